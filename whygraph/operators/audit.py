"""Audits, reports and data-quality checks over the graph's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schema import EDGE_TYPES, NODE_TYPES, STATUSES, TAGS, TIERS
from .decisions import landed_threads, rubric, side


def nodes_by_type(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def status_by_repo(repositories: DataFrame, nodes: DataFrame) -> DataFrame:
    """Artifacts of every repository, also of those with none, and people, who belong to none, as a row of their own."""
    kinds = ("issue", "pull_request", "commit", "release", "decision")
    counts = nodes.filter("repo_id is not null").groupBy("repo_id").agg(*[F.count_if(F.col("node_type") == k).alias(f"{k}s") for k in kinds])
    named = repositories.select("repo_id", F.concat_ws("/", "owner", "name").alias("repo"))
    rows = named.join(counts, "repo_id", "left").select("repo", *[F.coalesce(f"{k}s", F.lit(0)).alias(f"{k}s") for k in kinds], F.lit(0).cast("long").alias("people"))
    people = nodes.agg(F.lit("(people)").alias("repo"), *[F.lit(0).cast("long").alias(f"{k}s") for k in kinds], F.count_if(F.col("node_type") == "person").alias("people"))
    return rows.unionByName(people)


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, current edges, distinct threads, decisions."""
    one = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("thread_key").alias("threads"), F.count_if(F.col("node_type") == "decision").alias("decisions"), F.lit(0).cast("long").alias("current_edges"))
    two = edges.agg(F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("threads"), F.lit(0).cast("long").alias("decisions"), F.count_if(F.col("valid_to").isNull()).alias("current_edges"))
    return one.unionByName(two).agg(*[F.sum(c).alias(c) for c in ("nodes", "current_edges", "threads", "decisions")])


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.agg(*[F.max_by(c, "started_at").alias(c) for c in runs.columns])


def cursor_report(cursors: DataFrame, repositories: DataFrame) -> DataFrame:
    """Cursors with repository names; the phase means something for commits only."""
    names = repositories.select("repo_id", F.concat_ws("/", "owner", "name").alias("repo"))
    return cursors.join(names, "repo_id").select("repo", "resource", F.when(F.col("resource") == "commits", F.col("phase")).alias("phase"), "steady_watermark", "backfill_cursor")


def rubric_audit(nodes: DataFrame, decisions: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every decision with its title, status and rubric."""
    named = decisions.select("node_id", "status").join(nodes.select("node_id", "title"), "node_id")
    return named.join(rubric(decisions, edges, nodes, edges, artifacts), "node_id")


def thread_facts(nodes: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(repo_id, thread_key, has_decision, has_issue, members, closes_in_thread, landed) of threads with a member that is no decision."""
    kind = lambda k: F.bool_or(F.col("node_type") == k)
    threads = nodes.filter("thread_key is not null").groupBy("thread_key").agg(
        F.min(F.when(F.col("node_type") != "decision", F.col("repo_id"))).alias("repo_id"), kind("decision").alias("has_decision"), kind("issue").alias("has_issue"), F.count_if(F.col("node_type") != "decision").alias("members"),
    ).filter("members > 0")
    closing = edges.filter("edge_type = 'closes' and valid_to is null").select("src_id", "dst_id").join(side(nodes, "src", "thread_key"), "src_id").join(side(nodes, "dst", "thread_key"), "dst_id")
    closing = closing.filter("src_thread_key = dst_thread_key").select(F.col("src_thread_key").alias("thread_key")).distinct().withColumn("closes_in_thread", F.lit(True))
    landed = landed_threads(nodes, artifacts).withColumn("landed", F.lit(True))
    rows = threads.join(closing, "thread_key", "left").join(landed, "thread_key", "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("closes_in_thread", "landed")})


def bucket() -> Column:
    return (
        F.when(~F.col("has_issue"), "A  no issue in thread").when(F.col("members") == 1, "D  singleton issue").when(~F.col("closes_in_thread"), "C  issue, no in-thread closes")
        .when(~F.col("landed"), "B  closes, nothing merged").otherwise("F  residual")
    )


def recall_buckets(facts: DataFrame) -> DataFrame:
    """Threads without a decision, by the first reason that explains it."""
    return facts.filter(~F.col("has_decision")).groupBy(bucket().alias("bucket")).agg(F.count("*").alias("threads"))


def corpus_counts(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per repository: threads with and without a decision, pull requests, issues, commits."""
    threads = facts.groupBy("repo_id").agg(F.count("*").alias("threads"), F.count_if("has_decision").alias("decision_threads"), F.count_if(~F.col("has_decision")).alias("non_decision_threads"))
    kinds = nodes.filter("repo_id is not null").groupBy("repo_id").agg(*[F.count_if(F.col("node_type") == k).alias(f"{k}s") for k in ("pull_request", "issue", "commit")])
    rows = threads.join(kinds, "repo_id", "full_outer")
    return rows.select("repo_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns if c != "repo_id"])


def cross_thread_closes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many current closing references cross threads; none should."""
    rows = edges.filter("edge_type = 'closes' and valid_to is null").join(side(nodes, "src", "thread_key"), "src_id").join(side(nodes, "dst", "thread_key"), "dst_id")
    return rows.agg(F.count_if(~F.col("src_thread_key").eqNullSafe(F.col("dst_thread_key"))).alias("cross_thread_closes"))


def unmerged_detail(facts: DataFrame, nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per thread of bucket B: its issues, their closing reasons, and its pull requests and commits."""
    threads = facts.filter(~F.col("has_decision")).filter(bucket().startswith("B")).select("thread_key")
    rows = nodes.join(threads, "thread_key", "left_semi").join(artifacts.select("node_id", "state_reason"), "node_id", "left")
    issue = F.col("node_type") == "issue"
    return rows.groupBy("thread_key").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(issue, F.col("external_id")))), ",").alias("issues"), F.array_join(F.sort_array(F.collect_set(F.when(issue, F.col("state_reason")))), ",").alias("state_reasons"),
        F.count_if(F.col("node_type") == "pull_request").alias("prs"), F.count_if(F.col("node_type") == "commit").alias("commits"),
    )


def issueless_detail(facts: DataFrame, nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row about bucket A: its pull requests and commits, and pull requests with a closing word or any reference."""
    threads = facts.filter("not has_decision and not has_issue").select("thread_key")
    rows = nodes.join(threads, "thread_key", "left_semi").join(artifacts.select("node_id", "body"), "node_id", "left")
    pull = F.col("node_type") == "pull_request"
    return rows.agg(
        F.count_if(pull).alias("prs"), F.count_if(F.col("node_type") == "commit").alias("commits"),
        F.count_if(pull & F.col("body").rlike(text.AUDIT_CLOSING)).alias("prs_with_closing_word"), F.count_if(pull & F.col("body").rlike("#[0-9]+")).alias("prs_with_any_ref"),
    )


def contract_check(contract: Column, answered: Column, candidates: Column) -> Column:
    """Whether a result keeps its question's contract: HELD, VIOLATED with a reason, COMPARE, or null."""
    said = F.lower(contract)
    return (
        F.when(said.contains("no candidates"), F.when(candidates == 0, "HELD").otherwise("VIOLATED: candidates were returned"))
        .when(said.contains("no answer"), F.when(~answered, "HELD").otherwise("VIOLATED: an answer was returned"))
        .when(said.contains("fewer paths") | said.contains("same paths"), "COMPARE")
    )


def evaluation_summary(results: DataFrame) -> DataFrame:
    """One row over results (answered, used_inferred_fallback, contract_check)."""
    return results.agg(
        F.count("*").alias("total"), F.count_if("answered").alias("answered"), F.count_if(~F.col("answered")).alias("returned_no_answer"), F.count_if(F.col("contract_check").isin("HELD", "VIOLATED")).alias("contracts_checked"),
        F.count_if(F.col("contract_check") == "HELD").alias("contracts_held"), F.count_if("used_inferred_fallback").alias("used_inferred_fallback"),
    )


def sibling_compare(results: DataFrame, compare: str = "COMPARE") -> DataFrame:
    """Results to be compared, each beside the other results of the same question and mode: (id, sibling, paths, sibling_paths)."""
    one = results.filter(F.col("contract_check") == compare).select("id", "query", "mode", "paths")
    two = results.select(F.col("id").alias("sibling"), "query", "mode", F.col("paths").alias("sibling_paths"))
    return one.join(two, ["query", "mode"]).filter("id <> sibling").select("id", "sibling", "paths", "sibling_paths")


def tier_tally(paths: DataFrame) -> DataFrame:
    return paths.groupBy("tier").agg(F.count("*").alias("paths"))


def violations(nodes: DataFrame, edges: DataFrame, decisions: DataFrame, pending: DataFrame, artifacts: DataFrame, people: DataFrame, repositories: DataFrame) -> DataFrame:
    """(rule, violations) of every data-quality rule, also of those that hold.

    Each table is read once for the rules on single rows, once for the keys that must be unique and once for
    the references that must exist; keys and references of all tables are tagged with their rule and go
    through one grouping and one join.
    """
    unknown = lambda column, known: ~F.col(column).isin(*known)
    decided = (F.col("node_type") == "decision") & F.col("thread_key").isNotNull()
    single = [
        (nodes, {
            "a repository belongs to none": (F.col("node_type") == "repository") & F.col("repo_id").isNotNull(),
            "a decision's key names its repository": decided & (F.split_part("thread_key", F.lit(":"), F.lit(2)) != F.col("repo_id").cast("string")),
            "node types are known": unknown("node_type", NODE_TYPES),
        }),
        (edges, {
            "no edge to itself": F.col("src_id") == F.col("dst_id"),
            "edges end after they begin": F.col("valid_to") <= F.col("valid_from"),
            "tag and tier agree": (F.col("tag") == "inferred") != (F.col("tier") == "inferred"),
            "relevance is a share": (F.col("relevance") < 0) | (F.col("relevance") > 1),
            "inferred edges have a relevance": (F.col("tag") == "inferred") & F.col("relevance").isNull(),
            "edge types, tags and tiers are known": unknown("edge_type", EDGE_TYPES) | unknown("tag", TAGS) | unknown("tier", TIERS),
        }),
        (decisions.join(rubric(decisions, edges, nodes, edges, artifacts).select("node_id", "passes"), "node_id", "left"), {
            "explicit decisions have an artifact": (F.col("status") == "explicit") & F.col("source_artifact_id").isNull(),
            "reconstructed decisions pass the rubric": (F.col("status") == "reconstructed") & ~F.col("passes"),
            "decision statuses are known": unknown("status", STATUSES),
        }),
        (pending, {"resolution has its time and its edge": F.col("resolved_at").isNull() != F.col("resolved_edge_id").isNull()}),
    ]
    found = [df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())]).select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("violations")) for i, r in enumerate(rules)]))) for df, rules in single]

    text_of = lambda *columns: F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") if isinstance(c, str) else c.cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))
    keys = lambda df, *tagged: df.select(F.inline(F.array(*[F.struct(F.lit(rule).alias("rule"), F.when(when, key).alias("key")) for rule, when, key in tagged]))).filter("key is not null")
    always = F.lit(True)
    cut = F.split("external_id", "/", 2)
    tagged = [
        keys(nodes, ("node identity is unique", always, text_of("node_type", F.coalesce("repo_id", F.lit(0)), "external_id")), ("node ids are unique", always, text_of("node_id")), ("one decision a thread", decided, text_of("repo_id", "thread_key")), ("team names are unique", F.col("node_type") == "team", text_of(cut[0], cut[1]))),
        keys(edges, ("one current edge a pair and type", F.col("valid_to").isNull(), text_of("src_id", "dst_id", "edge_type"))),
        keys(pending, ("one open reference a source, number and type", F.col("resolved_at").isNull(), text_of("src_id", "ref_number", "edge_type"))),
        keys(people, ("logins are unique", always, text_of("login"))), keys(repositories, ("repository names are unique", always, text_of("owner", "name"))),
    ]
    many = reduce(DataFrame.unionByName, tagged).groupBy("rule", "key").count().filter("count > 1").groupBy("rule").agg(F.count("*").alias("violations"))

    needs = lambda df, rule, column, kind=None: df.select(F.lit(rule).alias("rule"), F.col(column).alias("node_id"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"))
    wanted = [
        needs(edges.select(F.explode(F.array("src_id", "dst_id")).alias("end")), "edges have both ends", "end"), needs(decisions, "decisions' artifacts exist", "source_artifact_id"), needs(pending, "references have a source", "src_id"),
        needs(decisions, "decisions are decision nodes", "node_id", F.lit("decision")), needs(artifacts, "artifacts have their node", "node_id", F.col("node_type")),
    ]
    have = nodes.select("node_id", "node_type").distinct()
    missing = reduce(DataFrame.unionByName, wanted).filter("node_id is not null").join(have, "node_id", "left").filter("node_type is null or node_type <> kind")
    found += [many, missing.groupBy("rule").agg(F.count("*").alias("violations"))]
    names = [r for _, rules in single for r in rules] + [
        "node identity is unique", "node ids are unique", "one decision a thread", "team names are unique", "one current edge a pair and type", "one open reference a source, number and type",
        "logins are unique", "repository names are unique", "edges have both ends", "decisions' artifacts exist", "references have a source", "decisions are decision nodes", "artifacts have their node",
    ]
    every = nodes.sparkSession.createDataFrame([(n,) for n in names], "rule string")
    return every.join(reduce(DataFrame.unionByName, found), "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).alias("violations"))
