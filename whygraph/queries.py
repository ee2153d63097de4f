"""Registered queries over the derived graph, and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import durable
from .functions import text
from .operators import audit, decisions, evidence, gate, link, reason, retrieval
from .plans.build import derived_graph
from .schema import IMPACT_EDGES, SCORES, node_id
from .sources import derived
from .streaming import cursors as cursor_rules


def named(df: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """`df` with each id column replaced by `type:external id` of its node."""
    names = nodes.select(F.col("node_id").alias("__id"), F.concat("node_type", F.lit(":"), "external_id").alias("__name"))
    for c in columns:
        df = df.join(names, df[c] == names["__id"], "left").withColumn(c, F.col("__name")).drop("__id", "__name")
    return df


def nodes_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.nodes_by_type(derived_graph(spark, sf_dir).nodes)


def status_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return audit.status_by_repo(g.projected["repositories"][1], g.nodes)


def edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_graph(spark, sf_dir).observed.groupBy("edge_type", "extractor").agg(F.count("*").alias("n"), F.min("valid_from").alias("first"), F.max("valid_from").alias("last"))


def exploded(spark: SparkSession, sf_dir: str, column: Column, name: str) -> DataFrame:
    rows = derived.order_rows(spark, sf_dir).withColumn("body", derived.body())
    return rows.select("k", F.explode(column).alias(name))


def closing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(spark, sf_dir, text.closing_refs(F.col("body"), F.col("repo")), "ref_number")


def mentioned_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(spark, sf_dir, text.mentioned_refs(F.col("body"), F.col("repo")), "ref_number")


def foreign_url_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exploded(spark, sf_dir, text.foreign_url_refs(F.col("body"), F.col("repo")), "ref")


def commit_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.explode(text.commit_refs(F.col("text"))).alias("sha"))


def owner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    rows = named(g.projected["owners"][2], g.sighted_nodes, "src_id").join(g.projected["owners"][1].select(F.col("node_id").alias("dst_id"), "path_pattern"), "dst_id")
    return rows.select(F.col("src_id").alias("owner"), "path_pattern", "source_ref")


def resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    rows = named(g.observed.filter("edge_type in ('closes', 'references')"), g.sighted_nodes, "src_id", "dst_id")
    return rows.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), "edge_type", "extractor", "valid_from")


def pending_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return named(g.pending, g.sighted_nodes, "src_id").select("repo_id", F.col("src_id").alias("src"), "ref_number", "edge_type")


def pending_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return link.pending_status(g.pending, g.sighted_nodes)


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derived_graph(spark, sf_dir).threaded
    return nodes.filter("thread_key is not null").select(F.concat("node_type", F.lit(":"), "external_id").alias("node"), "thread_key")


def decision_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    found = decisions.candidates(g.threaded, g.observed, g.artifacts)
    rows = named(found, g.sighted_nodes, "implementer_id", "motivator_id")
    return rows.select("repo_id", "thread_key", F.col("implementer_id").alias("implementer"), F.col("motivator_id").alias("motivator"), "title", "decided_at")


def synthesis_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_graph(spark, sf_dir).synthesis.outcomes.select("thread_key", "outcome", F.coalesce("reason", F.lit("")).alias("reason"))


def rubric_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    rows = audit.rubric_audit(g.nodes, g.decisions, g.untiered, g.artifacts)
    return rows.select("cluster_thread_key", "title", "status", "has_motivation", "has_implementation", "has_validation", "passes")


def decisions_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    rows = g.decisions.join(g.nodes.select("node_id", "thread_key"), "node_id")
    return named(rows, g.nodes, "source_artifact_id").select("thread_key", "status", F.coalesce("source_artifact_id", F.lit("")).alias("artifact"))


def thread_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return evidence.thread_signals(g.threaded, g.observed)


def edge_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    edges, _ = evidence.apply_tiers(g.threaded, g.observed)
    return edges.groupBy("edge_type", "tier").agg(F.count("*").alias("edges"))


def starts(g, mode: str, kind: str, as_of: str, depth: int = 3) -> DataFrame:
    """One question for every node of a type."""
    return g.nodes.filter(F.col("node_type") == kind).select(F.col("node_id").alias("question_id"), F.col("node_id").alias("start_id"), F.lit(mode).alias("mode"), F.lit(depth).alias("depth"), F.lit(as_of).cast("timestamp").alias("as_of"))


def stop_names(nodes: DataFrame) -> DataFrame:
    """(node_id, label): the names by which paths are told."""
    return nodes.select("node_id", F.when(F.col("node_type") == "decision", F.concat(F.lit("decision:"), "thread_key")).otherwise(F.concat("node_type", F.lit(":"), "external_id")).alias("label"))


def labelled(paths: DataFrame) -> DataFrame:
    """`path_rows` of a walk with labels."""
    return paths.select("question_id", "depth", reason.path_tier(F.col("tier_rank")).alias("tier"), F.array_join("path_labels", " > ").alias("path"))


def path_rows(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """`paths` with their nodes named, as one string."""
    places = paths.select("question_id", "path_nodes", "path_edges", "depth", "tier_rank", F.posexplode("path_nodes").alias("place", "at"))
    names = stop_names(nodes).toDF("at", "name")
    rows = places.join(names, "at").groupBy("question_id", "path_edges", "depth", "tier_rank").agg(F.sort_array(F.collect_list(F.struct("place", "name"))).alias("stops"))
    return rows.select("question_id", "depth", reason.path_tier(F.col("tier_rank")).alias("tier"), F.array_join(F.col("stops.name"), " > ").alias("path"))


LATE, EARLY = "2100-01-01", "1997-01-01"


def walked(spark: SparkSession, sf_dir: str, mode: str, kind: str, as_of: str, depth: int) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    begun = starts(g, mode, kind, as_of, depth)
    if mode == "impact":  # every path answers, and at a busy release there are very many
        return labelled(reason.walk(begun, g.edges, most=depth, labels=stop_names(g.nodes))).select("depth", "tier", "path")
    ends = g.nodes.filter("node_type = 'decision'") if kind != "decision" else None  # where the answers to why end
    return path_rows(reason.answers(reason.walk(begun, g.edges, most=depth, ends=ends), begun, g.nodes), g.nodes).select("depth", "tier", "path")


def walk_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(spark, sf_dir, "why", "commit", LATE, 3)


def walk_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(spark, sf_dir, "impact", "issue", LATE, 2)


def walk_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(spark, sf_dir, "impact", "issue", EARLY, 2)


INSTANTS = ("1994-06-01", "1996-06-01", LATE)


def ended(g) -> DataFrame:
    """The graph's edges as if closing references had been edited out after 1 to 200 days, every third pull request's,
    and commits taken off after up to 1,500 days, of those whose number leaves 1 by 4."""
    k = g.nodes.filter("node_type = 'pull_request'").select(F.col("node_id").alias("src_id"), F.col("external_id").cast("long").alias("k"))
    lasts = F.when((F.col("edge_type") == "closes") & (F.col("k") % 3 == 0), F.col("k") % 200 + 1).when((F.col("edge_type") == "implements") & (F.col("k") % 4 == 1), F.col("k") % 1500)
    rows = g.edges.join(k, "src_id", "left").withColumn("valid_to", F.coalesce("valid_to", F.col("valid_from") + F.make_dt_interval(lasts.cast("int"))))
    return rows.select(*g.edges.columns)


def walk_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of every issue at three instants in one question set, over edges of which many have ended."""
    g = derived_graph(spark, sf_dir)
    begun = starts(g, "impact", "issue", LATE, 2).withColumn("as_of", F.explode(F.array(*map(F.lit, INSTANTS))))
    begun = begun.withColumn("question_id", F.concat_ws(" ", "as_of", "start_id")).withColumn("as_of", F.col("as_of").cast("timestamp"))
    followed = ended(g).filter(F.col("edge_type").isin(*IMPACT_EDGES)).select("edge_id", "src_id", "dst_id", "edge_type", "tag", "tier", "valid_from", "valid_to")
    paths = labelled(reason.walk(begun, durable(followed), most=2, labels=stop_names(g.nodes)))
    return paths.select(F.split_part("question_id", F.lit(" "), F.lit(1)).alias("as_of"), "depth", "tier", "path")


def inferred(g, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived proposals, with ids of the orders they link, gated."""
    rows = derived.proposals(spark, sf_dir)
    orders = derived.order_rows(spark, sf_dir)
    ids = orders.select("k", node_id(F.when(F.col("is_issue"), "issue").otherwise("pull_request"), F.col("repo_id"), F.col("k").cast("string")).alias("id"))
    rows = rows.join(ids.toDF("src_key", "src_id"), "src_key").join(ids.toDF("dst_key", "dst_id"), "dst_key")
    return gate.gate(rows.select("pos", "src_key", "dst_key", "src_id", "dst_id", "edge_type", "relevance"), g.nodes, g.untiered)


def inferred_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return inferred(g, spark, sf_dir).select("pos", "src_key", "dst_key", "outcome")


def answers_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact of every issue, one step deep: explicit edges first, inferred ones for issues that these leave without an answer."""
    g = derived_graph(spark, sf_dir)
    edges = g.edges.unionByName(gate.accepted_edges(inferred(g, spark, sf_dir), g.now))
    begun = starts(g, "impact", "issue", LATE, 1)
    _, summary = reason.reason(begun, g.nodes, edges, 1)
    return named(summary, g.nodes, "question_id").select(F.col("question_id").alias("start"), "answered", "used_inferred_fallback", "paths", "explanation")


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, title) of the first order of each repository and priority: those that the SQL of `retrieve_candidates` and `contract_checks` asks for."""
    return derived.order_rows(spark, sf_dir).groupBy("repo_id", F.split_part("title", F.lit(" order "), F.lit(1)).alias("priority")).agg(F.min_by(F.struct("k", "title"), "k").alias("first")).select("first.*")


def asked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, title) of the orders divisible by 20."""
    return derived.order_rows(spark, sf_dir).filter("k % 20 = 0").select("k", "title")


def questions(orders: DataFrame) -> DataFrame:
    """Titles, identifiers, beginnings and swapped titles of `orders` (k, title)."""
    swapped = F.concat(F.split_part("title", F.lit(" "), F.lit(-1)), F.lit(" order "), F.split_part("title", F.lit(" "), F.lit(1)))
    kinds = {"title": F.col("title"), "number": F.concat(F.lit(" #"), F.col("k").cast("string")), "start": F.substring("title", 1, 12), "swapped": swapped}
    each = F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("question")) for k, q in kinds.items()])
    return orders.select("k", F.inline(each)).select(F.concat("kind", F.lit(":"), F.col("k").cast("string")).alias("question_id"), "question")


def retrieve_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = derived_graph(spark, sf_dir).sighted_nodes.filter("node_type in ('issue', 'pull_request')")
    found = retrieval.find_candidates(questions(first_orders(spark, sf_dir)), nodes)
    return found.select("question_id", "rank", "external_id", "match", F.round("score", 5).alias("score"))


def decision_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    notes = decisions.credit(g.decisions, g.nodes, g.untiered, g.artifacts)
    return notes.join(g.nodes.select("node_id", "thread_key"), "node_id").select("thread_key", "note")


def facts(g) -> DataFrame:
    return audit.thread_facts(g.nodes, g.untiered, g.artifacts)


def recall_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recall_buckets(facts(derived_graph(spark, sf_dir)))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return audit.corpus_counts(facts(g), g.nodes)


def cross_thread_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return audit.cross_thread_closes(g.nodes, g.untiered)


def unmerged_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return audit.unmerged_detail(facts(g), g.nodes, g.artifacts).drop("state_reasons")


def issueless_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return audit.issueless_detail(facts(g), g.nodes, g.artifacts)


def tier_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tier_tally(walk_why(spark, sf_dir))


def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of the stated questions, kept or not by what retrieval found."""
    asked = questions(first_orders(spark, sf_dir))
    nodes = derived_graph(spark, sf_dir).sighted_nodes.filter("node_type in ('issue', 'pull_request')")
    counts = retrieval.find_candidates(asked, nodes, 3).groupBy("question_id").agg(F.count("*").alias("candidates"), F.max(F.when(F.col("score") >= SCORES["identifier"], True)).alias("sure"))
    kind = F.split_part("question_id", F.lit(":"), F.lit(1))
    contract = F.when(kind == "number", "No candidates expected").when(kind == "start", "No answer is expected").when(kind == "swapped", "same paths as its twin")
    rows = asked.join(counts, "question_id", "left").select("question_id", audit.contract_check(contract, F.coalesce("sure", F.lit(False)), F.coalesce("candidates", F.lit(0))).alias("check"))
    return rows.groupBy(F.split_part("question_id", F.lit(":"), F.lit(1)).alias("kind"), F.coalesce("check", F.lit("")).alias("contract_check")).agg(F.count("*").alias("n"))


def dq_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    people = g.nodes.filter("node_type = 'person'").select(F.col("external_id").alias("login"))
    return audit.violations(g.nodes, g.edges, g.decisions, g.pending, g.artifacts, people, g.projected["repositories"][1])


def planted_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over a graph with planted faults, by the numbers of orders: copies, loops, ends that are not there and the like."""
    g = derived_graph(spark, sf_dir)
    nodes, edges, now = g.nodes, g.edges, F.lit("1990-01-01").cast("timestamp")
    every = lambda n: F.expr(f"node_type in ('issue', 'pull_request') and cast(external_id as long) % {n} = 0")
    orders = nodes.filter(every(1)).select("node_id", "node_type", "external_id", F.col("external_id").cast("long").alias("k"))
    made = edges.filter("edge_type = 'created' and valid_to is null").join(orders.select(F.col("node_id").alias("dst_id"), "k"), "dst_id")
    some = lambda n: made.filter(F.col("k") % n == 0).drop("k").select(*edges.columns)
    edges = edges.unionByName(some(200).withColumn("src_id", F.col("dst_id"))).unionByName(some(50).withColumn("tier", F.lit("inferred")))
    edges = edges.unionByName(some(70).withColumn("valid_to", F.col("valid_from"))).unionByName(some(90).withColumn("dst_id", F.lit(-1) - F.col("seq")).withColumn("edge_type", F.lit("praised")))
    edges = edges.unionByName(some(110).withColumns({"edge_type": F.lit("mentions"), "relevance": F.lit(1.5).cast("decimal(5,4)")}))
    edges = edges.unionByName(some(130).withColumns({"edge_type": F.lit("relates_to"), "tag": F.lit("inferred"), "tier": F.lit("inferred")}))
    copies = nodes.filter(every(100)).unionByName(nodes.filter("node_type = 'team'").withColumns({"node_id": F.lit(-1) - F.col("node_id"), "repo_id": F.lit(9).cast("long")}))
    copies = copies.unionByName(nodes.filter("node_type = 'repository'").withColumns({"node_id": F.lit(-1) - F.col("node_id"), "repo_id": F.lit(9).cast("long")}))
    nodes = nodes.unionByName(copies)
    pending = g.pending.withColumn("resolved_at", F.when(F.col("ref_number") % 7 == 0, now)).unionByName(g.pending.filter("ref_number % 7 = 1"))
    artifacts = g.artifacts.withColumn("node_type", F.when(F.col("number") % 300 == 0, "wiki_page").otherwise(F.col("node_type")))
    people = nodes.filter("node_type = 'person'").select(F.col("external_id").alias("login"))
    people = people.unionByName(people.filter("login like '%7'"))
    repositories = g.projected["repositories"][1]
    status = lambda facts: facts.withColumn("source_artifact_id", F.lit(None).cast("long"))
    return audit.violations(nodes, edges, status(g.decisions), pending, artifacts, people, repositories.unionByName(repositories.filter("repo_id < 2")))


def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    return audit.graph_totals(g.nodes, g.untiered)


def cursor_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest and newest time a resource (event type) and day, and the watermark reached by that day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return cursor_rules.cursor_progress(events.select(F.col("event_type").alias("resource"), F.col("ts").alias("updated_at")))


QUERIES = {
    f.__name__: f
    for f in (
        nodes_by_type, status_by_repo, edges_by_type, closing_refs, mentioned_refs, foreign_url_refs, commit_mentions, owner_edges, resolved_edges, pending_refs, pending_status, threads,
        decision_candidates, synthesis_outcomes, rubric_audit, decisions_explicit, thread_categories, edge_tiers, walk_why, walk_impact, walk_as_of, walk_instants, inferred_gate, answers_with_fallback,
        retrieve_candidates, decision_credit, recall_buckets, corpus_counts, cross_thread_closes, unmerged_detail, issueless_detail, tier_tally, contract_checks, dq_violations, planted_violations,
        graph_totals, cursor_progress,
    )
}
