"""Decisions: candidates, the rubric, promotion, refusal, retraction and upgrade."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..schema import RUBRIC_EDGES, node_id
from .upsert import upsert_edges, withdraw_edges


def current(edges: DataFrame, *types: str) -> DataFrame:
    """Current explicit edges of the given types."""
    return edges.filter(F.col("edge_type").isin(*types) & (F.col("tag") == "explicit") & F.col("valid_to").isNull())


def side(nodes: DataFrame, name: str, *columns: str) -> DataFrame:
    return nodes.select(F.col("node_id").alias(f"{name}_id"), *[F.col(c).alias(f"{name}_{c}") for c in columns])


def landed_threads(nodes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The thread keys with a merged pull request."""
    merged = artifacts.filter("merged_at is not null").select("node_id")
    return nodes.filter("node_type = 'pull_request' and thread_key is not null").join(merged, "node_id", "left_semi").select("thread_key").distinct()


def candidates(nodes: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One (repo_id, thread_key, implementer_id, motivator_id, title, decided_at) a thread in which something closes an issue.

    The implementer is a merged pull request before others, a pull request before a commit; then the
    motivator and the implementer that were seen first. Those seen at equal places, as on pages of two
    landings, go by id, so that the choice follows from the rows alone.
    """
    src = side(nodes, "src", "node_type", "repo_id", "thread_key", "seq")
    dst = side(nodes.filter("node_type = 'issue'"), "dst", "thread_key", "title", "seq")
    rows = current(edges, "closes").select("src_id", "dst_id").join(src, "src_id").join(dst, "dst_id").filter("src_thread_key = dst_thread_key")
    pulls = artifacts.filter("node_type = 'pull_request'").select(F.col("node_id").alias("src_id"), "merged_at", F.col("closed_at").alias("pull_closed_at"))
    issues = artifacts.filter("node_type = 'issue'").select(F.col("node_id").alias("dst_id"), F.col("closed_at").alias("issue_closed_at"))
    rows = rows.join(pulls, "src_id", "left").join(issues, "dst_id", "left")
    order = [F.col("merged_at").isNull(), F.col("src_node_type") != "pull_request", "dst_seq", "src_seq", "dst_id", "src_id"]
    rank = F.row_number().over(Window.partitionBy("src_repo_id", "src_thread_key").orderBy(*order))
    best = rows.withColumn("__rank", rank).filter("__rank = 1")
    return best.select(
        F.col("src_repo_id").alias("repo_id"), F.col("src_thread_key").alias("thread_key"), F.col("src_id").alias("implementer_id"), F.col("dst_id").alias("motivator_id"),
        F.col("dst_title").alias("title"), F.coalesce("merged_at", "pull_closed_at", "issue_closed_at").alias("decided_at"), F.col("dst_seq").alias("seq"),
    )


def validated_threads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The thread keys that a current review or closing reference touches at either end."""
    keys = nodes.filter("thread_key is not null").select("node_id", "thread_key")
    ends = current(edges, "reviewed", "closes").select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    return ends.join(keys, "node_id").select("thread_key").distinct()


def rubric(decisions: DataFrame, claims: DataFrame, nodes: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The rubric of each of `decisions` (node_id), from its `claims`: its current explicit rubric edges.

    Motivation is an edge to an issue, pull request or wiki page. The targets must all be in one thread;
    a target without a thread breaks that. In that thread something must have merged, and then either an
    implementing commit or pull request, or a review or closing reference, is enough.
    """
    ends = side(nodes, "dst", "node_type", "thread_key")
    rows = current(claims, "motivated_by", "implemented_by").select("src_id", "dst_id", "edge_type").join(ends, "dst_id")
    is_type = lambda kind, *types: F.coalesce(F.bool_or((F.col("edge_type") == kind) & F.col("dst_node_type").isin(*types)), F.lit(False))
    facts = rows.groupBy(F.col("src_id").alias("node_id")).agg(
        is_type("motivated_by", "issue", "pull_request", "wiki_page").alias("has_motivation"), is_type("implemented_by", "commit", "pull_request").alias("implements"),
        F.countDistinct("dst_thread_key").alias("threads"), F.bool_or(F.col("dst_thread_key").isNull()).alias("unthreaded"), F.min("dst_thread_key").alias("thread"),
    )
    facts = decisions.select("node_id").join(facts, "node_id", "left")
    coherent = F.coalesce((F.col("threads") == 1) & ~F.col("unthreaded"), F.lit(False))
    spans = F.coalesce(F.col("threads"), F.lit(0)) + F.coalesce(F.col("unthreaded").cast("int"), F.lit(0))
    facts = facts.select("node_id", F.coalesce("has_motivation", F.lit(False)).alias("has_motivation"), F.coalesce("implements", F.lit(False)).alias("implements"), spans.alias("spans"), coherent.alias("thread_coherent"), F.when(coherent, F.col("thread")).alias("cluster_thread_key"))
    landed = landed_threads(nodes, artifacts).select(F.col("thread_key").alias("cluster_thread_key"), F.lit(True).alias("landed"))
    valid = validated_threads(nodes, edges).select(F.col("thread_key").alias("cluster_thread_key"), F.lit(True).alias("valid"))
    facts = facts.join(landed, "cluster_thread_key", "left").join(valid, "cluster_thread_key", "left").withColumn("landed", F.coalesce("landed", F.lit(False)))
    facts = facts.withColumn("has_implementation", F.col("landed") & F.col("implements")).withColumn("has_validation", F.col("landed") & F.coalesce("valid", F.lit(False)))
    passes = F.col("has_motivation") & (F.col("has_implementation") | F.col("has_validation")) & F.col("thread_coherent")
    thread = F.coalesce("cluster_thread_key", F.lit("<none>"))
    reason = (
        F.when(passes, F.lit(None))
        .when(~F.col("has_motivation"), F.lit("clause 1: no explicit motivated_by edge to an issue/PR/wiki page"))
        .when(~F.col("thread_coherent"), F.concat(F.lit("clause 3: rubric edges span "), F.col("spans").cast("string"), F.lit(" thread(s) or an unthreaded node")))
        .when(~F.col("landed"), F.concat(F.lit("clause 2: nothing in thread "), thread, F.lit(" was ever merged")))
        .otherwise(F.concat(F.lit("clause 2: neither implemented_by nor a reviewed/closes edge in thread "), thread))
    )
    return facts.select("node_id", "has_motivation", "has_implementation", "has_validation", "cluster_thread_key", "thread_coherent", passes.alias("passes"), reason.alias("failure_reason"))


def claimed(chosen: DataFrame) -> DataFrame:
    """The rubric edges, as sighted, that the `chosen` candidates (with node_id) assert."""
    pair = F.array(
        F.struct(F.lit("motivated_by").alias("edge_type"), F.col("motivator_id").alias("dst_id")), F.struct(F.lit("implemented_by").alias("edge_type"), F.col("implementer_id").alias("dst_id"))
    )
    rows = chosen.select(F.col("node_id").alias("src_id"), F.col("thread_key").alias("source_ref"), F.col("decided_at").alias("observed_at"), "seq", F.inline(pair))
    return rows.select("src_id", "dst_id", "edge_type", F.lit("synthesis_closes_cluster").alias("extractor"), "source_ref", "observed_at", "seq")


@dataclass
class Synthesis:
    nodes: DataFrame
    decisions: DataFrame
    edges: DataFrame
    outcomes: DataFrame  # thread_key, outcome (created, refreshed, refused), reason


def synthesize(nodes: DataFrame, decisions: DataFrame, edges: DataFrame, artifacts: DataFrame, now: Column) -> Synthesis:
    """Promotes each candidate thread to one decision, or refuses it with the rubric clause that fails.

    A thread's decision is found by its live key, whatever name it was created under; if two have come
    together by a merge, the one seen first is used. Rubric edges that are no longer chosen are closed.
    A candidate is judged on the edges that it would have; a refused one changes nothing.
    """
    existing = nodes.filter("node_type = 'decision' and thread_key is not null").groupBy("repo_id", "thread_key").agg(F.min_by("node_id", F.struct("seq", "node_id")).alias("old_id"))
    found = candidates(nodes, edges, artifacts).join(existing, ["repo_id", "thread_key"], "left")
    new_id = node_id(F.lit("decision"), F.col("repo_id"), F.col("thread_key"))
    found = durable(found.withColumn("node_id", F.coalesce("old_id", new_id)))
    asserted = claimed(found)
    proposed = asserted.select("src_id", "dst_id", "edge_type", F.lit("explicit").alias("tag"), F.lit(None).cast("timestamp").alias("valid_to"))
    judged = durable(found.join(rubric(found, proposed, nodes, edges, artifacts).select("node_id", "passes", "failure_reason"), "node_id"))
    outcome = F.when(~F.col("passes"), "refused").when(F.col("old_id").isNull(), "created").otherwise("refreshed")
    outcomes = judged.select("repo_id", "thread_key", "node_id", outcome.alias("outcome"), F.col("failure_reason").alias("reason"))
    chosen = judged.filter("passes")

    ids = chosen.select("node_id", F.col("repo_id").alias("new_repo"), F.col("thread_key").alias("new_key"), F.col("title").alias("new_title"), F.col("decided_at").alias("new_time"), F.col("seq").alias("new_seq"))
    is_decision = F.col("node_type").eqNullSafe("decision")
    joined = nodes.filter(is_decision).join(ids, "node_id", "full_outer")
    is_new, touched = F.col("node_type").isNull(), F.col("new_key").isNotNull()
    filled = {
        "repo_id": F.coalesce("repo_id", "new_repo"), "external_id": F.coalesce("new_key", "external_id"), "title": F.coalesce("new_title", "title"), "thread_key": F.coalesce("thread_key", "new_key"),
        "source_created_at": F.when(is_new, F.col("new_time")).otherwise(F.col("source_created_at")), "seq": F.coalesce("seq", "new_seq"), "node_type": F.when(touched, "decision").otherwise(F.col("node_type")),
    }
    merged_nodes = nodes.filter(~is_decision).unionByName(joined.withColumns(filled).select(*nodes.columns))
    facts = decisions.join(ids.select("node_id", "new_title", "new_time"), "node_id", "full_outer")
    fresh = F.col("new_title").isNotNull() | F.col("status").isNull()
    merged = facts.select("node_id", F.coalesce("status", F.lit("reconstructed")).alias("status"), F.when(fresh, F.col("new_title")).otherwise(F.col("summary")).alias("summary"), F.when(fresh, F.col("new_time")).otherwise(F.col("decided_at")).alias("decided_at"), "source_artifact_id")

    asserted, is_claim = claimed(chosen), F.col("edge_type").isin(*RUBRIC_EDGES)
    claims = edges.filter(is_claim)
    stale = claims.filter("valid_to is null").join(chosen.select(F.col("node_id").alias("src_id")), "src_id", "left_semi")
    stale = stale.join(asserted.select("src_id", "dst_id"), ["src_id", "dst_id"], "left_anti")
    claims = upsert_edges(withdraw_edges(claims, stale, now), asserted, now).drop("created")
    return Synthesis(merged_nodes, merged, edges.filter(~is_claim).unionByName(claims), outcomes)


def unsupported(nodes: DataFrame, decisions: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The reconstructed decisions that fail the rubric, to be deleted; explicit ones are never among them."""
    bad = rubric(decisions, edges, nodes, edges, artifacts).filter(~F.col("passes"))
    return decisions.filter("status = 'reconstructed'").join(bad, "node_id", "left_semi").join(nodes.select("node_id", "thread_key"), "node_id").select("node_id", "thread_key")


def release_records(nodes: DataFrame, decisions: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, release_id, release_title, via): the first release that cites something in a reconstructed decision's thread."""
    cited = side(nodes.filter("thread_key is not null"), "src", "thread_key", "external_id", "seq")
    released = side(nodes.filter("node_type = 'release'"), "dst", "title", "seq")
    rows = current(edges, "deployed_by").select("src_id", "dst_id").join(cited, "src_id").join(released, "dst_id")
    open_ones = nodes.filter("node_type = 'decision'").join(decisions.filter("status = 'reconstructed'").select("node_id"), "node_id", "left_semi").select("node_id", F.col("thread_key").alias("src_thread_key"))
    first = F.min(F.struct("dst_seq", "dst_id", "dst_title", "src_seq", "src_external_id")).alias("first")
    best = rows.join(open_ones, "src_thread_key").groupBy("node_id").agg(first)
    return best.select("node_id", F.col("first.dst_id").alias("release_id"), F.col("first.dst_title").alias("release_title"), F.col("first.src_external_id").alias("via"))


def upgrade_explicit(nodes: DataFrame, decisions: DataFrame, edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decisions, edges, upgraded): a release note that cites a decision's thread makes it explicit."""
    found = durable(release_records(nodes, decisions, edges))
    up = F.col("release_id").isNotNull()
    after = decisions.join(found.select("node_id", "release_id"), "node_id", "left")
    after = after.withColumn("status", F.when(up, "explicit").otherwise(F.col("status"))).withColumn("source_artifact_id", F.coalesce("release_id", "source_artifact_id"))
    ref = F.concat(F.lit("release:"), "release_title", F.lit(" via #"), "via")
    seen = found.select(F.col("node_id").alias("src_id"), F.col("release_id").alias("dst_id"), F.lit("deployed_by").alias("edge_type"), F.lit("synthesis_release_note").alias("extractor"), ref.alias("source_ref"), F.lit(None).cast("timestamp").alias("observed_at"), F.lit(0).cast("long").alias("seq"))
    deployed = upsert_edges(edges.filter("edge_type = 'deployed_by'"), seen, now).drop("created")
    return after.select(*decisions.columns), edges.filter("edge_type <> 'deployed_by'").unionByName(deployed), found


def credit(decisions: DataFrame, nodes: DataFrame, edges: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(node_id, note): all current implementers of each decision, with merge dates, or that there is none."""
    from ..functions.text import implementer_phrase

    pulls = artifacts.filter("node_type = 'pull_request'").select(F.col("node_id").alias("dst_id"), "merged_at")
    done = edges.filter("edge_type = 'implemented_by' and valid_to is null").select(F.col("src_id").alias("node_id"), "dst_id")
    rows = decisions.select("node_id").join(done.join(side(nodes, "dst", "node_type", "external_id"), "dst_id").join(pulls, "dst_id", "left"), "node_id", "left")
    phrase = implementer_phrase(F.col("dst_node_type"), F.col("dst_external_id"), F.col("merged_at"))
    notes = rows.groupBy("node_id").agg(F.sort_array(F.collect_list(F.when(F.col("dst_external_id").isNotNull(), F.struct(F.col("dst_external_id").alias("ref"), phrase.alias("phrase"))))).alias("all"))
    note = F.when(F.size("all") == 0, F.lit("no current implementer")).otherwise(F.concat(F.lit("implemented by "), F.array_join(F.col("all.phrase"), "; ")))
    return notes.select("node_id", note.alias("note"))
