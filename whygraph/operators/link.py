"""From references in text to edges: resolution, the queue of what is not there yet, and its drain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..functions import text
from ..schema import edge_id


def reference_rows(bodies: DataFrame) -> DataFrame:
    """(repo_id, src_id, ref_number, edge_type, extractor, source_ref, observed_at, seq) of `bodies`.

    `bodies` has repo_id, repo, src_id, node_type, text, source_ref, observed_at, seq. A number that is
    closed is not also mentioned. Commit messages and other bodies give differently named provenance.
    """
    source = F.when(F.col("node_type") == "commit", "commit_message").otherwise("pr_body")
    found = F.concat(
        F.transform(text.closing_refs(F.col("text"), F.col("repo")), lambda n: F.struct(n.alias("ref_number"), F.lit("closes").alias("edge_type"), F.lit("_closing_keyword").alias("suffix"))),
        F.transform(text.mentioned_refs(F.col("text"), F.col("repo")), lambda n: F.struct(n.alias("ref_number"), F.lit("references").alias("edge_type"), F.lit("_issue_mention").alias("suffix"))),
    )
    rows = bodies.filter(F.col("text").contains("#") | F.col("text").contains("/issues/"))
    rows = rows.select("repo_id", "src_id", source.alias("source"), "source_ref", "observed_at", "seq", F.inline(found))
    return rows.select("repo_id", "src_id", "ref_number", "edge_type", F.concat("source", "suffix").alias("extractor"), "source_ref", "observed_at", "seq")


def targets(nodes: DataFrame) -> DataFrame:
    """(repo_id, ref_number, target_id): what `#N` means in a repository; a pull request before an issue."""
    first = lambda kind: F.min_by("node_id", F.when(F.col("node_type") == kind, F.coalesce("seq", F.lit(-(2**63)))))
    rows = nodes.filter(F.col("node_type").isin("issue", "pull_request")).groupBy("repo_id", "external_id").agg(F.coalesce(first("pull_request"), first("issue")).alias("target_id"))
    return rows.select("repo_id", F.col("external_id").cast("long").alias("ref_number"), "target_id")


def resolve(references: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges as sighted, references whose target is not in the graph): bodies are parsed and targets looked up once for both.

    Here and below, `known` are the `targets` of `nodes`, where the caller has them.
    """
    found = durable(references.join(targets(nodes) if known is None else known, ["repo_id", "ref_number"], "left"))
    edges = found.filter("target_id is not null").select("src_id", F.col("target_id").alias("dst_id"), "edge_type", "extractor", "source_ref", "observed_at", "seq")
    return edges, found.filter("target_id is null").select(*references.columns)


def enqueue(queue: DataFrame, unresolved: DataFrame) -> DataFrame:
    """`queue` with a row for each unresolved (source, number, type) that has no open row."""
    key = ["src_id", "ref_number", "edge_type"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("seq", "extractor"))
    new = unresolved.withColumn("__rank", rank).filter("__rank = 1").join(queue.filter("resolved_at is null"), key, "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    new = new.select("repo_id", *key, "extractor", "source_ref", "observed_at", F.lit(0).alias("attempts"), none("timestamp").alias("last_attempt_at"), none("timestamp").alias("resolved_at"), none("long").alias("resolved_edge_id"), "seq")
    return queue.unionByName(new.select(*queue.columns))


def drain(queue: DataFrame, nodes: DataFrame, now: Column, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(queue after one more attempt, edges as sighted) for the open rows of all repositories.

    A row whose target has come is resolved by that edge; a reference to its own source never is.
    """
    open_rows, done = queue.filter("resolved_at is null"), queue.filter("resolved_at is not null")
    tried = open_rows.join(targets(nodes) if known is None else known, ["repo_id", "ref_number"], "left")
    hit = F.col("target_id").isNotNull() & (F.col("target_id") != F.col("src_id"))
    edges = tried.filter(hit).select("src_id", F.col("target_id").alias("dst_id"), "edge_type", "extractor", "source_ref", "observed_at", "seq")
    edge = edge_id(F.col("src_id"), F.col("target_id"), F.col("edge_type"), F.coalesce("observed_at", now))
    after = tried.withColumns({"attempts": F.col("attempts") + 1, "last_attempt_at": now, "resolved_at": F.when(hit, now), "resolved_edge_id": F.when(hit, edge)})
    return done.unionByName(after.select(*queue.columns)), edges


def stored_bodies(artifacts: DataFrame, commits: DataFrame) -> DataFrame:
    """Bodies for `reference_rows` from stored details, to be linked again after a rule has widened."""
    one = artifacts.select("repo_id", "repo", F.col("node_id").alias("src_id"), "node_type", F.col("body").alias("text"), F.col("html_url").alias("source_ref"), F.col("updated_at").alias("observed_at"), "seq")
    two = commits.select("repo_id", "repo", F.col("node_id").alias("src_id"), F.lit("commit").alias("node_type"), F.col("message").alias("text"), F.col("sha").alias("source_ref"), F.col("committed_at").alias("observed_at"), "seq")
    return one.unionByName(two)


def reconcile(bodies: DataFrame, nodes: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges that stored bodies imply and the graph has not, references to queue)."""
    found, unresolved = resolve(reference_rows(bodies), nodes, known)
    current = edges.filter("valid_to is null").select("src_id", "dst_id", "edge_type")
    return found.filter("src_id <> dst_id").join(current, ["src_id", "dst_id", "edge_type"], "left_anti"), unresolved


def release_links(releases: DataFrame, nodes: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(deployed_by edges from what release notes cite, citations of what is not in the graph): notes are parsed once for both."""
    cited = F.array_union(text.mentioned_refs(F.col("body"), F.col("repo")), text.closing_refs(F.col("body"), F.col("repo")))
    rows = releases.select("repo_id", "node_id", "tag", "published_at", "seq", F.explode(cited).alias("ref_number"))
    found = durable(rows.join(targets(nodes) if known is None else known, ["repo_id", "ref_number"], "left"))
    edges = found.filter("target_id is not null").select(
        F.col("target_id").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit("deployed_by").alias("edge_type"), F.lit("release_notes_reference").alias("extractor"), F.col("tag").alias("source_ref"), F.col("published_at").alias("observed_at"), "seq"
    )
    return edges, found.filter("target_id is null").select("repo_id", "tag", "ref_number")


def pending_status(queue: DataFrame, nodes: DataFrame) -> DataFrame:
    """Open references by repository and type: how many could be resolved now, how many have no target."""
    rows = queue.filter("resolved_at is null").join(targets(nodes), ["repo_id", "ref_number"], "left")
    here = F.col("target_id").isNotNull()
    return rows.groupBy("repo_id", "edge_type").agg(F.count("*").alias("open_refs"), F.count_if(here).alias("resolvable_now"), F.count_if(~here).alias("target_outside_window"), F.max("attempts").alias("max_attempts"))
