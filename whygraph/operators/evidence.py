"""Evidence tiers: four kinds of signal a thread, three of which lift its edges, reversibly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..schema import CORROBORATED_EDGES, CORROBORATING
from .decisions import side

KINDS = ("declared", "structural", "attested", "published")


def thread_signals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(thread_key, declared, structural, attested, published, category_count, corroborates) of every thread.

    One scan of the current explicit edges that extractors observed; edges that synthesis derived don't
    count, nor does authorship.
    """
    kind = (
        F.when((F.col("edge_type") == "closes") & F.col("extractor").endswith("_closing_keyword"), "declared")
        .when((F.col("edge_type") == "implements") & (F.col("extractor") == "pr_commit_list"), "structural")
        .when((F.col("edge_type") == "reviewed") & (F.col("extractor") == "pr_review"), "attested")
        .when((F.col("edge_type") == "deployed_by") & (F.col("extractor") == "release_notes_reference"), "published")
    )
    current = edges.filter("tag = 'explicit' and valid_to is null and edge_type in ('closes', 'implements', 'reviewed', 'deployed_by')")
    rows = current.select("src_id", "dst_id", kind.alias("kind"))
    threaded = nodes.filter("thread_key is not null")
    # Each kind is joined with the ends that it needs: two where both must be in the thread, else one.
    inside = rows.filter("kind in ('declared', 'structural')").join(side(threaded, "src", "thread_key"), "src_id").join(side(threaded, "dst", "thread_key", "node_type"), "dst_id")
    inside = inside.filter((F.col("src_thread_key") == F.col("dst_thread_key")) & ((F.col("kind") == "structural") | (F.col("dst_node_type") == "issue")))
    one_end = rows.filter("kind in ('attested', 'published')").select(F.when(F.col("kind") == "attested", F.col("dst_id")).otherwise(F.col("src_id")).alias("dst_id"), "kind")
    one_end = one_end.distinct().join(side(threaded, "dst", "thread_key"), "dst_id")
    signals = inside.select(F.col("dst_thread_key").alias("thread_key"), "kind").unionByName(one_end.select(F.col("dst_thread_key").alias("thread_key"), "kind"))
    flags = signals.groupBy("thread_key").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in KINDS])
    threads = nodes.filter("thread_key is not null").select("thread_key").distinct()
    full = threads.join(flags, "thread_key", "left").select("thread_key", *[F.coalesce(k, F.lit(False)).alias(k) for k in KINDS])
    count = sum((F.col(k).cast("int") for k in KINDS), F.lit(0))
    return full.withColumn("category_count", count).withColumn("corroborates", count >= CORROBORATING)


def qualifying(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, qualifies) of the edges that qualify for `corroborated`: those in a thread whose signals corroborate.

    An edge's thread is that of both its ends; an edge from a person has the thread of its target.
    """
    lifted = nodes.join(thread_signals(nodes, edges).filter("corroborates").select("thread_key"), "thread_key", "left_semi")
    able = edges.filter((F.col("tag") == "explicit") & F.col("valid_to").isNull() & F.col("edge_type").isin(*CORROBORATED_EDGES))
    ends = able.select("edge_id", "src_id", "dst_id").join(side(lifted, "dst", "thread_key"), "dst_id").join(side(nodes, "src", "thread_key", "node_type"), "src_id")
    inside = F.coalesce(F.col("src_thread_key") == F.col("dst_thread_key"), F.lit(False)) | (F.col("src_node_type") == "person")
    return ends.filter(inside).select("edge_id", F.lit(True).alias("qualifies")).distinct()


def apply_tiers(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with tiers set anew, one row of (upgraded, downgraded)); inferred edges are not touched.

    Only ids and keys are joined to find the edges that qualify; whole edges then meet the ids of these alone.
    """
    tier = F.when(F.col("tag") != "explicit", F.col("tier")).when(F.col("qualifies"), "corroborated").when(F.col("tier") == "corroborated", "explicit").otherwise(F.col("tier"))
    may = F.coalesce((F.col("tag") == "explicit") & (F.col("edge_type").isin(*CORROBORATED_EDGES) | (F.col("tier") == "corroborated")), F.lit(False))
    rows = edges.filter(may).join(durable(qualifying(nodes, edges)), "edge_id", "left").withColumn("qualifies", F.coalesce("qualifies", F.lit(False))).withColumn("after", tier)
    changed = rows.agg(F.count_if((F.col("tier") == "explicit") & (F.col("after") == "corroborated")).alias("upgraded"), F.count_if((F.col("tier") == "corroborated") & (F.col("after") == "explicit")).alias("downgraded"))
    return edges.filter(~may).unionByName(rows.withColumn("tier", F.col("after")).select(*edges.columns)), changed
