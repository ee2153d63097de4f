"""Keyed merges of batches into the graph's tables; each returns a new snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import durable
from ..schema import edge_id


def last(column: str) -> Column:
    """The last value by seq that is not null."""
    return F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)


#: Kinds of nodes that most batches sight many times; others come as a rule once.
RECURRING = ("person", "team")
IDENTITY = ("node_type", "repo_id", "external_id")


def once_or_more(batch: DataFrame, *key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of `batch` whose `key` no other row has, all others): only hashes of keys are shuffled for it. Repeated ones
    are written, so that the joins with them are planned by their size and a few are broadcast before any row of `batch`
    is shuffled. Keys of equal hash count as repeated, so the others still have to be grouped by key."""
    return apart(repeated([batch], key), batch, key)


def repeated(frames: list[DataFrame], key: Sequence[str]) -> DataFrame:
    """(__key): the hashes of `key` that stand in several rows of `frames`, written."""
    hashes = reduce(DataFrame.unionByName, [df.select(F.xxhash64(*key).alias("__key")) for df in frames])
    return durable(hashes.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1").select("__key"))


def apart(again: DataFrame, rows: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(`rows` whose key's hash is not in `again`, the others)."""
    marked = rows.withColumn("__key", F.xxhash64(*key))
    return marked.join(again, "__key", "left_anti").drop("__key"), marked.join(again, "__key", "left_semi").drop("__key")


def met(current: DataFrame, batch: DataFrame, *key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows of `current` that no row of `batch` meets by `key`, its others, rows of `batch` that stand alone, its others).

    Most rows of a batch are new and most rows of a table are left as they are; both pass by without being shuffled.
    """
    again = repeated([current, batch], key)
    return *apart(again, current, key), *apart(again, batch, key)


def folded(batch: DataFrame) -> DataFrame:
    """One row a node_id of `batch`. Rows that differ in `seq` only are first counted as one, which keeps the first and
    the last place where it was seen, so that of a name that is sighted very often few rows are shuffled and sorted."""
    columns = [c for c in batch.columns if c != "seq"]
    seen = batch.groupBy(*columns).agg(F.min("seq").alias("from"), F.max("seq").alias("to"))
    at_last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("to"))).alias(c)
    return seen.groupBy("node_id").agg(
        *[F.min_by(c, "from").alias(c) for c in IDENTITY], *[at_last(c) for c in ("forge_id", "title", "url", "raw")], F.min_by(F.col("thread_key"), F.when(F.col("thread_key").isNotNull(), F.col("from"))).alias("thread_key"),
        F.min_by("source_created_at", "from").alias("source_created_at"), F.max("source_updated_at").alias("source_updated_at"), F.min("from").alias("seq"),
    )


def upsert_nodes(current: DataFrame, batch: DataFrame) -> DataFrame:
    """`current` with the sightings of `batch` merged in, by node_id.

    New values that are not null win for forge_id, title, url and raw; an old thread_key wins;
    source_updated_at is the latest; source_created_at and seq stay as first written.
    """
    often = F.coalesce(F.col("node_type").isin(*RECURRING), F.lit(False))
    passed, touched, once, more = met(current.filter(~often), batch.filter(~often), "node_id")
    old, new = current.filter(often).unionByName(touched).alias("old"), folded(batch.filter(often).unionByName(more)).alias("new")
    was = F.col("old.node_id").isNotNull()
    newest = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    oldest = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c)
    kept = lambda c: F.when(was, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c)
    latest = F.greatest("old.source_updated_at", "new.source_updated_at").alias("source_updated_at")
    joined = old.join(new, F.col("old.node_id") == F.col("new.node_id"), "full_outer")
    merged = joined.select(oldest("node_id"), *map(kept, IDENTITY), *map(newest, ("forge_id", "title", "url")), oldest("thread_key"), kept("source_created_at"), latest, newest("raw"), kept("seq"))
    return merged.unionByName(passed).unionByName(once)


def upsert_details(current: DataFrame, batch: DataFrame) -> DataFrame:
    """The last row of each node_id of `batch` replaces the row of `current`, nulls included."""
    rank = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("seq")))
    passed, touched, once, more = met(current, batch, "node_id")
    rows = more.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
    return passed.unionByName(touched.join(rows, "node_id", "left_anti")).unionByName(rows.unionByName(once).select(*current.columns))


def upsert_edges(current: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """`current` with the explicit sightings of `batch` merged in, and a column `created`.

    Current edges merge by (source, target, type): the last extractor wins, source_ref and observed_at
    the last that are not null; valid_from, tag and tier stay as first written. A new edge is valid from
    its observation, or from `now`. Edges from a node to itself are dropped; closed edges stay.
    """
    key = ["src_id", "dst_id", "edge_type"]
    passed, touched, once, more = met(current.filter("valid_to is null"), batch.filter("src_id <> dst_id"), *key)
    fold = more.groupBy(*key).agg(
        F.max_by("extractor", "seq").alias("extractor"), last("source_ref"), last("observed_at"),
        F.min_by(F.struct("observed_at"), "seq").alias("sighted"), F.min("seq").alias("seq"),
    )
    old, new = touched.alias("old"), fold.alias("new")
    joined = old.join(new, [F.col(f"old.{c}") == F.col(f"new.{c}") for c in key], "full_outer")
    was = F.col("old.edge_id").isNotNull()
    kept = lambda c, x: F.when(was, F.col(f"old.{c}")).otherwise(x).alias(c)
    newest = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    start = F.coalesce("new.sighted.observed_at", now)
    merged = joined.select(
        kept("edge_id", edge_id(*[F.col(f"new.{c}") for c in key], start)), *[kept(c, F.col(f"new.{c}")) for c in key], kept("tag", F.lit("explicit")), kept("tier", F.lit("explicit")),
        newest("extractor"), newest("source_ref"), kept("relevance", F.lit(None).cast("decimal(5,4)")), newest("observed_at"), kept("valid_from", start),
        F.lit(None).cast("timestamp").alias("valid_to"), kept("seq", F.col("new.seq")), (~was).alias("created"),
    )
    start = F.coalesce("observed_at", now)
    first = once.select(
        edge_id(*[F.col(c) for c in key], start).alias("edge_id"), *key, F.lit("explicit").alias("tag"), F.lit("explicit").alias("tier"), "extractor", "source_ref", F.lit(None).cast("decimal(5,4)").alias("relevance"),
        "observed_at", start.alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"), "seq", F.lit(True).alias("created"),
    )
    as_they_were = passed.unionByName(current.filter("valid_to is not null")).withColumn("created", F.lit(False))
    return merged.unionByName(first).unionByName(as_they_were.select(*merged.columns))


def withdraw_edges(edges: DataFrame, superseded: DataFrame, now: Column) -> DataFrame:
    """`edges` with the current ones whose edge_id is in `superseded` closed at `now`, not deleted."""
    gone = superseded.select("edge_id").distinct().withColumn("gone", F.lit(True))
    end = F.when(F.col("gone") & F.col("valid_to").isNull() & (F.col("valid_from") < now), now).otherwise(F.col("valid_to"))
    return edges.join(gone, "edge_id", "left").withColumn("valid_to", end).select(*edges.columns)


def delete_nodes(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """`tables` without the nodes whose node_id is in `gone`, their detail rows and their edges."""
    ids = gone.select("node_id").distinct()
    out = {}
    for name, rows in tables.items():
        ends = [c for c in ("node_id", "src_id", "dst_id") if c in rows.columns]
        out[name] = reduce(lambda df, c: df.join(ids.select(F.col("node_id").alias(c)), c, "left_anti"), ends, rows).select(*rows.columns)
    return out


def run_row(run_id: str, status: str, counts: DataFrame, skips: DataFrame, error: str | None = None) -> DataFrame:
    """One row of the run ledger: status, error, named counts (name, n) and counted skip reasons (reason)."""
    counted = skips.groupBy("reason").count().select(F.lit("skip").alias("kind"), F.col("reason").alias("name"), F.col("count").alias("n"))
    rows = counts.select(F.lit("count").alias("kind"), "name", F.col("n").cast("long").alias("n")).unionByName(counted)
    of = lambda kind: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n")))))
    return rows.agg(of("count").alias("counts"), of("skip").alias("skips")).select(F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), "counts", "skips")
