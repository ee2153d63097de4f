"""Threads: clusters of artifacts joined by closing references and commit lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..durable import durable
from ..functions.text import thread_rank
from .components import components


def union_edges(edges: DataFrame) -> DataFrame:
    """The edges that join threads: `closes`, and a pull request's own commits. Mentions never do."""
    return edges.filter("edge_type = 'closes' or (edge_type = 'implements' and extractor = 'pr_commit_list')").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"))


def contracted(edges: DataFrame, shared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) still to be joined, leaves (leaf, at)): the union of thread-joining `edges` and `shared` pairs.

    Of a pull request's own commits, most have no other edge; such a leaf is in the component of its pull request
    and is not looked at again. A commit of several pull requests joins these to the smallest of them.
    """
    pairs = union_edges(edges.filter("edge_type = 'closes'"))
    pairs = pairs if shared is None else pairs.unionByName(shared)
    lists = union_edges(edges.filter("edge_type = 'implements'")).filter("a <> b")
    stars = lists.groupBy("b").agg(F.min("a").alias("at"), F.max("a").alias("last"))
    several = lists.join(stars.filter("at <> last").select("b", "at"), "b").select("a", F.col("at").alias("b"))
    pairs = durable(pairs.unionByName(several))
    busy = pairs.select(F.explode(F.array("a", "b")).alias("leaf")).unionByName(lists.select(F.col("a").alias("leaf"))).distinct().withColumn("busy", F.lit(True))
    listed = durable(stars.select(F.col("b").alias("leaf"), "at").join(busy, "leaf", "left"))
    return pairs.unionByName(listed.filter("busy").select(F.col("leaf").alias("a"), F.col("at").alias("b"))), listed.filter("busy is null").select("leaf", "at")


def cluster(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` with the thread_key of their cluster: the lowest-ranking key that a member has.

    A node without a key takes its cluster's; a cluster in which no node has a key stays without one.
    Nodes that share a key from an earlier run stay together. Only ids and keys go through the joins before the last one.
    Leaves without a key of their own take no part in the components or in the choice of a key: they look up that of their pull request.
    """
    keyed = nodes.filter("thread_key is not null").select("node_id", "thread_key")
    many = keyed.groupBy("thread_key").agg(F.min("node_id").alias("first"), F.max("node_id").alias("last")).filter("first <> last").select("thread_key", "first")
    shared = keyed.join(many, "thread_key").filter("node_id <> first").select(F.col("node_id").alias("a"), F.col("first").alias("b"))
    pairs, leaves = contracted(edges, shared)
    # Written, so that it is known to be small and is broadcast: lists name commits, and these have no key in a first run.
    known = durable(nodes.filter("thread_key is not null and node_type not in ('issue', 'pull_request')").select(F.col("node_id").alias("leaf")))
    found = durable(components(pairs.unionByName(leaves.join(known, "leaf", "left_semi").select(F.col("leaf").alias("a"), F.col("at").alias("b")))))
    leaves = leaves.join(known, "leaf", "left_anti")
    keys = keyed.join(found, F.col("node_id") == F.col("node")).groupBy("root").agg(F.min(thread_rank(F.col("thread_key"))).alias("best"))
    changed = durable(found.join(keys.select("root", F.col("best.key").alias("key")), "root").select(F.col("node").alias("node_id"), "key"))
    after = keyed.join(changed, "node_id", "full_outer").select(F.col("node_id").alias("at"), F.coalesce("key", "thread_key").alias("key"))
    changed = changed.unionByName(leaves.join(after, "at").select(F.col("leaf").alias("node_id"), "key"))
    joined = nodes.join(changed, "node_id", "left").withColumn("thread_key", F.coalesce("key", "thread_key"))
    return joined.select(*nodes.columns)


def token() -> Column:
    """A thread's key, or a node without one."""
    return F.coalesce("thread_key", F.concat(F.lit("node:"), F.col("node_id").cast("string")))


def renames(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((token, key), (node_id, key)): the new keys of threads, and those of keyless nodes, that new `edges` touch.

    A token is a thread's key, or a keyless node. Only the ends of `edges` are looked up; their tokens are
    joined by the edges between them, and each component takes the lowest-ranking key in it. Leaves, keyless
    commits that only pull requests list, stay out of this: they take the key of their pull request.
    """
    joining = edges.filter(F.col("edge_type").isin("closes", "implements")).select("src_id", "dst_id", "edge_type", "extractor")
    ends = union_edges(joining).select(F.explode(F.array("a", "b")).alias("node_id")).distinct()
    touched = durable(nodes.select("node_id", "thread_key").join(ends, "node_id", "left_semi"))
    ids = lambda c: touched.select(F.col("node_id").alias(c))
    pairs, leaves = contracted(durable(joining.join(ids("src_id"), "src_id", "left_semi").join(ids("dst_id"), "dst_id", "left_semi")))
    keyed = touched.filter("thread_key is not null").select(F.col("node_id").alias("leaf"))
    leaves = durable(leaves.join(keyed.withColumn("has", F.lit(True)), "leaf", "left"))
    pairs = pairs.unionByName(leaves.filter("has").select(F.col("leaf").alias("a"), F.col("at").alias("b")))
    one, two = touched.select(F.col("node_id").alias("a"), token().alias("one")), touched.select(F.col("node_id").alias("b"), token().alias("two"))
    found = durable(components(pairs.join(one, "a").join(two, "b").select(F.col("one").alias("a"), F.col("two").alias("b"))))
    tokens = touched.select(token().alias("token"), "thread_key").distinct()
    rooted = tokens.join(found, F.col("token") == F.col("node")).select("token", "thread_key", "root")
    best = rooted.groupBy("root").agg(F.min(thread_rank(F.col("thread_key"))).alias("best"))
    changed = durable(rooted.join(best, "root").select("token", "thread_key", F.col("best.key").alias("key")).filter("key is not null and key <> token"))
    lists = leaves.filter("has is null").select(F.col("leaf").alias("node_id"), "at").join(touched.select(F.col("node_id").alias("at"), "thread_key", token().alias("token")), "at")
    listed = lists.join(changed.drop("thread_key"), "token", "left").select("node_id", F.coalesce("key", "thread_key").alias("key")).filter("key is not null")
    loose = touched.filter("thread_key is null").withColumn("token", token()).join(changed.drop("thread_key"), "token").select("node_id", "key")
    return changed.filter("thread_key is not null").select("token", "key"), listed.unionByName(loose)


def merge_threads(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` after new `edges`: losing keys are renamed, and nodes without a key take that of their neighbours."""
    renamed, named = renames(nodes, edges)
    threaded = nodes.filter("thread_key is not null").join(renamed, F.col("thread_key") == F.col("token"), "left")
    plain = nodes.filter("thread_key is null").join(named, "node_id", "left")
    after = lambda df: df.withColumn("thread_key", F.coalesce("key", "thread_key")).select(*nodes.columns)
    return after(threaded).unionByName(after(plain))
