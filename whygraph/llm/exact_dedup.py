"""Exact deduplication by deterministic block naming, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, table, with_key, without

#: Bytes of a block. Most documents are one block; a longer one takes log2(blocks) rounds of naming.
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    """Text with each run of ASCII white space replaced by one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def named(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Each distinct row of `columns` with an integer `name` that no other row has.

    Rows are dealt out by value and sorted; the name is the rank in the partition after the partition's
    number, so that a task that is run again gives the same names.
    """
    distinct = parts.select(*columns).distinct().sortWithinPartitions(*columns)
    return distinct.withColumn("name", F.monotonically_increasing_id())


def block_names(blocks: DataFrame) -> DataFrame:
    """(KEY, n, i, digest, name) of `blocks` (KEY, n, i, digest, h, block).

    Block contents are shuffled once, without repeats, to be sorted and named. Occurrences find their
    name by the 64-bit hash `h`. Where different blocks share a hash, their occurrences are named again
    by content, so that equal names always mean equal blocks.
    """
    names = durable(named(blocks, ["h", "block"]).select("h", "name"))
    shared = durable(names.groupBy("h").count().filter("count > 1").select("h"))
    own = blocks.drop("block").join(names, "h").drop("h")
    if shared.isEmpty():
        return durable(own)
    clear = blocks.drop("block").join(names.join(shared, "h", "left_anti"), "h").drop("h")
    again = blocks.join(shared, "h", "left_semi")
    exact = durable(named(again, ["h", "block"]).withColumn("name", -1 - F.col("name")))
    return durable(clear.unionByName(again.join(exact, ["h", "block"]).drop("h", "block")))


def identities(docs: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_block=F.xxhash64) -> DataFrame:
    """(KEY, n, name, digest) of `docs` with KEY: two rows have equal (n, name) if and only if their
    normalised texts are equal. `digest` is the SHA-256 of that text.

    Round 0 names blocks of `block_bytes` bytes. Each later round names pairs of adjacent names, the
    last without a partner paired with null, until one name is left of every document.
    """
    whole = docs.select(KEY, normalised(F.col(text_col)).cast("binary").alias("bytes"))
    sized = whole.select(KEY, "bytes", F.sha2("bytes", 256).alias("digest"), F.greatest(F.lit(1), F.ceil(F.length("bytes") / block_bytes)).cast("int").alias("n"))
    cut = F.expr(f"transform(sequence(0, n - 1), i -> substring(bytes, i * {block_bytes} + 1, {block_bytes}))")
    blocks = sized.select(KEY, "n", "digest", F.posexplode(cut).alias("i", "block"))
    blocks = blocks.select(KEY, "n", "i", F.when(F.col("i") == 0, F.col("digest")).alias("digest"), hash_block("block").alias("h"), "block")
    level = block_names(blocks)
    heads = level.filter("i = 0").select(KEY, "n", "digest")
    done = level.filter("n = 1").select(KEY, "name")
    level = level.filter("n > 1").select(KEY, F.col("n").alias("left"), "i", "name")
    while not level.isEmpty():
        half = F.shiftright("i", 1)
        side = lambda bit: F.max(F.when(F.col("i") % 2 == bit, F.col("name")))
        pairs = durable(level.groupBy(KEY, "left", half.alias("i")).agg(side(0).alias("a"), side(1).alias("b")))
        names = durable(named(pairs, ["a", "b"]))
        joined = pairs.join(names, (pairs.a == names.a) & pairs.b.eqNullSafe(names.b)).select(KEY, F.ceil(pairs.left / 2).cast("int").alias("left"), "i", "name")
        level = durable(joined)
        done = done.unionByName(level.filter("left = 1").select(KEY, "name"))
        level = level.filter("left > 1")
    return heads.join(done, KEY)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, hash_block=F.xxhash64) -> DataFrame:
    """One row per row of `docs` (with KEY): KEY, id, keep_id, group_size, kept, digest.

    Of equal texts the row with the smallest id stays; null ids come last, and of rows with equal ids
    the first stays. An empty table gives an empty result; other columns are not read.
    """
    ids = docs.select(KEY, F.col(id_col).alias("id"))
    rows = durable(identities(docs, text_col, block_bytes, hash_block).join(ids, KEY))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(KEY).alias("key"))).alias("first")
    groups = rows.groupBy("n", "name").agg(first, F.count("*").alias("group_size"))
    return rows.join(groups, ["n", "name"]).select(KEY, "id", F.col("first.id").alias("keep_id"), "group_size", (F.col(KEY) == F.col("first.key")).alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without later copies of a text, with all their columns."""
    keyed = with_key(docs, id_col)
    return without(keyed, exact_groups(keyed, id_col, text_col).filter("not kept")).select(*docs.columns)


def op7_exact_dedup(spark, sf_dir):
    """The group of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact_groups(with_key(docs, "doc_id"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP7_SQL = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW g AS (PARTITION BY t)
"""
