"""N-gram Jaccard self-join by MinHash banding, verified on the whole n-gram sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import KEY, durable, small, table, with_key, without
from .words import ALNUM, U, grams, mixed, powers, slices, word_hashes

#: Words of a gram and least similarity of a link.
GRAM, SIMILARITY = 5, 0.8
#: Wanted chance that a pair of exactly that similarity shares a band, and most hashes to spend on it.
RECALL, HASHES = 0.9999, 192
#: Texts, and grams of texts, of a candidate component that one task compares with as many others.
BLOCK, BLOCK_GRAMS = 256, 2_000_000

SIGNED = f"{KEY} long, content binary, grams int, bands array<bigint>"


def banding(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows, and so fewest false candidates, that reach `recall` with `hashes`."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = np.random.default_rng(20240229).integers(0, 1 << 32, (2, n), np.uint64).astype(np.uint32)
    return drawn[0], drawn[1] | np.uint32(1)


def minhashes(hashes: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n x texts least hashes of the grams of each text; texts must not be empty."""
    h = (hashes >> U(32)).astype(np.uint32)
    out = np.empty((n, len(bounds) - 1), np.uint32)
    for k, (x, m) in enumerate(zip(*seeds(n), strict=True)):
        out[k] = np.minimum.reduceat((h ^ x) * m, bounds[:-1])
    return out


def sign_batches(n: int, bands: int, rows: int):
    """A mapInArrow function over (KEY, text as bytes) that gives SIGNED rows of texts with words."""

    def sign(batches):
        for batch in batches:
            keys = batch.column(0)
            for lo, hi, texts in slices(batch.column(1)):
                words, bounds = word_hashes(texts, ALNUM)
                full = np.flatnonzero(np.diff(bounds))
                if not len(full):
                    continue
                content = [hashlib.blake2b(words[bounds[i] : bounds[i + 1]].tobytes(), digest_size=16).digest() for i in full]
                g, at = grams(words, bounds, n)
                mins = minhashes(g, np.append(at[full], at[-1]), bands * rows).astype(U)
                weight = powers(0xA0761D6478BD642F, rows + 1)[1:, None]
                band = [mixed((mins[b * rows : (b + 1) * rows] * weight).sum(axis=0) + U(b)) for b in range(bands)]
                flat = np.stack(band, axis=1).astype(np.int64).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1) * bands, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([keys.slice(lo, hi - lo).take(pa.array(full)), pa.array(content, pa.binary()), pa.array(np.diff(at)[full].astype(np.int32)), lists], [KEY, "content", "grams", "bands"])

    return sign


def verify(n: int, similarity: float):
    """An applyInPandas function over the texts of a pair of blocks of one component.

    Gives (node, other, weight): a spanning edge of linked texts where other is not null, and the number
    of documents that a text is linked with in this pair of blocks where it is.
    """

    def linked(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "node"], ignore_index=True)
        words, bounds = word_hashes([bytes(t) for t in rows["text"]], ALNUM)
        g, at = grams(words, bounds, n)
        node, weight, block = rows["node"].to_numpy(), rows["weight"].to_numpy(), rows["block"].to_numpy()
        one = bool(rows["i"].iloc[0] == rows["j"].iloc[0])
        owner = np.repeat(np.arange(len(rows)), np.diff(at))
        order = np.lexsort((owner, g))
        g, owner = g[order], owner[order]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[first], owner[first]
        size = np.bincount(owner, minlength=len(rows))
        runs = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
        # Grams of one text only add nothing; the others are columns of a 0/1 matrix, taken in strips.
        lengths = np.diff(runs)
        shared = np.repeat(lengths > 1, lengths)
        owner, column = owner[shared], np.repeat(np.cumsum(lengths > 1) - 1, lengths)[shared]
        both = np.zeros((len(rows), len(rows)), np.float32)
        width = 4096
        for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            lo, hi = np.searchsorted(column, (begin, begin + width))
            strip = np.zeros((len(rows), min(width, int(column[-1]) + 1 - begin)), np.float32)
            strip[owner[lo:hi], column[lo:hi] - begin] = 1
            both += strip @ strip.T
        union = size[:, None] + size[None, :] - both
        link = both >= similarity * union - 1e-6
        np.fill_diagonal(link, False)
        if not one:
            link &= block[:, None] != block[None, :]
        counts = link @ weight
        edges, root = [], np.arange(len(rows))
        for a in range(len(rows)):
            for b in np.flatnonzero(link[a, :a]):
                x, y = a, int(b)
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((node[a], node[b]))
        some = np.flatnonzero(counts)
        return pd.DataFrame({
            "node": np.concatenate((node[some], np.array([e[0] for e in edges], np.int64))).astype(np.int64),
            "other": pd.array([None] * len(some) + [e[1] for e in edges], "Int64"),
            "weight": np.concatenate((counts[some], np.zeros(len(edges)))).astype(np.int64),
        })

    return linked


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM, similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES, block: int = BLOCK, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """One row per row of `docs` (with KEY): KEY, id, class_id, n_links, kept.

    Words are runs of letters, digits and characters above 0x7F, with A-Z lowered; grams are sets of n
    adjacent words, a text of fewer words being one gram. Texts link where the Jaccard similarity of
    their sets is at least `similarity`; n_links counts the linked documents, copies included. A class is
    a connected component of links, named by its smallest id; the row with that id is kept (null ids
    last, equal ids by row order). Null texts and texts without words have no links and a class each.

    1. Sign every text; documents with the same words are one node, weighted by their number.
    2. A band's value shared by two nodes links each of its nodes with its smallest: one edge a node and
       band, never all pairs. Components of these edges hold every candidate pair.
    3. Each component with more than one node gets the texts of its nodes; texts that are in none are
       not shuffled where the candidates are few enough to be broadcast. Up to about `block` texts or
       `block_grams` grams are compared in one task; a larger component is dealt into blocks by hash, and
       each pair of blocks is one task, so no component has to fit a task.
    4. Links found are counted a node, and their components are the classes.
    """
    bands, rows = banding(similarity, recall, hashes)
    texts = docs.select(KEY, F.col(text_col).cast("binary").alias("text"))
    signed = durable(texts.mapInArrow(sign_batches(n, bands, rows), SIGNED))
    nodes = durable(signed.groupBy("content").agg(F.min(KEY).alias("node"), F.count("*").alias("weight"), F.first("grams").alias("grams")))
    # Only the first document of each node is banded.
    first = signed.join(nodes.select(F.col("node").alias(KEY)), KEY, "left_semi")
    banded = first.select(F.col(KEY).alias("node"), F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("band", "least")
    stars = durable(banded.join(least, "band").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    candidates = durable(components(stars))
    weighed = durable(candidates.join(nodes.select("node", "weight", "grams"), "node"))
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("grams") / block_grams)).cast("int").alias("blocks")
    dealt = weighed.join(weighed.groupBy("root").agg(parts), "root")
    dealt = dealt.select("node", "weight", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    chosen = texts.join(small(weighed.select(F.col("node").alias(KEY))), KEY, "left_semi")
    wanted = chosen.withColumnRenamed(KEY, "node").join(dealt, "node")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = wanted.select("root", "node", "weight", "text", "block", partner.alias("with"))
    paired = paired.select("root", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "weight", "text", "block")
    found = durable(paired.groupBy("root", "i", "j").applyInPandas(verify(n, similarity), "node long, other long, weight long"))
    links = found.filter("other is null").groupBy("node").agg(F.sum("weight").alias("others"))
    classes = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = nodes.join(links, "node", "left").join(classes, "node", "left")
    named = named.select("content", F.coalesce("root", "node").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    ids = docs.select(KEY, F.col(id_col).alias("id"))
    members = durable(ids.join(signed.select(KEY, "content").join(named, "content").select(KEY, "root", "n_links"), KEY, "left"))
    members = members.select(KEY, "id", F.coalesce("root", KEY).alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first_row = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(KEY).alias("key"))).alias("first")
    heads = members.groupBy("root").agg(first_row)
    return members.join(heads, "root").select(KEY, "id", F.col("first.id").alias("class_id"), "n_links", (F.col(KEY) == F.col("first.key")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without all but the first of each class, with all their columns."""
    keyed = with_key(docs, id_col)
    return without(keyed, near_classes(keyed, id_col, text_col).filter("not kept")).select(*docs.columns)


def op6_ngram_join(spark, sf_dir):
    """The class and number of links of every document."""
    docs = with_key(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return near_classes(docs).select(F.col("id").alias("doc_id"), "class_id", "n_links")


OP6_SQL = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), node AS (
  SELECT w, min(doc_id) AS node, count(*) AS weight FROM word WHERE len(w) > 0 GROUP BY w
), gram AS (
  SELECT DISTINCT node, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT node, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM node)
), size AS (SELECT node, count(*) AS n FROM gram GROUP BY node
), pair AS (
  SELECT a.node AS a, b.node AS b, count(*) AS shared FROM gram a JOIN gram b ON a.g = b.g AND a.node <> b.node GROUP BY a.node, b.node
), link AS (
  SELECT a, b FROM pair JOIN size x ON x.node = a JOIN size y ON y.node = b WHERE 5 * shared >= 4 * (x.n + y.n - shared)
), reach AS (
  SELECT node AS a, node AS b FROM node UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), root AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a
), links AS (
  SELECT n.node, n.weight - 1 + coalesce(sum(o.weight), 0) AS n_links
  FROM node n LEFT JOIN link ON link.a = n.node LEFT JOIN node o ON o.node = link.b GROUP BY n.node, n.weight
)
SELECT word.doc_id, coalesce(class_id, word.doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM word LEFT JOIN node ON node.w = word.w LEFT JOIN root USING (node) LEFT JOIN links USING (node)
"""
