"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, free_name, ranked, table, with_key

#: Weights of the sources in the order of their names, repeated as often as needed.
WEIGHTS = (5, 2, 1)
#: A source gives at most this many times its size, and no document more than that many copies.
MOST = 3
#: Documents of one source that one task rounds at a time; also the fan-in of the reduction tree.
LEAF = 4096

OPEN = f"{KEY} long, source string, size long, copies long, p double"


def sized(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """KEY, source and size (runs of characters other than ASCII white space; null has none)."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(KEY, F.col(source_col).alias("source"), words.cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): shares of all sizes by weight, none above `most` times its size.

    Sources rank by code point, null last. What a source can't give is shared among the others by
    weight, until none is above its limit: one scalar aggregate a round, over the table of sources.
    """
    per = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").isNull(), F.col("source")], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = durable(per.select("source", "source_size", weight.alias("weight")))
    limit = F.col("source_size") * most
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1
    while True:
        capped = F.col("weight") * level > limit
        n, held, free = per.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))).first()
        if n == before or not free:
            break
        before, level = n, (total - held) / free
    return per.select("source", "source_size", F.least(F.col("weight") * level, limit.cast("double")).alias("target"))


def chance(seed: int, *parts) -> float:
    """A number in [0, 1) that depends on the arguments only."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=7).digest(), "big") / 2**56


def pivot(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Rounds the open probabilities p of some documents of one source until at most one is left open.

    Two documents exchange expected words (size times p) until the p of one is 0 or 1; which of the two
    ways is drawn so that each keeps its expectation. The sum of expected words never changes.
    """
    rows = rows.sort_values(KEY, ignore_index=True)
    size, p, key = rows["size"].tolist(), rows["p"].tolist(), rows[KEY].tolist()
    held = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held], size[i]
        up, down = min(a * (1 - p[held]), b * p[i]), min(a * p[held], b * (1 - p[i]))
        to_held = chance(seed, key[held], key[i]) * (up + down) < down
        if to_held:
            whole_held = a * (1 - p[held]) <= b * p[i]
            x, y = p[held] + up / a, p[i] - up / b
        else:
            whole_held = a * p[held] <= b * (1 - p[i])
            x, y = p[held] - down / a, p[i] + down / b
        if whole_held:
            p[held], p[i] = float(to_held), min(max(y, 0.0), 1.0)
            held = i if 0.0 < p[i] < 1.0 else -1
        else:
            p[held], p[i] = min(max(x, 0.0), 1.0), float(not to_held)
            held = held if 0.0 < p[held] < 1.0 else -1
    rows["p"] = p
    return rows


def mix(sizes: DataFrame, targets: DataFrame, most: int = MOST, seed: int = 7, leaf: int = LEAF) -> DataFrame:
    """(KEY, source, size, source_size, target, copies) with whole copies of each document.

    Each document of a source starts with target / source_size copies. The whole part is kept; the
    rest is rounded in groups of about `leaf` documents chosen by a hash of the key, so a source with a
    third of all rows is spread over many tasks. What one group leaves open goes on to the next level.
    The last open document of a source is rounded by one draw, so a source's words differ from its
    target by less than its longest document. Documents of size 0 and sources of target 0 get none.
    """
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    started = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).select(KEY, sizes.source, "size", "source_size", "target", ratio.alias("ratio"))
    copies = F.when(F.col("size") > 0, F.floor("ratio")).otherwise(0).cast("long")
    part = F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0)
    started = started.select(KEY, "source", "size", copies.alias("copies"), part.alias("p"))
    groups = max(1, math.ceil(sizes.count() / leaf))
    level, done, depth = started, None, 0
    while True:
        slot = F.pmod(F.xxhash64(F.lit(seed + depth), KEY), F.lit(groups))
        one = lambda rows, s=seed + depth: pivot(rows, s)
        level = durable(level.groupBy("source", slot.alias("slot")).applyInPandas(lambda rows: one(rows.drop(columns="slot", errors="ignore")), OPEN))
        closed = level.filter("not (p > 0 and p < 1)").select(KEY, (F.col("copies") + F.col("p").cast("long")).alias("copies"))
        done = closed if done is None else done.unionByName(closed)
        level = level.filter("p > 0 and p < 1")
        if groups == 1:
            break
        groups, depth = math.ceil(groups / leaf), depth + 1
    draw = F.pmod(F.xxhash64(F.lit(seed), KEY), F.lit(1 << 30)) / float(1 << 30) < F.col("p")
    done = done.unionByName(level.select(KEY, (F.col("copies") + draw.cast("long")).alias("copies")))
    rows = sizes.join(targets, sizes.source.eqNullSafe(targets.source)).select(KEY, sizes.source, "size", "source_size", "target")
    return rows.join(done, KEY)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that the mix takes, with `copies` and `taken` (copies times words).

    Where `docs` has columns of these names, they stay, and the mix's are called `mix_copies` and `mix_taken`.
    """
    keyed = with_key(docs, id_col)
    sizes = durable(sized(keyed, text_col, source_col))
    share = mix(sizes, source_targets(sizes)).filter("copies > 0").select(KEY, F.col("copies").alias(f"{KEY}_copies"), F.col("size").alias(f"{KEY}_size"))
    rows = keyed.join(share, KEY)
    copies, taken = (free_name(n, docs.columns) for n in ("copies", "taken"))
    return rows.select(*[rows[c] for c in docs.columns], F.col(f"{KEY}_copies").alias(copies), (F.col(f"{KEY}_copies") * F.col(f"{KEY}_size")).alias(taken))


def op5_mixing(spark, sf_dir):
    """The mix's share of every document."""
    docs = with_key(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    ids = docs.select(KEY, "doc_id")
    sizes = durable(sized(docs))
    result = mix(sizes, source_targets(sizes)).join(ids, KEY)
    return result.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
