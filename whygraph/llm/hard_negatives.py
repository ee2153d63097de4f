"""Hard-negative mining by angular triangle filtering over stored angles to reference directions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, durable, ranked, table, with_key

#: A component x counts as the integer floor(SCALE * x); beyond FARTHEST it is held there, so that scores fit a long.
SCALE, FARTHEST = 256, 1 << 26
#: Reference directions; any vectors give right results, they decide only how much is skipped.
REFERENCES = 8
#: Positives of an anchor, negatives of a positive, and the window of their scores in tenths of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 3, 9
#: Anchors that a task holds; rows of a window; row groups that an anchor's search is dealt to, of at least so many rows.
ANCHOR_BLOCK, WINDOW, GROUPS, GROUP_ROWS = 2048, 256, 64, 4096
#: Added to bounds, as a share of the product of the norms: far above the rounding of angles and cosines (some 10^-7).
SLACK = 1e-6

PREPARED = "v array<int>, norm double, angles array<double>"


def participants(rows: DataFrame, id_col: str, vector_col: str, label: F.Column) -> DataFrame:
    """KEY, id, label and integer vector `v` of the `rows` (with KEY) that take part.

    Rows with a null label or vector, or a null or non-finite component, take no part; where lengths differ,
    only the commonest length (of several, the longest) takes part.
    """
    entry = F.col(vector_col)
    finite = F.forall(entry, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < math.inf))
    held = lambda x: F.greatest(F.lit(-float(FARTHEST)), F.least(F.lit(float(FARTHEST)), F.floor(x.cast("double") * SCALE).cast("double"))).cast("int")
    found = rows.filter(entry.isNotNull() & (F.size(entry) > 0) & finite & label.isNotNull())
    found = durable(found.select(KEY, F.col(id_col).alias("id"), label.cast("long").alias("label"), F.transform(entry, held).alias("v")))
    sizes = found.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).first()
    return found.filter(F.size("v") == (sizes.size if sizes else 0))


def angles_to(v: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of vectors to unit `references`; 0 for the zero vector, whose scores are 0 whatever its angle."""
    cosines = (v @ references.T) / np.where(norm > 0, norm, 1.0)[:, None]
    return np.where(norm[:, None] > 0, np.arccos(np.clip(cosines, -1.0, 1.0)), 0.0)


def with_angles(batches: Iterator[pd.DataFrame], references: np.ndarray) -> Iterator[pd.DataFrame]:
    for rows in batches:
        if len(rows):
            v = np.array(rows["v"].tolist(), dtype=float)
            norm = np.sqrt((v * v).sum(axis=1))
            angles = angles_to(v, norm, references)
            yield rows.assign(norm=norm, angles=list(angles), near=angles.argmin(axis=1), nearest=angles.min(axis=1))


def prepared(rows: DataFrame, references: int = REFERENCES) -> DataFrame:
    """Participants with their norm and stored angles: to the vectors of the rows with the smallest hashes of KEY."""
    spots = rows.orderBy(F.xxhash64(KEY), KEY).limit(references).select("v").collect()
    directions = np.array([r.v for r in spots], dtype=float).reshape(len(spots), len(spots[0].v) if spots else 1)
    lengths = np.sqrt((directions * directions).sum(axis=1))
    directions[lengths == 0] = 1.0
    directions /= np.sqrt((directions * directions).sum(axis=1))[:, None]
    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return durable(rows.mapInPandas(lambda batches: with_angles(batches, directions), f"{fields}, norm double, angles array<double>, near int, nearest double"))


class Block:
    """Vectors with what the bounds need, in numpy."""

    def __init__(self, rows: pd.DataFrame):
        self.key, self.label = rows[KEY].to_numpy(np.int64), rows["label"].to_numpy(np.int64)
        self.place = rows["place"].to_numpy(np.int64)
        self.v = np.array(rows["v"].tolist(), dtype=np.int64)
        self.norm = rows["norm"].to_numpy(float)
        self.angles = np.array(rows["angles"].tolist(), dtype=float)

    def part(self, at) -> Block:
        out = object.__new__(Block)
        for name, value in vars(self).items():
            setattr(out, name, value[at])
        return out


def bounds(anchors: Block, window: Block) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor can have with any row of `window`.

    With angles a and b to one reference direction, the angle between two vectors is at least |a - b| and
    at most a + b and 2 pi - a - b. The tightest of all references counts, over the window's span of
    angles; the cosine times the norms, with slack for rounding, bounds the score.
    """
    first, last = window.angles.min(axis=0), window.angles.max(axis=0)
    apart = np.maximum(np.maximum(first - anchors.angles, anchors.angles - last), 0.0).max(axis=1)
    over, under = anchors.angles + last, anchors.angles + first
    widest = np.where(over <= math.pi, over, np.where(under >= math.pi, 2 * math.pi - under, math.pi)).min(axis=1)
    small, large = window.norm.min(), window.norm.max()
    scaled = lambda cosine, if_positive, if_negative: cosine * anchors.norm * np.where(cosine > 0, if_positive, if_negative)
    slack = SLACK * anchors.norm * large + 1
    return scaled(np.cos(widest), small, large) - slack, scaled(np.cos(apart), large, small) + slack


def integer_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors: in floating point while they are below 2^53 and so exact."""
    if int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1] < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Best:
    """The first `keep` rows of each slot, by falling score, then place."""

    def __init__(self, slots: int, keep: int, floor: np.ndarray):
        self.keep, self.floor = keep, floor
        self.slot, self.score, self.place, self.key = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, slot: np.ndarray, score: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
        """Takes rows in, drops what is no longer among the first, and raises the floors of full slots."""
        if not len(slot):
            return
        slot, score, place, key = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.place, place), (self.key, key)))
        order = np.lexsort((key, place, -score, slot))
        slot = slot[order]
        begun = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        rank = np.arange(len(slot)) - np.repeat(begun, np.diff(np.r_[begun, len(slot)]))
        order, last = order[rank < self.keep], order[rank == self.keep - 1]
        self.floor[slot[rank == self.keep - 1]] = score[last]
        self.slot, self.score, self.place, self.key = slot[rank < self.keep], score[order], place[order], key[order]


def searched(anchors: Block, low: np.ndarray, high: np.ndarray, same: bool, keep: int, windows: Iterator[Block]) -> tuple[Best, int]:
    """(best, scored): the best rows of each anchor and request, and how many scores were computed.

    `low` and `high` (anchor x request) hold the scores that are wanted; `same` asks for rows of the
    anchor's label (without itself), else for those of others. A window of rows is scored only for the
    anchors whose bounds overlap what they still want: once a request has `keep` rows, its last score is
    its floor.
    """
    requests = low.shape[1]
    best, scored = Best(low.size, keep, low.reshape(-1).copy()), 0
    for window in windows:
        least, greatest = bounds(anchors, window)
        floor = best.floor.reshape(low.shape)
        at = np.flatnonzero(((greatest[:, None] >= floor) & (least[:, None] <= high)).any(axis=1))
        if not len(at):
            continue
        score = integer_scores(anchors.v[at], window.v)
        scored += score.size
        fits = anchors.label[at][:, None] == window.label[None, :]
        fits = fits & (anchors.key[at][:, None] != window.key[None, :]) if same else ~fits
        hits = [np.nonzero(fits & (score >= floor[at, r][:, None]) & (score <= high[at, r][:, None])) for r in range(requests)]
        slot = np.concatenate([at[i] * requests + r for r, (i, _) in enumerate(hits)])
        best.add(slot, np.concatenate([score[h] for h in hits]), *(np.concatenate([getattr(window, name)[j] for _, j in hits]) for name in ("place", "key")))
    return best, scored


Task = Callable[[pd.DataFrame, Iterator[Block]], pd.DataFrame]


def cells(batches: Iterator[pd.DataFrame], task: Task) -> Iterator[pd.DataFrame]:
    """`task` over each cell of a partition that is sorted by cell, anchors (`role` 0) before rows.

    Rows come window by window, so that a task holds its anchors and one batch, whatever the size of a cell.
    """
    held: list[pd.DataFrame] = []
    batches = (part for rows in batches if len(rows) for _, part in rows.groupby(["block", "grp", "role"], sort=True))
    part = next(batches, None)
    while part is not None:
        cell = (part["block"].iloc[0], part["grp"].iloc[0])
        held = []

        def same(role: int, cell=cell) -> bool:
            return part is not None and (part["block"].iloc[0], part["grp"].iloc[0], part["role"].iloc[0]) == (*cell, role)

        while same(0):
            held.append(part)
            part = next(batches, None)

        def windows() -> Iterator[Block]:
            nonlocal part
            while same(1):
                block = Block(part)
                for start in range(0, len(part), WINDOW):
                    yield block.part(slice(start, start + WINDOW))
                part = next(batches, None)

        rows = windows()
        if held:
            yield task(pd.concat(held, ignore_index=True), rows)
        for _ in rows:
            pass


def wide(column: pd.Series, width: int, empty: int) -> np.ndarray:
    """Lists of at most `width` scores as a matrix, filled up with `empty`."""
    return np.array([list(x) + [empty] * (width - len(x)) for x in column], dtype=np.int64).reshape(len(column), width)


def positive_task(anchors: pd.DataFrame, windows: Iterator[Block]) -> pd.DataFrame:
    block = Block(anchors)
    low = np.full((len(anchors), 1), np.iinfo(np.int64).min)
    best, _ = searched(block, low, np.full_like(low, np.iinfo(np.int64).max), True, POSITIVES, windows)
    return pd.DataFrame({"anchor": block.key[best.slot], "score": best.score, "place": best.place, "other": best.key})


def negative_task(anchors: pd.DataFrame, windows: Iterator[Block]) -> pd.DataFrame:
    """As floors and ceilings: 30 p <= 100 s is s >= ceil(3 p / 10), 100 s <= 90 p is s <= floor(9 p / 10)."""
    block, width = Block(anchors), max(map(len, anchors["wanted"]))
    low, high = wide(anchors["wanted"].map(lambda w: [-(-LEAST * int(p) // 10) for p in w]), width, 1), wide(anchors["wanted"].map(lambda w: [MOST * int(p) // 10 for p in w]), width, 0)
    low, high = np.where(low > high, np.iinfo(np.int64).max, low), np.where(low > high, np.iinfo(np.int64).min, high)
    best, _ = searched(block, low, high, False, NEGATIVES, windows)
    return pd.DataFrame({"anchor": block.key[best.slot // width], "request": best.slot % width, "score": best.score, "place": best.place, "other": best.key})


def search(anchors: DataFrame, rows: DataFrame, task: Task, schema: str) -> DataFrame:
    """`task` over every anchor block and row group.

    The anchors, a stated query set, are cut in blocks of a bounded size, similar ones together; rows are
    dealt to groups by a hash and sorted by label, nearest reference and angle, so that windows are
    narrow and no label or copied vector makes a group larger than others.
    """
    blocks = anchors.agg(F.max("block")).first()[0]
    groups = max(1, min(GROUPS, math.ceil(rows.count() / GROUP_ROWS)))
    have = ["block", "grp", "role", KEY, "place", "label", "v", "norm", "angles", "near", "nearest", "wanted"]
    wanted = F.col("wanted") if "wanted" in anchors.columns else F.array().cast("array<long>")
    asked = anchors.withColumn("wanted", wanted).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("role", F.lit(0)).select(*have)
    dealt = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks or 0)))).withColumn("grp", F.pmod(F.xxhash64(KEY), F.lit(groups)).cast("int"))
    dealt = dealt.withColumn("role", F.lit(1)).withColumn("wanted", F.array().cast("array<long>")).select(*have)
    cell = asked.withColumn("block", F.col("block").cast("int")).unionByName(dealt.withColumn("block", F.col("block").cast("int")))
    sorted_ = cell.repartition(groups * ((blocks or 0) + 1), "block", "grp").sortWithinPartitions("block", "grp", "role", "label", "near", "nearest", "place")
    return sorted_.mapInPandas(lambda batches: cells(batches, task), schema)


def first(rows: DataFrame, by: list[str], keep: int) -> DataFrame:
    """The first `keep` rows of each `by`, with their `rank` from 1; a task gave `keep` of each at most."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "place", "other")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def hard_negatives(rows: DataFrame, is_anchor: F.Column, label: F.Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and positive.

    `is_anchor` and `label` are columns of `rows`. Rows that take no part (see `participants`) are neither
    anchors, positives nor negatives; null ids are not anchors unless `is_anchor` says so and come first among
    ties. Rows with the same id are rows of their own, tied by the order of their content. An anchor
    without other rows of its label, or a positive without rows in its window, gives no row; so does an
    empty table. Other columns are not read.
    """
    keyed = with_key(rows, id_col).withColumn(f"{KEY}_anchor", F.coalesce(is_anchor, F.lit(False)))
    marks = keyed.filter(f"{KEY}_anchor").select(KEY)
    ready = prepared(participants(keyed, id_col, vector_col, label).withColumn("place", F.col(KEY)))
    order = [F.col(c) for c in ("label", "near", "nearest", KEY)]
    anchors = ranked(ready.join(marks, KEY, "left_semi"), order, "block").withColumn("block", F.floor(F.col("block") / ANCHOR_BLOCK))
    anchors = durable(anchors)
    found = search(anchors, ready, positive_task, "anchor long, score long, place long, other long")
    positives = durable(first(found, ["anchor"], POSITIVES).select("anchor", (F.col("rank") - 1).alias("request"), F.col("other").alias("positive"), F.col("score").alias("positive_score")))
    wanted = F.transform(F.array_sort(F.collect_list(F.struct("request", "positive_score"))), lambda p: p["positive_score"])
    asked = anchors.join(positives.groupBy(F.col("anchor").alias(KEY)).agg(wanted.alias("wanted")), KEY)
    found = search(asked, ready, negative_task, "anchor long, request int, score long, place long, other long")
    best = first(found, ["anchor", "request"], NEGATIVES).withColumnRenamed("score", "negative_score").join(positives, ["anchor", "request"])
    ids = ready.select(KEY, "id")
    named = best
    for key, name in (("anchor", "anchor_id"), ("positive", "positive_id"), ("other", "negative_id")):
        named = named.join(ids.select(F.col(KEY).alias(key), F.col("id").alias(name)), key)
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives of the vectors whose id is divisible by 100; labels of ids divisible by 7 are turned first."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


OP13_SQL = """
WITH turned AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vec AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM turned
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM vec a JOIN vec b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""
