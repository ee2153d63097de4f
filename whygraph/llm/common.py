"""What the corpus operators share: reading tables, row keys, selections of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..durable import checkpointed, durable_folder
from ..durable import checkpointed as durable

__all__ = ["KEY", "checkpointed", "durable", "durable_folder", "free_name", "ranked", "small", "spread", "table", "with_key", "without"]

#: Name of the key that `with_key` adds; the prefix keeps clear of users' own columns.
KEY = "__wg_key"
#: Keys that are broadcast; built as a hash table, a million takes some 60 MB.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken: list[str]) -> str:
    """`name`, with `mix_` before it as often as it takes to differ from all of `taken`, whatever their case."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = f"mix_{name}"
    return name


def with_key(rows: DataFrame, id_col: str) -> DataFrame:
    """`rows` with a column KEY that differs in every row.

    That is the id where ids are integers, not null and unique. Otherwise, as with text ids, rows are
    numbered from 0 in the order of their id (null first) and content, so that the numbers do not hang on
    how rows are dealt to files and tasks; which of two wholly equal rows comes first does not matter. The
    numbered rows are written once, so that every later reader sees the same numbers.
    """
    if isinstance(rows.schema[id_col].dataType, IntegralType):
        odd = rows.groupBy(F.col(id_col).alias("id")).count().filter("id is null or count > 1").limit(1)
        if odd.isEmpty():
            return rows.withColumn(KEY, F.col(id_col).cast("long"))
    return numbered(rows, id_col)


def numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """`rows` with KEY, their place in the order of id and content.

    Content is compared by its hash, then by itself; columns that have no order (maps) are left out. The
    last column of the order only deals equal rows to several tasks.
    """
    plain = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind and kind != "void"]
    hashed, place = f"{KEY}_hash", f"{KEY}_place"
    marked = rows.withColumn(hashed, F.xxhash64(*plain)).withColumn(place, F.monotonically_increasing_id())
    return ranked(marked, [F.col(c) for c in (id_col, hashed, *plain, place)], KEY).select(*rows.columns, KEY)


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """`rows` with their place in an `order` as column `name`, from 0.

    Rows are dealt to tasks by the order and sorted there; a task's rows come after the number of rows of
    the tasks before it, so no task has all rows. The driver gets one count a task.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ordered.withColumn(name, F.monotonically_increasing_id()))
    task = F.shiftright(name, 33)
    before, offsets = 0, []
    for t, n in sorted(placed.groupBy(task.alias("task")).count().collect()):
        offsets.append((t, before - (t << 33)))
        before += n
    shift = placed.sparkSession.createDataFrame(offsets, f"{KEY}_task long, {KEY}_shift long")
    joined = placed.join(F.broadcast(shift), task == F.col(f"{KEY}_task"))
    return joined.select(*rows.columns, (F.col(name) + F.col(f"{KEY}_shift")).alias(name))


def spread(rows: DataFrame) -> DataFrame:
    """`rows` (with KEY) in at least as many tasks as there are cores.

    For work that takes far longer than a shuffle of its input: a table in fewer pieces than cores is dealt
    out by key, a larger one stays as it is read.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores, KEY) if rows.rdd.getNumPartitions() < cores else rows


def small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Written `keys` (KEY), to be broadcast where they are at most `most` rows, else joined by a shuffle."""
    return F.broadcast(keys) if keys.count() <= most else keys


def without(rows: DataFrame, dropped: DataFrame) -> DataFrame:
    """The `rows` (with KEY) whose KEY is not in `dropped`, without KEY; few dropped rows leave the others unshuffled."""
    return rows.join(small(durable(dropped.select(KEY))), KEY, "left_anti").drop(KEY)
