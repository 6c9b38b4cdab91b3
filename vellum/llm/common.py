"""Helpers that every training-data operator shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.sources.workspace import _written, release, scratch, settle, settled, shared_dir, shared_path  # noqa: F401  for the operators

#: Words are maximal runs of anything but ASCII white space; ``bytes.split()`` splits on the same set.
WORD = r"[^\x20\x09-\x0D]+"
#: How many hot keys a join may broadcast, and the least rows of a key that is hot.
HOT_KEYS, HOT_ROWS = 10_000, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has each key once and in ``count`` its number of rows.

    A key of more than ``total / HOT_KEYS`` rows (and HOT_ROWS) is hot. There are at most HOT_KEYS of
    them among ``total`` rows, so they are broadcast and their rows never meet in one task; all other
    keys are joined by shuffling. Keys are not null; ``count`` is not in the result.
    """
    bound = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(keyed.where(F.col(count) > bound))
    cold = keyed.where(F.col(count) <= bound)
    left = rows.join(hot.select(*keys), keys, "left_anti").join(cold.drop(count), keys)
    return rows.join(hot.drop(count), keys).unionByName(left)


def parts(spark: SparkSession, rows: int, per_part: int) -> int:
    """How many groups of about ``per_part`` rows hold ``rows`` rows; at least one."""
    return max(1, -(-int(rows) // per_part))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as keep it from clashing with ``taken``."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def in_written_order(rows: DataFrame) -> DataFrame:
    """Rows that were written in order and read back from Parquet, in that order again.

    A scan packs files into tasks by their size, so it keeps the order within a file only. Files are
    taken by the numbers that Spark gives them, the task's and then the file's of the task.
    """
    at = rows.metadataColumn("_metadata")
    number = lambda pattern: F.regexp_extract(at["file_name"], pattern, 1).try_cast("long")
    keys = {"_task": number(r"^part-(\d+)"), "_file": number(r"-c(\d+)"), "_path": at["file_path"], "_row": at["row_index"]}
    names = {fresh(k, rows.columns): of for k, of in keys.items()}
    return rows.select("*", *[of.alias(k) for k, of in names.items()]).repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)


def numbered(rows: DataFrame, order: list[Column], name: str, tag: str) -> DataFrame:
    """``rows`` with their place (a long from 0) in ``order`` over the whole table, in a column ``name``.

    Rows are dealt into ranges of ``order``, with the place in the input behind it, so equal rows don't
    meet in one task; each range is sorted and written. A row's place is that in its range plus the rows
    of the ranges before, of which there is one number a range.
    """
    own = fresh("_own", rows.columns)
    ranges = rows.withColumn(own, F.monotonically_increasing_id())
    keys = [*order, F.col(own)]
    sorted_rows = ranges.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the id's upper bits are the range, the lower 33 the place in it
    placed = settle(sorted_rows.withColumn(own, F.monotonically_increasing_id()), tag)
    at = F.shiftrightunsigned(own, 33)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(at.alias("range")).agg(F.count(F.lit(1)).alias("n"))
        .select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    )
    start, row = fresh("start", placed.columns), fresh("range", placed.columns)
    starts = F.broadcast(starts.select(F.col("range").alias(row), F.col("start").alias(start)))
    place = F.col(start) + F.col(own).bitwiseAND((1 << 33) - 1)
    return placed.join(starts, at == F.col(row)).withColumn(name, place).drop(own, start, row)
