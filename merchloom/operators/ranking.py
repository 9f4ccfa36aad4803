"""Top-k, numbering and paging that never put a whole group or table into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchloom.session import cut_lineage

# Spark itself cuts a rank filter down before the shuffle up to this k; see WindowGroupLimit.
PRE_SHUFFLE_LIMIT = 100
SALTS = 64
_INDEX_BITS = 33


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None,
                  salt_by: Sequence[str] = ()) -> DataFrame:
    """The first ``k`` rows per group in a total order.

    For a small ``k`` the plan limits every input partition before the shuffle. For a larger one the
    group is first split by a salt (a hash of ``salt_by``, best the row id), so that a hot group is ranked by many tasks and at most
    ``SALTS * k`` of its rows meet in one task.
    """
    name = rank or "_rank"
    if k > PRE_SHUFFLE_LIMIT:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*(salt_by or df.columns)), F.lit(SALTS)))
        window = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = salted.withColumn("_pre", F.row_number().over(window)).where(F.col("_pre") <= k).drop("_pre", "_salt")
    window = Window.partitionBy(*group).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key; each input partition sends at most one row per key into the shuffle."""
    return top_per_group(df, keys, order, 1)


def numbered(df: DataFrame, order: Sequence[Column], name: str, start: Column | int = 1) -> DataFrame:
    """Consecutive numbers in a total order, without a global window.

    Rows are range-partitioned and sorted; a row's number is its place in its partition plus the
    sizes of the partitions before it. The ranges are fixed by a checkpoint before they are counted.
    Only one row per partition is added up in a single task.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.select("*", F.shiftright("_place", _INDEX_BITS).alias("_part"),
                           F.col("_place").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1)).alias("_index"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    # one row per shuffle partition, so the broadcast cannot grow with the data
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_index") + F.col("_before") + (start if isinstance(start, Column) else F.lit(start)))
        .drop("_place", "_part", "_index", "_before")
    )


def running_sum(df: DataFrame, order: Sequence[Column], value: str, before: str, rows: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before in a total order, and the number of all rows, without a global window.

    Parallel prefix sums: ranges are summed on their own, then moved by the sums of the ranges before them. Only one row per
    partition is added up in a single task.
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", _INDEX_BITS))
    sums = placed.groupBy("_part").agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_count"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"), F.sum("_count").over(Window.partitionBy()).alias(rows))
    within = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition, so the broadcast cannot grow with the data
    return (
        placed.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(offsets), "_part")
        .withColumn(before, F.col("_own") + F.col("_offset")).drop("_place", "_part", "_own", "_offset")
    )


DRIVER_LIMIT = 10_000


def first_rows(df: DataFrame, order: Sequence[Column], n: int, offset: int = 0) -> DataFrame:
    """Rows ``offset+1 .. offset+n`` in a total order; ``n = 0`` means all rows.

    A short page is a TakeOrdered; a long one is cut by number so that it stays distributed.
    """
    if n == 0:
        return df.orderBy(*order)
    if offset + n <= DRIVER_LIMIT:
        return df.orderBy(*order).offset(offset).limit(n)
    ranked = numbered(df, order, "_n").where((F.col("_n") > offset) & (F.col("_n") <= offset + n))
    return ranked.drop("_n")


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> tuple[DataFrame, DataFrame]:
    """(total as a one-row table, the page's rows); pages count from 1."""
    return df.agg(F.count(F.lit(1)).alias("total")), first_rows(df, order, size, (number - 1) * size)
