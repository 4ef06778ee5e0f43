"""Running totals and previous values along an order, safe for groups of any size.

A window function puts a whole group into one task. That is the best plan while groups are small. When the
largest group is above a limit, the rows are range-partitioned by (keys, order) instead: Spark then cuts a hot
group into several partitions, each partition into blocks of at most ``block_rows`` rows, and only one row per
(group, block) is carried from block to block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plugload.session import materialized
from plugload.settings import Settings


def largest_group(df: DataFrame, keys: Sequence[str | Column]) -> int:
    """Row count of the largest group; one aggregation with map-side combining, one row to the driver."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def in_blocks(df: DataFrame, order: Sequence[str | Column], block_rows: int, name: str) -> DataFrame:
    """Sort globally by ``order`` and number the blocks of that sort; block numbers grow with the order.

    monotonically_increasing_id is (partition << 33) + row, so a shift by log2(block_rows) numbers runs of
    block_rows sorted rows. The caller must write the result before using the number more than once.
    """
    shift = block_rows.bit_length() - 1
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn(name, F.shiftright(F.monotonically_increasing_id(), shift))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    s: Settings,
    sums: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Add inclusive running sums and previous-row values per key along ``order`` (which must be unique per key).

    ``largest`` is an upper bound of the group size if the caller knows one; otherwise it is counted.
    """
    sums, previous = sums or {}, previous or {}
    if largest is None:
        largest = largest_group(df, keys)
    if keys and largest <= s.window_rows:
        return df.select("*", *_window_columns(keys, order, sums, previous))

    names = {**{f"_sum_{k}": c for k, c in sums.items()}, **{f"_prev_{k}": c for k, c in previous.items()}}
    rows = df.select("*", *(c.alias(n) for n, c in names.items()))
    rows = materialized(in_blocks(rows, [*keys, *order], s.block_rows, "_block"))
    group = [*keys, "_block"]

    # One row per (key, block): block totals and the last value of the block, then their running form.
    totals = rows.groupBy(*group).agg(
        *(F.sum(f"_sum_{k}").alias(f"_sum_{k}") for k in sums),
        *(F.max_by(f"_prev_{k}", F.struct(*order)).alias(f"_prev_{k}") for k in previous),
        F.count("*").alias("_rows"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_block")
    carry = totals.select(
        *(F.col(k).alias(f"_of_{k}") for k in group),
        *(F.sum(f"_sum_{k}").over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_c_{k}") for k in sums),
        *(F.lag(f"_prev_{k}").over(earlier).alias(f"_c_{k}") for k in previous),
    )
    local_sums = {f"_l_{k}": F.col(f"_sum_{k}") for k in sums}
    local_prev = {f"_l_{k}": F.col(f"_prev_{k}") for k in previous}
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    inside = rows.select("*", *_window_columns(group, order, local_sums, local_prev), first.alias("_first"))
    # Rows whose key is null are a group like any other, as they are for a window.
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in group]
    joined = inside.join(carry, same, "left")
    return joined.select(
        *df.columns,
        *(_total(F.col(f"_l_{k}"), F.col(f"_c_{k}")).alias(k) for k in sums),
        *(F.when(F.col("_first"), F.col(f"_c_{k}")).otherwise(F.col(f"_l_{k}")).alias(k) for k in previous),
    )


def _total(local: Column, carried: Column) -> Column:
    """Like sum: null only without any value."""
    some = F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return F.when(local.isNotNull() | carried.isNotNull(), some)


def _window_columns(keys, order, sums, previous) -> list[Column]:
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return [
        *(F.sum(c).over(upto).alias(k) for k, c in sums.items()),
        *(F.lag(c).over(w).alias(k) for k, c in previous.items()),
    ]


def row_numbers(df: DataFrame, order: Sequence[str], s: Settings, name: str = "row_no") -> DataFrame:
    """Number all rows of a DataFrame 1, 2, 3, ... along a unique order without one global task."""
    return running(df, [], order, s, sums={name: F.lit(1).cast("long")}, largest=0)


def sample_every_n(df: DataFrame, n: int, order: Sequence[str], s: Settings) -> DataFrame:
    """Every n-th row along the order: rows n, 2n, 3n, ..."""
    if n < 1:
        raise ValueError("n must be positive")
    return row_numbers(df, order, s).where(F.col("row_no") % n == 0)
