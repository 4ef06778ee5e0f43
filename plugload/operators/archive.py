"""Archive aggregates per plug, house and slice, and their history per time of day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plugload.functions.columns import day_of, slice_index, slot_of
from plugload.operators.blocks import running
from plugload.schema import HOUSE, PLUG
from plugload.session import materialized
from plugload.settings import Settings


def plug_slices(rows: DataFrame, s: Settings) -> DataFrame:
    """Average load, readings and readings with a value per plug and slice. One scan covers every archive day."""
    return (
        rows.groupBy(*PLUG, slice_index(F.col("ts_ms"), s).alias("slice_idx"))
        .agg(F.avg("value").alias("average_load"), F.count("*").alias("readings_count"), F.count("value").alias("value_count"))
    )


def house_slices(plugs: DataFrame) -> DataFrame:
    """House average per slice, plug averages weighted by the readings that have a value."""
    weight = F.col("value_count")
    total = F.sum(weight)
    return plugs.groupBy(*HOUSE, "slice_idx").agg(
        F.when(total > 0, F.sum(F.col("average_load") * weight) / total).alias("average_load"),
        F.sum("readings_count").alias("readings_count"),
    )


def with_day_and_slot(df: DataFrame, s: Settings) -> DataFrame:
    idx = F.col("slice_idx")
    return df.withColumn("slot", slot_of(idx, s)).withColumn("day", day_of(idx, s))


def last_n(averages: DataFrame, keys: Sequence[str], n: int, s: Settings) -> DataFrame:
    """The latest n day averages per key and time of day; age 1 is the latest. Groups hold one row per day."""
    w = Window.partitionBy(*keys, "slot").orderBy(F.col("day").desc())
    ranked = with_day_and_slot(averages, s).withColumn("age", F.row_number().over(w))
    return ranked.where(F.col("age") <= n)


def last_n_list(averages: DataFrame, keys: Sequence[str], n: int, s: Settings) -> DataFrame:
    """The same as one list per key and slot, latest first."""
    latest = last_n(averages, keys, n, s)
    pairs = F.array_sort(F.collect_list(F.struct("age", "average_load")))
    return latest.groupBy(*keys, "slot").agg(pairs["average_load"].alias("averages"))


def history_median(averages: DataFrame, current: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """Per row of ``current`` the median at the same time of day over the 1..history_days days before its target.

    The target lies lookahead_slices after slice_idx. Rows without history are dropped. Averages and targets share
    one shuffle by (key, slot); a group there holds at most two rows per calendar day.
    """
    asked = current.select(*_at_target(keys, s), F.lit(None).cast("double").alias("average_load"), _asked(current))
    nothing = F.lit(None).cast(asked.schema["asked"].dataType).alias("asked")
    history = with_day_and_slot(averages, s).select(*keys, "slot", "day", "average_load", nothing)
    return _over_history(history.unionByName(asked), keys, s)


def history_of_live(averages: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """history_median for the live rows among the averages, which are computed and shuffled only once."""
    current = averages.withColumnRenamed("average_load", "current_load")
    as_history = F.struct(
        *(F.col(k) for k in keys), slot_of(F.col("slice_idx"), s).alias("slot"), day_of(F.col("slice_idx"), s).alias("day"),
        F.col("current_load").alias("average_load"), F.when(F.lit(False), _asked(current)).alias("asked"),
    )
    as_target = F.struct(*_at_target(keys, s), F.lit(None).cast("double").alias("average_load"), _asked(current))
    roles = F.when(F.col("slice_idx") >= 0, F.array(as_history, as_target)).otherwise(F.array(as_history))
    return _over_history(current.select(F.explode(roles).alias("row")).select("row.*"), keys, s)


def _asked(current: DataFrame) -> Column:
    return F.struct(*current.columns).alias("asked")


def _at_target(keys: Sequence[str], s: Settings) -> list[Column]:
    target = F.col("slice_idx") + s.lookahead_slices
    return [*(F.col(k) for k in keys), slot_of(target, s).alias("slot"), day_of(target, s).alias("day")]


def _over_history(rows: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    earlier = Window.partitionBy(*keys, "slot").orderBy("day").rangeBetween(-s.history_days, -1)
    return (
        rows.withColumn("history_median", F.percentile("average_load", 0.5).over(earlier))
        .withColumn("history_count", F.count("average_load").over(earlier))
        .where("asked is not null and history_median is not null")
        .select("asked.*", "history_median", "history_count")
        .withColumn("target_slice", F.col("slice_idx") + s.lookahead_slices)
    )


def with_markers(plugs: DataFrame) -> DataFrame:
    """Archive rows plus one closing marker row (household -1, plug -1, load -1, count 1) per house and slice.

    The rows are used twice and so written to the shared folder first.
    """
    plugs = materialized(plugs)
    markers = plugs.select(*HOUSE, "slice_idx").distinct().select(
        *HOUSE, F.lit(-1).alias("household_id"), F.lit(-1).alias("plug_id"), "slice_idx",
        F.lit(-1.0).alias("average_load"), F.lit(1).cast("long").alias("readings_count"),
        F.lit(1).cast("long").alias("value_count"),
    )
    return plugs.unionByName(markers).withColumn("is_marker", F.col("plug_id") < 0)


def punctuated_batches(
    df: DataFrame, marker: str, keys: Sequence[str], order: Sequence[str], s: Settings, name: str = "batch_no"
) -> DataFrame:
    """Number the batches that marker rows close, from 1 per key; markers and rows of an unclosed batch are dropped.

    The rows are counted, numbered and measured, and so written to the shared folder first.
    """
    df = materialized(df)
    is_marker = F.when(F.col(marker), 1).otherwise(0).cast("long")
    closed = df.groupBy(*keys).agg(F.sum(is_marker).alias("_closed"))
    numbered = running(df, keys, order, s, sums={"_markers": is_marker}).where(~F.col(marker))
    numbered = numbered.join(closed, list(keys)).where(F.col("_markers") < F.col("_closed"))
    return numbered.withColumn(name, F.col("_markers") + 1).drop("_markers", "_closed")
