"""Load prediction two slices ahead, per house and per plug."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plugload.functions.columns import predicted, slice_index, slice_label
from plugload.operators.archive import history_of_live
from plugload.operators.blocks import largest_group, running
from plugload.schema import HOUSE, PLUG
from plugload.settings import Settings
from plugload.sources.readings import between, slice_rows


def running_average(rows: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """Average and count within the slice up to each reading, per house or per plug.

    Readings without value are counted and do not move the average, which is null until there is a value.
    """
    rows = rows.withColumn("slice_idx", slice_index(F.col("ts_ms"), s))
    group = [*keys, "slice_idx"]
    one = F.lit(1).cast("long")
    with_sums = running(
        rows, group, ["ts_ms", "id"], s,
        sums={"_sum": F.col("value"), "_values": F.when(F.col("value").isNotNull(), one), "readings_count": one},
        largest=largest_group(rows, group),
    )
    return with_sums.withColumn("current_load", F.col("_sum") / F.col("_values")).drop("_sum", "_values")


def slice_average(rows: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """Average over the readings of each slice, per house or per plug."""
    return rows.groupBy(*keys, slice_index(F.col("ts_ms"), s).alias("slice_idx")).agg(
        F.avg("value").alias("current_load"), F.count("*").alias("readings_count")
    )


def key_averages(rows: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """Averages per key and slice. The average over readings equals the weighted average of the plug averages."""
    return slice_average(rows, keys, s).withColumnRenamed("current_load", "average_load")


def predict(readings: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """One row per key and live slice with its average and the predicted load of the target slice.

    The archive is everything in ``readings`` from the oldest day that a live slice may need: live data become
    archive a day later.
    """
    rows = slice_rows(between(readings, s.history_start_ms), s)
    return _finish(history_of_live(key_averages(rows, keys, s), keys, s), s)


def predict_per_reading(readings: DataFrame, keys: Sequence[str], s: Settings) -> DataFrame:
    """The same with one row per live reading, current_load being the average up to that reading."""
    rows = slice_rows(between(readings, s.history_start_ms), s)
    medians = history_of_live(key_averages(rows, keys, s), keys, s)
    medians = medians.select(*keys, "slice_idx", "target_slice", "history_median")
    live = running_average(between(rows, s.live_start_ms), keys, s)
    return _finish(live.join(medians, [*keys, "slice_idx"]), s)


def _finish(joined: DataFrame, s: Settings) -> DataFrame:
    return joined.withColumn(
        "predicted_load", predicted(F.col("history_median"), F.col("current_load"))
    ).withColumn("time_slice", slice_label(F.col("target_slice"), s))


def q1a(readings: DataFrame, s: Settings) -> DataFrame:
    return predict(readings, HOUSE, s)


def q1b(readings: DataFrame, s: Settings) -> DataFrame:
    return predict(readings, PLUG, s)
