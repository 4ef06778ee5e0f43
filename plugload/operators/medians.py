"""Grouped medians: exact, lower, sampled, and on a grid of overlapping windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plugload.functions.columns import slice_index
from plugload.operators.blocks import largest_group, running
from plugload.operators.sliding import sliding_median
from plugload.settings import Settings


def histogram(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values per key with their counts, column n; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))


def rows_bound(df: DataFrame, keys: Sequence[str | Column], s: Settings, copies: int = 1) -> int | None:
    """Rows of the largest group if they prove that its histogram is small; None if the histogram must be counted."""
    most = copies * largest_group(df, keys)
    return most if most <= s.window_rows else None


def median_of_histogram(
    hist: DataFrame, keys: Sequence[str], s: Settings, value: str = "value", largest: int | None = None
) -> DataFrame:
    """Exact median per key of a value -> n histogram: columns keys, median, n."""
    middle = (F.min(value) + F.max(value)) / 2
    return _middle_rows(hist, keys, s, value, largest).groupBy(*keys).agg(middle.alias("median"), F.max("size").alias("n"))


def lower_median_of_histogram(
    hist: DataFrame, keys: Sequence[str], s: Settings, value: str = "value", largest: int | None = None
) -> DataFrame:
    """Smallest value whose cumulative count reaches (n + 1) / 2: columns keys, median, n."""
    middle = _middle_rows(hist, keys, s, value, largest)
    return middle.groupBy(*keys).agg(F.min(value).alias("median"), F.max("size").alias("n"))


def _middle_rows(hist: DataFrame, keys: Sequence[str], s: Settings, value: str, largest: int | None) -> DataFrame:
    """The one or two histogram rows per key that hold the middle ranks, with the group size.

    Running counts find them; unlike Spark's percentile no task keeps a histogram in memory. Groups above
    ``window_rows`` distinct values are counted block by block.
    """
    keys = list(keys)
    if largest is None:
        largest = largest_group(hist, keys)
    if keys and largest <= s.window_rows:
        w = Window.partitionBy(*keys)
        upto = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = hist.select(*keys, value, "n", upto.alias("upto"), F.sum("n").over(w).alias("size"))
    else:
        ranked = running(hist, keys, [value], s, sums={"upto": F.col("n")}, largest=largest)
        sizes = hist.groupBy(*keys).agg(F.sum("n").alias("size"))
        ranked = ranked.join(sizes, keys) if keys else ranked.join(F.broadcast(sizes))  # without keys: one row
    lower, upper = F.floor((F.col("size") + 1) / 2), F.floor(F.col("size") / 2) + 1
    return ranked.where((F.col("upto") >= lower) & (F.col("upto") - F.col("n") < upper))


def exact_median(df: DataFrame, keys: Sequence[str], s: Settings, value: str = "value") -> DataFrame:
    """Exact median per key, for groups of any size."""
    return median_of_histogram(histogram(df, keys, value), keys, s, value, rows_bound(df, keys, s))


def lower_median(df: DataFrame, keys: Sequence[str], s: Settings, value: str = "value") -> DataFrame:
    """Exact lower median per key, for groups of any size."""
    return lower_median_of_histogram(histogram(df, keys, value), keys, s, value, rows_bound(df, keys, s))


def reservoir_median(
    df: DataFrame, keys: Sequence[str], k: int, seed: int, value: str = "value", id_col: str = "id"
) -> DataFrame:
    """Median of k rows per key, drawn uniformly by a hash of (seed, id): repeatable and independent of row order.

    Only the k rows with the smallest hash are wanted. Every task keeps at most k rows per key and bucket before the
    shuffle, every bucket k rows per key before the last step, which so gets a fixed number of rows.
    """
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col)))
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, id_col, draw.alias("draw"))
    if keys:
        sample = rows.withColumn("bucket", F.pmod(F.xxhash64("draw"), F.lit(64)))
        for group in ([*keys, "bucket"], keys):
            w = Window.partitionBy(*group).orderBy("draw", id_col)
            sample = sample.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    else:
        # First the k of each of many buckets, each in a task of its own, then the k of these.
        w = Window.partitionBy("bucket").orderBy("draw", id_col)
        first = rows.withColumn("bucket", F.pmod(F.xxhash64("draw"), F.lit(256))).withColumn("rn", F.row_number().over(w))
        sample = first.where(F.col("rn") <= k).orderBy("draw", id_col).limit(k)
    return sample.groupBy(*keys).agg(F.median(value).alias("median"), F.count("*").alias("n"))


def sketch_median(df: DataFrame, keys: Sequence[str], accuracy: int = 10_000, value: str = "value") -> DataFrame:
    """Lower median with a rank error of at most n / accuracy; memory per group is bounded, partials are merged."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.percentile_approx(value, 0.5, accuracy).alias("median"), F.count("*").alias("n")
    )


def sketch_slices(df: DataFrame, keys: Sequence[str], s: Settings, k: int = 400, value: str = "value") -> DataFrame:
    """One KLL sketch of the values per key and slice, to be stored: keys, slice_idx, sketch, n.

    A sketch has some kilobytes whatever it has seen; partial sketches are merged before the shuffle.
    """
    slices = slice_index(F.col("ts_ms"), s).alias("slice_idx")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, slices).agg(
        F.kll_sketch_agg_double(value, k).alias("sketch"), F.count("*").alias("n")
    )


def quantile_of_sketches(sketches: DataFrame, keys: Sequence[str], quantile: float = 0.5) -> DataFrame:
    """Quantile per key over all given slices by merging their stored sketches: keys, quantile, n. No value is read again."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    return merged.select(*keys, F.kll_sketch_get_quantile_double("sketch", F.lit(quantile)).alias("quantile"), "n")


def with_rank_error(quantiles: DataFrame, df: DataFrame, keys: Sequence[str], quantile: float = 0.5, value: str = "value") -> DataFrame:
    """Adds rank_error: how far, as a share of the rows, the quantile lies from the values of the wanted rank."""
    rows = df.where(F.col(value).isNotNull()).join(quantiles, list(keys))
    ranks = rows.groupBy(*keys, "quantile").agg(
        F.count_if(F.col(value) < F.col("quantile")).alias("below"), F.count_if(F.col(value) <= F.col("quantile")).alias("upto"), F.count("*").alias("n")
    )
    share = lambda c: F.col(c) / F.col("n")
    return ranks.select(*keys, "quantile", "n", F.greatest(share("below") - quantile, quantile - share("upto"), F.lit(0.0)).alias("rank_error"))


#: Widths per block of time in which grid windows are counted.
GRID_WIDTHS = 24


def grid_ends(df: DataFrame, keys: Sequence[str], width_ms: int, slide_ms: int) -> DataFrame:
    """Columns keys, window_end, n: the half-open windows [end - width, end) that hold values, each once.

    Ends are multiples of the slide. Values are counted per pane of one slide; a pane adds the ends that the pane
    before it did not reach, and range sums of the panes give n. Time is cut into blocks of some widths, each of which also
    gets the panes of one width before it, so neither a key nor all keys together are one task.
    """
    if width_ms % slide_ms:
        raise ValueError("the slide must divide the width")
    block_ms = GRID_WIDTHS * width_ms
    pane = ((F.floor(F.col("ts_ms") / slide_ms) + 1) * slide_ms).alias("window_end")
    panes = df.where(F.col("value").isNotNull()).groupBy(*keys, pane).agg(F.count("*").alias("n"))
    own = F.floor(F.col("window_end") / block_ms)
    reaches = F.col("window_end") + width_ms > (own + 1) * block_ms
    blocks = F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))
    panes = panes.withColumn("_block", F.explode(blocks))
    along = Window.partitionBy(*keys, "_block").orderBy("window_end")
    # A pane that is missing before a block's first one reaches no end of this block.
    first = F.greatest("window_end", F.coalesce(F.lag("window_end").over(along) + width_ms, "window_end"), F.col("_block") * block_ms)
    last = F.least(F.col("window_end") + (width_ms - slide_ms), (F.col("_block") + 1) * block_ms - 1)
    asked = panes.select(*keys, "_block", first.alias("first"), last.alias("last")).where("first <= last")
    asked = asked.select(*keys, "_block", F.explode(F.sequence("first", "last", F.lit(slide_ms))).alias("window_end"))
    every = panes.withColumn("asked", F.lit(False)).unionByName(
        asked.select("*", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    )
    inside = F.sum("n").over(along.rangeBetween(-(width_ms - slide_ms), 0))
    return every.withColumn("n", inside).where("asked").drop("asked", "_block")


def grid_median(df: DataFrame, keys: Sequence[str], width_ms: int, slide_ms: int, s: Settings) -> DataFrame:
    """Columns keys, window_end, median, n for every window that holds values.

    A window is the sliding window asked one millisecond before its end, so no reading is copied to its windows.
    ``df`` needs keys, ts_ms, value and id.
    """
    ends = grid_ends(df, keys, width_ms, slide_ms)
    asked = ends.select(
        *keys, (F.col("window_end") - 1).alias("ts_ms"), F.lit(None).cast("double").alias("value"), F.lit(-1).cast("long").alias("id")
    )
    rows = df.where(F.col("value").isNotNull()).select(*keys, "ts_ms", "value", "id").unionByName(asked)
    answered = sliding_median(rows, keys, width_ms, s).withColumn("window_end", F.col("ts_ms") + 1)
    medians = answered.where(F.col("window_end") % slide_ms == 0).select(*keys, "window_end", "median")
    return medians.join(ends, [*keys, "window_end"])
