"""Column expressions: slices, labels, keys, prediction and small scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plugload.settings import Settings


def slice_index(ts_ms: Column, s: Settings) -> Column:
    """Number of the half-open slice holding ts_ms, counted from live_start (negative before it)."""
    return F.floor((ts_ms - F.lit(s.live_start_ms)) / F.lit(s.slice_ms))


def slot_of(slice_idx: Column, s: Settings) -> Column:
    return F.pmod(slice_idx, F.lit(s.slices_per_day)).cast("int")


def day_of(slice_idx: Column, s: Settings) -> Column:
    return F.floor(slice_idx / F.lit(s.slices_per_day)).cast("int")


def slice_start_ms(slice_idx: Column, s: Settings) -> Column:
    return slice_idx * F.lit(s.slice_ms) + F.lit(s.live_start_ms)


def slice_label(slice_idx: Column, s: Settings) -> Column:
    """'HH:mm TO HH:mm' on the 24-hour clock, UTC; for display, never a key."""
    start = slice_start_ms(slice_idx, s)
    return F.concat(
        F.date_format(F.timestamp_millis(start), "HH:mm"),
        F.lit(" TO "),
        F.date_format(F.timestamp_millis(start + F.lit(s.slice_ms)), "HH:mm"),
    )


def time_frame(end_ms: Column, width_ms: int) -> Column:
    """'dd-MMM-yyyy HH:mm:ss TO ...' of the window that ends at end_ms, earlier time first."""
    pattern = "dd-MMM-yyyy HH:mm:ss"
    return F.concat(
        F.date_format(F.timestamp_millis(end_ms - F.lit(width_ms)), pattern),
        F.lit(" TO "),
        F.date_format(F.timestamp_millis(end_ms), pattern),
    )


def plug_key() -> Column:
    return F.concat_ws("_", "house_id", "household_id", "plug_id")


def member_key() -> Column:
    """Key of a plug within its house."""
    return F.concat_ws("-", "household_id", "plug_id")


def predicted(median: Column, current: Column) -> Column:
    return (median + current) / F.lit(2.0)


def above(median: Column, reference: Column) -> Column:
    return median > reference


def share_of_true(flag: Column) -> Column:
    """Percentage of true flags as an aggregate."""
    return F.avg(F.when(flag, 100.0).otherwise(0.0))


def round_half_up(value: Column, places: int) -> Column:
    if places < 0:
        raise ValueError("places must not be negative")
    return F.round(value, places)


def suffixed(word: Column, suffix: str = "!!!", times: int = 1) -> Column:
    for _ in range(times):
        word = F.concat(word, F.lit(suffix))
    return word


def latency_ms(eval_ms: Column) -> Column:
    return F.unix_millis(F.current_timestamp()) - eval_ms
