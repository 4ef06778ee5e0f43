"""Parameters shared by every query."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

DAY_MS = 86_400_000

# Property codes of a reading.
WORK = 0
LOAD = 1


@dataclass(frozen=True)
class Settings:
    live_start_ms: int = 1378604640000
    slice_ms: int = 60_000
    lookahead_slices: int = 2
    history_days: int = 29
    # Day streams that a running prediction starts from; its history then grows up to history_days as days pass.
    start_days: int = 29
    # Houses with this number or above are left out of slice_rows; None keeps all.
    house_limit: int | None = None
    window_ms: int = 3_600_000
    watermark_ms: int = 60_000
    jdbc_batch_rows: int = 5_000
    # Largest group that one task may hold in memory (Python groups, percentile buffers) and that one task may sort
    # for a window function (spills to disk). Larger groups are cut into blocks of at most block_rows rows.
    group_rows: int = 2_000_000
    window_rows: int = 32_000_000
    block_rows: int = 1 << 20

    def __post_init__(self) -> None:
        if self.slice_ms <= 0 or DAY_MS % self.slice_ms:
            raise ValueError(f"slice of {self.slice_ms} ms does not divide a day")
        if self.block_rows & (self.block_rows - 1) or self.block_rows <= 0:
            raise ValueError("block_rows must be a power of two")

    @property
    def slices_per_day(self) -> int:
        return DAY_MS // self.slice_ms

    @property
    def archive_start_ms(self) -> int:
        """Start of the first archive slice: one day back, two slices ahead."""
        return self.live_start_ms - DAY_MS + self.lookahead_slices * self.slice_ms

    @property
    def history_start_ms(self) -> int:
        """Start of the oldest slice that the history of a live slice may need."""
        return self.live_start_ms + (self.lookahead_slices - self.history_days * self.slices_per_day) * self.slice_ms

    def with_window(self, window_ms: int) -> "Settings":
        return replace(self, window_ms=window_ms)

    @classmethod
    def from_properties(cls, values: Mapping[str, str]) -> "Settings":
        """Build from the textual property names used in deployment files."""
        # Property name -> (field, factor).
        names = {
            "live.start.time": ("live_start_ms", 1),
            "slice.in.mins": ("slice_ms", 60_000),
            "number.of.archive.streams": ("start_days", 1),
        }
        return cls(**{field: int(values[name]) * factor for name, (field, factor) in names.items() if name in values})
