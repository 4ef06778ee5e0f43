"""Keyed stream state in event order.

``in_event_order`` holds the readings of a key until the watermark has passed them and then hands them to a processor, sorted
by time and id, whatever the order and the micro-batches in which they came. What a processor remembers between
calls is its memory, one per key; it is part of the checkpointed state.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plugload.functions.ranks import RankedValues

STATE = "pending binary, memories binary"
# Keys whose hash is equal modulo this number share a state; part of a checkpoint.
BUCKETS = 4096


class Processor(Protocol):
    """``columns`` are doubles it needs beside ts_ms and id; null comes as NaN. ``output`` is the schema of its rows."""

    columns: Sequence[str]
    output: str

    def start(self) -> Any: ...

    def advance(self, memory: Any, ts: np.ndarray, ids: np.ndarray, values: list[np.ndarray]) -> list[list]:
        """Take rows in event order, change the memory, give output columns."""

    def expire(self, memory: Any, watermark: int) -> int | None:
        """Forget what no later row can need; the time at which there is more to forget, if no row comes."""

    def dump(self, memory: Any) -> bytes: ...

    def load(self, data: bytes) -> Any: ...


def in_event_order(
    rows: DataFrame, keys: Sequence[str], processor: Processor, idle_ms: int | None = None
) -> DataFrame:
    """Output rows of the processor with the keys; ``rows`` needs keys, ts_ms, id, the processor's columns and an event time.

    Rows up to the watermark are final, as later ones of that time are dropped. The state of many keys is kept together, by
    a hash of the key: Spark's cost per state is far above that of a key's few readings. Each key has a memory of its
    own. A bucket's timer is set to its oldest waiting row, so rows are released when the watermark moves, also without new
    ones. ``idle_ms`` removes a key that had no reading for so long (event time); off by default.
    """
    keys, columns = list(keys), list(processor.columns)
    names = [part.split()[0] for part in processor.output.split(", ")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), processor.output])

    def run(_bucket: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = max(state.getCurrentWatermarkMs(), 0)
        # Waiting rows: place of the key in ``held``, time, id, columns. Held: key, memory, when to expire, newest time.
        waiting, held = [], []
        if state.exists:
            pending, packed = state.get
            waiting, held = [pickle.loads(pending)], pickle.loads(packed)
        places = {entry[0]: i for i, entry in enumerate(held)}
        for frame in frames:
            if len(frame):
                place = _places(frame[keys], places, held)
                some = [frame["ts_ms"].to_numpy(np.int64), frame["id"].to_numpy(np.int64)]
                waiting.append([place, *some, *(frame[c].to_numpy(float) for c in columns)])
        data = [np.concatenate(part) for part in zip(*waiting)] if waiting else [np.empty(0, np.int64)] * (3 + len(columns))
        newest = np.array([entry[3] for entry in held], np.int64)
        np.maximum.at(newest, data[0], data[1])
        ready = data[1] <= watermark
        done, rest = [part[ready] for part in data], [part[~ready] for part in data]
        order = np.lexsort((done[2], done[1], done[0]))
        done = [part[order] for part in done]
        bounds = np.searchsorted(done[0], np.arange(len(held) + 1)).tolist()

        owners, out = [], [[] for _ in names]
        for i, (key, packed, wake, _) in enumerate(held):
            first, after = bounds[i], bounds[i + 1]
            if first < after or (wake is not None and wake <= watermark):
                memory = processor.start() if packed is None else processor.load(packed)
                if first < after:
                    found = processor.advance(memory, *(part[first:after] for part in done[1:3]), [p[first:after] for p in done[3:]])
                    owners += [key] * len(found[0])
                    for column, part in zip(out, found):
                        column += part
                wake = processor.expire(memory, watermark)
                packed = processor.dump(memory)
            held[i] = (key, packed, wake, int(newest[i]))
        if owners:
            yield pd.DataFrame({**dict(zip(keys, zip(*owners))), **dict(zip(names, out))}, dtype=object)

        if idle_ms is not None:
            kept = newest + idle_ms > watermark
            kept[rest[0]] = True
            rest[0] = (np.cumsum(kept) - 1)[rest[0]]
            held = [entry for entry, keep in zip(held, kept) if keep]
        if not held:
            state.remove()
            return
        times = [int(rest[1].min()) - 1] if len(rest[1]) else []
        times += [wake for _, _, wake, _ in held if wake is not None]
        times += [last + idle_ms for *_, last in held] if idle_ms is not None else []
        state.update((pickle.dumps(rest), pickle.dumps(held)))
        if times:
            state.setTimeoutTimestamp(max(min(times), watermark, 1))

    # Which keys are null is part of the bucket, so a key column of a bucket holds nulls only or none.
    nulls = sum((F.col(k).isNull().cast("long") * (BUCKETS << i) for i, k in enumerate(keys)), F.lit(0))
    bucket = (F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) + nulls).alias("bucket")
    wanted = rows.select(bucket, *keys, "ts", "ts_ms", "id", *(F.col(c).cast("double").alias(c) for c in columns))
    return wanted.groupBy("bucket").applyInPandasWithState(run, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def _places(frame: pd.DataFrame, places: dict[tuple, int], held: list[tuple]) -> np.ndarray:
    """The place of each row's key in ``held``, where new keys are added."""
    number = frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy()
    _, first = np.unique(number, return_index=True)
    found = zip(*([None if pd.isna(v) else v for v in frame[k].iloc[first].tolist()] for k in frame.columns))
    place = []
    for key in found:
        if key not in places:
            places[key] = len(held)
            held.append((key, None, None, 0))
        place.append(places[key])
    return np.array(place, np.int64)[number]


class _Window:
    """Readings of one width in time order and their values by rank."""

    def __init__(self) -> None:
        self.rows: deque[tuple[int, float]] = deque()
        self.values = RankedValues()
        self.flag: bool | None = None

    def add(self, ts: int, value: float) -> None:
        if value == value:
            self.rows.append((ts, value))
            self.values.insert(value)

    def leave(self, upto: int) -> None:
        while self.rows and self.rows[0][0] <= upto:
            self.values.remove(self.rows.popleft()[1])


class SlidingMedian:
    """Median of (t - width, t] at each distinct time of a key, with the smallest id of that time."""

    columns = ["value"]
    output = "ts_ms bigint, id bigint, median double"

    def __init__(self, width_ms: int):
        self.width_ms = width_ms

    def start(self) -> _Window:
        return _Window()

    def times(self, window: _Window, ts: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, int, float | None]]:
        """(first row, time, median) of each distinct time."""
        edges = np.flatnonzero(np.append(True, ts[1:] != ts[:-1])).tolist()
        for first, after in zip(edges, [*edges[1:], len(ts)]):
            t = int(ts[first])
            window.leave(t - self.width_ms)
            for value in values[first:after].tolist():
                window.add(t, value)
            yield first, t, window.values.median()

    def advance(self, memory: _Window, ts, ids, values) -> list[list]:
        found = [(t, int(ids[first]), median) for first, t, median in self.times(memory, ts, values[0])]
        return [list(c) for c in zip(*found)]

    def expire(self, memory: _Window, watermark: int) -> int | None:
        memory.leave(watermark - self.width_ms)
        return memory.rows[0][0] + self.width_ms if memory.rows else None

    def dump(self, memory: _Window) -> bytes:
        ts = np.fromiter((r[0] for r in memory.rows), np.int64, len(memory.rows))
        values = np.fromiter((r[1] for r in memory.rows), float, len(memory.rows))
        return pickle.dumps((ts.tobytes(), values.tobytes(), memory.values.dump(), memory.flag))

    def load(self, data: bytes) -> _Window:
        ts, values, ranked, flag = pickle.loads(data)
        window = _Window()
        window.rows = deque(zip(np.frombuffer(ts, np.int64).tolist(), np.frombuffer(values, float).tolist()))
        window.values, window.flag = RankedValues.load(ranked), flag
        return window


class FlagChanges(SlidingMedian):
    """Changes of the flag "sliding median above the reference" of a key; its first flag is a change."""

    columns = ["value", "global_median"]
    output = "ts_ms bigint, id bigint, flag boolean, previous_flag boolean"

    def advance(self, memory: _Window, ts, ids, values) -> list[list]:
        found, reference = [], values[1]
        for first, t, median in self.times(memory, ts, values[0]):
            if median is None or reference[first] != reference[first]:
                continue
            flag = bool(median > reference[first])
            if flag != memory.flag:
                found.append((t, int(ids[first]), flag, memory.flag))
                memory.flag = flag
        return [list(c) for c in zip(*found)] if found else [[], [], [], []]


class SlidingSample:
    """Median of a sample of ``k`` readings of (t - width, t] at each distinct time: those of the least draws.

    Draws are given as a column, so a sample is repeatable. A reading can never be drawn again once k newer ones have
    lesser draws, as they stay longer; only the others are remembered, about k log(n / k) of the n readings in a window.
    """

    columns = ["value", "draw"]
    output = "ts_ms bigint, id bigint, median double, drawn bigint"

    def __init__(self, width_ms: int, k: int):
        self.width_ms, self.k = width_ms, k

    def start(self) -> list[np.ndarray]:
        """One table with the rows time, id, draw, value, number of newer readings with lesser draws."""
        return [np.empty((5, 0))]

    def advance(self, memory: list, ts, ids, values) -> list[list]:
        found, kept = [], memory[0]
        edges = np.flatnonzero(np.append(True, ts[1:] != ts[:-1])).tolist()
        for first, after in zip(edges, [*edges[1:], len(ts)]):
            t = int(ts[first])
            kept = kept[:, kept[0] > t - self.width_ms]
            for i in range(first, after):
                value, draw = values[0][i], values[1][i]
                if value == value:
                    kept[4] += (kept[2] > draw) | ((kept[2] == draw) & (kept[1] > ids[i]))
                    kept = np.column_stack([kept[:, kept[4] < self.k], [t, ids[i], draw, value, 0]])
            drawn = kept[3][np.lexsort((kept[1], kept[2]))[: self.k]]
            found.append((t, int(ids[first]), float(np.median(drawn)) if len(drawn) else None, len(drawn)))
        memory[0] = kept
        return [list(c) for c in zip(*found)]

    def expire(self, memory: list, watermark: int) -> int | None:
        memory[0] = memory[0][:, memory[0][0] > watermark - self.width_ms]
        return int(memory[0][0].min()) + self.width_ms if memory[0].size else None

    def dump(self, memory: list) -> bytes:
        return memory[0].tobytes()

    def load(self, data: bytes) -> list:
        return [np.frombuffer(data).reshape(5, -1).copy()]


# -- state that data close, not time ----------------------------------------------------------------------------------


def last_n_lists(averages: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The latest n day averages per key and slot of a stream, as a list for every change: days and averages, latest first.

    ``averages`` has keys, slot, day, average_load. State is one list of at most n entries per key and slot; a new day pushes
    the oldest out, wherever in the order it comes, and a day that is older than a full list changes nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in averages.schema.fields}
    group = [*keys, "slot"]
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in group), "newest int, days array<int>, averages array<double>"])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days, loads = (list(part) for part in state.get) if state.exists else ([], [])
        held = dict(zip(days, loads))
        before = dict(held)
        for frame in frames:
            held.update(zip(frame["day"].tolist(), frame["average_load"].tolist()))
            held = dict(sorted(held.items(), reverse=True)[:n])
        if held != before:
            state.update((list(held), list(held.values())))
            yield pd.DataFrame([[*key, max(held), list(held), list(held.values())]], columns=[*group, "newest", "days", "averages"])

    rows = averages.select(*group, F.col("day").cast("int").alias("day"), "average_load")
    state = "days array<int>, averages array<double>"
    return rows.groupBy(*group).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)


BATCH_SUMS = ["total", "weight", "readings_count"]


def punctuated_averages(rows: DataFrame, marker: str, order: str, keys: Sequence[str]) -> DataFrame:
    """Weighted averages of the batches that marker rows close: keys, batch_no, average_load, readings_count.

    ``rows`` is a stream of average_load, value_count, readings_count, the marker flag and an order (bigint). A marker closes
    what is open up to its place in the order; a batch is emitted when its marker comes and stays in state until then,
    for ever if none comes. Rows must come before their marker or with it; markers of a key in their order. Each task adds up its
    rows first, so a key's state function gets a few sums per micro-batch however many rows it has.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    columns = [*keys, "place", "closes", *BATCH_SUMS]
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby([*keys, "place", "closes"], as_index=False, dropna=False)[BATCH_SUMS].sum()[columns]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed, packed = state.get if state.exists else (0, pickle.dumps({}))
        open_sums: dict[int, list] = pickle.loads(packed)
        markers, found = [], []
        for frame in frames:
            for place, closes, *sums in frame[["place", "closes", *BATCH_SUMS]].itertuples(index=False, name=None):
                if closes:
                    markers.append(place)
                else:
                    open_sums[place] = [a + b for a, b in zip(open_sums.get(place, [0, 0, 0]), sums)]
        for place in sorted(markers):
            closed += 1
            parts = [open_sums.pop(p) for p in sorted(open_sums) if p <= place]
            total, weight, readings = (sum(p[k] for p in parts) for k in range(3))
            if parts:
                found.append([*key, closed, total / weight if weight else None, int(readings)])
        state.update((closed, pickle.dumps(open_sums)))
        if found:
            yield pd.DataFrame(found, columns=[*keys, "batch_no", "average_load", "readings_count"])

    weight = F.col("value_count")
    sums = rows.select(
        *keys, F.col(order).cast("long").alias("place"), F.col(marker).alias("closes"),
        F.coalesce(F.col("average_load") * weight, F.lit(0.0)).alias("total"), weight.cast("long").alias("weight"),
        F.col("readings_count").cast("long").alias("readings_count"),
    ).mapInPandas(combine, f"{head}, place bigint, closes boolean, total double, weight bigint, readings_count bigint")
    return sums.groupBy(*keys).applyInPandasWithState(
        run, f"{head}, batch_no bigint, average_load double, readings_count bigint", "closed bigint, open binary",
        "append", GroupStateTimeout.NoTimeout,
    )
