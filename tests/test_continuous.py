"""Streams that answer every reading, against the batch plans and plain replays, over shuffled micro-batches with restarts."""

import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plugload.functions.ranks import RankedValues
from plugload.plans import outliers as O, predict as P
from plugload.schema import HOUSE, PLUG
from plugload.settings import Settings
from plugload.sources import sinks
from plugload.sources.readings import stream_readings
from plugload.streaming import continuous as K
from plugload.streaming.tables import Tables

MINUTE, HOUR = 60_000, 3_600_000
LIVE = 240 * HOUR
CONF = Settings(live_start_ms=LIVE, slice_ms=HOUR, window_ms=30 * MINUTE, watermark_ms=2 * MINUTE)


def shuffled(n, seed=1, parts=3, hours=4, start=LIVE):
    """Parts of readings of six plugs, one of them very busy; late by less than the watermark delay, with ties, null, NaN and work readings."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = start + int(i / n * hours * HOUR)
        t -= t % rng.choice([1, 1000])
        house, plug = rng.choice([(0, 0), (0, 0), (0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (2, 7)])
        value = rng.choice([float(rng.randint(0, 9)), rng.random() * 10, float("nan")]) if i % 13 else float("nan")
        rows.append((i, t, value, house, 0, plug, 0 if rng.random() < 0.1 else 1))
    rows.append((n, rows[-1][1] + 5 * MINUTE, 1.0, 0, 0, 0, 0))  # work, but it moves the watermark
    rows.sort(key=lambda r: r[1] + rng.random() * MINUTE)
    size = -(-len(rows) // parts)
    return [rows[k : k + size] for k in range(0, len(rows), size)]


def closed(rows):
    return max(r[1] for r in rows) - CONF.watermark_ms


def load(rows):
    return [r for r in rows if r[6] == 1]


class Source:
    """A folder that grows by parts."""

    def __init__(self, spark, readings, folder):
        self.spark, self.readings, self.folder = spark, readings, folder

    def add(self, rows):
        self.readings(rows).coalesce(1).write.mode("append").parquet(str(self.folder))

    def stream(self):
        return stream_readings(self.spark, str(self.folder))


@pytest.fixture
def source(spark, readings, tmp_path):
    return Source(spark, readings, tmp_path / "in")


def medians_of(source, tmp_path, conf, keys=()):
    folder = str(tmp_path / "medians")
    K.stream_sliding_median(source.stream(), list(keys), conf, folder, str(tmp_path / "s0"), available_now=True).awaitTermination()
    return Tables(source.spark, folder)


def rounded(rows, places=9):
    return sorted((tuple(round(v, places) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("conf", [CONF, replace(CONF, group_rows=20, block_rows=16, window_rows=50)])
@pytest.mark.parametrize("keys", [[], PLUG])
def test_sliding_medians_from_tables(source, readings, tmp_path, conf, keys):
    parts = shuffled(600)
    for part in parts:
        source.add(part)
        tables = medians_of(source, tmp_path, conf, keys)
    rows = [r for part in parts for r in part]
    plan = O.plug_median if keys else O.global_median
    want = plan(readings(rows), CONF).where(F.col("ts_ms") <= closed(rows))
    name = "plug_median" if keys else "global_median"
    schema = ", ".join([*(f"{k} int" for k in keys), "ts_ms bigint", f"{'median' if keys else name} double"])
    got = [tuple(r) for r in tables.all("medians", schema).collect()]
    assert rounded(got) == rounded(want.select(*keys, "ts_ms", name).collect()) and len(got) > 300
    # Only readings that later windows reach are kept.
    assert len(tables.batches("readings")) <= len(tables.batches("medians"))
    kept = tables.all("readings", "ts_ms bigint").agg(F.min("ts_ms")).first()[0]
    assert kept > closed(rows) - 3 * HOUR


def test_plug_medians_from_keyed_state(source, spark, readings, tmp_path):
    parts = shuffled(600)
    for part in parts:
        source.add(part)
        stream = K.plug_medians(source.stream(), CONF)
        sinks.write_results(stream, str(tmp_path / "out"), str(tmp_path / "s1"), available_now=True).awaitTermination()
    rows = [r for part in parts for r in part]
    got = spark.read.parquet(str(tmp_path / "out")).select(*PLUG, "ts_ms", "id", "median").collect()
    want = {}
    for r in sorted(load(rows), key=lambda r: (r[1], r[0])):
        key = (r[3], r[4], r[5], r[1])
        inside = [x[2] for x in load(rows) if x[3:6] == r[3:6] and r[1] - CONF.window_ms < x[1] <= r[1] and x[2] == x[2]]
        if r[1] <= closed(rows) and key not in want:
            want[key] = (r[0], statistics.median(inside) if inside else None)
    assert rounded((*k, *v) for k, v in want.items()) == rounded(map(tuple, got))


def run_changes(source, tmp_path, conf=CONF, idle_ms=None):
    medians = medians_of(source, tmp_path, conf).follow("medians", K.GLOBAL_MEDIAN)
    folder = str(tmp_path / "changes")
    K.stream_outlier_changes(source.stream(), medians, conf, folder, str(tmp_path / "s2"), available_now=True, log_every=10).awaitTermination()
    return Tables(source.spark, folder)


def replay(rows, upto):
    """Change events reading by reading: (id, ts, house, household, plug, percentage)."""
    rows = sorted((r for r in load(rows) if r[1] <= upto), key=lambda r: (r[1], r[0]))
    flags, found, seen = {}, [], set()
    for r in rows:
        t, key = r[1], r[3:6]
        if (key, t) in seen:
            continue
        seen.add((key, t))
        window = [x for x in rows if t - CONF.window_ms < x[1] <= t and x[2] == x[2]]
        own = [x[2] for x in window if x[3:6] == key]
        if not own:
            continue
        flag = statistics.median(own) > statistics.median(x[2] for x in window)
        if flags.get(key) != flag:
            flags[key] = flag
            house = [f for k, f in flags.items() if k[0] == key[0]]
            found.append((r[0], t, *key, 100.0 * sum(house) / len(house)))
    return found


@pytest.mark.parametrize("conf", [CONF, replace(CONF, group_rows=20, block_rows=16, window_rows=10)])
def test_outlier_changes_equal_a_replay(source, readings, tmp_path, conf):
    parts = shuffled(500, seed=3)
    for part in parts:
        source.add(part)
        tables = run_changes(source, tmp_path, conf)
    rows = [r for part in parts for r in part]
    want = replay(rows, closed(rows))
    got = tables.all("changes", K.CHANGES).select("id", "ts_ms", *PLUG, "percentage").collect()
    assert rounded(map(tuple, got)) == rounded(want) and len(want) > 30
    batch = O.q2a(readings(rows), CONF).where(F.col("ts_ms") <= closed(rows)).select("id", "ts_ms", *PLUG, "percentage")
    assert rounded(map(tuple, got)) == rounded(map(tuple, batch.collect()))
    # Delivery: counts are carried from batch to batch, every tenth row of the whole stream is logged.
    delivered = sorted(tables.all("delivered", "batch bigint, rows bigint, upto bigint, avg_latency_ms double, max_latency_ms bigint").collect())
    assert delivered[-1]["upto"] == len(want) == sum(r["rows"] for r in delivered)
    assert all(r["max_latency_ms"] >= r["avg_latency_ms"] >= 0 for r in delivered if r["rows"])
    log = sorted((r["row_no"], r["id"]) for r in tables.all("log", "row_no bigint, id bigint").collect())
    in_order = sorted(want, key=lambda r: (r[1], r[0]))
    assert log == [(k, in_order[k - 1][0]) for k in range(10, len(want) + 1, 10)]
    assert tables.batches("totals") == tables.batches("changes")[-2:]


def test_join_with_the_global_median(source, spark, readings, tmp_path):
    parts = shuffled(400, seed=5)
    for part in parts:
        source.add(part)
        medians = medians_of(source, tmp_path, CONF).follow("medians", K.GLOBAL_MEDIAN)
        stream = K.with_global_median(source.stream(), medians, CONF)
        query = sinks.write_results(stream, str(tmp_path / "out"), str(tmp_path / "s3"), available_now=True)
        query.awaitTermination()
    rows = [r for part in parts for r in part]
    want = O.with_global_median(readings(rows), CONF).where(F.col("ts_ms") <= closed(rows))
    columns = ["id", *PLUG, "ts_ms", "value", "global_median"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    assert rounded(map(tuple, got)) == rounded(map(tuple, want.select(*columns).collect())) and len(got) > 200
    # The state holds what the watermark has not passed: far less than what came.
    state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert state <= sum(r[1] > closed(rows) - 1 for r in load(rows)) + 5


@pytest.mark.parametrize("keys", [HOUSE, PLUG])
@pytest.mark.parametrize("conf", [CONF, replace(CONF, window_rows=5, block_rows=8)])
def test_prediction_per_reading(source, readings, tmp_path, keys, conf):
    """History from the archive, then from the stream itself; running averages go on over batches and restarts."""
    archive = [r for k in range(3) for part in shuffled(200, seed=20 + k, parts=1, hours=24, start=LIVE - (3 - k) * 24 * HOUR) for r in part[:-1]]
    archive = [(1_000_000 + i, *r[1:]) for i, r in enumerate(archive)]
    live = shuffled(1500, seed=9, parts=6, hours=60)
    folder = str(tmp_path / "out")
    K.prepare_partials(readings(archive), keys, conf, folder)
    for part in live:
        source.add(part)
        K.stream_predict_per_reading(source.stream(), keys, conf, folder, str(tmp_path / "s4"), available_now=True).awaitTermination()
    rows = [r for part in live for r in part]
    want = P.predict_per_reading(readings(archive + rows), keys, CONF).where(F.col("ts_ms") <= closed(rows))
    columns = ["id", *keys, "slice_idx", "time_slice", "readings_count", "current_load", "predicted_load"]
    tables = Tables(source.spark, folder)
    types = ", ".join(f"{k} int" for k in keys)
    schema = f"id bigint, {types}, slice_idx bigint, time_slice string, readings_count bigint, current_load double, predicted_load double"
    got = tables.all("predictions", schema).select(*columns).collect()
    assert rounded(map(tuple, got), 7) == rounded(map(tuple, want.select(*columns).collect()), 7) and len(got) > 200
    assert len(tables.batches("sums")) < len(tables.batches("predictions"))


def test_idle_keys_are_forgotten(source, spark, tmp_path):
    """With an age, a silent plug loses its state; results of the others do not change. Without, its flag stays."""
    busy = [(i, LIVE + i * MINUTE, float(i % 7), 0, 0, 1) for i in range(240)]
    silent = [(1000 + i, LIVE + i * MINUTE, 50.0, 0, 0, 2) for i in range(3)]
    counts, results = {}, {}
    for name, idle in (("kept", None), ("aged", HOUR)):
        folder = Source(spark, source.readings, tmp_path / name)
        for part in (busy[:5] + silent, busy[5:120], busy[120:]):
            folder.add(part)
            stream = K.plug_medians(folder.stream(), CONF, idle_ms=idle)
            query = sinks.write_results(stream, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-s"), available_now=True)
            query.awaitTermination()
        counts[name] = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        results[name] = sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{name}-out")).collect()))
    assert counts == {"kept": 2, "aged": 1} and results["kept"] == results["aged"]


def test_late_readings_are_dropped_and_repeated_ones_counted(source, spark, tmp_path):
    source.add([(1, LIVE, 1.0, 0, 0, 0), (1, LIVE, 1.0, 0, 0, 0), (2, LIVE + 5, 4.0, 0, 0, 0), (3, LIVE + HOUR, 7.0, 0, 0, 0)])
    medians_of(source, tmp_path, CONF)
    source.add([(4, LIVE + 4, 100.0, 0, 0, 0), (5, LIVE + HOUR - MINUTE, 9.0, 0, 0, 0), (6, LIVE + 3 * HOUR, 1.0, 0, 0, 0)])
    tables = medians_of(source, tmp_path, CONF)
    got = sorted(map(tuple, tables.all("medians", K.GLOBAL_MEDIAN).collect()))
    assert got == [(LIVE, 1.0), (LIVE + 5, 1.0), (LIVE + HOUR - MINUTE, 9.0), (LIVE + HOUR, 8.0)]


def test_a_batch_is_published_once(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    first = tables.publish("t", 3, spark.range(4))
    again = tables.publish("t", 3, spark.range(9))
    assert first.count() == again.count() == tables.all("t", "id bigint").count() == 4
    assert tables.read("t", [1, 2], "id bigint").count() == 0 and tables.batches("t") == [3]


def test_ranked_values():
    rng, plain, ranked = random.Random(0), [], RankedValues()
    for step in range(20_000):
        if plain and rng.random() < 0.4:
            value = plain.pop(rng.randrange(len(plain)))
            ranked.remove(value)
        else:
            value = rng.choice([float(rng.randint(0, 50)), rng.random()])
            plain.append(value)
            ranked.insert(value)
        if step % 500 == 0:
            ranked = RankedValues.load(ranked.dump())
            plain.sort()
            assert len(ranked) == len(plain) and [ranked.at(k) for k in range(len(plain))] == plain
            assert ranked.median() == (statistics.median(plain) if plain else None)
    with pytest.raises(KeyError):
        ranked.remove(1e9)
    with pytest.raises(IndexError):
        ranked.at(len(ranked))
