"""Keys that share a state: the results of each are those of a key on its own."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plugload.schema import PLUG
from plugload.sources import sinks
from plugload.streaming import continuous as K, keyed
from tests.test_continuous import CONF, HOUR, LIVE, MINUTE, Source, closed, load, rounded


@pytest.fixture
def source(spark, readings, tmp_path):
    return Source(spark, readings, tmp_path / "in")


def many_plugs(n, parts):
    """Parts of readings of up to 120 plugs, some without house, household or number."""
    rng, rows = random.Random(4), []
    for i in range(n):
        t = LIVE + int(i / n * 3 * HOUR) // 1000 * 1000
        value = float("nan") if i % 11 == 0 else float(rng.randint(0, 9))
        rows.append((i, t, value, rng.choice([0, 1, None]), rng.choice([0, None]), rng.choice([*range(19), None]), 1))
    rows.sort(key=lambda r: r[1] + rng.random() * MINUTE)
    return [rows[k * n // parts : (k + 1) * n // parts] for k in range(parts)]


def test_many_plugs_share_few_states(source, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "BUCKETS", 3, raising=False)
    parts = many_plugs(900, 3)
    for part in parts:
        source.add(part)
        stream = K.plug_medians(source.stream(), CONF)
        query = sinks.write_results(stream, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
        query.awaitTermination()
    rows = [r for part in parts for r in part]
    want = {}
    for r in sorted(load(rows), key=lambda r: (r[1], r[0])):
        key = (*r[3:6], r[1])
        inside = [x[2] for x in rows if x[3:6] == r[3:6] and r[1] - CONF.window_ms < x[1] <= r[1] and x[2] == x[2]]
        if r[1] <= closed(rows) and key not in want:
            want[key] = (r[0], statistics.median(inside) if inside else None)
    got = spark.read.parquet(str(tmp_path / "out")).select(*PLUG, "ts_ms", "id", "median").collect()
    assert rounded((*k, *v) for k, v in want.items()) == rounded(map(tuple, got)) and len(got) > 700
    # 120 plugs; three states for each choice of what is null.
    assert len({r[3:6] for r in rows}) > 100
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 8


@pytest.mark.parametrize("idle, again", [(None, []), (HOUR, [(None, True)])])
def test_a_silent_plug_of_a_shared_state_is_forgotten(source, spark, tmp_path, monkeypatch, idle, again):
    monkeypatch.setattr(keyed, "BUCKETS", 1, raising=False)
    busy = [(i, LIVE + i * MINUTE, float(i % 2), 0, 0, 1, 1) for i in range(300)]
    silent = [(1000, LIVE, 9.0, 0, 0, 2, 1), (1001, LIVE + 230 * MINUTE, 9.0, 0, 0, 2, 1)]
    for part in (busy[:100] + silent[:1], busy[100:200], busy[200:] + silent[1:]):
        source.add(part)
        rows = K.loads(source.stream(), CONF).withColumn("global_median", F.lit(5.0))
        changes = keyed.in_event_order(rows, PLUG, keyed.FlagChanges(CONF.window_ms), idle)
        query = sinks.write_results(changes, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("plug_id = 2").orderBy("ts_ms").collect()
    assert [(r["previous_flag"], r["flag"]) for r in got] == [(None, True), *again]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
