import pytest
from pyspark.sql import functions as F

from plugload.operators import archive as A
from plugload.plans.outliers import grid_outliers
from plugload.plans.predict import predict
from plugload.schema import HOUSE, PLUG, READING
from plugload.settings import Settings
from plugload.sources import sinks
from plugload.sources.readings import read_readings, slice_rows, stream_readings
from plugload.streaming import queries as S

HOUR = 3_600_000
LIVE = 240 * HOUR
CONF = Settings(live_start_ms=LIVE, slice_ms=HOUR, window_ms=2 * HOUR, watermark_ms=60_000)


def series(first, hours, start_id=0, step=11 * 60_000):
    rows, i = [], start_id
    for t in range(LIVE + first * HOUR, LIVE + (first + hours) * HOUR, step):
        for plug in range(3):
            rows.append((i, t + plug, (i * 37) % 101, plug % 2, 0, plug))
            i += 1
    return rows


def write(df, folder):
    df.coalesce(1).write.mode("append").parquet(str(folder))


def test_restart_gives_batch_result_once(spark, readings, tmp_path):
    """Two runs from the same state over files that arrive in between: same windows as one batch, none twice."""
    parts = [series(0, 6), series(6, 6, 10_000)]
    state, out, src = str(tmp_path / "state"), str(tmp_path / "out"), tmp_path / "in"
    for rows in parts:
        write(readings(rows), src)
        S.stream_outliers(stream_readings(spark, str(src)), HOUR, CONF, out, state, available_now=True).awaitTermination()
    everything = readings([r for rows in parts for r in rows])
    newest = max(r[1] for rows in parts for r in rows)
    want = grid_outliers(everything, HOUR, CONF).where(F.col("window_end") <= newest - CONF.watermark_ms)
    columns = [*PLUG, "window_end", "flag", "above_count", "plug_count", "percentage"]
    got = spark.read.parquet(f"{out}/changes").select(*columns).collect()
    assert len(got) > 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.select(*columns).collect()))


def test_late_readings(spark, readings, tmp_path):
    """Out of order within the watermark counts, beyond it is dropped."""
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    S.prepare_history(readings([(900, LIVE + 2 * HOUR - 24 * HOUR, 50, 0, 0, 0)]), HOUSE, CONF, out)
    run = lambda: S.stream_prediction(
        stream_readings(spark, str(src)), HOUSE, CONF, out, state, available_now=True
    ).awaitTermination()
    write(readings([(1, LIVE, 10, 0, 0, 0), (2, LIVE + HOUR + 30_000, 99, 0, 0, 0)]), src)
    run()
    # The watermark stands 30 s before the end of slice 0: still open.
    write(readings([(3, LIVE + 5, 20, 0, 0, 0), (4, LIVE + 2 * HOUR, 1, 0, 0, 0)]), src)
    run()
    write(readings([(5, LIVE + 6, 1000, 0, 0, 0), (6, LIVE + 3 * HOUR, 1, 0, 0, 0)]), src)
    run()
    got = {r.slice_idx: (r.current_load, r.predicted_load) for r in spark.read.parquet(f"{out}/predictions").collect()}
    assert got == {0: (15.0, 32.5)}


@pytest.mark.parametrize("keys", [HOUSE, PLUG])
def test_prediction_equals_batch(spark, readings, tmp_path, keys):
    """History from the archive and, after a day, from slices closed in earlier runs of the stream."""
    parts = [series(-48, 30, 100_000), series(-18, 30), series(12, 20, 10_000), series(32, 20, 20_000)]
    everything = [r for rows in parts for r in rows]
    src, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    S.prepare_history(readings(everything), keys, CONF, out)
    for rows in parts:
        write(readings(rows), src)
        S.stream_prediction(stream_readings(spark, str(src)), keys, CONF, out, state, available_now=True).awaitTermination()
    newest = max(r[1] for r in everything)
    want = predict(readings(everything), keys, CONF).where(f"(slice_idx + 1) * {HOUR} + {LIVE} <= {newest - CONF.watermark_ms}")
    columns = [*keys, "slice_idx", "readings_count", "time_slice", "history_median", "predicted_load"]
    key = lambda rows: sorted((*r[:-2], round(r[-2], 9), round(r[-1], 9)) for r in rows)
    got = spark.read.parquet(f"{out}/predictions").select(*columns).collect()
    assert max(r.slice_idx for r in got) >= 48
    assert key(got) == key(want.select(*columns).collect())


def test_persisted_stream_is_archive(spark, readings, tmp_path):
    src, out, state = tmp_path / "in", str(tmp_path / "archive"), str(tmp_path / "state")
    for part in (series(0, 30), series(30, 5, 50_000)):
        write(readings(part), src)
        sinks.persist_readings(stream_readings(spark, str(src)), out, state, available_now=True).awaitTermination()
    archive = read_readings(spark, out)
    assert archive.columns[:7] == READING.fieldNames() and archive.count() == len(series(0, 30)) + len(series(30, 5))
    assert spark.read.parquet(out).select("day").distinct().count() == 2
    got = A.plug_slices(slice_rows(archive, CONF), CONF)
    want = A.plug_slices(slice_rows(readings(series(0, 30) + series(30, 5, 50_000)), CONF), CONF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_result_metrics_of_a_stream(spark, readings, tmp_path):
    src = tmp_path / "in"
    write(readings(series(0, 2)), src)
    listener = sinks.ResultMetrics()
    spark.streams.addListener(listener)
    try:
        rows = stream_readings(spark, str(src)).withColumnRenamed("ts_ms", "eval_ms")
        seen = sinks.observed(sinks.with_latency(rows), "results", "latency_ms")
        query = sinks.write_results(seen, str(tmp_path / "out"), str(tmp_path / "state"), available_now=True)
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    seen = [m["results"] for _, m in listener.batches if "results" in m]
    assert sum(m["rows"] for m in seen) == len(series(0, 2)) and all(m["max_latency_ms"] > 0 for m in seen)
