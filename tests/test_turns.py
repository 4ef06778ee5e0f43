"""A table that is streamed in turns gives what it gives as one micro-batch."""

import datetime as dt
import random

import __spark_entry__ as registered
from plugload.streaming import continuous as K, tables

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(n):
    rng, start = random.Random(3), dt.datetime(2024, 1, 23)
    rows = [
        (i, start + dt.timedelta(seconds=rng.randint(0, 6 * 3600)), rng.randint(0, 100),
         rng.choice(["view", "view", "error"]), rng.choice([float(rng.randint(0, 9)), float("nan"), None]), "")
        for i in range(n)
    ]
    return rows + rows[:20] + [(n, None, 1, "view", 1.0, "")]


def test_changes_in_turns(spark, tmp_path, monkeypatch):
    spark.createDataFrame(events(600), EVENTS).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    seen = []
    start = K.stream_outlier_changes
    monkeypatch.setattr(K, "stream_outlier_changes", lambda *a, **k: seen.append(start(*a, **k)) or seen[-1])
    found = []
    for rows in (10_000, 200):
        monkeypatch.setattr(registered, "TURN_ROWS", rows, raising=False)
        found.append(sorted(map(repr, registered.queries()["stream_q2a_changes"](spark, str(tmp_path)).collect())))
    assert found[0] == found[1] and len(found[0]) > 50
    taken = [[p["sources"][0]["numInputRows"] for p in query.recentProgress] for query in seen]
    assert max(taken[0]) == 621 and sum(taken[1]) == 621 and max(taken[1]) < 400 and sum(n > 0 for n in taken[1]) >= 3


def test_files_are_taken_in_the_order_of_their_turns(spark, tmp_path):
    rows = spark.range(0, 60, 1, 3).selectExpr("id", "cast(11 - id div 5 as int) as turn").repartition(4, "turn")
    assert tables.write_turns(rows, "turn", str(tmp_path / "turns"))
    got = []
    query = tables.follow_turns(spark, str(tmp_path / "turns"), "id bigint").writeStream.foreachBatch(
        lambda batch, _: got.append(sorted(r["id"] for r in batch.collect()))
    ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert got == [list(range(5 * k, 5 * k + 5)) for k in reversed(range(12))]
