import json
import os
import random

import pandas as pd
from pyspark.sql import functions as F

from millrace.streaming import limits, progress


def line(**k):
    return progress.MARKER + json.dumps(k)


def test_stream_equals_table(spark, tmp_path):
    lines = [line(stage="reading", state="done", ms=5, page=1, page_complete=True), "noise", line(stage="unknown", state="done", ms=1), line(stage="reading", state="done", ms=9, page=2, page_complete=True), line(stage="building", state="running")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "job7.txt").write_text("\n".join(lines))
    query = progress.state(progress.from_files(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    got = {(r.job_id, r.stage): (r.ms, r.pages_done) for r in spark.table("progress").collect()}
    table = progress.state(spark.createDataFrame([("job7", x) for x in lines], "job_id string, line string"))
    assert got == {(r.job_id, r.stage): (r.ms, r.pages_done) for r in table.collect()} == {("job7", "reading"): (9, 2), ("job7", "building"): (None, None)}


def test_refused_hits_are_not_recorded(spark):
    events = spark.createDataFrame(pd.DataFrame({"key": 1, "event_id": range(6), "ms": [0, 10, 20, 99, 100, 111]}))
    got = limits.rate_limited(events, most=2, window_ms=100).orderBy("event_id").collect()
    assert [r.accepted for r in got] == [True, True, False, False, True, True]


def test_stream_of_limits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pd.DataFrame({"key": 1, "event_id": range(4), "ms": [0, 10, 20, 200]}).to_json(tmp_path / "in" / "a.json", orient="records", lines=True)
    events = spark.readStream.schema("key long, event_id long, ms long").json(str(tmp_path / "in"))
    query = limits.rate_limited_stream(events, 2, 100).writeStream.format("memory").queryName("limits").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted((r.event_id, r.accepted) for r in spark.table("limits").collect()) == [(0, True), (1, True), (2, False), (3, True)]


def test_lockout(spark):
    events = spark.createDataFrame(pd.DataFrame({"key": 1, "event_id": range(7), "ms": [0, 1, 2, 3, 50, 103, 104], "failed": [True, True, False, True, True, True, False]}))
    got = limits.lockouts(events, failures=2, lock_ms=50).orderBy("event_id").collect()
    assert [r.locked for r in got] == [False, False, True, True, True, False, False]  # locked at 1 until 51
    assert [r["count"] for r in got] == [1, 0, 0, 0, 0, 1, 0]
    events = spark.createDataFrame(pd.DataFrame({"key": 1, "event_id": range(4), "ms": [0, 50, 51, 99], "failed": [True, True, False, True]}))
    assert [r.locked for r in limits.lockouts(events, 1, 50).orderBy("event_id").collect()] == [False, False, True, True]


def test_stream_of_lockouts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = pd.DataFrame({"key": [1, 1, 1, 1, 2], "event_id": range(5), "ms": [0, 1, 2, 60, 3], "failed": [True, True, False, True, True]})
    rows.to_json(tmp_path / "in" / "a.json", orient="records", lines=True)
    events = spark.readStream.schema("key long, event_id long, ms long, failed boolean").json(str(tmp_path / "in"))
    query = limits.lockouts_stream(events, 2, 50).writeStream.format("memory").queryName("locks").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    assert sorted((r.event_id, r.locked, r["count"]) for r in spark.table("locks").collect()) == [(0, False, 1), (1, False, 0), (2, True, 0), (3, False, 1), (4, False, 1)]


def test_folds_carry_a_key_over_batches(spark):
    n = 30_000
    events = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).cast("long").alias("key"), F.col("id").alias("event_id"), F.col("id").alias("ms"))
    got = limits.rate_limited(events, most=2, window_ms=1000).toPandas().sort_values("event_id")
    hits: dict = {}
    want = [limits.take(hits.setdefault(i % 7 if i % 3 == 0 else None, []), i, 2, 1000) for i in range(n)]
    assert got["accepted"].tolist() == want
    assert limits.lockouts(events.limit(0).withColumn("failed", F.lit(True))).count() == 0


def ordered(spark, tmp_path, name, batches, stream, schema):
    """What a stream gives whose batches come one by one, and the states that are left."""
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        path = tmp_path / "in" / f"{i:03d}.json"
        rows.to_json(path, orient="records", lines=True)
        os.utime(path, (1_000_000 + i, 1_000_000 + i))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream(events).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination()
    return spark.table(name).collect(), query.lastProgress["stateOperators"][0]["numRowsTotal"]


def mixed(n, keys, late):
    """Events whose order in the batches differs from their time by less than ``late`` ms, and a last one of another key."""
    rng = random.Random(n)
    rows = [{"key": rng.randint(1, keys), "event_id": i, "ms": 100_000 + 20 * i, "failed": rng.random() < 0.7} for i in range(n)]
    shuffled = sorted(rows, key=lambda r: r["ms"] + rng.uniform(0, late))
    end = [{"key": 99, "event_id": n + k, "ms": 10_000_000 + 1_000_000 * k, "failed": False} for k in range(2)]
    cut = len(rows) // 4
    parts = [shuffled[i : i + cut] for i in range(0, n, cut)] + [[e] for e in end]
    return pd.DataFrame(rows), [pd.DataFrame(p) for p in parts]


def test_limits_of_late_and_mixed_batches_equal_the_table(spark, tmp_path):
    table, batches = mixed(80, 3, 300)
    got, left = ordered(spark, tmp_path, "ordered_limits", batches, lambda e: limits.rate_limited_stream(e, 2, 200, delay="1 second"), "key long, event_id long, ms long")
    want = limits.rate_limited(spark.createDataFrame(table), 2, 200).collect()
    assert sorted((r.event_id, r.accepted) for r in got if r.key < 99) == sorted((r.event_id, r.accepted) for r in want)
    assert 0 < sum(not r.accepted for r in want) < 80 and left <= 1  # the keys' states are gone, but for the last event's


def test_lockouts_of_late_and_mixed_batches_equal_the_table(spark, tmp_path):
    table, batches = mixed(80, 3, 300)
    got, left = ordered(spark, tmp_path, "ordered_locks", batches, lambda e: limits.lockouts_stream(e, 3, 150, delay="1 second"), "key long, event_id long, ms long, failed boolean")
    want = limits.lockouts(spark.createDataFrame(table), 3, 150).collect()
    as_rows = lambda rows: sorted((r.event_id, r.locked, r["count"]) for r in rows if r.key < 99)
    open_ = {r.key: r["count"] for r in sorted(want, key=lambda r: r.event_id)}
    assert as_rows(got) == as_rows(want) and any(r.locked for r in want) and left <= 1 + sum(c > 0 for c in open_.values())
