"""Streams end where the batch does."""

import datetime as dt

from pyspark.sql import functions as F

from attesta.streaming import ingest

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_continuous_upsert_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(EVENTS).select("user_id", "event_id", "event_type", "value")
    for i in range(3):
        rows.where(F.col("event_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    source = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    for _ in range(2):  # a second run finds nothing new
        ingest.continuous_upsert(source(), str(tmp_path / "out"), str(tmp_path / "check"), "user_id", "event_id").awaitTermination(120)
    number, state = ingest.state_of(spark, str(tmp_path / "out"), "user_id", "event_id")
    assert number == 2
    want = ingest.merged(None, rows, "user_id", "event_id")
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, want.collect()))


def test_bytes_written_follow_the_batch(spark, tmp_path):
    """Small batches onto a large state write small deltas; compaction comes when they have grown, and changes nothing."""
    path = str(tmp_path)
    rows = lambda a, b, v: spark.range(a, b).select("id", F.lit(v).alias("v"))
    size = lambda: sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    ingest.write_delta(rows(0, 20000, 0), path, 0, "id", "v")
    assert ingest.compact(spark, path, "id", "v")
    large = size()
    for n in (1, 2):
        before = size()
        assert ingest.write_delta(rows(0, 10 * n, n), path, n, "id", "v") and not ingest.write_delta(rows(0, 5, 9), path, n, "id", "v")
        assert size() - before < large / 5
        assert not ingest.compact(spark, path, "id", "v")
    number, state = ingest.state_of(spark, path, "id", "v")
    want = sorted(map(tuple, state.collect()))
    assert number == 2 and len(want) == 20000 and sum(v == 2 for _, v in want) == 20
    assert ingest.compact(spark, path, "id", "v", share=0) and sorted(map(tuple, ingest.state_of(spark, path, "id", "v")[1].collect())) == want


def test_repeats_within_the_watermark_go(spark, tmp_path):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "k", "h") for m in (0, 5, 9)] + [(dt.datetime(2024, 1, 1), "k", "other")], "ts timestamp, k string, h string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.without_repeats(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", ["k", "h"])
    q = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.h for r in spark.table("once").collect()) == ["h", "other"]


def test_late_rows_are_flagged(spark):
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 5)), (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1, 0, 6)), (None, dt.datetime(2024, 1, 1))], "e timestamp, a timestamp")
    assert [r.late for r in ingest.flag_late(rows, "e", "a", 300).collect()] == [False, True, True]
