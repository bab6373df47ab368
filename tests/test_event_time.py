import datetime

import pytest
from pyspark.sql import functions as F

from terrane.streaming import event_time
from terrane.streaming.status_stream import read_events
from tests.test_status import EVENTS, START, brute_force, random_events


def streamed(spark, folder, parts, **options):
    """Pages of a stream that gets each part of ``parts`` in a micro-batch of its own, in order."""
    source, sink, check = (str(folder / x) for x in ("in", "pages", "check"))
    for part in parts:
        df = spark.createDataFrame(part, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(source)
        pages = event_time.status_pages(read_events(spark, source, max_files_per_trigger=1), **options)
        query = event_time.write_pages(pages, sink, check, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.schema(event_time.PAGE_SCHEMA).parquet(sink)


def numbered(pages):
    rows = event_time.revisions(pages).select("worker_id", "event_id", "status", "revision").collect()
    return sorted(map(tuple, rows), key=lambda r: r[1])


def expected(rows):
    return [(w, e, s, r) for w, _, e, s, r in brute_force(rows)]


def test_shuffled_micro_batches_equal_batch(spark, tmp_path):
    # 60 % of the events are of one worker; the parts come in no order of time.
    rows = random_events(400, seed=11)
    pages = streamed(spark, tmp_path, [rows[:150], rows[150:300], rows[300:]], bucket_seconds=500, delay="2 hours")
    assert numbered(pages) == expected(rows)
    assert {r["kind"] for r in pages.select("kind").distinct().collect()} == {"open"}


def test_events_behind_the_watermark_correct_closed_buckets(spark, tmp_path):
    rows = sorted(random_events(300, seed=12), key=lambda r: r[0])
    late, on_time = rows[20:40] + rows[100:120], rows[:20] + rows[40:100] + rows[120:]
    pages = streamed(spark, tmp_path, [on_time, late], bucket_seconds=200, delay="1 second")
    kinds = {r["kind"]: r["n"] for r in pages.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["late"] > 0 and kinds["closed"] > 0
    assert numbered(pages) == expected(rows)


def test_closed_buckets_only_and_events_without_time(spark, tmp_path):
    rows = [(START + datetime.timedelta(seconds=s), i, "A_1", f"S{i % 3}") for i, s in enumerate([5, 1, 30, 130])]
    pages = streamed(spark, tmp_path, [[*rows, (None, 9, "A_1", "IDLE"), (None, 8, None, None)]], bucket_seconds=60, delay="0 seconds", early=False)
    # The bucket of the newest event is still open and has no page yet.
    assert numbered(pages) == [("A_1", 0, "S0", 2), ("A_1", 1, "S1", 1), ("A_1", 2, "S2", 3), (None, 8, None, 1)]


def test_no_pages_no_revisions(spark):
    assert event_time.revisions(spark.createDataFrame([], event_time.PAGE_SCHEMA)).count() == 0


@pytest.mark.parametrize("setting", [None, "x.Provider"])
def test_store_setting_is_put_back(spark, tmp_path, setting):
    key, before = event_time.STORE_SETTING, spark.conf.get(event_time.STORE_SETTING, None)
    spark.conf.set(key, setting) if setting else spark.conf.unset(key)
    try:
        rows = random_events(10)
        spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
        pages = event_time.status_pages(read_events(spark, str(tmp_path / "in")))
        query = event_time.write_pages(pages, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
        after = spark.conf.get(key, None)
        query.awaitTermination(120)
        assert query.exception() is None
        assert after == setting or (setting is None and "HDFS" in str(after))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_workers_of_a_share_make_one_state_and_page(spark, tmp_path):
    # One event a worker and bucket, as in a wide table: calls and states grow with the events, not with the workers.
    rows = [(START + datetime.timedelta(seconds=i % 50), i, f"A_{i}", "IDLE" if i % 5 else "FAILED") for i in range(200)]
    frame = spark.createDataFrame(rows, EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    assert event_time.shares_for(frame, 86400) == 1
    pages = streamed(spark, tmp_path, [rows], bucket_seconds=86400, shares=1)
    assert [tuple(r) for r in pages.select("share", "kind", "events").distinct().collect()] == [(0, "open", 200)]
    assert numbered(pages) == expected(rows)


def test_null_ids_and_ids_beyond_floats_come_back(spark, tmp_path):
    at = [START + datetime.timedelta(seconds=s) for s in range(4)]
    rows = [(at[0], 2**60 + 1, "A_1", "X"), (at[1], None, "A_1", None), (at[2], 2**60 + 3, None, "Y"), (at[1], 2**60 + 5, "A_1", "Z")]
    pages = streamed(spark, tmp_path, [rows], bucket_seconds=60)
    found = event_time.revisions(pages).select("worker_id", "event_id", "status", "revision").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [("A_1", 2**60 + 1, "X", 1), ("A_1", None, None, 2), ("A_1", 2**60 + 5, "Z", 3), (None, 2**60 + 3, "Y", 1)], key=str
    )
