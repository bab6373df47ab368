import datetime
import random

import pytest
from pyspark.sql import functions as F

from terrane.operators import status
from terrane.streaming.status_stream import RevisionLog, read_events, status_changes

EVENTS = "ts timestamp_ntz, event_id bigint, worker_id string, status string"
START = datetime.datetime(2024, 1, 1)


def random_events(count, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        # One worker has most of the events.
        worker = "G0_0" if rng.random() < 0.6 else f"G{rng.randint(1, 3)}_{rng.randint(1, 9)}"
        moment = START + datetime.timedelta(seconds=rng.randint(0, 4000))
        rows.append((moment, i, worker, rng.choice(["IDLE", "FAILED", "COMPLETED", None])))
    return rows


def brute_force(rows):
    last, revision, kept = {}, {}, []
    for ts, event, worker, state in sorted(rows, key=lambda r: (r[0], r[1])):
        if last.get(worker, "IDLE") != state:
            revision[worker] = revision.get(worker, 0) + 1
            kept.append((worker, ts, event, state, revision[worker]))
        last[worker] = state
    return sorted(kept, key=lambda r: r[2])


@pytest.mark.parametrize("bucket", [1, 60, 3600, 10**6])
def test_revisions_by_any_bucket(spark, bucket):
    rows = random_events(500)
    df = spark.createDataFrame(rows, EVENTS).repartition(5)
    found = sorted((tuple(r) for r in status.status_revisions(df, bucket).collect()), key=lambda r: r[2])
    assert found == brute_force(rows)


def test_hot_worker_is_windowed_in_pieces(spark):
    plan = status.status_revisions(spark.createDataFrame(random_events(10), EVENTS))._jdf.queryExecution().toString()
    assert "hashpartitioning(worker_id" in plan and "bucket" in plan


def written_events(spark, path):
    rows = sorted(random_events(400, seed=9), key=lambda r: (r[0], r[1]))
    for i in range(4):
        part = spark.createDataFrame(rows[i * 100 : (i + 1) * 100], EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
        part.coalesce(1).write.mode("append").parquet(path)
    return [(w, e, s, r) for w, _, e, s, r in brute_force(rows)]


def test_stream_equals_batch(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    expected = written_events(spark, source)
    query = (
        status_changes(read_events(spark, source, max_files_per_trigger=1))
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", str(tmp_path / "check"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    found = spark.read.parquet(sink).select("worker_id", "event_id", "status", "revision").collect()
    assert sorted(map(tuple, found), key=lambda r: r[1]) == expected


def test_stream_by_batches_splits_hot_workers_and_can_be_repeated(spark, tmp_path):
    source = str(tmp_path / "in")
    expected = written_events(spark, source)
    log = RevisionLog(str(tmp_path / "log"), bucket_seconds=100)
    query = (
        read_events(spark, source, max_files_per_trigger=1)
        .writeStream.foreachBatch(log)
        .option("checkpointLocation", str(tmp_path / "check"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(180)

    def found():
        rows = log.revisions(spark).select("worker_id", "event_id", "status", "revision").collect()
        return sorted(map(tuple, rows), key=lambda r: r[1])

    assert found() == expected
    files = sorted(spark.read.parquet(source).selectExpr("_metadata.file_path f", "ts").groupBy("f").agg(F.min("ts")).collect(), key=lambda r: r[1])
    log(spark.read.parquet(files[3][0]), 3)
    assert found() == expected


def test_current_progress_and_groups(spark):
    rows = [
        (START, 1, "A_1_7", "IN_PROGRESS"),
        (START, 2, "A_1_7", "COMPLETED"),
        (START, 3, "A_1_8", "FAILED"),
        (START + datetime.timedelta(1), 4, "A_1_2", "EXPORTING_FILE"),
    ]
    df = spark.createDataFrame(rows, EVENTS)
    assert {tuple(r) for r in status.current_status(df).collect()} == {
        ("A_1_7", "COMPLETED"),
        ("A_1_8", "FAILED"),
        ("A_1_2", "EXPORTING_FILE"),
    }
    assert [tuple(r) for r in status.downloads_per_group(df).collect()] == [("A_1", 3, "A_1_7")]
    assert status.session_downloads(df).head()[0] == 3
    workers = spark.createDataFrame(
        [("w1", "COMPLETED", START, None), ("w2", "FAILED", START, 100.0), ("w3", "IDLE", START, 10.0), ("w4", "IDLE", START, 0.0), ("w5", "x", START, None)],
        "worker_id string, status string, started_at timestamp_ntz, estimated_seconds double",
    )
    moment = F.lit("2024-01-01 00:00:50").cast("timestamp_ntz")
    found = {r["worker_id"]: (r["status_text"], r["percent"]) for r in status.export_progress(workers, moment).collect()}
    assert found == {
        "w1": ("Export completed", 100.0),
        "w2": ("Export failed", 50.0),
        "w3": ("Waiting to start", 99.0),
        "w4": ("Waiting to start", None),
        "w5": (None, None),
    }
    assert len(status.STATUS_TEXT) == 16
