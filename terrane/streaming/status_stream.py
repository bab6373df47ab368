"""Status changes as a stream: the streaming form of ``status_revisions``.

:func:`status_changes` keeps a worker's state in Spark's state store and takes a worker's
rows of one micro-batch in one task. :class:`RevisionLog` runs the batch operator on each
micro-batch instead, which splits a worker's rows by time, for streams where one worker
may bring most of the events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrane.operators.status import INITIAL, carry_after, status_revisions

EVENT_SCHEMA = "ts timestamp, event_id bigint, worker_id string, status string"
REVISION_SCHEMA = "worker_id string, ts timestamp, event_id bigint, status string, revision bigint"
STATE_SCHEMA = "status string, revision bigint"


def read_events(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Status events arriving as Parquet files; the file limit bounds what one micro-batch holds."""
    reader = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def status_changes(events: DataFrame) -> DataFrame:
    """Events that change their worker's status, numbered per worker, across micro-batches.

    A worker's rows are ordered by (ts, event_id) inside a micro-batch; an event that
    arrives in a later one is taken in order of arrival. The state per worker is its last
    status and revision. Inside a micro-batch, repeats are found by comparison of whole
    columns, not row by row.
    """
    shaped = events.select("worker_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "status")
    return shaped.groupBy("worker_id").applyInPandasWithState(
        _keep_changes, REVISION_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def _keep_changes(
    key: tuple[str], chunks: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    last, revision = state.get if state.exists else (INITIAL, 0)
    rows = pd.concat(chunks, ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)
    before = rows["status"].shift(1)
    before.iloc[0] = last
    kept = rows[~(rows["status"].eq(before) | (rows["status"].isna() & before.isna()))].copy()
    kept["revision"] = range(revision + 1, revision + 1 + len(kept))
    state.update((rows["status"].iloc[-1], revision + len(kept)))
    yield kept[["worker_id", "ts", "event_id", "status", "revision"]]


class RevisionLog:
    """``foreachBatch`` target: revisions and the workers' standing, both per epoch.

    The standing after an epoch is made from the one before it and written under its own
    epoch, so an epoch that runs again after a failure writes the same rows again.
    """

    def __init__(self, path: str, bucket_seconds: int = 3600) -> None:
        self.path, self.bucket_seconds = path, bucket_seconds

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        carry = spark.read.parquet(f"{self.path}/standing/epoch={epoch - 1}") if epoch else None
        events = batch.select("ts", "event_id", "worker_id", "status").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            target = f"{self.path}/revisions/epoch={epoch}"
            status_revisions(events, self.bucket_seconds, carry).write.mode("overwrite").parquet(target)
            after = carry_after(events, spark.read.parquet(target), carry)
            after.write.mode("overwrite").parquet(f"{self.path}/standing/epoch={epoch}")
        finally:
            events.unpersist()

    def revisions(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/revisions").drop("epoch")
