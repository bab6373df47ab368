"""Status changes as a stream in event time: late events go to their place.

The stream keeps its state by (time bucket, share of the workers), so workers with an event or two a bucket do not make a state
each, and the events of one busy worker are spread over buckets. It writes *pages*: the changes of each worker inside one
bucket and share, written anew whenever events of these come in. Revision numbers are not in the pages, as one late event
moves all later numbers of its worker; :func:`revisions` adds them from one summary row a worker and bucket. Read at any moment,
the pages give what the batch operator gives for the events so far.

When the watermark passes the end of a bucket a timer writes its last pages, which hold all its events, and drops the
state. Events that come later still are written as ``late`` pages, and :func:`revisions` puts them in their place; so the
watermark bounds the state and drops nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from terrane.operators.status import bucket_changes, bucket_of, bucket_offsets, bucket_summaries

#: Keyed state with timers lives in this store; a session that runs ``status_pages`` must name it.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE_SETTING = "spark.sql.streaming.stateStore.providerClass"

#: A page has a row for each event that it shows. ``kept``: the worker's first event in the bucket, and those that change its
#: status there, with ``local`` changes so far. The first one also has the last status and all changes.
PAGE_SCHEMA = """
    bucket bigint, share int, kind string, events bigint, worker_id string, micros bigint, event_id bigint, status string,
    kept boolean, local bigint, last_status string, changes bigint
"""
#: Workers are dealt to so many shares, if not told otherwise; ``shares_for`` aims at so many events a bucket and share.
SHARES = 64
EVENTS_A_SHARE = 4_096

#: Events in the state, one value for those of a micro-batch. ``unnamed`` marks a null id: a column of integers and nulls
#: would pass through floats.
_HELD = pa.schema([("worker_id", pa.string()), ("micros", pa.int64()), ("event_id", pa.int64()), ("unnamed", pa.bool_()), ("status", pa.string())])
_PACK = pa.ipc.IpcWriteOptions(compression="lz4")


def _packed(events: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(events[_HELD.names], schema=_HELD, preserve_index=False)
    with pa.ipc.new_stream(sink, _HELD, options=_PACK) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(held).read_pandas()


class SharePages(StatefulProcessor):
    """Pages of one (bucket, share of workers); the state holds its events until the watermark passes the bucket's end."""

    def __init__(self, bucket_seconds: int, early: bool) -> None:
        self.bucket_ms, self.early = bucket_seconds * 1000, early

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "held binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([batch[_HELD.names] for batch in rows], ignore_index=True)
        bucket = None if key[0] is None or key[0] != key[0] else int(key[0])
        open_before = self.events.exists()
        end = None if bucket is None else (bucket + 1) * self.bucket_ms
        if not open_before and end is not None and end <= timerValues.getCurrentWatermarkInMs():
            yield self._page(bucket, key[1], "late", fresh)
            return
        known = self._held() if open_before and (self.early or end is None) else []
        self.events.appendList([(_packed(fresh),)])
        if not open_before and end is not None:
            self.handle.registerTimer(end)
        if self.early or end is None:
            yield self._page(bucket, key[1], "open", pd.concat([*known, fresh], ignore_index=True))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        page = self._page(int(key[0]), key[1], "closed", pd.concat(self._held(), ignore_index=True))
        self.events.clear()
        yield page

    def close(self) -> None:
        pass

    def _held(self) -> list[pd.DataFrame]:
        return [_unpacked(bytes(held[0])) for held in self.events.get()]

    @staticmethod
    def _page(bucket: int | None, share: int, kind: str, events: pd.DataFrame) -> pd.DataFrame:
        worker, status = (pd.factorize(events[c])[0] for c in ("worker_id", "status"))
        # Nulls come first, as in the order of a table.
        named = ~events["unnamed"].to_numpy(bool)
        order = np.lexsort((events["event_id"].to_numpy(), named, events["micros"].to_numpy(), worker))
        rows, worker, status = events.iloc[order].reset_index(drop=True), worker[order], status[order]
        first = np.append(True, worker[1:] != worker[:-1])
        change = ~first & np.append(False, status[1:] != status[:-1])
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(rows)) - 1
        so_far = np.cumsum(change)
        local = so_far - np.repeat(so_far[begins], ends - begins + 1)
        last_status = np.full(len(rows), None, dtype=object)
        last_status[begins] = rows["status"].to_numpy(object)[ends]
        changes = np.zeros(len(rows), dtype=np.int64)
        changes[begins] = local[ends]
        untimed = np.full(len(rows), bucket is None)
        page = pd.DataFrame(
            {
                "bucket": pd.array([bucket] * len(rows), dtype="Int64"),
                "share": np.int32(share),
                "kind": kind,
                "events": len(rows),
                "worker_id": rows["worker_id"],
                "micros": pd.arrays.IntegerArray(rows["micros"].to_numpy(np.int64), untimed),
                "event_id": pd.arrays.IntegerArray(rows["event_id"].to_numpy(np.int64), rows["unnamed"].to_numpy(bool)),
                "status": rows["status"],
                "kept": first | change,
                "local": local,
                "last_status": last_status,
                "changes": pd.arrays.IntegerArray(changes, ~first),
            }
        )
        return page[page["kept"]] if kind == "open" else page


def shares_for(events: DataFrame, bucket_seconds: int) -> int:
    """How many shares leave about EVENTS_A_SHARE events to each in the largest time bucket of ``events``."""
    buckets = events.groupBy(bucket_of(F.col("ts"), bucket_seconds).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return max(1, -(-(buckets.agg(F.max("n")).head()[0] or 0) // EVENTS_A_SHARE))


def status_pages(
    events: DataFrame, bucket_seconds: int = 3600, delay: str = "1 hour", early: bool = True, shares: int = SHARES
) -> DataFrame:
    """Pages of a stream of status events (ts, event_id, worker_id, status), in append mode.

    ``delay`` is how far the watermark stays behind the newest event; it bounds the state, not what is counted. The events of
    a bucket and share meet in one task: ``bucket_seconds`` and ``shares`` set how many those are; both stay the same as long as a
    stream goes on. With ``early=False`` a bucket is written once only, when the watermark has passed it. Events without a time
    stay open for good and are ordered first.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # The time travels as a number: without the column that carries the watermark, no row counts as too late.
    zero = F.lit(0).cast("long")
    shaped = timed.select(
        bucket_of(F.col("ts"), bucket_seconds).alias("bucket"),
        F.pmod(F.xxhash64("worker_id"), F.lit(shares)).cast("int").alias("share"),
        "worker_id",
        F.coalesce(F.unix_micros("ts"), zero).alias("micros"),
        F.coalesce(F.col("event_id").cast("long"), zero).alias("event_id"),
        F.col("event_id").isNull().alias("unnamed"),
        "status",
    )
    return shaped.groupBy("bucket", "share").transformWithStateInPandas(
        SharePages(bucket_seconds, early), PAGE_SCHEMA, "Append", "EventTime"
    )


def write_pages(pages: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start writing pages to Parquet; the file sink commits each micro-batch once, also after a failure."""
    spark = pages.sparkSession
    before = spark.conf.get(STORE_SETTING, None)
    spark.conf.set(STORE_SETTING, STORE)
    try:
        writer = pages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        # A query keeps the settings it was started with.
        spark.conf.set(STORE_SETTING, before) if before else spark.conf.unset(STORE_SETTING)


def revisions(pages: DataFrame) -> DataFrame:
    """(worker_id, ts, event_id, status, revision) of all events in ``pages``, as ``status_revisions`` numbers them.

    The newest page of a bucket and share holds the changes inside it. Only workers and buckets with late events are ordered
    again, from the events that their last page holds.
    """
    key = ["worker_id", "bucket"]
    on_time, late = pages.withColumn("closed", F.col("kind") == "closed").filter("kind <> 'late'"), pages.filter("kind = 'late'")
    newest = on_time.groupBy("bucket", "share").agg(F.max(F.struct("closed", "events")).alias("newest"))
    newest = newest.select("bucket", "share", "newest.*").toDF("__bucket", "__share", "__closed", "__events")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("bucket", "share", "closed", "events")]
    marked = late.select(*key).distinct().toDF("__worker_id", "__of").withColumn("__late", F.lit(True))
    hit = [F.col("worker_id").eqNullSafe(F.col("__worker_id")), F.col("bucket").eqNullSafe(F.col("__of"))]
    split = on_time.join(newest, same).join(marked, hit, "left")

    settled = split.filter("__late is null and kept")
    summaries = settled.filter("changes is not null").select(
        *key, F.col("status").alias("__first"), F.col("last_status").alias("__last"), F.col("changes").alias("__changes")
    )
    event = ["micros", "event_id", "status"]
    kept = settled.select(*key, *event, F.col("local").alias("__local"))

    again = split.filter("__late").select(*key, *event).unionByName(late.select(*key, *event))
    local = bucket_changes(again.withColumnRenamed("micros", "ts"))
    summaries = summaries.unionByName(bucket_summaries(local))
    changed = local.filter("__change or __place = 1").withColumnRenamed("ts", "micros")
    kept = kept.unionByName(changed.select(*kept.columns))

    offsets = bucket_offsets(summaries)
    same = [kept[c].eqNullSafe(offsets[c]) for c in key]
    numbered = kept.join(offsets, same).filter((F.col("__local") > 0) | F.col("__entry"))
    return numbered.select(
        kept["worker_id"],
        F.timestamp_micros("micros").alias("ts"),
        "event_id",
        "status",
        (F.col("__offset") + F.col("__local") + F.col("__entry").cast("long")).alias("revision"),
    )
