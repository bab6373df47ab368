"""Export status events: changes per worker, current state, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The export states and the text shown for each.
STATUS_TEXT = {
    "IDLE": "Waiting to start",
    "MISSING": "Missing",
    "UNKNOWN": "Unknown",
    "IN_PROGRESS": "In progress",
    "FETCHING_TABLES": "Fetching tables",
    "FETCHING_TERRITORY": "Fetching territory table",
    "FETCHING_NAMES": "Fetching names",
    "FETCHING_GEOMETRY": "Fetching geometry",
    "FETCHING_NDM": "Fetching NDM data",
    "JOINING_TABLES": "Joining datasets",
    "CONVERTING_GEOMETRY": "Converting geometry",
    "EXPORTING_FILE": "Writing output file",
    "FINALIZING": "Finalizing export",
    "COMPLETED": "Export completed",
    "FAILED": "Export failed",
    "CANCELLED": "Export cancelled",
}
INITIAL = "IDLE"


def status_revisions(
    events: DataFrame, bucket_seconds: int = 3600, carry: DataFrame | None = None
) -> DataFrame:
    """Events that change their worker's status, numbered 1, 2, 3, ... per worker.

    ``carry`` (worker_id, status, revision) is where each worker stood before these events.

    ``events`` has ts, event_id, worker_id and status; a worker starts out IDLE. A worker
    may hold most of the events, so none is sorted in one piece: rows are windowed per
    (worker, time bucket), and only one summary row per bucket meets in the worker's own
    window, giving each bucket the status it starts from and the revisions before it.
    """
    cut = events.select("ts", "event_id", "worker_id", "status", bucket_of(F.col("ts"), bucket_seconds).alias("bucket"))
    local = bucket_changes(cut)
    offsets = bucket_offsets(bucket_summaries(local), carry)
    kept = local.join(offsets, ["worker_id", "bucket"]).filter(
        F.col("__change") | ((F.col("__place") == 1) & F.col("__entry"))
    )
    return kept.select(
        "worker_id",
        "ts",
        "event_id",
        "status",
        (F.col("__offset") + F.col("__local") + F.col("__entry").cast("long")).alias("revision"),
    )


def bucket_of(ts: Column, bucket_seconds: int) -> Column:
    """Number of the time bucket an event falls into."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(bucket_seconds * 1_000_000))


def bucket_changes(cut: DataFrame) -> DataFrame:
    """Events with their place in (worker, bucket), whether they change the status there, and the changes so far."""
    inside = W.partitionBy("worker_id", "bucket").orderBy("ts", "event_id")
    # Inside a bucket the first row has nothing before it; it is judged against the bucket before.
    return (
        cut.withColumn("__place", F.row_number().over(inside))
        .withColumn("__change", (F.col("__place") > 1) & ~F.lag("status").over(inside).eqNullSafe(F.col("status")))
        .withColumn("__local", F.sum(F.col("__change").cast("long")).over(inside))
    )


def bucket_summaries(local: DataFrame) -> DataFrame:
    """First and last status and number of changes of each (worker, bucket)."""
    order = F.struct("ts", "event_id")
    return local.groupBy("worker_id", "bucket").agg(
        F.min_by("status", order).alias("__first"),
        F.max_by("status", order).alias("__last"),
        F.max("__local").alias("__changes"),
    )


def bucket_offsets(summary: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """Whether the first event of each bucket changes the status (``__entry``), and the revisions before it (``__offset``)."""
    worker = W.partitionBy("worker_id").orderBy("bucket")
    before = worker.rowsBetween(W.unboundedPreceding, -1)
    if carry is None:
        start = F.struct(F.lit(INITIAL).alias("status"), F.lit(0).cast("bigint").alias("revision"))
        summary = summary.withColumn("__start", start)
    else:
        known = carry.select("worker_id", F.struct("status", F.col("revision").cast("bigint").alias("revision")).alias("__carry"))
        fresh = F.struct(F.lit(INITIAL).alias("status"), F.lit(0).cast("bigint").alias("revision"))
        summary = summary.join(known, "worker_id", "left").withColumn("__start", F.coalesce("__carry", fresh))
    # A status may be null, so the one before is looked at as a struct: no struct means no bucket before.
    previous = F.lag(F.struct(F.col("__last").alias("status"))).over(worker)
    entering = F.when(previous.isNull(), F.col("__start.status")).otherwise(previous["status"])
    earlier = F.sum(F.col("__changes") + F.col("__entry").cast("long")).over(before)
    return (
        summary.withColumn("__entry", ~entering.eqNullSafe(F.col("__first")))
        .withColumn("__offset", F.coalesce(earlier, F.lit(0)) + F.col("__start.revision"))
        .select("worker_id", "bucket", "__entry", "__offset")
    )


def carry_after(events: DataFrame, revisions: DataFrame, carry: DataFrame | None = None) -> DataFrame:
    """(worker_id, status, revision) after ``events``, whose revisions are given."""
    numbered = revisions.groupBy("worker_id").agg(F.max("revision").alias("__revision"))
    latest = current_status(events).select("worker_id", F.struct("status").alias("__latest"))
    moved = latest.join(numbered, "worker_id", "left")
    if carry is None:
        return moved.select("worker_id", "__latest.status", F.coalesce("__revision", F.lit(0)).cast("bigint").alias("revision"))
    both = carry.withColumnRenamed("status", "__before").join(moved, "worker_id", "full")
    status = F.when(F.col("__latest").isNull(), F.col("__before")).otherwise(F.col("__latest.status"))
    revision = F.coalesce("__revision", "revision", F.lit(0)).cast("bigint")
    return both.select("worker_id", status.alias("status"), revision.alias("revision"))


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per worker."""
    return events.groupBy("worker_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def status_text(status: Column) -> Column:
    pairs = [F.lit(x) for item in STATUS_TEXT.items() for x in item]
    return F.create_map(*pairs)[status]


def progress_percent(status: Column, elapsed: Column, estimated: Column) -> Column:
    """Percent of the estimate that has passed, at most 99 until the export is complete.

    Null where the estimate is missing or not positive.
    """
    return F.when(status == "COMPLETED", F.lit(100.0)).when(
        estimated > 0, F.least(elapsed / estimated * 100, F.lit(99.0))
    )


def group_of_worker(worker_id: Column) -> Column:
    """Group key of a worker id, which is the group key, an underscore and a sequence."""
    return F.regexp_replace(worker_id, "_[^_]*$", "")


def export_progress(workers: DataFrame, as_of: Column) -> DataFrame:
    """Progress of each worker at ``as_of``.

    ``workers`` has worker_id, status, started_at and estimated_seconds.
    """
    elapsed = F.timestamp_diff("MICROSECOND", F.col("started_at"), as_of) / F.lit(1e6)
    return workers.select(
        "worker_id",
        "status",
        status_text(F.col("status")).alias("status_text"),
        progress_percent(F.col("status"), elapsed, F.col("estimated_seconds")).alias("percent"),
    )


def downloads_per_group(events: DataFrame) -> DataFrame:
    """Workers ever started per group key and the oldest one, which speaks for the group."""
    workers = events.groupBy("worker_id").agg(F.min(F.struct("ts", "event_id")).alias("__start"))
    return workers.groupBy(group_of_worker(F.col("worker_id")).alias("group_key")).agg(
        F.count(F.lit(1)).alias("downloads"),
        F.min_by("worker_id", F.struct("__start", "worker_id")).alias("first_worker"),
    )


def session_downloads(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct("worker_id").alias("downloads"))
