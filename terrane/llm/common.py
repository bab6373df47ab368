"""Small helpers that several operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_A_BUCKET = 1_000_000
LEAST_BUCKETS = 1_024


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def whole_text(column: str = "text") -> Column:
    """The text, empty if null."""
    return F.coalesce(F.col(column), F.lit(""))


def buckets_for(rows: int) -> int:
    """A power of two that grows with the rows: one bucket a million rows, 1,024 at least."""
    return max(LEAST_BUCKETS, 1 << max(0, rows // ROWS_A_BUCKET).bit_length())


def running_total(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], amount: str, bucket: str, before: str
) -> DataFrame:
    """Add ``before``: the sum of ``amount`` over the earlier rows of the same group.

    ``bucket`` must rise with the order. Rows are summed inside their bucket, in parallel, and
    the sums of earlier buckets (one small row each) are added, so no group meets in one task.
    """
    inside = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("__of_bucket"))
    offsets = sums.select(*group, bucket, F.coalesce(F.sum("__of_bucket").over(earlier), zero).alias("__earlier"))
    return (
        df.withColumn("__inside", F.coalesce(F.sum(amount).over(inside), zero))
        .join(offsets, [*group, bucket])
        .withColumn(before, F.col("__earlier") + F.col("__inside"))
        .drop("__earlier", "__inside")
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the session's checkpoint folder; one is set only where the session has none, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, its lineage cut and its shuffle files gone."""
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more: what was made of it is written too."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0]).getParent() if table.inputFiles() else None
    if path is not None:
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (columns ``a`` and ``b``, long): rows (``node``, ``component``), the smallest node.

    Large-star and small-star steps: each node's links are moved to the smallest node it knows until
    nothing changes. Every step is written to the shared folder. No links give no rows.
    """
    edges = written(links.select("a", "b").where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: larger neighbours of a node are linked to the smallest of its neighbourhood.
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of these.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("least"))
        moved = down.join(lowest, "a").select(F.col("b").alias("x"), "least").where("x <> least")
        small = moved.unionByName(lowest.select(F.col("a").alias("x"), "least")).select(F.col("x").alias("a"), F.col("least").alias("b"))
        older, edges = edges, written(small.distinct())
        dropped(older)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = nodes.select(F.col("component").alias("node"), "component")
    return nodes.unionByName(roots).distinct()
