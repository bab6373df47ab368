"""Row numbers over a whole table without sorting it in one task.

Rows go to as many buckets as the session has shuffle partitions, so that buckets follow the size a cluster is set up for. A
bucket is a range of the order; its rows are numbered by themselves and the sizes of earlier buckets are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.columns import col, places_before

# Keys sampled for each border between two buckets.
SAMPLES_A_BUCKET = 16


def bucket_count(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def rank_in_buckets(df: DataFrame, order: Sequence[str], bucket: str) -> DataFrame:
    """Add ``rank`` (from 1) by ``order`` and ``total``, given a column that rises with the order.

    Rows are ranked inside their bucket, in parallel; the number of rows in earlier
    buckets is added from a table with one row per bucket.
    """
    inside = W.partitionBy(bucket).orderBy(*order)
    earlier = W.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("__size"))
    offsets = sizes.select(
        bucket,
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__size").over(W.partitionBy()).alias("total"),
    )
    return (
        df.withColumn("__place", F.row_number().over(inside))
        .join(F.broadcast(offsets), bucket)
        .withColumn("rank", F.col("__before") + F.col("__place"))
        .drop(bucket, "__before", "__place")
    )


def shuffled_rank(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rank in the order of a seeded digest of ``key``: a shuffle that any engine can repeat.

    The digest is spread evenly, so its leading bits cut the order into equal buckets, two to four for each shuffle partition.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    bits = bucket_count(df).bit_length() + 1
    hashed = df.withColumn("__hash", F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")).withColumn(
        "__bucket", F.shiftright("__hash", 60 - bits)
    )
    return rank_in_buckets(hashed, ["__hash", key], "__bucket").drop("__hash")


def borders(df: DataFrame, key: str, buckets: int) -> Column:
    """Keys that cut the order into about even buckets, a lazy value.

    They come from the keys with the smallest hashes, a sample of fixed size that the data alone decide: whoever evaluates this
    again gets the same borders. A key with many copies weighs as much as they do.
    """
    hashed = df.select(col(key).alias("key")).where("key is not null").withColumn("hash", F.xxhash64("key"))
    sample = hashed.orderBy("hash", "key").limit(SAMPLES_A_BUCKET * buckets)
    held = sample.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    step = f"greatest(1, cast(size(keys) / {buckets} as int))"
    return held.select(F.expr(f"array_distinct(filter(keys, (k, i) -> (i + 1) % {step} = 0))").alias("borders")).scalar()


def ordered_rank(df: DataFrame, key: str) -> DataFrame:
    """Rank in the order of a key, nulls first, by ranges between sampled borders."""
    split = df.withColumn("__borders", borders(df, key, bucket_count(df)))
    bucket = places_before("__borders", col(key), strict=True)
    return rank_in_buckets(split.withColumn("__bucket", bucket).drop("__borders"), [key], "__bucket")


def shuffled_folds(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Add ``fold`` 0..k-1 by dealing the shuffled rows round; sizes differ by one at most."""
    ranked = shuffled_rank(df, key, seed)
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "total")


def contiguous_folds(df: DataFrame, key: str, k: int) -> DataFrame:
    """Add ``fold`` 0..k-1 as k runs of the key order; the first n mod k runs have one row more."""
    size = F.floor(F.col("total") / k)
    longer = F.col("total") % k
    place = F.col("rank") - 1
    in_longer = place < longer * (size + 1)
    fold = F.when(in_longer, F.floor(place / (size + 1))).otherwise(
        longer + F.floor((place - longer * (size + 1)) / F.greatest(size, F.lit(1)))
    )
    return ordered_rank(df, key).withColumn("fold", fold.cast("int")).drop("rank", "total")
