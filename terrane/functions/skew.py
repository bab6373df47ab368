"""Work on keys of which one may hold a third of all rows, planned without running anything.

Which keys are hot is told by a sketch of bounded size that is part of the plan (a scalar subquery), so building a plan starts
no job, and what every task gets to know stays small. The sketch decides layout only: results are the same whatever it finds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.columns import col, orderable

DEFAULT_CELL_ITEMS = 100_000
# A join key with more rows than this on either side is split over several tasks.
JOIN_KEY_ROWS = 1_000_000
# The sketch keeps so many counters and reports at most so many keys.
SKETCH_COUNTERS = 10_000
HOT_KEYS = 50
# A hot key is dealt to at most so many tasks.
MOST_SHARES = 256
# Sampled rows of a hot key for each border between its shares.
SAMPLES_A_SHARE = 8
# Parts of different shares are numbered this far apart.
PARTS_A_SHARE = 1_000_000


def hot_keys(df: DataFrame, item: Column, limit: int) -> Column:
    """Map from the values of ``item`` with more than ``limit`` rows to (shares, rows); a lazy value with at most ``HOT_KEYS`` entries.

    ``item`` is a bigint or a string and is counted by a frequent-items sketch: keys with more than about a
    ten-thousandth of all rows are found for certain, others need no splitting. A null item is not counted.
    """
    named = df.select(item.alias("item")).where("item is not null")
    top = named.agg(F.expr(f"approx_top_k(item, {HOT_KEYS}, {SKETCH_COUNTERS})").alias("top"))
    shares = f"cast(least({MOST_SHARES}, ceil(2 * t.count / {limit})) as int)"
    entries = f"transform(filter(top, t -> t.count > {limit}), t -> struct(t.item, struct({shares} as shares, t.count as rows)))"
    return top.select(F.expr(f"map_from_entries({entries})").alias("hot")).scalar()


def nothing_hot(item: str) -> Column:
    """The map of a table known to hold no hot key."""
    return F.expr(f"cast(map() as map<{item}, struct<shares: int, rows: bigint>>)")


def spread_hot_keys(
    left: DataFrame, right: DataFrame, key: str, left_hot: Column, right_hot: Column
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a left join on a bigint ``key`` and the columns to join on, with hot keys of either side split up.

    The maps come from :func:`hot_keys`. Rows of a key that is hot on one side are dealt to shares there and repeated for each
    share on the other; hot on both sides, they form a grid. Every pair of rows meets once. Shares are told from the
    row and its partition number, so copies of a row spread too and a task that runs again deals the same way. A
    left row of a key that is hot on the right finds no partner in some shares: :func:`join_spread` takes these rows out.
    """

    def shares(hot: Column) -> Column:
        return F.coalesce(hot[col(key)]["shares"], F.lit(1))

    def dealt(df: DataFrame, parts: Column) -> Column:
        row = [col(f.name) for f in df.schema.fields if orderable(f.dataType)]
        return F.when(parts > 1, F.pmod(F.xxhash64(*row, F.spark_partition_id()), parts).cast("int")).otherwise(0)

    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    wide, deep = shares(left_hot), shares(right_hot)
    right = right.where(col(key).isNotNull())
    slotted = left.withColumn("__wide", dealt(left, wide)).select("*", every(deep).alias("__deep"))
    repeated = right.withColumn("__deep", dealt(right, deep)).select("*", every(wide).alias("__wide"))
    return slotted, repeated, [key, "__wide", "__deep"]


def join_spread(left: DataFrame, right: DataFrame, key: str, left_hot: Column, right_hot: Column) -> DataFrame:
    """LEFT JOIN on ``key`` with hot keys of either side split up."""
    slotted, repeated, keys = spread_hot_keys(left, right, key, left_hot, right_hot)
    joined = slotted.join(repeated.withColumn("__met", F.lit(True)), keys, "left")
    # A key of the right's sketch is there for certain, so each of its left rows is met in another share.
    alone = F.col("__met").isNull() & (F.coalesce(right_hot[col(key)]["shares"], F.lit(1)) > 1)
    return joined.where(~alone).drop("__met", "__wide", "__deep")


def collect_in_parts(
    df: DataFrame,
    keys: Sequence[str],
    limit: int = DEFAULT_CELL_ITEMS,
    items: str = "items",
    part: str = "PART",
    item: Column | None = None,
) -> DataFrame:
    """(keys, part, items): sorted arrays of ``item``, at most ``limit`` long, each a run of the key's order.

    ``item`` is a struct of the columns of ``df`` other than the keys (default: all of them), and ``items`` is in its
    order, nulls first. Parts are in order too: all items of a part come before those of a higher one. Numbers of
    parts rise from 0 and may leave gaps. A key with up to ``limit`` rows has the single part 0, unless the sketch overrates
    it, which takes a table of some 10,000 times ``limit`` rows.

    A hot key is cut by value into shares, at borders read from a sample of its rows (each with a random number, so that
    copies are cut as well), and its shares are sorted by different tasks. Where borders lie decides the sizes of
    parts only. Nothing is dropped.
    """
    fields = [c for c in df.columns if c not in keys]
    key_cols = [col(k) for k in keys]
    item = F.struct(*[col(f) for f in fields]) if item is None else item
    hashed = F.xxhash64(*key_cols)
    # An ordinary key in a table of any size stays in one share; only what exceeds a cell is looked at.
    hot = hot_keys(df, hashed, limit)
    place = F.struct(item.alias("item"), F.xxhash64(F.spark_partition_id(), F.monotonically_increasing_id()).alias("chance"))

    known = df.withColumn("__hot", hot[hashed]).where("__hot is not null")
    every = F.greatest(F.lit(1), F.floor(F.col("__hot.rows") / (F.col("__hot.shares") * SAMPLES_A_SHARE)))
    sampled = known.select(hashed.alias("key"), "__hot", place.alias("place"), every.alias("every")).where(F.pmod(F.col("place.chance"), F.col("every")) == 0)
    gathered = sampled.groupBy("key").agg(F.first("__hot.shares").alias("shares"), F.array_sort(F.collect_list("place")).alias("places"))
    step = F.greatest(F.lit(1), F.floor(F.size("places") / F.col("shares"))).cast("int")
    gathered = gathered.withColumn("step", step)
    cut = gathered.select(F.struct("key", F.expr("filter(places, (p, i) -> (i + 1) % step = 0)")).alias("entry"))
    borders = cut.agg(F.map_from_entries(F.collect_list("entry")).alias("borders")).scalar()

    of_key = borders[hashed]
    before = F.size(F.filter(F.col("__borders"), lambda b: b < F.col("__place")))
    shared = df.withColumns({"__borders": of_key})
    shared = shared.withColumn("__place", F.when(F.col("__borders").isNotNull(), place))
    shared = shared.withColumn("__share", F.when(F.col("__borders").isNull(), 0).otherwise(before)).drop("__borders", "__place")

    # Rows are shuffled as they are: lists do not shrink in a map-side combine.
    together = shared.repartition(*key_cols, "__share").select(*key_cols, "__share", item.alias("__item"))
    nth = F.row_number().over(W.partitionBy(*key_cols, "__share").orderBy("__item"))
    numbered = together.withColumn("__part", (F.col("__share") * PARTS_A_SHARE + F.floor((nth - 1) / limit)).cast("int"))
    listed = numbered.groupBy(*key_cols, "__share", "__part").agg(F.sort_array(F.collect_list("__item")).alias(items))
    return listed.select(*key_cols, F.col("__part").alias(part), items)
