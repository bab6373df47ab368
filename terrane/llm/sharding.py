"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers that depend on their values alone; a keyed permutation of
``0 .. rows - 1`` shuffles the numbers, and shard and slot follow from the permuted number by
division. Whoever knows (rows, shards, seed) can compute where a row number lies.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import buckets_for, without

ROUNDS = 6
COPIES_A_BLOCK = 65_536


def sides(rows: int) -> tuple[int, int]:
    """Two factors whose product is at least ``rows`` and exceeds it by less than the first factor."""
    left = isqrt(max(0, rows - 1)) + 1
    return left, max(1, -(-rows // left))


def feistel(number: str, rows: int, seed: int) -> str:
    """SQL for one pass over ``number`` in 0 .. left * right - 1: a bijection, as every round only adds to one side."""
    left, right = sides(rows)
    state = f"named_struct('l', {number} div {right}L, 'r', {number} % {right}L)"
    step = (
        "if(i % 2 = 0, "
        f"named_struct('l', (s.l + pmod(xxhash64({seed}, i, s.r), {left}L)) % {left}L, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + pmod(xxhash64({seed}, i, s.l), {right}L)) % {right}L))"
    )
    return f"aggregate(sequence(1, {ROUNDS}), {state}, (s, i) -> {step}, s -> s.l * {right}L + s.r)"


def permuted(number: str, rows: int, seed: int) -> str:
    """SQL for the place of ``number`` in a permutation of 0 .. rows - 1.

    Places at or past ``rows`` walk on along their cycle. The domain has fewer than ``left`` such
    places, so that many further steps suffice; only the few rows that need them take them.
    """
    left, right = sides(rows)
    spare = left * right - rows
    once = feistel(number, rows, seed)
    again = f"aggregate(sequence(1, {spare}), x, (y, _k) -> if(y < {rows}L, y, {feistel('y', rows, seed)}))"
    walk = f"if(x < {rows}L, x, {again})" if spare else "x"
    return f"element_at(transform(array({once}), x -> {walk}), 1)"


def number_rows(df: DataFrame, order_by: Sequence[str], rows: int, name: str) -> DataFrame:
    """Add gapless row numbers from 0 that depend on the rows' values alone.

    Rows are numbered inside hash buckets of ``order_by``, in the order of these columns and then of all
    others. Equal rows are counted first and spread out again at the end, so copies make no hot bucket.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    first = [F.col(f"`{c}`") for c in order_by]
    rest = [F.col(f"`{c}`") for c in df.columns if c not in order_by]
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__copies"))
    dealt = counted.withColumn("__bucket", F.pmod(F.xxhash64(*first), F.lit(buckets_for(rows))))
    inside = W.partitionBy("__bucket").orderBy(*first, *rest).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = (
        dealt.groupBy("__bucket")
        .agg(F.sum("__copies").alias("__size"))
        .select("__bucket", F.coalesce(F.sum("__size").over(earlier), zero).alias("__earlier"))
    )
    block = F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / COPIES_A_BLOCK))
    low = F.col("__block") * COPIES_A_BLOCK
    high = F.least(low + COPIES_A_BLOCK, F.col("__copies")) - 1
    return (
        dealt.withColumn("__inside", F.coalesce(F.sum("__copies").over(inside), zero))
        .join(F.broadcast(offsets), "__bucket")  # one row a bucket, at most one for each million rows
        .withColumn("__block", F.explode(block))
        .withColumn("__copy", F.explode(F.sequence(low, high)))
        .withColumn(name, F.col("__earlier") + F.col("__inside") + F.col("__copy"))
        .select(*columns, name)
    )


def shard_rows(df: DataFrame, order_by: Sequence[str], shards: int = 16, seed: int = 7) -> DataFrame:
    """Add ``row_number``, ``position``, ``shard`` and ``slot``; row counts of shards differ by one at most.

    The result does not depend on how the input is partitioned. Null values and repeated rows are rows like
    others (copies differ in their numbers only). An empty table stays empty. Input columns of these
    four names are replaced. Columns must be of types that can be compared.
    """
    plain = without(df, "row_number", "position", "shard", "slot")
    rows = plain.count()
    numbered = number_rows(plain, order_by, rows, "row_number")
    placed = numbered.withColumn("position", F.expr(permuted("row_number", max(rows, 1), seed)))
    return placed.withColumns(
        {"shard": (F.col("position") % shards).cast("int"), "slot": F.expr(f"position div {shards}L")}
    )
