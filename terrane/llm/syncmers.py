"""Document fingerprints from closed syncmers over words.

A k-mer of words is an anchor when the smallest of its inner s-mers (by hash) is its first or last
one. The choice depends on the k-mer alone, so a passage keeps its anchors wherever it stands. In a short text it may be
that no k-mer is one; its anchor is then the k-mer of smallest hash, so only texts without words have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import without

K, S = 5, 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """32-bit hashes of the anchors of a text in order of place; a text of fewer than k words is one k-mer.

    Where no k-mer of a text is an anchor, its k-mer of smallest hash is taken.
    """
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"\s+")
    hashed = F.transform(words, lambda w: F.hash(w))

    def picked(h: Column, inner: Column) -> Column:
        def at_edge(i: Column) -> Column:
            smallest = F.least(*[F.get(inner, i + j) for j in range(k - s + 1)])
            return smallest.isin(F.get(inner, i), F.get(inner, i + (k - s)))

        places = F.sequence(F.lit(0), F.size(h) - k)
        made = lambda held: F.transform(held, lambda i: F.hash(*[F.get(h, i + j) for j in range(k)]))
        return _let(
            F.filter(places, at_edge), lambda kept: F.when(F.size(kept) == 0, F.array(F.array_min(made(places)))).otherwise(made(kept))
        )

    def chosen(h: Column) -> Column:
        if s == 1:
            found = picked(h, h)
        else:
            places = F.sequence(F.lit(0), F.size(h) - s)
            inner = F.transform(places, lambda i: F.hash(*[F.get(h, i + j) for j in range(s)]))
            found = _let(inner, lambda m: picked(h, m))
        return F.when(F.size(h) < k, F.array(F.hash(h))).otherwise(found)

    bare = F.btrim(text, F.lit(" \t\n\x0b\f\r")) == ""
    return F.when(bare, F.array().cast("array<int>")).otherwise(_let(hashed, chosen))


def printed(found: Column) -> Column:
    """The anchors as text, in order."""
    return F.array_join(found.cast("array<string>"), " ")


def likeness(a: Column, b: Column) -> Column:
    """Twice the shared distinct anchors over the distinct anchors of both; 1 if both have none, as only texts without words do."""
    total = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


ROWS_A_RANGE = 250
MOST_RANGES = 8_192


def _constants(values: list) -> Column:
    return F.expr("array(" + ", ".join("cast(null as bigint)" if v is None else f"{int(v)}L" for v in values) + ")")


def range_cuts(df: DataFrame, key: str, rows: int) -> list[int]:
    """Approximate quantiles of ``key``; their number follows the rows up to MOST_RANGES."""
    parts = min(MOST_RANGES, max(1, rows // ROWS_A_RANGE))
    if parts == 1:
        return []
    return sorted({int(c) for c in df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)})


def range_of(key: str, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, by bisection in a constant array; null keys come before all."""
    if not cuts:
        return F.lit(0)
    held = _constants(cuts)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(x: Column, _: Column) -> Column:
        middle = F.floor((x["lo"] + x["hi"]) / 2).cast("int")
        up = (x["lo"] < x["hi"]) & (F.get(held, middle) <= F.col(key))
        return F.struct(
            F.when(up, middle + 1).otherwise(x["lo"]).alias("lo"), F.when(up, x["hi"]).otherwise(middle).alias("hi")
        )

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, step, lambda x: x["lo"]))


def with_next(df: DataFrame, key: str, value: str, derived: dict[str, Column]) -> DataFrame:
    """Add ``next_<value>``, the value of the next row in descending order of ``key``; after the last comes the first.

    ``derived`` columns are computed once a row and get a ``next_`` column too. Rows are cut into ranges of the
    key. Only the first row of each range crosses a border: it goes to its own range and, as a lender, to
    the one above. Ties go by value; null keys come last. The next row of a single row is itself.
    """
    df = df.select(F.col(key).cast("long").alias(key), value)
    ranged = df.withColumn("__range", range_of(key, range_cuts(df.select(key), key, df.count())))
    # One row a range, MOST_RANGES at most.
    tops = sorted((r[0], r[1]) for r in ranged.groupBy("__range").agg(F.max(key)).collect())
    if not tops:
        tops = [(0, None)]
    highest, above = [None] * (tops[-1][0] + 1), [0] * (tops[-1][0] + 1)
    for i, (number, top) in enumerate(tops):
        highest[number], above[number] = top, tops[(i + 1) % len(tops)][0]
    lends = F.get(_constants(highest), F.col("__range")).eqNullSafe(F.col(key))
    seat = lambda number, lender: F.struct(number.cast("int").alias("range"), F.lit(lender).alias("lender"))
    own, lent = seat(F.col("__range"), 0), seat(F.get(_constants(above), F.col("__range")), 1)
    seated = ranged.withColumn("__seat", F.explode(F.when(lends, F.array(own, lent)).otherwise(F.array(own))))
    w = W.partitionBy("__range").orderBy("__lender", F.col(key).desc_nulls_last(), value)
    dealt = seated.select(key, value, F.col("__seat.range").alias("__range"), F.col("__seat.lender").alias("__lender"))
    followed = dealt.withColumn(f"next_{value}", F.lead(value).over(w)).withColumns(derived)
    for name in derived:
        followed = followed.withColumn(f"next_{name}", F.lead(name).over(w))
    return followed.where("__lender = 0").drop("__range", "__lender")


def fingerprints(df: DataFrame, text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Add ``anchors`` (array of int) and ``fingerprint`` (string). Null and blank texts have none, all others at least one; equal texts have equal ones.

    Input columns of these two names are replaced.
    """
    plain = without(df, "anchors", "fingerprint")
    return plain.withColumn("anchors", anchors(F.coalesce(F.col(text), F.lit("")), k, s)).withColumn(
        "fingerprint", printed(F.col("anchors"))
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the start of the following one."""
    n = F.length(text)
    m = F.floor(n / 3).cast("int")
    return F.concat(F.left(text, n - m), F.left(following, m))


def compare_with_edit_and_next(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, s: int = S) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and the likeness to that and to the next row's."""
    whole = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    near = with_next(whole, key, "__text", {"__anchors": anchors(F.col("__text"), k, s)})
    changed = near.withColumn("edited", edited(F.col("__text"), F.col("next___text")))
    found = changed.withColumn("edited_anchors", anchors(F.col("edited"), k, s))
    return found.select(
        key,
        F.length("__text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("__anchors")).alias("fingerprint"),
        printed(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("__anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("__anchors"), F.col("next___anchors")).alias("near_next"),
    )
