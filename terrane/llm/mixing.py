"""Mixing sources to target weights by temperature.

Source token shares are raised to an exponent and normalised. The exponent is bisected until a target is met:
a least entropy of the mixture, or a largest ratio between the most and the least repeated source. Weights
are then realised under a token budget: a source gives whole permutations of its rows (blocks) and
the start of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import running_total, without

STEPS = 40
#: Bits of the digest that cut the order of a block into buckets, summed side by side.
BUCKET_BITS = 12


def tokens_of(text: Column) -> Column:
    """Words between white space, one at least, so that every row weighs something."""
    whole = F.coalesce(text, F.lit(""))
    blank = lambda c: c.rlike(r"^\s$").cast("int")
    parts = F.size(F.split(whole, r"\s+")) - blank(F.substring(whole, 1, 1)) - blank(F.substring(whole, -1, 1))
    return F.greatest(parts, F.lit(1)).cast("long")


def exponent(shares: str, target: str, value: float) -> str:
    """SQL that bisects the exponent of a mixture of ``shares``, to within 2^-STEPS.

    ``entropy``: the largest exponent in 0 .. 1 whose mixture has an entropy (in nats) of ``value`` at least; 0 if
    none has. ``repetition``: the smallest one with which no source is repeated more than ``value``
    times as often as another. Entropy falls as the exponent rises, and so does the repetition.
    """
    if target == "entropy":
        total = f"aggregate({shares}, 0D, (a, p) -> a + power(p, e))"
        spread = f"aggregate({shares}, 0D, (a, p) -> a + power(p, e) * e * ln(p))"
        rise, out = f"ln({total}) - ({spread}) / ({total}) >= {float(value)!r}D", "lo"
    elif target == "repetition":
        # Repetition is p^(e - 1) but for a common factor: least for the largest share.
        rise, out = f"power(array_max({shares}) / array_min({shares}), 1D - e) > {max(1.0, float(value))!r}D", "hi"
    else:
        raise ValueError(f"unknown target {target!r}: entropy or repetition")
    step = f"element_at(transform(array((s.lo + s.hi) / 2), e -> if({rise}, named_struct('lo', e, 'hi', s.hi), named_struct('lo', s.lo, 'hi', e))), 1)"
    return f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (s, _i) -> {step}, s -> s.{out})"


def _group(source: str) -> Column:
    """The source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def source_plan(counted: DataFrame, target: str, value: float, budget: int | None) -> DataFrame:
    """One row per ``__group``: tokens, exponent, weight, budget in tokens, whole blocks, tokens left for one more.

    Without a budget it is the smallest with which every source gives all of its rows at least once.
    """
    per = counted.groupBy("__group").agg(F.sum("__tokens").alias("tokens"))
    # One array of token counts, eight bytes a source, and from it a single row of figures.
    shares = "transform(list, t -> t / total)"
    figures = (
        per.agg(F.array_sort(F.collect_list("tokens")).alias("list"), F.sum("tokens").alias("total"))
        .selectExpr("list", "total", f"if(size(list) = 0, 1D, {exponent(shares, target, value)}) as alpha")
        .selectExpr(
            "total", "alpha", "array_max(list) as most", "aggregate(list, 0D, (a, t) -> a + power(t / total, alpha)) as norm"
        )
        .first()
    )
    total, alpha, norm = float(figures["total"] or 0), figures["alpha"], figures["norm"]
    weight = F.pow(F.col("tokens") / F.lit(total), F.lit(alpha)) / F.lit(norm)
    spent = float(budget) if budget is not None else float(figures["most"] or 0) / ((float(figures["most"] or 1) / (total or 1.0)) ** alpha / (norm or 1.0))
    return per.select(
        "__group",
        "tokens",
        F.lit(alpha).alias("exponent"),
        weight.alias("weight"),
        F.floor(weight * F.lit(spent) + F.lit(1e-3)).cast("long").alias("budget"),
    ).withColumns({"__blocks": F.expr("budget div tokens"), "__left": F.expr("budget % tokens")})


def _digest(block: Column, key: str, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), block.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def mix(
    df: DataFrame,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    target: str = "repetition",
    value: float = 2.0,
    budget: int | None = None,
    seed: str = "mix",
) -> DataFrame:
    """Rows of the mixture: those of ``df`` with ``n_tokens``, ``weight``, ``block`` and ``order_key``.

    Sorted by (block, order_key) the rows of a source are its block permutations; blocks count from 0. The last
    block of a source ends before the row that would pass its budget; rows with equal keys stay together.
    A null source is a source of its own, null and empty texts weigh one token, equal rows are rows like
    others. An empty table stays empty. Input columns of the four names are replaced.
    """
    plain = without(df, "n_tokens", "weight", "block", "order_key")
    counted = plain.withColumns({"__tokens": tokens_of(F.col(text)), "__group": _group(source)})
    plan = source_plan(counted.select("__group", "__tokens"), target, value, budget)

    # Where the last block of each source ends: a digest, found from keys and token counts alone.
    narrow = counted.select(key, "__group", "__tokens").join(plan, "__group")
    last = narrow.withColumn("__digest", _digest(F.col("__blocks"), key, seed))
    bucket = F.shiftright(F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"), 16 - BUCKET_BITS)
    units = last.groupBy("__group", "__digest", "__left").agg(F.sum("__tokens").alias("__unit"))
    summed = running_total(
        units.withColumn("__bucket", bucket), ["__group"], [F.col("__digest")], "__unit", "__bucket", "__before"
    )
    fits = summed.where(F.col("__before") + F.col("__unit") <= F.col("__left"))
    ends = fits.groupBy("__group").agg(F.max("__digest").alias("__end"))

    dealt = counted.join(plan.drop("tokens", "exponent", "budget", "__left").join(ends, "__group", "left"), "__group")
    blocks = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks"))))
    keyed = blocks.withColumn("order_key", _digest(F.col("block"), key, seed))
    taken = keyed.where((F.col("block") < F.col("__blocks")) | (F.col("order_key") <= F.col("__end")))
    return taken.select(*plain.columns, F.col("__tokens").alias("n_tokens"), "weight", "block", "order_key")
