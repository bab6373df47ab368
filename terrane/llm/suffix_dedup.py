"""Removing long repeats by two rounds of hash comparison of suffixes.

Suffixes are ranked at anchors: positions whose 8-byte hash is the smallest of some stretch of STRETCH positions. The choice
depends on the bytes alone, so equal strings have equal anchors. Every string of the threshold length has its
anchor among its first STRETCH positions, hence a string that repeats shows as an anchor whose following bytes
repeat. There is no prefix doubling: Spark sorts one pair of ranks an anchor once (bytes up to an offset, and from there
up to twice the offset); anchors that are unique leave. What is left is ranked once more past the threshold: for each
start that belongs to the anchor by all of its bytes. Ranks are 64-bit hashes of the bytes, 48 bits in the last
round, where only equal pairs are compared.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm import ngram_join
from terrane.llm.common import dropped, written

STRETCH = 128
#: Rank pairs that several texts of a bounded sample share are repeats for certain: they need no sorting, and so
#: no task meets all anchors of a passage that very many documents hold.
SAMPLE = 4_000
MOST_COMMON = 100_000
#: A larger group is compared in parts first; what is single in its part meets by Spark's aggregation.
PART_ROWS = 2_048
_PLACE = np.uint64((1 << 31) - 1)
#: Groups that are compared at a time, told apart by 9 bits beside the 55 of a start.
COMPARED = 512
#: Large groups are few; up to so many are broadcast, more meet their rows dealt to so many shares a group.
BROADCAST_GROUPS = 200_000
SHARES = 64
#: Python workers put rows out after so many rows, or bytes of text: a batch that comes in may hold far more.
ROWS_OUT = 50_000
BYTES_OUT = 4_000_000
#: What is known of a text of which something goes.
COLUMNS = ("sha", "n_removed", "n_spans", "kept_sha256", "kept")
#: Bytes a word in coded texts.
CODE = 8
_SIX_BITS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)
_WORD = re.compile(rb"[^ \t\n\x0b\f\r]+")


def _sums(raw: np.ndarray) -> np.ndarray:
    ngram_join._grow(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * ngram_join._powers[: len(raw)], out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return ngram_join._mixed((sums[end] - sums[start]) * ngram_join._inverse[start])


def anchored(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text, and for each the first and the last start whose anchor it is."""
    starts = len(raw) - length + 1
    if starts <= 0:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    places = starts + STRETCH - 1
    eight = np.ndarray((places,), dtype="<u8", buffer=raw[: places + 7].tobytes(), strides=(1,))
    least = (ngram_join._mixed(eight.copy()) & ~_PLACE) | np.arange(places, dtype=np.uint64)
    width = 1
    while width < STRETCH:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    anchor = (least & _PLACE).astype(np.int64)
    low = np.flatnonzero(np.diff(anchor, prepend=-1))
    return anchor[low], low, np.append(low[1:], starts) - 1


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def _pairs(raw: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchors with their ranks: of the first bytes, and of as many after them."""
    anchor, low, high = anchored(raw, length)
    half = (length - STRETCH) // 2
    sums = _sums(raw) if len(anchor) else np.zeros(1, np.uint64)
    first = _hash(sums, anchor, anchor + half)
    second = _hash(sums, anchor + half, anchor + 2 * half)
    return anchor, low, high, first, second, sums


def _common(texts: DataFrame, length: int) -> np.ndarray:
    rows = texts.count()
    parts = 1 << 20
    some = texts if rows <= SAMPLE else texts.where(F.pmod("tid", F.lit(parts)) < int(parts * SAMPLE / rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for tid, text in zip(batch["tid"], batch["text"], strict=True):
                _, _, _, first, second, _ = _pairs(_bytes(text), length)
                if len(first):
                    rank = np.unique(ngram_join._mixed(first ^ ngram_join._mixed(second)))
                    yield pd.DataFrame({"rank": rank.view(np.int64), "tid": tid})

    ranks = some.mapInPandas(run, "rank long, tid long")
    counted = ranks.groupBy("rank").agg(F.min("tid").alias("a"), F.max("tid").alias("b"), F.count(F.lit(1)).alias("n"))
    top = counted.where("a <> b and n > 2").orderBy(F.desc("n"), "rank").limit(MOST_COMMON)
    return np.sort(np.array([r["rank"] for r in top.select("rank").collect()], dtype=np.int64))


def _anchors(texts: DataFrame, length: int, common: np.ndarray) -> DataFrame:
    """Rows (first, second, tid, anchor) whose rank pair occurs more than once in different places."""

    def emitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()  # copies of a text in the same task: one is enough
        names = ["first", "second", "tid", "anchor", "sure"]
        out: list[tuple] = []
        rows = 0

        def shown() -> pd.DataFrame:
            made = pd.DataFrame({n: np.concatenate(c) for n, c in zip(names, zip(*out, strict=True), strict=True)})
            out.clear()
            return made

        for batch in batches:
            for tid, text in zip(batch["tid"].tolist(), batch["text"], strict=True):
                if tid in seen:
                    continue
                seen.add(tid)
                anchor, _, _, first, second, _ = _pairs(_bytes(text), length)
                if len(anchor):
                    rank = ngram_join._mixed(first ^ ngram_join._mixed(second)).view(np.int64)
                    at = np.searchsorted(common, rank)
                    sure = (common[np.minimum(at, len(common) - 1)] == rank) if len(common) else np.zeros(len(rank), bool)
                    out.append((first.view(np.int64), second.view(np.int64), np.full(len(anchor), tid), anchor, sure))
                    rows += len(anchor)
                    if rows >= ROWS_OUT:
                        yield shown()
                        rows = 0
        if out:
            yield shown()

    def repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted; the last one waits for its neighbour, with whether the one before it was equal.
        wait: pd.DataFrame | None = None
        tied_before = False
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if wait is None else pd.concat([wait, batch], ignore_index=True)
            f, s, t, a = (rows[c].to_numpy() for c in ("first", "second", "tid", "anchor"))
            same = (f[1:] == f[:-1]) & (s[1:] == s[:-1])
            copy = same & (t[1:] == t[:-1]) & (a[1:] == a[:-1])
            # Copies count once: the first of equal rows stands for them, tied if any other row follows or comes before.
            keep = ~np.insert(copy, 0, False)
            rows, f, s = rows[keep], f[keep], s[keep]
            same = (f[1:] == f[:-1]) & (s[1:] == s[:-1])
            tied = np.insert(same, 0, tied_before) | np.append(same, False) | rows["sure"].to_numpy()
            yield rows.iloc[:-1][tied[:-1]].drop(columns="sure")
            tied_before = bool(same[-1]) if len(same) else tied_before
            wait = rows.iloc[-1:]
        if wait is not None and (tied_before or bool(wait["sure"].iloc[0])):
            yield wait.drop(columns="sure")

    schema = "first long, second long, tid long, anchor long, sure boolean"
    found = texts.mapInPandas(emitted, schema)
    seat = F.when(F.col("sure"), F.xxhash64("tid", "anchor")).otherwise(F.col("first"))
    dealt = found.repartition(seat).sortWithinPartitions("first", "second", "tid", "anchor")
    return dealt.mapInPandas(repeated, "first long, second long, tid long, anchor long")


def _starts(held: DataFrame, length: int) -> DataFrame:
    """Per anchor that is left: its starts, as the distance of the last one, and 48-bit ranks of all their bytes."""
    columns = ["rank", "part", "parts", "tid", "anchor", "low", "packed"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        size = 0

        def shown() -> pd.DataFrame:
            *numbers, packed = zip(*out, strict=True)
            out.clear()
            made = [np.concatenate(c) for c in numbers]
            return pd.DataFrame(dict(zip(columns, [*made, [x for row in packed for x in row]], strict=True)))

        for batch in batches:
            rows = zip(batch["tid"].tolist(), batch["text"], batch["anchors"], batch["parts"], strict=True)
            for tid, text, anchors, counts in rows:
                anchor, low, high, first, second, sums = _pairs(_bytes(text), length)
                order = np.argsort(anchors)
                kept = np.flatnonzero(np.isin(anchor, anchors))
                if not len(kept):
                    continue
                anchor, low, high = anchor[kept], low[kept], high[kept]
                n = counts[order][np.searchsorted(anchors, anchor, sorter=order)]
                # The starts of all anchors in a row, so that a text takes few steps however many anchors it has.
                ends = np.cumsum(high - low + 1)
                at = np.arange(ends[-1]) + np.repeat(high + 1 - ends, high - low + 1)
                ranks = (_hash(sums, at, at + length) >> np.uint64(16)).astype("<u8")
                whole = ranks.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
                cuts = [0, *(6 * ends).tolist()]
                packed = [whole[i:j] for i, j in zip(cuts, cuts[1:])]
                key = ngram_join._mixed(first[kept] ^ ngram_join._mixed(second[kept])).view(np.int64)
                out.append((key, (tid ^ anchor) % n, n, np.full(len(kept), tid), anchor, low, packed))
                size += len(whole)
                if size >= BYTES_OUT:
                    yield shown()
                    size = 0
        if out:
            yield shown()

    flat = held.select("tid", "text", F.col("left.anchor").alias("anchors"), F.col("left.parts").alias("parts"))
    return flat.mapInPandas(run, "rank long, part long, parts long, tid long, anchor long, low long, packed binary")


def _repeats(starts: DataFrame) -> DataFrame:
    """Ranges of starts that repeat (tid, low, high), found in parts or between them; a table."""

    def compared(rows: pd.DataFrame, group: np.ndarray) -> tuple[tuple, tuple]:
        """Of whole groups, COMPARED at most."""
        rank, parts, tid, anchor, first = (rows[c].to_numpy() for c in ("rank", "parts", "tid", "anchor", "low"))
        sizes = rows["packed"].map(len).to_numpy() // 6
        wide = np.zeros((sizes.sum(), 8), dtype=np.uint8)
        wide[:, :6] = np.frombuffer(b"".join(rows["packed"]), dtype=np.uint8).reshape(-1, 6)
        row = np.repeat(np.arange(len(rows)), sizes)
        start = np.arange(len(row)) + np.repeat(first - np.cumsum(sizes) + sizes, sizes)
        back = (anchor[row] - start).astype(np.uint64)  # starts repeat only at equal distance of their anchors, below STRETCH
        value = wide.view("<u8").reshape(-1) | (back << np.uint64(48))
        # 48 bits of rank, 7 of distance and 9 of the group: equal ones are the same string, in the same group.
        mixed = value | (group[row].astype(np.uint64) << np.uint64(55))
        order = np.argsort(mixed)
        met = mixed[order]
        same = met[1:] == met[:-1]
        again = np.empty(len(row), dtype=bool)
        again[order] = np.append(False, same) | np.append(same, False)
        edges = np.flatnonzero(np.diff(np.where(again, row, -1 - np.arange(len(row))), prepend=-(1 << 40)))
        last = np.append(edges[1:], len(row))[again[edges]] - 1
        edges = edges[again[edges]]
        ranges = (tid[row[edges]], start[edges], start[last])
        # Of parts one row for each value: columns, a part has PART_ROWS * STRETCH values at most.
        single = order[np.insert(~same, 0, True)] if len(order) else order
        single = single[parts[row[single]] > 1]
        of = row[single]
        return ranges, (rank[of], value[single].view(np.int64), tid[of], start[single], start[single], again[single])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by (rank, part); the last group waits until it is whole.
        names = ["rank", "value", "tid", "low", "high", "again"]
        wait: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            rank, part = rows["rank"].to_numpy(), rows["part"].to_numpy()
            new = np.insert((rank[1:] != rank[:-1]) | (part[1:] != part[:-1]), 0, True)
            group = np.cumsum(new) - 1
            kept = (np.bincount(group)[group] > 1) | (rows["parts"].to_numpy() > 1)
            rows, group = rows[kept], np.cumsum(np.diff(group[kept], prepend=-1) > 0) - 1
            for at in range(0, int(group[-1]) + 1 if len(group) else 0, COMPARED):
                i, j = np.searchsorted(group, [at, at + COMPARED])
                ranges, rest = compared(rows.iloc[i:j], group[i:j] - at)
                if len(ranges[0]):
                    # Nullable types: a column of integers and nulls would pass through floats.
                    none = {"rank": "Int64", "value": "Int64", "again": "boolean"}
                    empty = {c: pd.array([None] * len(ranges[0]), dtype=t) for c, t in none.items()}
                    yield pd.DataFrame(dict(zip(names[2:5], ranges, strict=True)) | empty)[names]
                if len(rest[0]):
                    yield pd.DataFrame(dict(zip(names, rest, strict=True)))

        for batch in batches:
            if not len(batch):
                continue
            rank, part = batch["rank"].to_numpy(), batch["part"].to_numpy()
            last = (rank == rank[-1]) & (part == part[-1])
            begun = bool(wait) and wait[0]["rank"].iloc[0] == rank[-1] and wait[0]["part"].iloc[0] == part[-1]
            if last.all() and (begun or not wait):
                wait.append(batch)
                continue
            yield from done(pd.concat([*wait, batch[~last]], ignore_index=True))
            wait = [batch[last]]
        if wait:
            yield from done(pd.concat(wait, ignore_index=True))

    dealt = starts.repartition("rank", "part").sortWithinPartitions("rank", "part")
    found = written(dealt.mapInPandas(run, "rank long, value long, tid long, low long, high long, again boolean"))
    ranges = found.where("rank is null").select("tid", "low", "high")
    # Of large groups each part gives one row for each of its values.
    single = F.collect_list(F.when(~F.col("again"), F.struct("tid", "low")))
    met = found.where("rank is not null").groupBy("rank", "value").agg(F.count(F.lit(1)).alias("n"), single.alias("singles"))
    between = met.where("n > 1").select(F.explode("singles").alias("x")).select("x.tid", "x.low", F.col("x.low").alias("high"))
    made = written(ranges.unionByName(between))
    dropped(found)
    return made


def _code(raw: np.ndarray) -> str:
    """A text as CODE characters, of 48 bits, for each word."""
    words = ngram_join.words_of(raw)
    shifts = np.arange(42, -1, -6, dtype=np.uint64)
    return _SIX_BITS[((words[:, None] >> shifts) & np.uint64(63)).astype(np.intp)].tobytes().decode("ascii")


def _coded(texts: DataFrame) -> DataFrame:
    """(tid, text) with CODE characters, of 48 bits, for each word in lower case: strings of words are strings of bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tids: list[int] = []
        coded: list[str] = []
        size = 0
        for batch in batches:
            for tid, text in zip(batch["tid"].tolist(), batch["text"], strict=True):
                tids.append(tid), coded.append(_code(_bytes(text)))
                size += len(coded[-1])
                if size >= BYTES_OUT:
                    yield pd.DataFrame({"tid": tids, "text": coded})
                    tids, coded, size = [], [], 0
        if tids:
            yield pd.DataFrame({"tid": tids, "text": coded})

    return texts.mapInPandas(run, "tid long, text string")


def _cleaned(held: DataFrame) -> DataFrame:
    columns = ["tid", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for tid, text, lows, ends, kinds in zip(batch["tid"].tolist(), *(batch[c] for c in ("text", "low", "end", "of_words")), strict=True):
                raw = _bytes(text)
                lows, ends, kinds = np.array(lows, np.int64), np.array(ends, np.int64), np.array(kinds, bool)
                if kinds.any():
                    placed = np.array([m.span() for m in _WORD.finditer(raw.tobytes())], dtype=np.int64)
                    lows[kinds], ends[kinds] = placed[lows[kinds], 0], placed[ends[kinds] - 1, 1]
                change = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(change, lows, 1)
                np.add.at(change, ends, -1)
                gone = np.cumsum(change)[:-1] > 0
                kept = raw[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                rows.append((tid, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                size += len(kept)
                if size >= BYTES_OUT:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    flat = held.select("tid", "text", *[F.col(f"found.{c}").alias(c) for c in ("low", "end", "of_words")])
    return flat.mapInPandas(run, "tid long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _with_parts(left: DataFrame) -> DataFrame:
    """``left`` with the number of parts of each row's group; no group's rows are dealt by its key alone."""
    sizes = left.groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))
    large = written(sizes.where(F.col("n") > PART_ROWS).select("first", "second", F.ceil(F.col("n") / PART_ROWS).cast("long").alias("parts")))
    if large.count() <= BROADCAST_GROUPS:
        dealt = left.join(F.broadcast(large), ["first", "second"], "left")
    else:
        share = F.pmod(F.xxhash64("tid", "anchor"), F.lit(SHARES))
        each = large.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)).cast("array<long>")))
        dealt = left.withColumn("share", share).join(each, ["first", "second", "share"], "left").drop("share")
    return dealt.withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))


def _repeated(texts: DataFrame, length: int, used_up: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts (tid, text) that hold an anchor left over, one copy each, and ranges (tid, low, high) of starts that repeat; tables.

    With ``used_up`` the table ``texts`` is deleted as soon as the first of these stands.
    """
    left = written(_anchors(texts, length, _common(texts, length)))
    sized = _with_parts(left).groupBy("tid").agg(F.collect_list(F.struct("anchor", "parts")).alias("left"))
    # Texts that every copy of goes are done; of the others one copy a text comes along.
    held = written(texts.join(sized, "tid").dropDuplicates(["tid"]))
    dropped(left)
    if used_up:
        dropped(texts)
    return held.select("tid", "text"), _repeats(_starts(held, length))


def texts_cleaned(df: DataFrame, text: str = "text", length: int = 400, words: int | None = None, only: Sequence[str] = COLUMNS) -> DataFrame:
    """Per distinct text of which something goes: ``sha``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (bytes), or those in ``only``.

    The result is a table; all others that were made on the way are deleted.

    A byte goes when a string of ``length`` bytes covers it that also starts elsewhere, in the same text or another,
    judged on the input. Null texts are empty; texts shorter than ``length`` keep all. ``length`` is 256 at least.
    With ``words`` (32 at least), strings of so many words that also start elsewhere go as well, however short in bytes;
    words are what lies between blanks, without regard to the case of A to Z.
    """
    if length < 2 * STRETCH or words is not None and CODE * words < 2 * STRETCH:
        raise ValueError(f"length must be {2 * STRETCH} at least, words {2 * STRETCH // CODE}")
    whole = F.coalesce(F.col(text), F.lit(""))
    sha = F.sha2(whole, 256)
    texts = df.select(whole.alias("text"), F.xxhash64(sha).alias("tid"))
    n_words = F.regexp_count(whole, F.lit(r"[^ \t\n\x0B\f\r]+")) if words else F.lit(0)
    counted = df.select(sha.alias("sha"), F.octet_length(whole).alias("size"), n_words.alias("n_words"))
    counted = counted.groupBy("sha", "size", "n_words").agg(F.count(F.lit(1)).alias("copies"))
    counted = written(counted.withColumn("tid", F.xxhash64("sha")))

    held, ranges = _repeated(texts.where(F.octet_length("text") >= length), length)
    made = [counted, held, ranges]
    found = ranges.select("tid", "low", (F.col("high") + length).alias("end"), F.lit(False).alias("of_words"))
    if words:
        # The texts themselves are cut, so one search leaves its ranges alone when the next begins.
        dropped(held)
        held = texts
        coded, ranges = _repeated(written(_coded(texts).where(F.length("text") >= CODE * words)), CODE * words, used_up=True)
        dropped(coded)
        made = [counted, made[-1], ranges]
        # Only whole words: a start inside a code repeats by chance, beside a repeat.
        first, last = F.ceil(F.col("low") / CODE).cast("long"), F.floor((F.col("high") + CODE * words) / CODE).cast("long")
        of_words = ranges.select("tid", first.alias("low"), last.alias("end"), F.lit(True).alias("of_words"))
        found = found.unionByName(of_words.where(F.col("end") - F.col("low") >= words))
    spans = found.groupBy("tid").agg(F.collect_list(F.struct("low", "end", "of_words")).alias("found"))
    one = held.join(spans, "tid").dropDuplicates(["tid"]) if words else held.join(spans, "tid")
    cleaned = _cleaned(one)

    enough = F.col("size") >= length
    several = (F.col("copies") > 1) & (enough | (F.col("n_words") >= words) if words else enough)
    empty = F.lit(b"")
    of_texts = (
        counted.join(cleaned, "tid", "left")
        .where(several | F.col("n_removed").isNotNull())
        .select(
            "sha",
            F.when(several, F.col("size").cast("long")).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(several, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
            F.when(several, F.sha2(empty, 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
            F.when(several, empty).otherwise(F.col("kept")).alias("kept"),
        )
    )
    result = written(of_texts.select(*only))
    for table in made:
        dropped(table)
    return result


def spans_removed(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """Per row: key, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs) and ``kept_sha256``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(key, F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"))
    cleaned = texts_cleaned(df, text, length, only=COLUMNS[:-1])
    zero = F.lit(0).cast("long")
    return rows.join(cleaned, "sha", "left").select(
        key,
        "n_bytes",
        F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "sha").alias("kept_sha256"),
    )


def without_repeats(df: DataFrame, text: str = "text", length: int = 400, words: int | None = None) -> DataFrame:
    """``df`` with repeats cut out of its texts, same columns. Characters that a cut went through go as well; nulls stay."""
    cleaned = texts_cleaned(df, text, length, words, only=("sha", "kept"))

    @F.pandas_udf("string")
    def read(kept: pd.Series) -> pd.Series:
        return kept.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))

    joined = df.withColumn("__sha", F.sha2(F.col(text), 256)).join(cleaned.select(F.col("sha").alias("__sha"), read("kept").alias("__kept")), "__sha", "left")
    return joined.withColumn(text, F.coalesce("__kept", F.col(text))).select(*[F.col(f"`{c}`") for c in df.columns])
