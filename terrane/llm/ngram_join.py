"""Joining near copies by the Jaccard likeness of their word n-grams, exactly.

Documents with equal n-gram sets are one class. A class meets others in tiles: all classes with one n-gram
among the few that each must share with any partner, cut where sizes differ too much to link. In a tile, bit
counts of hashed bitmap signatures bound the overlap from above; pairs that pass are verified once by
intersecting their sorted n-gram arrays. Links are found in two rounds: first to one leader a tile, then only
between classes that are not connected yet, so large groups of near copies make no pairs in square number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import components, dropped, written

#: Signatures have about a bit for each n-gram, between these bounds; a longer one folds to any shorter one. Pairs
#: that pass meet wide ones, with so many times the bits, before their sets are fetched.
LEAST_BITS, MOST_BITS, WIDER = 1_024, 16_384, 4
#: N-grams are taken for common on a sample of so many documents at least, and of one in SAMPLED: they come last in the
#: order of prefixes, the commonest at the end. A share of the documents, as in a sample of fixed size the n-grams of tiles that
#: grow with the input would not show. The order decides how large tiles get, never which pairs meet.
SAMPLE, SAMPLED = 4_000, 12
COMMON_IN_SAMPLE = 3
MOST_COMMON = 2_000_000
#: So many rows of numbers are sent to the texts (some 40 MB); more meet them by a shuffle of the texts.
SENT_ROWS = 1_000_000
#: Pairs that are made at a time, and bytes of signatures that are compared at a time.
PAIRS_COMPARED, BYTES_COMPARED = 200_000, 8 << 20
#: A larger tile is split into parts of about so many rows, which meet in pairs.
SPLIT_ROWS = 4_096

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _BASE
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(32))


def _grow(n: int) -> None:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << n.bit_length()
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE)]))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]))


def words_of(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words among the bytes of a text, A to Z in lower case."""
    word = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    _grow(len(raw) + 1)
    summed = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _powers[: len(raw)], out=summed[1:])
    return _mixed((summed[ends] - summed[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; all words as one if there are fewer, none without words."""
    words = words_of(np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8))
    if not len(words):
        return words
    width = min(n, len(words))
    count = len(words) - width + 1
    found = np.full(count, np.uint64(width), dtype=np.uint64)
    for j in range(width):
        found = _mixed(found ^ words[j : j + count]) + np.uint64(j)
    return np.unique(found)


def needed(size: int, percent: int) -> int:
    """The least overlap with which a set of this size can link."""
    return -(-percent * size // 100)


def signature(held: np.ndarray, wider: int = 1) -> bytes:
    size = wider * min(MOST_BITS, max(LEAST_BITS, 1 << (len(held) - 1).bit_length()))
    bits = np.zeros(size, dtype=bool)
    bits[(held >> np.uint64(7)) % np.uint64(size)] = True
    return np.packbits(bits).tobytes()


def folded(signatures: Sequence[bytes], width: int) -> np.ndarray:
    """Signatures as rows of ``width`` bytes, longer ones with their parts laid over each other."""
    out = np.empty((len(signatures), width), dtype=np.uint8)
    for i, x in enumerate(signatures):
        out[i] = np.bitwise_or.reduce(np.frombuffer(x, dtype=np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def overlap_bound(sizes_a, sizes_b, signatures_a: np.ndarray, signatures_b: np.ndarray) -> np.ndarray:
    """Overlap at most: every differing bit stands for an element that one of the two sets has alone."""
    differing = np.bitwise_count(signatures_a ^ signatures_b).sum(axis=-1, dtype=np.int64)
    return (sizes_a + sizes_b - differing) // 2


def links(overlap, sizes_a, sizes_b, percent: int):
    return 100 * overlap >= percent * (sizes_a + sizes_b - overlap)


def ordered(held: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """A sorted set in the order of prefixes: n-grams that are not common first, then by how often ``common`` (sorted) has them."""
    if not len(common):
        return held
    at = np.minimum(np.searchsorted(common, held), len(common) - 1)
    return held[np.argsort(np.where(common[at] == held, often[at], 0), kind="stable")]


def _described(df: DataFrame, n: int, percent: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: class, set size, signature, and the n-grams of which any partner shares one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["__key"], batch["__text"], strict=True):
                held = shingles(text, n)
                if not len(held):
                    rows.append((key, None, 0, None, None))
                    continue
                prefix = ordered(held, *common)[: len(held) - needed(len(held), percent) + 1]
                kind = int.from_bytes(hashlib.blake2b(held.tobytes(), digest_size=8).digest(), "big", signed=True)
                rows.append((key, kind, len(held), signature(held), prefix.view(np.int64)))
            # Objects: a column of integers and nulls would pass through floats.
            yield pd.DataFrame(rows, columns=["key", "kind", "n", "signature", "prefix"], dtype=object).astype({"kind": "Int64", "n": "int64"})

    keyed = df.select(F.col("__key").cast("string").alias("__key"), "__text")
    made = keyed.mapInPandas(run, "key string, kind long, n long, signature binary, prefix array<long>")
    return made.withColumn("key", F.col("key").cast("long"))


def _common(df: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams that several documents of a sample share, sorted, and how often it has them."""
    rows = df.count()
    parts = 1 << 20
    share = max(SAMPLE / max(rows, 1), 1 / SAMPLED)
    some = df if share >= 1 else df.where(F.pmod(F.xxhash64("__key"), F.lit(parts)) < int(parts * share))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [shingles(t, n) for t in batch["__text"]]
            gram, count = np.unique(np.concatenate([np.empty(0, np.uint64), *held]), return_counts=True)
            yield pd.DataFrame({"gram": gram.view(np.int64), "count": count})

    counted = some.mapInPandas(run, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))
    several = written(counted.where(F.col("count") >= COMMON_IN_SAMPLE))
    # One row a count; the least one with which no more than MOST_COMMON n-grams are taken.
    least, taken = COMMON_IN_SAMPLE, 0
    for r in several.groupBy("count").agg(F.count(F.lit(1)).alias("grams")).orderBy(F.desc("count")).collect():
        taken += r["grams"]
        if taken > MOST_COMMON:
            least = r["count"] + 1
            break
    top = several.where(F.col("count") >= least).orderBy("gram").toArrow()
    dropped(several)
    gram, count = (top[c].to_numpy() for c in ("gram", "count"))
    order = np.argsort(gram.view(np.uint64))
    return gram.view(np.uint64)[order], count[order].astype(np.int32)


def _tiles(classes: DataFrame, percent: int) -> DataFrame:
    """Rows (tile, kind, n, leader, leader_n, before, before_n): classes that share a prefix n-gram.

    A tile goes on while neighbours by size can link; ``leader`` is its first class, ``before`` the one before.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by (gram, n, kind). The last row of a batch waits for the next, with what it is tied to.
        wait: tuple | None = None
        for batch in batches:
            gram, n, kind = (batch[c].to_numpy(np.int64) for c in ("gram", "n", "kind"))
            if not len(gram):
                continue
            if wait is not None:
                gram, n, kind = (np.insert(x, 0, v) for x, v in zip((gram, n, kind), wait[:3], strict=True))
            tied = np.append(False, (gram[1:] == gram[:-1]) & (100 * n[:-1] >= percent * n[1:]))
            first = np.maximum.accumulate(np.where(tied, 0, np.arange(len(gram))))
            tile = _mixed(gram.view(np.uint64) ^ _mixed(n[first].astype(np.uint64))).view(np.int64)
            leader, leader_n = kind[first], n[first]
            before, before_n = np.roll(kind, 1), np.roll(n, 1)
            if wait is not None:
                same = first == 0
                tile[same], leader[same], leader_n[same] = wait[3:6]
                tied[0], before[0], before_n[0] = wait[6:9]
            out = pd.DataFrame(
                {"tile": tile, "kind": kind, "n": n, "leader": leader, "leader_n": leader_n, "before": before, "before_n": before_n}
            )
            out.loc[~tied, ["before", "before_n"]] = out.loc[~tied, ["kind", "n"]].to_numpy()
            yield out.iloc[:-1][tied[:-1] | tied[1:]]
            wait = (gram[-1], n[-1], kind[-1], tile[-1], leader[-1], leader_n[-1], tied[-1], before[-1], before_n[-1])
        if wait is not None and wait[6]:
            names = ["tile", "kind", "n", "leader", "leader_n", "before", "before_n"]
            yield pd.DataFrame([[wait[3], wait[2], wait[1], wait[4], wait[5], wait[7], wait[8]]], columns=names)

    posted = classes.select(F.explode("prefix").alias("gram"), "n", "kind")
    dealt = posted.repartition("gram").sortWithinPartitions("gram", "n", "kind")
    schema = "tile long, kind long, n long, leader long, leader_n long, before long, before_n long"
    return dealt.mapInPandas(run, schema)


def _could_link(percent: int) -> str:
    return f"a <> b and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"


def _first_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    pairs = tiles.select("kind", "n", F.explode(F.array(F.struct(F.col("leader").alias("x"), F.col("leader_n").alias("x_n")), F.struct(F.col("before").alias("x"), F.col("before_n").alias("x_n")))).alias("other"))
    named = pairs.select(F.col("kind").alias("a"), F.col("n").alias("a_n"), F.col("other.x").alias("b"), F.col("other.x_n").alias("b_n"))
    turned = named.where(_could_link(percent)).selectExpr(
        "least(a, b) as a", "if(a < b, a_n, b_n) as a_n", "greatest(a, b) as b", "if(a < b, b_n, a_n) as b_n"
    )
    return turned.distinct()


def _of_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("kind")).distinct()


def _chosen(wanted: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(kind, __text) of the classes in ``wanted`` (kind): texts whose key is that of a row with the text of the class."""
    rows = written(classes.select("kind", "first").join(wanted, "kind").select("kind", F.col("first").alias("__key")))
    # A counted few are sent to the texts; for more the texts meet them by a shuffle.
    few = rows.count() <= SENT_ROWS
    return texts.join(F.broadcast(rows) if few else rows, "__key").select("kind", "__text")


def _wide(wanted: DataFrame, classes: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(kind, n, signature) with wide signatures, made from the texts of the classes in ``wanted`` (kind) alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [shingles(t, n) for t in batch["__text"]]
            mine = [int.from_bytes(hashlib.blake2b(h.tobytes(), digest_size=8).digest(), "big", signed=True) for h in held]
            same = batch["kind"].to_numpy() == np.array(mine, dtype=np.int64)
            rows = [(k, len(h), signature(h, WIDER)) for k, h, s in zip(batch["kind"].tolist(), held, same, strict=True) if s]
            yield pd.DataFrame(rows, columns=["kind", "n", "signature"])

    made = _chosen(wanted, classes, texts)
    return made.mapInPandas(run, "kind long, n long, signature binary").dropDuplicates(["kind"])


def _bounded(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures allow enough overlap."""
    a, b = (signatures.select(F.col("kind").alias(x), F.col("n").alias(f"{x}_n"), F.col("signature").alias(f"s{x}")) for x in "ab")
    both = pairs.select("a", "b").join(a, "a").join(b, "b")

    @F.pandas_udf("boolean")
    def passes(a_n: pd.Series, b_n: pd.Series, sa: pd.Series, sb: pd.Series) -> pd.Series:
        if not len(a_n):
            return pd.Series([], dtype=bool)
        na, nb = a_n.to_numpy(), b_n.to_numpy()
        width = np.minimum(sa.map(len), sb.map(len)).to_numpy()
        out = np.zeros(len(na), dtype=bool)
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            x, y = (folded([v.iat[i] for i in at], w) for v in (sa, sb))
            out[at] = links(overlap_bound(na[at], nb[at], x, y), na[at], nb[at], percent)
        return pd.Series(out)

    return both.where(passes("a_n", "b_n", "sa", "sb")).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs that link, by the intersection of their sorted n-gram arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = [shingles(t, n).tobytes() for t in batch["__text"]]
            mine = [int.from_bytes(hashlib.blake2b(h, digest_size=8).digest(), "big", signed=True) for h in held]
            out = pd.DataFrame({"kind": batch["kind"], "grams": held})
            yield out[batch["kind"].to_numpy() == np.array(mine)]

    sets = _chosen(_of_pairs(pairs), classes, texts).mapInPandas(run, "kind long, grams binary")
    sets = written(sets.dropDuplicates(["kind"]))

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            both = np.concatenate([p, q])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out.append(bool(links(shared, len(p), len(q), percent)))
        return pd.Series(out, dtype=bool)

    paired = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    found = written(paired.where(linked("x", "y")).select("a", "b"))
    dropped(sets)
    return found


def _open_rows(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (tile, kind, n, label, parts) of the tiles that hold classes not connected yet; of tiles with the same classes one stays."""
    labelled = tiles.select("tile", "kind", "n").join(found.toDF("kind", "label"), "kind", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "kind"))
    # Near copies share many n-grams of their prefixes, so the same classes meet in many tiles; 128 bits tell equal ones.
    same = [F.bit_xor(F.xxhash64("kind", F.lit(i))).alias(f"set{i}") for i in range(2)]
    sizes = labelled.groupBy("tile").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("rows"), *same)
    # Two classes were compared in the first round.
    once = sizes.where("low < high and rows > 2").groupBy("rows", "set0", "set1").agg(F.min("tile").alias("tile"))
    open_ = once.select("tile", F.ceil(F.col("rows") / SPLIT_ROWS).cast("int").alias("parts"))
    return labelled.join(open_, "tile")


def _second_pairs(open_rows: DataFrame, wide: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs among classes of a tile that are not connected yet, by wide signatures.

    With ``best`` each class brings only its likeliest partner of a tile: when those that link are connected, few pairs are
    left for the round that takes all.
    """
    rows = open_rows.join(wide.select("kind", "signature"), "kind")
    part = F.pmod(F.xxhash64("kind"), F.col("parts")).cast("int")
    seats = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("part")).alias("i"), F.greatest(o, F.col("part")).alias("j")))
    seated = rows.withColumn("part", part).withColumn("seat", F.explode(seats)).select("tile", "seat.i", "seat.j", "part", "n", "kind", "label", "signature")

    def laid(signatures: pd.Series, widths: np.ndarray, w: int) -> tuple[np.ndarray, ...]:
        """Signatures of ``w`` bytes and more, folded to as many and to narrow ones, and the place of each row among them."""
        out = np.empty((int((widths >= w).sum()), w), dtype=np.uint8)
        place = np.cumsum(widths >= w) - 1
        for v in np.unique(widths[widths >= w]).tolist():
            of = np.flatnonzero(widths == v)
            every = np.frombuffer(b"".join(signatures.iloc[of]), dtype=np.uint8).reshape(len(of), v // w, w)
            out[place[of]] = np.bitwise_or.reduce(every, axis=1)
        wide = out.view(np.uint64)
        return np.bitwise_or.reduce(wide.reshape(len(wide), WIDER, -1), axis=1), wide, place

    def fitting(n: np.ndarray, widths: np.ndarray, known: dict[int, tuple], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Those of the pairs (a, b) of rows that may link, in their order, with their bounds."""
        width = np.minimum(widths[a], widths[b])
        kept, bounds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for w, (narrow, wide, place) in known.items():
            of_width = np.flatnonzero(width == w)
            step = max(1, BYTES_COMPARED // w)
            for at in range(0, len(of_width), step):
                pairs = of_width[at : at + step]
                for bits in (narrow, wide):
                    x, y = a[pairs], b[pairs]
                    bound = overlap_bound(n[x], n[y], bits[place[x]], bits[place[y]])
                    fits = links(bound, n[x], n[y], percent)
                    pairs, bound = pairs[fits], bound[fits]
                kept.append(pairs)
                bounds.append(bound)
        found, bound = np.concatenate(kept), np.concatenate(bounds)
        order = np.argsort(found)
        return a[found[order]], b[found[order]], bound[order]

    def compared(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Pairs of whole groups, all at once: most groups are small."""
        n, kind, label, part, i, j, tile = (rows[c].to_numpy() for c in ("n", "kind", "label", "part", "i", "j", "tile"))
        new = np.insert((tile[1:] != tile[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), 0, True)
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(rows))
        reach = np.concatenate([x + np.searchsorted(percent * n[x:y], 100 * n[x:y], side="right") for x, y in zip(starts, ends, strict=True)])
        sizes = np.maximum(reach - np.arange(len(rows)) - 1, 0)
        widths = rows["signature"].map(len).to_numpy()
        known = {w: laid(rows["signature"], widths, w) for w in np.unique(widths).tolist()}
        # Some PAIRS_COMPARED pairs at a time, of whole rows, so that a row's likeliest partner is known.
        step = np.cumsum(sizes) // PAIRS_COMPARED
        for x, y in zip(cuts := np.flatnonzero(np.diff(step, prepend=-1)), np.append(cuts[1:], len(rows)), strict=True):
            mine = sizes[x:y]
            a = np.repeat(np.arange(x, y), mine)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(mine) - mine, mine)
            apart = (label[a] != label[b]) & ((i[a] == j[a]) | (part[a] != part[b]))
            a, b, bound = fitting(n, widths, known, a[apart], b[apart])
            if best and len(a):
                likeness = bound / (n[a] + n[b] - bound)
                order = np.lexsort((b, -likeness, a))
                first = order[np.diff(a[order], prepend=-1) > 0]
                a, b = a[first], b[first]
            if len(a):
                yield pd.DataFrame({"a": np.minimum(kind[a], kind[b]), "b": np.maximum(kind[a], kind[b])})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by (tile, i, j, n); a group has SPLIT_ROWS rows a side or so and waits until it is whole.
        wait: pd.DataFrame | None = None

        for batch in batches:
            if not len(batch):
                continue
            rows = batch if wait is None else pd.concat([wait, batch], ignore_index=True)
            key = rows[["tile", "i", "j"]].to_numpy()
            last = (key == key[-1]).all(axis=1)
            if not last.all():
                yield from compared(rows[~last])
            wait = rows[last]
        if wait is not None:
            yield from compared(wait)

    dealt = seated.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j", "n", "kind")
    return dealt.mapInPandas(run, "a long, b long").distinct()


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose classes are not connected yet."""
    both = pairs.join(found.toDF("a", "la"), "a", "left").join(found.toDF("b", "lb"), "b", "left")
    return both.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")


def join(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``df``: key, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Words are what lies between ASCII blanks, A-Z in lower case; sets are of distinct n-grams of the whole text, all
    words as one if there are fewer. Sets link when 100 * intersection >= percent * union. Null texts and
    texts without words have an empty set, link with nothing and are their own component, as do rows with a null
    key or text. Equal rows give equal results. Keys are integers; other columns take no part.
    """
    texts = df.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))
    described = written(_described(texts, n, percent, _common(texts, n)))
    named = written(described.select("key", "kind", "n"))
    narrow = named.where("kind is not null").groupBy("kind").agg(F.min("key").alias("first"), F.min("n").alias("n"))
    # One row a class: prefixes and signatures of its other rows are equal, and go.
    classes = written(
        described.withColumnRenamed("key", "first")
        .join(narrow.select("kind", "first"), ["kind", "first"], "left_semi")
        .dropDuplicates(["kind"])
        .select("kind", "first", "n", "signature", "prefix")
    )
    dropped(described)
    tiles = written(_tiles(classes, percent))
    signed = written(classes.drop("prefix"))
    dropped(classes)
    passed = written(_bounded(_first_pairs(tiles, percent), signed, percent))
    wide = written(_wide(_of_pairs(passed), signed, texts, n))
    near = written(_bounded(passed, wide, percent))
    dropped(wide)
    dropped(passed)
    # One partner for each class first, so that a set travels about once; then what that left apart.
    linked = _verified(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), signed, texts, n, percent)
    found = components(linked)
    more = written(_apart(near, found))
    dropped(near)
    if not more.isEmpty():
        linked = written(linked.unionByName(_verified(more, signed, texts, n, percent)))
        found = components(linked)
    open_rows = written(_open_rows(tiles, found))
    wide = written(_wide(open_rows.select("kind").distinct(), signed, texts, n))
    for best in (True, False):
        more = written(_second_pairs(open_rows, wide, percent, best))
        if more.isEmpty():
            break
        linked = written(linked.unionByName(_verified(more, signed, texts, n, percent)))
        found = components(linked)
        if best:
            open_rows = written(_open_rows(tiles, found))
    for table in (tiles, wide, signed, open_rows):
        dropped(table)
    smallest = found.join(narrow.select(F.col("kind").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    placed = found.join(smallest, "component").select(F.col("node").alias("kind"), "component_id")
    of_kind = narrow.join(placed, "kind", "left").select("kind", F.coalesce("component_id", "first").alias("component_id"))
    return named.join(of_kind, "kind", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id")
    )
