"""Collocations of words by vertically partitioned suffix subtrees.

The suffixes of all pieces of text, cut off after ``DEPTH`` words, form one tree a language. It is never built as a whole:

1. Word counts are the first level. Words below the least count can be in no phrase, so suffixes end before them.
2. Prefixes of two words whose suffixes exceed the memory budget are extended by a word until each one fits.
3. Prefixes are put into groups of about one budget each.
4. Every suffix goes to its prefix's group, in sorted and compressed blocks. A group sorts its suffixes and reads
   its subtrees off them: a node is a run of equal prefixes, and its count is the total of its leaves.

A task holds one group at a time. An extended prefix lies in several groups; its totals are added at the end, so which
prefixes are extended is layout only, and a sample of the rows may tell. The rest is joins over frequent phrases.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import written

DEPTH = 4
#: Suffix occurrences of one group: the memory budget of a task (some 100 MB).
BUDGET = 1_000_000
#: At most so many prefixes of each length are extended (the list is broadcast); past so many budgets of words they get larger groups.
HOT_PREFIXES = 100_000
#: One row in so many is read to find the prefixes to extend.
SAMPLED = 8
#: Bits that tell words which may be frequent: 2 MB whatever the corpus. Where bits are shared, fewer suffixes are left out.
WORD_BITS = 1 << 24
#: A task hands on its counts when it holds so many suffixes or words, or has read so many characters.
HELD = 300_000
HELD_CHARS = 32 << 20

#: What ends a piece; blanks and tabs part words.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO_LINES = bytes.maketrans(_ENDS, b"\n" * len(_ENDS))
_WORDS = [f"w{i}" for i in range(1, DEPTH + 1)]
CODEC = "zstd"


def pieces(text: str) -> Iterator[list[bytes]]:
    """The words of each piece, A-Z in lower case."""
    for piece in text.encode("utf-8").lower().translate(_TO_LINES).split(b"\n"):
        if words := piece.split():
            yield words


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            yield lang.as_py(), text.as_py()


class _Held:
    """Counts of one task by language, handed on when they grow beyond a bound."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.by, self.read = names, {}, 0

    def of(self, lang: str) -> Counter:
        found = self.by.get(lang)
        if found is None:
            found = self.by[lang] = Counter()
        return found

    def full(self, read: int) -> bool:
        self.read += read
        return self.read > HELD_CHARS or sum(map(len, self.by.values())) > HELD

    def drained(self) -> Iterator[pa.RecordBatch]:
        for lang, counts in self.by.items():
            columns = list(zip(*counts, strict=True)) if counts else [()] * len(self.names)
            arrays = [pa.array(c, pa.binary()).cast(pa.string()) for c in columns]
            arrays = [pa.array([lang] * len(counts), pa.string()), *arrays, pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["lang", *self.names, "n"])
        self.by, self.read = {}, 0


def words_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task."""
    held = _Held(["w1"])
    for lang, text in _texts(batches):
        counts = held.of(lang)
        for words in pieces(text):
            counts.update(zip(words))
        if held.full(len(text)):
            yield from held.drained()
    yield from held.drained()


class _Frequent(dict):
    """Whether a word of one language may be frequent, by its bit; remembered up to a bound."""

    def __init__(self, lang: str, bits: np.ndarray) -> None:
        super().__init__()
        self.start, self.bits = zlib.crc32(lang.encode() + b"\0"), bits

    def __missing__(self, word: bytes) -> bool:
        place = zlib.crc32(word, self.start) % WORD_BITS
        found = bool(self.bits[place >> 3] >> (place & 7) & 1)
        if len(self) < HELD and len(word) < 64:
            self[word] = found
        return found


@dataclass(frozen=True)
class Partition:
    """Where suffixes go: bits of frequent words, prefixes that were extended, and the number of groups."""

    bits: np.ndarray
    extended: frozenset[tuple[str | bytes, ...]]  # (language, words...), too large for a group
    groups: int = 1

    def runs(self, lang: str, text: str, known: dict[str, _Frequent]) -> Iterator[list[bytes]]:
        """Runs of at least two words that may all be frequent."""
        may = known.get(lang)
        if may is None:
            may = known[lang] = _Frequent(lang, self.bits)
        for words in pieces(text):
            marks = [may[w] for w in words]
            if all(marks):
                if len(words) > 1:
                    yield words
                continue
            start = 0
            for end in [i for i, mark in enumerate(marks) if not mark] + [len(words)]:
                if end - start > 1:
                    yield words[start:end]
                start = end + 1

    def group(self, lang: str, suffix: tuple[bytes, ...]) -> int:
        """The group of the shortest prefix, from two words on, that fits one."""
        size = 2
        while size < len(suffix) and (lang, *suffix[:size]) in self.extended:
            size += 1
        return zlib.crc32(b" ".join(suffix[:size]), zlib.crc32(lang.encode())) % self.groups


def _suffixes(words: list[bytes]) -> Iterator[tuple[bytes, ...]]:
    """All suffixes of a run, cut off at the depth; those of a single word are counted already."""
    size = len(words)
    if size >= DEPTH:
        yield from zip(*(words[i:] for i in range(DEPTH)))
    for left in range(min(DEPTH - 1, size), 1, -1):
        yield tuple(words[-left:])


def extensions_of(batches: Iterable[pa.RecordBatch], partition: Partition, size: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of ``size`` words whose shorter parts were all extended."""
    held, known = _Held(_WORDS[:size]), {}
    hot = partition.extended
    for lang, text in _texts(batches):
        counts = held.of(lang)
        for words in partition.runs(lang, text, known):
            marks = [(lang, *part) in hot for part in zip(*(words[i:] for i in range(size - 1)))]
            counts.update(tuple(words[i : i + size]) for i in range(len(marks) - 1) if marks[i] and marks[i + 1])
        if held.full(len(text)):
            yield from held.drained()
    yield from held.drained()


def blocks_of(batches: Iterable[pa.RecordBatch], partition: Partition) -> Iterator[pa.RecordBatch]:
    """The suffixes of a task by group, as compressed blocks of sorted lines.

    In a line every word is followed by a blank, so lines that share words lie together whatever signs the words hold; a count
    above 1 follows after a tab.
    """
    held, known = _Held(_WORDS), {}

    def drained() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.by.items():
            by: defaultdict[int, list[bytes]] = defaultdict(list)
            # Most prefixes are the first two words; only below extended ones longer prefixes are looked for.
            hot, start, crc, groups = {p[1:] for p in partition.extended if p[0] == lang}, zlib.crc32(lang.encode()), zlib.crc32, partition.groups
            for suffix, n in counts.items():
                if hot and suffix[:2] in hot:
                    group = partition.group(lang, suffix)
                else:
                    group = crc(b"%b %b" % suffix[:2], start) % groups
                line = b" ".join(suffix)
                by[group].append(line + b" " if n == 1 else b"%b \t%d" % (line, n))
            blocks = [pa.compress(b"\n".join(sorted(lines)), codec=CODEC, asbytes=True) for lines in by.values()]
            sizes = [sum(map(len, lines)) + len(lines) - 1 for lines in by.values()]
            arrays = [pa.array(list(by), pa.int64()), pa.array([lang] * len(by), pa.string()), pa.array(sizes, pa.int64()), pa.array(blocks, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["group", "lang", "size", "block"])
        held.by, held.read = {}, 0

    for lang, text in _texts(batches):
        counts = held.of(lang)
        for words in partition.runs(lang, text, known):
            counts.update(_suffixes(words))
        if held.full(len(text)):
            yield from drained()
    yield from drained()


def _nodes(lines: list[bytes], least: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """Nodes of two words and more with their leaf totals, from sorted lines; those below ``least`` are left out."""
    path: list[bytes] = []
    totals = [0] * (DEPTH + 1)
    for line in [*lines, b""]:
        head, _, n = line.partition(b"\t") if b"\t" in line else (line, b"", b"")
        words = head.split()
        shared = 0
        for a, b in zip(path, words):
            if a != b:
                break
            shared += 1
        for size in range(len(path), shared, -1):
            total = totals[size]
            if size > 1 and total >= least:
                yield tuple(path[:size]), total
            totals[size - 1] += total
            totals[size] = 0
        path = words
        totals[len(words)] += int(n) if n else 1


def subtrees_of(batches: Iterable[pa.RecordBatch], partition: Partition, least: int) -> Iterator[pa.RecordBatch]:
    """Nodes of every group, from blocks in the order of group and language.

    Parts of extended prefixes are put out whatever their count.
    """
    held: list[bytes] = []
    of: tuple[int, str] | None = None

    def read() -> pa.RecordBatch:
        lang = of[1]
        held.sort()
        mine = {p[1:] for p in partition.extended if p[0] == lang}
        rows = list(_nodes(held, least)) if not mine else [(k, n) for k, n in _nodes(held, 1) if n >= least or k in mine]
        held.clear()
        arrays = [pa.array([lang] * len(rows), pa.string()), pa.array([b" ".join(k) for k, _ in rows], pa.binary()).cast(pa.string())]
        arrays += [pa.array([len(k) for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "phrase", "size", "f"])

    for batch in batches:
        columns = [batch.column(c) for c in ("group", "lang", "size", "block")]
        for group, lang, size, block in zip(*columns, strict=True):
            key = (group.as_py(), lang.as_py())
            if of is not None and key != of:
                yield read()
            of = key
            held += pa.decompress(block.as_buffer(), decompressed_size=size.as_py(), codec=CODEC, asbytes=True).split(b"\n")
    if of is not None:
        yield read()


def _bits(words: DataFrame) -> np.ndarray:
    """One bit a frequent word, gathered by Spark into blocks of bits: the driver takes a table of fixed size."""
    place = F.crc32(F.concat("lang", F.lit("\0"), "phrase").cast("binary")) % WORD_BITS + 1  # numbers from 1 fill blocks evenly
    blocks = words.select(place.cast("long").alias("place")).groupBy(F.bitmap_bucket_number(F.col("place")).alias("block"))
    bits = np.zeros(WORD_BITS // 8, dtype=np.uint8)
    for r in blocks.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place"))).alias("bits")).toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        bits[(r["block"] - 1) * len(part) : r["block"] * len(part)] = part
    return bits


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Counts of all phrases of up to ``DEPTH`` words that occur at least ``least`` times, by language, and word totals.

    Returns ``lang``, ``phrase`` (words joined by a blank), ``size``, ``f``; and ``lang``, ``n`` (all words). A null text has
    no words, a null language is ``und``. Repeated rows count as often as they come. Other columns are not read.
    """
    docs = df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    counted = docs.mapInArrow(words_of, "lang string, w1 string, n long")
    words = written(counted.groupBy("lang", F.col("w1").alias("phrase")).agg(F.sum("n").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)
    every = often.agg(F.sum("f")).first()[0] or 0
    budget = max(BUDGET, -(-every // HOT_PREFIXES))

    partition = Partition(_bits(often), frozenset(), -(-every // budget) + 1)
    hot = often.where(F.col("f") > budget).select("lang", F.array("phrase").alias("words"))  # every / budget at most
    some = docs.where(F.pmod(F.monotonically_increasing_id(), F.lit(SAMPLED)) == 0)
    for size in range(2, DEPTH + 1):
        added = {(r["lang"], *(w.encode() for w in r["words"])) for r in hot.collect()}
        if not added:
            break
        partition = replace(partition, extended=partition.extended | added)
        if size == DEPTH:
            break
        shared, names = df.sparkSession.sparkContext.broadcast(partition), _WORDS[:size]
        schema = f"lang string, {', '.join(f'{w} string' for w in names)}, n long"
        longer = some.mapInArrow(lambda batches, s=shared, k=size: extensions_of(batches, s.value, k), schema)
        summed = longer.groupBy("lang", *names).agg((F.sum("n") * SAMPLED).alias("f"))
        hot = summed.where(F.col("f") > budget).select("lang", F.array(*names).alias("words"))

    # Single words were only needed to find longer prefixes.
    partition = replace(partition, extended=frozenset(p for p in partition.extended if len(p) > 2))
    shared = df.sparkSession.sparkContext.broadcast(partition)  # a bitmap and a list, each of bounded size
    dealt = docs.mapInArrow(lambda batches: blocks_of(batches, shared.value), "group long, lang string, size long, block binary")
    together = dealt.repartition("group").sortWithinPartitions("group", "lang")
    nodes = together.mapInArrow(lambda batches: subtrees_of(batches, shared.value, least), "lang string, phrase string, size int, f long")
    summed = nodes.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    singles = often.select("lang", "phrase", F.lit(1).alias("size"), "f")
    return written(singles.unionByName(summed)), totals


def _words(phrase: str = "phrase") -> Column:
    return F.split(F.col(phrase), " ")


def _part(words: str, start: int, size: int | Column) -> Column:
    return F.array_join(F.slice(F.col(words), start, size), " ")


def collocations(
    df: DataFrame, text: str = "text", lang: str = "lang", least: int = 30, share: int = 80, best: int | None = 2000
) -> DataFrame:
    """Phrases of two words to ``DEPTH`` that occur ``least`` times, scored by their weakest cut, at most ``best`` a language.

    Cutting a phrase of count a after k words gives l and r, the counts of its two parts, and floor(2000000 a / (l + r)); the
    lowest score counts, the smallest k of equals. A phrase inside a longer one that has ``share`` percent of its count
    or more goes. Returns ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``; ties go by count, then by phrase in byte
    order. Sums and products are exact decimals. An empty table, or texts without words, give no row.
    """
    counts, totals = frequent_phrases(df, text, lang, least)
    longer = counts.where("size > 1").withColumn("words", _words())

    # A part is at least as frequent as its phrase, so every part is in the table.
    cut = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = longer.select("lang", "phrase", F.col("f").alias("a"), "size", "words", cut)
    sides = cuts.select(
        "lang", "phrase", "a", "k",
        F.explode(F.array(
            F.struct(F.lit(True).alias("first"), _part("words", 1, F.col("k")).alias("part")),
            F.struct(F.lit(False).alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("part")),
        )).alias("side"),
    ).select("lang", "phrase", "a", "k", "side.*")
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part"))
    met = sides.join(known, ["lang", "part"])
    whole = "decimal(38,0)"
    of = lambda first: F.max(F.when(F.col("first") == first, F.col("of_part")))
    both = met.groupBy("lang", "phrase", "a", "k").agg(of(True).alias("l"), of(False).alias("r"))
    score = F.expr(f"(cast(a as decimal(20,0)) * 2000000) div (cast(l as {whole}) + cast(r as {whole}))")
    lowest = both.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # The longer phrase of highest count tells whether any covers enough.
    spans = [(start, size) for size in range(2, DEPTH) for start in range(1, DEPTH)]
    inner = F.filter(F.array(*[F.when(F.col("size") >= max(start + size - 1, size + 1), _part("words", start, size)) for start, size in spans]), F.isnotnull)
    inside = longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    covered = F.col("most").cast(whole) * 100 >= F.col("a").cast(whole) * share
    kept = scored.join(inside, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("most")

    order = [F.desc("score"), F.desc("a"), "phrase"]
    if best is not None:
        # First the best of each share of a language, side by side, so that no language meets in one task as a whole.
        dealt = kept.withColumn("__share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
        nth = F.row_number().over(W.partitionBy("lang", "__share").orderBy(*order))
        kept = dealt.withColumn("__nth", nth).where(F.col("__nth") <= best).drop("__share", "__nth")
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
