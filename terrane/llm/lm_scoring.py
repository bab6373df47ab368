"""Cross-entropy difference: how much better a target model predicts a document than a background model.

Two bigram models of the same order, smoothing and vocabulary are counted over whole tables, one on the target
rows and one on all rows. Every word and every pair of words of the corpus is counted, so what is counted grows with it:

    P(w | v) = (count(v, w) + PRIOR * prior(w | v)) / (count(v before a word) + PRIOR),
    prior(w | v) = P(symbol of w | symbol of v) * (count(w) + 1) / total(symbol of w).

The commonest words are symbols of their own (the last factor is 1 for them), the others share hashed symbols. The
background counts every document, so a target document is scored like any other only if the target model has not seen it:
its own words and pairs are taken off ``count`` there, or it would be recognised and not judged. The probabilities of
symbols and the totals, which are tables of fixed size, keep them.

The fixed tables are sent to the tasks, which add up all that they decide. For the rest each text becomes one row of
numbers a distinct pair with a rarer word: hashes of both words and the text, and counts. They are shuffled once, as blocks of
columns, by the rarer word (the second if both are), to parts of some WORDS_A_PART rows that grow in number with the input. A
part is sorted by (word, other word); a word's and a pair's counts are then sums over runs, from which each row gets what it adds
to its text. These sums go back as blocks to where the texts of a block meet, so that Spark sees a row a text. A word that has no symbol of its own has at most 1 / (WORDS + 1) of all tokens, so no run is larger than that, and a
part is larger by such runs at most.
"""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from terrane.llm.common import dropped, without, written

#: Symbols of single words and symbols that words share: the tables of symbols have 1,025 x 1,024 entries at any size.
WORDS = 768
SHARED = 256
SIZE = WORDS + SHARED
#: Weight of the unigram model in the model of symbols, and of that in the bigram model of words, in tokens.
PRIOR = 50.0
REMEMBERED = 300_000
#: Words of the texts that a task turns into rows at a time.
WORDS_A_CHUNK = 200_000
#: Rows that a task gathers before it deals them out in blocks, and rows of a part.
ROWS_A_FLUSH, WORDS_A_PART = 1_000_000, 1_000_000
#: What is known of a row: its text is a target text, is counted, is scored; the pair ends its text; the word does.
TARGET, COUNTED, ASKED, LAST, FINAL = 1, 2, 4, 8, 16
FLAG_BITS, COUNT_BITS = 5, 29
#: The other word of a row: a rarer word before, a word with a symbol of its own before, or such a word after.
BEFORE, KNOWN, AFTER = 0, 1, 2
BY_BITS = 32
LOW = (1 << 32) - 1
#: So many keys of the target are sent to the tasks (some 50 MB); more are joined by a shuffle.
SENT_KEYS = 1_000_000


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Numbered(dict):
    """Numbers of words in order of appearance, with a hash and a symbol each; 0 is the mark before the first word of a text."""

    def __init__(self, vocabulary: list[str]) -> None:
        super().__init__()
        self.hashes, self.symbols = array("Q", [0]), array("q", [SIZE])
        for at, word in enumerate(vocabulary):
            self.add(word, at)

    def add(self, word: str, symbol: int | None = None) -> int:
        """Low 32 bits of the hash give the shared symbol."""
        said = word.encode("utf-8", "replace")
        crc = zlib.crc32(said)
        self.hashes.append(xxhash.xxh32_intdigest(said) << 32 | crc)
        self.symbols.append(WORDS + crc % SHARED if symbol is None else symbol)
        found = self[word] = len(self.symbols) - 1
        return found

    __missing__ = add

    def of(self, text: str | None) -> np.ndarray:
        said = words(text)
        return np.fromiter(map(self.__getitem__, said), dtype=np.int64, count=len(said))


def renewed(held: Numbered | None, vocabulary: list[str]) -> Numbered:
    """``held``, or a new one once it remembers too many words."""
    return Numbered(vocabulary) if held is None or len(held) > REMEMBERED else held


@dataclass(frozen=True)
class Chunk:
    """Some texts with words as numbers in a row: where each starts and ends, its name and flag, and each word with the one before."""

    held: Numbered
    names: list
    flags: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    now: np.ndarray
    before: np.ndarray

    def codes(self) -> np.ndarray:
        """(symbol before) * SIZE + symbol of each word."""
        symbols = np.array(self.held.symbols, dtype=np.int64)
        return symbols[self.before] * SIZE + symbols[self.now]


def chunks(texts: Iterator[tuple], vocabulary: list[str]) -> Iterator[Chunk]:
    """Texts with words, out of (text, name, flag), in chunks of some WORDS_A_CHUNK words."""
    held, size, kept, names, flags = None, 0, [], [], []

    def made() -> Chunk:
        sizes = np.array([len(t) for t in kept])
        now, ends = np.concatenate(kept), np.cumsum(sizes)
        before = np.append(0, now[:-1])
        before[ends - sizes] = 0
        return Chunk(held, names, np.array(flags), ends - sizes, ends, np.repeat(np.arange(len(kept)), sizes), now, before)

    for value, name, flag in texts:
        if not kept:
            held = renewed(held, vocabulary)
        found = held.of(value)
        if len(found):
            kept.append(found)
            names.append(name)
            flags.append(flag)
            size += len(found)
        if size > WORDS_A_CHUNK:
            yield made()
            size, kept, names, flags = 0, [], [], []
    if kept:
        yield made()


@dataclass(frozen=True)
class Symbols:
    """One model's tables of fixed size."""

    losses: np.ndarray  # negative log probability of a symbol after another, by code
    counts: np.ndarray  # counts of codes
    before: np.ndarray  # counts of a symbol, or the mark, before another
    totals: np.ndarray  # by shared symbol: counts of its words, one more for each word and one for words never seen


def count_words(marked: DataFrame) -> DataFrame:
    """(word, every, wanted): counts of each word in all rows and in target rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every: Counter[str] = Counter()
        wanted: Counter[str] = Counter()

        def shown() -> pd.DataFrame:
            return pd.DataFrame({"word": list(every), "every": list(every.values()), "wanted": [wanted[w] for w in every]})

        for batch in batches:
            for value, inside in zip(batch["__text"], batch["__in"], strict=True):
                found = words(value)
                every.update(found)
                if inside:
                    wanted.update(found)
                if len(every) > REMEMBERED:
                    yield shown()
                    every.clear()
                    wanted.clear()
        if every:
            yield shown()

    found = marked.select("__text", "__in").mapInPandas(run, "word string, every long, wanted long")
    return found.groupBy("word").agg(F.sum("every").alias("every"), F.sum("wanted").alias("wanted"))


def _vocabulary(counted: DataFrame) -> list[str]:
    """The commonest words, which get symbols of their own."""
    return [r["word"] for r in counted.orderBy(F.desc("every"), "word").limit(WORDS).collect()]


def symbol_losses(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of symbols after symbols from the counts of codes, the unigram model as prior."""
    table = counts.reshape(SIZE + 1, SIZE).astype(np.float64)
    single = (table.sum(axis=0) + 1) / (table.sum() + SIZE)
    return -np.log((table + PRIOR * single) / (table.sum(axis=1, keepdims=True) + PRIOR)).astype(np.float32).reshape(-1)


def count_symbols(marked: DataFrame, vocabulary: list[str], counted: DataFrame) -> dict[str, Symbols]:
    """The tables of the target (``wanted``) and the background model (``every``)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        every = np.zeros((SIZE + 1) * SIZE, dtype=np.int64)
        wanted = np.zeros_like(every)
        rows = ((t, None, i) for batch in batches for t, i in zip(batch["__text"], batch["__in"], strict=True))
        for chunk in chunks(rows, vocabulary):
            codes = chunk.codes()
            every += np.bincount(codes, minlength=len(every))
            wanted += np.bincount(codes[chunk.flags[chunk.text]], minlength=len(every))
        codes = np.flatnonzero(every)
        for part in np.array_split(codes, max(1, len(codes) // 50_000)):
            yield pd.DataFrame({"code": part, "every": every[part], "wanted": wanted[part]})

    found = marked.select("__text", "__in").mapInPandas(run, "code long, every long, wanted long")
    # At most (SIZE + 1) * SIZE rows.
    summed = found.groupBy("code").agg(F.sum("every").alias("every"), F.sum("wanted").alias("wanted")).toArrow()
    symbol = (F.crc32(F.col("word").cast("binary")) % SHARED).cast("int")
    others = counted.where(~F.col("word").isin(vocabulary)) if vocabulary else counted
    sums = others.groupBy(symbol.alias("s")).agg(*[(F.sum(c) + F.count(F.lit(1))).alias(c) for c in ("every", "wanted")])
    of_symbol = sums.collect()  # at most SHARED rows
    made = {}
    for name in ("wanted", "every"):
        counts = np.zeros((SIZE + 1) * SIZE, dtype=np.int64)
        counts[summed["code"].to_numpy()] = summed[name].to_numpy()
        totals = np.ones(SHARED)
        for r in of_symbol:
            totals[r["s"]] += r[name]
        made[name] = Symbols(symbol_losses(counts), counts, counts.reshape(SIZE + 1, SIZE).sum(axis=1), totals)
    return made


def _packed(column: np.ndarray) -> bytes:
    """Numbers with their bytes by place: the upper ones, mostly zero, come together and compress."""
    return column.view(np.uint8).reshape(-1, column.itemsize).T.tobytes()


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _pair_rows(chunk: Chunk) -> tuple[np.ndarray, ...]:
    """(at, by, text, more): a row for each text and distinct pair of words of which one has no symbol of its own.

    ``at`` is the hash of that word, of the second if both are such; ``by`` the hash or symbol of the other one and what
    it is; ``text`` the place of the text in the chunk; ``more`` how often the text has the pair and the word, and flags.
    """
    hashes, symbols = np.array(chunk.held.hashes, dtype=np.uint64), np.array(chunk.held.symbols, dtype=np.int64)
    bits = len(symbols).bit_length()
    key = (chunk.text << 2 * bits) | (chunk.now << bits) | chunk.before
    last = key[chunk.ends - 1]
    found, n = np.unique(key, return_counts=True)
    starts = np.flatnonzero(np.append(True, (found[1:] >> bits) != (found[:-1] >> bits)))
    said = np.repeat(np.add.reduceat(n, starts), np.diff(np.append(starts, len(found))))
    mask = (1 << bits) - 1
    text, w, v = found >> 2 * bits, (found >> bits) & mask, found & mask
    known = (symbols[v] < WORDS) | (v == 0)
    rarer = symbols[w] >= WORDS
    kept = rarer | ~known
    flags = chunk.flags[text] + np.where(last[text] == found, LAST, 0) + np.where(last[text] >> bits == found >> bits, FINAL, 0)
    low = (hashes & np.uint64(LOW)).astype(np.int64)
    by = np.where(rarer, np.where(known, KNOWN << BY_BITS | symbols[v], low[v]), AFTER << BY_BITS | symbols[w])
    at = np.where(rarer, hashes[w], hashes[v])
    more = (n << COUNT_BITS + FLAG_BITS) | (said << FLAG_BITS) | flags
    return at[kept], by[kept], text[kept], more[kept]


def _blocks(marked: DataFrame, vocabulary: list[str], use: int, tables: dict[str, Symbols], parts: int) -> DataFrame:
    """Blocks of the rows of pairs by part of ``at``; and blocks of scored texts with their tokens and what the fixed tables add to their losses."""
    # Of fixed size.
    shared = marked.sparkSession.sparkContext.broadcast((vocabulary, tables["wanted"], _seen(tables["wanted"]), _seen(tables["every"])))
    columns = ["part", "flush", "words", "runs", "by", "place", "more", "names", "own", "fixed"]

    def fixed(chunk: Chunk, own: np.ndarray) -> np.ndarray:
        _, wanted, *seen = shared.value
        codes = chunk.codes()
        sums = np.array([chunk.ends - chunk.starts, *[np.add.reduceat(table[codes], chunk.starts) for table in seen]], dtype=np.float64)
        for i in np.flatnonzero(own):
            sums[1, i] = _left_out(codes[chunk.starts[i] : chunk.ends[i]], wanted)
        return sums

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        names: list[np.ndarray] = []
        owns: list[np.ndarray] = []
        sums: list[np.ndarray] = []
        size = texts = 0

        def shown() -> pd.DataFrame:
            nonlocal size, texts
            at, by, text, more = (np.concatenate(c) for c in zip(*held, strict=True))
            # Texts are known by their place among those gathered; equal lists of texts may share a name, as their sums are added up.
            name, own = np.concatenate(names).tobytes(), np.concatenate(owns).tobytes()
            flush = xxhash.xxh64_intdigest(name + own) - (1 << 63)
            order = np.argsort(at)
            at, by, text, more = at[order], by[order], text[order], more[order]
            # Parts are ranges of the upper half of the hash.
            edges = np.searchsorted(at >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64) * np.uint64((1 << 32) // parts + 1))
            out, empty = [], b""
            for part, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
                if i == j:
                    continue
                new = np.flatnonzero(np.append(True, at[i + 1 : j] != at[i : j - 1]))
                runs = np.diff(np.append(new, j - i))
                out.append((part, flush, _packed(at[i:j][new]), _packed(runs), _packed(by[i:j]), _packed(text[i:j].astype(np.uint32)), _packed(more[i:j]), empty, empty, empty))
            if use & ASKED:
                out.append((flush % parts, flush, empty, empty, empty, empty, empty, name, own, np.concatenate(sums, axis=1).tobytes()))
            for kept in (held, names, owns, sums):
                kept.clear()
            size = texts = 0
            return pd.DataFrame(out, columns=columns)

        rows = ((t, name, use + TARGET * i) for batch in batches for t, name, i in batch[["__text", "__t", "__in"]].itertuples(index=False))
        for chunk in chunks(rows, shared.value[0]):
            at, by, text, more = _pair_rows(chunk)
            own = (chunk.flags & (COUNTED | TARGET)) == (COUNTED | TARGET)
            held.append((at, by, text + texts, more))
            names.append(np.array(chunk.names, dtype=np.int64))
            owns.append(own)
            if use & ASKED:
                sums.append(fixed(chunk, own))
            size += len(at)
            texts += len(own)
            if size >= ROWS_A_FLUSH:
                yield shown()
        if held:
            yield shown()

    rows = marked.where("__text is not null").select("__text", "__t", "__in")
    binary = ", ".join(f"{c} binary" for c in columns[2:])
    return rows.mapInPandas(run, f"part int, flush long, {binary}")


SUMS = ["flush", "place", "target", "background", "names", "own", "fixed"]


def _sums_of(rows: pd.DataFrame, tables: dict[str, tuple]) -> pd.DataFrame:
    """(flush, place, target, background, ...) by block of one part: what its pairs add to each text; blocks of texts go on as they are."""
    whole = rows["names"].map(len).to_numpy() > 0
    passed, rows = rows[whole], rows[~whole]
    empty = [b""] * len(passed)
    out = [pd.DataFrame({"flush": passed["flush"], "place": empty, "target": empty, "background": empty, **{c: passed[c] for c in SUMS[4:]}})]
    if not len(rows):
        return out[0]
    read = lambda c, kind: [_unpacked(x, kind) for x in rows[c]]
    at = np.concatenate([np.repeat(w, r) for w, r in zip(read("words", np.uint64), read("runs", np.int64), strict=True)])
    by = np.concatenate(read("by", np.int64))
    places = [p.astype(np.int64) for p in read("place", np.uint32)]
    ends_of = np.cumsum([p.max() + 1 for p in places])
    starts_of = np.append(0, ends_of[:-1])
    place = np.concatenate([p + x for p, x in zip(places, starts_of, strict=True)])
    more = np.concatenate(read("more", np.int64))
    made = {}
    if len(at):
        order = np.argsort(at)
        key = (np.cumsum(np.append(0, np.diff(at[order]) != 0)) << BY_BITS + 2) | by[order]
        again = np.argsort(key)
        key, order = key[again], order[again]
        at, by, place, more = at[order], by[order], place[order], more[order]
        pairs = np.append(True, key[1:] != key[:-1])
        words_ = np.append(True, key[1:] >> BY_BITS + 2 != key[:-1] >> BY_BITS + 2)
        has = lambda f: (more & f) == f
        kind, other, shared_symbol = by >> BY_BITS, by & LOW, WORDS + (at & np.uint64(LOW)).astype(np.int64) % SHARED
        is_word = rarer = kind != AFTER
        n = more >> COUNT_BITS + FLAG_BITS

        def over(values: np.ndarray, new: np.ndarray) -> np.ndarray:
            return np.add.reduceat(values, np.flatnonzero(new))[np.cumsum(new) - 1]

        counts = {}
        for name, held in (("every", has(COUNTED)), ("wanted", has(COUNTED | TARGET))):
            counted = np.where(held, n, 0)
            ends = (is_word & held & has(LAST)).astype(np.int64)
            counts[name] = over(counted, pairs), over(np.where(is_word, counted, 0), words_), over(ends, words_)
        asked = np.flatnonzero(has(ASKED))
        said = (more >> FLAG_BITS) & ((1 << COUNT_BITS) - 1)
        n, said, kind, other, shared_symbol, rarer, place = (x[asked] for x in (n, said, kind, other, shared_symbol, rarer, place))
        symbol = np.where(rarer, shared_symbol, other)
        first = np.where(rarer, np.where(kind == KNOWN, other, WORDS + other % SHARED), shared_symbol)
        code = first * SIZE + symbol
        last, final, taken = has(LAST)[asked], has(FINAL)[asked], has(COUNTED | TARGET)[asked]
        for name, own in (("wanted", taken), ("every", np.False_)):
            losses, totals = tables[name]
            in_pair, in_word, ends = (x[asked] for x in counts[name])
            before = in_word - ends - own * (said - final)
            of_word = np.where(rarer, totals[np.maximum(symbol - WORDS, 0)] - np.log1p(np.where(rarer, in_word - own * said, 0.0)), 0.0)
            prior = np.exp(-(losses[code].astype(np.float64) + of_word))
            of_before = np.where(rarer, (n - last) * np.log1p(np.where(rarer, before, 0.0) / PRIOR), 0.0)
            added = n * of_word + of_before - n * np.log1p((in_pair - own * n) / (PRIOR * prior))
            made[name] = np.bincount(place, weights=added, minlength=int(ends_of[-1])).astype(np.float32)
        met = np.flatnonzero(np.bincount(place, minlength=int(ends_of[-1])))
        cuts = np.searchsorted(met, np.append(starts_of, ends_of[-1])).tolist()
        found = [(flush, met[i:j] - x, met[i:j]) for flush, x, i, j in zip(rows["flush"].tolist(), starts_of, cuts, cuts[1:]) if i < j]
        of_pairs = [(flush, _packed(p.astype(np.uint32)), made["wanted"][m].tobytes(), made["every"][m].tobytes(), b"", b"", b"") for flush, p, m in found]
        out.append(pd.DataFrame(of_pairs, columns=SUMS))
    return pd.concat(out, ignore_index=True)


def _of_texts(rows: pd.DataFrame) -> pd.DataFrame:
    """(text, own, copies, tokens, target, background) of the texts of one flush from all blocks of their sums."""
    whole = rows["names"].map(len).to_numpy() > 0
    texts = rows[whole]
    names = np.frombuffer(texts["names"].iloc[0], dtype=np.int64)
    tokens, *sums = sum(np.frombuffer(x).reshape(3, -1) for x in texts["fixed"])
    pairs = rows[~whole]
    if len(pairs):
        place = np.concatenate([_unpacked(x, np.uint32) for x in pairs["place"]]).astype(np.int64)
        for i, name in enumerate(("target", "background")):
            added = np.frombuffer(b"".join(pairs[name]), dtype=np.float32).astype(np.float64)
            sums[i] = sums[i] + np.bincount(place, weights=added, minlength=len(names))
    own = np.frombuffer(texts["own"].iloc[0], dtype=bool)
    return pd.DataFrame({"text": names, "own": own, "copies": len(texts), "tokens": tokens.astype(np.int64), "target": sums[0], "background": sums[1]})


def _together(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """All rows of a key at a time; they come sorted by it."""
    wait: list[pd.DataFrame] = []
    for batch in batches:
        for value, rows in batch.groupby(key, sort=True):
            if wait and wait[0][key].iloc[0] != value:
                yield pd.concat(wait, ignore_index=True)
                wait = []
            wait.append(rows)
    if wait:
        yield pd.concat(wait, ignore_index=True)


def _added(blocks: DataFrame, tables: dict[str, Symbols]) -> DataFrame:
    """(text, own, copies, tokens, target, background): sums of tokens and losses of each scored text over its copies."""
    # Of fixed size.
    shared = blocks.sparkSession.sparkContext.broadcast({c: (t.losses, np.log(t.totals)) for c, t in tables.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _together(batches, "part"):
            yield _sums_of(rows, shared.value)

    def of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _together(batches, "flush"):
            yield _of_texts(rows)

    dealt = blocks.repartition("part").sortWithinPartitions("part")
    back = dealt.mapInPandas(run, "flush long, " + ", ".join(f"{c} binary" for c in SUMS[1:]))
    dealt = back.repartition("flush").sortWithinPartitions("flush")
    each = dealt.mapInPandas(of_texts, "text long, own boolean, copies long, tokens long, target double, background double")
    return each.groupBy("text", "own").agg(*[F.sum(c).alias(c) for c in ("copies", "tokens", "target", "background")])


def _seen(table: Symbols) -> np.ndarray:
    """By code: loss of a symbol after another with the counts of what follows words with symbols of their own, and of pairs of such."""
    out = table.losses.astype(np.float64).reshape(SIZE + 1, SIZE)
    known = [*range(WORDS), SIZE]
    gain = np.log1p(table.counts.reshape(SIZE + 1, SIZE)[known, :WORDS] / (PRIOR * np.exp(-out[known, :WORDS])))
    out[known] += np.log1p(table.before[known] / PRIOR)[:, None]
    out[known, :WORDS] -= gain
    return out.reshape(-1)


def _left_out(codes: np.ndarray, table: Symbols) -> float:
    """Sum of a text's losses as in _seen, its own pairs taken off the counts."""
    a, b = codes // SIZE, codes % SIZE
    known = (a < WORDS) | (a == SIZE)
    found, n = np.unique(codes[known & (b < WORDS)], return_counts=True)
    first, m = np.unique(a[known], return_counts=True)
    prior = np.exp(-table.losses[found].astype(np.float64))
    of_pairs = (n * np.log1p((table.counts[found] - n) / (PRIOR * prior))).sum()
    return float(table.losses[codes].sum(dtype=np.float64) + (m * np.log1p((table.before[first] - m) / PRIOR)).sum() - of_pairs)


def score(df: DataFrame, target: DataFrame, corpus: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``target_loss``, ``background_loss`` (means a token, in nats) and ``score``, their difference.

    The background model counts all rows of ``corpus`` and the target model those whose key is in ``target``. Without
    ``corpus`` the rows of ``df`` are counted, and a target text is scored by what the other target texts count. The lower
    the score, the more a text reads like the target.

    Words are what lies between blanks, in lower case. A text that is null or has no words has 0 tokens and null
    for the rest. A row without a key is in no target. Repeated rows count as often as they come, and one of them
    is taken off; equal texts get equal scores unless one is a target text and the other not. Of words that are equally common,
    the smaller get symbols. Texts of any length are scored whole. Empty tables give no rows, an empty target a model
    that knows only its prior. Input columns of the four names are replaced, whatever their case; names with two
    underscores in front are taken. Texts are told apart by 64 bits of a hash, words by as many, words before the same
    word by 32.
    """

    chosen = target.select(F.col(f"`{key}`").alias("__key")).where("__key is not null").distinct().withColumn("__chosen", F.lit(True))
    fixed = not isinstance(chosen.schema["__key"].dataType, (StringType, BinaryType))
    few = fixed and chosen.limit(SENT_KEYS + 1).count() <= SENT_KEYS

    def marked(rows: DataFrame) -> DataFrame:
        named = rows.withColumns({"__key": F.col(f"`{key}`"), "__text": F.col(f"`{text}`")})
        met = named.join(F.broadcast(chosen) if few else chosen, "__key", "left").withColumn("__in", F.coalesce("__chosen", F.lit(False)))
        return met.withColumn("__t", F.xxhash64("__text")).drop("__key", "__chosen")

    alone = corpus is None
    plain = without(df, "n_tokens", "target_loss", "background_loss", "score")
    asked = marked(plain)
    held = (asked if alone else marked(corpus.select(F.col(f"`{key}`"), F.col(f"`{text}`")))).select("__text", "__t", "__in")
    held = held if few else written(held)  # read three times, met with the keys once
    counted = written(count_words(held))
    vocabulary = _vocabulary(counted)
    tables = count_symbols(held, vocabulary, counted)
    dropped(counted)
    parts = max(1, int(tables["every"].counts.sum()) // WORDS_A_PART)
    blocks = _blocks(held, vocabulary, COUNTED | ASKED if alone else COUNTED, tables, parts)
    if not alone:
        blocks = blocks.unionByName(_blocks(asked, vocabulary, ASKED, tables, parts))
    # Copies of a text come together, so its means are theirs; texts without words have no row.
    added = written(_added(blocks, tables)).where("copies > 0").select(F.col("text").alias("__t"), F.col("own").alias("__own"), *[F.col(c).alias(f"__{c}") for c in ("copies", "tokens", "target", "background")])
    n_tokens = F.coalesce(F.expr("__tokens div __copies"), F.lit(0).cast("long")).alias("n_tokens")
    losses = [(F.col(f"__{c}") / F.col("__tokens")).alias(f"{c}_loss") for c in ("target", "background")]
    return (
        asked.withColumn("__own", F.col("__in") & F.lit(alone))
        .join(added, ["__t", "__own"], "left")
        .select(*[F.col(f"`{c}`") for c in plain.columns], n_tokens, *losses)
        .withColumn("score", F.col("target_loss") - F.col("background_loss"))
    )
