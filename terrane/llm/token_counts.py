"""Token counts of a byte-level BPE vocabulary by a whole-token shortcut.

Most pre-tokens of a text are vocabulary strings that encode alone as one token. Which ones do is proved
once, on the driver, by merging every vocabulary string from its bytes: those that end as one symbol
count 1 without any merging. Only the other pre-tokens are merged, and only their number of symbols is kept.

Pre-tokens are cut by a pattern whose letters, numbers and blanks must be those of the tokenizers library.
The driver asks the library for each code point of ``PROBED``; a text with any other code point, or one on
which the two differ, is cut by the library itself, so the counts do not depend on Unicode versions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from terrane.llm.common import whole_text, without

#: Fixed values of the byte-level scheme: how a text is cut into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points looked up in the library: alphabets and punctuation, East Asian signs, Hangul, wide forms.
PROBED = ((0x0, 0x3000), (0x3000, 0xA000), (0xAC00, 0xD7A4), (0xFF00, 0xFFF0))
#: A worker keeps the counts of twice so many merged pre-tokens, none longer than the limit.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64
#: Up to so many symbols the best pair is found by scanning, beyond by a heap.
SCANNED = 48
NO_MERGE = 1 << 60


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(shown)))
    return letters


@dataclass(frozen=True)
class Vocabulary:
    """What the driver proved, as wide as the vocabulary (a few MB), and what workers need to merge the rest."""

    whole: frozenset[str]  # pre-tokens that are one token
    ranks: dict[int, int]  # rank by the numbers of two symbols: left << 32 | right; bytes are their own numbers
    made: list[int]  # the symbol that each merge makes
    special: tuple[str, ...]
    unsure: str  # code points at which a text is cut by the library, as a pattern

    def merged(self, symbols: list[int]) -> int:
        """Number of symbols left after merging: lowest rank first, leftmost of equals."""
        if len(symbols) > SCANNED:
            return self._merged_long(symbols)
        rank = self.ranks.get
        ranks = [rank(a << 32 | b, NO_MERGE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NO_MERGE:
                break
            i = ranks.index(best)
            made = symbols[i] = self.made[best]
            del symbols[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(symbols[i - 1] << 32 | made, NO_MERGE)
            if i < len(ranks):
                ranks[i] = rank(made << 32 | symbols[i + 1], NO_MERGE)
        return len(symbols)

    def _merged_long(self, symbols: list[int]) -> int:
        """The same by a heap and links, so that a long run without blanks takes n log n steps."""
        n, rank = len(symbols), self.ranks.get
        after, before, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
        pairs = enumerate(zip(symbols, symbols[1:], strict=False))
        heap = [(r, i, a, b) for i, (a, b) in pairs if (r := rank(a << 32 | b)) is not None]
        heapify(heap)
        while heap:
            r, i, a, b = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue  # one of the two was merged before
            made = symbols[i] = self.made[r]
            symbols[j] = -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(made << 32 | symbols[k])) is not None:
                    heappush(heap, (r, i, made, symbols[k]))
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] << 32 | made)) is not None:
                heappush(heap, (r, h, symbols[h], made))
        return left

    def of_pre_token(self, text: str) -> int:
        return self.merged(list(text.encode("utf-8")))


class Counts(dict):
    """Tokens of a pre-token: 1 for whole ones; others are merged once and remembered in two generations of bounded size."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary
        self.older: dict[str, int] = {}
        self.renew()

    def renew(self) -> None:
        self.older = dict(self)
        self.clear()
        self.update(dict.fromkeys(self.vocabulary.whole, 1))
        self.most = len(self) + REMEMBERED

    def __missing__(self, text: str) -> int:
        found = self.older.get(text)
        if found is None:
            found = self.vocabulary.of_pre_token(text)
        if len(text) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.renew()
            self[text] = found
        return found


class Counter:
    """Counts the tokens of whole texts; one a task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.cut = regex.compile(PRE_TOKEN).findall
        # The same on ASCII, where letters and numbers are plain ranges.
        self.cut_ascii = re.compile(PRE_TOKEN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"), re.ASCII).findall
        self.unsure = regex.compile(vocabulary.unsure).search
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)
        found = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, found))) if found else None
        self.counts = Counts(vocabulary)

    def pre_tokens(self, text: str) -> Iterable[str]:
        if text.isascii():
            return self.cut_ascii(text)
        if not self.unsure(text):
            return self.cut(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def of_text(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        # Each special string between two parts is one token.
        return len(parts) - 1 + sum(sum(map(self.counts.__getitem__, self.pre_tokens(part))) for part in parts)


def unsure_pattern() -> str:
    """A pattern for the code points that were not probed or that the library puts into another class."""
    library, cut = pre_tokenizers.ByteLevel(add_prefix_space=False), regex.compile(PRE_TOKEN)

    def differ(points: list[int]) -> Iterator[int]:
        # After a letter, a number, a mark and a blank the class of a code point shows in the cuts.
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}x" for c in points)
        if [span for _, span in library.pre_tokenize_str(text)] == [m.span() for m in cut.finditer(text)]:
            return
        if len(points) == 1:
            yield points[0]
            return
        half = len(points) // 2
        yield from differ(points[:half])
        yield from differ(points[half:])

    odd = [c for low, high in PROBED for start in range(low, high, 512) for c in differ(list(range(start, min(high, start + 512))))]
    probed = "".join(f"\\U{low:08X}-\\U{high - 1:08X}" for low, high in PROBED)
    differing = "".join(f"\\U{c:08X}" for c in odd)
    return f"[^{probed}]" + (f"|[{differing}]" if odd else "")


def read_vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE file of the tokenizers library and prove which of its strings are whole tokens.

    Files with a normaliser, another way of cutting, dropout or special strings that take blanks along are refused.
    """
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    model, cut = held["model"], held["pre_tokenizer"]
    plain = cut == cut | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} and held["normalizer"] is None
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    flags = [t["content"] for t in held["added_tokens"] if not t["special"] or t["lstrip"] or t["rstrip"] or t["single_word"]]
    if model["type"] != "BPE" or not plain or odd or flags:
        raise ValueError(f"only plain byte-level BPE files are taken: {odd or flags or cut}")
    number = {letter: b for b, letter in byte_letters().items()}
    byte_of, ranks, made = dict(number), {}, []
    for rank, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        made.append(number.setdefault(left + right, len(number)))
        ranks[number[left] << 32 | number[right]] = rank
    special = tuple(t["content"] for t in held["added_tokens"])
    bare = Vocabulary(frozenset(), ranks, made, special, unsure_pattern())
    whole = set()
    for token in model["vocab"]:
        raw = bytes(byte_of[c] for c in token) if token not in special else b""
        if raw and bare.merged(list(raw)) == 1:
            try:
                whole.add(raw.decode("utf-8"))
            except UnicodeDecodeError:
                pass  # a part of a character: never a pre-token by itself
    return replace(bare, whole=frozenset(whole))


def count_tokens(df: DataFrame, vocabulary: Vocabulary, text: str = "text", limit: int = 1024) -> DataFrame:
    """Add ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more tokens than ``limit``) for every whole text.

    No begin or end tokens, no truncation; special strings inside a text count as one token each. A null text
    counts as empty: 0 bytes, 0 tokens. Copies and equal keys stay rows of their own; an empty table gives none.
    Input columns of the three names are replaced, whatever their case. Nothing is shuffled. A text is cut whole, so a
    very long one takes memory in proportion to its own length.
    """
    plain = without(df, "n_bytes", "n_tokens", "over_limit")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # as wide as the vocabulary file

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(shared.value)
        for series in texts:
            yield pd.Series([counter.of_text(x) if x else 0 for x in series], dtype="int64")

    counted = plain.withColumn("__tokens", F.pandas_udf(run, "long")(F.col(f"`{text}`")))
    return counted.select(
        *[F.col(f"`{c}`") for c in plain.columns],
        F.octet_length(whole_text(f"`{text}`")).cast("long").alias("n_bytes"),
        F.col("__tokens").alias("n_tokens"),
        (F.col("__tokens") > limit).alias("over_limit"),
    )
