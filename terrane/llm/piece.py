"""Byte-pair pieces by a merge-type prefix table, and decoding.

For every prefix of a text exactly one piece can be last in its encoding. The table is filled from left to right:
an automaton gives the pieces that end at a place, and the right one is the one that may follow the
last piece of what is before it. Two pieces may follow one another when merging their joined text
gives exactly these two. The encoding is read from the table backwards.

Texts are cut where no piece reaches across, so equal stretches are encoded once and remembered.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from heapq import merge
from operator import itemgetter

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrane.llm.common import without

SPACE = "▁"
#: A worker keeps twice so many stretches, none longer than the limit, and twice so many tested pairs, from task to task.
REMEMBERED = 100_000
LONGEST_REMEMBERED = 64
PAIRS_REMEMBERED = 150_000


class Pieces:
    """The pieces of a model file of the merge type, read through its library; ids come from the table below."""

    def __init__(self, proto: bytes) -> None:
        held = sentencepiece.SentencePieceProcessor(model_proto=proto)
        count = held.get_piece_size()
        self.surface = [held.id_to_piece(i) for i in range(count)]
        self.bytes_of = {i: int(self.surface[i][3:5], 16) for i in range(count) if held.is_byte(i)}
        special = {i for i in range(count) if held.is_byte(i) or held.is_control(i) or held.is_unknown(i) or held.is_unused(i)}
        self.special = special
        self.id_of = {self.surface[i]: i for i in range(count) if i not in special}
        self.rank = {p: -held.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = {b: i for i, b in self.bytes_of.items()}
        self.unknown = held.unk_id()
        self.characters = {p for p in self.id_of if len(p) == 1}
        self.follow: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self._followed: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self._tested = 0
        self.encoded: dict[str, tuple[int, str, str]] = {}
        self._older: dict[str, tuple[int, str, str]] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging, best pair first and the leftmost of equals; only for short strings, in tests of pairs."""
        none, rank, parts = float("inf"), self.rank.get, list(text)
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    @cached_property
    def whole_pieces(self) -> frozenset[str]:
        """The pieces that merging can make of their own text."""
        return frozenset(p for p in self.id_of if len(p) == 1 or self.merged(p) == [p])

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Finds all pieces that merging can make."""
        found = ahocorasick.Automaton()
        for piece in self.whole_pieces:
            found.add_word(piece, (piece, len(piece)))
        found.make_automaton()
        return found

    @cached_property
    def cut(self) -> re.Pattern[str]:
        """Cuts a text where no piece reaches across: before blanks and around marks that join with no letter."""
        inside = {a + b for p in self.id_of for a, b in zip(p, p[1:], strict=False)}
        if any(b[0] != SPACE and b[1] == SPACE for b in inside):
            return re.compile(r"(?s).+")
        marks = ".,;:!?"
        joined = {c for b in inside for c in b if any(m in b for m in marks)} - set(marks)
        odd = re.escape("".join(sorted(c for c in joined if re.match(r"[^\W\d_]", c))))
        letter = rf"[^\W\d_{odd}]"  # letters that join with none of the marks
        line = "" if any("\n" in b for b in inside) else "\\n"
        ways = [f"{SPACE}*{letter}++(?=[{marks}])", f"[{marks}]+(?={letter}|[{SPACE}{line}]|\\Z)"]
        ways += [f"{line}+"] if line else []
        return re.compile("|".join([*ways, f"{SPACE}*[^{SPACE}{line}]+", f"{SPACE}+"]))

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives these two; remembered."""
        if self._tested >= PAIRS_REMEMBERED:
            # The generation before the last goes; the dictionary itself stays, as callers hold it.
            self._followed = self.follow.copy()
            self.follow.clear()
            self._tested = 0
        self._tested += 1
        older = self._followed.get(left)
        found = None if older is None else older.get(right)
        if found is None:
            found = self.merged(left + right) == [left, right]
        self.follow[left][right] = found
        return found

    def split(self, text: str) -> list[str]:
        """The pieces of a text, by the prefix table: ``last`` holds the last piece of each prefix."""
        size = len(text)
        last: list[str] = [""] * size
        follow = self.follow
        matches = self.automaton.iter(text)
        if not self.characters.issuperset(text):
            # A character outside the vocabulary is a piece by itself.
            alone = [(i, (c, 1)) for i, c in enumerate(text) if c not in self.characters]
            matches = merge(matches, alone, key=itemgetter(0))
        for end, (piece, length) in matches:
            if last[end]:
                continue
            before = end - length
            if before < 0:
                last[end] = piece
            else:
                left = last[before]
                fits = follow[left].get(piece)
                if fits or fits is None and self.may_follow(left, piece):
                    last[end] = piece
        found, end = [], size - 1
        while end >= 0:
            piece = last[end]
            if not piece:
                raise ValueError(f"no piece fits at {end} of {text[:80]!r}")
            found.append(piece)
            end -= len(piece)
        return found[::-1]

    def ids(self, text: str) -> list[int]:
        """Ids of a stretch of normalised text; characters outside the vocabulary become bytes."""
        out: list[int] = []
        for piece in self.split(text):
            known = self.id_of.get(piece)
            if known is not None:
                out.append(known)
            elif self.byte_id:
                out += [self.byte_id[b] for b in piece.encode("utf-8")]
            else:
                out.append(self.unknown)
        return out

    def shown(self, ids: list[int]) -> str:
        """Text of ids without the blank that encoding puts first."""
        if self.special.isdisjoint(ids):
            return "".join([self.surface[i] for i in ids]).replace(SPACE, " ")
        out, raw = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                raw.append(self.bytes_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i == self.unknown:
                out.append(" ⁇ ")
            elif i not in self.special:
                out.append(self.surface[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        text = self.shown(ids)
        return text[1:] if text.startswith(" ") and ids and ids[0] not in self.bytes_of else text

    def stretch(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal and decoded text of one stretch, kept for the next time."""
        found = self._older.get(text)
        if found is None:
            ids = self.ids(text)
            found = (len(ids), ",".join(map(str, ids)), self.shown(ids))
        if len(text) <= LONGEST_REMEMBERED:
            if len(self.encoded) >= REMEMBERED:
                self._older, self.encoded = self.encoded, {}
            self.encoded[text] = found
        return found

    def whole(self, text: str) -> tuple[int, str, str]:
        """The same for a whole text: the blank put before it is taken off again."""
        if not text:
            return 0, "", ""
        stretches = self.cut.findall(SPACE + text.replace(" ", SPACE))
        get = self.encoded.get
        parts = [get(x) or self.stretch(x) for x in stretches]
        counts, ids, shown = zip(*parts, strict=True)
        return sum(counts), ",".join(ids), "".join(shown)[1:]


_loaded: dict[bytes, Pieces] = {}


def pieces_of(proto: bytes) -> Pieces:
    """The tables of a model, built once a worker."""
    key = hashlib.sha256(proto).digest()
    if key not in _loaded:
        _loaded[key] = Pieces(proto)
    return _loaded[key]


def read_model(path: str) -> bytes:
    """A model file as bytes (a few hundred kB): it travels with the tasks, so executors need no such file.

    Only models that leave texts as they are and put one blank before them are taken.
    """
    with open(path, "rb") as file:
        proto = file.read()
    held = sentencepiece.SentencePieceProcessor(model_proto=proto)
    probe = "a  ﬁ　 é\tb "
    if held.decode(held.encode(probe)) != probe or held.encode_as_pieces("a")[0][0] != SPACE:
        raise ValueError("the model normalises texts; only identity models with a leading blank are taken")
    return proto


def encode(df: DataFrame, proto: bytes, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids`` (decimal, joined by commas) and ``decoded``. A null or empty text has no ids.

    Whole texts are encoded whatever their length. Input columns of the three names are replaced.
    """
    plain = without(df, "n_tokens", "ids", "decoded")

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = pieces_of(proto)
        for series in texts:
            yield pd.DataFrame([held.whole(x or "") for x in series], columns=["n_tokens", "ids", "decoded"])

    made = F.pandas_udf(run, "n_tokens long, ids string, decoded string")
    return plain.withColumn("__made", made(F.col(text))).select(*[F.col(f"`{c}`") for c in plain.columns], "__made.*")


def digests(df: DataFrame, proto: bytes, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; as ``encode``, but only digests leave the workers."""
    plain = without(df, "n_tokens", "ids_sha256", "decoded_sha256")

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = pieces_of(proto)
        for series in texts:
            rows = []
            for x in series:
                n, ids, shown = held.whole(x or "")
                rows.append((n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(shown.encode("utf-8")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return plain.withColumn("__made", made(F.col(text))).select(*[F.col(f"`{c}`") for c in plain.columns], "__made.*")
