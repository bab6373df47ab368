"""Language identification with words first and character n-grams for words never seen.

A model holds, per language, log frequencies of its commonest words and of character n-grams of all
lengths up to a largest. A known word scores by its own log frequencies. Any other word is cut
into the longest n-grams, then into shorter and shorter ones, until a length has known n-grams.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import without

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Limits:
    """Bounds of the fitted model: it is sent to every executor, so it must not grow with the corpus."""

    rows: int = 10_000  # about so many labelled rows are fitted on, chosen by a hash of the key
    languages: int = 400
    words: int = 10_000  # commonest words kept of each language
    grams: int = 5_000  # commonest n-grams kept of each language and length
    longest: int = 4
    cached: int = 100_000  # words whose scores a worker remembers


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray  # log share of each language
    words: dict[str, np.ndarray]  # log frequency of a word in each language
    grams: list[dict[str, np.ndarray]]  # the same for n-grams, by length - 1

    def of_word(self, word: str) -> np.ndarray | None:
        """Scores by language; None if no part of the word is known."""
        known = self.words.get(word)
        if known is not None:
            return known
        held = f" {word} "
        for n in range(len(self.grams), 0, -1):
            table = self.grams[n - 1]
            text = held if n > 1 else word
            found = [table[g] for g in (text[i : i + n] for i in range(len(text) - n + 1)) if g in table]
            if found:
                return np.add.reduce(found) / len(found)
        return None


def has_letter(text: str) -> bool:
    return text.isalpha() or any(c.isalpha() for c in text)


def _counted(batches: Iterator[pd.DataFrame], longest: int) -> Iterator[pd.DataFrame]:
    """Per task: word and n-gram counts by language (length 0: words)."""
    words: dict[str, Counter] = {}

    def drained() -> pd.DataFrame:
        rows = []
        for lang, counts in words.items():
            grams: list[Counter] = [Counter() for _ in range(longest)]
            for word, n in counts.items():
                for size in range(1, longest + 1):
                    text = f" {word} " if size > 1 else word
                    for i in range(len(text) - size + 1):
                        grams[size - 1][text[i : i + size]] += n
            rows += [(lang, 0, w, n) for w, n in counts.items()]
            rows += [(lang, size, g, n) for size in range(1, longest + 1) for g, n in grams[size - 1].items()]
        words.clear()
        return pd.DataFrame(rows, columns=["lang", "size", "part", "n"])

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            words.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        if sum(map(len, words.values())) > 300_000:
            yield drained()
    if words:
        yield drained()


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", limits: Limits = Limits()) -> Model:
    """Fit on the rows of ``df`` whose text and language are given, on about ``limits.rows`` of them.

    The counts are summed by Spark; the driver takes the bounded number of commonest parts of each language.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key)).alias("chance")
    )
    rows = labelled.count()
    if rows > limits.rows:
        parts = 1 << 20
        labelled = labelled.where(F.pmod("chance", F.lit(parts)) < int(parts * limits.rows / rows))
    labelled = labelled.drop("chance")
    shares = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(limits.languages).collect()
    languages = sorted(r["lang"] for r in shares)
    place = {x: i for i, x in enumerate(languages)}
    total = sum(r["count"] for r in shares)
    prior = np.zeros(len(languages))
    for r in shares:
        prior[place[r["lang"]]] = np.log(r["count"] / total)

    longest = limits.longest
    found = labelled.mapInPandas(lambda batches: _counted(batches, longest), "lang string, size int, part string, n long")
    summed = found.groupBy("lang", "size", "part").agg(F.sum("n").alias("n"))
    sums = {(r["lang"], r["size"]): r["n"] for r in summed.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect()}
    nth = F.row_number().over(W.partitionBy("lang", "size").orderBy(F.desc("n"), "part"))
    most = F.when(F.col("size") == 0, limits.words).otherwise(limits.grams)
    kept = summed.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(longest + 1)]
    # Half a count stands for parts that a language does not have.
    floors = [np.array([np.log(0.5 / (sums.get((x, size), 0) + 1)) for x in languages]) for size in range(longest + 1)]
    for lang_, size, part, n in kept.toLocalIterator():
        if lang_ in place:
            row = tables[size].get(part)
            if row is None:
                row = tables[size][part] = floors[size].copy()
            row[place[lang_]] = np.log(n / (sums[(lang_, size)] + 1))
    return Model(languages, prior, tables[0], tables[1:])


def predict(df: DataFrame, model: Model, text: str = "text", cached: int = Limits.cached) -> DataFrame:
    """Add ``lang_pred`` and ``score``, the share of the likeliest language between 0 and 1.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if the model has no
    language. A text of which no part is known gets the commonest language. Input columns of the two names
    are replaced; others, also ``lang``, are never read.
    """
    plain = without(df, "lang_pred", "score")
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by Limits

    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m: Model = shared.value
        # Row 0 is for words of which no part is known.
        scores, place = np.zeros((cached + 1, len(m.languages))), {}

        def place_of(word: str) -> int:
            held = m.of_word(word)
            if held is None:
                row = 0
            else:
                row = len(place) + 1
                scores[row] = held
            place[word] = row
            return row

        for series in texts:
            rows = []
            for value in series:
                words = WORD.findall(value.lower()) if value else []
                if not m.languages or not any(map(has_letter, words)):
                    rows.append((UNDETERMINED, 0.0))
                    continue
                total = m.prior.copy()
                for start in range(0, len(words), cached // 2):
                    some = words[start : start + cached // 2]
                    if len(place) + len(some) > cached:
                        place.clear()
                    get = place.get
                    at = [i if (i := get(w)) is not None else place_of(w) for w in some]
                    total += scores[at].sum(axis=0)
                best = int(total.argmax())
                rows.append((m.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    guess = F.pandas_udf(judged, "lang_pred string, score double")
    return plain.withColumn("__guess", guess(F.col(text))).select(
        *[F.col(f"`{c}`") for c in plain.columns], F.col("__guess.lang_pred"), F.col("__guess.score")
    )


def held_out(key: str) -> Column:
    """One row in four by a checksum of its key; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """Fit on the rows that are not held out and predict all; adds ``held_out``, ``lang_pred`` and ``score``."""
    model = fit(df.where(~held_out(key)), text, lang, key, limits)
    return predict(without(df, "held_out").withColumn("held_out", held_out(key)), model, text, limits.cached)
