"""Exact top-k by inner product with an impact-ordered index, score at a time.

Every block of candidates is indexed by dimension: postings sorted by quantised impact and cut into segments
of equal count. A query takes segments of all dimensions by descending contribution, up to a fixed share of its postings. What a segment not
yet taken can still add bounds every candidate from above; only candidates whose bound reaches the k-th
best exact score are scored exactly. There is no test after each segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CANDIDATES_A_BLOCK = 16_384
QUERIES_A_BLOCK = 2_048
#: Impacts are grouped to so many levels a dimension; more levels bound more tightly and make more segments.
LEVELS = 8
#: Share of a query's postings taken before candidates are bounded.
TAKEN = 0.5


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """Components times ``scale``, rounded down; null if the vector or a component is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(x * scale).cast("long")))


@dataclass
class Index:
    """One block of candidates: ids, vectors, and per dimension its postings by descending impact, cut into segments."""

    ids: np.ndarray
    rows: np.ndarray
    postings: np.ndarray
    impacts: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, rows: np.ndarray) -> Index:
        by_impact = np.argsort(-rows.T, axis=1, kind="stable")
        edges = np.unique(np.linspace(0, len(rows), LEVELS + 1).astype(np.int64))
        return cls(ids, rows, by_impact, np.take_along_axis(rows.T, by_impact, axis=1), edges)

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """An upper bound of every candidate's score, from the segments that contribute most."""
        n, dims = self.rows.shape
        starts, ends = self.edges[:-1], self.edges[1:]
        # The most that a member of a segment contributes; a negative weight reads its dimension from the other end.
        weight = query[:, None]
        gain = np.where(weight >= 0, weight * self.impacts[:, starts], weight * self.impacts[:, ends - 1])
        order = np.argsort(-gain, axis=None, kind="stable")
        filled = np.cumsum(np.tile(ends - starts, dims)[order])
        taken = order[: int(np.searchsorted(filled, TAKEN * n * dims)) + 1]
        open_ = gain.copy()
        open_.reshape(-1)[taken] = np.iinfo(np.int64).min
        left = open_.max(axis=1)
        left[left == np.iinfo(np.int64).min] = 0  # the whole dimension is taken
        bound = np.full(n, left.sum(), dtype=np.int64)
        for segment in taken.tolist():
            d, level = divmod(segment, len(starts))
            part = slice(starts[level], ends[level])
            bound[self.postings[d, part]] += query[d] * self.impacts[d, part] - left[d]
        return bound

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to the smaller id; rows with the query's own id take no part."""
        bound = self.bounds(query)
        other = self.ids != own
        likely = np.argpartition(-bound, min(4 * k, len(bound) - 1))[: 4 * k + 1]
        likely = likely[other[likely]]
        scores = np.sort(self.rows[likely] @ query)[::-1]
        # Whoever is bounded below the k-th best of some members is proved out.
        possible = other if len(scores) < k else other & (bound >= scores[k - 1])
        members = np.flatnonzero(possible)
        exact = self.rows[members] @ query
        best = np.lexsort((self.ids[members], -exact))[:k]
        return self.ids[members[best]], exact[best]


def _matrix(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def search(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """The k best candidates of every query row, among all rows of ``df`` but its own.

    Returns ``query_id``, ``rank`` (from 1), ``<key>`` and ``score``; ties go to the smaller id. Vectors that are null or
    hold a null or non-finite component, and rows with a null id, take no part. A shorter vector counts as
    padded with zeros. Equal query rows are one query; equal candidates are candidates each. Scores are 64-bit.

    Queries and candidates meet in blocks: a block of candidates is indexed once for a block of queries.
    """
    usable = df.select(
        F.col(key).cast("long").alias("__id"), quantised(F.col(vector), scale).alias("__vector"), is_query.alias("__asks")
    ).where(F.col("__id").isNotNull() & F.col("__vector").isNotNull())
    asked = usable.where("__asks").select("__id", "__vector").distinct()
    rows, questions = usable.count(), asked.count()
    blocks = max(1, -(-rows // CANDIDATES_A_BLOCK))
    groups = max(1, -(-questions // QUERIES_A_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = usable.select("__id", "__vector", F.pmod(F.xxhash64("__id"), F.lit(blocks)).cast("int").alias("block")).withColumn("asked", each(groups))
    right = asked.withColumn("asked", F.pmod(F.xxhash64("__id"), F.lit(groups)).cast("int")).withColumn("block", each(blocks))

    def best(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(candidates) and len(queries):
            dims = max(candidates["__vector"].map(len).max(), queries["__vector"].map(len).max(), 1)
            index = Index.of(candidates["__id"].to_numpy(np.int64), _matrix(candidates["__vector"], dims))
            for own, query in zip(queries["__id"].tolist(), _matrix(queries["__vector"], dims), strict=True):
                ids, scores = index.top(query, own, k)
                found += [(own, i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        return pd.DataFrame(found, columns=["query_id", "found", "score"])

    grouped = left.groupBy("block", "asked").cogroup(right.groupBy("block", "asked"))
    found = grouped.applyInPandas(best, "query_id long, found long, score long")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "found"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", F.col("found").alias(key), "score")
