"""Export-duration model: features, ridge regression, cross-validation, prediction.

All fits come from one aggregation of means and covariances per fold. Statistics of
several folds are merged on the driver, where a fit is one solve of a matrix as wide as
the feature list, so a grid search does not go back to the data for each fit.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.ranking import contiguous_folds, shuffled_folds

# Numeric and shape features in model order; the one-hot roles follow them.
NUMERIC_FEATURES = [
    "log_rows_fetched",
    "log_columns_fetched",
    "log_row_column_product",
    "join_count",
    "is_spatial",
]
SHAPE_FEATURES = ["log_table_rows", "log_table_columns", "log_table_cells"]
ONE_HOT = "joined_table_one_hot"
# Alphas tried by default, and the folds of both cross-validations.
ALPHAS = [0.001, 0.01, 0.1, 1, 10, 100, 1000]
FOLDS = 5
SEED = 42
# Fields a record needs before its duration can be predicted.
PREDICT_REQUIRED = ["joined_tables", "columns_fetched", "rows_fetched", "table_shapes"]
# A fit holds a square matrix of this width on the driver.
MAX_ROLES = 1000

TARGET = "log_seconds"


def roles_joined(joined_tables: Column) -> Column:
    """Role names of a record's tables, nulls left out; empty for a null map."""
    return F.coalesce(F.filter(F.map_values(joined_tables), lambda t: t.isNotNull()), F.array().cast("array<string>"))


def duration_features(records: DataFrame) -> DataFrame:
    """Add the eight numeric features and ``roles``, the list behind the one-hot features."""
    rows = F.coalesce(F.col("rows_fetched"), F.lit(0)).cast("double")
    cols = F.coalesce(F.col("columns_fetched"), F.lit(0)).cast("double")
    shapes = F.filter(F.col("table_shapes"), lambda s: s.isNotNull())

    def total(field: str) -> Column:
        summed = F.aggregate(shapes, F.lit(0.0), lambda acc, s: acc + s[field].cast("double"))
        return F.coalesce(summed, F.lit(0.0))

    features = [
        F.log1p(rows),
        F.log1p(cols),
        F.log1p(rows * cols),
        F.size(roles_joined(F.col("joined_tables"))).cast("double"),
        F.col("is_spatial").cast("int").cast("double"),
        F.log1p(total("rows")),
        F.log1p(total("cols")),
        F.log1p(total("rows") * total("cols")),
    ]
    # The spatial flag is both an input and a feature of the same name; the feature replaces it.
    named = dict(zip([*NUMERIC_FEATURES, *SHAPE_FEATURES], features, strict=True))
    return records.withColumns({"roles": roles_joined(F.col("joined_tables")), **named})


def role_vocabulary(records: DataFrame) -> list[str]:
    """Sorted distinct roles of all records."""
    return _vocabulary(records.select(roles_joined(F.col("joined_tables")).alias("roles")))


def _vocabulary(listed: DataFrame) -> list[str]:
    roles = listed.select(F.explode("roles").alias("role")).distinct()
    found = [r["role"] for r in roles.limit(MAX_ROLES + 1).collect()]
    if len(found) > MAX_ROLES:
        raise ValueError(f"More than {MAX_ROLES} distinct roles; joined_tables must hold role names, not table names.")
    return sorted(found)


def one_hot(roles: Column, vocabulary: Sequence[str]) -> list[Column]:
    """One 0/1 column per known role; repeats count once and unknown roles not at all."""
    return [F.array_contains(roles, F.lit(v)).cast("double") for v in vocabulary]


def feature_names(vocabulary: Sequence[str]) -> list[str]:
    return [*NUMERIC_FEATURES, *SHAPE_FEATURES, *[f"role_{i}" for i in range(len(vocabulary))]]


def training_rows(records: DataFrame, vocabulary: Sequence[str], key: str = "id") -> DataFrame:
    """(key, log_seconds, features...) of the records with a known duration."""
    return _encoded(_timed(records, key), vocabulary, key)


def _timed(records: DataFrame, key: str) -> DataFrame:
    """(key, log_seconds, numeric features, roles) of the records with a known duration."""
    timed = duration_features(records.filter(F.col("duration").isNotNull()))
    return timed.select(key, F.log1p("duration").alias(TARGET), *NUMERIC_FEATURES, *SHAPE_FEATURES, "roles")


def _encoded(timed: DataFrame, vocabulary: Sequence[str], key: str) -> DataFrame:
    hot = one_hot(F.col("roles"), vocabulary)
    return timed.select(
        key, TARGET, *NUMERIC_FEATURES, *SHAPE_FEATURES, *[h.alias(f"role_{i}") for i, h in enumerate(hot)]
    )


@contextmanager
def _training(records: DataFrame, key: str) -> Iterator[tuple[DataFrame, list[str]]]:
    """Encoded training rows and the role vocabulary, kept while several passes read them.

    The rows are cached with replication off, to disk if need be; a lost executor's share is
    computed again.
    """
    timed = _timed(records, key).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        vocabulary = _vocabulary(timed)
        yield _encoded(timed, vocabulary, key), vocabulary
    finally:
        timed.unpersist()


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred cross-product sums of the features and the target (last)."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        return Moments(
            n,
            self.mean + gap * (other.n / n),
            self.cross + other.cross + np.outer(gap, gap) * (self.n * other.n / n),
        )


_MOMENTS = "fold int, n long, mean array<double>, cross array<double>"
# Statistics of tasks are added up in so many groups a fold first, then per fold.
_FIRST_GROUPS = 64


def _as_rows(held: dict[int, Moments]) -> pd.DataFrame:
    rows = [(fold, m.n, m.mean, m.cross.ravel()) for fold, m in held.items()]
    return pd.DataFrame(rows, columns=["fold", "n", "mean", "cross"])


def fold_moments(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows (fold, n, mean, cross): statistics of the features and, last, the target; ``cross`` is a flat square matrix.

    Each task reduces its rows to one matrix a fold, and Spark brings the matrices of a fold together, so the work
    for a row is one matrix product however many features there are. Rows that lack a feature do not count.
    """
    names = [*features, TARGET]
    width = len(names)

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Moments] = {}
        for batch in batches:
            values, folds = batch[names].to_numpy(dtype=np.float64), batch["fold"].to_numpy()
            whole = np.isfinite(values).all(axis=1)
            values, folds = values[whole], folds[whole]
            for fold in np.unique(folds).tolist():
                x = values[folds == fold]
                gap = x - (mean := x.mean(axis=0))
                found = Moments(len(x), mean, gap.T @ gap)
                held[fold] = held[fold] + found if fold in held else found
        yield _as_rows(held)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Moments] = {}
        for batch in batches:
            for fold, n, mean, cross in batch[["fold", "n", "mean", "cross"]].itertuples(index=False):
                found = Moments(n, mean, cross.reshape(width, width))
                held[fold] = held[fold] + found if fold in held else found
        yield _as_rows(held)

    of_task = rows.select(F.col("fold").cast("int"), *names).mapInPandas(of_rows, _MOMENTS)
    group = F.pmod(F.spark_partition_id(), F.lit(_FIRST_GROUPS)).alias("__group")
    first = of_task.select("*", group).repartition("fold", "__group").mapInPandas(added, _MOMENTS)
    return first.repartition("fold").mapInPandas(added, _MOMENTS)


def collect_moments(rows: DataFrame, features: Sequence[str]) -> dict[int, Moments]:
    """The fold statistics on the driver: one row per fold."""
    width = len(features) + 1
    return {
        r["fold"]: Moments(r["n"], np.array(r["mean"]), np.array(r["cross"]).reshape(width, width))
        for r in fold_moments(rows, features).collect()
    }


def solve_ridge(moments: Moments, alpha: float) -> tuple[float, list[float]]:
    """(intercept, coefficients) of ridge on standardized features with a free intercept."""
    xx, xy = moments.cross[:-1, :-1], moments.cross[:-1, -1]
    spread = np.sqrt(np.diag(xx) / moments.n)
    # Rounding leaves a constant column with a tiny spread; it counts as constant.
    constant = spread <= 1e-12 * np.maximum(1.0, np.abs(moments.mean[:-1]))
    spread = np.where(constant, 1.0, spread)
    scaled = xx / np.outer(spread, spread)
    scaled[constant, :] = 0.0
    scaled[:, constant] = 0.0
    weights = np.linalg.solve(scaled + alpha * np.eye(len(spread)), np.where(constant, 0.0, xy / spread)) / spread
    return float(moments.mean[-1] - weights @ moments.mean[:-1]), [float(w) for w in weights]


def linear(intercept: float, weights: Sequence[float], columns: Sequence[Column]) -> Column:
    return reduce(lambda acc, term: acc + F.lit(term[0]) * term[1], zip(weights, columns), F.lit(intercept))


@dataclass(frozen=True)
class DurationModel:
    """A fitted model: what prediction needs, and nothing tied to a session."""

    alpha: float
    vocabulary: tuple[str, ...]
    intercept: float
    coefficients: tuple[float, ...]
    training_records: int

    def predict(self, records: DataFrame, strict: bool = True) -> DataFrame:
        """Add ``predicted_seconds``, never below zero.

        A record without a required field fails the query, or with ``strict=False`` gets a
        null prediction; ``missing_fields`` names what it lacks.
        """
        lacks = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in PREDICT_REQUIRED])
        featured = duration_features(records)
        inputs = [F.col(c) for c in [*NUMERIC_FEATURES, *SHAPE_FEATURES]] + one_hot(F.col("roles"), self.vocabulary)
        seconds = F.greatest(F.expm1(linear(self.intercept, self.coefficients, inputs)), F.lit(0.0))
        scored = featured.select(
            *[(F.col(c) > 0).alias(c) if c == "is_spatial" else F.col(c) for c in records.columns],
            lacks.alias("missing_fields"),
            seconds.alias("__seconds"),
        )
        message = F.concat(F.lit("no prediction without: "), F.col("missing_fields"))
        absent = F.raise_error(message).cast("double") if strict else F.lit(None).cast("double")
        return scored.withColumn(
            "predicted_seconds", F.when(F.col("missing_fields") != "", absent).otherwise(F.col("__seconds"))
        ).drop("__seconds")

    def metadata(self) -> dict:
        return {
            "model_type": "Ridge",
            "parameters": {"alpha": self.alpha},
            "feature_count": len(self.coefficients),
            "features": [*NUMERIC_FEATURES, *SHAPE_FEATURES, ONE_HOT],
            "training_records": self.training_records,
        }

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the model as a one-row text table; an existing one at the path is replaced."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> DurationModel:
        state = json.loads(spark.read.text(path).head()["value"])
        state["vocabulary"] = tuple(state["vocabulary"])
        state["coefficients"] = tuple(state["coefficients"])
        return DurationModel(**state)


def fit(records: DataFrame, alpha: float = 1.0, key: str = "id") -> DurationModel:
    """Ridge on log1p of the duration. ``training_records`` counts all records given."""
    with _training(records, key) as (rows, vocabulary):
        moments = collect_moments(rows.withColumn("fold", F.lit(0)), feature_names(vocabulary))
    if not moments:
        raise ValueError("No record with a duration to train on.")
    intercept, weights = solve_ridge(moments[0], alpha)
    return DurationModel(float(alpha), tuple(vocabulary), intercept, tuple(weights), records.count())


def mae_seconds(actual_log: Column, predicted_log: Column) -> Column:
    """Mean absolute error in seconds of log1p values, as an aggregate."""
    return F.avg(F.abs(F.expm1(actual_log) - F.expm1(predicted_log)))


def _held_out(moments: dict[int, Moments], fold: int) -> Moments:
    return reduce(lambda a, b: a + b, [m for f, m in sorted(moments.items()) if f != fold])


def _out_of_fold(moments: dict[int, Moments], alpha: float, names: Sequence[str]) -> Column:
    """Prediction of each row by the model fitted without its fold."""
    columns = [F.col(c) for c in names]
    branches = None
    for fold in sorted(moments):
        value = linear(*solve_ridge(_held_out(moments, fold), alpha), columns)
        hit = F.col("fold") == fold
        branches = F.when(hit, value) if branches is None else branches.when(hit, value)
    return branches


def _cross_moments(rows: DataFrame, names: Sequence[str], k: int) -> dict[int, Moments]:
    moments = collect_moments(rows, names)
    if len(moments) < k:
        count = sum(m.n for m in moments.values())
        raise ValueError(f"{k} folds need as many records with a duration; there are {count}.")
    return moments


def evaluate_kfold(
    records: DataFrame, alpha: float = 1.0, n_splits: int = FOLDS, random_state: int = SEED, key: str = "id"
) -> dict:
    """Pooled mean absolute error over all out-of-fold predictions of shuffled folds."""
    with _training(records, key) as (rows, vocabulary):
        names = feature_names(vocabulary)
        folded = shuffled_folds(rows, key, n_splits, random_state)
        moments = _cross_moments(folded, names, n_splits)
        scored = folded.agg(mae_seconds(F.col(TARGET), _out_of_fold(moments, alpha, names)).alias("mae")).head()
    return {"mae_seconds": scored["mae"], "record_count": sum(m.n for m in moments.values()), "folds": n_splits}


def tune_alpha(records: DataFrame, alphas: Iterable[float] | None = None, key: str = "id") -> dict:
    """Best alpha by the mean of per-fold errors over contiguous folds; the first best wins."""
    candidates = list(alphas or []) or ALPHAS
    with _training(records, key) as (rows, vocabulary):
        names = feature_names(vocabulary)
        folded = contiguous_folds(rows, key, FOLDS)
        moments = _cross_moments(folded, names, FOLDS)
        errors = [mae_seconds(F.col(TARGET), _out_of_fold(moments, a, names)).alias(f"mae_{i}") for i, a in enumerate(candidates)]
        scores = folded.groupBy("fold").agg(*errors).collect()
    means = [float(np.mean([row[f"mae_{i}"] for row in scores])) for i in range(len(candidates))]
    best = int(np.argmin(means))
    return {"best_alpha": candidates[best], "best_mae": means[best]}
