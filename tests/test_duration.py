import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from terrane.functions.ranking import contiguous_folds, shuffled_folds
from terrane.operators import duration
from terrane.operators.history import PERFORMANCE_SCHEMA
from terrane.plans.train import ModelRegistry, train_and_save


def make_records(spark, count, seed=1, untimed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(count + untimed):
        tables = [("main", "territory_primary_table")] + [
            (k, v) for k, v in [("join_1", "name_table"), ("join_2", "geometry_table"), ("join_3", None)] if rng.random() < 0.5
        ]
        shapes = [(rng.randint(10, 10**6), rng.randint(2, 30)) for _ in tables]
        rows_total, cols_total = sum(s[0] for s in shapes), sum(s[1] for s in shapes)
        spent = None if i >= count else rows_total * cols_total / 1e5 * rng.uniform(0.5, 2)
        rows.append((i + 1, i + 1, rows_total, cols_total, spent, None, None, rng.random() < 0.5, dict(tables), shapes, None))
    return spark.createDataFrame(rows, PERFORMANCE_SCHEMA)


@pytest.fixture(scope="module")
def records(spark):
    return make_records(spark, 60, untimed=5).cache()


@pytest.fixture(scope="module")
def matrix(records):
    vocabulary = duration.role_vocabulary(records)
    names = duration.feature_names(vocabulary)
    rows = duration.training_rows(records, vocabulary).orderBy("id").toPandas()
    return rows[names].to_numpy(), rows["log_seconds"].to_numpy(), rows["id"].to_numpy()


def closed_form(x, y, alpha):
    mean, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1
    z = (x - mean) / spread
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / spread
    return y.mean() - w @ mean, w


def error(y, p):
    return np.mean(np.abs(np.expm1(y) - np.expm1(p)))


def test_features_of_one_record(spark):
    row = (1, 1, 9, 4, math.e - 1, None, None, True, {"a": "t", "b": None, "c": "t"}, [(2, 3), None, (5, 7)], None)
    empty = (2, 2, None, None, None, None, None, False, None, None, None)
    df = duration.duration_features(spark.createDataFrame([row, empty], PERFORMANCE_SCHEMA)).orderBy("id").collect()
    values = [df[0][c] for c in [*duration.NUMERIC_FEATURES, *duration.SHAPE_FEATURES]]
    assert values == pytest.approx([math.log(10), math.log(5), math.log(37), 2, 1, math.log(8), math.log(11), math.log(71)])
    assert [df[1][c] for c in [*duration.NUMERIC_FEATURES, *duration.SHAPE_FEATURES]] == [0] * 8
    assert df[0]["roles"] == ["t", "t"] and df[1]["roles"] == []


def test_vocabulary_is_sorted_and_repeats_count_once(spark, records):
    assert duration.role_vocabulary(records) == ["geometry_table", "name_table", "territory_primary_table"]
    df = spark.createDataFrame([(["b", "b", "x"],)], "roles array<string>")
    assert tuple(df.select(*duration.one_hot(F.col("roles"), ["a", "b"])).head()) == (0.0, 1.0)


@pytest.mark.parametrize("alpha", [0.001, 1.0, 1000.0])
def test_fit_is_ridge_on_standardized_features(records, matrix, alpha):
    x, y, _ = matrix
    model = duration.fit(records, alpha)
    intercept, weights = closed_form(x, y, alpha)
    assert model.intercept == pytest.approx(intercept, abs=1e-8)
    assert np.allclose(model.coefficients, weights, atol=1e-8)
    assert model.training_records == 65
    meta = model.metadata()
    assert meta["feature_count"] == 11 and len(meta["features"]) == 9 and meta["parameters"] == {"alpha": alpha}


def test_fit_agrees_with_spark_ml(records, matrix):
    x, y, _ = matrix
    vocabulary = duration.role_vocabulary(records)
    names = duration.feature_names(vocabulary)
    rows = VectorAssembler(inputCols=names, outputCol="x").transform(duration.training_rows(records, vocabulary))
    ridge = LinearRegression(
        featuresCol="x", labelCol="log_seconds", solver="normal", elasticNetParam=0.0, standardization=True,
        regParam=float(y.std() / len(y)),
    ).fit(rows)
    model = duration.fit(records, 1.0)
    assert np.allclose(model.coefficients, ridge.coefficients.toArray(), atol=1e-5)
    assert model.intercept == pytest.approx(ridge.intercept, abs=1e-5)


def test_kfold_and_tuning_match_refitting(records, matrix):
    x, y, ids = matrix
    rows = duration.training_rows(records, duration.role_vocabulary(records))
    folds = {r["id"]: r["fold"] for r in shuffled_folds(rows, "id", 5, 42).collect()}
    fold = np.array([folds[i] for i in ids])
    predicted = np.empty(len(y))
    for f in range(5):
        b, w = closed_form(x[fold != f], y[fold != f], 1.0)
        predicted[fold == f] = x[fold == f] @ w + b
    scored = duration.evaluate_kfold(records)
    assert scored["mae_seconds"] == pytest.approx(error(y, predicted), rel=1e-8)
    assert (scored["record_count"], scored["folds"]) == (60, 5)

    runs = np.array_split(np.arange(len(y)), 5)
    means = []
    for alpha in duration.ALPHAS:
        maes = []
        for run in runs:
            keep = np.setdiff1d(np.arange(len(y)), run)
            b, w = closed_form(x[keep], y[keep], alpha)
            maes.append(error(y[run], x[run] @ w + b))
        means.append(np.mean(maes))
    best = duration.tune_alpha(records)
    assert best["best_alpha"] == duration.ALPHAS[int(np.argmin(means))]
    assert best["best_mae"] == pytest.approx(min(means), rel=1e-8)
    assert duration.tune_alpha(records, [5])["best_alpha"] == 5


@pytest.mark.parametrize("count", [12, 23, 103])
def test_folds_have_the_usual_sizes(spark, count):
    df = spark.range(count).select((F.col("id") * 17 + 3).alias("id")).repartition(5)
    sizes = [count // 5 + (i < count % 5) for i in range(5)]
    expected = np.repeat(np.arange(5), sizes)
    found = contiguous_folds(df, "id", 5).orderBy("id").toPandas()
    assert found["fold"].tolist() == expected.tolist()
    dealt = shuffled_folds(df, "id", 5, 42).groupBy("fold").count().orderBy("fold").toPandas()
    assert dealt["count"].tolist() == sizes
    again = shuffled_folds(df.repartition(2), "id", 5, 42)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, shuffled_folds(df, "id", 5, 42).collect()))


def test_too_few_records(spark):
    few = make_records(spark, 3)
    with pytest.raises(ValueError, match="5 folds need as many records with a duration; there are 3"):
        duration.evaluate_kfold(few)
    with pytest.raises(ValueError, match="No record"):
        duration.fit(make_records(spark, 0, untimed=2))


def test_prediction_rules(spark, records):
    model = duration.fit(records)
    predicted = model.predict(records)
    assert predicted.columns[: len(records.columns)] == records.columns
    assert dict(predicted.dtypes)["is_spatial"] == "boolean"
    assert predicted.filter("predicted_seconds < 0 or predicted_seconds is null").count() == 0
    low = duration.DurationModel(1.0, (), -50.0, (0.0,) * 8, 1)
    assert low.predict(records).agg(F.max("predicted_seconds")).head()[0] == 0
    missing = records.limit(1).withColumn("rows_fetched", F.lit(None).cast("bigint")).withColumn(
        "joined_tables", F.lit(None).cast("map<string,string>")
    )
    with pytest.raises(Exception, match="no prediction without: joined_tables, rows_fetched"):
        model.predict(missing).collect()
    lenient = model.predict(missing, strict=False).head()
    assert lenient["predicted_seconds"] is None and lenient["missing_fields"] == "joined_tables, rows_fetched"


def test_save_load_and_registry(spark, records, tmp_path):
    path = str(tmp_path / "one")
    saved = train_and_save(records, path)
    assert duration.DurationModel.load(spark, path) == saved
    registry = ModelRegistry(spark, str(tmp_path / "registry"))
    assert registry.latest() is None
    first, _ = registry.train(records, {"best_alpha": 10})
    second, metrics = registry.train(records)
    assert first.alpha == 10 and registry.latest() == second
    rows = registry.models().orderBy("id").collect()
    assert [r["model_type"] for r in rows] == ["ridge", "ridge"]
    assert float(rows[1]["metrics"]["mae_seconds"]) == metrics["mae_seconds"]


def test_roles_must_be_few(spark):
    df = spark.range(duration.MAX_ROLES + 1).select(F.create_map(F.lit("main"), F.col("id").cast("string")).alias("joined_tables"))
    with pytest.raises(ValueError, match="distinct roles"):
        duration.role_vocabulary(df)


def test_moments_equal_the_covariances(spark):
    names = ["a", "b"]
    df = spark.range(500).selectExpr("cast(id % 3 as int) as fold", "cast(id as double) as a", "cast(id * id % 17 as double) as b", f"sqrt(id) as {duration.TARGET}")
    lacking = df.limit(3).selectExpr("fold", "cast(null as double) as a", "b", duration.TARGET)
    found = duration.collect_moments(df.unionByName(lacking).repartition(5), names)
    for r in df.groupBy("fold").agg(F.count("a"), F.avg("b"), F.covar_pop("a", "b"), F.covar_pop("b", duration.TARGET)).collect():
        m = found[r[0]]
        assert (m.n, m.mean[1], m.cross[0, 1] / m.n, m.cross[2, 1] / m.n) == pytest.approx(tuple(r)[1:])
    assert duration.collect_moments(df.where("false"), names) == {}


def test_ranks_start_no_job_and_follow_the_partitions(spark):
    from terrane.functions.ranking import ordered_rank, shuffled_rank

    rows = [(i * 37 % 1009, i) for i in range(1009)] + [(None, 1), (5, 2), (5, 3)]
    df = spark.createDataFrame(rows, "id bigint, v int").repartition(6)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions in ("3", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.sparkContext.setJobGroup(f"ranking {partitions}", "")
        try:
            ranked, dealt = ordered_rank(df, "id"), shuffled_rank(df, "id", 3)
            assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(f"ranking {partitions}")) == []
            found = sorted((r["rank"], r["id"]) for r in ranked.collect())
            assert [r for r, _ in found] == list(range(1, len(rows) + 1))
            assert [i for _, i in found] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
            assert sorted(r["rank"] for r in dealt.collect()) == list(range(1, len(rows) + 1))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert ordered_rank(df.where("false"), "id").count() == 0


def test_fold_queries_make_their_records_once(spark, sf, monkeypatch):
    """The passes over the training records do not join the history anew."""
    import __spark_entry__ as entry

    made = []
    monkeypatch.setattr(entry, "_training", lambda *of, f=entry._training: made.append(f(*of)) or made[-1])
    for query in (entry.contiguous_fold_sizes, entry.shuffled_fold_of_record, entry.ridge_fold_stats):
        folds = query(spark, sf)
        assert not [f for f in folds.inputFiles() if "lineitem" in f or "orders" in f]
        assert sum(r[0] for r in folds.groupBy("fold").count().select("count").collect()) > 0
    assert len(made) == 3
