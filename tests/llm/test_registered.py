"""Registered queries of the corpus operators against SQL, and the pipeline against its stages' rules."""

import duckdb
import pytest

import __spark_entry__ as registered
import corpus_pipeline
from check_queries import TABLES, rows_of
from terrane.llm import queries as corpus


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    found = registered.queries()[name](spark, sf)
    result = db.execute(corpus.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of(columns, result.fetchall())


def test_pipeline_keeps_one_of_each_and_all_clean_ones(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    single = corpus_pipeline.ngram_jaccard(spark, kept, sf).cache()
    assert single.columns == docs.columns
    assert single.select("text").distinct().count() == single.count() >= 100
    mixture = corpus_pipeline.mixed(spark, single, sf)
    assert mixture.select("doc_id").distinct().count() == single.count() <= mixture.count()
    assert registered.queries()["pipeline"](spark, sf).where("n_tokens = 0").count() == 0


def test_near_copy_stage_keeps_texts_that_share_an_id_or_have_none(spark):
    import random

    rng = random.Random(1)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(500)}" for _ in range(60)) for k in "abcd")
    rows = [(1, a), (1, b), (None, c), (None, c), (None, d), (2, a), (3, ""), (4, None), (5, ""), (0, d + " x"), (6, "w " * 50_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "")
    assert kept.columns == docs.columns
    want = [(1, a), (1, b), (None, c), (3, ""), (4, None), (5, ""), (0, d + " x"), (6, "w " * 50_000)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in kept.collect())
    assert corpus_pipeline.ngram_jaccard(spark, docs.where("false"), "").count() == 0
