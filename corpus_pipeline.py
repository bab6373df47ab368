"""From documents to token ids: language ID, near copies, long repeats, mixing of sources, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.

- ``language_id`` drops documents that are null, have no letter, or whose likeliest language has less than half.
- ``ngram_jaccard`` keeps of each group of near copies the document with the smallest id (ids before none; any one of equal
  ids). Documents without an id are kept like others, and so are different texts that share one.
- ``suffix_dedup`` cuts out passages of over 50 words, and those of 400 bytes and more, that start anywhere else; documents left
  empty go. Words count without regard to blanks and case, so no passage is too short in bytes; the bytes are for long words.
- ``mixing`` repeats documents of small sources until none is repeated more than twice as often as another;
  every document stays once at least.
- ``pieces`` encodes the texts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.llm import langid, mixing, ngram_join, piece, suffix_dedup
from terrane.llm.common import written
from terrane.session import ship

LEAST_SCORE = 0.5
REPETITION = 2.0
REPEATED_WORDS = 51
PIECE_MODEL = "piece_bpe_32k.model"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    judged = langid.identify(docs)
    return judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # Rows are told apart by a hash of id and text, so that no numbered copy of all texts stays: ids may be null, or shared by different texts.
    hashed = docs.withColumn("__row", F.xxhash64("doc_id", "text"))
    joined = ngram_join.join(hashed.select(F.col("__row").alias("doc_id"), "text")).withColumnRenamed("doc_id", "__row")
    classes = joined.groupBy("__row").agg(*[F.first(c).alias(c) for c in ("n_shingles", "component_id")], F.count(F.lit(1)).alias("rows"))
    ids = hashed.select("__row", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "__row", "n_shingles", "rows")).alias("first")
    stays = written(classes.join(ids, "__row").groupBy("component_id").agg(first).select("first.__row", "first.n_shingles", "first.rows"))
    # Of rows with the same id and text any one stays, and all of those without words.
    several = F.expr("rows > 1 and n_shingles > 0")
    single = hashed.join(stays.where(~several), "__row", "left_semi")
    repeated = hashed.join(stays.where(several), "__row", "left_semi").dropDuplicates(["__row"])
    return single.unionByName(repeated).select(docs.columns)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = suffix_dedup.without_repeats(docs, words=REPEATED_WORDS).where("text is not null and text <> ''")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs, target="repetition", value=REPETITION).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = piece.read_model(public_tokenizers.path(PIECE_MODEL))
    coded = piece.encode(docs.select("doc_id", "lang", "source", "text"), model)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", long_repeats),
    ("mixing", mixed),
    ("pieces", pieces),
]

#: Learned language models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
