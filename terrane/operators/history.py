"""Export history: run records, performance records and the model registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns of the history frame, in output order.
EXPORT_COLUMNS = [
    "id",
    "group_key",
    "primary_table_name",
    "geography_table",
    "name_table",
    "ndm_table",
    "fetch_timestamp",
    "output_path",
    "sf_query_ids",
    "sf_database",
    "sf_schema",
    "sf_data_timestamp",
    "status",
]
PERFORMANCE_COLUMNS = [
    "rows_fetched",
    "columns_fetched",
    "joined_tables",
    "table_shapes",
    "duration",
    "predicted_duration",
]
# What a performance record must have to be used for training.
TRAINING_REQUIRED = ["joined_tables", "columns_fetched", "rows_fetched", "table_shapes", "duration"]

EXPORTS_SCHEMA = """
    id bigint, group_key string, primary_table_name string, geography_table string,
    name_table string, ndm_table string, sf_query_ids array<string>, sf_database string,
    sf_schema string, sf_data_timestamp timestamp, fetch_timestamp timestamp,
    export_timestamp timestamp, output_path string, status string
"""
# Durations are kept in seconds.
PERFORMANCE_SCHEMA = """
    id bigint, export_id bigint, rows_fetched bigint, columns_fetched bigint, duration double,
    predicted_duration double, predicted_method string, is_spatial boolean,
    joined_tables map<string,string>, table_shapes array<struct<rows:bigint,cols:bigint>>,
    prediction_model_id bigint
"""
MODELS_SCHEMA = """
    id bigint, created_at timestamp, model_name string, model_type string,
    parameters map<string,string>, metrics map<string,string>, artifact_path string
"""


def utc_tagged(df: DataFrame, column: str) -> Column:
    """The stored wall-clock time read as UTC, whatever the session's time zone."""
    if df.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.col(column)
    # Both sides are zone-less, so the difference is exact in every session zone.
    origin = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", origin, F.col(column)))


def exports_history(exports: DataFrame, performance: DataFrame) -> DataFrame:
    """Every export with its performance record, if it has one; times are tagged UTC."""
    tagged = exports.select(
        *[
            utc_tagged(exports, c).alias(c) if c in ("fetch_timestamp", "sf_data_timestamp") else F.col(c)
            for c in EXPORT_COLUMNS
        ]
    )
    perf = performance.select(F.col("export_id").alias("id"), *PERFORMANCE_COLUMNS)
    return tagged.join(perf, "id", "left")


def training_set(exports: DataFrame, performance: DataFrame) -> DataFrame:
    """Performance records of completed exports that have everything training needs."""
    complete = performance.dropna(subset=TRAINING_REQUIRED)
    done = exports.filter(F.col("status") == "COMPLETED").select(F.col("id").alias("export_id"))
    return complete.join(done, "export_id").select(*performance.columns)


def training_count(exports: DataFrame, performance: DataFrame) -> DataFrame:
    return training_set(exports, performance).agg(F.count(F.lit(1)).alias("training_records"))


def packaged_models(models: DataFrame) -> DataFrame:
    """The registry under its application-facing names."""
    return models.select(
        "id",
        "created_at",
        F.col("model_name").alias("name"),
        F.col("model_type").alias("type"),
        "parameters",
        "metrics",
        "artifact_path",
    )


def latest_model(models: DataFrame) -> DataFrame:
    return packaged_models(models).orderBy(F.desc("id")).limit(1)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def actual_durations(exports: DataFrame) -> DataFrame:
    """(id, seconds) from fetch to export; null for an export that has not finished."""
    return exports.select(
        "id", seconds_between(F.col("fetch_timestamp"), F.col("export_timestamp")).alias("seconds")
    )


def latest_runs(events: DataFrame, key: str = "id", sequence: str = "event_seq") -> DataFrame:
    """Current state per run from an append-only table of run events.

    Each event carries only the fields it sets; the newest non-null value of each wins.
    The partial maxima combine on the map side.
    """
    fields = [c for c in events.columns if c not in (key, sequence)]
    return events.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence))).alias(c) for c in fields])
