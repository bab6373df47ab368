"""Registered queries of the package and the SQL each must agree with.

Every query reads the given tables through the stand-ins of ``terrane.sources.standins``
and runs over all of their rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from importlib.util import find_spec
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from terrane.functions import wkb  # noqa: E402
from terrane.functions.columns import first_row_per_key, left_join_suffixed  # noqa: E402
from terrane.functions.ranking import contiguous_folds, shuffled_folds  # noqa: E402
from terrane.operators import catalog, detect, duration, features, history, status, union  # noqa: E402
from terrane.plans.assemble import assemble  # noqa: E402
from terrane.plans.export_run import RunLog  # noqa: E402
from terrane.session import shared_folder, ship  # noqa: E402
from terrane.sinks.prepare import narrow_decimals  # noqa: E402
from terrane.sources import standins, tables  # noqa: E402
from terrane.streaming import event_time, status_stream  # noqa: E402

# The corpus operators and their pipeline may be absent; an error inside them is not hidden.
corpus = pipeline = None
if find_spec("terrane.llm") is not None and find_spec("terrane.llm.queries") is not None:
    from terrane.llm import queries as corpus  # noqa: E402
    if find_spec("corpus_pipeline") is not None:
        import corpus_pipeline as pipeline  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"
RUN_ID = "load-1"
AS_OF = "2024-01-20 00:00:00"


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the full feature table of the smoke data."""
    return queries()["flagship_features"](spark, SMOKE_DIR)


# Catalog


def _tables(spark: SparkSession, sf: str) -> DataFrame:
    named = standins.catalog(spark, sf).toDF("table_name", "created")
    return named.withColumn("table_schema", F.when(F.col("table_name").like("N1%"), "OTHER").otherwise("APP"))


def list_tables_like(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_tables(_tables(spark, sf), "APP", ["n2\\_%", "n%_territory_%"])


def list_tables_all(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_tables(_tables(spark, sf), "APP")


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.preprocess_catalog(standins.catalog(spark, sf))


def catalog_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    return _prepared(spark, sf).toDF("table_name", "created", "date_from_name", "group_key", "table_type")


def catalog_groups(spark: SparkSession, sf: str) -> DataFrame:
    grouped = catalog.group_tables(_prepared(spark, sf))
    return catalog.sort_groups(grouped).select(
        F.col("Group Key").alias("group_key"),
        F.array_join(F.transform("Creation_Dates", lambda d: F.date_format(d, "yyyy-MM-dd")), ",").alias("dates"),
        "territory_table_creation_date",
        "territory_table_primary",
        "geometry_source_primary",
        *[F.array_join(kind, ",").alias(f"{kind}_tables") for kind in catalog.TABLE_TYPES],
    )


def catalog_listing(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listing(catalog.group_tables(_prepared(spark, sf))).toDF("table_name", "created")


def catalog_listing_flat(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listing(_prepared(spark, sf), grouped=False).toDF("table_name", "created")


def table_sets(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.table_sets(catalog.group_tables(_prepared(spark, sf)))


def resolve_table_set(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.resolve_table_set(catalog.group_tables(_prepared(spark, sf)), "N3_19960101")


def group_key_unique(spark: SparkSession, sf: str) -> DataFrame:
    keyed = catalog.preprocess_catalog(standins.catalog(spark, sf), RUN_ID)
    return keyed.groupBy(F.col("Group Key").alias("group_key")).agg(F.count(F.lit(1)).alias("tables"))


# Scans and profiles


def column_types(spark: SparkSession, sf: str) -> DataFrame:
    return tables.column_types(standins.read(spark, sf, "part"))


def scan_projection(spark: SparkSession, sf: str) -> DataFrame:
    text_key = standins.territory(spark, sf).withColumn("FEATURE_ID", F.col("FEATURE_ID").cast("string"))
    return tables.scan(text_key, ["FEATURE_ID", "NAME", "PRICE"])


def scan_limit(spark: SparkSession, sf: str) -> DataFrame:
    ordered = standins.territory(spark, sf).orderBy(F.desc("PRICE"), "FEATURE_ID")
    return tables.scan(ordered, ["FEATURE_ID", "PRICE"], limit=50)


def _four(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return (
        standins.territory(spark, sf),
        standins.names(spark, sf),
        standins.pieces(spark, sf),
        standins.ndm(spark, sf),
    )


def table_set_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table_set_shapes(*_four(spark, sf))


def table_set_metrics(spark: SparkSession, sf: str) -> DataFrame:
    roles = F.array_join(F.sort_array(F.map_values("joined_tables")), ",")
    shapes = F.array_join(F.transform("table_shapes", lambda s: F.concat_ws("x", s["rows"], s["cols"])), ",")
    return tables.table_set_metrics(*_four(spark, sf)).select(
        "rows_fetched", "columns_fetched", "is_spatial", roles.alias("roles"), shapes.alias("shapes")
    )


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return standins.read(spark, sf, "documents").select(
        F.hex(F.encode("text", "utf-8")).alias("hex_text"),
        F.hex(F.substring("text", 1, 3)).alias("short_hex"),
        F.col("text").alias("plain"),
        F.col("lang").alias("lang"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("doc_id").cast("string"), F.lit(" "))).alias("number_text"),
    )


def text_profile(spark: SparkSession, sf: str) -> DataFrame:
    return detect.text_profile(_texts(spark, sf))


def wkb_validity(spark: SparkSession, sf: str) -> DataFrame:
    good = F.col("geometry")
    body = F.substring(good, 6, 88)
    variants = [
        ("good", good),
        ("trailing_bytes", F.concat(good, F.unhex(F.lit("00")))),
        ("truncated", F.substring(good, 1, 60)),
        ("bad_type", F.concat(F.unhex(F.lit("0163000000")), body)),
        ("odd_order", F.concat(F.unhex(F.lit("05")), F.substring(good, 2, 92))),
        ("with_srid", F.concat(F.unhex(F.lit("0103000020E6100000")), body)),
        ("open_ring", F.concat(F.substring(good, 1, 77), F.unhex(F.lit("000000000000F0C0000000000000F0C0")))),
    ]
    # Spark may hold all rows of a task until the worker has answered: the variants are made as arguments, so only the geometry
    # waits, and both counts are written alike, so that a value goes to the worker once.
    judged = standins.pieces(spark, sf).agg(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                F.count(F.lit(1)).alias("values"),
                F.count_if(F.coalesce(wkb.wkb_valid(value), F.lit(False))).alias("valid_values"),
                detect.all_wkb(value).alias("all_valid"),
            ).alias(name)
            for name, value in variants
        ]
    )
    # An empty table has no variants.
    return judged.select(F.inline(F.array(*[name for name, _ in variants]))).filter(F.col("values") > 0)


def wkb_hex_profile(spark: SparkSession, sf: str) -> DataFrame:
    hexed = standins.pieces(spark, sf).select(F.hex("geometry").alias("geom_text"))
    return detect.wkb_profile(hexed, "geom_text")


def detect_geometry(spark: SparkSession, sf: str) -> DataFrame:
    pieces = standins.pieces(spark, sf)
    hexed = pieces.select("FEATURE_ID", F.hex("geometry").alias("SHAPE"))
    searched = {
        "binary": (pieces, None),
        "geography": (pieces, {"FEATURE_ID": "NUMBER", "geometry": "GEOGRAPHY"}),
        "hex_text": (hexed, None),
        "named_wkb": (hexed.withColumnRenamed("SHAPE", "SHAPE_WKB"), None),
        "none": (standins.territory(spark, sf), None),
    }
    rows = []
    for table, (df, declared) in searched.items():
        found = detect.detect_geometry(df, declared)
        rows.append((table, *(found.to_dict().values() if found else (None, None, None))))
    return spark.createDataFrame(rows, "searched string, TYPE string, COLUMN string, SOURCE string")


def spatial_prepare(spark: SparkSession, sf: str) -> DataFrame:
    declared = {"FEATURE_ID": "NUMBER", "geometry": "GEOGRAPHY"}
    table, column = detect.prepare_spatial(standins.pieces(spark, sf), declared)
    unions = union.union_features(table.select("FEATURE_ID", F.col(column).alias("geometry")))
    return unions.groupBy("FEATURE_ID").agg(F.sum(wkb.wkb_area("geometry")).alias("area"))


def geometry_headers(spark: SparkSession, sf: str) -> DataFrame:
    lines = standins.read(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("with_srid"), "l_suppkey")
    x = F.col("l_suppkey").cast("double")
    square = wkb.rectangle_wkb(x, x, x + 1, x + 1)
    tagged = F.concat(F.unhex(F.lit("0103000020E6100000")), F.substring(F.col("g"), 6, 88))
    value = F.when(F.col("with_srid") == 1, tagged).otherwise(F.col("g"))
    return (
        lines.withColumn("g", square)
        .withColumn("g", value)
        .groupBy("with_srid", wkb.geometry_type(F.col("g")).alias("type"), wkb.srid(F.col("g")).alias("srid"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# Feature assembly


def names_array(spark: SparkSession, sf: str) -> DataFrame:
    return features.names_array(standins.names(spark, sf))


def territory_with_names(spark: SparkSession, sf: str) -> DataFrame:
    return assemble(standins.territory(spark, sf), standins.names(spark, sf)).dataframe


def ndm_shape(spark: SparkSession, sf: str) -> DataFrame:
    return features.ndm_attributes(standins.ndm(spark, sf), standins.NDM_PAYLOAD)


def territory_full_attributes(spark: SparkSession, sf: str) -> DataFrame:
    notes = standins.territory(spark, sf).select(
        "FEATURE_ID", F.upper("NAME").alias("NAME"), (F.col("SIZE") * 2).alias("WIDTH")
    ).filter(F.col("FEATURE_ID") % 5 != 0)
    base, names, _, ndm = _four(spark, sf)
    return assemble(base, names, notes, ndm, json_cols=standins.NDM_PAYLOAD).dataframe


def first_row_of_names(spark: SparkSession, sf: str) -> DataFrame:
    ranked = standins.names(spark, sf).select("FEATURE_ID", "NAME_RANK", "UNPARSED_FULL_NAME", "UNPARSED_NAME")
    return first_row_per_key(ranked, "FEATURE_ID")


def suffixed_join(spark: SparkSession, sf: str) -> DataFrame:
    left = standins.territory(spark, sf).select("FEATURE_ID", "NAME", "BRAND")
    right = standins.ndm(spark, sf).select("FEATURE_ID", "NAME", "LENGTH")
    return left_join_suffixed(left, right, "FEATURE_ID", "_GEOMETRY")


def _areas(unions: DataFrame) -> DataFrame:
    return unions.groupBy("FEATURE_ID").agg(F.sum(wkb.wkb_area("geometry")).alias("area"))


def feature_union_area(spark: SparkSession, sf: str) -> DataFrame:
    return _areas(union.union_features(standins.pieces(spark, sf)))


def feature_union_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _areas(union.union_features(standins.pieces(spark, sf, width=2)))


def feature_union_lines(spark: SparkSession, sf: str) -> DataFrame:
    x, y = (F.col("l_suppkey") % 4).cast("double"), F.col("l_linenumber").cast("double")
    lines = standins.read(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("FEATURE_ID"), wkb.line_wkb(x, y, x + 2.0, y).alias("geometry")
    )
    return union.union_features(lines).select("FEATURE_ID", wkb.wkb_length("geometry").alias("length"))


def collection_union(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("o_custkey") % 50).cast("double")
    orders = standins.read(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ROW_ID"),
        wkb.rectangle_wkb(x, x, x + 1.0, x + 1.0).alias("one"),
        wkb.rectangle_wkb(x + 0.5, x, x + 1.5, x + 1.0).alias("two"),
    )
    both = F.concat(F.unhex(F.lit("010700000002000000")), "one", "two")
    rows = orders.select("ROW_ID", F.when(F.col("ROW_ID") % 3 == 0, both).otherwise(F.col("one")).alias("geometry"))
    dissolved = union.dissolve_collections(rows)
    return dissolved.select(
        "ROW_ID", wkb.geometry_type(F.col("geometry")).alias("type"), wkb.wkb_area("geometry").alias("area")
    )


def flagship_features(spark: SparkSession, sf: str) -> DataFrame:
    base, names, pieces, ndm = _four(spark, sf)
    table = assemble(base, names, pieces, ndm, json_cols=standins.NDM_PAYLOAD).dataframe
    return table.withColumn("AREA", wkb.wkb_area("geometry")).drop("geometry")


def territory_own_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Territory rows that bring their own geometry, several rows per feature."""
    attributes = standins.territory(spark, sf).select("FEATURE_ID", "NAME", "KIND")
    rows = attributes.join(standins.pieces(spark, sf), "FEATURE_ID").withColumnRenamed("geometry", "SHAPE")
    table = assemble(rows, standins.names(spark, sf)).dataframe
    return table.select("FEATURE_ID", "NAME", "KIND", F.length("NAMES_ARRAY").alias("NAMES_LENGTH"), wkb.wkb_area("geometry").alias("AREA"))


def decimal_narrow(spark: SparkSession, sf: str) -> DataFrame:
    priced = standins.read(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("decimal(20,0)").alias("customer"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("price"),
    )
    legacy = narrow_decimals(priced, legacy_decimal=True).select("o_orderkey", F.col("price").cast("bigint").alias("whole_price"))
    return narrow_decimals(priced).join(legacy, "o_orderkey")


# History


def exports_history(spark: SparkSession, sf: str) -> DataFrame:
    joined = history.exports_history(standins.exports(spark, sf), standins.performance(spark, sf))
    return joined.select(
        *[c for c in history.EXPORT_COLUMNS if c not in ("fetch_timestamp", "sf_data_timestamp", "sf_query_ids")],
        F.unix_micros("fetch_timestamp").alias("fetched_micros"),
        F.unix_micros("sf_data_timestamp").alias("data_micros"),
        "rows_fetched",
        "columns_fetched",
        F.array_join(F.sort_array(F.map_values("joined_tables")), ",").alias("roles"),
        F.size("table_shapes").alias("shapes"),
        "duration",
        "predicted_duration",
    )


def _training(spark: SparkSession, sf: str) -> DataFrame:
    return history.training_set(standins.exports(spark, sf), standins.performance(spark, sf))


def training_set(spark: SparkSession, sf: str) -> DataFrame:
    return _training(spark, sf).select("id", "export_id", "rows_fetched", "columns_fetched", "duration", "is_spatial")


def training_count(spark: SparkSession, sf: str) -> DataFrame:
    return history.training_count(standins.exports(spark, sf), standins.performance(spark, sf))


def latest_model(spark: SparkSession, sf: str) -> DataFrame:
    return history.latest_model(standins.models(spark, sf)).select("id", "created_at", "name", "type", "artifact_path")


def models_packaged(spark: SparkSession, sf: str) -> DataFrame:
    return history.packaged_models(standins.models(spark, sf)).select(
        "id", "created_at", "name", "type", F.col("parameters")["alpha"].alias("alpha"),
        F.col("metrics")["folds"].alias("folds"), "artifact_path",
    )


def actual_duration(spark: SparkSession, sf: str) -> DataFrame:
    return history.actual_durations(standins.exports(spark, sf))


def _run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Registration, start and finish events of each run."""
    runs = standins.exports(spark, sf)

    def event(place: int, state: Column, started: Column, path: Column) -> Column:
        return F.struct(
            F.lit(place).alias("event_seq"),
            state.alias("status"),
            started.cast("timestamp_ntz").alias("started"),
            path.cast("string").alias("path"),
        )

    none = F.lit(None)
    done = F.when(F.col("status") == "COMPLETED", F.col("output_path"))
    events = F.array(
        event(1, F.lit("UNKNOWN"), none, none),
        event(2, F.lit("IN_PROGRESS"), F.col("fetch_timestamp"), none),
        F.when(F.col("status") != "IN_PROGRESS", event(3, F.col("status"), none, done)),
    )
    return runs.select("id", F.inline(F.filter(events, lambda e: e.isNotNull())))


def run_log_state(spark: SparkSession, sf: str) -> DataFrame:
    """Current state of each run from its registration, start and finish events."""
    return history.latest_runs(_run_events(spark, sf))


def run_log_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The same state from a run log that takes the events in out of order, some of them twice, as two snapshots."""
    events = _run_events(spark, sf).selectExpr(
        "id", "event_seq as step", "status", "cast(started as timestamp) as fetch_timestamp", "path as output_path"
    )
    log = RunLog(spark, shared_folder(spark))
    log.load(events.filter("step <> 2"))
    log.load(events.filter("step <> 3"))
    started = F.col("fetch_timestamp").cast("timestamp_ntz").alias("started")
    return log.runs().select("id", "status", started, F.col("output_path").alias("path"))


# Duration model


def duration_features(spark: SparkSession, sf: str) -> DataFrame:
    names = [*duration.NUMERIC_FEATURES, *duration.SHAPE_FEATURES]
    featured = duration.duration_features(standins.performance(spark, sf))
    return featured.select("id", *[F.round(c, 6).alias(c) for c in names], F.round(F.log1p("duration"), 6).alias("log_seconds"))


def role_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    records = standins.performance(spark, sf)
    vocabulary = duration.role_vocabulary(records)
    hot = duration.one_hot(duration.roles_joined(F.col("joined_tables")), vocabulary)
    return records.select("id", *[h.cast("int").alias(v) for h, v in zip(hot, vocabulary)])


def _model_rows(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    records = _kept_records(_training(spark, sf))
    vocabulary = duration.role_vocabulary(records)
    return duration.training_rows(records, vocabulary), duration.feature_names(vocabulary)


def _kept_records(records: DataFrame) -> DataFrame:
    """What a model learns from, written once to the shared folder: the roles, the fold borders, the fold sizes and the rows are a pass each."""
    spark = records.sparkSession
    folder = f"{shared_folder(spark)}/training"
    kept = records.select("id", "duration", *duration.PREDICT_REQUIRED, "is_spatial")
    kept.write.parquet(folder)
    return spark.read.schema(kept.schema).parquet(folder)


def contiguous_fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _model_rows(spark, sf)
    return contiguous_folds(rows, "id", duration.FOLDS).groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )


def shuffled_fold_of_record(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = _model_rows(spark, sf)
    return shuffled_folds(rows, "id", duration.FOLDS, duration.SEED).select("id", "fold")


def ridge_fold_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows, names = _model_rows(spark, sf)
    moments = duration.fold_moments(contiguous_folds(rows, "id", duration.FOLDS), names)
    width, target = len(names) + 1, len(names)
    mean = lambda i: F.round(F.col("mean")[i], 6)
    cov = lambda i, j: F.round(F.col("cross")[i * width + j] / F.col("n"), 6)
    return moments.select(
        "fold",
        "n",
        *[mean(i).alias(f"mean_{i}") for i in range(8)],
        mean(target).alias("mean_target"),
        *[cov(target, i).alias(f"cov_target_{i}") for i in range(8)],
        *[cov(i, i).alias(f"var_{i}") for i in range(8)],
    )


def ridge_fit(spark: SparkSession, sf: str) -> DataFrame:
    model = duration.fit(_training(spark, sf))
    names = ["intercept", *duration.NUMERIC_FEATURES, *duration.SHAPE_FEATURES, *model.vocabulary]
    rows = list(zip(names, [model.intercept, *model.coefficients], strict=True))
    fitted = spark.createDataFrame(rows, "feature string, coefficient double")
    return fitted.withColumn("coefficient", F.round("coefficient", 6))


def ridge_predict(spark: SparkSession, sf: str) -> DataFrame:
    model = duration.fit(_training(spark, sf))
    predicted = model.predict(standins.performance(spark, sf), strict=False)
    return predicted.select("id", F.round("predicted_seconds", 6).alias("predicted_seconds"), "missing_fields")


def ridge_tune(spark: SparkSession, sf: str) -> DataFrame:
    best = duration.tune_alpha(_training(spark, sf))
    row = (float(best["best_alpha"]), round(best["best_mae"], 6))
    return spark.createDataFrame([row], "best_alpha double, best_mae double")


def ridge_kfold_mae(spark: SparkSession, sf: str) -> DataFrame:
    scored = duration.evaluate_kfold(_training(spark, sf))
    row = (round(scored["mae_seconds"], 6), scored["record_count"], scored["folds"])
    return spark.createDataFrame([row], "mae_seconds double, record_count bigint, folds int")


# Status events


def status_revisions(spark: SparkSession, sf: str) -> DataFrame:
    return status.status_revisions(standins.status_events(spark, sf))


def status_event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The revisions of ``status_revisions`` from a stream whose three micro-batches come in no order of time."""
    folder = shared_folder(spark)
    arriving = standins.status_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    arriving = arriving.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int"))
    arriving.write.partitionBy("part").parquet(f"{folder}/in")
    files = len(spark.read.parquet(f"{folder}/in").inputFiles())
    events = status_stream.read_events(spark, f"{folder}/in", max_files_per_trigger=-(-files // 3))
    shares = event_time.shares_for(spark.read.schema(status_stream.EVENT_SCHEMA).parquet(f"{folder}/in"), 6 * 3600)
    pages = event_time.status_pages(events, bucket_seconds=6 * 3600, delay="12 hours", shares=shares)
    query = event_time.write_pages(pages, f"{folder}/pages", f"{folder}/check", available_now=True)
    query.awaitTermination()
    numbered = event_time.revisions(spark.read.schema(event_time.PAGE_SCHEMA).parquet(f"{folder}/pages"))
    return numbered.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def status_current(spark: SparkSession, sf: str) -> DataFrame:
    return status.current_status(standins.status_events(spark, sf))


def export_progress(spark: SparkSession, sf: str) -> DataFrame:
    events = standins.status_events(spark, sf)
    user = F.regexp_extract("worker_id", "_([0-9]+)$", 1).cast("int")
    workers = (
        status.current_status(events)
        .join(events.groupBy("worker_id").agg(F.min("ts").alias("started_at")), "worker_id")
        .withColumn("estimated_seconds", F.when(user % 7 != 0, (user - 20) * 20000.0))
    )
    progress = status.export_progress(workers, F.lit(AS_OF).cast("timestamp_ntz"))
    return progress.withColumn("percent", F.round("percent", 6))


def downloads_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return status.downloads_per_group(standins.status_events(spark, sf))


def session_downloads(spark: SparkSession, sf: str) -> DataFrame:
    return status.session_downloads(standins.status_events(spark, sf))


_QUERIES: list[Query] = [
    list_tables_like, list_tables_all, catalog_preprocess, catalog_groups, catalog_listing, catalog_listing_flat,
    table_sets, resolve_table_set, group_key_unique,
    column_types, scan_projection, scan_limit, table_set_shapes, table_set_metrics, text_profile, wkb_validity,
    wkb_hex_profile, detect_geometry, spatial_prepare, geometry_headers,
    names_array, territory_with_names, ndm_shape, territory_full_attributes, first_row_of_names, suffixed_join,
    feature_union_area, feature_union_overlap, feature_union_lines, collection_union, flagship_features,
    territory_own_geometry, decimal_narrow,
    exports_history, training_set, training_count, latest_model, models_packaged, actual_duration, run_log_state, run_log_snapshot,
    duration_features, role_one_hot, contiguous_fold_sizes, shuffled_fold_of_record, ridge_fold_stats, ridge_fit,
    ridge_predict, ridge_tune, ridge_kfold_mae,
    status_revisions, status_event_stream, status_current, export_progress, downloads_per_group, session_downloads,
]


def queries() -> dict[str, Query]:
    """All registered queries by name; each ships the package to the executors first."""

    def shipped(query: Query) -> Query:
        return lambda spark, sf_dir: query(ship(spark), sf_dir)

    named = {query.__name__: shipped(query) for query in _QUERIES}
    if corpus:
        named |= corpus.queries()
    if pipeline:
        named["pipeline"] = shipped(pipeline.run)
    return named


# The same stand-ins in SQL.

_CATALOG = r"""
raw as (
  select concat('N', c_nationkey, case o_orderkey % 8
      when 0 then concat('_TERRITORY_', d)
      when 1 then concat('_TERRITORY_NAME_', d)
      when 2 then concat('_', d, '_GEOMETRY_DATA')
      when 3 then concat('_SOURCE_TABLE_', d, '_GEOMETRY_DATA')
      when 4 then concat('_', d, '_NDM_DATA')
      when 5 then concat('_POSTCODE_', d)
      when 6 then concat('_', d)
      else concat('_', d, '_TERRITORY_NAME') end) as table_name,
    o_orderdate as created
  from (select *, concat(year(o_orderdate), '0101') as d from orders) o
  join customer on o_custkey = c_custkey),
cat as (select table_name, max(created) as created from raw group by table_name),
prep as (
  select table_name, created,
    list_max(regexp_extract_all(table_name, '\d{8}')) as date_from_name,
    regexp_replace(regexp_replace(table_name, '_(TERRITORY_NAME|POSTCODE|TERRITORY|SOURCE_TABLE)', ''),
      '_(GEOMETRY_DATA|NDM_DATA)$', '') as group_key,
    case when contains(table_name, '_GEOMETRY_DATA') then 'geometry_source'
      when contains(table_name, '_NDM_DATA') then 'ndm_source'
      when contains(table_name, '_TERRITORY_NAME_') then 'name'
      when contains(table_name, '_TERRITORY_') then 'territory' else 'other' end as table_type
  from cat),
grouped as (
  select group_key,
    list(created order by created desc nulls first, table_name) as dates,
    list(table_name order by created desc nulls first, table_name) filter (table_type = 'territory') as territory,
    list(table_name order by created desc nulls first, table_name) filter (table_type = 'name') as name,
    list(table_name order by created desc nulls first, table_name)
      filter (table_type = 'geometry_source') as geometry_source,
    list(table_name order by created desc nulls first, table_name)
      filter (table_type = 'geometry_source' and contains(table_name, '_SOURCE_TABLE_')) as preferred,
    list(table_name order by created desc nulls first, table_name) filter (table_type = 'ndm_source') as ndm_source,
    list(table_name order by created desc nulls first, table_name) filter (table_type = 'other') as other,
    coalesce(first(created order by created desc nulls first, table_name) filter (table_type = 'territory'),
      max(created)) as territory_table_creation_date
  from prep group by group_key),
groups as (
  select *, coalesce(territory[1], other[1], geometry_source[1], name[1], ndm_source[1]) as territory_table_primary,
    coalesce(preferred[1], geometry_source[1]) as geometry_source_primary
  from grouped)
"""

_TERRITORY = """
territory as (select p_partkey as FEATURE_ID, p_name as NAME, p_brand as BRAND, p_type as KIND, p_size as SIZE,
  p_retailprice as PRICE from part)
"""

_NAMES = """
names as (
  select l_partkey as FEATURE_ID,
    concat(l_returnflag, '-', l_linestatus, '-', l_orderkey, '-', l_suppkey) as UNPARSED_FULL_NAME,
    case when l_linenumber % 2 <> 0 then concat('n', l_linenumber) end as UNPARSED_NAME,
    case when l_linestatus = 'F' then 'fr' when l_linenumber = 7 then null else 'en' end as LANGUAGE,
    l_returnflag as NAME_TYPE, cast(null as varchar) as CODE_TYPE, l_linenumber as NAME_RANK,
    l_linestatus as LOCALE_LIST_USE
  from lineitem),
names_array as (
  select FEATURE_ID, concat('[', string_agg(j, ',' order by NAME_RANK, j), ']') as NAMES_ARRAY
  from (select FEATURE_ID, NAME_RANK, cast(to_json(struct_pack(UNPARSED_FULL_NAME, UNPARSED_NAME, LANGUAGE, NAME_TYPE,
    CODE_TYPE, NAME_RANK, LOCALE_LIST_USE)) as varchar) as j from names)
  group by FEATURE_ID)
"""

_NDM = """
ndm as (
  select p_partkey as FEATURE_ID, concat('{"size":', p_size, '}') as FEATURE_PROTO,
    concat('{"kind":"', p_type, '"}') as METADATA, concat('{"brand":"', p_brand, '"}') as MANUAL_EDITS,
    p_brand as NAME, p_size as LENGTH_NDM, p_retailprice as AREA_NDM, p_size * 2 as PERIMETER_NDM
  from part where p_partkey % 3 <> 0)
"""

_CELLS = """
cells as (select distinct l_partkey as f, l_suppkey % 4 as x, l_linenumber - 1 as y from lineitem),
areas as (select f as FEATURE_ID, cast(count(*) as double) as area from cells group by f)
"""

_EXPORTS = """
exports as (
  select o_orderkey as id, concat('G', o_custkey % 100) as group_key, concat('T', o_orderkey) as primary_table_name,
    case when o_orderkey % 4 >= 2 then concat('GEO', o_orderkey) end as geography_table,
    case when o_orderkey % 2 = 1 then concat('NAM', o_orderkey) end as name_table,
    case when o_orderkey % 8 >= 4 then concat('NDM', o_orderkey) end as ndm_table,
    'DB' as sf_database, 'APP' as sf_schema, o_orderdate as sf_data_timestamp, o_orderdate as fetch_timestamp,
    case when o_orderstatus = 'F' then cast(floor(o_totalprice / 1000) as double) end as seconds,
    concat('/out/T', o_orderkey, '.gpkg') as output_path,
    case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'IN_PROGRESS' else 'FAILED' end as status
  from orders),
lines as (
  select l_orderkey as k, cast(sum(l_quantity) as bigint) as r, count(*) as c from lineitem group by l_orderkey),
perf as (
  select k as id, k as export_id, case when k % 97 <> 0 then r end as rows_fetched, c as columns_fetched, r, c,
    case when o_orderstatus = 'F' then cast(floor(o_totalprice / 1000) as double) end as duration,
    (k // 2) % 2 = 1 as is_spatial, 1 + k % 2 + (k // 2) % 2 + (k // 4) % 2 as roles
  from lines left join orders on k = o_orderkey),
training as (
  select p.* from perf p join exports e on p.export_id = e.id
  where e.status = 'COMPLETED' and rows_fetched is not null and duration is not null)
"""

_FEATURES = """
feats as (
  select *, ln(1 + coalesce(rows_fetched, 0)) as f0, ln(1 + columns_fetched) as f1,
    ln(1 + cast(coalesce(rows_fetched, 0) as double) * columns_fetched) as f2, cast(roles as double) as f3,
    cast(is_spatial as int)::double as f4, ln(1 + r * roles) as f5, ln(1 + c * roles) as f6,
    ln(1 + cast(r * roles as double) * (c * roles)) as f7, ln(1 + duration) as y
  from {source})
"""

_SHUFFLED = """
shuffled as (
  select *, cast((row_number() over (order by cast(concat('0x', substr(md5(concat('42:', id)), 1, 15)) as bigint), id)
    - 1) % 5 as int) as fold from {source})
"""

# Ridge on standardized features: standardize each training set, add up the normal equations
# and eliminate. ``hold`` is the fold left out; -1 leaves out none.
_RIDGE = """
long as (
  select id, fold, y, unnest(range(12)) as i, unnest([f0, f1, f2, f3, f4, f5, f6, f7,
    cast((id // 4) % 2 as double), cast((id // 2) % 2 as double), cast(id % 2 as double), 1.0::double]) as x
  from {folded}),
holds as (select unnest({holds}) as hold),
part as (select * from long, holds where fold <> hold),
scale as (
  select hold, i, avg(x) as m, case when stddev_pop(x) < 1e-12 then 1 else stddev_pop(x) end as s, avg(y) as my
  from part group by hold, i),
z as (select p.hold, id, i, (x - m) / s as z, y - my as c from part p join scale using (hold, i)),
gram as (
  select a.hold, a.i, b.i as j, sum(a.z * b.z) as g from z a join z b on a.hold = b.hold and a.id = b.id
  group by a.hold, a.i, b.i),
alphas as (select unnest({alphas}) as alpha),
system as (
  select hold, alpha, list(cells order by i) as m from (
    select hold, alpha, i, list_append(list(g + case when i = j then alpha else 0 end order by j), any_value(r)) as cells
    from gram join (select hold, i, sum(z * c) as r from z group by hold, i) using (hold, i), alphas
    group by hold, alpha, i) group by hold, alpha),
steps as (
  select hold, alpha, 1 as k, m from system
  union all
  select hold, alpha, k + 1, list_transform(m, lambda r, p: case when p = k
      then list_transform(r, lambda v: v / m[k][k])
      else list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) end)
  from steps where k <= 12),
weights as (
  select hold, alpha, unnest(range(12)) as i, unnest(list_transform(m, lambda r: r[13])) as w
  from steps where k = 13),
models as (
  select hold, alpha, any_value(my) - sum(w / s * m) as intercept, list(w / s order by i) as coefficients
  from weights join scale using (hold, i) group by hold, alpha)
"""

_STATUS = """
ev as (
  select ts, event_id, concat('G', user_id % 20, '_', user_id) as worker_id, user_id,
    case event_type when 'click' then 'FETCHING_TABLES' when 'signup' then 'JOINING_TABLES'
      when 'purchase' then 'COMPLETED' when 'error' then 'FAILED' else 'IN_PROGRESS' end as status
  from events)
"""

_TABLES_SCHEMA = "case when table_name like 'N1%' then 'OTHER' else 'APP' end"
_JOINED = "FEATURE_ID, NAME, BRAND, KIND, SIZE, PRICE"


def oracle_sql() -> dict[str, str]:
    """For each query that SQL can express, the same rows in DuckDB's SQL."""
    found = _own_sql()
    if corpus:
        found |= corpus.oracle_sql()
    if pipeline and pipeline.ORACLE_SQL:
        found["pipeline"] = pipeline.ORACLE_SQL
    return found


def _own_sql() -> dict[str, str]:
    stats = ", ".join(
        [f"round(avg(f{i}), 6) as mean_{i}" for i in range(8)]
        + ["round(avg(y), 6) as mean_target"]
        + [f"round(covar_pop(y, f{i}), 6) as cov_target_{i}" for i in range(8)]
        + [f"round(var_pop(f{i}), 6) as var_{i}" for i in range(8)]
    )
    feature_names = [*duration.NUMERIC_FEATURES, *duration.SHAPE_FEATURES]
    feature_list = ", ".join(f"round(f{i}, 6) as {n}" for i, n in enumerate(feature_names))
    roles = ["NDM_table", "geometry_table", "name_table", "territory_primary_table"]
    coefficient_names = ", ".join(f"'{n}'" for n in [*feature_names, *roles])
    inputs = [f"f{i}" for i in range(8)] + ["(id // 4) % 2", "(id // 2) % 2", "id % 2", "1"]
    linear = " + ".join(f"coefficients[{i + 1}] * ({x})" for i, x in enumerate(inputs))
    alphas = "[" + ", ".join(f"{a}::double" for a in duration.ALPHAS) + "]"
    lists = ", ".join(f"coalesce(array_to_string({k}, ','), '') as {k}_tables" for k in catalog.TABLE_TYPES)
    run_states = f"""with {_EXPORTS} select id, status, fetch_timestamp as started,
        case when status = 'COMPLETED' then output_path end as path from exports"""
    revisions = f"""with {_STATUS},
        changed as (select *, lag(status, 1, 'IDLE') over (partition by worker_id order by ts, event_id) as was from ev)
        select worker_id, ts, event_id, status,
          row_number() over (partition by worker_id order by ts, event_id) as revision
        from changed where status <> was"""
    return {
        "list_tables_like": f"with {_CATALOG} select table_name, created from cat where {_TABLES_SCHEMA} = 'APP' "
        r"and (table_name like 'N%_TERRITORY_%') order by created desc nulls first",
        "list_tables_all": f"with {_CATALOG} select table_name, created from cat where {_TABLES_SCHEMA} = 'APP'",
        "catalog_preprocess": f"with {_CATALOG} select * from prep",
        "catalog_groups": f"""with {_CATALOG}
            select group_key, array_to_string(list_transform(dates, lambda d: strftime(d, '%Y-%m-%d')), ',') as dates,
              territory_table_creation_date, territory_table_primary, geometry_source_primary, {lists}
            from groups""",
        "catalog_listing": f"""with {_CATALOG} select territory_table_primary as table_name,
            coalesce(strftime(territory_table_creation_date, '%Y-%m-%d %H:%M:%S'), '') as created from groups""",
        "catalog_listing_flat": f"""with {_CATALOG}
            select table_name, coalesce(strftime(created, '%Y-%m-%d %H:%M:%S'), '') as created from cat""",
        "table_sets": f"""with {_CATALOG} select group_key, territory_table_primary as territory_table,
            geometry_source_primary as geometry_table, ndm_source[1] as ndm_table, name[1] as name_table from groups""",
        "resolve_table_set": f"""with {_CATALOG} select group_key, territory_table_primary as territory_table,
            geometry_source_primary as geometry_table, ndm_source[1] as ndm_table, name[1] as name_table
            from groups where group_key = 'N3_19960101'""",
        "group_key_unique": f"""with {_CATALOG} select concat(group_key, '_',
              regexp_replace(md5(concat('{RUN_ID}', group_key)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$',
              '\\1-\\2-\\3-\\4-\\5')) as group_key, count(*) as tables
            from prep group by prep.group_key""",
        "column_types": """select cast(row_number() over () as int) as ordinal, column_name,
            case column_type when 'VARCHAR' then 'STRING' when 'INTEGER' then 'INT' else column_type end as data_type
            from (describe part)""",
        "scan_projection": f"with {_TERRITORY} select FEATURE_ID, NAME, PRICE from territory",
        "scan_limit": f"""with {_TERRITORY} select FEATURE_ID, PRICE from territory
            order by PRICE desc, FEATURE_ID limit 50""",
        "table_set_shapes": """
            select 0::int as ordinal, 'main' as role, 'territory_primary_table' as table_role, count(*) as "rows",
              6::bigint as "columns" from part
            union all select 1, 'join_1', 'name_table', count(*), 8 from lineitem
            union all select 2, 'join_2', 'geometry_table', count(*), 2 from lineitem
            union all select 3, 'join_3', 'NDM_table', count(*), 10 from part where p_partkey % 3 <> 0""",
        "table_set_metrics": """with n as (select (select count(*) from part) as t, (select count(*) from lineitem) as l,
              (select count(*) from part where p_partkey % 3 <> 0) as m)
            select t + 2 * l + m as rows_fetched, 26::bigint as columns_fetched, true as is_spatial,
              'NDM_table,geometry_table,name_table,territory_primary_table' as roles,
              concat(t, 'x6,', l, 'x8,', l, 'x2,', m, 'x10') as shapes from n""",
        "text_profile": r"""with t as (
              select hex(encode(text)) as hex_text, hex(encode(substring(text, 1, 3))) as short_hex, text as plain, lang,
                case when doc_id % 2 = 0 then concat(doc_id, ' ') end as number_text from documents),
            u as (select 'hex_text' as column_name, hex_text as v from t union all select 'short_hex', short_hex from t
              union all select 'plain', plain from t union all select 'lang', lang from t
              union all select 'number_text', number_text from t),
            f as (select column_name, v,
                length(v) % 2 = 0 and not regexp_matches(v, '[^0-9A-Fa-f \t\n\x0B\f\r]')
                  and len(list_filter(regexp_split_to_array(v, '[ \t\n\x0B\f\r]+'), lambda p: length(p) % 2 = 1)) = 0
                  as is_hex,
                regexp_matches(v, '[^\x20-\x7E]') as is_bin from u)
            select column_name, count(v) as "values", count_if(is_hex) as hex_values, count_if(is_bin) as binary_values,
              count(v) > 0 and coalesce(bool_and(is_hex or is_bin), false) as looks_binary
            from f group by column_name""",
        "wkb_validity": """with v(variant, ok) as (values ('good', 1), ('trailing_bytes', 1), ('truncated', 0),
              ('bad_type', 0), ('odd_order', 1), ('with_srid', 1), ('open_ring', 0)),
            n as (select count(*) as c from lineitem)
            select variant, c as "values", c * ok as valid_values, ok = 1 as all_valid from v, n""",
        "wkb_hex_profile": 'select count(*) as "values", count(*) as valid_values, true as all_valid from lineitem',
        "detect_geometry": """select * from (values ('binary', 'WKB_BINARY', 'geometry', 'POLARS'),
            ('geography', 'SNOWFLAKE_GEOGRAPHY', 'geometry', 'SNOWFLAKE'), ('hex_text', 'WKB_TEXT', 'SHAPE', 'POLARS'),
            ('named_wkb', 'WKB_BINARY', 'SHAPE_WKB', 'POLARS'), ('none', null, null, null))
            as t(searched, "TYPE", "COLUMN", "SOURCE")""",
        "spatial_prepare": f"with {_CELLS} select FEATURE_ID, area from areas",
        "geometry_headers": """select cast(l_linenumber % 2 as int) as with_srid, 'Polygon' as type,
            cast(case when l_linenumber % 2 = 1 then 4326 else 0 end as int) as srid, count(*) as "rows"
            from lineitem group by 1, 2, 3""",
        "names_array": f"""with {_NAMES} select FEATURE_ID, 0::int as NAMES_PART, NAMES_ARRAY from names_array""",
        "territory_with_names": f"""with {_TERRITORY}, {_NAMES}
            select {_JOINED}, 0::int as NAMES_PART, NAMES_ARRAY from territory left join names_array using (FEATURE_ID)""",
        "ndm_shape": f"with {_NDM} select * from ndm",
        "territory_full_attributes": f"""with {_TERRITORY}, {_NAMES}, {_NDM}
            select FEATURE_ID, t.NAME, BRAND, KIND, SIZE, PRICE, 0::int as NAMES_PART, NAMES_ARRAY,
              case when FEATURE_ID % 5 <> 0 then upper(t.NAME) end as NAME_GEOMETRY,
              case when FEATURE_ID % 5 <> 0 then SIZE * 2 end as WIDTH,
              FEATURE_PROTO, METADATA, MANUAL_EDITS, n.NAME as NAME_right, LENGTH_NDM, AREA_NDM, PERIMETER_NDM
            from territory t left join names_array using (FEATURE_ID) left join ndm n using (FEATURE_ID)""",
        "first_row_of_names": f"""with {_NAMES}
            select FEATURE_ID, NAME_RANK, UNPARSED_FULL_NAME, UNPARSED_NAME from names
            qualify row_number() over (partition by FEATURE_ID
              order by NAME_RANK, UNPARSED_FULL_NAME, UNPARSED_NAME nulls first) = 1""",
        "suffixed_join": f"""with {_TERRITORY}, {_NDM}
            select FEATURE_ID, t.NAME, BRAND, n.NAME as NAME_GEOMETRY, LENGTH_NDM as LENGTH
            from territory t left join ndm n using (FEATURE_ID)""",
        "feature_union_area": f"with {_CELLS} select FEATURE_ID, area from areas",
        "feature_union_overlap": """with cells as (
              select distinct l_partkey as f, (l_suppkey % 4) + s as x, l_linenumber as y
              from lineitem, (values (0), (1)) as w(s))
            select f as FEATURE_ID, cast(count(*) as double) as area from cells group by f""",
        "feature_union_lines": """with cells as (
              select distinct l_partkey as f, (l_suppkey % 4) + s as x, l_linenumber as y
              from lineitem, (values (0), (1)) as w(s))
            select f as FEATURE_ID, cast(count(*) as double) as length from cells group by f""",
        "collection_union": """select o_orderkey as ROW_ID, 'Polygon' as type,
            case when o_orderkey % 3 = 0 then 1.5::double else 1.0::double end as area from orders""",
        "flagship_features": f"""with {_TERRITORY}, {_NAMES}, {_NDM}, {_CELLS}
            select FEATURE_ID, t.NAME, BRAND, KIND, SIZE, PRICE, 0::int as NAMES_PART, NAMES_ARRAY, FEATURE_PROTO,
              METADATA, MANUAL_EDITS, n.NAME as NAME_right, LENGTH_NDM, AREA_NDM, PERIMETER_NDM,
              0::int as GEOMETRY_PART, area as AREA
            from territory t left join names_array using (FEATURE_ID) left join areas using (FEATURE_ID)
              left join ndm n using (FEATURE_ID)""",
        "territory_own_geometry": f"""with {_TERRITORY}, {_NAMES}, {_CELLS}
            select FEATURE_ID, NAME, KIND, cast(length(NAMES_ARRAY) as int) as NAMES_LENGTH, area as AREA
            from territory join areas using (FEATURE_ID) left join names_array using (FEATURE_ID)""",
        "decimal_narrow": """select o_orderkey, o_custkey as customer,
            cast(cast(o_totalprice as decimal(12,2)) as double) as price,
            cast(cast(cast(o_totalprice as decimal(12,2)) as decimal(19,0)) as bigint) as whole_price from orders""",
        "exports_history": f"""with {_EXPORTS}
            select e.id, group_key, primary_table_name, geography_table, name_table, ndm_table, output_path, sf_database,
              sf_schema, status, epoch_us(fetch_timestamp) as fetched_micros, epoch_us(sf_data_timestamp) as data_micros,
              rows_fetched, columns_fetched,
              case when p.id is not null then array_to_string(list_sort(list_filter(['territory_primary_table',
                case when e.id % 2 = 1 then 'name_table' end, case when (e.id // 2) % 2 = 1 then 'geometry_table' end,
                case when (e.id // 4) % 2 = 1 then 'NDM_table' end], lambda v: v is not null)), ',') end as roles,
              cast(p.roles as int) as shapes, duration, cast(null as double) as predicted_duration
            from exports e left join perf p on p.export_id = e.id""",
        "training_set": f"""with {_EXPORTS}
            select id, export_id, rows_fetched, columns_fetched, duration, is_spatial from training""",
        "training_count": f"with {_EXPORTS} select count(*) as training_records from training",
        "latest_model": """select s_suppkey as id, timestamp '2024-01-01' + to_days(cast(s_suppkey as int)) as created_at,
            concat('ExportDurationRidge_', s_name) as name, 'ridge' as type, concat('models/', s_name) as artifact_path
            from supplier order by id desc limit 1""",
        "models_packaged": """select s_suppkey as id,
            timestamp '2024-01-01' + to_days(cast(s_suppkey as int)) as created_at,
            concat('ExportDurationRidge_', s_name) as name, 'ridge' as type, cast(s_nationkey + 1 as varchar) as alpha,
            '5' as folds, concat('models/', s_name) as artifact_path from supplier""",
        "actual_duration": f"with {_EXPORTS} select id, seconds from exports",
        "run_log_state": run_states,
        "run_log_snapshot": run_states,
        "duration_features": f"""with {_EXPORTS}, {_FEATURES.format(source="perf")}
            select id, {feature_list}, round(y, 6) as log_seconds from feats""",
        "role_one_hot": f"""with {_EXPORTS} select id, cast((id // 4) % 2 as int) as NDM_table,
            cast((id // 2) % 2 as int) as geometry_table, cast(id % 2 as int) as name_table,
            1::int as territory_primary_table from perf""",
        "contiguous_fold_sizes": f"""with {_EXPORTS},
            f as (select id, ntile(5) over (order by id) - 1 as fold from training)
            select cast(fold as int) as fold, count(*) as "rows", min(id) as first_id, max(id) as last_id
            from f group by fold""",
        "shuffled_fold_of_record": f"""with {_EXPORTS}, {_SHUFFLED.format(source="training")}
            select id, fold from shuffled""",
        "ridge_fold_stats": f"""with {_EXPORTS}, {_FEATURES.format(source="training")},
            f as (select *, cast(ntile(5) over (order by id) - 1 as int) as fold from feats)
            select fold, count(*) as n, {stats} from f group by fold""",
        "ridge_fit": f"""with recursive {_EXPORTS}, {_FEATURES.format(source="training")},
            folded as (select *, 0 as fold from feats),
            {_RIDGE.format(folded="folded", holds="[-1]", alphas="[1.0::double]")}
            select unnest(['intercept', {coefficient_names}]) as feature,
              unnest(list_transform(list_prepend(intercept, coefficients), lambda c: round(c, 6))) as coefficient
            from models""",
        "ridge_predict": f"""with recursive {_EXPORTS}, {_FEATURES.format(source="training")},
            folded as (select *, 0 as fold from feats),
            {_RIDGE.format(folded="folded", holds="[-1]", alphas="[1.0::double]")},
            scored as (select t.* from ({_FEATURES.format(source="perf").strip()[len("feats as ("):-1]}) t)
            select id, case when rows_fetched is not null then round(greatest(exp(intercept + {linear}) - 1, 0), 6) end
                as predicted_seconds,
              case when rows_fetched is null then 'rows_fetched' else '' end as missing_fields
            from scored, models""",
        "ridge_tune": f"""with recursive {_EXPORTS}, {_FEATURES.format(source="training")},
            folded as (select *, ntile(5) over (order by id) - 1 as fold from feats),
            {_RIDGE.format(folded="folded", holds="[0, 1, 2, 3, 4]", alphas=alphas)},
            errors as (select alpha, fold, avg(abs(exp(y) - exp(intercept + {linear}))) as mae
              from folded join models on fold = hold group by alpha, fold),
            means as (select alpha, avg(mae) as mae from errors group by alpha)
            select alpha as best_alpha, round(mae, 6) as best_mae from means order by mae, alpha limit 1""",
        "ridge_kfold_mae": f"""with recursive {_EXPORTS}, {_FEATURES.format(source="training")},
            {_SHUFFLED.format(source="feats")},
            {_RIDGE.format(folded="shuffled", holds="[0, 1, 2, 3, 4]", alphas="[1.0::double]")}
            select round(avg(abs(exp(y) - exp(intercept + {linear}))), 6) as mae_seconds, count(*) as record_count,
              5::int as folds
            from shuffled join models on fold = hold""",
        "status_revisions": revisions,
        "status_event_stream": revisions,
        "status_current": f"""with {_STATUS} select worker_id, status from ev
            qualify row_number() over (partition by worker_id order by ts desc, event_id desc) = 1""",
        "export_progress": f"""with {_STATUS},
            w as (select worker_id, any_value(user_id) as u, min(ts) as started, arg_max(status, (ts, event_id)) as status
              from ev group by worker_id),
            e as (select *, case when u % 7 <> 0 then (u - 20) * 20000.0::double end as est,
              (epoch_us(timestamp '{AS_OF}') - epoch_us(started)) / 1e6 as elapsed from w)
            select worker_id, status, case status when 'FETCHING_TABLES' then 'Fetching tables'
                when 'JOINING_TABLES' then 'Joining datasets' when 'COMPLETED' then 'Export completed'
                when 'FAILED' then 'Export failed' when 'IN_PROGRESS' then 'In progress' end as status_text,
              round(case when status = 'COMPLETED' then 100.0::double
                when est > 0 then least(elapsed / est * 100, 99.0) end, 6) as percent from e""",
        "downloads_per_group": f"""with {_STATUS},
            w as (select worker_id, user_id, min((ts, event_id)) as started from ev group by worker_id, user_id)
            select concat('G', user_id % 20) as group_key, count(*) as downloads,
              arg_min(worker_id, (started, worker_id)) as first_worker from w group by user_id % 20""",
        "session_downloads": "select count(distinct user_id) as downloads from events",
    }
