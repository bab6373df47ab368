"""The reference tables of the domain, derived from the star-schema test tables.

Each function reads the whole of its source tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.wkb import rectangle_wkb


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Table Name, Creation Date): table names made of a customer's nation and an order's year."""
    orders = read(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", (F.col("o_orderkey") % 8).alias("kind"),
        F.concat(F.year("o_orderdate").cast("string"), F.lit("0101")).alias("d"),
    )
    customer = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    endings = {
        0: F.concat(F.lit("_TERRITORY_"), "d"),
        1: F.concat(F.lit("_TERRITORY_NAME_"), "d"),
        2: F.concat(F.lit("_"), "d", F.lit("_GEOMETRY_DATA")),
        3: F.concat(F.lit("_SOURCE_TABLE_"), "d", F.lit("_GEOMETRY_DATA")),
        4: F.concat(F.lit("_"), "d", F.lit("_NDM_DATA")),
        5: F.concat(F.lit("_POSTCODE_"), "d"),
        6: F.concat(F.lit("_"), "d"),
        7: F.concat(F.lit("_"), "d", F.lit("_TERRITORY_NAME")),
    }
    ending = F.when(F.col("kind") == 0, endings[0])
    for kind in range(1, 8):
        ending = ending.when(F.col("kind") == kind, endings[kind])
    named = orders.join(customer, "o_custkey").select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), ending).alias("Table Name"), "o_orderdate"
    )
    return named.groupBy("Table Name").agg(F.max("o_orderdate").alias("Creation Date"))


def territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("FEATURE_ID"),
        F.col("p_name").alias("NAME"),
        F.col("p_brand").alias("BRAND"),
        F.col("p_type").alias("KIND"),
        F.col("p_size").alias("SIZE"),
        F.col("p_retailprice").alias("PRICE"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("l_linenumber")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("FEATURE_ID"),
        F.concat_ws(
            "-", "l_returnflag", "l_linestatus", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")
        ).alias("UNPARSED_FULL_NAME"),
        F.when(number % 2 != 0, F.concat(F.lit("n"), number.cast("string"))).alias("UNPARSED_NAME"),
        F.when(F.col("l_linestatus") == "F", '["fr","en"]')
        .when(number == 7, "[]")
        .otherwise('["en"]')
        .alias("LANGUAGE"),
        F.col("l_returnflag").alias("NAME_TYPE"),
        F.lit(None).cast("string").alias("CODE_TYPE"),
        number.alias("NAME_RANK"),
        F.col("l_linestatus").alias("LOCALE_LIST_USE"),
    )


def pieces(spark: SparkSession, sf_dir: str, width: int = 1) -> DataFrame:
    """(FEATURE_ID, geometry): rectangles ``width`` x 1 on a grid, as pieces of a split feature.

    Width 1 gives edge-matched cells, width 2 overlapping ones. Copies are left in.
    """
    x = (F.col("l_suppkey") % 4).cast("double")
    y = (F.col("l_linenumber") - 1).cast("double")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("FEATURE_ID"),
        rectangle_wkb(x, y, x + F.lit(float(width)), y + F.lit(1.0)).alias("geometry"),
    )


#: Payload columns of the table that ``ndm`` gives.
NDM_PAYLOAD = ["FEATURE_PROTO", "METADATA", "MANUAL_EDITS"]


def ndm(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").filter(F.col("p_partkey") % 3 != 0)
    return part.select(
        F.col("p_partkey").alias("FEATURE_ID"),
        F.to_json(F.struct(F.col("p_size").alias("size"))).alias("FEATURE_PROTO"),
        F.to_json(F.struct(F.col("p_type").alias("kind"))).alias("METADATA"),
        F.to_json(F.struct(F.col("p_brand").alias("brand"))).alias("MANUAL_EDITS"),
        F.lit("US").alias("ISO_COUNTRY_CODE"),
        F.col("p_partkey").alias("VENDOR_ID"),
        F.col("p_brand").alias("NAME"),
        F.col("p_size").alias("LENGTH"),
        F.col("p_retailprice").alias("AREA"),
        (F.col("p_size") * 2).alias("PERIMETER"),
    )


def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "IN_PROGRESS")
    seconds = F.floor(F.col("o_totalprice") / 1000).cast("int")
    key = F.col("o_orderkey").cast("string")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("G"), (F.col("o_custkey") % 100).cast("string")).alias("group_key"),
        F.concat(F.lit("T"), key).alias("primary_table_name"),
        F.when(F.col("o_orderkey") % 4 >= 2, F.concat(F.lit("GEO"), key)).alias("geography_table"),
        F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("NAM"), key)).alias("name_table"),
        F.when(F.col("o_orderkey") % 8 >= 4, F.concat(F.lit("NDM"), key)).alias("ndm_table"),
        F.lit(None).cast("array<string>").alias("sf_query_ids"),
        F.lit("DB").alias("sf_database"),
        F.lit("APP").alias("sf_schema"),
        F.col("o_orderdate").alias("sf_data_timestamp"),
        F.col("o_orderdate").alias("fetch_timestamp"),
        F.when(
            F.col("o_orderstatus") == "F", F.timestamp_add("SECOND", seconds, F.col("o_orderdate"))
        ).alias("export_timestamp"),
        F.concat(F.lit("/out/T"), key, F.lit(".gpkg")).alias("output_path"),
        status.otherwise("FAILED").alias("status"),
    )


def performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per order with lines; the duration comes from the order's price."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("cols")
    )
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    key = F.col("l_orderkey")
    roles = [("main", "territory_primary_table", F.lit(True))] + [
        (role, table, (F.floor(key / bit) % 2) == 1)
        for role, table, bit in [("join_1", "name_table", 1), ("join_2", "geometry_table", 2), ("join_3", "NDM_table", 4)]
    ]
    present = F.filter(
        F.array(*[F.when(hit, F.struct(F.lit(role).alias("key"), F.lit(table).alias("value"))) for role, table, hit in roles]),
        lambda e: e.isNotNull(),
    )
    shape = F.struct(F.col("rows"), F.col("cols"))
    seconds = F.floor(F.col("o_totalprice") / 1000).cast("double")
    return lines.join(orders, "l_orderkey", "left").select(
        key.alias("id"),
        key.alias("export_id"),
        F.when(key % 97 != 0, F.col("rows")).alias("rows_fetched"),
        F.col("cols").alias("columns_fetched"),
        F.when(F.col("o_orderstatus") == "F", seconds).alias("duration"),
        F.lit(None).cast("double").alias("predicted_duration"),
        F.lit(None).cast("string").alias("predicted_method"),
        ((F.floor(key / 2) % 2) == 1).alias("is_spatial"),
        F.map_from_entries(present).alias("joined_tables"),
        F.transform(present, lambda e: shape).alias("table_shapes"),
        F.lit(None).cast("bigint").alias("prediction_model_id"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model registry with one model per supplier."""
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.timestamp_add("DAY", key.cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        F.concat(F.lit("ExportDurationRidge_"), F.col("s_name")).alias("model_name"),
        F.lit("ridge").alias("model_type"),
        F.create_map(F.lit("alpha"), (F.col("s_nationkey") + 1).cast("string")).alias("parameters"),
        F.create_map(F.lit("folds"), F.lit("5")).alias("metrics"),
        F.concat(F.lit("models/"), F.col("s_name")).alias("artifact_path"),
    )


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts, event_id, worker_id, status); each kind of event stands for one status."""
    user = F.col("user_id")
    kinds = {"click": "FETCHING_TABLES", "signup": "JOINING_TABLES", "purchase": "COMPLETED", "error": "FAILED"}
    status = F
    for kind, meaning in kinds.items():
        status = status.when(F.col("event_type") == kind, meaning)
    return read(spark, sf_dir, "events").select(
        "ts",
        "event_id",
        F.concat(F.lit("G"), (user % 20).cast("string"), F.lit("_"), user.cast("string")).alias("worker_id"),
        status.otherwise("IN_PROGRESS").alias("status"),
    )
