"""Scans of warehouse tables, their column lists and their shapes."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.columns import col, has_column, quoted, require_columns

KEY = "FEATURE_ID"
SRID = 4326

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")

# The role recorded for each table of a set, by its place in the joins.
ROLES = {
    "main": "territory_primary_table",
    "join_1": "name_table",
    "join_2": "geometry_table",
    "join_3": "NDM_table",
}
# Column names that mark a territory table as spatial without reading it.
SPATIAL_COLUMNS = ["GEOMETRY", "GEOMETRY_GEOGRAPHY", "WKB"]


def quote_identifier(name: str) -> str:
    """A checked identifier in backticks; anything but a plain identifier is an error."""
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise ValueError(f"Invalid identifier: {name!r}")
    return quoted(name)


def read_table(spark: SparkSession, schema: str, table: str) -> DataFrame:
    return spark.table(f"{quote_identifier(schema)}.{quote_identifier(table)}")


def scan(df: DataFrame, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """Projection and limit of a table, with FEATURE_ID as bigint.

    The cast is strict under ANSI mode, which is Spark's default: a key that is not a
    number fails the query.
    """
    if columns is not None:
        require_columns(df, columns)
        df = df.select(*[col(c) for c in columns])
    if limit is not None:
        df = df.limit(limit)
    if has_column(df, KEY):
        df = df.withColumn(KEY, F.col(KEY).cast("long"))
    return df


def column_types(df: DataFrame) -> DataFrame:
    """(ordinal, column_name, data_type) of a table, in column order."""
    rows = [(i + 1, f.name, f.dataType.simpleString().upper()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ordinal int, column_name string, data_type string")


def as_wkb(df: DataFrame, column: str) -> Column:
    """A geometry column as WKB bytes, whatever it is stored as: geography, bytes or hex text."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, T.BinaryType):
        return col(column)
    if isinstance(dtype, T.StringType):
        return F.unhex(col(column))
    return F.call_function("st_asbinary", col(column))


def scan_geography(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """(FEATURE_ID, geometry) with the geography as WKB; coordinates are in SRID 4326."""
    rows = df.select(F.col(KEY).cast("long").alias(KEY), as_wkb(df, column).alias("geometry"))
    return rows if limit is None else rows.limit(limit)


def table_shape(df: DataFrame) -> DataFrame:
    """(rows, columns) of a table; the count reads no column."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("long"))


def table_set_shapes(
    territory: DataFrame,
    names: DataFrame | None = None,
    geometry: DataFrame | None = None,
    ndm: DataFrame | None = None,
) -> DataFrame:
    """(ordinal, role, table_role, rows, columns) for each table given, territory first."""
    given = zip(ROLES.items(), (territory, names, geometry, ndm), strict=True)
    shapes = [
        table_shape(df).select(
            F.lit(i).alias("ordinal"), F.lit(role).alias("role"), F.lit(table_role).alias("table_role"), "rows", "columns"
        )
        for i, ((role, table_role), df) in enumerate(given)
        if df is not None
    ]
    return reduce(DataFrame.unionByName, shapes)


def joined_roles(names: object = None, geometry: object = None, ndm: object = None) -> dict[str, str]:
    """Role map of a table set: the territory and the tables that are given."""
    given = dict(zip(ROLES, (True, names, geometry, ndm), strict=True))
    return {role: table for role, table in ROLES.items() if given[role] is not None and given[role] is not False}


def looks_spatial(
    territory: DataFrame, geometry: DataFrame | None = None, declared: Mapping[str, str] | None = None
) -> bool:
    """Cheap guess from the schema alone whether an export will be spatial."""
    if geometry is not None:
        return True
    types = declared or {f.name: f.dataType.simpleString().upper() for f in territory.schema.fields}
    return any(name in SPATIAL_COLUMNS for name in types) or "GEOGRAPHY" in types.values()


def table_set_metrics(
    territory: DataFrame,
    names: DataFrame | None = None,
    geometry: DataFrame | None = None,
    ndm: DataFrame | None = None,
    declared: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per table set: totals, shapes in join order, roles and the spatial guess."""
    shapes = table_set_shapes(territory, names, geometry, ndm)
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "role", "table_role", "rows", "columns")))
    return (
        shapes.agg(
            F.sum("rows").alias("rows_fetched"), F.sum("columns").alias("columns_fetched"), listed.alias("__tables")
        )
        .select(
            "rows_fetched",
            "columns_fetched",
            F.lit(looks_spatial(territory, geometry, declared)).alias("is_spatial"),
            F.map_from_entries(
                F.transform("__tables", lambda t: F.struct(t["role"], t["table_role"]))
            ).alias("joined_tables"),
            F.transform(
                "__tables", lambda t: F.struct(t["rows"].alias("rows"), t["columns"].alias("cols"))
            ).alias("table_shapes"),
        )
    )
