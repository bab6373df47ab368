"""Catalog listing and grouping of warehouse tables into table sets by name."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from terrane.functions.columns import col, require_columns
from terrane.functions.skew import DEFAULT_CELL_ITEMS, collect_in_parts

NAME = "Table Name"
CREATED = "Creation Date"
GROUP = "Group Key"
TYPE = "Table Type"

# The five table types, in output order.
TABLE_TYPES = ["territory", "name", "geometry_source", "ndm_source", "other"]
# Name parts that mark a table's role inside its family.
FIRST_MARKER = "TERRITORY_NAME|POSTCODE|TERRITORY|SOURCE_TABLE"
LAST_MARKER = "GEOMETRY_DATA|NDM_DATA"


@dataclass(frozen=True)
class TableSet:
    """Names of the tables that make up one feature family."""

    group_key: str | None = None
    territory_table: str | None = None
    geometry_table: str | None = None
    ndm_table: str | None = None
    name_table: str | None = None


def list_tables(
    tables: DataFrame, schema: str, like: str | Sequence[str] | None = None
) -> DataFrame:
    """``(table_name, created)`` of one schema, newest first, null dates first.

    ``tables`` has ``table_schema``, ``table_name`` and ``created``. Patterns are
    upper-cased and OR-ed; ``_`` stays a wildcard and a backslash is a plain character.
    """
    patterns = [like] if isinstance(like, str) else list(like or [])
    found = tables.filter(F.col("table_schema") == F.lit(schema))
    if patterns:
        tests = [F.col("table_name").like(str(p).upper().replace("\\", "\\\\")) for p in patterns]
        found = found.filter(reduce(lambda a, b: a | b, tests))
    return found.select("table_name", "created").orderBy(F.desc_nulls_first("created"))


def date_from_name(name: Column) -> Column:
    """Largest of the 8-digit runs in a table name, null when there is none."""
    return F.array_max(F.regexp_extract_all(name, F.lit(r"(\d{8})"), F.lit(0)))


def family_key(name: Column) -> Column:
    """Name without its first role marker and without a trailing data marker."""
    # regexp_replace is global, so the lazy anchored prefix limits it to the first hit.
    first = F.regexp_replace(name, f"(?s)^(.*?)_({FIRST_MARKER})", "$1")
    return F.regexp_replace(first, f"_({LAST_MARKER})$", "")


def table_type(name: Column) -> Column:
    return (
        F.when(name.contains("_GEOMETRY_DATA"), "geometry_source")
        .when(name.contains("_NDM_DATA"), "ndm_source")
        .when(name.contains("_TERRITORY_NAME_"), "name")
        .when(name.contains("_TERRITORY_"), "territory")
        .otherwise("other")
    )


def unique_group_key(key: Column, run_id: str) -> Column:
    """``key`` plus a UUID-shaped digest of (run, key): unique per load, the same in every task."""
    digest = F.md5(F.concat(F.lit(run_id), key))
    return F.concat(key, F.lit("_"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def preprocess_catalog(catalog: DataFrame, run_id: str | None = None) -> DataFrame:
    """Add ``Date From Name``, ``Group Key`` and ``Table Type``; rows without a name go.

    With ``run_id`` every group key is made unique to that load.
    """
    require_columns(catalog, [NAME, CREATED])
    name = col(NAME).cast("string")
    key = family_key(name)
    return catalog.filter(col(NAME).isNotNull()).withColumns(
        {
            "Date From Name": date_from_name(name),
            GROUP: unique_group_key(key, run_id) if run_id is not None else key,
            TYPE: table_type(name),
        }
    )


def group_tables(prepared: DataFrame, cell_items: int = DEFAULT_CELL_ITEMS) -> DataFrame:
    """One row per group: creation dates, primary tables, and the table names by type.

    Lists run newest first, then by name. One aggregation does all of it; the five type
    lists are cut from the group's sorted members. A group with more than about
    ``cell_items`` tables goes on in rows with the same key and ``LIST_PART`` 1, 2, ...;
    its primary tables and date are those of the whole group in every row.
    """
    members = prepared.select(
        GROUP,
        # Ascending order of the negated time is the listing order: null dates first, then newest.
        (-F.unix_micros(col(CREATED).cast("timestamp"))).alias("age"),
        col(NAME).cast("string").alias("name"),
        col(TYPE).alias("type"),
        col(CREATED).alias("created"),
    )
    parts = collect_in_parts(members, [GROUP], cell_items, "members", "LIST_PART")

    def of_type(kind: str) -> Column:
        return F.filter("members", lambda m: m["type"] == kind)

    # Minimum over the parts of a group; an ordinary group has one part.
    whole = W.partitionBy(GROUP)
    firsts = {kind: F.min(F.get(of_type(kind), 0)).over(whole) for kind in TABLE_TYPES}
    source_first = F.min(
        F.get(F.filter(of_type("geometry_source"), lambda m: m["name"].contains("_SOURCE_TABLE_")), 0)
    ).over(whole)
    newest = F.max(F.array_max(F.transform("members", lambda m: m["created"]))).over(whole)
    fallback = ["territory", "other", "geometry_source", "name", "ndm_source"]
    return parts.select(
        GROUP,
        F.transform("members", lambda m: m["created"]).alias("Creation_Dates"),
        F.coalesce(firsts["territory"]["created"], newest).alias("territory_table_creation_date"),
        F.coalesce(*[firsts[k]["name"] for k in fallback]).alias("territory_table_primary"),
        F.coalesce(source_first, firsts["geometry_source"])["name"].alias("geometry_source_primary"),
        firsts["ndm_source"]["name"].alias("ndm_primary"),
        firsts["name"]["name"].alias("name_primary"),
        *[F.transform(of_type(kind), lambda m: m["name"]).alias(kind) for kind in TABLE_TYPES],
        "LIST_PART",
    )


def sort_groups(groups: DataFrame) -> DataFrame:
    """Groups by territory creation date, newest first."""
    return groups.orderBy(F.desc_nulls_first("territory_table_creation_date"), GROUP)


def date_text(created: Column) -> Column:
    return F.coalesce(F.date_format(created, "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def listing(frame: DataFrame, grouped: bool = True) -> DataFrame:
    """(Table Name, Creation Date) as shown to a user.

    ``grouped`` takes the rows of :func:`group_tables`, newest first; otherwise the
    prepared catalog is listed, one row per table in the catalog's order.
    """
    if grouped:
        name, created = "territory_table_primary", "territory_table_creation_date"
        frame = sort_groups(frame.filter(F.col("LIST_PART") == 0))
    else:
        name, created = NAME, CREATED
    return frame.select(col(name).alias(NAME), date_text(col(created)).alias(CREATED))


def table_sets(groups: DataFrame) -> DataFrame:
    """Every group as a table set: key and the four chosen table names."""
    return groups.filter(F.col("LIST_PART") == 0).select(
        col(GROUP).alias("group_key"),
        F.col("territory_table_primary").alias("territory_table"),
        F.col("geometry_source_primary").alias("geometry_table"),
        F.col("ndm_primary").alias("ndm_table"),
        F.col("name_primary").alias("name_table"),
    )


def resolve_table_set(groups: DataFrame, group_key: str) -> DataFrame:
    """The table set of one group; more than one matching row fails the query."""
    counted = table_sets(groups).filter(F.col("group_key") == group_key).withColumn(
        "__n", F.count(F.lit(1)).over(W.partitionBy("group_key"))
    )
    guard = F.when(
        F.col("__n") > 1, F.raise_error(F.lit("more than one table set has this group key")).cast("string")
    ).otherwise(F.col("group_key"))
    return counted.withColumn("group_key", guard).drop("__n")


def collect_table_set(groups: DataFrame, group_key: str) -> TableSet | None:
    """:func:`resolve_table_set` as a value, for handing to an export."""
    rows = resolve_table_set(groups, group_key).limit(2).collect()
    return TableSet(**rows[0].asDict()) if rows else None


CATALOG_SCHEMA = T.StructType(
    [
        T.StructField(NAME, T.StringType()),
        T.StructField(CREATED, T.TimestampNTZType()),
    ]
)
