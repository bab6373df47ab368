"""Which column of a table holds its geometry, from the schema and a small sample."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.columns import col, has_column, orderable
from terrane.functions.wkb import is_binary_text, is_hex_text, wkb_valid
from terrane.sources.tables import KEY, as_wkb, scan

# Kinds and sources a detection reports.
WKB_BINARY = "WKB_BINARY"
WKB_TEXT = "WKB_TEXT"
GEOGRAPHY = "SNOWFLAKE_GEOGRAPHY"
DECLARED = "SNOWFLAKE"
IN_FRAME = "POLARS"
# Point columns that never count as a feature's geometry.
POINT_COLUMNS = ("REPRESENTATIVE_POINT", "REP_POINT")
# Rows fetched, rows checked of those, and the seed of the choice.
TABLE_SAMPLE, GEOGRAPHY_SAMPLE, CHECKED, SEED = 50, 10, 5, 42


@dataclass(frozen=True)
class Detection:
    """A detected geometry column: what it is, its name, and where it was recognised."""

    TYPE: str
    COLUMN: str
    SOURCE: str

    def to_dict(self) -> dict[str, str]:
        return asdict(self)


def declared_types(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString().upper() for f in df.schema.fields}


def checked_rows(df: DataFrame, fetched: int) -> DataFrame:
    """At most five of the first ``fetched`` rows, chosen by a seeded hash of their values."""
    hashable = [col(f.name) for f in df.schema.fields if orderable(f.dataType)]
    return df.limit(fetched).orderBy(F.xxhash64(*hashable, F.lit(SEED))).limit(CHECKED)


def looks_binary(column: Column) -> Column:
    """Aggregate: there is a value, and all values are hex text or text with unprintable characters."""
    return _fits(is_hex_text(column), is_binary_text(column))


def _fits(is_hex: Column, is_binary: Column) -> Column:
    return (F.count(is_hex) > 0) & F.coalesce(F.bool_and(is_hex | is_binary), F.lit(False))


def all_wkb(column: Column) -> Column:
    """Aggregate: every row holds WKB. A null row counts against it, an empty table does not."""
    return F.count_if(F.coalesce(wkb_valid(column), F.lit(False))) == F.count(F.lit(1))


def text_profile(df: DataFrame) -> DataFrame:
    """(column_name, values, hex_values, binary_values, looks_binary) over all rows of all text columns."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    # Each pattern is matched once per value; the aggregates share its result.
    kinds = df.select(
        *[
            F.struct(is_hex_text(col(c)).alias("hex"), is_binary_text(col(c)).alias("binary")).alias(f"c{i}")
            for i, c in enumerate(text)
        ]
    )
    flags = kinds.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.col(f"c{i}.hex")).alias("values"),
                F.count_if(F.col(f"c{i}.hex")).alias("hex_values"),
                F.count_if(F.col(f"c{i}.binary")).alias("binary_values"),
                _fits(F.col(f"c{i}.hex"), F.col(f"c{i}.binary")).alias("looks_binary"),
            ).alias(f"c{i}")
            for i, c in enumerate(text)
        ]
    )
    return flags.select(F.explode(F.array(*[f"c{i}" for i in range(len(text))])).alias("c")).select("c.*")


def wkb_profile(df: DataFrame, column: str) -> DataFrame:
    """(values, valid_values, all_valid) of one column over all rows."""
    return df.agg(
        F.count(col(column)).alias("values"),
        F.count_if(F.coalesce(wkb_valid(col(column)), F.lit(False))).alias("valid_values"),
        all_wkb(col(column)).alias("all_valid"),
    )


def detect_geometry(df: DataFrame, declared: Mapping[str, str] | None = None) -> Detection | None:
    """First hit of a fixed order of rules, or None.

    ``declared`` maps column names to the warehouse's type names where those say more than
    the DataFrame's schema; the default is the schema. All flags of all candidate columns
    come from one aggregate over the checked rows, plus one over the ten-row geography
    sample if a geography column is declared.
    """
    types = dict(declared) if declared is not None else declared_types(df)
    fields = {f.name: f.dataType for f in df.schema.fields}
    geographies = [c for c, t in types.items() if "GEOGRAPHY" in t.upper()]
    if geographies:
        valid = checked_rows(df.select(*[as_wkb(df, c).alias(f"g{i}") for i, c in enumerate(geographies)]), GEOGRAPHY_SAMPLE)
        hits = valid.agg(*[all_wkb(F.col(f"g{i}")).alias(f"g{i}") for i in range(len(geographies))]).head()
        for i, c in enumerate(geographies):
            if hits[f"g{i}"]:
                return Detection(GEOGRAPHY, c, DECLARED)

    rules = [
        ("wkb", WKB_BINARY, IN_FRAME, [c for c in fields if "WKB" in c.upper()]),
        ("wkb", WKB_BINARY, DECLARED, [c for c in types if "WKB" in c.upper()]),
        ("wkb", WKB_BINARY, IN_FRAME, [c for c, t in fields.items() if isinstance(t, T.BinaryType)]),
        ("wkb", WKB_BINARY, DECLARED, [c for c, t in types.items() if "BINARY" in t.upper()]),
        ("text", WKB_TEXT, IN_FRAME, [c for c, t in fields.items() if isinstance(t, T.StringType)]),
        ("text", WKB_TEXT, DECLARED, [c for c, t in types.items() if "TEXT" in t.upper()]),
    ]
    candidates = list(dict.fromkeys(c for _, _, _, columns in rules for c in columns))
    if not candidates:
        return None
    for c in candidates:
        if not isinstance(fields[c], (T.BinaryType, T.StringType)):
            raise TypeError(f"Column '{c}' is taken for a geometry but holds {fields[c].simpleString()}.")
    sample = checked_rows(df, TABLE_SAMPLE).select(*[col(c).alias(f"c{i}") for i, c in enumerate(candidates)])
    flags = sample.agg(
        *[all_wkb(F.col(f"c{i}")).alias(f"wkb{i}") for i in range(len(candidates))],
        *[
            (looks_binary(F.col(f"c{i}")) if isinstance(fields[c], T.StringType) else F.lit(False)).alias(f"text{i}")
            for i, c in enumerate(candidates)
        ],
    ).head()
    place = {c: i for i, c in enumerate(candidates)}
    for test, kind, source, columns in rules:
        for c in columns:
            if flags[f"wkb{place[c]}"] and (test == "wkb" or flags[f"text{place[c]}"]):
                return Detection(kind, c, source)
    return None


def prepare_spatial(df: DataFrame, declared: Mapping[str, str] | None = None) -> tuple[DataFrame, str | None]:
    """The table with its geometry readable as WKB, and the geometry column's name or None.

    A geography column becomes ``geometry``, in place: joining it back on FEATURE_ID would
    pair all rows of a split feature, which the union per feature only has to undo. As in
    such a join, a row without a key has no geometry.
    """
    found = detect_geometry(df, declared)
    table = scan(df)
    if found is None or found.COLUMN in POINT_COLUMNS:
        return table, None
    if found.TYPE == GEOGRAPHY:
        if found.COLUMN.lower() != "geometry" and has_column(table, "geometry"):
            raise ValueError("The table has a column 'geometry' beside its geography column.")
        wkb = F.when(col(KEY).isNotNull(), as_wkb(df, found.COLUMN))
        others = [col(c) for c in table.columns if c != found.COLUMN]
        return table.select(*others, wkb.alias("geometry")), "geometry"
    if found.SOURCE == IN_FRAME:
        return table, found.COLUMN
    return table, None
