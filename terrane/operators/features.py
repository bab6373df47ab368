"""Shaping of the tables that are joined into a feature table: names and NDM attributes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import col, left_join_suffixed, require_columns, strict_rename
from terrane.functions.skew import DEFAULT_CELL_ITEMS, collect_in_parts

KEY = "FEATURE_ID"

# The fields of one name record, in output order.
NAME_FIELDS = [
    "UNPARSED_FULL_NAME",
    "UNPARSED_NAME",
    "LANGUAGE",
    "NAME_TYPE",
    "CODE_TYPE",
    "NAME_RANK",
    "LOCALE_LIST_USE",
]
# Attribute columns that the NDM table repeats from the territory.
NDM_DROPPED = ["REPRESENTATIVE_POINT", "ISO_COUNTRY_CODE", "FEATURE_TYPE", "VENDOR_ID"]
# Measures that are renamed so that they do not look like the territory's.
NDM_RENAMED = {"LENGTH": "LENGTH_NDM", "AREA": "AREA_NDM", "PERIMETER": "PERIMETER_NDM"}


def first_language(language: Column) -> Column:
    """First entry of a JSON list of languages; null when empty or not a list."""
    return F.get_json_object(language, "$[0]")


def names_array(names: DataFrame, cell_items: int = DEFAULT_CELL_ITEMS) -> DataFrame:
    """(FEATURE_ID, NAMES_PART, NAMES_ARRAY): the names of each feature as a JSON array.

    Records are ordered by NAME_RANK and then by their JSON text. A feature with more than
    about ``cell_items`` names has several rows, NAMES_PART 0, 1, 2, ...

    The fields travel through the shuffle; JSON is made after it, where it is read.
    """
    require_columns(names, [KEY, *NAME_FIELDS])
    fields = names.select(col(KEY).cast("long").alias(KEY), *[col(f) for f in NAME_FIELDS])
    record = F.struct(*[first_language(col(f)).alias(f) if f == "LANGUAGE" else col(f) for f in NAME_FIELDS])
    item = F.struct(col("NAME_RANK").alias("rank"), F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))
    parts = collect_in_parts(fields, [KEY], cell_items, "items", "NAMES_PART", item)
    array = F.concat(F.lit("["), F.array_join(F.col("items")["json"], ","), F.lit("]"))
    return parts.select(KEY, "NAMES_PART", array.alias("NAMES_ARRAY"))


def ndm_attributes(
    ndm: DataFrame,
    json_cols: Sequence[str],
    exclude_cols: Sequence[str] | None = None,
    pair_duplicates: bool = False,
) -> DataFrame:
    """Key, the payload columns ``json_cols``, then all other kept columns with the measures renamed.

    A payload column that the table lacks is an error. What is left out besides is ``exclude_cols``, by default the
    payload and NDM_DROPPED.

    The key identifies an NDM row, so this is one projection. A null key has null
    attributes, as it never matches itself. ``pair_duplicates`` joins the payloads to the
    attributes instead, which gives n*n rows for a key held by n rows.
    """
    payload = list(json_cols)
    require_columns(ndm, [KEY, *payload])
    excluded = set(exclude_cols if exclude_cols is not None else [*payload, *NDM_DROPPED])
    kept = strict_rename(ndm.select(*[col(c) for c in ndm.columns if c not in excluded]), NDM_RENAMED)
    if pair_duplicates:
        return left_join_suffixed(ndm.select(col(KEY), *[col(c) for c in payload]), kept, KEY)
    known = col(KEY).isNotNull()
    renamed = {c: NDM_RENAMED.get(c, c) for c in ndm.columns if c not in excluded and c != KEY}
    return ndm.select(
        col(KEY),
        *[col(c) for c in payload],
        *[F.when(known, col(c)).alias(new) for c, new in renamed.items()],
    )
