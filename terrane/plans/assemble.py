"""Assembly of a feature table: territory, names, geometry and NDM attributes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.columns import col, first_row_per_key, suffix_clashes
from terrane.functions.skew import DEFAULT_CELL_ITEMS, JOIN_KEY_ROWS, hot_keys, join_spread, nothing_hot
from terrane.operators.detect import prepare_spatial
from terrane.operators.features import names_array, ndm_attributes
from terrane.operators.union import CELL_SEGMENTS, STRIP_SEGMENTS, union_features
from terrane.sources.tables import KEY, scan, table_shape

GEOMETRY = "geometry"
PREVIOUS = "previous_geometry"


@dataclass(frozen=True)
class FeatureTable:
    """An assembled table and how it came about.

    ``geometry_col`` is the source column the geometry was taken from. ``inputs`` are the
    tables whose shapes count for the run: the names after grouping, the NDM table before
    shaping. Shapes are only computed when asked for.
    """

    dataframe: DataFrame
    is_spatial: bool
    geometry_col: str | None
    inputs: tuple[DataFrame, ...] = ()
    joined_tables: dict[str, str] = field(default_factory=dict)

    def table_shapes(self) -> list[tuple[int, int]]:
        return [tuple(table_shape(df).head()) for df in self.inputs]


def assemble(
    territory: DataFrame | None,
    names: DataFrame | None = None,
    geometry: DataFrame | None = None,
    ndm: DataFrame | None = None,
    *,
    declared: Mapping[str, str] | None = None,
    json_cols: Sequence[str] | None = None,
    exclude_cols: Sequence[str] | None = None,
    cell_names: int = DEFAULT_CELL_ITEMS,
    strip_segments: int = STRIP_SEGMENTS,
    cell_segments: int = CELL_SEGMENTS,
    hot_rows: int = JOIN_KEY_ROWS,
) -> FeatureTable:
    """Territory LEFT JOIN names LEFT JOIN geometry LEFT JOIN NDM on FEATURE_ID.

    With a geometry (in the geometry table if there is one, else found in the territory)
    the result has one row per feature: FEATURE_ID, the union of its geometries, and the
    first values of everything else. Each table is brought down to one row per feature
    before it is joined, so a split feature never multiplies. Without a geometry the rows
    stay as the joins give them; a feature with more than ``hot_rows`` territory rows is
    joined in several tasks.

    ``json_cols`` names the payload columns of the NDM table and must be given with one.
    ``declared`` describes the table searched for the geometry. NAMES_PART and
    GEOMETRY_PART number the rows of a feature too large for one cell; both are 0 in
    ordinary rows.
    """
    if territory is None:
        raise ValueError("A territory table is needed.")
    if ndm is not None and json_cols is None:
        raise ValueError("json_cols must name the payload columns of the NDM table.")
    if geometry is not None:
        base, found = scan(territory), None
        shapes, found_in = prepare_spatial(geometry, declared)
    else:
        base, found = prepare_spatial(territory, declared)
        shapes, found_in = None, None
    inputs = [base]

    grouped_names = None
    if names is not None:
        grouped_names = names_array(scan(names), cell_names)
        inputs.append(grouped_names.drop("NAMES_PART"))
    if shapes is not None:
        inputs.append(shapes)
    shaped_ndm = None
    if ndm is not None:
        ndm = scan(ndm)
        inputs.append(ndm)
        shaped_ndm = ndm_attributes(ndm, json_cols, exclude_cols)

    chosen = found_in or found
    if chosen is None:
        result = _join_all(base, grouped_names, shapes, shaped_ndm, hot_rows)
        return FeatureTable(result, False, None, tuple(inputs))

    source = shapes if found_in else base
    pieces = source.select(col(KEY), _wkb(source, chosen).alias(GEOMETRY))
    if found_in:
        # The null key matches nothing in a join, so it brings no geometry.
        pieces = pieces.filter(col(KEY).isNotNull())
    unions = union_features(pieces, strip_segments, cell_segments)

    base = _first_rows(base if found_in else base.drop(chosen))
    attributes = _first_rows(shapes.drop(chosen)) if found_in else shapes
    first_ndm = _first_rows(shaped_ndm) if shaped_ndm is not None else None
    result = _join_all(base, grouped_names, attributes, first_ndm)
    present = next((c for c in result.columns if c.lower() == GEOMETRY), None)
    if present is not None:
        result = result.withColumnRenamed(present, PREVIOUS)
    result = _attach_geometry(result, unions, null_key=not found_in)
    ordered = [KEY, GEOMETRY] + [c for c in result.columns if c not in (KEY, GEOMETRY)]
    return FeatureTable(result.select(*[col(c) for c in ordered]), True, chosen, tuple(inputs))


def _wkb(df: DataFrame, column: str):
    return F.unhex(col(column)) if isinstance(df.schema[column].dataType, T.StringType) else col(column)


def _first_rows(df: DataFrame) -> DataFrame:
    return first_row_per_key(df, KEY)


def _join_all(
    base: DataFrame,
    names: DataFrame | None,
    geometry: DataFrame | None,
    ndm: DataFrame | None,
    hot_rows: int | None = None,
) -> DataFrame:
    """The joins in their fixed order, with each table's own suffix for clashing columns.

    With ``hot_rows`` a feature with more rows than that, in the territory or in the joined table, is split up.
    """
    result = base
    left_hot = None if hot_rows is None else hot_keys(base, col(KEY), hot_rows)
    for right, suffix in ((names, "_right"), (geometry, "_GEOMETRY"), (ndm, "_right")):
        if right is None:
            continue
        # Names have one row a feature already, or one a part: only the other tables can hold a feature very often.
        rows = None if right is names else hot_rows
        right, _ = suffix_clashes(result, right, KEY, suffix)
        if left_hot is None:
            result = result.join(right, KEY, "left")
        else:
            right_hot = nothing_hot("bigint") if rows is None else hot_keys(right, col(KEY), rows)
            result = join_spread(result, right, KEY, left_hot, right_hot)
    if names is not None:
        result = result.withColumn("NAMES_PART", F.coalesce("NAMES_PART", F.lit(0)))
    return result


def _attach_geometry(result: DataFrame, unions: DataFrame, null_key: bool) -> DataFrame:
    """LEFT JOIN the unions; a continued names array does not repeat the geometry.

    Only a territory with its own geometry has a union for the null key. Otherwise the
    join is on plain equality, which leaves the rows where the joins before put them.
    """
    unions, _ = suffix_clashes(result, unions, KEY, "_right")
    right = unions.withColumnRenamed(KEY, "__key")
    match = col(KEY).eqNullSafe(F.col("__key")) if null_key else col(KEY) == F.col("__key")
    if "NAMES_PART" in result.columns:
        # The part decides inside the condition, not as a join key: rows stay partitioned by feature.
        match = match & (F.col("NAMES_PART") == 0)
    joined = result.join(right, match, "left")
    if "NAMES_PART" in result.columns:
        first = F.coalesce("GEOMETRY_PART", F.lit(0)) == 0
        joined = joined.withColumn("NAMES_ARRAY", F.when(first, F.col("NAMES_ARRAY")))
    return joined.drop("__key").withColumn("GEOMETRY_PART", F.coalesce("GEOMETRY_PART", F.lit(0)))
