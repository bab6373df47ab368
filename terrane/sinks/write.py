"""Writing a feature table in one of the supported formats."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from terrane.functions.columns import col
from terrane.functions.wkb import geojson, wkb_text
from terrane.session import ship
from terrane.sinks import geopackage
from terrane.sinks.prepare import json_ready, narrow_decimals, require_geometry
from terrane.sources.tables import SRID

# Known formats by file suffix; those without a writer are refused by name.
FORMATS = ["shp", "gpkg", "geojson", "csv", "fgb", "parquet", "kml", "gml", "dxf"]
WRITABLE = ["gpkg", "geojson", "csv", "parquet"]
GEOMETRY_OUT = "geom"
# One file is one task; a table above this many rows is written in parts.
SINGLE_FILE_ROWS = 1_000_000


def output_path(directory: str, territory_table: str, suffix: str = "gpkg") -> str:
    return str(PurePosixPath(directory) / f"{territory_table}.{suffix}")


@F.pandas_udf(StringType())
def wkb_geojson(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else json.dumps(geojson(v), separators=(",", ":")))


def write_features(
    df: DataFrame,
    path: str,
    geometry_column: str = "geometry",
    format: str = "gpkg",
    mode: str = "overwrite",
    legacy_decimal: bool = False,
    single_file: bool = False,
    layer: str | None = None,
    srid: int = SRID,
) -> None:
    """Write a feature table with WKB geometry; the geometry column is called ``geom`` in the file.

    ``gpkg`` and the others write one file per partition under ``path``. ``single_file``
    makes ``path`` one GeoPackage, for tables of at most SINGLE_FILE_ROWS rows.
    """
    if format not in WRITABLE:
        known = "not supported" if format in FORMATS else "unknown"
        raise ValueError(f"Format '{format}' is {known}; use one of {', '.join(WRITABLE)}.")
    geometry = require_geometry(df, geometry_column)
    table = narrow_decimals(df, legacy_decimal).withColumnRenamed(geometry, GEOMETRY_OUT)
    if format == "gpkg":
        _write_geopackage(table, path, mode, single_file, layer or PurePosixPath(path).stem, srid)
        return
    ship(df.sparkSession)
    if format == "parquet":
        table.withMetadata(GEOMETRY_OUT, {"encoding": "WKB", "crs": f"EPSG:{srid}"}).write.mode(mode).parquet(path)
    elif format == "csv":
        text = json_ready(table).withColumn(GEOMETRY_OUT, wkb_text(GEOMETRY_OUT))
        text.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        properties = F.to_json(
            F.struct(*[col(c) for c in table.columns if c != GEOMETRY_OUT]), {"ignoreNullFields": "false"}
        )
        feature = F.concat(
            F.lit('{"type":"Feature","geometry":'),
            F.coalesce(wkb_geojson(GEOMETRY_OUT), F.lit("null")),
            F.lit(',"properties":'),
            properties,
            F.lit("}"),
        )
        table.select(feature.alias("value")).write.mode(mode).text(path)


def _write_geopackage(table: DataFrame, path: str, mode: str, single_file: bool, layer: str, srid: int) -> None:
    spark = ship(table.sparkSession)
    geopackage.register(spark)
    if single_file:
        rows = table.limit(SINGLE_FILE_ROWS + 1).count()
        if rows > SINGLE_FILE_ROWS:
            raise ValueError(f"More than {SINGLE_FILE_ROWS} rows; write parts instead of a single file.")
        table = table.coalesce(1)
    writer = json_ready(table).write.format(geopackage.NAME).mode(mode).option("layer", layer)
    writer = writer.option("geometry_column", GEOMETRY_OUT).option("srid", str(srid))
    writer.option("single_file", str(single_file).lower()).save(path)
