"""Column changes that a feature table needs before it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrane.functions.columns import col


def narrow_decimals(df: DataFrame, legacy_decimal: bool = False) -> DataFrame:
    """Decimals as types that file formats can hold: scale 0 as bigint, others as double.

    ``legacy_decimal`` makes the others decimal(19,0) instead, rounded half up, which loses
    their fractions.
    """
    fraction = "decimal(19,0)" if legacy_decimal else "double"
    return df.withColumns(
        {
            f.name: col(f.name).cast("bigint" if f.dataType.scale == 0 else fraction)
            for f in df.schema.fields
            if isinstance(f.dataType, T.DecimalType)
        }
    )


def require_geometry(df: DataFrame, geometry_column: str) -> str:
    """The geometry column's actual name, found without regard to case."""
    for name in df.columns:
        if name.lower() == geometry_column.lower():
            return name
    raise ValueError(f"Geometry column '{geometry_column}' not found.")


def json_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that have none."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.withColumns(
        {f.name: F.to_json(col(f.name)) for f in df.schema.fields if isinstance(f.dataType, nested)}
    )
