"""DataFrame helpers shared by the operators: strict renames and suffixed joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name; dots and spaces in the name are literal."""
    return F.col(quoted(name))


def has_column(df: DataFrame, name: str) -> bool:
    return name.lower() in {c.lower() for c in df.columns}


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Fail at analysis time, naming the missing columns in sorted order."""
    present = set(df.columns)
    missing = sorted(n for n in names if n not in present)
    if missing:
        raise ValueError(f"Missing required column(s): {', '.join(missing)}")


def strict_rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; a name that is not there is an error, not a no-op."""
    require_columns(df, list(names))
    return df.withColumnsRenamed(dict(names))


def left_join_suffixed(
    left: DataFrame,
    right: DataFrame,
    key: str,
    suffix: str = "_right",
    null_safe: bool = False,
) -> DataFrame:
    """LEFT JOIN on one key; right columns that clash with the left get ``suffix``.

    Clashes are found case-insensitively because that is how Spark resolves names.
    With ``null_safe`` the null key matches itself (used when the right side is an
    aggregate of the left, where null is a group of its own).
    """
    right, taken = suffix_clashes(left, right, key, suffix)
    if not null_safe:
        return left.join(right, key, "left")
    right = right.withColumnRenamed(key, "__key")
    joined = left.join(right, col(key).eqNullSafe(F.col("__key")), "left")
    return joined.drop("__key")


def suffix_clashes(
    left: DataFrame, right: DataFrame, key: str, suffix: str
) -> tuple[DataFrame, dict[str, str]]:
    """Rename right columns already present on the left; returns the renames too."""
    left_names = {c.lower() for c in left.columns}
    renames = {
        c: c + suffix
        for c in right.columns
        if c.lower() != key.lower() and c.lower() in left_names
    }
    kept = {c.lower() for c in right.columns if c not in renames}
    for new in renames.values():
        if new.lower() in left_names or new.lower() in kept:
            raise ValueError(f"Column '{new}' already exists; choose another suffix.")
    return right.withColumnsRenamed(renames), renames


def places_before(ordered: str, value: Column, strict: bool, step: int = 64) -> Column:
    """How many entries of the sorted array column ``ordered`` come before ``value`` (or equal it, unless ``strict``).

    The array is looked through in two steps, first every so many entries. A null value comes before all.
    """
    before = (lambda b: b < value) if strict else (lambda b: b <= value)
    steps = F.filter(F.col(ordered), lambda b, i: i % step == step - 1)
    start = F.size(F.filter(steps, before)) * step
    return start + F.size(F.filter(F.slice(F.col(ordered), start + 1, F.lit(step)), before))


def orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, (T.MapType, T.VariantType, T.GeographyType, T.GeometryType)):
        return False
    if isinstance(dtype, T.ArrayType):
        return orderable(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return all(orderable(f.dataType) for f in dtype.fields)
    return True


def first_row_per_key(
    df: DataFrame, key: str, order_by: Sequence[str] = ()
) -> DataFrame:
    """One row per key, every value taken from the same source row, nulls included.

    "First" means smallest by ``order_by`` and then by all values, so the answer does
    not depend on how the table is split. The minimum combines on the map side, so a
    key with a huge number of rows reaches the shuffle as one row per task.
    """
    rest = [c for c in df.columns if c.lower() != key.lower()]
    if not rest:
        return df.distinct()
    row = F.struct(*[col(c) for c in rest])
    sortable = [c for c in rest if orderable(df.schema[c].dataType)]
    if not order_by and len(sortable) == len(rest):
        first = F.min(row)
    else:
        first = F.min_by(row, F.struct(*[col(c) for c in [*order_by, *sortable]] or [F.lit(0)]))
    return (
        df.groupBy(col(key).alias(key))
        .agg(first.alias("__row"))
        .select(col(key), *[F.col("__row").getField(c).alias(c) for c in rest])
    )
