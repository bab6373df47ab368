import json

import pytest

from pyspark.sql import functions as F

from terrane.functions.skew import hot_keys, nothing_hot, spread_hot_keys
from terrane.plans.assemble import assemble

NAMES = (
    "FEATURE_ID bigint, UNPARSED_FULL_NAME string, UNPARSED_NAME string, LANGUAGE string, NAME_TYPE string, "
    "CODE_TYPE string, NAME_RANK int, LOCALE_LIST_USE string"
)
NDM = "FEATURE_ID bigint, FEATURE_PROTO string, METADATA string, LENGTH int, AREA int, PERIMETER int, NAME string"


@pytest.fixture(scope="module")
def shapes(jts):
    return [jts.wkb(f"POLYGON (({x} 0, {x + 1} 0, {x + 1} 1, {x} 1, {x} 0))") for x in range(4)]


@pytest.fixture(scope="module")
def territory(spark):
    return spark.createDataFrame([(1, "one"), (2, "two"), (3, "three"), (None, "none")], "FEATURE_ID bigint, NAME string")


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame(
        [(1, f"n{i}", None, '["en"]', None, None, i, None) for i in range(3)] + [(9, "lost", None, None, None, None, 1, None)],
        NAMES,
    )


def test_territory_is_required():
    with pytest.raises(ValueError, match="territory table is needed"):
        assemble(None)


def test_all_four_tables(spark, jts, territory, names, shapes):
    geometry = spark.createDataFrame(
        [(1, shapes[0], "b"), (1, shapes[1], "a"), (2, shapes[2], "c"), (None, shapes[3], "d")],
        "FEATURE_ID bigint, SHAPE binary, NAME string",
    )
    ndm = spark.createDataFrame([(1, "{}", "m", 1, 2, 3, "ndm"), (1, "{}", "m", 1, 2, 3, "other")], NDM)
    with pytest.raises(ValueError, match="json_cols"):
        assemble(territory, names, geometry, ndm)
    result = assemble(territory, names, geometry, ndm, json_cols=["FEATURE_PROTO", "METADATA"])
    assert result.is_spatial and result.geometry_col == "SHAPE" and result.joined_tables == {}
    assert result.dataframe.columns == [
        "FEATURE_ID", "geometry", "NAME", "NAMES_PART", "NAMES_ARRAY", "NAME_GEOMETRY", "FEATURE_PROTO", "METADATA",
        "LENGTH_NDM", "AREA_NDM", "PERIMETER_NDM", "NAME_right", "GEOMETRY_PART",
    ]
    rows = {r["FEATURE_ID"]: r for r in result.dataframe.collect()}
    assert len(rows) == 4
    assert jts.read(rows[1]["geometry"]).getArea() == 2
    assert rows[1]["NAME_GEOMETRY"] == "a" and rows[1]["NAME_right"] == "ndm"
    assert len(json.loads(rows[1]["NAMES_ARRAY"])) == 3
    assert rows[2]["geometry"] == shapes[2] and rows[2]["NAMES_ARRAY"] is None
    assert rows[3]["geometry"] is None and rows[None]["geometry"] is None
    assert result.table_shapes() == [(4, 2), (2, 2), (4, 3), (2, 7)]


def test_geometry_from_the_territory(spark, jts, names, shapes):
    rows = [(1, shapes[0].hex(), "y"), (1, shapes[1].hex(), "x"), (None, shapes[2].hex(), "q"), (None, shapes[3].hex(), "p")]
    territory = spark.createDataFrame(rows, "FEATURE_ID bigint, SHAPE string, KIND string")
    result = assemble(territory, names)
    found = {r["FEATURE_ID"]: r for r in result.dataframe.collect()}
    assert result.is_spatial and set(found) == {1, None}
    assert jts.read(found[1]["geometry"]).getArea() == 2 and found[1]["KIND"] == "x"
    assert jts.read(found[None]["geometry"]).getArea() == 2 and found[None]["KIND"] == "p"


def test_geometry_names_do_not_collide(spark, territory, shapes):
    territory = territory.withColumn("geometry", territory["NAME"])
    geometry = spark.createDataFrame([(1, shapes[0])], "FEATURE_ID bigint, geometry binary")
    result = assemble(territory, geometry=geometry).dataframe
    rows = {r["FEATURE_ID"]: r for r in result.collect()}
    assert rows[1]["previous_geometry"] == "one" and rows[1]["geometry"] == shapes[0]
    other = assemble(territory, geometry=geometry.withColumnRenamed("geometry", "WKB")).dataframe
    rows = {r["FEATURE_ID"]: r for r in other.collect()}
    assert rows[1]["previous_geometry"] == "one" and rows[1]["geometry"] == shapes[0]


def test_without_geometry_duplicates_stay(spark, territory, names):
    doubled = territory.union(territory)
    result = assemble(doubled, names)
    assert not result.is_spatial and result.geometry_col is None
    assert result.dataframe.count() == 8
    assert result.dataframe.columns == ["FEATURE_ID", "NAME", "NAMES_PART", "NAMES_ARRAY"]


def test_geometry_table_without_geometry(spark, territory):
    notes = spark.createDataFrame([(1, "x"), (1, "y")], "FEATURE_ID bigint, NAME string")
    result = assemble(territory, geometry=notes)
    assert not result.is_spatial
    assert result.dataframe.filter("FEATURE_ID = 1").count() == 2
    assert "NAME_GEOMETRY" in result.dataframe.columns


def test_large_cells_continue_in_further_rows(spark, jts, territory, shapes):
    many = spark.createDataFrame([(1, f"n{i}", None, '["en"]', None, None, i, None) for i in range(30)], NAMES)
    bars = [jts.wkb(f"POLYGON ((0 {y}, 2 {y}, 2 {y + 1.5}, 0 {y + 1.5}, 0 {y}))") for y in range(20)]
    geometry = spark.createDataFrame([(1, g) for g in bars] + [(2, shapes[2])], "FEATURE_ID bigint, SHAPE binary")
    result = assemble(territory, many, geometry, cell_names=5, strip_segments=10, cell_segments=20).dataframe
    rows = [r for r in result.collect() if r["FEATURE_ID"] == 1]
    assert {r["NAME"] for r in rows} == {"one"}
    listed = [n["UNPARSED_FULL_NAME"] for r in rows if r["NAMES_ARRAY"] for n in json.loads(r["NAMES_ARRAY"])]
    assert sorted(listed) == sorted(f"n{i}" for i in range(30))
    areas = [jts.read(r["geometry"]).getArea() for r in rows if r["geometry"] is not None]
    assert len(areas) > 1 and sum(areas) == pytest.approx(2 * 20.5)
    assert len({(r["NAMES_PART"], r["GEOMETRY_PART"]) for r in rows}) == len(rows)


def test_hot_features_are_split_in_the_joins(spark, names):
    """A third of the territory on one feature, half of that copies of one row, and many null keys."""
    rows = [(1, "copy" if i % 2 else f"row{i}") for i in range(400)] + [(None, f"none{i}") for i in range(300)]
    rows += [(i + 10, f"cold{i}") for i in range(500)]
    territory = spark.createDataFrame(rows, "FEATURE_ID bigint, NAME string").repartition(6)
    notes = spark.createDataFrame([(1, "x"), (1, "y"), (12, "z")], "FEATURE_ID bigint, NOTE string")
    key = lambda r: str(tuple(r))
    plain = sorted(assemble(territory, names, notes).dataframe.collect(), key=key)
    split = assemble(territory, names, notes, hot_rows=40).dataframe
    assert "__slot" not in split.columns
    assert sorted(split.collect(), key=key) == plain
    assert len(plain) == 2 * 400 + 300 + 500
    hot = hot_keys(territory, F.col("FEATURE_ID"), 40)
    left, right, keys = spread_hot_keys(territory, notes, "FEATURE_ID", hot, nothing_hot("bigint"))
    sizes = [r["count"] for r in left.filter("FEATURE_ID = 1").groupBy(*keys).count().collect()]
    assert len(sizes) > 15 and max(sizes) < 100


def test_hot_features_of_the_joined_table_are_split(spark, names):
    """A feature with most of the rows on the right, one hot on both sides, and left rows that find no partner."""
    territory = spark.createDataFrame([(i, f"t{i}") for i in range(30)] + [(2, f"u{i}") for i in range(90)], "FEATURE_ID bigint, NAME string")
    notes = [(1, f"n{i // 2}") for i in range(300)] + [(2, f"m{i}") for i in range(70)] + [(i, "x") for i in range(20, 40)] + [(None, "y")] * 200
    notes = spark.createDataFrame(notes, "FEATURE_ID bigint, NOTE string").repartition(5)
    key = lambda r: str(tuple(r))
    plain = sorted(assemble(territory, names, notes).dataframe.collect(), key=key)
    split = assemble(territory, names, notes, hot_rows=40).dataframe
    assert sorted(split.collect(), key=key) == plain
    assert len(plain) == 300 + 91 * 70 + 28
    hot = hot_keys(notes, F.col("FEATURE_ID"), 40)
    _, right, keys = spread_hot_keys(territory, notes, "FEATURE_ID", nothing_hot("bigint"), hot)
    sizes = [r["count"] for r in right.filter("FEATURE_ID = 1").groupBy(*keys).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 60


def test_planning_starts_no_job(spark, territory, names):
    from terrane.operators.features import names_array
    from terrane.plans.assemble import _join_all

    notes = spark.createDataFrame([(1, "x")], "FEATURE_ID bigint, NOTE string")
    spark.sparkContext.setJobGroup("planning", "")
    try:
        joined = _join_all(territory, names_array(names), notes, None, hot_rows=10)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert joined.count() == 4
