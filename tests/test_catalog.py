import datetime

import pytest
from pyspark.sql import functions as F

from terrane.operators import catalog
from terrane.sources.tables import quote_identifier

DAY = datetime.datetime(2024, 1, 1)

# Table name -> (group key, type)
CASES = {
    "X_TERRITORY_20240101": ("X_20240101", "territory"),
    "X_TERRITORY_NAME_20240101": ("X_20240101", "name"),
    "X_20240101_GEOMETRY_DATA": ("X_20240101", "geometry_source"),
    "X_SOURCE_TABLE_20240101_GEOMETRY_DATA": ("X_20240101", "geometry_source"),
    "X_20240101_NDM_DATA": ("X_20240101", "ndm_source"),
    "X_POSTCODE_20240101": ("X_20240101", "other"),
    "X_TERRITORY": ("X", "other"),
    "X_TERRITORY_NAME": ("X", "territory"),
    "X_TERRITORY_NAME_Y_TERRITORY_Z": ("X_Y_TERRITORY_Z", "name"),
    "X_GEOMETRY_DATA_20240101": ("X_GEOMETRY_DATA_20240101", "geometry_source"),
}


def tables(spark, rows):
    return spark.createDataFrame(rows, catalog.CATALOG_SCHEMA)


def test_hand_cases(spark):
    df = tables(spark, [(name, DAY) for name in CASES] + [(None, DAY)])
    found = {r["Table Name"]: (r["Group Key"], r["Table Type"]) for r in catalog.preprocess_catalog(df).collect()}
    assert found == CASES


def test_latest_date_in_name(spark):
    df = tables(spark, [("A_20230101_20240101_1", DAY), ("A_2024010", DAY), ("A_202401011", DAY)])
    found = {r["Table Name"]: r["Date From Name"] for r in catalog.preprocess_catalog(df).collect()}
    assert found == {"A_20230101_20240101_1": "20240101", "A_2024010": None, "A_202401011": "20240101"}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match=r"Missing required column\(s\): Creation Date, Table Name"):
        catalog.preprocess_catalog(spark.range(1))


def test_unique_keys_are_stable_per_load(spark):
    df = tables(spark, [("A_TERRITORY_1", DAY), ("A_1", DAY), ("B_1", DAY)])
    one = {r["Group Key"] for r in catalog.preprocess_catalog(df, "load-1").collect()}
    again = {r["Group Key"] for r in catalog.preprocess_catalog(df.repartition(3), "load-1").collect()}
    other = {r["Group Key"] for r in catalog.preprocess_catalog(df, "load-2").collect()}
    assert len(one) == 2 and one == again and not one & other


def test_primary_tables_and_fallbacks(spark):
    rows = [
        ("A_TERRITORY_1", DAY),
        ("A_TERRITORY_1_", DAY + datetime.timedelta(days=1)),
        ("A_1_GEOMETRY_DATA", DAY + datetime.timedelta(days=9)),
        ("A_SOURCE_TABLE_1_GEOMETRY_DATA", DAY),
        ("B_1_NDM_DATA", DAY),
        ("B_TERRITORY_NAME_1", DAY - datetime.timedelta(days=5)),
        ("C_TERRITORY_1", None),
        ("C_1", DAY),
    ]
    df = tables(spark, [r for r in rows if r[0] != "A_TERRITORY_1_"])
    groups = {r["Group Key"]: r for r in catalog.group_tables(catalog.preprocess_catalog(df)).collect()}
    assert groups["A_1"]["geometry_source_primary"] == "A_SOURCE_TABLE_1_GEOMETRY_DATA"
    assert groups["A_1"]["geometry_source"] == ["A_1_GEOMETRY_DATA", "A_SOURCE_TABLE_1_GEOMETRY_DATA"]
    assert groups["A_1"]["territory_table_creation_date"] == DAY
    assert groups["B_1"]["territory_table_primary"] == "B_TERRITORY_NAME_1"
    assert groups["B_1"]["territory_table_creation_date"] == DAY
    assert groups["B_1"]["territory"] == [] and groups["B_1"]["ndm_source"] == ["B_1_NDM_DATA"]
    assert groups["C_1"]["territory_table_primary"] == "C_TERRITORY_1"
    assert groups["C_1"]["territory_table_creation_date"] == DAY
    assert groups["C_1"]["Creation_Dates"] == [None, DAY]


def test_large_group_goes_on_in_further_rows(spark):
    rows = [(f"A_TERRITORY_1_{i:03d}"[:13] + f"{i:03d}_1", DAY + datetime.timedelta(days=i)) for i in range(40)]
    df = tables(spark, rows + [("B_1", DAY)]).withColumn("Group Key", F.substring("Table Name", 1, 1)).withColumn(
        "Table Type", F.lit("territory")
    )
    whole = {r["Group Key"]: r for r in catalog.group_tables(df).collect()}
    parts = [r for r in catalog.group_tables(df, cell_items=5).collect() if r["Group Key"] == "A"]
    assert len(parts) > 4
    assert sorted(n for p in parts for n in p["territory"]) == sorted(whole["A"]["territory"])
    assert len([d for p in parts for d in p["Creation_Dates"]]) == 40
    for p in parts:
        assert p["territory_table_primary"] == whole["A"]["territory_table_primary"]
        assert p["territory_table_creation_date"] == whole["A"]["territory_table_creation_date"]
    assert 0 in {p["LIST_PART"] for p in parts}


def test_like_keeps_wildcards_and_plain_backslashes(spark):
    df = spark.createDataFrame(
        [("S", "A_B", DAY), ("S", "AXB", None), ("S", "A\\B", DAY), ("T", "A_B", DAY)],
        "table_schema string, table_name string, created timestamp_ntz",
    )
    assert [r[0] for r in catalog.list_tables(df, "S", "a_b").collect()][0] == "AXB"
    assert {r[0] for r in catalog.list_tables(df, "S", "a_b").collect()} == {"A_B", "AXB", "A\\B"}
    assert [r[0] for r in catalog.list_tables(df, "S", ["a\\b"]).collect()] == ["A\\B"]
    assert catalog.list_tables(df, "S").count() == 3


def test_resolving_a_table_set(spark):
    df = tables(spark, [("A_TERRITORY_1", DAY), ("A_TERRITORY_NAME_1", DAY), ("A_1_NDM_DATA", DAY)])
    groups = catalog.group_tables(catalog.preprocess_catalog(df))
    found = catalog.collect_table_set(groups, "A_1")
    assert found == catalog.TableSet("A_1", "A_TERRITORY_1", None, "A_1_NDM_DATA", "A_TERRITORY_NAME_1")
    assert catalog.collect_table_set(groups, "B_1") is None
    with pytest.raises(Exception, match="more than one table set"):
        catalog.resolve_table_set(groups.union(groups), "A_1").collect()


def test_listing_shows_empty_text_for_no_date(spark):
    prepared = catalog.preprocess_catalog(tables(spark, [("A_1", None), ("B_1", DAY)]))
    rows = [tuple(r) for r in catalog.listing(catalog.group_tables(prepared)).collect()]
    assert rows == [("A_1", ""), ("B_1", "2024-01-01 00:00:00")]
    assert sorted(tuple(r) for r in catalog.listing(prepared, grouped=False).collect()) == rows


@pytest.mark.parametrize("name", ["", "1A", "A-B", "A B", 'A"', "A;drop", None, "Ä"])
def test_bad_identifiers(name):
    with pytest.raises(ValueError, match="Invalid identifier"):
        quote_identifier(name)


def test_good_identifier():
    assert quote_identifier("_A1$") == "`_A1$`"


def test_table_sets_do_not_depend_on_the_size_of_parts(spark):
    kinds = ["territory", "geometry_source", "name", "ndm_source", "other"]
    rows = [(f"A_{i:03d}", DAY + datetime.timedelta(days=i % 7)) for i in range(64)]
    df = tables(spark, rows).withColumn("Group Key", F.lit("A"))
    df = df.withColumn("Table Type", F.element_at(F.array(*map(F.lit, kinds)), F.substring("Table Name", 3, 3).cast("int") % 5 + 1))
    whole = catalog.table_sets(catalog.group_tables(df)).collect()
    assert whole[0]["ndm_table"] and whole[0]["name_table"]
    for cell_items in (3, 5, 8, 16):
        assert catalog.table_sets(catalog.group_tables(df, cell_items=cell_items)).collect() == whole
