import pytest
from pyspark.sql import functions as F

from terrane.functions import wkb
from terrane.operators.detect import Detection, detect_geometry, prepare_spatial, text_profile, wkb_profile
from terrane.sources.tables import looks_spatial, scan, table_set_metrics


@pytest.fixture(scope="module")
def square(jts):
    return jts.wkb("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")


def rows(spark, value, kind="binary", name="SHAPE", n=3):
    return spark.createDataFrame([(i, value, "plain") for i in range(n)], f"FEATURE_ID bigint, {name} {kind}, NOTE string")


def test_every_rung(spark, square):
    hexed = square.hex()
    binary, text = rows(spark, square), rows(spark, hexed, "string")
    declared = {"FEATURE_ID": "NUMBER", "SHAPE": "GEOGRAPHY", "NOTE": "TEXT"}
    assert detect_geometry(binary, declared) == Detection("SNOWFLAKE_GEOGRAPHY", "SHAPE", "SNOWFLAKE")
    assert detect_geometry(text, declared) == Detection("SNOWFLAKE_GEOGRAPHY", "SHAPE", "SNOWFLAKE")
    named = rows(spark, hexed, "string", "my_wkb_col")
    assert detect_geometry(named) == Detection("WKB_BINARY", "my_wkb_col", "POLARS")
    assert detect_geometry(binary) == Detection("WKB_BINARY", "SHAPE", "POLARS")
    assert detect_geometry(text) == Detection("WKB_TEXT", "SHAPE", "POLARS")
    # A type declared as binary is looked at before text found in the frame.
    assert detect_geometry(text, {"SHAPE": "BINARY"}) == Detection("WKB_BINARY", "SHAPE", "SNOWFLAKE")
    assert detect_geometry(rows(spark, "plain words", "string")) is None


def test_nulls_empties_and_mistakes(spark, square):
    some_null = spark.createDataFrame([(1, square), (2, None)], "FEATURE_ID bigint, SHAPE binary")
    assert detect_geometry(some_null) is None
    empty = spark.createDataFrame([], "FEATURE_ID bigint, SHAPE binary")
    assert detect_geometry(empty) == Detection("WKB_BINARY", "SHAPE", "POLARS")
    empty_text = spark.createDataFrame([], "FEATURE_ID bigint, SHAPE string")
    assert detect_geometry(empty_text) is None
    wrong = spark.createDataFrame([(1, 5)], "FEATURE_ID bigint, WKB_SIZE int")
    with pytest.raises(TypeError, match="WKB_SIZE"):
        detect_geometry(wrong)


def test_preparing_a_table(spark, square):
    table, column = prepare_spatial(rows(spark, square, name="REP_POINT"))
    assert column is None and "REP_POINT" in table.columns
    declared = {"FEATURE_ID": "NUMBER", "SHAPE": "GEOGRAPHY"}
    source = spark.createDataFrame([("1", square.hex(), 2), (None, square.hex(), 3)], "FEATURE_ID string, SHAPE string, A int")
    table, column = prepare_spatial(source, declared)
    assert column == "geometry" and table.columns == ["FEATURE_ID", "A", "geometry"]
    assert {r["FEATURE_ID"]: r["geometry"] for r in table.collect()} == {1: square, None: None}
    table, column = prepare_spatial(rows(spark, square.hex(), "string"), {"SHAPE": "BINARY"})
    assert column is None and "SHAPE" in table.columns


@pytest.mark.parametrize(
    "text, is_hex, is_binary",
    [
        ("", True, False),
        ("0102", True, False),
        ("01 02 ", True, False),
        ("0 11", False, False),
        ("012", False, False),
        ("zz", False, False),
        ("01\n02\t", True, True),
        ("é1", False, True),
        ("01 02 ", False, True),
        ("tab\t", False, True),
    ],
)
def test_text_kinds(spark, text, is_hex, is_binary):
    df = spark.createDataFrame([(text,)], "t string")
    found = df.select(wkb.is_hex_text(F.col("t")), wkb.is_binary_text(F.col("t"))).head()
    assert tuple(found) == (is_hex, is_binary)
    try:
        by_python = len(text) % 2 == 0 and bytes.fromhex(text) is not None
    except ValueError:
        by_python = False
    assert by_python == is_hex


def test_long_hex_text(spark):
    df = spark.range(1).select(F.repeat(F.lit("0A"), 2_000_000).alias("t"))
    assert df.select(wkb.is_hex_text(F.col("t"))).head()[0]


def test_text_profile_covers_all_rows(spark):
    df = spark.createDataFrame([("0a", None), ("zz", None)], "a string, b string")
    found = {r["column_name"]: tuple(r)[1:] for r in text_profile(df).collect()}
    assert found == {"a": (2, 1, 0, False), "b": (0, 0, 0, False)}


def test_validity_agrees_with_geometry_library(spark, jts, square):
    line = jts.wkb("LINESTRING (0 0, 1 1)")
    values = [
        square,
        square + b"\0",
        square[:-1],
        square[:9],
        b"",
        b"\x02" + square[1:],
        square[:1] + b"\x63" + square[2:],
        jts.wkb("POLYGON EMPTY"),
        jts.wkb("POINT EMPTY"),
        jts.wkb("GEOMETRYCOLLECTION (POINT (1 1), MULTIPOINT ((2 2), (3 3)))"),
        jts.wkb("MULTIPOINT ((2 2), (3 3))").replace(b"\x01\x01\x00\x00\x00", b"\x01\x02\x00\x00\x00"),
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v binary")
    found = [r[0] for r in df.orderBy("i").select(wkb.wkb_valid("v")).collect()]
    assert found == [jts.valid_wkb(v) for v in values]
    profile = wkb_profile(df, "v").head()
    assert tuple(profile) == (len(values), sum(found), False)
    # The library on the class path mends an open ring and a line of one point; the one to match refuses them.
    assert not wkb.is_valid(line[:5] + b"\x01" + line[6:25])
    assert not wkb.is_valid(square[:-16] + b"\0" * 15 + b"\x40")


def test_hex_validity(spark, square):
    df = spark.createDataFrame([(square.hex(),), (square.hex().upper(),), ("0102",), ("x",), (None,), (" " + square.hex(),)], "v string")
    assert [r[0] for r in df.select(wkb.wkb_valid("v")).collect()] == [True, True, False, False, None, False]


def test_headers(spark, jts):
    import struct

    samples = {
        "Point": jts.wkb("POINT (1 2)"),
        "MultiPolygon": jts.wkb("MULTIPOLYGON EMPTY"),
        "GeometryCollection": struct.pack("<BII", 1, 7, 0),
        "LineString": struct.pack("<BIII", 1, 2 | 0x20000000, 4326, 0),
        "Polygon": struct.pack(">BII", 0, 1003, 0),
    }
    df = spark.createDataFrame(list(samples.items()), "name string, g binary")
    found = df.select("name", wkb.geometry_type(F.col("g")).alias("t"), wkb.srid(F.col("g")).alias("s")).collect()
    assert all(r["name"] == r["t"] for r in found)
    assert {r["name"]: r["s"] for r in found}["LineString"] == 4326


def test_scan_casts_the_key_strictly(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "FEATURE_ID string, A string")
    assert scan(df, ["FEATURE_ID"]).schema.simpleString() == "struct<FEATURE_ID:bigint>"
    assert scan(df, limit=1).count() == 1
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        scan(spark.createDataFrame([("x",)], "FEATURE_ID string")).collect()
    with pytest.raises(ValueError, match="Missing"):
        scan(df, ["nope"])


def test_metrics_of_a_table_set(spark, square):
    territory, names = rows(spark, "x", "string"), spark.range(4)
    found = table_set_metrics(territory, names=names).head()
    assert (found["rows_fetched"], found["columns_fetched"], found["is_spatial"]) == (7, 4, False)
    assert found["joined_tables"] == {"main": "territory_primary_table", "join_1": "name_table"}
    assert [tuple(s) for s in found["table_shapes"]] == [(3, 3), (4, 1)]
    assert looks_spatial(rows(spark, square, name="WKB"))
    assert not looks_spatial(rows(spark, square, name="wkb"))
    assert looks_spatial(territory, declared={"A": "GEOGRAPHY"}) and looks_spatial(territory, geometry=names)


def test_geography_type(spark, square):
    spark.conf.set("spark.sql.geospatial.enabled", "true")
    try:
        df = spark.createDataFrame([(1, square, "a"), (2, square, "b")], "FEATURE_ID bigint, g binary, A string")
        df = df.selectExpr("FEATURE_ID", "st_geogfromwkb(g) as SHAPE", "A")
        assert detect_geometry(df) == Detection("SNOWFLAKE_GEOGRAPHY", "SHAPE", "SNOWFLAKE")
        table, column = prepare_spatial(df)
        assert column == "geometry" and dict(table.dtypes)["geometry"] == "binary"
        texts = {wkb.to_text(r["geometry"]) for r in table.collect()}
        assert texts == {"POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"}
    finally:
        spark.conf.unset("spark.sql.geospatial.enabled")


def test_values_of_one_header_are_judged_together(monkeypatch):
    """Malformed values with the same header are not read one by one, and are judged as the reader judges them."""
    import struct

    import pyarrow as pa

    square = struct.pack("<BIII10d", 1, 3, 1, 5, 0, 0, 1, 0, 1, 1, 0, 1, 0, 0)
    body = square[5:]
    kinds = [
        square, square + b"\0", square[:60], b"\x01" + struct.pack("<I", 99) + body, b"\x05" + square[1:],
        b"\x01" + struct.pack("<II", 0x20000003, 4326) + body, square[:77] + struct.pack("<2d", 7, 7), square[:4], b"",
        struct.pack(">BII4d", 0, 2, 2, 0, 0, 1, 1), struct.pack("<BII2d", 1, 2, 1, 0, 0), struct.pack("<BI2d", 1, 1, 0, 0),
    ]
    values = [None, *kinds] * 50
    expected = [None if v is None else wkb.is_valid(v) for v in values]
    assert True in expected and False in expected

    def one_by_one(value):
        raise AssertionError("a value was read by itself")

    monkeypatch.setattr(wkb, "is_valid", one_by_one)
    assert wkb.wkb_valid.func(pa.array(values, pa.binary())).to_pylist() == expected
    texts = [None if v is None else v.hex() for v in values]
    assert wkb.wkb_valid.func(pa.array(texts)[1:]).to_pylist() == expected[1:]


def test_long_hex_is_told_without_patterns(spark):
    import re

    values = ["", "0", "0aF9", "0aF", "0a f9", "0a f", "\n", " ", "é", "éa", "ab\x00c", "ab\x7f", "xy", "0g", "٣٤", "ab" * 5_000, "ab" * 5_000 + " c", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    shown = df.select("i", wkb.is_hex_text(F.col("t")).alias("h"), wkb.is_binary_text(F.col("t")).alias("b"))
    assert "unhex" in shown._jdf.queryExecution().optimizedPlan().toString()
    for i, is_hex, is_binary in shown.collect():
        v = values[i]
        if v is None:
            assert is_hex is None and is_binary is None
            continue
        parts = re.split("[ \t\n\x0b\f\r]+", v)
        assert is_hex == (len(v) % 2 == 0 and all(re.fullmatch("[0-9A-Fa-f]*", p) and len(p) % 2 == 0 for p in parts)), repr(v[:20])
        assert is_binary == bool(re.search(r"[^\x20-\x7E]", v)), repr(v[:20])
