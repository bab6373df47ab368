import decimal
import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from terrane.functions.wkb import to_text
from terrane.operators.catalog import TableSet
from terrane.plans.export_run import RunLog, export_table_set
from terrane.sinks import geopackage
from terrane.sinks.prepare import narrow_decimals
from terrane.sinks.write import output_path, write_features


@pytest.fixture(scope="module")
def table(spark, jts):
    shape = jts.wkb("POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))")
    rows = [(i, shape if i % 3 else None, f"n{i}", decimal.Decimal("2.50"), [i], datetime(2024, 1, 1, 2, 3, 4)) for i in range(10)]
    return spark.createDataFrame(
        rows, "FEATURE_ID bigint, geometry binary, NAME string, PRICE decimal(25,2), LIST array<int>, AT timestamp"
    ).repartition(3)


def test_geopackage_parts(table, tmp_path):
    path = tmp_path / "out" / "T.gpkg"
    write_features(table, str(path), layer="T")
    files = sorted(path.glob("part-*.gpkg"))
    assert len(files) == 3 and sorted(p.name for p in path.iterdir()) == [f.name for f in files]
    rows = [r for f in files for r in geopackage.read_rows(str(f), "T")]
    assert sorted(r["FEATURE_ID"] for r in rows) == list(range(10))
    row = next(r for r in rows if r["FEATURE_ID"] == 1)
    assert to_text(row["geom"]) == "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))"
    assert (row["PRICE"], row["LIST"], row["AT"]) == (2.5, "[1]", "2024-01-01T02:03:04.000000Z")
    assert next(r for r in rows if r["FEATURE_ID"] == 0)["geom"] is None
    db = sqlite3.connect(files[0])
    assert db.execute("pragma application_id").fetchone()[0] == 0x47504B47
    assert db.execute("select table_name, srs_id, min_x, min_y, max_x, max_y from gpkg_contents").fetchone() == ("T", 4326, 0, 0, 2, 1)
    assert db.execute("select column_name, geometry_type_name, srs_id from gpkg_geometry_columns").fetchone() == ("geom", "GEOMETRY", 4326)
    blob = db.execute("select geom from T where geom is not null").fetchone()[0]
    assert blob[:4] == b"GP\0\x03"
    db.close()


def test_geopackage_modes(table, tmp_path):
    path = tmp_path / "T.gpkg"
    write_features(table, str(path))
    write_features(table.limit(4), str(path))
    count = lambda: sum(len(geopackage.read_rows(str(f), "T")) for f in path.glob("*.gpkg"))
    assert count() == 4
    write_features(table, str(path), mode="append")
    assert count() == 14


def test_single_file_replaces_the_old_one(table, tmp_path, monkeypatch):
    path = tmp_path / "one.gpkg"
    for limit in (10, 5):
        write_features(table.limit(limit), f"file://{path}", single_file=True)
        assert path.is_file() and len(geopackage.read_rows(str(path), "one")) == limit
    assert [p.name for p in tmp_path.iterdir()] == ["one.gpkg"]
    monkeypatch.setattr("terrane.sinks.write.SINGLE_FILE_ROWS", 3)
    with pytest.raises(ValueError, match="More than 3 rows"):
        write_features(table, str(path), single_file=True)


def test_failed_write_publishes_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(1, b"\x01\x03")], "FEATURE_ID bigint, geometry binary")
    path = tmp_path / "bad.gpkg"
    with pytest.raises(Exception, match="truncated"):
        write_features(bad, str(path))
    assert not list(path.glob("part-*"))


def test_empty_table_is_one_empty_file(spark, table, tmp_path):
    write_features(table.filter("FEATURE_ID < 0"), str(tmp_path / "T"))
    (file,) = (tmp_path / "T").glob("part-*.gpkg")
    assert geopackage.read_rows(str(file), "T") == []


def test_geojson_csv_and_parquet(spark, table, tmp_path):
    write_features(table, str(tmp_path / "j"), format="geojson")
    features = [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()]
    assert len(features) == 10
    one = next(f for f in features if f["properties"]["FEATURE_ID"] == 1)
    assert one["geometry"] == {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]}
    assert one["properties"]["LIST"] == [1] and one["type"] == "Feature"
    assert next(f for f in features if f["properties"]["FEATURE_ID"] == 0)["geometry"] is None
    write_features(table, str(tmp_path / "c"), format="csv")
    text = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert text.filter("FEATURE_ID = 1").head()["geom"] == "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))"
    write_features(table, str(tmp_path / "p"), format="parquet")
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.schema["geom"].metadata == {"encoding": "WKB", "crs": "EPSG:4326"}
    assert back.count() == 10


def test_refusals(table, tmp_path):
    for format, word in (("shp", "not supported"), ("xyz", "unknown")):
        with pytest.raises(ValueError, match=word):
            write_features(table, str(tmp_path / "x"), format=format)
    with pytest.raises(ValueError, match="Geometry column 'geometry' not found"):
        write_features(table.drop("geometry"), str(tmp_path / "x"))
    assert output_path("/out", "A_TERRITORY_1") == "/out/A_TERRITORY_1.gpkg"


def test_decimals(spark):
    df = spark.createDataFrame(
        [(decimal.Decimal("2.5"), decimal.Decimal("7")), (decimal.Decimal("-2.5"), None)], "a decimal(10,1), b decimal(30,0)"
    )
    assert [tuple(r) for r in narrow_decimals(df).collect()] == [(2.5, 7), (-2.5, None)]
    legacy = narrow_decimals(df, legacy_decimal=True)
    assert legacy.dtypes == [("a", "decimal(19,0)"), ("b", "bigint")]
    assert [int(r["a"]) for r in legacy.collect()] == [3, -3]


def test_export_run(spark, jts, tmp_path):
    shape = jts.wkb("POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))")
    tables = {
        "A_TERRITORY_1": spark.createDataFrame([(1, "a"), (2, "b")], "FEATURE_ID bigint, NAME string"),
        "A_1_GEOMETRY_DATA": spark.createDataFrame([(1, shape)], "FEATURE_ID bigint, SHAPE binary"),
    }
    log = RunLog(spark, str(tmp_path / "log"))
    seen = []
    done = export_table_set(
        log, TableSet("A_1", "A_TERRITORY_1", "A_1_GEOMETRY_DATA"), tables.__getitem__, str(tmp_path / "out"), on_status=seen.append
    )
    fetched = ["FETCHING_TABLES", "FETCHING_TERRITORY", "FETCHING_GEOMETRY"]
    assert seen == [*fetched, "JOINING_TABLES", "CONVERTING_GEOMETRY", "EXPORTING_FILE", "FINALIZING", "COMPLETED"]
    steps = [r["status"] for r in log.status_steps().filter(F.col("id") == done).orderBy("step").collect()]
    assert steps == ["UNKNOWN", *fetched, "IN_PROGRESS", *seen[3:]]
    with pytest.raises(ValueError, match="Geometry column"):
        export_table_set(log, TableSet("A_1", "A_TERRITORY_1"), tables.__getitem__, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="needs a territory table"):
        log.register(TableSet("A_1"))
    runs = {r["id"]: r for r in log.runs().collect()}
    assert len(runs) == 2
    row = runs.pop(done)
    assert row["status"] == "COMPLETED" and row["is_spatial"] and row["duration"] > 0
    assert row["rows_fetched"] == 3 and row["joined_tables"]["join_2"] == "geometry_table"
    assert row["export_timestamp"] > row["fetch_timestamp"]
    (failed,) = runs.values()
    assert failed["status"] == "FAILED" and failed["export_timestamp"] is None
    assert log.performance().count() == 2 and "duration" not in log.exports().columns
    assert len(list((tmp_path / "out" / "A_TERRITORY_1.gpkg").glob("part-*.gpkg"))) > 0


def test_history_times_are_utc(spark):
    from terrane.operators.history import exports_history
    from terrane.sources import standins

    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        sf = "/root/testdata/sf0.001"
        rows = exports_history(standins.exports(spark, sf), standins.performance(spark, sf))
        shifted = rows.join(standins.exports(spark, sf).select("id", F.col("fetch_timestamp").alias("raw")), "id")
        micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("raw"))
        assert shifted.filter(F.unix_micros("fetch_timestamp") != micros).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
