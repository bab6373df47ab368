import math
import random
import struct

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.functions.wkb import Reader, to_text, wkb_area
from terrane.operators import union
from terrane.operators.union import dissolve_collections, merge_pieces, union_features

CASES = {
    "edge": ["POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))"],
    "overlap": ["POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))"],
    "t_junction": [
        "POLYGON ((0 0, 2 0, 2 1, 0 1, 0 0))",
        "POLYGON ((0 1, 1 1, 1 2, 0 2, 0 1))",
        "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))",
    ],
    "inside": ["POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))"],
    "corner": ["POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))"],
    "copies": ["POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"] * 3 + ["POLYGON ((5 5, 6 5, 6 6, 5 5))"],
    "ring": [
        f"POLYGON (({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y + 1}, {x} {y}))"
        for x in range(3)
        for y in range(3)
        if (x, y) != (1, 1)
    ],
    "diamond": [
        f"POLYGON (({x} {y}, {x + 1} {y}, {x + 1} {y + 1}, {x} {y + 1}, {x} {y}))"
        for x, y in ((1, 0), (0, 1), (2, 1), (1, 2))
    ],
    "hole_filled": [
        "POLYGON ((0 0, 6 0, 6 6, 0 6, 0 0), (1 1, 5 1, 5 5, 1 5, 1 1))",
        "POLYGON ((2 2, 3 2, 3 3, 2 3, 2 2))",
        "POLYGON ((0.5 0.5, 1.5 0.5, 1.5 1.5, 0.5 1.5, 0.5 0.5))",
    ],
    "hole_at_corner": [
        "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 1, 1 2, 0 0))",
        "POLYGON ((10 0, 11 0, 11 1, 10 0))",
    ],
    "multi": ["MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((3 3, 4 3, 4 4, 3 3)))", "POLYGON ((0.5 0, 3.5 0, 3.5 3.5, 0.5 0))"],
    "clockwise": ["POLYGON ((0 0, 0 1, 1 1, 1 0, 0 0))", "POLYGON ((0.5 0, 0.5 2, 2 2, 2 0, 0.5 0))"],
    "lines": ["LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", "LINESTRING (1 1, 3 3)"],
    "line_over_area": ["POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))", "LINESTRING (-1 1, 3 1)", "LINESTRING (0 0, 2 0)"],
    "points": ["POINT (1 1)", "POINT (1 1)", "MULTIPOINT ((2 2), (5 5))"],
    "points_over_area": [
        "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))",
        "POINT (1 1)",
        "POINT (2 1)",
        "POINT (3 3)",
        "POINT (0 0)",
        "POINT (8 8)",
        "LINESTRING (7 7, 9 9)",
    ],
    "collection": ["GEOMETRYCOLLECTION (POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0)), POLYGON ((1 0, 3 0, 3 1, 1 0)))"],
    "mixed_collection": ["GEOMETRYCOLLECTION (POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0)), LINESTRING (1 1, 5 1))"],
    "repeated_points": ["POLYGON ((0 0, 1 0, 1 0, 1 1, 0 1, 0 0))", "POLYGON ((0 0, 0 1, -1 1, -1 1, 0 0))"],
    "loop": ["LINESTRING (0 0, 1 0, 1 1, 0 0)", "LINESTRING (4 4, 5 5)"],
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "FEATURE_ID bigint, geometry binary")


def unions(df):
    found = {}
    for row in df.collect():
        found.setdefault(row["FEATURE_ID"], []).append((row["GEOMETRY_PART"], row["geometry"]))
    return found


@pytest.mark.parametrize("strip_segments", [4000, 3])
def test_cases_match_geometry_library(spark, jts, strip_segments):
    names = list(CASES)
    rows = [(i, jts.wkb(t)) for i, name in enumerate(names) for t in CASES[name]]
    found = unions(union_features(frame(spark, rows), strip_segments))
    problems = {}
    for i, name in enumerate(names):
        ((part, value),) = found[i]
        verdict = jts.same(value, [jts.wkb(t) for t in CASES[name]])
        if verdict or part:
            problems[name] = verdict
    assert not problems


def random_polygon(rng):
    x, y, r = rng.uniform(0, 10), rng.uniform(0, 10), rng.uniform(0.5, 4)
    n = rng.randint(3, 9)
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    points = [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]
    return points + points[:1]


def polygon_wkb(points):
    return struct.pack("<BIII", 1, 3, 1, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def random_features(jts, count, pieces, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        kept = 0
        while kept < pieces:
            value = polygon_wkb(random_polygon(rng))
            if jts.read(value).isValid():
                rows.append((i, value))
                kept += 1
    return rows


@pytest.mark.parametrize("strip_segments", [4000, 7])
def test_random_polygons_match_geometry_library(spark, jts, strip_segments):
    rows = random_features(jts, 40, 8, 7)
    found = unions(union_features(frame(spark, rows), strip_segments))
    verdicts = {i: jts.same(found[i][0][1], [g for k, g in rows if k == i]) for i in range(40)}
    assert not {i: v for i, v in verdicts.items() if v}


def test_oversized_feature_is_whole_over_several_rows(spark, jts):
    rows = random_features(jts, 2, 60, 3) + [(9, jts.wkb("POLYGON ((0 0, 1 0, 1 1, 0 0))"))]
    found = unions(union_features(frame(spark, rows), strip_segments=40, cell_segments=100))
    for i in (0, 1):
        parts = [jts.read(g) for _, g in found[i]]
        assert len(parts) > 3
        assert all(p.isValid() for p in parts)
        assert sorted(p for p, _ in found[i])[0] == 0
        whole = jts.union([g for k, g in rows if k == i])
        assert sum(p.getArea() for p in parts) == pytest.approx(whole.getArea(), rel=1e-9)
        again = jts.union([g for _, g in found[i]])
        gap = jts.overlay.overlay(again, whole, 4)
        assert gap.getArea() < 1e-9
    assert [p for p, _ in found[9]] == [0]


def test_hot_feature_is_spread_over_strips(spark):
    """One feature has nearly all pieces; the copies go in the first sum, the rest is cut up."""
    cells = spark.range(20000).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 50).otherwise(F.lit(-1)).alias("FEATURE_ID"),
        (F.col("id") % 100).cast("double").alias("x"),
        F.floor(F.col("id") / 100).cast("double").alias("y"),
    )
    from terrane.functions.wkb import rectangle_wkb
    from terrane.operators.union import in_strips, keyed, net_segments

    pieces = cells.select("FEATURE_ID", rectangle_wkb("x", "y", F.col("x") + 1.5, F.col("y") + 1.0).alias("geometry"))
    strips = in_strips(net_segments(keyed(pieces)), 500, 10**9).filter("k = -1").groupBy("strip").count().collect()
    assert len(strips) > 50
    assert max(r["count"] for r in strips) < 3000
    area = union_features(pieces, strip_segments=500).filter("FEATURE_ID = -1").select(wkb_area("geometry")).head()[0]
    covered = set()
    for i in range(20000):
        if i % 10:
            x, y = i % 100, i // 100
            covered |= {(x, y, 0), (x, y, 1), (x + 1, y, 0)}
    assert area == pytest.approx(len(covered) / 2)


@pytest.mark.parametrize("upright", [True, False])
@pytest.mark.parametrize("cell_segments", [10**9, 500])
def test_long_segments_are_cut_across(spark, jts, upright, cell_segments):
    """A fence of long bars: strips follow the axis on which each bar is in few of them."""
    from terrane.operators.union import in_strips, keyed, net_segments

    def bar(i):
        text = "POLYGON (({a} 0, {b} 0, {b} 100, {a} 100, {a} 0))" if upright else "POLYGON ((0 {a}, 100 {a}, 100 {b}, 0 {b}, 0 {a}))"
        return jts.wkb(text.format(a=i, b=i + (0.5 if i % 3 else 1.25)))

    bars = [bar(i) for i in range(300)]
    df = frame(spark, [(1, b) for b in bars])
    strips = in_strips(net_segments(keyed(df)), 100, cell_segments).groupBy("strip").count().collect()
    assert len(strips) >= 12 and max(r["count"] for r in strips) < 250
    found = unions(union_features(df, strip_segments=100, cell_segments=cell_segments))[1]
    if cell_segments > 10**6:
        assert jts.same(found[0][1], bars) == ""
    else:
        parts = [jts.read(g) for _, g in found]
        assert len(parts) > 5 and all(p.isValid() for p in parts)
        assert sum(p.getArea() for p in parts) == pytest.approx(jts.union(bars).getArea(), rel=1e-9)


def test_null_keys_null_and_empty_geometries(spark, jts):
    square = jts.wkb("POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))")
    beside = jts.wkb("POLYGON ((1 0, 2 0, 2 1, 1 1, 1 0))")
    empty, other_empty = jts.wkb("POLYGON EMPTY"), jts.wkb("MULTIPOLYGON EMPTY")
    rows = [(None, square), (None, beside), (1, None), (2, square), (2, None), (3, empty), (3, other_empty), (4, empty)]
    rows += [(5, square), (5, empty), (0, beside)]
    found = unions(union_features(frame(spark, rows)))
    assert jts.read(found[None][0][1]).getArea() == 2
    assert found[1] == [(0, None)]
    assert found[2] == [(0, square)]
    assert jts.read(found[3][0][1]).isEmpty()
    assert found[4] == [(0, empty)]
    assert jts.read(found[5][0][1]).getArea() == 1
    assert found[0] == [(0, beside)]


def test_byte_orders_srid_and_z_are_read_alike(spark, jts):
    points = [(0, 0), (1, 0), (1, 1), (0, 0)]
    big = struct.pack(">BIII", 0, 3, 1, 4) + b"".join(struct.pack(">dd", *p) for p in points)
    srid = struct.pack("<BIIII", 1, 3 | 0x20000000, 4326, 1, 4) + b"".join(struct.pack("<dd", *p) for p in points)
    iso_z = struct.pack("<BIII", 1, 1003, 1, 4) + b"".join(struct.pack("<ddd", *p, 7) for p in points)
    flag_zm = struct.pack("<BIII", 1, 3 | 0xC0000000, 1, 4) + b"".join(struct.pack("<dddd", *p, 7, 8) for p in points)
    far = jts.wkb("POLYGON ((10 10, 11 10, 11 11, 10 10))")
    rows = [(i, g) for i, g in enumerate([big, srid, iso_z, flag_zm])] + [(i, far) for i in range(4)]
    found = unions(union_features(frame(spark, rows)))
    texts = {to_text(found[i][0][1]) for i in range(4)}
    assert texts == {"MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((10 10, 11 10, 11 11, 10 10)))"}


def test_result_does_not_depend_on_partitioning(spark, jts):
    rows = random_features(jts, 10, 5, 11)
    results = []
    for partitions, shuffles in ((1, "3"), (7, "5")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        try:
            results.append(unions(union_features(frame(spark, rows).repartition(partitions))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_collections_are_dissolved_row_by_row(spark, jts):
    collection = jts.wkb(CASES["collection"][0])
    plain = jts.wkb("POLYGON ((0 0, 1 0, 1 1, 0 0))")
    hollow = jts.wkb("GEOMETRYCOLLECTION EMPTY")
    df = spark.createDataFrame(
        [(1, "a", collection), (2, "b", plain), (3, "c", None), (4, "d", hollow)], "ROW_ID bigint, label string, geometry binary"
    )
    rows = {r["ROW_ID"]: r for r in dissolve_collections(df).collect()}
    assert jts.same(rows[1]["geometry"], [collection]) == ""
    assert jts.read(rows[1]["geometry"]).getGeometryType() == "Polygon"
    assert rows[2]["geometry"] == plain and rows[3]["geometry"] is None
    assert jts.read(rows[4]["geometry"]).isEmpty()
    assert [rows[i]["label"] for i in (1, 2, 3, 4)] == ["a", "b", "c", "d"]


def test_bad_bytes_fail_the_union(spark):
    df = frame(spark, [(1, b"\x01\x03"), (1, b"\x01\x04")])
    with pytest.raises(Exception, match="truncated"):
        merge_pieces(df).collect()


def test_reader_reads_nested_collections(jts):
    value = jts.wkb("GEOMETRYCOLLECTION (GEOMETRYCOLLECTION (POINT (1 2)), LINESTRING (0 0, 1 1))")
    assert [kind for kind, _ in Reader(value).geometry()] == [1, 2]


def test_large_collection_keeps_all_of_its_area(spark, jts, monkeypatch):
    squares = [f"POLYGON (({3 * i} {i}, {3 * i + 1} {i}, {3 * i + 1} {i + 1}, {3 * i} {i + 1}, {3 * i} {i}))" for i in range(200)]
    collection = jts.wkb(f"GEOMETRYCOLLECTION ({', '.join(squares)})")
    monkeypatch.setattr(union, "STRIP_SEGMENTS", 50)
    monkeypatch.setattr(union, "CELL_SEGMENTS", 100)
    monkeypatch.setattr(union.merge_pieces, "__defaults__", (50, 100))
    df = spark.createDataFrame([(1, collection)], "ROW_ID bigint, geometry binary")
    rows = union.dissolve_collections(df).collect()
    assert len(rows) == 1 and jts.read(rows[0]["geometry"]).getArea() == pytest.approx(200.0)


def test_single_pieces_are_told_without_sorting_geometries(spark):
    square = "010300000001000000050000000000000000000000000000000000000000000000000000000000000000f03f000000000000f03f000000000000f03f000000000000f03f000000000000000000000000000000000000000000000000"
    wkb = bytes.fromhex(square)
    pieces = spark.createDataFrame([(1, wkb), (1, wkb), (1, None), (2, None), (None, wkb)], "FEATURE_ID long, geometry binary")
    found = union_features(pieces)
    assert sorted(((r[0], r[2] and bytes(r[2])) for r in found.collect()), key=str) == sorted([(1, wkb), (2, None), (None, wkb)], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "min(geometry" not in plan and "max(geometry" not in plan and "SortAggregate" not in plan


def strip_sizes(spark, pieces, strip_segments):
    from terrane.operators.union import in_strips, keyed, net_segments

    strips = in_strips(net_segments(keyed(pieces)), strip_segments, 10**9)
    return [r["count"] for r in strips.groupBy("strip").count().collect()]


@pytest.mark.parametrize("far", ["1e9", "-1e7"])
def test_an_outlier_or_a_dense_spot_fills_no_strip(spark, far):
    """20,000 squares, half of them in a hundredth of the height, and one far away: strips hold equal shares."""
    from terrane.functions.wkb import rectangle_wkb

    y = F.when(F.col("id") % 2 == 0, F.floor(F.col("id") / 100) / 100).otherwise(F.floor(F.col("id") / 100))
    cells = spark.range(20_001).select(
        F.lit(1).cast("long").alias("FEATURE_ID"),
        F.when(F.col("id") == 20_000, F.expr(f"{far}D")).otherwise((F.col("id") % 100) * 2.0).alias("x"),
        F.when(F.col("id") == 20_000, F.expr(f"{far}D")).otherwise(y.cast("double")).alias("y"),
    )
    pieces = cells.select("FEATURE_ID", rectangle_wkb("x", "y", F.col("x") + 1.0, F.col("y") + 0.005).alias("geometry"))
    found = strip_sizes(spark, pieces, 1000)
    assert len(found) > 60 and max(found) < 2000
    area = union_features(pieces, strip_segments=1000, cell_segments=10**9).select(wkb_area("geometry")).head()[0]
    corners = {(r["x"], r["y"]) for r in cells.collect()}
    # The far square's height is what doubles leave of it there.
    height = float(far) + 0.005 - float(far)
    assert area == pytest.approx((len(corners) - 1) * 0.005 + height, rel=1e-6)


def test_pieces_are_decoded_once(spark):
    """Segments of split features and geometries of the others come out of one pass and one shuffle."""
    from terrane.functions.wkb import rectangle_wkb

    x = F.col("id").cast("double")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(value):
        seen.add(1)
        return value

    pieces = spark.range(1000).select((F.col("id") % 70).alias("FEATURE_ID"), rectangle_wkb(x, x, watched(x + 1.0), x + 1.0).alias("geometry"))
    assert len(union_features(pieces).collect()) == 70
    assert seen.value == 2 * 1000


def test_small_features_are_made_by_one_task(spark, monkeypatch):
    """Only pieces of large features become segments in the shuffle; both ways give the same unions."""
    from terrane.functions.wkb import rectangle_wkb, wkb_area

    x = (F.col("id") % 5).cast("double")
    pieces = spark.range(300).select(
        F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("FEATURE_ID"),
        F.when(F.col("id") % 3 > 0, rectangle_wkb(x, x, x + 1.5, x + 1.0)).alias("geometry"),
    )
    empty = spark.sql("select 100L FEATURE_ID, cast(null as binary) geometry")
    # A null, an empty collection, and copies of one geometry.
    more = spark.sql("select 101L FEATURE_ID, unhex('010700000000000000') geometry")
    copies = pieces.filter("FEATURE_ID = 1 and geometry is not null").select(F.lit(102).cast("long").alias("FEATURE_ID"), F.max("geometry").over(W.partitionBy()).alias("geometry"))
    every = pieces.unionByName(empty).unionByName(more).unionByName(copies)

    def found(strip_segments):
        made = union_features(every, strip_segments=strip_segments)
        return sorted(made.select("FEATURE_ID", "GEOMETRY_PART", "geometry", F.round(wkb_area("geometry"), 9)).collect(), key=str)

    small, by_segment = found(4000), found(1)
    assert len(small) == 10 and [r[:2] for r in small] == [r[:2] for r in by_segment]
    assert [r[3] for r in small] == [r[3] for r in by_segment]
    assert next(r[2] for r in small if r[0] == 100) is None

    seen = []
    monkeypatch.setattr(union, "in_strips", lambda net, *rest, f=union.in_strips: seen.append(net) or f(net, *rest))
    union_features(every).collect()
    assert seen and seen[0].count() == 0


def test_unions_of_collections_are_not_sent_to_the_driver(spark):
    rows = spark.sql("select id as ROW_ID, unhex(concat('0107000000010000000101000000', repeat('00', 16))) geometry from range(20)")
    dissolved = dissolve_collections(rows)
    assert len(dissolved.collect()) == 20
    top = dissolved._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    first_join = next(line for line in top.splitlines() if "Join" in line)
    assert "SortMergeJoin" in first_join
