"""Union of the geometries of each feature.

Most features are small: their pieces meet in one task, which makes many features at once. The
pieces of the others become segments, and from there on the work is spread by segment and by strip of
a feature, not by feature, so a feature with a huge number of pieces is many tasks. A feature with
one geometry keeps it as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.columns import col
from terrane.functions.overlay import Segments, link, successors, union_boundary
from terrane.functions.wkb import COLLECTION, EMPTY_COLLECTION, is_collection, segments, type_code

KEY = "FEATURE_ID"
# Segments of one feature handled together; a feature with more is cut into strips.
STRIP_SEGMENTS = 4_000
# Segments a single result cell may come from (about 64 MB); beyond it every strip is a row.
CELL_SEGMENTS = 2_000_000
# For unions that are one cell whatever their size.
ONE_CELL = 1 << 62
# Strips are cut at quantiles of this grid: at most so many strips a feature, of so many equal shares.
GRID = 4_096
# A sketch places a quantile within one of so many shares, a fifth of the narrowest strip.
SKETCH_ACCURACY = 20_000
# Where a border lies between two neighbouring quantiles: no round share, which coordinates might have too.
BETWEEN = 0.381966
# Borders are looked up in two steps, first among every so many.
BORDERS_A_STEP = 64

# The keys are never null (kn = 1 marks the null key), which keeps the plan free of null filters
# that would stop Spark from sharing the segment shuffle between its two readers.
SEGMENT_SCHEMA = "k bigint not null, kn int not null, dim int, x1 double, y1 double, x2 double, y2 double, w bigint"
PIECE_SCHEMA = f"{SEGMENT_SCHEMA}, whole binary, alone int"
PART_SCHEMA = "k bigint not null, kn int not null, part int, area binary, lines binary, points binary"
SEGMENT_KEYS = ["k", "kn", "dim", "x1", "y1", "x2", "y2"]
# Area segments whose directions cancel are gone; lines and points always count.
COUNTS = "dim < 2 or w <> 0"
RESULT_SCHEMA = "k bigint not null, kn int not null, part int, geometry binary"


def union_features(
    pieces: DataFrame,
    strip_segments: int = STRIP_SEGMENTS,
    cell_segments: int = CELL_SEGMENTS,
) -> DataFrame:
    """(FEATURE_ID, GEOMETRY_PART, geometry): one geometry per feature, the union of its pieces.

    ``pieces`` has FEATURE_ID and WKB ``geometry``. The null key is a feature of its own and
    null geometries do not count; a feature with nothing else has a null geometry. A
    geometry collection becomes the union of its members. A feature whose union comes from
    more than ``cell_segments`` segments has one row per strip, GEOMETRY_PART 0, 1, 2, ...,
    whose polygons do not overlap and together are the union.
    """
    small, large = by_size(keyed(pieces), strip_segments)
    unions = small.mapInArrow(_union_or_keep, RESULT_SCHEMA)
    merged = unions.unionByName(_union_large(large, strip_segments, cell_segments))
    return merged.select(_key(), F.col("part").alias("GEOMETRY_PART"), "geometry")


def by_size(pieces: DataFrame, strip_segments: int) -> tuple[DataFrame, DataFrame]:
    """The pieces of features that surely have at most ``strip_segments`` segments, and those of the others.

    A segment has a point of its own, of 16 bytes at least. Features of the first kind are whole and in order in a partition, as
    they would be one strip anyhow. The others are few, one for so many segments, and their pieces are dealt out. Both kinds are
    read from one shuffle.
    """
    points = F.sum(F.octet_length("geometry").cast("long")) / 16
    others = pieces.groupBy("k", "kn").agg(points.alias("points")).filter(F.col("points") > strip_segments)
    placed = pieces.join(others.select("k", "kn", F.lit(True).alias("large")), ["k", "kn"], "left")
    partitions = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.when(F.col("large"), F.pmod(F.xxhash64("geometry"), F.lit(partitions))).otherwise(-1)
    dealt = placed.withColumn("share", share).repartition(partitions, "k", "kn", "share")

    def kind(wanted: Column) -> DataFrame:
        # A condition that Spark does not move below the shuffle, which would then be two.
        return dealt.filter(F.when(F.rand(0) >= 0, wanted)).select("k", "kn", "geometry")

    return kind(F.col("large").isNull()).sortWithinPartitions("k", "kn"), kind(F.col("large").isNotNull())


def _union_large(pieces: DataFrame, strip_segments: int, cell_segments: int) -> DataFrame:
    """(k, kn, part, geometry): one geometry per feature, or its strips, by segments that are spread over tasks."""
    known = F.col("geometry").isNotNull()
    # Numbers that tell geometries apart, so that this is a hash aggregate and no geometry is sorted.
    told = {
        "hash": F.xxhash64("geometry"),
        "check": F.crc32("geometry"),
        "bytes": F.octet_length("geometry"),
        "collection": (type_code(F.col("geometry")) == COLLECTION).cast("int"),
    }
    per_feature = pieces.select("k", "kn", *[F.when(known, value).alias(name) for name, value in told.items()]).groupBy("k", "kn")
    ranges = per_feature.agg(*[f(name).alias(f"{f.__name__}_{name}") for name in told for f in (F.min, F.max)])
    alike = reduce(and_, [F.col(f"min_{name}") == F.col(f"max_{name}") for name in ("hash", "check", "bytes")])
    single = alike & (F.col("max_collection") == 0)
    judged = ranges.select("k", "kn", (~F.coalesce(single, F.lit(True))).alias("__split"))

    # One more pass over the pieces gives the segments of split features and the one geometry of each other feature. Both
    # are told apart behind the shuffle, by an aggregate, so that the two readers share it.
    raw = pieces.join(judged, ["k", "kn"]).mapInArrow(_decode_or_keep, PIECE_SCHEMA)
    summed = raw.groupBy(*SEGMENT_KEYS, "whole").agg(F.sum("w").alias("w"), F.max("alone").alias("alone"))
    net = summed.filter(f"alone = 0 and ({COUNTS})").select(*SEGMENT_KEYS, "w")
    merged = merge_net(net, strip_segments, cell_segments).withColumnRenamed("geometry", "__union")
    # The weight of a whole geometry is 0; asking for it keeps this reader's columns those of the other one.
    alone = summed.filter("alone = 1 and w = 0").select("k", "kn", F.col("whole").alias("__one"))
    # A split feature without any segment has only empty pieces.
    merged_or_empty = F.coalesce("__union", F.lit(EMPTY_COLLECTION))
    return judged.join(merged, ["k", "kn"], "left").join(alone, ["k", "kn"], "left").select(
        "k",
        "kn",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.when(F.col("__split"), merged_or_empty).otherwise(F.col("__one")).alias("geometry"),
    )


def keyed(pieces: DataFrame) -> DataFrame:
    """(k, kn, geometry) with a key that is never null: ``kn`` is 1 for the null key.

    All later steps group and join on these two columns, so the plan needs no null-safe
    joins, which would shuffle again by another expression.
    """
    key = col(KEY).cast("long")
    return pieces.select(F.coalesce(key, F.lit(0)).alias("k"), key.isNull().cast("int").alias("kn"), "geometry")


def _key() -> Column:
    return F.when(F.col("kn") == 0, F.col("k")).alias(KEY)


def dissolve_collections(df: DataFrame, geometry: str = "geometry", row_key: str = "ROW_ID") -> DataFrame:
    """Replace each geometry collection by the union of its members; other rows stay as they are.

    ``row_key`` is a bigint column that identifies the rows of ``df``. A collection is one cell, so its union is made
    as one cell too, however large.
    """
    is_collection = F.coalesce(type_code(col(geometry)) == COLLECTION, F.lit(False))
    members = df.filter(is_collection).select(col(row_key).alias(KEY), col(geometry).alias("geometry"))
    unions = merge_pieces(members, cell_segments=ONE_CELL).select(KEY, F.col("geometry").alias("__union"))
    # The unions are as many as the collections: sent to all tasks they would pass whole through the driver.
    dealt = unions.withColumnRenamed(KEY, "__key").hint("merge")
    joined = df.join(dealt, col(row_key) == F.col("__key"), "left")
    value = F.when(is_collection, F.coalesce("__union", F.lit(EMPTY_COLLECTION))).otherwise(col(geometry))
    return joined.withColumn(geometry, value).select(*[col(c) for c in df.columns])


def merge_pieces(
    pieces: DataFrame, strip_segments: int = STRIP_SEGMENTS, cell_segments: int = CELL_SEGMENTS
) -> DataFrame:
    """Union of all pieces of each feature, by segments. Same result columns as :func:`union_features`."""
    small, large = by_size(keyed(pieces), strip_segments)
    unions = small.mapInArrow(_union_all, RESULT_SCHEMA).filter("geometry is not null")
    merged = unions.unionByName(merge_keyed(large, strip_segments, cell_segments))
    return merged.select(_key(), F.col("part").alias("GEOMETRY_PART"), "geometry")


def merge_keyed(pieces: DataFrame, strip_segments: int, cell_segments: int) -> DataFrame:
    """(k, kn, part, geometry): the union of the pieces of each key."""
    return merge_net(net_segments(pieces), strip_segments, cell_segments)


def merge_net(net: DataFrame, strip_segments: int, cell_segments: int) -> DataFrame:
    """(k, kn, part, geometry): the union of each key from its net segments."""
    strips = clustered(in_strips(net, strip_segments, cell_segments), ["k", "kn", "strip"])
    parts = strips.mapInArrow(_strip_boundaries, PART_SCHEMA)
    return clustered(parts, ["k", "kn", "part"]).mapInArrow(_link_parts, RESULT_SCHEMA)


def clustered(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of equal keys together and in order, for a Python stage.

    The number of partitions is set, as the stage's work is larger than its bytes suggest
    and adaptive coalescing would put it into too few tasks.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys).sortWithinPartitions(*keys)


def net_segments(pieces: DataFrame) -> DataFrame:
    """Distinct undirected segments per feature with the net number of pieces on their left.

    Shared edges of neighbouring pieces add up to zero and go; copies of a piece add up to
    one segment. Sums combine on the map side.
    """
    raw = pieces.mapInArrow(_decode, SEGMENT_SCHEMA)
    return raw.groupBy(*SEGMENT_KEYS).agg(F.sum("w").alias("w")).filter(COUNTS)


def in_strips(net: DataFrame, strip_segments: int, cell_segments: int) -> DataFrame:
    """Segments with the strips they reach into and their bounds; small features have one strip.

    Strips hold equal shares of a feature's segments: they are cut at quantiles of the segments' middles, read
    from a sketch that tasks merge, so neither an outlier nor a dense spot fills one strip. They run along the axis on
    which the segments are shorter, measured against the range of the middle 96 % of them; where that is x, the feature is
    mirrored (``flip``: x and y change places, which turns directions round). Only large features are sketched;
    without any, the joins below find an empty side at run time and cost nothing.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    sizes = net.groupBy("k", "kn").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > strip_segments)
    # One folded literal: thousands of single ones would weigh the plan down.
    ranks = F.expr(f"cast(split('{','.join(str(i / GRID) for i in range(1, GRID))}', ',') as array<double>)")
    measured = (
        net.join(sizes, ["k", "kn"])
        .groupBy("k", "kn")
        .agg(
            F.first("n").alias("n"),
            F.sum(high - low).alias("rise"),
            F.sum(F.abs(F.col("x2") - F.col("x1"))).alias("run"),
            F.percentile_approx((F.col("x1") + F.col("x2")) / 2, ranks, SKETCH_ACCURACY).alias("xs"),
            F.percentile_approx((F.col("y1") + F.col("y2")) / 2, ranks, SKETCH_ACCURACY).alias("ys"),
        )
    )
    most = GRID // 50

    def crossings(length: str, at: str) -> Column:
        """How often the segments reach through the range of their middles; endless where these lie in one place."""
        return F.coalesce(F.try_divide(F.col(length), F.get(at, F.lit(GRID - 2 - most)) - F.get(at, F.lit(most))), F.lit(float("inf")))

    flip = crossings("rise", "ys") > crossings("run", "xs")
    strips = F.least(F.ceil(F.col("n") / strip_segments), F.lit(GRID)).cast("int")
    # A border lies between a quantile and the next larger one, off the coordinates of level segments, whose crossings would
    # otherwise be rounded in one way as crossings and in another as places on the border.
    at = F.transform(F.sequence(F.lit(1), strips - 1), lambda i: F.get("grid", F.floor(i * GRID / strips).cast("int") - 1))
    cuts = F.transform(at, lambda v: v + (F.get("steps", F.array_position("steps", v).cast("int")) - v) * BETWEEN)
    large = (
        measured.select("k", "kn", "n", flip.alias("flip"), F.when(flip, F.col("xs")).otherwise(F.col("ys")).alias("grid"))
        .withColumn("steps", F.array_distinct("grid"))
        .select("k", "kn", "flip", (F.col("n") > cell_segments).cast("int").alias("closed"), F.filter(F.array_distinct(cuts), F.isnotnull).alias("borders"))
        .withColumn("steps", F.expr(f"filter(borders, (b, i) -> i % {BORDERS_A_STEP} = {BORDERS_A_STEP - 1})"))
    )
    mirrored = F.coalesce("flip", F.lit(False))
    placed = net.join(large, ["k", "kn"], "left").withColumns(
        {
            "x1": F.when(mirrored, F.col("y1")).otherwise(F.col("x1")),
            "y1": F.when(mirrored, F.col("x1")).otherwise(F.col("y1")),
            "x2": F.when(mirrored, F.col("y2")).otherwise(F.col("x2")),
            "y2": F.when(mirrored, F.col("x2")).otherwise(F.col("y2")),
            "w": F.when(mirrored, -F.col("w")).otherwise(F.col("w")),
            "flip": mirrored.cast("int"),
            "closed": F.coalesce("closed", F.lit(0)),
        }
    )

    def before(y: str, compared: str) -> str:
        """SQL for the number of borders before ``y``."""
        step = f"{BORDERS_A_STEP} * size(filter(steps, b -> b {compared} {y}))"
        return f"transform(array({step}), at -> at + size(filter(slice(borders, at + 1, {BORDERS_A_STEP}), b -> b {compared} {y})))[0]"

    # A segment that ends on a border belongs to the strips on both sides.
    reached = f"sequence({before('least(y1, y2)', '<')}, {before('greatest(y1, y2)', '<=')})"
    below, above = "if(i > 0, get(borders, i - 1), double('-infinity'))", "coalesce(get(borders, i), double('infinity'))"
    whole = "array(named_struct('strip', 0, 'lo', double('-infinity'), 'hi', double('infinity')))"
    strip = f"if(borders is null, {whole}, transform({reached}, i -> named_struct('strip', i, 'lo', {below}, 'hi', {above})))"
    return placed.withColumn("at", F.explode(F.expr(strip))).select(
        "k", "kn", "at.strip", "dim", "x1", "y1", "x2", "y2", "w", "at.lo", "at.hi", "closed", "flip"
    )


def _numpy(table: pa.Table | pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [np.asarray(table.column(n)) for n in names]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the pieces."""
    for batch in batches:
        batch = batch.filter(batch.column("geometry").is_valid())
        yield pa.RecordBatch.from_arrays(_segment_arrays(batch), names=[*SEGMENT_KEYS, "w"])


def _segment_arrays(batch: pa.RecordBatch) -> list[pa.Array]:
    k, kn = _numpy(batch, "k", "kn")
    row, dim, xy = segments(batch.column("geometry").to_pylist())
    whole = Segments(row, dim, xy, np.where(dim == 2, 1, 0)).directed()
    return [
        pa.array(k[row], pa.int64()),
        pa.array(kn[row], pa.int32()),
        pa.array(dim, pa.int32()),
        *[pa.array(np.ascontiguousarray(whole.xy[:, c]), pa.float64()) for c in range(4)],
        pa.array(whole.weight, pa.int64()),
    ]


def _decode_or_keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the pieces of split features, and the geometries of the others as they are."""
    names = [*SEGMENT_KEYS, "w", "whole", "alone"]
    for batch in batches:
        # Nulls go here: as a filter they would make Spark compute the geometry once more.
        batch = batch.filter(batch.column("geometry").is_valid())
        split = batch.column("__split")
        arrays = _segment_arrays(batch.filter(split))
        rows = len(arrays[0])
        yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(rows, pa.binary()), pa.array(np.zeros(rows, np.int32))], names=names)
        kept = batch.filter(pc.invert(split))
        rows = kept.num_rows
        empty = [pa.nulls(rows, pa.int32()), *[pa.nulls(rows, pa.float64())] * 4, pa.array(np.zeros(rows, np.int64))]
        arrays = [kept.column("k"), kept.column("kn"), *empty, kept.column("geometry"), pa.array(np.ones(rows, np.int32))]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of complete groups from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = _numpy(batch, *keys)
        other = np.flatnonzero(np.any([c != c[-1] for c in columns], axis=0))
        start = int(other[-1]) + 1 if len(other) else 0
        goes_on = bool(held) and all(held[-1].column(k)[-1].as_py() == c[0] for k, c in zip(keys, columns))
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = [batch.slice(start)]
        elif held and not goes_on:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _group_starts(columns: list[np.ndarray]) -> np.ndarray:
    fresh = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.r_[0, np.flatnonzero(fresh) + 1]


def _union_or_keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The geometry of each whole feature: what all its pieces are, or else their union."""
    for table in whole_groups(batches, ["k", "kn"]):
        yield _union_groups(table, keep=True)


def _union_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The union of each whole feature; null if there is nothing in it."""
    for table in whole_groups(batches, ["k", "kn"]):
        yield _union_groups(table, keep=False)


def _union_groups(table: pa.Table, keep: bool) -> pa.RecordBatch:
    k, kn = _numpy(table, "k", "kn")
    starts = _group_starts([k, kn])
    group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k)]))
    coded = table.column("geometry").combine_chunks().dictionary_encode()
    rows = np.flatnonzero(coded.is_valid())
    code, group = coded.indices.drop_null().to_numpy(), group[rows]
    values = coded.dictionary.to_pylist()
    geometries: list[bytes | None] = [None] * len(starts)
    if keep:
        # Groups that have geometries, and the least and greatest of each.
        firsts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, int)
        least, most = (f.reduceat(code, firsts) if len(firsts) else firsts for f in (np.minimum, np.maximum))
        split = np.zeros(len(starts), dtype=bool)
        for g, low, high in zip(group[firsts].tolist(), least.tolist(), most.tolist()):
            if low == high and not is_collection(values[low]):
                geometries[g] = values[low]
            else:
                geometries[g], split[g] = EMPTY_COLLECTION, True
        code, group = code[split[group]], group[split[group]]
    for g, union in _unions(group, code, values):
        geometries[g] = union
    arrays = [pa.array(k[starts], pa.int64()), pa.array(kn[starts], pa.int32()), pa.array(np.zeros(len(starts), np.int32)), pa.array(geometries, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=["k", "kn", "part", "geometry"])


def _unions(group: np.ndarray, code: np.ndarray, values: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(group, union) of the groups that have segments; a group's rows name its pieces by their places in ``values``."""
    used, code = np.unique(code, return_inverse=True)
    row, dim, xy = segments([values[i] for i in used])
    order = np.argsort(row, kind="stable")
    sizes = np.bincount(row, minlength=len(used))
    # The segments of each piece, piece after piece.
    before = np.cumsum(sizes) - sizes
    counts = sizes[code]
    at = order[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts - before[code], counts)]
    net = _net(Segments(np.repeat(group, counts), dim[at], xy[at], np.where(dim[at] == 2, 1, 0)).directed())
    if not len(net.group):
        return
    present, net.group = np.unique(net.group, return_inverse=True)
    endless = np.full(len(present), np.inf)
    bound = union_boundary(net, -endless, endless, np.zeros(len(present), dtype=bool))
    bound = bound.take(np.argsort(bound.group, kind="stable"))
    parts = [bound.take(bound.dim == d) for d in range(3)]
    stops = [np.searchsorted(p.group, np.arange(len(present) + 1)).tolist() for p in parts]
    points, lines, area = (p.xy for p in parts)
    follow, tail = successors(parts[2].group, area)
    for i, g in enumerate(present.tolist()):
        spots, strokes, mine = (slice(s[i], s[i + 1]) for s in stops)
        linked = link(area[mine], follow[mine] - mine.start, tail[mine], lines[strokes], points[spots, :2])
        if linked is not None:
            yield g, linked


def _net(s: Segments) -> Segments:
    """Distinct segments of each group with the sum of their weights, as ``net_segments`` has them."""
    # Adding 0 makes one zero of both; all that is no number is alike.
    xy = s.xy + 0.0
    xy[np.isnan(xy)] = np.nan
    bits = np.ascontiguousarray(xy).view("i8")
    order = np.lexsort((*bits.T, s.dim, s.group))
    fresh = _group_starts([column[order] for column in (s.group, s.dim, *bits.T)]) if len(order) else np.zeros(0, int)
    weight = np.add.reduceat(s.weight[order], fresh) if len(fresh) else np.zeros(0, int)
    first = order[fresh]
    counts = (s.dim[first] < 2) | (weight != 0)
    return Segments(s.group[first][counts], s.dim[first][counts], xy[first][counts], weight[counts])


def _strip_boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["k", "kn", "strip"]):
        k, kn, strip, dim, w = _numpy(table, "k", "kn", "strip", "dim", "w")
        lo, hi, closed, flip = _numpy(table, "lo", "hi", "closed", "flip")
        starts = _group_starts([k, kn, strip])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(k)]))
        xy = np.column_stack(_numpy(table, "x1", "y1", "x2", "y2"))
        bound = union_boundary(
            Segments(group, dim, xy, w), lo[starts], hi[starts], closed[starts].astype(bool)
        )
        # Undo the mirroring: coordinates back in place, directions back round.
        bound.xy = np.where((flip[starts] == 1)[bound.group][:, None], bound.xy[:, ::-1], bound.xy)
        order = np.argsort(bound.group, kind="stable")
        bound = bound.take(order)
        firsts = np.searchsorted(bound.group, np.arange(len(starts) + 1))
        packed: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        for g in range(len(starts)):
            part_xy, part_dim = bound.xy[firsts[g] : firsts[g + 1]], bound.dim[firsts[g] : firsts[g + 1]]
            for d in packed:
                packed[d].append(part_xy[part_dim == d].tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(k[starts], pa.int64()),
                pa.array(kn[starts], pa.int32()),
                pa.array(np.where(closed[starts] == 1, strip[starts], 0), pa.int32()),
                pa.array(packed[2], pa.binary()),
                pa.array(packed[1], pa.binary()),
                pa.array(packed[0], pa.binary()),
            ],
            names=["k", "kn", "part", "area", "lines", "points"],
        )


def _link_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["k", "kn", "part"]):
        k, kn, part = _numpy(table, "k", "kn", "part")
        starts = _group_starts([k, kn, part])
        stops = np.r_[starts[1:], len(k)]
        groups = list(zip(starts, stops))
        stacked = {
            name: [np.frombuffer(b"".join(cells[a:b]), dtype="f8").reshape(-1, 4) for a, b in groups]
            for name, cells in ((n, table.column(n).to_pylist()) for n in ("area", "lines", "points"))
        }
        sizes = np.array([len(xy) for xy in stacked["area"]])
        follow, tail = successors(np.repeat(np.arange(len(groups)), sizes), np.concatenate(stacked["area"]))
        bounds = np.r_[0, np.cumsum(sizes)]
        geometries = []
        for g in range(len(groups)):
            mine = slice(bounds[g], bounds[g + 1])
            geometries.append(
                link(
                    stacked["area"][g],
                    follow[mine] - bounds[g],
                    tail[mine],
                    stacked["lines"][g],
                    stacked["points"][g][:, :2],
                )
            )
        # A strip with nothing in it has no row; part 0 stays so that every feature has one.
        keep = np.array([g is not None or part[s] == 0 for g, s in zip(geometries, starts)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(k[starts][keep], pa.int64()),
                pa.array(kn[starts][keep], pa.int32()),
                pa.array(part[starts][keep], pa.int32()),
                pa.array([g for g, kept in zip(geometries, keep) if kept], pa.binary()),
            ],
            names=["k", "kn", "part", "geometry"],
        )
