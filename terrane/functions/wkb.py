"""Well-known binary: header expressions, validity, and decoding into segments.

Geometries travel as WKB bytes. What the header answers (type, SRID) is a JVM expression;
the rest decodes whole Arrow batches with numpy. Coordinates are read in 2D: Z and M
values are skipped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType

# WKB type codes and the flag bits of the extended form.
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
TYPE_NAMES = {
    POINT: "Point",
    LINE: "LineString",
    POLYGON: "Polygon",
    MULTIPOINT: "MultiPoint",
    MULTILINE: "MultiLineString",
    MULTIPOLYGON: "MultiPolygon",
    COLLECTION: "GeometryCollection",
}
MEMBER_TYPE = {MULTIPOINT: POINT, MULTILINE: LINE, MULTIPOLYGON: POLYGON}
Z_FLAG, M_FLAG, SRID_FLAG = 0x80000000, 0x40000000, 0x20000000

EMPTY_COLLECTION = struct.pack("<BII", 1, COLLECTION, 0)

# Bytes of the longest header that is judged for many values at once: mark, type, SRID, rings, points.
_HEADER = 17
# Values of hexadecimal digits; 255 for other characters.
_NIBBLE = np.full(256, 255, dtype="u1")
_NIBBLE[np.frombuffer(b"0123456789ABCDEFabcdef", dtype="u1")] = [*range(16), *range(10, 16)]


def _byte(wkb: Column, place: int) -> Column:
    return F.conv(F.hex(F.substring(wkb, place, 1)), 16, 10).cast("int")


def _little(wkb: Column) -> Column:
    return _byte(wkb, 1) != 0


def type_code(wkb: Column) -> Column:
    """Geometry type 1..7 from the header, for both byte orders, ISO and extended."""
    low = F.when(_little(wkb), _byte(wkb, 2)).otherwise(_byte(wkb, 5))
    high = F.when(_little(wkb), _byte(wkb, 3)).otherwise(_byte(wkb, 4))
    return (low + high * 256) % 1000


def is_collection(data: bytes) -> bool:
    """Whether the header of a value names a geometry collection, as ``type_code`` reads it."""
    if len(data) < 3 or (data[0] == 0 and len(data) < 5):
        return False
    low, high = (data[1], data[2]) if data[0] else (data[4], data[3])
    return (low + high * 256) % 1000 == COLLECTION


def geometry_type(wkb: Column) -> Column:
    pairs = [F.lit(x) for item in TYPE_NAMES.items() for x in item]
    return F.create_map(*pairs)[type_code(wkb)]


def srid(wkb: Column) -> Column:
    """SRID of extended WKB, 0 when the header carries none."""
    flags = F.when(_little(wkb), _byte(wkb, 5)).otherwise(_byte(wkb, 2))
    digits = F.hex(F.substring(wkb, 6, 4))
    swapped = F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    value = F.conv(F.when(_little(wkb), swapped).otherwise(digits), 16, 10).cast("int")
    return F.when(flags.bitwiseAND(0x20) != 0, value).otherwise(0)


def is_hex_text(text: Column) -> Column:
    """Hex digits in pairs, with ASCII white space allowed between pairs; even in length."""
    blank = r"[ \t\n\x0B\f\r]"
    # Possessive, so that long runs neither recurse nor backtrack.
    odd_run = rf"(?:^|{blank})[0-9A-Fa-f](?:[0-9A-Fa-f]{{2}})*+(?:{blank}|$)"
    other = r"[^0-9A-Fa-f \t\n\x0B\f\r]"
    even = F.length(text) % 2 == 0
    # Digits alone are told by decoding them; the patterns are left to texts with white space, and to others up to their first other character.
    return F.when(F.unhex(text).isNotNull(), even).otherwise(even & ~text.rlike(other) & ~text.rlike(odd_run))


def is_binary_text(text: Column) -> Column:
    """Text with a character outside printable ASCII."""
    wide = F.octet_length(text) != F.length(text)
    return F.when(F.unhex(text).isNotNull(), F.lit(False)).otherwise(wide | text.rlike(r"[^\x20-\x7E]"))


class Reader:
    """Reads one WKB value; any malformed byte raises ValueError."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def geometry(self, expected: int | None = None) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Primitives as (POINT | LINE | POLYGON, coordinate arrays); a polygon lists its rings."""
        order, kind, width = self.header(expected)
        if kind == POINT:
            yield POINT, [self._coords(order, 1, width)]
        elif kind == LINE:
            line = self._coords(order, self._count(order), width)
            if len(line) == 1:
                raise ValueError("line of one point")
            yield LINE, [line]
        elif kind == POLYGON:
            yield POLYGON, [self._ring(order, width) for _ in range(self._count(order))]
        else:
            for _ in range(self._count(order)):
                yield from self.geometry(MEMBER_TYPE.get(kind))

    def header(self, expected: int | None = None) -> tuple[str, int, int]:
        """(byte order, type, numbers a point) of the geometry that begins here."""
        # Geometry libraries read any mark but 0 as little-endian.
        order = ">" if self._take(1)[0] == 0 else "<"
        word = self._count(order)
        kind = (word & 0x1FFFFFFF) % 1000
        iso = (word & 0x1FFFFFFF) // 1000
        if kind not in TYPE_NAMES or iso > 3 or (expected is not None and kind != expected):
            raise ValueError("geometry type")
        if word & SRID_FLAG:
            self._take(4)
        return order, kind, 2 + bool(word & Z_FLAG or iso in (1, 3)) + bool(word & M_FLAG or iso in (2, 3))

    def _ring(self, order: str, width: int) -> np.ndarray:
        ring = self._coords(order, self._count(order), width)
        if len(ring) and (len(ring) < 3 or not np.array_equal(ring[0], ring[-1])):
            raise ValueError("ring is not closed")
        return ring

    def _take(self, size: int) -> bytes:
        taken = self.data[self.at : self.at + size]
        if len(taken) < size:
            raise ValueError("truncated")
        self.at += size
        return taken

    def _count(self, order: str) -> int:
        return struct.unpack(order + "I", self._take(4))[0]

    def _coords(self, order: str, count: int, width: int) -> np.ndarray:
        raw = np.frombuffer(self._take(count * width * 8), dtype=order + "f8")
        return raw.reshape(count, width)[:, :2].astype("f8")


def is_valid(value: object) -> bool:
    """Whether bytes or hex text parse as WKB. Other types are a caller's mistake."""
    if isinstance(value, str):
        try:
            value = bytes.fromhex(value) if not any(c.isspace() for c in value) else b""
        except ValueError:
            return False
    elif not isinstance(value, (bytes, bytearray, memoryview)):
        raise TypeError(f"Expected bytes or string, got {type(value).__name__}")
    try:
        for _ in Reader(bytes(value)).geometry():
            pass
    except (ValueError, RecursionError):
        return False
    return True


@F.arrow_udf(BooleanType())
def wkb_valid(values: pa.Array) -> pa.Array:
    """Whether each value (binary, or hex text) is WKB; null for null."""
    text = pa.types.is_string(values.type) or pa.types.is_large_string(values.type)
    if not text and not pa.types.is_binary(values.type) and not pa.types.is_large_binary(values.type):
        raise TypeError(f"Expected bytes or string, got {values.type}")
    found, unknown = np.zeros(len(values), dtype=bool), np.asarray(values.is_null())
    known, kept = np.flatnonzero(~unknown), values.drop_null()
    if text and len(kept):
        hexed, kept = _unhexed(kept)
        known = known[hexed]
    if len(kept):
        found[known] = _valid(kept)
    return pa.array(found, mask=unknown)


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of an array of binary or text values without nulls."""
    wide = pa.types.is_large_binary(values.type) or pa.types.is_large_string(values.type)
    held, data = values.buffers()[1:]
    offsets = np.frombuffer(held, "i8" if wide else "i4", len(values) + 1, values.offset * (8 if wide else 4)).astype("i8")
    return np.frombuffer(data if data is not None and data.size else b"", "u1"), offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary values from their bytes; beyond 2 GB as large ones."""
    kind, width = (pa.binary(), "i4") if offsets[-1] < 1 << 31 else (pa.large_binary(), "i8")
    buffers = [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(kind, len(offsets) - 1, buffers)


def _unhexed(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(rows, bytes) of the texts that are hex digits in pairs and nothing else."""
    data, offsets = _bytes(texts)
    sizes = np.diff(offsets)
    # Digits other than hexadecimal ones before each place.
    others = np.r_[0, np.cumsum(_NIBBLE[data[offsets[0] : offsets[-1]]] > 15)]
    good = (others[offsets[1:] - offsets[0]] == others[offsets[:-1] - offsets[0]]) & (sizes % 2 == 0)
    if not good.any():
        return np.zeros(0, dtype=int), pa.array([], pa.binary())
    if not good.all():
        data, offsets = _bytes(texts.filter(pa.array(good)))
    digits = _NIBBLE[data[offsets[0] : offsets[-1]]]
    return np.flatnonzero(good), _binary(digits[::2] << 4 | digits[1::2], (offsets - offsets[0]) // 2)


def _valid(values: pa.Array) -> np.ndarray:
    """Whether binary values without nulls are WKB. Values of one size and header are judged together."""
    data, offsets = _bytes(values)
    sizes, found = np.diff(offsets), np.zeros(len(values), dtype=bool)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size < 5:
            continue
        head = min(int(size), _HEADER)
        heads = data[offsets[at][:, None] + np.arange(head)]
        # What lies behind the header does not tell values apart.
        heads[np.arange(head) >= _header_sizes(heads)[:, None]] = 0
        _, first, alike = np.unique(heads.view(f"V{head}").ravel(), return_index=True, return_inverse=True)
        order = np.argsort(alike, kind="stable")
        for one, rows in zip(first, np.split(at[order], np.cumsum(np.bincount(alike))[:-1])):
            verdict = _header_verdict(heads[one].tobytes(), int(size))
            if isinstance(verdict, bool):
                found[rows] = verdict
            elif verdict is None:
                for i in rows:
                    found[i] = is_valid(data[offsets[i] : offsets[i + 1]].tobytes())
            else:
                # A ring closes where its first point is its last one.
                start, end, kind = verdict
                raw = data[offsets[rows][:, None] + np.r_[start : start + 16, end : end + 16]].view(kind)
                found[rows] = (raw[:, :2] == raw[:, 2:]).all(axis=1)
    return found


def _header_sizes(heads: np.ndarray) -> np.ndarray:
    """Bytes of the headers, up to the counts of rings and points."""
    word = np.where(heads[:, :1] == 0, heads[:, 4:0:-1], heads[:, 1:5]).astype("u4") @ np.array([1, 1 << 8, 1 << 16, 1 << 24], dtype="u4")
    kind = (word & 0x1FFFFFFF) % 1000
    return 5 + 4 * ((word & SRID_FLAG) != 0) + 4 * (kind == LINE) + 8 * (kind == POLYGON)


def _header_verdict(head: bytes, size: int) -> bool | tuple[int, int, str] | None:
    """What a header says of all values of ``size`` bytes with it.

    True or False where that decides; (place of the first point, of the last one, number type) for a polygon of one ring,
    valid if it is closed; None where the value must be read, as those with members or several rings.
    """
    reader = Reader(head)
    try:
        order, kind, width = reader.header()
        if kind > POLYGON:
            return None
        rings = reader._count(order) if kind == POLYGON else 1
        if rings != 1:
            return None if rings else True
        points = 1 if kind == POINT else reader._count(order)
    except ValueError:
        return False
    start, step = reader.at, width * 8
    if start + points * step > size or (kind == LINE and points == 1):
        return False
    if kind != POLYGON or not points:
        return True
    return (start, start + (points - 1) * step, order + "f8") if points > 2 else False


def _rows(packed: np.ndarray) -> pa.Array:
    """Binary values from the rows of a matrix of bytes."""
    return _binary(packed.ravel(), np.arange(len(packed) + 1, dtype="i8") * packed.shape[1])


def _packed(header: bytes, corners: list[pa.Array]) -> pa.Array:
    """Values of one header, each followed by its coordinates; a null coordinate is no number."""
    coords = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype="<f8") for c in corners], axis=1)
    packed = np.empty((len(coords), len(header) + 8 * coords.shape[1]), dtype="u1")
    packed[:, : len(header)] = np.frombuffer(header, dtype="u1")
    packed[:, len(header) :] = coords.view("u1").reshape(len(coords), 8 * coords.shape[1])
    return _rows(packed)


@F.arrow_udf(BinaryType())
def rectangle_wkb(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    """Rectangle polygons from their corners."""
    return _packed(struct.pack("<BIII", 1, POLYGON, 1, 5), [x0, y0, x1, y0, x1, y1, x0, y1, x0, y0])


@F.arrow_udf(BinaryType())
def line_wkb(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    """Straight lines from their end points."""
    return _packed(struct.pack("<BII", 1, LINE, 2), [x0, y0, x1, y1])


def _number(value: float) -> str:
    return repr(int(value)) if float(value).is_integer() and abs(value) < 1e15 else repr(float(value))


def _points_text(coords: np.ndarray) -> str:
    return ", ".join(f"{_number(x)} {_number(y)}" for x, y in coords)


def to_text(data: bytes) -> str:
    """Well-known text of a WKB value, with the primitives of its type."""
    return _text(Reader(data))


def _text(reader: Reader) -> str:
    kind = _peek_type(reader)
    name = TYPE_NAMES[kind].upper()
    if kind == COLLECTION:
        members = [_text(reader) for _ in range(_enter(reader))]
        return f"{name} ({', '.join(members)})" if members else f"{name} EMPTY"
    parts = [arrays for _, arrays in reader.geometry()]
    if kind == POINT:
        return f"{name} EMPTY" if np.isnan(parts[0][0]).any() else f"{name} ({_points_text(parts[0][0])})"
    if kind == LINE:
        return f"{name} ({_points_text(parts[0][0])})" if len(parts[0][0]) else f"{name} EMPTY"
    if not parts or (kind == POLYGON and not parts[0]):
        return f"{name} EMPTY"
    if kind == POLYGON:
        return f"{name} ({', '.join(f'({_points_text(r)})' for r in parts[0])})"
    if kind == MULTIPOLYGON:
        bodies = [f"({', '.join(f'({_points_text(r)})' for r in rings)})" for rings in parts]
    else:
        bodies = [f"({_points_text(arrays[0])})" for arrays in parts]
    return f"{name} ({', '.join(bodies)})"


def _peek_type(reader: Reader) -> int:
    order = ">" if reader.data[reader.at] == 0 else "<"
    word = struct.unpack_from(order + "I", reader.data, reader.at + 1)[0]
    return (word & 0x1FFFFFFF) % 1000


def _enter(reader: Reader) -> int:
    """Step over a collection's header; returns its member count."""
    order = ">" if reader._take(1)[0] == 0 else "<"
    if reader._count(order) & SRID_FLAG:
        reader._take(4)
    return reader._count(order)


@F.pandas_udf(StringType())
def wkb_text(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else to_text(v))


def geojson(data: bytes) -> dict:
    """GeoJSON geometry object of a WKB value."""
    return _geojson(Reader(data))


def _geojson(reader: Reader) -> dict:
    kind = _peek_type(reader)
    name = TYPE_NAMES[kind]
    if kind == COLLECTION:
        return {"type": name, "geometries": [_geojson(reader) for _ in range(_enter(reader))]}
    parts = [[a.tolist() for a in arrays] for _, arrays in reader.geometry()]
    if kind == POINT:
        point = parts[0][0][0]
        return {"type": name, "coordinates": [] if point[0] != point[0] else point}
    if kind == LINE:
        return {"type": name, "coordinates": parts[0][0]}
    if kind == POLYGON:
        return {"type": name, "coordinates": parts[0]}
    if kind == MULTIPOINT:
        return {"type": name, "coordinates": [p[0][0] for p in parts]}
    if kind == MULTILINE:
        return {"type": name, "coordinates": [p[0] for p in parts]}
    return {"type": name, "coordinates": parts}


def signed_area(ring: np.ndarray) -> float:
    """Area by the shoelace rule, positive when counter-clockwise."""
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float(np.sum(x[:-1] * y[1:] - x[1:] * y[:-1]) / 2)


@F.pandas_udf(DoubleType())
def wkb_area(values: pd.Series) -> pd.Series:
    def area(data: bytes) -> float:
        total = 0.0
        for kind, arrays in Reader(data).geometry():
            if kind == POLYGON:
                rings = [abs(signed_area(r)) if len(r) else 0.0 for r in arrays]
                total += sum(rings[:1]) - sum(rings[1:])
        return total

    # Polygons of one ring are summed together, the others read one by one.
    listed, found = values.tolist(), [None] * len(values)
    binary = [i for i, v in enumerate(listed) if v is not None]
    for at, rings in _simple_polygons([listed[i] for i in binary]):
        x, y = rings[..., 0] - rings[:, :1, 0], rings[..., 1] - rings[:, :1, 1]
        for i, size in zip(at, np.abs(np.sum(x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1], axis=1) / 2).tolist()):
            found[binary[i]] = size
    for i in binary:
        if found[i] is None:
            found[i] = area(listed[i])
    return pd.Series(found, dtype="Float64")


@F.pandas_udf(DoubleType())
def wkb_length(values: pd.Series) -> pd.Series:
    """Length of the lines of each value."""

    def length(data: bytes) -> float:
        lines = [arrays[0] for kind, arrays in Reader(data).geometry() if kind == LINE]
        return float(sum(np.hypot(*np.diff(line, axis=0).T).sum() for line in lines if len(line)))

    return values.map(lambda v: None if v is None else length(v)).astype("Float64")


def extent(data: bytes) -> tuple[float, float, float, float] | None:
    """(min x, max x, min y, max y), None for an empty geometry."""
    coords = [a for _, arrays in Reader(data).geometry() for a in arrays if len(a)]
    if not coords:
        return None
    xy = np.concatenate(coords)
    xy = xy[~np.isnan(xy).any(axis=1)]
    if not len(xy):
        return None
    return float(xy[:, 0].min()), float(xy[:, 0].max()), float(xy[:, 1].min()), float(xy[:, 1].max())


def _simple_polygons(values: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, rings) of the little-endian polygons of one closed ring, by size; decoded together."""
    sizes = np.array([len(v) for v in values])
    for size in np.unique(sizes[sizes >= 13 + 4 * 16]):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(values[i] for i in at), dtype="u1").reshape(len(at), size)
        header = raw[:, 1:13].copy().view("<u4")
        plain = (raw[:, 0] == 1) & (header[:, 0] == POLYGON) & (header[:, 1] == 1) & (header[:, 2] * 16 + 13 == size)
        if plain.any():
            at, rings = at[plain], raw[plain, 13:].copy().view("<f8").reshape(int(plain.sum()), -1, 2)
            closed = (rings[:, 0] == rings[:, -1]).all(axis=1)
            yield at[closed], rings[closed]


def segments(values: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, dimension, x1 y1 x2 y2) of all segments of a batch of WKB values.

    Polygon segments run with the interior on their left. A point is a segment of no
    length and dimension 0.
    """
    rows, dims, coords = [], [], []
    alike = np.zeros(len(values), dtype=bool)
    for at, rings in _simple_polygons(values):
        alike[at] = True
        x, y = rings[..., 0] - rings[:, :1, 0], rings[..., 1] - rings[:, :1, 1]
        clockwise = np.sum(x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1], axis=1) < 0
        rings[clockwise] = rings[clockwise, ::-1]
        pairs = np.concatenate([rings[:, :-1], rings[:, 1:]], axis=2)
        rows.append(np.repeat(at, pairs.shape[1]))
        dims.append(np.full(pairs.shape[0] * pairs.shape[1], 2))
        coords.append(pairs.reshape(-1, 4))
    for i in np.flatnonzero(~alike):
        for kind, arrays in Reader(values[i]).geometry():
            for place, line in enumerate(arrays):
                if not len(line) or np.isnan(line).any():
                    continue
                if kind == POLYGON and (signed_area(line) > 0) == (place > 0):
                    line = line[::-1]
                pairs = np.hstack([line, line]) if kind == POINT else np.hstack([line[:-1], line[1:]])
                rows.append(np.full(len(pairs), i))
                dims.append(np.full(len(pairs), kind - 1))
                coords.append(pairs)
    if not rows:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, 4))
    row, dim, xy = np.concatenate(rows), np.concatenate(dims), np.concatenate(coords)
    keep = (dim == 0) | (xy[:, :2] != xy[:, 2:]).any(axis=1)
    return row[keep], dim[keep], xy[keep]
