"""GeoPackage writer as a Spark data source: each task writes one file, the commit publishes them."""

from __future__ import annotations

import datetime
import sqlite3
import struct
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path, PurePosixPath

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from terrane.functions.wkb import extent

NAME = "terrane_gpkg"

# Fixed values of the GeoPackage format: file marks, reference systems and system tables.
APPLICATION_ID, USER_VERSION = 0x47504B47, 10300
WGS84 = (
    'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],'
    'UNIT["degree",0.0174532925199433],AUTHORITY["EPSG","4326"]]'
)
REFERENCE_SYSTEMS = [
    ("Undefined cartesian SRS", -1, "NONE", -1, "undefined", None),
    ("Undefined geographic SRS", 0, "NONE", 0, "undefined", None),
    ("WGS 84 geodetic", 4326, "EPSG", 4326, WGS84, None),
]
SYSTEM_TABLES = """
create table gpkg_spatial_ref_sys (srs_name text not null, srs_id integer not null primary key,
  organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
create table gpkg_contents (table_name text not null primary key, data_type text not null, identifier text unique,
  description text default '', last_change datetime not null, min_x double, min_y double, max_x double, max_y double,
  srs_id integer references gpkg_spatial_ref_sys(srs_id));
create table gpkg_geometry_columns (table_name text not null references gpkg_contents(table_name),
  column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null,
  m tinyint not null, primary key (table_name, column_name));
"""
COLUMN_TYPES = {
    T.LongType: "INTEGER",
    T.IntegerType: "MEDIUMINT",
    T.ShortType: "SMALLINT",
    T.ByteType: "TINYINT",
    T.BooleanType: "BOOLEAN",
    T.DoubleType: "DOUBLE",
    T.FloatType: "FLOAT",
    T.StringType: "TEXT",
    T.BinaryType: "BLOB",
    T.DateType: "DATE",
    T.TimestampType: "DATETIME",
    T.TimestampNTZType: "DATETIME",
}
WRITE_BUFFER = 1 << 24


def geometry_blob(wkb: bytes, srid: int, box: tuple[float, float, float, float] | None) -> bytes:
    """GeoPackage geometry: header with SRID and envelope, then the WKB."""
    if box is None:
        return b"GP" + struct.pack("<BBi", 0, 0b10001, srid) + wkb
    return b"GP" + struct.pack("<BBi4d", 0, 0b00011, srid, *box) + wkb


@dataclass
class Written(WriterCommitMessage):
    """One file a task has finished, relative to the staging directory."""

    name: str
    rows: int


def _sql_name(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _stored(value: object) -> object:
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


class GeoPackageWriter(DataSourceArrowWriter):
    """Tasks fill a local SQLite file, as SQLite needs one, and move it to the target's staging directory."""

    def __init__(self, schema: T.StructType, options: dict[str, str], overwrite: bool) -> None:
        self.schema, self.overwrite = schema, overwrite
        self.path = options["path"]
        self.single = options.get("single_file", "false") == "true"
        self.layer = options.get("layer", "features")
        self.geometry = options.get("geometry_column", "geom")
        self.srid = int(options.get("srid", "4326"))
        self.job = uuid.uuid4().hex[:12]

    def _target(self) -> tuple[fs.FileSystem, str]:
        where = self.path if "://" in self.path or self.path.startswith("file:") else str(Path(self.path).absolute())
        if where.startswith("file:"):
            where = "/" + where.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(where) if "://" in where else (fs.LocalFileSystem(), where)

    def _staging(self, root: str) -> str:
        base = PurePosixPath(root)
        return str(base.parent / f".{base.name}-{self.job}" if self.single else base / f"_staged-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name = f"{uuid.uuid4().hex}.gpkg"
        with tempfile.TemporaryDirectory(prefix="gpkg-") as local:
            file = Path(local) / name
            rows = self._fill(file, iterator)
            # Only the first partition leaves an empty file, so that an empty table still has its schema.
            if not rows and TaskContext.get().partitionId() != 0:
                return Written("", 0)
            system, root = self._target()
            staging = self._staging(root)
            system.create_dir(staging, recursive=True)
            fs.copy_files(str(file), f"{staging}/{name}", fs.LocalFileSystem(), system, chunk_size=WRITE_BUFFER)
        return Written(name, rows)

    def _fill(self, file: Path, batches: Iterator[pa.RecordBatch]) -> int:
        fields = list(self.schema.fields)
        place = next(i for i, f in enumerate(fields) if f.name == self.geometry)
        names = {f.name.lower() for f in fields}
        key = next(k for k in ("fid", "ogc_fid", "gpkg_fid") if k not in names)
        columns = [
            f"{_sql_name(f.name)} {'GEOMETRY' if i == place else COLUMN_TYPES[type(f.dataType)]}"
            for i, f in enumerate(fields)
        ]
        db = sqlite3.connect(file, isolation_level=None)
        db.execute("pragma journal_mode = off")
        db.execute("pragma synchronous = off")
        db.execute(f"pragma application_id = {APPLICATION_ID}")
        db.execute(f"pragma user_version = {USER_VERSION}")
        db.executescript(SYSTEM_TABLES)
        db.executemany("insert into gpkg_spatial_ref_sys values (?, ?, ?, ?, ?, ?)", self._reference_systems())
        db.execute(
            f"create table {_sql_name(self.layer)} ({key} integer primary key autoincrement not null, {', '.join(columns)})"
        )
        insert = (
            f"insert into {_sql_name(self.layer)} ({', '.join(_sql_name(f.name) for f in fields)}) "
            f"values ({', '.join('?' * len(fields))})"
        )
        rows, bounds = 0, None
        db.execute("begin")
        for batch in batches:
            values = [column.to_pylist() for column in batch.columns]
            boxes = [None if g is None else extent(g) for g in values[place]]
            values[place] = [
                None if g is None else geometry_blob(g, self.srid, box) for g, box in zip(values[place], boxes)
            ]
            for i, f in enumerate(fields):
                if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
                    values[i] = [_stored(v) for v in values[i]]
            db.executemany(insert, zip(*values))
            rows += batch.num_rows
            known = [b for b in boxes if b is not None]
            if known:
                low_x, high_x, low_y, high_y = zip(*([bounds] if bounds else []), *known)
                bounds = (min(low_x), max(high_x), min(low_y), max(high_y))
        box = (bounds[0], bounds[2], bounds[1], bounds[3]) if bounds else (None,) * 4
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        db.execute(
            "insert into gpkg_contents values (?, 'features', ?, '', ?, ?, ?, ?, ?, ?)",
            (self.layer, self.layer, now, *box, self.srid),
        )
        db.execute(
            "insert into gpkg_geometry_columns values (?, ?, 'GEOMETRY', ?, 0, 0)", (self.layer, self.geometry, self.srid)
        )
        db.execute("commit")
        db.close()
        return rows

    def _reference_systems(self) -> list[tuple]:
        known = {r[1] for r in REFERENCE_SYSTEMS}
        if self.srid in known:
            return REFERENCE_SYSTEMS
        return [*REFERENCE_SYSTEMS, (f"EPSG:{self.srid}", self.srid, "EPSG", self.srid, "undefined", None)]

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Publish the files of the tasks that succeeded; files of lost attempts go with the staging directory."""
        system, root = self._target()
        staging = self._staging(root)
        done = [m for m in messages if m is not None and m.name]
        if self.single:
            if len(done) != 1:
                raise ValueError(f"A single file needs one partition, got {len(done)}.")
            if system.get_file_info(root).type == fs.FileType.File:
                system.delete_file(root)
            system.move(f"{staging}/{done[0].name}", root)
        else:
            old = []
            if self.overwrite:
                listed = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
                old = [i.path for i in listed if i.base_name.startswith("part-") and i.extension == "gpkg"]
            for i, message in enumerate(done):
                system.move(f"{staging}/{message.name}", f"{root}/part-{i:05d}-{self.job}.gpkg")
            for path in old:
                system.delete_file(path)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = self._target()
        staging = self._staging(root)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class GeoPackageSource(DataSource):
    """``df.write.format("terrane_gpkg")``; the geometry column holds WKB."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: T.StructType, overwrite: bool) -> GeoPackageWriter:
        unsupported = [f.name for f in schema.fields if type(f.dataType) not in COLUMN_TYPES]
        if unsupported:
            raise ValueError(f"Column types a GeoPackage cannot hold: {', '.join(unsupported)}")
        return GeoPackageWriter(schema, dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GeoPackageSource)


def read_rows(file: str, layer: str = "features") -> list[dict]:
    """Rows of one written file with the geometry back as WKB, for checks."""
    db = sqlite3.connect(file)
    db.row_factory = sqlite3.Row
    column = db.execute("select column_name from gpkg_geometry_columns").fetchone()[0]
    rows = [dict(r) for r in db.execute(f"select * from {_sql_name(layer)}")]
    for row in rows:
        if row[column] is not None:
            row[column] = row[column][40 if row[column][3] & 0b1110 else 8 :]
    db.close()
    return rows
