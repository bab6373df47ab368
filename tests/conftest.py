import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402

from terrane.session import ship  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield ship(session)
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


class Jts:
    """The geometry library on Spark's class path, called on the driver as a judge."""

    def __init__(self, spark):
        self.jvm = spark.sparkContext._jvm
        base = self.jvm.org.locationtech.jts
        self.reader = base.io.WKTReader()
        self.binary = base.io.WKBReader()
        self.writer = base.io.WKBWriter(2, 2)  # little-endian
        self.union_op = base.operation.union.UnaryUnionOp
        self.overlay = base.operation.overlayng.OverlayNGRobust

    def wkb(self, text):
        return bytes(self.writer.write(self.reader.read(text)))

    def read(self, data):
        return self.binary.read(bytearray(data))

    def valid_wkb(self, data):
        try:
            self.read(data)
        except Exception:
            return False
        return True

    def union(self, values):
        factory = self.jvm.org.locationtech.jts.geom.GeometryFactory()
        members = self.jvm.java.util.ArrayList()
        for v in values:
            members.add(self.read(v))
        return self.overlay.union(factory.buildGeometry(members))

    def of_dimension(self, geometry, dimension):
        """Parts of one dimension: an overlay takes no mixed input."""
        members = self.jvm.java.util.ArrayList()
        for i in range(geometry.getNumGeometries()):
            part = geometry.getGeometryN(i)
            if part.getDimension() == dimension and not part.isEmpty():
                members.add(part)
        return self.jvm.org.locationtech.jts.geom.GeometryFactory().buildGeometry(members)

    def same(self, ours, values):
        """Empty when our bytes are valid and the union of the values as a point set, else what is wrong."""
        mine, theirs = self.read(ours), self.union(values)
        if not mine.isValid():
            return f"invalid: {mine.toText()[:300]}"
        for dimension, size in ((0, "getNumPoints"), (1, "getLength"), (2, "getArea")):
            a, b = self.of_dimension(mine, dimension), self.of_dimension(theirs, dimension)
            if a.isEmpty() != b.isEmpty():
                return f"dimension {dimension}: {mine.toText()[:300]} <> {theirs.toText()[:300]}"
            gap = getattr(self.overlay.overlay(a, b, 4), size)() if not a.isEmpty() else 0
            if gap > 1e-9 * max(1.0, getattr(b, size)()):
                return f"dimension {dimension} by {gap}: {mine.toText()[:300]} <> {theirs.toText()[:300]}"
        return ""


@pytest.fixture(scope="session")
def jts(spark):
    return Jts(spark)
