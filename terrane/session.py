"""Making the package importable in Python workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ARCHIVE = "terrane.zip"
#: Rows go to Python workers in batches of about so many bytes: Spark and the worker each hold a batch of texts more than once.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def _bytes(setting: str) -> int:
    """A size as Spark reads it, like 4194304, 64m or 256MB."""
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)i?b?", setting.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per application, and bound the batches that its workers get.

    Does what ``spark-submit --py-files`` does, for sessions that were started without it. A session that asks for smaller
    batches keeps them.
    """
    if _bytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    context = spark.sparkContext
    if any(ARCHIVE in name for name in context.listFiles):
        return spark
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="terrane-")) / ARCHIVE
    with zipfile.ZipFile(archive, "w") as packed:
        for module in sorted(root.rglob("*.py")):
            packed.write(module, Path(root.name) / module.relative_to(root))
    context.addPyFile(str(archive))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the folder that ``spark.checkpoint.dir`` names; one is set only where there is none, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return f"{context.getCheckpointDir()}/{uuid.uuid4().hex}"
