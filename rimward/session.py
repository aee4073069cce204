"""Getting the package to the executors, and a bound on the rows that Python workers are sent at once."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of a batch where the session doesn't say: whole texts are long, and a batch lies in the JVM and in a worker.
BATCH_ROWS = 2_000


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; their Python workers import functions from it.

    A session that doesn't set the rows of an Arrow batch gets ``BATCH_ROWS``.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="rimward-")) / "rimward.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
