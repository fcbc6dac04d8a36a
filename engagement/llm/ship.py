"""Makes this package importable in Spark's Python workers."""

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import engagement

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors once for each application.

    Spark serves the archive from the driver, so nothing has to be installed beside the
    libraries themselves.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(engagement.__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="engagement-"), "engagement_sources.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for path in sorted(top.rglob("*.py")):
            packed.write(path, path.relative_to(top.parent))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
