"""Sends this package to the executors' Python, which needs it for the functions that run inside tasks."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application; the driver serves the archive, so no folder has to be shared."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="spark-ship-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SENT.add(context.applicationId)
