"""The package for the Python workers of any session, wherever the driver runs and whenever its session was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[tuple[int, str]] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; their Python workers find it in front of their path.

    A worker that is started on any machine later gets it too, as Spark fetches the archive from the driver. The archive holds the package's Python files only.
    """
    sc = spark.sparkContext
    if (os.getpid(), sc.applicationId) in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tenderlake-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add((os.getpid(), sc.applicationId))
