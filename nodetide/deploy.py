"""Makes this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends a zip of the package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        here = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="nodetide-")
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "nodetide.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(here.rglob("*.py")):
                z.write(f, str(f.relative_to(here.parent)))
        spark.sparkContext.addPyFile(path)
        _shipped.add(app)
    return spark
