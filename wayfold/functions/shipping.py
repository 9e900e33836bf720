"""Gives this package to the executors' Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the application, once."""
    sc = spark.sparkContext
    if getattr(sc, "_wayfold_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(), "wayfold_pkg.zip")
    Path(path).write_bytes(buf.getvalue())
    sc.addPyFile(path)
    sc._wayfold_shipped = True
