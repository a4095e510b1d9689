"""Bring this package to the Python workers of a session, wherever it was imported from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to all executors, once per application. Workers then import it whatever their
    working directory and paths are; where it is installed on every machine this is not needed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        parent, name = os.path.split(package)
        folder = tempfile.mkdtemp(prefix=f"{name}-")
        path = os.path.join(folder, f"{name}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for at, _, files in os.walk(package):
                for file in files:
                    if file.endswith(".py"):
                        full = os.path.join(at, file)
                        out.write(full, os.path.relpath(full, parent))
        sc.addPyFile(path)  # the driver serves its own file
        _SHIPPED.add(sc.applicationId)
    return spark
