"""Ships this package to the executors, for sessions that were started without it on their path."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's sources as a ``--py-files`` archive, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(os.path.join(root, "parley")):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, root))
    path = os.path.join(tempfile.mkdtemp(prefix="parley-py-"), "parley.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    _shipped.add(context.applicationId)
