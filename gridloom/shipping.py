"""Makes the package importable in Python workers that do not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's files, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_gridloom_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(home):
        archive = os.path.join(tempfile.mkdtemp(prefix="gridloom-"), "gridloom_sources.zip")
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(home):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(home)))
        context.addPyFile(archive)
    context._gridloom_shipped = True
