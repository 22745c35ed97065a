"""Sends this package to executors that cannot import it from where they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the Python path of the application's workers, once. The archive is
    served by Spark, so that executors need not see the driver's folders."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(here)
    path = os.path.join(tempfile.mkdtemp(prefix="murmurate-code-"), "murmurate_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    _sent.add(context.applicationId)
