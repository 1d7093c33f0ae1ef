"""Makes this package importable in the Python workers of a session."""

from __future__ import annotations

import importlib.util
import os
import zipfile

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once per application.

    Spark serves the archive from the folder it keeps for such files; a job
    started with the package in ``--py-files`` is unaffected.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = os.path.dirname(importlib.util.find_spec("monthloom").origin)
    folder = os.path.join(SparkFiles.getRootDirectory(), "package")
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, "monthloom.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for top, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    out.write(path, os.path.join("monthloom", os.path.relpath(path, package)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(application)
