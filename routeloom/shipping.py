"""Bring this package to Python workers on executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers; once for each Spark application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    files = sorted(
        os.path.join(d, f)
        for d, _, names in os.walk(os.path.join(root, "routeloom"))
        for f in names
        if f.endswith(".py")
    )
    digest = hashlib.sha256()
    for f in files:
        digest.update(open(f, "rb").read())
    path = os.path.join(tempfile.mkdtemp(), f"routeloom_{digest.hexdigest()[:12]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, os.path.relpath(f, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED[app] = path
