"""Sending this package's Python code to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import tabscout

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes the package importable in Python workers, as ``--py-files`` would; once per application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    top = Path(tabscout.__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tabscout-")) / "tabscout.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(top.rglob("*.py")):
            archive.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    _SENT.add(context.applicationId)
