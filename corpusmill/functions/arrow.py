"""Arrow batch functions on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="corpusmill-zip-")
    atexit.register(shutil.rmtree, folder, True)
    name = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package importable in the Python workers."""
    ship(df.sparkSession)
    return df.mapInArrow(fn, schema)
