"""Makes the package known to the Python workers of a session."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once for each application, as a zip that Spark distributes."""
    context = spark.sparkContext
    if getattr(context, "_offerscope_shipped", False):
        return
    root = Path(__file__).resolve().parent
    name = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "offerscope_modules.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    context.addPyFile(str(name))
    context._offerscope_shipped = True
