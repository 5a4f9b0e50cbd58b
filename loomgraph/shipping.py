"""Make the library importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once an application, unless their path has it."""
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    on_path = any(p and Path(p).resolve() == root.parent for p in os.environ.get("PYTHONPATH", "").split(os.pathsep))
    if app not in _SHIPPED and not on_path:
        target = Path(tempfile.mkdtemp(prefix="loomgraph-ship-")) / "loomgraph.zip"
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(p.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
    return spark
