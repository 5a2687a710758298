"""Makes the package importable on executors, whatever the folder the driver was started in."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's modules to the Python workers of this application, once."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="ship-")) / f"{_PACKAGE.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(_PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(_PACKAGE.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)
    return spark
