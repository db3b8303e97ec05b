"""Making this package importable on executors."""

from __future__ import annotations

import tempfile
import zipfile
from functools import lru_cache
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = __name__.partition(".")[0]


@lru_cache(maxsize=1)
def _archive() -> str:
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix=f"{PACKAGE}-")) / f"{PACKAGE}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    return str(target)


def ship(spark: SparkSession) -> None:
    """Send the package once a session; operators that run Python call it."""
    context = spark.sparkContext
    if not any(path.endswith(f"{PACKAGE}.zip") for path in context.listFiles):
        context.addPyFile(_archive())
