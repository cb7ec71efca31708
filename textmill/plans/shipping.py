"""Makes the package importable on the executors, wherever the driver was started."""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's modules to the session's files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    files = sorted(p for p in (root / "textmill").rglob("*.py"))
    name = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:12]
    path = Path(tempfile.mkdtemp(prefix="textmill-ship-")) / f"textmill-{name}.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for p in files:
            archive.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
