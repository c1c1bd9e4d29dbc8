"""Sending this package's code to the executors."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Once for each application, so that Python workers import the package whatever their
    working directory is. Only the driver reads the file made here; Spark sends it on."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{_PACKAGE.name}/{p.relative_to(_PACKAGE).as_posix()}"), p.read_bytes())
    path = Path(tempfile.mkdtemp(prefix="graphspan-")).resolve() / "graphspan_code.zip"
    path.write_bytes(buf.getvalue())
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
