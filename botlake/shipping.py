"""Makes this package importable on Spark's Python workers, and their batches small."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()
#: Rows of an Arrow batch at most: a worker holds the texts of a batch several times over (Arrow, pandas, results), whatever the table's size.
BATCH_ROWS, BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"
#: And its bytes at most (the row that passes them ends the batch): else a batch of long texts has as much as the session allows, by default 64 MB.
BATCH_BYTES, BYTES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_FIRST: dict[str, tuple[int, str]] = {}


def ship(spark: SparkSession) -> None:
    """Adds the package to the application's Python files once, unless the workers inherit its place."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    to = os.path.join(tempfile.mkdtemp(prefix="botlake-"), "botlake.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    path = list(sys.path)
    sc.addPyFile(to)
    sys.path[:] = path  # the driver keeps importing from the folder


def _bytes(size: str) -> int:
    """Bytes of a setting such as 64m or 67108864b."""
    n, unit = re.fullmatch(r"(-?\d+)([a-z]*)", size.strip().lower()).groups()
    return int(n) << {"k": 10, "m": 20, "g": 30}.get(unit[:1], 0)


def batch_rows(spark: SparkSession, most: int | None) -> None:
    """Batches of at most so many rows, and of BATCH_BYTES, for what the session runs from here on (None, or more than it had at first: as it had at first)."""
    first, size = _FIRST.setdefault(spark.sparkContext.applicationId, (int(spark.conf.get(BATCH)), spark.conf.get(BYTES)))
    small = first if most is None else most if first <= 0 else min(first, most)
    spark.conf.set(BATCH, str(small))
    spark.conf.set(BYTES, size if most is None or 0 < _bytes(size) <= BATCH_BYTES else f"{BATCH_BYTES}b")
