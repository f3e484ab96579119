"""This package on the executors, so that Python functions sent there can import it."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows go to Python in batches of so many bytes, so that long texts don't make large ones.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's modules to every executor, once for each application, and bounds the batches sent to Python."""
    context = spark.sparkContext
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(_BYTES))
    if now and int(now[1]) > BATCH_BYTES:
        spark.conf.set(_BYTES, str(BATCH_BYTES))
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    path = os.path.join(tempfile.mkdtemp(prefix="rillstone-"), "rillstone.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, Path(root.name) / module.relative_to(root))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
