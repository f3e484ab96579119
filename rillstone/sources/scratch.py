"""The folder that driver and executors share, and tables and dumps written there or elsewhere."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where it is unset, a folder of this machine, in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own()


@lru_cache(1)
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='rillstone-')}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/rillstone-{uuid.uuid4().hex}/{name}"


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON object a line, in UTF-8, by all executors; sets are arrays."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)
