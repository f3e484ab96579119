"""Tables read from Parquet, and events in the shape that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.ranking import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parsed_events(events: DataFrame) -> DataFrame:
    """event_id, ts (timestamp), user_id, event_type, value, item."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").try_cast("int").alias("item"),
    )


def sequenced(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Parsed events with `seq`, their number from 1 in the order of (ts, event_id)."""
    return numbered(parsed_events(events), F.unix_micros("ts"), ["ts", "event_id"], "seq", bins=partitions)
