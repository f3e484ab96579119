"""The operators on Structured Streaming: windows, dedup and caches with bounded state."""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.operators.ranking import core_priority
from rillstone.operators.running import dedup_key
from rillstone.sources.packaging import ship
from rillstone.sources.scratch import fresh_path
from rillstone.sources.tables import parsed_events


def source(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """Parsed events as a stream of the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # the table may be a folder of files, or one file, which a stream can only name by a pattern
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true")
    return parsed_events(found.parquet(f"{sf_dir}/events.parque[t]"))


def hourly_counts(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events of each type in each hour; state of hours that the watermark has passed is dropped."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", F.col("window.start").alias("hour"), "n")


def deduplicated(events: DataFrame, bucket: int = 60, delay: str = "10 minutes") -> DataFrame:
    """Events without repeats of (user, item, bucket of time); a key is kept as long as the watermark asks."""
    keyed = events.withColumn("token", dedup_key(F.col("user_id"), F.col("item"), F.col("ts"), bucket))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["token"])


def served_in_order(events: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes each micro-batch in the order in which its events are to be served."""
    ranked = events.withColumn("priority", core_priority(F.when(F.col("event_type") == "purchase", "payment").otherwise(F.col("event_type")), F.col("user_id") % 3 == 0))

    def serve(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).repartitionByRange("priority", "ts", "event_id").sortWithinPartitions("priority", "ts", "event_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return ranked.writeStream.foreachBatch(serve).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame, mode: str | None = None) -> DataFrame:
    """What a stream gives when its source is read to the end, as a table in the shared folder.

    Aggregates are written as a whole at each micro-batch, other streams by appending.
    """
    spark = stream.sparkSession
    path, marks = fresh_path(spark, "stream"), fresh_path(spark, "marks")
    whole = mode == "complete" or mode is None and "Aggregate" in stream._jdf.queryExecution().analyzed().toString()
    writer = stream.writeStream.option("checkpointLocation", marks).trigger(availableNow=True)
    if whole:
        query = writer.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    else:
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(path)


def cache_stream(trace: DataFrame, capacity: int, shard: str = "shard") -> DataFrame:
    """(seq, item, hit) of a stream (seq, item, shard): a cache for each shard, its keys in order as state.

    A micro-batch is taken in the order of seq; micro-batches must come in that order.
    """
    if capacity <= 0:
        raise ValueError("capacity is positive")
    ship(trace.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = OrderedDict.fromkeys(json.loads(state.get[0]) if state.exists else [])
        rows = pd.concat(list(batches)).sort_values("seq")
        hit = []
        for item in rows["item"].tolist():
            hit.append(item in held)
            if hit[-1]:
                held.move_to_end(item)
            else:
                if len(held) >= capacity:
                    held.popitem(last=False)
                held[item] = None
        state.update((json.dumps(list(held)),))
        yield pd.DataFrame({"seq": rows["seq"].to_numpy(), "item": rows["item"].to_numpy(), "hit": hit})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return trace.groupBy(shard).applyInPandasWithState(run, "seq long, item int, hit boolean", "keys string", "append", GroupStateTimeout.NoTimeout)


def cache_hits(trace: DataFrame, capacity: int, parts: int = 3) -> DataFrame:
    """A bounded trace (seq, item) fed to `cache_stream` in `parts` micro-batches, in order."""
    spark = trace.sparkSession
    path = fresh_path(spark, "trace")
    rows = trace.select("seq", F.col("item").cast("int").alias("item"), F.lit(0).alias("shard"))
    low, high = rows.agg(F.coalesce(F.min("seq"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
    part = F.least(F.floor((F.col("seq") - low) * parts / F.lit(high - low + 1)), F.lit(parts - 1))
    for i in range(parts):  # files are read in the order of their times
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return finished(cache_stream(stream, capacity))
