"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.sources.packaging import ship
from rillstone.sources.scratch import fresh_path

#: Stands for a null doc_id where an id is a key.
NULL_ID = -(2**63)


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """`df`, written once in the shared folder and read from there: it cuts lineage and outlives executors.

    With `tidy`, shuffle files of plans that nothing refers to any more are dropped now, for
    steps that move about as many bytes as the input has.  So they are, with the broadcast
    sides of such plans, after any step that leaves the driver's heap a third full, or grown past half of its limit.
    """
    spark = df.sparkSession
    ship(spark)
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if tidy or _filled(spark):
        _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes that the driver's heap took from the system after the last collection, by application.
_LEFT: dict[str, int] = {}


def _filled(spark: SparkSession) -> bool:
    """Whether a third of the driver's heap is in use, by what is garbage too, or it has taken more than half of its limit, and more than the last collection left."""
    heap = spark.sparkContext._jvm.Runtime.getRuntime()
    taken, most = heap.totalMemory(), heap.maxMemory()
    return 3 * (taken - heap.freeMemory()) > most or 2 * taken > most and taken > _LEFT.get(spark.sparkContext.applicationId, 0)


def _tidy(spark: SparkSession) -> None:
    """Spark drops a shuffle's files when the driver collects the plan as garbage, which may otherwise be much later; the heap also gives memory back."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _LEFT[spark.sparkContext.applicationId] = spark.sparkContext._jvm.Runtime.getRuntime().totalMemory()


def give_back() -> None:
    """A Python worker stays for later tasks, and other workers beside it: what it has freed goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_key(column: str = "doc_id") -> Column:
    """The id as a key that is never null."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: Iterable[str], name: str) -> str:
    """`name`, with underscores put before it until none of the columns has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """`left` joined with `right`, a small row for each key, where one key may hold a third of left's rows: each key is dealt to `salts` tasks."""
    own = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    return own.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "_salt"], how).drop("_salt")


def hot_join(pairs: DataFrame, sides: dict[str, DataFrame], block: int = 20_000, broadcast_keys: int = 1_000_000) -> DataFrame:
    """`pairs`, a written table of two keys, joined on each with its side, a row of any size for each key.

    A key of more than `block` pairs is dealt, by the other key, to as many tasks as it has
    blocks, and only such keys' sides are repeated.  Keys of so many rows are at most one in
    `block` rows; they are sent to all executors while they are few (checked), and joined otherwise.
    """
    out, many = pairs, pairs.count() > block
    for (key, side), other in zip(sides.items(), reversed(sides), strict=True):
        hot = None
        if many:
            counts = pairs.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > block)
            hot = written(counts.select(key, F.ceil(F.col("_n") / block).cast("int").alias("_parts")), "hot")
            number = hot.count()
            hot = None if not number else F.broadcast(hot) if number <= broadcast_keys else hot
        if hot is None:
            out = out.join(side, key)
            continue
        parts = F.coalesce(F.col("_parts"), F.lit(1))
        own = out.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), parts).cast("int")).drop("_parts")
        side = side.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        out = own.join(side, [key, "_salt"]).drop("_salt")
    return out
