"""Count-Min cells, Bloom bits and Misra-Gries counters as tables.

Cells add up and bits unite, so partial aggregates combine before every shuffle, and sketches of
parts merge by the same aggregate that builds them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.sources.packaging import ship
from rillstone.functions.hashing import bloom_size, row_seed, slot


def _check(width: int, depth: int) -> None:
    if width <= 0 or depth <= 0:
        raise ValueError("width and depth are positive")


def cms_slots(item: Column, width: int, depth: int, seeds: list[int] | None = None) -> Column:
    """An item's (row, col) in every row of the sketch; `seeds`, one a row, make another family of hashes."""
    _check(width, depth)
    seeds = seeds or [row_seed(r) for r in range(depth)]
    return F.array(*[F.struct(F.lit(r).alias("row"), slot(seed, item, width).alias("col")) for r, seed in enumerate(seeds[:depth])])


def cms_cells(updates: DataFrame, item: str, width: int = 1000, depth: int = 5, count: str | None = None, by: list[str] | None = None, seeds: list[int] | None = None) -> DataFrame:
    """(row, col, n) of the cells that aren't 0; with `by`, a sketch for each of its values.

    Items are counted before they are hashed, so each distinct item is hashed once.
    """
    by = by or []
    n = F.count("*") if count is None else F.sum(count)
    exact = updates.groupBy(*by, item).agg(n.cast("long").alias("_n"))
    cells = exact.select(*by, "_n", F.inline(cms_slots(F.col(item), width, depth, seeds)))
    return cells.groupBy(*by, "row", "col").agg(F.sum("_n").cast("long").alias("n"))


def cms_merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of all that these have counted."""
    every = sketches[0]
    for other in sketches[1:]:
        every = every.unionByName(other)
    return every.groupBy("row", "col").agg(F.sum("n").cast("long").alias("n"))


def cms_estimates(items: DataFrame, cells: DataFrame, item: str, width: int = 1000, depth: int = 5) -> DataFrame:
    """(item, estimate): the least cell of each distinct item; never below its true count."""
    asked = items.select(item).distinct().select(item, F.inline(cms_slots(F.col(item), width, depth)))
    met = asked.join(cells, ["row", "col"], "left")
    return met.groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("estimate"))


def cms_stats(updates: DataFrame, item: str, width: int = 1000, depth: int = 5) -> DataFrame:
    """width, depth, cells, updates, distinct items, and the bounds of error and of its odds."""
    _check(width, depth)
    return updates.agg(
        F.lit(width).alias("width"),
        F.lit(depth).alias("depth"),
        F.lit(width * depth).alias("cells"),
        F.count(item).alias("updates"),
        F.countDistinct(item).alias("items"),
        F.lit(round(math.e / width, 9)).alias("epsilon"),
        F.lit(round(math.exp(-depth), 9)).alias("delta"),
    )


def cms_errors(estimates: DataFrame, exact: DataFrame, item: str, count: str = "n") -> DataFrame:
    """One row: mean absolute and mean relative error over items with a count above 0."""
    both = estimates.join(exact, item).filter(F.col(count) > 0)
    off = F.col("estimate") - F.col(count)
    return both.agg(F.round(F.avg(F.abs(off)), 6).alias("mean_absolute"), F.round(F.avg(off / F.col(count)), 6).alias("mean_relative"))


def bloom_slots(item: Column, bits: int, hashes: int) -> Column:
    if bits <= 0 or hashes <= 0:
        raise ValueError("bits and hashes are positive")
    return F.array(*[slot(i, item, bits) for i in range(hashes)])


def bloom_bits(items: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    """(bit) of every bit that is set."""
    return items.select(item).distinct().select(F.explode(bloom_slots(F.col(item), bits, hashes)).alias("bit")).distinct()


def bloom_packed(bits: DataFrame) -> DataFrame:
    """(bucket, bitmap): the set bits, 32,768 to a binary value."""
    return bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitmap"))


def bloom_contains(items: DataFrame, filter_bits: DataFrame, item: str, bits: int, hashes: int) -> DataFrame:
    """(item, contained) of each distinct item: true for all that were added, and for some others."""
    asked = items.select(item).distinct().select(item, F.explode(F.array_distinct(bloom_slots(F.col(item), bits, hashes))).alias("bit"))
    met = asked.join(filter_bits.select("bit", F.lit(1).alias("_set")), "bit", "left")
    return met.groupBy(item).agg(F.every(F.col("_set").isNotNull()).alias("contained"))


def bloom_info(added: DataFrame, item: str, capacity: int, error_rate: float) -> DataFrame:
    """One row: sizes, adds, share of set bits, and the false-positive rate that formula gives for the adds."""
    bits, hashes = bloom_size(capacity, error_rate)
    n = added.agg(F.count(item).alias("adds"))
    filled = bloom_bits(added, item, bits, hashes).agg(F.count("*").alias("_set"))
    rate = F.pow(1 - F.exp(-F.lit(float(hashes)) * F.col("adds") / bits), F.lit(float(hashes)))
    return n.crossJoin(filled).select(  # two single rows
        F.lit(bits).alias("bits"),
        F.lit(hashes).alias("hashes"),
        F.lit((bits + 7) // 8).alias("bytes"),
        "adds",
        F.round(F.col("_set") / bits, 6).alias("fill"),
        F.when(F.col("adds") == 0, F.lit(0.0)).otherwise(F.round(rate, 6)).alias("false_positive_rate"),
    )


def bloom_flags(events: DataFrame, item: str, bits: int, hashes: int, seq: str = "seq", name: str = "duplicate") -> DataFrame:
    """Events flagged as a filter that is asked, then fed, one by one would flag them.

    An event is flagged if each of its bits was first set by an earlier event.  That holds for
    false positives too, as an event that is flagged sets no new bit.  An event without an item
    stays, and is never flagged.
    """
    marked = events.filter(F.col(item).isNotNull())
    # an item's bits were first set by its own first event or by another item: items stand for events
    items = marked.groupBy(item).agg(F.min(seq).alias("_first"))
    touched = items.select(item, "_first", F.explode(F.array_distinct(bloom_slots(F.col(item), bits, hashes))).alias("_bit"))
    firsts = touched.groupBy("_bit").agg(F.min("_first").alias("_set"))
    latest = touched.join(firsts, "_bit").groupBy(item).agg(F.max("_set").alias("_complete"))
    return events.join(latest, item, "left").withColumn(name, F.coalesce(F.col("_complete") < F.col(seq), F.lit(False))).select(*events.columns, name)


def exact_flags(events: DataFrame, item: str, seq: str = "seq", name: str = "duplicate") -> DataFrame:
    """Events flagged from an item's second on."""
    return events.withColumn(name, F.row_number().over(Window.partitionBy(item).orderBy(seq)) > 1)


class MisraGries:
    """At most k - 1 counters; an update that finds none free takes one from each."""

    def __init__(self, k: int):
        if k < 2:
            raise ValueError("k is at least 2")
        self.k, self.counts = k, {}

    def add(self, item: object) -> None:
        counts = self.counts
        if item in counts:
            counts[item] += 1
        elif len(counts) < self.k - 1:
            counts[item] = 1
        else:
            self.counts = {x: n - 1 for x, n in counts.items() if n > 1}

    def merge(self, items: list, counts: list[int]) -> None:
        """Counters of another summary: sums, less the k-th largest of them."""
        for x, n in zip(items, counts, strict=True):
            self.counts[x] = self.counts.get(x, 0) + n
        if len(self.counts) >= self.k:
            cut = sorted(self.counts.values(), reverse=True)[self.k - 1]
            self.counts = {x: n - cut for x, n in self.counts.items() if n > cut}


def misra_gries(items: DataFrame, item: str, k: int = 50, seq: str | None = None) -> DataFrame:
    """(item, n): counters with f - N / k <= n <= f.

    With `seq`, one pass in that order, as one summary would count: inherently serial, in memory
    of k counters.  Without it, a summary for each partition, then merged: k rows a partition
    are all that is moved, and the bounds are the same.
    """
    MisraGries(k)
    ship(items.sparkSession)
    kind = items.schema[item].dataType.simpleString()
    schema = f"item {kind}, n long"
    rows = items.filter(F.col(item).isNotNull()).select(F.col(item).alias("item"), *([F.col(seq).alias("seq")] if seq else []))

    def counters(summary: MisraGries, kind: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        if summary.counts:  # a partition without items has none, and no type either
            yield pa.RecordBatch.from_arrays([pa.array(list(summary.counts), kind), pa.array(list(summary.counts.values()), pa.int64())], names=["item", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, kind = MisraGries(k), None
        for batch in batches:
            kind = batch.column(0).type
            for x in batch.column(0).to_pylist():
                summary.add(x)
        yield from counters(summary, kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, kind = MisraGries(k), None
        for batch in batches:
            kind = batch.column(0).type
            summary.merge(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield from counters(summary, kind)

    if seq:
        out = rows.repartition(1).sortWithinPartitions("seq").select("item").mapInArrow(count, schema)
    else:
        out = rows.mapInArrow(count, schema).repartition(1).mapInArrow(merge, schema)
    return out.withColumnRenamed("item", item) if item != "item" else out
