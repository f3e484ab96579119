"""Shards that all hold the mixture: proportional stratified interleaving.

The rows of each source are ranked in a seeded shuffled order.  A row's fractional rank is
(rank - shift) / rows of the source, the shift being a seeded number from 0 to 1 for each
source, so that small sources spread out.  The table in the order of fractional ranks holds
every source in its share at every stretch, and is cut into shards whose counts differ by one
at most.

No rank needs a whole source, or the whole table, in one task: hashes, and fractional ranks,
are cut into many equal bins, whose counts are summed up; a row's rank is the count before its
bin plus its place in the bin.  The number of bins follows the number of rows.

Case by case: a null source is a source; a null text has size 1; rows that repeat are placed
each for itself (equal rows are interchangeable); an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rows that a bin holds on average, at most.
BIN_ROWS = 2000


def interleaved(docs: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot of each row of `docs` (doc_id, text, source)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_crc32")))
    rows = written(rows, "rows")  # the texts are read once
    n = rows.count()
    bits = max(0, (max(1, n) // BIN_ROWS).bit_length())
    bins = 1 << bits
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null")))
    rows = rows.withColumn("_bin", F.shiftrightunsigned("_h", 64 - bits).cast("int") if bits else F.lit(0))

    # counts before each bin of each source: a few numbers for each bin
    counts = rows.groupBy("_source", "_bin").agg(F.count("*").alias("_in"))
    by_source = Window.partitionBy("_source")
    before = counts.withColumn("_before", F.sum("_in").over(by_source.orderBy("_bin")) - F.col("_in")).withColumn("_n", F.sum("_in").over(by_source)).drop("_in")
    place = F.row_number().over(Window.partitionBy("_source", "_bin").orderBy("_h", "doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("_place", place).join(before, ["_source", "_bin"])
    shift = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), F.col("_source")), 11).cast("double") / float(1 << 53))
    ranked = ranked.withColumn("_rank", (F.col("_before") + F.col("_place") - shift) / F.col("_n"))
    ranked = ranked.withColumn("_at", F.least(F.floor(F.col("_rank") * bins), F.lit(bins - 1)).cast("int"))
    ranked = written(ranked.select("doc_id", "source", "size", "text_crc32", "_source", "_rank", "_at"), "ranked")

    ahead = ranked.groupBy("_at").agg(F.count("*").alias("_in"))
    # one row for each of the bins, summed up in two steps so that no task takes them all
    step = max(1, int(bins**0.5))
    ahead = ahead.withColumn("_block", (F.col("_at") / step).cast("int"))
    within = F.sum("_in").over(Window.partitionBy("_block").orderBy("_at")) - F.col("_in")
    blocks = ahead.groupBy("_block").agg(F.sum("_in").alias("_sum"))
    blocks = blocks.withColumn("_start", F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).drop("_sum")
    ahead = ahead.withColumn("_within", within).join(blocks, "_block").select("_at", (F.col("_start") + F.col("_within")).alias("_ahead"))
    order = Window.partitionBy("_at").orderBy("_rank", "_source", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_row", F.row_number().over(order)).join(ahead, "_at").withColumn("_pos", F.col("_ahead") + F.col("_row") - 1)
    placed = placed.withColumn("shard", F.expr(f"cast(_pos * {shards} div {max(1, n)} as int)"))
    first = F.expr(f"(cast(shard as long) * {n} + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_pos") - first).alias("slot"))
