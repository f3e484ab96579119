"""Running counts and flags over a sequence of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered
from .sketches import cms_slots


def dedup_key(user: Column, item: Column, ts: Column, seconds: int = 60) -> Column:
    """user:item:bucket of event time."""
    return F.concat_ws(":", user.cast("string"), item.cast("string"), F.floor(F.unix_seconds(ts) / seconds).cast("string"))


def normalised_token(token: Column) -> Column:
    """A token in small letters, without white space at its ends."""
    return F.lower(F.regexp_replace(token, r"^\s+|\s+$", ""))


def normalised_source(source: Column) -> Column:
    """An address without white space at its ends."""
    return F.regexp_replace(source, r"^\s+|\s+$", "")


def cumulative_weights(ranked: DataFrame, rank: str, weight: str, name: str = "cumulative", block: int = 1000) -> DataFrame:
    """`ranked` (its rank from 1) with the share of all weight up to each row.

    Blocks of ranks are summed up first, so no task takes all rows.
    """
    rows = ranked.withColumn("_block", F.floor((F.col(rank) - 1) / block))
    blocks = rows.groupBy("_block").agg(F.sum(weight).alias("_sum"))
    total = Window.orderBy("_block")
    blocks = blocks.select("_block", (F.sum("_sum").over(total) - F.col("_sum")).alias("_before"), F.sum("_sum").over(total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    within = F.sum(weight).over(Window.partitionBy("_block").orderBy(rank))
    return rows.withColumn("_within", within).join(blocks, "_block").withColumn(name, (F.col("_before") + F.col("_within")) / F.col("_all")).select(*ranked.columns, name)


def running_count(events: DataFrame, key: str, seq: str = "seq", name: str = "running") -> DataFrame:
    """Events with their key's count so far, themselves included."""
    return events.withColumn(name, F.count("*").over(Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))


def running_estimate(events: DataFrame, key: str, width: int, depth: int, seq: str = "seq", name: str = "estimate") -> DataFrame:
    """Events with the Count-Min estimate of their key so far, themselves included."""
    cells = events.select(seq, F.inline(cms_slots(F.col(key), width, depth)))
    cells = running_count(cells.withColumn("_cell", F.struct("row", "col")), "_cell", seq, "_n")
    return events.join(cells.groupBy(seq).agg(F.min("_n").alias(name)), seq)


def anomalies(events: DataFrame, token: str, source: str, width: int = 5000, depth: int = 7, threshold: int = 8, seq: str = "seq") -> DataFrame:
    """(seq, token, source, duplicate, exact, estimate, anomalous): is this source too frequent right now?"""
    seen = running_count(running_count(events.select(seq, token, source), token, seq, "_seen"), source, seq, "exact")
    out = running_estimate(seen, source, width, depth, seq)
    return out.select(seq, token, source, (F.col("_seen") > 1).alias("duplicate"), "exact", "estimate", (F.col("estimate") >= threshold).alias("anomalous"))


def cumulative_rate(flags: DataFrame, flag: str = "hit", every: int = 100, seq: str = "seq") -> DataFrame:
    """(n, rate): the share of flagged events up to every `every`-th.

    Blocks of `every` events are summed up first; the running sum is over blocks, in two steps,
    so that no task takes them all.
    """
    rows = numbered(flags, F.col(seq), [seq], "_n").withColumn("_block", F.floor((F.col("_n") - 1) / every))
    blocks = rows.groupBy("_block").agg(F.sum(F.col(flag).cast("long")).alias("_flags"), F.count("*").alias("_rows"))
    blocks = blocks.withColumn("_group", F.floor(F.col("_block") / 1000))
    groups = blocks.groupBy("_group").agg(F.sum("_flags").alias("_sum"))
    groups = groups.select("_group", (F.sum("_sum").over(Window.orderBy("_group")) - F.col("_sum")).alias("_before"))
    within = F.sum("_flags").over(Window.partitionBy("_group").orderBy("_block"))
    out = blocks.withColumn("_within", within).join(groups, "_group").filter(F.col("_rows") == every)
    n = (F.col("_block") + 1) * every
    return out.select(n.cast("long").alias("n"), F.round((F.col("_before") + F.col("_within")) / n, 6).alias("rate"))


def queue_depth(events: DataFrame, change: Column, seq: str = "seq", by: list[str] | None = None, name: str = "depth") -> DataFrame:
    """Events with the length of their queue after them; `change` is 1 for a push, -1 for a pop."""
    return events.withColumn(name, F.sum(change).over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)))
