"""Priorities, drain order, positions and top-k.

A global rank never puts all rows in one task: rows fall into bins by quantiles of a number that
the order follows, the bins' counts are summed up, and a row's rank is the count before its bin
plus its place in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, by: Column, order: list[str | Column], name: str, lead: list[str] | None = None, bins: int | None = None) -> DataFrame:
    """`df` with each row's number from 1 in the order of `lead` (columns of few values), then `order`.

    `by` is a number that grows with `order`; its quantiles bound the bins.  Rows that tie in
    all of `order` get numbers in no fixed order.
    """
    lead = lead or []
    bins = bins or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_by", by.cast("double"))
    cuts = keyed.agg(F.percentile_approx("_by", [i / bins for i in range(1, bins)] or [0.5], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>")
    # a null sorts first
    keyed = keyed.withColumn("_bin", F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("_by"))), F.lit(0)))
    counts = keyed.groupBy(*lead, "_bin").agg(F.count("*").alias("_in"))
    # a row for each bin and lead value: bounded by the parameters, not by the data
    before = counts.withColumn("_before", F.coalesce(F.sum("_in").over(Window.orderBy(*lead, "_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_in")
    keys = [*lead, "_bin"]
    side = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_before")
    placed = keyed.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    out = placed.join(F.broadcast(side), on)
    return out.select(*df.columns, (F.col("_before") + F.col("_place")).cast("long").alias(name))


def core_priority(event_type: Column, premium: Column) -> Column:
    """0 for a payment, else 1 for a premium user, else 2: lower is more urgent."""
    return F.when(event_type == "payment", 0).when(F.coalesce(premium, F.lit(False)), 1).otherwise(2)


def graded_priority(event_type: Column, premium: Column) -> Column:
    """4 to 1: higher is more urgent."""
    premium = F.coalesce(premium, F.lit(False))
    return (
        F.when(event_type.isin("payment", "subscription", "chargeback"), 4)
        .when(premium & event_type.isin("play", "download"), 3)
        .when(event_type.isin("search", "resume"), 2)
        .otherwise(1)
    )


#: The labels of the core priorities.
LABELS = {0: "PAGO", 1: "PREMIUM", 2: "ESTÁNDAR"}


def priority_label(priority: Column) -> Column:
    """A known priority's label; another one as text."""
    out = F.when(F.lit(False), F.lit(""))
    for value, label in LABELS.items():
        out = out.when(priority == value, label)
    return out.otherwise(priority.cast("string"))


def drained(events: DataFrame, priority: str = "priority", ts: str = "ts", seq: str = "seq", name: str = "position") -> DataFrame:
    """Events with their position, from 1, in the order of (priority, ts, seq)."""
    return numbered(events, F.unix_micros(F.col(ts).cast("timestamp")), [ts, seq], name, lead=[priority])


def drained_graded(events: DataFrame, priority: str = "priority", seq: str = "seq", name: str = "position") -> DataFrame:
    """Events with their position, from 1: the highest priority first, then by seq."""
    rows = events.withColumn("_urgent", -F.col(priority))
    return numbered(rows, F.col(seq), [seq], name, lead=["_urgent"]).drop("_urgent")


def first_served(events: DataFrame, n: int = 10, priority: str = "priority", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """The next `n` events: a top-k, without a full sort."""
    if n < 0:
        raise ValueError("n is not negative")
    return events.orderBy(priority, ts, seq).limit(n)


def top_k(df: DataFrame, key: str, k: int = 10, seq: str | None = None, weight: str | None = None) -> DataFrame:
    """The `k` most frequent keys (or with the largest sums of `weight`); ties by first `seq`, else by key."""
    n = F.count("*") if weight is None else F.sum(weight)
    counted = df.groupBy(key).agg(n.cast("long").alias("n"), *([F.min(seq).alias("_first")] if seq else []))
    return counted.orderBy(F.desc("n"), "_first" if seq else key).limit(k).select(key, "n")


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first `k` rows of each group, with their rank; partial ranks cut most rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(name) <= k)


def precision(exact: DataFrame, approx: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """One row: hits, and hits over `k`, or over the exact rows where `k` is not given; 0.0 without any."""
    hits = exact.select(key).join(approx.select(key), key, "left_semi").agg(F.count("*").alias("hits"))
    base = hits.crossJoin(exact.agg(F.count("*").alias("_n")))  # two single rows
    of = F.lit(k) if k is not None else F.col("_n")
    return base.select("hits", F.when(of > 0, F.round(F.col("hits") / of, 6)).otherwise(F.lit(0.0)).alias("precision"))
