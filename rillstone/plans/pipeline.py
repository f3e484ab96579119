"""Plays served from an event sequence: duplicates, unknown items, cache hits and misses, and the counts they add up to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.functions.hashing import bands_and_rows, bloom_size
from rillstone.operators import cache, similarity, sketches
from rillstone.operators.ranking import top_k_per_group
from rillstone.operators.running import dedup_key


@dataclass(frozen=True)
class Settings:
    """The parameters of a platform; `bucket` is the time, in seconds, within which a repeat is a duplicate."""

    cache_capacity: int = 1000
    bloom_capacity: int = 500_000
    bloom_error: float = 0.001
    bucket: int = 60
    hashes: int = 100
    bands: int = 20
    least_audience: int = 5
    exact: bool = True

    def __post_init__(self) -> None:
        if self.cache_capacity <= 0 or self.bucket <= 0:
            raise ValueError("capacities and buckets are positive")
        bloom_size(self.bloom_capacity, self.bloom_error)
        bands_and_rows(self.hashes, self.bands)


def plays(events: DataFrame, settings: Settings, kind: str = "view") -> DataFrame:
    """Events of the playing kind with an item, and their dedup key."""
    found = events.filter((F.col("event_type") == kind) & F.col("item").isNotNull())
    return found.withColumn("token", dedup_key(F.col("user_id"), F.col("item"), F.col("ts"), settings.bucket))


def outcomes(events: DataFrame, catalogue: DataFrame, settings: Settings, kind: str = "view", native: bool = False) -> DataFrame:
    """Plays with `outcome`: duplicate, unknown (not in the catalogue; its key is spent), hit or miss.

    `catalogue` has a row for each known item.  The cache is one sequence; `native` computes its
    hits by stack distances, for small traces, else it is replayed.
    """
    asked = plays(events, settings, kind)
    if settings.exact:
        flagged = sketches.exact_flags(asked, "token")
    else:
        flagged = sketches.bloom_flags(asked, "token", *bloom_size(settings.bloom_capacity, settings.bloom_error))
    known = catalogue.select("item").distinct().withColumn("_known", F.lit(True))
    flagged = flagged.join(known, "item", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    served = flagged.filter(~F.col("duplicate") & F.col("_known")).select("seq", "item")
    answer = cache.hits(served, settings.cache_capacity) if native else cache.replay(served, settings.cache_capacity)
    out = flagged.join(answer.select("seq", "hit"), "seq", "left")
    outcome = F.when(F.col("duplicate"), "duplicate").when(~F.col("_known"), "unknown").when(F.col("hit"), "hit").otherwise("miss")
    return out.select("seq", "event_id", "user_id", "item", "ts", outcome.alias("outcome"))


def accepted(outcome: Column | None = None) -> Column:
    """Whether a play was served."""
    return (F.col("outcome") if outcome is None else outcome).isin("hit", "miss")


def trending(served: DataFrame, catalogue: DataFrame, k: int = 10) -> DataFrame:
    """(item, title, plays) of the most played items, ties by item; an item without a title is its own."""
    best = served.filter(accepted()).groupBy("item").agg(F.count("*").alias("plays")).orderBy(F.desc("plays"), "item").limit(k)
    titles = catalogue.groupBy("item").agg(F.min("title").alias("title"))
    return best.join(titles, "item", "left").select("item", F.coalesce("title", F.col("item").cast("string")).alias("title"), "plays")


def audiences(served: DataFrame, least: int = 1) -> DataFrame:
    """Distinct (item, member) of accepted plays."""
    return similarity.members(served.filter(accepted()), "item", "user_id", least)


def totals(events: DataFrame, served: DataFrame, searches: int = 0) -> DataFrame:
    """One row: events queued, plays, duplicates, unknown, hits, misses, active users and items, hit rate in percent."""
    n = lambda c: F.count_if(c).alias
    is_ = lambda x: F.col("outcome") == x
    counts = served.agg(
        n(accepted())("plays"),
        n(is_("duplicate"))("duplicates"),
        n(is_("unknown"))("unknown"),
        n(is_("hit"))("hits"),
        n(is_("miss"))("misses"),
        F.countDistinct(F.when(accepted(), F.col("user_id"))).alias("active_users"),
        F.countDistinct(F.when(accepted(), F.col("item"))).alias("items"),
    )
    lookups = F.col("hits") + F.col("misses") + F.col("unknown")
    rate = F.when(lookups > 0, F.round(100 * F.col("hits") / lookups, 2)).otherwise(F.lit(0.0))
    return events.agg(F.count("*").alias("queued")).crossJoin(counts).select("*", rate.alias("hit_rate"), F.lit(searches).alias("searches"))  # two single rows


def recommendations(served: DataFrame, settings: Settings, k: int = 10, threshold: float = 0.1) -> DataFrame:
    """(item, rank, other, similarity): each item with an audience against those with a large enough one."""
    sets = audiences(served)
    large = sets.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= settings.least_audience).select("item")
    signed = similarity.signatures(sets, settings.hashes)
    pairs = similarity.both_ways(similarity.similar(signed, settings.hashes, settings.bands, threshold))
    pairs = pairs.join(large.select(F.col("item").alias("other")), "other", "left_semi")
    return top_k_per_group(pairs, ["item"], [F.desc("similarity"), F.col("other")], k).select("item", "rank", "other", "similarity")


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, name, value) from tables of one row of numbers each."""
    out = None
    for section, row in sections.items():
        values = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).unpivot([], row.columns, "name", "value")
        part = values.select(F.lit(section).alias("section"), "name", "value")
        out = part if out is None else out.unionByName(part)
    return out
