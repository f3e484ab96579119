"""LRU caches over an access trace (seq, key): residents, hits, hit curves and replay."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.sources.packaging import ship


def _check(capacity: int) -> None:
    if capacity <= 0:
        raise ValueError("capacity is positive")


def most_recent(trace: DataFrame, n: int, key: str = "item", seq: str = "seq") -> DataFrame:
    """The `n` keys that were accessed last, the latest first; none for 0."""
    return trace.groupBy(key).agg(F.max(seq).alias("last_seq")).orderBy(F.desc("last_seq")).limit(n)


def residents(trace: DataFrame, capacity: int, key: str = "item", seq: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """What a cache of this capacity holds after the trace; keys that `known` lacks are never stored."""
    _check(capacity)
    stored = trace if known is None else trace.join(known.select(key).distinct(), key, "left_semi")
    return most_recent(stored, capacity, key, seq)


def distances(trace: DataFrame, key: str = "item", seq: str = "seq", known: DataFrame | None = None, block: int = 64) -> DataFrame:
    """(seq, key, distance): distinct stored keys since this key's access before; null at its first.

    An access hits a cache of a capacity above its distance, so one pass serves all capacities.
    An access counts for a later one's distance if it is its key's last before it: a range join
    on seq.  Ranges are cut into blocks of `block` numbers and met by an equi-join on the block,
    so the work is the sum of the gaps between a key's accesses, not the square of the trace.
    """
    rows = trace.select(F.col(seq).alias("seq"), F.col(key).alias("key"))
    if known is not None:
        rows = rows.join(known.select(F.col(key).alias("key")).distinct().withColumn("_known", F.lit(True)), "key", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    else:
        rows = rows.withColumn("_known", F.lit(True))
    own = Window.partitionBy("key").orderBy("seq")
    rows = rows.withColumn("prev", F.when(F.col("_known"), F.lag("seq").over(own))).withColumn("next", F.lead("seq").over(own))
    number = lambda c: F.floor(F.col(c) / block)
    asked = rows.filter("prev is not null").select(F.col("seq").alias("s"), "prev", F.explode(F.sequence(number("prev"), number("seq"))).alias("_block"))
    others = rows.filter("_known").select(F.col("seq").alias("o"), "next", number("seq").alias("_block"))
    inside = (F.col("o") > F.col("prev")) & (F.col("o") < F.col("s")) & (F.col("next").isNull() | (F.col("next") > F.col("s")))
    met = asked.join(others, "_block").select("s", inside.cast("int").alias("o"))
    found = met.groupBy("s").agg(F.sum("o").alias("distance"))
    return rows.join(found, F.col("seq") == F.col("s"), "left").select(F.col("seq").alias(seq), F.col("key").alias(key), "distance")


def hits(trace: DataFrame, capacity: int, key: str = "item", seq: str = "seq", known: DataFrame | None = None) -> DataFrame:
    """(seq, key, hit) by stack distances: for traces of up to some 10,000s of accesses; see `replay` for more."""
    _check(capacity)
    return distances(trace, key, seq, known).select(seq, key, F.coalesce(F.col("distance") < capacity, F.lit(False)).alias("hit"))


def curve(trace: DataFrame, capacities: list[int], key: str = "item", seq: str = "seq") -> DataFrame:
    """(capacity, hits, requests, hit_rate in percent) for many capacities from one pass."""
    for c in capacities:
        _check(c)
    counted = distances(trace, key, seq).groupBy("distance").agg(F.count("*").alias("n"))
    sizes = F.explode(F.array(*[F.lit(c) for c in capacities])).alias("capacity")
    hit = F.sum(F.when(F.col("distance") < F.col("capacity"), F.col("n")).otherwise(0))
    out = counted.select("*", sizes).groupBy("capacity").agg(hit.cast("long").alias("hits"), F.sum("n").cast("long").alias("requests"))
    return out.withColumn("hit_rate", F.round(100 * F.col("hits") / F.col("requests"), 2))


def replay(trace: DataFrame, capacity: int, key: str = "item", seq: str = "seq", shard: list[str] | None = None, known: DataFrame | None = None) -> DataFrame:
    """(shard..., seq, key, hit, evicted) of caches fed in the order of seq, one for each shard.

    One cache's answer depends on all before it, so a cache is one sorted stream through one
    task, in memory of its capacity; many caches run in parallel.
    """
    _check(capacity)
    ship(trace.sparkSession)
    shard = shard or []
    rows = trace.select(*shard, F.col(seq).alias("_seq"), F.col(key).alias("_key"))
    if known is not None:
        rows = rows.join(known.select(F.col(key).alias("_key")).distinct().withColumn("_known", F.lit(True)), "_key", "left").withColumn("_known", F.coalesce("_known", F.lit(False)))
    else:
        rows = rows.withColumn("_known", F.lit(True))
    rows = rows.select(*shard, "_seq", "_key", "_known")
    rows = rows.repartition(*shard) if shard else rows.repartition(1)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in shard), f"`{seq}` {kinds['_seq']}", f"`{key}` {kinds['_key']}", "hit boolean", "evicted boolean"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, OrderedDict()
        for batch in batches:
            owners = list(zip(*(batch[c] for c in shard), strict=True)) if shard else [()] * len(batch)
            hit, out = [], []
            for owner, k, stored in zip(owners, batch["_key"], batch["_known"], strict=True):
                if owner != now:
                    now, held = owner, OrderedDict()
                found = k in held
                full = False
                if found:
                    held.move_to_end(k)
                elif stored:
                    full = len(held) >= capacity
                    if full:
                        held.popitem(last=False)
                    held[k] = None
                hit.append(found)
                out.append(full)
            yield batch.drop(columns="_known").rename(columns={"_seq": seq, "_key": key}).assign(hit=hit, evicted=out)

    return rows.sortWithinPartitions(*shard, "_seq").mapInPandas(run, schema)


def stats(flags: DataFrame, capacity: int) -> DataFrame:
    """One row from (hit, evicted): hits, misses, hit_rate (percent, 2 places), evictions, requests, size, fill (percent)."""
    hit, out = F.sum(F.col("hit").cast("long")), F.sum(F.col("evicted").cast("long"))
    stored = F.sum((~F.col("hit") & F.col("stored")).cast("long")) if "stored" in flags.columns else F.sum((~F.col("hit")).cast("long"))
    got = flags.agg(F.coalesce(hit, F.lit(0)).alias("hits"), F.count("*").alias("requests"), F.coalesce(out, F.lit(0)).alias("evictions"), F.coalesce(stored, F.lit(0)).alias("_stored"))
    size = F.col("_stored") - F.col("evictions")
    return got.select(
        "hits",
        (F.col("requests") - F.col("hits")).alias("misses"),
        F.when(F.col("requests") > 0, F.round(100 * F.col("hits") / F.col("requests"), 2)).otherwise(F.lit(0.0)).alias("hit_rate"),
        "evictions",
        "requests",
        size.alias("size"),
        F.lit(capacity).alias("capacity"),
        F.round(100 * size / capacity, 2).alias("fill"),
    )


#: What `operated` takes as operations.
OPERATIONS = ("get", "put", "contains", "reset", "clear")


def operated(trace: DataFrame, capacity: int, op: str = "op", key: str = "item", seq: str = "seq") -> DataFrame:
    """(seq, op, key, answer, evicted, size, hits, misses) of one cache that is operated in the order of seq.

    `get` answers whether the key is there, and refreshes it; `contains` only answers; `put`
    answers whether the key was there, refreshes or stores it, and may evict the key that was
    used least recently; `reset` sets hits and misses, which `get` counts, to 0; `clear` empties
    the cache too.  Another operation is an error.  One cache is one stream, in memory of its
    capacity.
    """
    _check(capacity)
    ship(trace.sparkSession)
    rows = trace.select(F.col(seq).alias("_seq"), F.col(op).alias("_op"), F.col(key).alias("_key"))
    kinds = dict(rows.dtypes)
    schema = f"`{seq}` {kinds['_seq']}, `{op}` string, `{key}` {kinds['_key']}, answer boolean, evicted {kinds['_key']}, size long, hits long, misses long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, hits, misses = OrderedDict(), 0, 0
        for batch in batches:
            out = []
            for what, k in zip(batch["_op"], batch["_key"], strict=True):
                if what not in OPERATIONS:
                    raise ValueError(f"unknown operation {what}")
                answer, gone = k in held, None
                if what in ("reset", "clear"):
                    hits = misses = 0
                    answer = None
                    if what == "clear":
                        held.clear()
                elif what == "get":
                    hits, misses = hits + answer, misses + (not answer)
                if what in ("get", "put") and answer:
                    held.move_to_end(k)
                elif what == "put":
                    if len(held) >= capacity:
                        gone = held.popitem(last=False)[0]
                    held[k] = None
                out.append((answer, gone, len(held), hits, misses))
            named = batch.rename(columns={"_seq": seq, "_op": op, "_key": key}).reset_index(drop=True)
            yield pd.concat([named, pd.DataFrame(out, columns=["answer", "evicted", "size", "hits", "misses"], dtype=object)], axis=1)

    return rows.repartition(1).sortWithinPartitions("_seq").mapInPandas(run, schema)
