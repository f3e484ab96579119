"""Title catalogues and prefix search.

A catalogue row is (key, title, popularity): titles that differ in case alone are one, their
popularity summed, shown as the last one inserted.  Keys are stored lower-cased, so that a
prefix filter reaches the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_k_per_group


def normalized(text: Column) -> Column:
    """Without white space at either end, lower-cased."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


def catalogue(titles: DataFrame, title: str = "title", popularity: str = "popularity", seq: str = "seq") -> DataFrame:
    rows = titles.filter(F.col(title).isNotNull())
    return rows.groupBy(F.lower(title).alias("key")).agg(F.max_by(title, F.struct(seq, title)).alias("title"), F.sum(popularity).cast("long").alias("popularity"))


def autocomplete(found: DataFrame, prefix: str, limit: int = 10, empty_is_all: bool = True) -> DataFrame:
    """Titles with the prefix, most popular first, ties by key."""
    if limit < 0:
        raise ValueError("limit is not negative")
    hits = found if prefix or empty_is_all else found.limit(0)
    return hits.filter(F.col("key").startswith(prefix.lower())).orderBy(F.desc("popularity"), "key").limit(limit)


def autocomplete_ordered(titles: DataFrame, prefix: str, limit: int = 10, title: str = "title") -> DataFrame:
    """Titles, case and repeats kept, with the prefix, in the order of their code points."""
    return titles.filter(F.col(title).startswith(prefix)).orderBy(title).limit(limit)


def prefixes(found: DataFrame, longest: int) -> DataFrame:
    """(prefix, key, title, popularity) for each prefix of up to `longest` characters."""
    size = F.least(F.length("key"), F.lit(longest))
    return found.filter(F.length("key") > 0).select("*", F.explode(F.sequence(F.lit(1), size)).alias("_n")).select(F.expr("substring(key, 1, _n)").alias("prefix"), "key", "title", "popularity")


def prefix_index(found: DataFrame, longest: int = 6, k: int = 5) -> DataFrame:
    """The `k` best titles of every prefix: what a search tree gives, as a table to look up."""
    return top_k_per_group(prefixes(found, longest), ["prefix"], [F.desc("popularity"), F.col("key")], k)


def suggestions(queries: DataFrame, found: DataFrame, k: int = 8, query: str = "query", longest: int = 12) -> DataFrame:
    """The `k` best titles of each query, by an equi-join on its first characters; blank queries have none."""
    asked = queries.select(query, normalized(F.col(query)).alias("_q")).distinct().filter(F.length("_q") > 0)
    asked = asked.withColumn("prefix", F.substring("_q", 1, longest))
    hits = asked.join(prefixes(found, longest), "prefix").filter(F.col("key").startswith(F.col("_q")))
    return top_k_per_group(hits, [query], [F.desc("popularity"), F.col("key")], k).select(query, "rank", "title", "popularity")


def lookup(words: DataFrame, found: DataFrame, word: str = "word") -> DataFrame:
    """Each word's popularity; null where it is no title."""
    return words.join(found.select(F.col("key").alias("_key"), "popularity"), F.lower(word) == F.col("_key"), "left").drop("_key")


def any_with_prefix(found: DataFrame, asked: list[str]) -> DataFrame:
    """(prefix, found): whether a title begins so; the empty prefix always is."""
    spark = found.sparkSession
    rows = spark.createDataFrame([(p, p.lower()) for p in asked], "prefix string, _p string")
    longest = max([1, *map(len, asked)])
    hits = prefixes(found, longest).select(F.col("prefix").alias("_p")).join(F.broadcast(rows.select("_p").distinct()), "_p", "left_semi").distinct()
    return rows.join(hits.withColumn("_hit", F.lit(True)), "_p", "left").select("prefix", (F.coalesce("_hit", F.lit(False)) | (F.length("prefix") == 0)).alias("found"))


def deleted(found: DataFrame, words: DataFrame, word: str = "word") -> tuple[DataFrame, DataFrame]:
    """The catalogue without the words, and (word, existed)."""
    gone = words.select(word, F.lower(word).alias("key"))
    left = found.join(gone.select("key").distinct(), "key", "left_anti")
    told = gone.join(found.select("key", F.lit(True).alias("_was")), "key", "left").select(word, F.coalesce("_was", F.lit(False)).alias("existed"))
    return left, told
