"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Counts of each text come from array functions within its row; nothing is shuffled for them.
Four counts (symbols, repeated lines, words in repeated windows, code points in words) become
rates a word, and smoothed rates, (count + 1) a word, which are never 0.  Smoothed rates of the
documents that pass the base rules are summed up in mergeable quantile sketches for each
language and source, each language, and all.  A rule's limit for a group is

    Q3 * (Q3 / Q1) ** spread

of its quartiles: the fence of a box plot, on logarithms, as rates are skewed.  No cutoff is fixed:
a group of source code may have many symbols, one of prose few.  A document fails a rule where
its rate, not smoothed, is above its group's limit.

A small group's rows say little, so a group's sketch is merged with its language's, as if that
were of `weight` rows, and with that of all in the same way; the law is one and the same at
every size.  What is merged are `POINTS` quantiles of each sketch, each standing for its share of
the rows; the quartiles are those of the merged points by weight.

The sketches are those of approx_percentile: their rank error is at most 1/10,000 of the rows
of a group, whatever its size, and they are merged across tasks.

Case by case: a null text counts as empty, and fails; null languages and sources are groups of
their own; a document that fails the base rules has no other failed rules; rows that repeat are
judged each for itself; an empty table gives no row; columns of the same names as those added
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import salted_join, written

_BLANK = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rates, and the counts they are made of.
RATES = {"symbol_rate": "n_symbols", "dup_line_rate": "n_dup_lines", "repeat_rate": "n_repeat_words", "word_length": "word_chars"}
#: Quantiles taken of a sketch; in sixteenths and halves of them, which doubles hold exactly.
POINTS = [(2 * i + 1) / 32 for i in range(16)]


def counted(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, lang, source and COUNTS of each row.

    Windows whose hashes are equal are neighbours among the sorted (hash, place); those are
    sorted again by their words, so equal windows, not equal hashes, are counted.  Only texts
    whose hashes aren't all distinct take these steps.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("_text"))
    trimmed = F.btrim("_text", F.lit(_BLANK))
    rows = rows.select(
        "doc_id", "lang", "source",
        F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \x09-\x0D]+")).alias("_words"),
        F.length(F.translate("_text", _BLANK, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]")).alias("_lines"),
    )
    window = ", ".join(f"get(_words, i + {j})" for j in range(size))
    rows = rows.select(
        "doc_id", "lang", "source", F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "_words", F.expr(f"if(size(_words) > {size}, transform(sequence(0, size(_words) - {size}), i -> xxhash64({window})), cast(array() as array<bigint>))").alias("_hashes"),
    )
    twice = F.size("_hashes") > F.size(F.array_distinct("_hashes"))
    rows = rows.withColumn("_sorted", F.when(twice, F.expr("sort_array(transform(_hashes, (h, i) -> struct(h as x, i as i)))"))).drop("_hashes")
    equal = "filter({0}, (r, i) -> coalesce(r.x = get({0}, i - 1).x, false) or coalesce(r.x = get({0}, i + 1).x, false))"
    rows = rows.withColumn("_near", F.expr(equal.format("_sorted"))).drop("_sorted")
    rows = rows.withColumn("_near", F.expr(f"if(size(_words) > 0, sort_array(transform(_near, r -> struct(slice(_words, r.i + 1, {size}) as x, r.i as i))), null)"))
    rows = rows.withColumn("_places", F.expr(f"sort_array(transform({equal.format('_near')}, r -> cast(r.i as bigint)))"))
    # a window adds its words, less those that the window before it has too
    covered = F.expr(
        f"aggregate(_places, named_struct('at', {-size}L, 'sum', 0L), (a, p) -> named_struct('at', p, 'sum', a.sum + least(p - a.at, {size}L)), a -> a.sum)"
    )
    return rows.select("doc_id", "lang", "source", *COUNTS[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _rate(count: str, smooth: int = 0) -> Column:
    return (F.col(count) + smooth) / F.greatest(F.col("n_words"), F.lit(1))


def sketched(group: DataFrame) -> DataFrame:
    """Rows and POINTS (an array) of each smoothed rate, for each (_lang, _source), each _lang, and all; _level 0, 1 and 3."""
    smooth = group.filter(~base_failed()).select("_lang", "_source", *[_rate(count, 1).alias(r) for r, count in RATES.items()])
    return smooth.rollup("_lang", "_source").agg(F.grouping_id().cast("int").alias("_level"), F.count("*").alias("_rows"), *[F.percentile_approx(r, POINTS, 10_000).alias(r) for r in RATES])


def limits(sketches: DataFrame, spread: float, weight: int) -> DataFrame:
    """_lang, _source and the limit of each rate, from `sketched`."""

    def level(n: int, keys: list[str], mark: str) -> DataFrame:
        return sketches.filter(F.col("_level") == n).select(*keys, "_rows" if not n else F.lit(weight).cast("long").alias("_rows"), *RATES).select(*keys, *[F.col(c).alias(f"{c}{mark}") for c in ("_rows", *RATES)])

    # one row for all, and one for each language
    groups = level(0, ["_lang", "_source"], "_g").join(level(1, ["_lang"], "_l"), "_lang").join(F.broadcast(level(3, [], "_a")), how="cross")
    point = lambda rate, m: F.transform(f"{rate}_{m}", lambda v: F.struct(v.alias("v"), F.col(f"_rows_{m}").alias("w")))
    total = len(POINTS) * (F.col("_rows_g") + F.col("_rows_l") + F.col("_rows_a"))

    def quartile(rate: str, fourths: int) -> Column:
        """The least point at which so many fourths of the weight are reached."""
        merged = F.sort_array(F.concat(*[point(rate, m) for m in "gla"]))
        start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast("double").alias("v"))
        step = lambda acc, x: F.struct((acc["sum"] + x["w"]).alias("sum"), F.coalesce(acc["v"], F.when((acc["sum"] + x["w"]) * 4 >= total * fourths, x["v"])).alias("v"))
        return F.aggregate(merged, start, step, lambda acc: acc["v"])

    return groups.select("_lang", "_source", *[(quartile(r, 3) * F.pow(quartile(r, 3) / quartile(r, 1), F.lit(float(spread)))).alias(f"_{r}") for r in RATES])


def judged(docs: DataFrame, spread: float = 2.0, weight: int = 20, broadcast_groups: int = 100_000) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, failed_rules of each row of `docs` (doc_id, text, lang, source).

    Limits are sent to all executors while their groups are few (checked); beyond that they are
    joined on a salt too, so that a source with a third of the rows is dealt to many tasks.
    """
    counts = written(counted(docs), "counts")
    group = counts.select("*", *[F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null")).alias(f"_{c}") for c in ("lang", "source")])
    own = written(limits(written(sketched(group), "sketches"), spread, weight), "limits")
    if own.count() <= broadcast_groups:
        joined = group.join(F.broadcast(own), ["_lang", "_source"], "left")
    else:
        joined = salted_join(group, own, ["_lang", "_source"], ["doc_id"], "left")
    over = [F.when(~base_failed() & (_rate(count) > F.col(f"_{r}")), F.lit(r)) for r, count in RATES.items()]
    rules = F.array_compact(F.array(*over))
    return joined.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & (F.size(rules) == 0)).alias("kept"), F.array_join(rules, ",").alias("failed_rules"))
