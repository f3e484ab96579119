"""Line dedup by overlapping three-line windows.

A text's lines are what `\\n` separates; lines without a word are passed over.  Every run of
three consecutive lines with words is a window, known by two 64-bit hashes.  A window's first
place is its least (doc_id, text hash, place); at every later place its three lines are covered,
and covered lines are removed, each once however many windows cover it.

The first place of every window that occurs twice is an aggregate, combined before the shuffle.
It is joined back to the places on the hashes and a salt made of the document's id, so that a
window that a third of the documents share is dealt to `salts` tasks.

Case by case: a null text stays null; texts of fewer than three lines with words stay as they
are; rows with equal id and text are one place, so none of them loses lines for another; null
ids come first; an empty table gives no row; other columns stay, whatever their names, and are
not read, but `n_lines` and `n_removed`, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import id_key, salted_join, unused

WORD = r"[^ \x09-\x0D]"


def _split(text: str) -> Column:
    return F.split(F.col(text), "\n")


def _windows(docs: DataFrame, text: str, size: int) -> DataFrame:
    """_id, _t (hash of the text), _at (places of the window's lines in the text), _a, _b (the window's hashes)."""
    lines = F.filter(F.transform(_split(text), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda r: r["x"].rlike(WORD))
    rows = docs.select(id_key().alias("_id"), F.xxhash64(text).alias("_t"), lines.alias("_lines")).filter(F.size("_lines") >= size)
    rows = rows.select("_id", "_t", "_lines", F.explode(F.sequence(F.lit(0), F.size("_lines") - size)).alias("_w"))
    each = [F.get("_lines", F.col("_w") + j) for j in range(size)]
    return rows.select("_id", "_t", F.array(*[r["i"] for r in each]).alias("_at"), F.xxhash64(*[r["x"] for r in each]).alias("_a"), F.xxhash64(F.lit(1), *[r["x"] for r in each]).alias("_b"))


def deduplicated(docs: DataFrame, size: int = 3, salts: int = 16, text: str = "text") -> DataFrame:
    """`docs` without the covered lines, and `n_lines`, `n_removed` (lines with words, and those removed)."""
    windows = _windows(docs, text, size)
    place = F.struct("_id", "_t", F.col("_at")[0].alias("_p"))
    first = windows.groupBy("_a", "_b").agg(F.min(place).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    later = salted_join(windows, first, ["_a", "_b"], ["_id", "_t"], salts=salts).filter(place > F.col("_first"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    key, mark, gone, split = (unused(kept, c) for c in ("_id", "_t", "_gone", "_lines"))
    covered = later.groupBy(F.col("_id").alias(key), F.col("_t").alias(mark)).agg(F.array_distinct(F.flatten(F.collect_set("_at"))).alias(gone))
    rows = docs.select(*kept, id_key().alias(key), F.xxhash64(text).alias(mark)).join(covered, [key, mark], "left")
    # `split` is named twice below, so that the text is split once for a row, not once for each line
    rows = rows.withColumn(split, _split(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    short = F.when(F.size(split) > 0, F.array_join(F.transform(left, lambda i: F.get(F.col(split), i)), "\n"))
    n_lines = F.coalesce(F.size(F.filter(F.col(split), lambda x: x.rlike(WORD))), F.lit(0)).cast("long")
    return rows.select(
        *[F.when(F.col(gone).isNull(), F.col(c)).otherwise(short).alias(c) if c == text else c for c in kept],
        n_lines.alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
    )
