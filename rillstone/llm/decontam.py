"""Test items inside documents: size-partitioned MinHash containment search, in DataFrame functions alone.

Items and documents are sets of five-word shingles; an item is in a document that holds 75 of
100 of its shingles.  A single MinHash of a long document says nothing about a short item in
it, so containment is asked of the item's side: an item's sketch is its bottom-k, the k of its
shingles with the least hashes.  A document that lacks at most a quarter of an item's shingles
must hold one of the (a quarter, plus one) least.  Items are partitioned by size classes (powers
of two); k is that number for the largest size of the class, so no contained item is missed.

1. Search: the hashes of a document's shingles meet the sketches, and nothing else of the
   items.  A document that holds a hash of an item's sketch, and has as many places as the item
   needs, is a candidate for it.
2. Verification: the shingles of candidate documents are compared, as text, with all those of
   candidate items, and counted.

Sketches are rows of four numbers; they are sent to all executors while they are few
(`broadcast_rows`, checked), and joined on a salt beyond.  The same goes for the shingles of
candidate items, by their bytes (`broadcast_bytes`).  No shuffle moves a whole text, but for
candidates' texts when their ids are too many to send.

Texts are lower-cased from A to Z; words are runs of other characters than space and 0x09 to
0x0D.  A text of one to four words is one shingle, its whole sequence, so such an item is only
in a document of the same words.  A null text, or one without words, is in nothing and holds
nothing.  Documents of one id whose texts differ are documents of their own; rows whose id and
text are equal give one row; items of one id are one item; an empty table on either side gives
no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import id_key, salted_join, written

_BLANK = " \t\n\x0b\f\r"
SIZE = 5


def words_of(text: Column) -> Column:
    lowered = F.translate(F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.length(lowered) == 0, F.array().cast("array<string>")).otherwise(F.split(lowered, r"[ \x09-\x0D]+"))


def _word(i: Column | int) -> Column:
    return F.get(F.col("_words"), i if isinstance(i, Column) else F.lit(i))


def exploded(rows: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """One row for each place of a shingle: keys, _h (hash), _words and _i (place).

    The row holds a reference to its text's words; nothing is copied for a place.
    """
    full = F.size("_words") >= size
    places = F.when(full, F.sequence(F.lit(0), F.size("_words") - size)).when(F.size("_words") > 0, F.array(F.lit(0)))
    rows = rows.select(*keys, "_words", F.explode(places).alias("_i"))
    # a place beyond a short text's end is null, which the hash passes over
    return rows.select(*keys, "_words", "_i", F.xxhash64(*[_word(F.col("_i") + j) for j in range(size)]).alias("_h"))


def shingle(size: int = SIZE) -> Column:
    return F.concat_ws(" ", *[_word(F.col("_i") + j) for j in range(size)])


def _sketches(sets: DataFrame, percent: int) -> DataFrame:
    """The bottom-k rows of each item of `sets` (item_id, n_shingles, _h, _shingle)."""
    largest = F.expr("shiftleft(1L, cast(ceil(log2(n_shingles)) as int))")
    # the largest size of the class needs the longest sketch
    k = largest - F.ceil(largest * percent / 100).cast("long") + 1
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("_h", "_shingle"))
    return sets.withColumn("_place", place).filter(F.col("_place") <= k).select("item_id", "n_shingles", "_h")


def _places(docs: DataFrame, size: int) -> DataFrame:
    return exploded(docs.select("_id", "_t", words_of(F.col("text")).alias("_words")), ["_id", "_t"], size)


def candidates(docs: DataFrame, sketches: DataFrame, percent: int, size: int, broadcast_rows: int) -> DataFrame:
    """Distinct (_id, _t, item_id) of documents (_id, _t, text) that hold a hash of an item's sketch."""
    # a document's distinct shingles aren't counted yet; its places are as many at least
    n_places = F.greatest(F.size("_words") - size + 1, F.lit(1))
    places = _places(docs, size).select("_id", "_t", "_h", n_places.alias("_n"))
    if sketches.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = places.join(F.broadcast(sketches), "_h")
    else:
        met = salted_join(places, sketches, ["_h"], ["_id", "_t"])
    return met.filter(F.col("_n") * 100 >= F.col("n_shingles") * percent).select("_id", "_t", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, percent: int = 75, size: int = SIZE, broadcast_rows: int = 1_000_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_found, for every item in a document."""
    if not 0 < percent <= 100:
        raise ValueError("percent is above 0 and at most 100")
    item_words = items.select(id_key("item_id").alias("item_id"), words_of(F.col("text")).alias("_words"))
    sets = exploded(item_words, ["item_id"], size).select("item_id", "_h", shingle(size).alias("_shingle")).distinct()
    sizes = sets.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    sets = written(sets.join(sizes, "item_id"), "item-shingles")
    docs = docs.select(id_key().alias("_id"), F.xxhash64("text").alias("_t"), "text")
    found = written(candidates(docs, _sketches(sets, percent), percent, size, broadcast_rows), "contained-candidates")

    ids, wanted = found.select("_id", "_t").distinct(), found.select("item_id").distinct()
    ids = F.broadcast(ids) if ids.limit(broadcast_rows + 1).count() <= broadcast_rows else ids
    sets = sets.join(wanted, "item_id", "left_semi")
    held = _places(docs.join(ids, ["_id", "_t"], "left_semi"), size).select("_id", "_t", "_h", shingle(size).alias("_shingle"))
    if (sets.agg(F.sum(F.octet_length("_shingle") + 64)).first()[0] or 0) <= broadcast_bytes:
        hits = held.join(F.broadcast(sets), ["_h", "_shingle"])
    else:
        hits = salted_join(held, sets, ["_h", "_shingle"], ["_id", "_t"])
    hits = hits.select("_id", "_t", "item_id", "n_shingles", "_shingle").distinct().groupBy("_id", "_t", "item_id", "n_shingles").agg(F.count("*").alias("n_found"))
    out = hits.filter(F.col("n_found") * 100 >= F.col("n_shingles") * percent).join(found, ["_id", "_t", "item_id"], "left_semi")
    null = lambda c, name: F.when(F.col(c) != F.lit(-(2**63)), F.col(c)).alias(name)
    return out.select(null("_id", "doc_id"), null("item_id", "item_id"), "n_shingles", "n_found")
