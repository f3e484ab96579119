"""Passages that repeat, by sparse suffix arrays.

A suffix is kept at each minimiser: a place whose run of `key` words hashes least among some
`span` neighbouring places.  Minimisers depend on content alone, so equal passages of
`key` + `span` - 1 = `words` words or more keep a suffix at the same place.

0. Equal texts are one text, with its least id; whole copies are known from that alone.
1. Suffixes (hash of the first `key` words, then of the next ones, document, place) are sorted
   by range partitions and compared with their neighbours.  Those that share their first `key`
   words with a neighbour are seeds.  The order ends with document and place, so a passage that
   a third of the documents share is split among partitions; a partition's first and last
   suffix, whose neighbours are elsewhere, are seeds too, as later steps are exact.
2. Seeds go back to their texts, and are extended left and right: every window of `words` words
   that holds a seed's key is hashed, and windows that occur at two places are repeated.  A
   window that repeats holds a minimiser that is a seed, so none is missed.  Windows are dealt
   by hash in packed blocks; of equal windows among some texts only the first is dealt.  Where a
   span may begin at another of them, that first is asked for the first of all texts.
3. Repeated windows that overlap or touch are merged to maximal spans of a text.  A window's
   first place (least document, text hash, place) is its original; the words of a span that lie
   in windows which aren't the first are duplicates.

Case by case: a null text, or one of fewer than `words` words, has no span; words are compared
after lower-casing from A to Z; a repeat within one document counts; rows with equal id and text
are one text; a null id is an id below all others; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.sources.packaging import ship

from . import wordhash as wh
from .shared import NULL_ID, id_key, salted_join, shuffle_parts, written

U = wh.U


def minimisers(grams: np.ndarray, span: int) -> np.ndarray:
    """Places of the least of every `span` neighbours (of equal ones, all)."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    least = wh.sliding(grams, span, least=True)
    edge = np.zeros(span - 1, U)
    return np.flatnonzero(wh.sliding(np.concatenate([edge, least, edge]), span, least=False) == grams)


def _suffixes(docs: DataFrame, key: int, span: int) -> DataFrame:
    """_a (hash of the first words), _b (of the next), _id, _t (text hash), _at of each kept suffix."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for first, data, offsets in wh.texts(batch.column(2)):
                row, _, _, hashes = wh.words(data, offsets)
                grams, at = wh.grams(hashes, key), wh.bounds(row, len(offsets) - 1).tolist()
                a, b, rows, places = [], [], [], []
                for i, (lo, hi) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if hi - lo >= key + span - 1:
                        own = grams[lo : hi - key + 1]
                        found = minimisers(own, span)
                        a.append(own[found])
                        after = found + key
                        b.append(np.where(after < len(own), own[np.minimum(after, len(own) - 1)], U(0)))
                        rows.append(np.full(len(found), first + i))
                        places.append(found)
                if a:
                    r = np.concatenate(rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64)), pa.array(ids[r]), pa.array(marks[r]), pa.array(np.concatenate(places).astype(np.int32))],
                        names=["_a", "_b", "_id", "_t", "_at"],
                    )

    return docs.mapInArrow(keep, "_a long, _b long, _id long, _t long, _at int")


def _seeds(suffixes: DataFrame) -> DataFrame:
    """Suffixes that share their first words with a neighbour in the sorted order."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # a batch's last suffix waits for the one after it
        shared, first = False, True
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches(([last] if last is not None else []) + [batch]).combine_chunks().to_batches()[0]
            a = batch.column(0).to_numpy(zero_copy_only=False)
            same = a[1:] == a[:-1]
            seed = np.concatenate([[shared], same]) | np.concatenate([same, [False]])
            seed[0] |= first
            n = batch.num_rows
            if n > 1:
                yield batch.slice(0, n - 1).filter(pa.array(seed[:-1])).select(["_id", "_t", "_at"])
                first = False
                shared = bool(same[-1])
            last = batch.slice(n - 1)
        if last is not None:
            yield last.select(["_id", "_t", "_at"])

    parts = shuffle_parts(suffixes.sparkSession)
    ordered = suffixes.repartitionByRange(parts, "_a", "_b", "_id", "_t", "_at").sortWithinPartitions("_a", "_b", "_id", "_t", "_at")
    return ordered.mapInArrow(compare, "_id long, _t long, _at int")


_NAMES = ["bucket", "a", "id", "t", "w", "later", "first", "at"]
_KINDS = (np.uint64, np.int64, np.int64, np.int32, np.int8, np.int64, np.int32)
_SCHEMA = "bucket int, " + ", ".join(f"{c} binary" for c in _NAMES[1:])


def _blocks(bucket: np.ndarray, buckets: int, columns: list[np.ndarray | None]) -> pa.RecordBatch:
    """A row for each bucket, its share of each column packed; `columns` in the order of _NAMES."""
    by = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
    full = [b for b in range(buckets) if ends[b + 1] > ends[b]]
    out = [pa.array(full, pa.int32())]
    for col in columns:
        if col is None:
            out.append(pa.nulls(len(full), pa.binary()))
        else:
            dealt = col[by]
            out.append(pa.array([dealt[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary()))
    return pa.RecordBatch.from_arrays(out, names=_NAMES)


def _unpacked(data: pa.Table, name: str) -> np.ndarray:
    kind = _KINDS[_NAMES.index(name) - 1]
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for c in data.column(name).chunks for x in c])


def _windows(docs: DataFrame, words: int, key: int, buckets: int) -> DataFrame:
    """Blocks of windows that hold a seed: (a, id, t, w, later) with a bucket by a; locally repeated ones beyond the first by id, with their first.

    `later` is 1 for a window that has such copies, and 3 if a span may begin at one of them.
    Those copies are in blocks without a bucket too, with the text hash of their first as `a`.
    """

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            seeds = batch.column(3)
            for first, data, offsets in wh.texts(batch.column(2)):
                row, _, _, hashes = wh.words(data, offsets)
                rows = len(offsets) - 1
                at, one = wh.bounds(row, rows).tolist(), wh.grams(hashes, words)
                picked, owner, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i in np.lexsort((marks[first : first + rows], ids[first : first + rows])).tolist():
                    count = at[i + 1] - at[i] - words + 1
                    if count <= 0:
                        continue
                    seed = np.asarray(seeds[first + i].values, np.int64)
                    change = np.zeros(count + 1, np.int64)
                    np.add.at(change, np.clip(seed - (words - key), 0, count), 1)
                    np.add.at(change, np.minimum(seed + 1, count), -1)
                    found = np.flatnonzero(np.cumsum(change[:-1]) > 0)
                    picked.append(at[i] + found)
                    owner.append(np.full(len(found), first + i))
                    places.append(found)
                p, r, w = np.concatenate(picked), np.concatenate(owner), np.concatenate(places).astype(np.int32)
                if not len(p):
                    continue
                a, doc, t = one[p], ids[r], marks[r]
                by = np.argsort(a, kind="stable")  # places stay in order
                a, doc, t, r, w = a[by], doc[by], t[by], r[by], w[by]
                new = np.concatenate([[True], a[1:] != a[:-1]])
                again = np.concatenate([~new[1:], [False]]) & new
                head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
                copy = ~new & ((doc != doc[head]) | (t != t[head]) | (w != w[head]))
                again = np.isin(np.arange(len(a)), head[copy]) & again
                # a span begins at a copy only if its text has no repeated window shortly before it
                place = np.argsort(by)  # in text order
                known = place[(copy | again)[place]]
                apart = np.concatenate([[True], (r[known][1:] != r[known][:-1]) | (np.diff(w[known]) > words)])[: len(known)]
                begins = known[apart]
                begins = begins[copy[begins]]
                again = again.astype(np.int8)
                again[head[begins]] = 3
                yield _blocks((a[new] % U(buckets)).astype(np.int64), buckets, [a[new], doc[new], t[new], w[new], again[new], None, None])
                if len(begins):
                    h = head[begins]
                    out = _blocks(np.zeros(len(h), np.int64), 1, [t[h], doc[begins], t[begins], w[begins], None, doc[h], w[h]])
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), *out.columns[1:]], names=_NAMES)
                if copy.any():
                    h = head[copy]
                    b = (wh.mix(t[copy].view(U)) % U(buckets)).astype(np.int64)
                    out = _blocks(b, buckets, [None, doc[copy], t[copy], w[copy], np.ones(len(h), np.int8), doc[h], w[h]])
                    yield pa.RecordBatch.from_arrays([pa.array(-1 - out.column(0).to_numpy()), *out.columns[1:]], names=_NAMES)

    return docs.mapInArrow(extend, _SCHEMA)


def _repeated(dealt: DataFrame, buckets: int) -> DataFrame:
    """Blocks, by text, of the windows that occur at two places, with their first; `later` is 2 more where it was asked for."""

    def match(data: pa.Table) -> pa.Table:
        a, doc, t, w, again = (_unpacked(data, c) for c in ("a", "id", "t", "w", "later"))
        by = np.lexsort((w, t, doc, a))
        a, doc, t, w, again = a[by], doc[by], t[by], w[by], again[by]
        new = np.concatenate([[True], a[1:] != a[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        later = (doc != doc[head]) | (t != t[head]) | (w != w[head])
        group = np.cumsum(new) - 1
        twice = np.bincount(group, later | (again > 0)) > 0
        kept = np.flatnonzero(twice[group])
        kept = kept[np.lexsort((w[kept], t[kept], doc[kept]))]
        h = head[kept]
        b = (wh.mix(t[kept].view(U)) % U(buckets)).astype(np.int64)
        return pa.Table.from_batches([_blocks(b, buckets, [None, doc[kept], t[kept], w[kept], later[kept] | (again[kept] & 2), doc[h], w[h]])])

    return dealt.filter("bucket >= 0").groupBy("bucket").applyInArrow(match, _SCHEMA)


_SPANS = ["_id", "_t", "start_word", "n_words", "n_duplicate", "first_doc_id", "first_word"]


def _spans(blocks: DataFrame, words: int) -> DataFrame:
    """Maximal spans of each text, and how many of a span's words are duplicates; with n_words 0, windows that were asked for their first."""

    def merge(data: pa.Table) -> pa.Table:
        doc, t, w, later, first, at = (_unpacked(data, c) for c in ("id", "t", "w", "later", "first", "at"))
        by = np.lexsort((at, first, w, t, doc))
        doc, t, w, later, first, at = doc[by], t[by], w[by].astype(np.int64), later[by], first[by], at[by]
        asked, later = later > 1, (later & 1) > 0
        zero = np.zeros(int(asked.sum()), np.int64)
        cols: list[list] = [x.tolist() for x in (doc[asked], t[asked], w[asked], zero, zero, first[asked], at[asked])]
        cut = np.flatnonzero((doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (np.diff(w) > words)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(w)], strict=True):
            begin, end = int(w[lo]), int(w[hi - 1]) + words
            over = np.zeros(end - begin + 1, np.int64)
            ws = w[lo:hi][later[lo:hi]] - begin
            np.add.at(over, ws, 1)
            np.add.at(over, ws + words, -1)
            for col, value in zip(cols, (doc[lo], t[lo], begin, end - begin, int((np.cumsum(over) > 0).sum()), first[lo], at[lo]), strict=True):
                col.append(int(value))
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(_SPANS, cols, strict=True)})

    return blocks.groupBy("bucket").applyInArrow(merge, ", ".join(f"{c} long" for c in _SPANS))


def _asked(dealt: DataFrame) -> DataFrame:
    """Copies at which a span may begin (_id, _t, start_word), and their first among some texts (_h, _ht, _hw)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = pa.Table.from_batches([batch])
                cols = [_unpacked(data, c) for c in ("id", "t", "w", "first", "a", "at")]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == U else x.astype(np.int64)) for x in cols], names=["_id", "_t", "start_word", "_h", "_ht", "_hw"])

    return dealt.filter("bucket is null").mapInArrow(unpack, "_id long, _t long, start_word long, _h long, _ht long, _hw long")


def repeats(docs: DataFrame, words: int = 50, key: int = 25, text: str = "text", broadcast_texts: int = 1_000_000) -> DataFrame:
    """doc_id, start_word, n_words, n_duplicate, first_doc_id, first_word of each repeated span.

    A span's places are in words of the text; `n_duplicate` of its words have an earlier original;
    `first_doc_id` and `first_word` are the original of the span's first window.
    """
    if not 1 <= key < words:
        raise ValueError("key is at least 1 and below words")
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(id_key().alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("text")).filter("text is not null")
    # equal texts: their least id stands for all
    copies = docs.select("_id", "_t").groupBy("_t").agg(F.min("_id").alias("_least"), F.max("_id").alias("_most")).filter("_least < _most").select("_t", "_least")
    copies = written(copies, "copies")
    few = copies.count() <= broadcast_texts
    mark = lambda rows, how: rows.join(F.broadcast(copies), "_t", how) if few else salted_join(rows, copies, ["_t"], ["_id"], how)
    kept = mark(docs, "left").filter("_least is null or _id = _least")
    suffixes = written(_suffixes(kept.select("_id", "_t", "text"), key, words - key + 1), "suffixes", tidy=True)
    seeds = written(_seeds(suffixes).groupBy("_id", "_t").agg(F.collect_set("_at").alias("_seeds")), "seeds", tidy=True)
    most = (seeds.agg(F.sum(F.size("_seeds"))).first()[0] or 0) * (words - key + 1)
    buckets = max(shuffle_parts(spark), int(most / 2_000_000) + 1)
    dealt = written(_windows(docs.join(seeds, ["_id", "_t"]).select("_id", "_t", "text", "_seeds"), words, key, buckets), "windows", tidy=True)
    near = dealt.filter("bucket < 0").withColumn("bucket", -1 - F.col("bucket"))
    found = written(_spans(_repeated(dealt, buckets).unionByName(near), words), "spans", tidy=True)
    firsts = found.filter("n_words = 0").select(F.col("_id").alias("_h"), F.col("_t").alias("_ht"), F.col("start_word").alias("_hw"), F.col("first_doc_id").alias("_first"), F.col("first_word").alias("_place"))
    heads = ["_h", "_ht", "_hw"]
    # a first among some texts has no more copies than those have
    answered = _asked(dealt).join(firsts.dropDuplicates(heads), heads).drop(*heads).dropDuplicates(["_id", "_t", "start_word"])
    spans = found.filter("n_words > 0").join(answered, ["_id", "_t", "start_word"], "left")
    spans = spans.withColumns({"first_doc_id": F.coalesce("_first", "first_doc_id"), "first_word": F.coalesce("_place", "first_word")}).select(*_SPANS)

    # a text with copies is a span as a whole
    many = mark(docs, "inner").withColumn("n_words", F.regexp_count("text", F.lit(r"[^ \x09-\x0D]+")).cast("long")).filter(F.col("n_words") >= words)
    many = many.select("_id", "_t", "_least", "n_words").distinct()
    parts = spans.select("_id", "_t", F.col("n_duplicate").alias("_d"), "first_doc_id", "first_word", "start_word")
    own = parts.groupBy("_t").agg(F.sum("_d").alias("_d"), F.min(F.struct("start_word", "first_doc_id", "first_word")).alias("_f"))
    begun = F.coalesce(F.col("_f.start_word") == 0, F.lit(False))
    whole = salted_join(many, own, ["_t"], ["_id"], "left").select(
        "_id", "_t", F.lit(0).cast("long").alias("start_word"), "n_words",
        F.when(F.col("_id") > F.col("_least"), F.col("n_words")).otherwise(F.coalesce("_d", F.lit(0))).alias("n_duplicate"),
        F.when(begun, F.col("_f.first_doc_id")).otherwise(F.col("_least")).alias("first_doc_id"),
        F.when(begun, F.col("_f.first_word")).otherwise(0).alias("first_word"),
    )
    out = spans.join(copies.select("_t"), "_t", "left_anti").select(*_SPANS).union(whole.select(*_SPANS))
    null = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return out.select(null("_id").alias("doc_id"), "start_word", "n_words", "n_duplicate", null("first_doc_id").alias("first_doc_id"), "first_word")
