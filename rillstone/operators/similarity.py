"""Set similarity: MinHash signatures, banded LSH, exact Jaccard, recommendations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.functions.hashing import PRIME, bands_and_rows, element, element_of, minhash_parameters
from rillstone.sources.packaging import ship

from .ranking import top_k_per_group


def members(rows: DataFrame, item: str, member: str, least: int = 1) -> DataFrame:
    """Distinct (item, member) of items with at least so many members."""
    pairs = rows.select(F.col(item).alias("item"), F.col(member).alias("member")).dropna().distinct()
    if least <= 1:
        return pairs
    large = pairs.groupBy("item").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least)
    return pairs.join(large.select("item"), "item", "left_semi")


def signatures(sets: DataFrame, hashes: int = 100, seed: int = 42) -> DataFrame:
    """(item, signature) from distinct (item, member): the least value of each function, 0 for a set without members."""
    x = element(F.col("member"))
    hashed = sets.select("item", x.alias("_x"))
    least = [F.coalesce(F.min((F.lit(a) * F.col("_x") + F.lit(b)) % PRIME), F.lit(0)).cast("long") for a, b in minhash_parameters(hashes, seed)]
    return hashed.groupBy("item").agg(F.array(*least).alias("signature"))


def estimate(x: Column, y: Column) -> Column:
    """The share of places at which two signatures agree; they must be of one length."""
    same = F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda z: z))
    return F.when(F.size(x) == F.size(y), same / F.size(x)).otherwise(F.raise_error(F.lit("signatures of different lengths")))


def buckets(signed: DataFrame, hashes: int, bands: int) -> DataFrame:
    """(item, band, bucket): the signature's rows of each band, as they are, so that no two buckets collide."""
    bands, rows = bands_and_rows(hashes, bands)
    cut = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.slice("signature", i * rows + 1, rows).alias("bucket")))
    return signed.select("item", F.inline(cut))


def candidates(signed: DataFrame, hashes: int = 100, bands: int = 20) -> DataFrame:
    """Distinct (a, b), a < b, that share a bucket."""
    rows = buckets(signed, hashes, bands)
    left, right = rows.withColumnRenamed("item", "a"), rows.withColumnRenamed("item", "b")
    return left.join(right, ["band", "bucket"]).filter(F.col("a") < F.col("b")).select("a", "b").distinct()


def similar(signed: DataFrame, hashes: int = 100, bands: int = 20, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity) of candidates whose estimate reaches the threshold before it is rounded."""
    pairs = candidates(signed, hashes, bands)
    side = lambda c: signed.select(F.col("item").alias(c), F.col("signature").alias(f"_{c}"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("_s", estimate(F.col("_a"), F.col("_b")))
    return scored.filter(F.col("_s") >= threshold).select("a", "b", F.round("_s", 4).alias("similarity"))


def lsh_stats(signed: DataFrame, hashes: int = 100, bands: int = 20) -> DataFrame:
    """One row: items, hashes, bands, rows of a band, distinct buckets."""
    b, r = bands_and_rows(hashes, bands)
    counts = signed.agg(F.count("*").alias("items"))
    used = buckets(signed, hashes, bands).agg(F.countDistinct("band", "bucket").alias("buckets"))
    return counts.crossJoin(used).select("items", F.lit(hashes).alias("hashes"), F.lit(b).alias("bands"), F.lit(r).alias("rows"), "buckets")  # two single rows


def _sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("item").agg(F.count("*").alias("n"))


def jaccard_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, jaccard) of given pairs: members of one side are looked up on the other."""
    n = _sizes(sets)
    side = lambda c: n.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}"))
    met = pairs.join(sets.select(F.col("item").alias("a"), "member"), "a").join(sets.select(F.col("item").alias("b"), "member"), ["b", "member"])
    both = met.groupBy("a", "b").agg(F.count("*").alias("both"))
    out = pairs.join(both, ["a", "b"], "left").join(side("a"), "a", "left").join(side("b"), "b", "left")
    both, na, nb = F.coalesce("both", F.lit(0)), F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    union = na + nb - both
    return out.select("a", "b", both.alias("both"), F.when(union == 0, F.lit(1.0)).otherwise(both / union).alias("jaccard"))


def jaccard_pairs(sets: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(a, b, both, jaccard), a < b, of all pairs that share a member: a sparse self-join on members."""
    n = _sizes(sets)
    met = sets.select(F.col("item").alias("a"), "member").join(sets.select(F.col("item").alias("b"), "member"), "member").filter(F.col("a") < F.col("b"))
    both = met.groupBy("a", "b").agg(F.count("*").alias("both"))
    side = lambda c: n.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}"))
    out = both.join(side("a"), "a").join(side("b"), "b")
    j = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    return out.withColumn("jaccard", j).filter(F.col("jaccard") >= threshold).select("a", "b", "both", "jaccard")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair from either side, as (item, other)."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    one = pairs.select(F.col("a").alias("item"), F.col("b").alias("other"), *rest)
    return one.unionByName(pairs.select(F.col("b").alias("item"), F.col("a").alias("other"), *rest))


def recommended(signed: DataFrame, items: DataFrame | None = None, k: int = 10, hashes: int = 100, bands: int = 20, threshold: float = 0.1) -> DataFrame:
    """(item, rank, other, similarity): the `k` most similar of each item; items that aren't known have none."""
    pairs = both_ways(similar(signed, hashes, bands, threshold))
    if items is not None:
        pairs = pairs.join(items.select("item").distinct(), "item", "left_semi")
    return top_k_per_group(pairs, ["item"], [F.desc("similarity"), F.col("other")], k).select("item", "rank", "other", "similarity")


#: One task compares about so many queried sets with about so many others, and holds about so many members of either.
BLOCK, MEMBERS = 1 << 14, 1 << 20
#: It holds the common members of so many pairs at a time.
STRIP = 1 << 24
#: Blocks of other sets, and tasks that compare, at least, so that work spreads at every size.
SPREAD = 8
#: A token of more than one in so many pairs of rows is counted by a product of matrices.
DENSE = 50


def _tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, token) of each value; equal values have equal tokens."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)


def _buckets(lists: pa.Array, hashes: int, bands: int) -> np.ndarray:
    """A row of bucket numbers for each row of members, of each band one; equal numbers of a band are equal buckets of `buckets`."""
    bands, width = bands_and_rows(hashes, bands)
    sizes, coded = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten().dictionary_encode()
    x, at, full = np.array([element_of(m) for m in coded.dictionary.to_pylist()], np.uint64), coded.indices.to_numpy(zero_copy_only=False), sizes > 0
    signed = np.zeros((hashes, len(sizes)), np.int64)
    if len(at):
        starts = (np.cumsum(sizes) - sizes)[full]
        for i, (a, b) in enumerate(minhash_parameters(hashes)):
            signed[i, full] = np.minimum.reduceat(((np.uint64(a) * x + np.uint64(b)) % np.uint64(PRIME)).astype(np.int64)[at], starts)
    kind = np.uint16 if len(sizes) <= 1 << 16 else np.uint32
    out = np.zeros((bands, len(sizes)), kind)
    for band in range(bands):
        for column in signed[band * width : (band + 1) * width]:  # numbers of the columns so far are below 2**32, hashes below 2**31
            out[band] = np.unique(out[band].astype(np.int64) << 31 | column, return_inverse=True)[1].reshape(-1)
    return out


def _first(row: np.ndarray, column: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (row, column) the `k` of each row with the largest scores, of equal ones the first, in that order."""
    order = np.lexsort((column, -score, row))
    row, column = row[order], column[order]
    take = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[take], column[take]


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `k` largest of each row, of equal ones the first, in that order; none below 0."""
    width = score.shape[1]
    if width > 8 * k:  # the k-th largest of some columns is no larger than that of all
        some = width // 8
        row, column = np.nonzero(score >= np.maximum(np.partition(score[:, :some], some - k, axis=1)[:, some - k, None], 0))
        if 8 * len(row) <= score.size:
            return _first(row, column, score[row, column], k)
    take = score >= 0
    if width > k:
        least = np.partition(score, width - k, axis=1)[:, width - k, None]
        above, tie = score > least, score == least
        take &= above | (tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - above.sum(1, keepdims=True)))
    row, column = np.nonzero(take)
    return _first(row, column, score[row, column], k)


def _best_near(score: np.ndarray, row: np.ndarray, column: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """As `_best`, but of pairs that share a bucket of `x` (of rows) and `y` (of columns).

    They are sought among each row's best, (`row`, `column`), and where fewer than `k` of these do, among all.
    """
    met = (x[:, row] == y[:, column]).any(0)
    row, column = row[met], column[met]
    row, column = _first(row, column, score[row, column], k)
    few = np.bincount(row, minlength=len(score)) < k
    again = np.flatnonzero(few)
    if not len(again):
        return row, column
    met = np.zeros((len(again), score.shape[1]), bool)
    for band in range(len(x)):
        met |= x[band, again, None] == y[band]
    r, c = _best(np.where(met, score[again], -1), k)
    return np.concatenate([row[~few[row]], again[r]]), np.concatenate([column[~few[row]], c])


def _common(row: np.ndarray, token: np.ndarray, left: np.ndarray, right: np.ndarray, flush: int = 4_000_000) -> np.ndarray:
    """How many tokens each of the rows `left` shares with each of the rows `right`.

    Frequent tokens are counted by products of incidence matrices, the others pair by pair.
    """
    tokens = int(token.max(initial=-1)) + 1

    def side(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        place = np.full(int(row.max(initial=-1)) + 1, -1)
        own = rows < len(place)
        place[rows[own]] = np.flatnonzero(own)
        here = place[row] >= 0
        return place[row[here]], token[here], np.bincount(token[here], minlength=tokens)

    (x, tx, cx), (y, ty, cy) = side(left), side(right)
    both = np.zeros((len(left), len(right)), np.float32 if len(row) < 1 << 24 else np.float64)  # whole numbers, exact in either
    often = cx * cy * DENSE > len(left) * len(right)
    number, last = np.cumsum(often) - 1, int(often.sum())
    for lo in range(0, last, 1024):

        def incidence(at: np.ndarray, t: np.ndarray, rows: int) -> np.ndarray:
            some = often[t] & (number[t] >= lo) & (number[t] < lo + 1024)  # noqa: B023
            out = np.zeros((rows, min(1024, last - lo)), both.dtype)  # noqa: B023
            out[at[some], number[t[some]] - lo] = 1  # noqa: B023
            return out

        both += incidence(x, tx, len(left)) @ incidence(y, ty, len(right)).T
    rare = np.where(often, 0, cy)
    some = rare[tx] > 0
    x, tx = x[some], tx[some]
    some = rare[ty] > 0
    y = y[some][np.argsort(ty[some], kind="stable")]
    start, times = np.cumsum(rare) - rare, rare[tx]
    ends, flat, lo = np.cumsum(times), both.reshape(-1), 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + flush)))
        n = times[lo:hi]
        at = np.repeat(start[tx[lo:hi]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(flat, np.repeat(x[lo:hi] * len(right), n) + y[at], both.dtype.type(1))
        lo = hi
    return both


def _whole(sets: DataFrame) -> DataFrame:
    """(item, n, members) of items with members, of rows (item, member) that may come again; members are sorted."""
    # nulls are left out by the set, not by a filter, for which members would be computed twice
    whole = sets.filter(F.col("item").isNotNull()).groupBy("item").agg(F.sort_array(F.collect_set("member")).alias("members"))
    return whole.select("item", F.size("members").alias("n"), "members").filter("n > 0")


#: Of these types Python gives the text that Spark's cast to string gives.
PLAIN = ("tinyint", "smallint", "int", "bigint", "string")


def _nearest(sets: DataFrame, queries: DataFrame | Column | None, k: int, hashes: int = 0, bands: int = 0, both: bool = False) -> DataFrame:
    """(item, exact, near): arrays of (jaccard, other), the `k` most similar to each queried item, the best first.

    `queries` has items, or is a condition on them; without it every item is queried.  `near` has
    those sought among LSH candidates with `hashes`, and is empty without; `exact` has those among
    all without `hashes`, or with `both`.

    Items of equal sets have the same similarities, so each different set is compared once, with
    each different set, and stands for the `k` + 1 largest of its items: no more can be among the
    best.  Each item then takes its set's `k` + 1 best, less itself.  Queried sets and others are
    cut into blocks by hash.  A task compares one block of either: it counts the common members of
    all their pairs in matrices and gives out one row of each queried set, so pairs are never rows.
    The others are sent once for each block of queried sets, which are sent once for each block of
    others.
    """
    ship(sets.sparkSession)
    whole = _whole(sets)
    if queries is None or isinstance(queries, Column):
        whole = whole.withColumn("_asked", F.lit(True) if queries is None else F.coalesce(queries, F.lit(False)))
    else:
        whole = whole.join(queries.select("item").distinct().withColumn("_asked", F.lit(True)), "item", "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    keyed = whole.select("item", "members", "_asked", F.xxhash64("members").alias("_set"))
    largest = top_k_per_group(keyed, ["_set", "members", "_asked"], [F.desc("item")], k + 1)  # of queried items and of others, so that a queried set is known as such
    same = largest.groupBy("_set", "members").agg(F.slice(F.sort_array(F.collect_list("item"), False), 1, k + 1).alias("items"), F.max("_asked").alias("_asked"))
    same = same.withColumns({"id": F.col("items")[0], "n": F.size("members")})
    parts = lambda here, least: F.greatest(F.lit(least), F.ceil(F.count_if(here) / BLOCK), F.ceil(F.coalesce(F.sum(F.when(here, F.col("n"))), F.lit(0)) / MEMBERS)).cast("int")
    cut = same.agg(parts(F.col("_asked"), 1).alias("_is"), parts(F.lit(True), SPREAD).alias("_js"))
    own = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    place = lambda i, j, queried: F.struct(i.alias("i"), j.alias("j"), F.lit(queried).alias("queried"))
    every = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    as_asked = F.transform(every("_js"), lambda j: place(own("_is"), j, True))
    as_other = F.transform(every("_is"), lambda i: place(i, own("_js"), False))
    plain = sets.schema["member"].dataType.simpleString() in PLAIN
    texts = [F.transform("members", lambda m: m.cast("string").cast("binary")).alias("texts")] if hashes and not plain else []
    rows = same.crossJoin(F.broadcast(cut)).select("id", "items", "n", "members", *texts, F.inline(F.when(F.col("_asked"), F.concat(as_asked, as_other)).otherwise(as_other)))  # cut is one row
    kind = sets.schema["item"].dataType.simpleString()

    def compare(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        column = lambda c: data.column(c).chunk(0)
        ids, items, n, queried = column("id"), column("items"), column("n").to_numpy(), column("queried").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(queried), np.flatnonzero(~queried)
        right = right[pc.array_sort_indices(ids.take(pa.array(right)), order="descending").to_numpy()]  # of equal ones the larger come first
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        exact, near = [none], [none]
        if len(left) and len(right):
            tokens = _tokens(column("members"))
            if hashes:
                lists = column("members" if plain else "texts")
                at = _buckets(lists.cast(pa.list_(pa.string())).cast(pa.list_(pa.binary())) if plain else lists, hashes, bands)
                y = at[:, right]
            strip, step = max(1, STRIP // len(right)), max(1, (1 << 18) // len(right))
            for start in range(0, len(left), strip):
                common = _common(*tokens, left[start : start + strip], right)
                for lo in range(0, len(common), step):
                    b = common[lo : lo + step].astype(np.float64)
                    these = left[start + lo : start + lo + len(b)]
                    jaccard = b / (n[these, None] + n[right] - b)
                    p, q = _best(jaccard, (4 if hashes else 1) * (k + 1))
                    if hashes:
                        r, c = _best_near(jaccard, p, q, at[:, these], y, k + 1)
                        near.append((start + lo + r, right[c], jaccard[r, c]))
                    if both or not hashes:
                        p, q = _first(p, q, jaccard[p, q], k + 1)
                        exact.append((start + lo + p, right[q], jaccard[p, q]))

        def lists_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Array:
            p, q, jaccard = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.argsort(p, kind="stable")
            others = items.take(pa.array(q[order]))
            times = pc.list_value_length(others).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(np.bincount(p[order], times, len(left)))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(np.repeat(jaccard[order], times)), others.flatten()], ["jaccard", "other"])
            return pa.ListArray.from_arrays(pa.array(ends), pairs)

        return pa.table({"id": ids.take(pa.array(left)), "exact": lists_of(exact), "near": lists_of(near)})

    tasks = max(SPREAD, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # small rows, long work: not to be merged
    pairs = f"array<struct<jaccard: double, other: {kind}>>"
    found = rows.repartition(tasks, "i", "j").groupBy("i", "j").applyInArrow(compare, f"id {kind}, exact {pairs}, near {pairs}")
    merged = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), False), 1, k + 1).alias(c)
    best = found.groupBy("id").agg(merged("exact"), merged("near"))
    of_sets = same.select("id", "_set", "members").join(best, "id")
    rest = lambda c: F.slice(F.filter(c, lambda x: x["other"] != F.col("item")), 1, k).alias(c)
    return keyed.filter("_asked").join(of_sets, ["_set", "members"]).select("item", rest("exact"), rest("near"))


def _ranked(found: DataFrame, best: str) -> DataFrame:
    """(item, rank, other, jaccard) of an array of `_nearest`."""
    return found.select("item", F.posexplode(best).alias("_at", "_o")).select("item", (F.col("_at") + 1).alias("rank"), "_o.other", "_o.jaccard")


def top_exact(sets: DataFrame, queries: DataFrame | Column | None = None, k: int = 5) -> DataFrame:
    """(item, rank, other, jaccard): the `k` most similar to each queried item, ties by larger id.

    `sets` has rows (item, member), any number of times; `queries` has items, or is a condition on
    them, and without it every item is queried.
    Items that share no member have similarity 0 and fill up what is missing.
    """
    return _ranked(_nearest(sets, queries, k), "exact")


def top_approximate(sets: DataFrame, queries: DataFrame | Column | None = None, k: int = 5, hashes: int = 64, bands: int = 32) -> DataFrame:
    """(item, rank, other, jaccard): as `top_exact`, but among LSH candidates only, ranked by exact similarity."""
    return _ranked(_nearest(sets, queries, k, hashes, bands), "near")


def precision_at_k(exact: DataFrame, approx: DataFrame, k: int) -> DataFrame:
    """(item, hits, precision): how many of each item's exact `k` are among its approximate ones."""
    hits = exact.select("item", "other").join(approx.select("item", "other").withColumn("_hit", F.lit(1)), ["item", "other"], "left")
    return hits.groupBy("item").agg(F.count("_hit").alias("hits"), F.round(F.count("_hit") / F.lit(k), 6).alias("precision"))


def precision_of_searches(sets: DataFrame, queries: DataFrame | Column | None = None, k: int = 5, hashes: int = 64, bands: int = 32) -> DataFrame:
    """`precision_at_k` of `top_exact` and `top_approximate`; each pair is counted once for both."""
    found = _nearest(sets, queries, k, hashes, bands, both=True).filter(F.size("exact") > 0)
    hits = F.size(F.array_intersect(F.col("exact.other"), F.col("near.other"))).cast("long")
    return found.select("item", hits.alias("hits"), F.round(hits / F.lit(k), 6).alias("precision"))


def swapped(sets: DataFrame, out: DataFrame, into: DataFrame) -> DataFrame:
    """A set less some members, with others added."""
    return sets.join(out, ["item", "member"], "left_anti").unionByName(into.select("item", "member")).distinct()


def ranked_together(exact: DataFrame, approx: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(rank, exact, exact_n, approx, approx_n): two top lists side by side; lists are short."""
    order = Window.orderBy(F.desc(n), key)
    side = lambda df, c: df.select(F.row_number().over(order).alias("rank"), F.col(key).alias(c), F.col(n).alias(f"{c}_n"))
    return side(exact, "exact").join(side(approx, "approx"), "rank", "full")
