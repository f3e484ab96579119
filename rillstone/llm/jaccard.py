"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct five-word shingles (a shorter text's whole sequence).  Sets
that are equal are one node.  With all shingles in one global order, two sets of a Jaccard
similarity of 75/100 or more share one of their prefixes' shingles: of n, the first
n - ceil(0.75 n) + 1.  The order puts commonly repeated shingles last, so few prefixes hold
one; any order is right, so the list of common shingles may be short: it is what tasks saw
repeatedly, summed up over all data, its `common` most frequent.

1. Documents with the same prefix and size are collapsed into one group.
2. Groups that share a prefix shingle are candidates.  Shingles are dealt out in packed blocks;
   short posting lists give their pairs, long ones pairs with their smallest group (a star).
   Pairs are filtered by size, then by the overlap that both prefixes still allow.
3. Pairs are expanded to members, and verified by their whole sets.
4. Linked nodes form components.  What the stars and the groups' representatives left out is
   then taken up: members of one posting list, or of one group, in different components, are
   compared likewise, so every pair of candidates is either in one component or was verified,
   and no link between components is lost.  Pairs inside a component are not made.

Case by case: a null text, or one without words, has size 0 and is its own component; rows that
repeat, and different texts of one id, are rows of their own, and one id's texts are linked only
if their sets are; a null id is an id below all others; an empty table gives no row; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillstone.sources.packaging import ship

from . import wordhash as wh
from .components import components
from .shared import NULL_ID, give_back, hot_join, id_key, salted_join, shuffle_parts, written

U = wh.U
LOW = U(2**63 - 1)
TOP = U(1) << U(63)
SIZE = 5
#: Posting lists up to this long give all their pairs.
SHORT = 2
#: Bytes of text whose words are held at once; a longer text is held alone.
RUN = 1 << 20
#: Groups of so many bytes leave much free memory in the worker that had them.
LARGE = 1 << 20


def shingles(column: pa.Array, size: int = SIZE) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, each row's shingle hashes, 63 bits, not distinct yet) of runs of rows."""
    for first, data, offsets in wh.texts(column, RUN):
        rows = len(offsets) - 1
        row, _, _, hashes = wh.words(data, offsets)
        grams, at = wh.grams(hashes, size) & LOW, wh.bounds(row, rows).tolist()
        out = []
        for i in range(rows):
            lo, hi = at[i], at[i + 1]
            if hi - lo >= size:
                out.append(grams[lo : hi - size + 1])
            else:
                out.append((wh.grams(hashes[lo:hi], hi - lo) ^ U(hi - lo)) & LOW if hi > lo else grams[:0])
        yield first, out


class Order:
    """The global order of shingles: common ones last, by hash otherwise."""

    def __init__(self, common: np.ndarray):
        self.common = np.sort(common)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.common & U((1 << 20) - 1)).astype(np.int64)] = True

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """Distinct keys in order; the top bit marks common shingles."""
        keys = np.unique(grams)
        if len(self.common):
            some = np.flatnonzero(self.maybe[(keys & U((1 << 20) - 1)).astype(np.int64)])
            if len(some):
                at = np.minimum(np.searchsorted(self.common, keys[some]), len(self.common) - 1)
                hit = some[self.common[at] == keys[some]]
                if len(hit):
                    keys[hit] |= TOP
                    keys.sort()
        return keys


def thrice(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys that `held`, which is emptied, has three times or more, and how often; the keys are copied once, and sorted in place."""
    keys = np.concatenate(held)
    held.clear()
    keys.sort()
    again, counts = np.unique(keys[2:][keys[2:] == keys[:-2]], return_counts=True)  # a key of n rows is here n - 2 times
    return again, counts.astype(np.int64) + 2


def common_shingles(docs: DataFrame, most: int, text: str, size: int, flush: int = 4_000_000) -> np.ndarray:
    """Up to `most` shingles that tasks saw three times or more among `flush`, the most frequent first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> pa.RecordBatch:
            keys, counts = thrice(held)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["k", "n"])

        for batch in batches:
            for _, rows in shingles(batch.column(0), size):
                held += rows
                n += sum(map(len, rows))
                if n >= flush:
                    yield out()
                    n = 0
        if held:
            yield out()
        give_back()

    found = docs.select(F.col(text).alias("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "k").limit(most).select("k").toArrow().column(0).to_numpy().astype(np.int64).view(U)


def sets(docs: DataFrame, order: Order, whole: bool, percent: int, text: str, size: int) -> DataFrame:
    """_id, _t (text hash), n, node, prefix (hash), last (key of the prefix), keys (of the prefix, or of the whole set) of each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in shingles(batch.column(2), size):
                keys = [order.keys(g) for g in rows]
                n = np.array([len(k) for k in keys])
                need = n - (n * percent + 99) // 100 + 1
                digest = lambda many: np.array([wh.mix(np.array([wh.mix((k & LOW) + U(1)).sum() + U(len(k))]))[0] if len(k) else U(0) for k in many], U).view(np.int64)
                prefixes = [k[:p] for k, p in zip(keys, need.tolist(), strict=True)]
                whole_digest = digest(keys)
                prefix = wh.mix(digest(prefixes).view(U) ^ n.astype(U)).view(np.int64)
                kept = keys if whole else prefixes
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first : first + len(rows)], batch.column(1)[first : first + len(rows)], pa.array(n, pa.int32()), pa.array(whole_digest), pa.array(prefix), pa.array([int(k[-1]) - 2**64 * (int(k[-1]) >> 63) if len(k) else 0 for k in prefixes], pa.int64()), pa.array([k.tobytes() for k in kept], pa.binary())],
                    names=["_id", "_t", "n", "node", "prefix", "last", "keys"],
                )
        give_back()

    return docs.select(id_key().alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("text")).mapInArrow(make, "_id long, _t long, n int, node long, prefix long, last long, keys binary")


def postings(groups: DataFrame, buckets: int, percent: int) -> DataFrame:
    """From (prefix, n, keys): packed blocks of postings, a row for each bucket of keys, so that a row isn't a key.

    Common keys, whose lists may be of any length, are dealt one row each (bucket -1: key, a, n,
    cap).  A posting's cap is the largest size of a set whose first shared key with this one it
    can be: at place i of n, as n - i shingles are left, and the overlap must reach its share.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                keys = [np.frombuffer(x.as_buffer(), U) for x in part.column(2)]
                lengths = [len(k) for k in keys]
                key = np.concatenate(keys) if keys else np.zeros(0, U)
                a = np.repeat(part.column(0).to_numpy(zero_copy_only=False), lengths)
                n = np.repeat(part.column(1).to_numpy(zero_copy_only=False), lengths).astype(np.int32)
                place = np.arange(len(key)) - np.repeat(np.cumsum([0, *lengths[:-1]]), lengths)
                more = (np.floor((n - place) * (100 + percent) / percent - n + 1e-6) - n).astype(np.int32)
                often = key >= TOP
                if often.any():
                    yield rows(np.full(int(often.sum()), -1, np.int32), key[often].view(np.int64), a[often], n[often], more[often])
                key, a, n, more = key[~often], a[~often], n[~often], more[~often]
                bucket = (key % U(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                ends = np.searchsorted(bucket[by], np.arange(buckets + 1)).tolist()
                key, a, n, more = key[by], a[by], n[by], more[by]
                full = [b for b in range(buckets) if ends[b + 1] > ends[b]]
                cut = lambda x: pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in full], pa.binary())  # noqa: E731, B023
                none = pa.nulls(len(full), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), none, none, *[pa.nulls(len(full), pa.int32())] * 2, cut(key), cut(a), cut(n), cut(more)], names=names)
        give_back()

    names = ["bucket", "key", "a", "n", "cap", "keys", "many_a", "many_n", "many_more"]

    def rows(bucket: np.ndarray, key: np.ndarray, a: np.ndarray, n: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(key), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key), pa.array(a), pa.array(n), pa.array(n + more), *[none] * 4], names=names)

    return groups.select("prefix", "n", "keys").mapInArrow(deal, "bucket int, key long, a long, n int, cap int, keys binary, many_a binary, many_n binary, many_more binary")


def matched(dealt: DataFrame, percent: int) -> DataFrame:
    """Pairs (kind 0: a, b) and members of long lists (kind 1: key, a, n, cap) of each bucket's blocks; kind 2: all keys that several groups have (key, a)."""

    def match(data: pa.Table) -> pa.Table:
        key = np.concatenate([np.frombuffer(x.as_buffer(), U) for c in data.column("keys").chunks for x in c])
        a = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for c in data.column("many_a").chunks for x in c])
        n = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for c in data.column("many_n").chunks for x in c])
        more = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for c in data.column("many_more").chunks for x in c])
        by = np.lexsort((a, key))
        key, a, n, cap = key[by], a[by], n[by], n[by] + more[by]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1])])  # equal rows count once
        key, a, n, cap = key[new], a[new], n[new], cap[new]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        twice = length > 1
        start, length = start[twice], length[twice]
        every = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
        # members that fit with none of their list are dropped from it
        own = np.repeat(np.arange(len(start)), length)
        if len(start):
            at = np.cumsum(length) - length
            smallest, widest = np.minimum.reduceat(n[every], at), np.maximum.reduceat(cap[every], at)
            fit = (cap[every] >= smallest[own]) & (n[every] <= widest[own])
        else:
            fit = np.zeros(0, bool)
        member, own = every[fit], own[fit]
        length = np.bincount(own, minlength=len(start))
        start = np.cumsum(length) - length  # in `member` from here on
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in range(2, SHORT + 1):  # all pairs of short lists
            at = start[length == size]
            for i in range(size):
                for j in range(i + 1, size):
                    left.append(member[at + i])
                    right.append(member[at + j])
        long = length > SHORT
        members = [member[s : s + x] for s, x in zip(start[long].tolist(), length[long].tolist(), strict=True)]
        for m in members:
            hub = m[np.lexsort((a[m], n[m]))[0]]
            left.append(np.full(len(m) - 1, hub))
            right.append(m[m != hub])
        left, right = np.concatenate(left), np.concatenate(right)
        x, y = a[left], a[right]
        fits = (n[left] <= cap[right]) & (n[right] <= cap[left]) & (x != y)
        pairs = np.unique(np.stack([np.minimum(x, y)[fits], np.maximum(x, y)[fits]]), axis=1)
        m = np.concatenate(members) if members else np.zeros(0, np.int64)
        p, many = pairs.shape[1], len(m)
        m = np.concatenate([m, every])
        return pa.table(
            {
                "kind": pa.array(np.repeat([0, 1, 2], [p, many, len(every)]), pa.int32()),
                "key": pa.array(np.concatenate([np.zeros(p, np.int64), key[m].view(np.int64)])),
                "a": pa.array(np.concatenate([pairs[0], a[m]])),
                "b": pa.array(np.concatenate([pairs[1], np.zeros(len(m), np.int64)])),
                "n": pa.array(np.concatenate([np.zeros(p, np.int32), n[m]])),
                "cap": pa.array(np.concatenate([np.zeros(p, np.int32), cap[m]])),
            }
        )

    return dealt.filter("bucket >= 0").groupBy("bucket").applyInArrow(lean(match), "kind int, key long, a long, b long, n int, cap int")


def lean(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """`f` of a group, after which a large group's memory is given back."""

    def run(data: pa.Table) -> pa.Table:
        out = f(data)
        if data.nbytes > LARGE:
            give_back()
        return out

    return run


def _need(x: np.ndarray, y: np.ndarray, percent: int) -> int:
    """The least overlap of sets of these sizes: percent of the union."""
    return -(-percent * (x + y) // (100 + percent))


def allowed(pairs: DataFrame, groups: DataFrame, percent: int, broadcast_ids: int = 1_000_000, block: int = 20_000) -> DataFrame:
    """Pairs of groups (a, b) whose prefixes allow the overlap that is needed."""
    pairs = written(pairs, "met", tidy=True)
    wanted = pairs.select(F.col("a").alias("prefix")).union(pairs.select(F.col("b").alias("prefix"))).distinct()
    wanted = written(wanted, "asked")
    if wanted.count() <= broadcast_ids:
        wanted = F.broadcast(wanted)
    groups = written(groups.join(wanted, "prefix", "left_semi").groupBy("prefix").agg(F.first("n").alias("n"), F.first("keys").alias("keys")), "sides")
    side = lambda c: groups.select(F.col("prefix").alias(c), F.col("n").alias(f"n_{c}"), F.col("keys").alias(f"keys_{c}"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (nx, kx, ny, ky) in enumerate(zip(*(batch.column(c) for c in ("n_a", "keys_a", "n_b", "keys_b")), strict=True)):
                nx, ny, x, y = nx.as_py(), ny.as_py(), np.frombuffer(kx.as_buffer(), U), np.frombuffer(ky.as_buffer(), U)
                last = min(x[-1], y[-1])  # up to here both prefixes hold all that the sets hold
                cx, cy = np.searchsorted(x, last, side="right"), np.searchsorted(y, last, side="right")
                both = len(np.intersect1d(x[:cx], y[:cy], assume_unique=True))
                good[i] = both + min(nx - cx, ny - cy) >= _need(nx, ny, percent)
            good = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])
        give_back()

    return hot_join(pairs, {"a": side("a"), "b": side("b")}, block).mapInArrow(test, "a long, b long")


#: Members of a long list that one task compares with each other, or with as many others.
BLOCK = 1000
#: Lists up to this long are compared together with the other lists of their least member.
FEW = 32


def _passing(left: np.ndarray, right: np.ndarray, n: np.ndarray, last: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many common keys of two prefixes allow the overlap that is needed: what ends first is all there is up to its end."""
    spare = n - (n - (n * percent + 99) // 100 + 1)
    rest = np.where(last[left] <= last[right], spare[left], spare[right])
    return both + rest >= -(-percent * (n[left] + n[right]) // (100 + percent))


_PAIRS = "a long, part_a long, b long, part_b long"


def crossed_short(placed: DataFrame, shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """As `crossed`, for lists of at most FEW members, with the least member of each list (`least`).

    The lists of near copies have mostly the same least member, so one task has them together,
    and each member's keys once.
    """
    spark = placed.sparkSession
    buckets = max(64, shuffle_parts(spark), placed.count() // 20_000)
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64("least"), F.lit(buckets)).cast("int"))
    own = rows.select("bucket", "a").distinct().join(groups.select(F.col("prefix").alias("a"), "last").distinct(), "a").join(shared, "a")
    none = lambda kind: F.lit(None).cast(kind)
    lists = rows.select("bucket", "a", "key", "n", "cap", "part_a", none("long").alias("last"), none("array<long>").alias("shared"))
    both = lists.union(own.select("bucket", "a", none("long"), none("int"), none("int"), none("long"), "last", "shared"))

    def cross(data: pa.Table) -> pa.Table:
        is_list = data.column("shared").is_null().to_numpy()
        member = data.filter(pa.array(~is_list))
        entries = data.filter(pa.array(is_list))
        ids = member.column("a").to_numpy()
        keys = [np.asarray(x.values, np.int64) for c in member.column("shared").chunks for x in c]
        by = np.argsort(ids)
        ids, last = ids[by], member.column("last").to_numpy()[by].view(U)
        keys = [keys[i] for i in by.tolist()]
        key, a, part = (entries.column(c).to_numpy() for c in ("key", "a", "part_a"))
        n, cap = entries.column("n").to_numpy().astype(np.int64), entries.column("cap").to_numpy()
        order = np.argsort(key, kind="stable")
        key, a, part, n, cap = key[order], a[order], part[order], n[order], cap[order]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lag in range(1, FEW):
            at = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(at):
                break
            left.append(at)
            right.append(at + lag)
        x, y = np.concatenate(left), np.concatenate(right)
        good = (part[x] != part[y]) & (a[x] != a[y]) & (n[x] <= cap[y]) & (n[y] <= cap[x])
        x, y = x[good], y[good]
        swap = a[x] > a[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        _, first = np.unique(np.stack([a[x], part[x], a[y], part[y]], 1), axis=0, return_index=True) if len(x) else (None, np.zeros(0, np.int64))
        x, y = x[first], y[first]
        place = np.searchsorted(ids, a)
        common = np.array([len(np.intersect1d(keys[i], keys[j], assume_unique=True)) for i, j in zip(place[x].tolist(), place[y].tolist(), strict=True)], np.int64)
        good = _passing(x, y, n, last[place] if len(a) else last, common, percent)
        x, y = x[good], y[good]
        return pa.table({"a": pa.array(a[x]), "part_a": pa.array(part[x]), "b": pa.array(a[y]), "part_b": pa.array(part[y])})

    return both.groupBy("bucket").applyInArrow(lean(cross), _PAIRS)


def crossed(placed: DataFrame, shared: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, part_a, b, part_b) of members of one list (key, a, n, cap, part_a) in different parts whose prefixes may allow a link.

    `shared` has each group's keys that other groups have too (a, shared), `groups` its prefix's
    last key.  A list is cut into blocks by hash, and each pair of blocks is a task of its own;
    common keys are counted there, by products of blocks of the incidence matrix, and only pairs
    that pass are given out, each by the list of its first common key.
    """
    sizes = placed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_blocks"))
    rows = salted_join(placed, sizes, ["key"], ["a"]).withColumn("_own", F.pmod(F.xxhash64("a", "part_a"), F.col("_blocks")).cast("int"))
    rows = rows.join(groups.select(F.col("prefix").alias("a"), "last").distinct(), "a").join(shared, "a")
    # a pair is given out by the list of its first common key, so keys before it don't count; the top bit orders last
    ordered = lambda x: x.bitwiseXOR(F.lit(-(2**63)))
    rows = rows.withColumn("shared", F.filter("shared", lambda x: ordered(x) >= ordered(F.col("key"))))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    rows = rows.select("key", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "a", "n", "cap", "part_a", "last", "shared")

    def cross(data: pa.Table) -> pa.Table:
        col = lambda c: data.column(c).to_numpy()
        key, i, j = (data.column(c)[0].as_py() for c in ("key", "i", "j"))
        key = np.int64(key).view(U)
        own, a, n, cap, part, last = col("_own"), col("a"), col("n").astype(np.int64), col("cap"), col("part_a"), col("last").view(U)
        p = n - (n * percent + 99) // 100 + 1
        keys = [np.sort(np.asarray(x.values, np.int64).view(U)) for c in data.column("shared").chunks for x in c]
        tokens, at, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        kept = times[at] > 1
        number = np.cumsum(times > 1) - 1
        row, token = np.repeat(np.arange(len(a)), [len(k) for k in keys])[kept], number[at[kept]]
        by = np.argsort(token, kind="stable")
        row, token = row[by], token[by]
        left = np.flatnonzero(own == i)
        right = left if i == j else np.flatnonzero(own == j)
        both = np.zeros((len(left), len(right)), np.float32)
        width = 4096
        for lo in range(0, int((times > 1).sum()), width):
            s, e = np.searchsorted(token, [lo, lo + width])
            m = np.zeros((len(a), min(width, int((times > 1).sum()) - lo)), np.float32)
            m[row[s:e], token[s:e] - lo] = 1
            both += m[left] @ m[right].T
        nx, ny = n[left][:, None], n[right][None, :]
        need = -(-percent * (nx + ny) // (100 + percent))
        # the prefix that ends first is all there is up to its end
        rest = np.where(last[left][:, None] <= last[right][None, :], (n - p)[left][:, None], (n - p)[right][None, :])
        good = (both + rest >= need) & (part[left][:, None] != part[right][None, :]) & (a[left][:, None] != a[right][None, :])
        good &= (nx <= cap[right][None, :]) & (ny <= cap[left][:, None])
        if i == j:
            good &= np.tri(len(left), k=-1, dtype=bool)
        out = [(left[x], right[y]) for x, y in zip(*np.nonzero(good), strict=True) if np.intersect1d(keys[left[x]], keys[right[y]], assume_unique=True)[0] == key]
        x, y = np.array(out, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a[x]), "part_a": pa.array(part[x]), "b": pa.array(a[y]), "part_b": pa.array(part[y])})

    return rows.groupBy("key", "i", "j").applyInArrow(lean(cross), _PAIRS)


def similar(pairs: DataFrame, full: DataFrame, percent: int, block: int = 20_000) -> DataFrame:
    """Pairs of nodes (u, v) whose whole sets have the similarity; full: node, keys."""
    side = lambda c: full.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (kx, ky) in enumerate(zip(batch.column("keys_u"), batch.column("keys_v"), strict=True)):
                x, y = np.frombuffer(kx.as_buffer(), U), np.frombuffer(ky.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * both >= percent * (len(x) + len(y) - both)
            good = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(good), batch.column("v").filter(good)], names=["u", "v"])
        give_back()

    return hot_join(pairs, {"u": side("u"), "v": side("v")}, block).mapInArrow(test, "u long, v long")


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y), F.greatest(x, y)]


def linked(docs: DataFrame, percent: int = 75, size: int = SIZE, common: int = 1 << 20, text: str = "text", broadcast_ids: int = 1_000_000, turns: int = 1) -> DataFrame:
    """doc_id, n_shingles, node, component_id (the least id reachable by links), text_hash, component of each row of `docs`.

    `component` is the least node of a component, and tells those of one id's different texts apart.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent is above 50 and at most 100")
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
    order = Order(common_shingles(docs, common, text, size))
    rows = written(sets(docs, order, False, percent, text, size), "sets", tidy=True)
    full_rows = rows.filter("n > 0")
    members = written(full_rows.groupBy("prefix", "node").agg(F.first("n").alias("n"), F.min("_id").alias("_id")), "members")
    hubs_of = members.groupBy("prefix").agg(F.min("node").alias("hub"))
    # one row stands for a group: all but it are dropped where the groups of several rows, and no prefixes, are known
    shared = full_rows.groupBy("prefix").agg(F.min(F.struct("_id", "node")).alias("_one"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    shared = written(shared, "shared")
    if shared.count() <= broadcast_ids:
        shared = F.broadcast(shared)
    groups = full_rows.join(shared, "prefix", "left").filter((F.col("_one").isNull()) | (F.struct("_id", "node") == F.col("_one"))).select("prefix", "n", "last", "keys")

    entries = groups.agg(F.sum(F.octet_length("keys"))).first()[0] or 0
    # at least 64, so that blocks are alike, and work spreads, at every size
    buckets = max(64, shuffle_parts(docs.sparkSession), int(entries / 8 / 1_000_000) + 1)
    dealt = postings(groups, buckets, percent)
    found = written(matched(dealt, percent), "found", tidy=True)
    often = written(dealt.filter("bucket < 0").select("key", "a", "n", "cap").distinct(), "often")
    # a common shingle's smallest group meets its others: one aggregate, combined before the shuffle
    hubs = written(often.groupBy("key").agg(F.min(F.struct("n", "a", "cap")).alias("hub"), F.count("*").alias("c")).filter("c > 1").drop("c"), "hubs")
    stars = salted_join(often, hubs, ["key"], ["a"]).filter((F.col("n") <= F.col("hub.cap")) & (F.col("hub.n") <= F.col("cap"))).select(*[c.alias(x) for c, x in zip(_ordered(F.col("a"), F.col("hub.a")), "ab", strict=True)])
    shared_often = written(salted_join(often, hubs.select("key"), ["key"], ["a"], "left_semi"), "shared-often")
    lists = found.filter("kind = 1").select("key", "a", "n", "cap").union(shared_often.select("key", "a", "n", "cap"))
    short = found.filter("kind = 0").select("a", "b")
    candidates = written(allowed(short.union(stars).filter("a <> b").distinct(), groups, percent), "candidates")

    ids = members.select("node", "_id")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (u, v) of nodes that are links."""
        pairs = written(pairs.select(*[c.alias(x) for c, x in zip(_ordered(F.col("u"), F.col("v")), "uv", strict=True)]).filter("u <> v").distinct(), "pairs")
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
        wanted = written(nodes.join(ids, "node").groupBy("_id").agg(F.collect_set("node").alias("nodes")), "wanted")
        wanted_ids = wanted.select("_id")
        if wanted_ids.count() <= broadcast_ids:
            wanted_ids = F.broadcast(wanted_ids)
        texts = docs.withColumn("_id", id_key()).join(wanted_ids, "_id", "left_semi")
        whole = sets(texts, order, True, percent, text, size).select("node", "keys")
        whole = written(whole.join(nodes, "node", "left_semi").groupBy("node").agg(F.first("keys").alias("keys")), "whole", tidy=True)
        return written(similar(pairs, whole, percent), "links")

    hub = lambda c: hubs_of.select(F.col("prefix").alias(c), F.col("hub").alias(f"hub_{c}"))
    first = candidates.join(hub("a"), "a").join(hub("b"), "b").select(F.col("hub_a").alias("u"), F.col("hub_b").alias("v"))
    # only groups of several nodes, so that few rows are repeated for the salts
    several = members.groupBy("prefix").agg(F.min("node").alias("hub"), F.max("node").alias("_top")).filter("hub <> _top").select("prefix", "hub")
    within = salted_join(members, several, ["prefix"], ["node"]).filter("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v"))
    links = verified(first.union(within))
    label = written(components(links), "labels")

    # A list's group that is in most lists, such as the text that others are edits of, meets those in other components.
    degree = lists.groupBy("a").agg(F.count("*").alias("d"))
    apart = (F.col("part_a") != F.col("part_b")) & (F.col("n") <= F.col("cap_b")) & (F.col("m") <= F.col("cap"))
    for turn in range(turns + 1):
        parts = written(members.join(label, "node", "left").select("prefix", "node", "n", F.coalesce("label", "node").alias("part")), "parts")
        kinds = written(parts.groupBy("prefix", "part").agg(F.min("node").alias("rep")), "kinds")
        placed = lists.join(kinds.select(F.col("prefix").alias("a"), F.col("part").alias("part_a")), "a")
        split = placed.groupBy("key").agg(F.min("part_a").alias("p"), F.max("part_a").alias("q"), F.min("n").alias("smallest"), F.max("cap").alias("widest")).filter("p <> q")
        placed = salted_join(placed, split, ["key"], ["a"]).filter("cap >= smallest and n <= widest").select("key", "a", "n", "cap", "part_a")
        placed = written(placed, "mixed", tidy=True)
        if turn == turns:
            break
        score = F.col("d") if turn == 0 else F.xxhash64(F.lit(turn), "a")
        heads = placed.join(degree, "a").groupBy("key").agg(F.max(F.struct(score.alias("d"), "a", F.col("n").alias("m"), "part_a", "cap")).alias("h"))
        heads = heads.select("key", F.col("h.a").alias("b"), F.col("h.m").alias("m"), F.col("h.part_a").alias("part_b"), F.col("h.cap").alias("cap_b"))
        met = written(salted_join(placed, heads, ["key"], ["a"]).filter(apart & (F.col("a") != F.col("b"))).select("a", "part_a", "b", "part_b").distinct(), "heads-met", tidy=True)
        met = met.join(written(allowed(met.select("a", "b").distinct(), groups, percent), "allowed"), ["a", "b"])
        rep = lambda c, x: kinds.select(F.col("prefix").alias(c), F.col("part").alias(f"part_{c}"), F.col("rep").alias(x))  # noqa: E731, B023
        more = verified(met.join(rep("a", "u"), ["a", "part_a"]).join(rep("b", "v"), ["b", "part_b"]).select("u", "v"))
        if not more.isEmpty():
            links = links.union(more)
            label = written(components(links), "labels")

    # What is left: candidates whose components differ.
    kind = lambda c: kinds.select(F.col("prefix").alias(c), F.col("part").alias(f"part_{c}"))
    across = candidates.join(kind("a"), "a").join(kind("b"), "b").filter("part_a <> part_b").select("a", "part_a", "b", "part_b")
    # parts of one group, which are few: its members have one prefix
    inside = kind("a").join(kinds.select(F.col("prefix").alias("a"), F.col("part").alias("part_b")), "a").filter("part_a < part_b").select("a", "part_a", F.col("a").alias("b"), "part_b")
    mixed = placed.select("a").distinct()
    common_keys = found.filter("kind = 2").select("a", "key").union(shared_often.select("a", "key"))
    common_keys = common_keys.join(mixed, "a", "left_semi").groupBy("a").agg(F.collect_set("key").alias("shared"))
    common_keys = written(common_keys, "shared-keys")
    sizes = written(placed.groupBy("key").agg(F.count("*").alias("c"), F.min("a").alias("least")), "sizes")
    few = placed.join(sizes.filter(F.col("c") <= FEW), "key").drop("c")
    many = placed.join(sizes.filter(F.col("c") > FEW).select("key"), "key")
    near = written(crossed_short(few, common_keys, groups, percent), "far-short", tidy=True)
    far = written(near.union(written(crossed(many, common_keys, groups, percent), "far-long", tidy=True)).distinct(), "far")
    far = far.join(written(allowed(far.select("a", "b").distinct(), groups, percent), "allowed"), ["a", "b"])
    pieces = across.union(inside).unionByName(far).distinct()
    member = lambda c, x: parts.select(F.col("prefix").alias(c), F.col("part").alias(f"part_{c}"), F.col("node").alias(x))
    more = verified(pieces.join(member("a", "u"), ["a", "part_a"]).join(member("b", "v"), ["b", "part_b"]).select("u", "v"))
    if not more.isEmpty():
        label = written(components(links.union(more)), "labels")

    keyed = salted_join(rows.select("_id", "_t", "n", "node"), label, ["node"], ["_id", "_t"], "left").withColumn("label", F.coalesce("label", "node"))
    least = keyed.filter("n > 0").groupBy("label").agg(F.min("_id").alias("least"))
    out = salted_join(keyed, least, ["label"], ["_id", "_t"], "left")
    null = lambda c: F.when(c != NULL_ID, c)
    return out.select(
        null(F.col("_id")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "node", null(F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("_id"))).alias("component_id"),
        F.col("_t").alias("text_hash"), F.col("label").alias("component"),
    )
