"""Known answers and invariants of the core operators."""

import random
from collections import Counter, OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.functions import hashing
from rillstone.operators import cache, prefix, ranking, running, similarity, sketches
from rillstone.plans import pipeline, queries
from rillstone.sources import generators, scratch
from rillstone.streaming import streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# -- priorities -------------------------------------------------------------------------------


def queue(spark, seed, n):
    r = random.Random(seed)
    rows = [(f"p{i}", r.randrange(4), 50.0 + r.randrange(6), i) for i in range(n)]
    return rows, frame(spark, rows, "user string, priority int, t double, seq long").withColumn("ts", F.timestamp_seconds("t")).repartition(3)


def test_drain_order(spark):
    rows, events = queue(spark, 31, 120)
    got = ranking.drained(events).orderBy("position").select("user", "position").collect()
    want = sorted(rows, key=lambda x: (x[1], x[2], x[3]))
    assert [tuple(r) for r in got] == [(x[0], i + 1) for i, x in enumerate(want)]


def test_graded_drain_order(spark):
    rows, events = queue(spark, 32, 90)
    got = ranking.drained_graded(events).orderBy("position").select("user", "position").collect()
    want = sorted(rows, key=lambda x: (-x[1], x[3]))
    assert [tuple(r) for r in got] == [(x[0], i + 1) for i, x in enumerate(want)]


def test_equal_priorities_are_first_in_first_out(spark):
    rows = [(f"w{7 - i}", 1, 9.5, i) for i in range(8)]
    events = frame(spark, rows, "user string, priority int, t double, seq long").withColumn("ts", F.timestamp_seconds("t"))
    assert [r[0] for r in ranking.first_served(events, 6).select("user").collect()] == [f"w{7 - i}" for i in range(6)]


@pytest.mark.parametrize("bins", [1, 3, 50])
def test_numbers_follow_the_order(spark, bins):
    r = random.Random(bins)
    rows = [(i, r.choice([None, 0, 1, 1, 1, 5, 9]), r.randrange(3)) for i in range(300)]
    df = frame(spark, rows, "id long, v long, g int").repartition(4)
    got = {x["id"]: x["n"] for x in ranking.numbered(df, F.col("v"), ["v", "id"], "n", lead=["g"], bins=bins).collect()}
    want = sorted(rows, key=lambda x: (x[2], x[1] is not None, x[1] or 0, x[0]))
    assert got == {x[0]: i + 1 for i, x in enumerate(want)}


def test_empty_queue(spark):
    events = frame(spark, [], "user string, priority int, ts timestamp, seq long")
    assert ranking.drained(events).count() == 0 and ranking.first_served(events, 1).isEmpty()


@pytest.mark.parametrize("kind,premium,core,graded", [("payment", False, 0, 4), ("payment", True, 0, 4), ("play", True, 1, 3), ("play", False, 2, 1), ("search", None, 2, 2), ("chargeback", False, 2, 4), ("browse", True, 1, 1)])
def test_priority_rules(spark, kind, premium, core, graded):
    row = frame(spark, [(kind, premium)], "k string, p boolean").select(ranking.core_priority(F.col("k"), F.col("p")).alias("c"), ranking.graded_priority(F.col("k"), F.col("p")).alias("g"), ranking.priority_label(ranking.core_priority(F.col("k"), F.col("p"))).alias("l")).first()
    assert (row["c"], row["g"], row["l"]) == (core, graded, ("PAGO", "PREMIUM", "ESTÁNDAR")[core])


# -- caches -----------------------------------------------------------------------------------


def lru(trace, capacity, known=None):
    held, hits = OrderedDict(), []
    evictions = 0
    for k in trace:
        hits.append(k in held)
        if k in held:
            held.move_to_end(k)
        elif known is None or k in known:
            if len(held) >= capacity:
                held.popitem(last=False)
                evictions += 1
            held[k] = None
    return hits, list(reversed(held)), evictions


@pytest.mark.parametrize("capacity", [1, 3, 8])
def test_cache_against_replay(spark, capacity):
    r = random.Random(capacity)
    trace = [int(r.paretovariate(0.7)) % 25 for _ in range(400)]
    rows = frame(spark, list(enumerate(trace)), "seq long, item int").repartition(3)
    known = frame(spark, [(i,) for i in range(20)], "item int")
    for limit in (None, known):
        keep = None if limit is None else set(range(20))
        hits, held, evictions = lru(trace, capacity, keep)
        assert [x["hit"] for x in cache.hits(rows, capacity, known=limit).orderBy("seq").collect()] == hits
        played = cache.replay(rows, capacity, known=limit).orderBy("seq").collect()
        assert [x["hit"] for x in played] == hits and sum(x["evicted"] for x in played) == evictions
        assert [x["item"] for x in cache.residents(rows, capacity, known=limit).collect()] == held
    curve = {x["capacity"]: x["hits"] for x in cache.curve(rows, [1, 3, 8]).collect()}
    assert curve[capacity] == sum(lru(trace, capacity)[0]) and curve[1] <= curve[3] <= curve[8]


def test_cache_stats(spark):
    rows = frame(spark, [(0, "a"), (1, "a"), (2, "a"), (3, "x")], "seq long, item string")
    row = cache.stats(cache.replay(rows, 3), 3).first()
    assert (row["hits"], row["misses"], row["hit_rate"], row["size"], row["evictions"]) == (2, 2, 50.0, 2, 0)
    empty = cache.stats(cache.replay(rows.limit(0), 3), 3).first()
    assert (empty["hits"], empty["hit_rate"], empty["requests"]) == (0, 0.0, 0)
    assert [x["item"] for x in cache.most_recent(rows, 2).collect()] == ["x", "a"] and cache.most_recent(rows, 0).count() == 0


@pytest.mark.parametrize("capacity", [0, -1])
def test_bad_capacity(spark, capacity):
    with pytest.raises(ValueError):
        cache.hits(frame(spark, [], "seq long, item int"), capacity)


def test_cache_operations(spark):
    """Against a plain ordered dict, with every operation; looks don't refresh, a put of a held key evicts nothing."""
    r = random.Random(21)
    ops = [(i, r.choice(["get", "put", "put", "contains", "get", "put"] if i % 60 else ["reset", "clear"]), r.randrange(9)) for i in range(400)]
    held, hits, misses, want = OrderedDict(), 0, 0, []
    for _, op, k in ops:
        answer, gone = k in held, None
        if op in ("reset", "clear"):
            hits = misses = 0
            answer = None
            if op == "clear":
                held = OrderedDict()
        if op == "get":
            hits += answer
            misses += not answer
        if op == "put" and not answer:
            if len(held) == 4:
                gone, _ = held.popitem(last=False)
            held[k] = 1
        elif op in ("get", "put") and answer:
            held.move_to_end(k)
        want.append((answer, gone, len(held), hits, misses))
    rows = frame(spark, ops, "seq long, op string, item int").repartition(3)
    got = cache.operated(rows, 4).orderBy("seq").collect()
    assert [tuple(x)[3:] for x in got] == want
    assert cache.operated(rows.limit(0), 4).count() == 0
    with pytest.raises(Exception, match="unknown operation"):
        cache.operated(frame(spark, [(1, "steal", 2)], "seq long, op string, item int"), 4).collect()


def test_cache_stream_goes_on_from_its_state(spark):
    r = random.Random(9)
    trace = [r.randrange(12) for _ in range(200)]
    rows = frame(spark, list(enumerate(trace)), "seq long, item int")
    assert [x["hit"] for x in streams.cache_hits(rows, 5, parts=4).orderBy("seq").collect()] == lru(trace, 5)[0]


# -- sketches ---------------------------------------------------------------------------------


def test_cms_known_slots(spark):
    assert [hashing.row_seed(i) for i in range(3)] == [1, 2654435762, 5308871523]
    row = frame(spark, [("video1",)], "i string").select(sketches.cms_slots(F.col("i"), 1000, 5).alias("s")).first()["s"]
    assert [x["col"] for x in row] == [250, 528, 69, 598, 251]


def test_cms_never_underestimates(spark):
    r = random.Random(1)
    items = [str(int(r.paretovariate(0.6)) % 300) for _ in range(3000)]
    df = frame(spark, [(x,) for x in items], "item string")
    cells = sketches.cms_cells(df, "item", 50, 4)
    got = {x["item"]: x["estimate"] for x in sketches.cms_estimates(df, cells, "item", 50, 4).collect()}
    exact = Counter(items)
    assert set(got) == set(exact) and all(got[x] >= exact[x] for x in exact)
    weighted = frame(spark, [("video1", 5), ("video1", 3), ("video2", 1)], "item string, n long")
    cells = sketches.cms_cells(weighted, "item", 1000, 5, count="n")
    asked = frame(spark, [("video1",), ("never",)], "item string")
    assert {x["item"]: x["estimate"] for x in sketches.cms_estimates(asked, cells, "item").collect()} == {"video1": 8, "never": 0}
    with pytest.raises(ValueError):
        sketches.cms_cells(df, "item", 0, 4)


def test_top_k(spark):
    r = random.Random(33)
    sums = {f"k{i}": r.randrange(1000) for i in range(25)}
    rows = frame(spark, [(k, n, i) for i, (k, n) in enumerate(sums.items())], "item string, n long, seq long")
    want = sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:7]
    assert [tuple(x) for x in ranking.top_k(rows, "item", 7, weight="n").collect()] == want


def test_bloom_known_answers(spark):
    assert hashing.bloom_size(1000, 0.01) == (9586, 7) and hashing.bloom_size(10_000, 0.01) == (95_851, 7)
    assert hashing.bloom_size(100_000, 0.01) == (958_506, 7) and hashing.bloom_size(500_000, 0.001) == (7_188_794, 10)
    row = frame(spark, [("usuario_legit_001",)], "u string").select(sketches.bloom_slots(F.col("u"), 9586, 7).alias("b")).first()
    assert row["b"] == [2391, 1604, 9271, 2830, 5438, 7838, 9125]
    added = frame(spark, [(f"legit_{i}",) for i in range(1000)], "u string")
    bits = sketches.bloom_bits(added, "u", 9586, 7)
    assert sketches.bloom_contains(added, bits, "u", 9586, 7).filter("not contained").isEmpty()
    others = frame(spark, [(f"nuevo_{i}",) for i in range(10_000, 11_000)], "u string")
    assert sketches.bloom_contains(others, bits, "u", 9586, 7).filter("contained").count() == 9
    for n, p in ((0, 0.1), (10, 0), (10, 1)):
        with pytest.raises(ValueError):
            hashing.bloom_size(n, p)


def test_sequential_filter(spark):
    import hashlib

    r = random.Random(2)
    tokens = [f"t{r.randrange(500)}" for _ in range(600)]
    bits, held, want = 900, set(), []
    for t in tokens:
        own = {int(hashlib.sha256(f"{i}:{t}".encode()).hexdigest()[:16], 16) % bits for i in range(3)}
        want.append(own <= held)
        held |= own
    rows = frame(spark, list(enumerate(tokens)), "seq long, token string").repartition(3)
    assert [x["duplicate"] for x in sketches.bloom_flags(rows, "token", bits, 3).orderBy("seq").collect()] == want
    nulls = frame(spark, [(0, None), (1, "a"), (2, None), (3, "a")], "seq long, token string")
    assert [x["duplicate"] for x in sketches.bloom_flags(nulls, "token", bits, 3).orderBy("seq").collect()] == [False, False, False, True]
    exact = [x["duplicate"] for x in sketches.exact_flags(rows, "token").orderBy("seq").collect()]
    assert sum(want) > sum(exact) and all(w for w, e in zip(want, exact, strict=True) if e)


@pytest.mark.parametrize("stream,k,want", [("aabacadaeb", 3, {"a": 3, "b": 1}), ("abcabca", 3, {"a": 1}), ("aaabbc", 4, {"a": 3, "b": 2, "c": 1})])
def test_misra_gries_known(spark, stream, k, want):
    rows = frame(spark, list(enumerate(stream)), "seq long, item string").repartition(3)
    assert {x["item"]: x["n"] for x in sketches.misra_gries(rows, "item", k, seq="seq").collect()} == want


def test_misra_gries_bounds_of_merged_parts(spark):
    r = random.Random(7)
    items = [int(r.paretovariate(0.5)) % 200 for _ in range(4000)]
    rows = frame(spark, [(x,) for x in items], "item long").repartition(6)
    for k in (5, 20):
        got = {x["item"]: x["n"] for x in sketches.misra_gries(rows, "item", k).collect()}
        assert len(got) < k
        for x, n in Counter(items).items():
            assert n - len(items) / k <= got.get(x, 0) <= n


@pytest.mark.parametrize("kind,items", [("string", ["a", "b", "a"]), ("long", [1, 2, 1]), ("string", [])])
def test_misra_gries_with_parts_without_items(spark, kind, items):
    rows = frame(spark, [(i, x) for i, x in enumerate(items)] + [(9, None)], f"seq long, item {kind}").repartition(7)
    for seq in (None, "seq"):
        assert {x["item"]: x["n"] for x in sketches.misra_gries(rows, "item", 4, seq=seq).collect()} == Counter(items)


# -- prefixes ---------------------------------------------------------------------------------

TITLES = [("Harbour Lights", 71), ("Hollow Creek", 95), ("Moss", 33), ("Mosaic", 58), ("An Old Road", 64), ("An Odd Pair", 12)]


def catalogue(spark, extra=()):
    rows = [(t, p, i) for i, (t, p) in enumerate([*TITLES, *extra])]
    return prefix.catalogue(frame(spark, rows, "title string, popularity long, seq long"))


@pytest.mark.parametrize("asked,want", [("har", ["Harbour Lights"]), ("an", ["An Old Road", "An Odd Pair"]), ("MO", ["Mosaic", "Moss"]), ("h", ["Hollow Creek", "Harbour Lights"]), ("qqq", [])])
def test_autocomplete(spark, asked, want):
    assert [x["title"] for x in prefix.autocomplete(catalogue(spark), asked).collect()] == want


def test_catalogue_operations(spark):
    found = catalogue(spark, [("Paper Boats", 80), ("paper boats", 45)])
    assert found.count() == 7
    words = frame(spark, [("PAPER BOATS",), ("Absent",)], "word string")
    assert {x["word"]: x["popularity"] for x in prefix.lookup(words, found).collect()} == {"PAPER BOATS": 125, "Absent": None}
    left, told = prefix.deleted(found, frame(spark, [("Moss",), ("Nowhere",)], "word string"))
    assert left.count() == 6 and {x["word"]: x["existed"] for x in told.collect()} == {"Moss": True, "Nowhere": False}
    assert {x["prefix"]: x["found"] for x in prefix.any_with_prefix(found, ["har", "an", "qqq", ""]).collect()} == {"har": True, "an": True, "qqq": False, "": True}
    assert [x["title"] for x in prefix.autocomplete(found, "").collect()][0] == "paper boats" and prefix.autocomplete(found, "", empty_is_all=False).isEmpty()
    asked = frame(spark, [(" An ",), ("  ",), ("harbour li",), ("harbour lightsxx",)], "query string")
    got = [(x["query"], x["title"]) for x in prefix.suggestions(asked, found).orderBy("query", "rank").collect()]
    assert got == [(" An ", "An Old Road"), (" An ", "An Odd Pair"), ("harbour li", "Harbour Lights")]


# -- similarity -------------------------------------------------------------------------------


def sets(spark, **named):
    return frame(spark, [(k, m) for k, ms in named.items() for m in ms], "item string, member string")


def test_minhash_known_answers(spark):
    assert hashing.minhash_parameters(100)[:3] == [(1373158607, 794957572), (239081664, 762938025), (53710185, 449912919)]
    got = {x["item"]: x["signature"] for x in similarity.signatures(sets(spark, one="abcd", two="cdef")).collect()}
    assert got["one"][:3] == [1025956333, 708969780, 380837870] and got["two"][:3] == [735938347, 545037624, 1650658779]
    assert sum(a == b for a, b in zip(got["one"], got["two"], strict=True)) / 100 == 0.38


def test_lsh_finds_the_overlap(spark):
    u = [f"u{i}" for i in range(80)]
    rows = sets(spark, v1=u, v2=u[:70] + [f"n{i}" for i in range(10)], v3=[f"x{i}" for i in range(80)])
    signed = similarity.signatures(rows)
    (pair,) = similarity.similar(signed, threshold=0.1).collect()
    assert (pair["a"], pair["b"]) == ("v1", "v2") and abs(pair["similarity"] - 7 / 9) < 0.15
    assert [x["other"] for x in similarity.recommended(signed, frame(spark, [("v1",), ("none",)], "item string")).collect()] == ["v2"]
    stats = similarity.lsh_stats(signed).first()
    assert (stats["items"], stats["hashes"], stats["bands"], stats["rows"]) == (3, 100, 20, 5)


def test_jaccard(spark):
    rows = sets(spark, a="abcd", b="cdef", c="xyz", d="abcd")
    pairs = {(x["a"], x["b"]): x["jaccard"] for x in similarity.jaccard_pairs(rows).collect()}
    assert pairs[("a", "d")] == 1.0 and abs(pairs[("a", "b")] - 1 / 3) < 1e-9 and ("a", "c") not in pairs
    asked = frame(spark, [("a", "c"), ("e1", "e2")], "a string, b string")
    assert {x["a"]: x["jaccard"] for x in similarity.jaccard_of(asked, rows).collect()} == {"a": 0.0, "e1": 1.0}
    assert [(x["other"], x["jaccard"]) for x in similarity.top_exact(rows, frame(spark, [("a",)], "item string"), 3).orderBy("rank").collect()] == [("d", 1.0), ("b", pairs[("a", "b")]), ("c", 0.0)]


def random_sets(items, members, most):
    r = random.Random(5)
    return {f"i{k:02d}": set(r.sample([f"m{x}" for x in range(members)], r.randint(1, most))) for k in range(items)}


def brute(named, asked, k, allowed=lambda a, b: True):
    j = {(a, b): len(named[a] & named[b]) / len(named[a] | named[b]) for a in named for b in named if a != b}
    return {(a, rank, b, j[a, b]) for a in asked for rank, b in enumerate(sorted(sorted((b for b in named if b != a and allowed(a, b)), reverse=True), key=lambda b: -j[a, b])[:k], 1)}


def pairs_as_rows(found):
    """Joins of the plan that pair items, a row for each member or bucket that they share."""
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan.splitlines() if "Join" in x and ("member#" in x or "bucket#" in x)]


@pytest.mark.parametrize("members,most", [(8, 6), (300, 4)])
def test_top_exact_by_blocks(spark, monkeypatch, members, most):
    monkeypatch.setattr(similarity, "BLOCK", 7, raising=False)  # several blocks of queried items too
    named = random_sets(60, members, most)
    asked = [*list(named)[::3], "unknown", None]
    got = similarity.top_exact(sets(spark, **named), frame(spark, [(a,) for a in asked * 2], "item string"), 4)
    assert {(x["item"], x["rank"], x["other"], x["jaccard"]) for x in got.collect()} == brute(named, asked[:-2], 4)
    assert not pairs_as_rows(got)


@pytest.mark.parametrize("members,most", [(8, 6), (300, 4)])
def test_top_approximate_by_blocks(spark, monkeypatch, members, most):
    monkeypatch.setattr(similarity, "BLOCK", 7, raising=False)
    named = random_sets(60, members, most)
    asked = [*list(named)[::3], "unknown"]
    rows = sets(spark, **named)
    near = {(x["a"], x["b"]) for x in similarity.candidates(similarity.signatures(rows, 64), 64, 32).collect()}
    got = similarity.top_approximate(rows, frame(spark, [(a,) for a in asked], "item string"), 4)
    assert {(x["item"], x["rank"], x["other"], x["jaccard"]) for x in got.collect()} == brute(named, asked[:-1], 4, lambda a, b: (min(a, b), max(a, b)) in near)
    assert not pairs_as_rows(got)


def test_precision_of_searches(spark):
    named = random_sets(60, 12, 6)
    asked = frame(spark, [(a,) for a in list(named)[::3]], "item string")
    rows = sets(spark, **named)
    exact, near = similarity.top_exact(rows, asked, 4), similarity.top_approximate(rows, asked, 4, 8, 4)
    got = similarity.precision_at_k(exact, near, 4)
    best, found = ({(x["item"], x["other"]) for x in df.collect()} for df in (exact, near))
    hits = Counter(a for a, b in best if (a, b) in found)
    assert {(x["item"], x["hits"], x["precision"]) for x in got.collect()} == {(a, hits[a], round(hits[a] / 4, 6)) for a in list(named)[::3]}
    assert not pairs_as_rows(got) and 0 < sum(hits.values()) < 80


def test_precision_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    named = random_sets(60, 12, 6)
    asked = list(named)[::3]
    rows = sets(spark, **named)
    best, found = ({(x["item"], x["other"]) for x in df.collect()} for df in (similarity.top_exact(rows, frame(spark, [(a,) for a in asked], "item string"), 4), similarity.top_approximate(rows, F.col("item").isin(asked), 4, 8, 4)))
    raw = rows.unionByName(rows).unionByName(frame(spark, [("i00", None), (None, "m1"), ("i99", None)], "item string, member string"))  # rows as they come
    got = similarity.precision_of_searches(raw, F.col("item").isin([*asked, "i99"]), 4, 8, 4)
    hits = Counter(a for a, b in best if (a, b) in found)
    assert {(x["item"], x["hits"], x["precision"]) for x in got.collect()} == {(a, hits[a], round(hits[a] / 4, 6)) for a in asked}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and not pairs_as_rows(got)


def test_equal_sets_give_their_largest_items(spark):
    one, two = {"a", "b", "c"}, {"a", "b", "d", "e"}
    named = {f"i{k:02d}": one if k % 2 else two if k % 3 else {"z"} for k in range(40)}
    asked = ["i00", "i01", "i37", "i38", "i39"]
    got = similarity.top_exact(sets(spark, **named), F.col("item").isin(asked), 3)
    assert {(x["item"], x["rank"], x["other"], x["jaccard"]) for x in got.collect()} == brute(named, asked, 3)
    got = similarity.top_approximate(sets(spark, **named), F.col("item").isin(asked), 25, 64, 64)
    assert {(x["item"], x["rank"], x["other"], x["jaccard"]) for x in got.collect()} == brute(named, asked, 25, lambda a, b: bool(named[a] & named[b]))


def test_precision_parses_events_once(spark, tmp_path):
    rows = [(i, i % 4 * 50, f'{{"k": {i // 4 % 3}}}') for i in range(40)] + [(40, 50, None), (41, 50, "{"), (42, None, '{"k": 1}'), (43, 250, '{"k": "x"}')]
    frame(spark, [(i, None, u, "view", 1.0, p) for i, u, p in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = queries.QUERIES["precision_at_k"](spark, str(tmp_path))
    assert {(x["item"], x["hits"], x["precision"]) for x in got.collect()} == {(u, 3, 0.6) for u in (0, 50, 100, 150)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "get_json_object" in x]


def watched(spark, path):
    """Events of users whose ids 50 divides, and of others; some have seen the same. Returns each user's items."""
    r = random.Random(7)
    seen = {u: set(r.sample(range(9), r.randint(1, 5))) for u in [*range(1, 10), 50, 75, 100]}
    seen |= {u + 200: seen[1] for u in range(8)}  # more than 5 equal sets
    rows = [(0, None, u, "view", 1.0, f'{{"k": {m}}}') for u, ms in seen.items() for m in ms]
    frame(spark, rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{path}/events.parquet")
    return seen


def near_pairs(spark, seen):
    signed = similarity.signatures(frame(spark, [(u, m) for u, ms in seen.items() for m in ms], "item long, member int"), 64)
    return {(x["a"], x["b"]) for x in similarity.candidates(signed, 64, 32).collect()}


def test_precision_is_of_every_user(spark, tmp_path):
    seen = watched(spark, tmp_path)
    near = near_pairs(spark, seen)
    best = {(a, b) for a, _, b, _ in brute(seen, seen, 5)}
    found = {(a, b) for a, _, b, _ in brute(seen, seen, 5, lambda a, b: (min(a, b), max(a, b)) in near)}
    hits = Counter(a for a, b in best if (a, b) in found)
    got = queries.QUERIES["precision_at_k"](spark, str(tmp_path)).collect()
    assert len(got) == len(seen) and {(x["item"], x["hits"], x["precision"]) for x in got} == {(u, hits[u], round(hits[u] / 5, 6)) for u in seen}


def test_approximate_search_is_of_every_user(spark, tmp_path):
    seen = watched(spark, tmp_path)
    near = near_pairs(spark, seen)
    got = queries.QUERIES["top_approximate_users"](spark, str(tmp_path)).collect()
    want = brute(seen, seen, 5, lambda a, b: (min(a, b), max(a, b)) in near)
    assert {(x["item"], x["rank"], x["other"], x["jaccard"]) for x in got} == {(a, rank, b, round(j, 9)) for a, rank, b, j in want}


def test_exact_search_is_of_every_user(spark, tmp_path):
    seen = watched(spark, tmp_path)
    got = queries.QUERIES["top_exact_users"](spark, str(tmp_path)).collect()
    assert {(x["item"], x["rank"], x["other"], x["jaccard"]) for x in got} == {(a, rank, b, round(j, 9)) for a, rank, b, j in brute(seen, seen, 5)}


def test_best_of_rows():
    """The shortcuts of the search: few columns looked at first, near ones sought among the best first."""
    r = np.random.default_rng(4)
    for width, values in ((3, 4), (40, 3), (400, 1000), (400, 2)):
        score = r.integers(-1, values, (20, width)) / 7
        x, y = r.integers(0, 30, (2, 20)), r.integers(0, 30, (2, width))
        met = (x[:, :, None] == y[:, None]).any(0)
        top = lambda score, i, k: [(i, int(c)) for c in np.argsort(-score, kind="stable") if score[c] >= 0][:k]
        for k in (1, 6):
            p, q = similarity._best(score, k)
            assert list(zip(p.tolist(), q.tolist(), strict=True)) == [x for i in range(20) for x in top(score[i], i, k)]
            near = similarity._best_near(score, *similarity._best(score, 4 * k), x, y, k)
            assert sorted(zip(*map(np.ndarray.tolist, near), strict=True)) == sorted(x for i in range(20) for x in top(np.where(met[i], score[i], -1), i, k))


@pytest.mark.parametrize("members", ["long", "string", "double"])
def test_buckets_of_arrays(spark, members):
    rows = frame(spark, [(i, str(i * 7 % 5 + j)) for i in range(30) for j in range(i % 4 + 1)], "item long, member string").withColumn("member", F.col("member").cast(members))
    want = {}
    for x in similarity.buckets(similarity.signatures(rows, 9), 9, 3).collect():
        want.setdefault((x["band"], tuple(x["bucket"])), set()).add(x["item"])
    texts = rows.groupBy("item").agg(F.collect_list(F.col("member").cast("string").cast("binary")).alias("texts")).orderBy("item").toArrow()["texts"].combine_chunks()
    got = {}
    for band, numbers in enumerate(similarity._buckets(texts, 9, 3)):
        for item, number in enumerate(numbers.tolist()):
            got.setdefault((band, number), set()).add(item)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_top_exact_of_few_rows(spark):
    rows = frame(spark, [(1, 1), (2, 1), (None, 1)], "item long, member long")
    top = lambda rows, *asked: [tuple(x) for x in similarity.top_exact(rows, frame(spark, [(a,) for a in asked], "item long"), 5).select("item", "rank", "other", "jaccard").collect()]
    assert top(rows, 1, 9) == [(1, 1, 2, 1.0)] and top(rows) == top(rows.filter("item = 1"), 1) == top(rows.filter("item > 9"), 1) == []


@pytest.mark.parametrize("dense", [0, 50, 10**9])
def test_common_tokens(monkeypatch, dense):
    monkeypatch.setattr(similarity, "DENSE", dense)
    r = np.random.default_rng(3)
    has = r.random((30, 1500)) < r.random(1500) ** 4
    has[4] = False
    row, token = np.nonzero(has)
    left, right = np.array([3, 29, 4]), np.arange(29, -1, -1)
    want = has[left].astype(int) @ has[right].astype(int).T
    assert (similarity._common(row, token, left, right, flush=100) == want).all()
    assert not similarity._common(row[:0], token[:0], left, right).any()


def test_band_counts():
    assert hashing.bands_and_rows(100, 20) == (20, 5) and hashing.bands_and_rows(100, 30) == (33, 3)
    with pytest.raises(ValueError):
        hashing.bands_and_rows(10, 11)


# -- running counts and the pipeline ----------------------------------------------------------


def test_suspicious_batch(spark):
    rows = [(i, "shared_user:shared_title:bot" if i % 2 == 0 else f"token_{i}", "10.0.0.1") for i in range(5)]
    rows += [(i, f"again_{i}", "10.0.0.1") for i in range(5, 10)]
    got = running.anomalies(frame(spark, rows, "seq long, token string, ip string"), "token", "ip").orderBy("seq").collect()
    assert [x["duplicate"] for x in got[:5]] == [False, False, True, False, True]
    assert [x["exact"] for x in got] == list(range(1, 11)) and [x["anomalous"] for x in got] == [False] * 7 + [True] * 3


def test_outcomes(spark):
    rows = [(1, 1, 7, 0), (2, 1, 7, 10), (3, 1, 99, 20), (4, 2, 7, 30), (5, 1, 7, 90), (6, 2, 8, 95), (7, 3, None, 99)]
    events = frame(spark, [(s, s, u, "view", i, t) for s, u, i, t in rows], "seq long, event_id long, user_id long, event_type string, item int, t long").withColumn("ts", F.timestamp_seconds("t"))
    known = frame(spark, [(7, "Seven"), (8, "Eight")], "item int, title string")
    for exact in (True, False):
        for native in (True, False):
            got = pipeline.outcomes(events, known, pipeline.Settings(exact=exact, cache_capacity=5), native=native).orderBy("seq")
            assert [x["outcome"] for x in got.collect()] == ["miss", "duplicate", "unknown", "hit", "hit", "miss"]
    row = pipeline.totals(events, got).first()
    assert (row["queued"], row["plays"], row["duplicates"], row["unknown"], row["hits"], row["misses"], row["active_users"]) == (7, 4, 1, 1, 2, 2, 2)
    assert [tuple(x) for x in pipeline.trending(got, known).collect()] == [(7, "Seven", 3), (8, "Eight", 1)]
    with pytest.raises(ValueError):
        pipeline.Settings(cache_capacity=0)


def test_generators_do_not_depend_on_partitions(spark):
    one = generators.events(spark, generators.users(spark, 50), generators.videos(spark, 20), 500)
    rows = {tuple(map(str, r)) for r in one.collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert rows == {tuple(map(str, r)) for r in generators.events(spark, generators.users(spark, 50), generators.videos(spark, 20), 500).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    kinds = Counter(r["tipo"] for r in one.collect())
    assert len(rows) == 500 and 0.6 < kinds["stream"] / 500 < 0.8
    assert one.filter("tipo in ('search', 'payment') and video_id is not null").isEmpty()
    top = generators.access_stream(spark, 5000, 100, 1.2).groupBy("item").count().orderBy(F.desc("count")).first()
    assert top["item"] == 1 and abs(top["count"] / 5000 - 1 / sum(i**-1.2 for i in range(1, 101))) < 0.03
    assert generators.watch_histories(spark, 30).groupBy("user_id").count().filter("count > 20").isEmpty()
    assert generators.duplicate_events(spark, 2000).select("token").distinct().count() < 1990


def test_generated_users_and_videos(spark):
    users = generators.users(spark, 3000).collect()
    assert len({u["user_id"] for u in users}) == 3000 and abs(sum(u["tipo"] == "premium" for u in users) / 3000 - 0.35) < 0.04
    assert abs(sum(u["activo"] for u in users) / 3000 - 0.8) < 0.04 and {u["edad"] for u in users} == set(range(16, 66))
    assert {len(u["generos_favoritos"]) for u in users} == {2, 3, 4, 5} and all(len(set(u["generos_favoritos"])) == len(u["generos_favoritos"]) for u in users)
    assert {len(u["dispositivos"]) for u in users} == {1, 2, 3} and {u["fecha_registro"].year for u in users} == {2023}
    assert {g for u in users for g in u["generos_favoritos"]} == set(generators.GENRES) and {u["pais"] for u in users} == set(generators.COUNTRIES)
    videos = generators.videos(spark, 2000, titles=["First one", "Second"]).orderBy("video_id").collect()
    assert [v["titulo"] for v in videos[:3]] == ["First one", "Second", "Producción Original 0"]
    assert abs(sum(v["tipo"] == "serie" for v in videos) / 2000 - 0.6) < 0.04 and {v["anio"] for v in videos} == set(range(2015, 2025))
    for v in videos:
        low, high = (30, 60) if v["tipo"] == "serie" else (20, 180)
        assert low <= v["duracion_min"] <= high and 1 <= v["temporadas"] <= (5 if v["tipo"] == "serie" else 1)
        assert 5 <= v["calificacion_imdb"] <= 9.5 and 400 <= v["tamano_mb"] <= 2000 and 1_000_000 <= v["vistas_totales"] <= 150_000_000
    below = sum(v["vistas_totales"] < 2_000_000 for v in videos) / 2000
    assert abs(below - (1 - 2**-1.5)) < 0.04  # Pareto's law


def test_generated_events(spark):
    users, videos = generators.users(spark, 200), generators.videos(spark, 60)
    kinds = {u["user_id"]: u for u in users.collect()}
    rows = generators.events(spark, users, videos, 6000).collect()
    assert len({r["evento_id"] for r in rows}) == 6000
    shares = Counter(r["tipo"] for r in rows)
    assert all(abs(shares[k] / 6000 - w / 100) < 0.02 for k, w in generators.EVENT_WEIGHTS.items()) and set(shares) == set(generators.EVENT_WEIGHTS)
    for r in rows:
        user = kinds[r["user_id"]]
        assert r["user_type"] == user["tipo"] and (r["video_id"] is not None) == (r["tipo"] in generators.WITH_VIDEO)
        if r["tipo"] == "stream":
            assert r["datos"]["dispositivo"] in user["dispositivos"] and (r["datos"]["calidad"] != "4K" or user["tipo"] == "premium") and 1 <= int(r["datos"]["duracion_vista"]) <= 120
        if r["tipo"] == "payment":
            assert r["datos"]["monto"] == ("15.99" if user["tipo"] == "premium" else "9.99")
        if r["tipo"] == "search":
            assert r["datos"] == {"query": "Producción"}
    views = Counter(r["video_id"] for r in rows if r["video_id"])
    assert abs(views["vid_0000"] / sum(views.values()) - 1 / sum(i**-0.8 for i in range(1, 61))) < 0.02
    audience = generators.cowatch(users, videos).groupBy("video_id").count()
    assert audience.count() == 60 and audience.filter("count < 5").isEmpty()


def test_generated_titles(spark):
    titles = generators.catalogue_titles(spark, 3000)
    found = [r["title"] for r in titles.collect()]
    assert found == sorted(set(found)) and len(found) == 3000
    words = [t.split(" ") for t in found]
    for i, values in enumerate((generators.ADJECTIVES, generators.NOUNS, generators.SUFFIXES)):
        assert {w[i] for w in words} == set(values)
    assert all(1 <= int(w[3]) <= 999 for w in words) and len({w[3] for w in words}) > 500
    for count in (0, 10, 7000):
        asked = [r["query"] for r in generators.prefix_queries(titles, count).collect()]
        assert len(asked) == count and all(3 <= len(q) <= 10 for q in asked)
    assert {r["event_type"] for r in generators.stream_events(spark, 3000).collect()} == set(generators.STREAM_WEIGHTS)
    with pytest.raises(ValueError):
        generators.catalogue_titles(spark, 10**7)


def test_cumulative_weights(spark):
    rows = frame(spark, [(i, 1.0 / i) for i in range(1, 2501)], "rank long, weight double").repartition(4)
    got = [r["cumulative"] for r in running.cumulative_weights(rows, "rank", "weight", block=100).orderBy("rank").collect()]
    total, run = sum(1.0 / i for i in range(1, 2501)), 0.0
    for i, share in enumerate(got):
        run += 1.0 / (i + 1)
        assert abs(share - run / total) < 1e-9


def test_normalised_tokens(spark):
    row = frame(spark, [(" \tUser:Title\n", "\t10.0.0.1 ", None)], "t string, s string, n string").select(running.normalised_token(F.col("t")), running.normalised_source(F.col("s")), running.normalised_token(F.col("n"))).first()
    assert tuple(row) == ("user:title", "10.0.0.1", None)


def test_json_round_trip(spark, tmp_path):
    rows = frame(spark, [("é", [1, 2])], "name string, members array<int>")
    scratch.write_json(rows, str(tmp_path / "out"))
    assert scratch.read_json(spark, str(tmp_path / "out"), "name string, members array<int>").collect() == rows.collect()


def test_serving_order_of_a_stream(spark, tmp_path):
    rows = frame(spark, [(1, 1, "view"), (2, 3, "view"), (3, 2, "purchase")], "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id")).coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streams.served_in_order(stream, str(tmp_path / "out"), str(tmp_path / "marks"))
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("priority", "ts").collect()
    assert [x["event_id"] for x in got] == [3, 2, 1]
