import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from rillstone.llm import jaccard

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size=5):
    words = WORDS.findall(lowered(text))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        key = find(i)
        least[key] = min(least.get(key, doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)]) for i, (doc, _) in enumerate(rows))


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocab) for _ in range(30)]
    texts = []
    for i in range(n):
        kind = r.random()
        if texts and kind < 0.5:  # edits of an earlier text, so that chains and stars form
            words = r.choice(texts[-12:] if kind < 0.3 else texts[:3]).split(" ")
            for _ in range(r.randint(0, max(1, len(words) // 25))):
                at = r.randrange(len(words))
                words[at : at + r.randint(0, 2)] = [r.choice(vocab)] * r.randint(0, 2)
        else:
            words = [r.choice(vocab) for _ in range(r.choice((3, 8, 40, 120)))]
            if r.random() < 0.4:
                words[1:1] = passage
        texts.append(" ".join(words))
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed,common", [(1, 1 << 18), (2, 1 << 18), (3, 0), (4, 40)])
def test_against_brute_force(spark, seed, common):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.linked(docs, common=common).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_rows(spark):
    a = " ".join(f"x{i}" for i in range(40))
    rows = [(5, None, 1), (6, "", 1), (7, " \n", 1), (8, "One two", 1), (9, "one\tTWO", 1), (2, a, 1), (2, a, 1), (4, a.upper(), 1), (None, a, 1), (11, "two one", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted((tuple(r) for r in jaccard.linked(docs).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 1, 8), (9, 1, 8), (2, 36, None), (2, 36, None), (4, 36, None), (None, 36, None), (11, 1, 11)], key=str)


def test_empty(spark):
    assert jaccard.linked(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("common", [0, 1 << 18])
def test_size_bounds_of_very_long_texts(spark, common):
    """Sizes above 100,000 that differ by more than 32,767, of a similarity above 0.75; a copy makes shared shingles common."""
    words = [f"w{i}" for i in range(155_004)]
    rows = [(3, " ".join(words[:120_004])), (5, " ".join(words)), (7, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.linked(docs, common=common).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == [(3, 120_000, 3), (5, 155_000, 3), (7, 155_000, 3)]


def test_hot_keys_are_dealt(spark):
    """Pairs of one hub in blocks give the same as a plain join."""
    from rillstone.llm.shared import hot_join, salted_join, written

    rows = [(0, i) for i in range(1, 300)] + [(i, 400) for i in range(350)] + [(i, i + 1) for i in range(500, 560)]
    pairs = written(spark.createDataFrame(rows, "u long, v long"), "pairs")
    nodes = spark.range(600).selectExpr("id", "id * 2 as x")
    side = lambda c: nodes.select(nodes["id"].alias(c), nodes["x"].alias(f"x_{c}"))
    want = sorted((u, v, 2 * u, 2 * v) for u, v in rows)
    for block, few in ((10_000, 9), (20, 9), (20, 0)):
        found = hot_join(pairs, {"u": side("u"), "v": side("v")}, block, few).select("u", "v", "x_u", "x_v").collect()
        assert sorted(map(tuple, found)) == want
    assert sorted(map(tuple, salted_join(pairs, side("u"), ["u"], ["v"]).select("u", "v", "x_u").collect())) == sorted(r[:3] for r in want)


def test_thrice_counts_in_little_memory():
    r = np.random.default_rng(2)
    for n, few in ((0, 1), (1, 1), (2, 1), (500, 90)):
        keys = r.integers(0, few, n).astype(np.uint64)
        values, counts = np.unique(keys, return_counts=True)
        got, times = jaccard.thrice([keys[:3], keys[3:]])
        assert (got == values[counts >= 3]).all() and (times == counts[counts >= 3]).all()
    held = [r.integers(0, 2**62, 1 << 20, np.uint64)]
    tracemalloc.start()
    assert len(jaccard.thrice(held)[0]) == 0 and held == []
    assert tracemalloc.get_traced_memory()[1] < 12 << 20  # one copy of 8 MB, and a byte a key
    tracemalloc.stop()


def test_words_of_little_text_are_held_at_once():
    words = [" ".join(f"w{i * 300 + j}" for j in range(300)) for i in range(3000)]
    column = pa.array(words)
    list(jaccard.shingles(column[:1]))  # tables that stay
    tracemalloc.start()
    runs = [(first, len(rows)) for first, rows in jaccard.shingles(column)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f for f, _ in runs] == [0, *np.cumsum([n for _, n in runs])[:-1]] and sum(n for _, n in runs) == len(words)
    assert peak < 40 << 20


def test_plans_of_the_join_are_small(spark, monkeypatch):
    """The driver's memory grows with the square of a plan's exchanges, as adaptive execution plans anew after each."""
    from rillstone.llm import components, shared

    sizes = {}

    def counted(df, name, tidy=False):
        plan = df._jdf.queryExecution().executedPlan().toString()
        sizes[name] = max(sizes.get(name, 0), len(re.findall(r"\bExchange |BroadcastExchange ", plan)))
        return shared.written(df, name, tidy)

    for module in (jaccard, components):
        monkeypatch.setattr(module, "written", counted)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = base[: 40 + i % 20]
        words[rng.randrange(len(words))] = f"x{i % 7}"
        rows.append((i, " ".join(words)))
    found = jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in found.select("doc_id", "n_shingles", "component_id").collect()) == brute(rows)
    assert max(sizes.values()) <= 16, sizes


def test_stars_settle_in_one_round(spark, monkeypatch):
    from rillstone.llm import components, shared

    names = []
    monkeypatch.setattr(components, "written", lambda df, name, tidy=False: (names.append(name), shared.written(df, name, tidy))[1])
    links = spark.createDataFrame([(1, 5), (6, 1), (1, 7), (2, 9)], "u long, v long")
    assert {tuple(r) for r in components.components(links).collect()} == {(1, 1), (5, 1), (6, 1), (7, 1), (2, 2), (9, 2)}
    assert names.count("links") == 1
    names.clear()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {tuple(r) for r in components.components(chain).collect()} == {(i, 0) for i in range(41)}
    assert components.components(links.limit(0)).isEmpty()
