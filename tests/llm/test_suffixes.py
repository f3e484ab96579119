import random
from collections import defaultdict

import pytest
from test_jaccard import WORDS, lowered

from rillstone.llm import suffixes


def brute(rows, words):
    places = defaultdict(set)
    split = {}
    for doc, text in rows:
        split[doc, text] = WORDS.findall(lowered(text))
    for (doc, text), w in split.items():
        for i in range(len(w) - words + 1):
            places[tuple(w[i : i + words])].add((doc, text, i))
    starts = defaultdict(set)
    for found in places.values():
        if len(found) > 1:
            for doc, text, i in found:
                starts[doc, text].add(i)
    spans = []
    for (doc, _), found in starts.items():
        begin = end = None
        for i in sorted(found):
            if end is not None and i <= end:
                end = i + words
                continue
            if end is not None:
                spans.append((doc, begin, end - begin))
            begin, end = i, i + words
        spans.append((doc, begin, end - begin))
    return sorted(spans)


def corpus(seed, passage, n=60):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    shared = [[r.choice(vocab) for _ in range(passage + d)] for d in (-1, 0, 1, 9, 40)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.choice((2, 30, 90, 200)))]
        for _ in range(r.choice((0, 0, 1, 2))):
            at = r.randrange(len(words))
            words[at:at] = r.choice(shared)
        if rows and r.random() < 0.1:
            words = r.choice(rows)[1].split(" ")
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("seed,words,key", [(1, 50, 25), (2, 50, 25), (3, 12, 6)])
def test_spans_against_brute_force(spark, seed, words, key):
    rows = corpus(seed, words)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.repeats(docs, words, key).select("doc_id", "start_word", "n_words").collect()
    assert sorted(map(tuple, got)) == brute(rows, words)


def test_later_occurrence_is_the_duplicate(spark):
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(3, f"x y {a} z"), (1, a), (2, None), (4, "short"), (None, "nothing here")]
    got = {r["doc_id"]: r.asDict() for r in suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {1, 3}
    assert (got[1]["start_word"], got[1]["n_words"], got[1]["n_duplicate"]) == (0, 60, 0)
    assert (got[3]["start_word"], got[3]["n_words"], got[3]["n_duplicate"], got[3]["first_doc_id"]) == (2, 60, 60, 1)


def test_repeated_rows_are_one_text(spark):
    a = " ".join(f"a{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a, 0), (1, a, 1)], "doc_id long, text string, start_word int")
    assert suffixes.repeats(docs).count() == 0
    assert suffixes.repeats(docs.limit(0)).count() == 0


def firsts(rows, words):
    """(doc, first word of a span, document and place of the first of its first window) of distinct documents."""
    split = {doc: WORDS.findall(lowered(text)) for doc, text in rows}
    places = defaultdict(list)
    for doc in sorted(split):
        for i in range(len(split[doc]) - words + 1):
            places[tuple(split[doc][i : i + words])].append((doc, i))
    return sorted((doc, i, *places[tuple(split[doc][i : i + words])][0]) for doc, i, _ in brute(rows, words))


def test_first_is_that_of_all_partitions(spark):
    """Copies that lie together, in another partition than their first."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(70))
    rows = [(1, f"k {a}"), (2, "short"), (5, f"x y {a} z"), (7, f"u {a} {b}"), (3, f"{b} end"), (9, f"{b} {a}"), (10, f"w {b}"), (11, f"q r s {a}"), (4, "short too")]
    for n in (3, 4):
        docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "doc_id long, text string")
        got = suffixes.repeats(docs).select("doc_id", "start_word", "first_doc_id", "first_word").collect()
        assert sorted(map(tuple, got)) == firsts(rows, 50)


@pytest.mark.parametrize("seed", [5, 6])
def test_firsts_against_brute_force(spark, seed):
    rows = corpus(seed, 50, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = suffixes.repeats(docs).select("doc_id", "start_word", "first_doc_id", "first_word").collect()
    assert sorted(map(tuple, got)) == firsts(rows, 50)
