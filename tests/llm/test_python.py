"""Sharding, personal data, toxicity and packing against plain Python, and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rillstone.llm import packing, pii, sharding, toxicity
from rillstone.llm.queries import tokenizer_path


def test_shards_hold_the_mixture(spark):
    r = random.Random(1)
    rows = [(i, None if i % 50 == 0 else "é" * r.randint(0, 30), "hot" if i < 4000 else None if i % 3 == 0 else f"s{i % 40}", "x") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard string").repartition(5)
    got = sharding.interleaved(docs, 16).collect()
    assert len(got) == len(rows)
    sizes = Counter(x["shard"] for x in got)
    assert sorted(sizes) == list(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(16):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sizes[s]))
    by_source = defaultdict(Counter)
    for x in got:
        by_source[x["source"]][x["shard"]] += 1
    for source, shards in by_source.items():  # a row of rounding, and a source's share of the other sources' rounding
        total = sum(shards.values())
        assert all(abs(shards[s] - total / 16) <= 1.01 + 2 * len(by_source) ** 0.5 * total / len(rows) for s in range(16)), source
    text = {i: t or "" for i, t, _, _ in rows}
    assert all(x["size"] == len(text[x["doc_id"]].encode()) + 1 and x["text_crc32"] == zlib.crc32(text[x["doc_id"]].encode()) for x in got)
    again = sharding.interleaved(docs.repartition(2), 16).collect()
    assert {(x["doc_id"], x["shard"], x["slot"]) for x in got} == {(x["doc_id"], x["shard"], x["slot"]) for x in again}


def test_shards_follow_the_fractional_ranks(spark):
    """The order against plain ranking, from the same hashes."""
    from pyspark.sql import functions as F

    r = random.Random(14)
    rows = [(i, "t" * r.randint(0, 9), "hot" if i % 3 else f"s{i % 30}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    key = F.concat(F.lit("="), F.col("source"))
    shift = F.shiftrightunsigned(F.xxhash64(F.lit(18), key), 11).cast("double") / float(1 << 53)
    hashed = docs.select("doc_id", key.alias("key"), F.xxhash64(F.lit(17), F.col("doc_id"), F.crc32(F.col("text").cast("binary"))).alias("h"), shift.alias("shift")).collect()
    sources = defaultdict(list)
    for x in hashed:
        sources[x["key"]].append((x["h"] % 2**64, x["doc_id"], x["shift"]))
    order = []
    for name, own in sources.items():
        order += [((i + 1 - shift) / len(own), name, doc) for i, (_, doc, shift) in enumerate(sorted(own))]
    want, starts = {}, {}
    for at, (_, _, doc) in enumerate(sorted(order)):
        shard = at * 16 // len(rows)
        want[doc] = (shard, at - starts.setdefault(shard, at))
    assert {x["doc_id"]: (x["shard"], x["slot"]) for x in sharding.interleaved(docs, 16, seed=17).collect()} == want


def test_shards_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (None, None, None)], "doc_id long, text string, source string")
    got = sharding.interleaved(docs, 16).collect()
    assert len(got) == 3 and len({x["shard"] for x in got}) == 3 and {x["slot"] for x in got} == {0}
    assert sharding.interleaved(docs.limit(0), 16).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark):
    r = random.Random(2)
    pieces = ["a@b.co", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3", "4111111111111111", "4111 1111-1111 1111", "+1 (389) 555-5010", "+", "12", " ", "\n", "é", "a.b%c+d-e@f-g.h.i", "%d@e.f", "-", "(", "00001.2.3.4", "+12345678", "９"]
    texts = [None, "", "x" * 5000 + "@" + "y" * 5000, "1" * 5000, "+" + "1" * 3000 + "x"] + ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int").repartition(3)
    for row in pii.personal_data(docs).collect():
        spans = base_spans(texts[row["doc_id"]] or "")
        digest = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert row["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]
        assert not digest or set(digest.split(",")) <= set(row["spans"].split(","))
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_field_adds_spans_and_leaves_plain_text(spark):
    texts = ["ring 415-555-0123 or (020) 7946 0111 now", "paid with 4012-8888-8888-1882 in 2019", "version 2.1.7 of 2024-05-06 costs 13.20", "order 100777 of room 12", 'token = "9fceb02d0ae598e95dc970b74767f19372d61af8"']
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = {i: [texts[i][int(x.split(":")[1]) : int(x.split(":")[2])] for x in s.split(",") if x] for i, s in got.items()}
    assert found[0] == ["415-555-0123", "(020) 7946 0111"] and found[1] == ["4012-8888-8888-1882"]
    assert not found[2] and not found[3] and not found[4]


def test_viterbi_is_the_best_path():
    from itertools import product

    model = pii.field()
    for text in ("call 415 555 0199 or 12", "10.0.0.1 7 a@b.cc"):
        (run,) = [r for r in pii.runs(text) if len(r) > 1][:1]
        feats, _ = model.features([run])
        e = model.emissions(feats)[0]
        score = lambda ys: sum(e[i, y] for i, y in enumerate(ys)) + sum(model.t[a, b] for a, b in zip((0, *ys), (*ys, 0), strict=True))  # noqa: B023, E731
        best = max(product(range(len(pii.LABELS)), repeat=len(run)), key=score)
        assert tuple(model.decode([run])[0]) == best


def corpus(seed, n=1500):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    bad = [f"slur{i}" for i in range(8)]
    docs, labels = [], []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 200))]
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(1, 5)):
                words[r.randrange(len(words))] = r.choice(bad).upper() + r.choice(["", ",", "!!"])
        docs.append((i, " ".join(words)))
        if r.random() < 0.6:
            labels.append((i, int(toxic)))
    return docs, labels, {i for i, t in docs if "SLUR" in t}


def test_toxicity_held_out(spark):
    docs, labels, truth = corpus(3)
    docs += [(5000, None), (5001, ""), (None, "SLUR1"), (7, docs[7][1])]
    frame = spark.createDataFrame([(*d, 0.9) for d in docs], "doc_id long, text string, score double").repartition(3)
    marks = spark.createDataFrame(labels + [(None, 1), (9, None)], "doc_id long, toxic int")
    got = toxicity.toxicity(frame, marks).collect()
    assert len(got) == len(docs)
    for row in got:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode() if row["doc_id"] is not None else b"null") % 5 == 0)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 5000]
    wrong = [r for r in held if r["predicted"] != (r["doc_id"] in truth)]
    assert len(wrong) <= 0.02 * len(held)
    assert {r["predicted"] for r in got if r["doc_id"] in (5000, 5001)} == {0}


def test_slope_of_the_risk_is_its_gradient():
    r = np.random.default_rng(1)
    positive = np.arange(60) < 20
    z = np.where(positive, -1.0, 1.0) + r.normal(size=60)
    value, slope = toxicity.risk(z, positive, 0.2)
    for i in range(60):
        step = np.zeros(60)
        step[i] = 1e-5
        assert abs((toxicity.risk(z + step, positive, 0.2)[0] - toxicity.risk(z - step, positive, 0.2)[0]) / 2e-5 - slope[i]) < 1e-7
    low = np.where(positive, 5.0, -9.0)  # unlabelled text seems cleaner than it can be
    bracket = lambda z: (1 / (1 + np.exp(-z[~positive]))).mean() - 0.2 * (1 / (1 + np.exp(-z[positive]))).mean()
    assert bracket(low) < 0
    value, slope = toxicity.risk(low, positive, 0.2)
    assert abs(value - 0.2 * (1 - 1 / (1 + np.exp(-5.0)))) < 1e-9
    step = np.zeros(60)
    step[0] = 1e-5
    assert abs((bracket(low + step) - bracket(low - step)) / 2e-5 + slope[0]) < 1e-9


def test_prior_needs_no_negatives(spark):
    r = np.random.default_rng(2)
    for share in (0.05, 0.3):
        unlabelled = np.where(r.random(6000) < share, r.normal(4, 1, 6000), r.normal(0, 1, 6000))
        assert abs(toxicity.best_bin(r.normal(4, 1, 2000), unlabelled) - share) < 0.03
    assert toxicity.best_bin(np.zeros(0), np.zeros(3)) == toxicity.best_bin(np.zeros(5), np.zeros(3)) == 0.1


def test_labels_of_clean_documents_are_not_read(spark):
    docs, labels, _ = corpus(6, 900)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = {}
    real = toxicity.fit
    try:
        toxicity.fit = lambda docs, positive, *rest, **kw: seen.update(n=len(docs), p=int(positive.sum())) or real(docs, positive, *rest, **kw)
        toxicity.train(frame, marks)
    finally:
        toxicity.fit = real
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    marked = dict(labels)
    assert seen["p"] == sum(t for i, t in labels if not fold(i)) and seen["n"] - seen["p"] == sum(i not in marked and not fold(i) for i, _ in docs)


def test_sample_is_one_row_an_id_and_its_telling_words(spark):
    docs, labels, _ = corpus(8, 900)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    seen = []
    real = toxicity.fit
    try:
        toxicity.fit = lambda docs, positive, *rest, **kw: seen.append(docs) or real(docs, positive, *rest, **kw)
        once = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), marks)
        # one id holds most rows, some with a text of its own that has more words
        key, text = next(d for d in docs if zlib.crc32(str(d[0]).encode()) % 5 and d[0] not in dict(labels))
        hot = docs + [(key, text)] * 500 + [(key, text + " more")] * 400
        again = toxicity.train(spark.createDataFrame(hot, "doc_id long, text string").repartition(7), marks)
    finally:
        toxicity.fit = real
    assert max(map(len, seen)) < 900
    assert len(seen[2]) == len(seen[5])
    assert once.bias == pytest.approx(again.bias, abs=0.2)
    # the model is that of all words
    column = lambda rows: next(toxicity.features(pa.array([t for _, t in rows], pa.string())))
    marked, fold = dict(labels), lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    rows = [d for d in docs if not fold(d[0]) and marked.get(d[0], 1)]
    _, row, word, n = column(rows)
    whole = [np.unique(word[row == i]) for i in range(n)]
    positive = np.array([d[0] in marked for d in rows])
    given = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string"), marks, prior=0.1)
    direct = toxicity.fit(whole, positive, 0.1)
    assert np.allclose(given.weights, direct.weights, atol=1e-4) and direct.weights.any()


def test_toxicity_without_labels(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity(frame, none).collect()] == [0, 0]
    assert toxicity.toxicity(frame.limit(0), none).count() == 0


def test_labels_of_the_test_fold_are_not_read(spark):
    docs, labels, _ = corpus(4, 400)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    fold = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    one = toxicity.toxicity(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    two = toxicity.toxicity(frame, spark.createDataFrame([(i, 1 - t if fold(i) else t) for i, t in labels], "doc_id long, toxic int")).collect()
    assert sorted(one) == sorted(two)


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [e.ids + [packing.END_ID] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packed(rows, texts):
    ids = dict(enumerate(whole_ids(texts)))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for x in rows:
        own = ids[x["doc_id"]]
        part = own[x["start"] : x["start"] + x["length"]]
        assert x["doc_tokens"] == len(own) and len(part) == x["length"] > 0
        assert x["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
        pieces[x["doc_id"]].append((x["start"], x["length"]))
        sequences[x["sequence_id"]].append((x["offset"], x["length"], x["sequence_tokens"]))
    assert set(pieces) == set(ids)
    for i, found in pieces.items():
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
        assert at == len(ids[i])
    padding = 0
    for found in sequences.values():
        at = 0
        for offset, n, _ in sorted(found):
            assert offset == at
            at += n
        assert at == found[0][2] <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    return padding, len(sequences)


def check_groups(rows, largest=4096):
    """Counts of windows differ by one at most, in all and tier by tier, and tokens by a window at most."""
    groups = defaultdict(dict)
    for x in rows:
        groups[x["step_group"]][x["sequence_id"]] = x["sequence_tokens"]
    assert sorted(groups) == list(range(len(groups)))
    spread = lambda f: max(map(f, groups.values())) - min(map(f, groups.values()))
    assert spread(len) <= 1 and spread(lambda g: sum(g.values())) <= largest
    for size in {x["sequence_tokens"] for x in rows}:
        assert spread(lambda g: list(g.values()).count(size)) <= 1  # noqa: B023
    return groups


def test_packer_packs_each_tier():
    r = random.Random(12)
    packer, lengths = packing.Packer((8, 16, 32, 64), reserve=4), {}
    found = []
    for key in range(4000):
        lengths[key] = min(63, 1 + int(r.expovariate(1 / 14)))
        packer.add(key, 0, lengths[key])
        found += packer.windows(last=False)
    assert packer.total < 4 * 64 + 64
    found += packer.windows(last=True)
    assert packer.total == 0 and not packer.keys()
    pieces = defaultdict(list)
    for size, window in found:
        assert sum(n for _, _, n in window) == size
        for key, start, n in window:
            pieces[key].append((start, n))
    for key, own in pieces.items():
        at = 0
        for start, n in sorted(own):
            assert start == at
            at += n
        assert at == lengths[key]
    assert len(pieces) == len(lengths) and sum(s & (s - 1) > 0 for s, _ in found) <= 1
    assert {8, 16, 32, 64} <= {s for s, _ in found}
    assert sum(len(own) > 1 for own in pieces.values()) < 0.05 * len(lengths)  # few documents are cut


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    texts = ["two  words,\n\nand  spaces ", "", "naïve 日本", " x"]
    path = tokenizer_path("byte_bpe_50k.json")
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert not packing.Encoder(path).chunked and packing.Encoder(tokenizer_path()).chunked
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(path).encode(texts)] == want


def test_step_groups_of_many_partitions(spark):
    r = random.Random(13)
    docs = spark.createDataFrame([(i, "ab " * int(r.expovariate(1 / 300))) for i in range(1200)], "doc_id long, text string").repartition(16)
    rows = packing.packed(docs, tokenizer_path(), tiers=(64, 128, 256, 512), step_tokens=4096).collect()
    groups = check_groups(rows, 512)
    assert len(groups) > 50


def test_packing(spark):
    r = random.Random(6)
    texts = [None, "", " ", "<|endoftext|> x", "İΣ ÀÉ x\x0by\x85z", "word, " * 9000] + [" ".join(r.choice(["ab", "Straße,", "naïve.", "x1y", "日本", "it's"]) for _ in range(int(r.expovariate(1 / 400)))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    rows = packing.packed(docs, tokenizer_path()).collect()
    padding, sequences = check_packed(rows, texts)
    assert padding <= 3 * 4096 and sequences > 3
    check_groups(rows)
    assert len({x["tier"] for x in rows}) >= 2
    assert packing.packed(docs.limit(0), tokenizer_path()).count() == 0


def test_packing_repeated_rows(spark):
    docs = spark.createDataFrame([(4, "a b"), (4, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    rows = packing.packed(docs, tokenizer_path()).collect()
    assert sorted((x["doc_id"] or 0, x["length"], x["offset"]) for x in rows) == sorted((x["doc_id"] or 0, x["doc_tokens"], x["offset"]) for x in rows)
    assert len(rows) == 3 and sum(x["length"] for x in rows) == 8


def test_bad_parameters():
    with pytest.raises(ValueError):
        packing.packed(None, "x", tiers=(1000,))


def test_added_spans_of_long_tokens():
    """What lies beyond a token's first 64 characters is seen."""
    model = pii.field()
    for name in ("bob", "b" * 70):
        runs = list(pii.runs(f"write to {name}@localhost now"))
        assert pii.added(runs, model) == [[("email", 9, 9 + len(name) + 10)]]


def test_runs_go_on_over_any_white_space():
    model = pii.field()
    for gap in (" ", " " * 3, " " * 70, "\n" * 5000):
        text = f"ring (020){gap}7946 0111 now"
        ((kind, start, end),) = [s for spans in pii.added(list(pii.runs(text)), model) for s in spans]
        assert (kind, text[start:end]) == ("phone", f"(020){gap}7946 0111")
