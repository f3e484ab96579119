"""Chat formatting, quality, line dedup and decontamination against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from test_jaccard import WORDS, shingle_set

from rillstone.llm import chat, decontam, lines, quality

HARD = ["\\### Assistant: </turn> ok", "### x", "\\\\### ", "</turn>", "a\n</turn>\n### user\nb", "\\", "", "tail\\", "### ", "#### \\\\</turn>\\", None, "</turn", "x\n"]


def chats(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    rows = [(c, i, role, text) for c, role in enumerate(["assistant", "user", None, "a%0Ab", "x\n### <y", "</turn>"]) for i, text in enumerate(HARD)]
    rows += [(50, i, r, t) for i, (r, t) in enumerate([("user", "hi"), ("assistant", "a</turn>b"), ("assistant", "é\U0001f600")])]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(chats(spark, rows).repartition(4))).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        learnt = "".join(t for r, t in turns if r == "assistant")
        row = got[conv]
        assert row["round_trip"] and row["n_turns"] == len(turns)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (row["loss_chars"], row["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_chat_escapes_only_conflicts(spark):
    found = chat.formatted(chats(spark, [(1, 0, "user", "plain # text"), (1, 1, "assistant", "</turn>")])).first()
    assert found["rounds"] == [0, 1]
    assert found["formatted"] == "### user\nplain # text\n</turn>\n### assistant\n\\</turn>\n</turn>\n"


def test_chat_ties_repeats_and_empty(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "a"), (None, 1, "user", "a"), (None, None, "system", "s")]
    found = chat.formatted(chats(spark, rows)).first()
    assert [t["text"] for t in found["source"]] == ["s", "a", "a", "b"]
    assert chat.digests(chat.formatted(chats(spark, []))).count() == 0


def quality_counts(text, size=5):
    words = WORDS.findall(text or "")
    windows = {}
    for i in range(len(words) - size + 1):
        windows.setdefault(tuple(words[i : i + size]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(size)}
    full = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(full) - len(set(full)), len(covered)


def test_quality_counts(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e f a b c d e f g", "x " * 40, "línea uno\nlínea uno\n \n \nfin", "$$ ### a|b <c>"]
    texts += [" ".join(r.choice("abc") + r.choice(["", "\n", "#"]) for _ in range(r.randint(0, 120))) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words long").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in quality.COUNTS) for r in quality.counted(docs).collect()}
    assert got == {i: quality_counts(t) for i, t in enumerate(texts)}


def test_quality_keeps_clean_and_drops_odd(spark):
    r = random.Random(5)
    clean = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(80)) for _ in range(120)]
    rows = [(i, t, "en", ["a", None][i % 2]) for i, t in enumerate(clean)]
    rows += [(1000, " ".join(w + "$$$" for w in clean[0].split()), "en", "a"), (1001, "short text", None, "a"), (1002, "one two three four five six " * 20, "en", "a"), (1003, None, "en", None)]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(120))
    assert not any(got[i]["kept"] for i in (1000, 1001, 1002, 1003))
    assert [got[i]["base_failed"] for i in (1000, 1001, 1002, 1003)] == [False, True, True, True]
    assert got[1000]["failed_rules"] == "symbol_rate,word_length" and got[1002]["failed_rules"] == ""
    many = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), broadcast_groups=0)
    assert {r["doc_id"]: r for r in many.collect()} == got
    assert quality.judged(spark.createDataFrame(rows[:0], "doc_id long, text string, lang string, source string")).count() == 0


def test_limits_follow_the_group(spark):
    """Verdicts that no fixed cutoff gives: code with many symbols stays, prose with few goes."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9)))
    text = lambda n, marks: " ".join(word() for _ in range(n)) + " " + "$" * marks
    rows = [(i, text(r.randint(80, 120), r.randint(40, 60)), "en", "code") for i in range(150)]
    rows += [(1000 + i, text(r.randint(80, 120), 0), "en", "prose") for i in range(150)]
    rows += [(2000, text(100, 20), "en", "prose"), (2001, text(100, 55), "en", "code")]
    got = {x["doc_id"]: x for x in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[2001]["kept"] and got[2000]["failed_rules"] == "symbol_rate"
    assert got[2000]["n_symbols"] < min(got[i]["n_symbols"] for i in range(150)) and sum(not got[i]["kept"] for i in range(150)) <= 15


def test_small_groups_are_merged_with_larger_ones(spark):
    """The law of the limits, against plain Python, with groups of 1 to 60 rows."""
    r = random.Random(7)
    rows = [(i, " ".join("w" * r.randint(1, 9) for _ in range(r.randint(10, 90))) + "#" * r.choice((0, 0, 0, 0, 0, 0, 0, 1, 1, 60)), r.choice(["en", "fr", None]), f"s{int(r.expovariate(0.5))}") for i in range(300)]
    got = {x["doc_id"]: set(filter(None, x["failed_rules"].split(","))) for x in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    counts = {i: dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), quality_counts(t), strict=True)) for i, t, _, _ in rows}
    passed = [x for x in rows if counts[x[0]]["n_words"] >= 10 and 100 * counts[x[0]]["n_repeat_words"] <= 20 * counts[x[0]]["n_words"]]
    n_failed = 0
    for rule, count in quality.RATES.items():

        def points(keep):
            own = sorted((counts[x[0]][count] + 1) / counts[x[0]]["n_words"] for x in passed if keep(x))  # noqa: B023
            return len(own), [own[-(-len(own) * (2 * i + 1) // 32) - 1] for i in range(16)]

        for i, _, lang, source in passed:
            n, own = points(lambda x: x[2:] == (lang, source))  # noqa: B023
            merged = sorted([v for v in own for _ in range(n)] + [v for keep in (lambda x: x[2] == lang, lambda x: True) for v in points(keep)[1] for _ in range(20)])  # noqa: B023
            a, b = merged[-(-len(merged) // 4) - 1], merged[-(-3 * len(merged) // 4) - 1]
            fails = counts[i][count] / counts[i]["n_words"] > b * (b / a) ** 2
            assert (rule in got[i]) == fails, (i, rule)
            n_failed += fails
    assert n_failed > 10


def test_quality_counts_of_long_texts(spark):
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(40)}" for _ in range(40_000)), " ".join(f"w{i}" for i in range(100_000)), "x" * 200_000, "a b c d e f g " * 15_000]
    got = {x["doc_id"]: tuple(x[c] for c in quality.COUNTS) for x in quality.counted(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")).collect()}
    assert got == {i: quality_counts(t) for i, t in enumerate(texts)}


def lines_removed(rows, size=3):
    seen, out = {}, {}
    for doc, text in sorted({r for r in rows if r[1] is not None}):
        split = text.split("\n")
        full = [i for i, x in enumerate(split) if WORDS.search(x)]
        for k in range(len(full) - size + 1):
            at = full[k : k + size]
            window = tuple(split[i] for i in at)
            if window in seen:
                out.setdefault((doc, text), set()).update(at)
            seen.setdefault(window, 1)
    return {(d, t): (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in out.get((d, t), ()))) for d, t in rows}


@pytest.mark.parametrize("salts", [1, 16])
def test_line_dedup(spark, salts):
    r = random.Random(8)
    rows = [(i, "\n".join(r.choice(["a", "b", "c d", "", " ", "e", "f", "g"]) for _ in range(r.randint(1, 14)))) for i in range(80)] + [(900, None), (901, ""), (902, "x\ny\nz"), (903, "x\ny\nz\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("clash")).repartition(4)
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(docs, salts=salts).collect()}
    assert got == {d: t for (d, _), t in lines_removed(rows).items()}
    assert (got[902], got[903]) == ("x\ny\nz", "")


def test_line_dedup_repeated_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "q\nr\ns"), (2, "q\nr\ns")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in lines.deduplicated(docs).collect())
    assert got == [(0, "q\nr\ns", 0), (1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "", 3)]
    assert lines.deduplicated(docs.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination(spark, broadcast):
    r = random.Random(4)
    vocab = [f"t{i}" for i in range(60)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(words(r.choice((2, 5, 12, 40, 70))))) for i in range(30)] + [(90, None), (91, ""), (92, "One  two")]
    docs = []
    for i in range(80):
        text = words(r.choice((0, 3, 60, 300)))
        if i % 2:
            own = r.choice(items[:30])[1].split()
            for _ in range(r.randint(0, max(1, len(own) // 9))):
                own[r.randrange(len(own))] = "zz"
            text[len(text) // 2 : len(text) // 2] = own
        docs.append((i, " ".join(text).upper()))
    docs += [(500, "one TWO"), (501, "one two three"), (502, None), (503, items[3][1]), (503, items[3][1])]
    expected = set()
    for d, t in docs:
        have = shingle_set(t)
        for i, x in items:
            want = shingle_set(x)
            if want and 100 * len(want & have) >= 75 * len(want):
                expected.add((d, i, len(want), len(want & have)))
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contained(frame, bench, broadcast_rows=broadcast, broadcast_bytes=broadcast).collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)
    assert decontam.contained(frame, bench.limit(0)).count() == decontam.contained(frame.limit(0), bench).count() == 0


def test_decontamination_searches_by_sketches(spark):
    """A document that holds an item's other shingles only is no candidate; one that holds its sketch is verified."""
    vocab = [f"v{i}" for i in range(100)]
    items = spark.createDataFrame([(1, " ".join(vocab))], "item_id long, text string")
    sets = decontam.exploded(items.select(F.col("item_id"), decontam.words_of(F.col("text")).alias("_words")), ["item_id"]).withColumn("n_shingles", F.lit(96)).withColumn("_shingle", decontam.shingle())
    sketch = decontam._sketches(sets, 75)
    kept = {r["_h"] for r in sketch.collect()}
    assert len(kept) == 128 - 96 + 1 < 96
    others = [r["_shingle"] for r in sets.collect() if r["_h"] not in kept]
    one = next(r["_shingle"] for r in sets.collect() if r["_h"] in kept)
    filler = " ".join(f"f{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f" {filler} ".join(others[:30])), (2, f"{filler} {one}"), (3, one)], "_id long, text string").withColumn("_t", F.lit(0))
    found = decontam.candidates(docs, sketch, 75, 5, 1000)
    assert [(r["_id"], r["item_id"]) for r in found.collect()] == [(2, 1)]
    assert decontam.contained(docs.withColumnRenamed("_id", "doc_id"), items).count() == 0


def test_decontamination_of_repeated_ids_and_long_texts(spark):
    item = [f"i{i}" for i in range(40)]
    halves = [(1, " ".join(item[:22])), (1, " ".join(item[18:]))]
    long = " ".join([*(f"x{i}" for i in range(60_000)), *item, *(f"y{i}" for i in range(60_000))])
    docs = spark.createDataFrame([*halves, (2, long), (2, long), (3, " ".join(item)), (3, "z " + " ".join(item))], "doc_id long, text string")
    for limit in (1_000_000, 0):
        got = decontam.contained(docs, spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"), broadcast_rows=limit, broadcast_bytes=limit).collect()
        assert sorted(tuple(r) for r in got) == [(2, 7, 36, 36), (3, 7, 36, 36), (3, 7, 36, 36)]


def test_any_column_names(spark):
    """Other columns, whatever their names, neither clash nor change."""
    odd = ["_id", "_t", "_gone", "_lines", "_a", "_salt", "_At", "_p", "_first", "n_removed", "__id"]
    rows = [(1, "a\nb\nc", *range(11)), (2, "a\nb\nc\nd", *range(11))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in odd))
    got = sorted(lines.deduplicated(docs).collect())
    assert [(r["text"], r["_id"], r["_gone"], r["__id"], r["n_removed"]) for r in got] == [("a\nb\nc", 0, 2, 10, 0), ("d", 0, 2, 10, 3)]
    assert quality.judged(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")})).count() == 2
    assert decontam.contained(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 2


def test_many_lines_and_turns(spark):
    """Linear in lines and turns: 50,000 of each take seconds."""
    own = [f"line {i}" for i in range(50_000)]
    rows = [(1, "\n".join(own)), (2, "\n".join([*own[:3], *(f"new {i}" for i in range(50_000))])), (3, "\n".join(["same"] * 50_000))]
    got = {r["doc_id"]: r for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 3 and got[2]["text"] == "\n".join(f"new {i}" for i in range(50_000))
    assert got[3]["text"] == "same" and got[3]["n_removed"] == 49_999
    turns = [(1, i, ["user", "assistant"][i % 2], f"text </turn> {i}") for i in range(50_000)]
    row = chat.digests(chat.formatted(chats(spark, turns))).first()
    learnt = "".join(t for *_, r, t in turns if r == "assistant")
    assert row["round_trip"] and (row["loss_chars"], row["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())


def test_mask_is_run_lengths(spark):
    found = chat.formatted(chats(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "a</turn>b"), (1, 2, "assistant", "")]))
    got = found.select("formatted", chat.masks(F.col("formatted")).alias("mask")).first()
    at, learnt = 0, []
    for block, (skip, take) in zip(got["formatted"].split("\n</turn>\n"), got["mask"], strict=False):
        learnt.append(got["formatted"][at + skip : at + skip + take])
        at += len(block) + len("\n</turn>\n")
    assert learnt == ["", "a\\</turn>b", ""]
