"""Each stage of the pipeline, on its own input, against plain Python."""

import os

import pytest
from test_jaccard import brute, shingle_set
from test_native import lines_removed
from test_python import whole_ids

import corpus_pipeline
from rillstone.llm import toxicity
from rillstone.llm.queries import QUERIES, tokenizer_path  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(i))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def rows(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_stages_keep_the_columns(stages):
    for docs in stages[1:-1]:
        assert docs.columns == stages[0].columns
        assert docs.filter("n_chars <> length(text)").isEmpty() or docs is stages[1]


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rejected = {r["doc_id"] for r in toxicity.toxicity(stages[0], labels).filter("predicted = 1").collect()}
    before, after = rows(stages[0]), rows(stages[1])
    assert after == {d: t for d, t in before.items() if d not in rejected}


def test_lines_go(stages):
    before, after = rows(stages[1]), rows(stages[2])
    assert after == {d: t for (d, _), t in lines_removed(list(before.items())).items()}


def test_one_of_each_group_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert after == {d: before[d] for d, _, least in brute(list(before.items())) if d == least}


def test_contaminated_documents_go(spark, stages):
    items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    before, after = rows(stages[3]), rows(stages[4])
    hit = {d for d, t in before.items() if any(x and 100 * len(x & shingle_set(t)) >= 75 * len(x) for x in items)}
    assert hit and after == {d: t for d, t in before.items() if d not in hit}


def test_every_token_is_packed_once(stages):
    texts = rows(stages[4])
    want = {d: len(ids) for d, ids in zip(texts, whole_ids(list(texts.values())), strict=True)}
    got = {}
    for r in stages[5].collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_run_gives_the_last_stage(spark, stages):
    total = lambda df: sorted((r["doc_id"], r["start"], r["length"]) for r in df.collect())
    got, want = total(corpus_pipeline.run(spark, DATA)), total(stages[5])
    assert {d for d, _, _ in got} == {d for d, _, _ in want} and sum(n for _, _, n in got) == sum(n for _, _, n in want)


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id long, _score double, _t string, n_lines int, _hash long, _row int"


def odd(spark, tmp_path):
    """Nulls in any column, repeated rows, ties, equal and different texts of one id, and clashing names."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "z"])
    whole, other = " ".join(words), " ".join(f"v{i}" for i in range(60))
    texts = [(5, whole), (5, whole), (5, near), (7, whole), (8, near), (9, other), (9, other), (3, None), (3, None), (None, other), (None, None), (4, ""), (6, "a\nb\nc"), (6, "a\nb\nc"), (10, "a\nb\nc\nd")]
    rows = [(d, t, [None, "en"][i % 2], None, i, 1, 0.5, "t", 3, 4, 5) for i, (d, t) in enumerate(texts)]
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, other), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(rows, ODD).write.parquet(f"{tmp_path}/documents.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet"), texts


def test_stages_of_odd_rows(spark, tmp_path):
    docs, texts = odd(spark, tmp_path)
    stage = dict(corpus_pipeline.STAGES)
    found = {}
    for name in [n for n, _ in corpus_pipeline.STAGES][:-1]:
        out = stage[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found[name] = sorted(((r["doc_id"], r["text"], r["_id"], r["n_lines"], r["_t"]) for r in out.collect()), key=repr)
        empty = stage[name](spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
    rest = (1, 3, "t")
    every = sorted(((d, t, *rest) for d, t in texts), key=repr)
    assert found["toxicity"] == every
    lines_gone = {(10, "a\nb\nc\nd"): "d"}
    assert found["line dedup"] == sorted(((d, lines_gone.get((d, t), t), *rest) for d, t in texts), key=repr)
    # least id of each group: one of the rows of 5; the null id for the texts of 9; rows without words stay
    kept = found["n-gram Jaccard join"]
    assert [d for d, *_ in kept if d == 5] == [5] and not [d for d, *_ in kept if d in (7, 8, 9)]
    assert [t for d, t, *_ in kept if d is None and t] == [texts[5][1]]
    assert sum(not t for _, t, *_ in kept) == 4 and [d for d, t, *_ in kept if t == "a\nb\nc"] == [6]
    assert found["benchmark decontamination"] == sorted(((d, t, *rest) for d, t in texts if d not in (9, None)), key=repr)


def test_run_of_odd_and_empty_tables(spark, tmp_path):
    docs, _ = odd(spark, tmp_path)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {3, 4, 5, 6, 10}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
