"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled text is that of documents that have
no label.  A linear model over hashed words and beginnings of words (each once a document) is
trained in numpy with the non-negative risk estimator

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-)),

where R_p and R_u are mean losses over positives and unlabelled rows and `prior` is the share of
toxic documents among the unlabelled.  The sigmoid loss bounds what one mislabelled document
adds.  Where the bracket is below zero, its gradient is reversed, as the estimator's authors do.

The prior needs no negatives.  It is given, or estimated from a model of half the sample: among
the scores of the other half, the least ratio of the share of unlabelled rows above a threshold
to that of positives, with the confidence bound of best bin estimation.

Training takes at most `most_positive` and `most_unlabelled` rows, those with the least hash of
their id: a bounded sample.  Executors count its words, and the driver gets, of each row, only
those that may have a weight.  Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstone.sources.packaging import ship

from . import wordhash as wh
from .shared import written

BITS = 18
#: Bytes of text whose words are held at once; a longer text is held alone.
RUN = 1 << 20
#: Lengths, in bytes, of the beginnings of words that are features too.
PREFIXES = (3, 4)
#: Marks that stick to words and say nothing about them.
EDGE = np.zeros(256, bool)
EDGE[[ord(c) for c in "\"'`.,;:!?#$%&*|<>()[]{}-_=+~^/\\"]] = True


def _lowered(data: np.ndarray) -> np.ndarray:
    """Marks are blanks; capital letters up to U+00DE, which are 0xC3 and a byte in UTF-8, are small ones."""
    out = wh.lowered(np.where(EDGE[data], np.uint8(32), data))
    capital = (out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)
    out[1:][capital] += np.uint8(32)
    return out


def features(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, row of each, hashed word or beginning of each, rows)."""
    for first, data, offsets in wh.texts(column, RUN):
        clean = _lowered(data)
        row, start, end, hashes = wh.words(clean, offsets, lower=False)
        rows, words = [row], [hashes]
        head = np.zeros(len(start), wh.U)
        for k in range(max(PREFIXES)):
            long = end - start > k
            row, start, end, head = row[long], start[long], end[long], head[long]
            head = head * wh.U(257) + clean[start + k]
            if k + 1 in PREFIXES:
                rows.append(row)
                words.append(wh.mix(head * wh.U(8) + wh.U(k + 1)))
        row = np.concatenate(rows)
        by = np.argsort(row, kind="stable")
        yield first, row[by], (np.concatenate(words)[by] >> wh.U(64 - BITS)).astype(np.int64), len(offsets) - 1


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        """Probabilities, one a row; only words of some weight are looked at twice."""
        out = np.zeros(len(column))
        for first, row, word, rows in features(column):
            some = np.flatnonzero(self.weights[word])
            pair = np.unique(row[some] << BITS | word[some])
            total = np.bincount(pair >> BITS, self.weights[pair & ((1 << BITS) - 1)], rows)
            out[first : first + rows] = 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))
        return out


def risk(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of scores z before the sigmoid, and the slope along which training descends.

    The slope is the risk's gradient, but where unlabelled text seems less than clean (the
    bracket is negative): there it is the bracket's, reversed.
    """
    n_p, n_u = positive.sum(), (~positive).sum()
    s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))  # the loss of calling a row toxic is 1 - s, of calling it clean s
    slope = s * (1 - s)
    bracket = s[~positive].mean() - prior * s[positive].mean()
    value = prior * (1 - s[positive]).mean() + max(0.0, bracket)
    if bracket >= 0:
        return value, np.where(positive, -2 * prior / n_p * slope, slope / n_u)
    return value, np.where(positive, prior / n_p * slope, -slope / n_u)


def telling(in_p: np.ndarray | Column, in_u: np.ndarray | Column, n_p: int, n_u: int, rare: int = 5, lift: float = 4.0) -> np.ndarray | Column:
    """Whether words in so many of n_p positives, and of n_u unlabelled rows, get a weight.

    They are in `rare` positives or more, and `lift` times as common among them as among the
    unlabelled, and by more than chance: three deviations of the counts.
    """
    share = in_u / float(n_u)
    more = in_p - n_p * share
    return (in_p >= rare) & (in_p >= lift * n_p * share) & (more > 0) & (more * more > 9 * n_p * (share + 1 / n_u))


def fit(docs: list[np.ndarray], positive: np.ndarray, prior: float, rounds: int = 300, rate: float = 0.1, l1: float = 2e-4, rare: int = 5, lift: float = 4.0) -> Model:
    """docs: hashed words of each document; positive: which are confirmed.

    Only words that are `telling` have a weight, so `docs` may leave out others.
    """
    lengths = np.array([len(d) for d in docs], np.int64)
    words = np.concatenate(docs) if len(docs) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(docs)), lengths)
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    if not n_p or not n_u:
        return Model(np.zeros(1 << BITS, np.float32), -4.0)
    in_p = np.bincount(words[positive[row]], minlength=1 << BITS)
    in_u = np.bincount(words[~positive[row]], minlength=1 << BITS)
    keep = telling(in_p, in_u, n_p, n_u, rare, lift)[words]
    words, row = words[keep], row[keep]
    ids, words = np.unique(words, return_inverse=True)
    w, b = np.zeros(len(ids)), -2.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, rounds + 1):
        z = b + np.bincount(row, w[words], len(docs))
        g = risk(z, positive, prior)[1]
        gw, gb = np.bincount(words, g[row], len(ids)), g.sum()
        m += 0.1 * (gw - m)
        v += 0.01 * (gw * gw - v)
        mb += 0.1 * (gb - mb)
        vb += 0.01 * (gb * gb - vb)
        lr = rate / (1 - 0.9**step)
        w -= lr * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = np.sign(w) * np.maximum(0, np.abs(w) - rate * l1)
        b -= lr * mb / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(1 << BITS, np.float32)
    weights[ids] = w
    return Model(weights, float(b))


def best_bin(positives: np.ndarray, unlabelled: np.ndarray, default: float = 0.1, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among the unlabelled, from scores of both that training hasn't seen.

    Above the threshold where the bound on the ratio of both shares is least, the unlabelled rows
    are taken to be positive.  Scores that say nothing, which are 0, are no threshold; where no
    positive has another, `default` is the answer.
    """
    cuts = np.unique(positives[positives > 0])
    if not len(cuts) or not len(unlabelled):
        return default
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    q_p, q_u = above(positives), above(unlabelled)
    slack = (1 + gamma) * (np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positives)))
    best = np.argmin((q_u + slack) / q_p)
    return float(min(1.0, q_u[best] / q_p[best]))


def estimated_prior(docs: list[np.ndarray], positive: np.ndarray, half: np.ndarray) -> float:
    """By a model of one half of the rows, whose own prior is a rough one, and the others' scores; the mean of both ways round."""
    found = []
    for own in (half, ~half):
        model = fit([docs[i] for i in np.flatnonzero(own)], positive[own], 0.5)
        z = np.array([model.weights[docs[i]].sum() for i in np.flatnonzero(~own)])
        found.append(best_bin(z[positive[~own]], z[~positive[~own]]))
    return sum(found) / 2


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The test fold: crc32 of the id as text, modulo 5, is 0; a null id counts as the text `null`."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit("null")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 4000, most_unlabelled: int = 12000, prior: float | None = None, text: str = "text") -> Model:
    """A model from rows outside the test fold: texts that `labels` (doc_id, toxic) confirms, and texts it says nothing of.

    A null label counts as none; an id that `labels` gives twice is toxic if one row says so.  Of
    the rows of one id, that with the least words is used.  A label of 0 is not used.  Without positives, or without unlabelled documents, every score is
    near 0.
    """
    ship(docs.sparkSession)
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64(F.lit("sample"), F.col("doc_id")), F.col("doc_id")]
    positives = marked.filter((F.col("toxic") == 1) & ~held_out()).orderBy(*order).limit(most_positive).select("doc_id", F.lit(True).alias("positive"))
    ids = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out()).join(marked, "doc_id", "left_anti").distinct()
    unlabelled = ids.orderBy(*order).limit(most_unlabelled).select("doc_id", F.lit(False).alias("positive"))
    sample = positives.unionByName(unlabelled)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, row, word, rows in features(batch.column(2)):
                at = wh.bounds(row, rows)
                found = [np.unique(word[at[i] : at[i + 1]]).astype("<i4").tobytes() for i in range(rows)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i)[first : first + rows] for i in range(2)), pa.array(found, pa.binary())], names=["doc_id", "positive", "words"])

    # most_positive + most_unlabelled rows at most, so the ids are sent to every executor
    rows = docs.select("doc_id", docs[text].alias("text")).join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long"), "positive", "text")
    rows = rows.mapInArrow(extract, "doc_id long, positive boolean, words binary").groupBy("doc_id", "positive").agg(F.min("words").alias("words"))
    number = F.row_number().over(Window.partitionBy("positive").orderBy("words"))  # the sample's rows, whose number is bounded
    rows = written(rows.select("positive", number.alias("number"), (number % 2 == 1).alias("half"), "words"), "sample")
    told = _useful(rows)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.frombuffer(x.as_buffer(), "<i4") for x in batch.column("words")]
            short = pa.array([w[told[w]].tobytes() for w in words], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], short], names=batch.schema.names)

    found = rows.mapInArrow(shorten, rows.schema).toArrow().sort_by([("positive", "ascending"), ("number", "ascending")])
    words = [np.frombuffer(x.as_buffer(), "<i4").astype(np.int64) for x in found.column("words")]
    positive, half = (found.column(c).to_numpy() for c in ("positive", "half"))
    return fit(words, positive, estimated_prior(words, positive, half) if prior is None else prior)


def _useful(rows: DataFrame) -> np.ndarray:
    """Which hashed words are `telling` in the sample or in either half of it (positive, half, words): the driver needs no others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((4, 1 << BITS), np.int32)
        for batch in batches:
            for positive, half, words in zip(*(batch.column(c) for c in ("positive", "half", "words")), strict=True):
                cells[2 * positive.as_py() + half.as_py()][np.frombuffer(words.as_buffer(), "<i4")] += 1  # each once a document
        some = np.flatnonzero(cells.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some].astype(np.int64)) for c in cells)], names=["word", "u0", "u1", "p0", "p1"])

    cells = ["u0", "u1", "p0", "p1"]
    counts = rows.mapInArrow(count, "word long, u0 long, u1 long, p0 long, p1 long").groupBy("word").agg(*[F.sum(c).alias(c) for c in cells])
    sizes = dict.fromkeys(cells, 0) | {f"{'p' if r['positive'] else 'u'}{int(r['half'])}": r["n"] for r in rows.groupBy("positive", "half").agg(F.count("*").alias("n")).collect()}
    wanted = F.lit(False)
    for halves in ("0", "1", "01"):
        n_p, n_u = (sum(sizes[kind + h] for h in halves) for kind in "pu")
        if n_p and n_u:
            in_p, in_u = (sum((F.col(kind + h) for h in halves[1:]), F.col(kind + halves[0])) for kind in "pu")
            wanted |= telling(in_p, in_u, n_p, n_u)
    told = np.zeros(1 << BITS, bool)
    told[counts.filter(wanted).select("word").toArrow().column(0).to_numpy().astype(np.int64)] = True
    return told


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """`docs` with the score of each row's whole text; a null or empty text gets the model's bias alone.

    All columns of `docs` stay; one called `name` is replaced.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c != name]
    schema = docs.select(kept).withColumn(name, F.lit(0.0)).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(kept.index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*kept, name])

    return docs.select(kept).mapInArrow(apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **sample: float) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of `docs`; only doc_id and text are read.

    Rows that repeat are scored each for itself; an empty table gives no row.
    """
    model = train(docs, labels, **sample)
    return scored(docs.select(F.col("doc_id").cast("long"), "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
