"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The field labels white-space tokens O, email, ip, card or phone from word-shape features: the
token's shape, its class (count of digits, and which of `@`, `+`, three dots and letters it
has) and the classes of its neighbours.  It is trained from LABELLED below by gradient ascent
with forward-backward sums, on the driver, in under a second.  A token with neither a digit nor
`@` can only be O; so the chain falls apart into runs of other tokens, and Viterbi decodes
these runs, which is exact, in numpy batches of runs of like length.

Case by case: a null or empty text has no spans; a text of any length is read whole, in time
linear in its length; rows that repeat are searched each for itself; an empty table gives no
row; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillstone.sources.packaging import ship

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

#: The small labelled table; {kind:text} marks the personal data of a sentence.
LABELLED = """\
write to {email:ann.lee@mail.example.org} today
my address is {email:b.ruiz77@host.example} thanks
mail {email:sales@shop.example.com} or {email:help@shop.example.com} for prices
reach {email:root@localhost} on the old box
send it to {email:k_weber+news@uni.example.de} please
from {email:x9@a.example} at 9 in the morning
the host {ip:10.20.30.40} did not answer
connect to {ip:192.168.4.77:8080} with the tool
blocked {ip:203.0.113.9} and {ip:198.51.100.23} last night
peer {ip:172.16.254.1/24} is up
card {card:4111111111111111} was charged
paid by {card:5500 0000 0000 0004} in May
number {card:4012-8888-8888-1881} on file
use {card:4222.2222.2222.2228} for tests
kept {card:6011000990139424} for 2 days
call {phone:+1 (415) 555-0132} now
call me at {phone:415-555-0199} after work
office {phone:(020) 7946 0958} in London
mobile {phone:+49 1512 3456789} or desk
fax {phone:+33 1 23 45 67 89} only
tel {phone:555-867-5309} ask for Jo
dial {phone:+442079460000} first
ring {phone:(389) 555-5010} tomorrow
it was founded in 1987 and sold in 2004
the price rose from 12.50 to 13.75 on Monday
about 4,000 people and 35% more
version 3.11.2 came out on 2023-10-04
released under version 2.0 of the license
CC BY-NC 4.0. applies
General Public License, version 3.
at 10:30 or 22:45 on 12/05/2021
room 204 on floor 3 of building 7
token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" stays secret
commit 9fceb02d0ae598e95dc970b74767f19372d61af8 fixed it
order 100234567 shipped on 3/4
isbn 978-3-16-148410-0 is out of print
id 7781234 and id 99120034
section 4.2.1 of part 12
pages 118-131 and 201-207
scores of 21-14 and 3-0
the code a1b2c3 opens it
1984 2001 1999 2010 were good years
12 45 77 31 90 22 14
1000000 is a big number
3.14159 and 2.71828
see table 5, row 6, column 7
born 1961-02-03 in Lyon
@home and @work are tags
x@ is not one
chapter 10.4.3.2.1 is long
phi = 1.618 and e = 2.718
serial 00012300045600078900011 on the back
"""

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that begins no match is taken whole, so that no later start within it is tried.
_IP = re.compile(r"([0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)|[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if m[1] and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[1].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    twice = (int(x) * 2 for x in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(x - 9 if x > 9 else x for x in twice)) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


FINDERS = (emails, ips, cards, phones)

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]+")
_FROM_MARK = re.compile(r"[0-9@]\S*")
_EDGE = "\"'`.,;:!?#$%&*|<>[]{}"
PLAIN = 128


def token_class(token: str) -> int:
    digits = sum(map(len, _DIGITS.findall(token)))
    size = sum(digits > x for x in (0, 3, 6, 9, 13, 15, 19))
    return size * 16 + ("@" in token) * 8 + ("+" in token) * 4 + (token.count(".") == 3) * 2 + bool(_LETTERS.search(token))


def shape(token: str) -> str:
    return _DIGITS.sub("d", _LETTERS.sub("x", token))


def runs(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """Runs of tokens that have a digit or `@`, with nothing but white space between them: (start, end, token without marks at its edges)."""
    run: list[tuple[int, int, str]] = []
    last = 0
    for m in _FROM_MARK.finditer(text):
        start, end = m.span()
        while start > last and not text[start - 1].isspace():
            start -= 1
        if run and not text[last:start].isspace():
            yield run
            run = []
        last, token = end, text[start:end]
        left = len(token) - len(token.lstrip(_EDGE))
        token = token.strip(_EDGE)
        run.append((start + left, start + left + len(token), token))
    if run:
        yield run


class Field:
    """The trained field: emission weights by feature, and transitions; a run begins and ends at O."""

    def __init__(self, table: str = LABELLED, rounds: int = 400, l2: float = 0.02):
        data = []
        for line in table.splitlines():
            text, marks = "", []
            for part in re.split(r"(\{\w+:[^}]*\})", line):
                m = re.fullmatch(r"\{(\w+):([^}]*)\}", part)
                if m:
                    marks.append((len(text), len(text) + len(m[2]), LABELS.index(m[1])))
                text += m[2] if m else part
            for run in runs(text):
                data.append((run, [next((y for s, e, y in marks if a < e and s < b), 0) for a, b, _ in run]))
        self.shapes = {s: i + 1 for i, s in enumerate(sorted({shape(t) for run, _ in data for _, _, t in run}))}
        k = len(LABELS)
        self.w = [np.zeros((n, k)) for n in (len(self.shapes) + 1, PLAIN + 1, PLAIN + 1, PLAIN + 1)]
        self.t = np.zeros((k, k))
        feats, lengths = self.features([run for run, _ in data])
        gold = np.zeros(feats.shape[:2], int)
        for i, (_, ys) in enumerate(data):
            gold[i, : len(ys)] = ys
        self._fit(feats, lengths, gold, rounds, l2)

    def features(self, many: list[list]) -> tuple[np.ndarray, np.ndarray]:
        """(run, position, feature) ids, and the runs' lengths."""
        lengths = np.array([len(r) for r in many])
        out = np.zeros((len(many), lengths.max(), 4), int)
        out[:, :, 1:] = PLAIN
        for i, run in enumerate(many):
            classes = [PLAIN, *(token_class(t) for _, _, t in run), PLAIN]
            out[i, : len(run), 0] = [self.shapes.get(shape(t), 0) for _, _, t in run]
            for j, lag in ((1, 1), (2, 0), (3, 2)):
                out[i, : len(run), j] = classes[lag : lag + len(run)]
        return out, lengths

    def emissions(self, feats: np.ndarray) -> np.ndarray:
        return sum(w[feats[:, :, j]] for j, w in enumerate(self.w))

    def _fit(self, feats: np.ndarray, lengths: np.ndarray, gold: np.ndarray, rounds: int, l2: float) -> None:
        n, length, k = len(feats), feats.shape[1], len(LABELS)
        inside = np.arange(length) < lengths[:, None]
        total = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        params = [*self.w, self.t]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
        eye = np.eye(k)
        for step in range(1, rounds + 1):
            e = self.emissions(feats)
            a, b = np.zeros((n, length, k)), np.zeros((n, length, k))
            a[:, 0] = self.t[0] + e[:, 0]
            for i in range(1, length):
                a[:, i] = total(a[:, i - 1][:, :, None] + self.t, 1) + e[:, i]
            for i in range(length - 1, -1, -1):
                end = (i == lengths - 1)[:, None]
                nxt = total(self.t + (e[:, i + 1] + b[:, i + 1])[:, None, :], 2) if i + 1 < length else 0
                b[:, i] = np.where(end, self.t[:, 0], nxt)
            z = total(a[np.arange(n), lengths - 1] + self.t[:, 0], 1)
            p = np.exp(a + b - z[:, None, None]) * inside[:, :, None]
            diff = eye[gold] * inside[:, :, None] - p
            grads = [np.zeros_like(x) for x in params]
            for j in range(4):
                np.add.at(grads[j], feats[:, :, j][inside], diff[inside])
            g = grads[4]
            g[0] += diff[:, 0].sum(0)
            g[:, 0] += diff[np.arange(n), lengths - 1].sum(0)
            for i in range(1, length):
                on = inside[:, i]
                pair = np.exp(a[on, i - 1][:, :, None] + self.t + (e[on, i] + b[on, i])[:, None, :] - z[on][:, None, None])
                np.add.at(g, (gold[on, i - 1], gold[on, i]), 1)
                g -= pair.sum(0)
            for x, d, (m, v) in zip(params, grads, moments, strict=True):  # Adam's steps
                d -= l2 * x
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                x += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def decode(self, many: list[list]) -> list[np.ndarray]:
        """The best labels of each run, in batches of runs of about the same length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(many)
        order = sorted(range(len(many)), key=lambda i: len(many[i]))
        lo = 0
        while lo < len(order):
            longest = 2 * len(many[order[lo]])
            hi = lo + 1
            while hi < len(order) and hi - lo < 512 and len(many[order[hi]]) <= longest:
                hi += 1
            for i, labels in zip(order[lo:hi], self._viterbi(*self.features([many[i] for i in order[lo:hi]])), strict=True):
                out[i] = labels
            lo = hi
        return out

    def _viterbi(self, feats: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        e = self.emissions(feats)
        n, length, k = e.shape
        back = np.zeros((length, n, k), np.int8)
        best = self.t[0] + e[:, 0]
        final = np.zeros(n, int)
        for i in range(length):
            if i:
                paths = best[:, :, None] + self.t
                back[i] = paths.argmax(1)
                best = paths.max(1) + e[:, i]
            ends = lengths == i + 1
            final[ends] = (best[ends] + self.t[:, 0]).argmax(1)
        for r in range(n):
            labels = np.zeros(lengths[r], int)
            y = final[r]
            for i in range(lengths[r] - 1, -1, -1):
                labels[i] = y
                y = back[i, r, y]
            yield labels


@lru_cache(1)
def field() -> Field:
    return Field()


def added(many: list[list], model: Field) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each run, neighbours of one label joined."""
    out = []
    for run, labels in zip(many, model.decode(many), strict=True):
        spans: list[tuple[str, int, int]] = []
        before = 0
        for (start, end, _), y in zip(run, labels.tolist(), strict=True):
            if y and end > start:
                if y == before:
                    spans[-1] = (spans[-1][0], spans[-1][1], end)
                else:
                    spans.append((LABELS[y], start, end))
            before = y
        out.append(spans)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each row of `docs`: counts and digest of the base patterns' spans, and all spans.

    Spans are kind:start:end in code points, ends exclusive.  A span of the field is added where
    it overlaps no base span.
    """
    ship(docs.sparkSession)
    model = field()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                base, many, owner = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    base.append([[] for _ in KINDS] if not text else [[(k, *s) for s in f(text)] for k, f in zip(KINDS, FINDERS, strict=True)])
                    for run in runs(text or ""):
                        many.append(run)
                        owner.append(i)
                every = [[s for kind in spans for s in kind] for spans in base]
                digests = [joined(spans) for spans in every]
                extra = [0] * len(base)
                if many:
                    taken = [_union(spans) for spans in every]
                    for i, spans in zip(owner, added(many, model), strict=True):
                        for kind, s, e in spans:
                            if not _overlaps(taken[i], s, e):
                                every[i].append((kind, s, e))
                                extra[i] += 1
                counts = [pa.array([len(spans[j]) for spans in base], pa.int64()) for j in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *counts, pa.array([hashlib.sha256(d.encode()).hexdigest() for d in digests]), pa.array([joined(s) for s in every], pa.string()), pa.array(extra, pa.int64())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(find, SCHEMA)


def _union(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Sorted disjoint intervals that cover what the spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    i = bisect.bisect_left(taken, (start, start))
    return any(s < end and start < e for s, e in taken[max(0, i - 1) : i + 1])
