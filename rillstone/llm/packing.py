"""Hierarchical multi-length packing of token sequences.

1. Documents are tokenized and routed: whole windows of the largest tier are cut from long
   ones, and what is left goes to the pool of the smallest tier that holds it.
2. Each tier is packed from its own pool, the longest tier first: a rest begins a window, and
   the window's gap takes the longest rests of the same and shorter tiers that fit whole.  What
   is still open takes a piece of the one document that is being cut up; only when it is used
   up another one is, the longest, so few documents are cut.
3. `reserve` tokens wait for later documents, so that gaps find rests that fit.  A partition's
   last rests fill smaller tiers in turn; only its last sequence can need padding.
4. Windows of all partitions, the largest first, are dealt in turn to step groups, about
   `step_tokens` each.  So groups hold the same mixture of tiers; their counts of windows differ
   by one at most, and their counts of tokens by at most a window of the largest tier.

Documents are packed where they are read: a lost task packs its own rows again in the same way.
Memory holds one Arrow batch of token ids, the reserve, and a dictionary of at most `cache`
chunks of text.  The pieces, a few numbers each, are written once; for the groups only counts by
partition and size are summed up.
"""

from __future__ import annotations

import bisect
import ctypes
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstone.sources.packaging import ship

from .shared import written

END_ID = 2
TIERS = (512, 1024, 2048, 4096)
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier int, sequence_tokens int, tier_rank long"
)


class Encoder:
    """Token ids by a vocabulary file, as little-endian unsigned 32-bit bytes.

    A tokenizer whose rules aren't CHUNKED ones encodes whole texts.  One of these rules composes, lower-cases, drops white space and never joins across it, nor across
    the border of letters and marks.  So a text's ids are those of its chunks, one after the
    other: text between ASCII white space, marks after a letter at a chunk's end apart.  Texts
    of Latin characters are lower-cased first, which changes no id and makes chunks repeat more.
    Chunks seen before come from a dictionary, which starts anew at `cache` entries; a worker
    keeps it for its later tasks.
    """

    def __init__(self, path: str, cache: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), cache
        self.known = _Known(self.tokenizer)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.chunked = all(rules.get(k) == v for k, v in CHUNKED.items()) and rules["model"].get("end_of_word_suffix") == "</w>"

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        for t in texts:
            if not self.chunked:
                yield array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()
                continue
            if not _BEYOND.search(t):
                chunks = _TAIL.sub(r" \g<0>", t.lower()).split()
            else:  # split() also cuts at separators that the tokenizer may not take for white space
                chunks = t.translate(_PLAIN).split(" ")
            if len(self.known) > self.most:
                self.known.clear()
            yield b"".join(map(self.known.__getitem__, chunks))


#: The rules of tokenizers whose ids are those of chunks.
CHUNKED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}


class _Known(dict):
    def __init__(self, tokenizer):
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) < 100:
            self[chunk] = ids
        return ids


def give_back() -> None:
    """Returns what this worker's earlier tasks have freed to the system, before the dictionary grows."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Beyond these, and at the separators among them, the shortcuts of Encoder don't hold: dotted capital I too.
_BEYOND = re.compile("[^\x00-\x0a\x0d-\x1b\x20-\x84\x86-\x9f\xa1-įı-ɏ]")
_TAIL = re.compile(r"[.,!?;:#$%&*|](?<=[a-zà-öø-ÿ].)[.,!?;:#$%&*|]*(?=[ \n]|$)")
_PLAIN = str.maketrans("\t\n\r", "   ")


class Packer:
    """Packs rests (key, start, length), all shorter than the largest tier, from a pool for each tier."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, reserve: int = 16):
        self.tiers = tuple(sorted(tiers))
        self.pools: dict[int, list[tuple[int, int, int]]] = {t: [] for t in self.tiers}  # (length, key, start), sorted
        self.cut: tuple[int, int, int] | None = None  # what is left of the document that is being cut up
        self.total, self.reserve = 0, reserve * self.tiers[-1]

    def add(self, key: int, start: int, length: int) -> None:
        bisect.insort(self.pools[next(t for t in self.tiers if t >= length)], (length, key, start))
        self.total += length

    def keys(self) -> set[int]:
        return {k for pool in self.pools.values() for _, k, _ in pool} | ({self.cut[1]} if self.cut else set())

    def _whole(self, most: int) -> tuple[int, int, int] | None:
        """The longest rest of at most so many tokens."""
        for tier in reversed(self.tiers):
            i = bisect.bisect_right(self.pools[tier], (most, 1 << 62, 1 << 62))
            if i:
                return self.pools[tier].pop(i - 1)
        return None

    def _piece(self, most: int) -> tuple[int, int, int]:
        """A piece of at most so many tokens of the document that is being cut up."""
        if self.cut is None:
            self.cut = self.pools[max(t for t in self.tiers if self.pools[t])].pop()
        n, key, start = self.cut
        used = min(n, most)
        self.cut = (n - used, key, start + used) if used < n else None
        return used, key, start

    def _window(self, tier: int) -> list[tuple[int, int, int]]:
        """A full window (key, start, length) of this size; there are as many tokens."""
        pieces, gap = [], tier
        while gap:
            n, key, start = self._whole(gap) or self._piece(gap)
            pieces.append((key, start, n))
            gap -= n
        self.total -= tier
        return pieces

    def windows(self, last: bool) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(size, pieces) of full windows, tier by tier, the longest first; with `last`, all that is left too."""
        for tier in reversed(self.tiers):
            while self.total >= (tier if last else self.reserve) and (self.pools[tier] or self.cut and self.cut[0] > tier // 2):
                yield tier, self._window(tier)
        while last and self.total:
            size = max((t for t in self.tiers if t <= self.total), default=self.total)
            yield size, self._window(size)


def _sequences(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...], reserve: int) -> DataFrame:
    """The pieces of packed sequences; tier_rank counts a partition's sequences of one size."""
    largest = tiers[-1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        give_back()
        packer, encode = Packer(tiers, reserve), encoder(tokenizer).encode
        part = TaskContext.get().partitionId() << 32
        store: dict[int, tuple[int | None, bytes]] = {}
        ranks: dict[int, int] = defaultdict(int)
        serial = sequence = 0

        def rows(windows: list) -> pa.RecordBatch:
            nonlocal sequence
            cols: list[list] = [[] for _ in range(10)]
            for size, pieces in windows:
                offset = 0
                for key, start, n in pieces:
                    doc, ids = store[key]
                    for col, value in zip(cols, (doc, start, n, zlib.crc32(memoryview(ids)[4 * start : 4 * (start + n)]), len(ids) // 4, part + sequence, offset, size if size in tiers else largest, size, ranks[size]), strict=True):
                        col.append(value)
                    offset += n
                sequence += 1
                ranks[size] += 1
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo in range(0, len(doc_ids), 1000):
                ready = []
                some = [t or "" for t in batch.column(1)[lo : lo + 1000].to_pylist()]
                for doc, ids in zip(doc_ids[lo : lo + 1000], encode(some), strict=True):
                    ids += _END
                    store[serial] = (doc, ids)
                    n = len(ids) // 4
                    whole = n // largest * largest
                    ready += [(largest, [(serial, s, largest)]) for s in range(0, whole, largest)]
                    if n > whole:
                        packer.add(serial, whole, n - whole)
                    serial += 1
                ready += packer.windows(last=False)
                yield rows(ready)
                left = packer.keys()
                store = {k: v for k, v in store.items() if k in left}
        if packer.total:
            yield rows(list(packer.windows(last=True)))

    return docs.select(docs["_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(pack, SCHEMA)


def grouped(pieces: DataFrame, step_tokens: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """`pieces` with `step_group` in place of tier_rank: all sequences, the largest first, are dealt to the groups in turn."""
    part = F.shiftright("sequence_id", 32)
    counts = pieces.filter("offset = 0").groupBy(part.alias("_part"), "sequence_tokens").agg(F.count("*").alias("_n"))
    counts = written(counts, "sequences")  # a few rows for each partition
    groups = max(1, round((counts.agg(F.sum(F.col("sequence_tokens") * F.col("_n"))).first()[0] or 0) / step_tokens))
    within = F.sum("_n").over(Window.partitionBy("sequence_tokens").orderBy("_part")) - F.col("_n")
    sizes = counts.groupBy("sequence_tokens").agg(F.sum("_n").alias("_all"))  # as many rows as sizes, which are at most the largest tier
    ahead = sizes.select("sequence_tokens", (F.sum("_all").over(Window.orderBy(F.desc("sequence_tokens"))) - F.col("_all")).alias("_ahead"))
    starts = counts.withColumn("_within", within).join(F.broadcast(ahead), "sequence_tokens").select("_part", "sequence_tokens", (F.col("_ahead") + F.col("_within")).alias("_start"))
    if counts.count() <= broadcast_rows:
        starts = F.broadcast(starts)
    dealt = pieces.withColumn("_part", part).join(starts, ["_part", "sequence_tokens"])
    return dealt.select(*[c for c in pieces.columns if c != "tier_rank"], F.pmod(F.col("_start") + F.col("tier_rank"), F.lit(groups)).alias("step_group"))


def packed(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, step_tokens: int = 65536, reserve: int = 16, text: str = "text") -> DataFrame:
    """One row for each piece of each row of `docs` (doc_id, text); the tokenizer file is read by every worker.

    A null or empty text is its end id alone.  Rows with the same doc_id are packed each for
    itself.  Other columns, whatever their names, are not read.  An empty table gives no row.
    `sequence_id` is the partition's number times 2**32, counted up within it; `step_group`
    counts from 0.  Sequences of other sizes than the tiers' are to be padded to the largest.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers) or step_tokens % tiers[-1]:
        raise ValueError("tiers are powers of two, and a step group holds whole windows of the largest")
    ship(docs.sparkSession)
    docs = docs.select(docs["doc_id"].alias("_id"), docs[text].alias("text"))
    return grouped(written(_sequences(docs, tokenizer, tiers, reserve), "pieces"), step_tokens)


_END = np.asarray([END_ID], "<u4").tobytes()
