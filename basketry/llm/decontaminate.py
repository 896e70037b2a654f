"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of shingles of ``SHINGLE`` words (A-Z lowered). An item
is found in a document when at least ``THRESHOLD`` of its shingles stand there. An item of
fewer words is one shingle of that many, and is looked for among the documents' shingles
of the same number of words: with one shingle, its hash is its only min-hash value.

A short item has a tiny Jaccard similarity with a long document, so the search runs
by size: items are partitioned by the power of two above their number of shingles,
and for each partition of upper size L the documents are cut into windows of 2 L
shingles that start every L/2. Within a window the containment threshold turns into
a Jaccard threshold of 0.16 or more, so with ``HASHES`` min-hash values an item and a
window that match share none of them with a probability under 2e-5. Windows whose
values meet those of an item are candidates; a candidate is verified exactly, with
the shingle sets of the item and of the whole document.

Items are the query set. They go to the tasks in blocks of at most ``BLOCK_BYTES`` of
text (summed first); every block passes over all documents. A task holds a block's texts and
``HASHES`` values an item; shingle sets are made for the items that are candidates, a few at
a time. Documents are not shuffled, so a hot source or many copies land nowhere in particular.

Defined cases: null text is empty; a text of one to four words has one shingle for longer
items; an item without words matches nothing; repeated items are one, repeated documents
each give their rows; null ids are carried. Empty tables give empty results. Extra
columns are ignored by ``contaminated`` and kept by ``drop_contaminated``."""

from __future__ import annotations

import random
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import chunks, id_text, lowered_words, over_batches, written

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 64
BLOCK_BYTES = 32 << 20
PIECE_BYTES = 4 << 20

_rng = random.Random(7)
_odd = lambda: _rng.getrandbits(64) | 1
_BYTE = np.array([_rng.getrandbits(64) for _ in range(256)], np.uint64)
_BASE = np.uint64(_odd())
_WORD = np.array([_odd() for _ in range(SHINGLE)], np.uint64)
_MUL = np.array([_odd() for _ in range(HASHES)], np.uint64)
_ADD = np.array([_rng.getrandbits(64) for _ in range(HASHES)], np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FILTER_BITS = 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_hashes(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): the hashes of the shingles of k words of lowered texts, one after
    another, and their number per text. Words are hashed by position and byte, all at once."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = ~_IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    counts = np.zeros(len(texts), np.int64)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    first = np.searchsorted(starts, at)                  # first word of each text
    n_words = np.diff(first)
    where = np.flatnonzero(inside)
    lens = ends - starts
    offsets = np.cumsum(lens) - lens
    in_word = np.arange(len(where)) - np.repeat(offsets, lens)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
        w = _mixed(np.add.reduceat(_BYTE[buf[where]] * powers[in_word], offsets))
        padded = np.concatenate([w, np.zeros(SHINGLE, np.uint64)])
        h = sum(padded[j:j + len(w)] * _WORD[j] for j in range(k))
        counts = np.where(n_words > 0, np.maximum(1, n_words - k + 1), 0)
        for i in np.flatnonzero((n_words > 0) & (n_words < k)):
            f, n = first[i], n_words[i]
            h[f] = (w[f:f + n] * _WORD[:n]).sum(dtype=np.uint64)
        keep = np.repeat(first[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return _mixed(h[keep]), counts


def shingle_set(text: str, k: int = SHINGLE) -> set[bytes]:
    ws = lowered_words(text)
    return {b" ".join(ws[i:i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def _half(size: int) -> int:
    return max(1, size // 2)


@dataclass
class Partition:
    """Items of one size class: their min-hash values, sorted, with the item of each."""
    values: np.ndarray
    items: np.ndarray
    maybe: np.ndarray = field(init=False)

    def __post_init__(self):
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.values & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True

    def find(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in v, index of a value equal to it), for every equal value."""
        hit = np.flatnonzero(self.maybe[(v & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        lo, hi = (np.searchsorted(self.values, v[hit], s) for s in ("left", "right"))
        n = hi - lo
        return np.repeat(hit, n), np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


class Index:
    """The item side: sizes, min-hash values, and exact shingle sets on demand."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.width = [min(SHINGLE, len(lowered_words(t))) for t in self.texts]
        self.shingles = lru_cache(maxsize=256)(lambda k: shingle_set(self.texts[k]))
        self.sizes = [len(shingle_set(t)) for t in self.texts]
        self.partitions: dict[int, Partition] = {}
        self.short: dict[int, Partition] = {}            # by number of words
        by_size: dict[int, list[int]] = {}
        by_width: dict[int, list[int]] = {}
        for k, (n, w) in enumerate(zip(self.sizes, self.width)):
            if n and w == SHINGLE:
                by_size.setdefault(1 << (n - 1).bit_length(), []).append(k)
            elif n:
                by_width.setdefault(w, []).append(k)
        flat = lambda ks: [self.texts[k].encode("utf-8", "surrogatepass").lower() for k in ks]
        for size, ks in sorted(by_size.items()):
            h, counts = shingle_hashes(flat(ks))
            starts = np.cumsum(counts) - counts
            with np.errstate(over="ignore"):
                mins = [np.minimum.reduceat(h * _MUL[j] + _ADD[j], starts) for j in range(HASHES)]
            self.partitions[size] = self._sorted(np.concatenate(mins), np.tile(np.array(ks, np.int32), HASHES))
        for width, ks in sorted(by_width.items()):
            self.short[width] = self._sorted(shingle_hashes(flat(ks), width)[0], np.array(ks, np.int32))

    @staticmethod
    def _sorted(values: np.ndarray, who: np.ndarray) -> Partition:
        order = np.argsort(values, kind="stable")
        return Partition(values[order], who[order])

    @property
    def overlap(self) -> int:
        return 2 * max(self.partitions, default=1)

    def candidates(self, texts: list[bytes]) -> set[tuple[int, int]]:
        """(text, item) pairs of which a window shares a min-hash value."""
        found: set[tuple[int, int]] = set()
        for width, part in self.short.items():
            h, counts = shingle_hashes(texts, width)
            at, value = part.find(h)
            found.update(zip(np.repeat(np.arange(len(texts)), counts)[at].tolist(), part.items[value].tolist()))
        h, counts = shingle_hashes(texts) if self.partitions else (np.zeros(0, np.uint64), None)
        if not len(h):
            return found
        offsets = np.cumsum(counts) - counts
        plans = []
        for size, part in self.partitions.items():
            half = _half(size)
            n_blocks = -(-counts // half)
            first = np.cumsum(n_blocks) - n_blocks
            inner = np.arange(n_blocks.sum()) - np.repeat(first, n_blocks)
            starts = np.repeat(offsets, n_blocks) + inner * half
            text = np.repeat(np.arange(len(texts)), n_blocks)
            joins = [np.flatnonzero(text[s:] == text[:len(text) - s]) for s in (1, 2, 3)]
            plans.append((part, starts, text, joins))
        for j in range(HASHES):
            with np.errstate(over="ignore"):
                v = h * _MUL[j] + _ADD[j]
            for part, starts, text, joins in plans:
                low = np.minimum.reduceat(v, starts)
                window = low.copy()
                for s, at in zip((1, 2, 3), joins):      # four half-size blocks make a window
                    window[at] = np.minimum(window[at], low[at + s])
                at, value = part.find(window)
                if len(at):
                    found.update(zip(text[at].tolist(), part.items[value].tolist()))
        return found


def _pieces(text: bytes, overlap: int) -> list[bytes]:
    """A very long text in pieces that share ``overlap`` words, cut at white space."""
    out = []
    while len(text) > 2 * PIECE_BYTES:
        cut = text[:PIECE_BYTES].rsplit(None, 1)[0]
        tail = cut.rsplit(None, overlap + SHINGLE)
        back = len(cut) - len(tail[0]) if len(tail) > 1 else 0
        if len(cut) - back < PIECE_BYTES // 2:           # words too long to cut by: leave whole
            break
        out.append(cut)
        text = text[len(cut) - back:]
    return [*out, text]


def matches(texts: list[str], index: Index) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of the verified pairs."""
    flat, of = [], []
    for i, t in enumerate(texts):
        for p in _pieces(t.encode("utf-8", "surrogatepass").lower(), index.overlap):
            flat.append(p)
            of.append(i)
    by_text: dict[int, set[int]] = {}
    for p, k in index.candidates(flat):
        by_text.setdefault(of[p], set()).add(k)
    out = []
    for i, ks in sorted(by_text.items()):
        have = {w: shingle_set(texts[i], w) for w in {index.width[k] for k in ks}}
        for k in sorted(ks):
            shared = len(index.shingles(k) & have[index.width[k]])
            if shared >= THRESHOLD * index.sizes[k]:
                out.append((i, k, shared))
    return out


def _item_blocks(benchmark: DataFrame):
    """The items, block by block: each block's text is bounded, so it may be collected."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = sorted(((r.item_id, r.text) for r in block.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        yield k, n, [r for r in rows if r[1].strip()]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every match."""
    spark, out = docs.sparkSession, None
    schema = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"
    for _, _, rows in _item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for b in chunks(batches):
                ids = b.column("doc_id").to_pylist()
                got = [(ids[i], index.ids[k], index.sizes[k], n, n / index.sizes[k])
                       for i, k, n in matches(b.column("text").to_pylist(), index)]
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(names, g)) for g in got],
                    schema=pa.schema(list(zip(names, [pa.int64()] * 4 + [pa.float64()]))))
        names = ["doc_id", "item_id", "n_shingles", "n_shared", "containment"]
        part = over_batches(id_text(docs), run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item is found."""
    for k, n, rows in _item_blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            index = Index(sent.value)
            for b in chunks(batches):
                keep = np.ones(b.num_rows, bool)
                for i, _, _ in matches([t or "" for t in b.column("text").to_pylist()], index):
                    keep[i] = False
                yield b.filter(pa.array(keep))
        docs = over_batches(docs, run, docs.schema)
        if k + 1 < n:
            docs = written(docs, "decontaminated")
    return docs
