"""Line dedup with a sharded minimal perfect hash.

Lines are compared by key: the line without ``SPACE`` at both ends, A-Z lowered.
Keys of at least ``min_chars`` code points that stand in at least ``min_docs``
documents lose all their lines but those in the largest doc_id that holds them.

1. Each document emits the 128-bit hash of each of its distinct long keys once;
   counts and the largest doc_id are combined on the map side.
2. The hashes that reach ``min_docs`` are dealt to shards of about ``shard_keys``
   keys. Each shard builds a minimal perfect hash (levels of bit arrays; a key that
   collides moves to the next level; its index is the rank of its bit) over arrays
   of fingerprints (64 bits, so a line that is not in the table is not taken for
   one that is), counts and largest ids.
3. Documents probe the arrays; no line is joined. Shards are sent to the tasks in
   groups of at most ``max_group_bytes`` (their written size is summed first); a
   table beyond one group is probed group by group, with the documents written to
   the shared folder between groups. A hot line is one entry of one array.

Defined cases: null or empty text is one empty line; rows of one doc_id are one document
when counting, and all rows of the largest doc_id keep the line; rows with a null doc_id
are no document that counts, and never hold the kept copy. Empty tables give empty results.
Extra columns are kept by ``dedup`` and ignored by ``line_dedup``."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import SPACE, chunks, id_text, over_batches, ship, written

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 200_000
MAX_GROUP_BYTES = 128 << 20
_NO_ID = -(1 << 63)


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key, or None when it has fewer than ``min_chars`` code points."""
    s = line.strip(SPACE)
    return s.encode("utf-8", "surrogatepass").lower() if len(s) >= min_chars else None


def _halves(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h >> 64, h & ((1 << 64) - 1)


# ------------------------------------------------------------ minimal perfect hash
def _mix(hi: np.ndarray, lo: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hi ^ (lo * np.uint64(0x9E3779B97F4A7C15 + 2 * level) + np.uint64(level))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class PerfectHash:
    """Index of each of n known keys in 0..n-1; an unknown key gets -1 or some index,
    which the fingerprint array then refutes."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, spread: float = 2.0):
        self.levels: list[np.ndarray] = []          # bit arrays, one byte a bit
        self.ranks: list[np.ndarray] = []           # keys before each block of 64 bits
        placed, level = 0, 0
        while len(hi):
            m = max(64, -(-int(spread * len(hi)) // 64) * 64)
            at = _mix(hi, lo, level) % np.uint64(m)
            alone = np.bincount(at.astype(np.int64), minlength=m) == 1
            self.levels.append(np.packbits(alone))
            self.ranks.append(placed + np.concatenate(
                [[0], np.cumsum(alone.reshape(-1, 64).sum(1))[:-1]]).astype(np.int64))
            placed += int(alone.sum())
            stay = ~alone[at.astype(np.int64)]
            hi, lo, level = hi[stay], lo[stay], level + 1

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.full(len(hi), -1, np.int64)
        open_ = np.arange(len(hi))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(open_):
                break
            at = (_mix(hi[open_], lo[open_], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            a = at[hit]
            blocks = bits.view(">u8")[a >> 6].astype(np.uint64)
            before = np.bitwise_count(blocks & ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (a & 63).astype(np.uint64)))
            out[open_[hit]] = ranks[a >> 6] + before
            open_ = open_[~hit]
        return out


class Shard:
    """Compact arrays behind one perfect hash."""

    def __init__(self, hi, lo, counts, largest):
        self.hash = PerfectHash(hi, lo)
        at = self.hash.index(hi, lo)
        self.fingerprints, self.counts, self.largest = (np.empty(len(hi), t) for t in ("u8", "i8", "i8"))
        self.fingerprints[at], self.counts[at], self.largest[at] = lo, counts, largest

    def probe(self, hi, lo) -> tuple[np.ndarray, np.ndarray]:
        """(known, largest doc_id) for each key."""
        at = self.hash.index(hi, lo)
        if not len(self.fingerprints):
            return np.zeros(len(hi), bool), np.zeros(len(hi), np.int64)
        known = (at >= 0) & (self.fingerprints[np.maximum(at, 0)] == lo)
        return known, self.largest[np.maximum(at, 0)]


# ------------------------------------------------------------ the three steps
def frequent_lines(docs: DataFrame, min_chars: int = MIN_CHARS,
                   min_docs: int = MIN_DOCS) -> DataFrame:
    """(hi, lo, n_docs, largest) of the keys that stand in ``min_docs`` documents."""
    def run(batches):
        for b in chunks(batches):
            his, los, ids = [], [], []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                for k in {k for k in (line_key(x, min_chars) for x in t.split("\n")) if k is not None}:
                    hi, lo = _halves(k)
                    his.append(hi)
                    los.append(lo)
                    ids.append(i)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([as_long(his), as_long(los), pa.array(ids, pa.int64())],
                                             ["hi", "lo", "doc_id"])
    found = over_batches(id_text(docs).where("doc_id is not null"), run, "hi long, lo long, doc_id long")
    # rows of one id are one document; where ids repeat, their lines are made distinct first
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    repeated = written(ids.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if repeated.take(1):
        found = found.join(repeated, "doc_id", "left_anti").select("hi", "lo", "doc_id").unionByName(
            found.join(repeated, "doc_id", "left_semi").select("hi", "lo", "doc_id").distinct())
    return (found.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("largest"))
            .where(F.col("n_docs") >= min_docs))


def build_shards(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(shard, blob) rows and the number of shards; a shard holds about ``shard_keys``
    keys, as hashes deal them evenly."""
    lines = written(lines, "frequent-lines")
    n = max(1, -(-lines.count() // shard_keys))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        u = lambda c: rows[c].to_numpy(np.int64).view(np.uint64)
        s = Shard(u("hi"), u("lo"), rows["n_docs"].to_numpy(),
                  rows["largest"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [key[0]], "blob": [pickle.dumps(s)]})

    # pandas would read a long with nulls as floats
    lines = lines.select("hi", "lo", "n_docs", F.coalesce("largest", F.lit(_NO_ID)).alias("largest"),
                         F.pmod("hi", F.lit(n)).alias("shard"))
    ship(lines.sparkSession)
    return written(lines.groupBy("shard").applyInPandas(build, "shard long, blob binary"), "shards"), n


def _groups(shards: DataFrame, max_bytes: int) -> list[list[int]]:
    """Shard numbers in groups whose blobs stay under ``max_bytes`` (one at least)."""
    out, size = [[]], 0
    for s, b in sorted((r.shard, r.b) for r in shards.select("shard", F.length("blob").alias("b")).collect()):
        if out[-1] and size + b > max_bytes:
            out.append([])
            size = 0
        out[-1].append(s)
        size += b
    return out


def _strike(lines: list[str], doc_id, shards: dict, n_shards: int, min_chars: int) -> list[bool]:
    """True for each line that goes."""
    keys = [line_key(x, min_chars) for x in lines]
    at = [i for i, k in enumerate(keys) if k is not None]
    gone = [False] * len(lines)
    if not at:
        return gone
    hs = np.array([_halves(keys[i]) for i in at], np.uint64)
    hi, lo = hs[:, 0].copy(), hs[:, 1].copy()
    of = np.mod(hi.view(np.int64), n_shards)
    for s in np.unique(of):
        if (shard := shards.get(int(s))) is None:
            continue
        sel = np.flatnonzero(of == s)
        known, largest = shard.probe(hi[sel], lo[sel])
        for j, k, top in zip(sel, known, largest):
            gone[at[j]] = bool(k) and (doc_id is None or int(top) != doc_id)
    return gone


def _probed(docs: DataFrame, spark, blobs: dict, n_shards: int, min_chars: int) -> DataFrame:
    """``docs`` (doc_id, text, n_lines, n_dropped, rest struct) less the lines of ``blobs``."""
    sent = spark.sparkContext.broadcast(blobs)

    def run(batches):
        shards = {s: pickle.loads(b) for s, b in sent.value.items()}
        for b in chunks(batches):
            texts, dropped = [], []
            cols = (b.column(c).to_pylist() for c in ("doc_id", "text", "n_dropped"))
            for i, t, d in zip(*cols):
                lines = t.split("\n")
                gone = _strike(lines, i, shards, n_shards, min_chars)
                texts.append("\n".join(x for x, g in zip(lines, gone) if not g))
                dropped.append(d + sum(gone))
            new = {"text": pa.array(texts, pa.string()), "n_dropped": pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, b.column(n)) for n in b.schema.names],
                                             b.schema.names)
    return over_batches(docs, run, docs.schema)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
          shard_keys: int = SHARD_KEYS, max_group_bytes: int = MAX_GROUP_BYTES) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped, row): text without the dropped lines; ``row``
    holds every column of ``docs`` as it was, but the text."""
    spark = docs.sparkSession
    shards, n = build_shards(frequent_lines(docs, min_chars, min_docs), shard_keys)
    out = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    ).select("doc_id", "text",
             (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"),
             F.lit(0).cast("long").alias("n_dropped"), "row")
    groups = _groups(shards, max_group_bytes)
    for k, group in enumerate(groups):
        blobs = {r.shard: bytes(r.blob) for r in shards.where(F.col("shard").isin(group)).collect()}
        if blobs:
            out = _probed(out, spark, blobs, n, min_chars)
        if k + 1 < len(groups):
            out = written(out, "probed")
    return out


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row per row of ``docs``."""
    return dedup(docs, **options).select("doc_id", "n_lines", "n_dropped",
                                         F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def drop_repeated_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept lines as text; ``n_chars``, if there, follows the text."""
    out = dedup(docs, **options)
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.length("text").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return out.select(*cols)
