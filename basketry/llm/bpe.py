"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Each task cuts its texts into pre-tokens, a block of texts at a time (at most
   ``BLOCK_CHARS`` characters, or one longer text). A block has a dictionary of its
   distinct words and the position list: for every position of the block, the number of
   its word. The dictionary is dealt to buckets by the hash of the word, a packet of words
   per bucket. Packets are written to the shared folder as a table. Position lists go to
   files beside it, one per attempt of a task, and only their place enters the table; so
   they never travel, and the table names no file of an attempt that failed.
2. Packets are shuffled by bucket, so all packets that hold a word meet in one task, which
   encodes each distinct word once and answers every packet with the ids of its words. A
   frequent word is one entry per block, not one per occurrence.
3. The answers are joined by block to the place of the position list, which is read there,
   and the texts are reassembled by position, a few at a time.

Decoding joins the token-byte table: it has one entry per id of the vocabulary, a
fixed size, so every task holds it. ``round_trip`` decodes where step 3 runs.

The vocabulary file is read where the driver runs, by the path given, and its ranks are
sent to the tasks.

Defined cases: null and empty texts have no ids and decode to no bytes; rows that repeat
a document each give a row; null ids are carried. Empty tables give empty results.
Extra columns are ignored."""

from __future__ import annotations

import base64
import itertools
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from basketry.llm.common import chunks, filesystem, id_text, over_batches, scratch, ship, written

import public_tokenizers

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_CHARS = 12 << 20
PIECE = 1 << 17       # positions put together at a time


def ranks(path: str | None = None) -> dict[bytes, int]:
    """Token bytes to rank, of a tiktoken rank file."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _packed(lens, flat: bytes) -> bytes:
    """Lengths and the bytes they divide, compressed."""
    return zstandard.compress(len(lens).to_bytes(4, "little") + np.asarray(lens, "<u4").tobytes() + flat, 3)


def _unpacked(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    return np.frombuffer(raw, "<u4", n, 4).astype(np.int64), raw[4 + 4 * n:]


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers compressed byte plane by byte plane: high bytes are mostly zero."""
    return zstandard.compress(np.ascontiguousarray(
        x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unplaned(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


_BLOCKS = ("block long, bucket int, packet binary, doc_ids array<long>, counts array<long>, "
           "file string, places array<long>")
_BLOCKS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("packet", pa.binary()),
                           ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                           ("file", pa.string()), ("places", pa.list_(pa.int64()))])


def _blocks(docs: DataFrame, pattern: str, block_chars: int, n_buckets: int, folder: str) -> DataFrame:
    """Two kinds of rows: (block, bucket, packet), the words of a block in a bucket; and
    (block, null, ..., doc_ids, counts, file, places), its texts. The file has, from the first
    place to the second, the number of each word in the order of the packets, and from there
    to the third the position list."""
    def run(batches):
        split = regex.compile(pattern)
        task, n = TaskContext.get().partitionId(), 0
        number, at, ids, counts, chars = {}, [], [], [], 0
        store, base = filesystem(folder)
        file = f"{uuid.uuid4().hex}.positions"
        out, size = None, 0

        def block():
            nonlocal out, size
            flat = np.concatenate(at) if at else np.zeros(0, np.int32)
            at.clear()
            # words are numbered anew by falling frequency, so most positions are small
            falling = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")
            new = np.empty(len(number), np.int32)
            new[falling] = np.arange(len(number), dtype=np.int32)
            by_bucket: dict[int, list[tuple[bytes, int]]] = {}
            for w, k in number.items():
                b = w.encode("utf-8", "surrogatepass")
                by_bucket.setdefault(zlib.crc32(b) % n_buckets, []).append((b, k))
            rows, order = [], []
            for bucket, ws in sorted(by_bucket.items()):
                ws.sort()
                order += [k for _, k in ws]
                rows.append({"block": (task << 32) | n, "bucket": bucket,
                             "packet": _packed([len(b) for b, _ in ws], b"".join(b for b, _ in ws))})
            if out is None:
                out = store.open_output_stream(f"{base}/{file}", compression=None)
            places = [size]
            for part in (_planes(new[np.array(order, np.int64)]), _planes(new[flat])):
                out.write(part)
                size += len(part)
                places.append(size)
            rows.append({"block": (task << 32) | n, "doc_ids": ids, "counts": counts, "file": file, "places": places})
            return pa.RecordBatch.from_pylist(rows, schema=_BLOCKS_ARROW)
        for b in chunks(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if chars and chars + len(t) > block_chars:
                    yield block()
                    n += 1
                    number, at, ids, counts, chars = {}, [], [], [], 0
                found = split.findall(t)
                for w in found:
                    if w not in number:
                        number[w] = len(number)
                at.append(np.fromiter(map(number.__getitem__, found), np.int32, len(found)))
                ids.append(i)
                counts.append(len(found))
                chars += len(t)
        if ids:
            yield block()
        if out is not None:
            out.close()
    return over_batches(id_text(docs), run, _BLOCKS)


def _encoded(packets: DataFrame, table: dict[bytes, int], pattern: str) -> DataFrame:
    """(of, bucket, ids): the ids of each packet's words. ``packets`` come bucket by bucket."""
    sent = packets.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        enc = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        current, known = None, {}
        for b in chunks(batches, 64):
            out = []
            for bucket, blob in zip(b.column("bucket").to_pylist(), b.column("packet").to_pylist()):
                if bucket != current:
                    current, known = bucket, {}
                lens, flat = _unpacked(blob)
                ends = np.cumsum(lens).tolist()
                got = []
                for a, e in zip([0, *ends], ends):
                    w = flat[a:e]
                    if w not in known:      # a word is a single match of the pattern already
                        known[w] = enc._core_bpe.encode_single_piece(w)
                    got.append(known[w])
                ids = np.fromiter(itertools.chain.from_iterable(got), "<i4")
                out.append(_packed([len(x) for x in got], ids.tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("of"), b.column("bucket"), pa.array(out, pa.binary())],
                                             ["of", "bucket", "ids"])
    return over_batches(packets, run, "of long, bucket int, ids binary")


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_BOTH = pa.schema([*_IDS, ("bytes", pa.binary())])


def _reassembled(folder: str, found: pa.Table, block: pa.Table) -> Iterator[pa.RecordBatch]:
    """The ids of each text of a block, by position: a few texts at a time (at most
    ``PIECE`` positions, or one longer text), as each position takes many bytes on the way."""
    row = block.select(["doc_ids", "counts", "file", "places"]).to_pylist()[0]
    store, base = filesystem(folder)
    with store.open_input_file(f"{base}/{row['file']}") as f:
        a, b, c = row["places"]
        f.seek(a)
        numbers, at = _unplaned(f.read(b - a)), _unplaned(f.read(c - b))
    packets = [_unpacked(p["ids"]) for p in sorted(found.select(["bucket", "ids"]).to_pylist(), key=lambda p: p["bucket"])]
    lens = np.concatenate([n for n, _ in packets]) if packets else np.zeros(0, np.int64)
    flat = np.frombuffer(b"".join(f for _, f in packets), "<i4")
    # from the order of the packets to the numbers of the words
    starts = np.empty(len(lens), np.int64)
    starts[numbers] = np.cumsum(lens) - lens
    size_of = np.empty(len(lens), np.int64)
    size_of[numbers] = lens
    ends = np.concatenate([[0], np.cumsum(row["counts"], dtype=np.int64)])
    i = 0
    while i < len(row["doc_ids"]):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + PIECE, "right")) - 1)
        here = at[ends[i]:ends[j]]
        size = size_of[here]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(starts[here] - total[:-1], size) + np.arange(total[-1])]
        lists = pa.ListArray.from_arrays(pa.array(total[ends[i:j + 1] - ends[i]], pa.int32()), pa.array(ids.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][i:j], pa.int64()), lists], schema=_IDS)
        i = j


def _decoded(b: pa.RecordBatch, by_id: dict[int, bytes]) -> pa.RecordBatch:
    """The batch with the bytes that its ids stand for."""
    of = by_id.__getitem__
    out = [b"".join(map(of, x)) for x in b.column("ids").to_pylist()]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), pa.array(out, pa.binary())], schema=_BOTH)


def _answered(docs: DataFrame, vocabulary: str | None, pattern: str, block_chars: int) -> tuple[GroupedData, GroupedData, str]:
    """Answered packets and texts, both by block, and the folder of the position lists. There
    are twice as many buckets as shuffle partitions, so they grow with what the session is
    set up for."""
    spark = docs.sparkSession
    n_buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = scratch(spark, "positions")
    store, base = filesystem(folder)
    store.create_dir(base, recursive=True)
    blocks = written(_blocks(docs, pattern, block_chars, n_buckets, folder), "blocks")
    packets = (blocks.where("bucket IS NOT NULL").select(F.col("block").alias("of"), "bucket", "packet")
               .repartition("bucket").sortWithinPartitions("bucket"))
    texts = blocks.where("bucket IS NULL").select("block", "doc_ids", "counts", "file", "places")
    found = _encoded(packets, ranks(vocabulary), pattern)
    ship(spark)
    return found.groupBy("of"), texts.groupBy("block"), folder


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids), one row per row of ``docs``."""
    found, texts, folder = _answered(docs, vocabulary, pattern, block_chars)

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(_reassembled(folder, left, right), _IDS)
    return found.cogroup(texts).applyInArrow(reassemble, "doc_id long, ids array<int>")


def _by_id(vocabulary: str | None) -> dict[int, bytes]:
    return {v: k for k, v in ranks(vocabulary).items()}


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes): the ids and the bytes that they stand for."""
    sent = encoded.sparkSession.sparkContext.broadcast(_by_id(vocabulary))

    def run(batches):
        for b in chunks(batches):
            yield _decoded(b, sent.value)
    return over_batches(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN,
               block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids, bytes): ``decode`` of ``encode``, where the ids are put together, so a task
    needs one Python worker, not two."""
    found, texts, folder = _answered(docs, vocabulary, pattern, block_chars)
    sent = docs.sparkSession.sparkContext.broadcast(_by_id(vocabulary))

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches((_decoded(b, sent.value) for b in _reassembled(folder, left, right)), _BOTH)
    return found.cogroup(texts).applyInArrow(both, "doc_id long, ids array<int>, bytes binary")


def digests(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the round trip."""
    return round_trip(docs, **options).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"))
