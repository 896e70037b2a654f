"""Byte-level BPE against the tiktoken library, and the round trip."""

from __future__ import annotations

import hashlib
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from basketry.llm import bpe
from tests.llm.frames import AWKWARD, documents, prose

ROWS = [*AWKWARD, (30, prose(3)), (31, "  two  spaces \n\n\n and\ttabs  "), (32, "don't we'll I'VE 123abc ½ ١٢٣ 漢字かな 🙂🙂 é"),
        (33, "a\x1cb\x1d\x85c d e 　 f"), (34, "<|endoftext|> is text"), (35, "line\r\nends\r\n")]


def want():
    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})
    return sorted(((i, e.encode_ordinary(t or "")) for i, t in ROWS), key=str)


def test_ids_equal_tiktoken(spark):
    for block in (bpe.BLOCK_CHARS, 1000):
        got = sorted(((r.doc_id, list(r.ids)) for r in bpe.encode(documents(spark, ROWS), block_chars=block).collect()), key=str)
        assert got == want()


def test_round_trip_and_digests(spark):
    docs = documents(spark, ROWS)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted(((r.doc_id, bytes(r.bytes).decode()) for r in back), key=str) == sorted(((i, t or "") for i, t in ROWS), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = sorted((i, len(x), sha(",".join(map(str, x)).encode())) for i, x in want() if i is not None)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.digests(docs).collect() if r.doc_id is not None) == texts


def test_ids_are_put_together_a_few_texts_at_a_time(tmp_path):
    """One block of 400 texts and 2 M positions: the arrays per position exist for a piece only."""
    rng = np.random.default_rng(1)
    words = [[int(x) for x in rng.integers(0, 50000, 1 + k % 3)] for k in range(1000)]
    at = rng.integers(0, 1000, 2_000_000).astype(np.int32)
    counts = [0, 5000 * 2, *[5000] * 398, 0]
    first, rest = bpe._planes(np.arange(1000, dtype=np.int32)), bpe._planes(at)
    (tmp_path / "p").write_bytes(first + rest)
    found = pa.table({"bucket": pa.array([0], pa.int32()), "ids": [
        bpe._packed([len(w) for w in words], np.array(sum(words, []), "<i4").tobytes())]})
    block = pa.table({"doc_ids": [list(range(len(counts)))], "counts": [counts], "file": ["p"],
                      "places": [[0, len(first), len(first) + len(rest)]]})
    tracemalloc.start()
    got = [(b.column("doc_id").to_pylist(), b.column("ids").value_lengths().to_pylist(), b.column("ids").flatten().to_numpy())
           for b in bpe._reassembled(f"file://{tmp_path}", found, block)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) > 10 and sum((i for i, _, _ in got), []) == list(range(len(counts)))
    size = np.array([len(w) for w in words])
    ends = np.cumsum([0, *counts])
    assert sum((n for _, n, _ in got), []) == [int(size[at[a:b]].sum()) for a, b in zip(ends, ends[1:])]
    assert np.concatenate([x for _, _, x in got]).tolist() == [t for k in at for t in words[k]]
    assert most < 30 * len(at)          # 15 bytes a position; with whole arrays 52


def test_one_python_worker_puts_together_and_decodes(spark):
    plan = bpe.digests(documents(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan[:plan.index("FlatMapCoGroupsInArrow")]


def test_empty(spark):
    assert bpe.digests(documents(spark, [])).collect() == []
