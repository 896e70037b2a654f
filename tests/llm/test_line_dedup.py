"""Line dedup against plain counting."""

from __future__ import annotations

import collections
import hashlib

import numpy as np

from basketry.llm import line_dedup
from tests.llm.frames import AWKWARD, documents

LONG = "This line is longer than forty characters, "


def plain(rows, least=40, docs=5):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = collections.defaultdict(list)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least and i is not None:
                holders[k].append(i)
    often = {k: max(h) for k, h in holders.items() if len(set(h)) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if key(x) not in often or (i is not None and often[key(x)] == i)]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    return out


ROWS = [*AWKWARD, *[(20 + i, f"head {i}\n  {LONG.upper()}A\t\n{LONG}b{i % 3}\n\n{LONG}a" + "\r") for i in range(16)],
        (None, LONG + "a"), (90, LONG + "ä"), *[(91 + i, "é" * 39 + "\n" + "é" * 40) for i in range(6)]]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_plain_counting(spark):
    assert got(line_dedup.line_dedup(documents(spark, ROWS))) == sorted(plain(ROWS), key=str)


def test_many_shards_and_groups_change_nothing(spark):
    docs = documents(spark, ROWS)
    assert got(line_dedup.line_dedup(docs, shard_keys=2, max_group_bytes=1)) == sorted(plain(ROWS), key=str)


def test_filter_keeps_columns_and_counts_chars(spark):
    docs = documents(spark, ROWS)
    out = line_dedup.drop_repeated_lines(docs)
    assert out.schema.names == docs.columns and out.count() == len(ROWS)
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_rows_of_one_id_are_one_document(spark):
    line = LONG + "once more"
    rows = [(1, line)] * 4 + [(2, line)]
    assert got(line_dedup.line_dedup(documents(spark, rows))) == sorted(plain(rows), key=str)
    assert sum(r[2] for r in got(line_dedup.line_dedup(documents(spark, rows)))) == 0
    rows += [(i, line) for i in (3, 4, 5)] + [(3, "x\n" + line), (None, line), (None, line)]
    assert got(line_dedup.line_dedup(documents(spark, rows))) == sorted(plain(rows), key=str)


def test_null_ids_do_not_count(spark):
    line = LONG + "without a name"
    rows = [(None, line)] * 9 + [(i, line) for i in range(4)]
    assert [r[2] for r in got(line_dedup.line_dedup(documents(spark, rows)))] == [0] * 13


def test_empty(spark):
    assert line_dedup.drop_repeated_lines(documents(spark, [])).count() == 0
    assert got(line_dedup.line_dedup(documents(spark, []))) == []


def test_perfect_hash_is_minimal_and_refutes_strangers():
    r = np.random.default_rng(1)
    hi, lo = (r.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    shard = line_dedup.Shard(hi, lo, np.arange(5000), np.arange(5000))
    assert sorted(shard.hash.index(hi, lo)) == list(range(5000))
    known, largest = shard.probe(hi, lo)
    assert known.all() and (largest == np.arange(5000)).all()
    assert not shard.probe(lo, hi)[0].any()
