"""Jaccard join against all pairs; families, lists and prefixes against their definitions."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import set_join as j
from tests.llm.frames import AWKWARD, documents, prose


def plain_set(text):
    ws = (text or "").encode().lower().split()
    return frozenset(tuple(ws[i:i + 4]) for i in range(max(1, len(ws) - 3))) if ws else frozenset()


def linked(a, b, percent=85):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def plain(rows, percent=85):
    sets = [plain_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if group[x] != group[y] and linked(sets[x], sets[y], percent):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    out = []
    for x, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[x] and rows[k][0] is not None]
        out.append((doc, len(sets[x]), min(ids, default=None)))
    return sorted(out, key=str)


def edited(words, r, edits):
    w = list(words)
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.random()}"
    return " ".join(w)


def family(seed, n, most, length=150):
    """Copies of one text with up to ``most`` edits, some of them of a copy."""
    r = random.Random(seed)
    base = prose(seed, length).split()
    other = edited(base, r, most).split()
    return [" ".join(base)] + [edited(r.choice([base, base, other]), r, r.randrange(1, most + 1)) for _ in range(n)]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("percent", [85, 60])
def test_equals_all_pairs(spark, percent):
    r = random.Random(1)
    texts = family(1, 60, 9) + family(2, 25, 5, 60) + family(3, 30, 3, 25)
    passage = " ".join(prose(77, 60).split())
    texts += [prose(200 + i, 40).replace("\n", " ") + " " + passage for i in range(20)]      # a shared passage
    texts += [passage + " " + prose(300 + i, 6) for i in range(20)]
    texts += [" ".join(prose(5, 9).split()[:n]) for n in range(1, 10)]                        # small sets
    texts += [prose(400 + i, r.randrange(5, 80)) for i in range(20)]
    rows = list(AWKWARD) + [(100 + i, t) for i, t in enumerate(texts)] + [(50 + i, texts[3]) for i in range(8)]
    rows += [(None, texts[4]), (None, prose(999)), (100, prose(998))]
    r.shuffle(rows)
    assert got(j.components(documents(spark, rows), percent=percent)) == plain(rows, percent)


def test_every_shingle_frequent(spark, monkeypatch):
    """Lists dealt by size class and salt, entries in several blocks."""
    monkeypatch.setattr(j, "AGREE", 9)                                   # no families: the index does all
    maps = j.bitmaps
    monkeypatch.setattr(j, "bitmaps", lambda stored: maps(stored, (1, 1)))
    rows = list(enumerate(family(5, 90, 6) + family(6, 20, 4, 40)))
    assert got(j.components(documents(spark, rows))) == plain(rows)


def test_families_alone_find_their_links(spark):
    texts = family(8, 80, 10)
    docs = documents(spark, list(enumerate(texts)))
    rows = j.written(j.document_sets(docs), "t")
    classes = j.written(rows.select(rows.doc_id.alias("id"), "doc_id", "size", "k1", "k2", "stored", "mins"), "t")
    family_, links = j.families(docs, classes)
    inside = j._inside_families(family_, j.PERCENT)
    sets = [plain_set(t) for t in texts]
    edges = {(r.a, r.b) for r in links.union(inside).collect()}
    assert edges and all(linked(sets[a], sets[b]) for a, b in edges)
    members = {r.id: r for r in family_.collect()}
    assert any(not m.follows for m in members.values())
    for i, m in members.items():
        assert len(m.plus) == len(sets[i] - sets[m.leader]) and len(m.minus) == len(sets[m.leader] - sets[i])
    # whatever is linked inside a family is connected by these edges
    group = {i: i for i in range(len(texts))}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x
    for a, b in edges:
        group[find(a)] = find(b)
    for x in members:
        for y in members:
            if members[x].leader == members[y].leader and linked(sets[x], sets[y]):
                assert find(x) == find(y)


def test_prefixes_of_linked_sets_meet():
    r = random.Random(2)
    maps = np.zeros((2, 1 << 10), np.uint64)
    maps[0, ::2] = maps[1, ::3] = ~np.uint64(0)                          # a half count as shared, a third as frequent
    for _ in range(300):
        n = r.randrange(6, 120)
        a = np.unique(np.array([r.getrandbits(64) for _ in range(n)], np.uint64))
        b = np.unique(np.array([x for x in a.tolist() if r.random() > 0.05] + [r.getrandbits(64) for _ in range(3)], np.uint64))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 85 * (len(a) + len(b) - common):
            assert common >= j.needed(len(a), len(b))
            pa, pb = (j.prefix(j._stored(x, 85), len(x), maps)[0] for x in (a, b))
            assert len(pa) == j.prefix_length(len(a)) and len(np.intersect1d(pa, pb))
        else:
            assert common < j.needed(len(a), len(b))


def test_blocks_skip_and_lose_nothing():
    r = np.random.RandomState(3)
    n = 400
    size = np.sort(r.randint(10, 400, n))
    left = np.maximum(1, size - r.randint(0, 60, n))
    leader, members = np.arange(n), np.ones(n, np.int64)
    lists = j.Lists(85)
    lists.probe((leader, members, size, size, left), leader, members, leader, size, left)
    out = lists.out()
    want = {(y, x) for y in range(n) for x in range(y + 1, n)
            if 100 * size[x] >= 85 * size[y] and 100 * size[y] >= 85 * size[x]
            and min(left[x], left[y]) >= j.needed(size[x], size[y])}
    assert set(zip(out.column("y").to_pylist(), out.column("x").to_pylist())) == want
    assert lists.skipped > lists.compared


def test_short_lists_equal_all_pairs_in_each():
    r = np.random.RandomState(4)
    n = 600
    of = np.sort(r.randint(0, 90, n))
    size = r.randint(10, 120, n)
    by = np.lexsort((size, of))
    size, left = size[by], np.maximum(1, size[by] - r.randint(0, 12, n))
    leader, members, ids = r.randint(0, 200, n), r.randint(1, 3, n), np.arange(n)
    batches = []
    for at in range(0, n, 37):                                           # lists go over batches
        cut = slice(at, at + 37)
        batches.append(pa.RecordBatch.from_arrays([pa.array(c[cut].astype(np.int64)) for c in (of, leader, members, ids, size, left)],
                                                  ["h", *j._FIELDS]))
    got = {(y, x) for b in j._walk_short(iter(batches), 85) for y, x in zip(b.column("y").to_pylist(), b.column("x").to_pylist())}
    want = set()
    for a in range(n):
        for b in range(n):
            if (of[a] == of[b] and (members[a], leader[a]) < (members[b], leader[b]) and leader[a] != leader[b]
                    and 100 * min(size[a], size[b]) >= 85 * max(size[a], size[b]) and min(left[a], left[b]) >= j.needed(size[a], size[b])):
                want.add((a, leader[b]))
    assert got == want and len(want) > 50


def test_empty(spark):
    assert got(j.components(documents(spark, []))) == []
    assert got(j.components(documents(spark, [(1, None), (2, "  "), (None, "")]))) == [(1, 0, 1), (2, 0, 2), (None, 0, None)]
