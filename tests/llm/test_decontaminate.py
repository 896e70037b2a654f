"""Containment search against exact containment of every pair."""

from __future__ import annotations

import random

import pytest

from basketry.llm import decontaminate
from tests.llm.frames import AWKWARD, documents, prose


def items(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def plain(rows, bench):
    out = []
    for i, t in rows:
        for k, x in set(bench):
            s = decontaminate.shingle_set(x or "")
            have = decontaminate.shingle_set(t or "", min(5, max(1, len((x or "").split()))))
            if s and len(s & have) >= 0.8 * len(s):
                out.append((i, k, len(s), len(s & have)))
    return sorted(out, key=str)


def cases():
    r = random.Random(5)
    bench = [(i, prose(900 + i, r.choice([5, 6, 9, 17, 30, 60, 150]))) for i in range(40)]
    bench += [(100, "Two words"), (101, "one two three"), (104, "singleton"), (105, "four words in here"), (102, ""), (103, None), (103, "repeated item of six words"),
              (103, "repeated item of six words"), (None, prose(990, 30))]
    rows = list(AWKWARD)
    for d in range(60):
        k, x = bench[r.randrange(len(bench))]
        w = (x or "").split()
        if d % 3 == 1 and len(w) > 20:                      # a word changed
            w[r.randrange(len(w))] = "changed"
        if d % 3 == 2:                                      # half of it: no match
            w = w[:len(w) // 2]
        body = prose(d, 2000 if d % 5 == 0 else 300).split()
        at = r.randrange(len(body))
        rows.append((1000 + d, " ".join(body[:at] + [y.upper() for y in w] + body[at:])))
    return rows, bench


def test_equals_exact_containment(spark):
    rows, bench = cases()
    got = [tuple(r)[:4] for r in decontaminate.contaminated(documents(spark, rows), items(spark, bench)).collect()]
    assert sorted(got, key=str) == plain(rows, bench)
    assert len(got) > 30


def test_short_items_inside_long_documents(spark):
    bench = [(1, "two words"), (2, "Singleton"), (3, "a b c d"), (4, "words two")]
    rows = [(1, prose(1, 3000) + " Two\tWORDS " + prose(2, 50)), (2, prose(3) + " a b c\nd"), (3, "a b c"), (4, "singleton"),
            (5, prose(4) + " two other words"), (6, "words")]
    got = sorted(tuple(r) for r in decontaminate.contaminated(documents(spark, rows), items(spark, bench)).collect())
    assert got == [(1, 1, 1, 1, 1.0), (2, 3, 1, 1, 1.0), (4, 2, 1, 1, 1.0)]
    kept = decontaminate.drop_contaminated(documents(spark, rows), items(spark, bench))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5, 6]
    assert decontaminate.drop_contaminated(documents(spark, []), items(spark, bench)).count() == 0


def test_index_is_small_beside_its_items():
    import tracemalloc
    bench = [(i, prose(i, 60)) for i in range(3000)]
    size = sum(len(t) for _, t in bench)
    tracemalloc.start()
    index = decontaminate.Index(bench)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(index.ids) == 3000 and held < 9 * size, held / size


def test_blocks_of_items_and_pieces_of_texts_change_nothing(spark, monkeypatch):
    rows, bench = cases()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 4000)
    got = [tuple(r)[:4] for r in decontaminate.contaminated(documents(spark, rows), items(spark, bench)).collect()]
    assert sorted(got, key=str) == plain(rows, bench)
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 6000)
    index = decontaminate.Index([(i, t or "") for i, t in bench])
    text = " ".join(prose(s, 3000) for s in range(8)) + " " + bench[3][1] + " " + prose(77, 3000)
    assert any(index.ids[k] == 3 for _, k, _ in decontaminate.matches([text], index))


def test_drop_keeps_clean_documents_and_columns(spark):
    rows, bench = cases()
    docs = documents(spark, rows)
    kept = decontaminate.drop_contaminated(docs, items(spark, bench))
    bad = {i for i, *_ in plain(rows, bench)}
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in rows if i not in bad), key=str)


@pytest.mark.parametrize("rows,bench", [([], [(1, "a b c d e f")]), ([(1, "a b c d e f")], []), ([], [])])
def test_empty(spark, rows, bench):
    assert decontaminate.contaminated(documents(spark, rows), items(spark, bench)).collect() == []
    assert decontaminate.drop_contaminated(documents(spark, rows), items(spark, bench)).count() == len(rows)
