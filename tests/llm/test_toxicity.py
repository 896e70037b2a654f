"""Segments against all sub-ranges; the model on planted rows."""

from __future__ import annotations

import random
import zlib

from basketry.llm import toxicity
from tests.llm.frames import AWKWARD, documents, prose

BAD = ("vile", "rotten", "wretch", "filthy")


def ruzzo_tompa_by_definition(scores):
    """Maximal-scoring segments: take the best (longest of equal, then first) sub-range with
    positive score whose ends cannot be extended, split, and recurse on both sides."""
    def go(lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 0 and (best is None or total > best[0] + 1e-12):
                    best = (total, a, b)
        if best is None:
            return []
        return go(lo, best[1]) + [best] + go(best[2] + 1, hi)
    return go(0, len(scores))


def test_segments_equal_definition():
    r = random.Random(2)
    for _ in range(300):
        scores = [r.choice([-0.5, -0.5, -0.5, 1.37, 2.11, 3.93]) for _ in range(r.randrange(1, 18))]
        found = [(i, i, i + 1, s) for i, s in enumerate(scores) if s > 0]
        got = [(round(s, 6), found[a][0], found[b][0]) for s, a, b in toxicity.segments(found)]
        assert got == [(round(s, 6), a, b) for s, a, b in ruzzo_tompa_by_definition(scores)]


def rows_and_labels():
    r, rows, labels = random.Random(4), list(AWKWARD), []
    for i in range(1000, 1600):
        words = prose(i, 120).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def labelled(spark, labels):
    return spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string")


def test_held_out_rows_are_found(spark):
    rows, labels = rows_and_labels()
    docs, lab = documents(spark, rows), labelled(spark, labels)
    got = toxicity.score(docs, toxicity.fit(docs, lab)).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.predicted == truth.get(r.doc_id, 0)
        assert (r.n_passages > 0) == (r.predicted == 1)


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rows, labels = rows_and_labels()
    docs = documents(spark, rows)
    flipped = [(i, q, 1 - t if toxicity.held_out(i) else t) for i, q, t in labels]
    assert toxicity.fit(docs, labelled(spark, labels)) == toxicity.fit(docs, labelled(spark, flipped))


def test_passages_are_where_the_words_are(spark):
    model = toxicity.Model({w: 6.0 for w in BAD}, 1.0, 0.01, 1.0, 4.0)
    text = "clean words first " * 20 + "vile rotten wretch" + " and clean words after" * 20
    (a, b, _), = toxicity.passages(text, model)
    assert text[a:b] == "vile rotten wretch"


def test_drop_keeps_clean_rows_and_columns(spark):
    rows, labels = rows_and_labels()
    docs = documents(spark, rows)
    kept = toxicity.drop_toxic(docs, labelled(spark, labels))
    assert kept.columns == docs.columns
    assert kept.count() == len(rows) - sum(t for _, _, t in labels)


def test_without_labels_or_rows(spark):
    docs = documents(spark, AWKWARD)
    none = labelled(spark, [])
    got = toxicity.score(docs, toxicity.fit(docs, none)).collect()
    assert len(got) == len(AWKWARD) and all(r.score == 0 and r.predicted == 0 for r in got)
    empty = documents(spark, [])
    assert toxicity.score(empty, toxicity.fit(empty, none)).collect() == []
    clean_only = labelled(spark, [(1, 1, 0), (4, 1, None), (None, 1, 1)])
    assert all(r.predicted == 0 for r in toxicity.score(docs, toxicity.fit(docs, clean_only)).collect())
