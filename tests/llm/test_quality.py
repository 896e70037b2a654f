"""Quality rules against plain counting."""

from __future__ import annotations

import collections
import math
import re

from basketry.llm import quality
from tests.llm.frames import AWKWARD, documents, prose

ROWS = [*AWKWARD, *[(50 + i, prose(i, 80)) for i in range(20)], (80, "a b c a b c a b c d " * 10), (81, "x y z w x y z"),
        (82, "same line\nsame line\n \nsame line \n\t\nother #*$%&|<>"), (83, "a b a b a"), (84, " ".join(["junk!!"] * 70)),
        *[(90 + i, " ".join(f"q{i}x{k}$$$" for k in range(80))) for i in range(8)]]


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(g)
    covered = {k for i, x in enumerate(g) if c[x] > 1 for k in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(covered))


def labels(spark):
    rows = [(50 + i, 1, 0) for i in range(20)] + [(90 + i, 0, 0) for i in range(8)] + [(None, 1, 0), (51, 1, 0), (52, None, None)]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, quality int, toxic int, bucket string")


def test_base_rules_equal_plain_counting(spark):
    got = quality.judge(documents(spark, ROWS), labels(spark)).collect()
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got}
    for i, t in ROWS:
        r = by_id[i]
        want = plain(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, (i, want)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert all(by_id[50 + i].kept for i in range(20)) and not any(by_id[90 + i].kept for i in range(8))


def test_ratio_is_the_mean_weight_of_the_features(spark):
    docs = documents(spark, ROWS)
    weight = {r.bucket: r.weight for r in quality.weights(docs, labels(spark)).collect()}
    t = dict(ROWS)[55]
    w = t.split()
    one = spark.createDataFrame([(w,)], "w array<string>")
    buckets = [r.bucket for r in quality._features(one).where("bucket is not null").collect()]
    assert len(buckets) == 3 * len(w) - 1
    got = {r.doc_id: r.ratio for r in quality.judge(docs, labels(spark)).collect()}
    assert math.isclose(got[55], sum(weight[b] for b in buckets) / len(buckets) / 1e6, rel_tol=1e-12)


def test_all_trusted_documents_are_counted(spark, monkeypatch):
    ids = range(30_000)
    docs = documents(spark, [(i, f"common own{i % 3000}") for i in ids], clashes=False)
    trusted = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    want = sorted(map(tuple, quality.weights(docs, trusted).collect()))
    assert want and all(w == 0 for _, w in want)            # the target is the whole corpus
    monkeypatch.setattr(quality, "BROADCAST_IDS", -1)
    assert sorted(map(tuple, quality.weights(docs, trusted).collect())) == want


def test_without_labels_the_base_rules_decide(spark):
    none = labels(spark).where("false")
    got = quality.judge(documents(spark, ROWS), none).collect()
    assert all(r.kept == (not r.base_failed) for r in got)


def test_no_python_in_the_plan(spark):
    plan = quality.judge(documents(spark, ROWS), labels(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty(spark):
    assert quality.judge(documents(spark, []), labels(spark)).collect() == []
