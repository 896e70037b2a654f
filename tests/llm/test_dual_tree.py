"""Ranked search against scoring every pair, and bounds that prune."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

from basketry.llm import dual_tree as t
from tests.llm.frames import AWKWARD, documents, prose

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in _TERM.findall(text or "")]


def plain(docs, items, k=20):
    bags = [(i, Counter(plain_terms(x))) for i, x in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    big_n, total = len(bags), sum(n for *_, n in bags)
    df = Counter(w for _, b, _ in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * big_n) // total
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[w] + 1))) * ((1000000000 * b[w]) // (1000 * b[w] + 12 * m))
                    for w in plain_terms(text) if w in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def benchmark(spark, items):
    return spark.createDataFrame([(i, x, "y", 3) for i, x in items], "item_id long, text string, doc_id string, rank int")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_terms():
    text = "Ab-cD_e9 ÄÉ x \x7f\x00z ſK 𝔘"
    assert [w.decode() for w in t.terms(text)] == plain_terms(text)


def test_equals_scoring_every_pair(spark):
    r = random.Random(4)
    docs = list(AWKWARD) + [(100 + i, prose(i, r.randrange(3, 200), 300)) for i in range(120)]
    docs += [(500 + i % 3, "w1 w2 w3") for i in range(40)]               # ties and repeated rows
    docs += [(None, "w1 w2 w3"), (None, "w9")]
    items = [(1, None), (2, ""), (3, "--- !"), (4, "w1"), (5, "W1 w1 w2, w3-w4"), (6, "nowhere found"), (None, "w9 w10"),
             (5, "w1 w1 w2 w3 w4"), (7, prose(3, 60, 300)), (8, "long same x")]
    items += [(20 + i, prose(i, 30, 300)) for i in range(30)]
    want = plain(docs, items)
    assert got(t.search(documents(spark, docs), benchmark(spark, items))) == want
    few = t.search(documents(spark, docs), benchmark(spark, items), group_items=7, group_bytes=300)   # many passes
    assert got(few) == want


def test_empty_tables(spark):
    assert got(t.search(documents(spark, []), benchmark(spark, [(1, "a")]))) == []
    assert got(t.search(documents(spark, [(1, "a")]), benchmark(spark, []))) == []
    assert got(t.search(documents(spark, [(1, None)]), benchmark(spark, [(1, None), (2, "a")]))) == []


def test_bounds_prune_whole_batches():
    """Documents on different subjects: most pairs are never scored, and none is lost."""
    r = random.Random(8)
    docs = [[f"s{i % 40}w{r.randrange(30)}" for _ in range(40)] for i in range(4000)]
    items = [(i, Counter(f"s{i}w{j}" for j in range(12))) for i in range(40)]
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w.encode() for _, b in items for w in b))}
    bags = [Counter({w.encode(): n for w, n in b.items()}) for _, b in items]
    vec = [Counter(w.encode() for w in d) for d in docs]
    df = Counter(w for b in vec for w in b)
    import numpy as np
    w = np.array([t.weight(len(docs), df[x]) for x in vocabulary], np.int64)
    s = t.Search(t.Items([i for i, _ in items], bags, vocabulary, w), len(docs), 40 * len(docs), 5)
    known = [{vocabulary[x]: n for x, n in b.items() if x in vocabulary} for b in vec]
    s.add(list(range(len(docs))), [40] * len(docs), [np.array(list(b), "<i4").tobytes() for b in known],
          [np.array(list(b.values()), "<i4").tobytes() for b in known])
    _, item, doc, score = s.results()
    want = plain([(i, " ".join(d)) for i, d in enumerate(docs)], [(i, " ".join(b)) for i, b in items], 5)
    assert sorted(((a, c, d) for a, c, d in zip(item, doc, score)), key=str) == sorted(((a, c, d) for a, _, c, d in want), key=str)
    assert s.scored < s.possible / 4


def test_integers_where_doubles_would_round():
    bags = [Counter({b"a": 10**9, b"b": 1})]
    import numpy as np
    assert t.Items([1], bags, {b"a": 0, b"b": 1}, np.array([23000, 1])).kind is np.int64
