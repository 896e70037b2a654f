"""SimHash against all pairs on small frames."""

from __future__ import annotations

import random

import xxhash

from basketry.llm import simhash
from tests.llm.frames import AWKWARD, documents, prose


def plain_fingerprint(text):
    ws = (text or "").encode().lower().split()
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(ws[i:i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def plain(rows, bits=4):
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None]
        out.append((doc, f"{fps[i]:016x}", min(ids, default=None)))
    return out


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def near_copies(seed, n):
    r, words = random.Random(seed), prose(seed).split()
    out = []
    for _ in range(n):
        w = list(words)
        w[r.randrange(len(w))] = f"edit{r.random()}"
        out.append(" ".join(w))
    return out


def test_components_equal_all_pairs(spark):
    rows = list(AWKWARD) + [(100 + i, prose(i % 5)) for i in range(12)]
    rows += [(200 + i, t) for i, t in enumerate(near_copies(7, 25) + near_copies(8, 10))]
    assert got(simhash.near_duplicates(documents(spark, rows))) == sorted(plain(rows), key=str)


def test_links_equal_all_pairs_at_every_number_of_blocks(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), r.randrange(1, 7))))
    want = {(a, b) for a in fps for b in fps if simhash._signed(a) < simhash._signed(b) and (a ^ b).bit_count() <= 4}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    pairs = [(x.a & (2**64 - 1), x.b & (2**64 - 1)) for x in simhash.links(df).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    assert len(simhash._blocks(10**10, 4)) > len(simhash._blocks(1000, 4))
    assert all(sum(m) == 2**64 - 1 for m in (simhash._blocks(10**k, 4) for k in range(1, 12)))


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    roots = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert roots == {i: 0 for i in range(1, 61)}


def test_drop_keeps_smallest_of_each_group_and_all_columns(spark):
    rows = list(AWKWARD) + [(50, prose(1)), (51, prose(1)), (52, prose(2))]
    docs = documents(spark, rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {d: c for d, _, c in plain([r for r in rows if r[0] is not None])}
    assert sorted(i for i in ids if i is not None) == sorted({d for d, c in classes.items() if d == c})


def test_distinct_texts_of_one_id_stay(spark):
    near = near_copies(7, 1)[0]
    rows = [(1, prose(1)), (1, prose(2)), (1, prose(2)), (2, prose(1)), (2, prose(3)), (3, prose(7)), (3, near), (4, near), (None, prose(1))]
    kept = sorted((r.doc_id or 0, r.text) for r in simhash.drop_near_duplicates(documents(spark, rows)).collect())
    assert [k for k in kept if k[0] != 3] == sorted([(0, prose(1)), (1, prose(1)), (1, prose(2)), (2, prose(3))])
    assert len([k for k in kept if k[0] == 3]) == 1 and kept[-1][1] in (prose(7), near)


def test_rows_without_an_id_stay(spark):
    docs = documents(spark, list(AWKWARD))
    ids = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert ids.count(None) == 1


def test_empty(spark):
    assert got(simhash.near_duplicates(documents(spark, []))) == []
    assert simhash.drop_near_duplicates(documents(spark, [])).count() == 0


def test_keys_are_never_broadcast(spark, tmp_dir):
    """The planner sizes 35 keys a fingerprint as one row: under its own limit the table of keys
    would be sent to the driver, however many rows it has."""
    r = random.Random(11)
    spark.createDataFrame([(simhash._signed(r.getrandbits(64)),) for _ in range(300)], "fp long").write.parquet(f"{tmp_dir}/fps")
    plan = simhash.links(spark.read.parquet(f"{tmp_dir}/fps"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
