"""Personal data against plain patterns and plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import re

from basketry.llm import pii
from tests.llm.frames import AWKWARD, documents

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    out = []
    for k, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                    "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]:
                out.append((m.start(), list(PLAIN).index(k), m.end()))
    return sorted(out)


def some_texts():
    r = random.Random(6)
    bits = ["a.b+c@mail.example.com", "x@y", "x@y.z-q_w@e.f", "@", "a@b.c@d.e.f", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1",
            "007.8.9.010", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111", "5500000000000004", "3-4 5", "+1 (555) 010-9999",
            "+49.30.1234567", "+1", "++12 345 678 90", "+123456789012345678", "wörter", "🙂", "0000000000000000", "\n", "12", "(", "-", " "]
    return ["".join(r.choice(bits) + r.choice(["", " ", " und "]) for _ in range(r.randrange(1, 25))) for _ in range(120)] + [
        "9" * 40_000, "a" * 40_000 + "@", "+" + "1 " * 20_000, "1." * 20_000, "1-" * 20_000 + "1"]


def test_base_equals_plain_patterns(spark):
    rows = [*AWKWARD, *enumerate(some_texts(), 500)]
    got = pii.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, t in rows:
        base, r = plain_base(t), by_id[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4)), t[:80]
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), t[:80]
        assert set(listed.split(",")) - {""} <= set(r.spans.split(","))


def corpus():
    """A name stands beside one address only; a common word beside it and everywhere else."""
    rows = [(i, f"report by Quillon about sales quillon@firm.example number {i}") for i in range(1, 7)]
    rows += [(100 + i, f"report about sales of unit{i} and other matters") for i in range(60)]
    return rows + [(200 + i, f"contact sales other{i}@shop.example") for i in range(20)]


def test_disclosing_terms_follow_the_counts(spark):
    got = {r.doc_id: r for r in pii.scan(documents(spark, corpus())).collect()}
    texts = dict(corpus())
    for i in range(1, 7):
        spans = [s.split(":") for s in got[i].spans.split(",")]
        words = {(k, texts[i][int(a):int(b)]) for k, a, b in spans}
        assert words == {("email", "quillon@firm.example"), ("remove", "Quillon"), ("remove", "number")}
    assert all(got[100 + i].spans == "" for i in range(60))
    assert all(r.n_terms == 0 for i, r in got.items() if i >= 200)


def test_entities_of_one_document_are_judged(spark):
    rows = [*corpus(), (300, "report about sales by Zweistein zweistein@firm.example")]
    got = {r.doc_id: r for r in pii.scan(documents(spark, rows)).collect()}
    at = rows[-1][1].index("Zweistein")
    assert f"remove:{at}:{at + 9}" in got[300].spans.split(",") and got[300].n_terms == 1


def test_terms_of_the_whole_document_are_judged(spark):
    far = " report about sales of other matters" * 4
    names = ["Kim", "Li", "김민준", "李明", "K9x", "Zweistein"]
    rows = [*corpus(), *[(300 + i, f"{n}{far} z{i}@firm.example{far} {n}.") for i, n in enumerate(names)]]
    for broadcast in (pii.BROADCAST_TERMS, -1):
        pii.BROADCAST_TERMS, kept = broadcast, pii.BROADCAST_TERMS
        try:
            got = {r.doc_id: r for r in pii.scan(documents(spark, rows)).collect()}
        finally:
            pii.BROADCAST_TERMS = kept
        for i, n in enumerate(names):
            t = rows[-len(names) + i][1]
            last = t.rindex(n)
            spans = got[300 + i].spans.split(",")
            assert [spans[0], spans[-1]] == [f"remove:0:{len(n)}", f"remove:{last}:{last + len(n)}"], n
            assert got[300 + i].n_terms == 2


def plain_shares(rows):
    """The marked terms of each document by counting every pair of term and entity."""
    def terms(t):
        for m in re.finditer(r"[^\W_]+", t):
            w = m.group()
            if len(w) > 2 or w[0].isupper() or len(w) == 2 and w[0].isdigit() != w[1].isdigit():
                yield w.lower(), m.start(), m.end()
    ents = [{(k, t[a:b]) for a, k, b in plain_base(t)} for _, t in rows]
    words = [{w for w, _, _ in terms(t)} for _, t in rows]
    n, out = len(rows), {}
    for (i, t), es in zip(rows, ents):
        base, marked = plain_base(t), []
        share = {}
        for e in es:
            ne = sum(e in x for x in ents)
            for w in {w for w, _, _ in terms(t)} if ne < n else ():
                nt, nte = sum(w in x for x in words), sum(w in x and e in y for x, y in zip(words, ents))
                share[w] = max(share.get(w, -9), math.log(n * nte / (nt * ne)) / math.log(n / ne))
        for w, a, b in terms(t):
            if share.get(w, -9) >= pii.GENERALISE and not any(s < b and a < e for s, _, e in base):
                marked.append(("remove" if share[w] >= pii.REMOVE else "term", a, b))
        out[i] = marked
    return out


def test_terms_equal_counting_every_pair(spark):
    r = random.Random(3)
    some = [f"w{k}" for k in range(60)] + ["Al", "by", "x7", "Bob", "7", "mail"]
    ents = [f"p{k}@mail.example" for k in range(8)] + ["10.0.0.7", "+1 555 010 9999"]
    rows = [(i, " ".join(r.choice(ents) if r.random() < 0.04 else
                        r.choice(some) if r.random() < 0.8 else f"rare{r.randrange(200)}" for _ in range(40))) for i in range(60)]
    want = plain_shares(rows)
    assert sum(map(len, want.values())) > 20
    for x in pii.scan(documents(spark, rows)).collect():
        spans = [s.split(":") for s in x.spans.split(",") if s]
        assert [(k, int(a), int(b)) for k, a, b in spans if k in ("term", "remove")] == want[x.doc_id]


def test_joined_terms_equal_broadcast_terms(spark, monkeypatch):
    docs = documents(spark, corpus())
    want = sorted(map(tuple, pii.scan(docs).collect()))
    monkeypatch.setattr(pii, "BROADCAST_TERMS", -1)
    assert sorted(map(tuple, pii.scan(docs).collect())) == want


def test_sanitised_text(spark):
    got = {r.doc_id: r.text for r in pii.sanitise(documents(spark, corpus())).collect()}
    assert got[1] == "report by  about sales [EMAIL]  1"
    assert got[100] == dict(corpus())[100] and len(got) == len(corpus())


def test_no_python_in_the_plan(spark):
    plan = pii.scan(documents(spark, corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_empty(spark):
    assert pii.scan(documents(spark, [])).collect() == []


def test_sanitise_of_repeated_and_missing_ids_and_empty_tables(spark):
    rows = [(1, "write to kim kim@firm.example here"), (1, "other text"), (None, "mail a.b@c.example now"), (2, None), (2, "x@y.example")]
    got = sorted((r.doc_id or 0, r.text) for r in pii.sanitise(documents(spark, rows)).collect())
    assert len(got) == 5 and not any("@" in t for _, t in got) and (1, "other text") in got and (2, "") in got
    assert pii.sanitise(documents(spark, [])).count() == 0
