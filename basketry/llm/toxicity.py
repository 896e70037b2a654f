"""Toxicity by maximum-scoring segments.

1. *Token log-odds with Dirichlet priors.* Labelled rows outside the held-out fold
   give, per token, the number of distinct contexts (the token with its two
   neighbours) in toxic and in clean text; copies of a text have the same contexts,
   so they count once. A token's weight is the difference of its log-odds in the two
   classes under a Dirichlet prior of ``PRIOR`` pseudo-contexts shared out by its
   overall rate. Tokens and token prefixes of ``PREFIX`` characters (marked ``^``)
   are scored alike; a token that is not significant falls back to its prefix.
   Significant ones (z over ``Z``, positive) form the lexicon, at most ``MAX_TERMS``
   (the capacity of the model, so the size that is sent to the tasks is bounded).
2. *Segments.* A text is a sequence of scores: the lexicon's weights, and ``DRIFT``
   for every other token. One linear scan finds all maximal-scoring segments
   (Ruzzo and Tompa): the toxic passages.
3. *Extreme-value calibration.* In clean text the best of n positions exceeds x with
   probability 1 - exp(-K n exp(-lambda x)) (Karlin and Altschul). lambda solves
   sum p exp(lambda s) = 1 over the clean token rates, K is the maximum-likelihood
   value given lambda over clean training texts. A passage is significant if its
   probability is under ``ALPHA``; a text's evidence adds up -log of that probability
   over its significant passages. A logistic curve through the training rows turns
   evidence into a score; 0.5 is where it errs least.

The fit reads at most ``TRAIN_DOCS`` labelled rows (those of least hash of the id);
everything else covers all rows. Labels, lang, source and doc_id are no input of a
score: the id only assigns the fold.

Defined cases: null text is empty; an empty text has no passage and the score of no
evidence; no labels, or labels of one class only, give an empty lexicon and score 0
for all; a null id is outside the held-out fold; repeated rows are scored alike; a
document with several labels is toxic if one says so. Extra columns are ignored."""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import chunks, id_text, over_batches

TRAIN_DOCS = 20_000
FOLDS = 5
PRIOR = 0.02          # of all contexts
PREFIX = 5
Z = 4.0
MIN_CONTEXTS = 3
MAX_TERMS = 50_000
DRIFT = -0.5
ALPHA = 0.01
TOKEN = re.compile(r"\w+")


def held_out(doc_id: int | None) -> bool:
    """crc32 of the id as text, modulo 5, is 0."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


@dataclass
class Model:
    terms: dict[str, float]       # tokens and ^prefixes
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    cut: float = math.inf         # evidence at which the score is 0.5


def hits(text: str, terms: dict[str, float]) -> tuple[int, list[tuple[int, int, int, float]]]:
    """Number of tokens, and (position, start, end, weight) of those in the lexicon."""
    out, n = [], 0
    for n, m in enumerate(TOKEN.finditer(text.lower()), 1):
        t = m.group()
        w = terms.get(t)
        if w is None:
            w = terms.get("^" + t[:PREFIX])
        if w is not None:
            out.append((n - 1, m.start(), m.end(), w))
    return n, out


def segments(found: list[tuple[int, int, int, float]], drift: float = DRIFT) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last) over indexes of ``found``; the
    tokens between two hits score ``drift`` each. Linear: each segment joins the list
    once and is merged away at most once."""
    out: list[tuple[float, float, int, int, int]] = []   # left sum, right sum, first, last, previous lower
    total, at = 0.0, -1
    for i, (pos, _, _, w) in enumerate(found):
        total += drift * (pos - at - 1)
        at = pos
        left, total = total, total + w
        if w <= 0:
            continue
        first, j = i, len(out) - 1
        while True:
            while j >= 0 and out[j][0] >= left:
                j = out[j][4]
            if j < 0 or out[j][1] >= total:
                break
            left, first = out[j][0], out[j][2]
            del out[j:]
            j = len(out) - 1
        out.append((left, total, first, i, j))
    return [(r - le, a, b) for le, r, a, b, _ in out]


def evidence(n: int, segs: list[tuple[float, int, int]], lam: float, k: float) -> tuple[float, list]:
    """Sum of -log p over significant segments, and these segments."""
    total, kept = 0.0, []
    for s, a, b in segs:
        expect = k * max(1, n) * math.exp(-lam * s)
        p = -math.expm1(-expect)
        if p < ALPHA:
            total += -math.log(max(p, 1e-300))
            kept.append((s, a, b))
    return total, kept


def _training(docs: DataFrame, labels: DataFrame, train_docs: int) -> DataFrame:
    """(doc_id, text, toxic) of the bounded sample of labelled rows."""
    crc = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    lab = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
           .where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc % FOLDS != 0)
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs))
    # at most train_docs rows of two numbers: a bounded side
    return id_text(docs).join(F.broadcast(lab), "doc_id")


def _contexts(batches):
    for b in chunks(batches):
        out: dict[str, list] = {"term": [], "context": [], "toxic": []}
        for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            ts = TOKEN.findall(t.lower())
            seen = set()
            for p, w, q in zip(["", *ts], ts, [*ts[1:], ""]):
                c = zlib.crc32(f"{p} {q}".encode("utf-8", "surrogatepass"))
                if (w, c) not in seen:
                    seen.add((w, c))
                    out["term"].append(w)
                    out["context"].append(c)
                    out["toxic"].append(y)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [("term", pa.string()), ("context", pa.int64()), ("toxic", pa.int32())]))


def _lexicon(train: DataFrame, max_terms: int) -> tuple[dict[str, float], float]:
    """Weights of the significant terms, and the scale of the clean rates: the rows of
    (weight, clean rate) stay small as they are the lexicon itself."""
    once = (over_batches(train, _contexts, "term string, context long, toxic int")
            .groupBy("term", "context", "toxic").agg(F.lit(1).alias("one")))
    per = once.groupBy("term").agg(F.sum(F.col("toxic")).alias("y1"), F.sum(1 - F.col("toxic")).alias("y0"))
    prefixes = (per.where(F.length("term") > PREFIX)
                .groupBy(F.concat(F.lit("^"), F.substring("term", 1, PREFIX)).alias("term"))
                .agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
    per = per.unionByName(prefixes).persist()
    try:
        n1, n0 = per.where(~F.col("term").startswith("^")).agg(F.sum("y1"), F.sum("y0")).first()
        if not n1 or not n0:
            return {}, 1.0
        n1, n0 = float(n1), float(n0)
        prior = PRIOR * (n1 + n0)
        share = F.lit(prior) * (F.col("y1") + F.col("y0")) / F.lit(n1 + n0)
        a, b = F.col("y1") + share, F.col("y0") + share
        scored = per.where(F.col("y1") >= MIN_CONTEXTS).select(
            "term", a.alias("a"), b.alias("b"),
            (F.log(a / (F.lit(n1 + prior) - a)) - F.log(b / (F.lit(n0 + prior) - b))).alias("w"),
            F.sqrt(1 / a + 1 / b).alias("sd"))
        rows = (scored.where((F.col("w") / F.col("sd") > Z) & (F.col("w") > -4 * DRIFT))
                .orderBy((F.col("w") / F.col("sd")).desc(), "term").limit(max_terms).collect())
    finally:
        per.unpersist()
    # lambda: sum over tokens of clean rate * exp(lambda * score) = 1
    rates = [(r.w, r.b / (n0 + prior)) for r in rows if not r.term.startswith("^")]
    rest = max(1e-9, 1.0 - sum(p for _, p in rates))
    grows = lambda lam: rest * math.exp(lam * DRIFT) + sum(p * math.exp(min(700, lam * s)) for s, p in rates) > 1
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if grows(mid) else (mid, hi)
    return {r.term: float(r.w) for r in rows}, lo if rates else 1.0


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS,
        max_terms: int = MAX_TERMS) -> Model:
    """Learns from labelled rows outside the held-out fold."""
    train = _training(docs, labels, train_docs)
    terms, lam = _lexicon(train, max_terms)
    if not terms:
        return Model({})
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(terms)

    def best(batches):
        for b in chunks(batches):
            rows = []
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                n, found = hits(t, sent.value)
                segs = segments(found)
                rows.append((y, n, max((s for s, _, _ in segs), default=0.0), [s for s, _, _ in segs]))
            ys, ns, tops, alls = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ys, pa.int32()), pa.array(ns, pa.int64()), pa.array(tops, pa.float64()),
                 pa.array(alls, pa.list_(pa.float64()))], ["toxic", "n", "top", "scores"])

    rows = over_batches(train, best, "toxic int, n long, top double, scores array<double>").persist()
    try:
        k = rows.where("toxic = 0").agg(
            F.count("*") / F.sum(F.greatest("n", F.lit(1)) * F.exp(-F.lit(lam) * F.col("top")))).first()[0]
        k = min(1.0, max(1e-6, k or 1.0))
        # evidence in steps of 1/4, so the collected table has a bounded number of rows
        p = lambda s: -F.expm1(-F.lit(k) * F.greatest("n", F.lit(1)) * F.exp(-F.lit(lam) * s))
        ev = F.aggregate(F.filter("scores", lambda s: p(s) < ALPHA), F.lit(0.0),
                         lambda acc, s: acc - F.log(F.greatest(p(s), F.lit(1e-300))))
        steps = (rows.groupBy(F.least(F.floor(ev * 4), F.lit(4000)).alias("step"))
                 .agg(F.sum("toxic").alias("y1"), F.sum(1 - F.col("toxic")).alias("y0")).collect())
    finally:
        rows.unpersist()
    steps = sorted((float(r.step), r.y1, r.y0) for r in steps)
    # the cut between two steps with the fewest errors; of equal ones the middle
    errors = []
    for i in range(1, len(steps)):
        wrong = sum(y1 for _, y1, _ in steps[:i]) + sum(y0 for _, _, y0 in steps[i:])
        errors.append((wrong, (steps[i - 1][0] + 1 + steps[i][0]) / 8))
    if not errors:
        return Model(terms, lam, k, 1.0, 1.0)
    least = min(e for e, _ in errors)
    cuts = [c for e, c in errors if e == least]
    return Model(terms, lam, k, 1.0, cuts[len(cuts) // 2])


def score_of(ev: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(min(700.0, -model.slope * (ev - model.cut)))) if model.terms else 0.0


def _scored(text: str, model: Model) -> tuple[float, int, list]:
    n, found = hits(text, model.terms)
    ev, kept = evidence(n, segments(found), model.lam, model.k)
    return score_of(ev, model), n, [(found[a][1], found[b][2], s) for s, a, b in kept]


def passages(text: str, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, score) of the significant passages, in code points of the lowered text."""
    return _scored(text, model)[2]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages), one row per row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in chunks(batches):
            ids = b.column("doc_id").to_pylist()
            got = [_scored(t, m) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([held_out(i) for i in ids], pa.bool_()),
                 pa.array([s for s, _, _ in got], pa.float64()),
                 pa.array([int(s >= 0.5) for s, _, _ in got], pa.int32()),
                 pa.array([len(x) for _, _, x in got], pa.int64())],
                ["doc_id", "held_out", "score", "predicted", "n_passages"])
    return over_batches(
        id_text(docs), run, "doc_id long, held_out boolean, score double, predicted int, n_passages long")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that the model predicts to be toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))

    def run(batches):
        for b in chunks(batches):
            keep = [_scored(t or "", sent.value)[0] < 0.5 for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))
    return over_batches(docs, run, docs.schema)
