"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio.

Everything is DataFrame functions. The features of a text are its words, its word pairs
and the last three characters of each word, hashed to ``BUCKETS`` buckets. Two
multinomials over the buckets are estimated with add-one smoothing: the raw corpus from
all documents, and the trusted target from all labelled documents of quality 1. The
weight of a bucket is log p(target) - log p(raw), in whole millionths, so sums do not
depend on their order. A document's ratio is the mean weight of its features; it is kept
when no base rule fails and the ratio is at least ``THRESHOLD``, the same for every
document.

Counts are combined on the map side (at most ``BUCKETS`` rows per task); the weights,
``BUCKETS`` rows at most, are broadcast. Trusted ids are broadcast when they are at most
``BROADCAST_IDS``; then texts are not shuffled, only one row of numbers per document.
Beyond, documents and ids meet in a shuffle join. A hot source or group of copies is spread like any other rows.

Defined cases: null text has no words; fewer than ``MIN_WORDS`` words fail, so do empty
texts; without trusted rows all weights are equal and the base rules decide; repeated rows
each give a row; null ids are carried. Empty tables give empty results. Extra columns are
ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import SPACE, id_text, written

BUCKETS = 1 << 16
BROADCAST_IDS = 1_000_000
THRESHOLD = -0.5
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_SPACES = r"[\x20\x09-\x0D]+"


def _words(text):
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def _repeat_words(n, w):
    """Words that stand in a window of three words found twice or more. Only texts with
    such a window are sorted; the sorted windows mark their equal neighbours, and the
    marked positions, in order, cover min(3, distance to the next) words each."""
    # words hold no space, so joined windows are equal when the words are
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    at = F.sequence(F.lit(0), n - 3)
    some = F.size(F.array_distinct(F.transform(at, window))) < n - 2
    pairs = F.array_sort(F.transform(at, lambda i: F.struct(window(i).alias("g"), i.alias("i"))))
    # let p = pairs in ..., by a transform over a one-element array
    marked = F.element_at(F.transform(F.array(pairs), lambda p: F.array_sort(F.transform(
        F.filter(p, lambda x, k: ((k > 0) & (F.get(p, k - 1).getField("g") == x.getField("g")))
                 | F.coalesce(F.get(p, k + 1).getField("g") == x.getField("g"), F.lit(False))),
        lambda x: x.getField("i")))), 1)
    covered = F.element_at(F.transform(F.array(marked), lambda m: F.aggregate(
        F.transform(m, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(m, k + 1) - x, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)), 1)
    return F.when((n >= 3) & some, covered).otherwise(F.lit(0).cast("long"))


def base(docs: DataFrame) -> DataFrame:
    """(row, doc_id, w, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (id_text(docs)
            .select("doc_id", _words(text).alias("w"), lines.alias("lines"),
                    F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
                    (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"))
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "w",
                    F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
                    (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                    _repeat_words(F.size("w"), F.col("w")).alias("n_repeat_words")))


def _features(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per feature of ``w``: (keep..., bucket). A row without words gives a null bucket."""
    pairs = rows.select(*keep, F.inline_outer(F.arrays_zip(
        F.col("w").alias("a"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("a", "b"))
    a, b = F.col("a"), F.col("b")
    bucket = lambda *c: F.pmod(F.xxhash64(*c), F.lit(BUCKETS)).cast("int")
    return pairs.select(*keep, F.explode(F.array(
        F.when(a.isNotNull(), bucket(F.lit(1), a)),
        F.when(a.isNotNull(), bucket(F.lit(2), F.substring(a, -3, 3))),
        F.when(b.isNotNull(), bucket(F.lit(3), a, b)))).alias("bucket"))


def weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(bucket, weight) of the buckets that occur, weight in millionths."""
    trusted = written(labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id"))
                      .where("doc_id IS NOT NULL").distinct(), "quality-trusted").withColumn("trusted", F.lit(True))
    side = F.broadcast(trusted) if trusted.count() <= BROADCAST_IDS else trusted
    rows = id_text(docs).join(side, "doc_id", "left").select(_words(F.col("text")).alias("w"), "trusted")
    counts = (_features(rows, "trusted").where("bucket IS NOT NULL").groupBy("bucket")
              .agg(F.count("*").alias("raw"), F.count("trusted").alias("target")))
    both = written(counts, "quality-counts")
    n_raw, n_target = (float(x or 0) for x in both.agg(F.sum("raw"), F.sum("target")).first())
    if not n_target:
        return both.select("bucket", F.lit(0).cast("long").alias("weight"))
    ratio = (F.log((F.col("target") + 1) / F.lit(n_target + BUCKETS))
             - F.log((F.col("raw") + 1) / F.lit(n_raw + BUCKETS)))
    return both.select("bucket", F.round(ratio * 1e6).cast("long").alias("weight"))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    ratio, kept), one row per row of ``docs``."""
    side = weights(docs, labels)
    numbers = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # at most BUCKETS rows of two numbers are broadcast
    marks = (_features(base(docs), "row", *numbers).join(F.broadcast(side), "bucket", "left")
             .groupBy("row").agg(*[F.max(c).alias(c) for c in numbers],
                                 F.sum("weight").alias("total"), F.count("bucket").alias("n")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    ratio = F.coalesce(F.col("total") / F.col("n") / 1e6, F.lit(0.0))
    return marks.select(*numbers, failed.alias("base_failed"), ratio.alias("ratio"),
                        (~failed & (ratio >= threshold)).alias("kept"))
