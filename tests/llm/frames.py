"""Small frames for the tests: awkward rows, and columns whose names clash."""

from __future__ import annotations

import random

CLASHES = ("fingerprint", "row", "kind", "n_lines", "hi", "bucket", "host", "term", "block", "h", "score")


def documents(spark, rows, clashes=True):
    """rows: (doc_id, text); further columns as in documents, and clashing ones."""
    extra = ", ".join(f"{c} string" for c in CLASHES) if clashes else ""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + extra if clashes else "")
    return spark.createDataFrame(
        [(i, t, "en", None, None if t is None else len(t), *(["x"] * len(CLASHES) if clashes else [])) for i, t in rows],
        schema)


def prose(seed: int, n: int = 400, vocabulary: int = 3000) -> str:
    r = random.Random(seed)
    w = [f"w{r.randrange(vocabulary)}" for _ in range(n)]
    return " ".join(w[:n // 2]) + "\n" + " ".join(w[n // 2:])


AWKWARD = [(1, None), (2, ""), (3, " \t\x0b\n\n "), (4, "one"), (5, "one two three"), (None, "no id here at all"),
           (6, "Ünïcödé ſ K 𝔘 words"), (7, "same same same"), (7, "same same same"), (8, "x" * 50_000),
           (9, "long " * 30_000)]
