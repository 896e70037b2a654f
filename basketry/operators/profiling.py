"""Data profiling (Q1-Q4) and display sorts.

All in one pass per table where possible; exact quartiles come from counts in value
ranges that narrow around the wanted positions, duplicates from row fingerprints: neither
sorts or shuffles a table's rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from basketry.operators import encode
from basketry.session import cut_lineage

QUANTILES = (0.25, 0.5, 0.75)
BINS = 4096


def shape(name: str, df: DataFrame) -> DataFrame:
    """Q1: (table_name, n_rows, n_cols, columns, dtypes)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
        F.lit(",".join(df.columns)).alias("columns"),
        F.lit(",".join(t for _, t in df.dtypes)).alias("dtypes"))


def shapes(tables) -> DataFrame:
    out = None
    for name, df in tables:
        s = shape(name, df)
        out = s if out is None else out.unionByName(s)
    return out


def _fingerprint(cols) -> list[Column]:
    """128 bits of the given columns; a null has its own place, so that it cannot trade
    places with a value."""
    parts = [x for c in cols for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return [F.xxhash64(F.lit(seed), *parts) for seed in ("one", "two")]


def duplicates(name: str, df: DataFrame, cols=None) -> DataFrame:
    """Q2: rows beyond the first of each key (full row when ``cols`` is None); nulls compare
    equal, as in pandas. Keys of one or two numbers are counted as they are. Of wider ones
    fingerprints of 16 bytes a row are counted, map-side first; only
    rows whose fingerprint occurs twice or more are compared whole, so the answer does not
    rest on the fingerprints; there ``df`` is read twice: pass a written table."""
    key = list(cols) if cols else df.columns
    rows = df.select(*[F.col(f"`{c}`") for c in key])
    if len(key) > 2 or not all(isinstance(df.schema[c].dataType, IntegralType) for c in key):
        one, two = _fingerprint(key)
        rows = rows.withColumns({"_f1": one, "_f2": two})
        often = rows.groupBy("_f1", "_f2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
        rows = rows.join(often, ["_f1", "_f2"], "left_semi")
    g = rows.groupBy(*[F.col(f"`{c}`") for c in key]).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")).select(
        F.lit(name).alias("check_name"), F.col("duplicates").cast("long"))


def nested_duplicates(name: str, df: DataFrame, coarse_name: str, coarse: dict[str, Column]) -> DataFrame:
    """Q2 twice over one pass: repeated rows of ``df``, and repeated rows of the columns
    ``coarse`` made from it. Equal rows are counted first and the counts added up for equal
    coarse rows, both by whole values. Nothing is shuffled if the rows are dealt by columns
    that ``coarse`` keeps."""
    rows = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    kept = rows.select(*[c.alias(k) for k, c in coarse.items()], "_n")
    per = kept.groupBy(*[F.col(f"`{k}`") for k in coarse]).agg(F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_fine"))
    total = per.agg(F.coalesce(F.sum(F.col("_rows") - F.col("_fine")), F.lit(0)).alias("fine"),
                    F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("coarse"))
    both = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(c).cast("long").alias("duplicates"))
                     for n, c in ((name, "fine"), (coarse_name, "coarse"))])
    return total.select(F.inline(both))


def null_counts(df: DataFrame) -> DataFrame:
    """Q3: one pass of null counts, unpivoted to (column_name, nulls)."""
    agg = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in df.columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    return agg.selectExpr(f"stack({len(df.columns)}, {pairs}) AS (column_name, nulls)")


def _bin(lo: float, hi: float, v: Column) -> Column:
    """Number of v's range among ``BINS`` equal ones of [lo, hi], never falling as v grows.
    Infinite values and NaN (the largest) have ranges of their own."""
    inf = float("inf")
    # both ends are halved first: the difference of two large doubles may be infinite
    width = hi / 2 - lo / 2
    inside = F.floor((v / 2 - F.lit(lo / 2)) / F.lit(width or 1.0) * BINS) + 1
    return (F.when(F.isnan(v), BINS + 3).when(v == inf, BINS + 2).when(v == -inf, 0)
            .otherwise(F.greatest(F.lit(1), F.least(inside, F.lit(BINS + 1)))).cast("long"))


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], report: list | None = None) -> dict[tuple[str, int], float]:
    """Exact value at each wanted position (0 is the least non-null value) of each column.

    Each pass counts the values of all open ranges in ``BINS`` bins and takes each bin's
    least and greatest value, map-side; a position then lies in one bin, whose own least
    and greatest value are the next range, until both are equal. The driver sees
    at most ``BINS`` + 4 rows a range; a pass narrows a range by a factor of ``BINS``.
    ``report`` gets the number of ranges of each pass."""
    inf = float("inf")
    finite = lambda x: x is not None and math.isfinite(x)
    first = df.agg(*[f(F.when(F.abs(F.col(f"`{c}`").cast("double")) < inf, F.col(f"`{c}`").cast("double"))).alias(f"{k}{i}")
                     for i, c in enumerate(wanted) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    found: dict[tuple[str, int], float] = {}
    # (column, least value, greatest value, None for all) -> (values before it, positions)
    open_ = {(c, first[f"lo{i}"] or 0.0, first[f"hi{i}"] or 0.0, True): (0, sorted(set(p)))
             for i, (c, p) in enumerate(wanted.items()) if p}
    while open_:
        ranges = list(open_)
        if report is not None:
            report.append(len(ranges))
        hits = []
        for i, (c, lo, hi, whole) in enumerate(ranges):
            v = F.col(f"`{c}`").cast("double")
            there = v.isNotNull() if whole else (v >= lo) & (v <= hi)
            hits.append(F.when(there, F.struct(F.lit(i).alias("i"), _bin(lo, hi, v).alias("b"), v.alias("v"))))
        rows = (df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("x"))
                .groupBy("x.i", "x.b").agg(F.count(F.lit(1)).alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi"))
                .orderBy("i", "b").collect())
        narrower: dict = {}
        before = {i: open_[r][0] for i, r in enumerate(ranges)}
        for r in rows:
            c = ranges[r.i][0]
            at = before[r.i]
            inside = [p for p in open_[ranges[r.i]][1] if at <= p < at + r.n]
            before[r.i] = at + r.n
            if inside and (r.lo == r.hi or not finite(r.lo)):
                found |= {(c, p): r.lo for p in inside}
            elif inside:
                narrower[c, r.lo, r.hi, False] = (at, inside)
        open_ = narrower
    return found


def describe(df: DataFrame, cols) -> DataFrame:
    """Q4: (column_name, count, mean, std, min, p25, p50, p75, max) per column;
    std is the sample deviation, quartiles are interpolated linearly between exact values."""
    data = cut_lineage(df.select(*cols))   # read once by every pass
    stats = data.agg(*[e for c in cols for e in (
        F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"),
        F.stddev_samp(c).alias(f"{c}__std"), F.min(c).cast("double").alias(f"{c}__min"),
        F.max(c).cast("double").alias(f"{c}__max"))]).collect()[0]
    places = {c: [q * (stats[f"{c}__count"] - 1) for q in QUANTILES] if stats[f"{c}__count"] else [] for c in cols}
    value = order_statistics(data, {c: [f(p) for p in ps for f in (math.floor, math.ceil)] for c, ps in places.items()})
    rows = []
    for c in cols:
        qs = [value[c, math.floor(p)] + (value[c, math.ceil(p)] - value[c, math.floor(p)]) * (p - math.floor(p))
              if p != math.floor(p) else value[c, math.floor(p)] for p in places[c]] or [None] * len(QUANTILES)
        rows.append((c, stats[f"{c}__count"], stats[f"{c}__mean"], stats[f"{c}__std"], stats[f"{c}__min"], *qs, stats[f"{c}__max"]))
    rows = [(r[0], r[1], *(None if x is None else float(x) for x in r[2:])) for r in rows]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double")


def category_counts_sorted(master: DataFrame) -> DataFrame:
    """(user, category) purchase counts with their display position
    (count desc, user, category), numbered by a distributed sort."""
    c = master.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("count"))
    return encode.global_index(c, [F.col("count").desc(), F.col("user_id"), F.col("category")],
                               "position")


def active_days_sorted(user_profile: DataFrame) -> DataFrame:
    """Users by active days, longest first (ties by user)."""
    return encode.global_index(user_profile.select("user_id", "active_days"),
                               [F.col("active_days").desc(), F.col("user_id")], "position")
