"""SimHash near-duplicates with pivot distance tables.

A fingerprint is 64 bits; two documents are linked when their fingerprints differ
in at most ``max_bits`` bits. Equal fingerprints collapse first, so a group of
exact copies is one row from there on. Each distinct fingerprint carries a pivot
table: its Hamming distances to ``PIVOTS`` reference fingerprints, one byte each.
By the triangle inequality a pair whose tables differ by more than ``max_bits`` in
any coordinate cannot be linked, so it is discarded; survivors are verified bit by
bit. Pairs meet at all only if they agree on enough whole blocks of bits: with n
blocks, fingerprints that differ in d bits agree on n - d blocks at least, so a
join on every choice of n - d blocks loses no link. A pair that meets under several
choices is kept under the first only. The number of blocks follows the logarithm
of the number of fingerprints, so chance meetings stay in proportion to the input.

Components come from alternating large-star and small-star rounds over the links;
links never leave the cluster.

Defined cases: null text is empty; no words give fingerprint zero, linked like any
other; rows that repeat a document are copies of it; a null doc_id takes part in
the links, but is never a component_id unless the whole component has none. Empty
tables give empty results. Extra columns are ignored."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from basketry.llm.common import chunks, id_text, lowered_words, over_batches, written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
PIVOTS = 16
BITS = 64

#: The reference fingerprints: any fixed spread of 64-bit values does.
_REFERENCES = [xxhash.xxh64_intdigest(b"reference %d" % i, SEED) for i in range(PIVOTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """A bit is set when it is set in over half of the shingles' XXH64 values."""
    ws = lowered_words(text)
    if not ws:
        return 0
    joined = b" ".join(ws)
    n = max(1, len(ws) - shingle + 1)
    ends = list(itertools.accumulate(len(w) + 1 for w in ws))
    digest = xxhash.xxh64_intdigest
    last = min(shingle, len(ws)) - 1
    counts, start = np.zeros(BITS, np.int64), 0
    for at in range(0, n, 65536):                 # bounds the bit matrix of a long text
        hs = []
        for end in ends[at + last:min(at + 65536, n) + last]:
            hs.append(digest(joined[start:end - 1], SEED))
            start = ends[at + len(hs) - 1]
        h = np.array(hs, dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1,
                                bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp holds the 64 bits as a long."""
    def run(batches):
        for b in chunks(batches):
            fps = [_signed(fingerprint(t, shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())],
                                             ["doc_id", "fp"])
    return over_batches(id_text(docs), run, "doc_id long, fp long")


def _pivot_tables(fps: DataFrame) -> DataFrame:
    """Adds the distances to the references, eight of them packed into each long."""
    packed = []
    for half in range(0, PIVOTS, 8):
        c = F.lit(0).cast("long")
        for j in range(half, half + 8):
            d = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(_REFERENCES[j])))).cast("long")
            c = c.bitwiseOR(F.shiftleft(d, 8 * (j - half)))
        packed.append(c.alias(f"pivot{half // 8}"))
    return fps.select("fp", *packed)


def _max_coordinate_difference(a: str, b: str):
    diffs = []
    for half in range(PIVOTS // 8):
        x, y = F.col(f"{a}.pivot{half}"), F.col(f"{b}.pivot{half}")
        for j in range(8):
            byte = lambda c, s=8 * j: F.shiftright(c, s).bitwiseAND(F.lit(255))
            diffs.append(F.abs(byte(x) - byte(y)))
    return F.greatest(*diffs)


def _blocks(n_fps: int, max_bits: int) -> list[int]:
    """Masks of the blocks. Their number grows until the bits of n - max_bits blocks
    exceed log2(n_fps) by 8, so a key is shared by chance by few fingerprints."""
    n = max_bits + 3
    while n < BITS and (n - max_bits) * (BITS // n) < math.log2(max(2, n_fps)) + 8:
        n += 1
    edges = [round(BITS * i / n) for i in range(n + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]


def links(distinct_fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) with a < b: every pair of distinct fingerprints within ``max_bits`` bits."""
    masks = _blocks(distinct_fps.count(), max_bits)
    choices = list(itertools.combinations(range(len(masks)), len(masks) - max_bits))
    keys = F.array(*[
        F.struct(F.lit(sum(1 << i for i in c)).cast("long").alias("choice"),
                 F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] for i in c)))).alias("key"))
        for c in choices])
    rows = _pivot_tables(distinct_fps).select("fp", "pivot0", "pivot1", F.inline(keys))
    a, b = rows.alias("a"), rows.alias("b")
    xor = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    equal = F.lit(0).cast("long")
    for i, m in enumerate(masks):
        equal = equal + F.when(xor.bitwiseAND(F.lit(_signed(m))) == 0, 1 << i).otherwise(0)
    # the lowest n - max_bits equal blocks: the first choice under which the pair meets
    first, rest = F.lit(0).cast("long"), equal
    for _ in range(len(masks) - max_bits):
        low = rest.bitwiseAND(-rest)
        first, rest = first.bitwiseOR(low), rest.bitwiseAND(rest - 1)
    # sorted and merged whatever the planner thinks: it sizes the keys as one row a fingerprint,
    # so up to some size of input it would send the whole table through the driver
    return a.hint("merge").join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key"))
                  & (F.col("a.fp") < F.col("b.fp"))
                  & (_max_coordinate_difference("a", "b") <= max_bits)
                  & (F.bit_count(xor) <= max_bits)
                  & (first == F.col("a.choice"))
                  ).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component. Alternates large-star
    and small-star; each round is two aggregations over the edges, written to the
    shared folder. Nodes without an edge are absent."""
    edges = written(edges.select("a", "b").distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour goes to the smallest
        large = (both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .where("a <> b").distinct())
        # small star: every smaller neighbour and the node itself go to the smallest
        down = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(low2, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
                 .union(low2.select(F.col("m").alias("a"), F.col("u").alias("b")))
                 .where("a <> b").distinct())
        edges = written(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))


def _classes(fps: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root, component_id): the component of each fingerprint, named by one of its
    fingerprints and by its least doc_id."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected(links(distinct.select("fp"), max_bits))
    rooted = (distinct.join(roots, distinct.fp == roots.node, "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``."""
    fps = written(fingerprints(docs, shingle), "fingerprints")
    return fps.join(_classes(fps, max_bits), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one document of each component: of the smallest id and, where that id
    stands for several texts of the component, of the smallest fingerprint. Rows that agree
    in both are one. An id whose rows belong to several components keeps one row in each.
    Rows without an id stay, as nothing names them."""
    with_id = docs.where(F.col("doc_id").isNotNull())
    fps = written(fingerprints(with_id, shingle), "fingerprints")
    rows = written(fps.groupBy("doc_id", "fp").agg(F.count("*").alias("n")).join(_classes(fps, max_bits), "fp"), "rows")
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("k")).select("k.*")
    ids = rows.groupBy("doc_id").agg(F.sum("n").alias("n"))
    repeated = written(ids.where("n > 1").select("doc_id"), "repeated-ids")
    # a row of an id that stands once is decided by its id alone
    gone = written(rows.join(kept, ["doc_id", "fp"], "left_anti").select("doc_id").union(repeated).distinct(), "gone")
    key = F.col("doc_id").cast("long")
    out = (with_id.withColumn("_simhash_id", key).join(gone.withColumnRenamed("doc_id", "_simhash_id"), "_simhash_id", "left_anti").select(*docs.columns)
           .unionByName(docs.where(F.col("doc_id").isNull())))
    if not repeated.take(1):
        return out
    some = with_id.withColumn("_simhash_id", key).join(repeated.withColumnRenamed("doc_id", "_simhash_id"), "_simhash_id", "left_semi").select(*docs.columns)

    def run(batches):
        for b in chunks(batches):
            fp = [_signed(fingerprint(t or "", shingle)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp, pa.int64())], [*b.schema.names, "_simhash_fp"])
    marked = over_batches(some, run, StructType([*docs.schema.fields, StructField("_simhash_fp", LongType())]))
    mine = marked.withColumn("_simhash_id", key).join(kept.select(F.col("doc_id").alias("_simhash_id"), F.col("fp").alias("_simhash_fp")), ["_simhash_id", "_simhash_fp"], "left_semi")
    return out.unionByName(mine.dropDuplicates(["_simhash_id", "_simhash_fp"]).select(*docs.columns))
