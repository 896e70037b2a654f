"""Centroid clustering with zone maps along a space-filling curve.

Vectors become integers (floor of 256 times each component), get their position on a
Hilbert curve through the box of all vectors (dimensions of greater spread first), and
are sorted by it in a range-partitioned sort. Runs of ``BLOCK`` neighbours on the curve
are a block: one row with their ids, their components and their zone map, the least and
greatest value of each dimension. The blocks are written once; each round reads them.

For a block, a centroid's distance to any vector lies between its distance to the
nearest and to the farthest point of the box. A centroid whose least distance exceeds
another's greatest can be nearest to no vector of the block; neither can one that is
farther than another one at every point of the box (the difference of two squared
distances is linear, so its maximum over the box is exact). The rest are the block's
candidates and are compared exactly, a matrix product a block. All arithmetic is in
integers (or in doubles below 2^53, where they are exact), so results do not depend on
the partitioning. A task returns the count and component sums of each cluster; the
driver sees at most ``K`` x 64 sums a round.

Defined cases: a vector is kept if it has exactly ``DIMS`` components, none null or not
finite. Every kept row gets a row, repeated ones too. A null vec_id is assigned like any
other, but starts no centroid. Rows of one id count as vectors of their own; among equal
hashes the smaller vector starts first. Fewer kept vectors than ``K`` give as many
centroids; none give an empty result. A component beyond +-2^27 (x beyond +-524288) has
distances that need not fit a long: an error says so, instead of a wrong number."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import over_batches, written

DIMS = 64
K = 40
ROUNDS = 5
SCALE = 256
SEED = 2
BLOCK = 32                  # vectors of a block
BITS = 4                    # of a dimension on the curve
LARGEST = 1 << 27           # of a component, so that a squared distance fits a long
EXACT = 1 << 22             # components below this: doubles are exact


def vectors(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the kept rows."""
    e = F.col("embedding").cast("array<double>")
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (embeddings.where((F.size("embedding") == dims) & good)
            .select(F.col("vec_id").cast("long").alias("vec_id"),
                    F.transform(e, lambda x: F.floor(x * scale)).alias("v")))


def _matrix(column, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _spread(vecs: DataFrame, dims: int) -> np.ndarray | None:
    """Least and greatest value of each dimension and an estimate of its variance."""
    def run(batches):
        lo = hi = total = squares = None
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            m = _matrix(b.column("v"), dims)
            n += len(m)
            f = m.astype(np.float64)
            one = (m.min(0), m.max(0), f.sum(0), (f * f).sum(0))
            if lo is None:
                lo, hi, total, squares = one
            else:
                lo, hi = np.minimum(lo, one[0]), np.maximum(hi, one[1])
                total, squares = total + one[2], squares + one[3]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array(lo), pa.array(hi), pa.array(np.full(dims, n)),
                 pa.array(total), pa.array(squares)], ["dim", "lo", "hi", "n", "total", "squares"])
    parts = over_batches(vecs.select("v"), run,
                         "dim int, lo long, hi long, n long, total double, squares double")
    rows = (parts.groupBy("dim").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"),
                                     (F.sum("squares") / F.sum("n") - F.pow(F.sum("total") / F.sum("n"), 2)).alias("var"))
            .orderBy("dim").collect())
    return np.array([(r.lo, r.hi, r["var"]) for r in rows], dtype=object) if rows else None


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Position on the Hilbert curve of each row of small integers (first column first),
    as a byte string that sorts like the position. Works on the bit planes: the turn of
    each sub-cube is undone from the top plane down, then the Gray code is resolved."""
    x = cells.astype(np.uint32).T.copy()            # one row a dimension
    dims = len(x)
    top = np.uint32(1 << (bits - 1))
    q = top
    while q > 1:
        low = np.uint32(q - 1)
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(turned, low, swap).astype(np.uint32)
            x[i] ^= swap
        q = np.uint32(q >> 1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint32)
    q = top
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, np.uint32(q - 1), 0).astype(np.uint32)
        q = np.uint32(q >> 1)
    x ^= flip
    planes = [((x >> np.uint32(b)) & 1).T for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes, axis=1).astype(np.uint8), axis=1)
    return [row.tobytes() for row in packed]


def blocks(vecs: DataFrame, spread: np.ndarray, dims: int = DIMS, block: int = BLOCK) -> DataFrame:
    """(ids, data, lo, hi): runs of neighbours on the curve with their zone map. Equal
    vectors are told apart by a row number, so a very common one is split as well."""
    lo = spread[:, 0].astype(np.int64)
    width = np.maximum(spread[:, 1].astype(np.int64) - lo, 1)
    order = np.argsort(-spread[:, 2].astype(np.float64), kind="stable")

    def key(batches):
        for b in batches:
            m = _matrix(b.column("v"), dims)
            cells = np.minimum((m - lo) * (1 << BITS) // (width + 1), (1 << BITS) - 1)[:, order]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hilbert_keys(cells, BITS), pa.binary()), b.column("row"), b.column("vec_id"), b.column("v")],
                ["key", "row", "vec_id", "v"])

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, block):
                one = b.slice(at, block)
                m = _matrix(one.column("v"), dims)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([one.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                     *(pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in (m, m.min(0), m.max(0)))],
                    ["ids", "data", "lo", "hi"])
    keyed = over_batches(vecs.withColumn("row", F.monotonically_increasing_id()).select("row", "vec_id", "v"),
                         key, "key binary, row long, vec_id long, v array<long>")
    along = keyed.repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("vec_id", "v")
    return written(over_batches(along, pack, "ids array<long>, data binary, lo binary, hi binary"), "blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a point of the box, ascending."""
    near = np.maximum(np.maximum(lo - centroids, centroids - hi), 0)
    far = np.maximum(np.abs(centroids - lo), np.abs(centroids - hi))
    least, most = (near * near).sum(1), (far * far).sum(1)
    best = int(most.argmin())
    # greatest lead of another centroid over the best one, at any point of the box
    gap = 2 * (centroids - centroids[best])
    lead = ((centroids[best] ** 2).sum() - (centroids ** 2).sum(1) + np.maximum(lo * gap, hi * gap).sum(1))
    return np.flatnonzero((least <= most[best]) & (lead >= 0))


def nearest(m: np.ndarray, lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and squared distance of each row; pairs compared."""
    some = candidates(lo, hi, centroids)
    c = centroids[some]
    kind = np.float64 if max(np.abs(lo).max(), np.abs(hi).max(), np.abs(c).max()) <= EXACT else np.int64
    x, y = m.astype(kind), c.astype(kind)
    d = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)
    at = d.argmin(1)
    return some[at], d[np.arange(len(m)), at].astype(np.int64), len(m) * len(some)


def _each(batches, centroids):
    dims = centroids.shape[1]
    for b in batches:
        for ids, *raw in zip(*(b.column(c) for c in ("ids", "data", "lo", "hi"))):
            m, lo, hi = (np.frombuffer(x.as_py(), "<i4").astype(np.int64) for x in raw)
            m = m.reshape(-1, dims)
            yield ids, m, *nearest(m, lo, hi, centroids)


def _sums(blocks_: DataFrame, centroids: np.ndarray) -> tuple[dict, int]:
    """Count and component sums of each cluster as Python integers; pairs compared."""
    k, dims = centroids.shape

    def run(batches):
        n, sums, pairs = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        for _, m, at, _, compared in _each(batches, centroids):
            pairs += compared
            n += np.bincount(at, minlength=k)
            for c in np.unique(at):
                sums[c] += m[at == c].sum(0)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array(n[some]), pa.array([pairs] + [0] * (len(some) - 1), pa.int64()),
                 pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "pairs", "sums"])
    parts = over_batches(blocks_, run, "cluster int, n long, pairs long, sums array<long>")
    rows = (parts.select("cluster", "n", "pairs", F.posexplode("sums").alias("dim", "s"))
            .groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("pairs").alias("pairs"))
            .collect())
    out: dict[int, tuple[int, list[int]]] = {}
    for r in rows:
        out.setdefault(r.cluster, (r.n, [0] * dims))[1][r.dim] = r.s
    return out, sum(r.pairs for r in rows if r.dim == 0)


def start(vecs: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of smallest hash of their id, in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vecs.where("vec_id is not null").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], dtype=np.int64)


def cluster(embeddings: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS,
            report: list | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), a row per kept
    row. ``report`` gets the pairs compared in each round."""
    spark = embeddings.sparkSession
    vecs = written(vectors(embeddings, dims), "vectors")
    spread, centroids = _spread(vecs, dims), start(vecs, k)
    schema = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
              "centroid_sha256 string")
    if not len(centroids):
        return spark.createDataFrame([], schema)
    if max(-int(spread[:, 0].min()), int(spread[:, 1].max())) > LARGEST:
        raise ValueError("a component times 256 is beyond 2^27: squared distances may not fit a long")
    packed = blocks(vecs, spread, dims)
    for _ in range(rounds):
        sums, pairs = _sums(packed, centroids)
        if report is not None:
            report.append(pairs)
        for c, (n, s) in sums.items():
            centroids[c] = [x // n for x in s]

    def assign(batches):
        for ids, _, at, d, _ in _each(batches, centroids):
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(at, pa.int32()), pa.array(d, pa.int64())],
                                             ["vec_id", "cluster", "distance"])
    assigned = written(over_batches(packed, assign, "vec_id long, cluster int, distance long"), "assigned")
    of = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, s, sum(of.values()), hashes[c]) for c, s in of.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return (assigned.join(F.broadcast(facts), "cluster")          # at most k rows
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
