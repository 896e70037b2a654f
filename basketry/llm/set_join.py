"""N-gram Jaccard join with set relations: block skips in the index, derived answers.

A document's set holds the distinct word shingles of its whole text as 64-bit hashes.
Equal sets collapse into one class; the join is over classes and returns components.

1. *Prefixes.* Two sets that link share at least one of the first s - ceil(t s) + 1
   shingles of either in any common order. The order is: shingles with a hash in the low
   range first, there those of one class before shared and shared before frequent ones,
   then the others, by hash in each part. How many classes hold a shingle is counted for
   every shingle of the low range; what is shared and what is frequent goes into two
   bitmaps of fixed size (a chance hit only moves a shingle back). Shingles that no two
   classes share make no pairs and need no list.
2. *Answers of similar sets.* Sets that agree on min-hash values get the most central of
   them (whose values most sets hold) as leader. Overlaps with the leader are computed
   exactly. A set that links with its leader follows it; a set that does not, but is half
   similar, is its relative. Leader, followers and relatives are
   a family. The rest is derived from the differences D to the leader: two members differ
   in |Dy ^ Dx| shingles, so links inside a family are found by prefixes of the differences
   alone (rare ones first), without a list that holds the family's common shingles; and a
   set y of another family shares |L & y| - |(L-F) & y| + |(F-L) & y| with a member F of L,
   looked at only if the triangle inequality of the Jaccard distance leaves it open.
3. *Block skips.* In the index a family is one entry in a shingle's list, with the range of
   its sizes and positions there; sets probe the entries of larger families. The entries
   are cut into blocks: a block is skipped for a set whose size admits none of the block's,
   or if the shingles left from the positions on are fewer than the overlap needed. A pair
   goes on if it passes the same two tests itself.
4. *Verification* first bounds the overlap of every pair left by its exact part in the low
   range, then counts it from the whole texts.

Hot groups: exact copies are one class before anything is paired; near copies are one
entry under their leader; a list of a frequent shingle is dealt by size class and salt.

Two shingles are one if their 64-bit hashes are equal (a chance of about 10^-13 for a
pair of sets of a thousand shingles).

Defined cases: null and empty texts and texts without a word have no shingle, link with
nothing and are their own component. Fewer words than ``SHINGLE`` make one shingle. Rows
that repeat a document are copies. A null doc_id takes part in the links; a component_id
is null only if the whole component has no id. Empty tables give empty results. Other
columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import chunks, id_text, lowered_words, over_batches, written
from basketry.llm.simhash import connected

SHINGLE = 4
PERCENT = 85
LOW = 0.22                  # share of the hash range that is counted and ordered first
FREQUENT = 64               # classes that hold a shingle, from which on it is frequent
BITMAP = 1 << 27            # bits of each bitmap; 16 MB
COUNTED = (1 << 40) - 1     # bits of a hash that are counted by
MINHASHES = 8
AGREE = 3                   # values that must agree for a leader to be tried
HALF = 0.5                  # least similarity of a relative
BLOCK = 64                  # entries of a block
SALTS = 8                   # parts of the list of a frequent shingle, of each size class
CHUNK = 64                  # followers whose differences travel as one row

_U = np.uint64
_LOW_END = _U(int(LOW * 2**64))
#: Odd multipliers, by position in the shingle and by min-hash function.
_MIX = [_U(xxhash.xxh64_intdigest(b"mix %d" % i) | 1) for i in range(64)]
_MIN = [_U(xxhash.xxh64_intdigest(b"min %d" % i) | 1) for i in range(MINHASHES)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h = h * _U(0x9E3779B97F4A7C15)          # 2^64 over the golden ratio
    return h ^ (h >> _U(29))


def shingles(text: str, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    ws = lowered_words(text)
    if not ws:
        return np.empty(0, _U)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh64_intdigest
    for w in set(ws):
        known[w] = digest(w)
    h = np.fromiter(map(known.__getitem__, ws), _U, len(ws))
    width = min(n, len(ws))
    out = np.full(len(ws) - width + 1, _U(width))
    with np.errstate(over="ignore"):
        for i in range(width):
            out = _mixed(out * _MIX[i % len(_MIX)] + h[i:i + len(out)])
    return np.unique(out)


def needed(x, y, percent: int = PERCENT):
    """Least overlap of sets of sizes x and y that link."""
    return -(-(percent * (x + y)) // (100 + percent))


def prefix_length(size, percent: int = PERCENT):
    return size - -(-(percent * size) // 100) + 1


def _stored(hashes: np.ndarray, percent: int) -> np.ndarray:
    """All of the low range and, if they are fewer than the prefix, the next ones."""
    low = int(np.searchsorted(hashes, _LOW_END))
    return hashes[:max(low, min(len(hashes), prefix_length(len(hashes), percent)))]


def _key(hashes: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(hashes.astype("<u8").tobytes())
    return (d >> 64) - (1 << 63), (d & (2**64 - 1)) - (1 << 63)


def document_sets(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, size, k1, k2, stored, mins): a row per document. Equal keys are equal sets."""
    def run(batches):
        for b in chunks(batches):
            size, k1, k2, stored, mins = [], [], [], [], []
            for text in b.column("text").to_pylist():
                h = shingles(text, n)
                size.append(len(h))
                one, two = _key(h) if len(h) else (0, 0)
                k1.append(one)
                k2.append(two)
                stored.append(_stored(h, percent).view(np.int64))
                with np.errstate(over="ignore"):
                    mins.append([int(_mixed(h * m).min().view(np.int64)) for m in _MIN] if len(h) else [])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(stored, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int64()))],
                ["doc_id", "size", "k1", "k2", "stored", "mins"])
    return over_batches(id_text(docs), run,
                        "doc_id long, size long, k1 long, k2 long, stored array<long>, mins array<long>")


def bitmaps(stored: DataFrame, least: tuple[int, int] = (2, FREQUENT), bits: int = BITMAP) -> np.ndarray:
    """Two bitmaps, in words of 64 bits: of the shingles that as many classes hold as ``least``
    says, or more. The driver sees the words that are not zero, ``bits`` / 64 at most."""
    counts = (stored.select(F.explode("stored").alias("h")).select(F.col("h").bitwiseAND(F.lit(COUNTED)).alias("h"))
              .groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min(least))
              .select("n", F.col("h").bitwiseAND(F.lit(bits - 1)).alias("at")))
    bit = "shiftleft(1L, cast(at & 63 as int))"
    words = (counts.groupBy(F.expr("shiftright(at, 6)").alias("word"))
             .agg(*(F.bit_or(F.expr(f"if(n >= {n}, {bit}, 0L)")).alias(f"b{i}") for i, n in enumerate(least))).toArrow())
    out = np.zeros((2, bits // 64), _U)
    for i in range(2):
        out[i, words["word"].to_numpy()] = words[f"b{i}"].to_numpy().view(_U)
    return out


def _marked(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = h & _U(len(bitmap) * 64 - 1)
    return (bitmap[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1


def prefix(stored: np.ndarray, size: int, maps: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first shingles of a set in the common order, which of them may be shared, and
    which are frequent. High ones are not counted; any may be shared."""
    shared, often, high = _marked(stored, maps[0]), _marked(stored, maps[1]), stored >= _LOW_END
    by = np.lexsort((stored, (shared.astype(np.int8) + often) * ~high, high))[:prefix_length(size, percent)]
    return stored[by], (shared | often | high)[by], often[by]


def _leader_proposals(classes: DataFrame) -> DataFrame:
    """(y, x): for each class (id, mins) the most central one that agrees with it on enough
    min-hashes and is the most central under one of them."""
    keys = classes.select("id", F.posexplode("mins").alias("k", "v"))
    held = keys.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    keys = written(keys.join(held, ["k", "v"]), "min-hashes")
    score = keys.groupBy("id").agg(F.sum("n").alias("score"))
    best = (keys.join(score, "id").groupBy("k", "v")
            .agg(F.max(F.struct("score", (-F.col("id")).alias("id"))).alias("top")))
    return (keys.join(best, ["k", "v"]).where(F.col("id") != -F.col("top.id"))
            .groupBy("id", "top").agg(F.count("*").alias("n")).where(F.col("n") >= AGREE)
            .groupBy("id").agg((-F.max("top")["id"]).alias("x")).select(F.col("id").alias("y"), "x"))


def _sets_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(id, hashes): whole sets of the wanted classes (id, doc_id, k1, k2), from the texts."""
    ids = wanted.select(F.col("doc_id").alias("wanted_id")).distinct()
    some = id_text(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")

    def run(batches):
        for b in chunks(batches):
            rows = [shingles(t, n) for t in b.column("text").to_pylist()]
            keys = [_key(h) if len(h) else (0, 0) for h in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                 pa.array([h.tobytes() for h in rows], pa.binary())], ["k1", "k2", "hashes"])
    found = over_batches(some, run, "k1 long, k2 long, hashes binary")
    return (found.join(wanted.select("id", "k1", "k2"), ["k1", "k2"])
            .groupBy("id").agg(F.any_value("hashes").alias("hashes")))


def _overlaps(pairs: DataFrame, sets: DataFrame, percent: int, least: float | None = None) -> DataFrame:
    """(y, x, common, links, distance, plus, minus) of pairs (y, x): distance is Jaccard's; plus
    and minus are y - x and x - y of pairs of a similarity of ``least`` or more."""
    both = (pairs.select("y", "x")
            .join(sets.select(F.col("id").alias("y"), F.col("hashes").alias("hy")), "y")
            .join(sets.select(F.col("id").alias("x"), F.col("hashes").alias("hx")), "x"))
    none = np.empty(0, np.int64)

    def run(batches):
        for b in chunks(batches):
            common, links, far, plus, minus = [], [], [], [], []
            for one, two in zip(b.column("hy"), b.column("hx")):
                hy, hx = (np.frombuffer(v.as_py(), _U) for v in (one, two))
                at = np.minimum(np.searchsorted(hx, hy), len(hx) - 1)
                there = hx[at] == hy
                c = int(there.sum())
                union = len(hx) + len(hy) - c
                told = least is not None and c >= least * union
                if told:
                    left = np.ones(len(hx), bool)
                    left[at[there]] = False
                common.append(c)
                links.append(100 * c >= percent * union)
                far.append(1 - c / union)
                plus.append(hy[~there].view(np.int64) if told else none)
                minus.append(hx[left].view(np.int64) if told else none)
            yield pa.RecordBatch.from_arrays(
                [b.column("y"), b.column("x"), pa.array(common, pa.int64()), pa.array(links, pa.bool_()),
                 pa.array(far, pa.float64()), pa.array(plus, pa.list_(pa.int64())), pa.array(minus, pa.list_(pa.int64()))],
                ["y", "x", "common", "links", "distance", "plus", "minus"])
    return over_batches(both, run, "y long, x long, common long, links boolean, distance double, "
                                   "plus array<long>, minus array<long>")


def _postings(members: DataFrame, maps, percent: int) -> DataFrame:
    """(h, frequent, leader, members, id, size, left): a row per shingle of each prefix that
    another class may hold; left counts the set's shingles from this one on, members those
    of its family."""
    def run(batches):
        for b in chunks(batches):
            rows = []
            for s, n in zip(b.column("stored").to_pylist(), b.column("size").to_pylist()):
                h, shared, often = prefix(np.array(s, np.int64).view(_U), n, maps.value, percent)
                at = np.flatnonzero(shared)
                rows.append((h[at], often[at], n - at))
            times = np.array([len(r[0]) for r in rows], np.int64)
            repeat = lambda c: pa.array(np.repeat(np.array(b.column(c).to_pylist(), np.int64), times))
            h, f, left = (np.concatenate(c) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(f), repeat("leader"), repeat("members"), repeat("id"), repeat("size"),
                 pa.array(left, pa.int64())], ["h", "frequent", "leader", "members", "id", "size", "left"])
    some = members.select("leader", "members", "id", "size", "stored")
    return over_batches(some, run,
                        "h long, frequent boolean, leader long, members long, id long, size long, left long")


class Lists:
    """Probes lists with their sets; sends out (y, x): a set y and the leader x of a larger
    family (of equal ones, the larger leader)."""

    def __init__(self, percent: int):
        self.percent = percent
        self.y: list[np.ndarray] = []
        self.x: list[np.ndarray] = []
        self.compared = self.skipped = 0                # sets and blocks

    def probe(self, entries, leader, members, ids, size, left) -> None:
        """A list of any length. entries, one a family: leader, members, least and greatest
        size, most left, in order of size; compared by blocks with the sets that probe it."""
        e_leader, e_members, e_lo, e_hi, e_left = entries
        p = self.percent
        smallest = -(-p * size // 100)                  # of a set that links
        for at in range(0, len(e_leader), BLOCK):
            block = slice(at, at + BLOCK)
            lo, hi, most = e_lo[block].min(), e_hi[block].max(), e_left[block].max()
            some = np.flatnonzero((100 * hi >= p * size) & (100 * size >= p * lo) & (members <= e_members[block].max())
                                  & (np.minimum(left, most) >= needed(size, np.maximum(lo, smallest), p)))
            self.skipped += len(size) - len(some)
            self.compared += len(some)
            if not len(some):
                continue
            s, l, m, own, least = (c[some][:, None] for c in (size, left, members, leader, smallest))
            larger = (m < e_members[block]) | ((m == e_members[block]) & (own < e_leader[block]))
            good = (larger & (100 * e_hi[block] >= p * s) & (100 * s >= p * e_lo[block])
                    & (np.minimum(l, e_left[block]) >= needed(s, np.maximum(e_lo[block], least), p)))
            a, b = np.nonzero(good)
            self.y.append(ids[some][a])
            self.x.append(e_leader[block][b])

    def short(self, of, leader, members, ids, size, left) -> None:
        """Many short lists at once, each in order of size: every set meets the d-th after it in
        its list, for growing d, until its list ends or the sizes have grown too far apart."""
        at, d = np.arange(len(of) - 1), 1
        while len(at):
            at = at[at + d < len(of)]
            at = at[(of[at] == of[at + d]) & (100 * size[at] >= self.percent * size[at + d])]
            b = at + d
            good = (leader[at] != leader[b]) & (np.minimum(left[at], left[b]) >= needed(size[at], size[b], self.percent))
            one, two = at[good], b[good]
            first = (members[one] < members[two]) | ((members[one] == members[two]) & (leader[one] < leader[two]))
            self.y.append(ids[np.where(first, one, two)])
            self.x.append(leader[np.where(first, two, one)])
            d += 1

    def out(self):
        y, x = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (self.y, self.x))
        self.y, self.x = [], []
        pairs = np.unique(np.stack([y, x], 1), axis=0) if len(y) else np.empty((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["y", "x"])


_FIELDS = ("leader", "members", "id", "size", "left")


def _walk_short(batches, percent: int):
    """Rows of short lists, sorted by (h, size). A list that goes on in the next batch waits."""
    lists, kept = Lists(percent), None
    for b in batches:
        if not b.num_rows:
            continue
        col = [b.column(c).to_numpy(zero_copy_only=False) for c in ("h", *_FIELDS)]
        col = col if kept is None else [np.concatenate(c) for c in zip(kept, col)]
        last = int(np.searchsorted(col[0], col[0][-1]))
        kept = [c[last:] for c in col]
        lists.short(*(c[:last] for c in col))
        yield lists.out()
    if kept is not None:
        lists.short(*kept)
    yield lists.out()


def _walk_long(batches, percent: int):
    """Rows of long lists, sorted by (h, cell, salt), entries before the sets that probe them;
    a list may go over several batches."""
    lists, entries, of = Lists(percent), None, None
    for b in batches:
        if not b.num_rows:
            continue
        col = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        turn = np.zeros(b.num_rows - 1, bool)
        for c in ("h", "cell", "salt"):
            turn |= np.diff(col[c]) != 0
        cuts = np.flatnonzero(turn) + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            key = (col["h"][lo], col["cell"][lo], col["salt"][lo])
            if key != of:
                of, entries = key, None
            first = lo + int(col["entry"][lo:hi].sum())
            if first > lo:
                new = [col[c][lo:first] for c in ("leader", "members", "size", "hi", "left")]
                entries = new if entries is None else [np.concatenate(e) for e in zip(entries, new)]
            if first < hi and entries is not None:
                lists.probe(entries, *(col[c][first:hi] for c in _FIELDS))
            if sum(map(len, lists.y)) > 100_000:
                yield lists.out()
    yield lists.out()


def candidates(members: DataFrame, maps: np.ndarray, percent: int = PERCENT) -> DataFrame:
    """(y, x): pairs of a set and the leader of another family that pass the index."""
    known = members.sparkSession.sparkContext.broadcast(maps)            # 2 x BITMAP / 8 bytes
    posts = written(_postings(members, known, percent), "postings")
    short = (posts.where("not frequent").drop("frequent").repartition("h").sortWithinPartitions("h", "size"))
    # a long list is dealt by classes of size (sets that link are at most one class apart) and
    # by parts of the sets; a family's entry goes wherever sets may probe it
    often = posts.where("frequent")
    cell = lambda c: F.floor(F.log(F.col(c).cast("double")) / F.lit(float(np.log(100 / percent)))).cast("int")
    entries = (often.groupBy("h", "leader", "members").agg(
        F.min("size").alias("size"), F.max("size").alias("hi"), F.max("left").alias("left"))
        .select("h", F.lit(True).alias("entry"), "leader", "members", F.lit(0).cast("long").alias("id"), "size", "hi", "left",
                F.explode(F.sequence(cell("size") - 1, cell("hi") + 1)).alias("cell"))
        .select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt")))
    probes = often.select("h", F.lit(False).alias("entry"), "leader", "members", "id", "size", F.col("size").alias("hi"), "left",
                          cell("size").alias("cell"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    long = (entries.unionByName(probes).repartition("h", "cell", "salt")
            .sortWithinPartitions("h", "cell", "salt", F.desc("entry"), "size", "left"))
    return (over_batches(short, lambda batches: _walk_short(batches, percent), "y long, x long")
            .unionByName(over_batches(long, lambda batches: _walk_long(batches, percent), "y long, x long")).distinct())


def _possible(pairs: DataFrame, joined: DataFrame, radius: DataFrame, percent: int) -> DataFrame:
    """The pairs (y, x) whose similarity can reach the threshold less the radius of x's family,
    by the exact overlap in the low range and the sizes of the rest."""
    of = lambda c: joined.select(F.col("id").alias(c), F.col("size").alias(f"s{c}"), F.col("stored").alias(f"h{c}"))
    rows = (pairs.join(radius.groupBy("leader").agg(F.max("radius").alias("radius")).withColumnRenamed("leader", "x"), "x", "left")
            .join(of("y"), "y").join(of("x"), "x"))

    def run(batches):
        for b in chunks(batches):
            keep = []
            for sy, hy, sx, hx, r in zip(*(b.column(c).to_pylist() for c in ("sy", "hy", "sx", "hx", "radius"))):
                ly, lx = (h[h < _LOW_END] for h in (np.array(v, np.int64).view(_U) for v in (hy, hx)))
                most = len(np.intersect1d(ly, lx, assume_unique=True)) + min(sy - len(ly), sx - len(lx))
                keep.append(most / (sy + sx - most) >= percent / 100 - (r or 0) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column("y"), b.column("x")], ["y", "x"]).filter(pa.array(keep))
    return over_batches(rows, run, "y long, x long")


def _inside_families(family: DataFrame, percent: int) -> DataFrame:
    """(a, b): links between members of one family that are not connected by their leader.
    Two members differ in |Dy ^ Dx| shingles, at most ``most`` if they link; a relative
    shares at least one difference with any member that it links with."""
    most = lambda s: F.floor(s * (100 - percent) / F.lit(100 + percent))
    members = family.select("leader", "id", "size", "follows", F.concat("plus", "minus").alias("d"))
    some = family.where("not follows").select("leader").distinct()
    members = written(members.join(some, "leader", "left_semi"), "differences")
    each = members.select("leader", "id", F.explode("d").alias("h"))
    often = each.groupBy("leader", "h").agg(F.count("*").alias("n"))
    ordered = (each.join(often, ["leader", "h"]).groupBy("leader", "id")
               .agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("o")))
    largest = most(F.col("size") + F.floor(F.col("size") * 100 / F.lit(percent)))
    prefixes = written(
        ordered.join(members.select("leader", "id", "size", "follows", F.size("d").alias("nd")), ["leader", "id"])
        .select("leader", "id", "size", "follows", "nd", F.greatest(F.lit(1), F.col("nd") - largest).alias("r"), F.posexplode("o").alias("at", "e"))
        .where((F.col("e.n") > 1) & (F.col("at") <= F.col("nd") - F.col("r")))
        .select("leader", F.col("e.h").alias("h"), "id", "size", "follows", "nd", (F.col("nd") - F.col("at")).alias("left")),
        "difference-prefixes")
    of = lambda c: members.select(F.col("id").alias(c), F.col("size").alias(f"s{c}"), F.col("d").alias(f"d{c}"))
    differ = F.size("dy") + F.size("dx") - 2 * F.size(F.array_intersect("dy", "dx"))
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    shared = lambda nd, size: (a("nd") + nd - most(a("size") + size)) / 2

    def linked(rows: DataFrame) -> DataFrame:
        """Pairs (y, x) that link, by their differences."""
        return (rows.distinct().join(of("y"), "y").join(of("x"), "x").where(differ <= most(F.col("sy") + F.col("sx")))
                .select(F.col("y").alias("a"), F.col("x").alias("b")))
    # 1. the nearest member of each list is tried first, and the nearest follower
    near = F.struct("nd", "id", "size", "left")
    nearest = prefixes.groupBy("leader", "h").agg(F.min(near).alias("any"), F.min(F.when(F.col("follows"), near)).alias("f"))
    nearest = nearest.select("leader", "h", F.explode(F.array_distinct(F.array("any", "f"))).alias("t")).where("t is not null")
    tried = prefixes.where("not follows").alias("a").join(nearest.select("leader", "h", "t.*").alias("b"), ["leader", "h"]).where(
        (a("id") != b("id")) & (F.least(a("left"), b("left")) >= shared(b("nd"), b("size"))))
    first = written(linked(tried.select(a("id").alias("y"), b("id").alias("x"))), "first-links")
    # 2. what is connected then has one entry in a list; only entries of others are probed
    stars = family.where("follows").select(F.col("id").alias("a"), F.col("leader").alias("b"))
    roots = written(connected(first.union(stars).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "stars")
    rows = prefixes.join(roots, prefixes["id"] == roots["node"], "left").select(
        *prefixes.columns, F.coalesce("root", "id").alias("label"))
    mixed = rows.groupBy("leader", "h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    rows = written(rows.join(mixed.select("leader", "h"), ["leader", "h"], "left_semi"), "mixed-lists")
    entries = rows.groupBy("leader", "h", "label").agg(
        F.min("nd").alias("nd"), F.max("size").alias("size"), F.max("left").alias("left"))
    open_ = (rows.alias("a").join(entries.alias("b"), ["leader", "h"])
             .where((a("label") < b("label")) & (F.least(a("left"), b("left")) >= shared(b("nd"), b("size"))))
             .select("leader", "h", "a.id", "a.size", "a.nd", "a.left", b("label").alias("label")))
    rest = (open_.alias("a").join(rows.alias("b"), ["leader", "h", "label"])
            .where(F.least(a("left"), b("left")) >= shared(b("nd"), b("size")))
            .select(a("id").alias("y"), b("id").alias("x")))
    return first.union(linked(rest))


def _derived(pairs: DataFrame, family: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of sets y of pairs (y, leader, follows, common) with the leader's followers
    (one is enough, they are connected) or relatives (all), from the overlap with the leader
    and the members' differences. Members travel in packs of ``CHUNK``."""
    packs = (family.withColumn("pack", F.shiftright(F.monotonically_increasing_id(), CHUNK.bit_length() - 1))
             .groupBy("leader", "follows", "pack").agg(F.collect_list(F.struct("id", "size", "plus", "minus")).alias("them")))
    rows = (pairs.join(packs, ["leader", "follows"]).join(sets.select(F.col("id").alias("y"), "hashes"), "y")
            .select("y", "follows", "common", "them", "hashes"))

    def held(parts, hy):
        """How many of each part's hashes y holds."""
        ends = np.cumsum([len(p) for p in parts])
        h = np.array([x for p in parts for x in p], np.int64).view(_U)
        at = np.minimum(np.searchsorted(hy, h), len(hy) - 1)
        counts = np.concatenate([[0], np.cumsum(hy[at] == h)])
        return counts[ends] - counts[np.concatenate([[0], ends[:-1]])]

    def run(batches):
        for b in chunks(batches, 16):
            ys, xs = [], []
            for y, follows, common, them, raw in zip(
                    *(b.column(c).to_pylist() for c in ("y", "follows", "common", "them", "hashes"))):
                hy = np.frombuffer(raw, _U)
                c = common + held([t["plus"] for t in them], hy) - held([t["minus"] for t in them], hy)
                size = np.array([t["size"] for t in them], np.int64)
                good = np.flatnonzero(100 * c >= percent * (size + len(hy) - c))
                for i in good[:1] if follows else good:
                    ys.append(y)
                    xs.append(them[i]["id"])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int64()), pa.array(xs, pa.int64())], ["a", "b"])
    return over_batches(rows, run, "a long, b long")


def _sets_of_pairs(docs: DataFrame, classes: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
    wanted = pairs.select(F.col("y").alias("id")).union(pairs.select("x")).distinct()
    return _sets_of(docs, classes.join(wanted, "id", "left_semi"), n)


def families(docs: DataFrame, classes: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(id, leader, size, follows, distance, plus, minus) of followers and relatives, and the
    links (a, b) met on the way. A leader belongs to no other family."""
    pairs = written(_leader_proposals(classes.select("id", "mins")), "proposals")
    tried = written(_overlaps(pairs, _sets_of_pairs(docs, classes, pairs, n), percent, min(HALF, percent / 100) - 1e-9)
                    .where(F.col("links") | (F.col("distance") <= 1 - HALF + 1e-9)), "tried")
    told = (tried.join(tried.select(F.col("y").alias("x")), "x", "left_anti")
            .join(classes.select(F.col("id").alias("y"), "size"), "y")
            .select(F.col("y").alias("id"), F.col("x").alias("leader"), "size", F.col("links").alias("follows"),
                    "distance", "plus", "minus"))
    return written(told, "families"), tried.where("links").select(F.col("y").alias("a"), F.col("x").alias("b"))


def class_links(docs: DataFrame, classes: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(a, b): links that connect exactly what all links between the classes connect."""
    far = F.lit(1 - percent / 100 + 1e-9)
    # smaller sets link with equal ones only
    joined = classes.where(F.col("size") * (100 - percent) >= percent)
    family, links = families(docs, joined, n, percent)
    links = written(links.union(_inside_families(family, percent)), "inside")
    counts = family.groupBy("leader").agg((F.count("*") + 1).alias("members"))
    places = (joined.select("id").join(family.select("id", "leader"), "id", "left")
              .select(F.coalesce("leader", "id").alias("leader"), "id")
              .join(counts, "leader", "left").withColumn("members", F.coalesce("members", F.lit(1).cast("long"))))
    members = joined.select("id", "size", "stored").join(places, "id")
    radius = family.groupBy("leader", "follows").agg(F.max("distance").alias("radius"))
    pairs = written(candidates(members, bitmaps(joined.select("stored")), percent), "candidates")
    pairs = written(_possible(pairs, joined, radius, percent), "possible")
    sets = _sets_of_pairs(docs, joined, pairs, n)
    answers = written(_overlaps(pairs, sets, percent).drop("plus", "minus").withColumnRenamed("x", "leader"), "answers")
    links = written(links.union(answers.where("links").select("leader", "y")), "links")
    # what the leader's answers leave open
    roots = written(connected(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))), "roots")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    open_ = (answers.join(radius, "leader").where(F.col("distance") <= F.col("radius") + far)
             .join(root("y"), "y", "left").join(root("leader"), "leader", "left")
             .where(~F.col("follows") | (F.coalesce("y_root", "y") != F.coalesce("leader_root", "leader")))
             .select("y", "leader", "follows", "common"))
    open_ = written(open_, "open")
    sets = _sets_of(docs, joined.join(open_.select(F.col("y").alias("id")).distinct(), "id", "left_semi"), n)
    both = links.union(_derived(open_, family, sets, percent))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def components(docs: DataFrame, n: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per row of ``docs``."""
    rows = written(document_sets(docs, n, percent).withColumn("row", F.monotonically_increasing_id()), "document-sets")
    # a class goes by the number of one of its rows, which stands for it
    keys = written(rows.where("size > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("least"), F.min("row").alias("id")), "classes")
    classes = (rows.select(F.col("row").alias("id"), "size", "k1", "k2", "stored", "mins")
               .join(keys.select("id", F.col("least").alias("doc_id")), "id"))
    roots = connected(class_links(docs, classes, n, percent))
    rooted = keys.join(roots, keys["id"] == roots["node"], "left").select(
        "k1", "k2", "least", F.coalesce("root", "id").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("k1", "k2", "root").join(least, "root").select("k1", "k2", "component_id")
    empty = rows.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return (rows.where("size > 0").select("doc_id", "size", "k1", "k2").join(of, ["k1", "k2"])
            .select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(empty))
