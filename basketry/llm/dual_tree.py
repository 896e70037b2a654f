"""Ranked lexical search with two trees: all documents for every item of a query set.

A first pass turns each document into its length and its counts of the items' terms and
writes them; a second one sums the corpus statistics (N, L, df) over all of it. The
search then runs over those vectors:

* items stand in a tree whose nodes hold, for each term, the greatest weight (repeats x w)
  of the items below; documents, a few thousand at a time, stand in a tree whose nodes
  hold the greatest gain ((1000000000 tf) div (1000 tf + 12 m)) of the documents below.
  Both are ordered by their heaviest terms first, so that neighbours share terms.
* the product of two nodes' maxima bounds the score of every pair below them. Where it
  is under the weakest kth score of the node's items, the whole batch is left out; equal
  scores stay, as ties go by doc_id. Children are visited best bound first.
* two leaves are scored exactly, as one small matrix product in integers (or in doubles
  while every sum stays below 2^53, where they are exact).

A task keeps the k best of each item over all its documents, so the merge sees at most
k rows an item and task, through a group-limited window.

Items are a stated query set, taken in groups of at most ``GROUP_ITEMS`` items and
``GROUP_BYTES`` of text; each group is a pass over the documents, so what a task holds is
bounded whatever the number of items. A single longer item is a group of its own.

Defined cases: null text has no terms; a document without terms counts in nothing and is
never found; an item without terms finds nothing. Every row is a document or an item of
its own, also where an id repeats (a repeated item gets its list once for each row). A
null doc_id ranks after all others of its score. Empty tables give empty results."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import chunks, id_text, over_batches, written

TOP = 20
GROUP_ITEMS = 1024
GROUP_BYTES = 1 << 20
DOC_LEAF, DOC_CHUNK = 32, 4096
ITEM_LEAF = 8
FAN = 4
#: Every ASCII byte but letters and digits separates terms; A-Z count as a-z.
_SEPARATED = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SEPARATED).lower().split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with a term: length, and numbers and
    counts of the vocabulary's terms as packed int32."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        number = known.value.get
        for b in chunks(batches):
            ids, ns, at, tf = [], [], [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = terms(text)
                if not words:
                    continue
                found = Counter(map(number, words))
                found.pop(None, None)
                ids.append(i)
                ns.append(len(words))
                at.append(np.fromiter(found.keys(), "<i4", len(found)).tobytes())
                tf.append(np.fromiter(found.values(), "<i4", len(found)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(at, pa.binary()), pa.array(tf, pa.binary())],
                ["doc_id", "n", "terms", "counts"])
    return over_batches(id_text(docs), run, "doc_id long, n long, terms binary, counts binary")


def statistics(vecs: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each of the vocabulary's terms, over all documents."""
    def run(batches):
        n, total, df = 0, 0, np.zeros(size, np.int64)
        for b in batches:
            n += b.num_rows
            total += sum(b.column("n").to_pylist())
            df += np.bincount(np.frombuffer(b"".join(b.column("terms").to_pylist()), "<i4"), minlength=size)
        some = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([[-2, -1], some]), pa.int32()),
                 pa.array(np.concatenate([[n, total], df[some]]), pa.int64())], ["term", "x"])
    rows = (over_batches(vecs.select("n", "terms"), run, "term int, x long")
            .groupBy("term").agg(F.sum("x").alias("x")).collect())
    of = {r.term: r.x for r in rows}
    df = np.zeros(size, np.int64)
    for t, x in of.items():
        if t >= 0:
            df[t] = x
    return of.get(-2, 0), of.get(-1, 0), df


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Tree:
    """Levels of coordinate maxima over rows that stand in order: level 0 are leaves of
    ``leaf`` rows, each higher node has ``FAN`` children, the last level is the root."""

    def __init__(self, leaves: np.ndarray, leaf: int):
        self.levels, self.leaf = [leaves], leaf
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.maximum.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    def children(self, level: int, node: int) -> tuple[int, np.ndarray]:
        """Level and numbers of the nodes below; a leaf stands for itself."""
        if not level:
            return 0, np.array([node])
        return level - 1, np.arange(node * FAN, min((node + 1) * FAN, len(self.levels[level - 1])))

    def rows(self, level: int, node: int) -> slice:
        span = self.leaf * FAN ** level
        return slice(node * span, (node + 1) * span)


def _heaviest_first(rows: np.ndarray, cols: np.ndarray, mass: np.ndarray, n: int) -> np.ndarray:
    """Order of n rows by their heaviest entry's column, then by the second heaviest's."""
    by = np.lexsort((cols, -mass, rows))
    first = np.searchsorted(rows[by], np.arange(n))
    end = np.append(first[1:], len(by))
    pick = lambda k: np.where(first + k < end, cols[by][np.minimum(first + k, len(by) - 1)], -1)
    return np.lexsort((pick(1), pick(0))) if len(by) else np.arange(n)


class Items:
    """A group of items: their weights by term in tree order, and the tree."""

    def __init__(self, ids: list, bags: list[Counter], vocabulary: dict[bytes, int], w: np.ndarray):
        rows = np.array([i for i, bag in enumerate(bags) for _ in bag], np.int64)
        cols = np.array([vocabulary[t] for bag in bags for t in bag], np.int64)
        mass = np.array([c for bag in bags for c in bag.values()], np.int64) * w[cols]
        order = _heaviest_first(rows, cols, mass, len(bags))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        rows = place[rows]
        self.row = order                                 # the item's row in its group
        self.ids = [ids[i] for i in order]
        total = np.bincount(rows, mass, len(bags)).max(initial=0)
        self.kind = np.float64 if total * 1e6 < 2**52 else np.int64
        leaves = np.zeros((-(-len(bags) // ITEM_LEAF), len(w)), self.kind)
        np.maximum.at(leaves, (rows // ITEM_LEAF, cols), mass.astype(self.kind))
        self.tree = _Tree(leaves, ITEM_LEAF)
        self.weights = w
        self.local, self.matrix = [], []                 # of a leaf: term -> column, columns x items
        for leaf in range(len(leaves)):
            own = rows // ITEM_LEAF == leaf
            used = np.unique(cols[own])
            at = np.full(len(w), -1, np.int32)
            at[used] = np.arange(len(used))
            m = np.zeros((len(used), min(ITEM_LEAF, len(bags) - leaf * ITEM_LEAF)), self.kind)
            m[at[cols[own]], rows[own] % ITEM_LEAF] = mass[own]
            self.local.append(at)
            self.matrix.append(m)


class Search:
    """The k best documents of every item of a group, over documents added in chunks."""

    def __init__(self, items: Items, n_docs: int, total: int, k: int = TOP):
        self.items, self.n_docs, self.total, self.k = items, n_docs, total, k
        n = len(items.ids)
        self.kth = np.zeros(n, np.int64)                 # an item's weakest kth score, 0 while short
        self.best = [(np.empty(0, np.int64),) * 3 for _ in range(n)]   # score, id missing, id
        self.scored = self.possible = 0                  # pairs

    def add(self, ids: list, lengths: list[int], at: list[bytes], counts: list[bytes]) -> None:
        n = len(ids)
        sizes = np.array([len(x) // 4 for x in at])
        rows = np.repeat(np.arange(n), sizes)
        cols = np.frombuffer(b"".join(at), "<i4").astype(np.int64)
        tf = np.frombuffer(b"".join(counts), "<i4").astype(np.int64)
        m = np.array([75 + (25 * x * self.n_docs) // self.total for x in lengths], np.int64)
        gain = (1_000_000_000 * tf) // (1000 * tf + 12 * m[rows])
        order = _heaviest_first(rows, cols, gain * self.items.weights[cols], n)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        by = np.argsort(place[rows], kind="stable")
        rows, cols, gain = place[rows][by], cols[by], gain[by].astype(self.items.kind)
        known = np.array([ids[i] is not None for i in order])
        keys = np.array([0 if ids[i] is None else ids[i] for i in order], np.int64)
        leaves = np.zeros((-(-n // DOC_LEAF), len(self.items.weights)), self.items.kind)
        np.maximum.at(leaves, (rows // DOC_LEAF, cols), gain)
        starts = np.searchsorted(rows, np.arange(0, n + DOC_LEAF, DOC_LEAF))
        self.possible += n * len(self.items.ids)
        self._descend(_Tree(leaves, DOC_LEAF), rows, cols, gain, starts, keys, known)

    def _descend(self, docs: _Tree, rows, cols, gain, starts, keys, known) -> None:
        items = self.items.tree
        top = (len(items.levels) - 1, 0, len(docs.levels) - 1, 0)
        todo = [(items.levels[-1][0] @ docs.levels[-1][0], *top)]
        while todo:
            bound, il, i, dl, d = todo.pop()
            if bound <= 0 or bound < self.kth[items.rows(il, i)].min():
                continue
            if il == dl == 0:
                self._score(i, d, rows, cols, gain, starts, keys, known)
                continue
            (il, below_i), (dl, below_d) = items.children(il, i), docs.children(dl, d)
            bounds = items.levels[il][below_i] @ docs.levels[dl][below_d].T
            weakest = np.array([self.kth[items.rows(il, j)].min() for j in below_i])
            left = np.argwhere((bounds > 0) & (bounds >= weakest[:, None]))
            left = left[np.argsort(bounds[left[:, 0], left[:, 1]], kind="stable")]    # the best is popped first
            todo += [(bounds[a, b], il, int(below_i[a]), dl, int(below_d[b])) for a, b in left]

    def _score(self, leaf: int, d: int, rows, cols, gain, starts, keys, known) -> None:
        span = slice(starts[d], starts[d + 1])
        at = self.items.local[leaf][cols[span]]
        own = at >= 0
        n = min(DOC_LEAF, len(keys) - d * DOC_LEAF)
        dense = np.zeros((n, len(self.items.matrix[leaf])), self.items.kind)
        dense[rows[span][own] - d * DOC_LEAF, at[own]] = gain[span][own]
        scores = (dense @ self.items.matrix[leaf]).astype(np.int64)
        self.scored += scores.size
        first = leaf * ITEM_LEAF
        enough = (scores > 0) & (scores >= self.kth[first:first + scores.shape[1]])
        for j in np.flatnonzero(enough.any(0)):
            new = np.flatnonzero(enough[:, j])
            here = d * DOC_LEAF + new
            s, missing, k = (np.concatenate(x) for x in zip(
                self.best[first + j], (scores[new, j], (~known[here]).astype(np.int64), keys[here])))
            kept = np.lexsort((k, missing, -s))[:self.k]
            self.best[first + j] = s[kept], missing[kept], k[kept]
            if len(kept) == self.k:
                self.kth[first + j] = s[kept[-1]]

    def results(self) -> tuple[list, list, list, list]:
        out: tuple[list, list, list, list] = ([], [], [], [])
        for j, (s, missing, k) in enumerate(self.best):
            for a, b, c in zip(s.tolist(), missing.tolist(), k.tolist()):
                for column, x in zip(out, (int(self.items.row[j]), self.items.ids[j], None if b else c, a)):
                    column.append(x)
        return out


def _groups(items: DataFrame, group_items: int, group_bytes: int):
    """Lists of (item_id, bag of terms), within both bounds."""
    rows, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"),
                          F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        b = len(r.text.encode("utf-8", "surrogatepass"))
        if rows and (len(rows) == group_items or size + b > group_bytes):
            yield rows
            rows, size = [], 0
        rows.append((r.item_id, Counter(terms(r.text))))
        size += b
    if rows:
        yield rows


def _search_group(docs: DataFrame, group: list, k: int) -> DataFrame:
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for _, bag in group for t in bag))}
    vecs = written(vectors(docs, vocabulary), "term-vectors")
    n_docs, total, df = statistics(vecs, len(vocabulary))
    w = np.array([weight(n_docs, int(x)) for x in df], np.int64)
    tree = docs.sparkSession.sparkContext.broadcast(
        Items([i for i, _ in group], [bag for _, bag in group], vocabulary, w))

    def run(batches):
        search = Search(tree.value, n_docs, total, k)
        for b in chunks(batches, DOC_CHUNK):
            if b.num_rows:
                search.add(*(b.column(c).to_pylist() for c in ("doc_id", "n", "terms", "counts")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, pa.int64()) for x in search.results()], ["item_row", "item_id", "doc_id", "score"])
    found = over_batches(vecs, run, "item_row long, item_id long, doc_id long, score long")
    best = Window.partitionBy("item_row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, group_items: int = GROUP_ITEMS,
           group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score of every item."""
    out = None
    for group in _groups(items, group_items, group_bytes):
        if not any(bag for _, bag in group):
            continue
        one = written(_search_group(docs, group, k), "ranked")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out
