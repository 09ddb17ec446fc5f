"""Exact ranked search by inner products over sparse ball trees.

A document is a sparse vector of integers over the terms that some query asks for, a query a vector of term weights, and a score their inner product.
Texts are read once: a task turns them into vectors, which are written, and sums over these give the weights. Each task then builds ball trees over
blocks of its vectors and searches every query in them, best bound first, with the scores that it has found so far as the threshold.

A ball is a product of balls: terms are put in groups of like frequency, and a node has a centroid over all terms and a radius for each group. For any
document d below a node with centroid c and radii r, q.d <= q.c + sum over groups of |q_g| r_g. Bounds are floats that are rounded up by more than
all errors in them, so nothing that could rank is passed over; leaves are scored in 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import materialize
from gradeloom.llm.textops import LOWER, chunks, utf8, word_ids, word_spans

#: Text of the queries of one pass over the documents.
QUERY_BYTES = 16 << 20
#: Documents and vector entries of a tree, documents of a leaf, groups of terms, and bytes of a tree's centroids.
BLOCK_DOCS, BLOCK_ENTRIES, LEAF_DOCS, N_GROUPS, CENTROID_BYTES = 8192, 4 << 20, 64, 4096, 64 << 20
_NO_ID = np.iinfo(np.int64).max

_APART = np.ones(256, bool)
_APART[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = False
_APART[128:] = False
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def query_terms(text: str | None) -> Counter:
    """Terms of a query with their repeats."""
    return Counter(x.encode() for x in _TERM.findall((text or "").translate(_LOWER)))


def term_vectors(docs: DataFrame, terms: dict[bytes, int], key: str, text: str) -> DataFrame:
    """(id, n, terms, counts): number of all terms, and how often each term of ``terms`` occurs; rows without any term are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = shared.value, max(len(shared.value), 1)
        for batch in chunks(batches, "text"):
            data, at = utf8(batch.column("text"))
            data = LOWER[data]
            starts, ends, places = word_spans(data, at, _APART)
            ids, words = word_ids(data, starts, ends, _APART)
            number = np.fromiter((known.get(w, -1) for w in words.to_pylist()), np.int64, len(words))[ids]
            sizes = np.diff(places)
            doc = np.repeat(np.arange(len(sizes)), sizes)[number >= 0]
            pairs, counts = np.unique(doc * width + number[number >= 0], return_counts=True)
            ends_at = np.searchsorted(pairs, np.arange(len(sizes) + 1) * width)
            lists = [pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pa.array(x, pa.int32())) for x in (pairs % width, counts)]
            rows = pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "counts"])
            yield rows.filter(pa.array(sizes > 0))

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(emit, "id long, n long, terms array<int>, counts array<int>")


class BallTree:
    """Over vectors in rows ``ends[i]:ends[i + 1]`` of (terms, values), in the order of the terms; none is empty. ``group`` never falls from term to term."""

    def __init__(self, ids: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, scale: np.ndarray, group: np.ndarray, leaf_docs: int):
        width, self.n_groups = len(scale), int(group.max()) + 1 if len(group) else 1
        docs = len(ids)
        leaf_docs = max(leaf_docs, 2 * docs * (width + self.n_groups) * 8 // CENTROID_BYTES)
        scaled = values * scale[terms]
        order = np.arange(docs)
        self.children, self.spans, centroids, radii, min_ids = [], [], [], [], []
        todo = [(0, docs)]
        self.slack = 16.0 * (width + len(group) + 64) * 2.0**-53
        # breadth first; the documents of a node are neighbours in ``order``
        for node, (a, b) in enumerate(todo):
            mine = order[a:b]
            at, size = _entries(ends, mine)
            local = np.repeat(np.arange(b - a), size)
            t, v = terms[at], values[at].astype(float)
            centre = np.bincount(t, v, width) / (b - a)
            own = np.bincount(group, centre * centre, self.n_groups)
            g = group[t]
            starts = np.flatnonzero(np.append(True, (local[1:] != local[:-1]) | (g[1:] != g[:-1])))
            g = g[starts]
            # |d - c|^2 - |c|^2 in a group is 0 for a document that has none of its terms
            apart = np.where(np.bincount(g, minlength=self.n_groups) < b - a, 0.0, -np.inf)
            np.maximum.at(apart, g, np.add.reduceat(v * (v - 2 * centre[t]), starts))
            most = np.zeros(self.n_groups)
            np.maximum.at(most, g, np.add.reduceat(v * v, starts))
            radii.append(np.sqrt(np.maximum(apart + own, 0) + self.slack * (own + most)) * (1 + self.slack))
            centroids.append(centre)
            min_ids.append(int(ids[mine].min()))
            self.spans.append((a, b))
            if b - a <= leaf_docs:
                self.children.append(None)
                continue
            self.children.append((len(todo), len(todo) + 1))
            # cut across the line from the document farthest from the centre to the one farthest from that
            s = scaled[at]
            first = _far(local, t, s, b - a, np.bincount(t, s, width) / (b - a))
            second = _far(local, t, s, b - a, _dense(terms, scaled, ends, mine[first], width))
            along = _dense(terms, scaled, ends, mine[first], width) - _dense(terms, scaled, ends, mine[second], width)
            middle = (b - a) // 2
            order[a:b] = mine[np.argsort(np.bincount(local, s * along[t], b - a), kind="stable")]
            todo += [(a, a + middle), (a + middle, b)]
        self.centroids, self.radii, self.min_ids = np.stack(centroids), np.stack(radii), min_ids
        at, size = _entries(ends, order)
        self.ids, self.terms, self.values = ids[order], terms[at], values[at]
        self.ends = np.append(0, np.cumsum(size))

    def bound(self, node: int, query: Query) -> int:
        raw = self.centroids[node].take(query.terms) @ query.weights + self.radii[node].take(query.groups) @ query.norms
        return math.floor(raw * (1 + self.slack) + 2.0**-20)

    def search(self, query: Query, dense: np.ndarray, top: Top) -> int:
        """Put what ranks into ``top``; ``dense`` has the query's weights by term. Returns the number of documents that were scored."""
        scored, heap = 0, [(-self.bound(0, query), self.min_ids[0], 0)]
        while heap:
            bound, least_id, node = heapq.heappop(heap)
            if top.beats(-bound, least_id):
                break  # all others are bounded by less, or by as much with larger ids
            if (pair := self.children[node]) is not None:
                for child in pair:
                    if not top.beats(b := self.bound(child, query), self.min_ids[child]):
                        heapq.heappush(heap, (-b, self.min_ids[child], child))
                continue
            a, b = self.spans[node]
            lo, hi = self.ends[a], self.ends[b]
            scores = np.add.reduceat(dense[self.terms[lo:hi]] * self.values[lo:hi], self.ends[a:b] - lo)
            scored += b - a
            for k in np.flatnonzero(scores >= max(top.least, 1)):
                top.put(int(scores[k]), int(self.ids[a + k]))
        return scored


def _entries(ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of ``docs``, one after another, and how many each has."""
    size = ends[docs + 1] - ends[docs]
    return np.repeat(ends[docs] - (np.cumsum(size) - size), size) + np.arange(size.sum()), size


def _dense(terms: np.ndarray, values: np.ndarray, ends: np.ndarray, doc: int, width: int) -> np.ndarray:
    out = np.zeros(width)
    out[terms[ends[doc] : ends[doc + 1]]] = values[ends[doc] : ends[doc + 1]]
    return out


def _far(local: np.ndarray, t: np.ndarray, v: np.ndarray, n: int, point: np.ndarray) -> int:
    return int(np.bincount(local, v * (v - 2 * point[t]), n).argmax())


class Query:
    """A query's terms with their integer weights (repeats included), and its norm in each group of terms."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, group: np.ndarray):
        self.terms, self.whole, self.weights = terms, weights, weights.astype(float)
        self.groups, at = np.unique(group[terms], return_inverse=True)
        self.norms = np.sqrt(np.bincount(at, self.weights**2, len(self.groups))) * (1 + 2.0**-40)


class Top:
    """The ``k`` best (score, id), small ids first among equal scores."""

    def __init__(self, k: int):
        self.k, self.heap, self.least = k, [], 0

    def put(self, score: int, doc: int) -> None:
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, (score, -doc))
        elif (score, -doc) > self.heap[0]:
            heapq.heapreplace(self.heap, (score, -doc))
        if len(self.heap) == self.k:
            self.least = self.heap[0][0]

    def beats(self, bound: int, least_id: int) -> bool:
        """Whether nothing with a score up to ``bound`` and ids from ``least_id`` can come in."""
        return bound < 1 or len(self.heap) == self.k and (bound, -least_id) <= self.heap[0]


def _impacts(n: np.ndarray, counts: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What each count of a term is worth in a document of ``n`` terms."""
    m = 100 - 75 + (75 * n * n_docs) // all_terms
    return (1_000_000_000 * counts) // (1000 * counts + 8 * m)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, n, ends, terms, counts) of up to BLOCK_DOCS documents; those with no term of a query are left out."""
    held, docs, entries = [], 0, 0
    for batch in batches:
        for first in range(0, batch.num_rows, 512):
            part = batch.slice(first, 512)
            sizes = np.diff(part.column("terms").offsets.to_numpy())
            terms, counts = (part.column(c).flatten().to_numpy() for c in ("terms", "counts"))
            some = sizes > 0
            held.append((part.column("id").fill_null(_NO_ID).to_numpy()[some], part.column("n").to_numpy()[some], sizes[some], terms, counts))
            docs, entries = docs + int(some.sum()), entries + len(terms)
            if docs >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, docs, entries = [], 0, 0
    if docs:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _search_block(docs: DataFrame, items: list, top_k: int, key: str, text: str, leaf_docs: int) -> DataFrame:
    """(item, id, score): the best documents for each of ``items`` (item, text) that each task has found."""
    spark = docs.sparkSession
    asked = {r["item"]: query_terms(r["text"]) for r in items}
    terms = {t: k for k, t in enumerate(sorted(set().union(*asked.values())))}
    vectors = materialize(term_vectors(docs, terms, key, text), "term-vectors")

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows, size = np.zeros(len(terms) + 1, np.int64), 0, 0
        for batch in batches:
            found += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=len(found))
            rows, size = rows + batch.num_rows, size + int(batch.column("n").to_numpy().sum())
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int64()), pa.array([*found[at].tolist(), rows, size], pa.int64())], ["term", "n"])

    counted = {r["term"]: r["n"] for r in vectors.mapInArrow(holders, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n_docs, all_terms = counted.get(-1, 0), counted.get(-2, 0)
    df = np.array([counted.get(k, 0) for k in range(len(terms))], np.int64)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    # terms are numbered by falling frequency from here on
    common_first = np.argsort(-df, kind="stable")
    number = np.empty(len(df), np.int64)
    number[common_first] = np.arange(len(df))
    weight, group = weight[common_first], np.arange(len(df)) * min(N_GROUPS, len(df)) // max(len(df), 1)
    queries = {}
    for item, own in asked.items():
        at = number[[terms[t] for t in own]] if own else np.zeros(0, np.int64)
        w = weight[at] * np.array(list(own.values()), np.int64) if len(at) else at
        if (used := w > 0).any():
            queries[item] = Query(at[used], w[used], group)
    shared = spark.sparkContext.broadcast((queries, number, weight, group))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, number, weight, group = shared.value
        best = {item: Top(top_k) for item in queries}
        dense = np.zeros(len(weight), np.int64)
        for ids, n, sizes, t, counts in _blocks(batches):
            row, t = np.repeat(np.arange(len(ids)), sizes), number[t]
            order = np.lexsort((t, row))
            values = _impacts(n[row], counts.astype(np.int64), n_docs, all_terms)[order]
            tree = BallTree(ids, np.append(0, np.cumsum(sizes)), t[order], values, weight.astype(float), group, leaf_docs)
            for item, query in queries.items():
                dense[query.terms] = query.whole
                tree.search(query, dense, best[item])
                dense[query.terms] = 0
        rows = [(item, None if -x == _NO_ID else -x, score) for item, top in best.items() for score, x in top.heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], []))], ["item", "id", "score"])

    return vectors.mapInArrow(search, "item long, id long, score long")


def ranked_search(docs: DataFrame, queries: DataFrame, top_k: int = 10, *, key: str = "doc_id", text: str = "text", query_key: str = "item_id", query_text: str = "text", leaf_docs: int = LEAF_DOCS) -> DataFrame:
    """The ``top_k`` best rows of ``docs`` for each row of ``queries``: (query_key, rank, key, score), with scores above 0.

    Terms are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. With N rows that have a term, L terms in all of them, n in one, and df rows
    that hold a term tf times: weight w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 25 + 75 n N div L, and a score is the sum of
    w (10^9 tf div (1000 tf + 8 m)) over a query's terms, repeats included. Equal scores rank by ascending id.

    Queries are searched in blocks of ``QUERY_BYTES`` of text, each with a pass over the documents. Nulls and texts without a term match nothing; a null id comes last among
    equal scores (ids become longs); repeated rows rank as often as they are there; repeated queries are searched each; an empty table gives no rows.
    """
    items = materialize(queries.select(F.monotonically_increasing_id().alias("item"), F.col(query_key).alias("query_key"), F.col(query_text).cast("string").alias("text")), "queries")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-size // QUERY_BYTES)
    found = docs.sparkSession.createDataFrame([], "item long, id long, score long")
    for k in range(n_blocks):
        mine = items.filter((F.xxhash64("item") % n_blocks + n_blocks) % n_blocks == k).select("item", "text").collect()
        found = found.unionByName(_search_block(docs, mine, top_k, key, text, leaf_docs))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    return best.join(items.select("item", "query_key"), "item").select(F.col("query_key").alias(query_key), "rank", F.col("id").alias(key), "score")
