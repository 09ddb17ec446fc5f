"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard verification.

Signatures: a shingle's hash is a place in a universe of 2^32, put there by a first permutation; coordinate k of a
document is the least value of a second permutation applied to its places shifted circularly by k. Two permutations
serve all coordinates.

Documents with equal shingle sets form one class, and classes meet in buckets, one for each band of coordinates. The
bands are chosen so that a pair at the threshold shares no bucket with probability 2e-6 at most. No bucket's pairs are
all emitted:
 1. every class of a bucket is compared with the bucket's smallest class; links give components;
 2. in buckets that still hold several components, classes of different components are compared pair by pair where the
    bucket is small;
 3. large ones are cut into blocks of a fixed size, each class in one; each task compares two blocks that have a bucket in
    common by products of their set matrices and returns a link for each two components that it finds connected, never the
    pairs themselves.
A pair within one component needs no comparison, since it can't change the result. Every comparison is exact, on the
whole word sequences; that the sets of a class are equal is told by two 64-bit sums over hashes of all their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import broadcast_if_small, materialize, unused_name
from gradeloom.llm.graph import connected_components
from gradeloom.llm.textops import LOWER, chunks, gram_ids, hash_words, places, utf8, word_ids, word_spans

COORDINATES = 120
SMALL_BUCKET = 32
#: Classes and shingles in a block, and columns of the matrices that a cell holds at a time.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
COLUMNS = 2048
_CHUNK = 1 << 16


def banding(threshold: float, coordinates: int = COORDINATES, miss: float = 2e-6) -> tuple[int, int]:
    """Bands and rows a band: the longest bands that miss a pair at the threshold with probability ``miss`` at most."""
    fits = [r for r in range(1, coordinates + 1) if (1 - threshold**r) ** (coordinates // r) <= miss]
    rows = max(fits, default=1)
    return coordinates // rows, rows


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permute(x: np.ndarray) -> np.ndarray:
    """The second permutation of 0 .. 2^32 - 1, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(places_: np.ndarray, first: np.ndarray, coordinates: int) -> np.ndarray:
    """(sets, coordinates) uint32, for sets of universe places that begin at ``first`` (no set is empty)."""
    out = np.empty((len(first), coordinates), np.uint32)
    bounds = np.append(first, len(places_))
    lo = 0
    while lo < len(first):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + _CHUNK, "right")) - 1)
        block, cuts = places_[bounds[lo] : bounds[hi]], first[lo:hi] - bounds[lo]
        for k in range(coordinates):
            out[lo:hi, k] = np.minimum.reduceat(_permute(block + np.uint32(k)), cuts)
        lo = hi
    return out


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct ``n``-word shingles of each text, run together, and n + 1 offsets.

    A-Z is lower-cased first. A text with fewer words has its whole sequence as one shingle, one without words has none.
    """
    data, at = utf8(column)
    data = LOWER[data]
    starts, ends, doc = word_spans(data, at)
    ids, distinct = word_ids(data, starts, ends)
    with np.errstate(over="ignore"):
        hashes = hash_words(distinct)[ids]
        where, owner = places(doc, n)
        grams = gram_ids(ids, n)[where] if len(ids) >= n else where
        value = np.zeros(len(where), np.uint64)
        for k in range(n):
            value = _mix64(value * np.uint64(0x9E3779B97F4A7C15) + hashes[where + k])
        keep = ~pd.Series(owner * (grams.max(initial=0) + 1) + grams).duplicated().to_numpy()
        value, owner = value[keep], owner[keep]
        short = np.flatnonzero((np.diff(doc) > 0) & (np.diff(doc) < n))
        if len(short):
            whole = np.array([np.uint64(1)] * len(short))
            for j, d in enumerate(short):
                for h in hashes[doc[d] : doc[d + 1]]:
                    whole[j] = _mix64(whole[j : j + 1] * np.uint64(0x9E3779B97F4A7C15) + h)[0]
            value, owner = np.concatenate([value, whole]), np.concatenate([owner, short])
            order = np.argsort(owner, kind="stable")
            value, owner = value[order], owner[order]
    return value, np.searchsorted(owner, np.arange(len(column) + 1))


def signatures(docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, n_shingles, set_hi, set_lo, bands array<long>) from (id, text); no bands where there are no shingles."""
    bands, rows = banding(threshold)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values, at = shingle_sets(batch.column("text"), n)
            sizes = np.diff(at)
            some = np.flatnonzero(sizes)
            first = at[:-1][some]
            sums = np.zeros((2, len(sizes)), np.uint64)
            keys = np.zeros((len(some), bands), np.uint64)
            with np.errstate(over="ignore"):
                if len(some):
                    for i in range(2):
                        sums[i, some] = np.add.reduceat(_mix64(values + np.uint64(i)), first)
                    sig = circulant_signatures((_mix64(values ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32), first, bands * rows)
                    for b in range(bands):
                        key = np.full(len(some), b + 1, np.uint64)
                        for r in range(rows):
                            key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
                        keys[:, b] = key
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * bands)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes.astype(np.int32)), *(pa.array(s.view(np.int64)) for s in sums), listed], ["id", "n_shingles", "set_hi", "set_lo", "bands"])

    return docs.mapInArrow(sign, "id long, n_shingles int, set_hi long, set_lo long, bands array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets A, B have 100 |A and B| >= percent |A or B|, compared word for word."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_a"):
            m = batch.num_rows
            sides = [batch.column(c).cast(pa.large_string()) for c in ("text_a", "text_b")]
            data, at = utf8(pa.concat_arrays(sides))
            data = LOWER[data]
            starts, ends, doc = word_spans(data, at)
            ids, _ = word_ids(data, starts, ends)
            where, owner = places(doc, n)
            grams = gram_ids(ids, n)[where] if len(ids) >= n else where
            width = int(grams.max(initial=0)) + 1
            key = pd.unique(owner * width + grams)
            owner, grams = key // width, key % width
            size = np.bincount(owner, minlength=2 * m)
            left = owner < m
            both = np.intersect1d(key[left], (owner[~left] - m) * width + grams[~left], assume_unique=True)
            common = np.bincount(both // width, minlength=m)
            ok = (common > 0) & (100 * common >= percent * (size[:m] + size[m:] - common))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long").distinct()


def near_groups(docs: DataFrame, n: int = 5, percent: int = 80, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id), a row a document: the smallest id reachable over links.

    Two rows are linked if their sets of ``n``-word shingles have 100 |A and B| >= percent |A or B|. Rows without words
    have no shingles and are alone in their component. Rows that share an id share a component. Rows with a null id are not compared;
    their component_id is null. Other columns of ``docs`` are not looked at. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = materialize(signatures(rows, n, percent / 100), "signatures")
    usable = signed.filter("n_shingles > 0 and id is not null")
    classes = usable.groupBy("set_hi", "set_lo").agg(F.min("id").alias("node"), F.max("n_shingles").alias("n"), F.min_by("bands", "id").alias("bands"))
    classes = materialize(classes, "classes")
    # ids of several rows with different sets connect their classes
    varied = usable.groupBy("id").agg(F.min(F.struct("set_hi", "set_lo")).alias("a"), F.max(F.struct("set_hi", "set_lo")).alias("b")).filter("a <> b").select("id")
    varied = materialize(varied, "varied-ids")
    same_id = None
    if not varied.isEmpty():
        sets_of = usable.join(broadcast_if_small(varied), "id").select("id", "set_hi", "set_lo").distinct()
        nodes = materialize(sets_of.join(classes.select("set_hi", "set_lo", "node"), ["set_hi", "set_lo"]).select("id", "node"), "id-classes")
        same_id = nodes.join(nodes.groupBy("id").agg(F.min("node").alias("b")), "id").select(F.col("node").alias("a"), "b").filter("a <> b")
    dealt = classes.select("node", "n", F.explode("bands").alias("bucket"))
    crowded = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("pivot"), F.min_by("n", "node").alias("pivot_n")).filter("members > 1")
    met = materialize(dealt.join(crowded, "bucket"), "buckets")

    def fits(a: str, b: str):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    def between(pairs: DataFrame) -> DataFrame:
        return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    members = met.select(F.col("node").alias("id")).distinct()
    texts = materialize(rows.join(broadcast_if_small(materialize(members, "members")), "id"), "texts")

    pairs = materialize(between(met.filter(fits("n", "pivot_n")).select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "pairs")
    found = _verified(pairs, texts, n, percent)
    tried, links = pairs, materialize(found if same_id is None else found.unionByName(same_id), "links")

    def open_buckets() -> DataFrame:
        """Rows (bucket, node, n, members, component) of buckets that hold several components."""
        labels = broadcast_if_small(connected_components(links))
        labelled = met.join(labels, "node", "left").select("bucket", "node", "n", "members", F.coalesce("component", "node").alias("component"))
        mixed = labelled.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least < most").select("bucket")
        return materialize(labelled.join(mixed, "bucket"), "open")

    def compare(candidates: DataFrame) -> None:
        nonlocal tried, links
        fresh = materialize(between(candidates).join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(fresh)
        links = materialize(links.unionByName(_verified(fresh, texts, n, percent)), "links")

    left = open_buckets()
    small = left.filter(F.col("members") <= SMALL_BUCKET).select("bucket", "node", "n", "component")
    other = small.select("bucket", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("component").alias("component_b"))
    compare(small.join(other, "bucket").filter((F.col("node") < F.col("b")) & (F.col("component") != F.col("component_b")) & fits("n", "n_b")).select(F.col("node").alias("a"), "b"))
    large = left.filter(F.col("members") > SMALL_BUCKET)
    if not large.isEmpty():
        compare(_in_blocks(large, texts, n, percent))

    mapped = classes.join(broadcast_if_small(connected_components(links)), "node", "left").select("set_hi", "set_lo", F.coalesce("component", "node").alias("component_id"))
    # most documents are alone in their class and component; the others are looked up
    alone = usable.groupBy("set_hi", "set_lo").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("only"))
    moved = materialize(mapped.join(alone, ["set_hi", "set_lo"]).filter("copies > 1 or component_id <> only").select("set_hi", "set_lo", "component_id"), "moved")
    found = signed.join(broadcast_if_small(moved), ["set_hi", "set_lo"], "left").select("id", "n_shingles", F.when(F.col("id").isNull() | (F.col("n_shingles") == 0), F.col("id")).otherwise(F.coalesce("component_id", "id")).alias("component_id"))
    return found


def keep_one(docs: DataFrame, found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of ``found`` (from near_groups): that with the smallest id.

    Of rows that repeat that id the first in the order of a hash of all columns stays, so reruns agree. Rows with a null id all stay.
    Columns and their order stay, whatever their names; an empty table stays empty.
    """
    found = materialize(found.filter("id is not null"), "components")
    gone_id, again_id, place = (unused_name(docs, c) for c in ("gone", "again", "place"))
    gone = broadcast_if_small(materialize(found.filter("component_id <> id").select(F.col("id").alias(gone_id)).distinct(), "gone"))
    left = docs.join(gone, F.col(key) == F.col(gone_id), "left_anti")
    repeated = materialize(found.filter("component_id = id").groupBy(F.col("id").alias(again_id)).count().filter("count > 1").select(again_id), "repeated")
    if repeated.isEmpty():
        return left
    again = broadcast_if_small(repeated)
    once = left.join(again, F.col(key) == F.col(again_id), "left_anti")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns)))
    return once.unionByName(left.join(again, F.col(key) == F.col(again_id), "left_semi").withColumn(place, first).filter(F.col(place) == 1).drop(place))


def _cells(placed: DataFrame) -> DataFrame:
    """(node, component, block, i, j): the cells that each row of (bucket, node, component, block) goes to.

    A bucket lists its blocks in one row, so a class meets a list in each of its buckets and the lists are united before they are dealt out. A block whose classes
    in the bucket are all of the class's own component has nothing to be compared with it and is passed over.
    """
    held = placed.groupBy("bucket", "block").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    touched = materialize(held.groupBy("bucket").agg(F.collect_list(F.struct("block", "least", "most")).alias("held")), "touched")
    foreign = F.filter("held", lambda h: (h["least"] != F.col("component")) | (h["most"] != F.col("component")))
    met = placed.join(broadcast_if_small(touched), "bucket").select("node", "component", "block", F.array_sort(F.transform(foreign, lambda h: h["block"])).alias("others"))
    united = met.groupBy("node", "component", "block").agg(F.array_distinct(F.flatten(F.collect_set("others"))).alias("others"))
    dealt = united.select("node", "component", "block", F.explode("others").alias("other"))
    return dealt.select("node", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _in_blocks(large: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b), one at most for each two components of a cell, of classes of different components that reach the threshold.

    From (bucket, node, n, members, component). A class belongs to the fullest of its buckets, which is cut into blocks of about BLOCK classes and
    BLOCK_SHINGLES shingles at most. Two blocks have a cell if a bucket reaches into both, and only classes of such buckets are sent there, if a class of another component awaits them. So every two
    classes of a bucket meet, in one cell alone; no task grows with a bucket (a single text is always whole), and buckets that are merely
    chained by common classes are never multiplied with each other.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values, at = shingle_sets(batch.column("text"), n)
            listed = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), listed], ["node", "shingles"])

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        component, size = pdf["component"].to_numpy(), pdf["shingles"].str.len().to_numpy()
        a, b = np.flatnonzero(pdf["block"] == pdf["i"]), np.flatnonzero(pdf["block"] == pdf["j"])
        x, y = size[a][:, None], size[b][None, :]
        open_ = (component[a][:, None] != component[b][None, :]) & (100 * np.minimum(x, y) >= percent * np.maximum(x, y))
        # classes that no class opposite can still be linked with need no product
        in_a, in_b = open_.any(axis=1), open_.any(axis=0)
        open_, a, b = open_[in_a][:, in_b], a[in_a], b[in_b]
        if not open_.any():
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        node, component, size, sets = pdf["node"].to_numpy()[used], component[used], size[used], pdf["shingles"].to_numpy()[used].tolist()
        a, b = place[: len(a)], place[len(a) :]
        code = pd.factorize(np.concatenate(sets))[0]
        row = np.repeat(np.arange(len(sets)), size)
        shared = np.flatnonzero(np.bincount(code) > 1)
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        common = np.zeros((len(a), len(b)), np.float32)
        for lo in range(0, len(shared), COLUMNS):
            columns = shared[lo : lo + COLUMNS]
            here = slice(np.searchsorted(code, columns[0]), np.searchsorted(code, columns[-1], "right"))
            at = np.minimum(np.searchsorted(columns, code[here]), len(columns) - 1)
            hit = columns[at] == code[here]
            ones = np.zeros((len(sets), len(columns)), np.float32)
            ones[row[here][hit], at[hit]] = 1
            common += ones[a] @ ones[b].T
        union = size[a][:, None] + size[b][None, :] - common
        x, y = np.nonzero(open_ & (100 * common >= percent * union))
        found = pd.DataFrame({"a": node[a[x]], "b": node[b[y]], "ca": component[a[x]], "cb": component[b[y]]})
        return found.drop_duplicates(["ca", "cb"])[["a", "b"]]

    home = large.groupBy("node", "n").agg(F.max_by("bucket", F.struct("members", "bucket")).alias("home"))
    wanted = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    parts = broadcast_if_small(materialize(home.groupBy("home").agg(wanted.alias("parts")), "parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), "parts"))
    blocks = materialize(home.join(parts, "home").select("node", block.alias("block")), "blocks")
    placed = materialize(large.join(broadcast_if_small(blocks), "node").select("bucket", "node", "component", "block"), "placed")
    sent = _cells(placed)
    sets = texts.join(broadcast_if_small(blocks.select("node")), F.col("id") == F.col("node"), "left_semi")
    sets = sets.select("id", "text").distinct().mapInArrow(emit, "node long, shingles array<long>")
    return sets.join(sent, "node").groupBy("i", "j").applyInPandas(cell, "a long, b long")
