"""Phrase collocations from exact counts of n-grams in counting quotient filters.

Words are counted by language first; only frequent ones get ids, as a frequent phrase has none but these. Texts are then written once more as blocks of
ids, 0 standing wherever a phrase can't go on (end of a piece, rare word), and phrases are counted level by level, from two words up. A task
permutes and packs the grams of its blocks and sums them in quotient filters, a filter for each shard of the permuted grams. A shard's filters are
merged, and what is frequent in it is a row of the level's table and a member of a filter in the shared folder. The next level counts a gram only
where that filter has both its parts. So no task holds more than a shard, common phrases meet as one counter a task, and nothing goes through the driver but numbers of shards.

The rest is joins of the frequent phrases with their own parts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import broadcast_if_small, materialize, scratch_path
from gradeloom.llm.quotient_filter import CountingQuotientFilter, Grams, collapse
from gradeloom.llm.shared_arrays import ShardStore, by_shard, write_arrays
from gradeloom.llm.textops import LOWER, chunks, utf8, word_ids, word_spans

#: Occurrences for which a shard of counts is meant, words of a vocabulary shard and phrases of a probed filter.
OCCURRENCES_PER_SHARD, WORDS_PER_SHARD, PHRASES_PER_SHARD = 1 << 22, 500_000, 1 << 20
MIN_SHARD_BITS = 8
#: Ids of a block, and keys that a task holds before it turns them into filters.
BLOCK_IDS, HELD_KEYS = 1 << 18, 1 << 21

_IS_MARK = np.zeros(256, bool)
_IS_MARK[[*b".,;:!?", 10, 11, 12, 13]] = True
_APART = _IS_MARK.copy()
_APART[[0x20, 0x09]] = True


class _Words:
    """The words of a chunk of documents: the distinct (language, word) pairs, the pair of each word, and where a piece begins."""

    def __init__(self, batch: pa.RecordBatch, text: str, lang: str):
        data, at = utf8(batch.column(text))
        data = LOWER[data]
        starts, ends, docs = word_spans(data, at, _APART)
        ids, words = word_ids(data, starts, ends, _APART)
        langs = batch.column(lang).dictionary_encode()
        lang_of = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(docs))
        self.place, pair = pd.factorize(lang_of * max(len(words), 1) + ids)
        self.langs = langs.dictionary.take(pa.array(pair // max(len(words), 1)))
        self.words = words.take(pa.array(pair % max(len(words), 1)))
        piece = np.cumsum(_IS_MARK[data], dtype=np.int64)[starts]
        self.begins = np.ones(len(starts), bool)
        self.begins[1:] = piece[1:] != piece[:-1]
        self.begins[docs[:-1][docs[:-1] < len(starts)]] = True

    def keys(self) -> np.ndarray:
        return _word_keys(self.langs.to_pylist(), self.words.to_pylist())


def _word_keys(langs: list[str], words: list[bytes]) -> np.ndarray:
    """128 bits for each word of a language, as pairs of 64."""
    heads = {x: struct.pack("<I", len(x.encode())) + x.encode() for x in set(langs)}
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(heads[x] + w) for x, w in zip(langs, words, strict=True)), "<u8").reshape(-1, 2)


def _count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words, and with a null word of each language's."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            found = _Words(batch, "text", "lang")
            counts = np.bincount(found.place, minlength=len(found.words))
            totals = pd.Series(counts, dtype=np.int64).groupby(np.array(found.langs.to_pylist(), object)).sum() if len(counts) else pd.Series([], dtype=np.int64)
            langs = pa.concat_arrays([found.langs.cast(pa.string()), pa.array(totals.index.tolist(), pa.string())])
            words = pa.concat_arrays([found.words.cast(pa.large_binary()), pa.nulls(len(totals), pa.large_binary())]).cast(pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([langs, words, pa.array(np.append(counts, totals.to_numpy()), pa.int64())], ["lang", "word", "n"])

    return docs.mapInArrow(emit, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Vocabulary:
    """Ids from 1 for words, by binary search in shards of their 128-bit keys; 0 for words that aren't there."""

    def __init__(self, root: str, offsets: list[int]):
        self.offsets = offsets
        self.store = ShardStore(root, lambda get: ((h := get("hi"), lo := get("lo")), h.nbytes + lo.nbytes))

    def ids(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        if not self.offsets:
            return out
        for k, mine in by_shard((keys[:, 0] % np.uint64(len(self.offsets))).astype(np.int64)):
            hi, lo = self.store.shard(k)
            wanted = keys[mine]
            at = np.searchsorted(hi, wanted[:, 0])
            while len(mine):
                inside = at < len(hi)
                inside[inside] = hi[at[inside]] == wanted[inside, 0]
                mine, at, wanted = mine[inside], at[inside], wanted[inside]
                hit = lo[at] == wanted[:, 1]
                out[mine[hit]] = at[hit] + 1 + self.offsets[k]
                mine, at, wanted = mine[~hit], at[~hit] + 1, wanted[~hit]
        return out


def _index_words(vocabulary: DataFrame, root: str) -> tuple[DataFrame, _Vocabulary]:
    """Ids for the rows of (lang, word, n), as a table with column ``id`` and as shards in ``root``."""
    n_shards = -(-vocabulary.count() // WORDS_PER_SHARD)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _word_keys(batch.column("lang").to_pylist(), batch.column("word").cast(pa.binary()).to_pylist())
            shard = (keys[:, 0] % np.uint64(n_shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64))], [*batch.schema.names, "shard", "hi", "lo"])

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        hi, lo = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("hi", "lo"))
        order = np.lexsort((lo, hi))
        write_arrays(f"{root}/{int(pdf['shard'].iloc[0]):06d}", {"hi": hi[order], "lo": lo[order]})
        return pdf.iloc[order].assign(place=np.arange(len(pdf), dtype=np.int64))[["shard", "place", "lang", "word", "n"]]

    if not n_shards:
        return vocabulary.withColumn("id", F.lit(0).cast("long")), _Vocabulary(root, [])
    words = vocabulary.mapInArrow(keyed, "lang string, word string, n long, shard int, hi long, lo long").groupBy("shard").applyInPandas(write, "shard int, place long, lang string, word string, n long")
    words = materialize(words, "words")
    sizes = {r["shard"]: r["n"] for r in words.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets = [0, *np.cumsum([sizes.get(k, 0) for k in range(n_shards)]).tolist()][:-1]
    first = broadcast_if_small(words.sparkSession.createDataFrame(list(enumerate(offsets)), "shard int, first long"))
    return words.join(first, "shard").select("lang", "word", "n", (F.col("first") + F.col("place") + 1).alias("id")), _Vocabulary(root, offsets)


def _as_ids(docs: DataFrame, vocabulary: _Vocabulary, wide: bool) -> DataFrame:
    """Blocks (ids binary) of the words' ids, with 0 wherever no phrase goes on."""
    kind = np.uint64 if wide else np.uint32

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chunks(batches, "text"):
            found = _Words(batch, "text", "lang")
            if not len(found.place):
                continue
            own = vocabulary.ids(found.keys())[found.place]
            out = np.zeros(len(own) + int(found.begins.sum()), kind)
            out[np.arange(len(own)) + np.cumsum(found.begins)] = own
            keep = out != 0
            keep[1:] |= out[:-1] != 0
            held.append(out[keep])
            size += int(keep.sum())
            if size >= BLOCK_IDS:
                yield _block(held)
                held, size = [], 0
        if held:
            yield _block(held)

    return docs.mapInArrow(emit, "ids binary")


def _block(held: list[np.ndarray]) -> pa.RecordBatch:
    # texts end with a 0, as the first word of each begins a piece
    return pa.RecordBatch.from_arrays([pa.array([np.append(np.concatenate(held), held[0].dtype.type(0)).tobytes()], pa.binary())], ["ids"])


class _Frequent:
    """The filters of a level's frequent grams in the shared folder."""

    def __init__(self, root: str, grams: Grams, shard_bits: int, shards: frozenset[int]):
        self.grams, self.shard_bits, self.shards = grams, shard_bits, shards
        self.store = ShardStore(root, lambda get: ((f := CountingQuotientFilter.of_arrays(get)), 3 * f.nbytes() + 8 * len(f.counters)))

    def has(self, limbs: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(limbs[0]), bool)
        for k, mine in by_shard(self.grams.shard(limbs, self.shard_bits)):
            if k in self.shards:
                out[mine] = self.store.shard(k).has([x[mine] for x in limbs])
        return out


def _grams_in(ids: np.ndarray, n: int, bits: int, parts: _Frequent | None) -> list[np.ndarray]:
    """Limbs of the grams of ``n`` ids that can be frequent, once for each time they occur."""
    if len(ids) < n:
        return Grams(n, bits).pack([np.zeros(0, np.uint64)] * n)
    size = len(ids) - n + 1
    good = reduce(np.logical_and, (ids[k : k + size] != 0 for k in range(n)))
    if parts is not None:
        # both parts are frequent: each place is looked up once, as a first or as a second part
        asked = np.zeros(size + 1, bool)
        asked[:-1] |= good
        asked[1:] |= good
        at = np.flatnonzero(asked)
        asked[at] = parts.has(parts.grams.pack([ids[at + k] for k in range(n - 1)]))
        good &= asked[:-1] & asked[1:]
    at = np.flatnonzero(good)
    return Grams(n, bits).pack([ids[at + k] for k in range(n)])


def _count_level(blocks: DataFrame, n: int, bits: int, shard_bits: int, parts: _Frequent | None, min_count: int, wide: bool) -> DataFrame:
    """(k0, k1, ..., a): the permuted grams of ``n`` words that occur ``min_count`` times or more."""
    grams, kind = Grams(n, bits), np.uint64 if wide else np.uint32
    shard_bits = min(shard_bits, grams.widths[0])
    names = [f"k{i}" for i in range(len(grams.widths))]

    def filters(limbs: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        shards, rows = [], []
        for k, mine in by_shard(grams.shard(limbs, shard_bits)):
            shards.append(k)
            rows.append(CountingQuotientFilter.build(grams, [x[mine] for x in limbs], counts[mine], shard_bits).dump())
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(rows, pa.binary())], ["shard", "filter"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Sums(HELD_KEYS)
        for batch in batches:
            for raw in batch.column("ids"):
                held.add(*collapse(_grams_in(np.frombuffer(raw.as_buffer(), kind), n, bits, parts)))
                if held.size > HELD_KEYS // 2 and held.full():
                    yield filters(*held.take())
        if held.size:
            yield filters(*held.take())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = _Sums(1 << 62), None

        def frequent() -> pa.RecordBatch:
            limbs, counts = held.take()
            keep = counts >= min_count
            return pa.RecordBatch.from_arrays([*(pa.array(x[keep].view(np.int64)) for x in limbs), pa.array(counts[keep], pa.int64())], [*names, "a"])

        for batch in batches:
            for k, raw in zip(batch.column("shard").to_pylist(), batch.column("filter"), strict=True):
                if k != shard and shard is not None:
                    yield frequent()
                shard = k
                held.add(*CountingQuotientFilter.parse(raw.as_buffer().to_pybytes()).keys())
        if shard is not None:
            yield frequent()

    found = blocks.mapInArrow(count, "shard long, filter binary").repartition("shard").sortWithinPartitions("shard")
    return found.mapInArrow(merge, ", ".join(f"{c} long" for c in [*names, "a"]))


class _Sums:
    """Counted keys in order; parts are merged when they are together as large as what is merged already."""

    def __init__(self, most: int):
        self.most, self.parts, self.size, self.merged = most, [], 0, 0

    def add(self, limbs: list[np.ndarray], counts: np.ndarray) -> None:
        if len(counts):
            self.parts.append((limbs, counts))
            self.size += len(counts)
            if self.size > max(2 * self.merged, 1 << 18):
                self._merge()

    def _merge(self) -> None:
        if len(self.parts) > 1:
            both = collapse([np.concatenate(x) for x in zip(*(p[0] for p in self.parts), strict=True)], np.concatenate([p[1] for p in self.parts]))
            self.parts, self.size = [both], len(both[1])
        self.merged = self.size

    def full(self) -> bool:
        self._merge()
        return self.size > self.most // 2

    def take(self) -> tuple[list[np.ndarray], np.ndarray]:
        self._merge()
        out = self.parts[0]
        self.parts, self.size, self.merged = [], 0, 0
        return out


def _write_frequent(level: DataFrame, grams: Grams, root: str) -> _Frequent:
    """Filters of the grams of a level's table, for probing."""
    width = grams.widths[0]
    shard_bits = min(max(0, (level.count() // PHRASES_PER_SHARD).bit_length()), width)
    names = [f"k{i}" for i in range(len(grams.widths))]

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        limbs, counts = collapse([pdf[c].to_numpy(np.int64).view(np.uint64) for c in names], pdf["a"].to_numpy(np.int64))
        built = CountingQuotientFilter.build(grams, limbs, counts, shard_bits)
        write_arrays(f"{root}/{built.shard:06d}", built.arrays())
        return pd.DataFrame({"shard": [built.shard]}, dtype=np.int64)

    shard = F.shiftrightunsigned("k0", width - shard_bits) if shard_bits else F.lit(0).cast("long")
    shards = level.withColumn("shard", shard).groupBy("shard").applyInPandas(write, "shard long").collect()
    return _Frequent(root, grams, shard_bits, frozenset(r["shard"] for r in shards))


def _as_phrases(level: DataFrame, grams: Grams) -> DataFrame:
    """(ids array<long>, a): the permutation is taken back."""
    names = [f"k{i}" for i in range(len(grams.widths))]

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = grams.unpack([batch.column(c).to_numpy().view(np.uint64) for c in names])
            flat = pa.array(np.stack(words, 1).reshape(-1).astype(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * grams.n, pa.int32()), flat), batch.column("a")], ["ids", "a"])

    return level.mapInArrow(back, "ids array<long>, a long")


def frequent_phrases(docs: DataFrame, max_words: int = 5, min_count: int = 100, *, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases (ids, a) of 2 to ``max_words`` words, words (lang, word, n, id), totals (lang, n)), all with exact counts of ``min_count`` or more
    (totals: of all words of a language). Nulls and empty tables as in ``mine_phrases``."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    counted = _count_words(docs)
    counted = materialize(counted.filter(F.col("word").isNull() | (F.col("n") >= min_count)), "word-counts")
    totals = counted.filter("word is null").select("lang", "n")
    words, vocabulary = _index_words(counted.filter("word is not null"), scratch_path(spark, "vocabulary"))
    n_words, occurrences = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    wide, bits = n_words >= 1 << 32, max(1, n_words.bit_length())
    shard_bits = max(MIN_SHARD_BITS, (occurrences // OCCURRENCES_PER_SHARD).bit_length())
    blocks = materialize(_as_ids(docs, vocabulary, wide), "blocks")
    phrases, parts = spark.createDataFrame([], "ids array<long>, a long"), None
    for n in range(2, max_words + 1):
        grams = Grams(n, bits)
        level = materialize(_count_level(blocks, n, bits, shard_bits, parts, min_count, wide), f"phrases-{n}")
        phrases = phrases.unionByName(_as_phrases(level, grams))
        if n < max_words:
            parts = _write_frequent(level, grams, scratch_path(spark, f"filter-{n}"))
            if not parts.shards:
                break
    return materialize(phrases, "phrases"), words, totals


def mine_phrases(docs: DataFrame, max_words: int = 5, min_count: int = 100, cover_percent: int = 100, per_lang: int = 2000, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """The best collocations of each language: (lang, rank, phrase, a, l, r, n, score).

    Texts are lower-cased (A-Z) and split into pieces at ``.,;:!?`` and line ends, pieces into words at blanks and tabs. A phrase is 2 to ``max_words`` words of
    one piece that occur ``min_count`` times or more together, overlaps included (``a``). Its score is 1000 a n / (l r), rounded down, for the counts ``l`` and ``r`` of its
    two parts at the cut that makes it lowest (the first such cut on ties) and ``n`` words in the language. A phrase is left out where a longer one holds it and
    occurs ``cover_percent`` per cent as often or more. Ranks go by score, ``a`` (both falling) and the phrase's bytes, as far as ``per_lang``.

    A null text has no words; a null language counts as ``und``; repeated rows count again; other columns aren't looked at; an empty table gives no rows.
    """
    phrases, words, totals = frequent_phrases(docs, max_words, min_count, text=text, lang=lang)
    known = phrases.select("ids", F.col("a").alias("f")).unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("f")))
    size = F.size("ids")
    # f never falls from a phrase to its parts, so it is enough to look at those that are one word longer
    inner = F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))
    covering = phrases.filter(size > 2).select(F.explode(inner).alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    own = phrases.join(covering, "ids", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < cover_percent * F.col("a"))).drop("longer")
    cuts = own.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr("slice(ids, k + 1, size(ids) - k)"))
    cuts = cuts.join(known.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    langs = words.select("id", "lang").join(totals.withColumnRenamed("n", "all"), "lang")
    cuts = cuts.withColumn("id", F.element_at("ids", 1)).join(langs, "id")
    exact = "(cast(1000 as decimal(4,0)) * (cast(a as decimal(19,0)) * cast(all as decimal(19,0)))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    best = cuts.groupBy("ids", "a", "lang", "all").agg(F.min(F.struct(F.expr(exact).alias("score"), "k", "l", "r")).alias("cut"))
    scored = best.select("ids", "lang", "a", "cut.l", "cut.r", F.col("all").alias("n"), "cut.score")
    order = [F.desc("score"), F.desc("a")]
    # words are looked up for what can still be among the first
    first = scored.withColumn("_rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("_rank") <= per_lang).drop("_rank")
    first = materialize(first, "best-phrases")
    spelled = first.select("ids", F.posexplode("ids").alias("p", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first.join(spelled, "ids").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long"))
    return ranked.filter(F.col("rank") <= per_lang).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
