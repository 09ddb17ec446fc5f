"""Mixing sources to target weights by capped water-filling and seeded sampling.

Targets: the token budget is shared by weight; a source whose share exceeds ``max_epochs`` times its size
is clamped there and the excess goes to the others by weight, until nothing is above its cap. That fixed
point has a closed form over the sources sorted by cap / weight, so a few windows over the table of sources
(one row each) find it.

Sampling: a source of size S with target T is taken floor(T / S) whole times. The fractional repetition takes
documents in the order of a seeded hash while they fit into T - floor(T / S) * S. A document that doesn't fit is left out, and the
order is followed from there in further rounds, with documents no larger than what is still missing; then up to ``fillers``
further documents come in, each the one whose size is nearest to what is missing, if taking it comes nearer than leaving it out.
The place of a cut is found from sums over 4096 ranges of the hash, so no task sees more of a hot source than one range of
it. Behind the first cut only documents of less than twice what is missing are looked at again. A source misses its target by less than the
largest document that it holds, and where all that are left are larger than what is missing, by half the smallest of these at most. Texts are never
shuffled: the decision is a comparison of the document's own hash (and where large documents are left out, its size) with its source's cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import broadcast_if_small, fits_broadcast, materialize, n_words, unused_name

_RANGE_BITS = 12
#: Rounds of the fractional repetition; each goes on behind a document that was too large.
ROUNDS = 3
_LAST = (1 << 63) - 1


def water_fill(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Add ``target`` to a table (source, source_size) with one row a source.

    Weights go to the sources in code point order, null last, and repeat. A source without words gets 0. An
    empty table stays empty.
    """
    everything = Window.partitionBy()
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_ratio = everything.orderBy(F.col("_ratio"), F.col("_rank"))
    ranked = (
        sources.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("_weight", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
        .withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(budget_ratio)))
        .withColumn("_clamped", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_share", (F.col("_budget") - F.col("_clamped")) / F.col("_open"))
        .withColumn("_full", F.col("_ratio") <= F.col("_share"))
        .withColumn("_level", F.min(F.when(~F.col("_full"), F.struct("_ratio", "_rank", "_share"))).over(everything)["_share"])
    )
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_level"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 17, fillers: int = 2, *, source: str = "source", text: str = "text", key: str = "doc_id", size: Column | None = None) -> DataFrame:
    """``docs`` with four more columns: ``mix_size`` (words, or ``size``), ``mix_source_size``, ``mix_target`` and
    ``mix_copies`` (int: how often the mix takes the document, 0 to ceil(max_epochs)).

    Null texts have size 0; a null source is a source of its own. Rows that agree in key and text are taken
    alike, since the seeded hash covers both; ``text`` may name any column that tells texts apart, such as a hash, where
    ``size`` is given. A source whose target is a whole multiple of its size has no further copies, so no document, an
    empty one neither, is taken more than ceil(max_epochs) times. Columns of ``docs`` with one of the four names are replaced;
    other columns may have any name. An empty table gives an empty result. Reruns agree.
    """
    out = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    docs = docs.drop(*out)
    u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text), F.lit(seed)), 1)
    words = (n_words(F.col(text)) if size is None else size).cast("long")
    units = materialize(docs.select(F.col(source).alias("source"), u.alias("u"), words.alias("size")).groupBy("source", "u").agg(F.sum("size").alias("size"), F.max("size").alias("one")), "mix-units")
    targets = water_fill(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget_ratio, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    plan = materialize(targets.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    split = plan.filter("part > 0")
    # all tables below have a row a source and at most ROUNDS cuts in it, so one check of their size is enough
    few = fits_broadcast(plan, max_rows=20_000, max_bytes=8 << 20)
    hinted = F.broadcast if few else (lambda df: df)

    def by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "_s")
        return left.join(right, left["source"].eqNullSafe(right["_s"]), how).drop("_s")

    def next_cut(units: DataFrame, cuts: DataFrame) -> DataFrame:
        """One round: (source, low, missing, taken) with the cut behind ``low`` added to ``taken`` and less missing."""
        range_ = F.shiftright("u", 63 - _RANGE_BITS)
        left = by_source(units, hinted(cuts)).filter(F.col("u") > F.col("low"))
        sums = left.groupBy("source", range_.alias("range")).agg(F.sum(F.when(F.col("one") <= F.col("missing"), F.col("size")).otherwise(0)).alias("size"), F.max("one").alias("largest"), F.first("missing").alias("missing"))
        before = F.sum("size").over(Window.partitionBy("source").orderBy("range")) - F.col("size")
        crossed = (F.col("before") <= F.col("missing")) & (F.col("before") + F.col("size") > F.col("missing"))
        at = F.max(F.when(crossed, F.struct("range", "before"))).alias("at")
        found = sums.withColumn("before", before).groupBy("source").agg(at, F.sum("size").alias("total"), F.max("largest").alias("largest"))
        state = materialize(by_source(cuts, found, "left"), "mix-state")
        inside = by_source(units, hinted(state.filter("at is not null").drop("taken")))
        inside = inside.filter((range_ == F.col("at.range")) & (F.col("u") > F.col("low")) & (F.col("one") <= F.col("missing")))
        upto = F.col("at.before") + F.sum("size").over(Window.partitionBy("source").orderBy("u"))
        fits = inside.withColumn("upto", upto).filter(F.col("upto") <= F.col("missing")).groupBy("source").agg(F.max("u").alias("u_in"), F.max("upto").alias("upto"))
        # before the first document of the range where none of it fits; behind all where all fit
        cut = F.when(F.col("at").isNull(), F.lit(_LAST)).otherwise(F.coalesce("u_in", F.greatest("low", F.shiftleft("at.range", 63 - _RANGE_BITS) - 1)))
        gone = F.when(F.col("at").isNull(), F.coalesce("total", F.lit(0))).otherwise(F.coalesce("upto", "at.before"))
        # later rounds don't see the largest documents at all, so they always have a limit
        limit = F.col("missing") if units is rest else F.when(F.col("largest") > F.col("missing"), F.col("missing"))
        now = F.struct(F.col("low"), cut.alias("cut"), limit.alias("limit"))
        return materialize(by_source(state, fits, "left").select("source", cut.alias("low"), (F.col("missing") - gone).alias("missing"), F.array_append("taken", now).alias("taken")), "mix-cuts")

    none = F.expr("cast(array() as array<struct<low:bigint,cut:bigint,limit:double>>)")
    cuts = materialize(split.select("source", F.lit(-1).cast("long").alias("low"), F.col("part").alias("missing"), none.alias("taken")), "mix-cuts")
    rest = None
    for k in range(ROUNDS):
        open_ = cuts.filter((F.col("missing") > 0) & (F.col("low") < _LAST))
        done = cuts.filter((F.col("missing") <= 0) | (F.col("low") >= _LAST))
        if open_.isEmpty():
            break
        cuts = done.unionByName(next_cut(units if rest is None else rest, open_))
        if k == 0:
            # what may still come in: less than twice what is missing, and behind the first cut
            rest = by_source(units, hinted(cuts.select("source", "low", "missing"))).filter((F.col("u") > F.col("low")) & (F.col("one") < 2 * F.col("missing")))
            rest = materialize(rest.select("source", "u", "size", "one"), "mix-rest")
    cuts = cuts.withColumn("fillers", F.expr("cast(array() as array<bigint>)"))
    for _ in range(fillers):
        off = F.abs(F.col("size") - F.col("missing"))
        left = by_source(units if rest is None else rest, hinted(cuts)).filter((F.col("u") > F.col("low")) & (off < F.col("missing")) & ~F.array_contains("fillers", F.col("u")))
        best = left.groupBy("source").agg(F.min(F.struct(off.alias("off"), "u", "size")).alias("best"))
        added = F.when(F.col("best").isNull(), F.col("fillers")).otherwise(F.array_append("fillers", F.col("best.u")))
        cuts = by_source(cuts, best, "left").select("source", "low", "taken", (F.col("missing") - F.coalesce("best.size", F.lit(0))).alias("missing"), added.alias("fillers"))
        cuts = materialize(cuts, "mix-cuts")
    plan = materialize(by_source(plan, cuts, "left"), "mix-plan")
    mix_key, mix, mix_u = (unused_name(docs, c) for c in ("mix_key", "mix", "mix_u"))
    plan = plan.select(F.col("source").alias(mix_key), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.struct("whole", "taken", "fillers").alias(mix))
    # left, then filled in: a source in docs always has a row in the plan
    taken = docs.withColumn(mix_u, u).join(broadcast_if_small(plan), F.col(source).eqNullSafe(F.col(mix_key)), "left")
    # a text's words are counted here only where its source leaves large documents out
    inside = F.exists(F.col(mix)["taken"], lambda r: (F.col(mix_u) > r["low"]) & (F.col(mix_u) <= r["cut"]) & (r["limit"].isNull() | (words <= r["limit"])))
    extra = (inside | F.array_contains(F.col(mix)["fillers"], F.col(mix_u))).cast("int")
    copies = F.col(mix)["whole"] + F.coalesce(extra, F.lit(0))
    return taken.select(*docs.columns, words.alias("mix_size"), "mix_source_size", "mix_target", copies.alias("mix_copies"))


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as ``mix_copies`` says, without the columns that mix_sources added.

    Rows with a null ``mix_copies`` or none are left out, repeated rows count each for itself, an empty table stays empty, and
    other columns may have any name.
    """
    number = unused_name(mixed, "mix_n")
    rows = mixed.filter("mix_copies > 0").withColumn(number, F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return rows.drop(number, "mix_size", "mix_source_size", "mix_target", "mix_copies")
