"""Preparing prompt tables: filters, splits, mixing, row shapes and joins. Row order is an explicit column, ``ord`` by default."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.order import last_known, number_rows, range_bucket

#: Rows with neighbouring values of an ``ord`` column go to one bucket of global numbering.
BUCKET_ROWS = 100_000


def hash_order(key: str, seed: int) -> Column:
    """A seeded order that other engines can repeat: md5 of ``seed:key``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


# ---- filters and columns


def non_empty(df: DataFrame, question: str, rubrics: str) -> DataFrame:
    return df.filter((F.length(F.trim(F.coalesce(question, F.lit("")))) > 0) & (F.size(rubrics) > 0))


def skip_reasons(df: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """``skip_reason``: the name of the first test that a row fails (a test is true for good rows), or null."""
    reason = None
    for name, good in tests.items():
        reason = F.when(~F.coalesce(good, F.lit(False)), name) if reason is None else reason.when(~F.coalesce(good, F.lit(False)), name)
    return df.withColumn("skip_reason", reason)


def within_length(df: DataFrame, text: str, max_tokens: int, tokenizer=None) -> DataFrame:
    """Rows whose text has at most ``max_tokens`` tokens; rows that can't be counted go.

    ``tokenizer`` maps a column to its number of tokens; words and signs by default.
    """
    count = tokenizer or (lambda c: F.size(F.regexp_extract_all(c, F.lit(r"\w+|[^\w\s]"), 0)))
    n = F.when(F.col(text).isNotNull(), count(F.col(text)))
    return df.filter(n <= max_tokens)


def stable_bucket(key: Column, seed: int = 42) -> Column:
    """0 to 99 from the first 8 hex digits of md5 of ``seed:key``."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 8), 16, 10).cast("long") % 100).cast("int")


def split_held_out(df: DataFrame, key: str, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """``held_out``: whether the key's bucket is below 100 ratio; all rows of a key are on one side."""
    return df.withColumn("held_out", stable_bucket(F.col(key).cast("string"), seed) < int(ratio * 100))


def id_or_hash(id_: Column, question: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(id_), F.lit("")), F.md5(question))


def by_winner(df: DataFrame, a: str, b: str, winner: str, a_name: str, b_name: str) -> DataFrame:
    """``chosen`` and ``rejected`` from two answers and the winner's name; rows with another winner go."""
    is_a = F.col(winner) == a_name
    return df.filter(F.col(winner).isin(a_name, b_name)).withColumn("chosen", F.when(is_a, F.col(a)).otherwise(F.col(b))).withColumn("rejected", F.when(is_a, F.col(b)).otherwise(F.col(a)))


def preferred_pairs(df: DataFrame) -> DataFrame:
    """(prompt, chosen, rejected, subset) from conversation, two responses, preferred_index and category_path.

    The prompt is the last user turn, the subset the second part of the path; rows without two responses or a usable index go.
    """
    turns = F.filter("conversation", lambda m: m["role"] == "user")
    good = df.filter((F.size("responses") == 2) & F.col("preferred_index").isin(0, 1) & (F.size(turns) > 0))
    answer = lambda i: F.get(F.col("responses"), i)["answer"]
    parts = F.split("category_path", "/")
    return good.select(F.element_at(turns, -1)["content"].alias("prompt"), answer(F.col("preferred_index")).alias("chosen"), answer(1 - F.col("preferred_index")).alias("rejected"), F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))).alias("subset"))


def rows_at(df: DataFrame, wanted: DataFrame, order: str = "ord") -> DataFrame:
    """The rows whose ``order`` is in column ``idx`` of ``wanted``, once for each time it is there."""
    return df.join(wanted.select(F.col("idx").alias(order)), order)


def rows_slice(df: DataFrame, start: int, stop: int, step: int = 1, order: str = "ord") -> DataFrame:
    return df.filter((F.col(order) >= start) & (F.col(order) < stop) & ((F.col(order) - start) % step == 0))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def pop(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(popped columns with the keys, the rest)."""
    return df.select(*keys, *columns), df.drop(*columns)


def sampled_steps(df: DataFrame, step: str = "step") -> DataFrame:
    """Every 100th step, and every 20th from 800; the last 10 steps where that leaves none."""
    s = F.col(step)
    marked = df.withColumn("_hit", (s % 100 == 0) | ((s >= 800) & (s % 20 == 0)))
    steps = marked.groupBy(step).agg(F.first("_hit").alias("_hit"))
    last = Window.orderBy(F.desc(step))
    chosen = steps.withColumn("_any", F.max("_hit").over(Window.partitionBy())).withColumn("_r", F.row_number().over(last)).filter(F.col("_hit") | (~F.col("_any") & (F.col("_r") <= 10)))
    return df.join(chosen.select(step), step, "left_semi")


# ---- sampling


def upsample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows: whole copies of all, then the first rows in hash order; fewer than there are rows cut down. Empty stays empty."""
    order = hash_order(key, seed)
    ranked = number_rows(df, [order, key], F.substring(order, 1, 3), "_rank", "_count")
    copies = F.floor(F.lit(n) / F.col("_count")) + (F.col("_rank") < F.lit(n) % F.col("_count")).cast("int")
    return _copied(ranked, copies).drop("_rank", "_count")


def seeded_shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(key, seed), key)


def random_subset(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return seeded_shuffle(df, key, seed).limit(n)


def priority_sample(df: DataFrame, n: int, first: Column, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows: those for which ``first`` holds before the others, each part in hash order."""
    return df.orderBy((~F.coalesce(first, F.lit(False))).cast("int"), hash_order(key, seed), key).limit(n)


def sparse_subset(df: DataFrame, k: int, by: Sequence[str], item: str, always: Column | None = None, seed: int = 42) -> DataFrame:
    """At most ``k`` items in each group, by a hash of the group and the item; rows for which ``always`` holds stay besides.

    k = 0, or a group that has no more than k items, keeps all.
    """
    keep = F.lit(False) if always is None else F.coalesce(always, F.lit(False))
    if k <= 0:
        return df
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, item]]))
    rank = F.sum((~keep).cast("int")).over(Window.partitionBy(*by).orderBy(order, item).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_keep", keep).withColumn("_rank", rank).filter(F.col("_keep") | (F.col("_rank") <= k)).drop("_keep", "_rank")


def best_rows(df: DataFrame, by: Sequence[str], score: str, order: str, n: int = 1) -> DataFrame:
    """The ``n`` rows with the highest score in each group; ``order`` breaks ties."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), order))).filter(F.col("_r") <= n).drop("_r")


#: Children of a node of the tree that ``resample`` goes down.
FANOUT = 1000
_WHOLE = "decimal(38,0)"


def resample(df: DataFrame, n: int, score: str, method: str = "pow", power: float = 2.0, key: str = "ord", seed: int = 42, fanout: int = FANOUT) -> DataFrame:
    """``n`` rows drawn with replacement (``draw`` 0 .. n - 1) with weights |score|^power (pow), 1 at the extremes (max_min) or 0.4 / 0.1 (max_random).

    Inversion level by level: rows go to blocks of ``fanout`` neighbouring keys, blocks to blocks of blocks, each with the sum of its weights. A draw is a seeded hash of
    its number, a point in the sum of all; it goes down the levels, at each to the one child whose stretch holds it, which it finds in the sorted list of its
    node's children. So the work is rows and draws, not their product, and a node that draws most is met by joins that can be split. Weights are whole
    numbers of 2^-30 of the largest (at least 1), so sums are exact in any order and the draws are those of one long list in the order of ``key``,
    a whole number without repeats or nulls.
    """
    weight = {"pow": F.pow(F.abs(F.col(score)), power), "max_min": F.when((F.col(score) == F.col("_top")) | (F.col(score) == F.col("_low")), 1.0).otherwise(0.0), "max_random": F.when(F.col(score) == F.col("_top"), 0.4).otherwise(0.1)}[method]
    ends = df.agg(F.max(score).alias("_top"), F.min(score).alias("_low"), F.max(F.pow(F.abs(F.col(score)), power)).alias("_most"), F.min(key).alias("_first"), F.max(key).alias("_last"))
    first, last = ends.select("_first", "_last").first()
    if first is None:
        return df.withColumn("draw", F.lit(0).cast("long")).limit(0)
    largest = {"pow": F.col("_most"), "max_min": F.lit(1.0), "max_random": F.lit(0.4)}[method]
    units = F.coalesce(F.round(weight / F.nullif(largest, F.lit(0.0)) * float(1 << 30)), F.lit(0.0))
    # one row of extremes beside each row
    rows = df.crossJoin(F.broadcast(ends.select("_top", "_low", "_most"))).select((F.col(key).cast("long") - first).alias("_child"), F.greatest(units.cast(_WHOLE), F.lit(1).cast(_WHOLE)).alias("_w"))
    levels = [rows]
    size = last - first + 1
    while (size := -(-size // fanout)) > 1:
        levels.append(levels[-1].groupBy(F.floor(F.col("_child") / fanout).alias("_child")).agg(F.sum("_w").cast(_WHOLE).alias("_w")))
    whole = levels[-1].agg(F.sum("_w").cast(_WHOLE).alias("_all"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("decimal(15,0)")
    point = (hashed * F.col("_all")).cast(_WHOLE)
    draws = df.sparkSession.range(n).crossJoin(F.broadcast(whole)).select(F.col("id").alias("draw"), ((point - point % 16**12) / 16**12).cast(_WHOLE).alias("_u"), F.lit(0).cast("long").alias("_node"))
    for level in reversed(levels):
        draws = _descend(draws, level.withColumn("_node", F.floor(F.col("_child") / fanout)), fanout)
    return draws.select("draw", "_node").join(df, F.col("_node") + first == F.col(key)).drop("_node")


def _descend(draws: DataFrame, children: DataFrame, fanout: int) -> DataFrame:
    """Each draw (draw, _u, _node) at the child of its node whose stretch holds ``_u``, with the rest of ``_u`` in that stretch."""
    ahead = F.coalesce(F.sum("_w").over(Window.partitionBy("_node").orderBy("_child").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(_WHOLE)
    lists = children.select("_node", F.struct(ahead.alias("ahead"), F.col("_child").alias("child")).alias("c")).groupBy("_node").agg(F.sort_array(F.collect_list("c")).alias("_list"))
    start = F.struct(F.lit(1).alias("lo"), F.size("_list").alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"] + 1) / 2).cast("int")
        right = F.get(F.col("_list"), middle - 1)["ahead"] <= F.col("_u")
        return F.struct(F.when(right, middle).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(middle - 1).alias("hi"))

    place = F.aggregate(F.sequence(F.lit(1), F.lit(fanout.bit_length())), start, halve, lambda acc: acc["lo"])
    met = draws.join(lists, "_node").withColumn("_c", F.element_at("_list", place))
    return met.select("draw", (F.col("_u") - F.col("_c.ahead")).cast(_WHOLE).alias("_u"), F.col("_c.child").alias("_node"))


def shuffled_positions(df: DataFrame, by: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """``shuffled_pos`` from 0 in each group; ordering by ``key`` restores the old order exactly."""
    return df.withColumn("shuffled_pos", F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(key, seed), key)) - 1)


def reorder(df: DataFrame, permutation: DataFrame, order: str = "ord") -> DataFrame:
    """Row ``old`` of ``permutation`` (old, new) gets place ``new``; swap the two columns for the inverse."""
    return df.join(permutation.select(F.col("old").alias(order), "new"), order).drop(order).withColumnRenamed("new", order)


def workload(length: Column) -> Column:
    return F.lit(24576.0) * length + length * length


def snake_partitions(df: DataFrame, n: int, length: str, key: str) -> DataFrame:
    """``part`` 0 .. n - 1: rows by falling workload dealt forth and back, so parts have equal counts (within one) and close sums."""
    ranked = number_rows(df, [F.desc(workload(F.col(length))), key], range_bucket(df, [-workload(F.col(length)), F.col(key)]), "_r")
    lap, place = F.floor(F.col("_r") / n), F.col("_r") % n
    return ranked.withColumn("part", F.when(lap % 2 == 0, place).otherwise(n - 1 - place).cast("int")).drop("_r")


#: Rows of a cell of ``balanced_partitions``, bundles that a cell keeps for each part, cells that one task merges, and batches of a cell of ``token_budget_partitions``.
CELL_ROWS, BUNDLES_PER_PART, MERGED_CELLS, CELL_BATCHES = 200_000, 32, 64, 64
#: Sums in the states with which ``differencing`` may begin.
STATE_ENTRIES = 4 << 20


def differencing(loads, n: int):
    """Part of each load, by largest differencing over arrays: ``largest_differencing`` for many loads.

    States of ``n`` sums begin with one load each (or, where these would have more than STATE_ENTRIES sums, with ``n`` neighbours in load order). The two states with
    the widest spreads become one, the heaviest sum of one on the lightest of the other, until one is left; then its places are handed down to the states that it came from.
    """
    import heapq

    import numpy as np

    loads = np.asarray(loads, float)
    order = np.argsort(-loads, kind="stable")
    width = 1 if len(loads) * n <= STATE_ENTRIES else n
    first = -(-len(loads) // width)
    states = np.zeros((first, n))
    states[:, :width] = np.append(loads[order], np.zeros(first * width - len(loads))).reshape(-1, width)
    heap = list(zip((states[:, -1] - states[:, 0]).tolist(), range(first), states, strict=True))
    heapq.heapify(heap)
    merged = []
    while len(heap) > 1:
        (_, i, a), (_, j, b) = heapq.heappop(heap), heapq.heappop(heap)
        joined = a + b[::-1]
        falling = np.argsort(-joined, kind="stable")
        merged.append((i, j, falling))
        joined = joined[falling]
        heapq.heappush(heap, (joined[-1] - joined[0], first + len(merged) - 1, joined))
    # the part of each place of each state, from the last state back to the first ones
    parts = np.empty((first + len(merged), n), np.int32)
    parts[-1:] = np.arange(n)
    for k, (i, j, falling) in reversed(list(enumerate(merged, first))):
        at = np.empty(n, np.int32)
        at[falling] = parts[k]
        parts[i], parts[j] = at, at[::-1]
    out = np.empty(len(loads), np.int32)
    out[order] = parts[:first, :width].reshape(-1)[: len(loads)]
    return out


def balanced_partitions(df: DataFrame, n: int, length: str, key: str, cell_rows: int | None = None) -> DataFrame:
    """``part`` 0 .. n - 1 with sums of workloads as even as differencing makes them, for tables of any size.

    Rows go by a hash of ``key`` to cells of about ``cell_rows``. A cell is dealt by ``differencing`` to BUNDLES_PER_PART bundles for each part, of which a very heavy row has one
    to itself. Bundles are loads again: those of MERGED_CELLS cells are dealt to as many bundles as one cell has, level by level, and the last ones to the n parts. A
    row's part follows from its bundle through the levels' tables, which have a row a bundle. Nulls count as length 0. Deterministic for unique keys.
    """
    import pandas as pd

    n_cells = max(1, -(-df.count() // (cell_rows or CELL_ROWS)))
    bundles = n * BUNDLES_PER_PART
    cell = F.expr(f"cast(pmod(xxhash64({_quoted(key)}), {n_cells}) as long)")

    def dealt(rows: DataFrame, out: str, parts: int) -> DataFrame:
        return _dealt(rows.withColumn("_cell", cell), "_cell", out, length, key, lambda _: parts)

    if n_cells == 1:
        return dealt(df.drop("part"), "part", n).drop("_cell")

    def merge(parts: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["_cell", "_bundle"])
            return pdf.assign(next=differencing(pdf["load"], parts))

        return run

    load = workload(F.coalesce(F.col(length), F.lit(0)).cast("double"))
    # one pass over two columns gives the cells' bundles; the levels above are small tables
    loads = dealt(df.select(key, length), "_bundle", bundles).groupBy("_cell", "_bundle").agg(F.sum(load).alias("load"))
    path = None
    while n_cells > 1:
        n_cells = -(-n_cells // MERGED_CELLS)
        level = loads.withColumn("group", F.floor(F.col("_cell") / MERGED_CELLS)).groupBy("group").applyInPandas(merge(bundles if n_cells > 1 else n), "_cell long, _bundle int, load double, group long, next int")
        step = level.select("_cell", "_bundle", "group", "next")
        if path is None:
            path = step
        else:
            upper = step.toDF("group", "next", "_group", "_next")
            path = path.join(upper, ["group", "next"]).select("_cell", "_bundle", F.col("_group").alias("group"), F.col("_next").alias("next"))
        loads = level.groupBy(F.col("group").alias("_cell"), F.col("next").alias("_bundle")).agg(F.sum("load").alias("load"))
    path = path.select("_cell", "_bundle", F.col("next").alias("part"))
    return dealt(df.drop("part"), "_bundle", bundles).join(path, ["_cell", "_bundle"]).drop("_cell", "_bundle")


def token_budget_partitions(df: DataFrame, max_tokens: int, length: str, key: str) -> DataFrame:
    """``cell`` and ``part`` in it: micro-batches of about ``max_tokens``, as many in a cell as ceil(sum / max_tokens), for tables of any size.

    Cells are rows of like hash and hold about CELL_BATCHES batches, so none grows with the table; each is dealt by ``differencing``.
    """
    total = df.agg(F.sum(F.col(length).cast("long"))).first()[0] or 0
    n_cells = max(1, -(-total // (max_tokens * CELL_BATCHES)))

    placed = df.drop("cell", "part").withColumn("cell", F.expr(f"cast(pmod(xxhash64({_quoted(key)}), {n_cells}) as long)"))
    return _dealt(placed, "cell", "part", length, key, lambda tokens: max(1, -(-int(tokens) // max_tokens)))


def _dealt(df: DataFrame, by: str, out: str, length: str, key: str, n_parts) -> DataFrame:
    """``out``: the part of each row in its cell, of as many as ``n_parts`` says for the sum of lengths. Other columns pass as they are."""
    import pyarrow as pa
    from pyspark.sql import types as T

    def deal(cell: pa.Table) -> pa.Table:
        # in an order of its own, so that the rows' order on arrival decides nothing
        order = cell.select([length, key]).to_pandas().sort_values([length, key], na_position="first", kind="stable").index.to_numpy()
        size = cell.column(length).to_pandas().fillna(0).to_numpy(float)[order]
        parts = size.astype("int32")
        parts[order] = differencing(24576.0 * size + size**2, n_parts(size.sum()))
        return cell.append_column(out, pa.array(parts, pa.int32()))

    return df.groupBy(by).applyInArrow(deal, T.StructType([*df.schema.fields, T.StructField(out, T.IntegerType())]))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def balanced_batches(df: DataFrame, batch: str, n: int, length: str, key: str, equal_size: bool = False) -> DataFrame:
    """``part`` inside each batch by largest differencing (Karmarkar-Karp over n-way sets); a batch is one training step's rows."""
    import pandas as pd

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        loads = (24576.0 * pdf[length] + pdf[length].astype(float) ** 2).tolist()
        pdf["part"] = largest_differencing(loads, n, equal_size)
        return pdf

    from pyspark.sql import types as T

    return df.groupBy(batch).applyInPandas(deal, T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())]))


def largest_differencing(loads: Sequence[float], n: int, equal_size: bool = False) -> list[int]:
    """Part of each load. The two partial solutions with the widest spread are merged, heavy parts onto light ones, until one is left.

    ``equal_size`` starts from groups of ``n`` neighbours in load order, so all parts have as many members (the number of loads must be a multiple of n).
    """
    import heapq

    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    if equal_size:
        if len(loads) % n:
            raise ValueError("equal parts need a multiple of n rows")
        starts = [[(loads[i], [i]) for i in order[k : k + n]] for k in range(0, len(order), n)]
    else:
        starts = [[(loads[i], [i])] + [(0.0, [])] * (n - 1) for i in order]
    heap = []
    for t, state in enumerate(starts):
        state = sorted(state, key=lambda x: -x[0])
        heapq.heappush(heap, (state[-1][0] - state[0][0], t, state))
    t = len(heap)
    while len(heap) > 1:
        (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        merged = sorted(((x + y, i + j) for (x, i), (y, j) in zip(a, reversed(b), strict=True)), key=lambda x: -x[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], t, merged))
        t += 1
    out = [0] * len(loads)
    for part, (_, members) in enumerate(heap[0][2] if heap else []):
        for i in members:
            out[i] = part
    return out


def token_budget_batches(df: DataFrame, batch: str, max_tokens: int, length: str, key: str) -> DataFrame:
    """``part`` inside each batch with as many parts as ceil(sum / max_tokens), by largest differencing."""
    import pandas as pd
    from pyspark.sql import types as T

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        n = max(1, -(-int(pdf[length].sum()) // max_tokens))
        pdf["part"] = largest_differencing((24576.0 * pdf[length] + pdf[length].astype(float) ** 2).tolist(), n)
        return pdf

    return df.groupBy(batch).applyInPandas(deal, T.StructType([*df.schema.fields, T.StructField("part", T.IntegerType())]))


def imbalance(df: DataFrame, part: str, length: str) -> DataFrame:
    """One row (min, max, spread, mean) of the parts' summed lengths."""
    sums = df.groupBy(part).agg(F.sum(length).alias("s"))
    return sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("spread"), F.avg("s").alias("mean"))


# ---- set and row-shape operators


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows; columns that a part lacks are null there."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def equal_mix(df: DataFrame, source: str, key: str, seed: int = 42) -> DataFrame:
    """Every source upsampled to the rows of the largest: whole copies (``copy`` from 1), then its first rows in hash order.

    One count and one numbering serve all sources; the numbering is split by the hash, so a large source isn't one task's.
    """
    order = hash_order(key, seed)
    marked = df.withColumn("_order", order).withColumn("_slice", F.substring("_order", 1, 3))
    sums = marked.groupBy(source, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.sum("_n").over(Window.partitionBy(source).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    carried = sums.select(F.col(source).alias("_s"), F.col("_slice").alias("_c"), F.coalesce(ahead, F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(source)).alias("_count"))
    inside = F.row_number().over(Window.partitionBy(source, "_slice").orderBy("_order", key)) - 1
    placed = marked.withColumn("_inside", inside).join(carried, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_c")))
    n = df.groupBy(source).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows").alias("_most"))
    placed = placed.crossJoin(F.broadcast(n))  # one row
    copies = F.floor(F.col("_most") / F.col("_count")) + (F.col("_before") + F.col("_inside") < F.col("_most") % F.col("_count")).cast("int")
    return _copied(placed, copies).drop("_order", "_slice", "_inside", "_s", "_c", "_before", "_count", "_most")


def _copied(df: DataFrame, copies: Column) -> DataFrame:
    return df.withColumn("_copies", copies.cast("int")).filter("_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies")


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n): keys to which concatenated batches give several values."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n")).filter("n > 1")


def metric_lists(df: DataFrame, batch: str, metrics: str) -> DataFrame:
    """(name, list): each metric's values over concatenated batches, in the order of ``batch``, from a map a batch; a metric that some batch lacks is an error."""
    batches = df.agg(F.count(F.lit(1)).alias("_n"))
    each = df.select(batch, F.explode(metrics).alias("name", "_v")).groupBy("name").agg(F.sort_array(F.collect_list(F.struct(batch, "_v"))).alias("_l"))
    values = F.transform("_l", lambda x: x["_v"])
    lacking = F.raise_error(F.concat(F.lit("not every batch has metric "), "name")).cast(each.select(values).schema[0].dataType)
    return each.crossJoin(F.broadcast(batches)).select("name", F.when(F.size("_l") == F.col("_n"), values).otherwise(lacking).alias("list"))


def repeat_rows(df: DataFrame, n: int, interleave: bool = True, order: str = "ord") -> DataFrame:
    """Each row ``n`` times with a new ``ord``: copies next to each other (interleaved) or the table n times over."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        return copies.withColumn("new_ord", F.col(order) * n + F.col("copy"))
    return number_rows(copies, ["copy", order], F.struct("copy", F.floor(F.col(order) / BUCKET_ROWS)), "new_ord")


def repeat_each(df: DataFrame, times: str) -> DataFrame:
    """Each row as often as its own ``times`` says; 0, less and null drop it."""
    return df.filter(F.col(times) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(times))))


def chunk(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """``chunk`` 1 .. n of sizes equal within one, in order."""
    placed = number_rows(df, [order], F.floor(F.col(order) / BUCKET_ROWS), "_at", "_n")
    small, longer = F.floor(F.col("_n") / n), F.col("_n") % n  # the first ``longer`` chunks have one row more
    head = longer * (small + 1)
    place = F.when(F.col("_at") < head, F.floor(F.col("_at") / (small + 1))).otherwise(longer + F.floor((F.col("_at") - head) / F.greatest(small, F.lit(1))))
    return placed.withColumn("chunk", (place + 1).cast("long")).drop("_at", "_n")


def split_by_size(df: DataFrame, size: int, order: str = "ord") -> DataFrame:
    """``chunk`` = ord div size, for an ord without gaps from 0."""
    return df.withColumn("chunk", F.floor(F.col(order) / size))


def pad_to_multiple(df: DataFrame, divisor: int, order: str = "ord") -> DataFrame:
    """Leading rows repeated behind the last until the count is a multiple; the repeats have ``is_pad``. Unpad by filtering them."""
    n = df.count()
    pad = -n % divisor if n else 0
    out = df.withColumn("is_pad", F.lit(False))
    for lap in range(-(-pad // n) if n else 0):
        more = df.filter(F.col(order) < min(n, pad - lap * n)).withColumn(order, F.col(order) + n * (lap + 1)).withColumn("is_pad", F.lit(True))
        out = out.unionByName(more)
    return out


def unfold(df: DataFrame, array: str, n: int) -> DataFrame:
    """Each row as ``n`` rows with the n-th part of an array column, its other columns repeated."""
    step = F.ceil(F.size(array) / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(F.col(array), (i * step + 1).cast("int"), F.greatest(step, F.lit(0))))
    return df.select(*[c for c in df.columns if c != array], F.posexplode(parts).alias("part", array))


def fold(df: DataFrame, by: Sequence[str], array: str) -> DataFrame:
    """The reverse of ``unfold``."""
    return df.groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", array))), lambda x: x[array])).alias(array))


# ---- joins


def join_models(tables: Mapping[str, DataFrame], key: str, value: str) -> DataFrame:
    """One row a key that all tables have, a column a table."""
    out = None
    for name, df in tables.items():
        one = df.select(key, F.col(value).alias(name))
        out = one if out is None else out.join(one, key)
    return out


def leaked_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key), key, "left_semi")


def check_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise where an id is in both splits."""
    found = leaked_ids(a, b, key).limit(5).collect()
    if found:
        raise ValueError(f"ids in both splits, such as {', '.join(str(r[0]) for r in found)}")


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: object) -> DataFrame:
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return work.join(done.select(key), key, "left_anti")


def fallback_lookup(df: DataFrame, table: DataFrame, key: str, text: str, value: str, prefix: int = 150) -> DataFrame:
    """``value`` by key, else by the first ``prefix`` characters of the text behind a leading ``User: ``; the smallest on repeats."""
    start = lambda: F.substring(F.regexp_replace(F.trim(F.col(text)), "^User: ", ""), 1, prefix)
    by_key = table.groupBy(key).agg(F.min(value).alias("_a"))
    by_text = table.groupBy(start().alias("_start")).agg(F.min(value).alias("_b"))
    return df.join(by_key, key, "left").withColumn("_start", start()).join(by_text, "_start", "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b", "_start")


def union_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of two aligned tables side by side; shared columns must agree (null-safe) or the job fails."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    right = b.select(key, *[F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in b.columns if c != key])
    out = a.join(right, key)
    for c in shared:
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_b_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(a.schema[c].dataType))).drop(f"_b_{c}")
    return out


def forward_fill(df: DataFrame, column: str, by: str, order: str, out: str) -> DataFrame:
    """The latest value of ``column`` that isn't null, up to each row, inside one log. Of rows equal in ``order`` (a struct may break ties) any is the latest."""
    return last_known(df, column, by, order, out)


def before_after(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, before, after, delta) with keys that only one side has."""
    both = a.select(*keys, F.col(value).alias("before")).join(b.select(*keys, F.col(value).alias("after")), list(keys), "full_outer")
    return both.withColumn("delta", F.col("after") - F.col("before"))


def first_gold(df: DataFrame, by: str, gold: str, order: str) -> DataFrame:
    """``gold`` of each group's first row whose gold isn't blank, on all its rows."""
    good = F.when(F.trim(F.coalesce(gold, F.lit(""))) != "", F.struct(order, gold))
    found = df.groupBy(by).agg(F.min(good)[gold].alias("_gold"))
    return df.drop(gold).join(found, by).withColumnRenamed("_gold", gold)


def question_answer(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """``question`` and ``gold_answer`` by the kind of dataset: chats give their last user and assistant turn, others their fields.

    Columns that the union of layouts lacks may be null: messages, instruction, input, output, question, generated_solution,
    expected_answer. Kinds that have no answers, and unknown ones, give empty texts.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    last = lambda role: F.coalesce(F.try_element_at(F.filter("messages", lambda m: m["role"] == role), F.lit(-1))["content"], F.lit(""))
    first_filled = lambda a, b: F.when(text(a) != "", text(a)).otherwise(text(b))
    kind = F.col(dataset)
    asked = F.when(kind.contains("chat"), last("user")).when(kind.contains("instruct"), first_filled("instruction", "input")).when(kind.contains("math"), text("question")).otherwise("")
    answer = F.when(kind.contains("chat"), last("assistant")).when(kind.contains("instruct"), text("output")).when(kind.contains("math"), first_filled("generated_solution", "expected_answer")).otherwise("")
    return df.withColumn("_q", asked).withColumn("gold_answer", answer).drop("question").withColumnRenamed("_q", "question")


def showcase(df: DataFrame, best: str, others: Sequence[str], text: str, margin: float = 0.05, least: float = 0.6, lengths: tuple[int, int] = (50, 800), n: int = 10) -> DataFrame:
    """The ``n`` rows with the largest ``lead`` of one score over the best of the others, among those that lead each by more
    than ``margin``, score ``least`` or more, and have a text of a length strictly between ``lengths``."""
    rest = F.greatest(*[F.col(c) for c in others]) if len(others) > 1 else F.col(others[0])
    size = F.length(text)
    good = (F.col(best) > rest + margin) & (F.col(best) >= least) & (size > lengths[0]) & (size < lengths[1])
    return df.filter(good).withColumn("lead", F.col(best) - rest).orderBy(F.desc("lead"), text).limit(n)


def since(df: DataFrame, epoch: str, start: float) -> DataFrame:
    """Rows whose epoch seconds are ``start`` or later."""
    return df.filter(F.col(epoch) >= start)
