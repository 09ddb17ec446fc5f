"""Training sequences: token arrays with loss masks and weights, padded or cut to a length.

A tokenizer is a function Column -> Column giving an array; words and signs by default. Arrays stay inside a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\w+|[^\w\s]"), 0)


def fit(array: Column, length: int, pad: Column, truncate: str = "right", pad_left: bool = False) -> Column:
    """The array cut or padded to ``length``; truncation drops from the left, the right or the middle, or is an error."""
    n = F.size(array)
    half = length // 2
    cut = {
        "left": F.slice(array, F.greatest(n - length + 1, F.lit(1)), F.lit(length)),
        "right": F.slice(array, 1, length),
        "middle": F.concat(F.slice(array, 1, half), F.slice(array, F.greatest(n - (length - half) + 1, F.lit(1)), F.lit(length - half))),
        "error": F.when(n > length, F.raise_error(F.lit(f"sequence longer than {length}"))).otherwise(array) if truncate == "error" else array,
    }[truncate]
    padding = F.array_repeat(pad, F.greatest(F.lit(length) - n, F.lit(0)))
    return F.when(n > length, cut).otherwise(F.concat(padding, array) if pad_left else F.concat(array, padding))


def prompt_response(df: DataFrame, prompt: str, response: str, length: int, truncate: str = "right", tokenizer: Tokenizer = word_tokens, end: str = "</s>") -> DataFrame:
    """``tokens``, ``attention`` and ``loss_mask`` (on the response and its end)."""
    p, r = tokenizer(F.col(prompt)), F.concat(tokenizer(F.col(response)), F.array(F.lit(end)))
    zeros, ones = lambda a: F.array_repeat(F.lit(0), F.size(a)), lambda a: F.array_repeat(F.lit(1), F.size(a))
    tokens, mask = F.concat(p, r), F.concat(zeros(p), ones(r))
    out = df.withColumn("tokens", fit(tokens, length, F.lit(""), truncate)).withColumn("loss_mask", fit(mask, length, F.lit(0), truncate))
    return out.withColumn("attention", fit(ones(tokens), length, F.lit(0), truncate))


def multi_turn(messages: DataFrame, length: int, tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """(conv_id, tokens, loss_mask) from (conv_id, turn, role, text): all turns in order, loss on the assistant's."""
    each = messages.select("conv_id", "turn", tokenizer(F.col("text")).alias("t"), (F.col("role") == "assistant").cast("int").alias("m"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "m", "t")))
    rows = each.groupBy("conv_id").agg(turns.alias("s"))
    tokens, mask = F.flatten(F.transform("s", lambda x: x["t"])), F.flatten(F.transform("s", lambda x: F.array_repeat(x["m"], F.size(x["t"]))))
    return rows.select("conv_id", fit(tokens, length, F.lit("")).alias("tokens"), fit(mask, length, F.lit(0)).alias("loss_mask"))


def preference_pair(df: DataFrame, prompt: str, chosen: str, rejected: str, length: int, tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """``chosen_tokens`` and ``rejected_tokens``: the prompt with either answer."""
    both = lambda c: fit(F.concat(tokenizer(F.col(prompt)), tokenizer(F.col(c))), length, F.lit(""), "left")
    return df.withColumn("chosen_tokens", both(chosen)).withColumn("rejected_tokens", both(rejected))


def weighted_criteria(df: DataFrame, prompt: str, criteria: str, length: int, tokenizer: Tokenizer = word_tokens) -> DataFrame:
    """``tokens``, ``weights`` and ``loss_mask``: the prompt (weight 0), then each criterion's tokens at its own weight.

    ``criteria`` is array<struct<text, weight>>. Over-long sequences lose their right end.
    """
    p = tokenizer(F.col(prompt))
    parts = F.transform(criteria, lambda c: tokenizer(c["text"]))
    tokens = F.concat(p, F.flatten(parts))
    weights = F.concat(F.array_repeat(F.lit(0.0), F.size(p)), F.flatten(F.transform(criteria, lambda c: F.array_repeat(c["weight"].cast("double"), F.size(tokenizer(c["text"]))))))
    out = df.withColumn("tokens", fit(tokens, length, F.lit(""))).withColumn("weights", fit(weights, length, F.lit(0.0)))
    return out.withColumn("loss_mask", F.transform("weights", lambda w: (w > 0).cast("int")))


def spread_line_weights(df: DataFrame, text: str, weights: str, default: float = 1.0) -> DataFrame:
    """``char_weights``: for each character of the text the weight of its criterion line; other lines get ``default``.

    ``weights`` has a number for each criterion line in order; missing ones are ``default``.
    """
    from gradeloom.functions.text import is_criterion

    zero = F.expr("cast(named_struct('k', 0, 'out', array()) as struct<k:int,out:array<double>>)")

    def step(acc: Column, line: Column) -> Column:
        crit = is_criterion(line)
        w = F.when(crit, F.coalesce(F.get(F.col(weights), acc["k"]), F.lit(default))).otherwise(F.lit(default)).cast("double")
        return F.struct((acc["k"] + crit.cast("int")).alias("k"), F.concat(acc["out"], F.array_repeat(w, F.length(line) + 1)).alias("out"))

    spread = F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), zero, step)["out"]
    return df.withColumn("char_weights", F.slice(spread, 1, F.length(F.coalesce(text, F.lit("")))))
