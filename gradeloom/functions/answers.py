"""Column functions that read scores, rubrics and answers out of free text, and score answers by rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeloom.functions.text import strip_think, text_of


def within(x: Column, lo: float = 0.0, hi: float = 10.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(-1))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), group), F.lit(1))


def without_fences(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.trim(strip_think(text)), r"```(?:json)?\s*", ""))


def bracketed(text: Column) -> Column:
    """From the first [ to the last ], or null."""
    return first_match(text, r"(?s)(\[.*\])")


def rubric_from_text(text: Column | str) -> Column:
    """array<struct<criterion, points>> from a JSON array in free text, else from lines with a bracketed number.

    Points are held within -10 and 10; items without points, with 0 points or without a criterion are left out.
    """
    cleaned = without_fences(text)
    parsed = F.from_json(bracketed(cleaned), "array<struct<criterion:string,points:string>>", {"mode": "PERMISSIVE"})
    as_items = F.transform(parsed, lambda x: F.struct(F.trim(text_of(x["criterion"])).alias("criterion"), within(x["points"].try_cast("int"), -10, 10).cast("int").alias("points")))
    good = lambda items: F.filter(items, lambda x: (x["criterion"] != "") & x["points"].isNotNull() & (x["points"] != 0))
    from_json = good(F.coalesce(as_items, F.expr("cast(array() as array<struct<criterion:string,points:int>>)")))

    def of_line(line: Column) -> Column:
        number = first_match(line, r"\[\s*([+-]?\d+)\s*\]")
        words = F.regexp_replace(F.regexp_replace(F.trim(line), r"^[-*\d.\s]*", ""), r"\[\s*[+-]?\d+\s*\]", "")
        return F.struct(F.btrim(words, F.lit(" -:")).alias("criterion"), within(number.try_cast("int"), -10, 10).cast("int").alias("points"))

    from_lines = good(F.transform(F.split(cleaned, "\n"), of_line))
    return F.when(F.size(from_json) > 0, from_json).otherwise(from_lines)


def score_from_text(text: Column | str) -> Column:
    """A score 0 to 10: a bare integer; the last ``Score: n``; JSON score or overall; ``n/10``; the last integer up to 10; else null."""
    cleaned = F.trim(strip_think(text))
    cleaned = F.when(cleaned == "", F.trim(text_of(text))).otherwise(cleaned)
    body = F.from_json(first_match(cleaned, r"(?s)(\{[^{}]*\})"), "struct<score:double,overall:double>")
    bare = F.when(cleaned.rlike(r"^(?:\d|10)$"), cleaned.try_cast("double"))
    integers = F.filter(F.regexp_extract_all(cleaned, F.lit(r"\b(\d+)\b"), 1), lambda x: (F.length(x) <= 4) & (x.try_cast("int") <= 10))
    return F.coalesce(
        bare,
        within(last_match(cleaned, r"[Ss]core\s*[:=]\s*(\d+(?:\.\d+)?)").try_cast("double")),
        within(F.coalesce(body["score"], body["overall"])),
        within(first_match(cleaned, r"(\d+(?:\.\d+)?)\s*/\s*10").try_cast("double")),
        F.try_element_at(integers, F.lit(-1)).try_cast("double"),
    )


def scores_from_text(text: Column | str, n: Column, fallback: bool = False) -> Column:
    """array<double> of exactly ``n`` scores within 0 and 10 from a JSON array in the text; null otherwise.

    ``fallback`` (the batch form) takes the bare integers of the text where there are exactly ``n``.
    """
    cleaned = without_fences(text)
    scores = F.transform(F.from_json(bracketed(cleaned), "array<double>"), lambda x: within(x))
    found = F.when((F.size(scores) == n) & ~F.exists(scores, lambda x: x.isNull()), scores)
    if not fallback:
        return found
    bare = F.transform(F.regexp_extract_all(cleaned, F.lit(r"\b(\d+)\b"), 1), lambda x: within(x.try_cast("double")))
    return F.coalesce(found, F.when(F.size(bare) == n, bare))


def signed_to_ten(scores: Column, signs: Column) -> Column:
    """Sum of scores, minus those of negative criteria, mapped from its possible range to 0 to 10; 5 without criteria."""
    pos = F.size(F.filter(signs, lambda s: s == "+")) * 10.0
    neg = F.size(F.filter(signs, lambda s: s == "-")) * 10.0
    raw = F.aggregate(F.arrays_zip(scores.alias("score"), signs.alias("sign")), F.lit(0.0), lambda acc, x: acc + F.when(x["sign"] == "+", x["score"]).otherwise(-x["score"]))
    return F.when(pos + neg == 0, 5.0).otherwise(within((raw + neg) / F.nullif(pos + neg, F.lit(0.0)) * 10))


def yes_verdict(text: Column | str) -> Column:
    return F.contains(F.upper(F.trim(text_of(text))), F.lit("YES"))


# ---- rule scorers


def final_number(text: Column | str, strict: bool = True) -> Column:
    """The answer behind the last ``####`` of the last 300 characters, or (not strict) their last number; null without one."""
    tail = F.substring(text_of(text), -300, 300)
    tail = F.when(F.length(text_of(text)) > 300, tail).otherwise(text_of(text))
    if strict:
        return F.regexp_replace(last_match(tail, r"#### (-?[0-9.,]+)"), r"[,$]", "")
    found = F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), 1)
    return F.coalesce(F.try_element_at(F.filter(found, lambda x: x != "."), F.lit(-1)), F.try_element_at(found, F.lit(1)))


def score_number(text: Column | str, truth: Column, strict: bool = True, format_score: float = 0.0) -> Column:
    answer = final_number(text, strict)
    return F.when(answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(format_score)


def normalise_answer(text: Column | str) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces."""
    t = F.regexp_replace(F.lower(text_of(text)), r"[!-/:-@\[-`{-~]", "")
    t = F.regexp_replace(t, r"\b(?:a|an|the)\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tagged_answer(text: Column | str) -> Column:
    """What the last pair of answer tags holds, trimmed; null without one."""
    return F.trim(last_match(text_of(text), r"(?s)<answer>(.*?)</answer>"))


def score_exact_match(text: Column | str, golds: Column, substring: bool = False, format_score: float = 0.0) -> Column:
    """1 if the tagged answer equals (or holds, where ``substring``) any gold answer after normalisation; 0 without an answer."""
    answer = tagged_answer(text)
    mine = normalise_answer(answer)
    hit = F.exists(golds, lambda g: F.contains(mine, normalise_answer(g)) if substring else mine == normalise_answer(g))
    return F.when(answer.isNull(), 0.0).when(hit, 1.0).otherwise(format_score)


def last_boxed(text: Column | str) -> Column:
    r"""The content of the last ``\boxed{...}``, braces matched; null without one."""
    parts = F.split(text_of(text), r"\\boxed\{")
    rest = F.element_at(parts, -1)
    zero = F.expr("cast(named_struct('depth', 1, 'n', 0, 'done', false) as struct<depth:int,n:int,done:boolean>)")

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        done = acc["done"] | (depth == 0)
        return F.struct(F.when(acc["done"], acc["depth"]).otherwise(depth).alias("depth"), F.when(done, acc["n"]).otherwise(acc["n"] + 1).alias("n"), done.alias("done"))

    end = F.aggregate(F.split(rest, ""), zero, step)
    return F.when((F.size(parts) > 1) & end["done"], F.substring(rest, F.lit(1), end["n"]))


# Replacements and removals of the final-answer normalisation, in this order.
SUBSTITUTIONS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
REMOVALS = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits",
    "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}",
    "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)


# Fixed values: (pattern, replacement) of the final-answer normalisation, applied in this order behind the two lists above.
PATTERNS = (
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", r"frac\{$2\}\{$3\}"),
    (r"(sqrt)([^{])", r"sqrt\{$2\}"),
    (r"\$", ""),
)


def normalise_final_answer(text: Column | str) -> Column:
    """What stands behind the last equals sign, with units, fillers and LaTeX wrappers taken off."""
    t = F.element_at(F.split(text_of(text), "="), -1)
    for before, after in (*SUBSTITUTIONS, *((gone, "") for gone in REMOVALS)):
        t = F.replace(t, F.lit(before), F.lit(after))
    for pattern, replacement in PATTERNS:
        t = F.regexp_replace(t, pattern, replacement)
    plain = F.replace(t, F.lit(","), F.lit(""))
    return F.trim(F.when(plain.rlike(r"^\d+$"), plain).otherwise(t))


def score_math(text: Column | str, truth: Column, boxed: bool = False) -> Column:
    """1 if the boxed answer of the last 300 characters (or the one behind the last ``Answer:``) equals the truth, else -1."""
    whole = text_of(text)
    tail = F.when(F.length(whole) > 300, F.substring(whole, -300, 300)).otherwise(whole)
    answer = last_boxed(tail) if boxed else normalise_final_answer(F.coalesce(last_match(tail, r"(?i)Answer\s*:\s*([^\n]+)"), F.lit("[INVALID]")))
    return F.when(answer.eqNullSafe(truth if boxed else normalise_final_answer(truth)), 1.0).otherwise(-1.0)


def score_by_source(source: Column, rules: dict[tuple[str, ...], Column]) -> Column:
    """The score of the first rule whose sources hold the row's; an unknown source is an error."""
    out = None
    for names, score in rules.items():
        out = F.when(source.isin(*names), score) if out is None else out.when(source.isin(*names), score)
    return out.otherwise(F.raise_error(F.concat(F.lit("no scoring rule for source "), F.coalesce(source, F.lit("null")))).cast("double"))


def tool_calls(text: Column | str) -> Column:
    """array<struct<name, arguments>> from tagged JSON calls; calls without a name are left out."""
    found = F.regexp_extract_all(text_of(text), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)
    parsed = F.transform(found, lambda x: F.struct(F.get_json_object(x, "$.name").alias("name"), F.get_json_object(x, "$.arguments").alias("arguments")))
    return F.filter(parsed, lambda x: x["name"].isNotNull())
