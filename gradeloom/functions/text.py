"""Column functions over rubric and chat texts. A null text is empty unless a docstring says otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the rubric format. Dashes are hyphen, en dash and em dash.
DASH = "\\-\u2013\u2014"
BULLET = rf"^\s*(?:[*{DASH}]\s*)?"
CRITERION = rf"(?iU){BULLET}\[(\d*[+{DASH}]+\d*)\]\s*(.+?)(?:\s*\|\s*tags?\s*:.*)?$"
# The same for lines without a bar, which can have no tags behind them.
CRITERION_WITHOUT_TAGS = rf"(?U){BULLET}\[(\d*[+{DASH}]+\d*)\]\s*(.+)$"
BRACKETED = rf"(?U){BULLET}\[[^\]]*\]\s*.+$"
DOUBLE_TAG = rf"(?U){BULLET}\[[+\d{DASH}]*\]\s*\[[+\d{DASH}]*\]"
SCORED_LINE = r"^-\s*\[?\s*[+-]?\d+\s*\]?\s*.+"
LINE_BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# Words that say nothing about a rubric's subject.
STOP_WORDS = (
    "this that with from have will been should could would which their there about into "
    "also does than when what were they some more most each only such very just like"
).split()


def text_of(x: Column | str) -> Column:
    return F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit(""))


def bound(value: Column, use) -> Column:
    """``use(value)``, where the value is made once however often ``use`` names it: a one-element array binds it to a variable."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lines(text: Column | str) -> Column:
    """The lines of a text at all Unicode line breaks, without an empty last one."""
    parts = F.split(text_of(text), LINE_BREAKS)
    return bound(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


# ---- chats


def chat_lines(messages: Column) -> Column:
    """``Role: content`` lines of the messages that aren't blank; a message without a role is the user's."""
    said = F.filter(messages, lambda m: F.trim(text_of(m["content"])) != "")
    role = lambda m: F.coalesce(m["role"], F.lit("user"))
    cap = lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r))))
    return F.array_join(F.transform(said, lambda m: F.concat(cap(role(m)), F.lit(": "), F.trim(m["content"]))), "\n")


def chat_user_text(messages: Column) -> Column:
    """The user's turns alone, a line each."""
    mine = F.filter(messages, lambda m: (F.coalesce(m["role"], F.lit("user")) == "user") & (F.trim(text_of(m["content"])) != ""))
    return F.array_join(F.transform(mine, lambda m: F.trim(m["content"])), "\n")


def chat_contents(messages: Column) -> Column:
    """All contents without roles, a line each."""
    return F.array_join(F.transform(messages, lambda m: text_of(m["content"])), "\n")


# ---- rubrics


def normalise_rubrics(items: Column) -> Column:
    """array<struct<criterion, points>> without blank criteria; missing points are 1."""
    clean = F.transform(items, lambda r: F.struct(F.trim(text_of(r["criterion"])).alias("criterion"), F.coalesce(r["points"].cast("int"), F.lit(1)).alias("points")))
    return F.filter(clean, lambda r: r["criterion"] != "")


def normalise_plain_rubrics(items: Column) -> Column:
    """The same from bare strings: one point each."""
    clean = F.transform(items, lambda r: F.struct(F.trim(text_of(r)).alias("criterion"), F.lit(1).alias("points")))
    return F.filter(clean, lambda r: r["criterion"] != "")


def clamp_points(points: Column) -> Column:
    return F.when(points.isNotNull(), F.greatest(F.least(points, F.lit(10)), F.lit(1))).cast("int")


def weight_to_points(weight: Column) -> Column:
    """A weight in (0, 1] times 10, rounded half to even; other numbers cut to integers; within 1 to 10; null is 1."""
    w = weight.try_cast("double")
    return F.coalesce(clamp_points(F.when((w > 0) & (w <= 1), F.bround(w * 10, 0)).otherwise(w.cast("long"))), F.lit(1))


def rubric_line(criterion: Column, points: Column) -> Column:
    """``- [+3] text``, with the sign of the points."""
    return F.concat(F.lit("- ["), F.format_string("%+d", points.cast("int")), F.lit("] "), criterion)


def fill_template(template: str, **values: Column) -> Column:
    """The template with each ``{name}`` replaced; values are not looked at for further names."""
    if not values:
        return F.lit(template)
    # every second part is a name
    parts = re.split(r"\{(" + "|".join(map(re.escape, values)) + r")\}", template)
    return F.concat(*[text_of(values[part]) if k % 2 else F.lit(part) for k, part in enumerate(parts)])


def strip_think(text: Column | str) -> Column:
    return F.regexp_replace(text_of(text), r"(?s)<think>.*?</think>\s*", "")


def strip_tags_suffix(text: Column | str) -> Column:
    return F.regexp_replace(text_of(text), r"(?im)\s*\|\s*tags?\s*:.*$", "")


def is_criterion(line: Column) -> Column:
    return line.rlike(CRITERION)


#: Stands before the bracket of a criterion line, and behind it, once lines are marked.
_HEAD, _END = "\u0001\u0002", "\u0002\u0001"


def _marked(line: Column) -> Column:
    """One match a line, and none for lines without a bracket; the pattern with a lazy middle is for those alone that hold a bar."""
    mark = f"{_HEAD}$1{_END}$2"
    bracketed = F.when(F.contains(line, F.lit("|")), F.regexp_replace(line, CRITERION, mark)).otherwise(F.regexp_replace(line, CRITERION_WITHOUT_TAGS, mark))
    return F.when(F.contains(line, F.lit("[")), bracketed).otherwise(line)


def marked_lines(text: Column | str) -> Column:
    """The lines of a text; a criterion's is its bracket between marks and its text without tags."""
    return F.transform(lines(text), _marked)


def _is_marked(line: Column) -> Column:
    return F.startswith(line, F.lit(_HEAD))


def _sign(bracket: Column) -> Column:
    plain = F.translate(bracket, "\u2013\u2014", "--")
    return F.when(F.contains(plain, F.lit("-")) & ~F.contains(plain, F.lit("+")), "-").otherwise("+")


def _signs(marked: Column) -> Column:
    return F.transform(F.filter(marked, _is_marked), lambda v: _sign(F.substring_index(v, _END, 1)))


def parse_rubric(text: Column | str) -> Column:
    """array<struct<sign, text>> in order; other lines that aren't blank continue the criterion above them.

    Marked lines are joined and cut at the marks, so the work is linear in the text.
    """
    trimmed = lambda v: bound(_marked(v), lambda m: F.when(_is_marked(m), m).otherwise(F.trim(m)))
    kept = F.filter(F.transform(lines(text), trimmed), lambda v: v != "")
    pieces = F.split(F.concat(F.lit("\n"), F.array_join(kept, "\n")), f"\n{_HEAD}")

    def criterion(piece: Column) -> Column:
        body = piece.substr(F.locate(_END, piece) + len(_END), F.length(piece))
        # the criterion's own line is trimmed, as the others are
        head = lambda b: F.substring_index(b, "\n", 1)
        text = bound(body, lambda b: F.concat(F.trim(head(b)), b.substr(F.length(head(b)) + 1, F.length(b))))
        return F.struct(_sign(F.substring_index(piece, _END, 1)).alias("sign"), text.alias("text"))

    # what stands before the first criterion goes; the rest of a piece is its own
    return F.transform(F.filter(pieces, lambda _, i: i > 0), criterion)


def count_lines(text: Column | str, condition) -> Column:
    return F.size(F.filter(lines(text), condition))


def _malformed(marked: Column) -> Column:
    """Number of lines with a bracket that look like criteria but don't parse as one."""
    return F.size(F.filter(marked, lambda v: ~_is_marked(v) & F.contains(v, F.lit("[")) & v.rlike(BRACKETED)))


def malformed_count(text: Column | str) -> Column:
    return _malformed(marked_lines(text))


def _double_tags(ls: Column) -> Column:
    return F.size(F.filter(ls, lambda x: F.contains(x, F.lit("[")) & x.rlike(DOUBLE_TAG)))


def double_tag_count(text: Column | str) -> Column:
    return _double_tags(lines(text))


# Weights and bounds of the quality score.
QUALITY = {"lambda_len": 2.0, "min_criteria": 3, "max_criteria": 15, "lambda_zero": 10.0, "lambda_token_len": 1.5, "soft_max": 750, "hard_max": 1024, "lambda_malformed": 2.0, "lambda_double_tag": 5.0}


def quality_adjustment(text: Column, token_count: Column, **config: float) -> Column:
    """struct(n_criteria, n_positive, n_negative, length, token_length, malformed, double_tag, total): penalties, 0 or below."""
    c = QUALITY | config
    counted = lambda ls: bound(F.transform(ls, _marked), lambda m: F.struct(_signs(m).alias("signs"), _malformed(m).alias("malformed"), _double_tags(ls).alias("double")))

    def penalties(p: Column) -> Column:
        n = F.size(p["signs"])
        signs = lambda s: F.size(F.filter(p["signs"], lambda v: v == s))
        length = F.when(n == 0, -c["lambda_zero"]).when(n > c["max_criteria"], -c["lambda_len"] * (n - c["max_criteria"]) / n).when(n < c["min_criteria"], -c["lambda_len"] * (c["min_criteria"] - n) / max(c["min_criteria"], 1)).otherwise(0.0)
        tokens = bound(token_count, lambda k: F.when(k > c["soft_max"], -c["lambda_token_len"] * F.pow(F.least((k - c["soft_max"]) / max(c["hard_max"] - c["soft_max"], 1), F.lit(1.0)), 2)).otherwise(0.0))
        malformed = -c["lambda_malformed"] * F.least(p["malformed"] / 3.0, F.lit(1.0))
        double = -c["lambda_double_tag"] * p["double"] / F.greatest(n, F.lit(1))
        parts = F.struct(n.alias("n_criteria"), signs("+").alias("n_positive"), signs("-").alias("n_negative"), length.alias("length"), tokens.alias("token_length"), malformed.alias("malformed"), double.alias("double_tag"))
        fields = ("n_criteria", "n_positive", "n_negative", "length", "token_length", "malformed", "double_tag")
        return bound(parts, lambda x: F.struct(*[x[f].alias(f) for f in fields], (x["length"] + x["token_length"] + x["malformed"] + x["double_tag"]).alias("total")))

    # lines, marked lines and counts are each made once
    return bound(bound(lines(text), counted), penalties)


def bold_concepts(text: Column | str) -> Column:
    """Distinct lower-case texts between double asterisks."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_of(text), F.lit(r"\*\*([^*]+)\*\*"), 1), lambda x: F.trim(F.lower(x))))


def keywords(text: Column | str) -> Column:
    """Distinct lower-case ASCII words of four letters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(text_of(text)), F.lit("[a-z]{4,}"), 0)
    return F.array_except(found, F.array(*[F.lit(w) for w in STOP_WORDS]))


def keyword_scores(text: Column | str, gold: Column | str) -> Column:
    """struct(recall, precision, f1) of keywords; zeros where either side has none."""
    a, b = keywords(text), keywords(gold)
    both = F.size(F.array_intersect(a, b))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    recall = F.when(some, F.try_divide(both, F.size(b))).otherwise(0.0)
    precision = F.when(some, F.try_divide(both, F.size(a))).otherwise(0.0)
    f1 = F.when(some & (both > 0), 2.0 * both / (F.size(a) + F.size(b))).otherwise(0.0)
    return F.struct(recall.alias("recall"), precision.alias("precision"), f1.alias("f1"))


def _compliance(marked: Column) -> Column:
    return F.size(F.filter(marked, _is_marked)) / F.greatest(F.size(F.filter(marked, lambda v: F.trim(v) != "")), F.lit(1))


def format_compliance(text: Column | str) -> Column:
    """Share of lines that aren't blank and parse as criteria."""
    return F.get(F.transform(F.array(marked_lines(text)), _compliance), F.lit(0))


def composite_score(text: Column, gold: Column) -> Column:
    """5 f1 + compliance + (3 to 15 criteria) + (both signs)."""

    def form(marked: Column) -> Column:
        signs = _signs(marked)
        both = F.array_contains(signs, "+") & F.array_contains(signs, "-")
        return _compliance(marked) + F.size(signs).between(3, 15).cast("double") + both.cast("double")

    return 5 * keyword_scores(text, gold)["f1"] + F.get(F.transform(F.array(marked_lines(text)), form), F.lit(0))


def char_grams(text: Column | str, n: int = 3) -> Column:
    """The character ``n``-grams of the lower-case trimmed text, each with a number that tells its repeats apart."""
    t = F.lower(F.trim(text_of(text)))
    grams = F.array_sort(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n))))
    # the one-element array binds the grams to a variable, so they are made once
    numbered_grams = F.get(F.transform(F.array(grams), lambda gs: F.transform(gs, lambda g, i: F.concat(g, F.lit("#"), (i - F.array_position(gs, g) + 1).cast("string")))), F.lit(0))
    return F.when(F.length(t) >= n, numbered_grams).otherwise(F.expr("cast(array() as array<string>)"))


def gram_jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Multiset Jaccard of two results of ``char_grams``; ``empty`` where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(empty)).otherwise(F.try_divide(F.size(F.array_intersect(a, b)), both))


def dedup_criteria(text: Column | str, threshold: float = 0.55, pattern: str = SCORED_LINE) -> Column:
    """The text without criterion lines that resemble a kept one (3-gram Jaccard at least ``threshold``); other lines stay."""
    zero = F.expr("cast(named_struct('out', array(), 'kept', array()) as struct<out:array<string>,kept:array<array<string>>>)")

    items = F.transform(F.split(text_of(text), "\n"), lambda v: F.struct(v.alias("line"), F.trim(v).rlike(pattern).alias("crit"), char_grams(v).alias("grams")))

    def step(acc: Column, x: Column) -> Column:
        dup = x["crit"] & F.exists(acc["kept"], lambda k: gram_jaccard(x["grams"], k) >= threshold)
        out = lambda d: F.when(d, acc["out"]).otherwise(F.array_append(acc["out"], x["line"]))
        kept = lambda d: F.when(x["crit"] & ~d, F.array_append(acc["kept"], x["grams"])).otherwise(acc["kept"])
        return F.get(F.transform(F.array(dup), lambda d: F.struct(out(d).alias("out"), kept(d).alias("kept"))), F.lit(0))

    return F.array_join(F.aggregate(items, zero, step)["out"], "\n")


def numbered(items: Column) -> Column:
    """``1. text`` lines."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def criterion_weight(points: Column, alpha: float = 0.1, negative_boost: float = 1.5, low: float = 0.5, high: float = 3.0) -> Column:
    """1 + alpha |points|, boosted for negative points, within bounds."""
    w = (1 + alpha * F.abs(points)) * F.when(points < 0, negative_boost).otherwise(1.0)
    return F.greatest(F.least(w, F.lit(high)), F.lit(low))


def tag_flag(text: Column | str, tag: str) -> Column:
    """struct(flag, text): whether ``<tag>`` is there, and the text without it."""
    pattern = rf"(?i)\s*<{tag}>\s*"
    return F.struct(text_of(text).rlike(pattern).alias("flag"), F.trim(F.regexp_replace(text_of(text), pattern, " ")).alias("text"))


def has_filler(line: Column) -> Column:
    """An opening that says nothing specific."""
    # Openings of criteria without content.
    return line.rlike(
        r"(?i)^models?\s+answers?\s+with\b"
        r"|^(?:the\s+)?(?:response|answer|model)\s+(?:shows?|demonstrates?|maintains?|provides?)\s+(?:empathy|compassion|supportive|appropriate|sensitivity)"
        r"|^respond\s+with\s+(?:empathy|compassion|understanding|sensitivity|kindness|sympathy)"
        r"|^(?:show|display|express|convey)\s+(?:empathy|compassion|understanding|sensitivity|kindness)"
        r"|^acknowledge\s+(?:the\s+)?(?:user|patient|person|individual)(?:'?s?)?\s+(?:feeling|emotion|situation|concern|struggle|experience)"
    )


def non_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7f]")


def opener(text: Column, n: int = 8) -> Column:
    """The first ``n`` words."""
    return F.array_join(F.slice(F.split(F.trim(text_of(text)), r"\s+"), 1, n), " ")


def escape_cell(text: Column | str) -> Column:
    """A table cell: bars escaped, line feeds as spaces."""
    return F.replace(F.replace(text_of(text), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def signed(value: Column, digits: int = 4) -> Column:
    """A delta with its sign."""
    return F.format_string(f"%+.{digits}f", value.cast("double"))
