"""Benchmark decontamination by template canonicalisation, with DataFrame operations alone.

Words are runs of letters and digits. A number is one word with its decimals and thousands marks, a unit behind it another;
number words are numbers. Texts are read in two ways:
 * as a template: numbers that follow each other, units behind numbers, and names (capitalised words that follow each other)
   are one typed placeholder each, all else is lower-cased, so a question whose slots were filled anew keeps its template,
   however many words the new fillings have;
 * plainly: all words in lower case, each number a placeholder, which finds copies in another case.
Documents are cut into tiles of w words, benchmark items into windows of w words at every place; any run of 2 w - 1 words that
a document shares with an item holds a whole tile, which a hash join then finds, at one tile instead of w windows for each w
words of the corpus. Windows of placeholders for the most part aren't taken from templates, and are hashed as they stand
in the plain reading, so number tables don't meet each other. The tile's place gives the alignment, along which document and item are
compared word by word. A run of matching words counts if it is long enough, has enough words that are the item's own,
and fills the slots consistently: one value of the item goes to one value of the document and back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.common import broadcast_if_small, materialize, unused_name

#: Placeholders are single words that begin with a letter that no text is expected to have.
MARK = "ꙮ"
NUMBER, UNIT, NAME = MARK + "n", MARK + "u", MARK + "x"
#: A letter in place of the marks inside a number and of the spaces inside a placeholder's value.
POINT = "ꙭ"
TEMPLATE, PLAIN = 0, 1
# Units of measure that are replaced when they follow a number, and words for numbers.
UNITS = "km|m|cm|mm|kg|g|mg|t|l|ml|s|sec|min|h|hr|hours?|minutes?|seconds?|days?|weeks?|months?|years?|miles?|meters?|metres?|feet|foot|inch|inches|yards?|pounds?|lbs?|oz|ounces?|liters?|litres?|gallons?|percent|dollars?|cents?|euros?|usd|eur|degrees?|watts?|volts?|mph|kmh|gb|mb|kb|tb"
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()
#: Words in a row that make a leak; shorter items must be there whole.
RUN = 13
#: Tile widths and the least number of words of a run that is sure to hold a tile of that width.
WIDTHS = {6: 11, 4: 7, 2: 3, 1: 1}


def _by_first_letter(all_words: Sequence[str]) -> str:
    """An alternation that looks at the first letter before the words that begin with it."""
    first = sorted({w[0] for w in all_words})
    return "|".join(f"{c}(?:{'|'.join(w[1:] for w in all_words if w[0] == c)})" for c in first)


_INITIALS = "".join(sorted({c for w in NUMBER_WORDS for c in (w[0], w[0].upper())}))
# Groups repeat possessively, as the others take stack for each repetition.
# Texts are spaced: a single space stands before each word, and nothing else but words is there.
_DIGITS = r" \p{N}[^ ]*"
_NUMBER_WORD = rf" (?=[{_INITIALS}])(?i:{_by_first_letter(NUMBER_WORDS)})(?![^ ])"
_NAME = r" \p{Lu}[^ ]*"
#: A number word's placeholder, until words behind a number are joined to it.
_WORD = NUMBER + POINT
_TAG = f"{MARK}[nux]{POINT}?"


def spaced(text: Column) -> Column:
    """The words of a text, each behind a single space; marks inside numbers are letters, units apart from their numbers; null is empty."""
    t = F.coalesce(text, F.lit(""))
    whole = F.regexp_replace(t, r"(?<=\p{N})[.,](?=\p{N})", POINT)
    apart = F.regexp_replace(whole, rf"(?i)(?<![\p{{L}}\p{{N}}])(\p{{N}}[\p{{N}}{POINT}]*)(?=(?:{UNITS})(?![\p{{L}}\p{{N}}]))", "$1 ")
    clean = F.when(t.rlike(r"\p{N}[.,\p{L}]"), apart).otherwise(t)
    return F.rtrim(F.regexp_replace(F.concat(F.lit(" "), clean), r"[^a-zA-Z0-9\p{L}\p{N}]+", " "))


def with_numbers(text: Column, keep: bool = False) -> Column:
    """A spaced text with a placeholder for each number, its value behind the placeholder where ``keep`` is set."""
    found = (_DIGITS, NUMBER), (_NUMBER_WORD, _WORD)
    for pattern, mark in found:
        put = F.regexp_replace(text, f" ({pattern.removeprefix(' ')})", f" {mark}$1") if keep else F.regexp_replace(text, pattern, f" {mark}")
        text = F.when(text.rlike(r"\p{N}"), put).otherwise(text) if pattern == _DIGITS else put
    return text


def template(text: Column, keep: bool = False) -> Column:
    """The template of a text ``with_numbers`` (made with the same ``keep``), in its own case."""
    t = F.when(F.contains(text, F.lit(NUMBER)), _slots(text, keep)).otherwise(text)
    if not keep:
        return F.regexp_replace(t, f"(?:{_NAME})++", f" {NAME}")
    return F.regexp_replace(F.regexp_replace(t, r"(?<= )(\p{Lu}[^ ]*) (?=\p{Lu})", "$1" + POINT), r" (?=\p{Lu})", f" {NAME}")


def _slots(text: Column, keep: bool) -> Column:
    joined = F.regexp_replace(text, f"(?<= )({NUMBER}[^ ]*) (?={_WORD})", "$1" + POINT) if keep else F.regexp_replace(text, f" {NUMBER}{POINT}?(?: {_WORD})*+", f" {NUMBER}")
    return F.regexp_replace(joined, rf"( {NUMBER}[^ ]*) ((?i:{UNITS}))(?![^ ])", f"$1 {UNIT}" + ("$2" if keep else ""))


def plain(text: Column) -> Column:
    """A text ``with_numbers`` with number words like other numbers."""
    return F.replace(text, F.lit(_WORD), F.lit(NUMBER))


def words(text: Column) -> Column:
    """The words of a spaced text, in lower case; an empty one has none."""
    return F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.lower(text.substr(F.lit(2), F.length(text))), " "))


def _readings(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``template``, ``plain`` and ``raw`` (spaced texts in lower case, the last two word for word) in place of its text."""
    left = [c for c in df.columns if c != text]
    df = df.select(*left, spaced(F.col(text)).alias("_spaced")).select(*left, "_spaced", with_numbers(F.col("_spaced")).alias("_numbers"))
    return df.select(*left, F.lower(template(F.col("_numbers"))).alias("template"), F.lower(plain(F.col("_numbers"))).alias("plain"), F.lower("_spaced").alias("raw"))


def _hash(reading: int, w: int, words_: Column, raw: Column) -> Column:
    """xxhash64 of ``w`` words, each behind a space. Plain words that are numbers for the most part count as they stand."""
    hashed = F.xxhash64(F.lit(reading), words_)
    if reading == TEMPLATE:
        return hashed
    numbers = F.length(words_) - F.length(F.replace(words_, F.lit(f" {NUMBER}"), F.lit(" ")))
    return F.when(numbers * 2 > w * len(NUMBER), F.xxhash64(raw)).otherwise(hashed)


def _tiles(reading: int, w: int) -> Column:
    """Array of (reading, w, at, hash) for each ``w`` words of the texts from ``_readings``, one after another."""
    cut_up = lambda c: F.regexp_extract_all(c, F.lit(f"(?: [^ ]++){{{w}}}+"), F.lit(0))
    struct = lambda i, h: F.struct(F.lit(reading).alias("reading"), F.lit(w).alias("w"), (i * w).alias("at"), h.alias("hash"))
    if reading == TEMPLATE:
        return F.transform(cut_up("template"), lambda t, i: struct(i, _hash(reading, w, t, t)))
    # where no two numbers stand side by side, few of a tile's words are numbers
    raw = F.when(F.contains("plain", F.lit(NUMBER if w == 1 else f"{NUMBER} {NUMBER}")), cut_up("raw"))
    both = F.arrays_zip(cut_up("plain").alias("plain"), F.coalesce(raw, F.expr("cast(array() as array<string>)")).alias("raw"))
    return F.transform(both, lambda t, i: struct(i, _hash(reading, w, t["plain"], t["raw"])))


def _width(n: Column) -> Column:
    """The widest tile that a run of min(RUN, n) words is sure to hold."""
    out = F.lit(1)
    for w, least in sorted(WIDTHS.items()):
        out = F.when(n >= least, w).otherwise(out)
    return out


def _windows(items: DataFrame) -> DataFrame:
    """(item_id, reading, w, item_at, hash) of all windows of the items, each reading at its own width."""
    read = materialize(_readings(items.select("item_id", "text"), "text"), "item-readings")
    out = None
    for reading, name, other in ((TEMPLATE, "template", "template"), (PLAIN, "plain", "raw")):
        own = read.select("item_id", words(F.col(name)).alias("x"), words(F.col(other)).alias("y")).filter(F.size("x") > 0)
        own = materialize(own.withColumn("w", _width(F.size("x"))), "item-words").withColumn("item_at", F.explode(F.sequence(F.lit(0), F.size("x") - F.col("w"))))
        part = lambda c: F.slice(c, F.col("item_at") + 1, F.col("w"))
        text = lambda c: F.concat(F.lit(" "), F.array_join(part(c), " "))
        for w in WIDTHS:
            one = own.filter(F.col("w") == w)
            if reading == TEMPLATE:
                one = one.filter(2 * F.size(F.filter(part("x"), lambda v: ~F.startswith(v, F.lit(MARK)))) >= w)
            one = one.select("item_id", F.lit(reading).alias("reading"), "w", "item_at", _hash(reading, w, text("x"), text("y")).alias("hash"))
            out = one if out is None else out.unionByName(one)
    return out


def _kept(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """(ids, reading, template, value): the words as placeholders and as they stand, in arrays of equal length.

    In the plain reading each capitalised word is a name of its own.
    """
    df = df.select(*ids, spaced(F.col(text)).alias("_spaced")).withColumn("_tagged", template(with_numbers(F.col("_spaced"), keep=True), keep=True))
    each = F.regexp_replace(plain(with_numbers(F.col("_spaced"))), _NAME, f" {NAME}")
    first = F.struct(F.lit(TEMPLATE).alias("reading"), words(F.regexp_replace("_tagged", f"({MARK}[nux])[^ ]*", "$1")).alias("template"), words(F.regexp_replace("_tagged", _TAG, "")).alias("value"))
    second = F.struct(F.lit(PLAIN).alias("reading"), words(each).alias("template"), words(F.col("_spaced")).alias("value"))
    return df.select(*ids, F.explode(F.array(first, second)).alias("r")).select(*ids, "r.*")


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, *, key: str = "doc_id", text: str = "text", cut: bool = False) -> DataFrame:
    """(doc_id, item_id, run, literal, n_words): documents and the benchmark items that they leak.

    ``run`` is the longest consistent run of matching words that is a leak, ``literal`` how many of them are no placeholders
    or have the item's own value, both in the reading where the run is longest; ``n_words`` is the item's length. A leak has
    min(run, length) words in a row, at least half of them literal. Every run of each alignment is tried. With ``cut`` a run is cut where slots conflict
    and each consistent part counts for itself; without it, a conflict anywhere between two words that don't match rejects the
    run. ``run`` is 11 at least. Null texts and items without words leak nothing. Rows that share an id (null too) are reported together,
    as are items that share an item_id. Other columns are not looked at. An empty table on either side gives an empty result.
    """
    if run < WIDTHS[6]:
        raise ValueError("a run has 11 words at least")
    items = items.select("item_id", "text")
    windows = materialize(_windows(items), "windows")
    widths = sorted(tuple(r) for r in windows.select("reading", "w").distinct().collect())  # two for each of WIDTHS at most
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    if not widths:
        return rows.limit(0).crossJoin(items.limit(0)).select("doc_id", "item_id", *[F.lit(0).alias(c) for c in ("run", "literal", "n_words")])
    tiles = _readings(rows, "text").select("doc_id", F.explode(F.concat(*[_tiles(reading, w) for reading, w in widths])).alias("t")).select("doc_id", "t.*")
    met = tiles.join(broadcast_if_small(windows), ["reading", "w", "hash"]).select("doc_id", "item_id", "reading", (F.col("at") - F.col("item_at")).alias("shift"))
    pairs = materialize(met.distinct(), "tile-pairs")
    # only documents that hold a tile are read again
    ids = materialize(pairs.select(F.col("doc_id").alias("_id")).distinct(), "tile-ids")
    again = rows.join(broadcast_if_small(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    seen = _kept(again, "text", ["doc_id"])
    ours = materialize(_kept(items, "text", ["item_id"]), "benchmark").withColumnsRenamed({"item_id": "_item", "reading": "_reading", "template": "item_template", "value": "item_value"})
    near = broadcast_if_small(pairs).withColumnsRenamed({"doc_id": "_id", "reading": "_r"})
    both = seen.join(near, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("reading") == F.col("_r"))).drop("_id", "_r")
    both = both.join(broadcast_if_small(ours), F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("reading") == F.col("_reading"))).drop("_item", "_reading")
    # for each word of the item: its own and the document's
    at = F.greatest(F.col("shift"), F.lit(0))
    skipped = at - F.col("shift")
    part = [F.slice(c, at + 1, F.size("item_template") - skipped).alias(c) for c in ("template", "value")]
    cut_out = materialize(both.select("doc_id", "item_id", "reading", "shift", "item_template", "item_value", skipped.alias("skipped"), *part), "aligned")
    alignment = ["doc_id", "item_id", "reading", "shift"]
    zipped = F.posexplode(F.arrays_zip("item_template", "item_value")).alias("i", "z")
    each = cut_out.repartition(*alignment).select(*alignment, "skipped", "template", "value", zipped)
    b_template, b = (F.get(c, F.col("i") - F.col("skipped")) for c in ("template", "value"))
    a = F.col("z.item_value")
    slot = F.startswith(F.col("z.item_template"), F.lit(MARK))
    each = each.select(*alignment, "i", slot.alias("slot"), (b_template.eqNullSafe(F.col("z.item_template")) | b.eqNullSafe(a)).alias("ok"), a.alias("a"), b.alias("b"))
    each = each.withColumn("filled", F.col("ok") & F.col("slot"))

    def last_other(of: str, other: str) -> Column:
        """The last place before with the same ``of`` and another ``other``, among filled slots."""
        w = Window.partitionBy(*alignment, "filled", of).orderBy("i")
        return F.when(F.lead(other).over(w) != F.col(other), F.col("i")).otherwise(-1)

    before = lambda of: Window.partitionBy(*alignment, "filled", of).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_turn_a", last_other("a", "b")).withColumn("_bar_a", F.max("_turn_a").over(before("a")))
    each = each.withColumn("_turn_b", last_other("b", "a")).withColumn("_bar_b", F.max("_turn_b").over(before("b")))
    # the last place that can't stand in one run with this one; a place without a match bars itself
    bar = F.when(~F.col("ok"), F.col("i")).when(F.col("slot"), F.greatest(F.coalesce("_bar_a", F.lit(-1)), F.coalesce("_bar_b", F.lit(-1)))).otherwise(-1)
    literal = F.when(~F.col("slot") | (F.col("a") == F.col("b")), 1).otherwise(-1)
    upto = Window.partitionBy(*alignment).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    state = F.struct("i", F.max(bar).over(upto).alias("bar"), F.max(F.when(F.col("ok"), -1).otherwise(F.col("i"))).over(upto).alias("miss"), F.sum(literal).over(upto).cast("int").alias("sum"))
    start = F.expr("array(named_struct('i', -1, 'bar', -1, 'miss', -1, 'sum', 0))")
    # before each place and at the end: the last bar, the last place without a match, and literal less other words
    best = each.select(*alignment, state.alias("state")).groupBy(*alignment).agg(F.concat(start, F.sort_array(F.collect_list("state"))).alias("acc"))
    least = F.least(F.size("acc") - 1, F.lit(run))

    def ending(x: Column, end: Column) -> Column:
        """The longest run up to word ``end`` (not in it) that counts, or null."""
        first = x["bar"] + 1
        follows = F.get(F.col("acc"), end + 1)
        counts = end - first >= least
        if not cut:
            counts &= (x["bar"] == x["miss"]) & (follows.isNull() | (follows["miss"] == end))
        enough = lambda k: F.get(F.col("acc"), k)["sum"] <= x["sum"]
        begin = F.when(enough(first), first).otherwise(F.get(F.filter(F.sequence(first, end - least), enough), F.lit(0)))
        n = F.when(counts, end - begin)
        return F.when(n.isNotNull(), F.struct(n.alias("run"), ((n + x["sum"] - F.get(F.col("acc"), end - n)["sum"]) / 2).cast("int").alias("literal")))

    found = best.select("doc_id", "item_id", F.array_max(F.transform("acc", ending)).alias("best")).filter("best is not null")
    found = found.groupBy("doc_id", "item_id").agg(F.max("best").alias("best"))
    lengths = ours.filter(F.col("_reading") == PLAIN).groupBy("_item").agg(F.max(F.size("item_value")).alias("n_words"))
    lengths = broadcast_if_small(materialize(lengths, "item-lengths"))
    return found.join(lengths, F.col("item_id").eqNullSafe(F.col("_item"))).select("doc_id", "item_id", "best.run", "best.literal", "n_words")


def drop_leaks(docs: DataFrame, found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that ``found`` names; columns and the order of columns stay.

    Rows that share a leaking id go together, null ids too. With an empty table of leaks all rows stay, with an empty
    ``docs`` none. Any extra columns may be there.
    """
    leaked = unused_name(docs, "leaked")
    ids = broadcast_if_small(materialize(found.select(F.col("doc_id").alias(leaked)).distinct(), "leaked"))
    return docs.join(ids, F.col(key).eqNullSafe(F.col(leaked)), "left_anti")
