"""Benchmark decontamination against plain Python: every alignment of every document with every item, word by word."""

import random

import pytest
import regex

from gradeloom.llm import decontaminate as d

VOWELS, REST = "aeiou", "bcdfghjklmnprstvwz"
NUMBER_WORD = "|".join(d.NUMBER_WORDS)


def word(rng):
    return "".join(rng.choice(REST) + rng.choice(VOWELS) for _ in range(rng.randint(1, 3)))


def name(rng):
    kind = rng.randrange(5)
    one = word(rng).capitalize()
    return (one, f"{one} {word(rng).capitalize()}", f"{one}-{word(rng).capitalize()}", word(rng).upper() + "X", "Mc" + one)[kind]


def number(rng):
    return (str(rng.randint(2, 99)), f"{rng.randint(1, 9)},{rng.randint(100, 999)}", f"{rng.randint(1, 99)}.{rng.randint(1, 9)}", rng.choice(d.NUMBER_WORDS[2:20]), f"twenty-{rng.choice(d.NUMBER_WORDS[1:10])}")[rng.randrange(5)]


def unit(rng):
    return rng.choice(["km", "kg", "hours", "minutes", "litres", "miles"])


SLOTS = {"name": name, "number": number, "unit": unit}


def question(rng, n=30):
    """Pieces of a question: words, and slots by kind and identity."""
    pieces = [(None, word(rng)) for _ in range(n)]
    for k, at in enumerate(sorted(rng.sample(range(1, n), 6))):
        pieces[at] = ("name", k % 2) if k % 3 else ("number", k)
    out = []
    for p in pieces:
        out.append(p)
        if p[0] == "number" and rng.random() < 0.4:
            out.append(("unit", p[1]))
    return out


def filled(pieces, rng):
    values = {p: SLOTS[p[0]](rng) for p in pieces if p[0]}
    taken = {}
    for p in values:  # one value a slot
        while values[p].lower() in taken:
            values[p] = SLOTS[p[0]](rng) if p[0] != "unit" else values[p] + " "
        taken[values[p].lower()] = p
    return [values.get(p, p[1]).strip() if p[0] else p[1] for p in pieces]


def around(words, rng):
    """The words with white space, quotes and brackets about some of them."""
    wrap = ("{}", "{}", "{}", '"{}"', "({})", "{},")
    gap = (" ", " ", "  ", "\n")
    return "".join(rng.choice(wrap).format(w) + rng.choice(gap) for w in words)


# ---- the plain version


def tokens(text):
    """(template, plain) readings: lists of (placeholder or word, value)."""
    text = regex.sub(r"(?<=\p{N})[.,](?=\p{N})", d.POINT, text or "")
    text = regex.sub(rf"(?i)(?<![\p{{L}}\p{{N}}])(\p{{N}}[\p{{N}}{d.POINT}]*)(?=(?:{d.UNITS})(?![\p{{L}}\p{{N}}]))", r"\1 ", text)
    words = regex.findall(r"[\p{L}\p{N}]+", text)
    kind = lambda w: "d" if regex.match(r"\p{N}", w) else "w" if regex.fullmatch(rf"(?i){NUMBER_WORD}", w) else "x" if regex.match(r"\p{Lu}", w) else ""
    plain = [({"d": d.NUMBER, "w": d.NUMBER, "x": d.NAME}.get(kind(w), w.lower()), w.lower()) for w in words]
    out = []
    for w in words:
        k, last = kind(w), out[-1] if out else ("", "", "")
        if k == "w" and last[0] == d.NUMBER or k == "x" and last[0] == d.NAME:
            out[-1] = (last[0], f"{last[1]} {w.lower()}")
        elif last[0] == d.NUMBER and regex.fullmatch(rf"(?i){d.UNITS}", w):
            out.append((d.UNIT, w.lower()))
        else:
            out.append(({"d": d.NUMBER, "w": d.NUMBER, "x": d.NAME}.get(k, w.lower()), w.lower()))
    return out, plain


def leaky(doc, item):
    """A consistent run of min(13, item) words in any alignment, half of them literal."""
    for seen, own in zip(tokens(doc), tokens(item)):
        least = min(d.RUN, len(own))
        if not own:
            continue
        for shift in range(-len(own) + 1, len(seen)):
            for start in range(len(own) - least + 1):
                ahead, back, n, literal = {}, {}, 0, 0
                for i in range(start, len(own)):
                    if not 0 <= i + shift < len(seen):
                        break
                    (t, a), (u, b) = own[i], seen[i + shift]
                    if t != u and a != b:
                        break
                    if t.startswith(d.MARK):
                        if ahead.setdefault(a, b) != b or back.setdefault(b, a) != a:
                            break
                    n, literal = n + 1, literal + (not t.startswith(d.MARK) or a == b)
                    if n >= least and 2 * literal >= n:
                        return True
    return False


ITEMS = "item_id long, text string"
DOCS = "doc_id long, text string"


def test_recall_of_rewritten_questions(spark):
    """500 questions, each rewritten with other names, numbers and units, in other marks; and 200 documents that share nothing."""
    rng = random.Random(71)
    asked = [question(rng) for _ in range(500)]
    items = [(k, around(filled(q, rng), rng)) for k, q in enumerate(asked)]
    docs = [(k, f"{around([word(rng) for _ in range(rng.randint(0, 30))], rng)}{around(filled(q, rng), rng)} {around([word(rng) for _ in range(20)], rng)}") for k, q in enumerate(asked)]
    docs += [(1000 + k, around([word(rng) for _ in range(80)], rng)) for k in range(200)]
    found = d.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), cut=True).select("doc_id", "item_id").collect()
    got = {tuple(r) for r in found}
    recall = len({i for i, j in got if i == j}) / len(asked)
    print("recall of rewritten questions", recall)
    assert recall >= 0.9
    assert all(i == j for i, j in got)


def test_agrees_with_all_alignments(spark):
    """No document is found that the plain version doesn't find; of those that it finds, 95 % at least."""
    rng = random.Random(72)
    asked = [question(rng, rng.choice([3, 8, 12, 16, 30]) + 7) for _ in range(40)]
    items = [(k, " ".join(filled(q, rng))) for k, q in enumerate(asked)]
    docs = []
    for k, q in enumerate(asked):
        text = filled(q, rng)
        lo = rng.randrange(len(text) // 2)
        cut = text[lo : lo + rng.randint(8, 40)]
        docs.append((k, " ".join([*[word(rng) for _ in range(rng.randint(0, 9))], *cut, *[word(rng) for _ in range(9)]])))
        docs.append((100 + k, items[k][1].lower() if k % 2 else items[k][1].upper()))
    docs += [(300, None), (301, ""), (302, " \n")]
    want = {(i, j) for i, t in docs for j, u in items if leaky(t, u)}
    got = {tuple(r) for r in d.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), cut=True).select("doc_id", "item_id").collect()}
    assert got <= want
    assert len(got) >= 0.95 * len(want) > 0


ASKED = "a boat leaves port at dawn with 12 crates and Anna counts them twice before noon each day"
CHANGES = {
    "12": ["12.5", "1,200", "twelve", "twenty-five", "5 million"],
    "Anna": ["Bob", "Mary Jane", "IBM", "McDonald", "Jean-Luc", "\nBob", " Bob", "(Bob)", '"Bob"'],
}


@pytest.fixture(scope="module")
def variants(spark):
    texts = [ASKED] + [ASKED.replace(old, new) for old, all_new in CHANGES.items() for new in all_new]
    # neither side of the slot alone has 13 words
    docs = spark.createDataFrame([(k, f"we ask this now: {t}, if you will") for k, t in enumerate(texts)], DOCS)
    return texts, {r["doc_id"] for r in d.leaks(docs, spark.createDataFrame([(1, ASKED)], ITEMS), cut=True).collect()}


@pytest.mark.parametrize("k", range(1 + sum(map(len, CHANGES.values()))))
def test_one_slot_filled_anew(variants, k):
    assert k in variants[1], variants[0][k]


def test_readings_agree_word_for_word(spark):
    """The templates with and without values have the same words, as tiles and alignments need it."""
    rng = random.Random(73)
    texts = [around(filled(question(rng), rng), rng) for _ in range(50)] + ["", "5 KM Twelve Monkeys twenty five Million 7 7", "Ten hours OF One 3,5km. New York"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    short = {r[0]: r[1:] for r in d._readings(df, "text").select("doc_id", d.words(d.F.col("template")), d.words(d.F.col("plain")), d.words(d.F.col("raw"))).collect()}
    for r in d._kept(df, "text", ["doc_id"]).collect():
        assert len(r["template"]) == len(r["value"])
        template, plain, raw = short[r["doc_id"]]
        own = tokens(texts[r["doc_id"]])
        if r["reading"] == d.TEMPLATE:
            assert r["template"] == template == [t for t, _ in own[0]]
        else:
            assert r["value"] == raw == [v for _, v in own[1]] and len(plain) == len(raw) and r["template"] == [t for t, _ in own[1]]


def test_frequent_windows_of_placeholders_meet_nothing(spark):
    """Number tables share no template; an item that is one is found word for word."""
    rows = lambda k: " ".join(str(k * i % 97 + 2) for i in range(1, 40))
    docs = spark.createDataFrame([(k, rows(k)) for k in range(2, 30)], DOCS)
    items = spark.createDataFrame([(5, rows(5))], ITEMS)
    assert [tuple(r) for r in d.leaks(docs, items, cut=True).select("doc_id", "item_id").collect()] == [(5, 5)]


def test_very_long_texts_of_one_kind(spark):
    """Names, numbers and number words without end, in one text each, around an item."""
    item = "a boat leaves port at dawn with 12 crates and Anna counts them twice before noon each day"
    docs = spark.createDataFrame([(k, f"{w * 200_000}{item} {w * 200_000}") for k, w in enumerate(("WORD ", "12 ", "twelve ", "x", "5km "))], DOCS)
    got = d.leaks(docs, spark.createDataFrame([(1, item)], ITEMS), cut=True).select("doc_id").collect()
    assert sorted(r[0] for r in got) == [0, 1, 2, 3, 4]
