"""Each dealt operator against plain Python on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import datetime
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gradeloom.llm import chat, decontaminate, line_dedup, mixing, near_dedup, quality_fm, quality_rules, sharding, token_files, warc
from gradeloom.llm.common import n_words, scratch_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, size int, shard string"


def make_docs(spark, rows):
    """Rows of (doc_id, text[, source]) with extra columns whose names clash with those of operators."""
    full = [(i, t, "en", rest[0] if rest else "s", len(t or ""), 7, "x") for i, t, *rest in rows]
    return spark.createDataFrame(full, DOC)


@pytest.fixture(scope="module")
def vocabulary():
    random.seed(8)
    return ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(400)]


def prose(vocabulary, n):
    return " ".join(random.choice(vocabulary) for _ in range(n))


def test_n_words(spark):
    texts = [None, "", " \t\n", "a", " a\x0bb\rc ", "é ü\x1fz q"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(F.col("t"))).collect()]
    assert got == [len(WORDS.findall(t or "")) for t in texts]


# ---- op1


def fill(sizes, weights, ratio, most):
    """Water-filling by rounds of clamping."""
    budget, open_, target = ratio * sum(sizes.values()), set(sizes), {}
    while open_:
        left = budget - sum(target.values())
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            open_.remove(s)
    return target


def test_mix_targets_and_sampling(spark, vocabulary):
    rows = [(i, prose(vocabulary, random.randint(0, 60)), random.choice(["a", "b", "c", "d", "hot", "hot", "hot", None])) for i in range(900)]
    # "capped" gets twice its size and no further copy, of its empty texts neither
    rows += [(None, None, "a"), (5, rows[5][1], rows[5][2]), (901, "", "empty"), *[(910 + k, "" if k % 2 else prose(vocabulary, 5), "capped") for k in range(40)]]
    out = mixing.mix_sources(make_docs(spark, rows)).collect()
    assert len(out) == len(rows) and {r["size"] for r in out} == {7}
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    for s in sizes:
        mine = [r for r in out if r["source"] == s]
        assert mine[0]["mix_target"] == pytest.approx(want[s]) and mine[0]["mix_source_size"] == sizes[s]
        assert abs(sum(r["mix_copies"] * r["mix_size"] for r in mine) - want[s]) <= 5
        assert all(0 <= r["mix_copies"] <= 2 for r in mine)
    again = mixing.mix_sources(make_docs(spark, random.sample(rows, len(rows)))).collect()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["source"] or "", r["mix_copies"])
    assert sorted(map(key, again)) == sorted(map(key, out))
    clash = make_docs(spark, rows[:9]).selectExpr("*", "1 AS mix", "2 AS mix_key", "3 AS mix_u", "4 AS mix_n", "5 AS mix_size")
    assert [c for c in mixing.expand(mixing.mix_sources(clash)).columns if c.startswith("mix")] == ["mix", "mix_key", "mix_u", "mix_n"]
    assert mixing.expand(mixing.mix_sources(make_docs(spark, rows))).columns == DOC.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_passes_over_huge_documents(spark, seed):
    random.seed(seed)
    sizes = {"mixed": [random.randint(1, 30) for _ in range(300)] + [2500] * 6, "huge": [3000, 4000, 5000], "small": [3] * 50, "lone": [9]}
    rows = [(i, " ".join(["w"] * n + [f"{s}{k}"]), s) for i, (s, k, n) in enumerate((s, k, n) for s, ns in sizes.items() for k, n in enumerate(ns))]
    out = mixing.mix_sources(make_docs(spark, rows), seed=seed).collect()
    for s, ns in sizes.items():
        mine = [r for r in out if r["source"] == s]
        off = abs(sum(r["mix_copies"] * r["mix_size"] for r in mine) - mine[0]["mix_target"])
        assert off <= {"mixed": 3, "huge": 2501, "small": 2, "lone": 5}[s] and off <= max(ns)
        assert all(0 <= r["mix_copies"] <= 2 for r in mine)


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(make_docs(spark, [])).count() == 0
    assert [r["mix_copies"] for r in mixing.mix_sources(make_docs(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# ---- op2


def plain_stats(t):
    w = WORDS.findall(t or "")
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics(vocabulary):
    p = prose(vocabulary, 12)
    texts = [None, "", "\n", "\n\n", "a", "x\ny\nx\n x\nx", f"{p} {p}", f"{p}\n{p}\n", "a " * 30, "#é| <ü> \x0b$", f"{p}\n\n{p}", "one two\n", "\nz", prose(vocabulary, 3000)]
    got = np.array(quality_rules.statistics(pa.array(texts))[:5]).T.tolist()
    assert [tuple(g) for g in got] == [plain_stats(t) for t in texts]


@pytest.mark.parametrize(("k", "n"), [(0, 60), (3, 200), (50, 50), (0, 0), (40, 5000)])
def test_exact_bound(k, n):
    from math import comb

    bound = quality_rules.upper_bound(k, n, 0.05)
    if k >= n:
        assert bound == 1.0
    elif n <= 200:
        assert sum(comb(n, i) * bound**i * (1 - bound) ** (n - i) for i in range(k + 1)) == pytest.approx(0.05, rel=1e-6)
    else:
        assert k / n < bound < 2 * k / n


def test_rules_reject_junk_and_bound_false_rejections(spark, vocabulary):
    rows = [(i, prose(vocabulary, 80) if i % 8 else "### $$$ " * 20 + prose(vocabulary, 30)) for i in range(1600)] + [(None, None), (3000, "")]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 8 > 0), 0) for i in range(0, 1600, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    stats = quality_rules.rule_stats(docs)
    base = F.col("n_words") < 20
    out = {r["id"]: r for r in quality_rules.apply_rules(stats, quality_rules.calibrate(stats, labels, base=base), base).collect()}
    good = [out[i]["kept"] for i in range(1600) if i % 8]
    assert sum(good) / len(good) > 0.95 and not any(out[i]["kept"] for i in range(0, 1600, 8)) and not out[3000]["kept"]
    none = quality_rules.calibrate(stats, labels.limit(0), base=base)
    assert none.count() == 0 and quality_rules.apply_rules(stats, none, base).filter("kept").count() > 1500
    assert quality_rules.rule_stats(docs.limit(0)).count() == 0


# ---- op3


def shingles(t, n):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, percent):
    sets = {i: shingles(t, n) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_groups_against_all_pairs(spark, vocabulary, monkeypatch, n, percent):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = [prose(vocabulary, 60) for _ in range(12)]
    for t in list(texts):
        w = t.split(" ")
        for changes in (0, 0, 1, 2, 2, 3, 3, 4, 5, 6, 8):
            v = list(w)
            for _ in range(changes):
                v[random.randrange(len(v))] = random.choice(vocabulary)
            texts.append(" ".join(v))
    shared = prose(vocabulary, 40)  # a passage that many different documents share
    texts += [f"{shared} {prose(vocabulary, k % 15)}" for k in range(40)] + ["", " \n", "one", "One", "one two", prose(vocabulary, 5000).upper()]
    rows = [(i * 3, t) for i, t in enumerate(random.sample(texts, len(texts)))] + [(9999, None)]
    docs = make_docs(spark, rows + [(None, "one")])
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(docs, n, percent).collect()}
    assert got.pop(None)[1] is None
    assert got == components(rows, n, percent)
    kept = near_dedup.keep_one(docs.unionByName(docs), near_dedup.near_groups(docs.unionByName(docs), n, percent))
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(i for i, (_, c) in got.items() if c == i)


def test_rows_that_share_an_id_share_a_component(spark, vocabulary):
    a, b, c = (prose(vocabulary, 50) for _ in range(3))
    docs = make_docs(spark, [(3, a), (5, a), (5, b), (9, b), (7, c), (8, "")])
    found = near_dedup.near_groups(docs)
    assert {r["id"]: r["component_id"] for r in found.collect()} == {3: 3, 5: 3, 9: 3, 7: 7, 8: 8}
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(docs, found).collect()) == [3, 7, 8]
    twice = make_docs(spark, [(1, a), (1, b), (2, c)]).selectExpr("*", "1 AS gone", "2 AS again", "3 AS place")
    one = [[tuple(r) for r in near_dedup.keep_one(t, near_dedup.near_groups(t)).orderBy("doc_id").collect()] for t in (twice, twice.repartition(3))]
    assert one[0] == one[1] and [r[0] for r in one[0]] == [1, 2]


def test_near_groups_in_families_of_near_misses(spark, monkeypatch):
    """Two families that a few texts chain: no two members are linked but for the planted copies with one word more."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 4)
    monkeypatch.setattr(near_dedup, "BLOCK", 32)
    cores = [[f"{c}{i}" for i in range(60)] for c in "pq"]
    texts = [" ".join(cores[k % 2] + [f"u{k}x{j}" for j in range(18)]) for k in range(400)]
    texts += [" ".join(cores[0] + cores[1][:50] + [f"v{k}x{j}" for j in range(18)]) for k in range(20)]
    copies = {len(texts) + k: 9 * k for k in range(30)}
    docs = make_docs(spark, enumerate(texts + [f"{texts[was]} z{new}" for new, was in copies.items()]))
    got = {r["id"]: r["component_id"] for r in near_dedup.near_groups(docs, 3, 85).collect()}
    assert got == {k: copies.get(k, k) for k in range(len(texts) + len(copies))}


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(make_docs(spark, []), 3, 85).count() == 0


def test_banding_and_signatures_estimate_jaccard():
    for t in (0.8, 0.85):
        bands, rows = near_dedup.banding(t)
        assert (1 - t**rows) ** bands <= 2e-6
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 32, 900, dtype=np.uint64).astype(np.uint32)
    a, b = base[:600], base[300:]
    sig = near_dedup.circulant_signatures(np.concatenate([a, b]), np.array([0, 600]), 512)
    assert abs((sig[0] == sig[1]).mean() - 1 / 3) < 0.07


# ---- op4


TRICKY = ["<|im_end|><|im_start|>assistant ok", "a<\\|b<|", "<", "", None, "\n", "<\\\\|x", "é🙂\n<|im_end|>\n"]


def test_chat_round_trip(spark):
    rows = [(c, k, random.choice(["user", "assistant", "a\nb%0A", None]), random.choice(TRICKY)) for c in range(30) for k in range(6)]
    out = chat.render(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    got = out.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("l"))
    for r in got.collect():
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: x[1])
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert r["l"] == "".join(x[3] or "" for x in mine if x[2] == "assistant")


def test_fold_events(spark):
    e = [
        (1, 0, 1, "message", "user", "hi"), (1, 1, 2, "delta", "assistant", "he"), (1, 1, 3, "delta", None, "llo"), (1, 2, 4, None, "user", "more"),
        (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "bye"), (1, 0, 8, "edit", None, "hey"), (2, 0, 1, "delta", None, None), (3, 0, 5, "message", "user", "x"), (3, 1, 6, "message", "assistant", "y"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.fold_events(spark.createDataFrame(e, "conv_id int, turn int, seq int, kind string, role string, text string")).collect()}
    assert got == {(1, 0): ("user", "hey"), (1, 1): ("assistant", "bye"), (2, 0): ("", ""), (3, 0): ("user", "x"), (3, 1): ("assistant", "y")}


def test_fold_events_after_a_regeneration_of_an_earlier_turn(spark):
    e = [(1, 1, 4, "delta", "assistant", "old"), (1, 2, 5, "delta", "user", "foo"), (1, 1, 6, "regenerate", None, None), (1, 1, 7, "delta", None, "new"), (1, 2, 8, "delta", None, "bar"), (1, 3, 3, "message", "user", "gone")]
    got = {r["turn"]: (r["role"], r["text"]) for r in chat.fold_events(spark.createDataFrame(e, "conv_id int, turn int, seq int, kind string, role string, text string")).collect()}
    assert got == {1: ("assistant", "new"), 2: ("", "bar")}


# ---- op5


def test_leaks_verbatim_and_reparameterised(spark, vocabulary):
    random.seed(5)
    item = "If the train leaves at 5 km from Paris with Anna and 12 bags then how many bags and people does the train with Anna carry past Paris after 5 hours"
    other = item.replace("12", "40").replace("Anna", "Bob").replace("5", "7").replace("Paris", "Rome")
    clash = item.replace("Anna and 12", "Bob and 12")  # one name of the item becomes two
    filler = prose(vocabulary, 100)
    short = "seven short words make up this item"
    rows = [(1, f"{filler} {item} {filler}"), (2, f"{filler} and {other}."), (3, filler), (4, None), (5, ""), (6, item.upper()), (7, f"{filler} {short} {filler}"), (8, " ".join(item.split()[:9]) + " " + filler), (9, f"{filler}. {clash}"), (None, item)]
    items = spark.createDataFrame([(10, item), (11, short), (12, None), (13, "")], "item_id long, text string")
    found = decontaminate.leaks(make_docs(spark, rows), items)
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert got == {(1, 10), (2, 10), (6, 10), (7, 11), (None, 10)}
    left = sorted(r["doc_id"] for r in decontaminate.drop_leaks(make_docs(spark, rows), found).collect())
    assert left == [3, 4, 5, 8, 9]
    assert decontaminate.leaks(make_docs(spark, []), items).count() == 0 and decontaminate.leaks(make_docs(spark, rows), items.limit(0)).count() == 0


def test_every_offset_of_a_passage_is_found(spark, vocabulary):
    random.seed(6)
    item = prose(vocabulary, 13)
    rows = [(k, f"{prose(vocabulary, k)} {item} {prose(vocabulary, 20)}") for k in range(1, 25)]
    found = decontaminate.leaks(make_docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r["doc_id"] for r in found.collect()) == list(range(1, 25))


def test_leaks_beside_a_conflict_and_verbatim_slots(spark, vocabulary):
    random.seed(9)
    item = "If the train leaves at 5 km from Paris with Anna and 12 bags then how many bags and people does the train with Anna carry past Paris after 5 hours"
    filler = prose(vocabulary, 40)
    numbers = " ".join(f"{k} {w} {k + 1} {k + 2}" for k, w in zip(range(100, 190, 9), vocabulary))
    rows = [(1, f"{filler}. {item.replace('Anna and 12', 'Bob and 12')}"), (2, f"{filler} {numbers}"), (3, f"{filler} {numbers.translate(str.maketrans('123456789', '234567891'))}"), (4, filler)]
    rows.append((5, " ".join([*item.split()[:12], "word", *item.split()[13:]]).replace("people does the train with Anna", "people does the train with Bob")))
    items = spark.createDataFrame([(10, item), (11, numbers)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["run"], r["literal"]) for r in decontaminate.leaks(make_docs(spark, rows), items, cut=True).collect()}
    # 1: up to the second Anna, one slot is not literal; 2: all slots are the item's; 5: after the place that differs
    assert got == {(1, 10): (24, 23), (2, 11): (40, 40), (5, 10): (18, 17)}


def test_leaks_of_every_form_of_numbers_and_names(spark, vocabulary):
    random.seed(10)
    filler = prose(vocabulary, 40)
    pairs = [
        ("a tank holds 3.5 litres and gains 1,200 drops in each hour so how full is it", "a tank holds 4 litres and gains 900 drops in each hour so how full is it"),
        ("a van drove 5km on the 3rd trip and carried 20kg of sand for each of its owners", "a van drove 7 km on the 14th trip and carried 30kg of sand for each of its owners"),
        ("Natalia sold nine clips in spring. Natalia sold eight more.\nWeng gave \"Ann\" (Lee) some", "Maria sold nine clips in spring. Maria sold eight more.\nJose gave \"Eve\" (Kim) some"),
        ("MARTHA picks ten apples. JOHN picks six pears. MARTHA eats two pears. JOHN eats one", "ESTHER picks ten apples. PETER picks six pears. ESTHER eats two pears. PETER eats one"),
        ("The boat With Sails Left port at nine and came Back Home when rain fell on us", "the boat with sails left port at nine and came back home when rain fell on us"),
    ]
    items = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(pairs)], "item_id long, text string")
    rows = [(i, f"{prose(vocabulary, i)} {filler}. {other}. {filler}") for i, (_, other) in enumerate(pairs)] + [(9, filler)]
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(make_docs(spark, rows), items, cut=True).collect())
    assert got == [(i, i) for i in range(len(pairs))]


# ---- op6


def test_sharding(spark):
    rows = [(i, "x" * random.randint(0, 500)) for i in range(2000)] + [(None, None)] * 3 + [(7, "same")] * 5
    docs = make_docs(spark, rows).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1)
    path = scratch_path(spark, "map")
    out = sharding.shard_records(docs, path, 8, 512, key_cols=("doc_id",), size=F.col("size")).collect()
    assert len(out) == len(rows)
    loads = Counter()
    for r in out:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 8
    for k in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    first, second = sharding.load_map(spark, path, 1), sharding.load_map(spark, path)
    assert first.count() == 512 and second.first()["version"] == 2
    records = docs.withColumn("virtual_slot", sharding.slot_of(("doc_id",), 512))
    grown = {r["slot"]: r["shard"] for r in sharding.grow(second, sharding.slot_loads(records, F.col("size")), 8).collect()}
    was = {r["slot"]: r["shard"] for r in second.collect()}
    assert all(grown[s] in (was[s], 8) for s in was) and sum(v == 8 for v in grown.values()) > 20
    assert sharding.shard_records(docs.limit(0), scratch_path(spark, "map"), size=F.col("size")).count() == 0


# ---- op7


def test_token_files(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    alphabet = [*"abcXYZ019'.,!-_<|>éÉßÿ×ªµÀöø İΣς́­漢🙂\x1f", "<|endoftext|>", "'ll", "\n", "\t"]
    rows = [(i, "".join(random.choice(alphabet) for _ in range(random.randint(0, 60)))) for i in range(300)] + [(400, None), (401, ""), (402, "word " * 9000)]
    files = token_files.write_tokens(make_docs(spark, random.sample(rows, len(rows))), str(tmp_path), path, 2, sequence=64)
    got = {r["doc_id"]: r for r in token_files.read_tokens(files).collect()}
    plain, at = Tokenizer.from_file(path), 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"]) == (at, len(ids)) and bytes(got[i]["ids"]) == ids.tobytes()
        at += len(ids)
    ids, mask = token_files.sequence_at(files.orderBy("part").first()["file"], 0)
    assert len(ids) == len(mask) == 64
    assert token_files.read_tokens(token_files.write_tokens(make_docs(spark, []), str(tmp_path), path, 2)).count() == 0


def test_other_tokenizers_are_right_or_refused(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    import glob
    import os

    from tokenizers import Tokenizer

    folder = os.path.dirname(public.path("word_bpe_49k.json"))
    text = "Don't split THIS 123 naïve word's, 4,500.25 (see) x!!y Straße"
    for path in sorted(glob.glob(f"{folder}/*.json"))[:6]:
        try:
            plain = Tokenizer.from_file(path)
        except Exception:
            continue
        try:
            encoder = token_files.WordEncoder(path)
        except ValueError:
            continue
        ids, _ = encoder.texts(pa.array([text]), 2)
        assert ids.tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], path


# ---- op8


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    fm = quality_fm.FactorisationMachine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    number, value = np.array([3, 7, 20, 41]), rng.normal(size=4)
    pairs = sum(fm.v[number[i]] @ fm.v[number[j]] * value[i] * value[j] for i in range(4) for j in range(i))
    assert fm.raw(number, value, np.array([0, 4]))[0] == pytest.approx(0.3 + fm.w[number] @ value + pairs)


def test_classifier_learns_and_holds_out(spark, vocabulary):
    rows = [(i, prose(vocabulary, 60) if i % 4 else " ".join(f"{w.upper()}!!" for w in prose(vocabulary, 40).split())) for i in range(800)] + [(900, None), (901, ""), (902, "x " * 20000)]
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(800)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    machine = quality_fm.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality_fm.score(docs, machine).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scores[i] >= 0.7) == (i % 4 > 0) for i in held) / len(held) > 0.97
    assert all(0 <= s <= 1 for s in scores.values()) and len(scores) == len(rows)
    flipped = labels.withColumn("quality", F.when(quality_fm.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality_fm.train(docs, flipped).w, machine.w)
    blank = quality_fm.train(docs, labels.limit(0))
    assert {r["score"] for r in quality_fm.score(docs, blank).collect()} == {0.5}


# ---- op9


def test_warc_round_trip(spark, tmp_path):
    big = "".join(random.choice("abc\r\né") for _ in range(90_000))
    pages = [(1, "http://a/é b", "<p>x</p>"), (2, None, big), (3, "u", "<p>x</p>"), (4, "u", None), (5, "u", ""), (6, "u\r\nWARC-Type: bad", big), (None, "u", "lost"), (8, "u", "0\r\n\r\n")]
    date = datetime.datetime(2024, 2, 3, 4, 5, 6, tzinfo=datetime.UTC)
    files = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w", date=date)
    records = warc.read_warc(files).cache()
    assert records.filter("record_type = 'continuation'").count() >= 5 and {r["date"] for r in records.collect()} == {"2024-02-03T04:05:06Z"}
    got = {r["page_id"]: r for r in warc.payloads(warc.reassemble(records)).collect()}
    assert set(got) == {1, 2, 4, None, 8} and all(r["ok"] for r in got.values())
    assert {i: bytes(r["payload"]).decode() for i, r in got.items()} == {1: "<p>x</p>", 2: big, 4: "", None: "lost", 8: "0\r\n\r\n"}
    pages_of = {r["record_id"]: i for i, r in got.items()}
    assert {r["page_id"]: pages_of[r["refers_to"]] for r in records.filter("record_type = 'revisit'").collect()} == {3: 1, 5: 4, 6: 2}
    cut = records.filter("not (segment_number <=> 3)")
    assert [r["page_id"] for r in warc.payloads(warc.reassemble(cut)).filter("not ok").collect()] == [2]
    empty = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.read_warc(empty).count() == 0


def test_pages_are_read_in_one_pass(spark, tmp_path):
    big = "".join(random.choice("abc\r\né") for _ in range(90_000))
    pages = [(1, "u", "<p>x</p>"), (2, None, big), (3, "u", "<p>x</p>"), (4, "u", None), (5, "u", ""), (6, "u", big), (None, "u", "lost"), (8, "u", "0\r\n\r\n"), (9, "u", "z" * 3_000_000), (1, "v", "<p>x</p>")]
    files = warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    rows = warc.read_pages(files.repartition(3))
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    got = rows.collect()
    assert len(got) == len(pages) and all(r["ok"] for r in got)
    want = {(i, hashlib.sha1((h or "").encode()).digest()) for i, _, h in pages}
    assert {(r["page_id"], base64.b32decode(r["payload_digest"])) for r in got} == want
    names = {r["record_id"]: r["page_id"] for r in got if r["record_type"] == "response"}
    assert len(names) == 7 and sorted((r["page_id"], names[r["refers_to"]]) for r in got if r["record_type"] == "revisit") == [(3, 1), (5, 4), (6, 2)]
    assert {r["page_id"]: r["payload_bytes"] for r in got if r["record_type"] == "response"} == {i: len((h or "").encode()) for i, _, h in pages if i not in (3, 5, 6)}
    # without the archives of the continuations, or with them twice, segmented records aren't whole
    main = files.filter("file not like '%continued%'")
    assert sorted(r["page_id"] for r in warc.read_pages(main).filter("not ok").collect()) == [2, 9]
    assert {r["page_id"] for r in warc.read_pages(files.unionByName(files.filter("file like '%continued%'"))).filter("not ok").collect()} == {2, 9}
    assert {r["page_id"] for r in warc.read_pages(files.filter("file like '%continued%'")).collect()} == {None}
    assert warc.read_pages(files.limit(0)).count() == 0


def test_long_documents_are_read_alone(spark, tmp_path, monkeypatch):
    """A text of two million words among a thousand short ones."""
    public = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(token_files, "SLAB_IDS", 5000)
    docs = spark.createDataFrame([(k, f"word {k}") for k in range(1000)] + [(500, "so many words " * 700_000)], "doc_id long, text string").coalesce(1)
    files = token_files.write_tokens(docs, f"file://{tmp_path}/t", public.path("word_bpe_49k.json"), 2)
    got = token_files.read_tokens(files).select("doc_id", "start", "n_tokens", F.octet_length("ids").alias("size")).orderBy("start").collect()
    assert len(got) == 1001 and all(r["size"] == 4 * r["n_tokens"] for r in got) and max(r["n_tokens"] for r in got) > 2_000_000
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_warc_repeated_rows(spark, tmp_path):
    pages = [(1, "b", "same"), (1, "a", "same"), (1, "a", "same"), (2, "u", "same"), (None, "u", "same"), (1, "u", "other"), (3, None, "other")]
    records = warc.read_warc(warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string"), f"file://{tmp_path}/r")).cache()
    ids = [r["record_id"] for r in records.collect()]
    assert len(ids) == len(set(ids)) == len(pages)
    responses = {r["record_id"]: r["page_id"] for r in warc.payloads(warc.reassemble(records)).filter("ok").collect()}
    assert sorted(responses.values()) == [1, 1, 1, 1]
    assert sorted((r["page_id"] or 0, responses[r["refers_to"]]) for r in records.filter("record_type = 'revisit'").collect()) == [(0, 1), (2, 1), (3, 1)]


def test_broken_archives_are_reported(spark, tmp_path):
    files = warc.write_warc(spark.createDataFrame([(k, "u", f"page {k}" * 9000) for k in range(3)], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    path = next(r["file"] for r in files.collect() if "continued" not in r["file"]).removeprefix("file://")
    whole = open(path, "rb").read()

    def read(content, strict=False):
        with open(path, "wb") as f:
            f.write(content)
        return warc.read_warc(files, strict).collect()

    assert [r["error"] for r in read(whole)] == [None] * len(read(whole))
    assert [r["error"] for r in read(whole[:-7])].count("truncated gzip member") == 1
    assert any("broken gzip member" in (r["error"] or "") for r in read(whole[:40] + b"\0" * 40 + whole[80:]))
    bare = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n")
    assert "header lacks warc-record-id, warc-date" in {r["error"] for r in read(bare + whole)}
    short = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nWARC-Date: d\r\nContent-Length: 99\r\n\r\nabc")
    assert "block shorter than its stated length" in {r["error"] for r in read(short)}
    for content in (whole[:-7], bare):
        with pytest.raises(Exception, match="truncated|lacks"):
            read(content, strict=True)


def test_chunked_framing():
    for n in (0, 1, 4096, 4097, 20_000):
        body = random.Random(n).randbytes(n)
        assert warc.unchunk(warc.chunked(body)) == body
    assert warc.unchunk(b"5\r\nab") is None and warc.unchunk(b"zz\r\n") is None and warc.unchunk(b"") is None
    assert warc.unchunk(b"2;x=1\r\nab\r\n0\r\n\r\n") == b"ab"


# ---- op10


def test_line_dedup(spark):
    shared = [f"this is the shared line number {k}" for k in range(30)]
    rows = [(i, "\n".join(random.choice([*shared, f"own line of {i} that is long", "short", "", f"  {random.choice(shared).upper()}\t"]) for _ in range(random.randint(0, 12)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "\n"), (None, shared[0]), (503, "é" * 19 + "\n" + "é" * 20), (504, "é" * 20), (505, "É" * 20), (506, "é" * 20 + "\r")]
    holders = {}
    key = lambda x: (lambda k: k if len(k) >= 20 else None)("".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")))
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None}:
            holders.setdefault(k, []).append(i)
    out = line_dedup.dedup_lines(make_docs(spark, rows), keys_per_shard=7)
    for r in out.collect():
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if not (key(x) and len(holders[key(x)]) >= 3 and max(i for i in holders[key(x)] if i is not None) != r["doc_id"])]
        assert (r["n_lines"], r["n_dropped"], r["kept_text"]) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    assert line_dedup.dedup_lines(make_docs(spark, [])).count() == 0


def test_index_holds_all_lines_and_their_counts(spark, tmp_path):
    texts = ["\n".join(f"line number {k} of the whole corpus" for k in range(300) if k % (i + 1) == 0) for i in range(9)]
    root = f"file://{tmp_path}/index"
    n_shards = line_dedup.build_index(make_docs(spark, list(enumerate(texts))), root, 20, 3, "doc_id", "text", 50)
    assert n_shards == 6
    keys = [f"line number {k} of the whole corpus".encode() for k in range(300)] + [b"a line that no document has at all"]
    counts, keepers = line_dedup.LineIndex(root, n_shards).look_up(b"".join(line_dedup.line_key(k, 20) for k in keys))
    held = [[i for i in range(9) if k % (i + 1) == 0] for k in range(300)]
    assert counts.tolist() == [*map(len, held), 0]
    assert [x for x, h in zip(keepers.tolist(), held) if len(h) >= 3] == [h[-1] for h in held if len(h) >= 3]


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    for n in (0, 1, 63, 5000):
        hi, lo = rng.integers(0, 2**63, (2, n), dtype=np.uint64)
        index = line_dedup.PerfectHash.build(hi, lo)
        assert sorted(index.place(hi, lo)) == list(range(n))


def test_digests():
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_copies_are_one_trial(spark):
    """A stratum of one good text, however often it is labelled, certifies nothing."""
    docs = spark.createDataFrame([(k, "plain words of a text that stands here many times " * 3, "en") for k in range(400)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    assert [r["cutoffs"] for r in quality_rules.calibrate(quality_rules.rule_stats(docs), labels).collect()] in ([], [None])
