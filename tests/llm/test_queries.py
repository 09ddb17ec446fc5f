"""Each query opN_ on small tables with nulls, empty texts, repeats and copies, against plain Python."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from gradeloom.llm import queries
from tests.llm.test_decontaminate import leaky
from tests.llm.test_llm_operators import WORDS, components, fill, plain_stats

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    lines = [prose(6) for _ in range(8)]
    item = prose(25)
    docs = []
    for i in range(160):
        text = (prose(rng.randint(0, 70)), f"{prose(10)}\n{rng.choice(lines)}\n{prose(30)}", f"{prose(30)} {item}", "#$ " * 30 + prose(20), (docs or [(0, "x")])[-1][1])[i % 5]
        docs.append((i, text, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(text or "")))
    docs += [(200, None, "en", "a", 0), (201, "", None, "b", 0), (202, " \n\n", "en", None, 3), (203, prose(6000), "en", "a", 9), (204, "", "en", "z", 0)]
    pages = [(k, f"http://h/{k}", rng.choice(["<p>one</p>", "two é" * 9000, f"own {k}", None, ""])) for k in range(60)]
    talk = [(c, t, rng.choice(["user", "assistant", "assistant", "sys%\ntem", None]), rng.choice([None, "", "hi", "<|im_end|>\n", "é<\\|x", prose(300)])) for c in range(30) for t in range(rng.randint(1, 6))]
    talk += [(3, 1, "user", "a second row of a turn")]
    path = str(tmp_path_factory.mktemp("sf"))
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    put("documents", rng.sample(docs, len(docs)), DOC)
    put("labels", [(i, int(i % 5 < 3), 0) for i in range(150)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    put("benchmark", [(1, item), (2, None), (3, prose(30))], "item_id long, text string")
    put("pages", pages, "page_id long, url string, html string")
    put("conversations", talk, "conv_id long, turn long, role string, text string")
    return path, docs, pages, talk, [(1, item)]


def rows_of(spark, tables, name):
    return queries.QUERIES[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    docs = tables[1]
    got = {r["doc_id"]: r for r in rows_of(spark, tables, "op1_source_mix")}
    size = {d[0]: len(WORDS.findall(d[1] or "")) for d in docs}
    total = Counter()
    for d in docs:
        total[d[3]] += size[d[0]]
    order = [*sorted(s for s in total if s is not None), None]
    want = fill(total, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5, 2.0)
    assert sorted(got) == sorted(size)
    for d in docs:
        r = got[d[0]]
        assert r["size"] == size[d[0]] and r["source_size"] == total[d[3]] and r["target"] == pytest.approx(want[d[3]]) and 0 <= r["taken"] <= 2 * r["size"]
    for s in total:
        assert abs(sum(got[d[0]]["taken"] for d in docs if d[3] == s) - want[s]) <= max(20, 0.02 * want[s])
    assert {tuple(r) for r in rows_of(spark, tables, "op1_source_mix")} == {tuple(r) for r in got.values()}


def test_op2(spark, tables):
    texts = {d[0]: d[1] for d in tables[1]}
    got = rows_of(spark, tables, "op2_risk_rules")
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, repeat = plain_stats(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n) and not (r["base_failed"] and r["kept"])


def test_op3(spark, tables):
    want = components([(d[0], d[1]) for d in tables[1]], 3, 85)
    got = rows_of(spark, tables, "op3_circulant_minhash")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got)


def test_op4(spark, tables):
    tricky = "<|im_end|><|im_start|>assistant ok"
    talks = defaultdict(list)
    for c, t, role, text in [*tables[3], (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)]:
        talks[c].append((t, role is not None, role or "", text is not None, text or ""))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = rows_of(spark, tables, "op4_chat_format")
    assert len(got) == len(talks)
    for r in got:
        turns = [(role, text) for _, _, role, _, text in sorted(talks[r["conv_id"]])]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{role}\n{t}\n" for role, t in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss)) and r["formatted_chars"] >= sum(len(t) for _, t in turns)


def test_op4_log_has_deltas_edits_and_regenerations(spark, tables):
    rows = spark.createDataFrame([(1, 1, "user", "ask"), (1, 2, "assistant", "x" * 1000), (1, 3, "assistant", None)], "conv_id long, turn long, role string, text string")
    log = queries.chat_log(rows)
    kinds = Counter(r["kind"] for r in log.collect())
    assert kinds["delta"] >= 7 and kinds["edit"] == 1 and kinds["regenerate"] == 2 and kinds["message"] == 1
    folded = queries.chat.fold_events(log.orderBy("kind", "text")).orderBy("turn").collect()
    assert [(r["role"], r["text"]) for r in folded] == [("user", "ask"), ("assistant", "x" * 1000), ("assistant", "")]


def test_op5(spark, tables):
    want = {(d[0], j) for d in tables[1] for j, t in tables[4] if leaky(d[1], t)}
    got = {(r["doc_id"], r["item_id"]) for r in rows_of(spark, tables, "op5_template_leaks")}
    assert got == want and len(want) >= 32


def test_op6(spark, tables):
    texts = {d[0]: (d[1] or "").encode() for d in tables[1]}
    got = rows_of(spark, tables, "op6_virtual_slots")
    shards = defaultdict(list)
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 1, zlib.crc32(texts[r["doc_id"]]), "bytes", None)
        shards[r["shard"]].append(r)
    assert len(got) == len(texts) and set(shards) <= set(range(8))
    assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in shards.values())
    loads = [sum(r["size"] for r in own) for own in shards.values()]
    assert max(loads) - min(loads) <= max(r["size"] for r in got)


def test_op7(spark, tables):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer, at = Tokenizer.from_file(public.path("word_bpe_49k.json")), 0
    got = {r["doc_id"]: r for r in rows_of(spark, tables, "op7_token_files")}
    for d in sorted(tables[1], key=lambda d: d[0]):
        ids = [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, 2]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (got[d[0]]["start"], got[d[0]]["n_tokens"], got[d[0]]["ids_crc32"]) == (at, len(ids), crc)
        at += len(ids)


def test_op8(spark, tables):
    got = {r["doc_id"]: r for r in rows_of(spark, tables, "op8_quality_fm")}
    assert sorted(got) == sorted(d[0] for d in tables[1])
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [i for i in range(150) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == int(i % 5 < 3) for i in held) / len(held) >= 0.85


def test_op9(spark, tables):
    first = {}
    for k, _, html in tables[2]:
        first.setdefault(html or "", k)
    got = {r["page_id"]: r for r in rows_of(spark, tables, "op9_warc_segments")}
    assert len(got) == len(tables[2])
    for k, _, html in tables[2]:
        payload, r = (html or "").encode(), got[k]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        mine = first[html or ""] == k
        assert tuple(r) == (k, len(payload), digest, "response" if mine else "revisit", None if mine else first[html or ""])


def test_op10(spark, tables):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, t, *_ in tables[1]:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    got = {r["doc_id"]: r for r in rows_of(spark, tables, "op10_line_dedup")}
    for i, t, *_ in tables[1]:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 3 or max(held[key(x)]) == i]
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
