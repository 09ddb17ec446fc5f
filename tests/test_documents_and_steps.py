"""Logs by ranges and JSON documents by elements against Python's own readers; steps of a stream in any order of arrival."""

import gzip
import io as std
import itertools
import json

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import monitoring, order
from gradeloom.sources import documents, io
from gradeloom.streaming import runs


@pytest.mark.parametrize("data", [b"", b"\n", b"a", b"one\r\n\ntwo\n" + b"x" * 40 + b"\nlast", "ä\nöü\n".encode() * 5])
def test_ranges_share_out_the_lines(data):
    for size in (1, 2, 3, 7, 1000):
        got = [line for at in range(0, len(data), size) for line in documents.lines_of(std.BufferedReader(std.BytesIO(data)), at, min(at + size, len(data)))]
        assert got == data.splitlines(keepends=True)


def test_log_by_ranges(spark, tmp_path):
    (tmp_path / "_hidden.log").write_text("no\n")
    wanted = {}
    for name in ("a.log", "b.log"):
        lines = [f"step:{k}" if k % 3 else "" for k in range(100)] + ["� end"]
        (tmp_path / name).write_bytes("\r\n".join(lines).encode())
        wanted |= {(name, k): line for k, line in enumerate(lines) if line}
    (tmp_path / "c.log.gz").write_bytes(gzip.compress(b"p\nq\n"))
    wanted |= {("c.log.gz", 0): "p", ("c.log.gz", 1): "q"}
    for size in (64, 10_000):
        assert {(r["log"], r["line_no"]): r["line"] for r in io.read_log(spark, str(tmp_path), size).collect()} == wanted
    with pytest.raises(FileNotFoundError):
        io.read_log(spark, str(tmp_path / "none"))


def elements(text, part, chunk):
    return [(name, json.loads(value)) for name, value in documents.Elements(std.BytesIO(text.encode()), part, chunk)]


def test_elements_in_chunks_of_any_size():
    rows = [{"a": 'x "[{,}]" \\ ü 𝄞', "b": [1, [2, {}]]}, 12345, None, "", [], -1.5e3, True]
    document = json.dumps({"summary": {"per_prompt": [0]}, "per_prompt": rows, "more": "x"}, ensure_ascii=False, indent=1)
    texts = json.dumps({"a": "x", "*": "y", "": None})
    for chunk in (1, 2, 5, 1 << 20):
        assert elements(json.dumps(rows), "", chunk) == [(None, v) for v in rows]
        assert elements(document, "per_prompt", chunk) == [(None, v) for v in rows]
        assert elements(texts, "*", chunk) == [("a", "x"), ("*", "y"), ("", None)]
        assert elements(" [ ] ", "", chunk) == elements("{}", "*", chunk) == elements("", "*", chunk) == elements('{"per_prompt": null}', "per_prompt", chunk) == []
        assert elements("﻿123", "", chunk) == [(None, 123)] and elements('{"a": 1}', "", chunk) == [(None, {"a": 1})]
        for broken in ("[1", "[1 2]", "[1,]", "[1] x", '{"a" 1}', "["):
            with pytest.raises(ValueError):
                elements(broken, "*" if broken[0] == "{" else "", chunk)


def test_json_documents(spark, tmp_path):
    (tmp_path / "k=1").mkdir()
    (tmp_path / "k=1" / "r.json").write_text(json.dumps({"summary": {}, "per_prompt": [{"prompt_id": "p", "pred_scores": [0.5, None]}, {"prompt_id": "q"}]}))
    got = io.read_results(spark, str(tmp_path)).select("file", "prompt_id", "pred_scores").collect()
    assert sorted(map(tuple, got)) == [("r.json", "p", [0.5, None]), ("r.json", "q", None)]
    (tmp_path / "c.json").write_text('{"a": "x\\n\\"y\\"", "b": null, "a": "", "d": {"e": 1}}')
    assert sorted(map(tuple, io.read_cache_document(spark, str(tmp_path / "c.json")).collect()), key=str) == [("a", ""), ("a", 'x\n"y"'), ("b", None), ("d", '{"e":1}')]
    (tmp_path / "c.json").write_text('{"a": "x"')
    with pytest.raises(Exception, match="c.json"):
        io.read_cache_document(spark, str(tmp_path / "c.json")).collect()


FILES = [[("a", 1, 0.5), ("a", 3, 1.0), ("b", 2, 1.0)], [("a", 2, 0.0), ("a", 1, 1.0), ("b", 1, None)], [("a", 4, 0.25), (None, 7, 1.0), ("a", 3, 3.0)]]
ENDS = [("a", None, None), ("b", None, None), (None, None, None)]


def through(spark, folder, files, delay, make):
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "run string, step long, value double").coalesce(1).write.parquet(f"{folder}/in{k}")
        stream = spark.readStream.schema("run string, step long, value double").parquet(f"{folder}/in*")
        runs.run_to_files(make(stream, delay=delay), f"{folder}/out", f"{folder}/cp").awaitTermination()
    return sorted((tuple(r) for r in spark.read.parquet(f"{folder}/out").collect()), key=str)


def test_steps_in_any_order_of_arrival(spark, tmp_path):
    """Every order of the files gives the same rows, each step one of them, and the state outlives the run."""
    totals = [("a", 1, 1.5, 2, False), ("a", 2, 0.0, 1, False), ("a", 3, 4.0, 2, False), ("a", 4, 0.25, 1, False), ("b", 1, None, 0, False), ("b", 2, 1.0, 1, False), (None, 7, 1.0, 1, False)]
    orders = list(itertools.permutations(FILES))
    for k in (5,):
        assert through(spark, f"{tmp_path}/t{k}", [*orders[k], ENDS], 10, runs.step_totals) == sorted(totals, key=str)
    ema, factor, wanted = 1.0, 0.1, []
    for step, mean in ((1, 0.75), (2, 0.0), (3, 2.0), (4, 0.25)):
        ema = 0.9 * ema + 0.1 * mean
        factor = max(factor, 0.1 + 0.9 * ema)
        wanted.append((step, pytest.approx(ema), pytest.approx(factor)))
    got = through(spark, f"{tmp_path}/s", [*orders[3], ENDS], 10, runs.smooth_stream)
    assert [r[1:4] for r in got if r[0] == "a"] == wanted


def test_late_steps_are_told_and_not_lost(spark, tmp_path):
    got = through(spark, str(tmp_path), [[("a", 5, 1.0)], [("a", 4, 2.0), ("a", 5, 3.0), ("a", 6, 1.0)]], 0, runs.step_totals)
    assert got == [("a", 4, 2.0, 1, True), ("a", 5, 1.0, 1, False), ("a", 5, 3.0, 1, True), ("a", 6, 1.0, 1, False)]
    assert spark.conf.get(runs.STATE_STORE, "") == "" or "RocksDB" not in spark.conf.get(runs.STATE_STORE)


def test_order_of_a_hot_log_by_ranges(spark):
    """Numbers, last known values, averages and crossings of logs that are cut into ranges, against plain Python; a null log is one of its own."""
    rows = [(None if k % 5 == 4 else "hot" if k % 5 else "cold", k * 7919 % 1000 // 2, k, float(k * 31 % 17) if k % 6 else None) for k in range(1000)]
    df = spark.createDataFrame(rows, "log string, at long, id long, v double").withColumn("when", F.timestamp_seconds("at")).withColumn("place", F.struct("when", "id"))
    wanted, filled, averages, crossed = {}, {}, {}, {}
    for log in ("hot", "cold", None):
        last, seen = None, []
        for k, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == log), key=lambda r: r[1:3])):
            last = last if v is None else v
            if seen and seen[-1] is not None and v is not None and seen[-1] < 8 <= v:
                crossed.setdefault(log, i)
            seen.append(v)
            wanted[i], filled[i] = k, last
            if k >= 2:
                full = [x for x in seen[-3:] if x is not None]
                averages[i] = pytest.approx(sum(full) / len(full))
    for most in (10, 10_000):
        assert {r["id"]: r["k"] for r in order.number_within(df, "log", ["when", "id"], "k", most).collect()} == wanted
        assert {r["id"]: r["f"] for r in order.last_known(df, "v", "log", "place", "f", most).collect()} == filled
    placed = order.framed(df, "log", ["when", "id"], 2, 7)
    assert placed.groupBy("log", "_block").count().agg(F.max("count")).first()[0] <= 9 and placed.filter("not _copy").count() == 1000
    for most in (7, 10_000):
        assert {r["id"]: r["average"] for r in monitoring.moving_average(df, "v", ["when", "id"], "log", 3, most).collect()} == averages
        assert {r["log"]: r["id"] for r in monitoring.crossings(df, "v", 8.0, ["when", "id"], "log", most).collect()} == crossed


def test_upper_median_by_counting(spark):
    rows = [(k % 3 if k % 7 else None, k * k % 5000 if k % 11 else None) for k in range(900)]
    got = {r["step"]: tuple(r)[1:4] for r in monitoring.length_profile(spark.createDataFrame(rows, "step long, n long"), "n").collect()}
    for step in (0, 1, 2, None):
        own = sorted((n for s, n in rows if s == step), key=lambda n: (n is not None, n or 0))
        assert got[step] == (len(own), own[len(own) // 2], own[-1])
