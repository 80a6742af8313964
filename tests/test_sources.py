"""Reading files: splits, gzip, skipped folders, broken rows."""

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from siftlog.functions import clock as C
from siftlog.operators import joins as J
from siftlog.operators import timing as T
from siftlog.sources import lines as L
from siftlog.sources import records as S


def test_lines_are_numbered_through_splits_and_gzip(spark, tmp_path):
    texts = {f"f{k}.log": [f"line {i} of {k} " + "é" * (i % 40) for i in range(3000)] for k in range(2)}
    (tmp_path / "a" / ".git").mkdir(parents=True)
    (tmp_path / "a" / "node_modules").mkdir()
    for name, lines in texts.items():
        (tmp_path / "a" / name).write_text("\n".join(lines) + "\n")
        with gzip.open(tmp_path / "a" / f"{name}.gz", "wt") as f:
            f.write("\n".join(lines))
        (tmp_path / "a" / ".git" / name).write_text("no\n")
        (tmp_path / "a" / "node_modules" / name).write_text("no\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        got = L.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    held = {}
    for r in got:
        held.setdefault(r.path.rsplit("/", 1)[1], {})[r.line_no] = r.text
    assert held == {n + end: dict(enumerate(lines, 1)) for n, lines in texts.items() for end in ("", ".gz")}


def test_broken_and_ragged_rows(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"a": 1, "b": {"c": "x"}}\n{"a": \n[]\nnot json\n{"a": "word"}\n{"b": null}\n')
    assert [tuple(r) for r in S.read_jsonl(spark, str(tmp_path / "e.jsonl"), "a long, b struct<c:string>").select("a", "b.c").collect()] == [(1, "x"), (None, None)]
    (tmp_path / "t.tsv").write_text("src\tdst\tdport\n1\t2\t3\n4\n5\t6\t7\t8\n")
    assert [tuple(r) for r in S.read_table(spark, str(tmp_path / "t.tsv")).collect()] == [("1", "2", "3"), ("4", None, None), ("5", "6", "7")]
    (tmp_path / "l.json").write_text('{"line": 3, "labels": ["a", "b"]}\n{"line": 4, "labels": []}\n{"labels": ["c"]}\n?\n')
    assert [(r.line_no, r.label) for r in S.read_labels(spark, str(tmp_path / "l.json")).collect()] == [(3, "a"), (3, "b")]


def test_answer_keys(spark, tmp_path):
    defects = [
        {"id": "D1", "title": "red herring: x", "proof_locations": [{"file": "a.log", "line_start": 3, "line_end": 9, "note": "n"}, {"file": "b.log", "line_start": 4}]},
        {"id": "D2", "title": "real", "anchor": "c/d.log:17"}, {"id": "D3"}, {"id": "D4", "title": "t", "proof_locations": [], "alternate_proof_locations": [{"file": "e", "line_start": 1, "line_end": 2}]},
    ]
    (tmp_path / "key.json").write_text(json.dumps({"dataset": "s", "defects": defects}, indent=1))
    want = [("s", "D1", True, "a.log", 3, 9), ("s", "D1", True, "b.log", 4, 4), ("s", "D2", False, "c/d.log", 17, 17), ("s", "D3", False, None, None, None), ("s", "D4", False, "e", 1, 2)]
    assert sorted(map(tuple, S.read_truth(spark, str(tmp_path / "key.json"), whole_files=True).collect()), key=str) == sorted(want, key=str)
    named = {"dataset": "s", "defects": {d.pop("id"): d for d in defects}}
    rows = spark.createDataFrame([(json.dumps(named),), ("broken",), (None,)], "value string")
    assert sorted(map(tuple, S.truth_spans(rows).collect()), key=str) == sorted(want, key=str)


def test_clocks_of_each_shape(spark):
    rows = [("2024-02-29T23:59:58Z", 1709251198.0, None), ("2023-02-29 01:00:00", None, None), ("Feb 30 01:02:03 host", None, 3723.0), ("29.02.2024 23:59:58", 1709251198.0, None), ("20240229|235958.001|x", 1709251198.0, None), ("|235958.001|", None, 86398.0), ("1709251198123 ms", 1709251198.123, None), ("99/Feb/2024:01:02:03", None, None), ("at 01:02:03", None, 3723.0)]
    shapes = ["iso", "iso", "bsd", "dmy", "compact", "compact", "epoch", "clf", "clock"]
    for (text, at, sod), shape in zip(rows, shapes, strict=True):
        r = spark.createDataFrame([(text,)], "text string").select((C.reading(F.col("text"), shape) if shape not in ("bsd", "clock") else F.lit(None)).alias("at"), (C.second_of_day(F.col("text"), shape) if shape in ("bsd", "clock", "compact") else F.lit(None)).alias("sod")).first()
        assert r.at == at and (sod is None or r.sod == sod), text
    bsd = [(f"s{k}", i, f"Dec {30 + (i // 20)} {(i * 71 // 60) % 24:02d}:{i * 71 % 60:02d}:00 m") for k in range(2) for i in range(40)]
    kinds = {r.path: (r.kind, r.shape) for r in T.stream_state(spark.createDataFrame([*bsd, ("none", 1, "x")], "path string, line_no int, text string")).collect()}
    assert kinds == {"s0": ("stream", "bsd"), "s1": ("stream", "bsd"), "none": ("state", None)}


def test_evidence_verdicts(spark):
    lines = [("a/x.log", 1, "2024 ERROR payment failed for order 7741 after timeout"), ("a/x.log", 2, "всё хорошо с платежом"), ("b/x.log", 1, "other"), ("bin.dat", 1, "z")]
    claims = [
        ("verbatim", "a/x.log", 1, 1, 'the log says "payment failed for order"'), ("tokens", "a/x.log", 1, 1, 'it says "order 7741 timeout payment nothing"'), ("wrong", "a/x.log", 1, 1, 'it says "disk full while writing snapshot"'),
        ("russian", "a/x.log", 1, 1, "платёж не прошёл из-за сети"), ("sentence", "a/x.log", 1, 2, "payment order failed there"), ("past", "a/x.log", 9, 9, "payment order failed"), ("gone", "q.log", 1, 1, "payment order failed"),
        ("many", "x.log", 1, 1, "payment order failed"), ("sealed", "bin.dat", 1, 1, "payment order failed"), ("turned", "a/x.log", 1, 0, "payment order failed"), ("numbers", "a/x.log", 1, 1, "7741 2024 16 75"),
    ]
    c = spark.createDataFrame(claims, "claim_id string, path string, line_lo long, line_hi long, claim string")
    df, sealed = spark.createDataFrame(lines, "path string, line_no long, text string"), spark.createDataFrame([("bin.dat",)], "path string")
    got = {r.claim_id: r.verdict for r in J.verify_claims(c, df, sealed).collect()}
    assert got == {"verbatim": "ok", "tokens": "ok", "wrong": "wrong-content", "russian": "unverifiable", "sentence": "ok", "past": "out-of-range", "gone": "missing-file", "many": "ambiguous", "sealed": "binary-file", "turned": "ok", "numbers": "unverifiable"}
    strict = {r.claim_id: r.verdict for r in J.verify_claims(c, df, sealed, require_quote=True).collect()}
    assert strict["verbatim"] == "ok" and strict["sentence"] == "no-quote" and strict["wrong"] == "wrong-content"


def test_a_worklist_without_rows_is_read_back(spark, tmp_path):
    from siftlog.plans.queries import QUERIES

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at, 4, "view", 0.0, '{"k": 1}') for i in range(40)]  # one template, 40 times: too frequent for a worklist
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["worklist_sink"](spark, str(tmp_path))
    assert got.columns == ["path", "line_no", "round", "place", "host"] and got.collect() == []
    spark.createDataFrame([*rows, (40, at, 4, "view", 0.0, '{"k": 2}')], schema).write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in QUERIES["worklist_sink"](spark, str(tmp_path)).collect()] == [("h0/logs/view.log", 41, 1, 1, "h0")]
