"""Quotes of every kind, budgets, chosen runs, checklists, table citations, capped templates, binary files."""

import random

import pytest
from pyspark.sql import functions as F

from siftlog.functions.fields import table_citations
from siftlog.functions.masking import capped_template
from siftlog.operators import joins as J
from siftlog.operators import predicates as P
from siftlog.sources.lines import read_lines


def test_quotes_of_every_kind_are_found_exactly(spark):
    rng = random.Random(4)
    words = ["alpha", "beta", "gam", "de", "e", "", "ζeta"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))) for i in range(150)]
    quotes = [(i, t[a : a + rng.randrange(1, 30)]) for i in range(120) if (t := rng.choice(texts)[1]) for a in [rng.randrange(len(t))]]
    quotes += [(900, "nowhere to be found at all"), (901, "zzz"), (902, "a"), (903, None), (904, "  "), (905, "q")]
    got = {(r.doc_id, r.item_id) for r in P.quote_hits(spark.createDataFrame(texts, "doc_id long, t string"), spark.createDataFrame(quotes, "item_id long, quote string")).collect()}
    assert got == {(d, i) for d, t in texts for i, q in quotes if q is not None and q in t}
    long = spark.createDataFrame([(1, "alpha beta gam de e")], "item_id long, quote string")
    plan = P.quote_hits(spark.createDataFrame(texts, "doc_id long, t string"), long)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


@pytest.mark.parametrize("budget", [0, 50, 120, 10_000])
def test_byte_budget_takes_the_cheapest_of_each_class(spark, budget):
    rng = random.Random(budget)
    rows = [(i, i % 17 == 0, rng.choice("abc"), rng.choice([0, 1, 5, 5, 9])) for i in range(90)]
    left, want = budget - sum(c for _, e, _, c in rows if e), {i for i, e, _, _ in rows if e}
    for k in "abc":
        upto = 0
        for c, i in sorted((c, i) for i, e, klass, c in rows if not e and klass == k):
            if upto + c > left:
                break
            upto += c
            want.add(i)
        left -= upto
    got = [r.id for r in J.byte_budget(spark.createDataFrame(rows, "id long, earned boolean, klass string, cost long"), budget).collect()]
    assert sorted(got) == sorted(want)


def test_worklist_in_turns(spark):
    rng = random.Random(2)
    rows = [(f"f{i % 40:02d}", "state" if i % 40 > 30 else "stream", i, rng.randrange(5)) for i in range(400)]
    for budget in (1, 7, 45, 100, 1000):
        got = [(r.path, r.line_no, r.round, r.place) for r in J.fair_worklist(spark.createDataFrame(rows, "path string, kind string, line_no long, rank long"), budget, 0.2).orderBy("place").collect()]
        by_round = []
        for path in sorted({r[0] for r in rows}):
            own = sorted((rank, line, kind) for p, kind, line, rank in rows if p == path)
            by_round += [(n, path, line, kind) for n, (_, line, kind) in enumerate(own, 1) if kind == "stream" or n <= 3]
        streams = sorted(r for r in by_round if r[3] == "stream")[: budget - int(budget * 0.2)]
        states = sorted(r for r in by_round if r[3] == "state")[: budget - len(streams)]
        want = [(p, line, n, place) for place, (n, p, line, _) in enumerate(sorted(streams + states), 1)]
        assert got == want, budget


def test_runs_are_chosen_never_guessed(spark):
    rows = [("d1", "a", False, "runs/x1", 1), ("d1", "a", None, "runs/x2", 2), ("d1", "a", True, "runs/x3", 3), ("d2", "b", False, None, 4), (None, "c", False, "z", 5)]
    runs = spark.createDataFrame(rows, "dataset string, arm string, stub boolean, trace_dir string, seq long")
    assert P.select_run(runs, "seq", arm="a").first().seq == 2
    assert P.select_run(runs, "seq", trace="x1").first().seq == 1
    assert P.select_run(runs, "seq", dataset="d2").first().seq == 4
    for bad in ({}, {"arm": "zz"}, {"trace": "x3"}):
        with pytest.raises(ValueError):
            P.select_run(runs, "seq", **bad)


def test_checklist_and_references(spark):
    lines = spark.createDataFrame([("a/x.log", 9), ("b/x.log", 12), ("y.log", 1)], "path string, line_no long")
    texts = spark.createDataFrame([(1, "License, x.log:12 x.log:13 y.log:0 a/y.log:1 z.log:1 x.log:99999999999999999999"), (1, None)], "id long, t string")
    got = sorted((r.quality, r.missed, r.refs, r.refs_ok) for r in P.checklist(texts, "id", "t", {"lic": "(?i)license", "no": "never"}, lines).collect())
    assert got == [(0, "lic,no", 0, 0), (1, "no", 6, 2)]


def test_citations_in_tables(spark):
    text = "| file | line | why |\n|---|---|---|\n| a/b.log | 7 | it broke |\n|x.log|y.log|12|13|\n| only.log | |\n | 3 | c.log | \n| 4 | nofile | x |\nx | a.log | 5"
    (row,) = spark.createDataFrame([(text,)], "t string").select(table_citations(F.col("t")).alias("c")).collect()
    assert [(c["path"], c["line_lo"], c["claim"]) for c in row.c] == [("a/b.log", 7, "it broke"), ("x.log", 12, "y.log 13"), ("c.log", 3, "")]


def test_templates_are_capped_by_lines(spark):
    (row,) = spark.createDataFrame([("w " * 390,)], "t string").select(*[capped_template(F.col("t"), F.lit(n)).alias(f"n{n}") for n in (0, 1, 2, 9)]).collect()
    assert [len(x) for x in row] == [180, 180, 360, 720]


def test_binary_files_are_left_out(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.bin").write_bytes(b"x\n\x00y\n")
    (tmp_path / "late.txt").write_bytes(b"z" * 9000 + b"\n\x00\n")
    names = lambda **o: sorted({r.path.rsplit("/", 1)[-1] for r in read_lines(spark, str(tmp_path), **o).collect()})
    assert names() == ["a.txt", "late.txt"]
    assert names(skip_binary=False) == ["a.txt", "b.bin", "late.txt"]
