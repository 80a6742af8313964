"""Late rows, stateful framing with timers, and text lines as streams, over several ticks and runs."""

import datetime as dt
import random

import pytest

from siftlog.streaming import jobs as S
from siftlog.streaming.late import windowed
from siftlog.streaming.lines import tail_lines
from siftlog.streaming.records import STORE, framed

AT = dt.datetime(2024, 1, 1)


def hours(h):
    return AT + dt.timedelta(hours=h)


def fed(spark, root, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(root)


def test_late_rows_and_windows_are_all_rows(spark, tmp_path):
    schema, root = "id long, ts timestamp, host string", f"{tmp_path}/e"
    run = lambda: windowed(spark, S.tail(spark, root, schema), ["host"], "id", f"{tmp_path}/out")
    fed(spark, root, [(1, hours(0), "x"), (2, hours(1), "x"), (2, hours(1), "x")], schema)
    fed(spark, root, [(3, hours(30), "x"), (4, hours(2), "y"), (2, hours(1), "x")], schema)
    windows, late = run()
    assert [(r.host, r.begin, r.n) for r in windows.orderBy("host").collect()] == [("x", AT, 2), ("y", AT, 1)]
    assert late.count() == 0
    # A restart: the open window of the second day is state.
    fed(spark, root, [(5, hours(31), "x"), (6, hours(3), "y")], schema)
    fed(spark, root, [(7, hours(80), "x"), (8, hours(3), "y"), (9, hours(29), "x")], schema)
    fed(spark, root, [(10, hours(81), "x"), (11, hours(5), "y"), (12, hours(28), None)], schema)
    windows, late = run()
    assert {(r.host, r.begin): r.n for r in windows.collect()} == {("x", AT): 2, ("y", AT): 1, ("x", hours(24)): 2}
    assert sorted(r.id for r in late.collect()) == [6, 8, 9, 11, 12]
    assert {r.tick for r in late.where("id = 6").collect()} != {r.tick for r in late.where("id = 11").collect()}


def by_rule(rows, quiet, done):
    """path -> records by starts and gaps; the last one only if it is quiet at ``done``."""
    out = []
    for path in sorted({r[0] for r in rows}):
        own, records = sorted(r for r in rows if r[0] == path), []
        for _, n, ts, text in own:
            if not records or text.startswith("START") or ts - records[-1][2] >= quiet:
                records.append([n, n, ts, text])
            else:
                records[-1] = [records[-1][0], n, ts, records[-1][3] + " " + text]
        out += [(path, a, b, t) for a, b, ts, t in records[:-1] + [r for r in records[-1:] if r[2] + quiet <= done]]
    return sorted(out)


@pytest.mark.parametrize("cuts", [[60], [10, 25, 45, 60]])
def test_records_dont_depend_on_ticks(spark, tmp_path, cuts):
    rng, schema = random.Random(3), "path string, line_no long, ts timestamp, text string"
    rows, counts = [], {}
    for i in range(60):
        path = rng.choice("abcd" if i < 30 else "ab")  # c and d fall quiet
        counts[path] = counts.get(path, 0) + 1
        rows.append((path, counts[path], AT + dt.timedelta(minutes=4 * i + rng.randrange(3)), rng.choice(["START s", "more", "m2"])))
    got, begin = None, 0
    for end in cuts:
        fed(spark, f"{tmp_path}/f", rows[begin:end], schema)
        if end in (cuts[0], cuts[-1]):  # a restart between the first tick and the others
            got = S.into(spark, framed(S.tail(spark, f"{tmp_path}/f", schema), "^START", "20 minutes"), f"{tmp_path}/o", store=STORE)
        begin = end
    done = max(r[2] for r in rows) - dt.timedelta(minutes=1)
    want = by_rule(rows, dt.timedelta(minutes=20), done)
    assert sorted((r.path, r.line_start, r.line_end, r.text) for r in got.collect()) == want
    assert {p for p, *_ in want} == {"a", "b", "c", "d"}
    assert spark.conf.get(STORE[0], None) != STORE[1]  # the session has its own store again


def test_lines_are_numbered_over_chunks_and_runs(spark, tmp_path):
    root = tmp_path / "in"

    def chunk(path, name, lines):
        (root / path).mkdir(parents=True, exist_ok=True)
        (root / path / name).write_text("".join(f"{x}\n" for x in lines))

    run = lambda: sorted((r.path, r.line_no, r.text) for r in tail_lines(spark, str(root), f"{tmp_path}/out", files_each=2).collect())
    chunk("a", "0001", ["a1", "", "a3"])
    chunk("b", "0001", ["b1"])
    chunk("a", "0002", ["a4"])
    want = [("a", 1, "a1"), ("a", 2, ""), ("a", 3, "a3"), ("a", 4, "a4"), ("b", 1, "b1")]
    assert run() == want
    assert run() == want
    chunk("b", "0002", [f"b{i}" for i in range(2, 40)])
    chunk("c", "0001", [])
    chunk("a", "0003", ["a5"])
    assert run() == sorted([*want, ("a", 5, "a5"), *[("b", i, f"b{i}") for i in range(2, 40)]])
