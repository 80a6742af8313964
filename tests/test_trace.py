"""The trace of many identifiers against patterns tried one by one."""

import random
import re

import pytest

from siftlog.operators import trace as T

IDS = ["ORD-77421", "ord_77421", "svc", "a.b.c", "user=7", "x--y", "10.0.0.1", "[weird] (id)", "q\\E.z", "***", "", "K-9", "ünï-5", "ab-x=7"]
BITS = ["ORD", "77421", "-", "_", ".", ":", "/", " ", "svc", "a", "b", "c", "user", "=", "7", "x", "y", "10", "0", "1", "[weird]", "(id)", "q", "\\E", "z", "K", "K", "9", "İ", "ünï", "5", "ORD77421", "abc", "abx", "2024-01-02 03:04:05", "\n", " 10-0.0:1 ", " ab_x=7 "]


def brute(text, id_):
    parts = [re.escape(p) for p in re.split(r"[-_.\s]+", id_, flags=re.A) if p]
    if not re.search("[A-Za-z0-9]", id_):
        return False
    return re.search(r"(?<![A-Za-z0-9])" + "[-_.:/]?".join(parts) + r"(?![A-Za-z0-9])", text, re.I | re.A) is not None


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a/x", "b/y"]), 2 * i, 2 * i + i % 2, "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 25)))) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "path string, line_start long, line_end long, text string")


def test_hits_equal_patterns_tried_one_by_one(spark, records):
    rows, df = records
    ids = spark.createDataFrame([(i,) for i in [*IDS, "svc", None]], "id string")
    got = {(r.id, r.path, r.line_start) for r in T.id_hits(df, ids).collect()}
    want = {(i, p, a) for p, a, _, t in rows for i in IDS if brute(t, i)}
    assert got == want
    assert {i for i, _, _ in want} >= {"ORD-77421", "ord_77421", "svc", "a.b.c", "10.0.0.1", "K-9", "ab-x=7"}


def test_trace_counts_all_and_shows_some(spark, records):
    rows, df = records
    ids = spark.createDataFrame([(i,) for i in IDS], "id string")
    got = {(r.id, r.path): r for r in T.trace(df, ids, keep=5).collect()}
    stamp = re.compile(r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}")
    for i in IDS:
        for path in ("a/x", "b/y"):
            own = [(a, b, t) for p, a, b, t in rows if p == path and brute(t, i)]
            if not own:
                assert (i, path) not in got
                continue
            r = got[i, path]
            assert (r.n, r.truncated) == (len(own), len(own) > 5)
            assert r.refs == [f"{a}-{b}" if b > a else str(a) for a, b, _ in own[:5]]
            assert r.samples == [t.strip(" ")[:220] for _, _, t in own[:3]]
            stamps = [m.group() for _, _, t in own if (m := stamp.search(t))]
            assert (r.first_ts, r.last_ts) == ((stamps[0], stamps[-1]) if stamps else (None, None))


def test_first_rows_in_blocks(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as line_start")
    got = sorted((r.k, r.line_start) for r in T.first_rows(df, ["k"], "line_start", 4, block=10).collect())
    assert got == [(k, k + 3 * i) for k in range(3) for i in range(4)]


def test_no_nested_loop(spark, records):
    _, df = records
    ids = spark.range(2000).selectExpr("concat('ID-', id) as id")
    plan = T.id_hits(df, ids)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan
    assert "Cartesian" not in plan


def test_trace_of_nothing(spark, records):
    _, df = records
    none = spark.createDataFrame([], "id string")
    assert T.trace(df, none).count() == 0
    assert T.trace(df.where("false"), spark.createDataFrame([("svc",)], "id string")).count() == 0


def test_a_token_that_all_identifiers_share_meets_no_pattern(spark):
    """The pairs of a record and an identifier that its pattern is tried on grow with the records, not with the identifiers."""
    df = spark.range(400).selectExpr("'a/x' as path", "id as line_start", "id as line_end", "concat('user=', id, ' from 10.0.', id % 8, '.', id % 9, ' to 10.0.0.1') as text")
    ids = spark.range(400).selectExpr("explode(array(concat('USER=', id), concat('10.0.', id % 8, '.', id % 9))) as id")
    hits = {(r.id, r.line_start) for r in T.id_hits(df, ids).collect()}
    assert hits == {(f"USER={i}", i) for i in range(400)} | {(f"10.0.{i % 8}.{i % 9}", i) for i in range(400)} | {("10.0.0.1", i) for i in range(400)}
    assert T.candidates(df, ids).count() < 2 * len(hits)
