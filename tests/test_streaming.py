"""The streaming jobs over folders of several files."""

import datetime as dt
import random
from collections import Counter

import duckdb
import pytest

from siftlog.plans.queries import ORACLE_SQL, QUERIES

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def written(spark, path, files):
    for rows in files:
        spark.createDataFrame([(i, ts, user, kind, 0.0, "{}") for i, ts, user, kind in rows], EVENTS).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
    return str(path)


def test_newcomers_have_no_cap(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    users = [4 * i for i in range(10_500)]  # all under one host
    d = written(spark, tmp_path, [[(u, at, u, "view") for u in users], [(u, at, u, "view") for u in [*users[-40:], 1, 1]]])
    got = Counter((r.host, r.actor) for r in QUERIES["stream_newcomer"](spark, d).collect())
    assert got == Counter({**{("h0", str(u)): 1 for u in users}, ("h1", "1"): 1})


@pytest.mark.parametrize("name", ["stream_outcome", "threshold_alert"])
def test_windows_span_files_in_any_time_order(spark, tmp_path, name):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=7 * (i % 60)), i % 12, ("view", "error")[i % 5 == 0]) for i in range(240)]
    files = [rows[k::3] for k in range(3)] + [[(1000 + i, at - dt.timedelta(days=2, minutes=i), i, "view") for i in range(30)]]
    d = written(spark, tmp_path, files)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, d)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert want and Counter(map(tuple, df.collect())) == Counter(want)


def test_a_tail_goes_on_where_its_cursor_stands(spark, tmp_path):
    from siftlog.streaming import jobs as S

    at = dt.datetime(2024, 1, 1)
    day = lambda i: [(100 * i + k, at + dt.timedelta(days=i), k, "view") for k in range(5)]
    d = written(spark, tmp_path, [day(0), day(1)])
    run = lambda: S.into(spark, S.tail(spark, f"{d}/events.parquet", EVENTS).select("event_id"), f"{tmp_path}/out").collect()
    assert len(run()) == 10 and {r.tick for r in run()} == {0, 1}  # the second run finds nothing new
    written(spark, tmp_path, [day(2), day(-3)])  # late files, too
    rows = run()
    assert Counter(r.event_id for r in rows) == Counter(i for k in (0, 1, 2, -3) for i, *_ in day(k)) and {r.tick for r in rows} == {0, 1, 2, 3}


@pytest.mark.parametrize("name", ["stream_tail", "stream_newcomer", "stream_frames", "stream_stale", "id_sessions", "stream_manifest"])
def test_jobs_over_many_ticks_equal_their_sql(spark, tmp_path, name):
    at = dt.datetime(2024, 1, 1)
    rows = [(i, at + dt.timedelta(minutes=11 * ((i * 7) % 300)), i % 9, ("view", "error", "click")[i % 3 if i % 4 else 0]) for i in range(300)]
    d = written(spark, tmp_path, [rows[k::5] for k in range(5)])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    df = QUERIES[name](spark, d)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert want and Counter(map(tuple, df.collect())) == Counter(want)


def test_alerts_equal_windows_tried_one_by_one(spark):
    """Sources that come again inside a window, after one, and without a name; a row is made for a pane, not for each of its windows."""
    from siftlog.streaming import jobs as S

    at, rng = dt.datetime(2024, 1, 1, tzinfo=dt.UTC), random.Random(7)
    rows = [(rng.choice("ab"), at + dt.timedelta(seconds=rng.choice([1, 5]) * rng.randrange(40_000)), rng.choice([1, 2, 3, 4, 5, None])) for _ in range(300)]
    events = spark.createDataFrame(rows, "host string, ts timestamp, src int")
    counts = S.source_counts(events, "host", "src", late=None)
    assert counts.count() <= len(rows)
    pane = lambda ts: int(ts.timestamp()) // 300
    want = {}
    for host, ts, src in rows:
        for begin in range(pane(ts) - 11, pane(ts) + 1):
            want.setdefault((host, begin * 300), []).append(src)
    want = {k: (len(v), len({x for x in v if x})) for k, v in want.items()}
    for failures, sources in ((1, 0), (5, 3)):
        got = S.threshold_alerts(counts, "host", "src", failures, sources).selectExpr("host", "unix_seconds(begin) as at", "n", "sources").collect()
        assert len(got) == len({(r.host, r.at) for r in got})
        assert {(r.host, r.at): (r.n, r.sources) for r in got} == {k: v for k, v in want.items() if v[0] >= failures and v[1] >= sources}
