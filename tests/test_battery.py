"""The battery of observations on a small fleet, each figure by hand."""

from pyspark.sql import functions as F

from siftlog.operators.battery import Rule, battery


def rules():
    t, ip = F.col("text"), F.nullif(F.regexp_extract("text", r"from (\S+)", 1), F.lit(""))
    return {
        "deny": Rule(t.contains("deny"), "auth", ip, F.length("text"), {"allowed": t.contains("allow")}),
        "ban": Rule(t.startswith("ban"), "fail", ip, key=ip, opens=t.startswith("ban"), closes=t.startswith("unban")),
        "never": Rule(t == "never", "nofile"),
    }


def test_battery(spark):
    rows = [
        ("a", "a/auth.log", 1, 0, "deny from x"), ("a", "a/auth.log", 2, 3600, "deny from y"), ("a", "a/auth.log", 3, 7300, "deny from x"), ("a", "a/auth.log", 4, 7400, "allow from z"),
        ("a", "a/auth.log.1", 1, 10, "deny all"), ("a", "a/web.log", 1, 20, "deny from q"),
        ("a", "a/fail.log", 1, 100, "ban from x"), ("a", "a/fail.log", 2, 200, "unban from x"), ("a", "a/fail.log", 3, 300, "ban from x"), ("a", "a/fail.log", 4, 400, "ban from x"), ("a", "a/fail.log", 5, 90_000, "unban from y"),
        ("b", "b/other.log", 1, 5, "fine"),
    ]
    df = spark.createDataFrame(rows, "host string, path string, line_no long, sec long, text string")
    got = {(r.host, r.rule): r for r in battery(df, rules()).collect()}
    assert len(got) == 6
    deny = got["a", "deny"]
    assert (deny.n, deny.files, deny.sources, deny.top, deny.buckets, deny.parts) == (4, "a/auth.log=3 a/auth.log.1=1", 2, "x=2 y=1", "11=3 8=1", "allowed=1")
    assert (deny.first, deny.last, deny.hours, deny.quiet_hours, deny.share_bp, deny.opened) == (0, 7300, 2, 22, 8000, None)
    ban = got["a", "ban"]
    assert (ban.n, ban.opened, ban.open, ban.share_bp) == (3, 3, 2, 6000)
    for host, rule in (("a", "never"), ("b", "deny"), ("b", "ban")):
        r = got[host, rule]
        assert (r.n, r.files, r.top, r.parts, r.sources, r["first"], r.hours) == (0, "", "", "", 0, None, None)
    assert battery(df.where("false"), rules()).count() == 0
