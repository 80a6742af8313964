"""Functions and operators on small hand-made rows."""

from pyspark.sql import functions as F

from siftlog.functions import clock as C
from siftlog.functions import fields as X
from siftlog.functions import masking as M
from siftlog.operators import axes as A
from siftlog.operators import framing as R
from siftlog.operators import joins as J
from siftlog.operators import predicates as P


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()[0]


def test_mask_is_one_pass_from_the_left(spark):
    cases = {
        "id 550e8400-e29b-41d4-a716-446655440000 at 2024-01-01T10:00:00Z from 10.0.0.1": "id <uuid> at <T> from <ip>",
        "x12345678y and 12345678 and deadbeef1": "x#y and <hex> and <hex>",
        "-5 a-5 3.25 1e5": "# a-# # #e#",
        "-2024-01-01 10:00:00": "#-#-# <T>",
        "no numbers   here": "no numbers here",
        "": "",
    }
    for text, want in cases.items():
        assert one(spark, text, M.template) == want
    assert one(spark, None, M.template) is None


def test_slots_and_glue(spark):
    assert one(spark, "took 12ms ITEM-44 HTTP/1.1 rt=0.5", M.slots) == [12.0, 44.0, 1.1, 0.5]
    assert one(spark, "took 12ms ITEM-44 HTTP/1.1 rt=0.5", M.glued) == [False, True, True, False]


def test_clocks(spark):
    for text in ("2024-03-01 05:06:07 x", "01.03.2024 05:06:07", '[01/Mar/2024:05:06:07 +0000] "GET /"', "t=1709269567 x", "t=1709269567000 x"):
        assert str(one(spark, text, C.clock)) == "2024-03-01 05:06:07", text
    assert one(spark, "Mar  1 05:06:07 host", C.clock) is None
    assert one(spark, "Mar  1 05:06:07 host", C.hour_of) == 5
    assert one(spark, "nothing", C.hour_of) is None
    assert one(spark, "123", C.epoch_seconds) is None


def test_field_bag_and_addresses(spark):
    bag = {r["axis"]: r["value"] for r in one(spark, '{"lvl": "WARN", "n": 7} user=bob', X.field_bag)}
    assert bag["json:lvl"] == "WARN" and bag["json:n"] == "7" and bag["kv:user"] == "bob"
    assert one(spark, "100.65.0.1", X.ip_class) == "shared"
    assert one(spark, "8.8.8.8", X.ip_class) == "global"
    assert one(spark, "172.31.0.1", X.ip_class) == "local"


def test_frames(spark):
    lines = spark.createDataFrame([("f", 1, "2024-01-01 00:00:00 a"), ("f", 2, "  at b"), ("f", 3, ""), ("f", 4, "2024-01-01 00:00:01 c")], "path string, line_no long, text string")
    got = sorted(R.frame_anchor(lines).collect())
    assert [(r.line_start, r.line_end) for r in got] == [(1, 2), (4, 4)] and got[0].text.endswith("a at b")
    assert [(r.line_start, r.line_end) for r in sorted(R.frame_block(lines).collect())] == [(1, 2), (4, 4)]


def test_quantiles_take_the_floor_rank(spark):
    df = spark.createDataFrame([(1, v) for v in range(1, 11)], "k int, v long")
    assert A.floor_quantiles(df, ["k"], "v", p50=0.5, p99=0.99).first()[1:] == (10, 6, 10)


def test_resolve_fails_closed(spark):
    corpus = spark.createDataFrame([("a/x.log",), ("b/x.log",), ("c/y.log",)], "path string")
    asked = spark.createDataFrame([("x.log",), ("y.log",), ("a/x.log",), ("z",)], "asked string")
    got = {r.asked: (r.path, r.state) for r in J.resolve_paths(asked, corpus).collect()}
    assert got == {"x.log": (None, "ambiguous"), "y.log": ("c/y.log", "ok"), "a/x.log": ("a/x.log", "ok"), "z": (None, "missing")}


def test_overlap_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([("f", 1, 500, "a")], "path string, lo long, hi long, x string")
    b = spark.createDataFrame([("f", 100, 900, "b"), ("f", 501, 502, "c"), ("g", 1, 9, "d")], "path string, b_lo long, b_hi long, y string")
    assert [(r.x, r.y) for r in J.overlap_join(a, b).collect()] == [("a", "b")]


def test_identifiers_need_free_ends(spark):
    lines = spark.createDataFrame([("f", 1, "ORD-77421 ord_77421 ord77421"), ("f", 2, "xord-77421"), ("f", 3, "ord-774215")], "path string, line_no long, text string")
    assert [r.line_no for r in J.id_hits(lines, {"o": ["ord", "77421"]}).collect()] == [1]


def test_range_ids(spark):
    assert one(spark, "g041-g043", P.expand_ids) == ["g041", "g042", "g043"]
    assert one(spark, "g041-g040", P.expand_ids) is None


def test_quotes_of_any_length_are_found_where_contains_holds(spark):
    texts = dict(enumerate(["the quick brown fox jumps over it", "thequickbrownfox", "a b c d e f", "xa b c dy", "", "a b"]))
    quotes = dict(enumerate(["quick", "quick brown", "ick brown fox", "quick brown fox jum", "he quick brown fox jumps ov", "b c d", "a b c d", "", "no such words in any text", "kbrown"]))
    got = P.quote_hits(spark.createDataFrame(list(texts.items()), "doc_id long, t string"), spark.createDataFrame(list(quotes.items()), "item_id long, quote string"))
    assert {tuple(r) for r in got.collect()} == {(d, i) for d, t in texts.items() for i, q in quotes.items() if q in t}
