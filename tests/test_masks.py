"""The mask and the gate that reads it, against another form of both."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siftlog.functions import fields as X
from siftlog.functions import masking as M
from siftlog.operators import predicates as P

TOKEN = re.compile(f"(?P<uuid>{M.UUID})|(?P<stamp>{M.STAMP})|(?P<ip>{M.ADDRESS})|(?P<hex>{M.HEX})|(?P<number>{M.NUMBER})", re.ASCII)
PUT = {"uuid": "<uuid>", "stamp": "<T>", "ip": "<ip>", "hex": "<hex>", "number": "#"}


def brute_template(text):
    return re.sub(r"\s+", " ", TOKEN.sub(lambda m: PUT[m.lastgroup], text[: M.MOST_CHARS]), flags=re.ASCII).strip(" ")


LINES = [
    "plain words of text", "took -12.5ms of 3 and x-4 or a1b2c3d4 deadbeef01 12345678", "2024-01-02T03:04:05.678+02:00 start 10.0.0.7:8080", "Jan  2 03:04:05 host app[77]: id 123e4567-e89b-12d3-a456-426614174000",
    "01/Feb/2024:03:04:05 +0000 GET /v1/x2?y=3", "  spaces   and\ttabs 7  ", "", "version 1.2.3 not an address, 1.2.3.4 is", "x" * 790 + " 12 34 56", "é12 ü 5é", "ab12cd34ef of-12 _12 -3",
]


def test_template_equals_one_pass_of_the_alternation(spark):
    rows = [(i, t) for i, t in enumerate(LINES)]
    got = {r.i: r.t for r in spark.createDataFrame(rows, "i int, text string").select("i", M.template(F.col("text")).alias("t")).collect()}
    assert got == {i: brute_template(t) for i, t in rows}


@pytest.mark.parametrize("share", [0.25, 0.6])
def test_shape_gate_equals_brute_force(spark, share):
    rows = [(f"f{i % 7}", LINES[(i * i + i // 7) % len(LINES)] + ("" if i % 7 < 3 else f" w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}")) for i in range(300)]
    want = defaultdict(list)
    for p, t in rows:
        want[p].append(brute_template(t))
    df = spark.createDataFrame(rows, "path string, text string").select("path", M.template(F.col("text")).alias("template"))
    got = Counter((r.path, r.n) for r in P.shape_gate(df, share).collect())
    assert got == Counter((p, len(t)) for p, t in want.items() if len(set(t)) > share * len(t))


def test_shape_and_fields(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05,1 a1b2c3 cafe 77 from 1.2.3.4  at 12:13:14 deadbe1x",), ('{"a": 1, "a": "two"} user=a user=b k=1 ALERT warning, xERRORx verbose',)], "text string")
    a, b = (r[0] for r in df.select(M.shape(F.col("text"))).collect())
    assert a == "<ts> # cafe # from <ip> at <ts> deadbe#x"
    bag = [(r.f.axis, r.f.value) for r in df.select(F.explode(X.field_bag(F.col("text"))).alias("f")).collect()]
    assert [v for k, v in bag if k == "kv:user"] == ["a"] and [v for k, v in bag if k == "json:a"] == ["1"] and [v for k, v in bag if k == "kv:k"] == ["1"]
    assert df.select(X.severity_words(F.col("text")).alias("w")).collect()[1].w == ["ALERT", "WARNING", "VERBOSE"]


def test_template_and_slots_equal_their_pieces(spark):
    """Texts glued of anything that tokens are made of, marks among them; and the mask runs over a text once."""
    rng = random.Random(5)
    bits = ["12345678", "deadbeef1", "-", "_", ".", ":", " ", "é", "7", "1.5", "10.0.0.1", "Jan  2 03:04:05", "2024-01-02 03:04:05", "03:04:05", "123e4567-e89b-12d3-a456-426614174000", "x", "\n", "\ufdd0", "\ufdd1", "<", "$1", "\\"]
    rows = [("".join(rng.choice(bits[: len(bits) - 5 * (i % 2)]) for _ in range(rng.randrange(9))),) for i in range(4000)] + [(None,)]
    df = spark.createDataFrame(rows, "text string")
    kinds = F.transform(M.pieces(F.col("text")), lambda p: F.concat(p["before"], p["kind"]))
    rest = F.element_at(F.split(F.substring("text", 1, M.MOST_CHARS), M.TOKEN, -1), -1)
    numbers = F.transform(F.filter(M.pieces(F.col("text")), lambda p: p["kind"] == "#"), lambda p: p["token"].cast("double"))
    got = df.select("text", M.template(F.col("text")).alias("t"), M.slots(F.col("text")).alias("s"), F.trim(F.regexp_replace(F.concat(F.array_join(kinds, ""), rest), r"\s+", " ")).alias("wt"), F.slice(numbers, 1, M.MOST_SLOTS).alias("ws"))
    assert [r.text for r in got.collect() if (r.t, r.s) != (r.wt, r.ws)] == []
