"""Cards as a table, rendering twins, fenced blocks and table functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siftlog.functions import extractors as E
from siftlog.functions.fields import field_bag, text_blocks
from siftlog.operators.cards import card_verdicts, evidence
from siftlog.operators.twins import rendering_twins


def lines_of(spark, files):
    return spark.createDataFrame([(p, i, t) for p, text in files.items() for i, t in enumerate(text, 1)], "path string, line_no long, text string")


def test_cards(spark):
    lines = lines_of(spark, {"a/app.log": ["boom 1", "fine", "boom 2", "boom 3", "boom 4"], "b/app.log": ["bang"], "c/core.dump": [""]})
    cards = [("one", "any", "boom"), ("one", "any", "never"), ("both", "all", "boom"), ("both", "all", "bang"), ("half", "all", "boom"), ("half", "all", "never"), ("file", "name", r"\.dump$"), ("file", "name", "^a$"), ("one", "any", "boom"), ("null", "any", None), ("empty", "all", "")]
    df = spark.createDataFrame(cards, "card string, kind string, pattern string")
    got = {r.card: r for r in card_verdicts(lines, df).collect()}
    assert {c: r.holds for c, r in got.items()} == {"one": True, "both": True, "half": False, "file": True}
    assert (got["one"].hits, got["one"].files, got["one"].examples) == (4, 1, ["0:a/app.log:1", "0:a/app.log:3", "0:a/app.log:4"])
    assert (got["both"].bits, got["both"].examples[0], got["both"].files) == (3, "0:b/app.log:1", 2)
    assert got["file"].examples == ["0:c/core.dump:0"]
    by_file, _ = evidence(lines, df)
    assert {(r.card, r.path): r.bits for r in by_file.where("card = 'both'").collect()} == {("both", "a/app.log"): 2, ("both", "b/app.log"): 1}
    for bad in ([("x", "some", "y")], [("x", "any", str(i)) for i in range(70)], [(str(i), "any", "y") for i in range(30)]):
        with pytest.raises(ValueError):
            card_verdicts(lines, spark.createDataFrame(bad, "card string, kind string, pattern string"), most=25 if len(bad) == 30 else 2000)


ISO = "2024-03-01T12:00:{:02d}+02:00 h1 app[7]: {}"
JOURNAL = '{{"__REALTIME_TIMESTAMP":"{}000000","_PID":"7","_COMM":"app","_HOSTNAME":"h1","MESSAGE":"{}"}}'
NOON = 1709287200  # ten o'clock UTC


def test_twins(spark):
    files = {
        "h1/messages": [ISO.format(0, "up"), ISO.format(1, "tick"), ISO.format(1, "tick"), ISO.format(2, "twice"), ISO.format(3, "down"), "  "],
        "h1/journal.json": [JOURNAL.format(NOON, "up"), JOURNAL.format(NOON + 1, "tick"), JOURNAL.format(NOON + 2, "twice"), JOURNAL.format(NOON + 1, "tick"), JOURNAL.format(NOON + 2, "twice"), JOURNAL.format(NOON + 9, "down"), '{"MESSAGE":[1,2],"__REALTIME_TIMESTAMP":"1"}'],
        "h1/syslog": ["Mar  1 12:00:00 h1 app[7]: up"] * 2,
        "h1/rules": ["allow all", "deny none"],
        "h1/mixed": [ISO.format(0, "up"), "Mar  1 12:00:00 h1 app[7]: up"],
        "h2/messages": [ISO.format(0, "up")],
        "lone": [ISO.format(0, "up")],
    }
    lines = lines_of(spark, files)
    twins, refused = rendering_twins(lines)
    assert {(r.path, r.line_no, r.twin_path, r.twin_line) for r in twins.collect() if r.path == "h1/messages"} == {("h1/messages", 1, "h1/journal.json", 1), ("h1/messages", 2, "h1/journal.json", 2), ("h1/messages", 3, "h1/journal.json", 4)}
    why = {(r.path, r.twin_path): (r.reason, r["keys"]) for r in refused.collect()}
    assert why["h1/messages", "h1/journal.json"] == ("multiplicity", 1)
    assert {why["h1/messages", f"h1/{x}"][0] for x in ("syslog", "rules", "mixed")} == {"timebase"}
    assert not any("h2" in k or "lone" in k for pair in why for k in pair)
    spans = spark.createDataFrame([("h1/messages", 3, 3000)], "path string, lo long, hi long")
    twins, refused = rendering_twins(lines, spans)
    assert [(r.line_no, r.twin_line) for r in twins.collect()] == [(3, 4)]
    assert {r.path for r in refused.collect()} == {"h1/messages"}


def brute_blocks(text):
    out, cur, fence = [], [], False
    for line in text.replace("\r\n", "\n").split("\n"):
        if re.match(r"[^\S\n]*(```|~~~)", line):
            fence = not fence
        elif not fence and re.fullmatch(r"[ \t]*", line):
            out.append("\n".join(cur))
            cur = []
            continue
        cur.append(line)
    out.append("\n".join(cur))
    return [b for b in (re.sub(r"[ \t\n\x0b\f\r]+", " ", b).strip(" ") for b in out) if b]


def test_blocks_keep_fences_whole(spark):
    rng = random.Random(6)
    parts = ["a", "b c", "", " \t", "```", "~~~ py", "  ```x", "x ``` y", "\r", "d\r"]
    rows = [(i, "\n".join(rng.choice(parts) for _ in range(rng.randrange(0, 25)))) for i in range(400)]
    rows += [(1000, ""), (1001, "\n\n"), (1002, "```"), (1003, "a\n\n```\n\nopen\n\nrest"), (1004, "```\n\nx\n```\n\n~~~\n\n")]
    for r in spark.createDataFrame(rows, "id long, text string").select("id", text_blocks(F.col("text")).alias("b")).collect():
        assert r.b == brute_blocks(dict(rows)[r.id]), dict(rows)[r.id]


def test_table_function_gives_what_the_columns_give(spark):
    rng = random.Random(7)
    parts = ['"k": "v"', '"n": 12', "a=1", "a=2", "b-c=3", "|", "word", "averyveryverylongwordthatisnoplace", '"t": true', " ", "ключ=знач", "\t"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 16)))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "id long, text string")
    want = df.select("id", F.explode(field_bag(F.col("text"))).alias("f")).select("id", "f.axis", "f.value").collect()
    got = E.with_rows(df, E.FIELD_BAG, "text").select("id", "axis", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_brackets():
    assert list(E.brackets("(a(b)) [c] (d {e}")) == [(0, "(a(b))"), (7, "[c]"), (14, "{e}")]
    assert list(E.brackets(") ( ] (x)")) == [(6, "(x)")]
    assert list(E.brackets("")) == []
