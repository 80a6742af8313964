"""Scans along files in blocks, mixed framing and rotated streams."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.operators import framing, rotation, timing
from siftlog.operators.scan import along


def lines_of(spark, files):
    return spark.createDataFrame([(p, i, t) for p, text in files.items() for i, t in enumerate(text, 1)], "path string, line_no long, text string")


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_along_equals_windows_over_whole_files(spark, block):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 5]), rng.choice([None, "x", "y"])) for i in range(200)]
    df = spark.createDataFrame(rows, "path string, line_no long, v long, w string")
    by = W.partitionBy("path").orderBy("line_no")
    want = df.withColumns({"s": F.coalesce(F.sum("v").over(by), F.lit(0)), "p": F.last("w", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, -1)), "q": F.lag("w").over(by)})
    got = along(df, sums={"s": F.col("v")}, before={"p": F.col("w"), "q": F.struct("w")}, block=block).withColumn("q", F.col("q.w"))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_window_sorts_a_whole_file(spark):
    lines = spark.range(1000).select(F.lit("a").alias("path"), F.col("id").alias("line_no"), F.concat(F.lit("12:00:00 line "), "id").alias("text"))
    for df in (framing.frame_anchor(lines), framing.frame_block(lines), framing.framed(lines), timing.clock_readings(lines)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "Window [" in x]
        assert windows
        # Either inside a block, or over blocks' rows, which hold no text.
        assert all("_block#" in x for x in windows), plan


MIXED = {
    "plain.txt": ["first", "", "second", "   ", "third"],
    "app.log": ["2024-01-01 10:00:00 boom", "  at x", "", "  at y", "2024-01-01 10:00:01 fine", "2024-01-01 10:00:02 fine", "2024-01-01 10:00:03 fine"],
    "history.log": ["", "Start-Date: a", "Command: b", "", "", "Start-Date: c", "End: d"],
    "pod.log": ["t1Z stdout P one ", "t1Z stdout P two ", "stray", "t1Z stdout F three", "t2Z stdout F four"] + [f"t{i}Z stdout F n{i}" for i in range(3, 30)],
    "audit.log": [f"type=X{j} msg=audit(17000000{i:02d}.000:{i}): at 10:00:{i:02d}" for i in range(30) for j in range(3)],
}


def test_one_call_frames_a_mixed_corpus(spark):
    fields = {"msg": F.nullif(F.regexp_extract("text", r"msg=(\S+):", 1), F.lit(""))}
    got = framing.framed(lines_of(spark, MIXED), fields).orderBy("path", "line_start").collect()
    by = {}
    for r in got:
        by.setdefault(r.path, []).append((r.framing, r.line_start, r.line_end, r.text))
    assert by["plain.txt"] == [("line", 1, 1, "first"), ("line", 3, 3, "second"), ("line", 5, 5, "third")]
    assert by["app.log"] == [("anchor", 1, 4, "2024-01-01 10:00:00 boom at x at y")] + [("anchor", i, i, f"2024-01-01 10:00:0{i - 4} fine") for i in (5, 6, 7)]
    assert by["history.log"] == [("block", 2, 3, "Start-Date: a\nCommand: b"), ("block", 6, 7, "Start-Date: c\nEnd: d")]
    assert by["pod.log"][:2] == [("cri", 1, 4, "t1Z stdout P one two straythree"), ("cri", 5, 5, "t2Z stdout F four")]
    assert len(by["pod.log"]) == 29
    assert len(by["audit.log"]) == 30
    assert by["audit.log"][1] == ("key", 4, 6, "\n".join(MIXED["audit.log"][3:6]))


def slice_of(hours, marker=(), stamp="2024-03-01 {:02d}:{:02d}:00", every=10):
    out = []
    for h in hours:
        for m in range(0, 60, every):
            out.append(stamp.format(h, m) + f" INFO took {m}ms")
            if h in marker and m < 2 * every:
                out.append(stamp.format(h, m) + " the rare shape")
    return out


def stitched(spark, files):
    records = framing.framed(lines_of(spark, files))
    found, templates, places = rotation.stitch(records, lines_of(spark, files))
    return {r.stream: r for r in found.collect()}, templates.collect(), places.collect()


def test_a_rotated_pair_is_one_stream(spark):
    found, templates, places = stitched(spark, {"svc/app.log.1.gz": slice_of([6, 7, 8], [8]), "svc/app.log": slice_of([9, 10, 11], [9]), "svc/other.log": slice_of([6])})
    assert list(found) == ["svc/app.log"]
    own = found["svc/app.log"]
    assert (own.gate, own.slices, own.members) == ("stitched", 2, ["svc/app.log.1.gz", "svc/app.log"])
    (rare,) = [t for t in templates if "rare" in t.template]
    assert (rare.stream, rare.n, rare.path) == ("svc/app.log", 4, "svc/app.log.1.gz")
    assert [h for h, n in enumerate(rare.hours) if n] == [8, 9]
    (took,) = [t for t in templates if "took" in t.template and t.stream == "svc/app.log"]
    assert [h for h, n in enumerate(took.hours) if n] == [6, 7, 8, 9, 10, 11]
    (place,) = [p for p in places if p.stream == "svc/app.log" and p.place == 0]
    assert (place.n, place.least, place.most, place.total) == (36, 0.0, 50.0, 36 * 25.0)


def test_gates_keep_families_apart(spark):
    files = {
        "a/x.log.1": slice_of([9, 10, 11]), "a/x.log": slice_of([9, 10, 11]),
        "b/x.log.1": slice_of([6, 7], stamp="{:02d}:{:02d}:00"), "b/x.log": slice_of([8, 9], stamp="{:02d}:{:02d}:00"),
        "c/x.log.1": slice_of([6, 7]), "c/x.log": slice_of([8, 9], stamp="01.03.2024 {:02d}:{:02d}:00"),
        "d/x.log.2": slice_of([6, 7]), "d/x.log": [x for t in slice_of([8, 9]) for x in ("Time: " + t, "Kind: y", "")],
        "e/x.log.1": slice_of([6, 7]), "e/x.log.20240301": ["", " "],
        "f/x.log.1": slice_of([6]) + ["2024-03-01 07:10:00 INFO"], "f/x.log": ["2024-03-01 07:10:00 INFO", "2024-03-01 07:20:00 INFO"],
        "g/x.log.1": slice_of([6, 7]), "g/x.log.2": slice_of([8, 9]),  # the numbers say the contrary of the clocks
        "h/x.log.1": slice_of([6, 7]), "h/x.log.old": slice_of([8]),
    }
    found, templates, _ = stitched(spark, files)
    assert {k: r.gate for k, r in found.items()} == {"a/x.log": "overlap", "b/x.log": "undated", "c/x.log": "shape", "d/x.log": "framing", "e/x.log": "empty", "f/x.log": "hour", "g/x.log": "stitched"}
    assert found["g/x.log"].members == ["g/x.log.1", "g/x.log.2"]
    assert {t.stream for t in templates if t.path[0] in "ag"} == {"a/x.log.1", "a/x.log", "g/x.log"}


def test_empty_corpus(spark):
    records = framing.framed(lines_of(spark, {"a": ["x"]}).where("false"))
    assert records.count() == 0
    assert [x.count() for x in rotation.stitch(records)] == [0, 0, 0]


def test_the_time_shape_is_that_of_all_lines(spark):
    """The first 4,000 lines of a file show another shape than most of its lines."""
    df = spark.range(1, 10001).selectExpr("'a' as path", "id as line_no", "if(id <= 4000, 'Jan  1 10:00:00 x', '2024-01-01 10:00:00 x') as text")
    assert [tuple(r) for r in timing.time_shape(df).collect()] == [("a", "clock", 10000)]
    df = spark.range(1, 10001).selectExpr("'a' as path", "id as line_no", "if(id <= 4000, 'x', '1704103200 x') as text")
    assert [tuple(r) for r in timing.time_shape(df).collect()] == [("a", "epoch", 6000)]


def test_stamps_are_read_once(spark):
    """What is made of readings, the sums along a file among it, doesn't read the texts again."""
    df = spark.range(1, 200).selectExpr("concat('a.log.', id % 2) as path", "id as line_start", "'line' as framing", "concat(if(id % 2 = 0, '2024-01-01 ', ''), lpad(id div 10, 2, '0'), ':00:00 x ', id) as text")
    at = rotation.readings(df)
    for made in (at, rotation.families(rotation.slices(df, at=at))):
        assert "(\\d{2})" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.line_no, r.hour, r.dated) for r in at.collect()} == {(i, i // 10, i % 2 == 0) for i in range(1, 200)}
