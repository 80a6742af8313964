"""Queries that run the streaming jobs over the tables' files to their end."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.plans.fixtures import loglines
from siftlog.plans.registry import query
from siftlog.streaming import jobs as S
from siftlog.streaming.late import windowed
from siftlog.streaming.lines import tail_lines
from siftlog.streaming.records import STORE, framed
from siftlog.work import work_base, work_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark, d):
    return _shaped(S.tail(spark, f"{d}/events.parquet*", EVENTS))


def _shaped(e):
    return e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("host", F.concat(F.lit("h"), F.col("user_id") % 4))


def feed(spark, d, root, parts=range(4), each=None):
    """Appends quarters of the events, by their ids, one after another to a folder; ``each`` files of them where it is given."""
    e = spark.read.parquet(f"{d}/events.parquet")
    last = e.agg(F.max("event_id")).first()[0] or 0
    for i in parts:
        part = e.where(F.floor(F.col("event_id") * 4 / (last + 1)) == i)
        (part.coalesce(each) if each else part).write.mode("append").parquet(root)
    return root


@query("stream_tail", "SELECT event_id, user_id, event_type FROM events")
def stream_tail(spark, d):
    """Two runs with one cursor: half of the files is there before the first, the rest comes before the second."""
    root, out = work_path(spark, "feed"), work_path(spark, "tail")
    for parts in (range(2), range(2, 4)):
        feed(spark, d, root, parts)
        rows = S.into(spark, S.tail(spark, root, EVENTS).select("event_id", "user_id", "event_type"), out)
    return rows.drop("tick")


@query("stream_manifest", """
WITH p AS (SELECT event_id, event_id * 4 // ((SELECT max(event_id) FROM events) + 1) AS tick FROM events WHERE event_id % 50 <> 7 AND event_id >= 5),
t AS (SELECT tick, count(*) AS rows, min(event_id) AS lo, max(event_id) AS hi, max(event_id) - min(event_id) + 1 - count(*) AS gap FROM p GROUP BY tick)
SELECT tick, rows, lo, hi, gap, coalesce(lo - lag(hi) OVER (ORDER BY tick) - 1, 0) AS skipped, CASE WHEN tick = 0 THEN lo ELSE 0 END AS truncated_head FROM t""")
def stream_manifest(spark, d):
    """Four files and ticks; events that never came leave gaps inside them, between them and before the first."""
    files = S.tail(spark, feed(spark, d, work_path(spark, "feed"), each=1), EVENTS).where("event_id % 50 <> 7 and event_id >= 5")
    return S.manifest(spark, files, work_base(spark), "event_id")


@query("stream_stale", """
WITH s AS (SELECT user_id, max(ts) AS seen, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, seen, n, seen <= (SELECT max(seen) FROM s) - INTERVAL 12 HOUR AS stale FROM s""")
def stream_stale(spark, d):
    seen = S.settled(spark, S.last_seen(_shaped(S.tail(spark, feed(spark, d, work_path(spark, "feed")), EVENTS)), "user_id"), work_base(spark), ["user_id"])
    return S.stale(seen, "12 hours").withColumn("seen", F.col("seen").cast("timestamp_ntz"))


@query("stream_outcome", "SELECT event_type, time_bucket(INTERVAL 10 MINUTE, ts) AS begin, count(*) AS n FROM events GROUP BY ALL")
def stream_outcome(spark, d):
    # The files need not be in time order, so no watermark: it would drop events of later files, and hold the last windows back.
    out = S.settled(spark, S.tumbling(stream(spark, d), ["event_type"], late=None), work_base(spark), ["event_type", "begin"])
    return out.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


@query("threshold_alert", """
WITH w AS (SELECT host, ts, user_id, unnest(range(0, 12)) AS i FROM (SELECT 'h' || (user_id % 4) AS host, ts, user_id FROM events)),
g AS (SELECT host, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(CAST(5 * i AS INTEGER)) AS begin, user_id FROM w)
SELECT host, begin, count(*) AS n, count(DISTINCT user_id) AS sources FROM g GROUP BY host, begin HAVING count(*) >= 5 AND count(DISTINCT user_id) >= 3""")
def threshold_alert(spark, d):
    counts = S.tallied(spark, S.with_pane(stream(spark, d)), work_base(spark), ["host", "begin", "user_id"])
    return S.threshold_alerts(counts, "host", "user_id", 5, 3).select("host", F.col("begin").cast("timestamp_ntz").alias("begin"), "n", "sources")


@query("id_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def id_sessions(spark, d):
    files = _shaped(S.tail(spark, feed(spark, d, work_path(spark, "feed")), EVENTS))
    out = S.final(spark, S.sessions(files, ["user_id"], late=None), work_base(spark))
    return out.withColumn("first", F.col("first").cast("timestamp_ntz")).withColumn("last", F.col("last").cast("timestamp_ntz"))


@query("stream_newcomer", "SELECT 'h' || (user_id % 4) AS host, CAST(user_id AS VARCHAR) AS actor FROM events GROUP BY ALL")
def stream_newcomer(spark, d):
    e = _shaped(S.tail(spark, feed(spark, d, work_path(spark, "feed")), EVENTS)).withColumn("actor", F.col("user_id").cast("string"))
    return S.collected(spark, S.newcomers(e, "host", "actor"), work_base(spark)).select("host", "actor")


@query("stream_frames", """
WITH l AS (SELECT 'h' || (user_id % 4) AS path, event_id AS line_no, event_type FROM events),
r AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS run FROM l),
f AS (SELECT path, run, min(line_no) AS line_start, string_agg(event_type, ' ' ORDER BY line_no) AS text FROM r GROUP BY path, run)
SELECT path, line_start, text FROM f WHERE run < (SELECT max(run) FROM f g WHERE g.path = f.path)""")
def stream_frames(spark, d):
    lines = _shaped(S.tail(spark, feed(spark, d, work_path(spark, "feed"), each=1), EVENTS)).select(F.col("host").alias("path"), F.col("event_id").alias("line_no"), F.col("event_type").alias("text"))
    return S.collected(spark, S.frames(lines, "^error$", quiet=None), work_base(spark))


#: Tenths of the month by time; a tenth of the events come two files late, another tenth twice.
_DELAYED = """t AS (SELECT *, 'h' || (user_id % 4) AS host, epoch_us(ts) - min(epoch_us(ts)) OVER () AS since, max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1 AS span FROM events),
f AS (SELECT *, least(CAST(since * 10 // span AS BIGINT) + CASE event_id % 10 WHEN 3 THEN 2 ELSE 0 END, 9) AS tick FROM t),
z AS (SELECT tick, max(max(ts)) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - INTERVAL 2 DAY AS horizon FROM f GROUP BY tick),
r AS (SELECT f.*, horizon IS NOT NULL AND ts <= horizon AS late FROM f JOIN z USING (tick)),
e AS (SELECT max(ts) - INTERVAL 2 DAY AS done FROM f)"""


def delayed(spark, d, root):
    """Ten files of events: by time, but for rows that come two files late, and rows that come twice."""
    e = _shaped(spark.read.parquet(f"{d}/events.parquet")).select("event_id", "ts", "host")
    low, high = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    tick = F.floor((F.unix_micros("ts") - low) * 10 / (high - low + 1)).cast("long") if low is not None else F.lit(0)
    e = e.withColumn("tick", F.least(tick + F.when(F.col("event_id") % 10 == 3, 2).otherwise(0), F.lit(9)))
    e = e.unionByName(e.where("event_id % 10 = 4"))
    for i in range(10):
        e.where(F.col("tick") == i).drop("tick").coalesce(1).write.mode("append").parquet(root)
    return S.tail(spark, root, "event_id long, ts timestamp, host string")


@query("stream_late", f"""
WITH {_DELAYED}, w AS (SELECT host, CAST(date_trunc('day', ts) AS TIMESTAMP) AS begin, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) + count(*) FILTER (late AND event_id % 10 = 4) AS late FROM r GROUP BY ALL)
SELECT host, begin, CASE WHEN begin + INTERVAL 1 DAY <= (SELECT done FROM e) AND n > 0 THEN n END AS n, late FROM w WHERE late > 0 OR begin + INTERVAL 1 DAY <= (SELECT done FROM e)""")
def stream_late(spark, d):
    """Days that the watermark has closed, and by day the rows that came after it."""
    windows, late = windowed(spark, delayed(spark, d, work_path(spark, "feed")), ["host"], "event_id", work_path(spark, "late"), delay="2 days")
    late = late.groupBy("host", F.date_trunc("day", "ts").alias("begin")).agg(F.count("*").alias("late"))
    out = windows.join(late, ["host", "begin"], "full_outer")
    return out.select("host", F.col("begin").cast("timestamp_ntz").alias("begin"), "n", F.coalesce("late", F.lit(0)).alias("late"))


@query("stream_records", """
WITH l AS (SELECT 'u' || user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, ts, event_type, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
r AS (SELECT *, sum(CASE WHEN prev IS NULL OR event_type = 'error' OR epoch_ms(ts) - epoch_ms(prev) >= 86400000 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS run FROM l),
g AS (SELECT path, run, min(line_no) AS line_start, max(line_no) AS line_end, string_agg(event_type, ' ' ORDER BY line_no) AS text, max(ts) AS last FROM r GROUP BY path, run)
SELECT path, line_start, line_end, text FROM g WHERE run < (SELECT max(run) FROM g h WHERE h.path = g.path) OR epoch_ms(last) + 86400000 <= (SELECT max(epoch_ms(ts)) - 3600000 FROM events)""")
def stream_records(spark, d):
    """Each user's events as lines; a record ends at the next error, or when its user is quiet for a day. A restart lies between two runs."""
    root, out = work_path(spark, "feed"), work_path(spark, "records")
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    lines = e.select(F.concat(F.lit("u"), "user_id").alias("path"), at.alias("line_no"), "ts", F.col("event_type").alias("text"))
    low, high = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - low) * 6 / (high - low + 1)) if low is not None else F.lit(0)
    rows = None
    for i in range(6):
        lines.where(part == i).coalesce(1).write.mode("append").parquet(root)
        if i in (2, 5):
            tail = S.tail(spark, root, "path string, line_no long, ts timestamp, text string")
            rows = S.into(spark, framed(tail, "^error$", "1 day", "1 hour"), out, store=STORE)
    return rows.drop("tick")


@query("stream_lines", "SELECT replace(path, '/', '~') AS path, line_no, text FROM loglines")
def stream_lines(spark, d):
    """Log files that come in four chunks over two runs, numbered on as one file each."""
    root, out = work_path(spark, "chunks"), work_path(spark, "lines")
    lines = loglines(spark, d).select(F.translate("path", "/", "~").alias("file"), "line_no", "text")
    lines = lines.join(lines.groupBy("file").agg(F.count("*").alias("all")), "file").withColumn("chunk", F.floor((F.col("line_no") - 1) * 4 / F.col("all")))
    for run in (0, 1):
        own = lines.where(F.floor(F.col("chunk") / 2) == run).repartition("file").sortWithinPartitions("file", "chunk", "line_no")
        own.select("file", "chunk", "text").write.mode("append").partitionBy("file", "chunk").text(root)
        rows = tail_lines(spark, root, out)
    return rows.select(F.regexp_replace("path", "^file=", "").alias("path"), "line_no", "text")
