"""Inputs that the queries derive from the tables, as DataFrames and as the same SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the integers and strings that log lines are made of."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.regexp_extract("props", r'"k": (\d+)', 1).cast("long")
    return e.select(
        "event_id", "ts", "user_id", "event_type", "props", k.alias("k"),
        F.floor(F.col("value") * 10).cast("long").alias("ms"),
        F.concat(F.lit("h"), F.col("user_id") % 4).alias("host"),
        F.concat(F.lit("10.0."), F.col("user_id") % 8, F.lit("."), F.col("user_id") % 250 + 1).alias("ip"),
        F.when(k < 3, 500 + k).when(k < 10, 404).otherwise(200).cast("long").alias("status"),
        F.when(k < 2, "FATAL").when(k < 15, "WARN").otherwise("INFO").alias("level"),
        F.floor(F.unix_micros("ts") / 1_000_000).cast("long").alias("sec"),
    )


def loglines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, host, line_no, text, ts, event_id and the event's own columns: one file for each host and event type."""
    e = events(spark, sf_dir)
    app = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z "), "level", F.lit(" svc-"), F.col("user_id") % 3, F.lit(" user="), "user_id", F.lit(" took "), "ms", F.lit("ms k="), "k", F.lit(" from "), "ip")
    web = F.concat("ip", F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET /'), "event_type", F.lit("/"), "k", F.lit(' HTTP/1.1" '), "status", F.lit(" "), "ms")
    e = e.withColumns({"text": F.when(F.col("event_type").isin("view", "click"), web).otherwise(app), "path": F.concat("host", F.lit("/logs/"), "event_type", F.lit(".log"))})
    return e.withColumn("line_no", F.row_number().over(W.partitionBy("path").orderBy("ts", "event_id")).cast("long"))


def doclines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, text: documents split at line feeds, blank lines kept."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    return d.select(path.alias("path"), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text")).select("path", "doc_id", (F.col("i") + 1).cast("long").alias("line_no"), "text")


def written(spark: SparkSession, lines: DataFrame, root: str, compression: str = "none") -> None:
    """(path, line_no, text) as one text file for each path, in a folder named by it; see ``path_of``."""
    files = lines.select(F.translate("path", "/", "~").alias("file"), "line_no", "text").repartition("file").sortWithinPartitions("file", "line_no")
    files.select("file", "text").write.mode("append").partitionBy("file").option("compression", compression).text(root)


def path_of(file_path: Column) -> Column:
    """The path that ``written`` named a file by."""
    return F.translate(F.regexp_extract(file_path, "/file=([^/]+)/", 1), "~", "/")


def clocklines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, text, shape, sec: events stamped in one of seven shapes, one file for each host and shape."""
    e = events(spark, sf_dir)
    stamps = {"iso": "yyyy-MM-dd HH:mm:ss", "dmy": "dd.MM.yyyy HH:mm:ss", "bsd": "MMM dd HH:mm:ss", "clf": "dd/MMM/yyyy:HH:mm:ss", "compact": "yyyyMMdd'|'HHmmss'.000|'", "epoch": None, "clock": "HH:mm:ss"}
    shape = F.element_at(F.array(*[F.lit(s) for s in stamps]), (F.expr("user_id div 4") % 7 + 1).cast("int"))
    stamp = F.col("sec").cast("string")
    for name, form in stamps.items():
        stamp = F.when(F.col("shape") == name, F.date_format("ts", form)).otherwise(stamp) if form else stamp
    e = e.withColumn("shape", shape).withColumn("path", F.concat("host", F.lit("/"), "shape", F.lit(".log")))
    n = F.row_number().over(W.partitionBy("path").orderBy("ts", "event_id")).cast("long")
    return e.select("path", n.alias("line_no"), F.concat(stamp, F.lit(" event of "), "user_id").alias("text"), "shape", "sec")


def convlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, conv_id, text: whole conversation turns as lines, 64 conversations to a file."""
    c = table(spark, sf_dir, "conversations")
    c = c.select(F.concat(F.lit("shard-"), F.expr("conv_id div 64")).alias("path"), "conv_id", "turn", "role", F.regexp_replace("text", r"\s+", " ").alias("body"))
    n = F.row_number().over(W.partitionBy("path").orderBy("conv_id", "turn"))
    return c.withColumn("line_no", n.cast("long"))


def rotlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, text: all events on one day, by host and type in three slices of eight hours, in three framings.

    h0's families are whole. h1's slices are cut at half past, so two share an hour; h2 writes no dates; of h3, views and
    clicks overlap, signups and purchases change their stamps, errors change their framing.
    """
    e = events(spark, sf_dir).withColumn("t", F.col("sec") % 86400)
    host, kind = F.col("host"), F.col("event_type")
    cut = F.when(host == "h1", 1800).otherwise(0)
    part = F.floor((F.col("t") + cut) / 28800)
    part = F.when(part > 2, 2).when((host == "h3") & kind.isin("view", "click") & (F.col("event_id") % 10 == 0), 0).otherwise(part)
    e = e.withColumn("part", part)
    day, time = F.lit("2024-02-01"), F.date_format(F.timestamp_seconds(F.col("t")), "HH:mm:ss")
    old = (host == "h3") & kind.isin("signup", "purchase") & (F.col("part") == 0)
    stamp = F.when(host == "h2", time).when(kind.isin("view", "click"), F.concat(F.lit("01/Feb/2024:"), time, F.lit(" +0000"))).when(old, F.concat(F.lit("01.02.2024 "), time)).otherwise(F.concat(day, F.lit("T"), time, F.lit("Z")))
    web = F.concat("ip", F.lit(" - - ["), stamp, F.lit('] "GET /'), kind, F.lit(' HTTP/1.1" '), "status", F.lit(" "), "ms")
    app = F.concat(stamp, F.lit(" "), "level", F.lit(" took "), "ms", F.lit("ms"))
    block = F.array(F.concat(F.lit("Time: "), stamp), F.concat(F.lit("Code: "), "status"), F.concat(F.lit("Took: "), "ms"), F.lit(""))
    flat = F.array(F.concat(stamp, F.lit(" error "), "status", F.lit(" took "), "ms"))
    lines = F.when(kind.isin("view", "click"), F.array(web)).when(kind == "error", F.when((host == "h3") & (F.col("part") == 2), flat).otherwise(block))
    lines = lines.otherwise(F.when(F.col("event_id") % 3 == 0, F.array(app, F.concat(F.lit("  at step "), "k"))).otherwise(F.array(app)))
    suffix = F.element_at(F.array(F.lit(".log.2.gz"), F.lit(".log.1"), F.lit(".log")), (F.col("part") + 1).cast("int"))
    rows = e.select(F.concat(host, F.lit("/"), kind, suffix).alias("path"), "t", "event_id", F.posexplode(lines).alias("i", "text"))
    return rows.select("path", F.row_number().over(W.partitionBy("path").orderBy("t", "event_id", "i")).cast("long").alias("line_no"), "text")


#: The same inputs in DuckDB SQL; each names the ones before it that it needs.
TABLES = {
    "ev": """
SELECT event_id, ts, user_id, event_type, props, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) AS k,
  CAST(floor(value * 10) AS BIGINT) AS ms, 'h' || (user_id % 4) AS host,
  '10.0.' || (user_id % 8) || '.' || (user_id % 250 + 1) AS ip,
  CAST(CASE WHEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) < 3 THEN 500 + CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT)
       WHEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) < 10 THEN 404 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) < 2 THEN 'FATAL'
       WHEN CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) < 15 THEN 'WARN' ELSE 'INFO' END AS level,
  CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS sec
FROM events""",
    "loglines": """
SELECT *, host || '/logs/' || event_type || '.log' AS path, row_number() OVER (PARTITION BY host, event_type ORDER BY ts, event_id) AS line_no,
  CASE WHEN event_type IN ('view', 'click')
    THEN ip || ' - - [' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000] "GET /' || event_type || '/' || k || ' HTTP/1.1" ' || status || ' ' || ms
    ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z ' || level || ' svc-' || (user_id % 3) || ' user=' || user_id || ' took ' || ms || 'ms k=' || k || ' from ' || ip
  END AS text
FROM ev""",
    "clocklines": """
SELECT host || '/' || shape || '.log' AS path, row_number() OVER (PARTITION BY host, shape ORDER BY ts, event_id) AS line_no, shape, sec, ts, user_id
FROM (SELECT *, ['iso', 'dmy', 'bsd', 'clf', 'compact', 'epoch', 'clock'][user_id // 4 % 7 + 1] AS shape FROM ev)""",
    "doclines": """
SELECT lang || '/' || source || '/' || doc_id || '.txt' AS path, doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no,
  unnest(string_split(text, chr(10))) AS text
FROM documents""",
    "rotevents": """
SELECT *, CASE WHEN host = 'h2' THEN time WHEN event_type IN ('view', 'click') THEN '01/Feb/2024:' || time || ' +0000'
    WHEN host = 'h3' AND event_type IN ('signup', 'purchase') AND part = 0 THEN '01.02.2024 ' || time ELSE '2024-02-01T' || time || 'Z' END AS stamp,
  host || '/' || event_type || ['.log.2.gz', '.log.1', '.log'][part + 1] AS path
FROM (SELECT *, strftime(TIMESTAMP '2024-02-01' + to_seconds(t), '%H:%M:%S') AS time,
    CASE WHEN host = 'h3' AND event_type IN ('view', 'click') AND event_id % 10 = 0 THEN 0 ELSE least((t + CASE host WHEN 'h1' THEN 1800 ELSE 0 END) // 28800, 2) END AS part
  FROM (SELECT *, sec % 86400 AS t FROM ev))""",
    "rotrecords": """
SELECT path, host, event_type, part, t, event_id, lines, framing, text, CAST(1 + sum(lines) OVER (PARTITION BY path ORDER BY t, event_id) - lines AS BIGINT) AS line_no, CAST(line_no + lines - 1 - CASE framing WHEN 'block' THEN 1 ELSE 0 END AS BIGINT) AS line_end
FROM (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'line' WHEN event_type = 'error' THEN CASE WHEN host = 'h3' AND part = 2 THEN 'anchor' ELSE 'block' END ELSE CASE WHEN host = 'h2' THEN 'line' ELSE 'anchor' END END AS framing,
    CASE WHEN event_type IN ('view', 'click') THEN 1 WHEN event_type = 'error' THEN CASE WHEN host = 'h3' AND part = 2 THEN 1 ELSE 4 END ELSE CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END END AS lines,
    CASE WHEN event_type IN ('view', 'click') THEN ip || ' - - [' || stamp || '] "GET /' || event_type || ' HTTP/1.1" ' || status || ' ' || ms
      WHEN event_type = 'error' THEN CASE WHEN host = 'h3' AND part = 2 THEN stamp || ' error ' || status || ' took ' || ms ELSE 'Time: ' || stamp || chr(10) || 'Code: ' || status || chr(10) || 'Took: ' || ms END
      ELSE stamp || ' ' || level || ' took ' || ms || 'ms' || CASE WHEN event_id % 3 = 0 AND host <> 'h2' THEN ' at step ' || k ELSE '' END END AS text, k
  FROM rotevents)""",
    "convlines": """
SELECT 'shard-' || (conv_id // 64) AS path, conv_id, turn, role, regexp_replace(text, '\\s+', ' ', 'g') AS body,
  row_number() OVER (PARTITION BY conv_id // 64 ORDER BY conv_id, turn) AS line_no
FROM conversations""",
}


def with_tables(sql: str) -> str:
    """``sql`` after a WITH clause of the derived inputs that it names, and those that they name."""
    need: set[str] = set()

    def add(text: str) -> None:
        for name, body in TABLES.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                add(body)

    add(sql)
    if not need:
        return sql
    own = sql.strip()
    head = ", ".join(f"{n} AS ({TABLES[n]})" for n in TABLES if n in need)
    if own.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {own[15:]}"
    return f"WITH {head}, {own[5:]}" if own.upper().startswith("WITH ") else f"WITH {head} {own}"


def renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, line_no, text: each event, by the hour, in a dated file, a journal that lacks every seventh, and one without years, and a file of notes."""
    e = events(spark, sf_dir).withColumn("hour", F.date_trunc("hour", "ts"))
    body = F.concat(F.lit("app[7]: "), "event_type")
    member = lambda n, v: F.concat(F.lit(f'"{n}":"'), v, F.lit('"'))
    micros = F.unix_micros("hour").cast("string")
    journal = F.concat(F.lit("{"), F.concat_ws(",", member("__REALTIME_TIMESTAMP", micros), member("SYSLOG_IDENTIFIER", F.lit("app")), member("_PID", F.lit("7")), member("_HOSTNAME", F.col("host")), member("MESSAGE", F.col("event_type"))), F.lit("}"))
    zoned = F.from_utc_timestamp("hour", "+02:00")
    iso = F.concat(F.date_format(zoned, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00 "), "host", F.lit(" "), body)
    bsd = F.concat(F.date_format("hour", "MMM dd HH:mm:ss"), F.lit(" "), "host", F.lit(" "), body)
    kinds = F.array(F.struct(F.lit("/app.log").alias("f"), iso.alias("t")), F.struct(F.lit("/journal.json").alias("f"), F.when(F.col("event_id") % 7 != 0, journal).alias("t")), F.struct(F.lit("/syslog").alias("f"), bsd.alias("t")), F.struct(F.lit("/notes.txt").alias("f"), F.concat(F.lit("note "), "k").alias("t")))
    rows = e.select("host", "ts", "event_id", F.explode(kinds).alias("x")).where("x.t is not null").select(F.concat("host", "x.f").alias("path"), "ts", "event_id", F.col("x.t").alias("text"))
    return rows.select("path", F.row_number().over(W.partitionBy("path").orderBy("ts", "event_id")).cast("long").alias("line_no"), "text", "event_id")


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, text: JSON records of five kinds from the events, and of pages: data named, by place, as one string, without any, and broken."""
    e = events(spark, sf_dir)
    head = lambda number, provider=True, channel=F.lit("Security"): F.struct(
        *([F.struct(F.struct(F.lit("App").alias("Name")).alias("#attributes")).alias("Provider")] if provider else []),
        channel.alias("Channel"), number.alias("EventID"), F.col("host").alias("Computer"),
        F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("SystemTime")).alias("#attributes")).alias("TimeCreated"), F.col("event_id").alias("EventRecordID"),
    )
    wrap = lambda system, data: F.to_json(F.struct(F.struct(system.alias("System"), F.struct(data.alias("Data")).alias("EventData")).alias("Event")))
    user = F.concat(F.lit("user"), "user_id")
    named = F.struct(user.alias("TargetUserName"), F.lit("").alias("SubjectUserName"), F.col("k").alias("Count"), F.array(F.lit("first"), F.concat(F.lit("CODE_RED_"), F.col("k") % 3)).alias("#text"))
    placed = F.array(F.concat(F.lit("User="), user, F.lit("\tip="), "ip", F.lit("\nrole=admin \nrole= other\nit=no")), F.concat(F.lit("'acct"), "k", F.lit("' and 'b c'")), F.lit("x" * 121))
    lone = F.concat(F.lit("STATE_OLD_VALUE from 8.8.4."), F.col("k") % 200 + 1, F.lit(", 10.1.2.3, 100.64.0.1, 8.8.8.300"))
    kinds = [wrap(head(F.lit(4624)), named), wrap(head(F.struct(F.lit("4625").alias("#text"))), placed), wrap(head(F.lit(1), False, F.lit(7)), lone), F.to_json(F.struct(head(F.lit(2)).alias("System"))), F.lit('{"Event": {')]
    text = F.coalesce(*[F.when(F.col("event_id") % 5 == i, k) for i, k in enumerate(kinds)])  # only the row's own kind is written
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("row"), F.to_json(F.struct(F.struct(F.struct(F.struct(F.array("url", "html").alias("Data")).alias("EventData")).alias("Event")).alias("x"))).alias("text"))
    p = p.select("row", F.expr("substring(text, 6, length(text) - 6)").alias("text"))  # without the outer object
    return e.select(F.concat(F.lit("e"), "event_id").alias("row"), text.alias("text")).unionByName(p)
