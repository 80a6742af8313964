"""Queries over sources, framings and clocks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.functions import clock as C
from siftlog.operators import framing as R
from siftlog.operators import timing as T
from siftlog.plans.fixtures import clocklines, convlines, doclines, events, loglines, path_of, table, written
from siftlog.plans.registry import query
from siftlog.plans.text_queries import SQL_PATH
from siftlog.sources import lines as L
from siftlog.sources import records as S
from siftlog.work import work_path


@query("scan_corpus", "SELECT path, count(*) AS lines FROM loglines GROUP BY path")
def scan_corpus(spark, d):
    """Files on disk, those of web events as gzip, found below one root; copies in folders of caches are passed over."""
    lines, root = loglines(spark, d), work_path(spark, "corpus")
    web = F.col("event_type").isin("view", "click")
    written(spark, lines.where(web), f"{root}/a", "gzip")
    written(spark, lines.where(~web), f"{root}/b/c")
    written(spark, lines.where("event_type = 'error'"), f"{root}/b/node_modules/x")
    found = L.read_lines(spark, root)
    return found.groupBy(path_of(F.col("path")).alias("path")).agg(F.count("*").alias("lines"))


@query("numbered_lines", "SELECT path, line_no, text FROM loglines")
def numbered_lines(spark, d):
    """Lines read back from text files, every other host's as gzip, with the numbers that they have there."""
    lines, root = loglines(spark, d), work_path(spark, "lines")
    packed = F.col("host").isin("h0", "h2")
    written(spark, lines.where(packed), f"{root}/z", "gzip")
    written(spark, lines.where(~packed), f"{root}/p")
    return L.read_lines(spark, root).select(path_of(F.col("path")).alias("path"), "line_no", "text")


@query("binary_guard", """
WITH m AS (SELECT doc_id, max(line_no) AS last FROM doclines GROUP BY doc_id),
l AS (SELECT path, doc_id, line_no, last, sum(strlen(text) + 1 + CASE WHEN line_no = last AND doc_id % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) - strlen(text) - 1 AS start FROM doclines JOIN m USING (doc_id))
SELECT path, bool_or(doc_id % 3 = 0 AND line_no = last AND start <= 8192) AS "binary" FROM l GROUP BY path""")
def binary_guard(spark, d):
    """A NUL before the last line of every third file: the guard sees it only where it stands early enough."""
    lines = doclines(spark, d)
    last = lines.groupBy("path").agg(F.max("line_no").alias("last"))
    nul = F.when((F.col("line_no") == F.col("last")) & (F.col("doc_id") % 3 == 0), F.concat(F.lit("\x00"), "text")).otherwise(F.col("text"))
    return L.binary_files(lines.join(last, "path").select("path", "line_no", nul.alias("text")))


@query("strip_ansi", "SELECT path, line_no, text FROM loglines")
def strip_ansi(spark, d):
    coloured = F.concat(F.lit("\x1b[31m"), F.col("text"), F.lit("\x1b[0m"))
    return loglines(spark, d).select("path", "line_no", L.strip_ansi(coloured).alias("text"))


@query("json_events", "SELECT event_id, k FROM ev WHERE event_id % 7 > 1")
def json_events(spark, d):
    """JSON lines on disk; of seven one is cut off and one holds a text for the number."""
    e, k = events(spark, d), F.col("event_id") % 7
    row = F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "props": '), F.when(k == 1, '{"k": "none"}').otherwise(F.col("props")), F.lit("}"))
    e.select(F.when(k == 0, F.substring(row, 1, 14)).otherwise(row).alias("value")).write.text(path := work_path(spark, "json"))
    return S.read_jsonl(spark, path, "event_id long, props struct<k:long>").select("event_id", "props.k")


@query("table_scan", """
SELECT CAST(l_orderkey AS BIGINT) AS src, CASE WHEN l_linenumber <> 2 THEN CAST(l_partkey AS BIGINT) END AS dport, CASE WHEN l_linenumber NOT IN (2, 4) THEN CAST(floor(l_extendedprice) AS BIGINT) END AS bytes FROM lineitem""")
def table_scan(spark, d):
    """A tab-separated table on disk whose second and fourth lines of an order are short and whose third is long."""
    n, cell = F.col("l_linenumber"), lambda c: F.col(c).cast("long").cast("string")
    row = F.concat_ws("\t", cell("l_orderkey"), F.when(n != 2, cell("l_partkey")), F.when(~n.isin(2, 4), F.floor("l_extendedprice").cast("string")), F.when(n == 3, "more"))
    rows = table(spark, d, "lineitem").select(row.alias("src\tdport\tbytes"))
    rows.write.option("header", True).option("sep", "\x01").option("quote", "\x02").csv(path := work_path(spark, "table"))
    return S.read_table(spark, path).select(*[F.col(c).cast("long").alias(c) for c in ("src", "dport", "bytes")])


@query("load_labels", """SELECT 'shard-' || (doc_id // 64) || '.json' AS path, doc_id AS line_no, label FROM (SELECT doc_id, unnest(CASE WHEN quality = 0 AND toxic = 1 THEN ['bad', 'toxic'] WHEN quality = 0 THEN ['bad'] WHEN toxic = 1 THEN ['toxic'] ELSE [] END) AS label FROM labels WHERE doc_id % 10 > 0)""")
def load_labels(spark, d):
    """Label files on disk, one for 64 documents; every tenth line is no JSON."""
    marks = F.array_compact(F.array(F.when(F.col("quality") == 0, "bad"), F.when(F.col("toxic") == 1, "toxic")))
    row = F.to_json(F.struct(F.col("doc_id").alias("line"), marks.alias("labels")))
    path = F.concat(F.lit("shard-"), F.expr("doc_id div 64"), F.lit(".json"))
    lines = table(spark, d, "labels").select(path.alias("path"), F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("#"), row)).otherwise(row).alias("text"))
    written(spark, lines, root := work_path(spark, "labels"))
    return S.read_labels(spark, root).select(path_of(F.col("path")).alias("path"), "line_no", "label")


@query("truth_spans", f"""
WITH t AS (SELECT d.doc_id, toxic = 1 AS is_decoy, {SQL_PATH} AS path, unnest(CASE doc_id % 3 WHEN 0 THEN [{{'lo': 1, 'hi': 3}}, {{'lo': 5, 'hi': 6}}] WHEN 1 THEN [{{'lo': 2, 'hi': 2}}] ELSE [{{'lo': 4, 'hi': 4}}] END) AS s FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0 OR toxic = 1)
SELECT 'set-' || (doc_id // 16) AS dataset, 'D' || doc_id AS defect_id, is_decoy, path, CAST(s.lo AS BIGINT) AS lo, CAST(s.hi AS BIGINT) AS hi FROM t""")
def truth_spans(spark, d):
    """Answer keys on disk: every other one lists its defects, the rest name them; a third of the defects has an anchor only."""
    marks = table(spark, d, "labels").where("quality = 0 or toxic = 1").select("doc_id", F.when(F.col("toxic") == 1, "Red herring: noise").otherwise("broken").alias("title"))
    docs = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("file")).join(marks, "doc_id")
    span = lambda lo, hi: F.struct("file", F.lit(lo).alias("line_start"), (F.lit(hi) if hi else F.lit(None).cast("int")).alias("line_end"))
    k = F.col("doc_id") % 3
    places = F.when(k == 1, F.array(span(2, None))).when(k == 0, F.array(span(1, 3)))
    more, anchor = F.when(k == 0, F.array(span(5, 6))), F.when(k == 2, F.concat("file", F.lit(":4")))
    defect = F.struct("title", places.alias("proof_locations"), more.alias("alternate_proof_locations"), anchor.alias("anchor"))
    name = F.concat(F.lit("D"), "doc_id")
    keys = docs.withColumns({"name": name, "defect": defect}).groupBy(F.concat(F.lit("set-"), F.expr("doc_id div 16")).alias("dataset"), (F.expr("doc_id div 16") % 2 == 0).alias("listed"))
    keys = keys.agg(F.collect_list(F.struct("name", "defect")).alias("d"))  # 16 at most
    listed = F.to_json(F.struct("dataset", F.transform("d", lambda x: x["defect"].withField("id", x["name"])).alias("defects")))
    named = F.to_json(F.struct("dataset", F.map_from_entries("d").alias("defects")))
    keys.select(F.when(F.col("listed"), listed).otherwise(named).alias("value")).write.text(path := work_path(spark, "keys"))
    return S.read_truth(spark, path)


@query("ledger_load", "SELECT 'ds' || (user_id % 3) AS dataset, event_type AS arm, event_id AS seq, ms AS duration, k AS tokens FROM ev WHERE event_id % 9 > 0")
def ledger_load(spark, d):
    """A ledger of runs as JSON lines on disk; every ninth is cut off."""
    e = events(spark, d)
    row = F.to_json(F.struct(F.concat(F.lit("ds"), F.col("user_id") % 3).alias("dataset"), F.col("event_type").alias("arm"), F.col("event_id").alias("seq"), F.col("ms").alias("duration"), F.col("k").alias("tokens"), F.lit("x").alias("answer")))
    e.select(F.when(F.col("event_id") % 9 == 0, F.substring(row, 1, 30)).otherwise(row).alias("value")).write.text(path := work_path(spark, "ledger"))
    return S.read_jsonl(spark, path, "dataset string, arm string, seq long, duration long, tokens long")


@query("fetch_lines", "SELECT path, line_no, text FROM doclines WHERE line_no = doc_id % 5 + 1")
def fetch_lines(spark, d):
    docs = doclines(spark, d)
    wanted = table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), (F.col("doc_id") % 5 + 1).alias("line_no"))
    return L.fetch_lines(docs, wanted).select("path", "line_no", "text")


@query("small_files", "SELECT path, line_no, substr(text, 1, 300) AS text, length(text) > 300 AS cut FROM doclines WHERE path IN (SELECT path FROM doclines GROUP BY path HAVING sum(strlen(text) + 1) < 4096)")
def small_files(spark, d):
    return L.small_files(doclines(spark, d))


@query("host_index", "SELECT host, count(DISTINCT path) AS files, count(*) AS rows FROM loglines GROUP BY host")
def host_index(spark, d):
    return L.host_index(loglines(spark, d))


@query("frame_choice", """
SELECT path, CASE WHEN avg(CASE WHEN regexp_matches(text, '^[^A-Za-z0-9_]{0,3}\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}') THEN 1 ELSE 0 END) >= 0.55 THEN 'anchor' ELSE 'line' END AS framing,
  avg(CASE WHEN regexp_matches(text, '^\\S+ \\S+ \\S+ \\[\\d{2}/[A-Za-z]{3}/\\d{4}(:\\d{2}){3} [-+]\\d{4}\\] "[^"]*" \\d{3} (\\d+|-)') THEN 1 ELSE 0 END) >= 0.9 AS one_line_grammar
FROM loglines GROUP BY path""")  # fmt: skip
def frame_choice(spark, d):
    return R.frame_choice(loglines(spark, d))


@query("frame_line", "SELECT path, line_no AS line_start, line_no AS line_end, text FROM doclines WHERE trim(text) <> ''")
def frame_line(spark, d):
    return R.frame_line(doclines(spark, d))


@query("frame_anchor", r"""
WITH f AS (SELECT path, line_no, trim(text) AS text FROM doclines WHERE trim(text) <> ''),
r AS (SELECT *, sum(CASE WHEN regexp_matches(text, '^[A-Z]') THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS run FROM f)
SELECT path, min(line_no) AS line_start, max(line_no) AS line_end, string_agg(text, ' ' ORDER BY line_no) AS text FROM r GROUP BY path, run""")
def frame_anchor(spark, d):
    return R.frame_anchor(doclines(spark, d), start="^[A-Z]")


@query("frame_block", r"""
WITH b AS (SELECT *, coalesce(lag(trim(text) = '') OVER (PARTITION BY path ORDER BY line_no), true) AS opens FROM doclines),
r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS run FROM b WHERE trim(text) <> '')
SELECT path, min(line_no) AS line_start, max(line_no) AS line_end, string_agg(text, chr(10) ORDER BY line_no) AS text FROM r GROUP BY path, run""")
def frame_block(spark, d):
    return R.frame_block(doclines(spark, d))


@query("frame_cri", r"""
WITH o AS (SELECT *, coalesce(lag(role <> 'user') OVER (PARTITION BY path ORDER BY line_no), true) AS opens FROM convlines),
r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS run FROM o)
SELECT path, min(line_no) AS line_start, max(line_no) AS line_end, string_agg(CASE WHEN opens THEN role || ' ' || body ELSE body END, '' ORDER BY line_no) AS text FROM r GROUP BY path, run""")
def frame_cri(spark, d):
    c = convlines(spark, d).withColumn("text", F.concat("role", F.lit(" "), "body"))
    return R.frame_cri(c, F.col("role") == "user", F.col("body"))


@query("frame_key", r"""
WITH o AS (SELECT *, coalesce(lag(conv_id) OVER (PARTITION BY path ORDER BY line_no) <> conv_id, true) AS opens FROM convlines),
r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS run FROM o)
SELECT path, min(line_no) AS line_start, max(line_no) AS line_end, string_agg(body, chr(10) ORDER BY line_no) AS text FROM r GROUP BY path, run""")
def frame_key(spark, d):
    return R.frame_key(convlines(spark, d).withColumn("text", F.col("body")), F.col("conv_id"))


@query("detect_key", """
WITH l AS (SELECT event_type, event_id, unnest(range(0, event_id % 3 + 1)) AS part FROM ev WHERE event_type IN ('signup', 'purchase'))
SELECT event_type AS path, 'serial' AS field, count(DISTINCT event_id) AS runs, count(*) AS n, count(DISTINCT event_id) AS "distinct" FROM l GROUP BY event_type""")
def detect_key(spark, d):
    """Events of one to three lines. Views are whole JSON objects, clicks have no clock, the serials of errors come back; the rest has one key."""
    e = events(spark, d).withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    stamp, kind = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("event_type")
    serial = F.when(kind == "error", F.col("event_id") % 40).otherwise(F.col("event_id"))
    text = F.concat(F.when(kind == "click", "at no time").otherwise(stamp), F.lit(" serial="), serial, F.lit(" part="), "part", F.when(kind == "click", "").otherwise(F.concat(F.lit(" stamp="), stamp)), F.lit(" host="), "host")
    text = F.when(kind == "view", F.to_json(F.struct(serial.alias("serial"), "part", stamp.alias("stamp")))).otherwise(text)
    lines = e.select(kind.alias("path"), (F.col("event_id") * 4 + F.col("part")).alias("line_no"), text.alias("text"))
    field = lambda name, form=r"\S+": F.nullif(F.regexp_extract("text", f"{name}=({form})", 1), F.lit(""))
    return R.detect_key(lines, {"serial": field("serial"), "part": field("part"), "stamp": field("stamp", r"\S+ \S+"), "host": field("host")})


@query("json_guard", "SELECT event_type AS path, 10 * count(*) FILTER (event_type <> 'view' OR k % 5 > 0) >= 9 * count(*) AS whole_json FROM ev GROUP BY event_type")
def json_guard(spark, d):
    """Views whose number ends in 0 or 5 are cut off in the middle."""
    cut = (F.col("event_type") == "view") & (F.col("k") % 5 == 0)
    return R.json_guard(events(spark, d).select(F.col("event_type").alias("path"), F.when(cut, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("text")))


@query("clock_residue", r"SELECT path, line_no, regexp_replace(text, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} \+\d{4}', '') AS residue FROM loglines")
def clock_residue(spark, d):
    return loglines(spark, d).select("path", "line_no", T.clock_residue(F.col("text")).alias("residue"))


@query("informative_fields", r"""
SELECT path, min(line_no) AS line_start, string_agg(text, chr(10) ORDER BY line_no) AS text
FROM doclines WHERE trim(text) <> '' AND NOT regexp_matches(text, '^[A-Za-z_][A-Za-z0-9_.-]*[:=]\s*$') GROUP BY path""")
def informative_fields(spark, d):
    docs = doclines(spark, d).where((F.trim("text") != "") & ~F.col("text").rlike(r"^[A-Za-z_][A-Za-z0-9_.-]*[:=]\s*$")).groupBy("path").agg(F.min("line_no").alias("line_start"))
    whole = table(spark, d, "documents").select(F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), R.informative_fields(F.col("text")).alias("text"))
    return docs.join(whole, "path")


@query("time_shape", """
WITH c AS (SELECT path, shape, count(*) AS hits FROM clocklines GROUP BY ALL),
l AS (SELECT path, CASE WHEN event_type IN ('view', 'click') THEN 'clf' ELSE 'iso' END AS shape, count(*) AS hits FROM loglines GROUP BY ALL)
SELECT path, shape, hits FROM c WHERE hits > 0 UNION ALL SELECT path, shape, hits FROM l""")
def time_shape(spark, d):
    cols = ["path", "line_no", "text"]
    return T.time_shape(clocklines(spark, d).select(cols).unionByName(loglines(spark, d).select(cols)))


@query("clock_readings", """
WITH g AS (SELECT *, sec % 86400 AS sod, lag(sec % 86400) OVER (PARTITION BY path ORDER BY line_no) AS prev FROM clocklines),
c AS (SELECT *, sod + 86400 * sum(CASE WHEN sod < prev - 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line_no) AS carried, shape NOT IN ('bsd', 'clock') AS dated FROM g)
SELECT path, line_no, shape, CAST(sod // 3600 AS INTEGER) AS hour, CAST(CASE WHEN dated THEN sec ELSE carried END AS BIGINT) AS reading, dated FROM c""")
def clock_readings(spark, d):
    """Lines stamped in all seven shapes, over many midnights."""
    return T.clock_readings(clocklines(spark, d))


@query("parse_clock", "SELECT path, line_no, sec FROM loglines")
def parse_clock(spark, d):
    return loglines(spark, d).select("path", "line_no", F.unix_timestamp(C.clock(F.col("text"))).alias("sec"))


@query("epoch_norm", "SELECT event_id, sec AS seconds FROM ev")
def epoch_norm(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.col("sec")).when(F.col("event_id") % 3 == 1, F.col("sec") * 1000).otherwise(F.col("sec") * 1_000_000).cast("string")
    return events(spark, d).select("event_id", F.floor(C.epoch_seconds(raw)).cast("long").alias("seconds"))


@query("epoch_is_clock", """
WITH g AS (SELECT event_type, event_id, sec, lag(sec) OVER (PARTITION BY event_type ORDER BY event_id) AS prev FROM ev)
SELECT event_type, count(*) AS n, count(*) >= 20 AND max(sec) - min(sec) <= 90 * 86400 AND 10 * count(*) FILTER (sec >= prev) >= 7 * (count(*) - 1) AS is_clock FROM g GROUP BY event_type""")
def epoch_is_clock(spark, d):
    return T.epoch_is_clock(events(spark, d), "event_type", "event_id", "sec")


@query("midnight_carry", """
WITH g AS (SELECT host, event_id, sec % 86400 AS sod, lag(sec % 86400) OVER (PARTITION BY host ORDER BY event_id) AS prev FROM ev)
SELECT host, event_id, CAST(sod + 86400 * sum(CASE WHEN sod < prev - 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY event_id) AS BIGINT) AS carried FROM g""")
def midnight_carry(spark, d):
    return T.midnight_carry(events(spark, d).withColumn("sod", F.col("sec") % 86400), "host", "event_id", "sod")


@query("hour_bucket", "SELECT path, line_no, CAST(hour(ts) AS INTEGER) AS hour FROM loglines")
def hour_bucket(spark, d):
    return loglines(spark, d).select("path", "line_no", C.hour_of(F.col("text")).alias("hour"))


@query("stream_state", """
SELECT path, 'stream' AS kind, shape FROM clocklines GROUP BY ALL UNION ALL SELECT path, 'stream', CASE WHEN event_type IN ('view', 'click') THEN 'clf' ELSE 'iso' END FROM loglines GROUP BY ALL
UNION ALL SELECT 'shuffled/' || event_type, 'stream-unordered', 'iso' FROM ev GROUP BY ALL
UNION ALL SELECT 'sparse/' || event_type, CASE WHEN count(*) FILTER (event_id % 4 = 0) >= 20 THEN 'stream-sparse' ELSE 'state' END, 'iso' FROM ev GROUP BY ALL
UNION ALL SELECT 'plain/' || event_type, 'state', NULL FROM ev GROUP BY ALL""")
def stream_state(spark, d):
    """Files in all shapes, files whose lines are out of order, files with a stamp on every fourth line only, files without any."""
    cols, e = ["path", "line_no", "text"], events(spark, d)
    name = lambda kind: F.concat(F.lit(f"{kind}/"), "event_type").alias("path")
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    shuffled = e.select(name("shuffled"), F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 12), 16, 10).cast("long").alias("line_no"), stamp.alias("text"))
    order = F.struct("ts", "event_id")
    sparse = e.select(name("sparse"), F.row_number().over(W.partitionBy("event_type").orderBy(order)).cast("long").alias("line_no"), F.when(F.col("event_id") % 4 == 0, stamp).otherwise("no stamp here").alias("text"))
    plain = e.select(name("plain"), F.col("event_id").alias("line_no"), F.concat(F.lit("key = "), "k").alias("text"))
    files = clocklines(spark, d).select(cols).unionByName(loglines(spark, d).select(cols)).unionByName(shuffled).unionByName(sparse).unionByName(plain)
    return T.stream_state(files)


@query("column_clock", """
WITH u AS (SELECT o_orderkey AS pos, 'o_orderkey' AS col, CAST(o_orderkey AS DOUBLE) AS v FROM orders UNION ALL SELECT o_orderkey, 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders UNION ALL SELECT o_orderkey, 'o_totalprice', CAST(o_totalprice AS DOUBLE) FROM orders),
g AS (SELECT *, lag(v) OVER (PARTITION BY col ORDER BY pos) AS prev FROM u)
SELECT col, count(*) AS n FROM g GROUP BY col HAVING count(*) >= 10 AND count(DISTINCT v) >= 3 AND 10 * count(*) FILTER (v >= prev) >= 9 * (count(*) - 1)""")
def column_clock(spark, d):
    return T.column_clock(table(spark, d, "orders"), "o_orderkey", ["o_orderkey", "o_custkey", "o_totalprice"])


@query("raw_ts", r"SELECT path, line_no, CASE WHEN event_type IN ('view', 'click') THEN strftime(ts, '%d/%b/%Y:%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS stamp FROM loglines")
def raw_ts(spark, d):
    return loglines(spark, d).select("path", "line_no", C.raw_stamp(F.col("text")).alias("stamp"))


@query("clock_gap", """
WITH p AS (SELECT host, arg_min(sec, (-k, event_id)) % 86400 AS peak FROM ev GROUP BY host)
SELECT event_id, least((sec % 86400 - peak + 86400) % 86400, 86400 - (sec % 86400 - peak + 86400) % 86400) AS gap FROM ev JOIN p USING (host)""")
def clock_gap(spark, d):
    e = events(spark, d)
    peak = e.groupBy("host").agg((F.min_by("sec", F.struct(-F.col("k"), "event_id")) % 86400).alias("peak"))
    return e.join(peak, "host").select("event_id", C.clock_gap(F.col("sec") % 86400, F.col("peak")).alias("gap"))


@query("render_key", r"""
SELECT path, line_no, 'utc' AS base, CASE WHEN event_type IN ('view', 'click') THEN sec WHEN k % 3 = 1 THEN sec - 7200 WHEN k % 3 = 2 THEN sec + 19800 ELSE sec END AS sec,
  regexp_replace(text, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} \+\d{4}', '') AS body FROM loglines
UNION ALL SELECT path, line_no, 'yearless', ((month(ts) * 31 + day(ts)) * 86400 + sec % 86400)::BIGINT, ' event of ' || user_id FROM clocklines WHERE shape = 'bsd'""")
def render_key(spark, d):
    """Stamps with an offset, and stamps without a year."""
    k = F.col("k") % 3
    zone = F.when(k == 1, "+02:00").when(k == 2, "-0530").otherwise("Z")
    moved = loglines(spark, d).select("path", "line_no", F.when(F.col("event_type").isin("view", "click"), F.col("text")).otherwise(F.concat(F.substring("text", 1, 19), zone, F.expr("substr(text, 21)"))).alias("text"))
    return T.render_key(moved.unionByName(clocklines(spark, d).where("shape = 'bsd'").select("path", "line_no", "text")))


@query("telemetry_gap", """
WITH c AS (SELECT max(sec) AS now FROM ev), h AS (SELECT host, event_type, max(sec) AS newest, count(*) AS n FROM ev GROUP BY ALL)
SELECT host, event_type, n, now - newest AS age_s, (now - newest) // 3600 AS age_h FROM h, c""")
def telemetry_gap(spark, d):
    return T.telemetry_gap(events(spark, d), ["host", "event_type"], "sec")


@query("burst_spread", """
WITH f AS (SELECT path, max(sec) - min(sec) AS win FROM loglines GROUP BY path),
t AS (SELECT path, level, count(*) AS n, max(sec) - min(sec) AS span FROM loglines GROUP BY ALL)
SELECT path, level, n, span, n > 1 AND win >= 4 * greatest(span, 1) AS burst FROM t JOIN f USING (path)""")
def burst_spread(spark, d):
    return T.burst_spread(loglines(spark, d), ["path"], "level", "sec")
