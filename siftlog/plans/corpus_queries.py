"""Queries over whole corpora: mixed framing, rotated streams, traces of many identifiers, nested events, cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.functions.clock import hour_of
from siftlog.functions.extractors import BRACKETS, FIELD_BAG, with_rows
from siftlog.functions.fields import extract_axis, table_citations, text_blocks
from siftlog.functions.masking import capped_template, template
from siftlog.operators import axes as A
from siftlog.operators import predicates as P
from siftlog.operators.battery import Rule, battery
from siftlog.operators.cards import card_verdicts
from siftlog.operators.framing import framed
from siftlog.operators.nested import event_facts, event_fields
from siftlog.operators.rotation import stitch
from siftlog.operators.trace import firsts, trace
from siftlog.operators.twins import rendering_twins
from siftlog.plans.fixtures import events, loglines, nested_events, path_of, renderings, rotlines, table, written
from siftlog.plans.registry import query
from siftlog.plans.text_queries import SQL_TEMPLATE
from siftlog.sources.lines import host_bill, read_lines
from siftlog.work import saved, work_path

_STAMPED = r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} \+\d{4}|\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}|\d{2}:\d{2}:\d{2}"
_ROTATED_TEMPLATE = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '{_STAMPED}', '<T>', 'g'), '\b\d{{1,3}}(\.\d{{1,3}}){{3}}\b', '<ip>', 'g'), '\d+(\.\d+)?', '#', 'g'), '\s+', ' ', 'g'))"


def rotated(spark, d):
    """The rotated slices, written to disk and read back by their lines."""
    root = work_path(spark, "rotated")
    written(spark, rotlines(spark, d), root)
    return saved(framed(read_lines(spark, root).withColumn("path", path_of(F.col("path")))), "framed")


#: h2's signups and purchases have no leading stamp, so a line of theirs is a record, also a second one.
_ROTATED = """r AS (SELECT path, framing, line_no, line_end, text, host, event_type, t, part FROM rotrecords
  UNION ALL SELECT path, framing, line_no + 1, line_end, '  at step ' || k, host, event_type, NULL, part FROM (SELECT r.*, e.k FROM rotrecords r JOIN ev e USING (event_id)) WHERE framing = 'line' AND lines = 2)"""


@query("framed_corpus", f"WITH {_ROTATED} SELECT path, framing, line_no AS line_start, CASE WHEN framing = 'line' THEN line_no ELSE line_end END AS line_end, text FROM r")
def framed_corpus(spark, d):
    """One call frames files of three framings."""
    return rotated(spark, d)


_FAMILY = """fy AS (SELECT *, host || '/' || event_type || '.log' AS stream, host <> 'h2' AS dated, CASE WHEN host = 'h3' AND event_type IN ('signup', 'purchase') AND part = 0 THEN 'dmy' ELSE 'one' END AS shape FROM r),
sl AS (SELECT *, lag(hi) OVER (PARTITION BY stream ORDER BY lo, path) - lo AS back FROM (SELECT stream, path, bool_and(dated) AS dated, max(framing) AS framing, max(shape) AS shape, min(t) AS lo, max(t) AS hi, list(DISTINCT t // 3600) FILTER (t IS NOT NULL) AS hours FROM fy GROUP BY stream, path)),
ga AS (SELECT stream, CASE WHEN count(*) = 1 THEN 'single' WHEN NOT bool_and(dated) THEN 'undated' WHEN count(DISTINCT framing) > 1 THEN 'framing' WHEN count(DISTINCT shape) > 1 THEN 'shape' WHEN max(back) > 2 THEN 'overlap'
  WHEN sum(len(hours)) > len(list_distinct(flatten(list(hours)))) THEN 'hour' ELSE 'stitched' END AS gate FROM sl GROUP BY stream),
f AS (SELECT fy.*, gate FROM fy JOIN ga USING (stream))"""


@query("rotation_families", f"""
WITH {_ROTATED}, {_FAMILY}, s AS (SELECT stream, gate, path, min(t) AS lo, max(t) AS hi FROM f WHERE gate <> 'single' GROUP BY ALL)
SELECT stream, gate, count(*) AS slices, string_agg(path, ' ' ORDER BY lo, path) AS members, CASE WHEN gate <> 'undated' THEN 1706745600 + min(lo) END AS lo, CASE WHEN gate <> 'undated' THEN 1706745600 + max(hi) END AS hi FROM s GROUP BY stream, gate""")
def rotation_families(spark, d):
    found, _, _ = stitch(rotated(spark, d))
    dated = lambda c: F.when(F.col("gate") != "undated", F.col(c)).alias(c)
    return found.select("stream", "gate", "slices", F.array_join("members", " ").alias("members"), dated("lo"), dated("hi"))


@query("rotation_streams", f"""
WITH {_ROTATED}, {_FAMILY}, x AS (SELECT *, CASE WHEN gate = 'stitched' THEN stream ELSE path END AS stream_, {_ROTATED_TEMPLATE} AS template FROM f)
SELECT stream_ AS stream, template, count(*) AS n, arg_min(path, (part, line_no)) AS path, arg_min(line_no, (part, line_no)) AS line,
  CASE WHEN gate <> 'undated' THEN 1706745600 + min(t) END AS lo, CASE WHEN gate <> 'undated' THEN 1706745600 + max(t) END AS hi,
  array_to_string(list_transform(range(0, 24), lambda h: len(list_filter(list(t // 3600), lambda x: x = h))), ',') AS hours
FROM x GROUP BY stream_, template, gate""")
def rotation_streams(spark, d):
    """Slices of one family are one stream, cited where a template stands first; families apart stay files."""
    found, templates, _ = stitch(rotated(spark, d))
    undated = F.col("stream").startswith("h2/")
    dated = lambda c: F.when(~undated, F.col(c)).alias(c)
    return templates.select("stream", "template", "n", "path", "line", dated("lo"), dated("hi"), F.array_join("hours", ",").alias("hours"))


@query("rotation_places", f"""
WITH {_ROTATED}, {_FAMILY}, x AS (SELECT CASE WHEN gate = 'stitched' THEN stream ELSE path END AS stream, {_ROTATED_TEMPLATE} AS template,
  list_transform(regexp_extract_all(regexp_replace(regexp_replace(text, '{_STAMPED}', '<T>', 'g'), '\\b\\d{{1,3}}(\\.\\d{{1,3}}){{3}}\\b', '', 'g'), '\\d+(?:\\.\\d+)?'), lambda v: CAST(v AS DOUBLE)) AS v FROM f),
y AS (SELECT stream, template, unnest(v) AS v, unnest(range(0, len(v))) AS place FROM x)
SELECT stream, template, CAST(place AS INTEGER) AS place, count(*) AS n, min(v) AS least, max(v) AS most, round(sum(v), 3) AS total FROM y GROUP BY stream, template, place""")
def rotation_places(spark, d):
    _, _, places = stitch(rotated(spark, d))
    return places.withColumn("total", F.round("total", 3))


#: Each user, address and service as they are written elsewhere, and orders that no line has.
_TRACED = """i AS (SELECT DISTINCT 'USER=' || user_id AS id, user_id, NULL AS ip, NULL AS svc FROM ev UNION ALL SELECT DISTINCT ip, NULL, ip, NULL FROM ev
  UNION ALL SELECT DISTINCT 'Svc_' || (user_id % 3), NULL, NULL, user_id % 3 FROM ev UNION ALL SELECT DISTINCT 'ORD-' || user_id, -1, NULL, NULL FROM ev)"""


@query("id_trace_table", f"""
WITH {_TRACED}, l AS (SELECT *, event_type IN ('view', 'click') AS web FROM loglines),
h AS (SELECT id, path, line_no, text, CASE WHEN web THEN strftime(ts, '%d/%b/%Y:%H:%M:%S') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' END AS stamp
  FROM l JOIN i ON i.ip = l.ip OR regexp_matches(text, '(^|[^A-Za-z0-9])' || replace(i.ip, '.', '[-_.:/]?') || '($|[^A-Za-z0-9])') OR NOT web AND (i.user_id = l.user_id OR i.svc = l.user_id % 3)),
r AS (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY line_no) AS r FROM h)
SELECT id, path, count(*) AS n, string_agg(line_no, ',' ORDER BY line_no) FILTER (r <= 20) AS refs, string_agg(text, chr(10) ORDER BY line_no) FILTER (r <= 3) AS samples,
  arg_min(stamp, line_no) AS first_ts, arg_max(stamp, line_no) AS last_ts, count(*) > 20 AS truncated FROM r GROUP BY id, path""")
def id_trace_table(spark, d):
    """Thousands of identifiers as rows, through every log line."""
    e = events(spark, d)
    names = [F.concat(F.lit("USER="), "user_id"), F.col("ip"), F.concat(F.lit("Svc_"), F.col("user_id") % 3), F.concat(F.lit("ORD-"), "user_id")]
    ids = e.select(F.explode(F.array(*names)).alias("id"))
    lines = loglines(spark, d).select("path", F.col("line_no").alias("line_start"), F.col("line_no").alias("line_end"), "text")
    return trace(lines, ids).withColumns({"refs": F.array_join("refs", ","), "samples": F.array_join("samples", "\n")})


_PAGE_PAIRS = """pp AS (SELECT 'p' || page_id AS "row", unnest([0, 1]) AS src, unnest([url, html]) AS s FROM pages),
pk AS (SELECT "row", src, unnest(regexp_extract_all(s, '([A-Za-z][A-Za-z0-9_]{2,31})=([^\\r\\n\\t]{0,120})', 1)) AS k, unnest(regexp_extract_all(s, '([A-Za-z][A-Za-z0-9_]{2,31})=([^\\r\\n\\t]{0,120})', 2)) AS v,
  unnest(range(1, len(regexp_extract_all(s, '([A-Za-z][A-Za-z0-9_]{2,31})=([^\\r\\n\\t]{0,120})')) + 1)) AS i FROM pp)"""


@query("nested_fields", f"""
WITH x AS (SELECT 'e' || event_id AS "row", event_id % 5 AS kind, * FROM ev), {_PAGE_PAIRS}
SELECT "row", 'provider' AS field, 'App' AS value FROM x WHERE kind IN (0, 1, 3) UNION ALL SELECT "row", 'channel', 'Security' FROM x WHERE kind IN (0, 1, 3)
UNION ALL SELECT "row", 'event_id', ['4624', '4625', '1', '2'][kind + 1] FROM x WHERE kind < 4 UNION ALL SELECT "row", 'computer', host FROM x WHERE kind < 4
UNION ALL SELECT "row", 'data.TargetUserName', 'user' || user_id FROM x WHERE kind = 0 UNION ALL SELECT "row", 'data.SubjectUserName', '' FROM x WHERE kind = 0
UNION ALL SELECT "row", 'data[0]', 'first' FROM x WHERE kind = 0 UNION ALL SELECT "row", 'data[1]', 'CODE_RED_' || (k % 3) FROM x WHERE kind = 0
UNION ALL SELECT "row", 'data[0]', 'User=user' || user_id || chr(9) || 'ip=' || ip || chr(10) || 'role=admin ' || chr(10) || 'role= other' || chr(10) || 'it=no' FROM x WHERE kind = 1
UNION ALL SELECT "row", 'data[1]', '''acct' || k || ''' and ''b c''' FROM x WHERE kind = 1
UNION ALL SELECT "row", 'kv.User', 'user' || user_id FROM x WHERE kind = 1 UNION ALL SELECT "row", 'kv.role', 'other' FROM x WHERE kind = 1
UNION ALL SELECT "row", 'data[0]', 'STATE_OLD_VALUE from 8.8.4.' || (k % 200 + 1) || ', 10.1.2.3, 100.64.0.1, 8.8.8.300' FROM x WHERE kind = 2
UNION ALL SELECT "row", 'data[' || src || ']', s FROM pp WHERE length(s) <= 120
UNION ALL SELECT "row", 'kv.' || k, regexp_replace(arg_max(v, (src, i)), '^\\s+|\\s+$', '', 'g') FROM pk GROUP BY "row", k""")
def nested_fields(spark, d):
    return event_fields(nested_events(spark, d), "row", "text")


@query("nested_facts", """
WITH x AS (SELECT 'e' || event_id AS "row", event_id % 5 AS kind, * FROM ev)
SELECT "row", CASE WHEN kind < 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS at, CASE WHEN kind < 4 THEN CAST(event_id AS VARCHAR) END AS record, CAST([2, 3, 1, 0, 0][kind + 1] AS INTEGER) AS strings,
  CASE kind WHEN 0 THEN 'CODE_RED_' || (k % 3) WHEN 2 THEN 'STATE_OLD_VALUE' ELSE '' END AS constants,
  CASE kind WHEN 0 THEN 'user' || user_id WHEN 1 THEN 'acct' || k || ',user' || user_id ELSE '' END AS accounts, CASE kind WHEN 2 THEN '8.8.4.' || (k % 200 + 1) ELSE '' END AS peers
FROM x
UNION ALL SELECT 'p' || page_id, NULL, NULL, CAST(2 AS INTEGER), array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(url, '\\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+){2,})\\b', 1), regexp_extract_all(html, '\\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+){2,})\\b', 1)))), ','),
  array_to_string(list_sort(list_distinct(list_filter(list_concat(regexp_extract_all(url, '''([^'']{1,64})''', 1), regexp_extract_all(html, '''([^'']{1,64})''', 1)), lambda q: NOT contains(q, ' ')))), ','),
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(url || ' ' || html, '\\b((?:\\d{1,3}\\.){3}\\d{1,3})\\b', 1), lambda a: len(list_filter(string_split(a, '.'), lambda o: CAST(o AS INTEGER) > 255 OR length(o) > 1 AND o[1] = '0')) = 0
    AND NOT regexp_matches(a, '^(0|10|127|22[4-9]|2[345]\\d)\\.|^100\\.(6[4-9]|[789]\\d|1[01]\\d|12[0-7])\\.|^169\\.254\\.|^172\\.(1[6-9]|2\\d|3[01])\\.|^192\\.168\\.|^192\\.0\\.[02]\\.|^198\\.1[89]\\.|^198\\.51\\.100\\.|^203\\.0\\.113\\.')))), ',') FROM pages""")
def nested_facts(spark, d):
    facts = event_facts(nested_events(spark, d), "row", "text")
    return facts.withColumns({c: F.array_join(c, ",") for c in ("constants", "accounts", "peers")})


_RENDERED = """a AS (SELECT host, event_id, event_type, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS line_no,
  row_number() OVER (PARTITION BY host, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY host, event_type, date_trunc('hour', ts)) AS c FROM ev),
j AS (SELECT host, event_id, event_type, date_trunc('hour', ts) AS hour, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS line_no,
  row_number() OVER (PARTITION BY host, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS r, count(*) OVER (PARTITION BY host, event_type, date_trunc('hour', ts)) AS c FROM ev WHERE event_id % 7 <> 0),
m AS (SELECT a.host, a.line_no AS a_line, j.line_no AS j_line FROM a JOIN j USING (host, event_type, hour, r, c)),
s AS (SELECT host || '/app.log' AS path, line_no AS lo, line_no + 2 AS hi FROM a WHERE event_id % 11 = 0)"""


def _spans(lines):
    return lines.where((F.col("event_id") % 11 == 0) & F.col("path").endswith("/app.log")).select("path", F.col("line_no").alias("lo"), (F.col("line_no") + 2).alias("hi"))


@query("rendering_twins", f"""
WITH {_RENDERED} SELECT host || '/app.log' AS path, a_line AS line_no, host || '/journal.json' AS twin_path, j_line AS twin_line FROM m
SEMI JOIN s ON s.path = host || '/app.log' AND a_line BETWEEN lo AND hi""")
def rendering_twins_(spark, d):
    """Lines of the truth in the dated file, and the journal's lines that say the same; the file without years is another timebase."""
    lines = renderings(spark, d)
    return rendering_twins(lines, _spans(lines))[0]


@query("refused_twins", f"""
WITH {_RENDERED}, f AS (SELECT DISTINCT host, unnest(['app.log', 'journal.json', 'syslog', 'notes.txt']) AS name, unnest([1, 1, 2, NULL]) AS base FROM a),
u AS (SELECT x.host, count(*) AS n FROM (SELECT DISTINCT host, event_type, hour, c FROM a) x JOIN (SELECT DISTINCT host, event_type, hour, c FROM j) y USING (host, event_type, hour) WHERE x.c <> y.c GROUP BY x.host)
SELECT x.host || '/' || x.name AS path, y.host || '/' || y.name AS twin_path, 'timebase' AS reason, CAST(NULL AS BIGINT) AS keys FROM f x JOIN f y ON x.host = y.host AND x.name <> y.name WHERE x.base IS NULL OR y.base IS NULL OR x.base <> y.base
UNION ALL SELECT host || '/app.log', host || '/journal.json', 'multiplicity', n FROM u UNION ALL SELECT host || '/journal.json', host || '/app.log', 'multiplicity', n FROM u""")
def refused_twins(spark, d):
    return rendering_twins(renderings(spark, d))[1]


@query("fenced_blocks", r"""
WITH b AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS block FROM documents)
SELECT doc_id, block FROM b WHERE block <> '' UNION ALL SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN ['``` a b ```', 'last'] ELSE ['~~~ open end'] END) FROM documents WHERE text IS NOT NULL""")
def fenced_blocks(spark, d):
    """Documents with a fenced block behind them, every other one left open."""
    tail = F.when(F.col("doc_id") % 2 == 0, "\n\n```\na\n\n \nb\n  ```\n\t\nlast").otherwise("\n\n~~~\nopen\n\nend")
    return table(spark, d, "documents").select("doc_id", F.explode(text_blocks(F.concat("text", tail))).alias("block"))


@query("field_bag_rows", r"""
WITH w AS (SELECT path, line_no, string_split(text, ' ') AS t, k, user_id, event_type FROM loglines)
SELECT path, line_no, 'kv:k' AS axis, CAST(k AS VARCHAR) AS value FROM w WHERE event_type NOT IN ('view', 'click')
UNION ALL SELECT path, line_no, 'kv:user', CAST(user_id AS VARCHAR) FROM w WHERE event_type NOT IN ('view', 'click')
UNION ALL SELECT path, line_no, 'ws:' || (i - 1), t[i] FROM (SELECT path, line_no, t, unnest(range(1, least(len(t), 12) + 1)) AS i FROM w) WHERE length(t[i]) BETWEEN 1 AND 24""")
def field_bag_rows(spark, d):
    """The fields of every line by the table function; the columns of ``field_bag`` give the same."""
    return with_rows(loglines(spark, d).select("path", "line_no", "text"), FIELD_BAG, "text").select("path", "line_no", "axis", "value")


@query("bracket_groups", r"""
SELECT doc_id, "at", part FROM (SELECT doc_id, unnest([0, 3 + length(CAST(doc_id AS VARCHAR)) + 2 * (doc_id % 3)]) AS "at",
  unnest(['(a' || repeat('(', CAST(doc_id % 3 AS INTEGER)) || doc_id || repeat(')', CAST(doc_id % 3 AS INTEGER)) || ')', '{"x": [1, (2)]}']) AS part FROM documents)
WHERE "at" >= 0""")
def bracket_groups(spark, d):
    """Groups of balanced brackets, outermost ones: no column expression counts depth."""
    docs, deep = table(spark, d, "documents"), (F.col("doc_id") % 3).cast("int")
    text = F.concat(F.lit("(a"), F.repeat(F.lit("("), deep), "doc_id", F.repeat(F.lit(")"), deep), F.lit(")"), F.lit('{"x": [1, (2)]} ) ]{open ('))
    return with_rows(docs.select("doc_id", text.alias("text")), BRACKETS, "text").select("doc_id", "at", "part")


_CARDS = [
    ("blocked", "any", " 50[0-2] "), ("blocked", "any", "FATAL"), ("pair", "all", "FATAL svc-0"), ("pair", "all", "/view/99 "), ("never", "all", "FATAL svc-0"), ("never", "all", "no such line"),
    ("named", "name", "^error\\.log$"), ("mixed", "name", "^nothing$"), ("mixed", "all", "k=42 "), ("mixed", "all", "k=41 "), ("none", "any", "zzz"),
]
_EVIDENCE = """c(card, bit, every) AS (VALUES ('blocked', 0, false), ('blocked', 1, false), ('pair', 0, true), ('pair', 1, true), ('never', 0, true), ('never', 1, true), ('named', 0, false), ('mixed', 0, true), ('mixed', 1, true), ('mixed', 2, false), ('none', 0, false)),
h AS (SELECT 'blocked' AS card, 0 AS bit, path, line_no FROM loglines WHERE regexp_matches(text, ' 50[0-2] ') UNION ALL SELECT 'blocked', 1, path, line_no FROM loglines WHERE contains(text, 'FATAL')
  UNION ALL SELECT 'pair', 1, path, line_no FROM loglines WHERE contains(text, 'FATAL svc-0') UNION ALL SELECT 'pair', 0, path, line_no FROM loglines WHERE contains(text, '/view/99 ')
  UNION ALL SELECT 'never', 0, path, line_no FROM loglines WHERE contains(text, 'FATAL svc-0') UNION ALL SELECT 'named', 0, path, 0 FROM (SELECT DISTINCT path FROM loglines) WHERE ends_with(path, '/error.log')
  UNION ALL SELECT 'mixed', 1, path, line_no FROM loglines WHERE contains(text, 'k=42 ') UNION ALL SELECT 'mixed', 0, path, line_no FROM loglines WHERE contains(text, 'k=41 '))"""


@query("card_table", f"""
WITH {_EVIDENCE}, r AS (SELECT *, row_number() OVER (PARTITION BY card, bit ORDER BY path, line_no) AS r FROM h),
x AS (SELECT card, count(*) AS hits, count(DISTINCT path) AS files, string_agg(bit || ':' || path || ':' || line_no, ' ' ORDER BY bit, path, line_no) FILTER (r <= 3) AS examples FROM r GROUP BY card),
b AS (SELECT c.card, sum(CASE WHEN n > 0 THEN pow(2, c.bit)::BIGINT ELSE 0 END)::BIGINT AS bits, bool_or(NOT every AND coalesce(n, 0) > 0) AS one, bool_or(every) AND bool_and(NOT every OR coalesce(n, 0) > 0) AS whole
  FROM c LEFT JOIN (SELECT card, bit, count(*) AS n FROM h GROUP BY ALL) n ON n.card = c.card AND n.bit = c.bit GROUP BY c.card)
SELECT card, coalesce(one, false) OR coalesce(whole, false) AS holds, bits, coalesce(hits, 0) AS hits, coalesce(files, 0) AS files, coalesce(examples, '') AS examples FROM b LEFT JOIN x USING (card)""")
def card_table(spark, d):
    """Cards of any, all and file-name patterns as a table."""
    cards = spark.createDataFrame(_CARDS, "card string, kind string, pattern string")
    return card_verdicts(loglines(spark, d).select("path", "line_no", "text"), cards).withColumn("examples", F.array_join("examples", " "))


def battery_rules():
    """Twelve observations on the log lines: attempts, refusals, outsiders, probes, bans, broken delivery, its sender, a stale file, sessions without outcome, self-talk, a rare line, one source for all."""
    text, word = F.col("text"), lambda w: F.col("text").contains(w)
    source, client, account = F.regexp_extract(text, r" from (\S+)$", 1), F.regexp_extract(text, r"^(\S+) - - ", 1), F.nullif(F.regexp_extract(text, r" user=(\d+) ", 1), F.lit(""))
    inside = F.regexp_extract(text, r" from 10\.0\.([01])\.", 1) != ""
    log = lambda n: F.col("path").endswith(f"/{n}.log")
    code = lambda c: word(f'" {c} ')
    return {
        "R01": Rule(word(" FATAL "), source=source, parts={"accepted": word(" INFO "), "blocked": word(" BLOCK ")}),
        "R02": Rule(code(404), source=client, bucket=F.regexp_extract(text, r"/(\d+) HTTP", 1)),
        "R03": Rule(word(" WARN ") & ~inside, source=source, parts={"accepted": word(" INFO "), "accepted_outside": word(" INFO ") & ~inside}),
        "R04": Rule(word("GET /click/"), "click", client, F.regexp_extract(text, r'" (\d{3}) ', 1), {"served": word("GET /click/") & code(200)}),
        "R05": Rule(log("signup"), "signup", account, key=account, opens=log("signup"), closes=log("purchase"), parts={"found": log("error")}),
        "R06": Rule(code(200), "view", bucket=F.regexp_extract(text, r'" (\d{3}) ', 1)),
        "R07": Rule(word(" WARN "), "error", account),
        "R08": Rule(log("error"), "error", parts={"mentions": word("error")}),
        "R09": Rule(log("view"), "view", client, key=F.nullif(client, F.lit("")), opens=log("view"), closes=log("click")),
        "R10": Rule(word(" INFO "), "signup|purchase"),
        "R11": Rule(word(" k=0 ") & log("purchase"), "purchase", source, parts={"elsewhere": word(" k=0 ") & ~log("purchase"), "accepts": log("view")}),
        "R12": Rule(client != "", "click", client),
    }


_BATTERY = r"""b AS (SELECT host, path, line_no, sec, event_type AS t, level, status, k, CAST(ip AS VARCHAR) AS ip, CAST(user_id AS VARCHAR) AS u, event_type IN ('view', 'click') AS web, ip LIKE '10.0.0.%' OR ip LIKE '10.0.1.%' AS inside FROM loglines),
m AS (SELECT host, path, sec, 'R01' AS rule, '' AS part, ip AS source, NULL AS bucket FROM b WHERE NOT web AND level = 'FATAL' UNION ALL SELECT host, path, sec, 'R01', 'accepted', NULL, NULL FROM b WHERE NOT web AND level = 'INFO'
  UNION ALL SELECT host, path, sec, 'R02', '', ip, CAST(k AS VARCHAR) FROM b WHERE web AND status = 404
  UNION ALL SELECT host, path, sec, 'R03', '', ip, NULL FROM b WHERE NOT web AND level = 'WARN' AND NOT inside UNION ALL SELECT host, path, sec, 'R03', 'accepted', NULL, NULL FROM b WHERE NOT web AND level = 'INFO'
  UNION ALL SELECT host, path, sec, 'R03', 'accepted_outside', NULL, NULL FROM b WHERE NOT web AND level = 'INFO' AND NOT inside
  UNION ALL SELECT host, path, sec, 'R04', '', ip, CAST(status AS VARCHAR) FROM b WHERE t = 'click' UNION ALL SELECT host, path, sec, 'R04', 'served', NULL, NULL FROM b WHERE t = 'click' AND status = 200
  UNION ALL SELECT host, path, sec, 'R05', '', u, NULL FROM b WHERE t = 'signup' UNION ALL SELECT host, path, sec, 'R05', 'found', NULL, NULL FROM b WHERE t = 'error'
  UNION ALL SELECT host, path, sec, 'R06', '', NULL, '200' FROM b WHERE t = 'view' AND status = 200 UNION ALL SELECT host, path, sec, 'R07', '', u, NULL FROM b WHERE t = 'error' AND level = 'WARN'
  UNION ALL SELECT host, path, sec, 'R08', '', NULL, NULL FROM b WHERE t = 'error' UNION ALL SELECT host, path, sec, 'R09', '', ip, NULL FROM b WHERE t = 'view'
  UNION ALL SELECT host, path, sec, 'R10', '', NULL, NULL FROM b WHERE t IN ('signup', 'purchase') AND level = 'INFO' UNION ALL SELECT host, path, sec, 'R11', '', ip, NULL FROM b WHERE t = 'purchase' AND k = 0
  UNION ALL SELECT host, path, sec, 'R11', 'elsewhere', NULL, NULL FROM b WHERE t IN ('signup', 'error') AND k = 0 UNION ALL SELECT host, path, sec, 'R11', 'accepts', NULL, NULL FROM b WHERE t = 'view'
  UNION ALL SELECT host, path, sec, 'R12', '', ip, NULL FROM b WHERE t = 'click'),
w(rule, within) AS (VALUES ('R01', ''), ('R02', ''), ('R03', ''), ('R04', 'click'), ('R05', 'signup'), ('R06', 'view'), ('R07', 'error'), ('R08', 'error'), ('R09', 'view'), ('R10', 'signup|purchase'), ('R11', 'purchase'), ('R12', 'click')),
e AS (SELECT h.host, w.rule, w.within FROM (SELECT DISTINCT host FROM b) h, w),
n AS (SELECT host, rule, count(*) AS n, min(sec) AS first, max(sec) AS last FROM m WHERE part = '' GROUP BY ALL),
f AS (SELECT host, rule, string_agg(path || '=' || c, ' ' ORDER BY path) AS files FROM (SELECT host, rule, path, count(*) AS c FROM m WHERE part = '' GROUP BY ALL) GROUP BY ALL),
p AS (SELECT host, rule, string_agg(part || '=' || c, ' ' ORDER BY part) AS parts FROM (SELECT host, rule, part, count(*) AS c FROM m WHERE part <> '' GROUP BY ALL) GROUP BY ALL),
s AS (SELECT host, rule, count(*) AS sources, string_agg(source || '=' || c, ' ' ORDER BY r) FILTER (r <= 5) AS top FROM (SELECT host, rule, source, count(*) AS c, row_number() OVER (PARTITION BY host, rule ORDER BY count(*) DESC, source) AS r FROM m WHERE part = '' AND source IS NOT NULL GROUP BY host, rule, source) GROUP BY ALL),
q AS (SELECT host, rule, string_agg(bucket || '=' || c, ' ' ORDER BY r) FILTER (r <= 5) AS buckets FROM (SELECT host, rule, bucket, count(*) AS c, row_number() OVER (PARTITION BY host, rule ORDER BY count(*) DESC, bucket) AS r FROM m WHERE part = '' AND bucket IS NOT NULL GROUP BY host, rule, bucket) GROUP BY ALL),
l AS (SELECT b.host, w.rule, count(*) AS looked FROM b JOIN w ON regexp_matches(b.path, w.within) GROUP BY ALL),
o AS (SELECT host, rule, count(*) FILTER (opens) AS opened, count(*) FILTER (opens AND coalesce(nxt, true)) AS open FROM (SELECT host, rule, opens, lead(opens) OVER (PARTITION BY host, rule, key ORDER BY sec, path, line_no) AS nxt
  FROM (SELECT host, path, line_no, sec, 'R05' AS rule, u AS key, t = 'signup' AS opens FROM b WHERE t IN ('signup', 'purchase') UNION ALL SELECT host, path, line_no, sec, 'R09', ip, t = 'view' FROM b WHERE web)) GROUP BY ALL)"""


@query("observable_battery", f"""
WITH {_BATTERY}
SELECT e.host, e.rule, coalesce(n, 0) AS n, coalesce(files, '') AS files, coalesce(sources, 0) AS sources, coalesce(top, '') AS top, coalesce(buckets, '') AS buckets, coalesce(parts, '') AS parts, first, last,
  CAST((last - first) // 3600 AS BIGINT) AS hours, CAST(((SELECT max(sec) FROM b) - last) // 3600 AS BIGINT) AS quiet_hours, CAST(round(10000.0 * coalesce(n, 0) / looked) AS BIGINT) AS share_bp, opened, open
FROM e LEFT JOIN n USING (host, rule) LEFT JOIN f USING (host, rule) LEFT JOIN p USING (host, rule) LEFT JOIN s USING (host, rule) LEFT JOIN q USING (host, rule) LEFT JOIN l USING (host, rule) LEFT JOIN o USING (host, rule)""")
def observable_battery(spark, d):
    """Twelve observations on each host."""
    return battery(loglines(spark, d).select("host", "path", "line_no", "sec", "text"), battery_rules())


@query("floor_rows", f"""
WITH b AS (SELECT path, line_no, {SQL_TEMPLATE} AS template, CASE WHEN event_type IN ('view', 'click') THEN status END AS code, hour(ts) AS hour, level, user_id, event_type, k FROM loglines),
c AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, line_no) AS place FROM (SELECT path, code, count(*) AS n, min(line_no) AS line_no FROM b WHERE code IS NOT NULL GROUP BY path, code)),
v AS (SELECT path, line_no, template, unnest(['kv:par', 'ws:1', 'ws:2']) AS axis, unnest([CAST(user_id % 2 AS VARCHAR), level, 'svc-' || (user_id % 3)]) AS value FROM b WHERE event_type NOT IN ('view', 'click')
  UNION ALL SELECT path, line_no, template, 'kv:par', CASE WHEN k < 98 THEN 'low' ELSE 'high' END FROM b WHERE event_type IN ('view', 'click')),
h AS (SELECT *, row_number() OVER (PARTITION BY path, axis ORDER BY n, value) AS r, count(*) OVER (PARTITION BY path, axis) AS card FROM (SELECT path, axis, value, count(*) AS n FROM v GROUP BY ALL)),
x AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY axis) AS place FROM h WHERE r = 1 AND card > 1),
t AS (SELECT v.path, v.axis, x.place, v.template, row_number() OVER (PARTITION BY v.path, v.axis ORDER BY count(*) DESC, min(v.line_no)) AS r FROM v JOIN x ON x.path = v.path AND x.axis = v.axis AND x.value = v.value AND place <= 2 GROUP BY v.path, v.axis, x.place, v.template),
u AS (SELECT path, line_no, 'code' AS why, 10 + row_number() OVER (PARTITION BY path ORDER BY n, code) AS s FROM c WHERE place > 1
  UNION ALL SELECT t.path, min(b.line_no), 'level', 20 + t.place FROM t JOIN b ON b.path = t.path AND b.template = t.template WHERE t.r = 1 GROUP BY t.path, t.axis, t.place
  UNION ALL SELECT path, line_no, 'burst', 30 FROM (SELECT path, hour, min(line_no) AS line_no, row_number() OVER (PARTITION BY path ORDER BY count(*) DESC, hour) AS r FROM b GROUP BY path, hour) WHERE r = 1
  UNION ALL SELECT path, min(line_no), 'first', 40 FROM b GROUP BY path UNION ALL SELECT path, max(line_no), 'last', 41 FROM b GROUP BY path),
o AS (SELECT *, row_number() OVER (PARTITION BY path, line_no ORDER BY s, why) AS r FROM u WHERE why <> 'code' OR s <= 13)
SELECT path, line_no, why FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s, line_no) AS q FROM o WHERE r = 1) WHERE q <= 6""")
def floor_rows(spark, d):
    """Minority codes, rarest levels, fullest hour, first and last record of every file."""
    lines, text = loglines(spark, d), F.col("text")
    app = ~F.col("event_type").isin("view", "click")
    code = F.nullif(F.regexp_extract(text, r'" (\d{3}) ', 1), F.lit("")).cast("int")
    records = lines.select("path", "line_no", template(text).alias("template"), code.alias("code"), hour_of(text).alias("hour"))
    pair = lambda axis, value: F.struct(F.lit(axis).alias("axis"), value.cast("string").alias("value"))
    own = F.array(pair("kv:par", F.col("user_id") % 2), pair("ws:1", extract_axis(text, "ws:1")), pair("ws:2", extract_axis(text, "ws:2")))
    levels = lines.select("path", "line_no", F.explode(F.when(app, own).otherwise(F.array(pair("kv:par", F.when(F.col("k") < 98, "low").otherwise("high"))))).alias("x"))
    return A.floor_rows(records, levels.select("path", "line_no", "x.*"))


@query("chosen_run", """
WITH r AS (SELECT 'ds' || (user_id % 3) AS dataset, event_type AS arm, k = 0 AS stub, 'runs/' || host || '/' || event_id AS trace_dir, event_id AS seq, ms AS duration FROM ev)
SELECT dataset, arm, max(seq) AS seq, arg_max(duration, seq) AS duration, arg_max(trace_dir, seq) AS trace_dir FROM r WHERE NOT stub AND dataset = 'ds1' AND arm = 'view' AND contains(trace_dir, '/h2/') GROUP BY ALL""")
def chosen_run(spark, d):
    """The last run of an arm, a dataset and a trace that is no stub; mixed datasets are refused."""
    e = events(spark, d)
    runs = e.select(F.concat(F.lit("ds"), F.col("user_id") % 3).alias("dataset"), F.col("event_type").alias("arm"), (F.col("k") == 0).alias("stub"), F.concat(F.lit("runs/"), "host", F.lit("/"), "event_id").alias("trace_dir"), F.col("event_id").alias("seq"), F.col("ms").alias("duration"))
    return P.select_run(runs, "seq", "view", "/h2/", "ds1").select("dataset", "arm", "seq", "duration", "trace_dir")


_LOGS = "WITH n AS (SELECT string_split(path, '/')[-1] AS file, max(line_no) AS most FROM loglines GROUP BY ALL), d AS (SELECT doc_id, text, 1 + doc_id * 7 % 200 AS a, doc_id * 13 % 900 AS b FROM documents)"


@query("checklist_refs", f"""
{_LOGS}
SELECT doc_id, CAST(regexp_matches(text, '(?i)license') AS INTEGER) + CAST(regexp_matches(text, '[0-9]{{4}}') AS INTEGER) AS quality, 2 AS quality_max,
  concat_ws(',', CASE WHEN NOT regexp_matches(text, '(?i)license') THEN 'license' END, CASE WHEN NOT regexp_matches(text, '[0-9]{{4}}') THEN 'year' END) AS missed, 3 AS refs,
  CAST(a <= (SELECT most FROM n WHERE file = 'view.log') AS BIGINT) + CAST(b BETWEEN 1 AND (SELECT most FROM n WHERE file = 'error.log') AS BIGINT) AS refs_ok FROM d""")
def checklist_refs(spark, d):
    """Checks that each document meets, and which of its references name a line that there is."""
    docs = table(spark, d, "documents")
    tail = F.concat(F.lit("\n(view.log:"), F.lit(1) + F.col("doc_id") * 7 % 200, F.lit(") error.log:"), F.col("doc_id") * 13 % 900, F.lit(" other.log:1"))
    checked = P.checklist(docs.select("doc_id", F.concat("text", tail).alias("t"), "text"), "doc_id", "t", {"license": "(?i)license", "year": "[0-9]{4}"}, loglines(spark, d))
    return checked


@query("table_citations", """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'view.log' ELSE 'logs/error.log' END AS path, doc_id % 50 + 1 AS line_lo, doc_id % 50 + 1 AS line_hi, CASE doc_id % 3 WHEN 0 THEN 'found here twice' ELSE 'x ' || lang END AS claim FROM documents WHERE doc_id % 3 < 2""")
def table_citations_(spark, d):
    """Citations in the rows of tables: a file's cell and a number's cell."""
    docs, n = table(spark, d, "documents"), (F.col("doc_id") % 50 + 1).cast("string")
    head = "| what | file | line | note |\n|---|:--|--:|---|\n"
    row = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("| found here | view.log | "), n, F.lit(" | twice |"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("  |"), n, F.lit("|x|logs/error.log|"), "lang", F.lit("|"))).otherwise(F.lit("| view.log | none | a: 12 |"))
    return docs.select("doc_id", F.explode(table_citations(F.concat(F.lit(head), row, F.lit("\nview.log | 12")))).alias("c")).select("doc_id", "c.*")


@query("capped_templates", f"""
WITH {_ROTATED}, x AS (SELECT path, line_no, CASE WHEN framing = 'line' THEN 1 ELSE line_end - line_no + 1 END AS span, {_ROTATED_TEMPLATE.replace("text,", "repeat(text || ' ', 12),")} AS template FROM r)
SELECT path, line_no AS line_start, substr(template, 1, CAST(180 * least(span, 4) AS INTEGER)) AS template FROM (SELECT path, line_no, span, template FROM x)""")
def capped_templates(spark, d):
    """Templates of records, cut by how many lines a record has."""
    records = rotated(spark, d).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), F.lit(12)))
    return records.select("path", "line_start", capped_template(F.col("text"), F.col("line_end") - F.col("line_start") + 1).alias("template"))


@query("host_bill", f"""
WITH t AS (SELECT host, path, event_type, {SQL_TEMPLATE} || k AS template, min(line_no) AS line_no, count(*) AS n FROM loglines GROUP BY host, path, event_type, template),
g AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n, path, line_no) AS r FROM t WHERE n <= 3), w AS (SELECT host, path, CASE WHEN n % 2 = 0 THEN 'rate' ELSE 'rarity' END AS axis FROM g WHERE r <= 5),
s AS (SELECT host, path, count(*) AS rows, count(*) FILTER (axis = 'rate') AS rate FROM w GROUP BY ALL),
f AS (SELECT l.host, l.path, CASE WHEN max(event_type) IN ('view', 'error') THEN 'stream' ELSE 'state' END AS kind, CAST(sum(strlen(text) + 1) AS BIGINT) AS cost, coalesce(max(gg.c), 0) AS groups, coalesce(max(s.rows), 0) AS rows, coalesce(max(s.rate), 0) AS rate
  FROM loglines l LEFT JOIN (SELECT path, count(*) AS c FROM g GROUP BY path) gg ON gg.path = l.path LEFT JOIN s ON s.path = l.path GROUP BY l.host, l.path),
m AS (SELECT *, (SELECT CAST(avg(c) * 4 AS BIGINT) FROM (SELECT sum(cost) / 5 AS c FROM f GROUP BY host)) AS cap, coalesce(sum(cost) FILTER (rows > 0) OVER (PARTITION BY host), 0) AS spent,
  sum(CASE WHEN rows = 0 THEN cost ELSE 0 END) OVER (PARTITION BY host, kind ORDER BY cost, path) AS upto FROM f),
q AS (SELECT *, coalesce(max(upto) FILTER (kind = 'stream' AND rows = 0 AND spent + upto <= cap) OVER (PARTITION BY host), 0) AS streams FROM m),
z AS (SELECT *, rows > 0 OR spent + upto + CASE kind WHEN 'stream' THEN 0 ELSE streams END <= cap AS kept FROM q)
SELECT host, count(*) AS files, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(rate) AS BIGINT) AS rate, CAST(sum(greatest(groups - rows, 0)) AS BIGINT) AS truncated, count(*) FILTER (NOT kept) AS folded, CAST(coalesce(sum(cost) FILTER (NOT kept), 0) AS BIGINT) AS withheld FROM z GROUP BY host""")
def host_bill_(spark, d):
    """What each host's report holds and leaves out: five rows a host, and blocks of four files' average size."""
    lines = loglines(spark, d).withColumn("template", F.concat(template(F.col("text")), F.col("k")))
    groups = saved(lines.groupBy("host", "path", "template").agg(F.min("line_no").alias("line_no"), F.count("*").alias("n")).where("n <= 3"), "groups")
    rows = firsts(groups, ["host"], ["n", "path", "line_no"], 5).select("host", "path", F.when(F.col("n") % 2 == 0, "rate").otherwise("rarity").alias("axis"))
    files = lines.groupBy("host", "path").agg(F.max("event_type").alias("event_type"), F.sum(F.octet_length("text") + 1).alias("cost"))
    files = files.join(groups.groupBy("path").agg(F.count("*").alias("groups")), "path", "left").fillna(0, ["groups"])
    files = saved(files.select("host", "path", F.when(F.col("event_type").isin("view", "error"), "stream").otherwise("state").alias("kind"), "cost", "groups"), "files")
    cap = files.groupBy("host").agg(F.sum("cost").alias("c")).agg(F.round(F.avg(F.col("c") / 5) * 4).cast("long")).first()[0] or 0
    return host_bill(files, rows, cap)
