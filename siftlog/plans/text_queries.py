"""Queries over scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlog.functions import fields as X
from siftlog.functions import masking as M
from siftlog.operators import predicates as P
from siftlog.plans.fixtures import doclines, events, loglines, table
from siftlog.plans.registry import query

#: The mask on the derived lines in SQL: no signed numbers, uuids or long hex words occur there, so no look-around is needed.
SQL_TEMPLATE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2} \+\d{4}', '<T>', 'g'), '\b\d{1,3}(\.\d{1,3}){3}\b', '<ip>', 'g'), '\d+(\.\d+)?', '#', 'g'), '\s+', ' ', 'g'))"""
SQL_PATH = "lang || '/' || source || '/' || doc_id || '.txt'"


@query("mask_template", f"SELECT path, line_no, {SQL_TEMPLATE} AS template FROM loglines")
def mask_template(spark, d):
    return loglines(spark, d).select("path", "line_no", M.template(F.col("text")).alias("template"))


@query("numeric_slots", """SELECT path, line_no, CASE WHEN event_type IN ('view', 'click') THEN concat_ws(',', k, '1.1', status, ms) ELSE concat_ws(',', user_id % 3, user_id, ms, k) END AS slots FROM loglines""")
def numeric_slots(spark, d):
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return loglines(spark, d).select("path", "line_no", F.array_join(F.transform(M.slots(F.col("text")), number), ",").alias("slots"))


@query("glued_slots", """
SELECT path, line_no, CASE WHEN event_type IN ('view', 'click') THEN 'true,true,false,false' ELSE 'true,false,false,false' END || CASE k % 3 WHEN 0 THEN ',false' WHEN 1 THEN ',true' ELSE ',true,false' END AS glued FROM loglines""")
def glued_slots(spark, d):
    k = F.col("k")
    text = F.concat("text", F.when(k % 3 == 0, F.concat(F.lit(" n "), k)).when(k % 3 == 1, F.concat(F.lit(" id-"), k)).otherwise(F.concat(F.lit(" v"), k, F.lit(" ="), k)))
    return loglines(spark, d).select("path", "line_no", F.array_join(F.transform(M.glued(text), lambda x: x.cast("string")), ",").alias("glued"))


@query("actors", "SELECT path, ip AS actor, count(*) AS n FROM loglines GROUP BY ALL")
def actors(spark, d):
    return loglines(spark, d).select("path", F.explode(M.actors(F.col("text"))).alias("actor")).groupBy("path", "actor").agg(F.count("*").alias("n"))


#: The shape of the derived lines in SQL.
SQL_SHAPE = r"""substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z|\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}', '<ts>', 'g'), '\b\d{1,3}(\.\d{1,3}){3}\b', '<ip>', 'g'), '\b[0-9a-f]{6,}\b', '#', 'g'), '\d+', '#', 'g'), 1, 180)"""


@query("line_shape", f"SELECT path, {SQL_SHAPE} AS shape, count(*) AS n FROM loglines GROUP BY ALL")
def line_shape(spark, d):
    return loglines(spark, d).groupBy("path", M.shape(F.col("text")).alias("shape")).agg(F.count("*").alias("n"))


@query("slot_label", f"SELECT template, right(string_split(template, '#')[2], 14) AS label, count(*) AS n FROM (SELECT {SQL_TEMPLATE} AS template FROM loglines) GROUP BY ALL")
def slot_label(spark, d):
    t = loglines(spark, d).select(M.template(F.col("text")).alias("template"))
    return t.groupBy("template").agg(F.count("*").alias("n")).select("template", M.slot_label(F.col("template"), F.lit(1)).alias("label"), "n")


@query("field_bag", r"""
WITH w AS (SELECT path, line_no, string_split(text, ' ') AS t, k, user_id, event_type FROM loglines),
f AS (SELECT path, 'kv:k' AS axis, CAST(k AS VARCHAR) AS value FROM w WHERE event_type NOT IN ('view', 'click')
  UNION ALL SELECT path, 'kv:user', CAST(user_id AS VARCHAR) FROM w WHERE event_type NOT IN ('view', 'click')
  UNION ALL SELECT path, 'ws:' || (i - 1), t[i] FROM (SELECT path, t, unnest(range(1, least(len(t), 12) + 1)) AS i FROM w) WHERE length(t[i]) <= 24)
SELECT path, axis, count(*) AS n, count(DISTINCT value) AS card FROM f GROUP BY ALL""")  # fmt: skip
def field_bag(spark, d):
    bag = loglines(spark, d).select("path", F.explode(X.field_bag(F.col("text"))).alias("f"))
    return bag.groupBy("path", F.col("f.axis").alias("axis")).agg(F.count("*").alias("n"), F.count_distinct("f.value").alias("card"))


@query("extract_axis", "SELECT path, line_no, CASE WHEN event_type NOT IN ('view', 'click') THEN CAST(user_id AS VARCHAR) END AS account, string_split(text, ' ')[2] AS second FROM loglines")
def extract_axis(spark, d):
    t = F.col("text")
    return loglines(spark, d).select("path", "line_no", X.extract_axis(t, "kv:user").alias("account"), X.extract_axis(t, "ws:1").alias("second"))


@query("kv_pairs", """
SELECT path, line_no, trim(CASE WHEN event_type IN ('view', 'click') THEN '' ELSE 'user=' || user_id || ' k=' || k END || CASE WHEN k % 2 = 0 THEN ' a=' || k || ' b=x a=2' || k ELSE '' END) AS pairs FROM loglines""")
def kv_pairs(spark, d):
    more = F.when(F.col("k") % 2 == 0, F.concat(F.lit(" a="), "k", F.lit(" b=x,y a="), "k", F.lit(" a=2"), "k", F.lit(" b=x;"))).otherwise("")
    return loglines(spark, d).select("path", "line_no", F.array_join(X.kv_pairs(F.concat("text", more)), " ").alias("pairs"))


@query("severity_words", "SELECT path, level AS word, count(*) AS n FROM loglines WHERE event_type NOT IN ('view', 'click') GROUP BY ALL")
def severity_words(spark, d):
    return loglines(spark, d).select("path", F.explode(X.severity_words(F.col("text"))).alias("word")).groupBy("path", "word").agg(F.count("*").alias("n"))


@query("vocabulary", r"""SELECT path, w AS word, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(text, '\b([A-Z]{3,12})\b', 1)) AS w FROM loglines) GROUP BY ALL""")
def vocabulary(spark, d):
    return loglines(spark, d).select("path", F.explode(X.vocabulary(F.col("text"))).alias("word")).groupBy("path", "word").agg(F.count("*").alias("n"))


@query("explode_event", "SELECT event_id, 'k' AS field, CAST(k AS VARCHAR) AS value FROM ev WHERE k IS NOT NULL")
def explode_event(spark, d):
    m = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", F.explode(m).alias("field", "value"))


@query("const_tokens", r"""SELECT source, count(*) AS texts, CAST(sum(len(list_distinct(regexp_extract_all(text, '\b([A-Z][A-Z0-9]*(_[A-Z0-9]+)+)\b', 1)))) AS BIGINT) AS n FROM documents GROUP BY source""")
def const_tokens(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.size(X.const_tokens(F.col("text")))).alias("n"))


@query("ip_class", """
WITH i AS (SELECT CASE event_id % 4 WHEN 0 THEN ip WHEN 1 THEN '100.' || (60 + user_id % 70) || '.3.4' WHEN 2 THEN '8.8.' || (user_id % 8) || '.1' ELSE '172.' || (10 + user_id % 30) || '.0.9' END AS ip FROM ev),
o AS (SELECT ip, list_transform(string_split(ip, '.'), lambda x: CAST(x AS BIGINT)) AS o, count(*) AS n FROM i GROUP BY ip)
SELECT ip, ((o[1] * 256 + o[2]) * 256 + o[3]) * 256 + o[4] AS number, n,
  CASE WHEN o[1] = 100 AND o[2] BETWEEN 64 AND 127 THEN 'shared' WHEN o[1] = 10 OR o[1] = 172 AND o[2] BETWEEN 16 AND 31 THEN 'local' ELSE 'global' END AS kind FROM o""")
def ip_class(spark, d):
    user = F.col("user_id")
    made = [F.concat(F.lit("100."), 60 + user % 70, F.lit(".3.4")), F.concat(F.lit("8.8."), user % 8, F.lit(".1")), F.concat(F.lit("172."), 10 + user % 30, F.lit(".0.9"))]
    ip = F.element_at(F.array("ip", *made), (F.col("event_id") % 4 + 1).cast("int"))
    return events(spark, d).groupBy(ip.alias("ip")).agg(F.count("*").alias("n")).select("ip", X.ip_number(F.col("ip")).alias("number"), X.ip_class(F.col("ip")).alias("kind"), "n")


@query("measure_line", r"""
SELECT path, line_no, CAST(list_max(list_transform(string_split(text, ' '), lambda x: length(x))) AS BIGINT) AS longest,
  CASE WHEN event_type IN ('view', 'click') THEN CASE WHEN ms BETWEEN 100 AND 599 AND ms <> status THEN status || ',' || ms ELSE CAST(status AS VARCHAR) END ELSE '' END AS codes, ip AS addresses FROM loglines""")
def measure_line(spark, d):
    m = loglines(spark, d).select("path", "line_no", X.measure_line(F.col("text")).alias("m"))
    return m.select("path", "line_no", "m.longest", F.array_join("m.codes", ",").alias("codes"), F.array_join("m.addresses", ",").alias("addresses"))


@query("extract_citations", f"SELECT doc_id, {SQL_PATH} AS path, doc_id % 9 + 1 AS line_lo, doc_id % 9 + 1 + doc_id % 3 AS line_hi FROM documents")
def extract_citations(spark, d):
    cite = F.concat(F.lit("see "), "lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt:"), F.col("doc_id") % 9 + 1, F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("-"), F.col("doc_id") % 9 + 1 + F.col("doc_id") % 3)).otherwise(""), F.lit(" for it"))
    c = table(spark, d, "documents").select("doc_id", F.explode(X.citations(cite)).alias("c"))
    return c.select("doc_id", "c.path", "c.line_lo", "c.line_hi")


#: What the library's quotes, tokens and script checks are in SQL.
SQL_QUOTES = "list_concat(list_concat(list_concat(regexp_extract_all({0}, '\"([^\"\\n]{{4,400}})\"', 1), regexp_extract_all({0}, '«([^»\\n]{{4,400}})»', 1)), regexp_extract_all({0}, '“([^”\\n]{{4,400}})”', 1)), regexp_extract_all({0}, '`([^`\\n]{{4,400}})`', 1))"
SQL_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({}), '([0-9a-z_\\x{{400}}-\\x{{4FF}}]+)', 1), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "], w) AND length(w) >= CASE WHEN regexp_full_match(w, '[0-9]+') THEN 2 ELSE 3 END))"


@query("quoted_spans", f"SELECT page_id, len({SQL_QUOTES.format('html')}) AS n FROM pages")
def quoted_spans(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(X.quoted_spans(F.col("html"))).cast("long").alias("n"))


@query("token_set", f"""
WITH t AS (SELECT doc_id, {SQL_TOKENS.format('text')} AS s FROM documents)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n, coalesce(list_min(s), '') AS least FROM t""")
def token_set(spark, d):
    s = table(spark, d, "documents").select("doc_id", X.token_set(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.coalesce(F.array_min("s"), F.lit("")).alias("least"))


@query("verbatim_contains", r"""
WITH q AS (SELECT item_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS quote FROM benchmark),
w AS (SELECT doc_id, trim(lower(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents)
SELECT item_id, count(*) AS n FROM q JOIN w ON contains(t, quote) GROUP BY item_id""")
def verbatim_contains(spark, d):
    quotes = table(spark, d, "benchmark").select("item_id", X.normalised(F.col("text")).alias("quote"))
    return P.quote_hits(table(spark, d, "documents").select("doc_id", X.normalised(F.col("text")).alias("t")), quotes).groupBy("item_id").agg(F.count("*").alias("n"))


@query("canon_id", r"SELECT lower(regexp_replace(path, '[-_.\s]+', '', 'g')) AS id, count(*) AS n FROM loglines GROUP BY ALL")
def canon_id(spark, d):
    return loglines(spark, d).groupBy(X.canon_id(F.col("path")).alias("id")).agg(F.count("*").alias("n"))


@query("fingerprint", r"""
SELECT doc_id, substr(sha256(array_to_string(list_sort(list_transform(string_split(text, chr(10)), lambda x: trim(lower(regexp_replace(x, '\s+', ' ', 'g'))))), chr(10))), 1, 12) AS print FROM documents""")
def fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", X.fingerprint(F.split("text", "\n", -1)).alias("print"))


@query("path_parts", """
WITH r AS (SELECT *, ['', '.1', '-20240301.gz', '.2.gz'][k % 4 + 1] AS rotation FROM loglines)
SELECT path || rotation AS path, host, host || '/logs' AS dir, event_type || '.log' || rotation AS base, event_type || '.log' AS stem, rotation FROM r GROUP BY ALL""")
def path_parts(spark, d):
    rotated = F.concat("path", F.element_at(F.array(F.lit(""), F.lit(".1"), F.lit("-20240301.gz"), F.lit(".2.gz")), (F.col("k") % 4 + 1).cast("int")))
    return loglines(spark, d).select(rotated.alias("path")).distinct().select("path", X.path_parts(F.col("path")).alias("p")).select("path", "p.*")


@query("text_blocks", r"""
SELECT doc_id, b AS block FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS b FROM documents) WHERE b <> ''""")
def text_blocks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(X.text_blocks(F.col("text"))).alias("block"))


@query("regex_scan", "SELECT path, count(*) AS n FROM loglines WHERE regexp_matches(text, 'FATAL|\" 50[0-9] ') AND NOT regexp_matches(text, 'svc-1') GROUP BY path")
def regex_scan(spark, d):
    return P.regex_scan(loglines(spark, d), r'FATAL|" 50[0-9] ', "svc-1").groupBy("path").agg(F.count("*").alias("n"))


@query("glob_filter", "SELECT path, count(*) AS n FROM loglines WHERE path ILIKE 'h1/%' OR path ILIKE '%click.log' GROUP BY path")
def glob_filter(spark, d):
    return loglines(spark, d).where(P.glob_match(F.col("path"), "H1/*|*click.log")).groupBy("path").agg(F.count("*").alias("n"))


_RULES = [("R1", 0, "axis", "=", "error"), ("R1", 1, "n", ">=", "50"), ("R2", 0, "host", "=", "h1"), ("R3", 0, "axis", "~", "view*|click*"), ("R3", 1, "n", "<", "20"), ("R4", 0, "burst", "=", "true")]
_VERDICTS = "SELECT event_id AS id, event_type AS axis, host, k AS n, ms > 400 AS burst, ['?', 'D', 'D H-2', 'N', 'N n=12', 'X', 'X no data'][event_id % 7 + 1] AS verdict FROM ev"


def verdicts(spark, d):
    cells = F.array(*[F.lit(v) for v in ("?", "D", "D H-2", "N", "N n=12", "X", "X no data")])
    return events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("axis"), "host", F.col("k").alias("n"), (F.col("ms") > 400).alias("burst"), F.element_at(cells, (F.col("event_id") % 7 + 1).cast("int")).alias("verdict"))


@query("rule_coverage", f"""
WITH v AS ({_VERDICTS})
SELECT id, CASE WHEN axis = 'error' AND n >= 50 THEN 'R1' WHEN host = 'h1' THEN 'R2' WHEN axis IN ('view', 'click') AND n < 20 THEN 'R3' WHEN burst THEN 'R4' END AS rule FROM v""")
def rule_coverage(spark, d):
    return verdicts(spark, d).select("id", P.first_rule(_RULES).alias("rule"))


@query("claim_violations", "SELECT path, line_no FROM loglines WHERE event_type IN ('view', 'click') AND NOT (status < 500 AND (ms < 500 OR ms NOT BETWEEN 100 AND 599))")
def claim_violations(spark, d):
    web = loglines(spark, d).where(F.col("event_type").isin("view", "click"))
    return web.where(~P.every_code(F.col("text"), lambda c: c < 500)).select("path", "line_no")


@query("verdict_state", f"""
WITH v AS ({_VERDICTS})
SELECT id, CASE WHEN regexp_matches(verdict, '^D.*\\d') THEN 'D' WHEN regexp_matches(verdict, '^N.*\\d') THEN 'N' WHEN regexp_matches(verdict, '^X\\s+\\S.{{2,}}') THEN 'X' ELSE 'open' END AS state FROM v""")
def verdict_state(spark, d):
    return verdicts(spark, d).select("id", P.verdict_state(F.col("verdict")).alias("state"))


@query("expand_ids", "SELECT 'g' || lpad(CAST(i AS VARCHAR), 3, '0') AS id, event_id FROM (SELECT event_id, unnest(range(k, k + ms % 5 + 1)) AS i FROM ev)")
def expand_ids(spark, d):
    cell = F.concat(F.lit("g"), F.lpad(F.col("k").cast("string"), 3, "0"), F.lit("-g"), F.lpad((F.col("k") + F.col("ms") % 5).cast("string"), 3, "0"))
    return events(spark, d).select("event_id", F.explode(P.expand_ids(cell)).alias("id"))


@query("shape_gate")
def shape_gate(spark, d):
    """All log and document lines; the mask has no form in SQL for every line that occurs, tests hold it against another one."""
    lines = loglines(spark, d).select("path", "text").unionByName(doclines(spark, d).select("path", "text"))
    return P.shape_gate(lines.where("text <> ''").select("path", M.template(F.col("text")).alias("template")))


@query("select_run", "SELECT dataset, arm, max(event_id) AS seq, arg_max(ms, event_id) AS duration FROM (SELECT *, user_id % 3 AS dataset, event_type AS arm FROM ev) WHERE k > 0 GROUP BY ALL")
def select_run(spark, d):
    runs = events(spark, d).where("k > 0").withColumn("dataset", F.col("user_id") % 3).withColumn("arm", F.col("event_type"))
    return P.latest(runs, ["dataset", "arm"], "event_id").select("dataset", "arm", F.col("event_id").alias("seq"), F.col("ms").alias("duration"))


@query("doc_checks", """
WITH c AS (SELECT doc_id, text, list_filter(['license', 'http', '|'], lambda s: contains(lower(text), s)) AS present FROM documents)
SELECT doc_id, array_to_string(present, ',') AS present, CAST(3 - len(present) AS BIGINT) AS missing, contains(text, '$$$') AS banned, length(text) < CASE WHEN doc_id % 2 = 0 THEN 500 ELSE 200 END AS collapsed FROM c""")
def doc_checks(spark, d):
    least = F.when(F.col("doc_id") % 2 == 0, 500).otherwise(200)
    return P.doc_checks(table(spark, d, "documents"), ["license", "http", "|"], "$$$", least)


@query("diagnosis", """
SELECT doc_id, CASE WHEN l.quality = 1 THEN 'ok' WHEN length(d.text) < 200 THEN 'collapsed' WHEN l.toxic = 1 THEN 'reasoning' WHEN l.doc_id IS NULL THEN 'inconclusive' ELSE 'coverage' END AS diagnosis FROM documents d LEFT JOIN labels l USING (doc_id)""")
def diagnosis(spark, d):
    facts = table(spark, d, "documents").select("doc_id", (F.length("text") < 200).alias("collapsed")).join(table(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    return facts.select("doc_id", P.diagnosis(F.col("quality") == 1, F.col("collapsed"), F.col("toxic") == 1, F.col("known").isNull()).alias("diagnosis"))


@query("quality_checks", """
SELECT doc_id, concat_ws(',', CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'lang' END, CASE WHEN length(text) < 100 THEN 'short' END, CASE WHEN n_chars <> length(text) THEN 'n_chars' END, CASE WHEN count(*) OVER (PARTITION BY sha256(text)) > 1 THEN 'copy' END) AS found FROM documents""")
def quality_checks(spark, d):
    return P.quality_checks(table(spark, d, "documents"))
