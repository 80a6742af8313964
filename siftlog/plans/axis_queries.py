"""Queries over axes and aggregations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.functions import fields as X
from siftlog.functions import masking as M
from siftlog.functions.clock import clock
from siftlog.operators import axes as A
from siftlog.operators import predicates as P
from siftlog.operators import tallies as G
from siftlog.plans.fixtures import doclines, events, loglines, table
from siftlog.plans.registry import query
from siftlog.plans.text_queries import _RULES, _VERDICTS, SQL_SHAPE, SQL_TEMPLATE, verdicts

_WORDS = r"SELECT path, 'ws:' || (i - 1) AS axis, t[i] AS value FROM (SELECT path, t, unnest(range(1, least(len(t), 12) + 1)) AS i FROM (SELECT path, string_split(text, ' ') AS t FROM loglines)) WHERE length(t[i]) <= 24 UNION ALL SELECT path, 'kv:k', CAST(k AS VARCHAR) FROM loglines WHERE event_type NOT IN ('view', 'click') UNION ALL SELECT path, 'kv:user', CAST(user_id AS VARCHAR) FROM loglines WHERE event_type NOT IN ('view', 'click')"
_T = f"SELECT *, {SQL_TEMPLATE} AS template FROM loglines"


def bag(spark, d):
    lines = loglines(spark, d).select("path", "text")
    return lines.select("path", F.explode(X.field_bag(F.col("text"))).alias("f")).select("path", "f.axis", "f.value"), lines.groupBy("path").agg(F.count("*").alias("n"))


def templated(spark, d):
    return loglines(spark, d).withColumn("template", M.template(F.col("text")))


@query("template_counts", f"SELECT path, template, count(*) AS n, min(line_no) AS first_line, arg_min(text, line_no) AS exemplar FROM ({_T}) GROUP BY ALL")
def template_counts(spark, d):
    return A.template_counts(templated(spark, d))


@query("axis_rarity", f"""
WITH c AS (SELECT path, template, count(*) AS n, min(line_no) AS first_line, arg_min(text, line_no) AS exemplar FROM ({_T}) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY path ORDER BY n, first_line) AS rank FROM c WHERE n <= 12""")
def axis_rarity(spark, d):
    return A.axis_rarity(A.template_counts(templated(spark, d)), most=12)


@query("level_axes", f"""
WITH f AS ({_WORDS}), z AS (SELECT path, count(*) AS n FROM loglines GROUP BY path),
v AS (SELECT path, axis, value, count(*) AS c FROM f GROUP BY ALL),
a AS (SELECT path, axis, sum(c) AS total, count(*) AS card, max(c) AS top, sum(CASE WHEN NOT regexp_matches(value, '^[0-9]') AND length(value) <= 12 THEN c ELSE 0 END) AS w FROM v GROUP BY ALL),
s AS (SELECT path, axis, round(total / n * (1 - (card - 2) / 40) * (0.25 + 0.75 * w / total), 9) AS score FROM a JOIN z USING (path) WHERE card BETWEEN 2 AND 40 AND 4 * top >= total AND 10 * total >= 6 * n)
SELECT path, axis, rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, axis) AS rank FROM s) WHERE rank <= 3""")
def level_axes(spark, d):
    return A.level_axes(*bag(spark, d))


@query("level_hist", f"SELECT path, level, template, count(*) AS n FROM ({_T}) WHERE event_type NOT IN ('view', 'click') GROUP BY ALL")
def level_hist(spark, d):
    app = templated(spark, d).where(~F.col("event_type").isin("view", "click"))
    return app.groupBy("path", X.extract_axis(F.col("text"), "ws:1").alias("level"), "template").agg(F.count("*").alias("n"))


@query("axis_category", "SELECT path, value, n FROM (SELECT path, value, n, sum(n) OVER (PARTITION BY path) AS a FROM (SELECT path, level AS value, count(*) AS n FROM loglines GROUP BY ALL)) WHERE n <= 200 AND n < 0.05 * a")
def axis_category(spark, d):
    return A.axis_category(loglines(spark, d).groupBy("path", F.col("level").alias("value")).agg(F.count("*").alias("n")), share=0.05)


@query("status_axis", f"""
WITH f AS ({_WORDS}), z AS (SELECT path, count(*) AS n FROM loglines GROUP BY path),
v AS (SELECT path, axis, value, count(*) AS c, regexp_matches(value, '^[1-5][0-9]{{2}}$') AS code FROM f GROUP BY ALL),
a AS (SELECT path, axis, sum(c) AS total, coalesce(sum(c) FILTER (code), 0) AS coded, count(*) FILTER (code) AS card, max(c) FILTER (code) AS top, count(DISTINCT substr(value, 1, 1)) FILTER (code) AS classes FROM v GROUP BY ALL)
SELECT path, arg_max(axis, (CASE WHEN classes > 1 THEN 1 ELSE 0 END, coded, -card, axis)) AS axis FROM a JOIN z USING (path)
WHERE total >= 20 AND 10 * total >= 9 * n AND card BETWEEN 1 AND 16 AND 10 * coded >= 9 * total AND 4 * top >= coded GROUP BY path""")
def status_axis(spark, d):
    return A.status_axis(*bag(spark, d))


_SERIES = """
WITH b AS (SELECT host, status // 100 AS cls, sec // 86400 AS b FROM ev),
s AS (SELECT host, min(b) AS lo, max(b) AS hi FROM b GROUP BY host),
g AS (SELECT host, cls, x FROM (SELECT host, unnest(range(lo, hi + 1)) AS x FROM s) JOIN (SELECT DISTINCT host, cls FROM b) USING (host)),
d AS (SELECT g.host, g.cls, g.x, count(b.b) AS c FROM g LEFT JOIN b ON b.host = g.host AND b.cls = g.cls AND b.b = g.x GROUP BY ALL),
o AS (SELECT host, cls, sum(c) AS total, count(*) FILTER (c > 0) AS hot, count(*) AS buckets, max(c) AS peak, arg_max(x, (c, -x)) * 86400 AS peak_at, list_sort(list(c))[least(count(*) - 1, count(*) // 2) + 1] AS quiet FROM d GROUP BY ALL)"""


@query("outcome_summary", _SERIES + " SELECT host, cls, CAST(total AS BIGINT) AS total, hot, buckets, peak, peak_at, quiet FROM o")
def outcome_summary(spark, d):
    return A.outcome_series(events(spark, d).withColumn("cls", F.floor(F.col("status") / 100)), ["host"], "cls", "sec", 86400)


@query("axis_outcome", _SERIES + ", r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY total DESC, cls) AS r FROM o) SELECT host, cls, CAST(total AS BIGINT) AS total, hot, buckets, peak, peak_at, quiet FROM r WHERE r > 1 AND peak >= 2 AND peak >= 1.5 * greatest(quiet, 1)")
def axis_outcome(spark, d):
    return A.axis_outcome(outcome_summary(spark, d), ["host"], "cls", 2, 1.5)


@query("metric_axes", f"""
WITH f AS ({_WORDS}), z AS (SELECT path, count(*) AS n FROM loglines GROUP BY path),
v AS (SELECT path, axis, value, count(*) AS c FROM f GROUP BY ALL),
a AS (SELECT path, axis, sum(c) AS total, count(*) AS card, max(c) AS top, sum(CASE WHEN regexp_matches(value, '^-?\\d+(\\.\\d+)?$') THEN c ELSE 0 END) AS num FROM v GROUP BY ALL)
SELECT path, axis, rank FROM (SELECT path, axis, row_number() OVER (PARTITION BY path ORDER BY total DESC, round(card / total, 9), axis) AS rank FROM a JOIN z USING (path)
  WHERE 10 * total >= 6 * n AND card >= 20 AND 100 * num >= 95 * total AND 4 * top < total) WHERE rank <= 2""")
def metric_axes(spark, d):
    return A.metric_axes(*bag(spark, d))


@query("slot_verdict", """
WITH s AS (SELECT path, line_no, 0 AS slot, CAST(CASE WHEN event_type IN ('view', 'click') THEN k ELSE user_id % 3 END AS DOUBLE) AS value, true AS glued FROM loglines
  UNION ALL SELECT path, line_no, 1, CASE WHEN event_type IN ('view', 'click') THEN 1.1 ELSE user_id END, event_type IN ('view', 'click') FROM loglines
  UNION ALL SELECT path, line_no, 2, CASE WHEN event_type IN ('view', 'click') THEN status ELSE ms END, false FROM loglines
  UNION ALL SELECT path, line_no, 3, CASE WHEN event_type IN ('view', 'click') THEN ms ELSE k END, false FROM loglines),
w AS (SELECT *, first_value(value) OVER o AS f, lag(value) OVER o AS p FROM s WINDOW o AS (PARTITION BY path, slot ORDER BY line_no)),
a AS (SELECT path, slot, count(*) AS n, bool_or(glued) AS glued, count(DISTINCT value) AS dist, count(*) FILTER (value = f) AS same, count(*) FILTER (value > p) AS up FROM w GROUP BY ALL)
SELECT path, CAST(slot AS INTEGER) AS slot, n, CASE WHEN glued THEN 'name' WHEN n < 40 THEN 'few' WHEN dist < 3 THEN 'flag' WHEN 100 * same >= 99 * n THEN 'constant' WHEN dist > 64 AND 100 * up >= 98 * (n - 1) THEN 'counter' ELSE 'metric' END AS verdict FROM a""")
def slot_verdict(spark, d):
    s = loglines(spark, d).select("path", "line_no", F.posexplode(F.arrays_zip(M.slots(F.col("text")).alias("value"), M.glued(F.col("text")).alias("glued"))).alias("slot", "p"))
    return A.slot_verdict(s.select("path", "line_no", "slot", "p.value", "p.glued"))


_Q = "list_sort(list({v}))[CAST(least(count(*) - 1, floor({q} * count(*))) AS BIGINT) + 1]"


@query("slot_percentiles", f"SELECT path, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n, {_Q.format(v='ms', q=0.5)} AS p50, {_Q.format(v='ms', q=0.9)} AS p90, {_Q.format(v='ms', q=0.99)} AS p99 FROM loglines GROUP BY ALL HAVING count(*) >= 5")
def slot_percentiles(spark, d):
    return A.floor_quantiles(loglines(spark, d).withColumn("hour", F.hour("ts")), ["path", "hour"], "ms", p50=0.5, p90=0.9, p99=0.99).where("n >= 5")


@query("comparable_hours", """
WITH h AS (SELECT path, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM loglines GROUP BY ALL),
m AS (SELECT path, list_sort(list(n))[least(count(*) - 1, count(*) // 2) + 1] AS mid FROM h GROUP BY path)
SELECT path, min(hour) AS h0, max(hour) AS h1 FROM h JOIN m USING (path) WHERE n >= 2 AND 4 * n >= mid GROUP BY path""")
def comparable_hours(spark, d):
    return A.comparable_hours(hours(spark, d), least=2)


def hours(spark, d):
    return loglines(spark, d).groupBy("path", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


_RATE = f"""
WITH c AS (SELECT host AS path, event_type AS grp, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY ALL), a AS (SELECT path, hour, sum(n) AS tot FROM c GROUP BY ALL),
m AS (SELECT path, list_sort(list(tot))[least(count(*) - 1, count(*) // 2) + 1] AS mid FROM a GROUP BY path),
x AS (SELECT path, min(hour) AS h0, max(hour) AS h1 FROM a JOIN m USING (path) WHERE tot >= 2 AND 4 * tot >= mid GROUP BY path HAVING min(hour) < max(hour)),
p AS (SELECT c.path, grp, sum(CASE WHEN c.hour = h0 THEN n ELSE 0 END) AS n0, sum(CASE WHEN c.hour = h1 THEN n ELSE 0 END) AS n1, max(CASE WHEN c.hour = h0 THEN tot END) AS a0, max(CASE WHEN c.hour = h1 THEN tot END) AS a1
  FROM c JOIN x ON x.path = c.path JOIN a ON a.path = c.path AND a.hour = c.hour WHERE c.hour IN (h0, h1) GROUP BY ALL),
s AS (SELECT host AS path, event_type AS grp, CAST(hour(ts) AS INTEGER) AS hour, 'ms' AS slot, ms AS v FROM ev UNION ALL SELECT host, event_type, CAST(hour(ts) AS INTEGER), 'k', k FROM ev),
l AS (SELECT path, grp, hour, slot, {_Q.format(v='v', q=0.99)} AS level FROM s WHERE v IS NOT NULL GROUP BY ALL),
v AS (SELECT path, grp, slot, round(max(level) FILTER (hour = h1) / nullif(max(level) FILTER (hour = h0), 0), 6) AS sr FROM l JOIN x USING (path) GROUP BY ALL),
b AS (SELECT path, grp, slot, sr FROM v WHERE sr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path, grp ORDER BY abs(sr - 1) DESC, slot) = 1),
q AS (SELECT path, grp, CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1, CASE WHEN n0 >= 2 AND n1 >= 2 THEN round((n1 / a1) / (n0 / a0), 6) END AS ratio, slot, sr AS slot_ratio FROM p LEFT JOIN b USING (path, grp)),
r AS (SELECT *, coalesce(CASE WHEN ratio > 0 THEN greatest(ratio, 1 / ratio) END, 0) AS f, coalesce(CASE WHEN slot_ratio > 0 THEN greatest(slot_ratio, 1 / slot_ratio) END, 0) AS g,
  coalesce(ratio >= 1.25 OR ratio <= 0.8, false) OR coalesce(slot_ratio >= 1.25 OR slot_ratio <= 0.8, false) AS moved FROM q WHERE ratio IS NOT NULL OR slot_ratio IS NOT NULL)"""


def rates(spark, d):
    e = events(spark, d).select(F.col("host").alias("path"), F.col("event_type").alias("grp"), F.hour("ts").alias("hour"), "ms", "k")
    c = e.groupBy("path", "grp", "hour").agg(F.count("*").alias("n"))
    ends = A.comparable_hours(c.groupBy("path", "hour").agg(F.sum("n").alias("n")), least=2)
    values = e.select("path", "grp", "hour", F.explode(F.create_map(F.lit("ms"), "ms", F.lit("k"), "k")).alias("slot", "value"))
    return A.axis_rate(c, ends, A.floor_quantiles(values, ["path", "grp", "slot", "hour"], "value", level=0.99).drop("n"), low=0.8, high=1.25, least=2)


@query("axis_rate", _RATE + " SELECT path, grp, n0, n1, ratio, slot, slot_ratio, round(greatest(f, g), 6) AS factor, CASE WHEN f >= g THEN 'share' ELSE 'slot' END AS driver, moved FROM r")
def axis_rate(spark, d):
    return rates(spark, d)


@query("axis_background", _RATE + " SELECT path, grp, n0, n1, ratio FROM r WHERE n0 + n1 >= 10 AND ratio BETWEEN 0.8 AND 1.25")
def axis_background(spark, d):
    return A.axis_background(rates(spark, d), least=10)


@query("axis_excursion", f"""
WITH l AS (SELECT host, CAST(hour(ts) AS INTEGER) AS hour, {_Q.format(v='ms', q=0.5)} AS level FROM ev GROUP BY ALL),
t AS (SELECT host, list_sort(list(level))[least(count(*) - 1, count(*) // 2) + 1] AS typical FROM l GROUP BY host HAVING count(*) >= 4),
w AS (SELECT l.host, l.hour, level, typical, max(CASE WHEN level <= 1.05 * typical THEN 1 ELSE 0 END) OVER (PARTITION BY l.host ORDER BY l.hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a,
  max(CASE WHEN level <= 1.05 * typical THEN 1 ELSE 0 END) OVER (PARTITION BY l.host ORDER BY l.hour ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b FROM l JOIN t USING (host))
SELECT host, hour, level, typical FROM w WHERE level >= 1.15 * typical AND a = 1 AND b = 1""")
def axis_excursion(spark, d):
    return A.axis_excursion(events(spark, d).withColumn("hour", F.hour("ts")), "host", "hour", "ms", factor=1.15, back=1.05)


_NEW = """
WITH s AS (SELECT path, {v} AS v, row_number() OVER (PARTITION BY path ORDER BY line_no) AS pos FROM loglines),
z AS (SELECT path, count(*) AS tot, count(DISTINCT v) AS vs FROM s GROUP BY path),
f AS (SELECT path, v, min(pos) AS first, count(*) AS n FROM s GROUP BY ALL)"""


@query("axis_newcomer", _NEW.format(v="ip || '/' || (k % 10)") + ", x AS (SELECT f.*, count(*) OVER (PARTITION BY f.path) AS new FROM f JOIN z USING (path) WHERE tot >= 30 AND vs <= 4000 AND 2 * first > tot) SELECT path, v AS actor, first, n FROM x WHERE new <= 400")
def axis_newcomer(spark, d):
    lines = loglines(spark, d).select("path", "line_no", F.concat(F.get(M.actors(F.col("text")), F.lit(0)), F.lit("/"), F.col("k") % 10).alias("actor"))
    return A.axis_newcomer(lines, "path", "line_no", "actor", most_actors=4000, least=30, most_new=400)


_FLOOR = """
WITH e AS (SELECT path, min(line_no) AS a, max(line_no) AS b FROM loglines GROUP BY path),
v AS (SELECT path, k, count(*) AS n, min(line_no) AS line_no FROM loglines GROUP BY path, k),
h AS (SELECT path, hour(ts) AS h, count(*) AS n, min(line_no) AS line_no FROM loglines GROUP BY ALL),
u AS (SELECT path, line_no, 'rare' AS why, 1 AS s FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n, line_no) AS r FROM v) WHERE r <= 2
  UNION ALL SELECT path, line_no, 'fullest', 2 FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, h) AS r FROM h) WHERE r = 1
  UNION ALL SELECT path, a, 'first', 3 FROM e UNION ALL SELECT path, b, 'last', 4 FROM e),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, line_no ORDER BY s, why) AS r FROM u) WHERE r = 1)"""


@query("axis_floor", _FLOOR + " SELECT path, line_no, why FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY s, line_no) AS q FROM o) WHERE q <= 6")
def axis_floor(spark, d):
    return A.axis_floor(loglines(spark, d).select("path", "line_no", F.col("k").alias("value"), F.hour("ts").alias("hour")))


@query("file_profile", f"""
WITH w AS (SELECT path, w AS word, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(text, '\\b([A-Z]{{3,12}})\\b', 1)) AS w FROM loglines) GROUP BY ALL),
t AS (SELECT path, string_agg(word || '=' || n, ',' ORDER BY n DESC, word) AS vocabulary, string_agg(word || '=' || n, ',' ORDER BY word) FILTER (word IN ('FATAL', 'WARN', 'INFO')) AS severities FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, word) AS r FROM w) WHERE r <= 12 GROUP BY path)
SELECT l.path, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes, count(*) AS lines, CASE WHEN max(event_type) IN ('view', 'click') THEN strftime(min(ts), '%d/%b/%Y:%H:%M:%S') ELSE strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') END AS first_stamp, CASE WHEN max(event_type) IN ('view', 'click') THEN strftime(max(ts), '%d/%b/%Y:%H:%M:%S') ELSE strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') END AS last_stamp,
  count(DISTINCT {SQL_SHAPE}) AS shapes, coalesce(any_value(severities), '') AS severities, coalesce(any_value(vocabulary), '') AS vocabulary FROM loglines l LEFT JOIN t ON t.path = l.path GROUP BY l.path""")
def file_profile(spark, d):
    return G.file_profile(loglines(spark, d))


@query("peer_identity", "SELECT ip, user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n FROM ev GROUP BY ALL HAVING count(DISTINCT event_type) >= 2")
def peer_identity(spark, d):
    return G.seen_under(events(spark, d), ["ip", "user_id"], "event_type")


@query("port_fanout", "SELECT l_suppkey AS src, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_partkey) >= 50")
def port_fanout(spark, d):
    return G.fan_out(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), "l_partkey"), "src", "l_partkey")


@query("numeric_outlier", """
WITH u AS (SELECT 'k' AS col, CAST(k AS DOUBLE) AS v FROM ev UNION ALL SELECT 'ms', CAST(ms AS DOUBLE) FROM ev UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM ev)
SELECT col, count(*) AS n, max(v) AS top, list_sort(list(v))[least(count(*) - 1, count(*) // 2) + 1] AS mid FROM u GROUP BY col HAVING count(*) >= 8 AND max(v) >= 3 * list_sort(list(v))[least(count(*) - 1, count(*) // 2) + 1]""")
def numeric_outlier(spark, d):
    return A.numeric_outlier(events(spark, d), ["k", "ms", "user_id"], factor=3)


@query("shape_burst", f"SELECT path, template AS shape, count(*) AS n, min(line_no) AS line_no FROM ({_T}) GROUP BY ALL HAVING count(*) >= 20")
def shape_burst(spark, d):
    return templated(spark, d).groupBy("path", F.col("template").alias("shape")).agg(F.count("*").alias("n"), F.min("line_no").alias("line_no")).where("n >= 20")


@query("rare_field", """
WITH v AS (SELECT host, 'status' AS axis, CAST(status AS VARCHAR) AS value, count(*) AS n FROM ev GROUP BY ALL UNION ALL SELECT host, 'level', level, count(*) FROM ev GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY host, axis) AS tot, count(*) OVER (PARTITION BY host, axis) AS card FROM v)
SELECT host, axis, value, n FROM w WHERE card BETWEEN 2 AND 50 AND (n <= greatest(2.0, 0.005 * tot) OR (card <= 8 AND 100 * n <= 15 * tot))""")
def rare_field(spark, d):
    long = events(spark, d).select("host", F.explode(F.array(F.struct(F.lit("status").alias("axis"), F.col("status").cast("string").alias("value")), F.struct(F.lit("level").alias("axis"), F.col("level").alias("value")))).alias("f")).select("host", "f.axis", "f.value")
    return A.rare_field(long.groupBy("host", "axis", "value").agg(F.count("*").alias("n")), ["host", "axis"], "value")


@query("state_change", """
WITH s AS (SELECT user_id, status, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos FROM ev),
v AS (SELECT user_id, status, min(pos) AS first, count(*) AS n FROM s GROUP BY ALL),
w AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS tot, count(*) OVER (PARTITION BY user_id) AS card FROM v)
SELECT user_id, status, first, n FROM w WHERE card BETWEEN 2 AND 8 AND 10 * first > 3 * tot AND 2 * n < tot""")
def state_change(spark, d):
    return A.state_change(events(spark, d), "user_id", "event_id", "status")


@query("state_transition", "SELECT event_id, user_id % 5 AS was, k % 5 AS now FROM ev WHERE user_id % 5 <> k % 5")
def state_transition(spark, d):
    parts = F.split(F.concat(F.lit("state,"), F.col("user_id") % 5, F.lit(","), F.col("k") % 5), ",")
    numbers = F.filter(parts, lambda x: x.rlike(r"^\d+$"))
    e = events(spark, d).select("event_id", F.element_at(numbers, -2).cast("long").alias("was"), F.element_at(numbers, -1).cast("long").alias("now"))
    return e.where("was <> now")


_CARDS = [("license", "(?i)license"), ("table", r" \| "), ("symbols", r"\$\$\$")]


@query("card_hits", r"""
WITH h AS (SELECT 'license' AS card, path, line_no FROM doclines WHERE regexp_matches(text, '(?i)license') UNION ALL SELECT 'table', path, line_no FROM doclines WHERE contains(text, ' | ') UNION ALL SELECT 'symbols', path, line_no FROM doclines WHERE contains(text, '$$$')),
r AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY path, line_no) AS r FROM h)
SELECT card, count(*) AS n, string_agg(path || ':' || line_no, ' ' ORDER BY path, line_no) FILTER (r <= 3) AS first FROM r GROUP BY card""")
def card_hits(spark, d):
    return G.card_hits(doclines(spark, d), _CARDS)


@query("observables", """
SELECT host, count(*) FILTER (event_type = 'error') AS failures, count(DISTINCT ip) AS sources, min(sec) AS first, max(sec) AS last,
  CAST(round(10000.0 * count(*) FILTER (status = 404) / count(*)) AS BIGINT) AS missing_bp, count(*) FILTER (status >= 500) AS broken, count(DISTINCT CASE WHEN event_type = 'view' THEN ms END) AS body_sizes,
  count(DISTINCT user_id) - count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS no_outcome, arg_max(event_type, (k, event_id)) AS loudest FROM ev GROUP BY host""")
def observables(spark, d):
    t = F.col("event_type")
    return events(spark, d).groupBy("host").agg(
        F.count_if(t == "error").alias("failures"), F.count_distinct("ip").alias("sources"), F.min("sec").alias("first"), F.max("sec").alias("last"),
        F.round(10000.0 * F.count_if(F.col("status") == 404) / F.count("*")).cast("long").alias("missing_bp"), F.count_if(F.col("status") >= 500).alias("broken"), F.count_distinct(F.when(t == "view", F.col("ms"))).alias("body_sizes"),
        (F.count_distinct("user_id") - F.count_distinct(F.when(t == "purchase", F.col("user_id")))).alias("no_outcome"), F.max_by("event_type", F.struct("k", "event_id")).alias("loudest"))


@query("line_runs", """
WITH l AS (SELECT path, line_no FROM loglines WHERE ms > 200),
g AS (SELECT path, line_no, line_no - row_number() OVER (PARTITION BY path ORDER BY line_no) AS g FROM l)
SELECT path, min(line_no) AS lo, max(line_no) AS hi FROM g GROUP BY path, g""")
def line_runs(spark, d):
    return G.line_runs(loglines(spark, d).where("ms > 200"), ["path"], "line_no")


@query("cell_medians", "WITH m AS (SELECT host, event_type, median(ms) AS m FROM ev WHERE event_type IN ('view', 'click') GROUP BY ALL), p AS (SELECT host, max(CASE WHEN event_type = 'view' THEN m END) AS v, max(CASE WHEN event_type = 'click' THEN m END) AS c FROM m GROUP BY host) SELECT host, v AS view, c AS click, round(100 * (c - v) / v, 4) AS change_pct FROM p")
def cell_medians(spark, d):
    p = events(spark, d).groupBy("host").pivot("event_type", ["view", "click"]).agg(F.percentile("ms", F.lit(0.5)))
    return p.withColumn("change_pct", F.round(100 * (F.col("click") - F.col("view")) / F.col("view"), 4))


@query("baseline_ratio", "WITH m AS (SELECT event_type AS arm, sum(ms) / count(ms) AS m FROM ev GROUP BY ALL) SELECT arm, round(m, 6) AS mean, round(m / (SELECT m FROM m WHERE arm = 'view'), 6) AS ratio FROM m")
def baseline_ratio(spark, d):
    return G.baseline_ratio(events(spark, d).withColumn("arm", F.col("event_type")), "arm", "ms", "view")


@query("spend_rollup", """
WITH o AS (SELECT o_orderpriority AS p, o_orderstatus AS s, CAST(floor(o_totalprice) AS BIGINT) AS amount FROM orders)
SELECT p, s, CAST(sum(amount) AS BIGINT) AS spent, CAST(sum(CASE WHEN s = 'F' THEN amount ELSE 0 END) AS BIGINT) AS burned, round(100 * sum(CASE WHEN s = 'F' THEN amount ELSE 0 END) / sum(amount), 4) AS wasted_pct FROM o GROUP BY ROLLUP (p, s)""")
def spend_rollup(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), F.floor("o_totalprice").cast("long").alias("amount"))
    return G.spend_rollup(o, "p", "s", "amount", F.col("s") == "F")


@query("outcome_rollup", """
WITH r AS (SELECT o_custkey, arg_max(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 ELSE 0 END) AS o_orderstatus FROM orders GROUP BY o_custkey) SELECT * FROM r""")
def outcome_rollup(spark, d):
    return G.strongest(table(spark, d, "orders"), "o_custkey", "o_orderstatus", {"F": 2, "P": 1, "O": 0})


@query("triage_buckets", f"""
WITH v AS ({_VERDICTS}), r AS (SELECT CASE WHEN axis = 'error' AND n >= 50 THEN 'R1' WHEN host = 'h1' THEN 'R2' WHEN axis IN ('view', 'click') AND n < 20 THEN 'R3' WHEN burst THEN 'R4' ELSE 'open' END AS bucket FROM v)
SELECT bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM r GROUP BY bucket""")
def triage_buckets(spark, d):
    b = verdicts(spark, d).groupBy(F.coalesce(P.first_rule(_RULES), F.lit("open")).alias("bucket")).agg(F.count("*").alias("n"))
    return b.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6))


@query("ledger_counters", f"""
WITH v AS ({_VERDICTS}), s AS (SELECT axis, CASE WHEN regexp_matches(verdict, '^D.*\\d') THEN 'D' WHEN regexp_matches(verdict, '^N.*\\d') THEN 'N' WHEN regexp_matches(verdict, '^X\\s+\\S.{{2,}}') THEN 'X' ELSE 'open' END AS state, verdict FROM v)
SELECT axis, count(*) FILTER (state = 'open') AS open, count(*) FILTER (verdict = '?') AS untouched, count(*) FILTER (state = 'D') AS findings, count(*) FILTER (state = 'X') AS dismissed FROM s GROUP BY axis""")
def ledger_counters(spark, d):
    v = verdicts(spark, d).withColumn("state", P.verdict_state(F.col("verdict")))
    n = lambda c, name: F.count_if(c).alias(name)
    return v.groupBy("axis").agg(n(F.col("state") == "open", "open"), n(F.col("verdict") == "?", "untouched"), n(F.col("state") == "D", "findings"), n(F.col("state") == "X", "dismissed"))


@query("duplicate_ids", "SELECT user_id AS id, count(*) AS n FROM ev GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return events(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@query("tool_profile", "SELECT role, CAST(length(text) % 3 AS INTEGER) AS tool, count(*) AS n FROM conversations GROUP BY ALL")
def tool_profile(spark, d):
    return table(spark, d, "conversations").groupBy("role", (F.length("text") % 3).alias("tool")).agg(F.count("*").alias("n"))


@query("host_partition", "SELECT 'flat' AS corpus, 1 AS depth, count(DISTINCT host) AS roots FROM loglines UNION ALL SELECT 'deep', 3, count(DISTINCT host) FROM loglines")
def host_partition(spark, d):
    """Two corpora: hosts at the top, and hosts two folders down."""
    paths = loglines(spark, d).select("path").distinct()
    flat, deep = G.host_depth(paths), G.host_depth(paths.select(F.concat(F.lit("site/rack/"), "path").alias("path")))
    named = lambda df, name: df.select(F.lit(name).alias("corpus"), "depth", "roots")
    return named(flat, "flat").unionByName(named(deep, "deep"))


@query("checklist_score", r"""SELECT doc_id, CAST(regexp_matches(text, '(?i)license') AS BIGINT) + CAST(regexp_matches(text, '\d') AS BIGINT) + CAST(regexp_matches(text, '\n') AS BIGINT) AS score FROM documents""")
def checklist_score(spark, d):
    checks = ["(?i)license", r"\d", r"\n"]
    return table(spark, d, "documents").select("doc_id", sum((F.col("text").rlike(c).cast("long") for c in checks[1:]), F.col("text").rlike(checks[0]).cast("long")).alias("score"))


@query("file_coverage", "SELECT count(DISTINCT path) FILTER (cited) AS cited, count(DISTINCT path) AS files FROM (SELECT path, status = 500 AS cited FROM loglines)")
def file_coverage(spark, d):
    lines = loglines(spark, d)
    files = lines.select("path").distinct()
    cited = lines.where("status = 500").select("path").distinct().withColumn("c", F.lit(1))
    return files.join(cited, "path", "left").agg(F.count("c").alias("cited"), F.count("*").alias("files"))


_LABELLED = "SELECT path, line_no, CASE WHEN k < 3 THEN 'broken' END AS a, CASE WHEN k < 10 THEN 'failing' END AS b, CASE WHEN ms > 300 THEN 'slow' END AS c FROM loglines"


@query("derive_truth", f"""
WITH l AS (SELECT path, line_no, label FROM (SELECT path, line_no, unnest([a, b, c]) AS label FROM ({_LABELLED})) WHERE label IS NOT NULL),
s AS (SELECT path, label, list(DISTINCT line_no) AS s FROM l GROUP BY ALL),
i AS (SELECT DISTINCT x.path, x.label FROM s x JOIN s y ON x.path = y.path AND x.label <> y.label WHERE list_has_all(y.s, x.s) AND (len(x.s) < len(y.s) OR (len(x.s) = len(y.s) AND x.label > y.label))),
k AS (SELECT DISTINCT l.* FROM l ANTI JOIN i USING (path, label)),
g AS (SELECT path, label, line_no, line_no - row_number() OVER (PARTITION BY path, label ORDER BY line_no) AS g FROM k)
SELECT path, label AS phase, min(line_no) AS lo, max(line_no) AS hi FROM g GROUP BY path, label, g""")
def derive_truth(spark, d):
    marks = F.array_compact(F.array(F.when(F.col("k") < 3, "broken"), F.when(F.col("k") < 10, "failing"), F.when(F.col("ms") > 300, "slow")))
    return G.truth_phases(loglines(spark, d).select("path", "line_no", F.explode(marks).alias("label")))


@query("boundary_rows", "SELECT path, arg_max(line_no, (ms, sha256(text))) AS line_no, max(ms) AS ms FROM loglines GROUP BY path")
def boundary_rows(spark, d):
    return loglines(spark, d).groupBy("path").agg(F.max_by("line_no", F.struct("ms", F.sha2("text", 256))).alias("line_no"), F.max("ms").alias("ms"))


@query("hourly_onset", """
WITH h AS (SELECT host, event_type, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM ev GROUP BY ALL),
f AS (SELECT *, first_value(n) OVER (PARTITION BY host, event_type ORDER BY hour) AS opening FROM h)
SELECT host, event_type, max(opening) AS opening, min(CASE WHEN n >= 1.5 * opening OR 1.5 * n <= opening THEN hour END) AS onset FROM f GROUP BY ALL""")
def hourly_onset(spark, d):
    h = events(spark, d).groupBy("host", "event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return A.onset(h, ["host", "event_type"], "hour", "n", 1.5)


@query("p99_series", f"""
WITH h AS (SELECT host, CAST(hour(ts) AS INTEGER) AS hour, {_Q.format(v='ms', q=0.99)} AS p99 FROM ev GROUP BY ALL)
SELECT host, string_agg(hour || '=' || p99, ' ' ORDER BY hour) AS series FROM h GROUP BY host""")
def p99_series(spark, d):
    h = A.floor_quantiles(events(spark, d).withColumn("hour", F.hour("ts")), ["host", "hour"], "ms", p99=0.99)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("hour", "p99"))), lambda x: F.concat(x["hour"], F.lit("="), x["p99"]))
    return h.groupBy("host").agg(F.array_join(cells, " ").alias("series"))
