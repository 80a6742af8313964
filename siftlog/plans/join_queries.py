"""Queries over joins, windows, top-k, sets and scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.functions import fields as X
from siftlog.functions import masking as M
from siftlog.functions.clock import clock_gap
from siftlog.operators import axes as A
from siftlog.operators import joins as J
from siftlog.operators import tallies as G
from siftlog.plans.axis_queries import _FLOOR, _RATE, rates
from siftlog.plans.fixtures import doclines, events, loglines, table
from siftlog.plans.registry import query
from siftlog.plans.text_queries import SQL_PATH, SQL_QUOTES, SQL_TEMPLATE, SQL_TOKENS
from siftlog.sources.lines import binary_files, write_worklist
from siftlog.sources.records import read_table, write_table
from siftlog.work import work_path

_IDS = {"svc-1": ["svc", "1"], "user=7": ["user=7"], "k=42": ["k=42"], "zz-9": ["zz", "9"]}
_HITS = r"""hits AS (SELECT path, line_no, 'svc-1' AS id FROM loglines WHERE event_type NOT IN ('view', 'click') AND user_id % 3 = 1
  UNION ALL SELECT path, line_no, 'user=7' FROM loglines WHERE event_type NOT IN ('view', 'click') AND user_id = 7
  UNION ALL SELECT path, line_no, 'k=42' FROM loglines WHERE event_type NOT IN ('view', 'click') AND k = 42)"""


def hits(spark, d):
    return J.id_hits(loglines(spark, d).select("path", "line_no", "text"), _IDS)


@query("id_trace", f"WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY id, path ORDER BY line_no) AS r FROM hits) SELECT id, path, count(*) AS n, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (r <= 3) AS refs FROM r GROUP BY ALL")
def id_trace(spark, d):
    return J.id_trace(hits(spark, d))


@query("id_absence", f"WITH {_HITS} SELECT i.id, p.path FROM (SELECT DISTINCT path FROM loglines) p, (SELECT unnest(['svc-1', 'user=7', 'k=42', 'zz-9']) AS id) i ANTI JOIN hits h ON h.id = i.id AND h.path = p.path")
def id_absence(spark, d):
    return J.id_absence(loglines(spark, d).select("path").distinct(), list(_IDS), hits(spark, d))


@query("id_cooccurrence", f"""WITH {_HITS}, i AS (SELECT unnest(['svc-1', 'user=7', 'k=42', 'zz-9']) AS id),
n AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM hits a JOIN hits b ON a.path = b.path AND a.line_no = b.line_no AND a.id < b.id GROUP BY ALL)
SELECT x.id AS a, y.id AS b, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN 'confirmed' ELSE 'not-in-corpus' END AS verdict FROM i x JOIN i y ON x.id < y.id LEFT JOIN n ON n.a = x.id AND n.b = y.id""")
def id_cooccurrence(spark, d):
    return J.co_occurrence(hits(spark, d), list(_IDS))


_ASKED = "SELECT DISTINCT CASE event_id % 4 WHEN 0 THEN host || '/logs/' || event_type || '.log' WHEN 1 THEN event_type || '.log' WHEN 2 THEN 'no/' || event_type ELSE 'logs/' || event_type || '.log' END AS asked FROM ev"


@query("resolve_paths", f"""
WITH a AS ({_ASKED}), p AS (SELECT DISTINCT path FROM loglines),
j AS (SELECT asked, path, asked = path AS exact FROM a LEFT JOIN p ON path = asked OR ends_with(path, '/' || asked)),
g AS (SELECT asked, count(path) AS n, max(CASE WHEN exact THEN path END) AS own, min(path) AS one FROM j GROUP BY asked)
SELECT asked, CASE WHEN own IS NOT NULL OR n = 1 THEN coalesce(own, one) END AS path, CASE WHEN own IS NOT NULL OR n = 1 THEN 'ok' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS state FROM g""")
def resolve_paths(spark, d):
    k, log = F.col("event_id") % 4, F.concat("event_type", F.lit(".log"))
    asked = F.when(k == 0, F.concat("host", F.lit("/logs/"), log)).when(k == 1, log).when(k == 2, F.concat(F.lit("no/"), "event_type")).otherwise(F.concat(F.lit("logs/"), log))
    return J.resolve_paths(events(spark, d).select(asked.alias("asked")), loglines(spark, d).select("path"))


def claims(spark, d):
    """Of each document's first full line, a claim of one of seven kinds; see ``_CLAIMS``."""
    first = doclines(spark, d).where(F.trim("text") != "").groupBy("doc_id", "path").agg(F.min_by("text", "line_no").alias("line"), F.min("line_no").alias("line_no"))
    k, plain = F.col("doc_id") % 7, F.translate("line", '"`«»“”', "")
    quoted = F.concat(F.lit('it says "'), F.substring(plain, 1, 60), F.lit('" there'))
    turned = F.concat(F.lit('it says "'), F.array_join(F.reverse(F.split(F.substring(plain, 1, 60), " ", -1)), " "), F.lit('" there'))
    path = F.when(k == 2, F.concat(F.lit("x/"), "path")).when(k == 4, F.concat("doc_id", F.lit(".txt"))).otherwise(F.col("path"))
    at = F.when(k == 1, F.col("line_no") + 1).when(k == 3, F.col("line_no") + 1_000_000).otherwise(F.col("line_no"))
    claim = F.when(k == 4, plain).when(k == 5, turned).when(k == 6, "строка говорит об ошибке").otherwise(quoted)
    return first.select(F.col("doc_id").alias("claim_id"), path.alias("path"), at.alias("line_lo"), at.alias("line_hi"), claim.alias("claim"))


def claim_verdicts(spark, d):
    """The claims against all lines; every eleventh file is binary."""
    lines = doclines(spark, d)
    nul = F.when((F.col("line_no") == 1) & (F.col("doc_id") % 11 == 0), F.concat(F.lit("\x00"), "text")).otherwise(F.col("text"))
    binary = binary_files(lines.select("path", "line_no", nul.alias("text"))).where("binary").select("path")
    return J.verify_claims(claims(spark, d), lines, binary)


#: The same in SQL: what a claim says, what the line holds, and the verdict of both.
_CLAIMS = f"""
WITH f AS (SELECT doc_id, path, min(line_no) AS line_no, translate(arg_min(text, line_no), '"`«»“”', '') AS plain FROM doclines WHERE trim(text) <> '' GROUP BY ALL),
c AS (SELECT doc_id AS claim_id, CASE WHEN doc_id % 7 <> 2 THEN path END AS path, line_no + CASE doc_id % 7 WHEN 1 THEN 1 WHEN 3 THEN 1000000 ELSE 0 END AS line_no,
  CASE doc_id % 7 WHEN 4 THEN plain WHEN 6 THEN 'строка говорит об ошибке' WHEN 5 THEN 'it says "' || array_to_string(list_reverse(string_split(substr(plain, 1, 60), ' ')), ' ') || '" there' ELSE 'it says "' || substr(plain, 1, 60) || '" there' END AS claim FROM f),
j AS (SELECT claim_id, c.path, claim, l.text AS line, regexp_matches(l.text, '[\\x{{400}}-\\x{{4FF}}]') AS cyr, regexp_matches(l.text, '[A-Za-z]') AS lat, {SQL_QUOTES.format('claim')} AS qs, {SQL_TOKENS.format("coalesce(l.text, '')")} AS got,
  trim(lower(regexp_replace(l.text, '\\s+', ' ', 'g'))) AS norm FROM c LEFT JOIN doclines l ON l.path = c.path AND l.line_no = c.line_no),
k AS (SELECT *, list_transform(list_append(qs, claim), lambda x: list_filter({SQL_TOKENS.format('x')}, lambda w: regexp_full_match(w, '[0-9]+') OR CASE WHEN regexp_matches(w, '[\\x{{400}}-\\x{{4FF}}]') THEN cyr ELSE lat END)) AS ts FROM j),
m AS (SELECT *, list_transform(ts, lambda t: {{'n': len(t), 'w': len(list_filter(t, lambda w: NOT regexp_full_match(w, '[0-9]+'))), 'h': len(list_intersect(t, got))}}) AS ms FROM k),
b AS (SELECT *, list_min(list_filter(list_transform(qs, lambda x, i: {{'a': -length(x), 'i': i, 'n': ms[i].n, 'w': ms[i].w, 'h': ms[i].h}}), lambda z: z.n >= 4 AND z.w >= 2)) AS best, ms[len(ms)] AS own,
  len(list_filter(qs, lambda x: trim(lower(regexp_replace(x, '\\s+', ' ', 'g'))) <> '' AND contains(norm, trim(lower(regexp_replace(x, '\\s+', ' ', 'g')))))) > 0 AS verbatim FROM m),
v AS (SELECT claim_id, CASE WHEN path IS NULL THEN 'missing-file' WHEN claim_id % 11 = 0 THEN 'binary-file' WHEN line IS NULL THEN 'out-of-range' WHEN verbatim THEN 'ok'
  WHEN best IS NOT NULL THEN CASE WHEN best.h >= 0.6 * best.n THEN 'ok' ELSE 'wrong-content' END WHEN own.n < 3 OR own.w < 2 THEN 'unverifiable' WHEN own.h >= 0.34 * own.n THEN 'ok' ELSE 'wrong-content' END AS verdict FROM b)"""


@query("verify_claims", _CLAIMS + " SELECT claim_id, verdict FROM v")
def verify_claims(spark, d):
    return claim_verdicts(spark, d)


@query("sibling_prefix", r"""
WITH t AS (SELECT doc_id AS id, lang AS owner, regexp_replace(text, '\s+', ' ', 'g') AS text, len(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' ')) AS n FROM documents)
SELECT a.id, b.id AS of FROM t a JOIN t b ON a.owner = b.owner AND a.n >= 4 AND a.n < b.n AND starts_with(b.text, a.text || ' ')""")
def sibling_prefix(spark, d):
    """Whole texts that are the beginning of another's."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("owner"), F.regexp_replace("text", r"\s+", " ").alias("text"))
    return J.sibling_prefix(docs)


@query("refutations", """
WITH c AS (SELECT path, k, count(*) AS n, min(line_no) AS line_no, min_by(sec, line_no) % 86400 AS sod FROM loglines GROUP BY path, k HAVING count(*) <= 3),
b AS (SELECT path, count(*) AS background FROM loglines WHERE level = 'INFO' GROUP BY path),
p AS (SELECT host || '/' AS h, arg_max(sec, (ms, event_id)) % 86400 AS peak FROM ev GROUP BY host)
SELECT c.path, c.line_no, c.n, coalesce(background, 0) AS background, least((sod - peak + 86400) % 86400, 86400 - (sod - peak + 86400) % 86400) AS gap FROM c LEFT JOIN b USING (path) LEFT JOIN p ON starts_with(c.path, h)""")
def refutations(spark, d):
    lines = loglines(spark, d)
    c = lines.groupBy("path", "host", "k").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no"), (F.min_by("sec", "line_no") % 86400).alias("sod")).where("n <= 3")
    background = lines.where("level = 'INFO'").groupBy("path").agg(F.count("*").alias("background"))
    peak = events(spark, d).groupBy("host").agg((F.max_by("sec", F.struct("ms", "event_id")) % 86400).alias("peak"))
    return c.join(background, "path", "left").join(peak, "host", "left").select("path", "line_no", "n", F.coalesce("background", F.lit(0)).alias("background"), clock_gap(F.col("sod"), F.col("peak")).alias("gap"))


@query("stitch_rotation", """
WITH x AS (SELECT host || '/' || event_type || '-' || (sec // 86400) AS stem, sec // 28800 % 3 AS part, sec FROM ev),
s AS (SELECT stem, part, min(sec) AS lo, max(sec) AS hi, count(*) AS n FROM x GROUP BY ALL)
SELECT stem AS stream, count(*) AS slices, CAST(sum(n) AS BIGINT) AS n, min(lo) AS lo, max(hi) AS hi, count(*) > 1 AS stitched FROM s GROUP BY stem""")
def stitch_rotation(spark, d):
    x = events(spark, d).withColumn("part", F.floor(F.col("sec") / 28800) % 3)
    stem = F.concat("host", F.lit("/"), "event_type", F.lit("-"), F.expr("sec div 86400"))
    s = x.groupBy(stem.alias("stem"), F.concat(stem, F.lit(".log."), 2 - F.col("part")).alias("path")).agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"), F.count("*").alias("n"))
    return J.stitch_rotation(s)


def truth(spark, d):
    marks = table(spark, d, "labels").where("quality = 0 or toxic = 1").select(F.col("doc_id"), (F.col("toxic") == 1).alias("is_decoy"))
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    return table(spark, d, "documents").select("doc_id", path.alias("path")).join(marks, "doc_id").select(F.col("doc_id").alias("defect_id"), "is_decoy", "path", F.lit(1).cast("long").alias("lo"), F.lit(3).cast("long").alias("hi"))


def ranked(spark, d):
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("row_id"), path.alias("path"), (F.lit(2) + F.col("doc_id") % 6).cast("long").alias("line"))


_TRUTH = f"t AS (SELECT d.doc_id AS defect_id, toxic = 1 AS is_decoy, {SQL_PATH} AS path, 1 AS lo, 3 AS hi FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0 OR toxic = 1), r AS (SELECT doc_id AS row_id, {SQL_PATH} AS path, 2 + doc_id % 6 AS line FROM documents)"


@query("anchor_hits", f"WITH {_TRUTH} SELECT row_id, defect_id FROM r JOIN t ON r.path = t.path AND line BETWEEN lo AND hi")
def anchor_hits(spark, d):
    a = ranked(spark, d).select("row_id", "path", F.col("line").alias("lo"), F.col("line").alias("hi"))
    b = truth(spark, d).select("defect_id", "path", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    return J.overlap_join(a, b).select("row_id", "defect_id")


@query("step1_score", f"""
WITH {_TRUTH}, w AS (SELECT unnest([0, 2, 50]) AS win), h AS (SELECT win, defect_id, row_id, is_decoy FROM w, r JOIN t ON r.path = t.path AND line BETWEEN lo - win AND hi + win)
SELECT win, count(DISTINCT defect_id) FILTER (NOT is_decoy) AS found, count(DISTINCT defect_id) FILTER (is_decoy) AS decoys, count(DISTINCT row_id) AS useful FROM h GROUP BY win""")
def step1_score(spark, d):
    a = ranked(spark, d).withColumn("win", F.explode(F.array(F.lit(0), F.lit(2), F.lit(50)))).select("row_id", "win", "path", F.greatest(F.col("line") - F.col("win"), F.lit(0)).alias("lo"), (F.col("line") + F.col("win")).alias("hi"))
    b = truth(spark, d).select("defect_id", "is_decoy", "path", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"))
    h = J.overlap_join(a, b)
    return h.groupBy("win").agg(F.count_distinct(F.when(~F.col("is_decoy"), F.col("defect_id"))).alias("found"), F.count_distinct(F.when(F.col("is_decoy"), F.col("defect_id"))).alias("decoys"), F.count_distinct("row_id").alias("useful"))


@query("label_coverage", f"WITH {_TRUTH}, h AS (SELECT * FROM r JOIN t ON r.path = t.path AND line BETWEEN lo AND hi) SELECT count(DISTINCT (r.path, line)) AS lines, count(DISTINCT row_id) AS rows, count(DISTINCT r.path) AS files FROM r JOIN t ON r.path = t.path AND line BETWEEN lo AND hi")
def label_coverage(spark, d):
    a = ranked(spark, d).select("row_id", "path", F.col("line").alias("lo"), F.col("line").alias("hi"))
    h = J.overlap_join(a, truth(spark, d).select("path", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi")))
    return h.agg(F.count_distinct("path", "lo").alias("lines"), F.count_distinct("row_id").alias("rows"), F.count_distinct("path").alias("files"))


@query("detector_score", "SELECT quality, count(*) FILTER (n_chars < 300) AS flagged, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality")
def detector_score(spark, d):
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return j.groupBy("quality").agg(F.count_if(F.col("n_chars") < 300).alias("flagged"), F.count("*").alias("n"))


@query("truth_outcome_pivot", f"""
WITH {_TRUTH}, o AS (SELECT {SQL_PATH} AS path, 1 AS b_lo, 2 AS b_hi, CASE WHEN n_chars < 300 THEN 'dismissed' WHEN n_chars < 2000 THEN 'unlabelled' ELSE 'normal' END AS outcome FROM documents WHERE doc_id % 6 < 5
  UNION ALL SELECT {SQL_PATH}, 3, 6, 'incident' FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT {SQL_PATH}, 4, 6, 'incident' FROM documents),
z AS (SELECT defect_id, is_decoy, max(CASE outcome WHEN 'incident' THEN 4 WHEN 'normal' THEN 3 WHEN 'unlabelled' THEN 2 WHEN 'dismissed' THEN 1 ELSE 0 END) AS z FROM t LEFT JOIN o ON o.path = t.path AND b_lo <= hi AND lo <= b_hi GROUP BY ALL)
SELECT is_decoy, count(*) FILTER (z = 4) AS incident, count(*) FILTER (z = 3) AS normal, count(*) FILTER (z = 2) AS unlabelled, count(*) FILTER (z = 1) AS dismissed, count(*) FILTER (z = 0) AS elsewhere FROM z GROUP BY is_decoy""")
def truth_outcome_pivot(spark, d):
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path")
    docs = table(spark, d, "documents").select("doc_id", path, "n_chars")
    block = lambda rows, lo, hi, outcome: rows.select("path", F.lit(lo).alias("b_lo"), F.lit(hi).alias("b_hi"), outcome.alias("outcome"))
    told = F.when(F.col("n_chars") < 300, "dismissed").when(F.col("n_chars") < 2000, "unlabelled").otherwise("normal")
    blocks = block(docs.where("doc_id % 6 < 5"), 1, 2, told).unionByName(block(docs.where("doc_id % 4 = 0"), 3, 6, F.lit("incident"))).unionByName(block(docs, 4, 6, F.lit("incident")))
    return J.truth_outcomes(truth(spark, d), blocks)


@query("proof_reach", """
WITH c AS (SELECT 'shard-' || (conv_id // 64) AS path, conv_id * 100 + turn AS call_id, CASE WHEN turn % 3 > 0 THEN conv_id END AS c_lo, conv_id + turn AS c_hi, role <> 'user' AS failed FROM conversations),
p AS (SELECT doc_id AS proof_id, 'shard-' || (doc_id // 64) AS path, doc_id AS lo, doc_id + 2 AS hi FROM documents)
SELECT proof_id, CASE max(CASE WHEN c_lo <= hi AND lo <= c_hi AND NOT failed THEN 2 WHEN call_id IS NOT NULL AND (c_lo IS NULL OR failed) THEN 1 ELSE 0 END) WHEN 2 THEN 'reached' WHEN 1 THEN 'unknown' ELSE 'not_reached' END AS reach FROM p LEFT JOIN c USING (path) GROUP BY proof_id""")
def proof_reach(spark, d):
    c = table(spark, d, "conversations").select(F.concat(F.lit("shard-"), F.expr("conv_id div 64")).alias("path"), (F.col("conv_id") * 100 + F.col("turn")).alias("call_id"), F.when(F.col("turn") % 3 > 0, F.col("conv_id")).alias("c_lo"), (F.col("conv_id") + F.col("turn")).alias("c_hi"), (F.col("role") != "user").alias("failed"))
    p = table(spark, d, "documents").select(F.col("doc_id").alias("proof_id"), F.concat(F.lit("shard-"), F.expr("doc_id div 64")).alias("path"), F.col("doc_id").alias("lo"), (F.col("doc_id") + 2).alias("hi"))
    return J.proof_reach(c, p)


@query("event_twins", """
WITH n AS (SELECT event_type, ms, status, host, count(*) AS own FROM ev GROUP BY ALL), a AS (SELECT event_type, ms, status, sum(own) AS tot FROM n GROUP BY ALL)
SELECT event_id, CAST(tot - own AS BIGINT) AS twins FROM ev JOIN n USING (event_type, ms, status, host) JOIN a USING (event_type, ms, status) WHERE tot > own""")
def event_twins(spark, d):
    return J.event_twins(events(spark, d), ["event_type", "ms", "status"], "host", "event_id")


@query("rank_match", """
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM ev WHERE event_type = 'view'),
b AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM ev WHERE event_type = 'click')
SELECT a.event_id AS a_row, b.event_id AS b_row FROM a JOIN b USING (user_id, k, c)""")
def rank_match(spark, d):
    e = events(spark, d)
    return J.rank_match(e.where("event_type = 'view'"), e.where("event_type = 'click'"), ["user_id"], "event_id", "event_id")


@query("snapshot_diff", """
SELECT o_orderkey AS path, CASE o_orderkey % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'disappeared' WHEN 2 THEN 'rotated' WHEN 3 THEN 'truncated' WHEN 4 THEN 'append' ELSE 'unchanged' END AS change FROM orders""")
def snapshot_diff(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("inode"), F.floor("o_totalprice").cast("long").alias("size"))
    k = F.col("path") % 7
    b = o.where(k != 1).select("path", (F.col("inode") + (k == 2).cast("int")).alias("inode"), (F.col("size") + F.when(k == 3, -1).when(k == 4, 1).otherwise(0)).alias("size"))
    return J.snapshot_diff(o.where(k != 0), b)


@query("pair_turns", """
WITH t AS (SELECT conv_id * 100 + turn AS id, conv_id, turn, role, length(text) AS n FROM conversations), c AS (SELECT * FROM t WHERE role = 'user'), r AS (SELECT id - 1 AS id, n % 4 = 0 AS is_error, n FROM t WHERE role <> 'user')
SELECT c.id AS call_id, CAST(c.n % 3 AS INTEGER) AS tool, CASE WHEN NOT coalesce(is_error, true) THEN c.n END AS lo, CASE WHEN NOT coalesce(is_error, true) THEN c.n + r.n END AS hi, coalesce(is_error, true) AS failed FROM c LEFT JOIN r USING (id)""")
def pair_turns(spark, d):
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", F.length("text").cast("long").alias("n"))
    results = t.where("role <> 'user'").select((F.col("id") - 1).alias("call_id"), (F.col("n") % 4 == 0).alias("is_error"), F.col("n").alias("m"))
    calls = t.where("role = 'user'").join(results.select("call_id", "m"), F.col("id") == F.col("call_id"), "left").select(F.col("id").alias("call_id"), (F.col("n") % 3).cast("int").alias("tool"), F.col("n").alias("lo"), (F.col("n") + F.col("m")).alias("hi"))
    return J.pair_turns(calls, results.drop("m"))


@query("reconcile", """
WITH c AS (SELECT o_orderkey, o_orderkey % 8 AS n, o_orderkey % 2 AS odd FROM orders WHERE o_orderkey % 11 > 0), e AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, max(l_orderkey % 2) AS odd FROM lineitem WHERE l_orderkey % 13 > 0 GROUP BY ALL)
SELECT coalesce(c.o_orderkey, e.o_orderkey) AS o_orderkey, concat_ws(',', CASE WHEN e.o_orderkey IS NULL THEN 'unsupported' END, CASE WHEN c.o_orderkey IS NULL THEN 'unclaimed' END, CASE WHEN c.n <> e.n THEN 'n' END, CASE WHEN c.odd <> e.odd THEN 'odd' END) AS flags FROM c FULL JOIN e ON c.o_orderkey = e.o_orderkey""")
def reconcile(spark, d):
    claimed = table(spark, d, "orders").where("o_orderkey % 11 > 0").select("o_orderkey", (F.col("o_orderkey") % 8).alias("n"), (F.col("o_orderkey") % 2).alias("odd"))
    derived = table(spark, d, "lineitem").where("l_orderkey % 13 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.max(F.col("l_orderkey") % 2).alias("odd"))
    return J.reconcile(claimed, derived, "o_orderkey", ["n", "odd"])


@query("unverified_delivery", f"SELECT {SQL_PATH} AS path, doc_id % 7 + 1 AS line_no FROM documents WHERE doc_id % 3 > 0 AND NOT (doc_id % 5 = 0)")
def unverified_delivery(spark, d):
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path")
    docs = table(spark, d, "documents").select("doc_id", path, (F.col("doc_id") % 7 + 1).alias("line_no"))
    return docs.where("doc_id % 3 > 0").select("path", "line_no").join(docs.where("doc_id % 5 = 0").select("path", "line_no"), ["path", "line_no"], "left_anti")


@query("truth_drift", f"WITH {_TRUTH}, n AS (SELECT path, max(line_no) AS n FROM doclines GROUP BY path) SELECT defect_id, coalesce(n, 0) AS n, hi > coalesce(n, 0) AS past_end FROM t LEFT JOIN n USING (path)")
def truth_drift(spark, d):
    n = doclines(spark, d).groupBy("path").agg(F.max("line_no").alias("n"))
    return truth(spark, d).join(n, "path", "left").select("defect_id", F.coalesce("n", F.lit(0)).alias("n"), (F.col("hi") > F.coalesce("n", F.lit(0))).alias("past_end"))


@query("case_slice", f"WITH {_TRUTH} SELECT path, line_no FROM doclines SEMI JOIN (SELECT path FROM t WHERE NOT is_decoy) x USING (path)")
def case_slice(spark, d):
    return doclines(spark, d).join(truth(spark, d).where("not is_decoy").select("path"), "path", "left_semi").select("path", "line_no")


@query("attribute_unique", f"""
WITH a AS ({_ASKED}), p AS (SELECT DISTINCT path FROM loglines), j AS (SELECT asked, path FROM a JOIN p ON path = asked OR ends_with(path, '/' || asked))
SELECT asked, min(path) AS path FROM j GROUP BY asked HAVING count(*) = 1""")
def attribute_unique(spark, d):
    r = resolve_paths(spark, d)
    return r.where("state = 'ok'").select("asked", "path")


@query("coverage_audit", """
WITH n AS (SELECT path, host, event_type, count(*) AS n, event_type = 'signup' AS bin FROM loglines GROUP BY ALL),
c AS (SELECT path AS asked, CASE host WHEN 'h0' THEN 'empty' WHEN 'h1' THEN 'binary' ELSE 'text' END AS state, CASE WHEN event_type = 'error' THEN 'h3/logs/error.log' ELSE path END AS cited FROM n WHERE event_type <> 'view'
  UNION ALL SELECT path, 'text', path FROM n WHERE host = 'h2' AND event_type = 'click' UNION ALL SELECT 'x.log', 'text', NULL UNION ALL SELECT 'click.log', 'text', NULL),
j AS (SELECT asked, state, cited, n.path, n, bin, asked = 'click.log' AS amb, count(*) OVER (PARTITION BY asked) AS times FROM c LEFT JOIN n ON n.path = asked)
SELECT asked, state, concat_ws(',', CASE WHEN amb THEN 'ambiguous' WHEN path IS NULL THEN 'missing' END, CASE WHEN times > 1 THEN 'duplicate' END, CASE WHEN state = 'empty' AND n > 0 THEN 'false-empty' END, CASE WHEN state = 'binary' AND NOT bin THEN 'false-binary' END, CASE WHEN cited <> path THEN 'foreign-file' END) AS flags FROM j""")
def coverage_audit(spark, d):
    """Declared files against the inventory: hosts declared empty or binary, files declared twice, by a bare name or not there, citations from elsewhere."""
    n = loglines(spark, d).groupBy("path", "host", "event_type").agg(F.count("*").alias("n")).withColumn("binary", F.col("event_type") == "signup")
    state = F.when(F.col("host") == "h0", "empty").when(F.col("host") == "h1", "binary").otherwise("text")
    cited = F.when(F.col("event_type") == "error", "h3/logs/error.log").otherwise(F.col("path"))
    c = n.where("event_type <> 'view'").select(F.col("path").alias("asked"), state.alias("state"), cited.alias("cited"))
    c = c.unionByName(n.where("host = 'h2' and event_type = 'click'").select(F.col("path").alias("asked"), F.lit("text").alias("state"), F.col("path").alias("cited")))
    c = c.unionByName(spark.createDataFrame([("x.log", "text", None), ("click.log", "text", None)], "asked string, state string, cited string"))
    return J.coverage_audit(c, n.select("path", "n", "binary"))


@query("channel_scores", _CLAIMS + """
SELECT source AS channel, count(*) AS citations, count(*) FILTER (verdict = 'ok') AS ok, count(*) FILTER (verdict NOT IN ('ok', 'unverifiable')) AS bad FROM v JOIN documents ON doc_id = claim_id GROUP BY ROLLUP (source)""")
def channel_scores(spark, d):
    """Verdicts of each channel's claims beside those of all; a claim's channel is its document's source."""
    v = claim_verdicts(spark, d).join(table(spark, d, "documents").select(F.col("doc_id").alias("claim_id"), F.col("source").alias("channel")), "claim_id")
    return v.rollup("channel").agg(F.count("*").alias("citations"), F.count_if(F.col("verdict") == "ok").alias("ok"), F.count_if(~F.col("verdict").isin("ok", "unverifiable")).alias("bad"))


_CANDIDATES = f"SELECT path, template, CASE WHEN event_type = 'signup' THEN 'state' ELSE 'stream' END AS kind, min(line_no) AS line_no, count(*) AS rank FROM (SELECT *, {SQL_TEMPLATE} || k AS template FROM loglines) GROUP BY path, template, event_type HAVING count(*) <= 12"


def worklist(spark, d, budget=60):
    lines = loglines(spark, d).withColumn("template", F.concat(M.template(F.col("text")), F.col("k")))
    c = A.template_counts(lines)
    kind = F.when(F.col("path").contains("signup"), "state").otherwise("stream")
    return J.fair_worklist(c.where("n <= 12").select("path", kind.alias("kind"), F.col("first_line").alias("line_no"), F.col("n").alias("rank")), budget)


@query("fair_worklist", f"""
WITH c AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, line_no) AS round FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round, path) AS pos FROM r WHERE kind = 'stream' OR round <= 3),
k AS (SELECT * FROM a WHERE kind = 'stream' AND pos <= 54 UNION ALL SELECT * FROM a WHERE kind = 'state' AND pos <= 60 - (SELECT count(*) FROM a WHERE kind = 'stream' AND pos <= 54))
SELECT path, line_no, round, row_number() OVER (ORDER BY round, path) AS place FROM k""")
def fair_worklist(spark, d):
    return worklist(spark, d)


@query("assign_ids", f"""
WITH c AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, line_no) AS round FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round, path) AS pos FROM r WHERE kind = 'stream' OR round <= 3),
k AS (SELECT * FROM a WHERE kind = 'stream' AND pos <= 54 UNION ALL SELECT * FROM a WHERE kind = 'state' AND pos <= 60 - (SELECT count(*) FROM a WHERE kind = 'stream' AND pos <= 54))
SELECT path, line_no, 'g' || lpad(CAST(row_number() OVER (ORDER BY round, path) AS VARCHAR), 3, '0') AS id FROM k""")
def assign_ids(spark, d):
    return worklist(spark, d).select("path", "line_no", F.format_string("g%03d", "place").alias("id"))


@query("truncation", f"""
WITH c AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, line_no) AS round FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round, path) AS pos FROM r WHERE kind = 'stream' OR round <= 3),
k AS (SELECT path, line_no FROM a WHERE kind = 'stream' AND pos <= 54 UNION ALL SELECT path, line_no FROM a WHERE kind = 'state' AND pos <= 60 - (SELECT count(*) FROM a WHERE kind = 'stream' AND pos <= 54))
SELECT path, count(*) AS groups, count(*) - count(k.line_no) AS dropped FROM c LEFT JOIN k USING (path, line_no) GROUP BY path""")
def truncation(spark, d):
    lines = loglines(spark, d).withColumn("template", F.concat(M.template(F.col("text")), F.col("k")))
    c = A.template_counts(lines).where("n <= 12").select("path", F.col("first_line").alias("line_no"))
    shown = worklist(spark, d).select("path", "line_no", F.lit(1).alias("s"))
    return c.join(shown, ["path", "line_no"], "left").groupBy("path").agg(F.count("*").alias("groups"), (F.count("*") - F.count("s")).alias("dropped"))


@query("worklist_sink", f"""
WITH c AS ({_CANDIDATES}), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, line_no) AS round FROM c),
a AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY round, path) AS pos FROM r WHERE kind = 'stream' OR round <= 3),
k AS (SELECT * FROM a WHERE kind = 'stream' AND pos <= 54 UNION ALL SELECT * FROM a WHERE kind = 'state' AND pos <= 60 - (SELECT count(*) FROM a WHERE kind = 'stream' AND pos <= 54))
SELECT path, line_no, round, row_number() OVER (ORDER BY round, path) AS place, string_split(path, '/')[1] AS host FROM k""")
def worklist_sink(spark, d):
    """Writes the worklist as tab-separated files by host and reads it back."""
    path = work_path(spark, "worklist")
    write_worklist(worklist(spark, d).withColumn("host", F.substring_index("path", "/", 1)), path)
    got = read_table(spark, path, schema="path string, line_no long, round long, place long")  # none is written for no rows
    return got.select("path", "line_no", "round", "place", F.substring_index("path", "/", 1).alias("host"))


@query("tempo_sink", _RATE + " SELECT path, grp, n0, n1, CAST(ratio AS DOUBLE) AS ratio, CASE WHEN moved THEN 'rate' ELSE 'background' END AS kind FROM r")
def tempo_sink(spark, d):
    """Writes the tempo table, what moved beside what didn't, as tab-separated text and reads it back."""
    r = rates(spark, d)
    write_table(r.select("path", "grp", "n0", "n1", "ratio", F.when(F.col("moved"), "rate").otherwise("background").alias("kind")), path := work_path(spark, "tempo"))
    got = read_table(spark, path)
    return got.select("path", "grp", F.col("n0").cast("long").alias("n0"), F.col("n1").cast("long").alias("n1"), F.col("ratio").cast("double").alias("ratio"), "kind")


@query("diversity_cap", """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS row, l_suppkey AS file, l_linenumber AS slot, CAST(floor(l_extendedprice) AS BIGINT) AS strength FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY file, slot ORDER BY strength DESC, row) AS a FROM l), b AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY strength DESC, row) AS b FROM a WHERE a <= 2)
SELECT row, file, slot, strength FROM b WHERE b <= 6""")
def diversity_cap(spark, d):
    l = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"), F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("slot"), F.floor("l_extendedprice").cast("long").alias("strength"))  # noqa: E741
    return J.diversity_cap(l, "file", "slot", "strength", "row")


@query("rep_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY event_id) AS rep FROM ev")
def rep_index(spark, d):
    return events(spark, d).select("event_id", F.row_number().over(W.partitionBy(F.col("user_id") % 3, "event_type").orderBy("event_id")).cast("long").alias("rep"))


@query("latest_row", "SELECT user_id, max(event_id) AS event_id, arg_max(ms, event_id) AS ms FROM ev GROUP BY user_id")
def latest_row(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("ms", "event_id").alias("ms"))


@query("receipt_sample", """
WITH e AS (SELECT event_type, host, event_id, k < 2 AS pref, sha256(event_type || '|' || event_id) AS key FROM ev),
t AS (SELECT *, row_number() OVER (PARTITION BY event_type, host ORDER BY pref DESC, key) AS turn, count(*) OVER (PARTITION BY event_type) AS n FROM e),
f AS (SELECT event_type, count(DISTINCT host) FILTER (pref) AS files FROM e GROUP BY event_type),
a AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY pref DESC, turn, key) AS pos FROM t)
SELECT event_type, event_id FROM a JOIN f USING (event_type) WHERE pos <= least(n, greatest(3, ceil(sqrt(n)), files))""")
def receipt_sample(spark, d):
    return J.receipt_sample(events(spark, d), "event_type", "host", "event_id", F.col("k") < 2)


_RECEIPTS = """
WITH c AS (SELECT event_id AS row, 'R' || (event_id % 4) AS rule, host || ':' || k AS ref FROM ev),
g AS (SELECT event_id AS row, 'R' || (event_id % 5) AS rule, CASE WHEN event_id % 30 = 0 THEN 'nowhere:1' ELSE host || ':' || k END AS ref, 'q' || ms AS quote, CASE WHEN event_id % 42 = 0 THEN 'candidate' ELSE 'rule' END AS decision FROM ev WHERE event_id % 6 = 0),
r AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE row % 24 = 0 UNION ALL SELECT row, rule, ref, quote || '!', decision FROM g WHERE row % 36 = 0 UNION ALL SELECT row + 1000000000, rule, ref, quote, decision FROM g WHERE row % 66 = 0)"""


@query("receipt_audit", _RECEIPTS + """
SELECT rule, row, 'missing' AS kind, count(*) AS n FROM c WHERE row % 3 = 0 AND NOT EXISTS (SELECT 1 FROM r WHERE r.rule = c.rule AND r.row = c.row AND decision = 'rule') GROUP BY ALL
UNION ALL SELECT rule, row, CASE WHEN count(DISTINCT (ref, quote, decision)) = 1 THEN 'duplicate-identical' ELSE 'duplicate-conflicting' END, 1 FROM r GROUP BY rule, row HAVING count(*) > 1
UNION ALL SELECT rule, row, 'candidate', count(*) FROM r WHERE decision = 'candidate' GROUP BY ALL
UNION ALL SELECT rule, row, CASE WHEN rule = 'R4' THEN 'unknown-rule' WHEN row >= 1000000000 THEN 'unknown-row' ELSE 'row-not-covered' END, count(*) FROM r WHERE rule = 'R4' OR row >= 1000000000 OR row % 4 <> CAST(rule[2:] AS BIGINT) GROUP BY ALL
UNION ALL SELECT rule, r.row, 'wrong-address', count(*) FROM r JOIN (SELECT row, ref AS own FROM c) o ON o.row = r.row WHERE ref <> own GROUP BY ALL""")
def receipt_audit(spark, d):
    """Rules that cover every fourth row; receipts for some, doubled, in doubt, misaddressed, of rules and rows that aren't there."""
    e, row = events(spark, d), F.col("event_id").alias("row")
    ref = F.concat("host", F.lit(":"), "k")
    covered = e.select(row, F.concat(F.lit("R"), F.col("event_id") % 4).alias("rule"), ref.alias("own"))
    got = e.where("event_id % 6 = 0").select(row, F.concat(F.lit("R"), F.col("event_id") % 5).alias("rule"), F.when(F.col("event_id") % 30 == 0, "nowhere:1").otherwise(ref).alias("ref"), F.concat(F.lit("q"), "ms").alias("quote"), F.when(F.col("event_id") % 42 == 0, "candidate").otherwise("rule").alias("decision"))
    more = got.where("row % 36 = 0").withColumn("quote", F.concat("quote", F.lit("!")))
    lost = got.where("row % 66 = 0").withColumn("row", F.col("row") + 1_000_000_000)
    receipts = got.unionByName(got.where("row % 24 = 0")).unionByName(more).unionByName(lost)
    return J.receipt_audit(covered.select("rule", "row"), covered.where("row % 3 = 0").select("rule", "row"), receipts, covered.select("row", "own"), ["R0", "R1", "R2", "R3"])


@query("top_rare_shapes", f"""
WITH c AS (SELECT path, {SQL_TEMPLATE} || level AS shape, count(*) AS n FROM loglines GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, shape) AS t FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n, shape) AS r FROM t WHERE t > 1)
SELECT path, shape, n, 'top' AS kind FROM t WHERE t <= 1 UNION ALL SELECT path, shape, n, 'rare' FROM r WHERE r <= 1""")
def top_rare_shapes(spark, d):
    c = loglines(spark, d).groupBy("path", F.concat(M.template(F.col("text")), "level").alias("shape")).agg(F.count("*").alias("n"))
    return G.top_and_rare(c, ["path"], "shape", 1, 1)


_KLASS = ("T", "C", "P", "S", "B", "O", "V", "F")


@query("priority_cut", """
WITH e AS (SELECT event_id, host, CASE WHEN status >= 500 THEN 'T' WHEN status = 404 THEN 'C' WHEN ms > 480 THEN 'P' WHEN k > 97 THEN 'S' WHEN k = 42 THEN 'B' WHEN k = 50 THEN 'O' WHEN ms < 10 THEN 'V' ELSE 'F' END AS klass FROM ev),
w AS (SELECT *, row_number() OVER (PARTITION BY host, klass ORDER BY event_id) AS w, strpos('TCPSBOVF', klass) AS p FROM e),
n AS (SELECT event_id, row_number() OVER (ORDER BY p, host, event_id) AS place FROM w WHERE klass <> 'F' OR w <= 6)
SELECT event_id, place, (SELECT count(*) FROM ev) - (SELECT count(*) FROM n WHERE place <= 250) AS dropped FROM n WHERE place <= 250""")
def priority_cut(spark, d):
    klass = F.when(F.col("status") >= 500, "T").when(F.col("status") == 404, "C").when(F.col("ms") > 480, "P").when(F.col("k") > 97, "S").when(F.col("k") == 42, "B").when(F.col("k") == 50, "O").when(F.col("ms") < 10, "V").otherwise("F")
    return J.priority_cut(events(spark, d).withColumn("klass", klass), "host", "klass", "event_id", list(_KLASS), "F")


@query("byte_budget", """
WITH b AS (SELECT doc_id AS id, doc_id % 50 = 0 AS earned, doc_id % 4 AS klass, n_chars AS cost FROM documents), e AS (SELECT coalesce(sum(cost), 0) AS s FROM b WHERE earned),
r AS (SELECT *, sum(cost) OVER (PARTITION BY klass ORDER BY cost, id ROWS UNBOUNDED PRECEDING) AS upto FROM b WHERE NOT earned),
k0 AS (SELECT 200000 - s AS l FROM e), u0 AS (SELECT coalesce(max(upto), 0) AS u FROM r WHERE klass = 0 AND upto <= (SELECT l FROM k0)),
k1 AS (SELECT l - u AS l FROM k0, u0), u1 AS (SELECT coalesce(max(upto), 0) AS u FROM r WHERE klass = 1 AND upto <= (SELECT l FROM k1)),
k2 AS (SELECT l - u AS l FROM k1, u1), u2 AS (SELECT coalesce(max(upto), 0) AS u FROM r WHERE klass = 2 AND upto <= (SELECT l FROM k2)),
k3 AS (SELECT l - u AS l FROM k2, u2)
SELECT id FROM b WHERE earned UNION ALL SELECT id FROM r WHERE upto <= CASE klass WHEN 0 THEN (SELECT l FROM k0) WHEN 1 THEN (SELECT l FROM k1) WHEN 2 THEN (SELECT l FROM k2) ELSE (SELECT l FROM k3) END""")
def byte_budget(spark, d):
    b = table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 50 == 0).alias("earned"), (F.col("doc_id") % 4).alias("klass"), F.col("n_chars").alias("cost"))
    return J.byte_budget(b, 200000)


@query("stride_sample", "SELECT l.path, l.line_no FROM loglines l JOIN (SELECT path, max(line_no) AS n FROM loglines GROUP BY path) z USING (path) WHERE ceil(n / 20) <= 1 OR line_no % CAST(ceil(n / 20) AS BIGINT) = 0 OR line_no <= 3 OR line_no > n - 3")
def stride_sample(spark, d):
    return J.stride_sample(loglines(spark, d), 20, 3).select("path", "line_no")


@query("example_per_reason", "SELECT level, arg_min(path || ':' || line_no, (ms, event_id)) AS example FROM loglines GROUP BY level")
def example_per_reason(spark, d):
    return loglines(spark, d).groupBy("level").agg(F.min_by(F.concat("path", F.lit(":"), "line_no"), F.struct("ms", "event_id")).alias("example"))


@query("merge_axes", _FLOOR + " SELECT path, line_no, why FROM o")
def merge_axes(spark, d):
    return A.axis_floor(loglines(spark, d).select("path", "line_no", F.col("k").alias("value"), F.hour("ts").alias("hour")), most=1000)


_BLOCKS = r"SELECT doc_id, trim(lower(regexp_replace(b, '\s+', ' ', 'g'))) AS block FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS b FROM documents) WHERE trim(b) <> ''"


def blocks(spark, d, keep):
    return table(spark, d, "documents").where(keep).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("b")).where(F.trim("b") != "").select("doc_id", X.normalised(F.col("b")).alias("block"))


@query("block_union", f"WITH b AS ({_BLOCKS}) SELECT block, count(*) AS n FROM (SELECT block FROM b WHERE doc_id % 2 = 0 UNION ALL SELECT block FROM b ANTI JOIN (SELECT DISTINCT block FROM b WHERE doc_id % 2 = 0) x USING (block) WHERE doc_id % 2 = 1) GROUP BY block")
def block_union(spark, d):
    a, b = blocks(spark, d, "doc_id % 2 = 0").select("block"), blocks(spark, d, "doc_id % 2 = 1").select("block")
    return a.unionByName(b.join(a.distinct(), "block", "left_anti")).groupBy("block").agg(F.count("*").alias("n"))


@query("block_overlap", f"""WITH b AS ({_BLOCKS}), x AS (SELECT block, bool_or(doc_id % 2 = 0) AS a, bool_or(doc_id % 2 = 1) AS b FROM b GROUP BY block)
SELECT count(*) FILTER (a AND b) AS shared, count(*) FILTER (a AND NOT b) AS only_left, count(*) FILTER (b AND NOT a) AS only_right, CASE WHEN count(*) FILTER (a AND b) = 0 THEN 'disjoint' WHEN count(*) FILTER (a AND NOT b) + count(*) FILTER (b AND NOT a) = 0 THEN 'same' ELSE 'overlap' END AS relation FROM x""")
def block_overlap(spark, d):
    x = blocks(spark, d, "true").groupBy("block").agg(F.bool_or(F.col("doc_id") % 2 == 0).alias("a"), F.bool_or(F.col("doc_id") % 2 == 1).alias("b"))
    n = x.agg(F.count_if(F.col("a") & F.col("b")).alias("shared"), F.count_if(F.col("a") & ~F.col("b")).alias("only_left"), F.count_if(F.col("b") & ~F.col("a")).alias("only_right"))
    return n.withColumn("relation", F.when(F.col("shared") == 0, "disjoint").when(F.col("only_left") + F.col("only_right") == 0, "same").otherwise("overlap"))


@query("channel", "WITH u AS (SELECT conv_id, sum(length(text)) FILTER (role = 'user') AS a, sum(length(text)) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN b IS NULL THEN 'user' WHEN a IS NULL THEN 'assistant' WHEN 2 * a < b THEN 'assistant' WHEN 2 * b < a THEN 'user' ELSE 'both' END AS channel FROM u")
def channel(spark, d):
    n = lambda r: F.sum(F.when(F.col("role") == r, F.length("text")))
    u = table(spark, d, "conversations").groupBy("conv_id").agg(n("user").alias("a"), n("assistant").alias("b"))
    a, b = F.col("a"), F.col("b")
    return u.select("conv_id", F.when(b.isNull(), "user").when(a.isNull() | (2 * a < b), "assistant").when(2 * b < a, "user").otherwise("both").alias("channel"))


@query("rejected_signatures", r"""
WITH p AS (SELECT doc_id, substr(sha256(trim(lower(regexp_replace(text, '\s+', ' ', 'g')))), 1, 12) AS print FROM documents)
SELECT doc_id, print IN (SELECT print FROM p WHERE doc_id % 7 = 0) AS rejected FROM p""")
def rejected_signatures(spark, d):
    p = table(spark, d, "documents").select("doc_id", X.fingerprint(F.array("text")).alias("print"))
    bad = p.where("doc_id % 7 = 0").select("print").distinct().withColumn("r", F.lit(True))
    return p.join(bad, "print", "left").select("doc_id", F.coalesce("r", F.lit(False)).alias("rejected"))
