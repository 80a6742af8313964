"""The registered queries of this subpackage and their SQL, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.llm.conversation_repair import COUNTS, damaged, repair
from siftlog.llm.decontaminate import contamination_classes
from siftlog.llm.fill_middle import fill_in_middle, restored
from siftlog.llm.host_rules import host_rules
from siftlog.llm.jaccard_join import jaccard_classes
from siftlog.llm.langid import fit, predict
from siftlog.llm.mixing import mix_sources
from siftlog.llm.quality import fit_quality, score_quality
from siftlog.llm.secret_scan import ACCESS, CANDIDATE, ENCODINGS, HEX, KINDS, listed, scan_secrets
from siftlog.llm.shared import work_path
from siftlog.llm.suffix_dedup import remove_repeats
from siftlog.llm.token_counts import count_tokens
from siftlog.llm.token_orc import token_index, write_token_orc
from siftlog.llm.warc import dedup_captures, read_warc, write_warc

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(of))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs, fit(docs.where(_remainder(F.col("doc_id"), 5) != 0)))
    return out.select("doc_id", (_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of one language are counted first, as a corpus that came earlier; then all, of which those hit the cache."""
    docs, tokenizer, cache = table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), work_path(spark, "token-cache")
    earlier = docs.agg(F.min("lang")).first()[0]
    count_tokens(docs.where(F.col("lang").eqNullSafe(earlier)), tokenizer, cache)
    return count_tokens(docs, tokenizer, cache)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_classes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))[0]


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(_remainder(F.col("doc_id"), 4) != 2))
    return score_quality(docs, model).select("doc_id", (_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(table(spark, sf_dir, "documents")).drop("host", "host_rate")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_warc(dedup_captures(table(spark, sf_dir, "pages")), path := work_path(spark, "warc"))
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    write_token_orc(table(spark, sf_dir, "documents"), path := work_path(spark, "token-orc"), public_tokenizers.path(TOKENIZER))
    return token_index(spark, path)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < KINDS.index("random"))

    def number(kind: str) -> Column:
        # The kind is no default of the lambda: Spark would pass the place of each entry as a second argument.
        return F.size(F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(number, KINDS[:3]), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations that lost every row have zeros, no audit and the digest of nothing."""
    rows = table(spark, sf_dir, "conversations")
    found = repair(damaged(rows)).verdicts.withColumnRenamed("conv_id", "repaired_id").withColumn("found", F.lit(True))
    out = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    nothing = dict.fromkeys(COUNTS, F.lit(0)) | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return out.select("conv_id", *[F.when(F.col("found"), F.col(c)).otherwise(x).alias(c) for c, x in nothing.items()])


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    digests = {"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(back.cast("binary"), 256)}
    return out.withColumns(digests).drop("output")


QUERIES = {f.__name__: f for f in (op1_mix, op2_language, op3_token_counts, op4_suffix_dedup, op5_decontaminate, op6_quality, op7_jaccard, op8_host_rules, op9_warc, op10_token_orc, op11_secret_scan, op12_conversation_repair, op13_fill_middle)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"



def _secrets_sql() -> str:
    """Spans by pieces and matches, each test from its definition, and the step-up control of false finds."""
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    assign = rf"""({"|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    patterns = (assign, ACCESS, HEX, CANDIDATE)
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, string_split_regex(t, '{p}') AS pieces, regexp_extract_all(t, '{p}') AS tokens FROM d" for k, p in enumerate(patterns))
    tail = lambda z: f"exp(-pow({z}, 2) / 2) / ((0.661 * {z} + 0.339 * sqrt(pow({z}, 2) + 5.51)) * sqrt(2 * pi()))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
x AS (SELECT *, unnest(range(1, len(tokens) + 1)) AS i FROM m WHERE len(tokens) > 0),
s AS (
  SELECT doc_id, kind, tokens[i] AS token, length(array_to_string(pieces[1:i], '')) + length(array_to_string(tokens[1:i - 1], '')) AS start, start + length(tokens[i]) AS stop FROM x),
base AS (SELECT * FROM s WHERE kind IN (1, 2) OR kind = 0 AND length(regexp_extract(token, '{assign}', 2)) >= 6),
free AS (SELECT * FROM s WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = s.doc_id AND b.start < s.stop AND s.start < b.stop)),
enc(e, alphabet) AS (VALUES {", ".join(f"({e}, '{a}')" for e, a in enumerate(ENCODINGS))}),
c AS (SELECT e, alphabet, length(alphabet)::DOUBLE AS k, unnest(string_split(alphabet, '')) AS c FROM enc),
f AS (SELECT c, (SELECT sum(length(t) - length(replace(t, c, '')))::DOUBLE FROM d) AS n FROM (SELECT DISTINCT c FROM c)),
v AS (
  SELECT e, alphabet, k, f.c, f.n + CASE WHEN alphabet IN (lower(alphabet), upper(alphabet)) THEN coalesce(b.n, 0) ELSE 0 END AS n
  FROM c JOIN f USING (c) LEFT JOIN f b ON b.c <> f.c AND lower(b.c) = lower(f.c)),
g AS (SELECT e, alphabet, k, n / sum(n) OVER (PARTITION BY e) AS p FROM v),
o AS (
  SELECT e, alphabet, k, greatest(coalesce(sum(CASE WHEN isnan(p) THEN 0 ELSE p * p END), 0), 1 / k) AS two, greatest(coalesce(sum(CASE WHEN isnan(p) THEN 0 ELSE p * p * p END), 0), two * two) AS three
  FROM g GROUP BY e, alphabet, k),
t AS (SELECT token, min(e) AS e FROM (SELECT DISTINCT token FROM free) JOIN enc ON translate(token, alphabet, '') = '' GROUP BY token),
q AS (
  SELECT token, k, two, three, length(token)::DOUBLE AS n, translate(token, alphabet, repeat('0', (k / 2)::INT) || repeat('1', (k / 2)::INT)) AS h,
    list_sum(list_transform(string_split(alphabet, ''), lambda x: pow(length(token) - length(replace(token, x, '')), 2))) AS squares,
    list_transform(string_split(token, ''), lambda x: 2 * instr(alphabet, x) - 1 - k) AS y
  FROM t JOIN o USING (e)),
z AS (
  SELECT token, n * log2(k) AS bits,
    greatest(abs((k * squares / n - n - (k - 1)) / sqrt(2 * (k - 1) * (n - 1) / n)),
      abs(((length(h) - length(replace(h, '01', '')) + length(h) - length(replace(h, '10', ''))) / 2 - (n - 1) / 2) / sqrt((n - 1) / 4)),
      abs(list_sum(list_transform(range(1, len(y)), lambda i: y[i] * y[i + 1])) / ((k * k - 1) / 3) / sqrt(n - 1))) AS worst,
    (n * (n - 1) / 2 * two - (squares - n) / 2) / sqrt(n * (n - 1) / 2 * (two - two * two) + n * (n - 1) * (n - 2) * (three - two * two)) AS fewer
  FROM q),
p AS (
  SELECT token, bits, least(1, 6 * {tail("worst")}) AS battery, greatest(CASE WHEN fewer >= 0 THEN {tail("fewer")} ELSE 1 - {tail("abs(fewer)")} END, 1e-290) AS p FROM z),
w AS (SELECT *, least(greatest(floor(-16 * log2(p * (SELECT avg(bits) FROM p) / bits)), 0), 14400) AS step FROM p),
n AS (SELECT step, sum(count(*)) OVER (ORDER BY step DESC) AS so_far, sum(count(*)) OVER () AS total FROM w GROUP BY step),
l AS (SELECT min(step) AS least FROM n WHERE pow(2, -step / 16.0) * total <= 0.01 * so_far),
a AS (
  SELECT doc_id, kind, start, stop FROM base
  UNION ALL SELECT doc_id, kind, start, stop FROM free JOIN w USING (token) WHERE bits >= 64 AND battery >= 0.001 AND step >= (SELECT least FROM l)),
b AS (
  SELECT doc_id, kind, start, stop, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'random' END || ':' || start || ':' || stop AS span FROM a)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, kind, stop), '') AS spans
FROM d LEFT JOIN b ON b.doc_id = d.doc_id GROUP BY d.doc_id"""


def _repair_sql() -> str:
    """The shortest path over four states, a turn at a time; each state holds its least (cost, audit) and the repaired turns."""

    def way(v: str, cost: int | str, edit: str, line: str = "") -> str:
        new = f", 'r': list_append({v}.r, {line})" if line else f", 'r': {v}.r"
        return f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'a': {v}.a || '{edit}'{new}}} END"

    least = lambda *ways: f"list_min([{', '.join(ways)}])"
    user, assistant = "'user:'", "'assistant:'"
    keep = lambda v, initial: f"CASE WHEN i = '{initial}' AND NOT gone THEN {way(v, 'more', 'K', 'line')} END"
    rerole = lambda v, role: f"CASE WHEN NOT gone THEN {way(v, '3 + more', 'R', f'{role} || text')} END"
    w2 = least("v2", way("v0", 3, "I", user), way("v1", 3, "I", user), way("v3", 3, "I", user))
    return rf"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(key) + 1), lambda p: list_transform(range(0, 8), lambda b: (ascii(key[p]) >> b)::BIGINT & 1)))),
    lambda c, b: xor(c >> 1, xor(c & 1, b) * 3988292384)), 4294967295) % 20 AS kind FROM k),
d AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER c AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(left(role, 1)) OVER c AS before,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM d WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (
  SELECT *, left(role, 1) AS i, role || ':' || text AS line, t = '' AS blank, t <> '' AND nth > 1 AS duplicate, t <> '' AND nth = 1 AND NOT contains('.!?', right(t, 1)) AS truncated FROM o),
g AS (SELECT conv_id, p, i, line, text, blank OR duplicate AS gone, CASE WHEN truncated THEN 3 ELSE 0 END AS more FROM f),
s(conv_id, p, v0, v1, v2, v3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}}, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]), NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]), NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) FROM g
  UNION ALL
  SELECT conv_id, p, {way('v0', 4, 'D')}, {least(way('v1', 4, 'D'), keep('v0', 's'))},
    {least(way('w2', 4, 'D'), keep('v0', 'u'), keep('v1', 'u'), keep('w3', 'u'), rerole('v0', user), rerole('v1', user), rerole('w3', user))},
    {least(way('w3', 4, 'D'), keep('w2', 'a'), rerole('w2', assistant))}
  FROM (SELECT *, {least('v3', way('w2', 3, 'I', assistant))} AS w3
    FROM (SELECT g.*, v0, v1, v2, v3, {w2} AS w2 FROM s JOIN g ON s.conv_id IS NOT DISTINCT FROM g.conv_id AND g.p = s.p + 1))),
e AS (
  SELECT conv_id, {least('v0', 'v3', way('v2', 3, 'I', assistant), way(f"({way('v1', 3, 'I', user)})", 3, 'I', assistant))} AS best
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) AS back FROM s) WHERE back = 1),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM a.conv_id"""


ORACLE_SQL = {
    "op11_secret_scan": _secrets_sql(),
    "op12_conversation_repair": _repair_sql(),
    "op1_mix": f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5('mix|' || CAST(doc_id AS VARCHAR)), 1, 12)) AS BIGINT)::DOUBLE + 0.5) / 281474976710656.0)
      / greatest(0.05, 1 - 8 * (length(t) - length(translate(t, '#*$%&|<>', '')))::DOUBLE / greatest(length(t), 1)) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight, 3.0 * source_size AS most FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s)
      - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
a AS (
  SELECT source, source_size, least(most, weight * (SELECT max(level) FROM l WHERE level * weight <= most))::DOUBLE AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM a),
r AS (
  SELECT k.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto,
    sum(size) OVER (PARTITION BY k.source, key) AS same
  FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN whole < 3 AND 2 * upto - same <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
    "op7_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(v, u) AS (SELECT a, a FROM both_ways UNION SELECT reach.v, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.u),
c AS (SELECT v, min(u) AS u FROM reach GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.u, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.v = d.doc_id""",
    "op8_host_rules": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (
  SELECT doc_id, count(DISTINCT j) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM x) WHERE c > 1)
  GROUP BY doc_id),
b AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))
       - len(list_distinct(list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f GROUP BY source),
q AS (SELECT sum(k) / sum(n) AS m, var_samp(k / n) AS v FROM h),
z AS (SELECT m, CASE WHEN v > 0 THEN greatest(m * (1 - m) / v - 1, 1) ELSE 1 END AS s FROM q),
o AS (SELECT source, (k + (SELECT m * s FROM z)) / (n + (SELECT s FROM z)) AS rate FROM h)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM f JOIN o ON f.source IS NOT DISTINCT FROM o.source""",
    "op9_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f""",
    "op13_fill_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
r AS (
  SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
c AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
    array_to_string(u[greatest(a, b) + 1:], '') AS s
  FROM r)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c""",
}
