"""Secret scans, conversation repair and fill-in-the-middle against brute force, and their defined results for odd inputs."""

import hashlib
import random
import re
import string
from functools import cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlog.llm import conversation_repair as cr
from siftlog.llm import fill_middle as fm
from siftlog.llm import secret_scan as ss
from siftlog.llm.queries import ORACLE_SQL, QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- secrets


def planted(seed=5):
    """Prose with secrets of several encodings, and long runs of characters that are none."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(200)]
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    letters = string.ascii_letters + string.digits
    secrets = [draw(letters, 40) for _ in range(8)] + [draw("0123456789ABCDEF", 48) for _ in range(4)] + [draw(letters + "+/", 64) for _ in range(6)]
    innocent = [string.ascii_uppercase + string.digits, "anotherVeryLongIdentifierNameOfSomething", "".join(words[:9])[:60], "4952935900253052", "path/to/some/other/folder_with_names", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"]
    rows = []
    for i in range(120):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            text.insert(rng.randrange(len(text) + 1), rng.choice(secrets if i % 3 == 0 else innocent))
        if i % 7 == 0:
            text.append(rng.choice(["password=hunter22", "Token: 'abc'", 'api_key = "' + draw(letters, 30) + '"', "AKIA" + draw(string.ascii_uppercase + string.digits, 16), "ſecret=abcdefgh", "token:token:abcdefgh", "id " + draw("0123456789abcdef", 32)]))
        rows.append((i, " ".join(text) if i % 2 else "é\n".join(text)))
    return rows, secrets, innocent


def spans_by_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    found = con.execute(ORACLE_SQL["op11_secret_scan"])
    at = [c[0] for c in found.description]
    return {r[at.index("doc_id")]: r[at.index("spans")] for r in found.fetchall()}


def test_secrets_equal_their_definition(spark):
    rows, secrets, innocent = planted()
    got = {r.doc_id: r.listed for r in ss.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", ss.listed(F.col("spans")).alias("listed")).collect()}
    assert got == spans_by_sql(rows)
    found = {t[int(a) : int(b)] for i, t in rows for kind, a, b in (x.split(":") for x in got[i].split(",") if x) if kind == "random"}
    assert found
    assert not found & set(innocent)
    there = {s for s in secrets if any(s in t for _, t in rows)}
    assert len(found & there) >= 0.9 * len(there)


def test_base_spans_follow_the_patterns(spark):
    rng = random.Random(2)
    parts = ["token", "TOKEN", "pass", "password", "word", "=", ":", " ", '"', "'", "abc", "0123456789ab", "cdefabcdefab", "AKIA", "ZZZZ0000", "AAAAAAAAAAAAAAAA", "api_key", "apikey", "é", "😀", "\n", ".-_", "secret"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(400)]
    patterns = [re.compile(ss.ASSIGN[4:], re.I | re.A), re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")]
    good = [lambda m: len(m.group(2)) >= 6, lambda m: len(m.group()) >= 20, lambda m: len(m.group()) >= 24]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.array_sort(ss.base_spans(F.col("text"))).alias("b")).collect()
    for r in got:
        t = dict(rows)[r.doc_id]
        assert [tuple(x) for x in r.b] == sorted((m.start(), k, m.end()) for k, p in enumerate(patterns) for m in p.finditer(t) if good[k](m)), t


def test_many_matches_in_one_text(spark):
    text = "x ".join(f"token=secret{i}" for i in range(3000))
    (row,) = ss.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s["start"], s["end"]) for s in row.spans if s["kind"] == 0] == [m.span() for m in re.finditer(r"token=secret\d+x?", text)]


def test_secret_query_counts_each_kind(spark, tmp_path):
    rows, _, _ = planted()
    some_hex, access = "0123456789abcdef" * 2, "AKIA" + "ABCD1234" * 2
    mixed = [
        f"token=abcdefgh {some_hex} {access}", f"{access} {some_hex} {some_hex} secret=abcdefgh", f"password: {some_hex}", f"token={some_hex} api_key={some_hex}",
        f"{some_hex} {some_hex} {some_hex}", f"{access} {access}", "token=abcdefgh " * 5, None, "",
    ]
    rows += [(1000 + i, t) for i, t in enumerate(mixed)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    df = QUERIES["op11_secret_scan"](spark, str(tmp_path))
    got = {r.doc_id: tuple(r) for r in df.collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == {r[0]: r for r in con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL['op11_secret_scan']})").fetchall()}
    counts = {i: got[1000 + i][df.columns.index("n_assign") : df.columns.index("n_hex") + 1] for i in range(len(mixed))}
    assert counts == {0: (1, 1, 1), 1: (1, 1, 2), 2: (1, 0, 1), 3: (2, 0, 2), 4: (0, 0, 3), 5: (0, 2, 0), 6: (5, 0, 0), 7: (0, 0, 0), 8: (0, 0, 0)}


def test_secrets_of_odd_documents(spark, odd_docs, no_docs):
    assert ss.scan_secrets(odd_docs).count() == odd_docs.count()
    assert all(not r.spans for r in ss.scan_secrets(odd_docs).collect())
    assert ss.scan_secrets(no_docs).count() == 0


# -- conversations


def brute_repair(rows):
    """rows: (turn, role, text) in order. The least (cost, audit) by trying every edit, two inserts in a row at most."""
    seen, marks = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        marks.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {0: "ua", 1: "u", 2: "a", 3: "u"}

    @cache
    def best(i, state, inserts):
        out = []
        if i == len(rows) and state in (0, 3):
            out.append((0, "", ()))
        if inserts < 2:
            role = "a" if state == 2 else "u"
            c, a, r = best(i, 2 if role == "u" else 3, inserts + 1)
            out.append((c + 3, "I" + a, ({"u": "user:", "a": "assistant:"}[role], *r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, state, 0)
            out.append((c + 4, "D" + a, r))
            if marks[i] not in ("blank", "duplicate"):
                extra = 3 if marks[i] == "truncated" else 0
                to = 1 if role[:1] == "s" and state == 0 else 2 if role[:1] == "u" and state != 2 else 3 if role[:1] == "a" and state == 2 else None
                if to:
                    c, a, r = best(i + 1, to, 0)
                    out.append((c + extra, "K" + a, (f"{role}:{text}", *r)))
                name, to = ("assistant", 3) if state == 2 else ("user", 2)
                assert name[0] in after[state]
                c, a, r = best(i + 1, to, 0)
                out.append((c + 3 + extra, "R" + a, (f"{name}:{text}", *r)))
        return min(out, default=(10**9, "", ()))

    cost, audit, lines = best(0, 0, 0)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": marks.count("blank"), "duplicate": marks.count("duplicate"), "truncated": marks.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit, "repaired_sha256": sha("\n".join(lines)),
    }


def random_conversations(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        for _ in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant", "u", "annotator"])
            rows.append((c if c else None, rng.choice([None, *range(8)]), role, rng.choice(["Yes.", "No!", "So what", "Why? \n", "", " \t", None, "é…", f"{rng.randrange(99)}."])))
    return rows


def in_order(rows):
    by: dict = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, own in by.items()}


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_repairs_are_the_cheapest(spark, block_rows):
    rows = random_conversations(1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("x")).withColumn("part", F.lit("y"))
    found = cr.repair(df, block_rows=block_rows)
    want = {c: brute_repair(own) for c, own in in_order(rows).items()}
    got = {r.conv_id: {k: r[k] for k in want[r.conv_id]} for r in found.verdicts.collect()}
    assert got == want
    turns: dict = {}
    for r in sorted(found.turns.collect(), key=lambda r: r.place):
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(turns.get(c, []))) for c in want} == {c: x["repaired_sha256"] for c, x in want.items()}


def test_a_long_conversation_spans_blocks_and_copies_stand_aside(spark):
    rows = [(7, i // 2, ("user", "assistant", "user")[i % 3], f"said {i % 40}.") for i in range(900)] + [(7, 3, "user", "again")] * 500 + [(8, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in cr.repair(df, block_rows=64).verdicts.collect()}
    ordered = in_order(rows)
    # The brute force recurses a row at a time, so it gets the rows without most copies: each takes a D and nothing else.
    few = [r for i, r in enumerate(ordered[7]) if r[2] != "again" or ordered[7][i - 1] != r]
    want = brute_repair(few[:120])
    assert {r.conv_id: r.cost for r in cr.repair(spark.createDataFrame([(7, *r) for r in few[:120]], df.schema), block_rows=64).verdicts.collect()} == {7: want["cost"]}
    assert got[7].duplicate >= 499
    assert len(got[7].audit.replace("I", "")) == 1400
    assert got[8].audit == "KI"


def test_grammar_keeps_costs_and_audits(spark):
    rng = random.Random(4)
    strings = ["".join(rng.choice("xsuaoSUAO") for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    rules = cr.learn_rules(spark.createDataFrame([(s,) for s in strings * 2], "seq string"), rounds=6, pairs=20)
    assert len(rules) > 40
    plain, packed = cr.Grammar([]), cr.Grammar(rules)
    assert sum(len(packed.packed(s)) for s in strings) < 0.7 * sum(map(len, strings))
    for s in strings:
        a, b = plain.of(s), packed.of(s)
        assert a.cost == b.cost
        assert a.rank == b.rank
        assert all(a.audit(*e) == b.audit(*e) for e in a.cost)


def test_repair_of_no_rows_and_damage(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.repair(none).verdicts.count() == 0
    assert cr.damaged(none).count() == 0
    import zlib

    rows = [(i, t, "assistant", "One. Two!") for i in range(40) for t in (None, 0, 1)] + [(None, 5, None, None)]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    got = [tuple(r) for r in cr.damaged(spark.createDataFrame(rows, none.schema)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


# -- fill in the middle


def brute_middle(doc_id, text, seed=42, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digits = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def middles(spark, seed=9):
    rng = random.Random(seed)
    parts = ["a", "word", "é", "日本", "😀", " ", "  ", "\n", "\t ", "<P>", "<S", "M>", "x" * 50, "\x85", " "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 60)))) for i in range(300)] + [(1000 + i, " ".join("y" * rng.randrange(1, 9) for _ in range(20_000))) for i in range(3)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("error", [1, 64, 126])
def test_middles_equal_brute_force(spark, error):
    rows, df = middles(spark)
    for r in fm.fill_in_middle(df, rate=90, error=error).withColumn("back", fm.restored(F.col("output"), F.col("form"))).collect():
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_middle(r.doc_id, dict(rows)[r.doc_id], rate=90)
        assert r.back == dict(rows)[r.doc_id]


def test_a_stored_index_serves_other_seeds(spark):
    rows, df = middles(spark)
    indexed = fm.with_rank_index(df.withColumn("n", F.lit(1)), error=20)
    assert indexed.columns == ["doc_id", "text", "n", "rank_index"]
    for seed in (1, 2):
        for r in fm.fill_in_middle(indexed, seed=seed, rate=100, index_col="rank_index").collect():
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_middle(r.doc_id, dict(rows)[r.doc_id], seed, 100)


def test_lines_stay_within_their_error_and_are_few(spark):
    rng = np.random.default_rng(3)
    ends = np.cumsum(rng.integers(2, 10, 50_000))
    for error in (1, 16, 100):
        index = fm.fit_rank_index(ends, error)
        assert np.abs(index.residuals.astype(int)).max() <= error + 1
        assert [index.cut(r) for r in (0, 1, 777, 50_000)] == [0, ends[0], ends[776], ends[-1]]
    assert len(index.ranks) < 500
    assert len(fm.fit_rank_index(np.zeros(0, np.int64), 5).residuals) == 1
    with pytest.raises(ValueError, match="error"):
        fm.fill_in_middle(spark.createDataFrame([(1, "a")], "doc_id long, text string"), error=400)


def test_middles_of_odd_documents(spark, odd_docs, no_docs):
    got = fm.fill_in_middle(odd_docs, rate=100).collect()
    want = [brute_middle(r.doc_id, r.text, rate=100) for r in odd_docs.collect()]
    assert sorted(map(str, ((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got))) == sorted(map(str, want))
    assert fm.fill_in_middle(no_docs).count() == 0
    assert fm.with_rank_index(no_docs).count() == 0


# -- mended operators


def test_a_model_of_many_languages_stays_small(spark):
    from siftlog.llm import langid

    rng = random.Random(8)
    rows = []
    for k in range(200):
        words = ["".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randrange(2, 9))) for _ in range(120)]
        rows += [(" ".join(rng.choice(words) for _ in range(200)), f"l{k:03d}") for _ in range(20)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.fit(df)
    assert model.nbytes < 100 << 20
    asked = df.withColumn("doc_id", F.monotonically_increasing_id())
    got = asked.join(langid.predict(asked, model), "doc_id").where("lang = lang_pred").count()
    assert got >= 0.99 * len(rows)
    # Where its bounds bite, it is smaller, and still tells most texts.
    small = langid.fit(df, most_bytes=1 << 20, most_entries=60_000)
    assert small.nbytes < 60_000 * 20
    assert asked.join(langid.predict(asked, small), "doc_id").where("lang = lang_pred").count() >= 0.9 * len(rows)


def test_hosts_are_joined_without_shuffling_documents(spark):
    from siftlog.llm import host_rules

    docs = spark.createDataFrame([(i, f"text {i} " * 30, f"s{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "4096")  # below the base table, above the hosts
    try:
        out = host_rules.host_rules(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        assert "SortMergeJoin" not in plan
        assert "hashpartitioning" not in plan
        assert out.count() == 300
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_items_of_one_template_are_one_class(spark):
    from siftlog.llm import decontaminate as d

    question = "Sam has {a} apples and then {b} more arrive before noon so how many apples does she hold after {a} minutes of waiting there"
    items = [(i, question.format(a=10 + i, b=500 + i)) for i in range(200)] + [(900, "a lone question of its own with seven windows and no slot")] + [(901, question.format(a=7, b=7))]
    rng = random.Random(5)
    docs = [(i, f"intro {i} text. " + question.format(a=10 + i % 200, b=500 + i % 200) + " outro") for i in range(150)]
    docs += [(1000 + i, question.format(a=rng.randrange(9000), b=rng.randrange(9000))) for i in range(50)] + [(2000, "nothing of the kind is here at all, not a word of it"), (2001, items[200][1])]
    bench, corpus = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    for limit in (1 << 20, 3):
        found, members = d.contamination_classes(corpus, bench, most_broadcast=limit)
        got = {(r.doc_id, r.item_id): r for r in found.collect()}
        classes = {r.item_id: r.class_id for r in members.collect()}
        assert {classes[i] for i in range(200)} == {0}
        assert (classes[900], classes[901]) == (900, 901)  # 901 has equal values in both slots: another pattern
        # A row for each document, not for each document and item.
        assert len([k for k in got if k[1] == 0]) == 200
        assert all(got[i, 0].exact and got[i, 0].n_items == 200 for i in range(150))
        assert not any(got[1000 + i, 0].exact for i in range(50) if not any(docs[150 + i][1] == t for _, t in items))
        assert got[2001, 900].exact
        assert not any(k[0] == 2000 for k in got)
    pairs = {(r.doc_id, classes[r.item_id]) for r in d.find_contamination(corpus, bench).collect()}
    assert pairs <= set(got)
    assert {k[0] for k in got} == {i for i, _ in docs} - {2000}


def test_classes_agree_with_pairs_on_random_items(spark):
    from siftlog.llm import decontaminate as d

    rng = random.Random(9)
    word = lambda: rng.choice(["red", "blue", "Anna", "Bob", "12", "13", "kg", "and", "went", "home", "paid"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 14)))) for i in range(40)]
    items += [(100 + i, t.replace("12", "55").replace("Anna", "Cleo")) for i, t in items[:20]]
    docs = [(i, " ".join(word() for _ in range(3)) + " " + rng.choice(items)[1].replace("13", rng.choice(["13", "99"])) + " " + word()) for i in range(80)] + [(500, ""), (501, None)]
    bench, corpus = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    found, members = d.contamination_classes(corpus, bench)
    classes = {r.item_id: r.class_id for r in members.collect()}
    got = {(r.doc_id, r.item_id): r.exact for r in found.collect()}
    pairs = [(r.doc_id, classes[r.item_id]) for r in d.find_contamination(corpus, bench).collect()]
    assert set(pairs) <= set(got)
    assert len(set(got) - set(pairs)) <= 0.05 * len(got)
    assert {k[0] for k, e in got.items() if e} <= {i for i, _ in docs}
