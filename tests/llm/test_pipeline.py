"""The pipeline's stages, one after another, on a small table."""

import os
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftlog.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert [f"op{i}_" for i in range(1, 14)] == [q.split("_")[0] + "_" for q in QUERIES]
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 5


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    leak = text(30)
    docs = [(i, text(80), "en", f"s{i % 3}", 0) for i in range(60)]
    docs += [(100, docs[0][1], "en", "s0", 0), (101, docs[1][1] + " tail", "en", "s1", 0), (102, text(20) + " " + leak + " " + text(20), "en", "s2", 0), (103, "12 34 %%", "en", "s0", 0), (104, None, "en", None, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        at = spark.read.parquet(f"{tmp_path}/{name}")
        left.append({r.doc_id for r in at.collect()})
    clean = set(range(60))
    assert left[0] == clean | {100, 101, 102}
    assert left[1] == clean | {102}
    assert left[2] == clean
    assert left[3] <= clean and left[3]
    last = corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).collect()
    assert len(last) == at.count()
    end = 0
    for r in sorted(last, key=lambda r: r.start):
        assert r.start == end
        end += r.n_tokens


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    plain = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert sorted(map(str, map(plain, df.collect()))) == sorted(map(str, map(plain, want)))


def test_copies_under_one_id_or_none_leave_one(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    a, b, c, d, e = (text(60) for _ in range(5))
    rows = [*[(7, a)] * 4, *[(None, b)] * 3, *[(None, c + " " + w) for w in ("x", "y")], (9, b), (7, d), (None, e), (3, e)]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/d")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_each_class(spark, spark.read.parquet(f"{tmp_path}/d"), "").collect()]
    near = [r for r in got if r[1].startswith(c)]
    assert len(near) == 1 and near[0][0] is None
    assert sorted(r for r in got if r not in near) == sorted([(7, a), (9, b), (7, d), (3, e)])


def through(spark, docs, folder, items):
    """Each stage over what the one before it wrote; what each left."""
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    at, left = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(folder))
        if name != "token_orc":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        at = spark.read.parquet(f"{folder}/{name}")
        left.append(at.collect())
    return left


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, empty and very long texts, repeated rows, columns that clash."""
    names = iter(["stage_row", "stage_other", "told_lang", "told_score", "bad_text", "row", "epochs", "reader", "mixed_key"])
    docs = odd_docs.select(*[F.col(c).alias(next(names, c)) if c in ("key", "digest", "chunk", "level", "n", "label", "interval", "words", "value") else F.col(c) for c in odd_docs.columns])
    assert next(names, None) is None
    lang, near, leak, mix, index = through(spark, docs, tmp_path, [(0, None), (1, "")])
    assert Counter(r.doc_id for r in lang) == Counter([1, 1, None, 6, 7, 8, 9])
    # Of four copies one stays, that with the least id.
    assert Counter(r.doc_id for r in near) == Counter([1, 6, 7, 9])
    assert Counter(r.doc_id for r in leak) == Counter([1, 6, 7, 9])
    assert {r.doc_id for r in mix} <= {1, 6, 7, 9} and all(1 <= n <= 3 for n in Counter(r.doc_id for r in mix).values())
    assert Counter(r.doc_id for r in index) == Counter(r.doc_id for r in mix)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((r.doc_id, r.n_tokens) for r in index) == sorted((r.doc_id, len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1) for r in mix)


def test_stages_on_an_empty_table(spark, no_docs, tmp_path):
    assert through(spark, no_docs, tmp_path, []) == [[]] * 5


def test_stages_of_rows_with_one_or_no_id(spark, tmp_path):
    rng = random.Random(14)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    leak, kept = text(25), [text(60) for _ in range(12)]
    rows = [(1, t) for t in kept[:6]] + [(None, t) for t in kept[6:]] + [(1, f"{text(9)} {leak} {text(9)}"), (None, f"{text(9)} {leak}")] + [(2, kept[0])] * 5
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lang, near, leak_free, mix, index = through(spark, docs, tmp_path, [(0, leak)])
    assert len(lang) == len(rows) and len(near) == 14
    assert sorted(r.text for r in leak_free) == sorted(kept)
    assert Counter(r.text for r in mix) == Counter(kept)  # a single source is taken once
    assert len(index) == 12


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Whole runs of the stages against plain Python: what each one keeps, and the ids in the files."""
    rng = random.Random(33)
    letters = {"en": "abcdefgh", "de": "lmnopqrsß"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(3, 7)))
    vocabulary = {lang: [word(lang) for _ in range(300)] for lang in letters}
    text = lambda lang, n: [rng.choice(vocabulary[lang]) for _ in range(n)]
    items = [text("en", 20), text("de", 12)]
    docs = []
    for i in range(90):
        lang = rng.choice([*letters])
        t = text(lang, rng.randrange(30, 90))
        if i % 9 == 1:
            t = list(rng.choice([x for _, x, _, _ in docs if x[0] != "12"]))
            t[rng.randrange(len(t))] = "changed"
        elif i % 9 == 2:
            t[10:10] = items[i % 2]
        elif i % 9 == 3:
            t = ["12", "%%"] * 9
        docs.append((i, t, lang, f"s{i % 4}"))
    table = spark.createDataFrame([(i, " ".join(t), lang, s, 0) for i, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = [sorted(r.doc_id for r in rows) for rows in through(spark, table, tmp_path, [(i, " ".join(t)) for i, t in enumerate(items)])]
    assert got[0] == (at := [i for i, t, _, _ in docs if t[0] != "12"])
    shingles = lambda t, n: {tuple(t[k : k + n]) for k in range(len(t) - n + 1)}
    sets = {i: shingles(docs[i][1], 5) for i in at}
    top = {i: i for i in at}
    for i in at:
        for j in at:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = {k: new if v == old else v for k, v in top.items()}
    assert got[1] == (at := [i for i in at if top[i] == i])
    assert got[2] == (at := [i for i in at if not any(len(shingles(x, 5) & sets[i]) >= 0.8 * len(shingles(x, 5)) for x in items)])
    sizes = Counter()
    for i in at:
        sizes[docs[i][3]] += len(docs[i][1])
    taken, total = Counter(), sum(sizes.values())
    for i in got[3]:
        taken[docs[i][3]] += len(docs[i][1])
    low, high = 0.0, 3.0 * total
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * (k % 3 + 1)) for k, s in enumerate(sorted(sizes))) < total else (low, mid)
    for k, s in enumerate(sorted(sizes)):
        assert abs(taken[s] - min(3 * sizes[s], high * (k % 3 + 1))) <= 90
    assert set(got[3]) <= set(at) and got[4] == got[3]
