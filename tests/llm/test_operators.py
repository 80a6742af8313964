"""Each operator against a brute-force version, and its defined results for odd inputs."""

import hashlib
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftlog.llm import decontaminate, host_rules, jaccard_join, langid, mixing, packed, quality, suffix_dedup, token_counts, token_orc, warc
from siftlog.llm.components import components
from siftlog.llm.queries import TOKENIZER
from siftlog.llm.shared import small_batches, work_path

PATH = public_tokenizers.path(TOKENIZER)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(spark, n=150, seed=3, vocabulary=60):
    """Random texts with copies, near copies, shared passages and repeats inside a text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 8))) for _ in range(vocabulary)]
    shared = " ".join(rng.choice(words) for _ in range(70))
    texts = []
    for _ in range(n):
        kind, t = rng.random(), [rng.choice(words) for _ in range(rng.randrange(0, 160))]
        if kind < 0.2 and texts:
            t = rng.choice(texts).split(" ")
        elif kind < 0.5 and texts:
            t = rng.choice(texts).split(" ")
            for _ in range(rng.randrange(1, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
        elif kind < 0.65:
            t[len(t) // 2 : len(t) // 2] = [shared]
        elif kind < 0.75:
            t = t * 2
        texts.append(" ".join(t))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), dict(enumerate(texts))


# -- 1


def brute_mix(rows):
    """rows: (source, size). The water level by bisection."""
    sizes = Counter()
    for s, n in rows:
        sizes[s] += n
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight, total = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values())
    low, high = 0.0, 3.0 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(3 * sizes[s], mid * weight[s]) for s in names) < total else (low, mid)
    return {s: min(3 * sizes[s], high * weight[s]) for s in names}


def test_mix(spark, odd_docs, no_docs):
    got = mixing.mix_sources(odd_docs).collect()
    assert len(got) == odd_docs.count()
    want = brute_mix([(r.source, r.size) for r in got])
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert sum(r.size for r in got if r.doc_id == 7) == 60_000
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(odd_docs.repartition(5)).collect()))
    assert mixing.mix_sources(no_docs).count() == 0
    assert mixing.mixed(no_docs).columns == no_docs.columns


def test_mix_comes_near_targets_and_takes_whole_epochs_first(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), f"s{min(i % 10, 3)}") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
        assert max(r.epochs for r in own) - min(r.epochs for r in own) <= 1


def test_mixed_repeats_documents(spark):
    docs = spark.createDataFrame([(i, "a b c", "big" if i else "small", i) for i in range(9)], "doc_id long, text string, source string, size int")
    want = {r.doc_id: r.epochs for r in mixing.mix_sources(docs).collect()}
    got = Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert {k: got[k] for k in want} == want


def test_mixed_takes_each_row_of_a_repeated_or_null_id_for_itself(spark):
    rows = [(5, "a b c", "s0")] * 20 + [(None, f"t{i} u", None) for i in range(20)] + [(i, "d e " * (i % 5), f"s{i % 3}") for i in range(100, 160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id, r.source, r.size] += r.epochs
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mixed(docs).collect())
    assert got == Counter({k: n for k, n in want.items() if n})


def test_mix_orders_small_intervals_even_of_one_poor_source(spark):
    docs = spark.range(200_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "#### $$$$ ####").otherwise("plain words of text here").alias("text"), F.when(F.col("id") % 50 == 0, "small").otherwise("hot").alias("source"))
    rows = mixing._keyed(docs, "doc_id", "text", "source", "mix", None)
    most = rows.where("source = 'hot'").groupBy("interval").count().agg(F.max("count")).first()[0]
    assert most <= 196_000 / 11_000 * 2.5
    got = mixing.mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("epochs").alias("m"), F.min("epochs").alias("n")).collect()
    assert all(abs(r.taken - r.target) <= 5 and r.m - r.n <= 1 for r in got) and len(got) == 2


def test_mixed_with_clashing_names_and_a_row_that_is_a_third_of_all(spark, no_docs):
    rows = [(1, "a b c", "s0", "x", 1, 2)] * 300 + [(i, "d e " * (i % 5), f"s{i % 3}", None, 3, 4) for i in range(10, 600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mixed_id string, mixed_epochs int, row int")
    want = Counter()
    for r in mixing.mix_sources(docs).collect():
        want[r.doc_id] += r.epochs
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == +want
    assert mixing.mixed(no_docs).count() == 0


# -- 2


def test_language(spark, odd_docs, no_docs):
    rng, alphabets = random.Random(2), {"xx": "abcde", "yy": "aklmn", "zz": "uvwxé"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(1, 9))) for _ in range(30)), lang) for i, lang in enumerate([*alphabets] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 120"))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows if i >= 120)
    odd = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(odd_docs, model).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (5, "und", 0.0)} <= odd
    assert langid.predict(no_docs, model).count() == 0
    nothing = langid.fit(no_docs)
    assert {r.lang_pred for r in langid.predict(odd_docs, nothing).collect()} == {"und"}


def scored(table):
    order = np.argsort(langid.hashes_of(list(table)))
    return langid.Scored(langid.hashes_of(list(table))[order], np.array(list(table.values()), float)[order])


def test_backoff_takes_the_longest_known_gram():
    grams = {3: {"<ab": [3, -3]}, 1: {"b": [-5, 5], "c": [1, -1], ">": [0, 0]}}
    model = langid.LanguageModel(["a", "b"], scored({"xyz": [9, -9]}), {k: scored(v) for k, v in grams.items()})
    totals = lambda text: model.totals(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0][0]
    # <ab, then nothing at a, then b, c and the end mark: (3 - 5 + 1 + 0) / 4
    assert totals("ABC")[0] == pytest.approx(-0.25)
    assert totals("abc 7 XYZ, abc")[0] == pytest.approx(9 - 0.5)  # the second time from what the task remembers


class BruteLanguages:
    """Counts, log frequencies and backoff word by word."""

    def __init__(self, rows, least=2, longest=5):
        self.languages, self.longest = sorted({lang for _, lang in rows if lang is not None}), longest
        words, grams = {}, {}
        for text, lang in set(rows):
            if lang is None:
                continue
            for w in self.words_of(text):
                words.setdefault(w, Counter())[lang] += 1
                m = f"<{w}>"
                for g in (m[i : i + n] for n in range(1, longest + 1) for i in range(len(m) - n + 1)):
                    grams.setdefault(g, Counter())[lang] += 1
        self.words, self.grams = (self.logs({k: c for k, c in t.items() if c.total() >= least}) for t in (words, grams))

    @staticmethod
    def words_of(text):
        return re.findall(r"[^\W\d_]+", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")))

    def logs(self, table):
        m = np.array([[c[x] for x in self.languages] for c in table.values()], float).reshape(len(table), len(self.languages))
        totals = [max(sum(c[x] for c in table.values()), 1) for x in self.languages]
        m = np.log(m * max(totals) / totals + 0.1)
        return dict(zip(table, m - m.mean(axis=1, keepdims=True), strict=True))

    def score(self, w):
        if w in self.words:
            return self.words[w]
        m, found = f"<{w}>", []
        for i in range(len(m)):
            found += [self.grams[m[i : i + n]] for n in range(min(self.longest, len(m) - i), 0, -1) if m[i : i + n] in self.grams][:1]
        return sum(found) / len(found) if found else np.zeros(len(self.languages))

    def judge(self, text, certain_at=20):
        words = self.words_of(text)
        if not words:
            return "und", 0.0
        total = sum(self.score(w) for w in words) * min(len(words), certain_at) / len(words)
        share = np.exp(total - total.max())
        return self.languages[int(share.argmax())], float(share.max() / share.sum())


def test_language_equals_brute_force(spark):
    rng = random.Random(12)
    letters = {"xx": "abcdeé", "yy": "aklmnß", "zz": "uvwxÉЖ", "日": "日本語ab"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 7)))
    glue = [" ", ", ", "-", "7", "_", "\n", "²", "\u0301"]
    rows = [("".join(word(lang) + rng.choice(glue) for _ in range(rng.randrange(0, 40))), lang) for lang in [*letters] * 40]
    rows += [("İstanbul " + "日" * 700 + "Σας", "日"), (None, "xx"), ("abc", None), ("", "yy")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    brute = BruteLanguages(rows)
    asked = [(i, t) for i, (t, _) in enumerate(rows)] + [(900, "½ ²³"), (901, "x" * 6000 + "é"), (902, " ".join(word(x) for x in letters for _ in range(9)).upper()), (903, "٣٤ __ 12"), (904, None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    for i, text in asked:
        lang, score = brute.judge(text)
        assert got[i] == (lang, pytest.approx(score, abs=1e-4)), (i, text)
    assert got[900] == got[903] == got[904] == ("und", 0.0)


def test_language_reads_whole_runs_without_spaces(spark):
    rng, alphabets = random.Random(5), {"xx": "abcdef", "yy": "defghi"}
    run = lambda lang, n: "".join(rng.choice(alphabets[lang]) for _ in range(n))
    rows = [(run(lang, n), lang) for lang, n in [("xx", 2600), ("yy", 2100), ("xx", 1000), ("yy", 70), ("xx", 998), ("yy", 999)]]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    want = BruteLanguages(rows).grams
    for n, held in model.grams.items():
        own = [g for g in want if len(g) == n]
        assert np.allclose(held.rows[held.find(langid.hashes_of(own))], [want[g] for g in own], atol=1e-5) and len(held.keys) == len(own)
    docs = spark.createDataFrame([(0, run("xx", 60) + run("yy", 6000)), (1, run("yy", 60) + run("xx", 900))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {0: "yy", 1: "xx"}


def test_a_small_language_keeps_its_words(spark):
    rng = random.Random(3)
    rows = [(" ".join(f"w{rng.choice('abcdefghij')}{rng.choice('klmnopqrst')}" for _ in range(10)), "big") for _ in range(3000)] + [("zum zum zam zam", "small")] * 3
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), most_rows=50)
    assert (model.words.find(langid.hashes_of(["zum", "zam"])) >= 0).all()
    got = langid.predict(spark.createDataFrame([(0, "zum zam")], "doc_id long, text string"), model).first()
    assert got.lang_pred == "small"


def test_known_languages_keep_columns_of_any_name(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    docs = odd_docs.withColumnRenamed("size", "told_lang").withColumnRenamed("key", "told_score").withColumnRenamed("digest", "Told_Lang_")
    kept = langid.known_languages(docs, model, 0.0)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 1, None, 6, 7, 8, 9])
    assert langid.known_languages(no_docs, model, 0.5).count() == 0


# -- 3 and 10


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_token_counts_and_cache(spark, odd_docs, no_docs, tokenizer):
    cache = work_path(spark, "test-cache")
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    for _ in range(2):
        got = token_counts.count_tokens(odd_docs, PATH, cache, limit=10).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 10) for r in got)
        # The second run adds no entry.
        assert spark.read.parquet(cache).count() == 7
    assert token_counts.count_tokens(no_docs, PATH, work_path(spark, "test-cache")).count() == 0


def test_token_counts_encode_only_what_a_part_filled_cache_lacks(spark, odd_docs, tokenizer):
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    for most in (0, 1 << 17):  # misses by a join of distinct texts and by broadcast
        cache = work_path(spark, "test-cache")
        token_counts.count_tokens(odd_docs.where("doc_id = 1 or doc_id = 2"), PATH, cache)
        spark.createDataFrame([(b"other", "another tokenizer", 5)], token_counts.CACHE).write.mode("append").parquet(cache)
        # A count that is there is taken as it stands, so nothing is encoded twice.
        spark.read.parquet(cache).where("n_tokens > 5").selectExpr("content", "tokenizer", "n_tokens + 1000 as n_tokens").write.parquet(f"{cache}-b")
        spark.read.parquet(f"{cache}-b").write.mode("append").parquet(cache)
        got = Counter((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(odd_docs, PATH, cache, most_broadcast=most).collect())
        held = next(n for (i, n) in want if i == 1)
        assert got == Counter({(i, n + 1000 if i in (1, None) else n): k for (i, n), k in want.items()}) and held > 5
        assert spark.read.parquet(cache).count() == 2 + 1 + 1 + 5


def test_pieces_equal_the_library_on_hostile_texts(tokenizer):
    import pyarrow as pa

    from siftlog.llm.bytetext import spans, text_buffers
    from siftlog.llm.tokens import Pieces

    rng = random.Random(4)
    parts = ["a", "B", "É", "é", "1", "23", "'s", "'", "_", ".", "!?", " ", "\n", "\t", "×", "²", "́", "İ", "日本", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "ﬁ", "Σ", "\x1c", "٣", "don't", "😀", "\r\n", "ȿ", "ͅ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(2500)]
    coder = Pieces(PATH, most=300)  # the cache starts anew many times
    data, offsets = text_buffers(pa.array(texts))
    for i, j in spans(offsets, 2000):
        ids, n = coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k, one in zip(range(i, j), np.split(ids, np.cumsum(n)[:-1]), strict=True):
            assert one.tolist() == tokenizer.encode(texts[k], add_special_tokens=False).ids, texts[k]


def test_long_documents_in_parts_equal_the_library(tokenizer, monkeypatch):
    import pyarrow as pa

    from siftlog.llm import tokens
    from siftlog.llm.bytetext import text_buffers

    rng = random.Random(6)
    parts = ["word", "don't", "É_é", "<|endoftext|>", "\n\n", "  ", "12.5", "日本", "\t", "x" * 90]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "", " "]) for _ in range(k)) for k in (0, 3, 80, 400, 0, 90)] + ["y" * 500, " " * 300, "tail "]
    monkeypatch.setattr(tokens, "LONG", 64)
    ids, n = tokens.Pieces(PATH).encode(*text_buffers(pa.array(texts)))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert tokens.Pieces(PATH).encode(*text_buffers(pa.array(texts)), counts_only=True)[1].tolist() == n.tolist()


def test_token_orc(spark, odd_docs, no_docs, tokenizer):
    path = work_path(spark, "test-orc")
    token_orc.write_token_orc(odd_docs, path, PATH)
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start, want = 0, []
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_orc.token_index(spark, path).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert token_orc.read_token_orc(spark, path).where("doc_id = 6").count() == 1
    token_orc.write_token_orc(no_docs, empty := work_path(spark, "test-orc"), PATH)
    assert token_orc.token_index(spark, empty).count() == 0


def test_small_batches_bound_bytes_and_put_the_setting_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(2000, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield b.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    def written():
        texts.mapInArrow(sizes, "rows long, bytes long").write.parquet(path := work_path(spark, "sizes"))
        return spark.read.parquet(path).collect()

    assert spark.conf.get(key, None) is None
    assert [r["rows"] for r in written()] == [2000]
    with small_batches(spark, 100_000):
        got = written()
    assert sum(r["rows"] for r in got) == 2000 and len(got) > 15 and max(r["bytes"] for r in got) < 110_000
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "123456")
    try:
        with pytest.raises(ZeroDivisionError), small_batches(spark):
            assert spark.conf.get(key) == str(4 << 20)
            1 / 0
        assert spark.conf.get(key) == "123456"
    finally:
        spark.conf.unset(key)


def test_token_orc_spreads_equal_rows_and_grows_files_with_bytes(spark, tokenizer):
    rows = [(5, "equal rows of text")] * 400 + [(i, f"text {i}") for i in range(200)] + [(None, "no id")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    token_orc.write_token_orc(docs, path := work_path(spark, "test-orc"), PATH, file_bytes=1000)
    files = spark.read.orc(path).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 6 and max(r["count"] for r in files) < 300
    got = token_orc.token_index(spark, path).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))


# -- 4


def brute_repeats(texts, length):
    n = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "q", "step"), [(200, 64, 16), (40, 12, 5), (30, 10, 1)])
def test_suffix_dedup_equals_brute_force(spark, length, q, step):
    df, texts = corpus(spark)
    extra = [(1000, "z" * 900), (1001, "zy" * 90 + "q" + "zy" * 90), (1002, "z" * length), (1003, None)]
    df = df.union(spark.createDataFrame(extra, df.schema))
    texts |= dict(extra)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, length=length, q=q, step=step, chunk_bytes=9000).collect()}
    want = brute_repeats([(t or "").encode() for t in texts.values()], length)
    assert got == dict(zip(texts, want, strict=True))


def test_suffix_dedup_odd(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    want = Counter(brute_repeats([(r.text or "").encode() for r in rows], 40))
    got = suffix_dedup.remove_repeats(odd_docs, length=40, q=12, step=8).collect()
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_packed_counts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    for bits in (44, 64):
        t = packed.sent(3, np.concatenate([ids, ids[:10]]), bits, 7)
        back = np.concatenate([np.cumsum(packed.unsqueeze(b, np.uint64), dtype=np.uint64) for b in t["ids"].to_pylist()])
        assert (back == np.unique(ids >> np.uint64(64 - bits))).all()
    c = packed.code(np.arange(1, 100_000))
    assert (np.diff(c.astype(int)) >= 0).all() and c[126] == 127 and c[-1] > 200


# -- 5


def test_decontamination(spark, odd_docs, no_docs):
    items = [(0, "If Maria buys 12 apples for 3 euros each and Maria sells 5 apples how much does she keep in the end"), (1, "plain words without any slots at all but quite a few of them anyway"), (2, None), (3, ""), (None, "x y z")]
    texts = [
        (1, "intro text here. If Maria buys 12 apples for 3 euros each and Maria sells 5 apples how much does she keep in the end more text"),
        (2, "If Peter buys 40 apples for 7 euros each and Peter sells 9 apples how much does she keep in the end"),
        (3, "If Peter buys 40 apples for 7 euros each and Susan sells 9 apples how much does she keep in the end"),
        (4, "plain words without any slots at all and then something else entirely follows in this text"),
        (5, "PLAIN words without any slots at all but quite a few of them anyway."),
        (6, None), (7, ""), (None, items[0][1]), (5, "another row"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "w") for i, t in texts], "doc_id long, text string, window string")
    for limit in (1 << 20, 0):  # by a broadcast filter and by shuffle
        got = {(r.doc_id, r.item_id): r.exact for r in decontaminate.find_contamination(docs, bench, most_broadcast=limit).collect()}
        assert got == {(1, 0): True, (2, 0): False, (5, 1): True}
    kept = decontaminate.decontaminated(docs, bench)
    assert Counter(r.doc_id for r in kept.collect()) == Counter([3, 4, 5, 6, 7]) and kept.columns == docs.columns
    assert decontaminate.find_contamination(no_docs, bench).count() == 0
    assert decontaminate.find_contamination(odd_docs, bench.where("false")).count() == 0


def test_decontamination_equals_brute_force_without_slots(spark):
    df, texts = corpus(spark, n=80, vocabulary=400)
    bench = {i: " ".join(texts[k].split(" ")[:40]) for i, k in enumerate([1, 4, 9, 16]) if texts[k]}
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))} if t.split() else set()
    want = {(d, i) for d, t in texts.items() for i, b in bench.items() if shingles(b) and len(shingles(b) & shingles(t)) >= 0.8 * len(shingles(b))}
    got = decontaminate.find_contamination(df, spark.createDataFrame(list(bench.items()), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontamination_drops_only_the_windows_that_conflict(spark):
    item = " ".join(f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(60)).split()
    item[5] = item[50] = "12"
    edited, renamed, mixed_up = item.copy(), item.copy(), item.copy()
    edited[50], renamed[5], renamed[50], mixed_up[5], mixed_up[50] = "77", "40", "40", "40", "41"
    docs = spark.createDataFrame([(i, "so. " + " ".join(t) + " end") for i, t in enumerate([item, edited, renamed, mixed_up])], "doc_id long, text string")
    got = {r.doc_id: (r.n_windows, r.n_found, r.exact) for r in decontaminate.find_contamination(docs, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()}
    # 56 windows, 5 of them around each number.
    assert got == {0: (56, 56, True), 1: (56, 51, False), 2: (56, 56, False), 3: (56, 46, False)}


def test_decontamination_finds_short_items_inside_documents(spark):
    bench = spark.createDataFrame([(0, "quite rare phrase"), (1, "solo"), (2, "sold 7 boats"), (3, "42"), (4, "five words stand here now")], "item_id long, text string")
    texts = ["a quite rare phrase, in the middle of it", "quite rare phrase", "quite rare other phrase", "only solo", "he sold 9 boats then", "page 42 of 50", "page 43 of 50", "five words stand here now", "five words stand here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (1 << 20, 0):
        got = {(r.doc_id, r.item_id, r.exact) for r in decontaminate.find_contamination(docs, bench, most_broadcast=limit).collect()}
        assert got == {(0, 0, True), (1, 0, True), (3, 1, True), (4, 2, False), (5, 3, True), (7, 4, True)}


def brute_template(text):
    """(template word, value) of each word, None for the value of a plain word."""
    out, before, number_before = [], None, False
    for m in WORD.finditer(text):
        raw = m.group()
        bare = raw.strip("".join(chr(c) for c in range(128) if decontaminate._PUNCTUATION[c])) or raw
        value = bare.lower()
        number = any(c in "0123456789" for c in bare) and not any(c.isalpha() for c in bare)
        unit = number_before and value in decontaminate.UNITS
        opens = before is None or before.group()[-1] in "!.:?" or "\n" in text[before.end() : m.start()]
        name = bare[0].isupper() and not opens and not number and not unit
        out.append(("#N" if number else "#U" if unit else "#P" if name else value, value if number or unit or name else None))
        before, number_before = m, number
    return out


def brute_contamination(texts, items, width=5, share=0.8):
    got = {}
    for i, item in items.items():
        a = brute_template(item or "")
        n = min(width, len(a))
        if not n:
            continue
        windows = lambda w: [(p, tuple(x for x, _ in w[p : p + n]), [v for _, v in w[p : p + n] if v is not None]) for p in range(len(w) - n + 1)]  # noqa: E731,B023
        total = {w for _, w, _ in windows(a)}
        for d, text in texts.items():
            hits = [(q - p, w, x, y) for p, w, x in windows(a) for q, z, y in windows(brute_template(text or "")) if w == z and (n == width or len(x) < n or x == y)]
            maps = {}
            for along, _, x, y in hits:
                for v, u in zip(x, y, strict=True):
                    maps.setdefault((along, v), set()).add(u)
            kept = {w for along, w, x, y in hits if x == y or all(len(maps[along, v]) == 1 for v in x)}
            if kept and len(kept) >= share * len(total):
                got[d, i] = (len(total), len(kept))
    return got


def test_decontamination_equals_brute_force_with_slots(spark):
    rng = random.Random(21)
    plain, names, units = ["when", "buys", "and", "sells", "each", "how", "much", "left"], ["Maria", "Peter", "Zoë", "Émile"], ["kg", "euros", "km"]
    part = lambda: rng.choice([rng.choice(plain), rng.choice(plain), rng.choice(names), f"{rng.randrange(9)}", f"{rng.randrange(9)} {rng.choice(units)}", "end.", "so,\n"])
    text = lambda n: " ".join(part() for _ in range(n))
    items = {i: text(n) for i, n in enumerate([30, 12, 7, 5, 3, 1, 40, 25])} | {50: None, 51: ""}
    items[60] = items[0] + " " + text(4)  # shares most windows with another item
    texts = {}
    for d in range(120):
        source = (items[rng.choice([*range(8), 60])] or "").split(" ")
        kind = d % 4
        if kind == 1:  # each value renamed, always alike
            new = {w: rng.choice(names) for w in names} | {str(k): str(rng.randrange(90)) for k in range(9)}
            source = [new.get(w, w) for w in source]
        elif kind == 2:  # some values renamed at one place only
            source = [rng.choice(names) if w in names and rng.random() < 0.2 else str(rng.randrange(90)) if w.isdigit() and rng.random() < 0.2 else w for w in source]
        elif kind == 3:
            source = [w for w in source if rng.random() < 0.96]
        texts[d] = text(rng.randrange(8)) + " " + " ".join(source) + " " + text(rng.randrange(8))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute_contamination(texts, items)
    assert len(want) > 60
    for limit in (1 << 20, 0):
        got = {(r.doc_id, r.item_id): (r.n_windows, r.n_found) for r in decontaminate.find_contamination(docs, bench, most_broadcast=limit).collect()}
        assert got == want


def test_decontamination_with_phrases_that_all_items_share(spark):
    stock = "choose the one right answer to the question that follows here and"
    items = [(i, f"{stock} w{i}a x{i} y{i} z{i} " + " ".join(f"v{'abcdefghij'[i % 10]}{'abcdefghijklmnopqrst'[k]}q{'abcdefghij'[i // 10]}" for k in range(20))) for i in range(60)]
    docs = [(i, stock + " nothing else of an item") for i in range(200)] + [(1000, "so " + items[7][1])]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1000, 7)]


# -- 6


def test_quality(spark, odd_docs, no_docs):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    rows = []
    for i in range(600):
        t = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        bad = i % 5 == 0
        if bad:
            t = [w + rng.choice(["$$$", "###", ""]) for w in t] if i % 2 else [w for w in t[:9] for _ in range(8)]
        rows.append((i, " ".join(t), int(not bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs.where("doc_id < 400"), labels)
    got = {r.doc_id: r for r in quality.score_quality(docs, model).collect()}
    right = [got[i].predicted == q for i, _, q in rows if i >= 400]
    assert sum(right) / len(right) > 0.95
    assert all((r.score >= 0.7) == bool(r.predicted) and 0 <= r.score <= 1 for r in got.values())
    odd = quality.score_quality(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and len({r.score for r in odd if r.doc_id in (2, 3)}) == 1
    assert quality.score_quality(no_docs, model).count() == 0
    flat = quality.fit_quality(no_docs, labels)
    assert {round(r.score, 9) for r in quality.score_quality(odd_docs, flat).collect()} == {0.7}


def brute_features(text):
    words = WORD.findall(text)
    raw, n = text.encode(), len(words)
    size, per = max(len(raw), 1), max(n, 1)
    share = lambda f: sum(map(f, raw)) / size
    length = [min(len(w.encode()), 60) for w in words]
    mean = sum(length) / per
    runs = lambda k: len({tuple(words[i : i + k]) for i in range(n - k + 1)}) if n >= k else min(n, 1)
    return [
        np.log1p(n) / 10, share(lambda c: chr(c) in "#*$%&|<>"), share(lambda c: chr(c) in "0123456789"), share(lambda c: 65 <= c <= 90), share(lambda c: chr(c) in ".!?,;:"), share(lambda c: c == 10), share(lambda c: c >= 0xC0),
        mean / 20, np.sqrt(max(sum(x * x for x in length) / per - mean**2, 0)) / 20, len(set(words)) / per, sum(a == b for a, b in zip(words, words[1:], strict=False)) / per,
        runs(2) / max(n - 1, 1), runs(3) / max(n - 2, 1), max(Counter(words).values(), default=0) / per, sum(w[-1] in "#*$%&|<>" for w in words) / per, share(lambda c: c == ord("|")), sum(x > 25 for x in length) / per, float(n == 0),
    ]


def test_quality_features_equal_brute_force(spark):
    import pyarrow as pa

    from siftlog.llm.bytetext import text_buffers

    _, texts = corpus(spark, n=40, vocabulary=12)
    asked = [t + x for t, x in zip(texts.values(), ["", " A1 | 2$", "\n\n..", " é" * 9, " " + "x" * 80] * 8, strict=True)] + ["", " ", "a", "a a", "É|"]
    got = quality.features(*text_buffers(pa.array(asked)))
    want = np.array([brute_features(t) for t in asked])
    busy = want[:, -1] == 0  # without words, only the shares of bytes and the last feature count
    assert np.allclose(got[busy], want[busy]) and np.allclose(got[~busy][:, [0, 1, 2, 3, 4, 5, 6, 15, 17]], want[~busy][:, [0, 1, 2, 3, 4, 5, 6, 15, 17]])


def test_quality_weights_are_the_least_loss_of_the_pairs():
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    x = rng.normal(0, 1, (400, len(quality.FEATURES)))
    x[:, 2] += y
    model = quality.learn(x, y, pairs=3000, ridge=1e-2, seed=5)
    draw = np.random.default_rng(5)
    z = model.expand(x)
    d = z[draw.choice(np.flatnonzero(y == 1), 3000)] - z[draw.choice(np.flatnonzero(y == 0), 3000)]
    loss = lambda w: np.mean(np.log1p(np.exp(-d @ w))) + 0.5e-2 * w @ w
    least = loss(model.weights)
    assert all(loss(model.weights + 0.05 * rng.normal(0, 1, len(model.weights))) >= least for _ in range(200))
    # No cut between two scores splits the labels better.
    s = z @ model.weights
    split = lambda c: (s[y == 1] >= c).mean() + (s[y == 0] < c).mean()
    assert max(split(c) for c in s) <= split(model.threshold) + 1e-12


@pytest.mark.parametrize("bad", [0.002, 0.2, 0.9, 0.998])
def test_quality_cut_follows_the_labels_at_any_share_of_bad_rows(bad):
    rng = np.random.default_rng(3)
    y = (np.arange(5000) >= bad * 5000).astype(int)
    x = rng.normal(0, 0.01, (5000, len(quality.FEATURES)))
    x[:, 1] += y
    predicted = quality.learn(x, y, pairs=5000).scores(x) >= quality.CUT
    assert (predicted == y).mean() > 0.999


# -- 7


def brute_classes(texts, size, num, den):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            shared = len(sets[i] & sets[j])
            if shared and den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "num", "seed"), [(4, 85, 3), (5, 80, 4), (1, 60, 5), (2, 95, 6)])
def test_jaccard_equals_brute_force(spark, size, num, seed):
    df, texts = corpus(spark, n=130, seed=seed)
    extra = [(1000, "a B c"), (1001, "A b  C"), (1002, ""), (1003, None), (1004, "\t")]
    df, texts = df.union(spark.createDataFrame(extra, df.schema)), texts | dict(extra)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df, size=size, num=num, chunk_bytes=9000).collect()}
    assert got == brute_classes(texts, size, num, 100)


def test_jaccard_on_a_large_family(spark):
    """Many near copies of one text, linked and unlinked, with chains between them."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for i in range(160):
        t = list(base)
        for _ in range(rng.randrange(0, 5)):
            t[rng.randrange(len(t))] = f"e{rng.randrange(40)}"
        texts[i] = " ".join(t[rng.randrange(0, 9) :])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(df, size=4, num=85).collect()}
    assert got == brute_classes(texts, 4, 85, 100)


def test_jaccard_odd(spark, odd_docs, no_docs):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_classes(odd_docs, size=4, num=85).collect())
    assert got[(1, 10, 1)] == 2 and got[(8, 10, 1)] == 1 and got[(2, 0, 2)] == 1 and got[(3, 0, 3)] == 1 and got[(5, 0, 5)] == 1
    assert sum(got.values()) == odd_docs.count()
    assert jaccard_join.jaccard_classes(no_docs).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102)]
    got = {r.v: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# -- 8


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_host_rules(spark, odd_docs, no_docs):
    df, texts = corpus(spark, n=60, vocabulary=12)
    docs = df.withColumn("source", F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("h"), F.col("doc_id") % 4))).unionByName(odd_docs.select("doc_id", "text", "source"))
    got = host_rules.host_rules(docs).collect()
    rows = docs.collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(((r.doc_id, *brute_measures(r.text)) for r in rows), key=key)
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.host_rate <= 0.5)
    for host in {r.host for r in got}:
        own = [r for r in got if r.host == host]
        raw = sum(r.base_failed for r in own) / len(own)
        mean = sum(r.base_failed for r in got) / len(got)
        assert min(raw, mean) - 1e-9 <= own[0].host_rate <= max(raw, mean) + 1e-9  # shrunk towards the mean
    assert host_rules.host_rules(no_docs).count() == 0


# -- 9


def brute_captures(rows):
    first = {}
    for i, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, html in rows:
        raw = (html or "").encode()
        other = first.get(html)
        revisit = html in first and other != i and i is not None
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return out


def test_warc_round_trip(spark):
    trap = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nX-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big = "<p>" + "long text é " * 30_000
    rows = [(i, f"<html>{i} " + "x" * (i * 7 % 150)) for i in range(60)] + [(100, trap), (101, "pre " + trap * 3 + "WARC/1.1\r\n"), (102, "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n"), (103, None), (104, ""), (105, "é" * 60), (106, "é" * 60), (107, trap), (108, big), (109, big), (109, big), (110, "\r\n\r\n" + trap), (111, "日" * 40)]
    pages = spark.createDataFrame([(i, f"http://h/{i} x\r\ny", h, "s", "z") for i, h in rows], "page_id long, url string, html string, size string, digest string")
    for split in ("128m", "20k"):  # 20k: many splits in a file, some begin inside a payload
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        try:
            warc.write_warc(warc.dedup_captures(pages).coalesce(2), path := work_path(spark, "test-warc"))
            got = warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_captures(rows)))


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(warc.dedup_captures(pages), path := work_path(spark, "test-warc"))
    assert warc.read_warc(spark, path).count() == 0


def foreign(version, kind, name, block, content="application/http; msgtype=response", **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": name, "Content-Type": content, "Content-Length": str(len(block)), **{k.replace("_", "-"): v for k, v in fields.items()}}
    return f"WARC/{version}\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_warc_of_another_writer(spark, tmp_path):
    body = b"<html>payload with WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n inside and WARC/1.1</html>"
    for version in ("1.0", "1.1"):
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
        records = [
            foreign(version, "warcinfo", "<urn:uuid:1>", b"software: other\r\n", "application/warc-fields"),
            foreign(version, "request", "<urn:uuid:2>", b"GET / HTTP/1.1\r\n\r\n", "application/http; msgtype=request"),
            foreign(version, "response", "<urn:uuid:3>", http + body, WARC_Target_URI="http://a/"),
            foreign(version, "revisit", "<urn:uuid:4>", http, WARC_Refers_To="<urn:uuid:3>", WARC_Payload_Digest="sha1:ABC"),
            foreign(version, "metadata", "<urn:uuid:5>", b"x: y", "application/warc-fields"),
            foreign(version, "resource", "<urn:uuid:6>", b"plain bytes", "text/plain"),
            foreign(version, "response", "<urn:uuid:7>", http + b"short"),
        ]
        (tmp_path / version).mkdir()
        (tmp_path / version / "a.warc").write_bytes(b"".join(records) + foreign(version, "response", "<urn:uuid:8>", http + b"cut off here")[:-20])
        rows = {r.record_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_id, r.page_id) for r in warc.read_warc(spark, str(tmp_path / version)).collect()}
        assert rows == {
            "<urn:uuid:3>": (len(body), hashlib.sha256(body).hexdigest(), "response", None, None),
            "<urn:uuid:4>": (None, "sha1:ABC", "revisit", "<urn:uuid:3>", None),
            "<urn:uuid:7>": (5, hashlib.sha256(b"short").hexdigest(), "response", None, None),
        }
        every = warc.read_warc(spark, str(tmp_path / version), kinds=("warcinfo", "request", "response", "revisit", "metadata", "resource"))
        assert every.count() == 7


def test_warc_with_null_ids_and_huge_lengths(spark):
    odd = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999999999999999999\r\n\r\n"
    rows = [(None, None), (None, "z" * 200), (3, "z" * 200), (4, odd), (4, odd), (9223372036854775807, "last")]
    pages = spark.createDataFrame([(i, None, h) for i, h in rows], "page_id long, url string, html string")
    warc.write_warc(warc.dedup_captures(pages), path := work_path(spark, "test-warc"))
    got = warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    sha = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == Counter((i, len(h or ""), sha(h)) for i, h in rows)


def test_pieces_forget_and_keep_alike():
    """Ids are the library's, whether the cache holds all pieces in many runs or starts anew again and again."""
    from siftlog.llm.tokens import Pieces

    texts = [" ".join(f"w{i * j % 977}x{j}, Ünï{j % 13}'s" for j in range(i % 40)) for i in range(300)]
    for most in (50, 2_000_000):
        held = Pieces(PATH, most)
        want = [e.ids for e in held.tokenizer.encode_batch(texts, add_special_tokens=False)]
        for i in range(0, len(texts), 7):
            some = [t.encode() for t in texts[i : i + 7]]
            ids, n = held.encode(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
            assert n.tolist() == [len(w) for w in want[i : i + 7]]
            assert ids.tolist() == [x for w in want[i : i + 7] for x in w]
