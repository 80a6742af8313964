"""Tracing identifiers, resolving and verifying evidence, matching streams, comparing snapshots."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.functions.fields import comparable, normalised, quoted_spans, token_set, word_count
from siftlog.operators.trace import firsts
from siftlog.work import saved


def id_pattern(parts: list[str]) -> str:
    """A pattern for an identifier whose parts may be joined by any or no separator, with no letter or digit beside it."""
    return r"(?i)(?<![\p{L}\p{N}])" + r"[-_.\s]?".join(parts) + r"(?![\p{L}\p{N}])"


def id_hits(lines: DataFrame, ids: dict[str, list[str]]) -> DataFrame:
    """path, line_no, id for each identifier that a line holds; one pass over the lines, all patterns in one column."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(id_pattern(p)), F.lit(name)) for name, p in ids.items()]))
    return lines.select(*[c for c in lines.columns if c != "text"], F.explode(hits).alias("id"))


def id_trace(hits: DataFrame, keep: int = 3) -> DataFrame:
    """id, path, n, refs: counts and the first ``keep`` lines of each identifier in each file."""
    n = hits.groupBy("id", "path").agg(F.count("*").alias("n"))
    first = hits.withColumn("r", F.row_number().over(W.partitionBy("id", "path").orderBy("line_no"))).where(F.col("r") <= keep)
    refs = first.groupBy("id", "path").agg(F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("refs"))
    return n.join(refs, ["id", "path"])


def id_absence(paths: DataFrame, ids: list[str], hits: DataFrame) -> DataFrame:
    """id, path of files in which an identifier never appears."""
    all_ = paths.select("path", F.explode(F.array(*[F.lit(i) for i in ids])).alias("id"))
    return all_.join(hits.select("id", "path").distinct(), ["id", "path"], "left_anti").select("id", "path")


def co_occurrence(hits: DataFrame, ids: list[str]) -> DataFrame:
    """a, b, n, verdict for every pair of identifiers: how many records hold both."""
    both = hits.groupBy("path", "line_no").agg(F.array_sort(F.collect_set("id")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda x: F.transform(F.filter("s", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    n = both.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))
    ids = sorted(ids)
    every = hits.sparkSession.createDataFrame([(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :]], "a string, b string")
    return every.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") > 0, "confirmed").otherwise("not-in-corpus").alias("verdict"))


def _suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "/"))


def resolve_paths(asked: DataFrame, corpus: DataFrame) -> DataFrame:
    """asked, path, state (ok, ambiguous, missing): exact paths first, else whole-part suffixes; more than one is ambiguous.

    Suffixes of the corpus are exploded once and joined by equality, so nothing scans all files for each request.
    """
    keys = corpus.select("path", F.explode(_suffixes(F.col("path"))).alias("asked")).withColumn("exact", F.col("asked") == F.col("path"))
    found = asked.select("asked").distinct().join(keys, "asked", "left")
    best = found.groupBy("asked").agg(F.count("path").alias("n"), F.max(F.when(F.col("exact"), F.col("path"))).alias("own"), F.min("path").alias("one"))
    state = F.when(F.col("own").isNotNull() | (F.col("n") == 1), "ok").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return best.select("asked", F.when(state == "ok", F.coalesce("own", "one")).alias("path"), state.alias("state"))


#: Verdicts on evidence from best to worst; ``ambiguous`` is settled before any line is read.
VERDICTS = ("ok", "unverifiable", "no-quote", "wrong-content", "out-of-range", "missing-file", "binary-file", "ambiguous")


def _support(claim: Column, line: Column, got: Column, overlap: float, quote_overlap: float, least: int, least_quote: int, least_words: int) -> Column:
    """struct<v, quoted>: what one line says of a claim.

    A quote of the claim that the line holds verbatim settles it. Else its longest quote with enough tokens that the
    line's scripts could hold is compared by them, else the whole claim; with too few tokens nothing can be said.
    """
    quotes, norm = quoted_spans(claim), normalised(line)
    verbatim = F.exists(quotes, lambda q: (normalised(q) != "") & F.contains(norm, normalised(q)))

    def measured(text: Column, *before: Column) -> Column:
        t = comparable(token_set(text), line)
        return F.struct(*before, F.size(t).alias("n"), word_count(t).alias("w"), F.size(F.array_intersect(t, got)).alias("h"))

    every = F.transform(quotes, lambda q, i: measured(q, (-F.length(q)).alias("a"), i.alias("i")))
    best = F.array_min(F.filter(every, lambda z: (z["n"] >= least_quote) & (z["w"] >= least_words)))
    own = measured(claim)
    enough = lambda z, share: F.when(z["h"] >= share * z["n"], "ok").otherwise("wrong-content")
    v = F.when(verbatim, "ok").when(best.isNotNull(), enough(best, quote_overlap)).when((own["n"] < least) | (own["w"] < least_words), "unverifiable").otherwise(enough(own, overlap))
    return F.struct(v.alias("v"), F.coalesce(verbatim, F.lit(False)).alias("quoted"))


def verify_claims(claims: DataFrame, lines: DataFrame, binary: DataFrame | None = None, longest: int = 41, overlap: float = 0.34, quote_overlap: float = 0.6, least: int = 3, least_quote: int = 4, least_words: int = 2, require_quote: bool = False) -> DataFrame:
    """claim_id, verdict of (claim_id, path, line_lo, line_hi, claim): the best that any cited line says of the claim.

    Paths are resolved as ``resolve_paths`` does; ``binary`` holds paths that can't be read. Only the cited lines are joined,
    at most ``longest`` of a range; one that ends before it begins is its first line. With ``require_quote``, nothing but a
    verbatim quote is ok.
    """
    resolved = resolve_paths(claims.select(F.col("path").alias("asked")), lines.select("path").distinct())
    c = claims.withColumnRenamed("path", "asked").join(resolved, "asked")
    c = c.join(binary.select("path", F.lit(True).alias("sealed")), "path", "left") if binary is not None else c.withColumn("sealed", F.lit(None).cast("boolean"))
    c = c.withColumn("line_no", F.explode_outer(F.when((F.col("state") == "ok") & F.col("sealed").isNull(), F.sequence("line_lo", F.least(F.greatest("line_lo", "line_hi"), F.col("line_lo") + longest - 1)))))
    got = c.join(lines.select("path", "line_no", F.col("text").alias("line")), ["path", "line_no"], "left")
    got = got.withColumn("got", token_set(F.coalesce("line", F.lit("")))).withColumn("s", _support(F.col("claim"), F.col("line"), F.col("got"), overlap, quote_overlap, least, least_quote, least_words))
    said = F.when((F.col("s.v") != "wrong-content") & ~F.col("s.quoted"), "no-quote").otherwise(F.col("s.v")) if require_quote else F.col("s.v")
    state = F.when(F.col("state") == "missing", "missing-file").otherwise(F.col("state"))
    verdict = F.when(F.col("state") != "ok", state).when(F.col("sealed"), "binary-file").when(F.col("line").isNull(), "out-of-range").otherwise(said)
    rank = F.array_position(F.array(*[F.lit(v) for v in VERDICTS]), F.col("v"))
    return got.withColumn("v", verdict).groupBy("claim_id").agg(F.min_by("v", rank).alias("verdict"))


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _prefixes(least: int):
    """Arrow task: (id, owner, text) -> n, h of each beginning of ``least`` words or more, by sums over the text's bytes; the whole text last."""

    def run(batches):
        power = np.ones(1, np.uint64)

        def rows(done: list[tuple]) -> pa.RecordBatch:
            ids, owners, counts, hashes = zip(*done, strict=True)
            size = [len(n) for n in counts]
            whole = np.concatenate([n == n[-1:] for n in counts])
            columns = [pa.array(np.repeat(ids, size), pa.int64()), pa.array(np.repeat(np.array(owners, object), size), pa.string()), pa.array(np.concatenate(counts), pa.int64()), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(whole)]
            return pa.RecordBatch.from_arrays(columns, ["id", "owner", "n", "h", "whole"])

        for b in batches:
            done, held = [], 0
            for row, owner, text in zip(b["id"].to_pylist(), b["owner"].to_pylist(), b["text"].to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                if len(power) < len(data):
                    power = np.full(len(data), _PRIME)
                    power[0] = 1
                    power = np.multiply.accumulate(power)
                sums = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])
                ends = np.append(np.flatnonzero(data == 32), len(data))[least - 1 :]
                h = sums[ends - 1] * np.uint64(0xD6E8FEB86659FD93) if len(data) else np.zeros(0, np.uint64)
                done.append((row, owner, np.arange(least, least + len(h)), h))
                held += len(h)
                if held > 1 << 18:
                    yield rows(done)
                    done, held = [], 0
            if done:
                yield rows(done)

    return run


def sibling_prefix(texts: DataFrame, least: int = 4) -> DataFrame:
    """id, of: rows whose words are a strict prefix, of ``least`` words or more, of another's with the same owner.

    Only texts that share their first ``least`` words with another are read further; their beginnings are compared by 64-bit
    hashes, and joined by equality. Words are parted by single spaces; null texts and owners match nothing.
    """
    t = texts.where("text is not null and owner is not null").select("id", "owner", "text", F.xxhash64(F.slice(F.split("text", " ", least + 1), 1, least)).alias("key"))
    shared = t.groupBy("owner", "key").count().where("count > 1").select("owner", "key")
    rows = t.join(shared, ["owner", "key"], "left_semi").select("id", "owner", "text").mapInArrow(_prefixes(least), "id long, owner string, n long, h long, whole boolean")
    whole = rows.where("whole").select("id", "owner", "n", "h")
    return whole.join(rows.where("not whole").select(F.col("id").alias("of"), "owner", "n", "h"), ["owner", "n", "h"]).select("id", "of")


def stitch_rotation(slices: DataFrame) -> DataFrame:
    """stream, slices, n, lo, hi, stitched of (path, stem, lo, hi, n): slices of one stem that follow without overlap are one stream."""
    order = W.partitionBy("stem").orderBy("lo", "path")
    s = slices.withColumn("gap", F.col("lo") - F.lag("hi").over(order))
    out = s.groupBy("stem").agg(F.count("*").alias("slices"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.coalesce(F.bool_and(F.col("gap") >= -2), F.lit(True)).alias("ordered"))
    return out.select(F.col("stem").alias("stream"), "slices", "n", "lo", "hi", ((F.col("slices") > 1) & F.col("ordered")).alias("stitched"))


def overlap_join(a: DataFrame, b: DataFrame, bucket: int = 64) -> DataFrame:
    """Rows of a (path, lo, hi, ...) and b (path, b_lo, b_hi, ...) whose intervals meet, each pair once.

    Both sides are dealt into buckets of ``bucket`` lines and joined by equality; the pair is kept in the bucket where
    the later of the two begins.
    """
    x = a.withColumn("k", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))))
    y = b.withColumn("k", F.explode(F.sequence(F.floor(F.col("b_lo") / bucket), F.floor(F.col("b_hi") / bucket))))
    out = x.join(y, ["path", "k"]).where((F.col("lo") <= F.col("b_hi")) & (F.col("b_lo") <= F.col("hi")))
    return out.where(F.col("k") == F.floor(F.greatest("lo", "b_lo") / bucket)).drop("k")


def proof_reach(calls: DataFrame, proofs: DataFrame) -> DataFrame:
    """proof_id, reach: reached if a call without error covers it, unknown if one reads its file without lines or failed, else not_reached.

    Ranges meet by ``overlap_join``'s buckets, not all calls of a file with all its proofs.
    """
    read = calls.where(F.col("c_lo").isNotNull() & ~F.col("failed")).select("path", F.col("c_lo").alias("b_lo"), F.col("c_hi").alias("b_hi"))
    hit = overlap_join(proofs.select("proof_id", "path", "lo", "hi"), read).select("proof_id").distinct().withColumn("hit", F.lit(True))
    vague = calls.where(F.col("c_lo").isNull() | F.col("failed")).select("path").distinct().withColumn("vague", F.lit(True))
    j = proofs.join(hit, "proof_id", "left").join(vague, "path", "left")
    return j.select("proof_id", F.when(F.col("hit"), "reached").when(F.col("vague"), "unknown").otherwise("not_reached").alias("reach"))


def event_twins(df: DataFrame, keys: list[str], host: str, row: str) -> DataFrame:
    """row, twins: how many events on other hosts have the same keys."""
    by_host = df.groupBy(*keys, host).agg(F.count("*").alias("own"))
    all_ = by_host.groupBy(*keys).agg(F.sum("own").alias("all"))
    return df.join(by_host, [*keys, host]).join(all_, keys).where("all > own").select(row, (F.col("all") - F.col("own")).alias("twins"))


def rank_match(a: DataFrame, b: DataFrame, key: list[str], order: str, row: str) -> DataFrame:
    """a_row, b_row: the k-th row of a key on one side with the k-th on the other, where both have equally many."""
    by = W.partitionBy(*key)
    rank = lambda df, name: df.select(*key, F.col(row).alias(name), F.row_number().over(by.orderBy(order)).alias("k"), F.count("*").over(by).alias("c"))
    return rank(a, "a_row").join(rank(b, "b_row"), [*key, "k", "c"]).select("a_row", "b_row")


def snapshot_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """path, change of two listings (path, inode, size): new, disappeared, rotated, truncated, append or unchanged."""
    j = a.select("path", F.col("inode").alias("i"), F.col("size").alias("s")).join(b.select("path", F.col("inode").alias("j"), F.col("size").alias("t")), "path", "full_outer")
    change = F.when(F.col("i").isNull(), "new").when(F.col("j").isNull(), "disappeared").when(F.col("i") != F.col("j"), "rotated").when(F.col("t") < F.col("s"), "truncated").when(F.col("t") > F.col("s"), "append").otherwise("unchanged")
    return j.select("path", change.alias("change"))


def pair_turns(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Each call with its result by call_id; an error voids the range."""
    j = calls.join(results, "call_id", "left")
    void = F.coalesce(F.col("is_error"), F.lit(True))
    return j.select("call_id", "tool", F.when(~void, F.col("lo")).alias("lo"), F.when(~void, F.col("hi")).alias("hi"), void.alias("failed"))


def reconcile(claimed: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, flags: which of the claimed columns differ from the derived ones, and rows on one side only."""
    d = derived.select(F.col(key).alias("k"), *[F.col(c).alias(f"d_{c}") for c in columns])
    j = claimed.join(d, F.col(key) == F.col("k"), "full_outer")
    flags = F.array(F.when(F.col("k").isNull(), "unsupported"), F.when(F.col(key).isNull(), "unclaimed"), *[F.when(F.col(c) != F.col(f"d_{c}"), c) for c in columns])
    return j.select(F.coalesce(key, "k").alias(key), F.array_join(F.array_compact(flags), ",").alias("flags"))


def fair_worklist(rows: DataFrame, budget: int, state_share: float = 0.1, state_each: int = 3) -> DataFrame:
    """path, line_no, round, place of candidates (path, kind, line_no, rank): files take turns, one row each a round.

    State files share ``state_share`` of the budget with ``state_each`` rows each; stream rows that are not needed go to
    them. Rounds are counted first: those that fit are kept as they are, and only of the round in which a kind's budget ends are the first
    files by name looked for, bucket by bucket. At most ``budget`` rows meet in one place.
    """
    r = rows.withColumn("round", F.row_number().over(W.partitionBy("path").orderBy("rank", "line_no")))
    r = r.where((F.col("round") <= budget) & ((F.col("kind") == "stream") | (F.col("round") <= state_each)))
    per = r.groupBy("kind", "round").agg(F.count("*").alias("c"))  # ``budget`` rounds at most
    before = F.coalesce(F.sum("c").over(W.partitionBy("kind").orderBy("round").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # Streams leave what they don't need to the states; their total is known from the rounds' counts.
    streams = F.coalesce(F.sum(F.when(F.col("kind") == "stream", F.col("c"))).over(W.partitionBy()), F.lit(0))
    most = budget - int(budget * state_share)
    per = per.select("kind", "round", "c", before.alias("before"), F.when(F.col("kind") == "stream", most).otherwise(budget - F.least(streams, F.lit(most))).alias("most"))
    per = saved(per.where("before < most"), "rounds")
    near = r.join(F.broadcast(per), ["kind", "round"])  # ``budget`` rounds at most
    whole = near.where("before + c <= most").select("path", "line_no", "round")
    last = firsts(near.where("before + c > most"), ["kind"], ["path"], budget)
    last = last.withColumn("inside", F.row_number().over(W.partitionBy("kind").orderBy("path"))).where("before + inside <= most").select("path", "line_no", "round")
    kept = whole.unionByName(last)
    # At most ``budget`` rows are left to be numbered.
    return kept.withColumn("place", F.row_number().over(W.orderBy("round", "path")).cast("long")).select("path", "line_no", F.col("round").cast("long").alias("round"), "place")


def diversity_cap(rows: DataFrame, file: str, slot: str, strength: str, row: str, each_slot: int = 2, each_file: int = 6) -> DataFrame:
    """The strongest rows with at most ``each_slot`` of a (file, slot) and ``each_file`` of a file."""
    r = rows.withColumn("a", F.row_number().over(W.partitionBy(file, slot).orderBy(F.desc(strength), row))).where(F.col("a") <= each_slot)
    return r.withColumn("b", F.row_number().over(W.partitionBy(file).orderBy(F.desc(strength), row))).where(F.col("b") <= each_file).drop("a", "b")


def receipt_sample(rows: DataFrame, group: str, file: str, row: str, first: Column, least: int = 3) -> DataFrame:
    """group, row: a hash-ordered sample of max(least, ceil(sqrt(n)), files with ``first`` rows) rows of each group, one per file before seconds, ``first`` rows before all."""
    key = F.sha2(F.concat_ws("|", group, F.col(row).cast("string")), 256)
    r = rows.select(group, file, row, first.alias("pref"), key.alias("key"))
    r = r.withColumn("turn", F.row_number().over(W.partitionBy(group, file).orderBy(F.desc("pref"), "key")))
    n = r.groupBy(group).agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("pref"), F.col(file))).alias("files"))
    need = F.least(F.col("n"), F.greatest(F.lit(least), F.ceil(F.sqrt("n")), F.col("files")))
    # No file gives more rows than the group needs.
    r = r.join(n.select(group, need.alias("need")), group).where(F.col("turn") <= F.col("need"))
    r = r.withColumn("at", F.row_number().over(W.partitionBy(group).orderBy(F.desc("pref"), "turn", "key")))
    return r.where(F.col("at") <= F.col("need")).select(group, row)


def receipt_audit(covered: DataFrame, due: DataFrame, receipts: DataFrame, addresses: DataFrame, rules: list[str]) -> DataFrame:
    """rule, row, kind, n: what is wrong with the receipts (rule, row, ref, quote, decision) that rules brought for rows.

    ``covered`` and ``due``: (rule, row) that a rule covers, and those it owes a receipt for; ``addresses``: (row, own), the rows that
    there are. Kinds: missing (owed, and no receipt decides for the rule), duplicate-identical and duplicate-conflicting,
    candidate, unknown-rule, unknown-row, row-not-covered (the first that applies), wrong-address.
    """
    count = lambda df, kind: df.groupBy("rule", "row").agg(F.count("*").alias("n")).select("rule", "row", (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), "n")
    missing = count(due.join(receipts.where("decision = 'rule'").select("rule", "row").distinct(), ["rule", "row"], "left_anti"), "missing")
    twice = receipts.groupBy("rule", "row").agg(F.count("*").alias("times"), F.count_distinct(F.struct("ref", "quote", "decision")).alias("d")).where("times > 1")
    twice = twice.select("rule", "row", F.when(F.col("d") == 1, "duplicate-identical").otherwise("duplicate-conflicting").alias("kind"), F.lit(1).cast("long").alias("n"))
    placed = receipts.join(addresses, "row", "left").join(covered.distinct().withColumn("held", F.lit(True)), ["rule", "row"], "left")
    why = F.when(~F.col("rule").isin(*rules), "unknown-rule").when(F.col("own").isNull(), "unknown-row").when(F.col("held").isNull(), "row-not-covered")
    off = placed.withColumn("kind", why).where("kind is not null").groupBy("rule", "row", "kind").agg(F.count("*").alias("n"))
    parts = [twice, count(receipts.where("decision = 'candidate'"), "candidate"), off, count(placed.where("ref <> own"), "wrong-address")]
    for p in parts:
        missing = missing.unionByName(p)
    return missing


def coverage_audit(declared: DataFrame, inventory: DataFrame) -> DataFrame:
    """asked, state, flags of declared files (asked, state: empty, binary or text; cited: a path that its evidence is from, or null) against an inventory (path, n, binary).

    Flags: missing, ambiguous (several files by that name), duplicate, false-empty, false-binary, foreign-file.
    """
    found = resolve_paths(declared.select("asked"), inventory.select("path")).withColumnRenamed("state", "there")
    j = declared.join(found, "asked").join(inventory, "path", "left").withColumn("times", F.count("*").over(W.partitionBy("asked")))
    flags = F.array(
        F.when(F.col("there") != "ok", F.col("there")), F.when(F.col("times") > 1, "duplicate"), F.when((F.col("state") == "empty") & (F.col("n") > 0), "false-empty"),
        F.when((F.col("state") == "binary") & ~F.col("binary"), "false-binary"), F.when(F.col("cited") != F.col("path"), "foreign-file"),
    )
    return j.select("asked", "state", F.array_join(F.array_compact(flags), ",").alias("flags"))


#: From weakest to strongest; a truth that no block meets is elsewhere.
OUTCOMES = ("elsewhere", "dismissed", "unlabelled", "normal", "incident")


def truth_outcomes(truth: DataFrame, blocks: DataFrame) -> DataFrame:
    """is_decoy and a count for each of ``OUTCOMES``: what became of each truth (defect_id, is_decoy, path, lo, hi), by the strongest
    outcome of the blocks (path, b_lo, b_hi, outcome) that it meets."""
    rank = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("outcome"))
    met = overlap_join(truth.select("defect_id", "path", "lo", "hi"), blocks).groupBy("defect_id").agg(F.max(rank).alias("rank"))
    z = truth.select("defect_id", "is_decoy").distinct().join(met, "defect_id", "left").withColumn("zone", F.element_at(F.array(*[F.lit(o) for o in OUTCOMES]), F.coalesce(F.col("rank"), F.lit(1)).cast("int")))
    return z.groupBy("is_decoy").pivot("zone", list(OUTCOMES)).agg(F.count("defect_id")).na.fill(0)


def byte_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """id of (id, earned, klass, cost): earned blocks always; of the rest, class by class, the cheapest that fit.

    Costs ascend inside a class, so what fits is a prefix of each class; the remainder goes to the next. Blocks are counted by
    cost first, so windows see a row for each different cost; only blocks of the cost at which a class's share ends are
    ordered by id. Classes are few: what each of them leaves is one aggregate over the counted costs.
    """
    spent = blocks.where("earned").agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
    rest = blocks.where("not earned").select("id", "klass", "cost")
    levels = rest.groupBy("klass", "cost").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum(F.col("n") * F.col("cost")).over(W.partitionBy("klass").orderBy("cost").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    levels = saved(levels.withColumn("before", before), "block-costs")
    left, shares = budget - spent, []
    for k in [r[0] for r in levels.select("klass").distinct().orderBy("klass").collect()]:
        fits = F.when(F.col("cost") > 0, F.least("n", F.floor((F.lit(left) - F.col("before")) / F.col("cost")))).otherwise(F.col("n"))
        used = levels.where((F.col("klass") == k) & (F.col("before") <= left)).agg(F.max(F.col("before") + F.greatest(fits, F.lit(0)) * F.col("cost"))).first()[0] or 0
        shares.append((k, left))
        left -= used
    kept = blocks.where("earned").select("id")
    if not shares:
        return kept
    own = blocks.sparkSession.createDataFrame(shares, blocks.select("klass").schema.add("left", "long"))
    cuts = levels.join(F.broadcast(own), "klass").where("before <= left")  # a row a class
    cuts = cuts.withColumn("fit", F.when(F.col("cost") > 0, F.least("n", F.floor((F.col("left") - F.col("before")) / F.col("cost")))).otherwise(F.col("n")))
    near = rest.join(cuts.select("klass", "cost", "n", "fit").where("fit > 0"), ["klass", "cost"])
    edge = near.where("fit < n").withColumn("r", F.row_number().over(W.partitionBy("klass", "cost").orderBy("id"))).where("r <= fit")
    return kept.unionByName(near.where("fit = n").select("id")).unionByName(edge.select("id"))


def priority_cut(rows: DataFrame, file: str, klass: str, row: str, order: list[str], weak: str, weak_each: int = 6, most: int = 250) -> DataFrame:
    """row, place, dropped: rows by the order of their classes, then file and row, ``most`` of them; ``weak`` rows are held to
    ``weak_each`` of a file; dropped counts all rows that were left out."""
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col(klass))
    r = rows.withColumn("p", rank).withColumn("w", F.row_number().over(W.partitionBy(file, klass).orderBy(row)))
    r = r.where((F.col(klass) != weak) | (F.col("w") <= weak_each)).orderBy("p", file, row).limit(most)
    r = r.withColumns({"place": F.row_number().over(W.orderBy("p", file, row)).cast("long"), "kept": F.count("*").over(W.partitionBy())})  # ``most`` rows
    return r.join(F.broadcast(rows.agg(F.count("*").alias("all")))).select(row, "place", (F.col("all") - F.col("kept")).alias("dropped"))  # one row


def stride_sample(lines: DataFrame, most: int, edge: int) -> DataFrame:
    """Of files longer than ``most`` lines every k-th line and ``edge`` at both ends; shorter files whole."""
    n = lines.groupBy("path").agg(F.max("line_no").alias("n"))
    j = lines.join(n, "path")
    k = F.ceil(F.col("n") / most)
    return j.where((k <= 1) | (F.col("line_no") % k == 0) | (F.col("line_no") <= edge) | (F.col("line_no") > F.col("n") - edge)).drop("n")
