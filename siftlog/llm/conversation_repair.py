"""Conversation repair by a grammar-compressed shortest-path programme.

Turns of a conversation, in order, become a string of letters: ``x`` for one that must go (blank, or equal to an earlier
one), else ``s``, ``u``, ``a`` or ``o`` by its role's initial, upper case where the text is cut off. A legal conversation
has the role initials ``(s?(ua)+)?``; the cheapest edits into one are a shortest path over four states (nothing yet, after
s, after u, after a).

* ``learn_rules`` builds a Re-Pair grammar over all strings of the corpus: in each round the most frequent pairs of
  neighbouring symbols get a symbol of their own. Rounds and pairs a round bound the grammar, which is all that is
  broadcast; what no rule covers is multiplied symbol by symbol.
* Each symbol has one min-plus transfer matrix (start state to end state) with its audit, the initials of the edits, as a
  rope. A rule's matrix is the product of its two symbols' matrices, made bottom-up once and shared by all conversations.
* Inserts stand before the letter that follows them, so each audit of a string ends with a letter for its last turn. Hence
  no audit of a string is the beginning of another, their ASCII order is settled inside the string, and a matrix keeps
  it as a rank for each start state: products compare ranks, ropes are written out only where an audit is returned.

A conversation may hold a third of all rows. Equal rows are counted first; then rows are dealt by ranges of (conversation,
turn), so that it spreads over tasks, and cut into blocks of at most ``block_rows`` letters. Only blocks' matrices and counts
(a row for each block) are gathered by conversation, for the states between its blocks; the text of a conversation of several blocks streams
through one task for its digest, one joined piece a block, since SHA-256 has no other way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlog.llm.shared import picked, saved

SPACES = " \t\n\x0b\x0c\r"
STATES = range(4)  # nothing yet, after s, after u, after a
#: What edits cost, the roles' steps between states, the state that an insert leads to.
CUT_OFF, REROLE, DELETE, INSERT = 3, 3, 4, 3
STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
#: Inserts behind the last turn, by state; a conversation may stay empty.
ENDING = {0: "", 1: "II", 2: "I", 3: ""}
FIRST_SYMBOL = 0x100
BLOCK = "conv_id bigint, part int, block int, seq string, turns array<struct<role: string, text: string>>, facts struct<low: bigint, high: bigint, distinct: bigint, blank: bigint, duplicate: bigint, truncated: bigint, illegal: bigint, first: string, last: string>"
LEGAL = ("su", "ua", "au")


@dataclass
class Matrix:
    """By start and end state: the least cost; the order of the audits from one start state; how the audit is put together."""

    cost: dict = field(default_factory=dict)
    rank: dict = field(default_factory=dict)
    by: dict = field(default_factory=dict)  # a letter's audit, or the state between left and right
    left: Matrix | None = None
    right: Matrix | None = None

    def audit(self, i: int, j: int) -> str:
        """The rope from i to j, written out."""
        out, open_ = [], [(self, i, j)]
        while open_:
            m, i, j = open_.pop()
            if m.left is None:
                out.append(m.by[i, j])
            else:
                k = m.by[i, j]
                open_ += [(m.right, k, j), (m.left, i, k)]
        return "".join(out)


def letter_matrix(letter: str) -> Matrix:
    """Inserts, then the one edit of a turn."""
    found: dict = {}
    extra = CUT_OFF if letter.isupper() else 0
    for i in STATES:
        for inserts, k in (("", i), ("I", NEXT[i]), ("II", NEXT[NEXT[i]])):
            edits = [("D", DELETE, k)]
            if letter != "x":
                edits += [("K", extra, STEP[letter.lower()].get(k)), ("R", REROLE + extra, NEXT[k])]
            for edit, cost, j in edits:
                if j is not None:
                    new = (INSERT * len(inserts) + cost, inserts + edit)
                    found[i, j] = min(found.get((i, j), new), new)
    m = Matrix({e: c for e, (c, _) in found.items()}, {}, {e: a for e, (_, a) in found.items()})
    for i in STATES:
        for r, j in enumerate(sorted((j for a, j in found if a == i), key=lambda j: found[i, j][1])):
            m.rank[i, j] = r
    return m


def product(a: Matrix, b: Matrix) -> Matrix:
    m = Matrix(left=a, right=b)
    for i in STATES:
        best: dict = {}
        for k in STATES:
            if (i, k) in a.cost:
                for j in STATES:
                    if (k, j) in b.cost:
                        new = (a.cost[i, k] + b.cost[k, j], a.rank[i, k], k)
                        best[j] = min(best.get(j, new), new)
        for r, j in enumerate(sorted(best, key=lambda j: (best[j][1], b.rank[best[j][2], j]))):
            m.cost[i, j], m.rank[i, j], m.by[i, j] = best[j][0], r, best[j][2]
    return m


class Grammar:
    """The matrices of all symbols, bottom-up, and of strings, by their symbols."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = rules
        self.own = {c: letter_matrix(c) for c in "xsuaoSUAO"}
        for symbol, pair in rules:
            self.own[symbol] = product(self.own[pair[0]], self.own[pair[1]])
        self.of = lru_cache(1 << 14)(self._of)

    def packed(self, seq: str) -> str:
        for symbol, pair in self.rules:
            if len(seq) == 1:
                break
            seq = seq.replace(pair, symbol)
        return seq

    def _of(self, seq: str) -> Matrix:
        row = [self.own[c] for c in self.packed(seq)]
        while len(row) > 1:  # by halves, so that ropes stay flat
            row = [product(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]


_grammars: dict[tuple, Grammar] = {}


def _grammar(rules: tuple) -> Grammar:
    """Kept for the worker's next tasks."""
    if rules not in _grammars:
        _grammars.clear()
        _grammars[rules] = Grammar(list(rules))
    return _grammars[rules]


def learn_rules(strings: DataFrame, rounds: int = 12, pairs: int = 128) -> list[tuple[str, str]]:
    """(symbol, pair of symbols) in order, from the column ``seq``; each pair stands at least twice in the corpus.

    Strings are counted, so a string of many conversations is read once. Pairs of a round are replaced one after the other,
    most frequent first; one that overlaps with an earlier one is replaced where it is left.
    """
    seqs = saved(strings.groupBy("seq").agg(F.count("*").alias("n")), "repair-strings")
    rules: list[tuple[str, str]] = []
    for _ in range(rounds):
        chars = F.split("seq", "")
        two = F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1)))
        found = seqs.where(F.length("seq") > 1).select("n", F.explode(F.filter(two, lambda p: p.isNotNull())).alias("pair"))
        found = found.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "pair").limit(pairs).collect()
        if not found:
            break
        new = [(chr(FIRST_SYMBOL + len(rules) + i), r.pair) for i, r in enumerate(found)]
        rules += new
        each = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(s).alias("symbol")) for s, p in new])
        seqs = seqs.select("n", F.aggregate(each, F.col("seq"), lambda seq, r: F.replace(seq, r["pair"], r["symbol"])).alias("seq"))
        seqs = saved(seqs.groupBy("seq").agg(F.sum("n").alias("n")), "repair-strings")
    return rules


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, damaged by the crc32 of ``conv_id:turn``, of twenty kinds five; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes its ends of sentences out, 3 repeats it, 4 makes its role user.
    """
    rows = picked(conversations, **{c: c for c in ("conv_id", "turn", "role", "text")})
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = rows.withColumns({"kind": kind, "role": space("role"), "text": space("text")}).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": text})
    rows = rows.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))))
    return rows.select("conv_id", "turn", "role", "text")


def _facts(rows: list[tuple]) -> dict:
    """Counts of a block's rows (turn, initial, copies, fault); faults of copies are those of duplicates or blanks."""
    turns = [t for t, *_ in rows if t is not None]
    out = {"low": turns[0] if turns else None, "high": turns[-1] if turns else None, "distinct": len(set(turns)), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    before = None
    for _, initial, n, fault in rows:
        if fault == "blank":
            out["blank"] += n
        elif fault == "duplicate":
            out["duplicate"] += n
        else:
            out["truncated"] += fault == "truncated"
            out["duplicate"] += n - 1
        out["illegal"] += (before is not None and before + initial not in LEGAL) + n - 1
        before = initial
    return out | {"first": rows[0][1], "last": before}


def _blocks(rows: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """BLOCK rows of counted, sorted rows: a block holds neighbours of one conversation in one partition."""
    fields = pa.struct([("role", pa.string()), ("text", pa.string())])
    facts = pa.struct([(c, pa.int64()) for c in ("low", "high", "distinct", "blank", "duplicate", "truncated", "illegal")] + [("first", pa.string()), ("last", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int32()), ("seq", pa.string()), ("turns", pa.list_(fields)), ("facts", facts)])

    def batch(done: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(done, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, conv, part, seq, turns, own, size, done, held = 0, None, 0, [], [], [], 0, [], 0

        def close() -> None:
            nonlocal number, seq, turns, own, size, held
            if own:
                done.append({"conv_id": conv, "part": part, "block": number, "seq": "".join(seq), "turns": turns, "facts": _facts(own)})
                number, held = number + 1, held + size + 100
                seq, turns, own, size = [], [], [], 0

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "fault", "part")]
            for c, turn, role, text, n, fault, p in zip(*columns, strict=True):
                if c != conv or len(seq) >= block_rows or size >= block_bytes:
                    close()
                    if held > block_bytes:
                        yield batch(done)
                        done, held = [], 0
                conv, part = c, p
                if fault in (None, "truncated"):
                    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
                    seq.append(letter.upper() if fault else letter)
                    turns.append({"role": role, "text": text})
                    size += len(text)
                    own.append((turn, role[:1], 1, fault))
                    n, fault = n - 1, "duplicate"
                while n:  # copies of one row may fill blocks of their own
                    k = min(n, max(1, block_rows - len(seq)))
                    seq += "x" * k
                    own.append((turn, role[:1], k, fault))
                    n -= k
                    if n:
                        close()
        close()
        if done:
            yield batch(done)

    return rows.mapInArrow(cut, BLOCK)


def _ways(blocks: DataFrame, rules: tuple) -> DataFrame:
    """Each block's matrix as two lists of 16, -1 where there is no way."""

    def seen(batches):
        grammar = _grammar(rules)
        for b in batches:
            found = [grammar.of(s) for s in b.column("seq").to_pylist()]
            lists = [pa.array([[x.get((i, j), -1) for i in STATES for j in STATES] for x in part], pa.list_(pa.int64())) for part in ([m.cost for m in found], [m.rank for m in found])]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "block", "facts")), *lists], ["conv_id", "part", "block", "facts", "cost", "rank"])

    kinds = BLOCK.split("facts ")[1]
    return blocks.select("conv_id", "part", "block", "seq", "facts").mapInArrow(seen, f"conv_id bigint, part int, block int, facts {kinds}, cost array<bigint>, rank array<bigint>")


def path_of(blocks: list[dict]) -> list[tuple[int, int]]:
    """(start, end) of each block on the cheapest way, of those the one with the ASCII-least audit.

    From the end, each state's least cost to go; from the start, the end state that lies on a cheapest way, by its rank.
    """
    togo = [{j: INSERT * len(e) for j, e in ENDING.items()}]
    for b in reversed(blocks):
        togo.append({i: min((b["cost"][4 * i + j] + togo[-1][j] for j in STATES if b["cost"][4 * i + j] >= 0), default=1 << 60) for i in STATES})
    togo.reverse()
    out, i = [], 0
    for b, later in zip(blocks, togo[1:], strict=True):
        _, _, j = min((b["cost"][4 * i + j] + later[j], b["rank"][4 * i + j], j) for j in STATES if b["cost"][4 * i + j] >= 0)
        out.append((i, j))
        i = j
    return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _paths(ways: DataFrame) -> DataFrame:
    """For each block its states on the conversation's way, and the conversation's counts. Streams over sorted block rows."""
    names = ["conv_id", "part", "block", "blocks", "start", "finish", "last", *COUNTS]

    def told(blocks: list[dict]) -> list[dict]:
        way, facts = path_of(blocks), [b["facts"] for b in blocks]
        known = [f for f in facts if f["low"] is not None]
        distinct = sum(f["distinct"] for f in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        counts = {c: sum(f[c] for f in facts) for c in ("blank", "duplicate", "truncated", "illegal")}
        counts["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(facts, facts[1:]))
        counts["gaps"] = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        counts["cost"] = sum(b["cost"][4 * i + j] for b, (i, j) in zip(blocks, way, strict=True)) + INSERT * len(ENDING[way[-1][1]])
        return [
            {"conv_id": b["conv_id"], "part": b["part"], "block": b["block"], "blocks": len(blocks), "start": i, "finish": j, "last": n == len(blocks) - 1} | counts
            for n, (b, (i, j)) in enumerate(zip(blocks, way, strict=True))
        ]

    def seen(batches):
        open_, schema = [], pa.schema([("conv_id", pa.int64()), *[(c, pa.int32()) for c in names[1:6]], ("last", pa.bool_()), *[(c, pa.int64()) for c in COUNTS]])
        for b in batches:
            done = []
            for row in b.to_pylist():
                if open_ and open_[0]["conv_id"] != row["conv_id"]:
                    done += told(open_)
                    open_ = []
                open_.append(row)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if open_:
            yield pa.RecordBatch.from_pylist(told(open_), schema)

    ordered = ways.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return ordered.mapInArrow(seen, "conv_id bigint, part int, block int, blocks int, start int, finish int, last boolean, " + ", ".join(f"{c} bigint" for c in COUNTS))


def _applied(blocks: DataFrame, rules: tuple) -> DataFrame:
    """Blocks with their states: the audit, and the repaired turns in order."""
    roles = {2: "user", 3: "assistant"}
    turn = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def repaired(audit: str, seq: str, turns: list[dict], state: int) -> list[dict]:
        out, letters, alive = [], iter(seq), iter(turns)
        for edit in audit:
            if edit == "I":
                state = NEXT[state]
                out.append({"edit": edit, "role": roles[state], "text": ""})
                continue
            letter = next(letters)
            own = next(alive) if letter != "x" else None
            if edit == "K":
                state = STEP[letter.lower()][state]
                out.append({"edit": edit} | own)
            elif edit == "R":
                state = NEXT[state]
                out.append({"edit": edit, "role": roles[state], "text": own["text"]})
        return out

    def seen(batches):
        grammar = _grammar(rules)
        for b in batches:
            audits, turns = [], []
            for row in b.select(["seq", "turns", "start", "finish", "last"]).to_pylist():
                audit = grammar.of(row["seq"]).audit(row["start"], row["finish"]) + (ENDING[row["finish"]] if row["last"] else "")
                audits.append(audit)
                turns.append(repaired(audit, row["seq"], row["turns"], row["start"]))
            kept = [c for c in b.schema.names if c not in ("seq", "turns", "start", "finish", "last")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(audits, pa.string()), pa.array(turns, pa.list_(turn))], [*kept, "audit", "repaired"])

    kept = "conv_id bigint, part int, block int, blocks int, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return blocks.mapInArrow(seen, f"{kept}, audit string, repaired array<struct<edit: string, role: string, text: string>>")


def _streamed(pieces: DataFrame) -> DataFrame:
    """Conversations of several blocks: audits joined, the digest of all pieces in order, one piece held at a time."""
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]

    def seen(batches):
        schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        own, audits, digest, some = None, [], hashlib.sha256(), False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{c: own[c] for c in names[:-2]} | {"audit": "".join(audits), "repaired_sha256": digest.hexdigest()}], schema)

        for b in batches:
            for x in b.to_pylist():
                if own is None or x["conv_id"] != own["conv_id"]:
                    if own is not None:
                        yield row()
                    audits, digest, some = [], hashlib.sha256(), False
                own = x
                audits.append(x["audit"])
                if x["lines"]:
                    digest.update(b"\n" * some + x["lines"].encode())
                    some = True
        if own is not None:
            yield row()

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return ordered.mapInArrow(seen, "conv_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", audit string, repaired_sha256 string")


@dataclass
class Repair:
    """``verdicts``: a row for each conversation with rows; ``turns``: conv_id, place, edit, role, text of the repaired ones, place rising in a conversation."""

    verdicts: DataFrame
    turns: DataFrame


def _fault(text: Column) -> tuple[Column, Column]:
    """(blank, cut off): no character but white space; the last other one is no end of a sentence."""
    rest = F.rtrim(text, F.lit(SPACES))
    return rest == "", ~F.substring(rest, -1, 1).isin(".", "!", "?")


def repair(conversations: DataFrame, block_rows: int = 4096, block_bytes: int = 4 << 20, rounds: int = 12, pairs: int = 128) -> Repair:
    """The cheapest repair of each conversation of conv_id, turn, role and text; of equally cheap ones that with the ASCII-least audit.

    Rows go by turn, nulls first; rows of equal turns by role and text (by their first 64 and 32 characters first). A null role or text
    is one space, which makes a text blank; an empty role has no initial and is legal beside nothing. Equal rows are each
    counted: all but the first are duplicates. Rows without a conversation form one. An empty table gives empty tables; other columns are left out.
    """
    rows = picked(conversations, **{c: c for c in ("conv_id", "turn", "role", "text")})
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = saved(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")), "repair-rows")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    said = rows.groupBy(F.col("conv_id").alias("conv"), F.col("role").alias("by"), F.md5("text").alias("digest")).agg(F.count("*").alias("times"), F.min(place).alias("earliest"))
    said = saved(said.where("times > 1").drop("times"), "repair-said")  # its size is known: broadcast only if it is small
    joined = rows.join(said, rows["conv_id"].eqNullSafe(said["conv"]) & (rows["role"] == said["by"]) & (F.md5(rows["text"]) == said["digest"]), "left")
    blank, cut_off = _fault(F.col("text"))
    later = F.col("earliest").isNotNull() & ~F.col("earliest.turn").eqNullSafe(F.col("turn"))
    joined = joined.select("conv_id", "turn", "role", "text", "n", F.when(blank, "blank").when(later, "duplicate").when(cut_off, "truncated").alias("fault"))
    order = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 32)]
    dealt = joined.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").withColumn("part", F.spark_partition_id())
    blocks = saved(_blocks(dealt, block_rows, block_bytes), "repair-blocks")
    rules = tuple(learn_rules(blocks, rounds, pairs))
    paths = saved(_paths(_ways(blocks, rules)), "repair-paths")

    def applied(which: str) -> DataFrame:
        own = paths.where(which).withColumnsRenamed({"conv_id": "conv", "part": "at_part", "block": "at_block"})
        both = blocks.join(own, (F.col("part") == F.col("at_part")) & (F.col("block") == F.col("at_block")))
        return _applied(both.select("conv_id", "part", "block", "blocks", *COUNTS, "seq", "turns", "start", "finish", "last"), rules)

    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    alone = applied("blocks = 1").withColumn("repaired_sha256", F.sha2(lines.cast("binary"), 256)).select("conv_id", *COUNTS, "audit", "repaired_sha256")
    several = _streamed(applied("blocks > 1").withColumn("lines", lines).drop("repaired"))
    turns = applied("true").select("conv_id", "part", "block", F.posexplode("repaired").alias("at", "turn"))
    turns = turns.select("conv_id", F.struct("part", "block", "at").alias("place"), "turn.*")
    return Repair(alone.unionByName(several), turns)
