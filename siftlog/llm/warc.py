"""WARC archives: writing page captures with revisits, and reading them back by boundary-chain verification.

Reading: archives of any writer, WARC 1.0 and 1.1, with records of every type. Spark splits the files at ``WARC/1.`` wherever it occurs, also inside payloads. Each task
gives every candidate its offset within the split and the offset of its successor, from the candidate's own
header. A candidate's pointer is first taken through its own split to where the chain leaves it; pointer jumping
over splits from the start of each file then finds where the true chain enters each split, and only candidates on
the chain from there are records. A piece of a payload that looks like a record is on no chain; its bytes go back
to the record that holds it. Every record type takes part in the chain; captures are the responses and revisits on it.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlog.llm.shared import picked, saved

MAGIC = "WARC/1."
VERSION = "1\r\n"
END = "\r\n\r\n"
PIECES = "file string, block long, at long, size long, next long, record_id string, uri string, kind string, refers_to_id string, n long, digest string, sha256 string, body binary"
#: A fixed date: reruns write equal archives.
DATE = "2024-01-01T00:00:00Z"


def dedup_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 100) -> DataFrame:
    """page_id, url, html, n (bytes), digest (sha-256), refers_to: the least page_id with the same payload where that is another's and n >= least."""
    pages = picked(pages, page_id=id_col, url=url_col, html=html_col)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumns({"n": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    first = pages.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null")
    # Written first, so that Spark knows its size: few copies are broadcast, and payloads then need no shuffle.
    out = pages.join(saved(first.select("digest", "first"), "warc-copies"), "digest", "left")
    return out.select("page_id", "url", "html", "n", "digest", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("refers_to"))


def write_warc(captures: DataFrame, path: str) -> None:
    """Write the rows of ``dedup_captures`` as uncompressed WARC 1.1 files, one record each; revisits hold no payload."""
    revisit = F.col("refers_to").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC + VERSION + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"),
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("n").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.when(revisit, "0").otherwise(F.col("n").cast("string")),
        F.lit(END),
    )
    captures.select(F.concat(head, F.when(revisit, "").otherwise(F.col("html"))).alias("value")).write.option("lineSep", END).text(path)


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() and len(text) < 16 else None


def _payload(fields: dict[str, str], block: bytes) -> tuple[int | None, str | None, str | None]:
    """(payload length, stated digest, digest of the payload's bytes) of a whole record. A revisit's length is what its writer states.

    The payload of an HTTP message is what follows its head, of any other block the block itself.
    """
    stated = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if fields.get("warc-type") == "revisit":
        return _number(fields.get("x-payload-length", "")), stated, None
    if fields.get("content-type", "").startswith("application/http"):
        block = block.partition(END.encode())[2]
    return len(block), stated, hashlib.sha256(block).hexdigest()


def _pieces(batches, bodies: bool = False):
    """Offsets inside each split and what each piece's own header says; bodies only of pieces that are no whole record, or of all."""
    at: dict[tuple[str, int], int] = {}
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in PIECES.split(", ")]
    for batch in batches:
        rows = []
        for file, block, value in zip(*(batch[c].to_pylist() for c in ("file", "block", "value")), strict=True):
            # Each piece ends where the next magic begins; what stands before a file's first magic is its first piece.
            key = (file, block)
            begin = at.get(key, 0)
            raw = value.encode() if isinstance(value, str) else bytes(value)
            at[key] = begin + len(raw) + len(MAGIC)
            head, gap, body = raw.partition(END.encode())
            f = _fields(head) if gap and head[:3] in (b"0\r\n", b"1\r\n") else {}
            length = f.get("content-length", "")
            ok = _number(length) is not None and "warc-type" in f
            whole = len(head) + len(END) + int(length) + len(END) if ok else None
            done = ok and len(raw) == whole
            n, stated, sha = _payload(f, body[: int(length)]) if done else (None, None, None)
            rows.append((file, block, begin, len(raw), begin + len(MAGIC) + whole if ok else None, f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-type"), f.get("warc-refers-to"), n, stated, sha, None if done and not bodies else raw))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names)


def _leave(table: pa.Table) -> pa.Table:
    """Takes each candidate's pointer through its own split to where its chain leaves it."""
    rows = sorted(zip(table["at"].to_pylist(), table["next"].to_pylist(), strict=True), reverse=True)
    out: dict[int, int] = {}
    for at, then in rows:
        out[at] = out.get(then, then)
    return pa.table({"file": pa.array([table["file"][0].as_py()] * len(out)), "at": pa.array(list(out), pa.int64()), "exit": pa.array(list(out.values()), pa.int64())})


def _walk(table: pa.Table, entries: pa.Table) -> pa.Table:
    """The candidates of a split on the chain from its entry."""
    pointer = dict(zip(table["at"].to_pylist(), table["next"].to_pylist(), strict=True))
    chain = []
    for at in entries["at"].to_pylist():
        while at in pointer:
            chain.append(at)
            at = pointer[at]
    file = (table if table.num_rows else entries)["file"][0].as_py()
    return pa.table({"file": pa.array([file] * len(chain), pa.string()), "at": pa.array(chain, pa.int64())})


def _joined(table: pa.Table) -> pa.Table:
    """A record whose block holds the magic, from its pieces in order; one whose block ends early has no digest."""
    pieces = sorted(zip(table["at"].to_pylist(), table["body"].to_pylist(), strict=True))
    head, _, body = MAGIC.encode().join(b for _, b in pieces).partition(END.encode())
    f = _fields(head)
    length = int(f["content-length"])
    n, stated, sha = _payload(f, body[:length]) if len(body) >= length else (None, None, None)
    return pa.table({"file": table["file"][:1], "at": pa.array([pieces[0][0]], pa.int64()), "joined_n": pa.array([n], pa.int64()), "joined_digest": pa.array([stated], pa.string()), "joined_sha256": pa.array([sha], pa.string()), "held": pa.array([len(body) >= length])})


def read_warc(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("response", "revisit")) -> DataFrame:
    """Return record_id, target_uri, page_id, payload_bytes, payload_digest, record_type, refers_to, refers_to_id of the records of the ``kinds``.

    Length and sha-256 are those of the bytes read; a revisit has no bytes, and gives what its header states (its length
    where the writer gave it as X-Payload-Length, else null). page_id and refers_to are the numbers of ``write_warc``'s
    record names, null for other names. Only records on the chain from the start of their file count. A file that ends
    early keeps its whole records; a file that doesn't start with the magic has none. Two records of one name are two
    rows. No files: an error of the reader; files without records: an empty result.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    pieces = saved(lines.mapInArrow(_pieces, PIECES), "warc-pieces")
    splits = pieces.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("held"), F.count_if((F.col("at") == 0) & (F.col("size") == 0)).alias("clean"))
    splits = splits.withColumn("base", F.coalesce(F.sum("held").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    splits = saved(splits, "warc-splits")  # one row for each split
    placed = pieces.join(splits.select("file", "block", "base"), ["file", "block"])
    placed = placed.withColumns({"local": F.col("at"), "at": F.col("base") + F.col("at"), "next": F.col("base") + F.col("next")}).drop("base")
    pointers = placed.where("next is not null").select("file", "block", "at", "next")
    jumps = saved(pointers.groupBy("file", "block").applyInArrow(_leave, "file string, at long, exit long"), "warc-jumps")
    reached = splits.where("block = 0 and clean > 0").select("file", F.lit(len(MAGIC)).cast("long").alias("at"))
    most = splits.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    for _ in range((most - 1).bit_length()):
        reached = saved(reached.union(reached.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at"))).distinct(), "warc-reached")
        then = jumps.select("file", F.col("at").alias("exit"), F.col("exit").alias("far"))
        jumps = saved(jumps.join(then, ["file", "exit"], "left").select("file", "at", F.coalesce("far", "exit").alias("exit")), "warc-jumps")
    entries = saved(pointers.join(reached, ["file", "at"]).select("file", "block", "at"), "warc-entries")
    chain = saved(pointers.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInArrow(_walk, "file string, at long"), "warc-chain")
    records = placed.join(chain, ["file", "at"])
    # Pieces off the chain belong to the record before them in their file, which their offsets tell; their bytes follow by a join.
    broken = records.where("body is not null").select("file").distinct()
    loose = placed.join(broken, "file", "left_semi").join(chain.withColumn("on", F.lit(True)), ["file", "at"], "left")
    loose = saved(loose.where("body is not null or on is null").select("file", "block", "local", "at", "body", "on"), "warc-loose")
    lost = loose.where("body is null")
    if lost.limit(1).count():
        # Payloads that hold whole records: their bytes weren't kept as they might have been records; read them again.
        again = lines.mapInArrow(partial(_pieces, bodies=True), PIECES).select("file", "block", F.col("at").alias("local"), F.col("body").alias("found"))
        loose = loose.join(again.join(lost.select("file", "block", "local"), ["file", "block", "local"], "left_semi"), ["file", "block", "local"], "left").withColumn("body", F.coalesce("body", "found"))
    loose = saved(loose.select("file", "at", "body", "on"), "warc-loose")
    starts = chain.join(broken, "file", "left_semi").join(loose.select("file", "at"), ["file", "at"], "left_anti").select("file", "at", F.lit(True).alias("on"))
    owner = F.max(F.when(F.col("on"), F.col("at"))).over(W.partitionBy("file").orderBy("at"))
    owned = loose.select("file", "at", "on").union(starts).withColumn("owner", owner).where("owner is not null").select("file", "at", "owner")
    joined = owned.join(loose.where("body is not null").select("file", "at", "body"), ["file", "at"]).groupBy("file", "owner").applyInArrow(_joined, "file string, at long, joined_n long, joined_digest string, joined_sha256 string, held boolean")
    records = records.join(joined, ["file", "at"], "left").where("body is null or coalesce(held, false)").where(F.col("kind").isin(*kinds))
    digest = F.when(F.col("kind") == "revisit", F.coalesce("digest", "joined_digest")).otherwise(F.coalesce("sha256", "joined_sha256"))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d{1,19})>$", 1).try_cast("long")
    return records.select("record_id", F.col("uri").alias("target_uri"), page("record_id").alias("page_id"), F.coalesce("n", "joined_n").alias("payload_bytes"), digest.alias("payload_digest"), F.col("kind").alias("record_type"), page("refers_to_id").alias("refers_to"), "refers_to_id")
