"""Documents dealt into chunks, with one document standing for its exact copies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlog.llm.bytetext import text_buffers
from siftlog.llm.shared import chunk_of, chunks_for, picked, saved

#: The columns of the side table that meets the texts of a chunk; level -1 names its standing documents.
SIDE = "chunk int, level int, digest string, doc_id long, copies long, part int, counts binary"


@dataclass
class Standing:
    """members: doc_id, digest, n_bytes of every row; texts: chunk, doc_id, digest, text; side: rows of SIDE; total: bytes."""

    members: DataFrame
    texts: DataFrame
    side: DataFrame
    total: int


def stand(docs: DataFrame, id_col: str, text_col: str, chunk_bytes: int, name: str) -> Standing:
    """Null texts are empty. Of equal texts the least doc_id stands; chunks are dealt by doc_id and digest, so that copies, rows of one id and rows without an id spread."""
    docs = picked(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "digest": F.md5("text"), "n_bytes": F.octet_length("text").cast("long")})
    members = saved(docs.select("doc_id", "digest", "n_bytes"), f"{name}-members")
    total = members.agg(F.sum("n_bytes")).first()[0] or 0
    chunks = chunks_for(total, chunk_bytes)
    same = members.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    side = same.select(chunk_of("doc_id", "digest", chunks=chunks).alias("chunk"), F.lit(-1).alias("level"), "digest", "doc_id", "copies", F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("counts"))
    return Standing(members, docs.select(chunk_of("doc_id", "digest", chunks=chunks).alias("chunk"), "doc_id", "digest", "text"), side, total)


def answered(counts: DataFrame, level: int) -> DataFrame:
    """Rows of ``packed.ANSWERED`` as rows of SIDE."""
    none = F.lit(None)
    return counts.select("chunk", F.lit(level).alias("level"), none.cast("string").alias("digest"), none.cast("long").alias("doc_id"), none.cast("long").alias("copies"), "part", "counts")


def at_level(side: pa.Table, level: int) -> pa.Table:
    return side.filter(pc.equal(side["level"], level))


def standing_texts(texts: pa.Table, side: pa.Table) -> tuple[list[tuple[str, int, int]], np.ndarray, np.ndarray]:
    """((digest, doc_id, copies) of each standing document of a chunk, data, offsets), in an order that reruns keep."""
    keep = at_level(side, -1)
    own = {d: (d, doc, n) for d, doc, n in zip(keep["digest"].to_pylist(), keep["doc_id"].to_pylist(), keep["copies"].to_pylist(), strict=True)}
    at: dict[str, int] = {}
    for i, (d, doc) in enumerate(zip(texts["digest"].to_pylist(), texts["doc_id"].to_pylist(), strict=True)):
        if d in own and own[d][1] == doc:
            at.setdefault(d, i)
    order = sorted(at)
    data, offsets = text_buffers(texts["text"].take(pa.array([at[d] for d in order], pa.int64())))
    return [own[d] for d in order], data, offsets
