"""Structured Streaming jobs over files of lines or events.

Each takes a streaming DataFrame; ``drain`` runs one to the end of what is there. Event times are cast to TIMESTAMP in
UTC, so watermarks apply.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def tail(spark: SparkSession, path: str, schema: str, files_each: int = 1, fmt: str = "parquet") -> DataFrame:
    """A stream of a folder's files, ``files_each`` a tick; the checkpoint is the cursor, so a failed tick is read again."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_each).load(path)


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append", store: tuple[str, str] | None = None) -> StreamingQuery:
    """Process everything that is there, in ticks, then end. The sink gets each tick's rows and its number; numbers repeat after a failure.

    ``store`` is the setting and class of a state store other than the session's; a query takes the settings with it when it starts.
    """
    conf = stream.sparkSession.conf
    own = conf.get(store[0], None) if store else None
    if store:
        conf.set(*store)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    finally:
        if store:
            conf.unset(store[0]) if own is None else conf.set(store[0], own)
    query.awaitTermination()
    return query


def into(spark: SparkSession, stream: DataFrame, out: str, mode: str = "append", store: tuple[str, str] | None = None) -> DataFrame:
    """``drain`` into a table with one folder for each tick, overwritten if a tick is repeated; the rows and their ``tick``.

    The cursor stands beside the table, so a later call with the same ``out`` goes on with the files that are new.
    """

    def write(rows: DataFrame, tick: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/data/tick={tick}")

    drain(stream, write, f"{out}/cursor", mode, store)
    return spark.read.schema(StructType([*stream.schema.fields, StructField("tick", LongType())])).parquet(f"{out}/data")


def _ticks(spark: SparkSession, stream: DataFrame, base: str, mode: str) -> DataFrame:
    return into(spark, stream, f"{base.rstrip('/')}/siftlog/stream-{uuid.uuid4().hex}", mode)


def collected(spark: SparkSession, stream: DataFrame, base: str, mode: str = "append") -> DataFrame:
    """The rows of all ticks."""
    return _ticks(spark, stream, base, mode).select(*stream.columns)


def settled(spark: SparkSession, stream: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """An aggregate in update mode, at the end of the input: of each of the ``keys`` only the row of the last tick that changed it."""
    last = _ticks(spark, stream, base, "update").groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "tick").alias("r"))
    return last.select("r.*")


def final(spark: SparkSession, stream: DataFrame, base: str) -> DataFrame:
    """An aggregate in complete mode: what the last tick gave."""
    rows = _ticks(spark, stream, base, "complete")
    return rows.join(rows.agg(F.max("tick").alias("tick")), "tick").select(*stream.columns)


def manifest(spark: SparkSession, stream: DataFrame, base: str, key: str, first: int = 0) -> DataFrame:
    """One row for each tick: tick, rows, lo, hi of the running ``key``, and what is missing.

    ``gap``: values missing inside the tick; ``skipped``: values between the tick before and this one; ``truncated_head``:
    values from ``first`` on before the first tick.
    """
    out = f"{base.rstrip('/')}/siftlog/manifest-{uuid.uuid4().hex}"

    def write(rows: DataFrame, tick: int) -> None:
        row = rows.agg(F.lit(tick).cast("long").alias("tick"), F.count("*").alias("rows"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        row.withColumn("gap", F.col("hi") - F.col("lo") + 1 - F.col("rows")).write.mode("overwrite").parquet(f"{out}/data/tick_id={tick}")

    drain(stream, write, f"{out}/cursor")
    before = F.lag("hi").over(W.orderBy("tick"))  # one row for each tick
    rows = spark.read.parquet(f"{out}/data").select("tick", "rows", "lo", "hi", "gap")
    return rows.withColumns({"skipped": F.coalesce(F.col("lo") - before - 1, F.lit(0)), "truncated_head": F.when(before.isNull(), F.col("lo") - first).otherwise(0)})


def _until(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if late else events


def tumbling(events: DataFrame, keys: list[str], width: str = "10 minutes", late: str | None = "1 hour") -> DataFrame:
    """keys, begin, n in windows of ``width``; events later than ``late`` are dropped, with None none are (for bounded input)."""
    w = _until(events, late).groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("window.start").alias("begin"), "n")


def tallied(spark: SparkSession, stream: DataFrame, base: str, keys: list[str]) -> DataFrame:
    """keys, n: the rows of each of the ``keys``, at the end of the input. Ticks are counted alone and added up afterwards, so there is no state."""
    out = f"{base.rstrip('/')}/siftlog/tally-{uuid.uuid4().hex}"
    count = lambda rows: rows.groupBy(*keys).agg(F.count("*").alias("n"))
    drain(stream, lambda rows, tick: count(rows).write.mode("overwrite").parquet(f"{out}/data/tick={tick}"), f"{out}/cursor")
    ticks = spark.read.schema(StructType([*stream.select(*keys).schema.fields, StructField("n", LongType())])).parquet(f"{out}/data")
    return ticks.groupBy(*keys).agg(F.sum("n").alias("n"))


def with_pane(events: DataFrame, slide: str = "5 minutes") -> DataFrame:
    """The events with ``begin``, that of their pane: windows slide by a pane."""
    return events.withColumn("begin", F.window("ts", slide)["start"])


def source_counts(events: DataFrame, key: str, source: str, slide: str = "5 minutes", late: str | None = "1 hour") -> DataFrame:
    """key, begin, source, n in panes; a state row is one source of a pane, so no set of sources grows. ``late`` as for ``tumbling``."""
    w = _until(events, late).groupBy(F.window("ts", slide), key, source).agg(F.count("*").alias("n"))
    return w.select(key, F.col("window.start").alias("begin"), source, "n")


def threshold_alerts(counts: DataFrame, key: str, source: str, failures: int, sources: int, panes: int = 12, seconds: int = 300) -> DataFrame:
    """key, begin, n, sources of the windows with at least ``failures`` events from ``sources`` sources; ``counts`` has a row for each key, source and pane.

    Windows hold ``panes`` panes of so many ``seconds`` and slide by one. A pane counts from the window that it ends to the one that it
    begins; its source counts in those of them that don't hold the source's pane before. So each pane only sets where sums
    begin and end, and windows are made of these sums, a row for each pane of a key.
    """
    p = counts.select(key, source, F.expr(f"unix_seconds(begin) div {seconds}").alias("p"), "n")
    prev = F.lag("p").over(W.partitionBy(key, source).orderBy("p"))
    p = p.withColumn("new", F.when(F.col(source).isNotNull(), F.greatest(F.col("p") - (panes - 1), prev + 1)))
    edge = lambda at, n, s: F.struct(at.alias("at"), n.alias("n"), F.lit(s).cast("long").alias("s"))
    zero, end = F.lit(0).cast("long"), F.col("p") + 1
    edges = F.array(edge(F.col("p") - (panes - 1), F.col("n"), 0), edge(end, -F.col("n"), 0), edge(F.col("new"), zero, 1), edge(F.when(F.col("new").isNotNull(), end), zero, -1))
    e = p.select(key, F.inline(edges)).where("at is not null").groupBy(key, "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by = W.partitionBy(key).orderBy("at")
    upto = by.rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.select(key, "at", F.sum("n").over(upto).alias("n"), F.sum("s").over(upto).alias("sources"), F.lead("at").over(by).alias("next"))
    e = e.where((F.col("n") >= max(failures, 1)) & (F.col("sources") >= sources))
    return e.select(key, F.explode(F.sequence("at", F.col("next") - 1)).alias("at"), "n", "sources").select(key, F.timestamp_seconds(F.col("at") * seconds).alias("begin"), "n", "sources")


def sessions(events: DataFrame, keys: list[str], gap: str = "30 minutes", late: str | None = "1 hour") -> DataFrame:
    """keys, first, last, n of runs of events with no pause of ``gap``; without ``late`` for batches and complete mode."""
    w = _until(events, late).groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return w.select(*keys, "first", "last", "n")


def last_seen(events: DataFrame, key: str) -> DataFrame:
    """key, seen, n: the newest event of each key so far, in update mode; a key that no tick brings keeps its row."""
    return events.groupBy(key).agg(F.max("ts").alias("seen"), F.count("*").alias("n"))


def stale(seen: DataFrame, after: str) -> DataFrame:
    """The rows of ``last_seen`` and whether they are ``after`` or more behind the newest of all."""
    newest = seen.agg(F.max("seen").alias("newest"))
    return seen.join(F.broadcast(newest)).withColumn("stale", F.col("seen") <= F.col("newest") - F.expr(f"interval {after}")).drop("newest")  # one row


def newcomers(events: DataFrame, key: str, actor: str) -> DataFrame:
    """key, actor: a row for each actor when it first appears under its key.

    A state row is one (key, actor), so the actors of a key are spread over all tasks and none is left out. A running
    number of a key's actors can be counted in the written table.
    """
    return events.select(F.col(key).cast("string").alias(key), F.col(actor).cast("string").alias(actor)).dropDuplicates([key, actor])


def frames(lines: DataFrame, start: str, quiet: str | None = "10 minutes") -> DataFrame:
    """path, line_start, text of records that begin at lines matching ``start``; the open record of a path is the state.

    A record is emitted when the next one starts, or when its path is quiet for ``quiet`` of processing time; without
    ``quiet`` the last one stays open, and a run to the end of the input ends.
    """
    opens = re.compile(start)
    wait = pd.Timedelta(quiet) if quiet else None

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at, text = state.get
            state.remove()
            yield pd.DataFrame([(k[0], at, text)], columns=["path", "line_start", "text"])
            return
        held = [pd.DataFrame([state.get], columns=["line_no", "text"])] if state.exists else []
        new = pd.concat([*held, pd.concat(list(batches))[["line_no", "text"]].sort_values("line_no")], ignore_index=True)
        begins = new["text"].str.contains(opens)
        begins.iloc[0] = True  # the open record, or what stands before the first start
        records = new.groupby(begins.cumsum()).agg(line_start=("line_no", "first"), text=("text", " ".join))
        state.update((int(records["line_start"].iloc[-1]), records["text"].iloc[-1]))
        if wait is not None:
            state.setTimeoutDuration(int(wait.total_seconds() * 1000))
        yield pd.DataFrame({"path": k[0], "line_start": records["line_start"].iloc[:-1], "text": records["text"].iloc[:-1]})

    return lines.groupBy("path").applyInPandasWithState(step, "path string, line_start long, text string", "line_start long, text string", "append", GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout)
