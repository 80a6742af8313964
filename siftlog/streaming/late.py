"""Windows over a stream with a watermark, and the rows that came too late for them, kept in a table beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlog.streaming.jobs import drain


def _horizons(spark: SparkSession, out: str, before: int, delay: str) -> DataFrame:
    """One row: the watermark below which tick ``before + 2`` drops rows, null before there is one."""
    seen = spark.read.schema("newest timestamp, tick long").parquet(f"{out}/horizon")
    return seen.where(F.col("tick") <= before).agg((F.max("newest") - F.expr(f"interval {delay}")).alias("horizon"))


def windowed(spark: SparkSession, events: DataFrame, keys: list[str], row: str, out: str, width: str = "1 day", delay: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """(keys, begin, n; keys, row, ts, tick) of all ticks: closed windows, and late rows. Runs to the end of what is there.

    Rows of one ``row`` number within ``delay`` of each other count once. A window is written when the watermark, ``delay``
    behind the newest event of earlier ticks, has passed its end; then its state goes, and so does that of row numbers, so state is as large
    as ``delay`` and ``width`` and not as the stream. The engine drops what is at or below the watermark of the tick
    before; the same rows are found again in the tick and kept in ``late``, and each tick's number of them must be the engine's. Windows that
    the watermark hasn't passed stay open in the state, for the next run with the same ``out``. ts must not be null.
    """
    marked = events.withWatermark("ts", delay)
    counted = marked.dropDuplicatesWithinWatermark([row]).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count("*").alias("n"))
    closed = counted.select(F.lit(True).alias("closed"), *keys, F.col("w.start").alias("ts"), F.lit(None).cast(events.schema[row].dataType).alias(row), "n")
    came = events.select(F.lit(False).alias("closed"), *keys, "ts", row, F.lit(None).cast("long").alias("n"))

    def sink(rows: DataFrame, tick: int) -> None:
        own = rows.sparkSession
        rows.write.mode("overwrite").partitionBy("closed").parquet(f"{out}/rows/tick={tick}")  # once: the plan holds state
        here = own.read.schema(rows.schema).parquet(f"{out}/rows/tick={tick}").where("not closed")
        here.agg(F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{out}/horizon/tick={tick}")
        late = here.join(F.broadcast(_horizons(own, out, tick - 2, delay)), F.col("ts") <= F.col("horizon"))  # one row
        late.select(*keys, row, "ts").write.mode("overwrite").parquet(f"{out}/late/tick={tick}")

    query = drain(closed.unionByName(came), sink, f"{out}/cursor")
    kinds = {f.name: f.dataType.simpleString() for f in came.schema.fields}
    ddl = lambda *names: ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", tick long"
    rows = spark.read.schema(ddl("closed", *keys, "ts", row, "n")).parquet(f"{out}/rows")
    late = spark.read.schema(ddl(*keys, row, "ts")).parquet(f"{out}/late")
    dropped = {p.batchId: sum(o.numRowsDroppedByWatermark for o in p.stateOperators) for p in query.recentProgress}
    found = {r["tick"]: r["count"] for r in late.where(F.col("tick").isin(*dropped)).groupBy("tick").count().collect()} if dropped else {}  # a row a tick
    if any(found.get(tick, 0) != n for tick, n in dropped.items()):
        raise RuntimeError(f"the engine dropped {dropped} late rows by tick, found were {found}")
    return rows.where("closed").select(*keys, F.col("ts").alias("begin"), "n"), late
