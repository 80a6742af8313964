"""Record framing of a stream as a stateful processor: the open record of a path is its state, a timer closes it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "path string, line_start long, line_end long, text string"
_OPEN = "line_start long, line_end long, at long, text string"


class Framing(StatefulProcessor):
    """A line that matches ``start`` begins a record, and so does one that comes ``quiet`` ms or more after the line before it.

    The timer stands ``quiet`` ms behind the path's last line, in event time; when the watermark has passed it, the
    open record is written and its state goes. So what a path's records are doesn't depend on the ticks that bring its lines.
    """

    def __init__(self, start: str, quiet: int):
        self.start, self.quiet = start, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", _OPEN)
        self.pattern = re.compile(self.start)

    def _rearm(self, at: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        lines = pd.concat(list(rows))[["line_no", "at", "text"]].sort_values("line_no", ignore_index=True)
        first, at, texts, done = (held[0], held[2], [held[3]], []) if held else (None, None, [], [])
        last = held[1] if held else None
        for number, now, text in lines.itertuples(index=False):
            if texts and (self.pattern.search(text) or now - at >= self.quiet):
                done.append((key[0], first, last, " ".join(texts)))
                texts = []
            if not texts:
                first = number
            texts.append(text)
            last, at = number, now
        self.open.update((int(first), int(last), int(at), " ".join(texts)))
        self._rearm(int(at) + self.quiet)
        yield pd.DataFrame(done, columns=["path", "line_start", "line_end", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        first, last, _, text = self.open.get()
        self.open.clear()
        yield pd.DataFrame([(key[0], first, last, text)], columns=["path", "line_start", "line_end", "text"])

    def close(self) -> None:
        pass


#: The state store that stateful processors need; a query keeps the one that it began with.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def framed(lines: DataFrame, start: str, quiet: str = "10 minutes", delay: str = "1 minute") -> DataFrame:
    """path, line_start, line_end, text of a stream of path, line_no, ts, text, whose paths each bring their lines in order.

    Records end as ``Framing`` says; the last record of a path that isn't quiet yet stays open, also over a restart. Lines
    at or below the watermark, ``delay`` behind the newest line of all, come too late and are dropped.
    """
    wait = int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = lines.withWatermark("ts", delay).selectExpr("path", "line_no", "ts", "unix_millis(ts) as at", "text")
    return rows.groupBy("path").transformWithStateInPandas(Framing(start, wait), OUT, "Append", "EventTime")
