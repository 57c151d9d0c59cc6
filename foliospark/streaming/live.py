"""Live streams with state and timers: following runs to their end, and joining a reply's pieces into flushes.

Time is the events' own, so a replay of a stream gives what the live stream gave. Events of a key are put in order within a
micro-batch; timers fire when the watermark has passed them, and state goes with the run it is about.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("completed", "failed", "cancelled")


def _timed(stream: DataFrame, late: str) -> DataFrame:
    """The stream by run, with its watermark, and us, the microseconds of ts since the epoch."""
    at = F.col("ts").cast("timestamp")
    return stream.withColumns({"ts": at, "us": F.unix_micros(at)}).withWatermark("ts", late)


class Tail(StatefulProcessor):
    """Events of a run as they come, numbered within a connection, and a row that closes the connection. Times are microseconds."""

    def __init__(self, terminal: tuple[str, ...], longest: int):
        self.terminal, self.longest = terminal, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "connection long, began long, n long, last long")

    def _close(self, key: tuple, connection: int, n: int, last: int, status: str) -> tuple:
        return key[0], connection, n, last, "close", status

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        part = pd.concat(list(rows)).sort_values(["us", "event_id"])
        state = self.open.get() if self.open.exists() else None
        # a run without a connection keeps the number of its last one
        connection, began, n, _ = state if state else (0, -1, 0, -1)
        armed, out = began, []
        for us, event_id, kind in part[["us", "event_id", "event_type"]].itertuples(index=False):
            at = us
            if began >= 0 and at >= began + self.longest:
                out.append(self._close(key, connection, n, last, "timeout"))
                began = -1
            if began < 0:
                connection, began, n = connection + 1, at, 0
            n, last = n + 1, event_id
            out.append((key[0], connection, n, event_id, kind, None))
            if kind in self.terminal:
                out.append(self._close(key, connection, n, event_id, kind))
                began = -1
        if armed != began:
            if armed >= 0:
                self.handle.deleteTimer((armed + self.longest) // 1000)
            if began >= 0:
                self.handle.registerTimer((began + self.longest) // 1000)
        self.open.update((connection, began, n, last))
        yield pd.DataFrame(out, columns=["run_id", "connection", "n", "event_id", "kind", "status"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        connection, began, n, last = self.open.get()
        if began >= 0:
            yield pd.DataFrame([self._close(key, connection, n, last, "timeout")], columns=["run_id", "connection", "n", "event_id", "kind", "status"])
        self.open.update((connection, -1, 0, -1))

    def close(self) -> None:
        pass


def tail(stream: DataFrame, terminal: tuple[str, ...] = TERMINAL, longest: str = "30 minutes", late: str = "0 seconds") -> DataFrame:
    """(run_id, connection, n, event_id, kind, status): each event as the n-th of its connection, then a row "close".

    A connection begins with an event and ends with a terminal one, with the first event ``longest`` or more after its beginning, or
    when the watermark has come that far; the next event of the run begins another one. stream: run_id, ts, event_id, event_type.
    """
    micros = pd.Timedelta(longest) // pd.Timedelta(microseconds=1)
    schema = "run_id string, connection long, n long, event_id long, kind string, status string"
    return _timed(stream, late).groupBy("run_id").transformWithStateInPandas(Tail(terminal, micros), schema, "Append", "EventTime")


class Flush(StatefulProcessor):
    """Pieces joined until there are enough characters or enough time has passed. Pieces wait in a list; only their sum is looked at."""

    def __init__(self, chars: int, millis: int):
        self.chars, self.micros = chars, millis * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "chunk long, since long, chars long")
        self.pieces = handle.getListState("pieces", "piece string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        part = pd.concat(list(rows)).sort_values(["us", "event_id"])
        chunk, since, chars = self.sums.get() if self.sums.exists() else (0, -1, 0)
        armed, fresh, out = since, [], []
        for us, piece in part[["us", "piece"]].itertuples(index=False):
            at, piece = us, piece or ""
            since = at if since < 0 else since
            fresh.append(piece)
            chars += len(piece)
            if chars >= self.chars or at - since >= self.micros:
                waiting = [x[0] for x in self.pieces.get()] if armed >= 0 and not out else []
                out.append((key[0], chunk, "".join([*waiting, *fresh])))
                chunk, since, chars, fresh = chunk + 1, -1, 0, []
        if out and armed >= 0:
            self.pieces.clear()
        if fresh:
            self.pieces.appendList([(x,) for x in fresh])
        if armed != since:
            if armed >= 0:
                self.handle.deleteTimer((armed + self.micros) // 1000)
            if since >= 0:
                self.handle.registerTimer((since + self.micros) // 1000)
        self.sums.update((chunk, since, chars))
        yield pd.DataFrame(out, columns=["run_id", "chunk", "text"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802,N803
        chunk, since, _ = self.sums.get()
        if since >= 0:
            yield pd.DataFrame([(key[0], chunk, "".join(x[0] for x in self.pieces.get()))], columns=["run_id", "chunk", "text"])
            self.pieces.clear()
            self.sums.update((chunk + 1, -1, 0))

    def close(self) -> None:
        pass


def flush(stream: DataFrame, chars: int = 512, millis: int = 100, late: str = "0 seconds") -> DataFrame:
    """(run_id, chunk, text): pieces joined until they have ``chars`` characters, span ``millis``, or the watermark is ``millis`` past the first one.

    stream: run_id, ts, event_id, piece.
    """
    return _timed(stream, late).groupBy("run_id").transformWithStateInPandas(Flush(chars, millis), "run_id string, chunk long, text string", "Append", "EventTime")


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """Timers need the state store that keeps its rows on disk; a query takes the setting with it when it starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to files all that the stream gives now, and the timers that are due; a later call goes on from there."""
    with _rocks(df.sparkSession):
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
