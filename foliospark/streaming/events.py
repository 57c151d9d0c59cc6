"""Append-only event logs: cursors, windows, terminal states and buffered flushes, as batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.functions.time import millis

START = "0-0"


def cursor(c: Column) -> Column:
    """ "ms-seq" as it is; anything else is the start."""
    text = c.cast("string")
    return F.when(text.rlike(r"^\d+-\d+$"), text).otherwise(START)


def position(c: Column) -> Column:
    ends = F.split(cursor(c), "-")
    return F.struct(F.get(ends, F.lit(0)).cast("long").alias("ms"), F.get(ends, F.lit(1)).cast("long").alias("seq"))


def read_after(log: DataFrame, after: object, limit: int = 200) -> DataFrame:
    """Events behind the cursor, in order. log: seq as "ms-seq"."""
    at = position(F.lit(None if after is None else str(after)))
    return log.where(position(F.col("seq")) > at).orderBy(position(F.col("seq"))).limit(limit)


def last_seq(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.max_by("seq", position(F.col("seq"))).alias("last_seq"))


def with_seq(events: DataFrame, run: str, ts: str, order: str) -> DataFrame:
    """Ids as the log would give them: milliseconds, and a count of the run's events of that millisecond."""
    from pyspark.sql import Window

    ms = millis(F.col(ts))
    n = F.row_number().over(Window.partitionBy(run, ms).orderBy(order)) - 1
    return events.withColumn("seq", F.concat_ws("-", ms.cast("string"), n.cast("string")))


def windowed_counts(events: DataFrame, size: str = "1 day", late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, event_type, n, value) of tumbling or sliding windows; ``late`` sets the watermark of a stream."""
    df = events.withWatermark("ts", late) if late else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return df.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes all that a stream has now and ends; a later call goes on from there."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_batches(df: DataFrame, merge, checkpoint: str) -> StreamingQuery:
    """Every micro-batch goes to ``merge(batch, id)``; the id makes repeats of a batch recognisable."""
    return df.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_FLUSH = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("chunk", T.LongType()), T.StructField("text", T.StringType())])


def flushes(deltas: DataFrame, chars: int = 512, millis: int = 100) -> DataFrame:
    """(run_id, chunk, text): a run's pieces joined until they have ``chars`` characters or span ``millis``.

    deltas: run_id, ts, piece; a batch. A run's pieces are one reply, small by nature.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out, buf, since, size = [], [], None, 0
        for ts, piece in part.sort_values("ts")[["ts", "piece"]].itertuples(index=False):
            since = ts if since is None else since
            buf.append(piece or "")
            size += len(buf[-1])
            if size >= chars or (ts - since).total_seconds() * 1000 >= millis:
                out.append("".join(buf))
                buf, since, size = [], None, 0
        if buf:
            out.append("".join(buf))
        return pd.DataFrame({"run_id": part.run_id.iloc[0], "chunk": range(len(out)), "text": out})

    return deltas.groupBy("run_id").applyInPandas(run, _FLUSH)


_STATUS = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("status", T.StringType()), T.StructField("events", T.LongType())])


def tail(stream: DataFrame, terminal: tuple[str, ...] = ("completed", "failed", "cancelled"), idle: str = "30 minutes") -> DataFrame:
    """(run_id, status, events) once for each run: at its terminal event, or "timeout" after ``idle`` without events.

    stream: run_id, ts, event_type.
    """
    minutes = int(idle.split()[0])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n = state.get[0]
            state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": ["timeout"], "events": [n]})
            return
        n, last, end = state.get[0] if state.exists else 0, None, None
        for part in parts:
            part = part.sort_values("ts")
            n += len(part)
            last = part.ts.iloc[-1]
            hit = part.event_type[part.event_type.isin(terminal)]
            end = hit.iloc[0] if len(hit) and end is None else end
        if end is not None:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"run_id": [key[0]], "status": [end], "events": [n]})
            return
        state.update((n,))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + minutes * 60_000)

    return stream.withWatermark("ts", idle).groupBy("run_id").applyInPandasWithState(step, _STATUS, "n long", "append", GroupStateTimeout.EventTimeTimeout)


def without_cancelled(stream: DataFrame, cancelled: DataFrame) -> DataFrame:
    return stream.join(cancelled.select("run_id"), "run_id", "left_anti")


def from_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
