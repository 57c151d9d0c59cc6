"""Queries on event logs; streams run to the end of what there is, and their results are read back."""

import uuid
from functools import reduce

from pyspark.sql import functions as F

from foliospark.plans import sqlguard
from foliospark.queries import Tables, query
from foliospark.shared import shared_dir
from foliospark.streaming import events, live


def _shared(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def _log(t: Tables):
    e = t.events.select(F.col("user_id").cast("string").alias("run_id"), "event_type", "ts", "event_id")
    return events.with_seq(e, "run_id", "ts", "event_id")


@query("x1_event_log", "select user_id::varchar as run_id, event_id, cast((epoch_us(ts) // 1000) as varchar) || '-' || (row_number() over (partition by user_id, (epoch_us(ts) // 1000) order by event_id) - 1) as seq from events")
def _(t: Tables):
    return _log(t).select("run_id", "event_id", "seq")


@query("x2_read_after", "with l as (select event_id, (epoch_us(ts) // 1000) as ms, row_number() over (partition by user_id, (epoch_us(ts) // 1000) order by event_id) - 1 as s from events where user_id = 7) select event_id, ms || '-' || s as seq from l where ms > 1705000000000 order by ms, s limit 200")
def _(t: Tables):
    return events.read_after(_log(t).where("run_id = '7'"), "1705000000000-99999").select("event_id", "seq")


@query("x3_last_seq", "with l as (select user_id::varchar as run_id, (epoch_us(ts) // 1000) as ms, row_number() over (partition by user_id, (epoch_us(ts) // 1000) order by event_id) - 1 as s from events) select run_id, arg_max(ms || '-' || s, ms * 100000 + s) as last_seq from l group by 1")
def _(t: Tables):
    return events.last_seq(_log(t)).select("run_id", "last_seq")


@query("x4_stream_counts", "select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 3) as value from events group by 1, 2")
def _(t: Tables):
    """The same windows as a batch; the stream's result is compared with it in the tests."""
    return events.windowed_counts(t.events).withColumn("value", F.round("value", 3))


@query("x4_streamed_copy", "select event_id, user_id, event_type from events")
def _(t: Tables):
    out = _shared(t)
    src = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    q = events.append(src.select("event_id", "user_id", "event_type"), f"{out}/rows", f"{out}/checkpoint")
    q.awaitTermination()
    return t.spark.read.parquet(f"{out}/rows")


def _runs(t: Tables):
    """The events as a stream of runs' events and pieces of replies."""
    src = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    return src.select(F.col("user_id").cast("string").alias("run_id"), "ts", "event_id", "event_type", F.col("props").alias("piece"))


def _replayed(t: Tables, df):
    out = _shared(t)
    live.run_to_end(df, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{out}/rows")


_TAIL = """
with recursive e as (select cast(user_id as varchar) as run_id, event_id, event_type, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as k from events),
w as (
  select run_id, k, 1 as connection, us as began, 1 as n, event_id, event_type, false as timed_out, 0 as n_before, cast(null as bigint) as last_before from e where k = 1
  union all
  select e.run_id, e.k, case when w.event_type = 'error' or e.us >= w.began + 86400000000 then w.connection + 1 else w.connection end,
         case when w.event_type = 'error' or e.us >= w.began + 86400000000 then e.us else w.began end, case when w.event_type = 'error' or e.us >= w.began + 86400000000 then 1 else w.n + 1 end,
         e.event_id, e.event_type, w.event_type <> 'error' and e.us >= w.began + 86400000000, w.n, w.event_id
  from w join e on e.run_id = w.run_id and e.k = w.k + 1),
x as (
  select run_id, connection, n, event_id, event_type as kind, null as status from w
  union all select run_id, connection, n, event_id, 'close', 'error' from w where event_type = 'error'
  union all select run_id, connection - 1, n_before, last_before, 'close', 'timeout' from w where timed_out
  union all select run_id, connection, n, event_id, 'close', 'timeout' from (select * from w qualify row_number() over (partition by run_id order by k desc) = 1)
            where event_type <> 'error' and (began + 86400000000) // 1000 <= (select max(us) // 1000 from e))
select run_id, cast(connection as bigint) as connection, cast(n as bigint) as n, event_id, kind, status from x"""


@query("x4_tail", _TAIL)
def _(t: Tables):
    """Runs followed for a day or to their first error, as a stream with timers."""
    return _replayed(t, live.tail(_runs(t), ("error",), "1 day"))


_PIECES = """
with recursive e as (select cast(user_id as varchar) as run_id, coalesce(props, '') as piece, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as k from events),
w as (
  select run_id, k, piece, cast(0 as bigint) as chunk, us as since, length(piece) as chars, length(piece) >= 64 as closed from e where k = 1
  union all
  select e.run_id, e.k, e.piece, case when w.closed then w.chunk + 1 else w.chunk end, case when w.closed then e.us else w.since end, case when w.closed then length(e.piece) else w.chars + length(e.piece) end,
         case when w.closed then length(e.piece) >= 64 else w.chars + length(e.piece) >= 64 or e.us - w.since >= 3600000000 end
  from w join e on e.run_id = w.run_id and e.k = w.k + 1)
select run_id, chunk, string_agg(piece, '' order by k) as text from w group by 1, 2"""


@query("x5_streamed_flushes", f"{_PIECES} having bool_or(closed) or (min(since) + 3600000000) // 1000 <= (select max(us) // 1000 from e)")
def _(t: Tables):
    """Flushes of a stream with timers: what waits at the end goes out once the watermark is past it."""
    return _replayed(t, live.flush(_runs(t), 64, 3_600_000))


@query("x5_flushes", _PIECES)
def _(t: Tables):
    pieces = t.events.select(F.col("user_id").cast("string").alias("run_id"), "ts", F.col("props").alias("piece"))
    return events.flushes(pieces, 64, 3_600_000)


@query("x6_without_cancelled", "select event_id from events where user_id not in (select c_custkey from customer where c_acctbal < 0)")
def _(t: Tables):
    e = t.events.select("event_id", F.col("user_id").alias("run_id"))
    return events.without_cancelled(e, t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("run_id"))).select("event_id")


@query("x9_state_machine", """
select o_orderkey as run_id, case when (o_orderstatus, wanted) in (('O', 'P'), ('O', 'F'), ('P', 'F')) then wanted else o_orderstatus end as status
from (select *, case o_orderkey % 3 when 0 then 'F' when 1 then 'P' else 'O' end as wanted from orders)""")
def _(t: Tables):
    """Orders are open, then pending, then finished, and never go back."""
    from foliospark.sources.sinks import next_status

    wanted = F.when(F.col("o_orderkey") % 3 == 0, "F").when(F.col("o_orderkey") % 3 == 1, "P").otherwise("O")
    asked = t.orders.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), wanted.alias("wanted"))
    return next_status(asked, {"O": ("P", "F"), "P": ("F",), "F": ()}).select("run_id", "status")


@query("x11_cutoff", "select o_orderkey from orders where year(o_orderdate) > 1996")
def _(t: Tables):
    return t.orders.where(~(F.year("o_orderdate") <= 1996)).select("o_orderkey")


#: Statements of a log, by o_orderkey modulo their number, and whether they may run; %s is the key.
_STATEMENTS = [
    ("SELECT %s", True), ("DROP TABLE t%s", False), ("select a from t union  select %s", False), ("-- comment %s\nSHOW TABLES", True), ("with a as (select %s) select * from a", False),
    ("/* delete %s */ explain select 1", True), ("select * from t where k = %s or 1 = 1", False), ("select %s; drop table t", False), ("select sleep (%s)", False), (" describe t%s", True), ("-- only %s", False),
]


@query("g1_sql_guard", f"select o_orderkey, o_orderkey % {len(_STATEMENTS)} in ({', '.join(str(k) for k, (_, ok) in enumerate(_STATEMENTS) if ok)}) as safe from orders")
def _(t: Tables):
    k = F.col("o_orderkey")
    said = reduce(lambda a, b: a.when(k % len(_STATEMENTS) == b[0], F.format_string(b[1][0], k.cast("string"))), enumerate(_STATEMENTS), F.when(F.lit(False), ""))
    return t.orders.select("o_orderkey", sqlguard.safe(said).alias("safe"))


@query("g2_guarded_query", "select n_regionkey, count(*) as n from nation group by 1")
def _(t: Tables):
    t.nation.createOrReplaceTempView("guarded_nation")
    return sqlguard.run(t.spark, "SELECT n_regionkey, count(*) AS n FROM guarded_nation GROUP BY n_regionkey")


_DESCRIBED = {"nation": ("n_nationkey", "n_name", "n_regionkey"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"), "labels": ("doc_id", "quality", "toxic")}


@query("s25_describe", " union all ".join(f"select '{tab}' as tab, {k} as at, '{c}' as column, (select count(*) from {tab}) as rows, (select count({c}) from {tab}) as filled" for tab, cs in _DESCRIBED.items() for k, c in enumerate(cs)).replace(" as at,", ' as "at",').replace(" as column,", ' as "column",').replace(" as rows,", ' as "rows",'))
def _(t: Tables):
    return sqlguard.describe({name: getattr(t, name) for name in _DESCRIBED}).drop("type")
