"""Keep-first, best-of, latest, top-k, paging, upserts and set operations on DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.shared import shared_dir


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that there are, in the order asked for."""
    return df.select(*[f"`{c}`" for c in columns if c in df.columns])


def pick(df: DataFrame, candidates: list[str]) -> str | None:
    """The first candidate that is a column, whatever its case; else the first column that contains one."""
    lower = {c.lower(): c for c in df.columns}
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    return next((own for c in candidates for low, own in lower.items() if c.lower() in low), None)


def conform(df: DataFrame, schema: T.StructType, default: object = "") -> DataFrame:
    """The schema's columns, missing ones filled with a default."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`") if f.name in have else F.lit(default)).cast(f.dataType).alias(f.name) for f in schema])


def rank(df: DataFrame, by: list[str | Column], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top_per_group(df: DataFrame, by: list[str | Column], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group. Spark keeps k rows of a group in each task before the shuffle (WindowGroupLimit)."""
    return rank(df, by, order, "_rank").where(F.col("_rank") <= k).drop("_rank")


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str], empty_is_unique: bool = True) -> DataFrame:
    """One row for each key: the first in order. Rows whose key is empty are kept all, or collapse as one key.

    A partial minimum precedes the shuffle, so a key on a third of all rows is no hot spot.
    """
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    blank = reduce(lambda a, b: a & b, [F.coalesce(c.cast("string"), F.lit("")) == "" for c in cols])
    first = lambda d: d.groupBy(*[c.alias(f"_k{i}") for i, c in enumerate(cols)]).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r")).select("_r.*")
    if not empty_is_unique:
        return first(df)
    return first(df.where(~blank)).unionByName(df.where(blank))


def latest(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last state of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*by)).alias("_r")).select(*keys, "_r.*")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target with the last incoming row of each key in place of its own; rows without a key don't come in."""
    good = reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(k).cast("string")), F.lit("")) != "" for k in keys])
    new = latest(incoming.where(good), keys, [order]).drop(order)
    return target.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    return target.unionByName(incoming.dropDuplicates(keys).join(target, keys, "left_anti"), allowMissingColumns=True)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of a page by sort and limit; no window over all rows."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    n = F.count(F.lit(1))
    pages = F.ceil(n / F.lit(size))
    return df.agg(n.alias("total"), pages.alias("pages")).select("total", "pages", (F.lit(number) < F.col("pages")).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def pinned_first(df: DataFrame, pinned: Column, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """All pinned rows, then others up to the limit; the offset skips others only."""
    first = df.where(pinned).withColumn("grp", F.lit(0))
    n = first.count()
    rest = df.where(~F.coalesce(pinned, F.lit(False))).orderBy(*order).offset(offset).limit(max(0, limit - n)).withColumn("grp", F.lit(1))
    return first.unionByName(rest)


def sample_by_hash(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the same ones on every run and under any partitioning."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def matching(**wanted: object) -> Column:
    """Conjunction of the predicates that are asked for: None and "all" ask for nothing, lists for membership."""
    preds = [F.col(k).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in wanted.items() if v is not None and v != "all"]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def either_key_join(left: DataFrame, right: DataFrame, left_key: str, right_keys: list[str], right_id: str, how: str = "inner") -> DataFrame:
    """left joined where its key equals any of right's keys: one equi-join for each, a right row once for a left row."""
    from foliospark.operators.linkage import with_id

    base = with_id(left, "_l")
    hits = reduce(DataFrame.unionByName, [base.select("_l", F.col(left_key).cast("string").alias("_k")).join(right.select(F.col(k).cast("string").alias("_k"), F.col(right_id).alias("_rid")), "_k").select("_l", "_rid") for k in right_keys]).distinct()
    return base.join(hits, "_l", how).join(right.withColumnRenamed(right_id, "_rid2"), F.col("_rid") == F.col("_rid2"), how).drop("_l", "_rid").withColumnRenamed("_rid2", right_id)


def fill_rates(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, filled, rate) in one pass."""
    columns = columns or df.columns
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f"`{c}`").alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("filled")) for c in columns])
    return counted.select("_n", F.inline(pairs)).select("column", "filled", F.when(F.col("_n") > 0, F.round(100.0 * F.col("filled") / F.col("_n"), 2)).otherwise(0.0).alias("rate"))


def mode_or_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value that isn't empty; of equally frequent ones the earliest; null if there is none."""
    v = F.nullif(F.trim(F.col(value).cast("string")), F.lit(""))
    per = df.groupBy(*keys, v.alias("_v")).agg(F.count(v).alias("_n"), F.min(order).alias("_o"))
    return per.groupBy(*keys).agg(F.max_by("_v", F.struct("_n", -F.col("_o"))).alias(value))


def prefix_by_size(df: DataFrame, order: list[Column], most: int, size: Column) -> DataFrame:
    """Rows in order while their sizes sum up to at most ``most``; for results already cut to what a client gets."""
    return df.withColumn("_s", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_s") <= most).drop("_s")


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and the lineage cut, which would else grow by a power over the rounds."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def empty_like(spark: SparkSession, names: list[str]) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in names]))
