"""Usage analytics: active users, rates, categories, and time series without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import time, vectors


def active_users(events: DataFrame, user: str, ts: str, now: Column, days: int = 7) -> DataFrame:
    """(day, users): distinct users of each of the last ``days`` spans of 24 hours, day 0 the last; one pass, no range join."""
    return events.withColumn("day", time.days_before(F.col(ts), now)).where(F.col("day").between(0, days - 1)).groupBy("day").agg(F.count_distinct(user).alias("users"))


def success(df: DataFrame, by: list[str], failed: Column) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(failed)
    return df.groupBy(*by).agg(n.alias("calls"), bad.alias("errors"), vectors.rounded_share(n - bad, n).alias("success_rate"))


def satisfaction(df: DataFrame, by: list[str], liked: Column) -> DataFrame:
    """Share of likes among feedback; 100 where there is none. Rows without feedback have a null ``liked``."""
    n = F.count(liked)
    return df.groupBy(*by).agg(n.alias("feedback"), vectors.rounded_share(F.count_if(liked), n, 100.0).alias("satisfaction"))


def by_category(df: DataFrame, key: Column, names: dict[str, str], size: str) -> DataFrame:
    """(category, n, bytes): mapped names; others as "XYZ File", empty ones as "Other"."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    k = F.lower(F.trim(F.coalesce(key, F.lit(""))))
    cat = F.when(k == "", "Other").otherwise(F.coalesce(F.element_at(table, k), F.concat(F.upper(k), F.lit(" File"))))
    return df.groupBy(cat.alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(size, F.lit(0))).alias("bytes"))


def gap_filled(df: DataFrame, ts: str, category: str, value: Column, last_day: str, buckets: int = 14, shift_hours: int = time.SHIFT_HOURS) -> DataFrame:
    """(bucket, category, total): every day of the last ``buckets`` for every category, zeros included."""
    day = F.to_date(F.col(ts) + F.make_dt_interval(hours=F.lit(shift_hours)))
    end = F.to_date(F.lit(last_day))
    seen = df.withColumn("_d", day).where(F.col("_d").between(F.date_sub(end, buckets - 1), end))
    sums = seen.groupBy("_d", F.col(category).alias("_c")).agg(value.alias("total"))
    cats = seen.select(F.col(category).alias("_c")).distinct()
    grid = cats.select("_c", F.explode(F.sequence(F.date_sub(end, buckets - 1), end)).alias("_d"))
    out = grid.join(sums, ["_d", "_c"], "left")
    return out.select(F.date_format("_d", "yyyy-MM-dd").alias("bucket"), F.col("_c").alias("category"), F.coalesce("total", F.lit(0)).alias("total"))


def peak(series: DataFrame) -> DataFrame:
    """The bucket with the largest total, the earliest of equal ones; the average over buckets; the sum."""
    per = series.groupBy("bucket").agg(F.sum("total").alias("total"))
    return per.agg(F.min_by(F.struct("bucket", "total"), F.struct(-F.col("total"), F.col("bucket"))).alias("p"), F.sum("total").alias("total_count"), F.avg("total").alias("average")).select(F.col("p.bucket").alias("peak_bucket"), F.col("p.total").alias("peak_total"), "total_count", F.round("average", 2).alias("average"))
