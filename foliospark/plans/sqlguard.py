"""Read-only SQL: what may run, for how long, and how much of the result comes back."""

from __future__ import annotations

import re
import threading
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First words that may run, and patterns that may not occur.
ALLOWED = ("SELECT", "SHOW", "DESCRIBE", "EXPLAIN")
FORBIDDEN = (
    r"\bor\s+1\s*=\s*1\b", r"\bunion\s+select\b", r"\bexec\s*\(", r"\bxp_cmdshell\b", r"\bsleep\s*\(", r"\bbenchmark\s*\(",
    r"\bwaitfor\s+delay\b", r"\b;\s*drop\b", r"\b;\s*delete\b", r"\b;\s*update\b", r"\b;\s*insert\b",
)


def is_safe(sql: str | None) -> bool:
    """By the first word and the patterns, after comments are taken out."""
    bare = re.sub(r"/\*.*?\*/", "", re.sub(r"--.*$", "", sql or "", flags=re.M)).strip()
    first = re.match(r"\w+", bare)
    return bool(first) and first[0].upper() in ALLOWED and not any(re.search(p, bare, re.I) for p in FORBIDDEN)


def safe(sql: Column) -> Column:
    """``is_safe`` for a column of statements, as from a log."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(sql, F.lit("")), r"(?m)--.*$", ""), r"/\*.*?\*/", "")
    bare = F.regexp_replace(bare, r"^\s+|\s+$", "")
    first = F.upper(F.regexp_extract(bare, r"^(\w+)", 1))
    bad = reduce(lambda a, b: a | b, [bare.rlike(f"(?i){p}") for p in FORBIDDEN])
    return first.isin(*ALLOWED) & ~bad


def describe(tables: dict[str, DataFrame]) -> DataFrame:
    """(tab, at, column, type, rows, filled): the columns of tables, how many rows these have and in how many a column is filled; one pass over each."""
    told = []
    for name, df in sorted(tables.items()):
        counted = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)])
        rows = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(c).alias("column"), F.lit(kind).alias("type"), F.col("rows"), F.col(f"c{k}").alias("filled")) for k, (c, kind) in enumerate(df.dtypes)])
        told.append(counted.select(F.lit(name).alias("tab"), F.inline(rows)))
    return reduce(DataFrame.unionByName, told)


def is_table_name(name: str | None) -> bool:
    return bool(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or ""))


def is_timeout(seconds: object) -> bool:
    return isinstance(seconds, int) and not isinstance(seconds, bool) and 1 <= seconds <= 600


def plan_is_read_only(spark: SparkSession, sql: str) -> bool:
    """By Spark's own parser: a plan without commands other than SHOW, DESCRIBE and EXPLAIN."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception:
        return False
    name = plan.getClass().getSimpleName()
    return bool(re.match(r"(Show|Describe|Explain|Project|Aggregate|Sort|GlobalLimit|LocalLimit|Filter|Distinct|Union|UnresolvedWith|UnresolvedHaving|Join|SubqueryAlias|Unresolved\w*|OneRowRelation|Offset|Except|Intersect|WithWindowDefinition|Pivot|Tail)", name))


def run(spark: SparkSession, sql: str, timeout: int = 60, most_rows: int = 1000) -> DataFrame:
    """The result's first rows; jobs are cancelled after ``timeout`` seconds."""
    if not is_safe(sql) or not plan_is_read_only(spark, sql):
        raise PermissionError("only reading statements may run")
    if not is_timeout(timeout):
        raise ValueError("the timeout is 1 to 600 seconds")
    sc, tag = spark.sparkContext, f"guard-{uuid.uuid4().hex}"
    sc.addJobTag(tag)
    timer = threading.Timer(timeout, sc.cancelJobsWithTag, [tag])
    timer.start()
    try:
        df = spark.sql(sql)
        rows = df.limit(most_rows).collect()
        return spark.createDataFrame(rows, df.schema)
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
