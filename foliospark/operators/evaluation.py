"""Retrieval metrics, their means, pass marks, and overlap of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import vectors

KS = (1, 3, 5, 10)


def at_ks(results: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(qid, k, precision, recall, f1) for questions with both found and relevant ids. results: qid, found, relevant."""
    good = results.where((F.size("found") > 0) & (F.size("relevant") > 0))
    made = F.array(*[F.struct(F.lit(k).alias("k"), *[f(F.col("found"), F.col("relevant"), k).alias(n) for n, f in (("precision", vectors.precision_at), ("recall", vectors.recall_at), ("f1", vectors.f1_at))]) for k in ks])
    return good.select("qid", F.inline(made))


def means(metrics: DataFrame) -> DataFrame:
    """Mean of each metric over questions, by k."""
    return metrics.groupBy("k").agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def overall(per_question: DataFrame) -> DataFrame:
    """The mean over questions' mean metrics and answer scores, each counted once. per_question: qid, metrics map, answer."""
    vals = F.map_values("metrics")
    mean = F.when(F.size(vals) > 0, F.aggregate(vals, F.lit(0.0), lambda a, x: a + x) / F.size(vals))
    return per_question.select(F.explode(F.array(mean, F.col("answer"))).alias("v")).agg(F.avg("v").alias("overall_score"))


def low_quality(score: Column, metrics: Column) -> Column:
    """A score of 0.5 or less (missing: 1), or any recall below 0.3."""
    return (F.coalesce(score, F.lit(1.0)) <= 0.5) | F.exists(F.map_entries(metrics), lambda e: e.key.startswith("recall@") & (e.value < 0.3))


def pass_marks(values: DataFrame, marks: dict[str, float]) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in marks.items() for x in kv])
    return values.withColumn("target", F.element_at(table, F.col("metric"))).withColumn("passed", F.col("value") >= F.col("target"))


def rouge1(a: Column, b: Column) -> Column:
    """F1 of the words two texts share, counted with repeats."""
    wa, wb = (F.filter(F.split(F.lower(F.regexp_replace(x, "[^A-Za-z0-9]+", " ")), " "), lambda w: w != "") for x in (a, b))
    count = lambda ws, w: F.size(F.filter(ws, lambda x: x == w))
    same = F.aggregate(F.array_distinct(wa), F.lit(0), lambda s, w: s + F.least(count(wa, w), count(wb, w)))
    total = F.size(wa) + F.size(wb)
    return F.when(total > 0, 2.0 * same / total).otherwise(F.lit(0.0))


def slot_coverage(df: DataFrame, col: str, slots: dict[str, list[str]]) -> DataFrame:
    """Per cent of rows that have any of a slot's words, by slot, in one pass."""
    has = {s: F.avg(F.when(F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(F.lower(col), w)), 100.0).otherwise(0.0)) for s, ws in slots.items()}
    one = df.agg(*[c.alias(s) for s, c in has.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("slot"), F.round(F.col(s), 2).alias("rate")) for s in slots])))
