"""Importance resampling towards a target distribution, by hashed features, with an exact top k over all documents.

Words are runs of digits, letters and anything outside ASCII, with A-Z lower-cased. Features are all runs of 1 to ``n_words``
consecutive words, joined by one space, repeats counted; a feature's bucket is crc32 of its UTF-8 bytes modulo ``buckets``.

1. Features of all documents and of all target texts are counted by bucket: an array in each task, summed by Spark.
2. A bucket's gain is floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))). The gains are an array of bounded size, and a
   document's weight is the floor of the mean of its features' gains.
3. score = weight + floor(-1000 * ln(-ln((h + 0.5) / 2**32))), h from sha256 of seed and id: drawing the highest scores draws
   without replacement in proportion to exp(weight / 1000).
4. The k-th key is found by radix selection: score (descending), id and what tells equal ones apart are one string of digits. Each
   round counts the rows under the known prefix by their next DIGIT digits, at most 16**DIGIT counts, takes the group in which the
   k-th row lies, and goes on behind the digits that its least and greatest key share.
5. Only rows up to that key are range-sorted and ranked.

Defined cases: null or empty text has no features and weight 0; a null id counts as the empty string in h and comes after all others;
equal scores go to the smaller id, then to the smaller hash of the text, then to the row read first; documents of fewer than
``least_words`` words are never drawn but are scored; an empty table has no rows, an empty target gives gains from S alone; other columns
of docs are kept where they are asked for, whatever their names.
"""

from __future__ import annotations

import math
import os.path
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import Stored, fresh, numbered
from foliospark.llm.decontaminate import words_of

#: Hexadecimal digits that a round of the selection resolves at least.
DIGIT = 4
#: Features that a task holds before it counts them.
HELD = 1 << 20


@dataclass(frozen=True)
class Draw:
    seed: int = 2024
    n_words: int = 1
    buckets: int = 10_000
    #: Percent of the documents with least_words or more that are drawn.
    percent: int = 10
    least_words: int = 20


def features(text: str | None, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each of its features."""
    words = words_of(text)
    codes = list(map(crc32, words))
    every = [np.array(codes, np.uint32)]
    for k in range(1, n):
        codes = [crc32(b" " + w, c) for w, c in zip(words[k:], codes)]
        every.append(np.array(codes, np.uint32))
    return len(words), (np.concatenate(every) if n > 1 else every[0]) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, draw: Draw) -> np.ndarray:
    """Features by bucket over all rows of texts (text string). draw.buckets numbers come to the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(draw.buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(features(text.as_py(), draw.n_words, draw.buckets)[1])
                n += len(held[-1])
                if n >= HELD:
                    total += np.bincount(np.concatenate(held), minlength=draw.buckets)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=draw.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    summed = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(draw.buckets, np.int64)
    for bucket, n in summed.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (s_all + b) / (float(s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, draw: Draw, text: str = "text") -> DataFrame:
    """docs with the column ``text`` replaced by n_words, n_features and weight."""
    kept = [c for c in docs.columns if c != text]
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            found = []
            for x in batch.column(batch.schema.get_field_index(text)):
                n, buckets = features(x.as_py(), draw.n_words, draw.buckets)
                found.append((n, len(buckets), int(gain[buckets].sum()) // max(1, len(buckets))))
            made = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], *made], names=[*kept, "n_words", "n_features", "weight"])

    fields = [f for f in docs.schema.fields if f.name != text]
    return docs.mapInArrow(weights, T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]]))


def _digits(c: Column, descending: bool = False) -> Column:
    """16 hexadecimal digits in the order of a long."""
    flipped = c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.lpad(F.hex(F.bitwise_not(flipped) if descending else flipped), 16, "0")


def id_digits(c: Column, kind: T.DataType) -> Column:
    """Digits in the order of an id, null last: of a long, or of a text's bytes and an end that is below any digit."""
    own = _digits(c) if isinstance(kind, T.IntegralType) else F.concat(F.hex(c.cast("string").cast("binary")), F.lit(" "))
    return F.coalesce(F.concat(F.lit("0"), own), F.lit("1"))


def kth_key(rows: DataFrame, key: str, k: int, low: str, high: str) -> str:
    """The k-th (from 1) least value of a column of distinct strings that lie between low and high. Each round reads rows once."""
    while True:
        prefix = os.path.commonprefix([low, high])
        under = rows.where(F.col(key).startswith(prefix)) if prefix else rows
        groups = under.groupBy(F.substring(key, len(prefix) + 1, DIGIT).alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
        for _, n, low, high in sorted(groups.collect()):
            if k <= n:
                break
            k -= n
        if k == n:
            return high


def resample(spark: SparkSession, docs: DataFrame, target: DataFrame, draw: Draw = Draw(), columns: list[str] | None = None) -> DataFrame:
    """Every row of docs with its ``columns`` (all by default) and n_features, weight, score and rank, null where it isn't drawn.

    Of the N documents with least_words or more, floor(percent * N / 100) are drawn. Clashing names of docs' columns keep theirs.
    """
    columns = docs.columns if columns is None else columns
    gain = gains(bucket_counts(docs, draw), bucket_counts(target, draw))
    kind = docs.schema["doc_id"].dataType
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("tie"), F.col("text").alias("text"))
    weighed = weigh(base, gain, draw).withColumn("at", F.monotonically_increasing_id())
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    weighed = weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))))
    can = F.col("n_words") >= draw.least_words
    key = F.concat(_digits(F.col("score"), True), id_digits(F.col("id"), kind), _digits(F.col("tie")), _digits(F.col("at")))
    seen = Stored(weighed.withColumn("key", F.when(can, key)), {"n": F.count("key"), "low": F.min("key"), "high": F.max("key")})
    made = {c: fresh(columns, c) for c in ("n_features", "weight", "score", "rank")}
    k = draw.percent * seen.metrics["n"] // 100

    def result(df: DataFrame, rank: Column) -> DataFrame:
        return df.select("row.*", *[F.col(c).alias(made[c]) for c in ("n_features", "weight", "score")], rank.cast("long").alias(made["rank"]))

    if not k:
        return result(seen.df, F.lit(None))
    last = kth_key(seen.df.select("key").where("key is not null"), "key", k, seen.metrics["low"], seen.metrics["high"])
    drawn = F.coalesce(F.col("key") <= last, F.lit(False))
    ranked = numbered(seen.df.where(drawn), ["key"])
    return result(ranked, F.col("position") + 1).unionByName(result(seen.df.where(~drawn), F.lit(None)))


def oracle_sql(draw: Draw = Draw()) -> str:
    """For DuckDB, single words as features."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    b = draw.buckets
    return f"""
with crc_table as (
  select list(v order by i) as t from (select i, list_reduce(list_concat([i], range(0, 8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(0, 256) r(i))
), d as (
  select row_number() over () as rid, doc_id, {words} as w from documents
), word as (
  select rid, unnest(w) as x from d
), goal as (
  select unnest({words}) as x from benchmark
), bytes as (
  select x, hex(encode(x)) as hx from (select distinct x from word union select distinct x from goal)
), coded as (
  select x, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(hx), 2), lambda i: cast(instr('0123456789ABCDEF', substr(hx, i, 1)) * 16 + instr('0123456789ABCDEF', substr(hx, i + 1, 1)) - 17 as bigint))),
                            lambda p, q: xor(p >> 8, t[(xor(p, q) & 255) + 1])), 4294967295) % {b} as bucket
  from bytes, crc_table
), s as (
  select bucket, count(*) as n from word join coded using (x) group by bucket
), g as (
  select bucket, count(*) as n from goal join coded using (x) group by bucket
), totals as (
  select (select coalesce(sum(n), 0) from s) as ss, (select coalesce(sum(n), 0) from g) as tt
), gains as (
  select bucket, floor(1000 * ln(cast(coalesce(g.n, 0) + 1 as double) * cast(ss + {b} as double) / (cast(s.n + 1 as double) * cast(tt + {b} as double)))) as gain
  from s left join g using (bucket), totals
), weights as (
  select rid, floor(sum(gain) / count(*)) as weight from word join coded using (x) join gains using (bucket) group by rid
), scored as (
  select rid, doc_id, len(w) as n, cast(coalesce(weight, 0) as bigint) as weight,
         cast(coalesce(weight, 0) + floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: cast(instr('0123456789abcdef', substr(hash, i, 1)) - 1 as bigint)), lambda p, q: p * 16 + q) + 0.5) / 4294967296))) as bigint) as score
  from (select d.*, weight, sha256('{draw.seed}:' || coalesce(cast(doc_id as varchar), '')) as hash from d left join weights using (rid))
), ranked as (
  select rid, row_number() over (order by score desc, doc_id nulls last) as r, count(*) over () as total from scored where n >= {draw.least_words}
)
select doc_id, cast(n as bigint) as n_features, weight, score, cast(case when r <= ({draw.percent} * total) // 100 then r end as bigint) as rank
from scored left join ranked using (rid)
"""
