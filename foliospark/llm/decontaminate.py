"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Words are runs of digits, letters and anything outside ASCII, in the text with A-Z lower-cased. A benchmark item's
windows are its runs of 10 consecutive words; an item of 1 to 9 words is one window, one of none has none. A document
word inside any occurrence of a window is hit.

Patterns are sequences of words. For each length class the search keeps a shift table from blocks of words to how far
the search may move on, buckets of patterns by their suffix block, and compares the words themselves to confirm.

Defined cases: null or empty text has no words; a null item or one without an id is no pattern; items that share an id
count once; repeated documents each give a row; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import Stored, fresh

WINDOW = 10
#: Words in a block of the shift table.
BLOCK = 2
#: Benchmark bytes that are searched for in one pass over the documents (some 250 MB of tables in a Python worker); larger
#: benchmarks take several passes, after the first of which only rows with hits are written.
PASS_BYTES = 2 << 20

_KEPT = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_KEPT).split()


class WuManber:
    """Search for patterns of ``least`` words or more; every pattern carries the ids of its items."""

    def __init__(self, patterns: dict[tuple[bytes, ...], frozenset[str]]):
        self.least = m = min(map(len, patterns))
        self.block = b = min(BLOCK, m)
        self.skip = m - b + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[tuple[bytes, ...], list]] = {}
        for pattern, items in patterns.items():
            for end in range(b, m + 1):
                block = b" ".join(pattern[end - b : end])
                self.shift[block] = min(self.shift.get(block, self.skip), m - end)
            bucket = self.buckets.setdefault(b" ".join(pattern[m - b : m]), {})
            bucket.setdefault(pattern[:m], []).append((pattern, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, frozenset[str]]]:
        """(start, end, items) of every occurrence, by the end of its first ``least`` words."""
        m, b, n, shift, skip = self.least, self.block, len(words), self.shift, self.skip
        at = m
        while at <= n:
            block = b" ".join(words[at - b : at])
            step = shift.get(block, skip)
            if step:
                at += step
                continue
            start = at - m
            for pattern, items in self.buckets[block].get(tuple(words[start:at]), ()):
                end = start + len(pattern)
                if len(pattern) == m or tuple(words[start:end]) == pattern:
                    yield start, end, items
            at += 1


def patterns_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[WuManber]:
    """Matchers for the items' windows: one for full windows and one for shorter items, where there are any."""
    found: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_of(text)
        if item is None or not words:
            continue
        for at in range(max(1, len(words) - window + 1)):
            found.setdefault(tuple(words[at : at + window]), set()).add(str(item))
    full = {k: frozenset(v) for k, v in found.items() if len(k) == window}
    short = {k: frozenset(v) for k, v in found.items() if len(k) < window}
    return [WuManber(x) for x in (full, short) if x]


def scan(text: str | None, matchers: list[WuManber]) -> tuple[int, list[int], list[str]]:
    """Number of words, hit spans as start, end, start, end ... in order and apart, and items found."""
    words = words_of(text)
    spans, items = [], set()
    for matcher in matchers:
        for start, end, of in matcher.search(words):
            spans.append((start, end))
            items |= of
    return len(words), merged(spans), sorted(items)


def merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _passes(benchmark: DataFrame) -> list[list[tuple[object, str | None]]]:
    """The items in groups of at most about PASS_BYTES, collected one group at a time by the caller's loop."""
    slim = benchmark.select(F.col("item_id"), F.col("text")).where("item_id is not null and text is not null")
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / PASS_BYTES))
    if n == 1:
        return [slim]
    return [slim.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


_built: dict[str, list[WuManber]] = {}


def _matchers(key: str, items: list[tuple[object, str | None]]) -> list[WuManber]:
    """The tables of a pass, built once in a Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = patterns_of(items)
    return _built[key]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _merged_column(spans: pd.Series) -> pd.Series:
    return pd.Series([merged(list(zip(s[::2].tolist(), s[1::2].tolist()))) for s in spans])


def find_windows(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with three more columns: n_words long, hit_spans array<int> (word offsets), items array<string>.

    The patterns reach the executors in a broadcast of one pass's bounded share of the benchmark. With several passes the
    documents are written once, with the first pass's results; the others read their texts and write rows with hits, which
    meet the documents by a row number at the end.
    """
    n_col, s_col, i_col = names = [fresh(docs, c) for c in ("n_words", "hit_spans", "items")]
    own_fields = [
        T.StructField(n_col, T.LongType()),
        T.StructField(s_col, T.ArrayType(T.IntegerType())),
        T.StructField(i_col, T.ArrayType(T.StringType())),
    ]

    def searched(df: DataFrame, group: DataFrame, all_rows: bool) -> DataFrame:
        """df with the three columns; only rows with hits unless all_rows."""
        columns = df.columns
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r[0], r[1]) for r in group.collect()]))

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matchers = _matchers(*shared.value)
            for batch in batches:
                found = [scan(text, matchers) for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())))]
                out = pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*columns, *names])
                yield out if all_rows else out.filter(pa.array([bool(f[1]) for f in found]))

        return df.mapInArrow(search, T.StructType([*df.schema.fields, *own_fields]))

    first, *others = _passes(benchmark)
    if not others:
        return searched(docs, first, True)
    rid = fresh([*docs.columns, *names], "row")
    base = Stored(searched(docs.withColumn(rid, F.monotonically_increasing_id()), first, True)).df
    hits = [base.where(F.size(f"`{s_col}`") > 0).select(rid, s_col, i_col)]
    for group in others:
        hits.append(Stored(searched(base.select(rid, text_col), group, False).select(rid, s_col, i_col)).df)
    met = reduce(DataFrame.unionByName, hits).groupBy(rid).agg(F.flatten(F.collect_list(s_col)).alias("s"), F.array_distinct(F.flatten(F.collect_list(i_col))).alias("i"))
    met = met.select(F.col(rid).alias("hit_row"), _merged_column("s").alias("s"), F.array_sort("i").alias("i"))
    out = base.join(met, base[rid] == met.hit_row, "left")
    return out.select(*[base[f"`{c}`"] for c in docs.columns], base[n_col], F.coalesce(met.s, base[s_col]).alias(s_col), F.coalesce(met.i, base[i_col]).alias(i_col))


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = find_windows(spark, docs.select("doc_id", "text"), benchmark)
    starts, ends = "filter(hit_spans, (x, i) -> i % 2 = 0)", "filter(hit_spans, (x, i) -> i % 2 = 1)"
    n_hit = F.expr(f"cast(aggregate(zip_with({starts}, {ends}, (a, b) -> b - a), 0, (s, x) -> s + x) as long)")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, in which no benchmark window occurs."""
    found = find_windows(spark, docs, benchmark)
    spans = found.columns[len(docs.columns) + 1]
    return found.where(F.size(F.col(spans)) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


SQL = r"""
with d as (
  select doc_id, row_number() over () as rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select cast(item_id as varchar) as item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where item_id is not null and text is not null
), windows as (
  select distinct item, least(len(w), 10) as k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as s
  from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
), lengths as (
  select distinct k from windows
), grams as (
  select rid, i, k, array_to_string(w[i : i + k - 1], ' ') as s
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, lengths where len(w) >= k)
), found as (
  select rid, i, k, item from grams join windows using (k, s)
), hit as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + k)) as p from found) group by rid
), items as (
  select rid, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct rid, item from found) group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit,
       cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(items.s, '')) as items_sha256,
       coalesce(hit.n, 0) > 0 as contaminated
from d left join hit using (rid) left join items using (rid)
"""
