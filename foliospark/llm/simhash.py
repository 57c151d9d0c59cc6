"""Near-duplicates by 64-bit SimHash; meet-in-the-middle ball hashing finds all pairs within two bits.

Words are runs of anything but ASCII white space in the text with A-Z lower-cased; features are the 3-word shingles,
repeats included (fewer words: the whole sequence), hashed by XXH64 with seed 42. A bit is set if it is set in over
half the hashes. No words or a null text: fingerprint zero, which is linked like any other.

Two fingerprints at most two bits apart share one of the 65 values within one bit of each. So every distinct
fingerprint emits its 65 variants, and those that meet in a variant are compared. A variant has 65 fingerprints within
one bit, so no bucket holds more than 65 rows, however large a group of copies or near copies is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import Stored, connected_components, fresh

SEED = 42
#: Hashes that are unpacked into bits at once.
BLOCK = 1 << 16
#: Fingerprints whose variants one task emits.
FPS_A_TASK = 50_000
#: Most keys of rows that go for which they are broadcast (24 bytes each); beyond it texts are shuffled to them.
BROADCAST_KEYS = 500_000


def shingle_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= 3:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-3])).tolist()
    return np.fromiter([h(line[a:b], SEED) for a, b in zip(starts, (ends[2:] - 1).tolist())], np.uint64, len(words) - 2)


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    set_ = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * set_ > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def fingerprint_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series([fingerprint(x) for x in t], dtype="int64")


def link_fingerprints(fps: Stored) -> DataFrame:
    """Star edges (u, v) among the distinct fingerprints ``fp`` that meet in a variant, each verified. fps counts them as n.

    Those within one bit of a variant are within two bits of each other, so linking each with the least one there
    leaves the components as they are and doesn't write all pairs.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)])
    spread = fps.df.select("fp").repartition(max(1, math.ceil(fps.metrics["n"] / FPS_A_TASK)), "fp")
    near = spread.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    shared = near.groupBy("variant").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    pairs = shared.select(F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where("u <> v")
    return pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) for every row of docs; other columns aren't read.

    component_id is the least id reachable over links. Rows that repeat an id each give a row. A null id takes part but
    is never the least one, unless a component has no other.
    """
    slim = Stored(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col)).alias("fp")))
    distinct = Stored(slim.df.groupBy("fp").agg(F.min("doc_id").alias("least")), {"n": F.count(F.lit(1))})
    linked = connected_components(link_fingerprints(distinct))
    named = distinct.df.join(linked.df, F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = named.join(least, "root").select("fp", "component_id")
    return slim.df.join(component, "fp").select(
        F.col("doc_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def fingerprint_groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[Stored, DataFrame]:
    """(id, h1, h2, node) of every row, h1 and h2 hashes of its text; and (node, root) by op6's fingerprints."""
    slim = Stored(docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), fingerprint_column(F.col(text_col)).alias("node")))
    linked = connected_components(link_fingerprints(Stored(slim.df.select(F.col("node").alias("fp")).distinct(), {"n": F.count(F.lit(1))})))
    return slim, linked.df


def text_key(text: Column) -> list[Column]:
    """Two hashes of a text, together 128 bits."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(SEED), text).alias("h2")]


def _without(docs: DataFrame, keys: Stored, names: list[str], how: str) -> DataFrame:
    """docs joined (``how``: left_anti or left_semi) with keys by null-safe equality; texts are shuffled only past BROADCAST_KEYS."""
    same = [docs[f"`{c}`"].eqNullSafe(keys.df[k]) for c, k in zip(names, ("id", "h1", "h2"))]
    return docs.join(keys.df.hint("broadcast" if keys.metrics["n"] <= BROADCAST_KEYS else "shuffle_hash"), same, how)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: Callable[[DataFrame, str, str], tuple[Stored, DataFrame]] = fingerprint_groups) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: of each the one with the least (id, hashes of the text).

    A null id comes after all others. Rows are told apart by id and text together, so rows that share an id, or have
    none, and belong to different components each stay; of rows that share both one stays. groups gives the components
    (``fingerprint_groups``). What goes is found first, so that the texts only meet the keys of that.
    """
    slim, linked = groups(docs, id_col, text_col)
    named = slim.df.join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.groupBy("root", "id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    least = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h1", "h2")).alias("k"))
    told = named.join(least, "root").select("id", "h1", "h2", "n", (F.col("id").eqNullSafe(F.col("k.id")) & (F.col("h1") == F.col("k.h1")) & (F.col("h2") == F.col("k.h2"))).alias("stays"))
    told = Stored(told.where("n > 1 or not stays"))
    n = {"n": F.count(F.lit(1))}
    gone = Stored(told.df.where("not stays").select("id", "h1", "h2"), n)
    twice = Stored(told.df.where("stays").select("id", "h1", "h2"), n)
    told.drop()
    k1, k2 = fresh(docs, "kept_h1"), fresh(docs, "kept_h2")
    h1, h2 = text_key(F.col(f"`{text_col}`"))
    names = [id_col, k1, k2]
    out = _without(docs.withColumns({k1: h1, k2: h2}), gone, names, "left_anti")
    if twice.metrics["n"]:
        once = _without(out, twice, names, "left_semi").dropDuplicates(names)
        out = _without(out, twice, names, "left_anti").unionByName(once)
    return out.drop(k1, k2)
