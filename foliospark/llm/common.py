"""Shared plumbing: tables in the shared folder, connected components, safe column names."""

from __future__ import annotations

import atexit
import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.shared import shared_dir

#: Edges in a file between the rounds of connected_components.
EDGES_A_FILE = 250_000

_written: list[tuple[SparkSession, str]] = []


class Stored:
    """A table written to the shared folder: its rows survive lost executors and its lineage is cut."""

    def __init__(self, df: DataFrame, metrics: dict[str, Column] | None = None):
        spark = df.sparkSession
        self.spark, self.path = spark, f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}"
        seen = None
        if metrics:
            seen = Observation(uuid.uuid4().hex)
            df = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
        df.write.parquet(self.path)
        _written.append((spark, self.path))
        self.metrics = seen.get if seen else {}
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; no plan may read the table afterwards."""
        _delete(self.spark, self.path)


@contextmanager
def freeing() -> Iterator[Callable[[Stored], Stored]]:
    """Tables stored inside are dropped at the end, but for those handed to the function that this gives."""
    before, stay = {p for _, p in _written}, set()

    def keep(table: Stored) -> Stored:
        stay.add(table.path)
        return table

    yield keep
    for spark, path in [x for x in _written if x[1] not in before and x[1] not in stay]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if (spark, path) in _written:
        _written.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaner of the shared folder is left
            return


def fresh(df: DataFrame | Iterable[str], name: str) -> str:
    """``name``, or the first of name_1, name_2 ... that no column of df has, whatever its case."""
    taken = {c.lower() for c in (df.columns if isinstance(df, DataFrame) else df)}
    out, k = name, 0
    while out.lower() in taken:
        k += 1
        out = f"{name}_{k}"
    return out


def crc_of_id(c: Column) -> Column:
    """crc32 of an id's decimal text; -1 where the id is null, so that such rows fall in no held-out fold."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(-1))


def crc_of(value: object) -> int:
    return zlib.crc32(str(value).encode())


def connected_components(edges: DataFrame) -> Stored:
    """Large-star and small-star rounds over ``edges`` (u long, v long).

    Returns (node, root) for every node with an edge to another one; root is the least node of its component.
    A hub's rows meet only in partial minima and in a join that AQE may split. No edges: no rows. Nulls are dropped.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()

    check = {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("u", "v"))}
    now = Stored(oriented(edges.where("u is not null and v is not null")), check)
    while now.metrics["n"]:
        # no round adds edges, so this many files hold at most EDGES_A_FILE each
        files = math.ceil(now.metrics["n"] / EDGES_A_FILE)
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = oriented(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = Stored(oriented(hung.unionByName(least.select("u", F.col("m").alias("v")))).coalesce(files), check)
        same = after.metrics == now.metrics
        now.drop()
        now = after
        if same:
            break
    now.df = now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    # a root has no edge to a smaller node, so it isn't among the u
    roots = now.df.select(F.col("root").alias("node"), F.col("root")).distinct()
    now.df = now.df.unionByName(roots)
    return now


def bounded_labels(labels: DataFrame, name: str, per_class: int, seed: int = 11) -> DataFrame:
    """(doc_id, y): at most ``per_class`` labelled rows of each class, by hash order, none of the held-out fold.

    Held out is where crc32(doc_id as text) mod 5 is 0. Of several labels of a document the largest counts; null labels
    and null ids are left out.
    """
    known = labels.select("doc_id", F.col(name).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(crc_of_id(F.col("doc_id")) % 5 != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    order = F.xxhash64("doc_id", F.lit(seed))
    return known.where("y = 1").orderBy(order, "doc_id").limit(per_class).unionByName(
        known.where("y = 0").orderBy(order, "doc_id").limit(per_class)
    )


def bounded_rows(docs: DataFrame, most: int, seed: int = 12) -> DataFrame:
    """(doc_id, text) of about ``most`` training rows, by a hash of id and text, of all documents; all of them if there are fewer.

    Rows that are equal in both count once, so no number of repeated rows makes the sample larger.
    """
    n = docs.count()
    picked = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h")).where(crc_of_id(F.col("doc_id")) % 5 != 0)
    if n > most:
        top = (1 << 62) // n * most // (1 << 30)
        picked = picked.where(F.shiftright(F.pmod("h", F.lit((1 << 63) - 1)), 31) < top)
    return picked.dropDuplicates(["doc_id", "h"]).select("doc_id", "text")


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, y) for a bounded table of ids, one row an id: of several texts of an id the one with the least hash."""
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


#: Rows of a small table up to which it is broadcast.
BROADCAST_ROWS = 100_000


def numbered(df: DataFrame, order: list[str], group: str | None = None, name: str = "position") -> DataFrame:
    """df with ``name`` long: each row's place, from 0, in the order of columns ``order``, within its ``group`` (never null).

    Rows are range-sorted; a task knows the places of its own rows, and those of the rows before it come from one count for
    each task and group. So a group with a third of all rows is dealt out like any other. Rows that are equal in ``order`` are
    told apart by where they were read, so they fill no task by themselves.
    """
    m, g = fresh(df, "m"), group or fresh(df, "g")
    df = df if group else df.withColumn(g, F.lit(0))
    keys = [g, *order, m]
    dealt = df.withColumn(m, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    at, part = fresh(df, "at"), fresh(df, "part")
    placed = Stored(dealt.drop(m).withColumn(at, F.monotonically_increasing_id())).df.withColumn(part, F.shiftright(at, 33))
    runs = placed.groupBy(g, part).agg(F.min(at).alias("lo"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(g).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = Stored(runs.select(F.col(g).alias("run_g"), F.col(part).alias("run_part"), (before - F.col("lo")).alias("shift")), {"n": F.count(F.lit(1))})
    small = F.broadcast(shifts.df) if shifts.metrics["n"] <= BROADCAST_ROWS else shifts.df
    out = placed.join(small, (placed[g] == small.run_g) & (placed[part] == small.run_part))
    return out.select(*[placed[f"`{c}`"] for c in df.columns if group or c != g], (placed[at] + small["shift"]).alias(name))
