"""Approximate nearest neighbours by an inverted file: vectors lie in cells, and a query looks into the few nearest ones.

Cells are the clusters of a k-means over a bounded sample; every vector of the table is put into its nearest cell and written
in folders by cell. A search joins the queries with the cells they look into, so folders of other cells aren't read, and
scores whole vectors: the answer differs from an exact search only by neighbours in cells that weren't looked into. Looking into all
of them is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import vectors
from foliospark.operators.relational import top_per_group
from foliospark.operators.retrieval import nearest, query_blocks
from foliospark.tables import Table

#: Vectors that the cells are trained on, by the hash of their id.
SAMPLE = 50_000
#: Queries on which the number of cells to look into is measured.
MEASURED = 200
#: Cells at most; their centres go to every task.
MOST_CELLS = 4096
#: Looks into every cell: an exact search.
ALL = -1


@dataclass
class Index:
    """table: chunk_id, embedding, the other columns of the chunks, and cell. centres: one row a cell."""

    table: Table
    centres: np.ndarray
    metric: str

    @property
    def cells(self) -> int:
        return len(self.centres)

    def nearest_cells(self, vector: Column) -> Column:
        """All cells, the nearest one to a vector first; null for a null vector or one of another length."""
        held, cosine = self.table.df.sparkSession.sparkContext.broadcast(self.centres), self.metric == "COSINE"

        def order(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            centres = held.value
            for part in parts:
                fits = [x is not None and len(x) == centres.shape[1] for x in part]
                out = np.empty(len(part), object)
                out[:] = None
                if any(fits):
                    v = np.stack([x for x, ok in zip(part, fits) if ok]).astype(float)
                    far = -(v @ centres.T) if cosine else ((v[:, None, :] - centres[None]) ** 2).sum(2)
                    out[np.flatnonzero(fits)] = list(np.argsort(far, axis=1, kind="stable"))
                yield pd.Series(out)

        return F.pandas_udf(order, T.ArrayType(T.IntegerType()))(vector)


def build(chunks: DataFrame, cells: int | None = None, metric: str = "COSINE", sample: int = SAMPLE, seed: int = 5) -> Index:
    """An index over chunks (chunk_id, embedding, ...). cells: by default the root of the number of vectors.

    Null vectors, zero vectors under COSINE, and those whose length isn't the most frequent one are in no cell.
    """
    metric = metric.upper()
    sized = chunks.where("embedding is not null").groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if sized is None:
        raise ValueError("there are no vectors to index")
    fit = chunks.where(F.size("embedding") == sized.d)
    if metric == "COSINE":
        fit = fit.where(vectors.norm(F.col("embedding")) > 0)
    cells = min(cells or max(1, math.isqrt(sized.n)), MOST_CELLS)
    share = min(1.0, sample / sized.n)
    picked = fit.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else fit
    model = KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine" if metric == "COSINE" else "euclidean", featuresCol="v", predictionCol="cell").fit(picked.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("v")))
    centres = np.stack([np.asarray(c, float) for c in model.clusterCenters()])
    if metric == "COSINE":
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    placed = model.transform(fit.withColumn("v", array_to_vector(F.col("embedding").cast("array<double>")))).drop("v")
    # ranges of cell and id: a cell of a third of all vectors is written by many tasks, a small one by one
    return Index(Table(placed.repartitionByRange("cell", "chunk_id"), by=["cell"]), centres, metric)


def _distance(metric: str) -> Column:
    e, q = F.col("embedding"), F.col("q")
    return vectors.cosine(e, q) if metric == "COSINE" else vectors.euclidean(e, q) if metric == "L2" else vectors.dot(e, q)


def search(index: Index, queries: DataFrame, k: int, probes: int, threshold: float | None = None) -> DataFrame:
    """(qid, chunk_id, score): of each query (qid, q) the k best chunks in the ``probes`` cells nearest to it, by score then id.

    Queries come to the cells in blocks of bounded bytes, under COSINE as matrices whose rows name their cells; the vectors aren't shuffled. With
    all cells the result is the exact one.
    """
    if index.metric == "COSINE":
        asked = queries.select("qid", "q").where(F.size("q") == index.centres.shape[1])
        if probes < index.cells:
            asked = asked.withColumn("cells", F.slice(index.nearest_cells(F.col("q")), 1, max(1, probes)))
        top = nearest(index.table.df, asked, k)
    else:
        told = []
        for block in query_blocks(queries.select("qid", "q", F.explode(F.slice(index.nearest_cells(F.col("q")), 1, max(1, probes))).alias("cell"))):
            told.append(index.table.df.join(block, "cell").select("qid", "chunk_id", vectors.similarity(_distance(index.metric), index.metric).alias("score")))
        top = top_per_group(reduce(DataFrame.unionByName, told), ["qid"], [F.desc("score"), F.col("chunk_id")], k)
    return top if threshold is None else top.where(F.col("score") > threshold)


def recall_curve(index: Index, queries: DataFrame, k: int) -> list[float]:
    """For 1, 2, ... cells the share of the true k neighbours that a search finds, measured on at most MEASURED of the queries."""
    some = queries.select("qid", "q").orderBy(F.xxhash64("qid"), "qid").limit(MEASURED)
    block = F.broadcast(some.withColumn("order", index.nearest_cells(F.col("q"))))
    if index.metric == "COSINE":
        true = nearest(index.table.df, some, k, keep=("cell",))
    else:
        hits = index.table.df.join(F.broadcast(some)).select("qid", "chunk_id", "cell", vectors.similarity(_distance(index.metric), index.metric).alias("score"))
        true = top_per_group(hits, ["qid"], [F.desc("score"), F.col("chunk_id")], k)
    place = F.array_position("order", F.col("cell"))
    counted = dict(true.join(block.select("qid", "order"), "qid").groupBy(place.alias("place")).count().where("place is not null").collect())
    total, curve, got = sum(counted.values()), [], 0
    for p in range(1, index.cells + 1):
        got += counted.get(p, 0)
        curve.append(got / total if total else 1.0)
    return curve


def probes_for(index: Index, queries: DataFrame, k: int, recall: float = 0.95) -> int:
    """The least number of cells to look into that reaches ``recall`` on the measured queries."""
    return next(p for p, r in enumerate(recall_curve(index, queries, k), 1) if r >= recall or p == index.cells)


def node_search(nodes: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.9, label: str = "Upload", probes: int | None = None) -> DataFrame:
    """(qid, name, score): of the nodes (node_id, name, labels array, embedding) with the label the k nearest ones above the threshold.

    probes: cells to look into; by default as many as reach a measured recall of 0.95.
    """
    index = build(nodes.where(F.array_contains("labels", label)).select(F.col("node_id").alias("chunk_id"), "name", "embedding"))
    found = search(index, queries, k, index.cells if probes == ALL else probes or probes_for(index, queries, k), threshold)
    named = index.table.df.select("chunk_id", "name")
    return found.join(named, "chunk_id").select("qid", "name", "score")
