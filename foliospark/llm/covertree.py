"""Near-duplicate vectors: all pairs with cosine >= 0.95 in double precision, by dual traversal of a cover tree.

For unit vectors a cosine of 0.95 or more is a distance of at most sqrt(0.1). The tree's levels are nested nets with halving
radii 2, 1, 1/2 ... 1/8 of a bounded sample; a net's node hangs from the nearest one of the net above, and every vector from
the nearest node of the last net. Every node of every level has a covering radius: the largest distance of any vector below
it from its centre, over all vectors. The traversal starts with the root against itself and descends pairs of nodes, the
node with the larger radius first; pairs further apart than their radii and the threshold together are pruned.

Leaf pairs that survive are met in one task each: leaves are dealt over blocks in tree order, and a leaf's rows go to those
pairs of blocks in which it has a surviving partner. There each leaf's rows are a tree of their own, of farthest-point nets
with halving radii as deep as its rows need, and the traversal goes on: pairs of nodes out of reach are pruned, pairs within
the threshold by their radii alone are linked and only counted, and what is left of small nodes is compared, first in single
precision, and in double precision near the threshold.

Tasks return counts and spanning links only, never all pairs of a group. The comparison is quadratic in vectors where the
bounds prune nothing, as among unrelated vectors of many dimensions; equal vectors are compared once.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
lengths never link; equal vectors under several ids link with each other; repeated rows each give a row and count; a null
vec_id takes part and is never the least id; no rows give no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Stored, connected_components

THRESHOLD = 0.95
#: Bound of the sample that the tree's nets are built on, for each length of vectors.
SAMPLE = 3000
#: Vectors of a block; at least BLOCKS blocks are made, so that tasks are spread.
BLOCK_ROWS, BLOCKS = 100_000, 4
#: Rows of a ball that isn't divided, and most balls that one is divided into.
SMALL, FAN = 48, 64
#: Single-precision products are off by less than this.
_SLACK = 1e-5
_RADII = (2.0, 1.0, 0.5, 0.25, 0.125)


def chord(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine))


def unit_rows(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nested_nets(x: np.ndarray) -> list[np.ndarray]:
    """Indices of centres by level: each level has the one above and covers x within its radius."""
    nets, centres = [], []
    near = np.full(len(x), np.inf)
    for radius in _RADII:
        while len(x):
            far = int(near.argmax())
            if near[far] <= radius:
                break
            centres.append(far)
            near = np.minimum(near, np.sqrt(np.maximum(0, 2 - 2 * (x @ x[far]))))
        nets.append(np.array(centres, int))
    return nets


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * cosine))


class Tree:
    """Nets of a sample. A node is (level, place in the net); nodes of the last net are leaves, in tree order."""

    def __init__(self, x: np.ndarray):
        nets = nested_nets(x)
        path = np.stack([(x[nets[-1]] @ x[net].T).argmax(1) for net in nets])
        order = np.lexsort(path[:-1][::-1])
        nets[-1] = nets[-1][order]
        self.centres = [x[net] for net in nets]
        #: For each leaf its ancestors, one for each level, itself last. A parent is the nearest of the net above.
        self.above = [np.arange(len(nets[-1]))]
        for upper, lower in zip(nets[-2::-1], nets[:0:-1]):
            parent = (x[lower] @ x[upper].T).argmax(1)
            self.above.insert(0, parent[self.above[0]])
        self.above = np.stack(self.above)
        self.radii: list[np.ndarray] = []

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the leaf, and the distances from all ancestors of the leaf."""
        node, near = np.zeros(len(x), np.int64), np.zeros((len(x), len(self.centres)))
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node[at : at + 4096] = leaf = (part @ self.centres[-1].T).argmax(1)
            for level, centres in enumerate(self.centres):
                near[at : at + 4096, level] = distance(np.einsum("ij,ij->i", part, centres[self.above[level][leaf]]))
        return node, near

    def cover(self, leaves: np.ndarray, near: np.ndarray) -> None:
        """Sets the covering radii from each leaf's largest distances; a node without vectors has radius -1."""
        self.radii = [np.full(len(c), -1.0) for c in self.centres]
        for level, r in enumerate(self.radii):
            np.maximum.at(r, self.above[level][leaves], near[:, level])

    def pairs(self, eps: float) -> tuple[np.ndarray, int]:
        """Which leaves form surviving pairs (symmetric), and how many pairs of nodes were visited.

        A node's children meet the children of those nodes that the node survives with, in one product for each node.
        """
        live, visited = np.ones((1, 1), bool), 0
        above = np.zeros(len(self.centres[0]), np.int64)  # every node of the first net hangs from one root
        for level, (c, r) in enumerate(zip(self.centres, self.radii)):
            kids = np.flatnonzero(r >= 0)  # nodes that have vectors
            order = kids[np.argsort(above[kids], kind="stable")]
            ends = np.searchsorted(above[order], np.arange(len(live) + 1))
            below = np.zeros((len(c), len(c)), bool)
            for p in np.flatnonzero(np.diff(ends)):
                own = order[ends[p] : ends[p + 1]]
                met = kids[live[p][above[kids]]]
                visited += len(own) * len(met)
                below[np.ix_(own, met)] = distance(c[own] @ c[met].T) <= r[own][:, None] + r[met] + eps + 1e-6
            live = below
            if level + 1 < len(self.centres):
                above = np.zeros(len(self.centres[level + 1]), np.int64)
                above[self.above[level + 1]] = self.above[level]
        return live | live.T, visited // 2


def _spread(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the labels of a[i] and b[i]; a label is an index at most as large as its own."""
    while len(a):
        least = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels[:] = up
        open_ = labels[a] != labels[b]
        a, b = a[open_], b[open_]


class Ball:
    """A node inside a task: rows within radius of a centre, and the balls that they fall into."""

    __slots__ = ("centre", "kids", "radius", "rows")

    def __init__(self, x: np.ndarray, rows: np.ndarray, centre: np.ndarray, tight: float):
        self.rows, self.centre, self.kids = rows, centre, []
        d = distance(x[rows] @ centre)
        self.radius = float(d.max())
        if len(rows) <= SMALL or self.radius <= tight:
            return
        # a net of half the radius by farthest points; where it takes too many centres the rows don't cluster and stay as they are
        half, centres = self.radius / 2, []
        near, owner = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        far = int(d.argmin())
        while len(centres) <= FAN:
            own = distance(x[rows] @ x[rows[far]])
            closer = own < near
            near, owner = np.where(closer, own, near), np.where(closer, len(centres), owner)
            centres.append(rows[far])
            far = int(near.argmax())
            if near[far] <= half:
                break
        else:
            return
        self.kids = [Ball(x, rows[owner == k], x[c], tight) for k, c in enumerate(centres)]


class Links:
    """Links among a task's rows: the weight linked with each row, and labels that join linked rows."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, threshold: float):
        self.x, self.weight, self.threshold, self.eps = x, weight, threshold, chord(threshold)
        self.x32 = x.astype(np.float32)
        self.count, self.labels = np.zeros(len(x), np.int64), np.arange(len(x))
        self.compared = 0

    def ball(self, rows: np.ndarray) -> Ball:
        centre = self.x[rows].mean(0)
        norm = np.linalg.norm(centre)
        return Ball(self.x, rows, centre / norm if norm > 1e-9 else self.x[rows[0]], self.eps / 8)

    def meet(self, one: Ball, two: Ball) -> None:
        """Dual traversal from a pair of balls; one is two for the pairs inside a ball."""
        todo = [(one, two)]
        while todo:
            a, b = todo.pop()
            d = 0.0 if a is b else math.sqrt(max(0.0, 2 - 2 * float(a.centre @ b.centre)))
            if d - a.radius - b.radius > self.eps + 1e-6:
                continue
            if d + a.radius + b.radius <= self.eps - 1e-7:
                self.all_linked(a.rows, b.rows, a is b)
            elif a is b:
                if a.kids:
                    todo += [(a.kids[i], a.kids[j]) for i in range(len(a.kids)) for j in range(i, len(a.kids))]
                else:
                    self.inside(a.rows)
            elif a.kids and (a.radius >= b.radius or not b.kids):
                todo += [(k, b) for k in a.kids]
            elif b.kids:
                todo += [(a, k) for k in b.kids]
            else:
                self.across(a.rows, b.rows)

    def all_linked(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        if same:
            self.count[a] += self.weight[a].sum() - self.weight[a]
        else:
            self.count[a] += self.weight[b].sum()
            self.count[b] += self.weight[a].sum()
            _spread(self.labels, np.full(len(a), b[0]), a)
        _spread(self.labels, np.full(len(b), a[0]), b)

    def hits(self, ra: np.ndarray, rb: np.ndarray) -> np.ndarray:
        s = self.x32[ra] @ self.x32[rb].T
        self.compared += s.size
        hit = s >= self.threshold + _SLACK
        k, m = np.nonzero((s >= self.threshold - _SLACK) & ~hit)
        for at in range(0, len(k), 100_000):
            u, v = k[at : at + 100_000], m[at : at + 100_000]
            hit[u, v] = np.einsum("ij,ij->i", self.x[ra[u]], self.x[rb[v]]) >= self.threshold
        return hit

    def across(self, a: np.ndarray, b: np.ndarray) -> None:
        for p in range(0, len(a), 1024):
            for q in range(0, len(b), 8192):
                self.tally(a[p : p + 1024], b[q : q + 8192], self.hits(a[p : p + 1024], b[q : q + 8192]))

    def inside(self, rows: np.ndarray) -> None:
        for p in range(0, len(rows), 2048):
            own = rows[p : p + 2048]
            self.tally(own, own, self.hits(own, own) & np.triu(np.ones((len(own), len(own)), bool), 1))
            self.across(own, rows[p + 2048 :])

    def tally(self, ra: np.ndarray, rb: np.ndarray, hit: np.ndarray) -> None:
        rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
        if not len(rows):
            return
        dense = hit[np.ix_(rows, cols)].astype(np.float64)
        self.count[ra[rows]] += (dense @ self.weight[rb[cols]]).astype(np.int64)
        self.count[rb[cols]] += (self.weight[ra[rows]] @ dense).astype(np.int64)
        k, m = np.nonzero(dense)
        _spread(self.labels, ra[rows[k]], rb[cols[m]])


def links_within(x: np.ndarray, leaf: np.ndarray, block: np.ndarray, pair: tuple[int, int], weight: np.ndarray, live: np.ndarray, threshold: float) -> Links:
    """Links of two blocks' rows between surviving leaf pairs. Pairs inside a block belong to the task (k, k), pairs across to (i, j).

    live: which leaves form surviving pairs.
    """
    i, j = pair
    found = Links(x, weight, threshold)

    def balls(b: int) -> tuple[np.ndarray, list[Ball]]:
        rows = np.flatnonzero(block == b)
        rows = rows[np.argsort(leaf[rows], kind="stable")]
        groups = np.split(rows, np.flatnonzero(np.diff(leaf[rows])) + 1) if len(rows) else []
        return np.array([leaf[g[0]] for g in groups], int), [found.ball(g) for g in groups]

    names, left = balls(i)
    others, right = (names, left) if i == j else balls(j)
    if not left or not right:
        return found
    centres, radii = np.stack([b.centre for b in right]), np.array([b.radius for b in right])
    small = np.array([not b.kids for b in right])
    for k, one in enumerate(left):
        mine = live[names[k], others]
        if i == j:
            mine[:k] = False
            found.meet(one, one)
            mine[k] = False
        d = distance(centres @ one.centre)
        mine &= d - radii - one.radius <= found.eps + 1e-6
        # small balls whose pairs aren't settled by the radii are compared together
        plain = mine & small & (d + radii + one.radius > found.eps - 1e-7) if not one.kids else np.zeros(len(right), bool)
        if plain.any():
            found.across(one.rows, np.concatenate([right[m].rows for m in np.flatnonzero(plain)]))
        for m in np.flatnonzero(mine & ~plain):
            found.meet(one, right[m])
    return found


def _valid(v: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    eps = chord(threshold)
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", F.when(_valid(v), v).alias("v"))
    keyed = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b"), F.size("v").alias("dim"))).alias("key"), "v")
    # equal vectors are one entry of the tree with a weight
    entries = Stored(
        keyed.where("v is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
        .select("key", "least", "n", "v", F.xxhash64("key", F.lit(3)).alias("e")),
        {"n": F.count(F.lit(1))},
    )
    n_entries = entries.metrics["n"]
    dims = [r[0] for r in entries.df.select(F.col("key.dim").alias("d")).distinct().collect()] if n_entries else []
    trees: dict[int, Tree] = {}
    for dim in dims:
        own = entries.df.where(F.col("key.dim") == dim)
        trees[dim] = Tree(unit_rows([r.v for r in own.orderBy(F.xxhash64("e", F.lit(17)), "e").select("v").limit(SAMPLE).collect()]))
    shared = spark.sparkContext.broadcast(trees)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            node, near = np.zeros(len(part), np.int64), np.zeros((len(part), len(_RADII)))
            for dim in part.dim.unique():
                at = np.flatnonzero(part.dim.values == dim)
                node[at], near[at] = shared.value[dim].nearest(unit_rows(list(part.v.values[at])))
            yield pd.DataFrame({"e": part.e, "dim": part.dim, "node": node, "near": list(near), "n": part.n, "v": part.v})

    placed = entries.df.select("e", F.col("key.dim").alias("dim"), "n", "v").mapInPandas(place, "e long, dim int, node long, near array<double>, n long, v array<double>")
    placed = Stored(placed)
    # one row for each leaf: at most SAMPLE for each length of vectors
    far = [F.max(F.col("near")[k]).alias(f"r{k}") for k in range(len(_RADII))]
    leaves = placed.df.groupBy("dim", "node").agg(F.count(F.lit(1)).alias("n"), *far).toPandas()
    plan = {dim: _plan(trees[dim], leaves[leaves.dim == dim], eps) for dim in dims}
    plans = spark.sparkContext.broadcast(plan)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each row to the pairs of blocks in which its leaf has a surviving partner. A large leaf's rows are dealt over its blocks by hash."""
        for part in batches:
            out = {"task": [], "at": [], "block": []}
            for k, (dim, node, e) in enumerate(zip(part.dim, part.node, part.e)):
                own, meets = plans.value[dim][0][node]
                b = own[e % len(own)]
                for p in meets:
                    out["task"].append(f"{dim}:{min(b, p)}:{max(b, p)}")
                    out["at"].append(k)
                    out["block"].append(b)
            at = np.array(out["at"], int)
            yield pd.DataFrame({"task": out["task"], "block": out["block"], **{c: part[c].values[at] for c in ("e", "node", "n", "v")}})

    dealt = placed.df.select("e", "dim", "node", "n", "v").mapInPandas(deal, "task string, block int, e long, node long, n long, v array<double>")

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = map(int, key[0].split(":"))
        part = part.sort_values("e", ignore_index=True)
        x = unit_rows(list(part.v))
        live = np.unpackbits(plans.value[dim][1], axis=1, count=len(shared.value[dim].centres[-1])).astype(bool)
        found = links_within(x, part.node.values, part.block.values, (i, j), part.n.values, live, threshold)
        keep = (found.count > 0) | (found.labels != np.arange(len(x)))
        e = part.e.values
        return pd.DataFrame({"u": e[keep], "v": e[found.labels[keep]], "links": found.count[keep]})

    made = Stored(dealt.groupBy("task").applyInPandas(compare, "u long, v long, links long"))
    counts = made.df.groupBy("u").agg(F.sum("links").alias("links"))
    linked = connected_components(made.df.where("u <> v").select("u", "v"))
    named = entries.df.select("key", "e", "least", "n").join(linked.df, F.col("e") == F.col("node"), "left")
    named = named.select("key", "e", "least", "n", F.coalesce("root", "e").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    known = named.join(least, "root").join(counts, F.col("e") == F.col("u"), "left")
    known = known.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    out = keyed.drop("v").join(known, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )


def _plan(tree: Tree, leaves: pd.DataFrame, eps: float) -> tuple[dict[int, tuple[list[int], list[int]]], np.ndarray]:
    """For each leaf its blocks and the blocks in which it has a surviving partner; and the surviving pairs, as bits. Blocks are runs of leaves in tree order."""
    leaves = leaves.sort_values("node")
    ids, sizes = leaves.node.values, leaves.n.values
    tree.cover(ids, leaves[[f"r{k}" for k in range(len(_RADII))]].values)
    total = int(sizes.sum())
    size = max(1, math.ceil(total / max(BLOCKS, math.ceil(total / BLOCK_ROWS))))
    ends = np.cumsum(sizes)
    first, last = (ends - sizes) // size, (ends - 1) // size
    live, _ = tree.pairs(eps)
    mine = live[np.ix_(ids, ids)].astype(np.float32)
    blocks = np.arange(int(last[-1]) + 1)
    meets = mine @ ((blocks >= first[:, None]) & (blocks <= last[:, None])).astype(np.float32) > 0
    return {int(i): (list(range(a, b + 1)), np.flatnonzero(m).tolist()) for i, a, b, m in zip(ids, first.tolist(), last.tolist(), meets)}, np.packbits(live, axis=1)


SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as v, row_number() over () as r from embeddings
), ok as (
  select * from v where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), links as (
  select a.r as a, b.r as b from ok a, ok b where a.r <> b.r and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95
), reach(r, to_r) as (
  select r, r from v union select reach.r, links.b from reach join links on links.a = reach.to_r
)
select v.vec_id, (select count(*) from links where links.a = v.r) as n_links, min(w.vec_id) as component_id, v.vec_id = min(w.vec_id) as kept
from v join reach using (r) join v w on w.r = reach.to_r group by v.r, v.vec_id
"""
