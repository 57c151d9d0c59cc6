"""Merkle manifest of a dataset: a hash tree over each language's documents and one over the languages' roots.

H is the lowercase hex sha256 of its inputs one after the other, digests as hex text. A leaf is H of doc_id, source, lang, n_chars and text, each
``-`` where null, else its UTF-8 byte count, ``:`` and the value. Per language leaves ascend by doc_id (null first, equal ids by
leaf); level by level each two consecutive nodes become their H, a last one alone becomes H of itself, until one is left:
the subroot. Subroots, by language (null first, then by UTF-8 bytes), give the root likewise.

1. Leaves get their places by a range sort: one count for each task and language, no language in one task.
2. Aligned blocks of 2**HEIGHT leaves go to tasks, where a fractal traversal emits the leaves' authentication paths one after the
   other: the block's tree is a stack of subtrees of height SUBTREE; at each level of the stack the existing subtree holds the path's nodes, and the
   desired one, which comes next, takes in one leaf a step, so that it is whole when it is needed. A task holds a block's
   leaves and two subtrees for each level, whatever the table's size.
3. Blocks' roots are leaves of the tree above, which is walked in the same way until a language has one node; then
   come the languages. Upper proofs are appended to the paths of the blocks' leaves by a join on the block, which has 2**HEIGHT rows at most.

Defined cases: an empty table has no rows; a lone leaf is its own subroot and, of one language, the root, with an empty path; null
ids, languages and texts are values of their own; repeated rows are leaves of their own with the same leaf and other paths; a text's length
doesn't matter, since only its digest goes on; other columns of docs may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import Stored, crc_of_id, numbered

#: Levels of an aligned block's tree; the block has up to 2**HEIGHT leaves.
HEIGHT = 10
#: Levels of a subtree of the traversal.
SUBTREE = 4


def h(*digests: bytes) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


class Stack:
    """Treehash over leaves from ``first`` on; nodes below height ``top`` that ``wanted`` names are kept, by (height, number)."""

    def __init__(self, first: int, top: int, wanted):
        self.next, self.top, self.wanted = first, top, wanted
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.open: list[tuple[int, bytes]] = []

    def _put(self, height: int, node: bytes, leaf: int) -> None:
        """Adds a node over ``leaf``, joined with the equal ones to its left."""
        while True:
            if height < self.top and self.wanted(height, leaf >> height):
                self.nodes[height, leaf >> height] = node
            if not (self.open and self.open[-1][0] == height):
                break
            node = h(self.open.pop()[1], node)
            height += 1
        self.open.append((height, node))

    def take(self, leaf: bytes) -> None:
        self._put(0, leaf, self.next)
        self.next += 1

    def close(self) -> bytes:
        """No leaf follows: nodes without a right neighbour go up alone. Gives the node at height top."""
        while self.open[-1][0] < self.top:
            height, node = self.open.pop()
            self._put(height + 1, h(node), self.next - 1)
        return self.open[-1][1]


def traverse(leaves: list[bytes], height: int, subtree: int = SUBTREE) -> Iterator[list[bytes | None]]:
    """First the root alone, then for each leaf its siblings from height 0 up, None where there is none.

    height: the levels that this tree has, at least so many that one node is left.
    """
    tops = [*range(subtree, height, subtree), height]
    bottoms = [0, *tops[:-1]]
    level = [next(i for i, t in enumerate(tops) if j < t) for j in range(height)]
    first = Stack(0, height, lambda j, number: number >> (tops[level[j]] - j) == 0)
    for leaf in leaves:
        first.take(leaf)
    yield [first.close()]
    existing = [first.nodes] * len(tops)

    def desired(i: int, number: int) -> Stack:
        return Stack(number << tops[i], tops[i], lambda j, _: j >= bottoms[i])

    coming = [desired(i, 1) for i in range(len(tops) - 1)]
    for k in range(len(leaves)):
        yield [existing[level[j]].get((j, (k >> j) ^ 1)) for j in range(height)]
        for i, stack in enumerate(coming):
            ahead = k + (1 << tops[i])
            if ahead < len(leaves):
                stack.take(leaves[ahead])
                if ahead == len(leaves) - 1:
                    stack.close()
            if (k + 1) % (1 << tops[i]) == 0:
                existing[i] = stack.nodes
                coming[i] = desired(i, (k + 1 >> tops[i]) + 1)


def _walk(nodes: DataFrame, carried: list[str], height: int, subtree: int) -> DataFrame:
    """nodes (g, position, n, node, *carried), n being the group's number of nodes; adds block, siblings (array of binary, null for none)
    and, on a block's first row, its root."""
    fields = {f.name: f for f in nodes.schema.fields}
    out = T.StructType(
        [*[fields[c] for c in ("g", "position", "node", *carried)], T.StructField("block", T.LongType()), T.StructField("siblings", T.ArrayType(T.BinaryType())), T.StructField("block_root", T.StringType())]
    )
    passed = ["g", "position", "node", *carried, "block"]

    def paths(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(block).combine_chunks()
        n = rows.column("n")[0].as_py()
        steps = traverse([x.encode() for x in rows.column("node").to_pylist()], min(height, (n - 1).bit_length()), subtree)
        root = next(steps)[0].decode()
        siblings = pa.array([[x and bytes.fromhex(x.decode()) for x in path] for path in steps], pa.list_(pa.binary()))
        made = [siblings, pa.array([root, *[None] * (rows.num_rows - 1)], pa.string())]
        kept = [rows.column(c).combine_chunks() for c in passed]
        return pa.RecordBatch.from_arrays([*[x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in kept], *made], names=[*passed, "siblings", "block_root"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = list(zip(batch.column(batch.schema.get_field_index("g")).to_pylist(), batch.column(batch.schema.get_field_index("block")).to_pylist()))
            start = 0
            for k in range(len(keys) + 1):
                if k == len(keys) or keys[k] != key:
                    if k > start:
                        held.append(batch.slice(start, k - start))
                    if k < len(keys):
                        if held:
                            yield paths(held)
                        held, key, start = [], keys[k], k
        if held:
            yield paths(held)

    blocks = nodes.withColumn("block", F.shiftright("position", height)).repartition("g", "block").sortWithinPartitions("g", "block", "position")
    return blocks.mapInArrow(walk, out)


def proofs(nodes: DataFrame, carried: list[str] | None = None, height: int = HEIGHT, subtree: int = SUBTREE) -> DataFrame:
    """(g, position, n, node, *carried, path, top) for nodes (g string, position long, n long, node string, *carried); n is the number of g's nodes.

    path: (left, digest) of each level's sibling, digest null where a node is alone; top: the root over all of g's nodes.
    """
    carried = carried or []
    walked = Stored(_walk(nodes, ["n", *carried], height, subtree), {"last": F.max("block")})
    inner = F.transform("siblings", lambda x, j: F.struct(F.getbit(F.col("position"), j).cast("boolean").alias("left"), F.lower(F.hex(x)).alias("digest")))
    roots = walked.df.where("block_root is not null").select("g", F.col("block").alias("position"), F.expr(f"shiftright(n - 1, {height}) + 1").alias("n"), F.col("block_root").alias("node"))
    if walked.metrics["last"]:
        above = proofs(roots, [], height, subtree).select("g", F.col("position").alias("block"), F.col("path").alias("upper"), "top")
    else:
        above = roots.select("g", F.col("position").alias("block"), F.array().cast("array<struct<left:boolean,digest:string>>").alias("upper"), F.col("node").alias("top"))
    return walked.df.join(above, ["g", "block"]).select("g", "position", "n", "node", *carried, F.concat(inner, "upper").alias("path"), "top")


def leaf_of(n_chars: Column | str = "n_chars") -> Column:
    """A document's leaf, by its columns."""
    def field(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))

    return F.sha2(F.concat(*[field(F.col(c) if isinstance(c, str) else c) for c in ("doc_id", "source", "lang", n_chars, "text")]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    def up(node: Column, x: Column) -> Column:
        return F.sha2(F.when(x.digest.isNull(), node).when(x.left, F.concat(x.digest, node)).otherwise(F.concat(node, x.digest)), 256)

    return F.aggregate(path, leaf, up)


def manifest(docs: DataFrame, columns: list[str] | None = None, height: int = HEIGHT, subtree: int = SUBTREE) -> DataFrame:
    """Every document's place and proof: doc_id, lang, leaf, position, path (left, digest), subroot, root, and ``columns`` of docs."""
    more = columns or []
    held = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("g"), leaf_of().alias("node"),
        F.col("doc_id").alias("sort_id"), F.struct("doc_id", "lang", *more).alias("row"),
    )
    placed = numbered(held, ["sort_id", "node"], group="g")
    sizes = placed.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    sized = placed.join(sizes.select(F.col("g").alias("of"), F.col("size").alias("n")), F.col("g") == F.col("of")).drop("of", "sort_id")
    leaves = proofs(sized, ["row"], height, subtree)
    subroots = Stored(numbered(leaves.where("position = 0").select(F.col("g").alias("language"), F.col("top").alias("node")), ["language"]), {"n": F.count(F.lit(1))})
    over = proofs(subroots.df.select(F.lit("").alias("g"), "position", F.lit(subroots.metrics["n"]).cast("long").alias("n"), "node", "language"), ["language"], height, subtree)
    over = over.select(F.col("language").alias("g"), F.col("path").alias("upper"), F.col("top").alias("root"))
    return leaves.join(over, "g").select("row.doc_id", "row.lang", F.col("node").alias("leaf"), "position", F.concat("path", "upper").alias("path"), F.col("top").alias("subroot"), "root", *[F.col(f"row.`{c}`") for c in more])


def verify(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(doc_id, verified) for the manifest's documents against docs, which may have changed: false where no row of the id gives the root."""
    now = docs.select(F.col("doc_id").alias("id"), leaf_of().alias("now"))
    met = held.join(now, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return met.groupBy("doc_id", "position", "subroot").agg(F.coalesce(F.max(fold(F.col("now"), F.col("path")) == F.col("root")), F.lit(False)).alias("verified")).select("doc_id", "verified")


def tamper_check(docs: DataFrame, height: int = HEIGHT, subtree: int = SUBTREE) -> DataFrame:
    """Where 7 divides crc32 of the id, n_chars is one more than it was when the manifest was made: what folds to the root then?"""
    changed = F.coalesce(F.try_add(F.col("n_chars"), F.lit(1)), F.col("n_chars"))
    hit = crc_of_id(F.col("doc_id")) % 7 == 0
    held = manifest(docs.select("doc_id", "source", "lang", "n_chars", "text", F.when(hit, leaf_of(changed)).alias("tampered")), ["tampered"], height, subtree)
    digests = F.transform(F.filter("path", lambda x: x.digest.isNotNull()), lambda x: x.digest)
    out = held.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(digests, ""), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql() -> str:
    def tree(k: int, leaves: str) -> str:
        """nodes{k}: all levels of the trees over leaves (g, pos, n, h)."""
        return f"""nodes{k} as (
  select g, 0 as lvl, pos, n, h from {leaves}
  union all
  select g, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from nodes{k} where n > 1 group by g, lvl, n, pos // 2
)"""

    def walk(k: int, start: str) -> str:
        """up{k}: from the rows of start (rid, g, pos, proof, folded) to the top of tree k."""
        return f"""up{k} as (
  select rid, g, 0 as lvl, pos, proof, folded from ({start})
  union all
  select u.rid, u.g, u.lvl + 1, u.pos // 2, u.proof || coalesce(s.h, ''), sha256(case when s.h is null then u.folded when u.pos % 2 = 1 then s.h || u.folded else u.folded || s.h end)
  from up{k} u join (select g, max(lvl) as top from nodes{k} group by g) t on t.g = u.g and u.lvl < t.top
  left join nodes{k} s on s.g = u.g and s.lvl = u.lvl and s.pos = xor(u.pos, 1)
), end{k} as (
  select u.* from up{k} u join (select g, max(lvl) as top from nodes{k} group by g) t on t.g = u.g and u.lvl = t.top
)"""

    def leaf(n_chars: str) -> str:
        parts = [f"coalesce(octet_length(encode(cast({c} as varchar))) || ':' || cast({c} as varchar), '-')" for c in ("doc_id", "source", "lang", n_chars, "text")]
        return f"sha256({' || '.join(parts)})"

    return f"""
with recursive crc_table as (
  select list(v order by i) as t from (select i, list_reduce(list_concat([i], range(0, 8)), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(0, 256) r(i))
), keyed as (
  select *, coalesce('=' || lang, '') as g, row_number() over () as rid,
         list_transform(range(1, length(cast(doc_id as varchar)) + 1), lambda k: cast(ascii(substr(cast(doc_id as varchar), k, 1)) as bigint)) as bytes
  from documents
), coded as (
  select keyed.* exclude (bytes), xor(list_reduce(list_concat([4294967295], bytes), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as crc
  from keyed, crc_table
), leaf as (
  select rid, doc_id, g, crc, {leaf("n_chars")} as h, {leaf("n_chars + 1")} as changed from coded
), placed as (
  select *, row_number() over (partition by g order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by g) as n from leaf
), {tree(1, "placed")}, {walk(1, "select rid, g, pos, '' as proof, case when crc % 7 = 0 then changed else h end as folded from placed")}, tops as (
  select '' as g, g as language, row_number() over (order by g) - 1 as pos, count(*) over () as n, h from nodes1 where n = 1
), {tree(2, "tops")}, {walk(2, "select e.rid, '' as g, t.pos, e.proof, e.folded from end1 e join tops t on t.language = e.g")}
select p.doc_id, p.h as leaf, t.h as subroot, r.h as root, sha256(e.proof) as proof_sha256, e.folded as folded_root, e.folded = r.h as verified
from placed p join tops t on t.language = p.g join end2 e on e.rid = p.rid join nodes2 r on r.n = 1
"""
