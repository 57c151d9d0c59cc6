"""Deduplication and record linkage: keep-first cascades, greedy fuzzy dedup, tiered matching, alias closure."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foliospark.functions import names, text
from foliospark.operators.community import components
from foliospark.operators.relational import cut, keep_first
from foliospark.tables import Table

#: Names of one block, pairs of names that are compared at once, and groups of blocks that small groups of names share.
NAMES, PRODUCT, BUCKETS = 8192, 1 << 22, 1024
#: Words of a set's sketch, sets of an item that meet in one part, and of one of its rows of pairs.
SKETCH, PART, TILE = 4, 8192, 256
#: Merged people that are handed on at once.
MERGED = 10_000


def with_id(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def _sketch(hashes: Column) -> Column:
    """SKETCH words of 64 bits, of which each item of a set turns one: two sets' differ in as many bits at most as they have items apart."""
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))
    word = lambda k: F.aggregate(hashes, F.lit(0).cast("long"), lambda a, x: F.when(F.pmod(F.shiftright(x, 6), F.lit(SKETCH)) == k, a.bitwiseXOR(one(x))).otherwise(a))
    return F.array(*[word(k) for k in range(SKETCH)])


def _near(sketch: np.ndarray, n: np.ndarray, at: np.ndarray, low: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of sets of sizes n that may be similar by their sketches and by the place ``at`` of the item that they share: of a part (low) and the
    other one, or of one part if that is all."""
    # the greatest set that one can be similar to if this is the first item they share
    most = (n - at) * (1 + threshold) / threshold - n + 1e-6
    order = np.lexsort((at, n))
    left, right = order[low[order]], order[~low[order]]
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    for x, y in ((left, left),) if not len(right) else ((left, right), (right, left)):
        for k in range(0, len(x), TILE):  # the greater ones, or of equal ones the later
            i = x[k : k + TILE]
            j = y[np.searchsorted(n[y], threshold * n[i[0]] - 1e-6) : np.searchsorted(n[y], min(n[i[-1]], most[i].max()), side="right")]
            j = j[most[j] >= n[i[0]]]
            if not len(j):
                continue
            apart = np.zeros((len(i), len(j)), np.uint16)
            for w in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[i, w][:, None] ^ sketch[j, w][None, :])
            u, v = np.nonzero(apart <= ((1 - threshold) / (1 + threshold) * (n[i] + n[i]) + 1e-6)[:, None])
            u, v = i[u], j[v]
            fit = place[v] < place[u]
            yield u[fit], v[fit]


def similar_pairs(df: DataFrame, id_col: str, set_col: str, threshold: float) -> DataFrame:
    """(a, b, score): pairs a < b of rows whose sets have a Jaccard similarity of at least ``threshold``.

    Prefix filter: sets' items are ordered from rare to frequent over the whole table; a pair as similar as that shares an
    item among the first n - ceil(t * n) + 1 of both. Only sets of such an item meet, so frequent items hardly take part, and no
    pair is lost. Those of an item meet inside a task, in parts of a bounded number, by sketches that differ in no more bits than
    the sets have items apart; only pairs that may be similar by these are written, and they are verified on the whole sets.
    """
    sets = Table(df.select(F.col(id_col).alias("id"), F.array_distinct(F.array_compact(set_col)).alias("s")).where(F.size("s") > 0)).df
    items = sets.select("id", F.explode("s").alias("t"))
    freq = items.groupBy("t").agg(F.count(F.lit(1)).alias("f"))
    n = F.size("s")
    keep = n - F.ceil(F.lit(threshold) * n - 1e-9).cast("int") + 1
    # an item that no other set has makes no pair
    first = items.join(freq, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("f", F.xxhash64("t").alias("t")))).alias("s"))
    first = first.select("id", n.alias("n"), _sketch(F.transform("s", lambda x: x["t"])).alias("w"), F.posexplode(F.slice("s", F.lit(1), keep)).alias("at", "x"))
    prefix = Table(first.where("x.f > 1").select("id", "n", "at", "w", "x.t")).df
    parts = F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")
    dealt = prefix.join(prefix.groupBy("t").agg(F.count(F.lit(1)).alias("k"), parts).where("k > 1").drop("k"), "t")
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")
    dealt = dealt.select("t", "id", "n", "at", "w", part.alias("part"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    key = ["t", "low", "high"]
    dealt = dealt.select("t", F.least("part", "with").alias("low"), F.greatest("part", "with").alias("high"), "id", "n", "at", "w", (F.col("part") <= F.col("with")).alias("is_low"))
    kind = df.schema[id_col].dataType

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            k = np.stack([rows[c].to_numpy() for c in key])
            ends = np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [rows.num_rows]))
            w = rows["w"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
            n, at, low, ids = rows["n"].to_numpy(), rows["at"].to_numpy(), rows["is_low"].to_numpy(), rows["id"].combine_chunks()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                if b - a > 1:
                    for i, j in _near(w[a:b], n[a:b], at[a:b], low[a:b], threshold):
                        if len(i):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + a)), ids.take(pa.array(j + a))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # whole groups go on, the last one may not have ended
            last = np.stack([batch.column(c).to_numpy() for c in key])
            same = (last == last[:, -1:]).all(0)
            begins = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if begins or held and any(held[0].column(c)[-1 if len(held) == 1 else 0].as_py() != batch.column(c)[0].as_py() for c in key):
                yield from pairs(pa.Table.from_batches([*held, *([batch.slice(0, begins)] if begins else [])]))
                held = [batch.slice(begins)]
            else:
                held.append(batch)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    pair = T.StructType([T.StructField("a", kind), T.StructField("b", kind)])
    found = dealt.repartition(*key).sortWithinPartitions(*key).mapInArrow(meet, pair)
    found = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cand = Table(found).df
    full = cand.join(sets.withColumnsRenamed({"id": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"id": "b", "s": "sb"}), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return full.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("score")).where(F.col("score") >= threshold)


def greedy_keep(df: DataFrame, id_col: str, pairs: DataFrame) -> DataFrame:
    """Rows that remain when, in order of id, each row goes that is similar to an earlier one that remained.

    Every round settles the rows whose earlier partners are settled: a row with a kept partner goes, a row all of whose
    partners went stays. The least row of the open pairs is settled in each round, so the rounds end, and the result is that
    of the sequential pass. Pairs count with a < b.
    """
    some = {"n": F.count(F.lit(1))}
    open_ = Table(pairs.select("a", "b").where("a < b").distinct(), some)
    gone = []
    while open_.metrics["n"]:
        ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(False).alias("later")), F.struct(F.col("b").alias("id"), F.lit(True).alias("later"))))
        # partners that have no open earlier partner of their own stay, and theirs go
        kept = open_.df.select(ends.alias("e")).groupBy("e.id").agg(F.max("e.later").alias("later")).where("not later").select("id")
        settled = Table(open_.df.join(kept, F.col("a") == F.col("id")).select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(False).alias("lost")), F.struct(F.col("b").alias("id"), F.lit(True).alias("lost")))).alias("e")).select("e.*").distinct())
        done = settled.df.select("id")
        left = Table(open_.df.join(done, F.col("a") == F.col("id"), "left_anti").join(done, F.col("b") == F.col("id"), "left_anti"), some)
        gone.append(settled.df.where("lost").select("id"))
        open_.drop()
        open_ = left
    if not gone:
        return df
    lost = reduce(DataFrame.unionByName, gone).select(F.col("id").alias("_lost"))
    return df.join(lost, F.col(id_col) == F.col("_lost"), "left_anti")


def dedup_papers(df: DataFrame, order: str, title: str = "title", existing: DataFrame | None = None, threshold: float = 0.8, least: int = 10, compat: bool = False) -> DataFrame:
    """Papers without those whose title is in ``existing``, is that of an earlier paper, or resembles an earlier one's.

    Titles are compared without case and blanks; resemblance is the Jaccard similarity of trigrams, for titles of
    ``least`` characters or more. compat: all rows with an empty title count as one.
    """
    keyed = df.withColumn("_t", text.squashed(F.col(title)))
    if existing is not None:
        keyed = keyed.join(existing.select(text.squashed(F.col(title)).alias("_t")).distinct(), "_t", "left_anti")
    once = keep_first(keyed, ["_t"], [order], empty_is_unique=not compat)
    sets = once.where(F.length("_t") >= least).select(order, text.trigrams(F.col("_t")).alias("g"))
    return greedy_keep(once, order, similar_pairs(sets, order, "g", threshold)).drop("_t")


def dedup_publications(df: DataFrame, order: str, compat: bool = False) -> DataFrame:
    """By completeness, then year, latest first: first of each DOI, of each link, and of each (title, year)."""
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") if compat else (F.coalesce(F.trim(c), F.lit("")) != "").cast("int") for c in ("abstract", "keywords", "doi")])
    ranked = df.withColumns({"_c": -filled, "_y": F.coalesce(F.col("year").cast("string"), F.lit(""))})
    ranked = ranked.withColumn("_y", F.translate("_y", "0123456789", "9876543210"))  # later years sort first, as text
    by = ["_c", "_y", order]
    doi = F.when(F.col("doi").rlike("10." if compat else r"^10\."), F.lower("doi"))
    out = keep_first(ranked, [doi], by)
    out = keep_first(out, [F.trim(F.coalesce("link", F.lit("")))], by, empty_is_unique=not compat)
    year = F.when(F.coalesce(F.col("year").cast("string"), F.lit("")).rlike(r"^\d{4}$"), F.col("year").cast("string")).otherwise("unknown")
    name = text.squashed(F.col("title"))
    with_title, without = out.where(name != ""), out.where(name == "")
    return keep_first(with_title, [name, year], by).unionByName(without).drop("_c", "_y")


def tiered_match(left: DataFrame, right: DataFrame, tiers: list[tuple], left_id: str, right_id: str) -> DataFrame:
    """(right_id, left_id, tier): for each right row its left row by the first tier that has one.

    A tier is (name, key of left, key of right, score): an equi-join on the keys, then, with a score, those of a positive
    score with the best first; else the first left row. Or it is (name, function): of left and the open right rows it makes the
    pairs (left_id, right_id, _s). Later tiers see only right rows that earlier ones left over.
    """
    done, out = None, []
    for name, *how in tiers:
        rest = right if done is None else right.join(done, right_id, "left_anti")
        if len(how) == 1:
            both = how[0](left, rest)
        else:
            lk, rk, score = how
            l_, r_ = left.withColumn("_k", lk), rest.withColumn("_k", rk)
            both = l_.where(F.coalesce("_k", F.lit("")) != "").join(r_.where(F.coalesce("_k", F.lit("")) != ""), "_k")
            both = both.withColumn("_s", score if score is not None else F.lit(1.0)).where("_s > 0")
        hit = both.groupBy(right_id).agg(F.min_by(left_id, F.struct(-F.col("_s"), F.col(left_id))).alias(left_id), F.max("_s").alias("score")).withColumn("tier", F.lit(name))
        hit = cut(hit)  # every later tier reads it
        out.append(hit)
        done = hit.select(right_id) if done is None else done.unionByName(hit.select(right_id))
    return reduce(DataFrame.unionByName, out)


def _coded(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Names as rows of character codes, -1 behind their ends, and their lengths. The rarest of over 255 characters share a code, so
    that what two names share is never counted too low."""
    n = np.fromiter(map(len, names), np.int64, len(names))
    points = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, at, count = np.unique(points, return_inverse=True, return_counts=True)
    code = np.empty(len(kinds), np.int64)
    code[np.argsort(-count, kind="stable")] = np.minimum(np.arange(len(kinds)), 255)
    out = np.full((len(names), n.max()), -1)
    out[np.arange(n.max()) < n[:, None]] = code[at]
    return out, n


def _numbered(codes: np.ndarray) -> np.ndarray:
    """A row of 0 and 1 for each name: whether it has a character once at least, twice at least, and so on. Products of rows count shared characters."""
    of, at = np.nonzero(codes >= 0)
    c = codes[of, at]
    order = np.lexsort((c, of))
    of, c = of[order], c[order]
    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (c[1:] != c[:-1]))))
    nth = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate((first, [len(c)]))))
    place = np.unique(c * (codes.shape[1] + 1) + nth, return_inverse=True)[1]
    out = np.zeros((len(codes), place.max() + 1), np.float32)
    out[of, place] = 1
    return out


def _subsequence(codes: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of names x and y (places in codes), of which x has 64 characters at most: a bit for each character of x."""
    masks = np.zeros((len(codes), codes.max() + 1), np.uint64)
    for k in range(min(64, codes.shape[1])):
        some = np.flatnonzero(codes[:, k] >= 0)
        masks[some, codes[some, k]] |= np.uint64(1 << k)
    v = np.full(len(x), ~np.uint64(0))
    for k in range(int(n[y].max())):
        c = codes[y, k]
        u = v & np.where(c >= 0, masks[x, c], np.uint64(0))
        v = (v + u) | (v - u)
    inside = np.where(n[x] >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(n[x], 63).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~v & inside).astype(np.int64)


def alike_in(left: list[str], right: list[str], threshold: float) -> Iterator[tuple[int, int]]:
    """Places of names whose ratio of matching blocks may reach the threshold: as far as shared characters and common subsequences tell, which
    matched characters are. Bounded in memory by ``PRODUCT`` pairs at once."""
    codes, n = _coded(left + right)
    rows, at = _numbered(codes), len(left)
    step = max(1, PRODUCT // len(right))
    for a in range(0, len(left), step):
        b = min(a + step, len(left))
        x, y = np.nonzero(rows[a:b] @ rows[at:].T >= (threshold / 2 * (n[a:b, None] + n[None, at:]) - 1e-6).astype(np.float32))
        x, y = x + a, y + at
        short = n[x] <= n[y]
        one, two = np.where(short, x, y), np.where(short, y, x)
        told = n[one] > 64
        few = np.flatnonzero(~told)
        if len(few):
            told[few] = _subsequence(codes, n, one[few], two[few]) >= threshold / 2 * (n[one[few]] + n[two[few]]) - 1e-6
        yield from zip(x[told].tolist(), (y[told] - at).tolist())


def similar_names(left: DataFrame, right: DataFrame | None, threshold: float, within: list[str] | None = None, either: bool = False) -> DataFrame:
    """(lname, rname, *within, score): pairs of distinct names, equal in the columns ``within``, whose ratio of matching blocks reaches the threshold.

    left and right: name and the columns ``within``. right None: left's own pairs lname < rname. All names of a group meet, in blocks of bounded
    numbers of names that are dealt over tasks: products of matrices count the characters that two names share, a bit for each character
    gives the longest common subsequence of those that share enough, and only what that leaves is compared block by block. So no pair is lost, and only
    similar ones are written. either: the better ratio of both orders, since it isn't symmetric.
    """
    within = within or []
    own = right is None
    both = left.select(F.lit(True).alias("is_left"), "name", *within)
    if not own:
        both = both.unionByName(right.select(F.lit(False).alias("is_left"), "name", *within))
    good = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in within], F.col("name") != "")
    rows = Table(both.where(good).distinct().withColumn("bucket", F.pmod(F.xxhash64(*within) if within else F.lit(0).cast("long"), F.lit(BUCKETS)).cast("int"))).df
    held = rows.groupBy("bucket").agg(*[F.greatest(F.lit(1), F.ceil(F.count_if(side) / NAMES)).cast("int").alias(c) for c, side in (("lefts", F.col("is_left")), ("rights", ~F.col("is_left")))])
    dealt = rows.join(F.broadcast(held), "bucket")
    part = F.pmod(F.xxhash64("name", F.lit(1)), F.when(F.col("is_left"), F.col("lefts")).otherwise(F.col("rights"))).cast("int")
    meets = F.sequence(F.lit(0), F.when(F.col("is_left") & ~F.lit(own), F.col("rights")).otherwise(F.col("lefts")) - 1)
    dealt = dealt.select("bucket", "is_left", "name", *within, part.alias("part"), F.explode(meets).alias("with"))
    if own:  # parts of one table meet once, the least first
        dealt = dealt.withColumns({"is_left": F.col("part") <= F.col("with"), "low": F.least("part", "with"), "high": F.greatest("part", "with")})
    else:
        dealt = dealt.withColumns({"low": F.when(F.col("is_left"), F.col("part")).otherwise(F.col("with")), "high": F.when(F.col("is_left"), F.col("with")).otherwise(F.col("part"))})
    kinds = T.StructType([T.StructField("lname", T.StringType()), T.StructField("rname", T.StringType()), *[left.schema[c] for c in within], T.StructField("score", T.DoubleType())])

    def work(block: pa.Table) -> pa.Table:
        held = block.to_pydict()
        groups: dict[tuple, tuple[list[str], list[str]]] = {}
        one_part = own and held["low"][0] == held["high"][0]
        for name, is_left, *key in zip(held["name"], held["is_left"], *[held[c] for c in within]):
            groups.setdefault(tuple(key), ([], []))[0 if is_left else 1].append(name)
        out = []
        for key, (ls, rs) in groups.items():
            rs = ls if one_part else rs
            for x, y in alike_in(ls, rs, threshold) if ls and rs else ():
                l, r = ls[x], rs[y]
                if own:
                    if l == r or one_part and l > r:
                        continue
                    l, r = min(l, r), max(l, r)
                score = names.SequenceMatcher(None, l, r).ratio()
                if either:
                    score = max(score, names.SequenceMatcher(None, r, l).ratio())
                if score >= threshold:
                    out.append((l, r, *key, score))
        told = list(zip(*out)) if out else [()] * len(kinds)
        return pa.table({f.name: pa.array(v, to_arrow_type(f.dataType)) for f, v in zip(kinds, told)})

    columns = ["name", "is_left", "low", "high", *within]
    return dealt.select("bucket", *columns).groupBy("bucket", "low", "high").applyInArrow(work, kinds)


def _similar_tier(lname: str, rname: str, threshold: float, left_id: str, right_id: str, first_letter: bool = False):
    """A tier of tiered_match: names of a ratio that reaches the threshold, with the same first letter if so asked."""

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        letter = {"letter": F.substring("name", 1, 1)} if first_letter else {}
        l_, r_ = left.select(F.col(lname).alias("name")).withColumns(letter), right.select(F.col(rname).alias("name")).withColumns(letter)
        found = similar_names(l_, r_, threshold, list(letter)).select(F.col("lname").alias("_l"), F.col("rname").alias("_r"), F.col("score").alias("_s"))
        return found.join(left.select(left_id, F.col(lname).alias("_l")), "_l").join(right.select(right_id, F.col(rname).alias("_r")), "_r")

    return pairs


def link_people(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Two people tables (pos, name normalised, number, unit): by name, by number, by a name's beginning in the unit, by similarity.

    A beginning has three words at least, so both names have the first two in common. Similarity is asked for within the same first
    letter only, as between equal persons' names.
    """
    l_ = left.selectExpr("pos as lpos", "name as lname", "number as lnumber", "unit as lunit")
    r_ = right.selectExpr("pos as rpos", "name as rname", "number as rnumber", "unit as runit")
    words = lambda c: F.size(F.split(c, " "))
    begins = (F.least(words(F.col("lname")), words(F.col("rname"))) >= 3) & (F.col("lname").startswith(F.col("rname")) | F.col("rname").startswith(F.col("lname")))
    two = lambda unit, name: F.when(words(F.col(name)) >= 3, F.concat_ws("|", unit, F.substring_index(name, " ", 2)))
    return tiered_match(
        l_, r_,
        [
            ("name", F.col("lname"), F.col("rname"), None),
            ("number", F.col("lnumber"), F.col("rnumber"), None),
            ("prefix", two("lunit", "lname"), two("runit", "rname"), F.when(begins, 1.0).otherwise(0.0)),
            ("fuzzy", _similar_tier("lname", "rname", threshold, "lpos", "rpos", first_letter=True)),
        ],
        "lpos", "rpos",
    )


def match_authors(papers: DataFrame, people: DataFrame, keep_unmatched: bool = False, sep: str = ", ") -> DataFrame:
    """(paper_id, authors, ids): each author by the equal matching name, else by last name and initials; the owner comes first.

    papers: paper_id, authors (by ";" or ","), owner_id or null. people: pos, name, id. The first person by pos wins.
    """
    p = people.select("pos", "id", "name", names.for_matching(F.col("name")).alias("m")).withColumns({"last": F.element_at(F.split("m", " "), -1), "i": F.substring("m", 1, 1)})
    # the owner stands before the authors, all in one list; who an author is depends on the name alone, so each name is matched once
    said = F.transform(text.parts(F.col("authors")), lambda x, k: F.struct(k.alias("at"), x.alias("author"), F.lit(None).cast("string").alias("own")))
    owner = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("author"), F.col("owner_id").cast("string").alias("own")))
    each = papers.select("paper_id", F.inline(F.concat(F.when(F.col("owner_id").isNotNull(), owner).otherwise(F.slice(owner, 1, 0)), said)))
    a = Table(papers.select(F.explode(text.parts(F.col("authors"))).alias("author")).distinct()).df.withColumn("m", names.for_matching(names.flip(F.col("author"))))
    a = a.withColumns({"last": F.element_at(F.split("m", " "), -1), "i": F.substring("m", 1, 1)})
    first = lambda *keys: p.groupBy(*keys).agg(F.min_by(F.struct("id", "name"), "pos").alias("who"))
    exact = a.join(first("m"), "m").select("author", "who")
    near = a.join(exact, "author", "left_anti").where(F.size(F.split(F.col("m"), " ")) > 1).join(first("last", "i"), ["last", "i"]).select("author", "who")
    found = Table(exact.unionByName(near)).df
    owners = p.select(F.col("id").cast("string").alias("own"), F.col("name").alias("own_name"), F.lit(True).alias("known"))
    told = each.join(found, "author", "left").join(owners, "own", "left")
    good = F.when(F.col("at") < 0, F.col("known")).otherwise(F.lit(True) if keep_unmatched else F.col("who").isNotNull())
    listed = told.where(good).select("paper_id", "at", F.coalesce("own", "who.id", F.lit("")).alias("id"), F.when(F.col("at") < 0, F.col("own_name")).otherwise(F.coalesce("who.name", "author")).alias("name"))
    rows = listed.groupBy("paper_id", "id", "name").agg(F.min("at").alias("at"))
    grouped = rows.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("at", "name", "id"))).alias("x"))
    return grouped.select("paper_id", F.array_join(F.transform("x", lambda e: e["name"]), sep).alias("authors"), F.array_join(F.transform("x", lambda e: e["id"]), sep).alias("ids"))


def matched_with_ambiguity(left: DataFrame, tiers: list[tuple[str, int, DataFrame]], left_id: str = "lid") -> DataFrame:
    """(left_id, right_id, strategy, score): the first tier with candidates; several of them make it "-ambiguous".

    A tier is (name, score, candidates (left_id, right_id)).
    """
    per = reduce(DataFrame.unionByName, [c.groupBy(left_id).agg(F.count_distinct("rid").alias("n"), F.min("rid").alias("rid")).select(left_id, F.lit(k).alias("k"), F.lit(n).alias("s"), F.lit(v).alias("score"), "n", "rid") for k, (n, v, c) in enumerate(tiers)])
    return _first_tier(left, per, left_id)


def matched_by_keys(left: DataFrame, right: DataFrame, tiers: list[tuple[str, int, Column, Column]], left_id: str = "lid", right_id: str = "rid") -> DataFrame:
    """``matched_with_ambiguity`` where candidates share a key: a tier is (name, score, key of left, key of right).

    Right rows are counted by key before they are joined, so a key that many rows of both sides have makes no pairs.
    """
    per = []
    for k, (name, score, lk, rk) in enumerate(tiers):
        kinds = right.select(rk.alias("_k"), F.col(right_id).alias("rid")).where("_k is not null and rid is not null").groupBy("_k").agg(F.count_distinct("rid").alias("n"), F.min("rid").alias("rid"))
        met = left.select(left_id, lk.alias("_k")).join(kinds, "_k")
        # a left id of several keys may have candidates under each; one candidate counts once
        one = F.when((F.min("rid") == F.max("rid")) & (F.max("n") == 1), F.lit(1)).otherwise(F.lit(2)).cast("long")
        per.append(met.groupBy(left_id).agg(one.alias("n"), F.min("rid").alias("rid")).select(left_id, F.lit(k).alias("k"), F.lit(name).alias("s"), F.lit(score).alias("score"), "n", "rid"))
    return _first_tier(left, reduce(DataFrame.unionByName, per), left_id)


def _first_tier(left: DataFrame, per: DataFrame, left_id: str) -> DataFrame:
    """left's rows with the first tier that has candidates. per: left_id, k, s, score, n (candidates), rid."""
    best = per.groupBy(left_id).agg(F.min_by(F.struct("n", "rid", "s", "score"), "k").alias("b"))
    strategy = F.when(F.col("b.n") == 1, F.col("b.s")).otherwise(F.concat("b.s", F.lit("-ambiguous")))
    return left.select(left_id).join(best, left_id, "left").select(left_id, F.when(F.col("b.n") == 1, F.col("b.rid")).alias("right_id"), F.coalesce(strategy, F.lit("unmatched")).alias("strategy"), F.coalesce("b.score", F.lit(0)).alias("score"))


def resolve_aliases(alias: DataFrame) -> DataFrame:
    """(src, dst): where each alias ends, however long the chain is. On a cycle it ends at the first key met twice.

    Pointers double in each round, so a chain of n links takes log2(n) rounds; what still moves then leads into a cycle and
    is walked step by step.
    """
    now, moved = cut(alias.select("src", "dst")), True
    for _ in range(alias.count().bit_length() + 1):
        step = now.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
        nxt = cut(now.join(step, F.col("dst") == F.col("s2"), "left").select("src", F.coalesce("d2", "dst").alias("dst"), F.col("d2").isNotNull().alias("moved")))
        now, moved = nxt.select("src", "dst"), bool(nxt.where("moved").head(1))
        if not moved:
            return now
    step = alias.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
    circling = now.join(step.select(F.col("s2").alias("dst")).distinct(), "dst", "left_semi").select("src")
    walk = cut(alias.join(circling, "src", "left_semi").select("src", "dst", F.array("src").alias("seen")))
    while moved:
        nxt = walk.join(step, (F.col("dst") == F.col("s2")) & ~F.array_contains("seen", F.col("dst")), "left")
        nxt = cut(nxt.select("src", F.coalesce("d2", "dst").alias("dst"), F.when(F.col("d2").isNotNull(), F.concat("seen", F.array("dst"))).otherwise(F.col("seen")).alias("seen"), F.col("d2").isNotNull().alias("moved")))
        walk, moved = nxt.drop("moved"), bool(nxt.where("moved").head(1))
    return now.join(circling, "src", "left_anti").unionByName(walk.select("src", "dst"))


def apply_aliases(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(paper_id, keys sorted, merged): each paper's keys through the aliases, and how many changed."""
    r = refs.join(resolved, F.col("key") == F.col("src"), "left").withColumn("to", F.coalesce("dst", "key"))
    return r.groupBy("paper_id").agg(F.sort_array(F.collect_set("to")).alias("keys"), F.count_if(F.col("to") != F.col("key")).alias("merged"))


def abbreviation_aliases(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(src, dst): keys of short forms to keys of long forms; the last occurrence in order of id and text counts."""
    found = df.select(F.col(id_col).alias("id"), F.posexplode(text.abbreviations(F.col(text_col))).alias("at", "p"))
    return found.groupBy(text.plain(F.col("p.short")).alias("src")).agg(F.max_by(text.plain(F.col("p.long")), F.struct("id", "at")).alias("dst")).where("src <> '' and src <> dst")


def register_entities(df: DataFrame) -> DataFrame:
    """(key, text, label, n, first): one entity for each key; the best source names it, then the earliest mention.

    df: key, text, label, source (1 is best), pos. ``first`` is the key's first mention, whose order is that of arrival.
    """
    per = df.groupBy("key").agg(F.min_by(F.struct("text", "label"), F.struct("source", "pos")).alias("b"), F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return per.select("key", F.col("b.text").alias("text"), F.col("b.label").alias("label"), "n", "first")


def fill_cascade(df: DataFrame, key: str, providers: list[DataFrame], columns: list[str]) -> DataFrame:
    """Empty fields filled from landed provider tables, in their order; ``enriched`` tells whether any was."""
    out = df
    for k, p in enumerate(providers):
        own = [c for c in columns if c in p.columns]
        p = p.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{k}_{c}") for c in own])
        out = out.join(p, F.col(key) == F.col("_key"), "left").drop("_key")
    filled = {c: F.coalesce(*[F.nullif(F.trim(F.col(x)), F.lit("")) for x in [c, *[f"_{k}_{c}" for k, p in enumerate(providers) if c in p.columns]]]) for c in columns}
    was = reduce(lambda a, b: a | b, [(F.coalesce(F.trim(c), F.lit("")) == "") & v.isNotNull() for c, v in filled.items()])
    return out.withColumn("enriched", was).select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns], "enriched")


def _passed(rows: list[dict], threshold: float) -> list[dict]:
    """The rows of one group, which are in order, merged."""
    kept: list[dict] = []
    ids = lambda r: sum(bool(r[c]) for c in ("scholar_id", "number"))
    for row in rows:
        for k in kept:
            same = any(row[c] and row[c] == k[c] for c in ("scholar_id", "number"))
            if same or row["name"] and k["name"] and names.SequenceMatcher(None, row["name"].lower(), k["name"].lower()).ratio() >= threshold:
                base, other = (dict(row), k) if ids(row) > ids(k) else (k, row)
                for c in ("scholar_id", "number"):
                    base[c] = base[c] or other[c]
                base["name"] = max(base["name"] or "", other["name"] or "", key=len)
                base["pos"] = min(row["pos"], k["pos"])
                k.update(base)
                break
        else:
            kept.append(dict(row))
    return kept


def _merged(part, threshold: float):
    """The same of a frame with the columns pos and rid, by which it is put in order."""
    import pandas as pd

    rows = part.sort_values(["pos", "rid"]).drop(columns="rid").to_dict("records")
    return pd.DataFrame(_passed(rows, threshold), columns=["unit", "pos", "name", "scholar_id", "number"])


def merge_people(df: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Within a unit, people with similar names or a common id become one: the one with more ids, the other's ids, the longer name.

    df: unit, pos, name, scholar_id, number. The result is that of one pass in order of pos over each unit, in which merged people go on under
    their new name and ids. A merged person's name and ids are those of some row of it, so whoever joins it resembles one of its
    rows: people of different connected components of that resemblance never meet, and each component is passed through by itself.
    So a unit isn't one task's, but only those rows of it that hang together. Rows without a unit are nobody's colleagues and stay as they are.
    """
    columns = ["unit", "pos", "name", "scholar_id", "number"]
    rows = Table(df.select(*columns).withColumn("rid", F.monotonically_increasing_id())).df
    staff = rows.where("unit is not null").withColumn("key", F.col("rid"))
    lower = staff.select(F.lower("name").alias("name"), "unit").where("name is not null")
    # names meet their first bearer, so that equal names give one edge each
    bearers = staff.where("name <> ''").groupBy("unit", F.lower("name").alias("name")).agg(F.min("key").alias("first"))
    alike = similar_names(lower, None, threshold, ["unit"], either=True)
    first = lambda c: bearers.select("unit", F.col("name").alias(c), F.col("first").alias(f"{c}_first"))
    edges = alike.join(first("lname"), ["unit", "lname"]).join(first("rname"), ["unit", "rname"]).select(F.col("lname_first").alias("u"), F.col("rname_first").alias("v"))
    edges = edges.unionByName(staff.withColumn("name", F.lower("name")).join(bearers, ["unit", "name"]).select(F.col("key").alias("u"), F.col("first").alias("v")))
    for c in ("scholar_id", "number"):
        known = staff.where(F.coalesce(c, F.lit("")) != "").select("unit", "key", c)
        edges = edges.unionByName(known.join(known.groupBy("unit", c).agg(F.min("key").alias("v")), ["unit", c]).select(F.col("key").alias("u"), "v"))
    found = components(edges).df
    tied = staff.join(found, F.col("key") == F.col("node"), "left").withColumn("root", F.coalesce("root", "key"))

    kinds = T.StructType([T.StructField(c, T.LongType() if c == "pos" else T.StringType()) for c in columns])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, group, last = [], [], None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], to_arrow_type(f.dataType)) for f in kinds], names=columns)

        for batch in batches:
            held = batch.to_pydict()
            for root, *values in zip(held["root"], *[held[c] for c in columns]):
                if root != last:
                    out += _passed(group, threshold) if len(group) > 1 else group
                    group, last = [], root
                group.append(dict(zip(columns, values)))
            if len(out) >= MERGED:
                yield made()
                out = []
        out += _passed(group, threshold) if len(group) > 1 else group
        if out:
            yield made()

    # groups of two are many, so a task takes one after the other as they come
    met = tied.where("node is not null").select(*columns, "rid", "root").repartition("root").sortWithinPartitions("root", F.asc_nulls_last("pos"), "rid")
    met = met.select(*columns, "root").mapInArrow(merged, kinds)
    return met.unionByName(tied.where("node is null").select(*columns)).unionByName(rows.where("unit is null").select(*columns))


def synonym_aliases(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """(src, dst): aliases from synonym groups (group_id, canonical, member), as a model or a list gives them, to one key for all that hang together.

    Texts count by their plain key. A group of one key says nothing; one whose known members have different labels is refused
    as a clash. Groups that share a key are one; it goes by the canonical key of its groups that has the most mentions, of equal ones the least. entities: key, label, n.
    """
    told = groups.select("group_id", text.plain(F.col("canonical")).alias("c"), text.plain(F.col("member")).alias("m")).where("c <> '' and m <> ''")
    keys = told.select("group_id", F.explode(F.array_distinct(F.array("c", "m"))).alias("key")).distinct()
    known = keys.join(entities.select("key", "label"), "key", "left").groupBy("group_id").agg(F.count_distinct("key").alias("keys"), F.count_distinct("label").alias("labels"))
    good = Table(told.join(known.where("keys > 1 and labels <= 1"), "group_id").select("c", "m")).df
    found = components(good.select(F.col("c").alias("u"), F.col("m").alias("v"))).df
    heads = good.select(F.col("c").alias("node")).distinct().join(found, "node").join(entities.select(F.col("key").alias("node"), "n"), "node", "left")
    elected = heads.groupBy("root").agg(F.min_by("node", F.struct(-F.coalesce("n", F.lit(0)), F.col("node"))).alias("dst"))
    return found.join(elected, "root").where("node <> dst").select(F.col("node").alias("src"), "dst")
