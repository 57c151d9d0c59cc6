"""Mixing sources to target weights: a token budget goes down the tree domain - language - source.

1. A node's capacity is what its leaves can give in ``max_epochs`` epochs.
2. From the root down, a node's budget is shared among its children by weight. A child whose share is above its
   capacity gets its capacity and what it falls short by goes to its siblings, again by weight; only what a whole family
   can't take is given to the family's siblings, since the family's budget is cut to its capacity one level higher.
3. A leaf repeats its documents for the whole epochs its budget holds, and takes a prefix of one more epoch. Documents
   of an epoch are in the order of md5(seed:epoch:doc_id:md5(text)), so that no id or text can fill a place in the order
   by itself; the document at the budget's end is taken for the tokens that are left.

Tokens are words, runs of anything but ASCII white space. Shares are whole tokens, rounded down; a remainder of fewer
tokens than siblings stays unspent at each family.

DataFrame functions only. A leaf with a third of all rows isn't ordered as a whole: sums over the first byte of the hash
find the 1/256 of it where the budget ends, sums over the second byte the 1/65536, and only that is ordered.

Defined cases: null domain, language or source is the value ''; null text has no tokens and its document is never taken;
weights that are missing count as ``DEFAULT_WEIGHT``; what has a weight of 0 or less is left out before shares are made, and a
family of such children takes nothing; repeated rows are documents of their own; empty tables give no
rows; columns with clashing names are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Stored, fresh

DEFAULT_WEIGHT = 1
LEVELS = ("domain", "lang", "source")
_EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Mix:
    """Integer weights by name at each level; share: the budget as a fraction (numerator, denominator) of all tokens."""

    seed: int = 7
    share: tuple[int, int] = (1, 2)
    max_epochs: int = 3
    weights: dict[str, dict[str, int]] = field(default_factory=dict)
    #: SQL for a document's domain from its columns.
    domain: str = "''"


#: The production mix: three domains by the source's number, English first.
PRODUCTION = Mix(
    weights={"domain": {"web": 5, "books": 3, "talk": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 3}, "source": {"src0": 2, "src10": 3}},
    domain="case coalesce(try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) as int), 0) % 3 when 0 then 'web' when 1 then 'books' else 'talk' end",
)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weight(level: str, mix: Mix) -> Column:
    known = mix.weights.get(level, {})
    if not known:
        return F.lit(DEFAULT_WEIGHT).cast("long")
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(known.items())])
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(DEFAULT_WEIGHT)).cast("long")


def share_out(nodes: DataFrame, family: list[str], budget: str, out: str) -> DataFrame:
    """Column ``out``: each node's part of its family's ``budget``, by column w and up to column cap.

    By growing cap / w, the nodes that are filled up come first: node k is filled if cap_k * W_k <= w_k * B_k, with W_k
    and B_k the weight and budget left from k on. Past the first that isn't, all get w * B / W of that node.
    """
    w = Window.partitionBy(*family).orderBy((F.col("cap") / F.col("w")), *LEVELS)
    later = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.greatest(F.col(budget) - F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), F.lit(0))
    df = nodes.withColumn("w_left", F.sum("w").over(later)).withColumn("b_left", left)
    df = df.withColumn("full", F.col("cap").cast(_EXACT) * F.col("w_left") <= F.col("b_left").cast(_EXACT) * F.col("w"))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("r"), *LEVELS, "w_left", "b_left"))).over(Window.partitionBy(*family))
    df = df.withColumn("first", first)
    part = F.floor(F.col("first.b_left").cast(_EXACT) * F.col("w") / F.col("first.w_left")).cast("long")
    before = F.col("first").isNull() | (F.struct((F.col("cap") / F.col("w")), *LEVELS) < F.struct("first.r", *[f"first.{x}" for x in LEVELS]))
    return df.withColumn(out, F.when(before, F.col("cap")).otherwise(F.least(part, F.col("cap")))).drop("w_left", "b_left", "full", "first")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with budget long. Works on one row per leaf."""
    one = leaves.withColumn("cap0", F.col("tokens") * mix.max_epochs)
    for level in LEVELS:  # what can't be taken is no capacity of the nodes above
        one = one.where(_weight(level, mix) > 0)
    total = leaves.agg(F.coalesce(F.floor(F.sum("tokens").cast(_EXACT) * mix.share[0] / mix.share[1]), F.lit(0)).cast("long").alias("b0"))
    above = total.withColumn("root", F.lit(0))
    for depth, level in enumerate(LEVELS, 1):
        keys = list(LEVELS[:depth])
        rest = [F.lit("").alias(x) for x in LEVELS[depth:]]
        nodes = one.groupBy(*keys).agg(F.sum("cap0").alias("cap")).select(*keys, *rest, "cap").withColumn("w", _weight(level, mix)).where("w > 0")
        family = keys[:-1] or ["root"]
        nodes = nodes.withColumn("root", F.lit(0)) if depth == 1 else nodes
        nodes = share_out(nodes.join(above, family), family, f"b{depth - 1}", f"b{depth}")
        above = nodes.select(*keys, f"b{depth}")
    return leaves.join(above.withColumnRenamed("b3", "budget"), list(LEVELS))


def mix_documents(docs: DataFrame, mix: Mix = PRODUCTION, columns: list[str] | None = None) -> DataFrame:
    """The mix: for every document and epoch that is taken its ``columns`` (all by default) and domain, epoch, n_tokens and
    tokens_taken (fewer than n_tokens only where a leaf's budget ends). Clashing names of docs' columns keep theirs."""
    columns = docs.columns if columns is None else columns
    made = {x: fresh(docs, x) for x in ("domain", "epoch", "n_tokens", "tokens_taken")}
    lower = {c.lower() for c in docs.columns}
    has = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in lower else F.lit("")
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.expr(mix.domain).alias("domain"), has("lang").alias("lang"), has("source").alias("source"),
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), n_words(F.col("text")).alias("n"), F.md5(F.coalesce("text", F.lit(""))).alias("t"),
    ).fillna("", ["domain"]).where("n > 0")
    # words are counted once; rows without their text are kept with the counts, others are read again at the end
    narrow = "text" not in {c.lower() for c in columns}
    sized = Stored(base if narrow else base.drop("row")).df
    leaves = Stored(sized.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))).df
    budgets = Stored(leaf_budgets(leaves, mix).select(
        *LEVELS, F.expr("cast(budget div tokens as int)").alias("whole"), F.expr("budget % tokens").alias("rest"),
    ).where("whole > 0 or rest > 0")).df

    def keyed(df: DataFrame) -> DataFrame:
        h = F.md5(F.concat(F.lit(f"{mix.seed}:"), F.col("whole").cast("string"), F.lit(":"), F.col("id"), F.lit(":"), F.col("t")))
        return df.join(budgets, list(LEVELS)).withColumn("h", h).withColumns({"h1": F.substring("h", 1, 2), "h2": F.substring("h", 3, 2)})

    slim = keyed(sized).where("rest > 0").select(*LEVELS, "rest", "h1", "h2", "n")
    # the bucket of the first byte where the budget ends, and what is left of the budget there; then that of the second
    ends = budgets.where("rest > 0").select(*LEVELS, F.col("rest").alias("left"))
    found = []
    for k, key in enumerate(("h1", "h2")):
        part = slim if k == 0 else slim.join(found[0].select(*LEVELS, F.col("h1").alias("e1")), list(LEVELS)).where("h1 = e1")
        sums = part.groupBy(*LEVELS, key).agg(F.sum("n").alias("s"))
        lists = sums.groupBy(*LEVELS).agg(F.array_sort(F.collect_list(F.struct(key, "s"))).alias("xs"))
        walk = f"""aggregate(xs, named_struct('k', cast(null as string), 'left', left), (a, x) ->
            case when a.k is not null then a when x.s >= a.left then named_struct('k', x.{key}, 'left', a.left)
            else named_struct('k', cast(null as string), 'left', a.left - x.s) end)"""
        at = lists.join(ends, list(LEVELS)).withColumn("a", F.expr(walk)).select(*LEVELS, F.col("a.k").alias(key), F.col("a.left").alias("left"))
        found.append(Stored(at).df)
        ends = found[-1].select(*LEVELS, "left")
    cut = found[0].select(*LEVELS, F.col("h1").alias("e1")).join(found[1].select(*LEVELS, F.col("h2").alias("e2"), "left"), list(LEVELS))
    cut = Stored(cut).df
    placed = keyed(sized if narrow else base).join(cut, list(LEVELS), "left")
    inner = F.coalesce((F.col("h1") < F.col("e1")) | (F.col("h1") == F.col("e1")) & (F.col("h2") < F.col("e2")), F.lit(False))
    edge = F.coalesce((F.col("h1") == F.col("e1")) & (F.col("h2") == F.col("e2")), F.lit(False))
    epochs = F.col("whole") + F.when(inner, 1).otherwise(0)
    whole = placed.where(epochs > 0).select("row", "domain", F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch"), "n", F.col("n").alias("taken"))
    order = Window.partitionBy(*LEVELS).orderBy("h")
    last = placed.where(edge).withColumn("before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = last.where("before < left").select("row", "domain", F.col("whole").alias("epoch"), "n", F.least(F.col("n"), F.col("left") - F.col("before")).alias("taken"))
    return whole.unionByName(last).select(
        "row.*", F.col("domain").alias(made["domain"]), F.col("epoch").cast("long").alias(made["epoch"]),
        F.col("n").alias(made["n_tokens"]), F.col("taken").cast("long").alias(made["tokens_taken"]),
    )


def _sql_weight(level: str, mix: Mix) -> str:
    known = " ".join(f"when '{k}' then {v}" for k, v in mix.weights.get(level, {}).items())
    return f"case {level} {known} else {DEFAULT_WEIGHT} end" if known else str(DEFAULT_WEIGHT)


def oracle_sql(mix: Mix = PRODUCTION) -> str:
    """The same mix for DuckDB, by plain windows over whole leaves."""
    steps = []
    for depth, level in enumerate(LEVELS, 1):
        keys = ", ".join(LEVELS[:depth])
        family = ", ".join(LEVELS[: depth - 1])
        over = f"partition by {family} " if family else ""
        above = f"join b{depth - 1} using ({family})" if family else "cross join b0"
        steps.append(f"""n{depth} as (
  select {keys}, cast(sum(cap0) as hugeint) as cap, cast({_sql_weight(level, mix)} as hugeint) as w from leaves group by {keys}
), o{depth} as (
  select n{depth}.*, b, cap / w as r, row_number() over ({over}order by cap / w, {keys}) as k,
         sum(w) over ({over}order by cap / w, {keys} rows between current row and unbounded following) as wl,
         greatest(b - coalesce(sum(cap) over ({over}order by cap / w, {keys} rows between unbounded preceding and 1 preceding), 0), 0) as bl
  from n{depth} {above}
), f{depth} as (
  select {family + "," if family else ""} min(k) as k0 from o{depth} where not (cap * wl <= bl * w) {"group by " + family if family else ""}
), g{depth} as (
  select o.*, f.k0, first.bl as b0, first.wl as w0 from o{depth} o
  left join f{depth} f {"using (" + family + ")" if family else "on true"}
  left join o{depth} first on {" and ".join([f"first.{x} = o.{x}" for x in LEVELS[: depth - 1]] + ["first.k = f.k0"])}
), b{depth} as (
  select {keys}, case when k0 is null or k < k0 then cap else least((b0 * w) // w0, cap) end as b from g{depth}
)""")
    domain = mix.domain.replace("[0-9]{1,9}", "[0-9]{1,9}")
    return f"""
with d as (
  select *, {domain} as domain from (
    select doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n from documents) where n > 0
), all_leaves as (
  select domain, lang, source, sum(n) as tokens, sum(n) * {mix.max_epochs} as cap0 from d group by all
), leaves as (
  select * from all_leaves where {" and ".join(f"({_sql_weight(x, mix)}) > 0" for x in LEVELS)}
), b0 as (
  select (cast(sum(tokens) as hugeint) * {mix.share[0]}) // {mix.share[1]} as b from all_leaves
), {", ".join(steps)}, budgets as (
  select domain, lang, source, b // tokens as whole, b % tokens as rest from b3 join leaves using (domain, lang, source)
), k as (
  select d.*, whole, rest, md5('{mix.seed}:' || whole || ':' || coalesce(cast(doc_id as varchar), '') || ':' || md5(text)) as h from d join budgets using (domain, lang, source)
), s as (
  select *, coalesce(sum(n) over (partition by domain, lang, source order by h rows between unbounded preceding and 1 preceding), 0) as before from k
)
select doc_id, lang, source, domain, cast(epoch as bigint) as epoch, cast(n as bigint) as n_tokens,
       cast(case when epoch < whole then n else least(n, rest - before) end as bigint) as tokens_taken
from (select *, unnest(range(0, cast(whole + case when before < rest then 1 else 0 end as bigint))) as epoch from s)
"""
