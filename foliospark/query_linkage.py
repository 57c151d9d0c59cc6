"""Queries on deduplication, matching and sinks."""

import uuid

from pyspark.sql import functions as F

from foliospark.functions import text
from foliospark.operators import linkage, relational
from foliospark.queries import Tables, query
from foliospark.shared import shared_dir
from foliospark.sources import readers, sinks


#: Titles are the first eight words of documents, thousands of different ones with copies among them.
TITLES = "select doc_id, array_to_string(string_split(text, ' ')[1:8], ' ') as title from documents"
#: Trigrams of squashed titles, one row a title; pairs of them by their Jaccard similarity.
_SETS = """s as (select id, t, case when length(t) > 2 then list_distinct([substring(t, i, 3) for i in range(1, length(t) - 1)]) else [] end as g from once where length(t) >= 10),
    items as (select id, len(g) as n, unnest(g) as x from s),
    common as (select a.id as a, b.id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as c from items a join items b on a.x = b.x and a.id < b.id and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4 group by 1, 2),
    pairs as (select a, b, c / (na + nb - c) as score from common)"""


def _titles(t: Tables):
    return t.documents.select("doc_id", F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("title"))


@query("e1_dedup_titles", f"""
with recursive titles as ({TITLES}), once as (select min(doc_id) as id, replace(lower(trim(title)), ' ', '') as t from titles group by 2),
    {_SETS}, near as (select b, list(a) as earlier from pairs where score >= 0.8 group by b),
    numbered as (select id, coalesce(earlier, []) as earlier, row_number() over (order by id) as r from once left join near on b = id where id in (select a from pairs where score >= 0.8 union select b from pairs where score >= 0.8)),
    walk(r, kept) as (select cast(0 as bigint), cast([] as bigint[]) union all
        select n.r, case when list_has_any(kept, n.earlier) then kept else list_append(kept, n.id) end from walk join numbered n on n.r = walk.r + 1)
select id as doc_id from once where id not in (select id from numbered) or id in (select unnest(kept) from walk where r = (select max(r) from walk))""")
def _(t: Tables):
    """The whole operator: equal titles, then those that resemble an earlier one that stays."""
    return linkage.dedup_papers(_titles(t), "doc_id").select("doc_id")


@query("e1_fuzzy_pairs", f"""
with titles as ({TITLES}), once as (select min(doc_id) as id, replace(lower(trim(title)), ' ', '') as t from titles group by 2), {_SETS}
select a, b, round(score, 6) as score from pairs where score >= 0.8""")
def _(t: Tables):
    kinds = _titles(t).groupBy(text.squashed(F.col("title")).alias("t")).agg(F.min("doc_id").alias("id")).where("length(t) >= 10").select("id", text.trigrams(F.col("t")).alias("g"))
    return linkage.similar_pairs(kinds, "id", "g", 0.8).select("a", "b", F.round("score", 6).alias("score"))


@query("e1_greedy_dedup", f"""
with recursive titles as ({TITLES}), once as (select min(doc_id) as id, replace(lower(trim(title)), ' ', '') as t from titles group by 2), {_SETS},
    near as (select b, list(a) as earlier from pairs where score >= 0.8 group by b), numbered as (select id, coalesce(earlier, []) as earlier, row_number() over (order by id) as r from s left join near on b = id where id in (select a from pairs where score >= 0.8 union select b from pairs where score >= 0.8)),
    walk(r, kept) as (select cast(0 as bigint), cast([] as bigint[]) union all
        select n.r, case when list_has_any(kept, n.earlier) then kept else list_append(kept, n.id) end from walk join numbered n on n.r = walk.r + 1)
select id as key, t as title from s where id not in (select id from numbered) or id in (select unnest(kept) from walk where r = (select max(r) from walk))""")
def _(t: Tables):
    kinds = _titles(t).groupBy(text.squashed(F.col("title")).alias("title")).agg(F.min("doc_id").alias("key")).where("length(title) >= 10")
    pairs = linkage.similar_pairs(kinds.select(F.col("key").alias("id"), text.trigrams(F.col("title")).alias("g")), "id", "g", 0.8)
    return linkage.greedy_keep(kinds, "key", pairs).select("key", "title")


@query("e3_dedup_cascade", """
with p as (select doc_id, case when doc_id % 3 = 0 then '10.1/' || (doc_id % 500) when doc_id % 3 = 1 then 'none' else null end as doi, case when doc_id % 4 = 0 then 'http://x/' || (doc_id % 600) else '' end as link,
        array_to_string(string_split(text, ' ')[1:2], ' ') as title, 2000 + doc_id % 9 as year, case when doc_id % 2 = 0 then lang else '' end as abstract, source as keywords from documents),
    f as (select *, (trim(abstract) <> '')::int + (trim(keywords) <> '')::int + (coalesce(trim(doi), '') <> '')::int as filled from p),
    a as (select *, row_number() over (partition by case when regexp_matches(doi, '^10[.]') then lower(doi) end order by filled desc, year desc, doc_id) as r1 from f),
    b as (select *, row_number() over (partition by trim(link) order by filled desc, year desc, doc_id) as r2 from a where r1 = 1 or doi is null or not regexp_matches(doi, '^10[.]')),
    c as (select *, replace(lower(trim(title)), ' ', '') as t from b where r2 = 1 or trim(link) = ''),
    d as (select *, row_number() over (partition by t, year order by filled desc, year desc, doc_id) as r3 from c)
select doc_id from d where r3 = 1 or t = ''""")
def _(t: Tables):
    n = F.col("doc_id")
    p = t.documents.select(
        "doc_id", F.when(n % 3 == 0, F.concat(F.lit("10.1/"), (n % 500).cast("string"))).when(n % 3 == 1, F.lit("none")).alias("doi"),
        F.when(n % 4 == 0, F.concat(F.lit("http://x/"), (n % 600).cast("string"))).otherwise("").alias("link"), F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("title"),
        (n % 9 + 2000).alias("year"), F.when(n % 2 == 0, F.col("lang")).otherwise("").alias("abstract"), F.col("source").alias("keywords"),
    )
    return linkage.dedup_publications(p, "doc_id").select("doc_id")


@query("e4_drop_duplicates", "select count(*) as n from (select distinct l_orderkey, l_partkey, l_suppkey from lineitem)")
def _(t: Tables):
    return t.lineitem.dropDuplicates(["l_orderkey", "l_partkey", "l_suppkey"]).agg(F.count(F.lit(1)).alias("n"))


@query("e6_entities", "select p_brand as key, arg_min(p_type, (p_size % 3) * 1000000 + p_partkey) as text, count(*) as n from part group by 1")
def _(t: Tables):
    rows = t.part.select(F.col("p_brand").alias("key"), F.col("p_type").alias("text"), F.lit("Tool").alias("label"), (F.col("p_size") % 3).alias("source"), F.col("p_partkey").alias("pos"))
    return linkage.register_entities(rows).select("key", "text", "n")


@query("e7_abbreviation_aliases", "select 'n' || p_partkey as src, regexp_replace(lower(p_type), '\\s+', ' ', 'g') as dst from part")
def _(t: Tables):
    raw = t.part.select("p_partkey", F.concat("p_type", F.lit(" (N"), F.col("p_partkey").cast("string"), F.lit(")")).alias("x"))
    return linkage.abbreviation_aliases(raw, "p_partkey", "x")


@query("e9_alias_closure", """
with recursive a as (select c_custkey as src, c_custkey // 2 as dst from customer where c_custkey > 1), r(src, dst) as (select src, dst from a union all select r.src, a.dst from r join a on a.src = r.dst)
select cast(src as varchar) as src, cast(min(dst) as varchar) as dst from r group by 1""")
def _(t: Tables):
    """Every customer is an alias of the one with half its number."""
    a = t.customer.where("c_custkey > 1").select(F.col("c_custkey").cast("string").alias("src"), F.expr("c_custkey div 2").cast("string").alias("dst"))
    return linkage.resolve_aliases(a)


@query("e10_apply_aliases", "select l_orderkey as paper_id, array_to_string(list_sort(list_distinct(list(case when l_suppkey < 5 then 's1' else 's' || l_suppkey end))), ',') as keys, count(*) filter (l_suppkey in (0, 2, 3, 4)) as merged from lineitem group by 1")
def _(t: Tables):
    refs = t.lineitem.select(F.col("l_orderkey").alias("paper_id"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("key"))
    alias = t.supplier.where("s_suppkey < 5").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.lit("s1").alias("dst"))
    return linkage.apply_aliases(refs, alias).select("paper_id", F.array_join("keys", ",").alias("keys"), "merged")


@query("e12_fill_cascade", "select c_custkey, coalesce(nullif(case when c_custkey % 2 = 0 then c_mktsegment else '' end, ''), n_name) as v, c_custkey % 2 = 1 as enriched from customer join nation on n_nationkey = c_nationkey")
def _(t: Tables):
    base = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("v"))
    one = t.customer.where("c_custkey < 0").select("c_custkey", F.lit("never").alias("v"))
    two = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", F.col("n_name").alias("v"))
    return linkage.fill_cascade(base, "c_custkey", [one, two], ["v"])


@query("e15_same_content", "select doc_id from documents where sha256(text) in (select sha256(text) from documents group by 1 having count(*) > 1)")
def _(t: Tables):
    h = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return h.join(h.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h", "left_semi").select("doc_id")


@query("j5_tiered_linkage", """
with l as (select c_custkey as lpos, lower(c_name) as lname, cast(c_custkey as varchar) as lnumber from customer), r as (select o_orderkey as rpos, case when o_orderkey % 2 = 0 then 'customer#' || lpad(cast(o_custkey as varchar), 9, '0') else '' end as rname, cast(o_custkey as varchar) as rnumber from orders)
select rpos, coalesce((select min(lpos) from l where lname = rname and rname <> ''), (select min(lpos) from l where lnumber = rnumber)) as lpos, case when (select min(lpos) from l where lname = rname and rname <> '') is not null then 'name' else 'number' end as tier from r where rnumber in (select lnumber from l)""")
def _(t: Tables):
    left = t.customer.select(F.col("c_custkey").alias("lpos"), F.lower("c_name").alias("lname"), F.col("c_custkey").cast("string").alias("lnumber"))
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).otherwise("")
    right = t.orders.select(F.col("o_orderkey").alias("rpos"), name.alias("rname"), F.col("o_custkey").cast("string").alias("rnumber"))
    return linkage.tiered_match(left, right, [("name", F.col("lname"), F.col("rname"), None), ("number", F.col("lnumber"), F.col("rnumber"), None)], "lpos", "rpos").select("rpos", "lpos", "tier")


@query("j12_ambiguity", "select c_custkey as lid, case when n = 1 then k end as right_id, case when n is null then 'unmatched' when n = 1 then 'nation' else 'nation-ambiguous' end as strategy, coalesce(case when n is not null then 99 end, 0) as score from customer left join (select s_nationkey, count(*) as n, min(s_suppkey) as k from supplier group by 1) on s_nationkey = c_nationkey")
def _(t: Tables):
    left = t.customer.select(F.col("c_custkey").alias("lid"), "c_nationkey")
    right = t.supplier.select(F.col("s_suppkey").alias("rid"), "s_nationkey")
    return linkage.matched_by_keys(left, right, [("nation", 99, F.col("c_nationkey"), F.col("s_nationkey"))])


@query("k1_upsert", "select s_suppkey, case when s_suppkey % 2 = 0 then 'new' else s_name end as s_name from supplier")
def _(t: Tables):
    s = t.supplier.select("s_suppkey", "s_name")
    new = s.where("s_suppkey % 2 = 0").select("s_suppkey", F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit("old").alias("s_name")), F.struct(F.lit(2).alias("seq"), F.lit("new").alias("s_name")))).alias("x")).select("s_suppkey", "x.s_name", "x.seq")
    return relational.upsert(s, new, ["s_suppkey"], "seq")


@query("k4_upsert_by_doi", """
select '10.1/' || p_partkey as doi, case when p_partkey % 3 = 0 then 'new ' else '' end || p_name as title, case when p_partkey % 3 = 0 then p_size else null end as year from part
union all select '10.2/' || s_suppkey, s_name, 1 from supplier""")
def _(t: Tables):
    """The older load: papers keyed on their DOI in a table of files; later rows of a load win, those without a DOI go."""
    path = f"{shared_dir(t.spark)}/papers-{uuid.uuid4().hex}"
    rows = lambda df, doi, title, year, seq: df.select(doi.alias("doi"), title.alias("title"), year.cast("int").alias("year"), F.lit(seq).alias("seq"))
    p, doi = t.part, F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))
    sinks.upsert_table(t.spark, path, rows(p, doi, F.col("p_name"), F.lit(None), 1), ["doi"], "seq")
    again = rows(p.where("p_partkey % 3 = 0"), doi, F.lit("overridden"), F.col("p_size"), 1).unionByName(rows(p.where("p_partkey % 3 = 0"), doi, F.concat(F.lit("new "), "p_name"), F.col("p_size"), 2))
    fresh = rows(t.supplier, F.concat(F.lit("10.2/"), F.col("s_suppkey").cast("string")), F.col("s_name"), F.lit(1), 1)
    lost = rows(t.supplier, F.lit(None).cast("string"), F.col("s_name"), F.lit(1), 1)
    sinks.upsert_table(t.spark, path, again.unionByName(fresh).unionByName(lost), ["doi"], "seq")
    return t.spark.read.parquet(path)


@query("k2_paper_rows", "select md5('title:' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '_year:' || (1990 + p_size)) as paper_id, p_name as title, 1990 + p_size as year from part")
def _(t: Tables):
    p = t.part.select(F.col("p_name").alias("Title"), F.concat((F.col("p_size") + 1990).cast("string"), F.lit(".0")).alias("Year"))
    return sinks.paper_rows(p).select("paper_id", "title", "year")


@query("k3_junction", "select distinct l_orderkey as paper_id, s_name as nip from lineitem join supplier on s_suppkey = l_suppkey")
def _(t: Tables):
    ids = t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.collect_list("l_suppkey"), "; ").alias("author_ids")).withColumnRenamed("l_orderkey", "paper_id")
    who = t.supplier.select(F.col("s_name").alias("nip"), F.lit("").alias("scopus_id"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".0")).alias("scholar_id"))
    return sinks.paper_links(ids, who)


@query("k5_pending", "select doc_id as paper_id from documents left join labels using (doc_id) where quality is null order by doc_id limit 50")
def _(t: Tables):
    from foliospark.sources.readers import pending

    p = t.documents.join(t.labels, "doc_id", "left").select(F.col("doc_id").alias("paper_id"), F.col("quality").cast("string").alias("tldr"), F.lit("10.1/x").alias("doi"))
    return pending(p, 50).select("paper_id")


@query("k12_truncated_fields", "select doc_id, left(text, 500) as text from documents")
def _(t: Tables):
    return sinks.vector_rows(t.documents.select("doc_id", "text"), {"text": 500})


@query("k13_replace_chunks", "select cast(doc_id as varchar) as file_id, case when doc_id % 10 = 0 then 'new' else source end as content from documents")
def _(t: Tables):
    old = t.documents.select(F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("content"))
    new = t.documents.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("file_id"), F.lit("new").alias("content"))
    return sinks.replace_chunks(old, new)


@query("k15_json_rows", "select doc_id, case when doc_id % 5 = 0 then null else source end as source, n_chars from documents")
def _(t: Tables):
    path = f"{shared_dir(t.spark)}/rows-{uuid.uuid4().hex}"
    rows = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), "n_chars")
    sinks.write_json_rows(rows, path)
    return readers.json_lines(t.spark, path, "doc_id long, source string, n_chars long")


@query("s1_csv_text", "select cast(p_partkey as varchar) as p_partkey, p_name, case when p_partkey % 7 = 0 then '' else p_brand || ', \"' || p_type || '\"' end as note from part")
def _(t: Tables):
    """Out by the quoting sink and in again: every value is text, nulls are empty, quotes and commas survive."""
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    note = F.when(F.col("p_partkey") % 7 != 0, F.concat("p_brand", F.lit(', "'), "p_type", F.lit('"')))
    t.part.select("p_partkey", "p_name", note.alias("note")).write.option("escape", '"').csv(path, header=True)
    return readers.csv_text(t.spark, path)


@query("s5_missing_source", "select cast(s_suppkey as varchar) as s_suppkey, s_name from supplier")
def _(t: Tables):
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    t.supplier.select("s_suppkey", "s_name").write.csv(path, header=True)
    names = ["s_suppkey", "s_name"]
    return readers.csv_or_empty(t.spark, path, names).unionByName(readers.csv_or_empty(t.spark, f"{path}-missing", names))


@query("s7_json_lines", "select c_custkey, c_name from customer where c_custkey % 5 not in (1, 2)")
def _(t: Tables):
    """Broken lines and those without the required field go."""
    path = f"{shared_dir(t.spark)}/json-{uuid.uuid4().hex}"
    line = F.to_json(F.struct("c_custkey", F.when(F.col("c_custkey") % 5 != 1, F.col("c_name")).alias("c_name")))
    t.customer.select(F.when(F.col("c_custkey") % 5 == 2, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    return readers.json_lines(t.spark, path, "c_custkey long, c_name string", "c_name")


@query("k18_soft_delete", "select c_custkey, case when c_acctbal < 0 then 1 else 0 end as is_deleted from customer")
def _(t: Tables):
    return sinks.soft_delete(t.customer.withColumn("is_deleted", F.lit(0)), F.col("c_acctbal") < 0).select("c_custkey", "is_deleted")


#: Customers as the staff of their nations: two by two they are one person, whose name is a letter longer where the id is odd.
_STAFF = "select cast(c_nationkey as varchar) as unit, c_custkey as pos, substr(md5(cast(c_custkey // 2 as varchar)), 1, 20) || case when c_custkey % 2 = 1 then 'x' else '' end as name from customer"


def _staff(t: Tables):
    name = F.substring(F.md5(F.expr("c_custkey div 2").cast("string")), 1, 20)
    name = F.when(F.col("c_custkey") % 2 == 1, F.concat(name, F.lit("x"))).otherwise(name)
    return t.customer.select(F.col("c_nationkey").cast("string").alias("unit"), F.col("c_custkey").alias("pos"), name.alias("name"), F.lit("").alias("scholar_id"), F.lit("").alias("number"))


@query("e5_merge_people", f"select unit, min(pos) as pos, arg_max(name, length(name)) as name from ({_STAFF}) group by unit, substr(name, 1, 20)")
def _(t: Tables):
    """Two of a person in one nation become one, under the longer name and in the place of the first."""
    return linkage.merge_people(_staff(t)).select("unit", "pos", "name")


@query("e5_merge_by_number", """
select cast(o_orderpriority as varchar) as unit, min(o_orderkey) as pos, 's' || o_custkey as scholar_id, cast(o_custkey as varchar) as number from orders group by o_orderpriority, o_custkey""")
def _(t: Tables):
    """Orders without names: within a priority those of one customer are one person, who keeps the place of the first."""
    p = t.orders.select(F.col("o_orderpriority").alias("unit"), F.col("o_orderkey").alias("pos"), F.lit("").alias("name"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("scholar_id"), F.col("o_custkey").cast("string").alias("number"))
    return linkage.merge_people(p).drop("name")


@query("j5_fuzzy_names", f"""
with s as ({_STAFF}) select r.pos as rpos, case when r.pos % 3 = 0 then r.pos else l.pos end as lpos, case when r.pos % 3 = 0 then 1.0 else round(40.0 / 41, 6) end as score, case when r.pos % 3 = 0 then 'name' else 'fuzzy' end as tier
from s r left join s l on l.pos = r.pos - 1 where r.pos % 2 = 1""")
def _(t: Tables):
    """Every other person against the rest, whose names lack a letter; of every third one the whole name is known."""
    staff = _staff(t)
    left = staff.where("pos % 2 = 0 or pos % 3 = 0")
    found = linkage.link_people(left, staff.where("pos % 2 = 1"))
    return found.select("rpos", "lpos", F.round("score", 6).alias("score"), "tier")


_GROUPS = """
with recursive g as (select l_orderkey as g, 'p' || min(l_partkey) as c, 'p' || max(l_partkey) as m from lineitem where l_quantity > 40 and l_discount > 0.07 group by 1 having min(l_partkey) < max(l_partkey)),
ent as (select 'p' || p_partkey as k, case when p_size <= 25 then 'small' else 'large' end as label, n from part left join (select l_partkey, count(*) as n from lineitem group by 1) on l_partkey = p_partkey),
good as (select g.c, g.m from g join ent x on x.k = c join ent y on y.k = m where x.label = y.label),
e as (select c as a, m as b from good union select m, c from good),
reach as (select a as node, a as other from e union select node, b from reach join e on a = other),
roots as (select node, min(other) as root from reach group by 1),
heads as (select distinct c as node from good),
best as (select root, node as dst from roots join heads using (node) join ent on k = node qualify row_number() over (partition by root order by coalesce(n, 0) desc, node) = 1)
select node as src, dst from roots join best using (root) where node <> dst"""


@query("e8_synonym_groups", _GROUPS)
def _(t: Tables):
    """Parts of an order that are dear in the same way are synonyms; small and large ones clash."""
    p = lambda c: F.concat(F.lit("P"), c.cast("string"))
    g = t.lineitem.where("l_quantity > 40 and l_discount > 0.07").groupBy(F.col("l_orderkey").alias("group_id")).agg(F.min("l_partkey").alias("a"), F.max("l_partkey").alias("b")).where("a < b")
    n = t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    entities = t.part.join(n, F.col("l_partkey") == F.col("p_partkey"), "left").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("key"), F.when(F.col("p_size") <= 25, "small").otherwise("large").alias("label"), "n")
    return linkage.synonym_aliases(g.select("group_id", p(F.col("a")).alias("canonical"), p(F.col("b")).alias("member")), entities)


@query("s3_csv_behind_preamble", "select cast(s_suppkey as varchar) as \"Key\", 'say \"' || s_name || '\"' || chr(10) || 'of, ' || s_nationkey as \"Name\", case when s_suppkey % 3 = 0 then '' else cast(s_nationkey as varchar) end as \"Nation\" from supplier")
def _(t: Tables):
    """Three files with a preamble each, one of them without a column, and names of two lines."""
    folder = f"{shared_dir(t.spark)}/preamble-{uuid.uuid4().hex}"
    name = F.concat(F.lit('"say ""'), "s_name", F.lit('""\n'), F.lit("of, "), F.col("s_nationkey").cast("string"), F.lit('"'))
    for k in range(3):
        of = t.supplier.where(F.col("s_suppkey") % 3 == k)
        fields = ["s_suppkey", name] + (["s_nationkey"] if k else [])
        top = t.spark.createDataFrame([(-2, 'Exported by "someone'), (-1, "Key,Name" + (",Nation" if k else ""))], "o long, value string")
        lines = top.unionByName(of.select(F.col("s_suppkey").alias("o"), F.concat_ws(",", *[F.col(c).cast("string") if isinstance(c, str) else c for c in fields]).alias("value")))
        lines.coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{folder}/{k}")
    return readers.csv_behind_preamble(t.spark, f"{folder}/*/part-*", "Key")
