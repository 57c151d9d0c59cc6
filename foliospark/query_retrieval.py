"""Queries on retrieval, metrics and chunking."""

import io
import zipfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.operators import chunking, evaluation, retrieval
from foliospark.queries import Tables, query
from foliospark.sources import office


def _queries(t: Tables):
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


_HITS = "select q.vec_id as qid, e.vec_id as chunk_id, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as s from embeddings e, embeddings q where q.vec_id % 50 = 0"


@query("v2_dense_search", f"select qid, chunk_id, round(s, 6) as score from (select *, row_number() over (partition by qid order by s desc, chunk_id) as r from ({_HITS})) where r <= 10 and s >= 0.2")
def _(t: Tables):
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    return retrieval.dense(chunks, _queries(t), 10, threshold=0.2).select("qid", "chunk_id", F.round("score", 6).alias("score"))


_BM25 = """
with d as (select conv_id * 100 + turn as chunk_id, list_transform(regexp_extract_all(lower(text), '([a-z0-9_]+|[^\\x00-\\x7F]+)'), lambda x: x) as ts from conversations), st as (select count(*) as n, avg(len(ts)) as a from d),
q as (select * from (values (1, 'the'), (1, 'than'), (2, 'der'), (2, 'und'), (2, 'nicht')) v(qid, t)),
p as (select chunk_id, len(ts) as len, t, count(*) as tf from (select chunk_id, ts, unnest(ts) as t from d) where t in (select t from q) group by all),
df as (select t, count(*) as df from p group by 1),
s as (select qid, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) as score from p join df using (t) join q using (t), st group by 1, 2)
select qid, chunk_id, round(score, 5) as score from (select *, row_number() over (partition by qid order by round(score, 9) desc, chunk_id) as r from s) where r <= 10"""


def _chunks(t: Tables):
    return t.conversations.select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.col("text").alias("content"))


@query("v3_bm25", _BM25)
def _(t: Tables):
    q = t.spark.createDataFrame([(1, "the than"), (2, "der und nicht")], "qid int, query string")
    return retrieval.bm25(_chunks(t), q, 10).select("qid", "chunk_id", F.round("score", 5).alias("score"))


@query("v1_hybrid")
def _(t: Tables):
    text = t.documents.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "source")
    chunks = text.join(t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding"), "chunk_id")
    q = _queries(t).withColumn("query", F.lit("the than of"))
    return retrieval.retrieve(chunks, q, retrieval.Options(search_mode="hybrid")).withColumn("score", F.round("score", 6))


@query("v4_fusion", f"""
with h as ({_HITS}), a as (select * from (select *, row_number() over (partition by qid order by s desc, chunk_id) as r from h) where r <= 20), b as (select * from (select *, row_number() over (partition by qid order by s, chunk_id) as r from h) where r <= 20),
na as (select qid, chunk_id, (s - min(s) over (partition by qid)) / (max(s) over (partition by qid) - min(s) over (partition by qid)) as u from a), nb as (select qid, chunk_id, (s - min(s) over (partition by qid)) / (max(s) over (partition by qid) - min(s) over (partition by qid)) as u from b)
select qid, chunk_id, round(0.7 * coalesce(na.u, 0) + 0.3 * coalesce(nb.u, 0), 5) as score from na full join nb using (qid, chunk_id)""")
def _(t: Tables):
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    a, b = retrieval.nearest(chunks, _queries(t), 20), retrieval.nearest(chunks, _queries(t), 20, farthest=True)
    return retrieval.fuse(a, b, 0.7, 0.3).select("qid", "chunk_id", F.round("score", 5).alias("score"))


@query("v5_rerank", f"select qid, chunk_id, round(1 / (1 + exp(-(chunk_id % 7))), 6) as score from (select *, row_number() over (partition by qid order by s desc, chunk_id) as r from ({_HITS})) where r <= 10")
def _(t: Tables):
    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    o = retrieval.Options(similarity_threshold=-1, recall_top_k=10)
    return retrieval.retrieve(chunks, _queries(t), o, rerank=lambda d: d.withColumn("rerank_score", (F.col("chunk_id") % 7).cast("double"))).withColumn("score", F.round("score", 6))


@query("v6_file_chunks", "select conv_id, turn, text from conversations where conv_id = 3 order by turn limit 10000")
def _(t: Tables):
    return t.conversations.where("conv_id = 3").orderBy("turn").limit(10_000).select("conv_id", "turn", "text")


@query("v7_first_seen", "select p_partkey as key, cast(arg_min(s, k * 1000 - s) as double) as score from (select p_partkey, 1 as k, p_size as s from part where p_size > 40 union all select p_partkey, 2, p_size * 2 from part where p_size > 20) group by 1 order by 2 desc, 1 limit 20")
def _(t: Tables):
    one = lambda k, least, f: t.part.where(F.col("p_size") > least).select(F.lit(k).alias("kw_pos"), F.col("p_partkey").alias("key"), (F.col("p_size") * f).cast("double").alias("score"))
    return retrieval.first_seen(one(1, 40, 1).unionByName(one(2, 20, 2)), "key", 20)


@query("v8_relationships", """
with h as (select (ascii(l_returnflag) * 7 + l_linenumber) % 5 as kw, l_suppkey as src, l_linestatus as rel, l_partkey as dst, max(l_extendedprice) as score from lineitem group by 1, 2, 3, 4),
b as (select * from h where kw < 3 qualify row_number() over (partition by kw order by score desc, src, rel, dst) <= 5)
select src, rel, dst, arg_min(score, kw) as score from b group by 1, 2, 3""")
def _(t: Tables):
    kw = (F.ascii("l_returnflag") * 7 + F.col("l_linenumber")) % 5
    hits = t.lineitem.groupBy(kw.alias("kw_pos"), F.col("l_suppkey").alias("src"), F.col("l_linestatus").alias("rel"), F.col("l_partkey").alias("dst")).agg(F.max("l_extendedprice").alias("score"))
    return retrieval.relationship_search(hits)


@query("v9_chunk_prefix", "select doc_id, left(text, 500) as text from documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.substring("text", 1, 500).alias("text"))


@query("v10_context", """
select 'Entities' || (select string_agg(chr(10) || r_name, '' order by r_regionkey) from region) || chr(10) || chr(10) || 'Relations' || (select string_agg(chr(10) || n_name || ' - ' || n_regionkey, '' order by n_nationkey) from nation)
  || chr(10) || chr(10) || 'Chunks' || (select string_agg(chr(10) || left(text, 500), '' order by item_id) from benchmark) as context""")
def _(t: Tables):
    e = t.region.select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("line"))
    r = t.nation.select(F.col("n_nationkey").alias("pos"), F.concat_ws(" - ", "n_name", "n_regionkey").alias("line"))
    return retrieval.context(e, r, t.benchmark.select(F.col("item_id").alias("pos"), F.col("text").alias("line")))


def _results(t: Tables):
    rows = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("found"), F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey")))).alias("relevant"))
    return rows.withColumnRenamed("l_orderkey", "qid")


_METRICS = """
with x as (select l_orderkey as qid, list_sort(list_distinct(list(l_suppkey))) as f, coalesce(list_distinct(list(l_suppkey) filter (l_returnflag = 'R')), []) as r from lineitem group by 1),
m as (select qid, k, len(list_intersect(f[1:k], r)) / k as p, len(list_intersect(f[1:k], r)) / len(r) as c from x, (values (1), (3), (5), (10)) v(k) where len(r) > 0)"""


@query("q1_metrics_at_k", f"{_METRICS} select qid, k, round(p, 6) as precision, round(c, 6) as recall, round(case when p + c > 0 then 2 * p * c / (p + c) else 0 end, 6) as f1 from m")
def _(t: Tables):
    return evaluation.at_ks(_results(t)).select("qid", "k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("q3_mean_metrics", f"{_METRICS} select k, round(avg(p), 6) as precision, round(avg(c), 6) as recall, round(avg(case when p + c > 0 then 2 * p * c / (p + c) else 0 end), 6) as f1 from m group by 1")
def _(t: Tables):
    return evaluation.means(evaluation.at_ks(_results(t))).select("k", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("a17_overall_score", "select round(avg(v), 6) as overall_score from (select (l_discount + l_tax) / 2 as v from lineitem union all select l_quantity / 50 from lineitem)")
def _(t: Tables):
    m = F.create_map(F.lit("recall@1"), F.col("l_discount"), F.lit("f1@1"), F.col("l_tax"))
    return evaluation.overall(t.lineitem.select(m.alias("metrics"), (F.col("l_quantity") / 50).alias("answer"))).select(F.round("overall_score", 6).alias("overall_score"))


@query("p15_low_quality", "select l_orderkey, l_linenumber from lineitem where l_quantity / 50 <= 0.5 or l_discount < 0.03")
def _(t: Tables):
    m = F.create_map(F.lit("recall@1"), F.col("l_discount") * 10, F.lit("f1@1"), F.lit(0.0))
    return t.lineitem.where(evaluation.low_quality(F.col("l_quantity") / 50, m)).select("l_orderkey", "l_linenumber")


@query("q5_pass_marks", "select p_brand as metric, round(avg(p_size) / 50, 6) as value, 0.5 as target, avg(p_size) / 50 >= 0.5 as passed from part group by 1")
def _(t: Tables):
    v = t.part.groupBy(F.col("p_brand").alias("metric")).agg((F.avg("p_size") / 50).alias("value"))
    return evaluation.pass_marks(v, {f"Brand#{k}": 0.5 for k in range(100)}).select("metric", F.round("value", 6).alias("value"), F.col("target").cast("decimal(2,1)").alias("target"), "passed")


@query("q6_rouge1", "select p_partkey, round(2.0 * (select count(*) from (select unnest(list_distinct(string_split(lower(p_type), ' '))) as w) where list_contains(string_split(lower(p_type), ' '), w)) / (2 * len(string_split(p_type, ' '))), 6) as v from part where len(list_distinct(string_split(lower(p_type), ' '))) = len(string_split(p_type, ' '))")
def _(t: Tables):
    words = F.split(F.lower("p_type"), " ")
    same = F.array_join(F.reverse(words), " ")
    return t.part.where(F.size(F.array_distinct(words)) == F.size(words)).select("p_partkey", F.round(evaluation.rouge1(F.col("p_type"), same), 6).alias("v"))


@query("c1_general_chunks")
def _(t: Tables):
    return chunking.chunk(t.documents, "doc_id", "text", chunking.resolve("general", {"chunk_token_num": 128}))


@query("c2_hard_delimiters", r"select cast(doc_id as varchar) as file_id, count(*) as n from (select doc_id, unnest(string_split(text, '. ')) as c from documents) where trim(regexp_replace(c, '\s+', ' ', 'g')) <> '' group by 1")
def _(t: Tables):
    c = chunking.chunk(t.documents, "doc_id", "text", chunking.resolve("general", {"delimiter": "`. `"}))
    return c.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


_BOOK = """
with o as (select o_orderkey, '# Order ' || o_orderkey as top from orders),
l as (select l_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as k, l_partkey as p, l_suppkey as s from lineitem)"""


@query("c3_book_outline", f"""{_BOOK}, x as (
  select o_orderkey, cast(0 as bigint) as k, 0 as b, top || chr(10) || 'customer order of ' || o_orderkey as content from o
  union all select l_orderkey, k, b, top || chr(10) || '## Line ' || k || chr(10) || case b when 0 then 'part ' || p else 'made by ' || s end
  from l join o on l_orderkey = o_orderkey, (values (0), (1)) v(b))
select cast(o_orderkey as varchar) as file_id, cast(row_number() over (partition by o_orderkey order by k, b) - 1 as int) as chunk_index, content from x""")
def _(t: Tables):
    """A book for each order: a heading for it, one for each line, and text under both."""
    order = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    said = F.format_string("## Line %d\npart %d\nmade by %d", F.col("k"), F.col("l_partkey"), F.col("l_suppkey"))
    parts = t.lineitem.withColumn("k", order).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("said")))), lambda x: x["said"]), "\n").alias("lines"))
    books = t.orders.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.concat_ws("\n", F.format_string("# Order %d\ncustomer order of %d", F.col("o_orderkey"), F.col("o_orderkey")), "lines").alias("text"))
    return chunking.chunk(books, "o_orderkey", "text", chunking.resolve("book")).select("file_id", "chunk_index", "content")


@query("c3_book_chunks")
def _(t: Tables):
    return chunking.chunk(t.documents, "doc_id", "text", chunking.resolve("book", {"chunk_token_num": 256}))


@query("c4_law_articles", """
with s as (select s_suppkey, s_nationkey, row_number() over (partition by s_nationkey order by s_suppkey) as k from supplier)
select cast(n_nationkey as varchar) as file_id, cast(row_number() over (partition by n_nationkey order by k) - 1 as int) as chunk_index,
       'Chapter ' || n_nationkey || ' of suppliers' || chr(10) || case when k is null then 'all of them' else 'all of them' || chr(10) || 'Article ' || k || chr(10) || 'supplier ' || s_suppkey || chr(10) || '(1) delivers' || chr(10) || 'and is paid' end as content
from nation left join s on s_nationkey = n_nationkey""")
def _(t: Tables):
    """A law for each nation: a chapter with one sentence, and an article for each supplier with a clause."""
    k = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    said = F.format_string("- **Article %d** supplier %d\n(1) delivers\nand is paid", F.col("k"), F.col("s_suppkey"))
    parts = t.supplier.withColumn("k", k).groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", said.alias("said")))), lambda x: x["said"]), "\n").alias("lines"))
    laws = t.nation.join(parts, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", F.concat_ws("\n", F.format_string("## Chapter %d of suppliers\nall of them", F.col("n_nationkey")), "lines").alias("text"))
    return chunking.chunk(laws, "n_nationkey", "text", chunking.resolve("laws")).select("file_id", "chunk_index", "content")


def _word_file(title: str, heads: list[str], rows: list[str]) -> bytes:
    """A Word file: a title, a heading of the second level for each head, and a table of the rows."""
    out = io.BytesIO()
    paragraph = lambda style, said: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{said}</w:t></w:r></w:p>'
    cells = "".join(f"<w:tr><w:tc>{paragraph('', r)}</w:tc></w:tr>" for r in rows)
    body = paragraph("Heading1", title) + "".join(paragraph("Heading2", x) + paragraph("", f"{x} delivers") for x in heads) + f"<w:tbl>{cells}</w:tbl>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def _word_files(t: Tables):
    """A Word file for each nation that has suppliers and customers: its suppliers as headings, its customers as a table."""
    s = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.array_sort(F.collect_list("s_name")).alias("heads"))
    c = t.customer.groupBy(F.col("c_nationkey").alias("k")).agg(F.array_sort(F.collect_list("c_name")).alias("rows"))
    told = t.nation.select(F.col("n_nationkey").alias("k"), "n_name").join(s, "k").join(c, "k")
    made = F.udf(_word_file, "binary")("n_name", "heads", "rows")
    return told.select(F.concat("n_name", F.lit(".docx")).alias("path"), made.alias("content"))


_FILES = """
with s as (select s_nationkey as k, string_agg('## ' || s_name || chr(10) || chr(10) || s_name || ' delivers', chr(10) || chr(10) order by s_name) as heads from supplier group by 1),
c as (select c_nationkey as k, string_agg('| ' || c_name || ' |' || case when r = 1 then chr(10) || '| --- |' else '' end, chr(10) order by c_name) as rows
      from (select *, row_number() over (partition by c_nationkey order by c_name) as r from customer) group by 1)"""


@query("s24_documents", f"{_FILES} select n_name || '.docx' as path, 'docx' as form, '# ' || n_name || chr(10) || chr(10) || heads || chr(10) || chr(10) || rows as markdown, cast(null as varchar) as error from nation join s on s.k = n_nationkey join c on c.k = n_nationkey")
def _(t: Tables):
    return office.markdown(_word_files(t))


@query("c4_document_tree", f"""{_FILES}, h as (select s_nationkey as k, s_name, row_number() over (partition by s_nationkey order by s_name) as r, count(*) over (partition by s_nationkey) as n from supplier)
select n_name || '.docx' as file_id, cast(r - 1 as int) as chunk_index, n_name || chr(10) || s_name || chr(10) || s_name || ' delivers' || case when r = n then chr(10) || rows else '' end as content
from nation join h on h.k = n_nationkey join c on c.k = n_nationkey""")
def _(t: Tables):
    """The files' sections by their heading tree; the table belongs to the last one."""
    files = office.markdown(_word_files(t))
    return chunking.chunk(files, "path", "markdown", chunking.resolve("laws", {"chunk_token_num": 1_000_000}) | {"tree": "docx"}).select("file_id", "chunk_index", "content")


@query("c4_law_chunks")
def _(t: Tables):
    return chunking.chunk(t.documents, "doc_id", "text", chunking.resolve("laws", {"chunk_token_num": 180}))


_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query("c5_qa_chunks", f"""
with g as (select conv_id, turn, role, replace(text, chr(10), ' ') as x, sum(case when role = 'user' then 1 else 0 end) over (partition by conv_id order by turn) as k from conversations),
p as (select conv_id, min(turn) as t0, {_TRIM.format("string_agg(x, chr(10) order by turn) filter (role = 'user')")} as q, {_TRIM.format("string_agg(x, chr(10) order by turn) filter (role <> 'user')")} as a from g where k > 0 group by conv_id, k),
d1 as (select conv_id, q, a, t0 from p where q <> '' and a <> ''),
l as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as n, case when role = 'user' then 'Q: ' else 'A: ' end || x as line from g where conv_id not in (select conv_id from d1)),
c as (select *, sum(case when len(string_split(line, ',')) = 2 then 1 else 0 end) over (partition by conv_id order by n) as k from l),
c2 as (select conv_id, min(n) as t0, split_part(arg_min(line, n), ',', 1) as q, split_part(arg_min(line, n), ',', 2) || coalesce(chr(10) || string_agg(line, chr(10) order by n) filter (len(string_split(line, ',')) <> 2), '') as a from c where k > 0 group by conv_id, k),
d2 as (select conv_id, trim(q) as q, trim(a) as a, t0 from c2 where trim(q) <> '' and trim(a) <> ''),
d3 as (select conv_id, min(line) filter (n % 2 = 0) as q, min(line) filter (n % 2 = 1) as a, min(n) as t0 from l where conv_id not in (select conv_id from d2) group by conv_id, n // 2),
d as (select conv_id, q, a, min(t0) as t0 from (select * from d1 union all select * from d2 union all select * from d3 where a is not null) group by 1, 2, 3)
select cast(conv_id as varchar) as file_id, cast(row_number() over (partition by conv_id order by t0) - 1 as int) as chunk_index, 'Question: ' || regexp_replace(q, '(?i)^(question|答案|answer|user|assistant|q|a|问|答)[\\t:： ]+', '') || chr(9) || 'Answer: ' || regexp_replace(a, '(?i)^(question|答案|answer|user|assistant|q|a|问|答)[\\t:： ]+', '') as content from d""")
def _(t: Tables):
    turns = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.regexp_replace("text", "\n", " ").alias("text")))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat(F.when(e.role == "user", "Q: ").otherwise("A: "), e["text"])), "\n")
    return chunking.chunk(turns.select("conv_id", text.alias("text")), "conv_id", "text", chunking.resolve("qa")).select("file_id", "chunk_index", "content")


@query("c8_character_windows", "select doc_id as file_id, cast(k as int) as chunk_index, substr(text, k * 800 + 1, 1000) as content from (select doc_id, text, unnest(range(0, greatest(1, cast(ceil((length(text) - 200) / 800.0) as bigint)))) as k from documents where length(text) > 0)")
def _(t: Tables):
    return chunking.split_characters(t.documents, "doc_id", "text")


@query("v13_exact_neighbours", "select q.vec_id as qid, e.vec_id as chunk_id from embeddings e, embeddings q where q.vec_id % 50 = 0 and e.vec_id <> q.vec_id qualify row_number() over (partition by q.vec_id order by list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) desc, e.vec_id) <= 5")
def _(t: Tables):
    from foliospark.operators.relational import top_per_group

    chunks = t.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")
    hits = retrieval.dense(chunks, _queries(t), 6).where("qid <> chunk_id")
    return top_per_group(hits, ["qid"], [F.desc("score"), F.col("chunk_id")], 5).select("qid", "chunk_id")
