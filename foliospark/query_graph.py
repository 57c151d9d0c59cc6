"""Queries on the graph of lecturers, papers, keywords, journals and years."""

from pyspark.sql import functions as F

from foliospark.operators import ann, community, graph
from foliospark.queries import Tables, query
from foliospark.tables import Table

_WRITES = "select distinct l_suppkey as a, l_orderkey as p from lineitem"


def writes(t: Tables):
    return t.lineitem.select(F.col("l_suppkey").alias("a"), F.col("l_orderkey").alias("p")).distinct()


def edges(t: Tables):
    """Author a -> paper o, paper -> priority."""
    w = t.lineitem.select(F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("src"), F.lit("WRITES").alias("rel"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("dst")).distinct()
    return w.unionByName(t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("src"), F.lit("PUBLISHED_IN").alias("rel"), F.concat(F.lit("j"), F.substring("o_orderpriority", 1, 1)).alias("dst")))


_EDGES = "(select distinct 'a' || l_suppkey as src, 'WRITES' as rel, 'o' || l_orderkey as dst from lineitem union all select 'o' || o_orderkey, 'PUBLISHED_IN', 'j' || left(o_orderpriority, 1) from orders)"


@query("j24_coauthorship", f"with w as ({_WRITES}) select x.a, y.a as b, count(*) as n from w x join w y on x.p = y.p and x.a < y.a group by 1, 2")
def _(t: Tables):
    return graph.coauthors(t.lineitem, "l_orderkey", "l_suppkey")


@query("j25_shared_paper_pairs", "select o_orderpriority as journal, o_orderstatus as status, count(distinct l_orderkey) as papers from lineitem join orders on o_orderkey = l_orderkey group by 1, 2")
def _(t: Tables):
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderpriority").alias("journal"), F.col("o_orderstatus").alias("status")).agg(F.count_distinct("l_orderkey").alias("papers"))


@query("j26_path_join", "select n_name, p_brand, count(distinct l_orderkey) as papers from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey join part on p_partkey = l_partkey group by 1, 2")
def _(t: Tables):
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")
    p = t.part.select("p_partkey", "p_brand")
    return t.lineitem.join(s, F.col("s_suppkey") == F.col("l_suppkey")).join(p, F.col("p_partkey") == F.col("l_partkey")).groupBy("n_name", "p_brand").agg(F.count_distinct("l_orderkey").alias("papers"))


@query("j27_expert_finder", "with w as (select distinct l_suppkey as a, l_partkey as k from lineitem) select x.a, y.a as b, count(*) as problems from w x join w y on x.k = y.k and x.a < y.a group by 1, 2")
def _(t: Tables):
    return graph.coauthors(t.lineitem, "l_partkey", "l_suppkey").withColumnRenamed("n", "problems")


@query("j28_optional_match", "select s_suppkey, count(distinct l_orderkey) as returned from supplier left join lineitem on l_suppkey = s_suppkey and l_returnflag = 'R' and l_quantity > 45 group by 1")
def _(t: Tables):
    hit = t.lineitem.where("l_returnflag = 'R' and l_quantity > 45")
    return t.supplier.join(hit, F.col("l_suppkey") == F.col("s_suppkey"), "left").groupBy("s_suppkey").agg(F.count_distinct("l_orderkey").alias("returned"))


@query("j29_edges_among_sample", f"with n as (select s_suppkey from supplier order by s_suppkey limit 10), w as ({_WRITES}) select x.a, y.a as b, count(*) as n from w x join w y on x.p = y.p and x.a < y.a where x.a in (select * from n) and y.a in (select * from n) group by 1, 2")
def _(t: Tables):
    n = t.supplier.orderBy("s_suppkey").limit(10).select(F.col("s_suppkey").alias("a"))
    return graph.coauthors(writes(t).join(n, "a", "left_semi"), "p", "a")


@query("a9_graph_counts", f"with e as {_EDGES} select 'label' as kind, 'Dosen' as name, count(*) as n from supplier union all select 'label', 'Paper', count(*) from orders union all select 'rel', rel, count(*) from e group by rel union all select 'nodes', '', (select count(*) from supplier) + (select count(*) from orders) union all select 'edges', '', count(*) from e union all select 'edges_undirected', '', 2 * count(*) from e")
def _(t: Tables):
    nodes = t.supplier.select(F.lit("Dosen").alias("label")).unionByName(t.orders.select(F.lit("Paper").alias("label")))
    return graph.counts(nodes, edges(t))


@query("a21_degrees", f"with e as {_EDGES} select node, count(*) as degree from (select src as node from e union all select dst from e) group by 1")
def _(t: Tables):
    return graph.degrees(edges(t))


@query("k7_merge_nodes", "select 'Paper' as label, 'o' || o_custkey as node_id, count(*) > 0 as known, cast(arg_max(o_orderkey, o_orderkey) as varchar) as last from orders group by 2")
def _(t: Tables):
    props = F.create_map(F.lit("last"), F.col("o_orderkey").cast("string"), F.lit("empty"), F.lit("nan"))
    n = t.orders.select(F.lit("Paper").alias("label"), F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("node_id"), props.alias("props"), F.col("o_orderkey").alias("pos"))
    return graph.merge_nodes(n, "pos").select("label", "node_id", (F.size("props") == 1).alias("known"), F.element_at("props", "last").alias("last"))


@query("k8_merge_edges", "select count(*) as total, count(*) filter (l_suppkey % 2 = 0) as kept, count(*) filter (l_suppkey % 2 = 1) as skipped from (select distinct l_suppkey, l_orderkey from lineitem)")
def _(t: Tables):
    e = edges(t).where("rel = 'WRITES'").withColumn("pos", F.lit(1))
    nodes = t.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("node_id")).unionByName(t.orders.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node_id")))
    return graph.merge_edges(e, nodes, "pos")[1]


@query("k9_unique_ids", "select 'x' as label, cast(s_nationkey as varchar) as node_id, count(*) as n from supplier group by 2 having count(*) > 1")
def _(t: Tables):
    return graph.duplicate_keys(t.supplier.select(F.lit("x").alias("label"), F.col("s_nationkey").cast("string").alias("node_id")))


@query("k10_merge_triples", "select name, max(v) as v from (select 'u' || user_id as name, event_id as v from events union all select event_type, -1 from events) group by 1")
def _(t: Tables):
    line = F.to_json(F.struct(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.col("event_id").cast("string").alias("v")).alias("h"), F.lit("DID").alias("r"), F.col("event_type").alias("t")))
    nodes, _rels = graph.merge_triples(graph.parse_triples(t.events.select(F.col("event_id").alias("pos"), line.alias("value"))))
    return nodes.select("name", F.coalesce(F.element_at("props", "v").cast("long"), F.lit(-1)).alias("v"))


@query("k11_delete_entity", f"with e as {_EDGES} select count(*) as n from e where src <> 'a1' and dst <> 'a1'")
def _(t: Tables):
    nodes = t.supplier.select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("name"))
    return graph.delete_entity(nodes, edges(t), t.spark.createDataFrame([("a1",)], "name string"))[1].agg(F.count(F.lit(1)).alias("n"))


@query("h1_backbone", "select 'Dosen' as label, count(*) as n from supplier union all select 'Paper', count(*) from orders union all select 'ProgramStudi', count(distinct n_name) from supplier join nation on n_nationkey = s_nationkey union all select 'Year', count(distinct year(o_orderdate)) from orders union all select 'Journal', count(distinct o_orderpriority) from orders union all select 'Keyword', count(*) from (select distinct w from (select unnest(string_split(lower(p_type), ' ')) as w from part join lineitem on l_partkey = p_partkey) where length(w) > 2)")
def _(t: Tables):
    papers, people = _records(t)
    nodes, _e = graph.backbone(papers, people)
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("h2_author_edges", "select count(*) as n from (select distinct l_orderkey, l_suppkey from lineitem)")
def _(t: Tables):
    papers, people = _records(t)
    return graph.backbone(papers, people)[1].where("rel = 'WRITES'").agg(F.count(F.lit(1)).alias("n"))


def _records(t: Tables):
    people = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.when(F.col("s_suppkey") % 2 == 0, F.col("s_suppkey").cast("string")).otherwise("").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("unit"))
    lines = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    of = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list("s_name"), "; ").alias("authors"), F.array_join(F.collect_list(F.col("l_suppkey").cast("string")), "; ").alias("author_ids"), F.array_join(F.collect_list(F.replace("p_type", F.lit(" "), F.lit(";"))), ";").alias("keywords"))
    papers = t.orders.join(of, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.year("o_orderdate").cast("string").alias("year"), F.col("o_orderpriority").alias("journal"), "authors", "author_ids", "keywords")
    return papers, people


@query("h4_name_tokens", "select s_name as name, 0.3 as score from supplier where contains(lower(s_name), '00001') or contains(lower(s_name), '00002') order by 2 desc, 1 limit 8")
def _(t: Tables):
    from foliospark.operators.retrieval import entity_search

    none = t.spark.createDataFrame([], "name string, score double")
    return entity_search(t.supplier.select(F.col("s_name").alias("name")), none, "00001 00002").withColumn("score", F.col("score").cast("decimal(2,1)"))


@query("h6_hop_triples", f"with e as {_EDGES}, o1 as (select * from e where src = 'a1'), i1 as (select * from e where dst = 'a1') select src as h, rel as r, dst as t from (select * from o1 union select * from e where src in (select dst from o1) union select * from i1 union select * from e where dst in (select src from i1)) order by 1, 2, 3 limit 100")
def _(t: Tables):
    return graph.hop_triples(edges(t), t.spark.createDataFrame([("a1",)], "node string"))


@query("h7_distinct_results", f"with e as {_EDGES} select distinct rel, left(src, 1) as s, left(dst, 1) as d from e")
def _(t: Tables):
    return edges(t).select("rel", F.substring("src", 1, 1).alias("s"), F.substring("dst", 1, 1).alias("d")).distinct()


@query("h8_sample_subgraph")
def _(t: Tables):
    nodes = t.supplier.select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("node_id"))
    return graph.sample_subgraph(nodes, edges(t), 60)[0]


@query("h10_keyword_neighbourhood", f"with e as {_EDGES}, s as (select s_suppkey from supplier where contains(lower(s_name), '00001') order by 'a' || s_suppkey limit 40), k as (select 'a' || s_suppkey as node_id, 0 as g from s union all select distinct dst, 1 from e where src in (select 'a' || s_suppkey from s)) select node_id from k order by g, node_id limit 40")
def _(t: Tables):
    nodes = t.supplier.select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_name").alias("name"))
    return graph.keyword_neighbourhood(nodes, edges(t), "00001", 40)[0]


@query("h11_paths", f"""
with e as (select distinct * from {_EDGES}), ids as (select *, src || chr(9247) || rel || chr(9247) || dst as eid from e),
    u as (select src as a, dst as b, rel, eid from ids union all select dst, src, rel, eid from ids where src <> dst),
    one as (select a as seed, b as here, [a, rel, b] as path, eid as used from u where a in ('a1', 'a2')),
    two as (select seed, list_concat(path, [rel, b]) as path from one join u on a = here and eid <> used)
select seed, array_to_string(path, ' ') as path from (select seed, path from one union all select seed, path from two) qualify row_number() over (partition by seed order by len(path), path) <= 20""")
def _(t: Tables):
    seeds = t.spark.createDataFrame([("a1",), ("a2",)], "node string")
    return graph.paths(edges(t), seeds, 2, 20).select("seed", F.array_join("path", " ").alias("path"))


@query("h13_lookback", "with w as (select doc_id, i, lower(w[i]) as w, lower(w[i + 1]) as w1, lower(w[i + 2]) as w2, lower(w[i + 3]) as w3 from (select doc_id, string_split(text, ' ') as w, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from documents)) select src, dst, count(*) as n from (select w as src, w1 as dst from w union all select w, w2 from w union all select w, w3 from w) where dst is not null and src <> dst group by 1, 2")
def _(t: Tables):
    words = t.documents.select(F.col("doc_id").alias("sent"), F.posexplode(F.split("text", " ")).alias("pos", "node")).withColumn("node", F.lower("node"))
    return graph.lookback_pairs(words, 3)


@query("h13_cooccurrence", "with k as (select distinct p_partkey, unnest(string_split(p_type, ' ')) as w from part) select a.w as src, b.w as dst, count(*) as n from k a join k b on a.p_partkey = b.p_partkey and a.w < b.w group by 1, 2")
def _(t: Tables):
    return graph.cooccurrence(t.part.select(F.col("p_partkey").alias("sent"), F.explode(F.split("p_type", " ")).alias("node")))


_RANK = """
with e as (select distinct l_suppkey as src, l_partkey as dst from lineitem), n as (select src as node from e union select dst from e),
d as (select src, count(*) as k from e group by 1), c as (select count(*) as n from n),
r0 as (select node, 1.0 / (select n from c) as r from n)"""


def _rank_sql(rounds: int) -> str:
    out = _RANK
    for k in range(1, rounds + 1):
        out += f""", r{k} as (select n.node, 0.15 / (select n from c) + 0.85 * (coalesce(sum(p.r / d.k), 0) + (select coalesce(sum(x.r), 0) from r{k - 1} x where x.node not in (select src from e)) / (select n from c)) as r
from n left join e on e.dst = n.node left join r{k - 1} p on p.node = e.src left join d on d.src = e.src group by n.node)"""
    return f"{out} select cast(node as bigint) as node, round(r, 9) as rank from r{rounds}"


@query("h14_pagerank", _rank_sql(5))
def _(t: Tables):
    e = t.lineitem.select(F.col("l_suppkey").cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst"))
    return graph.pagerank(e, rounds=5).select("node", F.round("rank", 9).alias("rank"))


def _communities_sql(rounds: int) -> str:
    out = f"with w as ({_WRITES}), e as (select x.a as src, y.a as dst from w x join w y on x.p = y.p and x.a <> y.a group by 1, 2), l0 as (select distinct src as node, src as label from e)"
    for k in range(1, rounds + 1):
        votes = f"select src, label, count(*) as n from e join l{k - 1} on node = dst group by 1, 2"
        out += f", l{k} as (select src as node, label from ({votes}) qualify row_number() over (partition by src order by n desc, label) = 1)"
    return f"{out} select node, label as community from l{rounds}"


@query("h16_communities", _communities_sql(5))
def _(t: Tables):
    return graph.label_propagation(graph.coauthors(t.lineitem, "l_orderkey", "l_suppkey").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _links(t: Tables):
    """Suppliers and parts as nodes of one graph, by the number of lineitems."""
    return t.lineitem.groupBy((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


@query("h16_modularity", f"""
with recursive com as ({_communities_sql(5)}), w as ({_WRITES}), e as (select x.a as s, y.a as d, count(*) as n from w x join w y on x.p = y.p and x.a < y.a group by 1, 2),
b as (select s, d, n from e union all select d, s, n from e), k as (select s as node, sum(n) as k from b group by 1), t as (select sum(k) as t from k),
i as (select sum(n) as i from b join com x on x.node = s join com y on y.node = d where x.community = y.community),
q as (select sum(g * g) as q from (select sum(k) as g from k join com using (node) group by community))
select round(coalesce(i, 0) / t - q / (t * t), 9) as modularity from i, q, t""")
def _(t: Tables):
    pairs = Table(graph.coauthors(t.lineitem, "l_orderkey", "l_suppkey").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("n").alias("weight"))).df
    return community.modularity(pairs, graph.label_propagation(pairs.select("src", "dst"))).select(F.round("modularity", 9).alias("modularity"))


@query("h16_louvain")
def _(t: Tables):
    return community.louvain(_links(t))


@query("h18_record_triples", "select 'Part ' || p_partkey as h, 'HAS_KEYWORD' as r, w as t from (select distinct p_partkey, unnest(string_split(p_type, ' ')) as w from part) union all select 'Part ' || p_partkey, 'BELONGS_TO', p_brand from part")
def _(t: Tables):
    rec = t.part.select(F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("title"), F.lit("").alias("authors"), F.replace("p_type", F.lit(" "), F.lit(";")).alias("keywords"), F.lit("").alias("affiliations"), F.col("p_brand").alias("field"))
    return graph.record_triples(rec)


@query("h19_without_embedding", "select count(*) as n from documents where doc_id not in (select vec_id from embeddings)")
def _(t: Tables):
    return t.documents.join(t.embeddings.select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left_anti").agg(F.count(F.lit(1)).alias("n"))


@query("h20_tree_paths", "select r_regionkey as id, '/' || r_name as path, 0 as level from region union all select 100 + n_nationkey, '/' || r_name || '/' || n_name, 1 from nation join region on r_regionkey = n_regionkey")
def _(t: Tables):
    r = t.region.select(F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent_id"), F.col("r_name").alias("name"))
    n = t.nation.select((F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    return graph.tree_paths(r.unionByName(n))


@query("h17_collaboration_breadth", "with w as (select distinct l_orderkey, n_name from lineitem join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey) select l_orderkey as paper, count(*) as units, array_to_string(list_sort(list(n_name)), ', ') as names from w group by 1 having count(*) > 4")
def _(t: Tables):
    s = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "n_name")
    w = t.lineitem.join(s, F.col("s_suppkey") == F.col("l_suppkey")).groupBy(F.col("l_orderkey").alias("paper")).agg(F.sort_array(F.collect_set("n_name")).alias("x"))
    return w.where(F.size("x") > 4).select("paper", F.size("x").cast("long").alias("units"), F.array_join("x", ", ").alias("names"))


def _upload_nodes(t: Tables):
    """Every vector is a node; those of even labels were uploaded."""
    labels = F.when(F.col("label") % 2 == 0, F.array(F.lit("Entity"), F.lit("Upload"))).otherwise(F.array(F.lit("Entity")))
    return t.embeddings.select(F.col("vec_id").alias("node_id"), F.concat(F.lit("node "), F.col("vec_id").cast("string")).alias("name"), labels.alias("labels"), "embedding")


def _node_queries(t: Tables):
    return t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


@query("h5_node_index_all_cells", """
select qid, name, round(s, 6) as score from (
  select q.vec_id as qid, 'node ' || e.vec_id as name, list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])) as s, e.vec_id as id
  from embeddings e, embeddings q where q.vec_id % 50 = 0 and e.label % 2 = 0
  qualify row_number() over (partition by qid order by s desc, id) <= 10) where s > 0.2""")
def _(t: Tables):
    return ann.node_search(_upload_nodes(t), _node_queries(t), threshold=0.2, probes=ann.ALL).withColumn("score", F.round("score", 6))


@query("h5_node_index")
def _(t: Tables):
    return ann.node_search(_upload_nodes(t), _node_queries(t), threshold=0.2).withColumn("score", F.round("score", 6))


#: Parts that share a supplier and an order of high quantity are neighbours; every seventh of the first ones is a seed.
_CLUES = """
with recursive l as (select l_suppkey * 2 as s, l_partkey * 2 + 1 as p from lineitem where l_quantity > 45),
u as (select s as a, p as b from l union select p, s from l),
r as (select distinct a as seed, a as node, 0 as d from u where a % 2 = 1 and a < 100 and a % 7 = 0 union select seed, b, d + 1 from r join u on a = node where d < 4),
dist as (select seed, node, min(d) as distance from r group by 1, 2),
via as (select x.seed, x.node, x.distance, min(u.b) as via from dist x left join u on u.a = x.node and exists (select 1 from dist y where y.seed = x.seed and y.node = u.b and y.distance = x.distance - 1) group by 1, 2, 3)"""


def _clues(t: Tables):
    e = t.lineitem.where("l_quantity > 45").select((F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    return e, e.select(F.col("dst").alias("node")).where("node < 100 and node % 7 = 0")


@query("v15_clue_distances", f"{_CLUES} select seed, node, distance, via from via")
def _(t: Tables):
    return graph.distances(*_clues(t)).df


@query("v15_clue_ways", f"""{_CLUES}, w as (
  select seed as a, node as b, 1 as step, node as src, via as dst, distance as rest from via where node in (select seed from via) and seed < node
  union all select w.a, w.b, step + 1, w.dst, v.via, rest - 1 from w join via v on v.seed = w.a and v.node = w.dst where rest > 1)
select a, b, step, src, dst from w""")
def _(t: Tables):
    return graph.clue_subgraph(*_clues(t))
