"""Queries on projections, joins, aggregates, windows, sorting and set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliospark.functions import time, vectors
from foliospark.functions.text import glob_pattern, has_label, like_filter, numbered_lines
from foliospark.operators import analytics, evaluation, relational
from foliospark.queries import Tables, query

NOW = "2024-01-31 00:00:00"


@query("p1_project_existing", "select c_custkey, c_name from customer")
def _(t: Tables):
    return relational.project(t.customer, ["c_custkey", "c_phone", "c_name"])


@query("p2_pick_column", "select c_mktsegment as v, count(*) as n from customer group by 1")
def _(t: Tables):
    c = t.customer
    return c.groupBy(F.col(relational.pick(c, ["segment", "mkt"])).alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("p3_first_filled", "select doc_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), '')) as v from documents")
def _(t: Tables):
    from foliospark.functions.nulls import first_filled

    return t.documents.select("doc_id", first_filled(F.col("lang"), F.col("source")).alias("v"))


@query("p4_valid_rows", "select s_suppkey, s_name, '' as s_phone from supplier where trim(s_name) <> ''")
def _(t: Tables):
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("s_suppkey long, s_name string, s_phone string")
    return relational.conform(t.supplier, schema).where(F.trim("s_name") != "")


@query("p5_equal_without_case", "select n_nationkey, n_name from nation where lower(n_name) in ('france', 'germany')")
def _(t: Tables):
    from foliospark.functions.names import fold

    return t.nation.where(F.lower(fold(F.col("n_name"))).isin("france", "germany")).select("n_nationkey", "n_name")


@query("p6_exclude_substring", "select p_partkey from part where not contains(lower(p_type), 'steel')")
def _(t: Tables):
    return t.part.where(~F.contains(F.lower("p_type"), F.lit("steel"))).select("p_partkey")


@query("p7_label_in_list", "select p_partkey from part where list_contains(string_split(lower(p_type), ' '), 'brass')")
def _(t: Tables):
    return t.part.where(has_label(F.replace("p_type", F.lit(" "), F.lit(" | ")), "BRASS")).select("p_partkey")


@query("p8_length_gates", "select doc_id, length(text) as n from documents where length(text) >= 50")
def _(t: Tables):
    return t.documents.where(F.length("text") >= 50).select("doc_id", F.length("text").cast("long").alias("n"))


@query("p9_name_contains", "select distinct s_name from supplier where contains(lower(s_name), '0001')")
def _(t: Tables):
    return t.supplier.where(F.contains(F.lower("s_name"), F.lower(F.lit("0001")))).select("s_name").distinct()


@query("p10_like_filter", "select doc_id, source from documents where source like '%src1%'")
def _(t: Tables):
    return t.documents.where(like_filter(F.col("source"), "src1")).select("doc_id", "source")


@query("p11_optional_predicates", "select event_id from events where event_type in ('click', 'error') and user_id = 7")
def _(t: Tables):
    return t.events.where(relational.matching(event_type=["click", "error"], user_id=7, status="all", agent=None)).select("event_id")


@query("p12_not_in", "select user_id, count(*) as n from events where event_type not in ('error', 'signup') group by 1")
def _(t: Tables):
    return t.events.where(~F.col("event_type").isin("error", "signup")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("p13_label_filter", "select source, count(*) as n from documents where source <> 'src0' and not starts_with(source, 'src1') group by 1")
def _(t: Tables):
    return t.documents.where((F.col("source") != "src0") & ~F.startswith("source", F.lit("src1"))).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("p14_access", "select event_id from events where coalesce(try_cast(json_extract_string(props, '$.k') as int), 0) in (3, 5) or event_type = 'signup'")
def _(t: Tables):
    allowed = F.array(F.lit(3), F.lit(5))
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))
    return t.events.where((F.col("event_type") == "signup") | F.array_contains(allowed, k)).select("event_id")


@query("p16_keyword_guard", "select doc_id from documents where contains(lower(text), 'idiot') or contains(lower(text), 'license')")
def _(t: Tables):
    words = F.array(F.lit("idiot"), F.lit("license"))
    return t.documents.where(F.exists(words, lambda w: F.contains(F.lower("text"), w))).select("doc_id")


@query("p17_line_grep", "select doc_id, cast(i as int) as line, l as found from (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from documents) where contains(l, 'reserved')")
def _(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "found"))
    return lines.where(F.contains("found", F.lit("reserved"))).select("doc_id", (F.col("i") + 1).alias("line"), "found")


@query("p18_path_glob", "select page_id, url from pages where regexp_full_match(url, 'https://[^/]*/en/.*')")
def _(t: Tables):
    return t.pages.where(F.col("url").rlike(glob_pattern("https://*/en/**"))).select("page_id", "url")


@query("p19_numbered_window", "select doc_id, array_to_string([format('{:6d}', i + 1) || chr(9) || l[i + 1] for i in range(1, least(len(l), 3))], chr(10)) as v from (select doc_id, string_split(text, chr(10)) as l from documents)")
def _(t: Tables):
    return t.documents.select("doc_id", numbered_lines(F.col("text"), 1, 2).alias("v"))


@query("p21_drop_key", "select vec_id, label from embeddings where label is not null")
def _(t: Tables):
    props = F.map_filter(F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("embedding"), F.lit("x")), lambda k, v: k != "embedding")
    return t.embeddings.where("label is not null").select("vec_id", F.element_at(props, "label").cast("int").alias("label"))


@query("j1_left_join_by_name", "select c_custkey, n_name from customer left join nation on n_nationkey = c_nationkey")
def _(t: Tables):
    return t.customer.join(t.nation, F.col("c_nationkey").eqNullSafe(F.col("n_nationkey")), "left").select("c_custkey", "n_name")


@query("j3_id_lookup", "select l_orderkey, l_linenumber, s_name from lineitem join supplier on s_suppkey = l_suppkey where l_quantity > 49")
def _(t: Tables):
    return t.lineitem.where("l_quantity > 49").join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "s_name")


@query("j4_fill_if_empty", "select c_custkey, case when c_custkey % 3 = 0 then coalesce(n_name, '') else 'own' end as v from customer left join nation on n_nationkey = c_nationkey")
def _(t: Tables):
    own = F.when(F.col("c_custkey") % 3 != 0, "own").otherwise("")
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", F.coalesce(F.nullif(own, F.lit("")), "n_name", F.lit("")).alias("v"))


@query("j15_either_key", "select distinct e.event_id, c.c_custkey from events e join customer c on e.user_id = c.c_custkey or e.user_id = c.c_nationkey where e.event_type = 'signup'")
def _(t: Tables):
    left = t.events.where("event_type = 'signup'").select("event_id", "user_id")
    return relational.either_key_join(left, t.customer.select("c_custkey", "c_nationkey", F.col("c_custkey").alias("k")), "user_id", ["k", "c_nationkey"], "c_custkey").select("event_id", "c_custkey")


@query("j16_either_key_left", "select e.event_id, count(c.c_custkey) as n from events e left join customer c on e.user_id = c.c_custkey or e.user_id = c.c_nationkey + 1000 where e.event_type = 'signup' group by 1")
def _(t: Tables):
    left = t.events.where("event_type = 'signup'").select("event_id", "user_id")
    right = t.customer.select("c_custkey", F.col("c_custkey").alias("k"), (F.col("c_nationkey") + 1000).alias("k2"))
    return relational.either_key_join(left, right, "user_id", ["k", "k2"], "c_custkey", "left").groupBy("event_id").agg(F.count("c_custkey").alias("n"))


@query("j17_inner_chain", "select n_name, count(*) as n from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where l_returnflag = 'R' group by 1")
def _(t: Tables):
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return t.lineitem.where("l_returnflag = 'R'").join(o, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("j18_left_with_default", "select c_custkey, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders group by 1) on o_custkey = c_custkey")
def _(t: Tables):
    n = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.customer.join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j19_left_department", "select c_custkey, n_name from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 3")
def _(t: Tables):
    return t.customer.join(t.nation.where("n_regionkey < 3"), F.col("n_nationkey") == F.col("c_nationkey"), "left").select("c_custkey", "n_name")


@query("j20_counts_per_department", "select n_nationkey, n_name, (select count(*) from customer where c_nationkey = n_nationkey) as users from nation")
def _(t: Tables):
    n = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("users"))
    return t.nation.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("users", F.lit(0)).alias("users"))


@query("j21_anti_titles", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def _(t: Tables):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("j22_semi_endpoints", "select distinct l_orderkey, l_suppkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 0)")
def _(t: Tables):
    return t.lineitem.join(t.supplier.where("s_acctbal > 0"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("l_orderkey", "l_suppkey").distinct()


@query("j23_unknown_collections", "select distinct regexp_replace(source || '_chunks', '_(chunks|relationships|entities)$', '') as base from documents where source not in (select 'src' || cast(n_nationkey as varchar) from nation where n_nationkey < 10)")
def _(t: Tables):
    base = F.regexp_replace(F.concat("source", F.lit("_chunks")), "_(chunks|relationships|entities)$", "")
    known = t.nation.where("n_nationkey < 10").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("base"))
    return t.documents.select(base.alias("base")).distinct().join(known, "base", "left_anti")


@query("j30_day_buckets", f"select cast(floor((epoch(timestamp '{NOW}') - epoch(ts)) / 86400) as int) as day, count(*) as n from events group by 1 having day between 0 and 6")
def _(t: Tables):
    d = time.days_before(F.col("ts"), F.lit(NOW).cast("timestamp_ntz"))
    return t.events.groupBy(d.alias("day")).agg(F.count(F.lit(1)).alias("n")).where("day between 0 and 6")


@query("a1_global_counts", "select count(*) as n, count(*) filter (event_type = 'error') as errors, count(distinct user_id) as users from events")
def _(t: Tables):
    return t.events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))


@query("a2_active_users", f"select cast(floor((epoch(timestamp '{NOW}') - epoch(ts)) / 86400) as int) as day, count(distinct user_id) as users from events group by 1 having day between 0 and 29")
def _(t: Tables):
    return analytics.active_users(t.events, "user_id", "ts", F.lit(NOW).cast("timestamp_ntz"), 30)


@query("a3_success_rate", "select event_type, count(*) as calls, count(*) filter (value < 10) as errors, round(100.0 * (count(*) - count(*) filter (value < 10)) / count(*), 2) as success_rate from events group by 1")
def _(t: Tables):
    return analytics.success(t.events, ["event_type"], F.col("value") < 10)


@query("a4_satisfaction", "select user_id, count(*) filter (event_type in ('click', 'error')) as feedback, case when count(*) filter (event_type in ('click', 'error')) = 0 then 100.0 else round(100.0 * count(*) filter (event_type = 'click') / count(*) filter (event_type in ('click', 'error')), 2) end as satisfaction from events group by 1")
def _(t: Tables):
    liked = F.when(F.col("event_type") == "click", True).when(F.col("event_type") == "error", False)
    return analytics.satisfaction(t.events, ["user_id"], liked)


@query("a5_top_ten", "select user_id, count(*) as n from events where event_type = 'purchase' group by 1 order by n desc, user_id limit 10")
def _(t: Tables):
    return t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@query("a6_categories", "select case when trim(coalesce(lang, '')) = '' then 'Other' when lang = 'en' then 'English' when lang = 'de' then 'German' else upper(trim(lang)) || ' File' end as category, count(*) as n, cast(sum(coalesce(n_chars, 0)) as bigint) as bytes from documents group by 1")
def _(t: Tables):
    return analytics.by_category(t.documents, F.col("lang"), {"en": "English", "de": "German"}, "n_chars")


@query("a7_grouping_sets", "select coalesce(o_orderstatus, '*') as status, coalesce(o_orderpriority, '*') as kind, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def _(t: Tables):
    g = t.orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("kind"), "n")


@query("a8_type_counts", "select coalesce(lang, 'none') as kind, count(*) as n, cast(sum(n_chars) as bigint) as total from documents group by 1")
def _(t: Tables):
    return t.documents.groupBy(F.coalesce("lang", F.lit("none")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))


@query("a10_mode_or_first", """
with c as (select o_custkey, o_orderpriority as v, count(*) as n, min(o_orderkey) as p from orders group by 1, 2)
select o_custkey, arg_max(v, n * 1000000000 - p) as o_orderpriority from c group by 1""")
def _(t: Tables):
    return relational.mode_or_first(t.orders, ["o_custkey"], "o_orderpriority", "o_orderkey")


@query("a11_first_filled", "select o_custkey, arg_min(o_orderstatus, o_orderkey) as v from orders where trim(o_orderstatus) <> '' group by 1")
def _(t: Tables):
    return t.orders.where(F.trim("o_orderstatus") != "").groupBy("o_custkey").agg(F.min_by("o_orderstatus", "o_orderkey").alias("v"))


@query("a12_sorted_list", "select o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority))), '; ') as v from orders group by 1")
def _(t: Tables):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderpriority")), "; ").alias("v"))


@query("a13_collect_having", "select l_orderkey, count(distinct l_suppkey) as n from lineitem group by 1 having count(distinct l_suppkey) > 5")
def _(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.size(F.collect_set("l_suppkey")).cast("long").alias("n")).where("n > 5")


@query("a14_distinct_by_keys", "select l_returnflag, l_linestatus, count(distinct l_orderkey) as n from lineitem group by 1, 2")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count_distinct("l_orderkey").alias("n"))


@query("a15_group_size", "select p_brand, count(*) as n, count(distinct p_type) as kinds from part group by 1")
def _(t: Tables):
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_type").alias("kinds"))


@query("a16_fill_rates", "select 'quality' as \"column\", count(quality) as filled, round(100.0 * count(quality) / count(*), 2) as rate from documents left join labels using (doc_id) union all select 'lang', count(lang), round(100.0 * count(lang) / count(*), 2) from documents left join labels using (doc_id)")
def _(t: Tables):
    return relational.fill_rates(t.documents.join(t.labels, "doc_id", "left"), ["quality", "lang"])


@query("a18_running_totals", "select conv_id, count(*) as messages, cast(sum(length(text)) as bigint) as total from conversations group by 1")
def _(t: Tables):
    return t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("total"))


@query("a19_percentiles", "select lang, round(quantile_cont(n_chars, 0.95), 4) as p95, round(quantile_cont(n_chars, 0.99), 4) as p99, round(avg(n_chars), 4) as mean, min(n_chars) as least, max(n_chars) as most from documents group by 1")
def _(t: Tables):
    p = lambda x: F.round(F.percentile("n_chars", x), 4)
    return t.documents.groupBy("lang").agg(p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.avg("n_chars"), 4).alias("mean"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query("a20_slot_coverage", "select 'the' as slot, round(avg(case when contains(lower(text), ' the ') then 100.0 else 0.0 end), 2) as rate from conversations union all select 'der', round(avg(case when contains(lower(text), ' der ') or contains(lower(text), ' die ') then 100.0 else 0.0 end), 2) from conversations")
def _(t: Tables):
    return evaluation.slot_coverage(t.conversations, "text", {"the": [" the "], "der": [" der ", " die "]})


@query("a22_category_summary", "select role, count(*) as n from conversations group by 1")
def _(t: Tables):
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("a23_pivot", "select p_brand, coalesce(round(avg(p_retailprice) filter (p_size < 10), 4), 0) as small, coalesce(round(avg(p_retailprice) filter (p_size >= 10), 4), 0) as large from part group by 1")
def _(t: Tables):
    kind = F.when(F.col("p_size") < 10, "small").otherwise("large")
    return t.part.withColumn("k", kind).groupBy("p_brand").pivot("k", ["small", "large"]).agg(F.round(F.avg("p_retailprice"), 4)).fillna(0)


@query("w1_keep_first", "select o_custkey, min(o_orderkey) as o_orderkey from orders group by 1")
def _(t: Tables):
    return relational.keep_first(t.orders, ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("w2_ordered_keep_first", "select o_custkey, arg_min(o_orderkey, o_totalprice * -1000) as o_orderkey from orders group by 1")
def _(t: Tables):
    return relational.top_per_group(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("w4_latest", "select user_id, max(event_id) as event_id from events group by 1")
def _(t: Tables):
    return relational.latest(t.events, ["user_id"], ["event_id"]).select("user_id", "event_id")


@query("w5_top_k_per_group", "select l_suppkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as r from lineitem) where r <= 3")
def _(t: Tables):
    return relational.top_per_group(t.lineitem, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 3).select("l_suppkey", "l_orderkey", "l_linenumber")


@query("w7_position", "select l_orderkey, l_linenumber, case when row_number() over (partition by l_orderkey order by l_linenumber) = 1 then 'first' else 'co' end as position from lineitem")
def _(t: Tables):
    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(r == 1, "first").otherwise("co").alias("position"))


@query("l1_order_limit_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 10")
def _(t: Tables):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(20).select("o_orderkey", "o_totalprice")


@query("l2_pinned_first", "select c_custkey, 0 as grp from customer where c_acctbal > 9900 union all (select c_custkey, 1 from customer where not (c_acctbal > 9900) order by c_custkey limit greatest(0, 50 - (select count(*) from customer where c_acctbal > 9900)) offset 5)")
def _(t: Tables):
    return relational.pinned_first(t.customer, F.col("c_acctbal") > 9900, [F.col("c_custkey")], 50, 5).select("c_custkey", "grp")


@query("l3_page", "select o_orderkey from orders order by o_orderkey limit 25 offset 50")
def _(t: Tables):
    return relational.page(t.orders, [F.col("o_orderkey")], 3, 25).select("o_orderkey")


@query("l3_page_info", "select count(*) as total, cast(ceil(count(*) / 25.0) as bigint) as pages, 3 < ceil(count(*) / 25.0) as has_next, true as has_prev from orders")
def _(t: Tables):
    return relational.page_info(t.orders, 3, 25)


@query("l4_custom_order", "select o_orderkey, coalesce(nullif(list_position(['1-URGENT', '2-HIGH', '3-MEDIUM'], o_orderpriority), 0), 999) as r from orders")
def _(t: Tables):
    p = F.array_position(F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM")]), F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", F.coalesce(F.nullif(p, F.lit(0)), F.lit(999)).cast("int").alias("r"))


@query("l7_hash_sample", "select doc_id from documents order by md5('42:' || doc_id), doc_id limit 100")
def _(t: Tables):
    return relational.sample_by_hash(t.documents, "doc_id", 100).select("doc_id")


@query("l9_size_cap", "select event_id from (select event_id, sum(length(props)) over (order by event_id) as s from (select * from events order by event_id limit 500)) where s <= 2000")
def _(t: Tables):
    return relational.prefix_by_size(t.events.orderBy("event_id").limit(500), [F.col("event_id")], 2000, F.length("props")).select("event_id")


@query("u1_union_by_name", "select s_suppkey as k, s_name as name, null::varchar as segment from supplier union all select c_custkey, c_name, c_mktsegment from customer")
def _(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return s.unionByName(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")), allowMissingColumns=True)


@query("u2_distinct_pairs", "select distinct l_orderkey, l_suppkey from lineitem")
def _(t: Tables):
    return t.lineitem.select("l_orderkey", "l_suppkey").distinct()


@query("u3_set_sizes", "select l_orderkey, len(list_intersect(list(l_partkey) filter (l_linenumber <= 3), list(l_partkey) filter (l_linenumber >= 2))) as both from lineitem group by 1 having count(*) filter (l_linenumber <= 3) > 0 and count(*) filter (l_linenumber >= 2) > 0")
def _(t: Tables):
    a, b = F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_partkey"))), F.collect_set(F.when(F.col("l_linenumber") >= 2, F.col("l_partkey")))
    return t.lineitem.groupBy("l_orderkey").agg(a.alias("a"), b.alias("b")).where("size(a) > 0 and size(b) > 0").select("l_orderkey", F.size(F.array_intersect("a", "b")).cast("long").alias("both"))


@query("u4_except", "select n_nationkey from nation except select c_nationkey from customer where c_acctbal > 9000")
def _(t: Tables):
    return t.nation.select("n_nationkey").exceptAll(t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")).distinct())


@query("u6_concat_results", "select 'in' as kind, count(*) as n from conversations where role = 'user' union all select 'out', count(*) from conversations where role = 'assistant'")
def _(t: Tables):
    one = lambda role, kind: t.conversations.where(F.col("role") == role).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("user", "in").unionByName(one("assistant", "out"))


@query("d3_gap_filled", """
with e as (select cast(ts + interval 8 hours as date) as d, event_type as c from events), s as (select * from e where d between date '2024-01-17' and date '2024-01-30')
select strftime(d, '%Y-%m-%d') as bucket, c as category, count(s.d) as total from (select distinct c from s) x cross join (select cast(unnest(generate_series(timestamp '2024-01-17', timestamp '2024-01-30', interval 1 day)) as date) as d) g left join s using (c, d) group by 1, 2""")
def _(t: Tables):
    return analytics.gap_filled(t.events, "ts", "event_type", F.count(F.lit(1)), "2024-01-30")


@query("d3_peak", """
with s as (select strftime(cast(ts + interval 8 hours as date), '%Y-%m-%d') as b, count(*) as n from events where cast(ts + interval 8 hours as date) between date '2024-01-17' and date '2024-01-30' group by 1)
select (select b from s order by n desc, b limit 1) as peak_bucket, max(n) as peak_total, cast(sum(n) as bigint) as total_count, round(avg(n), 2) as average from s""")
def _(t: Tables):
    return analytics.peak(analytics.gap_filled(t.events, "ts", "event_type", F.count(F.lit(1)), "2024-01-30"))


@query("m6_percentage", "select source, round(100.0 * count(*) filter (lang = 'en') / count(*), 2) as share from documents group by 1")
def _(t: Tables):
    return t.documents.groupBy("source").agg(vectors.rounded_share(F.count_if(F.col("lang") == "en"), F.count(F.lit(1))).alias("share"))
