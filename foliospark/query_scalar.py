"""Queries on text, names, dates, arrays, JSON and vectors."""

from functools import reduce

from pyspark.sql import functions as F

from foliospark.functions import names, nulls, text, time, vectors
from foliospark.operators.relational import sample_by_hash
from foliospark.queries import Tables, query
from foliospark.sources import dom, html, readers
from foliospark.tables import Table


@query("n1_clean_id", "select o_orderkey, case when o_orderkey % 5 = 0 then '' when o_orderkey % 5 = 1 then cast(o_orderkey as varchar) when o_orderkey % 5 = 2 then 'v2.0' else cast(o_orderkey as varchar) end as v from orders")
def _(t: Tables):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, " NaN ").when(k % 5 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(k % 5 == 2, "v2.0").otherwise(k.cast("string"))
    return t.orders.select("o_orderkey", nulls.clean_id(raw).alias("v"))


@query("n3_clean_value", "select o_orderkey, case when o_orderkey % 3 = 0 then null else cast(o_orderkey as varchar) end as v from orders")
def _(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", nulls.clean_value(F.when(k % 3 == 0, "None").otherwise(F.concat(k.cast("string"), F.lit(".0")))).alias("v"))


@query("n4_clean_identifier", "select o_orderkey, case when o_orderkey % 3 = 0 then null else cast(o_orderkey as varchar) end as v from orders")
def _(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select("o_orderkey", nulls.clean_identifier(F.when(k % 3 == 0, "check").otherwise(F.concat(F.lit(" "), k.cast("string"), F.lit(".0")))).alias("v"))


@query("n5_safe_text", "select doc_id, coalesce(nullif(trim(lang), ''), '?') as v from documents")
def _(t: Tables):
    return t.documents.select("doc_id", nulls.safe_text(F.col("lang"), "?").alias("v"))


@query("f1_clean_text", r"select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as v from documents where not contains(text, '&') and not contains(text, '\') ")
def _(t: Tables):
    return t.documents.where(~F.contains("text", F.lit("&")) & ~F.contains("text", F.lit("\\"))).select("doc_id", text.clean_text(F.col("text")).alias("v"))


@query("f2_clean_abstract", r"select doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) as v from documents where not contains(text, '&') and not contains(text, '\') and not regexp_matches(text, '(?i)keyword|key\s+word|kata\s|subject\s|index\s')")
def _(t: Tables):
    clean = ~F.contains("text", F.lit("&")) & ~F.contains("text", F.lit("\\")) & ~F.col("text").rlike(r"(?i)keyword|key\s+word|kata\s|subject\s|index\s")
    return t.documents.where(clean).select("doc_id", text.clean_abstract(F.concat(F.lit("Abstract: "), "text", F.lit(" Keywords: a, b"))).alias("v"))


@query("f4_flip_name", "select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment || ' ' || c_name else c_name end as v from customer")
def _(t: Tables):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(", "), "c_mktsegment")).otherwise(F.col("c_name"))
    return t.customer.select("c_custkey", names.flip(raw).alias("v"))


@query("f5_matching_name", r"select c_custkey, regexp_replace(lower(c_name), '\s+', ' ', 'g') as v from customer")
def _(t: Tables):
    return t.customer.select("c_custkey", names.for_matching(F.concat(F.lit("Prof. Dr. "), "c_name", F.lit(", S.Kom., M.Sc."))).alias("v"))


@query("f6_without_titles", "select c_custkey, c_name as v from customer")
def _(t: Tables):
    return t.customer.select("c_custkey", names.without_titles(F.concat(F.lit("Prof. Dr. "), "c_name", F.lit(", M.T."))).alias("v"))


@query("f7_normalized_name", "select doc_id, regexp_replace(strip_accents(lower(trim(regexp_replace(regexp_replace(text, ',.*', '', 's'), '\\s+', ' ', 'g')))), '[^\\x00-\\x7F]', '', 'g') as v from documents")
def _(t: Tables):
    return t.documents.select("doc_id", names.fold(F.lower(text.squeeze(F.regexp_replace("text", "(?s),.*", "")))).alias("v"))


@query("f8_squashed_title", "select p_partkey, replace(trim(lower(p_name)), ' ', '') as v from part")
def _(t: Tables):
    return t.part.select("p_partkey", text.squashed(F.col("p_name")).alias("v"))


@query("f9_plain_text", r"select conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_ \n]', '', 'g'), '\s+', ' ', 'g')) as v from conversations where not regexp_matches(text, '[^\x00-\x7F]')")
def _(t: Tables):
    return t.conversations.where(~F.col("text").rlike(r"[^\x00-\x7F]")).select("conv_id", "turn", text.plain(F.col("text")).alias("v"))


@query("f10_trigrams", "select p_partkey, len(list_distinct([substring(lower(p_name), i, 3) for i in range(1, length(p_name) - 1)])) as n from part")
def _(t: Tables):
    return t.part.select("p_partkey", F.size(text.trigrams(F.lower("p_name"))).cast("long").alias("n"))


@query("f14_initials", "select p_partkey, case when contains(p_name, ' ') then left(string_split(p_name, ' ')[1], 1) || ' ' || string_split(p_name, ' ')[2] else p_name end as v from (select p_partkey, array_to_string(string_split(p_name, ' ')[1:2], ' ') as p_name from part)")
def _(t: Tables):
    two = F.array_join(F.slice(F.split("p_name", " "), 1, 2), " ")
    return t.part.select("p_partkey", names.initials(two).alias("v"))


@query("f15_program_names", "select n_nationkey, 'S1 ' || n_name as v from nation")
def _(t: Tables):
    raw = F.concat("n_name", F.lit(" S1"))
    return t.nation.select("n_nationkey", F.regexp_replace(raw, r"^(.*) (S[123]|D[34])$", "$2 $1").alias("v"))


@query("f16_keywords", "select p_partkey, array_to_string(list_filter(list_transform(string_split(lower(p_type), ' '), lambda x: trim(x)), lambda x: x <> ''), ', ') as v from part")
def _(t: Tables):
    return t.part.select("p_partkey", text.keywords(F.replace("p_type", F.lit(" "), F.lit(" ;"))).alias("v"))


@query("f17_paper_key", "select o_orderkey, case when o_orderkey % 2 = 0 then md5('doi:10.1/' || o_orderkey) else md5('title:order' || o_orderkey || '_year:' || year(o_orderdate)) end as v, substr(md5(cast(o_orderkey as varchar)), 1, 12) as short, sha256(o_orderpriority) as hash from orders")
def _(t: Tables):
    k = F.col("o_orderkey").cast("string")
    doi = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" 10.1/"), k))
    key = text.paper_key(doi, F.concat(F.lit("Order #"), k), F.year("o_orderdate"))
    return t.orders.select("o_orderkey", key.alias("v"), text.md5_prefix(k).alias("short"), F.sha2("o_orderpriority", 256).alias("hash"))


@query("f18_truncate", "select doc_id, left(trim(text), 200) as v from documents where not regexp_matches(text, '^\\s|\\s$')")
def _(t: Tables):
    return t.documents.where(~F.col("text").rlike(r"^\s|\s$")).select("doc_id", text.shortened(F.col("text"), 200).alias("v"))


@query("f20_abbreviations", "select p_partkey, 'n' || p_partkey as short, regexp_replace(lower(p_type), '\\s+', ' ', 'g') as long from part")
def _(t: Tables):
    raw = F.concat("p_type", F.lit(" (N"), F.col("p_partkey").cast("string"), F.lit(")"))
    first = F.get(text.abbreviations(raw), F.lit(0))
    return t.part.select("p_partkey", text.plain(first.short).alias("short"), text.plain(first.long).alias("long"))


@query("f21_title_terms", "select p_partkey, len(regexp_extract_all(p_type, '[A-Z]{2,}[0-9]*')) + len(regexp_extract_all(p_type, '[A-Z][A-Za-z0-9]*(?:\\s+[A-Z][A-Za-z0-9]*)+')) as n from part")
def _(t: Tables):
    return t.part.select("p_partkey", F.size(text.title_terms(F.col("p_type"))).cast("long").alias("n"))


@query("f22_label_map", "select event_id, case event_type when 'click' then 'Method' when 'view' then 'Model' when 'error' then 'Tool' else 'Field' end as v from events")
def _(t: Tables):
    raw = F.create_map(*[F.lit(x) for x in ("click", "Algorithm", "view", "MODEL", "error", "framework")])
    return t.events.select("event_id", text.node_type(F.coalesce(F.element_at(raw, F.col("event_type")), F.col("event_type"))).alias("v"))


@query("f23_token_count", "select doc_id, case when trim(text) = '' then 0 else greatest(1, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]'))) end as n from documents")
def _(t: Tables):
    return t.documents.select("doc_id", text.token_count(F.col("text")).cast("long").alias("n"))


@query("f25_ordered_set", "select p_partkey as doc_id, array_to_string(string_split(p_type, ' '), '|') as v from part where len(list_distinct(string_split(p_type, ' '))) = len(string_split(p_type, ' '))")
def _(t: Tables):
    words = F.split("p_type", " ")
    return t.part.where(F.size(F.array_distinct(words)) == F.size(words)).select(F.col("p_partkey").alias("doc_id"), F.array_join(text.ordered_set(F.concat_ws(";", F.concat_ws(" ; ", words), F.get(words, F.lit(0)))), "|").alias("v"))


@query("f26_title", "select conv_id, left(trim(min(text)), 40) as v from conversations where turn = 0 and not regexp_matches(text, '^\\s|\\s$') group by 1")
def _(t: Tables):
    first = t.conversations.where((F.col("turn") == 0) & ~F.col("text").rlike(r"^\s|\s$")).groupBy("conv_id").agg(F.min("text").alias("x"))
    return first.select("conv_id", text.shortened(F.col("x"), 40).alias("v"))


@query("f27_doi_link", "select o_orderkey, case when o_orderkey % 3 = 0 then 'https://a.b/' || o_orderkey else 'https://doi.org/10.1/' || o_orderkey end as v from orders")
def _(t: Tables):
    k = F.col("o_orderkey").cast("string")
    link = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://a.b/"), k)).when(F.col("o_orderkey") % 3 == 1, "https://scholar.google.com/x")
    return t.orders.select("o_orderkey", text.link_or_doi(link, F.concat(F.lit("10.1/"), k)).alias("v"))


@query("f28_summary_or_abstract", "select doc_id, case when length(source) > 4 then source else left(text, 100) end as v from documents")
def _(t: Tables):
    return t.documents.select("doc_id", F.when(F.length("source") > 4, F.col("source")).otherwise(F.substring("text", 1, 100)).alias("v"))


@query("d1_buckets", "select event_id, strftime(ts + interval 8 hours, '%Y-%m-%d %H:00') as hour, strftime(ts + interval 8 hours, '%G-%V') as week, strftime(ts + interval 8 hours, '%Y-%m-%d') as day from events")
def _(t: Tables):
    return t.events.select("event_id", *[time.bucket(F.col("ts"), u).alias(u) for u in ("hour", "week", "day")])


@query("d5_year", "select o_orderkey, case when o_orderkey % 4 = 0 then null else year(o_orderdate) end as y from orders")
def _(t: Tables):
    y = F.year("o_orderdate").cast("string")
    raw = F.when(F.col("o_orderkey") % 4 == 0, "n.d.").when(F.col("o_orderkey") % 4 == 1, F.concat(y, F.lit(".0"))).otherwise(y)
    return t.orders.select("o_orderkey", time.year_of(raw).cast("long").alias("y"))


@query("m1_cosine", "select e.vec_id, round(list_cosine_similarity(cast(e.embedding as double[]), cast(q.embedding as double[])), 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q")
def _(t: Tables):
    q = F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))
    return t.embeddings.join(q).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))


@query("m2_metric_score", "select e.vec_id, round(1 / (1 + list_distance(cast(e.embedding as double[]), cast(q.embedding as double[]))), 6) as score from embeddings e, (select embedding from embeddings where vec_id = 0) q")
def _(t: Tables):
    q = F.broadcast(t.embeddings.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1))
    return t.embeddings.join(q).select("vec_id", F.round(vectors.similarity(vectors.euclidean(F.col("embedding"), F.col("q")), "L2"), 6).alias("score"))


@query("m3_sigmoid", "select c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 6) as v from customer")
def _(t: Tables):
    return t.customer.select("c_custkey", F.round(vectors.sigmoid(F.col("c_acctbal") / 1000), 6).alias("v"))


@query("m5_calculator", "select l_orderkey, l_linenumber, round(l_quantity + l_tax, 4) as a, round(l_quantity - l_tax, 4) as s, round(l_quantity * l_tax, 4) as m, round(l_extendedprice / l_quantity, 4) as d from lineitem where l_quantity = 17")
def _(t: Tables):
    q, x, p = F.col("l_quantity"), F.col("l_tax"), F.col("l_extendedprice")
    return t.lineitem.where("l_quantity = 17").select("l_orderkey", "l_linenumber", F.round(q + x, 4).alias("a"), F.round(q - x, 4).alias("s"), F.round(q * x, 4).alias("m"), F.round(p / q, 4).alias("d"))


@query("r1_split_lists", "select p_partkey, unnest(list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '')) as w from part")
def _(t: Tables):
    return t.part.select("p_partkey", F.explode(text.parts(F.col("p_name"), " ")).alias("w"))


@query("r2_parallel_explode", "select p_partkey, unnest(string_split(p_type, ' ')) as a, unnest(list_reverse(string_split(p_type, ' '))) as b from part")
def _(t: Tables):
    a = F.split("p_type", " ")
    return t.part.select("p_partkey", F.inline(F.arrays_zip(a.alias("a"), F.reverse(a).alias("b"))))


@query("r3_positional_pairs", "select p_partkey, w[i] as w, coalesce(k[i], '') as k from (select p_partkey, string_split(p_name, ' ') as w, string_split(p_brand, '#') as k, unnest(range(1, len(string_split(p_name, ' ')) + 1)) as i from part)")
def _(t: Tables):
    k = F.split("p_brand", "#")
    rows = t.part.select("p_partkey", k.alias("ks"), F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    return rows.select("p_partkey", "w", F.coalesce(F.get("ks", F.col("i")), F.lit("")).alias("k"))


@query("r4_json_path", "select event_type, cast(sum(coalesce(try_cast(json_extract_string(props, '$.k') as int), 0)) as bigint) as tokens from events group by 1")
def _(t: Tables):
    return t.events.groupBy("event_type").agg(F.sum(F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0))).alias("tokens"))


@query("r5_fenced_json", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(t: Tables):
    reply = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```"))
    return t.events.select("event_id", F.get_json_object(text.first_object(reply), "$.k").alias("k"))


@query("r6_inverted_index", "select p_partkey, p_name as v from part where len(list_distinct(string_split(p_name, ' '))) = len(string_split(p_name, ' '))")
def _(t: Tables):
    words = F.split("p_name", " ")
    index = F.map_from_arrays(words, F.transform(words, lambda w, i: F.array(i)))
    return t.part.where(F.size(F.array_distinct(words)) == F.size(words)).select("p_partkey", text.text_of_index(index).alias("v"))


@query("r8_ordered_unique", "select l_orderkey, len(list(distinct l_suppkey)) as n from lineitem group by 1")
def _(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg(F.size(F.array_distinct(F.collect_list("l_suppkey"))).cast("long").alias("n"))


@query("s8_payload_records", "select event_id, json_extract_string(props, '$.k') as k from events")
def _(t: Tables):
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.concat(F.lit('{"items": ['), "props", F.lit("]}")))
    return readers.payload_records(t.events.select("event_id", body.alias("payload"))).select("event_id", F.element_at("record", "k").alias("k"))


@query("s9_text_export", "select o_orderkey, 'Order ' || o_orderkey as title, cast(year(o_orderdate) as varchar) as year from orders where year(o_orderdate) > 1995")
def _(t: Tables):
    y = F.year("o_orderdate").cast("string")
    rec = F.concat(F.lit("\nDoe J.\nOrder "), F.col("o_orderkey").cast("string"), F.lit("\n("), y, F.lit(") Journal of Orders, 3\nhttps://x.y/z\nDOI: 10.1/"), F.col("o_orderkey").cast("string"), F.lit("\nABSTRACT: a\n"))
    got = readers.export_records(t.orders.select(rec.alias("value")), 1995)
    return got.select(F.regexp_extract("doi", r"(\d+)$", 1).cast("long").alias("o_orderkey"), "title", "year")


@query("s10_projected_scan", "select s_suppkey, s_nationkey from supplier")
def _(t: Tables):
    return t.supplier.select("s_suppkey", "s_nationkey")


@query("s11_title_case_columns", 'select s_suppkey as "S Suppkey", s_name as "S Name" from supplier')
def _(t: Tables):
    return readers.renamed_for_display(t.supplier.select("s_suppkey", "s_name"))


@query("s13_openalex", "select o_orderkey, 'order of ' || lower(o_orderpriority) as abstract, 'kept' as keywords from orders")
def _(t: Tables):
    body = F.concat(F.lit('{"title": "x", "doi": "https://doi.org/'), F.col("o_orderkey").cast("string"), F.lit('", "abstract_inverted_index": {"of": [1], "order": [0], "'), F.lower("o_orderpriority"), F.lit('": [2]}, "concepts": [{"display_name": "kept", "score": 0.5}, {"display_name": "gone", "score": 0.3}]}'))
    got = readers.openalex_records(t.orders.select(body.alias("value")))
    return got.select(F.col("doi").cast("long").alias("o_orderkey"), "abstract", "keywords")


@query("s12_resume", "select c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def _(t: Tables):
    return readers.unread(t.customer.select("c_custkey"), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("s17_page_title", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) as lang from pages")
def _(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("s18_meta_fields", "select page_id, 'Keys, of ' || page_id as raw, 'keys, of ' || page_id as keywords, '10.1234/p' || page_id as doi from pages")
def _(t: Tables):
    k = F.col("page_id").cast("string")
    page = F.concat(F.lit('<meta name="keywords" content="Keys; of '), k, F.lit('"><meta content="https://doi.org/10.1234/p'), k, F.lit('&x=1" name="citation_doi">'), "html")
    return t.pages.select("page_id", F.concat(F.lit("Keys, of "), k).alias("raw"), html.keywords(page).alias("keywords"), html.doi(page).alias("doi"))


@query("s19_doi_in_url", "select page_id, '10.1000/abc.' || page_id as doi from pages")
def _(t: Tables):
    return t.pages.select("page_id", text.doi_in(F.concat(F.lit("https://doi.org/10.1000/abc."), F.col("page_id").cast("string"), F.lit("..&utm=1"))).alias("doi"))


@query("s20_links", """select page_id, len(regexp_extract_all(html, '<a\\b[^>]*\\bhref\\s*=\\s*"([^"]*)"[^>]*>', 1)) as n from pages where contains(html, '<a ')""")
def _(t: Tables):
    return html.links(t.pages.select("page_id", "html")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("s16_list_rows", "select page_id, len(regexp_extract_all(html, '<li\\b')) as n from pages where contains(html, '<li')")
def _(t: Tables):
    return html.rows(t.pages, "list").groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("s21_profile_ids", "select page_id, 'u' || page_id as scholar_id, cast(page_id as varchar) as scopus_id from pages")
def _(t: Tables):
    k = F.col("page_id").cast("string")
    urls = F.array(F.lit("https://scholar.google.com/citations?hl=en&user=old"), F.concat(F.lit("https://scholar.google.co.id/citations?user=u"), k), F.concat(F.lit("https://www.scopus.com/authid/detail.uri?authorId="), k))
    return t.pages.select("page_id", *html.profile_ids(urls)[:2])


@query("v13_neighbour_sample", "select doc_id from (select doc_id from documents order by md5('42:' || doc_id), doc_id limit 50)")
def _(t: Tables):
    return sample_by_hash(t.documents, "doc_id", 50).select("doc_id")


def _staff_pages(t: Tables):
    """A page for each nation with its suppliers in one of the seven layouts, by the nation's number."""
    k = F.format_string("%012d", F.col("s_suppkey"))
    name = F.concat(F.lit("Dr. "), "s_name")
    scholar = F.concat(F.lit("<a href='https://scholar.google.com/citations?hl=en&user=u"), F.col("s_suppkey").cast("string"), F.lit("'>S</a>"))
    cv = F.concat(F.lit("<a href='https://cv.example.ac.id/detail/"), k, F.lit("'>CV</a>"))
    cut = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kinds = [
        cut("<tr><td>1</td><td>", name, "</td><td>NIP ", k, "</td><td>", scholar, "</td></tr>"), cut("<tr><td>1<td>", name, "<td>-<td>", cv, scholar),
        cut("<table class='MsoTableGrid'><tr><td>", name, "</td></tr><tr><td>CV</td><td>", cv, "</td></tr><tr><td>Google Scholar</td><td>", scholar, "</td></tr></table>"),
        cut("<table><tr><td><h4>Profil</h4><h4>", name, "</h4>", cv, scholar, "</td></tr></table>"), cut("<div class='x'><div class='big nama-dosen'>", name, "</div>", cv, scholar, "</div>"),
        cut("<div><h3>", name, "</h3><p>NIP. ", k, "</p>", scholar, "</div>"), cut("<div class='team-card'><h4>", name, "</h4><span><i>", scholar, "</i></span>", cv, "</div>"),
    ]
    layout = F.col("s_nationkey") % len(kinds)
    block = reduce(lambda a, b: a.when(layout == b[0], b[1]), enumerate(kinds), F.when(F.lit(False), ""))
    rows = t.supplier.groupBy("s_nationkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", block.alias("b")))), lambda x: x["b"]), "").alias("body"))
    wrap = F.when(layout < 2, F.concat(F.lit("<table><tr><td>No</td><td>Nama</td><td>NIP</td></tr>"), "body", F.lit("</table>"))).otherwise(F.col("body"))
    return rows.select(F.col("s_nationkey").alias("page_id"), F.concat(F.lit("<html><body><h1>Staff</h1>"), wrap, F.lit("</body></html>")).alias("html"))


@query("s16_layouts", "select s_nationkey as page_id, 'Dr. ' || s_name as name, lpad(cast(s_suppkey as varchar), 12, '0') as nip, 'u' || s_suppkey as scholar_id from supplier")
def _(t: Tables):
    parsed = Table(dom.trees(_staff_pages(t))).df
    found = [dom.people(parsed.where(F.col("page_id") % len(dom.LAYOUTS) == k), layout) for k, layout in enumerate(dom.LAYOUTS)]
    return reduce(lambda a, b: a.unionByName(b), found).select("page_id", "name", "nip", "scholar_id")


#: What stands before each page's own html, by page_id modulo 8, with the keywords "alpha N" and "beta".
_BEFORE = [
    """<script id="__NEXT_DATA__">{"props":{"pageProps":{"data":{"item":{"itemInfo":{"subjects":"Alpha %s; Beta","ab":"%s"}}}}}}</script>""",
    """<dl><dt>Subjects:</dt><dd><a href=x>Alpha %s</a> <a href=y>Beta</a></dd></dl><meta name="citation_abstract" content="%s">""",
    """<script>xplGlobal.document.metadata={"keywords":[{"type":"IEEE","kwd":["no"]},{"type":"Author Keywords","kwd":["Alpha %s","Beta"]}]};</script><div class="x abstract-box">Abstract: %s</div>""",
    """<ul class="c-article-subject-list"><li>Alpha %s</li><li>Beta</li></ul><h2>Abstract</h2><p>%s</p>""",
    """<h3>Keywords</h3><ul><li>Alpha %s</li><li>Beta</li></ul><section id="abstractSection">%s</section>""",
    """<div class="kwd-group"><span class="kwd-text">Alpha %s</span><span class="kwd-text">Beta</span></div><meta property="og:description" content="%s">""",
    """<script type="application/ld+json">{"keywords":["Alpha %s","Beta"]}</script><strong>Abstrak:</strong><div>%s</div>""",
    """<meta name="keywords" content="Alpha %s; Beta"><meta name="description" content="%s">""",
]


@query("s18_page_fields", "select page_id, 'alpha ' || page_id || ', beta' as keywords, 'What page ' || page_id || ' is about, told in more than fifty characters.' as abstract from pages")
def _(t: Tables):
    k = F.col("page_id").cast("string")
    told = F.concat(F.lit("What page "), k, F.lit(" is about, told in more than fifty characters."))
    before = reduce(lambda a, b: a.when(F.col("page_id") % len(_BEFORE) == b[0], F.format_string(b[1], k, told)), enumerate(_BEFORE), F.when(F.lit(False), ""))
    return dom.trees(t.pages.select("page_id", F.concat(before, "html").alias("html"))).select("page_id", dom.keywords().alias("keywords"), dom.abstract().alias("abstract"))


@query("s20_best_pdf", """
with l as (select page_id, row_number() over () as at, u, t from pages, (values (1, '/a.pdf', 'PDF'), (2, '/b', 'Download full-text PDF'), (3, '/c.pdf', 'Citation pdf'), (4, '/interactive.pdf', 'Download pdf'), (5, '/d', 'Full-text')) v(k, u, t) where page_id % k = 0),
s as (select *, case when lower(t) like '%download full-text pdf%' then 10 else 0 end + case when lower(t) like '%download%' then 3 else 0 end + case when lower(t) like '%pdf%' then 3 else 0 end
  + case when lower(u) like '%pdf%' then 5 else 0 end + case when lower(t) like '%full-text%' then 2 else 0 end - case when u like '%interactive%' then 10 else 0 end - case when lower(t) like '%citation%' then 5 else 0 end as score from l)
select page_id, cast(max(score) as int) as score, arg_max(u, score) as url from s where score > 5 group by 1""")
def _(t: Tables):
    k = F.col("page_id")
    links = [(1, "/a.pdf", "PDF"), (2, "/b", "Download <b>full-text</b> PDF"), (3, "/c.pdf", "Citation pdf"), (4, "/interactive.pdf", "Download pdf"), (5, "/d", "Full-text")]
    behind = F.concat("html", *[F.when(k % n == 0, f"<a class=x href='{u}'>{said}</a>").otherwise("") for n, u, said in links])
    return dom.trees(t.pages.select("page_id", behind.alias("html"))).select("page_id", dom.pdf_link().alias("best")).where("best is not null").select("page_id", "best.score", "best.url")


@query("d4_to_utc", """
select event_id, case event_id % 5 when 0 then ts - interval 8 hour when 1 then ts when 2 then ts - interval 7 hour when 3 then date_trunc('second', ts) else null end as utc from events""")
def _(t: Tables):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    k = F.col("event_id") % 5
    seconds = F.floor(time.millis(F.col("ts")) / 1000).cast("string")
    said = F.when(k == 0, iso).when(k == 1, F.concat(iso, F.lit("Z"))).when(k == 2, F.concat(iso, F.lit("+07:00"))).when(k == 3, seconds).otherwise(F.concat(F.lit("on "), iso))
    return t.events.select("event_id", time.to_utc(said).alias("utc"))
