"""Hand-made cases for what SQL can't tell, and for the traps."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import names, nulls, text, time, vectors
from foliospark.operators import ann, chunking, community, etl, graph, linkage, outline, relational, retrieval
from foliospark.plans import sqlguard
from foliospark.sources import dom, html, office, readers, sinks
from foliospark.streaming import events


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(("raw", "out"), [("57201351214.0", "57201351214"), (" NaN ", ""), (None, ""), ("v2.0", "v2.0"), ("0012", "0012")])
def test_clean_id(spark, raw, out):
    assert one(spark, nulls.clean_id, raw) == out


def test_clean_id_compat(spark):
    assert one(spark, lambda c: nulls.clean_id(c, strict=False), "v2.0") == "v2"


@pytest.mark.parametrize(("raw", "out"), [("check", None), ("7.0", "7"), ("-inf", None), (None, None)])
def test_identifier(spark, raw, out):
    assert one(spark, nulls.clean_identifier, raw) == out


@pytest.mark.parametrize(
    ("f", "raw", "out"),
    [
        (names.flip, "Doe, Jane A", "Jane A Doe"),
        (names.for_matching, "Prof. Dr. Budi Santoso, S.Kom., M.T.", "budi santoso"),
        (names.without_titles, "Prof. Dr. Ir. Siti Aminah, M.Sc.", "Siti Aminah"),
        (names.normalized, "Dr. José Núñez, M.T.", "jose nunez"),
        (names.initials, "budi adi putra", "b a putra"),
        (text.clean_text, "a&nbsp;&amp; <b>b</b>​ \\n c\n\td ", "a & b c d"),
        (text.clean_abstract, "Abstract—We  test.\nKeywords: a, b", "We test."),
        (text.plain, "Déjà-vu, Again!", "déjàvu again"),
        (text.doi_in, "https://doi.org/10.1000/ab.c..&x=1", "10.1000/ab.c"),
        (text.keywords, "A; b|C,, ", "a, b, c"),
        (text.node_type, "Algorithm", "Method"),
        (text.node_type, "foo", "Field"),
        (text.first_object, 'x ```{"a": {"b": 1}}``` y', '{"a": {"b": 1}}'),
    ],
)
def test_text(spark, f, raw, out):
    assert one(spark, f, raw) == out


def test_counts_and_keys(spark):
    assert one(spark, text.token_count, "a_b 12 知识") == 4
    assert one(spark, text.token_count, " \n") == 0
    assert sorted(one(spark, lambda c: text.trigrams(text.squashed(c)), "ab cd")) == ["abc", "bcd"]
    assert one(spark, lambda c: text.paper_key(c, F.lit("x"), F.lit(2020)), " 10.1/X ") == "6cf2dfbaad7a2f9aca7932c6c15068d3"


def test_index(spark):
    assert one(spark, text.text_of_index, {"deep": [0], "nets": [1, 3], "and": [2]}, "map<string,array<int>>") == "deep nets and nets"


def test_similarity():
    assert names.best_match("budi santoso", "santoso budi")[1:] == (1.0, "token_set")
    assert names.best_match("", "x") == (False, 0.0, "empty")
    assert names.token_set("deep learning", "learning deep nets") == 100
    assert names.abbreviates("b santoso", "budi santoso") and not names.abbreviates("c santoso", "budi santoso")


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b"], ["a"])], "f array<string>, r array<string>")
    p, r = df.select(vectors.precision_at(F.col("f"), F.col("r"), 5), vectors.recall_at(F.col("f"), F.array().cast("array<string>"), 5)).first()
    assert (p, r) == (0.2, 0.0)


def greedy(sets, threshold):
    kept = []
    for k, s in sets:
        if all(len(s & o) / len(s | o) < threshold for _, o in kept if s | o):
            kept.append((k, s))
    return {k for k, _ in kept}


def test_greedy_dedup_is_that_of_the_sequential_pass(spark):
    import random

    rng = random.Random(5)
    rows = [(k, [f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 6))]) for k in range(120)]
    df = spark.createDataFrame([(k, sorted(set(s))) for k, s in rows], "id long, s array<string>")
    pairs = linkage.similar_pairs(df, "id", "s", 0.6)
    brute = {(a, b) for a, x in rows for b, y in rows if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= 0.6}
    assert {(r.a, r.b) for r in pairs.collect()} == brute
    kept = linkage.greedy_keep(df.withColumnRenamed("id", "key"), "key", pairs)
    assert {r.key for r in kept.collect()} == greedy([(k, set(s)) for k, s in rows], 0.6)


def test_greedy_keep_on_a_long_chain(spark):
    """Each row resembles the one before: more rounds are needed than any fixed number."""
    df = spark.range(1, 113).coalesce(1)
    pairs = df.selectExpr("id as a", "id + 1 as b").where("b < 113")
    kept = linkage.greedy_keep(df.withColumnRenamed("id", "key"), "key", pairs)
    assert {r.key for r in kept.collect()} == set(range(1, 113, 2))


def test_dedup_papers(spark):
    rows = [(1, "Deep Nets for Text"), (2, "deep nets FOR text"), (3, "Deep nets for texts"), (4, ""), (5, ""), (6, "Other things entirely")]
    df = spark.createDataFrame(rows, "pos long, title string")
    assert {r.pos for r in linkage.dedup_papers(df, "pos").collect()} == {1, 4, 5, 6}
    assert {r.pos for r in linkage.dedup_papers(df, "pos", compat=True).collect()} == {1, 4, 6}


def test_dedup_publications(spark):
    rows = [(1, "10.1/a", "l1", "T", "2019", None, None), (2, "10.1/A", "l2", "U", "2021", "x", "y"), (3, "", "l2", "V", "2020", None, None), (4, "", "", "W", "2020", None, None), (5, "", "", "w", "2020", None, None)]
    df = spark.createDataFrame(rows, "pos long, doi string, link string, title string, year string, abstract string, keywords string")
    assert sorted(r.pos for r in linkage.dedup_publications(df, "pos").collect()) == [2, 4]


def test_linkage_tiers(spark):
    left = spark.createDataFrame([(1, "budi adi santoso", "n1", "ti"), (2, "siti aminah", "n2", "ti")], "pos long, name string, number string, unit string")
    right = spark.createDataFrame([(1, "siti aminah", "", "ti"), (2, "x", "n1", "ti"), (3, "budi adi santoso putra", "", "ti"), (4, "siti aminahh", "", "si"), (5, "zz", "", "ti")], left.schema)
    got = {r.rpos: (r.lpos, r.tier) for r in linkage.link_people(left, right).collect()}
    assert got == {1: (2, "name"), 2: (1, "number"), 3: (1, "prefix"), 4: (2, "fuzzy")}


def test_aliases(spark):
    a = spark.createDataFrame([("x", "y"), ("y", "z"), ("a", "b"), ("b", "a")], "src string, dst string")
    got = dict(linkage.resolve_aliases(a).collect())
    assert got["x"] == got["y"] == "z" and got["a"] == "a" and got["b"] == "b"


def test_authors(spark):
    people = spark.createDataFrame([(1, "Budi Santoso", "s1"), (2, "Siti Aminah", "s2")], "pos long, name string, id string")
    papers = spark.createDataFrame([(1, "B Santoso; Nobody Else", "s2"), (2, "Aminah, Siti", None)], "paper_id long, authors string, owner_id string")
    got = {r.paper_id: (r.authors, r.ids) for r in linkage.match_authors(papers.where("paper_id = 1"), people).collect()}
    assert got[1] == ("Siti Aminah, Budi Santoso", "s2, s1")
    more = linkage.match_authors(papers.where("paper_id = 1"), people, keep_unmatched=True, sep="; ").first()
    assert more.authors == "Siti Aminah; Budi Santoso; Nobody Else"


def test_merge_people(spark):
    rows = [("ti", 1, "Budi S", "", "n1"), ("ti", 2, "Budi Santoso", "s1", "n1"), ("si", 3, "Budi Santoso", "", "")]
    df = spark.createDataFrame(rows, "unit string, pos long, name string, scholar_id string, number string")
    got = {(r.unit, r.name, r.scholar_id, r.number) for r in linkage.merge_people(df).collect()}
    assert got == {("ti", "Budi Santoso", "s1", "n1"), ("si", "Budi Santoso", "", "")}


def test_upsert_twice_is_upsert_once(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1), (None, "d", 1)], "k long, v string, seq int")
    for _ in range(2):
        sinks.upsert_table(spark, path, new, ["k"], "seq")
        assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "b"), (2, "c")]


def test_triples(spark):
    lines = ['{"h": "A", "r": "KNOWS", "t": "B"}', '{"h": {"name": "C", "age": 30}, "r": {"type": "LIKES", "weight": 0.8}, "t": {"name": "D", "role": "User"}}', "broken", '{"h": "", "r": "x", "t": "y"}']
    nodes, rels = graph.merge_triples(graph.parse_triples(spark.createDataFrame(list(enumerate(lines)), "pos long, value string")))
    assert {r.name: r.props for r in nodes.collect()} == {"A": {}, "B": {}, "C": {"age": "30"}, "D": {"role": "User"}}
    assert {(r.h, r.rel, r.t) for r in rels.collect()} == {("A", "KNOWS", "B"), ("C", "LIKES", "D")}


def test_coauthors_and_pagerank(spark):
    w = spark.createDataFrame([("p", x) for x in "abc"] + [("p", "a")], "p string, x string")
    assert {tuple(r) for r in graph.coauthors(w, "p", "x").collect()} == {("a", "b", 1), ("a", "c", 1), ("b", "c", 1)}
    r = {x.node: x["rank"] for x in graph.pagerank(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src long, dst long"), rounds=40).collect()}
    assert abs(sum(r.values()) - 1) < 1e-9 and r[1] == max(r.values())


def test_retrieval_modes(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "deep nets", "a.md"), (2, [0.8, 0.6], "shallow nets nets", "b.md"), (3, [0.0, 1.0], "trees", "a.md")], "chunk_id long, embedding array<double>, content string, source string")
    q = spark.createDataFrame([(1, [1.0, 0.0], "nets")], "qid long, q array<double>, query string")
    ids = lambda **o: [r.chunk_id for r in retrieval.retrieve(chunks, q, retrieval.Options(**o)).orderBy(F.desc("score")).collect()]
    assert ids(search_mode="vector") == [1, 2]
    assert ids(search_mode="what") == [1, 2]
    assert ids(search_mode="keyword") == [2, 1]
    assert ids(search_mode="hybrid", similarity_threshold=0.95) == []
    assert [r.chunk_id for r in retrieval.retrieve(chunks, q, source_like="a.md").collect()] == [1]


def test_chunk_parameters():
    p = chunking.resolve("book", {"preset": "book", "chunk_token_num": 300}, {"preset": "qa", "delimiter": "###"}, {"preset": "laws", "chunk_token_num": 666, "chunk_size": 777, "content_hashes": 1})
    assert (p["preset"], p["chunk_token_num"], p["delimiter"]) == ("laws", 777, "###") and "content_hashes" not in p


def chunked(spark, content, preset, **params):
    df = spark.createDataFrame([("f", content)], "id string, text string")
    rows = chunking.chunk(df, "id", "text", chunking.resolve(preset, params) | {k: v for k, v in params.items() if k in ("tree", "form")})
    return [r.content for r in rows.orderBy("chunk_index").collect()]


def test_chunkers(spark):
    law = "\n".join(f"Article {i} words and more words of the article number {i}" for i in range(1, 260))
    made = chunked(spark, law, "laws", chunk_token_num=180)
    assert len(made) > 1 and max(map(chunking.tokens, made)) <= 180
    same = chunked(spark, "The same sentence again. " * 120, "laws", chunk_token_num=120)
    assert max(map(chunking.tokens, same)) <= 120
    assert any("Chapter 1" in c for c in chunked(spark, "Chapter 1 One\ntext\nSection 1 A\nmore\nChapter 2 Two\ntext", "book"))
    assert chunked(spark, "# What?\nThis.\n# What?\nThis.", "qa") == ["Question: What?\tAnswer: This."]
    assert chunked(spark, None, "general") == chunked(spark, None, "book") == chunked(spark, " ", "laws") == chunked(spark, None, "qa") == []
    assert chunked(spark, "a`b", "general", delimiter="`b`") == ["a`"]


def family(spark, lines):
    return outline.families(spark.createDataFrame([(1, x) for x in lines], "row long, line string")).first().family


def test_families(spark):
    assert family(spark, ["# A", "## B", "1. x", "2. y, z", "3. a"]) == outline.MARKDOWN
    heads = ["# 3.2 Overview of taxable income items and filing methods", "1. The following rules continue to apply for seasonal or temporary worker deductions.", "2. Under current policy, subsidy income is included in salary income.", "(1) Subsidies paid above the statutory ratio are not tax-exempt benefits."]
    assert family(spark, heads) == outline.MARKDOWN
    inside = ["Based on the previous rule: 1. this is an in-sentence list, not a heading level.", "Continuing above: (2) this is also inline enumeration, not an independent title.", "## 3.4 Tax treatment of transportation allowances"]
    assert family(spark, inside) == outline.MARKDOWN
    assert family(spark, ["nothing here", "0 no number", "12 34 neither"]) == -1
    assert family(spark, ["Chapter I One", "Section 1 A", "Article 2 B"]) == 3


def test_book_outline(spark):
    text = "before\nChapter 1 General Provisions\nSection 1 Scope of Application\nThis specification applies to test scenarios.\nand more\nSection 2 Basic Principles\nChapter II Other\nlast line"
    top = "Chapter 1 General Provisions"
    scope = f"{top}\nSection 1 Scope of Application"
    assert chunked(spark, text, "book") == ["before", f"{scope}\nThis specification applies to test scenarios.", f"{scope}\nand more", "Chapter II Other\nlast line", f"{top}\nSection 2 Basic Principles"]
    toc = "Contents\nChapter 1 One\nChapter 2 Two\nChapter 1 One\ntext of one\nChapter 2 Two\ntext of two"
    assert chunked(spark, toc, "book") == ["Chapter 1 One\ntext of one", "Chapter 2 Two\ntext of two"]
    few = "\n".join(f"# Title {k}" for k in range(3)) + "\n" + "word " * 150
    assert chunked(spark, few, "book") == [f"# Title 2\n{('word ' * 150).strip()}", "# Title 0\n# Title 1"]


def test_law_outline(spark):
    text = "Chapter VI Special Tax Adjustments\nArticle 106 Scenarios where a withholding agent may be designated include:\n(1) direct or indirect control relationships in funding, operations, or procurement;\n(2) the ability to perform other binding actions on behalf of the enterprise.\nArticle 107 Tax authorities may determine taxable income according to law."
    made = [c for c in chunked(spark, text, "laws", chunk_token_num=1000) if "Article 106" in c]
    assert len(made) == 1 and "(1)" in made[0] and "(2)" in made[0] and "Article 107" not in made[0] and made[0].startswith("Chapter VI")
    marked = "## Chapter I General Provisions\n- **Article 1** This law is established to regulate guarantee activities and protect creditor rights.\n- **Article 2** In lending activities, parties may establish guarantees according to law.\n- **Article 3** Guarantee activities shall follow principles of equality, voluntariness, fairness, and good faith."
    made = chunked(spark, marked, "laws", chunk_token_num=120)
    assert [("Article 1" in c, "Article 2" in c, "Article 3" in c) for c in made] == [(True, False, False), (False, True, False), (False, False, True)]
    tree = "# Law\nintro\n## Part\nfirst\n### Deep\nsecond\n## Other\nthird"
    assert chunked(spark, tree, "laws", tree="docx") == ["Law\nintro\nPart\nfirst\nDeep\nsecond", "Law\nintro\nOther\nthird"]


def test_questions(spark):
    md = "# Q1\nans\n## Sub\nmore\n```\n# no heading\n```\n| a | b |\n|---|---|\n| c | d |"
    assert chunked(spark, md, "qa", form="md") == ["Question: Q1\tAnswer: ans", "Question: Q1\nSub\tAnswer: more\n```\n# no heading\n```\n| a | b |\n|---|---|\n| c | d |", "Question: a\tAnswer: b", "Question: c\tAnswer: d"]
    assert chunked(spark, 'x,"a, b"\nstill\ny,z', "qa", form="csv") == ["Question: x\tAnswer: a, b\nstill", "Question: y\tAnswer: z"]
    assert chunked(spark, "x\ty\nz", "qa", form="txt") == ["Question: x\tAnswer: y\nz"]
    assert chunked(spark, "one\ntwo\nthree", "qa") == ["Question: one\tAnswer: two"]


def test_guard(spark):
    assert not sqlguard.is_safe("select 1; drop table x") and not sqlguard.is_safe("") and sqlguard.is_safe("/* x */ select 1")
    assert sqlguard.plan_is_read_only(spark, "select 1") and not sqlguard.plan_is_read_only(spark, "create table x(a int)")
    assert [sqlguard.is_timeout(x) for x in (0, 1, 600, 601, True, "5")] == [False, True, True, False, False, False]
    with pytest.raises(PermissionError):
        sqlguard.run(spark, "drop table x")


def test_cursor(spark):
    log = spark.createDataFrame([("r", f"{ms}-{s}") for ms, s in ((9, 0), (10, 0), (10, 1), (100, 0))], "run_id string, seq string")
    assert [r.seq for r in events.read_after(log, "10-0").collect()] == ["10-1", "100-0"]
    for bad in (None, 0, 5, "12", "bad-value"):
        assert events.read_after(log, bad).count() == 4


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(f"{tmp_path}/in")
    stream = events.windowed_counts(events.from_files(spark, f"{tmp_path}/in", e.schema), late="1 day")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("counts")) == key(events.windowed_counts(e))


def test_runs_end_once(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1, 0, m)
    rows = [("a", t(0), "started"), ("a", t(1), "completed"), ("b", t(0), "started"), ("c", t(2), "failed")]
    spark.createDataFrame(rows, "run_id string, ts timestamp, event_type string").write.parquet(f"{tmp_path}/in")
    stream = events.from_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    q = events.tail(stream).writeStream.format("memory").queryName("ended").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("ended").collect()} >= {("a", "completed", 2), ("c", "failed", 1)}


def test_flushes(spark):
    t = [datetime(2024, 1, 1, 0, 0, 0, k * 30_000) for k in range(6)]
    df = spark.createDataFrame([("r", x, "abc") for x in t], "run_id string, ts timestamp, piece string")
    assert [r.text for r in events.flushes(df, chars=1000, millis=100).orderBy("chunk").collect()] == ["abc" * 5, "abc"]


def test_preamble_and_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Exported 2024\nby "x"\nTitle,Year\n"A, b",2020\nC,2021\n')
    assert sorted(map(tuple, readers.csv_behind_preamble(spark, f"file://{tmp_path}/s.csv", "Title").collect())) == [("A, b", "2020"), ("C", "2021")]
    (tmp_path / "b.csv").write_text("﻿id,name\n007,x\n008,\n")
    assert sorted(map(tuple, readers.csv_text(spark, f"file://{tmp_path}/b.csv").collect())) == [("007", "x"), ("008", "")]
    assert readers.csv_or_empty(spark, f"file://{tmp_path}/none.csv", ["a"]).count() == 0
    (tmp_path / "q.jsonl").write_text('{"query": "a", "gold_chunk_ids": ["1"]}\n{"gold_answer": "x"}\nbroken\n')
    got = readers.json_lines(spark, f"file://{tmp_path}/q.jsonl", "query string, gold_chunk_ids array<string>, gold_answer string", required="query")
    assert got.count() == 1 and tuple(readers.benchmark_flags(got).first()) == (1, True, False)
    with pytest.raises(PermissionError):
        readers.triple_lines(spark, "/etc/x")


def test_pages(spark):
    page = '<meta name="citation_doi" content="doi:10.1/x"><table><tr><th>T</th><th>C</th><th>Y</th></tr><tr><td>Nets &amp; co</td><td>12*</td><td>2020</td></tr></table><a href="/paper.pdf">PDF</a><a href="/cite">download</a>'
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    assert [tuple(r) for r in html.profile_papers(df).orderBy("year").collect()] == [(1, "T", 0, 0), (1, "Nets & co", 12, 2020)]
    assert html.best_pdf_link(html.links(df)).first().url == "/paper.pdf"


def test_small_relational(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "y", 3), ("b", "", 4)], "k string, v string, pos long")
    assert dict(relational.mode_or_first(df, ["k"], "v", "pos").collect()) == {"a": "y", "b": None}
    assert relational.keep_first(df, ["v"], ["pos"]).count() == 3
    assert relational.pick(df, ["POS"]) == "pos" and relational.pick(df, ["nothing"]) is None


def test_long_chains_are_followed_to_the_end(spark):
    chain = [(f"k{n:03}", f"k{n + 1:03}") for n in range(100)]
    cycle = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "d")]
    got = dict(linkage.resolve_aliases(spark.createDataFrame(chain + cycle, "src string, dst string")).collect())
    assert all(got[s] == "k100" for s, _ in chain) and {k: got[k] for k in "abcd"} == {"a": "b", "b": "b", "c": "c", "d": "d"}
    tree = [(n, n - 1 if n else None, f"f{n}") for n in range(60)]
    out = graph.tree_paths(spark.createDataFrame(tree, "id long, parent_id long, name string")).collect()
    assert len(out) == 60 and max(r.level for r in out) == 59


def test_table_is_replaced_by_rows_read_from_it(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    for n in (1, 2):
        sinks.upsert_table(spark, path, spark.createDataFrame([(k, f"v{n}", n) for k in range(n, n + 3)], "k long, v string, at long"), ["k"], "at")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "v1"), (2, "v2"), (3, "v2"), (4, "v2")]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_csv_keeps_lines_that_repeat_the_preamble(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Export\nTitle,Year\nA,1\nTitle,Year\nExport\n")
    assert sorted(map(tuple, readers.csv_behind_preamble(spark, f"file://{tmp_path}/s.csv", "Title").collect())) == [("A", "1"), ("Export", ""), ("Title", "Year")]


def test_inverted_file(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 16))
    rows = [(k, [float(x) for x in middles[k % 12] + rng.normal(size=16) * 0.4], "n") for k in range(1200)]
    rows += [(2000, None, "null"), (2001, [0.0] * 16, "zero"), (2002, [1.0, 2.0], "short")]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, name string")
    queries = chunks.where("chunk_id % 50 = 0 and chunk_id < 1200").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("q"))
    index = ann.build(chunks)
    assert index.table.df.count() == 1200 and index.cells <= 34
    exact = {(r.qid, r.chunk_id): r.score for r in retrieval.dense(chunks.where("chunk_id < 1200"), queries, 10).collect()}
    assert {(r.qid, r.chunk_id): r.score for r in ann.search(index, queries, 10, index.cells).collect()} == exact
    probes = ann.probes_for(index, queries, 10)
    found = {(r.qid, r.chunk_id) for r in ann.search(index, queries, 10, probes).collect()}
    assert probes < index.cells and len(found & set(exact)) >= 0.9 * len(exact)
    curve = ann.recall_curve(index, queries, 10)
    assert curve == sorted(curve) and curve[-1] == 1.0
    nodes = chunks.where("chunk_id < 1200").select(F.col("chunk_id").alias("node_id"), "name", F.array(F.lit("Upload")).alias("labels"), "embedding")
    assert {r.name for r in ann.node_search(nodes, queries, threshold=0.99).collect()} == {"n"}
    with pytest.raises(ValueError):
        ann.build(chunks.where("embedding is null"))


def brute_modularity(edges, of):
    total, inside, degree = 0, 0, {}
    for a, b, w in edges:
        total += 2 * w
        inside += 2 * w * (of[a] == of[b])
        for x in (a, b):
            degree[of[x]] = degree.get(of[x], 0) + w
    return inside / total - sum(d * d for d in degree.values()) / total**2


def test_louvain(spark):
    rng = random.Random(5)
    edges = [(10 * g + i, 10 * g + j, 3) for g in range(4) for i in range(8) for j in range(i) if rng.random() < 0.8] + [(10 * g, (10 * g + 10) % 40, 1) for g in range(4)] + [(3, 3, 2)]
    df = spark.createDataFrame(edges, "src long, dst long, weight long")
    of = {r.node: r.community for r in community.louvain(df).collect()}
    assert of == {x: x // 10 * 10 for e in edges for x in e[:2]}
    assert community.modularity(df, spark.createDataFrame(list(of.items()), "node long, community long")).first()[0] == pytest.approx(brute_modularity(edges, of))
    mixed = {x: x % 3 for x in of}
    assert community.modularity(df, spark.createDataFrame(list(mixed.items()), "node long, community long")).first()[0] == pytest.approx(brute_modularity(edges, mixed))
    assert community.louvain(df.where("src < 0")).count() == 0


def odd_names(n, seed):
    rng = random.Random(seed)
    parts = ["budi", "adi", "siti", "aminah", "santoso", "putra", "dewi", "sri", "agus", "rahmat", "hidayat", "nur"]
    out = set()
    while len(out) < n:
        name = " ".join(rng.sample(parts, rng.choice((1, 2, 2, 3, 4))))
        for _ in range(rng.choice((0, 0, 1, 2))):
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice(["", "x", name[k] * 2]) + name[k + 1 :]
        out.add(name.strip())
    return sorted(out - {""}) + ["a", "ab", "abc", "abcd", "ba"]


@pytest.mark.parametrize(("threshold", "letter"), [(0.85, True), (0.75, False), (0.6, False)])
def test_similar_names(spark, threshold, letter):
    left, right = odd_names(150, 1), odd_names(150, 2)
    want = {(a, b) for a in left for b in right if (not letter or a[0] == b[0]) and names.SequenceMatcher(None, a, b).ratio() >= threshold}
    table = lambda xs: spark.createDataFrame([(x, x[0] if letter else "") for x in xs * 2], "name string, letter string")
    assert {(r.lname, r.rname) for r in linkage.similar_names(table(left), table(right), threshold, ["letter"]).collect()} == want


def test_fuzzy_tiers(spark):
    left, right = [*odd_names(120, 3), "zaki budi adi"], [*odd_names(120, 4), "zaki budi adi putra"]
    df = lambda xs: spark.createDataFrame(list(enumerate(xs)), "pos long, name string").withColumns({"number": F.lit(""), "unit": F.lit("u")})
    want = {}
    for r, b in enumerate(right):
        words = len(b.split())
        begins = [k for k, a in enumerate(left) if min(words, len(a.split())) >= 3 and (a.startswith(b) or b.startswith(a))]
        best = max(((names.SequenceMatcher(None, a, b).ratio(), -k) for k, a in enumerate(left) if a[0] == b[0]), default=(0, 0))
        if b in left:
            want[r] = (left.index(b), "name")
        elif begins:
            want[r] = (begins[0], "prefix")
        elif best[0] >= 0.85:
            want[r] = (-best[1], "fuzzy")
    assert {r.rpos: (r.lpos, r.tier) for r in linkage.link_people(df(left), df(right)).collect()} == want
    assert {t for _, t in want.values()} == {"name", "prefix", "fuzzy"}


def one_pass(rows, threshold=0.75):
    import pandas as pd

    part = pd.DataFrame(rows, columns=["unit", "pos", "name", "scholar_id", "number"]).assign(rid=range(len(rows)))
    return sorted((tuple(r) for _, g in part.groupby("unit") for r in linkage._merged(g, threshold).itertuples(index=False)), key=str)


def test_merge_people_is_the_sequential_pass(spark):
    rng = random.Random(9)
    rows = []
    for k, name in enumerate(odd_names(120, 7) * 2):
        rows.append((rng.choice(["ti", "si", "tk"]), k, name, rng.choice(["", "", "s" + str(rng.randrange(30))]), rng.choice(["", "", "n" + str(rng.randrange(60))])))
    df = spark.createDataFrame([*rows, (None, 900, "budi", "s1", ""), (None, 901, "budi", "s1", "")], "unit string, pos long, name string, scholar_id string, number string")
    got = linkage.merge_people(df).collect()
    assert sorted((tuple(r) for r in got if r.unit), key=str) == one_pass(rows)
    assert sorted(r.pos for r in got if not r.unit) == [900, 901]
    assert linkage.merge_people(df.where("pos < 0")).count() == 0


def test_synonyms(spark):
    groups = spark.createDataFrame([(1, "Neural Net", "NN"), (1, "Neural Net", "neural network"), (2, "Deep Net", " Neural  NETWORK"), (3, "Alone", "alone"), (4, "Java", "Bali"), (5, None, "x"), (6, "SVM", "support vector machine")], "group_id int, canonical string, member string")
    entities = spark.createDataFrame([("neural net", "Method", 5), ("deep net", "Method", 9), ("java", "Tool", 2), ("bali", "Place", 1)], "key string, label string, n long")
    got = dict(linkage.synonym_aliases(groups, entities).collect())
    assert got == {"nn": "deep net", "neural network": "deep net", "neural net": "deep net", "support vector machine": "svm"}


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(501, 530)]
    root = {x: x for p in pairs for x in p}
    for _ in root:
        if all(root[a] == root[b] for a, b in pairs):
            break
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(community.components(spark.createDataFrame(pairs, "u long, v long")).df.collect())
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}
    assert community.components(spark.createDataFrame([], "u long, v long")).df.count() == 0


def zipped(**parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


WORD_FILE = dict(
    word__styles_xml='<w:styles xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:style w:styleId="berschrift1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="Own"><w:name w:val="Own"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style></w:styles>',
    word__document_xml='<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    + "".join(f'<w:p><w:pPr>{f'<w:pStyle w:val="{style}"/>' if style else ""}{"<w:numPr/>" if n else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' for style, text, n in [("berschrift1", "Law &amp; order", 0), ("", "intro", 0), ("Own", "Part one", 0), ("", "item", 1), ("Heading3", "Deep", 0), ("", "", 0)])
    + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b|c</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
)


def test_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(zipped(**WORD_FILE))
    book = {
        "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>name</t></si><si><r><t>val</t></r><r><t>ue</t></r></si></sst>',
        "xl/worksheets/s1.xml": '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="C2"><v>2.5</v></c></row></sheetData></worksheet>',
    }
    import zipfile

    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        for name, text in book.items():
            z.writestr(name, text)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.HTML").write_text("<html><head><title>no</title><style>x{}</style></head><body><h2>Head <i>line</i></h2><p>one<br>two</p><ul><li>a</li></ul><table><tr><th>k</th><td>v</td></tr></table></body></html>")
    (tmp_path / "d.csv").write_text('n,t\n1,"a, b"\n2,c\n')
    (tmp_path / "e.json").write_text('{"a": "é"}')
    (tmp_path / "f.docx").write_bytes(b"broken")
    (tmp_path / "g.xyz").write_bytes(b"x")
    (tmp_path / "h.txt").write_text("\ufeff")
    got = {r.path.rsplit("/", 1)[1]: r for r in office.documents(spark, f"file://{tmp_path}").collect()}
    assert got["a.docx"].markdown == "# Law & order\n\nintro\n\n## Part one\n\n- item\n\n### Deep\n\n| a | b\\|c |\n| --- | --- |\n| 1 |  |"
    assert got["b.xlsx"].markdown == "## One\n\n| name |  | value |\n| --- | --- | --- |\n| x |  | 2.5 |\n\n## Empty"
    assert got["c.HTML"].markdown == "no\n\n## Head line\n\none\n\ntwo\n\n- a\n\n| k | v |\n| --- | --- |"
    assert got["d.csv"].markdown == "| n | t |\n| --- | --- |\n| 1 | a, b |\n\n| n | t |\n| --- | --- |\n| 2 | c |"
    assert got["e.json"].markdown == '```json\n{\n  "a": "é"\n}\n```'
    assert got["f.docx"].markdown is None and "Zip" in got["f.docx"].error and "unsupported" in got["g.xyz"].error and got["h.txt"].markdown == ""
    tree = outline.law_chunks(office.documents(spark, f"file://{tmp_path}/a.docx"), "path", "markdown", chunking.resolve("laws") | {"tree": "docx"})
    assert [r.content for r in tree.orderBy("chunk_index").collect()] == ["Law & order\nintro\nPart one\n- item\nDeep\n| a | b\\|c |\n| --- | --- |\n| 1 |  |"]


def test_csv_across_splits(spark, tmp_path):
    """Records of several lines across splits of some 300 bytes, in files with preambles and headers of their own."""
    import csv
    import io

    rng = random.Random(6)
    want = []
    for k, (names, preamble) in enumerate([(["Title", "Year", "Note"], 'Exported "by\nhand\n'), (["Title", "Note", "Extra"], ""), (["Title", "Year", "Note"], "\n\n")]):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL if k == 1 else csv.QUOTE_MINIMAL)
        writer.writerow(names)
        for i in range(120):
            row = {n: "".join(rng.choice('ab ,"\n;é') for _ in range(rng.randrange(1, 400 if i % 40 == 0 else 20))).strip() or "x" for n in names}
            writer.writerow([row[n] for n in names])
            want.append({"Title": "", "Year": "", "Note": "", "Extra": ""} | row)
        (tmp_path / f"f{k}.csv").write_text(preamble + out.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = [r.asDict() for r in readers.csv_behind_preamble(spark, f"file://{tmp_path}/*.csv", "Title").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    order = lambda xs: sorted(xs, key=lambda r: repr(sorted(r.items())))
    assert order(got) == order(want)
    (tmp_path / "none.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="1 file"):
        readers.csv_behind_preamble(spark, f"file://{tmp_path}/*.csv", "Title")


def test_lookups(spark):
    papers = spark.createDataFrame([(1, "10.1/a", "x"), (2, "", "The deep nets of text"), (3, None, "unknown title")], "paper_id long, doi string, title string")
    landed = spark.createDataFrame([("10.1/A", "by doi"), ("", "Deep nets of text"), ("", "a deep nets of texts")], "doi string, title string")
    got = {r.paper_id: r.hit and r.hit.title for r in readers.lookup_by_doi_then_title(papers, landed).collect()}
    assert got == {1: "by doi", 2: "Deep nets of text", 3: None}
    hits = spark.createDataFrame([(2, 1, "The deep nets"), (2, 2, "THE DEEP NETS, of text!"), (2, 3, "The deep nets of text"), (3, 4, "unknown title")], "paper_id long, rank int, title string")
    got = {r.paper_id: (r.hit and r.hit.rank, r.score) for r in readers.best_of_hits(papers, hits).collect()}
    assert got == {1: (None, None), 2: (2, 1.0), 3: (None, None)}


@pytest.mark.parametrize(("raw", "utc"), [("2024-01-05T10:00:00", "2024-01-05 02:00:00"), ("2024-01-05 10:00:00.5+01:00", "2024-01-05 09:00:00.500000"), ("2024-01-05T10:00Z", "2024-01-05 10:00:00"), ("2024-01-05", "2024-01-04 16:00:00"), ("0", "1970-01-01 00:00:00"), ("1704448800.25", "2024-01-05 10:00:00.250000"), ("2024-13-45", None), ("soon", None), (None, None)])
def test_to_utc(spark, raw, utc):
    got = one(spark, time.to_utc, raw)
    assert (None if got is None else str(got)) == utc


def test_distances(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (4, 5), (6, 7), (1, 3)], "src long, dst long")
    seeds = spark.createDataFrame([(1,), (5,), (6,), (1,), (None,)], "node long")
    got = {(r.seed, r.node): (r.distance, r.via) for r in graph.distances(edges, seeds, 3).df.collect()}
    assert got == {(1, 1): (0, None), (1, 2): (1, 1), (1, 3): (1, 1), (1, 4): (2, 3), (1, 5): (3, 4), (5, 5): (0, None), (5, 4): (1, 5), (5, 3): (2, 4), (5, 2): (3, 3), (5, 1): (3, 3), (6, 6): (0, None), (6, 7): (1, 6)}
    assert sorted(map(tuple, graph.clue_subgraph(edges, seeds, 3).collect())) == [(1, 5, 1, 5, 4), (1, 5, 2, 4, 3), (1, 5, 3, 3, 1)]


def test_greedy_keep_is_the_sequential_pass(spark):
    rng = random.Random(2)
    pairs = sorted({tuple(sorted((rng.randrange(80), rng.randrange(80)))) for _ in range(160)})
    kept = []
    for k in range(80):
        if not any((a, k) in pairs for a in kept):
            kept.append(k)
    df = spark.range(80)
    assert sorted(r.id for r in linkage.greedy_keep(df, "id", spark.createDataFrame(pairs, "a long, b long")).collect()) == kept


def test_trees(spark):
    page = '<div id=a><p>One <b>two</b><p>three</div><script id="s">x < y</script><ul><li>a<li>b</ul><br>end'
    row = dom.trees(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).where("page_id = 1")
    els = row.first().els
    assert row.first().text == "One two three a b end" and [(e.tag, e.last, e.parent) for e in els] == [("div", 3, -1), ("p", 2, 0), ("b", 2, 1), ("p", 3, 0), ("script", 4, -1), ("ul", 7, -1), ("li", 6, 5), ("li", 7, 5), ("br", 8, -1)]
    assert row.select(F.transform("els", dom.said).alias("t")).first().t == ["One two three", "One two", "two", "three", "", "a b", "a", "b", ""]
    assert els[4].raw == "x < y"


@pytest.mark.parametrize(("page", "found"), [("<p>Keywords: Deep Nets; text mining. Introduction</p>", "deep nets, text mining"), ("<p>The keywords in this study were chosen by all of the students here.</p>", ""), ("<div class='keywords-section'>Keywords <span class=keyword>A b</span><span class=keyword>C d</span></div>", "a b, c d"), (None, "")])
def test_page_keywords(spark, page, found):
    assert dom.trees(spark.createDataFrame([(1, page)], "page_id long, html string")).select(dom.keywords().alias("k")).first().k == found


def test_similar_entities(spark):
    rng = random.Random(3)
    topics = [[f"a{k}" for k in range(6)], [f"b{k}" for k in range(6)]]
    rows = [(rng.sample(rng.choice(topics), 4),) for _ in range(600)] + [(["once", "a1"],)]
    got = etl.similar_entities(spark.createDataFrame(rows, "w array<string>"), "w").collect()
    assert {r.word for r in got} == set(topics[0] + topics[1]) and all(sum(x.word == r.word for x in got) == 3 and r.other != r.word for r in got)
    assert sum(r.word[0] == r.other[0] for r in got) >= 0.9 * len(got)


def test_abbreviations_of_digits(spark):
    """A number in a short form may be longer than the word it stands for."""
    df = spark.createDataFrame([(1, "LARGE (N10033)"), (2, "STANDARD (N5)"), (3, "W3C (World Wide Web)"), (4, "Long Short (LS)")], "id int, x string")
    of = lambda c: {r.id: (r.short, r.long) for r in df.select("id", F.get(c, F.lit(0)).alias("p")).select("id", "p.*").collect()}
    told = of(text.abbreviations(F.col("x")))
    assert told == {1: ("N10033", "LARGE"), 2: ("N5", "STANDARD"), 3: ("W3C", "World Wide Web"), 4: ("LS", "Long Short")}
    assert of(text.abbreviations(F.col("x"), compat=True))[1] == ("LARGE", "N10033")
    assert {(r.src, r.dst) for r in linkage.abbreviation_aliases(df, "id", "x").collect()} == {("n10033", "large"), ("n5", "standard"), ("w3c", "world wide web"), ("ls", "long short")}


def _against_sql(spark, tmp_path, name, **tables):
    """Whether a query gives its SQL's rows over tables that are made here."""
    import duckdb

    from foliospark import queries as q

    con = duckdb.connect()
    for table, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = q.QUERIES[name](spark, str(tmp_path))
    made = con.execute(f"select {', '.join(df.columns)} from ({q.SQL[name].strip()})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr) == sorted(made, key=repr)


def test_best_per_row_with_large_keys(spark, tmp_path):
    """A cent more doesn't outweigh a key that is greater by over ten million; rows without a price are never the best."""
    rows = [(1, 10, 1, 100.01), (1, 9_000_000, 1, 100.02), (2, 5, 1, 100.0), (2, 6, 1, 100.5), (3, 7, 1, None), (3, 8, 1, 1.0), (4, 9, 1, None)]
    lines = spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_extendedprice double")
    assert _against_sql(spark, tmp_path, "w3_best_per_row", lineitem=lines)


def test_author_edges_of_shared_names(spark):
    """An author is one person, whoever else has the name; the id goes before the name."""
    people = spark.createDataFrame([("7", "Budi", "A"), ("8", "Budi", "A"), ("", "Budi", "B"), ("", "Siti", "B")], "id string, name string, unit string")
    rows = [("one", "Budi; Siti; Ani", "8; ; 3"), ("two", "Budi", ""), ("three", "Siti; Budi", "7; 9")]
    df = spark.createDataFrame(rows, "title string, authors string, author_ids string")
    papers = df.withColumns({"year": F.lit("2020"), "journal": F.lit(""), "keywords": F.lit("")})
    nodes, edges = graph.backbone(papers, people)
    written = edges.where("rel = 'WRITES'").join(nodes.select(F.col("node_id").alias("dst"), "name"), "dst")
    got = sorted((r.name, r.src[:7]) for r in written.collect())
    assert [n for n, _ in got] == ["one", "one", "three", "three", "two"] and ("one", "dosen_8") in got and ("three", "dosen_7") in got
    assert edges.where("rel = 'WRITES'")._jdf.queryExecution().analyzed().toString().count("posexplode") == 1


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_is_the_pairwise_search(spark, kind):
    """Products of matrices give the rows of pairwise scores: copies, zeros, odd vectors and ties among them, near and far."""
    r = np.random.default_rng(3)
    base = r.normal(size=(60, 8)).round(1).tolist()
    odd = [None, [0.0] * 8, [1.0] * 7, [None] + [1.0] * 7, [float("nan")] * 8, [1e-200] * 8, [float("inf")] + [1.0] * 7]
    vectors_ = base + base[:5] * 9 + odd + r.normal(size=(20, 8)).tolist()
    rows = [(k if kind == "long" else f"k{k * 7 % 100}", v) for k, v in enumerate(vectors_)]
    chunks = spark.createDataFrame(rows, f"chunk_id {kind}, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(k, v) for k, v in enumerate(base[:6] + odd)], "qid int, q array<double>")
    pairs = retrieval.scores(chunks, asked)
    for far in (False, True):
        order = F.col("score") if far else F.desc("score")
        want = relational.top_per_group(pairs, ["qid"], [order, F.col("chunk_id")], 7)
        got = retrieval.nearest(chunks, asked, 7, farthest=far)
        told = lambda d: sorted((r.qid, str(r.chunk_id), repr(r.score)) for r in d.select("qid", "chunk_id", "score").collect())
        assert told(got) == told(want)


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 7)
    monkeypatch.setattr(retrieval, "ROWS", 16)
    monkeypatch.setattr(retrieval, "ASKED", 3)
    r = np.random.default_rng(4)
    chunks = spark.createDataFrame(list(enumerate(r.normal(size=(300, 5)).tolist())), "chunk_id int, embedding array<float>")
    asked = chunks.where("chunk_id % 15 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("q"))
    want = relational.top_per_group(retrieval.scores(chunks, asked), ["qid"], [F.desc("score"), F.col("chunk_id")], 4)
    assert sorted(map(tuple, retrieval.dense(chunks, asked, 4).collect())) == sorted(map(tuple, want.collect()))


def test_bm25_of_many_equal_queries(spark, monkeypatch):
    """Queries of the same terms are scored once, and there may be more of them than are broadcast."""
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 5)
    chunks = spark.createDataFrame([(k, f"a b{k % 3} c{k}") for k in range(12)], "chunk_id int, content string")
    asked = spark.createDataFrame([(k, ["b1 a", "A b1", f"c{k}"][k % 3]) for k in range(12)], "qid int, query string")
    got = {}
    for row in retrieval.bm25(chunks, asked, 3).collect():
        got.setdefault(row.qid, []).append((row.chunk_id, round(row.score, 9)))
    assert len(got) == 12 and all(sorted(got[k]) == sorted(got[0]) for k in (1, 3, 4)) and [c for c, _ in got[2]] == [2]


def test_matched_by_keys(spark):
    """The same as from pairs: several rows of an id, of one key or several, null keys, and a later tier."""
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (2, "c", "y"), (3, None, "x"), (4, "d", "z"), (5, "b", "z"), (5, "b", "z")], "lid int, k string, m string")
    right = spark.createDataFrame([(10, "a", "x"), (11, "a", "x"), (12, "b", "x"), (12, "c", "q"), (13, None, "y"), (12, "b", "w")], "rid int, rk string, rm string")
    pairs = [left.join(right, F.col(a) == F.col(b)).select("lid", "rid") for a, b in (("k", "rk"), ("m", "rm"))]
    want = linkage.matched_with_ambiguity(left, [("one", 9, pairs[0]), ("two", 5, pairs[1])])
    got = linkage.matched_by_keys(left, right, [("one", 9, F.col("k"), F.col("rk")), ("two", 5, F.col("m"), F.col("rm"))])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("strategy = 'one'").count() == 4


def test_alike_in_is_every_pair(monkeypatch):
    """No pair of names whose ratio reaches the threshold is lost: any lengths, over 64 characters too, more than 255 characters in use, and few at once."""
    monkeypatch.setattr(linkage, "PRODUCT", 50)
    r = random.Random(8)
    base = ["".join(r.choices("abcdef ", k=r.randint(1, 30))) for _ in range(60)] + ["".join(chr(r.randint(600, 1200)) for _ in range(12)) for _ in range(30)]
    base += ["".join(r.choices("abcdefgh", k=k)) for k in (63, 64, 65, 90, 130)]
    near = ["".join(c if r.random() > 0.12 else r.choice("abcxyz") for c in x) or "a" for x in base]
    for t in (0.6, 0.75, 0.85):
        found = set(linkage.alike_in(base, near, t))
        want = {(i, j) for i, x in enumerate(base) for j, y in enumerate(near) if names.SequenceMatcher(None, x, y).ratio() >= t}
        assert want <= found and len(found) < len(base) * len(near) / 4


def test_similar_names_of_parts(spark, monkeypatch):
    """A table's own pairs come once, whatever the number of parts and groups."""
    monkeypatch.setattr(linkage, "NAMES", 4)
    monkeypatch.setattr(linkage, "BUCKETS", 2)
    r = random.Random(9)
    rows = sorted({(u, "".join(r.choices("abc", k=r.randint(3, 8)))) for u in "xyz" for _ in range(40)})
    got = [(x.unit, x.lname, x.rname) for x in linkage.similar_names(spark.createDataFrame(rows, "unit string, name string"), None, 0.75, ["unit"], either=True).collect()]
    both = lambda x, y: max(names.SequenceMatcher(None, x, y).ratio(), names.SequenceMatcher(None, y, x).ratio())
    assert sorted(got) == sorted((u, x, y) for u, x in rows for v, y in rows if u == v and x < y and both(x, y) >= 0.75)


def test_similar_pairs_is_every_pair(spark, monkeypatch):
    """Items of many sets, which meet in parts, and items that most sets have; any types of ids."""
    monkeypatch.setattr(linkage, "PART", 7)
    monkeypatch.setattr(linkage, "TILE", 3)
    r = random.Random(10)
    base = [r.sample(range(60), r.randint(1, 25)) for _ in range(40)]
    sets = base + [[x for x in s if r.random() > 0.1] + r.sample(range(60), 1) for s in base for _ in range(3)] + [[1, 2, 3]] * 9 + [[1000 + k] for k in range(5)]
    rows = [(f"k{k}", [f"i{x}" for x in s]) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id string, s array<string>").repartition(3)
    jaccard = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    for t in (0.8, 0.5):
        want = {(a, b): round(jaccard(x, y), 9) for a, x in rows for b, y in rows if a < b and x and y and jaccard(x, y) >= t}
        got = [(p.a, p.b, round(p.score, 9)) for p in linkage.similar_pairs(df, "id", "s", t).collect()]
        assert len(got) == len(want) and {(a, b): v for a, b, v in got} == want


def test_match_authors_once_a_name(spark):
    """A name is matched once, wherever it stands: by the first person, the owner first and once, lost owners left out."""
    people = spark.createDataFrame([(2, "7", "Budi Santoso"), (1, "8", "Dr. Budi Santoso"), (3, "9", "Siti Aminah")], "pos int, id string, name string")
    papers = spark.createDataFrame([(1, "Budi Santoso; S Aminah; Ani", "9"), (2, "Santoso; S Aminah", None), (3, "Budi Santoso", "none"), (4, "", "7"), (5, None, None)], "paper_id int, authors string, owner_id string")
    got = {r.paper_id: (r.authors, r.ids) for r in linkage.match_authors(papers, people).collect()}
    assert got == {1: ("Siti Aminah, Dr. Budi Santoso", "9, 8"), 2: ("Siti Aminah", "9"), 3: ("Dr. Budi Santoso", "8"), 4: ("Budi Santoso", "7")}
    kept = {r.paper_id: (r.authors, r.ids) for r in linkage.match_authors(papers, people, keep_unmatched=True).collect()}
    assert kept[1] == ("Siti Aminah, Dr. Budi Santoso, Ani", "9, 8, ") and kept[2] == ("Santoso, Siti Aminah", ", 9")
    plan = linkage.match_authors(papers, people)._jdf.queryExecution().optimizedPlan().toString()
    assert "prof" not in plan.split("Aggregate")[0]


def test_search_in_cells_has_no_plan_for_each_query(spark, monkeypatch):
    """Queries meet the cells they name in one pass, however many cells: the plan doesn't grow with queries times cells."""
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 50)
    r = np.random.default_rng(6)
    chunks = spark.createDataFrame(list(enumerate(r.normal(size=(200, 4)).tolist())), "chunk_id int, embedding array<double>")
    index = ann.build(chunks, cells=8)
    asked = chunks.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("qid"), F.col("embedding").alias("q"))
    assert ann.search(index, asked, 3, 7)._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    near = {r.qid: set(r.c) for r in asked.select("qid", F.slice(index.nearest_cells(F.col("q")), 1, 2).alias("c")).collect()}
    cell = {r.chunk_id: r.cell for r in index.table.df.collect()}
    want = relational.top_per_group(retrieval.scores(chunks, asked).where(F.udf(lambda q, c: cell[c] in near[q], "boolean")("qid", "chunk_id")), ["qid"], [F.desc("score"), F.col("chunk_id")], 3)
    assert sorted(map(tuple, ann.search(index, asked, 3, 2).collect())) == sorted(map(tuple, want.collect()))


def test_label_propagation_by_rounds(spark, monkeypatch):
    """The first round, which needs no votes, gives what votes give; loops, parallel edges and both directions; and no edges are kept in checkpoints."""
    monkeypatch.setattr(graph, "cut", None)
    r = random.Random(11)
    rows = [(r.randrange(30), r.randrange(30)) for _ in range(70)] + [(40, 40), (41, 42), (42, 41)]
    near = {}
    for a, b in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    labels = {x: x for x in near}
    edges = spark.createDataFrame(rows, "src int, dst int")
    for k in range(4):
        assert {x.node: x.community for x in graph.label_propagation(edges, k).collect()} == labels
        votes = {x: [labels[y] for y in ys] for x, ys in near.items()}
        labels = {x: min(set(v), key=lambda c: (-v.count(c), c)) for x, v in votes.items()}


def test_modularity_of_loops(spark):
    df = spark.createDataFrame([(1, 2, 3), (2, 1, 1), (2, 3, 2), (4, 4, 5), (3, 4, 1), (5, 5, 0), (None, 1, 9)], "src int, dst int, weight int")
    of = {1: 1, 2: 1, 3: 3, 4: 3}
    got = community.modularity(df, spark.createDataFrame(list(of.items()), "node int, community int")).first()[0]
    assert abs(got - brute_modularity([(1, 2, 3), (2, 1, 1), (2, 3, 2), (4, 4, 5), (3, 4, 1)], of)) < 1e-12
