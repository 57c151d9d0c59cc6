"""Composed steps of the publication and people pipelines."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import names, nulls, text
from foliospark.operators import ann
from foliospark.operators.linkage import match_authors
from foliospark.operators.relational import top_per_group
from foliospark.tables import Table


def join_in_order(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """A left join whose rows come out in the left table's order."""
    return left.join(right, key, "left").orderBy(order)


def merge_people_sources(web: DataFrame, other: DataFrame, matches: DataFrame) -> DataFrame:
    """Web rows with what matched rows of another register know. Its number and programme override, its staff id fills.

    web: wpos, nip, nidn, prodi, source. other: rpos, nip, nidn, prodi. matches: wpos, rpos; of several the last row counts.
    Unmatched rows of the other register are left out.
    """
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    o = matches.join(other.withColumnsRenamed({c: f"o_{c}" for c in ("nip", "nidn", "prodi")}), "rpos")
    last = o.groupBy("wpos").agg(*[F.max_by(c, F.when(full(F.col(c)).isNotNull(), F.col("rpos"))).alias(c) for c in ("o_nip", "o_nidn", "o_prodi")])
    tag = F.when(F.col("_hit") & ~F.contains("source", F.lit("+PDDIKTI")), F.concat("source", F.lit("+PDDIKTI"))).otherwise(F.col("source"))
    return web.join(last.withColumn("_hit", F.lit(True)), "wpos", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False))).select(
        "wpos", F.coalesce(full(F.col("nip")), full(F.col("o_nip")), F.lit("")).alias("nip"), F.coalesce(full(F.col("o_nidn")), full(F.col("nidn")), F.lit("")).alias("nidn"),
        F.coalesce(full(F.col("o_prodi")), full(F.col("prodi")), F.lit("")).alias("prodi"), tag.alias("source"),
    )


def resume_ids(now: DataFrame, before: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """Ids that are empty now, from an earlier run's output with the same name."""
    full = lambda c: F.nullif(F.trim(c), F.lit(""))
    old = before.groupBy(F.lower(F.trim(key)).alias("_k")).agg(*[F.max(full(F.col(c))).alias(f"_{c}") for c in ids])
    out = now.join(old, F.lower(F.trim(key)) == F.col("_k"), "left")
    filled = {c: F.coalesce(full(F.col(c)), F.col(f"_{c}"), F.lit("")) for c in ids}
    any_ = F.greatest(*[(full(F.col(c)).isNull() & F.col(f"_{c}").isNotNull()).cast("int") for c in ids], F.lit(0)) == 1
    return out.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in now.columns], F.when(any_, "+RESUME").otherwise("").alias("resumed"))


def best_candidate(candidates: DataFrame, key: str, score: str, least: float = 0.85) -> DataFrame:
    """The candidate with the best score above ``least``, the first of equals. candidates: key, pos, score, ..."""
    rest = [c for c in candidates.columns if c != key]
    return candidates.where(F.col(score) > least).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), "pos")).alias("b")).select(key, "b.*")


def initials_match(left: DataFrame, right: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(rpos, lpos, tier): by name, by initials, by similar name, by similar initials."""
    from foliospark.operators.linkage import _similar_tier, tiered_match

    l_ = left.selectExpr("pos as lpos", "name as lname").withColumn("li", names.initials(F.col("lname")))
    r_ = right.selectExpr("pos as rpos", "name as rname").withColumn("ri", names.initials(F.col("rname")))
    return tiered_match(l_, r_, [
        ("name", F.col("lname"), F.col("rname"), None), ("initials", F.col("li"), F.col("ri"), None),
        ("fuzzy", _similar_tier("lname", "rname", threshold, "lpos", "rpos")), ("fuzzy_initials", _similar_tier("li", "ri", threshold, "lpos", "rpos")),
    ], "lpos", "rpos")


def abbreviated_match(authors: DataFrame, people: DataFrame) -> DataFrame:
    """(author, id): people whose name an author's short form may stand for, met by sorted words or by any long word."""
    keys = lambda c: F.array_distinct(F.concat(F.array(names.signature(c)), F.filter(F.split(c, " "), lambda w: F.length(w) > 2)))
    a = authors.select("author", F.explode(keys(F.col("author"))).alias("k"))
    p = people.select("id", "name", F.explode(keys(F.col("name"))).alias("k"))
    both = a.join(p, "k").select("author", "id", "name").distinct()
    return both.where(names.is_abbreviation(F.col("author"), F.col("name"))).groupBy("author").agg(F.min("id").alias("id"))


def clean_papers(papers: DataFrame, people: DataFrame) -> DataFrame:
    """Titles, abstracts, keywords, ids and authors of papers, cleaned. papers: paper_id, title, abstract, keywords, doi, authors, owner_id."""
    who = match_authors(papers, people)
    base = papers.drop("authors").select(
        "paper_id", text.clean_text(F.col("title")).alias("title"), text.clean_abstract(F.col("abstract")).alias("abstract"),
        text.keywords(F.col("keywords")).alias("keywords"), nulls.clean_id(F.col("doi")).alias("doi"),
    )
    return base.join(who, "paper_id", "left").withColumns({"authors": F.coalesce("authors", F.lit("")), "ids": F.coalesce("ids", F.lit(""))})


def clean_people(people: DataFrame, ids: list[str], name: str) -> DataFrame:
    return people.withColumns({c: nulls.clean_id(F.col(c)) for c in ids if c in people.columns}).where(F.trim(F.coalesce(name, F.lit(""))) != "")


def extract_entities(papers: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(paper_id, key, text, label, source, pos): entities a model found (source 1), titles' terms (2) and keywords (3).

    found: paper_id, text, label, from any recogniser.
    """
    terms = papers.select("paper_id", F.posexplode(text.title_terms(F.col("title"))).alias("at", "text")).withColumns({"label": F.lit("Method"), "source": F.lit(2)})
    words = papers.select("paper_id", F.posexplode(text.parts(F.col("keywords"), "[;,]")).alias("at", "text")).withColumns({"label": F.lit("Field"), "source": F.lit(3)})
    out = terms.unionByName(words)
    if found is not None:
        out = out.unionByName(found.select("paper_id", F.lit(0).alias("at"), "text", text.node_type(F.col("label")).alias("label"), F.lit(1).alias("source")))
    keyed = out.withColumn("key", text.plain(F.col("text"))).where("key <> ''")
    return keyed.select("paper_id", "key", "text", "label", "source", F.struct("paper_id", "source", "at").alias("pos"))


def curated_graph(entities: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and HAS_<LABEL> edges of entities (paper_id, key, text, label) under their resolved keys; unknown labels are Field."""
    e = entities.join(aliases.select("src", "dst"), F.col("key") == F.col("src"), "left").withColumn("key", F.coalesce("dst", "key"))
    e = e.withColumn("label", text.node_type(F.col("label")))
    node = F.concat_ws("_", F.lower("label"), F.md5("key"))
    nodes = e.groupBy(node.alias("node_id"), "label").agg(F.min("text").alias("name"))
    return nodes, e.select(F.col("paper_id").alias("src"), node.alias("dst"), F.concat(F.lit("HAS_"), F.upper("label")).alias("rel")).distinct()


def entity_vectors(sequences: DataFrame, col: str, size: int = 32, seed: int = 42, partitions: int = 4, least: int = 2) -> DataFrame:
    """(word, embedding) by skip-gram over sequences of entities, those of fewer than ``least`` mentions left out.

    Every partition learns by itself in a round and their vectors are put together after it, so there are as many rounds as partitions.
    """
    model = Word2Vec(vectorSize=size, minCount=least, seed=seed, inputCol=col, outputCol="_v", numPartitions=partitions, maxIter=partitions).fit(sequences)
    return model.getVectors().select("word", vector_to_array("vector").alias("embedding"))


def similar_entities(sequences: DataFrame, col: str, k: int = 3, size: int = 32, seed: int = 42, partitions: int = 4) -> DataFrame:
    """(word, other, similarity): the k nearest other entities of every entity that is mentioned twice or more, by skip-gram vectors
    and an inverted file of them (see ``ann``)."""
    v = Table(entity_vectors(sequences, col, size, seed, partitions)).df
    index = ann.build(v.select(F.col("word").alias("chunk_id"), "embedding"))
    asked = v.select(F.col("word").alias("qid"), F.col("embedding").alias("q"))
    others = ann.search(index, asked, k + 1, ann.probes_for(index, asked, k + 1)).where("qid <> chunk_id")
    return top_per_group(others, ["qid"], [F.desc("score"), F.col("chunk_id")], k).select(F.col("qid").alias("word"), F.col("chunk_id").alias("other"), F.col("score").alias("similarity"))


def simple_graph(papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Papers and authors as nodes, AUTHORED_BY edges. papers: paper_id, title, authors by ";"."""
    a = papers.select("paper_id", F.explode(text.parts(F.col("authors"), ";")).alias("author"))
    nodes = papers.select(F.lit("Paper").alias("label"), F.col("paper_id").cast("string").alias("node_id")).unionByName(a.select(F.lit("Author").alias("label"), F.col("author").alias("node_id")))
    return nodes.distinct(), a.select(F.col("paper_id").cast("string").alias("src"), F.lit("AUTHORED_BY").alias("rel"), F.col("author").alias("dst")).distinct()
