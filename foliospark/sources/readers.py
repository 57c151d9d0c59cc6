"""Tables from CSV, JSON lines, text exports and landed provider answers. Schemas are given; ids stay text."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import text as tx
from foliospark.tables import Table


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def all_text(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def csv_text(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """All columns as text, empty where they were null. Names come from the file, free of a byte order mark."""
    df = spark.read.schema(all_text(names)).option("enforceSchema", False).csv(path, header=True, multiLine=True, escape='"') if names else spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    return df.toDF(*[c.removeprefix("\ufeff") for c in df.columns]).fillna("")


def csv_or_empty(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """As csv_text; a source that isn't there has no rows."""
    return csv_text(spark, path) if exists(spark, path) else spark.createDataFrame([], all_text(names))


def csv_behind_preamble(spark: SparkSession, path: str, first: str, lines: int = 30) -> DataFrame:
    """CSV files in each of which the header, a line that starts with ``first``, stands among the first lines behind other text.

    All columns are text, "" where they were empty; columns that a file hasn't got too. A field in quotes may hold line feeds, which
    come back as one: whether a line goes on with a record is told by the number of quotes behind the header. Quotes are summed for each
    split of a file, so that a file of any length is read by many tasks, and only lines of records of several lines are shuffled.
    """
    read = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"))
    base = Table(read.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))).df
    tops = base.where("split = 0").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("at"))).where(F.col("n") <= lines)
    is_head = F.ltrim(F.regexp_replace("value", '^\\s*"', "")).startswith(first)
    heads = Table(tops.groupBy("file").agg(F.min(F.when(is_head, F.struct("at", "value"))).alias("h"))).df
    lost = heads.where("h is null").count()
    if lost or not heads.head(1):
        raise ValueError(f"no header line starts with {first!r} in the first {lines} lines of {lost or 'any'} file(s)")
    body = base.join(heads.select("file", F.col("h.at").alias("head"), F.col("h.value").alias("names")), "file").where("split > 0 or at > head")
    body = body.withColumn("quotes", F.regexp_count("value", F.lit('"')))
    in_split, by_split = Window.partitionBy("file", "split").orderBy("at"), Window.partitionBy("file").orderBy("split")
    ahead = Window.unboundedPreceding, -1
    sums = body.groupBy("file", "split").agg(F.sum("quotes").alias("sum")).select("file", "split", F.coalesce(F.sum("sum").over(by_split.rowsBetween(*ahead)), F.lit(0)).alias("before"))
    told = body.join(sums, ["file", "split"]).withColumn("inside", (F.col("before") + F.coalesce(F.sum("quotes").over(in_split.rowsBetween(*ahead)), F.lit(0))) % 2 == 1)
    told = Table(told.withColumn("open", F.col("inside") != (F.col("quotes") % 2 == 1))).df
    # records of several lines: each goes by its first line, which may stand in an earlier split
    starts = F.last(F.when(~F.col("inside"), F.struct("split", "at")), ignorenulls=True)
    several = told.where("inside or open").withColumn("own", starts.over(in_split.rowsBetween(Window.unboundedPreceding, 0)))
    carried = several.groupBy("file", "split").agg(F.max("own").alias("own")).select("file", "split", F.last("own", ignorenulls=True).over(by_split.rowsBetween(*ahead)).alias("earlier"))
    keyed = several.join(carried, ["file", "split"]).withColumn("record", F.coalesce("own", "earlier"))
    joined = keyed.groupBy("file", "names", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "at", "value"))), lambda x: x["value"]), "\n").alias("value"))
    records = told.where("not inside and not open").select("names", "value").unionByName(joined.select("names", "value")).where(F.trim("value") != "")
    parts = []
    for (header,) in heads.select("h.value").distinct().orderBy("value").collect():
        names = [n.strip() for n in next(csv.reader([header]))]
        fields = ", ".join(f"`{n}` string" for n in names)
        parts.append(records.where(F.col("names") == header).select(F.from_csv("value", fields, {"escape": '"', "multiLine": "true"}).alias("r")).select("r.*"))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts).fillna("")


def json_lines(spark: SparkSession, path: str, schema: str, required: str | None = None, strict: bool = False) -> DataFrame:
    """Objects, one a line; those without the required field, and broken ones, go, or stop the read."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    df = spark.read.schema(T.StructType.fromDDL(schema).add("_corrupt", T.StringType())).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt")
    good = df.where(F.col("_corrupt").isNull()) if required is None else df.where(F.col("_corrupt").isNull() & (F.coalesce(F.trim(required), F.lit("")) != ""))
    return good.drop("_corrupt")


def benchmark_flags(df: DataFrame) -> DataFrame:
    """(questions, has_gold_chunks, has_gold_answers)."""
    return df.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.bool_or(F.size("gold_chunk_ids") > 0), F.lit(False)).alias("has_gold_chunks"), F.coalesce(F.bool_or(F.trim("gold_answer") != ""), F.lit(False)).alias("has_gold_answers"))


def triple_lines(spark: SparkSession, path: str, allowed: tuple[str, ...] = ("http://", "https://", "s3a://")) -> DataFrame:
    """(pos, value) of a JSON-lines file in an object store; paths elsewhere are refused."""
    if not path.startswith(allowed):
        raise PermissionError("triples are read from an object store only")
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("pos"), "value")


def payload_records(df: DataFrame, col: str = "payload") -> DataFrame:
    """Records of payloads: a JSON array, an object with items, records or data, or one object; as maps of text."""
    kind = "array<map<string,string>>"
    raw = F.trim(col)
    inner = F.coalesce(*[F.get_json_object(raw, f"$.{k}") for k in ("items", "records", "data")])
    listed = F.when(raw.startswith("["), F.from_json(raw, kind)).when(inner.isNotNull(), F.from_json(inner, kind)).when(raw.startswith("{"), F.array(F.from_json(raw, "map<string,string>")))
    return df.select(*[c for c in df.columns if c != col], F.explode(F.coalesce(listed, F.array().cast(kind))).alias("record"))


def text_export(spark: SparkSession, path: str, mark: str = "SOURCE: Scopus", cutoff_year: int | None = None) -> DataFrame:
    """Publications of a plain-text export: records end with a mark, labelled fields, title and year by place.

    Years up to the cutoff are left out.
    """
    raw = spark.read.option("lineSep", mark).text(path)
    return export_records(raw, cutoff_year)


def export_records(raw: DataFrame, cutoff_year: int | None = None) -> DataFrame:
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    field = lambda name: F.trim(F.regexp_extract("value", rf"(?m)^\s*{name}:\s*(.*)$", 1))
    out = raw.select(
        F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("authors"), F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("title"),
        F.regexp_extract("value", r"(?m)^\s*\((\d{4})\)", 1).alias("year"), F.trim(F.regexp_extract("value", r"(?m)^\s*\(\d{4}\)\s*([^,\n]*)", 1)).alias("journal"),
        F.regexp_extract("value", r"(?m)^\s*(https?://\S+)", 1).alias("link"), field("DOI").alias("doi"), field("ABSTRACT").alias("abstract"),
        field("AUTHOR KEYWORDS").alias("keywords"), field("DOCUMENT TYPE").alias("document_type"),
    ).where("title <> ''")
    return out if cutoff_year is None else out.where((F.col("year") == "") | (F.col("year").cast("int") > cutoff_year))


def openalex_records(landed: DataFrame, least: float = 0.3) -> DataFrame:
    """title, doi, abstract from its inverted index, keywords from concepts above a score. landed: JSON text ``value``."""
    schema = "title string, doi string, abstract_inverted_index map<string,array<int>>, concepts array<struct<display_name:string,score:double>>"
    r = landed.select(F.from_json("value", schema).alias("r")).select("r.*")
    concepts = F.transform(F.filter("concepts", lambda c: c.score > least), lambda c: c.display_name)
    return r.select("title", F.regexp_replace("doi", "^https?://(dx\\.)?doi\\.org/", "").alias("doi"), tx.text_of_index(F.col("abstract_inverted_index")).alias("abstract"), F.array_join(concepts, ", ").alias("keywords"))


def lookup_by_doi_then_title(papers: DataFrame, landed: DataFrame, threshold: float = 0.85) -> DataFrame:
    """papers (paper_id, doi, title) with the landed row of their DOI, else that of the most similar title, whatever word it begins with."""
    from foliospark.operators.linkage import similar_names

    key = lambda c: F.lower(F.trim(c))
    name = lambda c: tx.squashed(F.col(c)).alias("name")
    l_ = landed.select(key(F.col("doi")).alias("ldoi"), F.col("title").alias("ltitle"), F.struct(*landed.columns).alias("hit"))
    by_doi = papers.where("trim(doi) <> ''").join(l_, key(F.col("doi")) == F.col("ldoi")).groupBy("paper_id").agg(F.min("hit").alias("hit"))
    rest = Table(papers.join(by_doi, "paper_id", "left_anti").select("paper_id", name("title"))).df
    near = similar_names(rest.select("name"), landed.select(name("title")), threshold)
    told = rest.join(near, rest["name"] == near.lname).join(l_.withColumn("rname", tx.squashed(F.col("ltitle"))), "rname")
    by_title = told.groupBy("paper_id").agg(F.min_by("hit", F.struct(-F.col("score"), "ltitle")).alias("hit"))
    return papers.join(by_doi.unionByName(by_title), "paper_id", "left")


def best_of_hits(papers: DataFrame, hits: DataFrame, most: int = 3, least: float = 0.75) -> DataFrame:
    """papers (paper_id, title, ...) with the landed answer that fits best, as ``hit``, and its ``score``; null where none does.

    hits: paper_id, rank from 1, title and other columns, as a title search gave them. Of the first ``most`` the most similar title counts, of
    equals the first, if its ratio reaches ``least``; titles are compared without case, marks and blanks.
    """
    from foliospark.functions.names import ratio

    plain = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    asked = papers.select("paper_id", plain(F.col("title")).alias("_asked")).where("_asked <> ''")
    scored = hits.where(F.col("rank") <= most).join(asked, "paper_id").withColumn("_s", ratio(plain(F.col("title")), F.col("_asked")))
    best = scored.where(F.col("_s") >= least).groupBy("paper_id").agg(F.min_by(F.struct(F.struct(*hits.columns).alias("hit"), F.col("_s").alias("score")), F.struct(-F.col("_s"), F.col("rank"))).alias("b"))
    return papers.join(best.select("paper_id", "b.*"), "paper_id", "left")


def unread(targets: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run has still to do."""
    return targets.join(done.select(key).distinct(), key, "left_anti")


def pending(papers: DataFrame, limit: int) -> DataFrame:
    """Papers without a summary that have a DOI; the next ``limit`` by id."""
    return papers.where("tldr is null and doi is not null and doi <> 'null'").orderBy("paper_id").limit(limit)


def renamed_for_display(df: DataFrame) -> DataFrame:
    """snake_case names as Title Case."""
    return df.withColumnsRenamed({c: c.replace("_", " ").title() for c in df.columns})


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text, Markdown and HTML files; HTML without tags."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.decode("content", "UTF-8").alias("text"))
    page = F.lower("path").rlike(r"\.html?$")
    return raw.select("path", F.when(page, tx.clean_text(F.regexp_replace("text", r"(?is)<(script|style)\b.*?</\1>", " "))).otherwise(F.col("text")).alias("text"))
