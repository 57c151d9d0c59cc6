"""Writes that can be repeated: upserts, links, quoted CSV, chunks, and status changes, over Parquet folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import nulls, text, time
from foliospark.operators.relational import insert_ignore, upsert
from foliospark.sources.readers import exists


def replace_table(df: DataFrame, path: str) -> None:
    """Writes beside the table and swaps, since the new rows may be read from the old ones. The old table stays aside until the new one is in place."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    p, new, old = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, f"{path}.new", f"{path}.old"))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if fs.exists(p) and not fs.rename(p, old):
        raise OSError(f"{path} could not be put aside")
    if not fs.rename(new, p):
        raise OSError(f"{path}.new could not take the place of {path}; the old table is {path}.old")
    fs.delete(old, True)


def upsert_table(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], order: str) -> int:
    old = spark.read.parquet(path) if exists(spark, path) else incoming.drop(order).limit(0)
    replace_table(upsert(old, incoming, keys, order), path)
    return incoming.count()


def lecturer_rows(df: DataFrame) -> DataFrame:
    """Lecturers with a number and a name; ids cleaned."""
    ids = {c: nulls.clean_value(F.col(c)) for c in ("nip", "nidn", "scopus_id", "scholar_id", "sinta_id") if c in df.columns}
    return df.withColumns(ids).where("nip is not null and trim(nama_dosen) <> ''")


def paper_rows(df: DataFrame) -> DataFrame:
    """Papers with a title, their key, and a year as number; names in Title Case or lower case are both read."""
    low = {c.lower().replace(" ", "_"): c for c in df.columns}
    get = lambda n: nulls.clean_value(F.col(f"`{low[n]}`")) if n in low else F.lit(None).cast("string")
    names = ("doi", "title", "abstract", "year", "journal", "document_type", "authors", "author_ids", "keywords", "link", "tldr")
    out = df.select(*[get(n).alias(n) for n in names]).where("trim(title) <> ''").withColumn("year", time.year_of(F.col("year")))
    return out.withColumn("paper_id", text.paper_key(F.col("doi"), F.col("title"), F.col("year")))


def paper_links(papers: DataFrame, lecturers: DataFrame) -> DataFrame:
    """Distinct (paper_id, nip): author ids by ";" or "," that are a lecturer's profile ids; the second kind wins."""
    ids = papers.select("paper_id", F.explode(text.parts(F.col("author_ids"), "[;,]")).alias("id")).withColumn("id", nulls.clean_id(F.col("id")))
    keys = lecturers.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), nulls.clean_id(F.col(c)).alias("id")) for k, c in enumerate(("scopus_id", "scholar_id"))])).alias("x"), "nip").select("x.*", "nip").where("id <> ''")
    return ids.join(keys.groupBy("id").agg(F.max_by("nip", F.struct("k", "nip")).alias("nip")), "id").select("paper_id", "nip").distinct()


def link_table(old: DataFrame, papers: DataFrame, lecturers: DataFrame) -> DataFrame:
    return insert_ignore(old, paper_links(papers, lecturers), ["paper_id", "nip"])


def write_quoted_csv(df: DataFrame, path: str, id_columns: list[str]) -> None:
    df.withColumns({c: nulls.clean_id(F.col(c)) for c in id_columns if c in df.columns}).write.mode("overwrite").option("quoteAll", True).csv(path, header=True)


def write_json_rows(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of re-indexed files in place of their old ones."""
    return old.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new)


def vector_rows(df: DataFrame, most: dict[str, int]) -> DataFrame:
    """Texts cut to what a collection's fields hold."""
    return df.withColumns({c: F.substring(c, 1, n) for c, n in most.items()})


def soft_delete(df: DataFrame, which: Column) -> DataFrame:
    return df.withColumn("is_deleted", F.when(which, 1).otherwise(F.col("is_deleted")))


def next_status(states: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Requested changes (run_id, status, wanted): the wanted status where the present one may go there."""
    pairs = [f"{a}>{b}" for a, bs in allowed.items() for b in bs]
    return states.withColumn("status", F.when(F.concat_ws(">", "status", "wanted").isin(*pairs), F.col("wanted")).otherwise(F.col("status")))
