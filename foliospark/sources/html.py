"""Fields of landed web pages: DOI, keywords, abstract, links, profile ids and table rows."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import text


def meta(page: Column, name: str) -> Column:
    """The content of a meta tag, with its attributes in either order; "" if there is none."""
    one = F.regexp_extract(page, rf"""(?is)<meta[^>]*\b(?:name|property)\s*=\s*["']?{re.escape(name)}["'\s][^>]*?\bcontent\s*=\s*["']([^"']*)""", 1)
    two = F.regexp_extract(page, rf"""(?is)<meta[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\b(?:name|property)\s*=\s*["']?{re.escape(name)}["'\s/>]""", 1)
    return F.coalesce(F.nullif(F.trim(one), F.lit("")), F.trim(two))


def first_meta(page: Column, *names: str) -> Column:
    return F.coalesce(*[F.nullif(meta(page, n), F.lit("")) for n in names], F.lit(""))


def doi(page: Column) -> Column:
    return text.doi_in(first_meta(page, "citation_doi", "dc.identifier", "DC.Identifier.DOI", "prism.doi", "bepress_citation_doi"))


def keywords(page: Column) -> Column:
    """Meta tags, then a line "Keywords: ..." of the text; lower case, by ", "."""
    line = F.regexp_extract(F.regexp_replace(page, "<[^>]+>", "\n"), r"(?im)^\s*(?:keywords?|kata kunci)\s*:\s*\n?\s*([^\n]+)", 1)
    return text.keywords(F.coalesce(F.nullif(first_meta(page, "citation_keywords", "keywords", "dc.subject", "article:tag"), F.lit("")), line))


def abstract(page: Column, meta_least: int = 50, text_least: int = 80) -> Column:
    """Meta tags, a container named abstract, or what follows the heading; each if it is long enough."""
    m = first_meta(page, "citation_abstract", "dc.description", "description", "og:description")
    box = text.clean_text(F.regexp_extract(page, r"""(?is)<(?:div|section|p)[^>]*(?:class|id)\s*=\s*["'][^"']*abstract[^"']*["'][^>]*>(.*?)</(?:div|section|p)>""", 1))
    head = text.clean_text(F.regexp_extract(page, r"(?is)<h\d[^>]*>\s*(?:abstract|abstrak)\s*</h\d>\s*<[^>]+>(.*?)</", 1))
    long = lambda c, n: F.when(F.length(c) >= n, text.clean_abstract(c))
    return F.coalesce(long(m, meta_least), long(box, text_least), long(head, text_least), F.lit(""))


def links(pages: DataFrame, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, at, url, label) of all links."""
    pattern = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    both = F.arrays_zip(F.regexp_extract_all(page, F.lit(pattern), 1).alias("url"), F.regexp_extract_all(page, F.lit(pattern), 2).alias("label"))
    rows = pages.select(key, F.posexplode(both).alias("at", "x"))
    return rows.select(key, "at", F.trim("x.url").alias("url"), text.squeeze(F.regexp_replace("x.label", "<[^>]+>", " ")).alias("label"))


def best_pdf_link(found: DataFrame, key: str = "page_id", gate: int = 5) -> DataFrame:
    """The link with the highest score above a gate; the first of equals."""
    u, t = F.lower("url"), F.lower("label")
    has = lambda c, w, n: F.when(c.contains(w), n).otherwise(0)
    score = F.when(u.rlike(r"\.pdf($|[?#])"), 10).otherwise(0) + has(t, "pdf", 6) + has(t, "full text", 4) + has(t, "download", 4) + has(u, "download", 3) + has(u, "/view/", 2) - has(t, "supplement", 8) - has(u, "citation", 6)
    return found.withColumn("score", score).where(F.col("score") > gate).groupBy(key).agg(F.min_by("url", F.struct(-F.col("score"), "at")).alias("url"), F.max("score").alias("score"))


# Profile ids in links.
PROFILES = {"scholar_id": r"scholar\.google\.[^/]+/citations\?(?:[^#]*&)?user=([\w-]+)", "scopus_id": r"authorId=(\d+)", "sinta_id": r"sinta\.[^/]*/authors/(?:profile|detail\?id=)?/?(\d+)", "orcid": r"orcid\.org/(\d{4}-\d{4}-\d{4}-\d{3}[\dX])"}


def profile_ids(urls: Column) -> list[Column]:
    """The last link of each kind in an array of links."""
    found = lambda p: F.filter(F.transform(urls, lambda u: F.regexp_extract(u, p, 1)), lambda x: x != "")
    return [F.coalesce(F.try_element_at(found(p), F.lit(-1)), F.lit("")).alias(n) for n, p in PROFILES.items()]


def table_rows(page: str | None) -> list[list[str]]:
    """Cells' texts of every table row."""
    out = []
    for row in re.findall(r"(?is)<tr\b[^>]*>(.*?)(?=</tr>|<tr\b|\Z)", page or ""):
        cells = re.findall(r"(?is)<t[dh]\b[^>]*>(.*?)(?=</t[dh]>|<t[dh]\b|\Z)", row)
        if cells:
            out.append([" ".join(html.unescape(re.sub("<[^>]+>", " ", c)).split()) for c in cells])
    return out


def list_items(page: str | None) -> list[list[str]]:
    return [[" ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split())] for x in re.findall(r"(?is)<li\b[^>]*>(.*?)(?=</li>|<li\b|\Z)", page or "")]


def headed_blocks(page: str | None) -> list[list[str]]:
    """A heading and the text up to the next one."""
    clean = lambda x: " ".join(html.unescape(re.sub("<[^>]+>", " ", x)).split())
    return [[clean(a), clean(b)] for a, b in re.findall(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>(.*?)(?=<h[1-6]\b|\Z)", page or "")]


#: Page layouts by name; more can be added.
LAYOUTS = {"table": table_rows, "list": list_items, "headed": headed_blocks}


def rows(pages: DataFrame, layout: str, key: str = "page_id", page: str = "html") -> DataFrame:
    """(key, at, cells) of pages of a layout."""
    parse = LAYOUTS[layout]

    def work(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(parse)

    made = F.pandas_udf(work, T.ArrayType(T.ArrayType(T.StringType())))(F.col(page))
    return pages.select(key, F.posexplode(made).alias("at", "cells"))


def profile_papers(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, citations, year) of a profile's table; what isn't a number is 0."""
    n = lambda k: F.coalesce(F.try_to_number(F.regexp_replace(F.coalesce(F.get("cells", F.lit(k)), F.lit("")), r"\D", ""), F.lit("999999999")).cast("int"), F.lit(0))
    return rows(pages, "table", key).where(F.size("cells") >= 3).select(key, F.get("cells", F.lit(0)).alias("title"), n(1).alias("citations"), n(2).alias("year"))
