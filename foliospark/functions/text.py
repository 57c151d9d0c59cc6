"""Cleaning, keys, lists and patterns of text, as column functions."""

from __future__ import annotations

import html
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unescape(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML character references decoded. Spark has no such function; rows without "&" don't leave the JVM's result."""
    return F.when(c.contains("&"), F.pandas_udf(_unescape, T.StringType())(c)).otherwise(c)


def squeeze(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def clean_text(c: Column) -> Column:
    """Character references, tags, zero-width characters, written-out and real line ends and tabs, runs of blanks; null is ""."""
    c = F.regexp_replace(unescape(F.coalesce(c, F.lit(""))), "<[^>]+>", " ")
    c = F.regexp_replace(c, "[\u200b\u200c\u200d\u2060\ufeff]", "")
    return squeeze(F.regexp_replace(c, r"\\[ntr]", " "))


def clean_abstract(c: Column) -> Column:
    """Without the heading "Abstract" before and the keyword list behind."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"^(?U)\s*(?i:abstract|abstrak)[\s\-—–:.]+", "")
    tail = r"(?isU)\s*(?:kata\s+kunci|keywords?|key\s+words?|subject\s+terms?|index\s+terms?)[\s:\-—–.].*$"
    return clean_text(F.regexp_replace(c, tail, ""))


def squashed(c: Column) -> Column:
    """Lower case, trimmed, no blanks: the key for equal titles."""
    return F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit(" "), F.lit(""))


def plain(c: Column) -> Column:
    """Lower case words without marks."""
    return squeeze(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", ""))


def trigrams(c: Column) -> Column:
    """Distinct runs of three characters; none for shorter texts."""
    n = F.length(c) - 2
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: c.substr(i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def parts(c: Column, separators: str = "[;,]") -> Column:
    """Trimmed pieces between separators, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), separators), lambda x: F.trim(x)), lambda x: x != "")


def ordered_set(c: Column, separators: str = "[;,|\n]") -> Column:
    return F.array_distinct(parts(c, separators))


def keywords(c: Column) -> Column:
    """Lower-case keywords joined by ", ", whatever separated them."""
    return F.array_join(parts(F.lower(c), "[;|,]"), ", ")


def has_label(c: Column, label: str) -> Column:
    """Whether a list written with "|" has the label as a whole item, whatever its case."""
    return F.array_contains(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.lower(F.trim(x))), label.lower())


def md5_prefix(c: Column, n: int = 12) -> Column:
    return F.substring(F.md5(c.cast("string")), 1, n)


def paper_key(doi: Column, title: Column, year: Column) -> Column:
    """md5 of doi:<doi>, or where there is none of title:<letters and digits>_year:<year>."""
    doi = F.lower(F.trim(F.coalesce(doi, F.lit(""))))
    name = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", "")
    return F.md5(F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("title:"), name, F.lit("_year:"), F.coalesce(year.cast("string"), F.lit("")))))


def token_count(c: Column) -> Column:
    """Words of ASCII letters, digits and underscores, and CJK characters one by one; 1 at least unless blank."""
    n = F.regexp_count(c, F.lit("[A-Za-z0-9_]+|[\u4e00-\u9fff]"))
    blank = F.coalesce(squeeze(c), F.lit("")) == ""
    return F.when(blank, F.lit(0)).otherwise(F.greatest(n, F.lit(1)))


def doi_in(url: Column) -> Column:
    """The DOI in an address, up to a query, an escape or closing dots; "" if none."""
    found = F.regexp_extract(url, r"(10\.\d{4,9}/[-._;()/:a-zA-Z0-9]+)", 1)
    return F.regexp_replace(F.regexp_replace(found, "[&%].*$", ""), r"\.+$", "")


def link_or_doi(link: Column, doi: Column) -> Column:
    """The link, unless it is empty or a profile page and there is a DOI."""
    link, doi = F.coalesce(link, F.lit("")), F.coalesce(doi, F.lit(""))
    return F.when((doi != "") & ((link == "") | link.contains("scholar.google")), F.concat(F.lit("https://doi.org/"), doi)).otherwise(link)


# The two ways of writing an abbreviation.
LONG_SHORT = r"([A-Za-z][\w\s\-]+?)\s*\(([A-Z][A-Za-z0-9\s\-.]*?)\)"
SHORT_LONG = r"([A-Z][A-Z0-9]{1,10})\s*\(([A-Za-z][\w\s\-]+?)\)"


def abbreviations(c: Column, compat: bool = False) -> Column:
    """Array of (short, long) from "Long Form (LF)" and "LF (Long Form)", in the order of the patterns and the text.

    The short one has fewer characters, digits not counted, since those stand for what is left out ("LARGE (N10033)"); of equal ones it is
    that in brackets. compat: digits count.
    """
    size = lambda x: F.length(x if compat else F.regexp_replace(x, r"\d", ""))
    out = []
    for pattern in (LONG_SHORT, SHORT_LONG):
        a, b = F.regexp_extract_all(c, F.lit(pattern), 1), F.regexp_extract_all(c, F.lit(pattern), 2)
        out.append(F.zip_with(a, b, lambda x, y: F.struct(F.trim(x).alias("x"), F.trim(y).alias("y"))))
    pairs = F.transform(F.concat(*out), lambda p: F.when(size(p.x) < size(p.y), F.struct(p.x.alias("short"), p.y.alias("long"))).otherwise(F.struct(p.y.alias("short"), p.x.alias("long"))))
    return F.filter(pairs, lambda p: (F.length(p.short) >= 2) & (plain(p.short) != plain(p.long)))


def title_terms(c: Column) -> Column:
    """Acronyms, then runs of capitalised words."""
    return F.concat(F.regexp_extract_all(c, F.lit("([A-Z]{2,}[0-9]*)")), F.regexp_extract_all(c, F.lit(r"([A-Z][A-Za-z0-9]*(?:\s+[A-Z][A-Za-z0-9]*)+)")))


def first_object(c: Column) -> Column:
    """The first { to the last } of a reply that wraps JSON in prose or fences."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def text_of_index(index: Column) -> Column:
    """A text from a map of its words to their places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e.value, lambda p: F.struct(p.alias("p"), e.key.alias("w")))))
    return F.array_join(F.transform(F.array_sort(places), lambda x: x.w), " ")


def numbered_lines(c: Column, offset: int, limit: int) -> Column:
    """Lines from offset on, each with its number."""
    lines = F.slice(F.split(c, "\r\n|\n|\r"), offset + 1, limit)
    return F.array_join(F.transform(lines, lambda x, i: F.format_string("%6d\t%s", i + F.lit(offset + 1), x)), "\n")


def shortened(c: Column, most: int) -> Column:
    return F.substring(F.trim(c), 1, most)


# Node types by label.
LABELS = {
    "method": "Method", "algorithm": "Method", "technique": "Method", "research method": "Method", "model": "Model", "metric": "Metric",
    "evaluation metric": "Metric", "dataset": "Dataset", "problem": "Problem", "task": "Task", "field": "Field", "scientific concept": "Field",
    "tool": "Tool", "framework": "Tool", "software": "Tool", "platform": "Tool", "technology": "Tool", "programming language": "Tool",
    "innovation": "Innovation", "results": "Innovation",
}
STRUCTURAL = ("Dosen", "Paper", "ProgramStudi", "Journal", "Year", "Keyword")
SEMANTIC = ("Method", "Model", "Metric", "Dataset", "Problem", "Task", "Field", "Tool", "Innovation")


def node_type(label: Column) -> Column:
    """The node type of a label: by the map, as it is where it names one, else Field."""
    known = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    capital = F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 1 << 20)))
    return F.coalesce(F.element_at(known, F.lower(label)), F.when(capital.isin(*STRUCTURAL, *SEMANTIC), capital), F.lit("Field"))


def glob_pattern(glob: str) -> str:
    """A file-name pattern as a regular expression: * and ? stay inside a folder, ** doesn't."""
    import re

    out, at = [], 0
    while at < len(glob):
        if glob.startswith("**", at):
            out.append(".*")
            at += 2
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[at], re.escape(glob[at])))
            at += 1
    return "^" + "".join(out) + "$"


def like_filter(c: Column, wanted: str) -> Column:
    return c.like(wanted if "%" in wanted else f"%{wanted}%")
