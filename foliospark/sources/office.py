"""Files of many formats as Markdown: headings, lists and tables of Word, Excel, PowerPoint, HTML, CSV, JSON and text files.

Spark reads the files and deals them out; a file is opened in the task that has it. A file that can't be read gives a row with
its error and no text, and doesn't stop the others.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a part of a file may have when it is unpacked; a longer one is an error, not a full memory.
MOST_BYTES = 256 << 20

# Namespaces of the formats.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def _part(box: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in box.namelist():
        return None
    if box.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is longer than {MOST_BYTES} bytes")
    return ElementTree.fromstring(box.read(name))


def table(rows: list[list[str]]) -> str:
    """A Markdown table; the first row is its head, shorter rows are filled up."""
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] for r in rows if any(c.strip() for c in r)]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |" for r in rows]
    return "\n".join([lines[0], f"|{' --- |' * width}", *lines[1:]])


def word(content: bytes) -> str:
    """Paragraphs and tables in their order; headings by the name or outline level of their style."""
    box = zipfile.ZipFile(io.BytesIO(content))
    levels: dict[str, int] = {}
    styles = _part(box, "word/styles.xml")
    for style in styles.iter(f"{W}style") if styles is not None else ():
        name = style.find(f"{W}name")
        found = re.fullmatch(r"heading (\d)", (name.get(f"{W}val") or "").lower()) if name is not None else None
        outline = style.find(f"{W}pPr/{W}outlineLvl")
        if found or outline is not None:
            levels[style.get(f"{W}styleId")] = int(found[1]) if found else int(outline.get(f"{W}val")) + 1
        elif name is not None and (name.get(f"{W}val") or "").lower() == "title":
            levels[style.get(f"{W}styleId")] = 1

    def said(p: ElementTree.Element) -> str:
        marks = {f"{W}tab": "\t", f"{W}br": "\n", f"{W}cr": "\n"}
        return "".join((x.text or "") if x.tag == f"{W}t" else marks.get(x.tag, "") for x in p.iter()).strip()

    def paragraph(p: ElementTree.Element) -> str:
        text, style = said(p), p.find(f"{W}pPr/{W}pStyle")
        name = style.get(f"{W}val") if style is not None else ""
        number = re.fullmatch(r"[Hh]eading(\d)", name or "")
        level = levels.get(name) or (int(number[1]) if number else 0)
        if text and 1 <= level <= 6:
            return f"{'#' * level} {' '.join(text.split())}"
        return f"- {text}" if text and p.find(f"{W}pPr/{W}numPr") is not None else text

    blocks = []
    body = _part(box, "word/document.xml").find(f"{W}body")
    for x in body:
        if x.tag == f"{W}p":
            blocks.append(paragraph(x))
        elif x.tag == f"{W}tbl":
            blocks.append(table([["\n".join(said(p) for p in cell.iter(f"{W}p")) for cell in row.iter(f"{W}tc")] for row in x.iter(f"{W}tr")]))
    return "\n\n".join(b for b in blocks if b)


def sheets(content: bytes) -> str:
    """Each sheet as a heading and a table."""
    box = zipfile.ZipFile(io.BytesIO(content))
    shared = _part(box, "xl/sharedStrings.xml")
    texts = ["".join(t.text or "" for t in si.iter(f"{S}t")) for si in shared.iter(f"{S}si")] if shared is not None else []
    links = _part(box, "xl/_rels/workbook.xml.rels")
    target = {x.get("Id"): x.get("Target") for x in links} if links is not None else {}

    def value(c: ElementTree.Element) -> str:
        kind, v = c.get("t"), c.find(f"{S}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{S}t"))
        raw = (v.text or "") if v is not None else ""
        return texts[int(raw)] if kind == "s" and raw else {"1": "TRUE", "0": "FALSE"}.get(raw, raw) if kind == "b" else raw

    def place(ref: str, after: int) -> int:
        letters = re.match(r"[A-Z]*", ref or "")[0]
        n = 0
        for x in letters:
            n = n * 26 + ord(x) - 64
        return n - 1 if letters else after

    blocks = []
    for sheet in _part(box, "xl/workbook.xml").iter(f"{S}sheet"):
        path = target.get(sheet.get(f"{R}id"), "")
        data = _part(box, path.lstrip("/") if path.startswith("/") else f"xl/{path}")
        rows = []
        for row in data.iter(f"{S}row") if data is not None else ():
            cells: list[str] = []
            for c in row.iter(f"{S}c"):
                at = place(c.get("r"), len(cells))
                cells += [""] * (at + 1 - len(cells))
                cells[at] = value(c)
            rows.append(cells)
        blocks += [f"## {sheet.get('name')}", table(rows)]
    return "\n\n".join(b for b in blocks if b)


def slides(content: bytes) -> str:
    """Each slide's title as a heading, and its other paragraphs."""
    box = zipfile.ZipFile(io.BytesIO(content))
    names = sorted((int(m[1]), n) for n in box.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
    blocks = []
    for _, name in names:
        for shape in _part(box, name).iter(f"{P}sp"):
            kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
            title = kind is not None and kind.get("type") in ("title", "ctrTitle")
            for p in shape.iter(f"{A}p"):
                text = "".join(t.text or "" for t in p.iter(f"{A}t")).strip()
                if text:
                    blocks.append(f"## {text}" if title else text)
    return "\n\n".join(blocks)


class _Page(HTMLParser):
    """Headings, paragraphs, list items and tables of a page."""

    BLOCKS = {"p", "div", "li", "ul", "ol", "section", "article", "header", "footer", "main", "nav", "aside", "blockquote", "pre", "br", "tr", "body", "table", "form", "dl", "dt", "dd", *(f"h{k}" for k in range(1, 7))}

    def __init__(self):
        super().__init__()
        self.blocks: list[str] = []
        self.now, self.mark, self.skip = "", "", 0
        self.rows: list[list[str]] | None = None

    def end(self) -> None:
        text = " ".join(self.now.split())
        if text:
            self.blocks.append(self.mark + text)
        self.now = self.mark = ""

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("script", "style", "head"):
            self.skip += tag != "head"
        elif self.rows is not None and tag in ("td", "th"):
            self.rows[-1:] = [[*self.rows[-1], ""]] if self.rows else [[""]]
        elif self.rows is not None and tag == "tr":
            self.rows.append([])
        elif tag in self.BLOCKS and self.rows is None:
            self.end()
            self.mark = f"{'#' * int(tag[1])} " if re.fullmatch("h[1-6]", tag) else "- " if tag == "li" else ""
            if tag == "table":
                self.rows = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "table" and self.rows is not None:
            self.blocks += [t for t in [table(self.rows)] if t]
            self.rows = None
        elif tag in self.BLOCKS and self.rows is None:
            self.end()

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.rows is None:
            self.now += data
        elif self.rows and self.rows[-1]:
            self.rows[-1][-1] += data


def page(content: bytes) -> str:
    reader = _Page()
    reader.feed(content.decode("utf-8", "replace"))
    reader.close()
    reader.end()
    return "\n\n".join(reader.blocks)


def records(content: bytes) -> str:
    """Each record of a CSV as a table of its own, under the names."""
    names, *rows = csv.reader(io.StringIO(content.decode("utf-8-sig"))) if content.strip() else [[]]
    return "\n\n".join(t for t in (table([names, r]) for r in rows if r) if t)


def indented(content: bytes) -> str:
    return f"```json\n{json.dumps(json.loads(content), ensure_ascii=False, indent=2)}\n```"


def plain(content: bytes) -> str:
    return content.decode("utf-8-sig")


FORMATS = {"docx": word, "xlsx": sheets, "pptx": slides, "html": page, "htm": page, "csv": records, "json": indented, "txt": plain, "md": plain}


def markdown(files: DataFrame) -> DataFrame:
    """(path, form, markdown, error) for files (path, content binary). form: the ending of the path in lower case."""

    def work(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for forms, contents in parts:
            out = []
            for form, content in zip(forms, contents):
                try:
                    out.append((FORMATS[form](content or b""), None))
                except KeyError as e:
                    out.append((None, f"unsupported format {form}" if e.args == (form,) else f"KeyError: {e}"))
                except Exception as e:  # the row tells what is wrong with the file
                    out.append((None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["markdown", "error"])

    form = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    made = F.pandas_udf(work, "markdown string, error string")
    return files.select("path", form.alias("form"), "content").select("path", "form", made("form", "content").alias("m")).select("path", "form", "m.markdown", "m.error")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, form, markdown, error) of all files under a path."""
    return markdown(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"))
