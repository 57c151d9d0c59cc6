"""Main text of web pages by composite text density.

Every node of the page's tree gets a density: characters per tag in its subtree times a logarithm that is lower the more of its
characters and tags belong to links (Sun et al., "DOM based content extraction via text density", 2011):

    chars / tags * log_b(chars / link chars * tags / link tags),  b = ln(chars / other chars * link chars + share * chars + e)

with the body's share of link characters. Bases below 2 count as 2: logarithms to a base near 1, as on pages without links,
would favour the smallest nodes. Text and inline elements between blocks are a unit of their own with its own density.

The subtree whose children have the largest sum of densities is the article's core. Of it nothing is dropped but rows of bare links
(not lists or paragraphs of them) before or behind all else. From there the way goes up to the body. The threshold is the least plain density (characters outside links per tag) on that way. At each step the
blocks beside the way are taken along if they are prose, unlinked and as dense as the threshold, and so are headings and
bare text; beside prose all that isn't mostly links is taken. An ``article`` element around the core is part of it as a whole, and beside
it only other ones and the title are taken.

Before, menus, page headers, footers, side bars, notices, adverts, forms, scripts, styles and reader comments are cut out by
element and role, and by class and id names that as a whole say so (``side-effects`` isn't a side bar), however much text they hold. A
name doesn't count on what holds an ``article``, ``main`` or ``h1`` with text, nor on a paragraph or heading of prose where its words may
mean something else (``related``), nor at all on a page that would have no text without what is named.

Text comes out in blocks in page order: character references decoded, white space inside a block turned into one space,
ends trimmed, blocks joined by a line feed. Nothing is dropped for its length. Time is linear in the page's length.

Defined cases: null or empty html gives an empty text; unclosed, stray and misnested tags are closed as browsers would
close the common cases, a tag that never ends hides the rest of the page; every row gives a row; other columns aren't read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>\"'<]*+)([^<>\"']*+)>")
_TAG_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_IN_TAG = re.compile(r"(=\s*+)?([\"'])|>")
_ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")

# Element names by their part in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr br".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
DROPPED = frozenset(
    "head script style noscript template iframe object embed svg math canvas audio video nav footer aside form button select "
    "option textarea input label dialog menu title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
# Words that name what isn't the article; a class or id says so if all its words are from these lists.
COMMENTS = frozenset("comment comments commentlist commenter disqus respond reply replies".split())
NOISE = COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup sidebar aside side menu nav navbar navigation navi breadcrumb breadcrumbs "
    "footer masthead topbar toolbar share sharing social related recommended recommendations pagination pager skip login search".split()
)
AROUND = frozenset(
    "area bar block body bottom box button buttons column container content form global group header holder inner item items left link links "
    "list main message outer page panel primary right row secondary section site slot text thread title top unit widget wrap wrapper".split()
)
#: Names that may stand on a paragraph for what it is about.
DOUBTFUL = frozenset("related recommended recommendations notice notices alert side search login skip social share sharing promotion banner".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd td".split())
PAGE_HEADER = frozenset(("header", "masthead", "site-header", "page-header"))
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that end when another of the group begins, up to the container.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}),
}


_CHAINS = {name: k for k, name in enumerate(SIBLINGS)}
_CHAINED = frozenset(x for own, stop in SIBLINGS.values() for x in own | stop)


class Node:
    """chains: for each name in SIBLINGS the outermost element that such an element would end. p: an open paragraph that a block ends."""

    __slots__ = ("attrs", "chains", "chars", "density", "holds", "link_chars", "link_tags", "name", "p", "parent", "parts", "score", "tags")

    def __init__(self, name: str, attrs: str, parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.parts: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.score = 0.0
        self.holds = False
        self.p: Node | None = self if name == "p" else parent.p if parent and name in INLINE else None
        self.chains: tuple = parent.chains if parent else (None,) * len(SIBLINGS)
        if name in _CHAINED:
            self.chains = tuple(None if name in stop else held or (self if name in own else None) for held, (own, stop) in zip(self.chains, SIBLINGS.values()))


def _tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where the tag at ``at`` has its ``>``, outside of quoted values; -1 if nowhere. missing: quotes that don't come any more."""
    while m := _IN_TAG.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at - 1
        if m[1] is not None and m[2] not in missing:
            end = page.find(m[2], at)
            if end < 0:
                missing.add(m[2])
            else:
                at = end + 1
    return -1


def parse(page: str) -> Node:
    root = Node("", "", None)
    at, node, end = 0, root, len(page)
    open_: Counter = Counter()
    missing: set[str] = set()

    def up_to(target: Node) -> Node:
        """Closes elements until target is the current one; each is closed once."""
        now = node
        while now is not target:
            open_[now.name] -= 1
            now = now.parent
        return now

    while at < end:
        start = page.find("<", at)
        if start < 0:
            node.parts.append(page[at:])
            break
        m = _PLAIN_TAG.match(page, start) or _TAG_NAME.match(page, start)
        if m is None:
            after = page[start + 1 : start + 2]
            if after not in ("!", "?", "/"):  # a mere character
                node.parts.append(page[at : start + 1])
                at = start + 1
                continue
            if start > at:
                node.parts.append(page[at:start])
            opener, closer = next((x for x in (("<!--", "-->"), ("<![CDATA[", "]]>")) if page.startswith(x[0], start)), ("<", ">"))
            stop = page.find(closer, start + len(opener))
            if len(opener) > 4:
                node.parts.append(html.escape(page[start + 9 : stop if stop >= 0 else end]))
            at = stop + len(closer) if stop >= 0 else end
            continue
        if start > at:
            node.parts.append(page[at:start])
        if m.re is _PLAIN_TAG:
            attrs, at = m[3], m.end()
        else:
            stop = _tag_end(page, m.end(), missing)
            if stop < 0:
                break
            attrs, at = page[m.end() : stop], stop + 1
        name = m[2].lower()
        if m[1]:
            if open_[name] > 0:
                up = node
                while up.name != name:
                    up = up.parent
                node = up_to(up.parent)
            continue
        if name in CLOSES_P and node.p is not None:
            node = up_to(node.p.parent)
        if name in _CHAINS and (held := node.chains[_CHAINS[name]]) is not None:
            node = up_to(held.parent)
        child = Node(name, attrs, node)
        node.parts.append(child)
        if name in VOID or attrs.endswith("/") and name not in INLINE and name not in CLOSES_P:
            continue
        if name in RAW:
            m = _raw_end(name).search(page, at)
            child.parts.append(page[at : m.start() if m else end])
            at = page.find(">", m.start()) + 1 if m else end
            at = at or end
            continue
        open_[name] += 1
        node = child
    return root


@lru_cache(maxsize=32)
def _raw_end(name: str) -> re.Pattern:
    return re.compile(f"</{re.escape(name)}", re.I)


def is_noise(node: Node, inside: bool) -> bool:
    """Whether the element by its kind isn't part of any article. inside: of an article or main element."""
    if node.name in DROPPED or node.name == "header" and not inside:
        return True
    if not node.attrs or node.name in ("html", "body", "article", "main"):
        return False
    for key, *values in _ATTR.findall(node.attrs):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in ROLES or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def named_noise(node: Node, inside: bool) -> frozenset[str]:
    """The words by which a class or id says that the element isn't part of the article."""
    if not node.attrs or node.name in ("html", "body", "article", "main"):
        return frozenset()
    found: set[str] = set()
    for key, *values in _ATTR.findall(node.attrs):
        if key.lower() in ("class", "id"):
            for name in "".join(values).lower().split():
                words = {w for w in re.split(r"[_\-0-9]+", name) if w}
                if words & NOISE and words <= NOISE | AROUND:
                    found |= words & NOISE
                elif name in PAGE_HEADER and not inside:
                    found.add(name)
    return frozenset(found)


def means_text(node: Node, says: frozenset[str]) -> bool:
    """Whether the name is no ground to drop the element: it holds the article, or it is a paragraph that has a name of the doubtful kind."""
    if says & COMMENTS:
        return False
    if says <= DOUBTFUL and node.name in PROSE and node.chars and 2 * node.link_chars < node.chars:
        return True
    todo = [node]
    while todo:
        now = todo.pop()
        if now.chars and now.name in ("article", "main", "h1"):
            return True
        todo += [p for p in now.parts if not isinstance(p, str) and p.holds]
    return False


def prune(root: Node) -> None:
    """Takes noise out of the tree, from the top down: by kind, then by name, unless no text were left then."""
    for names in (False, True):
        todo, cut = [(root, False)], []
        while todo:
            node, inside = todo.pop()
            inside = inside or node.name in ARTICLE
            kept: list[Node | str] = []
            for p in node.parts:
                if isinstance(p, str):
                    kept.append(p)
                elif names:
                    says = named_noise(p, inside)
                    if not says or means_text(p, says):
                        kept.append(p)
                elif not is_noise(p, inside):
                    kept.append(p)
            if len(kept) < len(node.parts):
                cut.append((node, node.parts))
                node.parts = kept
            todo += [(p, inside) for p in kept if not isinstance(p, str)]
        count(root)
        if names and not root.chars:
            for node, parts in cut:
                node.parts = parts


def nodes_of(root: Node) -> list[Node]:
    """Every node, parents before children, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in reversed(node.parts) if not isinstance(p, str)]
    return out


def count(root: Node) -> None:
    """Characters and tags of all subtrees, those that belong to links, and whether they hold an element that names an article."""
    for node in reversed(nodes_of(root)):
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.holds = node.name in ("article", "main", "h1")
        for part in node.parts:
            if isinstance(part, str):
                node.chars += sum(map(len, part.split()))
            else:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags
                node.holds = node.holds or part.holds
        if node.name == "a":
            node.link_chars = node.chars
            node.link_tags += 1


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    if not chars:
        return 0.0
    tags = max(1, tags)
    ratio = chars / max(1, link_chars) * tags / max(1, link_tags)
    base = math.log(chars / max(1, chars - link_chars) * link_chars + share * chars + math.e)
    return chars / tags * max(0.0, math.log(ratio)) / math.log(max(2.0, base))


def plain_density(node: Node) -> float:
    return (node.chars - node.link_chars) / max(1, node.tags)


class Unit:
    """A block below a node, or a run of text and inline elements between blocks."""

    __slots__ = ("chars", "density", "link_chars", "node", "parts")

    def __init__(self, parts: list[Node | str], node: Node | None, share: float):
        self.parts, self.node = parts, node
        if node is not None:
            self.chars, self.link_chars, self.density = node.chars, node.link_chars, node.density
            return
        own = [p for p in parts if not isinstance(p, str)]
        self.chars = sum(p.chars for p in own) + sum(len(w) for p in parts if isinstance(p, str) for w in p.split())
        self.link_chars = sum(p.link_chars for p in own)
        self.density = density(self.chars, sum(p.tags + 1 for p in own), self.link_chars, sum(p.link_tags for p in own), share)

    @property
    def linked(self) -> bool:
        return 2 * self.link_chars >= self.chars > 0


def units(node: Node, share: float) -> list[Unit]:
    out: list[Unit] = []
    run: list[Node | str] = []
    for p in node.parts:
        if isinstance(p, str) or p.name in INLINE:
            run.append(p)
            continue
        if run:
            out.append(Unit(run, None, share))
            run = []
        out.append(Unit([p], p, share))
    if run:
        out.append(Unit(run, None, share))
    return out


def weigh(root: Node) -> float:
    """Densities of all nodes and the sums over their children; the share of link characters."""
    count(root)
    order = nodes_of(root)
    share = root.link_chars / max(1, root.chars)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in order:
        if any(not isinstance(p, str) and p.name not in INLINE for p in node.parts):
            node.score = sum(u.density for u in units(node, share))
    return share


def choose(root: Node) -> Node:
    """The part of the tree that holds the article."""
    share = weigh(root)
    order = nodes_of(root)
    best = max(order, key=lambda n: n.score)
    if not best.score:
        best = next((n for n in order if n.name == "article" and n.chars), None) or next((n for n in order if n.name == "body"), root)
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    articles = [n for n in path if n.name == "article"]
    if articles:  # the core is the article around it
        path = path[path.index(articles[-1]) :]
    end = next(k for k, n in enumerate(path) if n.name in ("", "html", "body", "main"))
    way = path[: end + 1]
    threshold = min(plain_density(n) for n in way)
    if not articles:
        held = units(best, share)
        bare = [u.node is None and u.chars == u.link_chars > 0 for u in held]
        text = [k for k, u in enumerate(held) if u.chars and not bare[k]]
        if text:  # rows of links without a block of their own lead elsewhere where they stand before or behind all else
            best.parts = [p for k, u in enumerate(held) if not bare[k] or text[0] < k < text[-1] for p in u.parts]
    for child, node in zip(way, way[1:]):
        beside = units(node, share)
        prose = [u for u in beside if u.node is not child and not u.linked and u.node is not None and u.chars and plain_density(u.node) >= threshold]
        kept: list[Node | str] = []
        for u in beside:
            if articles:  # what is beside a marked article isn't part of it, but for other marked ones and the title
                taken = u in prose and u.node.holds or u.node is not None and u.node.name == "h1"
            else:
                taken = not u.linked and (prose or u.node is None or u.node.name in HEADINGS)
            if u.node is child or not u.chars or taken:
                kept += u.parts
        node.parts = kept
    return way[-1]


def blocks(node: Node) -> list[str]:
    """Texts of the subtree's blocks in page order, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            run.append(part)
        elif part.name == "br":
            run.append(" ")
        elif part.name in INLINE:
            todo += reversed(part.parts)
        else:
            close()
            todo.append(None)
            todo += reversed(part.parts)
    close()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(blocks(choose(root)))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = [main_text(x) for x in part.html]
            yield pd.DataFrame({"page_id": part.page_id, "url": part.url, "text": texts, "n_chars": [len(x) for x in texts]})

    # ids go through pandas as text, which has no integers with nulls
    slim = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html")
    return slim.mapInPandas(work, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
