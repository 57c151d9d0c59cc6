"""Personal names: order, titles, folding, and similarity scores."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.text import squeeze

# Titles that matching leaves out, in this order, as patterns.
MATCH_TITLES = (
    r"\bprof\.?\b", r"\bdr\.?\b", r"\bir\.?\b", r"\bdrs\.?\b", r"\bs\.?t\.?\b", r"\bs\.?kom\.?\b", r"\bs\.?pd\.?\b", r"\bs\.?si\.?\b",
    r"\bm\.?t\.?\b", r"\bm\.?kom\.?\b", r"\bm\.?pd\.?\b", r"\bm\.?si\.?\b", r"\bm\.?eng\.?\b", r"\bm\.?sc\.?\b", r"\bph\.?d\.?\b",
    r"\bm\.?m\.?\b", r"\bs\.?e\.?\b", r"\bm\.?a\.?\b", ",", r"\.",
)
# Titles before a name.
PREFIXES = ("prof", "dr", "drs", "dra", "ir", "h", "hj", "apt", "ns", "bd", "kh", "r", "ra", "tb", "en", "rr", "rm", "andes")


def flip(c: Column) -> Column:
    """"Last, First" as "First Last"; by the first comma."""
    c = F.trim(c)
    return F.when(c.contains(","), F.concat_ws(" ", F.trim(F.regexp_extract(c, r"(?s)^[^,]*,(.*)$", 1)), F.trim(F.substring_index(c, ",", 1)))).otherwise(c)


def for_matching(c: Column) -> Column:
    """Lower case without titles and marks; patterns are taken out one after the other."""
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for title in MATCH_TITLES:
        out = F.regexp_replace(out, title, " ")
    return squeeze(out)


def without_titles(c: Column) -> Column:
    """Up to the first comma, without titles at the front."""
    titles = "|".join(rf"{t}\.?" for t in sorted(PREFIXES, key=len, reverse=True))
    out = F.trim(F.substring_index(F.coalesce(c, F.lit("")), ",", 1))
    return squeeze(F.regexp_replace(out, rf"(?i)^(?:(?:{titles})\s+)+", ""))


def _each(f: Callable, kind: T.DataType) -> Callable[..., Column]:
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*row) for row in zip(*series)])

    def typed2(a: pd.Series, b: pd.Series) -> pd.Series:
        return run(a, b)

    def typed1(a: pd.Series) -> pd.Series:
        return run(a)

    return lambda *c: F.pandas_udf(typed1 if len(c) == 1 else typed2, kind)(*c)


def fold_text(x: str | None) -> str:
    return unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode()


#: Letters without their accents; what has no ASCII form goes.
fold = _each(fold_text, T.StringType())


def normalized(c: Column) -> Column:
    out = F.regexp_replace(F.lower(without_titles(c)), "['’‘`]", "")
    return fold(squeeze(F.regexp_replace(out, r"[.,;()\[\]]", " ")))


#: Ratio of matching blocks; depends on the order of its arguments.
ratio = _each(lambda a, b: SequenceMatcher(None, a or "", b or "").ratio(), T.DoubleType())


def token_set(a: str | None, b: str | None) -> float:
    """0 to 100: the best ratio among shared words, and shared words with either side's other words."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, two = (f"{both} {' '.join(sorted(s))}".strip() for s in (x - y, y - x))
    if both and (x <= y or y <= x):
        return 100.0
    pairs = ((both, one), (both, two), (one, two))
    return 100 * max(_indel(p, q) for p, q in pairs if p or q)


def _indel(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for k, y in enumerate(b, 1):
            before, row[k] = row[k], before + 1 if x == y else max(row[k], row[k - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


token_set_ratio = _each(token_set, T.DoubleType())


def best_match(a: str | None, b: str | None, threshold: float = 0.85) -> tuple[bool, float, str]:
    """Whether two normalised names agree, how well, and by which rule."""
    a, b = a or "", b or ""
    if not a or not b:
        return False, 0.0, "empty"
    if a == b:
        return True, 1.0, "exact"
    if min(len(a), len(b)) > 5 and (a in b or b in a):
        return True, 1.0, "contain"
    x, y = set(a.split()), set(b.split())
    sort = lambda s: " ".join(sorted(s.split()))
    rules = (
        ("sequence", lambda: SequenceMatcher(None, a, b).ratio()),
        ("token_set", lambda: len(x & y) / len(x | y)),
        ("sorted", lambda: SequenceMatcher(None, sort(a), sort(b)).ratio()),
    )
    best = 0.0
    for name, score in rules:
        s = score()
        if s >= threshold:
            return True, s, name
        best = max(best, s)
    return False, best, "none"


def compare(a: Column, b: Column, threshold: float = 0.85) -> Column:
    """struct(match, score, method) of two normalised names."""

    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for x, y in parts:
            yield pd.DataFrame([best_match(p, q, threshold) for p, q in zip(x, y)], columns=["match", "score", "method"])

    return F.pandas_udf(run, "match boolean, score double, method string")(a, b)


def initials(c: Column) -> Column:
    """First letters of all words but the last, then the last word: "budi adi putra" is "b a putra"."""
    words = F.split(squeeze(c), " ")
    n = F.size(words)
    return F.when(n > 1, F.concat_ws(" ", F.transform(F.slice(words, F.lit(1), n - 1), lambda w: F.substring(w, 1, 1)), F.element_at(words, -1))).otherwise(c)


def signature(c: Column) -> Column:
    """Words in alphabetical order."""
    return F.array_join(F.array_sort(F.split(squeeze(c), " ")), " ")


def abbreviates(short: str | None, full: str | None) -> bool:
    """Whether a name may stand for another: same words in any order, or the last word whole and the rest as initials."""
    a, b = (short or "").split(), (full or "").split()
    if not a or not b:
        return False
    if sorted(a) == sorted(b):
        return True
    rest = list(b)
    for word in sorted(a, key=len, reverse=True):
        found = next((w for w in rest if w == word), None)
        if found is None and len(word) <= 2:
            found = next((w for w in rest if w[:1] == word[:1]), None)
        if found is None:
            return False
        rest.remove(found)
    return any(len(w) > 2 and w in b for w in a)


is_abbreviation = _each(abbreviates, T.BooleanType())
