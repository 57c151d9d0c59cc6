"""The five ways in which source data says "empty". Each keeps text as text; none casts an id to a number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as empty, after trimming, in lower case.
EMPTY_ID = ("nan", "none", "null", "na", "")
EMPTY_VALUE = ("nan", "none", "null", "")
EMPTY_IDENTIFIER = ("nan", "none", "null", "", "nat", "check", "inf", "-inf")
EMPTY_TEXT = ("nan", "none", "")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")


def _unless(text: Column, empty: tuple[str, ...], otherwise: Column) -> Column:
    return F.when(text.isNull() | F.lower(text).isin(*empty), otherwise).otherwise(text)


def clean_id(c: Column, strict: bool = True) -> Column:
    """An id without a trailing ".0"; "" if empty. strict: only where the rest is digits; else from any text."""
    pattern = r"^(\d+)\.0$" if strict else r"(?s)^(.*)\.0$"
    return _unless(F.regexp_replace(trimmed(c), pattern, "$1"), EMPTY_ID, F.lit(""))


def clean_value(c: Column) -> Column:
    """For loading into the warehouse: NULL if empty, not a number or infinite; ".0" goes from digits only."""
    return _unless(F.regexp_replace(trimmed(c), r"^(\d+)\.0$", "$1"), (*EMPTY_VALUE, "inf", "-inf", "infinity", "-infinity"), F.lit(None))


def clean_identifier(c: Column) -> Column:
    """NULL if empty by the widest rule; whole numbers lose ".0"."""
    return _unless(F.regexp_replace(trimmed(c), r"^(\d+)\.0$", "$1"), EMPTY_IDENTIFIER, F.lit(None))


def safe_text(c: Column, default: str = "") -> Column:
    return _unless(trimmed(c), EMPTY_TEXT, F.lit(default))


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or blank."""
    return F.coalesce(*[F.nullif(trimmed(c), F.lit("")) for c in columns])
