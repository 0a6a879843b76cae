"""Text functions as Column expressions, with Unicode classes and case folding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_FLAGS = "(?iuU)"


def jvm(pattern: str, flags: str = _FLAGS) -> str:
    """A pattern of ``lexicon`` for Java: any case, Unicode classes."""
    return flags + pattern


def duck(pattern: str, flags: str = "(?i)") -> str:
    """The same for RE2, as a literal of DuckDB's SQL; RE2's word class is ASCII."""
    return flags + pattern.replace(r"\w", r"[\p{L}\p{N}_]").replace("'", "''")


def matches(c: Column | str, pattern: str, flags: str = _FLAGS) -> Column:
    """How often the pattern matches; null text counts as none."""
    return F.coalesce(F.regexp_count(c, F.lit(flags + pattern)), F.lit(0))


def has(c: Column | str, pattern: str, flags: str = _FLAGS) -> Column:
    """Whether the pattern matches; null text does not."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.rlike(flags + pattern), F.lit(False))


def words(c: Column | str) -> Column:
    """The words of a text, parted by any white space; none for a null or blank text."""
    return F.regexp_extract_all(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0))


def word_count(c: Column | str) -> Column:
    """The number of words parted by white space."""
    return F.regexp_count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"(?U)\S+"))


def token_count(c: Column | str) -> Column:
    """The number of runs of letters, digits and underscores (another number than word_count)."""
    return F.regexp_count(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit(r"(?U)\b\w+\b"))


def squeeze(c: Column | str) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^ | $", "")


def escape(c: Column) -> Column:
    """A literal as a pattern."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def half_even(c: Column) -> Column:
    """Rounding to a whole number, ties to even."""
    return F.rint(c)
