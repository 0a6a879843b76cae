"""Keys under which spellings of one document, category or source are the same."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Hashes of empty content (MD5, SHA-1 and SHA-256 begin so) and usual placeholders.
EMPTY_HASHES = ("", "d41d8cd98f00", "da39a3ee5e6b", "e3b0c44298fc", "none", "null", "nan", "n/a", "na", "-", "unknown", "undefined")


def plain(c: Column | str) -> Column:
    """Lower case, no outer blanks, and no hyphen, blank or underscore inside; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "")


def plain_doc(c: Column | str) -> Column:
    """A document's name: lower case, no outer blanks, no file ending; an empty name is null."""
    c = F.col(c) if isinstance(c, str) else c
    name = F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"^\s+|\s+$", "")), r"(\.(txt|pdf|json|jsonl|docx?|xml|html?|md|csv|gz|tex|odt|rtf))+$", ""))
    return F.when(name != "", name)


def content_hash(c: Column | str) -> Column:
    """A content hash without outer blanks, in lower case; null where it says nothing about content."""
    c = F.col(c) if isinstance(c, str) else c
    h = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    digest = F.regexp_replace(h, r"(?s)^(.{12}).*$", "$1")
    return F.when(~digest.isin(*EMPTY_HASHES) & ~h.rlike(r"^(0+|f+|x+|\?+|-+)$"), h)


def source_of(c: Column | str) -> Column:
    """The collection a document name begins with."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
