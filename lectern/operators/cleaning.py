"""Cleaning, masking and rewriting of extracted text, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lectern.functions import lexicon, text as tx


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_pdf(text: Column | str) -> Column:
    """Without soft hyphens and line-end hyphens, a blank after punctuation, dashes and runs of blanks as one blank.

    A decimal point before a digit gets its blank, too.
    """
    t = F.replace(_c(text), F.lit("­"), F.lit(""))
    t = F.regexp_replace(t, r"-[\r\n]+([a-záéíóúüñ])", "$1")
    t = F.regexp_replace(t, r"([.!?;:,])([A-ZÁÉÍÓÚÜÑ\d¿¡])", "$1 $2")
    t = F.translate(t, "–—", "  ")
    return F.regexp_replace(t, r"[ \t\r\f\x0B]{2,}", " ")


def dehyphen(text: Column | str) -> Column:
    """Words parted by a hyphen and white space joined; all white space as one blank."""
    t = F.regexp_replace(text, r"([\p{L}\p{N}_]+)-\s+([\p{L}\p{N}_]+)", "$1$2")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def without_toc(text: Column | str) -> Column:
    """Without lines of contents, page headers, captions and headings in capitals; empty lines stay."""

    def keep(line: Column) -> Column:
        t = F.trim(line, F.lit(" \t\r"))
        letters, capitals = F.length(F.regexp_replace(t, r"[^\p{L}]", "")), F.length(F.regexp_replace(t, r"[^\p{Lu}]", ""))
        verb = t.rlike("(?u)" + lexicon.CONTENT_VERBS)
        listed = (F.length(t) < 120) & (t.rlike(r"\d{1,4}\s*$") | t.rlike(r"\.{3,}")) & ~verb
        loud = (F.length(t) <= 80) & (letters > 0) & (capitals >= 0.75 * letters) & ~verb
        return (t == "") | ~(t.rlike("(?u)" + lexicon.PAGE_HEADER) | t.rlike("(?u)" + lexicon.DOCUMENT_HEADER) | listed | t.rlike("(?u)" + lexicon.CAPTION) | loud)

    return F.array_join(F.filter(F.split(_c(text), "\n", -1), keep), "\n")


def without_noise(text: Column | str) -> Column:
    """Every pattern of noise, in order, replaced by a blank."""
    t = _c(text)
    for p in lexicon.NOISE_PATTERNS:
        t = F.regexp_replace(t, p, " ")
    return F.trim(t, F.lit(" \n\t\r"))


def clean(text: Column | str) -> Column:
    """normalize_pdf, without_toc and without_noise."""
    return without_noise(without_toc(normalize_pdf(text)))


#: Abbreviations that end no sentence.
ABBREVIATIONS = "Dr|Dra|Sr|Sra|Srta|Prof|Dpto|Fig|Tab|Ec|Eq|et\\s+al|ej|pag|pags|vol|num|nums|approx|etc|art|arts|cap|ed|eds|coord|trad"
_HOLD = ""


def sentences(text: Column | str) -> Column:
    """Sentences of a text: parted before a capital, digit, or opening mark, not after an abbreviation."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"([.!?])([A-ZÁÉÍÓÚÜÑ])", "$1 $2")
    t = F.regexp_replace(t, rf"(?iu)\b({ABBREVIATIONS})\.", "$1" + _HOLD)
    parts = F.split(t, r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÜÑ\d¿¡])", -1)
    return F.filter(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit(_HOLD), F.lit(".")), F.lit(" \n\t\r"))), lambda x: x != "")


def installed_segmenter() -> Callable[[str], list[str]] | None:
    """The sentence segmenter of an installed library, or none."""
    try:
        from nltk.tokenize import sent_tokenize

        sent_tokenize("Una prueba. Otra.", language="spanish")
        return lambda t: sent_tokenize(t, language="spanish")
    except Exception:
        return None


def sentences_by(df: DataFrame, id_col: str, text_col: str, segmenter: Callable[[str], list[str]] | None) -> DataFrame:
    """(id, idx, sentence) by the given segmenter, or by ``sentences`` where there is none."""
    if segmenter is None:
        return df.select(id_col, F.posexplode(sentences(text_col)).alias("idx", "sentence"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(i, k, s) for i, t in zip(pdf["id"], pdf["text"]) for k, s in enumerate(segmenter(t or ""))], columns=[id_col, "idx", "sentence"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, idx int, sentence string")


def section_hint(text: Column | str, at: Column) -> Column:
    """The last line in the 500 characters before a place that may be a heading, or ``unknown``."""
    start = F.greatest(at - 500, F.lit(0))
    lines = F.transform(F.split(F.substring(_c(text), start + 1, at - start), "\n", -1), lambda x: F.trim(x, F.lit(" \t\r")))
    fit = F.filter(lines, lambda x: (F.length(x) > 3) & (F.length(x) < 70) & (F.right(x, F.lit(1)) != ".") & (F.left(x, F.lit(1)) != "["))
    return F.coalesce(F.left(F.try_element_at(fit, F.lit(-1)), F.lit(60)), F.lit("unknown"))


MASK = "[MASK]"


def mask(text: Column | str, keywords: Column) -> Column:
    """Every keyword as a word in any case replaced by [MASK], the longest first; white space squeezed."""
    longest = F.array_sort(F.transform(keywords, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("k"))))
    return tx.squeeze(F.aggregate(longest, _c(text), lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?iuU)\b"), tx.escape(x["k"]), F.lit(r"\b")), F.lit(MASK))))


def soft_mask(text: Column | str) -> Column:
    """The fixed keywords masked in one pass, the longest first at each place."""
    words = "|".join(sorted(lexicon.SOFT_MASK_KEYWORDS, key=lambda k: (-len(k), k)))
    return F.trim(F.regexp_replace(F.regexp_replace(_c(text), rf"(?iu)\b({words})\b", r"\[MASK\]"), r"\s+", " "))


def mask_listed(text: Column | str, listed: Column) -> Column:
    """Keywords of a comma-separated list masked; a null list leaves the text untouched."""
    keys = F.filter(F.transform(F.split(listed, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(listed.isNull(), _c(text)).otherwise(mask(text, keys))


def mask_count(text: Column | str) -> Column:
    """How many masks a text has."""
    return F.regexp_count(text, F.lit(r"\[MASK\]"))


def truncate_around(text: Column | str, key: Column, keywords: Column, size: int = 240, jitter: int = 160, least: int = 40, seed: int = 42) -> Column:
    """Texts of more than size + jitter words as a window of size +- jitter words around a keyword, or their head.

    The keyword is the first of the row's own, in their order, that stands in the text in any case; without one, or with a
    null list, the window is the head.  The jitter comes from a hash of seed and key.  No window is longer than the text.
    """
    words = tx.words(text)
    n = F.size(words)
    width = F.least(n, F.greatest(F.lit(least), size + F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2 * jitter + 1)).cast("int") - jitter))
    low = F.lower(_c(text))
    places = F.filter(F.transform(keywords, lambda k: F.position(F.lower(k), low)), lambda at: at > 0)
    before = tx.word_count(F.left(low, F.coalesce(F.get(places, F.lit(0)), F.lit(1)) - 1))
    start = F.greatest(F.lit(0), F.least(before - F.floor(width / 2).cast("int"), n - width))
    return F.when(n <= size + jitter, _c(text)).otherwise(F.array_join(F.slice(words, start + 1, width), " "))


def neutralize(text: Column | str, hits: Column | str) -> Column:
    """The first place of each hit's wording replaced by the neutral wording of its sign, or by nothing."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.NEUTRALIZATIONS.items() for x in kv])

    def one(t: Column, hit: Column) -> Column:
        new = F.replace(F.replace(F.coalesce(F.try_element_at(table, hit["label"]), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        return F.regexp_replace(t, F.concat(F.lit("(?ius)^(.*?)"), tx.escape(hit["hit_text"])), F.concat(F.lit("$1"), new))

    return F.aggregate(_c(hits), _c(text), one)


def inject(text: Column | str, which: Column) -> Column:
    """A phrase of a contribution put before the text."""
    return F.concat(F.element_at(F.array(*[F.lit(p) for p in lexicon.INJECTION_PHRASES]), which.cast("int") + 1), F.lit(" "), _c(text))
