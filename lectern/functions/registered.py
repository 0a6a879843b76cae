"""Functions of this library under names that SQL can call."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import SparkSession, functions as F

from lectern.operators.mining import windows_of


class SlidingFragments:
    """(idx, first, words, text) of the windows of an array of sentences."""

    def eval(self, sentences: list, min_words: int, max_words: int, overlap: int):
        for k, (a, b, n) in enumerate(windows_of(list(sentences or []), min_words, max_words, overlap)):
            yield k, a, n, " ".join(sentences[a:b])


def _gathered(parts: list[str], alone, least: int) -> list[str]:
    """Parts joined until they have ``least`` words; one that stands alone closes what is before it."""
    groups: list[list[str]] = [[]]
    words = 0
    for p in parts:
        if alone(p):
            groups += [[p], []]
            words = 0
            continue
        groups[-1].append(p)
        words += len(p.split())
        if words >= least:
            groups.append([])
            words = 0
    return [" ".join(g) for g in groups if g]


def paragraphs_of(text: str | None, least: int = 25) -> list[str]:
    """The same as ``segmentation.paragraphs`` of one text."""
    text = text or ""
    blocks = [b for x in re.split(r"\n{2,}", text) if (b := x.strip(" \n\t\r"))]
    if len(blocks) > 1:
        return blocks
    lines = [b for x in text.split("\n") if (b := x.strip(" \n\t\r"))]
    if len(lines) > 3:
        return _gathered(lines, lambda x: len(x.split()) <= 5 and bool(re.match("[A-ZAEIOUÜN]", x)), least)
    return [g for g in _gathered(re.split(r"(?<=[.!?])\s+", text), lambda x: False, least) if g.strip(" ")] or [text]


#: Cohen's kappa of a 2x2 table of agreement; 0 without rows, 1 where chance agreement is certain.
KAPPA = """CREATE OR REPLACE TEMPORARY FUNCTION kappa(n11 BIGINT, n00 BIGINT, n10 BIGINT, n01 BIGINT) RETURNS DOUBLE RETURN
 CASE WHEN n11 + n00 + n10 + n01 = 0 THEN 0D
 WHEN (n11 + n10) * (n11 + n01) + (n00 + n10) * (n00 + n01) = (n11 + n00 + n10 + n01) * (n11 + n00 + n10 + n01) THEN 1D
 ELSE ((n11 + n00) * (n11 + n00 + n10 + n01) - ((n11 + n10) * (n11 + n01) + (n00 + n10) * (n00 + n01)))
  / ((n11 + n00 + n10 + n01) * (n11 + n00 + n10 + n01) - ((n11 + n10) * (n11 + n01) + (n00 + n10) * (n00 + n01))) END"""


def register(spark: SparkSession) -> None:
    """Make ``split_paragraphs(text)``, ``kappa(n11, n00, n10, n01)`` and the table function ``sliding_fragments`` known to a session."""
    spark.sql(KAPPA)
    spark.udf.register("split_paragraphs", F.pandas_udf(_paragraphs, "array<string>"))
    spark.udtf.register("sliding_fragments", F.udtf(SlidingFragments, returnType="idx: int, first: int, words: int, text: string"))


def _paragraphs(texts: pd.Series) -> pd.Series:
    return texts.map(paragraphs_of)
