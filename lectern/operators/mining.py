"""Overlapping fragments of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.functions import text as tx
from lectern.operators import cleaning, rhetoric, segmentation

_WINDOWS = "idx int, text string, word_count int, char_start int, char_end int, relative_pos double, section_hint string"


def window_ends(sizes: np.ndarray, closing: np.ndarray, min_words: int, max_words: int) -> tuple[np.ndarray, np.ndarray]:
    """For a window that begins at each sentence: the sentence after its last, and its words.

    A window ends with the first closing sentence at which it has min_words, or where it reaches max_words, or with the text.
    Both places are looked up in the running sum of words.
    """
    n = sizes.size
    through = np.concatenate(([0], np.cumsum(sizes)))
    begin = through[:-1]
    full = np.minimum(np.searchsorted(through, begin + max_words), n)
    long = np.searchsorted(through, begin + min_words)
    # the first closing sentence at or after each place; behind the last there is none
    closed = np.concatenate((np.minimum.accumulate(np.where(closing, np.arange(1, n + 1), n + 1)[::-1])[::-1], [n + 1, n + 1]))
    ends = np.minimum(full, closed[np.minimum(np.maximum(long, 1) - 1, n)])
    return ends, through[ends] - begin


def windows_of(sentences: list[str], min_words: int, max_words: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first sentence, after the last, words) of the windows of a text; each begins ``overlap`` sentences before the end of the one before."""
    sizes = np.array([len(s.split()) for s in sentences], np.int64)
    ends, words = window_ends(sizes, np.array([s.rstrip()[-1:] in (".", "?", "…") for s in sentences], bool), min_words, max_words)
    out, at = [], 0
    while at < sizes.size and words[at] >= min_words:
        out.append((at, int(ends[at]), int(words[at])))
        at = max(at + 1, int(ends[at]) - overlap)
    return out


def heading_before(text: str, at: int) -> str:
    """The last line in the 500 characters before a place that may be a heading, or ``unknown``."""
    lines = (x.strip(" \t\r") for x in reversed(text[max(at - 500, 0) : at].split("\n")))
    return next((x[:60] for x in lines if 3 < len(x) < 70 and x[-1] != "." and x[0] != "["), "unknown")


def sliding_fragments(df: DataFrame, id_col: str, text_col: str, *, min_words: int = 250, max_words: int = 1000, overlap: int = 2, least_chars: int = 300) -> DataFrame:
    """Windows of sentences with their place in the raw text and the heading before it.

    The place is that of the first 30 characters of the first sentence in the raw text, 0 if not found.
    Documents below ``least_chars`` characters or three sentences give none; null texts neither.
    """
    kind = dict(df.dtypes)[id_col]
    names = ["id", *[c.split()[0] for c in _WINDOWS.split(", ")]]
    types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for row, (sentences, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if len(sentences) < 3:  # decided here: a filter would make the sentences twice
                    continue
                for k, (a, b, words) in enumerate(windows_of(sentences, min_words, max_words, overlap)):
                    text, start = " ".join(sentences[a:b]), max(raw.find(sentences[a][:30]), 0)
                    keep.append(row)
                    rows.append((k, text, words, start, min(len(raw), start + len(text)), round(start / len(raw), 4), heading_before(raw, start)))
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]], names=names)

    rows = df.filter(F.length(text_col) >= least_chars).select(F.col(id_col).alias("id"), cleaning.sentences(cleaning.clean(text_col)).alias("sentences"), F.col(text_col).alias("raw"))
    return rows.mapInArrow(run, f"id {kind}, {_WINDOWS}").withColumnRenamed("id", id_col)


def labelled_snippets(docs: DataFrame, id_col: str, text_col: str, enough: int, min_words: int = 250, max_words: int = 350) -> DataFrame:
    """(id, category, regex_score, idx, snippet, word_count): the best clean snippet of each document and section.

    The earlier snippet wins among equals.  Documents are taken in the order of id until every section that occurs has
    ``enough`` of them: the document with which the last section gets there is found by a top-n of each section.
    """
    snippets = docs.select(F.col(id_col).alias("id"), F.posexplode(segmentation.word_windows(text_col, min_words, max_words)).alias("idx", "snippet")).filter(segmentation.is_clean("snippet"))
    rows = snippets.select("id", "idx", "snippet", rhetoric.threshold_section("snippet").alias("s")).filter("s is not null")
    best = F.max_by(F.struct("idx", "snippet"), F.struct(F.col("s.count"), -F.col("idx"))).alias("b")
    found = rows.groupBy("id", F.col("s.label").alias("category")).agg(best, F.max("s.count").alias("regex_score"))
    found = found.select("id", "category", "regex_score", "b.idx", "b.snippet", tx.word_count("b.snippet").alias("word_count"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("id"))
    full = found.select("category", "id", place.alias("k")).filter(F.col("k") <= enough).groupBy("category").agg(F.count("*").alias("n"), F.max("id").alias("at"))
    end = full.agg(F.count_if(F.col("n") == enough).alias("reached"), F.max("at").alias("_end"))
    end = end.select(F.when(F.col("reached") == F.lit(len(rhetoric.SECTION_ORDER)), F.col("_end")).alias("_end"))
    return found.join(F.broadcast(end)).filter(F.col("_end").isNull() | (F.col("id") <= F.col("_end"))).drop("_end").withColumnRenamed("id", id_col)
