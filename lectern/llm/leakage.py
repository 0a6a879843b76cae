"""Passages of evaluation items inside a large corpus: pigeonhole edit matching.

A passage of ``run`` consecutive words with at most ``errors`` words wrong contains one of
``errors + 1`` pieces unharmed.  Pieces of every position of every item are looked up in the
documents by their hash; every window of an item that a hit may belong to is then verified by Myers' bit-parallel
edit distance over words, many windows at once.  Its least distance decides: 0 is a passage word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.text_sets import distinct
from lectern.llm.wordcodes import code_chunks, shingles, shingles_of_many, word_codes
from lectern.runtime import materialize, release

_BREAK = re.compile(r"(?<=[^\W\d_])(?:[-‐‑­¬][ \t]*\r?\n\s*|­)(?=[^\W\d_])")
_HIDDEN = re.compile("[​‌‍⁠﻿]")
#: Items that are held by a task at once; more are matched in blocks.
MAX_ITEMS = 20_000
#: Windows that are verified at once.
WINDOWS = 100_000


def unbroken(text: str) -> str:
    """The text with words that were broken at a line end joined, and invisible characters gone."""
    if text.isascii() and "-" not in text:
        return text
    return _BREAK.sub("", _HIDDEN.sub("", text))


def openings_of(text: str) -> list[tuple[int, int]]:
    """(characters, code of the folded words) of the first sentences or paragraphs of an item, up to four."""
    ends = [m.end() for m in re.finditer(r"[.!?:](?=\s)|\n", text)][:4]
    out = []
    for e, (_, codes) in zip(ends, word_codes([text[:e] for e in ends])):
        if codes.size:
            out.append((e, int(shingles(codes, codes.size)[0].view(np.int64))))
    return out


def passages(items: DataFrame, run: int, least: int = 3) -> DataFrame:
    """(item_id, codes) of the items of at least ``run`` words, without the opening instruction that ``least`` items or more begin with."""
    rows = items.select(F.col("item_id").cast("int").alias("item_id"), "text").filter("text is not null").dropDuplicates(["item_id"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, e, code) for i, t in zip(*(batch.column(k).to_pylist() for k in range(2))) for e, code in openings_of(t)]
            columns = list(zip(*found)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))], names=["item_id", "chars", "opening"])

    opened = rows.mapInArrow(begin, "item_id int, chars int, opening long")
    shared = opened.groupBy("opening").agg(F.countDistinct("item_id").alias("n")).filter(F.col("n") >= least).select("opening")
    cut = opened.join(shared, "opening").groupBy("item_id").agg(F.max("chars").alias("chars"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, chars = (batch.column(k).to_pylist() for k in range(3))
            got = [(ids[k], codes.tobytes()) for k, codes in word_codes([unbroken(t[c or 0 :]) for t, c in zip(texts, chars)]) if codes.size >= run]
            columns = list(zip(*got)) or [()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary()))], names=["item_id", "codes"])

    return rows.join(cut, "item_id", "left").select("item_id", "text", "chars").mapInArrow(encode, "item_id int, codes binary")


def myers_distance(pattern: np.ndarray, text: np.ndarray) -> int:
    """The least edit distance of the pattern to any stretch of the text (words as symbols)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[int, int] = {}
    for k, x in enumerate(pattern.tolist()):
        peq[x] = peq.get(x, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for x in text.tolist():
        eq = peq.get(x, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may begin anywhere in the text
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        best = min(best, score)
    return best


def myers_distances(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """``myers_distance`` of many pairs at once, a row each; patterns of up to 63 words."""
    n, m = patterns.shape
    one, full, top = np.uint64(1), np.uint64((1 << m) - 1), np.uint64(m - 1)
    bit = one << np.arange(m, dtype=np.uint64)
    pv, mv = np.full(n, full), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    for j in range(texts.shape[1]):
        eq = ((patterns == texts[:, j, None]) * bit).sum(1, dtype=np.uint64)
        xv = eq | mv
        with np.errstate(over="ignore"):
            xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
        ph, mh = ph << one & full, mh << one & full  # a match may begin anywhere in the text
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        np.minimum(best, score, out=best)
    return best


class ItemIndex:
    """Where the pieces of a block of items stand."""

    def __init__(self, ids: list[int], words: list[np.ndarray], run: int, errors: int):
        self.run, self.errors, self.width = run, errors, run // (errors + 1)
        self.ids = np.array(ids, np.int32)
        self.bounds = np.concatenate(([0], np.cumsum([w.size for w in words]))).astype(np.int64)
        self.words = np.concatenate([*words, np.zeros(0, np.uint64)])
        pieces, owner = shingles_of_many(self.words, self.bounds, self.width)
        sizes = np.maximum(np.diff(self.bounds) - self.width + 1, 0)
        place = np.arange(pieces.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.bounds[owner]
        order = np.argsort(pieces, kind="stable")
        self.hashes = distinct(pieces)
        self.first = np.searchsorted(pieces[order], self.hashes)
        self.count = np.diff(np.append(self.first, pieces.size))
        self.place, self.owner = place[order], owner[order]

    def leaks(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, item, words of the longest run in common, fewest word errors) for texts one after the other, each pair in one or more pieces."""
        if not self.hashes.size or not codes.size:
            return
        pieces, text = shingles_of_many(codes, bounds, self.width)
        sizes = np.maximum(np.diff(bounds) - self.width + 1, 0)
        place = np.arange(pieces.size) - np.repeat(np.cumsum(sizes) - sizes, sizes) + bounds[text]
        at = np.searchsorted(self.hashes, pieces)
        at[at == self.hashes.size] = 0
        hit = np.flatnonzero(self.hashes[at] == pieces)
        load = np.cumsum(self.count[at[hit]]) // WINDOWS
        # a text's hits stay together, so that its runs are seen whole
        cuts = np.flatnonzero((np.diff(load) > 0) & (np.diff(text[hit]) > 0)) + 1
        for part in np.split(hit, cuts):
            if part.size:
                yield self._verified(codes, bounds, text[part], place[part], at[part])

    def _verified(self, codes, bounds, text, place, at):
        n = self.count[at]
        which = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[at], n)
        text, p = np.repeat(text, n), np.repeat(place, n)
        item, q = self.owner[which], self.place[which]
        # runs: pieces side by side on one diagonal of one pair
        order = np.lexsort((p, p - q, item, text))
        text, item, p, q = text[order], item[order], p[order], q[order]
        new = np.ones(p.size, bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)
        starts = np.flatnonzero(new)
        length = np.diff(np.append(starts, p.size)) + self.width - 1
        pair = text * np.int64(self.ids.size) + item
        errors = np.full(p.size, self.run, np.int64)
        for k in range(self.errors + 1):  # the piece as the k-th of its window
            begin = q - k * self.width
            fits = np.flatnonzero((begin >= self.bounds[item]) & (begin + self.run <= self.bounds[item + 1]))
            for some in np.split(fits, range(WINDOWS, fits.size, WINDOWS)):
                pattern = self.words[begin[some][:, None] + np.arange(self.run)]
                lo = p[some] - k * self.width - self.errors
                where = lo[:, None] + np.arange(self.run + 2 * self.errors)
                inside = (where >= bounds[text[some]][:, None]) & (where < bounds[text[some] + 1][:, None])
                # beyond the ends of a text stands a word that no pattern has
                window = np.where(inside, codes[np.clip(where, 0, codes.size - 1)], np.uint64(0))
                errors[some] = np.minimum(errors[some], myers_distances(pattern, window))
        names, group = np.unique(pair, return_inverse=True)
        longest = np.zeros(names.size, np.int64)
        np.maximum.at(longest, group[starts], length)
        least = np.full(names.size, self.run, np.int64)
        np.minimum.at(least, group, errors)
        return names // self.ids.size, self.ids[names % self.ids.size], longest, least


LEAKS = "doc_id long, item_id int, longest_run int, errors int"


def leaked_passages(corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, *, run: int = 12, errors: int = 1) -> DataFrame:
    """Documents that hold a passage of ``run`` words of an item with at most ``errors`` word errors.

    items: (item_id, text), of any number: blocks of ``MAX_ITEMS`` at most are matched against all documents.  errors: the
    least edit distance in words of a passage; longest_run: the longest run of words in common, of at least
    run // (errors + 1).  Openings that several items share are no passage.  Folding ignores case, accents,
    punctuation, layout and line-end hyphens; a document is read with its broken words joined and, where
    that differs, as it stands.  Null texts and items shorter than ``run`` words match nothing;
    repeated rows of a document give one row.
    """
    held = materialize(passages(items, run), "leakage-items")
    blocks = held.count() // MAX_ITEMS + 1
    rows, found = corpus.selectExpr(f"cast(`{id_col}` as long) id", f"`{text_col}` text"), None
    for k in range(blocks):
        block = held.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        index = ItemIndex([r["item_id"] for r in block], [np.frombuffer(bytes(r["codes"]), np.uint64) for r in block], run, errors)
        part = rows.mapInArrow(_scan(corpus.sparkSession.sparkContext.broadcast(index), errors), LEAKS)
        found = part if found is None else found.unionByName(part)
    release(held)
    return found.groupBy("doc_id", "item_id").agg(F.max("longest_run").alias("longest_run"), F.min("errors").alias("errors"))


def _scan(shared, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for batch in batches:
            owner, forms = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    joined = unbroken(t)
                    owner.append(i)
                    forms.append(joined)
                    if joined != t:
                        owner.append(i)
                        forms.append(t)
            ids = np.array(owner, object)
            for first, codes, bounds, _ in code_chunks(forms):
                for text, item, longest, wrong in index.leaks(codes, bounds):
                    near = wrong <= errors
                    columns = (ids[first + text[near]].tolist(), item[near], longest[near], wrong[near])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "longest_run", "errors"])

    return run
