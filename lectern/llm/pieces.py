"""Cutting oversized items at natural boundaries.

The legal cuts of a text are the ends of its units (words; long runs without spaces are units of a
few characters, ending at their own marks where there are any).  For every unit at once, the farthest
legal end of a piece that begins there is looked up, and with the overlap its successor; squaring the
successor table again and again then marks all cuts of the greedy division from the first unit in a
logarithmic number of steps, for all texts of a batch together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PIECES = "id long, piece_index int, piece_count int, text string, word_count int, char_start int, char_end int"
_UNIT = re.compile(r"\S+")
#: Marks after which a run without spaces may be cut, and those that end a sentence.
_INNER = re.compile(r"[。！？；，、：।॥؟،]")
_END = re.compile(r"[.!?…。！？।॥؟]+[\"'”’»)\]」』]*$")
_CLAUSE = re.compile(r"[,;:，；：、—–)\]]+[\"'”’»]*$")
_LONG, _STEP = 64, 32


def units(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, kind of boundary after it, words begun up to and with it) of each unit of the text.

    Kinds: 3 paragraph, 2 sentence or line, 1 clause, 0 any word, -1 inside a word.
    """
    start, end, kind, word = [], [], [], []
    words, previous = 0, 0
    for m in _UNIT.finditer(text):
        a, b = m.span()
        if start:
            gap = text.count("\n", previous, a)
            if gap:
                kind[-1] = 3 if gap > 1 else max(kind[-1], 2)
        words += 1
        previous = b
        if b - a > _LONG:
            cuts = {a + x.end() for x in _INNER.finditer(m[0])} | {b}
            at = a
            for c in sorted(cuts):
                while c - at > _LONG:  # no mark for long: cut between characters
                    start.append(at)
                    at += _STEP
                    end.append(at)
                    kind.append(-1)
                    word.append(words)
                start.append(at)
                end.append(c)
                kind.append((2 if text[c - 1] in "。！？।॥؟" else 1) if c < b else 0)
                word.append(words)
                at = c
        else:
            start.append(a)
            end.append(b)
            kind.append(0)
            word.append(words)
        tail = text[max(a, b - 6) : b]
        if _END.search(tail):
            kind[-1] = 2
        elif _CLAUSE.search(tail):
            kind[-1] = max(kind[-1], 1)
    return tuple(np.array(x, np.int64) for x in (start, end, kind, word))


def successors(start: np.ndarray, end: np.ndarray, kind: np.ndarray, word: np.ndarray, max_words: int, max_chars: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(end unit, exclusive; first unit of the next piece) for pieces that begin at each unit."""
    n = start.size
    here = np.arange(n)
    by_chars = np.searchsorted(end, start + max_chars, "right")
    by_words = np.searchsorted(word, word + max_words, "left")
    limit = np.maximum(np.minimum(by_chars, by_words), here + 1)
    cut = limit.copy()
    done = limit == n
    least = here + np.maximum((limit - here) // 2, 1)  # a piece is filled by half at least
    for grade in (3, 2, 1, 0):
        last = np.maximum.accumulate(np.where(kind >= grade, here + 1, 0))[limit - 1]
        use = ~done & (last >= least)
        cut[use] = last[use]
        done |= use
    # the overlap in whole words; where words are longer than the limits' proportion, by characters
    back = np.searchsorted(word, word[cut - 1] - overlap, "right")
    near = np.searchsorted(start, end[cut - 1] - overlap * max_chars // max_words, "left")
    nxt = np.where(cut == n, n, np.clip(np.maximum(back, near), here + 1, cut))
    return cut, nxt


def marked(nxt: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """All units reached from ``firsts`` by following ``nxt`` (n means the end), by pointer doubling."""
    n = nxt.size
    table = np.append(nxt, n)
    on = np.zeros(n + 1, bool)
    on[firsts] = True
    while True:
        on[table[np.flatnonzero(on)]] = True
        if (table == n).all():
            break
        table = table[table]
    return np.flatnonzero(on[:n])


def cut_text(text: str, max_words: int, max_chars: int, overlap: int) -> list[tuple[int, int, int]]:
    """(char_start, char_end, word_count) of the pieces of a text, in order; a text of white space alone is cut at the limit."""
    start, end, kind, word = units(text)
    if not start.size:
        return [(a, min(a + max_chars, len(text)), 0) for a in range(0, len(text), max_chars)]
    cut, nxt = successors(start, end, kind, word, max_words, max_chars, overlap)
    out = []
    for i in marked(nxt, np.array([0])).tolist():
        a, b = int(start[i]), int(end[cut[i] - 1])
        out.append((a, b, int(word[cut[i] - 1] - word[i] + 1)))
    return out


def oversized(text: str, max_words: int, max_chars: int) -> bool:
    """More than max_words words, parted by white space, or more than max_chars characters."""
    return len(text) > max_chars or len(text) > 2 * max_words and len(text.split()) > max_words


def split_oversized(df: DataFrame, id_col: str, text_col: str, *, max_words: int = 1000, max_chars: int = 10_000, overlap: int = 50) -> DataFrame:
    """The pieces of every item over the limits; items within them, null and empty ones give no row.

    char_start and char_end (exclusive) count code points of the item's text, and
    ``text == item[char_start:char_end]``; word_count is that of the piece (0 in a text of white space alone).  Consecutive pieces share
    ``overlap`` words; where words are long, as in scripts without spaces, no more than the same share
    of max_chars as overlap is of max_words.  Pieces end at a
    paragraph, else a sentence, a clause or a word in the second half of the room they have, and inside
    a word only where it is longer than that.  Repeated rows of an id come out once.
    """
    if not 0 <= overlap < max_words // 2:
        raise ValueError("the overlap must be less than half of max_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if oversized(t, max_words, max_chars):
                    cuts = cut_text(t, max_words, max_chars, overlap)
                    rows += [(i, k, len(cuts), t[a:b], w, a, b) for k, (a, b, w) in enumerate(cuts)]
            columns = list(zip(*rows)) or [()] * 7
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in PIECES.split(", ")])

    # a text of more than max_words words has twice as many characters; this much is decided in the JVM
    least = min(max_chars, 2 * max_words)
    large = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > least)
    return large.mapInArrow(run, PIECES).dropDuplicates(["id", "piece_index"])
