"""Words of folded texts as 64-bit codes, computed for many texts at once with NumPy.

A *folded* text is lower case and without accents; its words are its runs of letters and
digits.  The code of a word is a polynomial hash of its characters, so equal words have equal
codes in every task and no vocabulary has to be shared.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

_BMP = 0x10000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_CHUNK = 2_000_000
#: Kinds of characters: no part of a word, a digit, a mark that is dropped, a Latin letter, another letter.
_OTHER, _DIGIT, _MARK, _LATIN, _LETTER = 0, 1, 2, 3, 4


def _kind(cp: int) -> int:
    c = chr(cp)
    if unicodedata.category(c) == "Mn":
        return _MARK
    if not c.isalnum():
        return _OTHER
    if not c.isalpha():
        return _DIGIT
    return _LATIN if cp < 0x250 or 0x1E00 <= cp < 0x1F00 or 0xFB00 <= cp < 0xFB07 else _LETTER


_TABLE: np.ndarray | None = None
_POW: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _TABLE, _POW
    if _TABLE is None:
        _TABLE = np.fromiter((0 if 0xD800 <= c < 0xE000 else _kind(c) for c in range(_BMP)), np.uint8, _BMP)
        with np.errstate(over="ignore"):
            _POW = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))
    return _TABLE, _POW


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
        return x ^ (x >> np.uint64(31))


def fold(text: str) -> str:
    """Lower case, compatibility forms resolved, accents still apart (they are dropped later)."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFKD", text.lower())


def _encode(folded: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table, power = _tables()
    cps = np.frombuffer("\0".join(folded).encode("utf-32-le", "replace"), np.uint32)
    small = np.minimum(cps, _BMP - 1)
    kind = table[small]
    far = np.flatnonzero(cps >= _BMP)
    if far.size:
        values, where = np.unique(cps[far], return_inverse=True)
        kind[far] = np.array([_kind(int(v)) for v in values], np.uint8)[where]
    marks = kind == _MARK
    if marks.any():
        cps, kind = cps[~marks], kind[~marks]
    letter = kind > _OTHER
    starts = np.flatnonzero(letter & ~np.concatenate(([False], letter[:-1])))
    ends = np.append(np.flatnonzero(cps == 0), cps.size)
    at_ends = lambda of: np.diff(np.concatenate(([0], np.cumsum(of), [0]))[np.concatenate(([0], ends))])
    latin = at_ends(kind == _LATIN) >= at_ends(kind == _LETTER)
    if not starts.size:
        return np.zeros(0, np.uint64), np.zeros(len(folded) + 1, np.int64), latin
    at = np.flatnonzero(letter)
    first = np.searchsorted(at, starts)
    place = np.arange(at.size) - np.repeat(first, np.diff(np.append(first, at.size)))
    with np.errstate(over="ignore"):
        value = (cps[at].astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, power.size - 1)]
        codes = mix(np.add.reduceat(value, first))
    bounds = np.concatenate(([0], np.searchsorted(starts, ends)))
    return codes, bounds.astype(np.int64), latin


def code_chunks(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the first text, codes of all words, bounds of the texts in them, mainly Latin or not) of runs of texts.

    A null or empty text has no words.  Work goes in chunks of some two million characters, so that long
    batches and very long texts stay within memory.
    """
    start, size, part = 0, 0, []
    for i in range(len(texts) + 1):
        if part and (i == len(texts) or size >= _CHUNK):
            yield (start, *_encode(part))
            start, size, part = i, 0, []
        if i < len(texts):
            t = fold((texts[i] or "").replace("\0", " "))
            part.append(t)
            size += len(t)


def word_codes(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index of the text, codes of its words in order) for every text."""
    for start, codes, bounds, _ in code_chunks(texts):
        for k in range(bounds.size - 1):
            yield start + k, codes[bounds[k] : bounds[k + 1]]


def shingles(codes: np.ndarray, width: int) -> np.ndarray:
    """Codes of the runs of ``width`` consecutive words, in order, repeats included."""
    n = codes.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for k in range(width):
            total = total * np.uint64(0x100000001B3) + codes[k : k + n]
    return mix(total)


def shingles_of_many(codes: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs, index of their text) of many texts at once; texts of fewer words have none."""
    runs = shingles(codes, width)
    owner = np.repeat(np.arange(bounds.size - 1), np.diff(bounds))[: runs.size]
    inside = np.arange(runs.size) + width <= bounds[1:][owner] if runs.size else np.zeros(0, bool)
    return runs[inside], owner[inside]
