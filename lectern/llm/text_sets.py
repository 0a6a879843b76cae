"""Word-shingle sets of texts, kept as packed word codes.

One row a text: ``id``, ``tag``, ``set_id`` (hash of its shingle set, equal for equal sets), ``n`` (size of the
set) and ``codes`` (32-bit codes of its words, in order, little endian).  Within a task ``codes`` is
filled for the first row of a set only, so copies cost a few bytes each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.wordcodes import code_chunks, mix, shingles, shingles_of_many

SET_SCHEMA = "id long, tag string, set_id long, n int, codes binary"


def many(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds) of packed texts, one after the other."""
    bounds = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int64)
    return np.frombuffer(b"".join(blobs), np.uint32).astype(np.uint64), bounds


def distinct(values: np.ndarray) -> np.ndarray:
    """The values once each, in order; sorting is several times as fast here as ``numpy.unique``, which hashes."""
    v = np.sort(values)
    return v[np.concatenate(([True], v[1:] != v[:-1]))] if v.size else v


def grams(codes: bytes | np.ndarray, width: int) -> np.ndarray:
    """32-bit hashes of the runs of ``width`` words, in order; a shorter text is one run."""
    c = np.frombuffer(codes, np.uint32) if isinstance(codes, bytes) else codes
    return (shingles(c.astype(np.uint64), min(width, max(c.size, 1))) >> np.uint64(32)).astype(np.uint32)


def gram_set(codes: bytes | np.ndarray, width: int) -> np.ndarray:
    """The same as a sorted set."""
    return distinct(grams(codes, width))


def shingle_sets(df: DataFrame, id_col: str, text_col: str, width: int, min_words: int, latin_only: bool, tag: Column | None = None) -> DataFrame:
    """The sets of all texts with at least ``min_words`` words (and ``width``), as above.

    Null and shorter texts, and with ``tag`` those of a null tag, give no row.  Repeated rows give repeated
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for batch in batches:
            ids, tags, texts = (batch.column(k).to_pylist() for k in range(3))
            rows: list[tuple] = []
            for first, codes, bounds, latin in code_chunks(texts):
                short = (codes >> np.uint64(32)).astype(np.uint32)
                sizes = np.diff(bounds)
                fit = sizes >= max(min_words, width)
                if latin_only:
                    fit &= latin
                runs, owner = shingles_of_many(short.astype(np.uint64), bounds, width)
                pairs = distinct(owner.astype(np.uint64) << np.uint64(32) | runs >> np.uint64(32))
                owner, found = (pairs >> np.uint64(32)).astype(np.int64), pairs & np.uint64(0xFFFFFFFF)
                counts = np.bincount(owner, minlength=sizes.size)
                hashes = np.zeros(sizes.size, np.uint64)
                filled = np.flatnonzero(counts)
                if filled.size:
                    with np.errstate(over="ignore"):
                        hashes[filled] = np.add.reduceat(mix(found + np.uint64(0x9E3779B97F4A7C15)), np.concatenate(([0], np.cumsum(counts[filled])[:-1])))
                        hashes = mix(hashes + counts.astype(np.uint64))
                keys = hashes.astype(np.int64).tolist()
                for k in np.flatnonzero(fit).tolist():
                    i = first + k
                    key = (tags[i], keys[k])
                    rows.append((ids[i], tags[i], keys[k], int(counts[k]), None if key in seen else short[bounds[k] : bounds[k + 1]].tobytes()))
                    seen.add(key)
            columns = list(zip(*rows)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SET_SCHEMA.split(", ")])

    rows = df.select(F.col(id_col).cast("long").alias("id"), (F.lit("") if tag is None else tag).alias("tag"), F.col(text_col).alias("text"))
    return rows.filter("id is not null and tag is not null and text is not null").mapInArrow(run, SET_SCHEMA)
