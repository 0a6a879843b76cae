"""Near-duplicate records with small edits.

Similarity is the Jaccard coefficient of word-shingle sets.  Candidates come from PartEnum signatures:
the features of a text are cut into ``N1`` partitions of ``N2`` smaller ones, and every subset of
``N2 - K2`` of the smaller ones of a partition makes a signature, so that two texts that differ in at most ``K2``
of them in any one partition share a signature.

*Features.*  PartEnum on the shingle sets themselves needs equal sizes and few differences: at a Jaccard
coefficient of 0.6, two sets of 290 three-word shingles may differ in 145 of them, so partitions would
hold two features each or none, and the text would need 400 signatures, many of them shared by half of
the corpus.  The feature domain here is therefore that of minima: one feature for each of ``FEATURES``
hash functions, its value the smallest hash among all shingles of the text.  All texts then have equally many
features (one size band), and two texts agree in each with the probability of their Jaccard
coefficient, whatever kind of edits parts them.  No shingle is left out, however common it is, so that
the texts of a family meet whatever its size.

*Certainty.*  With N1 = 12, N2 = 4, K2 = 1, a pair of coefficient J is missed with probability
(1 - 4 J**3 + 3 J**4)**12: 4.4e-4 at 0.6, 4e-5 at 0.65, 2e-6 at 0.7, 1e-9 at 0.8.  Texts that share a signature by everyday
wording are told apart by two bits of each of the 96 features: at a coefficient of at least the threshold, fewer
agree than asked for with probability 1e-5.  Candidates are then verified on the whole sets.

*Hot signatures.*  A signature of more than ``HOT`` texts (found from the signatures of one set in 64) is cut:
its texts fall into blocks, and each text carries one key for each block it has to meet, so that every
pair of blocks meets in a bucket of its own.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.text_sets import gram_set, many, shingle_sets
from lectern.llm.wordcodes import mix, shingles_of_many
from lectern.runtime import materialize, release

_PAIR = "set_a long, set_b long"
_TEXT = np.dtype([("set", "<i8"), ("bits", "<u8", 3)])
_ENTRY = np.dtype([("sig", "<u4"), ("text", "<u2")])
N1, N2, K2, FEATURES = 12, 4, 1, 96
#: Texts that make a bucket, and pairs that are compared at once.
TEXTS_A_BUCKET, PAIRS_AT_ONCE = 25_000, 500_000
#: Texts above which a signature is cut, the share of sets that is counted to find it, and how many may be listed.
HOT, COUNTED, LISTED = 4096, 64, 200_000
#: Bits of the filter that names the sets of candidates, and pairs that are verified together.
FILTER_BITS, PAIRS_A_CELL = 1 << 27, 20_000


def _slots() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, FEATURES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


_PICKS = np.array(list(combinations(range(N2), N2 - K2)))
SIGNATURES = N1 * len(_PICKS)


def features(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minima of texts, a row each.  starts: where each text's runs begin."""
    with np.errstate(over="ignore"):
        minima = np.empty((starts.size, FEATURES), np.uint64)
        for j, slot in enumerate(_slots()):
            minima[:, j] = np.minimum.reduceat(runs * slot >> np.uint64(24), starts)
    return minima


def signatures(minima: np.ndarray) -> np.ndarray:
    """``SIGNATURES`` 64-bit values a row, from the first N1 * N2 features."""
    parts = minima[:, : N1 * N2].reshape(-1, N1, N2)
    with np.errstate(over="ignore"):
        h = np.arange(N1, dtype=np.uint64)[:, None] * np.uint64(64) + np.arange(len(_PICKS), dtype=np.uint64)
        h = np.broadcast_to(h, (len(parts), *h.shape))
        for c in range(N2 - K2):
            h = mix(h * np.uint64(0x100000001B3) + parts[:, :, _PICKS[:, c]])
    return h.reshape(len(parts), -1)


def partenum(runs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The signatures of texts, a row each."""
    return signatures(features(runs, starts))


def two_bits(minima: np.ndarray) -> np.ndarray:
    """Two bits of each feature, 32 features a word."""
    code = (mix(minima) & np.uint64(3)).reshape(len(minima), -1, 32)
    return np.bitwise_or.reduce(code << np.arange(0, 64, 2, dtype=np.uint64), axis=2)


def least_alike(threshold: float) -> int:
    """How many features agree in their two bits in all but one of 100,000 pairs of Jaccard >= threshold."""
    p = threshold + (1 - threshold) / 4
    return int(FEATURES * p - 4.3 * (FEATURES * p * (1 - p)) ** 0.5)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many features texts agree by their two bits."""
    apart = x ^ y
    return FEATURES - np.bitwise_count((apart | apart >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(1, dtype=np.int64)


def _sign(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, two bits of the features) of packed texts."""
    runs, owner = shingles_of_many(*many(blobs), width)
    minima = features(runs, np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))))
    return signatures(minima), two_bits(minima)


def _hot(filled: DataFrame, width: int, total: int) -> dict[int, int]:
    """Blocks of each signature that many texts share: at most ``LISTED`` signatures, whatever the corpus."""
    least = max(HOT, total * SIGNATURES // LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                signs, _ = _sign(batch.column(0).to_pylist(), width)
                values, n = np.unique(signs, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.astype(np.int64)), pa.array(n)], names=["sig", "n"])

    some = filled.filter(F.pmod("set_id", F.lit(COUNTED)) == 0).select("codes").mapInArrow(run, "sig long, n long")
    many_ = some.groupBy("sig").agg(F.sum("n").alias("n")).filter(F.col("n") * COUNTED >= least).orderBy(F.desc("n")).limit(LISTED)
    return {r["sig"]: math.ceil(r["n"] * COUNTED / HOT) for r in many_.collect()}


def _cut(signs: np.ndarray, sets: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, text) of every signature of every text; a hot signature gives a key for each block that the text's block has to meet."""
    keys, text = signs.ravel(), np.repeat(np.arange(len(signs)), signs.shape[1])
    values, blocks = hot
    if not values.size:
        return keys, text
    at = np.searchsorted(values, keys)
    at[at == values.size] = 0
    is_hot = values[at] == keys
    if not is_hot.any():
        return keys, text
    n = blocks[at[is_hot]]
    mine = mix(sets[text[is_hot]].view(np.uint64)) % n.astype(np.uint64)
    other = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
    mine, sig = np.repeat(mine, n), np.repeat(keys[is_hot], n)
    with np.errstate(over="ignore"):
        cells = mix(sig + np.minimum(mine, other) * np.uint64(0x9E3779B97F4A7C15) + np.maximum(mine, other) * np.uint64(0x100000001B3) + np.uint64(1))
    return np.concatenate((keys[~is_hot], cells)), np.concatenate((text[~is_hot], np.repeat(text[is_hot], n)))


def _signatures(width: int, buckets: int, hot: tuple[np.ndarray, np.ndarray]):
    """Packs the signatures of a task's sets: a row a bucket and batch has the texts once and their keys."""

    def pack(sets: np.ndarray, signs: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        texts = np.empty(len(sets), _TEXT)
        texts["set"], texts["bits"] = sets, bits
        keys, text = _cut(signs, sets, hot)
        bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        bucket, sig, text = bucket[order], (keys[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), text[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        out = []
        for k in np.flatnonzero(np.diff(ends)).tolist():
            here, place = np.unique(text[ends[k] : ends[k + 1]], return_inverse=True)
            entry = np.empty(place.size, _ENTRY)
            entry["sig"], entry["text"] = sig[ends[k] : ends[k + 1]], place
            out.append((k, texts[here].tobytes(), entry.tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "texts", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            keys, blobs, held = [], [], 0
            for key, blob in zip(*(batch.column(k).to_pylist() for k in range(2))):
                if key not in seen:
                    seen.add(key)
                    keys.append(key)
                    blobs.append(blob)
                    held += len(blob)
                if held > 8_000_000 or len(keys) == 20_000:
                    yield pack(np.array(keys, np.int64), *_in_parts(blobs, width))
                    keys, blobs, held = [], [], 0
            if keys:
                yield pack(np.array(keys, np.int64), *_in_parts(blobs, width))

    return run


def _in_parts(blobs: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``_sign`` by megabytes, which fit the cache of a processor."""
    cuts = np.flatnonzero(np.diff(np.cumsum([len(b) for b in blobs]) // 1_000_000)) + 1
    parts = [_sign([blobs[i] for i in part.tolist()], width) for part in np.split(np.arange(len(blobs)), cuts)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _meet(threshold: float):
    """Pairs of sets that share a signature and may be near by their features."""
    least = least_alike(threshold)

    def pairs(rows: list[tuple[bytes, bytes]]) -> Iterator[np.ndarray]:
        texts = [np.frombuffer(t, _TEXT) for t, _ in rows]
        entries = [np.frombuffer(e, _ENTRY) for _, e in rows]
        base = np.cumsum([0, *[t.size for t in texts[:-1]]])
        text = np.concatenate([e["text"].astype(np.int64) + b for e, b in zip(entries, base)])
        sig = np.concatenate([e["sig"] for e in entries])
        texts = np.concatenate(texts)
        # sets are numbered in the bucket: copies of a set, from several tasks, are one
        sets, number = np.unique(texts["set"], return_inverse=True)
        bits = np.empty((sets.size, 3), np.uint64)
        bits[number] = texts["bits"]
        entry = np.sort(sig.astype(np.uint64) << np.uint64(32) | number[text].astype(np.uint64))
        entry = entry[np.concatenate(([True], entry[1:] != entry[:-1]))]
        sig, at = entry >> np.uint64(32), (entry & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edge = np.flatnonzero(sig[1:] != sig[:-1]) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [sig.size]))
        several = ends - starts > 1
        starts, sizes = starts[several], (ends - starts)[several]
        d = 1
        while starts.size:
            # each member against the one d places on, in many groups at once
            cut = np.flatnonzero(np.diff(np.cumsum(sizes - d) // PAIRS_AT_ONCE)) + 1
            for s, n in zip(np.split(starts, cut), np.split(sizes - d, cut)):
                a = np.arange(int(n.sum())) + np.repeat(s - np.cumsum(n) + n, n)
                a, b = at[a], at[a + d]
                near = alike(bits[a], bits[b]) >= least
                if near.any():
                    yield np.stack((sets[a[near]], sets[b[near]]), 1)  # members of a group are in order
            d += 1
            keep = sizes > d
            starts, sizes = starts[keep], sizes[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = defaultdict(list)
        for batch in batches:
            for k, texts, entries in zip(*(batch.column(c).to_pylist() for c in range(3))):
                held[k].append((texts, entries))
        for k in list(held):
            parts, waiting = [], 0
            for x in pairs(held.pop(k)):
                parts.append(x)
                waiting += len(x)
                if waiting > 1_000_000:  # a bucket's pairs leave in pieces
                    yield _pair_batch(parts)
                    parts, waiting = [], 0
            if parts:
                yield _pair_batch(parts)

    return run


def _pair_batch(parts: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate(parts)
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    x = x[np.concatenate(([True], (x[1:] != x[:-1]).any(1)))]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["set_a", "set_b"])


def _verify(threshold: float):
    """The pairs of a cell whose whole sets are near enough."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        codes = {k: np.frombuffer(c, np.uint32) for k, c in zip(sets.column("set_id").to_pylist(), sets.column("codes").to_pylist())}
        a, b = pairs.column("set_a").to_pylist(), pairs.column("set_b").to_pylist()
        keep = []
        for i in range(len(a)):
            p, q = codes[a[i]], codes[b[i]]
            at = np.searchsorted(p, q)
            at[at == p.size] = 0
            both = int((p[at] == q).sum())
            if both >= threshold * (p.size + q.size - both) - 1e-9:
                keep.append(i)
        return pa.table({"set_a": pa.array([a[i] for i in keep], pa.int64()), "set_b": pa.array([b[i] for i in keep], pa.int64())})

    return run


def named_only(rows: DataFrame, key: str, names: DataFrame) -> DataFrame:
    """The rows whose key may be among the names: all that are, and a share of the others of at most names / FILTER_BITS.

    The names become a filter of FILTER_BITS bits (16 MB, whatever their number), so that few rows travel to
    the join that decides.
    """
    position = lambda c: F.pmod(F.xxhash64(F.lit(7), c), F.lit(FILTER_BITS))
    bits = names.select(position(F.col(key)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bitmap"))
    asked = rows.withColumn("_p", position(F.col(key))).withColumn("_block", F.bitmap_bucket_number("_p")).withColumn("_p", F.bitmap_bit_position("_p"))
    octet = F.conv(F.hex(F.substring("_bitmap", F.expr("cast(_p div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    met = asked.join(F.broadcast(bits), "_block").filter(octet.bitwiseAND(F.expr("shiftleft(1, cast(_p % 8 as int))")) != 0)
    return met.select(*rows.columns)


def verify_pairs(candidates: DataFrame, sets: DataFrame, width: int, threshold: float) -> DataFrame:
    """The candidate pairs (set_a, set_b) whose sets (set_id, codes) have Jaccard >= threshold.

    Pairs fall into cells by the hashes of both sets, and a set goes once to each cell that needs it, so that the sets of
    a large family do not travel once a pair.  candidates is read several times: give a written table.
    """
    side = math.ceil(math.sqrt(candidates.count() / PAIRS_A_CELL)) or 1
    row = lambda c: F.pmod(F.xxhash64(c), F.lit(side))
    placed = candidates.withColumn("cell", row("set_a") * side + row("set_b"))
    need = placed.select("cell", F.explode(F.array("set_a", "set_b")).alias("set_id")).distinct().toDF("place", "set_id")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gram_set(x, width).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["set_id", "codes"])

    names = candidates.select(F.explode(F.array("set_a", "set_b")).alias("set_id"))
    one = named_only(sets.select("set_id", "codes"), "set_id", names).groupBy("set_id").agg(F.first("codes").alias("codes"))
    sent = one.mapInArrow(sets_of, "set_id long, codes binary").join(need, "set_id")
    return placed.groupBy("cell").cogroup(sent.groupBy("place")).applyInArrow(_verify(threshold), _PAIR)


def near_sets(sets: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs (set_a < set_b) of different sets with Jaccard >= threshold, each once, as a written table.

    ``sets`` has the columns of ``shingle_sets`` and is read several times: give a written table.
    """
    spark = sets.sparkSession
    filled = sets.filter("codes is not null").select("set_id", "codes")
    total = filled.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, total // TEXTS_A_BUCKET + 1)
    found = sorted(((k & 0xFFFFFFFFFFFFFFFF, n) for k, n in _hot(filled, width, total).items()))
    hot = np.array([k for k, _ in found], np.uint64), np.array([n for _, n in found], np.int64)
    packed = filled.mapInArrow(_signatures(width, buckets, hot), "bucket int, texts binary, entries binary")
    met = materialize(packed.repartition(buckets, "bucket").mapInArrow(_meet(threshold), _PAIR).distinct(), "neardup-candidates")
    links = materialize(verify_pairs(met, filled, width, threshold), "neardup-links")
    release(met)
    return links


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, *, width: int = 5, threshold: float = 0.8, min_words: int = 1, latin_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links), two written tables: members (id, set_id) has a row an id; links the near pairs of sets.

    Null or short texts take no part; rows with equal id count once; equal sets are one class and need no
    link.  An empty table gives two empty results.  Copies are never expanded into pairs.
    """
    sets = materialize(shingle_sets(df, id_col, text_col, width, min_words, latin_only), "neardup-sets")
    links = near_sets(sets, width, threshold)
    members = materialize(sets.select("id", "set_id").distinct(), "neardup-members")
    release(sets)
    return members, links


def pairs_of_ids(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs id_a < id_b whose sets are equal or linked."""
    a = members.select(F.col("id").alias("id_a"), F.col("set_id").alias("set_a"))
    b = members.select(F.col("id").alias("id_b"), F.col("set_id").alias("set_b"))
    equal = a.join(b, (F.col("set_a") == F.col("set_b")) & (F.col("id_a") < F.col("id_b"))).select("id_a", "id_b")
    near = links.join(a, "set_a").join(b, "set_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    return equal.unionByName(near)
