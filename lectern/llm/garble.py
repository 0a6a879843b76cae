"""Text that was decoded with the wrong character encoding: finding and restoring it.

Every value has a latent *encoding chain*: the true encoding of its bytes and the one they were read
with (or none).  Undoing a chain gives a candidate original; its likelihood is that of a character
bigram model counted over the corpus.  Expectation-maximization pools the weak evidence of single
values: the share of each chain among the values of one source and field is the prior of the next
round, and each value is repaired by its posterior.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lectern.runtime import materialize

_BITS = 18
#: How the bytes were read, where they are UTF-8.
UTF8_READ_AS = ("cp1252", "cp437", "cp850", "cp1251", "mac_roman", "koi8_r", "cp1253", "cp1250")
#: Fixed values: (read as, true) of single-byte encodings.
SINGLE_BYTE = (
    ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "cp850"), ("cp1252", "cp437"), ("cp1251", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "koi8_r"), ("cp1252", "cp1251"), ("cp1252", "koi8_r"),
    ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1252", "cp1253"), ("cp1252", "iso8859_7"), ("cp1252", "cp1256"), ("cp1252", "iso8859_6"), ("cp1252", "cp874"), ("cp1250", "cp1252"), ("cp1253", "cp1252"), ("iso8859_5", "cp1251"),
)
#: Multi-byte encodings whose bytes were read as a Western single-byte one, or one another.
MULTI_BYTE = ("euc_jp", "shift_jis", "gb18030", "big5", "euc_kr")

NONE, LOSSY, GBK = "none", "lossy", "utf-8 read as gbk"


@cache
def _bytes_of(encoding: str) -> dict[str, int]:
    """Characters of the upper half of a single-byte encoding; bytes it leaves out stand for themselves."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        table[c] = b
    if encoding == "cp1252":
        table |= {chr(b): b for b in range(0x80, 0xA0)}
    return table


@cache
def _utf8_pattern(read_as: str) -> re.Pattern:
    table = _bytes_of(read_as)
    some = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"
    tail = some(0x80, 0xBF)
    return re.compile(f"{some(0xC2, 0xDF)}{tail}|{some(0xE0, 0xEF)}{tail}{{2}}|{some(0xF0, 0xF4)}{tail}{{3}}")


#: Signs beyond letters that writing in the corpus' languages uses.
_SIGNS = "¿¡«»ºª°·§©®²³¹½¼¾±µ×´¨£¥¢–—‘’‚“”„†‡•…‰‹›€™−≤≥√∞"


#: First and last code point of the scripts and signs a decoded character may belong to.
_SCRIPTS = ((0xA0, 0x24F), (0x300, 0x52F), (0x5D0, 0x6FF), (0x900, 0xEFF), (0x1E00, 0x206F), (0x2100, 0x22FF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF))


def _likely(c: str, any_control: bool) -> bool:
    cp = ord(c)
    return c in _SIGNS or any(lo <= cp <= hi for lo, hi in _SCRIPTS) or any_control and 0x80 <= cp < 0xA0


def undo_utf8(text: str, read_as: str, any_control: bool = False) -> tuple[str, int]:
    """Every place that is UTF-8 read as another encoding, decoded; and how many places."""
    table, hits = _bytes_of(read_as), 0

    def one(m: re.Match) -> str:
        nonlocal hits
        try:
            c = bytes(table[x] for x in m[0]).decode("utf-8")
        except UnicodeDecodeError:
            return m[0]
        if not _likely(c, any_control):
            return m[0]
        hits += 1
        return c

    out = _utf8_pattern(read_as).sub(one, text)
    return out, hits


@cache
def _single_table(read_as: str, true: str) -> dict[int, str]:
    table = {}
    for c, b in _bytes_of(read_as).items():
        try:
            table[ord(c)] = bytes([b]).decode(true)
        except UnicodeDecodeError:
            continue
    return table


_RUN = re.compile(r"[^\x00-\x7f]+")
_HIGH = re.compile(r"[\x80-\xffŒœŠšŸŽžƒˆ˜–-…‰‹›€™]{4,}")
_CJK = re.compile(r"[　-ヿ㐀-鿿가-힯＀-￯]")


def undo_gbk(text: str) -> tuple[str, int]:
    """Runs that are UTF-8 read as GBK, decoded; what was lost in reading stays a replacement character."""
    hits = 0

    def one(m: re.Match) -> str:
        nonlocal hits
        run = m[0]
        if len(run) < 3 or not _CJK.search(run):
            return run
        got = run.replace("�", "?").encode("gbk", "replace").decode("utf-8", "replace")
        good = len(_CJK.findall(got))
        if good >= 2 and good >= 0.35 * len(run) and good > 2 * got.count("�"):
            hits += good
            return got
        return run

    return _RUN.sub(one, text), hits


def undo_multi(text: str, true: str) -> tuple[str, int]:
    """Runs of Western characters that are a multi-byte encoding, decoded."""
    hits = 0
    table = _bytes_of("cp1252")

    def one(m: re.Match) -> str:
        nonlocal hits
        try:
            got = bytes(table.get(c, ord(c) & 0xFF) for c in m[0]).decode(true)
        except UnicodeDecodeError:
            return m[0]
        if 2 * len(_CJK.findall(got)) < len(got):
            return m[0]
        hits += len(got)
        return got

    return _HIGH.sub(one, text), hits


_LETTER, _C1, _CASE = re.compile(r"[^\W\d_]"), re.compile("[\x80-\x9f]"), re.compile("[a-zß-öø-ÿа-яё][A-ZÀ-ÖØ-ÞА-ЯЁ]")
#: Elided words before an apostrophe in French and Italian.
_ELISION = re.compile(r"\W*(?:[cdjlmnst]|qu|jusqu|lorsqu|puisqu|quoiqu|aujourd|dell|nell|all|sull|un)’(?=[aeiouyhàâæéèêëîïôœûü])", re.I)
_FOLD: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """Lower case, digits as 0 and white space as a blank, for the basic plane."""
    global _FOLD
    if _FOLD is None:
        table = np.arange(0x10000, dtype=np.uint32)
        for cp in range(0x10000):
            c = chr(cp)
            low = c.lower()
            table[cp] = 0x30 if c.isdecimal() else 0x20 if c.isspace() else ord(low) if len(low) == 1 else cp
        _FOLD = table
    return _FOLD


def _bigrams(text: str) -> np.ndarray:
    cps = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), np.uint32)
    cps = np.where(cps < 0x10000, _fold_table()[np.minimum(cps, 0xFFFF)], cps).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = (cps[:-1] << np.uint64(21) | cps[1:]) * np.uint64(0x9E3779B97F4A7C15)
    return (key >> np.uint64(64 - _BITS)).astype(np.int64)


#: Accented letters and signs of plain writing in the corpus' Latin languages.
_PLAIN = "áéíóúñüÁÉÍÓÚÑÜ¿¡àâãçèêëîïôõöäùûœÀÇÉÊÔÕ°ºª«»“”‘’–—…"
#: Characters that misread UTF-8 in Chinese often shows as.
_GBK_SIGNS = "鍦鐨绗缁鏄鍚璇濂浠銆锛鈥鎴涓鏂"
_LOWER_JOIN, _UPPER_JOIN = "—–’”“‘·…œ»«ºª°¡¿", "—–”“‘·…îêèôûïëàâ»«ºª°"
_IS_ODD, _JOINS_LOWER, _JOINS_UPPER, _LOWER, _UPPER, _FOREIGN, _QUOTE, _RUSSIAN = (1 << k for k in range(8))
#: Cyrillic in odd case or next to signs, and misread UTF-8 of Cyrillic.
_MIXED = re.compile(r"\b[а-яё][А-ЯЁ]{2}|[─-╿≈≤≥÷°²·√][А-яё]|[А-яё][─-╿≈≤≥÷°²·√]|[РСГÐÑ][\u0080-¿Ђ-Џѐ-џ–-›°±µ¶·»]")
_CLASSES: np.ndarray | None = None


def _classes() -> np.ndarray:
    global _CLASSES
    if _CLASSES is None:
        table = np.zeros(0x10000, np.uint8)
        known = [(0, 0x80), (0x300, 0x530), (0x600, 0x700), (0x900, 0xE80), (0x2000, 0x2010), (0x3000, 0xA000), (0xFF00, 0xFFF0)]
        table[:] = _IS_ODD
        for lo, hi in known:
            table[lo:hi] = 0
        for c in _PLAIN:
            table[ord(c)] = 0
        for c in _GBK_SIGNS:
            table[ord(c)] = _IS_ODD
        for c in _LOWER_JOIN:
            table[ord(c)] |= _JOINS_LOWER
        for c in _UPPER_JOIN:
            table[ord(c)] |= _JOINS_UPPER
        table[ord("’")] |= _QUOTE
        table[ord("a") : ord("z") + 1] |= _LOWER
        table[ord("A") : ord("Z") + 1] |= _UPPER
        table[0x370:0x530] |= _FOREIGN
        table[0x400:0x530] |= _RUSSIAN
        _CLASSES = table
    return _CLASSES


def suspicious(texts: list[str | None]) -> list[int]:
    """Indices of the texts with characters or neighbourhoods that plain writing lacks.

    A cheap test, in NumPy over some million characters at a time, that no garbled value fails.
    """
    out, start, part, size = [], 0, [], 0
    for i in range(len(texts) + 1):
        if part and (i == len(texts) or size > 2_000_000):
            out += [start + k for k in _suspicious(part)]
            part, size = [], 0
        if i < len(texts):
            if not part:
                start = i
            t = texts[i] or ""
            part.append("" if t.isascii() else t)
            size += len(part[-1])
    return out


def _suspicious(part: list[str]) -> list[int]:
    cps = np.frombuffer("\n\n".join(["", *part, ""]).encode("utf-32-le", "replace"), np.uint32)
    kind = np.where(cps < 0x10000, _classes()[np.minimum(cps, 0xFFFF)], _IS_ODD).astype(np.uint8)
    hit = (kind & _IS_ODD) > 0
    before, after = kind[:-2], kind[2:]
    lower, upper = (before & after & _LOWER) > 0, (before & after & _UPPER) > 0
    mid = kind[1:-1]
    joined = (((mid & _JOINS_LOWER) > 0) & lower) | (((mid & _JOINS_UPPER) > 0) & upper)
    # an apostrophe after a single letter is an elision
    single = np.concatenate(([True], (kind[:-3] & (_LOWER | _UPPER)) == 0))
    joined &= ~(((mid & _QUOTE) > 0) & single)
    near = ((mid & _FOREIGN) > 0) & (((before | after) & (_LOWER | _UPPER)) > 0)
    hit[1:-1] |= joined | near
    ends = np.cumsum([len(t) + 2 for t in part])
    at = set(np.searchsorted(ends, np.flatnonzero(hit), "right").tolist())
    russian = set(np.searchsorted(ends, np.flatnonzero((kind & _RUSSIAN) > 0), "right").tolist()) - at
    at |= {k for k in russian if k < len(part) and _MIXED.search(part[k])}
    return sorted(k for k in at if k < len(part))


#: What misread UTF-8 shows at first sight.
_TRACES = ("Ã", "â€", "├", "√", "�", "Ð", "Г")


def _misread(text: str) -> bool:
    """Whether a value plainly holds misread UTF-8, or lost characters."""
    if text.isascii() or not any(x in text for x in _TRACES):
        return False
    return "�" in text or any(_utf8_pattern(r).search(text) for r in ("cp1252", "cp437", "cp1251", "mac_roman"))


_EDGE = "“”«»‘’\"'()[]¿¡.,;:—–…?!"
_WORD = re.compile(f"[^\x00-\x7f{_PLAIN[:_PLAIN.index('¿')]}àâãçêôõëï]|[A-Z][îêèôûïëàâ][A-Z]")


class Scorer:
    """Likelihoods under the bigram model, and what each chain makes of a word, remembered."""

    def __init__(self, table: np.ndarray):
        self.table, self.list, self.fold = table, table.tolist(), _fold_table().tolist()
        self.words: dict[str, dict[tuple[str, str], tuple[str, float]]] = {}

    def __call__(self, text: str) -> float:
        if len(text) < 40:
            return self._short(text)
        return float(self.table[_bigrams(text)].sum())

    def _short(self, text: str) -> float:
        fold, table = self.fold, self.list
        total, last = 0.0, 0x20
        for c in text:
            cp = ord(c)
            cp = fold[cp] if cp < 0x10000 else cp
            total += table[((last << 21 | cp) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - _BITS)]
            last = cp
        return total + table[((last << 21 | 0x20) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - _BITS)]

    def chains(self, word: str) -> dict[tuple[str, str], tuple[str, float]]:
        """The single-byte chains under which the word reads better: what it becomes, and the gain."""
        known = self.words.get(word)
        if known is None:
            if len(self.words) > 200_000:
                self.words.clear()
            known = {}
            if not _ELISION.match(word) and _LETTER.search(word):
                here, cases = None, len(_CASE.findall(word))
                for chain in SINGLE_BYTE:
                    got = word.translate(_single_table(*chain))
                    if got != word and len(_LETTER.findall(got)) >= 2 and not _C1.search(got) and len(_CASE.findall(got)) <= cases:
                        here = self(word) if here is None else here
                        gain = self(got) - here
                        if gain > 8:
                            known[chain] = (got, gain)
            self.words[word] = known
        return known


def undo_single(text: str, score: Scorer) -> list[tuple[str, float, str]]:
    """(chain, gain, text) with the words that read better under another single-byte encoding."""
    totals: Counter = Counter()
    for word in text.split():
        if not word.isascii() and _WORD.search(word.strip(_EDGE)):
            for chain, (_, gain) in score.chains(word).items():
                totals[chain] += gain
    out = []
    for chain, total in totals.items():
        parts = re.split(r"(\s+)", text)
        restored = "".join(x if x.isascii() or x.isspace() else score.chains(x).get(chain, (x,))[0] for x in parts)
        out.append((f"{chain[1]} read as {chain[0]}", total, restored))
    return out


def candidates(text: str, score: Scorer) -> list[tuple[str, float, str]]:
    """(chain, gain in log-likelihood over leaving the value as it is, candidate original), gains only."""
    found: list[tuple[str, float, str]] = []
    base: float | None = None

    def gain(got: str) -> float:
        nonlocal base
        if base is None:
            base = score(text)
        return score(got) - base

    for read_as in UTF8_READ_AS:
        if not _utf8_pattern(read_as).search(text):
            continue
        got, hits = undo_utf8(text, read_as)
        if hits:
            g = gain(got)
            if g > 6:
                found.append((f"utf-8 read as {read_as}", g, got))
            again, more = undo_utf8(undo_utf8(text, read_as, True)[0], read_as)
            if more and (g2 := gain(again)) > max(g, 0):
                found.append((f"utf-8 read as {read_as} twice", g2, again))
    if any(x in text for x in ("�", *_GBK_SIGNS)):
        got, hits = undo_gbk(text)
        if hits:
            found.append((GBK, max(gain(got), 4.0 * hits), got))
    if _HIGH.search(text):
        for true in MULTI_BYTE:
            got, hits = undo_multi(text, true)
            if hits >= 4 and (g := gain(got)) > 0:
                found.append((f"{true} read as cp1252", g, got))
    found += undo_single(text, score)
    if "�" in text:
        found.append((LOSSY, 12.0 * text.count("�"), text))
    return found


def count_bigrams(values: DataFrame) -> np.ndarray:
    """Log-probabilities of hashed character bigrams over all values without misread UTF-8.

    values has one string column.  The model has 2**18 buckets whatever the corpus.
    """
    size, slices, groups = 1 << _BITS, 8, 64
    step = size // slices

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            part: list[str] = []
            length = 0
            for t in batch.column(0).to_pylist():
                if t and not _misread(t):
                    part.append(t)
                    length += len(t)
                if length > 2_000_000:
                    total += np.bincount(_bigrams(" ".join(part)), minlength=size)
                    part, length = [], 0
            if part:
                total += np.bincount(_bigrams(" ".join(part)), minlength=size)
        group = TaskContext.get().partitionId() % groups
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([group] * slices, pa.int32()), pa.array([total[k * step : (k + 1) * step].tobytes() for k in range(slices)], pa.binary())], names=["slice", "part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                x = np.frombuffer(blob, np.int64)
                sums[k] = sums[k] + x if k in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["slice", "part", "counts"])

    total = np.zeros(size, np.int64)
    kind = "slice int, part int, counts binary"
    # in two steps, so that no task adds up what all tasks of the scan have counted
    some = values.mapInArrow(count, kind).repartition(groups, "slice", "part").mapInArrow(add, kind)
    for row in some.repartition(slices, "slice").mapInArrow(add, kind).collect():
        total[row["slice"] * step : (row["slice"] + 1) * step] += np.frombuffer(bytes(row["counts"]), np.int64)
    return np.log((total + 0.05) / (total.sum() + 0.05 * size)).astype(np.float32)


EVIDENCE = "id long, field string, source string, chain string, gain double, restored string"


def evidence(values: DataFrame, model: np.ndarray) -> DataFrame:
    """Per value (id, field, source, value) the chains that would explain it better than none."""
    shared = values.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            ids, fields, sources, texts = (batch.column(k).to_pylist() for k in range(4))
            for k in suspicious(texts):
                i, f, s, t = ids[k], fields[k], sources[k], texts[k]
                rows += [(i, f, s, chain, g, got) for chain, g, got in candidates(t, score)]
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in EVIDENCE.split(", ")])

    return values.select("id", "field", "source", "value").mapInArrow(run, EVIDENCE)


def repair(values: DataFrame, *, only: DataFrame | None = None, rounds: int = 3, prior: float = 0.002, weight: float = 50.0) -> DataFrame:
    """Garbled values of (id, field, source, value): (id, field, source, chain, posterior, restored).

    Null and empty values are not garbled; repeated rows of an id and field count once; a null source
    is a source of its own.  ``prior`` is a chain's share before anything is known and ``weight`` the
    number of values it is worth.  A value with replacement characters only is returned as it is
    (chain ``lossy``): what stood there is not in the value; see ``restore_lost``.  With ``only`` (ids), the
    model is still that of all values, but only those ids are judged.
    """
    model = count_bigrams(values.select("value"))
    asked = values if only is None else values.join(only.select("id").distinct(), "id", "left_semi")
    found = evidence(asked, model).withColumn("source", F.coalesce("source", F.lit("")))
    found = materialize(found.dropDuplicates(["id", "field", "chain"]), "garble-evidence")
    sizes = values.groupBy(F.coalesce("source", F.lit("")).alias("source"), "field").agg(F.count("value").alias("size"))
    sizes = materialize(sizes, "garble-sizes")
    share = found.select("source", "field", "chain").distinct().withColumn("share", F.lit(prior))
    one = Window.partitionBy("id", "field")
    for k in range(rounds + 1):
        # E-step: the posterior of each chain against all others and none
        odds = F.least(F.col("gain"), F.lit(600.0)) + F.log("share")
        scored = found.join(share, ["source", "field", "chain"]).withColumn("odds", odds)
        top = F.greatest(F.max("odds").over(one), F.lit(0.0))
        scored = scored.withColumn("mass", F.exp(F.col("odds") - top)).withColumn("posterior", F.col("mass") / (F.sum("mass").over(one) + F.exp(-top)))
        if k < rounds:
            # M-step: the share of each chain in its source and field
            share = scored.groupBy("source", "field", "chain").agg(F.sum("posterior").alias("held")).join(sizes, ["source", "field"])
            share = share.select("source", "field", "chain", ((F.col("held") + weight * prior) / (F.col("size") + weight)).alias("share"))
    sure = scored.withColumn("sum", F.sum("posterior").over(one)).filter("sum > 0.5")
    best = sure.withColumn("rank", F.row_number().over(one.orderBy(F.desc("posterior"), "chain"))).filter("rank = 1")
    return best.select("id", "field", "source", "chain", "posterior", "restored")


_LOST = re.compile(r"\w*�[\w�]*")
_MARKED = re.compile(r"\b[A-Za-z]*[À-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ]*\b")


def restore_lost(repaired: DataFrame, values: DataFrame) -> DataFrame:
    """Fill replacement characters from the corpus: each word takes the commonest word that fits it.

    Words with accents are counted over all values, under the key in which every accented letter is a
    replacement character.  Words that fit nothing stay.  Same columns as ``repaired``.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t and not t.isascii():
                    c.update(_MARKED.findall(t))
            yield pa.RecordBatch.from_arrays([pa.array([re.sub(r"[^A-Za-z]", "�", w) for w in c], pa.string()), pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["key", "word", "n"])

    lost = repaired.filter(F.col("restored").contains("�"))
    keys = lost.select("id", "field", F.explode(F.expr("regexp_extract_all(restored, '[A-Za-zÀ-ÖØ-öø-ÿ]*�[A-Za-zÀ-ÖØ-öø-ÿ�]*', 0)")).alias("key")).distinct()
    known = values.select("value").mapInArrow(words, "key string, word string, n long")
    known = known.join(keys.select("key").distinct(), "key", "left_semi").groupBy("key", "word").agg(F.sum("n").alias("n"))
    known = known.groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    fills = keys.join(known, "key").groupBy("id", "field").agg(F.collect_list(F.struct(F.length("key").alias("size"), "key", "word")).alias("fills"))
    filled = lost.join(fills, ["id", "field"], "left")
    value = F.aggregate(F.sort_array(F.coalesce("fills", F.array().cast("array<struct<size:int,key:string,word:string>>")), asc=False), F.col("restored"), lambda t, x: F.replace(t, x["key"], x["word"]))
    filled = filled.withColumn("restored", value).select(*repaired.columns)
    return repaired.filter(~F.col("restored").contains("�")).unionByName(filled)
