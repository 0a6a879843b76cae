"""Subject areas of documents: classifier chains over term, source and structure features.

Sentences are scored by a table of term weights, learned from labelled documents by expectation-
maximization: each sentence of a document belongs to one of its areas or to none.  The scores give the
features of a document (the share of its subject-bearing sentences in each area, their number, its
source, the kinds of lines in it).  A chain of logistic classifiers follows the areas from the most
frequent to the rarest, each seeing the labels given before it, so that co-occurrence is modelled;
a beam search finds the most probable combination of labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.wordcodes import code_chunks
from lectern.llm.keys import plain

#: Headings after which a bibliography or the like follows.
_BACK = re.compile(r"(?im)^\s*(?:\d+\.?\s*)?(?:referencias(?: bibliogr[aá]ficas)?|bibliograf[ií]a|references|bibliography|refer[eê]ncias(?: bibliogr[aá]ficas)?|r[eé]f[eé]rences(?: bibliographiques)?|bibliographie|literatur(?:verzeichnis)?|参考文献|литература|список литературы)\s*:?\s*$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+(?=[^a-zß-ÿ\s])|(?<=[。！？])|(?<=[㐀-鿿%\d][!?])|\n\s*\n|\n(?=[^a-zß-öø-ÿ\s])|(?<=[a-z]{3}\.)(?=[A-ZÀ-Þ¿¡])")
_ENDED = re.compile(r"[.!?…。！？।؟][\"'”’»)」]*\s*$")
_CJK = re.compile(r"[㐀-鿿]+")
_NUMBER = re.compile(r"\d+")
_ENTRY = re.compile(r"^[^.]{2,60}\(\d{4}[a-z]?\)\.?\s")


def subject_sentences(text: str) -> tuple[list[str], int]:
    """(running sentences; number of other lines): no headings, affiliations or bibliography."""
    cut = None
    for m in _BACK.finditer(text):
        cut = m
    other = 0
    if cut and cut.start() > 0.3 * len(text):
        other = text.count("\n", cut.start()) + 1
        text = text[: cut.start()]
    out = []
    for s in _SPLIT.split(text):
        s = s.strip()
        if not s:
            continue
        if _ENDED.search(s) and not _ENTRY.match(s):
            out.append(s)
        else:
            other += 1
    return out, other


def _spaced(sentence: str) -> str:
    """Without numbers, which are no subject; scripts without spaces as overlapping pairs of characters."""
    sentence = _NUMBER.sub(" ", sentence)
    if sentence.isascii():
        return sentence
    return _CJK.sub(lambda m: " " + " ".join(m[0][k : k + 2] for k in range(len(m[0]) - 1)) + " ", sentence)


@dataclass
class SubjectModel:
    """Everything a task needs: a table of term weights, and the chain."""

    areas: list[str]
    terms: np.ndarray  # sorted term codes
    weights: np.ndarray  # terms x areas: log-odds of the area, given the term, in units of what is possible
    cutoff: float  # least score of a subject-bearing sentence
    order: list[int]  # areas, in the order of the chain
    chain: np.ndarray  # a row an area in that order: weights of features, of labels before, and bias
    sources: dict[str, np.ndarray]
    beam: int = 8
    #: Papers in which a smaller part of the running sentences bears a subject have none: learned, see ``BELOW``.
    least_bearing: float = 0.0

    def has_subject(self, scores: np.ndarray) -> bool:
        """Whether enough of a document's running sentences bear a subject."""
        sure = (scores.max(1) >= self.cutoff).sum() if len(scores) else 0
        return bool(sure and sure >= self.least_bearing * len(scores))

    def sentence_scores(self, sentences: list[str]) -> np.ndarray:
        out = np.zeros((len(sentences), len(self.areas)))
        if not self.terms.size:
            return out
        for first, codes, bounds, _ in code_chunks([_spaced(s) for s in sentences]):
            at = np.searchsorted(self.terms, codes)
            at[at == self.terms.size] = 0
            hit = np.flatnonzero(self.terms[at] == codes)
            if hit.size:
                # each term counts once a sentence
                pairs = np.unique((np.searchsorted(bounds, hit, "right") - 1) * self.terms.size + at[hit])
                owner, term = np.divmod(pairs, self.terms.size)
                starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                out[first + owner[starts]] = np.add.reduceat(self.weights[term], starts)
        return out

    def features(self, scores: np.ndarray, other: int, source: str | None) -> np.ndarray:
        k = len(self.areas)
        best = scores.argmax(1) if len(scores) else np.zeros(0, int)
        sure = scores.max(1) >= self.cutoff if len(scores) else np.zeros(0, bool)
        n = int(sure.sum())
        counts = np.bincount(best[sure], minlength=k)
        share = counts / max(n, 1)
        prior = self.sources.get(source or "", self.sources.get("", np.zeros(k)))
        terms = np.maximum(scores, 0).mean(0) if len(scores) else np.zeros(k)
        return np.concatenate((share, np.minimum(share, 0.2) * 5, prior, terms, [np.log1p(n), np.log1p(len(scores)), other / (other + len(scores) + 1.0), float(n == 0)]))

    def decode(self, x: np.ndarray) -> list[int]:
        """The most probable combination of labels, by beam search along the chain."""
        k, m = len(self.areas), x.size
        order = np.array(self.order)
        own = np.concatenate((x[order[:, None] + [0, k, 2 * k, 3 * k]], np.broadcast_to(x[m - 4 :], (k, 4))), 1)
        base = ((own * self.chain[:, :8]).sum(1) + self.chain[:, -1]).tolist()
        beams: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]  # log-probability, steps labelled yes
        for step in range(k):
            row = self._rows()[step]
            grown = []
            for logp, given in beams:
                z = max(-30.0, min(30.0, base[step] + sum([row[8 + j] for j in given])))
                no = math.log1p(math.exp(z))
                if z > -12:  # below, yes is less likely than 1e-5
                    grown.append((logp + z - no, (*given, step)))
                grown.append((logp - no, given))
            grown.sort(key=lambda b: -b[0])
            beams = grown[: self.beam]
        return sorted(self.order[j] for j in beams[0][1])

    def _rows(self) -> list[list[float]]:
        if not hasattr(self, "_list"):
            self._list = self.chain.tolist()
        return self._list


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, rounds: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


#: The part of the labelled documents, of words the model knows, that has a smaller share of subject-bearing sentences than is asked for.
BELOW = 0.005
#: Parts of the labelled documents that are scored by weights from the others.
FOLDS = 5


def _term_weights(y: np.ndarray, owner: np.ndarray, rows: np.ndarray, cols: np.ndarray, n_terms: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each term for each area, terms that count) by expectation-maximization.

    y: labels of documents; owner: document of each sentence; rows, cols: which term stands in which sentence.
    """
    k = y.shape[1]
    allowed = np.concatenate((y[owner], np.ones((owner.size, 1))), 1)  # the last class is none
    post = allowed * np.concatenate((np.full(k, 0.9), [0.1]))
    post /= post.sum(1, keepdims=True)
    for _ in range(rounds):
        # M-step: how often each term stands in sentences of each class
        mass = np.zeros((n_terms, k + 1))
        for c in range(k + 1):
            mass[:, c] = np.bincount(cols, post[rows, c], minlength=n_terms)
        total = post.sum(0)
        p = (mass + 0.05) / (total + 1.0)
        spread = (mass.sum(1, keepdims=True) + 0.05 * (k + 1)) / (total.sum() + k + 1)
        gain = np.clip(np.log(p / spread), -4, 4)
        # E-step
        logp = np.zeros((owner.size, k + 1))
        for c in range(k + 1):
            logp[:, c] = np.bincount(rows, gain[cols, c], minlength=owner.size)
        logp += np.log(total / total.sum() + 1e-9)
        logp = np.where(allowed > 0, logp, -np.inf)
        logp -= logp.max(1, keepdims=True)
        post = np.exp(logp)
        post /= post.sum(1, keepdims=True)
    area_mass = mass[:, :k]
    n = mass.sum(1)
    part = (area_mass + 0.02) / (n[:, None] + 0.02 * (k + 1) + 0.3)
    base = np.clip(total[:k] / total.sum(), 1e-6, 0.9)
    weight = np.log(part / base) / np.log(1 / base)  # 1: the term stands in this area only
    # a term must stand in two documents, however many are labelled, or the names of persons and places would count
    held = np.unique(np.stack((cols, owner[rows]), 1), axis=0)[:, 0]
    several = np.bincount(held, minlength=n_terms) >= 2
    keep = several & (part.max(1) >= 0.5)
    return np.clip(weight, -1, 1), keep


def fit(texts: list[str], sources: list[str | None], labels: list[list[str]], areas: list[str], *, rounds: int = 8, cutoff: float = 0.65, beam: int = 8) -> SubjectModel:
    """Train on labelled documents; without any, a model that gives no document an area."""
    k = len(areas)
    index = {a: i for i, a in enumerate(areas)}
    y = np.zeros((len(texts), k))
    for i, row in enumerate(labels):
        for a in row:
            if a in index:
                y[i, index[a]] = 1
    sentences, owner, others = [], [], []
    for i, t in enumerate(texts):
        got, other = subject_sentences(t or "")
        sentences += got
        owner += [i] * len(got)
        others.append(other)
    owner = np.array(owner, int)
    model = SubjectModel(areas, np.zeros(0, np.uint64), np.zeros((0, k)), cutoff, list(range(k)), np.zeros((k, 9 + k)), {}, beam)
    if not sentences:
        model.chain[:, -1] = -30
        return model
    rows, cols = [], []
    for first, codes, bounds, _ in code_chunks([_spaced(s) for s in sentences]):
        owner_ = first + np.searchsorted(bounds, np.arange(codes.size), "right") - 1
        order = np.lexsort((codes, owner_))
        codes, owner_ = codes[order], owner_[order]
        new = np.concatenate(([True], (codes[1:] != codes[:-1]) | (owner_[1:] != owner_[:-1]))) if codes.size else np.zeros(0, bool)
        rows.append(owner_[new])
        cols.append(codes[new])
    rows, codes = np.concatenate(rows), np.concatenate(cols)
    terms, cols = np.unique(codes, return_inverse=True)
    weights, keep = _term_weights(y, owner, rows, cols, terms.size, rounds)
    model.terms, model.weights = terms[keep], weights[keep]
    counts = y.sum(0)
    model.order = [int(i) for i in np.argsort(-counts, kind="stable")]
    smooth = (counts + 1) / (len(texts) + 2)
    model.sources[""] = np.log(smooth)
    for s in {s for s in sources if s}:
        at = [i for i, x in enumerate(sources) if x == s]
        model.sources[s] = np.log((y[at].sum(0) + 20 * smooth) / (len(at) + 20))
    # the chain learns from scores that a document had no part in: those of weights from the other folds
    fold = np.arange(len(texts)) % FOLDS
    scores = np.zeros((len(sentences), k))
    for f in range(FOLDS):
        inside = fold[owner] != f
        number = np.cumsum(inside) - 1
        taken = inside[rows]
        if not taken.any() or taken.all():
            continue
        w, kept = _term_weights(y, owner[inside], number[rows[taken]], cols[taken], terms.size, rounds)
        w = np.where(kept[:, None], w, 0)
        r, c = rows[~taken], cols[~taken]
        for a in range(k):
            scores[:, a] += np.bincount(r, w[c, a], minlength=len(sentences))
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    bearing = np.add.reduceat(np.append(scores.max(1) >= cutoff, False).astype(float), ends[:-1]) * (np.diff(ends) > 0) / np.maximum(np.diff(ends), 1)
    if (bearing > 0).any():
        model.least_bearing = float(np.quantile(bearing[bearing > 0], BELOW))
    x = np.array([model.features(scores[ends[i] : ends[i + 1]], others[i], sources[i]) for i in range(len(texts))])
    m = x.shape[1]
    # one set of feature weights serves all areas (a share means the same in each); each has its own bias and labels before it
    shared = [np.concatenate((x[:, [a, a + k, a + 2 * k, a + 3 * k]], x[:, m - 4 :], np.ones((len(x), 1))), 1) for a in range(k)]
    ridge = np.array([0.02, 0.02, 1, 0.1, 1, 1, 1, 1, 0.01])
    common = _fit_logistic(np.concatenate(shared), np.concatenate([y[:, a] for a in range(k)]), ridge)
    for step, a in enumerate(model.order):
        before = y[:, model.order[:step]]
        offset = shared[a] @ common
        design = np.concatenate((before, np.ones((len(x), 1)), offset[:, None]), 1)
        strength = np.concatenate((np.full(step, 20.0), [20.0, 20.0]))
        start = np.zeros(design.shape[1])
        start[-1] = 1.0
        w = start + _fit_offset(design, y[:, a], offset, strength)
        scale = w[-1]
        model.chain[step, :8] = common[:8] * scale
        model.chain[step, 8 : 8 + step] = w[:step]
        model.chain[step, -1] = common[8] * scale + w[step]
    return model


def _fit_offset(x: np.ndarray, y: np.ndarray, offset: np.ndarray, ridge: np.ndarray, rounds: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(offset + x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


MAX_LABELLED = 20_000


def train(documents: DataFrame, labels: DataFrame, areas: DataFrame, *, max_labelled: int = MAX_LABELLED, seed: int = 42) -> SubjectModel:
    """A model from the labelled documents, of which at most ``max_labelled`` (by hash) are taken.

    documents: doc_id, text, source.  labels: (doc_id, area_code).  areas: area_code.
    """
    given = labels.groupBy("doc_id").agg(F.collect_set("area_code").alias("areas"))
    sample = given.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labelled)
    rows = documents.select("doc_id", "text", plain("source").alias("source")).join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    names = sorted(r["area_code"] for r in areas.select("area_code").distinct().collect())
    return fit([r["text"] for r in rows], [r["source"] for r in rows], [sorted(r["areas"]) for r in rows], names)


SUBJECTS = "doc_id long, area_code string, share double, sentences int"


def subject_areas(documents: DataFrame, model: SubjectModel) -> DataFrame:
    """(doc_id, area_code, share of its subject-bearing sentences, their number) for every area of a document.

    A document without a subject, of null or empty text, or in words the model does not know has no
    row.  Documents are read once, whole; repeated rows give one row.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: SubjectModel = shared.value
        for batch in batches:
            ids, texts, sources = (batch.column(k).to_pylist() for k in range(3))
            out: list[tuple] = []
            for at in range(0, len(ids), 1000):
                parts = [subject_sentences(t or "") for t in texts[at : at + 1000]]
                flat = [s for got, _ in parts for s in got]
                scores = m.sentence_scores(flat)
                lo = 0
                for i, (got, other) in enumerate(parts, at):
                    mine, lo = scores[lo : lo + len(got)], lo + len(got)
                    if m.has_subject(mine):
                        x = m.features(mine, other, sources[i])
                        sure = int((mine.max(1) >= m.cutoff).sum())
                        out += [(ids[i], m.areas[a], float(x[a]), sure) for a in m.decode(x)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64(), pa.int32()))], names=["doc_id", "area_code", "share", "sentences"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", plain("source").alias("source")).mapInArrow(run, SUBJECTS).dropDuplicates(["doc_id", "area_code"])
