"""Models and language-model clients behind one interface, called a batch at a time."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.functions import lexicon, prompts


class Model(Protocol):
    """What a classifier offers: its labels, and the probabilities of each for a batch of texts."""

    labels: Sequence[str]

    def probabilities(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


class RuleModel:
    """The model without weights: probabilities in proportion to the markers of each section."""

    labels = list(lexicon.T1_PATTERNS)

    def __init__(self) -> None:
        self._patterns = [re.compile(p, re.I) for p in lexicon.T1_PATTERNS.values()]

    def probabilities(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            n = [1.0 + len(p.findall(t)) for p in self._patterns]
            out.append([x / sum(n) for x in n])
        return out


def classify(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Model], batch: int = 32) -> DataFrame:
    """(id, label, confidence, alternatives, all_probs): the best class, the next three, and all, to four decimals.

    ``make`` builds the model once a task.  A null text is classified as an empty one; ties go to the
    earlier label.
    """
    kind = dict(df.dtypes)[id_col]
    schema = f"{id_col} {kind}, label string, confidence double, alternatives array<struct<label:string,score:double>>, all_probs map<string,double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for rows in batches:
            texts = [t or "" for t in rows.column(1).to_pylist()]
            probs = [p for k in range(0, len(texts), batch) for p in model.probabilities(texts[k : k + batch])]
            ranked = [sorted(zip(model.labels, p), key=lambda x: -x[1]) for p in probs]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([r[0][0] for r in ranked], pa.string()),
                    pa.array([round(r[0][1], 4) for r in ranked], pa.float64()),
                    pa.array([[{"label": a, "score": round(s, 4)} for a, s in r[1:4]] for r in ranked], pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))),
                    pa.array([[(a, round(s, 4)) for a, s in zip(model.labels, p)] for p in probs], pa.map_(pa.string(), pa.float64())),
                ],
                names=[id_col, "label", "confidence", "alternatives", "all_probs"],
            )

    return df.select(id_col, text_col).mapInArrow(run, schema)


def threshold(default: float = 0.5) -> float:
    """The least probability of a contribution, from the environment variable T2_THRESHOLD if that is a number."""
    try:
        return float(os.environ.get("T2_THRESHOLD", default))
    except ValueError:
        return default


class Client(Protocol):
    """A language model: one answer a prompt; errors are raised."""

    def complete(self, prompt: str) -> str: ...


class EchoClient:
    """A client without a network: answers by the markers of the text in question, the last turn of the prompt."""

    def __init__(self) -> None:
        self._section = [(k, re.compile(p, re.I)) for k, p in lexicon.T1_PATTERNS.items() if k != "CONTR"]
        self._contribution = re.compile(lexicon.T2_PATTERN, re.I)

    def complete(self, prompt: str) -> str:
        turns = json.loads(prompt)
        asked = turns[-1]["content"]
        if turns[0]["content"].startswith(prompts.CONTRIBUTION_INSTRUCTION[:40]):
            return "SI" if self._contribution.search(asked) else "NO"
        counts = [(len(p.findall(asked)), k) for k, p in self._section]
        best = max(counts, key=lambda x: x[0])
        return best[1] if best[0] else "no sé"


#: Characters that are asked of a text, by task; sections are asked whole.
MOST = {"yes_no": 4000, "section": None}


def ask(df: DataFrame, id_col: str, text_col: str, make: Callable[[], Client], task: str, *, examples: bool = True, retries: int = 3, wait: float = 1.0, longest_wait: float = 60.0, at_once: int = 1) -> DataFrame:
    """(id, raw_answer, label, confidence) of each text.  task: ``section`` or ``yes_no``.

    The client is given the prompt as a JSON list of turns.  An error is tried again after wait * 2**k seconds (at most
    longest_wait); after ``retries`` the answer is ERROR.  at_once: prompts of a task that are under way together.
    A null text is asked as an empty one.  The confidence is 1.0, or 0.5 for UNKNOWN and ERROR.
    """
    from lectern.operators import answers

    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()

        def one(prompt: str) -> str:
            for k in range(retries):
                try:
                    return client.complete(prompt)
                except Exception:
                    if k + 1 < retries:
                        time.sleep(min(wait * 2**k, longest_wait))
            return "ERROR"

        with ThreadPoolExecutor(at_once) as pool:
            for rows in batches:
                got = list(pool.map(one, rows.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(got, pa.string())], names=[id_col, "raw_answer"])

    prompt = F.to_json(answers.prompt(F.coalesce(F.col(text_col), F.lit("")), task, examples, most=MOST[task]))
    out = df.select(id_col, prompt.alias("prompt")).mapInArrow(run, f"{id_col} {kind}, raw_answer string")
    failed = F.col("raw_answer") == "ERROR"
    if task == "yes_no":
        label = F.when(failed, "ERROR").when(answers.yes_no("raw_answer") == 1, "ES_CONTRIBUCION").otherwise("NO_ES_CONTRIBUCION")
    else:
        label = F.when(failed, "ERROR").otherwise(answers.section_label("raw_answer"))
    return out.withColumn("label", label).withColumn("confidence", F.when(F.col("label").isin("UNKNOWN", "ERROR"), 0.5).otherwise(1.0))


@dataclass(frozen=True)
class Entry:
    """A model of the catalog.  needs: a file with its weights, or the name of an environment variable with its key."""

    model_id: str
    name: str
    family: str
    weights: str | None = None
    key: str | None = None

    @property
    def available(self) -> bool:
        if self.family == "heuristic":
            return True
        return bool(self.weights and os.path.exists(self.weights)) or bool(self.key and os.environ.get(self.key))


def resolve(model_id: str, catalog: Sequence[Entry]) -> tuple[Entry, str, str]:
    """(entry, family that will answer, name to show): what is not available is answered by the rules, and its name says so.

    A model that the catalog doesn't have is a KeyError.
    """
    entry = next((e for e in catalog if e.model_id == model_id), None)
    if entry is None:
        raise KeyError(f"no model {model_id}")
    if entry.available:
        return entry, entry.family, entry.name
    return entry, "heuristic", entry.name + " [fallback heuristico]"


def with_fallback(df: DataFrame, model_id: str, catalog: Sequence[Entry], answer: Callable[[DataFrame], DataFrame], rules: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The answers of a model, or of the rules where it isn't available, with ``used_mode`` and ``used_name``.

    The choice is made while the plan is built, so the plan of only one of both runs.  Rows the model answers with ERROR
    (column label) get the label of the rules; rules must give (id, label, ...) with the same id.
    """
    entry, mode, name = resolve(model_id, catalog)
    if mode != entry.family or mode == "heuristic":
        return rules(df).withColumns({"used_mode": F.lit("heuristic"), "used_name": F.lit(name)})
    out, other = answer(df), rules(df)
    key = out.columns[0]
    failed = F.col("label") == "ERROR"
    joined = out.join(other.select(key, F.col("label").alias("_rule")), key, "left")
    return joined.withColumns({"used_mode": F.when(failed, "heuristic").otherwise(mode), "used_name": F.when(failed, name + " [fallback heuristico: error de inferencia]").otherwise(name), "label": F.when(failed, F.col("_rule")).otherwise(F.col("label"))}).drop("_rule")
