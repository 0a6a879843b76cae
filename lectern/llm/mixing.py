"""Mixing sources to target weights, measured in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.hash_budget import histogram, random_key, take_budget
from lectern.llm.keys import plain
from lectern.runtime import materialize

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE of this vocabulary parts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(df: DataFrame, id_col: str, text_col: str, source_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, source, tokens): the whole text of every row counted; a null text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["id", "source", "tokens"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).mapInArrow(run, "id long, source string, tokens long")


def token_sums(sizes: DataFrame, seed: int = 42) -> DataFrame:
    """Tokens by source and hash bucket of (id, source, tokens), as a written table of at most 4,096 rows a source.

    Repeated rows of an id must have been removed; rows without a source have the empty key.
    """
    rows = sizes.select(F.coalesce(plain("source"), F.lit("")).alias("key"), "tokens", random_key(seed, "id").alias("at"))
    return materialize(histogram(rows, ["key"], "at", "tokens"), "mix-sums")


def mix_report(sums: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target (mix_id, source): wanted tokens, size of the source, copies of everything, rest and short.

    sums: as by ``token_sums``.  copies: how often every record is taken; rest: tokens still to be taken
    once more; short: whether the source cannot reach its target with max_repeats.  A source that
    has no records is short; rows without a source count in the whole, and belong to no source.
    """
    by = sums.groupBy("key").agg(F.sum("_sum").alias("size"))
    whole = by.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("whole"))
    asked = targets.withColumn("key", plain("source")).join(by.filter("key <> ''"), "key", "left").join(F.broadcast(whole))
    size, most = F.coalesce("size", F.lit(0)), F.col("max_repeats")
    wanted = F.col("target_share") * F.col("budget_ratio") * F.col("whole")
    short = size * most < wanted
    copies = F.when(short, most).when(size > 0, F.floor(wanted / size)).otherwise(0).cast("int")
    asked = asked.withColumn("size", size).withColumn("wanted", wanted).withColumn("short", short).withColumn("copies", copies)
    rest = F.when(F.col("short"), F.lit(0)).otherwise(F.floor(F.col("wanted") - F.col("copies") * F.col("size"))).cast("long")
    return asked.select("mix_id", "source", "key", "target_share", "wanted", "size", "max_repeats", "copies", rest.alias("rest"), "short", "whole")


def mix_sources(sizes: DataFrame, targets: DataFrame, *, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(selection, report): selection has (mix_id, source, id, copies), each record with copies >= 1.

    Every record of a source is taken ``copies`` times, and those below a hash threshold once more; the
    threshold is found from sums by hash bucket (see ``take_budget``), nested for growing budgets.
    No record is taken more than max_repeats times.  One histogram a source serves every mix.
    """
    sizes = materialize(sizes.dropDuplicates(["id"]), "mix-tokens")
    sums = token_sums(sizes, seed)
    report = materialize(mix_report(sums, targets), "mix-report")
    rows = sizes.select("id", plain("source").alias("key"), "tokens").filter("key <> ''").withColumn("at", random_key(seed, "id"))
    asked = report.filter("copies < max_repeats and rest > 0").select("mix_id", "key", "rest")
    extra = take_budget(rows, ["mix_id", "key"], "at", "tokens", asked, "rest", sums.filter("key <> ''")).select("mix_id", "key", "id", F.lit(1).alias("copies"))
    base = rows.join(report.filter("copies > 0").select("mix_id", "key", "copies"), "key").select("mix_id", "key", "id", "copies")
    chosen = base.unionByName(extra).groupBy("mix_id", "key", "id").agg(F.sum("copies").cast("int").alias("copies"))
    return chosen.join(report.select("mix_id", "key", "source"), ["mix_id", "key"]).select("mix_id", "source", "id", "copies"), report


def mix_shares(sizes: DataFrame, selection: DataFrame, report: DataFrame) -> DataFrame:
    """The report with the tokens taken and the share of the mix reached by each source."""
    taken = selection.join(sizes.select("id", "tokens").dropDuplicates(["id"]), "id").groupBy("mix_id", "source").agg(F.sum(F.col("copies") * F.col("tokens")).alias("taken"))
    out = report.join(taken, ["mix_id", "source"], "left").withColumn("taken", F.coalesce("taken", F.lit(0)))
    mix = out.groupBy("mix_id").agg(F.sum("taken").alias("mix_tokens"))
    return out.join(mix, "mix_id").withColumn("share", F.coalesce(F.try_divide("taken", "mix_tokens"), F.lit(0.0))).drop("key", "whole")
