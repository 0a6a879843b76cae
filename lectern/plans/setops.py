"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.plans.joins import plain_doc
from lectern.plans.registry import frg, query, seg
from lectern.sources.tables import table

_FD = "lower(regexp_replace(trim(doc_id), '\\.(txt|json|jsonl)$', '', 'i'))"


def _docs(spark, d, split):
    return frg(spark, d, "split", "doc_id").filter((F.lower(F.trim("split")) == split) & F.col("doc_id").isNotNull()).select(plain_doc().alias("doc")).distinct()


_D = lambda s: f"SELECT {_FD} AS doc FROM {{FRG}} WHERE lower(trim(split)) = '{s}' AND doc_id IS NOT NULL"


@query("set_union_all", "SELECT 'a' AS batch, seg_id FROM {SEG} WHERE seg_id % 4 = 0 UNION ALL SELECT 'b', seg_id FROM {SEG} WHERE seg_id % 4 = 1 UNION ALL SELECT 'a', seg_id FROM {SEG} WHERE seg_id % 4 = 0")
def set_union_all(spark, d):
    rows = seg(spark, d, "model_id").select("seg_id")
    part = lambda k, n: rows.filter(F.col("seg_id") % 4 == k).select(F.lit(n).alias("batch"), "seg_id")
    return part(0, "a").unionByName(part(1, "b")).unionByName(part(0, "a"))


@query("set_union_common_cols", "SELECT doc_id, text, word_count, relative_pos, char_start, char_end FROM {SEG} UNION ALL SELECT doc_id, text, word_count, relative_pos, char_start, char_end FROM {FRG}")
def set_union_common_cols(spark, d):
    from lectern.operators.tables import union_common

    a, b = seg(spark, d, "doc_id", "text", "word_count", "relative_pos", "char_start", "char_end").drop("seg_id"), frg(spark, d, "doc_id", "text", "word_count", "relative_pos", "char_start", "char_end", "split")
    return union_common(a, b)


@query("set_distinct", "SELECT DISTINCT lower(trim(source)) AS source, lower(lang) AS lang FROM documents")
def set_distinct(spark, d):
    return table(spark, d, "documents", "source", "lang").select(F.lower(F.trim("source")).alias("source"), F.lower("lang").alias("lang")).distinct()


@query("set_distinct_first", "SELECT min(seg_id) AS seg_id FROM {SEG} GROUP BY text")
def set_distinct_first(spark, d):
    return seg(spark, d, "text").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("seg_id").alias("seg_id")).select("seg_id")


@query("set_intersect", f"{_D('train')} INTERSECT {_D('val')}")
def set_intersect(spark, d):
    return _docs(spark, d, "train").intersect(_docs(spark, d, "val"))


@query("set_except", f"{_D('train')} EXCEPT {_D('val')}")
def set_except(spark, d):
    return _docs(spark, d, "train").subtract(_docs(spark, d, "val"))


@query("set_union_ids", f"{_D('test')} UNION {_D('val')}")
def set_union_ids(spark, d):
    return _docs(spark, d, "test").union(_docs(spark, d, "val")).distinct()
