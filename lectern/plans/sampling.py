"""Sorts, limits and samples."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lectern.operators import sampling as sp
from lectern.plans.joins import plain_doc
from lectern.plans.metrics import _F1, _SAID, model_answers
from lectern.plans.registry import frg, log, query, seg

_H = "md5(concat_ws('|', '42', {k})), {k}"
_HF, _HS = _H.replace("{k}", "fragment_id"), _H.replace("{k}", "seg_id")


@query("sort_desc_limit", "SELECT fragment_id, score_implicit FROM {FRG} ORDER BY score_implicit DESC, fragment_id LIMIT 2")
def sort_desc_limit(spark, d):
    return frg(spark, d, "score_implicit").select("fragment_id", "score_implicit").orderBy(F.desc_nulls_last("score_implicit"), "fragment_id").limit(2)


@query("sort_probs_top3", """SELECT request_id, t1_label, p, r - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY p DESC, t1_label) AS r FROM (SELECT request_id, t1_label, round(count(*) / sum(count(*)) OVER (PARTITION BY request_id), 4) AS p FROM {SEG} WHERE request_id IS NOT NULL GROUP BY ALL)) WHERE r BETWEEN 2 AND 4""".replace("count(*) / sum(count(*)) OVER (PARTITION BY request_id)", "n / sum(n) OVER (PARTITION BY request_id)").replace("FROM {SEG} WHERE request_id IS NOT NULL GROUP BY ALL", "FROM (SELECT request_id, t1_label, count(*) AS n FROM {SEG} WHERE request_id IS NOT NULL GROUP BY ALL)"))
def sort_probs_top3(spark, d):
    n = seg(spark, d, "request_id", "t1_label").filter("request_id is not null").groupBy("request_id", "t1_label").agg(F.count("*").alias("n"))
    every = n.groupBy("request_id").agg(F.sum("n").alias("all"), F.collect_list(F.struct("t1_label", "n")).alias("xs"))
    probs = F.transform("xs", lambda x: F.struct((-F.round(x["n"] / F.col("all"), 4)).alias("m"), x["t1_label"].alias("t1_label")))
    return every.select("request_id", F.posexplode(F.slice(F.array_sort(probs), 2, 3)).alias("i", "x")).select("request_id", F.col("x.t1_label").alias("t1_label"), (-F.col("x.m")).alias("p"), (F.col("i") + 1).alias("place"))


@query("sort_rank_models", f"SELECT model_id, f1, row_number() OVER (ORDER BY f1 DESC, model_id) AS place FROM (SELECT model_id, round({_F1}, 6) AS f1 FROM {_SAID} GROUP BY model_id)")
def sort_rank_models(spark, d):
    from lectern.operators.evaluation import binary_by

    m = binary_by(model_answers(spark, d), "model_id", "y", "yhat").select("model_id", F.round("f1", 6).alias("f1"))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "model_id")))


@query("sort_effect_size", "SELECT feature, d, row_number() OVER (ORDER BY d DESC, feature) AS place FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(avg({c}) FILTER (p) - avg({c}) FILTER (NOT p)) / sqrt((stddev_samp({c}) FILTER (p) ** 2 + stddev_samp({c}) FILTER (NOT p) ** 2) / 2), 6) AS d FROM (SELECT *, a1_label = 'ES_CONTRIBUCION' AS p FROM {{FRG}} WHERE a1_label IS NOT NULL)" for c in ("word_count", "relative_pos", "score_implicit")) + ")")
def sort_effect_size(spark, d):
    from lectern.operators.statistics import cohen_d

    cols = ("word_count", "relative_pos", "score_implicit")
    rows = frg(spark, d, "a1_label", *cols).filter("a1_label is not null").withColumn("p", F.col("a1_label") == "ES_CONTRIBUCION")
    return cohen_d(rows, "p", cols).select("feature", F.round("d", 6).alias("d")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("d"), "feature")))


@query("sample_uniform", f"SELECT fragment_id FROM {{FRG}} WHERE word_count BETWEEN 250 AND 500 ORDER BY {_HF} LIMIT 200")
def sample_uniform(spark, d):
    return sp.uniform(frg(spark, d, "word_count").filter("word_count between 250 and 500").select("fragment_id"), "fragment_id", 200, 42)


@query("sample_per_class", f"SELECT seg_id, t1_label FROM {{SEG}} QUALIFY row_number() OVER (PARTITION BY t1_label ORDER BY {_HS}) <= 50")
def sample_per_class(spark, d):
    return sp.per_class(seg(spark, d, "t1_label"), "t1_label", "seg_id", 50, 42)


_ZONE = "CASE WHEN relative_pos <= 0.15 THEN 'a' WHEN relative_pos <= 0.4 THEN 'b' WHEN relative_pos <= 0.7 THEN 'c' ELSE 'd' END"


@query("sample_stratified", f"""WITH z AS (SELECT fragment_id, {_ZONE} AS zone FROM {{FRG}} WHERE relative_pos IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY {_HF}) AS r, greatest(1, round_even(100 * count(*) OVER (PARTITION BY zone) / count(*) OVER (), 0)) AS k FROM z)
 SELECT fragment_id, zone FROM r ORDER BY (r > k)::INT, {_HF} LIMIT 100""")
def sample_stratified(spark, d):
    p = F.col("relative_pos")
    rows = frg(spark, d, "relative_pos").filter("relative_pos is not null").select("fragment_id", F.when(p <= 0.15, "a").when(p <= 0.4, "b").when(p <= 0.7, "c").otherwise("d").alias("zone"))
    return sp.stratified(rows, "zone", "fragment_id", 100, 42).select("fragment_id", "zone")


@query("sample_fraction", f"SELECT fragment_id, row_number() OVER (ORDER BY {_HF}) <= floor(count(*) OVER () * 0.4) AS chosen FROM {{FRG}} WHERE a1_label = 'ES_CONTRIBUCION'")
def sample_fraction(spark, d):
    return sp.fraction(frg(spark, d, "a1_label").filter("a1_label = 'ES_CONTRIBUCION'").select("fragment_id"), "fragment_id", 0.4, 42)


@query("shuffle_ids", f"SELECT item_id, printf('T2-%04d', row_number() OVER (ORDER BY {_H.replace('{k}', 'item_id')})) AS number FROM gold_items")
def shuffle_ids(spark, d):
    from lectern.sources.tables import table

    return sp.numbered(table(spark, d, "gold_items", "item_id"), "item_id", "T2-%04d", 42)


_FD = "lower(regexp_replace(trim(doc_id), '\\.(txt|json|jsonl)$', '', 'i'))"


@query("split_by_doc", f"SELECT doc, CASE WHEN row_number() OVER (ORDER BY {_H.replace('{k}', 'doc')}) <= ceil(count(*) OVER () * 0.15) THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT {_FD} AS doc FROM {{FRG}} WHERE doc_id IS NOT NULL)")
def split_by_doc(spark, d):
    return sp.split_keys(frg(spark, d, "doc_id").filter("doc_id is not null").select(plain_doc().alias("doc")), "doc", 0.15, 42, ("train", "val"))
