"""Joins: equi, semi, anti, positional and lookup."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lectern.functions import lexicon
from lectern.operators.segmentation import noise_class
from lectern.plans.projections import noise_sql
from lectern.plans.registry import ann, frg, log, query, seg
from lectern.sources.tables import table

_T2 = "(SELECT request_id, arg_max(coalesce(lower(trim(raw_answer)) ~ '^(si|sí|yes)', false), (predicted_at, log_id)) AS yes, arg_max({'c': confidence}, (predicted_at, log_id)).c AS conf FROM {LOG} WHERE task = 'T2' AND request_id IS NOT NULL GROUP BY request_id)"


@query("join_t1_t2", f"SELECT s.seg_id, coalesce(t.yes, false) AS is_contribution, coalesce(t.conf, 0.5) AS confidence FROM {{SEG}} s LEFT JOIN {_T2} t USING (request_id)")
def join_t1_t2(spark, d):
    """Every segment with the latest answer of its request; false and 0.5 where there is none."""
    said = F.struct(F.coalesce(F.lower(F.trim("raw_answer")).rlike("^(si|sí|yes)"), F.lit(False)).alias("yes"), F.col("confidence").alias("conf"))
    last = log(spark, d, "request_id", "task", "raw_answer", "confidence", "predicted_at").filter("task = 'T2' and request_id is not null").groupBy("request_id").agg(F.max_by(said, F.struct("predicted_at", "log_id")).alias("x"))
    return seg(spark, d, "request_id").join(last, "request_id", "left").select("seg_id", F.coalesce("x.yes", F.lit(False)).alias("is_contribution"), F.coalesce("x.conf", F.lit(0.5)).alias("confidence"))


_LAST = "(SELECT fragment_id, upper(annotator) AS who, arg_max(label, ann_id) FILTER (label IS NOT NULL) AS label FROM {ANN} WHERE label IS NOT NULL GROUP BY ALL)"


def annotators(spark, d):
    """(fragment_id, a, b): what both annotators said of a fragment, the later annotation of each counting."""
    last = ann(spark, d).filter("label is not null").groupBy("fragment_id", F.upper("annotator").alias("who")).agg(F.max_by("label", "ann_id").alias("label"))
    side = lambda w, n: last.filter(F.col("who") == w).select("fragment_id", F.col("label").alias(n))
    return side("A", "a").join(side("B", "b"), "fragment_id")


@query("join_annotators", f"SELECT a.fragment_id, a.label AS a, b.label AS b FROM {_LAST} a JOIN {_LAST} b ON a.fragment_id = b.fragment_id AND a.who = 'A' AND b.who = 'B'")
def join_annotators(spark, d):
    return annotators(spark, d)


@query("join_ref", f"SELECT l.fragment_id, l.who, l.label, CASE f.a1_label WHEN 'ES_CONTRIBUCION' THEN 1 ELSE 0 END AS auto_label FROM {_LAST} l JOIN {{FRG}} f USING (fragment_id) WHERE f.a1_label IS NOT NULL")
def join_ref(spark, d):
    last = ann(spark, d).filter("label is not null").groupBy("fragment_id", F.upper("annotator").alias("who")).agg(F.max_by("label", "ann_id").alias("label"))
    ref = frg(spark, d, "a1_label").filter("a1_label is not null").select("fragment_id", F.when(F.col("a1_label") == "ES_CONTRIBUCION", 1).otherwise(0).alias("auto_label"))
    return last.join(ref, "fragment_id")


@query("join_consensus", f"""SELECT f.fragment_id, c.label AS consensus, (c.fragment_id IS NOT NULL AND c.label IS NULL) AS is_ambiguous FROM {{FRG}} f LEFT JOIN
 (SELECT a.fragment_id, CASE WHEN a.label = b.label THEN a.label END AS label FROM {_LAST} a JOIN {_LAST} b ON a.fragment_id = b.fragment_id AND a.who = 'A' AND b.who = 'B') c USING (fragment_id)""")
def join_consensus(spark, d):
    c = annotators(spark, d).select("fragment_id", F.when(F.col("a") == F.col("b"), F.col("a")).alias("consensus"), F.lit(True).alias("seen"))
    return frg(spark, d, "split").select("fragment_id").join(c, "fragment_id", "left").select("fragment_id", "consensus", (F.col("seen").isNotNull() & F.col("consensus").isNull()).alias("is_ambiguous"))


_LABELS = ", ".join(f"('{k}', '{lexicon.T1_NAMES[k]}', '{lexicon.T1_COLORS[k]}')" for k in lexicon.T1_PATTERNS)


@query("join_lookup_dim", f"SELECT s.seg_id, coalesce(n.name, s.t1_label) AS name, coalesce(n.color, '#9CA3AF') AS color FROM {{SEG}} s LEFT JOIN (VALUES {_LABELS}) n(label, name, color) ON n.label = s.t1_label")
def join_lookup_dim(spark, d):
    names = F.create_map(*[F.lit(x) for kv in lexicon.T1_NAMES.items() for x in kv])
    colors = F.create_map(*[F.lit(x) for kv in lexicon.T1_COLORS.items() for x in kv])
    return seg(spark, d, "t1_label").select("seg_id", F.coalesce(F.try_element_at(names, "t1_label"), "t1_label").alias("name"), F.coalesce(F.try_element_at(colors, "t1_label"), F.lit("#9CA3AF")).alias("color"))


_DOC = "lower(regexp_replace(trim({c}), '\\.(txt|json|jsonl)$', '', 'i'))"
_FDOC = _DOC.replace("{c}", "doc_id")


def plain_doc(c="doc_id"):
    """A document's name without case, outer blanks and file ending."""
    return F.lower(F.regexp_replace(F.trim(c), r"(?i)\.(txt|json|jsonl)$", ""))


@query("join_anti_files", f"SELECT DISTINCT {_FDOC} AS doc FROM {{FRG}} WHERE doc_id IS NOT NULL AND {_FDOC} NOT IN (SELECT doc_id FROM {{SEG}} WHERE doc_id IS NOT NULL)")
def join_anti_files(spark, d):
    done = seg(spark, d, "doc_id").select(F.col("doc_id").alias("doc")).filter("doc is not null").distinct()
    return frg(spark, d, "doc_id").select(plain_doc().alias("doc")).filter("doc is not null").distinct().join(done, "doc", "left_anti")


@query("join_anti_snippet", """SELECT g.fragment_id FROM {FRG} g WHERE lower(trim(g.contr_type)) = 'none' AND NOT EXISTS (SELECT 1 FROM {FRG} p WHERE lower(trim(p.contr_type)) = 'explicit' AND p.doc_id = g.doc_id)
 AND NOT EXISTS (SELECT 1 FROM {FRG} p WHERE lower(trim(p.contr_type)) = 'explicit' AND p.text = g.text)""")
def join_anti_snippet(spark, d):
    rows = frg(spark, d, "contr_type", "doc_id", "text").withColumn("kind", F.lower(F.trim("contr_type")))
    first = rows.filter("kind = 'explicit'")
    rest = rows.filter("kind = 'none'").select("fragment_id", "doc_id", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("text_key"))
    return rest.join(first.select("doc_id").distinct(), "doc_id", "left_anti").join(first.select(F.sha2("text", 256).alias("text_key")).distinct(), "text_key", "left_anti").select("fragment_id")


@query("join_anti_leak", f"SELECT fragment_id FROM {{FRG}} WHERE lower(trim(split)) = 'train' AND doc_id IS NOT NULL AND {_FDOC} NOT IN (SELECT {_FDOC} FROM {{FRG}} WHERE lower(trim(split)) = 'test' AND doc_id IS NOT NULL)")
def join_anti_leak(spark, d):
    rows = frg(spark, d, "split", "doc_id").filter("doc_id is not null").select("fragment_id", plain_doc().alias("doc"), F.lower(F.trim("split")).alias("split"))
    return rows.filter("split = 'train'").join(rows.filter("split = 'test'").select("doc").distinct(), "doc", "left_anti").select("fragment_id")


@query("join_semi_split", f"SELECT fragment_id FROM {{FRG}} WHERE {_FDOC} IN (SELECT {_FDOC} FROM {{FRG}} WHERE lower(trim(split)) = 'val' AND doc_id IS NOT NULL)")
def join_semi_split(spark, d):
    rows = frg(spark, d, "split", "doc_id").select("fragment_id", plain_doc().alias("doc"), F.lower(F.trim("split")).alias("split"))
    return rows.join(rows.filter("split = 'val'").select("doc").distinct(), "doc", "left_semi").select("fragment_id")


_MARKED = noise_sql("{SEG}", "request_id", "seg_index, seg_id", "request_id, seg_index, seg_id")


@query("join_interleave", f"""WITH p AS (SELECT * EXCLUDE (noise), noise, noise IS NOT NULL AS is_noise FROM {_MARKED}), k AS (SELECT *, row_number() OVER (PARTITION BY request_id, is_noise ORDER BY seg_index, seg_id) AS k FROM p),
 r AS (SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY log_id) AS k, model_id AS answered_by FROM {{LOG}} WHERE task = 'T1' AND request_id IS NOT NULL)
 SELECT k.seg_id, k.noise, row_number() OVER (PARTITION BY k.request_id ORDER BY k.seg_index, k.seg_id) - 1 AS new_index, r.answered_by FROM k LEFT JOIN r ON r.request_id = k.request_id AND r.k = k.k AND NOT k.is_noise""")
def join_interleave(spark, d):
    """The k-th clean paragraph of a request with its k-th answer; noise stays in its place, without an answer."""
    order = ["seg_index", "seg_id"]
    rows = noise_class(seg(spark, d, "request_id", "seg_index", "text"), "request_id", order, "text").select("request_id", *order, "noise").withColumn("is_noise", F.col("noise").isNotNull())
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("request_id", "is_noise").orderBy(*order))).withColumn("new_index", F.row_number().over(Window.partitionBy("request_id").orderBy(*order)) - 1)
    answers = log(spark, d, "request_id", "task", "model_id").filter("task = 'T1' and request_id is not null").select("request_id", F.row_number().over(Window.partitionBy("request_id").orderBy("log_id")).alias("k"), F.lit(False).alias("is_noise"), F.col("model_id").alias("answered_by"))
    return rows.join(answers, ["request_id", "k", "is_noise"], "left").select("seg_id", "noise", "new_index", "answered_by")


@query("join_cross_param", """SELECT t.threshold, count(*) AS n, count(*) FILTER (score_implicit >= t.threshold) AS positive FROM {FRG} CROSS JOIN (SELECT unnest([0.3, 0.35, 0.4, 0.45, 0.5]) AS threshold) t GROUP BY t.threshold""")
def join_cross_param(spark, d):
    grid = F.array(*[F.lit(x) for x in (0.3, 0.35, 0.4, 0.45, 0.5)])
    counts = frg(spark, d, "score_implicit").groupBy("score_implicit").agg(F.count("*").alias("w"))
    return counts.withColumn("threshold", F.explode(grid)).groupBy("threshold").agg(F.sum("w").alias("n"), F.sum(F.when(F.col("score_implicit") >= F.col("threshold"), F.col("w")).otherwise(0)).alias("positive"))


@query("join_gold_docs", "SELECT g.item_id, count(f.doc_id) AS fragments FROM gold_items g LEFT JOIN (SELECT DISTINCT split_part(lower(trim(doc_id)), '_', 1) AS doc_id FROM fragments) f ON f.doc_id = g.doc_source GROUP BY g.item_id")
def join_gold_docs(spark, d):
    sources = table(spark, d, "fragments", "doc_id").select(F.split_part(F.lower(F.trim("doc_id")), F.lit("_"), F.lit(1)).alias("doc_source")).distinct().withColumn("hit", F.lit(1))
    return table(spark, d, "gold_items", "item_id", "doc_source").join(sources, "doc_source", "left").groupBy("item_id").agg(F.count("hit").alias("fragments"))
