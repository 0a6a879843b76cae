"""Agreement, classification quality, calibration and leakage."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lectern.functions import lexicon, text as tx
from lectern.operators import evaluation as ev
from lectern.plans.joins import _LAST, annotators, plain_doc
from lectern.plans.registry import frg, log, query, seg
from lectern.sources.tables import table

_AB = f"(SELECT a.fragment_id, a.label AS a, b.label AS b FROM {_LAST} a JOIN {_LAST} b ON a.fragment_id = b.fragment_id AND a.who = 'A' AND b.who = 'B')"
_CNT = f"(SELECT count(*) AS n, count(*) FILTER (a = b) AS same, count(*) FILTER (a = 1) AS a1, count(*) FILTER (b = 1) AS b1, count(*) FILTER (a = 1 AND b = 1) AS n11, count(*) FILTER (a = 0 AND b = 0) AS n00, count(*) FILTER (a = 1 AND b = 0) AS n10, count(*) FILTER (a = 0 AND b = 1) AS n01 FROM {_AB})"


@query("met_kappa", f"SELECT n, round(CASE WHEN n = 0 THEN 0 WHEN pe = 1 THEN 1 ELSE (po - pe) / (1 - pe) END, 4) AS kappa FROM (SELECT n, same / n AS po, (a1 / n) * (b1 / n) + (1 - a1 / n) * (1 - b1 / n) AS pe FROM {_CNT})")
def met_kappa(spark, d):
    return ev.agreement(annotators(spark, d), "a", "b").select("n", F.round("kappa", 4).alias("kappa"))


@query("met_alpha", f"SELECT n, round(CASE WHEN n = 0 THEN 0 WHEN de = 0 THEN 1 ELSE 1 - (1 - same / n) / de END, 4) AS alpha FROM (SELECT n, same, 2 * ((a1 + b1) / (2 * n)) * (1 - (a1 + b1) / (2 * n)) AS de FROM {_CNT})")
def met_alpha(spark, d):
    return ev.agreement(annotators(spark, d), "a", "b").select("n", F.round("alpha", 4).alias("alpha"))


@query("met_agree", f"SELECT n, round(100.0 * same / n, 2) AS pct, n11, n00, n10, n01, CASE WHEN 100.0 * same / n >= 80 THEN 'high' WHEN 100.0 * same / n >= 60 THEN 'medium' ELSE 'low' END AS band FROM {_CNT}")
def met_agree(spark, d):
    pct = 100.0 * F.col("same") / F.col("n")
    band = F.when(pct >= 80, "high").when(pct >= 60, "medium").otherwise("low")
    return ev.agreement(annotators(spark, d), "a", "b").select("n", F.round(pct, 2).alias("pct"), "n11", "n00", "n10", "n01", band.alias("band"))


@query("met_consensus", f"SELECT fragment_id, CASE WHEN a = b THEN a END AS label, a <> b AS disagreement FROM {_AB}")
def met_consensus(spark, d):
    return annotators(spark, d).select("fragment_id", F.when(F.col("a") == F.col("b"), F.col("a")).alias("label"), (F.col("a") != F.col("b")).alias("disagreement"))


_LAB = "['INTRO','BACK','METH','RES','DISC','LIM','CONC','CONTR']"
_GOLD = "(SELECT annotator_1 AS actual, annotator_2 AS pred FROM gold_items WHERE item_set = 'gold_t1')"
LABELS = ["INTRO", "BACK", "METH", "RES", "DISC", "LIM", "CONC", "CONTR"]


def _gold(spark, d):
    return table(spark, d, "gold_items", "item_set", "annotator_1", "annotator_2").filter("item_set = 'gold_t1'").select(F.col("annotator_1").alias("actual"), F.col("annotator_2").alias("pred"))


_CONF = f"SELECT x.actual, y.pred, count(g.actual) AS n FROM (SELECT unnest({_LAB}) AS actual) x CROSS JOIN (SELECT unnest({_LAB}) AS pred) y LEFT JOIN {_GOLD} g ON g.actual = x.actual AND g.pred = y.pred GROUP BY ALL"


@query("met_confusion", _CONF)
def met_confusion(spark, d):
    return ev.confusion(_gold(spark, d), "actual", "pred", LABELS)


@query("met_confusion_norm", f"SELECT actual, pred, round(n / greatest(sum(n) OVER (PARTITION BY actual), 1), 6) AS share FROM ({_CONF})")
def met_confusion_norm(spark, d):
    rows = ev.confusion(_gold(spark, d), "actual", "pred", LABELS)
    return rows.select("actual", "pred", F.round(F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy("actual")), F.lit(1)), 6).alias("share"))


_PRF = f"SELECT l.label, count(*) FILTER (g.actual = l.label AND g.pred = l.label) AS tp, count(*) FILTER (g.actual <> l.label AND g.pred = l.label) AS fp, count(*) FILTER (g.actual = l.label AND g.pred <> l.label) AS fn FROM (SELECT unnest({_LAB}) AS label) l CROSS JOIN {_GOLD} g GROUP BY l.label"


@query("met_prf", f"SELECT label, tp + fn AS support, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM ({_PRF})")
def met_prf(spark, d):
    return ev.class_scores(_gold(spark, d), "actual", "pred", LABELS).select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("met_prf_avg", f"SELECT round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(sum(tp) / (SELECT count(*) FROM {_GOLD}), 6) AS accuracy FROM ({_PRF})")
def met_prf_avg(spark, d):
    return ev.averages(_gold(spark, d), "actual", "pred", LABELS).select(*[F.round(c, 6).alias(c) for c in ("macro_f1", "micro_f1", "accuracy")])


_BIN = "(SELECT fragment_id, (a1_label = 'ES_CONTRIBUCION')::INT AS y, round(score_implicit * 0.5 + score_explicit * 0.5, 4) AS p FROM {FRG} WHERE a1_label IS NOT NULL AND score_implicit IS NOT NULL AND score_explicit IS NOT NULL)"


def _scored(spark, d):
    return frg(spark, d, "a1_label", "score_implicit", "score_explicit").filter("a1_label is not null and score_implicit is not null and score_explicit is not null").select("fragment_id", (F.col("a1_label") == "ES_CONTRIBUCION").cast("int").alias("y"), F.round(F.col("score_implicit") * 0.5 + F.col("score_explicit") * 0.5, 4).alias("p"))


_SWEEP = f"""SELECT t, (coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)) / 2 AS f1 FROM (SELECT t, count(*) FILTER (y = 1 AND p >= t) AS tp, count(*) FILTER (y = 0 AND p >= t) AS fp,
 count(*) FILTER (y = 1 AND p < t) AS fn, count(*) FILTER (y = 0 AND p < t) AS tn FROM {_BIN} CROSS JOIN (SELECT unnest(range(17)) * 25 / 1000.0 + 0.3 AS t) GROUP BY t)"""


@query("met_threshold_sweep", f"""WITH s AS (SELECT round(t, 3) AS t, round(f1, 6) AS f1 FROM ({_SWEEP})), m AS (SELECT max(f1) AS best FROM s), q AS (SELECT t FROM s, m WHERE f1 >= best - 0.0001)
 SELECT round(best, 6) AS best_f1, (SELECT t FROM q ORDER BY round(abs(t - 0.5), 6), t LIMIT 1) AS threshold, (SELECT min(t) FROM q) AS plateau_min, (SELECT max(t) FROM q) AS plateau_max FROM m""")
def met_threshold_sweep(spark, d):
    return ev.threshold_sweep(_scored(spark, d), "y", "p", [round(0.3 + 0.025 * k, 3) for k in range(17)])


@query("met_auc", f"""WITH r AS (SELECT y, p, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM {_BIN}),
 c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM {_BIN} GROUP BY p), w AS (SELECT p, pos, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(n) OVER (ORDER BY p DESC) AS k FROM c)
 SELECT round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, (SELECT round(sum(pos * tp / k) / sum(pos), 6) FROM w) AS average_precision FROM r""")
def met_auc(spark, d):
    return ev.ranking_scores(_scored(spark, d), "y", "p").select(F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


@query("met_curves", f"WITH c AS (SELECT p, sum(y) AS pos, count(*) AS n FROM {_BIN} GROUP BY p) SELECT p AS threshold, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr, round((sum(n) OVER w - sum(pos) OVER w) / (sum(n) OVER () - sum(pos) OVER ()), 6) AS fpr, round(sum(pos) OVER w / sum(n) OVER w, 6) AS precision FROM c WINDOW w AS (ORDER BY p DESC)")
def met_curves(spark, d):
    return ev.curves(_scored(spark, d), "y", "p").select("threshold", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision")])


@query("met_bootstrap")
def met_bootstrap(spark, d):
    """Macro-F1 of 1,000 resamples: mean, deviation and the middle 95 %."""
    out = ev.bootstrap_f1(_scored(spark, d).select("y", (F.col("p") >= 0.3).cast("int").alias("yhat")), "y", "yhat")
    return out.select("samples", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


@query("met_f1_section", f"""SELECT section, count(*) AS n, round(coalesce(2 * count(*) FILTER (y = 1 AND p >= 0.3) / nullif(2 * count(*) FILTER (y = 1 AND p >= 0.3) + count(*) FILTER ((y = 1) <> (p >= 0.3)), 0), 0), 6) AS f1
 FROM {_BIN} b JOIN (SELECT fragment_id, coalesce(lower(section_hint), 'unknown') AS section FROM {{FRG}}) s USING (fragment_id) GROUP BY section HAVING count(*) >= 3""")
def met_f1_section(spark, d):
    rows = _scored(spark, d).join(frg(spark, d, "section_hint").select("fragment_id", F.coalesce(F.lower("section_hint"), F.lit("unknown")).alias("section")), "fragment_id")
    yes = F.col("p") >= 0.3
    tp, wrong = F.count_if((F.col("y") == 1) & yes), F.count_if((F.col("y") == 1) != yes)
    return rows.groupBy("section").agg(F.count("*").alias("n"), F.round(F.coalesce(F.try_divide(2 * tp, 2 * tp + wrong), F.lit(0.0)), 6).alias("f1")).filter("n >= 3")


@query("met_reliability", f"SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(y), 6) AS observed, round(avg(p), 5) AS predicted FROM {_BIN} GROUP BY 1")
def met_reliability(spark, d):
    return _scored(spark, d).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("observed"), F.round(F.avg("p"), 5).alias("predicted"))


#: What models answered of paragraphs of a request, against whether the request has a paragraph marked as a contribution.
_SAID = "(SELECT l.model_id, coalesce(regexp_matches(lower(trim(l.raw_answer)), '^(si|sí|yes)'), false)::INT AS yhat, r.y FROM {LOG} l JOIN (SELECT request_id, max((t1_label = 'CONTR')::INT) AS y FROM {SEG} GROUP BY 1) r USING (request_id) WHERE l.task = 'T2')"
_F1 = "coalesce(2 * count(*) FILTER (y = 1 AND yhat = 1) / nullif(2 * count(*) FILTER (y = 1 AND yhat = 1) + count(*) FILTER (y <> yhat), 0), 0)"
_REC = "coalesce(count(*) FILTER (y = 1 AND yhat = 1) / nullif(count(*) FILTER (y = 1), 0), 0)"


def model_answers(spark, d):
    from lectern.operators.answers import yes_no

    asked = seg(spark, d, "request_id", "t1_label").groupBy("request_id").agg(F.max((F.col("t1_label") == "CONTR").cast("int")).alias("y"))
    return log(spark, d, "model_id", "task", "request_id", "raw_answer").filter("task = 'T2'").select("model_id", "request_id", yes_no("raw_answer").alias("yhat")).join(asked, "request_id")


_CAT = "CASE WHEN y = 1 AND p >= 0.3 THEN 'TP' WHEN y = 0 AND p >= 0.3 THEN 'FP' WHEN y = 0 THEN 'TN' ELSE 'FN' END"


@query("met_error_cat", f"SELECT {_CAT} AS category, count(*) AS n, round(avg(f.word_count), 6) AS mean_words, round(quantile_cont(f.word_count, 0.5), 6) AS median_words FROM {_BIN} b JOIN {{FRG}} f USING (fragment_id) GROUP BY 1")
def met_error_cat(spark, d):
    yes = F.col("p") >= 0.3
    cat = F.when((F.col("y") == 1) & yes, "TP").when((F.col("y") == 0) & yes, "FP").when(F.col("y") == 0, "TN").otherwise("FN")
    return _scored(spark, d).join(frg(spark, d, "word_count"), "fragment_id").groupBy(cat.alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("word_count"), 6).alias("mean_words"), F.round(F.percentile("word_count", F.lit(0.5)), 6).alias("median_words"))


@query("met_shortcut", "SELECT lower(section_hint) AS section, count(*) AS n, round(100.0 * avg((a1_label = 'ES_CONTRIBUCION')::INT), 6) AS pct_pos FROM {FRG} WHERE a1_label IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 AND (avg((a1_label = 'ES_CONTRIBUCION')::INT) >= 0.8 OR avg((a1_label = 'ES_CONTRIBUCION')::INT) <= 0.2)")
def met_shortcut(spark, d):
    p = 100.0 * F.avg((F.col("a1_label") == "ES_CONTRIBUCION").cast("int"))
    return frg(spark, d, "section_hint", "a1_label").filter("a1_label is not null").groupBy(F.lower("section_hint").alias("section")).agg(F.count("*").alias("n"), F.round(p, 6).alias("pct_pos")).filter("n >= 5 and (pct_pos >= 80 or pct_pos <= 20)")


_FD = "lower(regexp_replace(trim(doc_id), '\\.(txt|json|jsonl)$', '', 'i'))"


@query("met_leak", f"SELECT count(*) AS leaking_docs, CASE WHEN count(*) = 0 THEN 'clean' ELSE 'leak' END AS verdict FROM (SELECT {_FD} AS doc FROM {{FRG}} WHERE split IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(split))) > 1)")
def met_leak(spark, d):
    docs = frg(spark, d, "split", "doc_id").filter("split is not null and doc_id is not null").groupBy(plain_doc().alias("doc")).agg(F.countDistinct(F.lower(F.trim("split"))).alias("k")).filter("k > 1")
    return docs.agg(F.count("*").alias("leaking_docs")).select("leaking_docs", F.when(F.col("leaking_docs") == 0, "clean").otherwise("leak").alias("verdict"))


@query("met_fewshot_delta", f"""WITH m AS (SELECT model_id, count(*) AS n, round({_F1}, 6) AS f1, round({_REC}, 6) AS recall FROM {_SAID} GROUP BY model_id)
 SELECT model_id, row_number() OVER (ORDER BY f1 DESC, model_id) AS place, f1, round(f1 - min(f1) OVER (), 6) AS f1_delta, round(recall - min(recall) OVER (), 6) AS recall_delta, round(n * 500 * 0.15 / 1000000 + n * 5 * 0.6 / 1000000, 6) AS cost_usd FROM m""")
def met_fewshot_delta(spark, d):
    """Models by F1 of their yes or no, what each gains over the weakest in F1 and recall, and what it costs."""
    m = ev.binary_by(model_answers(spark, d), "model_id", "y", "yhat").select("model_id", "n", F.round("f1", 6).alias("f1"), F.round("recall", 6).alias("recall"))
    low = m.agg(F.min("f1").alias("low_f1"), F.min("recall").alias("low_recall"))
    return m.join(F.broadcast(low)).select("model_id", F.row_number().over(Window.orderBy(F.desc("f1"), "model_id")).alias("place"), "f1", F.round(F.col("f1") - F.col("low_f1"), 6).alias("f1_delta"), F.round(F.col("recall") - F.col("low_recall"), 6).alias("recall_delta"), F.round(F.col("n") * 500 * 0.15 / 1000000 + F.col("n") * 5 * 0.6 / 1000000, 6).alias("cost_usd"))


@query("met_split_diag", """WITH s AS (SELECT lower(trim(split)) AS part, avg((a1_label = 'ES_CONTRIBUCION')::INT) AS pos FROM {FRG} WHERE split IS NOT NULL AND a1_label IS NOT NULL GROUP BY 1)
 SELECT part, round(pos, 6) AS pos, (SELECT max(pos) - min(pos) < 0.05 FROM s) AS even, pos < 0.05 OR pos > 0.95 AS unbalanced FROM s""")
def met_split_diag(spark, d):
    s = frg(spark, d, "split", "a1_label").filter("split is not null and a1_label is not null").groupBy(F.lower(F.trim("split")).alias("part")).agg(F.avg((F.col("a1_label") == "ES_CONTRIBUCION").cast("int")).alias("p"))
    return s.join(F.broadcast(s.agg((F.max("p") - F.min("p") < 0.05).alias("even")))).select("part", F.round("p", 6).alias("pos"), "even", ((F.col("p") < 0.05) | (F.col("p") > 0.95)).alias("unbalanced"))


_HITS2 = f"len(regexp_extract_all(x, '{tx.duck(lexicon.T2_PATTERN)}')) > 0"
_MACRO = "(coalesce(2 * tp / nullif(2 * tp + w, 0), 0) + coalesce(2 * tn / nullif(2 * tn + w, 0), 0)) / 2"
_ARMS = {"whole": "text", "random_prefix": "'[SECCION:' || CASE WHEN substr(md5(concat_ws('|', '42', fragment_id)), 1, 1) <= '7' THEN 'BACK' ELSE 'INTRO' END || '] [POS:0.5] ' || text", "empty_text": "''"}


@query("met_ablation", f"""WITH v AS (SELECT *, (a1_label = 'ES_CONTRIBUCION') AS y FROM {{FRG}} WHERE a1_label IS NOT NULL), a AS (SELECT fragment_id, y, unnest(['whole', 'random_prefix', 'empty_text']) AS arm,
 unnest([{', '.join(_ARMS.values())}]) AS x FROM v), s AS (SELECT arm, count(*) FILTER (y AND h) AS tp, count(*) FILTER (NOT y AND NOT h) AS tn, count(*) FILTER (y <> h) AS w FROM (SELECT arm, y, {_HITS2} AS h FROM a) GROUP BY arm),
 f AS (SELECT arm, {_MACRO} AS f1 FROM s) SELECT arm, round(f1, 6) AS macro_f1, round(w.f - f1, 6) AS drop_f1, CASE WHEN w.f - f1 > 0.2 THEN 'content' WHEN w.f - f1 > 0.05 THEN 'mixed' ELSE 'shortcut' END AS verdict FROM f, (SELECT f1 AS f FROM f WHERE arm = 'whole') w WHERE arm <> 'whole'""")
def met_ablation(spark, d):
    """Macro-F1 of the contribution rules with a random context prefix and with an empty text, and the drop from the whole text."""
    from lectern.operators import answers, rhetoric

    rows = frg(spark, d, "text", "a1_label").filter("a1_label is not null").withColumn("y", (F.col("a1_label") == "ES_CONTRIBUCION").cast("int"))
    low = F.substring(F.md5(F.concat_ws("|", F.lit("42"), "fragment_id")), 1, 1).isin(*"01234567")
    prefixed = answers.context_prefix(F.when(low, "BACK").otherwise("INTRO"), F.lit(0.5), "text")
    return ev.ablation(rows, "y", {"whole": F.col("text"), "random_prefix": prefixed, "empty_text": F.lit("")}, "whole", lambda x: (rhetoric.contribution_hits(x) > 0).cast("int"))
