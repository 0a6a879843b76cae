"""Aggregations over segments, fragments and logs."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lectern.functions import lexicon, text as tx
from lectern.operators import statistics as st
from lectern.plans.registry import frg, log, query, seg
from lectern.sources.tables import table


def _r(c, n=6):
    return F.round(c, n)


@query("agg_label_dist", """SELECT request_id, t1_label, count(*) AS n, sum(CASE WHEN low_confidence THEN 1 ELSE 0 END) AS n_low, round(avg(t1_confidence)::DECIMAL(18, 9), 3)::DOUBLE AS mean_conf
 FROM {SEG} GROUP BY ALL""")
def agg_label_dist(spark, d):
    return seg(spark, d, "request_id", "t1_label", "low_confidence", "t1_confidence").groupBy("request_id", "t1_label").agg(
        F.count("*").alias("n"), F.count_if("low_confidence").alias("n_low"), _r(_r(F.avg("t1_confidence"), 9), 3).alias("mean_conf"))


@query("agg_contrib_summary", """SELECT request_id, count(*) AS total_fragments, count(*) FILTER (t1_label = 'CONTR') AS contributions_detected,
 round(count(*) FILTER (t1_label = 'CONTR') / greatest(count(*), 1), 3) AS contribution_rate,
 count(*) FILTER (t1_label = 'CONTR' AND lower(rhetorical_zone) = 'inicio') AS in_start, count(*) FILTER (t1_label = 'CONTR' AND lower(rhetorical_zone) = 'desarrollo') AS in_middle,
 count(*) FILTER (t1_label = 'CONTR' AND lower(rhetorical_zone) = 'cierre') AS in_end FROM {SEG} GROUP BY request_id""")
def agg_contrib_summary(spark, d):
    yes, zone = F.col("t1_label") == "CONTR", F.lower("rhetorical_zone")
    return seg(spark, d, "request_id", "t1_label", "rhetorical_zone").groupBy("request_id").agg(
        F.count("*").alias("total_fragments"), F.count_if(yes).alias("contributions_detected"), _r(F.count_if(yes) / F.greatest(F.count("*"), F.lit(1)), 3).alias("contribution_rate"),
        *[F.count_if(yes & (zone == z)).alias(n) for z, n in (("inicio", "in_start"), ("desarrollo", "in_middle"), ("cierre", "in_end"))])


@query("agg_class_balance", """SELECT lower(trim(split)) AS split_key, count(*) AS n, count(*) FILTER (a1_label = 'ES_CONTRIBUCION') AS pos, count(*) FILTER (a1_label = 'NO_ES_CONTRIBUCION') AS neg,
 round(count(*) FILTER (a1_label = 'ES_CONTRIBUCION') / nullif(count(*) FILTER (a1_label = 'NO_ES_CONTRIBUCION'), 0), 3) AS ratio, count(DISTINCT lower(trim(doc_id))) AS docs
 FROM {FRG} GROUP BY 1""")
def agg_class_balance(spark, d):
    pos, neg = F.count_if(F.col("a1_label") == "ES_CONTRIBUCION"), F.count_if(F.col("a1_label") == "NO_ES_CONTRIBUCION")
    return frg(spark, d, "split", "a1_label", "doc_id").groupBy(F.lower(F.trim("split")).alias("split_key")).agg(
        F.count("*").alias("n"), pos.alias("pos"), neg.alias("neg"), _r(F.try_divide(pos, neg), 3).alias("ratio"), F.countDistinct(F.lower(F.trim("doc_id"))).alias("docs"))


@query("agg_value_counts", """SELECT l.label, coalesce(n, 0) AS n FROM (SELECT unnest(['INTRO','BACK','METH','RES','DISC','CONTR','LIM','CONC','NONE']) AS label) l
 LEFT JOIN (SELECT t1_label, count(*) AS n FROM {SEG} GROUP BY 1) c ON c.t1_label = l.label""")
def agg_value_counts(spark, d):
    domain = spark.createDataFrame([(x,) for x in ("INTRO", "BACK", "METH", "RES", "DISC", "CONTR", "LIM", "CONC", "NONE")], "label string")
    counts = seg(spark, d, "t1_label").groupBy(F.col("t1_label").alias("label")).agg(F.count("*").alias("n"))
    return F.broadcast(domain).join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


_PERCENTS = (0.05, 0.25, 0.5, 0.75, 0.95)


@query("agg_describe", """SELECT t1_label, count(word_count) AS n, round(avg(word_count), 6) AS mean, round(stddev_samp(word_count), 6) AS std, min(word_count) AS min, max(word_count) AS max,
 round(quantile_cont(word_count, 0.05), 6) AS p05, round(quantile_cont(word_count, 0.25), 6) AS p25, round(quantile_cont(word_count, 0.5), 6) AS p50, round(quantile_cont(word_count, 0.75), 6) AS p75, round(quantile_cont(word_count, 0.95), 6) AS p95
 FROM {SEG} GROUP BY t1_label""")
def agg_describe(spark, d):
    c = "word_count"
    return seg(spark, d, "t1_label", c).groupBy("t1_label").agg(
        F.count(c).alias("n"), _r(F.avg(c)).alias("mean"), _r(F.stddev_samp(c)).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        *[_r(F.percentile(c, F.lit(p))).alias(f"p{round(p * 100):02d}") for p in _PERCENTS])


@query("agg_mean_score", "SELECT contr_type, round(avg(score_explicit), 2) AS mean_score FROM {FRG} GROUP BY contr_type")
def agg_mean_score(spark, d):
    return frg(spark, d, "contr_type", "score_explicit").groupBy("contr_type").agg(_r(F.avg("score_explicit"), 2).alias("mean_score"))


@query("agg_nunique", "SELECT doc_id, count(DISTINCT t1_label) AS labels FROM {SEG} WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING count(DISTINCT t1_label) > 1")
def agg_nunique(spark, d):
    return seg(spark, d, "doc_id", "t1_label").filter("doc_id is not null").groupBy("doc_id").agg(F.countDistinct("t1_label").alias("labels")).filter("labels > 1")


@query("agg_docs_per_count", "SELECT n AS segments_per_doc, count(*) AS docs FROM (SELECT doc_id, count(*) AS n FROM {SEG} GROUP BY doc_id) GROUP BY n")
def agg_docs_per_count(spark, d):
    return seg(spark, d, "doc_id").groupBy("doc_id").agg(F.count("*").alias("segments_per_doc")).groupBy("segments_per_doc").agg(F.count("*").alias("docs"))


@query("agg_multi", """SELECT t1_label, round(avg(CASE WHEN low_confidence THEN 100.0 ELSE 0 END), 6) AS pct_low, round(avg(length(text)), 6) AS mean_chars,
 round(avg(CASE WHEN contains(text, chr(10)) THEN 100.0 ELSE 0 END), 6) AS pct_multiline FROM {SEG} GROUP BY t1_label""")
def agg_multi(spark, d):
    share = lambda c: _r(F.avg(F.when(c, 100.0).otherwise(0.0)))
    return seg(spark, d, "t1_label", "low_confidence", "text").groupBy("t1_label").agg(
        share(F.col("low_confidence")).alias("pct_low"), _r(F.avg(F.length("text"))).alias("mean_chars"), share(F.contains("text", F.lit("\n"))).alias("pct_multiline"))


@query("agg_decoupling", "SELECT lower(trim(contr_type)) AS kind, a1_label, count(*) AS n, round(avg(word_count), 6) AS mean_words FROM {FRG} GROUP BY ALL")
def agg_decoupling(spark, d):
    return frg(spark, d, "contr_type", "a1_label", "word_count").groupBy(F.lower(F.trim("contr_type")).alias("kind"), "a1_label").agg(F.count("*").alias("n"), _r(F.avg("word_count")).alias("mean_words"))


@query("agg_pivot_crosstab", """SELECT model_id, count(*) FILTER (lower(rhetorical_zone) = 'inicio') AS inicio, count(*) FILTER (lower(rhetorical_zone) = 'desarrollo') AS desarrollo,
 count(*) FILTER (lower(rhetorical_zone) = 'cierre') AS cierre, count(*) AS total, round(100.0 * count(*) FILTER (lower(rhetorical_zone) = 'cierre') / count(*), 1) AS pct_cierre FROM {SEG} GROUP BY model_id""")
def agg_pivot_crosstab(spark, d):
    zones = ["inicio", "desarrollo", "cierre"]
    out = seg(spark, d, "model_id", "rhetorical_zone").withColumn("zone", F.lower("rhetorical_zone")).groupBy("model_id").pivot("zone", zones).count().fillna(0)
    total = F.col("inicio") + F.col("desarrollo") + F.col("cierre")
    return out.select("model_id", *zones, total.alias("total"), _r(100.0 * F.col("cierre") / total, 1).alias("pct_cierre"))


@query("agg_pivot_median", """SELECT t1_label, round(quantile_cont(word_count, 0.5) FILTER (NOT low_confidence), 6) AS sure, round(quantile_cont(word_count, 0.5) FILTER (low_confidence), 6) AS unsure,
 round(100.0 * (quantile_cont(word_count, 0.5) FILTER (low_confidence) - quantile_cont(word_count, 0.5) FILTER (NOT low_confidence)) / nullif(quantile_cont(word_count, 0.5) FILTER (NOT low_confidence), 0), 4) AS pct_diff FROM {SEG} GROUP BY t1_label""")
def agg_pivot_median(spark, d):
    half = lambda c: F.percentile(F.when(c, F.col("word_count")), F.lit(0.5))
    out = seg(spark, d, "t1_label", "low_confidence", "word_count").groupBy("t1_label").agg(half(~F.col("low_confidence")).alias("a"), half(F.col("low_confidence")).alias("b"))
    return out.select("t1_label", _r("a").alias("sure"), _r("b").alias("unsure"), _r(F.try_divide(100.0 * (F.col("b") - F.col("a")), "a"), 4).alias("pct_diff"))


@query("agg_pivot_custom", """SELECT t1_label, round(100.0 * avg(CASE WHEN word_count > 50 THEN 1 ELSE 0 END) FILTER (lower(rhetorical_zone) = 'inicio'), 6) AS inicio,
 round(100.0 * avg(CASE WHEN word_count > 50 THEN 1 ELSE 0 END) FILTER (lower(rhetorical_zone) = 'cierre'), 6) AS cierre FROM {SEG} GROUP BY t1_label""")
def agg_pivot_custom(spark, d):
    long = F.avg(F.when(F.col("word_count") > 50, 1).otherwise(0)) * 100.0
    out = seg(spark, d, "t1_label", "rhetorical_zone", "word_count").withColumn("zone", F.lower("rhetorical_zone")).groupBy("t1_label").pivot("zone", ["inicio", "cierre"]).agg(long)
    return out.select("t1_label", _r("inicio").alias("inicio"), _r("cierre").alias("cierre"))


@query("agg_topk_terms", """SELECT kind, term, n FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, term) AS r FROM (
 SELECT kind, term, count(*) AS n FROM (SELECT lower(trim(contr_type)) AS kind, lower(trim(unnest(regexp_split_to_array(section_hint, '[,;]|\\s+y\\s+')))) AS term FROM {FRG} WHERE section_hint IS NOT NULL) WHERE term <> '' GROUP BY ALL)) WHERE r <= 5""")
def agg_topk_terms(spark, d):
    terms = frg(spark, d, "contr_type", "section_hint").select(F.lower(F.trim("contr_type")).alias("kind"), F.explode(F.split("section_hint", r"[,;]|\s+y\s+")).alias("term"))
    counts = terms.select("kind", F.lower(F.trim("term")).alias("term")).filter("term <> ''").groupBy("kind", "term").agg(F.count("*").alias("n"))
    return counts.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "term"))).filter("r <= 5").drop("r")


@query("agg_hit_freq", """SELECT label, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM {FRG} WHERE len(explicit_hits) > 0), 6) AS pct
 FROM (SELECT unnest(explicit_hits).label AS label FROM {FRG}) GROUP BY label""")
def agg_hit_freq(spark, d):
    rows = frg(spark, d, "explicit_hits").filter("size(explicit_hits) > 0")
    return rows.select(F.explode("explicit_hits.label").alias("label")).groupBy("label").agg(F.count("*").alias("n")).join(F.broadcast(rows.agg(F.count("*").alias("all")))).select("label", "n", _r(100.0 * F.col("n") / F.col("all")).alias("pct"))


#: Common words left out of word counts.
STOPWORDS = "para como este esta estos estas entre desde hasta sobre según cuando donde pero sino también más menos todo toda todos todas otro otra otros otras cada cuya cuyo porque aunque mientras durante ante bajo tras sido fueron cual cuales".split()
_TOP = "SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zñáéíóúü]{4,}')) AS word FROM {src} WHERE {cond}) WHERE word NOT IN ({stop}) GROUP BY word) ORDER BY n DESC, word LIMIT {k}"
_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_TOP_ALL = _TOP.replace("{src}", "{FRG}").replace("{stop}", _STOP)


def _top_words(df, k):
    found = df.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zñáéíóúü]{4,}"), F.lit(0))).alias("word")).filter(~F.col("word").isin(*STOPWORDS))
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(k)


@query("agg_top_words", _TOP_ALL.replace("{cond}", "true").replace("{k}", "60"))
def agg_top_words(spark, d):
    return _top_words(frg(spark, d, "text"), 60)


_A, _B = (_TOP_ALL.replace("{cond}", f"a1_label = '{x}'").replace("{k}", "200") for x in ("ES_CONTRIBUCION", "NO_ES_CONTRIBUCION"))


@query("agg_vocab_diff", f"SELECT word FROM ({_A}) WHERE word NOT IN (SELECT word FROM ({_B}))")
def agg_vocab_diff(spark, d):
    rows = frg(spark, d, "text", "a1_label")
    return _top_words(rows.filter("a1_label = 'ES_CONTRIBUCION'"), 200).select("word").subtract(_top_words(rows.filter("a1_label = 'NO_ES_CONTRIBUCION'"), 200).select("word"))


EDGES = (250, 300, 350, 400, 450, 500, 2000)
_BIN = "CASE " + " ".join(f"WHEN word_count >= {a} AND word_count < {b} THEN '[{a},{b})'" for a, b in zip(EDGES, EDGES[1:])) + " END"


@query("agg_hist", f"SELECT {_BIN} AS bin, a1_label, count(*) AS n FROM {{FRG}} GROUP BY ALL")
def agg_hist(spark, d):
    return frg(spark, d, "word_count", "a1_label").groupBy(st.bin_label("word_count", EDGES).alias("bin"), "a1_label").agg(F.count("*").alias("n"))


@query("agg_cut", f"SELECT fragment_id, {_BIN} AS bin FROM {{FRG}}")
def agg_cut(spark, d):
    """The range of words of every fragment; none outside all ranges."""
    return frg(spark, d, "word_count").select("fragment_id", st.bin_label("word_count", EDGES).alias("bin"))


@query("agg_hist2d", """SELECT x, y, count(*) AS n FROM (SELECT least(floor(10 * (relative_pos - min(relative_pos) OVER ()) / nullif(max(relative_pos) OVER () - min(relative_pos) OVER (), 0)), 9)::INT AS x,
 least(floor(10 * (word_count - min(word_count) OVER ()) / nullif(max(word_count) OVER () - min(word_count) OVER (), 0)), 9)::INT AS y FROM {SEG} WHERE relative_pos IS NOT NULL AND word_count IS NOT NULL) GROUP BY ALL""")
def agg_hist2d(spark, d):
    return st.histogram2d(seg(spark, d, "relative_pos", "word_count"), "relative_pos", "word_count", 10)


@query("agg_cdf", "SELECT a1_label, word_count, round(cume_dist() OVER (PARTITION BY a1_label ORDER BY word_count), 6) AS cdf, 1 AS one FROM {FRG} WHERE word_count IS NOT NULL AND a1_label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a1_label, word_count ORDER BY fragment_id) = 1")
def agg_cdf(spark, d):
    return st.ecdf(frg(spark, d, "a1_label", "word_count").filter("word_count is not null and a1_label is not null"), ["a1_label"], "word_count").select("a1_label", "word_count", _r("cdf").alias("cdf"), F.lit(1).alias("one"))


@query("agg_density", """WITH v AS (SELECT a1_label AS g, relative_pos AS x FROM {FRG} WHERE a1_label IS NOT NULL AND relative_pos IS NOT NULL), s AS (SELECT g, count(*) AS n, 0.15 * stddev_samp(x) AS h FROM v GROUP BY g),
 p AS (SELECT unnest(range(200)) / 199.0 AS at) SELECT s.g AS a1_label, round(p.at, 6) AS at, round(sum(exp(0 - (((p.at - v.x) / s.h) ** 2) / 2)) / (any_value(s.n) * any_value(s.h) * sqrt(2 * pi())), 6) AS density FROM v JOIN s USING (g) CROSS JOIN p GROUP BY ALL""")
def agg_density(spark, d):
    rows = frg(spark, d, "a1_label", "relative_pos").filter("a1_label is not null and relative_pos is not null")
    out = st.density(rows, "a1_label", "relative_pos", 0.15, 0.0, 1.0, 200)
    return out.select("a1_label", _r("at").alias("at"), _r("density").alias("density"))


_NUM = ("word_count", "relative_pos", "score_explicit", "score_implicit", "char_start")
_EIGHT = (*_NUM, "char_end", "n_explicit", "n_implicit")


@query("agg_corr", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM (SELECT *, len(explicit_hits) AS n_explicit, len(implicit_hits) AS n_implicit FROM {{FRG}})" for a in _EIGHT for b in _EIGHT))
def agg_corr(spark, d):
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    rows = frg(spark, d, *_NUM, "char_end", "explicit_hits", "implicit_hits").withColumns({"n_explicit": size("explicit_hits"), "n_implicit": size("implicit_hits")})
    return st.correlations(rows, _EIGHT).select("a", "b", _r("r").alias("r"))


@query("agg_cohen_d", " UNION ALL ".join(f"""SELECT '{c}' AS feature, round(coalesce(abs(avg({c}) FILTER (p) - avg({c}) FILTER (NOT p)) / nullif(sqrt((stddev_samp({c}) FILTER (p) ** 2 + stddev_samp({c}) FILTER (NOT p) ** 2) / 2), 0), 0), 6) AS d
 FROM (SELECT *, a1_label = 'ES_CONTRIBUCION' AS p FROM {{FRG}} WHERE a1_label IS NOT NULL)""" for c in _NUM))
def agg_cohen_d(spark, d):
    rows = frg(spark, d, "a1_label", *_NUM).filter("a1_label is not null").withColumn("p", F.col("a1_label") == "ES_CONTRIBUCION")
    return st.cohen_d(rows, "p", _NUM).select("feature", _r("d").alias("d"))


@query("agg_mannwhitney", """WITH v AS (SELECT a1_label = 'ES_CONTRIBUCION' AS p, word_count AS x FROM {FRG} WHERE a1_label IS NOT NULL AND word_count IS NOT NULL),
 r AS (SELECT p, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rk FROM v)
 SELECT count(*) FILTER (p) AS n1, count(*) FILTER (NOT p) AS n0, sum(rk) FILTER (p) - count(*) FILTER (p) * (count(*) FILTER (p) + 1) / 2.0 AS u FROM r""")
def agg_mannwhitney(spark, d):
    rows = frg(spark, d, "a1_label", "word_count").filter("a1_label is not null and word_count is not null").select((F.col("a1_label") == "ES_CONTRIBUCION").alias("p"), F.col("word_count").alias("x"))
    return st.mann_whitney(rows, "p", "x").select("n1", "n0", "u")


@query("agg_mannwhitney_p")
def agg_mannwhitney_p(spark, d):
    """U with its tie-corrected two-sided p-value and stars (normal approximation)."""
    rows = frg(spark, d, "a1_label", "word_count").filter("a1_label is not null and word_count is not null").select((F.col("a1_label") == "ES_CONTRIBUCION").alias("p"), F.col("word_count").alias("x"))
    return st.mann_whitney(rows, "p", "x")


@query("agg_ks", """WITH v AS (SELECT lower(trim(split)) = 'train' AS p, relative_pos AS x FROM {FRG} WHERE split IS NOT NULL AND a1_label = 'ES_CONTRIBUCION' AND relative_pos IS NOT NULL),
 c AS (SELECT x, count(*) FILTER (p) AS a, count(*) FILTER (NOT p) AS b FROM v GROUP BY x) SELECT round(max(abs(fa - fb)), 6) AS d FROM (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb FROM c)""")
def agg_ks(spark, d):
    rows = frg(spark, d, "split", "a1_label", "relative_pos").filter("split is not null and a1_label = 'ES_CONTRIBUCION' and relative_pos is not null")
    return st.kolmogorov_smirnov(rows.select((F.lower(F.trim("split")) == "train").alias("p"), F.col("relative_pos").alias("x")), "p", "x").select(_r("d").alias("d"))


@query("agg_run_stats", """SELECT count(*) AS total, count(*) FILTER (lower(trim(tarea2_role)) = 'positive') AS positives, greatest(0, 500 - count(*) FILTER (lower(trim(tarea2_role)) = 'positive')) AS pending_positives,
 greatest(0, 100 - count(*) FILTER (lower(trim(tarea2_role)) = 'negative')) AS pending_negatives, count(*) FILTER (lower(trim(tarea2_role)) = 'positive') >= 500 AND count(*) FILTER (lower(trim(tarea2_role)) = 'negative') >= 100 AS all_met FROM {FRG}""")
def agg_run_stats(spark, d):
    role = F.lower(F.trim("tarea2_role"))
    out = frg(spark, d, "tarea2_role").agg(F.count("*").alias("total"), F.count_if(role == "positive").alias("positives"), F.count_if(role == "negative").alias("negatives"))
    pend = lambda c, n: F.greatest(F.lit(0), F.lit(n) - F.col(c))
    return out.select("total", "positives", pend("positives", 500).alias("pending_positives"), pend("negatives", 100).alias("pending_negatives"), ((F.col("positives") >= 500) & (F.col("negatives") >= 100)).alias("all_met"))


@query("agg_missing_dup", """SELECT count(*) FILTER (doc_id IS NULL) AS null_doc, count(*) FILTER (word_count IS NULL) AS null_words, count(*) FILTER (relative_pos IS NULL) AS null_pos, count(*) - count(DISTINCT seg_id) AS repeated FROM segments""")
def agg_missing_dup(spark, d):
    null = lambda c: F.count_if(F.col(c).isNull())
    return table(spark, d, "segments", "seg_id", "doc_id", "word_count", "relative_pos").agg(null("doc_id").alias("null_doc"), null("word_count").alias("null_words"), null("relative_pos").alias("null_pos"), (F.count("*") - F.countDistinct("seg_id")).alias("repeated"))


@query("agg_class_weights", "SELECT t1_label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM {SEG} GROUP BY t1_label")
def agg_class_weights(spark, d):
    counts = seg(spark, d, "t1_label").groupBy("t1_label").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("all"), F.count("*").alias("k")))).select("t1_label", _r(F.col("all") / (F.col("k") * F.col("n"))).alias("weight"))


_YES = "SELECT request_id, model_id, max((lower(trim(raw_answer)) ~ '^(si|sí|yes)')::INT) AS yes FROM {LOG} WHERE task = 'T2' AND request_id IS NOT NULL GROUP BY ALL"
_KIND = "CASE WHEN votes = models THEN 'unanimous_yes' WHEN votes = 0 THEN 'unanimous_no' ELSE 'mixed' END"


@query("agg_ensemble_votes", f"SELECT votes, models, {_KIND} AS kind, count(*) AS n, list_sort(list(request_id)) AS requests FROM (SELECT request_id, coalesce(sum(yes), 0)::BIGINT AS votes, count(*) AS models FROM ({_YES}) GROUP BY request_id) GROUP BY ALL")
def agg_ensemble_votes(spark, d):
    """Requests by how many of the models that were asked said yes, with their ids."""
    from lectern.operators.answers import yes_no

    said = log(spark, d, "task", "request_id", "model_id", "raw_answer").filter("task = 'T2' and request_id is not null").groupBy("request_id", "model_id").agg(F.max(yes_no("raw_answer")).alias("yes"))
    votes = said.groupBy("request_id").agg(F.sum("yes").alias("votes"), F.count("*").alias("models"))
    kind = F.when(F.col("votes") == F.col("models"), "unanimous_yes").when(F.col("votes") == 0, "unanimous_no").otherwise("mixed")
    return votes.groupBy("votes", "models", kind.alias("kind")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("request_id")).alias("requests"))


@query("agg_largest_remainder", """WITH c AS (SELECT request_id, t1_label, 100.0 * n / sum(n) OVER (PARTITION BY request_id) AS p FROM (SELECT request_id, t1_label, count(*) AS n FROM {SEG} WHERE t1_label <> '' GROUP BY ALL)),
 f AS (SELECT *, floor(p) AS low, row_number() OVER (PARTITION BY request_id ORDER BY round(p - floor(p), 9) DESC, t1_label) AS r, 100 - sum(floor(p)) OVER (PARTITION BY request_id) AS spare FROM c)
 SELECT request_id, t1_label, (low + CASE WHEN r <= spare THEN 1 ELSE 0 END)::BIGINT AS pct FROM f""")
def agg_largest_remainder(spark, d):
    counts = seg(spark, d, "request_id", "t1_label").filter("t1_label <> ''").groupBy("request_id", "t1_label").agg(F.count("*").alias("n"))
    return st.whole_percentages(counts, "request_id", "t1_label", "n")


@query("agg_quick_stats", """SELECT lower(trim(contr_type)) AS kind, count(*) AS n, round(quantile_cont(word_count, 0.05), 6) AS p5, round(quantile_cont(word_count, 0.5), 6) AS p50, round(quantile_cont(word_count, 0.95), 6) AS p95,
 round(avg(len(explicit_hits)), 6) AS mean_hits, round(100.0 * avg(CASE WHEN len(explicit_hits) > 0 THEN 1 ELSE 0 END), 6) AS pct_hit FROM {FRG} GROUP BY 1""")
def agg_quick_stats(spark, d):
    p = lambda q: _r(F.percentile("word_count", F.lit(q)))
    n = F.size("explicit_hits")
    return frg(spark, d, "contr_type", "word_count", "explicit_hits").groupBy(F.lower(F.trim("contr_type")).alias("kind")).agg(F.count("*").alias("n"), p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"), _r(F.avg(n)).alias("mean_hits"), _r(100.0 * F.avg(F.when(n > 0, 1).otherwise(0))).alias("pct_hit"))


_KW = "|".join(sorted(lexicon.SOFT_MASK_KEYWORDS, key=lambda k: (-len(k), k)))


@query("agg_kw_overlap", f"""SELECT round(avg(CASE WHEN regexp_full_match(w, '{_KW}') THEN 1 ELSE 0 END), 6) AS share, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(regexp_extract_all(text, '{tx.duck(lexicon.T1_PATTERNS["METH"])}'), lambda x: lower(x)))) AS w FROM {{FRG}})""")
def agg_kw_overlap(spark, d):
    """The share of the keywords found in fragments that the soft mask knows."""
    from lectern.plans.scalars import keywords

    words = frg(spark, d, "text").select(F.explode(keywords("text")).alias("w"))
    return words.agg(_r(F.avg(F.col("w").rlike(f"^(?u)({_KW})$").cast("int"))).alias("share"), F.count("*").alias("n"))


@query("met_drift_flags", """WITH m AS (SELECT quantile_cont(word_count, 0.5) FILTER (lower(trim(split)) = 'train') AS a, quantile_cont(word_count, 0.5) FILTER (lower(trim(split)) = 'test') AS b,
 100.0 * avg(CASE WHEN score_implicit = 0 THEN 1 ELSE 0 END) AS zero FROM {FRG}) SELECT abs(b - a) / a * 100 > 30 AS length_gap, zero > 90 AS zero_scores, round(zero, 6) AS pct_zero FROM m""")
def met_drift_flags(spark, d):
    half = lambda s: F.percentile(F.when(F.lower(F.trim("split")) == s, F.col("word_count")), F.lit(0.5))
    m = frg(spark, d, "split", "word_count", "score_implicit").agg(half("train").alias("a"), half("test").alias("b"), (100.0 * F.avg(F.when(F.col("score_implicit") == 0, 1).otherwise(0))).alias("zero"))
    return m.select((F.abs(F.col("b") - F.col("a")) / F.col("a") * 100 > 30).alias("length_gap"), (F.col("zero") > 90).alias("zero_scores"), _r("zero").alias("pct_zero"))
