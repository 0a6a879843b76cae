"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lectern.functions import lexicon, text as tx
from lectern.operators import segmentation as sg
from lectern.plans.registry import docs, frg, query, seg
from lectern.sources.tables import table

_SP = "[\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{3000}\\x{1680}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{0085}]"
_NS = _SP.replace("[", "[^", 1)


@query("proj_cols", "SELECT fragment_id AS id, text AS snippet, a1_label AS label, 'mined' AS origin FROM {FRG}")
def proj_cols(spark, d):
    return frg(spark, d, "text", "a1_label").withColumnsRenamed({"fragment_id": "id", "text": "snippet", "a1_label": "label"}).select("id", "snippet", "label", F.lit("mined").alias("origin"))


@query("proj_strip_internal", "SELECT seg_id, t1_label FROM {SEG}")
def proj_strip_internal(spark, d):
    return sg.strip_internal(seg(spark, d, "t1_label").withColumn("_score", F.lit(1)).withColumn("_debug", F.lit("x")))


@query("filt_wordrange", "SELECT fragment_id, word_count < 250 OR word_count > 1000 AS violates FROM {FRG} WHERE word_count BETWEEN 250 AND 500 OR word_count < 250 OR word_count > 1000")
def filt_wordrange(spark, d):
    w = F.col("word_count")
    out = (w < 250) | (w > 1000)
    return frg(spark, d, "word_count").filter(w.between(250, 500) | out).select("fragment_id", out.alias("violates"))


@query("filt_excl_label", "SELECT seg_id, t1_label FROM {SEG} WHERE t1_label <> 'CONTR' AND text IS NOT NULL AND t1_label IN ('INTRO','BACK','METH','RES','DISC','LIM','CONC')")
def filt_excl_label(spark, d):
    return seg(spark, d, "t1_label", "text").filter(F.col("t1_label") != "CONTR").dropna(subset=["text"]).filter(F.col("t1_label").isin("INTRO", "BACK", "METH", "RES", "DISC", "LIM", "CONC")).select("seg_id", "t1_label")


_ANCHORS = " + ".join(f"contains(lower(left(text, 2000)), '{a}')::INT" for a in lexicon.ACADEMIC_ANCHORS)


@query("filt_formal_doc", f"SELECT doc_id FROM documents WHERE {_ANCHORS} >= 2")
def filt_formal_doc(spark, d):
    return docs(spark, d).filter(sg.is_formal("text")).select("doc_id")


_BIB = " + ".join(f"contains(lower(text), '{a}')::INT" for a in lexicon.BIBLIOGRAPHY_MARKS)


@query("filt_clean_snippet", f"""WITH w AS (SELECT fragment_id, text, regexp_extract_all(text, '{_NS}+') AS ws, len(string_split(text, chr(10))) AS lines FROM {{FRG}})
 SELECT fragment_id FROM w WHERE len(ws) > 0 AND len(list_filter(ws, lambda x: regexp_matches(x, '[0-9]'))) / len(ws) <= 0.15 AND NOT (lines > 20 AND len(ws) / lines < 10) AND NOT ({_BIB} > 5)""")
def filt_clean_snippet(spark, d):
    return frg(spark, d, "text").filter(sg.is_clean("text")).select("fragment_id")


_FM = " + ".join("regexp_matches(head, '" + p.replace("'", "''") + "')::INT" for p in lexicon.FRONTMATTER_PATTERNS)


@query("filt_frontmatter", f"SELECT doc_id, score FROM (SELECT doc_id, {_FM} AS score FROM (SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, floor(length(text) * 0.3)::INT) ELSE text END AS head FROM documents)) WHERE score >= 2")
def filt_frontmatter(spark, d):
    return docs(spark, d).select("doc_id", sg.frontmatter_score("text").alias("score")).filter("score >= 2")


def noise_sql(rows: str, doc: str, order: str, keep: str) -> str:
    """The noise of (doc, order, text) rows, with the columns of keep."""
    return f"""(WITH w AS (SELECT {keep}, trim(coalesce(text, ''), ' ' || chr(10) || chr(9) || chr(13)) AS t FROM {rows}), f AS (SELECT *, regexp_matches(t, '{lexicon.BIBLIOGRAPHY_HEADING}') AS heading, regexp_matches(t, '{lexicon.NUMBERED_REFERENCE}') AS ref, len(regexp_extract_all(t, '\\S+')) AS n FROM w),
 s AS (SELECT *, coalesce(max((heading OR ref)::INT) OVER (PARTITION BY {doc} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM f)
 SELECT {keep}, CASE WHEN t = '' THEN 'short' WHEN inside = 1 THEN 'biblio' WHEN heading THEN 'header' WHEN ref THEN 'biblio' WHEN regexp_matches(t, '{lexicon.FRONT_LINE}') THEN 'frontmatter'
 WHEN n < 15 AND NOT regexp_matches(t, '[.!?…]\\s*$') THEN 'header' WHEN n < 15 THEN 'short' END AS noise FROM s)"""


_LINE_ROWS = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"
_NOISE = f"SELECT * FROM {noise_sql(_LINE_ROWS, 'doc_id', 'idx', 'doc_id, idx')}"


@query("filt_noise", _NOISE)
def filt_noise(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    return sg.noise_class(lines, "doc_id", ["idx"], "line").select("doc_id", "idx", "noise")


@query("win_sticky_biblio", f"SELECT doc_id, idx FROM ({_NOISE}) WHERE noise = 'biblio'")
def win_sticky_biblio(spark, d):
    return filt_noise(spark, d).filter("noise = 'biblio'").select("doc_id", "idx")


@query("filt_kpi", "SELECT seg_id FROM {SEG} WHERE t1_label = 'CONTR' OR (t1_label IN ('RES', 'DISC') AND t1_confidence > 0.42)")
def filt_kpi(spark, d):
    return seg(spark, d, "t1_label", "t1_confidence").filter((F.col("t1_label") == "CONTR") | (F.col("t1_label").isin("RES", "DISC") & (F.col("t1_confidence") > 0.42))).select("seg_id")


@query("filt_llm_cond", "SELECT log_id, CASE WHEN model_id LIKE 'heuristic%' THEN coalesce(confidence, 0) <= 0.42 ELSE coalesce(confidence, 0) < 0.35 END AS low FROM {LOG}")
def filt_llm_cond(spark, d):
    from lectern.plans.registry import log

    c = F.coalesce("confidence", F.lit(0.0))
    return log(spark, d, "model_id", "confidence").select("log_id", F.when(F.col("model_id").startswith("heuristic"), c <= 0.42).otherwise(c < 0.35).alias("low"))


@query("agg_frontmatter_by_class", f"SELECT a1_label, count(*) AS n, count(*) FILTER (score >= 2) AS n_front, round(100.0 * count(*) FILTER (score >= 2) / count(*), 6) AS pct FROM (SELECT a1_label, {_FM} AS score FROM (SELECT a1_label, CASE WHEN length(text) > 200 THEN left(text, floor(length(text) * 0.3)::INT) ELSE text END AS head FROM {{FRG}})) GROUP BY a1_label")
def agg_frontmatter_by_class(spark, d):
    n = F.count_if(F.col("score") >= 2)
    return frg(spark, d, "a1_label", "text").select("a1_label", sg.frontmatter_score("text").alias("score")).groupBy("a1_label").agg(F.count("*").alias("n"), n.alias("n_front"), F.round(100.0 * n / F.count("*"), 6).alias("pct"))
