"""Ordered operators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from lectern.operators import segmentation as sg
from lectern.plans.registry import docs, frg, log, query, seg
from lectern.sources.tables import table


def _w(*keys, order):
    return Window.partitionBy(*keys).orderBy(*order)


@query("win_relative_pos", "SELECT seg_id, round((row_number() OVER (PARTITION BY request_id ORDER BY seg_index, seg_id) - 1) / greatest(count(*) OVER (PARTITION BY request_id) - 1, 1), 4) AS pos FROM {SEG}")
def win_relative_pos(spark, d):
    idx = F.row_number().over(_w("request_id", order=["seg_index", "seg_id"])) - 1
    n = F.count("*").over(Window.partitionBy("request_id"))
    return seg(spark, d, "request_id", "seg_index").select("seg_id", F.round(idx / F.greatest(n - 1, F.lit(1)), 4).alias("pos"))


@query("win_char_offset", r"""WITH RECURSIVE l AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents), r AS (
 SELECT doc_id, text, parts, 0 AS i, 0::BIGINT AS s, 0::BIGINT AS e FROM l UNION ALL
 SELECT doc_id, text, parts, i + 1, CASE WHEN p > 0 THEN e + p - 1 ELSE e END, CASE WHEN p > 0 THEN e + p - 1 ELSE e END + length(part) FROM (SELECT *, parts[i + 1] AS part, instr(substr(text, e + 1), parts[i + 1]) AS p FROM r WHERE i < len(parts)))
 SELECT doc_id, i - 1 AS idx, s AS char_start, e AS char_end FROM r WHERE i > 0""")
def win_char_offset(spark, d):
    parts = F.split("text", "\n", -1)
    return docs(spark, d).select("doc_id", F.posexplode(sg.char_offsets("text", parts)).alias("idx", "x")).select("doc_id", "idx", F.col("x.start").alias("char_start"), F.col("x.end").alias("char_end"))


@query("win_best_per_file", "SELECT doc_id, t1_label, seg_id, t1_confidence FROM {SEG} WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, t1_label ORDER BY t1_confidence DESC, seg_id) = 1")
def win_best_per_file(spark, d):
    best = F.max_by(F.struct("seg_id", "t1_confidence"), F.struct("t1_confidence", -F.col("seg_id"))).alias("b")
    return seg(spark, d, "doc_id", "t1_label", "t1_confidence").filter("doc_id is not null").groupBy("doc_id", "t1_label").agg(best).select("doc_id", "t1_label", "b.seg_id", "b.t1_confidence")


@query("win_cap_per_doc", """SELECT fragment_id, bucket FROM (SELECT fragment_id, CASE WHEN lower(trim(contr_type)) = 'none' THEN 'neg' WHEN lower(trim(contr_type)) IN ('explicit', 'implicit') THEN 'contr' ELSE 'free' END AS bucket, doc_id, char_start FROM {FRG})
 QUALIFY bucket = 'free' OR row_number() OVER (PARTITION BY doc_id, bucket ORDER BY char_start NULLS FIRST, fragment_id) <= CASE bucket WHEN 'neg' THEN 3 ELSE 5 END""")
def win_cap_per_doc(spark, d):
    kind = F.lower(F.trim("contr_type"))
    rows = frg(spark, d, "contr_type", "doc_id", "char_start").withColumn("bucket", F.when(kind == "none", "neg").when(kind.isin("explicit", "implicit"), "contr").otherwise("free"))
    r = F.row_number().over(_w("doc_id", "bucket", order=["char_start", "fragment_id"]))
    return rows.withColumn("r", r).filter((F.col("bucket") == "free") | (F.col("r") <= F.when(F.col("bucket") == "neg", 3).otherwise(5))).select("fragment_id", "bucket")


@query("win_topn_score", "SELECT fragment_id, round(score_explicit + 0.1 * (len(explicit_hits) + len(implicit_hits)), 6) AS score FROM {FRG} ORDER BY score DESC, fragment_id LIMIT 100")
def win_topn_score(spark, d):
    s = F.round(F.col("score_explicit") + 0.1 * (F.size("explicit_hits") + F.size("implicit_hits")), 6)
    return frg(spark, d, "score_explicit", "explicit_hits", "implicit_hits").select("fragment_id", s.alias("score")).orderBy(F.desc_nulls_last("score"), "fragment_id").limit(100)


@query("win_head_per_class", """WITH have AS (SELECT t1_label, count(*) AS n FROM {SEG} WHERE NOT low_confidence GROUP BY 1), r AS (SELECT seg_id, t1_label, row_number() OVER (PARTITION BY t1_label ORDER BY seg_id) AS k FROM {SEG} WHERE low_confidence)
 SELECT r.seg_id, r.t1_label FROM r LEFT JOIN have USING (t1_label) WHERE r.k <= 460 - coalesce(have.n, 0)""")
def win_head_per_class(spark, d):
    rows = seg(spark, d, "t1_label", "low_confidence")
    have = rows.filter("not low_confidence").groupBy("t1_label").agg(F.count("*").alias("n"))
    rest = rows.filter("low_confidence").withColumn("k", F.row_number().over(_w("t1_label", order=["seg_id"])))
    return rest.join(have, "t1_label", "left").filter(F.col("k") <= 460 - F.coalesce("n", F.lit(0))).select("seg_id", "t1_label")


@query("win_page", "SELECT seg_id, ceil((seg_index + 1) / 6.0)::INT AS page FROM {SEG}")
def win_page(spark, d):
    return seg(spark, d, "seg_index").select("seg_id", F.ceil((F.col("seg_index") + 1) / 6).cast("int").alias("page"))


_RL = "count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"


@query("win_rate_limit", f"SELECT event_id, {_RL} AS in_window, {_RL} > 3 AS over FROM events")
def win_rate_limit(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000_000, 0)
    return table(spark, d, "events", "event_id", "user_id", "ts").select("event_id", F.count("*").over(w).alias("in_window"), (F.count("*").over(w) > 3).alias("over"))


@query("win_rate_limit_exact")
def win_rate_limit_exact(spark, d):
    """Decisions of a sliding-window limiter that does not count what it rejects, with the seconds to wait."""
    from lectern.streaming.rate_limit import decide_batch

    rows = table(spark, d, "events", "event_id", "user_id", "ts").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return decide_batch(rows, limit=3, window=3600.0)


@query("win_cumulative_target", """WITH f AS (SELECT lower(trim(doc_id)) AS doc, count(*) FILTER (lower(trim(tarea2_role)) = 'positive') AS p, count(*) FILTER (lower(trim(tarea2_role)) = 'negative') AS n FROM {FRG} WHERE doc_id IS NOT NULL GROUP BY 1)
 SELECT doc FROM (SELECT doc, coalesce(sum(p) OVER w, 0) AS p, coalesce(sum(n) OVER w, 0) AS n FROM f WINDOW w AS (ORDER BY doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE NOT (p >= 100 AND n >= 200)""")
def win_cumulative_target(spark, d):
    role = F.lower(F.trim("tarea2_role"))
    from lectern.operators.sampling import until_reached

    rows = frg(spark, d, "doc_id", "tarea2_role").filter("doc_id is not null").select(F.lower(F.trim("doc_id")).alias("doc"), role.alias("role"))
    return until_reached(rows, "doc", {"positive": (F.col("role") == "positive", 100), "negative": (F.col("role") == "negative", 200)})


@query("win_greedy_split", """WITH f AS (SELECT lower(trim(doc_id)) AS doc, count(*) AS n FROM {FRG} WHERE doc_id IS NOT NULL GROUP BY 1), t AS (SELECT floor(0.8 * sum(n))::BIGINT AS target FROM f)
 SELECT doc, CASE WHEN coalesce(sum(n) OVER (ORDER BY md5(concat_ws('|', '42', doc)), doc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < target THEN 'train' ELSE 'val' END AS part FROM f, t""")
def win_greedy_split(spark, d):
    from lectern.operators.sampling import greedy_split

    docs = frg(spark, d, "doc_id").filter("doc_id is not null").groupBy(F.lower(F.trim("doc_id")).alias("doc")).agg(F.count("*").alias("n"))
    return greedy_split(docs, "doc", "n", 0.8, 42)


@query("win_latest_log", "SELECT model_id, task, log_id, elapsed_ms FROM {LOG} QUALIFY row_number() OVER (PARTITION BY model_id, task ORDER BY predicted_at DESC, log_id DESC) = 1")
def win_latest_log(spark, d):
    last = F.max_by(F.struct("log_id", "elapsed_ms"), F.struct("predicted_at", "log_id")).alias("x")
    return log(spark, d, "model_id", "task", "predicted_at", "elapsed_ms").groupBy("model_id", "task").agg(last).select("model_id", "task", "x.log_id", "x.elapsed_ms")
