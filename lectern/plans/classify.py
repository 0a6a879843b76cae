"""Classification of paragraphs and fragments."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lectern.functions import lexicon, text as tx
from lectern.operators import cleaning, inference, mining, rhetoric as rh, segmentation as sg
from lectern.plans.registry import docs, frg, log, query, seg
from lectern.sources.tables import table

_POS = "(row_number() OVER (PARTITION BY request_id ORDER BY seg_index, seg_id) - 1) / greatest(count(*) OVER (PARTITION BY request_id) - 1, 1)"
_CNT = {k: f"len(regexp_extract_all(text, '{tx.duck(p)}'))" for k, p in lexicon.T1_PATTERNS.items()}
_BONUS = {"INTRO": " + CASE WHEN p <= 0.15 THEN 3 ELSE 0 END", "BACK": " + CASE WHEN p <= 0.15 THEN 2 ELSE 0 END", "CONC": " + CASE WHEN p > 0.15 AND p >= 0.8 THEN 3 ELSE 0 END", "LIM": " + CASE WHEN p > 0.15 AND p >= 0.8 THEN 2 ELSE 0 END"}
_ARR = "[" + ", ".join(f"{{'s': {_CNT[k]}{_BONUS.get(k, '')}, 'r': {-i}, 'l': '{k}'}}" for i, k in enumerate(lexicon.T1_PRIORITY)) + "]"
_T1 = f"""(SELECT seg_id, CASE WHEN b.s = 0 THEN ['INTRO','BACK','METH','RES','DISC','CONC'][least(floor(p * 6), 5)::INT + 1] ELSE b.l END AS label, CASE WHEN b.s = 0 THEN 0.42 ELSE round(least(0.95, 0.45 + b.s / greatest(total, 1) * 0.5), 3) END AS confidence, b.s = 0 AS low
 FROM (SELECT seg_id, p, list_sort(a, 'DESC')[1] AS b, list_sum(list_transform(a, lambda x: x.s)) AS total FROM (SELECT seg_id, p, {_ARR} AS a FROM (SELECT seg_id, text, {_POS} AS p FROM {{SEG}}))))"""


def _placed(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("request_id")
    rows = seg(spark, d, "request_id", "seg_index", "text")
    return rows.select("seg_id", "text", rh.relative_position(F.row_number().over(w.orderBy("seg_index", "seg_id")) - 1, F.count("*").over(w)).alias("p"))


@query("cls_t1_heur", f"SELECT seg_id, label, round(confidence, 2) AS confidence, low FROM {_T1}")
def cls_t1_heur(spark, d):
    return _placed(spark, d).select("seg_id", rh.section("text", "p").alias("x")).select("seg_id", "x.label", F.round("x.confidence", 2).alias("confidence"), "x.low")


@query("cls_t1_zone", f"SELECT seg_id, CASE WHEN p <= 0.2 THEN 'Inicio (0-20%)' WHEN p >= 0.8 THEN 'Cierre (80-100%)' ELSE 'Desarrollo (20-80%)' END AS zone FROM (SELECT seg_id, {_POS} AS p FROM {{SEG}})")
def cls_t1_zone(spark, d):
    return _placed(spark, d).select("seg_id", rh.zone("p").alias("zone"))


_N = f"len(regexp_extract_all(text, '{tx.duck(lexicon.T2_PATTERN)}'))"


@query("cls_t2_heur", f"SELECT fragment_id, n > 0 AS is_contribution, round(CASE WHEN n >= 3 THEN least(0.95, 0.70 + 0.04 * n) WHEN n = 2 THEN 0.80 WHEN n = 1 THEN 0.65 ELSE greatest(0.48, 0.85 - len(regexp_extract_all(text, '\\S+')) * 0.0009) END, 6) AS confidence FROM (SELECT fragment_id, text, {_N} AS n FROM {{FRG}})")
def cls_t2_heur(spark, d):
    return frg(spark, d, "text").select("fragment_id", rh.contribution("text").alias("x")).select("fragment_id", "x.is_contribution", F.round("x.confidence", 6).alias("confidence"))


_DUCKSEC = {k: f"len(regexp_extract_all(text, '{tx.duck(p)}'))" for k, p in lexicon.SECTION_PATTERNS.items()}


def _sec(cond, least):
    arr = "[" + ", ".join(f"{{'n': {_DUCKSEC[k]}, 'r': {-i}, 'l': '{k}', 'm': {0 if least else lexicon.SECTION_THRESHOLDS[k]}}}" for i, k in enumerate(rh.SECTION_ORDER)) + "]"
    return f"SELECT fragment_id, CASE WHEN b.n >= {least} THEN b.l END AS label, CASE WHEN b.n >= {least} THEN b.n END AS score FROM (SELECT fragment_id, list_sort(list_filter({arr}, lambda x: x.n >= x.m), 'DESC')[1] AS b FROM {{FRG}})"


@query("cls_regex_threshold", _sec("", 0))
def cls_regex_threshold(spark, d):
    return frg(spark, d, "text").select("fragment_id", rh.threshold_section("text").alias("x")).select("fragment_id", "x.label", F.col("x.count").alias("score"))


@query("cls_regex_threshold_v0", _sec("", 2))
def cls_regex_threshold_v0(spark, d):
    return frg(spark, d, "text").select("fragment_id", rh.threshold_section("text", best_first=True).alias("x")).select("fragment_id", "x.label", F.col("x.count").alias("score"))


@query("prep_t1")
def prep_t1(spark, d):
    """Section by threshold, its keywords, and the text with them masked."""
    rows = frg(spark, d, "text").withColumn("s", rh.threshold_section("text"))
    by = F.coalesce(*[F.when(F.col("s.label") == k, F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(tx.jvm(p)), F.lit(0)), F.lower))) for k, p in lexicon.SECTION_PATTERNS.items()], F.array().cast("array<string>"))
    rows = rows.withColumn("keywords", by)
    return rows.select("fragment_id", F.col("s.label").alias("regex_category"), F.coalesce("s.count", F.lit(0)).alias("regex_score"), "keywords", F.size("keywords").alias("n_keywords_masked"), cleaning.mask("text", F.col("keywords")).alias("neutralized_snippet"), (F.size("keywords") > 0).alias("was_masked"))


_RE2 = [(p, k) for p, k in lexicon.EXPLICIT_PATTERNS]
_EXP = "[" + ", ".join(f"regexp_matches(lower(text), '{tx.duck(p, '')}')" for p, _ in _RE2) + "]"


@query("cls_contr_explicit", f"SELECT fragment_id, n, round(least(1.0, n * 0.35 + CASE WHEN n > 0 THEN 0.2 ELSE 0 END), 3) AS score FROM (SELECT fragment_id, len(list_filter({_EXP}, lambda x: x)) AS n FROM {{FRG}})")
def cls_contr_explicit(spark, d):
    n = F.size(rh.hits("text", lexicon.EXPLICIT_PATTERNS))
    return frg(spark, d, "text").select("fragment_id", n.alias("n")).select("fragment_id", "n", F.round(F.least(F.lit(1.0), F.col("n") * 0.35 + F.when(F.col("n") > 0, 0.2).otherwise(0.0)), 3).alias("score"))


@query("cls_contr_score")
def cls_contr_score(spark, d):
    """All signs, both scores, kind, section and role of every fragment."""
    rows = frg(spark, d, "text", "relative_pos", "section_hint").select("fragment_id", rh.contribution_scores("text", F.coalesce("relative_pos", F.lit(0.5)), "section_hint").alias("x"))
    return rows.select("fragment_id", "x.*")


_BLOCKED = frozenset({"B11-primera-vez", "B19-hallazgos", "I02-logro-pasiva"})  # the last looks ahead, which RE2 can't
_EDGE = r"[^\p{L}\p{N}\p{M}_]"


def _whole(p):
    """RE2's word edges are those of ASCII words: edges as the characters beside a word."""
    p = re.sub(r"\\b(?=[a-zñ(\[])", lambda _: f"(?:^|{_EDGE})", tx.duck(p, ""))
    return p.replace(r"\b", f"(?:$|{_EDGE})")


_SIGNS = {n: "[" + ", ".join(f"regexp_matches(lower(text), '{_whole(p)}')" for p, k in ps if k not in _BLOCKED) + "]" for n, ps in (("e", lexicon.EXPLICIT_PATTERNS), ("i", lexicon.IMPLICIT_PATTERNS))}
_PRIOR = "|".join(lexicon.HIGH_PRIOR_SECTIONS)
_SCORES = f"""(SELECT fragment_id, round(least(1.0, n * 0.35 + CASE WHEN n > 0 THEN 0.2 ELSE 0 END), 3) AS e, round(least(1.0, m * 0.25 + CASE WHEN p <= 0.15 OR p >= 0.85 THEN 0.2 ELSE 0 END + CASE WHEN h THEN 0.15 ELSE 0 END), 3) AS i
 FROM (SELECT fragment_id, coalesce(relative_pos, 0.5) AS p, coalesce(regexp_matches(lower(section_hint), '{_PRIOR}'), false) AS h, len(list_filter({_SIGNS["e"]}, lambda x: x)) AS n, len(list_filter({_SIGNS["i"]}, lambda x: x)) AS m FROM {{FRG}}))"""


@query("cls_contr_blocked", f"SELECT fragment_id, e::DOUBLE AS score_explicit, i::DOUBLE AS score_implicit, CASE WHEN e >= 0.35 THEN 'explicit' WHEN i >= 0.45 THEN 'implicit' WHEN i >= 0.30 THEN 'implicit_weak' ELSE 'none' END AS contr_type, CASE WHEN e >= 0.35 THEN 'positive' WHEN i >= 0.30 THEN 'hard_negative' ELSE 'negative' END AS tarea2_role FROM {_SCORES}")
def cls_contr_blocked(spark, d):
    """The same, with noisy signs left out."""
    rows = frg(spark, d, "text", "relative_pos", "section_hint").select("fragment_id", rh.contribution_scores("text", F.coalesce("relative_pos", F.lit(0.5)), "section_hint", _BLOCKED).alias("x"))
    return rows.select("fragment_id", "x.score_explicit", "x.score_implicit", "x.contr_type", "x.tarea2_role")


@query("cls_mine_corpus")
def cls_mine_corpus(spark, d):
    """The whole pipeline: documents cleaned, cut into fragments, scored and capped by document."""
    from pyspark.sql import Window

    cut = mining.sliding_fragments(docs(spark, d), "doc_id", "text")
    rows = cut.withColumn("x", rh.contribution_scores("text", "relative_pos", "section_hint")).select("doc_id", "idx", "text", "word_count", "char_start", "char_end", "relative_pos", "section_hint", "x.*")
    bucket = F.when(F.col("contr_type") == "none", "none").when(F.col("contr_type").isin("explicit", "implicit"), "contr").otherwise("weak")
    rows = rows.withColumn("bucket", bucket).withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "bucket").orderBy("idx")))
    return rows.filter((F.col("bucket") == "weak") | (F.col("r") <= F.when(F.col("bucket") == "none", 3).otherwise(5))).drop("bucket", "r")


@query("cls_autolabel")
def cls_autolabel(spark, d):
    """Formal documents without labels so far cut into snippets of 250 to 350 words, clean ones labelled by threshold, the best of each document and section.

    Documents are taken in order until every section has 1,800 snippets; those after that are left out.
    """
    labelled = table(spark, d, "subject_labels", "doc_id").distinct()
    rows = docs(spark, d).join(labelled, "doc_id", "left_anti").filter(sg.is_formal("text"))
    return mining.labelled_snippets(rows, "doc_id", "text", 1800)


@query("cls_encoder")
def cls_encoder(spark, d):
    """A batch classifier behind the model interface; without weights, the rules answer."""
    return inference.classify(seg(spark, d, "text"), "seg_id", "text", inference.RuleModel)


@query("cls_t2_threshold", "SELECT log_id, coalesce(confidence, 0) >= 0.5 AS is_contribution, round(CASE WHEN coalesce(confidence, 0) >= 0.5 THEN confidence ELSE 1 - coalesce(confidence, 0) END, 6) AS conf FROM {LOG} WHERE task = 'T2'")
def cls_t2_threshold(spark, d):
    c = F.coalesce("confidence", F.lit(0.0))
    return log(spark, d, "task", "confidence").filter("task = 'T2'").select("log_id", (c >= inference.threshold()).alias("is_contribution"), F.round(F.when(c >= inference.threshold(), c).otherwise(1 - c), 6).alias("conf"))


_ASKED = "[" + ", ".join(f"{{'n': {_CNT[k]}, 'r': {-i}, 'l': '{k}'}}" for i, k in enumerate(k for k in lexicon.T1_PATTERNS if k != "CONTR")) + "]"


@query("cls_llm_t1", f"SELECT seg_id, CASE WHEN b.n > 0 THEN b.l ELSE 'no sé' END AS raw_answer, CASE WHEN b.n > 0 THEN b.l ELSE 'UNKNOWN' END AS label, CASE WHEN b.n > 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS confidence FROM (SELECT seg_id, list_sort({_ASKED}, 'DESC')[1] AS b FROM {{SEG}})")
def cls_llm_t1(spark, d):
    """Sections by a language model behind the client interface; here a client that answers by rule."""
    return inference.ask(seg(spark, d, "text"), "seg_id", "text", inference.EchoClient, "section")


@query("cls_llm_t2", f"SELECT fragment_id, CASE WHEN h THEN 'SI' ELSE 'NO' END AS raw_answer, CASE WHEN h THEN 'ES_CONTRIBUCION' ELSE 'NO_ES_CONTRIBUCION' END AS label, 1.0::DOUBLE AS confidence FROM (SELECT fragment_id, regexp_matches(left(text, 4000), '{tx.duck(lexicon.T2_PATTERN)}') AS h FROM {{FRG}})")
def cls_llm_t2(spark, d):
    """Yes or no by a language model behind the client interface, at most 4,000 characters of a text asked."""
    return inference.ask(frg(spark, d, "text"), "fragment_id", "text", inference.EchoClient, "yes_no")


@query("cls_llm_async", "SELECT 1 AS calls_per_row, count(*) AS rows FROM {SEG}")
def cls_llm_async(spark, d):
    """Every segment asked with eight prompts of a task under way at once and up to five tries; here a client that answers by rule."""
    out = inference.ask(seg(spark, d, "text"), "seg_id", "text", inference.EchoClient, "section", examples=False, retries=5, wait=2.0, at_once=8)
    return out.filter("label <> 'ERROR'").agg(F.lit(1).alias("calls_per_row"), F.count("*").alias("rows"))


@query("cls_llm_cost", "SELECT model_id, count(*) AS calls, round(sum(length(raw_answer)), 6) AS chars, round(count(*) * 500 * 0.150 / 1e6 + sum(length(raw_answer)) * 0.25 * 0.600 / 1e6, 9) AS cost_usd FROM {LOG} WHERE model_id LIKE 'llm%' GROUP BY model_id")
def cls_llm_cost(spark, d):
    rows = log(spark, d, "model_id", "raw_answer").filter("model_id like 'llm%'")
    chars = F.sum(F.length("raw_answer"))
    return rows.groupBy("model_id").agg(F.count("*").alias("calls"), F.round(chars.cast("double"), 6).alias("chars"), F.round(F.count("*") * 500 * 0.150 / 1e6 + chars * 0.25 * 0.600 / 1e6, 9).alias("cost_usd"))


CATALOG = (inference.Entry("heuristic", "Reglas", "heuristic"), inference.Entry("encoder", "Encoder", "encoder", weights="/no/weights"), inference.Entry("llm", "LLM", "llm_api", key="NO_SUCH_KEY"))


@query("pred_catalog", "SELECT * FROM (VALUES ('heuristic', true, 'heuristic', 'Reglas'), ('encoder', false, 'heuristic', 'Encoder [fallback heuristico]'), ('llm', false, 'heuristic', 'LLM [fallback heuristico]')) t(model_id, available, mode, name)")
def pred_catalog(spark, d):
    """What each model of a catalog resolves to where neither weights nor keys are there."""
    rows = [(e.model_id, e.available, *inference.resolve(e.model_id, CATALOG)[1:]) for e in CATALOG]
    return spark.createDataFrame(rows, "model_id string, available boolean, mode string, name string")


@query("cls_fallback", f"SELECT seg_id, label, 'heuristic' AS used_mode, 'LLM [fallback heuristico]' AS used_name FROM {_T1}")
def cls_fallback(spark, d):
    """A model that isn't there: the rules answer, and the name says so."""
    rules = lambda df: df.select("seg_id", rh.section("text", "p")["label"].alias("label"))
    ask = lambda df: inference.ask(df, "seg_id", "text", inference.EchoClient, "section")
    return inference.with_fallback(_placed(spark, d), "llm", CATALOG, ask, rules).select("seg_id", "label", "used_mode", "used_name")


_TS = tx.duck(lexicon.T2_PATTERN)


@query("cls_sentence_highlight", f"SELECT fragment_id, CASE WHEN len(h) > 0 THEN len(h) ELSE 0 END AS n, CASE WHEN len(h) > 0 THEN md5(array_to_string(h, '|')) ELSE md5(text) END AS marked FROM (SELECT fragment_id, text, list_filter(regexp_extract_all(text, '[^.!?]+[.!?]*'), lambda s: regexp_matches(s, '{_TS}')) AS h FROM {{FRG}})")
def cls_sentence_highlight(spark, d):
    found = F.filter(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0)), lambda s: s.rlike(tx.jvm(lexicon.T2_PATTERN)))
    return frg(spark, d, "text").select("fragment_id", "text", found.alias("h")).select("fragment_id", F.size("h").alias("n"), F.when(F.size("h") > 0, F.md5(F.array_join("h", "|"))).otherwise(F.md5("text")).alias("marked"))


_ARRAY = "[" + ", ".join(f"'{x}'" for x in lexicon.T1_PATTERNS) + "]"


@query("dim_lexicon", f"SELECT label, i AS place FROM (SELECT unnest({_ARRAY}) AS label, unnest(range({len(lexicon.T1_PATTERNS)})) AS i)")
def dim_lexicon(spark, d):
    return spark.createDataFrame([(k, i) for i, k in enumerate(lexicon.T1_PATTERNS)], "label string, place int")


@query("sql_functions", "SELECT doc_id, text IS NOT NULL AS same, round((81 * 200 + 89 * 200 - (96 * 96 + 104 * 104)) / (200.0 * 200 - (96 * 96 + 104 * 104)), 4) AS kappa FROM documents")
def sql_functions(spark, d):
    """The functions registered for SQL: paragraphs as the Column expression has them, and kappa of a known table."""
    from lectern.functions.registered import register

    register(spark)
    rows = docs(spark, d).withColumn("p", sg.paragraphs("text"))
    return rows.select("doc_id", (F.expr("split_paragraphs(text)") == F.col("p")).alias("same"), F.expr("round(kappa(81L, 89L, 15L, 15L), 4)").alias("kappa"))


@query("sql_sliding_fragments")
def sql_sliding_fragments(spark, d):
    """The table function in SQL, over the sentences of every document."""
    from lectern.functions.registered import register

    register(spark)
    rows = docs(spark, d).select("doc_id", cleaning.sentences("text").alias("sentences"))
    return spark.sql("SELECT doc_id, f.* FROM {docs}, LATERAL sliding_fragments(sentences, 250, 1000, 2) f", docs=rows)
