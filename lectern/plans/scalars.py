"""Scalar functions over text, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import lexicon, text as tx
from lectern.operators import answers, cleaning, segmentation as sg
from lectern.plans.projections import _NS, _SP
from lectern.plans.registry import docs, frg, log, query, seg
from lectern.sources.tables import table


@query("txt_word_count", f"SELECT seg_id, len(regexp_extract_all(text, '{_NS}+')) AS n FROM {{SEG}}")
def txt_word_count(spark, d):
    return seg(spark, d, "text").select("seg_id", tx.word_count("text").alias("n"))


@query("txt_word_count_re", "SELECT seg_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}\\p{M}_]+')) AS n FROM {SEG}")
def txt_word_count_re(spark, d):
    return seg(spark, d, "text").select("seg_id", F.regexp_count("text", F.lit(r"[\p{L}\p{N}\p{M}_]+")).alias("n"))


@query("txt_ws_collapse", f"SELECT seg_id, trim(regexp_replace(text, '{_SP}+', ' ', 'g')) AS t FROM {{SEG}}")
def txt_ws_collapse(spark, d):
    return seg(spark, d, "text").select("seg_id", tx.squeeze("text").alias("t"))


_TRIM = "trim({x}, ' ' || chr(10) || chr(9) || chr(13))"
_BLOCKS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n{{2,}}'), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '')"
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_TRIM.format(x='x')}), lambda x: x <> '')"
_SENTS = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_WC = f"len(regexp_extract_all(x, '{_NS}+'))"


def _grouped(parts, header):
    """Parts gathered to 25 words; a header is a group of its own."""
    item = f"{{'cur': [x], 'wc': {_WC}, 'out': []::VARCHAR[], 'h': {header}}}"
    closed = "CASE WHEN len({a}.cur) > 0 THEN list_append({a}.out, array_to_string({a}.cur, ' ')) ELSE {a}.out END"
    cur, wc, out = "CASE WHEN x.h THEN x.cur ELSE list_concat(a.cur, x.cur) END", "CASE WHEN x.h THEN x.wc ELSE a.wc + x.wc END", f"CASE WHEN x.h THEN {closed.format(a='a')} ELSE a.out END"
    step = f"CASE WHEN x.h OR {wc} >= 25 THEN {{'cur': []::VARCHAR[], 'wc': 0, 'out': list_append({out}, array_to_string({cur}, ' ')), 'h': false}} ELSE {{'cur': {cur}, 'wc': {wc}, 'out': {out}, 'h': false}} END"
    return f"(SELECT {closed.format(a='g')} FROM (SELECT list_reduce(list_transform({parts}, lambda x: {item}), lambda a, x: {step}, {{'cur': []::VARCHAR[], 'wc': 0, 'out': []::VARCHAR[], 'h': false}}) AS g))"


@query("txt_split_para", f"""WITH m AS (SELECT doc_id, CASE WHEN len({_BLOCKS}) > 1 THEN {_BLOCKS} WHEN len({_LINES}) > 3 THEN {_grouped(_LINES, f"{_WC} <= 5 AND regexp_matches(x, '^[A-ZAEIOUÜN]')")} ELSE list_filter({_grouped(_SENTS, "false")}, lambda x: trim(x) <> '') END AS p, text FROM documents),
 q AS (SELECT doc_id, CASE WHEN len(p) > 0 THEN p ELSE [text] END AS p FROM m) SELECT doc_id, generate_subscripts(p, 1) - 1 AS idx, unnest(p) AS paragraph FROM q""")
def txt_split_para(spark, d):
    """Paragraphs of every document, whichever way it is laid out."""
    return docs(spark, d).select("doc_id", F.posexplode(sg.paragraphs("text")).alias("idx", "paragraph"))


@query("txt_split_para_js")
def txt_split_para_js(spark, d):
    """The variant that peels headings off and knows accented capitals."""
    return docs(spark, d).select("doc_id", F.posexplode(sg.paragraphs("text", "A-ZÁÉÍÓÚÜÑ", True)).alias("idx", "paragraph"))


@query("txt_split_sent")
def txt_split_sent(spark, d):
    """Sentences, with the usual abbreviations protected."""
    return docs(spark, d).select("doc_id", F.posexplode(cleaning.sentences("text")).alias("idx", "sentence"))


@query("txt_sent_alt")
def txt_sent_alt(spark, d):
    """Sentences by a segmenter of choice; without an installed library, by rules."""
    return cleaning.sentences_by(docs(spark, d), "doc_id", "text", cleaning.installed_segmenter())


@query("txt_split_sent_simple", "SELECT seg_id, generate_subscripts(p, 1) - 1 AS idx, unnest(p) AS s FROM (SELECT seg_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS p FROM {SEG})")
def txt_split_sent_simple(spark, d):
    return seg(spark, d, "text").select("seg_id", F.posexplode(F.regexp_extract_all("text", F.lit("[^.!?]+[.!?]*"), F.lit(0))).alias("idx", "s"))


@query("txt_segment_window")
def txt_segment_window(spark, d):
    """Snippets of 250 to 350 words from lines of five words or more."""
    return docs(spark, d).select("doc_id", F.posexplode(sg.word_windows("text", 250, 350)).alias("idx", "snippet")).withColumn("n", tx.word_count("snippet"))


@query("txt_segment_window_v0")
def txt_segment_window_v0(spark, d):
    """The earlier variant: 250 to 750 words, only empty lines are left out."""
    return docs(spark, d).select("doc_id", F.posexplode(sg.word_windows("text", 250, 750, 1)).alias("idx", "snippet")).withColumn("n", tx.word_count("snippet"))


@query("txt_sliding_frag")
def txt_sliding_frag(spark, d):
    """Overlapping windows of whole sentences, 250 to 1,000 words, with offsets and the heading before them."""
    from lectern.operators import mining

    return mining.sliding_fragments(docs(spark, d), "doc_id", "text")


@query("txt_normalize_pdf", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '-[\r\n]+([a-záéíóúüñ])', '\1', 'g'), '([.!?;:,])([A-ZÁÉÍÓÚÜÑ\d¿¡])', '\1 \2', 'g'), '$^', ''), '–', ' '), '—', ' '), '[ \t\r\f\v]{2,}', ' ', 'g'), '$^', '')) AS h FROM documents""")
def txt_normalize_pdf(spark, d):
    return docs(spark, d).select("doc_id", F.md5(cleaning.normalize_pdf("text")).alias("h"))


@query("txt_dehyphen", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '([\p{L}\p{N}_]+)-[\s]+([\p{L}\p{N}_]+)', '\1\2', 'g'), '\s+', ' ', 'g'))) AS h FROM documents")
def txt_dehyphen(spark, d):
    return docs(spark, d).select("doc_id", F.md5(cleaning.dehyphen("text")).alias("h"))


_V, _PH, _DH, _CAP = (tx.duck(x, "").replace("(?:a|á)", "[aá]") for x in (lexicon.CONTENT_VERBS, lexicon.PAGE_HEADER, lexicon.DOCUMENT_HEADER, lexicon.CAPTION))
_KEEP = rf"""l = '' OR NOT (regexp_matches(l, '{_PH}') OR regexp_matches(l, '{_DH}') OR (length(l) < 120 AND (regexp_matches(l, '\d{{1,4}}\s*$') OR regexp_matches(l, '\.{{3,}}')) AND NOT regexp_matches(l, '{_V}'))
 OR regexp_matches(l, '{_CAP}') OR (length(l) <= 80 AND length(regexp_replace(l, '[^\p{{Lu}}]', '', 'g')) >= 0.75 * length(regexp_replace(l, '[^\p{{L}}]', '', 'g')) AND length(regexp_replace(l, '[^\p{{L}}]', '', 'g')) > 0 AND NOT regexp_matches(l, '{_V}')))"""


@query("txt_toc_filter", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13)) AS l FROM documents) WHERE {_KEEP} GROUP BY doc_id")
def txt_toc_filter(spark, d):
    lines = F.split(cleaning.without_toc("text"), "\n", -1)
    return docs(spark, d).select("doc_id", F.size(lines).alias("n"))


def _noise_sql(text):
    # RE2 knows no look-ahead: the year keeps the bracket behind it
    for p in lexicon.NOISE_PATTERNS:
        p, new = (p.replace(r"(?=\s*\))", r"(\s*\))"), r" \1") if "(?=" in p else (p, " ")
        text = f"regexp_replace({text}, '{tx.duck(p, '')}', '{new}', 'g')"
    return f"trim({text}, ' ' || chr(10) || chr(9) || chr(13))"


@query("txt_noise_sub", f"SELECT doc_id, md5({_noise_sql('text')}) AS clean FROM documents")
def txt_noise_sub(spark, d):
    """Documents without references, links, captions and page numbers."""
    return docs(spark, d).select("doc_id", F.md5(cleaning.without_noise("text")).alias("clean"))


@query("txt_clean", None)
def txt_clean(spark, d):
    """All cleaning steps in order."""
    return docs(spark, d).select("doc_id", cleaning.clean("text").alias("clean"))


@query("txt_section_hint", """SELECT doc_id, coalesce(left(list_filter(list_transform(string_split(substr(text, greatest(c - 500, 0) + 1, least(c, 500)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 3 AND length(x) < 70 AND right(x, 1) <> '.' AND left(x, 1) <> '[')[-1], 60), 'unknown') AS hint FROM (SELECT doc_id, text, length(text) // 2 AS c FROM documents)""")
def txt_section_hint(spark, d):
    return docs(spark, d).select("doc_id", cleaning.section_hint("text", F.floor(F.length("text") / 2).cast("int")).alias("hint"))


_RC = ", ".join(f"len(regexp_extract_all(text, '{tx.duck(p)}')) AS {k.lower()}" for k, p in lexicon.T1_PATTERNS.items())


@query("txt_regex_count", f"SELECT fragment_id, {_RC} FROM {{FRG}}")
def txt_regex_count(spark, d):
    return frg(spark, d, "text").select("fragment_id", *[tx.matches("text", p).alias(k.lower()) for k, p in lexicon.T1_PATTERNS.items()])


@query("txt_kw_extract", f"SELECT fragment_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '{tx.duck(lexicon.T1_PATTERNS['METH'])}'), lambda x: lower(x)))) AS keywords FROM {{FRG}}")
def txt_kw_extract(spark, d):
    found = F.regexp_extract_all("text", F.lit(tx.jvm(lexicon.T1_PATTERNS["METH"])), F.lit(0))
    return frg(spark, d, "text").select("fragment_id", F.array_sort(F.array_distinct(F.transform(found, F.lower))).alias("keywords"))


def keywords(text):
    """The methodological words of a text, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(tx.jvm(lexicon.T1_PATTERNS["METH"])), F.lit(0)), F.lower))


_METH = f"list_distinct(list_transform(regexp_extract_all(text, '{tx.duck(lexicon.T1_PATTERNS['METH'])}'), lambda x: lower(x)))"
_LONGEST = f"list_transform(list_sort(list_transform({_METH}, lambda k: {{'n': -length(k), 'k': k}})), lambda x: x.k)"


@query("txt_mask_dynamic", rf"SELECT fragment_id, trim(regexp_replace(list_reduce({_LONGEST}, lambda t, k: regexp_replace(t, '(?i)\b' || regexp_escape(k) || '\b', '[MASK]', 'g'), text), '{_SP}+', ' ', 'g')) AS masked FROM {{FRG}}")
def txt_mask_dynamic(spark, d):
    """Fragments whose own methodological words are masked, the longest first."""
    return frg(spark, d, "text").select("fragment_id", cleaning.mask("text", keywords("text")).alias("masked"))


_SOFT = "|".join(sorted(lexicon.SOFT_MASK_KEYWORDS, key=lambda k: (-len(k), k)))


@query("txt_mask_soft", rf"SELECT fragment_id, md5(trim(regexp_replace(regexp_replace(text, '(?i)\b({_SOFT})\b', '[MASK]', 'g'), '\s+', ' ', 'g'))) AS h FROM {{FRG}}")
def txt_mask_soft(spark, d):
    return frg(spark, d, "text").select("fragment_id", F.md5(cleaning.soft_mask("text")).alias("h"))


@query("txt_mask_csv_kw")
def txt_mask_csv_kw(spark, d):
    """Keywords from a comma-separated column; where it is null, the text stays as it is."""
    rows = frg(spark, d, "text", "section_hint")
    return rows.select("fragment_id", cleaning.mask_listed("text", F.lower("section_hint")).alias("masked"))


@query("txt_mask_count", rf"SELECT fragment_id, len(regexp_extract_all(text, '(?i)\b({_SOFT})\b')) AS masks FROM {{FRG}}")
def txt_mask_count(spark, d):
    return frg(spark, d, "text").select("fragment_id", cleaning.mask_count(cleaning.soft_mask("text")).alias("masks"))


@query("txt_truncate_anchor")
def txt_truncate_anchor(spark, d):
    """Texts above 400 words cut to a window around the first of their own keywords that stands in them."""
    rows = frg(spark, d, "text").withColumn("keywords", keywords("text"))
    return rows.select("fragment_id", cleaning.truncate_around("text", F.col("fragment_id"), F.col("keywords")).alias("window"))


@query("prep_refactor")
def prep_refactor(spark, d):
    """Front matter dropped, window cut, masked again; test rows are only masked."""
    rows = frg(spark, d, "text", "split").withColumn("test", F.lower(F.trim("split")) == "test")
    kept = rows.filter(F.coalesce("test", F.lit(False)) | (sg.frontmatter_score("text") < 2))
    cut = F.when(F.coalesce("test", F.lit(False)), F.col("text")).otherwise(cleaning.truncate_around("text", F.col("fragment_id"), keywords("text")))
    out = kept.select("fragment_id", cleaning.soft_mask(cut).alias("text"))
    return out.select("fragment_id", "text", tx.word_count("text").alias("n"), cleaning.mask_count("text").alias("masks"))


_NEUTRAL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lexicon.NEUTRALIZATIONS.items()) + "}"


@query("txt_neutralize", f"SELECT fragment_id, list_reduce(list_transform(explicit_hits, lambda h: {{'h': h.hit_text, 'n': coalesce(({_NEUTRAL})[h.label], '')}}), lambda t, x: {{'h': regexp_replace(t.h, '(?i)' || regexp_escape(x.h), x.n), 'n': ''}}, {{'h': text, 'n': ''}}).h AS neutral FROM {{FRG}} WHERE len(explicit_hits) > 0")
def txt_neutralize(spark, d):
    """Signs of a contribution replaced by neutral wording, the first place of each."""
    rows = frg(spark, d, "text", "explicit_hits").filter("size(explicit_hits) > 0")
    return rows.select("fragment_id", cleaning.neutralize("text", "explicit_hits").alias("neutral"))


_PH20 = "[" + ", ".join("'" + p + "'" for p in lexicon.INJECTION_PHRASES) + "]"


@query("txt_inject", f"SELECT fragment_id, md5({_PH20}[fragment_id % 20 + 1] || ' ' || text) AS h FROM {{FRG}} WHERE a1_label = 'NO_ES_CONTRIBUCION'")
def txt_inject(spark, d):
    return frg(spark, d, "text", "a1_label").filter("a1_label = 'NO_ES_CONTRIBUCION'").select("fragment_id", F.md5(cleaning.inject("text", F.col("fragment_id") % 20)).alias("h"))


_T1 = "('INTRO','BACK','METH','RES','DISC','LIM','CONC')"


@query("txt_prefix_ctx", f"SELECT seg_id, '[SECCION:' || CASE WHEN upper(trim(t1_label)) IN {_T1} THEN upper(trim(t1_label)) ELSE 'UNK' END || '] [POS:' || printf('%.1f', least(0.9, greatest(0, round_even(least(1, greatest(0, coalesce(relative_pos, 0.5))) * 10, 0) / 10))) || '] ' || left(text, 40) AS t FROM {{SEG}}")
def txt_prefix_ctx(spark, d):
    return seg(spark, d, "t1_label", "relative_pos", "text").select("seg_id", answers.context_prefix("t1_label", "relative_pos", F.left("text", F.lit(40))).alias("t"))


@query("txt_rhet_context", "SELECT seg_id, 'Contribucion detectada en seccion ''' || t1_label_name || ''' (' || round_even(t1_confidence * 100, 0)::INT || '% conf. retorica) | ' || rhetorical_zone AS msg FROM {SEG} WHERE t1_label = 'CONTR'")
def txt_rhet_context(spark, d):
    rows = seg(spark, d, "t1_label", "t1_label_name", "t1_confidence", "rhetorical_zone").filter("t1_label = 'CONTR'")
    return rows.select("seg_id", answers.context_message("heuristic", F.col("t1_label_name"), F.col("t1_confidence"), F.col("rhetorical_zone")).alias("msg"))


_PCT = "round_even(t1_confidence * 100, 0)::INT"
_IN = f"''' || t1_label_name || ''' (' || {_PCT} || '% conf. {{r}})"


@query("txt_rhet_context_all", f"SELECT seg_id, 'Contribucion detectada en seccion {_IN.format(r='retorica')} | ' || rhetorical_zone AS heuristic, 'Contribucion detectada (conf. 65%) en seccion {_IN.format(r='retorica')} | ' || rhetorical_zone AS encoder, 'Contribución detectada en sección {_IN.format(r='retórica')} · ' || rhetorical_zone AS llm, 'Contribución en ''' || t1_label_name || ''' (' || {_PCT} || '%) | ' || rhetorical_zone AS local FROM {{SEG}} WHERE t1_label = 'CONTR'")
def txt_rhet_context_all(spark, d):
    """The messages of all four kinds of model."""
    rows = seg(spark, d, "t1_label", "t1_label_name", "t1_confidence", "rhetorical_zone").filter("t1_label = 'CONTR'")
    return rows.select("seg_id", *[answers.context_message(k, F.col("t1_label_name"), F.col("t1_confidence"), F.col("rhetorical_zone"), F.lit(0.65)).alias(k) for k in answers.MESSAGES])


@query("txt_parse_yesno", "SELECT log_id, CASE WHEN regexp_matches(lower(trim(raw_answer)), '^(si|sí|yes)') THEN 1 ELSE 0 END AS yes FROM {LOG} WHERE task = 'T2'")
def txt_parse_yesno(spark, d):
    return log(spark, d, "task", "raw_answer").filter("task = 'T2'").select("log_id", answers.yes_no("raw_answer").alias("yes"))


_NEEDLES = sorted(lexicon.ANSWER_LABELS, key=lambda k: (-len(k), list(lexicon.ANSWER_LABELS).index(k)))
_BY = " ".join(f"WHEN regexp_matches(a, '(^|[^\\p{{L}}\\p{{N}}_]){n}($|[^\\p{{L}}\\p{{N}}_])') THEN '{lexicon.ANSWER_LABELS[n] if lexicon.ANSWER_LABELS[n] != 'CONTR' else 'UNKNOWN'}'" for n in _NEEDLES)


@query("txt_parse_label", f"SELECT log_id, CASE WHEN a IS NULL OR a = '' THEN 'UNKNOWN' {_BY} ELSE 'UNKNOWN' END AS label FROM (SELECT log_id, upper(trim(raw_answer)) AS a FROM {{LOG}} WHERE task = 'T1')")
def txt_parse_label(spark, d):
    return log(spark, d, "task", "raw_answer").filter("task = 'T1'").select("log_id", answers.section_label("raw_answer").alias("label"))


_V0 = " ".join(f"WHEN contains(a, '{k}') THEN '{k}'" for k in lexicon.T1_PATTERNS)


@query("txt_parse_label_v0", f"SELECT log_id, CASE {_V0} END AS label FROM (SELECT log_id, upper(raw_answer) AS a FROM {{LOG}} WHERE task = 'T1')")
def txt_parse_label_v0(spark, d):
    return log(spark, d, "task", "raw_answer").filter("task = 'T1'").select("log_id", answers.first_label("raw_answer", list(lexicon.T1_PATTERNS)).alias("label"))


@query("txt_tokens_topn", "SELECT word, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zñáéíóúü]{4,}')) AS word FROM documents) GROUP BY word) ORDER BY n DESC, word LIMIT 25")
def txt_tokens_topn(spark, d):
    found = table(spark, d, "documents", "text").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zñáéíóúü]{4,}"), F.lit(0))).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


@query("txt_hash", "SELECT doc_id, substr(md5(left(text, 2048)), 1, 12) AS m, substr(sha1(left(text, 65536)), 1, 12) AS s1, sha256(text) AS s2 FROM documents")
def txt_hash(spark, d):
    return docs(spark, d).select("doc_id", F.substring(F.md5(F.substring("text", 1, 2048)), 1, 12).alias("m"), F.substring(F.sha1(F.substring("text", 1, 65536)), 1, 12).alias("s1"), F.sha2("text", 256).alias("s2"))


def _prompt_sql(task):
    from lectern.functions import prompts

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    before = "".join(f"<{role}>{content}" for role, content in prompts.opening(task, True))
    head, tail = prompts.QUESTION[task]
    return f"{quoted(before + '<user>' + head)} || text || {quoted(tail)}"


@query("txt_few_shot_prompt", f"SELECT item_id, md5(CASE item_set WHEN 'gold_t1' THEN {_prompt_sql('section')} ELSE {_prompt_sql('yes_no')} END) AS h, CASE item_set WHEN 'gold_t1' THEN 2 ELSE 18 END AS turns FROM gold_items")
def txt_few_shot_prompt(spark, d):
    """The prompt of every held-out item: instruction, examples, and the whole text without its label."""
    rows = table(spark, d, "gold_items", "item_id", "item_set", "text")
    rows = rows.select("item_id", F.when(F.col("item_set") == "gold_t1", answers.prompt("text", "section")).otherwise(answers.prompt("text", "yes_no")).alias("p"))
    return rows.select("item_id", F.md5(F.array_join(F.transform("p", lambda t: F.concat(F.lit("<"), t["role"], F.lit(">"), t["content"])), "")).alias("h"), F.size("p").alias("turns"))


@query("txt_html_escape", "SELECT seg_id, md5(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS h FROM {SEG}")
def txt_html_escape(spark, d):
    return seg(spark, d, "text").select("seg_id", F.md5(answers.escape_html("text")).alias("h"))


@query("num_clip", "SELECT fragment_id, least(1, greatest(0, score_implicit * 1.5)) AS v FROM {FRG}")
def num_clip(spark, d):
    return frg(spark, d, "score_implicit").select("fragment_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score_implicit") * 1.5)).alias("v"))


@query("num_round", "SELECT seg_id, round_even(t1_confidence * 100, 0)::BIGINT AS pct FROM {SEG}")
def num_round(spark, d):
    return seg(spark, d, "t1_confidence").select("seg_id", tx.half_even(F.col("t1_confidence") * 100).cast("long").alias("pct"))


@query("num_frag_stats", "SELECT fragment_id, length(text) AS chars, len(explicit_hits) AS n_exp, len(implicit_hits) AS n_imp, coalesce(explicit_hits[1].label, 'none') AS top_pattern, round(score_explicit + score_implicit, 6) AS total FROM {FRG}")
def num_frag_stats(spark, d):
    return frg(spark, d, "text", "explicit_hits", "implicit_hits", "score_explicit", "score_implicit").select("fragment_id", F.length("text").alias("chars"), F.size("explicit_hits").alias("n_exp"), F.size("implicit_hits").alias("n_imp"), F.coalesce(F.get("explicit_hits", F.lit(0))["label"], F.lit("none")).alias("top_pattern"), F.round(F.col("score_explicit") + F.col("score_implicit"), 6).alias("total"))


@query("arr_key_phrases", "SELECT fragment_id, left(array_to_string(list_transform(explicit_hits, lambda x: x.hit_text), '; '), 200) AS phrases FROM {FRG} WHERE len(explicit_hits) > 0")
def arr_key_phrases(spark, d):
    return frg(spark, d, "explicit_hits").filter("size(explicit_hits) > 0").select("fragment_id", F.left(F.array_join("explicit_hits.hit_text", "; "), F.lit(200)).alias("phrases"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, date_trunc('day', ts)::VARCHAR[1:10] AS day FROM events".replace("date_trunc('day', ts)::VARCHAR[1:10]", "strftime(ts, '%Y-%m-%d')"))
def json_props(spark, d):
    return table(spark, d, "events", "event_id", "props", "ts").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
