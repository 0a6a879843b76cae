"""Sources and sinks: what is written is read back and must be the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.plans.registry import frg, log, query, seg
from lectern.runtime import shared_dir
from lectern.sources import readers, writers
from lectern.sources.tables import table


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _files(spark, d, name):
    """The documents as text files, a folder of each source; many small files, written by many tasks."""
    at = _folder(spark, name)
    rows = table(spark, d, "documents", "doc_id", "text")
    rows.select(F.concat(F.lit("d"), F.pmod("doc_id", F.lit(16))).alias("part"), F.to_json(F.struct("doc_id", "text")).alias("value")).write.partitionBy("part").text(at)
    return at


@query("src_txt_dir", "SELECT doc_id, length(text) AS chars FROM documents")
def src_txt_dir(spark, d):
    """Text files of a folder, read whole: here a record a line each."""
    at = _files(spark, d, "txt-dir")
    lines = readers.text_documents(spark, f"{at}/part=*").select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.from_json("line", "doc_id long, text string").alias("x")).select("x.doc_id", F.length("x.text").alias("chars"))


@query("src_recursive", "SELECT doc_id, length(text) AS chars FROM documents")
def src_recursive(spark, d):
    lines = readers.text_documents(spark, _files(spark, d, "recursive"), recursive=True).select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.from_json("line", "doc_id long, text string").alias("x")).select("x.doc_id", F.length("x.text").alias("chars"))


@query("src_decode", "SELECT doc_id, substr(md5(left(text, 2048)), 1, 12) AS h FROM documents WHERE length(text) >= 300")
def src_decode(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return rows.select("doc_id", readers.decoded("content").alias("text")).filter(F.length("text") >= 300).select("doc_id", F.substring(F.md5(F.substring("text", 1, 2048)), 1, 12).alias("h"))


@query("src_jsonl", "SELECT fragment_id, a1_label, len(explicit_hits) AS hits FROM {FRG}")
def src_jsonl(spark, d):
    at = _folder(spark, "jsonl")
    frg(spark, d, "a1_label", "explicit_hits").write.json(at)
    rows = readers.json_lines(spark, at, "fragment_id long, a1_label string, explicit_hits array<struct<label:string,hit_text:string>>")
    return rows.select("fragment_id", "a1_label", F.coalesce(F.size("explicit_hits"), F.lit(0)).alias("hits"))


@query("src_csv", "SELECT item_id::VARCHAR AS item_id, md5(text) AS h, label FROM gold_items")
def src_csv(spark, d):
    at = _folder(spark, "csv")
    writers.write_csv(table(spark, d, "gold_items", "item_id", "text", "label"), at)
    return readers.csv_strings(spark, at).select("item_id", F.md5("text").alias("h"), "label")


def _docx(text):
    """The bytes of a Word document with a paragraph a line."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    body = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in text.split("\n"))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return buffer.getvalue()


def _xlsx(rows):
    """The bytes of a workbook with the given rows of texts."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    cell = lambda k, i, v: f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
    lines = "".join(f'<row r="{i}">' + "".join(cell(k, i, v) for k, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{lines}</sheetData></worksheet>')
    return buffer.getvalue()


def _made(spark, d, ending, make):
    """(path, content) of files made of the held-out items, one an item."""
    build = F.udf(lambda i, t, s: make(i, t, s), "binary")
    rows = table(spark, d, "gold_items", "item_id", "text", "label")
    return rows.select(F.concat("item_id", F.lit(ending)).alias("path"), build("item_id", "text", "label").alias("content"))


@query("src_docx", r"SELECT item_id || '.docx' AS path, md5(trim(text, ' ' || chr(10) || chr(9) || chr(13))) AS h, 0 AS error_code FROM gold_items")
def src_docx(spark, d):
    """Word documents: their text, a line a paragraph."""
    return readers.office_documents(_made(spark, d, ".docx", lambda i, t, s: _docx(t))).select("path", F.md5("text").alias("h"), "error_code")


@query("src_xlsx", "SELECT item_id || '.xlsx' AS path, item_id::VARCHAR AS id, label, md5(text) AS h FROM gold_items")
def src_xlsx(spark, d):
    """Workbooks: the rows of their first sheets."""
    files = _made(spark, d, ".xlsx", lambda i, t, s: _xlsx([["id", "label", "text"], [i, s or "", t]]))
    return readers.xlsx_sheets(files, ["id", "label", "text"]).select("path", "id", "label", F.md5("text").alias("h"))


@query("src_doc", "SELECT item_id || '.doc' AS path, [400, 400, 400, 413][item_id % 4 + 1] AS error_code FROM gold_items")
def src_doc(spark, d):
    """Files that are no legacy Word files: empty, plain text, a newer Word document under the old ending, and too large."""
    def content(i, t, s):
        return (b"", t.encode(), _docx(t), readers.OLE_MAGIC + bytes(readers.MOST_BYTES))[i % 4]

    return readers.office_documents(_made(spark, d, ".doc", content)).select("path", "error_code")


@query("snk_jsonl_roles", """WITH r AS (SELECT fragment_id, lower(trim(contr_type)) AS k, lower(trim(tarea2_role)) AS r FROM {FRG}), s AS (SELECT 't1' AS sink, fragment_id FROM r WHERE k IN ('explicit', 'implicit') UNION ALL SELECT 't2_positive', fragment_id FROM r WHERE r = 'positive'
 UNION ALL SELECT 't2_hard_negative', fragment_id FROM r WHERE r = 'hard_negative' UNION ALL (SELECT 't2_negative', fragment_id FROM r WHERE r = 'negative' ORDER BY fragment_id LIMIT 1500)) SELECT * FROM s""")
def snk_jsonl_roles(spark, d):
    """Fragments written to a folder of JSON lines for each role, and read back."""
    at = _folder(spark, "roles")
    writers.write_by_role(frg(spark, d, "contr_type", "tarea2_role"), at, ["fragment_id"])
    return spark.read.schema("fragment_id long, sink string").json(at).select("sink", "fragment_id")


@query("snk_csv", "SELECT fragment_id::VARCHAR AS fragment_id, md5(text) AS h FROM {FRG} WHERE text <> ''")
def snk_csv(spark, d):
    """Fragments, line breaks and quotes in them, written as CSV and read back."""
    at = _folder(spark, "csv-sink")
    writers.write_csv(frg(spark, d, "text").filter("text <> ''"), at)
    return readers.csv_strings(spark, at).select("fragment_id", F.md5("text").alias("h"))


@query("export_rhetorical", "SELECT seg_index + 1 AS number, t1_label, t1_label_name, t1_confidence, CASE WHEN t1_confidence <= 0.42 THEN 'SI' ELSE 'NO' END AS confianza_baja, CASE WHEN t1_label = 'CONTR' THEN 'ES_CONTRIBUCION' ELSE 'NO_ES_CONTRIBUCION' END AS t2, rhetorical_zone, relative_pos, ceil((seg_index + 1) / 6.0)::INT AS pagina, word_count, md5(text) AS texto, seg_id FROM {SEG}")
def export_rhetorical(spark, d):
    rows = seg(spark, d, "seg_index", "t1_label", "t1_label_name", "t1_confidence", "rhetorical_zone", "relative_pos", "word_count", "text")
    yes = lambda c, a, b: F.when(c, a).otherwise(b)
    return rows.select((F.col("seg_index") + 1).alias("number"), "t1_label", "t1_label_name", "t1_confidence", yes(F.col("t1_confidence") <= 0.42, "SI", "NO").alias("confianza_baja"), yes(F.col("t1_label") == "CONTR", "ES_CONTRIBUCION", "NO_ES_CONTRIBUCION").alias("t2"), "rhetorical_zone", "relative_pos", F.ceil((F.col("seg_index") + 1) / 6).cast("int").alias("pagina"), "word_count", F.md5("text").alias("texto"), "seg_id")


@query("export_contrib", "SELECT row_number() OVER (PARTITION BY request_id ORDER BY seg_index, seg_id) AS number, t1_label_name || ' (' || round_even(t1_confidence * 100, 0)::INT || '%)' AS contexto, rhetorical_zone, relative_pos, word_count, char_start, char_end, md5(text) AS fragmento, seg_id FROM {SEG} WHERE t1_label = 'CONTR'")
def export_contrib(spark, d):
    from pyspark.sql import Window

    from lectern.operators.answers import percent

    rows = seg(spark, d, "request_id", "seg_index", "t1_label", "t1_label_name", "t1_confidence", "rhetorical_zone", "relative_pos", "word_count", "char_start", "char_end", "text").filter("t1_label = 'CONTR'")
    n = F.row_number().over(Window.partitionBy("request_id").orderBy("seg_index", "seg_id"))
    return rows.select(n.alias("number"), F.concat("t1_label_name", F.lit(" ("), percent(F.col("t1_confidence")), F.lit("%)")).alias("contexto"), "rhetorical_zone", "relative_pos", "word_count", "char_start", "char_end", F.md5("text").alias("fragmento"), "seg_id")


@query("snk_json_html_pdf", """SELECT md5('<tr><td>' || seg_id || '</td><td>' || replace(replace(replace(t1_label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td></tr>') AS html, seg_id, t1_label, length(text) AS chars FROM {SEG}""")
def snk_json_html_pdf(spark, d):
    """Each row as a row of an HTML report, and as JSON that is read again."""
    rows = writers.report_rows(seg(spark, d, "t1_label", "text"), ["seg_id", "t1_label", "text"])
    back = F.from_json("json", "seg_id long, t1_label string, text string")
    return rows.select(F.md5("html").alias("html"), back.alias("x")).select("html", "x.seg_id", "x.t1_label", F.length("x.text").alias("chars"))


@query("snk_splits", "SELECT lower(trim(split)) AS split, a1_label, count(*) AS n FROM {FRG} WHERE split IS NOT NULL GROUP BY ALL")
def snk_splits(spark, d):
    rows = frg(spark, d, "split", "a1_label", "text").filter("split is not null").withColumn("split", F.lower(F.trim("split")))
    return writers.write_splits(rows, _folder(spark, "splits"), "despues")


@query("snk_predlog", "SELECT strftime(predicted_at, '%Y-%m-%d') AS dt, substr(sha1(raw_answer), 1, 12) AS input_hash, length(raw_answer) AS input_length, count(*) AS n FROM {LOG} GROUP BY ALL")
def snk_predlog(spark, d):
    """Log entries with a hash and the length of a text instead of it, appended by day."""
    at = _folder(spark, "predlog")
    writers.write_prediction_log(writers.prediction_entries(log(spark, d, "predicted_at", "raw_answer"), "raw_answer"), at, "predicted_at")
    rows = spark.read.schema("log_id long, input_hash string, input_length int, dt string").json(at)
    return rows.groupBy("dt", "input_hash", "input_length").agg(F.count("*").alias("n"))


@query("snk_checkpoint", "SELECT doc_id, length(text) AS chars, 1 AS times FROM documents")
def snk_checkpoint(spark, d):
    """A run in batches that is taken up from its checkpoint: a first batch, then the rest behind its last document."""
    out, state = _folder(spark, "batches"), _folder(spark, "checkpoint")
    docs = table(spark, d, "documents", "doc_id", "text")
    spark.createDataFrame([], "last long").write.parquet(state)
    for most in (300, 2_147_483_647):
        batch = readers.batch_after(docs, "doc_id", spark.read.schema("last long").parquet(state), most)
        path = f"{out}/upto={most}"
        batch.select("doc_id", F.length("text").alias("chars")).write.parquet(path)
        spark.read.parquet(path).agg(F.max("doc_id").alias("last")).write.mode("append").parquet(state)
    return spark.read.parquet(out).groupBy("doc_id", "chars").agg(F.count("*").cast("int").alias("times"))


@query("snk_partial", "SELECT fragment_id, len(regexp_extract_all(text, '[^\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}]+')) AS words FROM {FRG}")
def snk_partial(spark, d):
    """Results kept as Parquet under the hash of their input: the second run computes only what the first has not."""
    from lectern.functions import text as tx
    from lectern.runtime import materialize

    rows = frg(spark, d, "text").withColumn("key", F.sha2("text", 256))
    result = lambda df: df.dropDuplicates(["key"]).select("key", tx.word_count("text").alias("words"))
    cache = materialize(result(rows.filter("fragment_id % 2 = 0")), "inference-cache")
    fresh = result(rows.join(cache, "key", "left_anti"))
    return rows.select("fragment_id", "key").join(cache.unionByName(fresh), "key").select("fragment_id", "words")
