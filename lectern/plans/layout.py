"""Layout operators over pages made of the words of documents: two columns where doc_id is even."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import layout as ly
from lectern.plans.registry import docs, query
from lectern.sources.tables import table

_W = "(SELECT unnest([595, 842, 612, 612, 500, 500]) AS w, unnest([842, 595, 1008, 792, 1100, 830]) AS h)"


@query("pdf_format", f"SELECT w, h, CASE WHEN abs(a - 595) <= 8 AND abs(b - 842) <= 8 THEN 'A4' WHEN abs(a - 612) <= 8 AND abs(b - 1008) <= 8 THEN 'Oficio' WHEN abs(a - 612) <= 8 AND abs(b - 936) <= 8 THEN 'Folio' WHEN abs(a - 612) <= 8 AND abs(b - 792) <= 8 THEN 'Carta' WHEN b > 1000 THEN 'Oficio' WHEN b > 870 THEN 'Folio' WHEN b > 820 THEN 'A4' ELSE 'Carta' END AS format FROM (SELECT w, h, least(w, h) AS a, greatest(w, h) AS b FROM {_W})")
def pdf_format(spark, d):
    rows = spark.createDataFrame([(595, 842), (842, 595), (612, 1008), (612, 792), (500, 1100), (500, 830)], "w int, h int")
    return rows.select("w", "h", ly.page_format("w", "h").alias("format"))


def _items(spark, d):
    """Three-word items: (doc_id, page, item, text, x, y, height, page_width, page_height, column)."""
    words = F.col("words")  # a column, not an expression: that would be worked out again for every item
    rows = docs(spark, d).select("doc_id", F.split(F.regexp_replace("text", r"\s+", " "), " ").alias("words")).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(words) - 1) / 3), F.lit(0))), lambda k: F.array_join(F.slice(words, (k * 3 + 1).cast("int"), 3), " "))).alias("k", "text"))
    two = F.pmod("doc_id", F.lit(2)) == 0
    line, column = F.pmod("k", F.lit(50)), F.when(two, F.pmod(F.floor(F.col("k") / 50), F.lit(2))).otherwise(0)
    page = F.when(two, F.floor(F.col("k") / 100)).otherwise(F.floor(F.col("k") / 50)).cast("int")
    return rows.select("doc_id", page.alias("page"), F.col("k").alias("item"), "text", (50.0 + column * 270).alias("x"), (780.0 - line * 14.0).alias("y"), F.lit(10.0).alias("height"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"), column.cast("int").alias("column"))


@query("pdf_columns")
def pdf_columns(spark, d):
    """Columns found on every page, and its text."""
    return ly.pages(_items(spark, d))


@query("pdf_kmeans1d")
def pdf_kmeans1d(spark, d):
    """Pages by the number of columns found."""
    return ly.page_columns(_items(spark, d)).groupBy("columns").agg(F.count("*").alias("pages"))


@query("pdf_paragraphs")
def pdf_paragraphs(spark, d):
    """Paragraphs of every page."""
    return ly.pages(_items(spark, d)).select("doc_id", "page", F.posexplode(F.split("text", "\n\n")).alias("idx", "paragraph"))


@query("pdf_reading_order", """WITH i AS (SELECT doc_id, k, CASE WHEN doc_id % 2 = 0 THEN k // 100 ELSE k // 50 END AS page, CASE WHEN doc_id % 2 = 0 THEN (k // 50) % 2 ELSE 0 END AS col, 780 - (k % 50) * 14 AS y FROM (SELECT doc_id, unnest(range(greatest((len(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) - 1) // 3, 0) + 1)) AS k FROM documents))
 SELECT doc_id, page::INT AS page, k AS item, row_number() OVER (PARTITION BY doc_id, page ORDER BY col, y DESC, k) AS place FROM i WHERE y > 0.07 * 842 AND y < 0.93 * 842""")
def pdf_reading_order(spark, d):
    return ly.in_reading_order(_items(spark, d)).select("doc_id", "page", "item", "place")
