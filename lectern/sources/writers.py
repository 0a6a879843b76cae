"""Writers: role-routed fragments, dataset splits, annotation sheets, prediction logs and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

NEGATIVES = 1500


def by_role(fragments: DataFrame, order: Sequence[str], most: int = NEGATIVES) -> DataFrame:
    """Each fragment once for every sink it belongs to (column ``sink``), pure negatives up to ``most`` in order.

    Sinks: t1, t2_positive, t2_hard_negative, t2_negative.  Kinds and roles are compared without case and blanks.
    """
    kind, role = F.lower(F.trim("contr_type")), F.lower(F.trim("tarea2_role"))
    sinks = F.filter(F.array(F.when(kind.isin("explicit", "implicit"), "t1"), F.when(role == "positive", "t2_positive"), F.when(role == "hard_negative", "t2_hard_negative"), F.when(role == "negative", "t2_negative")), lambda x: x.isNotNull())
    rows = fragments.withColumn("sink", F.explode(sinks))
    # only the capped sink is ranked, and only its first rows are sorted
    rest = rows.filter("sink <> 't2_negative'")
    return rest.unionByName(rows.filter("sink = 't2_negative'").orderBy(*order).limit(most))


def write_by_role(fragments: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines in a folder of each sink."""
    by_role(fragments, order).write.mode("append").partitionBy("sink").json(path)


def write_splits(rows: DataFrame, path: str, version: str) -> DataFrame:
    """JSON lines by version and split; returns the number of rows of each split and label."""
    rows.withColumn("version", F.lit(version)).write.mode("append").partitionBy("version", "split").json(path)
    return rows.groupBy("split", "a1_label").agg(F.count("*").alias("n"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with every field quoted, a header, and the first name preceded by a byte-order mark."""
    df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).write.mode("overwrite").option("encoding", "UTF-8").csv(path, header=True, quoteAll=True, escape='"')


def prediction_entries(df: DataFrame, text: str = "text") -> DataFrame:
    """Log entries: a hash of the first 65,536 characters and the length instead of the text."""
    return df.withColumn("input_hash", F.substring(F.sha1(F.substring(text, 1, 65536)), 1, 12)).withColumn("input_length", F.length(text)).drop(text)


def write_prediction_log(df: DataFrame, path: str, time: str) -> None:
    """Entries appended as JSON by the day of ``time``."""
    df.withColumn("dt", F.date_format(time, "yyyy-MM-dd")).write.mode("append").partitionBy("dt").json(path)


def html_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One HTML table row of the given columns each, special characters as entities; null as nothing."""
    return report_rows(df, columns).select("html")


def report_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(html, json) of each row: a table row as by ``html_rows``, and a JSON object."""
    from lectern.operators.answers import escape_html

    cells = [F.concat(F.lit("<td>"), F.coalesce(escape_html(F.col(c).cast("string")), F.lit("")), F.lit("</td>")) for c in columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"), F.to_json(F.struct(*columns)).alias("json"))
