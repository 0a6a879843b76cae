"""Pages of positioned text items: format, columns, reading order and paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Page sizes in points (width, height), in order of preference.
SIZES = (("A4", 595, 842), ("Oficio", 612, 1008), ("Folio", 612, 936), ("Carta", 612, 792))
#: Heights above which a page of no known size is taken for one.
FALLBACKS = ((1000, "Oficio"), (870, "Folio"), (820, "A4"))
#: What str.strip() takes away, for a class of characters.
_BLANKS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def page_format(width: Column | str, height: Column | str, tolerance: float = 8) -> Column:
    """The name of a page size, whichever way the page lies."""
    w, h = F.least(width, height), F.greatest(width, height)
    out = None
    for name, a, b in SIZES:
        fits = (F.abs(w - a) <= tolerance) & (F.abs(h - b) <= tolerance)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    for above, name in FALLBACKS:
        out = out.when(h > above, name)
    return out.otherwise("Carta")


def kmeans_1d(x: np.ndarray, k: int, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(labels from left to right, centres) of k groups, from evenly spread starting centres."""
    if not x.size:
        return np.zeros(0, int), np.zeros(0)
    centres = x.min() + (x.max() - x.min()) * np.arange(k) / max(k - 1, 1)
    labels = np.zeros(x.size, int)
    for _ in range(rounds):
        new = np.abs(x[:, None] - centres).argmin(1)
        moved = np.array([x[new == j].mean() if (new == j).any() else centres[j] for j in range(k)])
        order = np.argsort(moved, kind="stable")
        new, centres = np.argsort(order, kind="stable")[new], moved[order]
        if (new == labels).all():
            break
        labels = new
    return labels, centres


def column_count(x: np.ndarray, page_width: float, most: int = 3) -> int:
    """Columns by the elbow: the largest number that lowers the spread by 30 % with columns 15 % of the page apart."""
    if x.size < 4:
        return 1
    fits = [kmeans_1d(x, k) for k in range(1, most + 1)]
    spread = np.array([np.square(x - centres[labels]).sum() for labels, centres in fits])
    apart = np.array([np.diff(centres).min() for _, centres in fits[1:]])
    fall = -np.diff(spread) / np.maximum(spread[:-1], 1.0)
    good = np.flatnonzero((np.minimum(apart, page_width) > 0.15 * page_width) & (fall > 0.30))
    return int(good[-1]) + 2 if good.size else 1


def join_items(texts: list[str], ys: np.ndarray, heights: np.ndarray) -> str:
    """Items from top to bottom as text: large gaps part paragraphs, lines are joined, end-of-line hyphens too.

    What stands between two neighbours follows from the gap between them: all gaps are told apart at once.
    """
    t = pd.Series(texts, dtype="object")
    line = float(heights[heights > 2].mean()) if (heights > 2).any() else 10.0
    down = -np.diff(ys)
    before, after = t[:-1].reset_index(drop=True), t[1:].reset_index(drop=True)
    part, lower = down > max(4.0, 1.8 * line), down > 0.4 * line
    broken = ~part & lower & before.str.rstrip().str.endswith("-").to_numpy(bool)
    tight = before.str.endswith(" ").to_numpy(bool) | ~(lower | (after != "").to_numpy(bool))
    between = np.select([part, broken, tight], ["\n\n", "", ""], " ")
    heads = np.where(broken, before.str.rstrip().str[:-1], before)
    return ("".join((pd.Series(heads, dtype="object") + pd.Series(between, dtype="object")).tolist()) + t.iloc[-1]).strip() if len(t) else ""


def page_text(items: pd.DataFrame, margin: float = 0.07) -> tuple[int, str]:
    """(columns, text) of one page: (text, x, y, height, page_width, page_height), y upwards."""
    width, tall = float(items["page_width"].iloc[0]), float(items["page_height"].iloc[0])
    body = items[(items["y"] > margin * tall) & (items["y"] < (1 - margin) * tall) & (items["text"].fillna("").str.strip() != "")]
    if body.empty:
        return 1, " ".join(items["text"].fillna(""))
    long = body[body["text"].str.strip().str.len() > 3]
    k = column_count(long["x"].to_numpy(float), width) if len(body) >= 4 else 1
    labels = kmeans_1d(body["x"].to_numpy(float), k)[0] if k > 1 else np.zeros(len(body), int)
    parts = []
    for j in range(k):
        column = body[labels == j].sort_values("y", ascending=False, kind="stable")
        parts.append(join_items(column["text"].tolist(), column["y"].to_numpy(float), column["height"].fillna(10).to_numpy(float)))
    return k, "\n\n".join(p for p in parts if p.strip())


def pages(items: DataFrame) -> DataFrame:
    """(doc_id, page, columns, text) of items (doc_id, page, text, x, y, height, page_width, page_height).

    A page is the unit of work; its items fit one task by nature.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k, text = page_text(pdf.sort_values("item"))
        return pd.DataFrame({"doc_id": [pdf["doc_id"].iloc[0]], "page": [pdf["page"].iloc[0]], "columns": [k], "text": [text]})

    return items.groupBy("doc_id", "page").applyInPandas(run, "doc_id long, page int, columns int, text string")


def page_columns(items: DataFrame, margin: float = 0.07) -> DataFrame:
    """(doc_id, page, columns): the columns that ``pages`` finds, without the texts.  All items of a page name the same page size.

    Items are counted by their left edge before they travel, so a page is a few rows; pages of the same edges
    and counts in a batch are looked at once.
    """
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), f"^[{_BLANKS}]+|[{_BLANKS}]+$", "")
    body = F.coalesce((F.col("y") > margin * F.col("page_height")) & (F.col("y") < (1 - margin) * F.col("page_height")) & (bare != ""), F.lit(False))
    rows = items.select("doc_id", "page", "page_width", body.alias("body"), F.when(body & (F.length(bare) > 3), F.coalesce(F.col("x").cast("double"), F.lit(float("nan")))).alias("edge"))
    edges = rows.groupBy("doc_id", "page", "edge").agg(F.count_if("body").alias("n"), F.max("page_width").cast("double").alias("page_width"))
    edge = F.when(F.col("edge").isNotNull(), F.struct("edge", "n"))
    each = edges.groupBy("doc_id", "page").agg(F.sum("n").alias("body"), F.max("page_width").alias("page_width"), F.sort_array(F.collect_list(edge)).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, int] = {}
            out = []
            edges = batch.column(4)
            flat, ends = edges.flatten(), np.cumsum([0, *edges.value_lengths().to_pylist()])
            xs, counts = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for i, (n, width) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                x, c = xs[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]]
                if n < 4 or x.size < 2:  # all at one edge
                    out.append(1)
                    continue
                key = (width, x.tobytes(), c.tobytes())
                if key not in known:
                    known[key] = column_count(np.repeat(x, c), width)
                out.append(known[key])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], names=["doc_id", "page", "columns"])

    return each.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "body", "page_width", "edges").mapInArrow(run, "doc_id long, page int, columns int")


def in_reading_order(items: DataFrame, margin: float = 0.07) -> DataFrame:
    """Items without headers and footers, with ``place``: their place on the page, columns from the left, then downwards."""
    from pyspark.sql import Window

    body = items.filter((F.col("y") > margin * F.col("page_height")) & (F.col("y") < (1 - margin) * F.col("page_height")))
    return body.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("column", F.desc("y"), "item")))
