"""Deterministic samples and splits: the order is that of an MD5 over seed and key, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def draw_order(seed: int, key: str) -> list[Column]:
    """Columns to sort by for a random order that depends on seed and key alone."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key))), F.col(key)]


def uniform(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, or all; a top-n per task, merged, so nothing is sorted as a whole."""
    return df.orderBy(*draw_order(seed, key)).limit(n)


def per_class(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """Up to n rows of each class."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*draw_order(seed, key)))).filter(F.col("_r") <= n).drop("_r")


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, each stratum by its share (at least 1, halves to even), topped up from the rest, then cut to n."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("_g"))
    total = df.agg(F.count("*").alias("_t"))
    k = F.greatest(F.lit(1), F.rint(n * F.col("_g") / F.col("_t"))).cast("int")
    r = F.row_number().over(Window.partitionBy(stratum).orderBy(*draw_order(seed, key)))
    rows = df.withColumn("_r", r).join(sizes, stratum).join(F.broadcast(total)).withColumn("_late", (F.col("_r") > k).cast("int"))
    return rows.orderBy("_late", *draw_order(seed, key)).limit(n).drop("_g", "_t", "_r", "_late")


def running(df: DataFrame, key: str, seed: int, size: Column | None = None) -> DataFrame:
    """df with ``_through``: rows, or the sum of size, up to each row in random order.

    The order is cut into 4,096 ranges of the hash; sums of the ranges before come from a table of so many rows,
    and only within a range are rows sorted, so that no task sees all of them.
    """
    h, k = draw_order(seed, key)
    rows = df.withColumns({"_h": h, "_size": F.lit(1) if size is None else size}).withColumn("_range", F.substring("_h", 1, 3))
    sums = rows.groupBy("_range").agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum("_size").over(Window.partitionBy("_range").orderBy("_h", k).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = rows.withColumn("_in", inside).join(F.broadcast(sums.select("_range", before.alias("_before"))), "_range")
    return placed.withColumn("_through", F.col("_before") + F.col("_in")).select(*df.columns, "_through")


def fraction(df: DataFrame, key: str, part: float, seed: int) -> DataFrame:
    """df with ``chosen``: true for the whole part of part * rows, at random."""
    total = df.agg(F.floor(F.count("*") * F.lit(part)).alias("_k"))
    return running(df, key, seed).join(F.broadcast(total)).select(*df.columns, (F.col("_through") <= F.col("_k")).alias("chosen"))


def numbered(df: DataFrame, key: str, pattern: str, seed: int) -> DataFrame:
    """df with ``number``: its place in random order, in the given format."""
    return running(df, key, seed).select(*df.columns, F.format_string(pattern, "_through").alias("number"))


def split_keys(keys: DataFrame, key: str, part: float, seed: int, names: tuple[str, str]) -> DataFrame:
    """(key, split): the rounded-up part of the distinct keys goes to the second name."""
    keys = keys.select(key).distinct()
    total = keys.agg(F.ceil(F.count("*") * F.lit(part)).alias("_k"))
    return running(keys, key, seed).join(F.broadcast(total)).select(key, F.when(F.col("_through") <= F.col("_k"), names[1]).otherwise(names[0]).alias("split"))


def greedy_split(docs: DataFrame, doc: str, size: str, share: float, seed: int) -> DataFrame:
    """(doc, part): documents in random order go to train while those before hold less than share of all."""
    total = docs.agg(F.floor(share * F.sum(size)).cast("long").alias("_t"))
    rows = running(docs, doc, seed, F.col(size)).join(F.broadcast(total))
    return rows.select(doc, F.when(F.col("_through") - F.col(size) < F.col("_t"), "train").otherwise("val").alias("part"))


def until_reached(rows: DataFrame, order: str, goals: dict[str, tuple[Column, int]]) -> DataFrame:
    """The groups (distinct values of order) from the first on while any goal is still open before them.

    goals: name to (condition, rows wanted).  A goal is reached with the group of its n-th row in order, which a
    top-n finds; a goal that is never reached keeps all groups.
    """
    ends = None
    for wanted, n in goals.values():
        first = rows.filter(wanted).select(order).orderBy(order).limit(n).agg(F.when(F.count("*") == n, F.max(order)).alias("_end"))
        ends = first if ends is None else ends.unionAll(first)
    last = ends.agg(F.when(F.count("_end") == F.count("*"), F.max("_end")).alias("_last"))
    return rows.select(order).distinct().join(F.broadcast(last)).filter(F.col("_last").isNull() | (F.col(order) <= F.col("_last"))).select(order)
