"""Taking a given number of units from groups of any size by hash thresholds, without sorting them.

Units are summed by group and by one of 4,096 hash buckets; buckets below the one in which the running
sum passes the budget are taken whole, those above not at all.  That boundary bucket is refined by 4,096
buckets of its own, and only the rows of the one in which the budget ends are ranked: one in 16 million.
A group that holds a third of all rows is one more 4,096-row histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.runtime import materialize

BUCKETS = 4096


def random_key(seed: int, *cols: str):
    """A pseudo-random 64-bit key of a row, the same in every run."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def bucket(key: str, level: int = 0) -> Column:
    """The bucket of a key, from 0 to 4,095; level 1 parts a bucket again."""
    return (F.shiftrightunsigned(key, 52 - 12 * level).bitwiseAND(BUCKETS - 1)).cast("int")


def histogram(rows: DataFrame, group: list[str], key: str, size: str, level: int = 0) -> DataFrame:
    """Sums of size by group and bucket."""
    return rows.groupBy(*group, bucket(key, level).alias("_bucket")).agg(F.sum(size).alias("_sum"))


def _edges(sums: DataFrame, pool: list[str], group: list[str], budgets: DataFrame) -> DataFrame:
    """Per group: the last bucket that is taken whole, what is used with it, and the bucket in which the budget ends."""
    before = Window.partitionBy(*pool).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = sums.withColumn("_sofar", F.sum("_sum").over(before)).join(budgets, pool).withColumn("_through", F.col("_used") + F.col("_sofar"))
    fits = F.col("_through") <= F.col("_budget")
    return reached.groupBy(*group).agg(
        F.max("_budget").alias("_budget"),
        F.coalesce(F.max(F.when(fits, F.col("_bucket"))), F.lit(-1)).alias("_last"),
        F.coalesce(F.max(F.when(fits, F.col("_through"))), F.max("_used")).alias("_used"),
        F.coalesce(F.min(F.when(~fits, F.col("_bucket"))), F.lit(-1)).alias("_edge"),
    )


def take_budget(rows: DataFrame, group: list[str], key: str, size: str, budgets: DataFrame, budget: str, sums: DataFrame | None = None) -> DataFrame:
    """Rows of each group, in order of ``key``, while the sizes so far (its own included) fit the budget.

    budgets: one row a group.  Rows need not have all columns of a group: those they lack come from the budgets, and all
    groups that share a pool of rows share its histogram (sums, if it is known already); larger budgets take all that smaller
    ones do.  Groups without a budget, or of a null one, yield nothing.  At least every row that fits before the
    first that does not is taken.  Ties of ``key`` are taken together in no order only if the rows
    are equal in all other columns.
    """
    pool = [c for c in group if c in rows.columns]
    asked = budgets.select(*group, F.col(budget).alias("_budget"), F.lit(0).cast("long").alias("_used")).filter("_budget is not null")
    first = _edges(sums if sums is not None else histogram(rows, pool, key, size), pool, group, asked)
    names = ("_last", "_used", "_edge")
    first = materialize(first.select(*group, "_budget", *[F.col(c).alias(f"{c}1") for c in names]), "budget-edges")
    inside = rows.join(first.filter("_edge1 >= 0"), pool).filter(bucket(key) == F.col("_edge1"))
    second = _edges(histogram(inside, group, key, size, 1), group, group, first.select(*group, "_budget", F.col("_used1").alias("_used")))
    second = second.select(*group, *[F.col(c).alias(f"{c}2") for c in names])
    edges = materialize(first.join(second, group, "left").fillna(-1, ["_last2", "_edge2"]), "budget-edges")
    joined = rows.join(edges, pool).withColumns({"_b1": bucket(key), "_b2": bucket(key, 1)})
    at_edge = F.col("_b1") == F.col("_edge1")
    whole = joined.filter((F.col("_b1") <= F.col("_last1")) | (at_edge & (F.col("_b2") <= F.col("_last2"))))
    order = Window.partitionBy(*group).orderBy(key, *[c for c in rows.columns if c not in {*group, key, size}]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = joined.filter(at_edge & (F.col("_b2") == F.col("_edge2"))).withColumn("_run", F.col("_used2") + F.sum(size).over(order)).filter("_run <= _budget")
    columns = [*rows.columns, *[c for c in group if c not in pool]]
    return whole.select(*columns).unionByName(part.select(*columns))
