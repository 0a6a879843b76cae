"""Statistics that need more than one built-in aggregate; all of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window, functions as F


def bin_label(c: str, edges: Sequence[float]) -> Column:
    """The right-open bin a value falls in, as ``[a,b)``; null outside all bins."""
    out = None
    for a, b in pairwise(edges):
        inside = (F.col(c) >= a) & (F.col(c) < b)
        out = F.when(inside, f"[{a},{b})") if out is None else out.when(inside, f"[{a},{b})")
    return out


def histogram2d(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """(x, y, n) of a grid between the extremes, the last bin closed; rows with a null are left out."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("_x"), F.col(y).alias("_y"))
    ends = df.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))
    at = lambda v, lo, hi: F.least(F.floor(F.try_divide(bins * (F.col(v) - F.col(lo)), F.col(hi) - F.col(lo))), F.lit(bins - 1)).cast("int")
    return df.join(F.broadcast(ends)).groupBy(at("_x", "x0", "x1").alias("x"), at("_y", "y0", "y1").alias("y")).agg(F.count("*").alias("n"))


def ecdf(df: DataFrame, group: list[str], x: str) -> DataFrame:
    """(group, x, cdf) for every distinct value: counted first, so windows run over distinct values only."""
    counts = df.groupBy(*group, x).agg(F.count("*").alias("_n"))
    run = Window.partitionBy(*group).orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*group, x, (F.sum("_n").over(run) / F.sum("_n").over(Window.partitionBy(*group))).alias("cdf"))


def density(df: DataFrame, group: str, x: str, factor: float, low: float, high: float, points: int) -> DataFrame:
    """(group, at, density): Gaussian kernels at equal distances, bandwidth = factor * standard deviation.

    The grid is exploded per distinct value, after counting, and summed with partial aggregation.
    """
    counts = df.groupBy(group, x).agg(F.count("*").alias("_w"))
    scale = df.groupBy(group).agg(F.count(x).alias("_n"), (factor * F.stddev_samp(x)).alias("_h"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: low + k * (high - low) / (points - 1))
    z = (F.col("at") - F.col(x)) / F.col("_h")
    rows = counts.join(scale, group).withColumn("at", F.explode(grid))
    return rows.groupBy(group, "at", "_n", "_h").agg(F.sum(F.col("_w") * F.exp(-z * z / 2)).alias("_s")).select(group, "at", (F.col("_s") / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi()))).alias("density"))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): Pearson's r of every pair of columns, in one pass; null where a column is constant."""
    pairs = [(a, b) for a in columns for b in columns]
    once = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return once.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def cohen_d(df: DataFrame, flag: str, columns: Sequence[str]) -> DataFrame:
    """(feature, d): distance of the two groups' means in pooled standard deviations; 0 where that is 0."""
    part = lambda f, c, v: f(F.when(F.col(flag) == v, F.col(c)))
    once = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("a", lambda c: part(F.avg, c, True)), ("b", lambda c: part(F.avg, c, False)), ("s", lambda c: part(F.stddev_samp, c, True)), ("t", lambda c: part(F.stddev_samp, c, False)))])
    value = lambda c: F.coalesce(F.try_divide(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")), F.sqrt((F.col(f"s_{c}") ** 2 + F.col(f"t_{c}") ** 2) / 2)), F.lit(0.0))
    return once.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), value(c).alias("d")) for c in columns])).alias("x")).select("x.*")


def mann_whitney(df: DataFrame, flag: str, x: str) -> DataFrame:
    """(n1, n0, u, z, p_value, stars) of the values where flag is true against the others.

    Ranks come from the counts of distinct values, so the ordered window holds no repeated value.  p is
    two-sided, by the normal approximation with correction for ties and continuity.
    """
    counts = df.groupBy(x).agg(F.count_if(F.col(flag)).alias("a"), F.count("*").alias("n"))
    before = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("n").over(before), F.lit(0)) + (F.col("n") + 1) / 2
    s = counts.withColumn("rank", rank).agg(F.sum("a").alias("n1"), F.sum("n").alias("n"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    s = s.withColumn("n0", F.col("n") - F.col("n1")).withColumn("u", F.col("r") - n1 * (n1 + 1) / 2)
    spread = F.sqrt(n1 * (n - n1) / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    s = s.withColumn("z", F.try_divide(F.abs(F.col("u") - n1 * (n - n1) / 2) - 0.5, spread))
    t = 1 / (1 + 0.5 * F.col("z") / F.sqrt(F.lit(2.0)))
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    # the complementary error function, by a rational approximation good to 1e-7
    p = F.least(t * F.exp(-F.col("z") * F.col("z") / 2 + poly), F.lit(1.0))
    stars = F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**").when(F.col("p_value") < 0.05, "*").otherwise("ns")
    return s.withColumn("p_value", F.when(F.col("z") <= 0, 1.0).otherwise(p)).select("n1", "n0", "u", "z", "p_value", stars.alias("stars"))


def kolmogorov_smirnov(df: DataFrame, flag: str, x: str) -> DataFrame:
    """(d, n1, n0): the largest distance of the two groups' empirical distributions."""
    counts = df.groupBy(x).agg(F.count_if(F.col(flag)).alias("a"), F.count_if(~F.col(flag)).alias("b"))
    run = Window.orderBy(x).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.select(F.sum("a").over(run).alias("ra"), F.sum("b").over(run).alias("rb"))
    ends = counts.agg(F.sum("a").alias("n1"), F.sum("b").alias("n0"))
    return sums.join(F.broadcast(ends)).groupBy("n1", "n0").agg(F.max(F.abs(F.col("ra") / F.col("n1") - F.col("rb") / F.col("n0"))).alias("d"))


def whole_percentages(counts: DataFrame, group: str, label: str, n: str) -> DataFrame:
    """(group, label, pct): integer percentages that add up to 100 in each group, by largest remainders."""
    every = Window.partitionBy(group)
    p = counts.withColumn("p", 100.0 * F.col(n) / F.sum(n).over(every)).withColumn("low", F.floor("p"))
    r = F.row_number().over(every.orderBy(F.desc(F.round(F.col("p") - F.col("low"), 9)), label))
    return p.withColumn("r", r).withColumn("spare", 100 - F.sum("low").over(every)).select(group, label, (F.col("low") + F.when(F.col("r") <= F.col("spare"), 1).otherwise(0)).alias("pct"))
