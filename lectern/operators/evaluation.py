"""Quality of labels and predictions: everything is one or two aggregations in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, same, the 2x2 table (n11, n00, n10, n01), Cohen's kappa and Krippendorff's alpha of 0/1 labels.

    Without rows both are 0; kappa is 1 where chance agreement is certain, alpha where no disagreement is
    expected.  Rows with a null label do not count.
    """
    x, y = F.col(a) == 1, F.col(b) == 1
    t = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.count_if(x & y).alias("n11"), F.count_if(~x & ~y).alias("n00"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"))
    n = F.col("n")
    pa, pb = F.try_divide(F.col("n11") + F.col("n10"), n), F.try_divide(F.col("n11") + F.col("n01"), n)
    po, pe = F.try_divide(F.col("n11") + F.col("n00"), n), pa * pb + (1 - pa) * (1 - pb)
    share = (pa + pb) / 2
    de = 2 * share * (1 - share)
    kappa = F.when(n == 0, 0.0).when(pe == 1, 1.0).otherwise(F.try_divide(po - pe, 1 - pe))
    alpha = F.when(n == 0, 0.0).when(de == 0, 1.0).otherwise(1 - F.try_divide(1 - po, de))
    return t.withColumn("same", F.col("n11") + F.col("n00")).withColumn("kappa", kappa).withColumn("alpha", alpha)


def confusion(df: DataFrame, actual: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """(actual, pred, n) for every pair of the given labels, 0 where none."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, p) for a in labels for p in labels], "actual string, pred string")
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return F.broadcast(grid).join(counts, ["actual", "pred"], "left").select("actual", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def class_scores(df: DataFrame, actual: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1), 0 where a quotient has no denominator.

    Predictions outside the labels count as errors of the actual class only.
    """
    each = F.explode(F.array(F.struct(F.col(actual).alias("label"), F.lit(1).alias("is_actual"), F.lit(0).alias("is_pred")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("is_actual"), F.lit(1).alias("is_pred"))))
    rows = df.withColumn("hit", (F.col(actual) == F.col(pred)).cast("int")).select("hit", each.alias("x")).select("hit", "x.*")
    s = rows.groupBy("label").agg(F.sum(F.col("hit") * F.col("is_actual")).alias("tp"), F.sum("is_actual").alias("support"), F.sum("is_pred").alias("said"))
    domain = df.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    s = F.broadcast(domain).join(s, "label", "left").fillna(0, ["tp", "support", "said"])
    q = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, support, said = F.col("tp"), F.col("support"), F.col("said")
    return s.select("label", "tp", (said - tp).alias("fp"), (support - tp).alias("fn"), "support", q(tp, said).alias("precision"), q(tp, support).alias("recall"), q(2 * tp, said + support).alias("f1"))


def averages(df: DataFrame, actual: str, pred: str, labels: Sequence[str]) -> DataFrame:
    """macro_f1 over the given labels, micro_f1 and accuracy."""
    s = class_scores(df, actual, pred, labels)
    a = s.agg(F.avg("f1").alias("macro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return a.join(F.broadcast(df.agg(F.count("*").alias("all")))).select("macro_f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("micro_f1"), F.coalesce(F.try_divide("tp", "all"), F.lit(0.0)).alias("accuracy"))


def binary_macro_f1(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """macro_f1 of 0/1 predictions."""
    t, p = F.col(y) == 1, F.col(yhat) == 1
    s = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t != p).alias("wrong"))
    f = lambda c: F.coalesce(F.try_divide(2 * F.col(c), 2 * F.col(c) + F.col("wrong")), F.lit(0.0))
    return s.select(((f("tp") + f("tn")) / 2).alias("macro_f1"))


def binary_by(df: DataFrame, group: str, y: str, yhat: str) -> DataFrame:
    """(group, n, f1, recall) of 0/1 predictions, 0 where a quotient has no denominator."""
    t, p = F.col(y) == 1, F.col(yhat) == 1
    s = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(t & p).alias("tp"), F.count_if(t != p).alias("wrong"), F.count_if(t).alias("pos"))
    q = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select(group, "n", q(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")).alias("f1"), q(F.col("tp"), F.col("pos")).alias("recall"))


def ablation(df: DataFrame, y: str, arms: dict[str, Column], base: str, predict: Callable[[Column], Column]) -> DataFrame:
    """(arm, macro_f1, drop_f1, verdict) of every arm but the base: what the prediction loses when its input is changed.

    arms: name to the input in place of the text; predict: the 0/1 prediction of an input.  A drop above 0.2 means that
    the content decides, above 0.05 both, else a shortcut does.
    """
    scored = [binary_macro_f1(df.withColumn("_p", predict(x)), y, "_p").select(F.lit(n).alias("arm"), "macro_f1") for n, x in arms.items()]
    rows = reduce(DataFrame.unionByName, scored)
    whole = rows.filter(F.col("arm") == base).select(F.col("macro_f1").alias("_whole"))
    drop = F.col("_whole") - F.col("macro_f1")
    out = rows.filter(F.col("arm") != base).join(F.broadcast(whole))
    return out.select("arm", F.round("macro_f1", 6).alias("macro_f1"), F.round(drop, 6).alias("drop_f1"), F.when(drop > 0.2, "content").when(drop > 0.05, "mixed").otherwise("shortcut").alias("verdict"))


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds: Sequence[float], tolerance: float = 1e-4) -> DataFrame:
    """best_f1 (macro), the threshold nearest to 0.5 among those within tolerance of it, and their range.

    Scores are counted by value first; the thresholds meet the counts, not the rows.
    """
    counts = df.groupBy(p).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    grid = counts.withColumn("t", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    over = F.col(p) >= F.col("t")
    neg = F.col("n") - F.col("pos")
    s = grid.groupBy("t").agg(F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, neg).otherwise(0)).alias("fp"), F.sum(F.when(~over, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~over, neg).otherwise(0)).alias("tn"))
    wrong = F.col("fp") + F.col("fn")
    f = lambda c: F.coalesce(F.try_divide(2 * F.col(c), 2 * F.col(c) + wrong), F.lit(0.0))
    s = s.select("t", F.round((f("tp") + f("tn")) / 2, 6).alias("f1"))
    best = s.agg(F.max("f1").alias("best_f1"))
    near = s.join(F.broadcast(best)).filter(F.col("f1") >= F.col("best_f1") - tolerance)
    return near.groupBy("best_f1").agg(F.min_by("t", F.struct(F.round(F.abs(F.col("t") - 0.5), 6), F.col("t"))).alias("threshold"), F.min("t").alias("plateau_min"), F.max("t").alias("plateau_max"))


def curves(df: DataFrame, y: str, p: str) -> DataFrame:
    """(threshold, tpr, fpr, precision, pos, n) at every distinct score, from the highest down."""
    c = df.groupBy(F.col(p).alias("threshold")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    run = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = c.agg(F.sum("pos").alias("all_pos"), F.sum("n").alias("all_n"))
    c = c.withColumn("tp", F.sum("pos").over(run)).withColumn("k", F.sum("n").over(run)).join(F.broadcast(ends))
    return c.select("threshold", "pos", "n", F.try_divide("tp", "all_pos").alias("tpr"), F.try_divide(F.col("k") - F.col("tp"), F.col("all_n") - F.col("all_pos")).alias("fpr"), (F.col("tp") / F.col("k")).alias("precision"))


def ranking_scores(df: DataFrame, y: str, p: str) -> DataFrame:
    """auc (ties count half) and average_precision of 0/1 labels; null where a class is missing."""
    c = df.groupBy(F.col(p).alias("s")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("tp", F.sum("pos").over(down)).withColumn("k", F.sum("n").over(down))
    neg = F.col("n") - F.col("pos")
    # a positive beats all negatives below it and ties with those beside it
    below = F.sum(neg).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    c = c.withColumn("won", F.col("pos") * (F.coalesce(below, F.lit(0)) + neg / 2))
    return c.agg(F.try_divide(F.sum("won"), F.sum("pos") * F.sum(neg)).alias("auc"), F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("k")), F.sum("pos")).alias("average_precision"))


def bootstrap_f1(df: DataFrame, y: str, yhat: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """(samples, mean, std, low, high) of the macro-F1 of resamples with replacement, those of one actual class left out.

    The score depends on the four counts of the confusion table only, and those of a resample follow a multinomial
    distribution over them: the rows are counted once, and every round draws four numbers, however many rows there are.
    """
    cells = df.agg(*[F.count_if((F.col(y) == a) & (F.col(yhat) == b)).alias(n) for n, a, b in (("tp", 1, 1), ("fn", 1, 0), ("fp", 0, 1), ("tn", 0, 0))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for b, *n in pdf[["id", "tp", "fn", "fp", "tn"]].itertuples(index=False, name=None):
                if sum(n):
                    out.append((b, *np.random.default_rng([seed, b]).multinomial(sum(n), np.array(n) / sum(n)).tolist()))
            yield pd.DataFrame(out, columns=["id", "tp", "fn", "fp", "tn"])

    drawn = df.sparkSession.range(rounds).join(F.broadcast(cells)).mapInPandas(run, "id long, tp long, fn long, fp long, tn long").filter("tp + fn > 0 and fp + tn > 0")
    wrong = F.col("fn") + F.col("fp")
    f = lambda c: F.coalesce(F.try_divide(2 * F.col(c), 2 * F.col(c) + wrong), F.lit(0.0))
    f1 = drawn.select(((f("tp") + f("tn")) / 2).alias("f1"))
    return f1.agg(F.count("*").alias("samples"), F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std"), F.percentile("f1", F.lit(0.025)).alias("low"), F.percentile("f1", F.lit(0.975)).alias("high"))
