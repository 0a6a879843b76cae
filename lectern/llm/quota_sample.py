"""Samples whose shares of categories match target proportions."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lectern.llm.hash_budget import random_key, take_budget
from lectern.llm.keys import plain
from lectern.runtime import materialize

CATEGORIES = ("contr_type", "tarea1_label", "tarea2_role")
_ANY = "*"


def allocate(shares: list[float], floors: list[int], available: list[int], total: int) -> list[int]:
    """Rows for each category: largest remainders of share * total, with floors and caps.

    What a capped category cannot take goes to the others by largest remainder of their shares; the
    sum is total unless floors or availability forbid it.  Ties go to the earlier category.
    """
    n = len(shares)
    got = [min(f, a) for f, a in zip(floors, available)]
    open_ = set(range(n))
    while open_:
        rest = total - sum(got[i] for i in range(n) if i not in open_)
        weight = sum(shares[i] for i in open_)
        if rest <= 0 or weight <= 0:
            break
        ideal = {i: shares[i] / weight * rest for i in open_}
        low = {i for i in open_ if ideal[i] < min(floors[i], available[i])}
        high = {i for i in open_ if ideal[i] > available[i]}
        if low or high:
            # the side that is further off is settled first
            if sum(min(floors[i], available[i]) - ideal[i] for i in low) >= sum(ideal[i] - available[i] for i in high):
                for i in low:
                    got[i] = min(floors[i], available[i])
                open_ -= low
            else:
                for i in high:
                    got[i] = available[i]
                open_ -= high
            continue
        base = {i: int(ideal[i]) for i in open_}
        spare = rest - sum(base.values())
        for i in sorted(open_, key=lambda i: (base[i] - ideal[i], i)):
            extra = 1 if spare > 0 and base[i] < available[i] else 0
            got[i], spare = base[i] + extra, spare - extra
        break
    return got


def _keys(df: DataFrame, columns=CATEGORIES) -> DataFrame:
    return df.withColumns({f"_{c}": F.coalesce(plain(c), F.lit("")) for c in columns})


def quota_report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: wanted, available, quota (rows to draw) and short (wanted - available, if positive).

    rows: one row a record with the category columns.  targets: plan_id, target_id, the category
    columns (null admits any value, an empty string means no label), target_share, min_rows,
    sample_rows.  Null, empty and blank categories of a record are no label.  Categories are compared
    without case, outer blanks, hyphens, blanks and underscores.  Only counts of category combinations
    leave the scan; without rows every target is short.
    """
    counts = _keys(rows).groupBy(*[f"_{c}" for c in CATEGORIES]).agg(F.count("*").alias("n"))
    masks = list(itertools.product((False, True), repeat=len(CATEGORIES)))
    each = F.explode(F.array(*[F.struct(*[(F.lit(_ANY) if m else F.col(f"_{c}")).alias(f"k_{c}") for c, m in zip(CATEGORIES, mask)], F.col("n").alias("n")) for mask in masks]))
    counts = counts.select(each.alias("x")).select("x.*").groupBy(*[f"k_{c}" for c in CATEGORIES]).agg(F.sum("n").alias("available"))
    asked = _target_keys(targets).join(counts, [f"k_{c}" for c in CATEGORIES], "left").withColumn("available", F.coalesce("available", F.lit(0)).cast("long"))
    mille = F.round(F.col("target_share") * 1000).cast("long")
    asked = asked.withColumn("wanted", F.greatest(F.col("min_rows").cast("long"), F.floor((mille * F.col("sample_rows") + 999) / 1000)))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("target_id")
        quota = allocate(pdf["target_share"].tolist(), pdf["min_rows"].tolist(), pdf["available"].tolist(), int(pdf["sample_rows"].iloc[0]))
        return pdf.assign(quota=quota)[["plan_id", "target_id", "wanted", "available", "quota"]]

    out = asked.select("plan_id", "target_id", "target_share", "min_rows", "sample_rows", "available", "wanted").groupBy("plan_id").applyInPandas(plan, "plan_id int, target_id int, wanted long, available long, quota long")
    return out.withColumn("short", F.greatest(F.col("wanted") - F.col("available"), F.lit(0)))


def _target_keys(targets: DataFrame) -> DataFrame:
    return targets.withColumns({f"k_{c}": F.when(F.col(c).isNull(), F.lit(_ANY)).otherwise(plain(c)) for c in CATEGORIES})


def quota_sample(rows: DataFrame, id_col: str, targets: DataFrame, *, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report): sample has (plan_id, target_id, id), the rows with the smallest random keys.

    Rows of equal id must be equal in their categories and count once.
    """
    rows = materialize(_keys(rows.select(F.col(id_col).alias("id"), *CATEGORIES).dropDuplicates(["id"])).select("id", *CATEGORIES, *[f"_{c}" for c in CATEGORIES]), "quota-rows")
    report = materialize(quota_report(rows.select("id", *CATEGORIES), targets), "quota-report")
    wanted = _target_keys(targets).join(report.filter("quota > 0").select("target_id", "quota"), "target_id")
    # which targets a combination of categories belongs to is settled among the combinations; rows only look it up
    own = [f"_{c}" for c in CATEGORIES]
    masks = F.array(*[F.struct(*[(F.lit(_ANY) if m else F.col(f"_{c}")).alias(f"k_{c}") for c, m in zip(CATEGORIES, mask)]) for mask in itertools.product((False, True), repeat=len(CATEGORIES))])
    combinations = rows.select(*own).distinct().select(*own, F.explode(masks).alias("k")).select(*own, "k.*")
    belongs = combinations.join(wanted.select("plan_id", "target_id", *[f"k_{c}" for c in CATEGORIES]), [f"k_{c}" for c in CATEGORIES]).select(*own, "plan_id", "target_id")
    matched = rows.select("id", *own).join(belongs, own)
    matched = matched.select("plan_id", "target_id", "id", F.lit(1).alias("one")).withColumn("key", random_key(seed, "target_id", "id"))
    budget = report.select("plan_id", "target_id", "quota")
    return take_budget(matched, ["plan_id", "target_id"], "key", "one", budget, "quota").select("plan_id", "target_id", "id"), report
