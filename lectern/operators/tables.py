"""Operators on whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_common(*frames: DataFrame) -> DataFrame:
    """All rows of all tables, with the columns they share, in the order of the first.

    Names are compared without outer blanks.  Tables that share no column are an error.
    """
    frames = tuple(f.toDF(*[c.strip() for c in f.columns]) for f in frames)
    shared = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    if not shared:
        raise ValueError("the tables have no column in common")
    return reduce(DataFrame.unionByName, [f.select(shared) for f in frames])
