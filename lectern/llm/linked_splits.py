"""Splits that keep linked records together.

Documents and the hashes of their content form a graph.  Its components come from a breadth-first
search from many seeds at once: adjacency lists are hash-partitioned, a seed is a node whose hash is
smallest among its neighbours (so every component has one), all frontiers advance together for a few
hops, and where two searches meet, their labels are joined in a smaller graph, which is treated the
same way until no edge is left.  Components go to splits in the order of their hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.llm.keys import content_hash, plain_doc
from lectern.runtime import materialize

HOPS = 2


def _rank(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), F.col(node).alias("node"))


def _level(edges: DataFrame) -> DataFrame:
    """(node, label): each node of the symmetric edges (a, b) with the seed whose search reached it."""
    nodes = edges.groupBy(F.col("a").alias("node")).agg(F.min(_rank("b")).alias("near"))
    seed = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node")) < F.col("near")
    labels = nodes.select("node", F.when(seed, F.col("node")).alias("label"))
    front = labels.filter("label is not null")
    for hop in range(HOPS):
        met = edges.join(front.select(F.col("node").alias("a"), "label"), "a")
        reached = met.groupBy(F.col("b").alias("node")).agg(F.min("label").alias("met"))
        step = labels.join(reached, "node", "left")
        if hop < HOPS - 1:
            front = step.filter("label is null and met is not null").select("node", F.col("met").alias("label"))
        labels = step.select("node", F.coalesce("label", "met").alias("label"))
    return labels.select("node", F.coalesce("label", "node").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph with edges (a, b); a node without edges has no row.

    Nulls link nothing, loops and repeated edges count once.  Every round at least halves the nodes
    that still have edges, so long chains take a logarithmic number of rounds.
    """
    both = edges.filter("a is not null and b is not null and a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph-edges")
    where: DataFrame | None = None
    while not both.isEmpty():
        level = materialize(_level(both), "graph-labels")
        if where is None:
            where = level.withColumnRenamed("label", "component")
        else:
            moved = where.join(level.withColumnRenamed("node", "component"), "component", "left")
            where = materialize(moved.select("node", F.coalesce("label", "component").alias("component")), "graph-components")
        a, b = level.select(F.col("node").alias("a"), F.col("label").alias("la")), level.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        met = both.join(a, "a").join(b, "b").filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        both = materialize(met, "graph-edges")
    return where if where is not None else both.select(F.col("a").alias("node"), F.col("b").alias("component"))


def document_components(fragments: DataFrame) -> DataFrame:
    """(doc, component) for every document named in fragments, by doc_id and doc_hash.

    A document without a name takes no part; null, blank and placeholder hashes link nothing; a
    document without links is its own component.
    """
    named = fragments.select(plain_doc("doc_id").alias("doc"), content_hash("doc_hash").alias("hash")).filter("doc is not null").distinct()
    named = materialize(named, "doc-hash")
    edges = named.filter("hash is not null").select(F.concat(F.lit("d"), "doc").alias("a"), F.concat(F.lit("h"), "hash").alias("b"))
    found = components(edges).filter("node like 'd%'").select(F.expr("substring(node, 2)").alias("doc"), "component")
    return named.select("doc").distinct().join(found, "doc", "left").select("doc", F.coalesce("component", F.concat(F.lit("d"), "doc")).alias("component"))


def linked_pairs(docs: DataFrame) -> DataFrame:
    """All pairs doc_a < doc_b of one component."""
    several = docs.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    docs = docs.join(several, "component", "left_semi")
    a, b = docs.select("component", F.col("doc").alias("doc_a")), docs.select("component", F.col("doc").alias("doc_b"))
    return a.join(b, "component").filter("doc_a < doc_b").select("doc_a", "doc_b")


def split_components(sized: DataFrame, shares: dict[str, float], *, seed: int = 42, large: float = 0.005) -> DataFrame:
    """(component, split) for (component, size), the sizes of the splits near the given shares.

    Components above ``large`` of all (at most 1 / large of them) are placed first, the largest into the
    split that lacks most; the others follow in the order of their hash, cut at 65,536 hash buckets, to
    fill what is left.  Shares must add up to 1.
    """
    spark = sized.sparkSession
    total = sized.agg(F.sum("size")).first()[0] or 0
    big = sized.filter(F.col("size") > large * total).orderBy(F.desc("size"), "component").collect() if total else []
    left = {k: v * total for k, v in shares.items()}
    placed = []
    for row in big:
        k = max(left, key=lambda x: left[x])
        placed.append((row["component"], k))
        left[k] -= row["size"]
    left = {k: max(0.0, v) for k, v in left.items()}
    whole = sum(left.values()) or 1.0
    small = sized.filter(F.col("size") <= large * total).withColumn("bucket", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "component"), 48))
    sums = small.groupBy("bucket").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = (F.sum("sum").over(before) - F.col("sum") / 2) / F.sum("sum").over(Window.partitionBy(F.lit(0)))
    split, reached = F.lit(None).cast("string"), 0.0
    for k, v in left.items():
        reached += v / whole
        split = F.coalesce(split, F.when(F.col("part") <= reached, F.lit(k)))
    last = max(left, key=lambda x: left[x])
    cut = sums.withColumn("part", part).select("bucket", F.coalesce(split, F.lit(last)).alias("split"))
    out = small.join(cut, "bucket").select("component", "split")
    return out.unionByName(spark.createDataFrame(placed, "component string, split string")) if placed else out
