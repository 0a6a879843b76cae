"""The queries of the operators for training data, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lectern.llm import garble, leakage, linked_splits, mixing, neardup, overlap, pieces, quota_sample, sentences, subjects
from lectern.llm.keys import plain, plain_doc, source_of
from lectern.runtime import materialize, spread
from lectern.sources.tables import table

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
NEAR = {"width": 3, "threshold": 0.6, "min_words": 30}


def _texts(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a table, spread over all slots: for work on whole texts."""
    return spread(table(spark, d, name, key, *columns), key)


# 1 --------------------------------------------------------------------------------------------
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    docs = linked_splits.document_components(table(spark, d, "fragments", "doc_id", "doc_hash"))
    return linked_splits.linked_pairs(materialize(docs, "p1-docs"))


def _splits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "fragments", "fragment_id", "doc_id", "doc_hash")
    docs = materialize(linked_splits.document_components(rows), "p1-docs")
    named = rows.select("fragment_id", plain_doc("doc_id").alias("doc")).distinct().join(docs, "doc", "left")
    # a fragment of a document without a name is linked to nothing
    named = materialize(named.select("fragment_id", F.coalesce("component", F.concat(F.lit("f"), "fragment_id")).alias("component")), "p1-fragments")
    sized = named.groupBy("component").agg(F.count("*").alias("size"))
    return named, materialize(linked_splits.split_components(sized, SHARES), "p1-splits")


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """One row a fragment: its component and split."""
    named, splits = _splits(spark, d)
    return named.join(splits, "component").select("fragment_id", "component", F.col("split").alias("new_split"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Components and fragments of each split, and the share reached."""
    named, splits = _splits(spark, d)
    out = named.join(splits, "component").groupBy(F.col("split").alias("new_split")).agg(F.countDistinct("component").alias("components"), F.count("*").alias("fragments"))
    return out.join(F.broadcast(named.agg(F.count("*").alias("all_fragments")))).withColumn("share", F.col("fragments") / F.col("all_fragments"))


# 2 --------------------------------------------------------------------------------------------
def _fragments_by_category(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fragments", "fragment_id", *quota_sample.CATEGORIES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _fragments_by_category(spark, d).dropDuplicates(["fragment_id"])
    return quota_sample.quota_report(rows, table(spark, d, "sample_targets")).filter("short > 0").select("plan_id", "target_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Wanted, available, quota and shortfall of every category of every plan."""
    return quota_sample.quota_report(_fragments_by_category(spark, d).dropDuplicates(["fragment_id"]), table(spark, d, "sample_targets"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    """The fragments drawn for each plan."""
    sample, _ = quota_sample.quota_sample(_fragments_by_category(spark, d), "fragment_id", table(spark, d, "sample_targets"))
    return sample.select("plan_id", "target_id", F.col("id").alias("fragment_id"))


# 3 --------------------------------------------------------------------------------------------
def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized fragment."""
    return pieces.split_oversized(_texts(spark, d, "fragments", "fragment_id", "text"), "fragment_id", "text").withColumnRenamed("id", "fragment_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pieces(spark, d).select("fragment_id").distinct()


# 4 --------------------------------------------------------------------------------------------
def p4_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentence units of every fragment."""
    return sentences.sentence_units(_texts(spark, d, "fragments", "fragment_id", "text"), "fragment_id", "text").withColumnRenamed("id", "fragment_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "sentence_probe", "fragment_id").distinct()
    rows = table(spark, d, "fragments", "fragment_id", "text").join(asked, "fragment_id", "left_semi")
    return sentences.sentence_units(rows, "fragment_id", "text").select(F.col("id").alias("fragment_id"), "end_pos")


# 7 --------------------------------------------------------------------------------------------
def _values(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    rows = _texts(spark, d, "fragments", "fragment_id", "doc_id", *fields)
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    return rows.select(F.col("fragment_id").alias("id"), source_of("doc_id").alias("source"), each.alias("x")).select("id", "source", "x.field", "x.value").filter("value is not null")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return garble.repair(_values(spark, d, "text", "section_hint")).select(F.col("id").alias("fragment_id"), F.col("field").alias("field_name"))


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    """The garbled values with their encoding chain and the restored wording."""
    values = _values(spark, d, "text", "section_hint")
    out = garble.restore_lost(materialize(garble.repair(values), "p7-repaired"), values)
    return out.select(F.col("id").alias("fragment_id"), F.col("field").alias("field_name"), "chain", "posterior", "restored")


# 5 --------------------------------------------------------------------------------------------
def _near(spark: SparkSession, d: str, name: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Members and links of one table; garbled fragments, as far as they have a partner, are left out."""
    members, links = neardup.near_duplicate_groups(_texts(spark, d, name, key, "text"), key, "text", latin_only=True, **NEAR)
    if name == "fragments":
        with_partner = members.join(links.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).distinct(), "set_id", "left_semi")
        several = members.groupBy("set_id").agg(F.count("*").alias("n")).filter("n > 1")
        asked = with_partner.select("id").unionByName(members.join(several, "set_id", "left_semi").select("id"))
        bad = materialize(garble.repair(_values(spark, d, "text"), only=materialize(asked.distinct(), "p5-asked")).select("id"), "p5-garbled")
        members = members.join(bad, "id", "left_anti")
    return members, links


_TABLES = (("fragments", "fragment_id"), ("segments", "seg_id"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    out = [neardup.pairs_of_ids(*_near(spark, d, name, key)).select(F.lit(name).alias("table_name"), "id_a", "id_b") for name, key in _TABLES]
    return out[0].unionByName(out[1])


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a text: its group (texts joined by chains of near pairs), its class of copies, links of the class."""
    out = None
    for name, key in _TABLES:
        members, links = _near(spark, d, name, key)
        held = members.groupBy("set_id").agg(F.count("*").alias("copies"))
        links = links.join(held.select(F.col("set_id").alias("set_a")), "set_a", "left_semi").join(held.select(F.col("set_id").alias("set_b")), "set_b", "left_semi")
        groups = linked_splits.components(links.select(F.col("set_a").cast("string").alias("a"), F.col("set_b").cast("string").alias("b")))
        degree = links.select(F.explode(F.array("set_a", "set_b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("links"))
        rows = members.join(held, "set_id").join(degree, "set_id", "left").join(groups.select(F.col("node").cast("long").alias("set_id"), "component"), "set_id", "left")
        rows = rows.select(F.lit(name).alias("table_name"), "id", F.coalesce("component", F.col("set_id").cast("string")).alias("group_id"), F.col("set_id").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
        out = rows if out is None else out.unionByName(rows)
    return out


# 6 --------------------------------------------------------------------------------------------
def _split_tag():
    split = plain("split")
    return F.when(split == "train", F.lit("train")).when(split.isin("val", "test"), F.lit("eval"))


def _overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, "fragments", "fragment_id", "split", "text")
    members, found = overlap.cross_split_overlaps(rows, "fragment_id", "text", _split_tag(), **NEAR)
    pairs = materialize(overlap.overlap_pairs(members, found).filter("eval_id <> train_id"), "p6-pairs")
    asked = materialize(pairs.select(F.explode(F.array("eval_id", "train_id")).alias("id")).distinct(), "p6-asked")
    bad = materialize(garble.repair(_values(spark, d, "text"), only=asked).select("id"), "p6-garbled")
    return pairs.join(bad.withColumnRenamed("id", "eval_id"), "eval_id", "left_anti").join(bad.withColumnRenamed("id", "train_id"), "train_id", "left_anti")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap_pairs(spark, d).select(F.least("eval_id", "train_id").alias("id_a"), F.greatest("eval_id", "train_id").alias("id_b")).distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation fragments found in train, by split, document and evaluation set, and their best coverage."""
    best = _overlap_pairs(spark, d).groupBy("eval_id").agg(F.max("coverage").alias("coverage"), F.count("*").alias("train_fragments"))
    sets = table(spark, d, "a3_stats").select(plain("config.test_source").alias("key"), F.col("config.test_source").alias("evaluation_set")).dropDuplicates(["key"])
    rows = table(spark, d, "fragments", "fragment_id", "doc_id", "split", "test_source").dropDuplicates(["fragment_id"])
    rows = rows.select(F.col("fragment_id").alias("eval_id"), plain_doc("doc_id").alias("doc_id"), plain("split").alias("split"), plain("test_source").alias("key"))
    rows = best.join(rows, "eval_id").join(F.broadcast(sets), "key", "left")
    return rows.groupBy("split", "doc_id", "evaluation_set").agg(F.count("*").alias("fragments"), F.sum("train_fragments").alias("train_fragments"), F.max("coverage").alias("best_coverage"))


# 8 --------------------------------------------------------------------------------------------
def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and items with the longest common run and the least edit distance of 12 words (at most one)."""
    return leakage.leaked_passages(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "gold_items", "item_id", "text"), run=12, errors=1)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).filter("errors = 0").select("doc_id", "item_id")


# 9 --------------------------------------------------------------------------------------------
def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return mixing.count_tokens(_texts(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    sums = mixing.token_sums(_tokens(spark, d).dropDuplicates(["id"]))
    return mixing.mix_report(sums, table(spark, d, "mix_targets")).filter("short").select("mix_id", "source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix, with how often each is taken."""
    selection, _ = mixing.mix_sources(_tokens(spark, d), table(spark, d, "mix_targets"))
    return selection.select("mix_id", "source", F.col("id").alias("doc_id"), "copies")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """What each source of each mix reaches."""
    sizes = materialize(_tokens(spark, d), "p9-tokens")
    selection, report = mixing.mix_sources(sizes, table(spark, d, "mix_targets"))
    return mixing.mix_shares(sizes, selection, report)


# 10 -------------------------------------------------------------------------------------------
def p10_areas(spark: SparkSession, d: str) -> DataFrame:
    """The areas of every document, with the share of its subject-bearing sentences."""
    documents = _texts(spark, d, "documents", "doc_id", "text", "source")
    model = subjects.train(documents, table(spark, d, "subject_labels"), table(spark, d, "subject_areas"))
    return subjects.subject_areas(documents, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_areas(spark, d).select("doc_id", "area_code")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each area; the empty area counts those without a subject."""
    found = materialize(p10_areas(spark, d), "p10-areas")
    counts = found.groupBy("area_code").agg(F.count("*").alias("documents"))
    rest = table(spark, d, "documents", "doc_id").distinct().join(found.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.lit("").alias("area_code"), F.count("*").alias("documents"))
    return counts.unionByName(rest)


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_report, p2_found, p2_report, p2_sample, p3_found, p3_pieces, p4_found, p4_sentences, p5_found, p5_groups, p6_found, p6_report, p7_found, p7_repaired, p8_found, p8_leaks, p9_found, p9_mix, p9_shares, p10_found, p10_areas, p10_composition)}
