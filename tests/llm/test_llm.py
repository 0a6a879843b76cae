"""The operators for training data: brute force on small fixtures, exact round trips, edge cases."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm.wordcodes import word_codes
from lectern.llm import garble, hash_budget, leakage, linked_splits, mixing, neardup, overlap, pieces, quota_sample, sentences, subjects
from lectern.llm.keys import content_hash, plain, plain_doc

WORDS = [f"palabra{i}" for i in range(400)]


def fragments(spark, rows):
    return spark.createDataFrame(rows, "fragment_id long, text string")


# keys -----------------------------------------------------------------------------------------------
def test_keys(spark):
    rows = spark.createDataFrame([(" Core_01.TXT ", " ABCDEF123456"), ("core_01.json", "0000"), ("", ""), (None, None), ("a", "d41d8cd98f00b204")], "d string, h string")
    got = rows.select(plain_doc("d").alias("d"), content_hash("h").alias("h")).collect()
    assert [(r["d"], r["h"]) for r in got] == [("core_01", "abcdef123456"), ("core_01", None), (None, None), (None, None), ("a", None)]
    assert spark.createDataFrame([("Hard-Negative ",)], "c string").select(plain("c").alias("c")).first()["c"] == "hardnegative"


# 1 --------------------------------------------------------------------------------------------------
def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for x in parent:
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("kind", ["chain", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {"chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "star": [("hub", f"n{i}") for i in range(50)] + [("hub", "hub"), (None, "x")], "random": [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(60)], "empty": []}[kind]
    got = {}
    for r in linked_splits.components(spark.createDataFrame(edges, "a string, b string")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    want = brute_components([(a, b) for a, b in edges if a and b and a != b])
    assert {frozenset(g) for g in got.values()} == want


def test_linked_documents(spark):
    rows = spark.createDataFrame([("A.txt", "h1"), (" a ", "h2"), ("b", "H2 "), ("c", "h3"), ("d", None), ("e", "0000"), ("f", "0000"), (None, "h3")], "doc_id string, doc_hash string")
    docs = linked_splits.document_components(rows)
    assert {r["doc"] for r in docs.collect()} == set("abcdef")
    assert [tuple(r) for r in linked_splits.linked_pairs(docs).collect()] == [("a", "b")]


def test_splits_hold_their_shares(spark):
    sized = spark.createDataFrame([(f"c{i}", 300 if i == 0 else 1) for i in range(700)], "component string, size long")
    out = linked_splits.split_components(sized, {"train": 0.8, "val": 0.1, "test": 0.1})
    assert out.count() == 700
    got = {r["split"]: r["n"] for r in out.join(sized, "component").groupBy("split").agg(F.sum("size").alias("n")).collect()}
    assert abs(got["train"] - 800) < 60 and abs(got["val"] - 100) < 40 and abs(got["test"] - 100) < 40


# 2 --------------------------------------------------------------------------------------------------
def test_allocate():
    assert quota_sample.allocate([0.5, 0.3, 0.2], [0, 0, 0], [99, 99, 99], 10) == [5, 3, 2]
    assert quota_sample.allocate([0.9, 0.1], [0, 3], [99, 99], 10) == [7, 3]
    assert quota_sample.allocate([0.5, 0.5], [0, 0], [2, 99], 10) == [2, 8]
    assert quota_sample.allocate([0.5, 0.5], [5, 5], [0, 1], 10) == [0, 1]
    assert quota_sample.allocate([1.0], [0], [5], 0) == [0]


def test_quota_sample(spark):
    rows = spark.createDataFrame([(i, "Explicit " if i % 3 == 0 else "none", None if i % 2 else "CONTR", "hard-negative") for i in range(60)] * 2, "fragment_id long, contr_type string, tarea1_label string, tarea2_role string")
    targets = spark.createDataFrame([(1, 1, "explicit", None, None, 0.5, 5, 30), (2, 1, "none", None, None, 0.5, 5, 30), (3, 2, "explicit", "", "hard_negative", 1.0, 20, 10)], "target_id int, plan_id int, contr_type string, tarea1_label string, tarea2_role string, target_share double, min_rows int, sample_rows int")
    sample, report = quota_sample.quota_sample(rows, "fragment_id", targets)
    by = {r["target_id"]: r for r in report.collect()}
    assert (by[1]["available"], by[1]["wanted"], by[1]["quota"], by[1]["short"]) == (20, 15, 15, 0)
    assert (by[3]["available"], by[3]["wanted"], by[3]["short"]) == (10, 20, 10)
    counts = {r["target_id"]: r["n"] for r in sample.groupBy("target_id").agg(F.countDistinct("id").alias("n")).collect()}
    assert counts == {1: 15, 2: 15, 3: 10}
    none = quota_sample.quota_report(rows.limit(0), targets).collect()
    assert all(r["available"] == 0 and r["short"] == r["wanted"] for r in none)


def test_take_budget_is_a_prefix(spark):
    rows = spark.createDataFrame([("a" if i % 3 else "b", i, 1 + i % 4) for i in range(300)], "g string, id long, size long").withColumn("key", hash_budget.random_key(1, "id"))
    budgets = spark.createDataFrame([("a", 100), ("b", 0)], "g string, budget long")
    got = {r["id"] for r in hash_budget.take_budget(rows, ["g"], "key", "size", budgets, "budget").collect()}
    order = sorted((r["_k"], r["id"], r["size"]) for r in rows.filter("g = 'a'").withColumn("_k", F.expr("shiftrightunsigned(key, 52)")).collect())
    taken = sum(s for _, i, s in order if i in got)
    assert 90 <= taken <= 100 and all(i % 3 for i in got)
    # groups that share a pool: each takes a prefix of one order, the larger budget all that the smaller does
    pool = rows.withColumn("g", F.lit("one"))
    shared = hash_budget.take_budget(pool, ["mix", "g"], "key", "size", spark.createDataFrame([(1, "one", 50), (2, "one", 500), (3, "one", 10_000)], "mix int, g string, budget long"), "budget")
    by = {m: {r["id"] for r in shared.filter(F.col("mix") == m).collect()} for m in (1, 2, 3)}
    assert by[1] < by[2] < by[3] and len(by[3]) == 300
    sizes = {r["id"]: r["size"] for r in pool.collect()}
    assert 46 <= sum(sizes[i] for i in by[1]) <= 50 and 496 <= sum(sizes[i] for i in by[2]) <= 500


def test_quota_sample_takes_the_smallest_keys(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", "x", "y") for i in range(200)], "fragment_id long, contr_type string, tarea1_label string, tarea2_role string")
    targets = spark.createDataFrame([(1, 1, "a", None, None, 0.5, 5, 30), (2, 1, "b", None, None, 0.5, 5, 30)], "target_id int, plan_id int, contr_type string, tarea1_label string, tarea2_role string, target_share double, min_rows int, sample_rows int")
    got = {}
    for r in quota_sample.quota_sample(rows, "fragment_id", targets)[0].collect():
        got.setdefault(r["target_id"], set()).add(r["id"])
    for target, odd in ((1, 1), (2, 0)):
        keys = rows.filter(F.col("fragment_id") % 2 == odd).select("fragment_id", F.xxhash64(F.lit(42), F.lit(target), "fragment_id").alias("k")).collect()
        want = sorted(keys, key=lambda r: r["k"] % 2**64)[:15]
        assert got[target] == {r["fragment_id"] for r in want}


# 3 --------------------------------------------------------------------------------------------------
def greedy(start, end, kind, word, max_words, max_chars, overlap):
    cut, nxt = pieces.successors(start, end, kind, word, max_words, max_chars, overlap)
    out, i = [], 0
    while i < len(start):
        out.append(i)
        i = int(nxt[i])
    return out


@pytest.mark.parametrize("text", ["uno dos tres. " * 900, "a" * 25_000, "第一句话很长。" * 3000, " ".join(["x"] * 2500), "línea\n" * 1500, "p1 " * 400 + "\n\n" + "p2 " * 800])
def test_pieces(text):
    assert pieces.oversized(text, 1000, 10_000) == (len(text.split()) > 1000 or len(text) > 10_000)
    cuts = pieces.cut_text(text, 1000, 10_000, 50)
    assert cuts[0][0] == len(text) - len(text.lstrip()) and cuts[-1][1] == len(text.rstrip())
    for (a, b, w), (c, d, _) in zip(cuts, [*cuts[1:], (None, None, None)]):
        assert len(text[a:b].split()) == w <= 1000 and b - a <= 10_000
        assert c is None or a < c < b or c <= b
    u = pieces.units(text)
    assert len(cuts) == len(greedy(*u, 1000, 10_000, 50))


def test_pieces_of_table(spark):
    rows = fragments(spark, [(1, "corto"), (2, None), (3, ""), (4, "una palabra. " * 700), (4, "una palabra. " * 700)])
    got = pieces.split_oversized(rows.withColumn("text_", F.lit(1)), "fragment_id", "text").collect()
    assert {r["id"] for r in got} == {4} and len(got) == got[0]["piece_count"] == 2
    assert pieces.split_oversized(rows.limit(0), "fragment_id", "text").count() == 0
    blank = pieces.split_oversized(fragments(spark, [(1, " " * 10_001), (2, " " * 9_000)]), "fragment_id", "text").collect()
    assert [(r["id"], r["char_start"], r["char_end"], r["word_count"]) for r in sorted(blank, key=lambda r: r["char_start"])] == [(1, 0, 10_000, 0), (1, 10_000, 10_001, 0)]


# 4 --------------------------------------------------------------------------------------------------
CASES = [
    ("El Dr. Pérez y la Dra. López (véase la Fig. 3) midieron 54,53 mg/l. Luego vino otra.", 2),
    ("Hacia el s. III a. C. ya constaba. J. M. Ruiz lo vio en EE. UU. y calló.", 2),
    ("Metodología\nSe midió el\nagua. 2.1. Diseño\n", None),
    ("Metodología\nSe midió el\nagua.", 2),
    ("2.1. Diseño y participación\n¿Hasta qué punto? ¡Nunca! pH y sal suben.", 4),
    ("El texto pregunta: “¿es así?”, y responde que no. Otra.", 2),
    ("«Метод устойчив. разброс нет», — пишет автор. По словам г. Морвелина, т. е. так (см. рис. 5). Да?", 3),
    ("报告写道:“法规有效。法院次之。”这一记录仍需验证。结果稳定!是否?对。", 4),
    ("著者は「仮説は安定である。試料も同様だ」と述べている。終わり。", 2),
    ("डॉ. केरिन ने कहा। मान 74.62 था। क्या?", 3),
    ("ذكر د. مورفيل أن هذا. هل تغير؟ نعم.", 3),
    ("Κατά τον κ. Μορβέλη, είναι 18,97, δηλ. πάνω. Μήπως αλλάζει; Ναι.", 3),
    ("ค่าเฉลี่ยเท่ากับ 19.81 หน่วย ผู้วิจัยเปรียบเทียบบันทึก", 2),
    ("Fin sin espacio.Otra frase aquí. Los puntos... no cierran.", 3),
]


@pytest.mark.parametrize("text,n", CASES)
def test_sentences(text, n):
    got = sentences.unit_ends(text)
    if n is not None:
        assert len(got) == n, [text[a:b] for a, b in got]
    assert "".join(text[a:b] for a, b in got).replace("\n", "").replace(" ", "") == re.sub(r"\s", "", text)


def test_sentences_of_table(spark):
    got = sentences.sentence_units(fragments(spark, [(1, "Una. Dos."), (1, "Una. Dos."), (2, None), (3, " \n ")]), "fragment_id", "text").orderBy("unit_index").collect()
    assert [(r["id"], r["end_pos"]) for r in got] == [(1, 4), (1, 9)]


# 5 and 6 --------------------------------------------------------------------------------------------
def corpus(n=120, seed=3):
    rng = random.Random(seed)
    base = [[rng.choice(WORDS) for _ in range(rng.randrange(35, 160))] for _ in range(n // 3)]
    out = []
    for k in range(n):
        w = list(base[k % len(base)])
        for _ in range(rng.randrange(0, 8) if k >= len(base) else 0):
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(2)] = [rng.choice(WORDS)] * rng.randrange(2)
        out.append((k, " ".join(w) + ("." if k % 2 else "!")))
    return [*out, (n, out[0][1].upper()), (n + 1, None), (n + 2, ""), (n + 3, "muy corto"), (5, out[5][1])]


def jaccard_pairs(rows, width=3, threshold=0.6, least=30):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= least:
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def family(n, kind="replace", seed=11):
    """n texts edited from one, each in its own places and with its own words."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    out = []
    for k in range(n):
        w = list(base)
        for j, at in enumerate(sorted(rng.sample(range(0, 290, 4), rng.randrange(6, 13)), reverse=True)):
            w[at : at + (kind == "replace")] = [f"own{k}x{j}"]
        out.append((k, " ".join(w)))
    return out


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    members, links = neardup.near_duplicate_groups(fragments(spark, rows), "fragment_id", "text", width=3, threshold=0.6, min_words=30, latin_only=True)
    got = {tuple(r) for r in neardup.pairs_of_ids(members, links).collect()}
    assert got == jaccard_pairs(rows)
    assert members.count() == len({i for i, t in rows if t and len(t.split()) >= 30})


@pytest.mark.parametrize("kind", ["replace", "insert"])
def test_near_duplicates_of_a_family(spark, kind):
    rows = family(120, kind)
    members, links = neardup.near_duplicate_groups(fragments(spark, rows), "fragment_id", "text", width=3, threshold=0.6, min_words=30, latin_only=True)
    got, want = {tuple(r) for r in neardup.pairs_of_ids(members, links).collect()}, jaccard_pairs(rows)
    assert len(want) > 1000 and got == want


def test_near_duplicates_of_nothing(spark):
    members, links = neardup.near_duplicate_groups(fragments(spark, []), "fragment_id", "text")
    assert members.count() == 0 and links.count() == 0


def test_overlaps_against_brute_force(spark):
    rows = corpus(seed=5)
    tag = F.when(F.col("fragment_id") % 4 == 0, "eval").when(F.col("fragment_id") % 4 < 3, "train")
    members, found = overlap.cross_split_overlaps(fragments(spark, rows), "fragment_id", "text", tag, width=3, threshold=0.6, min_words=30)
    got = {(r["eval_id"], r["train_id"]) for r in overlap.overlap_pairs(members, found).collect()}
    want = {(a, b) if a % 4 == 0 else (b, a) for a, b in jaccard_pairs(rows) if 3 not in (a % 4, b % 4) and (a % 4 == 0) != (b % 4 == 0)}
    assert got == want
    assert all(0.5 < r["coverage"] <= 1 for r in found.collect())


@pytest.mark.parametrize("kind", ["replace", "insert"])
def test_overlaps_of_a_family(spark, kind):
    rows = family(120, kind)
    tag = F.when(F.col("fragment_id") % 4 == 0, "eval").otherwise("train")
    members, found = overlap.cross_split_overlaps(fragments(spark, rows), "fragment_id", "text", tag, width=3, threshold=0.6, min_words=30)
    got = {(r["eval_id"], r["train_id"]) for r in overlap.overlap_pairs(members, found).collect()}
    want = {(a, b) if a % 4 == 0 else (b, a) for a, b in jaccard_pairs(rows) if (a % 4 == 0) != (b % 4 == 0)}
    assert len(want) > 500 and got == want


def test_a_family_of_a_thousand(spark):
    rows = family(1000, "insert", seed=12)
    want = jaccard_pairs(rows)
    near = {"width": 3, "threshold": 0.6, "min_words": 30}
    members, links = neardup.near_duplicate_groups(fragments(spark, rows), "fragment_id", "text", **near)
    got = {tuple(r) for r in neardup.pairs_of_ids(members, links).collect()}
    assert len(want) > 100_000 and got <= want and len(want - got) <= 1e-4 * len(want)
    tag = F.when(F.col("fragment_id") % 4 == 0, "eval").otherwise("train")
    members, found = overlap.cross_split_overlaps(fragments(spark, rows), "fragment_id", "text", tag, **near)
    got = {tuple(sorted((r["eval_id"], r["train_id"]))) for r in overlap.overlap_pairs(members, found).collect()}
    assert got == {(a, b) for a, b in want if (a % 4 == 0) != (b % 4 == 0)}


@pytest.mark.parametrize("kind", ["replace", "insert"])
def test_hot_signatures_are_cut(spark, kind, monkeypatch):
    rows = family(150, kind, seed=3)
    monkeypatch.setattr(neardup, "HOT", 20)
    monkeypatch.setattr(neardup, "COUNTED", 1)
    monkeypatch.setattr(neardup, "PAIRS_A_CELL", 200)
    members, links = neardup.near_duplicate_groups(fragments(spark, rows), "fragment_id", "text", width=3, threshold=0.6, min_words=30, latin_only=True)
    assert {tuple(r) for r in neardup.pairs_of_ids(members, links).collect()} == jaccard_pairs(rows)


def test_overlaps_in_many_shards(spark):
    rows = corpus(seed=6) + [(10_000 + i, t) for i, t in family(40)]
    tag = F.when(F.col("fragment_id") % 4 == 0, "eval").otherwise("train")
    near = {"width": 3, "threshold": 0.6, "min_words": 30}
    one, five = (overlap.cross_split_overlaps(fragments(spark, rows), "fragment_id", "text", tag, **near, a_shard=size)[1] for size in (10**7, 1000))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, five.collect())) and one.count() > 100


def test_equal_texts_are_matched_once(spark, monkeypatch):
    rows = [(1000 * copy + i, t) for copy in range(8) for i, t in family(40)]
    many = fragments(spark, rows).repartitionByRange(8, "fragment_id")  # each copy in a task of its own
    tag = F.when(F.col("fragment_id") % 4 == 0, "eval").otherwise("train")
    near = {"width": 3, "threshold": 0.6, "min_words": 30}
    members, found = overlap.cross_split_overlaps(many, "fragment_id", "text", tag, **near)
    got = {(r["eval_id"], r["train_id"]) for r in overlap.overlap_pairs(members, found).collect()}
    one = {(a, b) if a % 4 == 0 else (b, a) for a, b in jaccard_pairs(rows[:40]) if (a % 4 == 0) != (b % 4 == 0)}
    assert got == {(a + 1000 * x, b + 1000 * y) for a, b in one for x in range(8) for y in range(8)}
    shards = []

    def seen(path, k, threshold, width):
        def run(batches):
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            sets = [s for b in batches for s in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.int64()), pa.array([part] * len(sets), pa.int64()), pa.array([1.0] * len(sets))], names=["set_a", "set_b", "coverage"])

        shards.append(k)
        return run

    monkeypatch.setattr(overlap, "_match", seen)
    _, tasks = overlap.cross_split_overlaps(many, "fragment_id", "text", tag, **near, a_shard=5000)
    assert tasks.count() == 30  # every set in one task
    assert shards == [1]  # 10 records of 300 passages, not 80


def test_least_overlap_follows_the_sizes():
    assert overlap._least(np.array([100, 300, 500]), 300, 0.6).tolist() == [150, 225, 300]
    for n in range(1, 60):
        for m in range(1, 60):
            if min(n, m) >= 0.6 * max(n, m):
                both = next(b for b in range(min(n, m) + 1) if b >= 0.6 * (n + m - b) - 1e-9)
                assert overlap._least(np.array([n]), m, 0.6)[0] == both


def test_automaton_against_search():
    rng = random.Random(4)
    texts = [[rng.randrange(12) for _ in range(rng.randrange(0, 40))] for _ in range(30)]
    flat = lambda ts: (np.array([w for t in ts for w in t], np.uint64), np.cumsum([0, *map(len, ts)]))
    automaton = overlap.Automaton(*flat(texts[:10]), 3)
    grams = lambda t: [tuple(t[k : k + 3]) for k in range(len(t) - 2)]
    known = {g for t in texts[:10] for g in grams(t)}
    text, passage = automaton.scan(*flat(texts[10:]))
    assert automaton.passages == len(known)
    assert text.tolist() == [i for i, t in enumerate(texts[10:]) for g in grams(t) if g in known]
    assert len(set(passage.tolist())) == len({g for t in texts[10:] for g in grams(t)} & known)


def test_signatures_find_similar_sets():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 100, dtype=np.uint64)
        b = np.concatenate((a[:75], rng.integers(0, 2**63, 25, dtype=np.uint64)))  # 60 % of all runs in common
        x, y = (set(neardup.partenum(s, np.array([0])).ravel().tolist()) for s in (a, b))
        missed += not x & y
    assert missed == 0


# 7 --------------------------------------------------------------------------------------------------
PLAIN = "La evaluación de la corrección según el método español midió el análisis estadístico del patrón y la línea después de la observación en la región."


@pytest.mark.parametrize("read_as,true", [("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1251", "utf-8"), ("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp1252", "mac_roman"), ("cp1251", "cp1252")])
def test_round_trip_of_encodings(spark, read_as, true):
    bad = PLAIN.encode(true).decode(read_as, "replace")
    values = [(i, "core", "text", PLAIN + f" Caso {i}. Café ½ más «sí» – fin √2 ≥ 1.") for i in range(60)] + [(100, "core", "text", bad), (101, None, "text", None), (102, "core", "text", "")]
    rows = spark.createDataFrame(values, "id long, source string, field string, value string")
    got = {r["id"]: r["restored"] for r in garble.repair(rows).collect()}
    assert set(got) == {100} and got[100] == PLAIN


def test_lost_characters(spark):
    values = [(i, "core", "text", PLAIN) for i in range(20)] + [(50, "core", "text", PLAIN.replace("ó", "�").replace("é", "�"))]
    rows = spark.createDataFrame(values, "id long, source string, field string, value string")
    found = garble.repair(rows)
    assert [(r["id"], r["chain"]) for r in found.collect()] == [(50, "lossy")]
    assert garble.restore_lost(found, rows).first()["restored"] == PLAIN


# 8 --------------------------------------------------------------------------------------------------
def test_myers_against_dynamic_programming():
    rng = random.Random(2)

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
            row = new
        return min(row)

    for _ in range(200):
        p, t = [rng.randrange(4) for _ in range(rng.randrange(1, 14))], [rng.randrange(4) for _ in range(rng.randrange(0, 30))]
        assert leakage.myers_distance(np.array(p), np.array(t, int)) == least(p, t)
    p, t = np.random.default_rng(1).integers(0, 3, (300, 12)).astype(np.uint64), np.random.default_rng(2).integers(0, 3, (300, 14)).astype(np.uint64)
    assert leakage.myers_distances(p, t).tolist() == [leakage.myers_distance(a, b) for a, b in zip(p, t)]


def test_leaks(spark, monkeypatch):
    rng = random.Random(4)
    lead = "Lea con calma este texto y decida bien ahora mismo por favor si quiere hacerlo."
    body = {i: [rng.choice(WORDS) for _ in range(60)] for i in range(6)}
    items = spark.createDataFrame([(i, (lead + " " if i < 4 else "") + " ".join(w)) for i, w in body.items()] + [(9, None), (10, "corto")], "item_id int, text string")
    broken = " ".join(body[0][5:18])
    broken = broken[:20] + "-\n" + broken[20:]
    docs = [(1, "X " + broken.upper() + " y"), (2, "nada " + " ".join(body[1][3:14]) + " fin"), (3, lead), (4, ", ".join(body[5][10:30])), (5, None), (6, ""), (4, ", ".join(body[5][10:30])), (7, " ".join([*body[2][4:10], "otra", *body[2][11:17]]))]
    got = {(r["doc_id"], r["item_id"]): r for r in leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items).collect()}
    assert {k for k, r in got.items() if r["errors"] == 0} == {k for k, r in got.items() if r["longest_run"] >= 12} == {(1, 0), (4, 5)}
    assert got[7, 2]["errors"] == 1 and got[2, 1]["longest_run"] == 11 and got[4, 5]["longest_run"] == 20
    monkeypatch.setattr(leakage, "MAX_ITEMS", 2)
    monkeypatch.setattr(leakage, "WINDOWS", 3)
    blocks = {(r["doc_id"], r["item_id"]): r for r in leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items).collect()}
    assert blocks == got
    assert leakage.leaked_passages(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", items.limit(0)).count() == 0


# 9 --------------------------------------------------------------------------------------------------
def test_mixing(spark):
    sizes = spark.createDataFrame([(i, "Big Source" if i < 100 else "small", 10) for i in range(110)] + [(500, None, 1000), (0, "Big Source", 10)], "id long, source string, tokens long")
    targets = spark.createDataFrame([(1, "big_source", 0.5, 2, 0.5), (1, "small", 0.3, 3, 0.5), (1, "absent", 0.2, 9, 0.5)], "mix_id int, source string, target_share double, max_repeats int, budget_ratio double")
    selection, report = mixing.mix_sources(sizes, targets)
    assert {r["source"] for r in mixing.mix_report(mixing.token_sums(sizes.dropDuplicates(["id"])), targets).filter("short").collect()} == {"small", "absent"}
    by = {r["source"]: r for r in report.collect()}
    assert by["small"]["short"] and by["absent"]["short"] and not by["big_source"]["short"]
    shares = {r["source"]: r["taken"] for r in mixing.mix_shares(sizes, selection, report).collect()}
    assert shares == {"big_source": 520, "small": 300, "absent": 0}
    assert selection.filter("copies > 3").count() == 0


# 10 -------------------------------------------------------------------------------------------------
def test_subjects_held_out():
    rng = random.Random(6)
    nouns = {a: [f"{a}{i}" for i in range(25)] for a in ("derecho", "fisica", "deporte")}

    def doc(areas):
        s = [f"En la zona el {rng.choice(nouns[rng.choice(areas)])} modifica el {rng.choice(['resto', 'valor', 'caso'])} medido." for _ in range(12)]
        return "Título general\n" + " ".join(s) + "\nReferencias\nPérez, A. (2001). " + nouns["derecho"][0] + " derecho1."

    labels = [[rng.choice(list(nouns))] if rng.random() < 0.8 else sorted(rng.sample(list(nouns), 2)) for _ in range(300)]
    texts = [doc(x) for x in labels]
    model = subjects.fit(texts[:200], [None] * 200, labels[:200], sorted(nouns))
    right = 0
    for t, y in zip(texts[200:], labels[200:]):
        got, other = subjects.subject_sentences(t)
        x = model.features(model.sentence_scores(got), other, None)
        right += [model.areas[a] for a in model.decode(x)] == y
    assert right >= 95
    empty = subjects.fit([], [], [], ["a"])
    assert empty.sentence_scores(["x"]).max() < empty.cutoff


def test_subject_terms_of_two_documents():
    """They count among many labelled documents, too."""
    labels = [["derecho"], ["fisica"], ["deporte"]] * 200
    texts = ["Título\n" + f"En la zona el {y[0]}{k % 25} modifica el valor medido. " * 3 for k, y in enumerate(labels)]
    for k in (1, 4):
        texts[k] += "En la zona el sincrotronio modifica el valor medido."
    model = subjects.fit(texts, [None] * 600, labels, ["deporte", "derecho", "fisica"])
    assert model.sentence_scores(["El sincrotronio."]).max() > 0


# words ----------------------------------------------------------------------------------------------
def test_word_codes():
    texts = ["Él, ÁRBOL\n", "el arbol", None, "", "Straße 12", "第一 句话", "a" * 5000 + " el"]
    got = {i: c.copy() for i, c in word_codes(texts)}
    assert got[0].tolist() == got[1].tolist() and got[2].size == got[3].size == 0 and got[4].size == got[5].size == 2
    assert got[6][1] == got[1][0]
