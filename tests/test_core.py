"""Golden values and edge cases of the core operators."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import lexicon, text as tx
from lectern.operators import answers, cleaning, evaluation as ev, inference, layout, mining, rhetoric as rh, sampling as sp, segmentation as sg, statistics as st
from lectern.operators.tables import union_common
from lectern.sources import readers
from lectern.streaming.rate_limit import decide, decide_batch


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_prefix_bins(spark):
    cases = {0.0: "0.0", 0.05: "0.0", 0.1: "0.1", 0.4: "0.4", 0.9: "0.9", 0.95: "0.9", 1.0: "0.9", -0.1: "0.0", 2.0: "0.9"}
    rows = spark.createDataFrame([(p, e) for p, e in cases.items()], "p double, e string").withColumn("t", answers.context_prefix(F.lit("intro"), "p", F.lit("x"))).collect()
    assert all(r["t"] == f"[SECCION:INTRO] [POS:{r['e']}] x" for r in rows)
    for label in ("FOO", "CONTR", "", "intro_long", "unknown"):
        assert one(spark, answers.context_prefix("l", F.lit(None).cast("double"), F.lit("x")), l=label) == "[SECCION:UNK] [POS:0.5] x"


def test_yes_no(spark):
    for answer, want in {"SI": 1, "Sí": 1, "Si.": 1, "si, claramente": 1, " YES ": 1, "NO": 0, "Maybe": 0, "": 0, "siempre": 1}.items():
        assert one(spark, answers.yes_no("a"), a=answer) == want
    assert one(spark, answers.yes_no("a"), a=None) == 0


def test_section_label(spark):
    for answer, want in {"INTRO": "INTRO", "Introducción": "INTRO", '{"category": "Metodología"}': "METH", "CONTR": "UNKNOWN", "Contribución": "UNKNOWN", "": "UNKNOWN", "no sé": "UNKNOWN", "La categoría es METH.": "METH"}.items():
        assert one(spark, answers.section_label("a"), a=answer) == want, answer
    assert one(spark, answers.section_label("a"), a=None) == "UNKNOWN"


def test_agreement_golden(spark):
    pairs = [(1, 1)] * 81 + [(0, 0)] * 89 + [(1, 0)] * 15 + [(0, 1)] * 15
    r = ev.agreement(spark.createDataFrame(pairs, "a int, b int"), "a", "b").first()
    assert (r["n"], r["same"]) == (200, 170) and round(r["kappa"], 4) == 0.6995 and round(r["alpha"], 4) == 0.6995
    empty = ev.agreement(spark.createDataFrame([], "a int, b int"), "a", "b").first()
    assert empty["n"] == 0 and empty["kappa"] == 0 and empty["alpha"] == 0
    same = ev.agreement(spark.createDataFrame([(1, 1)] * 3, "a int, b int"), "a", "b").first()
    assert same["kappa"] == 1 and same["alpha"] == 1


def test_paragraphs(spark):
    assert one(spark, sg.paragraphs("t"), t="uno\n\ndos\n\n\ntres") == ["uno", "dos", "tres"]
    lined = "Título\n" + "palabra " * 13 + "\n" + "otra " * 13 + "\nresto final de texto que no llega a nada"
    got = one(spark, sg.paragraphs("t"), t=lined)
    assert got[0] == "Título" and len(got) == 3
    assert one(spark, sg.paragraphs("t"), t="") == [""]
    assert one(spark, sg.paragraphs("t", "A-ZÁÉÍÓÚÜÑ", True), t="Cabeza\nuno dos\n\notro") == ["Cabeza", "uno dos", "otro"]


def test_word_windows(spark):
    line = " ".join(["w"] * 10)
    assert one(spark, sg.word_windows("t", 20, 25), t="\n".join([line] * 5)) == [f"{line} {line}", f"{line} {line}"]
    long = one(spark, sg.word_windows("t", 20, 25), t="a b\n" + " ".join(["v"] * 40))
    assert long == [" ".join(["v"] * 25)]
    assert one(spark, sg.word_windows("t", 20, 25), t=None) == []


def test_char_offsets(spark):
    got = one(spark, sg.char_offsets("t", F.array(F.lit("ab"), F.lit("zz"), F.lit("ab"))), t="ab cd ab")
    assert [(x["start"], x["end"]) for x in got] == [(0, 2), (2, 4), (6, 8)]


def test_noise_is_sticky(spark):
    rows = spark.createDataFrame([(1, 0, "Un párrafo del cuerpo con bastantes palabras para que no sea corto ni encabezado de nada, claro."), (1, 1, "REFERENCIAS"), (1, 2, "Texto largo que sigue"), (2, 0, None), (2, 1, "DOI: 10.1")], "d int, i int, t string")
    got = {(r["d"], r["i"]): r["noise"] for r in sg.noise_class(rows, "d", ["i"], "t").collect()}
    assert got == {(1, 0): None, (1, 1): "header", (1, 2): "biblio", (2, 0): "short", (2, 1): "frontmatter"}


def test_section_rules(spark):
    x = one(spark, rh.section("t", F.lit(0.0)), t="nada")
    assert x["label"] == "INTRO" and not x["low"]
    y = one(spark, rh.section("t", F.lit(0.5)), t="nada")
    assert y["label"] == "RES" and y["confidence"] == 0.42 and y["low"]
    z = one(spark, rh.section("t", F.lit(0.5)), t="La metodología y la muestra; el análisis estadístico")
    assert z["label"] == "METH"


def test_contribution_rules(spark):
    assert one(spark, rh.contribution("t"), t="Proponemos un nuevo enfoque")["confidence"] == 0.80
    x = one(spark, rh.contribution_scores("t", F.lit(0.5), F.lit(None).cast("string")), t="Aquí proponemos algo")
    assert x["contr_type"] == "explicit" and x["score_explicit"] == 0.55 and x["tarea2_role"] == "positive"
    weak = one(spark, rh.contribution_scores("t", F.lit(0.0), F.lit("Conclusiones")), t="nada")
    assert weak["contr_type"] == "implicit_weak" and weak["score_implicit"] == 0.35
    blocked = one(spark, rh.contribution_scores("t", F.lit(0.5), F.lit(""), frozenset({"B02-1PL"})), t="proponemos algo")
    assert blocked["contr_type"] == "none"


def test_masks(spark):
    assert one(spark, cleaning.soft_mask("t"), t="Los  Resultados y la metodología") == "Los [MASK] y la [MASK]"
    assert one(spark, cleaning.mask("t", F.array(F.lit("a.b"), F.lit("a"))), t="A a.b x") == "[MASK] [MASK] x"
    assert one(spark, cleaning.mask_listed("t", F.lit(None).cast("string")), t="x  y") == "x  y"


def test_sentences(spark):
    assert one(spark, cleaning.sentences("t"), t="El Dr. Pérez vino.Luego habló. ¿Sí? Fin") == ["El Dr. Pérez vino.", "Luego habló.", "¿Sí?", "Fin"]
    assert one(spark, cleaning.sentences("t"), t=None) == []


def test_windows_of_sentences():
    s = ["a b c d e."] * 6
    assert mining.windows_of(s, 10, 20, 1) == [(0, 2, 10), (1, 3, 10), (2, 4, 10), (3, 5, 10), (4, 6, 10)]
    assert mining.windows_of(["a"], 10, 20, 2) == []


def test_windows_go_by_words_and_full_stops():
    s = ["a b c d.", "e f", "g h i j k l m n", "o p.", "q r s t.", "u."]
    assert mining.windows_of(s, 5, 12, 1) == [(0, 3, 14), (2, 4, 10), (3, 5, 6), (4, 6, 5)]
    assert mining.windows_of([], 5, 12, 1) == [] and mining.windows_of(["a " * 30], 5, 12, 2) == [(0, 1, 30)]
    assert mining.windows_of(["", "a.", "b."], 0, 5, 0)[0] == (0, 2, 1)


def test_fragments_of_a_document(spark):
    body = " ".join(f"Palabra {k} de la frase que sigue con otras voces distintas." for k in range(40))
    rows = spark.createDataFrame([(1, "Un título breve\n" + body), (2, None), (3, "corto.")], "id int, t string")
    got = mining.sliding_fragments(rows, "id", "t", min_words=60, max_words=100).orderBy("idx").collect()
    assert {r["id"] for r in got} == {1} and got[0]["char_start"] == 0 and got[0]["section_hint"] == "unknown"
    assert all(r["word_count"] == len(r["text"].split()) >= 60 and r["section_hint"] == "Un título breve" for r in got[1:3])


def test_labelled_snippets_stop_when_all_sections_are_full(spark, monkeypatch):
    line = "La metodología y la muestra con el análisis estadístico y el diseño experimental del estudio"
    rows = spark.createDataFrame([(i, "\n".join([line] * (20 + i))) for i in range(4)], "id int, t string")
    got = mining.labelled_snippets(rows, "id", "t", 2).orderBy("id").collect()
    assert [r["id"] for r in got] == [0, 1, 2, 3] and {r["category"] for r in got} == {"METH"} and all(r["word_count"] >= 250 and r["idx"] == 0 for r in got)
    monkeypatch.setattr(rh, "SECTION_ORDER", ["METH"])
    assert [r["id"] for r in mining.labelled_snippets(rows, "id", "t", 2).orderBy("id").collect()] == [0, 1]
    monkeypatch.undo()
    found = mining.labelled_snippets(spark.createDataFrame([(1, None), (2, "nada")], "id int, t string"), "id", "t", 5)
    assert found.count() == 0


def test_prompt_holds_examples_and_the_whole_text_last(spark):
    text = "Un texto " + "largo " * 1000
    turns = one(spark, answers.prompt("t", "yes_no"), t=text)
    assert [x["role"] for x in turns] == ["system", *["user", "assistant"] * 8, "user"]
    assert turns[-1]["content"] == f"Fragmento:\n{text}\n\nRespuesta:" and [x["content"] for x in turns[2::2]] == ["SI", "NO"] * 4
    short = one(spark, answers.prompt("t", "yes_no", examples=False, most=10), t=text)
    assert len(short) == 2 and short[1]["content"] == "Fragmento:\nUn texto l\n\nRespuesta:"
    section = one(spark, answers.prompt("t", "section", as_json=True), t="x")
    assert len(section) == 2 and section[0]["content"].count("Categoría: ") == 14 and section[0]["content"].endswith('{"category": "SIGLA"}') and section[1]["content"] == 'Fragmento: "x"'


def test_truncation_takes_the_first_of_the_rows_own_keywords(spark):
    words = [f"p{i}" for i in range(1000)]
    words[100], words[800] = "beta", "Alfa"
    cut = lambda *keys: one(spark, cleaning.truncate_around("t", F.lit(7), F.array(*[F.lit(k) for k in keys]).cast("array<string>")), t=" ".join(words)).split()
    assert "Alfa" in cut("no", "alfa", "beta") and "beta" not in cut("no", "alfa", "beta") and "beta" in cut("beta", "alfa")
    assert cut("no")[0] == "p0" and cut()[0] == "p0" and 80 <= len(cut("alfa")) <= 400
    assert one(spark, cleaning.truncate_around("t", F.lit(7), F.array(F.lit("a"))), t="a b") == "a b"


def test_bootstrap_follows_the_rows(spark):
    rows = spark.createDataFrame([(int(i % 3 == 0), int(i % 4 == 0)) for i in range(240)], "y int, p int")
    r, point = ev.bootstrap_f1(rows, "y", "p").first(), ev.binary_macro_f1(rows, "y", "p").first()["macro_f1"]
    assert r["samples"] == 1000 and abs(r["mean"] - point) < 0.01 and r["low"] < point < r["high"] and 0.02 < r["std"] < 0.05
    assert ev.bootstrap_f1(rows.limit(0), "y", "p").first()["samples"] == 0


def test_running_order_is_that_of_one_sort(spark):
    df = spark.range(500).withColumn("n", F.col("id") % 7)
    got = {r["id"]: r["_through"] for r in sp.running(df, "id", 3, F.col("n")).collect()}
    total = 0
    for r in df.orderBy(*sp.draw_order(3, "id")).collect():
        total += r["n"]
        assert got[r["id"]] == total


def test_until_reached(spark):
    rows = spark.createDataFrame([(d, k) for d in "abcdef" for k in (0, 1)], "d string, k int")
    found = lambda a, b: sorted(r["d"] for r in sp.until_reached(rows, "d", {"x": (F.col("k") == 0, a), "y": (F.col("k") == 1, b)}).collect())
    assert found(2, 3) == ["a", "b", "c"] and found(2, 99) == list("abcdef")


def test_catalog(monkeypatch):
    catalog = [inference.Entry("heuristic", "Reglas", "heuristic"), inference.Entry("gpt", "GPT", "llm_api", key="SOME_TEST_KEY")]
    assert inference.resolve("gpt", catalog)[1:] == ("heuristic", "GPT [fallback heuristico]")
    monkeypatch.setenv("SOME_TEST_KEY", "x")
    assert inference.resolve("gpt", catalog)[1:] == ("llm_api", "GPT")
    with pytest.raises(KeyError):
        inference.resolve("no", catalog)


def test_files_that_are_no_office_files(spark):
    assert [readers.extract_doc(x)[1] for x in (b"", b"text", bytes(readers.MOST_BYTES + 1))] == [400, 400, 413]
    files = spark.createDataFrame([("a", b"no"), ("b", None)], "path string, content binary")
    assert readers.xlsx_sheets(files, ["x"]).count() == 0


def test_paragraphs_in_sql_are_the_same(spark):
    from lectern.functions.registered import register

    register(spark)
    texts = ["a\n\nb", "A\nuna línea\n" * 6, "Uno. Dos. " * 30, "", None, "  \n ", "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] for r in rows.select(F.expr("split_paragraphs(t)") == sg.paragraphs("t")).collect())


def test_rate_limit(spark):
    from collections import deque

    assert [x[1] for x in decide([0, 1, 2, 3], [1, 2, 3, 4], deque(), 2, 10)] == [True, True, False, False]
    assert [x[1] for x in decide([0, 1, 11], [1, 2, 3], deque(), 2, 10)] == [True, True, True]
    rows = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 1.0), ("k", 3, 2.0), ("j", 4, 2.0), (None, 5, 1.0)], "key string, id long, at double")
    got = {r["id"]: (r["allowed"], r["retry_after"]) for r in decide_batch(rows, 2, 10.0).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (False, 8), 4: (True, 0)}


def test_largest_remainder(spark):
    rows = spark.createDataFrame([("d", k, 1) for k in "abc"], "g string, l string, n int")
    got = {r["l"]: r["pct"] for r in st.whole_percentages(rows, "g", "l", "n").collect()}
    assert got == {"a": 34, "b": 33, "c": 33}


def test_mann_whitney(spark):
    rows = spark.createDataFrame([(True, float(x)) for x in (1, 2, 3)] + [(False, float(x)) for x in (4, 5, 6)], "p boolean, x double")
    r = st.mann_whitney(rows, "p", "x").first()
    assert r["u"] == 0 and abs(r["p_value"] - 0.0809) < 0.001


def test_samples_are_exact(spark):
    df = spark.range(100).withColumn("z", (F.col("id") % 3).cast("string"))
    assert sp.uniform(df, "id", 10, 1).count() == 10 and sp.uniform(df, "id", 1000, 1).count() == 100
    assert sp.stratified(df, "z", "id", 30, 1).groupBy("z").count().count() == 3
    assert sp.fraction(df, "id", 0.4, 1).filter("chosen").count() == 40
    assert sp.split_keys(df, "id", 0.15, 1, ("a", "b")).filter("split = 'b'").count() == 15


def test_union_common(spark):
    a, b = spark.createDataFrame([(1, "x", 2)], "a int, b string, c int"), spark.createDataFrame([("y", 3)], "b string, ` a ` int")
    assert {tuple(r) for r in union_common(a, b).collect()} == {(1, "x"), (3, "y")}


def test_model_interface(spark):
    rows = spark.createDataFrame([(1, "Los resultados y hallazgos"), (2, None)], "id int, t string")
    got = {r["id"]: r for r in inference.classify(rows, "id", "t", inference.RuleModel).collect()}
    assert got[1]["label"] == "RES" and len(got[1]["alternatives"]) == 3 and abs(sum(got[2]["all_probs"].values()) - 1) < 0.01

    class Broken:
        def complete(self, prompt):
            raise RuntimeError

    bad = inference.ask(rows, "id", "t", Broken, "section", retries=1, at_once=2).collect()
    assert all(r["label"] == "ERROR" and r["confidence"] == 0.5 for r in bad)


def test_layout():
    import numpy as np
    import pandas as pd

    x = np.array([50.0] * 10 + [320.0] * 10)
    assert layout.column_count(x, 595) == 2 and layout.column_count(x[:3], 595) == 1
    items = pd.DataFrame({"text": ["uno-", "dos", "tres"], "x": 50.0, "y": [700.0, 688.0, 600.0], "height": 10.0, "page_width": 595.0, "page_height": 842.0})
    assert layout.page_text(items) == (1, "unodos\n\ntres")


def test_page_columns_are_those_of_pages(spark):
    import random

    rng, rows = random.Random(3), []
    for page in range(60):
        edges = [rng.choice([50.0, 60.0, 200.0, 320.0, 330.5, 430.0, 600.0]) for _ in range(rng.randrange(1, 4))]
        for k in range(rng.randrange(1, 40)):
            text = rng.choice(["largo texto", "uno", "\u00a0dos\u3000", "cuatro", " \u2003 ", "", None, "\x1fabcd\x85"])
            rows.append((page // 7, page, k, text, rng.choice(edges) + rng.choice([0.0, 0.0, 1.25]), rng.uniform(0, 842), 10.0, 595.0, 842.0))
    items = spark.createDataFrame(rows, "doc_id long, page int, item int, text string, x double, y double, height double, page_width double, page_height double")
    want = {(r["doc_id"], r["page"]): r["columns"] for r in layout.pages(items).collect()}
    got = {(r["doc_id"], r["page"]): r["columns"] for r in layout.page_columns(items).collect()}
    assert got == want and len(want) == 60 and set(want.values()) == {1, 2, 3}


def test_items_split_a_text_once(spark, tmp_path):
    from lectern.plans import layout as plans

    spark.createDataFrame([(1, "uno dos tres\ncuatro  cinco"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = plans._items(spark, str(tmp_path))
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" in plan and not any("split(" in x.split("lambdafunction", 1)[1] for x in plan.splitlines() if "lambdafunction" in x)
    assert [(r["doc_id"], r["item"], r["text"]) for r in items.orderBy("doc_id", "item").collect()] == [(1, 0, "uno dos tres"), (1, 1, "cuatro cinco"), (2, 0, None)]


def test_lexicon_sizes():
    assert (len(lexicon.T1_PATTERNS), len(lexicon.EXPLICIT_PATTERNS), len(lexicon.IMPLICIT_PATTERNS), len(lexicon.INJECTION_PHRASES), len(lexicon.FRONTMATTER_PATTERNS)) == (8, 20, 10, 20, 12)


def test_word_counts(spark):
    assert one(spark, tx.word_count("t"), t=" uno  dos\tañejo ") == 3
    assert one(spark, tx.word_count("t"), t=None) == 0
