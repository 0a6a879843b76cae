"""Cutting documents into paragraphs and snippets, and telling text from noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lectern.functions import lexicon, text as tx


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_internal(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.select([c for c in df.columns if not c.startswith("_")])


def is_formal(text: Column | str) -> Column:
    """At least two academic words in the first 2,000 characters."""
    head = F.lower(F.substring(text, 1, 2000))
    hits = [F.contains(head, F.lit(a)).cast("int") for a in lexicon.ACADEMIC_ANCHORS]
    return sum(hits[1:], hits[0]) >= 2


def is_clean(text: Column | str) -> Column:
    """Not empty, at most 15 % of words with digits, not many short lines, not all marks of a bibliography."""
    words, lines = tx.words(text), F.size(F.split(text, "\n", -1))
    n = F.size(words)
    digits = F.size(F.filter(words, lambda w: w.rlike("[0-9]")))
    marks = [F.contains(F.lower(text), F.lit(m)).cast("int") for m in lexicon.BIBLIOGRAPHY_MARKS]
    return (n > 0) & (digits <= 0.15 * n) & ~((lines > 20) & (n / lines < 10)) & ~(sum(marks[1:], marks[0]) > 5)


def frontmatter_score(text: Column | str) -> Column:
    """How many signs of front matter stand in the first 30 % (the whole, up to 200 characters)."""
    text = _c(text)
    head = F.when(F.length(text) > 200, F.substring(text, F.lit(1), F.floor(F.length(text) * 0.3).cast("int"))).otherwise(text)
    hits = [F.coalesce(head.rlike(p), F.lit(False)).cast("int") for p in lexicon.FRONTMATTER_PATTERNS]
    return sum(hits[1:], hits[0])


def noise_class(df: DataFrame, doc: str, order: list[str], text: str) -> DataFrame:
    """df with ``noise``: header, biblio, frontmatter, short or null, in the order of each document.

    Once a bibliography begins, all that follows in the document belongs to it; the first paragraph of it
    is the only state, so a running maximum takes the place of the sequential scan.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")), F.lit(" \n\t\r"))
    heading, reference = t.rlike(lexicon.BIBLIOGRAPHY_HEADING), t.rlike(lexicon.NUMBERED_REFERENCE)
    before = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.regexp_count(t, F.lit(r"\S+"))
    df = df.withColumn("_t", t).withColumn("_start", (heading | reference).cast("int")).withColumn("_in", F.coalesce(F.max("_start").over(before), F.lit(0)))
    noise = (
        F.when(t == "", "short").when(F.col("_in") == 1, "biblio").when(heading, "header").when(reference, "biblio").when(t.rlike(lexicon.FRONT_LINE), "frontmatter")
        .when((n < 15) & ~t.rlike(r"[.!?…]\s*$"), "header").when(n < 15, "short")
    )
    return df.withColumn("noise", noise).drop("_t", "_start", "_in")


# paragraphs ---------------------------------------------------------------------------------------
_GROUP = "struct<cur:array<string>,wc:int,out:array<string>>"


def _closed(g: Column) -> Column:
    return F.when(F.size(g["cur"]) > 0, F.concat(g["out"], F.array(F.array_join(g["cur"], " ")))).otherwise(g["out"])


def _empty(out: Column) -> Column:
    return F.struct(F.array().cast("array<string>").alias("cur"), F.lit(0).alias("wc"), out.alias("out"))


def _add(g: Column, item: Column, flush: Column, least: int) -> Column:
    """The group with one more item; closed if ``flush`` or long enough."""
    cur, wc = F.concat(g["cur"], F.array(item)), g["wc"] + tx.word_count(item)
    full = F.struct(cur.alias("cur"), wc.alias("wc"), g["out"].alias("out"))
    return F.when(flush | (wc >= least), _empty(_closed(full))).otherwise(full)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(" \n\t\r"))), lambda x: x != "")


def paragraphs(text: Column | str, capitals: str = "A-ZAEIOUÜN", peel: bool = False, least: int = 25) -> Column:
    """The paragraphs of a text, at least one.

    Blank lines part them where there are any; else lines are gathered to ``least`` words, with short lines
    that begin with one of ``capitals`` as headings of their own; else sentences are gathered.  With
    ``peel``, a first line of up to six words is a paragraph of its own.
    """
    text = F.coalesce(_c(text), F.lit(""))
    trim = lambda x: F.trim(x, F.lit(" \n\t\r"))
    blocks = F.filter(F.transform(F.split(text, r"\n{2,}", -1), trim), lambda x: x != "")
    if peel:
        def pieces(b: Column) -> Column:
            lines = _lines(b)
            first = F.get(lines, F.lit(0))
            short = (F.size(lines) > 1) & (tx.word_count(first) <= 6)
            return F.when(short, F.array(first, F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1))), " "))).otherwise(F.array(F.replace(b, F.lit("\n"), F.lit(" "))))

        doubled = F.flatten(F.transform(blocks, pieces))
    else:
        doubled = blocks
    lines = _lines(text)

    def by_line(g: Column, line: Column) -> Column:
        header = (tx.word_count(line) <= 5) & line.rlike(f"^[{capitals}]")
        g = F.when(header, _empty(_closed(g))).otherwise(g)
        return _add(g, line, header, least)

    start = _empty(F.array().cast("array<string>"))
    lined = F.aggregate(lines, start, by_line, _closed)
    sentences = F.split(text, r"(?<=[.!?])\s+", -1)
    grouped = F.filter(F.aggregate(sentences, start, lambda g, s: _add(g, s, F.lit(False), least), _closed), lambda x: F.trim(x) != "")
    grouped = F.when(F.size(grouped) > 0, grouped).otherwise(F.array(text))
    return F.when(F.size(blocks) > 1, doubled).when(F.size(lines) > 3, lined).otherwise(grouped)


def word_windows(text: Column | str, min_words: int, max_words: int, line_words: int = 5) -> Column:
    """Snippets of min_words to max_words, gathered from lines of at least line_words words.

    A line above max_words is a snippet by itself, cut to max_words; what was gathered before it is kept
    only if long enough.
    """
    lines = F.filter(F.split(F.coalesce(_c(text), F.lit("")), "\n", -1), lambda x: tx.word_count(x) >= line_words)
    emit = lambda g: F.when(g["wc"] >= min_words, F.concat(g["out"], F.array(F.trim(F.array_join(g["cur"], " "))))).otherwise(g["out"])

    def step(g: Column, line: Column) -> Column:
        n = tx.word_count(line)
        cut = F.array_join(F.slice(tx.words(line), 1, max_words), " ")
        more = F.struct(F.concat(g["cur"], F.array(line)).alias("cur"), (g["wc"] + n).alias("wc"), g["out"].alias("out"))
        alone = _empty(F.concat(emit(g), F.array(cut)))
        fresh = F.struct(F.array(line).alias("cur"), n.alias("wc"), emit(g).alias("out"))
        return F.when(g["wc"] + n <= max_words, more).when(n > max_words, alone).otherwise(fresh)

    return F.aggregate(lines, _empty(F.array().cast("array<string>")), step, lambda g: F.when(g["wc"] <= max_words, emit(g)).otherwise(g["out"]))


def char_offsets(text: Column | str, parts: Column) -> Column:
    """(start, end) of each part, searched from the end of the one before; where it isn't found, it starts there."""
    text = _c(text)

    def step(g: Column, part: Column) -> Column:
        at = F.position(part, text, g["at"] + 1) - 1
        start = F.when((at >= 0) & (part != ""), at).otherwise(g["at"])
        end = start + F.length(part)
        return F.struct(end.alias("at"), F.concat(g["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), step, lambda g: g["out"])
