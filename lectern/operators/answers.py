"""Reading answers of language models, and writing what they are asked."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions import lexicon, prompts

#: Sections a model may name.
SECTIONS = ["INTRO", "BACK", "METH", "RES", "DISC", "LIM", "CONC"]


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def yes_no(answer: Column | str) -> Column:
    """1 where the answer begins with yes in Spanish or English, else 0; null is 0."""
    return F.when(F.lower(F.trim(answer)).rlike("^(si|sí|yes)"), 1).otherwise(0)


def section_label(answer: Column | str) -> Column:
    """The section an answer names: by its JSON field ``category``, else by the longest name that stands in it.

    Contributions, blank answers and answers that name none are UNKNOWN.
    """
    up = F.upper(F.trim(answer))
    names = F.create_map(*[F.lit(x) for k, v in lexicon.ANSWER_LABELS.items() for x in (k, v)])
    field = F.try_element_at(names, F.upper(F.trim(F.when(up.startswith("{"), F.get_json_object(answer, "$.category")))))
    found = None
    for n in sorted(lexicon.ANSWER_LABELS, key=len, reverse=True):
        hit = up.rlike(rf"(?U)\b{n}\b")
        found = F.when(hit, lexicon.ANSWER_LABELS[n]) if found is None else found.when(hit, lexicon.ANSWER_LABELS[n])
    label = F.coalesce(field, found)
    return F.when(label.isin(*SECTIONS), label).otherwise("UNKNOWN")


def first_label(answer: Column | str, labels: list[str]) -> Column:
    """The first of the labels, in their order, that stands anywhere in the answer; null if none."""
    return F.coalesce(*[F.when(F.contains(F.upper(answer), F.lit(k)), k) for k in labels])


def context_prefix(label: Column | str, position: Column | str, text: Column | str) -> Column:
    """``[SECCION:X] [POS:p] text``, unknown sections as UNK, the position to one decimal from 0.0 to 0.9."""
    name = F.upper(F.trim(label))
    p = F.least(F.lit(0.9), F.rint(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(_c(position), F.lit(0.5)))) * 10) / 10)
    return F.concat(F.lit("[SECCION:"), F.when(name.isin(*SECTIONS), name).otherwise("UNK"), F.lit("] [POS:"), F.format_string("%.1f", p), F.lit("] "), _c(text))


def percent(c: Column) -> Column:
    """A share as a whole percentage, halves to even, as text."""
    return F.rint(c * 100).cast("int").cast("string")


#: The messages of the four kinds of model, with places for section, its confidence, zone and the model's confidence.
MESSAGES = {
    "heuristic": "Contribucion detectada en seccion '{name}' ({section}% conf. retorica) | {zone}",
    "encoder": "Contribucion detectada (conf. {model}%) en seccion '{name}' ({section}% conf. retorica) | {zone}",
    "llm": "Contribución detectada en sección '{name}' ({section}% conf. retórica) · {zone}",
    "local": "Contribución en '{name}' ({section}%) | {zone}",
}


def context_message(kind: str, name: Column, section: Column, zone: Column, model: Column | None = None) -> Column:
    """One of ``MESSAGES`` with its places filled; null where a filled value is null."""
    fill = {"name": name, "section": percent(section), "zone": zone, "model": percent(model) if model is not None else F.lit("")}
    parts, rest = [], MESSAGES[kind]
    while "{" in rest:
        head, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        parts += [F.lit(head), fill[key]]
    return F.concat(*parts, F.lit(rest))


def prompt(text: Column | str, task: str, examples: bool = True, as_json: bool = False, most: int | None = None) -> Column:
    """array<struct<role, content>>: instruction, examples, and last the text in question, without its label.

    task: ``section`` or ``yes_no``.  The examples are constants of the query, equal for all rows; most: characters of
    the text that are asked (the whole text if none).
    """
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    head, tail = prompts.QUESTION[task]
    asked = F.concat(F.lit(head), _c(text) if most is None else F.left(_c(text), F.lit(most)), F.lit(tail))
    return F.array(*[turn(role, F.lit(content)) for role, content in prompts.opening(task, examples, as_json)], turn("user", asked))


def escape_html(text: Column | str) -> Column:
    """&, < and > as entities."""
    t = F.replace(_c(text), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
