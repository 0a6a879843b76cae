"""Rhetorical sections and contributions of paragraphs, by rules; all in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern.functions import lexicon, text as tx


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def relative_position(index: Column | str, count: Column | str) -> Column:
    """Place of a paragraph between 0 and 1; the only paragraph is at 0."""
    return _c(index) / F.greatest(_c(count) - 1, F.lit(1))


def zone(position: Column | str) -> Column:
    """Start, middle or end of a document; the fifth at either end belongs to it."""
    p = _c(position)
    return F.when(p <= 0.2, "Inicio (0-20%)").when(p >= 0.8, "Cierre (80-100%)").otherwise("Desarrollo (20-80%)")


#: Sections supposed where no marker is found, by sixths of the document.
DEFAULT_SECTIONS = ["INTRO", "BACK", "METH", "RES", "DISC", "CONC"]


def section(text: Column | str, position: Column | str) -> Column:
    """struct(label, confidence, low): the section whose markers are most frequent, with a bonus for the place."""
    p = _c(position)
    first, last = p <= 0.15, p >= 0.8
    bonus = {"INTRO": F.when(first, 3), "BACK": F.when(first, 2), "CONC": F.when(~first & last, 3), "LIM": F.when(~first & last, 2)}
    score = {k: tx.matches(text, v) + (bonus[k].otherwise(0) if k in bonus else F.lit(0)) for k, v in lexicon.T1_PATTERNS.items()}
    scores = F.array(*[F.struct(score[k].alias("score"), F.lit(-i).alias("rank"), F.lit(k).alias("label")) for i, k in enumerate(lexicon.T1_PRIORITY)])

    def decide(all_: Column) -> Column:
        best = F.array_max(all_)
        total = F.greatest(F.aggregate(all_, F.lit(0), lambda s, x: s + x["score"]), F.lit(1))
        low = best["score"] == 0
        default = F.element_at(F.array(*[F.lit(x) for x in DEFAULT_SECTIONS]), F.least(F.floor(p * 6), F.lit(5)).cast("int") + 1)
        return F.struct(F.when(low, default).otherwise(best["label"]).alias("label"), F.when(low, 0.42).otherwise(F.round(F.least(F.lit(0.95), 0.45 + best["score"] / total * 0.5), 3)).alias("confidence"), low.alias("low"))

    # one-element transform: the scores are computed once, however often they are used
    return F.transform(F.array(scores), decide)[0]


def contribution_hits(text: Column | str) -> Column:
    """How many markers of a contribution a text has."""
    return tx.matches(text, lexicon.T2_PATTERN)


def contribution(text: Column | str) -> Column:
    """struct(is_contribution, confidence) from the number of markers; without any, longer texts are surer."""
    def decide(n: Column) -> Column:
        some = F.least(F.lit(0.95), 0.70 + 0.04 * n)
        none = F.greatest(F.lit(0.48), 0.85 - tx.word_count(text) * 0.0009)
        return F.struct((n > 0).alias("is_contribution"), F.when(n >= 3, some).when(n == 2, 0.80).when(n == 1, 0.65).otherwise(none).alias("confidence"))

    return F.transform(F.array(contribution_hits(text)), decide)[0]


#: Sections in the order in which ties of the threshold rules are settled.
SECTION_ORDER = ["INTRO", "BACK", "METH", "RES", "DISC", "LIM", "CONC"]


def threshold_section(text: Column | str, thresholds: dict[str, int] | None = None, best_first: bool = False, least: int = 2) -> Column:
    """struct(label, count) of the most frequent section among those that reach their threshold; null if none.

    With best_first, the most frequent section is chosen before it is held against ``least``.
    """
    thresholds = thresholds or lexicon.SECTION_THRESHOLDS
    each = [F.struct(tx.matches(text, lexicon.SECTION_PATTERNS[k]).alias("n"), F.lit(-i).alias("rank"), F.lit(k).alias("label"), F.lit(0 if best_first else thresholds.get(k, least)).alias("least")) for i, k in enumerate(SECTION_ORDER)]
    best = F.array_max(F.filter(F.array(*each), lambda x: x["n"] >= x["least"]))
    return F.transform(F.array(best), lambda b: F.when(b["n"] >= (least if best_first else 0), F.struct(b["label"].alias("label"), b["n"].alias("count"))))[0]


def hits(text: Column | str, patterns: list[tuple[str, str]], flags: str = "(?uU)") -> Column:
    """array<struct<label, match>>: the first match of each pattern in lower case, at most 55 characters of it."""
    t = F.lower(_c(text))
    each = [F.struct(F.lit(label).alias("label"), F.regexp_substr(t, F.lit(flags + p)).alias("match")) for p, label in patterns]
    return F.transform(F.filter(F.array(*each), lambda x: x["match"].isNotNull()), lambda x: F.struct(x["label"].alias("label"), F.substring(x["match"], 1, 55).alias("match")))


def contribution_scores(text: Column | str, position: Column | str, heading: Column | str, blocked: frozenset[str] = frozenset()) -> Column:
    """struct of both lists of signs, both scores, and the kind, section and role they make.

    blocked: labels of signs that do not count.  A null position or heading gives no bonus.
    """
    pick = lambda ps: [x for x in ps if x[1] not in blocked]
    p = _c(position)
    place = F.when((p <= 0.15) | (p >= 0.85), 0.20).otherwise(0.0)
    under = F.when(F.coalesce(F.lower(_c(heading)).rlike("|".join(lexicon.HIGH_PRIOR_SECTIONS)), F.lit(False)), 0.15).otherwise(0.0)

    def decide(x: Column) -> Column:
        n, m = F.size(x["e"]), F.size(x["i"])
        exp = F.least(F.lit(1.0), n * 0.35 + F.when(n > 0, 0.2).otherwise(0.0))
        imp = F.least(F.lit(1.0), m * 0.25 + place + under)
        # halves of a hundredth: the sums are compared after rounding
        e, i = F.round(exp, 3), F.round(imp, 3)
        kind = F.when(e >= 0.35, "explicit").when(i >= 0.45, "implicit").when(i >= 0.30, "implicit_weak").otherwise("none")
        label = F.when((e >= 0.35) | (i >= 0.45), "CONTR").otherwise("")
        role = F.when(e >= 0.35, "positive").when(i >= 0.30, "hard_negative").otherwise("negative")
        return F.struct(x["e"].alias("explicit_hits"), x["i"].alias("implicit_hits"), e.alias("score_explicit"), i.alias("score_implicit"), kind.alias("contr_type"), label.alias("tarea1_label"), role.alias("tarea2_role"))

    both = F.struct(hits(text, pick(lexicon.EXPLICIT_PATTERNS)).alias("e"), hits(text, pick(lexicon.IMPLICIT_PATTERNS)).alias("i"))
    return F.transform(F.array(both), decide)[0]
