"""Sentence units of texts in many languages and scripts, by cascading segmentation rules.

A rule is a pair of regular expressions, for what stands before and after a position, and says break
or no break.  Tables of rules follow one another: those every language shares, then those of the language (of the
text for Latin letters, else of the script the position stands in), then defaults.  The first rule that matches decides.  Positions are
those after an end mark (with its closing marks), after a line, and in scripts that have no end
mark, after a space between two words of the script.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UNITS = "id long, unit_index int, end_pos int, unit string"

#: Abbreviations no sentence ends with, by language.
ABBREVIATIONS = {
    "es": "Dr Dra Dres Sr Sra Srta Sres Prof Profa Lic Ing Arq Mtro Mtra Fig Figs Ec Ecs Tab Tabs cf cfr p pp pág págs vol vols núm núms s ss aprox ej al vid véase op cit ibíd ca Cía D Dña Ud Uds Vd tel av Avda EE RR FF máx mín prom gral Gral Cap Cmdte",
    "en": "Mr Mrs Ms Dr Drs Prof St Sts Rev Hon Gen Col Capt Lt Sgt Jr vs viz cf fig figs eq eqs eqn vol vols p pp approx ca al i.e e.g Inc Ltd Dept Univ Gov Sen Rep",
    "pt": "Dr Dra Sr Sra Srta Prof Profa Eng fig figs cf p pp pág págs vol vols núm nº aprox ex al obs",
    "fr": "M MM Mme Mmes Mlle Dr Pr Me fig figs tab éq cf p pp vol vols n art éd chap env al av apr ex",
    "de": "Dr Prof Hr Fr Nr Abb Tab Gl vgl bzw ca z.B d.h u.a S Bd Hrsg usw Kap",
    "ru": "г гг см рис табл стр с т е п пп ст ч др проф акад им ул напр тыс млн млрд руб вып ред изд кн гл прим ср",
    "el": "κ κα κος δηλ π.χ βλ σελ αρ εικ πιν κεφ τ μ.Χ π.Χ αι",
    "ar": "د أ م ص ج أ.د",
    "hi": "डॉ प्रो श्री कु पं सं पृ",
    "th": "ดร ศ รศ ผศ นาย พ.ศ ค.ศ น.ส",
}
#: Closed-class words of the languages in Latin letters.  They tell the language of a text, a capital one after an
#: abbreviation begins a sentence, and no heading begins or ends with one.
CLOSED = {
    "es": "el la los las lo un una unos unas de del al a ante con contra desde durante en entre hacia hasta para por según sin sobre tras y e o u ni que se su sus no cada si como cuando pero pues aunque este esta estos estas ese esa es son fue hubo muy más también porque donde",
    "en": "the a an of to in for with by from between among into through during against about over under after before and or but nor neither either both some any each every all no not that this these those which who it its we our they their he she his her is are was were be been has have had at on as if when while because however there here such",
    "pt": "o os as um uma uns umas de do da dos das no na nos nas ao aos em para por com sem sobre entre e ou nem mas que se seu sua não como quando foi são é muito mais também este esta esse essa pelo pela",
    "fr": "le la les un une des du de au aux et ou ni mais dans en sur sous par pour avec sans entre que qui dont où se ce cet cette ces son sa ses leur il elle ils elles on nous est sont été ne pas plus comme si chaque",
    "de": "der die das den dem des ein eine einer einem einen und oder aber nicht in im an am auf aus bei mit nach von vom zu zum zur für über unter durch als wie wenn dass sich es er sie wir ist sind war wurde wurden auch noch nur",
}
_KNOWN = {k: frozenset(v.split()) for k, v in CLOSED.items()}
_BOUND = frozenset().union(*_KNOWN.values())
_WORD = re.compile(r"[^\W\d_]+")


def language(text: str) -> str:
    """The language in Latin letters whose closed-class words are most frequent in the whole text; Spanish if none are."""
    counts = Counter(_WORD.findall(text.lower()))
    return max(_KNOWN, key=lambda k: sum(n for w, n in counts.items() if w in _KNOWN[k]))


#: Abbreviations that only go on before a number, a bracket or a small letter.
NUMERIC = "no nos núm num fig figs tab ec eq vol p pp pág art arts cap caps sec séc ed eds n nº ch chap"
_UPPER_INITIAL = r"(?:^|[\s(«“\"'‘\[—–-])[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω]"
_OPEN = r"[«“\"'‘(\[¿¡„‹—–-]"
_SMALL = r"[a-zß-öø-ÿа-яёα-ωά-ώāăąćčďđēęěğīłńňōőŕřśşšťūůűźżž]"
_MIXED = rf"{_SMALL}{{1,2}}[A-Z]"
_CLOSE = r"[»”’\"')\]」』》›】）]"

Rule = tuple[bool, re.Pattern, re.Pattern]


def _rule(is_break: bool, before: str, after: str = "") -> Rule:
    return is_break, re.compile(f"(?:{before})$"), re.compile(after)


def _any(words: str) -> str:
    return "|".join(sorted((re.escape(w) for w in words.split()), key=len, reverse=True))


_WORD_START = r"(?:^|[\s(«“\"'‘\[/—–-])"
#: What holds in every language.  Patterns see what stands before a position from the unit's start on.
COMMON: list[Rule] = [
    _rule(False, r"^\W*\d{1,3}(?:\.\d{1,3})*\.", r"[ \t]"),  # the number of a heading or list item
    _rule(False, r"^\W*(?:[IVXLC]{1,5}|[A-Za-z])[.)]", r"[ \t]+\S"),
    _rule(False, r"[…]|\.\.\.", rf"\s+{_OPEN}*{_SMALL}(?![A-Z])"),
    _rule(True, r"[!?؟]" + _CLOSE + "*", rf"\s+(?:{_MIXED})"),
    _rule(True, r"\.", rf"\s+(?:{_MIXED})"),
    _rule(True, r"(?:[a-zß-öø-ÿа-яёα-ωά-ώ]{3}|\d)[.!?]" + _CLOSE + "*", r"[¿¡«“]?[A-ZÀ-ÖØ-ÞА-ЯЁΑ-Ω][a-zß-öø-ÿа-яёα-ωά-ώ]|[¿¡«“]"),  # the space is missing
]
def _starters(lang: str) -> str:
    """No closed-class word with a capital: it would begin a sentence."""
    return rf"(?!(?:{'|'.join(sorted(w.capitalize() for w in CLOSED[lang].split()))})\b)"


#: One table for each language in Latin letters, then those all of them share.
SPANISH: list[Rule] = [
    _rule(False, rf"{_WORD_START}(?:a|d)\.", r"\s*C\."),
    _rule(False, rf"{_WORD_START}p\.", r"\s*ej\."),
    _rule(False, rf"{_WORD_START}(?:EE|RR|FF|JJ|CC)\.", r"\s*[A-Z]{2}\."),
    _rule(False, rf"{_WORD_START}(?i:{_any(ABBREVIATIONS['es'])})\.", r"\s"),
]
PORTUGUESE: list[Rule] = [_rule(False, rf"{_WORD_START}(?:a|d)\.", r"\s*C\."), _rule(False, rf"{_WORD_START}p\.", r"\s*ex\."), _rule(False, rf"{_WORD_START}(?i:{_any(ABBREVIATIONS['pt'])})\.", r"\s")]
ENGLISH: list[Rule] = [_rule(False, rf"{_WORD_START}(?:{_any(ABBREVIATIONS['en'] + ' Fig Figs Eq Eqs Tab Vol Sec Ch Chap')})\.", rf"\s+(?=[\d(\[A-Za-z]){_starters('en')}")]
FRENCH: list[Rule] = [_rule(False, rf"{_WORD_START}(?:{_any(ABBREVIATIONS['fr'])})\.", rf"\s+(?=[\d(A-ZÀ-Þa-z]){_starters('fr')}")]
GERMAN: list[Rule] = [_rule(False, rf"{_WORD_START}(?:{_any(ABBREVIATIONS['de'])})\.", rf"\s+(?=[\d(A-ZÄÖÜa-zäöü]){_starters('de')}")]
#: Titles before a name, in any of these languages.
_TITLES = "Dr Dra Sr Sra Srta Prof Profa Mr Mrs Ms St Mme Mlle Hr Lic Ing"
LATIN: list[Rule] = [
    _rule(False, rf"{_WORD_START}(?i:{_any(_TITLES)})\.", r"\s+[A-ZÀ-Þ]"),
    _rule(False, rf"{_WORD_START}(?i:i\.\s?e|e\.\s?g|cf|viz|al|vs|approx|aprox)\.", r"\s"),
    _rule(False, rf"{_WORD_START}(?i:{_any(NUMERIC)})\.", r"\s+[\d(\[IVXLC]"),
    _rule(False, _UPPER_INITIAL + r"\.", r"\s+[A-ZÀ-Þ]"),
]
CYRILLIC: list[Rule] = [
    _rule(True, r"\d\s?г\.", r"\s+[А-ЯЁ]"),
    _rule(True, r"(?:и др|и т\.\s?[дп]|и пр)\.", r"\s+[А-ЯЁ]"),
    _rule(False, rf"(?i:(?:^|[^а-яё])(?:{_any(ABBREVIATIONS['ru'])}))\.", r"\s"),
    _rule(False, _UPPER_INITIAL + r"\.", r"\s*[А-ЯЁ]"),
]
GREEK: list[Rule] = [_rule(False, rf"(?i:(?:^|[^α-ωά-ώ])(?:{_any(ABBREVIATIONS['el'])}))\.", r"\s"), _rule(False, _UPPER_INITIAL + r"\.", r"\s*[Α-Ω]")]
ARABIC: list[Rule] = [_rule(False, rf"(?:^|\s)[وبلفك]?(?:{_any(ABBREVIATIONS['ar'])})\.", r"\s")]
INDIC: list[Rule] = [_rule(False, rf"(?:^|\s)(?:{_any(ABBREVIATIONS['hi'])}|[ऀ-ॿ]{{1,2}})\.", r"\s"), _rule(False, r"[ऀ-ॿ]\.", r"\s+[ऀ-ॿ]")]
THAI: list[Rule] = [_rule(False, rf"(?:{_any(ABBREVIATIONS['th'])})\.", r"\s*"), _rule(False, r"(?:^|\s)[ก-ฮ]{1,3}\.", r"\s*")]
DEFAULT: list[Rule] = [
    _rule(True, r"[。！？｡．।॥።፧၊။។៕།]" + _CLOSE + "*", r""),
    _rule(True, r"[۔։]" + _CLOSE + "*", r"\s|$"),
    _rule(True, r"[؟]" + _CLOSE + "*", r"\s|$"),
    _rule(True, r"[぀-ヿ㐀-鿿가-힣％%\d][!?]" + _CLOSE + "*", r"\s*[぀-ヿ㐀-鿿가-힣\dA-Z]"),
    _rule(False, r"[.!?…]" + _CLOSE + "*", rf"\s+{_OPEN}*{_SMALL}"),
    _rule(False, r"[.!?…]" + _CLOSE + "*", r"\s+[,;:)\]]"),
    _rule(True, r"[.!?…]" + _CLOSE + "*", r"\s"),
]
_LATIN = {"es": SPANISH + LATIN, "pt": PORTUGUESE + LATIN, "en": ENGLISH + LATIN, "fr": FRENCH + LATIN, "de": GERMAN + LATIN}
_TABLES = {"cyrillic": CYRILLIC, "greek": GREEK, "arabic": ARABIC, "indic": INDIC, "thai": THAI}
_GREEK_QUESTION: Rule = _rule(True, r"[;;]" + _CLOSE + "*", r"\s")

#: Where a unit may end.
_PLACE = re.compile(rf"[.!?…؟।॥。！？｡．;۔։።፧။។៕།]+{_CLOSE}*(?=\s|$|[^\s\d.,;:!?\-/@_%&=+])|(?<=[฀-๿])[ \t]+(?=[฀-๿])|\s*\n\s*")
_IN = r"(?:[^{}\n]|\n(?![ \t]*\n))*"  # a quotation ends with its paragraph at the latest
_QUOTED = re.compile("|".join([*(o + _IN.replace("{}", o + c) + c for o, c in ("«»", "“”", "„“", "「」", "『』", "《》", "（）")), r"\(" + _IN.replace("{}", "()") + r"\)", r"(?<![^\s(])\"[^\"\n]*\"(?![^\s.,;:!?)])"]))
_ENDED = re.compile(rf"[.!?…؟।॥。！？｡۔։።፧။។៕།;:,،、，；：—–]{_CLOSE}*$")


def _script(text: str, pos: int) -> str:
    for c in reversed(text[max(0, pos - 12) : pos]):
        if c.isalpha() or "ऀ" <= c <= "๿":
            cp = ord(c)
            if cp < 0x250 or 0x1E00 <= cp < 0x1F00:
                return "latin"
            if 0x370 <= cp < 0x400 or 0x1F00 <= cp < 0x2000:
                return "greek"
            if 0x400 <= cp < 0x530:
                return "cyrillic"
            if 0x590 <= cp < 0x780:
                return "arabic"
            if 0x900 <= cp < 0xE00:
                return "indic"
            if 0x530 <= cp < 0x590:
                return "armenian"
            if 0xE00 <= cp < 0xE80:
                return "thai"
            return "other"
    return "latin"


#: What makes a line a heading: at most so many characters and words.  Longer lines without an end mark belong to a sentence.
HEADING_CHARS, HEADING_WORDS = 90, 10
#: Characters before and after a place that rules look at; no rule reaches further.
BEFORE, AFTER = 60, 24


def _is_heading(line: str, following: str) -> bool:
    """A line that is a heading by itself: short, not ended, no part of a sentence that goes on."""
    line = line.strip()
    words = _WORD.findall(line)
    if not words or len(line) > HEADING_CHARS or len(words) > HEADING_WORDS or _ENDED.search(line):
        return False
    first = re.sub(r"^(?:[\d.]+[.)]?|[IVXLC]+[.)]|[#*•-]+)\s*", "", line) or line
    if first[:1].islower() and not line[:1].isdigit() or words[0].lower() in _BOUND or words[-1].lower() in _BOUND:
        return False
    nxt = following.lstrip()
    if not nxt:
        return True
    if nxt[0].islower() and not re.match(_MIXED, nxt):
        return False
    return not re.match(r"[,;:.)\]»”]", nxt)


def unit_ends(text: str) -> list[tuple[int, int]]:
    """(start, end) of the units of a text, in order; blank texts have none."""
    quoted = [m.span() for m in _QUOTED.finditer(text)]
    out: list[tuple[int, int]] = []
    start, q = 0, 0
    size = len(text)
    spoken: list[Rule] | None = None  # the rules of the text's language, once they are asked for

    def close(end: int, nxt: int) -> None:
        nonlocal start
        a, b = start, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        start = nxt

    while start < size and text[start].isspace():
        start += 1
    for m in _PLACE.finditer(text):
        mark = m[0]
        end = m.end()
        if end <= start:
            continue
        if mark.isspace() and not text[start : m.start()].strip():
            start = end
            continue
        if mark[0].isspace() and "\n" in mark:
            begin = m.start()
            # a line's end: of a heading, or of a paragraph
            line_start = text.rfind("\n", start, begin) + 1 or start
            if line_start <= start and begin > start and _is_heading(text[start:begin], text[end : end + 40]) or mark.count("\n") > 1:
                close(begin, end)
            elif begin > start and _script(text, begin) == "thai" and text[end : end + 1] >= "฀":
                close(begin, end)
            continue
        while q < len(quoted) and quoted[q][1] <= m.start():
            q += 1
        if q < len(quoted) and quoted[q][0] < m.start() and m.start() < quoted[q][1]:
            if end < quoted[q][1]:
                continue  # inside a quotation
            if quoted[q][1] == end and text[end : end + 1].strip() and not text[end].isspace() and text[quoted[q][0]] in "“「『《«（(" and text[end] > "⺀":
                continue  # a quotation the sentence goes on after, in a script without spaces
        if mark[0].isspace():
            close(m.start(), end)
            continue
        script = _script(text, m.start())
        before, after = text[max(start, end - BEFORE) : end], text[end : end + AFTER]
        if max(start, end - BEFORE) > start:
            before = " " + before  # so that ^ stands for the unit's start only
        if not after.strip():
            close(end, size)
            continue
        if mark[0] in ";;":
            if script == "greek" and _GREEK_QUESTION[2].match(after):
                close(end, end)
            continue
        if script == "latin" and spoken is None:
            spoken = _LATIN[language(text)]
        for is_break, left, right in (*COMMON, *(spoken if script == "latin" else _TABLES.get(script, ())), *DEFAULT):
            if left.search(before) and right.match(after):
                if is_break:
                    close(end, end)
                break
    close(size, size)
    return out


def sentence_units(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a sentence unit: (id, unit_index, end_pos, unit).

    end_pos counts code points of the text up to and including the unit's last one; closing marks belong
    to the unit, white space after it does not.  Headings are units.  Null and blank texts have no
    units.  Repeated rows of an id come out once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t:
                    rows += [(i, k, b, t[a:b]) for k, (a, b) in enumerate(unit_ends(t))]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["id", "unit_index", "end_pos", "unit"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, UNITS).dropDuplicates(["id", "unit_index"])
