"""SQL equivalents, for DuckDB, of those queries that SQL expresses on whole tables."""

from __future__ import annotations

_DOC = r"lower(regexp_replace(lower(trim(doc_id)), '(\.(txt|json|jsonl|pdf))+$', ''))"
_HASH = "lower(trim(doc_hash))"
_LINKS = f"(SELECT DISTINCT {_DOC} AS doc, {_HASH} AS h FROM fragments WHERE doc_id IS NOT NULL AND doc_hash IS NOT NULL AND {_HASH} NOT IN ('', 'd41d8cd98f00', 'da39a3ee5e6b', 'e3b0c44298fc', 'none', 'null', 'nan', 'n/a', 'na', '-', 'unknown') AND NOT regexp_matches({_HASH}, '^(0+|f+|-+)$'))"


def _plain(c: str) -> str:
    return rf"regexp_replace(lower(trim({c})), '[\s_\-]+', '', 'g')"


_CAT = ("contr_type", "tarea1_label", "tarea2_role")
_MATCH = " AND ".join(f"(t.{c} IS NULL OR {_plain('t.' + c)} = coalesce({_plain('f.' + c)}, ''))" for c in _CAT)
_ASKED = f"""(SELECT t.plan_id, t.target_id, greatest(t.min_rows, (round(t.target_share * 1000)::BIGINT * t.sample_rows + 999) // 1000) AS wanted, count(f.fragment_id) AS available
 FROM sample_targets t LEFT JOIN (SELECT DISTINCT fragment_id, {', '.join(_CAT)} FROM fragments) f ON {_MATCH} GROUP BY ALL)"""
_SIZES = f"(SELECT {_plain('source')} AS k, sum(length(text)) AS size FROM documents GROUP BY 1)"

# folded words: lower case, no accents, runs of letters and digits
_WORDS = r"regexp_extract_all(strip_accents(lower({t})), '[\p{L}\p{N}]+')"
_JOINED = r"regexp_replace(regexp_replace({t}, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]', '', 'g'), '(\p{L})(?:[-\x{2010}\x{2011}\x{00AD}\x{00AC}][ \t]*\r?\n\s*|\x{00AD})(\p{L})', '\1\2', 'g')"
_OPENING = " UNION ALL ".join(rf"SELECT item_id, regexp_extract(text, '^(?:[\s\S]*?(?:[.!?:]\s|\n)){{{k}}}', 0) AS o FROM gold_items" for k in (1, 2, 3, 4))
_RUNS = "(SELECT DISTINCT {id}, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT {id}, w, unnest(range(1, len(w) - 10)) AS k FROM {rows}))"


def _near(name: str, key: str, extra: str, rest: str) -> str:
    """Pairs of rows of which 60 % of all runs of three words are in both texts."""
    return rf"""WITH t AS (SELECT DISTINCT {key} AS id, text{extra} FROM {name} WHERE text IS NOT NULL), w AS (SELECT * EXCLUDE (text), {_WORDS.replace("{t}", "text")} AS w, length(regexp_replace(text, '[^\p{{Latin}}]', '', 'g')) >= length(regexp_replace(text, '[^\p{{L}}]|\p{{Latin}}', '', 'g')) AS latin FROM t),
 g AS (SELECT * EXCLUDE (w, latin), list_distinct(list_transform(range(1, len(w) - 1), lambda k: hash(array_to_string(w[k : k + 2], ' ')))) AS g FROM w WHERE latin AND len(w) >= 30), e AS (SELECT id, len(g) AS n, unnest(g) AS x FROM g),
 p AS (SELECT a.id AS id_a, b.id AS id_b FROM e a JOIN e b ON a.x = b.x AND a.id < b.id AND 0.6 * greatest(a.n, b.n) <= least(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= 0.6 * (a.n + b.n - count(*)) - 1e-9) {rest}"""


ORACLES: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE l AS (SELECT DISTINCT a.doc AS a, b.doc AS b FROM {_LINKS} a JOIN {_LINKS} b USING (h) WHERE a.doc <> b.doc), r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
 SELECT DISTINCT a AS doc_a, b AS doc_b FROM r WHERE a < b""",
    "p2_found": f"SELECT plan_id, target_id FROM {_ASKED} WHERE available < wanted",
    "p3_found": r"SELECT DISTINCT fragment_id FROM fragments WHERE length(text) > 10000 OR len(regexp_extract_all(text, '[^\s\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+')) > 1000",
    "p8_found": f"""WITH o AS ({_OPENING}), f AS (SELECT item_id, length(o) AS n, array_to_string({_WORDS.replace("{t}", "o")}, ' ') AS w FROM o WHERE o <> ''), c AS (SELECT item_id, max(n) AS n FROM f WHERE w IN (SELECT w FROM f GROUP BY w HAVING count(DISTINCT item_id) >= 3 AND w <> '') GROUP BY item_id),
 i AS (SELECT item_id, {_WORDS.replace("{t}", _JOINED.replace("{t}", "substr(text, coalesce(n, 0) + 1)"))} AS w FROM gold_items LEFT JOIN c USING (item_id)), d AS (SELECT doc_id, {_WORDS.replace("{t}", "text")} AS w FROM documents UNION ALL SELECT doc_id, {_WORDS.replace("{t}", _JOINED.replace("{t}", "text"))} FROM documents)
 SELECT DISTINCT doc_id, item_id FROM {_RUNS.replace("{id}", "doc_id").replace("{rows}", "d")} JOIN {_RUNS.replace("{id}", "item_id").replace("{rows}", "i")} USING (g)""",
    # no case hangs on the choice of tokenizer: characters stand for tokens
    "p9_found": f"SELECT mix_id, source FROM (SELECT t.*, coalesce(s.size, 0) AS size, (SELECT sum(size) FROM {_SIZES}) AS whole FROM mix_targets t LEFT JOIN {_SIZES} s ON s.k = {_plain('t.source')}) WHERE size * max_repeats < target_share * budget_ratio * whole",
    "p5_found": "SELECT * FROM (" + _near("fragments", "fragment_id", "", "SELECT 'fragments' AS table_name, id_a, id_b FROM p") + ") UNION ALL SELECT * FROM (" + _near("segments", "seg_id", "", "SELECT 'segments' AS table_name, id_a, id_b FROM p") + ")",
    "p6_found": _near("fragments", "fragment_id", f", {_plain('split')} AS split", "SELECT id_a, id_b FROM p JOIN t a ON a.id = id_a JOIN t b ON b.id = id_b WHERE (a.split = 'train' AND b.split IN ('val', 'test')) OR (b.split = 'train' AND a.split IN ('val', 'test'))"),
}
