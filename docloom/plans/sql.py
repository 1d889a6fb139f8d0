"""DuckDB SQL of the document operators, put together from expressions.

Written against DuckDB's own functions: RE2 patterns without look-around, list functions, lambdas.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.rules import STOP_WORDS
from . import sql_rules as R
from .policy_docs import CTE

#: Words of the longest name of nations and regions, and more.
NAME_WORDS = 6

Step = Callable[[str], str]


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def array(values: list[str]) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def sub(x: str, pattern: str, by: str, any_case: bool = False) -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(by)}, '{'gi' if any_case else 'g'}')"


def rewrite(rules: list[R.Rule]) -> Step:
    def step(x: str) -> str:
        for pattern, by, any_case in rules:
            x = sub(x, pattern, by, any_case)
        return x

    return step


def strip(x: str) -> str:
    return sub(x, r"^\s+|\s+$", "")


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> '')"


def sentences(x: str) -> str:
    return f"string_split({sub(x, r'([.!?])\s+', r'\1' + chr(1))}, chr(1))"


def key(x: str) -> str:
    return sub(f"lower({x})", r"\s+", " ")


def contains_any(x: str, wanted: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in wanted) + ")"


def _preprocess(x: str) -> str:
    kept = sub(strip(sub(x, r"\s+", " ")), r"[^\p{L}\p{N}\p{M}_\s.,;?!-]", "")
    return strip(sub(kept, r"\s*([.!?])\s*", r" \1 "))


def _acronyms(x: str) -> str:
    parts = f"regexp_extract_all({x}, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+')"
    return f"(SELECT array_to_string(list_transform(l, lambda w, i: CASE WHEN list_contains({array(R.ACRONYMS)}, w) OR (w = 'REDD' AND starts_with(coalesce(l[i + 1], ''), '+')) THEN w ELSE lower(w) END), '') FROM (SELECT {parts} AS l))"


def _headers(x: str) -> str:
    noise = "|".join(f"(?:{p})" for p in R.HEADER_FOOTER_LINES)
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda a: {strip('a')}), lambda b: b <> '' AND NOT regexp_matches(b, {lit(R.PAGE_LINE)}, 'i'))"
    numbered = f"list_transform({lines}, lambda c: {sub('c', r'^\d+\.\s*', '')})"
    return f"array_to_string(list_filter({numbered}, lambda d: NOT regexp_matches(d, {lit(noise)}, 'i')), chr(10))"


def _first_by_key(x: str, parts: str, fine: str, join: str) -> str:
    """The first item of each key: `parts` gives the items of x, `fine` tests one, called s."""
    items = f"list_filter(list_transform({parts}, lambda r: {strip('r')}), lambda s: {fine})"
    return f"(SELECT array_to_string(list_filter(l, lambda t, i: list_position(k, k[i]) = i), {join}) FROM (SELECT l, list_transform(l, lambda u: {key('u')}) AS k FROM (SELECT {items} AS l)))"


def _join_hyphens(x: str) -> str:
    return sub(x, r"([A-Za-z0-9_]+)-\s*\n\s*([A-Za-z0-9_]+)", r"\1\2")


def _special(x: str) -> str:
    spaced = sub(x, r"[\x{00a0}\x{2000}-\x{200f}\x{2028}\x{2029}]", " ")
    return sub(_join_hyphens(sub(sub(spaced, "[©®™]", ""), "[–—]", "-")), r"\s+", " ")


#: SQL of each elementary text function.
STEPS: dict[str, Step] = {
    "sanitize_text": lambda x: sub(x, r"[^a-zA-Z0-9\s.,;:!?()-]", ""),
    "preprocess_text": _preprocess,
    "lower_keep_acronyms": _acronyms,
    "squeeze_bullets": lambda x: f"trim({sub(sub(x, r'\s+', ' '), '[#*•▪▫]', '')})",
    "remove_headers_footers": _headers,
    "join_hyphenated": _join_hyphens,
    "clean_special_characters": _special,
    "normalize_percentages": rewrite(R.PERCENTAGES),
    "normalize_years": rewrite(R.YEARS),
    "normalize_dates": rewrite(R.dates()),
    "normalize_currency": rewrite(R.CURRENCIES),
    "normalize_emission_units": rewrite(R.EMISSION_UNITS),
    "convert_written_numbers": rewrite(R.WRITTEN_NUMBERS),
    "handle_missing_values": rewrite(R.MISSING_VALUES),
    "remove_captions": rewrite(R.CAPTIONS),
    "dedup_sentences": lambda x: _first_by_key(x, f"regexp_split_to_array({x}, '[.!?]+')", "length(s) > 10", "'. '"),
    "fix_sentence_boundaries": rewrite(R.SENTENCE_BOUNDARIES),
    "mark_sections": rewrite(R.HEADINGS),
    "dedup_paragraphs": lambda x: _first_by_key(x, f"string_split({x}, chr(10) || chr(10))", f"length({key('s')}) > 20", "chr(10) || chr(10)"),
    "remove_annexes_references": rewrite(R.ANNEXES),
    "standardize_terms": rewrite(R.TERMS),
    "remove_legal_boilerplate": rewrite(R.BOILERPLATE),
    "entity_tagging_prep": rewrite(R.COUNTRIES),
    "final_cleanup": lambda x: f"trim({sub(sub(x, r'\s+', ' '), r'([.!?])\s*([A-Z])', r'\1 \2')})",
}
#: Composed functions by their parts.
PARTS = {
    "basic_text_cleaning": ["lower_keep_acronyms", "squeeze_bullets"],
    "normalize_numeric_and_dates": ["normalize_percentages", "normalize_years", "normalize_dates", "normalize_currency", "normalize_emission_units", "convert_written_numbers"],
    "structure_oriented_cleaning": ["remove_captions", "dedup_sentences", "fix_sentence_boundaries", "mark_sections"],
    "climate_policy_cleaning": ["remove_annexes_references", "standardize_terms", "remove_legal_boilerplate", "entity_tagging_prep"],
}
#: Text functions in the order of their numbers, from 3.
ORDER = ["lower_keep_acronyms", "basic_text_cleaning", "remove_headers_footers", "clean_special_characters", "normalize_percentages", "normalize_years", "normalize_dates", "normalize_currency", "normalize_emission_units", "convert_written_numbers", "normalize_numeric_and_dates", "handle_missing_values", "remove_captions", "dedup_sentences", "fix_sentence_boundaries", "mark_sections", "structure_oriented_cleaning", "dedup_paragraphs", "remove_annexes_references", "standardize_terms", "remove_legal_boilerplate", "entity_tagging_prep", "climate_policy_cleaning", "final_cleanup"]


def _flat(names: list[str]) -> list[str]:
    return [part for n in names for part in PARTS.get(n, [n])]


COMPAT = _flat(["basic_text_cleaning", "remove_headers_footers", "clean_special_characters", "normalize_numeric_and_dates", "handle_missing_values", "structure_oriented_cleaning", "dedup_paragraphs", "climate_policy_cleaning", "final_cleanup"])
STRUCTURED = _flat(["remove_headers_footers", "join_hyphenated", "remove_captions", "remove_annexes_references", "dedup_paragraphs", "basic_text_cleaning", "clean_special_characters", "normalize_numeric_and_dates", "handle_missing_values", "dedup_sentences", "fix_sentence_boundaries", "mark_sections", "standardize_terms", "remove_legal_boilerplate", "entity_tagging_prep", "final_cleanup"])


def steps_ctes(names: list[str], source: str, out: str) -> str:
    """CTEs that take (doc_id, text) of `source` through the steps into `out`."""
    made, last = [], source
    for i, name in enumerate(names):
        now = out if i == len(names) - 1 else f"{out}{i}"
        made.append(f"{now} AS MATERIALIZED (SELECT doc_id, {STEPS[name]('text')} AS text FROM {last})")
        last = now
    return ", ".join(made)


def chain(names: list[str], source: str) -> str:
    head = "WITH " + (CTE + ", " if source == "policy_docs" else "")
    return f"{head}{steps_ctes(names, source, 's')} SELECT doc_id, text FROM s"


def halves(ss: str) -> tuple[str, str]:
    half = f"len({ss}) // 2"
    return f"array_to_string({ss}[1:{half}], ' ')", f"array_to_string({ss}[{half} + 1:], ' ')"


_SECTION_COLUMNS = f"CASE WHEN len(pp) >= 2 THEN pp[1] ELSE {halves('ss')[0]} END AS section1, CASE WHEN len(pp) >= 2 THEN array_to_string(pp[2:], chr(10)) ELSE {halves('ss')[1]} END AS section2"
SECTIONS = f"WITH {CTE}, sp AS (SELECT doc_id, list_filter(string_split(text, chr(10) || chr(10)), lambda q: {contains_any('lower(q)', R.POLICY_WORDS)}) AS pp, {sentences('text')} AS ss FROM policy_docs), sections AS (SELECT doc_id, {_SECTION_COLUMNS} FROM sp)"


def in_category(s: str, category: str) -> str:
    if R.CATEGORIES[category] is None:
        return f"regexp_matches({s}, {lit(R.TARGET_YEAR)})"
    return contains_any(f"lower({s})", R.CATEGORIES[category])


CLASSIFIED = f"WITH {CTE}, l AS (SELECT doc_id, {sentences('text')} AS ss FROM policy_docs), one AS (SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sentence FROM l), classified AS (" + " UNION ALL ".join(f"SELECT doc_id, {lit(c)} AS category, pos, sentence FROM one WHERE {in_category('sentence', c)}" for c in R.CATEGORIES) + ")"


def impact(x: str, kind: str) -> str:
    gate, more, less = R.IMPACTS[kind]
    plus = " + ".join(f"CAST(contains(lower({x}), {lit(w)}) AS INTEGER)" for w in more)
    minus = " - ".join(f"CAST(contains(lower({x}), {lit(w)}) AS INTEGER)" for w in less)
    return f"CASE WHEN {contains_any(f'lower({x})', gate)} THEN greatest(-1.0, least(1.0, ({plus} - {minus}) / 3.0::DOUBLE)) ELSE 0.0 END"


def keywords(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({x}), '\\p{{L}}+'), lambda w: NOT list_contains({array(STOP_WORDS)}, w))))"


STATS = f"WITH c AS (SELECT doc_id, {_preprocess('text')} AS clean FROM documents), stats AS (SELECT doc_id, clean, len({words('clean')}) AS word_count, len(regexp_split_to_array(clean, '[.!?]+')) AS sentence_count FROM c)"

PAIRS = "WITH pairs AS (SELECT * FROM (SELECT doc_id AS id_a, lead(doc_id) OVER (PARTITION BY lang, source ORDER BY doc_id) AS id_b FROM documents) WHERE id_b IS NOT NULL)"


def compared(source: str) -> str:
    """CTEs tokens and compared of the pairs over (doc_id, text) of `source`."""
    return f"tokens AS (SELECT doc_id, list_distinct({words('text')}) AS w FROM {source}), compared AS (SELECT id_a, id_b, list_sort(list_intersect(a.w, b.w)) AS overlap, list_sort(list_filter(a.w, lambda x: NOT list_contains(b.w, x))) AS unique_a, list_sort(list_filter(b.w, lambda x: NOT list_contains(a.w, x))) AS unique_b FROM pairs JOIN tokens a ON a.doc_id = id_a JOIN tokens b ON b.doc_id = id_b)"


COMPARED = f"{PAIRS}, {compared('documents')}"


def tf_idf(source: str) -> str:
    """CTEs up to alike (id_a, id_b, similarity) of the pairs over `source`."""
    return f"""tw AS (SELECT doc_id, unnest({words('text')}) AS term FROM {source}), tf AS (SELECT doc_id, term, count(*) AS tf FROM tw GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), nn AS (SELECT count(*) AS n FROM {source}),
v AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1.0) AS w FROM tf JOIN df USING (term), nn),
vn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM v GROUP BY doc_id),
vd AS (SELECT id_a, id_b, sum(a.w * b.w) AS dot FROM pairs JOIN v a ON a.doc_id = id_a JOIN v b ON b.doc_id = id_b AND a.term = b.term GROUP BY ALL),
alike AS (SELECT id_a, id_b, coalesce(dot / (a.norm * b.norm), 0.0) AS similarity FROM pairs LEFT JOIN vd USING (id_a, id_b) LEFT JOIN vn a ON a.doc_id = id_a LEFT JOIN vn b ON b.doc_id = id_b)"""


POLICY_PAIRS = f"WITH clean AS (SELECT doc_id, {STEPS['sanitize_text']('text')} AS text FROM documents WHERE length({strip('text')}) >= 10), pairs AS (SELECT p.* FROM ({PAIRS[len('WITH pairs AS ('):-1]}) p JOIN clean a ON a.doc_id = id_a JOIN clean b ON b.doc_id = id_b), {compared('clean')}, {tf_idf('clean')} SELECT id_a, id_b, round(similarity, 6) AS similarity, array_to_string(overlap, ' ') AS overlap, array_to_string(unique_a, ' ') AS unique_a, array_to_string(unique_b, ' ') AS unique_b FROM compared JOIN alike USING (id_a, id_b)"

SECTION_SIMILARITY = f"""{SECTIONS}, wl AS (SELECT doc_id, {words('section1')} AS w1, {words('section2')} AS w2 FROM sections),
wc AS (SELECT doc_id, term, sum(s1) AS c1, sum(s2) AS c2 FROM (SELECT doc_id, unnest(w1) AS term, 1 AS s1, 0 AS s2 FROM wl UNION ALL SELECT doc_id, unnest(w2), 0, 1 FROM wl) GROUP BY ALL),
ws AS (SELECT doc_id, CASE WHEN sum(c1 * c1) > 0 AND sum(c2 * c2) > 0 THEN sum(c1 * c2) / (sqrt(sum(c1 * c1)) * sqrt(sum(c2 * c2))) ELSE 0.0 END AS similarity FROM wc GROUP BY doc_id)
SELECT doc_id, round(coalesce(similarity, 0.0), 6) AS similarity, array_to_string(list_sort(list_distinct(list_intersect(w1, w2))), ' ') AS overlap, array_to_string(list_sort(list_distinct(list_filter(w1, lambda x: NOT list_contains(w2, x)))), ' ') AS unique_a, array_to_string(list_sort(list_distinct(list_filter(w2, lambda x: NOT list_contains(w1, x)))), ' ') AS unique_b FROM wl LEFT JOIN ws USING (doc_id)"""


def spans(source: str, pattern: str, out: str) -> str:
    """CTE `out` (doc_id, src, pos, t, s, e): matches of a pattern with places, from lengths of matches and gaps."""
    # A match can't lie in a gap, so splitting and extracting go hand in hand.
    listed = f"SELECT doc_id, text AS src, regexp_extract_all(text, {lit(pattern)}) AS m, regexp_split_to_array(text, {lit(pattern)}) AS g FROM {source}"
    place = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"{out} AS (SELECT doc_id, src, i - 1 AS pos, m[i] AS t, CAST({place} AS BIGINT) AS s, CAST({place} + length(m[i]) AS BIGINT) AS e FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM ({listed})))"


def _label(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {lit(f'(?i)^(?:{p})$')}) THEN {lit(label)}" for label, p in R.ENTITIES.items()) + " ELSE 'CARDINAL' END"


def names_of(source: str) -> str:
    """CTE names (doc_id, text, label, start, end) of nations and regions in `source`."""
    runs = " UNION ALL ".join(f"SELECT a.doc_id, substr(a.src, a.s + 1, b.e - a.s) AS text, a.s, b.e FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + {k}" for k in range(NAME_WORDS))
    return f"""{spans(source, '[\\p{L}\\p{N}]+', 'w')}, gz AS (SELECT DISTINCT lower(n) AS n FROM (SELECT n_name AS n FROM nation UNION ALL SELECT r_name FROM region)),
names AS (SELECT doc_id, text, 'GPE' AS label, s AS "start", e AS "end" FROM ({runs}) JOIN gz ON lower(text) = n)"""


def _entities(source: str) -> str:
    pattern = "(?i)" + "|".join(f"(?:{p})" for p in R.ENTITIES.values())
    return f"""{spans(source, pattern, 'f')}, {names_of(source)},
entities AS (SELECT doc_id, t AS text, {_label('t')} AS label, s AS "start", e AS "end" FROM f UNION ALL SELECT * FROM names)"""


NAMES = f"WITH {CTE}, {names_of('policy_docs')}"
ENTITIES = f"WITH {CTE}, {_entities('policy_docs')}"


def entities_of(steps: list[str]) -> str:
    return f"WITH {CTE}, {steps_ctes(steps, 'policy_docs', 'done')}, {_entities('done')}"


def _summary_ctes(source: str, max_input: int | None = 4000, max_words: int = 120, min_words: int = 40) -> str:
    """CTEs up to summaries (doc_id, summary) of (doc_id, text) of `source`."""
    read = "text" if max_input is None else f"substr(text, 1, {max_input})"
    return f"""sh AS (SELECT doc_id, {read} AS x FROM {source}),
su AS (SELECT doc_id, unnest({words('x')}) AS term FROM sh), sf AS (SELECT doc_id, term, count(*) AS c FROM su GROUP BY ALL),
sl AS (SELECT doc_id, {sentences('x')} AS ss FROM sh), ses AS (SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS s FROM sl),
sw AS (SELECT doc_id, pos, unnest({words('s')}) AS term FROM ses),
sc AS (SELECT doc_id, pos, round(sum(c) / count(*), 6) AS score, count(*) AS n FROM sw JOIN sf USING (doc_id, term) GROUP BY ALL),
sr AS (SELECT doc_id, pos, n, row_number() OVER o AS r, sum(n) OVER o AS used FROM sc WINDOW o AS (PARTITION BY doc_id ORDER BY score DESC, pos ROWS UNBOUNDED PRECEDING)),
sx AS (SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS summary FROM sr JOIN ses USING (doc_id, pos) WHERE r = 1 OR used <= {max_words} OR used - n < {min_words} GROUP BY doc_id),
summaries AS (SELECT doc_id, coalesce(summary, '') AS summary FROM sh LEFT JOIN sx USING (doc_id))"""


SUMMARIES = f"WITH {_summary_ctes('documents')} SELECT doc_id, summary FROM summaries"
WHOLE_SUMMARIES = f"WITH {_summary_ctes('documents', None)} SELECT doc_id, summary FROM summaries"


def summaries_of(steps: list[str], max_input: int | None = 4000) -> str:
    return f"WITH {CTE}, {steps_ctes(steps, 'policy_docs', 'done')}, {_summary_ctes('done', max_input)} SELECT doc_id, summary FROM summaries"


def recommended(asked: str) -> str:
    """CTEs up to best: the five best orders of each query; `asked` is a query over z that gives query_id and its columns."""
    return f"""WITH h AS (SELECT o_orderkey AS id, o_orderstatus AS status, CAST(month(o_orderdate) AS VARCHAR) AS month, o_totalprice AS price, o_orderpriority AS priority FROM orders),
st AS (SELECT avg(price) AS m, stddev_pop(price) AS d FROM h), z AS (SELECT h.*, (price - m) / d AS zp FROM h, st), asked AS ({asked}),
sc AS (SELECT query_id, z.id, z.priority, (CAST(a.status = z.status AS INTEGER) + CAST(a.month = z.month AS INTEGER) + a.zp * z.zp) / (sqrt(2 + a.zp * a.zp) * sqrt(2 + z.zp * z.zp)) AS similarity FROM asked a, z),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id DESC) AS rank FROM sc) WHERE rank <= 5)"""


#: Every order whose key is divisible by 100 is a query, its key the query's id; and the one fixed query of a full analysis.
RECOMMENDED = recommended("SELECT id AS query_id, z.* EXCLUDE (id) FROM z WHERE id % 100 = 0")
FIXED = recommended("SELECT n_nationkey AS query_id, z.* EXCLUDE (id) FROM nation JOIN z ON id = n_nationkey * 100 + 1 WHERE n_nationkey = 0")
VOTED = ", vt AS (SELECT query_id, priority, sum(similarity) AS s, min(rank) AS r FROM best GROUP BY ALL), voted AS (SELECT query_id, priority AS predicted, s / CASE WHEN total = 0 THEN 1 ELSE total END AS confidence FROM (SELECT *, sum(s) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS k FROM vt) WHERE k = 1)"

KNN = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
sc AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, list_cosine_similarity(a.v, b.v) AS similarity FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id DESC) AS rank FROM sc) WHERE rank <= 5),
vt AS (SELECT query_id, label, sum(similarity) AS s, min(rank) AS r FROM best GROUP BY ALL)
SELECT query_id, label AS predicted, round(s / CASE WHEN total = 0 THEN 1 ELSE total END, 6) AS confidence FROM (SELECT *, sum(s) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, r) AS k FROM vt) WHERE k = 1"""


def ingested(key_col: str, cte: str = CTE) -> str:
    return f"WITH {cte}, {steps_ctes(STRUCTURED, 'policy_docs', 'done')} SELECT CAST(p.{key_col} AS VARCHAR) AS id, 'doc-' || p.{key_col} AS filename, CAST(length(p.text) AS INTEGER) AS original_length, CAST(length(done.text) AS INTEGER) AS processed_length FROM policy_docs p JOIN done USING (doc_id)"


# ---- reports ---------------------------------------------------------------------------------

#: Entities of a document as label:text in the order of their places, joined by |.
_LISTED = """listed AS (SELECT doc_id, string_agg(label || ':' || text, '|' ORDER BY "start", label, text) AS entities FROM entities GROUP BY doc_id)"""


def phrases_of(source: str) -> str:
    """CTE phrases (doc_id, phrase, score, n): runs of words between stop words and signs, which become a mark first."""
    parts = "[\\p{L}\\p{N}]+|[\\s''-]+|[^\\p{L}\\p{N}\\s''-]+"
    marked = f"array_to_string(list_transform(regexp_extract_all(lower(text), '{parts}'), lambda x: CASE WHEN list_contains({array(STOP_WORDS)}, x) OR regexp_matches(x, '^[^\\p{{L}}\\p{{N}}\\s''-]') THEN chr(1) ELSE x END), '')"
    return f"""pm AS (SELECT doc_id, unnest(list_filter(list_transform(string_split({marked}, chr(1)), lambda p: trim({sub('p', r'\s+', ' ')})), lambda p: regexp_matches(p, '\\p{{L}}'))) AS phrase FROM {source}),
pn AS (SELECT doc_id, phrase, count(*) AS n FROM pm GROUP BY ALL),
pw AS (SELECT doc_id, phrase, n, len(string_split(phrase, ' ')) AS k, unnest(string_split(phrase, ' ')) AS word FROM pn),
pd AS (SELECT *, sum(k * n) OVER w / sum(n) OVER w AS mean FROM pw WINDOW w AS (PARTITION BY doc_id, word)),
phrases AS (SELECT doc_id, phrase, round(avg(mean), 6) AS score, max(n) AS n FROM pd GROUP BY doc_id, phrase)"""


PHRASES = f"WITH {CTE}, {phrases_of('policy_docs')} SELECT doc_id, phrase, score, n FROM phrases"

def policy_report(max_input: int | None = 4000) -> str:
    """Sentences of each category, the summary and the entities of raw texts."""
    return f"""WITH {CTE}, {_entities('policy_docs')}, {_LISTED}, {_summary_ctes('policy_docs', max_input)}, l AS (SELECT doc_id, {sentences('text')} AS ss, len({words('text')}) AS word_count FROM policy_docs)
SELECT doc_id, {', '.join(f"len(list_filter(ss, lambda s: {in_category('s', c)})) AS {c}" for c in R.CATEGORIES)}, summary, word_count, entities FROM l JOIN summaries USING (doc_id) LEFT JOIN listed USING (doc_id)"""

NONPUNCT = "[\\p{L}\\p{N}]+(?:[''’-][\\p{L}\\p{N}]+)*"
TEXT_REPORT = f"""WITH {CTE}, {_entities('policy_docs')}, {_LISTED}, {phrases_of('policy_docs')}, pl AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY phrase) AS phrases FROM phrases GROUP BY doc_id)
SELECT doc_id, len(regexp_extract_all(text, '{NONPUNCT}')) AS word_count, len(list_filter({sentences('text')}, lambda s: {strip('s')} <> '')) AS sentence_count, entities, phrases FROM policy_docs LEFT JOIN listed USING (doc_id) LEFT JOIN pl USING (doc_id)"""

#: Neighbouring policy texts, by entities, words and cosine.
ENTITY_PAIRS = f"""WITH {CTE}, there AS (SELECT * FROM policy_docs WHERE length({strip('text')}) > 0), pairs AS (SELECT a.doc_id AS id_a, b.doc_id AS id_b FROM there a JOIN there b ON b.doc_id = a.doc_id + 1),
{tf_idf('there')}, {_entities('there')}, en AS (SELECT DISTINCT doc_id, lower(text) AS t FROM entities),
sh AS (SELECT id_a, id_b, string_agg(a.t, '|' ORDER BY a.t) AS overlap FROM pairs JOIN en a ON a.doc_id = id_a JOIN en b ON b.doc_id = id_b AND b.t = a.t GROUP BY ALL),
wn AS (SELECT doc_id, len(regexp_extract_all(text, '{NONPUNCT}')) AS n FROM there)
SELECT id_a, id_b, round(similarity, 6) AS similarity, coalesce(overlap, '') AS overlap, a.n AS word_count_a, b.n AS word_count_b FROM alike LEFT JOIN sh USING (id_a, id_b) JOIN wn a ON a.doc_id = id_a JOIN wn b ON b.doc_id = id_b"""


def full_analysis(max_input: int | None = 4000) -> str:
    """Sections, summaries and entities of the cleaned texts, and the recommendation for the fixed query."""
    sections = SECTIONS[len(f"WITH {CTE}, ") :].replace("FROM policy_docs", "FROM done")
    summaries = []
    for i in "12":
        ctes = _summary_ctes(f"(SELECT doc_id, section{i} AS text FROM sections)", max_input)
        for name in ("sh", "su", "sf", "sl", "ses", "sw", "sc", "sr", "sx", "summaries"):
            ctes = re.sub(rf"\b{name}\b", f"{name}{i}", ctes)
        summaries.append(ctes)
    similar = SECTION_SIMILARITY[len(SECTIONS) + 2 :].replace("\nSELECT doc_id, round", ", ss AS (SELECT doc_id, round", 1) + ")"
    advice = FIXED[len("WITH ") :] + VOTED + ", tops AS (SELECT query_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY rank) AS top FROM best GROUP BY query_id)"
    return f"""WITH {CTE}, {steps_ctes(['preprocess_text', 'sanitize_text'], 'policy_docs', 'done')}, {sections}, {similar}, {', '.join(summaries)}, {_entities('done')}, {_LISTED}, {advice}
SELECT doc_id, ss.similarity, ss.overlap, summaries1.summary AS summary1, summaries2.summary AS summary2, entities, predicted, round(confidence, 6) AS confidence, top
FROM ss JOIN summaries1 USING (doc_id) JOIN summaries2 USING (doc_id) LEFT JOIN listed USING (doc_id), voted JOIN tops USING (query_id)"""
