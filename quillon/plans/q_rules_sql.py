"""SQL of the rule queries of other modules, every marker, weight and threshold typed out."""

from __future__ import annotations

from quillon.plans import sqltext as sq
from quillon.plans.q_spans import _LATEST
from quillon.plans.q_text import _sql_light

_UNITS = "u AS (SELECT DISTINCT ON (guidance_unit_id) * FROM guidance_units WHERE span_text IS NOT NULL ORDER BY guidance_unit_id)"
_COLLAPSED = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


def _sum(c: str, *weighted: tuple[str, float]) -> str:
    return " + ".join(rf"CASE WHEN regexp_matches({c}, '\b{p}\b') THEN {w} ELSE 0 END" for p, w in weighted)


def _count(c: str, *phrases: str) -> str:
    return " + ".join(rf"CAST(regexp_matches({c}, '(?i)\b{p}\b') AS INT)" for p in phrases)


# four topics, no phrase is shared, so each weight (3.5 slug, 3 phrase, 1.5 display name) counts four times
_X49 = f"""WITH {_UNITS}, n AS (SELECT guidance_unit_id, {sq.norm('span_text')} AS n FROM u),
s AS (SELECT guidance_unit_id, list_sort(list_filter([
{{'s': -({_sum('n', ('road', 14.0), ('caravan', 12.0), ('traveller', 12.0), ('road and journey', 6.0))}), 'slug': 'travel.road'}}, {{'s': -({_sum('n', ('household', 14.0), ('garden', 12.0), ('roof', 12.0), ('lamp', 12.0))}), 'slug': 'home.household'}},
{{'s': -({_sum('n', ('word', 14.0), ('the word', 12.0), ('meaning', 12.0), ('idiom', 12.0), ('words and meaning', 6.0))}), 'slug': 'speech.word'}}, {{'s': -({_sum('n', ('patience', 14.0), ('patient', 12.0), ('hardship', 12.0))}), 'slug': 'character.patience'}}], lambda x: x.s < 0)) AS r FROM n)
SELECT guidance_unit_id, CASE WHEN coalesce(-r[1].s, 0) >= 3 THEN r[1].slug END AS topic, coalesce(-r[1].s, 0) AS score, coalesce(-r[1].s, 0) >= 3 AND coalesce(-r[1].s, 0) - coalesce(-r[2].s, 0) >= 2 AS is_sure,
array_to_string(list_transform(list_filter(r[2:6], lambda x: x.s <= -1.5), lambda x: x.slug), ',') AS secondary FROM s"""


def _surface(n: str, c: str, phrase: str) -> str:
    words = phrase.split()
    share = " + ".join(f"CAST(list_contains({sq.words(n)}, '{w}') AS INT)" for w in words)
    return rf"CASE WHEN regexp_matches({n}, '\b{phrase}\b') THEN 1.0 WHEN contains(regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g'), '{''.join(words)}') THEN 0.9 ELSE 0.8 * ({share}) / {len(words)} END"


def _best(*phrases: str) -> str:
    return f"greatest({', '.join(_surface('n', 'span_text', p) for p in phrases)}, 0.0)"


_X51 = f"""WITH {_UNITS}, n AS (SELECT guidance_unit_id, span_text, {sq.norm('span_text')} AS n FROM u),
o AS (SELECT guidance_unit_id, unnest([{{'concept': 'household', 'f': {_best('the household', 'the roof')}}}, {{'concept': 'trade', 'f': {_best('the market', 'the merchant', 'coin')}}}, {{'concept': 'speech', 'f': {_best('the word', 'the phrase', 'the idiom')}}},
{{'concept': 'light', 'f': {_best('the lamp', 'the lantern')}}}]) AS x FROM n), c AS (SELECT guidance_unit_id, x.concept AS concept, round(x.f, 6) AS confidence FROM o)
SELECT *, row_number() OVER (PARTITION BY guidance_unit_id ORDER BY confidence DESC, concept) AS rank FROM c WHERE confidence >= 0.84 QUALIFY rank <= 4"""


def _layer(n: str, part: str) -> str:
    return f"0.30 + CASE WHEN {n} >= 3 THEN 0.55 WHEN {n} = 2 THEN 0.47 WHEN {n} = 1 THEN 0.35 ELSE 0.0 END + CASE WHEN contains(lower(coalesce(title, '')), '{part}') THEN 0.10 ELSE 0.0 END"


_M13 = rf"""WITH e AS (SELECT e.id, c.title_en AS title, {_COLLAPSED(r"regexp_replace(coalesce(english_text, ''), '(?i)narrated\s+[^:]{2,80}:', ' ', 'g')")} AS b FROM hadith_entries e LEFT JOIN hadith_chapters c ON e.chapter_id = c.id),
n AS (SELECT *, {_count('b', 'road', 'caravan', 'traveller')} AS n1, {_count('b', 'household', 'garden', 'roof', 'lamp')} AS n2, {_count('b', r'the\s+word', 'meaning', 'idiom')} AS n3, {_count('b', 'patient', 'patience', 'hardship')} AS n4 FROM e),
r AS (SELECT *, list_sort([{{'s': -({_layer('n1', 'the road')}), 't': 'travel.road'}}, {{'s': -({_layer('n2', 'the household')}), 't': 'home.household'}}, {{'s': -({_layer('n3', 'the word')}), 't': 'speech.word'}}, {{'s': -({_layer('n4', 'patience')}), 't': 'character.patience'}}]) AS r,
CASE title WHEN 'The road' THEN 'travel.road' WHEN 'The household' THEN 'home.household' WHEN 'The word' THEN 'speech.word' WHEN 'Patience' THEN 'character.patience' END AS one FROM n),
l AS (SELECT *, -r[1].s AS top, -r[2].s AS nx, CASE WHEN b = '' THEN 'empty' WHEN one IS NOT NULL THEN 'chapter' WHEN -r[1].s >= 0.55 AND (-r[1].s >= 0.70 OR r[2].s - r[1].s >= 0.15 - 1e-9) THEN 'phrases' ELSE 'low_confidence' END AS layer FROM r)
SELECT id, CASE layer WHEN 'chapter' THEN one WHEN 'phrases' THEN r[1].t END AS topic, layer, round(CASE layer WHEN 'chapter' THEN 0.92 WHEN 'phrases' THEN CASE WHEN top >= 0.8 THEN 0.75 ELSE 0.60 END WHEN 'empty' THEN 0.0 ELSE top END, 3) AS density FROM l"""


def _has(c: str, *markers: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in markers) + ")"


def _hits(name: str, *aliases: str) -> str:
    n = " + ".join(f"CAST(contains(n, '{a}') AS INT)" for a in aliases)
    return f"{{'n': -({n}), 't': '{name}'}}"


_M06 = f"""WITH e AS (SELECT id, lower(coalesce(english_text, '')) AS l, {sq.norm('english_text')} AS n FROM hadith_entries)
SELECT id, concat_ws(',', CASE WHEN {_has('l', 'do not', 'let no', 'forbid')} THEN 'prohibition' END, CASE WHEN {_has('l', 'asked')} THEN 'question' END, CASE WHEN {_has('l', 'better that', 'more than')} THEN 'comparison' END,
CASE WHEN {_has('l', 'returned', 'once')} THEN 'story' END) AS labels,
array_to_string(list_transform(list_sort(list_filter([{_hits('household', 'the household', 'the roof')}, {_hits('trade', 'the market', 'the merchant', 'coin')}, {_hits('speech', 'the word', 'the phrase', 'the idiom')}, {_hits('light', 'the lamp', 'the lantern')}], lambda x: x.n < 0)), lambda x: x.t), ',') AS topics FROM e"""

_REF = [
    r"(?i)\bquran[: ]+(\d{1,3}):(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?",
    r"(?i)\bsurah\s+(\d{1,3})\D{1,12}(?:ayah|verse)s?\s+(\d{1,3})(?:\s*(?:-|–|to)\s*(\d{1,3}))?",
    r"\b(\d{1,3})\s*:\s*(\d{1,3})(?:\s*[-–]\s*(\d{1,3}))?",
]
_P25 = f"""WITH m AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN [regexp_extract(text, '{p}', 1), regexp_extract(text, '{p}', 2), regexp_extract(text, '{p}', 3)]" for p in _REF)} END AS g FROM documents),
n AS (SELECT doc_id, CAST(g[1] AS INTEGER) AS surah, CAST(g[2] AS INTEGER) AS a, CAST(CASE WHEN g[3] = '' THEN g[2] ELSE g[3] END AS INTEGER) AS b FROM m),
o AS (SELECT doc_id, surah, CASE WHEN surah IS NOT NULL THEN least(a, b) END AS ayah_start, CASE WHEN surah IS NOT NULL THEN greatest(a, b) END AS ayah_end, ayah_count FROM n LEFT JOIN quran_surahs q ON q.surah_no = n.surah),
e AS (SELECT *, CASE WHEN surah IS NULL THEN 'no_reference' WHEN ayah_count IS NULL THEN 'unknown_chapter' WHEN ayah_start < 1 OR ayah_end > ayah_count THEN 'verse_out_of_range' END AS error FROM o)
SELECT doc_id, surah, ayah_start, ayah_end, error, CASE WHEN error IS NULL THEN 'quran:' || surah || ':' || ayah_start || CASE WHEN ayah_end > ayah_start THEN '-' || ayah_end ELSE '' END END AS span_ref FROM e"""

_F27 = rf"""WITH t AS (SELECT id, {_COLLAPSED('text_plain')} AS t FROM tafsir_sections), c AS (SELECT *, substr(t, 1, 702) AS h, regexp_extract(substr(t, 1, 702), '(?s)^(.{{450,700}}?[.!?;،؛])(\s|$)', 1) AS cut FROM t)
SELECT id, CASE WHEN length(t) <= 700 THEN t WHEN cut <> '' THEN cut ELSE rtrim(substr(t, 1, 700), ' ') || '…' END AS excerpt FROM c"""

_H8 = f"""WITH {_LATEST}, w AS (SELECT id, language_code, surah_no, ayah_no, {sq.words(sq.norm('text_normalized'))} AS a, {sq.words(sq.norm("translate(" + _sql_light('text_normalized') + ", 'ىة', 'اه')"))} AS x FROM v WHERE text_normalized IS NOT NULL),
n AS (SELECT id, neighbour_id FROM (@)),
p AS (SELECT q.id, r.id AS neighbour_id, q.a, r.a AS b, q.x, r.x AS y, len(q.a) AS m, len(r.a) AS k FROM w q JOIN w r ON q.language_code = r.language_code AND q.id <> r.id AND NOT (q.surah_no = r.surah_no AND q.ayah_no = r.ayah_no) AND abs(len(q.a) - len(r.a)) <= 1 WHERE len(q.a) >= 4),
o AS (SELECT id, neighbour_id FROM p WHERE (m = k AND len(list_filter(range(1, m + 1), lambda i: a[i] <> b[i])) <= 1)
OR (m = k + 1 AND len(list_filter(range(1, m + 1), lambda i: list_concat(a[1:i - 1], a[i + 1:]) = b)) > 0) OR (k = m + 1 AND len(list_filter(range(1, k + 1), lambda i: list_concat(b[1:i - 1], b[i + 1:]) = a)) > 0)),
z AS (SELECT DISTINCT * FROM (SELECT * FROM n UNION ALL SELECT * FROM o)),
j AS (SELECT z.id, z.neighbour_id, q.a, r.a AS b, q.x, r.x AS y, len(q.a) AS m, len(r.a) AS k FROM z JOIN w q ON q.id = z.id JOIN w r ON r.id = z.neighbour_id WHERE NOT (q.surah_no = r.surah_no AND q.ayah_no = r.ayah_no)),
f AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(a), lambda t: greatest(0, len(list_filter(a, lambda c: c = t)) - len(list_filter(b, lambda c: c = t))))), 0) AS missing,
coalesce(list_sum(list_transform(list_distinct(x), lambda t: greatest(0, len(list_filter(x, lambda c: c = t)) - len(list_filter(y, lambda c: c = t))))), 0) AS missing_x FROM j)
SELECT id, neighbour_id, missing, CASE WHEN m = k THEN len(list_filter(range(1, m + 1), lambda i: a[i] <> b[i])) <= 1 WHEN m = k + 1 THEN len(list_filter(range(1, m + 1), lambda i: list_concat(a[1:i - 1], a[i + 1:]) = b)) > 0
WHEN k = m + 1 THEN len(list_filter(range(1, k + 1), lambda i: list_concat(b[1:i - 1], b[i + 1:]) = a)) > 0 ELSE false END AS one_edit,
len(a) >= 6 AND least(missing, missing_x) <= 4 AND greatest(coalesce(len(list_intersect(list_distinct(a), b)) * 100.0 / nullif(len(list_distinct(a)), 0), 0.0), coalesce(len(list_intersect(list_distinct(x), y)) * 100.0 / nullif(len(list_distinct(x)), 0), 0.0)) >= 50 AS relaxed_parallel FROM f"""


def _sql_built_units() -> str:
    role = f"""CASE WHEN {_has('lower(t)', 'do not', 'beware', 'shall not', 'should not', 'must not', 'none of you', 'whoever', 'the best', 'best of')} THEN 'direct_moral_instruction'
WHEN {_has('lower(t)', 'beware', 'warning', 'punishment', 'do not', 'forbidden', 'woe')} THEN 'warning' WHEN {_has('lower(t)', 'best', 'virtue', 'reward', 'superior', 'believer', 'good deed', 'patience is')} THEN 'virtue_statement' ELSE 'narrative_incident' END"""
    told = _has("lower(t)", "while we were", "then a man", "thereupon", "they asked", "she asked", "he asked", "during", "journey", "campaign", "battle", "wives of the prophet", "noticed anger on his face")
    cs = f"""list_filter([CASE WHEN {_has('lower(t)', 'the household', 'the roof')} THEN 'household' END, CASE WHEN {_has('lower(t)', 'the market', 'the merchant', 'coin')} THEN 'trade' END,
CASE WHEN {_has('lower(t)', 'the word', 'the phrase', 'the idiom')} THEN 'speech' END, CASE WHEN {_has('lower(t)', 'the lamp', 'the lantern')} THEN 'light' END], lambda z: z IS NOT NULL)"""
    clip = lambda x: f"CAST(greatest(0.0, least(1.0, round({x}, 3))) AS DOUBLE)"
    active = "role IN ('direct_moral_instruction', 'warning', 'virtue_statement')"
    direct = f"CASE role WHEN 'direct_moral_instruction' THEN 0.74 WHEN 'warning' THEN 0.68 WHEN 'virtue_statement' THEN 0.66 ELSE 0.26 END + CASE WHEN {_has('lower(t)', 'the prophet', 'allah' + chr(39) * 2 + 's messenger')} THEN 0.06 ELSE 0 END + CASE WHEN length(t) <= 220 THEN 0.06 WHEN length(t) >= 700 THEN -0.14 WHEN length(t) >= 420 THEN -0.08 ELSE 0 END"
    answer = f"0.28 + 0.12 * least(nc, 2) + 0.18 * conf + CASE WHEN {active} THEN 0.1 ELSE 0 END + CASE WHEN length(t) <= 240 THEN 0.06 WHEN length(t) >= 500 THEN -0.08 ELSE 0 END"
    story = f"CASE WHEN role = 'narrative_incident' THEN 0.14 ELSE 0.03 END + CASE WHEN {told} THEN 0.12 ELSE 0 END + CASE WHEN length(t) >= 700 THEN 0.24 WHEN length(t) >= 360 THEN 0.12 ELSE 0 END"
    scored = lambda src: f"""(SELECT *, {clip(f"0.34 * conf + 0.22 * directness + 0.22 * answerability + CASE WHEN nc > 0 THEN least(0.22, 0.12 * nc) ELSE 0 END + CASE WHEN {active} THEN 0.12 ELSE -0.02 END - 0.22 * narrative")} AS rank_score FROM (SELECT *, {clip(direct)} AS directness, {clip(answer)} AS answerability, {clip(story)} AS narrative
FROM (SELECT *, {role} AS role FROM {src})))"""  # noqa: E731
    return rf"""WITH e AS (SELECT id, english_text, list_filter(string_split(regexp_replace({_COLLAPSED('english_text')}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM hadith_entries),
g AS (SELECT id, s, unnest([1, 2, 3]) AS k FROM e), w0 AS (SELECT id, s, k, unnest(range(1, len(s) - k + 2)) AS i FROM g WHERE len(s) >= k),
w AS (SELECT id, i - 1 AS a, i - 1 + k AS b, array_to_string(s[i:i + k - 1], ' ') AS t FROM w0), c AS (SELECT *, {cs} AS cs FROM w WHERE length(t) >= 28), d AS (SELECT *, len(cs) AS nc, CASE WHEN len(cs) > 0 THEN 0.9 ELSE 0.0 END AS conf FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank_score DESC, answerability DESC, directness DESC, a, b) AS rank FROM {scored('d')} WHERE rank_score >= 0.34 QUALIFY rank <= 3),
f AS (SELECT id, english_text AS t, [] AS cs, 0 AS nc, 0.0 AS conf FROM hadith_entries WHERE trim(coalesce(english_text, ''), ' ') <> '' AND id NOT IN (SELECT id FROM k))
SELECT id, t AS span_text, role AS guidance_role, array_to_string(cs, ',') AS concepts, directness, answerability, narrative, rank_score, rank FROM k
UNION ALL SELECT id, t, role, '', directness, answerability, narrative, rank_score, 1 FROM {scored('f')}"""


def _sql_h8() -> str:
    from quillon.plans.q_retrieval import _J09

    return _H8.replace("@", _J09)


QUERIES: dict = {}
ORACLES = {"x49_unit_topics": _X49, "x51_unit_concepts": _X51, "m13_entry_topics": _M13, "m06_directive_labels": _M06, "p25_resolved_references": _P25, "f27_excerpts": _F27, "w04_built_units": _sql_built_units(), "h8_one_edit_verses": _sql_h8()}
