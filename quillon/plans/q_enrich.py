"""Entries enriched by rules, with the SQL of every rule typed out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import enrich
from quillon.plans import sqltext as sq
from quillon.sources.tables import table

ALIASES = {"patience": ["patience", "patient", "hardship"], "trust": ["trust", "pledge", "promise"], "charity": ["charity", "mercy"], "rizq": ["provision", "harvest", "portion"], "anger": ["anger", "angry"]}


def g03_enriched_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries with topics, labels, role, specificity, centrality, flags and answerability."""
    e = table(spark, root, "hadith_entries").select("id", "book_id", "chapter_id", "english_text")
    b = table(spark, root, "hadith_books").select(F.col("id").alias("book_id"), F.col("title_en").alias("book_title"))
    c = table(spark, root, "hadith_chapters").select(F.col("id").alias("chapter_id"), F.col("title_en").alias("chapter_title"))
    rows = enrich.enriched(e.join(b, "book_id", "left").join(c, "chapter_id", "left"), "id", "english_text", "chapter_title", "book_title", ALIASES)
    return rows.select("id", *[F.array_join(x, "|").alias(x) for x in ("topics", "labels", "flags", "concepts")], "role", "specificity", "central", "answerability")


def _topic(name: str, aliases: list[str]) -> str:
    hit = ", ".join(f"CASE WHEN contains(a, '{x}') THEN '{x}' END" for x in aliases)
    return f"{{'h': list_filter([{hit}], lambda x: x IS NOT NULL), 't': '{name}', 'names': {sq.strings(aliases)}}}"


def _any(c: str, *markers: str) -> str:
    return "(" + " OR ".join(f"contains({c}, '{m}')" for m in markers) + ")"


_TOPICS = ", ".join(_topic(n, a) for n, a in (("patience", ["patience", "patient", "hardship"]), ("trust", ["trust", "pledge", "promise"]), ("charity", ["charity", "mercy"]), ("rizq", ["provision", "harvest", "portion"]), ("anger", ["anger", "angry"])))
_G03 = f"""WITH e AS (SELECT e.id, {sq.norm("concat_ws(' ', nullif(english_text, ''), nullif(c.title_en, ''), nullif(b.title_en, ''))")} AS a, {sq.norm("concat_ws(' ', nullif(english_text, ''), nullif(c.title_en, ''))")} AS tc, {sq.norm('english_text')} AS body,
{sq.norm("concat_ws(' ', nullif(c.title_en, ''), nullif(b.title_en, ''))")} AS ti, {sq.norm('c.title_en')} AS ch FROM hadith_entries e LEFT JOIN hadith_books b ON e.book_id = b.id LEFT JOIN hadith_chapters c ON e.chapter_id = c.id),
m AS (SELECT *, list_sort(list_transform(list_filter([{_TOPICS}], lambda x: len(x.h) > 0), lambda x: {{'n': -len(x.h), 't': x.t, 'h': x.h, 'names': x.names}})) AS m,
list_filter([CASE WHEN {_any('tc', 'do not ', 'do not get angry', 'do not become angry')} THEN 'prohibition' END, CASE WHEN {_any('tc', 'has ordered', 'ordered you')} THEN 'command' END,
CASE WHEN {_any('tc', 'best of you', 'the best', 'better than', 'better and more comprehensive')} THEN 'virtue' END, CASE WHEN {_any('tc', 'beware', 'woe', 'punishment')} THEN 'warning' END, CASE WHEN contains(tc, 'whoever') THEN 'guidance' END,
CASE WHEN contains(tc, 'ask whatever you want') THEN 'qa_exchange' END], lambda x: x IS NOT NULL) AS l0 FROM e),
l AS (SELECT *, CASE WHEN contains(' ' || tc || ' ', ' said ') AND NOT list_contains(l0, 'qa_exchange') THEN list_append(l0, 'story') ELSE l0 END AS labels FROM m),
r AS (SELECT *, m[1] AS p, CASE WHEN (list_contains(labels, 'qa_exchange') OR contains(ch, 'questions')) AND {_any('tc', 'prayer', 'zakat', 'fasts', 'ask whatever you want')} THEN 'narrative_incident'
WHEN list_has_any(labels, ['warning', 'prohibition']) AND {_any('tc', 'beware', 'woe', 'do not get angry', 'do not become angry')} THEN 'direct_moral_instruction' WHEN list_has_any(labels, ['warning', 'prohibition']) THEN 'warning'
WHEN list_contains(labels, 'virtue') THEN 'virtue_statement' WHEN list_contains(labels, 'command') THEN 'legal_specific_case' ELSE 'narrative_incident' END AS role FROM l),
s AS (SELECT *, greatest(0.0, least(1.0, round(CASE WHEN role IN ('direct_moral_instruction', 'virtue_statement') THEN 0.2 ELSE 0.45 END
+ CASE WHEN {_any('tc', 'while we were sitting', 'then a man came', 'the wives of the prophet', 'he said to them', 'thereupon', 'so this verse was revealed')} THEN 0.2 ELSE 0 END
+ CASE WHEN len({sq.words('tc')}) >= 80 THEN 0.15 ELSE 0 END + CASE WHEN contains(tc, 'so this verse was revealed') THEN 0.1 ELSE 0 END, 3))) AS specificity,
len(list_filter(p.names, lambda x: contains(ti, x))) > 0 AS title, coalesce(list_sum(list_transform(p.h, lambda x: (length(body) - length(replace(body, x, ''))) // length(x))), 0) AS hits, len({sq.words('body')}) AS n FROM r),
c AS (SELECT *, CASE WHEN p IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, round(0.18 + CASE WHEN title THEN 0.35 ELSE 0 END + CASE WHEN hits >= 2 THEN 0.25 WHEN hits = 1 THEN 0.1 ELSE 0 END
+ CASE WHEN role IN ('direct_moral_instruction', 'virtue_statement') THEN 0.18 ELSE 0 END + CASE WHEN {_any('body', 'the best', 'whoever', 'none is given', 'real patience', 'do not get angry', 'beware')} THEN 0.08 ELSE 0 END
+ CASE WHEN n <= 60 AND hits > 0 THEN 0.05 ELSE 0 END - CASE WHEN role = 'narrative_incident' AND NOT title THEN 0.18 ELSE 0 END, 3))) END AS central,
CASE WHEN p IS NULL THEN [] ELSE list_filter([CASE WHEN (hits <= 1 AND NOT title AND n >= 70) OR (p.t = 'anger' AND NOT contains(body, 'do not get angry') AND contains(body, 'anger on his face'))
OR (p.t = 'anger' AND contains(ch, 'questions') AND {_any('body', 'prayer', 'zakat', 'fasts')}) THEN 'incidental_mention_risk' END, CASE WHEN role = 'narrative_incident' AND NOT title THEN 'narrative_specific_risk' END,
CASE WHEN p.t = 'anger' AND NOT contains(body, 'do not get angry') AND hits <= 2 THEN 'anger_phrase_not_central' END, CASE WHEN p.t = 'rizq' AND contains(body, 'provision') AND contains(body, 'journey') THEN 'travel_provision_context' END], lambda x: x IS NOT NULL) END AS flags FROM s)
SELECT id, array_to_string(list_transform(m, lambda x: x.t), '|') AS topics, array_to_string(labels, '|') AS labels, array_to_string(flags, '|') AS flags,
array_to_string(list_concat(list_transform(m, lambda x: x.t), list_filter(labels, lambda x: x IN ('warning', 'virtue', 'guidance', 'prohibition', 'command'))), '|') AS concepts, role, specificity, central,
greatest(0.0, least(1.0, round(central + CASE WHEN role IN ('direct_moral_instruction', 'virtue_statement', 'warning') THEN 0.1 ELSE 0 END - CASE WHEN list_contains(flags, 'incidental_mention_risk') THEN 0.18 ELSE 0 END
- CASE WHEN list_contains(flags, 'narrative_specific_risk') THEN 0.12 ELSE 0 END - specificity * 0.12, 3))) AS answerability FROM c"""

QUERIES = {"g03_enriched_entries": g03_enriched_entries}
ORACLES = {"g03_enriched_entries": _G03}
