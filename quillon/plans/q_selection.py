"""Queries of choices, small scalars, ranks and bookkeeping. Constants of the SQL are typed out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import collections as cx
from quillon.functions import text as tx
from quillon.operators import fusion, quotes, retrieval, rules, search, selection
from quillon.plans import pipelines
from quillon.plans import sqltext as sq
from quillon.plans.q_retrieval import _J09, j09_verse_neighbours
from quillon.plans.q_spans import _LATEST, verses
from quillon.sources.tables import table

_UNITS = "SELECT DISTINCT ON (guidance_unit_id) * FROM guidance_units ORDER BY guidance_unit_id"


def _units(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])


def x54_query_shapes(spark: SparkSession, root: str) -> DataFrame:
    """Shape and profile of the test questions; of those without one, of their passage."""
    text = F.coalesce("question", "passage")
    return table(spark, root, "eval_items").select("item_id", selection.query_shape(text).alias("shape"), selection.query_profile(text, F.col("suite"), {"reading": "guidance"}).alias("profile"))


_X54 = r"""WITH t AS (SELECT item_id, suite, lower(coalesce(question, passage, '')) AS t FROM eval_items)
SELECT item_id, CASE WHEN regexp_matches(t, '\bhow\b|\bdescribe\b|\bdescription\b|\bmethod\b|\bway\b|\bprocedure\b|\bshow me\b|\bwhat is it like\b|\bwhat did (?:the prophet|the messenger|he)\s+(?:do|pray|perform|recite|used to)\b|\bwhat (?:was|were) (?:the prophet''?s|his)\s+(?:practice|habit|routine|way|manner|custom)\b|\bused to (?:do|pray|perform|recite)\b') THEN 'procedural_descriptive'
WHEN regexp_matches(t, '\bwhat did the prophet\s+(?:say|teach|advise|command)\b|\bwhat does the prophet\s+(?:say|teach)\b|\bwhat did the messenger\s+(?:say|teach)\b|\bdid the prophet\s+(?:say|teach|advise|warn|command|mention)\b|\bprophet''?s\s+(?:teaching|guidance|advice|command)\b|\baccording to the prophet\b') THEN 'prophetic_teaching'
WHEN regexp_matches(t, '\bpunishment\b|\bforbid\b|\bforbidden\b|\bharam\b|\bprohibit|\brulings?\b|\bwarn|\bsin\b|\bpenalty\b|\bis it (haram|allowed|permissible)\b') THEN 'ruling_warning'
WHEN regexp_matches(t, '\bvirtues?\b|\bmerits?\b|\breward\b|\bblessings?\b|\bbenefit|\bexcellenc') THEN 'virtue' ELSE 'broad' END AS shape,
CASE WHEN regexp_matches(t, 'warning|punishment|danger|consequence|avoid|stay away from') THEN 'warning' WHEN regexp_matches(t, 'virtue|benefit|merit|best of|reward of|excellence of') THEN 'virtue' WHEN suite = 'reading' THEN 'guidance' ELSE 'general_topic' END AS profile FROM t"""


def x38_role_bonuses(spark: SparkSession, root: str) -> DataFrame:
    """Bonuses and thresholds of every unit for questions of each shape, family and profile that its data name."""
    u = _units(spark, root).withColumn("role", search.unit_role(F.col("guidance_role")))
    shape = F.when(F.size("central_concept_ids") == 0, "procedural_descriptive").when(F.size("central_concept_ids") == 1, "prophetic_teaching").when(F.size("central_concept_ids") == 2, "ruling_warning").otherwise("virtue")
    family = F.when(F.col("topic_family") == "travel", "narrative_event").when(F.col("topic_family") == "charity", "ritual_practice").when(F.col("topic_family") == "trade", "entity_eschatology").otherwise("general_topic")
    profile = F.when(F.col("topic_family") == "honesty", "prophetic_guidance").when(F.col("topic_family") == "kinship", "warning").when(F.col("topic_family") == "patience", "virtue").otherwise("guidance")
    u = u.withColumn("shape", shape).withColumn("family", family).withColumn("profile", profile)
    t = selection.thresholds(F.col("family"), F.col("profile"), F.size("secondary_concept_ids") > 0)
    rows = u.select("guidance_unit_id", selection.shape_bonus(F.col("shape"), F.col("role")).alias("by_shape"), selection.role_bonus(F.col("shape"), F.col("family"), F.col("profile"), F.col("role")).alias("by_role"), t.alias("t"))
    return rows.select("guidance_unit_id", "by_shape", "by_role", F.col("t.score").alias("least_score"), F.col("t.answer").alias("least_answer"), F.col("t.central").alias("least_central"))


_X38 = f"""WITH u AS (SELECT guidance_unit_id, len(central_concept_ids) AS n, len(secondary_concept_ids) AS m, coalesce(topic_family, '') AS f, CASE WHEN trim(coalesce(guidance_role, '')) IN ('', 'narrative_context') THEN 'narrative_incident' ELSE trim(guidance_role) END AS r FROM ({_UNITS}))
SELECT guidance_unit_id, CASE WHEN n = 0 THEN CASE r WHEN 'narrative_incident' THEN 0.14 WHEN 'direct_moral_instruction' THEN 0.04 WHEN 'warning' THEN -0.04 WHEN 'virtue_statement' THEN -0.04 ELSE 0.0 END
WHEN n = 1 THEN CASE r WHEN 'direct_moral_instruction' THEN 0.14 WHEN 'virtue_statement' THEN 0.06 WHEN 'warning' THEN 0.06 WHEN 'narrative_incident' THEN -0.04 ELSE 0.0 END
WHEN n = 2 THEN CASE r WHEN 'warning' THEN 0.14 WHEN 'direct_moral_instruction' THEN 0.08 WHEN 'narrative_incident' THEN -0.02 ELSE 0.0 END
ELSE CASE r WHEN 'virtue_statement' THEN 0.14 WHEN 'direct_moral_instruction' THEN 0.06 WHEN 'narrative_incident' THEN -0.02 ELSE 0.0 END END AS by_shape,
CASE WHEN n = 0 THEN 0.0 WHEN f = 'trade' THEN CASE r WHEN 'narrative_incident' THEN 0.06 ELSE -0.02 END WHEN f IN ('travel', 'charity') THEN CASE r WHEN 'narrative_incident' THEN 0.1 ELSE 0.0 END
WHEN f = 'honesty' THEN CASE WHEN r IN ('direct_moral_instruction', 'virtue_statement', 'warning') THEN 0.12 WHEN r = 'narrative_incident' THEN -0.08 ELSE 0.0 END
WHEN f = 'kinship' THEN CASE WHEN r IN ('warning', 'direct_moral_instruction') THEN 0.1 WHEN r = 'narrative_incident' THEN -0.06 ELSE 0.0 END WHEN f = 'patience' THEN CASE r WHEN 'virtue_statement' THEN 0.1 WHEN 'narrative_incident' THEN -0.06 ELSE 0.0 END
ELSE CASE WHEN r IN ('direct_moral_instruction', 'virtue_statement', 'warning') THEN 0.06 WHEN r = 'narrative_incident' THEN -0.04 ELSE 0.0 END END AS by_role,
CASE f WHEN 'trade' THEN 0.46 WHEN 'travel' THEN 0.44 WHEN 'charity' THEN 0.48 ELSE CASE WHEN m = 0 THEN 0.7 WHEN f = 'honesty' THEN 0.64 ELSE 0.61 END END AS least_score,
CASE f WHEN 'trade' THEN 0.42 WHEN 'travel' THEN 0.38 WHEN 'charity' THEN 0.4 ELSE CASE WHEN m = 0 THEN 0.56 WHEN f = 'honesty' THEN 0.58 ELSE 0.55 END END AS least_answer,
CASE f WHEN 'trade' THEN 0.5 WHEN 'travel' THEN 0.46 WHEN 'charity' THEN 0.48 ELSE CASE WHEN m = 0 THEN 0.62 WHEN f = 'honesty' THEN 0.62 ELSE 0.58 END END AS least_central FROM u"""


def a28_judged_units(spark: SparkSession, root: str) -> DataFrame:
    """Relevance of each entry's best unit, judged by the concepts of the entry's other units."""
    u = _units(spark, root)
    best = fusion.keep_first(u, ["parent_hadith_ref"], F.col("answerability_score").desc_nulls_last(), "guidance_unit_id")
    none = F.array().cast("array<string>")
    acceptable = F.when(F.col("topic_family") == "charity", F.array("parent_hadith_ref")).when(F.col("topic_family").isNull(), F.array(F.lit("none"))).otherwise(none)
    bad = F.when(F.col("guidance_role") == "narrative_context", F.array("parent_hadith_ref")).otherwise(none)
    return best.select("parent_hadith_ref", selection.relevance(F.col("parent_hadith_ref"), acceptable, bad, F.coalesce("central_concept_ids", none), F.coalesce("secondary_concept_ids", none)).alias("x")).select("parent_hadith_ref", "x.*")


_A28 = f"""WITH b AS (SELECT * FROM ({_UNITS}) QUALIFY row_number() OVER (PARTITION BY parent_hadith_ref ORDER BY answerability_score DESC NULLS LAST, guidance_unit_id) = 1),
j AS (SELECT parent_hadith_ref, topic_family IS NOT NULL AS top1_ok, coalesce(guidance_role = 'narrative_context', false) AS bad_hit, coalesce(list_has_any(central_concept_ids, secondary_concept_ids), false) AS topic_overlap FROM b)
SELECT *, (top1_ok OR topic_overlap) AND NOT bad_hit AS passed FROM j"""


def pr17_backfill_gates(spark: SparkSession, root: str) -> DataFrame:
    """The neighbours that pass the gates of strong, passage and verse backfill."""
    n = j09_verse_neighbours(spark, root)
    status = F.when(F.col("coverage") >= 95, "exact").when(F.col("coverage") >= 70, "close").otherwise("weak")
    gate = lambda s, c: (F.col("score") >= s) & (F.col("coverage") >= c)
    return n.select("id", "neighbour_id", (status.isin("exact", "close") & gate(60, 80)).alias("strong"), gate(19, 65).alias("passage_backfill"), gate(15, 50).alias("verse_backfill"))


_P17 = f"SELECT id, neighbour_id, coverage >= 70 AND score >= 60 AND coverage >= 80 AS strong, score >= 19 AND coverage >= 65 AS passage_backfill, score >= 15 AND coverage >= 50 AS verse_backfill FROM ({_J09})"


def pr05_chapter_attributes(spark: SparkSession, root: str) -> DataFrame:
    """Per work and chapter the first non-blank name, translation and invocation in verse order."""
    return selection.first_filled(table(spark, root, "quran_ayahs"), ["work_id", "surah_no"], ["ayah_no", "id"], ["surah_name_ar", "translation_name", "bismillah"])


_P05 = f"""SELECT work_id, surah_no, count(*) AS n_rows, {', '.join(f"arg_min(nullif(trim({c}), ''), (ayah_no, id)) FILTER (trim({c}) <> '') AS {c}" for c in ('surah_name_ar', 'translation_name', 'bismillah'))} FROM quran_ayahs GROUP BY ALL"""


def pr04_preferred_verses(spark: SparkSession, root: str) -> DataFrame:
    """The verses of the first Arabic work, topped up with those of the other ones by the least id."""
    v = verses(spark, root).where("language_code = 'ar'").select("work_id", "surah_no", "ayah_no", "id")
    first = v.agg(F.min("work_id").alias("work_id"))
    one = v.join(first, "work_id", "left_semi")
    rest = fusion.keep_first(v.join(first, "work_id", "left_anti"), ["surah_no", "ayah_no"], "id")
    return selection.with_fallback(one, rest.select(*one.columns), ["surah_no", "ayah_no"])


_P04 = f"""WITH {_LATEST}, a AS (SELECT work_id, surah_no, ayah_no, id FROM v WHERE language_code = 'ar'), f AS (SELECT * FROM a WHERE work_id = (SELECT min(work_id) FROM a)),
o AS (SELECT * FROM a WHERE work_id <> (SELECT min(work_id) FROM a) QUALIFY row_number() OVER (PARTITION BY surah_no, ayah_no ORDER BY id) = 1)
SELECT *, 'preferred' AS origin FROM f UNION ALL SELECT *, 'other' FROM o WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.surah_no = o.surah_no AND f.ayah_no = o.ayah_no)"""


def x09_preferred_lanes(spark: SparkSession, root: str) -> DataFrame:
    """Which of two results leads and by which rule, with a unit's scores as the two results."""
    u = _units(spark, root).where("directness_score IS NOT NULL AND answerability_score IS NOT NULL")
    level = lambda c: F.when(F.col(c) >= 0.6, 3).when(F.col(c) >= 0.4, 2).when(F.col(c) >= 0.2, 1).otherwise(0)
    a = {"rank": level("directness_score"), "score": F.round(F.col("directness_score") * 100, 1), "unit": F.when(F.size("central_concept_ids") > 0, 2).otherwise(1), "contains": F.size("secondary_concept_ids") > 0}
    b = {"rank": level("answerability_score"), "score": F.round(F.col("answerability_score") * 100, 1), "unit": F.when(F.col("topic_family").isNull(), 2).otherwise(1), "several": F.col("span_end") - F.col("span_start") > 1}
    return u.select("guidance_unit_id", rules.preferred_lane(a, b, F.size(tx.words(tx.normalize_search(F.col("span_text"))))).alias("x")).select("guidance_unit_id", "x.lane", "x.rule")


_X09 = f"""WITH u AS (SELECT guidance_unit_id, CASE WHEN directness_score >= 0.6 THEN 3 WHEN directness_score >= 0.4 THEN 2 WHEN directness_score >= 0.2 THEN 1 ELSE 0 END AS ar, round(directness_score * 100, 1) AS sa, CASE WHEN len(central_concept_ids) > 0 THEN 2 ELSE 1 END AS au,
len(secondary_concept_ids) > 0 AS ac, CASE WHEN answerability_score >= 0.6 THEN 3 WHEN answerability_score >= 0.4 THEN 2 WHEN answerability_score >= 0.2 THEN 1 ELSE 0 END AS br, round(answerability_score * 100, 1) AS sb, CASE WHEN topic_family IS NULL THEN 2 ELSE 1 END AS bu,
span_end - span_start > 1 AS bs, len({sq.match_words('span_text')}) AS n FROM ({_UNITS}) WHERE directness_score IS NOT NULL AND answerability_score IS NOT NULL),
t AS (SELECT *, ar = br AND au <> bu AND (ar = 3 OR (abs(sa - sb) <= 5 AND least(sa, sb) >= 60)) AS un FROM u),
r AS (SELECT guidance_unit_id, CASE WHEN br > ar THEN 'b:status' WHEN ar > br THEN 'a:status' WHEN ar <= 1 AND br <= 1 THEN 'a:both_weak' WHEN un AND au > bu THEN 'a:unit' WHEN un THEN 'b:unit' WHEN ac AND sa >= sb - 8 THEN 'a:contains_query'
WHEN n >= 6 AND bs AND sb >= sa - 5 THEN 'b:long_query' WHEN sa >= sb + 5 THEN 'a:score' WHEN bs AND sb >= sa + 3 AND n >= 5 THEN 'b:score' ELSE 'a:default' END AS x FROM t)
SELECT guidance_unit_id, split_part(x, ':', 1) AS lane, split_part(x, ':', 2) AS rule FROM r"""


def x42_fused_scores(spark: SparkSession, root: str) -> DataFrame:
    """Overlap coefficient of a unit's concepts and words, its scores saturated and fused."""
    u = _units(spark, root).select("guidance_unit_id", F.array_distinct(tx.words(tx.normalize_search(F.col("span_text")))).alias("w"), F.coalesce("central_concept_ids", F.array().cast("array<string>")).alias("c"), "span_start", "directness_score")
    fused = retrieval.fuse_scores(F.col("span_start").cast("double"), F.col("directness_score"))
    return u.select("guidance_unit_id", F.round(retrieval.overlap_coefficient(F.col("c"), F.col("w")), 6).alias("overlap"), F.round(retrieval.saturate(F.col("span_start").cast("double")), 6).alias("saturated"), fused.alias("fused"))


_SAT = "CASE WHEN coalesce(span_start, 0) <= 0 THEN 0.0 WHEN span_start <= 1 THEN span_start ELSE span_start / (span_start + 4) END"
_X42 = f"""WITH u AS (SELECT *, list_distinct({sq.match_words('span_text')}) AS w, coalesce(central_concept_ids, []) AS c FROM ({_UNITS}))
SELECT guidance_unit_id, round(CASE WHEN least(len(c), len(w)) > 0 THEN len(list_intersect(c, w)) / least(len(c), len(w)) ELSE 0.0 END, 6) AS overlap, round({_SAT}, 6) AS saturated, round(0.66 * ({_SAT}) + 0.34 * coalesce(directness_score, 0.0), 4) AS fused FROM u"""


def a22_best_units(spark: SparkSession, root: str) -> DataFrame:
    """The best row of each unit, the best unit of each entry, the best 60 entries, with shortened text."""
    u = table(spark, root, "guidance_units").where("answerability_score IS NOT NULL").select("guidance_unit_id", "parent_hadith_ref", F.col("answerability_score").alias("score"), "span_text")
    return pipelines.best_units(u, "guidance_unit_id", "parent_hadith_ref", "score", 60).withColumn("span_text", tx.truncate(F.col("span_text"), 280))


_A22 = """WITH o AS (SELECT DISTINCT ON (guidance_unit_id) guidance_unit_id, parent_hadith_ref, answerability_score AS score, trim(coalesce(span_text, ''), ' ') AS t FROM guidance_units WHERE answerability_score IS NOT NULL ORDER BY guidance_unit_id, answerability_score DESC),
b AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY parent_hadith_ref ORDER BY score DESC, guidance_unit_id) = 1)
SELECT guidance_unit_id, parent_hadith_ref, score, CASE WHEN length(t) <= 280 THEN t ELSE rtrim(substr(t, 1, 279), ' ') || '…' END AS span_text FROM b ORDER BY score DESC, parent_hadith_ref LIMIT 60"""


def g54_best_per_source(spark: SparkSession, root: str) -> DataFrame:
    """Three sections per work by length, of works whose longest one reaches 200 characters."""
    s = table(spark, root, "tafsir_sections").select("id", "work_id", F.length("text_plain").alias("n")).where("n IS NOT NULL")
    good = s.groupBy("work_id").agg(F.max("n").alias("m")).where("m >= 200").select("work_id")
    return fusion.top_k(s.join(good, "work_id", "left_semi"), ["work_id"], 3, F.col("n").desc(), "id")


_G54 = """SELECT id, work_id, length(text_plain) AS n, row_number() OVER (PARTITION BY work_id ORDER BY length(text_plain) DESC, id) AS rank FROM tafsir_sections
WHERE text_plain IS NOT NULL AND work_id IN (SELECT work_id FROM tafsir_sections GROUP BY work_id HAVING max(length(text_plain)) >= 200) QUALIFY rank <= 3"""


def w10_expanded_spans(spark: SparkSession, root: str) -> DataFrame:
    """Spans of at least two verses around the anchor verses of every third chapter's sections, up to two verses further on each side."""
    seeds = table(spark, root, "tafsir_sections").where("ayah_end = ayah_start").select("surah_no", F.col("ayah_start").alias("a"), F.col("ayah_end").alias("b"))
    chapters = table(spark, root, "quran_surahs").select("surah_no", F.col("ayah_count").alias("last"))
    return quotes.expanded_spans(seeds.join(chapters, "surah_no"), ["surah_no"], "a", "b", 2, 2, "last")


_W10 = """WITH s AS (SELECT DISTINCT t.surah_no, ayah_start AS a, ayah_end AS b, ayah_count AS last FROM tafsir_sections t JOIN quran_surahs USING (surah_no) WHERE ayah_end = ayah_start),
x AS (SELECT surah_no, unnest(range(greatest(1, a - 2), a + 1)) AS start_pos, b, last FROM s), y AS (SELECT surah_no, start_pos, unnest(range(b, least(b + 2, last) + 1)) AS end_pos FROM x WHERE least(b + 2, last) >= b)
SELECT DISTINCT surah_no, start_pos, end_pos FROM y WHERE end_pos - start_pos + 1 >= 2"""


def w14_first_stage(spark: SparkSession, root: str) -> DataFrame:
    """For each chapter the works found at the first of three stages: Arabic, English, any language."""
    v = verses(spark, root).where("work_id IS NOT NULL").select("surah_no", "work_id", "language_code").distinct()
    stages = [v.where(c).select("surah_no", "work_id") for c in ("language_code = 'ar'", "language_code = 'en'", "true")]
    return quotes.first_stage(stages, ["surah_no"])


_W14 = f"""WITH {_LATEST}, d AS (SELECT DISTINCT surah_no, work_id, language_code FROM v WHERE work_id IS NOT NULL), s AS (SELECT surah_no, work_id, 0 AS stage FROM d WHERE language_code = 'ar' UNION ALL SELECT surah_no, work_id, 1 FROM d WHERE language_code = 'en'
UNION ALL SELECT surah_no, work_id, 2 FROM d) SELECT * FROM s QUALIFY stage = min(stage) OVER (PARTITION BY surah_no)"""

def pr22_confidence_policy(spark: SparkSession, root: str) -> DataFrame:
    """Units as results: their status and confidence after the policy, with its reasons."""
    u = _units(spark, root)
    lane = F.when(F.col("span_end") - F.col("span_start") > 1, "passage").otherwise("ayah")
    engine = F.when(F.size("central_concept_ids") > 0, "giant_exact_anchor").when(F.col("topic_family").isNull(), "surah_span_exact").otherwise("other")
    status = F.when(F.col("directness_score") >= 0.4, "exact").when(F.col("directness_score") >= 0.25, "close").otherwise("none")
    confidence = F.when(F.col("answerability_score") >= 0.45, "high").otherwise("low")
    x = selection.confidence_policy(lane, engine, status, confidence, F.col("span_end") - F.col("span_start") + 3, 100 - F.col("narrative_penalty") * 10, F.round(60 + F.col("answerability_score") * 60, 1))
    return u.select("guidance_unit_id", x.alias("x")).select("guidance_unit_id", "x.status", "x.confidence", "x.action", F.array_join("x.reasons", "|").alias("reasons"))


_PR22 = f"""WITH u AS (SELECT guidance_unit_id, CASE WHEN span_end - span_start > 1 THEN 'passage' ELSE 'ayah' END AS lane, CASE WHEN len(central_concept_ids) > 0 THEN 'g' WHEN topic_family IS NULL THEN 's' ELSE 'o' END AS eng,
CASE WHEN directness_score >= 0.4 THEN 'exact' WHEN directness_score >= 0.25 THEN 'close' ELSE 'none' END AS st, CASE WHEN answerability_score >= 0.45 THEN 'high' ELSE 'low' END AS cf, coalesce(span_end - span_start + 3, 0) AS w, coalesce(100 - narrative_penalty * 10, 0) AS c,
coalesce(round(60 + answerability_score * 60, 1), 0) AS s FROM ({_UNITS})),
r AS (SELECT *, CASE WHEN st = 'exact' AND lane = 'passage' AND eng = 'g' THEN CASE WHEN w < 5 THEN 'giant_exact_window_below_minimum' WHEN c < 99.5 THEN 'giant_exact_token_coverage_below_strict_threshold' WHEN s < 90 THEN 'giant_exact_score_below_strict_threshold'
ELSE 'giant_exact_strict_verified' END WHEN st = 'exact' AND lane = 'passage' AND eng = 's' THEN CASE WHEN w < 5 OR c < 98 OR s < 85 THEN 'surah_span_exact_evidence_softened' ELSE 'surah_span_exact_verified' END
WHEN st = 'exact' AND lane = 'ayah' THEN CASE WHEN s < 85 THEN 'ayah_exact_score_softened' ELSE 'ayah_exact_verified' END END AS f, cf = 'high' AND st <> 'exact' AS loose FROM u),
d AS (SELECT *, coalesce(ends_with(f, 'minimum') OR ends_with(f, 'threshold'), false) AS dem, coalesce(ends_with(f, 'softened'), false) AS sof FROM r)
SELECT guidance_unit_id, CASE WHEN dem THEN 'close' ELSE st END AS status, CASE WHEN dem OR sof OR loose THEN 'medium' ELSE cf END AS confidence, CASE WHEN dem THEN 'demoted' WHEN sof OR loose THEN 'confidence_softened' ELSE 'kept' END AS action,
coalesce(nullif(concat_ws('|', f, CASE WHEN loose THEN 'non_exact_high_confidence_softened' END), ''), 'no_change') AS reasons FROM d"""


def x56_script_routes(spark: SparkSession, root: str) -> DataFrame:
    """The route of every verse by the signs of fully marked text."""
    return table(spark, root, "quran_ayahs").select("id", selection.script_route(F.col("text_display")).alias("x")).select("id", "x.*")


_X56N = lambda p: f"len(regexp_extract_all(coalesce(text_display, ''), '{p}'))"
_X56 = rf"""WITH c AS (SELECT id, {_X56N(r'\x{0671}')} AS wa, {_X56N(r'[\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}]')} AS an, {_X56N('[٠-٩۰-۹]')} AS di, {_X56N('[﴾﴿]')} AS orn, {_X56N(r'[\x{06DE}\x{06E9}]')} AS sp, {_X56N(r'[\x{0654}-\x{065F}\x{0670}\x{06D6}-\x{06DC}]')} AS hi FROM quran_ayahs),
s AS (SELECT id, CASE WHEN wa > 0 THEN 5 ELSE 0 END + CASE WHEN an >= 2 THEN 4 ELSE 0 END AS strong, CASE WHEN orn > 0 THEN 1 ELSE 0 END + CASE WHEN sp > 0 THEN 1 ELSE 0 END + CASE WHEN di >= 2 THEN 1 ELSE 0 END + CASE WHEN hi >= 4 THEN 1 ELSE 0 END AS weak FROM c)
SELECT id, CASE WHEN strong > 0 THEN 'marked_first' ELSE 'plain_first' END AS route, strong, weak FROM s"""

# --- scalars ---


def f46_entry_scalars(spark: SparkSession, root: str) -> DataFrame:
    """Scalars of the entries."""
    e = table(spark, root, "hadith_entries")
    noted = F.concat_ws(" ", "english_narrator", F.concat(F.lit("[["), F.col("canonical_ref_collection"), F.lit("]]")), F.lit("and [[a note]]"), "matn_text")
    place = tx.book_and_number(F.concat(F.lit("Book "), F.col("book_id"), F.lit(", Hadith "), F.col("in_book_hadith_number")))
    grade = tx.grade_label(F.when(F.col("id") % 3 == 0, "Sahih (Darussalam)").when(F.col("id") % 3 == 1, "Hasan").otherwise("Da'if"))
    summary = tx.contextual_summary([F.col("english_narrator")], F.col("english_text"), F.array(F.lit("trust"), F.lit("patience")))
    return e.select(
        "id", tx.collapse(F.concat(F.lit("  "), F.col("english_narrator"), F.lit(" \t\n x "))).alias("collapsed"), F.array_join(tx.inline_notes(noted), "|").alias("notes"), F.md5(tx.without_inline_notes(noted)).alias("without"),
        place["book"].alias("book"), place["number"].alias("number"), grade.alias("grade"), summary.alias("summary"), F.size(tx.analysis_tokens(F.col("english_text"))).alias("n_tokens"), cx.iso_time(F.col("created_at")).alias("made"),
        tx.client_key(F.col("canonical_entry_id"), F.lit("agent")).alias("session_key"),
    )


_F46 = rf"""WITH e AS (SELECT *, concat_ws(' ', english_narrator, '[[' || canonical_ref_collection || ']]', 'and [[a note]]', matn_text) AS nt, trim(regexp_replace(concat_ws(' ', english_narrator, english_text), '[\s\p{{Z}}]+', ' ', 'g')) AS wh FROM hadith_entries)
SELECT id, trim(english_narrator || ' x') AS collapsed, canonical_ref_collection || '|a note' AS notes, md5(trim(regexp_replace(regexp_replace(nt, '\[\[.*?\]\]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g'))) AS without,
CASE WHEN in_book_hadith_number IS NOT NULL THEN book_id END AS book, CAST(in_book_hadith_number AS INTEGER) AS number, CASE id % 3 WHEN 0 THEN 'sahih' WHEN 1 THEN 'hasan' ELSE 'daif' END AS grade,
substr('[topics=trust, patience] ' || rtrim(regexp_extract(wh, '^(.*?[.!?])(\s|$)|^(.*)$', 0)), 1, 420) AS summary,
len(list_filter(regexp_extract_all(lower(coalesce(english_text, '')), '[a-z]{{3,}}'), lambda t: NOT list_contains(['a', 'an', 'the', 'and', 'or', 'but', 'of', 'in', 'on', 'to', 'for', 'from', 'with', 'what', 'which', 'who', 'whom', 'whose', 'is', 'are', 'was', 'were', 'be',
'been', 'about', 'show', 'tell', 'me', 'does', 'do', 'did', 'there', 'any', 'this', 'that', 'these', 'those', 'it', 'its', 'can', 'could', 'would', 'should', 'explain', 'please'], t))) AS n_tokens,
strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS made, substr(sha1(canonical_entry_id || '|agent'), 1, 24) AS session_key FROM e"""


def a30_unit_collections(spark: SparkSession, root: str) -> DataFrame:
    """Array, map, JSON and lookup scalars of the units."""
    both = F.concat(F.coalesce("central_concept_ids", F.array().cast("array<string>")), F.coalesce("secondary_concept_ids", F.array().cast("array<string>")), F.array(F.lit(" trust "), F.lit(""), F.lit(None).cast("string"), F.lit("trust")))
    flags = F.create_map(F.lit("direct"), F.col("directness_score") > 0.5, F.lit("answers"), F.col("answerability_score") > 0.5, F.lit("story"), F.lit(None).cast("boolean"))
    phrases = cx.phrases_for(tx.words(tx.normalize_search(F.col("span_text"))), {"anger": ["do not get angry", "don't get angry"], "rizq": ["sustenance", "livelihood", "provisions", "provision"]})
    return _units(spark, root).select(
        "guidance_unit_id", F.array_join(cx.clean_distinct(both), "|").alias("cleaned"), cx.flag(flags, "direct").alias("direct"), cx.flag(flags, "none", True).alias("other"), F.array_join(cx.set_flags(flags), "|").alias("set_flags"),
        F.array_join(phrases, "|").alias("phrases"), cx.any_term(F.array(F.lit("two words"), F.col("topic_family"), F.lit("two words"))).alias("any_term"), cx.json_text(F.col("metadata"), "$.title", "$.english_narrator").alias("narrator"),
        cx.swap_prefix(F.col("parent_hadith_ref"), "hadith:", "h/").alias("swapped"), cx.named(F.col("guidance_role"), {"warning": "2", "virtue_statement": "3"}, "0").alias("ordinal"),
        cx.step(F.col("answerability_score"), [(0.9, 0.9), (0.7, 0.84), (0.5, 0.8), (0.3, 0.7)], 0.25).alias("ladder"),
    )


_A30 = rf"""WITH u AS (SELECT *, {sq.match_words('span_text')} AS w FROM ({_UNITS})), p AS (SELECT *, list_distinct(flatten(list_transform(list_filter(w, lambda t: t IN ('anger', 'angry', 'rizq', 'provision', 'provisions', 'sustenance', 'livelihood', 'rizk')),
lambda t: CASE WHEN t IN ('anger', 'angry') THEN ['do not get angry', 'don''t get angry'] ELSE ['sustenance', 'livelihood', 'provisions', 'provision'] END))) AS ph, list_concat(coalesce(central_concept_ids, []), coalesce(secondary_concept_ids, []), ['trust']) AS l FROM u)
SELECT guidance_unit_id, array_to_string(list_transform(list_sort(list_transform(list_distinct(l), lambda x: {{'i': list_position(l, x), 'x': x}})), lambda s: s.x), '|') AS cleaned, coalesce(directness_score > 0.5, false) AS direct, true AS other,
concat_ws('|', CASE WHEN answerability_score > 0.5 THEN 'answers' END, CASE WHEN directness_score > 0.5 THEN 'direct' END) AS set_flags, array_to_string(list_sort(ph), '|') AS phrases, concat_ws(' OR ', '"two words"', topic_family) AS any_term,
coalesce(TRY_CAST(metadata AS JSON) ->> '$.title', TRY_CAST(metadata AS JSON) ->> '$.english_narrator') AS narrator, regexp_replace(parent_hadith_ref, '^hadith:', 'h/') AS swapped, CASE lower(guidance_role) WHEN 'warning' THEN '2' WHEN 'virtue_statement' THEN '3' ELSE '0' END AS ordinal,
CASE WHEN answerability_score >= 0.9 THEN 0.9 WHEN answerability_score >= 0.7 THEN 0.84 WHEN answerability_score >= 0.5 THEN 0.8 WHEN answerability_score >= 0.3 THEN 0.7 ELSE 0.25 END AS ladder FROM p"""


def f36_citations(spark: SparkSession, root: str) -> DataFrame:
    """The title of every document read as a citation, its canonical form and its significant words."""
    aliases = {"measure of": "measures", "book": "books", "lamp": "lamps"}
    ref = tx.narration_reference(F.col("title"), aliases)
    rows = table(spark, root, "documents").select("doc_id", "title", ref.alias("r"), tx.canonical_reference(F.concat(F.lit("please see surat "), F.col("doc_id"), F.lit(" : 5, ayat")), ["please", "see"]).alias("canonical"))
    words = F.array_join(tx.significant_tokens(F.col("title"), ["measure"]), "|")
    return rows.select("doc_id", "r.collection", "r.book", "r.number", "canonical", words.alias("significant"))


_F36N = sq.norm("title")
_F36 = rf"""WITH n AS (SELECT doc_id, {_F36N} AS n, {sq.search_words('title')} AS s FROM documents), c AS (SELECT *, ' ' || n || ' ' AS p FROM n),
a AS (SELECT *, CASE WHEN contains(p, ' measure of ') THEN 'measures' WHEN contains(p, ' book ') OR contains(p, ' lamp ') THEN CASE WHEN contains(p, ' lamp ') AND (NOT contains(p, ' book ') OR instr(p, ' lamp ') < instr(p, ' book ')) THEN 'lamps' ELSE 'books' END END AS coll FROM c),
r AS (SELECT *, CASE WHEN regexp_matches(n, 'book\s+(\d+)\D{{1,12}}(?:hadith|number|no)\s*(\d+)') THEN [regexp_extract(n, 'book\s+(\d+)\D{{1,12}}(?:hadith|number|no)\s*(\d+)', 1), regexp_extract(n, 'book\s+(\d+)\D{{1,12}}(?:hadith|number|no)\s*(\d+)', 2)]
WHEN regexp_matches(n, '(\d+)\s*:\s*(\d+)') THEN [regexp_extract(n, '(\d+)\s*:\s*(\d+)', 1), regexp_extract(n, '(\d+)\s*:\s*(\d+)', 2)] WHEN regexp_matches(n, '(?:hadith|number|no)\s*(\d+)') THEN ['', regexp_extract(n, '(?:hadith|number|no)\s*(\d+)', 1)]
WHEN regexp_matches(n, '\b(\d+)\b') THEN ['', regexp_extract(n, '\b(\d+)\b', 1)] END AS g FROM a)
SELECT doc_id, CASE WHEN g IS NOT NULL THEN coll END AS collection, CASE WHEN coll IS NOT NULL AND g[1] <> '' THEN CAST(g[1] AS INTEGER) END AS book, CASE WHEN coll IS NOT NULL THEN CAST(g[2] AS INTEGER) END AS number, 'surah ' || doc_id || ':5 verse' AS canonical,
array_to_string(list_filter(list_distinct_ordered, lambda t: t <> 'measure'), '|') AS significant FROM (SELECT *, list_transform(list_sort(list_transform(list_distinct(x), lambda t: {{'i': list_position(x, t), 't': t}})), lambda z: z.t) AS list_distinct_ordered FROM (SELECT *,
flatten(list_transform(s, lambda t: CASE t WHEN 'patience' THEN ['patience', 'sabr'] WHEN 'mercy' THEN ['mercy', 'rahmah'] WHEN 'faith' THEN ['faith', 'iman'] WHEN 'hardship' THEN ['hardship', 'difficulty'] WHEN 'reliance' THEN ['reliance', 'tawakkul']
WHEN 'anger' THEN ['anger', 'angry', 'do not get angry', 'don''t get angry'] WHEN 'rizq' THEN ['rizq', 'provision', 'provisions', 'sustenance', 'livelihood'] WHEN 'intention' THEN ['intention', 'niyyah', 'intentions'] WHEN 'difficulty' THEN ['difficulty', 'hardship'] WHEN 'piety' THEN ['piety', 'taqwa'] ELSE [t] END)) AS x FROM r))"""

QUERIES = {
    f.__name__: f
    for f in (
        x54_query_shapes, x38_role_bonuses, a28_judged_units, pr17_backfill_gates, pr05_chapter_attributes, pr04_preferred_verses, x09_preferred_lanes, x42_fused_scores, a22_best_units, g54_best_per_source, w10_expanded_spans,
        w14_first_stage, pr22_confidence_policy, x56_script_routes, f46_entry_scalars, a30_unit_collections, f36_citations,
    )
}
ORACLES = {
    "x54_query_shapes": _X54, "x38_role_bonuses": _X38, "a28_judged_units": _A28, "pr17_backfill_gates": _P17, "pr05_chapter_attributes": _P05, "pr04_preferred_verses": _P04, "x09_preferred_lanes": _X09, "x42_fused_scores": _X42,
    "a22_best_units": _A22, "g54_best_per_source": _G54, "w10_expanded_spans": _W10, "w14_first_stage": _W14, "pr22_confidence_policy": _PR22, "x56_script_routes": _X56, "f46_entry_scalars": _F46, "a30_unit_collections": _A30, "f36_citations": _F36,
}
