"""Small relational and state queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, quotes, rules, search, selection, spans
from quillon.plans import sqltext as sq
from quillon.plans.q_retrieval import _J09, j09_verse_neighbours
from quillon.plans.q_spans import _LATEST, CHAPTER, verses
from quillon.plans.q_text import _sql_light
from quillon.sources.tables import table

_UNITS = "SELECT DISTINCT ON (guidance_unit_id) * FROM guidance_units ORDER BY guidance_unit_id"


def _units(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])


def t10_ordered_works(spark: SparkSession, root: str) -> DataFrame:
    """The works of each domain in order of priority and id with their place, default ones first."""
    w = table(spark, root, "source_works").select("id", "source_domain", "priority_rank", "default_for_explain")
    return fusion.with_rank(w, ["source_domain"], F.col("default_for_explain").desc(), "priority_rank", "id")


_T10 = "SELECT id, source_domain, priority_rank, default_for_explain, row_number() OVER (PARTITION BY source_domain ORDER BY default_for_explain DESC, priority_rank, id) AS rank FROM source_works"


def a25_sizes_of_passages(spark: SparkSession, root: str) -> DataFrame:
    """Distinct passages by chapter and span, partitioned by size: how many there are and how many words they have."""
    w = spans.passage_windows(verses(spark, root).where("work_id IS NOT NULL"), CHAPTER, "ayah_no", "text_normalized", [2, 3, 4])
    one = fusion.keep_first(w, ["window_size", "surah_no", "start_pos"], "work_id")
    return one.groupBy("window_size").agg(F.count("*").alias("n"), F.sum(F.size(tx.words(tx.normalize_search(F.col("text"))))).alias("n_words"))


_A25 = " UNION ALL ".join(
    f"""SELECT {k} AS window_size, count(*) AS n, sum(len({sq.match_words('text')})) AS n_words FROM (SELECT * FROM (SELECT work_id, surah_no, ayah_no, max(ayah_no) OVER w AS e, count(*) OVER w AS c, string_agg(coalesce(text_normalized, ''), ' ') OVER w AS text FROM v
WHERE work_id IS NOT NULL WINDOW w AS (PARTITION BY work_id, surah_no ORDER BY ayah_no ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)) WHERE c = {k} AND e - ayah_no = {k - 1} QUALIFY row_number() OVER (PARTITION BY surah_no, ayah_no ORDER BY work_id) = 1)"""
    for k in (2, 3, 4)
)
_A25 = f"WITH {_LATEST} {_A25}"


def a44_changed_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Units of some collections whose stored narrator is distinct from the one of their entry, NULLs included."""
    e = table(spark, root, "hadith_entries").select(F.col("canonical_ref_collection").alias("parent_hadith_ref"), "english_narrator", F.col("book_id").isin(1, 2, 3).alias("wanted"))
    u = _units(spark, root).join(e, "parent_hadith_ref").where("wanted")
    stored = F.get_json_object("metadata", "$.english_narrator")
    return u.where(~stored.eqNullSafe(F.col("english_narrator"))).select("guidance_unit_id", stored.alias("stored"), "english_narrator")


_A44 = f"""SELECT guidance_unit_id, metadata ->> '$.english_narrator' AS stored, english_narrator FROM ({_UNITS}) u JOIN hadith_entries e ON e.canonical_ref_collection = u.parent_hadith_ref
WHERE book_id = ANY([1, 2, 3]) AND (metadata ->> '$.english_narrator') IS DISTINCT FROM english_narrator"""


def j13_exact_lookup(spark: SparkSession, root: str) -> DataFrame:
    """Verses for a displayed verse by its light form, else by its folded form, in its language."""
    v = verses(spark, root)
    f = v.select("language_code", "id", tx.arabic_light(F.col("text_normalized")).alias("l"), tx.arabic_aggressive(F.col("text_normalized")).alias("g")).where("l <> ''")
    q = v.where("id % 20 = 0").select("language_code", F.col("id").alias("query_id"), tx.arabic_light(F.col("text_display")).alias("l"), tx.arabic_aggressive(F.col("text_display")).alias("g")).where("l <> ''")
    by = lambda c: q.join(f, ["language_code", c]).select("query_id", "id", F.lit(c).alias("form"))
    light = by("l")
    return light.unionByName(by("g").join(light.select("query_id").distinct(), "query_id", "left_anti"))


_J13 = f"""WITH {_LATEST}, f AS (SELECT * FROM (SELECT language_code, id, {_sql_light('text_normalized')} AS l, translate({_sql_light('text_normalized')}, 'ىة', 'اه') AS g FROM v) WHERE l <> ''),
q AS (SELECT * FROM (SELECT language_code, id AS query_id, {_sql_light('text_display')} AS l, translate({_sql_light('text_display')}, 'ىة', 'اه') AS g FROM v WHERE id % 20 = 0) WHERE l <> ''),
a AS (SELECT query_id, id, 'l' AS form FROM q JOIN f USING (language_code, l)) SELECT * FROM a UNION ALL SELECT query_id, id, 'g' FROM q JOIN f USING (language_code, g) WHERE query_id NOT IN (SELECT query_id FROM a)"""


def j22_filled_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries with missing body texts and numbers filled from their first unit, and whether a unit was there."""
    e = table(spark, root, "hadith_entries").select(F.col("canonical_ref_collection").alias("ref"), F.col("in_book_hadith_number").cast("int").alias("number"), F.md5("matn_text").alias("body"))
    u = fusion.keep_first(_units(spark, root), ["parent_hadith_ref"], "guidance_unit_id").select(F.col("parent_hadith_ref").alias("ref"), F.col("span_start").alias("number"), F.md5("span_text").alias("body"), F.lit(True).alias("there"))
    filled = selection.fill_missing(e, u, ["ref"], ["number", "body"])
    return filled.join(u.select("ref", "there"), "ref", "left").select("ref", "number", "body", F.coalesce("there", F.lit(False)).alias("has_unit"))


_J22 = f"""WITH u AS (SELECT DISTINCT ON (parent_hadith_ref) parent_hadith_ref, span_start, span_text FROM ({_UNITS}) ORDER BY parent_hadith_ref, guidance_unit_id)
SELECT canonical_ref_collection AS ref, coalesce(CAST(in_book_hadith_number AS INTEGER), span_start) AS number, coalesce(md5(matn_text), md5(span_text)) AS body, parent_hadith_ref IS NOT NULL AS has_unit FROM hadith_entries e LEFT JOIN u ON u.parent_hadith_ref = e.canonical_ref_collection"""


def pr24_checked_ranges(spark: SparkSession, root: str) -> DataFrame:
    """sections' spans as ranges with a limit, checked against their chapter; sections of one kind ask for the whole chapter."""
    s = table(spark, root, "tafsir_sections").select("id", "surah_no", "ayah_start", "ayah_end")
    rows = s.join(table(spark, root, "quran_surahs").select("surah_no", "ayah_count"), "surah_no", "left")
    start = F.when(F.col("id") % 7 != 0, F.col("ayah_start"))
    x = selection.checked_range(start, F.col("ayah_end"), F.col("id") % 23, F.when(F.col("id") % 31 != 0, F.col("ayah_count")))
    return rows.select("id", x.alias("x")).select("id", "x.*")


_P24 = """WITH r AS (SELECT id, CASE WHEN id % 7 = 0 THEN 1 ELSE ayah_start END AS first, CASE WHEN id % 31 <> 0 THEN ayah_count END AS n, CASE WHEN id % 7 = 0 THEN CASE WHEN id % 31 <> 0 THEN ayah_count END ELSE coalesce(ayah_end, ayah_start) END AS last
FROM tafsir_sections t LEFT JOIN quran_surahs q USING (surah_no)) SELECT id, first, last, CASE WHEN n IS NULL THEN 'unknown_chapter' WHEN first < 1 THEN 'start_too_small' WHEN last < first THEN 'end_before_start' WHEN last > n THEN 'beyond_chapter'
WHEN id % 23 < 1 OR id % 23 > 20 THEN 'bad_limit' END AS error FROM r"""


def x12_chosen_evaluation(spark: SparkSession, root: str) -> DataFrame:
    """Per entry the evaluation that leads, strong ones first, then by status, confidence, score and coverage, with the number of alternatives."""
    u = _units(spark, root).where("directness_score IS NOT NULL AND answerability_score IS NOT NULL AND narrative_penalty IS NOT NULL")
    status = F.when(F.col("directness_score") >= 0.6, 3).when(F.col("directness_score") >= 0.4, 2).otherwise(1)
    u = u.select("parent_hadith_ref", "guidance_unit_id", ((status >= 2) & (F.col("answerability_score") >= 0.5)).alias("strong"), status.alias("status"), "answerability_score", "directness_score", "narrative_penalty")
    n = u.groupBy("parent_hadith_ref").agg((F.count("*") - 1).alias("n_alternatives"))
    best = fusion.keep_first(u, ["parent_hadith_ref"], F.col("strong").desc(), F.col("status").desc(), F.col("answerability_score").desc(), F.col("directness_score").desc(), "narrative_penalty", "guidance_unit_id")
    return best.join(n, "parent_hadith_ref").select("parent_hadith_ref", "guidance_unit_id", "strong", "status", "n_alternatives")


_X12 = f"""WITH u AS (SELECT *, CASE WHEN directness_score >= 0.6 THEN 3 WHEN directness_score >= 0.4 THEN 2 ELSE 1 END AS status FROM ({_UNITS}) WHERE directness_score IS NOT NULL AND answerability_score IS NOT NULL AND narrative_penalty IS NOT NULL)
SELECT parent_hadith_ref, guidance_unit_id, status >= 2 AND answerability_score >= 0.5 AS strong, status, count(*) OVER (PARTITION BY parent_hadith_ref) - 1 AS n_alternatives FROM u
QUALIFY row_number() OVER (PARTITION BY parent_hadith_ref ORDER BY status >= 2 AND answerability_score >= 0.5 DESC, status DESC, answerability_score DESC, directness_score DESC, narrative_penalty, guidance_unit_id) = 1"""


def x30_proxy_scores(spark: SparkSession, root: str) -> DataFrame:
    """Centrality, answerability and specificity of units from a rank score, by their ground, directness and family."""
    u = _units(spark, root).where("span_start IS NOT NULL")
    x = selection.proxy_scores(1.0 / (60 + F.col("span_start")) + F.when(F.col("topic_family").isNull(), 0.0).otherwise(1.0 / 61), F.size("central_concept_ids") > 0, F.coalesce(F.col("guidance_role") == "direct_moral_instruction", F.lit(False)), F.coalesce(F.col("topic_family") == "travel", F.lit(False)))
    return u.select("guidance_unit_id", x.alias("x")).select("guidance_unit_id", "x.*")


_X30 = f"""WITH u AS (SELECT guidance_unit_id, least(1.0, (1.0 / (60 + span_start) + CASE WHEN topic_family IS NULL THEN 0.0 ELSE 1.0 / 61 END) / (2.0 / 61)) AS s, len(central_concept_ids) > 0 AS g, coalesce(guidance_role = 'direct_moral_instruction', false) AS d, coalesce(topic_family = 'travel', false) AS e
FROM ({_UNITS}) WHERE span_start IS NOT NULL) SELECT guidance_unit_id, round(least(0.95, greatest(0.0, CASE WHEN e THEN 0.58 ELSE 0.44 END + 0.38 * s + CASE WHEN g THEN 0.12 ELSE -0.20 END)), 4) AS central, CASE WHEN d THEN 0.72 WHEN e THEN 0.70 ELSE 0.52 END AS answer,
CASE WHEN d THEN 0.08 ELSE 0.35 END AS narrative FROM u"""


def g17_checked_cases(spark: SparkSession, root: str) -> DataFrame:
    """Test items as cases with boolean checks and the names of those that fail."""
    c = table(spark, root, "eval_items")
    words = F.size(tx.words(tx.normalize_search(F.col("passage"))))
    checks = {"has_question": F.col("question").isNotNull(), "long_enough": words >= 30, "not_too_long": words <= 90, "known_language": F.col("lang").isin("en", "ar", "fr"), "ends_well": F.col("passage").endswith(".")}
    return c.select("item_id", selection.failed_checks(checks).alias("x")).select("item_id", "x.passed", F.array_join("x.failures", "|").alias("failures"))


_G17 = f"""WITH c AS (SELECT *, len({sq.match_words('passage')}) AS n FROM eval_items), f AS (SELECT item_id, concat_ws('|', CASE WHEN question IS NULL THEN 'has_question' END, CASE WHEN n < 30 THEN 'long_enough' END, CASE WHEN n > 90 THEN 'not_too_long' END,
CASE WHEN lang NOT IN ('en', 'ar', 'fr') OR lang IS NULL THEN 'known_language' END, CASE WHEN NOT ends_with(passage, '.') THEN 'ends_well' END) AS failures FROM c) SELECT item_id, failures = '' AS passed, failures FROM f"""


def z03_states_by_turn(spark: SparkSession, root: str) -> DataFrame:
    """Per user the folded state of the events (the last known value of each attribute), looked up by the turn that made it; users without any value have none."""
    e = table(spark, root, "events").select("user_id", F.col("event_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.when(F.col("value") > 10, F.col("value")).alias("v"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", "event_id")))
    state = e.groupBy("user_id").agg(last("v").alias("value"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max_by("event_id", F.struct("ts", "event_id")).alias("turn_id")).where("value IS NOT NULL")
    turns = e.select(F.col("event_id").alias("turn_id"), F.col("event_type").alias("turn_type"))
    return state.join(turns, "turn_id").select("turn_id", "user_id", "value", F.coalesce("last_type", "turn_type").alias("kind"))


_Z03 = """SELECT arg_max(event_id, (ts, event_id)) AS turn_id, user_id, arg_max(value, (ts, event_id)) FILTER (value > 10) AS value, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY user_id HAVING count(*) FILTER (value > 10) > 0"""


def g25_exact_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """Units that are exact excerpts of their entry: at least four words, all inside and covered; with the constant score of an exact match."""
    e = table(spark, root, "hadith_entries").select(F.col("canonical_ref_collection").alias("parent_hadith_ref"), tx.normalize_search(F.col("english_text")).alias("e"))
    u = _units(spark, root).select("guidance_unit_id", "parent_hadith_ref", tx.normalize_search(F.col("span_text")).alias("q")).join(e, "parent_hadith_ref")
    q = F.array_distinct(tx.words(F.col("q")))
    covered = F.size(F.array_intersect(q, tx.words(F.col("e")))) * 100.0 / F.size(q)
    return u.where((F.size(tx.words(F.col("q"))) >= 4) & F.col("e").contains(F.col("q")) & (covered >= 95)).select("guidance_unit_id", F.lit(100.0).alias("score"), F.round(covered, 2).alias("coverage"))


_G25 = f"""WITH u AS (SELECT guidance_unit_id, {sq.norm('span_text')} AS q, {sq.norm('english_text')} AS e FROM ({_UNITS}) u JOIN hadith_entries h ON h.canonical_ref_collection = u.parent_hadith_ref),
c AS (SELECT *, {sq.words('q')} AS w FROM u) SELECT guidance_unit_id, 100.0 AS score, round(len(list_intersect(list_distinct(w), {sq.words('e')})) * 100.0 / len(list_distinct(w)), 2) AS coverage FROM c
WHERE len(w) >= 4 AND contains(e, q) AND len(list_intersect(list_distinct(w), {sq.words('e')})) * 100.0 / len(list_distinct(w)) >= 95"""


def x46_thematic_units(spark: SparkSession, root: str) -> DataFrame:
    """Units of a theme by aliases and words, those of other families rejected, from 0.34 on, the best of each entry, best 20."""
    u = _units(spark, root).where(F.coalesce(F.col("topic_family"), F.lit("")) != "trade").withColumn("n", tx.normalize_search(F.concat_ws(" ", "span_text", "summary_text")))
    u = u.withColumn("t", tx.normalized_tokens(F.col("n")))
    u = u.withColumn("score", search.text_match("n", "t", ["garden", "harvest"], ["late harvest"])).where("score >= 0.34")
    best = fusion.keep_first(u.select("parent_hadith_ref", "guidance_unit_id", "score"), ["parent_hadith_ref"], F.col("score").desc(), "guidance_unit_id")
    return best.orderBy(F.col("score").desc(), "parent_hadith_ref").limit(20)


_GRAMS = lambda c: f"list_distinct(list_transform(range(1, length({c}) + 3), lambda i: substr('  ' || {c} || '  ', i, 3)))"
_SHARE = lambda w: f"len(list_intersect({_GRAMS(w)}, {_GRAMS('z')})) / len(list_distinct(list_concat({_GRAMS(w)}, {_GRAMS('z')})))"
_X46 = f"""WITH u AS (SELECT *, {sq.norm("concat_ws(' ', span_text, summary_text)")} AS n, {sq.search_words("concat_ws(' ', span_text, summary_text)")} AS t FROM ({_UNITS}) WHERE coalesce(topic_family, '') <> 'trade'),
w AS (SELECT *, CASE WHEN list_contains(t, 'garden') THEN 1.0 ELSE 1.0 + ln(2) END AS w1, CASE WHEN list_contains(t, 'harvest') THEN 1.0 ELSE 1.0 + ln(2) END AS w2 FROM u),
s AS (SELECT *, (CASE WHEN list_contains(t, 'garden') OR contains(n, 'garden') THEN w1 ELSE 0.0 END + CASE WHEN list_contains(t, 'harvest') OR contains(n, 'harvest') THEN w2 ELSE 0.0 END) / (w1 + w2) AS sh, CASE WHEN contains(n, 'late harvest') THEN 0.12 ELSE 0.0 END AS al,
coalesce(list_max(list_transform(list_distinct(t), lambda z: greatest({_SHARE("'garden'")}, {_SHARE("'harvest'")}))), 0.0) AS cl FROM w),
f AS (SELECT parent_hadith_ref, guidance_unit_id, CASE WHEN n = '' THEN 0.0 ELSE round(least(1.0, 0.68 * sh + al + CASE WHEN sh < 0.99 AND cl >= 0.42 THEN least(0.18, cl * 0.22) ELSE 0.0 END), 4) END AS score FROM s),
b AS (SELECT * FROM f WHERE score >= 0.34 QUALIFY row_number() OVER (PARTITION BY parent_hadith_ref ORDER BY score DESC, guidance_unit_id) = 1) SELECT * FROM b ORDER BY score DESC, parent_hadith_ref LIMIT 20"""

def a20_likely_chapters(spark: SparkSession, root: str) -> DataFrame:
    """For each verse the three chapters with the greatest sum of scores among its twelve best neighbours."""
    place = verses(spark, root).select(F.col("id").alias("neighbour_id"), F.col("surah_no").alias("chapter"))
    return quotes.likely_groups(j09_verse_neighbours(spark, root).join(place, "neighbour_id"), ["id"], "chapter", "score", "rank").select("id", "chapter", "score", "rank")


_A20 = f"""WITH n AS ({_J09}), {_LATEST}, s AS (SELECT n.id, v.surah_no AS chapter, round(sum(score), 6) AS score FROM n JOIN v ON v.id = neighbour_id WHERE rank <= 12 GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, chapter) AS rank FROM s QUALIFY rank <= 3"""


def g30_unit_types(spark: SparkSession, root: str) -> DataFrame:
    """The type of each passage's span by its length and place."""
    s = table(spark, root, "tafsir_sections").select("id", "ayah_start", "ayah_end")
    kind = rules.first_match(
        [("open", F.col("ayah_end").isNull()), ("reversed", F.col("ayah_end") < F.col("ayah_start")), ("single", F.col("ayah_end") == F.col("ayah_start")), ("static_window", F.col("ayah_end") - F.col("ayah_start") <= 3)], "contiguous_span"
    )
    return s.select("id", kind.alias("unit_type"))


_G30 = "SELECT id, CASE WHEN ayah_end IS NULL THEN 'open' WHEN ayah_end < ayah_start THEN 'reversed' WHEN ayah_end = ayah_start THEN 'single' WHEN ayah_end - ayah_start <= 3 THEN 'static_window' ELSE 'contiguous_span' END AS unit_type FROM tafsir_sections"

QUERIES = {
    f.__name__: f
    for f in (
        t10_ordered_works, a25_sizes_of_passages, a44_changed_metadata, j13_exact_lookup, j22_filled_entries, pr24_checked_ranges, x12_chosen_evaluation, x30_proxy_scores, g17_checked_cases, z03_states_by_turn, g25_exact_excerpts,
        x46_thematic_units, a20_likely_chapters, g30_unit_types,
    )
}
ORACLES = {
    "t10_ordered_works": _T10, "a25_sizes_of_passages": _A25, "a44_changed_metadata": _A44, "j13_exact_lookup": _J13, "j22_filled_entries": _J22, "pr24_checked_ranges": _P24, "x12_chosen_evaluation": _X12, "x30_proxy_scores": _X30,
    "g17_checked_cases": _G17, "z03_states_by_turn": _Z03, "g25_exact_excerpts": _G25, "x46_thematic_units": _X46, "a20_likely_chapters": _A20, "g30_unit_types": _G30,
}
