"""Span, window and interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import spans
from quillon.plans import sqltext as sq
from quillon.plans.materialize import exploded
from quillon.sources.tables import table, text_table

CHAPTER = ["work_id", "surah_no"]
_LATEST = """v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id, surah_no, ayah_no ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn FROM quran_ayahs) WHERE rn = 1)"""


def verses(spark: SparkSession, root: str) -> DataFrame:
    """One row per work and verse, the one delivered last."""
    rows = table(spark, root, "quran_ayahs").select("id", *CHAPTER, "ayah_no", "language_code", "text_display", "text_normalized", "updated_at")
    return spans.latest(rows, [*CHAPTER, "ayah_no"], ["updated_at", "id"])


def w01_passage_windows(spark: SparkSession, root: str) -> DataFrame:
    """Passages of two to four neighbouring verses."""
    return spans.passage_windows(verses(spark, root), CHAPTER, "ayah_no", "text_display", [2, 3, 4])


_W01 = f"WITH {_LATEST} " + " UNION ALL ".join(
    f"""SELECT work_id, surah_no, {k} AS window_size, ayah_no AS start_pos, end_pos, text FROM (SELECT *, max(ayah_no) OVER w AS end_pos, count(*) OVER w AS n, string_agg(coalesce(text_display, ''), ' ') OVER w AS text FROM v
WINDOW w AS (PARTITION BY work_id, surah_no ORDER BY ayah_no ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)) WHERE n = {k} AND end_pos - ayah_no = {k - 1}"""
    for k in (2, 3, 4)
)


def a10_window_counts(spark: SparkSession, root: str) -> DataFrame:
    """A10: windows per size and work."""
    return w01_passage_windows(spark, root).groupBy("work_id", "window_size").agg(F.count("*").alias("n"))


_A10 = f"SELECT work_id, window_size, count(*) AS n FROM ({_W01}) GROUP BY ALL"


def w03_sentence_windows(spark: SparkSession, root: str) -> DataFrame:
    """Windows of one to three sentences of an entry with at least 28 characters."""
    rows = exploded(table(spark, root, "hadith_entries").select("id", tx.sentences(F.col("english_text")).alias("s")), ["id"], spans.list_windows(F.col("s"), [1, 2, 3]), "w")
    rows = rows.select("id", F.col("w.start").alias("start"), F.col("w.width").alias("width"), F.array_join("w.items", " ").alias("text"))
    return rows.where(F.length("text") >= 28)


_SENT = r"list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(english_text, ''), '\s+', ' ', 'g')), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"
_W03 = f"""WITH s AS (SELECT id, {_SENT} AS ss FROM hadith_entries), i AS (SELECT id, ss, w.width, unnest(range(0, len(ss) - w.width + 1)) AS start FROM s, (SELECT unnest([1, 2, 3]) AS width) w),
t AS (SELECT id, CAST(start AS INTEGER) AS start, width, array_to_string(list_slice(ss, start + 1, start + width), ' ') AS text FROM i) SELECT * FROM t WHERE length(text) >= 28"""


def w06_char_ranges(spark: SparkSession, root: str) -> DataFrame:
    """Character ranges of the verses in their chapter's joined text."""
    return spans.running_offsets(verses(spark, root), CHAPTER, "ayah_no", "text_display")


_W06 = f"""WITH {_LATEST}, o AS (SELECT work_id, surah_no, ayah_no, length(coalesce(text_display, '')) AS n, coalesce(sum(length(coalesce(text_display, '')) + 1) OVER (PARTITION BY work_id, surah_no ORDER BY ayah_no
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM v) SELECT work_id, surah_no, ayah_no, s AS char_start, s + n AS char_end FROM o"""


def w07_token_positions(spark: SparkSession, root: str) -> DataFrame:
    """Every token of a chapter with its position."""
    return spans.token_stream(verses(spark, root), CHAPTER, "ayah_no", tx.words(tx.normalize_search(F.col("text_normalized"))))


_VW = sq.match_words("text_normalized")
_W07 = f"""WITH {_LATEST}, t AS (SELECT work_id, surah_no, ayah_no, {_VW} AS w FROM v),
o AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY work_id, surah_no ORDER BY ayah_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM t),
i AS (SELECT *, unnest(range(0, len(w))) AS p FROM o) SELECT work_id, surah_no, ayah_no, o + p AS pos, w[p + 1] AS token FROM i"""


def w08_shared_five_grams(spark: SparkSession, root: str) -> DataFrame:
    """Five-grams of words that occur in more than one verse."""
    grams = spans.token_ngrams(verses(spark, root), [*CHAPTER, "ayah_no"], tx.words(tx.normalize_search(F.col("text_normalized"))), 5)
    return grams.groupBy("gram").agg(F.count("*").alias("n"), F.countDistinct("work_id").alias("n_works")).where("n > 1")


_W08 = f"""WITH {_LATEST}, t AS (SELECT work_id, {_VW} AS w FROM v), i AS (SELECT work_id, w, unnest(range(1, len(w) - 3)) AS p FROM t WHERE len(w) >= 5),
g AS (SELECT work_id, array_to_string(list_slice(w, p, p + 4), ' ') AS gram FROM i) SELECT gram, count(*) AS n, count(DISTINCT work_id) AS n_works FROM g GROUP BY gram HAVING count(*) > 1"""


def w09_alignment(spark: SparkSession, root: str) -> DataFrame:
    """The longest run of words that a guidance unit shares with its parent entry."""
    units = text_table(spark, root, "guidance_units").select("guidance_unit_id", F.col("parent_hadith_ref").alias("ref"), "span_text").dropDuplicates(["guidance_unit_id"])
    query = exploded(units, ["guidance_unit_id", "ref"], tx.words(tx.normalize_search(F.col("span_text"))), "token", "qpos")
    entries = exploded(text_table(spark, root, "hadith_entries"), [F.col("canonical_ref_collection").alias("ref")], tx.words(tx.normalize_search(F.col("english_text"))), "token", "pos")
    return spans.aligned_runs(query, entries, ["guidance_unit_id"], ["ref"], on=["ref"], least=3)


_W09 = f"""WITH u AS (SELECT DISTINCT ON (guidance_unit_id) guidance_unit_id, parent_hadith_ref AS ref, {sq.match_words('span_text')} AS w FROM guidance_units ORDER BY guidance_unit_id),
e AS (SELECT canonical_ref_collection AS ref, {sq.match_words('english_text')} AS w FROM hadith_entries),
q AS (SELECT guidance_unit_id, ref, w, unnest(range(0, len(w))) AS qpos FROM u), s AS (SELECT ref, w, unnest(range(0, len(w))) AS pos FROM e),
h AS (SELECT guidance_unit_id, q.ref, qpos, pos, pos - qpos AS d FROM q JOIN s ON q.ref = s.ref AND q.w[qpos + 1] = s.w[pos + 1]),
i AS (SELECT *, qpos - row_number() OVER (PARTITION BY guidance_unit_id, ref, d ORDER BY qpos) AS i FROM h),
r AS (SELECT guidance_unit_id, ref, min(qpos) AS query_start, min(pos) AS stream_start, count(*) AS run_length FROM i GROUP BY guidance_unit_id, ref, d, i HAVING count(*) >= 3),
b AS (SELECT *, row_number() OVER (PARTITION BY guidance_unit_id, ref ORDER BY run_length DESC, query_start, stream_start) AS b FROM r)
SELECT guidance_unit_id, ref, query_start, stream_start, run_length FROM b WHERE b = 1"""


def w12_filled_sections(spark: SparkSession, root: str) -> DataFrame:
    """Sections of a work and chapter, empty texts joined to the section before them."""
    rows = table(spark, root, "tafsir_sections").select("id", *CHAPTER, "ayah_start", "text_plain", "updated_at").where("ayah_start IS NOT NULL")
    rows = spans.latest(rows, [*CHAPTER, "ayah_start"], ["updated_at", "id"])
    return spans.fill_forward_groups(rows, CHAPTER, "ayah_start", "text_plain").withColumn("text", F.length("text")).withColumnRenamed("text", "n_chars")


_W12 = """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY work_id, surah_no, ayah_start ORDER BY updated_at DESC NULLS LAST, id DESC) AS rn FROM tafsir_sections WHERE ayah_start IS NOT NULL) WHERE rn = 1),
f AS (SELECT work_id, surah_no, ayah_start, CASE WHEN trim(coalesce(text_plain, ''), ' ') <> '' THEN text_plain END AS t FROM l),
g AS (SELECT *, greatest(1, count(t) OVER (PARTITION BY work_id, surah_no ORDER BY ayah_start)) AS section_no FROM f)
SELECT work_id, surah_no, section_no, min(ayah_start) AS start_pos, max(ayah_start) AS end_pos, count(*) AS n_rows, length(max(t)) AS n_chars FROM g GROUP BY work_id, surah_no, section_no HAVING max(t) IS NOT NULL"""


def _spans(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tafsir_sections").where("ayah_end IS NOT NULL").select("id", *CHAPTER, F.least("ayah_start", "ayah_end").alias("a"), F.greatest("ayah_start", "ayah_end").alias("b"))


def j02_overlapping_sections(spark: SparkSession, root: str) -> DataFrame:
    """For every 20th section the five best overlapping sections of the same work and chapter."""
    every = _spans(spark, root)
    asked = every.where("id % 20 = 0").select(F.col("id").alias("query_id"), *CHAPTER, F.col("a").alias("qa"), F.col("b").alias("qb"))
    hits = spans.overlap_join(asked, every, CHAPTER, ("qa", "qb"), ("a", "b"), bin_width=8).where("id <> query_id")
    best = spans.rank_overlaps(hits, ["query_id"], ("qa", "qb"), ("a", "b"), "id", 5)
    contains, within = (F.col("a") <= F.col("qa")) & (F.col("b") >= F.col("qb")), (F.col("a") >= F.col("qa")) & (F.col("b") <= F.col("qb"))
    return best.select("query_id", F.col("id").alias("section_id"), "overlap", "rank", contains.alias("contains_query"), within.alias("within_query"))


_J02 = """WITH s AS (SELECT id, work_id, surah_no, least(ayah_start, ayah_end) AS a, greatest(ayah_start, ayah_end) AS b FROM tafsir_sections WHERE ayah_end IS NOT NULL),
h AS (SELECT q.id AS query_id, s.id AS section_id, q.a AS qa, q.b AS qb, s.a, s.b, least(q.b, s.b) - greatest(q.a, s.a) + 1 AS overlap FROM s q JOIN s ON q.work_id = s.work_id AND q.surah_no = s.surah_no AND q.a <= s.b AND q.b >= s.a
WHERE q.id % 20 = 0 AND s.id <> q.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (a = qa AND b = qb) DESC, (a <= qa AND b >= qb) DESC, overlap DESC, b - a, abs(a - qa), section_id) AS rank FROM h)
SELECT query_id, section_id, overlap, rank, a <= qa AND b >= qb AS contains_query, a >= qa AND b <= qb AS within_query FROM r WHERE rank <= 5"""


def j16_contained_phrase(spark: SparkSession, root: str) -> DataFrame:
    """Every place of a phrase in the joined text of a chapter, as verses."""
    rows = verses(spark, root).withColumn("t", F.lower("text_display"))
    return spans.contained_spans(rows, CHAPTER, "ayah_no", "t", "some readers take")


_J16 = f"""WITH {_LATEST}, e AS (SELECT *, lower(coalesce(text_display, '')) AS t FROM v), o AS (SELECT work_id, surah_no, ayah_no, t, coalesce(sum(length(t) + 1) OVER (PARTITION BY work_id, surah_no ORDER BY ayah_no
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM e), c AS (SELECT work_id, surah_no, string_agg(t, ' ' ORDER BY ayah_no) AS t FROM e GROUP BY work_id, surah_no),
h AS (SELECT work_id, surah_no, unnest(list_filter(range(0, length(t)), lambda i: substr(t, i + 1, 17) = 'some readers take')) AS hit_start FROM c)
SELECT h.work_id, h.surah_no, hit_start, min(ayah_no) AS start_pos, max(ayah_no) AS end_pos FROM h JOIN o ON h.work_id = o.work_id AND h.surah_no = o.surah_no AND o.s < hit_start + 17 AND o.s + length(o.t) > hit_start GROUP BY ALL"""


def p02_span_completeness(spark: SparkSession, root: str) -> DataFrame:
    """How many verses of a section's span the works of the same language hold."""
    wanted = table(spark, root, "tafsir_sections").where("ayah_end IS NOT NULL").select("surah_no", F.least("ayah_start", "ayah_end").alias("a"), F.greatest("ayah_start", "ayah_end").alias("b")).distinct()
    return spans.complete_spans(wanted, verses(spark, root), ["surah_no"], "ayah_no", "a", "b").select("surah_no", "a", "b", "n_found", "is_complete")


_P02 = """WITH w AS (SELECT DISTINCT surah_no, least(ayah_start, ayah_end) AS a, greatest(ayah_start, ayah_end) AS b FROM tafsir_sections WHERE ayah_end IS NOT NULL), h AS (SELECT DISTINCT surah_no, ayah_no FROM quran_ayahs)
SELECT w.surah_no, a, b, count(ayah_no) AS n_found, count(ayah_no) = b - a + 1 AS is_complete FROM w LEFT JOIN h ON w.surah_no = h.surah_no AND ayah_no BETWEEN a AND b GROUP BY w.surah_no, a, b"""


def p27_missing_verses(spark: SparkSession, root: str) -> DataFrame:
    """Verses that are missing in a work's chapter before its last one."""
    return spans.missing_positions(table(spark, root, "quran_ayahs"), CHAPTER, "ayah_no")


_P27 = """WITH d AS (SELECT DISTINCT work_id, surah_no, ayah_no FROM quran_ayahs), p AS (SELECT *, coalesce(lag(ayah_no) OVER (PARTITION BY work_id, surah_no ORDER BY ayah_no), 0) AS p FROM d)
SELECT work_id, surah_no, p + 1 AS missing_from, ayah_no - 1 AS missing_to FROM p WHERE ayah_no > p + 1"""


def w20_adjacent_verses(spark: SparkSession, root: str) -> DataFrame:
    """Neighbours of a verse, and the second verse of its three-verse span."""
    rows = spans.neighbours(verses(spark, root), CHAPTER, "ayah_no")
    return rows.withColumn("second_of_span", spans.nth_of_span(F.col("ayah_no"), F.col("ayah_no") + 2, F.lit(2)))


_W20 = f"""WITH {_LATEST} SELECT work_id, surah_no, ayah_no, lag(ayah_no) OVER w AS prev_pos, lead(ayah_no) OVER w AS next_pos, ayah_no + 1 AS second_of_span FROM v WINDOW w AS (PARTITION BY work_id, surah_no ORDER BY ayah_no)"""

QUERIES = {
    f.__name__: f
    for f in (
        w01_passage_windows, a10_window_counts, w03_sentence_windows, w06_char_ranges, w07_token_positions, w08_shared_five_grams, w09_alignment, w12_filled_sections, j02_overlapping_sections, j16_contained_phrase,
        p02_span_completeness, p27_missing_verses, w20_adjacent_verses,
    )
}
ORACLES = {
    "w01_passage_windows": _W01, "a10_window_counts": _A10, "w03_sentence_windows": _W03, "w06_char_ranges": _W06, "w07_token_positions": _W07, "w08_shared_five_grams": _W08, "w09_alignment": _W09,
    "w12_filled_sections": _W12, "j02_overlapping_sections": _J02, "j16_contained_phrase": _J16, "p02_span_completeness": _P02, "p27_missing_verses": _P27, "w20_adjacent_verses": _W20,
}
