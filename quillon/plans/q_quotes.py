"""Quotation, unit and reference queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import quotes
from quillon.plans import pipelines
from quillon.plans import sqltext as sq
from quillon.plans.q_rules import CONCEPTS
from quillon.plans.q_spans import _LATEST, CHAPTER, verses
from quillon.sources.tables import table

_U = "u AS (SELECT DISTINCT ON (guidance_unit_id) guidance_unit_id, parent_hadith_ref AS ref, span_text FROM guidance_units ORDER BY guidance_unit_id)"


def _anchors(spark: SparkSession, root: str) -> DataFrame:
    u = table(spark, root, "guidance_units").select("guidance_unit_id", F.col("parent_hadith_ref").alias("ref"), "span_text").dropDuplicates(["guidance_unit_id"])
    u = u.withColumn("w", tx.words(tx.normalize_search(F.col("span_text"))))
    e = table(spark, root, "hadith_entries").select(F.col("canonical_ref_collection").alias("ref"), tx.words(tx.normalize_search(F.col("english_text"))).alias("w"))
    return quotes.anchor_hits(u, ["guidance_unit_id"], F.col("w"), e, ["ref"], F.col("w"), 5, on=["ref"])


_HITS = f"""WITH {_U}, q AS (SELECT guidance_unit_id, ref, {sq.match_words('span_text')} AS w FROM u), e AS (SELECT canonical_ref_collection AS ref, {sq.match_words('english_text')} AS w FROM hadith_entries),
a AS (SELECT guidance_unit_id, ref, greatest(len(w) - 4, 0) AS n_grams, w, unnest(range(0, len(w) - 4)) AS qpos FROM q WHERE len(w) >= 5), b AS (SELECT ref, w, unnest(range(0, len(w) - 4)) AS pos FROM e WHERE len(w) >= 5),
h AS (SELECT guidance_unit_id, a.ref, n_grams, qpos, pos FROM a JOIN b ON a.ref = b.ref AND list_slice(a.w, qpos + 1, qpos + 5) = list_slice(b.w, pos + 1, pos + 5))"""


def j18_anchored_units(spark: SparkSession, root: str) -> DataFrame:
    """Where each unit stands in its entry by the agreement of its five-grams."""
    return quotes.anchored_spans(_anchors(spark, root), ["guidance_unit_id"], ["ref"])


_J18 = f"""{_HITS}, d AS (SELECT guidance_unit_id, ref, pos - qpos AS start_pos, n_grams, count(*) AS n_anchors, max(CAST(qpos = 0 AS INT)) + max(CAST(qpos = (n_grams - 1) // 2 AS INT)) + max(CAST(qpos = n_grams - 1 AS INT)) AS m FROM h GROUP BY ALL)
SELECT guidance_unit_id, ref, start_pos, n_anchors, n_grams, m = 3 AS is_exact FROM d WHERE n_anchors >= 0.6 * n_grams - 1e-9"""


def j19_anchor_chains(spark: SparkSession, root: str) -> DataFrame:
    """The longest chain of five-grams of each unit in its entry."""
    return quotes.anchor_chains(_anchors(spark, root), ["guidance_unit_id"], ["ref"])


def a21_voted_entries(spark: SparkSession, root: str) -> DataFrame:
    """A21, plain lane only: the entries of the same collection that a unit's five-grams vote for; ``a21_voted_scope`` has all lanes."""
    u = table(spark, root, "guidance_units").select("guidance_unit_id", "collection_source_id", "span_text").dropDuplicates(["guidance_unit_id"]).withColumn("w", tx.words(tx.normalize_search(F.col("span_text"))))
    works = table(spark, root, "source_works").select(F.col("id").alias("work_id"), F.col("source_id").alias("collection_source_id"))
    e = table(spark, root, "hadith_entries").select("id", "work_id", "english_text").join(works, "work_id").withColumn("w", tx.words(tx.normalize_search(F.col("english_text"))))
    hits = quotes.anchor_hits(u, ["guidance_unit_id"], F.col("w"), e, ["id"], F.col("w"), 5, on=["collection_source_id"])
    return quotes.anchor_votes(hits, ["guidance_unit_id"], ["id"])


def a21_voted_scope(spark: SparkSession, root: str) -> DataFrame:
    """The entries of the same collection that a unit votes for by plain and folded five-grams, or by its rare words where none is found."""
    lanes = lambda c: [tx.words(tx.normalize_search(F.col(c))).alias("w"), tx.words(tx.normalize_search(tx.arabic_aggressive(F.col(c)))).alias("x")]
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"]).select("guidance_unit_id", "collection_source_id", *lanes("span_text"))
    works = table(spark, root, "source_works").select(F.col("id").alias("work_id"), F.col("source_id").alias("collection_source_id"))
    e = table(spark, root, "hadith_entries").join(works, "work_id").select("id", "collection_source_id", *lanes("english_text"))
    return quotes.scope_votes(u, ["guidance_unit_id"], [F.col("w"), F.col("x")], e, ["id"], [F.col("w"), F.col("x")], ["collection_source_id"])


_A21 = f"""WITH u AS (SELECT DISTINCT ON (guidance_unit_id) guidance_unit_id, collection_source_id AS c, {sq.match_words('span_text')} AS w FROM guidance_units ORDER BY guidance_unit_id),
e AS (SELECT h.id, source_id AS c, {sq.match_words('english_text')} AS w FROM hadith_entries h JOIN source_works s ON h.work_id = s.id),
a AS (SELECT guidance_unit_id, c, qpos, array_to_string(list_slice(w, qpos + 1, qpos + 5), ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 4)) AS qpos FROM u WHERE len(w) >= 5)),
b AS (SELECT id, c, array_to_string(list_slice(w, pos + 1, pos + 5), ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - 4)) AS pos FROM e WHERE len(w) >= 5)),
p AS (SELECT guidance_unit_id, id, qpos, count(*) AS n FROM a JOIN b USING (c, g) GROUP BY ALL), v AS (SELECT guidance_unit_id, id, sum(3 + least(n, 4) * 0.25) AS votes, count(*) AS n_anchors FROM p GROUP BY ALL)
SELECT guidance_unit_id, id, CAST(votes AS DOUBLE) AS votes, n_anchors, row_number() OVER (PARTITION BY guidance_unit_id ORDER BY votes DESC, id) AS rank FROM v QUALIFY rank <= 3"""


def w19_exact_passages(spark: SparkSession, root: str) -> DataFrame:
    """Passages of other works with the same wording as a passage of two verses."""
    v = verses(spark, root)
    asked = w_two(v).select(F.concat_ws(":", "work_id", "surah_no", "start_pos").alias("query_id"), "text")
    found = quotes.exact_passages(asked, "query_id", F.col("text"), v, CHAPTER, "ayah_no", "text_display", [2])
    return found.where(F.col("query_id") != F.concat_ws(":", "work_id", "surah_no", "start_pos"))


def w_two(v: DataFrame) -> DataFrame:
    """Passages of two verses."""
    from quillon.operators.spans import passage_windows

    return passage_windows(v, CHAPTER, "ayah_no", "text_display", [2])


_W19 = f"""WITH {_LATEST}, w AS (SELECT work_id, surah_no, ayah_no AS start_pos, end_pos, trim(text, ' ') AS t FROM (SELECT *, max(ayah_no) OVER w AS end_pos, count(*) OVER w AS n, string_agg(coalesce(text_display, ''), ' ') OVER w AS text FROM v
WINDOW w AS (PARTITION BY work_id, surah_no ORDER BY ayah_no ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) WHERE n = 2 AND end_pos - ayah_no = 1)
SELECT q.work_id || ':' || q.surah_no || ':' || q.start_pos AS query_id, w.work_id, w.surah_no, w.start_pos, w.end_pos FROM w q JOIN w ON q.t = w.t AND q.t <> '' WHERE (q.work_id, q.surah_no, q.start_pos) <> (w.work_id, w.surah_no, w.start_pos)"""


def p25_resolved_references(spark: SparkSession, root: str) -> DataFrame:
    """The first reference of every document checked against the chapters."""
    return pipelines.resolve_references(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "quran_surahs"), "surah_no", "ayah_count")


def w04_built_units(spark: SparkSession, root: str) -> DataFrame:
    """The best passages of every entry with role, concepts and scores."""
    rows = pipelines.build_units(table(spark, root, "hadith_entries").select("id", "english_text"), "id", "english_text", CONCEPTS)
    return rows.withColumn("concepts", F.array_join("concepts", ","))


def s19_search_documents(spark: SparkSession, root: str) -> DataFrame:
    """The table that searches run on."""
    rows = pipelines.search_documents(table(spark, root, "hadith_entries"), table(spark, root, "hadith_books"), table(spark, root, "hadith_chapters"))
    return rows.withColumn("tokens", F.size("tokens"))


_S19 = f"""SELECT e.id, canonical_ref_collection, b.title_en AS book_title, c.title_en AS chapter_title, english_narrator, english_text, len({sq.match_words('english_text')}) AS tokens FROM hadith_entries e
LEFT JOIN hadith_books b ON e.book_id = b.id LEFT JOIN hadith_chapters c ON e.chapter_id = c.id WHERE length(trim(coalesce(english_text, ''), ' ')) > 0 AND coalesce(json_extract_string(e.metadata_json, '$.is_stub'), '') <> 'true'"""

QUERIES = {f.__name__: f for f in (j18_anchored_units, j19_anchor_chains, a21_voted_entries, a21_voted_scope, w19_exact_passages, p25_resolved_references, w04_built_units, s19_search_documents)}
ORACLES = {"j18_anchored_units": _J18, "a21_voted_entries": _A21, "w19_exact_passages": _W19, "s19_search_documents": _S19}
