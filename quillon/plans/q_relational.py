"""Joins, merges, reports and quality gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, merge, report, spans
from quillon.plans import sqltext as sq
from quillon.sources import readers
from quillon.sources.tables import table


def j01_hydrated_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries with their work, book and (where there is one) chapter, as one projection."""
    e = table(spark, root, "hadith_entries").select("id", "work_id", "book_id", "chapter_id", "canonical_ref_collection", "collection_hadith_number", F.length("english_text").alias("n_chars"))
    w = table(spark, root, "source_works").select(F.col("id").alias("work_id"), "source_id", "display_name")
    b = table(spark, root, "hadith_books").select(F.col("id").alias("book_id"), F.col("title_en").alias("book_title"))
    c = table(spark, root, "hadith_chapters").select(F.col("id").alias("chapter_id"), F.col("title_en").alias("chapter_title"))
    rows = e.join(w, "work_id").join(b, "book_id").join(c, "chapter_id", "left")
    return rows.select("id", "source_id", "display_name", "book_title", "chapter_title", "canonical_ref_collection", "collection_hadith_number", "n_chars")


_J01 = """SELECT e.id, w.source_id, w.display_name, b.title_en AS book_title, c.title_en AS chapter_title, canonical_ref_collection, collection_hadith_number, length(english_text) AS n_chars FROM hadith_entries e
JOIN source_works w ON e.work_id = w.id JOIN hadith_books b ON e.book_id = b.id LEFT JOIN hadith_chapters c ON e.chapter_id = c.id"""


def p01_lookup(spark: SparkSession, root: str) -> DataFrame:
    """The first entry of every work and number, looked up by reference."""
    e = table(spark, root, "hadith_entries").select("id", "work_id", "collection_hadith_number", "canonical_ref_collection")
    return fusion.keep_first(e, ["work_id", "collection_hadith_number"], "id")


_P01 = "SELECT id, work_id, collection_hadith_number, canonical_ref_collection FROM hadith_entries QUALIFY row_number() OVER (PARTITION BY work_id, collection_hadith_number ORDER BY id) = 1"


def j05_verse_texts(spark: SparkSession, root: str) -> DataFrame:
    """For every section's span the verses of one reference work joined in order, and how many are missing."""
    ref = spans.latest(table(spark, root, "quran_ayahs").where("work_id = 1").select("id", "surah_no", "ayah_no", "text_display", "updated_at"), ["surah_no", "ayah_no"], ["updated_at", "id"])
    s = table(spark, root, "tafsir_sections").where("ayah_end IS NOT NULL").select("id", "surah_no", F.explode(F.sequence(F.least("ayah_start", "ayah_end"), F.greatest("ayah_start", "ayah_end"))).alias("ayah_no"))
    rows = s.join(ref.select("surah_no", "ayah_no", "text_display"), ["surah_no", "ayah_no"], "left")
    ordered = F.array_sort(F.collect_list(F.when(F.coalesce(F.col("text_display"), F.lit("")) != "", F.struct("ayah_no", "text_display"))))
    return rows.groupBy("id").agg(ordered.alias("v"), F.count("*").alias("n_verses")).select("id", "n_verses", (F.col("n_verses") - F.size("v")).alias("n_missing"), F.array_join(F.transform("v", lambda x: x["text_display"]), " ").alias("verses"))


_J05 = """WITH r AS (SELECT surah_no, ayah_no, text_display FROM quran_ayahs WHERE work_id = 1 QUALIFY row_number() OVER (PARTITION BY surah_no, ayah_no ORDER BY updated_at DESC NULLS LAST, id DESC) = 1),
s AS (SELECT id, surah_no, unnest(range(least(ayah_start, ayah_end), greatest(ayah_start, ayah_end) + 1)) AS ayah_no FROM tafsir_sections WHERE ayah_end IS NOT NULL)
SELECT id, count(*) AS n_verses, count(*) FILTER (coalesce(text_display, '') = '') AS n_missing, coalesce(string_agg(nullif(text_display, ''), ' ' ORDER BY ayah_no), '') AS verses FROM s LEFT JOIN r USING (surah_no, ayah_no) GROUP BY id"""


def j20_overridden_works(spark: SparkSession, root: str) -> DataFrame:
    """Works of two lists as one, the later list winning where both have a work."""
    works = table(spark, root, "source_works").select("source_id", "display_name", "language_code", "priority_rank", F.col("approved_for_answering").alias("approved"))
    first = works.where("language_code <> 'ar'")
    later = works.where("approved").withColumn("display_name", F.upper("display_name"))
    return merge.upsert(first, later, ["source_id"], ["display_name", "language_code", "priority_rank"])


_J20 = """WITH a AS (SELECT source_id, display_name, language_code, priority_rank FROM source_works WHERE language_code <> 'ar'), b AS (SELECT source_id, upper(display_name) AS display_name, language_code, priority_rank FROM source_works WHERE approved_for_answering)
SELECT coalesce(b.source_id, a.source_id) AS source_id, CASE WHEN b.source_id IS NULL THEN a.display_name ELSE b.display_name END AS display_name, coalesce(b.language_code, a.language_code) AS language_code,
coalesce(b.priority_rank, a.priority_rank) AS priority_rank, CASE WHEN b.source_id IS NULL THEN 'kept' WHEN a.source_id IS NULL THEN 'inserted' WHEN a.display_name IS DISTINCT FROM b.display_name THEN 'updated' ELSE 'unchanged' END AS outcome
FROM a FULL OUTER JOIN b ON a.source_id = b.source_id"""

_FIELDS = ["ayah_start", "ayah_end", "text_hash", "text_plain"]


def _deliveries(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, root, "tafsir_sections").select("id", "canonical_section_id", *_FIELDS, "updated_at", "coverage_mode")
    newest = spans.latest(rows, ["canonical_section_id"], ["updated_at", "id"])
    oldest = fusion.keep_first(rows, ["canonical_section_id"], "id")
    return oldest.where("coverage_mode <> 'anchor_only'"), newest.where("coverage_mode <> 'explicit_range'")


def k09_merged_sections(spark: SparkSession, root: str) -> DataFrame:
    """The newest delivery of each section merged into the first, with the outcome."""
    old, new = _deliveries(spark, root)
    return merge.upsert(old, new, ["canonical_section_id"], _FIELDS).select("canonical_section_id", "ayah_start", "ayah_end", "text_hash", "outcome")


_K09 = """WITH n AS (SELECT * FROM (SELECT * FROM tafsir_sections QUALIFY row_number() OVER (PARTITION BY canonical_section_id ORDER BY updated_at DESC NULLS LAST, id DESC) = 1) WHERE coverage_mode <> 'explicit_range'),
o AS (SELECT * FROM (SELECT * FROM tafsir_sections QUALIFY row_number() OVER (PARTITION BY canonical_section_id ORDER BY id) = 1) WHERE coverage_mode <> 'anchor_only')
SELECT coalesce(n.canonical_section_id, o.canonical_section_id) AS canonical_section_id, CASE WHEN n.id IS NULL THEN o.ayah_start ELSE n.ayah_start END AS ayah_start, CASE WHEN n.id IS NULL THEN o.ayah_end ELSE n.ayah_end END AS ayah_end,
CASE WHEN n.id IS NULL THEN o.text_hash ELSE n.text_hash END AS text_hash, CASE WHEN n.id IS NULL THEN 'kept' WHEN o.id IS NULL THEN 'inserted'
WHEN n.ayah_start IS DISTINCT FROM o.ayah_start OR n.ayah_end IS DISTINCT FROM o.ayah_end OR n.text_hash IS DISTINCT FROM o.text_hash OR n.text_plain IS DISTINCT FROM o.text_plain THEN 'updated' ELSE 'unchanged' END AS outcome
FROM n FULL OUTER JOIN o ON n.canonical_section_id = o.canonical_section_id"""


def k10_outcomes(spark: SparkSession, root: str) -> DataFrame:
    """How many sections had each outcome."""
    return merge.outcome_counts(k09_merged_sections(spark, root))


_K10 = f"SELECT outcome, count(*) AS n FROM ({_K09}) GROUP BY outcome"


def k16_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Rows that stay in each table when disabled works go."""
    works = table(spark, root, "source_works").select("id", "enabled")
    kids = {n: (table(spark, root, n).select("work_id"), "work_id") for n in ("hadith_entries", "hadith_books", "tafsir_sections", "quran_ayahs")}
    left = merge.delete_cascade(works, ~F.col("enabled"), "id", kids)
    parts = [d.agg(F.lit(n).alias("table_name"), F.count("*").alias("n")) for n, d in left.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_K16 = "SELECT 'parents' AS table_name, count(*) AS n FROM source_works WHERE enabled " + "".join(
    f"UNION ALL SELECT '{n}', count(*) FROM {n} WHERE work_id NOT IN (SELECT id FROM source_works WHERE NOT enabled) " for n in ("hadith_entries", "hadith_books", "tafsir_sections", "quran_ayahs")
)


def k17_merged_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Metadata of works joined with new keys, the new ones winning."""
    works = table(spark, root, "source_works").select("id", F.col("metadata_json").cast("string").alias("m"), "version_label")
    m = merge.merge_json(F.col("m"), F.to_json(F.struct(F.col("version_label").alias("version"), F.lit("9").alias("volumes"))))
    rows = works.select("id", m.alias("m"))
    return rows.select("id", F.size("m").alias("n_keys"), F.try_element_at("m", F.lit("volumes")).alias("volumes"), F.try_element_at("m", F.lit("version")).alias("version"))


_K17 = """SELECT id, len(list_distinct(list_concat(json_keys(CAST(coalesce(metadata_json, '{}') AS JSON)), CASE WHEN version_label IS NULL THEN ['volumes'] ELSE ['volumes', 'version'] END))) AS n_keys, '9' AS volumes, version_label AS version FROM source_works"""


def a06_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    """Documents by domain and source at all levels."""
    d = table(spark, root, "documents").select("source_domain", "source", "lang", F.length("text").alias("n"))
    measures = [F.count("*").alias("n_docs"), F.count_if(F.col("n") > 1000).alias("n_long"), F.max("n").alias("longest"), F.count_if(F.col("lang").isNull()).alias("n_no_lang")]
    return report.hierarchy(d, ["source_domain", "source"], measures)


_A06 = """SELECT source_domain, source, CAST(2 - grouping(source_domain) - grouping(source) AS INTEGER) AS level, count(*) AS n_docs, count(*) FILTER (length(text) > 1000) AS n_long, max(length(text)) AS longest, count(*) FILTER (lang IS NULL) AS n_no_lang
FROM documents GROUP BY ROLLUP (source_domain, source)"""


def a12_length_quantiles(spark: SparkSession, root: str) -> DataFrame:
    """Exclusive quantiles of the text lengths by domain."""
    d = table(spark, root, "documents").select("source_domain", F.length("text").alias("n_chars"))
    return report.exclusive_quantiles(d, ["source_domain"], "n_chars", [0.25, 0.5, 0.75])


def _sql_quantile(p: float) -> str:
    at = f"greatest(1.0, least(CAST(n AS DOUBLE), {p} * (n + 1)))"
    return f"round(l[CAST(floor({at}) AS INT)] + ({at} - floor({at})) * (l[CAST(ceil({at}) AS INT)] - l[CAST(floor({at}) AS INT)]), 6)"


_A12 = f"""WITH g AS (SELECT source_domain, list_sort(list(CAST(length(text) AS DOUBLE))) AS l, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY source_domain)
SELECT source_domain, n, {_sql_quantile(0.25)} AS q25, {_sql_quantile(0.5)} AS q50, {_sql_quantile(0.75)} AS q75 FROM g"""


def a13_word_buckets(spark: SparkSession, root: str) -> DataFrame:
    """Documents by number of words."""
    d = table(spark, root, "documents").select(F.size(tx.words(tx.normalize_search(F.col("text")))).alias("n"))
    return report.bucket_counts(d, F.col("n"), [1, 4, 7, 11, 51, 201])


_A13 = f"""SELECT CASE WHEN n < 1 THEN '0' WHEN n < 4 THEN '1-3' WHEN n < 7 THEN '4-6' WHEN n < 11 THEN '7-10' WHEN n < 51 THEN '11-50' WHEN n < 201 THEN '51-200' ELSE '201+' END AS bucket, count(*) AS n
FROM (SELECT len({sq.match_words('text')}) AS n FROM documents) GROUP BY 1"""


def a14_quality_gate(spark: SparkSession, root: str) -> DataFrame:
    """Rates of sound documents by domain with the names of those below their threshold."""
    d = table(spark, root, "documents")
    m = d.groupBy("source_domain").agg(
        report.rate(F.length(F.trim("text")) > 0).alias("with_text"), report.rate(F.col("lang").rlike("^[a-z]{2}$")).alias("clean_lang"), report.rate(F.col("n_chars") == F.length("text"), F.col("n_chars").isNotNull()).alias("right_length")
    )
    gated = report.gate(m, {"with_text": 0.97, "clean_lang": 0.98, "right_length": 0.9})
    return gated.withColumn("failed", F.array_join("failed", ","))


_A14 = """WITH m AS (SELECT source_domain, round(avg(CASE WHEN length(trim(text, ' ')) > 0 THEN 1.0 ELSE 0.0 END), 6) AS with_text, round(avg(CASE WHEN regexp_matches(lang, '^[a-z]{2}$') THEN 1.0 ELSE 0.0 END), 6) AS clean_lang,
round(coalesce(avg(CASE WHEN n_chars IS NULL THEN NULL WHEN n_chars = length(text) THEN 1.0 ELSE 0.0 END), 1.0), 6) AS right_length FROM documents GROUP BY source_domain),
f AS (SELECT *, list_filter([CASE WHEN with_text < 0.97 THEN 'with_text' END, CASE WHEN clean_lang < 0.98 THEN 'clean_lang' END, CASE WHEN right_length < 0.9 THEN 'right_length' END], lambda x: x IS NOT NULL) AS l FROM m)
SELECT source_domain, with_text, clean_lang, right_length, coalesce(array_to_string(l, ','), '') AS failed, len(l) = 0 AS passed FROM f"""


def a17_preflight(spark: SparkSession, root: str) -> DataFrame:
    """How many entries there are and how many have each optional column."""
    e = table(spark, root, "hadith_entries")
    return report.preflight(e, ["chapter_id", "english_narrator", "matn_text", "in_book_hadith_number"], {"n_long": F.length("english_text") > 500, "n_metadata": F.col("metadata_json") != "{}"})


_A17 = """SELECT count(*) AS n_rows, count(chapter_id) AS n_chapter_id, count(english_narrator) AS n_english_narrator, count(matn_text) AS n_matn_text, count(in_book_hadith_number) AS n_in_book_hadith_number,
count(*) FILTER (length(english_text) > 500) AS n_long, count(*) FILTER (metadata_json <> '{}') AS n_metadata FROM hadith_entries"""


def a19_domain_invariants(spark: SparkSession, root: str) -> DataFrame:
    """Groups of works that break a rule of their domain."""
    w = table(spark, root, "source_works").groupBy("source_domain").agg(F.count_if(F.col("default_for_explain")).alias("n_default"), F.count_if(F.col("enabled")).alias("n_enabled"), F.countDistinct("source_id").alias("n_ids"), F.count("*").alias("n"))
    issue = report.issues({"several_defaults": F.col("n_default") <= 1, "no_default": F.col("n_default") >= 1, "none_enabled": F.col("n_enabled") >= 1, "repeated_ids": F.col("n_ids") == F.col("n")})
    return w.select("source_domain", "n", F.array_join(issue, ",").alias("issues"))


_A19 = """WITH g AS (SELECT source_domain, count(*) AS n, count(*) FILTER (default_for_explain) AS d, count(*) FILTER (enabled) AS e, count(DISTINCT source_id) AS i FROM source_works GROUP BY source_domain)
SELECT source_domain, n, coalesce(array_to_string(list_filter([CASE WHEN d > 1 THEN 'several_defaults' END, CASE WHEN d < 1 THEN 'no_default' END, CASE WHEN e < 1 THEN 'none_enabled' END, CASE WHEN i <> n THEN 'repeated_ids' END], lambda x: x IS NOT NULL), ','), '') AS issues FROM g"""


def a27_concept_weights(spark: SparkSession, root: str) -> DataFrame:
    """Concepts of each topic family weighted by how few families have them."""
    u = table(spark, root, "guidance_units").where("topic_family IS NOT NULL")
    return report.phrase_specificity(u, "topic_family", "central_concept_ids", F.col("directness_score"))


_A27 = """WITH r AS (SELECT topic_family, unnest(central_concept_ids) AS phrase, directness_score AS w FROM guidance_units WHERE topic_family IS NOT NULL), n AS (SELECT count(DISTINCT topic_family) AS n FROM guidance_units WHERE topic_family IS NOT NULL),
f AS (SELECT phrase, count(DISTINCT topic_family) AS f FROM r GROUP BY phrase), b AS (SELECT topic_family, phrase, max(w) AS w FROM r GROUP BY ALL) SELECT topic_family, phrase, round(w * greatest(1.0, n / f), 6) AS weight FROM b JOIN f USING (phrase), n"""


def a32_unused_concepts(spark: SparkSession, root: str) -> DataFrame:
    """Secondary concepts that are central nowhere."""
    u = table(spark, root, "guidance_units")
    return report.unused(u.select(F.explode("secondary_concept_ids").alias("concept")), "concept", u.select(F.explode("central_concept_ids").alias("c")), "c")


_A32 = "SELECT DISTINCT unnest(secondary_concept_ids) AS concept FROM guidance_units EXCEPT SELECT unnest(central_concept_ids) FROM guidance_units"


def a39_unique_suffixes(spark: SparkSession, root: str) -> DataFrame:
    """Endings of work names that belong to one work only."""
    return report.unique_suffixes(table(spark, root, "source_works"), "work_slug", "-")


_A39 = """WITH p AS (SELECT DISTINCT work_slug, string_split(work_slug, '-') AS p FROM source_works), s AS (SELECT work_slug, p, unnest(range(1, len(p) + 1)) AS i FROM p),
g AS (SELECT array_to_string(list_slice(p, i, len(p)), '-') AS suffix, work_slug FROM s) SELECT suffix, min(work_slug) AS work_slug FROM g GROUP BY suffix HAVING count(*) = 1"""


def t06_suppressed_spans(spark: SparkSession, root: str) -> DataFrame:
    """Per work the widest spans that do not overlap an accepted one."""
    s = table(spark, root, "tafsir_sections").where("ayah_end IS NOT NULL").select("id", "work_id", "surah_no", F.least("ayah_start", "ayah_end").alias("a"), F.greatest("ayah_start", "ayah_end").alias("b"))
    return fusion.suppress_overlaps(s.groupBy("work_id", "surah_no", "a", "b").agg(F.min("id").alias("id")), ["work_id", "surah_no"], "surah_no", "a", "b", (F.col("b") - F.col("a")).desc(), "id").select("work_id", "surah_no", "id", "a", "b", "rank")


def s27_file_digests(spark: SparkSession, root: str) -> DataFrame:
    """Size, digest and number of rows of every file."""
    return readers.file_digests(spark, root)


QUERIES = {
    f.__name__: f
    for f in (
        j01_hydrated_entries, p01_lookup, j05_verse_texts, j20_overridden_works, k09_merged_sections, k10_outcomes, k16_cascade, k17_merged_metadata, a06_hierarchy, a12_length_quantiles, a13_word_buckets, a14_quality_gate,
        a17_preflight, a19_domain_invariants, a27_concept_weights, a32_unused_concepts, a39_unique_suffixes, t06_suppressed_spans, s27_file_digests,
    )
}
ORACLES = {
    "j01_hydrated_entries": _J01, "p01_lookup": _P01, "j05_verse_texts": _J05, "j20_overridden_works": _J20, "k09_merged_sections": _K09, "k10_outcomes": _K10, "k16_cascade": _K16, "k17_merged_metadata": _K17,
    "a06_hierarchy": _A06, "a12_length_quantiles": _A12, "a13_word_buckets": _A13, "a14_quality_gate": _A14, "a17_preflight": _A17, "a19_domain_invariants": _A19, "a27_concept_weights": _A27, "a32_unused_concepts": _A32,
    "a39_unique_suffixes": _A39,
}
