"""Text queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions import unicode as ux
from quillon.plans import sqltext as sq
from quillon.sources.tables import table, text_table


def _entries(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "hadith_entries")


def f01_normalized_entries(spark: SparkSession, root: str) -> DataFrame:
    """normalized text, its words and search tokens."""
    t = F.col("english_text")
    return _entries(spark, root).select(
        "id", tx.normalize_search(t).alias("normalized"), F.size(tx.words(tx.normalize_search(t))).alias("n_words"), F.size(tx.match_tokens(t)).alias("n_distinct"), F.array_join(tx.search_tokens(t), " ").alias("search_tokens")
    )


_F01 = f"""SELECT id, {sq.norm('english_text')} AS normalized, len({sq.match_words('english_text')}) AS n_words, len(list_distinct({sq.match_words('english_text')})) AS n_distinct,
array_to_string({sq.search_words('english_text')}, ' ') AS search_tokens FROM hadith_entries"""


def f04_label_similarity(spark: SparkSession, root: str) -> DataFrame:
    """Trigram similarity of the names and labels of works."""
    return table(spark, root, "source_works").select("id", F.round(tx.trigram_similarity(F.col("display_name"), F.col("citation_label")), 6).alias("similarity"))


_A, _B = sq.norm("display_name"), sq.norm("citation_label")
_F04 = f"""WITH n AS (SELECT id, {_A} AS a, {_B} AS b FROM source_works), g AS (SELECT id, a, b, {sq.grams("'  ' || a || '  '")} AS x, {sq.grams("'  ' || b || '  '")} AS y FROM n)
SELECT id, round(CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS similarity FROM g"""


def f06_snippets(spark: SparkSession, root: str) -> DataFrame:
    """the place of a query in each entry."""
    return _entries(spark, root).where(tx.normalize_search(F.col("english_text")).contains("garden")).select("id", tx.snippet(F.col("english_text"), "garden").alias("snippet"))


def f08_arabic_forms(spark: SparkSession, root: str) -> DataFrame:
    """The light and the aggressive Arabic form of the verses."""
    return table(spark, root, "quran_ayahs").where("language_code = 'ar'").select("id", tx.arabic_light(F.col("text_display")).alias("light"), tx.arabic_aggressive(F.col("text_display")).alias("aggressive"))


def _sql_light(c: str) -> str:
    def sub(x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, '{p}', '{to}', 'g')"

    t = sub(f"coalesce({c}, '')", r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]", "")
    t = sub(sub(t, "ـ", ""), "[﴾﴿]", " ")
    t = sub(t, r"(^|\s)[(\[{]*[0-9٠-٩۰-۹]+[)\]}]*(\s|$)", " ")
    t = sub(sub(t, r"[\x{06D6}-\x{06ED}]", ""), "[،؛؟۔,;?!:.…﴿﴾]", " ")
    t = f"trim({sub(t, r'[\s\p{Z}]+', ' ')})"
    t = f"translate({t}, 'أإآٱٲٳٵؤئىء', 'اااااااويي')"
    return f"trim({sub(sub(t, r'[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]', ''), r'[\s\p{Z}]+', ' ')})"


_F08 = f"SELECT id, {_sql_light('text_display')} AS light, translate({_sql_light('text_display')}, 'ىة', 'اه') AS aggressive FROM quran_ayahs WHERE language_code = 'ar'"


def f12_plain_from_markup(spark: SparkSession, root: str) -> DataFrame:
    """Text of the sections' markup and its hash."""
    t = tx.html_to_text(F.col("text_html"))
    return text_table(spark, root, "tafsir_sections").select("id", t.alias("plain"), tx.text_hash(t).alias("plain_hash"))


def _sql_html(c: str) -> str:
    t = rf"regexp_replace(coalesce({c}, ''), '(?i)<\s*br\s*/?>|</\s*(p|div|li|h[1-6]|tr)\s*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for e, x in tx.ENTITIES.items():
        t = f"replace({t}, '{e}', '{x.replace(chr(39), chr(39) * 2)}')"
    t = rf"regexp_replace(regexp_replace({t}, '[ \t]+', ' ', 'g'), ' ?\n ?', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({t}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


_F12 = f"SELECT id, {_sql_html('text_html')} AS plain, sha256({_sql_html('text_html')}) AS plain_hash FROM tafsir_sections"


def f13_compatibility_form(spark: SparkSession, root: str) -> DataFrame:
    """the Unicode compatibility form of the verses."""
    return table(spark, root, "quran_ayahs").select("id", ux.nfkc("text_display").alias("nfkc"))


def f12_parsed_markup(spark: SparkSession, root: str) -> DataFrame:
    """visible text of any markup, by a parser."""
    return text_table(spark, root, "tafsir_sections").select("id", ux.parsed_html("text_html").alias("plain"))


LEADS = ["the word", "some readers take", "it is better that", "in this passage", "what does"]


def f18_without_leads(spark: SparkSession, root: str) -> DataFrame:
    """units without their opening phrase, and their compact form."""
    rows = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])
    return rows.select("guidance_unit_id", tx.without_lead(F.col("span_text"), LEADS).alias("rest"), F.length(tx.compact(F.col("span_text"))).alias("n_compact"))


_F18 = rf"""SELECT guidance_unit_id, trim(regexp_replace({sq.norm('span_text')}, '^(?:it is better that|some readers take|in this passage|what does|the word)\b\s*', '')) AS rest,
length(regexp_replace(lower(coalesce(span_text, '')), '[^a-z0-9]+', '', 'g')) AS n_compact FROM (SELECT DISTINCT guidance_unit_id, span_text FROM guidance_units)"""


def f24_entry_bodies(spark: SparkSession, root: str) -> DataFrame:
    """entries without attribution, sentence counts, first sentences and a short form."""
    t = F.concat_ws(": ", "english_narrator", "english_text")
    split = tx.narrator_and_body(t)
    body = tx.clean_attribution(t)
    return _entries(spark, root).select("id", split["narrator"].alias("narrator"), F.size(tx.sentences(body)).alias("n_sentences"), tx.take_sentences(body, 2, 200).alias("opening"), tx.truncate(body, 80).alias("short"))


_BODY = r"trim(regexp_replace(regexp_replace(concat_ws(': ', english_narrator, english_text), '(?i)narrated\s+[^:]{2,80}:', ' ', 'g'), '\s+', ' ', 'g'))"
_F24 = rf"""WITH b AS (SELECT id, concat_ws(': ', english_narrator, english_text) AS t, {_BODY} AS body FROM hadith_entries),
s AS (SELECT *, list_filter(string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM b)
SELECT id, CASE WHEN regexp_matches(t, '(?is)^\s*narrated\s+([^:]{{2,120}}):\s*(.*)$') THEN trim(regexp_extract(t, '(?is)^\s*narrated\s+([^:]{{2,120}}):\s*(.*)$', 1)) END AS narrator, len(ss) AS n_sentences,
CASE WHEN len(ss) = 0 THEN '' WHEN len(ss) > 1 AND length(ss[1]) + 1 + length(ss[2]) <= 200 THEN ss[1] || ' ' || ss[2] ELSE ss[1] END AS opening,
CASE WHEN length(body) <= 80 THEN body ELSE rtrim(substr(body, 1, 79)) || '…' END AS short FROM s"""


def f25_phrases(spark: SparkSession, root: str) -> DataFrame:
    """which phrases stand in each unit at word boundaries."""
    phrases = ["patient page", "it is better", "asked", "the word", "second half", "some readers", "honest"]
    rows = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])
    return rows.select("guidance_unit_id", F.array_join(tx.matched_phrases(F.col("span_text"), phrases), "|").alias("phrases"))


_PH = ", ".join(rf"CASE WHEN regexp_matches(coalesce(span_text, ''), '(?i)\b{p.replace(' ', chr(92) + 's+')}\b') THEN '{p}' END" for p in ["patient page", "it is better", "asked", "the word", "second half", "some readers", "honest"])
_F25 = f"SELECT guidance_unit_id, array_to_string(list_slice(list_filter([{_PH}], lambda x: x IS NOT NULL), 1, 6), '|') AS phrases FROM (SELECT DISTINCT guidance_unit_id, span_text FROM guidance_units)"


def f27_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """excerpts of the sections that end with a sentence where possible."""
    return table(spark, root, "tafsir_sections").select("id", tx.excerpt(F.col("text_plain")).alias("excerpt"))


def f34_references(spark: SparkSession, root: str) -> DataFrame:
    """the first verse reference of every document, parsed and formatted again."""
    ref = tx.verse_reference(F.col("text"))
    rows = table(spark, root, "documents").select("doc_id", ref.alias("r")).where("r IS NOT NULL")
    return rows.select("doc_id", "r.surah", "r.ayah_start", "r.ayah_end", tx.format_reference(F.col("r.surah"), F.col("r.ayah_start"), F.col("r.ayah_end")).alias("citation"))


_REFS = [p.replace("'", "''") for p in tx.VERSE_REFERENCE]
_F34 = f"""WITH m AS (SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN [regexp_extract(text, '{p}', 1), regexp_extract(text, '{p}', 2), regexp_extract(text, '{p}', 3)]" for p in _REFS)} END AS g FROM documents),
n AS (SELECT doc_id, CAST(g[1] AS INTEGER) AS s, CAST(g[2] AS INTEGER) AS a, CAST(CASE WHEN g[3] = '' THEN g[2] ELSE g[3] END AS INTEGER) AS b FROM m WHERE g IS NOT NULL),
o AS (SELECT doc_id, s AS surah, least(a, b) AS ayah_start, greatest(a, b) AS ayah_end FROM n)
SELECT *, 'quran:' || surah || ':' || ayah_start || CASE WHEN ayah_end > ayah_start THEN '-' || ayah_end ELSE '' END AS citation FROM o"""


def f47_gram_counts(spark: SparkSession, root: str) -> DataFrame:
    """q-grams of every verse."""
    g = tx.qgrams(F.col("text_normalized"))
    return table(spark, root, "quran_ayahs").select("id", F.size(g).alias("n_grams"), F.size(F.array_distinct(g)).alias("n_distinct"))


_F47 = f"""WITH t AS (SELECT id, trim(coalesce(text_normalized, ''), ' ') AS t FROM quran_ayahs), g AS (SELECT id, CASE WHEN t = '' THEN [] WHEN length(t) <= 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END AS g FROM t)
SELECT id, len(g) AS n_grams, len(list_distinct(g)) AS n_distinct FROM g"""


def f48_keys(spark: SparkSession, root: str) -> DataFrame:
    """hashes and numbers of references."""
    return _entries(spark, root).select("id", tx.client_key(F.col("canonical_ref_collection"), F.col("english_narrator")).alias("client_key"), tx.collection_number(F.col("canonical_ref_collection")).alias("number"))


_F48 = r"SELECT id, substr(sha1(concat_ws('|', canonical_ref_collection, english_narrator)), 1, 24) AS client_key, CAST(regexp_extract(canonical_ref_collection, '(\d+)\D*$', 1) AS INTEGER) AS number FROM hadith_entries"


def h5_label_matches(spark: SparkSession, root: str) -> DataFrame:
    """H5: how well the names and labels of works match block by block."""
    return table(spark, root, "source_works").select("id", F.round(ux.matcher_ratio(F.lower("display_name"), F.lower("citation_label")), 2).alias("matcher"))


def h1_narration_ratios(spark: SparkSession, root: str) -> DataFrame:
    """H1: fuzzy ratios of a unit's text and summary."""
    rows = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"]).where("span_text IS NOT NULL AND summary_text IS NOT NULL")
    scored = rows.select("guidance_unit_id", ux.fuzzy_ratios(tx.normalize_search(F.col("span_text")), tx.normalize_search(F.col("summary_text"))).alias("r"))
    return scored.select("guidance_unit_id", *[F.round(f"r.{k}", 2).alias(k) for k in ux.RATIOS])


QUERIES = {
    f.__name__: f
    for f in (
        f01_normalized_entries, f04_label_similarity, f06_snippets, f08_arabic_forms, f12_plain_from_markup, f12_parsed_markup, f13_compatibility_form, f18_without_leads, f24_entry_bodies, f25_phrases, f27_excerpts,
        f34_references, f47_gram_counts, f48_keys, h1_narration_ratios, h5_label_matches,
    )
}
ORACLES = {
    "f01_normalized_entries": _F01, "f04_label_similarity": _F04, "f08_arabic_forms": _F08, "f12_plain_from_markup": _F12, "f18_without_leads": _F18, "f24_entry_bodies": _F24, "f25_phrases": _F25, "f34_references": _F34,
    "f47_gram_counts": _F47, "f48_keys": _F48,
}
