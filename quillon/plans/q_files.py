"""Readers and sinks in use: tables written in the formats of the readers into the shared folder, read back and compared with the tables by SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import collections as cx
from quillon.functions import text as tx
from quillon.operators import merge
from quillon.plans import pipelines
from quillon.plans.materialize import checkpoint_dir
from quillon.sources import readers, sinks
from quillon.sources.tables import table


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/files-{name}-{uuid.uuid4().hex}"


def s01_csv_verses(spark: SparkSession, root: str) -> DataFrame:
    """Verses as CSV with a header, read back by the key of chapter and verse, split into light and folded words."""
    v = table(spark, root, "quran_ayahs").groupBy("surah_no", "ayah_no").agg(F.min_by("text_display", F.when(F.col("text_display").isNotNull(), F.col("id"))).alias("text"))
    path = _scratch(spark, "csv")
    sinks.write_csv(v, path, ["surah_no", "ayah_no", "text"])
    rows = readers.read_csv(spark, path, "surah_no int, ayah_no int, text string", key=["surah_no", "ayah_no"])
    words = lambda c: F.size(tx.words(c))
    return rows.select("surah_no", "ayah_no", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), words(tx.arabic_light(F.col("text"))).alias("n_light"), words(tx.arabic_aggressive(F.col("text"))).alias("n_folded"))


def _sql_s01() -> str:
    from quillon.plans.q_text import _sql_light

    n = f"len(list_filter(string_split({_sql_light('t')}, ' '), lambda x: x <> ''))"
    return f"""WITH v AS (SELECT surah_no, ayah_no, coalesce(arg_min(text_display, id) FILTER (text_display IS NOT NULL), '') AS t FROM quran_ayahs GROUP BY ALL) SELECT surah_no, ayah_no, md5(t) AS text_md5, {n} AS n_light, {n} AS n_folded FROM v"""


def s05_json_lists(spark: SparkSession, root: str) -> DataFrame:
    """The concept lists of the units as JSON texts in CSV, read back as arrays."""
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])
    path = _scratch(spark, "lists")
    sinks.write_csv(u.select("guidance_unit_id", F.to_json("central_concept_ids").alias("a"), F.to_json("secondary_concept_ids").alias("b")), path, ["guidance_unit_id", "a", "b"])
    rows = readers.json_lists(readers.read_csv(spark, path, "guidance_unit_id string, a string, b string"), "a", "b")
    return rows.select("guidance_unit_id", F.array_join("a", "|").alias("central"), F.size("b").alias("n_secondary"))


_S05 = "SELECT DISTINCT ON (guidance_unit_id) guidance_unit_id, array_to_string(central_concept_ids, '|') AS central, len(secondary_concept_ids) AS n_secondary FROM guidance_units ORDER BY guidance_unit_id"


def s06_jsonl_units(spark: SparkSession, root: str) -> DataFrame:
    """Units as JSON lines with their arrays, read back without those that lack a span."""
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])
    path = _scratch(spark, "jsonl")
    sinks.write_jsonl(u.select("guidance_unit_id", "span_text", "central_concept_ids", "directness_score", "span_start", "metadata"), path, ["guidance_unit_id"])
    rows = readers.read_jsonl(spark, path, readers.UNIT_SCHEMA, ["guidance_unit_id", "span_text"])
    return rows.select("guidance_unit_id", F.md5("span_text").alias("span_md5"), F.size("central_concept_ids").alias("n_concepts"), "directness_score", "span_start")


_S06 = "SELECT DISTINCT ON (guidance_unit_id) guidance_unit_id, md5(span_text) AS span_md5, len(central_concept_ids) AS n_concepts, directness_score, span_start FROM guidance_units WHERE span_text IS NOT NULL ORDER BY guidance_unit_id"


def s07_verse_xml(spark: SparkSession, root: str) -> DataFrame:
    """The verses of one work as XML of chapters and verses, read back from the attributes."""
    esc = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\x00-\x1F]", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    v = table(spark, root, "quran_ayahs").groupBy("surah_no", "ayah_no").agg(F.min("id").alias("id"), F.min_by("text_display", F.when(F.col("text_display").isNotNull(), F.col("id"))).alias("text"))
    aya = F.concat(F.lit('<aya index="'), F.col("ayah_no"), F.lit('" text="'), esc("text"), F.lit('"/>'))
    sura = v.groupBy("surah_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ayah_no", aya.alias("x")))), lambda s: s["x"]), "").alias("x"))  # the verses of a chapter
    path = _scratch(spark, "xml")
    xml = F.concat(F.lit('<quran><sura index="'), F.col("surah_no"), F.lit('" name="n'), F.col("surah_no"), F.lit('">'), F.col("x"), F.lit("</sura></quran>"))
    sura.select(xml.alias("value"), F.col("surah_no").alias("part")).repartition("part").write.partitionBy("part").text(path)
    rows = readers.read_verse_xml(spark, path)
    return rows.select("surah_no", "ayah_no", "surah_name_ar", F.length(tx.collapse(F.col("text_display"))).alias("n_chars"))


_S07 = r"SELECT surah_no, ayah_no, 'n' || surah_no AS surah_name_ar, length(trim(regexp_replace(coalesce(arg_min(text_display, id) FILTER (text_display IS NOT NULL), ''), '[\x00-\x1F\s\p{Z}]+', ' ', 'g'))) AS n_chars FROM quran_ayahs GROUP BY surah_no, ayah_no"


def s09_chapter_files(spark: SparkSession, root: str) -> DataFrame:
    """Commentary of the chapters as one nested JSON file each, with their verses, read back with the faults of the files."""
    t = table(spark, root, "tafsir_sections").groupBy("surah_no", "ayah_start").agg(F.min("id").alias("id"))
    item = F.struct(F.col("id"), F.lit(7).alias("resource_id"), F.concat_ws(":", "surah_no", "ayah_start").alias("verse_key"), F.lit(1).alias("language_id"), F.lit("s").alias("slug"), F.lit("x").alias("text"))
    files = t.groupBy("surah_no").agg(F.array_sort(F.collect_list(item)).alias("tafsirs"))  # one entry per verse of a chapter
    text = F.to_json(F.struct(F.lit(7).alias("resource_id"), F.col("surah_no").alias("chapter_number"), F.size("tafsirs").alias("count"), "tafsirs"))
    path = _scratch(spark, "chapters")
    files.select(text.alias("value"), "surah_no").repartition("surah_no").write.partitionBy("surah_no").text(path)
    rows = readers.read_chapter_files(spark, path, pattern="*.txt")
    return rows.select("chapter_number", "ayah_no", "id", F.array_contains("issues", "contiguous").alias("has_holes"), F.array_contains("issues", "count").alias("bad_count"))


_S09 = """WITH t AS (SELECT surah_no AS chapter_number, ayah_start AS ayah_no, min(id) AS id FROM tafsir_sections GROUP BY ALL)
SELECT *, max(ayah_no) OVER w <> count(*) OVER w OR min(ayah_no) OVER w <> 1 AS has_holes, false AS bad_count FROM t WINDOW w AS (PARTITION BY chapter_number)"""


def s03_optional_translations(spark: SparkSession, root: str) -> DataFrame:
    """S3: translations from an optional file that is there and one that is missing, the text from the first column that has one."""
    v = table(spark, root, "quran_ayahs").where("language_code = 'en'").select("id", "text_display", "text_normalized", "citation_string")
    path = _scratch(spark, "optional")
    sinks.write_csv(v, path, ["id", "text_display", "text_normalized", "citation_string"])
    read = lambda p: readers.read_optional_csv(spark, p, "id int, text_display string, text_normalized string, citation_string string", ["text_display", "text_normalized", "citation_string"])
    return read(path).unionByName(read(path + "-missing")).select("id", F.md5("text").alias("text_md5"))


_S03 = "SELECT id, md5(coalesce(nullif(trim(text_display, ' '), ''), nullif(trim(text_normalized, ' '), ''), nullif(trim(citation_string, ' '), ''))) AS text_md5 FROM quran_ayahs WHERE language_code = 'en'"


def s11_keyed_texts(spark: SparkSession, root: str) -> DataFrame:
    """The verses of each chapter as one object keyed by chapter and verse, read back as rows; empty texts are left out."""
    v = table(spark, root, "quran_ayahs").groupBy("surah_no", "ayah_no").agg(F.min_by(F.coalesce("text_display", F.lit(" ")), "id").alias("t"))
    text = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "surah_no", "ayah_no").alias("k"), F.struct("t").alias("v"))))  # the verses of a chapter
    path = _scratch(spark, "keyed")
    v.groupBy("surah_no").agg(F.to_json(text).alias("value")).repartition("surah_no").write.partitionBy("surah_no").text(path)
    return readers.read_keyed_json(spark, path + "/*").select("surah_no", "ayah_no", F.md5("text").alias("text_md5"))


_S11 = "SELECT surah_no, ayah_no, md5(t) AS text_md5 FROM (SELECT surah_no, ayah_no, arg_min(coalesce(text_display, ' '), id) AS t FROM quran_ayahs GROUP BY ALL) WHERE trim(t, ' ') <> ''"


def s28_table_or_nothing(spark: SparkSession, root: str) -> DataFrame:
    """Works of one domain from a table that is there and from one that is not."""
    table(spark, root, "source_works").createOrReplaceTempView("quillon_works")
    schema = "id int, source_domain string, source_id string"
    found = readers.safe_table(spark, "quillon_works", schema).where("source_domain = 'tafsir'")
    return found.select("id", "source_domain", "source_id").unionByName(readers.safe_table(spark, "quillon_no_such_table", schema))


_S28 = "SELECT id, source_domain, source_id FROM source_works WHERE source_domain = 'tafsir'"


def s12_book_files(spark: SparkSession, root: str) -> DataFrame:
    """A book with its chapters and entries as nested JSON, read back as rows with the chapters' numbers by position."""
    ch = table(spark, root, "hadith_chapters").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id"), F.col("book_id").alias("bookId"), F.lit("a").alias("arabic"), F.col("title_en").alias("english")))).alias("chapters"))  # of one book
    en = table(spark, root, "hadith_entries").groupBy("book_id").agg(
        F.collect_list(F.struct(F.col("id"), F.col("collection_hadith_number").alias("idInBook"), F.col("book_id").alias("bookId"), F.col("chapter_id").alias("chapterId"), F.lit("a").alias("arabic"), F.struct(F.col("english_narrator").alias("narrator"), F.lit("t").alias("text")).alias("english"))).alias("hadiths")
    )
    b = table(spark, root, "hadith_books").select(F.col("id").alias("book_id"), "title_en").join(ch, "book_id", "left").join(en, "book_id", "left")
    path = _scratch(spark, "books")
    title = lambda c: F.struct(c.alias("title"))
    b.select(F.to_json(F.struct(F.col("book_id").alias("id"), F.struct(title(F.col("title_en")).alias("english"), title(F.lit("x")).alias("arabic")).alias("metadata"), "chapters", "hadiths")).alias("value"), "book_id").repartition("book_id").write.partitionBy("book_id").text(path)
    entries = readers.read_book_file(spark, path + "/*")["entries"]
    works = table(spark, root, "hadith_entries").select(F.col("id").alias("upstream_entry_id"), "work_id")
    return pipelines.with_surrogate_keys(entries, works, ["upstream_entry_id"], "work_id").select("upstream_entry_id", "number", "book_id", "chapter_number", "has_chapter", "english_narrator", "work_id")


_S12 = """WITH c AS (SELECT id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY id) AS n FROM hadith_chapters)
SELECT e.id AS upstream_entry_id, collection_hadith_number AS number, e.book_id, c.n AS chapter_number, c.n IS NOT NULL AS has_chapter, english_narrator, e.work_id
FROM hadith_entries e JOIN hadith_books b ON b.id = e.book_id LEFT JOIN c ON c.id = e.chapter_id AND c.book_id = e.book_id"""


def s13_flat_entries(spark: SparkSession, root: str) -> DataFrame:
    """A flat list of entries, parsed into numbers, narrator, body and grade, joined back by number; entries that cannot be parsed name their fault."""
    e = table(spark, root, "hadith_entries").where("collection_hadith_number IS NOT NULL").groupBy("collection_hadith_number").agg(F.min("id").alias("id")).join(table(spark, root, "hadith_entries").select("id", "book_id", "in_book_hadith_number", "english_narrator"), "id")
    place = F.concat(F.lit("Book "), F.col("book_id"), F.lit(", Hadith "), F.col("in_book_hadith_number"))
    flat = e.select(F.concat(F.lit("https://site/x:"), F.col("collection_hadith_number")).alias("Reference"), place.alias("In-book reference"), F.concat(F.col("english_narrator"), F.lit(": the body")).alias("English_Text"), F.lit("Hasan").alias("Grade"))
    path = _scratch(spark, "flat")
    lists = flat.groupBy(F.pmod(F.xxhash64("Reference"), F.lit(8)).alias("part")).agg(F.to_json(F.collect_list(F.struct(*flat.columns))).alias("value"))  # a file is a list
    lists.repartition("part").write.partitionBy("part").text(path)
    rows = readers.read_flat_entries(spark, path)
    joined = e.select(F.col("collection_hadith_number").alias("number"), "id").join(rows, "number", "left")
    return joined.select("id", "number", "book_number", "number_in_book", "english_narrator", "matn_text", "grade_label", "issue")


_S13 = r"""WITH e AS (SELECT * FROM hadith_entries WHERE collection_hadith_number IS NOT NULL QUALIFY row_number() OVER (PARTITION BY collection_hadith_number ORDER BY id) = 1)
SELECT id, collection_hadith_number AS number, CASE WHEN in_book_hadith_number IS NOT NULL THEN book_id END AS book_number, CAST(in_book_hadith_number AS INTEGER) AS number_in_book, CASE WHEN starts_with(english_narrator, 'Narrated ') THEN substr(english_narrator, 10) END AS english_narrator,
CASE WHEN english_narrator IS NULL THEN '' WHEN starts_with(english_narrator, 'Narrated ') THEN 'the body' ELSE english_narrator || ': the body' END AS matn_text, 'hasan' AS grade_label,
CASE WHEN in_book_hadith_number IS NULL THEN 'no_place' WHEN english_narrator IS NULL THEN 'no_text' END AS issue FROM e"""


def s14_delimited_verses(spark: SparkSession, root: str) -> DataFrame:
    """Verses as delimited lines between comments and blank lines, read back by pattern."""
    v = table(spark, root, "quran_ayahs").where("text_display IS NOT NULL").groupBy("surah_no", "ayah_no").agg(F.min_by("text_display", "id").alias("t"))
    path = _scratch(spark, "lines")
    line = F.concat_ws("|", "surah_no", "ayah_no", F.regexp_replace("t", r"\s+", " "))
    v.select(F.explode(F.array(F.lit("# comment"), F.lit("  "), line)).alias("value")).write.text(path)
    return readers.read_delimited(spark, path).select("surah_no", "ayah_no", F.md5(F.replace("text", F.lit(" "), F.lit(""))).alias("text_md5"))


_S14 = r"SELECT surah_no, ayah_no, md5(replace(regexp_replace(arg_min(text_display, id), '[ \t\n\v\f\r]+', ' ', 'g'), ' ', '')) AS text_md5 FROM quran_ayahs WHERE text_display IS NOT NULL GROUP BY surah_no, ayah_no"


def s21_catalogs(spark: SparkSession, root: str) -> DataFrame:
    """Works as a versioned catalog and as an object keyed by slug, read back and joined."""
    w = table(spark, root, "source_works").select(F.col("work_slug").alias("slug"), "priority_rank", F.lower("display_name").alias("label")).dropDuplicates(["slug"])
    a, b = _scratch(spark, "catalog"), _scratch(spark, "keyed")
    w.agg(F.array_sort(F.collect_list(F.struct("slug", "priority_rank"))).alias("items")).select(F.to_json(F.struct(F.lit("v1").alias("version"), "items")).alias("value")).write.text(a)  # one entry per work
    w.agg(F.map_from_entries(F.collect_list(F.struct("slug", F.struct("label")))).alias("topics")).select(F.to_json(F.struct("topics")).alias("value")).write.text(b)
    one = readers.read_catalog(spark, a, "items", "slug:string,priority_rank:int")
    return one.join(readers.read_keyed_catalog(spark, b, "topics", "label:string"), "slug").select("version", "slug", "priority_rank", "label")


_S21 = "SELECT DISTINCT 'v1' AS version, work_slug AS slug, priority_rank, lower(display_name) AS label FROM source_works"


def s24_remaining_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries without an enrichment in the log, whose torn lines are tolerated."""
    e = table(spark, root, "hadith_entries").select("id", "canonical_ref_collection")
    path = _scratch(spark, "log")
    sinks.append_log(table(spark, root, "guidance_units").where("guidance_role = 'warning'").select(F.col("parent_hadith_ref").alias("canonical_ref_collection")).distinct(), path)
    spark.range(1).select(F.lit('{"canonical_ref_collection": "torn').alias("value")).write.mode("append").text(path)
    done = readers.read_jsonl(spark, path, "canonical_ref_collection string, timestamp_utc string", ["canonical_ref_collection"], tolerate=True)
    return readers.todo(e, done, "canonical_ref_collection")


_S24 = "SELECT id, canonical_ref_collection FROM hadith_entries WHERE canonical_ref_collection NOT IN (SELECT parent_hadith_ref FROM guidance_units WHERE guidance_role = 'warning')"


def g06_flat_translations(spark: SparkSession, root: str) -> DataFrame:
    """Verses with their translations as nested service rows, flattened with the first translation of each."""
    v = table(spark, root, "quran_ayahs").where("text_display IS NOT NULL")
    first = v.groupBy("surah_no", "ayah_no").agg(F.min_by("text_display", "id").alias("t"))
    nested = first.select(F.concat_ws(":", "surah_no", "ayah_no").alias("verse_key"), F.array(F.struct(F.concat(F.lit("<b>"), F.lit("id "), F.col("surah_no"), F.lit("</b><sup>1</sup>")).alias("text"))).alias("translations"))
    return pipelines.flat_translations(nested)


_G06 = "SELECT DISTINCT surah_no, ayah_no, 'id ' || surah_no || '1' AS text_display, '<b>id ' || surah_no || '</b><sup>1</sup>' AS text_raw_html FROM quran_ayahs WHERE text_display IS NOT NULL"


def g04_audited_run(spark: SparkSession, root: str) -> DataFrame:
    """The audit row of merging the later deliveries of the sections into the earlier ones."""
    s = table(spark, root, "tafsir_sections").select("canonical_section_id", "work_id", "surah_no", "text_hash", "updated_at", "id")
    old = s.groupBy("canonical_section_id").agg(*[F.min_by(c, F.struct("updated_at", "id")).alias(c) for c in ("work_id", "surah_no", "text_hash")]).where("surah_no <= 60")
    new = s.groupBy("canonical_section_id").agg(*[F.max_by(c, F.struct("updated_at", "id")).alias(c) for c in ("work_id", "surah_no", "text_hash")]).where("surah_no >= 20")
    return pipelines.ingest(old, new, ["canonical_section_id"], ["work_id", "surah_no", "text_hash"], "run-1")[1]


_G04 = """WITH f AS (SELECT canonical_section_id, first(work_id ORDER BY updated_at, id) AS w, first(surah_no ORDER BY updated_at, id) AS s, first(text_hash ORDER BY updated_at, id) AS h, last(work_id ORDER BY updated_at, id) AS w2, last(surah_no ORDER BY updated_at, id) AS s2,
last(text_hash ORDER BY updated_at, id) AS h2 FROM tafsir_sections GROUP BY ALL), x AS (SELECT *, s <= 60 AS o, s2 >= 20 AS n FROM f)
SELECT 'run-1' AS run_id, count(*) FILTER (n AND NOT o) AS n_inserted, count(*) FILTER (n AND o AND (w, s, coalesce(h, '-')) <> (w2, s2, coalesce(h2, '-'))) AS n_updated, count(*) FILTER (n AND o AND (w, s, coalesce(h, '-')) = (w2, s2, coalesce(h2, '-'))) AS n_unchanged,
count(*) FILTER (o AND NOT n) AS n_kept, 'completed' AS status FROM x"""


def k29_audit_totals(spark: SparkSession, root: str) -> DataFrame:
    """Runs added up from their events: counters, last status, first and last time."""
    e = table(spark, root, "events").select(F.col("user_id").alias("run_id"), F.lit(1).alias("n"), F.when(F.col("event_id") % 2 == 0, "running").otherwise("completed").alias("status"), F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id").alias("at"))
    last = merge.run_totals(e, "run_id", ["n"], "status", "at")
    return last.select("run_id", "n", "status", F.unix_micros("opened_at.ts").alias("opened"), F.unix_micros("closed_at.ts").alias("closed"))


_K29 = "SELECT user_id AS run_id, count(*) AS n, CASE WHEN arg_max(event_id, (ts, event_id)) % 2 = 0 THEN 'running' ELSE 'completed' END AS status, epoch_us(min(ts)) AS opened, epoch_us(max(ts)) AS closed FROM events GROUP BY user_id"


def j28_contained_references(spark: SparkSession, root: str) -> DataFrame:
    """Whether the reference of a document lies inside the span of its chapter's first ten verses."""
    d = table(spark, root, "documents").where("quran_ref IS NOT NULL")
    inside = pipelines.contained_reference(F.concat(F.lit("quran:"), F.split_part("quran_ref", F.lit(":"), F.lit(2)), F.lit(":1-10")), F.col("quran_ref"))
    return d.select("doc_id", inside.alias("inside"))


_J28 = r"SELECT doc_id, coalesce(CAST(regexp_extract(quran_ref, '(\d+):(\d+)', 2) AS INTEGER) >= 1 AND greatest(CAST(regexp_extract(quran_ref, '(\d+):(\d+)', 2) AS INTEGER), coalesce(TRY_CAST(nullif(regexp_extract(quran_ref, '(\d+):(\d+)-(\d+)', 3), '') AS INTEGER), 0)) <= 10, false) AS inside FROM documents WHERE quran_ref IS NOT NULL"


def k08_nested_merge(spark: SparkSession, root: str) -> DataFrame:
    """K8: entries and their gradings merged in one go, as the outcomes of both."""
    e = table(spark, root, "hadith_entries").select("work_id", "collection_hadith_number", F.md5("arabic_text").alias("t"), F.length("narrator_chain_text").alias("g"), "id")
    key = ["work_id", "collection_hadith_number"]
    old, new = e.where("id % 5 <> 0").withColumn("t", F.when(F.col("id") % 7 == 0, "old").otherwise(F.col("t"))), e.where("id % 3 <> 0")
    parents, grades = merge.upsert_with_children(old, new, key, ["t"], e.where("id % 4 <> 0").withColumn("g", F.when(F.col("id") % 2 == 0, F.col("g") + 1).otherwise(F.col("g"))), e.where("id % 5 <> 1"), ["g"])
    return parents.select(*key, F.col("outcome").alias("entry")).join(grades.select(*key, "g", F.col("outcome").alias("grading")), key, "full_outer")


_K08 = """WITH p AS (SELECT work_id, collection_hadith_number, CASE WHEN id % 3 = 0 THEN 'kept' WHEN id % 5 = 0 THEN 'inserted' WHEN id % 7 = 0 THEN 'updated' ELSE 'unchanged' END AS entry FROM hadith_entries WHERE id % 5 <> 0 OR id % 3 <> 0),
c AS (SELECT h.*, length(narrator_chain_text) AS n, id % 4 <> 0 AS o, id % 5 <> 1 AND (id % 5 <> 0 OR id % 3 <> 0) AS w FROM hadith_entries h),
g AS (SELECT work_id, collection_hadith_number, CASE WHEN w THEN n WHEN id % 2 = 0 THEN n + 1 ELSE n END AS g, CASE WHEN NOT w THEN 'kept' WHEN NOT o THEN 'inserted' WHEN id % 2 = 0 AND n IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS grading FROM c WHERE o OR w)
SELECT * FROM p FULL JOIN g USING (work_id, collection_hadith_number)"""


def k15_seeded_works(spark: SparkSession, root: str) -> DataFrame:
    """The registry of works seeded again from a fixed list: outcomes of one changed, one new and one equal entry."""
    old = table(spark, root, "source_works").select("source_id", "priority_rank", "enabled")
    first = old.orderBy("source_id").limit(2)
    seeds = first.withColumn("priority_rank", F.when(F.col("source_id") == first.agg(F.min("source_id")).first()[0], -1).otherwise(F.col("priority_rank"))).unionByName(spark.createDataFrame([("new:work", 1, True)], "source_id string, priority_rank int, enabled boolean"))
    return merge.outcome_counts(merge.upsert(old, seeds, ["source_id"], ["priority_rank", "enabled"]))


_K15 = "SELECT * FROM (SELECT 'updated' AS outcome, 1 AS n UNION ALL SELECT 'inserted', 1 UNION ALL SELECT 'unchanged', 1 UNION ALL SELECT 'kept', count(*) - 2 FROM source_works)"


def k18_stored_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Vectors merged into JSON metadata and read from it again; rows without one have none."""
    e = table(spark, root, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, 4), lambda x: F.round(x, 4)).alias("v"))
    rows = table(spark, root, "hadith_entries").select("id", "metadata_json").join(e, "id", "left")
    stored = rows.withColumn("m", F.when(F.col("v").isNotNull(), F.to_json(F.struct(F.col("v").alias("embedding")))).otherwise(F.col("metadata_json").cast("string")))
    back = cx.json_numbers(F.col("m"), "$.embedding")
    return stored.select("id", F.size(back).alias("n"), F.round(F.aggregate(back, F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"))


_K18 = """SELECT h.id, CASE WHEN e.vec_id IS NOT NULL THEN 4 END AS n, round(list_sum(list_transform(e.embedding[1:4], lambda x: CAST(round(x, 4) AS DOUBLE))), 3) AS total FROM hadith_entries h LEFT JOIN embeddings e ON e.vec_id = h.id AND e.vec_id % 2 = 0"""

QUERIES = {
    f.__name__: f
    for f in (
        s01_csv_verses, s03_optional_translations, s11_keyed_texts, s28_table_or_nothing, s05_json_lists, s06_jsonl_units, s07_verse_xml, s09_chapter_files, s12_book_files, s13_flat_entries, s14_delimited_verses, s21_catalogs, s24_remaining_entries, g06_flat_translations, g04_audited_run, k29_audit_totals,
        j28_contained_references, k08_nested_merge, k15_seeded_works, k18_stored_vectors,
    )
}
ORACLES = {
    "s01_csv_verses": _sql_s01(), "s03_optional_translations": _S03, "s11_keyed_texts": _S11, "s28_table_or_nothing": _S28, "s05_json_lists": _S05, "s06_jsonl_units": _S06, "s07_verse_xml": _S07, "s09_chapter_files": _S09, "s12_book_files": _S12, "s13_flat_entries": _S13, "s14_delimited_verses": _S14, "s21_catalogs": _S21,
    "s24_remaining_entries": _S24, "g06_flat_translations": _G06, "g04_audited_run": _G04, "k29_audit_totals": _K29, "j28_contained_references": _J28, "k18_stored_vectors": _K18, "k08_nested_merge": _K08, "k15_seeded_works": _K15,
}
