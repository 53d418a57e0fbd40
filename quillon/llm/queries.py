"""Queries of the llm operators and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import charforms, encoding, leakage, neardup, packing, splitting, sqlforms, tokenbudget
from quillon.sources.tables import table, text_table

VERSE_FIELDS = ["text_display", "text_normalized"]


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Verses that look alike in a field but are stored differently."""
    pairs = charforms.alike_pairs(text_table(spark, root, "quran_ayahs"), "id", VERSE_FIELDS)
    return pairs.select(F.col("id_a").alias("ayah_id_a"), F.col("id_b").alias("ayah_id_b"), "field_name")


def p1_canonical_verses(spark: SparkSession, root: str) -> DataFrame:
    """Every verse with the consistent form of both text columns."""
    rows = charforms.with_canonical(text_table(spark, root, "quran_ayahs").select("id", *VERSE_FIELDS), VERSE_FIELDS)
    return rows.select("id", *[F.col(f"{f}_canonical") for f in VERSE_FIELDS], *[(~F.col(f).eqNullSafe(F.col(f"{f}_canonical"))).alias(f"{f}_changed") for f in VERSE_FIELDS])


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Pairs of commentary sections whose word sets are at least 0.7 similar."""
    pairs = neardup.similar_pairs(text_table(spark, root, "tafsir_sections"), "id", "text_plain_normalized", threshold=0.7, min_words=25, guarantee=0.8)
    return pairs.select(F.col("id_a").cast("int").alias("section_id_a"), F.col("id_b").cast("int").alias("section_id_b"))


def p2_groups(spark: SparkSession, root: str) -> DataFrame:
    """Every commentary section with its class of equal word sets, its group of similar texts and its number of links."""
    return neardup.groups(text_table(spark, root, "tafsir_sections"), "id", "text_plain_normalized", threshold=0.7, min_words=25, guarantee=0.8)


_P2 = r"""
WITH w AS (
  SELECT id, list_distinct(regexp_extract_all(lower(text_plain_normalized), '[\p{L}\p{N}]+')) AS s FROM tafsir_sections WHERE text_plain_normalized IS NOT NULL
), b AS (SELECT id, s, len(s) AS n FROM w WHERE len(s) >= 25),
u AS (SELECT id, n, unnest(s) AS t FROM b),
c AS (
  SELECT x.id AS section_id_a, y.id AS section_id_b, any_value(x.n) AS nx, any_value(y.n) AS ny, count(*) AS i
  FROM u x JOIN u y ON x.t = y.t AND x.id < y.id AND x.n >= 0.7 * y.n - 1e-9 AND y.n >= 0.7 * x.n - 1e-9 GROUP BY x.id, y.id
)
SELECT section_id_a, section_id_b FROM c WHERE i >= 0.7 * (nx + ny - i) - 1e-9
"""

_P2_GROUPS = f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT id, list_sort(list_distinct(regexp_extract_all(lower(coalesce(text_plain_normalized, '')), '[\\p{{L}}\\p{{N}}]+'))) AS s FROM tafsir_sections),
k AS MATERIALIZED (SELECT id, CASE WHEN len(s) >= 25 THEN min(id) OVER (PARTITION BY s) ELSE id END AS class_id FROM s),
p AS MATERIALIZED (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM ({_P2}) x JOIN k a ON a.id = section_id_a JOIN k b ON b.id = section_id_b WHERE a.class_id <> b.class_id),
e AS MATERIALIZED (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT DISTINCT class_id AS n, class_id AS r FROM k UNION SELECT e.b, c.r FROM c JOIN e ON e.a = c.n WHERE c.r < e.b),
g AS (SELECT n, min(r) AS r FROM c GROUP BY n), l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT id, class_id, g.r AS group_id, coalesce(l.n, 0) AS n_links FROM k JOIN g ON g.n = class_id LEFT JOIN l ON l.a = class_id
"""

LIMIT, OVERLAP, CAPACITY = 1500, 150, 4096


def _items(spark: SparkSession, root: str) -> DataFrame:
    """Texts to split: commentary sections and guidance units."""
    sections = text_table(spark, root, "tafsir_sections").select(F.lit("tafsir_sections").alias("item_table"), F.col("canonical_section_id").alias("item_key"), F.col("text_plain").alias("text"))
    units = text_table(spark, root, "guidance_units").select(F.lit("guidance_units").alias("item_table"), F.col("guidance_unit_id").alias("item_key"), F.col("span_text").alias("text"))
    return sections.unionByName(units)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Oversized items with the strongest boundary that suffices."""
    rows = splitting.boundary_profile(_items(spark, root), {"item_table": F.col("item_table"), "item_key": F.col("item_key")}, F.col("text"), longer_than=LIMIT)
    return rows.select("item_table", "item_key", splitting.needed_boundary(LIMIT).alias("boundary")).distinct()


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Every item cut into ordered pieces under the limit."""
    return splitting.split_texts(_items(spark, root), {"item_table": F.col("item_table"), "item_key": F.col("item_key")}, F.col("text"), LIMIT, OVERLAP)


def p4_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Every distinct text of an item: how many visible characters its pieces cover, how many pieces are too long, start too early for the overlap or leave a hole in the numbering."""
    items = _items(spark, root).where("text IS NOT NULL")
    pieces = splitting.split_texts(items, {"item_table": F.col("item_table"), "item_key": F.col("item_key"), "text_md5": F.md5("text")}, F.col("text"), LIMIT, OVERLAP).dropDuplicates(["item_table", "item_key", "text_md5", "piece_no"])
    keys = ["item_table", "item_key", "text_md5"]
    before = Window.partitionBy(*keys).orderBy("piece_no").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.greatest(F.lit(0), F.coalesce(F.max("stop").over(before), F.lit(0)) - F.col("start"))
    rows = pieces.withColumn("shared", shared).withColumn("visible", F.length(F.regexp_replace(F.substring("piece", F.col("shared") + 1, F.length("piece")), _BLANKS, "")))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("piece_no")) - 1)
    found = rows.groupBy(*keys).agg(F.sum("visible").alias("visible"), F.count_if(F.length("piece") > LIMIT).alias("too_long"), F.count_if(F.col("shared") > OVERLAP).alias("too_early"), F.count_if(F.col("at") != F.col("piece_no")).alias("holes"))
    return found.where("visible > 0")


_BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]"
_P4_COVERAGE = r"""
WITH i AS (SELECT 'tafsir_sections' AS item_table, canonical_section_id AS item_key, text_plain AS t FROM tafsir_sections UNION ALL SELECT 'guidance_units', guidance_unit_id, span_text FROM guidance_units)
SELECT DISTINCT item_table, item_key, md5(t) AS text_md5, length(regexp_replace(t, '[\s\x{1c}-\x{1f}\x{85}\p{Z}\x{0b}]', '', 'g')) AS visible, 0 AS too_long, 0 AS too_early, 0 AS holes FROM i
WHERE length(regexp_replace(t, '[\s\x{1c}-\x{1f}\x{85}\p{Z}\x{0b}]', '', 'g')) > 0
"""

_P4 = r"""
WITH i AS (
  SELECT 'tafsir_sections' AS item_table, canonical_section_id AS item_key, text_plain AS t FROM tafsir_sections
  UNION ALL SELECT 'guidance_units', guidance_unit_id, span_text FROM guidance_units
), o AS (SELECT DISTINCT * FROM i WHERE length(t) > 1500),
n AS (SELECT item_table, item_key, t, regexp_replace(t, '\r?\n[ \t]*\r?\n', chr(1), 'g') AS p FROM o),
m AS (SELECT *, regexp_replace(p, '([.!?…؟۔])\s+', '\1' || chr(1), 'g') AS s FROM n),
l AS (
  SELECT item_table, item_key,
    list_max(list_transform(string_split(p, chr(1)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')))) AS lp,
    list_max(list_transform(string_split(s, chr(1)), lambda x: length(regexp_replace(x, '^\s+|\s+$', '', 'g')))) AS ls,
    list_max(list_transform(regexp_split_to_array(t, '\s+'), lambda x: length(x))) AS lw
  FROM m
)
SELECT DISTINCT item_table, item_key, CASE WHEN lp <= 1500 THEN 'paragraph' WHEN ls <= 1500 THEN 'sentence' WHEN lw <= 1500 THEN 'word' ELSE 'none' END AS boundary FROM l
"""


def _section_tokens(spark: SparkSession, root: str) -> DataFrame:
    keep = [F.col("work_id"), F.col("canonical_section_id"), tokenbudget.clean_source(F.col("source_id")).alias("source_id"), tokenbudget.clean_language(F.col("language_code")).alias("language_code")]
    return tokenbudget.row_tokens(text_table(spark, root, "tafsir_sections"), "text_plain", keep)


def p5_token_budget(spark: SparkSession, root: str) -> DataFrame:
    """Tokens by source, language and domain: of all delivered sections, and counting each section once."""
    works = table(spark, root, "source_works").select(F.col("id").alias("work_id"), "source_domain")
    rows = tokenbudget.token_budget(_section_tokens(spark, root), ["work_id", "source_id", "language_code"], "canonical_section_id")
    placed = rows.join(works, "work_id", "left").groupBy("source_domain", "source_id", "language_code")
    return placed.agg(*[F.sum(c).alias(c) for c in ("n_rows", "n_with_text", "n_tokens", "n_distinct", "n_distinct_tokens")])


def p5_slices(spark: SparkSession, root: str) -> DataFrame:
    """The slices of the token budget with their rows, and whether every slice with text has tokens and no item more of them than its slice."""
    rows = p5_token_budget(spark, root)
    sound = F.when(F.col("n_with_text") > 0, (F.col("n_tokens") >= F.col("n_with_text")) & (F.col("n_distinct_tokens") <= F.col("n_tokens"))).otherwise(F.col("n_tokens") == 0)
    return rows.select("source_domain", "source_id", "language_code", "n_rows", "n_with_text", "n_distinct", sound.alias("sound"))


_P5_SLICES = r"""
WITH s AS (SELECT work_id, canonical_section_id AS c, lower(regexp_replace(trim(source_id, ' '), '\s*:\s*', ':', 'g')) AS source_id, lower(regexp_extract(coalesce(language_code, ''), '^\s*([A-Za-z]*)', 1)) AS l, coalesce(text_plain, '') <> '' AS t FROM tafsir_sections),
n AS (SELECT *, CASE l WHEN 'eng' THEN 'en' WHEN 'ara' THEN 'ar' WHEN 'urd' THEN 'ur' WHEN 'ind' THEN 'id' WHEN 'in' THEN 'id' WHEN 'tur' THEN 'tr' WHEN 'fra' THEN 'fr' WHEN 'fre' THEN 'fr' WHEN 'rus' THEN 'ru' WHEN '' THEN 'und' ELSE l END AS language_code FROM s)
SELECT source_domain, n.source_id, n.language_code, count(*) AS n_rows, count(*) FILTER (t) AS n_with_text, count(DISTINCT (work_id, c)) AS n_distinct, true AS sound FROM n LEFT JOIN source_works w ON w.id = work_id GROUP BY ALL
"""


def _document_sizes(spark: SparkSession, root: str) -> DataFrame:
    rows = tokenbudget.row_tokens(text_table(spark, root, "documents"), "text", [F.col("doc_id")])
    return rows.select(F.col("doc_id").alias("key"), F.col("n_tokens").alias("size"))


def p6_containers(spark: SparkSession, root: str) -> DataFrame:
    """Assignment of every document, or part of an oversized one, to a container."""
    rows = packing.pack(_document_sizes(spark, root), CAPACITY)
    return rows.select(F.col("key").alias("doc_id"), F.col("chunk").alias("part_no"), F.col("size").alias("n_tokens"), F.col("bin").alias("container_id"), F.col("fill").alias("container_tokens"))


def p6_usage(spark: SparkSession, root: str) -> DataFrame:
    """How many containers there are, how full they are, and the least number that could do."""
    bins = p6_containers(spark, root).groupBy("container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    return bins.agg(
        F.count("*").alias("n_containers"), F.sum("parts").alias("n_parts"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"),
        F.ceil(F.sum("n") / CAPACITY).alias("least_containers"), F.round(F.sum("n") / (F.count("*") * CAPACITY), 6).alias("share_used"),
    )


def p6_audit(spark: SparkSession, root: str) -> DataFrame:
    """One row: every document is placed once with all its tokens, no container is overfull, only documents above the capacity are divided, and few more containers are used than the least number."""
    placed = packing.pack(sizes := _document_sizes(spark, root), CAPACITY)
    per = placed.groupBy("key").agg(F.sum("size").alias("placed"), F.count("*").alias("parts"), F.count_distinct("chunk").alias("chunks")).join(sizes, "key", "full_outer")
    items = per.agg(
        F.count("*").alias("n_documents"), F.count_if(F.coalesce("placed", F.lit(-1)) != F.col("size")).alias("n_wrong"), F.count_if(F.col("parts") != F.col("chunks")).alias("n_repeated"),
        F.count_if((F.col("parts") > 1) & (F.col("size") <= CAPACITY)).alias("n_divided_small"), F.sum("size").alias("tokens"),
    )
    bins = placed.groupBy("bin").agg(F.sum("size").alias("n"), F.max("fill").alias("said"))
    full = bins.agg(F.count("*").alias("bins"), F.count_if(F.col("n") > CAPACITY).alias("n_overfull"), F.count_if(F.col("n") != F.col("said")).alias("n_misstated"))
    least = F.ceil(F.col("tokens") / CAPACITY)
    return items.crossJoin(full).select("n_documents", "n_wrong", "n_repeated", "n_divided_small", "n_overfull", "n_misstated", (F.col("bins") <= F.greatest(least + 1, F.ceil(least * 1.01))).alias("tight"))


_P6_AUDIT = "SELECT count(*) AS n_documents, 0 AS n_wrong, 0 AS n_repeated, 0 AS n_divided_small, 0 AS n_overfull, 0 AS n_misstated, true AS tight FROM documents WHERE doc_id IS NOT NULL"


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.find_leaks(text_table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "passage", window=12)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of a test passage."""
    return _leaks(spark, root).where("run_words >= 12").select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def p7_leaks(spark: SparkSession, root: str) -> DataFrame:
    """The leaks with their longest run, their similarity and whether the passage is there fully."""
    rows = _leaks(spark, root)
    return rows.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "run_words", F.round("similarity", 6).alias("similarity"), F.when(F.col("similarity") >= 0.8, "full").otherwise("partial").alias("extent"))


_PLAIN = r"regexp_extract_all(lower(strip_accents(regexp_replace({0}, '[\x{{064B}}-\x{{0652}}\x{{0670}}]', '', 'g'))), '[\p{{L}}\p{{N}}]+')"
_P7 = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_PLAIN.format('passage')} AS w FROM eval_items),
a AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12), b AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)
SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS run FROM a) x JOIN (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS run FROM b) y USING (run)
"""

_P7_LEAKS = f"""
WITH d AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_PLAIN.format('passage')} AS w FROM eval_items),
a AS (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12), b AS (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12),
h AS (SELECT DISTINCT doc_id, item_id, x.k AS kd, x.k - y.k AS diag FROM (SELECT doc_id, k, array_to_string(w[k : k + 11], ' ') AS run FROM a) x JOIN (SELECT item_id, k, array_to_string(w[k : k + 11], ' ') AS run FROM b) y USING (run)),
g AS (SELECT *, kd - row_number() OVER (PARTITION BY doc_id, item_id, diag ORDER BY kd) AS island FROM h),
r AS (SELECT doc_id, item_id, max(n) + 11 AS run_words FROM (SELECT doc_id, item_id, diag, island, count(*) AS n FROM g GROUP BY ALL) GROUP BY ALL),
si AS (SELECT item_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i WHERE len(w) >= 5)),
wt AS (SELECT s, 1.0 / count(DISTINCT item_id) AS wt FROM si GROUP BY s), sd AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d WHERE len(w) >= 5)) SEMI JOIN wt USING (s)),
total AS (SELECT item_id, sum(wt) AS t FROM si JOIN wt USING (s) GROUP BY ALL), sh AS (SELECT doc_id, item_id, sum(wt) AS part FROM si JOIN wt USING (s) JOIN sd USING (s) GROUP BY ALL),
m AS (SELECT doc_id, item_id, coalesce(run_words, 0) AS run_words, coalesce(part, 0) / t AS sim FROM r FULL JOIN sh USING (doc_id, item_id) JOIN total USING (item_id))
SELECT doc_id, item_id, CAST(run_words AS INTEGER) AS run_words, round(sim, 6) AS similarity, CASE WHEN round(sim, 6) >= 0.8 THEN 'full' ELSE 'partial' END AS extent FROM m WHERE run_words >= 12 OR sim >= 0.8
"""


def p8_restored(spark: SparkSession, root: str) -> DataFrame:
    """Documents with garbled text, the mapping that was undone and the text as far as it could be restored."""
    return encoding.find_garbled(text_table(spark, root, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents with garbled text."""
    return p8_restored(spark, root).select("doc_id")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_canonical_verses, p2_found, p2_groups, p4_found, p4_pieces, p4_coverage, p5_token_budget, p5_slices, p6_containers, p6_usage, p6_audit, p7_found, p7_leaks, p8_found, p8_restored)
}
ORACLES = {"p1_found": sqlforms.alike_pairs(), "p2_found": _P2, "p4_found": _P4, "p7_found": _P7, "p7_leaks": _P7_LEAKS, "p2_groups": _P2_GROUPS, "p4_coverage": _P4_COVERAGE, "p5_slices": _P5_SLICES, "p6_audit": _P6_AUDIT}
