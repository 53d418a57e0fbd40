"""Retrieval, ranking and similarity queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, index, retrieval, similarity, spans
from quillon.plans import sqltext as sq
from quillon.plans.materialize import cut, keep_where, sorted_join
from quillon.plans.q_spans import _LATEST, CHAPTER, verses
from quillon.sources.tables import table, text_table

QUERY = ["garden", "trust", "patient", "lamp"]
_DOC_WORDS = sq.match_words("text")


def _documents(spark: SparkSession, root: str) -> DataFrame:
    return text_table(spark, root, "documents").select("doc_id", "text", "title", "source", "source_domain", "lang")


def x01_idf_shortlist(spark: SparkSession, root: str) -> DataFrame:
    """The best documents by the idf of the query's words and trigrams."""
    rows = _documents(spark, root).select("doc_id", tx.normalize_search(F.col("text")).alias("n"))
    return retrieval.idf_shortlist(rows, "doc_id", tx.words(F.col("n")), F.col("n"), QUERY, _G, limit=50)


_G = sorted({w[i : i + 3] for w in QUERY for i in range(len(w) - 2)})
_X01 = f"""WITH d AS (SELECT doc_id, {sq.norm('text')} AS n FROM documents),
t AS (SELECT doc_id, 't' AS lane, unnest(list_intersect(list_distinct({sq.words('n')}), {sq.strings(QUERY)})) AS term FROM d
UNION ALL SELECT doc_id, 'g', unnest(list_filter({sq.strings(_G)}, lambda g: contains(n, g))) FROM d),
f AS (SELECT lane, term, ln(1 + ((SELECT count(*) FROM d) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM t GROUP BY lane, term),
s AS (SELECT doc_id, round(sum(idf * CASE lane WHEN 't' THEN 1.0 ELSE 0.35 END), 6) AS score, count(*) FILTER (lane = 't') AS token_overlap, count(*) FILTER (lane = 'g') AS gram_overlap FROM t JOIN f USING (lane, term) GROUP BY doc_id)
SELECT * FROM s WHERE token_overlap >= 2 OR gram_overlap >= 3 ORDER BY score DESC, token_overlap DESC, gram_overlap DESC, doc_id LIMIT 50"""


def _bm25(spark: SparkSession, root: str) -> DataFrame:
    fields = {"title": (tx.words(tx.normalize_search(F.col("title"))), 2.5), "body": (tx.words(tx.normalize_search(F.col("text"))), 1.0)}
    return retrieval.bm25(_documents(spark, root), "doc_id", fields, QUERY)


def x21_bm25(spark: SparkSession, root: str) -> DataFrame:
    """Every document that holds a query word, by BM25 over title and body."""
    return _bm25(spark, root)


def _sql_bm25() -> str:
    parts, stats = [], []
    for f, boost in (("title", 2.5), ("body", 1.0)):
        stats.append(f"avg(len({f})) AS a_{f}")
        for i, w in enumerate(QUERY):
            stats.append(f"count(*) FILTER (list_contains({f}, '{w}')) AS d_{f}_{i}")
            tf = sq.same(f, w)
            idf = f"ln(1 + (n - d_{f}_{i} + 0.5) / (d_{f}_{i} + 0.5))"
            parts.append(f"CASE WHEN {tf} > 0 THEN {boost} * {idf} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len({f}) / a_{f})) ELSE 0.0 END")
    return f"""WITH d AS (SELECT doc_id, {sq.match_words('title')} AS title, {_DOC_WORDS} AS body FROM documents), a AS (SELECT count(*) AS n, {', '.join(stats)} FROM d)
SELECT doc_id, round({' + '.join(parts)}, 6) AS score FROM d, a WHERE list_has_any(title, {sq.strings(QUERY)}) OR list_has_any(body, {sq.strings(QUERY)})"""


_X21 = _sql_bm25()


def x20_fused(spark: SparkSession, root: str) -> DataFrame:
    """The shortlist and the BM25 list joined by reciprocal ranks, best 30."""
    a = fusion.with_rank(x01_idf_shortlist(spark, root).withColumn("q", F.lit(1)), ["q"], F.col("score").desc(), F.col("token_overlap").desc(), F.col("gram_overlap").desc(), "doc_id")
    b = fusion.top_k(_bm25(spark, root).withColumn("q", F.lit(1)), ["q"], 50, F.col("score").desc(), "doc_id")
    fused = fusion.reciprocal_rank_fusion([a, b], ["q"], "doc_id")
    return fusion.top_k(fused, ["q"], 30, F.col("score").desc(), "doc_id").drop("q")


_X20 = f"""WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, token_overlap DESC, gram_overlap DESC, doc_id) AS r, 0 AS lane FROM ({_X01})),
y AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 1 AS lane FROM ({_X21}) QUALIFY r <= 50),
f AS (SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score, min(lane) AS first_lane, count(*) AS n_lanes FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY doc_id)
SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 30"""


def x22_nearest_vectors(spark: SparkSession, root: str) -> DataFrame:
    """For every 20th vector its ten nearest others by cosine."""
    rows = table(spark, root, "embeddings")
    return retrieval.knn(rows, "vec_id", "embedding", rows.where("vec_id % 20 = 0"), "vec_id", "embedding", 10)


_X22 = """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbour_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, neighbour_id) AS rank FROM p QUALIFY rank <= 10"""


def x14_ranked_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries with their book and chapter, scored by field."""
    e = table(spark, root, "hadith_entries").select("id", "book_id", "chapter_id", "english_narrator", "english_text")
    books = table(spark, root, "hadith_books").select(F.col("id").alias("book_id"), F.col("title_en").alias("book_title"))
    chapters = table(spark, root, "hadith_chapters").select(F.col("id").alias("chapter_id"), F.col("title_en").alias("chapter_title"))
    rows = e.join(books, "book_id").join(chapters, "chapter_id", "left")
    rows = retrieval.with_search_fields(rows, {"book": F.col("book_title"), "chapter": F.col("chapter_title"), "body": F.concat_ws(" ", "english_narrator", "english_text")})
    exact, query = ["garden", "patience"], "garden patience"
    wide = ["garden", "patience", "sabr"]
    score = retrieval.weighted_field_score(query, exact, wide, "book", 1.2) + retrieval.weighted_field_score(query, exact, wide, "chapter", 2.2)
    score = score + retrieval.weighted_field_score(query, exact, wide, "body", 1.2)
    return keep_where(rows.select("id", F.round(score, 6).alias("score")), F.col("score") > 0)


def _sql_field(c: str, weight: float) -> str:
    t = sq.search_words(c)
    occurs = f"({sq.same(t, 'garden')} + {sq.same(t, 'patience')})"
    direct = f"(CAST(list_contains({t}, 'garden') AS INT) + CAST(list_contains({t}, 'patience') AS INT))"
    first = f"least(nullif(coalesce(list_position({t}, 'garden'), 0), 0), nullif(coalesce(list_position({t}, 'patience'), 0), 0)) - 1"
    place = f"CASE WHEN {occurs} > 0 THEN least({occurs}, 3) * 0.7 + least({occurs} / greatest(len({t}), 1) * 40.0, 3.0) + greatest(0.0, 1.5 - ({first}) / 20.0) ELSE 0.0 END"
    phrase = f"CASE WHEN contains({sq.norm(c)}, 'garden patience') THEN 3.0 ELSE 0.0 END"
    return f"CASE WHEN {sq.norm(c)} = '' THEN 0.0 ELSE {weight} * (3.0 * {direct} + 2.0 * CAST(list_contains({t}, 'sabr') AS INT) + {phrase} + {place}) END"


_X14 = f"""WITH r AS (SELECT e.id, b.title_en AS book, c.title_en AS chapter, concat_ws(' ', english_narrator, english_text) AS body FROM hadith_entries e JOIN hadith_books b ON e.book_id = b.id LEFT JOIN hadith_chapters c ON e.chapter_id = c.id),
s AS (SELECT id, round({_sql_field('book', 1.2)} + {_sql_field('chapter', 2.2)} + {_sql_field('body', 1.2)}, 6) AS score FROM r) SELECT * FROM s WHERE score > 0"""


def x17_scored_sections(spark: SparkSession, root: str) -> DataFrame:
    """Commentary sections by the share of query words in body and metadata."""
    works = table(spark, root, "source_works").where("enabled").select(F.col("id").alias("work_id"), "display_name", "citation_label")
    rows = text_table(spark, root, "tafsir_sections").select("id", "work_id", "quran_span_ref", "text_plain").join(works, "work_id")
    rows = retrieval.with_search_fields(rows, {"meta": F.concat_ws(" ", "display_name", "citation_label", "quran_span_ref"), "body": F.col("text_plain")})
    score = retrieval.field_score("garden lamp", ["garden", "lamp"], "meta", 1.8) + retrieval.field_score("garden lamp", ["garden", "lamp"], "body", 1.0)
    return keep_where(rows.select("id", F.round(score, 6).alias("score")), F.col("score") > 0)


def _sql_share(c: str, weight: float) -> str:
    hit = " + ".join(f"CAST(list_contains({sq.search_words(c)}, '{w}') OR contains({sq.norm(c)}, '{w}') AS INT)" for w in ("garden", "lamp"))
    return f"CASE WHEN {sq.norm(c)} = '' THEN 0.0 ELSE {weight} * (2.0 * ({hit}) + CASE WHEN contains({sq.norm(c)}, 'garden lamp') THEN 2.0 ELSE 0.0 END) END"


_X17 = f"""WITH r AS (SELECT t.id, concat_ws(' ', display_name, citation_label, quran_span_ref) AS meta, text_plain FROM tafsir_sections t JOIN source_works w ON t.work_id = w.id WHERE enabled),
s AS (SELECT id, round({_sql_share('meta', 1.8)} + {_sql_share('text_plain', 1.0)}, 6) AS score FROM r) SELECT * FROM s WHERE score > 0"""


def x36_gated_units(spark: SparkSession, root: str) -> DataFrame:
    """Guidance units as candidates for their topic family: scored, gated with reasons, ten kept per family."""
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"]).where("topic_family IS NOT NULL AND span_text IS NOT NULL")
    aligned = F.array_contains("central_concept_ids", F.col("topic_family")) | (F.size("central_concept_ids") > 0)
    score = fusion.selection_score({"lexical": F.lit(0.5), "semantic": F.col("directness_score"), "central": F.col("directness_score"), "answer": F.col("answerability_score"), "narrative": F.col("narrative_penalty")}, aligned)
    rows = u.select("guidance_unit_id", "topic_family", "parent_hadith_ref", F.round(score, 6).alias("score"), "answerability_score", "narrative_penalty")
    rows = fusion.keep_first(rows, ["topic_family", "parent_hadith_ref"], F.col("score").desc(), "guidance_unit_id")
    gates = [("score_below_threshold", F.col("score") < 0.42), ("answerability_below_threshold", F.col("answerability_score") < 0.48), ("too_narrative", F.col("narrative_penalty") > 0.5)]
    return fusion.gated_selection(rows, ["topic_family"], "guidance_unit_id", "score", gates, 10).select("topic_family", "guidance_unit_id", "score", "reason", "rank")


_X36 = """WITH u AS (SELECT DISTINCT ON (guidance_unit_id) * FROM guidance_units ORDER BY guidance_unit_id), s AS (SELECT guidance_unit_id, topic_family, parent_hadith_ref,
round(0.16 * 0.5 + 0.18 * directness_score + 0.26 * directness_score + 0.22 * answerability_score - 0.04 * narrative_penalty + CASE WHEN len(central_concept_ids) > 0 THEN 0.08 ELSE 0.0 END, 6) AS score, answerability_score, narrative_penalty
FROM u WHERE topic_family IS NOT NULL AND span_text IS NOT NULL),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY topic_family, parent_hadith_ref ORDER BY score DESC, guidance_unit_id) = 1),
g AS (SELECT *, CASE WHEN score < 0.42 THEN 'score_below_threshold' WHEN answerability_score < 0.48 THEN 'answerability_below_threshold' WHEN narrative_penalty > 0.5 THEN 'too_narrative' END AS r FROM k),
n AS (SELECT *, CASE WHEN r IS NULL THEN row_number() OVER (PARTITION BY topic_family, r IS NULL ORDER BY score DESC, guidance_unit_id) END AS n FROM g)
SELECT topic_family, guidance_unit_id, score, CASE WHEN n > 10 THEN 'beyond_limit' ELSE r END AS reason, CASE WHEN n <= 10 THEN n END AS rank FROM n"""


def j09_verse_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """For every verse up to twelve similar verses of other chapters in the same language."""
    rows = verses(spark, root).where("text_normalized IS NOT NULL")
    tokens = tx.words(tx.normalize_search(F.col("text_normalized")))
    return similarity.neighbours_by_rare_tokens(rows, "id", ["language_code"], "surah_no", tokens, short=True)


_J09 = f"""WITH {_LATEST}, s AS (SELECT id, language_code, surah_no, list_distinct({sq.match_words('text_normalized')}) AS t FROM v WHERE text_normalized IS NOT NULL), e AS (SELECT id, language_code, surah_no, unnest(t) AS w FROM s),
f AS (SELECT language_code, w, count(*) AS df FROM e GROUP BY language_code, w),
a AS (SELECT e.* FROM e JOIN f USING (language_code, w) QUALIFY row_number() OVER (PARTITION BY e.language_code, id ORDER BY df, w) <= 6),
p AS (SELECT DISTINCT a.language_code, a.id AS x, e.id AS y FROM a JOIN e ON a.language_code = e.language_code AND a.w = e.w AND a.id <> e.id AND a.surah_no <> e.surah_no),
c AS (SELECT p.language_code, x, y, len(list_intersect(l.t, r.t)) AS shared, len(l.t) AS n, len(r.t) AS m FROM p JOIN s l ON l.id = x JOIN s r ON r.id = y),
g AS (SELECT *, round(shared * 10 + shared / (n + m - shared) * 100 + shared / n * 100, 6) AS score FROM c WHERE shared >= 4)
SELECT language_code, x AS id, y AS neighbour_id, row_number() OVER (PARTITION BY language_code, x ORDER BY score DESC, shared DESC, y) AS rank, shared, round(shared / n * 100, 2) AS coverage, n - shared AS missing, score FROM g QUALIFY rank <= 12"""


def j09_passage_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """For every passage of one to four verses up to twelve similar passages of as many verses from other chapters of its work.

    Every work and window size has its own postings and document frequencies, so copies of a verse in other works take no places. The token sets are used five times and are written once.
    """
    w = spans.passage_windows(verses(spark, root).where("work_id IS NOT NULL"), CHAPTER, "ayah_no", "text_normalized", [1, 2, 3, 4])
    tokens = F.array_distinct(tx.words(tx.normalize_search(F.col("text"))))
    rows = cut(w.select("work_id", "window_size", "surah_no", F.struct("surah_no", "start_pos").alias("passage"), tokens.alias("t")))
    near = similarity.neighbours_by_rare_tokens(rows, "passage", ["work_id", "window_size"], "surah_no", F.col("t"))
    ends = [F.col("passage.surah_no").alias("surah_no"), F.col("passage.start_pos").alias("start_pos"), F.col("neighbour_id.surah_no").alias("neighbour_surah_no"), F.col("neighbour_id.start_pos").alias("neighbour_start_pos")]
    return near.select("work_id", "window_size", *ends, "rank", "shared", "coverage", "missing", "score")


_PASSAGES = " UNION ALL ".join(
    f"""SELECT work_id, surah_no, {k} AS window_size, ayah_no AS start_pos, list_distinct({sq.match_words('text')}) AS t FROM (SELECT *, max(ayah_no) OVER w AS end_pos, count(*) OVER w AS n, string_agg(coalesce(text_normalized, ''), ' ') OVER w AS text FROM v
WINDOW w AS (PARTITION BY work_id, surah_no ORDER BY ayah_no ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)) WHERE n = {k} AND end_pos - ayah_no = {k - 1}"""
    for k in (1, 2, 3, 4)
)
_J09_PASSAGES = f"""WITH {_LATEST}, s AS ({_PASSAGES}), e AS (SELECT work_id, window_size, surah_no, start_pos, unnest(t) AS w FROM s),
f AS (SELECT work_id, window_size, w, count(*) AS df FROM e GROUP BY ALL),
a AS (SELECT e.* FROM e JOIN f USING (work_id, window_size, w) QUALIFY row_number() OVER (PARTITION BY e.work_id, e.window_size, surah_no, start_pos ORDER BY df, w) <= 6),
p AS (SELECT DISTINCT a.work_id, a.window_size, a.surah_no, a.start_pos, e.surah_no AS neighbour_surah_no, e.start_pos AS neighbour_start_pos FROM a JOIN e ON a.work_id = e.work_id AND a.window_size = e.window_size AND a.w = e.w AND a.surah_no <> e.surah_no),
c AS (SELECT p.*, len(list_intersect(l.t, r.t)) AS shared, len(l.t) AS n, len(r.t) AS m FROM p JOIN s l ON l.work_id = p.work_id AND l.window_size = p.window_size AND l.surah_no = p.surah_no AND l.start_pos = p.start_pos
JOIN s r ON r.work_id = p.work_id AND r.window_size = p.window_size AND r.surah_no = p.neighbour_surah_no AND r.start_pos = p.neighbour_start_pos),
g AS (SELECT *, round(shared * 10 + shared / (n + m - shared) * 100 + shared / n * 100, 6) AS score FROM c WHERE shared >= 4)
SELECT work_id, window_size, surah_no, start_pos, neighbour_surah_no, neighbour_start_pos, row_number() OVER (PARTITION BY work_id, window_size, surah_no, start_pos ORDER BY score DESC, shared DESC, neighbour_surah_no, neighbour_start_pos) AS rank,
shared, round(shared / n * 100, 2) AS coverage, n - shared AS missing, score FROM g QUALIFY rank <= 12"""


def a01_document_frequency(spark: SparkSession, root: str) -> DataFrame:
    """Words of the documents by language with their document frequency and idf."""
    rows = _documents(spark, root).withColumn("w", tx.words(tx.normalize_search(F.col("text"))))
    n = rows.groupBy("source_domain").agg(F.count("*").alias("n"))
    df = index.document_frequency(rows, F.col("w"), ["source_domain"])
    return df.join(F.broadcast(n), "source_domain").select("source_domain", "term", "df", F.round(index.idf_smooth(F.col("n"), F.col("df")), 6).alias("idf"))


_A01 = f"""WITH d AS (SELECT source_domain, unnest(list_distinct({_DOC_WORDS})) AS term FROM documents), f AS (SELECT source_domain, term, count(*) AS df FROM d GROUP BY ALL), n AS (SELECT source_domain, count(*) AS n FROM documents GROUP BY ALL)
SELECT source_domain, term, df, round(ln((n + 1) / (df + 1)) + 1, 6) AS idf FROM f JOIN n USING (source_domain)"""


def a05_distinctive_terms(spark: SparkSession, root: str) -> DataFrame:
    """A4, A5: the eight most distinctive words of every source within its domain."""
    return index.distinctive_terms(_documents(spark, root), ["source_domain", "source"], ["source_domain"], "doc_id", tx.analysis_tokens(F.col("text")), 8)


_A05 = f"""WITH d AS (SELECT doc_id, source_domain, source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}'), lambda t: NOT list_contains({sq.strings(tx.STOPWORDS)}, t)) AS w FROM documents),
n AS (SELECT source_domain, count(DISTINCT doc_id) AS n FROM d GROUP BY ALL), f AS (SELECT source_domain, term, count(*) AS df FROM (SELECT source_domain, unnest(list_distinct(w)) AS term FROM d) GROUP BY ALL),
t AS (SELECT source_domain, source, term, count(*) AS tf FROM (SELECT source_domain, source, unnest(w) AS term FROM d) GROUP BY ALL),
s AS (SELECT source_domain, source, term, tf, round(tf * (ln((n + 1) / (df + 1)) + 1), 6) AS score FROM t JOIN f USING (source_domain, term) JOIN n USING (source_domain))
SELECT *, row_number() OVER (PARTITION BY source_domain, source ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 8"""


def a24_exact_groups(spark: SparkSession, root: str) -> DataFrame:
    """Documents by their exact text: how many share it, and the only one where it is one."""
    return similarity.exact_groups(_documents(spark, root), "doc_id", F.col("text")).select(F.md5("text").alias("text_md5"), "n", "unique_key")


_A24 = "SELECT md5(t) AS text_md5, n, CASE WHEN n = 1 THEN k END AS unique_key FROM (SELECT trim(text, ' ') AS t, count(*) AS n, min(doc_id) AS k FROM documents WHERE trim(coalesce(text, ''), ' ') <> '' GROUP BY 1)"


def h8_one_edit_verses(spark: SparkSession, root: str) -> DataFrame:
    """Similar verses with the words missing in the neighbour, whether they are one word apart, and whether the neighbour is a parallel in the wide sense.

    The pairs are all neighbours of ``j09_verse_neighbours`` and, whatever their rank, all verses of a language that are at most one word apart (from four words on, other places of the text only).
    """
    text = F.col("text_normalized")
    w = cut(verses(spark, root).where("text_normalized IS NOT NULL").select("id", "language_code", "surah_no", "ayah_no", tx.words(tx.normalize_search(text)).alias("a"), tx.words(tx.normalize_search(tx.arabic_aggressive(text))).alias("x")))
    near = j09_verse_neighbours(spark, root).select("id", "neighbour_id")
    edits = similarity.one_edit_pairs(w, "id", ["language_code"], F.col("a")).select("id", "neighbour_id")
    to = w.select(F.col("id").alias("neighbour_id"), F.col("surah_no").alias("s"), F.col("ayah_no").alias("v"), F.col("a").alias("b"), F.col("x").alias("y"))
    both = near.unionByName(edits).distinct().join(sorted_join(w), "id").join(sorted_join(to), "neighbour_id").where(~(F.col("surah_no").eqNullSafe(F.col("s")) & F.col("ayah_no").eqNullSafe(F.col("v"))))
    wide = similarity.relaxed_parallel(F.col("a"), F.col("b"), F.col("x"), F.col("y"))
    return both.select("id", "neighbour_id", similarity.missing_count(F.col("a"), F.col("b")).alias("missing"), similarity.one_edit_apart(F.col("a"), F.col("b")).alias("one_edit"), wide.alias("relaxed_parallel"))


def p12_anchored_sections(spark: SparkSession, root: str) -> DataFrame:
    """Sections in which a query word stands as a word."""
    return table(spark, root, "tafsir_sections").where(retrieval.anchored(["garden", "lamp"], F.col("text_plain"))).select("id")


_P12 = r"SELECT id FROM tafsir_sections WHERE regexp_matches(coalesce(text_plain, ''), '(?i)\b(?:garden|lamp)\b')"

QUERIES = {
    f.__name__: f
    for f in (
        x01_idf_shortlist, x21_bm25, x20_fused, x22_nearest_vectors, x14_ranked_entries, x17_scored_sections, x36_gated_units, j09_verse_neighbours, j09_passage_neighbours, a01_document_frequency, a05_distinctive_terms, a24_exact_groups,
        h8_one_edit_verses, p12_anchored_sections,
    )
}
ORACLES = {
    "x01_idf_shortlist": _X01, "x21_bm25": _X21, "x20_fused": _X20, "x22_nearest_vectors": _X22, "x14_ranked_entries": _X14, "x17_scored_sections": _X17, "x36_gated_units": _X36, "j09_verse_neighbours": _J09,
    "j09_passage_neighbours": _J09_PASSAGES,
    "a01_document_frequency": _A01, "a05_distinctive_terms": _A05, "a24_exact_groups": _A24, "p12_anchored_sections": _P12,
}
