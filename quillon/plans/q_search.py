"""Composed searches: shortlists, boolean full-text queries, hybrid candidates, reranking and evidence gates. Constants of the SQL are typed out, not taken from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, retrieval, search
from quillon.plans import sqltext as sq
from quillon.plans.q_retrieval import _X14, x14_ranked_entries
from quillon.plans.q_spans import _LATEST, verses
from quillon.plans.q_text import _sql_light
from quillon.sources.tables import table, text_table

# --- X1: shortlists of verses for every 20th verse as another work spells it ---


def _shortlists(spark: SparkSession, root: str, short_circuit: bool) -> DataFrame:
    rows = verses(spark, root)
    asked = rows.where("id % 20 = 0").select("language_code", "id", "text_display")
    return search.shortlist(rows, "id", F.col("text_normalized"), asked, "id", F.col("text_display"), ["language_code"], 25, short_circuit)


def x01_verse_shortlists(spark: SparkSession, root: str) -> DataFrame:
    """Verses for a verse as it is displayed: the exact ones, else the best over words, folded words and grams."""
    return _shortlists(spark, root, True)


def g27_open_shortlists(spark: SparkSession, root: str) -> DataFrame:
    """The same without the exact short cut."""
    return _shortlists(spark, root, False)


def _sql_shortlists(short: bool) -> str:
    light, folded = _sql_light("t"), f"translate({_sql_light('t')}, 'ىة', 'اه')"
    grams = "CASE WHEN length(f) <= 3 THEN [f] ELSE list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3)) END"
    forms = f"(SELECT language_code, id, l, f, {sq.words('l')} AS lw, {sq.words('f')} AS fw, {grams} AS g FROM (SELECT language_code, id, {light} AS l, {folded} AS f FROM (@)) WHERE l <> '')"
    terms = "SELECT language_code, id, 'light' AS lane, unnest(list_distinct(lw)) AS term FROM {0} UNION ALL SELECT language_code, id, 'folded', unnest(list_distinct(fw)) FROM {0} UNION ALL SELECT language_code, id, 'gram', unnest(list_distinct(g)) FROM {0}"
    exact = """SELECT language_code, query_id, id, 'exact' AS strategy, NULL::DOUBLE AS score, 0 AS token_overlap, 0 AS gram_overlap, row_number() OVER (PARTITION BY language_code, query_id ORDER BY id) AS rank FROM x QUALIFY rank <= 25 UNION ALL """
    return f"""WITH {_LATEST}, d AS {forms.replace('@', 'SELECT language_code, id, text_normalized AS t FROM v')}, q0 AS {forms.replace('@', 'SELECT language_code, id, text_display AS t FROM v WHERE id % 20 = 0')},
x AS (SELECT DISTINCT d.language_code, q0.id AS query_id, d.id FROM q0 JOIN d ON d.language_code = q0.language_code AND (d.l = q0.l OR d.f = q0.f)),
q AS (SELECT * FROM q0 {'WHERE id NOT IN (SELECT query_id FROM x)' if short else ''}), dt AS ({terms.format('d')}), qt AS ({terms.format('q')}), n AS (SELECT language_code, count(*) AS n FROM d GROUP BY ALL),
i AS (SELECT language_code, lane, term, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM dt JOIN n USING (language_code) GROUP BY ALL),
m AS (SELECT language_code, qt.id AS query_id, dt.id, sum(CASE lane WHEN 'light' THEN idf WHEN 'folded' THEN 0.65 * idf ELSE 0.0 END) AS w, sum(CASE lane WHEN 'gram' THEN 0.35 * idf ELSE 0.0 END) AS g,
count(*) FILTER (lane <> 'gram') AS o, count(*) FILTER (lane = 'gram') AS p FROM qt JOIN i USING (language_code, lane, term) JOIN dt USING (language_code, lane, term) GROUP BY ALL),
c AS (SELECT m.*, len(list_distinct(lw)) AS nw, len(q.g) AS ng, length(f) AS len, o >= CASE WHEN nw <= 2 THEN 1 WHEN nw <= 4 THEN 2 WHEN nw <= 8 THEN 3 ELSE 4 END AS byw FROM m JOIN q ON q.id = m.query_id AND q.language_code = m.language_code),
u AS (SELECT *, len >= 14 OR count(*) FILTER (byw) OVER (PARTITION BY language_code, query_id) < 20 AS use_g FROM c),
k AS (SELECT *, byw OR (use_g AND p >= CASE WHEN ng <= 0 THEN 1 WHEN ng <= 6 THEN 2 WHEN ng <= 14 THEN 3 ELSE 4 END) AS ok FROM u WHERE o > 0 OR (use_g AND p > 0)),
s AS (SELECT language_code, query_id, id, round(w + CASE WHEN use_g THEN g ELSE 0.0 END, 6) AS score, o AS token_overlap, CASE WHEN use_g THEN p ELSE 0 END AS gram_overlap, ok, bool_or(ok) OVER (PARTITION BY language_code, query_id) AS any_ok FROM k)
{exact if short else ''}SELECT language_code, query_id, id, 'token_qgram' AS strategy, score, token_overlap, gram_overlap, row_number() OVER (PARTITION BY language_code, query_id ORDER BY score DESC, token_overlap DESC, gram_overlap DESC, id) AS rank
FROM s WHERE ok OR NOT any_ok QUALIFY rank <= 25"""


# --- boolean full-text queries ---


def _sql_bool(source: str, key: str, fields: dict[str, str], words: list[str], clauses: list[tuple[str, str, float]], features: list[tuple[str, float]], keep: str, least: int, carry: str = "") -> str:
    """The SQL of a boolean query: ``fields`` are word lists of ``source``."""
    stats, parts, hits = [], [], []
    for f in fields:
        stats += [f"count(*) FILTER (len({f}) > 0) AS n_{f}", f"avg(len({f})) FILTER (len({f}) > 0) AS a_{f}", *[f"count(*) FILTER (list_contains({f}, '{w}')) AS d_{f}_{i}" for i, w in enumerate(words)]]
    for kind, f, boost in clauses:
        idf = [f"ln(1 + (n_{f} - d_{f}_{i} + 0.5) / (d_{f}_{i} + 0.5))" for i in range(len(words))]
        has = [f"list_contains({f}, '{w}')" for w in words]
        value = lambda tf, w, f=f: f"CASE WHEN {tf} > 0 THEN {w} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len({f}) / a_{f})) ELSE 0.0 END"
        if kind == "phrase":
            tf = f"len(list_filter(range(1, len({f}) - {len(words) - 2}), lambda i: {f}[i:i + {len(words) - 1}] = {sq.strings(words)}))"
            hit, bm = f"{tf} > 0", value(tf, "(" + " + ".join(idf) + ")")
        else:
            hit, bm = "(" + (" AND " if kind == "and" else " OR ").join(has) + ")", "(" + " + ".join(value(sq.same(f, w), x) for w, x in zip(words, idf)) + ")"
        parts.append(f"CASE WHEN {hit} THEN {boost} * {bm} ELSE 0.0 END")
        hits.append(hit)
    for c, w in features:
        parts.append(f"CASE WHEN {c} THEN {w} ELSE 0.0 END")
        hits.append(f"coalesce({c}, false)")
    lists = ", ".join(f"{e} AS {f}" for f, e in fields.items())
    return f"""WITH d AS (SELECT *, {lists} FROM ({source})), a AS (SELECT {', '.join(stats)} FROM d)
SELECT {key}, round({' + '.join(parts)}, 6) AS score{carry} FROM d, a WHERE ({keep}) AND ({' OR '.join(hits) if least else 'true'})"""


_CONCEPTS = "SELECT parent_hadith_ref AS ref, list_sort(list_distinct(flatten(list(coalesce(central_concept_ids, []))))) AS central, list_sort(list_distinct(flatten(list(coalesce(secondary_concept_ids, []))))) AS secondary, bool_or(coalesce(guidance_role, '') = 'direct_moral_instruction') AS direct FROM guidance_units GROUP BY ALL"


def _topic_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries with chapter title and the concepts of their units, of which there are a few per entry."""
    u = table(spark, root, "guidance_units").groupBy(F.col("parent_hadith_ref").alias("canonical_ref_collection")).agg(
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(n) for c, n in (("central_concept_ids", "central"), ("secondary_concept_ids", "secondary"))],
        F.bool_or(F.coalesce("guidance_role", F.lit("")) == "direct_moral_instruction").alias("direct"),
    )
    chapters = table(spark, root, "hadith_chapters").select(F.col("id").alias("chapter_id"), F.col("title_en").alias("chapter_title"))
    e = table(spark, root, "hadith_entries").select("id", "chapter_id", "canonical_ref_collection", "english_text", "matn_text")
    return e.join(chapters, "chapter_id", "left").join(u, "canonical_ref_collection", "left")


_ENTRIES = f"SELECT e.id, english_text, matn_text, c.title_en AS chapter_title, u.central, u.secondary, u.direct FROM hadith_entries e LEFT JOIN hadith_chapters c ON e.chapter_id = c.id LEFT JOIN ({_CONCEPTS}) u ON u.ref = e.canonical_ref_collection"
_LIST = lambda c: f"coalesce({c}, [])"


def x21_boosted_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries that are no stubs by boosts 8 / 5 on their concepts, 4 / 2.5 on the chapter title, 1 on the body, 0.5 for secondary topics, 40 for a direct statement."""
    words = lambda c: tx.words(tx.normalize_search(c))
    fields = {"concepts": F.coalesce("central", F.array().cast("array<string>")), "title": words(F.col("chapter_title")), "body": words(F.col("matn_text"))}
    clauses = [("phrase", "concepts", 8.0), ("and", "concepts", 5.0), ("phrase", "title", 4.0), ("and", "title", 2.5), ("and", "body", 1.0)]
    features = [(F.coalesce(F.array_contains("secondary", t), F.lit(False)), 0.5) for t in ("mother", "mountain")] + [(F.coalesce("direct", F.lit(False)), 40.0)]
    return search.bool_search(_topic_entries(spark, root), "id", fields, ["early", "counsel"], clauses, features, keep=F.length("english_text") >= 40)


_X21 = _sql_bool(
    _ENTRIES, "id", {"concepts": _LIST("central"), "title": sq.match_words("chapter_title"), "body": sq.match_words("matn_text")}, ["early", "counsel"],
    [("phrase", "concepts", 8.0), ("and", "concepts", 5.0), ("phrase", "title", 4.0), ("and", "title", 2.5), ("and", "body", 1.0)],
    [("list_contains(secondary, 'mother')", 0.5), ("list_contains(secondary, 'mountain')", 0.5), ("direct", 40.0)], "length(english_text) >= 40", 1,
)


def x23_all_entries(spark: SparkSession, root: str) -> DataFrame:
    """Without query words every entry that passes the filters matches with 1.0."""
    return search.bool_search(_topic_entries(spark, root), "id", {"body": tx.words(tx.normalize_search(F.col("matn_text")))}, [], [("and", "body", 1.0)], keep=F.length("english_text") >= 40)


_X23 = "SELECT id, 1.0 AS score FROM hadith_entries WHERE length(english_text) >= 40"


def x25_topical_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents by phrase and words of the title and words of the text, with topic terms, without those of a source that is ruled out, best 40 by score, length and id."""
    words = lambda c: tx.words(tx.normalize_search(F.col(c)))
    rows = text_table(spark, root, "documents").select("doc_id", "title", "text", "lang", "source", "source_domain", F.length("text").alias("len"))
    found = search.bool_search(
        rows, "doc_id", {"title": words("title"), "body": words("text")}, ["garden", "mercy"], [("phrase", "title", 4.2), ("or", "title", 3.1), ("or", "body", 1.0)], [(F.col("source_domain") == "hadith", 1.1)],
        keep=F.col("lang") == "en", must_not=F.col("source").startswith("web"), carry=["len"],
    )
    return found.orderBy(F.col("score").desc(), F.col("len").desc_nulls_last(), "doc_id").limit(40)


_X25 = (
    _sql_bool(
        "SELECT * FROM documents", "doc_id", {"title_w": sq.match_words("title"), "body": sq.match_words("text")}, ["garden", "mercy"], [("phrase", "title_w", 4.2), ("or", "title_w", 3.1), ("or", "body", 1.0)],
        [("source_domain = 'hadith'", 1.1)], "lang = 'en' AND NOT coalesce(starts_with(source, 'web'), false)", 1, ", length(text) AS len",
    ) + " ORDER BY score DESC, len DESC NULLS LAST, doc_id LIMIT 40"
)


def x26_concept_units(spark: SparkSession, root: str) -> DataFrame:
    """Guidance units of one collection by text 1 and summary 1.3, central topics 2.6, secondary ones 1.4, family 1.15; best 30 by score, answerability, directness and little narrative."""
    words = lambda c: tx.words(tx.normalize_search(F.col(c)))
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])
    features = [(F.array_contains("central_concept_ids", t), 2.6) for t in ("counsel", "mountain")] + [(F.array_contains("secondary_concept_ids", t), 1.4) for t in ("counsel", "mountain")] + [(F.col("topic_family") == "charity", 1.15)]
    found = search.bool_search(u, "guidance_unit_id", {"span": words("span_text"), "summary": words("summary_text")}, ["counsel", "mountain"], [("or", "span", 1.0), ("or", "summary", 1.3)], features,
                               keep=F.col("collection_source_id").contains("counsel"), carry=["answerability_score", "directness_score", "narrative_penalty"])
    return found.orderBy(F.col("score").desc(), F.col("answerability_score").desc_nulls_last(), F.col("directness_score").desc_nulls_last(), F.col("narrative_penalty").asc_nulls_last(), "guidance_unit_id").limit(30)


_X26 = (
    _sql_bool(
        "SELECT DISTINCT ON (guidance_unit_id) * FROM guidance_units ORDER BY guidance_unit_id", "guidance_unit_id", {"span": sq.match_words("span_text"), "summary": sq.match_words("summary_text")}, ["counsel", "mountain"],
        [("or", "span", 1.0), ("or", "summary", 1.3)],
        [("list_contains(central_concept_ids, 'counsel')", 2.6), ("list_contains(central_concept_ids, 'mountain')", 2.6), ("list_contains(secondary_concept_ids, 'counsel')", 1.4), ("list_contains(secondary_concept_ids, 'mountain')", 1.4),
         ("topic_family = 'charity'", 1.15)],
        "contains(collection_source_id, 'counsel')", 1, ", answerability_score, directness_score, narrative_penalty",
    ) + " ORDER BY score DESC, answerability_score DESC NULLS LAST, directness_score DESC NULLS LAST, narrative_penalty ASC NULLS LAST, guidance_unit_id LIMIT 30"
)

# --- X13: two stages ---


def x13_two_stage_entries(spark: SparkSession, root: str) -> DataFrame:
    """The thousand best entries by full text, scored field by field, best 20 by score, text rank, number and id; without any full-text hit all entries are scored."""
    e = table(spark, root, "hadith_entries").select("id", "book_id", "chapter_id", "collection_hadith_number", "english_narrator", "english_text", "matn_text")
    books = table(spark, root, "hadith_books").select(F.col("id").alias("book_id"), F.col("title_en").alias("b"))
    chapters = table(spark, root, "hadith_chapters").select(F.col("id").alias("chapter_id"), F.col("title_en").alias("c"))
    rows = e.join(books, "book_id").join(chapters, "chapter_id", "left").withColumn("w", tx.words(tx.normalize_search(F.concat_ws(" ", "b", "c", "english_narrator", "english_text", "matn_text"))))
    stage = search.bool_search(rows, "id", {"all": F.col("w")}, ["garden", "patience", "sabr"], [("or", "all", 1.0)]).withColumnRenamed("score", "rank_score")
    stage = stage.orderBy(F.col("rank_score").desc(), "id").limit(1000)
    any_hit = stage.agg((F.count("*") > 0).alias("any_hit"))
    numbers = e.select("id", "collection_hadith_number")
    scored = x14_ranked_entries(spark, root).join(stage, "id", "left").crossJoin(F.broadcast(any_hit)).where(F.col("rank_score").isNotNull() | ~F.col("any_hit")).join(numbers, "id")
    best = scored.select("id", "score", F.coalesce("rank_score", F.lit(0.0)).alias("rank_score"), "collection_hadith_number")
    return best.orderBy(F.col("score").desc(), F.col("rank_score").desc(), "collection_hadith_number", "id").limit(20)


_X13_STAGE = _sql_bool(
    "SELECT e.id, b.title_en AS b, c.title_en AS c, english_narrator, english_text, matn_text FROM hadith_entries e JOIN hadith_books b ON e.book_id = b.id LEFT JOIN hadith_chapters c ON e.chapter_id = c.id", "id",
    {"all_w": sq.match_words("concat_ws(' ', b, c, english_narrator, english_text, matn_text)")}, ["garden", "patience", "sabr"], [("or", "all_w", 1.0)], [], "true", 1,
)
_X13 = f"""WITH st AS (SELECT id, score AS rank_score FROM ({_X13_STAGE}) ORDER BY score DESC, id LIMIT 1000)
SELECT x.id, x.score, coalesce(rank_score, 0.0) AS rank_score, collection_hadith_number FROM ({_X14}) x LEFT JOIN st ON st.id = x.id JOIN hadith_entries e ON e.id = x.id
WHERE rank_score IS NOT NULL OR NOT EXISTS (SELECT 1 FROM st) ORDER BY score DESC, rank_score DESC, collection_hadith_number, id LIMIT 20"""

# --- X27, X28: hybrid candidates ---


def _slices(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with their slice, their full-text score for two words, and their likeness to the first vector."""
    docs = text_table(spark, root, "documents").select("doc_id", "title", "text", F.concat_ws("/", "source_domain", "lang").alias("slice"), "n_chars")
    words = lambda c: tx.words(tx.normalize_search(F.col(c)))
    text = search.bool_search(docs, "doc_id", {"title": words("title"), "body": words("text")}, ["garden", "mercy"], [("or", "title", 2.5), ("or", "body", 1.0)], carry=["slice"])
    vectors = table(spark, root, "embeddings")
    near = retrieval.knn(vectors, "vec_id", "embedding", vectors.where("vec_id = 0"), "vec_id", "embedding", 100)
    like = near.select(F.col("neighbour_id").alias("doc_id"), F.col("rank").alias("at")).join(docs.select("doc_id", "slice"), "doc_id")
    return docs, text, like


def x27_hybrid_documents(spark: SparkSession, root: str) -> DataFrame:
    """Per slice of domain and language the fused full-text and vector lanes of the slice; thin slices are topped up from all documents; best 20."""
    docs, text, like = _slices(spark, root)
    asked = docs.select("slice").distinct()
    best_text = fusion.top_k(text, ["slice"], 60, F.col("score").desc(), "doc_id").select("slice", "doc_id", "rank")
    best_like = fusion.top_k(like, ["slice"], 60, "at").select("slice", "doc_id", "rank")
    all_text = text.orderBy(F.col("score").desc(), "doc_id").limit(60).withColumn("q", F.lit(1))
    all_text = fusion.with_rank(all_text, ["q"], F.col("score").desc(), "doc_id").select("doc_id", "rank")
    all_like = fusion.with_rank(like.where("at <= 60").withColumn("q", F.lit(1)), ["q"], "at").select("doc_id", "rank")
    relaxed = [asked.crossJoin(F.broadcast(x)) for x in (all_text, all_like)]  # sixty rows a lane
    title = tx.normalize_search(F.col("title"))
    facts = docs.select("doc_id", retrieval.anchored(["garden", "mercy"], F.col("title"), F.col("text")).alias("anchored"), title.contains("garden").alias("boosted"), F.lit(0.9).alias("central"), F.coalesce("n_chars", F.lit(0)).alias("answer"))
    return search.hybrid_candidates([best_text, best_like], relaxed, ["slice"], "doc_id", facts, "anchored", "boosted")


_SLICED = "SELECT *, concat_ws('/', source_domain, lang) AS slice FROM documents"
_X27_TEXT = _sql_bool(_SLICED, "doc_id", {"title_w": sq.match_words("title"), "body": sq.match_words("text")}, ["garden", "mercy"], [("or", "title_w", 2.5), ("or", "body", 1.0)], [], "true", 1, ", slice")
_X27_LIKE = """SELECT e.vec_id AS doc_id, row_number() OVER (ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) DESC, e.vec_id) AS place
FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0 QUALIFY place <= 100"""
_X27 = rf"""WITH s0 AS ({_SLICED}), tx AS ({_X27_TEXT}), lk AS (SELECT doc_id, place, slice FROM ({_X27_LIKE}) JOIN s0 USING (doc_id)), asked AS (SELECT DISTINCT slice FROM s0),
sl AS (SELECT slice, doc_id, row_number() OVER (PARTITION BY slice ORDER BY score DESC, doc_id) AS r FROM tx QUALIFY r <= 60 UNION ALL SELECT slice, doc_id, row_number() OVER (PARTITION BY slice ORDER BY place) AS r FROM lk QUALIFY r <= 60),
st AS (SELECT slice, doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM sl GROUP BY ALL), thin AS (SELECT slice FROM asked LEFT JOIN st USING (slice) GROUP BY slice HAVING count(doc_id) < 5),
rl AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM tx QUALIFY r <= 60 UNION ALL SELECT doc_id, row_number() OVER (ORDER BY place) AS r FROM lk WHERE place <= 60),
rx AS (SELECT slice, doc_id, score FROM thin, (SELECT doc_id, round(sum(1.0 / (60 + r)), 9) AS score FROM rl GROUP BY ALL) z WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.slice = thin.slice AND st.doc_id = z.doc_id)),
al AS (SELECT *, 'strict' AS lane FROM st UNION ALL SELECT *, 'relaxed' FROM rx),
f AS (SELECT al.slice, doc_id, lane, round(al.score * CASE WHEN contains({sq.norm('title')}, 'garden') THEN 1.3 ELSE 1.0 END, 9) AS score,
CASE WHEN lane = 'strict' OR regexp_matches(concat_ws(' ', title, text), '(?i)\b(?:garden|mercy)\b') THEN 0.9 ELSE 0.0 END AS central, coalesce(n_chars, 0) AS answer FROM al JOIN documents USING (doc_id))
SELECT *, row_number() OVER (PARTITION BY slice ORDER BY score DESC, central DESC, answer DESC, doc_id) AS rank FROM f QUALIFY rank <= 20"""


def x28_merged_units(spark: SparkSession, root: str) -> DataFrame:
    """Candidates of a field-weighted and a full-text lane, per parent the better score, best 25 by six keys."""
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"]).where("span_text IS NOT NULL")
    facts = [F.col("answerability_score").alias("answer"), F.col("directness_score").alias("central"), F.col("narrative_penalty").alias("incidental"), F.when(F.col("guidance_role") == "narrative_context", 1.0).otherwise(0.0).alias("narrative")]
    rows = retrieval.with_search_fields(u.select("parent_hadith_ref", "guidance_unit_id", "span_text", "summary_text", *facts), {"span": F.col("span_text"), "summary": F.col("summary_text")})
    carry = ["answer", "central", "incidental", "narrative"]
    lexical = retrieval.field_score("garden mercy", ["garden", "mercy"], "span", 1.0) + retrieval.field_score("garden mercy", ["garden", "mercy"], "summary", 1.8)
    a = rows.select("parent_hadith_ref", "guidance_unit_id", F.round(lexical, 6).alias("score"), *carry).where("score > 0")
    b = search.bool_search(rows, "guidance_unit_id", {"span": F.col("span_tokens"), "summary": F.col("summary_tokens")}, ["garden", "mercy"], [("or", "span", 1.0), ("or", "summary", 1.3)], carry=["parent_hadith_ref", *carry])
    lanes = [fusion.keep_first(x.withColumn("q", F.lit("garden mercy")), ["q", "parent_hadith_ref"], F.col("score").desc(), "guidance_unit_id") for x in (a, b)]
    return search.merged_candidates([x.select("q", "parent_hadith_ref", "score", *carry) for x in lanes], ["q"], "parent_hadith_ref", 25)


_UNITS = "SELECT DISTINCT ON (guidance_unit_id) * FROM guidance_units ORDER BY guidance_unit_id"
_X28_ROWS = f"""SELECT parent_hadith_ref, guidance_unit_id, span_text, summary_text, answerability_score AS answer, directness_score AS central, narrative_penalty AS incidental, CASE WHEN guidance_role = 'narrative_context' THEN 1.0 ELSE 0.0 END AS narrative
FROM ({_UNITS}) WHERE span_text IS NOT NULL"""


def _sql_share(c: str, weight: float) -> str:
    hit = " + ".join(f"CAST(list_contains({sq.search_words(c)}, '{w}') OR contains({sq.norm(c)}, '{w}') AS INT)" for w in ("garden", "mercy"))
    return f"CASE WHEN {sq.norm(c)} = '' THEN 0.0 ELSE {weight} * (2.0 * ({hit}) + CASE WHEN contains({sq.norm(c)}, 'garden mercy') THEN 2.0 ELSE 0.0 END) END"


_X28_TEXT = _sql_bool(_X28_ROWS, "guidance_unit_id", {"span": sq.search_words("span_text"), "summary": sq.search_words("summary_text")}, ["garden", "mercy"], [("or", "span", 1.0), ("or", "summary", 1.3)], [], "true", 1, ", parent_hadith_ref, answer, central, incidental, narrative")
_X28 = f"""WITH a AS (SELECT *, round({_sql_share('span_text', 1.0)} + {_sql_share('summary_text', 1.8)}, 6) AS score FROM ({_X28_ROWS})), b AS ({_X28_TEXT}),
l AS (SELECT parent_hadith_ref, guidance_unit_id, score, answer, central, incidental, narrative, 0 AS lane FROM a WHERE score > 0 UNION ALL SELECT parent_hadith_ref, guidance_unit_id, score, answer, central, incidental, narrative, 1 FROM b),
k AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY lane, parent_hadith_ref ORDER BY score DESC, guidance_unit_id) = 1),
m AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY parent_hadith_ref ORDER BY score DESC, lane) = 1)
SELECT 'garden mercy' AS q, parent_hadith_ref, score, answer, central, incidental, narrative, lane,
row_number() OVER (ORDER BY score DESC, answer DESC NULLS LAST, central DESC NULLS LAST, incidental ASC NULLS FIRST, narrative ASC NULLS FIRST, parent_hadith_ref) AS rank FROM m QUALIFY rank <= 25"""

# --- X32, X33, P13: reranking and the evidence gate ---


def _rerank(spark: SparkSession, root: str) -> DataFrame:
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"]).where("span_text IS NOT NULL AND topic_family IS NOT NULL")
    words = lambda c: F.array_distinct(tx.words(tx.normalize_search(F.col(c))))
    u = u.withColumn("sw", words("span_text")).withColumn("mw", words("summary_text"))
    aligned = F.arrays_overlap(F.coalesce("central_concept_ids", F.array().cast("array<string>")), F.array(F.lit("mercy"), F.lit("counsel"), F.lit("portion")))
    q = F.array(F.lit("garden"), F.lit("mercy"), F.lit("counsel"))
    score = fusion.rerank_score(
        q, {"summary": F.col("mw"), "text": F.col("sw")},
        {"central": F.col("directness_score"), "answer": F.col("answerability_score"), "topic": aligned.cast("int"), "terms": F.arrays_overlap("sw", q).cast("int"), "miss": (~aligned).cast("int"), "narrative": F.col("narrative_penalty")},
        F.when(F.col("guidance_role") == "direct_moral_instruction", 0.12).when(F.col("guidance_role") == "narrative_incident", -0.08).otherwise(0.0),
    )
    return u.withColumn("heuristic", F.round(score, 6)).withColumn("provider", F.when(F.length("span_text") > 0, F.size(F.array_intersect("sw", q)) / F.size(q)))


def x32_reranked_units(spark: SparkSession, root: str) -> DataFrame:
    """Units of a topic family by the heuristic rerank score, blended at 0.45 with another scorer's, which is divided by the family's maximum."""
    rows = _rerank(spark, root)
    return rows.withColumn("score", fusion.blend_with_provider(F.col("heuristic"), F.col("provider"), ["topic_family"])).select("topic_family", "guidance_unit_id", "heuristic", "score")


_X32_Q = "['garden', 'mercy', 'counsel']"


def _sql_overlap(c: str) -> str:
    return f"CASE WHEN least(3, len({c})) > 0 THEN len(list_intersect({_X32_Q}, {c})) / least(3, len({c})) ELSE 0.0 END"


_X32 = f"""WITH u AS (SELECT *, list_distinct({sq.match_words('span_text')}) AS sw, list_distinct({sq.match_words('summary_text')}) AS mw, list_has_any(coalesce(central_concept_ids, []), ['mercy', 'counsel', 'portion']) AS al
FROM ({_UNITS}) WHERE span_text IS NOT NULL AND topic_family IS NOT NULL),
h AS (SELECT topic_family, guidance_unit_id, CASE WHEN length(span_text) > 0 THEN len(list_intersect(sw, {_X32_Q})) / 3 END AS p, round(greatest(0.0, least(1.0, 0.16 * {_sql_overlap('mw')} + 0.10 * {_sql_overlap('sw')} + 0.16 * coalesce(directness_score, 0) + 0.18 * coalesce(answerability_score, 0)
+ CASE WHEN al THEN 0.18 ELSE -0.12 END + CASE WHEN list_has_any(sw, {_X32_Q}) THEN 0.12 ELSE 0.0 END - 0.10 * coalesce(narrative_penalty, 0)
+ CASE guidance_role WHEN 'direct_moral_instruction' THEN 0.12 WHEN 'narrative_incident' THEN -0.08 ELSE 0.0 END)), 6) AS heuristic FROM u),
m AS (SELECT *, max(p) OVER (PARTITION BY topic_family) AS top FROM h)
SELECT topic_family, guidance_unit_id, heuristic, round(greatest(0.0, least(1.0, CASE WHEN top IS NULL THEN heuristic ELSE 0.55 * heuristic + 0.45 * CASE WHEN top > 1e-9 THEN p / top ELSE 0.0 END END)), 4) AS score FROM m"""


def pr13_evidence_gate(spark: SparkSession, root: str) -> DataFrame:
    """Units with the first of the four evidence thresholds they miss, NULL where they pass."""
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])
    gate = search.evidence_gate(F.col("directness_score"), F.when(F.col("answerability_score") > 0, F.col("answerability_score")), F.col("narrative_penalty"), F.when(F.col("guidance_role") == "narrative_context", 0.9).otherwise(0.1), F.col("topic_family").isNull())
    return u.select("guidance_unit_id", gate.alias("missed"))


_P13 = f"""SELECT guidance_unit_id, CASE WHEN coalesce(directness_score, 0) < 0.42 THEN 'centrality' WHEN coalesce(CASE WHEN answerability_score > 0 THEN answerability_score END, directness_score, 0) < 0.48 THEN 'answerability'
WHEN coalesce(narrative_penalty, 0) > 0.45 THEN 'incidental' WHEN topic_family IS NULL AND guidance_role = 'narrative_context' THEN 'narrative' END AS missed FROM ({_UNITS})"""

# --- X41 to X45: guidance units as candidates ---


def x43_unit_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Units of one collection as candidates for a question about two topics: eight-term score, floor, best unit of each parent, best 40."""
    u = table(spark, root, "guidance_units").dropDuplicates(["guidance_unit_id"])
    builder = F.get_json_object("metadata", "$.builder_rank_score").cast("double")
    return search.unit_candidates(u, "guidance_unit_id", "parent_hadith_ref", "span_text", "summary_text", ["counsel", "mountain"], ["counsel", "mountain"], builder, 40, keep=F.col("collection_source_id").contains("counsel"))


def _sql_word_grams(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) + 3), lambda i: substr('  ' || {c} || '  ', i, 3)))"


_X43 = f"""WITH w AS (SELECT *, list_distinct(regexp_extract_all(lower(coalesce(span_text, '') || ' ' || coalesce(summary_text, '')), '[a-z'']+')) AS ws, {sq.norm("concat_ws(' ', span_text, summary_text)")} AS n, {sq.search_words("concat_ws(' ', span_text, summary_text)")} AS tk,
CASE WHEN trim(coalesce(guidance_role, '')) IN ('', 'narrative_context') THEN 'narrative_incident' ELSE trim(guidance_role) END AS role, coalesce(central_concept_ids, []) AS ci, coalesce(secondary_concept_ids, []) AS si,
greatest(0.0, least(1.0, coalesce(TRY_CAST(metadata ->> '$.builder_rank_score' AS DOUBLE), 0.0))) AS b, coalesce(answerability_score, 0.0) AS a, coalesce(directness_score, 0.0) AS dd, coalesce(narrative_penalty, 0.0) AS np FROM ({_UNITS}) WHERE contains(collection_source_id, 'counsel')),
x AS (SELECT *, (CAST(list_contains(ws, 'counsel') AS INT) + CAST(list_contains(ws, 'mountain') AS INT)) / 2 AS ov, CAST(list_contains(ci, 'counsel') AS INT) + CAST(list_contains(ci, 'mountain') AS INT) AS di,
CAST(list_contains(si, 'counsel') AND NOT list_contains(ci, 'counsel') AS INT) + CAST(list_contains(si, 'mountain') AND NOT list_contains(ci, 'mountain') AS INT) AS asd FROM w),
c AS (SELECT *, greatest(0.0, least(1.0, round(0.46 * CASE WHEN di > 0 THEN 1.0 WHEN asd > 0 THEN 0.58 ELSE 0.0 END + 0.22 * dd + 0.14 * a + 0.12 * b + 0.06 * ov - CASE WHEN role = 'narrative_incident' AND di = 0 THEN 0.1 ELSE 0.0 END, 3))) AS central,
CASE WHEN list_contains(tk, 'counsel') THEN 1.0 ELSE 1.0 + ln(2) END AS w1, CASE WHEN list_contains(tk, 'mountain') THEN 1.0 ELSE 1.0 + ln(2) END AS w2, list_contains(tk, 'counsel') OR contains(n, 'counsel') AS h1, list_contains(tk, 'mountain') OR contains(n, 'mountain') AS h2
FROM x WHERE di > 0 OR asd > 0 OR ov >= 0.34),
t AS (SELECT *, (CASE WHEN h1 THEN w1 ELSE 0.0 END + CASE WHEN h2 THEN w2 ELSE 0.0 END) / (w1 + w2) AS share, 0.12 * (CAST(contains(n, 'counsel') AS INT) + CAST(contains(n, 'mountain') AS INT)) AS alias,
coalesce(list_max(list_transform(list_distinct(tk), lambda z: greatest(len(list_intersect({_sql_word_grams("'counsel'")}, {_sql_word_grams('z')})) / len(list_distinct(list_concat({_sql_word_grams("'counsel'")}, {_sql_word_grams('z')}))),
len(list_intersect({_sql_word_grams("'mountain'")}, {_sql_word_grams('z')})) / len(list_distinct(list_concat({_sql_word_grams("'mountain'")}, {_sql_word_grams('z')})))))), 0.0) AS close FROM c),
s AS (SELECT *, CASE WHEN n = '' THEN 0.0 ELSE round(least(1.0, 0.68 * share + least(0.32, alias) + CASE WHEN share < 0.99 AND close >= 0.42 THEN least(0.18, close * 0.22) ELSE 0.0 END), 4) END AS sem FROM t),
r AS (SELECT *, 0.28 * central + 0.12 * ov + 0.18 * sem + 0.12 * round(0.72 * ov + 0.28 * sem, 4) + 0.16 * a + 0.14 * b - 0.18 * np AS sc FROM s),
k AS (SELECT guidance_unit_id, parent_hadith_ref, round(sc, 4) AS score, central, a AS answer, np AS penalty FROM r WHERE sc >= 0.24 AND NOT (role = 'narrative_incident' AND di = 0 AND sem < 0.24 AND sc < 0.58)),
p AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY parent_hadith_ref ORDER BY score DESC, central DESC, answer DESC, penalty, guidance_unit_id) = 1)
SELECT * FROM p ORDER BY score DESC, central DESC, answer DESC, penalty, parent_hadith_ref LIMIT 40"""

QUERIES = {
    f.__name__: f
    for f in (
        x01_verse_shortlists, g27_open_shortlists, x21_boosted_entries, x23_all_entries, x25_topical_documents, x26_concept_units, x13_two_stage_entries, x27_hybrid_documents, x28_merged_units, x32_reranked_units, pr13_evidence_gate,
        x43_unit_candidates,
    )
}
ORACLES = {
    "x01_verse_shortlists": _sql_shortlists(True), "g27_open_shortlists": _sql_shortlists(False), "x21_boosted_entries": _X21, "x23_all_entries": _X23, "x25_topical_documents": _X25, "x26_concept_units": _X26,
    "x13_two_stage_entries": _X13, "x27_hybrid_documents": _X27, "x28_merged_units": _X28, "x32_reranked_units": _X32, "pr13_evidence_gate": _P13, "x43_unit_candidates": _X43,
}
