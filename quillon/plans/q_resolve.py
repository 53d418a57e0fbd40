"""Names, slugs, collections in passes and aligned spans, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, quotes, resolve, spans
from quillon.plans import sqltext as sq
from quillon.plans.q_retrieval import _J09, _J09_PASSAGES, j09_passage_neighbours, j09_verse_neighbours
from quillon.plans.q_spans import _LATEST, CHAPTER, verses
from quillon.sources.tables import table


def f30_resolved_names(spark: SparkSession, root: str) -> DataFrame:
    """Names of chapters as they are, without hyphens and spaces, with a dropped, a doubled and a wrong letter, resolved again."""
    s = table(spark, root, "quran_surahs").select("surah_no", "surah_name_en")
    n, v = F.col("surah_name_en"), F.lower("surah_name_en")
    forms = [n, F.replace(v, F.lit("-"), F.lit(" ")), F.regexp_replace(v, "[^a-z]", ""), F.concat(F.substring(v, 1, 3), F.substring(v, F.lit(5), F.length(v))), F.concat(F.substring(v, 1, 2), F.substring(v, F.lit(2), F.length(v))), F.concat(v, F.lit("nt")), F.lit("?")]
    q = s.select("surah_no", F.posexplode(F.array(*forms)).alias("k", "name")).withColumn("query", F.col("surah_no") * 10 + F.col("k"))
    return resolve.resolve_names(q, "query", F.col("name"), s, "surah_no", n)


def _sql_skeleton(c: str) -> str:
    t = f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"
    for a, b in (("sh", "s"), ("th", "t"), ("dh", "d"), ("kh", "k"), ("gh", "g"), ("ph", "f"), ("q", "k"), ("z", "s"), ("w", "u")):
        t = f"replace({t}, '{a}', '{b}')"
    rest = f"regexp_replace(substr({t}, 2), '[aeiouy]', '', 'g')"
    for letter in "bcdfghjklmnpqrstvwxz0123456789":
        rest = f"regexp_replace({rest}, '{letter}+', '{letter}', 'g')"
    return f"substr({t}, 1, 1) || {rest}"


_PLAIN_NAME = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 \\-]+', '', 'g'), '\\s+', ' ', 'g'))"
_F30 = f"""WITH s AS (SELECT surah_no, surah_name_en AS n, lower(surah_name_en) AS v FROM quran_surahs),
q0 AS (SELECT surah_no, unnest([{{'k': 0, 'n': n}}, {{'k': 1, 'n': replace(v, '-', ' ')}}, {{'k': 2, 'n': regexp_replace(v, '[^a-z]', '', 'g')}}, {{'k': 3, 'n': substr(v, 1, 3) || substr(v, 5)}}, {{'k': 4, 'n': substr(v, 1, 2) || substr(v, 2)}}, {{'k': 5, 'n': v || 'nt'}}]) AS x FROM s),
q AS MATERIALIZED (SELECT surah_no * 10 + x.k AS query_id, {_PLAIN_NAME('x.n')} AS p, regexp_replace(lower(x.n), '[^a-z0-9]+', '', 'g') AS c, {_sql_skeleton('x.n')} AS sk FROM q0 WHERE regexp_replace(lower(x.n), '[^a-z0-9]+', '', 'g') <> ''),
k AS MATERIALIZED (SELECT surah_no AS key, {_PLAIN_NAME('n')} AS p, regexp_replace(lower(n), '[^a-z0-9]+', '', 'g') AS c, {_sql_skeleton('n')} AS sk FROM s),
e AS (SELECT query_id, min(key) AS key, 1 AS level FROM q JOIN k USING (p) GROUP BY ALL UNION ALL SELECT query_id, min(key), 2 FROM q JOIN k ON k.p = replace(q.p, ' ', '-') GROUP BY ALL UNION ALL SELECT query_id, min(key), 3 FROM q JOIN k USING (c) GROUP BY ALL
UNION ALL SELECT query_id, min(key), 4 FROM q JOIN k USING (sk) GROUP BY query_id HAVING count(DISTINCT key) = 1),
d AS (SELECT query_id, key, levenshtein(q.sk, k.sk) AS d, greatest(length(q.sk), length(k.sk)) AS n FROM q JOIN k ON true WHERE length(q.c) >= 5 AND len(list_filter(string_split(q.p, ' '), lambda z: z <> '')) <= 4),
b AS (SELECT * FROM d WHERE d <= CASE WHEN n <= 4 THEN 0 WHEN n <= 7 THEN 1 WHEN n <= 11 THEN 2 ELSE 3 END QUALIFY rank() OVER (PARTITION BY query_id ORDER BY d) = 1),
a AS (SELECT * FROM e UNION ALL SELECT query_id, min(key), 5 FROM b GROUP BY query_id HAVING count(*) = 1) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY level) = 1"""


def a40_resolved_slugs(spark: SparkSession, root: str) -> DataFrame:
    """Slugs of works written with another family, leaf or area, resolved again."""
    w = table(spark, root, "source_works").select(F.concat_ws(".", "source_domain", "language_code", F.when(F.col("id") % 3 == 0, "general").when(F.col("id") % 3 == 1, F.concat(F.lit("x"), F.col("id"))).otherwise("other")).alias("known")).distinct()
    p = F.split("known", r"\.")
    raw = w.select(F.explode(F.array("known", F.concat(F.lit("zz."), F.lit("zz."), p[2]), F.concat(p[0], F.lit("."), p[1], F.lit(".none")), F.concat(p[0], F.lit(".none.none")))).alias("raw"))
    return resolve.resolve_slugs(raw, "raw", w, "known")


_A40 = """WITH w AS (SELECT DISTINCT concat_ws('.', source_domain, language_code, CASE id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'x' || id ELSE 'other' END) AS k FROM source_works), p AS (SELECT k, string_split(k, '.') AS p FROM w),
r AS (SELECT DISTINCT unnest([k, 'zz.zz.' || p[3], p[1] || '.' || p[2] || '.none', p[1] || '.none.none']) AS slug FROM p), rp AS (SELECT slug, string_split(slug, '.') AS s FROM r),
sx AS (SELECT e, min(k) AS k FROM (SELECT k, unnest([k, array_to_string(p[2:], '.'), p[3]]) AS e FROM p) GROUP BY e HAVING count(*) = 1),
l AS (SELECT slug, (SELECT k FROM w WHERE k = slug) AS l1, coalesce((SELECT k FROM sx WHERE e = array_to_string(s[2:], '.')), (SELECT k FROM sx WHERE e = s[3])) AS l2, (SELECT k FROM w WHERE k = s[1] || '.' || s[2] || '.general') AS l3,
(SELECT min(k) FROM w WHERE starts_with(k, s[1] || '.' || s[2] || '.') HAVING count(*) = 1) AS l4, (SELECT k FROM w WHERE k = s[1] || '.' || s[2] || '.other') AS l6 FROM rp)
SELECT slug, coalesce(l1, l2, l3, l4, l6) AS resolved, CASE WHEN l1 IS NOT NULL THEN 1 WHEN l2 IS NOT NULL THEN 2 WHEN l3 IS NOT NULL THEN 3 WHEN l4 IS NOT NULL THEN 4 WHEN l6 IS NOT NULL THEN 6 END AS layer FROM l"""


def t07_collected_verses(spark: SparkSession, root: str) -> DataFrame:
    """Per verse up to five similar verses, collected in passes: strong ones, near-identical ones, then two kinds of backfill; those of the next chapter are taken already."""
    n = j09_verse_neighbours(spark, root)
    place = verses(spark, root).select("id", "surah_no")
    n = n.join(place, "id").join(place.select(F.col("id").alias("neighbour_id"), F.col("surah_no").alias("s")), "neighbour_id")
    taken = n.where(F.col("s") == F.col("surah_no") + 1).select("id", "neighbour_id")
    gate = lambda score, coverage: (F.col("score") >= score) & (F.col("coverage") >= coverage)
    passes = [("strong", gate(150, 80)), ("near_identical_sibling", F.col("missing") <= 1), ("alternative_backfill", gate(19, 65)), ("cross_lane_backfill", gate(15, 50))]
    return resolve.collect_in_passes(n, ["id"], "neighbour_id", "rank", passes, 5, taken).select("id", "neighbour_id", "kind", "rank")


_T07 = f"""WITH v0 AS ({_J09}), {_LATEST}, n AS (SELECT n.*, a.surah_no AS s, b.surah_no AS t FROM v0 n JOIN v a ON a.id = n.id JOIN v b ON b.id = n.neighbour_id),
k AS (SELECT *, CASE WHEN score >= 150 AND coverage >= 80 THEN 0 WHEN missing <= 1 THEN 1 WHEN score >= 19 AND coverage >= 65 THEN 2 WHEN score >= 15 AND coverage >= 50 THEN 3 END AS p FROM n WHERE t <> s + 1)
SELECT id, neighbour_id, ['strong', 'near_identical_sibling', 'alternative_backfill', 'cross_lane_backfill'][p + 1] AS kind, row_number() OVER (PARTITION BY id ORDER BY p, rank) AS rank FROM k WHERE p IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, rank) <= 5"""


def j11_parallel_passages(spark: SparkSession, root: str) -> DataFrame:
    """For every passage up to three parallels of its size from other chapters of its work that do not overlap each other, and whether at most four words are missing and half are covered."""
    n = j09_passage_neighbours(spark, root).where("window_size >= 2")
    key = ["work_id", "window_size", "surah_no", "start_pos"]
    n = n.select(*key, "neighbour_surah_no", "neighbour_start_pos", (F.col("neighbour_start_pos") + F.col("window_size") - 1).alias("neighbour_end_pos"), F.col("rank").alias("r"), ((F.col("missing") <= 4) & (F.col("coverage") >= 50)).alias("relaxed_parallel"))
    return fusion.suppress_overlaps(n, key, "neighbour_surah_no", "neighbour_start_pos", "neighbour_end_pos", "r", limit=3).drop("r")


_FREE = lambda n, *taken: " AND ".join(f"NOT ({n}.s = {t}.s AND {n}.a <= {t}.b AND {n}.b >= {t}.a)" for t in taken)
_J11 = f"""WITH n0 AS ({_J09_PASSAGES}), n AS MATERIALIZED (SELECT (work_id, window_size, surah_no, start_pos) AS q, neighbour_surah_no AS s, neighbour_start_pos AS a, neighbour_start_pos + window_size - 1 AS b, rank AS r, missing <= 4 AND coverage >= 50 AS rp FROM n0 WHERE window_size >= 2),
x AS MATERIALIZED (SELECT *, 1 AS k FROM n QUALIFY row_number() OVER (PARTITION BY q ORDER BY r) = 1),
y AS MATERIALIZED (SELECT n.*, 2 AS k FROM n JOIN x ON x.q = n.q WHERE n.r > x.r AND {_FREE('n', 'x')} QUALIFY row_number() OVER (PARTITION BY n.q ORDER BY n.r) = 1),
z AS (SELECT n.*, 3 AS k FROM n JOIN x ON x.q = n.q JOIN y ON y.q = n.q WHERE n.r > y.r AND {_FREE('n', 'x', 'y')} QUALIFY row_number() OVER (PARTITION BY n.q ORDER BY n.r) = 1)
SELECT q[1] AS work_id, q[2] AS window_size, q[3] AS surah_no, q[4] AS start_pos, s AS neighbour_surah_no, a AS neighbour_start_pos, b AS neighbour_end_pos, rp AS relaxed_parallel, k AS rank FROM (SELECT * FROM x UNION ALL SELECT * FROM y UNION ALL SELECT * FROM z)"""

_T06 = """WITH RECURSIVE s AS MATERIALIZED (SELECT work_id, surah_no, least(ayah_start, ayah_end) AS a, greatest(ayah_start, ayah_end) AS b, min(id) AS id FROM tafsir_sections WHERE ayah_end IS NOT NULL GROUP BY ALL),
c AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY work_id, surah_no ORDER BY b - a DESC, id) AS rank FROM s),
r AS (SELECT work_id, surah_no, [{'a': a, 'b': b, 'id': id, 'rank': rank}] AS acc, rank AS last FROM c WHERE rank = 1
UNION ALL SELECT r.work_id, r.surah_no, list_append(any_value(r.acc), arg_min({'a': c.a, 'b': c.b, 'id': c.id, 'rank': c.rank}, c.rank)), min(c.rank) FROM r JOIN c ON c.work_id = r.work_id AND c.surah_no = r.surah_no AND c.rank > r.last
WHERE len(list_filter(r.acc, lambda y: y.a <= c.b AND y.b >= c.a)) = 0 GROUP BY r.work_id, r.surah_no),
m AS (SELECT work_id, surah_no, arg_max(acc, len(acc)) AS acc FROM r GROUP BY work_id, surah_no), f AS (SELECT work_id, surah_no, unnest(acc) AS x FROM m) SELECT work_id, surah_no, x.id AS id, x.a AS a, x.b AS b, x.rank AS rank FROM f"""


def w17_partial_spans(spark: SparkSession, root: str) -> DataFrame:
    """For every 20th verse the longest run of its words in each chapter of the other works of its language that covers 0.55 of them, as a span of verses, and whether it covers 0.78."""
    v = verses(spark, root).where("text_normalized IS NOT NULL")
    words = tx.words(tx.normalize_search(F.col("text_normalized")))
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "language_code", F.col("work_id").alias("own"), words.alias("_t"))
    asked = q.select("query_id", "language_code", "own", F.size("_t").alias("n"), F.posexplode("_t").alias("qpos", "token")).where("n >= 4")
    stream = spans.token_stream(v, ["language_code", *CHAPTER], "ayah_no", words)
    runs = spans.aligned_runs(asked, stream, ["query_id", "own", "n"], CHAPTER, on=["language_code"], least=2)
    kept = runs.where((F.col("own") != F.col("work_id")) & (F.col("run_length") >= 0.55 * F.col("n")))
    at = stream.groupBy("language_code", *CHAPTER, "ayah_no").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1")).drop("language_code")
    found = kept.join(at, CHAPTER).where((F.col("p0") < F.col("stream_start") + F.col("run_length")) & (F.col("p1") >= F.col("stream_start")))
    return found.groupBy("query_id", *CHAPTER, "run_length", "n").agg(F.min("ayah_no").alias("start_pos"), F.max("ayah_no").alias("end_pos")).withColumn("seeded", F.col("run_length") >= 0.78 * F.col("n"))


_W17 = f"""WITH {_LATEST}, t AS (SELECT id, work_id, language_code, surah_no, ayah_no, {sq.match_words('text_normalized')} AS w FROM v WHERE text_normalized IS NOT NULL),
o AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY language_code, work_id, surah_no ORDER BY ayah_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM t),
st AS MATERIALIZED (SELECT language_code, work_id, surah_no, ayah_no, o + i - 1 AS pos, w[i] AS token FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM o)),
q AS MATERIALIZED (SELECT id AS query_id, language_code, work_id AS own, len(w) AS n, i - 1 AS qpos, w[i] AS token FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t WHERE id % 20 = 0 AND len(w) >= 4)),
h AS (SELECT query_id, own, n, qpos, st.work_id, st.surah_no, pos, pos - qpos AS d FROM q JOIN st USING (language_code, token)),
g AS (SELECT *, qpos - row_number() OVER (PARTITION BY query_id, work_id, surah_no, d ORDER BY qpos) AS isl FROM h),
r AS (SELECT query_id, own, n, work_id, surah_no, d, isl, min(qpos) AS qs, min(pos) AS ss, count(*) AS len FROM g GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, own, n, work_id, surah_no ORDER BY len DESC, qs, ss) = 1),
k AS (SELECT * FROM b WHERE own <> work_id AND len >= 0.55 * n), pl AS (SELECT work_id, surah_no, ayah_no, min(pos) AS p0, max(pos) AS p1 FROM st GROUP BY ALL)
SELECT query_id, work_id, surah_no, len AS run_length, n, min(ayah_no) AS start_pos, max(ayah_no) AS end_pos, len >= 0.78 * n AS seeded FROM k JOIN pl USING (work_id, surah_no) WHERE p0 < ss + len AND p1 >= ss GROUP BY ALL"""

def w14_quotation_cascade(spark: SparkSession, root: str) -> DataFrame:
    """Where every 20th verse stands in the other works of its language: passages of one or two verses with its very words, else runs that cover 0.78 of it, else runs that cover 0.55, these also a verse wider on each side."""
    v = verses(spark, root).where("text_normalized IS NOT NULL")
    q = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("work_id").alias("own"), F.col("language_code").alias("lang"), F.trim("text_normalized").alias("text"))
    langs = v.select("work_id", F.col("language_code").alias("lang")).distinct()
    exact = quotes.exact_passages(q, "query_id", F.col("text"), v, CHAPTER, "ayah_no", "text_normalized", [1, 2]).join(q.select("query_id", "own", "lang"), "query_id").join(langs, ["work_id", "lang"], "left_semi").where("work_id <> own")
    runs = w17_partial_spans(spark, root).select("query_id", *CHAPTER, "start_pos", "end_pos", "seeded")
    cols = ["query_id", *CHAPTER, "start_pos", "end_pos"]
    wide = quotes.expanded_spans(runs.where("NOT seeded"), ["query_id", *CHAPTER], "start_pos", "end_pos", 1)
    return quotes.first_stage([exact.select(*cols), runs.where("seeded").select(*cols), wide.select(*cols)], ["query_id"])


_W14 = f"""WITH {_LATEST}, t AS (SELECT * FROM v WHERE text_normalized IS NOT NULL), q AS (SELECT id AS query_id, work_id AS own, language_code AS lang, trim(text_normalized, ' ') AS t FROM t WHERE id % 20 = 0 AND trim(text_normalized, ' ') <> ''),
p AS (SELECT work_id, language_code, surah_no, ayah_no AS start_pos, ayah_no AS end_pos, trim(text_normalized, ' ') AS t FROM t UNION ALL SELECT work_id, language_code, surah_no, ayah_no, e, trim(x, ' ') FROM (SELECT work_id, language_code, surah_no, ayah_no, lead(ayah_no) OVER w AS e,
text_normalized || ' ' || lead(text_normalized) OVER w AS x FROM t WINDOW w AS (PARTITION BY work_id, surah_no ORDER BY ayah_no)) WHERE e = ayah_no + 1),
r AS ({_W17}), n AS (SELECT query_id, work_id, surah_no, unnest(range(greatest(1, start_pos - 1), start_pos + 1)) AS start_pos, end_pos FROM r WHERE NOT seeded),
s AS (SELECT query_id, work_id, surah_no, start_pos, end_pos, 0 AS stage FROM q JOIN p ON p.t = q.t AND p.language_code = q.lang AND p.work_id <> q.own UNION ALL SELECT query_id, work_id, surah_no, start_pos, end_pos, 1 FROM r WHERE seeded
UNION ALL SELECT DISTINCT query_id, work_id, surah_no, start_pos, unnest([end_pos, end_pos + 1]), 2 FROM n)
SELECT * FROM s QUALIFY stage = min(stage) OVER (PARTITION BY query_id)"""

QUERIES = {f.__name__: f for f in (w14_quotation_cascade, f30_resolved_names, a40_resolved_slugs, t07_collected_verses, j11_parallel_passages, w17_partial_spans)}
ORACLES = {"f30_resolved_names": _F30, "a40_resolved_slugs": _A40, "t07_collected_verses": _T07, "j11_parallel_passages": _J11, "t06_suppressed_spans": _T06, "w17_partial_spans": _W17, "w14_quotation_cascade": _W14}
