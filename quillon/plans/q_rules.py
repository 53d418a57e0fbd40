"""Classification and state queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.functions import unicode as ux
from quillon.operators import rules, spans, state
from quillon.plans import sqltext as sq
from quillon.sources.tables import table

_UNITS = "u AS (SELECT DISTINCT ON (guidance_unit_id) * FROM guidance_units WHERE span_text IS NOT NULL ORDER BY guidance_unit_id)"


def _units(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "guidance_units").where("span_text IS NOT NULL").dropDuplicates(["guidance_unit_id"])


def _marks(c: str, markers: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{m}')" for m in markers) + ")"


def m11_unit_scores(spark: SparkSession, root: str) -> DataFrame:
    """Role and scores of every guidance unit from its text."""
    rows = rules.with_unit_scores(_units(spark, root), "span_text", "role", F.size("central_concept_ids"), F.lit(0.9))
    return rows.select("guidance_unit_id", "role", "directness", "answerability", "narrative", "rank_score")


def _sql_unit_scores() -> str:
    t, role = "span_text", "role"
    case = f"""CASE WHEN {_marks(t, ['do not', 'beware', 'shall not', 'should not', 'must not', 'none of you', 'whoever', 'the best', 'best of'])} THEN 'direct_moral_instruction'
WHEN {_marks(t, ['beware', 'warning', 'punishment', 'do not', 'forbidden', 'woe'])} THEN 'warning' WHEN {_marks(t, ['best', 'virtue', 'reward', 'superior', 'believer', 'good deed', 'patience is'])} THEN 'virtue_statement' ELSE 'narrative_incident' END"""
    told = _marks(t, ["while we were", "then a man", "thereupon", "they asked", "she asked", "he asked", "during", "journey", "campaign", "battle", "wives of the prophet", "noticed anger on his face"])
    active = f"{role} IN ('direct_moral_instruction', 'warning', 'virtue_statement')"
    clip = lambda x: f"greatest(0.0, least(1.0, round({x}, 3)))"
    direct = clip(
        f"CASE {role} WHEN 'direct_moral_instruction' THEN 0.74 WHEN 'warning' THEN 0.68 WHEN 'virtue_statement' THEN 0.66 ELSE 0.26 END + CASE WHEN contains(lower({t}), 'the prophet') OR contains(lower({t}), 'allah''s messenger') THEN 0.06 ELSE 0 END"
        f" + CASE WHEN length({t}) <= 220 THEN 0.06 WHEN length({t}) >= 700 THEN -0.14 WHEN length({t}) >= 420 THEN -0.08 ELSE 0 END"
    )
    answer = clip(f"0.28 + 0.12 * least(n, 2) + 0.18 * 0.9 + CASE WHEN {active} THEN 0.1 ELSE 0 END + CASE WHEN length({t}) <= 240 THEN 0.06 WHEN length({t}) >= 500 THEN -0.08 ELSE 0 END")
    narrative = clip(
        f"CASE WHEN {role} = 'narrative_incident' THEN 0.14 ELSE 0.03 END + CASE WHEN {told} THEN 0.12 ELSE 0 END + CASE WHEN length({t}) >= 700 THEN 0.24 WHEN length({t}) >= 360 THEN 0.12 ELSE 0 END"
    )
    rank = clip(f"0.34 * 0.9 + 0.22 * directness + 0.22 * answerability + CASE WHEN n > 0 THEN least(0.22, 0.12 * n) ELSE 0 END + CASE WHEN {active} THEN 0.12 ELSE -0.02 END - 0.22 * narrative")
    return f"""WITH {_UNITS}, r AS (SELECT guidance_unit_id, span_text, len(central_concept_ids) AS n, {case} AS role FROM u),
s AS (SELECT *, CAST({direct} AS DOUBLE) AS directness, CAST({answer} AS DOUBLE) AS answerability, CAST({narrative} AS DOUBLE) AS narrative FROM r) SELECT guidance_unit_id, role, directness, answerability, narrative, CAST({rank} AS DOUBLE) AS rank_score FROM s"""


def p20_assessed_units(spark: SparkSession, root: str) -> DataFrame:
    """P20: whether each unit's text can be verified, and why not."""
    rows = _units(spark, root).select("guidance_unit_id", rules.assess_text(F.col("span_text")).alias("a"))
    return rows.select("guidance_unit_id", "a.mode", "a.reason")


_P20N = r"trim(regexp_replace(regexp_replace(regexp_replace(span_text, '(^|\s)[(\[{]*[0-9]+[)\]}]*(\s|$)', ' ', 'g'), '[،؛؟۔,;?!:.…]', ' ', 'g'), '\s+', ' ', 'g'))"
_P20 = f"""WITH {_UNITS}, n AS (SELECT guidance_unit_id, ltrim(lower(span_text)) AS low, span_text, {_P20N} AS n FROM u), w AS (SELECT *, {sq.words('n')} AS w FROM n),
r AS (SELECT guidance_unit_id, CASE WHEN n = '' THEN 'empty_after_normalization' WHEN contains(span_text, '?') OR regexp_matches(low, '^(what |how |where |when |why |is this|does this|which )') OR regexp_matches(span_text, 'هل هذه آية|هل هذا من القرآن|اين ورد|أين ورد|في القرآن|في القران') THEN 'question_or_meta_query'
WHEN length(n) < 6 OR len(w) < 2 THEN 'too_short' WHEN len(w) = 2 AND (w[1] = w[2] OR (list_contains(['من', 'في', 'على', 'عن', 'ما', 'كيف', 'هل', 'قال', 'الله', 'يوم', 'رب', 'هذا', 'ذلك', 'كل', 'لا', 'لن'], w[1]) AND length(w[1]) <= 3 AND length(w[2]) <= 3)) THEN 'generic_two_token_input'
WHEN len(w) <= 3 AND len(list_distinct(w)) < len(w) THEN 'short_repeated_phrase' WHEN len(list_filter(w, lambda t: length(t) <= 1)) >= greatest(2, (len(w) + 1) // 2) OR (len(w) >= 3 AND len(list_distinct(w)) = 1) THEN 'low_structural_signal' ELSE 'sufficient_signal' END AS reason FROM w)
SELECT guidance_unit_id, CASE reason WHEN 'sufficient_signal' THEN 'verify_like' WHEN 'question_or_meta_query' THEN 'ask_like' ELSE 'cannot_assess' END AS mode, reason FROM r"""


def x05_unit_verification(spark: SparkSession, root: str) -> DataFrame:
    """Each unit as a quotation of its entry: score parts, total and match class."""
    e = table(spark, root, "hadith_entries").select(F.col("canonical_ref_collection").alias("parent_hadith_ref"), F.col("english_text").alias("entry"))
    rows = _units(spark, root).join(e, "parent_hadith_ref").select("guidance_unit_id", F.col("span_text").alias("q"), "entry", tx.arabic_light(F.lower("span_text")).alias("ql"), tx.arabic_light(F.lower("entry")).alias("el"))
    rows = rows.withColumn("f", ux.fuzzy_ratios("ql", "el")).withColumn("qt", F.array_distinct(tx.words(F.col("ql")))).withColumn("et", tx.words(F.col("el")))
    same = lambda a, b: F.when(F.col(a) == F.col(b), 100.0).otherwise(0.0)
    inside = F.when((F.col("ql") != "") & F.col("el").contains(F.col("ql")), 100.0).otherwise(0.0)
    coverage = F.when(F.size("qt") > 0, 100.0 * F.size(F.array_intersect("qt", "et")) / F.size("qt")).otherwise(0.0)
    n, m = F.greatest(F.length("ql"), F.lit(1)), F.greatest(F.length("el"), F.lit(1))
    s = {
        "exact_display": same("q", "entry"), "exact_light": same("ql", "el"), "exact_aggressive": same("ql", "el"), "contains_light": inside, "contains_aggressive": inside, "coverage": coverage, "length_ratio": F.least(n, m) / F.greatest(n, m),
        "token_set": F.col("f.token_set"), "token_set_aggressive": F.col("f.token_set"), "token_sort": F.col("f.token_sort"), "ratio": F.col("f.ratio"), "partial": F.col("f.partial"),
    }
    rows = rows.select("guidance_unit_id", "q", F.size(tx.words(F.col("ql"))).alias("n_tokens"), F.length("ql").alias("nq"), F.length("el").alias("ne"), *[c.alias(k) for k, c in s.items()])
    parts = {k: F.col(k) for k in s}
    scored = rows.withColumn("score", rules.candidate_score(parts, F.col("nq"), F.col("ne")))
    ok = rules.assess_text(F.col("q"))["mode"] == "verify_like"
    return scored.select("guidance_unit_id", F.round("coverage", 2).alias("coverage"), "score", rules.match_status(parts | {"score": F.col("score")}, ok, F.col("n_tokens")).alias("status"))


TOPICS = [
    rules.Topic("travel.road", "travel", "Road and journey", ("road", "caravan", "traveller"), ("The road",), ()),
    rules.Topic("home.household", "home", "Household", ("household", "garden", "roof", "lamp"), ("The household",), ()),
    rules.Topic("speech.word", "speech", "Words and meaning", ("the word", "meaning", "idiom"), ("The word",), ()),
    rules.Topic("character.patience", "character", "Patience", ("patient", "patience", "hardship"), ("Patience",), ()),
]


def x49_unit_topics(spark: SparkSession, root: str) -> DataFrame:
    """The topic of each unit by weighted phrases, with its score and whether it is sure."""
    rows = rules.resolve_topics(_units(spark, root), "guidance_unit_id", "span_text", TOPICS)
    return rows.withColumn("secondary", F.array_join("secondary", ","))


def m13_entry_topics(spark: SparkSession, root: str) -> DataFrame:
    """The topic of each entry by chapter, book or phrases, or an abstention."""
    e = table(spark, root, "hadith_entries").select("id", "book_id", "chapter_id", "english_text")
    b = table(spark, root, "hadith_books").select(F.col("id").alias("book_id"), F.col("title_en").alias("book_title"))
    c = table(spark, root, "hadith_chapters").select(F.col("id").alias("chapter_id"), F.col("title_en").alias("chapter_title"))
    return rules.classify_by_layers(e.join(b, "book_id", "left").join(c, "chapter_id", "left"), "id", "english_text", "chapter_title", "book_title", TOPICS)


CUES = {"narrative": (["asked", "returned", "relates"], ["better that"], 1.0), "advice": (["better that", "whoever", "let no"], ["asked"], 1.1), "meaning": (["the word", "to mean", "figurative"], [], 0.9)}


def x50_unit_labels(spark: SparkSession, root: str) -> DataFrame:
    """Label of each unit by cues and anti-cues."""
    return rules.best_label(_units(spark, root), "guidance_unit_id", F.col("span_text"), CUES).withColumn("score", F.round(F.col("score").cast("double"), 6))


_CUE = ", ".join(
    "{'s': (" + " + ".join(f"CAST(contains(n, '{p}') AS INT)" for p in pro) + (" - 2 * (" + " + ".join(f"CAST(contains(n, '{p}') AS INT)" for p in con) + ")" if con else "") + f") * CAST({w} AS DOUBLE), 'i': {-i}, 'label': '{label}'}}"
    for i, (label, (pro, con, w)) in enumerate(CUES.items())
)
_X50 = f"""WITH {_UNITS}, n AS (SELECT guidance_unit_id, {sq.norm('span_text')} AS n FROM u), b AS (SELECT guidance_unit_id, list_max([{_CUE}]) AS b FROM n)
SELECT guidance_unit_id, CASE WHEN b.s > 0 THEN b.label END AS label, round(greatest(b.s, 0.0), 6) AS score FROM b"""

CONCEPTS = {"household": ["the household", "the roof"], "trade": ["the market", "the merchant", "coin"], "speech": ["the word", "the phrase", "the idiom"], "light": ["the lamp", "the lantern"]}


def x51_unit_concepts(spark: SparkSession, root: str) -> DataFrame:
    """Concepts of each unit by their surface forms."""
    return rules.link_concepts(_units(spark, root), "guidance_unit_id", "span_text", CONCEPTS)


def x59_scripts(spark: SparkSession, root: str) -> DataFrame:
    """Letters by script of every document."""
    return table(spark, root, "documents").select("doc_id", rules.script_counts(F.col("text")).alias("s")).select("doc_id", "s.arabic", "s.latin", "s.cyrillic", "s.other")


_X59C = {"arabic": r"[^\x{0621}-\x{064A}\x{066E}-\x{06D3}]", "latin": r"[^A-Za-z\x{00C0}-\x{024F}]", "cyrillic": r"[^\x{0400}-\x{04FF}]", "letters": r"[^\p{L}]"}
_X59 = f"""WITH c AS (SELECT doc_id, {', '.join(f"length(regexp_replace(coalesce(text, ''), '{p}', '', 'g')) AS {n}" for n, p in _X59C.items())} FROM documents) SELECT doc_id, arabic, latin, cyrillic, letters - arabic - latin - cyrillic AS other FROM c"""


def m06_directive_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels and topics of each entry by their markers."""
    e = table(spark, root, "hadith_entries")
    labels = {"prohibition": ["do not", "let no", "forbid"], "question": ["asked"], "comparison": ["better that", "more than"], "story": ["returned", "once"]}
    return e.select("id", F.array_join(rules.all_matches(F.col("english_text"), labels), ",").alias("labels"), F.array_join(rules.topics_by_hits(F.col("english_text"), CONCEPTS), ",").alias("topics"))


NOW = "2024-01-20 12:00:00"


def z02_latest_state(spark: SparkSession, root: str) -> DataFrame:
    """The newest unexpired event of every user at a given moment."""
    ev = table(spark, root, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return state.latest_state(ev, "user_id", "ts", "event_id", ["event_id", "event_type"], F.lit(NOW).cast("timestamp")).select("user_id", "event_id", "event_type")


_Z02 = f"""SELECT user_id, event_id, event_type FROM events WHERE ts <= TIMESTAMP '{NOW}' AND ts + INTERVAL 21600 SECOND > TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


def z04_state_at_purchase(spark: SparkSession, root: str) -> DataFrame:
    """Every purchase with the user's newest view before it, if that has not expired."""
    ev = table(spark, root, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    bought = ev.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    seen = ev.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), F.col("ts").alias("seen_at"), "user_id")
    rows = state.as_of(bought, seen, "user_id", "ts", "seen_at", "view_id", ["view_id"])
    return rows.select("event_id", "user_id", F.col("state_view_id").alias("view_id"))


_Z04 = """SELECT p.event_id, p.user_id, v.event_id AS view_id FROM events p LEFT JOIN events v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.ts < p.ts AND v.ts + INTERVAL 21600 SECOND > p.ts
WHERE p.event_type = 'purchase' QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC NULLS LAST, v.event_id DESC) = 1"""


def ext_user_sessions(spark: SparkSession, root: str) -> DataFrame:
    """Extension: sessions of a user's events less than six hours apart."""
    ev = table(spark, root, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return state.sessions(ev, "user_id", "ts", "6 hours").select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events")


_EXT = """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS o FROM events), g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, count(*) AS n_events FROM g GROUP BY user_id, g"""

QUERIES = {
    f.__name__: f
    for f in (m11_unit_scores, p20_assessed_units, x05_unit_verification, x49_unit_topics, m13_entry_topics, x50_unit_labels, x51_unit_concepts, x59_scripts, m06_directive_labels, z02_latest_state, z04_state_at_purchase, ext_user_sessions)
}
ORACLES = {"m11_unit_scores": _sql_unit_scores(), "p20_assessed_units": _P20, "x50_unit_labels": _X50, "x59_scripts": _X59, "z02_latest_state": _Z02, "z04_state_at_purchase": _Z04, "ext_user_sessions": _EXT}
