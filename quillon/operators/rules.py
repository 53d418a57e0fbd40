"""Classification by ordered rules. Rule sets are data: a name, a test, a result; the plan gets them as one CASE expression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx


def first_match(rules: list[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule whose test holds; a NULL test does not hold."""
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def any_of(c: Column, markers: list[str]) -> Column:
    """Whether any marker occurs in the lower-case text."""
    low = F.lower(tx.text_or_empty(c))
    return reduce(lambda a, b: a | b, [low.contains(m) for m in markers], F.lit(False))


def all_matches(c: Column, rules: dict[str, list[str]]) -> Column:
    """The names whose markers occur, each once, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(any_of(c, markers), F.lit(n)) for n, markers in rules.items()]))


def topics_by_hits(c: Column, aliases: dict[str, list[str]]) -> Column:
    """Topics whose aliases occur in the text, most aliases first, then by name."""
    norm = tx.normalize_search(c)
    hits = [F.struct((-sum((norm.contains(a).cast("int") for a in als), F.lit(0))).alias("n"), F.lit(t).alias("t")) for t, als in aliases.items()]
    return F.transform(F.array_sort(F.filter(F.array(*hits), lambda x: x["n"] < 0)), lambda x: x["t"])


# Question openings, markers of guidance units and their scores by role.
QUESTION_OPENINGS = ["what ", "how ", "where ", "when ", "why ", "is this", "does this", "which "]
META_MARKERS = ["هل هذه آية", "هل هذا من القرآن", "اين ورد", "أين ورد", "في القرآن", "في القران"]
GENERIC_TOKENS = [
    "من", "في", "على", "الى", "إلى", "عن", "ما", "ماذا", "كيف", "هل", "قال", "قالوا", "الله", "للَّه", "الناس", "يوم", "رب", "ربك", "ربهم", "هذا", "هذه", "ذلك", "تلك", "كل", "بعض", "ان", "إن", "لا", "لن",
]
ROLE_MARKERS = {
    "direct_moral_instruction": ["do not", "beware", "shall not", "should not", "must not", "none of you", "whoever", "the best", "best of"],
    "warning": ["beware", "warning", "punishment", "do not", "forbidden", "woe"],
    "virtue_statement": ["best", "virtue", "reward", "superior", "believer", "good deed", "patience is"],
    "narrative_incident": [
        "while we were", "then a man", "thereupon", "they asked", "she asked", "he asked", "during", "journey", "campaign", "battle", "wives of the prophet", "noticed anger on his face",
    ],
}
ACTIVE_ROLES = ["direct_moral_instruction", "warning", "virtue_statement"]


def assess_text(c: Column, least_chars: int = 6, least_tokens: int = 2) -> Column:
    """P20: whether a text can be verified: (mode, reason) by the first of its defects."""
    norm = tx.arabic_light(c)
    tokens = tx.words(norm)
    low = F.ltrim(F.lower(tx.text_or_empty(c)))
    question = tx.text_or_empty(c).contains("?") | reduce(lambda a, b: a | b, [low.startswith(q) for q in QUESTION_OPENINGS]) | reduce(lambda a, b: a | b, [tx.text_or_empty(c).contains(m) for m in META_MARKERS])
    count = lambda test: F.size(F.filter(tokens, test))
    generic, short = count(lambda t: t.isin(*GENERIC_TOKENS)), count(lambda t: F.length(t) <= 3)
    first, second = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(2))
    n, distinct, tiny = F.size(tokens), F.size(F.array_distinct(tokens)), count(lambda t: F.length(t) <= 1)
    reason = first_match(
        [
            ("empty_after_normalization", norm == ""),
            ("question_or_meta_query", question),
            ("too_short", (F.length(norm) < least_chars) | (F.size(tokens) < least_tokens)),
            ("generic_two_token_input", (n == 2) & ((first == second) | (generic == 2) | ((generic >= 1) & (short == 2)))),
            ("short_repeated_phrase", (n <= 3) & (distinct < n)),
            ("low_structural_signal", (tiny >= F.greatest(F.lit(2), F.floor((n + 1) / 2))) | ((n >= 3) & (distinct == 1))),
        ],
        "sufficient_signal",
    )
    mode = F.when(reason == "sufficient_signal", "verify_like").when(reason == "question_or_meta_query", "ask_like").otherwise("cannot_assess")
    return F.struct(mode.alias("mode"), reason.alias("reason"))


def match_status(s: dict[str, Column], assessable: Column, n_tokens: Column) -> Column:
    """Exact, close, none or not assessable, from the parts of a candidate's score (0 to 100 each)."""
    contains = (s["contains_light"] == 100) | (s["contains_aggressive"] == 100)
    return first_match(
        [
            ("exact", (s["exact_display"] == 100) | (s["exact_light"] == 100)),
            ("cannot_assess", ~assessable),
            ("exact", (s["exact_aggressive"] == 100) & (s["coverage"] >= 95) & (s["length_ratio"] >= 0.98)),
            ("exact", contains & (n_tokens >= 4) & (s["coverage"] >= 95) & (s["partial"] >= 100)),
            ("close", s["exact_aggressive"] == 100),
            ("close", contains & (s["coverage"] >= 60) & (n_tokens >= 3)),
            ("close", (F.greatest(s["token_set"], s["token_set_aggressive"]) >= 95) & (s["coverage"] >= 70) & (n_tokens >= 4)),
            ("close", (s["token_set_aggressive"] >= 85) & (s["coverage"] >= 80) & (n_tokens >= 4)),
            ("close", (s["score"] >= 60) & (s["coverage"] >= 50)),
        ],
        "none",
    )


# Weights of the parts of a candidate's score.
CANDIDATE = {
    "exact_light": 0.25, "exact_aggressive": 0.12, "exact_display": 0.08, "contains_light": 0.18, "contains_aggressive": 0.10, "coverage": 0.12, "token_set": 0.06,
    "token_set_aggressive": 0.04, "token_sort": 0.02, "ratio": 0.02,
}


def candidate_score(s: dict[str, Column], query_length: Column, text_length: Column) -> Column:
    """The weighted parts plus the length-adjusted partial ratio, less 25 for candidates much shorter than the query; not below 0."""
    q, t = F.greatest(query_length, F.lit(1)), F.greatest(text_length, F.lit(1))
    ratio = F.least(q, t) / F.greatest(q, t)
    short = (t < F.greatest(F.lit(6), F.floor(q * 0.35))) & (s["exact_light"] != 100)
    return F.bround(F.greatest(F.lit(0.0), sum((w * s[n] for n, w in CANDIDATE.items()), 0.01 * s["partial"] * ratio) - F.when(short, 25.0).otherwise(0.0)), 2)


def preferred_lane(a: dict[str, Column], b: dict[str, Column], n_tokens: Column) -> Column:
    """Which of two results (``a`` single rows, ``b`` passages) leads, as (lane, rule).

    Each has ``rank`` (0 weak to 3 exact), ``score``, ``unit`` (rank of its kind of unit); ``a`` also ``contains``, ``b`` also ``several`` rows.
    """
    tie = (F.abs(a["score"] - b["score"]) <= 5) & (F.least(a["score"], b["score"]) >= 60)
    unit = (a["rank"] == b["rank"]) & (a["unit"] != b["unit"]) & ((a["rank"] == 3) | tie)
    rule = first_match(
        [
            ("b:status", b["rank"] > a["rank"]),
            ("a:status", a["rank"] > b["rank"]),
            ("a:both_weak", (a["rank"] <= 1) & (b["rank"] <= 1)),
            ("a:unit", unit & (a["unit"] > b["unit"])),
            ("b:unit", unit),
            ("a:contains_query", a["contains"] & (a["score"] >= b["score"] - 8)),
            ("b:long_query", (n_tokens >= 6) & b["several"] & (b["score"] >= a["score"] - 5)),
            ("a:score", a["score"] >= b["score"] + 5),
            ("b:score", b["several"] & (b["score"] >= a["score"] + 3) & (n_tokens >= 5)),
        ],
        "a:default",
    )
    return F.struct(F.split(rule, ":")[0].alias("lane"), F.split(rule, ":")[1].alias("rule"))


def unit_role(c: Column) -> Column:
    """The role of a passage by its first markers."""
    return first_match([(r, any_of(c, m)) for r, m in ROLE_MARKERS.items()], "narrative_incident")


def unit_scores(c: Column, role: Column, n_concepts: Column, confidence: Column) -> Column:
    """Directness, answerability, narrative penalty and rank score of a passage, each between 0 and 1."""
    n = F.length(c)
    active = role.isin(*ACTIVE_ROLES)
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.bround(x, 3)))
    by_role = F.when(role == "direct_moral_instruction", 0.74).when(role == "warning", 0.68).when(role == "virtue_statement", 0.66).otherwise(0.26)
    direct = clip(by_role + F.when(any_of(c, ["the prophet", "allah's messenger"]), 0.06).otherwise(0.0) + F.when(n <= 220, 0.06).when(n >= 700, -0.14).when(n >= 420, -0.08).otherwise(0.0))
    answer = clip(0.28 + 0.12 * F.least(n_concepts, F.lit(2)) + 0.18 * confidence + F.when(active, 0.1).otherwise(0.0) + F.when(n <= 240, 0.06).when(n >= 500, -0.08).otherwise(0.0))
    narrative = clip(F.when(role == "narrative_incident", 0.14).otherwise(0.03) + F.when(any_of(c, ROLE_MARKERS["narrative_incident"]), 0.12).otherwise(0.0) + F.when(n >= 700, 0.24).when(n >= 360, 0.12).otherwise(0.0))
    concept = F.when(n_concepts > 0, F.least(F.lit(0.22), 0.12 * n_concepts)).otherwise(0.0)
    rank = clip(0.34 * confidence + 0.22 * direct + 0.22 * answer + concept + F.when(active, 0.12).otherwise(-0.02) - 0.22 * narrative)
    return F.struct(direct.alias("directness"), answer.alias("answerability"), narrative.alias("narrative"), rank.alias("rank_score"))


def with_unit_scores(df: DataFrame, text: str, role: str, n_concepts: Column, confidence: Column) -> DataFrame:
    """Adds ``role`` and the four unit scores as columns."""
    d = df.withColumn(role, unit_role(F.col(text))).withColumn("_s", unit_scores(F.col(text), F.col(role), n_concepts, confidence))
    return d.select(*df.columns, *([role] if role not in df.columns else []), "_s.directness", "_s.answerability", "_s.narrative", "_s.rank_score")


@dataclass(frozen=True)
class Topic:
    """A leaf of a taxonomy: its family, display name, phrases, and the titles it is known under."""

    slug: str
    family: str
    display: str
    phrases: tuple[str, ...] = ()
    chapters: tuple[str, ...] = ()
    books: tuple[str, ...] = ()


def resolve_topics(df: DataFrame, key: str, text: str, topics: list[Topic], least: float = 3.0, margin: float = 2.0, floor: float = 1.5) -> DataFrame:
    """Weighted phrase matches per topic; the best one if it reaches ``least``, sure if it leads by ``margin``, others from ``floor`` on as secondary.

    Weights: a phrase 3.0, the slug's words 3.5, the display name 1.5, times ``max(1, topics / topics with the phrase)``; a phrase counts once per topic with its largest weight.
    """
    weights: dict[tuple[str, str], float] = {}
    for t in topics:
        for w, ps in ((3.5, [t.slug.split(".")[-1].replace("_", " ")]), (3.0, t.phrases), (1.5, [t.display])):
            for p in ps:
                k = (t.slug, p.lower())
                weights[k] = max(weights.get(k, 0.0), w)
    spread: dict[str, int] = {}
    for _, p in weights:
        spread[p] = spread.get(p, 0) + 1
    norm = tx.normalize_search(F.col(text))
    scores = []
    for t in topics:
        parts = [F.when(norm.rlike(tx.phrase_pattern(p)), w * max(1.0, len(topics) / spread[p])).otherwise(0.0) for (s, p), w in weights.items() if s == t.slug]
        scores.append(F.struct(F.round(-sum(parts, F.lit(0.0)), 6).alias("s"), F.lit(t.slug).alias("slug")))
    ranked = df.select(key, F.array_sort(F.filter(F.array(*scores), lambda x: x["s"] < 0)).alias("_r"))
    first, second = F.try_element_at("_r", F.lit(1)), F.try_element_at("_r", F.lit(2))
    top, next_ = F.abs(F.coalesce(first["s"], F.lit(0.0))), F.abs(F.coalesce(second["s"], F.lit(0.0)))
    return ranked.select(
        key, F.when(top >= least, first["slug"]).alias("topic"), top.alias("score"), ((top >= least) & (top - next_ >= margin)).alias("is_sure"),
        F.transform(F.filter(F.slice("_r", 2, 5), lambda x: x["s"] <= -floor), lambda x: x["slug"]).alias("secondary"),
    )


def classify_by_layers(df: DataFrame, key: str, text: str, chapter: str, book: str, topics: list[Topic], least: float = 0.55, margin: float = 0.15) -> DataFrame:
    """Topic by chapter title, else by a book title of one topic only, else by the best score with a margin; otherwise an abstention with its reason.

    The score is 0.30 for the base, 0.35, 0.12 and 0.08 for the first three phrases, 0.15 for the book, 0.10 for a part of the chapter title.
    """
    body = tx.clean_attribution(F.col(text))
    by_chapter = {c: t.slug for t in topics for c in t.chapters}
    books: dict[str, list[str]] = {}
    for t in topics:
        for b in t.books:
            books.setdefault(b, []).append(t.slug)
    by_book = {b: s[0] for b, s in books.items() if len(s) == 1}
    find = lambda table, c: tx.lookup(table, c) if table else F.lit(None).cast("string")
    one, two = find(by_chapter, F.coalesce(F.col(chapter), F.lit(""))), find(by_book, F.coalesce(F.col(book), F.lit("")))
    scored = []
    for t in topics:
        n = sum((tx.has_phrase(F.col("_b"), p).cast("int") for p in t.phrases), F.lit(0))
        s = 0.30 + F.when(n >= 3, 0.55).when(n == 2, 0.47).when(n == 1, 0.35).otherwise(0.0)
        s = s + F.when(F.col(book).isin(*t.books) if t.books else F.lit(False), 0.15).otherwise(0.0)
        title = F.lower(F.coalesce(F.col(chapter), F.lit("")))
        part = reduce(lambda a, b: a | b, [title.contains(c.lower()) for c in t.chapters], F.lit(False))
        scored.append(F.struct((-(s + F.when(part, 0.10).otherwise(0.0))).alias("s"), F.lit(t.slug).alias("slug")))
    rows = df.withColumn("_b", body).select(key, "_b", one.alias("_one"), two.alias("_two"), F.array_sort(F.array(*scored)).alias("_r"))
    top, next_ = -F.col("_r")[0]["s"], -F.coalesce(F.try_element_at("_r", F.lit(2))["s"], F.lit(0.0))
    sure = (top >= least) & ((top >= 0.70) | (top - next_ >= margin - 1e-9))
    layer = first_match([("empty", F.col("_b") == ""), ("chapter", F.col("_one").isNotNull()), ("book", F.col("_two").isNotNull()), ("phrases", sure)], "low_confidence")
    topic = F.when(layer == "chapter", F.col("_one")).when(layer == "book", F.col("_two")).when(layer == "phrases", F.col("_r")[0]["slug"])
    density = F.when(layer == "chapter", 0.92).when(layer == "book", 0.85).when(layer == "phrases", F.when(top >= 0.8, 0.75).otherwise(0.60)).when(layer == "empty", 0.0).otherwise(F.bround(top, 3))
    return rows.select(key, topic.alias("topic"), layer.alias("layer"), F.round(density, 3).alias("density"))


def best_label(df: DataFrame, key: str, text: Column, cues: dict[str, tuple[list[str], list[str], float]]) -> DataFrame:
    """Label with the most cues less twice the anti-cues, times its priority; none if no score is positive (ties: the first label)."""
    norm = tx.normalize_search(text)
    options = []
    for i, (label, (pro, con, priority)) in enumerate(cues.items()):
        s = sum((norm.contains(p).cast("int") for p in pro), F.lit(0)) - 2 * sum((norm.contains(p).cast("int") for p in con), F.lit(0))
        options.append(F.struct((s * F.lit(priority)).alias("s"), F.lit(-i).alias("i"), F.lit(label).alias("label")))
    best = F.array_max(F.array(*options))
    return df.select(key, F.when(best["s"] > 0, best["label"]).alias("label"), F.greatest(best["s"], F.lit(0.0)).alias("score"))


def script_counts(c: Column) -> Column:
    """Letters by script: Arabic, Latin, Cyrillic, others."""
    t = tx.text_or_empty(c)
    count = lambda p: F.length(F.regexp_replace(t, f"[^{p}]", ""))
    arabic, latin, cyrillic, letters = count(r"\x{0621}-\x{064A}\x{066E}-\x{06D3}"), count(r"A-Za-z\x{00C0}-\x{024F}"), count(r"\x{0400}-\x{04FF}"), count(r"\p{L}")
    return F.struct(arabic.alias("arabic"), latin.alias("latin"), cyrillic.alias("cyrillic"), (letters - arabic - latin - cyrillic).alias("other"))


def surface_score(surface: str, c: Column) -> Column:
    """How well a surface form fits: as a phrase 1.0, without spaces 0.9, else the share of its words, scaled to 0.8."""
    norm, ws = tx.normalize_search(c), surface.lower().split()
    tokens = tx.words(norm)
    share = sum((F.array_contains(tokens, w).cast("int") for w in ws), F.lit(0)) / len(ws)
    return F.when(norm.rlike(tx.phrase_pattern(surface.lower())), 1.0).when(tx.compact(c).contains("".join(ws)), 0.9).otherwise(0.8 * share)


def link_concepts(df: DataFrame, key: str, text: str, concepts: dict[str, list[str]], least: float = 0.84, most: int = 4) -> DataFrame:
    """The concepts whose best surface form reaches ``least``, best first, at most ``most`` per row: ``(key, concept, confidence, rank)``."""
    options = [F.struct(F.greatest(*[surface_score(s, F.col(text)) for s in forms], F.lit(0.0)).alias("confidence"), F.lit(c).alias("concept")) for c, forms in concepts.items()]
    rows = df.select(key, F.explode(F.array(*options)).alias("x")).select(key, "x.concept", F.round("x.confidence", 6).alias("confidence")).where(F.col("confidence") >= least)
    order = Window.partitionBy(key).orderBy(F.col("confidence").desc(), "concept")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
