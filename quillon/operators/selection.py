"""Choices by the kind of a question: its shape, profile and thresholds, bonuses by role, relevance of results, fallbacks between stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.rules import first_match

# Patterns of the shapes of a question, in order.
SHAPES = {
    "procedural_descriptive": [
        r"\bhow\b", r"\bdescribe\b", r"\bdescription\b", r"\bmethod\b", r"\bway\b", r"\bprocedure\b", r"\bshow me\b", r"\bwhat is it like\b",
        r"\bwhat did (?:the prophet|the messenger|he)\s+(?:do|pray|perform|recite|used to)\b", r"\bwhat (?:was|were) (?:the prophet'?s|his)\s+(?:practice|habit|routine|way|manner|custom)\b",
        r"\bused to (?:do|pray|perform|recite)\b",
    ],
    "prophetic_teaching": [
        r"\bwhat did the prophet\s+(?:say|teach|advise|command)\b",
        r"\bwhat does the prophet\s+(?:say|teach)\b", r"\bwhat did the messenger\s+(?:say|teach)\b", r"\bdid the prophet\s+(?:say|teach|advise|warn|command|mention)\b",
        r"\bprophet'?s\s+(?:teaching|guidance|advice|command)\b", r"\baccording to the prophet\b",
    ],
    "ruling_warning": [r"\bpunishment\b", r"\bforbid\b", r"\bforbidden\b", r"\bharam\b", r"\bprohibit", r"\brulings?\b", r"\bwarn", r"\bsin\b", r"\bpenalty\b", r"\bis it (haram|allowed|permissible)\b"],
    "virtue": [r"\bvirtues?\b", r"\bmerits?\b", r"\breward\b", r"\bblessings?\b", r"\bbenefit", r"\bexcellenc"],
}
# Markers of the profiles, in order.
PROFILES = {"warning": ["warning", "punishment", "danger", "consequence", "avoid", "stay away from"], "virtue": ["virtue", "benefit", "merit", "best of", "reward of", "excellence of"]}
# Bonus of a role by the shape of the question; roles that are not named get none.
SHAPE_BONUS = {
    "procedural_descriptive": {"narrative_incident": 0.14, "direct_moral_instruction": 0.04, "warning": -0.04, "virtue_statement": -0.04},
    "prophetic_teaching": {"direct_moral_instruction": 0.14, "virtue_statement": 0.06, "warning": 0.06, "narrative_incident": -0.04},
    "ruling_warning": {"warning": 0.14, "direct_moral_instruction": 0.08, "narrative_incident": -0.02},
    "virtue": {"virtue_statement": 0.14, "direct_moral_instruction": 0.06, "narrative_incident": -0.02},
}
# Bonus of a role by family of the question (the last entry is for all other roles), then by profile.
FAMILY_BONUS = {
    "entity_eschatology": ({"thematic_passage": 0.14, "narrative_incident": 0.06}, -0.02),
    "narrative_event": ({"thematic_passage": 0.1, "narrative_incident": 0.1}, 0.0),
    "ritual_practice": ({"thematic_passage": 0.1, "legal_specific_case": 0.1, "narrative_incident": 0.1}, 0.0),
}
PROFILE_BONUS = {
    "prophetic_guidance": {"direct_moral_instruction": 0.12, "virtue_statement": 0.12, "warning": 0.12, "narrative_incident": -0.08},
    "warning": {"warning": 0.1, "direct_moral_instruction": 0.1, "narrative_incident": -0.06},
    "virtue": {"virtue_statement": 0.1, "narrative_incident": -0.06},
    "guidance": {"direct_moral_instruction": 0.06, "virtue_statement": 0.06, "warning": 0.06, "narrative_incident": -0.04},
}
# Thresholds of score, answerability and centrality by family, without topics, by profile, else.
FAMILY_THRESHOLDS = {"entity_eschatology": (0.46, 0.42, 0.5), "narrative_event": (0.44, 0.38, 0.46), "ritual_practice": (0.48, 0.4, 0.48)}
NO_TOPIC, PROPHETIC, PROFILED, GENERAL = (0.7, 0.56, 0.62), (0.64, 0.58, 0.62), (0.61, 0.55, 0.58), (0.58, 0.42, 0.48)


def query_shape(c: Column) -> Column:
    """The first shape one of whose patterns stands in the text, else 'broad'."""
    low = F.lower(tx.text_or_empty(c))
    return first_match([(name, reduce(lambda a, b: a | b, [low.rlike(p) for p in patterns])) for name, patterns in SHAPES.items()], "broad")


def query_profile(c: Column, family: Column, by_family: dict[str, str]) -> Column:
    """The profile by markers, else by the family of the question, else 'general_topic'."""
    low = F.lower(tx.text_or_empty(c))
    marked = first_match([(name, reduce(lambda a, b: a | b, [low.contains(m) for m in markers])) for name, markers in PROFILES.items()])
    return F.coalesce(marked, tx.lookup(by_family, F.coalesce(family, F.lit(""))), F.lit("general_topic"))


def _by_role(role: Column, bonus: dict[str, float], otherwise: float = 0.0) -> Column:
    out = F.lit(otherwise)
    for name, value in bonus.items():
        out = F.when(role == name, value).otherwise(out)
    return out


def shape_bonus(shape: Column, role: Column) -> Column:
    """What a role gains by the shape of the question."""
    out = F.lit(0.0)
    for name, bonus in SHAPE_BONUS.items():
        out = F.when(shape == name, _by_role(role, bonus)).otherwise(out)
    return out


def role_bonus(shape: Column, family: Column, profile: Column, role: Column) -> Column:
    """What a role gains by the family of the question, else by its profile; nothing for questions about a procedure."""
    out = F.lit(0.0)
    for name, bonus in PROFILE_BONUS.items():
        out = F.when(profile == name, _by_role(role, bonus)).otherwise(out)
    for name, (bonus, otherwise) in FAMILY_BONUS.items():
        out = F.when(family == name, _by_role(role, bonus, otherwise)).otherwise(out)
    return F.when(shape == "procedural_descriptive", 0.0).otherwise(out)


def thresholds(family: Column, profile: Column, has_topics: Column) -> Column:
    """The least score, answerability and centrality of a question's results."""
    triple = lambda t: F.struct(*[F.lit(x).alias(n) for x, n in zip(t, ("score", "answer", "central"))])
    out = F.when(~has_topics, triple(NO_TOPIC)).when(profile == "prophetic_guidance", triple(PROPHETIC)).when(profile.isin("warning", "virtue", "guidance"), triple(PROFILED)).otherwise(triple(GENERAL))
    for name, t in FAMILY_THRESHOLDS.items():
        out = F.when(family == name, triple(t)).otherwise(out)
    return out


def relevance(top_ref: Column, acceptable: Column, bad: Column, expected: Column, topics: Column) -> Column:
    """Whether a result's first reference is acceptable (any is if none is named), is a bad one, shares a topic, and whether it passes."""
    there = top_ref.isNotNull() & (top_ref != "")
    ok, wrong = there & ((F.size(acceptable) == 0) | F.array_contains(acceptable, top_ref)), there & F.array_contains(bad, top_ref)
    shared = F.arrays_overlap(expected, topics)
    zero = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(zero(ok).alias("top1_ok"), zero(wrong).alias("bad_hit"), zero(shared).alias("topic_overlap"), ((zero(ok) | zero(shared)) & ~zero(wrong)).alias("passed"))


def with_fallback(preferred: DataFrame, other: DataFrame, key: list[str], only: bool = False) -> DataFrame:
    """The preferred rows and, unless ``only`` these are wanted, the other store's rows for keys it lacks; ``origin`` tells them apart. NULL keys never match."""
    first = preferred.withColumn("origin", F.lit("preferred"))
    return first if only else first.unionByName(other.join(preferred.select(*key).distinct(), key, "left_anti").withColumn("origin", F.lit("other")))


def first_filled(df: DataFrame, by: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Per group the first non-blank value of each column in the given order, and how many rows there are."""
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    first = lambda c: F.min_by(filled(c), F.when(filled(c).isNotNull(), F.struct(*order))).alias(c)
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[first(c) for c in columns])


def proxy_scores(fused: Column, grounded: Column, direct: Column, end_times: Column, k: int = 60) -> Column:
    """Centrality, answerability and narrative specificity of a hit from its reciprocal-rank score, which is divided by that of a first place in two lists.

    A hit without textual ground loses 0.20; the floor is 0.58 for end-times hits, else 0.44.
    """
    share = F.least(F.lit(1.0), fused / F.lit(2.0 / (k + 1)))
    central = F.when(end_times, 0.58).otherwise(0.44) + 0.38 * share + F.when(grounded, 0.12).otherwise(-0.20)
    answer = F.when(direct, 0.72).when(end_times, 0.70).otherwise(0.52)
    return F.struct(F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.0), central)), 4).alias("central"), answer.alias("answer"), F.when(direct, 0.08).otherwise(0.35).alias("narrative"))


def checked_range(start: Column, end: Column, limit: Column, length: Column, most: int = 20) -> Column:
    """A verse range with its error. Without a start it is the whole chapter; a missing end is the start. A NULL length is an unknown chapter, a NULL limit the most."""
    first, last = F.when(start.isNull(), 1).otherwise(start), F.when(start.isNull(), length).otherwise(F.coalesce(end, start))
    error = first_match(
        [("unknown_chapter", length.isNull()), ("start_too_small", first < 1), ("end_before_start", last < first), ("beyond_chapter", last > length), ("bad_limit", (limit < 1) | (limit > most))]
    )
    return F.struct(first.alias("first"), last.alias("last"), error.alias("error"))


def fill_missing(left: DataFrame, right: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The left rows with NULLs of the columns filled from the right row of their key, which is unique there; values that are there stay."""
    r = right.select(*key, *[F.col(c).alias(f"_r_{c}") for c in columns])
    out = left.join(r, key, "left")
    return out.select(*[F.coalesce(c, f"_r_{c}").alias(c) if c in columns else F.col(c) for c in left.columns])


def failed_checks(checks: dict[str, Column]) -> Column:
    """Whether a case passes all its checks, and the names of those it fails in order; a check that is NULL fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return F.struct((F.size(failed) == 0).alias("passed"), failed.alias("failures"))


def confidence_policy(lane: Column, engine: Column, status: Column, confidence: Column, window: Column, coverage: Column, score: Column) -> Column:
    """Status and confidence of a result after the policy, what it did (``action``) and why (``reasons``, 'no_change' if nothing); NULL numbers count as 0.

    ``status`` is 'exact', 'close' or 'none'. Exact claims of anchored passages fall to 'close' and 'medium' below 5 rows, 99.5 coverage or a score of 90; those of exact spans only lose confidence below 5, 98 or 85,
    those of single rows below 85; no other result keeps high confidence.
    """
    w, c, s = (F.coalesce(x.cast("double"), F.lit(0.0)) for x in (window, coverage, score))
    exact = F.coalesce(status == "exact", F.lit(False))
    anchored, spans, single = exact & (lane == "passage") & (engine == "giant_exact_anchor"), exact & (lane == "passage") & (engine == "surah_span_exact"), exact & (lane == "ayah")
    first = first_match(
        [
            ("giant_exact_window_below_minimum", anchored & (w < 5)),
            ("giant_exact_token_coverage_below_strict_threshold", anchored & (c < 99.5)),
            ("giant_exact_score_below_strict_threshold", anchored & (s < 90)),
            ("giant_exact_strict_verified", anchored),
            ("surah_span_exact_evidence_softened", spans & ((w < 5) | (c < 98) | (s < 85))),
            ("surah_span_exact_verified", spans),
            ("ayah_exact_score_softened", single & (s < 85)),
            ("ayah_exact_verified", single),
        ]
    )
    demoted, softened = F.coalesce(first.endswith("threshold") | first.endswith("minimum"), F.lit(False)), F.coalesce(first.endswith("softened"), F.lit(False))
    loose = F.coalesce((confidence == "high") & ~exact, F.lit(False))
    reasons = F.array_compact(F.array(first, F.when(loose, F.lit("non_exact_high_confidence_softened"))))
    return F.struct(
        F.when(demoted, "close").otherwise(status).alias("status"), F.when(demoted | softened | loose, "medium").otherwise(confidence).alias("confidence"),
        F.when(demoted, "demoted").when(softened | loose, "confidence_softened").otherwise("kept").alias("action"), F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("no_change"))).alias("reasons"),
    )


# Signs of fully marked verse text, as regular-expression classes.
SIGNS = {
    "wasla_alif": r"\x{0671}", "annotations": r"[\x{06DF}-\x{06E4}\x{06E7}\x{06E8}\x{06EA}-\x{06ED}]", "special": r"[\x{06DE}\x{06E9}]", "digits": r"[٠-٩۰-۹]", "ornaments": r"[﴾﴿]", "high": r"[\x{0654}-\x{065F}\x{0670}\x{06D6}-\x{06DC}]",
}


def script_route(c: Column) -> Column:
    """Counts of the signs of fully marked verse text, and which corpus is asked first: the marked one for a wasla alif or two annotation signs."""
    count = {n: F.regexp_count(tx.text_or_empty(c), F.lit(p)) for n, p in SIGNS.items()}
    strong = F.when(count["wasla_alif"] > 0, 5).otherwise(0) + F.when(count["annotations"] >= 2, 4).otherwise(0)
    weak = sum((F.when(count[n] >= least, 1).otherwise(0) for n, least in (("ornaments", 1), ("special", 1), ("digits", 2), ("high", 4))), F.lit(0))
    return F.struct(F.when(strong > 0, "marked_first").otherwise("plain_first").alias("route"), strong.alias("strong"), weak.alias("weak"))
