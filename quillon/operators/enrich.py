"""Entries enriched by rules: topics by aliases, directive labels, role, specificity, centrality, risk flags and answerability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators.rules import first_match

# Phrases with the directive they stand for, in order.
DIRECTIVES = [
    ("do not ", "prohibition"), ("do not get angry", "prohibition"), ("do not become angry", "prohibition"), ("has ordered", "command"), ("ordered you", "command"), ("best of you", "virtue"), ("the best", "virtue"),
    ("better than", "virtue"), ("better and more comprehensive", "virtue"), ("beware", "warning"), ("woe", "warning"), ("punishment", "warning"), ("whoever", "guidance"), ("ask whatever you want", "qa_exchange"),
]
NARRATIVE = ["while we were sitting", "then a man came", "the wives of the prophet", "he said to them", "thereupon", "so this verse was revealed"]
GENERAL = ["the best", "whoever", "none is given", "real patience", "do not get angry", "beware"]
RITUAL = ["prayer", "zakat", "fasts", "ask whatever you want"]


def _holds(c: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(m) for m in markers], F.lit(False))


def _occurrences(c: Column, needle: Column) -> Column:
    """How often the needle stands in the text, not counting overlaps."""
    return ((F.length(c) - F.length(F.replace(c, needle, F.lit("")))) / F.greatest(F.lit(1), F.length(needle))).cast("int")


def _unit(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(c, 3)))


def enriched(df: DataFrame, key: str, text: str, chapter: str, book: str, aliases: dict[str, list[str]]) -> DataFrame:
    """``(key, topics, labels, role, specificity, central, flags, answerability, concepts)``.

    ``aliases`` are the topics with their aliases, lower case. Topics are those with aliases in text and titles, most aliases first, then by name; the first is the primary one. NULL texts count as empty.
    """
    space = lambda *cols: tx.normalize_search(F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in cols]))
    rows = df.select(key, space(text, chapter, book).alias("_all"), space(text, chapter).alias("_tc"), space(text).alias("_body"), space(chapter, book).alias("_titles"), space(chapter).alias("_ch"))
    found = [F.struct(F.array_compact(F.array(*[F.when(F.col("_all").contains(a), F.lit(a)) for a in names])).alias("hits"), F.lit(t).alias("t"), F.array(*map(F.lit, names)).alias("names")) for t, names in aliases.items()]
    hits = F.filter(F.array(*found), lambda x: F.size(x["hits"]) > 0)
    rows = rows.withColumn("_m", F.array_sort(F.transform(hits, lambda x: F.struct((-F.size(x["hits"])).alias("n"), x["t"].alias("t"), x["hits"].alias("hits"), x["names"].alias("names")))))
    labels = F.array_distinct(F.array_compact(F.array(*[F.when(F.col("_tc").contains(p), F.lit(label)) for p, label in DIRECTIVES])))
    story = F.concat(F.lit(" "), F.col("_tc"), F.lit(" ")).contains(" said ")
    rows = rows.withColumn("_l", labels).withColumn("labels", F.when(story & ~F.array_contains("_l", "qa_exchange"), F.array_append("_l", F.lit("story"))).otherwise(F.col("_l")))
    has = lambda x: F.array_contains("labels", x)
    forbids = has("warning") | has("prohibition")
    role = first_match(
        [
            ("narrative_incident", (has("qa_exchange") | F.col("_ch").contains("questions")) & _holds(F.col("_tc"), RITUAL)),
            ("direct_moral_instruction", forbids & _holds(F.col("_tc"), ["beware", "woe", "do not get angry", "do not become angry"])),
            ("warning", forbids),
            ("virtue_statement", has("virtue")),
            ("legal_specific_case", has("command")),
        ],
        "narrative_incident",
    )
    guiding = lambda *more: F.col("role").isin("direct_moral_instruction", "virtue_statement", *more)
    words = lambda c: F.size(tx.words(F.col(c)))
    rows = rows.withColumn("role", role).withColumn("topics", F.transform("_m", lambda x: x["t"])).withColumn("_p", F.try_element_at("_m", F.lit(1)))
    specific = F.when(guiding(), 0.2).otherwise(0.45) + F.when(_holds(F.col("_tc"), NARRATIVE), 0.2).otherwise(0.0) + F.when(words("_tc") >= 80, 0.15).otherwise(0.0) + F.when(F.col("_tc").contains("so this verse was revealed"), 0.1).otherwise(0.0)
    count = F.aggregate("_p.hits", F.lit(0), lambda s, a: s + _occurrences(F.col("_body"), a))
    rows = rows.withColumn("specificity", _unit(specific)).withColumn("_title", F.exists("_p.names", lambda a: F.col("_titles").contains(a))).withColumn("_hits", count).withColumn("_n", words("_body"))
    central = 0.18 + F.when(F.col("_title"), 0.35).otherwise(0.0) + F.when(F.col("_hits") >= 2, 0.25).when(F.col("_hits") == 1, 0.1).otherwise(0.0) + F.when(guiding(), 0.18).otherwise(0.0)
    central = central + F.when(_holds(F.col("_body"), GENERAL), 0.08).otherwise(0.0) + F.when((F.col("_n") <= 60) & (F.col("_hits") > 0), 0.05).otherwise(0.0)
    central = central - F.when((F.col("role") == "narrative_incident") & ~F.col("_title"), 0.18).otherwise(0.0)
    body, primary = F.col("_body"), F.col("_p.t")
    flags = [
        ("incidental_mention_risk", (F.col("_hits") <= 1) & ~F.col("_title") & (F.col("_n") >= 70)),
        ("narrative_specific_risk", (F.col("role") == "narrative_incident") & ~F.col("_title")),
        ("anger_phrase_not_central", (primary == "anger") & ~body.contains("do not get angry") & (F.col("_hits") <= 2)),
        ("incidental_mention_risk", (primary == "anger") & ~body.contains("do not get angry") & body.contains("anger on his face")),
        ("incidental_mention_risk", (primary == "anger") & F.col("_ch").contains("questions") & _holds(body, ["prayer", "zakat", "fasts"])),
        ("jealousy_context_specific", (primary == "hasad") & body.contains("wives of the prophet")),
        ("travel_provision_context", (primary == "rizq") & body.contains("provision") & body.contains("journey")),
    ]
    none = F.array().cast("array<string>")
    listed = F.array_distinct(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in flags])))
    rows = rows.withColumn("central", F.when(F.col("_p").isNull(), 0.0).otherwise(_unit(central))).withColumn("flags", F.when(F.col("_p").isNull(), none).otherwise(listed))
    risk = lambda name, loss: F.when(F.array_contains("flags", name), loss).otherwise(0.0)
    answer = F.col("central") + F.when(guiding("warning"), 0.1).otherwise(0.0) - risk("incidental_mention_risk", 0.18) - risk("narrative_specific_risk", 0.12) - F.col("specificity") * 0.12
    moral = F.array_distinct(F.concat("topics", F.filter("labels", lambda x: x.isin("warning", "virtue", "guidance", "prohibition", "command"))))
    return rows.select(key, "topics", "labels", "role", "specificity", "central", "flags", _unit(answer).alias("answerability"), moral.alias("concepts"))
