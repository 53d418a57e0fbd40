"""Operators put together into the batch flows: ingestion with an audit, unit building, reference resolution, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import collections as cx
from quillon.functions import text as tx
from quillon.operators import fusion, merge, rules, spans


def ingest(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str], run_id: str) -> tuple[DataFrame, DataFrame]:
    """The merged table and the audit row of the run with its outcome counts."""
    merged = merge.upsert(old, new, keys, fields)
    counts = merged.agg(*[F.count_if(F.col("outcome") == o).alias(f"n_{o}") for o in ("inserted", "updated", "unchanged", "kept")])
    return merged, counts.select(F.lit(run_id).alias("run_id"), "*", F.lit("completed").alias("status"))


def with_surrogate_keys(df: DataFrame, parent: DataFrame, natural: list[str], surrogate: str) -> DataFrame:
    """The parent's surrogate key for its natural key; rows without a parent keep NULL."""
    return df.join(parent.select(*natural, surrogate), natural, "left")


def flat_translations(verses: DataFrame) -> DataFrame:
    """Nested service rows ``(verse_key, translations)`` as flat ones, the first translation of each."""
    first = F.try_element_at("translations", F.lit(1))
    part = lambda i: F.split_part("verse_key", F.lit(":"), F.lit(i)).cast("int")
    return verses.select(part(1).alias("surah_no"), part(2).alias("ayah_no"), tx.html_to_text(first["text"]).alias("text_display"), first["text"].alias("text_raw_html"))


def search_documents(entries: DataFrame, books: DataFrame, chapters: DataFrame) -> DataFrame:
    """The table that is searched instead of a search server: typed columns, joined titles, no stubs."""
    e = entries.where((F.length(F.trim(F.coalesce("english_text", F.lit("")))) > 0) & ~F.coalesce(cx.json_text(F.col("metadata_json").cast("string"), "$.is_stub") == "true", F.lit(False)))
    b = books.select(F.col("id").alias("book_id"), F.col("title_en").alias("book_title"))
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("title_en").alias("chapter_title"))
    rows = e.join(b, "book_id", "left").join(c, "chapter_id", "left")
    return rows.select("id", "canonical_ref_collection", "book_title", "chapter_title", "english_narrator", "english_text", tx.words(tx.normalize_search(F.col("english_text"))).alias("tokens"))


def build_units(entries: DataFrame, key: str, text: str, concepts: dict[str, list[str]], most: int = 3) -> DataFrame:
    """Passages of one to three sentences with role, concepts and scores; the best ``most`` per entry that reach 0.34, else the whole entry."""
    w = entries.select(key, tx.sentences(F.col(text)).alias("_s")).select(key, F.explode_outer(spans.list_windows(F.col("_s"), [1, 2, 3])).alias("w"))
    w = w.select(key, F.col("w.start").alias("span_start"), (F.col("w.start") + F.col("w.width")).alias("span_end"), F.array_join("w.items", " ").alias("span_text")).where(F.length("span_text") >= 28)
    hits = [F.when(rules.any_of(F.col("span_text"), forms), F.lit(c)) for c, forms in concepts.items()]
    w = w.withColumn("concepts", F.array_compact(F.array(*hits)))
    scored = rules.with_unit_scores(w, "span_text", "guidance_role", F.size("concepts"), F.when(F.size("concepts") > 0, 0.9).otherwise(0.0)).where("rank_score >= 0.34")
    best = fusion.top_k(scored, [key], most, F.col("rank_score").desc(), F.col("answerability").desc(), F.col("directness").desc(), "span_start", "span_end")
    whole = entries.select(key, F.col(text).alias("span_text")).where(F.trim(F.coalesce("span_text", F.lit(""))) != "").join(best.select(key).distinct(), key, "left_anti")
    fallback = rules.with_unit_scores(whole.withColumn("concepts", F.array().cast("array<string>")), "span_text", "guidance_role", F.lit(0), F.lit(0.0))
    cols = [key, "span_text", "guidance_role", "concepts", "directness", "answerability", "narrative", "rank_score"]
    return best.select(*cols, "rank").unionByName(fallback.select(*cols).withColumn("rank", F.lit(1)))


def resolve_references(df: DataFrame, key: str, text: str, chapters: DataFrame, chapter_no: str, length: str) -> DataFrame:
    """References checked against the chapters: the span with its id, or an error code."""
    r = df.select(key, tx.verse_reference(F.col(text)).alias("r")).select(key, "r.surah", "r.ayah_start", "r.ayah_end", F.col("r").isNull().alias("_none"))
    c = chapters.select(F.col(chapter_no).alias("surah"), F.col(length).alias("_n"))
    rows = r.join(c, "surah", "left")
    error = rules.first_match([("no_reference", F.col("_none")), ("unknown_chapter", F.col("_n").isNull()), ("verse_out_of_range", (F.col("ayah_start") < 1) | (F.col("ayah_end") > F.col("_n")))])
    ref = F.when(error.isNull(), tx.format_reference(F.col("surah"), F.col("ayah_start"), F.col("ayah_end")))
    return rows.select(key, "surah", "ayah_start", "ayah_end", error.alias("error"), ref.alias("span_ref"))


def contained_reference(container: Column, value: Column) -> Column:
    """Whether one reference lies inside another."""
    a, b = tx.verse_reference(container), tx.verse_reference(value)
    return F.coalesce((a["surah"] == b["surah"]) & (a["ayah_start"] <= b["ayah_start"]) & (a["ayah_end"] >= b["ayah_end"]), F.lit(False))


def best_units(units: DataFrame, unit: str, parent: str, score: str, most: int) -> DataFrame:
    """Per unit its best row, per parent its best unit, then the best parents."""
    one = fusion.keep_first(units, [parent, unit], F.col(score).desc())
    top = fusion.keep_first(one, [parent], F.col(score).desc(), unit)
    return top.orderBy(F.col(score).desc(), parent).limit(most)


def evidence(selected: DataFrame, query: list[str], ref: str, text: str, most: int = 5, chars: int = 280) -> DataFrame:
    """Per query the distinct references in order with shortened texts."""
    rows = fusion.keep_first(selected, [*query, ref], "rank")
    kept = fusion.top_k(rows.drop("rank"), query, most, ref) if "rank" not in rows.columns else rows.withColumn("_o", F.row_number().over(Window.partitionBy(*query).orderBy("rank"))).where(F.col("_o") <= most).drop("_o")
    return kept.withColumn("excerpt", tx.truncate(F.col(text), chars))


def hybrid_text_score(query_tokens: list[str], df: DataFrame, norm: str, tokens: str, aliases: list[str]) -> Column:
    """0.68 for the share of query tokens in the text, up to 0.32 for aliases, between 0 and 1. Inside one text all query tokens weigh the same."""
    hit = sum((F.array_contains(tokens, t).cast("int") for t in query_tokens), F.lit(0)) / max(1, len(query_tokens))
    alias = F.least(F.lit(0.32), 0.12 * sum((F.col(norm).contains(a).cast("int") for a in aliases), F.lit(0)))
    return F.round(F.least(F.lit(1.0), 0.68 * hit + alias), 4)
