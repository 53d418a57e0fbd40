"""Scoring and ranking of documents for queries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import index
from quillon.plans.materialize import cut, exploded, keep_where


def _count(tokens: Column, word: str) -> Column:
    return F.size(tokens) - F.size(F.array_remove(tokens, word))


def _closest(tokens: Column, word: str) -> Column:
    """Best trigram similarity of ``word`` with a token of nearly its length."""
    close = F.filter(tokens, lambda c: F.abs(F.length(c) - len(word)) <= 4)
    return F.coalesce(F.array_max(F.transform(close, lambda c: tx.trigram_similarity(F.lit(word), c))), F.lit(0.0))


def idf_shortlist(df: DataFrame, key: str, tokens: Column, gram_text: Column, query_tokens: list[str], query_grams: list[str], limit: int = 250, gram_weight: float = 0.35) -> DataFrame:
    """Documents by the summed idf of the query's tokens and, at a lower weight, q-grams: ``(key, score, token_overlap, gram_overlap)``.

    A document qualifies by enough tokens or enough q-grams; a text holds a q-gram if the q-gram occurs in ``gram_text``. Only rows that hold a query term are kept before anything is shuffled: the query's terms are literals of the plan.
    """
    qt, qg = list(dict.fromkeys(query_tokens)), list(dict.fromkeys(query_grams))
    held = lambda c, query: F.array_compact(F.array(*[F.when(c(x), F.lit(x)) for x in query]).cast("array<string>"))
    rows = df.select(key, tokens.alias("_w"), gram_text.alias("_s"))
    rows = rows.select(key, held(lambda x: F.array_contains("_w", x), qt).alias("_t"), held(lambda x: F.col("_s").contains(x), qg).alias("_g"))
    n = df.agg(F.count("*").alias("_n"))
    both = F.concat(F.transform("_t", lambda x: F.struct(F.lit("t").alias("lane"), x.alias("term"))), F.transform("_g", lambda x: F.struct(F.lit("g").alias("lane"), x.alias("term"))))
    terms = exploded(rows, [key], both, "x").select(key, "x.lane", "x.term")
    idf = terms.groupBy("lane", "term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("lane", "term", index.idf_bm25(F.col("_n"), F.col("df")).alias("idf"))
    weight = F.when(F.col("lane") == "t", 1.0).otherwise(gram_weight)
    scored = terms.join(F.broadcast(idf), ["lane", "term"]).groupBy(key).agg(
        F.sum(F.col("idf") * weight).alias("score"), F.count_if(F.col("lane") == "t").alias("token_overlap"), F.count_if(F.col("lane") == "g").alias("gram_overlap")
    )
    enough = (F.col("token_overlap") >= index.min_token_overlap(F.lit(len(qt)))) | (F.col("gram_overlap") >= index.min_qgram_overlap(F.lit(len(qg))))
    return scored.where(enough).withColumn("score", F.round("score", 6)).orderBy(F.col("score").desc(), F.col("token_overlap").desc(), F.col("gram_overlap").desc(), key).limit(limit)


def bm25(df: DataFrame, key: str, fields: dict[str, tuple[Column, float]], query_tokens: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 per field times its boost, summed: ``(key, score)``.

    One pass computes all fields' term frequencies inside the rows; the statistics (documents, mean lengths, document frequencies of the query terms) are one small row.
    """
    q = list(dict.fromkeys(query_tokens))
    names = list(fields)
    cols = [key]
    for f in names:
        cols.append(fields[f][0].alias(f"_t_{f}"))
    rows = df.select(*cols)
    for f in names:
        t = F.col(f"_t_{f}")
        rows = rows.withColumn(f"_l_{f}", F.size(t)).withColumn(f"_f_{f}", F.array(*[_count(t, w) for w in q]))
    rows = rows.drop(*[f"_t_{f}" for f in names])
    stats = [F.count("*").alias("_n")]
    for f in names:
        stats.append(F.avg(f"_l_{f}").alias(f"_a_{f}"))
        stats += [F.count_if(F.col(f"_f_{f}")[i] > 0).alias(f"_d_{f}_{i}") for i in range(len(q))]
    one = rows.agg(*stats)
    hit = reduce(lambda x, y: x | y, [F.exists(f"_f_{f}", lambda x: x > 0) for f in names])
    joined = keep_where(rows, hit).crossJoin(F.broadcast(one))
    score = F.lit(0.0)
    for f in names:
        norm = k1 * (1 - b + b * F.col(f"_l_{f}") / F.col(f"_a_{f}"))
        for i in range(len(q)):
            tf = F.col(f"_f_{f}")[i]
            score = score + F.when(tf > 0, fields[f][1] * index.idf_bm25(F.col("_n"), F.col(f"_d_{f}_{i}")) * tf * (k1 + 1) / (tf + norm)).otherwise(0.0)
    return joined.select(key, F.round(score, 6).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; NULL if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def _nearest(shared, k: int):
    def run(batches):
        ids, matrix = shared.value
        norms = np.sqrt((matrix * matrix).sum(1))
        for pdf in batches:
            v = np.array(pdf["v"].tolist(), np.float64).reshape(len(pdf), -1)
            keys = pdf["key"].to_numpy(np.int64)
            length = np.sqrt((v * v).sum(1))
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.round((matrix @ v.T) / np.outer(norms, length), 6)
            sim[~np.isfinite(sim)] = -np.inf
            sim[ids[:, None] == keys[None, :]] = -np.inf
            order = np.lexsort((np.broadcast_to(keys, sim.shape), -sim), axis=1)[:, :k]
            q = np.repeat(ids, order.shape[1])
            found = pd.DataFrame({"query_id": q, "neighbour_id": keys[order].ravel(), "similarity": np.take_along_axis(sim, order, 1).ravel()})
            yield found[np.isfinite(found["similarity"])]

    return run


def knn(df: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int, block: int = 2000) -> DataFrame:
    """The ``k`` nearest vectors per query by cosine, exact: ``(query_id, neighbour_id, similarity, rank)``; ties by id.

    Queries are a stated set: they are taken ``block`` at a time, so no more than a block is on the driver or broadcast however many there are. Each batch of vectors keeps its best ``k`` per query
    before the shuffle. NULL ids and vectors are left out, vectors without length have no neighbours, a row is not its own neighbour.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).where("key IS NOT NULL AND v IS NOT NULL")
    found: DataFrame | None = None
    part: list[tuple[int, list[float]]] = []

    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "neighbour_id")

    def scan(last: bool) -> None:
        nonlocal found
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in part], np.int64), np.array([v for _, v in part], np.float64).reshape(len(part), -1)))
        near = rows.mapInPandas(_nearest(shared, k), "query_id long, neighbour_id long, similarity double")
        if not last or found is not None:  # several blocks: the best of each are written, so its broadcast can go before the next
            near = cut(near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
            shared.destroy()
        found = near if found is None else found.unionByName(near)

    for r in queries.select(F.col(query_key).cast("long").alias("i"), F.col(query_vector).alias("v")).where("i IS NOT NULL AND v IS NOT NULL").toLocalIterator():
        if len(part) >= block:
            scan(False)
            part = []
        part.append((r["i"], r["v"]))
    if part:
        scan(True)
    if found is None:
        return spark.createDataFrame([], "query_id long, neighbour_id long, similarity double, rank int")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_search_fields(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """``df`` with ``<name>_norm`` and ``<name>_tokens`` for every field, computed once per row for the scores below."""
    df = df.withColumns({f"{n}_norm": tx.normalize_search(c) for n, c in fields.items()})
    return df.withColumns({f"{n}_tokens": tx.normalized_tokens(F.col(f"{n}_norm")) for n in fields})


def field_score(query: str, query_tokens: list[str], field: str, weight: float, fuzzy: bool = False) -> Column:
    """Share of the query's tokens in the field, fuzzy hits for the rest, a bonus for the whole phrase. ``field`` is a name of :func:`with_search_fields`."""
    norm, tokens = F.col(f"{field}_norm"), F.array_distinct(f"{field}_tokens")
    if not query_tokens:
        return F.lit(0.0)
    hits, near = F.lit(0), F.lit(0.0)
    for t in query_tokens:
        hit = F.array_contains(tokens, t) | norm.contains(t)
        hits = hits + hit.cast("int")
        if fuzzy and len(t) >= 4:
            best = _closest(tokens, t)
            near = near + F.when(~hit & (best >= 0.45), best).otherwise(0.0)
    phrase = " ".join(query.lower().split())
    whole = F.when(norm.contains(phrase), 2.0).otherwise(0.0) if len(phrase) > 3 else F.lit(0.0)
    return F.when(norm == "", 0.0).otherwise(weight * (4.0 * hits / len(query_tokens) + near + whole))


def weighted_field_score(query: str, exact: list[str], expanded: list[str], field: str, weight: float, fuzzy: bool = False) -> Column:
    """Direct and synonym hits, fuzzy hits, phrase, number, density and place of direct hits. ``field`` is a name of :func:`with_search_fields`."""
    norm, tokens = F.col(f"{field}_norm"), F.col(f"{field}_tokens")
    distinct = tokens
    n = max(1, len(exact))
    direct, near, occurs, first = F.lit(0), F.lit(0.0), F.lit(0), F.lit(None).cast("int")
    for t in exact:
        hit = F.array_contains(distinct, t)
        direct = direct + hit.cast("int")
        occurs = occurs + _count(tokens, t)
        first = F.least(first, F.when(hit, F.array_position(tokens, t) - 1).cast("int"))
        if fuzzy and len(t) >= 4:
            best = _closest(F.array_distinct(tokens), t)
            near = near + F.when(~hit & (best >= 0.45), best).otherwise(0.0)
    synonyms = sum((F.array_contains(distinct, t).cast("int") for t in expanded if t not in exact), F.lit(0))
    phrase = F.when(norm.contains(" ".join(query.lower().split())), 3.0).otherwise(0.0) if query.strip() else F.lit(0.0)
    place = F.when(occurs > 0, F.least(occurs, F.lit(3)) * 0.7 + F.least(occurs / F.greatest(F.size(tokens), F.lit(1)) * 40.0, F.lit(3.0)) + F.greatest(F.lit(0.0), 1.5 - first / 20.0)).otherwise(0.0)
    return F.when(norm == "", 0.0).otherwise(weight * (6.0 * direct / n + 4.0 * synonyms / n + near + phrase + place))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; 0 if either is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def saturate(score: Column) -> Column:
    """Scores above 1 as ``x / (x + 4)``; nothing below 0."""
    x = F.coalesce(score, F.lit(0.0))
    return F.when(x <= 0, 0.0).when(x <= 1, x).otherwise(x / (x + 4))


def fuse_scores(lexical: Column, semantic: Column, semantic_weight: float = 0.34) -> Column:
    """Weighted mean of a saturated lexical and a semantic score."""
    return F.round((1 - semantic_weight) * saturate(lexical) + semantic_weight * F.coalesce(semantic, F.lit(0.0)), 4)


def anchored(tokens: list[str], *fields: Column) -> Column:
    """Whether any token stands as a word in the fields together; no tokens pass, no text fails."""
    joined = F.concat_ws(" ", *fields)
    if not tokens:
        return F.lit(True)
    return (F.trim(joined) != "") & joined.rlike("(?i)\\b(?:" + "|".join(tx._quoted(t) for t in tokens) + ")\\b")
