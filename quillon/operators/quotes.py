"""Finding where a quotation stands in ordered texts: exact spans, anchors, chains of anchors and a cascade of stages."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import spans
from quillon.plans.materialize import exploded, sorted_join


def exact_passages(queries: DataFrame, query_key: str, query_text: Column, df: DataFrame, group: list[str], order: str, text: str, sizes: list[int]) -> DataFrame:
    """Passages of the given sizes whose joined text equals the query's: ``(query_key, *group, start_pos, end_pos)``.

    The join is on a hash of the text with the text checked again, so long texts are not shuffled as keys.
    """
    windows = spans.passage_windows(df, group, order, text, sizes)
    w = windows.select(*group, "start_pos", "end_pos", F.trim("text").alias("_t")).withColumn("_h", F.xxhash64("_t"))
    q = queries.select(query_key, F.trim(query_text).alias("_q")).where("_q <> ''").withColumn("_h", F.xxhash64("_q"))
    return q.join(w, "_h").where(F.col("_q") == F.col("_t")).select(query_key, *group, "start_pos", "end_pos")


def anchor_hits(queries: DataFrame, query_key: list[str], query_tokens: Column, df: DataFrame, group: list[str], tokens: Column, n: int = 5, on: list[str] = ()) -> DataFrame:
    """Equal n-grams of queries and texts: ``(query_key, *group, qpos, pos, gram)``, and how many grams the query has (``n_grams``)."""
    q = spans.token_ngrams(queries.withColumn("_all", F.greatest(F.size(query_tokens) - n + 1, F.lit(0))), [*query_key, *on, "_all"], query_tokens, n)
    q = q.select(*query_key, *on, F.col("_all").alias("n_grams"), F.col("pos").alias("qpos"), "gram")
    t = spans.token_ngrams(df, list(dict.fromkeys([*group, *on])), tokens, n)
    return q.join(sorted_join(t), ["gram", *on])


def anchor_votes(hits: DataFrame, query_key: list[str], group: list[str], most: int = 3) -> DataFrame:
    """The groups a query's n-grams vote for: 3 per gram of the query plus a quarter for each of up to four places; the ``most`` best."""
    per = hits.groupBy(*query_key, *group, "qpos").agg(F.count("*").alias("_n"))
    votes = per.groupBy(*query_key, *group).agg(F.sum(3 + F.least("_n", F.lit(4)) * 0.25).alias("votes"), F.count("*").alias("n_anchors"))
    order = Window.partitionBy(*query_key).orderBy(F.col("votes").desc(), *group)
    return votes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def scope_votes(queries: DataFrame, query_key: list[str], query_lanes: list[Column], df: DataFrame, group: list[str], lanes: list[Column], on: list[str], n: int = 5, most: int = 3, rarest: int = 12) -> DataFrame:
    """The groups a query's tokens vote for, by a plain and a folded lane of tokens; ``lexical_fallback`` says whether rare tokens had to decide.

    An n-gram gives 3 (folded: 2) and 0.25 (0.2) for each of up to four places. A query with n-grams that hits nothing votes by its ``rarest`` tokens of three letters or more (fewest groups, then longest,
    then by token): 2 (folded: 1.5) divided by the number of groups that hold the token, and 0.05 for each of up to four places. Queries of fewer than ``n`` tokens have no votes, as in the reference.
    """
    votes, rare = [], []
    words = lambda rows, keys, lane: exploded(rows, keys, lane, "token")
    for lane, other, base, place, weight in zip(query_lanes, lanes, (3.0, 2.0), (0.25, 0.2), (2.0, 1.5)):
        per = anchor_hits(queries, query_key, lane, df, group, other, n, on).groupBy(*query_key, *group, "qpos").agg(F.count("*").alias("_n"))
        votes.append(per.select(*query_key, *group, (F.lit(base) + F.least("_n", F.lit(4)) * place).alias("_v")))
        held = words(df, [*on, *group], other).groupBy(*on, *group, "token").agg(F.count("*").alias("_n"))
        spread = held.groupBy(*on, "token").agg(F.count("*").alias("_g"))
        asked = words(queries, [*query_key, *on], F.when(F.size(lane) >= n, F.array_distinct(lane))).where(F.length("token") >= 3).join(sorted_join(spread), [*on, "token"])
        best = Window.partitionBy(*query_key).orderBy("_g", F.length("token").desc(), "token")
        few = asked.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= rarest)
        rare.append(few.join(sorted_join(held), [*on, "token"]).select(*query_key, *group, (F.lit(weight) / F.col("_g") + F.least("_n", F.lit(4)) * 0.05).alias("_v")))
    total = lambda parts, fallback: parts[0].unionByName(parts[1]).groupBy(*query_key, *group).agg(F.round(F.sum("_v"), 6).alias("votes")).withColumn("lexical_fallback", F.lit(fallback))
    first = total(votes, False)
    both = first.unionByName(total(rare, True).join(sorted_join(first.select(*query_key).distinct()), query_key, "left_anti"))
    order = Window.partitionBy(*query_key).orderBy(F.col("votes").desc(), *group)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def likely_groups(candidates: DataFrame, query_key: list[str], group: str, score: str, *order: Column | str, first: int = 12, most: int = 3) -> DataFrame:
    """The groups with the greatest sum of scores among a query's ``first`` candidates in the given order; a NULL group takes a place and has no votes."""
    top = candidates.withColumn("_r", F.row_number().over(Window.partitionBy(*query_key).orderBy(*order))).where((F.col("_r") <= first) & F.col(group).isNotNull())
    sums = top.groupBy(*query_key, group).agg(F.round(F.sum(F.coalesce(score, F.lit(0.0))), 6).alias("score"))
    return sums.withColumn("rank", F.row_number().over(Window.partitionBy(*query_key).orderBy(F.col("score").desc(), group))).where(F.col("rank") <= most)


def anchored_spans(hits: DataFrame, query_key: list[str], group: list[str], least_share: float = 0.6) -> DataFrame:
    """Diagonals on which at least ``least_share`` of the query's n-grams stand in place: the start, the number of anchors, whether first, middle and last gram are there.

    On one diagonal all offsets agree, so the groups of hits with equal ``pos - qpos`` are the candidates; no greedy search is needed.
    """
    d = hits.withColumn("start_pos", F.col("pos") - F.col("qpos")).groupBy(*query_key, *group, "start_pos", "n_grams")
    marks = d.agg(F.count("*").alias("n_anchors"), F.max((F.col("qpos") == 0).cast("int")).alias("_a"), F.max((F.col("qpos") == F.floor((F.col("n_grams") - 1) / 2)).cast("int")).alias("_b"), F.max((F.col("qpos") == F.col("n_grams") - 1).cast("int")).alias("_c"))
    kept = marks.where(F.col("n_anchors") >= least_share * F.col("n_grams") - 1e-9)
    return kept.select(*query_key, *group, "start_pos", "n_anchors", "n_grams", (F.col("_a") + F.col("_b") + F.col("_c") == 3).alias("is_exact"))


def _chain(least_share: float, max_gap: int, keys: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Longest chain of hits with rising positions on both sides and bounded gaps."""
        hits = sorted(set(zip(pdf["qpos"], pdf["pos"])))
        length, back = [1] * len(hits), [-1] * len(hits)
        for i, (q, p) in enumerate(hits):
            for j in range(i - 1, -1, -1):
                a, b = hits[j]
                if a < q and 0 < p - b <= q - a + max_gap and length[j] + 1 > length[i]:
                    length[i], back[i] = length[j] + 1, j
        if not hits:
            return pd.DataFrame(columns=[*keys, "n_anchors", "start_pos", "end_pos"])
        end = max(range(len(hits)), key=lambda i: (length[i], -hits[i][1]))
        start = end
        while back[start] >= 0:
            start = back[start]
        if length[end] < least_share * int(pdf["n_grams"].iloc[0]):
            return pd.DataFrame(columns=[*keys, "n_anchors", "start_pos", "end_pos"])
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), length[end], int(hits[start][1]), int(hits[end][1]))], columns=[*keys, "n_anchors", "start_pos", "end_pos"])

    return run


def anchor_chains(hits: DataFrame, query_key: list[str], group: list[str], least_share: float = 0.6, max_gap: int = 8) -> DataFrame:
    """Per query and group the longest chain of n-grams in rising order that holds ``least_share`` of the query's, gaps of up to ``max_gap`` words allowed.

    A task holds the hits of one query in one text; the texts are chapters or entries.
    """
    keys = [*query_key, *group]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hits.schema if f.name in keys)
    return hits.select(*keys, "qpos", "pos", "n_grams").groupBy(*keys).applyInPandas(_chain(least_share, max_gap, [f.name for f in hits.schema if f.name in keys]), f"{kinds}, n_anchors long, start_pos long, end_pos long")


def expanded_spans(seeds: DataFrame, keys: list[str], start: str, end: str, by: int = 2, least: int = 1, last: str | None = None) -> DataFrame:
    """Every span that begins and ends up to ``by`` positions outside a seed, of at least ``least`` positions, inside ``1..last``."""
    rows = seeds.select(*keys, start, end, *([last] if last else [])).distinct()
    rows = rows.withColumn("_s", F.explode(F.sequence(F.greatest(F.lit(1), F.col(start) - by), F.col(start)))).withColumn("_e", F.explode(F.sequence(F.col(end), F.least(F.col(end) + by, F.col(last)) if last else F.col(end) + by)))
    return rows.where(F.col("_e") - F.col("_s") + 1 >= least).select(*keys, F.col("_s").alias("start_pos"), F.col("_e").alias("end_pos")).distinct()


def first_stage(stages: list[DataFrame], query: list[str]) -> DataFrame:
    """For each query the rows of the first stage that found anything, with the stage's number."""
    rows = reduce(DataFrame.unionByName, [s.withColumn("stage", F.lit(i)) for i, s in enumerate(stages)])
    return rows.withColumn("_m", F.min("stage").over(Window.partitionBy(*query))).where("stage = _m").drop("_m")
