"""Neighbour lists of passages and comparisons of token lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators import index
from quillon.plans.materialize import exploded, sorted_join


def neighbours_by_rare_tokens(df: DataFrame, key: str, block: list[str], apart: str, tokens: Column, anchors: int = 6, top: int = 12, min_shared: int = 4, short: bool = False) -> DataFrame:
    """For every row the ``top`` most similar rows of its block from another ``apart`` value.

    Candidates share one of a row's ``anchors`` rarest tokens (by document frequency in the block, then by token), which blocks the join. The score is ``10 * shared + 100 * jaccard + share of
    the source's tokens in percent``; ties go by key. Rows without tokens have no neighbours. Tokens travel with the anchor rows only; all other rows are met through the postings.
    Of a row's postings the ``min_shared - 1`` most frequent tokens are left out: the rarest shared token of a pair with enough of them has as many behind it, so every such pair still meets, and common words gather no one.
    With ``short`` (token lists of a dozen or so) they travel with the postings too: a pair is judged where it meets, at the first of the source's anchors that the other holds, and only pairs with enough
    shared tokens are shuffled. The result is the same.
    """
    sets = df.select(*block, key, apart, F.array_distinct(tokens).alias("_t"))
    terms = exploded(sets, [*block, key], F.col("_t"), "term")
    freq = terms.groupBy(*block, "term").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy(*block, key).orderBy("df", "term")
    order = terms.join(sorted_join(freq), [*block, "term"]).withColumn("_r", F.row_number().over(rarest)).withColumn("_of", F.count("*").over(Window.partitionBy(*block, key))).where(F.col("_r") <= F.greatest(F.lit(anchors), F.col("_of") - (min_shared - 1)))
    anchor = order.where(F.col("_r") <= anchors).select(*block, key, "term", "_r")
    posted = order.where(F.col("_r") <= F.col("_of") - (min_shared - 1)).select(*block, key, "term")
    shared = F.size(F.array_intersect("_t", "_u"))
    if short:
        long_enough = sets.where(F.size("_t") >= min_shared)
        ranked = anchor.groupBy(*block, key).agg(F.array_sort(F.collect_list(F.struct("_r", "term"))).alias("_a")).withColumn("_a", F.col("_a.term"))
        source = ranked.join(sorted_join(long_enough), [*block, key]).select(*block, key, apart, "_t", "_a", F.posexplode("_a").alias("_p", "term"))
        other = posted.join(sorted_join(long_enough), [*block, key]).select(*block, F.col(key).alias("_c"), F.col(apart).alias("_ca"), F.col("_t").alias("_u"), "term")
        met = source.join(sorted_join(other), [*block, "term"]).where((F.col(key) != F.col("_c")) & (F.col(apart) != F.col("_ca")) & (shared >= min_shared) & ~F.arrays_overlap(F.slice("_a", F.lit(1), F.col("_p")), F.col("_u")))
        scored = met.select(*block, key, "_c", shared.alias("shared"), F.size("_t").alias("_n"), F.size("_u").alias("_m"))
    else:
        source = anchor.join(sorted_join(sets.select(*block, key, apart)), [*block, key])
        other = posted.join(sorted_join(sets.select(*block, F.col(key), F.col(apart))), [*block, key]).select(*block, "term", F.col(key).alias("_c"), F.col(apart).alias("_ca"))
        pairs = source.join(sorted_join(other), [*block, "term"]).where((F.col(key) != F.col("_c")) & (F.col(apart) != F.col("_ca"))).select(*block, key, "_c").distinct()
        right = sets.select(*block, F.col(key).alias("_c"), F.col("_t").alias("_u"))
        scored = pairs.join(sorted_join(sets.select(*block, key, "_t")), [*block, key]).join(sorted_join(right), [*block, "_c"])
        scored = scored.select(*block, key, "_c", shared.alias("shared"), F.size("_t").alias("_n"), F.size("_u").alias("_m")).where(F.col("shared") >= min_shared)
    coverage = F.col("shared") / F.col("_n") * 100
    score = F.col("shared") * 10 + F.col("shared") / (F.col("_n") + F.col("_m") - F.col("shared")) * 100 + coverage
    scored = scored.withColumn("score", F.round(score, 6)).withColumn("coverage", F.round(coverage, 2)).withColumn("missing", F.col("_n") - F.col("shared"))
    order = Window.partitionBy(*block, key).orderBy(F.col("score").desc(), F.col("shared").desc(), "_c")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.select(*block, key, F.col("_c").alias("neighbour_id"), "rank", "shared", "coverage", "missing", "score")


def missing_count(query: Column, other: Column) -> Column:
    """How many tokens of the query are missing in the other list, counting repetitions."""
    per = F.transform(F.array_distinct(query), lambda t: F.greatest(F.lit(0), F.size(F.filter(query, lambda x: x == t)) - F.size(F.filter(other, lambda x: x == t))))
    return F.aggregate(per, F.lit(0), lambda s, x: s + x)


def one_edit_apart(a: Column, b: Column) -> Column:
    """H8: whether two token lists differ by at most one replaced, inserted or removed token."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), lambda e: ~e)) <= 1
    drop_one = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x))), lambda i: F.concat(F.slice(x, F.lit(1), i - 1), F.slice(x, i + 1, F.greatest(F.lit(0), F.size(x) - i))))
    longer, shorter = F.when(F.size(a) >= F.size(b), a).otherwise(b), F.when(F.size(a) >= F.size(b), b).otherwise(a)
    return F.when(F.size(a) == F.size(b), same).when(F.abs(F.size(a) - F.size(b)) == 1, F.exists(drop_one(longer), lambda x: x == shorter)).otherwise(False)


def relaxed_parallel(a: Column, b: Column, a_folded: Column, b_folded: Column) -> Column:
    """Whether ``b`` is a parallel of ``a`` in the wide sense: at least six tokens, at most four missing, half of the distinct tokens covered, each in the better of the plain and the folded form."""
    share = lambda x, y: F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)) * F.lit(100.0), F.size(F.array_distinct(x))), F.lit(0.0))
    return (F.size(a) >= 6) & (F.least(missing_count(a, b), missing_count(a_folded, b_folded)) <= 4) & (F.greatest(share(a, b), share(a_folded, b_folded)) >= 50)


def one_edit_pairs(df: DataFrame, key: str, block: list[str], tokens: Column, least: int = 4) -> DataFrame:
    """H8: every ordered pair of rows of a block whose token lists differ by at most one token (:func:`one_edit_apart`), where the first has at least ``least`` tokens.

    Two such lists agree once the token is taken out of both, or out of the longer one, so lists meet on the hashes of themselves with one or no token removed, and what meets is compared.
    Equal lists are reduced to one before the join and come apart again in the result. Rows with a NULL block value have no pairs.
    """
    rows = df.select(*block, key, tokens.alias("_t")).where(F.size("_t") >= least - 1)
    lists = rows.groupBy(*block, "_t").agg(F.min(key).alias("_d"))
    n = F.size("_t")
    without = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.xxhash64(F.concat(F.slice("_t", F.lit(1), i - 1), F.slice("_t", i + 1, F.greatest(F.lit(0), n - i)))))
    marks = exploded(lists, [*block, "_d"], F.array_distinct(F.array_append(without, F.xxhash64("_t"))), "_s")
    other = marks.select(*block, "_s", F.col("_d").alias("_e"))
    meet = marks.join(sorted_join(other), [*block, "_s"]).where("_d < _e").select(*block, "_d", "_e").distinct()
    met = meet.join(sorted_join(lists), [*block, "_d"]).join(sorted_join(lists.select(*block, F.col("_d").alias("_e"), F.col("_t").alias("_u"))), [*block, "_e"])
    one = met.where(one_edit_apart(F.col("_t"), F.col("_u"))).select(*block, "_d", "_e")
    both = one.unionByName(one.select(*block, F.col("_e").alias("_d"), F.col("_d").alias("_e"))).unionByName(lists.select(*block, "_d", F.col("_d").alias("_e")))
    members = rows.join(sorted_join(lists), [*block, "_t"]).select(*block, "_d", key, F.size("_t").alias("_n"))
    found = members.where(F.col("_n") >= least).join(sorted_join(both), [*block, "_d"]).drop("_d", "_n")
    return found.join(sorted_join(members.select(*block, F.col("_d").alias("_e"), F.col(key).alias("neighbour_id"))), [*block, "_e"]).where(F.col(key) != F.col("neighbour_id")).select(*block, key, "neighbour_id")


def exact_groups(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Rows by their trimmed text: how many share it and, if it is only one, which. Empty texts are left out."""
    rows = df.select(key, F.trim(F.coalesce(text, F.lit(""))).alias("text")).where("text <> ''")
    out = rows.groupBy("text").agg(F.count("*").alias("n"), F.min(key).alias("_k"))
    return out.select("text", "n", F.when(F.col("n") == 1, F.col("_k")).alias("unique_key"))


def document_terms(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """The weighted terms of every row: term frequency times BM25 idf."""
    rows = index.postings(df, key, tokens)
    n = df.agg(F.count("*").alias("_n"))
    freq = rows.groupBy("term").agg(F.count("*").alias("df"))
    return rows.join(freq, "term").crossJoin(F.broadcast(n)).select(key, "term", "tf", F.round(F.col("tf") * index.idf_bm25(F.col("_n"), F.col("df")), 6).alias("weight"))
