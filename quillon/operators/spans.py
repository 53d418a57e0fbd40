"""Ordered rows as windows, spans and positions: passages, sentence windows, token streams, alignment and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.materialize import exploded, sorted_join


def latest(df: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """One row per key, the newest by the given columns (descending); a NULL key is a key of its own. Extra columns are kept."""
    order = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in newest])
    return df.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def passage_windows(df: DataFrame, group: list[str], order: str, text: str, sizes: list[int]) -> DataFrame:
    """Every run of ``k`` neighbouring rows of a group, for each size: first and last position and the joined text.

    Only complete runs of consecutive positions count. One window of the largest size gives them all: each row carries that many texts at most.
    """
    run = Window.partitionBy(*group).orderBy(order).rowsBetween(0, max(sizes) - 1)
    item = F.struct(F.col(order).alias("p"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = df.select(*group, F.col(order).alias("start_pos"), F.collect_list(item).over(run).alias("_run"))
    rows = rows.withColumn("window_size", F.explode(F.array(*[F.lit(k) for k in sizes]))).withColumn("end_pos", F.try_element_at("_run", "window_size")["p"])
    whole = rows.where(F.col("end_pos") - F.col("start_pos") == F.col("window_size") - 1)
    return whole.select(*group, "window_size", "start_pos", "end_pos", F.array_join(F.slice("_run.t", F.lit(1), F.col("window_size")), " ").alias("text"))


def list_windows(items: Column, widths: list[int]) -> Column:
    """Every run of ``w`` neighbouring elements of an array as ``(start, width, items)``, for each width."""
    n = F.size(items)

    def of_width(w: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - w + 1)), lambda i: F.struct((i - 1).alias("start"), F.lit(w).alias("width"), F.slice(items, i, w).alias("items")))
        return F.when(n >= w, runs)

    per = [of_width(w) for w in widths]
    empty = F.array().cast("array<struct<start:int,width:int,items:array<string>>>")
    return F.flatten(F.array(*[F.coalesce(p, empty) for p in per]))


def running_offsets(df: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """Where each row's text starts and ends when the rows of a group are joined with single spaces."""
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    start = F.coalesce(F.sum(n + 1).over(before), F.lit(0))
    return df.select(*group, order, start.alias("char_start"), (start + n).alias("char_end"))


def token_stream(df: DataFrame, group: list[str], order: str, tokens: Column) -> DataFrame:
    """One row per token with its position in the group, counted over the rows in order.

    Positions come from a running count per row, so only one small row per text is sorted, not the tokens.
    """
    rows = df.select(*group, order, tokens.alias("_t"))
    before = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_o", F.coalesce(F.sum(F.size("_t")).over(before), F.lit(0)))
    return exploded(rows, [*group, order, "_o"], F.col("_t"), "token", "_p").select(*group, order, (F.col("_o") + F.col("_p")).alias("pos"), "token")


def token_ngrams(df: DataFrame, keys: list[str], tokens: Column, n: int) -> DataFrame:
    """Every run of ``n`` neighbouring tokens with its position."""
    rows = df.select(*keys, tokens.alias("_t"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_t") - n + 1)), lambda i: F.array_join(F.slice("_t", i, n), " "))
    return exploded(rows, keys, F.when(F.size("_t") >= n, grams), "gram", "pos").select(*keys, "pos", "gram")


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], bin_width: int | None = None) -> DataFrame:
    """Pairs whose closed spans overlap, with the width of the overlap.

    ``left`` and ``right`` share the key columns ``on``; all other columns must differ in name. With ``bin_width`` both sides are cut into bins that become part of the
    equality key, for spans over a wide domain with few keys; a pair that meets in several bins is kept in the first one only. Rows with a NULL key or end match nothing.
    """
    (ls, le), (rs, re_) = left_span, right_span
    hit = (F.col(ls) <= F.col(re_)) & (F.col(le) >= F.col(rs))
    if bin_width is None:
        joined = left.join(right, on).where(hit)
    else:
        bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width), F.floor(F.col(b) / bin_width)))
        lhs = left.where(F.col(ls) <= F.col(le)).withColumn("_bin", bins(ls, le))
        rhs = right.where(F.col(rs) <= F.col(re_)).withColumn("_bin", bins(rs, re_))
        joined = lhs.join(rhs, [*on, "_bin"]).where(hit & (F.col("_bin") == F.floor(F.greatest(ls, rs) / bin_width))).drop("_bin")
    return joined.withColumn("overlap", F.least(le, re_) - F.greatest(ls, rs) + 1)


def rank_overlaps(hits: DataFrame, key: list[str], query_span: tuple[str, str], span: tuple[str, str], row_id: str, most: int) -> DataFrame:
    """Per query the best overlaps: equal spans first, then containing ones, wide overlaps, narrow rows, near anchors, small ids."""
    (qs, qe), (s, e) = query_span, span
    w = Window.partitionBy(*key).orderBy(
        ((F.col(s) == F.col(qs)) & (F.col(e) == F.col(qe))).desc(), ((F.col(s) <= F.col(qs)) & (F.col(e) >= F.col(qe))).desc(), F.col("overlap").desc(), F.col(e) - F.col(s), F.abs(F.col(s) - F.col(qs)), row_id
    )
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def fill_forward_groups(df: DataFrame, group: list[str], order: str, text: str) -> DataFrame:
    """Sections of rows: an empty text belongs to the section of the last text before it, leading empty texts to the first section.

    Gives ``section_no`` (from 1), first and last position, the number of rows and the section's text. Groups without any text are left out.
    """
    by = Window.partitionBy(*group).orderBy(order)
    filled = F.trim(F.coalesce(F.col(text), F.lit(""))) != ""
    rows = df.select(*group, order, F.when(filled, F.col(text)).alias("_t")).withColumn("section_no", F.greatest(F.lit(1), F.sum(F.col("_t").isNotNull().cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))))
    out = rows.groupBy(*group, "section_no").agg(F.min(order).alias("start_pos"), F.max(order).alias("end_pos"), F.count("*").alias("n_rows"), F.max("_t").alias("text"))
    return out.where(F.col("text").isNotNull())


def _runs_of(df: DataFrame, by: list[str], pos: str, n: int) -> DataFrame:
    """Tokens replaced by the ``n`` tokens that begin at their position; the last ones of a text, which have fewer after them, are left out."""
    order = Window.partitionBy(*dict.fromkeys(by)).orderBy(pos)
    rows = df.withColumn("_end", F.lead(pos, n - 1).over(order)).withColumn("_t", F.concat_ws(" ", "token", *[F.lead("token", i).over(order) for i in range(1, n)]))
    return rows.where(F.col("_end") == F.col(pos) + n - 1).withColumn("token", F.col("_t")).drop("_end", "_t")


def aligned_runs(query: DataFrame, stream: DataFrame, query_key: list[str], group: list[str], on: list[str] = (), least: int = 1) -> DataFrame:
    """Longest common runs of tokens between queries and streams, as gaps and islands over the difference of positions.

    ``query(*query_key, qpos, token)`` meets ``stream(*group, pos, token)`` by token and, where given, the columns ``on`` that both have; along one diagonal consecutive positions form an island.
    Gives the position and length of the longest island per query and group (ties: the earliest). They meet by whole runs of ``least`` tokens, of which every longer run consists, so common words alone meet nothing.
    """
    if least > 1:
        query, stream = _runs_of(query, [*query_key, *on], "qpos", least), _runs_of(stream, [*group, *on], "pos", least)
    hits = query.join(sorted_join(stream), ["token", *on]).withColumn("_d", F.col("pos") - F.col("qpos"))
    diagonal = Window.partitionBy(*query_key, *group, "_d").orderBy("qpos")
    islands = hits.withColumn("_i", F.col("qpos") - F.row_number().over(diagonal))
    runs = islands.groupBy(*query_key, *group, "_d", "_i").agg(F.min("qpos").alias("query_start"), F.min("pos").alias("stream_start"), (F.count("*") + (least - 1)).alias("run_length"))
    best = Window.partitionBy(*query_key, *group).orderBy(F.col("run_length").desc(), "query_start", "stream_start")
    return runs.withColumn("_b", F.row_number().over(best)).where("_b = 1").select(*query_key, *group, "query_start", "stream_start", "run_length")


def contained_spans(df: DataFrame, group: list[str], order: str, text: str, needle: str) -> DataFrame:
    """Every occurrence of ``needle`` in the joined text of a group, mapped back to the first and last row it covers.

    The text of a group (a chapter) is joined once; the found offsets are matched with the rows' character ranges.
    """
    ranges = running_offsets(df, group, order, text)
    joined = df.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")))), lambda x: x["t"]), " ").alias("_all"))
    n = len(needle)
    chars = joined.where(F.col("_all").contains(needle)).select(*group, F.split("_all", "").alias("_c"))
    here = lambda i: (F.get("_c", i) == needle[0]) & (F.array_join(F.slice("_c", i + 1, n), "") == needle)
    found = chars.select(*group, F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_c") - n)), here)).alias("hit_start"))
    hits = found.join(ranges, group).where((F.col("char_start") < F.col("hit_start") + n) & (F.col("char_end") > F.col("hit_start")))
    return hits.groupBy(*group, "hit_start").agg(F.min(order).alias("start_pos"), F.max(order).alias("end_pos"))


def complete_spans(spans: DataFrame, rows: DataFrame, on: list[str], order: str, start: str, end: str) -> DataFrame:
    """For each span how many of its positions are there, and whether all are. Equal spans are counted once; a span with a NULL key or end has none."""
    key = [*on, start, end]
    have = rows.select(*on, F.col(order).alias("_o")).distinct()
    hits = spans.select(*key).distinct().join(have, on).where(F.col("_o").between(F.col(start), F.col(end))).groupBy(*key).agg(F.count("*").alias("n_found"))
    out = spans.join(hits, key, "left").withColumn("n_found", F.coalesce("n_found", F.lit(0)))
    return out.select(*spans.columns, "n_found").withColumn("is_complete", F.col("n_found") == F.col(end) - F.col(start) + 1)


def missing_positions(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """Runs of positions that are missing between the first and last of a group, starting from 1."""
    rows = df.select(*group, order).where(F.col(order).isNotNull()).distinct()
    prev = F.coalesce(F.lag(order).over(Window.partitionBy(*group).orderBy(order)), F.lit(0))
    return rows.withColumn("_p", prev).where(F.col(order) > F.col("_p") + 1).select(*group, (F.col("_p") + 1).alias("missing_from"), (F.col(order) - 1).alias("missing_to"))


def neighbours(df: DataFrame, group: list[str], order: str) -> DataFrame:
    """The positions before and after each row of a group; NULL at the ends."""
    by = Window.partitionBy(*group).orderBy(order)
    return df.select(*group, order, F.lag(order).over(by).alias("prev_pos"), F.lead(order).over(by).alias("next_pos"))


def nth_of_span(start: Column, end: Column, n: Column) -> Column:
    """The n-th position of a closed span, counted from 1 or with negative n from the end; NULL outside."""
    return F.try_element_at(F.sequence(start, end), n.cast("int"))
