"""Searches put together from lanes: shortlists for many queries at once, boolean full-text queries, hybrid candidates and guidance units as candidates."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion, index, retrieval
from quillon.plans.materialize import cut, exploded, sorted_join

# Weights of the lanes of the shortlist: light words, aggressively folded words, character grams.
LANES = {"light": 1.0, "folded": 0.65, "gram": 0.35}
# From this length of a query on, and below this share of candidates, character grams are used.
GRAM_LENGTH, FEW_CANDIDATES = 14, 20
# Texts and queries of a bucket, of which each pair of buckets is counted as a whole.
BUCKET_TEXTS, BUCKET_QUERIES = 4096, 1024


def _forms(text: Column) -> list[Column]:
    """The light and the folded form of a text with their terms per lane."""
    light, folded = tx.arabic_light(text), tx.arabic_aggressive(text)
    return [light.alias("_light"), folded.alias("_folded")]


def _laned(lane: str, terms: Column) -> Column:
    return F.transform(F.array_distinct(terms), lambda x: F.concat(F.lit(lane), x))


def _terms() -> Column:
    """The distinct terms of a text's forms, each after the letter of its lane: words of the light and of the folded form, grams of the folded one."""
    lanes = {"l": tx.words(F.col("_light")), "f": tx.words(F.col("_folded")), "g": tx.qgrams(F.col("_folded"))}
    return F.flatten(F.array(*[_laned(lane, c) for lane, c in lanes.items()]))


def _best_of_bucket(block: list[str], limit: int):
    """For each query of a bucket the ``limit`` best texts of another bucket, with and without grams where the number of all candidates has to decide on them."""

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        facts = {"_use": pa.bool_(), "_ok": pa.bool_(), "_many": pa.int64(), "score": pa.float64(), "token_overlap": pa.int64(), "gram_overlap": pa.int64()}
        schema = pa.schema([*[asked.schema.field(c) for c in (*block, "_q", "_len")], rows.schema.field("_form"), *facts.items()])
        if not asked.num_rows or not rows.num_rows:
            return schema.empty_table()
        rows = rows.sort_by("_form")  # positions are in the order of ids
        flat = lambda t, c: t[c].combine_chunks().flatten()
        sizes = lambda t, c: pc.list_value_length(t[c]).to_numpy()
        known = pc.unique(flat(asked, "_terms"))
        is_gram = pc.starts_with(known, "g").to_numpy(zero_copy_only=False)
        code = pc.fill_null(pc.index_in(flat(rows, "_terms"), known), -1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(code >= 0)
        held = held[np.argsort(code[held], kind="stable")]
        places = np.repeat(np.arange(rows.num_rows), sizes(rows, "_terms"))[held]
        lists = np.split(places, np.searchsorted(code[held], np.arange(1, len(known))))
        n_rows, total = rows["_c"].to_numpy(), rows.num_rows

        wanted, weight = pc.index_in(flat(asked, "_terms"), known).to_numpy(zero_copy_only=False), flat(asked, "_weights").to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes(asked, "_terms"))
        need_words, need_grams, length = (asked[c].to_numpy() for c in ("_words", "_grams", "_len"))

        def met(terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """How many of the terms each text holds, and the sum of their weights."""
            if not len(terms):
                return np.zeros(total, "int64"), np.zeros(total)
            found = [lists[t] for t in terms]
            at = np.concatenate(found)
            return np.bincount(at, minlength=total), np.bincount(at, np.repeat(weights, [len(x) for x in found]), total)

        out: list[tuple] = []
        for i, end in enumerate(ends):
            own = slice(ends[i - 1] if i else 0, end)
            terms, weights = wanted[own], weight[own]
            grams = is_gram[terms]
            words, by_words = met(terms[~grams], weights[~grams])
            shared, by_grams = met(terms[grams], weights[grams])
            enough = words >= need_words[i]
            many = int(n_rows[enough].sum())
            for use in (True,) if length[i] >= GRAM_LENGTH else (True, False):
                score = np.floor((by_words + by_grams if use else by_words) * 1e6 + 0.5) / 1e6
                good = enough | (shared >= need_grams[i]) if use else enough
                pool = np.flatnonzero(good)
                ok = len(pool) > 0
                if not ok:
                    pool = np.flatnonzero((words > 0) | (shared > 0) if use else words > 0)
                if len(pool) > limit:
                    pool = pool[score[pool] >= np.partition(score[pool], -limit)[-limit]]
                p = shared if use else np.zeros_like(shared)
                pool = pool[np.lexsort((pool, -p[pool], -words[pool], -score[pool]))[:limit]]
                n = len(pool)
                out.append((np.full(n, i), pool, np.full(n, use), np.full(n, ok), np.where(np.arange(n) == 0, many, 0), score[pool], words[pool], p[pool]))
        i, pool, *values = (np.concatenate(x) for x in zip(*out))
        return pa.table([*asked.select([*block, "_q", "_len"]).take(pa.array(i)).columns, rows["_form"].take(pa.array(pool)), *map(pa.array, values)], schema=schema)

    return run


def shortlist(rows: DataFrame, key: str, text: Column, queries: DataFrame, query_key: str, query: Column, block: list[str], limit: int = 250, short_circuit: bool = True) -> DataFrame:
    """For many queries the best rows of their block: ``(query_id, *block, id, strategy, score, token_overlap, gram_overlap, rank)``.

    A query whose light or folded form is the form of a row gets just these rows, by id (``exact``), unless ``short_circuit`` is off (G27). The others get the rows with enough words or enough grams, by the idf of
    what they share over the three lanes, ties by id; if no row has enough, all that share anything. Grams count for queries of some length or with few candidates only. NULL and empty texts and NULL blocks match
    nothing. Ids are unique.

    Shared terms grow with the square of the rows, so they are never rows of their own: texts, each wording once, and queries meet as buckets of bounded size, where the terms are counted in memory, and only
    the ``limit`` best of each bucket go on.
    """
    known = F.lit(True)
    for c in block:
        known = known & F.col(c).isNotNull()
    forms = cut(rows.where(known).select(*block, F.col(key).alias("id"), *_forms(text)).where("_light <> ''"))
    asked = cut(queries.where(known).select(*block, F.col(query_key).alias("query_id"), *_forms(query)).where("_light <> ''"))
    wording = [*block, "_light", "_folded"]
    if short_circuit:
        first = lambda form: sorted_join(fusion.top_k(forms.select(*block, "id", form), [*block, form], limit, "id").drop("rank"))
        same = [asked.select(*block, "query_id", form).join(first(form), [*block, form]).select(*block, "query_id", "id") for form in ("_light", "_folded")]
        best_exact = cut(fusion.top_k(same[0].unionByName(same[1]).distinct(), [*block, "query_id"], limit, "id"))
        asked = asked.join(sorted_join(best_exact.select(*block, "query_id").distinct()), [*block, "query_id"], "left_anti")
    texts = forms.groupBy(*wording).agg(F.min("id").alias("_form"), F.count("*").alias("_c"))
    wanted = asked.groupBy(*wording).agg(F.min("query_id").alias("_q"))
    n = texts.groupBy(*block).agg(F.sum("_c").alias("_rows"), F.ceil(F.count("*") / BUCKET_TEXTS).alias("_b")).join(wanted.groupBy(*block).agg(F.ceil(F.count("*") / BUCKET_QUERIES).alias("_a")), block)
    n = F.broadcast(cut(n))  # a row per block
    dealt = lambda df, k, own, other: df.join(n, block).select(*df.columns, F.pmod(F.xxhash64(*k), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other))

    idf = exploded(texts, [*block, "_c"], _terms(), "_x").groupBy(*block, "_x").agg(F.sum("_c").alias("_df")).join(n, block)
    lane = F.substring("_x", 1, 1)
    weight = F.when(lane == "l", LANES["light"]).when(lane == "f", LANES["folded"]).otherwise(LANES["gram"])
    idf = idf.select(*block, "_x", (weight * index.idf_bm25(F.col("_rows"), F.col("_df"))).alias("_weight"))
    least = [index.min_token_overlap(F.size(F.array_distinct(tx.words(F.col("_light"))))).alias("_words"), index.min_qgram_overlap(F.size(tx.qgrams(F.col("_folded")))).alias("_grams"), F.length("_folded").alias("_len")]
    terms = exploded(wanted.select(*block, "_q", *least, "_light", "_folded"), [*block, "_q", "_words", "_grams", "_len"], _terms(), "_x").join(sorted_join(idf), [*block, "_x"])
    lists = terms.groupBy(*block, "_q", "_words", "_grams", "_len").agg(F.array_sort(F.collect_list(F.struct("_x", "_weight"))).alias("_l"))
    lists = lists.select(*block, "_q", "_words", "_grams", "_len", F.col("_l._x").alias("_terms"), F.col("_l._weight").alias("_weights"))

    # buckets are few and costly, so they are spread over a fixed number of tasks; the terms of a text are made behind the shuffle
    spread, at = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*block, "_a", "_b"]
    left = dealt(lists, ["_q"], "_a", "_b").repartition(spread, *at)
    right = dealt(texts, ["_form"], "_b", "_a").repartition(spread, *at).select(*[F.col(c).alias(c) for c in at], "_form", "_c", _terms().alias("_terms"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for df, names in ((lists, [*block, "_q", "_len"]), (texts, ["_form"])) for c in names)
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_best_of_bucket(block, limit), f"{kinds}, _use boolean, _ok boolean, _many long, score double, token_overlap long, gram_overlap long")

    of_query = Window.partitionBy(*block, "_q")
    grams = (F.col("_len") >= GRAM_LENGTH) | (F.sum(F.when(F.col("_use"), F.col("_many"))).over(of_query) < max(FEW_CANDIDATES, limit // 5))
    found = found.withColumn("_by_grams", grams).where("_use = _by_grams")
    found = found.withColumn("_any", F.max("_ok").over(of_query)).where(F.col("_ok") | ~F.col("_any"))
    order = [F.col("score").desc(), F.col("token_overlap").desc(), F.col("gram_overlap").desc()]
    # a wording stands in the order by its first id, so the best rows are among those of the best wordings
    best = fusion.top_k(found, [*block, "_q"], limit, *order, "_form").select(*block, "_q", "_form", "score", "token_overlap", "gram_overlap")
    ids = fusion.top_k(forms, wording, limit, "id").select(*block, F.min("id").over(Window.partitionBy(*wording)).alias("_form"), "id")
    best = fusion.top_k(best.join(sorted_join(ids), [*block, "_form"]), [*block, "_q"], limit, *order, "id")
    askers = asked.select(*block, "query_id", F.min("query_id").over(Window.partitionBy(*wording)).alias("_q"))
    columns = ["query_id", "id", "strategy", "score", "token_overlap", "gram_overlap", "rank"]
    open_ = askers.join(sorted_join(best), [*block, "_q"]).withColumn("strategy", F.lit("token_qgram")).select(*block, *columns)
    if not short_circuit:
        return open_
    none = {"strategy": F.lit("exact"), "score": F.lit(None).cast("double"), "token_overlap": F.lit(0).cast("long"), "gram_overlap": F.lit(0).cast("long")}
    return best_exact.withColumns(none).select(*block, *columns).unionByName(open_)


def _phrases(tokens: Column, query: list[str]) -> Column:
    """How often the words of the query follow each other in the list."""
    if not query:
        return F.lit(0)
    phrase = F.array(*map(F.lit, query))
    return F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - len(query) + 1)), lambda i: F.slice(tokens, i, len(query)) == phrase))


def bool_search(
    df: DataFrame, key: str, fields: dict[str, Column], query: list[str], clauses: list[tuple[str, str, float]], features: list[tuple[Column, float]] = (), keep: Column | None = None, must_not: Column | None = None,
    least: int = 1, carry: list[str] = (), k1: float = 1.2, b: float = 0.75,
) -> DataFrame:
    """``(key, score, *carry)`` of the rows that pass the filters, scored by boosted clauses.

    ``clauses`` are ``(kind, field, boost)``: 'phrase' (all words in a row), 'and' (all words), 'or' (any word), each by BM25 over its field; ``features`` add their boost where they hold. With ``least`` 1 a row needs
    one clause or feature that matches, with 0 the clauses only order the rows. Without query words and features every row matches with 1.0. Statistics are those of all rows, before the filters, and one small row.
    """
    q = list(dict.fromkeys(query))
    passes = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    if must_not is not None:
        passes = passes & ~F.coalesce(must_not, F.lit(False))
    if not q and not features:
        return df.where(passes).select(key, F.lit(1.0).alias("score"), *carry)
    rows = df.withColumn("_pass", passes).withColumn("_feature", F.round(sum((F.when(c, w).otherwise(0.0) for c, w in features), F.lit(0.0)), 9))
    rows = rows.select(key, *carry, "_pass", "_feature", *[c.alias(f"_t_{f}") for f, c in fields.items()])
    for f in fields:
        t = F.col(f"_t_{f}")
        rows = rows.withColumn(f"_l_{f}", F.size(t)).withColumn(f"_f_{f}", F.array(*[retrieval._count(t, w) for w in q]).cast("array<int>")).withColumn(f"_p_{f}", _phrases(t, query))
    rows = rows.drop(*[f"_t_{f}" for f in fields])
    has = lambda f: F.col(f"_l_{f}") > 0
    stats = [x for f in fields for x in (F.count_if(has(f)).alias(f"_n_{f}"), F.avg(F.when(has(f), F.col(f"_l_{f}"))).alias(f"_a_{f}"), *[F.count_if(F.col(f"_f_{f}")[i] > 0).alias(f"_d_{f}_{i}") for i in range(len(q))])]
    joined = rows.where("_pass").crossJoin(F.broadcast(rows.agg(*stats))) if q else rows.where("_pass")
    score, matched = F.col("_feature"), F.col("_feature") != 0
    for kind, f, boost in clauses if q else ():
        tf = [F.col(f"_f_{f}")[i] for i in range(len(q))]
        idf = [index.idf_bm25(F.col(f"_n_{f}"), F.col(f"_d_{f}_{i}")) for i in range(len(q))]
        norm = k1 * (1 - b + b * F.col(f"_l_{f}") / F.col(f"_a_{f}"))
        part = lambda t, w, norm=norm: F.when(t > 0, w * t * (k1 + 1) / (t + norm)).otherwise(0.0)
        if kind == "phrase":
            hit, value = F.col(f"_p_{f}") > 0, part(F.col(f"_p_{f}"), sum(idf, F.lit(0.0)))
        else:
            join = (lambda x, y: x & y) if kind == "and" else (lambda x, y: x | y)
            hit, value = reduce(join, [t > 0 for t in tf]), sum((part(t, w) for t, w in zip(tf, idf)), F.lit(0.0))
        score, matched = score + F.when(hit, boost * value).otherwise(0.0), matched | hit
    return joined.where(matched if least else F.lit(True)).select(key, F.round(score, 6).alias("score"), *carry)


def hybrid_candidates(lanes: list[DataFrame], relaxed: list[DataFrame], query: list[str], key: str, facts: DataFrame, anchored: str, boosted: str, enough: int = 5, limit: int = 20, boost: float = 1.3) -> DataFrame:
    """Candidates from a strict pair of lanes, topped up from the relaxed one where it is thin.

    ``lanes`` and ``relaxed`` are ranked lists ``(*query, key, rank)``. Each pair is fused by reciprocal ranks; rows of the relaxed one join, without those of the strict one, for queries with fewer than ``enough``
    strict rows. ``facts`` holds per key whether a query word stands in its text (``anchored``) and whether it is to be ``boosted``, and ``central`` and ``answer``. A relaxed row without an anchor gets centrality 0. The best ``limit``
    by score, centrality, answerability and key are kept.
    """
    strict = fusion.reciprocal_rank_fusion(lanes, query, key).select(*query, key, "score")
    more = fusion.reciprocal_rank_fusion(relaxed, query, key).select(*query, key, "score")
    both = fusion.supplement(strict, more, query, key, enough).join(facts, key)
    score = F.round(F.col("score") * F.when(F.col(boosted), boost).otherwise(1.0), 9)
    trusted = (F.col("lane") == "strict") | F.col(anchored)
    rows = both.select(*query, key, "lane", score.alias("score"), F.when(trusted, F.col("central")).otherwise(0.0).alias("central"), "answer")
    return fusion.top_k(rows, query, limit, F.col("score").desc(), F.col("central").desc(), F.col("answer").desc(), key)


def merged_candidates(lanes: list[DataFrame], query: list[str], key: str, limit: int) -> DataFrame:
    """Rows of several lanes ``(*query, key, score, answer, central, incidental, narrative)``: per key the best score (the earlier lane on a tie), then the best by six keys."""
    rows = reduce(DataFrame.unionByName, [d.withColumn("lane", F.lit(i)) for i, d in enumerate(lanes)])
    best = fusion.keep_first(rows, [*query, key], F.col("score").desc(), "lane")
    return fusion.top_k(best, query, limit, F.col("score").desc(), F.col("answer").desc(), F.col("central").desc(), "incidental", "narrative", key)


def text_match(norm: str, tokens: str, query_tokens: list[str], aliases: list[str]) -> Column:
    """0.68 of the weighted share of query tokens in the text, up to 0.32 for aliases, up to 0.18 for the closest word where not all are there. A token that is no word of the text weighs 1 + ln 2, else 1."""
    if not query_tokens:
        return F.lit(0.0)
    n, t = F.col(norm), F.col(tokens)
    weight = lambda w: F.when(F.array_contains(t, w), 1.0).otherwise(1.0 + F.log(F.lit(2.0)))
    hit = lambda w: F.array_contains(t, w) | n.contains(w)
    share = sum((F.when(hit(w), weight(w)).otherwise(0.0) for w in query_tokens), F.lit(0.0)) / sum((weight(w) for w in query_tokens), F.lit(0.0))
    alias = F.least(F.lit(0.32), 0.12 * sum((n.contains(a).cast("int") for a in aliases), F.lit(0)))
    close = F.greatest(F.lit(0.0), *[_closest(t, w) for w in query_tokens])
    fuzzy = F.when((share < 0.99) & (close >= 0.42), F.least(F.lit(0.18), close * 0.22)).otherwise(0.0)
    return F.when(n == "", 0.0).otherwise(F.round(F.least(F.lit(1.0), 0.68 * share + alias + fuzzy), 4))


def _closest(tokens: Column, word: str) -> Column:
    return F.coalesce(F.array_max(F.transform(F.array_distinct(tokens), lambda c: _gram_share(F.lit(word), c))), F.lit(0.0))


def _gram_share(a: Column, b: Column) -> Column:
    """Trigram similarity of two normalized words."""
    x, y = tx.trigrams(a), tx.trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def unit_role(role: Column) -> Column:
    """The role of a unit; none and mere context count as an incident."""
    r = F.trim(F.coalesce(role, F.lit("")))
    return F.when((r == "") | (r == "narrative_context"), "narrative_incident").otherwise(r)


def alignment(topics: list[str], central: Column, secondary: Column) -> tuple[Column, Column]:
    """How many query topics are among the central ones, and how many among the secondary ones only."""
    inner, outer = F.coalesce(central, F.array().cast("array<string>")), F.coalesce(secondary, F.array().cast("array<string>"))
    direct = sum((F.array_contains(inner, t).cast("int") for t in topics), F.lit(0))
    aside = sum(((F.array_contains(outer, t) & ~F.array_contains(inner, t)).cast("int") for t in topics), F.lit(0))
    return direct, aside


def unit_centrality(direct: Column, aside: Column, directness: Column, answerability: Column, builder: Column, overlap: Column, role: Column) -> Column:
    """Weighted centrality of a unit for a topic, between 0 and 1; an incident that is not about the topic itself loses a tenth."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    signal = F.when(direct > 0, 1.0).when(aside > 0, 0.58).otherwise(0.0)
    value = 0.46 * signal + 0.22 * unit(directness) + 0.14 * unit(answerability) + 0.12 * unit(builder) + 0.06 * unit(overlap)
    value = value - F.when((role == "narrative_incident") & (signal < 1.0), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(value, 3)))


def unit_candidates(units: DataFrame, unit: str, parent: str, text: str, summary: str, query_tokens: list[str], topics: list[str], builder: Column, limit: int, keep: Column | None = None) -> DataFrame:
    """Guidance units as candidates for a query: filtered, scored by eight terms, above the floor, the best unit of each parent, the best parents.

    Units need the columns ``central_concept_ids``, ``secondary_concept_ids``, ``directness_score``, ``answerability_score``, ``narrative_penalty`` and ``guidance_role``. NULL scores count as 0, NULL texts as empty.
    """
    u = units.where(keep) if keep is not None else units
    words = lambda c: F.regexp_extract_all(F.lower(tx.text_or_empty(F.col(c))), F.lit("([a-z']+)"), 1)
    direct, aside = alignment(topics, F.col("central_concept_ids"), F.col("secondary_concept_ids"))
    u = u.withColumn("_words", F.array_distinct(F.concat(words(text), words(summary)))).withColumn("_norm", tx.normalize_search(F.concat_ws(" ", text, summary))).withColumn("_tokens", tx.normalized_tokens(F.col("_norm")))
    held = sum((F.array_contains("_words", w).cast("int") for w in query_tokens), F.lit(0)) / max(1, len(query_tokens))
    u = u.withColumn("overlap", F.least(F.lit(1.0), held)).withColumn("direct", direct).withColumn("aside", aside).withColumn("role", unit_role(F.col("guidance_role"))).withColumn("_b", builder)
    u = u.withColumn("central", unit_centrality(F.col("direct"), F.col("aside"), F.col("directness_score"), F.col("answerability_score"), F.col("_b"), F.col("overlap"), F.col("role")))
    u = u.where((F.col("direct") > 0) | (F.col("aside") > 0) | (F.col("overlap") >= 0.34)) if topics else u
    u = u.withColumn("semantic", text_match("_norm", "_tokens", query_tokens, topics))
    unit_ = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))))
    score = 0.28 * F.col("central") + 0.12 * F.col("overlap") + 0.18 * F.col("semantic") + 0.12 * retrieval.fuse_scores(F.col("overlap"), F.col("semantic"), 0.28) + 0.16 * unit_("answerability_score") + 0.14 * unit_("_b") - 0.18 * unit_("narrative_penalty")
    u = u.withColumn("_s", score).where((F.col("_s") >= 0.24) & ~((F.col("role") == "narrative_incident") & (F.col("direct") == 0) & (F.col("semantic") < 0.24) & (F.col("_s") < 0.58)))
    u = cut(u.select(unit, parent, F.round("_s", 4).alias("score"), "central", F.coalesce("answerability_score", F.lit(0.0)).alias("answer"), F.coalesce("narrative_penalty", F.lit(0.0)).alias("penalty")))
    order = (F.col("score").desc(), F.col("central").desc(), F.col("answer").desc(), "penalty")
    one = fusion.keep_first(u, [parent], *order, unit)
    return one.orderBy(*order, parent).limit(limit)


def evidence_gate(central: Column, answer: Column, incidental: Column, narrative: Column, general: Column) -> Column:
    """NULL when a candidate is good evidence, else the first of four thresholds it misses. A missing answerability is its centrality, other missing signals count as 0; the last threshold is for general questions."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    c, a = zero(central), F.coalesce(answer.cast("double"), zero(central))
    return F.when(c < 0.42, "centrality").when(a < 0.48, "answerability").when(zero(incidental) > 0.45, "incidental").when(general & (zero(narrative) > 0.78), "narrative")
