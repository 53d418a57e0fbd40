"""Resolving names and slugs by levels of tolerance, and collecting results in passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import fusion


def _name_forms(name: Column) -> list[Column]:
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(tx.text_or_empty(name)), r"[^a-z0-9 \-]+", ""), r"\s+", " "))
    return [plain.alias("_plain"), F.replace(plain, F.lit(" "), F.lit("-")).alias("_hyphen"), tx.compact(name).alias("_compact"), tx.name_skeleton(name).alias("_skeleton")]


def resolve_names(queries: DataFrame, query_key: str, name: Column, known: DataFrame, known_key: str, known_name: Column) -> DataFrame:
    """The known name a written name stands for: ``(query_id, key, level)``.

    Levels: 1 the same without case and signs, 2 with hyphens for spaces, 3 letters and digits only, 4 the same skeleton if only one name has it, 5 the nearest skeleton within the edits its length allows, if only
    one name is nearest (names of five letters or more and at most four words). The first level that finds one decides; the least key on levels 1 to 3. Empty and unknown names give no row.
    Names are compared at level 5 only with names of a length that the edits can bridge, whatever letters they begin with.
    """
    q = queries.select(F.col(query_key).alias("query_id"), *_name_forms(name)).where("_compact <> ''")
    k = known.select(F.col(known_key).alias("key"), *_name_forms(known_name)).where("_compact <> ''")
    level = lambda i, left, right, unique=False: _level(q.select("query_id", F.col(left).alias("_f")), k.select("key", F.col(right).alias("_f")), i, unique)
    exact = [level(1, "_plain", "_plain"), level(2, "_hyphen", "_plain"), level(3, "_compact", "_compact"), level(4, "_skeleton", "_skeleton", True)]
    far = q.where((F.length("_compact") >= 5) & (F.size(tx.words(F.col("_plain"))) <= 4)).select("query_id", "_skeleton", F.explode(F.sequence(F.greatest(F.lit(1), F.length("_skeleton") - 3), F.length("_skeleton") + 3)).alias("_n"))
    met = far.join(k.select("key", F.col("_skeleton").alias("_s")).withColumn("_n", F.length("_s")), "_n")
    near = met.withColumn("_d", F.levenshtein("_skeleton", "_s")).where(F.col("_d") <= tx.allowed_distance(F.greatest(F.length("_skeleton"), F.length("_s"))))
    best = near.withColumn("_r", F.rank().over(Window.partitionBy("query_id").orderBy("_d"))).where("_r = 1").groupBy("query_id").agg(F.min("key").alias("key"), F.count("*").alias("_c")).where("_c = 1")
    rows = reduce(DataFrame.unionByName, [*exact, best.select("query_id", "key", F.lit(5).alias("level"))])
    return fusion.keep_first(rows, ["query_id"], "level")


def _level(q: DataFrame, k: DataFrame, level: int, unique: bool) -> DataFrame:
    of = k.groupBy("_f").agg(F.min("key").alias("key"), F.count_distinct("key").alias("_c"))
    return q.join(of.where("_c = 1") if unique else of, "_f").select("query_id", "key", F.lit(level).alias("level"))


def resolve_slugs(raw: DataFrame, slug: str, known: DataFrame, known_slug: str, sep: str = ".") -> DataFrame:
    """A valid slug for a written one: ``(slug, resolved, layer)``; NULL where no layer finds any.

    Layers: 1 it is valid, 2 the longest ending that belongs to one valid slug only, 3 ``family.area.general``, 4 the only slug of that family and area, 5 the only one there that ends in ``_general``, 6 ``other`` or ``others`` there.
    """
    quoted = "\\" + sep
    k = known.select(F.col(known_slug).alias("_k")).where("_k IS NOT NULL").distinct().withColumn("_p", F.split("_k", quoted))
    r = raw.select(F.col(slug).alias("slug")).where("slug IS NOT NULL").distinct().withColumn("_p", F.split("slug", quoted))
    endings = lambda least: F.transform(F.sequence(F.lit(least), F.greatest(F.lit(least), F.size("_p"))), lambda i: F.array_join(F.slice("_p", i, F.size("_p")), sep))
    suffix = k.select("_k", F.explode(F.array_distinct(endings(1))).alias("_e")).groupBy("_e").agg(F.count("*").alias("_c"), F.min("_k").alias("_k")).where("_c = 1")
    tails = r.where(F.size("_p") > 1).select("slug", F.posexplode(endings(2)).alias("_i", "_e")).join(suffix, "_e")
    area = lambda d: F.when(F.size("_p") >= 2, F.array_join(F.slice("_p", 1, 2), sep))
    two = k.withColumn("_a", area(k)).where("_a IS NOT NULL").where(F.size("_p") > 2)
    leaf = F.element_at("_p", -1)
    general = F.when(leaf.endswith("_general"), F.col("_k"))
    places = two.groupBy("_a").agg(
        F.min(F.when((F.size("_p") == 3) & (leaf == "general"), F.col("_k"))).alias("l3"), F.when(F.count("*") == 1, F.min("_k")).alias("l4"), F.when(F.count(general) == 1, F.min(general)).alias("l5"),
        F.coalesce(F.min(F.when((F.size("_p") == 3) & (leaf == "other"), F.col("_k"))), F.min(F.when((F.size("_p") == 3) & (leaf == "others"), F.col("_k")))).alias("l6"),
    )
    ends = tails.groupBy("slug").agg(F.min_by("_k", "_i").alias("l2"))
    rows = r.withColumn("_a", area(r)).join(k.select(F.col("_k").alias("l1")), F.col("slug") == F.col("l1"), "left").join(ends, "slug", "left").join(places, "_a", "left")
    layer = F.coalesce(*[F.when(F.col(f"l{i}").isNotNull(), i) for i in range(1, 7)])
    return rows.select("slug", F.coalesce(*[f"l{i}" for i in range(1, 7)]).alias("resolved"), layer.alias("layer"))


def collect_in_passes(candidates: DataFrame, query: list[str], key: str, rank: str, passes: list[tuple[str, Column]], limit: int, excluded: DataFrame | None = None) -> DataFrame:
    """Per query the first ``limit`` results when the passes are gone through one after the other, each over the candidates in rank order.

    A result is taken once, by the first pass it qualifies for (``kind``). ``excluded(*query, key)`` are taken already. Ranks are unique in a query; a NULL test does not hold.
    """
    kind = F.coalesce(*[F.when(test, F.lit(i)) for i, (_, test) in enumerate(passes)])
    rows = candidates.withColumn("_pass", kind).where("_pass IS NOT NULL")
    if excluded is not None:
        rows = rows.join(excluded.select(*query, key).distinct(), [*query, key], "left_anti")
    once = fusion.keep_first(rows.withColumnRenamed(rank, "_rank"), [*query, key], "_pass", "_rank")
    best = fusion.top_k(once, query, limit, "_pass", "_rank")
    names = F.array(*[F.lit(n) for n, _ in passes])
    return best.withColumn("kind", F.get(names, F.col("_pass"))).drop("_pass", "_rank")
