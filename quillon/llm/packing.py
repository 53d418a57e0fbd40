"""Packing items of varying size into containers of one capacity, by hierarchical residual packing.

Every partition packs its own items best-fit (largest first), ``at_once`` at a time. Containers that are nearly full are done; the others go on as items of their content's size. Partitions of
underfull containers are then merged in a tree, ``fan_in`` at a time, and packed best-fit again, until one partition is left. Only an item above the capacity is divided: into full
containers of its own and a remainder that is packed like any item.

What moves between rounds is one row per underfull container, a few per partition and round, never the items. The placed items are written to the shared folder once, so a lost
executor repeats at most the last round. Where so many containers stay open that a group of the tree would hold more than ``at_once``, the last round works on the histogram of their fills, which has
at most ``capacity`` entries: the plan says how many containers of which fill go together, and the containers find their place by their rank among those of their fill. No task holds a group then.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.materialize import cut


def best_fit(items: list[tuple[int, int]], capacity: int) -> list[tuple[int, list[int]]]:
    """Best-fit decreasing: ``(fill, positions in items)`` of each container. ``items`` are ``(size, id)``, ties go by id."""
    order = sorted(range(len(items)), key=lambda i: (-items[i][0], items[i][1]))
    room: list[tuple[int, int]] = []  # (free space, container), sorted
    bins: list[tuple[int, list[int]]] = []
    for i in order:
        size = items[i][0]
        at = bisect.bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b] = (bins[b][0] + size, bins[b][1])
            bins[b][1].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append((size, [i]))
        bisect.insort(room, (free - size, b))
    return bins


def _place(capacity: int, at_once: int):
    """First round: the items of a partition to containers named after their least ``(key, chunk)``."""

    def packed(keys: list[int], sizes: list[int]) -> pd.DataFrame:
        chunks: list[tuple[int, int, int]] = []  # key, chunk, size
        for k, s in zip(keys, sizes):
            full, rest = divmod(int(s), capacity)
            chunks += [(k, c, capacity) for c in range(full)]
            if rest or not full:
                chunks.append((k, full, rest))
        chunks.sort()
        names = {}
        for fill, inside in best_fit([(c[2], i) for i, c in enumerate(chunks)], capacity):
            first = min(inside)
            for i in inside:
                names[i] = (f"{chunks[first][0]}.{chunks[first][1]}", fill)
        return pd.DataFrame([(*c, *names[i]) for i, c in enumerate(chunks)], columns=["key", "chunk", "size", "bin", "fill"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys: list[int] = []
        sizes: list[int] = []
        for pdf in batches:
            keys += pdf["key"].tolist()
            sizes += pdf["size"].tolist()
            while len(keys) >= at_once:
                yield packed(keys[:at_once], sizes[:at_once])
                del keys[:at_once], sizes[:at_once]
        if keys:
            yield packed(keys, sizes)

    return run


def _merge(capacity: int):
    """A later round: underfull containers of one group to joint ones. The names of joint containers are those of their first member."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["bin"], pdf["fill"]))
        out = []
        for fill, inside in best_fit([(f, i) for i, (_, f) in enumerate(rows)], capacity):
            first = rows[min(inside)][0]
            out += [(rows[i][0], first, fill) for i in inside]
        return pd.DataFrame(out, columns=["bin", "into", "total"])

    return run


def plan_by_fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing on a histogram of fills: ``(fill, first rank, number, first container, per container)``.

    Among the containers of one fill, those of ranks ``first rank`` to ``first rank + number - 1`` go to the containers from ``first container`` on, ``per container`` to each. It is what
    :func:`best_fit` does one by one, for runs of equal items at once: the tightest container takes as many of them as fit, then the next one of its kind.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # free space -> runs of containers (first, number)
    made = 0

    def put(free: int, first: int, number: int) -> None:
        if number:
            open_.setdefault(free, []).append((first, number))

    for fill in sorted(counts, reverse=True):
        rank, left = 0, counts[fill]
        while left:
            free = min((f for f in open_ if f >= fill), default=None)
            if free is None:
                free, first, number = capacity, made, left
            else:
                first, number = open_[free].pop()
                if not open_[free]:
                    del open_[free]
            per = free // fill if fill else left
            whole = min(number, left // per)
            if whole:
                plan.append((fill, rank, whole * per, first, per))
                put(free - per * fill, first, whole)
                rank, left = rank + whole * per, left - whole * per
            used = whole
            if left and whole < number:
                plan.append((fill, rank, left, first + whole, left))
                put(free - left * fill, first + whole, 1)
                used, left = whole + 1, 0
            if first == made:
                made += used
            else:
                put(free, first + used, number - used)
    return plan


def _merge_by_fill(under: DataFrame, capacity: int, salts: int = 256) -> DataFrame:
    """One round over all underfull containers at once, ``(bin, into, total)`` as in :func:`_merge`. Only the histogram of fills comes to the driver; ranks within a fill are counted in ``salts`` parts."""
    counts = {r["fill"]: r["n"] for r in under.groupBy("fill").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan = under.sparkSession.createDataFrame(plan_by_fill(counts, capacity), "fill long, at long, number long, first long, per long")
    salted = under.withColumn("salt", F.pmod(F.xxhash64("bin"), F.lit(salts)))
    before = Window.partitionBy("fill").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("fill", "salt").agg(F.count("*").alias("n")).select("fill", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    ranked = salted.withColumn("rn", F.row_number().over(Window.partitionBy("fill", "salt").orderBy("bin"))).join(offsets, ["fill", "salt"])
    ranked = ranked.select("bin", "fill", (F.col("off") + F.col("rn") - 1).alias("rank"))
    placed = ranked.join(plan, "fill").where((F.col("rank") >= F.col("at")) & (F.col("rank") < F.col("at") + F.col("number")))
    placed = cut(placed.select("bin", "fill", (F.col("first") + F.floor((F.col("rank") - F.col("at")) / F.col("per"))).alias("target")))
    joint = placed.groupBy("target").agg(F.min("bin").alias("into"), F.sum("fill").alias("total"))
    return placed.join(joint, "target").select("bin", "into", "total")


def _open_ones(under: DataFrame, capacity: int) -> DataFrame:
    """The containers that fit together with the emptiest other one; the rest can be merged with none. The two least fills are enough to know."""
    low = [r["fill"] for r in under.orderBy("fill").limit(2).collect()]
    if len(low) < 2 or sum(low) > capacity:
        return under.limit(0)
    return under.where(F.col("fill") + low[0] <= capacity)


def pack(sizes: DataFrame, capacity: int, nearly_full: float = 0.98, fan_in: int = 16, at_once: int = 250_000) -> DataFrame:
    """Assignment ``(key, chunk, size, bin, fill)`` of every item of ``sizes(key, size)`` to a container.

    ``chunk`` is 0 for an undivided item. Items of size 0 or NULL size are placed too and take no space. Keys are unique; NULL keys are left out. An empty table gives no rows.
    The partitions of the input are packed as they are. The tree ends at one group, or as soon as no two containers fit together; ``at_once`` bounds what a task holds, not what is merged.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    items = sizes.select(F.col("key").cast("long").alias("key"), F.greatest(F.coalesce(F.col("size"), F.lit(0)).cast("long"), F.lit(0)).alias("size")).where("key IS NOT NULL")
    placed = cut(items.mapInPandas(_place(capacity, at_once), "key long, chunk int, size long, bin string, fill long"))
    least = math.ceil(nearly_full * capacity)
    under = _open_ones(placed.where(F.col("fill") < least).select("bin", "fill").distinct(), capacity)
    moved: DataFrame | None = None
    groups, waiting = placed.rdd.getNumPartitions(), under.count()
    while waiting:
        groups = math.ceil(groups / fan_in)
        if waiting > groups * at_once:
            groups = 1
            step = _merge_by_fill(under, capacity)
        else:
            step = under.groupBy(F.pmod(F.xxhash64("bin"), F.lit(groups)).alias("g")).applyInPandas(_merge(capacity), "bin string, into string, total long")
        step = cut(step)
        if moved is None:
            moved = step
        else:
            nxt = step.select(F.col("bin").alias("into"), F.col("into").alias("into2"), F.col("total").alias("total2"))
            moved = cut(moved.join(nxt, "into", "left").select("bin", F.coalesce("into2", "into").alias("into"), F.coalesce("total2", "total").alias("total")))
        if groups == 1:
            break
        under = _open_ones(step.where(F.col("total") < least).select(F.col("into").alias("bin"), F.col("total").alias("fill")).distinct(), capacity)
        waiting = under.count()
    if moved is None:
        return placed
    return placed.join(moved, "bin", "left").select("key", "chunk", "size", F.coalesce("into", "bin").alias("bin"), F.coalesce("total", "fill").alias("fill"))
