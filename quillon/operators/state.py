"""Keyed state with expiry, as batch operators over an event history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds after which a stored state expires unless told otherwise.
TTL_SECONDS = 21_600


def latest_state(events: DataFrame, key: str, at: str, tie: str, payload: list[str], now: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """The newest record per key that has not expired at ``now``; a record expires ``ttl_seconds`` after it was made, at that very moment included."""
    alive = events.where((F.col(at) <= now) & (F.unix_micros(at) + ttl_seconds * 1_000_000 > F.unix_micros(now)) & F.col(key).isNotNull())
    row = F.max_by(F.struct(at, *payload), F.struct(at, tie)).alias("_r")
    return alive.groupBy(key).agg(row).select(key, F.col(f"_r.{at}").alias(at), *[F.col(f"_r.{p}").alias(p) for p in payload])


def as_of(requests: DataFrame, states: DataFrame, key: str, at: str, state_at: str, tie: str, payload: list[str], ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Each request with the newest state of its key made before it and not expired then; NULLs where there is none.

    Requests and states of a key are put in one order and the last state is carried forward, so no request meets every state of its key. Requests travel whole, so nothing is joined back. A NULL key has no state.
    """
    blank = [F.lit(None).cast(states.schema[p].dataType).alias(p) for p in payload]
    asked = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    rows = requests.select(F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(states.schema[tie].dataType).alias("_tie"), asked.alias("_r"), F.lit(None).cast("timestamp").alias("_made"), *blank)
    made = states.select(F.col(key).alias("_k"), F.col(state_at).alias("_at"), F.lit(0).alias("_kind"), F.col(tie).alias("_tie"), F.lit(None).cast(rows.schema["_r"].dataType).alias("_r"), F.col(state_at).alias("_made"), *payload)
    rows = rows.unionByName(made)
    order = Window.partitionBy("_k").orderBy("_at", F.col("_kind").desc(), "_tie").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_kind") == 0, F.struct("_made", *payload)), ignorenulls=True).over(order)
    found = rows.withColumn("_s", last).where("_kind = 1")
    fresh = F.unix_micros("_s._made") + ttl_seconds * 1_000_000 > F.unix_micros("_at")
    found = found.select("_r", F.when(fresh & F.col("_k").isNotNull(), F.col("_s")).alias("_s"))
    return found.select("_r.*", F.col("_s._made").alias("state_at"), *[F.col(f"_s.{p}").alias(f"state_{p}") for p in payload])


def resolve_state(requests: DataFrame, supplied: Column, by_turn: Column, by_session: Column, followup: Column) -> DataFrame:
    """Which state a request uses: its own, that of its parent turn, that of its session if it follows up, or none."""
    chosen = F.coalesce(supplied, by_turn, F.when(followup, by_session))
    origin = F.when(supplied.isNotNull(), "supplied").when(by_turn.isNotNull(), "parent_turn").when(followup & by_session.isNotNull(), "session").otherwise("none")
    return requests.withColumn("state", chosen).withColumn("state_origin", origin)


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """Extension: sessions of events that are less than ``gap`` apart."""
    return events.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n_events")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events")
