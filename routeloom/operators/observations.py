"""Vehicle polls and what follows from them: passages, gaps, regressions, evidence.

Classification of two consecutive polls of one vehicle, in this order: a falling order is a
REGRESSION; time that does not advance a DATA_GAP (NON_MONOTONIC_CAPTURE_TIME); one stop further
within the time limit a PASSAGE; more than one stop a DATA_GAP (NODE_ORDER_JUMP); a changed stop,
too late ones included, NODE_ORDER_COLLISION; else more time than allowed OBSERVATION_TIME_GAP.
Polls that show nothing new give no event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VEHICLE = ["route_id", "vehicle_no"]
MAX_GAP_S = 900


def classify(delta: Column, elapsed_us: Column, moved: Column, max_gap_s: int) -> tuple[Column, Column]:
    """(status, reason); both null where there is no event."""
    late = elapsed_us > max_gap_s * 1_000_000
    reason = (
        F.when(delta < 0, "NODE_ORDER_REGRESSION").when(elapsed_us <= 0, "NON_MONOTONIC_CAPTURE_TIME").when((delta == 1) & ~late, F.lit(None).cast("string"))
        .when(delta > 1, "NODE_ORDER_JUMP").when(moved, "NODE_ORDER_COLLISION").when(late, "OBSERVATION_TIME_GAP")
    )
    status = F.when(delta < 0, "REGRESSION").when(elapsed_us <= 0, "DATA_GAP").when((delta == 1) & ~late, "PASSAGE").when(reason.isNotNull(), "DATA_GAP")
    return status, reason


def passages(polls: DataFrame, max_gap_s: int = MAX_GAP_S) -> DataFrame:
    """Events of polls that arrive in order of time, then id. A vehicle's polls meet in one task,
    as its state does; the key is route and vehicle, so no group grows with the fleet."""
    w = Window.partitionBy(*VEHICLE).orderBy("observed_at", "poll_id")
    df = polls.withColumn("from_order", F.lag("node_order").over(w)).withColumn("observed_from", F.lag("observed_at").over(w)).where("observed_from is not null")
    delta = F.col("node_order") - F.col("from_order")
    elapsed = F.unix_micros("observed_at") - F.unix_micros("observed_from")
    status, reason = classify(delta, elapsed, F.col("node_order") != F.col("from_order"), max_gap_s)
    return df.withColumn("status", status).withColumn("gap_reason", reason).where("status is not null")


def passages_by_arrival(polls: DataFrame, max_gap_s: int = MAX_GAP_S) -> DataFrame:
    """As above for polls in arrival order (arrival_seq): compared is the latest of those that came before."""
    w = Window.partitionBy(*VEHICLE).orderBy("arrival_seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct("observed_at", "arrival_seq", "node_order")).over(w)
    df = polls.withColumn("_l", last).where("_l is not null")
    df = df.withColumn("from_order", F.col("_l.node_order")).withColumn("observed_from", F.col("_l.observed_at")).drop("_l")
    status, reason = classify(F.col("node_order") - F.col("from_order"), F.unix_micros("observed_at") - F.unix_micros("observed_from"), F.col("node_order") != F.col("from_order"), max_gap_s)
    return df.withColumn("status", status).withColumn("gap_reason", reason).where("status is not null")


def history(snapshots: DataFrame, filters: dict, start: Column | None, end: Column | None, at: str, key: str, limit: int) -> DataFrame:
    """Newest first; every filter is optional."""
    for c, v in filters.items():
        if v is not None:
            snapshots = snapshots.where(F.col(c) == v)
    if start is not None:
        snapshots = snapshots.where(F.col(at) >= start)
    if end is not None:
        snapshots = snapshots.where(F.col(at) < end)
    return snapshots.orderBy(F.col(at).desc(), F.col(key).desc()).limit(limit)


def service_evidence(arrivals: DataFrame, positions: DataFrame, official: Column) -> DataFrame:
    """By route over both kinds of observation: counts, official share, days, first and last."""
    both = arrivals.select("route_id", "source", "observed_at").unionAll(positions.select("route_id", "source", "observed_at"))
    return both.groupBy("route_id").agg(F.count("*").alias("observations"), F.count_if(official).alias("official"), F.count_distinct(F.to_date("observed_at")).alias("days"), F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"))


def passage_evidence(events: DataFrame) -> DataFrame:
    by = events.groupBy("route_id").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PASSAGE", "DATA_GAP", "REGRESSION")], F.count_distinct(F.to_date("observed_at")).alias("days"))
    whole = F.col("passage") + F.col("data_gap") + F.col("regression")
    return by.withColumn("passage_ppm", F.floor((F.col("passage") * 2_000_000 + whole) / (whole * 2)).cast("long"))


def deduped(polls: DataFrame, key: Column) -> DataFrame:
    """One poll of each idempotency key, the first that came."""
    best = polls.withColumn("idempotency_key", key).groupBy("idempotency_key").agg(F.min("poll_id").alias("poll_id"), F.count("*").alias("copies"))
    return best


def conflicts(polls: DataFrame, key: Column, request: Column) -> DataFrame:
    """Keys that came with more than one request."""
    return polls.select(key.alias("idempotency_key"), request.alias("request")).groupBy("idempotency_key").agg(F.count_distinct("request").alias("requests")).where("requests > 1")


def first_by_vehicle(positions: DataFrame) -> DataFrame:
    """Of one snapshot's repeated vehicles the first in the list."""
    return positions.groupBy("snapshot_id", *VEHICLE).agg(F.min_by(F.struct("node_order", "observed_at"), "ordinal").alias("x")).select("snapshot_id", *VEHICLE, "x.*")


def object_or_list(text: Column, item: str) -> Column:
    """Items of JSON in which one object stands for a list of one; empty text is no item."""
    return F.coalesce(F.from_json(text, f"array<{item}>"), F.filter(F.array(F.from_json(text, item)), lambda x: x.isNotNull()), F.array())
