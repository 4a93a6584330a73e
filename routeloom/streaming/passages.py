"""Passages and windowed counts as Structured Streaming queries.

State is one small row for each vehicle: the latest poll. Polls repeated under one idempotency key
are dropped within the watermark; a late poll is compared with the latest one and gives a DATA_GAP.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUT = "route_id string, vehicle_no long, poll_id long, from_order int, node_order int, status string, gap_reason string"
STATE = "observed_us long, poll_id long, node_order int"


def _event(delta: int, elapsed_us: int, max_gap_s: int) -> tuple[str, str | None] | None:
    late = elapsed_us > max_gap_s * 1_000_000
    if delta < 0:
        return "REGRESSION", "NODE_ORDER_REGRESSION"
    if elapsed_us <= 0:
        return "DATA_GAP", "NON_MONOTONIC_CAPTURE_TIME"
    if delta == 1 and not late:
        return "PASSAGE", None
    if delta > 1:
        return "DATA_GAP", "NODE_ORDER_JUMP"
    if delta:
        return "DATA_GAP", "NODE_ORDER_COLLISION"
    return ("DATA_GAP", "OBSERVATION_TIME_GAP") if late else None


def passages(polls: DataFrame, max_gap_s: int = 900) -> DataFrame:
    """Events of a stream of polls (route_id, vehicle_no, node_order, observed_at, poll_id)."""

    def go(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        route, vehicle = key
        last = state.get if state.exists else None
        pdf = pd.concat(list(frames)).sort_values(["us", "poll_id"])
        out = []
        for us, poll, order in zip(pdf["us"], pdf["poll_id"], pdf["node_order"]):
            if last is not None:
                found = _event(int(order) - last[2], int(us) - last[0], max_gap_s)
                if found:
                    out.append((route, vehicle, int(poll), last[2], int(order), *found))
            if last is None or (us, poll) > (last[0], last[1]):
                last = (int(us), int(poll), int(order))
        state.update(last)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    df = polls.select("route_id", "vehicle_no", "poll_id", "node_order", F.unix_micros("observed_at").alias("us"))
    return df.groupBy("route_id", "vehicle_no").applyInPandasWithState(go, OUT, STATE, "append", "NoTimeout")


def window_counts(polls: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Polls of each route in tumbling windows; late ones count until the watermark passes."""
    w = polls.withWatermark("observed_at", late).groupBy(F.window("observed_at", width), "route_id").agg(F.count("*").alias("polls"))
    return w.select(F.col("window.start").alias("window_start"), "route_id", "polls")


def sessions(polls: DataFrame, gap: str = "900 seconds", late: str = "1 hour") -> DataFrame:
    """Vehicle sessions that end after a gap."""
    w = polls.withWatermark("observed_at", late).groupBy(F.session_window("observed_at", gap), "route_id", "vehicle_no").agg(F.count("*").alias("polls"))
    return w.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "route_id", "vehicle_no", "polls")


def deduped(polls: DataFrame, late: str = "1 hour") -> DataFrame:
    return polls.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["idempotency_key"])


def with_stop_names(polls: DataFrame, stops: DataFrame) -> DataFrame:
    """A stream joined with the static stop list."""
    return polls.join(stops, "node_id", "left")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into a Parquet folder, in append mode, and read that."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
