"""Queries by name with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Common table expressions over the driver's tables, as routeloom.sources.tables defines them.
ROUTES = """routes AS (SELECT o_orderkey AS route_id, c_nationkey AS city_code, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS captured_at, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey)"""
STOPS = """stops AS (SELECT p_partkey AS node_id, p_name AS node_name, p_brand AS city_name, p_size,
  CASE WHEN p_partkey % 97 <> 0 THEN CAST(36 AS DOUBLE) + CAST(p_partkey * 37 % 400 AS DOUBLE) / 1000 END AS latitude,
  CASE WHEN p_partkey % 97 <> 0 THEN CAST(127 AS DOUBLE) + CAST(p_partkey * 61 % 400 AS DOUBLE) / 1000 END AS longitude FROM part)"""
SEQ = """seq AS (SELECT l_orderkey AS route_id, l_partkey AS node_id, l_linenumber AS node_order, l_suppkey AS tie,
  CASE WHEN l_suppkey % 11 = 0 THEN '' ELSE l_linestatus END AS direction, l_returnflag <> 'R' AS can_board, l_returnflag <> 'A' AS can_alight,
  CASE WHEN l_partkey % 97 <> 0 THEN CAST(36 AS DOUBLE) + CAST(l_partkey * 37 % 400 AS DOUBLE) / 1000 END AS latitude,
  CASE WHEN l_partkey % 97 <> 0 THEN CAST(127 AS DOUBLE) + CAST(l_partkey * 61 % 400 AS DOUBLE) / 1000 END AS longitude,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS pos FROM lineitem)"""
SEGMENTS = """bounds AS (SELECT *, coalesce(lag(direction) OVER w <> '' AND direction <> '' AND lag(direction) OVER w <> direction, false) AS cut FROM seq WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
segments AS (SELECT *, CAST(sum(CAST(cut AS INT)) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_id FROM bounds)"""
POLLS = """polls AS (SELECT event_type AS route_id, user_id AS vehicle_no, CAST(floor(value) % 12 + 1 AS INT) AS node_order, ts AS observed_at, event_id AS poll_id, value FROM events)"""
TIMES = """times AS (SELECT l_orderkey AS trip_id, l_partkey AS stop_id, l_linenumber AS stop_sequence, l_suppkey AS tie, CAST(l_linenumber * 1800 + l_partkey % 1800 AS BIGINT) AS departure_seconds,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS pickup_type, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS drop_off_type FROM lineitem)"""
TRIPS = """trips AS (SELECT o_orderkey AS trip_id, o_custkey AS route_id, o_orderpriority AS service_id, CAST(o_orderdate AS DATE) AS service_date, o_orderstatus AS status FROM orders)"""
PASSAGES = """lagged AS (SELECT *, lag(node_order) OVER w AS from_order, lag(observed_at) OVER w AS observed_from FROM polls WINDOW w AS (PARTITION BY route_id, vehicle_no ORDER BY observed_at, poll_id)),
deltas AS (SELECT *, node_order - from_order AS delta, epoch_us(observed_at) - epoch_us(observed_from) AS us FROM lagged WHERE observed_from IS NOT NULL),
judged AS (SELECT *, CASE WHEN delta < 0 THEN 'REGRESSION' WHEN us <= 0 THEN 'DATA_GAP' WHEN delta = 1 AND us <= 86400000000 THEN 'PASSAGE' WHEN delta > 1 OR delta <> 0 OR us > 86400000000 THEN 'DATA_GAP' END AS status,
  CASE WHEN delta < 0 THEN 'NODE_ORDER_REGRESSION' WHEN us <= 0 THEN 'NON_MONOTONIC_CAPTURE_TIME' WHEN delta = 1 AND us <= 86400000000 THEN NULL WHEN delta > 1 THEN 'NODE_ORDER_JUMP' WHEN delta <> 0 THEN 'NODE_ORDER_COLLISION' WHEN us > 86400000000 THEN 'OBSERVATION_TIME_GAP' END AS gap_reason FROM deltas),
passages AS (SELECT * FROM judged WHERE status IS NOT NULL)"""


def distance(a_lat: str, a_lon: str, b_lat: str, b_lon: str, radius: float = 6_371_000.0) -> str:
    return f"{2 * radius} * asin(least(1.0, sqrt(pow(sin((radians({b_lat}) - radians({a_lat})) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2))))"


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, fractions as double."""
    return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint", "tinyint") or t.startswith("decimal") else F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return plain(f(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add
