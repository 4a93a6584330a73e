"""Queries over the catalog: summaries, pointer joins, normalised answers, probes, service-day clocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import graph, normalise, sequence
from ..operators import catalog as ops
from .. import storage
from ..sources import tables
from .registry import POLLS, ROUTES, SEQ, STOPS, distance, query

STEP = distance("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude", 6_371_008.8)
COUNTERS = {
    "negative_order_rows": "node_order < 0", "edges": "step IS NOT NULL", "non_increasing_edges": "step <= 0", "order_gap_edges": "step > 1", "boundary_gap_edges": "step > 1 AND turned", "same_direction_gap_edges": "step > 1 AND NOT turned",
    "self_loop_edges": "node_id = last_node", "direction_change_edges": "turned", "repeated_node_rows": "k > 1", "blank_direction_rows": "direction = ''",
    "missing_coordinate_rows": "latitude IS NULL AND longitude IS NULL", "partial_coordinate_rows": "(latitude IS NULL) <> (longitude IS NULL)", "out_of_range_rows": "latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180",
    **{f"segments_over_{k}km": f"metres > {k * 1000}" for k in (5, 20)}, **{f"boundaries_over_{m}m": f"turned AND metres > {m}" for m in (300, 1000, 5000)},
}


@query(f"""WITH {SEQ}, f AS (SELECT *, node_order - lag(node_order) OVER w AS step, lag(node_id) OVER w AS last_node, coalesce(direction <> '' AND lag(direction) OVER w <> '' AND direction <> lag(direction) OVER w, false) AS turned, {STEP} AS metres,
row_number() OVER (PARTITION BY route_id, node_id ORDER BY pos) AS k FROM seq WINDOW w AS (PARTITION BY route_id ORDER BY pos))
SELECT count(DISTINCT route_id) AS sequences, count(*) AS rows, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in COUNTERS.items())} FROM f""")
def seq_validator_counters(spark, d):
    return sequence.validator_counters(tables.sequences(spark, d))


@query(f"""WITH {SEQ}, a AS (SELECT o_orderkey AS route_id, 1 AS from_pos, 1 + o_orderkey % 4 AS to_pos FROM orders WHERE o_orderstatus = 'P') SELECT a.route_id, CAST(pos AS BIGINT) AS pos, node_id FROM a JOIN seq ON seq.route_id = a.route_id AND pos BETWEEN from_pos AND to_pos""")
def ride_segment_stops(spark, d):
    asked = tables.routes(spark, d).where("status = 'P'").select("route_id", F.lit(1).alias("from_pos"), (1 + F.col("route_id") % 4).alias("to_pos"))
    return sequence.between_orders(tables.sequences(spark, d), asked).select("route_id", "pos", "node_id")


@query("SELECT 'snapshots' AS store, count(*) AS rows FROM orders UNION ALL SELECT 'observations', count(*) FROM lineitem UNION ALL SELECT 'positions', count(*) FROM events UNION ALL SELECT 'passages', count(*) FROM part UNION ALL SELECT 'catalog', count(*) FROM customer UNION ALL SELECT 'mappings', count(*) FROM supplier")
def store_counts(spark, d):
    names = {"snapshots": "orders", "observations": "lineitem", "positions": "events", "passages": "part", "catalog": "customer", "mappings": "supplier"}
    return ops.store_counts({k: tables.table(spark, d, v) for k, v in names.items()})


VERSIONS = f"{ROUTES}, v AS (SELECT route_id, city_code, priority AS source, captured_at FROM routes), act AS (SELECT max(route_id) AS route_id FROM v GROUP BY city_code, source, CAST(captured_at AS DATE))"


def _pointer(spark, d):
    """Versions and pointers: of the routes of a city, source and day the last one is active."""
    v = tables.routes(spark, d).select("route_id", "city_code", F.col("priority").alias("source"), "captured_at")
    return v, v.groupBy("city_code", "source", F.to_date("captured_at")).agg(F.max("route_id").alias("route_id")).select("route_id")


@query(f"""WITH {VERSIONS}, {SEQ} SELECT count(DISTINCT v.route_id) AS active_route_sequences, count(*) AS directed_stop_rows, count(DISTINCT (city_code, node_id)) AS unique_graph_stops, count(DISTINCT city_code) AS city_count, count(DISTINCT source) AS source_count, count(*) > 0 AS graph_ready FROM act JOIN v USING (route_id) JOIN seq USING (route_id)""")
def active_topology_summary(spark, d):
    v, active = _pointer(spark, d)
    return ops.topology_summary(ops.active_rows(active, v, tables.sequence_rows(spark, d), "route_id"))


@query(f"""WITH {VERSIONS}, {SEQ} SELECT seq.route_id, CAST(city_code AS BIGINT) AS city_code, source, CAST(pos AS BIGINT) AS pos, node_id FROM act JOIN v USING (route_id) JOIN seq USING (route_id)""")
def pointer_version_stops(spark, d):
    v, active = _pointer(spark, d)
    return ops.active_rows(active, v, tables.sequences(spark, d), "route_id").select("route_id", "city_code", "source", "pos", "node_id")


@query(f"""WITH {ROUTES}, t AS (SELECT c_custkey AS k, c_name AS label FROM customer WHERE c_mktsegment = 'BUILDING') SELECT r.route_id, coalesce(label, 'route ' || r.route_id) AS label FROM routes r LEFT JOIN t ON t.k = r.route_id % 1000""")
def sequence_target_labels(spark, d):
    t = tables.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label"))
    return ops.labelled(tables.routes(spark, d).select("route_id", (F.col("route_id") % 1000).alias("k")), t, "k", F.concat(F.lit("route "), F.col("route_id").cast("string"))).select("route_id", "label")


@query(f"""WITH {ROUTES}, p AS (SELECT CASE WHEN city_code = 0 THEN 'cities' ELSE 'routes:' || city_code END AS scope, bool_and(status <> 'F' OR route_id % 50 <> 0) AS done FROM routes GROUP BY 1)
SELECT count(*) FILTER (scope LIKE 'routes:%') AS route_scopes, count(*) FILTER (scope LIKE 'routes:%' AND done) AS complete_route_scopes, coalesce(bool_or(scope = 'cities' AND done), false) AS cities_complete,
  CAST((SELECT count(*) FROM nation) AS BIGINT) AS cities, coalesce(bool_or(scope = 'cities' AND done), false) AND (SELECT count(*) FROM nation) > 0 AND count(*) FILTER (scope LIKE 'routes:%') = (SELECT count(*) FROM nation) AND count(*) FILTER (scope LIKE 'routes:%' AND done) = (SELECT count(*) FROM nation) AS complete FROM p""")
def discovery_completeness(spark, d):
    r = tables.routes(spark, d)
    scope = F.when(F.col("city_code") == 0, "cities").otherwise(F.concat(F.lit("routes:"), F.col("city_code").cast("string")))
    p = r.groupBy(scope.alias("scope")).agg(F.bool_and((F.col("status") != "F") | (F.col("route_id") % 50 != 0)).alias("done"))
    return ops.discovery(p, tables.table(spark, d, "nation"))


@query(f"""WITH {POLLS} SELECT poll_id, vehicle_no, CAST(node_order AS BIGINT) AS node_order FROM polls WHERE route_id = 'view' AND CAST(observed_at AS DATE) = DATE '2024-01-05' ORDER BY observed_at, poll_id LIMIT 1000""")
def replay_events(spark, d):
    p = tables.polls(spark, d).where((F.col("route_id") == "view") & (F.to_date("observed_at") == F.lit("2024-01-05").cast("date")))
    return ops.oldest_first(p, "observed_at", "poll_id", 1000).select("poll_id", "vehicle_no", "node_order")


@query(f"""WITH {POLLS} SELECT poll_id, CAST(floor(value * 60) AS BIGINT) AS arrival_seconds FROM polls WHERE route_id = 'click' AND vehicle_no % 4 <> 0 ORDER BY observed_at DESC, poll_id DESC LIMIT 5000""")
def delay_observations(spark, d):
    p = tables.polls(spark, d).where("route_id = 'click'").withColumn("arrival_seconds", F.when(F.col("vehicle_no") % 4 != 0, F.floor(F.col("value") * 60)))
    return ops.delay_observations(p, "arrival_seconds", "observed_at", "poll_id", 5000).select("poll_id", "arrival_seconds")


@query(f"""WITH {STOPS} SELECT node_name, count(*) AS n, CASE WHEN count(*) = 1 THEN 'unique' ELSE 'ambiguous' END AS probe, CASE WHEN count(*) = 1 THEN min(node_id) END AS node_id FROM stops GROUP BY 1""")
def uniqueness_probe(spark, d):
    return ops.unique_targets(tables.stops(spark, d), "node_name", "node_id")


@query("SELECT c_nationkey AS city_code, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS sources FROM customer GROUP BY 1")
def sorted_sources(spark, d):
    return ops.sorted_distinct(tables.table(spark, d, "customer").withColumnRenamed("c_nationkey", "city_code"), "city_code", "c_mktsegment").select("city_code", F.array_join("values", ",").alias("sources"))


@query("""SELECT o_orderkey AS trip_id, day_offset, CAST(o_orderkey % 172800 + day_offset * 86400 AS BIGINT) AS absolute_seconds, strftime(TIMESTAMP '2026-08-30' + to_seconds(o_orderkey % 172800 + day_offset * 86400), '%Y-%m-%dT%H:%M:%S+09:00') AS civil FROM orders, (SELECT CAST(unnest([-1, 0, 1]) AS BIGINT) AS day_offset) o""")
def civil_timeline(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_orderkey") % 172_800).alias("s"))
    t = o.withColumn("day_offset", F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 1)])))
    t = t.withColumn("absolute_seconds", clock.absolute_seconds(F.col("s"), F.col("day_offset")))
    return t.select("trip_id", "day_offset", "absolute_seconds", clock.civil_timestamp(F.lit("2026-08-30").cast("date"), F.col("absolute_seconds")).alias("civil"))


@query("""SELECT o_orderkey AS route_id, strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS operation_date, epoch_us(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS utc_us FROM orders""")
def operation_midnights(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("route_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("operation_date"))
    return o.withColumn("utc_us", F.unix_micros(clock.operation_midnight(F.col("operation_date"))))


ITEMS = """i AS (SELECT event_id, event_id // 20 AS snapshot, json_object('nodeid', 'N' || (event_id % 50), 'vehicleno', CASE WHEN event_id % 23 = 0 THEN '' ELSE ' V' || (user_id % 9) || ' ' END, 'nodeord', CASE WHEN event_id % 17 = 0 THEN 'x' ELSE CAST(event_id % 40 AS VARCHAR) END, 'gpslati', CAST(event_id % 100 AS VARCHAR), 'cityCode', CAST(event_id % 7 AS VARCHAR)) AS item FROM events)"""


def _items(spark, d):
    e = tables.table(spark, d, "events")
    k = F.col("event_id")
    item = F.to_json(F.struct(
        F.concat(F.lit("N"), (k % 50).cast("string")).alias("nodeid"), F.when(k % 23 == 0, "").otherwise(F.concat(F.lit(" V"), (F.col("user_id") % 9).cast("string"), F.lit(" "))).alias("vehicleno"),
        F.when(k % 17 == 0, "x").otherwise((k % 40).cast("string")).alias("nodeord"), (k % 100).cast("string").alias("gpslati"), (k % 7).cast("string").alias("cityCode"),
    ))
    return e.select("event_id", F.floor(k / 20).alias("snapshot"), item.alias("item"))


@query(f"""WITH {ITEMS}, f AS (SELECT event_id, snapshot, json_extract_string(item, '$.nodeid') AS node_id, trim(json_extract_string(item, '$.vehicleno')) AS vehicle_no, TRY_CAST(json_extract_string(item, '$.nodeord') AS INT) AS node_order, CAST(json_extract_string(item, '$.gpslati') AS DOUBLE) AS lat FROM i),
o AS (SELECT *, vehicle_no <> '' AND coalesce(node_order BETWEEN 1 AND 9999, false) AS ok FROM f), g AS (SELECT snapshot, vehicle_no, min(event_id) AS first_id FROM o WHERE ok GROUP BY ALL)
SELECT o.event_id, o.vehicle_no, o.node_id, CAST(node_order AS BIGINT) AS node_order, CASE WHEN lat <= 90 THEN lat END AS latitude, NOT ok OR event_id <> first_id AS dropped FROM o LEFT JOIN g ON g.snapshot = o.snapshot AND g.vehicle_no = o.vehicle_no""")
def normalised_positions(spark, d):
    return normalise.positions(_items(spark, d), "item", "snapshot", "event_id").select("event_id", "vehicle_no", "node_id", "node_order", "latitude", "dropped")


@query(f"""WITH {ITEMS} SELECT event_id, coalesce(json_extract_string(item, '$.citycode'), json_extract_string(item, '$.cityCode')) AS city_code, 'R' || (event_id % 3) AS route_id, json_extract_string(item, '$.nodeid') AS node_id, '' AS node_name, CAST(TRY_CAST(json_extract_string(item, '$.nodeord') AS INT) AS BIGINT) AS node_order FROM i""")
def normalised_catalog(spark, d):
    r = normalise.records(_items(spark, d).drop("snapshot"), "item", "stops", {"route_id": F.concat(F.lit("R"), (F.col("event_id") % 3).cast("string"))})
    return r.select("event_id", "city_code", "route_id", "node_id", "node_name", "node_order")


@query("""SELECT c_custkey, c_name FROM customer WHERE lower(trim(c_mktsegment)) = 'building'""")
def exact_match_retry(spark, d):
    return normalise.accepted(tables.table(spark, d, "customer"), "c_mktsegment", F.lit(" Building ")).select("c_custkey", "c_name")


@query(f"""WITH {SEQ}, f AS (SELECT route_id, pos, {distance("lag(latitude) OVER w", "lag(longitude) OVER w", "latitude", "longitude")} AS m FROM seq WINDOW w AS (PARTITION BY route_id ORDER BY pos)) SELECT route_id, CAST(pos AS BIGINT) AS pos, CAST(CAST(least(round_even(m, 0), 999999) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(least(round_even(m / 7, 0), 999999) AS BIGINT) AS VARCHAR) AS evidence FROM f WHERE m IS NOT NULL""")
def spike_evidence_text(spark, d):
    from ..functions.geo import haversine

    w = Window.partitionBy("route_id").orderBy("pos")
    m = haversine(F.lag("latitude").over(w), F.lag("longitude").over(w), F.col("latitude"), F.col("longitude"))
    s = tables.sequences(spark, d).select("route_id", "pos", m.alias("m")).where("m is not null")
    return s.select("route_id", "pos", normalise.bounded_evidence([F.col("m"), F.col("m") / 7]).alias("evidence"))


@query("""SELECT k, min(v) AS value FROM (SELECT o_custkey AS k, o_orderkey AS v, epoch(CAST(o_orderdate AS TIMESTAMP)) AS t FROM orders) WHERE t > epoch(TIMESTAMP '1997-01-01') - 86400 * 90 AND t <= epoch(TIMESTAMP '1997-01-01') GROUP BY k""")
def cache_fresh_entries(spark, d):
    o = tables.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderdate").cast("timestamp").alias("stored_at"))
    return ops.fresh(o, "stored_at", F.lit("1997-01-01").cast("timestamp"), 90 * 86_400).groupBy("k").agg(F.min("v").alias("value"))


@query(f"""WITH {SEQ}, s AS (SELECT route_id, count(*) AS rows, count(DISTINCT node_id) AS stops, max(node_order) - min(node_order) + 1 <> count(*) AS gap FROM seq GROUP BY 1), t AS (SELECT direction, count(*) AS n FROM seq GROUP BY 1)
SELECT count(*) AS routes, CAST(sum(rows) AS BIGINT) AS rows, count(*) FILTER (gap) AS gap_routes, count(*) FILTER (stops < rows) AS repeat_routes, (SELECT count(DISTINCT node_id) FROM seq) AS stops, (SELECT max(n) FROM t) AS largest_direction FROM s""")
def ingest_summary(spark, d):
    return ops.ingest_summary(tables.sequences(spark, d))


@query()
def components_largest(spark, d):
    c = graph.stop_components(tables.sequences(spark, d), 300, storage.saved)
    return ops.largest_components(c, 10)


@query(f"""WITH {ROUTES}, u AS (SELECT city_code, priority, count(*) AS routes FROM routes GROUP BY ALL) SELECT CAST(city_code AS BIGINT) AS city_code, arg_min(priority, (-routes, priority)) AS name, max(routes) AS n FROM u GROUP BY 1""")
def mode_city_names(spark, d):
    from ..operators import search

    return search.mode(tables.routes(spark, d), "city_code", "priority").select("city_code", F.col("priority").alias("name"), "n")


@query(f"""WITH {STOPS}, {SEQ}, a AS (SELECT DISTINCT p_partkey % 2500 AS node_id FROM part), s AS (SELECT node_id, 0 AS rank, node_name, latitude FROM stops WHERE node_id % 3 <> 0), h AS (SELECT node_id, 1 AS rank, 'stop ' || node_id AS node_name, min(latitude) AS latitude FROM seq GROUP BY ALL),
u AS (SELECT * FROM s UNION ALL SELECT * FROM h), b AS (SELECT node_id, min(rank) AS source_rank, arg_min(node_name, rank) AS node_name FROM u GROUP BY 1) SELECT a.node_id, CAST(source_rank AS BIGINT) AS source_rank, node_name FROM a JOIN b ON b.node_id = a.node_id""")
def planning_stop_reference(spark, d):
    from ..operators import search

    asked = tables.stops(spark, d).select((F.col("node_id") % 2500).alias("node_id")).distinct()
    static = tables.stops(spark, d).where("node_id % 3 <> 0").select("node_id", "node_name")
    hydrated = tables.sequence_rows(spark, d).select("node_id", F.concat(F.lit("stop "), F.col("node_id").cast("string")).alias("node_name")).distinct()
    return search.first_source([static, hydrated], ["node_id"]).join(asked, "node_id").select("node_id", "source_rank", "node_name")
