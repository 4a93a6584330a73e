"""Queries over polls, passages, replays, space, schedules and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, geo, text
from ..operators import geometry, graph, journeys, observations, replay, schedule, search, sequence, spatial, versions
from ..sources import tables
from ..streaming import passages as streaming
from .. import storage
from .registry import PASSAGES, POLLS, ROUTES, SEGMENTS, SEQ, STOPS, TIMES, TRIPS, distance, query

DAY_S = 86_400


def _passages(spark, d):
    return observations.passages(tables.polls(spark, d), DAY_S)


EVENT = ("poll_id", "route_id", "vehicle_no", "from_order", "node_order", "status", "gap_reason")


@query(f"WITH {POLLS}, {PASSAGES} SELECT poll_id, route_id, vehicle_no, CAST(from_order AS BIGINT) AS from_order, CAST(node_order AS BIGINT) AS node_order, status, gap_reason FROM passages")
def passages_derive(spark, d):
    return _passages(spark, d).select(*EVENT)


@query(f"""WITH {POLLS}, late AS (SELECT *, poll_id + CASE WHEN poll_id % 10 = 0 THEN 300 ELSE 0 END AS arrival_seq0 FROM polls), a AS (SELECT *, arrival_seq0 * 100000 + poll_id % 100000 AS arrival_seq FROM late),
l AS (SELECT *, max((observed_at, arrival_seq, node_order)) OVER (PARTITION BY route_id, vehicle_no ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a),
s AS (SELECT *, node_order - m[3] AS delta, epoch_us(observed_at) - epoch_us(m[1]) AS us FROM l WHERE m IS NOT NULL),
j AS (SELECT CASE WHEN delta < 0 THEN 'REGRESSION' WHEN us <= 0 THEN 'DATA_GAP' WHEN delta = 1 AND us <= 86400000000 THEN 'PASSAGE' WHEN delta <> 0 OR us > 86400000000 THEN 'DATA_GAP' END AS status, * FROM s)
SELECT poll_id, status FROM j WHERE status IS NOT NULL""")
def passages_late_polls(spark, d):
    p = tables.polls(spark, d)
    seq = (F.col("poll_id") + F.when(F.col("poll_id") % 10 == 0, 300).otherwise(0)) * 100_000 + F.col("poll_id") % 100_000
    return observations.passages_by_arrival(p.withColumn("arrival_seq", seq), DAY_S).select("poll_id", "status")


@query(f"""WITH {POLLS} SELECT poll_id, route_id, vehicle_no, CAST(node_order AS BIGINT) AS node_order FROM polls WHERE route_id = 'click' AND observed_at >= TIMESTAMP '2024-01-03' AND observed_at < TIMESTAMP '2024-01-10' ORDER BY observed_at DESC, poll_id DESC LIMIT 100""")
def history_filter(spark, d):
    h = observations.history(tables.polls(spark, d), {"route_id": "click", "vehicle_no": None}, F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-10").cast("timestamp"), "observed_at", "poll_id", 100)
    return h.select("poll_id", "route_id", "vehicle_no", "node_order")


@query(f"""WITH {POLLS}, {PASSAGES} SELECT poll_id, route_id, vehicle_no, gap_reason FROM passages WHERE status = 'DATA_GAP' AND route_id = 'view' ORDER BY observed_at DESC, poll_id DESC LIMIT 60""")
def passage_filter(spark, d):
    return observations.history(_passages(spark, d), {"status": "DATA_GAP", "route_id": "view"}, None, None, "observed_at", "poll_id", 60).select("poll_id", "route_id", "vehicle_no", "gap_reason")


@query(f"""WITH {POLLS}, u AS (SELECT route_id, observed_at, CASE WHEN vehicle_no % 2 = 0 THEN 'official' ELSE 'fixture' END AS source FROM polls WHERE poll_id % 3 = 0 UNION ALL SELECT route_id, observed_at, 'official' FROM polls WHERE poll_id % 5 = 0)
SELECT route_id, count(*) AS observations, count(*) FILTER (source = 'official') AS official, count(DISTINCT CAST(observed_at AS DATE)) AS days, epoch_us(min(observed_at)) AS first_us, epoch_us(max(observed_at)) AS last_us FROM u GROUP BY route_id""")
def evidence_service(spark, d):
    p = tables.polls(spark, d)
    a = p.where("poll_id % 3 = 0").withColumn("source", F.when(F.col("vehicle_no") % 2 == 0, "official").otherwise("fixture"))
    b = p.where("poll_id % 5 = 0").withColumn("source", F.lit("official"))
    e = observations.service_evidence(a, b, F.col("source") == "official")
    return e.select("route_id", "observations", "official", "days", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"))


@query(f"""WITH {POLLS}, {PASSAGES}, b AS (SELECT route_id, count(*) FILTER (status = 'PASSAGE') AS passage, count(*) FILTER (status = 'DATA_GAP') AS data_gap, count(*) FILTER (status = 'REGRESSION') AS regression, count(DISTINCT CAST(observed_at AS DATE)) AS days, count(*) AS n FROM passages GROUP BY route_id)
SELECT route_id, passage, data_gap, regression, days, (passage * 2000000 + n) // (n * 2) AS passage_ppm FROM b""")
def evidence_passage_ratio(spark, d):
    return observations.passage_evidence(_passages(spark, d))


LEGS = """legs AS (SELECT row_number() OVER (ORDER BY t.r, o.o) AS leg_id, t.r AS route_id, o.o AS node_order, 300 + o.o * 60 AS arrive_min, 300 + o.o * 60 + 45 AS next_min, 5 AS min_transfer FROM (VALUES ('click'), ('view'), ('error'), ('purchase'), ('signup')) t(r), (SELECT unnest(range(2, 13)) AS o) o)"""
EVENTS = """ev AS (SELECT route_id, CAST(observed_at AS DATE) AS service_date, node_order, poll_id AS event_id, status, (epoch_us(observed_at) // 60000000) % 1440 - 10 AS from_min, (epoch_us(observed_at) // 60000000) % 1440 AS to_min FROM passages)"""
MATCH = f"""WITH {POLLS}, {PASSAGES}, {EVENTS}, {LEGS}, p AS (SELECT leg_id, service_date, event_id, from_min, to_min, abs((from_min + to_min) / 2.0 - arrive_min) AS off FROM legs JOIN ev USING (route_id, node_order) WHERE status = 'PASSAGE'),
b AS (SELECT leg_id, service_date, arg_min((event_id, from_min, to_min), (off, event_id)) AS x, count(*) AS candidates FROM p WHERE off <= 120 GROUP BY ALL),
m AS (SELECT legs.leg_id, route_id, service_date, x[1] AS event_id, coalesce(candidates, 0) AS candidates, CASE WHEN x IS NULL THEN 'data_gap' WHEN x[3] <= next_min - min_transfer THEN 'success' WHEN x[2] > next_min - min_transfer THEN 'failure' ELSE 'data_gap' END AS verdict,
  CASE WHEN x IS NULL THEN 'NO_PASSAGE' WHEN x[2] <= next_min - min_transfer AND x[3] > next_min - min_transfer THEN 'PASSAGE_WINDOW_CROSSES_DEADLINE' END AS reason FROM legs JOIN (SELECT DISTINCT route_id, service_date FROM ev) USING (route_id) LEFT JOIN b USING (leg_id, service_date))"""


def _legs(spark):
    rows = [(r, o) for r in ("click", "error", "purchase", "signup", "view") for o in range(2, 13)]
    return spark.createDataFrame([(i + 1, r, o, 300 + o * 60, 345 + o * 60, 5) for i, (r, o) in enumerate(rows)], "leg_id long, route_id string, node_order int, arrive_min int, next_min int, min_transfer int")


def _matches(spark, d):
    minute = F.floor(F.unix_micros("observed_at") / 60_000_000).cast("long") % 1440
    ev = _passages(spark, d).select("route_id", F.to_date("observed_at").alias("service_date"), "node_order", F.col("poll_id").alias("event_id"), "status", (minute - 10).alias("from_min"), minute.alias("to_min"))
    return replay.leg_match(_legs(spark), ev, 120)


@query(f"{MATCH} SELECT leg_id, CAST(service_date AS VARCHAR) AS service_date, event_id, candidates, verdict, reason FROM m")
def replay_leg_match(spark, d):
    return _matches(spark, d).select("leg_id", F.col("service_date").cast("string").alias("service_date"), "event_id", "candidates", "verdict", "reason")


@query(f"""{MATCH}, dd AS (SELECT route_id, service_date, CASE WHEN count(*) FILTER (verdict = 'data_gap') > 0 THEN 'data_gap' WHEN count(*) FILTER (verdict = 'failure') > 0 THEN 'failure' ELSE 'success' END AS v FROM m WHERE event_id IS NOT NULL GROUP BY ALL),
d AS (SELECT service_date, CASE WHEN count(*) FILTER (v = 'data_gap') > 0 THEN 'data_gap' WHEN count(*) FILTER (v = 'failure') > 0 THEN 'failure' ELSE 'success' END AS v FROM dd GROUP BY 1)
SELECT count(*) AS days, count(*) FILTER (v <> 'data_gap') AS eligible, count(*) FILTER (v = 'success') AS successes, CASE WHEN count(*) FILTER (v <> 'data_gap') > 0 THEN CAST(floor(count(*) FILTER (v = 'success') * 1000000 / count(*) FILTER (v <> 'data_gap')) AS BIGINT) END AS success_ppm FROM d""")
def replay_daily_summary(spark, d):
    return replay.summary(replay.daily(_matches(spark, d).where("event_id is not null")))


@query("""WITH delays AS (SELECT CAST(l_linenumber AS BIGINT) AS route_id, CASE WHEN l_linestatus = 'O' THEN 'weekday' ELSE 'weekend' END AS kind, CAST(floor(l_quantity) AS BIGINT) AS delay FROM lineitem),
b AS (SELECT p_partkey AS journey_id, leg, (p_partkey + leg) % 7 + 1 AS route_id, CASE WHEN p_partkey % 7 < 5 THEN 'weekday' ELSE 'weekend' END AS kind, p_size AS budget FROM part, (VALUES (1), (2), (3)) t(leg)),
p AS (SELECT journey_id, leg, count(*) AS n, count(*) FILTER (delay <= budget) AS ok FROM b JOIN delays USING (route_id, kind) GROUP BY ALL)
SELECT journey_id, count(*) AS legs, CAST(floor(product(CAST(ok AS DOUBLE) / n) * 1000000 + 0.5) AS BIGINT) AS success_ppm, CAST(arg_min(leg, (CAST(ok AS DOUBLE) / n, leg)) AS BIGINT) AS weakest_leg FROM p GROUP BY journey_id""")
def simulate_closed_form(spark, d):
    line = tables.table(spark, d, "lineitem")
    delays = line.select(F.col("l_linenumber").cast("long").alias("route_id"), F.when(F.col("l_linestatus") == "O", "weekday").otherwise("weekend").alias("kind"), F.floor("l_quantity").alias("delay"))
    p = tables.table(spark, d, "part").select(F.col("p_partkey").alias("journey_id"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("leg"), F.col("p_size").alias("budget"))
    p = p.select("journey_id", "leg", ((F.col("journey_id") + F.col("leg")) % 7 + 1).alias("route_id"), F.when(F.col("journey_id") % 7 < 5, "weekday").otherwise("weekend").alias("kind"), "budget")
    out = replay.closed_form(p, delays)
    return out.select("journey_id", "legs", F.floor(F.col("success_probability") * 1_000_000 + 0.5).cast("long").alias("success_ppm"), "weakest_leg")


@query(f"""WITH {POLLS}, o AS (SELECT poll_id, (epoch_us(observed_at) // 1000000) % 86400 + CAST(floor(value * 60) AS BIGINT) AS predicted_s, (poll_id * 977) % 86400 AS scheduled_s FROM polls), x AS (SELECT poll_id, predicted_s - scheduled_s AS d FROM o)
SELECT poll_id, CASE WHEN abs(d - 86400) < abs(d) AND abs(d - 86400) <= abs(d + 86400) THEN d - 86400 WHEN abs(d + 86400) < abs(d) OR (abs(d + 86400) = abs(d) AND d > 0) THEN d + 86400 WHEN abs(d - 86400) = abs(d) THEN least(d, d - 86400) ELSE d END AS delay_s FROM x""")
def eta_delay_samples(spark, d):
    p = tables.polls(spark, d)
    sec = F.floor(F.unix_micros("observed_at") / 1_000_000).cast("long") % 86_400
    return replay.delay_samples(p.select("poll_id", (sec + F.floor(F.col("value") * 60)).alias("predicted_s"), (F.col("poll_id") * 977 % 86_400).alias("scheduled_s"))).select("poll_id", "delay_s")


@query("""SELECT sha256(concat_ws(':', event_type, CAST(epoch_us(ts) // 300000000 AS VARCHAR))) AS idempotency_key, min(event_id) AS poll_id, count(*) AS copies FROM events GROUP BY 1""")
def idempotent_dedupe(spark, d):
    p = tables.polls(spark, d)
    return observations.deduped(p, F.sha2(F.concat_ws(":", "route_id", clock.time_bucket(F.col("observed_at"), 300).cast("string")), 256))


@query("""SELECT event_type || ':' || CAST(epoch_us(ts) // 3600000000 AS VARCHAR) AS idempotency_key, count(DISTINCT user_id) AS requests FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1""")
def idempotency_conflicts(spark, d):
    p = tables.polls(spark, d)
    return observations.conflicts(p, F.concat_ws(":", "route_id", clock.time_bucket(F.col("observed_at"), 3600).cast("string")), F.col("vehicle_no"))


@query(f"""WITH {POLLS}, n AS (SELECT CAST(observed_at AS DATE) AS day, row_number() OVER (PARTITION BY CAST(observed_at AS DATE) ORDER BY observed_at, poll_id) AS k FROM polls) SELECT CAST(day AS VARCHAR) AS day, count(*) AS calls, count(*) FILTER (k <= 90) AS reserved FROM n GROUP BY day""")
def daily_quota(spark, d):
    p = tables.polls(spark, d).withColumn("day", F.to_date("observed_at"))
    return versions.daily_quota(p, "day", ["observed_at", "poll_id"], 90).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("calls"), F.count_if("reserved").alias("reserved"))


@query(f"""WITH {POLLS} SELECT CAST(CAST(observed_at + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS civil_day, route_id, count(*) AS polls FROM polls GROUP BY ALL""")
def civil_service_dates(spark, d):
    return tables.polls(spark, d).groupBy(clock.civil_date(F.col("observed_at")).cast("string").alias("civil_day"), "route_id").agg(F.count("*").alias("polls"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_object_or_list(spark, d):
    e = tables.table(spark, d, "events")
    either = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props"))
    return e.select("event_id", F.explode(observations.object_or_list(either, "struct<k:long>")).alias("x")).select("event_id", F.col("x.k").alias("k")).where("k is not null")


# --- space --------------------------------------------------------------------------------------

CITY_SEQ = f"WITH {SEQ}, {ROUTES}, cs AS (SELECT seq.*, city_code FROM seq JOIN routes USING (route_id))"


def _city_rows(spark, d):
    return tables.sequence_rows(spark, d).join(tables.routes(spark, d).select("route_id", "city_code"), "route_id")


@query(f"""{CITY_SEQ}, r AS (SELECT city_code, node_id, route_id, max(CAST(can_alight AS INT)) AS a, max(CAST(can_board AS INT)) AS b FROM cs GROUP BY ALL)
SELECT CAST(x.city_code AS BIGINT) AS city_code, x.node_id, count(*) AS transfers FROM r x JOIN r y ON x.city_code = y.city_code AND x.node_id = y.node_id AND x.route_id <> y.route_id WHERE x.a = 1 AND y.b = 1 GROUP BY x.city_code, x.node_id""")
def transfers_exact(spark, d):
    return spatial.exact_transfers(_city_rows(spark, d)).select("city_code", "node_id", "transfers")


NEAR = distance("a.latitude", "a.longitude", "b.latitude", "b.longitude")


@query(f"""WITH {SEQ}, p AS (SELECT DISTINCT node_id, latitude, longitude FROM seq WHERE latitude IS NOT NULL)
SELECT a.node_id AS from_node, b.node_id AS to_node, CAST(floor({NEAR} + 0.5) AS BIGINT) AS walk_m FROM p a JOIN p b ON b.latitude BETWEEN a.latitude - 0.01 AND a.latitude + 0.01 AND a.node_id <> b.node_id WHERE {NEAR} <= 300""")
def transfers_proximity(spark, d):
    e = spatial.transfer_edges(tables.sequence_rows(spark, d), 300).where("kind = 'geodesic_proximity'")
    return e.select("from_node", "to_node", geo.metres(F.col("walk_m")).alias("walk_m"))


@query(f"""WITH {STOPS} SELECT node_id, CAST(floor({distance('latitude', 'longitude', '36.2', '127.15')} + 0.5) AS BIGINT) AS distance_m FROM stops WHERE {distance('latitude', 'longitude', '36.2', '127.15')} <= 3000""")
def nearby_point(spark, d):
    return spatial.nearby(tables.stops(spark, d), 36.2, 127.15, 3000).select("node_id", geo.metres(F.col("distance_m")).alias("distance_m"))


@query(f"""{CITY_SEQ}, n AS (SELECT city_code, node_id, count(DISTINCT route_id) AS routes FROM cs GROUP BY ALL) SELECT CAST(city_code AS BIGINT) AS city_code, node_id, routes, routes * (routes - 1) // 2 AS route_pairs FROM n WHERE routes > 1""")
def shared_stop_route_pairs(spark, d):
    return spatial.shared_pairs(_city_rows(spark, d), ["city_code", "node_id"])


@query(f"""WITH {STOPS}, s AS (SELECT city_name, count(*) AS n, sum(cos(radians(latitude)) * cos(radians(longitude))) AS x, sum(cos(radians(latitude)) * sin(radians(longitude))) AS y, sum(sin(radians(latitude))) AS z FROM stops WHERE latitude IS NOT NULL GROUP BY 1)
SELECT city_name, n, CAST(floor(degrees(asin(z / sqrt(x * x + y * y + z * z))) * 1000000 + 0.5) AS BIGINT) AS lat_e6, CAST(floor(degrees(atan2(y, x)) * 1000000 + 0.5) AS BIGINT) AS lon_e6 FROM s""")
def spherical_mean(spark, d):
    m = spatial.spherical_mean(tables.stops(spark, d), ["city_name"])
    return m.select("city_name", "n", F.floor(F.col("latitude") * 1_000_000 + 0.5).alias("lat_e6"), F.floor(F.col("longitude") * 1_000_000 + 0.5).alias("lon_e6"))


@query(f"""WITH {STOPS}, s AS (SELECT node_name, node_id, latitude, longitude FROM stops WHERE latitude IS NOT NULL), a AS (SELECT node_name, arg_min((latitude, longitude), node_id) AS p FROM s GROUP BY 1)
SELECT node_name, CAST(floor(max({distance('latitude', 'longitude', 'p[1]', 'p[2]')}) + 0.5) AS BIGINT) AS distance_m, count(*) AS n FROM s JOIN a USING (node_name) GROUP BY node_name HAVING max({distance('latitude', 'longitude', 'p[1]', 'p[2]')}) > 10000""")
def coordinate_conflicts(spark, d):
    return spatial.conflicts(tables.stops(spark, d), ["node_name"], 10_000, ["node_id"]).select("node_name", geo.metres(F.col("distance_m")).alias("distance_m"), "n")


# --- schedules ----------------------------------------------------------------------------------


@query(f"WITH {TIMES}, {STOPS} SELECT stop_id, count(*) AS rows FROM times WHERE stop_id NOT IN (SELECT node_id FROM stops WHERE node_id % 50 <> 0) GROUP BY stop_id")
def gtfs_reference_orphans(spark, d):
    s = tables.stops(spark, d).where("node_id % 50 <> 0").select(F.col("node_id").alias("stop_id"))
    return schedule.orphans(tables.stop_times(spark, d), s, "stop_id")


@query(f"""WITH {TIMES}, w AS (SELECT *, max(departure_seconds) OVER (PARTITION BY trip_id ORDER BY stop_sequence, stop_id, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_s FROM times)
SELECT trip_id, CAST(stop_sequence AS BIGINT) AS stop_sequence, stop_id, tie, departure_seconds, last_s FROM w WHERE departure_seconds < last_s""")
def gtfs_time_monotonic(spark, d):
    return schedule.time_disorder(tables.stop_times(spark, d)).select("trip_id", "stop_sequence", "stop_id", "tie", "departure_seconds", "last_s")


@query(f"""WITH {TIMES}, {TRIPS}, s AS (SELECT trip_id, count(*) AS stop_count, string_agg(concat_ws(':', (stop_id % 5), pickup_type, drop_off_type), '|' ORDER BY stop_sequence, stop_id % 5, tie, pickup_type, drop_off_type) AS stops FROM times GROUP BY 1)
SELECT route_id % 50 AS route_id, sha256(stops) AS pattern, count(*) AS trips, min(trip_id) AS representative_trip_id, min(stop_count) AS stop_count FROM s JOIN trips USING (trip_id) GROUP BY route_id % 50, stops""")
def gtfs_patterns(spark, d):
    t = tables.stop_times(spark, d).withColumn("stop_id", F.col("stop_id") % 5)
    trips = tables.trips(spark, d).withColumn("route_id", F.col("route_id") % 50)
    return schedule.patterns(t, trips).select("route_id", F.sha2("stops", 256).alias("pattern"), "trips", "representative_trip_id", "stop_count")


SERVICES = f"""{TRIPS}, cal AS (SELECT service_id, min(service_date) AS a, max(service_date) AS b FROM trips GROUP BY 1), dates AS (SELECT CAST(unnest(generate_series(DATE '1997-03-01', DATE '1997-03-31', INTERVAL 1 DAY)) AS DATE) AS service_date),
exc AS (SELECT DISTINCT service_id, service_date, 1 + CAST(day(service_date) % 2 AS INT) AS exception_type FROM trips WHERE trip_id % 97 = 0),
running AS (SELECT service_id, dates.service_date FROM cal CROSS JOIN dates LEFT JOIN exc ON exc.service_id = cal.service_id AND exc.service_date = dates.service_date
  WHERE CASE WHEN exception_type IS NOT NULL THEN exception_type = 1 ELSE dates.service_date BETWEEN a AND b AND (isodow(dates.service_date) - 1 + CAST(substr(cal.service_id, 1, 1) AS INT)) % 3 <> 0 END)""".replace("SELECT service_id, dates.service_date FROM cal CROSS", "SELECT cal.service_id, dates.service_date FROM cal CROSS")


def _running(spark, d):
    exc = tables.trips(spark, d).where("trip_id % 97 = 0").select("service_id", "service_date", (1 + F.day("service_date") % 2).alias("exception_type")).distinct()
    return schedule.operating(tables.services(spark, d), exc, "1997-03-01", "1997-03-31")


@query(f"WITH {SERVICES} SELECT service_id, CAST(service_date AS VARCHAR) AS service_date FROM running")
def gtfs_service_days(spark, d):
    return _running(spark, d).select("service_id", F.col("service_date").cast("string").alias("service_date"))


@query(f"""WITH {SERVICES}, {TIMES}, j AS (SELECT t.*, service_id FROM times t JOIN trips USING (trip_id) WHERE (service_id, service_date) IN (SELECT service_id, service_date FROM running) AND departure_seconds >= 3600 AND departure_seconds < 9000 AND pickup_type = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY departure_seconds, trip_id, stop_sequence, tie) AS rank FROM j) SELECT stop_id, rank, trip_id, departure_seconds FROM k WHERE rank <= 3""")
def gtfs_boarding_topk(spark, d):
    return schedule.boardings(tables.stop_times(spark, d), tables.trips(spark, d), _running(spark, d), 3600, 9000, 3).select("stop_id", "rank", "trip_id", "departure_seconds")


@query(f"""WITH {SERVICES}, {TIMES} SELECT trip_id, stop_id, route_id, service_id, departure_seconds, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date FROM times JOIN trips USING (trip_id) JOIN cal USING (service_id) WHERE trip_id % 11 = 3 AND stop_id % 13 = 1""")
def gtfs_exact_record(spark, d):
    t, trips = tables.stop_times(spark, d), tables.trips(spark, d)
    asked = t.where("trip_id % 11 = 3 and stop_id % 13 = 1").select("trip_id", "stop_id")
    r = schedule.exact_record(t, trips, tables.services(spark, d), asked)
    return r.select("trip_id", "stop_id", "route_id", "service_id", "departure_seconds", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))


@query(f"""WITH {TIMES} SELECT trip_id, count(*) AS rows, min(printf('%02d:%02d:%02d', departure_seconds // 3600, departure_seconds % 3600 // 60, departure_seconds % 60)) AS first_clock, sum(departure_seconds)::BIGINT AS seconds FROM times GROUP BY trip_id""")
def gtfs_clock_roundtrip(spark, d):
    t = tables.stop_times(spark, d).withColumn("c", clock.clock_text(F.col("departure_seconds"))).withColumn("s", clock.clock_seconds(F.col("c")))
    return t.groupBy("trip_id").agg(F.count("*").alias("rows"), F.min("c").alias("first_clock"), F.sum("s").alias("seconds"))


@query()
def gtfs_earliest_arrival(spark, d):
    times = tables.stop_times(spark, d)
    starts = spark.createDataFrame([(q, s, 0) for q, s in ((1, 1), (2, 5), (3, 9))], "query_id long, stop long, arrival long")
    return schedule.earliest_arrival(schedule.connections(times), starts, 300, None, storage.saved).select("query_id", "stop", "arrival", "round")


DAY, START_S, HORIZON_S = "1997-03-10", 3600, 10_800
RIDES = f"""ex AS (SELECT DISTINCT service_id, service_date, 1 + CAST(day(service_date) % 2 AS INT) AS exception_type FROM trips WHERE trip_id % 97 = 0),
cal AS (SELECT service_id, min(service_date) AS a, max(service_date) AS b FROM trips GROUP BY 1), days AS (SELECT o AS day_offset, CAST(DATE '{DAY}' + CAST(o AS INT) AS DATE) AS d FROM (VALUES (-1), (0), (1)) t(o)),
run AS (SELECT cal.service_id, day_offset FROM cal CROSS JOIN days LEFT JOIN ex ON ex.service_id = cal.service_id AND ex.service_date = d WHERE CASE WHEN exception_type IS NOT NULL THEN exception_type = 1 ELSE d BETWEEN a AND b AND (isodow(d) - 1 + CAST(substr(cal.service_id, 1, 1) AS INT)) % 3 <> 0 END),
bad AS (SELECT DISTINCT trip_id FROM (SELECT trip_id, departure_seconds, lag(departure_seconds) OVER (PARTITION BY trip_id ORDER BY stop_sequence, stop_id, tie) AS last_s FROM times) WHERE departure_seconds < last_s),
ride AS MATERIALIZED (SELECT trip_id, day_offset, stop_id, pickup_type, drop_off_type, departure_seconds + day_offset * 86400 AS t, row_number() OVER (PARTITION BY trip_id, day_offset ORDER BY stop_sequence, stop_id, tie) AS n FROM times JOIN trips USING (trip_id) JOIN run USING (service_id) WHERE trip_id NOT IN (SELECT trip_id FROM bad)),
b0 AS (SELECT * FROM (VALUES (1, 1, {START_S}), (2, 5, {START_S}), (3, 9, {START_S})) v(query_id, stop, arrival))"""


def _round(k: int) -> str:
    """SQL of the least arrivals with one boarding more."""
    ready = "arrival" if k == 1 else f"arrival + CASE WHEN arrival = {START_S} THEN 0 ELSE 300 END"
    return f"""b{k} AS MATERIALIZED (SELECT query_id, stop, min(arrival) AS arrival FROM (SELECT * FROM b{k - 1} UNION ALL SELECT query_id, y.stop_id, y.t FROM b{k - 1} b JOIN ride x ON x.stop_id = b.stop AND x.pickup_type = 0 AND x.t >= {ready} AND x.t <= {START_S + HORIZON_S}
JOIN ride y ON y.trip_id = x.trip_id AND y.day_offset = x.day_offset AND y.n > x.n AND y.drop_off_type = 0 AND y.t <= {START_S + HORIZON_S}) GROUP BY ALL)"""


@query(f"""WITH {TRIPS}, {TIMES}, {RIDES}, {", ".join(_round(k) for k in range(1, 8))} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(stop AS BIGINT) AS stop, CAST(arrival AS BIGINT) AS arrival FROM b7""")
def gtfs_schedule_arrival(spark, d):
    """Least arrival by the calendars of the day before, the day and the day after, within the horizon."""
    trips = tables.trips(spark, d)
    exc = trips.where("trip_id % 97 = 0").select("service_id", "service_date", (1 + F.day("service_date") % 2).alias("exception_type")).distinct()
    starts = spark.createDataFrame([(q, s, START_S) for q, s in ((1, 1), (2, 5), (3, 9))], "query_id long, stop long, arrival long")
    rides = schedule.dated_rides(tables.stop_times(spark, d), trips.select("trip_id", "service_id"), tables.services(spark, d), exc, DAY)
    return schedule.scheduled_arrival(rides, starts, 300, HORIZON_S, storage.saved).select("query_id", "stop", "arrival")


@query(f"WITH {TRIPS} SELECT trip_id, t.service_id, CAST(a AS VARCHAR) AS start_date, CAST(b AS VARCHAR) AS end_date FROM trips t JOIN (SELECT service_id, min(service_date) AS a, max(service_date) AS b FROM trips GROUP BY 1) c ON c.service_id = t.service_id")
def gtfs_trip_calendars(spark, d):
    return schedule.trip_calendars(tables.trips(spark, d), tables.services(spark, d)).select("trip_id", "service_id", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"))


REFERENCES = (("stop_times.stop_id", "SELECT l_partkey AS k FROM lineitem", "SELECT p_partkey AS k FROM part WHERE p_partkey % 50 <> 0"), ("stop_times.trip_id", "SELECT l_orderkey AS k FROM lineitem", "SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 50 <> 0"), ("trips.route_id", "SELECT o_custkey AS k FROM orders", "SELECT c_custkey AS k FROM customer WHERE c_custkey % 50 <> 0"), ("routes.agency_id", "SELECT c_nationkey AS k FROM customer", "SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 5 <> 0"), ("agencies.region_id", "SELECT n_regionkey AS k FROM nation", "SELECT r_regionkey AS k FROM region"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS reference, count(*) AS rows, count(DISTINCT k) AS targets FROM ({c}) WHERE k NOT IN ({p})" for n, c, p in REFERENCES))
def gtfs_all_references(spark, d):
    t = lambda n: tables.table(spark, d, n)
    keep = lambda df, c, m: df.where(F.col(c) % m != 0)
    return schedule.broken_references({
        "stop_times.stop_id": (t("lineitem"), "l_partkey", keep(t("part"), "p_partkey", 50), "p_partkey"), "stop_times.trip_id": (t("lineitem"), "l_orderkey", keep(t("orders"), "o_orderkey", 50), "o_orderkey"),
        "trips.route_id": (t("orders"), "o_custkey", keep(t("customer"), "c_custkey", 50), "c_custkey"), "routes.agency_id": (t("customer"), "c_nationkey", keep(t("nation"), "n_nationkey", 5), "n_nationkey"),
        "agencies.region_id": (t("nation"), "n_regionkey", t("region"), "r_regionkey"),
    })


# --- graphs -------------------------------------------------------------------------------------


RADIUS_M = 300
#: query_id, origin, destination
ASKED = tuple((q, 3 * q, (q * 37) % 190 + 5) for q in range(1, 41, 3))


def _states(spark, d):
    return sequence.with_segments(tables.sequences(spark, d)).join(tables.routes(spark, d).select("route_id", "city_code"), "route_id")


def _questions(spark, asked=ASKED):
    return spark.createDataFrame(list(asked), "query_id long, origin long, destination long")


def _ways(spark, d, asked=ASKED, **options):
    with storage.lean(spark):
        # every layer reads the states, by segment or by stop: dealt by route, they are shuffled for stops only
        kept = storage.saved(storage.dealt(_states(spark, d).select("route_id", "city_code", "segment_id", "pos", "node_id", "can_board", "can_alight"), "route_id"))
        # places follow from the stop; neither shuffles nor files carry them
        states = journeys.placed(tables.coordinates(kept, "node_id")).drop("latitude", "longitude")
        near = storage.saved(journeys.place_walks(states, RADIUS_M))
        ways = journeys.search(states, near, _questions(spark, asked), storage.saved, **options)
        storage.dropped(kept, near)
    return ways


@query()
def components_routes(spark, d):
    e = tables.sequence_rows(spark, d).select(F.col("route_id").alias("a"), (-1 - F.col("node_id")).alias("b")).distinct()
    c = graph.components(e, storage.saved)
    return c.where("node >= 0").groupBy("root").agg(F.count("*").alias("routes"), F.min("node").alias("first_route"))


@query()
def components_stops_300m(spark, d):
    c = graph.stop_components(tables.sequences(spark, d), 300, storage.saved)
    return c.groupBy("root").agg(F.count("*").alias("stops")).groupBy("stops").agg(F.count("*").alias("components"))


STATES = f"""{SEQ}, {ROUTES}, {SEGMENTS}, st AS MATERIALIZED (SELECT segments.*, city_code FROM segments JOIN routes USING (route_id)),
q(query_id, origin, destination) AS (VALUES {", ".join(map(str, ASKED))}),
pl AS (SELECT DISTINCT node_id, latitude, longitude FROM seq WHERE latitude IS NOT NULL),
nb AS MATERIALIZED (SELECT a.node_id AS f, b.node_id AS t, CAST(floor({distance("a.latitude", "a.longitude", "b.latitude", "b.longitude")} * 1000 + 0.5) AS BIGINT) AS mm FROM pl a JOIN pl b ON b.latitude BETWEEN a.latitude - 0.01 AND a.latitude + 0.01 WHERE {distance("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= {RADIUS_M}),
r0 AS MATERIALIZED (SELECT query_id, a.route_id, a.city_code, b.node_id, [a.route_id] AS sig, min((b.pos - a.pos, 0)) AS c FROM q JOIN st a ON a.node_id = origin AND a.can_board JOIN st b ON b.route_id = a.route_id AND b.segment_id = a.segment_id AND b.pos > a.pos AND b.can_alight GROUP BY ALL)"""


def _layer(n: int, best: bool) -> str:
    """SQL of the ways with one ride more, by all routes (best: the least of each route and stop, else of each list of routes)."""
    keep = "min((c[1] + b.pos - a.pos, c[2] + mm, list_append(sig, a.route_id)))" if best else "min((c[1] + b.pos - a.pos, c[2] + mm))"
    last = f"r{n - 1}"
    on_foot = f"SELECT query_id, r.route_id AS r, t AS node_id, NULL AS city, sig, c, mm FROM {last} r JOIN nb ON f = r.node_id"
    at_stop = f"SELECT query_id, route_id AS r, node_id, city_code AS city, sig, c, 0 AS mm FROM {last}"
    ride = "JOIN st a ON a.node_id = x.node_id AND a.can_board AND a.route_id <> r AND (city IS NULL OR a.city_code = city) JOIN st b ON b.route_id = a.route_id AND b.segment_id = a.segment_id AND b.pos > a.pos AND b.can_alight"
    if best:
        return f"""x{n} AS (SELECT query_id, a.route_id, a.city_code, b.node_id, {keep} AS m FROM ({at_stop} UNION ALL {on_foot}) x {ride} GROUP BY ALL), r{n} AS MATERIALIZED (SELECT query_id, route_id, city_code, node_id, m[3] AS sig, (m[1], m[2]) AS c FROM x{n})"""
    return f"""r{n} AS MATERIALIZED (SELECT query_id, a.route_id, a.city_code, b.node_id, list_append(sig, a.route_id) AS sig, {keep} AS c FROM ({at_stop} UNION ALL {on_foot}) x {ride} GROUP BY ALL)"""


ENDS = " UNION ALL ".join(f"SELECT q.query_id, {n} AS transfers, c[1] AS rides, c[2] AS walk_mm, sig FROM r{n} JOIN q ON q.query_id = r{n}.query_id AND node_id = destination" for n in range(4))


FEW = ASKED[:2]  # these go on for as many layers as it takes


@query(f"""WITH {STATES.replace(", ".join(map(str, ASKED)), ", ".join(map(str, FEW)))}, {_layer(1, True)}, {_layer(2, True)}, {_layer(3, True)}, e AS ({ENDS}), b AS (SELECT query_id, min((transfers, rides, walk_mm, sig)) AS m FROM e GROUP BY 1)
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(m[1] AS BIGINT) AS transfers, CAST(m[2] AS BIGINT) AS rides, CAST(m[3] AS BIGINT) AS walk_mm, list_aggregate(m[4], 'string_agg', '>') AS routes FROM b""")
def journey_min_transfers(spark, d):
    best = journeys.chosen(_ways(spark, d, FEW), "low_transfer", 1)
    return best.select("query_id", "transfers", "rides", "walk_mm", F.array_join("sig", ">").alias("routes"))


@query(f"""WITH {STATES}, m AS (SELECT query_id, node_id, min(c[1]) AS rides FROM r0 GROUP BY ALL) SELECT CAST(query_id AS BIGINT) AS query_id, node_id, CAST(rides AS BIGINT) AS rides FROM m""")
def journey_direct(spark, d):
    """Stops that one ride reaches from each question's origin."""
    ahead = sequence.reachable(tables.sequences(spark, d))
    q = _questions(spark).select("query_id", F.col("origin").alias("from_node"))
    return ahead.join(q, "from_node").groupBy("query_id", F.col("to_node").alias("node_id")).agg(F.min(F.col("to_pos") - F.col("from_pos")).alias("rides"))


def _all_ways(spark, d):
    """Ways of at most one transfer, five labels of each state."""
    return _ways(spark, d, k=5, extra=1, layers=2)


ONE = f"""{STATES}, {_layer(1, False)}, e AS ({" UNION ALL ".join(ENDS.split(" UNION ALL ")[:2])}), w AS (SELECT query_id, transfers, rides, walk_mm, sig, round(rides + transfers * 6.0::DOUBLE + walk_mm / 120000.0::DOUBLE, 9) AS cost FROM e)"""
RANKED = "CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, CAST(transfers AS BIGINT) AS transfers, CAST(rides AS BIGINT) AS rides, CAST(walk_mm AS BIGINT) AS walk_mm, list_aggregate(sig, 'string_agg', '>') AS routes"


def _ranked(ways):
    return ways.select("query_id", "rank", "transfers", "rides", "walk_mm", F.array_join("sig", ">").alias("routes"))


@query(f"""WITH {ONE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY transfers, rides, walk_mm, sig) AS rank FROM w) SELECT {RANKED} FROM k WHERE rank <= 3""")
def journey_alternatives_low_transfer(spark, d):
    return _ranked(journeys.chosen(_all_ways(spark, d), "low_transfer"))


@query(f"""WITH {ONE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cost, transfers, walk_mm, sig) AS rank FROM w) SELECT {RANKED} FROM k WHERE rank <= 3""")
def journey_alternatives_reliable(spark, d):
    return _ranked(journeys.chosen(_all_ways(spark, d), "reliable"))


@query(f"""WITH {ONE}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY -len(sig), cost, transfers, walk_mm, sig) AS rank FROM w) SELECT {RANKED} FROM k WHERE rank <= 3""")
def journey_alternatives_challenge(spark, d):
    return _ranked(journeys.chosen(_all_ways(spark, d), "challenge"))


#: The second of the diverse ways is the least like the first one: no common route where there is such a way.
@query(f"""WITH {ONE}, f AS (SELECT query_id, min((cost, transfers, walk_mm, sig)) AS m FROM w GROUP BY 1),
l AS (SELECT w.*, round(len(list_intersect(sig, m[4])) / len(list_distinct(list_concat(sig, m[4]))), 9) AS alike FROM w JOIN f USING (query_id) WHERE sig <> m[4]),
k AS (SELECT query_id, 1 AS rank, m AS m FROM f UNION ALL SELECT query_id, 2, (x[2], x[3], x[4], x[5]) FROM (SELECT query_id, min((alike, cost, transfers, walk_mm, sig)) AS x FROM l GROUP BY 1))
SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS BIGINT) AS rank, CAST(m[2] AS BIGINT) AS transfers, CAST(m[3] AS BIGINT) AS walk_mm, list_aggregate(m[4], 'string_agg', '>') AS routes FROM k""")
def journey_alternatives(spark, d):
    return _ranked(journeys.chosen(_all_ways(spark, d), "diverse", 2)).drop("rides")


@query()
def journey_steps(spark, d):
    """Rides and changes of the best way of each question."""
    return journeys.steps(journeys.chosen(_ways(spark, d, FEW), "low_transfer", 1))


# --- geometry, names, streams -------------------------------------------------------------------


@query()
def polyline_projection(spark, d):
    p = tables.sequences(spark, d).where("latitude is not null").select(F.col("route_id").alias("line_id"), F.col("pos").alias("n"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"), "node_id")
    stops = p.select("line_id", F.col("node_id").alias("stop_id"), (F.col("lon") + 0.001).alias("lon"), (F.col("lat") - 0.001).alias("lat")).dropDuplicates(["line_id", "stop_id"])
    return geometry.project(stops, geometry.segments(p)).select("line_id", "stop_id", "n", geo.metres(F.col("distance_m")).alias("distance_m"))


@query(f"""WITH {SEQ}, p AS (SELECT route_id, pos, longitude, latitude, row_number() OVER (PARTITION BY route_id ORDER BY pos) AS k FROM seq WHERE latitude IS NOT NULL),
x AS (SELECT a.route_id, a.pos, {distance('b.latitude', 'b.longitude', 'a.latitude', 'a.longitude')} AS d FROM p a LEFT JOIN p b ON b.route_id = a.route_id AND b.k = a.k - 1)
SELECT route_id, count(*) FILTER (coalesce(d, 0) > 20000) + 1 AS chains, count(*) AS points FROM x GROUP BY route_id""")
def polyline_chains(spark, d):
    p = tables.sequences(spark, d).where("latitude is not null").select(F.col("route_id").alias("line_id"), F.col("pos").alias("n"), F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return geometry.chains(p, gap_m=20_000).groupBy(F.col("line_id").alias("route_id")).agg((F.max("chain") + 1).alias("chains"), F.count("*").alias("points"))


@query()
def stop_name_key_nfkc(spark, d):
    s = tables.stops(spark, d).select("node_id", text.name_key("node_name").alias("name_key"))
    return s.groupBy("name_key").agg(F.count("*").alias("stops"), F.min("node_id").alias("first_node"))


def _stream(spark, d):
    raw = spark.readStream.schema(tables.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return raw.select(F.col("event_type").alias("route_id"), F.col("user_id").alias("vehicle_no"), (F.floor("value") % 12 + 1).cast("int").alias("node_order"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").alias("poll_id"))


@query(f"WITH {POLLS}, {PASSAGES} SELECT poll_id, route_id, vehicle_no, CAST(from_order AS BIGINT) AS from_order, CAST(node_order AS BIGINT) AS node_order, status, gap_reason FROM passages")
def stream_passages(spark, d):
    folder = storage.folder(spark)
    return streaming.drained(streaming.passages(_stream(spark, d), DAY_S), f"{folder}/out", f"{folder}/state").select(*EVENT)


#: Windows that the watermark (an hour behind the last poll) has closed.
@query(f"""WITH {POLLS}, m AS (SELECT max(observed_at) AS last_at FROM polls) SELECT epoch_us(date_trunc('day', observed_at)) AS window_us, route_id, count(*) AS polls FROM polls, m WHERE date_trunc('day', observed_at) + INTERVAL 1 DAY <= last_at - INTERVAL 1 HOUR GROUP BY ALL""")
def stream_window_counts(spark, d):
    folder = storage.folder(spark)
    counts = streaming.drained(streaming.window_counts(_stream(spark, d)), f"{folder}/out", f"{folder}/state")
    return counts.select(F.unix_micros("window_start").alias("window_us"), "route_id", "polls")


@query("""SELECT event_type || ':' || CAST(epoch_us(ts) // 300000000 AS VARCHAR) AS idempotency_key, count(*) AS kept FROM (SELECT DISTINCT event_type, epoch_us(ts) // 300000000 AS b, min(ts) AS ts FROM events GROUP BY ALL) GROUP BY 1""")
def stream_deduped(spark, d):
    folder = storage.folder(spark)
    keyed = _stream(spark, d).withColumn("idempotency_key", F.concat_ws(":", "route_id", clock.time_bucket(F.col("observed_at"), 300).cast("string")))
    out = streaming.drained(streaming.deduped(keyed), f"{folder}/out", f"{folder}/state")
    return out.groupBy("idempotency_key").agg(F.count("*").alias("kept"))


@query(f"""WITH {POLLS}, {STOPS} SELECT poll_id, p.node_order AS node_id, node_name FROM polls p LEFT JOIN stops s ON s.node_id = p.node_order""")
def stream_stop_names(spark, d):
    folder = storage.folder(spark)
    names = tables.stops(spark, d).select("node_id", "node_name")
    polls = _stream(spark, d).withColumn("node_id", F.col("node_order").cast("long"))
    return streaming.drained(streaming.with_stop_names(polls, names), f"{folder}/out", f"{folder}/state").select("poll_id", "node_id", "node_name")


@query(f"""WITH {POLLS}, g AS (SELECT *, CASE WHEN epoch_us(observed_at) - lag(epoch_us(observed_at)) OVER w < 3600000000 THEN 0 ELSE 1 END AS new FROM polls WINDOW w AS (PARTITION BY route_id, vehicle_no ORDER BY observed_at, poll_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY route_id, vehicle_no ORDER BY observed_at, poll_id ROWS UNBOUNDED PRECEDING) AS k FROM g), x AS (SELECT route_id, vehicle_no, k, min(observed_at) AS a, max(observed_at) + INTERVAL 1 HOUR AS b, count(*) AS polls FROM s GROUP BY ALL)
SELECT route_id, vehicle_no, epoch_us(a) AS start_us, epoch_us(b) AS end_us, polls FROM x WHERE b <= (SELECT max(observed_at) - INTERVAL 1 HOUR FROM polls)""")
def stream_sessions(spark, d):
    folder = storage.folder(spark)
    out = streaming.drained(streaming.sessions(_stream(spark, d), "1 hour"), f"{folder}/out", f"{folder}/state")
    return out.select("route_id", "vehicle_no", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "polls")
