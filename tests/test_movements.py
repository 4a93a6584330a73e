import datetime

from pyspark.sql import functions as F

from routeloom.functions import clock
from routeloom.operators import geometry, observations, replay, schedule, spatial

POLL = "route_id string, vehicle_no long, node_order int, observed_at timestamp, poll_id long"


def at(minute):
    return datetime.datetime(2026, 8, 31, 3) + datetime.timedelta(minutes=minute)


def polls(spark, orders, minutes=None):
    return spark.createDataFrame([("R", 1, o, at(m), i) for i, (o, m) in enumerate(zip(orders, minutes or range(len(orders))))], POLL)


def events(df):
    return [(r.status, r.gap_reason) for r in df.orderBy("poll_id").collect()]


def test_passage_classes(spark):
    assert events(observations.passages(polls(spark, [1, 2]))) == [("PASSAGE", None)]
    assert events(observations.passages(polls(spark, [1, 3, 2]))) == [("DATA_GAP", "NODE_ORDER_JUMP"), ("REGRESSION", "NODE_ORDER_REGRESSION")]
    assert events(observations.passages(polls(spark, [1, 2], [0, 16]))) == [("DATA_GAP", "NODE_ORDER_COLLISION")]
    assert events(observations.passages(polls(spark, [4, 4], [0, 16]))) == [("DATA_GAP", "OBSERVATION_TIME_GAP")]
    assert events(observations.passages(polls(spark, [4, 4]))) == []
    assert events(observations.passages(polls(spark, [4, 4], [3, 3]))) == [("DATA_GAP", "NON_MONOTONIC_CAPTURE_TIME")]


def test_late_polls_compare_with_the_latest(spark):
    df = polls(spark, [1, 3, 2], [0, 2, 1]).withColumn("arrival_seq", F.col("poll_id"))
    assert events(observations.passages_by_arrival(df)) == [("DATA_GAP", "NODE_ORDER_JUMP"), ("REGRESSION", "NODE_ORDER_REGRESSION")]
    same = polls(spark, [2, 2], [5, 1]).withColumn("arrival_seq", F.col("poll_id"))
    assert events(observations.passages_by_arrival(same)) == [("DATA_GAP", "NON_MONOTONIC_CAPTURE_TIME")]


def test_replay_verdicts(spark):
    legs = spark.createDataFrame([(1, "R", 2, 721, 730, 5), (2, "R", 2, 720, 725, 5)], "leg_id long, route_id string, node_order int, arrive_min int, next_min int, min_transfer int")
    ev = spark.createDataFrame([("R", "2026-08-31", 2, 719, 721, "PASSAGE", 7), ("R", "2026-09-01", 2, 719, 721, "DATA_GAP", 8)], "route_id string, service_date string, node_order int, from_min int, to_min int, status string, event_id long")
    got = {(r.leg_id, r.service_date): (r.verdict, r.reason) for r in replay.leg_match(legs, ev).collect()}
    assert got[1, "2026-08-31"] == ("success", None) and got[1, "2026-09-01"] == ("data_gap", "NO_PASSAGE")
    assert got[2, "2026-08-31"] == ("data_gap", "PASSAGE_WINDOW_CROSSES_DEADLINE")
    days = replay.daily(replay.leg_match(legs.where("leg_id = 1"), ev))
    r = replay.summary(days).first()
    assert (r.eligible, r.success_ppm) == (1, 1_000_000)
    assert replay.summary(replay.daily(replay.leg_match(legs.where("leg_id = 2"), ev))).first().success_ppm is None


def test_closed_form(spark):
    budgets = spark.createDataFrame([(1, 1, "a", "weekday", 2), (1, 2, "a", "weekday", 0)], "journey_id long, leg int, route_id string, kind string, budget int")
    delays = spark.createDataFrame([("a", "weekday", d) for d in range(4)], "route_id string, kind string, delay int")
    r = replay.closed_form(budgets, delays).first()
    assert abs(r.success_probability - 0.75 * 0.25) < 1e-12 and r.weakest_leg == 2


def test_clocks(spark):
    df = spark.createDataFrame([("24:20:00",), ("47:59:59",), ("48:00:00",), ("1:02:03",), ("12:60:00",), (None,)], "c string")
    assert [r[0] for r in df.select(clock.clock_seconds(F.col("c"))).collect()] == [87600, 172799, None, 3723, None, None]
    assert [r[0] for r in spark.createDataFrame([("20260830",), ("20260231",), ("2026-08-30",)], "d string").select(clock.feed_date(F.col("d")).cast("string")).collect()] == ["2026-08-30", None, None]


def test_calendar_exception_decides(spark):
    s = spark.createDataFrame([("S", *[True] * 5, False, False, datetime.date(2026, 8, 1), datetime.date(2026, 9, 30))], "service_id string, monday boolean, tuesday boolean, wednesday boolean, thursday boolean, friday boolean, saturday boolean, sunday boolean, start_date date, end_date date")
    e = spark.createDataFrame([("S", datetime.date(2026, 8, 30), 1), ("S", datetime.date(2026, 8, 31), 2)], "service_id string, service_date date, exception_type int")
    got = {str(r.service_date) for r in schedule.operating(s, e, "2026-08-29", "2026-09-01").collect()}
    assert got == {"2026-08-30", "2026-09-01"}


def test_grid_join_at_the_date_line_and_poles(spark):
    p = spark.createDataFrame([(1, 0.0, 179.9995), (2, 0.0, -179.9995), (3, 89.9999, 10.0), (4, 89.9999, -170.0), (5, 10.0, 10.0), (6, None, None)], "id long, latitude double, longitude double")
    got = {(r.id, r.near_id) for r in spatial.within(p, p, 300).where("id < near_id").collect()}
    assert got == {(1, 2), (3, 4)}


def test_geometry(spark):
    seg = spark.createDataFrame([("L", i, 127.0 + i / 100, 36.0) for i in range(3)], "line_id string, n int, lon double, lat double")
    stop = spark.createDataFrame([("L", "S", 127.015, 36.001)], "line_id string, stop_id string, lon double, lat double")
    r = geometry.project(stop, geometry.segments(seg)).first()
    assert r.n == 1 and abs(r.fraction - 0.5) < 1e-6 and 100 < r.distance_m < 120
    pt = "struct<lon:double,lat:double>"
    line = spark.createDataFrame([([[(0.0, 0.0), (1.0, 0.0)], [(2.0, 0.0), (1.0, 0.0)], [(2.0, 0.0), (3.0, 0.0)]],)], f"parts array<array<{pt}>>")
    turned = line.select(geometry.oriented(F.col("parts")).alias("x")).first().x
    assert [[p.lon for p in part] for part in turned] == [[0.0, 1.0], [1.0, 2.0], [2.0, 3.0]]
    a = spark.createDataFrame([(list(range(1, 8)), [1, 1, 2, 2, 1])], "a array<int>, b array<int>")
    x = a.select(geometry.chunks(F.col("a"), 3).alias("c"), geometry.deduped_line(F.col("b")).alias("d")).first()
    assert x.c == [[1, 2, 3], [3, 4, 5], [5, 6, 7]] and x.d == [1, 2, 1]


def test_boxes_and_gaps(spark):
    pt = "struct<lon:double,lat:double>"
    df = spark.createDataFrame([([[(127.0, 36.0), (127.1, 36.1)], [(127.0, 36.0)], [(127.0, 36.0), (100.0, 36.0)]],)], f"x array<array<{pt}>>")
    assert len(df.select(geometry.inside_box(F.col("x"), 33, 39, 124, 132)).first()[0]) == 1
    gap = df.select(geometry.endpoint_gap(F.col("x")[0], F.col("x")[2])).first()[0]
    assert gap == 0
