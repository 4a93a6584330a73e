import random

import pytest
from pyspark.sql import functions as F

from routeloom import storage
from routeloom.operators import graph, journeys, schedule, sequence, spatial


@pytest.fixture(autouse=True)
def small(spark):
    """These loops run hundreds of jobs over a few rows: one task each, nothing compiled."""
    few = {"spark.sql.shuffle.partitions": "1", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    before = {k: spark.conf.get(k, None) for k in few}
    for k, v in few.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def saved(df):
    """Rows kept by the driver; test_storage() writes files."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def test_storage(spark):
    df = storage.saved(spark.range(5))
    path = df._saved_at
    assert df.count() == 5 and storage.listed(spark, path)
    storage.dropped(df, spark.range(2))
    assert storage.listed(spark, path) == []


def network(seed, routes=14, stops=16):
    rng, rows = random.Random(seed), []
    place = {s: (36 + rng.random() / 40, 127 + rng.random() / 40) for s in range(stops)}
    for r in range(routes):
        for i, s in enumerate(rng.choice(range(stops)) for _ in range(rng.randrange(2, 7))):
            rows.append((r, i, i, s, *place[s], rng.choice(["0", "0", "0", "1", ""]), rng.random() < 0.9, rng.random() < 0.9))
    return rows


ROW = "route_id long, pos int, node_order int, node_id long, latitude double, longitude double, direction string, can_board boolean, can_alight boolean"


def plain_search(rows, walks, origin, destination, layers):
    """Least (transfers, rides, walk_mm) by going through all states layer by layer."""
    by = {}
    for r in rows:
        by.setdefault((r["route_id"], r["segment_id"]), []).append(r)

    def rides(labels):
        out = {}
        for (route, seg, pos), (n, w) in labels.items():
            for r in by[route, seg]:
                if r["pos"] > pos and r["can_alight"]:
                    key, c = (route, r["city_code"], r["node_id"]), (n + r["pos"] - pos, w)
                    out[key] = min(out.get(key, c), c)
        return out

    labels = {(r["route_id"], r["segment_id"], r["pos"]): (0, 0) for r in rows if r["node_id"] == origin and r["can_board"]}
    for t in range(layers):
        there = rides(labels)
        ends = [c for (_, _, node), c in there.items() if node == destination]
        if ends:
            return (t, *min(ends))
        new = {}
        for (route, city, node), (n, w) in there.items():
            for r in rows:
                if r["route_id"] == route or not r["can_board"]:
                    continue
                d = 0 if r["node_id"] == node and r["city_code"] == city else walks.get((node, r["node_id"]))
                if d is not None:
                    key, c = (r["route_id"], r["segment_id"], r["pos"]), (n, w + d)
                    new[key] = min(new.get(key, c), c)
        labels = new
    return None


def found(spark, rows, questions, radius=400, **options):
    seq = sequence.with_segments(spark.createDataFrame(rows, ROW)).withColumn("city_code", F.col("route_id") % 2)
    near = journeys.walks(seq, radius)
    q = spark.createDataFrame(questions, "query_id long, origin long, destination long")
    return seq, near, journeys.search(seq, near, q, saved, **options)


def test_least_transfers_against_plain_search(spark):
    for seed in (1,):
        rows = network(seed)
        rows = [(*r[:4], *((None, None) if r[3] % 5 == 0 else r[4:6]), *r[6:]) for r in rows]  # some stops have no place
        questions = [(n, a, b) for n, (a, b) in enumerate([(0, 5), (1, 9), (2, 13), (3, 10), (4, 15), (6, 7)])]
        seq, near, ways = found(spark, rows, questions)
        got = {r.query_id: (r.transfers, r.rides, r.walk_mm) for r in journeys.chosen(ways, "low_transfer", 1).collect()}
        table, walks = [r.asDict() for r in seq.collect()], {(r.from_node, r.to_node): r.walk_mm for r in near.collect()}
        want = {n: plain_search(table, walks, a, b, 12) for n, a, b in questions}
        assert got == {n: c for n, c in want.items() if c}


def line(route, *stops, direction=None, placed=False):
    """A route's rows; stops lie a degree apart, so that nobody walks."""
    return [(route, i, i, s, *((30.0 + s, 100.0) if placed else (None, None)), (direction or "0" * len(stops))[i], True, True) for i, s in enumerate(stops)]


def test_stops_without_places_are_routed(spark):
    _, _, ways = found(spark, line(2, 1, 2) + line(4, 2, 3) + line(6, 3, 4), [(1, 1, 4), (2, 4, 1)])
    assert [(r.query_id, r.transfers, r.sig) for r in ways.collect()] == [(1, 2, [2, 4, 6])]


def test_changes_between_cities_need_a_place(spark):
    rows = line(2, 1, 2) + line(3, 2, 3)  # two cities
    assert found(spark, rows, [(1, 1, 3)])[2].count() == 0
    placed = line(2, 1, 2, placed=True) + line(3, 2, 3, placed=True)
    assert found(spark, placed, [(1, 1, 3)])[2].first().transfers == 1


def test_a_route_again_after_another_one(spark):
    rows = line(2, 11, 12, 13, 14, direction="0011") + line(4, 11, 12) + line(6, 12, 13)
    best = journeys.chosen(found(spark, rows, [(1, 11, 14)])[2], "low_transfer", 1).first()
    assert best.sig == [2, 6, 2] and [(p.board_node, p.alight_node) for p in best.path] == [(11, 12), (12, 13), (13, 14)]
    # not from a route to itself: its direction ends at 12 and no other route goes on
    assert found(spark, line(2, 11, 12, 13, direction="001"), [(1, 11, 13)])[2].count() == 0


def test_histories_that_meet_stay_apart(spark):
    rows = line(2, 1, 2) + line(4, 1, 2) + line(6, 2, 3)
    ways = found(spark, rows, [(1, 1, 3)], k=5, extra=1)[2]
    assert {tuple(r.sig) for r in journeys.chosen(ways, "diverse").collect()} == {(2, 6), (4, 6)}
    assert found(spark, rows, [(1, 1, 3)])[2].count() == 1


def test_a_long_chain_and_a_layer_bound(spark):
    rows = [x for i in range(5) for x in line(2 * i, i, i + 1)]
    assert found(spark, rows, [(1, 0, 5)])[2].first().sig == [2 * i for i in range(5)]
    assert found(spark, rows, [(1, 0, 5)], layers=2)[2].count() == 0


def test_preferences(spark):
    ways = spark.createDataFrame(
        [(1, 0, 30, 0, [1]), (1, 1, 20, 120_000, [1, 2]), (1, 1, 22, 0, [3, 4]), (1, 2, 19, 0, [1, 2, 5]), (2, 0, 5, 0, [9])],
        "query_id long, transfers int, rides long, walk_mm long, sig array<long>",
    )
    got = lambda p: [r.sig for r in journeys.chosen(ways, p).where("query_id = 1").orderBy("rank").collect()]
    assert got("low_transfer") == [[1], [1, 2], [3, 4]]
    assert got("reliable") == [[1, 2], [3, 4], [1]]  # costs 27, 28, 30 and 31
    assert got("challenge") == [[1, 2, 5], [1, 2], [3, 4]]
    assert got("diverse") == [[1, 2], [3, 4], [1]]
    assert journeys.chosen(ways, "diverse").where("query_id = 2").count() == 1


def test_steps_name_rides_and_changes(spark):
    rows = line(2, 1, 2, 3) + line(4, 3, 4) + [(6, 0, 0, 50, 34.0, 100.0005, "0", True, True), (6, 1, 1, 60, None, None, "0", True, True)]
    rows = [(*r[:4], 34.0, 100.0, *r[6:]) if r[3] == 4 else r for r in rows]
    ways = found(spark, rows, [(1, 1, 60)])[2]
    steps = [(r.kind, r.route_id, r.from_node, r.to_node) for r in journeys.steps(journeys.chosen(ways, "low_transfer", 1)).orderBy("step").collect()]
    assert steps == [("ride", 2, 1, 3), ("transfer", None, 3, 3), ("ride", 4, 3, 4), ("walk", None, 4, 50), ("ride", 6, 50, 60)]


def test_earliest_arrival_against_plain_search(spark):
    rng = random.Random(4)
    times = []
    for t in range(25):
        s = rng.randrange(0, 4000)
        for i in range(5):
            times.append((t, rng.randrange(12), i, 0, s, 0 if rng.random() < 0.9 else 1))
            s += rng.randrange(60, 400)
    df = spark.createDataFrame(times, "trip_id long, stop_id long, stop_sequence int, tie int, departure_seconds long, pickup_type int")
    got = {r.stop: r.arrival for r in schedule.earliest_arrival(schedule.connections(df), spark.createDataFrame([(1, 0, 0)], "query_id long, stop long, arrival long"), 300, 6, saved).collect()}
    best, changed = {0: (0, 0)}, True
    for r in range(1, 7):
        new = dict(best)
        for stop, (arrival, rd) in best.items():
            if rd != r - 1:
                continue
            for i, (t, s, n, _, dep, pick) in enumerate(times):
                if s == stop and pick == 0 and n < 4 and dep >= arrival + (300 if rd else 0):
                    for t2, s2, n2, _, dep2, _ in times:
                        if t2 == t and n2 > n and (dep2 < new.get(s2, (10**9,))[0]):
                            new[s2] = (dep2, r)
        if new == best:
            break
        best = new
    assert got == {s: a for s, (a, _) in best.items()}


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(e, "a long, b long"), saved).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long"), saved).count() == 0


def test_hub_is_dealt_over_salts(spark):
    e = [(0, i) for i in range(1, 400)]
    got = graph.components(spark.createDataFrame(e, "a long, b long"), saved)
    assert got.count() == 400 and got.where("root = 0").count() == 400
    least = graph.with_least(spark.createDataFrame(e + [(7, 9)], "a long, b long"), "a", "b", several=True)
    assert least.count() == 399 and {r.m for r in least.collect()} == {1}


def test_transfer_counts_equal_pairs(spark):
    df = spark.createDataFrame(network(3), ROW).withColumn("city_code", F.lit(1))
    got = {r.node_id: r.transfers for r in spatial.exact_transfers(df).collect()}
    rows = df.collect()
    pairs = {(a.node_id, a.route_id, b.route_id) for a in rows for b in rows if a.node_id == b.node_id and a.route_id != b.route_id and a.can_alight and b.can_board}
    assert got == {n: sum(1 for p in pairs if p[0] == n) for n in {p[0] for p in pairs}}
