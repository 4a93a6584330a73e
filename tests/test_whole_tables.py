"""Graph queries on tables whose ids no modulo sample keeps, against brute force."""

import math
import random
from collections import Counter

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from routeloom.plans.registry import QUERIES

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_linestatus string, l_returnflag string"


@pytest.fixture
def lines(spark, tmp_path):
    def put(rows):
        spark.createDataFrame([(r, s, 1, n, "O", "N") for r, n, s in rows], LINE).write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return put


def test_components_of_every_route(spark, lines):
    rng = random.Random(5)
    rows = [(r, n, s) for r in range(1, 5) for n, s in enumerate(rng.sample(range(1, 300), 3))]
    rows += [(6, 0, rows[0][2] + 400), (7, 0, 350), (7, 1, 97), (8, 0, 97), (9, 0, 351)]  # one place with another stop, no place, alone
    d = lines(rows)

    def place(s):
        return (36 + s * 37 % 400 / 1000, 127 + s * 61 % 400 / 1000)

    def metres(a, b):
        (p, q), (u, v) = place(a), place(b)
        x = math.sin(math.radians(u - p) / 2) ** 2 + math.cos(math.radians(p)) * math.cos(math.radians(u)) * math.sin(math.radians(v - q) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(x))

    def sizes(nodes, pairs):
        root = {x: x for x in nodes}
        for a, b in pairs:
            a, b = root[a], root[b]
            root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
        return root

    stops = {s for _, _, s in rows}
    rides = [(a[2], b[2]) for a, b in zip(rows, rows[1:]) if a[0] == b[0]]
    near = [(a, b) for a in stops for b in stops if a % 97 and b % 97 and metres(a, b) <= 300]
    n = Counter(sizes(stops, rides + near).values())
    got = {(r.stops, r.components) for r in QUERIES["components_stops_300m"](spark, d).collect()}
    assert got == set(Counter(n.values()).items())
    r = QUERIES["component_summary"](spark, d).first()
    assert (r.components, r.largest, r.singletons, r.connected_pairs) == (len(n), max(n.values()), list(n.values()).count(1), sum(k * (k - 1) // 2 for k in n.values()))
    by = Counter(sizes([(0, r) for r, _, _ in rows] + [(1, s) for s in stops], [((0, r), (1, s)) for r, _, s in rows])[0, r] for r in {r for r, _, _ in rows})
    assert {(r.first_route, r.routes) for r in QUERIES["components_routes"](spark, d).collect()} == {(k[1], m) for k, m in by.items()}


def test_earliest_arrival_rides_every_trip_and_boarding(spark, lines):
    d = lines([x for k in range(1, 8) for x in ((k, 2 * k, k), (k, 2 * k + 1, k + 1))])
    got = {r.stop: (r.arrival, r["round"]) for r in QUERIES["gtfs_earliest_arrival"](spark, d).where("query_id = 1").collect()}
    assert got == {1: (0, 0), **{k + 1: ((2 * k + 1) * 1800 + k + 1, k) for k in range(1, 8)}}


def test_projection_of_every_line(spark, lines):
    d = lines([(r, n, 10 * r + n) for r in range(1, 12) for n in range(3)])
    got = {(r.line_id, r.stop_id) for r in QUERIES["polyline_projection"](spark, d).collect()}
    assert got == {(r, s) for r in range(1, 12) for s in range(10 * r, 10 * r + 3) if s != 97}
