"""Plans and amounts that must not grow with the square of a crowded place, nor in the driver."""

import random
import re
import time

import __spark_entry__  # noqa: F401  registers the queries
from routeloom import storage
from routeloom.functions import geo
from routeloom.operators import candidates, journeys
from routeloom.plans.registry import QUERIES


def test_counterparts_of_crowded_places(spark, tmp_path):
    rng = random.Random(3)
    places = [(36.0 + i / 100, 127.0 + i % 3 / 100) for i in range(8)] + [(None, None)]
    rows = [(n, rng.choice(["a", "b", None]), *places[rng.randrange(9)]) for n in range(120)]
    spark.createDataFrame(rows, "node_id long, node_name string, latitude double, longitude double").write.parquet(f"{tmp_path}/stops")
    got = candidates.counterparts(spark.read.parquet(f"{tmp_path}/stops"), "node_name", 1500)
    # a small file is no small table: nothing goes to the driver to be broadcast
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = spark.createDataFrame([(a[0], b[0], *a[2:], *b[2:]) for a in rows for b in rows if a[1] and a[1] == b[1] and a[2] and b[2]], "a long, b long, p double, q double, u double, v double")
    want = pairs.where("a <> b").select("a", "b", geo.haversine(*map(pairs.__getitem__, "pquv"), geo.PLANNER_RADIUS_M).alias("d")).where("d <= 1500")
    want = sorted(map(tuple, want.collect()))
    assert want and sorted((r.node_id, r.other_id, r.distance_m) for r in got.collect()) == want


def crowded(spark, d):
    """One question's way changes on foot at a place of 60 stops, of which each has a route."""
    lines = [(1, 1, 3), (1, 2, 10), (2, 1, 410), (2, 2, 42), *(x for j in range(2, 60) for x in ((10 + j, 1, 10 + 400 * j), (10 + j, 2, 11 + 400 * j)))]
    spark.createDataFrame([(r, n, s, 1, "O", "N") for r, n, s in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(r, 1) for r in {x[0] for x in lines}], "o_orderkey long, o_custkey long").selectExpr("*", "'O' as o_orderstatus", "'1' as o_orderpriority", "timestamp'2024-01-01' as o_orderdate", "1D as o_totalprice").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, 1)], "c_custkey long, c_nationkey int").write.parquet(f"{d}/customer.parquet")
    return len(lines)


def test_crowded_places_are_not_paired(spark, tmp_path, monkeypatch):
    n, counts, save = crowded(spark, tmp_path), [], storage.saved

    def saved(df):
        out = save(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(storage, "saved", saved)
    got = QUERIES["journey_min_transfers"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 2, 0, "1>2")]
    assert max(counts) == n  # before: 60 * 60 pairs of stops


def test_steps_across_a_crowded_place(spark, tmp_path, monkeypatch):
    n, counts, save = crowded(spark, tmp_path), [], storage.saved

    def saved(df):
        out = save(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(storage, "saved", saved)
    got = QUERIES["journey_steps"](spark, str(tmp_path)).orderBy("step").collect()
    assert [(r.kind, r.route_id, r.from_node, r.to_node, r.rows, r.walk_mm) for r in got] == [("ride", 1, 3, 10, 1, 0), ("walk", None, 10, 410, 0, 0), ("ride", 2, 410, 42, 1, 0)]
    assert max(counts) == n


def test_steps_shuffle_no_states_by_segment_and_leave_no_shuffles(spark, tmp_path, monkeypatch):
    crowded(spark, tmp_path)
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: str(blocks.getAllFiles().mkString(" ")).count("shuffle_")
    plans, save, before = [], storage.saved, files()

    def saved(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df)

    monkeypatch.setattr(storage, "saved", saved)
    monkeypatch.setattr(storage, "PASS_BYTES", 1, raising=False)  # several passes
    monkeypatch.setattr(journeys, "FEW", 0)  # as over labels that are too many to broadcast
    got = QUERIES["journey_steps"](spark, str(tmp_path))
    # before: the rows of all routes, once for each join that rides or closes
    assert plans and not [p for p in plans if re.search(r"hashpartitioning\(route_id#\d+L, segment_id#\d+L, \d+\)", p)]
    until = time.time() + 20
    while files() > before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert files() <= before
    assert [(r.kind, r.route_id, r.from_node, r.to_node) for r in got.orderBy("step").collect()] == [("ride", 1, 3, 10), ("walk", None, 10, 410), ("ride", 2, 410, 42)]


def test_dealt_tables_are_whole(spark, monkeypatch):
    df = spark.range(200).selectExpr("nullif(id % 23, 0) as a", "id")
    want = sorted((r.id, r.a) for r in df.collect())
    for size in (1, 1 << 26):
        monkeypatch.setattr(storage, "PASS_BYTES", size)
        conf = dict(spark.conf.getAll)
        with storage.lean(spark):
            out = storage.saved(storage.dealt(df, "a"))
            both = out.join(df.hint("merge"), ["a", "id"])
            assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted((r.id, r.a) for r in out.collect()) == want and both.count() == 191
        assert dict(spark.conf.getAll) == conf
        assert not [t for t in spark.catalog.listTables("spark_catalog.default") if t.name.startswith("tables_")]
        storage.dropped(out)
        assert not storage.listed(spark, out._saved_at)
