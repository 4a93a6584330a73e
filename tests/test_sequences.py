from pyspark.sql import functions as F

from routeloom.operators import coverage, ingest, search, sequence, versions

ROW = "route_id string, pos int, node_order int, node_id string, latitude double, longitude double, direction string, can_board boolean, can_alight boolean"


def rows(spark, points, route="R", way="0"):
    return spark.createDataFrame([(route, i, i + 1, f"N{i}", *p, way, True, True) for i, p in enumerate(points)], ROW)


def test_spike_triple(spark):
    far = rows(spark, [(36.0, 127.0), (36.3, 127.0), (36.001, 127.0)])
    assert [r.node_id for r in sequence.spikes(far).collect()] == ["N1"]
    near = rows(spark, [(36.0, 127.0), (36.01, 127.0), (36.001, 127.0)])
    assert sequence.spikes(near).count() == 0
    assert sequence.spikes(far.withColumn("direction", F.lit(""))).count() == 0
    mixed = far.withColumn("direction", F.col("pos").cast("string"))
    assert sequence.spikes(mixed).count() == 0


def test_spike_suppression_is_a_fixpoint(spark):
    df = rows(spark, [(36.0, 127.0), (36.5, 127.0), (36.001, 127.0), (36.6, 127.0), (36.002, 127.0)])
    out = ingest.without_spikes(df).orderBy("pos").collect()
    assert [r.latitude is None for r in out] == [False, True, False, True, False]


def test_blank_direction_hides_a_boundary(spark):
    df = spark.createDataFrame([("R", i, i, f"N{i}", None, None, w, True, True) for i, w in enumerate(["0", "", "1", "1", "0"])], ROW)
    assert [r.segment_id for r in sequence.with_segments(df).orderBy("pos").collect()] == [0, 0, 0, 0, 1]
    assert sequence.ride_edges(df).count() == 3


def test_uniform_sample_keeps_ends(spark):
    df = rows(spark, [(36.0, 127.0)] * 11)
    got = [r.pos for r in sequence.uniform_sample(df, "route_id", 5).orderBy("pos").collect()]
    assert got[0] == 0 and got[-1] == 10 and len(got) == 5
    assert sequence.uniform_sample(rows(spark, [(36.0, 127.0)]), "route_id", 5).count() == 1


def test_forward_pairs_count_through_rides(spark):
    flags = [(True, True), (False, True), (True, False), (True, True)]
    df = spark.createDataFrame([("R", i, i, f"N{i}", None, None, "0", b, a) for i, (b, a) in enumerate(flags)], ROW)
    assert sequence.forward_od_pairs(df).first().od_pairs == 1 + 2


def test_overlap_with_an_empty_side(spark):
    none = spark.createDataFrame([], "k long")
    some = spark.range(3).select(F.col("id").alias("k"))
    r = coverage.overlap(none, some, ["k"]).first()
    assert (r.catalog_count, r.graph_count, r.overlap_ppm) == (0, 3, None)
    assert coverage.overlap(some, none, ["k"]).first().overlap_ppm == 0


def test_search_marks_are_literal(spark):
    df = spark.createDataFrame([("50% off",), ("500 off",), ("a_b",), ("axb",), ("City Hall",)], "name string")
    assert [r[0] for r in search.search(df, ["name"], "0%").collect()] == ["50% off"]
    assert [r[0] for r in search.search(df, ["name"], "a_b").collect()] == ["a_b"]
    assert [r[0] for r in search.search(df, ["name"], "cityhall", (("cityhall", "city hall"),)).collect()] == ["City Hall"]


def test_activation_outcomes(spark):
    active = spark.createDataFrame([("a", 5, "x"), ("b", 5, "x"), ("c", 5, "x"), ("d", 5, "x")], "k string, at int, v string")
    new = spark.createDataFrame([("a", 6, "y"), ("b", 4, "y"), ("c", 5, "y"), ("d", 9, "x"), ("e", 1, "z")], "k string, at int, v string")
    judged = versions.preserve_newer(new, active, ["k"], "at", "v")
    assert {r.k: r.outcome for r in judged.collect()} == {"a": "activated", "b": "skipped_older", "c": "conflict", "d": "unchanged", "e": "inserted"}
    assert {(r.k, r.v) for r in versions.pointer_after(active, judged, ["k"], "at", "v").collect()} == {("a", "y"), ("b", "x"), ("c", "x"), ("d", "x"), ("e", "z")}


def test_persist_twice_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([("s1", 1), ("s1", 2)], "source_id string, v int")
    pointer = spark.createDataFrame([("stops", "s1")], "kind string, source_id string")
    for _ in range(2):
        versions.persist(df, f"{tmp_path}/t", "source_id", pointer, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2 and spark.read.parquet(f"{tmp_path}/p").first().source_id == "s1"


def test_quarantine_names_the_first_reason(spark):
    df = spark.createDataFrame([(1, 91.0, "a"), (2, 36.0, None), (3, 36.0, "b")], "id int, lat double, name string")
    good, bad = ingest.split(df, [("range", F.col("lat").between(-90, 90)), ("name", F.length("name") > 0)])
    assert [r.id for r in good.collect()] == [3] and {r.id: r.reject_reason for r in bad.collect()} == {1: "range", 2: "name"}


def test_quarantine_compares_versions(spark):
    active = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    evidence = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    assert [r.k for r in versions.quarantined(active, evidence, ["k"], "v").collect()] == ["b"]


def test_feed_activation(spark, tmp_path):
    tables = {"stops": spark.range(3), "trips": spark.range(2)}
    try:
        versions.activate_feed(tables, {"stops": 3, "trips": 9}, f"{tmp_path}/c", "f1", "p")
        raise AssertionError
    except ValueError:
        assert not (tmp_path / "c").exists()
    for feed in ("f1", "f2", "f2"):
        versions.activate_feed(tables, {"stops": 3, "trips": 2}, f"{tmp_path}/c", feed, "p")
    assert [r.feed_id for r in spark.read.parquet(f"{tmp_path}/c/active").collect()] == ["f2"]
    assert spark.read.parquet(f"{tmp_path}/c/stops").count() == 6
