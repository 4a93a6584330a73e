import datetime

from pyspark.sql import functions as F

from routeloom.operators import observations
from routeloom.shipping import ship
from routeloom.sources import tables
from routeloom.streaming import passages as streaming

DIR = "/root/testdata/sf0.001"


def source(spark, tmp_path, rows, files=3):
    df = spark.createDataFrame(rows, "route_id string, vehicle_no long, node_order int, observed_at timestamp, poll_id long, idempotency_key string")
    for i in range(files):
        df.where(F.col("poll_id") % files == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def rows(orders):
    start = datetime.datetime(2026, 8, 31)
    return [("R", 1, o, start + datetime.timedelta(minutes=i), i, f"k{i % 4}") for i, o in enumerate(orders)]


def test_state_lives_across_batches(spark, tmp_path):
    ship(spark)
    made = rows([1, 2, 3, 5, 4])
    stream = source(spark, tmp_path, made, files=1)
    got = streaming.drained(streaming.passages(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    batch = observations.passages(spark.createDataFrame([r[:5] for r in made], "route_id string, vehicle_no long, node_order int, observed_at timestamp, poll_id long"))
    key = lambda df: sorted((r.poll_id, r.status, r.gap_reason) for r in df.collect())
    assert [x[:2] for x in key(got.fillna("-"))] == [x[:2] for x in key(batch.fillna("-"))]


def test_late_batches_become_gaps(spark, tmp_path):
    ship(spark)
    stream = source(spark, tmp_path, rows([1, 1, 1, 1, 1, 1]), files=2)
    got = streaming.drained(streaming.passages(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    assert {r.gap_reason for r in got.collect()} == {"NON_MONOTONIC_CAPTURE_TIME"}


def test_dedupe_and_windows(spark, tmp_path):
    stream = source(spark, tmp_path, rows([1, 2, 3, 4, 5, 6]), files=1)
    kept = streaming.drained(streaming.deduped(stream), f"{tmp_path}/out", f"{tmp_path}/state")
    assert kept.count() == 4
    counts = streaming.drained(streaming.window_counts(stream, "2 minutes"), f"{tmp_path}/out2", f"{tmp_path}/state2")
    assert counts.count() == 0  # the watermark is an hour behind
    named = streaming.with_stop_names(stream.withColumn("node_id", F.col("node_order")), spark.createDataFrame([(1, "first")], "node_id int, name string"))
    assert streaming.drained(named, f"{tmp_path}/out3", f"{tmp_path}/state3").where("name = 'first'").count() == 1


def test_sessions(spark, tmp_path):
    made = rows([1, 2, 3]) + [("R", 1, 4, datetime.datetime(2026, 8, 31, 5), 9, "z"), ("R", 1, 4, datetime.datetime(2026, 8, 31, 9), 10, "y")]
    s = streaming.sessions(source(spark, tmp_path, made, files=1))
    assert sorted(r.polls for r in streaming.drained(s, f"{tmp_path}/out", f"{tmp_path}/state").collect()) == [1, 3]  # the last one is still open


def test_polls_view(spark):
    assert tables.polls(spark, DIR).where("node_order between 1 and 12").count() == spark.read.parquet(f"{DIR}/events.parquet").count()
