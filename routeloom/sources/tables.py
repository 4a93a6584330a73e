"""Transit views over the order tables: routes are orders, stops parts, polls events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinates(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    real = k % 97 != 0
    return df.withColumn("latitude", F.when(real, F.lit(36.0) + (k * 37 % 400).cast("double") / 1000)).withColumn("longitude", F.when(real, F.lit(127.0) + (k * 61 % 400).cast("double") / 1000))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """route_id, city_code, status, priority, captured_at of all catalog routes."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("route_id"), F.col("c_nationkey").alias("city_code"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("captured_at"), F.col("o_totalprice").alias("price"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("node_name"), F.col("p_brand").alias("city_name"), "p_size")
    return coordinates(p, "node_id")


def sequence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ordered stop sequences without positions."""
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route_id"), F.col("l_partkey").alias("node_id"), F.col("l_linenumber").alias("node_order"), F.col("l_suppkey").alias("tie"),
        F.when(F.col("l_suppkey") % 11 == 0, "").otherwise(F.col("l_linestatus")).alias("direction"),
        (F.col("l_returnflag") != "R").alias("can_board"), (F.col("l_returnflag") != "A").alias("can_alight"),
    )
    return coordinates(df, "node_id")


ORDER = ("node_order", "node_id", "tie")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence rows with pos, the place from 0 in the route."""
    return sequence_rows(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("route_id").orderBy(*ORDER)) - 1)


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vehicle positions: route_id, vehicle_no, node_order, observed_at, poll_id."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("route_id"), F.col("user_id").alias("vehicle_no"), (F.floor("value") % 12 + 1).cast("int").alias("node_order"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("event_id").alias("poll_id"), "value")


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip_id, stop_id, stop_sequence, arrival and departure seconds, pickup and drop-off flags."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"), F.col("l_linenumber").alias("stop_sequence"), F.col("l_suppkey").alias("tie"), (F.col("l_linenumber") * 1800 + F.col("l_partkey") % 1800).cast("long").alias("departure_seconds"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("pickup_type"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("drop_off_type"))


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("route_id"), F.col("o_orderpriority").alias("service_id"), F.to_date("o_orderdate").alias("service_date"), F.col("o_orderstatus").alias("status"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar for each service: all days between the first and last date that it runs on, weekday flags by priority."""
    first = F.substring("service_id", 1, 1).cast("int")
    cal = trips(spark, sf_dir).groupBy("service_id").agg(F.min("service_date").alias("start_date"), F.max("service_date").alias("end_date"))
    for i, day in enumerate(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")):
        cal = cal.withColumn(day, (F.lit(i) + first) % 3 != 0)
    return cal
