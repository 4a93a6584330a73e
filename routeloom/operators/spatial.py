"""Joins in space by grid cells: an equi-join on cells, then the exact distance.

Cells are cubes around the unit sphere as wide as the search radius, so the 27 cells around a
point hold all its neighbours, at the poles and the date line too. The smaller side is copied 27
times; nothing is a cross join. Stops are far fewer than rows (distinct places), and cells bound
their density; a cell that is crowded is split by the join's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import PLANNER_RADIUS_M, chord_cell, haversine, unit_vector


def _cells(df: DataFrame, radius_m: float) -> DataFrame:
    x, y, z = chord_cell(F.col("latitude"), F.col("longitude"), radius_m)
    return df.where("latitude is not null and longitude is not null").withColumn("_x", x).withColumn("_y", y).withColumn("_z", z)


def _around(df: DataFrame) -> DataFrame:
    near = F.array(*map(F.lit, (-1, 0, 1)))
    for c in ("_x", "_y", "_z"):
        df = df.withColumn("_d", F.explode(near)).withColumn(c, F.col(c) + F.col("_d")).drop("_d")
    return df


def within(left: DataFrame, right: DataFrame, radius_m: float, sphere: float = PLANNER_RADIUS_M, also: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within the radius, with equal ``also`` columns. Both sides have latitude and longitude; the right side's columns get the prefix near_."""
    a = _around(_cells(left, radius_m))
    b = _cells(right, radius_m)
    b = b.select("_x", "_y", "_z", *also, *[F.col(c).alias(f"near_{c}") for c in right.columns if c not in also])
    d = haversine(F.col("latitude"), F.col("longitude"), F.col("near_latitude"), F.col("near_longitude"), sphere)
    # Spark takes a small file for a small table; what it would broadcast here grows with the input
    return a.hint("merge").join(b, ["_x", "_y", "_z", *also]).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m).drop("_x", "_y", "_z")


def places(seq: DataFrame) -> DataFrame:
    """One row for each stop that has a place; of differing ones the least."""
    placed = seq.where("latitude is not null and longitude is not null")
    return placed.groupBy("node_id").agg(F.min(F.struct("latitude", "longitude")).alias("x")).select("node_id", "x.latitude", "x.longitude")


def exact_transfers(seq: DataFrame, city: str = "city_code") -> DataFrame:
    """By stop of a city: how many ordered pairs of different routes meet, from alighting to boarding.

    Pairs are counted, not made: alighting times boarding routes less those that do both."""
    by = seq.groupBy(city, "node_id", "route_id").agg(F.max(F.col("can_alight").cast("int")).alias("a"), F.max(F.col("can_board").cast("int")).alias("b"))
    n = by.groupBy(city, "node_id").agg(F.sum("a").alias("alight"), F.sum("b").alias("board"), F.sum(F.col("a") * F.col("b")).alias("both"))
    return n.withColumn("transfers", F.col("alight") * F.col("board") - F.col("both")).where("transfers > 0")


def transfer_edges(states: DataFrame, radius_m: float) -> DataFrame:
    """Transfers between stops: the same stop (0 m), placed or not, before near ones; one row for each ordered pair of stops."""
    p = places(states)
    same = states.select("node_id").distinct().select(F.col("node_id").alias("from_node"), F.col("node_id").alias("to_node"), F.lit(0.0).alias("walk_m"), F.lit("shared_node_id").alias("kind"))
    near = within(p, p, radius_m).where("node_id <> near_node_id").select(F.col("node_id").alias("from_node"), F.col("near_node_id").alias("to_node"), F.col("distance_m").alias("walk_m"), F.lit("geodesic_proximity").alias("kind"))
    return same.unionByName(near)


def near_links(states: DataFrame, radius_m: float) -> DataFrame:
    """Links (a, b) that join the same stops as all pairs within the radius: stops of one place hang
    on its least one, and only those are paired, so a crowded place costs a row for each stop."""
    p = places(states)
    at = p.groupBy("latitude", "longitude").agg(F.min("node_id").alias("node_id"))
    same = p.withColumnRenamed("node_id", "b").join(at, ["latitude", "longitude"]).select(F.col("node_id").alias("a"), "b")
    near = within(at, at, radius_m).where("node_id < near_node_id").select(F.col("node_id").alias("a"), F.col("near_node_id").alias("b"))
    return same.unionByName(near)


def nearby(points: DataFrame, latitude: float, longitude: float, radius_m: float) -> DataFrame:
    """Rows within the radius of one point; the box on latitude goes to the scan."""
    span = radius_m / 111_000
    d = haversine(F.col("latitude"), F.col("longitude"), F.lit(latitude), F.lit(longitude))
    return points.where(F.col("latitude").between(latitude - span, latitude + span)).withColumn("distance_m", d).where(F.col("distance_m") <= radius_m)


def shared_pairs(seq: DataFrame, keys: list[str]) -> DataFrame:
    """Route pairs that share each stop, k (k - 1) / 2, without making them."""
    by = seq.groupBy(*keys).agg(F.count_distinct("route_id").alias("routes"))
    return by.where("routes > 1").withColumn("route_pairs", (F.col("routes") * (F.col("routes") - 1) / 2).cast("long"))


def spherical_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    x, y, z = unit_vector(F.col("latitude"), F.col("longitude"))
    s = df.where("latitude is not null").groupBy(*keys).agg(F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(z).alias("z"), F.count("*").alias("n"))
    length = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return s.select(*keys, "n", F.degrees(F.asin(F.col("z") / length)).alias("latitude"), F.degrees(F.atan2("y", "x")).alias("longitude"))


def conflicts(df: DataFrame, keys: list[str], limit_m: float, order: list[str]) -> DataFrame:
    """Keys whose rows lie farther than the limit from the first one that has a place."""
    rows = df.where("latitude is not null")
    anchor = rows.groupBy(*keys).agg(F.min_by(F.struct("latitude", "longitude"), F.struct(*order)).alias("a"))
    d = haversine(F.col("latitude"), F.col("longitude"), F.col("a.latitude"), F.col("a.longitude"))
    return rows.join(anchor, keys).groupBy(*keys).agg(F.max(d).alias("distance_m"), F.count("*").alias("n")).where(F.col("distance_m") > limit_m)
