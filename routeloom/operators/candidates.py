"""What is said about a journey: evidence, endpoints, frontiers, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import spatial

#: Width of the ranges that a frontier is cut into.
FRONTIER_STEP = 4096


def decorate(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Coverage of each candidate by its least observed route, and why it is not verified.

    A generated journey never gets a probability. candidates: path_id, routes; evidence: route_id, observations, passages."""
    each = candidates.select("path_id", F.explode("routes").alias("route_id")).distinct().join(evidence, "route_id", "left")
    by = each.groupBy("path_id").agg(F.count("*").alias("routes"), F.count_if(F.coalesce("observations", F.lit(0)) > 0).alias("observed"), F.min(F.coalesce("passages", F.lit(0))).alias("least_passages"))
    reasons = F.filter(F.array(F.when(F.col("observed") == 0, "NO_SERVICE_EVIDENCE"), F.when((F.col("observed") > 0) & (F.col("observed") < F.col("routes")), "PARTIAL_SERVICE_EVIDENCE"), F.when(F.col("least_passages") == 0, "NO_PASSAGE_HISTORY")), lambda x: x.isNotNull())
    status = F.when(F.size("reasons") == 0, "evidence_complete").when(F.col("observed") > 0, "evidence_partial").otherwise("structural_only")
    return by.withColumn("reasons", reasons).withColumn("status", status).withColumn("success_probability", F.lit(None).cast("double"))


def counterparts(stops: DataFrame, name: str, radius_m: float) -> DataFrame:
    """Other stops of exactly the same name within the radius: node_id, the name, other_id, distance_m.

    Distances are taken once for each two places of a name, by an equi-join on the name and the cells of a grid as
    wide as the radius; stops then join the places that they lie at. Nothing is broadcast: all sides grow with the stops."""
    at = stops.where("latitude is not null and longitude is not null").select("node_id", name, "latitude", "longitude")
    places = at.select(name, "latitude", "longitude").distinct()
    near = spatial.within(places, places, radius_m, also=(name,)).select(name, "latitude", "longitude", "near_latitude", "near_longitude", "distance_m")
    other = at.select(F.col("node_id").alias("other_id"), name, F.col("latitude").alias("near_latitude"), F.col("longitude").alias("near_longitude"))
    pairs = at.hint("merge").join(near, [name, "latitude", "longitude"]).hint("merge").join(other, [name, "near_latitude", "near_longitude"])
    return pairs.where(F.col("node_id") != F.col("other_id")).select("node_id", name, "other_id", "distance_m")


def frontier(labels: DataFrame, keys: list[str], first: str, second: str, tie: str) -> DataFrame:
    """Labels that none of their group beats in both measures.

    Of each first value only the least second one can stay, so the window runs over one row for each of them; the
    window's rows are cut into ranges of the first measure, each told the least second measure ahead of it."""
    best = labels.groupBy(*keys, first).agg(F.min(F.struct(second, tie, *[c for c in labels.columns if c not in (*keys, first, second, tie)])).alias("_x"))
    best = best.select(*keys, first, "_x.*")
    best = best.withColumn("_part", F.floor(F.col(first) / FRONTIER_STEP))
    ahead = best.groupBy(*keys, "_part").agg(F.min(second).alias("_least"))
    ahead = ahead.withColumn("_ahead", F.min("_least").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    w = Window.partitionBy(*keys, "_part").orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    rows = best.join(ahead, [*keys, "_part"]).withColumn("_m", F.least(F.min(second).over(w), "_ahead"))
    return rows.where(F.col("_m").isNull() | (F.col(second) < F.col("_m"))).select(*labels.columns)


def sections(steps: DataFrame) -> DataFrame:
    """Steps of a path folded into rides of one route; steps: path_id, n, route_id, from_node, to_node."""
    w = Window.partitionBy("path_id").orderBy("n")
    df = steps.withColumn("_c", F.coalesce((F.col("route_id") != F.lag("route_id").over(w)).cast("int"), F.lit(1))).withColumn("section", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy("path_id", "section", "route_id").agg(F.count("*").alias("rides"), F.min_by("from_node", "n").alias("board"), F.max_by("to_node", "n").alias("alight"))


def boxed(df: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Rows in a box; one whose west lies east of its east crosses the date line."""
    lon = F.col("longitude").between(west, east) if west <= east else (F.col("longitude") >= west) | (F.col("longitude") <= east)
    return df.where(F.col("latitude").between(south, north) & lon)


def component_summary(labels: DataFrame) -> DataFrame:
    """Components, the largest, single nodes and connected pairs. labels: node, root."""
    size = labels.groupBy("root").agg(F.count("*").alias("n"))
    return size.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("connected_pairs"))
