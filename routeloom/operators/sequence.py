"""Ordered stop sequences: edges, direction segments, anomalies, origin-destination pairs.

A direction boundary lies between adjacent rows whose directions are both non-empty and differ; a
blank between two codes hides it. Rows need route_id, pos, node_id, node_order, direction,
latitude, longitude, can_board and can_alight. One shuffle by route serves all windows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import AUDIT_RADIUS_M, haversine

def route():
    return Window.partitionBy("route_id").orderBy("pos")


def boundary() -> Column:
    last = F.lag("direction").over(route())
    return F.coalesce((last != "") & (F.col("direction") != "") & (last != F.col("direction")), F.lit(False))


def with_segments(seq: DataFrame) -> DataFrame:
    """Adds segment_id: the number of direction boundaries up to the row."""
    return seq.withColumn("_b", boundary().cast("long")).withColumn("segment_id", F.sum("_b").over(route().rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_b")


def ride_edges(seq: DataFrame) -> DataFrame:
    """Edges between consecutive rows of a route that no direction boundary parts."""
    d = F.lead("direction").over(route())
    df = seq.select("route_id", "pos", F.col("node_id").alias("from_node"), F.lead("node_id").over(route()).alias("to_node"), ((F.col("direction") != "") & (d != "") & (F.col("direction") != d)).alias("_cut"))
    return df.where("to_node is not null and not _cut").drop("_cut")


def order_anomalies(seq: DataFrame) -> DataFrame:
    """By route: gaps in the published order, orders that do not increase, stops that follow themselves."""
    step = F.col("node_order") - F.lag("node_order").over(route())
    df = seq.select("route_id", step.alias("step"), (F.col("node_id") == F.lag("node_id").over(route())).alias("loop"))
    return df.groupBy("route_id").agg(F.count_if(F.col("step") > 1).alias("order_gaps"), F.count_if(F.col("step") <= 0).alias("non_increasing"), F.count_if("loop").alias("self_loops"))


def repeated_nodes(seq: DataFrame) -> DataFrame:
    return seq.groupBy("route_id", "node_id").agg(F.count("*").alias("visits")).where("visits > 1")


def spikes(seq: DataFrame, away_m: float = 20_000, back_m: float = 5_000) -> DataFrame:
    """Single points far from both neighbours, which are near each other, in one named direction."""
    lat, lon = F.col("latitude"), F.col("longitude")
    n = {i: {c: F.lead(c, i).over(route()) for c in ("latitude", "longitude", "direction", "node_id")} for i in (1, 2)}
    df = seq.select("route_id", (F.col("pos") + 1).alias("pos"), n[1]["node_id"].alias("node_id"), haversine(lat, lon, n[1]["latitude"], n[1]["longitude"], AUDIT_RADIUS_M).alias("ab"), haversine(n[1]["latitude"], n[1]["longitude"], n[2]["latitude"], n[2]["longitude"], AUDIT_RADIUS_M).alias("bc"), haversine(lat, lon, n[2]["latitude"], n[2]["longitude"], AUDIT_RADIUS_M).alias("ac"), ((F.col("direction") != "") & (F.col("direction") == n[1]["direction"]) & (F.col("direction") == n[2]["direction"])).alias("same"))
    return df.where((F.col("same")) & (F.col("ab") > away_m) & (F.col("bc") > away_m) & (F.col("ac") < back_m)).select("route_id", "pos", "node_id")


def long_segments(seq: DataFrame, limits: tuple[int, int] = (5_000, 20_000)) -> DataFrame:
    """By route: steps longer than the limits; a row without coordinates breaks the chain."""
    d = haversine(F.lag("latitude").over(route()), F.lag("longitude").over(route()), F.col("latitude"), F.col("longitude"), AUDIT_RADIUS_M)
    return seq.select("route_id", d.alias("d")).groupBy("route_id").agg(F.count_if(F.col("d") > limits[0]).alias("over_5km"), F.count_if(F.col("d") > limits[1]).alias("over_20km"), F.count("d").alias("measured"))


def forward_od_pairs(seq: DataFrame, directional: bool = False) -> DataFrame:
    """Pairs of a boardable row and a later alightable one, by route or by direction segment."""
    keys = ["route_id", "segment_id"] if directional else ["route_id"]
    df = with_segments(seq) if directional else seq
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    df = df.select(*keys, F.when(F.col("can_alight"), F.coalesce(F.sum(F.col("can_board").cast("long")).over(w), F.lit(0))).otherwise(0).alias("n"))
    return df.groupBy(*keys).agg(F.sum("n").alias("od_pairs"))


def integrity(seq: DataFrame) -> DataFrame:
    """One row: sequences and rows, and how many sequences show each anomaly."""
    step = F.col("node_order") - F.lag("node_order").over(route())
    both = F.col("latitude").isNull() != F.col("longitude").isNull()
    rows = seq.select("route_id", "node_order", step.alias("step"), F.col("latitude").isNull().alias("missing"), both.alias("half"), (~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180)).alias("out"))
    by = rows.groupBy("route_id").agg(F.count("*").alias("n"), F.max("node_order").alias("declared"), F.count_if(F.col("step") <= 0).alias("order_bad"), F.count_if("missing").alias("missing"), F.count_if(F.col("half") | F.coalesce("out", F.lit(False))).alias("bad_place"))
    few, declared, order, place = F.col("n") < 2, F.col("n") != F.col("declared"), F.col("order_bad") > 0, F.col("bad_place") > 0
    return by.agg(
        F.count("*").alias("sequences"), F.sum("n").alias("row_count"), F.count_if(few).alias("fewer_than_two"), F.count_if(declared).alias("declared_mismatch"),
        F.count_if(order).alias("order_issue"), F.sum("missing").alias("missing_coordinates"), F.sum("bad_place").alias("bad_coordinates"), F.count_if(few | declared | order | place).alias("anomalous"),
    )


def reachable(seq: DataFrame) -> DataFrame:
    """Rows that can be ridden to from each boardable row: later in the same segment, alightable."""
    s = with_segments(seq)
    a = s.where("can_board").select("route_id", "segment_id", F.col("pos").alias("from_pos"), F.col("node_id").alias("from_node"))
    b = s.where("can_alight").select("route_id", "segment_id", F.col("pos").alias("to_pos"), F.col("node_id").alias("to_node"))
    return a.join(b, ["route_id", "segment_id"]).where("to_pos > from_pos")


def islands(df: DataFrame, part: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal values: run number, first and last place and length."""
    w = Window.partitionBy(part).orderBy(*order)
    df = df.withColumn("_p", F.row_number().over(w) - 1).withColumn("_c", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1)))
    df = df.withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(part, "run", value).agg(F.min("_p").alias("first_pos"), F.max("_p").alias("last_pos"), F.count("*").alias("length"))


def uniform_sample(seq: DataFrame, part: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spread, both ends kept."""
    n = F.count("*").over(Window.partitionBy(part))
    df = seq.withColumn("_n", n)
    # row p is kept if it is the place of one of the ``most`` even steps: floor(k * (n - 1) / (most - 1))
    k = F.ceil(F.col("pos") * (most - 1) / (F.col("_n") - 1))
    at = F.floor(k * (F.col("_n") - 1) / (most - 1))
    return df.where((F.col("_n") <= most) | (at == F.col("pos"))).drop("_n")


def validator_counters(seq: DataFrame) -> DataFrame:
    """One row of counters over all sequences: order, direction, stops and coordinates of adjacent rows.

    All flags come from one window by route; a route's flags are summed before anything is shuffled again."""
    w = route()
    last = lambda c: F.lag(c).over(w)
    step = F.col("node_order") - last("node_order")
    turned = F.coalesce((F.col("direction") != "") & (last("direction") != "") & (F.col("direction") != last("direction")), F.lit(False))
    # a row without a valid place parts the rows around it
    distance = haversine(last("latitude"), last("longitude"), F.col("latitude"), F.col("longitude"), AUDIT_RADIUS_M)
    gap = step > 1
    repeat = F.row_number().over(Window.partitionBy("route_id", "node_id").orderBy("pos")) > 1
    flags = {
        "negative_order_rows": F.col("node_order") < 0, "edges": step.isNotNull(), "non_increasing_edges": step <= 0, "order_gap_edges": gap, "boundary_gap_edges": gap & turned, "same_direction_gap_edges": gap & ~turned,
        "self_loop_edges": F.col("node_id") == last("node_id"), "direction_change_edges": turned, "repeated_node_rows": repeat, "blank_direction_rows": F.col("direction") == "",
        "missing_coordinate_rows": F.col("latitude").isNull() & F.col("longitude").isNull(), "partial_coordinate_rows": F.col("latitude").isNull() != F.col("longitude").isNull(),
        "out_of_range_rows": ~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180),
        **{f"segments_over_{k}km": distance > k * 1000 for k in (5, 20)}, **{f"boundaries_over_{m}m": turned & (distance > m) for m in (300, 1000, 5000)},
    }
    marked = seq.select("route_id", *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in flags.items()])
    by = marked.groupBy("route_id").agg(F.count("*").alias("rows"), *[F.sum(n).alias(n) for n in flags])
    return by.agg(F.count("*").alias("sequences"), F.sum("rows").alias("rows"), *[F.sum(n).alias(n) for n in flags])


def between_orders(seq: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of a ride: of each asked (route_id, from_pos, to_pos) those from one end to the other."""
    return asked.join(seq, "route_id").where("pos between from_pos and to_pos")
