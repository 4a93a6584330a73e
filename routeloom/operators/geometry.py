"""Map lines: projection of stops, oriented chains, chunks for a road router."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine, segment_projection


def segments(points: DataFrame, line: str = "line_id") -> DataFrame:
    """Consecutive points of each line as segments; points: line_id, n, lon, lat."""
    w = Window.partitionBy(line).orderBy("n")
    df = points.select(line, "n", F.col("lon").alias("ax"), F.col("lat").alias("ay"), F.lead("lon").over(w).alias("bx"), F.lead("lat").over(w).alias("by"))
    return df.where("bx is not null")


def project(stops: DataFrame, segs: DataFrame, line: str = "line_id", most: int = 1) -> DataFrame:
    """The ``most`` nearest places of each stop on its line: segment, fraction, distance.

    Longitudes are shrunk by the stop's latitude, so a plane serves for nearby lines."""
    k = F.cos(F.radians("lat"))
    t, _ = segment_projection(F.col("lon") * k, F.col("lat"), F.col("ax") * k, F.col("ay"), F.col("bx") * k, F.col("by"))
    j = stops.join(segs, line).withColumn("fraction", t)
    x, y = F.col("ax") + F.col("fraction") * (F.col("bx") - F.col("ax")), F.col("ay") + F.col("fraction") * (F.col("by") - F.col("ay"))
    j = j.withColumn("distance_m", haversine(F.col("lat"), F.col("lon"), y, x))
    if most == 1:
        best = j.groupBy(line, "stop_id").agg(F.min(F.struct("distance_m", "n", "fraction")).alias("b"))
        return best.select(line, "stop_id", F.col("b.n").alias("n"), F.col("b.fraction").alias("fraction"), F.col("b.distance_m").alias("distance_m"))
    w = Window.partitionBy(line, "stop_id").orderBy("distance_m", "n")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(line, "stop_id", "rank", "n", "fraction", "distance_m")


def clipped(points: DataFrame, first: DataFrame, line: str = "line_id") -> DataFrame:
    """Points of each line strictly between two projections; first: line_id, from_n, to_n."""
    return points.join(first, line).where((F.col("n") > F.col("from_n")) & (F.col("n") <= F.col("to_n")))


def chains(points: DataFrame, line: str = "line_id", gap_m: float = 500) -> DataFrame:
    """Adds chain: a new one starts where the next point is farther than the gap."""
    w = Window.partitionBy(line).orderBy("n")
    d = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return points.withColumn("_j", (F.coalesce(d, F.lit(0.0)) > gap_m).cast("int")).withColumn("chain", F.sum("_j").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_j")


def deduped_line(line: Column) -> Column:
    """Array of points without consecutive repeats."""
    return F.filter(line, lambda p, i: (i == 0) | (p != F.element_at(line, F.greatest(i, F.lit(1)))))


def chunks(line: Column, size: int) -> Column:
    """Overlapping pieces of up to ``size`` points; each starts with the last point of the one before."""
    n = F.size(line)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)), F.lit(size - 1))
    return F.transform(starts, lambda i: F.slice(line, i, size))


def oriented(parts: Column) -> Column:
    """Parts of a line, each turned so that it continues the one before: a two-state dynamic programme
    over (cost if kept, cost if turned) as one fold; all in the row, without a UDF."""

    def gap(a, b):
        return haversine(a["lat"], a["lon"], b["lat"], b["lon"])

    def head(p, turned):
        return F.element_at(p, -1) if turned else F.element_at(p, 1)

    def tail(p, turned):
        return F.element_at(p, 1) if turned else F.element_at(p, -1)

    first = F.element_at(parts, 1)
    point = "struct<lon:double,lat:double>"
    state = f"struct<k:double,t:double,kw:array<int>,tw:array<int>,kp:{point},tp:{point}>"
    start = F.struct(F.lit(0.0).alias("k"), F.lit(0.0).alias("t"), F.array(F.lit(0)).alias("kw"), F.array(F.lit(1)).alias("tw"), tail(first, False).alias("kp"), tail(first, True).alias("tp")).cast(state)

    def step(s, p):
        def best(turned):
            a, b = s["k"] + gap(s["kp"], head(p, turned)), s["t"] + gap(s["tp"], head(p, turned))
            return F.least(a, b), F.concat(F.when(a <= b, s["kw"]).otherwise(s["tw"]), F.array(F.lit(int(turned))))

        (k, kw), (t, tw) = best(False), best(True)
        return F.struct(k.alias("k"), t.alias("t"), kw.alias("kw"), tw.alias("tw"), tail(p, False).alias("kp"), tail(p, True).alias("tp")).cast(state)

    end = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), start, step)
    turns = F.when(end["k"] <= end["t"], end["kw"]).otherwise(end["tw"])
    return F.zip_with(parts, turns, lambda p, t: F.when(t == 1, F.reverse(p)).otherwise(p))


def relation_score(lines: DataFrame, stops: DataFrame) -> DataFrame:
    """How far each candidate line lies from the stops: ends count twice. Lines and stops share route_id."""
    near = project(stops.join(lines.select("route_id", "line_id").distinct(), "route_id").select("line_id", "stop_id", "lon", "lat", "weight"), segments(lines))
    w = stops.select("stop_id", "weight").distinct()
    return near.join(w, "stop_id").groupBy("line_id").agg((F.sum(F.col("distance_m") * F.col("weight")) / F.sum("weight")).alias("score"))


def inside_box(lines: Column, south: float, north: float, west: float, east: float) -> Column:
    """Lines (arrays of lon, lat) with two points or more, all of them in the box."""

    def fits(p):
        return p["lat"].between(south, north) & p["lon"].between(west, east)

    return F.filter(lines, lambda line: (F.size(line) >= 2) & F.forall(line, fits))


def endpoint_gap(a: Column, b: Column) -> Column:
    """Least distance between the ends of two lines."""
    ends = [(F.element_at(a, i), F.element_at(b, j)) for i in (1, -1) for j in (1, -1)]
    return F.least(*[haversine(p["lat"], p["lon"], q["lat"], q["lon"]) for p, q in ends])
