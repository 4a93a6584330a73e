"""Journeys between stops: layers of rides, few labels of each state, paths carried along.

A state is a row of a route's sequence at which one boards. A label of a state is the way there:
rides (rows ridden), walk_mm (millimetres walked) and the path (route, boarding and alighting stop,
rows, walk ahead of it), which also names the routes in order (sig). Labels of one layer have equally many transfers, so they
compare by (rides, walk_mm, sig). One rides on within the direction segment and changes to another route
of the same city at the same stop, or to any other route at a stop within the radius; both need
the flags to alight and board. A route is boarded again only after another one.

A layer is three joins on keys (segment, stop, place); labels of many questions move together. What is
kept after each of them is bounded: ``k`` labels of a state, and of a stop or place those of the k + 1
routes that reach it best, k of each, which is enough for k labels of any route boarded there.

One walks between places, not between stops: the stops of a crowded place are never paired. A layer is first
boarded only where a ride leads to the question's destination, and in full only if the question goes on after it.
Up to FEW labels are broadcast to the rows that they join, more are sorted with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import dropped
from . import spatial

LEG = "array<struct<route_id:long,board_node:long,alight_node:long,rows:long,walk_mm:long>>"
FEW = 10_000
PREFERENCES = ("low_transfer", "reliable", "challenge", "diverse")


def walks(seq: DataFrame, radius_m: float) -> DataFrame:
    """(from_node, to_node, walk_mm) between stops within the radius, a placed stop and itself included."""
    p = spatial.places(seq)
    near = spatial.within(p, p, radius_m)
    return near.select(F.col("node_id").alias("from_node"), F.col("near_node_id").alias("to_node"), F.floor(F.col("distance_m") * 1000 + 0.5).cast("long").alias("walk_mm"))


def placed(states: DataFrame) -> DataFrame:
    """The rows with place, their coordinates, null unless both are there."""
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return states.withColumn("place", F.when(both, F.struct("latitude", "longitude")))


def place_walks(states: DataFrame, radius_m: float) -> DataFrame:
    """(from_node, to_node, walk_mm) between the places of placed() rows within the radius, for search() on those rows."""
    p = states.select(F.col("place").alias("node_id")).where("node_id is not null").distinct()
    return walks(p.select("node_id", "node_id.latitude", "node_id.longitude"), radius_m)


def _sized(df: DataFrame) -> DataFrame:
    """A saved table ahead of a join: broadcast if it has few rows; Spark itself goes by the size of files."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df.hint("merge")


def _key():
    return F.struct("rides", "walk_mm", "sig")


def _kept(labels: DataFrame, at: list[str], k: int) -> DataFrame:
    """Of each place the k best labels of each of the k + 1 routes that reach it best."""
    mine = Window.partitionBy(*at, "route_id")
    labels = labels.withColumn("_k", _key()).withColumn("_n", F.row_number().over(mine.orderBy("_k", "path"))).where(F.col("_n") <= k)
    labels = labels.withColumn("_r", F.min("_k").over(mine)).withColumn("_d", F.dense_rank().over(Window.partitionBy(*at).orderBy("_r", "route_id")))
    return labels.where(F.col("_d") <= k + 1).drop("_k", "_n", "_r", "_d")


def _ridden(labels: DataFrame, ahead: DataFrame, on: list[str], k: int) -> DataFrame:
    """Labels of states, as those of the stops that one ride reaches."""
    rode = labels.drop("place").join(ahead, on).where("to_pos > pos")
    n = F.col("to_pos") - F.col("pos")
    leg = F.struct("route_id", F.col("node_id").alias("board_node"), F.col("to_node").alias("alight_node"), n.cast("long").alias("rows"), F.col("foot").alias("walk_mm"))
    rode = rode.select("query_id", "route_id", "city_code", F.col("to_node").alias("node_id"), F.col("to_place").alias("place"), (F.col("rides") + n).alias("rides"), "walk_mm", "sig", F.concat("path", F.array(leg)).cast(LEG).alias("path"))
    return _kept(rode, ["query_id", "city_code", "node_id"], k)


def _walked(rode: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Labels at places within reach on foot. The city does not matter: of a place the best over all cities set out."""
    out = _kept(rode.where("place is not null"), ["query_id", "place"], k).withColumnRenamed("place", "from_node").join(near.withColumnRenamed("walk_mm", "foot").hint("merge"), "from_node")
    out = out.select("query_id", "route_id", F.col("to_node").alias("place"), "rides", (F.col("walk_mm") + F.col("foot")).alias("walk_mm"), "sig", "path", "foot")
    return _kept(out, ["query_id", "place"], k)


def _boarded(labels: DataFrame, board: DataFrame, on: list[str]) -> DataFrame:
    """Labels at stops, as labels of the states that other routes have there."""
    j = labels.withColumnRenamed("route_id", "_last").join(board, on).where(F.col("_last") != F.col("route_id"))
    return j.select("query_id", "route_id", "city_code", "segment_id", "pos", "node_id", "rides", "walk_mm", F.concat("sig", F.array("route_id")).alias("sig"), "path", "foot")


def _layer(rode: DataFrame, foot: DataFrame, board: DataFrame, seen: DataFrame | None, k: int, also: list[str]) -> DataFrame:
    """Labels of the states that are boarded next, at the stop or on foot; seen: segments boarded so far, if those of them are to be left out."""
    state = ["query_id", "route_id", "segment_id", "pos"]
    at_stop = _boarded(_sized(rode).drop("place").withColumn("foot", F.lit(0).cast("long")), board.drop("place"), ["node_id", "city_code", *also])
    both = at_stop.unionByName(_boarded(_sized(foot), board, ["place", *also]))
    # of one sig the best, then the k best
    both = both.groupBy(*state, "sig").agg(F.min(F.struct("rides", "walk_mm", "foot", "path", "city_code", "node_id")).alias("x")).select(*state, "sig", "x.*")
    new = both.withColumn("_n", F.row_number().over(Window.partitionBy(*state).orderBy(_key()))).where(F.col("_n") <= k).drop("_n")
    if seen is not None:
        seen = seen.groupBy("query_id", "route_id", "segment_id").agg(F.min("pos").alias("first_pos"))
        new = new.join(seen.hint("merge"), ["query_id", "route_id", "segment_id"], "left").where("first_pos is null or pos < first_pos").drop("first_pos")
        # boarding later is no use where an earlier row's label is as good all the way
        earlier = Window.partitionBy("query_id", "route_id", "segment_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        off = F.struct((F.col("rides") - F.col("pos")).alias("off"), "walk_mm", "sig")
        new = new.withColumn("_o", off).withColumn("_b", F.min("_o").over(earlier)).where("_b is null or _o < _b").drop("_o", "_b")
    return new


def search(seq: DataFrame, near: DataFrame, questions: DataFrame, save, k: int = 1, extra: int = 0, layers: int = 33) -> DataFrame:
    """query_id, transfers, rides, walk_mm, sig, path of the ways found, the best of each sig.

    seq: rows with route_id, city_code, segment_id, pos, node_id, can_board, can_alight, and maybe place, which near then
    is about; without it each stop is its own place. questions:
    query_id, origin, destination. A question's search ends ``extra`` layers after the first one
    that reaches its destination, or after ``layers`` rides. With k = 1 and extra = 0 a
    label is dropped if its segment was boarded at or ahead of its row in an earlier layer: all
    that it reaches has been reached with fewer transfers."""
    place = F.col("place") if "place" in seq.columns else F.col("node_id")
    rows = seq.select("route_id", "city_code", "segment_id", "pos", "node_id", place.alias("place"), "can_board", "can_alight")
    board = rows.where("can_board").drop("can_board", "can_alight")
    ahead = rows.where("can_alight").select("route_id", "segment_id", F.col("pos").alias("to_pos"), F.col("node_id").alias("to_node"), F.col("place").alias("to_place"))
    segment = ["query_id", "route_id", "segment_id"]
    zero = F.lit(0).cast("long")
    questions = save(questions)
    made = [questions]

    def keep(df: DataFrame) -> DataFrame:
        made.append(save(df))
        return made[-1]

    first = _sized(questions).select("query_id", F.col("origin").alias("node_id")).join(board, "node_id")
    labels = keep(first.select("query_id", "route_id", "city_code", "segment_id", "pos", "node_id", zero.alias("rides"), zero.alias("walk_mm"), F.array("route_id").alias("sig"), F.array().cast(LEG).alias("path"), zero.alias("foot")))
    # the rows where a question's last ride ends, and those where it can begin
    goal = keep(_sized(questions).select("query_id", F.col("destination").alias("to_node")).join(ahead, "to_node"))
    last = goal.groupBy(*segment).agg(F.max("to_pos").alias("last_pos"))
    last = keep(last)
    closing = keep(_sized(last).join(board, segment[1:]).where("pos < last_pos").drop("last_pos"))
    prune = k == 1 and extra == 0

    def arrived(labels: DataFrame, layer: int) -> DataFrame:
        return keep(_ridden(labels, _sized(goal), segment, k).select("query_id", F.lit(layer).alias("transfers"), "rides", "walk_mm", "sig", "path"))

    def unfinished(layer: int) -> DataFrame:
        done = _all(ended).groupBy("query_id").agg(F.min("transfers").alias("t")).where(F.col("t") + extra <= layer)
        return keep(questions.select("query_id").join(done, "query_id", "left_anti"))

    boarded, ended = [labels], [arrived(labels, 0)]
    going = unfinished(0)
    for layer in range(1, layers):
        if going.isEmpty() or labels.isEmpty():
            break
        rode = keep(_ridden(_sized(labels).join(_sized(going), "query_id", "left_semi"), ahead, segment[1:], k))
        foot = keep(_walked(rode, near, k))
        seen = _all(boarded, "query_id", "route_id", "segment_id", "pos") if prune else None
        ended.append(arrived(_layer(rode, foot, _sized(closing), seen.join(_sized(last), segment, "left_semi") if prune else None, k, ["query_id"]), layer))
        if layer == layers - 1:
            break
        going = unfinished(layer)
        if going.isEmpty():
            break
        on = lambda df: keep(df.join(_sized(going), "query_id", "left_semi"))
        labels = keep(_layer(on(rode), on(foot), board, seen, k, []))
        boarded.append(labels)
    best = _all(ended).groupBy("query_id", "sig").agg(F.min(F.struct("transfers", "rides", "walk_mm", "path")).alias("x"))
    out = save(best.select("query_id", "x.transfers", "x.rides", "x.walk_mm", "sig", "x.path"))
    dropped(*made)
    return out


def _all(frames: list, *columns: str) -> DataFrame:
    out = None
    for x in frames:
        x = x.select(*columns) if columns else x
        out = x if out is None else out.unionByName(x)
    return out


def generalized():
    """Rows ridden, six for each transfer, one for each 120 m walked."""
    return F.round(F.col("rides") + F.col("transfers") * 6.0 + F.col("walk_mm") / 120_000.0, 9)


def choice_key(preference: str):
    plain = (generalized().alias("cost"), F.col("transfers"), F.col("walk_mm"), F.col("sig"))
    if preference == "low_transfer":
        return F.struct("transfers", "rides", "walk_mm", "sig")
    if preference == "challenge":
        return F.struct((-F.size("sig")).alias("routes"), *plain)
    return F.struct(*plain)


def likeness(a, b):
    """Share of common routes of two sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union)


def chosen(ways: DataFrame, preference: str, most: int = 3) -> DataFrame:
    """The ways with their rank in the preference's order, up to ``most`` of each question.

    low_transfer: transfers, rides, walk. reliable: the generalised cost. challenge: most routes first.
    diverse: the best by cost, then the one least like those chosen, in turn; each turn is one aggregate over all
    ways, and what is joined to them is the few chosen ones, by query_id."""
    if preference not in PREFERENCES:
        raise ValueError(preference)
    rows = ways.withColumn("_key", choice_key(preference))
    if preference != "diverse":
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("_key"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= most).drop("_key")
    picked = rows.groupBy("query_id").agg(F.array(F.min("_key")["sig"]).alias("_sigs"))
    for _ in range(most - 1):
        j = rows.join(picked, "query_id")
        alike = F.round(F.array_max(F.transform("_sigs", lambda s: likeness(F.col("sig"), s))), 9)
        free = ~F.array_contains("_sigs", F.col("sig"))
        best = j.groupBy("query_id").agg(F.min(F.when(free, F.struct(alike.alias("alike"), "_key"))).alias("x"), F.first("_sigs").alias("_sigs"))
        more = F.when(F.col("x").isNull(), F.col("_sigs")).otherwise(F.concat("_sigs", F.array(F.col("x._key.sig"))))
        picked = best.select("query_id", more.alias("_sigs"))
    order = picked.select("query_id", F.posexplode("_sigs").alias("_at", "sig")).withColumn("rank", F.col("_at") + 1).drop("_at")
    return rows.drop("_key").join(order, ["query_id", "sig"])


def steps(ways: DataFrame) -> DataFrame:
    """The steps of each way in order: rides, and ahead of a ride the change (transfer at a stop, walk between stops)."""
    legs = ways.select("query_id", "rank", F.posexplode("path").alias("n", "leg"))
    before = F.lag("leg.alight_node").over(Window.partitionBy("query_id", "rank").orderBy("n"))
    legs = legs.withColumn("_from", before)
    ride = F.struct(F.lit("ride").alias("kind"), F.col("leg.route_id").alias("route_id"), F.col("leg.board_node").alias("from_node"), F.col("leg.alight_node").alias("to_node"), F.col("leg.rows").alias("rows"), F.lit(0).cast("long").alias("walk_mm"))
    kind = F.when((F.col("_from") == F.col("leg.board_node")) & (F.col("leg.walk_mm") == 0), "transfer").otherwise("walk")
    change = F.struct(kind.alias("kind"), F.lit(None).cast("long").alias("route_id"), F.col("_from").alias("from_node"), F.col("leg.board_node").alias("to_node"), F.lit(0).cast("long").alias("rows"), F.col("leg.walk_mm").alias("walk_mm"))
    both = legs.select("query_id", "rank", "n", F.posexplode(F.when(F.col("_from").isNull(), F.array(ride)).otherwise(F.array(change, ride))).alias("m", "s"))
    step = F.row_number().over(Window.partitionBy("query_id", "rank").orderBy("n", "m"))
    return both.select("query_id", "rank", step.alias("step"), "s.*")
