"""Static schedules: references, time order, patterns, service days, boardings, earliest arrival."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import DAYS, runs_on
from ..storage import dropped


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Distinct references that have no target, with the number of rows that use them."""
    return children.join(parents.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("rows"))


def time_disorder(times: DataFrame) -> DataFrame:
    """Rows that leave before a row ahead of them in the trip; rows without times are skipped."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence", "stop_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    return times.withColumn("last_s", F.max("departure_seconds").over(w)).where("departure_seconds < last_s")


def patterns(times: DataFrame, trips: DataFrame) -> DataFrame:
    """Trips of a route with equal ordered (stop, pickup, drop-off) are one pattern."""
    stop = F.struct("stop_sequence", "stop_id", "tie", "pickup_type", "drop_off_type")
    by = times.groupBy("trip_id").agg(F.array_sort(F.collect_list(stop)).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["stop_id"], x["pickup_type"], x["drop_off_type"])), "|")
    one = by.select("trip_id", F.size("s").alias("stop_count"), text.alias("stops"))
    one = one.join(trips.select("trip_id", "route_id"), "trip_id")
    return one.groupBy("route_id", "stops").agg(F.count("*").alias("trips"), F.min("trip_id").alias("representative_trip_id"), F.first("stop_count").alias("stop_count"))


def operating(services: DataFrame, exceptions: DataFrame, first: str, last: str) -> DataFrame:
    """(service_id, service_date) that run on the dates from first to last."""
    return operating_between(services, exceptions, F.lit(first).cast("date"), F.lit(last).cast("date"))


def operating_between(services: DataFrame, exceptions: DataFrame, first, last) -> DataFrame:
    every = services.withColumn("service_date", F.explode(F.sequence(first, last)))
    out = every.join(exceptions, ["service_id", "service_date"], "left")
    return out.where(runs_on(F.col("service_date"), F.col("start_date"), F.col("end_date"), [F.col(d) for d in DAYS], F.col("exception_type"))).select("service_id", "service_date")


def boardings(times: DataFrame, trips: DataFrame, running: DataFrame, from_s: int, to_s: int, most: int) -> DataFrame:
    """The first departures of each stop in a range of seconds, on trips of running services."""
    some = times.where((F.col("departure_seconds") >= from_s) & (F.col("departure_seconds") < to_s) & (F.col("pickup_type") == 0))
    live = trips.join(running.select("service_id", "service_date"), ["service_id", "service_date"], "left_semi")
    j = some.join(live.select("trip_id", "service_id"), "trip_id")
    w = Window.partitionBy("stop_id").orderBy("departure_seconds", "trip_id", "stop_sequence", "tie")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def exact_record(times: DataFrame, trips: DataFrame, services: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked trips and stops (trip_id, stop_id) with their service's range."""
    return times.join(asked.select("trip_id", "stop_id").distinct(), ["trip_id", "stop_id"]).join(trips, "trip_id").join(services.select("service_id", "start_date", "end_date"), "service_id")


def trip_calendars(trips: DataFrame, services: DataFrame) -> DataFrame:
    """Trips with the calendar of their service."""
    return trips.drop("service_date").join(services, "service_id")


def broken_references(references: dict) -> DataFrame:
    """reference, rows and distinct targets that are missing; each is (children, key, parents, key of these)."""
    out = None
    for name, (children, key, parents, own) in references.items():
        lost = children.select(F.col(key).alias("k")).join(parents.select(F.col(own).alias("k")), "k", "left_anti")
        one = lost.agg(F.count("*").alias("rows"), F.count_distinct("k").alias("targets")).select(F.lit(name).alias("reference"), "rows", "targets")
        out = one if out is None else out.unionByName(one)
    return out


def dated_rides(times: DataFrame, trips: DataFrame, services: DataFrame, exceptions: DataFrame, day: str) -> DataFrame:
    """Rows of trips on the day before, the day and the day after, on one clock that starts at the day's midnight.

    A trip whose times fall anywhere is left out, as is a service that does not run on the date."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence", "stop_id", "tie")
    rows = times.withColumn("n", F.row_number().over(w)).withColumn("_last", F.lag("departure_seconds").over(w))
    rows = rows.withColumn("_bad", F.max((F.col("departure_seconds") < F.col("_last")).cast("int")).over(Window.partitionBy("trip_id"))).where("coalesce(_bad, 0) = 0")
    first = F.lit(day).cast("date")
    dates = operating_between(services, exceptions, F.date_sub(first, 1), F.date_add(first, 1))
    dates = dates.select("service_id", F.datediff("service_date", first).alias("day_offset"))
    running = trips.join(dates, "service_id").select("trip_id", "day_offset")
    return rows.join(running, "trip_id").select("trip_id", "day_offset", F.col("stop_id").alias("stop"), "n", (F.col("departure_seconds") + F.col("day_offset") * 86_400).alias("t"), "pickup_type", "drop_off_type")


def scheduled_arrival(rides: DataFrame, starts: DataFrame, buffer_s: int, horizon_s: int, save) -> DataFrame:
    """(query_id, stop, arrival, round): least arrival at each stop that can be reached within the horizon.

    rides as dated_rides() gives them; starts: query_id, stop, arrival. A round boards each dated trip at
    its first row that can be reached in time (after the buffer, but for the origin), and keeps the least
    arrival of each stop; it ends when nothing improves, so the number of boardings is not bounded."""
    end = starts.select("query_id", (F.col("arrival") + horizon_s).alias("end_t"))
    rides = save(rides)
    best = save(starts.select("query_id", "stop", "arrival", F.lit(0).alias("round")).join(end, "query_id"))
    for r in count(1):
        front = best.where(F.col("round") == r - 1)
        wait = F.when(F.col("round") == 0, 0).otherwise(buffer_s)
        board = rides.where("pickup_type = 0").join(front, "stop").where((F.col("t") >= F.col("arrival") + wait) & (F.col("t") <= F.col("end_t")))
        board = board.groupBy("query_id", "end_t", "trip_id", "day_offset").agg(F.min("n").alias("first_n"))
        reached = board.join(rides, ["trip_id", "day_offset"]).where("n > first_n and drop_off_type = 0 and t <= end_t")
        reached = reached.groupBy("query_id", "stop", "end_t").agg(F.min("t").alias("arrival")).withColumn("round", F.lit(r))
        new = best.unionByName(reached).groupBy("query_id", "stop", "end_t").agg(F.min(F.struct("arrival", "round")).alias("x")).select("query_id", "stop", "x.arrival", "x.round", "end_t")
        before, best = best, save(new)
        if best.where(F.col("round") == r).isEmpty():
            dropped(before, rides)
            return best.drop("end_t")
        dropped(before)


def connections(times: DataFrame) -> DataFrame:
    """Rides between consecutive rows of a trip, by departure and arrival seconds."""
    w = Window.partitionBy("trip_id").orderBy("stop_sequence", "stop_id", "tie")
    df = times.select("trip_id", F.col("stop_id").alias("from_stop"), F.col("departure_seconds").alias("depart"), F.lead("stop_id").over(w).alias("to_stop"), F.lead("departure_seconds").over(w).alias("arrive"), F.col("pickup_type"))
    return df.where("to_stop is not null and arrive >= depart")


def earliest_arrival(conns: DataFrame, starts: DataFrame, buffer_s: int, rounds: int | None, save) -> DataFrame:
    """(query_id, stop, arrival): least arrival at each stop with at most ``rounds`` boardings (None: any number).

    starts: query_id, stop, arrival. Every round boards at reached stops after the buffer, rides
    each trip as far as it goes, and keeps the least arrival; stops when nothing improves. save(df)
    writes an intermediate table and reads it back, so plans stay short."""
    w = Window.partitionBy("trip_id").orderBy("arrive", "depart", "from_stop", "to_stop")
    rides = save(conns.withColumn("n", F.row_number().over(w)))
    best = save(starts.select("query_id", "stop", "arrival", F.lit(0).alias("round")))
    for r in count(1) if rounds is None else range(1, rounds + 1):
        front = best.where(F.col("round") == r - 1)
        wait = F.when(F.col("round") == 0, 0).otherwise(buffer_s)
        board = rides.where("pickup_type = 0").join(front, rides.from_stop == front.stop).where(F.col("depart") >= F.col("arrival") + wait)
        # of one trip the earliest boarding reaches most
        board = board.groupBy("query_id", "trip_id").agg(F.min("n").alias("first_n"))
        reached = board.join(rides, "trip_id").where("n >= first_n").groupBy("query_id", F.col("to_stop").alias("stop")).agg(F.min("arrive").alias("arrival"))
        new = best.unionByName(reached.withColumn("round", F.lit(r))).groupBy("query_id", "stop").agg(F.min(F.struct("arrival", "round")).alias("x")).select("query_id", "stop", "x.arrival", "x.round")
        best = save(new)
        if best.where(F.col("round") == r).isEmpty():
            break
    return best
