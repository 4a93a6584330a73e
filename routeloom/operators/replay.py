"""Schedules held against derived events; missing evidence stays missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leg_match(legs: DataFrame, events: DataFrame, window_min: int = 30) -> DataFrame:
    """For each leg and date the PASSAGE nearest to the scheduled arrival within the window.

    legs: leg_id, route_id, node_order, arrive_min, next_min, min_transfer. events: route_id,
    service_date, node_order, from_min, to_min (civil minutes), status, event_id. Verdicts: no event
    is a data gap; an event window that crosses the deadline (next departure less transfer time)
    decides nothing; else early enough is a success. The join's keys are route and stop; the time
    window is a filter on top of that equi-join."""
    passed = events.where("status = 'PASSAGE'")
    mid = (F.col("from_min") + F.col("to_min")) / 2
    j = legs.join(passed, ["route_id", "node_order"]).withColumn("off", F.abs(mid - F.col("arrive_min"))).where(F.col("off") <= window_min)
    best = j.groupBy("leg_id", "service_date").agg(F.min(F.struct("off", "event_id", "from_min", "to_min")).alias("x"), F.count("*").alias("candidates"))
    days = events.select("route_id", "service_date").distinct()
    every = legs.join(days, "route_id")
    deadline = F.col("next_min") - F.col("min_transfer")
    out = every.join(best, ["leg_id", "service_date"], "left")
    verdict = F.when(F.col("x").isNull(), "data_gap").when(F.col("x.to_min") <= deadline, "success").when(F.col("x.from_min") > deadline, "failure").otherwise("data_gap")
    reason = F.when(F.col("x").isNull(), "NO_PASSAGE").when((F.col("x.from_min") <= deadline) & (F.col("x.to_min") > deadline), "PASSAGE_WINDOW_CROSSES_DEADLINE")
    return out.select("leg_id", "route_id", "service_date", F.col("x.event_id").alias("event_id"), F.coalesce("candidates", F.lit(0)).alias("candidates"), verdict.alias("verdict"), reason.alias("reason"))


def daily(matches: DataFrame) -> DataFrame:
    """A day's verdict: any gap, else any failure, else success."""
    by = matches.groupBy("service_date").agg(F.count_if(F.col("verdict") == "data_gap").alias("gaps"), F.count_if(F.col("verdict") == "failure").alias("failures"), F.count("*").alias("legs"))
    return by.withColumn("verdict", F.when(F.col("gaps") > 0, "data_gap").when(F.col("failures") > 0, "failure").otherwise("success"))


def summary(days: DataFrame) -> DataFrame:
    """Eligible days leave gap days out; without any the rate is null."""
    out = days.agg(F.count("*").alias("days"), F.count_if(F.col("verdict") != "data_gap").alias("eligible"), F.count_if(F.col("verdict") == "success").alias("successes"))
    return out.withColumn("success_ppm", F.when(F.col("eligible") > 0, F.floor(F.col("successes") * 1_000_000 / F.col("eligible")).cast("long")))


def closed_form(budgets: DataFrame, delays: DataFrame) -> DataFrame:
    """Chance that all legs of a journey hold, and where it breaks first, by independent legs.

    budgets: journey_id, leg, route_id, kind, budget; delays: route_id, kind, delay. The delays become a
    histogram with running sums, of one row for each distinct delay; a leg meets the last of its rows that the budget
    covers, found in the route's sorted list of them. No leg is joined with observations."""
    n = delays.where("delay is not null").groupBy("route_id", "kind", "delay").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("route_id", "kind").orderBy("delay"))
    steps = n.withColumn("upto", upto).groupBy("route_id", "kind").agg(F.array_sort(F.collect_list(F.struct("delay", "upto"))).alias("steps"), F.sum("n").alias("total"))
    p = budgets.join(steps, ["route_id", "kind"])
    covered = F.element_at(F.filter("steps", lambda x: x["delay"] <= F.col("budget")), -1)["upto"]
    p = p.withColumn("p", F.coalesce(covered, F.lit(0)) / F.col("total"))
    legs = p.groupBy("journey_id").agg(F.array_sort(F.collect_list(F.struct("leg", "p"))).alias("legs"))
    chance = F.aggregate("legs", F.lit(1.0), lambda a, x: a * x["p"])
    worst = F.array_min(F.transform("legs", lambda x: F.struct(x["p"].alias("p"), x["leg"].alias("leg"))))
    return legs.select("journey_id", F.size("legs").alias("legs"), chance.alias("success_probability"), worst["leg"].alias("weakest_leg"))


def outcomes(matches: DataFrame) -> DataFrame:
    """How many legs came to each verdict and reason, and which reason is the most common (of equals the least)."""
    return matches.groupBy("verdict", "reason").agg(F.count("*").alias("legs")).withColumn("most_common", F.row_number().over(Window.partitionBy("verdict").orderBy(F.desc("legs"), F.asc_nulls_last("reason"))) == 1)


def delay_samples(observed: DataFrame) -> DataFrame:
    """Seconds between predicted arrival and the nearest of the same clock time on the day before,
    the day itself and the day after. observed: key, predicted_s, scheduled_s (seconds of day)."""
    d = F.col("predicted_s") - F.col("scheduled_s")
    return observed.withColumn("delay_s", F.element_at(F.array_sort(F.transform(F.array(*[d + k * 86400 for k in (-1, 0, 1)]), lambda x: F.struct(F.abs(x).alias("a"), x.alias("d")))), 1)["d"])
