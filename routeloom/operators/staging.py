"""Resumable ingest as tables: targets, pages, progress and their state machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key over both tables; on equal times the new table's."""
    rest = [c for c in old.columns if c not in keys and c != at]
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = both.groupBy(*keys).agg(F.max(F.struct(at, "_new", *rest)).alias("x"))
    return best.select(*keys, *[F.col(f"x.{c}").alias(c) for c in (at, *rest)], (F.col("x._new") == 1).alias("replaced"))


def only_on_one_side(targets: DataFrame, progress: DataFrame, keys: list[str]) -> DataFrame:
    """Targets without progress and progress without target, with the side that has them."""
    a = targets.select(*keys).distinct().join(progress.select(*keys), keys, "left_anti").withColumn("side", F.lit("target"))
    b = progress.select(*keys).distinct().join(targets.select(*keys), keys, "left_anti").withColumn("side", F.lit("progress"))
    return a.unionByName(b)


def with_pages(progress: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """Progress rows with what is staged of them; none is 0."""
    by = pages.groupBy(key).agg(F.count("*").alias("staged_pages"), F.sum("items").alias("staged_items"))
    return progress.join(by, key, "left").fillna(0, ["staged_pages", "staged_items"])


def corrupt(pages: DataFrame, key: str) -> DataFrame:
    """Keys whose first page is empty while a later one is not: one conditional aggregate, no two joins."""
    by = pages.groupBy(key).agg(F.max(((F.col("page_no") == 1) & (F.col("items") == 0)).cast("int")).alias("first_empty"), F.max(((F.col("page_no") > 1) & (F.col("items") > 0)).cast("int")).alias("later_full"))
    return by.where("first_empty = 1 and later_full = 1").select(key)


def disorder_across_pages(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value is not above the one before, page ends included."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("before", F.lag(value).over(w)).where(F.col(value) <= F.col("before"))


def next_status(status: Column, attempts: Column, transient: Column, most: int) -> Column:
    """The state machine of a target after a run: done and pending stay, transient failures come back
    until their attempts are used up, other failures stay failed."""
    return F.when(status != "FAILED", status).when(transient & (attempts < most), F.lit("PENDING")).when(transient, F.lit("DEFERRED")).otherwise(F.lit("FAILED"))


def route_reasons(rows: DataFrame) -> DataFrame:
    """Why a route's rows can't be hydrated: the first of too few stops, order, half a coordinate; or null."""
    w = Window.partitionBy("route_id").orderBy("pos")
    step = F.col("node_order") - F.lag("node_order").over(w)
    half = F.col("latitude").isNull() != F.col("longitude").isNull()
    by = rows.select("route_id", (step <= 0).alias("bad"), half.alias("half")).groupBy("route_id").agg(F.count("*").alias("stops"), F.count_if("bad").alias("bad"), F.count_if("half").alias("half"))
    return by.select("route_id", "stops", F.when(F.col("stops") < 2, "TOO_FEW_STOPS").when(F.col("bad") > 0, "ORDER_NOT_INCREASING").when(F.col("half") > 0, "HALF_COORDINATE").alias("reason"))


def contiguous_from_one(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Keys whose orders are exactly 1..n."""
    by = rows.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(order).alias("d"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    return by.withColumn("contiguous", (F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n")))


def provenance(sources: DataFrame, quality: DataFrame, limit: int) -> DataFrame:
    """Sources, newest first, with their import counts; without a quality row nothing was rejected."""
    out = sources.join(quality, "source_id", "left")
    out = out.withColumn("rejected", F.coalesce("rejected", F.lit(0))).withColumn("input_rows", F.coalesce("input_rows", "row_count"))
    return out.orderBy(F.col("imported_at").desc(), "source_id").limit(limit)


def members(asked: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each asked pair is in the sequences, and at which order first."""
    at = rows.groupBy(*keys).agg(F.min("node_order").alias("node_order"))
    return asked.join(at, keys, "left").withColumn("valid", F.col("node_order").isNotNull())


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, in the order of its first row."""
    return df.groupBy(key).agg(F.min(order).alias("first_at"))


def run_summary(df: DataFrame, status: str, requests: Column) -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("targets"), F.sum(requests).alias("requests"), F.count_distinct("city_code").alias("cities"))
