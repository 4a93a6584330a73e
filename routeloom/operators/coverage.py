"""Overlap and coverage audits; ratios are null where nothing is expected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio_ppm(part: Column, whole: Column) -> Column:
    """Share in whole millionths, rounded half up; null for an empty whole."""
    return F.when(whole > 0, F.floor((part * 2_000_000 + whole) / (whole * 2)).cast("long"))


def overlap(catalog: DataFrame, graph: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys on each side, on both, and only on one; one shuffle, no sides collected."""
    both = catalog.select(*keys, F.lit(1).alias("c"), F.lit(0).alias("g")).unionByName(graph.select(*keys, F.lit(0).alias("c"), F.lit(1).alias("g")))
    by = both.groupBy(*keys).agg(F.max("c").alias("c"), F.max("g").alias("g"))
    out = by.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("catalog_count"), F.coalesce(F.sum("g"), F.lit(0)).alias("graph_count"), F.count_if((F.col("c") == 1) & (F.col("g") == 1)).alias("shared_count"))
    return out.withColumn("catalog_only", F.col("catalog_count") - F.col("shared_count")).withColumn("graph_only", F.col("graph_count") - F.col("shared_count")).withColumn("overlap_ppm", ratio_ppm(F.col("shared_count"), F.col("catalog_count")))


def only_left(left: DataFrame, right: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The first keys in order that the other side lacks: a bounded sample for a report."""
    return left.select(*keys).distinct().join(right.select(*keys).distinct(), keys, "left_anti").orderBy(*keys).limit(limit)


def by_city(catalog: DataFrame, graph: DataFrame, city: str, key: str) -> DataFrame:
    """Routes in the catalog, in the graph and on both, for every city of either side."""
    both = catalog.select(city, key, F.lit(1).alias("c"), F.lit(0).alias("g")).unionByName(graph.select(city, key, F.lit(0).alias("c"), F.lit(1).alias("g")))
    one = both.groupBy(city, key).agg(F.max("c").alias("c"), F.max("g").alias("g"))
    out = one.groupBy(city).agg(F.sum("c").cast("long").alias("catalog_routes"), F.sum("g").cast("long").alias("graph_routes"), F.count_if((F.col("c") == 1) & (F.col("g") == 1)).alias("shared_routes"))
    return out.withColumn("coverage_ppm", ratio_ppm(F.col("shared_routes"), F.col("catalog_routes")))


def ranked(df: DataFrame, by: str, keys: list[str], limit: int, lowest: bool = True) -> DataFrame:
    order = F.col(by).asc_nulls_last() if lowest else F.col(by).desc_nulls_last()
    return df.orderBy(order, *keys).limit(limit)


def status_histogram(progress: DataFrame, status: str, done: str) -> DataFrame:
    out = progress.groupBy(status).agg(F.count("*").alias("targets"))
    return out.withColumn("complete", F.col(status) == done)
