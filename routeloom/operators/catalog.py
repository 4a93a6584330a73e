"""Summaries and lookups over the catalog's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def store_counts(stores: dict[str, DataFrame]) -> DataFrame:
    """Rows of each store: counts of files' footers, no data is read."""
    out = None
    for name, df in stores.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def active_rows(active: DataFrame, versions: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of the versions that a pointer names, with what the version says."""
    return rows.join(versions.join(active, key), key)


def topology_summary(rows: DataFrame) -> DataFrame:
    """Sequences, rows, stops (by city), cities and sources of the active rows."""
    one = rows.agg(
        F.count_distinct("route_id").alias("active_route_sequences"), F.count("*").alias("directed_stop_rows"), F.count_distinct(F.struct("city_code", "node_id")).alias("unique_graph_stops"),
        F.count_distinct("city_code").alias("city_count"), F.count_distinct("source").alias("source_count"),
    )
    return one.withColumn("graph_ready", F.col("directed_stop_rows") > 0)


def labelled(sequences: DataFrame, targets: DataFrame, key: str, otherwise: Column) -> DataFrame:
    """Sequences with the label of their target, where it has one."""
    return sequences.join(targets, key, "left").withColumn("label", F.coalesce("label", otherwise))


def discovery(progress: DataFrame, cities: DataFrame) -> DataFrame:
    """Whether all is discovered: the list of cities, and as many complete route scopes as there are cities. progress: scope, done."""
    routes = F.col("scope").startswith("routes:")
    one = progress.agg(F.count_if(routes).alias("route_scopes"), F.count_if(routes & F.col("done")).alias("complete_route_scopes"), F.coalesce(F.bool_or((F.col("scope") == "cities") & F.col("done")), F.lit(False)).alias("cities_complete"))
    all_of = one.crossJoin(cities.agg(F.count("*").alias("cities")))  # one row with one row
    whole = (F.col("cities") > 0) & (F.col("route_scopes") == F.col("cities")) & (F.col("complete_route_scopes") == F.col("cities"))
    return all_of.withColumn("complete", F.col("cities_complete") & whole)


def oldest_first(events: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    return events.orderBy(at, tie).limit(limit)


def delay_observations(rows: DataFrame, value: str, at: str, tie: str, limit: int) -> DataFrame:
    """The newest rows that predict an arrival."""
    return rows.where(F.col(value).isNotNull()).orderBy(F.col(at).desc(), F.col(tie).desc()).limit(limit)


def unique_targets(rows: DataFrame, key: str, target: str) -> DataFrame:
    """Whether a key names one target or several; only a unique one is given."""
    by = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(target).alias("_t"))
    return by.select(key, "n", F.when(F.col("n") == 1, "unique").otherwise("ambiguous").alias("probe"), F.when(F.col("n") == 1, F.col("_t")).alias(target))


def sorted_distinct(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The distinct values of each key in order; for values of which there are few."""
    return rows.select(key, value).distinct().groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def fresh(entries: DataFrame, at: str, now: Column, ttl_s: int) -> DataFrame:
    """Entries that were stored within the time to live."""
    age = F.unix_micros(now) - F.unix_micros(F.col(at))
    return entries.where((age >= 0) & (age < ttl_s * 1_000_000))


def ingest_summary(seq: DataFrame) -> DataFrame:
    """Routes, rows, routes with gaps in their orders or with a stop twice, stops, and rows of the most frequent direction."""
    by = seq.groupBy("route_id").agg(F.count("*").alias("rows"), F.count_distinct("node_id").alias("n"), (F.max("node_order") - F.min("node_order") + 1 != F.count("*")).alias("gap"))
    one = by.agg(F.count("*").alias("routes"), F.sum("rows").alias("rows"), F.count_if("gap").alias("gap_routes"), F.count_if(F.col("n") < F.col("rows")).alias("repeat_routes"))
    stops = seq.agg(F.count_distinct("node_id").alias("stops"))
    most = seq.groupBy("direction").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest_direction"))
    return one.crossJoin(stops).crossJoin(most)  # three single rows


def largest_components(labels: DataFrame, limit: int) -> DataFrame:
    """The components with most nodes, by size and least node. labels: node, root."""
    return labels.groupBy("root").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "root").limit(limit)
