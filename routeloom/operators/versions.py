"""Immutable versions and active pointers.

Versions are content-addressed and only appended; a small pointer table names the active one of
each key. Persisting writes the new partition first and swaps the pointer last, so a reader sees
either the old state or the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def content_id(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """sha-256 over the ordered rows of each key; absent values are marked, so they differ from empty ones."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    out = df.groupBy(*keys).agg(rows.alias("_r"), F.count("*").alias("stop_count"))
    return out.select(*keys, "stop_count", F.sha2(F.concat_ws("\x1e", F.transform("_r", lambda r: r["_t"])), 256).alias("sequence_id"))


def latest_version(versions: DataFrame, keys: list[str], at: str, version: str) -> DataFrame:
    """The newest version of each key, the greater id on equal times; a partial aggregate, no window."""
    best = versions.groupBy(*keys).agg(F.max(F.struct(at, version)).alias("x"), F.count("*").alias("versions"))
    return best.select(*keys, F.col(f"x.{version}").alias(version), F.col(f"x.{at}").alias(at), "versions")


def preserve_newer(candidates: DataFrame, active: DataFrame, keys: list[str], at: str, version: str) -> DataFrame:
    """What becomes of each candidate: inserted, unchanged, skipped_older, conflict or activated."""
    now = active.select(*keys, F.col(at).alias("active_at"), F.col(version).alias("active_version"))
    out = candidates.join(now, keys, "left")
    same = F.col(version) == F.col("active_version")
    outcome = F.when(F.col("active_version").isNull(), "inserted").when(same, "unchanged").when(F.col(at) < F.col("active_at"), "skipped_older").when(F.col(at) == F.col("active_at"), "conflict").otherwise("activated")
    return out.withColumn("outcome", outcome)


def pointer_after(active: DataFrame, judged: DataFrame, keys: list[str], at: str, version: str) -> DataFrame:
    """The pointer table once the accepted candidates are active."""
    new = judged.where(F.col("outcome").isin("inserted", "activated")).select(*keys, at, version)
    return new.unionByName(active.select(*keys, at, version).join(new.select(*keys), keys, "left_anti"))


def persist(df: DataFrame, path: str, partition: str, pointer: DataFrame, pointer_path: str) -> None:
    """Append new partitions, then replace the pointer; a second run with the same data changes nothing."""
    spark: SparkSession = df.sparkSession
    try:
        old = spark.read.parquet(path).select(partition).distinct()
        df = df.join(old, partition, "left_anti")
    except Exception as e:  # the first version of all
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").partitionBy(partition).parquet(path)
    pointer.write.mode("overwrite").parquet(pointer_path)


def contiguous_pages(pages: DataFrame, key: str, number: str) -> DataFrame:
    """By key: pages, items, and whether the numbers run from the first one without gap or repeat."""
    return pages.groupBy(key).agg(F.count("*").alias("pages"), F.countDistinct(number).alias("distinct_pages"), F.min(number).alias("first_page"), F.max(number).alias("last_page")).withColumn("contiguous", (F.col("pages") == F.col("distinct_pages")) & (F.col("last_page") - F.col("first_page") + 1 == F.col("pages")))


def claim_order(targets: DataFrame, status: str, city: str, key: list[str], ranks: dict[str, int], done: str) -> DataFrame:
    """Targets in the order in which they are claimed: status rank, then cities with fewest complete."""
    complete = targets.groupBy(city).agg(F.count_if(F.col(status) == done).alias("completed"))
    rank = F.coalesce(*[F.when(F.col(status) == s, r) for s, r in ranks.items()])
    return targets.join(complete, city).withColumn("rank", rank).where("rank is not null").orderBy("rank", "completed", *key)


def daily_quota(calls: DataFrame, day: str, order: list[str], limit: int) -> DataFrame:
    """Marks the calls within each day's budget."""
    w = Window.partitionBy(day).orderBy(*order)
    return calls.withColumn("attempt", F.row_number().over(w)).withColumn("reserved", F.col("attempt") <= limit)


def quarantined(active: DataFrame, evidence: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The pointer without rows whose active version the evidence names; a version that has changed since stays."""
    return active.join(evidence.select(*keys, version).distinct(), [*keys, version], "left_anti")


def feed_counts(tables: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each table of a feed, by one job over all of them."""
    both = None
    for name, df in tables.items():
        one = df.select(F.lit(name).alias("name"))
        both = one if both is None else both.unionAll(one)
    found = {r["name"]: r["count"] for r in both.groupBy("name").count().collect()}
    return {name: found.get(name, 0) for name in tables}


def activate_feed(tables: dict[str, DataFrame], expected: dict[str, int], root: str, feed_id: str, provider: str) -> None:
    """Write a feed's tables under its id, and point the provider to it once all counts are as expected.

    A second activation of the same feed writes nothing anew; a wrong count leaves the pointer alone."""
    counts = feed_counts(tables)
    if wrong := {n: (counts[n], expected.get(n)) for n in counts if counts[n] != expected.get(n)}:
        raise ValueError(f"row counts differ: {wrong}")
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/feed_id={feed_id}")
    # one small file a provider, so that one provider's swap never touches another's
    spark.createDataFrame([(provider, feed_id)], "provider string, feed_id string").coalesce(1).write.mode("overwrite").parquet(f"{root}/active/provider_key={provider}")
