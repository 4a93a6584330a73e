"""Substring search and lookups over the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, spelling_variants


def search(df: DataFrame, columns: list[str], query: str, swaps: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    return df.where(contains_any(columns, spelling_variants(query, swaps)))


def top(df: DataFrame, order: list, limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def first_source(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union in which the first part that has a key gives its row."""
    both = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_rank", F.lit(i))
        both = p if both is None else both.unionByName(p)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.min(F.struct("source_rank", *[c for c in rest if c != "source_rank"])).alias("_x"))
    return best.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def mode(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the least."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    best = n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("x"))
    return best.select(key, F.col("x.v").alias(value), (-F.col("x.m")).alias("n"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order: a partial aggregate, no window."""
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in df.columns if c not in (*keys, *order)])).alias("_x"))
    return best.select(*keys, "_x.*").select(*df.columns)
