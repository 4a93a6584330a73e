"""Connected components as a loop of joins on saved tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped
from . import sequence, spatial


SALTS = 64


def with_least(rows: DataFrame, key: str, value: str, several: bool = False) -> DataFrame:
    """(key, value, m) with m the least value of the key; ``several``: only of keys with two rows or more.

    A key's rows are dealt over SALTS tasks by their value, both for the aggregate and for the join
    back, so a key that holds a third of all rows is not one task's; m is copied once for each
    salt that the key has, which is never more than its rows."""
    spread = rows.select(key, value, F.pmod(F.xxhash64(value), F.lit(SALTS)).alias("_salt"))
    parts = spread.groupBy(key, "_salt").agg(F.min(value).alias("_m"), F.count("*").alias("_n"))
    least = parts.groupBy(key).agg(F.min("_m").alias("m"), F.sum("_n").alias("_n"), F.collect_list("_salt").alias("_salts"))
    if several:
        least = least.where("_n > 1")
    return spread.join(least.select(key, "m", F.explode("_salts").alias("_salt")), [key, "_salt"]).select(key, value, "m")


def components(edges: DataFrame, save) -> DataFrame:
    """(node, root) of connected components by alternating large and small stars; root is the least node.

    Hubs are spread by with_least(). Each round's edges are deleted once the next ones are written."""

    def down(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    e, last = save(down(edges)), None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last or not now[0]:
            break
        last = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        large = down(with_least(both, "u", "v").where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")))
        small = with_least(large, "a", "b").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x"))
        before, e = e, save(down(small.select("x.*")))
        dropped(before)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


def stop_components(seq: DataFrame, radius_m: float, save) -> DataFrame:
    """(node, root) of stops joined by rides or within the radius; a stop without either is one of its own."""
    rides = sequence.ride_edges(seq).select(F.col("from_node").alias("a"), F.col("to_node").alias("b"))
    joined = components(rides.union(spatial.near_links(seq, radius_m)), save)
    return seq.select(F.col("node_id").alias("node")).distinct().join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
