"""Checks between reading and persisting: quarantine, exact id resolution, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reason(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Adds reject_reason: the first check that fails (a null check fails), or null."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        reason = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reject_reason", reason)


def split(df: DataFrame, checks: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    judged = with_reason(df, checks)
    return judged.where("reject_reason is null").drop("reject_reason"), judged.where("reject_reason is not null")


def quality(df: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """Rows by reason; accepted rows have the reason ''."""
    return with_reason(df, checks).groupBy(F.coalesce("reject_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("rows"))


def resolve_exact(rows: DataFrame, catalog: DataFrame, key: str, area: str) -> DataFrame:
    """Catalog city of each row's id: the only match in the row's area, else the only one at all.

    Ids are grouped before the join, so it stays one row for each row asked for."""
    everywhere = catalog.groupBy(key).agg(F.count("*").alias("n_all"), F.min("city_code").alias("any_city"))
    here = catalog.groupBy(key, area).agg(F.count("*").alias("n_area"), F.min("city_code").alias("area_city"))
    out = rows.join(everywhere, key, "left").join(here, [key, area], "left")
    n_all, n_area = F.coalesce("n_all", F.lit(0)), F.coalesce("n_area", F.lit(0))
    city = F.when(n_area == 1, F.col("area_city")).when((n_area == 0) & (n_all == 1), F.col("any_city"))
    status = F.when(city.isNotNull(), "resolved").when(n_all == 0, "missing").otherwise("ambiguous")
    return out.withColumn("resolved_city", city).withColumn("status", status)


def reconcile(occurrences: DataFrame, owners: DataFrame) -> DataFrame:
    """Routes collected in several regions: one content or a conflict, and whose they are.

    occurrences: route_id, region, digest; owners: route_id, city_code of the catalog."""
    by = occurrences.groupBy("route_id").agg(F.count("*").alias("occurrences"), F.count_distinct("digest").alias("digests"), F.min("region").alias("first_region"))
    own = owners.groupBy("route_id").agg(F.count_distinct("city_code").alias("cities"), F.min("city_code").alias("city"))
    out = by.join(own, "route_id", "left")
    status = F.when(F.col("digests") > 1, "conflict").when(F.coalesce("cities", F.lit(0)) == 1, "catalog_owner").when(F.coalesce("cities", F.lit(0)) == 0, "first_region").otherwise("ambiguous_owner")
    return out.withColumn("status", status).withColumn("owner", F.when(status == "catalog_owner", F.col("city")).when(status == "first_region", F.col("first_region")))


def coordinate_by_number_and_name(rows: DataFrame, local: DataFrame, national: DataFrame, number: str, name: str) -> DataFrame:
    """A coordinate where exactly one stop of the local list, else of the national one, has both the number and the exact name."""

    def unique(df: DataFrame, prefix: str) -> DataFrame:
        by = df.groupBy(number, name).agg(F.count("*").alias("n"), F.min(F.struct("latitude", "longitude")).alias("c"))
        return by.where("n = 1").select(number, name, F.col("c").alias(prefix))

    out = rows.join(unique(local, "_l"), [number, name], "left").join(unique(national, "_n"), [number, name], "left")
    at = F.coalesce("_l", "_n")
    source = F.when(F.col("_l").isNotNull(), "local").when(F.col("_n").isNotNull(), "national")
    return out.withColumn("latitude", at["latitude"]).withColumn("longitude", at["longitude"]).withColumn("coordinate_source", source).drop("_l", "_n")


def without_spikes(df: DataFrame, away_m: float = 20_000, back_m: float = 5_000) -> DataFrame:
    """Blanks the middle point of spikes until none is left; the order of blanking matters, so each
    route's points (a bounded list) go through one function call."""
    import math

    import pandas as pd

    def dist(a, b):
        (p, q), (r, s) = (map(math.radians, a)), (map(math.radians, b))
        h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
        return 2 * 6_371_008.8 * math.asin(min(1.0, math.sqrt(h)))

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        lat, lon, way = pdf["latitude"].tolist(), pdf["longitude"].tolist(), pdf["direction"].tolist()
        changed = True
        while changed:
            changed = False
            for i in range(len(lat) - 2):
                three = [(lat[j], lon[j]) for j in (i, i + 1, i + 2)]
                if any(pd.isna(a) or pd.isna(b) for a, b in three) or not way[i] or len(set(way[i : i + 3])) > 1:
                    continue
                if dist(three[0], three[1]) > away_m and dist(three[1], three[2]) > away_m and dist(three[0], three[2]) < back_m:
                    lat[i + 1] = lon[i + 1] = float("nan")
                    changed = True
        pdf["latitude"], pdf["longitude"] = pd.array(lat, "Float64"), pd.array(lon, "Float64")
        pdf.loc[pdf["latitude"].isna(), ["latitude", "longitude"]] = pd.NA
        return pdf

    return df.groupBy("route_id").applyInPandas(go, df.schema)


def research(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Status of each case by how many of its labels the catalog knows. cases: case_id, labels."""
    known = catalog.groupBy("label").agg(F.count("*").alias("routes"))
    each = cases.select("case_id", F.explode("labels").alias("label")).distinct().join(known, "label", "left")
    by = each.groupBy("case_id").agg(F.count("*").alias("labels"), F.count("routes").alias("known"), F.coalesce(F.sum("routes"), F.lit(0)).alias("routes"))
    return by.withColumn("status", F.when(F.col("known") == F.col("labels"), "all_labels_found").when(F.col("known") > 0, "some_labels_found").otherwise("no_label_found"))


def headway_flags(df: DataFrame) -> DataFrame:
    """Published headways whose minimum exceeds the maximum are flagged, not rejected."""
    flags = F.filter(F.array(F.when(F.col("min_headway") > F.col("max_headway"), "PUBLISHED_MIN_HEADWAY_GT_MAX"), F.when(F.col("daily_runs") == 0, "NO_DAILY_RUNS")), lambda x: x.isNotNull())
    return df.withColumn("quality_flags", flags)
