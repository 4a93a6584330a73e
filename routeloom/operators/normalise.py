"""Saved answers of the vehicle and catalog interfaces as rows: field aliases, lengths, ranges, first of repeats.

An item is JSON text; one object stands for a list of one. Nothing is inferred: each field is read by
name, trimmed and cut, and cast where it can be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Record, then its fields as (name, names in the answer, kind or greatest length).
RECORDS = {
    "cities": (("city_code", ("citycode", "cityCode"), 9), ("city_name", ("cityname", "cityName"), 80)),
    "routes": (("city_code", ("citycode", "cityCode"), 9), ("route_id", ("routeid", "routeId"), 64), ("route_no", ("routeno", "routeNo"), 40), ("route_type", ("routetp", "routeTp"), 40), ("start_node_name", ("startnodenm", "startNodeNm"), 80), ("end_node_name", ("endnodenm", "endNodeNm"), 80)),
    "route_info": (("city_code", ("citycode", "cityCode"), 9), ("route_id", ("routeid", "routeId"), 64), ("route_no", ("routeno", "routeNo"), 40), ("first_vehicle_time", ("startvehicletime", "startVehicleTime"), 12), ("last_vehicle_time", ("endvehicletime", "endVehicleTime"), 12), ("weekday_interval_minutes", ("intervaltime", "intervalTime"), "int"), ("saturday_interval_minutes", ("intervalsattime", "intervalSatTime"), "int"), ("sunday_interval_minutes", ("intervalsuntime", "intervalSunTime"), "int")),
    "stops": (("city_code", ("citycode", "cityCode"), 9), ("route_id", ("routeid", "routeId"), 64), ("node_id", ("nodeid", "nodeId"), 64), ("node_no", ("nodeno", "nodeNo"), 40), ("node_name", ("nodenm", "nodeNm"), 80), ("node_order", ("nodeord", "nodeOrd"), "int"), ("latitude", ("gpslati",), 90.0), ("longitude", ("gpslong",), 180.0), ("up_down_code", ("updowncd", "upDownCd"), 20)),
    "arrivals": (("node_id", ("nodeid",), 64), ("node_name", ("nodenm",), 80), ("route_id", ("routeid",), 64), ("route_no", ("routeno",), 40), ("route_type", ("routetp",), 40), ("arrival_seconds", ("arrtime",), "int"), ("remaining_stops", ("arrprevstationcnt",), "int"), ("vehicle_type", ("vehicletp",), 40)),
    "positions": (("route_name", ("routenm",), 30), ("route_type", ("routetp",), 20), ("vehicle_no", ("vehicleno",), 33), ("node_id", ("nodeid",), 31), ("node_name", ("nodenm",), 60), ("node_order", ("nodeord",), "int"), ("latitude", ("gpslati",), 90.0), ("longitude", ("gpslong",), 180.0)),
}


def field(item: Column, names: tuple[str, ...], kind) -> Column:
    """The first of the names that the item has: text cut to a length, a whole number, or a number within ± a bound."""
    found = F.coalesce(*[F.get_json_object(item, f"$.{n}") for n in names])
    if kind == "int":
        return F.coalesce(*[F.get_json_object(item, f"$.{n}").try_cast("int") for n in names])
    if isinstance(kind, float):
        x = found.try_cast("double")
        return F.when(x.between(-kind, kind), x)
    return F.coalesce(F.substring(F.trim(found), 1, kind), F.lit(""))


def records(items: DataFrame, item: str, operation: str, fallback: dict[str, Column] | None = None) -> DataFrame:
    """The input's other columns with the operation's fields; an empty text takes its fallback."""
    out = {}
    for name, names, kind in RECORDS[operation]:
        out[name] = field(F.col(item), names, kind)
        if fallback and name in fallback:
            out[name] = F.coalesce(F.nullif(out[name], F.lit("")), fallback[name])
    return items.select(*[c for c in items.columns if c != item], *[c.alias(n) for n, c in out.items()])


def positions(items: DataFrame, item: str, snapshot: str, ordinal: str) -> DataFrame:
    """Valid positions with ``dropped`` false, and all others with it true: bad ids, order or vehicle, or a vehicle that the snapshot has named before."""
    r = records(items, item, "positions")
    ok = (F.length("node_id").between(1, 30)) & (F.length("vehicle_no").between(1, 32)) & ~F.col("vehicle_no").rlike(r"[\x00-\x1f]") & F.coalesce(F.col("node_order").between(1, 9999), F.lit(False))
    r = r.withColumn("_ok", ok)
    first = r.where("_ok").groupBy(snapshot, "vehicle_no").agg(F.min(ordinal).alias("_first"))
    r = r.join(first, [snapshot, "vehicle_no"], "left")
    return r.withColumn("dropped", ~F.col("_ok") | (F.col(ordinal) != F.col("_first"))).drop("_ok", "_first")


def casefolded(items: DataFrame, key: str, name: str) -> DataFrame:
    """Field names that an object holds twice once their case is folded; such an object has no certain field."""
    low = items.select(key, F.lower(F.trim(name)).alias("name"))
    return low.groupBy(key, "name").agg(F.count("*").alias("n")).where("n > 1")


def accepted(found: DataFrame, column: str, wanted: Column) -> DataFrame:
    """Of an unfiltered page's rows only those whose value is exactly the wanted one, whatever its case."""
    return found.where(F.lower(F.trim(column)) == F.lower(F.trim(wanted)))


def bounded_evidence(distances: list[Column]) -> Column:
    """Distances as text: whole metres, at most six digits, joined by a stroke."""
    return F.concat_ws("/", *[F.least(F.greatest(F.bround(d, 0), F.lit(0.0)), F.lit(999_999.0)).cast("long").cast("string") for d in distances])
