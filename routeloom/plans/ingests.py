"""Queries over staged ingests, provenance, validation and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import candidates, coverage, search, staging
from ..sources import tables
from .. import storage
from .registry import POLLS, ROUTES, SEQ, STOPS, distance, query


@query("""WITH s AS (SELECT CAST(n_nationkey AS BIGINT) AS source_id, n_name AS name, (n_nationkey * 7) % 25 AS imported_at, count(c_custkey) AS row_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal >= 0 GROUP BY ALL),
q AS (SELECT CAST(c_nationkey AS BIGINT) AS source_id, count(*) AS rejected, CAST(NULL AS BIGINT) AS x FROM customer WHERE c_acctbal < 0 GROUP BY 1), t AS (SELECT CAST(c_nationkey AS BIGINT) AS source_id, count(*) AS input_rows FROM customer GROUP BY 1)
SELECT source_id, name, row_count, coalesce(rejected, 0) AS rejected, coalesce(CASE WHEN rejected IS NOT NULL THEN input_rows END, row_count) AS input_rows FROM s LEFT JOIN q USING (source_id) LEFT JOIN t USING (source_id) ORDER BY imported_at DESC, source_id LIMIT 12""")
def provenance_list(spark, d):
    n, c = tables.table(spark, d, "nation"), tables.table(spark, d, "customer").withColumn("source_id", F.col("c_nationkey").cast("long"))
    good = c.where("c_acctbal >= 0").groupBy("source_id").agg(F.count("*").alias("row_count"))
    s = n.select(F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") * 7 % 25).alias("imported_at")).join(good, "source_id", "left").fillna(0, ["row_count"])
    q = c.groupBy("source_id").agg(F.count_if(F.col("c_acctbal") < 0).alias("rejected"), F.count("*").alias("input_rows")).where("rejected > 0")
    return staging.provenance(s, q, 12).select("source_id", "name", "row_count", "rejected", "input_rows")


@query("""WITH t AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 <> 0), p AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_orderkey % 7 <> 0)
SELECT k AS route_id, 'target' AS side FROM t WHERE k NOT IN (SELECT k FROM p) UNION ALL SELECT k, 'progress' FROM p WHERE k NOT IN (SELECT k FROM t)""")
def targets_progress_orphans(spark, d):
    t = tables.table(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("route_id"))
    p = tables.table(spark, d, "lineitem").where("l_orderkey % 7 <> 0").select(F.col("l_orderkey").alias("route_id"))
    return staging.only_on_one_side(t, p, ["route_id"])


def _pages(spark, d):
    return tables.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("page_no"), F.when(F.col("l_quantity") < 10, 0).otherwise(F.floor("l_quantity")).cast("long").alias("items"))


PAGES = "pages_ AS (SELECT l_orderkey AS route_id, l_linenumber AS page_no, CASE WHEN l_quantity < 10 THEN 0 ELSE CAST(floor(l_quantity) AS BIGINT) END AS items FROM lineitem)"


@query(f"""WITH {ROUTES}, {PAGES} SELECT r.route_id, priority, count(p.route_id) AS staged_pages, CAST(coalesce(sum(items), 0) AS BIGINT) AS staged_items FROM routes r LEFT JOIN pages_ p ON p.route_id = r.route_id WHERE status = 'P' GROUP BY ALL""")
def failed_page_aggregates(spark, d):
    p = tables.routes(spark, d).where("status = 'P'").select("route_id", "priority")
    return staging.with_pages(p, _pages(spark, d), "route_id")


@query(f"""WITH {PAGES} SELECT DISTINCT route_id FROM pages_ a WHERE EXISTS (SELECT 1 FROM pages_ b WHERE b.route_id = a.route_id AND page_no = 1 AND items = 0) AND EXISTS (SELECT 1 FROM pages_ b WHERE b.route_id = a.route_id AND page_no > 1 AND items > 0)""")
def corrupt_retry_targets(spark, d):
    return staging.corrupt(_pages(spark, d), "route_id")


@query(f"""WITH {SEQ}, n AS (SELECT direction, lead(direction) OVER (PARTITION BY route_id ORDER BY pos) AS next_direction FROM seq) SELECT direction, next_direction, count(*) AS n FROM n WHERE next_direction IS NOT NULL GROUP BY ALL""")
def direction_transitions(spark, d):
    s = tables.sequences(spark, d).select("direction", F.lead("direction").over(Window.partitionBy("route_id").orderBy("pos")).alias("next_direction"))
    return s.where("next_direction is not null").groupBy("direction", "next_direction").agg(F.count("*").alias("n"))


@query(f"""WITH {SEQ}, r AS (SELECT route_id, node_order - lag(node_order) OVER (PARTITION BY route_id ORDER BY pos) AS step, (latitude IS NULL) <> (longitude IS NULL) AS half FROM seq), b AS (SELECT route_id, count(*) AS stops, count(*) FILTER (step <= 0) AS bad, count(*) FILTER (half) AS half FROM r GROUP BY 1)
SELECT route_id, stops, CASE WHEN stops < 2 THEN 'TOO_FEW_STOPS' WHEN bad > 0 THEN 'ORDER_NOT_INCREASING' WHEN half > 0 THEN 'HALF_COORDINATE' END AS reason FROM b""")
def hydrate_validation(spark, d):
    return staging.route_reasons(tables.sequences(spark, d))


@query(f"""WITH {SEQ}, b AS (SELECT route_id, count(*) AS n, count(DISTINCT node_order) AS d, min(node_order) AS lo, max(node_order) AS hi FROM seq GROUP BY 1) SELECT route_id, n, CAST(lo AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi, lo = 1 AND hi = n AND d = n AS contiguous FROM b""")
def municipal_contiguous_orders(spark, d):
    return staging.contiguous_from_one(tables.sequence_rows(spark, d), "route_id", "node_order").select("route_id", "n", "lo", "hi", "contiguous")


@query(f"""WITH {ROUTES}, o AS (SELECT route_id % 900 AS k, captured_at, priority FROM routes WHERE route_id % 2 = 0), n AS (SELECT route_id % 900 AS k, captured_at, priority FROM routes WHERE route_id % 2 = 1),
u AS (SELECT *, 0 AS new FROM o UNION ALL SELECT *, 1 FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY captured_at DESC, new DESC, priority DESC) AS i FROM u) SELECT k AS target, captured_at, priority, new = 1 AS replaced FROM r WHERE i = 1""")
def target_upsert(spark, d):
    r = tables.routes(spark, d).select((F.col("route_id") % 900).alias("target"), "captured_at", "priority", "route_id")
    return staging.upsert(r.where("route_id % 2 = 0").drop("route_id"), r.where("route_id % 2 = 1").drop("route_id"), ["target"], "captured_at")


@query(f"""WITH {ROUTES}, s AS (SELECT CASE status WHEN 'P' THEN 'FAILED' WHEN 'F' THEN 'COMPLETE' ELSE 'PENDING' END AS status, route_id % 5 AS attempts, priority LIKE '1-%' OR priority LIKE '2-%' AS transient FROM routes)
SELECT status, CASE WHEN status <> 'FAILED' THEN status WHEN transient AND attempts < 3 THEN 'PENDING' WHEN transient THEN 'DEFERRED' ELSE 'FAILED' END AS next_status, count(*) AS targets FROM s GROUP BY ALL""")
def requeue_transitions(spark, d):
    r = tables.routes(spark, d).withColumn("status", F.when(F.col("status") == "P", "FAILED").when(F.col("status") == "F", "COMPLETE").otherwise("PENDING"))
    transient = F.col("priority").startswith("1-") | F.col("priority").startswith("2-")
    return r.withColumn("next_status", staging.next_status(F.col("status"), F.col("route_id") % 5, transient, 3)).groupBy("status", "next_status").agg(F.count("*").alias("targets"))


@query("""WITH x AS (SELECT conv_id, turn, length(text) AS size, lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, size, before FROM x WHERE size <= before""")
def disorder_across_pages(spark, d):
    c = tables.table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("size"))
    return staging.disorder_across_pages(c, "conv_id", ["turn"], "size")


@query(f"""WITH {SEQ}, a AS (SELECT p_partkey AS node_id, p_partkey * 3 % 1500 AS route_id FROM part), m AS (SELECT route_id, node_id, min(node_order) AS node_order FROM seq GROUP BY ALL) SELECT a.route_id, a.node_id, CAST(node_order AS BIGINT) AS node_order, node_order IS NOT NULL AS valid FROM a LEFT JOIN m ON m.route_id = a.route_id AND m.node_id = a.node_id""")
def mapping_validation(spark, d):
    asked = tables.stops(spark, d).select((F.col("node_id") * 3 % 1500).alias("route_id"), "node_id")
    return staging.members(asked, tables.sequence_rows(spark, d), ["route_id", "node_id"]).select("route_id", "node_id", "node_order", "valid")


@query("""SELECT event_id, coalesce(json_extract_string(props, '$.label'), CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN json_extract_string(props, '$.k') END, event_type) AS label FROM events""")
def public_labels(spark, d):
    e = tables.table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.label"), F.when(k.cast("long") > 50, k), "event_type").alias("label"))


@query(f"""WITH {STOPS} SELECT a.node_id, b.node_id AS other_id, CAST(floor({distance('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} + 0.5) AS BIGINT) AS distance_m FROM stops a JOIN stops b ON a.node_name = b.node_name AND a.node_id <> b.node_id WHERE {distance('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 4000""")
def endpoint_counterparts(spark, d):
    c = candidates.counterparts(tables.stops(spark, d), "node_name", 4000)
    return c.select("node_id", "other_id", F.floor(F.col("distance_m") + 0.5).alias("distance_m"))


@query(f"""WITH {POLLS}, e AS (SELECT route_id, count(*) AS observations, count(*) FILTER (vehicle_no % 3 = 0) AS passages FROM polls WHERE route_id <> 'signup' GROUP BY 1),
c AS (SELECT p_partkey AS path_id, ['click', 'view', 'signup', 'bus', 'error'][1 + p_partkey % 5] AS r1, ['click', 'view', 'signup', 'bus', 'error'][1 + p_size % 5] AS r2 FROM part), x AS (SELECT path_id, r1 AS route_id FROM c UNION SELECT path_id, r2 FROM c),
b AS (SELECT path_id, count(*) AS routes, count(*) FILTER (coalesce(observations, 0) > 0) AS observed, min(coalesce(passages, 0)) AS least_passages FROM x LEFT JOIN e USING (route_id) GROUP BY 1)
SELECT path_id, routes, observed, least_passages, concat_ws(',', CASE WHEN observed = 0 THEN 'NO_SERVICE_EVIDENCE' END, CASE WHEN observed > 0 AND observed < routes THEN 'PARTIAL_SERVICE_EVIDENCE' END, CASE WHEN least_passages = 0 THEN 'NO_PASSAGE_HISTORY' END) AS reasons,
  CASE WHEN observed = routes AND least_passages > 0 THEN 'evidence_complete' WHEN observed > 0 THEN 'evidence_partial' ELSE 'structural_only' END AS status FROM b""")
def candidate_evidence(spark, d):
    names = F.array(*map(F.lit, ("click", "view", "signup", "bus", "error")))
    p = tables.table(spark, d, "part")
    c = p.select(F.col("p_partkey").alias("path_id"), F.array(F.element_at(names, (1 + F.col("p_partkey") % 5).cast("int")), F.element_at(names, 1 + F.col("p_size") % 5)).alias("routes"))
    e = tables.polls(spark, d).where("route_id <> 'signup'").groupBy("route_id").agg(F.count("*").alias("observations"), F.count_if(F.col("vehicle_no") % 3 == 0).alias("passages"))
    return candidates.decorate(c, e).select("path_id", "routes", "observed", "least_passages", F.array_join("reasons", ",").alias("reasons"), "status")


@query(f"""WITH {SEQ}, s AS (SELECT route_id // 3 AS path_id, route_id % 3 AS leg, row_number() OVER (PARTITION BY route_id // 3 ORDER BY route_id, pos) AS n, direction, node_id, lead(node_id) OVER (PARTITION BY route_id // 3 ORDER BY route_id, pos) AS to_node FROM seq),
c AS (SELECT *, CASE WHEN leg = lag(leg) OVER (PARTITION BY path_id ORDER BY n) THEN 0 ELSE 1 END AS new FROM s WHERE to_node IS NOT NULL), g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY path_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM c)
SELECT path_id, section, leg AS route_id, count(*) AS rides, arg_min(node_id, n) AS board, arg_max(to_node, n) AS alight FROM g GROUP BY path_id, section, leg""")
def journey_sections(spark, d):
    w = Window.partitionBy("path_id").orderBy("route_id", "pos")
    s = tables.sequences(spark, d).withColumn("path_id", F.floor(F.col("route_id") / 3))
    s = s.select("path_id", (F.col("route_id") % 3).alias("route_id"), F.row_number().over(w).alias("n"), F.col("node_id").alias("from_node"), F.lead("node_id").over(w).alias("to_node")).where("to_node is not null")
    return candidates.sections(s)


@query(f"""WITH {ROUTES}, l AS (SELECT city_code, route_id, CAST(floor(price) AS BIGINT) AS a, route_id * 7919 % 10007 AS b FROM routes) SELECT CAST(city_code AS BIGINT) AS city_code, route_id, a, b FROM l x WHERE NOT EXISTS (SELECT 1 FROM l y WHERE y.city_code = x.city_code AND y.route_id <> x.route_id AND (y.a < x.a AND y.b <= x.b OR y.a = x.a AND y.b < x.b OR y.a = x.a AND y.b = x.b AND y.route_id < x.route_id))""")
def pareto_frontier(spark, d):
    r = tables.routes(spark, d).select("city_code", "route_id", F.floor("price").alias("a"), (F.col("route_id") * 7919 % 10007).alias("b"))
    return candidates.frontier(r, ["city_code"], "a", "b", "route_id")


@query(f"WITH {STOPS} SELECT node_id FROM stops WHERE latitude BETWEEN 36.1 AND 36.2 AND longitude BETWEEN 127.05 AND 127.3")
def box_filter(spark, d):
    return candidates.boxed(tables.stops(spark, d), 36.1, 36.2, 127.05, 127.3).select("node_id")


@query("SELECT o_custkey AS target, min(o_orderkey) AS first_at FROM orders GROUP BY 1")
def ordered_targets(spark, d):
    return staging.ordered_distinct(tables.table(spark, d, "orders").select(F.col("o_custkey").alias("target"), "o_orderkey"), "target", "o_orderkey")


@query(f"WITH {ROUTES} SELECT status, count(*) AS targets, CAST(sum(route_id % 4) AS BIGINT) AS requests, count(DISTINCT city_code) AS cities FROM routes GROUP BY status")
def run_summary(spark, d):
    return staging.run_summary(tables.routes(spark, d), "status", F.col("route_id") % 4)


@query(f"""WITH {ROUTES}, r AS (SELECT city_code, route_id, captured_at, row_number() OVER (PARTITION BY city_code, priority ORDER BY captured_at DESC, route_id DESC) AS k, priority FROM routes) SELECT CAST(city_code AS BIGINT) AS city_code, priority, route_id FROM r WHERE k = 1""")
def latest_row_per_key(spark, d):
    return search.latest(tables.routes(spark, d), ["city_code", "priority"], ["captured_at", "route_id"]).select("city_code", "priority", "route_id")


@query(f"""WITH {ROUTES}, c AS (SELECT city_code, count(*) AS n, count(*) FILTER (status = 'F') AS f FROM routes GROUP BY 1) SELECT CAST(city_code AS BIGINT) AS city_code, n AS routes, f AS complete, (f * 2000000 + n) // (n * 2) AS complete_ppm FROM c""")
def per_city_progress(spark, d):
    c = tables.routes(spark, d).groupBy("city_code").agg(F.count("*").alias("routes"), F.count_if(F.col("status") == "F").alias("complete"))
    return c.withColumn("complete_ppm", coverage.ratio_ppm(F.col("complete"), F.col("routes")))


@query("""SELECT c_custkey, 'stop:' || substr(sha256(concat_ws(chr(31), c_mktsegment, 'stop', c_name)), 1, 20) AS namespaced_id FROM customer""")
def namespaced_ids(spark, d):
    return tables.table(spark, d, "customer").select("c_custkey", text.namespaced_id(F.col("c_mktsegment"), "stop", F.col("c_name")).alias("namespaced_id"))


@query("""SELECT page_id, CASE WHEN length(trim(url)) BETWEEN 1 AND 45 AND NOT regexp_matches(url, '[\\x00-\\x1f\\x7f]') THEN trim(url) END AS label, regexp_matches(regexp_extract(url, '([^/?#]*)$', 1), '^[0-9A-Za-z_.:-]{1,96}$') AS code_ok FROM pages""")
def text_validators(spark, d):
    p = tables.table(spark, d, "pages")
    return p.select("page_id", text.safe_text(F.col("url"), 45).alias("label"), text.safe_code(F.regexp_extract("url", "([^/?#]*)$", 1)).isNotNull().alias("code_ok"))


@query()
def component_summary(spark, d):
    from ..operators import graph

    return candidates.component_summary(graph.stop_components(tables.sequences(spark, d), 300, storage.saved))
