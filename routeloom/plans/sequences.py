"""Queries over ordered sequences, overlap, coverage, versions and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import AUDIT_RADIUS_M
from ..operators import coverage, ingest, search, sequence, versions
from ..sources import files, tables
from .registry import ROUTES, SEGMENTS, SEQ, STOPS, distance, query

D = lambda a, b: distance(f"{a}.latitude", f"{a}.longitude", f"{b}.latitude", f"{b}.longitude", AUDIT_RADIUS_M)


@query(f"""WITH {SEQ}, n AS (SELECT route_id, pos, node_id AS from_node, lead(node_id) OVER w AS to_node, direction, lead(direction) OVER w AS d2 FROM seq WINDOW w AS (PARTITION BY route_id ORDER BY pos))
SELECT route_id, pos, from_node, to_node FROM n WHERE to_node IS NOT NULL AND NOT (direction <> '' AND d2 <> '' AND direction <> d2)""")
def seq_ride_edges(spark, d):
    return sequence.ride_edges(tables.sequences(spark, d))


@query(f"WITH {SEQ}, {SEGMENTS} SELECT route_id, pos, node_id, segment_id FROM segments")
def seq_direction_segments(spark, d):
    return sequence.with_segments(tables.sequences(spark, d)).select("route_id", "pos", "node_id", "segment_id")


@query(f"""WITH {SEQ}, r AS (SELECT route_id, node_order, node_order - lag(node_order) OVER (PARTITION BY route_id ORDER BY pos) AS step, latitude, longitude FROM seq),
b AS (SELECT route_id, count(*) AS n, max(node_order) AS declared, count(*) FILTER (step <= 0) AS bad, count(*) FILTER (latitude IS NULL) AS missing,
  count(*) FILTER ((latitude IS NULL) <> (longitude IS NULL) OR coalesce(latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180, false)) AS badp FROM r GROUP BY route_id)
SELECT count(*) AS sequences, CAST(sum(n) AS BIGINT) AS row_count, count(*) FILTER (n < 2) AS fewer_than_two, count(*) FILTER (n <> declared) AS declared_mismatch, count(*) FILTER (bad > 0) AS order_issue,
  CAST(sum(missing) AS BIGINT) AS missing_coordinates, CAST(sum(badp) AS BIGINT) AS bad_coordinates, count(*) FILTER (n < 2 OR n <> declared OR bad > 0 OR badp > 0) AS anomalous FROM b""")
def seq_integrity_summary(spark, d):
    return sequence.integrity(tables.sequences(spark, d))


@query(f"""WITH {SEQ}, r AS (SELECT route_id, node_order - lag(node_order) OVER w AS step, node_id = lag(node_id) OVER w AS l FROM seq WINDOW w AS (PARTITION BY route_id ORDER BY pos))
SELECT route_id, count(*) FILTER (step > 1) AS order_gaps, count(*) FILTER (step <= 0) AS non_increasing, count(*) FILTER (l) AS self_loops FROM r GROUP BY route_id""")
def seq_order_anomalies(spark, d):
    return sequence.order_anomalies(tables.sequences(spark, d))


@query(f"""WITH {SEQ} SELECT b.route_id, b.pos, b.node_id FROM seq a JOIN seq b ON b.route_id = a.route_id AND b.pos = a.pos + 1 JOIN seq c ON c.route_id = a.route_id AND c.pos = a.pos + 2
WHERE a.direction <> '' AND a.direction = b.direction AND b.direction = c.direction AND {D('a', 'b')} > 20000 AND {D('b', 'c')} > 20000 AND {D('a', 'c')} < 5000""")
def seq_spikes(spark, d):
    return sequence.spikes(tables.sequences(spark, d))


@query(f"""WITH {SEQ}, x AS (SELECT b.route_id, {D('a', 'b')} AS d FROM seq b LEFT JOIN seq a ON a.route_id = b.route_id AND a.pos = b.pos - 1)
SELECT route_id, count(*) FILTER (d > 5000) AS over_5km, count(*) FILTER (d > 20000) AS over_20km, count(d) AS measured FROM x GROUP BY route_id""")
def seq_long_segments(spark, d):
    return sequence.long_segments(tables.sequences(spark, d))


@query(f"""WITH {SEQ} SELECT r.route_id, CAST(coalesce(n, 0) AS BIGINT) AS od_pairs FROM (SELECT DISTINCT route_id FROM seq) r LEFT JOIN
(SELECT a.route_id, count(*) AS n FROM seq a JOIN seq b ON a.route_id = b.route_id AND a.pos < b.pos WHERE a.can_board AND b.can_alight GROUP BY a.route_id) USING (route_id)""")
def seq_forward_od_pairs(spark, d):
    return sequence.forward_od_pairs(tables.sequences(spark, d))


@query(f"""WITH {SEQ}, {SEGMENTS} SELECT r.route_id, r.segment_id, CAST(coalesce(n, 0) AS BIGINT) AS od_pairs FROM (SELECT DISTINCT route_id, segment_id FROM segments) r LEFT JOIN
(SELECT a.route_id, a.segment_id, count(*) AS n FROM segments a JOIN segments b ON a.route_id = b.route_id AND a.segment_id = b.segment_id AND a.pos < b.pos WHERE a.can_board AND b.can_alight GROUP BY ALL) q ON q.route_id = r.route_id AND q.segment_id = r.segment_id""")
def seq_forward_od_pairs_directional(spark, d):
    return sequence.forward_od_pairs(tables.sequences(spark, d), directional=True)


@query(f"WITH {SEQ} SELECT route_id, node_id, count(*) AS visits FROM seq GROUP BY ALL HAVING count(*) > 1")
def seq_repeated_nodes(spark, d):
    return sequence.repeated_nodes(tables.sequences(spark, d))


@query(f"""WITH {SEQ}, {SEGMENTS} SELECT a.route_id, count(*) AS pairs, CAST(max(b.pos - a.pos) AS BIGINT) AS longest FROM segments a JOIN segments b ON a.route_id = b.route_id AND a.segment_id = b.segment_id AND a.pos < b.pos WHERE a.can_board AND b.can_alight GROUP BY a.route_id""")
def seq_reachable_stops(spark, d):
    return sequence.reachable(tables.sequences(spark, d)).groupBy("route_id").agg(F.count("*").alias("pairs"), F.max(F.col("to_pos") - F.col("from_pos")).alias("longest"))


@query(f"""WITH {SEQ}, c AS (SELECT *, CASE WHEN direction IS NOT DISTINCT FROM lag(direction) OVER w AND pos > 0 THEN 0 ELSE 1 END AS new FROM seq WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY route_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c)
SELECT route_id, run, direction, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos, count(*) AS length FROM r GROUP BY route_id, run, direction""")
def journey_boarding_islands(spark, d):
    return sequence.islands(tables.sequences(spark, d), "route_id", ["pos"], "direction")


@query(f"""WITH {SEQ}, n AS (SELECT *, count(*) OVER (PARTITION BY route_id) AS n FROM seq), k AS (SELECT *, CAST(ceil(pos * 3 / (CASE WHEN n > 1 THEN n - 1 END)) AS BIGINT) AS k FROM n)
SELECT route_id, pos, node_id FROM k WHERE n <= 4 OR CAST(floor(k * (n - 1) / 3) AS BIGINT) = pos""")
def segment_uniform_sample(spark, d):
    return sequence.uniform_sample(tables.sequences(spark, d), "route_id", 4).select("route_id", "pos", "node_id")


# --- coverage -----------------------------------------------------------------------------------


@query(f"""WITH {ROUTES}, g AS (SELECT DISTINCT l_orderkey AS route_id FROM lineitem), x AS (SELECT count(*) AS c, count(g.route_id) AS s, (SELECT count(*) FROM g) AS n FROM routes LEFT JOIN g USING (route_id))
SELECT c AS catalog_count, n AS graph_count, s AS shared_count, c - s AS catalog_only, n - s AS graph_only, (s * 2000000 + c) // (c * 2) AS overlap_ppm FROM x""")
def route_overlap(spark, d):
    return coverage.overlap(tables.routes(spark, d).select("route_id"), tables.sequence_rows(spark, d).select("route_id"), ["route_id"])


@query(f"""WITH {STOPS}, g AS (SELECT DISTINCT l_partkey AS node_id FROM lineitem WHERE l_orderkey % 2 = 0), s AS (SELECT DISTINCT node_id FROM stops WHERE node_id % 7 <> 0),
x AS (SELECT (SELECT count(*) FROM s) AS c, (SELECT count(*) FROM g) AS n, (SELECT count(*) FROM s JOIN g USING (node_id)) AS sh)
SELECT c AS catalog_count, n AS graph_count, sh AS shared_count, c - sh AS catalog_only, n - sh AS graph_only, (sh * 2000000 + c) // (c * 2) AS overlap_ppm FROM x""")
def stop_overlap(spark, d):
    return coverage.overlap(tables.stops(spark, d).where("node_id % 7 <> 0").select("node_id"), tables.sequence_rows(spark, d).where("route_id % 2 = 0").select("node_id"), ["node_id"])


@query(f"WITH {ROUTES} SELECT route_id FROM routes WHERE route_id NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY route_id LIMIT 25")
def route_overlap_samples(spark, d):
    return coverage.only_left(tables.routes(spark, d), tables.sequence_rows(spark, d), ["route_id"], 25)


@query(f"""WITH {ROUTES}, g AS (SELECT DISTINCT l_orderkey AS route_id FROM lineitem), x AS (SELECT city_code, count(*) AS c, count(g.route_id) AS s FROM routes LEFT JOIN g USING (route_id) GROUP BY city_code)
SELECT CAST(city_code AS BIGINT) AS city_code, c AS catalog_routes, s AS graph_routes, s AS shared_routes, (s * 2000000 + c) // (c * 2) AS coverage_ppm FROM x ORDER BY coverage_ppm, city_code LIMIT 10""")
def city_coverage_ranked(spark, d):
    r = tables.routes(spark, d).select("city_code", "route_id")
    g = r.join(tables.sequence_rows(spark, d).select("route_id"), "route_id", "left_semi")
    return coverage.ranked(coverage.by_city(r, g, "city_code", "route_id"), "coverage_ppm", ["city_code"], 10)


@query(f"""WITH {ROUTES}, {STOPS}, {SEQ} SELECT (SELECT count(*) FROM stops) AS catalog_stops, (SELECT count(*) FROM routes) AS catalog_routes, (SELECT count(DISTINCT route_id) FROM seq) AS sequences, (SELECT count(*) FROM seq) AS sequence_rows, (SELECT count(DISTINCT node_id) FROM seq) AS graph_stops""")
def catalog_graph_counts(spark, d):
    names = ("catalog_stops", "catalog_routes", "sequences", "sequence_rows", "graph_stops")
    parts = [
        tables.stops(spark, d).agg(F.count("*").alias("catalog_stops")),
        tables.routes(spark, d).agg(F.count("*").alias("catalog_routes")),
        tables.sequence_rows(spark, d).agg(F.count_distinct("route_id").alias("sequences"), F.count("*").alias("sequence_rows"), F.count_distinct("node_id").alias("graph_stops")),
    ]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    return both.agg(*[F.max(n).alias(n) for n in names])


@query(f"WITH {ROUTES} SELECT status, count(*) AS targets, status = 'F' AS complete FROM routes GROUP BY status")
def topology_coverage(spark, d):
    return coverage.status_histogram(tables.routes(spark, d), "status", "F")


@query(f"""WITH {ROUTES} SELECT count(*) AS targets, count(*) FILTER (status = 'F') AS complete, count(*) FILTER (status = 'P') AS failed, count(*) FILTER (status = 'O') AS pending,
  count(*) FILTER (status = 'P' AND priority LIKE '1-%') AS retryable, count(*) FILTER (status = 'P' AND priority LIKE '5-%') AS corrupt, count(*) FILTER (status = 'P' AND priority NOT LIKE '1-%' AND priority NOT LIKE '5-%') AS other_failures, count(DISTINCT city_code) AS cities FROM routes""")
def topology_failure_taxonomy(spark, d):
    r, failed = tables.routes(spark, d), F.col("status") == "P"
    retry, corrupt = F.col("priority").startswith("1-"), F.col("priority").startswith("5-")
    return r.agg(F.count("*").alias("targets"), F.count_if(F.col("status") == "F").alias("complete"), F.count_if(failed).alias("failed"), F.count_if(F.col("status") == "O").alias("pending"), F.count_if(failed & retry).alias("retryable"), F.count_if(failed & corrupt).alias("corrupt"), F.count_if(failed & ~retry & ~corrupt).alias("other_failures"), F.count_distinct("city_code").alias("cities"))


@query("""SELECT conv_id, count(*) AS pages, count(DISTINCT turn) AS distinct_pages, min(turn) AS first_page, max(turn) AS last_page, count(*) = count(DISTINCT turn) AND max(turn) - min(turn) + 1 = count(*) AS contiguous FROM conversations GROUP BY conv_id""")
def staging_page_integrity(spark, d):
    return versions.contiguous_pages(tables.table(spark, d, "conversations"), "conv_id", "turn")


@query(f"""WITH {ROUTES}, c AS (SELECT city_code, count(*) FILTER (status = 'F') AS completed FROM routes GROUP BY city_code)
SELECT CAST(city_code AS BIGINT) AS city_code, route_id, status, completed FROM routes JOIN c USING (city_code) WHERE status IN ('P', 'O') ORDER BY CASE status WHEN 'O' THEN 0 ELSE 1 END, completed, city_code, route_id LIMIT 1""")
def claim_next_target(spark, d):
    return versions.claim_order(tables.routes(spark, d), "status", "city_code", ["city_code", "route_id"], {"O": 0, "P": 1}, "F").limit(1).select("city_code", "route_id", "status", "completed")


# --- versions -----------------------------------------------------------------------------------


@query(f"""WITH {ROUTES}, v AS (SELECT city_code, route_id % 1000 AS line, route_id AS sequence_id, captured_at FROM routes)
SELECT CAST(city_code AS BIGINT) AS city_code, line, arg_max(sequence_id, (captured_at, sequence_id)) AS sequence_id, max(captured_at) AS captured_at, count(*) AS versions FROM v GROUP BY ALL""")
def active_latest_version(spark, d):
    v = tables.routes(spark, d).select("city_code", (F.col("route_id") % 1000).alias("line"), F.col("route_id").alias("sequence_id"), "captured_at")
    return versions.latest_version(v, ["city_code", "line"], "captured_at", "sequence_id")


@query(f"""WITH {ROUTES}, v AS (SELECT city_code, route_id % 200 AS line, route_id AS sequence_id, captured_at, route_id % 2 AS part FROM routes),
a AS (SELECT city_code, line, arg_max(sequence_id, (captured_at, sequence_id)) AS sequence_id, max(captured_at) AS captured_at FROM v WHERE part = 0 GROUP BY ALL),
c AS (SELECT city_code, line, arg_max(sequence_id, (captured_at, sequence_id)) AS sequence_id, max(captured_at) AS captured_at FROM v WHERE part = 1 OR route_id_is_even(sequence_id) GROUP BY ALL)
SELECT CAST(c.city_code AS BIGINT) AS city_code, c.line, c.sequence_id, CASE WHEN a.sequence_id IS NULL THEN 'inserted' WHEN a.sequence_id = c.sequence_id THEN 'unchanged' WHEN c.captured_at < a.captured_at THEN 'skipped_older' WHEN c.captured_at = a.captured_at THEN 'conflict' ELSE 'activated' END AS outcome
FROM c LEFT JOIN a ON a.city_code = c.city_code AND a.line = c.line""".replace("route_id_is_even(sequence_id)", "sequence_id % 8 = 0"))
def activation_preserve_newer(spark, d):
    v = tables.routes(spark, d).select("city_code", (F.col("route_id") % 200).alias("line"), F.col("route_id").alias("sequence_id"), "captured_at")
    keys = ["city_code", "line"]
    active = versions.latest_version(v.where("sequence_id % 2 = 0"), keys, "captured_at", "sequence_id")
    new = versions.latest_version(v.where("sequence_id % 2 = 1 or sequence_id % 8 = 0"), keys, "captured_at", "sequence_id")
    return versions.preserve_newer(new, active, keys, "captured_at", "sequence_id").select(*keys, "sequence_id", "outcome")


@query(f"""WITH {SEQ}, t AS (SELECT route_id, pos, concat_ws(chr(31), CAST(node_id AS VARCHAR), direction, CAST(can_board AS VARCHAR), CAST(can_alight AS VARCHAR)) AS t FROM seq)
SELECT route_id, count(*) AS stop_count, sha256(string_agg(t, chr(30) ORDER BY pos, t)) AS sequence_id FROM t GROUP BY route_id""")
def sequence_content_ids(spark, d):
    return versions.content_id(tables.sequences(spark, d), ["route_id"], ["pos"], ["node_id", "direction", "can_board", "can_alight"])


# --- searches -----------------------------------------------------------------------------------


@query(f"WITH {ROUTES} SELECT CAST(city_code AS BIGINT) AS city_code, n_name AS city_name, count(*) AS routes FROM routes JOIN nation ON n_nationkey = city_code WHERE n_name ILIKE '%N\\_1%' ESCAPE '\\' GROUP BY ALL")
def search_cities(spark, d):
    n = tables.table(spark, d, "nation").select(F.col("n_nationkey").alias("city_code"), F.col("n_name").alias("city_name"))
    return search.search(n, ["city_name"], "n_1").join(tables.routes(spark, d), "city_code").groupBy("city_code", "city_name").agg(F.count("*").alias("routes"))


@query(f"""WITH {STOPS}, {SEQ}, g AS (SELECT node_id, count(DISTINCT route_id) AS routes FROM seq WHERE route_id % 3 = 0 GROUP BY node_id),
m AS (SELECT s.node_id, s.node_name, coalesce(g.routes, 0) AS routes, CASE WHEN g.node_id IS NULL THEN 1 ELSE 0 END AS source_rank FROM stops s LEFT JOIN g USING (node_id) WHERE node_name ILIKE '%red bolt%' OR node_name ILIKE '%redbolt%' OR node_name ILIKE '%blue bolt%' OR node_name ILIKE '%bluebolt%')
SELECT node_id, node_name, routes, source_rank FROM m ORDER BY source_rank, node_name, node_id LIMIT 50""")
def search_stops_merged(spark, d):
    found = search.search(tables.stops(spark, d), ["node_name"], "red bolt", (("red", "blue"),)).select("node_id", "node_name")
    routes = tables.sequence_rows(spark, d).where("route_id % 3 = 0").groupBy("node_id").agg(F.count_distinct("route_id").alias("routes"))
    live = found.join(routes, "node_id")
    both = search.first_source([live, found.withColumn("routes", F.lit(0).cast("long"))], ["node_id"])
    return search.top(both.select("node_id", "node_name", "routes", "source_rank"), ["source_rank", "node_name", "node_id"], 50)


@query(f"WITH {ROUTES} SELECT route_id, CAST(city_code AS BIGINT) AS city_code, status, priority FROM routes WHERE CAST(route_id AS VARCHAR) ILIKE '%77%' OR priority ILIKE '%77%' OR status ILIKE '%77%' ORDER BY route_id LIMIT 40")
def search_routes(spark, d):
    r = tables.routes(spark, d).withColumn("route_text", F.col("route_id").cast("string"))
    return search.top(search.search(r, ["route_text", "priority", "status"], "77"), ["route_id"], 40).select("route_id", "city_code", "status", "priority")


@query(f"""WITH {STOPS}, c AS (SELECT p_size, city_name, count(*) AS n FROM stops GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY n DESC, city_name) AS k FROM c) SELECT CAST(p_size AS BIGINT) AS p_size, city_name, n FROM r WHERE k = 1""")
def city_name_mode(spark, d):
    return search.mode(tables.stops(spark, d), "p_size", "city_name")


@query("SELECT page_id, url, CASE WHEN contains(lower(url), 'blog') THEN 0 ELSE 1 END AS tier FROM pages WHERE contains(lower(url), 'example.com') ORDER BY tier, url, page_id LIMIT 20 OFFSET 10".replace("CASE", "CAST(CASE").replace("END AS", "END AS BIGINT) AS"))
def registry_search_paged(spark, d):
    p = tables.table(spark, d, "pages").select("page_id", "url").where(F.contains(F.lower("url"), F.lit("example.com")))
    return search.page(p.withColumn("tier", F.when(F.contains(F.lower("url"), F.lit("blog")), 0).otherwise(1)), ["tier", "url", "page_id"], 10, 20)


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>') AS a FROM pages), y AS (SELECT page_id, unnest(a) AS a, generate_subscripts(a, 1) AS n FROM x),
z AS (SELECT page_id, regexp_extract(a, '<a href="([^"]*)">', 1) AS href, regexp_extract(a, '>([^<]*)</a>', 1) AS title, n FROM y)
SELECT href, min(page_id) AS first_page, count(DISTINCT page_id) AS pages, count(*) AS links FROM z GROUP BY href""")
def html_dataset_links(spark, d):
    p = tables.table(spark, d, "pages").select("page_id", F.explode(files.links(F.col("html"))).alias("a"))
    return p.groupBy(F.col("a.href").alias("href")).agg(F.min("page_id").alias("first_page"), F.count_distinct("page_id").alias("pages"), F.count("*").alias("links"))


@query(f"""WITH {ROUTES}, c AS (SELECT o_custkey AS case_id, o_orderpriority AS label FROM orders UNION SELECT o_custkey, 'NONE' FROM orders WHERE o_custkey % 30 = 0),
k AS (SELECT priority AS label, count(*) AS routes FROM routes WHERE priority NOT LIKE '4%' GROUP BY 1),
b AS (SELECT case_id, count(*) AS labels, count(routes) AS known, CAST(coalesce(sum(routes), 0) AS BIGINT) AS routes FROM c LEFT JOIN k USING (label) GROUP BY case_id)
SELECT case_id, labels, known, routes, CASE WHEN known = labels THEN 'all_labels_found' WHEN known > 0 THEN 'some_labels_found' ELSE 'no_label_found' END AS status FROM b""")
def research_verification(spark, d):
    o = tables.table(spark, d, "orders")
    cases = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("labels"))
    cases = cases.withColumn("labels", F.when(F.col("case_id") % 30 == 0, F.concat("labels", F.array(F.lit("NONE")))).otherwise(F.col("labels")))
    return ingest.research(cases, tables.routes(spark, d).where("priority not like '4%'").select(F.col("priority").alias("label")))


# --- checks of imports --------------------------------------------------------------------------


@query(f"""WITH {STOPS}, r AS (SELECT CASE WHEN latitude IS NULL THEN 'missing_coordinate' WHEN latitude NOT BETWEEN 36 AND 36.35 THEN 'out_of_range' WHEN length(node_name) > 12 THEN 'long_name' WHEN p_size IS NULL OR p_size < 3 THEN 'bad_size' ELSE '' END AS reason FROM stops)
SELECT reason, count(*) AS rows FROM r GROUP BY reason""")
def quarantine_split(spark, d):
    checks = [("missing_coordinate", F.col("latitude").isNotNull()), ("out_of_range", F.col("latitude").between(36, 36.35)), ("long_name", F.length("node_name") <= 12), ("bad_size", F.col("p_size") >= 3)]
    return ingest.quality(tables.stops(spark, d), checks)


@query("""WITH cat AS (SELECT c_custkey % 400 AS node_id, c_mktsegment AS area, c_nationkey AS city_code FROM customer WHERE c_custkey % 3 = 0), ask AS (SELECT c_custkey AS row_id, c_custkey % 500 AS node_id, c_mktsegment AS area FROM customer),
e AS (SELECT node_id, count(*) AS n_all, min(city_code) AS any_city FROM cat GROUP BY 1), h AS (SELECT node_id, area, count(*) AS n_area, min(city_code) AS area_city FROM cat GROUP BY 1, 2),
j AS (SELECT ask.*, coalesce(n_all, 0) AS n_all, coalesce(n_area, 0) AS n_area, any_city, area_city FROM ask LEFT JOIN e USING (node_id) LEFT JOIN h USING (node_id, area))
SELECT row_id, CAST(CASE WHEN n_area = 1 THEN area_city WHEN n_area = 0 AND n_all = 1 THEN any_city END AS BIGINT) AS resolved_city, CASE WHEN n_area = 1 OR (n_area = 0 AND n_all = 1) THEN 'resolved' WHEN n_all = 0 THEN 'missing' ELSE 'ambiguous' END AS status FROM j""")
def resolve_exact_ids(spark, d):
    c = tables.table(spark, d, "customer")
    cat = c.where("c_custkey % 3 = 0").select((F.col("c_custkey") % 400).alias("node_id"), F.col("c_mktsegment").alias("area"), F.col("c_nationkey").alias("city_code"))
    ask = c.select(F.col("c_custkey").alias("row_id"), (F.col("c_custkey") % 500).alias("node_id"), F.col("c_mktsegment").alias("area"))
    return ingest.resolve_exact(ask, cat, "node_id", "area").select("row_id", "resolved_city", "status")


@query(f"""WITH {ROUTES}, o AS (SELECT route_id % 2000 AS route_id, city_code AS region, priority AS digest FROM routes), w AS (SELECT route_id % 2500 AS route_id, city_code FROM routes WHERE route_id % 7 = 0),
b AS (SELECT route_id, count(*) AS occurrences, count(DISTINCT digest) AS digests, min(region) AS r FROM o GROUP BY 1), x AS (SELECT route_id, count(DISTINCT city_code) AS cities, min(city_code) AS city FROM w GROUP BY 1),
s AS (SELECT *, CASE WHEN digests > 1 THEN 'conflict' WHEN coalesce(cities, 0) = 1 THEN 'catalog_owner' WHEN coalesce(cities, 0) = 0 THEN 'first_region' ELSE 'ambiguous_owner' END AS status FROM b LEFT JOIN x USING (route_id))
SELECT route_id, occurrences, status, CAST(CASE status WHEN 'catalog_owner' THEN city WHEN 'first_region' THEN r END AS BIGINT) AS owner FROM s""")
def reconcile_regions(spark, d):
    r = tables.routes(spark, d)
    occ = r.select((F.col("route_id") % 2000).alias("route_id"), F.col("city_code").alias("region"), F.col("priority").alias("digest"))
    own = r.where("route_id % 7 = 0").select((F.col("route_id") % 2500).alias("route_id"), "city_code")
    return ingest.reconcile(occ, own).select("route_id", "occurrences", "status", "owner")


@query(f"""WITH {STOPS}, l AS (SELECT node_id % 300 AS num, node_name, count(*) AS n, min((latitude, longitude)) AS c FROM stops WHERE latitude IS NOT NULL AND node_id % 2 = 0 GROUP BY 1, 2 HAVING count(*) = 1),
g AS (SELECT node_id % 300 AS num, node_name, count(*) AS n, min((latitude, longitude)) AS c FROM stops WHERE latitude IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1)
SELECT s.node_id, CASE WHEN l.n IS NOT NULL THEN 'local' WHEN g.n IS NOT NULL THEN 'national' END AS coordinate_source FROM stops s LEFT JOIN l ON l.num = s.node_id % 300 AND l.node_name = s.node_name LEFT JOIN g ON g.num = s.node_id % 300 AND g.node_name = s.node_name""")
def coordinate_exact_name_join(spark, d):
    s = tables.stops(spark, d).withColumn("num", F.col("node_id") % 300)
    placed = s.where("latitude is not null").select("num", "node_name", "latitude", "longitude", "node_id")
    return ingest.coordinate_by_number_and_name(s.select("node_id", "num", "node_name"), placed.where("node_id % 2 = 0").drop("node_id"), placed.drop("node_id"), "num", "node_name").select("node_id", "coordinate_source")


@query("""SELECT p_partkey AS route_id, CAST(p_size AS BIGINT) AS min_headway, CAST(p_partkey % 40 AS BIGINT) AS max_headway, CASE WHEN p_size > p_partkey % 40 THEN 'PUBLISHED_MIN_HEADWAY_GT_MAX' ELSE '' END || CASE WHEN p_size > p_partkey % 40 AND p_partkey % 9 = 0 THEN ',' ELSE '' END || CASE WHEN p_partkey % 9 = 0 THEN 'NO_DAILY_RUNS' ELSE '' END AS flags FROM part""")
def service_summary_flags(spark, d):
    p = tables.table(spark, d, "part").select(F.col("p_partkey").alias("route_id"), F.col("p_size").alias("min_headway"), (F.col("p_partkey") % 40).alias("max_headway"), (F.col("p_partkey") % 9).alias("daily_runs"))
    return ingest.headway_flags(p).select("route_id", "min_headway", "max_headway", F.array_join("quality_flags", ",").alias("flags"))
