"""Relational queries whose SQL reads the same for Spark and DuckDB: one text each, planned by Catalyst.

``{listing}`` stands for the listing view and ``{table}`` for a base table; the oracle gets the same text over DuckDB's own views.
Ties are broken by unit_key or an id, so that first-wins rules have one outcome.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .listing import SQL, listing, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def views(spark: SparkSession, d: str, text: str) -> dict[str, DataFrame]:
    return {n: listing(spark, d) if n == "listing" else table(spark, d, n) for n in set(re.findall(r"\{(\w+)\}", text))}


def add(name: str, text: str, duck: str | None = None) -> None:
    """One portable text; ``duck`` where the dialects part."""
    QUERIES[name] = lambda spark, d: spark.sql(text, **views(spark, d, text))
    own = re.sub(r"\{(\w+)\}", r"\1", duck or text).strip()
    if re.search(r"\{listing\}", duck or text):
        own = SQL + ("," + own[4:] if own.upper().startswith("WITH") else " " + own)
    ORACLE[name] = own


# --- predicates and projections -------------------------------------------------------------------------------------------------
add("p1_valid_price", "SELECT unit_key, prix AS prix FROM {listing} WHERE prix > 0 AND prix < 500000")
add("p3_minimum_price", "SELECT unit_key FROM {listing} WHERE prix >= 1")
add("p6_non_product_url", "SELECT page_id FROM (SELECT page_id, lower(url) AS u FROM {pages}) WHERE u LIKE '%/cart%' OR u LIKE '%/login%' OR u LIKE '%/contact%' OR u LIKE '%page=%' OR u LIKE '%/tag/%' OR u LIKE '%#%'")
add("p9_inventory_only", "SELECT unit_key FROM {listing} WHERE (etat = 'occasion' OR disponibilite = 'F') OR NOT (etat = 'neuf' AND disponibilite = 'O' AND prix IS NULL)")
add("p11_facet_filter", "SELECT unit_key FROM {listing} WHERE (lower(name) LIKE '%small%' OR lower(marque) LIKE '%small%') AND annee = 1997 AND etat = 'neuf' AND prix >= 10")
add("p12_facet_values", "SELECT 'site' AS facet, CAST(site AS VARCHAR(20)) AS value FROM {listing} GROUP BY site UNION ALL SELECT 'brand', marque FROM {listing} GROUP BY marque UNION ALL SELECT 'year', CAST(annee AS VARCHAR(20)) FROM {listing} GROUP BY annee UNION ALL SELECT 'state', etat FROM {listing} GROUP BY etat UNION ALL SELECT 'type', category FROM {listing} GROUP BY category UNION ALL SELECT 'status', disponibilite FROM {listing} GROUP BY disponibilite")
add("p14_tab_partition", "SELECT CASE WHEN site = 0 THEN 'reference' WHEN EXISTS (SELECT 1 FROM {listing} r WHERE r.site = 0 AND r.product = l.product) THEN 'compared' ELSE 'other' END AS tab, count(*) AS n FROM {listing} l GROUP BY 1")
add("p15_slim_rows", "SELECT unit_key, name, prix AS prix, site FROM {listing}")
add("p16_taxonomy_under", "SELECT p_partkey, path = 'root.' || lower(left(p_type, 1)) OR path LIKE 'root.' || lower(left(p_type, 1)) || '.%' AS is_under FROM (SELECT p_partkey, p_type, 'root.' || lower(left(p_type, 1)) || '.' || p_size AS path FROM {part})")
add("p20_read_filters", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND lower(o_orderpriority) LIKE '%high%' AND o_orderdate IS NOT NULL ORDER BY o_orderkey LIMIT 50 OFFSET 10")

# --- joins ------------------------------------------------------------------------------------------------------------------------
STEP = "SELECT site, product, y, p, lag(p) OVER (PARTITION BY site, product ORDER BY y) AS was, lag(y) OVER (PARTITION BY site, product ORDER BY y) AS wy FROM (SELECT site, product, annee AS y, min(prix) AS p FROM {listing} GROUP BY site, product, annee)"
add("j8_trigger_diff", f"SELECT site, product, y, was AS old_price, p AS new_price, CASE WHEN was IS NULL THEN 'baseline' ELSE 'price_change' END AS change_type FROM ({STEP}) WHERE p >= 1 AND (was IS NULL OR p <> was)")
add("j9_expand_units", "SELECT site, product, u.unit_key AS unit_key, u.prix AS prix FROM (SELECT site, product, collect_list(named_struct('unit_key', unit_key, 'prix', prix)) AS units FROM {listing} GROUP BY site, product) LATERAL VIEW explode(units) x AS u", "SELECT site, product, unit_key, prix AS prix FROM {listing}")
add("j17_canonical_view", "SELECT p.p_partkey, l.l_suppkey, round(l.l_extendedprice / l.l_quantity / p.p_retailprice * 100, 6) AS pct_of_list FROM {part} p JOIN {lineitem} l ON l.l_partkey = p.p_partkey WHERE l.l_linestatus = 'O' AND p.p_retailprice > 0")
add("j18_unmatched_view", "SELECT o_orderkey, o_custkey FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING' WHERE c_custkey IS NULL")
add("j19_cache_stats_view", "SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS top, round(avg(o_totalprice), 6) AS mean FROM {customer} LEFT JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
add("j20_scalar_subqueries", "SELECT s_suppkey, (SELECT max(l_extendedprice) FROM {lineitem} WHERE l_suppkey = s_suppkey) AS top, (SELECT count(*) FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_returnflag = 'R') AS returned, EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_quantity > 49) AS large FROM {supplier}")
add("j21_embedded_join", "SELECT o_orderkey, c_name, n_name FROM {orders} LEFT JOIN {customer} ON c_custkey = o_custkey LEFT JOIN {nation} ON n_nationkey = c_nationkey")
add("j22_semi_ready", "SELECT c_custkey FROM {customer} LEFT SEMI JOIN {orders} ON o_custkey = c_custkey AND o_totalprice > 100000", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
add("j23_anti_muted", "SELECT c_custkey FROM {customer} LEFT ANTI JOIN {orders} ON o_custkey = c_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
add("j24_user_channels", "SELECT e.user_id, c.c_name, count(*) AS n FROM {events} e LEFT JOIN {customer} c ON c.c_custkey = e.user_id GROUP BY e.user_id, c.c_name")
add("j25_golden_diff", "SELECT d.doc_id, d.n_chars AS expected, length(d.text) AS actual, coalesce(abs(d.n_chars - length(d.text)) <= 0.05 * d.n_chars, false) AS same FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id", "SELECT d.doc_id, d.n_chars AS expected, CAST(length(d.text) AS INTEGER) AS actual, coalesce(abs(d.n_chars - length(d.text)) <= 0.05 * d.n_chars, false) AS same FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id")
add("j26_bench_ab", "SELECT a.site, round(b.p - a.p, 6) AS delta FROM (SELECT site, avg(prix) AS p FROM {listing} WHERE annee = 1996 GROUP BY site) a JOIN (SELECT site, avg(prix) AS p FROM {listing} WHERE annee = 1997 GROUP BY site) b ON a.site = b.site")
add("j29_config_join", "SELECT s_suppkey, count(*) AS n FROM {supplier} JOIN {lineitem} ON l_suppkey = s_suppkey WHERE s_acctbal > 0 GROUP BY s_suppkey")
add("j30_semi_all", "SELECT p_partkey FROM {part} LEFT SEMI JOIN {lineitem} ON l_partkey = p_partkey AND l_quantity > 45", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 45)")
add("j31_read_flags", "SELECT c.c_custkey, count_if(o.o_orderkey IS NOT NULL AND o.o_orderdate <= TIMESTAMP '1997-01-01 00:00:00') AS read, count_if(o.o_orderdate > TIMESTAMP '1997-01-01 00:00:00') AS unread FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey", "SELECT c.c_custkey, count(*) FILTER (WHERE o.o_orderkey IS NOT NULL AND o.o_orderdate <= TIMESTAMP '1997-01-01 00:00:00') AS read, count(*) FILTER (WHERE o.o_orderdate > TIMESTAMP '1997-01-01 00:00:00') AS unread FROM {customer} c LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey")
add("j32_first_unseen", "SELECT c_custkey, min(c_acctbal) AS bal FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) GROUP BY c_custkey ORDER BY c_custkey LIMIT 1")
add("j33_enrichment", "SELECT l_orderkey * 10 + l_linenumber AS k, l_partkey, l_partkey IN (SELECT p_partkey FROM {part} WHERE p_size > 40) AS large FROM {lineitem}")

# --- aggregations -------------------------------------------------------------------------------------------------------------------
GROUP_KEY = "lower(marque) || '|' || lower(modele) || '|' || annee || '|' || etat"
add("a2_canonical_aggregate", "SELECT product, round(avg(prix), 6) AS mean, min(prix) AS low, max(prix) AS high, count(*) AS n FROM {listing} WHERE disponibilite = 'O' AND prix > 0 GROUP BY product")
add("a11_report_past", "SELECT annee, count(*) AS n, count(DISTINCT product) AS products, count(DISTINCT site) AS sites, round(avg(prix), 6) AS mean FROM {listing} GROUP BY annee")
add("a12_events_per_day", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM {events} GROUP BY 1")
add("a16_change_summary", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) AS n FROM {events} GROUP BY user_id")
add("a18_counters", "SELECT marque, category, etat, count(*) AS n FROM {listing} GROUP BY GROUPING SETS ((marque), (category), (etat), (category, etat))")
add("a18_examples", "SELECT category, etat, unit_key FROM (SELECT category, etat, unit_key, row_number() OVER (PARTITION BY category, etat ORDER BY ord, unit_key) AS rn FROM {listing}) WHERE rn <= 3")
add("a19_admin_stats", "SELECT coalesce(c_mktsegment, 'unknown') AS segment, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS in_debt, max(c_acctbal) AS top FROM {customer} GROUP BY 1")
add("a20_bench_aggregate", "SELECT count(*) FILTER (WHERE quality = 1) AS passed, count(*) FILTER (WHERE quality = 0) AS failed, round(avg(quality), 6) AS score, avg(quality) > 0.8 AS gate FROM {labels}")
add("a21_field_coverage", "SELECT source, count(*) AS total, count(*) FILTER (WHERE text IS NOT NULL AND text <> '') AS with_text, count(*) FILTER (WHERE lang IS NOT NULL AND lang <> '') AS with_lang, count(*) FILTER (WHERE n_chars IS NOT NULL AND n_chars <> 0) AS with_chars FROM {documents} GROUP BY source")
add("a23_soft_404", "SELECT count(*) FILTER (WHERE lower(html) LIKE '%404%' OR lower(html) LIKE '%not found%') AS n FROM {pages}")
add("a24_time_buckets", "SELECT site, date_trunc('month', scraped_at) AS month, round(avg(prix), 6) AS mean, count(*) AS n FROM {listing} GROUP BY 1, 2")
add("a26_condition_mix", "SELECT site, round(100 * count(*) FILTER (WHERE etat = 'neuf') / count(*), 6) AS new_pct, round(100 * count(*) FILTER (WHERE etat = 'occasion') / count(*), 6) AS used_pct, round(100 * count(*) FILTER (WHERE etat = 'demonstrateur') / count(*), 6) AS demo_pct FROM {listing} GROUP BY site")
add("a27_families", "SELECT marque, category, count(*) AS n, count(DISTINCT modele) AS models FROM {listing} GROUP BY marque, category HAVING count(DISTINCT modele) > 1")
add("a28_counter_sync", "SELECT o_custkey, count(*) AS items, count(*) FILTER (WHERE o_orderstatus = 'F') AS applied FROM {orders} GROUP BY o_custkey")
add("a29_cache_stats", "SELECT l_linestatus, count(*) AS n, max(l_shipdate) AS latest, round(avg(l_quantity), 6) AS mean, round(sum(l_quantity), 2) AS total FROM {lineitem} GROUP BY l_linestatus")
add("a30_activity", "SELECT user_id, max(ts) AS last_seen, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(*) FILTER (WHERE event_type = 'purchase') AS purchases, round(avg(value), 6) AS mean FROM {events} GROUP BY user_id")
add("a33_run_totals", "SELECT count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 10) AS hits, count(*) AS scanned FROM {events}")
add("a34_ingestion_counters", "SELECT count(*) AS fetched, count(*) FILTER (WHERE l_returnflag = 'N') AS created, count(*) FILTER (WHERE l_returnflag = 'R') AS updated, count(*) FILTER (WHERE l_returnflag = 'A') AS unmatched FROM {lineitem}")
add("a35_coefficient_of_variation", "SELECT site, round(stddev_samp(prix) / avg(prix), 6) AS cv FROM {listing} GROUP BY site HAVING count(*) > 1")
add("a39_distinct_quota", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS used, count(DISTINCT o_orderpriority) >= 3 AS over_limit FROM {orders} GROUP BY o_custkey")
add("a40_user_rollup", "SELECT c_custkey, coalesce(n, 0) AS orders, latest FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey")
add("a41_gap_filled_days", "SELECT d AS day, count(event_id) AS n FROM (SELECT explode(sequence(DATE'2024-01-25', DATE'2024-02-07', INTERVAL 1 DAY)) AS d) LEFT JOIN {events} ON CAST(ts AS DATE) = d GROUP BY d", "SELECT d AS day, count(event_id) AS n FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-25', DATE '2024-02-07', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN {events} ON CAST(ts AS DATE) = d GROUP BY d")
add("a43_increase_decrease", f"SELECT site, round(sum(CASE WHEN p < was THEN p - was ELSE 0 END), 2) AS decreases, round(sum(CASE WHEN p > was THEN p - was ELSE 0 END), 2) AS increases FROM ({STEP}) WHERE was IS NOT NULL GROUP BY site")
add("a44_legacy_grouping", "SELECT site, lower(marque) AS marque, lower(modele) AS modele, annee, etat, count(*) AS quantity, CASE WHEN count(prix) = count(*) THEN min(prix) END AS prix FROM {listing} GROUP BY 1, 2, 3, 4, 5")
add("a46_run_summary", "SELECT site, etat, category, count(*) AS n FROM {listing} GROUP BY site, etat, category")
add("a47_purge_summary", "SELECT s_nationkey, count(*) AS n FROM {supplier} WHERE s_acctbal < 0 GROUP BY s_nationkey")
add("a48_pending_items", "SELECT CAST(sum(greatest(0, l_linenumber - 3)) AS BIGINT) AS pending FROM {lineitem} WHERE l_linestatus = 'O'")
add("a49_cohort_rollup", "SELECT c_mktsegment, count(*) AS users, CAST(sum(coalesce(n, 0)) AS BIGINT) AS orders, max(latest) AS latest FROM {customer} LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey GROUP BY c_mktsegment")
add("a50_first_last_variation", "SELECT user_id, round((l - f) / f * 100, 6) AS pct FROM (SELECT user_id, min_by(value, named_struct('t', ts, 'i', event_id)) AS f, max_by(value, named_struct('t', ts, 'i', event_id)) AS l FROM {events} WHERE value > 0 GROUP BY user_id)", "SELECT user_id, round((l - f) / f * 100, 6) AS pct FROM (SELECT user_id, min_by(value, (ts, event_id)) AS f, max_by(value, (ts, event_id)) AS l FROM {events} WHERE value > 0 GROUP BY user_id)")

# --- windows ------------------------------------------------------------------------------------------------------------------------
add("w2_leave_one_out", "SELECT unit_key, round((sum(prix) OVER (PARTITION BY product) - prix) / nullif(count(*) OVER (PARTITION BY product) - 1, 0), 6) AS others FROM {listing}")
add("w3_latest_per_key", "SELECT site, product, unit_key FROM (SELECT site, product, unit_key, row_number() OVER (PARTITION BY site, product ORDER BY scraped_at DESC, ord DESC, unit_key DESC) AS rn FROM {listing}) WHERE rn = 1")
add("w5_running_sum", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 3) AS total FROM {events}")
add("w7_first_last_snapshot", "SELECT site, round((l - f) / f * 100, 6) AS pct FROM (SELECT site, avg(CASE WHEN annee = 1995 THEN prix END) AS f, avg(CASE WHEN annee = 2000 THEN prix END) AS l FROM {listing} GROUP BY site) WHERE f IS NOT NULL AND l IS NOT NULL")
add("w9_delta_alert", "SELECT event_id, round(value - was, 6) AS delta FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM {events}) WHERE value - was < -50")
add("w10_distinct_on", "SELECT product, unit_key FROM (SELECT product, unit_key, row_number() OVER (PARTITION BY product ORDER BY ord, unit_key) AS rn FROM {listing}) WHERE rn = 1")
add("w11_weighted_percentile", "SELECT product, round(min(CASE WHEN cw >= 0.5 * tw THEN prix END), 6) AS p50, round(min(CASE WHEN cw >= 0.25 * tw THEN prix END), 6) AS p25 FROM (SELECT product, prix, sum(w) OVER (PARTITION BY product ORDER BY prix, unit_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(w) OVER (PARTITION BY product) AS tw FROM (SELECT product, prix, unit_key, 1 + site % 4 AS w FROM {listing})) GROUP BY product")
add("w14_unit_position", "SELECT unit_key, CAST(row_number() OVER (PARTITION BY site, product ORDER BY ord, unit_key) AS VARCHAR(9)) || '/' || CAST(count(*) OVER (PARTITION BY site, product) AS VARCHAR(9)) AS position FROM {listing}")
add("w15_least_recent", "SELECT c_custkey FROM {customer} LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS latest FROM {orders} GROUP BY o_custkey) ON o_custkey = c_custkey ORDER BY latest ASC NULLS FIRST, c_custkey LIMIT 20")
add("w16_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) WHERE rn <= 5")

# --- order, top-k, dedup, sets ----------------------------------------------------------------------------------------------------
add("t4_multi_key_sort", "SELECT unit_key FROM {listing} ORDER BY annee DESC, prix, unit_key LIMIT 100")
add("t5_digest_sort", "SELECT event_id FROM {events} ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, abs(value) DESC, event_id LIMIT 20")
add("t7_queue_pop", "SELECT o_orderkey FROM {orders} WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 25")
add("t8_top_sites", "SELECT site, round(sum(prix), 2) AS total FROM {listing} GROUP BY site ORDER BY sum(prix) DESC, site LIMIT 5")
add("t9_pagination", "SELECT unit_key, (SELECT count(*) FROM {listing} WHERE category = 'STANDARD') AS total FROM {listing} WHERE category = 'STANDARD' ORDER BY unit_key LIMIT 25 OFFSET 50")
add("t11_tab_page", "SELECT unit_key FROM {listing} WHERE lower(name) LIKE '%brand#1%' AND category = 'PROMO' ORDER BY prix DESC, unit_key LIMIT 25 OFFSET 25")
add("t13_type_priority", "SELECT product, unit_key FROM (SELECT product, unit_key, row_number() OVER (PARTITION BY product ORDER BY CASE etat WHEN 'neuf' THEN 1 WHEN 'demonstrateur' THEN 2 ELSE 3 END, ord, unit_key) AS rn FROM {listing}) WHERE rn = 1")
add("t16_latest_before", "SELECT o_custkey, coalesce(max(CASE WHEN o_orderdate < TIMESTAMP '1997-06-01 00:00:00' THEN o_orderdate END), max(o_orderdate)) AS report FROM {orders} GROUP BY o_custkey")
add("t17_evict_oldest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) WHERE rn <= 9")
add("t18_price_history_page", "SELECT o_orderkey FROM {orders} WHERE o_custkey < 50 ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
add("dd3_dedup_stock", "SELECT unit_key FROM (SELECT unit_key, row_number() OVER (PARTITION BY coalesce(nullif(CASE WHEN site % 2 = 0 THEN CAST(product AS VARCHAR(20)) ELSE '' END, ''), name || '-' || CAST(round(prix) AS BIGINT)) ORDER BY ord, unit_key) AS rn FROM {listing}) WHERE rn = 1")
add("dd5_dedup_comparables", "SELECT name, CAST(floor(prix / 100) AS BIGINT) AS bucket, site, min(ord) AS first_ord FROM {listing} GROUP BY 1, 2, 3")
add("dd6_max_confidence", "SELECT p_brand, max_by(p_partkey, named_struct('r', p_retailprice, 'k', p_partkey)) AS p_partkey FROM {part} GROUP BY p_brand", "SELECT p_brand, max_by(p_partkey, (p_retailprice, p_partkey)) AS p_partkey FROM {part} GROUP BY p_brand")
add("dd7_distinct", "SELECT DISTINCT marque, category FROM {listing}")
add("dd8_url_only_dedup", "SELECT page_id FROM (SELECT page_id, url, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM {pages}) WHERE rn = 1 OR url IS NULL")
add("u1_union_all", "SELECT product, count(*) AS n, 'multi' AS kind FROM {listing} GROUP BY product HAVING count(*) > 1 UNION ALL SELECT product, count(*), 'mono' FROM {listing} GROUP BY product HAVING count(*) = 1")
add("u2_present_in_both", "SELECT product FROM {listing} WHERE annee = 1995 INTERSECT SELECT product FROM {listing} WHERE annee = 2000")
add("u4_set_difference", "SELECT product FROM {listing} WHERE site = 1 EXCEPT SELECT product FROM {listing} WHERE site = 0")
add("u5_language_filter", "SELECT page_id FROM (SELECT page_id, fr, max(fr) OVER (PARTITION BY k) AS any_kept FROM (SELECT page_id, CASE WHEN url LIKE '%/fr/%' THEN 1 ELSE 0 END AS fr, replace(replace(url, '/fr/', '/'), '/en/', '/') AS k FROM {pages})) WHERE fr = any_kept")

# --- stateful, in batch form --------------------------------------------------------------------------------------------------------
add("st6_churn_guard", f"SELECT site, y, n_new, n, NOT (n_new > 5 AND n_new > 0.3 * n) AS emit FROM (SELECT site, y, count(*) FILTER (WHERE was IS NULL) AS n_new, count(*) AS n FROM ({STEP}) GROUP BY site, y)")
add("st8_sliding_ranges", "SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29 00:00:00') AS day, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23 00:00:00') AS week FROM {events} GROUP BY event_type")
add("st9_tumbling_day", "SELECT window.start AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY window(ts, '1 day'), event_type", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY 1, 2")
