"""Reads, joins, aggregates, triage and workflow over the register views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import OPEN_STATUSES, PRIORITIES, STATUSES
from ..operators import analytics, reads, triage, workflow
from .registry import Registry
from .views import AS_OF, EVENTS, EVENTS_AS_OF, PARCELS, SUBS, as_of, parcels, review_events, sub_divisions, time_text

query = Registry()
OPEN = "review_status IN ('pending','in_review','escalated')"
NOW, ENOW = f"TIMESTAMP '{AS_OF}'", f"TIMESTAMP '{EVENTS_AS_OF}'"
T = "'%Y-%m-%d %H:%M:%S'"
SUMMARY = reads.SUMMARY
S = ", ".join(SUMMARY)


# Filters


@query("fl1_shared_filter", f"WITH {PARCELS} SELECT {S} FROM parcels WHERE state = 'ASIA' AND review_status = 'pending' AND mismatch >= 40 AND {OPEN} AND assigned_to IS NULL")
def fl1(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return p.filter(reads.parcel_filter(p.columns, state="ASIA", review_status="pending", min_mismatch=40, open_only=True, unassigned=True)).select(*SUMMARY)


@query("fl2_free_text", f"WITH {PARCELS} SELECT {S} FROM parcels WHERE village ILIKE '%furn%' OR district ILIKE '%furn%' OR khata_number ILIKE '%furn%' OR survey_number ILIKE '%furn%' OR state ILIKE '%furn%'")
def fl2(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return p.filter(reads.parcel_filter(p.columns, q=" Furn ")).select(*SUMMARY)


@query("fl3_equalities", f"WITH {PARCELS} SELECT {S} FROM parcels WHERE state = 'EUROPE' AND village = 'BUILDING' AND priority = 'high' AND severity = 'warning' AND action = 'auto_approve'")
def fl3(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return p.filter(reads.parcel_filter(p.columns, state="EUROPE", village="BUILDING", priority="high", severity="warning", recommended_action="auto_approve")).select(*SUMMARY)


@query("fl4_ranges", f"WITH {PARCELS} SELECT {S} FROM parcels WHERE mismatch >= 75.5 AND confidence <= 0.25")
def fl4(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return p.filter(reads.parcel_filter(p.columns, min_mismatch=75.5, max_confidence=0.25)).select(*SUMMARY)


@query("fl5_null_predicates", f"WITH {PARCELS} SELECT {S} FROM parcels WHERE assigned_to IS NULL AND has_geometry")
def fl5(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return p.filter(reads.parcel_filter(p.columns, unassigned=True, has_geometry=True)).select(*SUMMARY)


@query("fl6_overdue", f"WITH {PARCELS} SELECT {S}, strftime(sla_due_at, {T}) AS due FROM parcels WHERE sla_due_at IS NOT NULL AND sla_due_at < {NOW} AND {OPEN}")
def fl6(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return p.filter(reads.parcel_filter(p.columns, as_of(), overdue=True)).select(*SUMMARY, time_text("sla_due_at").alias("due"))


@query("fl7_scope", f"WITH {PARCELS} SELECT count(*) AS n, count(mismatch) AS measured FROM parcels WHERE state = 'AFRICA' AND district = 'NATION_10'")
def fl7(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return p.filter(reads.parcel_filter(p.columns, state="AFRICA", district="NATION_10")).agg(F.count(F.lit(1)).alias("n"), F.count("mismatch").alias("measured"))


@query("fl9_detail_with_reasons")
def fl9(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).select(*SUMMARY, triage.score().alias("score"), triage.reasons().alias("reasons"))


LIGHT = "CASE WHEN action = 'reject_re_scan' OR severity = 'critical' OR mismatch >= 50 THEN 'red' WHEN action = 'auto_approve' AND (severity IS NULL OR severity NOT IN ('error','warning','critical')) AND (mismatch < 50 OR mismatch IS NULL) THEN 'green' ELSE 'yellow' END"


@query("fl10_summary_projection", f"WITH {PARCELS} SELECT {S} FROM parcels")
def fl10(spark: SparkSession, d: str) -> DataFrame:
    return reads.summary_rows(parcels(spark, d))


@query("fl11_traffic_light", f"WITH {PARCELS} SELECT id, {LIGHT} AS light FROM parcels")
def fl11(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).select("id", reads.traffic_light().alias("light"))


@query("fl12_sla_pill", f"WITH {PARCELS}, h AS (SELECT id, review_status, sla_due_at, round((epoch_us(sla_due_at) - epoch_us(TIMESTAMP '1998-08-02 00:00:00')) / 3.6e9) AS hours FROM parcels) SELECT id, CASE WHEN review_status IN ('approved','rejected') OR sla_due_at IS NULL THEN 'none' WHEN hours < 0 THEN 'overdue' WHEN hours <= 24 THEN 'due_soon' ELSE 'on_track' END AS pill FROM h")
def fl12(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).select("id", reads.sla_pill(as_of("1998-08-02 00:00:00")).alias("pill"))


# Joins


@query("jn1_audit_join", f"WITH {PARCELS}, {EVENTS} SELECT e.id, e.parcel_id, e.reviewer, e.action, p.state, p.district, p.survey_number, strftime(e.created_at, {T}) AS at FROM review_events e JOIN parcels p ON e.parcel_id = p.id WHERE e.action = 'corrected' AND p.district = 'NATION_3' ORDER BY e.created_at DESC, e.id LIMIT 100")
def jn1(spark: SparkSession, d: str) -> DataFrame:
    out = reads.audit(review_events(spark, d), parcels(spark, d), action="corrected", district="NATION_3")
    return out.orderBy(F.col("created_at").desc(), "id").limit(100).select("id", "parcel_id", "reviewer", "action", "state", "district", "survey_number", time_text("created_at").alias("at"))


@query("jn2_audit_export", f"WITH {PARCELS}, {EVENTS} SELECT e.id, p.state, p.district, p.village, e.reviewer, e.action, concat('{{\"value\":', e.k, '}}') AS new_value FROM review_events e JOIN parcels p ON e.parcel_id = p.id")
def jn2(spark: SparkSession, d: str) -> DataFrame:
    out = reads.audit(review_events(spark, d), parcels(spark, d))
    return out.select("id", "state", "district", "village", "reviewer", "action", F.to_json(F.struct(F.col("k").alias("value"))).alias("new_value"))


@query("jn3_parcel_document", f"WITH {PARCELS} SELECT p.id, p.document_id, c.c_name AS document_name FROM parcels p LEFT JOIN customer c ON p.document_id = c.c_custkey")
def jn3(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("document_name"))
    return reads.with_document(parcels(spark, d), docs).select("id", "document_id", "document_name")


@query("jn4_case_events", "SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def jn4(spark: SparkSession, d: str) -> DataFrame:
    rows = reads.in_order(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "role")
    return rows.select("conv_id", "n", F.array_join("all", ",").alias("roles"))


@query("jn5_parcels_with_events", f"WITH {PARCELS}, {EVENTS} SELECT id, state FROM parcels WHERE id IN (SELECT parcel_id FROM review_events WHERE action = 'flagged')")
def jn5(spark: SparkSession, d: str) -> DataFrame:
    return reads.with_event(parcels(spark, d), review_events(spark, d), "flagged").select("id", "state")


@query("jn6_first_match", f"WITH {PARCELS}, {SUBS}, f AS (SELECT parcel_id, min((number, part, supplier, area)) AS m FROM sub_divisions GROUP BY 1) SELECT id, f.m[2] AS first_part, CAST(f.m[4] AS DOUBLE) AS first_area FROM parcels LEFT JOIN f ON id = parcel_id".replace("f.m[2]", "struct_extract_at(f.m, 2)").replace("f.m[4]", "struct_extract_at(f.m, 4)"))
def jn6(spark: SparkSession, d: str) -> DataFrame:
    subs = sub_divisions(spark, d).withColumn("place", F.struct("number", "part", "supplier", "area")).select(F.col("parcel_id").alias("id"), "part", "area", "place")
    ids = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))  # the parcels' ids, without the joins that give their other columns
    out = reads.first_match(ids, subs, "id", "place")
    return out.select("id", F.col("part").alias("first_part"), F.col("area").cast("double").alias("first_area"))


@query("jn7_geometry_lookup", f"WITH {PARCELS}, g AS (SELECT o_orderkey AS gid, o_orderkey * 2 AS geom FROM orders WHERE o_orderkey % 6 <> 0) SELECT id, geom, geom IS NULL AS missing FROM parcels LEFT JOIN g ON id = gid")
def jn7(spark: SparkSession, d: str) -> DataFrame:
    g = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderkey % 6 <> 0").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 2).alias("geom"))
    return reads.with_geometry(parcels(spark, d), g).select("id", "geom", "missing")


# Aggregates

FLAGGED = "sum(CASE WHEN severity IN ('error','critical') OR mismatch >= 50 THEN 1 ELSE 0 END)"
AVG_C = "round(CAST(sum(CAST(confidence AS DECIMAL(10,3))) AS DOUBLE) / CAST(count(confidence) AS DOUBLE), 4)"
AVG_M = "round(CAST(sum(CAST(mismatch AS DECIMAL(10,3))) AS DOUBLE) / CAST(count(mismatch) AS DOUBLE), 2)"
AREA = "round(CAST(sum(area) AS DOUBLE) / 10000, 3)"


@query("ag1_summary", f"WITH {PARCELS}, l AS (SELECT *, {LIGHT} AS light FROM parcels), a AS (SELECT count(*) AS total_parcels, sum(CASE WHEN light = 'green' THEN 1 ELSE 0 END) AS auto_validated, sum(CASE WHEN light = 'red' THEN 1 ELSE 0 END) AS flagged, {AVG_C} AS avg_confidence, {AVG_M} AS avg_mismatch, round(median(confidence), 4) AS median_confidence, {AREA} AS total_area_hectares, count(DISTINCT district) AS districts_covered, count(DISTINCT village) AS villages_covered, sum(CASE WHEN sla_due_at < {NOW} AND {OPEN} THEN 1 ELSE 0 END) AS overdue_count, sum(CASE WHEN assigned_to IS NULL AND review_status = 'pending' THEN 1 ELSE 0 END) AS unassigned_count, sum(CASE WHEN correction_count > 0 THEN 1 ELSE 0 END) AS corrections_applied FROM l) SELECT total_parcels, CAST(auto_validated AS BIGINT) AS auto_validated, CAST(flagged AS BIGINT) AS flagged, avg_confidence, avg_mismatch, median_confidence, total_area_hectares, districts_covered, villages_covered, CAST(overdue_count AS BIGINT) AS overdue_count, CAST(unassigned_count AS BIGINT) AS unassigned_count, CAST(corrections_applied AS BIGINT) AS corrections_applied, CAST(greatest(total_parcels - auto_validated - flagged, 0) AS BIGINT) AS needs_review, round(auto_validated / total_parcels * 100, 1) AS straight_through_rate, round(auto_validated * CAST(22 AS DOUBLE) / 60, 1) AS staff_hours_saved FROM a")
def ag1(spark: SparkSession, d: str) -> DataFrame:
    return analytics.summary(parcels(spark, d), as_of())


def _domain(values) -> str:
    return "(VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(values)) + ") v(ord, value)"


@query("ag2_by_status", f"WITH {PARCELS} SELECT CAST(v.ord AS INT) AS ord, v.value AS review_status, count(p.id) AS n FROM {_domain(STATUSES)} LEFT JOIN parcels p ON p.review_status = v.value AND p.state = 'ASIA' AND p.priority = 'low' GROUP BY 1, 2")
def ag2(spark: SparkSession, d: str) -> DataFrame:
    return analytics.zero_filled(parcels(spark, d).filter("state = 'ASIA' AND priority = 'low'"), "review_status", STATUSES)


@query("ag2_by_priority", f"WITH {PARCELS} SELECT CAST(v.ord AS INT) AS ord, v.value AS priority, count(p.id) AS n FROM {_domain(PRIORITIES)} LEFT JOIN parcels p ON p.priority = v.value GROUP BY 1, 2")
def ag2b(spark: SparkSession, d: str) -> DataFrame:
    return analytics.zero_filled(parcels(spark, d), "priority", PRIORITIES)


@query("ag3_lights", f"WITH {PARCELS} SELECT {LIGHT} AS light, count(*) AS n FROM parcels GROUP BY 1")
def ag3(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).groupBy(reads.traffic_light().alias("light")).agg(F.count(F.lit(1)).alias("n"))


@query("ag4_median", f"WITH {PARCELS} SELECT state, round(median(confidence), 4) AS median_confidence FROM parcels GROUP BY state")
def ag4(spark: SparkSession, d: str) -> DataFrame:
    return analytics.medians(parcels(spark, d), "state", "confidence")


@query("ag5_district_rollup", f"WITH {PARCELS} SELECT state, district, count(*) AS total, CAST({FLAGGED} AS BIGINT) AS flagged, CAST(sum(CASE WHEN review_status = 'approved' THEN 1 ELSE 0 END) AS BIGINT) AS approved, CAST(sum(CASE WHEN review_status = 'pending' THEN 1 ELSE 0 END) AS BIGINT) AS pending, CAST(sum(CASE WHEN sla_due_at < {NOW} AND review_status NOT IN ('approved','rejected') THEN 1 ELSE 0 END) AS BIGINT) AS overdue, {AVG_C} AS avg_confidence, {AVG_M} AS avg_mismatch, {AREA} AS total_area_hectares, round(sum(CASE WHEN review_status = 'approved' THEN 1 ELSE 0 END) / count(*) * 100, 1) AS completion_rate FROM parcels GROUP BY state, district ORDER BY total DESC, state NULLS FIRST, district NULLS FIRST LIMIT 50")
def ag5(spark: SparkSession, d: str) -> DataFrame:
    return analytics.districts(parcels(spark, d), as_of())


@query("ag6_timeseries", f"WITH {EVENTS}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) SELECT strftime(day, '%Y-%m-%d') AS day, count(e.id) AS ingested, count(CASE WHEN e.action = 'status_changed' THEN 1 END) AS decided, count(CASE WHEN e.action = 'corrected' THEN 1 END) AS corrections FROM days LEFT JOIN review_events e ON CAST(e.created_at AS DATE) = day AND e.created_at >= {ENOW} - INTERVAL 29 DAY GROUP BY 1")
def ag6(spark: SparkSession, d: str) -> DataFrame:
    e = review_events(spark, d).filter(F.col("created_at") >= as_of(EVENTS_AS_OF) - F.expr("INTERVAL 29 DAYS"))
    out = analytics.daily(analytics.calendar(spark, "2024-01-31", 30), ingested=(e, "created_at"), decided=(e.filter("action = 'status_changed'"), "created_at"), corrections=(e.filter("action = 'corrected'"), "created_at"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


ISSUES = "issues AS (SELECT concat('RULE_', k % 17) AS rule_code, CASE k % 4 WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS severity FROM review_events WHERE k IS NOT NULL)"


@query("ag7_rule_frequency", f"WITH {EVENTS}, {ISSUES} SELECT rule_code, count(*) AS n, CASE max(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE 3 END) WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' ELSE 'critical' END AS worst_severity, count(CASE WHEN severity = 'info' THEN 1 END) AS n_info, count(CASE WHEN severity = 'warning' THEN 1 END) AS n_warning, count(CASE WHEN severity = 'error' THEN 1 END) AS n_error, count(CASE WHEN severity = 'critical' THEN 1 END) AS n_critical FROM issues GROUP BY 1 ORDER BY n DESC, rule_code LIMIT 12")
def ag7(spark: SparkSession, d: str) -> DataFrame:
    e = review_events(spark, d).filter("k is not null")
    names = F.array(*(F.lit(s) for s in ("info", "warning", "error", "critical")))
    return analytics.rule_frequency(e.select(F.concat(F.lit("RULE_"), (F.col("k") % 17).cast("string")).alias("rule_code"), F.get(names, F.col("k") % 4).alias("severity")))


@query("ag8_throughput", f"WITH {EVENTS} SELECT reviewer, reviewer_role, count(*) AS events, CAST(sum(CASE WHEN action = 'corrected' THEN 1 ELSE 0 END) AS BIGINT) AS corrections, CAST(sum(CASE WHEN action = 'status_changed' THEN 1 ELSE 0 END) AS BIGINT) AS decisions, strftime(max(created_at), {T}) AS last_active FROM review_events WHERE created_at >= {ENOW} - INTERVAL 14 DAY GROUP BY 1, 2")
def ag8(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.throughput(review_events(spark, d), as_of(EVENTS_AS_OF) - F.expr("INTERVAL 14 DAYS"))
    return out.withColumn("last_active", time_text("last_active"))


@query("ag9_queue_health", f"WITH {PARCELS}, o AS (SELECT * FROM parcels WHERE {OPEN}), b AS (SELECT CAST(3 - v.ord AS INT) AS rank, v.value AS priority, count(o.id) AS open, CAST(sum(CASE WHEN o.sla_due_at < {NOW} THEN 1 ELSE 0 END) AS BIGINT) AS overdue FROM {_domain(PRIORITIES)} LEFT JOIN o ON o.priority = v.value GROUP BY 1, 2) SELECT rank, priority, open, overdue, CAST((SELECT sum(open) FROM b) AS BIGINT) AS total_open, CAST((SELECT sum(overdue) FROM b) AS BIGINT) AS total_overdue, (SELECT strftime(min(created_at), {T}) FROM o) AS oldest_open_at FROM b")
def ag9(spark: SparkSession, d: str) -> DataFrame:
    return analytics.queue_health(parcels(spark, d), as_of()).withColumn("oldest_open_at", time_text("oldest_open_at"))


@query("ag10_facets", f"WITH {PARCELS} SELECT coalesce(state, 'Unknown') AS state, coalesce(district, 'Unknown') AS district, coalesce(village, 'Unknown') AS village, count(*) AS n FROM parcels GROUP BY 1, 2, 3")
def ag10(spark: SparkSession, d: str) -> DataFrame:
    return reads.facets(parcels(spark, d))


@query("ag11_page_total", f"WITH {PARCELS} SELECT count(*) AS total FROM parcels WHERE {OPEN} AND mismatch >= 10")
def ag11(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return reads.total(p.filter(reads.parcel_filter(p.columns, open_only=True, min_mismatch=10)))


@query("ag13_reference_number", "SELECT o_orderpriority AS prefix, printf('CASE/2001/%04d', count(*) + 1) AS reference FROM orders GROUP BY 1")
def ag13(spark: SparkSession, d: str) -> DataFrame:
    return analytics.reference_numbers(spark.read.parquet(f"{d}/orders.parquet"), "o_orderpriority")


@query("ag14_integrity", f"WITH {EVENTS}, {ISSUES} SELECT rule_code, count(*) AS n, round(greatest(0.0, 1.0 - sum(CASE severity WHEN 'info' THEN CAST(0 AS DECIMAL(6,2)) WHEN 'warning' THEN CAST(0.04 AS DECIMAL(6,2)) WHEN 'error' THEN CAST(0.15 AS DECIMAL(6,2)) ELSE CAST(0.40 AS DECIMAL(6,2)) END) / 100), 4) AS integrity FROM issues GROUP BY 1".replace("round(greatest(0.0, 1.0 - sum(", "CAST(greatest(0, 1 - CAST(sum(").replace("END) / 100), 4) AS", "END) AS DOUBLE) / 100) AS DOUBLE) AS"))
def ag14(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.findings import SEVERITY_PENALTY

    e = review_events(spark, d).filter("k is not null")
    names = F.array(*(F.lit(s) for s in ("info", "warning", "error", "critical")))
    rows = e.select(F.concat(F.lit("RULE_"), (F.col("k") % 17).cast("string")).alias("rule_code"), F.get(names, F.col("k") % 4).alias("severity"))
    weight = None
    for s, w in SEVERITY_PENALTY.items():
        weight = F.when(F.col("severity") == s, F.lit(w)) if weight is None else weight.when(F.col("severity") == s, F.lit(w))
    return rows.groupBy("rule_code").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.lit(0.0), 1.0 - F.sum(weight.cast("decimal(6,2)")).cast("double") / 100).alias("integrity"))


@query("ag15_area_sums", f"WITH {SUBS} SELECT parcel_id, CAST(sum(area) AS DOUBLE) AS total, CAST(coalesce(sum(CASE WHEN kind = 'sale' THEN area END), 0) AS DOUBLE) AS cultivable, CAST(coalesce(sum(CASE WHEN kind <> 'sale' THEN area END), 0) AS DOUBLE) AS other FROM sub_divisions GROUP BY 1")
def ag15(spark: SparkSession, d: str) -> DataFrame:
    return analytics.area_sums(sub_divisions(spark, d), "parcel_id", "area", F.col("kind") == "sale")


@query("ag16_rate_outliers", f"WITH {SUBS}, w AS (SELECT *, avg(rate) OVER g AS m, stddev_pop(rate) OVER g AS s, count(*) OVER g AS c FROM sub_divisions WINDOW g AS (PARTITION BY parcel_id)) SELECT parcel_id, number, part, supplier, c AS siblings, round((rate - m) / s, 3) AS z FROM w WHERE c >= 3 AND s > 1e-9 * abs(m) AND abs((rate - m) / s) >= 2")
def ag16(spark: SparkSession, d: str) -> DataFrame:
    out = analytics.outliers(sub_divisions(spark, d), "parcel_id", "rate", 2.0)
    return out.select("parcel_id", "number", "part", "supplier", "siblings", F.round("z", 3).alias("z"))


@query("ag17_weighted_mean", "SELECT event_type, round(sum(CAST(value AS DECIMAL(12,2)) * greatest(1, user_id)) / CAST(sum(greatest(1, user_id)) AS DOUBLE), 6) AS mean FROM events GROUP BY 1".replace("round(sum(CAST(value AS DECIMAL(12,2)) * greatest(1, user_id)) /", "round(CAST(sum(CAST(value AS DECIMAL(12,2)) * greatest(1, user_id)) AS DOUBLE) /"))
def ag17(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("exact", F.col("value").cast("decimal(12,2)"))
    w = F.greatest(F.lit(1), F.col("user_id"))
    return e.groupBy("event_type").agg(F.round(analytics.weighted_mean("exact", w), 6).alias("mean"))


@query("ag18_document_means", f"WITH {PARCELS} SELECT document_id, CAST(sum(CAST(confidence AS DECIMAL(10,3))) AS DOUBLE) / CAST(count(confidence) AS DOUBLE) AS confidence, CAST(sum(area) AS DOUBLE) AS area FROM parcels GROUP BY 1")
def ag18(spark: SparkSession, d: str) -> DataFrame:
    return analytics.document_means(parcels(spark, d))


@query("ag19_token_usage", "SELECT role, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END) AS BIGINT) AS cached, round(sum(CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END) / sum(length(text)), 6) AS hit_ratio FROM conversations GROUP BY role")
def ag19(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/conversations.parquet").select("role", F.length("text").alias("used"), F.when(F.col("turn") % 2 == 0, F.length("text")).otherwise(0).alias("cached"))
    return analytics.token_usage(rows, "role")


@query("ag21_map_bounds", f"WITH {PARCELS} SELECT state, min(id % 360 - 180) AS west, max(id % 360 - 180) AS east, min(id % 180 - 90) AS south, max(id % 180 - 90) AS north FROM parcels WHERE has_geometry GROUP BY 1")
def ag21(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d).filter("has_geometry").select("state", F.array(F.struct((F.col("id") % 360 - 180).alias("lon"), (F.col("id") % 180 - 90).alias("lat"))).alias("ring"))
    return analytics.map_bounds(p, "state")


# Sorts, pages, windows


@query("rd1_list", f"WITH {PARCELS} SELECT {S} FROM parcels WHERE {OPEN} ORDER BY mismatch DESC NULLS LAST, id LIMIT 50 OFFSET 100")
def rd1(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    return reads.page(p.filter(reads.parcel_filter(p.columns, open_only=True)), "mismatch", limit=50, offset=100).select(*SUMMARY)


@query("rd1_list_ascending", f"WITH {PARCELS} SELECT {S} FROM parcels ORDER BY confidence ASC NULLS FIRST, id LIMIT 75")
def rd1b(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(parcels(spark, d), "confidence", descending=False, limit=75).select(*SUMMARY)


SEV = "CASE severity WHEN 'critical' THEN CAST(1.0 AS DOUBLE) WHEN 'error' THEN CAST(0.7 AS DOUBLE) WHEN 'warning' THEN CAST(0.35 AS DOUBLE) WHEN 'info' THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
ACT = "CASE action WHEN 'reject_re_scan' THEN CAST(1.0 AS DOUBLE) WHEN 'field_verification' THEN CAST(0.8 AS DOUBLE) WHEN 'review_queue' THEN CAST(0.5 AS DOUBLE) WHEN 'auto_approve' THEN CAST(0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END"
SCORE = f"round(CASE WHEN mismatch IS NULL THEN CAST(0 AS DOUBLE) ELSE least(mismatch, CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) * CAST(34 AS DOUBLE) END + {SEV} * CAST(30 AS DOUBLE) + (CAST(1 AS DOUBLE) - CASE WHEN confidence IS NULL THEN CAST(0.5 AS DOUBLE) ELSE greatest(CAST(0 AS DOUBLE), least(confidence, CAST(1 AS DOUBLE))) END) * CAST(22 AS DOUBLE) + least(issue_count, 5) / CAST(5 AS DOUBLE) * CAST(8 AS DOUBLE) + {ACT} * CAST(6 AS DOUBLE), 2)"
BAND = "CASE WHEN score >= 55 THEN 'critical' WHEN score >= 30 THEN 'high' WHEN score >= 12 THEN 'normal' ELSE 'low' END"


@query("rd2_queue", f"WITH {PARCELS}, s AS (SELECT *, {SCORE} AS score FROM parcels) SELECT id, district, score, strftime(sla_due_at, {T}) AS due FROM s WHERE {OPEN} AND assigned_to = 'officer5' ORDER BY score DESC, sla_due_at, id LIMIT 50")
def rd2(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d).withColumn("score", triage.score())
    return reads.queue(p, "score", scope="mine", user="officer5").select("id", "district", "score", time_text("sla_due_at").alias("due"))


@query("rd3_audit_order", f"WITH {EVENTS} SELECT id, reviewer, action FROM review_events ORDER BY created_at DESC, id LIMIT 200")
def rd3(spark: SparkSession, d: str) -> DataFrame:
    return reads.newest_first(review_events(spark, d)).select("id", "reviewer", "action")


@query("rd4_event_trail", f"WITH {EVENTS} SELECT id, parcel_id, row_number() OVER (PARTITION BY parcel_id ORDER BY created_at, id) AS step FROM review_events")
def rd4(spark: SparkSession, d: str) -> DataFrame:
    return reads.numbered(review_events(spark, d), "parcel_id", ("created_at", "id"), "step").select("id", "parcel_id", "step")


@query("rd7_geojson_counts", f"WITH {PARCELS}, m AS (SELECT * FROM parcels WHERE state = 'AMERICA') SELECT count(*) AS total_matching, least(count(CASE WHEN has_geometry THEN 1 END), 200) AS returned, count(*) - least(count(CASE WHEN has_geometry THEN 1 END), 200) AS without_geometry FROM m")
def rd7(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.exports import geojson_counts

    return geojson_counts(parcels(spark, d).filter("state = 'AMERICA'"), 200)


@query("rd10_out_of_sequence", f"WITH {SUBS}, o AS (SELECT *, lag(entry_date) OVER (PARTITION BY parcel_id ORDER BY number, part, supplier, entry_date) AS before FROM sub_divisions) SELECT parcel_id, number, part, supplier, strftime(entry_date, '%Y-%m-%d') AS entry_date, strftime(before, '%Y-%m-%d') AS previous FROM o WHERE entry_date < before")
def rd10(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.findings import out_of_sequence

    out = out_of_sequence(sub_divisions(spark, d).filter("entry_date is not null"), "parcel_id", ("number", "part", "supplier", "entry_date"), "entry_date")
    return out.select("parcel_id", "number", "part", "supplier", F.date_format("entry_date", "yyyy-MM-dd").alias("entry_date"), F.date_format("previous", "yyyy-MM-dd").alias("previous"))


@query("rd11_duplicate_serials", f"WITH {SUBS}, o AS (SELECT *, row_number() OVER (PARTITION BY parcel_id, number ORDER BY part, supplier, entry_date) AS nth FROM sub_divisions) SELECT parcel_id, number, part, supplier, nth FROM o WHERE nth > 1")
def rd11(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.findings import repeats

    return repeats(sub_divisions(spark, d), ("parcel_id", "number"), ("part", "supplier", "entry_date")).select("parcel_id", "number", "part", "supplier", F.col("nth").cast("long").alias("nth"))


@query("rd12_duplicate_khasra", f"WITH {SUBS} SELECT parcel_id, part, count(*) - 1 AS extra FROM sub_divisions GROUP BY 1, 2 HAVING count(*) > 1")
def rd12(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.findings import repeats

    out = repeats(sub_divisions(spark, d), ("parcel_id", "part"), ("number", "supplier", "entry_date"))
    return out.groupBy("parcel_id", "part").agg(F.count(F.lit(1)).alias("extra"))


@query("rd13_snapshot_pairs", "WITH o AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations) SELECT conv_id, turn, role, next_role FROM o WHERE next_role IS NOT NULL")
def rd13(spark: SparkSession, d: str) -> DataFrame:
    return reads.followed(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "role", "next_role").select("conv_id", "turn", "role", "next_role")


@query("rd14_issue_order", f"WITH {EVENTS}, r AS (SELECT id, parcel_id, CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS rank, value FROM review_events) SELECT id, parcel_id, row_number() OVER (PARTITION BY parcel_id ORDER BY rank DESC, value DESC, id) AS place FROM r")
def rd14(spark: SparkSession, d: str) -> DataFrame:
    worst = F.coalesce(F.col("k") % 4, F.lit(3)).desc()
    return reads.numbered(review_events(spark, d), "parcel_id", (worst, F.col("value").desc_nulls_first(), "id")).select("parcel_id", "id", "place")


@query("rd16_snapshot_order", f"WITH {SUBS} SELECT parcel_id, number, part, supplier, row_number() OVER (PARTITION BY parcel_id ORDER BY CASE WHEN kind = 'succession' THEN 0 ELSE 1 END, entry_date NULLS LAST, number, part, supplier) AS place FROM sub_divisions")
def rd16(spark: SparkSession, d: str) -> DataFrame:
    order = (F.when(F.col("kind") == "succession", 0).otherwise(1), F.col("entry_date").asc_nulls_last(), "number", "part", "supplier")
    return reads.numbered(sub_divisions(spark, d), "parcel_id", order).select("parcel_id", "number", "part", "supplier", "place")


@query("rd17_timeline_sequence", f"WITH {EVENTS} SELECT id, row_number() OVER (PARTITION BY parcel_id ORDER BY created_at, id) - 1 AS sequence FROM review_events")
def rd17(spark: SparkSession, d: str) -> DataFrame:
    return reads.numbered(review_events(spark, d), "parcel_id", ("created_at", "id"), "sequence", first=0).select("id", "sequence")


@query("rd18_latest_mutation", f"WITH {SUBS} SELECT parcel_id, strftime(max(entry_date), '%Y-%m-%d') AS latest, arg_max(part * 1000 + supplier, (entry_date, -number, -part, -supplier)) AS winner FROM sub_divisions GROUP BY 1")
def rd18(spark: SparkSession, d: str) -> DataFrame:
    out = reads.latest(sub_divisions(spark, d), "parcel_id", "entry_date", F.col("part") * 1000 + F.col("supplier"), (-F.col(c) for c in ("number", "part", "supplier")))
    return out.withColumn("latest", F.date_format("latest", "yyyy-MM-dd"))


@query("rd22_set_operations", f"WITH {SUBS}, a AS (SELECT DISTINCT parcel_id, part % 20 AS x FROM sub_divisions WHERE kind = 'sale'), b AS (SELECT DISTINCT parcel_id, part % 20 AS x FROM sub_divisions WHERE kind <> 'sale'), k AS (SELECT DISTINCT parcel_id FROM sub_divisions) SELECT k.parcel_id, (SELECT count(*) FROM (SELECT x FROM a WHERE a.parcel_id = k.parcel_id UNION SELECT x FROM b WHERE b.parcel_id = k.parcel_id)) AS n_union, (SELECT count(*) FROM a JOIN b USING (parcel_id, x) WHERE a.parcel_id = k.parcel_id) AS n_shared, (SELECT count(*) FROM a WHERE a.parcel_id = k.parcel_id AND x NOT IN (SELECT x FROM b WHERE b.parcel_id = k.parcel_id)) AS n_only FROM k")
def rd22(spark: SparkSession, d: str) -> DataFrame:
    return analytics.set_counts(sub_divisions(spark, d), "parcel_id", F.col("part") % 20, F.col("kind") == "sale")


# Triage and workflow


@query("tr1_priority_score", f"WITH {PARCELS} SELECT id, {SCORE} AS score FROM parcels")
def tr1(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).select("id", triage.score().alias("score"))


@query("tr2_bands", f"WITH {PARCELS}, s AS (SELECT {SCORE} AS score FROM parcels) SELECT {BAND} AS band, count(*) AS n FROM s GROUP BY 1")
def tr2(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).groupBy(triage.band(triage.score()).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("tr3_sla_due", f"WITH {PARCELS}, s AS (SELECT id, created_at, {SCORE} AS score FROM parcels), b AS (SELECT *, {BAND} AS band FROM s) SELECT id, band, strftime(created_at + to_hours(CASE band WHEN 'critical' THEN 24 WHEN 'high' THEN 72 WHEN 'normal' THEN 168 ELSE 336 END), {T}) AS due FROM b")
def tr3(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d).withColumn("band", triage.band(triage.score()))
    return p.select("id", "band", time_text(triage.sla_due(F.col("band"), F.col("created_at"))).alias("due"))


REQUESTS = "requests AS (SELECT event_id, event_id % 15100 AS parcel_id, CASE CAST(json_extract(props, '$.k') AS INT) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_review' WHEN 2 THEN 'approved' WHEN 3 THEN 'rejected' ELSE 'escalated' END AS target, CASE user_id % 3 WHEN 0 THEN 'operator' WHEN 1 THEN 'reviewer' ELSE 'admin' END AS role FROM events)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    k, u = F.get_json_object("props", "$.k").cast("int"), F.col("user_id") % 3
    return e.select("event_id", (F.col("event_id") % 15100).alias("parcel_id"), F.get(F.array(*(F.lit(s) for s in STATUSES)), k % 5).alias("target"), F.get(F.array(F.lit("operator"), F.lit("reviewer"), F.lit("admin")), u.cast("int")).alias("role"), F.lit("me").alias("actor"))


LEGAL = "((was = 'pending' AND target IN ('in_review','approved','rejected','escalated')) OR (was = 'in_review' AND target IN ('pending','approved','rejected','escalated')) OR (was = 'escalated' AND target IN ('in_review','approved','rejected')) OR (was IN ('approved','rejected') AND target = 'in_review'))"
REASON = f"CASE WHEN id IS NULL THEN 'not found' WHEN was = target THEN 'already there' WHEN NOT {LEGAL} THEN 'not allowed' WHEN was IN ('approved','rejected') AND role NOT IN ('reviewer','admin') THEN 'needs a reviewer' END"


@query("wf1_transition_matrix", "SELECT * FROM (VALUES " + ", ".join(f"('{a}','{b}')" for a, b in [(x, y) for x, ys in __import__("parcelforge.enums", fromlist=["TRANSITIONS"]).TRANSITIONS.items() for y in ys]) + ") v(from_status, to_status)")
def wf1(spark: SparkSession, d: str) -> DataFrame:
    return workflow.allowed_pairs(spark)


@query("wf3_bulk_transition", f"WITH {PARCELS}, {REQUESTS}, j AS (SELECT r.*, p.id, p.review_status AS was, p.assigned_to FROM requests r LEFT JOIN parcels p ON r.parcel_id = p.id), o AS (SELECT *, {REASON} AS reason FROM j) SELECT parcel_id, was, target, reason, CASE WHEN reason IS NULL THEN target ELSE was END AS review_status, CASE WHEN reason IS NULL AND target = 'in_review' THEN coalesce(assigned_to, 'me') ELSE assigned_to END AS assigned_to, CASE WHEN reason IS NULL AND target IN ('approved','rejected') THEN 'me' END AS decided_by FROM o")
def wf3(spark: SparkSession, d: str) -> DataFrame:
    return workflow.transition(_requests(spark, d), parcels(spark, d), as_of()).select("parcel_id", "was", "target", "reason", "review_status", "assigned_to", "decided_by")


@query("wf2_decisions", f"WITH {PARCELS}, {REQUESTS}, j AS (SELECT r.*, p.id, p.review_status AS was, p.decided_at FROM requests r LEFT JOIN parcels p ON r.parcel_id = p.id), o AS (SELECT *, {REASON} AS reason FROM j) SELECT parcel_id, target, CASE WHEN reason IS NULL AND target IN ('approved','rejected') THEN '{AS_OF}' WHEN reason IS NULL AND target = 'in_review' THEN NULL ELSE strftime(decided_at, {T}) END AS decided_at FROM o")
def wf2(spark: SparkSession, d: str) -> DataFrame:
    return workflow.transition(_requests(spark, d), parcels(spark, d), as_of()).select("parcel_id", "target", time_text("decided_at").alias("decided_at"))


@query("wf4_assign", f"WITH {PARCELS} SELECT id, CASE WHEN id % 2 = 0 THEN 'kim' END AS assigned_to, CASE WHEN id % 2 = 0 AND review_status = 'pending' THEN 'in_review' ELSE review_status END AS review_status FROM parcels WHERE id % 5 = 0")
def wf4(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    wanted = spark.read.parquet(f"{d}/orders.parquet").filter("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("parcel_id"), F.when(F.col("o_orderkey") % 2 == 0, "kim").alias("assignee"))
    return workflow.assign(wanted, p)


@query("wf5_latest_corrections", f"WITH {EVENTS} SELECT parcel_id, concat('$.f', k % 3) AS field_path, arg_max(k, (created_at, id)) AS value, count(*) AS corrections FROM review_events WHERE action = 'corrected' GROUP BY 1, 2")
def wf5(spark: SparkSession, d: str) -> DataFrame:
    e = review_events(spark, d).filter("action = 'corrected'")
    return workflow.latest_corrections(e.select("id", "parcel_id", "created_at", F.concat(F.lit("$.f"), (F.col("k") % 3).cast("string")).alias("field_path"), F.col("k").alias("value")))


@query("wf5_corrections_applied", f"WITH {PARCELS}, {EVENTS}, c AS (SELECT parcel_id, CASE k % 3 WHEN 0 THEN 'area' WHEN 1 THEN 'village' ELSE 'other' END AS field, k, created_at, id FROM review_events WHERE action = 'corrected'), l AS (SELECT parcel_id, field, arg_max(k, (created_at, id)) AS k, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT parcel_id, sum(n) AS n, max(CASE WHEN field = 'area' THEN k END) AS area, max(CASE WHEN field = 'village' THEN k END) AS village FROM l GROUP BY 1), j AS (SELECT parcels.id, parcels.issue_count, correction_count + coalesce(n, 0) AS correction_count, n IS NOT NULL AS touched, CASE WHEN p.area IS NOT NULL THEN CASE WHEN p.area % 2 = 0 THEN CAST(p.area - 20 AS DECIMAL(18,4)) END ELSE parcels.area END AS area, coalesce('village ' || CAST(p.village AS VARCHAR), parcels.village) AS village FROM parcels LEFT JOIN p ON p.parcel_id = parcels.id) SELECT id, CAST(area AS DOUBLE) AS area, village, CAST(correction_count AS INT) AS correction_count, CASE WHEN touched THEN CASE WHEN area IS NULL OR area <= 0 THEN 1 ELSE 0 END ELSE issue_count END AS issue_count FROM j")
def wf5b(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    path = F.when(k % 3 == 0, "$.area").when(k % 3 == 1, "$.village").otherwise("$.other")
    value = F.when(k % 3 == 1, F.concat(F.lit("village "), k.cast("string"))).when((k % 3 == 0) & (k % 2 == 1), "unreadable").otherwise((k - 20).cast("string"))
    e = review_events(spark, d).filter("action = 'corrected'").select("id", "parcel_id", "created_at", path.alias("field_path"), value.alias("value"))
    found = F.when(F.col("area").isNull() | (F.col("area") <= 0), 1).otherwise(0)  # the two area rules
    out = workflow.corrected(parcels(spark, d).select("id", "area", "village", "correction_count", "issue_count"), e, {"$.area": "area", "$.village": "village"}, found)
    return out.select("id", F.col("area").cast("double").alias("area"), "village", "correction_count", "issue_count")


@query("wf6_refresh", f"WITH {PARCELS}, s AS (SELECT id, created_at, issue_count, severity, {SCORE} AS score FROM parcels), b AS (SELECT *, {BAND} AS band FROM s) SELECT id, issue_count, severity, score, band, strftime(created_at + to_hours(CASE band WHEN 'critical' THEN 24 WHEN 'high' THEN 72 WHEN 'normal' THEN 168 ELSE 336 END), {T}) AS due FROM b")
def wf6(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d).withColumn("score", triage.score()).withColumn("band", triage.band(F.col("score")))
    return p.select("id", "issue_count", "severity", "score", "band", time_text(triage.sla_due(F.col("band"), F.col("created_at"))).alias("due"))


@query("wf8_audit_rows", f"WITH {PARCELS}, {REQUESTS}, j AS (SELECT r.*, p.id, p.review_status AS was FROM requests r LEFT JOIN parcels p ON r.parcel_id = p.id), o AS (SELECT *, {REASON} AS reason FROM j) SELECT parcel_id, '$.review_status' AS field_path, concat('{{\"value\":\"', was, '\"}}') AS previous_value, concat('{{\"value\":\"', target, '\"}}') AS new_value, 'status_changed' AS action FROM o WHERE reason IS NULL")
def wf8(spark: SparkSession, d: str) -> DataFrame:
    out = workflow.audit_rows(workflow.transition(_requests(spark, d), parcels(spark, d), as_of()), "status_changed", as_of())
    return out.select("parcel_id", "field_path", "previous_value", "new_value", "action")


@query("wf9_role_gate", "SELECT event_id, CASE user_id % 3 WHEN 0 THEN false ELSE true END AS allowed FROM events")
def wf9(spark: SparkSession, d: str) -> DataFrame:
    return _requests(spark, d).select("event_id", workflow.outranks(F.col("role"), "reviewer").alias("allowed"))


@query("wf10_backfill", f"WITH {PARCELS}, s AS (SELECT *, {SCORE} AS score FROM parcels WHERE review_status = 'pending' AND correction_count = 0) SELECT id, score, {BAND} AS band FROM s")
def wf10(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d).filter("review_status = 'pending' AND correction_count = 0").withColumn("score", triage.score())
    return p.select("id", "score", triage.band(F.col("score")).alias("band"))


@query("wf11_delete_cascade", f"WITH {PARCELS}, {EVENTS}, dead AS (SELECT id FROM parcels WHERE document_id % 10 = 0) SELECT 'parcels' AS name, count(*) AS n FROM parcels WHERE document_id % 10 <> 0 UNION ALL SELECT 'events', count(*) FROM review_events WHERE parcel_id NOT IN (SELECT id FROM dead) UNION ALL SELECT 'documents', count(*) FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT 'cases', count(CASE WHEN l_orderkey NOT IN (SELECT id FROM dead) THEN 1 END) FROM lineitem WHERE l_orderkey IN (SELECT id FROM parcels)")
def wf11(spark: SparkSession, d: str) -> DataFrame:
    p, e = parcels(spark, d), review_events(spark, d)
    docs = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"))
    cases = spark.read.parquet(f"{d}/lineitem.parquet").join(p.select(F.col("id").alias("pid")), F.col("l_orderkey") == F.col("pid"), "left_semi").select(F.col("l_orderkey").alias("parcel_id"))
    a, b, c, x = workflow.delete_cascade(docs, p, e, cases, docs.filter("id % 10 = 0"))
    named = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    return named("parcels", b).unionByName(named("events", c)).unionByName(named("documents", a)).unionByName(named("cases", x.filter("parcel_id is not null")))
