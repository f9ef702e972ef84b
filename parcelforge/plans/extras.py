"""What remains of the inventory: display, case lists, projections, catalogues."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, names, numerals
from ..operators import reads, rules, triage
from ..session import shared_folder
from ..sources import database, exports, files
from .engine import records, shaped
from .office import BAND, SCORE
from .registry import Registry
from .views import AS_OF, EVENTS, PARCELS, SUBS, as_of, parcels, review_events, sub_divisions, table

query = Registry()


@query("sc4_numeric_text", "SELECT event_id, concat('1,', user_id, '  ', user_id) AS raw, concat('1', user_id, ' ', user_id) AS out FROM events")
def sc4(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.lit("1,"), F.col("user_id").cast("string"), F.lit("  "), F.col("user_id").cast("string")).alias("raw"))
    return t.select("event_id", "raw", numerals.numeric_text(F.col("raw")).alias("out"))


@query("sc8_unit_words", "SELECT o_orderkey, round(CAST(o_custkey * CASE o_orderkey % 5 WHEN 2 THEN 0.09290304 WHEN 3 THEN 100 WHEN 4 THEN 0.83612736 ELSE 1 END AS DOUBLE), 1) AS area FROM orders")
def sc8(spark: SparkSession, d: str) -> DataFrame:
    from ..functions import areas

    word = F.get(F.array(*(F.lit(w) for w in (" Sq. Mtrs", " चौ.मी.", " sq. ft", " आर", " Sq.Yds"))), (F.col("o_orderkey") % 5).cast("int"))
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", areas.parse(F.concat(F.col("o_custkey").cast("string"), word)).alias("parsed"))
    return t.select("o_orderkey", F.round(areas.unrounded(F.col("parsed")).cast("double"), 1).alias("area"))


@query("sc29_token_similarity", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(0.92 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM part")
def sc29(spark: SparkSession, d: str) -> DataFrame:
    """Words in another order, an initial for the second word, and nothing."""
    a, b, k = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 3
    other = F.when(k == 0, F.concat(b, F.lit(" "), a)).when(k == 1, F.concat(a, F.lit(" "), F.left(b, F.lit(1)))).otherwise("")
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.concat(a, F.lit(" "), b).alias("a"), other.alias("b"))
    return t.select("p_partkey", names.folded_similarity("a", "b").alias("score"))


@query("sc37_display_key", "SELECT o_orderkey, concat('Khasra ', o_orderkey, ' · ', o_orderpriority) AS key FROM orders")
def sc37(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", display.display_key(none, F.col("o_orderkey").cast("string"), none, F.col("o_orderpriority"), F.lit("")).alias("key"))


@query("sc44_rule_groups", "SELECT * FROM (VALUES ('AREA_SUM_MISMATCH', 'Arithmetic consistency'), ('DUPLICATE_OWNER_SERIAL', 'Ownership'), ('DUPLICATE_KHASRA_NUMBER', 'Identifiers'), ('MUTATION_DATE_IN_FUTURE', 'Mutation chain'), ('SUCCESSION_PARCEL_MISMATCH', 'Ownership succession'), ('XYZ', 'Other')) t(code, family)")
def sc44(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(c,) for c in ("AREA_SUM_MISMATCH", "DUPLICATE_OWNER_SERIAL", "DUPLICATE_KHASRA_NUMBER", "MUTATION_DATE_IN_FUTURE", "SUCCESSION_PARCEL_MISMATCH", "XYZ")], "code string")
    return t.select("code", display.rule_group(F.col("code")).alias("family"))


@query("sc45_formatters", "WITH t AS (SELECT p_partkey, CAST(100000 + p_partkey % 900000 AS VARCHAR) AS n, p_partkey % 100 AS c, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part) SELECT p_partkey, concat(left(n, 1), ',', substr(n, 2, 2), ',', right(n, 3)) AS count, concat(c, '%') AS percent, upper(concat(left(a, 1), left(b, 1))) AS initials FROM t")
def sc45(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", display.indian_count(100000 + k % 900000).alias("count"), display.percent((k % 100) / F.lit(100.0)).alias("percent"), display.initials(F.replace("p_name", F.lit(" "), F.lit("  "))).alias("initials"))


@query("sc46_map_colours", f"WITH {PARCELS} SELECT CASE WHEN mismatch IS NULL THEN 'muted' WHEN mismatch < 5 THEN 'good' WHEN mismatch < 50 THEN 'warning' ELSE 'critical' END AS colour, count(*) AS n FROM parcels GROUP BY 1")
def sc46(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).groupBy(display.map_colour(F.col("mismatch")).alias("colour")).agg(F.count(F.lit(1)).alias("n"))


@query("sc47_axis_steps", "SELECT l_quantity AS v, CASE WHEN l_quantity <= 1 THEN CAST(1 AS DOUBLE) WHEN l_quantity <= 2 THEN CAST(2 AS DOUBLE) WHEN l_quantity <= 5 THEN CAST(5 AS DOUBLE) WHEN l_quantity <= 10 THEN CAST(10 AS DOUBLE) WHEN l_quantity <= 20 THEN CAST(20 AS DOUBLE) ELSE CAST(50 AS DOUBLE) END AS step, count(*) AS n FROM lineitem GROUP BY 1, 2")
def sc47(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_quantity").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("v", display.nice_step(F.col("v").cast("double")).alias("step"), "n")


@query("rd19_top_reasons", f"WITH {PARCELS} SELECT id, CAST(least(3, greatest(1, CASE WHEN mismatch >= 15 THEN 1 ELSE 0 END + CASE WHEN severity IN ('critical','error') THEN 1 ELSE 0 END + CASE WHEN coalesce(confidence, CAST(0.5 AS DOUBLE)) < CAST(0.6 AS DOUBLE) THEN 1 ELSE 0 END + CASE WHEN issue_count >= 3 THEN 1 ELSE 0 END + CASE WHEN action IN ('reject_re_scan','field_verification') THEN 1 ELSE 0 END)) AS INT) AS n FROM parcels")
def rd19(spark: SparkSession, d: str) -> DataFrame:
    return parcels(spark, d).select("id", F.size(triage.reasons()).alias("n"))


@query("rd21_distinct_in_order", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2) GROUP BY 1")
def rd21(spark: SparkSession, d: str) -> DataFrame:
    t = reads.in_order(spark.read.parquet(f"{d}/conversations.parquet"), "conv_id", "turn", "role")
    return t.select("conv_id", F.array_join("distinct", ",").alias("roles"))


@query("jn8_orphan_serials", f"WITH {SUBS} SELECT parcel_id, number FROM sub_divisions WHERE number NOT IN (1, 2, 3)")
def jn8(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(1,), (2,), (3,)], "serial int")
    return reads.without(sub_divisions(spark, d), known, {"number": "serial"}).select("parcel_id", "number")


@query("ag22_rule_page", "SELECT family, count(*) AS n FROM (VALUES " + ", ".join(f"('{c}')" for c in rules.REGISTRY) + ") t(code), LATERAL (SELECT CASE " + " ".join(f"WHEN starts_with(code, '{p}') THEN '{g}'" for p, g in display.RULE_GROUPS) + " ELSE 'Other' END AS family) GROUP BY 1")
def ag22(spark: SparkSession, d: str) -> DataFrame:
    return rules.catalogue(spark).groupBy(display.rule_group(F.col("rule_code")).alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("io1_table_scan", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders WHERE o_totalprice > 100000")
def io1(spark: SparkSession, d: str) -> DataFrame:
    return files.scan(spark, f"{d}/orders.parquet", ("o_custkey",), F.col("o_totalprice") > 100000).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("io1_database_scan", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 2 = 1")
def io1b(spark: SparkSession, d: str) -> DataFrame:
    """Orders stored in database files and scanned there; the remainder of the keys is Spark's part of the condition."""
    at = f"{shared_folder(spark)}/database-{uuid.uuid4().hex}"
    database.store_table(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice")), at, "orders")
    wanted = (F.col("o_totalprice") > 100000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_custkey") % 2 == 1)
    return database.scan(spark, at, "orders", "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double", wanted)[0].drop("o_totalprice")


@query("io4_geojson", "SELECT CASE WHEN o_orderkey % 10 <> 9 THEN CAST(o_orderkey AS VARCHAR) END AS parcel_key, CASE WHEN o_orderkey % 9 <> 8 THEN CASE o_orderkey % 4 WHEN 0 THEN '5' WHEN 1 THEN '5 5' WHEN 2 THEN '5|5' ELSE '5 5|5' END END AS rings, CASE WHEN o_orderkey % 3 = 0 THEN 'drone_survey' ELSE 'unknown' END AS source, CASE WHEN o_orderkey % 9 = 8 THEN 'not_a_polygon' END AS reason FROM orders WHERE o_orderkey % 10 <> 9")
def io4(spark: SparkSession, d: str) -> DataFrame:
    """Every shape is written as a GeoJSON feature and read back; some have no key, some are points."""
    known = F.when(F.col("o_orderkey") % 10 != 9, F.col("o_orderkey").cast("string"))
    properties = F.struct(known.alias("parcel_key"), F.when(F.col("o_orderkey") % 3 == 0, "drone_survey").alias("source"))
    point = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.5]},"properties":'), F.to_json(properties), F.lit("}"))
    text = F.when(F.col("o_orderkey") % 9 == 8, point).otherwise(exports.feature(F.col("parts"), properties))
    at = f"{shared_folder(spark)}/geojson-{uuid.uuid4().hex}"
    shaped(spark, d).select(text.alias("value")).write.text(at)
    rings = F.transform("parts", lambda part: F.array_join(F.transform(part, lambda r: F.size(r).cast("string")), " "))
    return files.geojson(spark, at, lines=True).select("parcel_key", F.array_join(rings, "|").alias("rings"), "source", "reason")


@query("io5_policy", "SELECT * FROM (VALUES ('AREA_SUM_MISMATCH', CAST(2 AS DOUBLE), CAST(0.005 AS DOUBLE)), ('SHARE_MISSING', CAST(1 AS DOUBLE), CAST(0.005 AS DOUBLE))) t(code, absolute, relative)")
def io5(spark: SparkSession, d: str) -> DataFrame:
    p = files.policy(json.dumps({"rules": {"AREA_SUM_MISMATCH": {"absolute_sq_metre": 2.0}}}))
    return spark.createDataFrame([(c, p.of(c).absolute, p.of(c).relative) for c in ("AREA_SUM_MISMATCH", "SHARE_MISSING")], "code string, absolute double, relative double")


@query("io8_artifact_projection", f"WITH {PARCELS}, {EVENTS}, i AS (SELECT parcel_id, count(*) AS n, max(k % 4) AS worst FROM review_events GROUP BY 1), s AS (SELECT p.id, i.n AS issues, CASE i.worst WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' WHEN 3 THEN 'critical' END AS severity, mismatch, confidence, CAST(coalesce(i.n, 0) AS INT) AS issue_count, action FROM parcels p LEFT JOIN i ON i.parcel_id = p.id), t AS (SELECT *, {SCORE} AS score FROM s) SELECT id, issue_count, severity, score, {BAND} AS band FROM t")
def io8(spark: SparkSession, d: str) -> DataFrame:
    i = review_events(spark, d).groupBy("parcel_id").agg(F.count(F.lit(1)).alias("issues"), F.max(F.col("k") % 4).alias("worst"))
    p = parcels(spark, d).select("id", "mismatch", "confidence", "action").join(i, F.col("id") == F.col("parcel_id"), "left")
    severities = F.array(*(F.lit(s) for s in ("info", "warning", "error", "critical")))
    p = p.withColumns({"severity": F.get(severities, F.col("worst")), "issue_count": F.coalesce("issues", F.lit(0)).cast("int")}).withColumn("score", triage.score())
    return p.select("id", "issue_count", "severity", "score", triage.band(F.col("score")).alias("band"))


@query("io15_html_report", f"WITH {PARCELS} SELECT id, concat('<dl><dt>id</dt><dd>', id, '</dd><dt>state</dt><dd>', state, '</dd><dt>district</dt><dd>', coalesce(district, ''), '</dd><dt>note</dt><dd>&lt;b&gt;', village, '&lt;/b&gt; &amp; &quot;', survey_number, '&quot;</dd></dl>') AS facts FROM parcels")
def io15(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d).withColumn("note", F.concat(F.lit("<b>"), "village", F.lit('</b> & "'), "survey_number", F.lit('"')))
    return p.select("id", exports.report_facts(("id", "state", "district", "note")).alias("facts"))


@query("wf7_revalidate", "SELECT * FROM (VALUES ('yaml_gap', 1, 0)) t(parcel_key, before, after)")
def wf7(spark: SparkSession, d: str) -> DataFrame:
    r = records(spark).filter("parcel_key = 'yaml_gap'")
    a = rules.report(r, rules.DEFAULT, F.lit(AS_OF).cast("date")).select("parcel_key", F.col("issue_count").alias("before"))
    b = rules.report(r, rules.SHIPPED, F.lit(AS_OF).cast("date")).select(F.col("parcel_key").alias("k"), F.col("issue_count").alias("after"))
    return a.join(b, F.col("parcel_key") == F.col("k")).select("parcel_key", "before", "after")


@query("wf13_active_policy", "SELECT 'default' AS name, CAST(1 AS DOUBLE) AS absolute, 7 AS overrides")
def wf13(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(rules.SHIPPED.name, rules.SHIPPED.absolute, len(rules.SHIPPED.rules))], "name string, absolute double, overrides int")
