"""The record rules over records that are assembled from orders and lineitem: the rule engine itself against SQL on the flat tables.

A record is an order; its sub-divisions, owners, mutations and charges are its lines in
order of (number, part, supplier, date, quantity, price), so an index in a path is a line's place.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules
from .engine import TODAY
from .registry import Registry
from .views import table

query = Registry()
#: z scores of a few siblings stay low, so the threshold of this policy is low too.
POLICY = rules.Policy(rules={"ASSESSMENT_DISPROPORTIONATE": rules.Tolerance(z_score=1.6)})

_LINE = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"
_ENTRY = "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END"


def records(spark: SparkSession, d: str) -> DataFrame:
    """One nested record per order (``rules.RECORD``)."""
    none = "CAST(NULL AS STRING)"
    area = lambda v, parts="CAST(map() AS MAP<STRING,DECIMAL(18,4)>)", system="'metric_ha_are_sqm'": f"named_struct('sq_metre', CAST({v} AS DECIMAL(24,4)), 'unit_system', {system}, 'components', {parts})"
    person = lambda v: f"named_struct('raw', {v}, 'relation_type', {none}, 'relation_name', {none})"
    parts = {
        "sub": f"named_struct('sub_division_number', CAST(l_linenumber AS STRING), 'area', {area('l_extendedprice', 'map(\"are\", CAST(l_partkey % 120 AS DECIMAL(18,4)))')}, 'assessment_amount', CAST(l_quantity AS DECIMAL(18,2)), 'owner_serial_numbers', array(CAST(l_linenumber % 6 AS STRING), CAST(l_suppkey % 9 AS STRING)))",
        "part": f"named_struct('classification', l_returnflag, 'area', {area('l_extendedprice')})",
        "owner": f"named_struct('serial_number', CAST(l_partkey % 6 AS STRING), 'name', {person('concat(\" N\", CAST(l_suppkey % 10 AS STRING), \" \")')}, 'share', CASE WHEN o_orderkey % 5 = 0 OR (o_orderkey % 5 = 1 AND l_linenumber = 1) THEN NULL ELSE named_struct('num', CAST(l_linenumber AS BIGINT), 'den', 12L) END)",
        "mutation": f"named_struct('mutation_number', CAST(l_linenumber AS STRING), 'mutation_type', CASE l_returnflag WHEN 'R' THEN 'correction' WHEN 'A' THEN 'inheritance' ELSE 'sale' END, 'status', CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'sanctioned' END, 'entry_date', {_ENTRY}, 'order_date', date_add({_ENTRY}, CAST(l_suppkey % 40 AS INT)), 'to_parties', array({person('concat(\"n\", CAST(l_partkey % 10 AS STRING))')}), 'area_transacted', {area('CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE l_extendedprice END')})",
        "charge": f"named_struct('encumbrance_type', 'mortgage', 'status', CASE l_partkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'discharged' WHEN 2 THEN 'unknown' END, 'holder_name', {none})",
    }
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*_LINE.split(", "), "l_linestatus", "l_returnflag"))).alias("lines"))  # an order has a few lines
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    of = lambda part, keep="true": f"transform(filter(lines, x -> {keep}), x -> {re.sub(r'\bl_', 'x.l_', parts[part])})"
    total = area("CASE o_orderkey % 37 WHEN 1 THEN 0 WHEN 2 THEN -5 ELSE o_totalprice END", "map('are', CAST(o_orderkey % 150 AS DECIMAL(18,4)), 'sq_metre', CAST(o_orderkey % 130 AS DECIMAL(18,4)))", "CASE WHEN o_orderkey % 2 = 0 THEN 'metric_ha_are_sqm' ELSE 'acre_guntha' END")
    return o.selectExpr(
        "CAST(o_orderkey AS STRING) AS parcel_key",
        "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE CAST(o_orderkey % 1000 AS STRING) END AS survey_number",
        "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 500 AS STRING) END AS khata_number",
        "transform(filter(lines, x -> x.l_linestatus = 'O'), x -> CAST(x.l_partkey % 15 AS STRING)) AS khasra_numbers",
        f"CASE WHEN o_orderkey % 37 <> 0 THEN {total} END AS total_area",
        f"named_struct('state', 'S', 'district', CASE WHEN o_orderkey % 41 <> 0 THEN 'D' END, 'tehsil', CASE WHEN o_orderkey % 43 = 0 THEN '' ELSE 'T' END, 'village', 'V', 'village_lgd_code', CASE WHEN o_orderkey % 3 = 0 THEN '123' END) AS jurisdiction",
        f"{of('sub')} AS sub_divisions", f"{of('part', 'x.l_returnflag = \"R\"')} AS classified_areas", f"{of('owner', 'x.l_linestatus = \"F\"')} AS owners",
        f"{of('mutation')} AS mutations", f"{of('charge', 'x.l_quantity > 40')} AS encumbrances",
    )


O = "o AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS parcel_key, o_custkey, CASE o_orderkey % 37 WHEN 0 THEN NULL WHEN 1 THEN CAST(0 AS DECIMAL(24,4)) WHEN 2 THEN CAST(-5 AS DECIMAL(24,4)) ELSE CAST(o_totalprice AS DECIMAL(24,4)) END AS total FROM orders)"  # noqa: E741
LI = f"li AS (SELECT *, l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS parcel_key, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE}) - 1 AS i, CAST(l_extendedprice AS DECIMAL(24,4)) AS area, {_ENTRY} AS entry FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))"
OW = f"ow AS (SELECT k, parcel_key, row_number() OVER (PARTITION BY k ORDER BY {_LINE}) - 1 AS i, CAST(l_partkey % 6 AS VARCHAR) AS serial, concat('n', l_suppkey % 10) AS name, CASE WHEN k % 5 = 0 OR (k % 5 = 1 AND l_linenumber = 1) THEN NULL ELSE l_linenumber END AS num FROM li WHERE l_linestatus = 'F')"


def _found(spark: SparkSession, d: str, *codes: str) -> DataFrame:
    """Findings of these codes, by the rules that give them."""
    return rules.validate(records(spark, d), POLICY, F.lit(TODAY), codes).select("parcel_key", "rule_code", "severity", "json_path", "observed", "delta")


def _sql(head: str, *parts: str) -> str:
    """Findings of each part: its columns are parcel_key, code, severity, path, and where it has them observed and delta."""
    each = [p if " AS observed" in p else p.replace(" FROM ", ", NULL AS observed, CAST(NULL AS DOUBLE) AS delta FROM ", 1) for p in parts]
    return f"WITH {head} SELECT parcel_key, rule_code, severity, json_path, CAST(observed AS VARCHAR) AS observed, CAST(delta AS DOUBLE) AS delta FROM (" + " UNION ALL ".join(f"({p})" for p in each) + ") t(parcel_key, rule_code, severity, json_path, observed, delta)"


_D = "CAST(NULL AS DOUBLE) AS delta"


@query("vr_areas", _sql(
    f"{O}, {LI}, s AS (SELECT k, sum(area) AS s FROM li GROUP BY 1), c AS (SELECT k, sum(area) AS s FROM li WHERE l_returnflag = 'R' GROUP BY 1), z AS (SELECT parcel_key, i, l_quantity / CAST(area AS DOUBLE) AS r, avg(l_quantity / CAST(area AS DOUBLE)) OVER w AS m, stddev_pop(l_quantity / CAST(area AS DOUBLE)) OVER w AS sd, count(*) OVER w AS n FROM li WHERE area > 0 WINDOW w AS (PARTITION BY k))",
    "SELECT parcel_key, 'TOTAL_AREA_MISSING' AS rule_code, 'critical' AS severity, '$.total_area' AS json_path FROM o WHERE total IS NULL",
    f"SELECT parcel_key, 'TOTAL_AREA_NON_POSITIVE' AS rule_code, 'critical' AS severity, '$.total_area' AS json_path, CAST(total AS VARCHAR) AS observed, {_D} FROM o WHERE total <= 0",
    "SELECT parcel_key, CASE WHEN s > total THEN 'AREA_SUM_EXCEEDS_TOTAL' ELSE 'AREA_SUM_MISMATCH' END AS rule_code, 'error' AS severity, '$.sub_divisions' AS json_path, CAST(s AS VARCHAR) AS observed, s - total AS delta FROM o JOIN s USING (k) WHERE s > total OR NOT (abs(s - total) <= 1 OR abs(CAST(s - total AS DOUBLE)) / CAST(total AS DOUBLE) <= 0.005)",
    "SELECT parcel_key, 'CLASSIFICATION_SPLIT_MISMATCH' AS rule_code, 'error' AS severity, '$.classified_areas' AS json_path, CAST(c.s AS VARCHAR) AS observed, c.s - total AS delta FROM o JOIN c USING (k) WHERE NOT (abs(c.s - total) <= 1 OR CASE WHEN total = 0 THEN CAST(1 AS DOUBLE) ELSE abs(CAST(c.s - total AS DOUBLE)) / CAST(total AS DOUBLE) END <= 0.005)",
    f"SELECT parcel_key, 'AREA_COMPONENT_OUT_OF_RANGE' AS rule_code, 'warning' AS severity, '$.total_area.components.are' AS json_path, concat(k % 150, '.0000') AS observed, {_D} FROM o WHERE k % 37 <> 0 AND k % 2 = 0 AND k % 150 >= 100",
    f"SELECT parcel_key, 'AREA_COMPONENT_OUT_OF_RANGE' AS rule_code, 'warning' AS severity, '$.total_area.components.sq_metre' AS json_path, concat(k % 130, '.0000') AS observed, {_D} FROM o WHERE k % 37 <> 0 AND k % 2 = 0 AND k % 130 >= 100",
    f"SELECT parcel_key, 'AREA_COMPONENT_OUT_OF_RANGE' AS rule_code, 'warning' AS severity, concat('$.sub_divisions[', i, '].area.components.are') AS json_path, concat(l_partkey % 120, '.0000') AS observed, {_D} FROM li WHERE l_partkey % 120 >= 100",
    f"SELECT parcel_key, 'ASSESSMENT_DISPROPORTIONATE' AS rule_code, 'warning' AS severity, concat('$.sub_divisions[', i, '].assessment_amount') AS json_path, printf('%.4f', r) AS observed, {_D} FROM z WHERE n >= 3 AND sd > 0 AND abs((r - m) / sd) >= 1.6",
))
def vr_areas(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "TOTAL_AREA_MISSING", "TOTAL_AREA_NON_POSITIVE", "AREA_SUM_EXCEEDS_TOTAL", "AREA_SUM_MISMATCH", "CLASSIFICATION_SPLIT_MISMATCH", "AREA_COMPONENT_OUT_OF_RANGE", "ASSESSMENT_DISPROPORTIONATE")


_SHARE = "CASE WHEN n // gcd(n, 12) >= 12 // gcd(n, 12) AND 12 // gcd(n, 12) = 1 THEN CAST(n // gcd(n, 12) AS VARCHAR) ELSE concat(n // gcd(n, 12), '/', 12 // gcd(n, 12)) END"


@query("vr_owners", _sql(
    f"{O}, {LI}, {OW}, t AS (SELECT k, parcel_key, CAST(sum(num) AS BIGINT) AS n, count(*) AS owners, count(num) AS stated FROM ow GROUP BY 1, 2), q AS (SELECT parcel_key, i, k, CAST(l_linenumber % 6 AS VARCHAR) AS ref FROM li UNION ALL SELECT parcel_key, i, k, CAST(l_suppkey % 9 AS VARCHAR) FROM li)",
    "SELECT parcel_key, 'NO_OWNERS_RECORDED' AS rule_code, 'warning' AS severity, '$.owners' AS json_path FROM o WHERE k NOT IN (SELECT k FROM ow)",
    f"SELECT parcel_key, CASE WHEN n > 12 THEN 'SHARE_SUM_EXCEEDS_UNITY' ELSE 'SHARE_SUM_NOT_UNITY' END AS rule_code, CASE WHEN n > 12 THEN 'error' ELSE 'warning' END AS severity, '$.owners' AS json_path, {_SHARE} AS observed, {_D} FROM t WHERE stated = owners AND n <> 12",
    "SELECT parcel_key, 'SHARE_MISSING' AS rule_code, 'warning' AS severity, '$.owners' AS json_path FROM t WHERE owners > 1 AND stated = 0",
    f"SELECT parcel_key, 'DUPLICATE_OWNER_SERIAL' AS rule_code, 'error' AS severity, concat('$.owners[', i, '].serial_number') AS json_path, serial AS observed, {_D} FROM ow a WHERE EXISTS (SELECT 1 FROM ow b WHERE b.k = a.k AND b.serial = a.serial AND b.i < a.i)",
    f"SELECT parcel_key, 'ORPHAN_OWNER_REFERENCE' AS rule_code, 'error' AS severity, concat('$.sub_divisions[', i, '].owner_serial_numbers') AS json_path, ref AS observed, {_D} FROM q WHERE NOT EXISTS (SELECT 1 FROM ow WHERE ow.k = q.k AND ow.serial = q.ref)",
    "SELECT parcel_key, 'OWNER_WITHOUT_MUTATION_TRAIL' AS rule_code, 'info' AS severity, concat('$.owners[', i, ']') AS json_path FROM ow WHERE EXISTS (SELECT 1 FROM li WHERE li.k = ow.k AND l_linestatus = 'F') AND NOT EXISTS (SELECT 1 FROM li WHERE li.k = ow.k AND l_linestatus = 'F' AND concat('n', l_partkey % 10) = ow.name)",
))
def vr_owners(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "NO_OWNERS_RECORDED", "SHARE_SUM_EXCEEDS_UNITY", "SHARE_SUM_NOT_UNITY", "SHARE_MISSING", "DUPLICATE_OWNER_SERIAL", "ORPHAN_OWNER_REFERENCE", "OWNER_WITHOUT_MUTATION_TRAIL")


_T, _MOVED = f"DATE '{TODAY}'", "CASE WHEN l_suppkey % 3 = 0 THEN CAST(0 AS DECIMAL(24,4)) ELSE area END"


@query("vr_mutations", _sql(
    f"{O}, {LI}, e AS (SELECT *, lag(entry) OVER (PARTITION BY k ORDER BY i) AS before FROM li WHERE entry IS NOT NULL), m AS (SELECT li.*, {_MOVED} AS moved, total FROM li JOIN o USING (k))",
    f"SELECT parcel_key, 'MUTATION_OUT_OF_SEQUENCE' AS rule_code, 'warning' AS severity, concat('$.mutations[', i, '].entry_date') AS json_path, CAST(entry AS VARCHAR) AS observed, {_D} FROM e WHERE entry < before",
    f"SELECT parcel_key, 'MUTATION_DATE_IN_FUTURE' AS rule_code, 'error' AS severity, concat('$.mutations[', i, '].entry_date') AS json_path, CAST(entry AS VARCHAR) AS observed, {_D} FROM li WHERE entry > {_T}",
    f"SELECT parcel_key, 'MUTATION_DATE_IN_FUTURE' AS rule_code, 'error' AS severity, concat('$.mutations[', i, '].order_date') AS json_path, CAST(entry + CAST(l_suppkey % 40 AS INT) AS VARCHAR) AS observed, {_D} FROM li WHERE entry + CAST(l_suppkey % 40 AS INT) > {_T}",
    f"SELECT parcel_key, 'MUTATION_PENDING_UNRESOLVED' AS rule_code, 'warning' AS severity, concat('$.mutations[', i, '].status') AS json_path, CAST({_T} - entry AS VARCHAR) AS observed, {_D} FROM li WHERE l_linestatus = 'O' AND {_T} - entry > 180",
    f"SELECT parcel_key, 'MUTATION_AREA_EXCEEDS_PARCEL' AS rule_code, 'error' AS severity, concat('$.mutations[', i, '].area_transacted') AS json_path, CAST(moved AS VARCHAR) AS observed, {_D} FROM m WHERE moved > total",
    f"SELECT parcel_key, 'CORRECTION_CHANGED_AREA' AS rule_code, 'warning' AS severity, concat('$.mutations[', i, '].mutation_type') AS json_path, CAST(moved AS VARCHAR) AS observed, {_D} FROM m WHERE l_returnflag = 'R' AND moved <> 0",
))
def vr_mutations(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "MUTATION_OUT_OF_SEQUENCE", "MUTATION_DATE_IN_FUTURE", "MUTATION_PENDING_UNRESOLVED", "MUTATION_AREA_EXCEEDS_PARCEL", "CORRECTION_CHANGED_AREA")


@query("vr_charges_and_identifiers", _sql(
    f"{O}, {LI}, g AS (SELECT parcel_key, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS i, l_partkey % 4 AS s FROM li WHERE l_quantity > 40), h AS (SELECT parcel_key, k, i, CAST(l_partkey % 15 AS VARCHAR) AS khasra FROM li WHERE l_linestatus = 'O')",
    "SELECT parcel_key, 'ENCUMBRANCE_ACTIVE' AS rule_code, 'info' AS severity, concat('$.encumbrances[', i, ']') AS json_path FROM g WHERE s = 0",
    "SELECT parcel_key, 'ENCUMBRANCE_STATUS_UNKNOWN' AS rule_code, 'warning' AS severity, concat('$.encumbrances[', i, '].status') AS json_path FROM g WHERE s >= 2",
    "SELECT parcel_key, 'IDENTIFIER_MISSING' AS rule_code, 'critical' AS severity, '$' AS json_path FROM o WHERE k % 3 <> 2 AND k % 4 <> 0 AND k NOT IN (SELECT k FROM h)",
    f"SELECT parcel_key, 'DUPLICATE_KHASRA_NUMBER' AS rule_code, 'warning' AS severity, '$.khasra_numbers' AS json_path, khasra AS observed, {_D} FROM h a WHERE EXISTS (SELECT 1 FROM h b WHERE b.k = a.k AND b.khasra = a.khasra AND b.i < a.i)",
    "SELECT parcel_key, 'JURISDICTION_INCOMPLETE' AS rule_code, 'warning' AS severity, '$.jurisdiction' AS json_path FROM o WHERE k % 3 <> 0 AND (k % 41 = 0 OR k % 43 = 0)",
))
def vr_charges_and_identifiers(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, "ENCUMBRANCE_ACTIVE", "ENCUMBRANCE_STATUS_UNKNOWN", "IDENTIFIER_MISSING", "DUPLICATE_KHASRA_NUMBER", "JURISDICTION_INCOMPLETE")


_ALL = "SELECT parcel_key, severity, rule_code FROM (" + ") UNION ALL SELECT parcel_key, severity, rule_code FROM (".join(query.oracle.values()) + ")"


@query("vr_register_report", f"WITH f AS ({_ALL}), c AS (SELECT parcel_key, count(*) AS n, max(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 1 WHEN 'error' THEN 2 ELSE 3 END) AS worst, sum(CASE severity WHEN 'info' THEN 0 WHEN 'warning' THEN 400 WHEN 'error' THEN 1500 ELSE 4000 END * CASE rule_code WHEN 'ASSESSMENT_DISPROPORTIONATE' THEN 7 WHEN 'OWNER_WITHOUT_MUTATION_TRAIL' THEN 6 ELSE 10 END) AS lost FROM f GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS parcel_key, CAST(coalesce(n, 0) AS INT) AS issue_count, CASE worst WHEN 0 THEN 'info' WHEN 1 THEN 'warning' WHEN 2 THEN 'error' WHEN 3 THEN 'critical' END AS highest_severity, coalesce(worst >= 2, false) AS is_blocking, round(greatest(CAST(0 AS DOUBLE), 1 - CAST(coalesce(lost, 0) AS DOUBLE) / 100000), 4) AS integrity_score FROM orders LEFT JOIN c ON parcel_key = CAST(o_orderkey AS VARCHAR)")
def vr_register_report(spark: SparkSession, d: str) -> DataFrame:
    return rules.report(records(spark, d), POLICY, F.lit(TODAY))
