"""Record rules and geometry: SQL twins on the register views, and the nested engine on literal records."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import findings, geo, rules, shapes
from .registry import Registry
from .views import PARCELS, SUBS, parcels, sub_divisions

query = Registry()
TODAY = datetime.date(2001, 8, 2)


def _area(v, parts=None, system="metric_ha_are_sqm"):
    return (Decimal(v), system, {k: Decimal(x) for k, x in (parts or {}).items()})


def _mutation(number, kind="sale", status="sanctioned", entry=None, order=None, to=(), area=None):
    return (number, kind, status, entry, order, [(n, "unknown", None) for n in to], area)


_FULL = ("KA", "Belagavi", "Belagavi", "Testville", None)
_OWNER = ("1", ("Ram", "unknown", None), (1, 1))


def cases() -> list[tuple]:
    """Literal records, one or more per rule."""
    def record(key, total="5", survey="1", khata=None, khasra=(), place=_FULL, subs=(), split=(), owners=(_OWNER,), mutations=(), charges=()):
        return (key, survey, khata, list(khasra), _area(total) if isinstance(total, str) else total, place, list(subs), list(split), list(owners), list(mutations), list(charges))

    sub = lambda n, a, assessed=None, refs=("1",), parts=None: (n, _area(a, parts), None if assessed is None else Decimal(assessed), list(refs))
    owner = lambda s, name, share: (s, (name, "unknown", None), share)
    d = lambda days: TODAY - datetime.timedelta(days=days)
    return [
        record("clean", "12000", subs=[sub("1", "6000"), sub("2", "6000")]),
        record("exceeds", "10000", subs=[sub("1", "7000"), sub("2", "7000")]),
        record("tolerance", "10000", subs=[sub("1", "9999.5")]),
        record("short", "10000", subs=[sub("1", "9000")]),
        record("yaml_gap", "100", subs=[sub("1", "98.5")]),
        record("split", "10000", split=[("irrigated", _area("5000")), ("forest", _area("4000"))]),
        record("component", _area("20000", {"are": "105", "sq_metre": "5"}), subs=[sub("1", "20000", parts={"are": "5", "sq_metre": "100"})]),
        record("outlier", "900", subs=[sub(str(i), "100", "10") for i in range(8)] + [sub("9", "100", "900")]),
        record("no_owner", owners=[]),
        record("shares_over", owners=[owner("1", "A", (2, 3)), owner("2", "B", (2, 3))]),
        record("shares_thirds", owners=[owner("1", "A", (1, 3)), owner("2", "B", (1, 3)), owner("3", "C", (1, 3))]),
        record("shares_under", owners=[owner("1", "A", (1, 2)), owner("2", "B", (1, 4))]),
        record("share_missing", owners=[owner("1", "A", None), owner("2", "B", None)]),
        record("serials", owners=[owner("1", "A", (1, 2)), owner("1", "B", (1, 2))]),
        record("orphan", subs=[sub("1", "5", refs=("1", "9"))]),
        record("sequence", mutations=[_mutation("m1", entry=d(100), to=("ram",)), _mutation("m0"), _mutation("m2", entry=d(200))]),
        record("future", mutations=[_mutation("m1", entry=d(-10), to=("Ram ",))]),
        record("pending", mutations=[_mutation("m1", status="pending", entry=d(400))]),
        record("moves_more", mutations=[_mutation("m1", area=_area("6"), to=("RAM",))]),
        record("correction", mutations=[_mutation("m1", kind="correction", area=_area("1"), to=("Ram",))]),
        record("trail", mutations=[_mutation("m1", to=("Shyam",))]),
        record("charge", charges=[("mortgage", "active", "Bank")]),
        record("charge_unknown", charges=[("mortgage", "unknown", None)]),
        record("charge_done", charges=[("mortgage", "discharged", None)]),
        record("khasra", khasra=["4", "5", "4"], survey=None),
        record("nowhere", place=(None, "x", "y", "z", None)),
        record("empty", None, survey=None, place=(None,) * 5, owners=[]),
        record("zero", "0"),
    ]


#: (record, code, severity) under the default policy. What the rules must find.
EXPECTED = [
    ("exceeds", "AREA_SUM_EXCEEDS_TOTAL", "error"), ("short", "AREA_SUM_MISMATCH", "error"), ("yaml_gap", "AREA_SUM_MISMATCH", "error"),
    ("split", "CLASSIFICATION_SPLIT_MISMATCH", "error"), ("component", "AREA_COMPONENT_OUT_OF_RANGE", "warning"), ("component", "AREA_COMPONENT_OUT_OF_RANGE", "warning"),
    ("outlier", "ASSESSMENT_DISPROPORTIONATE", "warning"), ("no_owner", "NO_OWNERS_RECORDED", "warning"), ("shares_over", "SHARE_SUM_EXCEEDS_UNITY", "error"),
    ("shares_under", "SHARE_SUM_NOT_UNITY", "warning"), ("share_missing", "SHARE_MISSING", "warning"), ("serials", "DUPLICATE_OWNER_SERIAL", "error"),
    ("orphan", "ORPHAN_OWNER_REFERENCE", "error"), ("sequence", "MUTATION_OUT_OF_SEQUENCE", "warning"), ("future", "MUTATION_DATE_IN_FUTURE", "error"),
    ("pending", "MUTATION_PENDING_UNRESOLVED", "warning"), ("moves_more", "MUTATION_AREA_EXCEEDS_PARCEL", "error"), ("correction", "CORRECTION_CHANGED_AREA", "warning"),
    ("trail", "OWNER_WITHOUT_MUTATION_TRAIL", "info"), ("charge", "ENCUMBRANCE_ACTIVE", "info"), ("charge_unknown", "ENCUMBRANCE_STATUS_UNKNOWN", "warning"),
    ("khasra", "DUPLICATE_KHASRA_NUMBER", "warning"), ("nowhere", "JURISDICTION_INCOMPLETE", "warning"), ("empty", "TOTAL_AREA_MISSING", "critical"),
    ("empty", "NO_OWNERS_RECORDED", "warning"), ("empty", "IDENTIFIER_MISSING", "critical"), ("empty", "JURISDICTION_INCOMPLETE", "warning"), ("zero", "TOTAL_AREA_NON_POSITIVE", "critical"),
]


def records(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(cases(), rules.RECORD)


_VALUES = ", ".join(f"('{k}', '{c}', '{s}')" for k, c, s in EXPECTED)


@query("vr_registry_findings", f"SELECT * FROM (VALUES {_VALUES}) t(parcel_key, rule_code, severity)")
def vr(spark: SparkSession, d: str) -> DataFrame:
    return rules.validate(records(spark), rules.DEFAULT, F.lit(TODAY)).select("parcel_key", "rule_code", "severity")


_SHIPPED = ", ".join(f"('{k}', '{c}', '{'warning' if c == 'SHARE_SUM_EXCEEDS_UNITY' else s}')" for k, c, s in EXPECTED if k != "yaml_gap")


@query("vr_policy_overrides", f"SELECT * FROM (VALUES {_SHIPPED}) t(parcel_key, rule_code, severity)")
def vr_pol(spark: SparkSession, d: str) -> DataFrame:
    return rules.validate(records(spark), rules.SHIPPED, F.lit(TODAY)).select("parcel_key", "rule_code", "severity")


_PENALTY = {"info": 0.0, "warning": 0.04, "error": 0.15, "critical": 0.40}
_CONF = {"ASSESSMENT_DISPROPORTIONATE": 0.7, "OWNER_WITHOUT_MUTATION_TRAIL": 0.6}


def _reports() -> str:
    out = []
    for key in (c[0] for c in cases()):
        own = [(c, s) for k, c, s in EXPECTED if k == key]
        worst = max((s for _, s in own), key=list(_PENALTY).index, default=None)
        score = round(max(0.0, 1 - sum(_PENALTY[s] * _CONF.get(c, 1.0) for c, s in own)), 4)
        out.append(f"('{key}', {len(own)}, {'NULL' if worst is None else repr(worst)}, {str(any(s in ('error', 'critical') for _, s in own)).lower()}, {score})")
    return ", ".join(out)


@query("vr_report", f"SELECT parcel_key, CAST(n AS INT) AS issue_count, worst AS highest_severity, blocking AS is_blocking, CAST(score AS DOUBLE) AS integrity_score FROM (VALUES {_reports()}) t(parcel_key, n, worst, blocking, score)")
def vr_report(spark: SparkSession, d: str) -> DataFrame:
    return rules.report(records(spark), rules.DEFAULT, F.lit(TODAY))


@query("wf12_rule_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{c}', true)" for c in rules.REGISTRY) + ") t(rule_code, enabled)")
def wf12(spark: SparkSession, d: str) -> DataFrame:
    return rules.catalogue(spark).select("rule_code", "enabled")


# The same conditions over the views, where the tables are large


@query("vr3_area_sum", f"WITH {PARCELS}, {SUBS}, s AS (SELECT parcel_id, sum(area) AS total FROM sub_divisions GROUP BY 1), j AS (SELECT p.id, s.total, p.area FROM s JOIN parcels p ON p.id = s.parcel_id) SELECT id, CASE WHEN total > area THEN 'AREA_SUM_EXCEEDS_TOTAL' ELSE 'AREA_SUM_MISMATCH' END AS code, CAST(total - area AS DOUBLE) AS delta FROM j WHERE total > area OR NOT (CAST(abs(total - area) AS DOUBLE) <= 1 OR CAST(abs(total - area) AS DOUBLE) / CAST(area AS DOUBLE) <= 0.005)")
def vr3(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,4)").alias("area"))
    return rules.area_sums(sub_divisions(spark, d).select("parcel_id", "area"), p)


@query("vr8_share_sums", "SELECT l_orderkey, CAST(sum(l_linenumber) AS BIGINT) AS num, CASE WHEN sum(l_linenumber) > 24 THEN 'SHARE_SUM_EXCEEDS_UNITY' WHEN sum(l_linenumber) < 24 THEN 'SHARE_SUM_NOT_UNITY' END AS code FROM lineitem GROUP BY 1")
def vr8(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", F.col("l_linenumber").alias("num"), F.lit(24).alias("den"))
    return rules.share_sums(t, "l_orderkey", 24)


@query("vr11_orphan_references", f"WITH {SUBS} SELECT s.parcel_id, s.number, s.part, s.supplier FROM sub_divisions s WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = s.parcel_id AND o.o_custkey % 50 <> s.part % 50)")
def vr11(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("c"))
    s = sub_divisions(spark, d)
    return s.join(o, (F.col("parcel_id") == F.col("k")) & (F.col("part") % 50 != F.col("c")), "left_anti").select("parcel_id", "number", "part", "supplier")


@query("vr13_future_dates", f"WITH {SUBS} SELECT parcel_id, number, part, supplier FROM sub_divisions WHERE entry_date > DATE '2001-08-02'")
def vr13(spark: SparkSession, d: str) -> DataFrame:
    return sub_divisions(spark, d).filter(F.col("entry_date") > F.lit(TODAY)).select("parcel_id", "number", "part", "supplier")


@query("vr14_pending_too_long", f"WITH {SUBS} SELECT parcel_id, number, part, supplier, CAST(DATE '2001-08-02' - entry_date AS INT) AS age FROM sub_divisions WHERE status = 'pending' AND DATE '2001-08-02' - entry_date > 180")
def vr14(spark: SparkSession, d: str) -> DataFrame:
    age = F.date_diff(F.lit(TODAY), "entry_date")
    return sub_divisions(spark, d).filter((F.col("status") == "pending") & (age > 180)).select("parcel_id", "number", "part", "supplier", age.alias("age"))


@query("vr15_area_exceeds_parcel", f"WITH {PARCELS}, {SUBS} SELECT s.parcel_id, s.number, s.part, s.supplier FROM sub_divisions s JOIN parcels p ON p.id = s.parcel_id WHERE s.area > p.area")
def vr15(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d).select("id", F.col("area").alias("p_area"))
    return sub_divisions(spark, d).join(p, (F.col("id") == F.col("parcel_id")) & (F.col("area") > F.col("p_area"))).select("parcel_id", "number", "part", "supplier")


@query("vr17_owner_without_trail", "SELECT o_orderkey, o_custkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F' AND l_suppkey % 10 = o_custkey % 10)")
def vr17(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    done = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_linestatus = 'F'").select("l_orderkey", (F.col("l_suppkey") % 10).alias("to"))
    named = o.join(done, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return named.join(done, (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("o_custkey") % 10 == F.col("to")), "left_anti")


# Geometry


def _square(lon: str, lat: str, w: str) -> str:
    return f"array(named_struct('lon', {lon}, 'lat', {lat}), named_struct('lon', {lon} + {w}, 'lat', {lat}), named_struct('lon', {lon} + {w}, 'lat', {lat} + {w}), named_struct('lon', {lon}, 'lat', {lat} + {w}), named_struct('lon', {lon}, 'lat', {lat}))"


LON, LAT, W = "CAST(73 + o_orderkey % 400 * 0.01 AS DOUBLE)", "CAST(18 + o_orderkey % 300 * 0.01 AS DOUBLE)", "CAST(0.0007 + o_orderkey % 9 * 0.0001 AS DOUBLE)"


def squares(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(_square(LON, LAT, W)).alias("ring"))


_E = math.sqrt(geo.E2)


def _q_sql(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"((1 - {geo.E2!r}) * ({s} / (1 - {geo.E2!r} * {s} * {s}) - ln((1 - {_E!r} * {s}) / (1 + {_E!r} * {s})) / (2 * {_E!r})))".replace(repr(geo.E2), f"CAST({geo.E2!r} AS DOUBLE)").replace(repr(_E), f"CAST({_E!r} AS DOUBLE)")


AREA_SQL = f"abs(radians({W}) * (2 * {_q_sql(LAT)} - 2 * {_q_sql(f'({LAT} + {W})')})) * CAST({geo.A * geo.A!r} AS DOUBLE) / 4"


@query("ge1_ring_area", f"SELECT o_orderkey, round({AREA_SQL}, 1) AS area FROM orders")
def ge1(spark: SparkSession, d: str) -> DataFrame:
    return squares(spark, d).select("o_orderkey", F.round(geo.ring_area(F.col("ring")), 1).alias("area"))


# A parcel of two squares, the first with a square hole of half its width; which of them it has is decided by its number


def _shape(k: str = "o_orderkey") -> str:
    hole = _square(f"{LON} + {W} / 4", f"{LAT} + {W} / 4", f"{W} / 2")
    first, second = _square(LON, LAT, W), _square(f"{LON} + {W} * 2", LAT, f"{W} / 2")
    return f"CASE {k} % 4 WHEN 0 THEN array(array({first})) WHEN 1 THEN array(array({first}, {hole})) WHEN 2 THEN array(array({first}), array({second})) ELSE array(array({first}, {hole}), array({second})) END"


def shaped(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(_shape()).alias("parts"))


def _box_sql(lat: str, w: str) -> str:
    return f"abs(radians({w}) * (2 * {_q_sql(lat)} - 2 * {_q_sql(f'({lat} + {w})')})) * CAST({geo.A * geo.A!r} AS DOUBLE) / 4"


_HOLE, _SECOND = _box_sql(f"({LAT} + {W} / 4)", f"({W} / 2)"), _box_sql(LAT, f"({W} / 2)")
SHAPE_SQL = f"({AREA_SQL} - CASE WHEN o_orderkey % 4 IN (1, 3) THEN {_HOLE} ELSE CAST(0 AS DOUBLE) END + CASE WHEN o_orderkey % 4 >= 2 THEN {_SECOND} ELSE CAST(0 AS DOUBLE) END)"


@query("ge1_shape_area", f"SELECT o_orderkey, round({SHAPE_SQL}, 0) AS area, 5 * (1 + CASE WHEN o_orderkey % 4 >= 2 THEN 1 ELSE 0 END) AS vertices FROM orders")
def ge1c(spark: SparkSession, d: str) -> DataFrame:
    return shaped(spark, d).select("o_orderkey", F.round(geo.area(F.col("parts")), 0).alias("area"), shapes.vertices(F.col("parts")).alias("vertices"))


def _spoiled() -> str:
    """The shapes above, every eighth of them spoiled in one of seven ways."""
    p = lambda x, y: f"named_struct('lon', {LON} + {W} * {x}, 'lat', {LAT} + {W} * {y})"
    ring = lambda *at: f"array({', '.join(p(x, y) for x, y in at)})"
    whole = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    kinds = [
        f"array(array({ring((0, 0), (1, 1), (1, 0), (0, 1), (0, 0))}))",  # a bow tie
        f"array(array({ring((0, 0), (1, 0), (1, 1), (0, 1))}))",
        f"array(array({ring((0, 0), (1, 1), (2, 2), (0, 0))}))",
        f"array(array({whole}, {ring((2, 2), (3, 2), (3, 3), (2, 2))}))",  # a hole beside it
        f"array(array({whole}, {ring((0.5, 0.5), (1.5, 0.5), (1.5, 0.75), (0.5, 0.5))}))",  # a hole across its edge
        f"array(array({whole}), array({ring((0.25, 0.25), (0.5, 0.25), (0.5, 0.5), (0.25, 0.25))}))",  # a part inside a part
        f"array(array({whole}, {ring((0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75), (0.25, 0.25))}), array({ring((0.375, 0.375), (0.5, 0.375), (0.5, 0.5), (0.375, 0.375))}))",  # an island in the hole
    ]
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(kinds)) + f" ELSE {_shape('(o_orderkey div 8)')} END"


@query("ge1_validity", "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'self_intersection' WHEN 1 THEN 'not_closed' WHEN 2 THEN 'degenerate' WHEN 3 THEN 'hole_outside' WHEN 4 THEN 'self_intersection' WHEN 5 THEN 'nested' END AS reason FROM orders")
def ge1b(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr(_spoiled()).alias("parts"))
    return rows.select("o_orderkey", shapes.validity(F.col("parts")).alias("reason"))


COMPARED = f"c AS (SELECT id, CAST(area AS DOUBLE) AS t, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(area AS DOUBLE) * (1 + (id % 31 - 15) / CAST(100 AS DOUBLE)) END AS g, CASE id % 4 WHEN 0 THEN 'drone_survey' WHEN 1 THEN 'ets_survey' WHEN 2 THEN 'bhu_naksha' ELSE 'unknown' END AS source FROM parcels), r AS (SELECT *, CASE WHEN g IS NULL THEN NULL ELSE abs(t - g) / g END AS rel, CASE source WHEN 'drone_survey' THEN CAST(0.6 AS DOUBLE) WHEN 'ets_survey' THEN CAST(0.8 AS DOUBLE) WHEN 'bhu_naksha' THEN CAST(1.0 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END * CAST(0.005 AS DOUBLE) AS tol FROM c)"


def _compared(spark: SparkSession, d: str) -> DataFrame:
    p = parcels(spark, d)
    t = F.col("area").cast("double")
    names_ = F.array(*(F.lit(x) for x in ("drone_survey", "ets_survey", "bhu_naksha", "unknown")))
    p = p.select("id", t.alias("t"), F.when(F.col("id") % 9 != 0, t * (1 + (F.col("id") % 31 - 15) / F.lit(100.0))).alias("g"), F.get(names_, (F.col("id") % 4).cast("int")).alias("source"))
    return p.withColumns({"rel": geo.relative_delta(F.col("t"), F.col("g")), "tol": geo.tolerance(F.col("source"))})


@query("ge2_area_comparison", f"WITH {PARCELS}, {COMPARED} SELECT id, CASE WHEN rel IS NULL THEN 'undetermined' WHEN rel <= 0.001 THEN 'exact' WHEN rel <= tol THEN 'within_survey_tolerance' WHEN rel <= 0.02 THEN 'minor' WHEN rel <= 0.1 THEN 'material' ELSE 'severe' END AS band, CASE WHEN rel IS NULL THEN 0 ELSE round(least(CAST(100 AS DOUBLE), rel / CAST(0.1 AS DOUBLE) * 100), 1) END AS score, CASE WHEN rel IS NULL THEN 0 ELSE round(greatest(CAST(0 AS DOUBLE), 1 - rel / CAST(0.1 AS DOUBLE)), 3) END AS agreement FROM r".replace("THEN 0 ELSE", "THEN CAST(0 AS DOUBLE) ELSE"))
def ge2(spark: SparkSession, d: str) -> DataFrame:
    rel = F.col("rel")
    return _compared(spark, d).select("id", geo.band(rel, F.col("tol")).alias("band"), F.round(F.when(rel.isNull(), 0.0).otherwise(F.least(F.lit(100.0), rel / geo.SEVERE * 100)), 1).alias("score"), F.round(F.when(rel.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - rel / geo.SEVERE)), 3).alias("agreement"))


_SOURCES = "CASE o_orderkey % 5 WHEN 0 THEN 'drone_survey' WHEN 1 THEN 'ets_survey' WHEN 2 THEN 'bhu_naksha' WHEN 3 THEN o_orderpriority ELSE 'unknown' END"


@query("ge3_source_tolerance", f"SELECT {_SOURCES} AS source, CASE o_orderkey % 5 WHEN 0 THEN CAST(0.003 AS DOUBLE) WHEN 1 THEN CAST(0.004 AS DOUBLE) WHEN 4 THEN CAST(0.0075 AS DOUBLE) ELSE CAST(0.005 AS DOUBLE) END AS tolerance, count(*) AS n FROM orders GROUP BY ALL")
def ge3(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/orders.parquet").select(F.expr(_SOURCES).alias("source"))
    return t.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select("source", F.round(geo.tolerance(F.col("source")), 6).alias("tolerance"), "n")


CONF = "k AS (SELECT o_orderkey AS id, CAST(o_orderkey * 7 % 100 AS DOUBLE) / 100 AS a, CAST(o_orderkey * 11 % 100 AS DOUBLE) / 100 AS b, CAST(o_orderkey * 13 % 100 AS DOUBLE) / 100 AS c, CAST(o_orderkey * 17 % 100 AS DOUBLE) / 100 AS g, o_orderkey % 3 <> 0 AS ok FROM orders), m AS (SELECT *, a * 0.25 + b * 0.25 + c * 0.25 + g * 0.25 AS mean, CASE WHEN ok THEN least(a, b, c, g) ELSE least(a, b, c) END AS low FROM k), h AS (SELECT *, CASE WHEN low < 0.35 THEN least(mean, low) ELSE mean END AS held FROM m)".replace("0.25", "CAST(0.25 AS DOUBLE)").replace("< 0.35", "< CAST(0.35 AS DOUBLE)")
CONF_SCORE = "round(greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CASE WHEN ok THEN held ELSE least(held, CAST(0.55 AS DOUBLE)) END)), 4)"


def _confidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    part = lambda f: (k * f % 100).cast("double") / 100
    t = spark.read.parquet(f"{d}/orders.parquet").select(k.alias("id"), part(7).alias("a"), part(11).alias("b"), part(13).alias("c"), part(17).alias("g"), (k % 3 != 0).alias("ok"))
    return t.withColumn("score", geo.confidence(F.col("a"), F.col("b"), F.col("c"), F.col("g"), F.col("ok")))


@query("ge4_confidence", f"WITH {CONF} SELECT id, {CONF_SCORE} AS score FROM h")
def ge4(spark: SparkSession, d: str) -> DataFrame:
    return _confidence(spark, d).select("id", "score")


@query("ge5_topology_penalty", "SELECT l_orderkey, round(least(CAST(100 AS DOUBLE), sum(CASE WHEN l_quantity > 1 AND l_discount > 0.001 THEN least(CAST(40 AS DOUBLE), l_discount * 100) ELSE CAST(0 AS DOUBLE) END)), 1) AS penalty FROM lineitem GROUP BY 1")
def ge5(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    f = t.groupBy("l_orderkey").agg(F.collect_list(F.when(geo.is_material(F.col("l_quantity"), F.col("l_discount")), F.col("l_discount"))).alias("f"))
    return f.select("l_orderkey", F.round(F.least(F.lit(100.0), geo.topology_penalty(F.col("f"))), 1).alias("penalty"))


@query("ge6_action", f"WITH {CONF}, s AS (SELECT *, {CONF_SCORE} AS score, CASE id % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'within_survey_tolerance' WHEN 2 THEN 'minor' WHEN 3 THEN 'material' WHEN 4 THEN 'severe' ELSE 'undetermined' END AS band FROM h) SELECT id, CASE WHEN a < 0.45 OR b < 0.45 THEN 'reject_re_scan' WHEN id % 10 = 0 THEN 'field_verification' WHEN band IN ('material','severe') THEN 'field_verification' WHEN score >= 0.85 AND band IN ('exact','within_survey_tolerance') THEN 'auto_approve' ELSE 'review_queue' END AS action FROM s".replace("< 0.45", "< CAST(0.45 AS DOUBLE)"))
def ge6(spark: SparkSession, d: str) -> DataFrame:
    bands = F.array(*(F.lit(x) for x in ("exact", "within_survey_tolerance", "minor", "material", "severe", "undetermined")))
    t = _confidence(spark, d).withColumn("band", F.get(bands, (F.col("id") % 6).cast("int")))
    return t.select("id", geo.action(F.col("a"), F.col("b"), F.col("band"), F.col("score"), F.col("id") % 10 == 0).alias("action"))


# The stated area is that of a plane square of as many degrees, times a factor by number; every fourth parcel has no shape
_STATED = f"{W} * {W} * CAST(11700000000 AS DOUBLE) * (CAST(85 AS DOUBLE) + o_orderkey % 29) / CAST(100 AS DOUBLE)"
_GE7 = f"WITH m AS (SELECT o_orderkey, {_STATED} AS t, CASE WHEN o_orderkey % 4 <> 0 THEN {AREA_SQL} END AS g FROM orders), r AS (SELECT *, abs(t - g) / g AS rel FROM m)"


@query("ge7_discrepancy_report", f"{_GE7} SELECT o_orderkey, g IS NOT NULL AS geometry_matched, round(g, 1) AS area, CASE WHEN rel IS NULL THEN 'undetermined' WHEN rel <= 0.001 THEN 'exact' WHEN rel <= 0.005 THEN 'within_survey_tolerance' WHEN rel <= 0.02 THEN 'minor' WHEN rel <= 0.1 THEN 'material' ELSE 'severe' END AS band, CASE WHEN rel IS NULL THEN CAST(0 AS DOUBLE) ELSE round(least(CAST(100 AS DOUBLE), rel / CAST(0.1 AS DOUBLE) * 100), 2) END AS mismatch, CASE WHEN rel > CAST(0.02 AS DOUBLE) THEN 'field_verification' WHEN rel <= CAST(0.005 AS DOUBLE) THEN 'auto_approve' ELSE 'review_queue' END AS action FROM r")
def ge7(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey").cast("string").alias("parcel_key")
    s = squares(spark, d)
    records_ = s.select(key, F.expr(_STATED).alias("textual_area"), F.lit(0.95).alias("ocr"), F.lit(0.95).alias("llm"), F.lit(1.0).alias("integrity"))
    shapes_ = s.filter("o_orderkey % 4 <> 0").select(key, "ring", F.lit("cadastral_shapefile").alias("source"))
    out = geo.discrepancies(records_, shapes_)
    return out.select(F.col("parcel_key").cast("bigint").alias("o_orderkey"), "geometry_matched", F.round("geometric_area", 1).alias("area"), "band", F.col("mismatch_score").alias("mismatch"), F.col("recommended_action").alias("action"))


# Boxes on a lattice of 4,000 columns and as many rows as the table needs: each touches its eight neighbours at any size of the table


@query("jn14_neighbours", "WITH b AS (SELECT o_orderkey AS k, o_orderkey % 4000 AS i FROM orders), s AS (SELECT x.i AS di, y.i AS dj FROM range(-1, 2) x(i), range(-1, 2) y(i) WHERE x.i <> 0 OR y.i <> 0) SELECT p.k AS a, q.k AS b FROM b p, s, b q WHERE q.k = p.k + di + 4000 * dj AND p.i + di BETWEEN 0 AND 3999")
def jn14(spark: SparkSession, d: str) -> DataFrame:
    ring = _square("CAST(68 + o_orderkey % 4000 * 0.001 AS DOUBLE)", "CAST(8 + o_orderkey div 4000 * 0.001 AS DOUBLE)", "CAST(0.0012 AS DOUBLE)")
    boxes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("parcel_key"), F.expr(ring).alias("ring"))
    return geo.neighbours(boxes, cell=0.003).select("a", "b")


# Rows of squares a fifth wider than their distance, so that each overlaps its two neighbours by a sixth; every fifth has a hole
# of two fifths of its width with an island of a tenth of its width in it, every seventh is a bow tie


@query("ge8_topology", "WITH b AS (SELECT o_orderkey AS k, o_orderkey % 7 <> 0 AS valid, CASE WHEN o_orderkey % 5 = 0 THEN CAST(0.85 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS own FROM orders) SELECT CAST(p.k AS VARCHAR) AS parcel_key, CAST(q.k AS VARCHAR) AS counterpart, 'overlap' AS kind, round(1 / CAST(6 AS DOUBLE) / p.own, 3) AS fraction FROM b p, (VALUES (-1), (1)) s(step), b q WHERE q.k = p.k + step AND p.k // 1000 = q.k // 1000 AND p.valid AND q.valid UNION ALL SELECT CAST(k AS VARCHAR), NULL, 'self_intersection', CAST(0 AS DOUBLE) FROM b WHERE NOT valid")
def ge8(spark: SparkSession, d: str) -> DataFrame:
    lon, lat, w = "(CAST(68 AS DOUBLE) + o_orderkey % 1000 * CAST(0.001 AS DOUBLE))", "(CAST(8 AS DOUBLE) + o_orderkey div 1000 % 14000 * CAST(0.002 AS DOUBLE))", "CAST(0.0012 AS DOUBLE)"
    part = lambda at, size: _square(f"{lon} + {w} * {at}", f"{lat} + {w} * {at}", f"{w} * {size}")
    tie = f"transform(array(0, 2, 1, 3, 0), i -> element_at({part(0, 1)}, i + 1))"
    shape = f"CASE WHEN o_orderkey % 7 = 0 THEN array(array({tie})) WHEN o_orderkey % 5 = 0 THEN array(array({part(0, 1)}, {part(0.3, 0.4)}), array({part(0.45, 0.1)})) ELSE array(array({part(0, 1)})) END"
    lattice = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("parcel_key"), F.expr(shape).alias("parts"))
    return geo.topology_findings(lattice).select("parcel_key", "counterpart", "kind", F.round("fraction", 3).alias("fraction"))


@query("rd10_chain_breaks", f"WITH {SUBS}, o AS (SELECT parcel_id, entry_date, lag(entry_date) OVER (PARTITION BY parcel_id ORDER BY number, part, supplier, entry_date) AS before FROM sub_divisions) SELECT parcel_id, count(*) AS breaks FROM o WHERE entry_date < before GROUP BY 1")
def rd10(spark: SparkSession, d: str) -> DataFrame:
    out = findings.out_of_sequence(sub_divisions(spark, d), "parcel_id", ("number", "part", "supplier", "entry_date"), "entry_date")
    return out.groupBy("parcel_id").agg(F.count(F.lit(1)).alias("breaks"))


