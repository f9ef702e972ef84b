"""The bundle engine over cases that are assembled from orders and lineitem, against SQL on the flat tables.

A case is an order: its number decides the snapshots, deaths and heirs, its returned lines are mutations and its
accepted lines deeds.  The eight names are so unlike that a match is an equality, which SQL can say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle, readers, reads
from .registry import Registry
from .views import table

query = Registry()
NAMES = ("Ramesh Sharma", "Sunita Kulkarni", "Vijay Patil", "Gopal Iyer", "Lata Bhosale", "Abdul Shaikh", "Kiran Naik", "Thomas Fernandes")


def _name(i: str) -> str:
    return f"element_at(array({', '.join(repr(n) for n in NAMES)}), CAST(({i}) % 8 + 1 AS INT))"


def _owner(i: str, share: str = "NULL") -> str:
    n, _, d = share.partition("/")
    part = f"named_struct('num', {n}L, 'den', {d}L)" if d else "CAST(NULL AS STRUCT<num:BIGINT,den:BIGINT>)"
    return f"named_struct('name', {_name(i)}, 'relation_type', 'unknown', 'relation_name', CAST(NULL AS STRING), 'share', {part})"


def _parcel(khasra: str, village: str = "NULL", area: str = "NULL") -> str:
    none = "CAST(NULL AS STRING)"
    return f"named_struct('khasra_number', CAST({khasra} AS STRING), 'khata_number', {none}, 'survey_number', {none}, 'village', CAST({village} AS STRING), 'tehsil', {none}, 'district', {none}, 'state', {none}, 'area', CAST({area} AS DOUBLE))"


def cases(spark: SparkSession, d: str) -> DataFrame:
    """One case per order (``bundle.CASE``)."""
    k, c = "o_orderkey", "o_custkey"
    line = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus"
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*line.split(", ")))).alias("lines"))  # an order has a few lines
    o = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    before = f"CASE WHEN {k} % 3 = 0 THEN array({_owner(c, '1/2')}, {_owner(f'{c} + 1', '1/2')}) ELSE array({_owner(c, '1/1')}) END"
    two, three = f"{c} + 2", f"{c} + 3"
    after = f"CASE {k} % 5 WHEN 0 THEN {before} WHEN 1 THEN array({_owner(two, '1/1')}) WHEN 2 THEN array({_owner(two, '1/2')}, {_owner(three, '1/3')}) WHEN 3 THEN array({_owner(two)}) ELSE array({_owner(two, '2/3')}, {_owner(three, '2/3')}) END"
    snap = lambda label, kind, at, parcel, owners: f"named_struct('label', '{label}', 'document_type', '{kind}', 'as_of', DATE '{at}', 'as_of_inferred', false, 'parcel', {parcel}, 'owners', {owners}, 'is_legible', true)"
    old = snap("old", "jamabandi", "1990-01-01", _parcel("'125'", "'Angol'", "1000"), before)
    now_parcel = _parcel(f"CASE {k} % 7 WHEN 0 THEN '311' WHEN 1 THEN '125/2' WHEN 2 THEN NULL ELSE '125' END", f"CASE WHEN {k} % 7 <> 2 THEN 'Angol' END", f"CASE {k} % 9 WHEN 0 THEN 1500 WHEN 1 THEN 700 WHEN 2 THEN NULL ELSE 1003 END")
    new = snap("new", "updated_jamabandi", "2000-01-01", now_parcel, after)
    dead = lambda i, at, legible="true": f"named_struct('person', {_name(i)}, 'date_of_death', {at}, 'is_legible', {legible})"
    one = dead(c, "DATE '1995-06-01'")
    heir = lambda *i: f"array({', '.join(_heir(x) for x in i)})"
    _heir = lambda i: f"named_struct('name', {_name(f'{c} + {i}')}, 'relation', 'son_of', 'deceased_name', CAST(NULL AS STRING), 'share', CAST(NULL AS STRUCT<num:BIGINT,den:BIGINT>))"
    mutation = f"named_struct('number', CAST(x.l_linenumber AS STRING), 'mutation_type', IF(x.l_linestatus = 'F', 'inheritance', 'sale'), 'status', IF(x.l_quantity > 25, 'sanctioned', 'pending'), 'entry_date', IF(x.l_partkey % 7 = 0, NULL, date_add(DATE '1994-01-01', CAST(x.l_partkey % 1500 AS INT))), 'order_date', CAST(NULL AS DATE), 'parcel', {_parcel('CASE x.l_suppkey % 4 WHEN 0 THEN \"125\" WHEN 1 THEN \"125/2\" WHEN 2 THEN \"311\" END')}, 'area', CAST(NULL AS DOUBLE), 'previous_owners', IF(x.l_suppkey % 3 = 0, slice(array({_owner('x.l_suppkey')}), 1, 0), array({_owner('x.l_suppkey')})), 'new_owners', array({_owner('x.l_partkey', '1/1')}), 'is_legible', true)"
    deed = f"named_struct('document_type', CASE x.l_suppkey % 3 WHEN 0 THEN 'relinquishment_deed' WHEN 1 THEN 'tax_receipt' ELSE 'court_order' END, 'label', CAST(NULL AS STRING), 'issued_on', CAST(NULL AS DATE), 'executants', array({_owner('x.l_suppkey')}), 'beneficiaries', array({_owner('x.l_partkey')}), 'is_legible', x.l_quantity <> 50)"
    return o.selectExpr(
        f"CAST({k} AS STRING) AS case_id", f"CAST({k} AS STRING) AS parcel_key",
        f"CASE WHEN {k} % 97 = 0 THEN slice(array({old}), 1, 0) WHEN {k} % 11 = 0 THEN array({old}) ELSE array({old}, {new}) END AS snapshots",
        f"CASE WHEN {k} % 4 = 0 THEN slice(array({one}), 1, 0) WHEN {k} % 20 = 1 THEN array({one}, {dead(c, 'DATE \"1996-06-01\"')}) WHEN {k} % 4 = 1 THEN array({one}) WHEN {k} % 4 = 2 THEN array({dead(f'{c} + 5', 'DATE \"1995-06-01\"')}) ELSE array({dead(c, 'CAST(NULL AS DATE)', f'{k} % 8 <> 3')}) END AS deaths",
        f"CASE {k} % 6 WHEN 0 THEN slice({heir(2)}, 1, 0) WHEN 2 THEN {heir(2, 3)} WHEN 3 THEN {heir(2, 6)} WHEN 4 THEN {heir(6, 7)} ELSE {heir(2)} END AS heirs",
        f"transform(filter(lines, x -> x.l_returnflag = 'R'), x -> {mutation}) AS mutations",
        f"transform(filter(lines, x -> x.l_returnflag = 'A'), x -> {deed}) AS documents",
    )


def _tables() -> str:
    """The same cases as flat tables; names are their numbers."""
    return """
o AS (SELECT o_orderkey AS k, o_custkey % 8 AS c, CASE WHEN o_orderkey % 97 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 1 ELSE 2 END AS shots FROM orders),
li AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey) AS id, l_suppkey % 8 AS s, l_partkey % 8 AS p, * FROM lineitem),
b AS (SELECT k, c AS x FROM o WHERE shots > 0 UNION ALL SELECT k, (c + 1) % 8 FROM o WHERE shots > 0 AND k % 3 = 0),
a AS (SELECT k, c AS x FROM o WHERE shots = 2 AND k % 5 = 0 UNION ALL SELECT k, (c + 1) % 8 FROM o WHERE shots = 2 AND k % 5 = 0 AND k % 3 = 0 UNION ALL SELECT k, (c + 2) % 8 FROM o WHERE shots = 2 AND k % 5 <> 0 UNION ALL SELECT k, (c + 3) % 8 FROM o WHERE shots = 2 AND k % 5 IN (2, 4)),
d AS (SELECT k, CASE WHEN k % 4 = 2 THEN (c + 5) % 8 ELSE c END AS x, CASE WHEN k % 4 <> 3 THEN DATE '1995-06-01' END AS seen, NOT (k % 8 = 3) AS legible FROM o WHERE k % 4 <> 0 UNION ALL SELECT k, c, DATE '1996-06-01', true FROM o WHERE k % 20 = 1),
hg AS (SELECT k, (c + 2) % 8 AS x FROM o WHERE k % 6 IN (1, 2, 3, 5) UNION ALL SELECT k, (c + 3) % 8 FROM o WHERE k % 6 = 2 UNION ALL SELECT k, (c + 6) % 8 FROM o WHERE k % 6 IN (3, 4) UNION ALL SELECT k, (c + 7) % 8 FROM o WHERE k % 6 = 4),
m AS (SELECT k, id, s, p, l_suppkey % 3 = 0 AS unnamed, l_suppkey % 4 AS plot, l_linestatus = 'F' AS inherits, l_quantity > 25 AS sanctioned, CASE WHEN l_partkey % 7 <> 0 THEN DATE '1994-01-01' + CAST(l_partkey % 1500 AS INT) END AS seen FROM li WHERE l_returnflag = 'R' AND k IN (SELECT k FROM o)),
x AS (SELECT k, id, s, p, l_suppkey % 3 <> 1 AS deed, l_quantity <> 50 AS legible FROM li WHERE l_returnflag = 'A' AND k IN (SELECT k FROM o)),
known AS (SELECT k, x FROM d UNION SELECT k, x FROM b UNION SELECT k, x FROM a),
h AS (SELECT k, x FROM hg UNION SELECT k, s FROM x WHERE deed AND EXISTS (SELECT 1 FROM known n WHERE n.k = x.k AND n.x IN (x.s, x.p))),
nm AS (SELECT k, count(*) AS n, count(CASE WHEN sanctioned THEN 1 END) AS done, count(CASE WHEN inherits THEN 1 END) AS inherits, min(seen) AS first FROM m GROUP BY 1),
f AS (SELECT o.*, coalesce(nm.n, 0) AS muts, coalesce(nm.done, 0) AS done, coalesce(nm.inherits, 0) AS inherits, nm.first, CASE WHEN shots = 2 THEN k % 5 <> 0 ELSE coalesce(nm.n, 0) > 0 END AS changed, k % 4 <> 0 AS died, k % 4 IN (1, 3) AND shots > 0 AS linked, EXISTS (SELECT 1 FROM x WHERE x.k = o.k AND deed) AS deeds, (SELECT count(*) FROM h WHERE h.k = o.k) AS heirs FROM o LEFT JOIN nm USING (k)),
t AS (SELECT k, x FROM a UNION SELECT k, p FROM m WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.k = m.k)),
lo AS (SELECT h.k, h.x FROM h ANTI JOIN t ON t.k = h.k AND t.x = h.x),
ed AS (SELECT x.* FROM x WHERE deed AND (EXISTS (SELECT 1 FROM t WHERE t.k = x.k AND t.x IN (x.s, x.p)) OR EXISTS (SELECT 1 FROM lo WHERE lo.k = x.k AND lo.x IN (x.s, x.p)))),
un AS (SELECT lo.* FROM lo WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.k = lo.k AND lo.x IN (ed.s, ed.p))),
mv AS (SELECT DISTINCT m.k FROM m JOIN a ON a.k = m.k AND a.x = m.p WHERE m.seen IS NULL OR m.seen BETWEEN DATE '1990-01-01' AND DATE '2000-01-01'),
bx AS (SELECT DISTINCT x.k FROM x JOIN a ON a.k = x.k AND a.x = x.p WHERE deed),
bad AS (SELECT k FROM o WHERE k % 20 = 1 UNION ALL SELECT k FROM m WHERE EXISTS (SELECT 1 FROM a WHERE a.k = m.k) AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = m.k AND a.x = m.p) UNION ALL SELECT k FROM x WHERE deed AND EXISTS (SELECT 1 FROM a WHERE a.k = x.k) AND NOT EXISTS (SELECT 1 FROM a WHERE a.k = x.k AND a.x = x.p))"""


#: (rule, code, rows with k and status).
_RULES = (
    ("OWNER_IDENTITY_MATCH", "OWNER_IDENTITY_MISMATCH", "SELECT f.k, CASE WHEN NOT died THEN 'not_applicable' WHEN shots = 0 THEN 'review_required' WHEN d.x IN (SELECT b.x FROM b WHERE b.k = f.k) THEN 'pass' ELSE 'fail' END AS status FROM f LEFT JOIN d ON d.k = f.k AND shots > 0"),
    ("TRANSITION_AFTER_DEATH", "EVENT_SEQUENCE_INVALID", "SELECT k, CASE WHEN NOT linked OR NOT changed THEN 'not_applicable' WHEN k % 4 = 3 OR (first IS NULL AND shots < 2) THEN 'review_required' WHEN least(coalesce(first, DATE '2000-01-01'), CASE WHEN shots = 2 THEN DATE '2000-01-01' ELSE first END) < CASE WHEN k % 20 = 1 THEN DATE '1996-06-01' ELSE DATE '1995-06-01' END THEN 'fail' ELSE 'pass' END AS status FROM f WHERE NOT linked OR changed OR NOT EXISTS (SELECT 1 FROM b WHERE b.k = f.k AND b.x = f.c)"),
    ("TRANSITION_AFTER_DEATH", "RECORD_NOT_UPDATED_AFTER_DEATH", "SELECT k, 'warning' AS status FROM f WHERE linked AND NOT changed"),
    ("PARCEL_MATCH", "PARCEL_MISMATCH", "SELECT k, CASE WHEN shots < 2 THEN 'not_applicable' WHEN k % 7 = 0 THEN 'fail' WHEN k % 7 = 1 THEN 'warning' WHEN k % 7 = 2 THEN 'review_required' ELSE 'pass' END AS status FROM f"),
    ("MUTATION_PREDECESSOR_MATCH", "MUTATION_PREDECESSOR_MISMATCH", "SELECT f.k, CASE WHEN m.k IS NULL THEN 'not_applicable' WHEN unnamed THEN 'warning' WHEN m.s IN (SELECT b.x FROM b WHERE b.k = f.k) THEN 'pass' ELSE 'fail' END AS status FROM f LEFT JOIN m ON m.k = f.k AND shots > 0"),
    ("MUTATION_PARCEL_MATCH", "MUTATION_PARCEL_MISMATCH", "SELECT f.k, CASE WHEN m.k IS NULL THEN 'not_applicable' WHEN plot = 0 THEN 'pass' WHEN plot = 2 THEN 'fail' ELSE 'warning' END AS status FROM f LEFT JOIN m ON m.k = f.k AND shots > 0"),
    ("SHARE_SUM_CONSISTENCY", "SHARE_SUM_INCONSISTENT", "SELECT k, CASE k % 5 WHEN 2 THEN 'warning' WHEN 4 THEN 'fail' ELSE 'pass' END AS status FROM f WHERE shots = 2 UNION ALL SELECT k, 'pass' FROM m UNION ALL SELECT k, 'not_applicable' FROM f WHERE shots < 2 AND muts = 0"),
    ("AREA_CONSISTENCY", "AREA_MISMATCH", "SELECT k, CASE WHEN shots < 2 OR k % 9 = 2 THEN 'not_applicable' WHEN k % 9 = 0 THEN 'fail' WHEN k % 9 = 1 THEN 'warning' ELSE 'pass' END AS status FROM f"),
    ("HEIRS_IDENTIFIED", "HEIRS_NOT_IDENTIFIED", "SELECT k, CASE WHEN NOT died THEN 'not_applicable' WHEN heirs > 0 THEN 'pass' ELSE 'warning' END AS status FROM f"),
    ("SUCCESSION_EVIDENCE", "EVIDENCE_MISSING", "SELECT k, CASE WHEN NOT changed THEN 'not_applicable' WHEN done > 0 OR deeds THEN 'pass' WHEN muts > 0 THEN 'warning' ELSE 'review_required' END AS status FROM f"),
    ("EXCLUSIVE_TRANSFER_EVIDENCE", "EXCLUSIVE_TRANSFER_UNSUPPORTED", "SELECT k, CASE WHEN NOT changed OR NOT linked OR heirs <= 1 OR k NOT IN (SELECT k FROM t) THEN 'not_applicable' WHEN k NOT IN (SELECT k FROM lo) THEN 'pass' WHEN k NOT IN (SELECT k FROM ed) THEN 'review_required' WHEN k NOT IN (SELECT k FROM un) THEN 'pass' ELSE 'warning' END AS status FROM f"),
    ("TRANSITION_CHAIN_COMPLETE", "UNEXPLAINED_TRANSITION", "SELECT k, CASE WHEN shots < 2 THEN 'not_applicable' WHEN k % 5 = 0 OR k IN (SELECT k FROM mv) OR (linked AND k IN (SELECT k FROM bx)) THEN 'pass' ELSE 'review_required' END AS status FROM f"),
    ("DEATH_RECORD_PRESENT", "DEATH_RECORD_MISSING", "SELECT k, CASE WHEN died THEN 'pass' WHEN inherits > 0 OR k % 6 <> 0 THEN 'warning' ELSE 'not_applicable' END AS status FROM f"),
    ("MUTATION_RECORD_PRESENT", "MUTATION_MISSING", "SELECT k, CASE WHEN muts > 0 THEN 'pass' WHEN NOT changed THEN 'not_applicable' ELSE 'warning' END AS status FROM f"),
    ("DOCUMENT_CONSISTENCY", "DOCUMENTS_CONTRADICT", "SELECT k, 'fail' AS status FROM bad UNION ALL SELECT k, 'pass' FROM f WHERE k NOT IN (SELECT k FROM bad)"),
    ("DOCUMENT_LEGIBILITY", "DOCUMENT_UNREADABLE", "SELECT k, CASE WHEN k % 8 = 3 OR k IN (SELECT k FROM x WHERE NOT legible) THEN 'warning' ELSE 'pass' END AS status FROM f"),
    ("NAME_MATCH_QUALITY", "NAME_MATCH_APPROXIMATE", "SELECT k, 'pass' AS status FROM f"),
)
_CHECKS = f"{_tables()}, checks AS (" + " UNION ALL ".join(f"SELECT k, '{r}' AS rule, 'SUCCESSION_{c}' AS rule_code, status FROM ({sql})" for r, c, sql in _RULES) + ")"
_POINTS = " ".join(f"WHEN '{c}' THEN {p}" for c, p in bundle.RISK_POINTS.items())
_RISK = f"SELECT k, round(least(CAST(100 AS DOUBLE), CAST(sum(round(CASE rule_code {_POINTS} ELSE 20 END * CASE status WHEN 'fail' THEN 1.0 WHEN 'review_required' THEN 0.85 WHEN 'warning' THEN 0.45 ELSE 0 END, 2)) AS DOUBLE)), 2) AS risk, max(CASE status WHEN 'not_applicable' THEN 0 WHEN 'pass' THEN 1 WHEN 'warning' THEN 2 WHEN 'review_required' THEN 3 ELSE 4 END) AS worst FROM checks GROUP BY 1"


@query("sx_register_checks", f"WITH {_CHECKS} SELECT CAST(k AS VARCHAR) AS case_id, rule, rule_code, status, count(*) AS n FROM checks GROUP BY ALL")
def sx_register_checks(spark: SparkSession, d: str) -> DataFrame:
    c = reports(spark, d, "checks").select("case_id", F.explode("checks").alias("c"))
    return c.groupBy("case_id", "c.rule", "c.rule_code", "c.status").agg(F.count(F.lit(1)).alias("n"))


#: The fields of a check that its sentences are made of.
SAID = ("rule", "rule_code", "status", "message", "observed")
_SAID = " ".join(f"WHEN '{r}|{s}' THEN '{m}'" for r, by in bundle.MESSAGES.items() for s, m in by.items())


@query("sx_register_reports", f"WITH {_CHECKS}, r AS ({_RISK}), s AS (SELECT k, count(DISTINCT CASE concat(rule, '|', status) {_SAID} END) + 2 * count(CASE WHEN rule = 'EXCLUSIVE_TRANSFER_EVIDENCE' AND status IN ('review_required', 'warning') THEN 1 END) AS n FROM checks GROUP BY 1) SELECT CAST(k AS VARCHAR) AS case_id, risk AS risk_score, CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 40 THEN 'high' WHEN risk >= 15 THEN 'medium' ELSE 'low' END AS risk_level, CASE worst WHEN 4 THEN 'inconsistent' WHEN 3 THEN 'review_required' WHEN 2 THEN 'incomplete' ELSE 'validated' END AS outcome, CASE WHEN shots = 0 AND muts = 0 THEN 'insufficient_documents' WHEN NOT changed THEN 'no_transition_detected' WHEN linked THEN 'owner_death_succession' ELSE 'ownership_transition' END AS event_type, linked AS death_verified, CAST(heirs AS INT) AS heirs, CAST(shots + (SELECT count(*) FROM d WHERE d.k = r.k) + CASE WHEN heirs > 0 AND died THEN 1 ELSE 0 END + muts + (SELECT count(*) FROM x WHERE x.k = r.k) AS INT) AS events, CAST(s.n AS INT) AS issues FROM r JOIN f USING (k) JOIN s USING (k)")
def sx_register_reports(spark: SparkSession, d: str) -> DataFrame:
    rows = bundle.report_rows(bundle.validate(cases(spark, d), told=SAID))
    return rows.select("case_id", "risk_score", "risk_level", "outcome", "event_type", "death_verified", "heirs", "events", F.size("issues").alias("issues"))


# What the office asks of the reports

_LEVEL = "CASE WHEN risk >= 70 THEN 'critical' WHEN risk >= 40 THEN 'high' WHEN risk >= 15 THEN 'medium' ELSE 'low' END"
_OUTCOME = "CASE worst WHEN 4 THEN 'inconsistent' WHEN 3 THEN 'review_required' WHEN 2 THEN 'incomplete' ELSE 'validated' END"
_KIND = "CASE WHEN shots = 0 AND muts = 0 THEN 'insufficient_documents' WHEN NOT changed THEN 'no_transition_detected' WHEN linked THEN 'owner_death_succession' ELSE 'ownership_transition' END"
_REPORTS = f"{_CHECKS}, r AS ({_RISK}), reports AS (SELECT k, CAST(k AS VARCHAR) AS case_id, risk, {_LEVEL} AS risk_level, {_OUTCOME} AS outcome, {_KIND} AS kind, linked, heirs FROM r JOIN f USING (k))"
_DOMAIN = "(VALUES (0, 'not_applicable'), (1, 'pass'), (2, 'warning'), (3, 'review_required'), (4, 'fail')) v(ord, status)"
_POINTS_OF = f"round(CASE rule_code {_POINTS} ELSE 20 END * CASE status WHEN 'fail' THEN CAST(1 AS DOUBLE) WHEN 'review_required' THEN CAST(0.85 AS DOUBLE) WHEN 'warning' THEN CAST(0.45 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 2)"


def reports(spark: SparkSession, d: str, *columns: str, told: tuple[str, ...] = ("rule", "rule_code", "status", "match_score")) -> DataFrame:
    """These columns of the cases' reports."""
    return bundle.validate(cases(spark, d), columns=("case_id", *columns), told=told)


@query("sx17_outcomes", f"WITH {_REPORTS} SELECT case_id, outcome, risk_level, risk AS risk_score FROM reports")
def sx17(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d, "outcome", "risk_level", "risk_score").select("case_id", "outcome", "risk_level", "risk_score")


@query("sx18_actions", f"WITH {_REPORTS} SELECT case_id, CASE outcome WHEN 'validated' THEN 'accept_record' WHEN 'incomplete' THEN 'obtain_additional_documents' WHEN 'review_required' THEN 'human_review' ELSE 'refer_to_revenue_authority' END AS recommended_action FROM reports")
def sx18(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d, "recommended_action").select("case_id", "recommended_action")


@query("ag12_case_summary", f"WITH {_REPORTS} SELECT count(*) AS total, count(CASE WHEN outcome <> 'validated' THEN 1 END) AS open, count(CASE WHEN linked THEN 1 END) AS deaths, round(CAST(sum(CAST(round(risk * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*), 2) AS avg_risk FROM reports")
def ag12(spark: SparkSession, d: str) -> DataFrame:
    return bundle.summary(reports(spark, d, "outcome", "death_verified", "risk_score"))


@query("ag20_check_status_counts", f"WITH {_CHECKS} SELECT CAST(v.ord AS INT) AS ord, v.status, count(c.k) AS n FROM {_DOMAIN} LEFT JOIN checks c ON c.status = v.status GROUP BY 1, 2")
def ag20(spark: SparkSession, d: str) -> DataFrame:
    return bundle.status_counts(reports(spark, d, "checks", told=("status",)))


@query("fl8_case_filters", f"WITH {_REPORTS} SELECT case_id, risk AS risk_score FROM reports WHERE outcome <> 'validated' AND risk >= 60 AND risk_level = 'critical'")
def fl8(spark: SparkSession, d: str) -> DataFrame:
    r = reports(spark, d, "outcome", "risk_level", "risk_score")
    return r.filter(bundle.case_filter(r.columns, open_only=True, min_risk=60, risk_level="critical")).select("case_id", "risk_score")


@query("rd5_case_list", f"WITH {_REPORTS} SELECT case_id, risk AS risk_score FROM reports ORDER BY risk DESC, case_id LIMIT 50 OFFSET 100")
def rd5(spark: SparkSession, d: str) -> DataFrame:
    return reads.page(reports(spark, d, "risk_score"), "risk_score", limit=50, offset=100, tie="case_id").select("case_id", "risk_score")


@query("rd8_cases_of_a_parcel", f"WITH {_REPORTS} SELECT case_id, outcome FROM reports WHERE k % 50 = 7")
def rd8(spark: SparkSession, d: str) -> DataFrame:
    own = (F.col("case_id").cast("long") % 50).cast("string")
    own_cases = cases(spark, d).withColumn("parcel_key", own).filter("parcel_key = '7'")
    return bundle.validate(own_cases, columns=("case_id", "outcome")).select("case_id", "outcome")


@query("rd9_explain", f"WITH {_CHECKS} SELECT CAST(k AS VARCHAR) AS case_id, rule, rule_code, status, {_POINTS_OF} AS points, count(*) AS n FROM checks WHERE status IN ('fail', 'review_required', 'warning') GROUP BY ALL")
def rd9(spark: SparkSession, d: str) -> DataFrame:
    return bundle.explained(reports(spark, d, "contributions")).groupBy("case_id", "rule", "rule_code", "status", "points").agg(F.count(F.lit(1)).alias("n"))


@query("rd15_check_order", f"WITH {_CHECKS}, p AS (SELECT k, rule, status, {_POINTS_OF} AS points FROM checks) SELECT CAST(k AS VARCHAR) AS case_id, CAST(row_number() OVER (PARTITION BY k ORDER BY CASE status WHEN 'fail' THEN 4 WHEN 'review_required' THEN 3 WHEN 'warning' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END DESC, points DESC, rule) AS INT) AS place, rule, status, points FROM p")
def rd15(spark: SparkSession, d: str) -> DataFrame:
    return bundle.sorted_checks(reports(spark, d, "checks")).select("case_id", "place", "rule", "status", "points")


@query("sx0b_heir_merge", f"WITH {_CHECKS} SELECT CAST(k AS VARCHAR) AS case_id, CAST(heirs AS INT) AS heirs FROM f")
def sx0b(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d, "heirs").select("case_id", F.size("heirs").alias("heirs"))


@query("jn11_owner_diff", f"WITH {_CHECKS} SELECT CAST(f.k AS VARCHAR) AS case_id, CAST((SELECT count(*) FROM b WHERE b.k = f.k AND shots = 2 AND b.x NOT IN (SELECT a.x FROM a WHERE a.k = f.k)) AS INT) AS departed, CAST((SELECT count(*) FROM a WHERE a.k = f.k AND a.x NOT IN (SELECT b.x FROM b WHERE b.k = f.k)) AS INT) AS arrived, CAST((SELECT count(*) FROM a WHERE a.k = f.k AND a.x IN (SELECT b.x FROM b WHERE b.k = f.k)) AS INT) AS retained FROM f WHERE shots <> 1")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    """Cases of two snapshots or none."""
    rows = bundle.prepared(cases(spark, d).filter("size(snapshots) <> 1"))
    return rows.select("case_id", F.size("__diff.gone").alias("departed"), F.size("__diff.left").alias("arrived"), F.size("__diff.kept").alias("retained"))


_NAMED = "list_extract([" + ", ".join(f"'{n}'" for n in NAMES) + "], CAST({} AS INT) + 1)"


@query("sx21_summaries", f"WITH {_REPORTS} SELECT case_id, CASE kind WHEN 'insufficient_documents' THEN 'There are too few documents to assess a transfer.' WHEN 'no_transition_detected' THEN 'The records show no change of ownership.' ELSE concat('Ownership changed.', CASE WHEN linked THEN ' A recorded owner has died.' ELSE '' END, CASE WHEN heirs > 1 THEN concat(' ', heirs, ' potential heirs are named.') WHEN heirs = 1 THEN concat(' One potential heir is named: ', {_NAMED.format('(SELECT min(h.x) FROM h WHERE h.k = reports.k)')}, '.') ELSE '' END, CASE outcome WHEN 'validated' THEN ' The documents account for the transfer.' WHEN 'inconsistent' THEN ' The documents contradict each other; the revenue authority must review them.' ELSE ' The documents do not establish the transfer; a review is required.' END) END AS summary FROM reports")
def sx21(spark: SparkSession, d: str) -> DataFrame:
    return bundle.summary_sentence(reports(spark, d, "heirs", "death_verified", "outcome", "event_type"))


# Takers in their owners' or lines' order; a case has one check of transfers that leave heirs out
_HOLDERS = f"""
ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus) AS i FROM lineitem),
tk AS (SELECT a.k, a.x, (a.x - o.c + 8) % 8 AS i FROM a JOIN o USING (k) UNION ALL SELECT l_orderkey, l_partkey % 8, i FROM ln WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT k FROM o) AND l_orderkey NOT IN (SELECT k FROM a)),
holders AS (SELECT k, string_agg({_NAMED.format('x')}, ', ' ORDER BY i) AS names FROM tk GROUP BY 1)"""
_ORDER = "CASE rule " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(dict.fromkeys(r for r, *_ in _RULES))) + " END"


@query("sx19_issue_sentences", f"""WITH {_CHECKS}, {_HOLDERS}, w AS (SELECT k, rule, status, max({_POINTS_OF}) AS points FROM checks WHERE status IN ('fail', 'review_required', 'warning') GROUP BY ALL),
s AS (SELECT w.*, part, CASE WHEN rule = 'EXCLUSIVE_TRANSFER_EVIDENCE' AND part = 0 THEN concat(heirs, ' potential heirs are named.') WHEN rule = 'EXCLUSIVE_TRANSFER_EVIDENCE' AND part = 1 THEN concat('The current record gives the land to ', coalesce(names, 'a single successor'), '.') ELSE CASE concat(rule, '|', status) {_SAID} END END AS sentence
  FROM w JOIN f USING (k) LEFT JOIN holders USING (k), (VALUES (0), (1), (2)) v(part) WHERE part = 2 OR rule = 'EXCLUSIVE_TRANSFER_EVIDENCE')
SELECT CAST(k AS VARCHAR) AS case_id, CAST(row_number() OVER (PARTITION BY k ORDER BY CASE status WHEN 'fail' THEN 0 WHEN 'review_required' THEN 1 ELSE 2 END, points DESC, {_ORDER}, part) - 1 AS INT) AS place, sentence FROM s""")
def sx19(spark: SparkSession, d: str) -> DataFrame:
    return bundle.issues(reports(spark, d, "checks", "heirs", told=SAID)).select("case_id", F.posexplode("issues").alias("place", "sentence"))


@query("sx22_checks_as_findings", f"WITH {_CHECKS} SELECT CAST(k AS VARCHAR) AS case_id, rule_code, CASE status WHEN 'fail' THEN 'error' ELSE 'warning' END AS severity, concat('$.succession.checks[', rule, ']') AS json_path, count(*) AS n FROM checks WHERE status IN ('fail', 'review_required', 'warning') GROUP BY ALL")
def sx22(spark: SparkSession, d: str) -> DataFrame:
    return bundle.as_findings(reports(spark, d, "parcel_key", "checks")).groupBy("case_id", "rule_code", "severity", "json_path").agg(F.count(F.lit(1)).alias("n"))


# Events in the order of their sources, then by their dates; deeds have none
_EVENTS = f"""
ln AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_returnflag, l_linestatus) AS i FROM lineitem),
ev AS (SELECT k, 0 AS part, 0 AS i, 'record_snapshot' AS event_type, DATE '1990-01-01' AS event_date, DATE '1990-01-01' AS anchor, NULL AS x FROM o WHERE shots > 0
  UNION ALL SELECT k, 0, 1, 'record_snapshot', DATE '2000-01-01', DATE '2000-01-01', NULL FROM o WHERE shots = 2
  UNION ALL SELECT k, 1, CASE WHEN seen = DATE '1996-06-01' THEN 1 ELSE 0 END, 'death', seen, seen, x FROM d
  UNION ALL SELECT f.k, 2, 0, 'succession_claim', NULL, CASE WHEN f.k % 4 <> 3 THEN DATE '1995-06-01' END, CASE WHEN f.k % 4 = 2 THEN (c + 5) % 8 ELSE c END FROM f WHERE died AND heirs > 0
  UNION ALL SELECT l_orderkey, 3, i, CASE l_suppkey % 3 WHEN 0 THEN 'relinquishment' WHEN 1 THEN 'other' ELSE 'court_order' END, NULL, NULL, NULL FROM ln WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT k FROM o)
  UNION ALL SELECT l_orderkey, 4, i, 'mutation', CASE WHEN l_partkey % 7 <> 0 THEN DATE '1994-01-01' + CAST(l_partkey % 1500 AS INT) END, CASE WHEN l_partkey % 7 <> 0 THEN DATE '1994-01-01' + CAST(l_partkey % 1500 AS INT) END, NULL FROM ln WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT k FROM o)),
events_ AS (SELECT CAST(k AS VARCHAR) AS case_id, k, CAST(row_number() OVER (PARTITION BY k ORDER BY coalesce(anchor, DATE '9999-12-31'), part, i) - 1 AS INT) AS sequence, event_type, CAST(event_date AS VARCHAR) AS event_date, event_date IS NOT NULL AS stated, {_NAMED.format('x')} AS person FROM ev)"""


@query("sx16_timeline", f"WITH {_CHECKS}, {_EVENTS} SELECT case_id, sequence, event_type, event_date, stated, person FROM events_")
def sx16(spark: SparkSession, d: str) -> DataFrame:
    return bundle.ownership_events(reports(spark, d, "parcel_key", "timeline")).select("case_id", "sequence", "event_type", F.col("event_date").cast("string").alias("event_date"), "stated", "person")


@query("rd6_history", f"WITH {_CHECKS}, {_EVENTS} SELECT case_id, sequence, event_type, event_date FROM events_ WHERE k % 50 = 7 ORDER BY event_date NULLS LAST, sequence, case_id LIMIT 200")
def rd6(spark: SparkSession, d: str) -> DataFrame:
    own = (F.col("case_id").cast("long") % 50).cast("string")
    own_cases = cases(spark, d).withColumn("parcel_key", own).filter("parcel_key = '7'")
    events = bundle.ownership_events(bundle.validate(own_cases, columns=("case_id", "parcel_key", "timeline")))
    return bundle.history(events, "7").select("case_id", "sequence", "event_type", F.col("event_date").cast("string").alias("event_date"))


_BUNDLE = """concat('{', CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN concat('"case_id":"', o_orderkey % 7, '",') ELSE concat('"case_id":"', o_orderkey, '","parcel_key":"p', o_orderkey % 5, '",') END, '"documents":[{"document_type":"RoR","as_of":"01/04/2015","land":{"khasra":" ', o_orderkey % 100, ' ","area":"', o_orderkey % 50, '","area_unit":"', CASE o_orderkey % 3 WHEN 0 THEN 'Hectare' WHEN 1 THEN 'are' ELSE 'bigha' END, '"},"owners":[{"name":"Owner ', o_custkey, '","share":"1/', 1 + o_orderkey % 4, '"},"Second"]},
{"document_type":"new-jamabandi","revenue_year":"2019-20","owners":["Heir"]},{"document_type":"Death Certificate","deceased":"Owner ', o_custkey, '","date_of_death":"5 March 2020"},{"document_type":"Death Certificate","date_of_death":"5 March 2020"},
{"document_type":"ferfar","number":"M', o_orderkey, '","status":"manjur","type":"varsa","order_date":"2021-02-01","entry_date":"', CASE WHEN o_orderkey % 2 = 0 THEN '01/01/2021' ELSE '01/03/2021' END, '","previous_owner":"Owner ', o_custkey, '","new_owners":["Heir",{"name":"  "}]},
{"document_type":"legal heir","deceased":"Owner ', o_custkey, '","heirs":[{"name":"Heir","share":"0.5"},{"share":"1/2"}]},{"document_type":"tax bill","date":"junk","label":"T"},"text"]}')"""


# A third of the bundles has no case id, a third shares seven ids


@query("sx24_document_readers", "SELECT CASE o_orderkey % 3 WHEN 0 THEN 'case' WHEN 1 THEN CAST(o_orderkey % 7 AS VARCHAR) ELSE CAST(o_orderkey AS VARCHAR) END AS case_id, CASE WHEN o_orderkey % 3 = 2 THEN concat('p', o_orderkey % 5) END AS parcel_key, 2 AS snapshots, CAST(o_orderkey % 100 AS VARCHAR) AS khasra, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 50 * CAST(10000 AS DOUBLE) WHEN 1 THEN o_orderkey % 50 * CAST(100 AS DOUBLE) END AS area, concat('Owner ', o_custkey, ', Second') AS owners, 1 + o_orderkey % 4 AS den, '2019-01-01' AS inferred, 1 AS deaths, '2020-03-05' AS died, concat('M', o_orderkey, ' inheritance sanctioned') AS mutation, CASE WHEN o_orderkey % 2 = 0 THEN '2021-01-01' END AS entry_date, 1 AS new_owners, 1 AS heirs, CAST(2 AS BIGINT) AS heir_den, 'other T' AS supporting, CAST(4 + o_orderkey % 2 + CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS INT) AS warnings FROM orders")
def sx24(spark: SparkSession, d: str) -> DataFrame:
    c = readers.normalize_cases(table(spark, d, "orders").select(F.expr(_BUNDLE).alias("json")))
    s, m, x = F.get("snapshots", F.lit(0)), F.get("mutations", F.lit(0)), F.get("documents", F.lit(0))
    return c.select(
        "case_id", "parcel_key", F.size("snapshots").alias("snapshots"), s["parcel"]["khasra_number"].alias("khasra"), s["parcel"]["area"].alias("area"), F.array_join(F.transform(s["owners"], lambda o: o["name"]), ", ").alias("owners"), F.get(s["owners"], F.lit(0))["share"]["den"].alias("den"),
        F.get("snapshots", F.lit(1))["as_of"].cast("string").alias("inferred"), F.size("deaths").alias("deaths"), F.get("deaths", F.lit(0))["date_of_death"].cast("string").alias("died"), F.concat_ws(" ", m["number"], m["mutation_type"], m["status"]).alias("mutation"), m["entry_date"].cast("string").alias("entry_date"),
        F.size(m["new_owners"]).alias("new_owners"), F.size("heirs").alias("heirs"), F.get("heirs", F.lit(0))["share"]["den"].alias("heir_den"), F.concat_ws(" ", x["document_type"], x["label"]).alias("supporting"), F.size("warnings").alias("warnings"),
    )
