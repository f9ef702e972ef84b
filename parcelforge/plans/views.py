"""Register views over the driver's tables, in Spark and in SQL.

``parcels`` is orders with customer, nation and region; ``sub_divisions`` and
``mutations`` are lineitem; ``review_events`` is events.  Every value is a function of
the row, never of the clock: AS_OF and EVENTS_AS_OF stand for "now".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF, EVENTS_AS_OF = "2001-08-02 00:00:00", "2024-01-31 00:00:00"

#: Columns of ``parcels`` as (name, Spark SQL, DuckDB SQL); one text where both agree.
_PARCELS: tuple[tuple[str, str, str | None], ...] = (
    ("id", "o_orderkey", None),
    ("document_id", "o_custkey", None),
    ("state", "r_name", None),
    ("district", "CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE n_name END", None),
    ("village", "c_mktsegment", None),
    ("khata_number", "CAST(o_custkey % 500 AS STRING)", "CAST(o_custkey % 500 AS VARCHAR)"),
    ("survey_number", "concat(CAST(o_orderkey % 1000 AS STRING), '/', CAST(o_orderkey % 7 AS STRING))", "concat(CAST(o_orderkey % 1000 AS VARCHAR), '/', CAST(o_orderkey % 7 AS VARCHAR))"),
    ("area", "CAST(o_totalprice AS DECIMAL(18,4))", None),
    ("confidence", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey * 37 % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END", None),
    ("mismatch", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey * 53 % 101 AS DOUBLE) END", None),
    ("review_status", "CASE WHEN o_orderkey % 10 = 3 THEN 'escalated' WHEN o_orderkey % 10 = 7 THEN 'rejected' WHEN o_orderstatus = 'F' THEN 'approved' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'in_review' END", None),
    ("priority", "CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE 'normal' END", None),
    ("severity", "CASE o_orderkey % 5 WHEN 1 THEN 'info' WHEN 2 THEN 'warning' WHEN 3 THEN 'error' WHEN 4 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'critical' ELSE NULL END ELSE NULL END", None),
    ("action", "CASE o_orderkey % 6 WHEN 0 THEN 'auto_approve' WHEN 1 THEN 'auto_approve' WHEN 2 THEN 'review_queue' WHEN 3 THEN 'field_verification' WHEN 4 THEN 'reject_re_scan' ELSE NULL END", None),
    ("assigned_to", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('officer', CAST(o_orderkey % 8 AS STRING)) END", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('officer', CAST(o_orderkey % 8 AS VARCHAR)) END"),
    ("issue_count", "CAST(o_orderkey % 7 AS INT)", None),
    ("correction_count", "CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 3 ELSE 0 END AS INT)", None),
    ("has_geometry", "o_orderkey % 6 <> 0", None),
    ("created_at", "o_orderdate", None),
    ("sla_due_at", "o_orderdate + make_interval(0, 0, 0, 0, CASE o_orderpriority WHEN '1-URGENT' THEN 24 WHEN '2-HIGH' THEN 72 WHEN '5-LOW' THEN 336 ELSE 168 END)", "o_orderdate + to_hours(CASE o_orderpriority WHEN '1-URGENT' THEN 24 WHEN '2-HIGH' THEN 72 WHEN '5-LOW' THEN 336 ELSE 168 END)"),
    ("decided_at", "CASE WHEN o_orderkey % 10 = 7 OR (o_orderkey % 10 <> 3 AND o_orderstatus = 'F') THEN o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 10 AS INT)) END", "CASE WHEN o_orderkey % 10 = 7 OR (o_orderkey % 10 <> 3 AND o_orderstatus = 'F') THEN o_orderdate + to_days(CAST(o_orderkey % 10 AS INT)) END"),
)

PARCELS = "parcels AS (SELECT " + ", ".join(f"{duck or spark} AS {name}" for name, spark, duck in _PARCELS) + " FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"

_SUBS: tuple[tuple[str, str], ...] = (
    ("parcel_id", "l_orderkey"),
    ("number", "l_linenumber"),
    ("part", "l_partkey"),
    ("supplier", "l_suppkey"),
    ("area", "CAST(l_extendedprice AS DECIMAL(18,4))"),
    ("assessment", "l_quantity"),
    ("rate", "l_extendedprice / l_quantity"),
    ("entry_date", "CAST(l_shipdate AS DATE)"),
    ("status", "CASE l_linestatus WHEN 'O' THEN 'pending' ELSE 'sanctioned' END"),
    ("kind", "CASE l_returnflag WHEN 'R' THEN 'correction' WHEN 'A' THEN 'succession' ELSE 'sale' END"),
)
SUBS = "sub_divisions AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in _SUBS) + " FROM lineitem)"

_EVENTS: tuple[tuple[str, str, str | None], ...] = (
    ("id", "event_id", None),
    ("parcel_id", "event_id % 15000", None),
    ("reviewer", "concat('user', CAST(user_id AS STRING))", "concat('user', CAST(user_id AS VARCHAR))"),
    ("reviewer_role", "CASE user_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'operator' WHEN 2 THEN 'reviewer' ELSE NULL END", None),
    ("action", "CASE event_type WHEN 'click' THEN 'corrected' WHEN 'purchase' THEN 'status_changed' WHEN 'signup' THEN 'assigned' WHEN 'error' THEN 'flagged' ELSE 'note_added' END", None),
    ("created_at", "ts", None),
    ("value", "value", None),
    ("props", "props", None),
    ("k", "CAST(get_json_object(props, '$.k') AS INT)", "CAST(json_extract(props, '$.k') AS INT)"),
)
EVENTS = "review_events AS (SELECT " + ", ".join(f"{duck or spark} AS {name}" for name, spark, duck in _EVENTS) + " FROM events)"

DUE_TEXT = "'%Y-%m-%d %H:%M:%S'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension joins are left to adaptive execution: sizes decide whether they broadcast."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.selectExpr(*(f"{sql} AS {name}" for name, sql, _ in _PARCELS))


def sub_divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*(f"{sql} AS {name}" for name, sql in _SUBS))


def review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*(f"{sql} AS {name}" for name, sql, _ in _EVENTS))


def time_text(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def as_of(text: str = AS_OF) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")
