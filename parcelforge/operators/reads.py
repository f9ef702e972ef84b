"""Read paths of the review office: shared filters, sorts, pages, queues, facets, joins, trails.

All are plain projections, filters, joins and sorts, so pushdown, pruning and top-k come from
Catalyst.  "Now" is always an argument.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..enums import OPEN_STATUSES, PRIORITIES

SEARCHED = ("village", "district", "khata_number", "survey_number", "parcel_key", "state")
EQUAL = {"state": "state", "district": "district", "village": "village", "review_status": "review_status", "priority": "priority", "assigned_to": "assigned_to", "severity": "severity", "recommended_action": "action"}


def free_text(q: str, columns: Iterable[str]) -> Column:
    """Any of the columns contains ``q`` (trimmed, any case); its % and _ are wild."""
    return reduce(or_, (F.col(c).ilike(f"%{q.strip()}%") for c in columns))


def is_open(status: str = "review_status") -> Column:
    return F.col(status).isin(*OPEN_STATUSES)


def is_overdue(now: Column) -> Column:
    return F.col("sla_due_at").isNotNull() & (F.col("sla_due_at") < now) & is_open()


def parcel_filter(columns: Iterable[str], now: Column | None = None, *, q: str | None = None, min_mismatch: float | None = None, max_confidence: float | None = None, unassigned: bool = False, overdue: bool = False, open_only: bool = False, has_geometry: bool = False, requires_review: bool | None = None, **equal: str | None) -> Column:
    """One condition for list, queue, map and exports alike. Unset filters do not restrict; comparisons with null drop rows."""
    have, out = set(columns), []
    if q:
        out.append(free_text(q, [c for c in SEARCHED if c in have]))
    for key, value in equal.items():
        if value is not None:
            out.append(F.col(EQUAL[key]) == value)
    if requires_review is not None:
        out.append(F.col("requires_human_review") == requires_review)
    if min_mismatch is not None:
        out.append(F.col("mismatch") >= min_mismatch)
    if max_confidence is not None:
        out.append(F.col("confidence") <= max_confidence)
    if unassigned:
        out.append(F.col("assigned_to").isNull())
    if overdue:
        out.append(is_overdue(now))
    if open_only:
        out.append(is_open())
    if has_geometry:
        out.append(F.col("geometry").isNotNull() if "geometry" in have else F.col("has_geometry"))
    return reduce(and_, out, F.lit(True))


#: Columns of a record in lists.
SUMMARY = ("id", "state", "district", "village", "khata_number", "survey_number", "review_status", "priority", "mismatch", "confidence")


def summary_rows(parcels: DataFrame) -> DataFrame:
    """Records as lists show them; the other columns are pruned from the scan."""
    return parcels.select(*SUMMARY)


def page(df: DataFrame, sort: str, *, descending: bool = True, limit: int = 50, offset: int = 0, tie: str = "id") -> DataFrame:
    """A page in total order. Nulls are least, as in Spark's default."""
    key = F.col(sort).desc() if descending else F.col(sort).asc()
    return df.orderBy(key, tie).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def queue(df: DataFrame, score: str = "priority_score", *, scope: str = "all", user: str | None = None, district: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Open records, worst first; ``scope`` is mine, unassigned, district or all."""
    df = df.filter(is_open())
    if scope == "mine":
        df = df.filter(F.col("assigned_to") == user)
    elif scope == "unassigned":
        df = df.filter(F.col("assigned_to").isNull())
    elif scope == "district" and district:
        df = df.filter(F.col("district") == district)
    return df.orderBy(F.col(score).desc(), F.col("sla_due_at").asc(), "id").offset(offset).limit(limit)


def facets(df: DataFrame) -> DataFrame:
    """Counts by state, district, village; null names are Unknown, as in the tree."""
    names = [F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("state", "district", "village")]
    return df.groupBy("state", "district", "village").agg(F.count(F.lit(1)).alias("n")).select(*names, "n").groupBy("state", "district", "village").agg(F.sum("n").alias("n"))


def facet_tree(df: DataFrame) -> DataFrame:
    """One row: a map state -> district -> village -> count, built level by level."""
    flat = facets(df)
    villages = flat.groupBy("state", "district").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("village", "n")))).alias("villages"))
    districts = villages.groupBy("state").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("district", F.to_json("villages").alias("villages"))), lambda a, b: F.when(a["district"] < b["district"], -1).when(a["district"] > b["district"], 1).otherwise(0))).alias("districts"))
    return districts


def audit(events: DataFrame, parcels: DataFrame, *, reviewer: str | None = None, action: str | None = None, district: str | None = None) -> DataFrame:
    """Events with their parcel's key and place (inner join on the parcel)."""
    if reviewer:
        events = events.filter(F.col("reviewer") == reviewer)
    if action:
        events = events.filter(F.col("action") == action)
    own = parcels.select(F.col("id").alias("p_id"), "state", "district", "village", "survey_number")
    if district:
        own = own.filter(F.col("district") == district)
    return events.join(own, F.col("parcel_id") == F.col("p_id")).drop("p_id")


def with_document(parcels: DataFrame, documents: DataFrame) -> DataFrame:
    """Records with the name of their document (``id, document_name``); null without one."""
    own = documents.select(F.col("id").alias("__document"), "document_name")
    return parcels.join(own, F.col("document_id") == F.col("__document"), "left").drop("__document")


def with_event(parcels: DataFrame, events: DataFrame, action: str) -> DataFrame:
    """Records that have an event of this kind, once each."""
    return parcels.join(events.filter(F.col("action") == action).select(F.col("parcel_id").alias("__parcel")), F.col("id") == F.col("__parcel"), "left_semi")


def with_geometry(parcels: DataFrame, shapes: DataFrame, key: str = "id") -> DataFrame:
    """Records with the columns of their shape (``key`` and others) and ``missing``; a miss is a valid outcome."""
    own = shapes.withColumnRenamed(key, "__shape")
    return parcels.join(own, F.col(key) == F.col("__shape"), "left").withColumn("missing", F.col("__shape").isNull()).drop("__shape")


def without(rows: DataFrame, known: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Rows that refer to nothing known: ``keys`` maps columns of ``rows`` to columns of ``known``."""
    own = known.select(*(F.col(b).alias(f"__{b}") for b in keys.values())).distinct()
    return rows.join(own, reduce(and_, (F.col(a) == F.col(f"__{b}") for a, b in keys.items())), "left_anti")


def newest_first(events: DataFrame, limit: int = 200, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The last events; a top-k, not a sort of the table."""
    return events.orderBy(F.col(time).desc(), tie).limit(limit)


def numbered(rows: DataFrame, key: str, order: Iterable[Column | str], name: str = "place", first: int = 1) -> DataFrame:
    """Rows with their place within their key: event trails, timelines, issue and snapshot orders."""
    return rows.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1 + first).cast("long"))


def followed(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Rows with the value of the next row of their key; the last of each key goes."""
    return rows.withColumn(name, F.lead(value).over(Window.partitionBy(key).orderBy(order))).filter(F.col(name).isNotNull())


def latest(rows: DataFrame, key: str, date: str, value: Column, ties: Iterable[Column | str]) -> DataFrame:
    """``key, latest, winner``: the last date of each key and the value of its row; of equal dates the first in order of ``ties`` wins."""
    return rows.groupBy(key).agg(F.max(date).alias("latest"), F.max_by(value, F.struct(date, *ties)).alias("winner"))


def in_order(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """``key, n, all, distinct``: the values of each key in order, and each once at its first place."""
    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("__rows"))
    values = F.transform("__rows", lambda x: x[value])
    return own.select(key, F.size("__rows").cast("long").alias("n"), values.alias("all"), F.array_distinct(values).alias("distinct"))


def traffic_light() -> Column:
    """red, green or yellow, as the summary counts them."""
    red = F.coalesce(F.col("action") == "reject_re_scan", F.lit(False)) | F.coalesce(F.col("severity") == "critical", F.lit(False)) | F.coalesce(F.col("mismatch") >= 50, F.lit(False))
    green = (F.col("action") == "auto_approve") & (F.col("severity").isNull() | ~F.col("severity").isin("error", "warning", "critical")) & ((F.col("mismatch") < 50) | F.col("mismatch").isNull())
    return F.when(red, "red").when(green, "green").otherwise("yellow")


def sla_pill(now: Column) -> Column:
    """none when decided or without a due time, overdue, due_soon within a day, else on_track."""
    hours = F.round((F.unix_micros(F.col("sla_due_at").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 3.6e9)
    return F.when(F.col("review_status").isin("approved", "rejected") | F.col("sla_due_at").isNull(), "none").when(hours < 0, "overdue").when(hours <= 24, "due_soon").otherwise("on_track")


def first_match(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Left rows with the first right row (least ``order``) of their key; a miss keeps nulls."""
    names = [c for c in right.columns if c != key]
    first = right.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*names), order).alias("__row"))
    return left.join(first, F.col(key) == F.col("__key"), "left").select(*left.columns, *(F.col(f"__row.{c}").alias(c) for c in names))


def priority_rank(column: str = "priority") -> Column:
    """3 for critical down to 0 for low."""
    out = None
    for i, p in enumerate(reversed(PRIORITIES)):
        out = F.when(F.col(column) == p, i) if out is None else out.when(F.col(column) == p, i)
    return out
