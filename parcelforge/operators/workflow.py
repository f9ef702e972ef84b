"""Adjudication workflow as batch operators over tables: requests in, updated rows, rejects and audit rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..enums import ROLES, STATUSES, TERMINAL_STATUSES, TRANSITIONS


def allowed_pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a in STATUSES for b in TRANSITIONS[a]], "from_status string, to_status string")


def outranks(role: Column, needed: str) -> Column:
    rank = F.array_position(F.array(*(F.lit(r) for r in ROLES)), role)
    return F.coalesce(rank >= ROLES.index(needed) + 1, F.lit(False)) & role.isNotNull()


def transition(requests: DataFrame, parcels: DataFrame, now: Column) -> DataFrame:
    """Every request ``parcel_id, target, actor, role`` with its outcome and the parcel's new state.

    ``reason`` is null for accepted requests.  A terminal target sets the decision,
    in_review claims an unassigned record and clears the decision.
    """
    own = parcels.select(F.col("id").alias("p_id"), F.col("review_status").alias("was"), F.col("assigned_to").alias("had"), F.col("decided_at").alias("decided"))
    rows = requests.join(own, F.col("parcel_id") == F.col("p_id"), "left")
    legal = None
    for a in STATUSES:
        ok = (F.col("was") == a) & F.col("target").isin(*TRANSITIONS[a])
        legal = ok if legal is None else legal | ok
    reason = (
        F.when(F.col("p_id").isNull(), "not found")
        .when(F.col("was") == F.col("target"), "already there")
        .when(~F.coalesce(legal, F.lit(False)), "not allowed")
        .when(F.col("was").isin(*TERMINAL_STATUSES) & ~outranks(F.col("role"), "reviewer"), "needs a reviewer")
    )
    done = F.col("reason").isNull()
    final, review = F.col("target").isin(*TERMINAL_STATUSES), F.col("target") == "in_review"
    return rows.withColumn("reason", reason).select(
        "parcel_id", "was", "target", "actor", "reason",
        F.when(done, F.col("target")).otherwise(F.col("was")).alias("review_status"),
        F.when(done & review, F.coalesce("had", "actor")).otherwise(F.col("had")).alias("assigned_to"),
        F.when(done & final, F.col("actor")).alias("decided_by"),
        F.when(done & final, now).when(done & review, None).otherwise(F.col("decided")).alias("decided_at"),
    )


def assign(requests: DataFrame, parcels: DataFrame) -> DataFrame:
    """Apply ``parcel_id, assignee`` (null releases); a pending record that gets an assignee goes into review."""
    wanted = requests.select(F.col("parcel_id").alias("p_id"), "assignee")
    rows = parcels.join(wanted, F.col("id") == F.col("p_id"))
    claimed = F.col("assignee").isNotNull() & (F.col("review_status") == "pending")
    return rows.select("id", F.col("assignee").alias("assigned_to"), F.when(claimed, "in_review").otherwise(F.col("review_status")).alias("review_status"))


def audit_rows(outcomes: DataFrame, action: str, now: Column) -> DataFrame:
    """Audit rows of accepted outcomes; previous and new values are wrapped."""
    wrap = lambda c: F.to_json(F.struct(F.col(c).alias("value")))
    return outcomes.filter("reason is null").select("parcel_id", F.lit("$.review_status").alias("field_path"), wrap("was").alias("previous_value"), wrap("target").alias("new_value"), F.lit(action).alias("action"), F.col("actor").alias("reviewer"), now.alias("created_at"))


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """The last correction of each field of each parcel: ``parcel_id, field_path, value``."""
    return corrections.groupBy("parcel_id", "field_path").agg(F.max_by("value", F.struct("created_at", "id")).alias("value"), F.count(F.lit(1)).alias("corrections"))


def corrected(parcels: DataFrame, corrections: DataFrame, paths: dict[str, str], rules: Column) -> DataFrame:
    """Parcels with their latest corrections written, ``correction_count`` raised by all of them, and ``issue_count`` of the rules run again on the new values.

    ``paths`` maps field paths to columns; values are texts, cast to the column's type (null if they do not fit). ``rules`` counts findings of a row.
    """
    last = latest_corrections(corrections)
    per = last.groupBy(F.col("parcel_id").alias("__parcel")).agg(F.sum("corrections").alias("__n"), *(F.max(F.when(F.col("field_path") == p, F.struct("value"))).alias(f"__{c}") for p, c in paths.items()))
    rows = parcels.join(per, F.col("id") == F.col("__parcel"), "left")
    for c in paths.values():
        rows = rows.withColumn(c, F.when(F.col(f"__{c}").isNotNull(), F.col(f"__{c}.value").try_cast(parcels.schema[c].dataType)).otherwise(F.col(c)))
    rows = rows.withColumn("correction_count", (F.col("correction_count") + F.coalesce("__n", F.lit(0))).cast("int"))
    return rows.withColumn("issue_count", F.when(F.col("__parcel").isNotNull(), rules).otherwise(F.col("issue_count"))).drop("__parcel", "__n", *(f"__{c}" for c in paths.values()))


def delete_cascade(documents: DataFrame, parcels: DataFrame, events: DataFrame, cases: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables without the documents ``gone`` (id): their parcels and events go, cases lose the reference."""
    ids = gone.select(F.col("id").alias("gone_id"))
    dead = parcels.join(ids, F.col("document_id") == F.col("gone_id"), "left_semi").select(F.col("id").alias("dead_id"))
    left = parcels.join(ids, F.col("document_id") == F.col("gone_id"), "left_anti")
    orphan = cases.join(dead, F.col("parcel_id") == F.col("dead_id"), "left")
    orphan = orphan.withColumn("parcel_id", F.when(F.col("dead_id").isNull(), F.col("parcel_id"))).drop("dead_id")
    return documents.join(ids, F.col("id") == F.col("gone_id"), "left_anti"), left, events.join(dead, F.col("parcel_id") == F.col("dead_id"), "left_anti"), orphan
