"""Dashboard aggregates: one pass of conditional sums each, zero-filled over closed vocabularies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..enums import MINUTES_SAVED, PRIORITIES, SEVERITIES
from ..session import shared_folder
from .geo import bounds
from .reads import is_open, is_overdue, traffic_light
from .shapes import of_ring

#: Bins of one round of a selection.
BINS = 4096


def mean(value: Column | str, places: int) -> Column:
    """Average of the non-null values, rounded; sums are exact for decimals."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double")), places)


def count_if(condition: Column) -> Column:
    """Rows for which the condition is true, 0 for none."""
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def summary(parcels: DataFrame, now: Column, minutes: float = MINUTES_SAVED) -> DataFrame:
    """One row of dashboard figures: sums by district and village, which are then counted, and the exact median."""
    light = traffic_light()
    confidence, mismatch = F.col("confidence").cast("decimal(10,3)"), F.col("mismatch").cast("decimal(10,3)")
    counts = {
        "total_parcels": F.count(F.lit(1)),
        "auto_validated": count_if(light == "green"),
        "flagged": count_if(light == "red"),
        "overdue_count": count_if(is_overdue(now)),
        "unassigned_count": count_if(F.col("assigned_to").isNull() & (F.col("review_status") == "pending")),
        "corrections_applied": count_if(F.col("correction_count") > 0),
    }
    sums = {"c": F.sum(confidence), "c_n": F.count(confidence), "m": F.sum(mismatch), "m_n": F.count(mismatch), "area_sum": F.sum("area")}
    places = parcels.groupBy("district", "village").agg(*(x.alias(n) for n, x in (counts | sums).items()))
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n)
    ratio = lambda a, b, digits: F.round(F.try_divide(F.sum(a).cast("double"), F.sum(b).cast("double")), digits)
    first = places.agg(
        *(total(n) for n in ("total_parcels", "auto_validated", "flagged")),
        ratio("c", "c_n", 4).alias("avg_confidence"),
        ratio("m", "m_n", 2).alias("avg_mismatch"),
        F.round(F.coalesce(F.sum("area_sum"), F.lit(0)).cast("double") / 10_000, 3).alias("total_area_hectares"),
        F.countDistinct("district").alias("districts_covered"),
        F.countDistinct("village").alias("villages_covered"),
        *(total(n) for n in ("overdue_count", "unassigned_count", "corrections_applied")),
    )
    whole = medians(parcels.select(F.lit(0).alias("__all"), "confidence"), "__all", "confidence")
    first = first.join(whole.select("median_confidence"), F.lit(True), "left")  # one row each
    green, all_ = F.col("auto_validated"), F.col("total_parcels")
    return first.withColumns({
        "needs_review": F.greatest(all_ - green - F.col("flagged"), F.lit(0)),
        "straight_through_rate": F.when(all_ > 0, F.round(green / all_ * 100, 1)).otherwise(0.0),
        "staff_hours_saved": F.round(green * F.lit(minutes) / 60, 1),
    })


def zero_filled(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """``column, n`` for every value of a closed vocabulary."""
    domain_rows = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(domain)], f"ord int, {column} string")
    counts = df.groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("n"))
    return domain_rows.join(counts, F.col(column) == F.col("__v"), "left").select("ord", column, F.coalesce("n", F.lit(0)).alias("n"))


def districts(parcels: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """Rollup by state and district, largest first (ties by name)."""
    late = F.col("sla_due_at").isNotNull() & (F.col("sla_due_at") < now) & ~F.col("review_status").isin("approved", "rejected")
    out = parcels.groupBy("state", "district").agg(
        F.count(F.lit(1)).alias("total"),
        count_if(F.col("severity").isin("error", "critical") | (F.col("mismatch") >= 50)).alias("flagged"),
        count_if(F.col("review_status") == "approved").alias("approved"),
        count_if(F.col("review_status") == "pending").alias("pending"),
        count_if(late).alias("overdue"),
        mean(F.col("confidence").cast("decimal(10,3)"), 4).alias("avg_confidence"),
        mean(F.col("mismatch").cast("decimal(10,3)"), 2).alias("avg_mismatch"),
        F.round(F.coalesce(F.sum("area"), F.lit(0)).cast("double") / 10_000, 3).alias("total_area_hectares"),
    )
    out = out.withColumn("completion_rate", F.round(F.col("approved") / F.col("total") * 100, 1))
    return out.orderBy(F.col("total").desc(), F.col("state").asc_nulls_first(), F.col("district").asc_nulls_first()).limit(limit)


def daily(days: DataFrame, **series: tuple[DataFrame, str]) -> DataFrame:
    """Dense daily counts: ``days`` has one ``day`` a row; each series is (rows, time column)."""
    out = days
    for name, (rows, column) in series.items():
        counts = rows.filter(F.col(column).isNotNull()).groupBy(F.to_date(column).alias(f"__{name}")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(counts, F.col("day") == F.col(f"__{name}"), "left").drop(f"__{name}").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def calendar(spark: SparkSession, last: str, days: int) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(F.to_date(F.lit(last)), days - 1), F.to_date(F.lit(last)))).alias("day"))


def rule_frequency(issues: DataFrame, limit: int = 12) -> DataFrame:
    """``rule_code, n, worst_severity`` and counts per severity of ``rule_code, severity`` rows, most frequent first."""
    ranks = F.create_map(*(x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))))
    per = issues.filter("rule_code is not null").groupBy("rule_code", F.coalesce("severity", F.lit("info")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy("rule_code").agg(F.sum("n").alias("n"), F.max_by("severity", F.coalesce(ranks[F.col("severity")], F.lit(0))).alias("worst_severity"), *(F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}") for s in SEVERITIES))
    return out.orderBy(F.col("n").desc(), "rule_code").limit(limit)


def throughput(events: DataFrame, since: Column) -> DataFrame:
    """Activity by reviewer and role since a moment."""
    return events.filter(F.col("created_at") >= since).groupBy("reviewer", "reviewer_role").agg(
        F.count(F.lit(1)).alias("events"),
        count_if(F.col("action") == "corrected").alias("corrections"),
        count_if(F.col("action") == "status_changed").alias("decisions"),
        F.max("created_at").alias("last_active"),
    )


def queue_health(parcels: DataFrame, now: Column) -> DataFrame:
    """Open and overdue by priority (zero-filled, worst first), with totals and the oldest open record on each row."""
    rows = parcels.filter(is_open()).groupBy(F.col("priority").alias("__p")).agg(F.count(F.lit(1)).alias("open"), count_if(F.col("sla_due_at").isNotNull() & (F.col("sla_due_at") < now)).alias("overdue"), F.min("created_at").alias("oldest"))
    domain = parcels.sparkSession.createDataFrame([(len(PRIORITIES) - 1 - i, p) for i, p in enumerate(PRIORITIES)], "rank int, priority string")
    out = domain.join(rows, F.col("priority") == F.col("__p"), "left").select("rank", "priority", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("overdue", F.lit(0)).alias("overdue"), "oldest")
    everything = Window.partitionBy()  # four rows
    return out.withColumns({"total_open": F.sum("open").over(everything), "total_overdue": F.sum("overdue").over(everything), "oldest_open_at": F.min("oldest").over(everything)}).drop("oldest")


def outliers(rows: DataFrame, group: str, rate: str, threshold: float = 2.5, least: int = 3) -> DataFrame:
    """Rows whose rate lies ``threshold`` population deviations from its group's mean; groups of ``least`` at least."""
    w = Window.partitionBy(group)
    rows = rows.filter(F.col(rate).isNotNull()).withColumns({"siblings": F.count(rate).over(w), "mean": F.avg(rate).over(w), "deviation": F.stddev_pop(rate).over(w)})
    rows = rows.filter((F.col("siblings") >= least) & (F.col("deviation") > 1e-9 * F.abs(F.col("mean"))))
    return rows.withColumn("z", (F.col(rate) - F.col("mean")) / F.col("deviation")).filter(F.abs("z") >= threshold)


def weighted_mean(value: str, weight: Column) -> Column:
    """Sum of value times weight over the weights' sum; decimals are summed exactly."""
    return F.try_divide(F.sum(F.col(value) * weight).cast("double"), F.sum(weight).cast("double"))


def _selected(counts: DataFrame, key: str, value: str) -> DataFrame:
    """``__key, __lo, __hi``: both middle values of each key of ``key, value, __n``, by ever narrower histograms.

    Each round cuts the range that holds a wanted rank into BINS bins, whose counts are summed with map-side
    combine, and keeps the bin of the rank; a key needs BINS rows in a task, whatever its values. The range shrinks
    by BINS a round at least, or ends at one value, so a few rounds do for numbers of 64 bits.
    """
    c = counts.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), F.col("__n").alias("n"))
    total = c.groupBy("k").agg(F.sum("n").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
    ranks = F.array(F.struct(F.lit(0).alias("w"), F.floor((F.col("n") - 1) / 2).alias("r")), F.struct(F.lit(1).alias("w"), F.floor(F.col("n") / 2).alias("r")))
    wanted = total.select(F.col("k").alias("x_k"), F.explode(ranks).alias("x"), "a", "z").select("x_k", "x.w", "x.r", "a", "z").checkpoint()
    order = Window.partitionBy("x_k", "w").orderBy("bin")
    while not wanted.filter("a < z").isEmpty():
        open_ = wanted.filter("a < z")
        rows = c.join(open_, F.col("k").eqNullSafe(F.col("x_k")) & F.col("v").between(F.col("a"), F.col("z")))
        half = F.col("z") / 2 - F.col("a") / 2  # does not overflow
        at = F.floor((F.col("v") / 2 - F.col("a") / 2) / half * BINS)
        at = F.when(half > 0, F.least(at, F.lit(BINS - 1))).otherwise(F.when(F.col("v") > F.col("a"), 1).otherwise(0))  # neighbours
        bins = rows.groupBy("x_k", "w", "r", at.cast("int").alias("bin")).agg(F.sum("n").alias("n"), F.min("v").alias("a"), F.max("v").alias("z"))
        bins = bins.withColumn("before", F.sum("n").over(order) - F.col("n")).filter((F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("n")))
        wanted = wanted.filter("a = z").unionByName(bins.select("x_k", "w", (F.col("r") - F.col("before")).alias("r"), "a", "z")).checkpoint()
    return wanted.groupBy(F.col("x_k").alias("__key")).agg(F.min("a").alias("__lo"), F.max("a").alias("__hi"))


def medians(rows: DataFrame, key: str, value: str, places: int = 4, most: int = 1_000_000) -> DataFrame:
    """``key, median_<value>``, exact at any size.

    Equal values of a key are counted first, with map-side combine. Up to ``most`` different values of all keys together are sorted as
    they are, more by selection over histograms, so that no group is gathered in one task.
    """
    counts = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    if counts.count() <= most:
        return counts.groupBy(key).agg(F.round(F.percentile(value, F.lit(0.5), F.col("__n")), places).alias(f"median_{value}"))
    shared_folder(rows.sparkSession)
    counts = counts.checkpoint()
    mid = _selected(counts.filter(F.col(value).isNotNull()), key, value).select("__key", ((F.col("__lo") + F.col("__hi")) / 2).alias("__m"))
    return counts.select(key).distinct().join(mid, F.col(key).eqNullSafe(F.col("__key")), "left").select(key, F.round("__m", places).alias(f"median_{value}"))


def reference_numbers(rows: DataFrame, prefix: str, form: str = "CASE/2001/%04d") -> DataFrame:
    """``prefix, reference``: the next number of each series, one above those in use."""
    return rows.groupBy(F.col(prefix).alias("prefix")).agg(F.format_string(form, F.count(F.lit(1)) + 1).alias("reference"))


def area_sums(parts: DataFrame, key: str, area: str, cultivable: Column) -> DataFrame:
    """``key, total, cultivable, other``: exact sums of parts, 0 where there are none of a kind."""
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col(area))), F.lit(0)).cast("double")
    return parts.groupBy(key).agg(F.sum(area).cast("double").alias("total"), of(cultivable).alias("cultivable"), of(~cultivable).alias("other"))


def document_means(parcels: DataFrame) -> DataFrame:
    """``document_id, confidence, area``: mean confidence of a document's records and their area."""
    exact = F.col("confidence").cast("decimal(10,3)")
    return parcels.groupBy("document_id").agg(F.try_divide(F.sum(exact).cast("double"), F.count(exact).cast("double")).alias("confidence"), F.sum("area").cast("double").alias("area"))


def token_usage(calls: DataFrame, key: str) -> DataFrame:
    """``key, characters, cached, hit_ratio`` of calls with ``used`` and ``cached`` sizes."""
    used, cached = F.sum("used"), F.sum("cached")
    return calls.groupBy(key).agg(used.alias("characters"), cached.alias("cached"), F.round(F.try_divide(cached, used), 6).alias("hit_ratio"))


def set_counts(rows: DataFrame, key: str, value: Column, left: Column) -> DataFrame:
    """``key, n_union, n_shared, n_only``: distinct values of the left rows against the others'; counted per (key, value) first, so no set is gathered."""
    sides = rows.groupBy(key, value.alias("__v")).agg(F.max(F.when(left, 1).otherwise(0)).alias("a"), F.max(F.when(left, 0).otherwise(1)).alias("b"))
    return sides.groupBy(key).agg(F.count("__v").alias("n_union"), count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("n_shared"), count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("n_only"))


def map_bounds(shapes: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """``key, west, east, south, north`` over all corners of the rings; each ring is reduced where it is read."""
    box = bounds(of_ring(F.col(ring)))
    rows = shapes.filter(F.col(ring).isNotNull()).select(key, box.alias("b"))
    return rows.groupBy(key).agg(F.min("b.west").alias("west"), F.max("b.east").alias("east"), F.min("b.south").alias("south"), F.max("b.north").alias("north"))
