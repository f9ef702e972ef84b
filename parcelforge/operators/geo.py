"""Cadastral geometry: geodesic area, comparison with the stated area, confidence, topology.

Rings are ARRAY<STRUCT<lon, lat>>, shapes are polygons of rings (``shapes``).  Areas are exact on the authalic sphere of WGS84
between vertices at constant-bearing steps; against a geodesic library small
parcels differ by less than a part in a million.  Neighbours are found by an equi join on grid cells, never by a
cross join; exact overlap runs in an Arrow UDF over candidate pairs only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shapes
from .plan import settled

# WGS84, source tolerance multipliers, thresholds.
A, E2 = 6378137.0, 0.0066943799901413165
SOURCE_MULTIPLIER = {"drone_survey": 0.6, "dgps_survey": 0.6, "ets_survey": 0.8, "cadastral_shapefile": 1.0, "bhu_naksha": 1.0, "mock": 1.0, "unknown": 1.5}
SURVEY_TOLERANCE, SEVERE, FLOOR, NO_GEOMETRY_CAP = 0.005, 0.10, 0.35, 0.55
RING = "array<struct<lon:double,lat:double>>"
_E = math.sqrt(E2)
QP = (1 - E2) * (1 / (1 - E2) - math.log((1 - _E) / (1 + _E)) / (2 * _E))


def _q(lat: Column) -> Column:
    """Authalic q of a latitude in degrees."""
    s = F.sin(F.radians(lat))
    return (1 - E2) * (s / (1 - E2 * s * s) - F.log((1 - _E * s) / (1 + _E * s)) / (2 * _E))


def ring_area(ring: Column) -> Column:
    """Square metres inside a closed ring, whatever its direction."""
    n = F.size(ring)
    lon = lambda i: F.get(ring, i)["lon"]
    before = lambda i: F.when(i == 0, n - 2).otherwise(i - 1)
    # sum of dlon (q_i + q_i+1), regrouped so that each vertex' q is computed once
    step = lambda i: F.radians(lon(i + 1) - lon(before(i))) * _q(F.get(ring, i)["lat"])
    total = F.aggregate(F.sequence(F.lit(0), n - 2), F.lit(0.0), lambda s, i: s + step(i))
    return F.when(n >= 4, F.abs(total) * A * A / 4)


def ring_perimeter(ring: Column) -> Column:
    """Metres along a closed ring by local radii of curvature."""
    def step(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        s2 = F.pow(F.sin(F.radians((a["lat"] + b["lat"]) / 2)), 2)
        w = 1 - E2 * s2
        east = F.radians(b["lon"] - a["lon"]) * A / F.sqrt(w) * F.cos(F.radians((a["lat"] + b["lat"]) / 2))
        north = F.radians(b["lat"] - a["lat"]) * A * (1 - E2) / F.pow(w, 1.5)
        return F.sqrt(east * east + north * north)

    return F.when(F.size(ring) >= 2, F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(0.0), lambda s, i: s + step(i)))


def area(parts: Column) -> Column:
    """Square metres of a shape: outer rings less holes."""
    return shapes.measured(parts, ring_area)


def perimeter(parts: Column) -> Column:
    """Metres along all rings."""
    return shapes.summed(parts, ring_perimeter)


def _scale(lat: float) -> np.ndarray:
    """Metres a degree of longitude and latitude."""
    s2 = math.sin(math.radians(lat)) ** 2
    w = 1 - E2 * s2
    return math.radians(1) * A * np.array([math.cos(math.radians(lat)) / math.sqrt(w), (1 - E2) / w**1.5])


def intersection_area(p: list[tuple[float, float]], q: list[tuple[float, float]]) -> float:
    """Planar area shared by two rings."""
    return shapes.shared_area([[np.array(p, float)]], [[np.array(q, float)]])


_TOPOLOGY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("area", T.DoubleType()), T.StructField("fraction", T.DoubleType())])


@F.arrow_udf(_TOPOLOGY)
def topology(subject: pa.Array, neighbour: pa.Array) -> pa.Array:
    """overlap, sliver_gap or null of two shapes, with area and fraction of the subject, in a local projection."""
    out = []
    for r, s in zip(subject.to_pylist(), neighbour.to_pylist(), strict=True):
        p, q = shapes.points(r), shapes.points(s)
        at = np.concatenate([x for part in p for x in part]).mean(0)
        p, q = ([[(x - at) * _scale(at[1]) for x in part] for part in shape] for shape in (p, q))
        own, shared = shapes.planar_area(p), shapes.shared_area(p, q)
        kind, size = ("overlap", shared) if shared > 1e-9 else ("sliver_gap", shapes.strip_area(p, q))
        out.append({"kind": kind, "area": round(size, 4), "fraction": round(size / own, 6)} if own and size > 1e-9 else {})
    return pa.array(out, pa.struct([("kind", pa.string()), ("area", pa.float64()), ("fraction", pa.float64())]))


def bounds(parts: Column) -> Column:
    points = F.flatten(F.flatten(parts))
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("west"), F.array_max(lon).alias("east"), F.array_min(lat).alias("south"), F.array_max(lat).alias("north"))


def with_parts(parcels: DataFrame) -> DataFrame:
    """Tables of a single ``ring`` a row get it as ``parts``."""
    return parcels if "parts" in parcels.columns else parcels.withColumn("parts", shapes.of_ring(F.col("ring")))


def neighbours(parcels: DataFrame, cell: float = 0.01, margin: float = 1e-5) -> DataFrame:
    """Ordered pairs ``a, b, parts_a, parts_b`` of parcels (``parcel_key`` and ``parts`` or ``ring``) whose boxes touch.

    Each box is put into the grid cells it covers; a pair is taken in one cell only, that
    of the greater of both lower corners, so no distinct is needed.
    """
    rows = with_parts(parcels).select("parcel_key", "parts", bounds(F.col("parts")).alias("box"))
    at = lambda c: F.floor(c / cell)
    rows = rows.withColumns({"x": F.explode(F.sequence(at(F.col("box.west") - margin), at(F.col("box.east") + margin)))}).withColumn("y", F.explode(F.sequence(at(F.col("box.south") - margin), at(F.col("box.north") + margin))))
    other = rows.select(F.col("parcel_key").alias("b"), F.col("parts").alias("parts_b"), F.col("box").alias("box_b"), F.col("x").alias("x_b"), F.col("y").alias("y_b"))
    touch = (F.col("box.west") <= F.col("box_b.east") + margin) & (F.col("box_b.west") <= F.col("box.east") + margin) & (F.col("box.south") <= F.col("box_b.north") + margin) & (F.col("box_b.south") <= F.col("box.north") + margin)
    home = (F.col("x") == at(F.greatest("box.west", "box_b.west") - margin)) & (F.col("y") == at(F.greatest("box.south", "box_b.south") - margin))
    joined = rows.join(other, (F.col("x") == F.col("x_b")) & (F.col("y") == F.col("y_b")) & (F.col("parcel_key") != F.col("b")) & touch & home)
    return joined.select(F.col("parcel_key").alias("a"), "b", F.col("parts").alias("parts_a"), "parts_b")


def topology_findings(parcels: DataFrame) -> DataFrame:
    """``parcel_key, counterpart, kind, area, fraction`` of overlaps and slivers between valid shapes, and of invalid shapes (self_intersection, no counterpart)."""
    rows = settled(with_parts(parcels).select("parcel_key", "parts", shapes.validity(F.col("parts")).alias("why")))
    found = neighbours(rows.filter("why is null and size(parts) > 0")).withColumn("t", topology("parts_a", "parts_b")).filter("t.kind is not null")
    found = found.select(F.col("a").alias("parcel_key"), F.col("b").alias("counterpart"), "t.*")
    wrong = rows.filter("why is not null").select("parcel_key", F.lit(None).cast("string").alias("counterpart"), F.lit("self_intersection").alias("kind"), F.lit(0.0).alias("area"), F.lit(0.0).alias("fraction"))
    return found.unionByName(wrong)


def is_material(area: Column, fraction: Column) -> Column:
    return (area > 1) & (fraction > 0.001)


def tolerance(source: Column, survey: float = SURVEY_TOLERANCE) -> Column:
    table = F.create_map(*(x for k, v in SOURCE_MULTIPLIER.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(table, source), F.lit(1.0)) * survey


def relative_delta(textual: Column, geometric: Column) -> Column:
    """Share of the measured area; null without both, 1 for a measured area of zero."""
    t, g = textual.cast("double"), geometric.cast("double")
    return F.when(t.isNull() | g.isNull(), None).when(g == 0, F.when(t != 0, 1.0)).otherwise(F.abs(t - g) / g)


def band(rel: Column, tol: Column, severe: float = SEVERE) -> Column:
    return F.when(rel.isNull(), "undetermined").when(rel <= 0.001, "exact").when(rel <= tol, "within_survey_tolerance").when(rel <= severe / 5, "minor").when(rel <= severe, "material").otherwise("severe")


def mismatch_score(rel: Column, severe: float = SEVERE) -> Column:
    return F.when(rel.isNull(), 0.0).otherwise(F.round(F.least(F.lit(100.0), rel / severe * 100), 2))


def agreement(rel: Column, severe: float = SEVERE) -> Column:
    return F.when(rel.isNull(), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - rel / severe), 4))


def topology_penalty(fractions: Column) -> Column:
    """Of the material findings' fractions."""
    return F.aggregate(fractions, F.lit(0.0), lambda s, f: s + F.least(F.lit(40.0), f * 100))


def total_mismatch(base: Column, penalty: Column) -> Column:
    return F.round(F.least(F.lit(100.0), base + penalty), 2)


def confidence(ocr: Column, llm: Column, integrity: Column, geometric: Column, available: Column, weights: tuple[float, float, float, float] = (0.25, 0.25, 0.25, 0.25)) -> Column:
    """Weighted mean, held down to a component below the floor; capped without geometry, whose zero still weighs."""
    mean = ocr * weights[0] + llm * weights[1] + integrity * weights[2] + geometric * weights[3]
    weakest = F.when(available, F.least(ocr, llm, integrity, geometric)).otherwise(F.least(ocr, llm, integrity))
    held = F.when(weakest < FLOOR, F.least(mean, weakest)).otherwise(mean)
    capped = F.when(available, held).otherwise(F.least(held, F.lit(NO_GEOMETRY_CAP)))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), capped)), 4)


def action(ocr: Column, llm: Column, band_: Column, score: Column, material: Column) -> Column:
    return (
        F.when((ocr < 0.45) | (llm < 0.45), "reject_re_scan")
        .when(material, "field_verification")
        .when(band_.isin("material", "severe"), "field_verification")
        .when((score >= 0.85) & band_.isin("exact", "within_survey_tolerance"), "auto_approve")
        .otherwise("review_queue")
    )


def discrepancies(records: DataFrame, geometries: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Reports of ``parcel_key, textual_area, ocr, llm, integrity`` against ``parcel_key, parts`` or ``ring``, ``source``; a miss is a valid outcome.

    Shapes are measured where they are read; invalid ones are matched but have no area.  Of several
    of a key that of the most exact source counts, then the smallest.
    """
    one = "parts" not in geometries.columns
    rows = settled(geometries.select(F.col("parcel_key").alias("g_key"), tolerance(F.col("source")).alias("tol"), "ring" if one else "parts"))  # a shape is made once
    plain, size = (shapes.plain_ring(F.col("ring")), ring_area(F.col("ring"))) if one else (shapes.plainly_valid(F.col("parts")), area(F.col("parts")))
    parts = shapes.of_ring(F.col("ring")) if one else F.col("parts")
    sure = rows.filter(plain).select("g_key", "tol", size.alias("geometric_area"))  # without Python
    other = rows.filter(~plain).select("g_key", "tol", F.when(shapes.validity(parts).isNull(), size).alias("geometric_area"))
    measured = settled(sure.unionByName(other))
    g = measured.groupBy("g_key").agg(F.min(F.struct("tol", "geometric_area")).alias("g")).select("g_key", "g.tol", "g.geometric_area")
    rows = records.join(g, F.col("parcel_key") == F.col("g_key"), "left").withColumn("available", F.col("g_key").isNotNull())
    if findings is not None:
        per = findings.filter(is_material(F.col("area"), F.col("fraction"))).groupBy(F.col("parcel_key").alias("f_key")).agg(F.collect_list("fraction").alias("fractions"))
        rows = rows.join(per, F.col("parcel_key") == F.col("f_key"), "left")
    else:
        rows = rows.withColumn("fractions", F.lit(None).cast("array<double>"))
    rows = settled(rows)
    rel = relative_delta(F.col("textual_area"), F.col("geometric_area"))
    tol = F.coalesce("tol", F.lit(SURVEY_TOLERANCE))
    rows = settled(rows.withColumn("relative_delta", rel)).withColumn("band", band(F.col("relative_delta"), tol))
    penalty = F.coalesce(topology_penalty(F.col("fractions")), F.lit(0.0))
    rows = rows.withColumns({"mismatch_score": total_mismatch(mismatch_score(F.col("relative_delta")), penalty), "confidence_score": confidence(F.col("ocr"), F.col("llm"), F.col("integrity"), agreement(F.col("relative_delta")), F.col("available"))})
    act = action(F.col("ocr"), F.col("llm"), F.col("band"), F.col("confidence_score"), F.coalesce(F.size("fractions") > 0, F.lit(False)))
    return rows.select("parcel_key", F.col("available").alias("geometry_matched"), "geometric_area", "relative_delta", "band", "mismatch_score", "confidence_score", act.alias("recommended_action"))
