"""Readers: documents as bytes, GeoJSON collections, policies, content-hash dedup, batch isolation."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes
from ..operators.rules import REGISTRY, Policy, Tolerance


def scan(spark: SparkSession, path: str, columns: tuple[str, ...], condition: Column | None = None) -> DataFrame:
    """Columns of a Parquet table under a condition; both reach the scan."""
    rows = spark.read.parquet(path)
    return (rows if condition is None else rows.filter(condition)).select(*columns)


def ingested(artifacts: DataFrame, document: str = "document", parcels: str = "parcels") -> tuple[DataFrame, DataFrame]:
    """Document rows (all columns but the parcels, and ``n_parcels``) and parcel rows (``document, parcel`` and the parcel's fields) of artifacts with an array of parcels."""
    rows = artifacts.select(*(c for c in artifacts.columns if c != parcels), F.coalesce(F.size(parcels), F.lit(0)).alias("n_parcels"))
    return rows, artifacts.select(document, F.posexplode(parcels).alias("parcel", "p")).select(document, "parcel", "p.*")


def documents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Files as rows ``path, length, modificationTime, content, sha256, document_id``."""
    rows = spark.read.format("binaryFile").options(**options).load(path)
    return rows.withColumn("sha256", F.sha2("content", 256)).withColumn("document_id", F.substring("sha256", 1, 32))


def geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``parcel_key, parts, source, reason`` of the features of FeatureCollections, or of one feature a line, which splits well.

    Features without a key are skipped.  Polygons and MultiPolygons keep all parts and holes; other
    geometries, and those that cannot be read, have no parts and a reason.
    """
    feature = "properties:map<string,string>,geometry:struct<type:string,coordinates:string>"
    if lines:
        f = spark.read.schema(feature.replace(":map", " map", 1).replace("geometry:", "geometry ", 1)).json(path).select(F.struct("properties", "geometry").alias("f"))
    else:
        f = spark.read.schema(f"features array<struct<{feature}>>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    kind = F.col("f.geometry.type")
    rows = f.select(F.try_element_at("f.properties", F.lit("parcel_key")).alias("parcel_key"), shapes.from_geojson(kind, F.col("f.geometry.coordinates")).alias("parts"), F.coalesce(F.try_element_at("f.properties", F.lit("source")), F.lit("unknown")).alias("source"), kind.alias("kind"))
    why = F.when(F.coalesce(~F.col("kind").isin("Polygon", "MultiPolygon"), F.lit(True)), "not_a_polygon").when(F.col("parts").isNull(), "unreadable")
    return rows.filter("parcel_key is not null").select("parcel_key", "parts", "source", why.alias("reason"))


def policy(text: str, extra_codes: tuple[str, ...] = ()) -> Policy:
    """A policy from JSON text (YAML is read when a parser is installed); unknown rule codes and fields are rejected."""
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("the policy is not JSON, and no YAML parser is installed") from e
        data = yaml.safe_load(text)
    if not isinstance(data, dict):
        raise ValueError("a policy is a mapping")
    names = {"absolute_sq_metre": "absolute", "z_score_threshold": "z_score"}
    rules = {}
    for code, fields in (data.get("rules") or {}).items():
        if code not in REGISTRY and code not in extra_codes and not code.startswith("SUCCESSION_"):
            raise ValueError(f"unknown rule code {code}")
        known = {names.get(k, k): v for k, v in (fields or {}).items() if k not in ("note", "min_confidence")}
        unknown = set(known) - set(Tolerance.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)} of {code}")
        rules[code] = Tolerance(**known)
    return Policy(data.get("name", "default"), float(data.get("default_absolute_sq_metre", 1.0)), float(data.get("default_relative", 0.005)), rules)


def new_documents(incoming: DataFrame, stored: DataFrame, key: str = "sha256") -> DataFrame:
    """Incoming documents whose content is not stored yet, one per content (least path first)."""
    fresh = incoming.join(stored.select(F.col(key).alias("__known")), F.col(key) == F.col("__known"), "left_anti")
    names = [c for c in fresh.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*names), F.struct(*[c for c in names if c in ("path", "doc_id")] or names)).alias("r")).select(key, "r.*")


def split_batch(rows: DataFrame, is_bad: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and failures with their reason: one bad file costs no other."""
    bad = F.coalesce(is_bad, F.lit(True))
    return rows.filter(~bad), rows.filter(bad).withColumn("reason", reason)


def rekeyed(provenance: Column, index: int) -> Column:
    """Provenance of one parcel with its prefix taken off the paths."""
    prefix = f"$.parcels[{index}]."
    own = F.map_filter(provenance, lambda k, v: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(own, lambda k, v: F.concat(F.lit("$."), F.substring(k, F.lit(len(prefix) + 1), F.length(k))))
