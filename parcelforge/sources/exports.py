"""Sinks: CSV for spreadsheets, audit CSV, GeoJSON, artifact JSON, HTML report, share text."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..operators import shapes
from ..operators.geo import with_parts

BOM = "﻿"
PARCEL_COLUMNS = ("id", "state", "district", "village", "khata_number", "survey_number", "area_sq_metre", "area_hectare", "confidence", "mismatch", "action", "review_status", "priority", "assigned_to", "sla_due_at", "issue_count", "severity", "correction_count", "created_at")


def share_text(share: Column, raw: Column) -> Column:
    """n/d, else the text of the record, else null."""
    return F.when(share.isNotNull(), F.concat(share["num"].cast("string"), F.lit("/"), share["den"].cast("string"))).otherwise(raw)


def parcel_rows(parcels: DataFrame, limit: int = 50_000) -> DataFrame:
    """The columns of the parcel export in its order; areas in square metres and hectares."""
    area = F.col("area").cast("double")
    rows = parcels.withColumns({"area_sq_metre": area, "area_hectare": F.round(area / 10_000, 4)})
    return rows.orderBy("district", "village", "id").limit(limit).select(*PARCEL_COLUMNS)


def audit_rows(joined: DataFrame) -> DataFrame:
    """Audit events, newest first, with their values as JSON text."""
    return joined.orderBy(F.col("created_at").desc(), "id")


def csv_line(values) -> str:
    def one(v) -> str:
        text = "" if v is None else "True" if v is True else "False" if v is False else v.isoformat() if hasattr(v, "isoformat") else str(v)
        return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text

    return ",".join(map(one, values)) + "\n"


def csv_lines(df: DataFrame) -> DataFrame:
    """``line`` of every row, quoted as ``csv_line`` does, on the executors."""
    def text(c: str) -> Column:
        kind = df.schema[c].dataType.typeName()
        own = F.when(F.col(c), "True").when(~F.col(c), "False") if kind == "boolean" else F.col(c).cast("string")
        return F.coalesce(F.when(own.rlike(r'[,"\r\n]'), F.concat(F.lit('"'), F.replace(own, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(own), F.lit(""))

    return df.select(F.concat_ws(",", *(text(c) for c in df.columns)).alias("line"))


def csv_stream(df: DataFrame) -> Iterator[bytes]:
    """The export as bytes for one download, a row at a time through the driver; the byte order mark lets spreadsheets read the names. Large exports go to ``write_csv``."""
    yield (BOM + csv_line(df.columns)).encode()
    for row in df.toLocalIterator(prefetchPartitions=True):
        yield csv_line(row).encode()


def write_csv(df: DataFrame, path: str) -> None:
    """Distributed variant: part files with a header each, nulls empty."""
    df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def feature(parts: Column, properties: Column) -> Column:
    """A GeoJSON feature as JSON text."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), shapes.to_geojson(parts), F.lit(',"properties":'), F.to_json(properties), F.lit("}"))


def feature_collection(parcels: DataFrame, properties: tuple[str, ...], limit: int = 2000) -> DataFrame:
    """One row: ``collection`` JSON of at most ``limit`` shapes (``parts`` or ``ring``), with the numbers of matching and returned parcels."""
    shown = with_parts(parcels).filter("size(parts) > 0").orderBy("id").limit(limit).select(feature(F.col("parts"), F.struct(*properties)).alias("f"))
    body = shown.agg(F.collect_list("f").alias("features"))  # bounded by the limit
    counts = parcels.agg(F.count(F.lit(1)).alias("total_matching"))
    row = body.join(counts)
    n = F.size("features")
    out = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("features", ","), F.lit('],"total_matching":'), F.col("total_matching").cast("string"), F.lit(',"returned":'), n.cast("string"), F.lit(',"without_geometry":'), (F.col("total_matching") - n).cast("string"), F.lit("}"))
    return row.select(out.alias("collection"), n.alias("returned"), "total_matching")


def geojson_counts(parcels: DataFrame, limit: int) -> DataFrame:
    """``total_matching, returned, without_geometry`` of a collection of at most ``limit`` shapes, without building it."""
    n, g = F.count(F.lit(1)), F.least(F.count_if("has_geometry"), F.lit(limit))
    return parcels.agg(n.alias("total_matching"), g.alias("returned"), (n - g).alias("without_geometry"))


def escaped(text: Column) -> Column:
    """Text for HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def report_facts(columns: tuple[str, ...]) -> Column:
    """The facts section of a record's verification report as HTML, for whole tables; null values are empty."""
    parts = [F.concat(F.lit(f"<dt>{html.escape(c)}</dt><dd>"), escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</dd>")) for c in columns]
    return F.concat(F.lit("<dl>"), *parts, F.lit("</dl>"))


def artifact_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def report_html(parcel: Row, owners: list[Row], issues: list[Row], events: list[Row]) -> str:
    """A verification report of one parcel; every value is escaped."""
    e = lambda v: html.escape("" if v is None else str(v))

    def section(title: str, rows: list[Row]) -> str:
        if not rows:
            return f"<h2>{e(title)}</h2><p>None.</p>"
        names = list(rows[0].asDict())
        head = "".join(f"<th>{e(n)}</th>" for n in names)
        body = "".join("<tr>" + "".join(f"<td>{e(r[n])}</td>" for n in names) + "</tr>" for r in rows)
        return f"<h2>{e(title)}</h2><table><tr>{head}</tr>{body}</table>"

    facts = "".join(f"<dt>{e(k)}</dt><dd>{e(v)}</dd>" for k, v in parcel.asDict().items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Verification report</title></head><body><h1>Verification report</h1><dl>{facts}</dl>{section('Owners', owners)}{section('Findings', issues)}{section('History', events)}</body></html>"
