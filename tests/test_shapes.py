import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelforge.operators import geo, shapes
from parcelforge.sources import exports, files


def ring(*at):
    return [(float(x), float(y)) for x, y in at] + [(float(at[0][0]), float(at[0][1]))]


def box(x, y, w, h=None):
    h = w if h is None else h
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def arrays(*parts):
    return [[np.array(r, float) for r in part] for part in parts]


def spun(shape, angle):
    turn = np.array([[math.cos(angle), -math.sin(angle)], [math.sin(angle), math.cos(angle)]])
    return [[r @ turn for r in part] for part in shape]


REASONS = [
    ([[box(0, 0, 4)]], None), ([[box(0, 0, 4), box(1, 1, 1), box(2.5, 2.5, 1)], [box(9, 9, 1)]], None),
    ([[ring((0, 0), (4, 4), (4, 0), (0, 4))]], "self_intersection"), ([[box(0, 0, 4)[:-1]]], "not_closed"), ([[ring((0, 0), (1, 1), (2, 2))]], "degenerate"),
    ([[box(0, 0, 4), box(3, 3, 2)]], "self_intersection"), ([[box(0, 0, 4), box(7, 7, 1)]], "hole_outside"), ([[box(0, 0, 9), box(1, 1, 6), box(2, 2, 1)]], "nested"),
    ([[box(0, 0, 9)], [box(2, 2, 1)]], "nested"), ([[box(0, 0, 9), box(1, 1, 6)], [box(2, 2, 1)]], None), ([[box(0, 0, 4)], [box(4, 4, 2)]], None),
    ([[box(0, 0, 4)], [box(4, 1, 2)]], "self_intersection"), ([[ring((0, 0), (4, 0), (4, 4), (2, 0), (0, 4))]], "self_intersection"), ([[ring((0, 0), (0, 0), (4, 0), (4, 4))]], None),
]


def test_validity():
    for parts, why in REASONS:
        assert shapes.invalid_reason(arrays(*parts)) == why, parts


def test_validity_column(spark):
    rows = [(k, [[[dict(lon=x, lat=y) for x, y in r] for r in part] for part in parts]) for k, (parts, _) in enumerate(REASONS)] + [(98, None), (99, [])]
    df = spark.createDataFrame(rows, f"id int, parts {shapes.PARTS}")
    got = dict(df.select("id", shapes.validity(F.col("parts")).alias("why")).collect())
    assert [got[k] for k in range(len(REASONS))] == [why for _, why in REASONS] and got[98] is None and got[99] == "degenerate"
    plain = {r.id for r in df.filter(shapes.plainly_valid(F.col("parts"))).collect()}
    assert plain == {0}


@pytest.mark.parametrize("angle", [0.0, 0.3, 1.1])
def test_shared_area_of_boxes_with_holes(angle):
    """Against counting unit cells, which boxes of whole numbers allow."""
    r = random.Random(int(angle * 10))

    def invented():
        parts = []
        for k in range(r.randrange(1, 4)):
            x, y, w, h = 10 * k + r.randrange(0, 3), r.randrange(0, 6), r.randrange(3, 8), r.randrange(3, 8)
            holes = [box(x + 1, y + 1, r.randrange(1, w - 1), r.randrange(1, h - 1))] if r.random() < 0.6 else []
            parts.append([box(x, y, w, h), *holes])
        return parts

    def cells(parts):
        return {(i, j) for i in range(40) for j in range(20) if shapes.inside(np.array([[i + 0.5, j + 0.5]]), [np.array(x) for part in parts for x in part])[0][0]}

    for _ in range(40):
        p, q = invented(), invented()
        want = len(cells(p) & cells(q))
        assert abs(shapes.shared_area(spun(arrays(*p), angle), spun(arrays(*q), angle)) - want) < 1e-7
        assert abs(shapes.planar_area(spun(arrays(*p), angle)) - len(cells(p))) < 1e-7


def test_areas_and_perimeters(spark):
    whole, hole, part = box(73.9, 18.5, 0.001), box(73.9002, 18.5002, 0.0005), box(74.0, 18.5, 0.002)
    rows = [(1, [[whole, hole], [part]]), (2, [[whole]]), (3, [[hole]]), (4, [[part]]), (5, None), (6, [])]
    df = spark.createDataFrame([(k, None if s is None else [[[dict(lon=x, lat=y) for x, y in r] for r in p] for p in s]) for k, s in rows], f"id int, parts {shapes.PARTS}")
    got = {r.id: r for r in df.select("id", geo.area(F.col("parts")).alias("a"), geo.perimeter(F.col("parts")).alias("p"), shapes.vertices(F.col("parts")).alias("n")).collect()}
    assert abs(got[1].a - (got[2].a - got[3].a + got[4].a)) < 1e-6 and abs(got[1].p - (got[2].p + got[3].p + got[4].p)) < 1e-6
    assert got[1].n == 10 and got[5].a is None and got[6].a is None


def test_geojson_of_both_types(spark, tmp_path):
    whole, hole, part = box(0, 0, 4), box(1, 1, 1), box(9, 9, 2)
    geometries = {"a": {"type": "Polygon", "coordinates": [whole, hole]}, "b": {"type": "MultiPolygon", "coordinates": [[whole, hole], [part]]}, "c": {"type": "Point", "coordinates": [1, 2]}, "d": {"type": "Polygon", "coordinates": "x"}, "e": None}
    features = [{"type": "Feature", "properties": {"parcel_key": k}, "geometry": g} for k, g in geometries.items()] + [{"type": "Feature", "properties": {}, "geometry": geometries["a"]}]
    (tmp_path / "x.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = {r.parcel_key: r for r in files.geojson(spark, str(tmp_path / "x.json")).collect()}
    assert set(got) == set("abcde")
    assert [[len(r) for r in p] for p in got["a"].parts] == [[5, 5]] and [[len(r) for r in p] for p in got["b"].parts] == [[5, 5], [5]]
    assert [(got[k].reason, got[k].parts) for k in "ce"] == [("not_a_polygon", None)] * 2 and got["d"].reason == "unreadable"
    back = files.geojson(spark, str(tmp_path / "x.json")).filter("parcel_key in ('a', 'b')").select("parcel_key", shapes.to_geojson(F.col("parts")).alias("g")).collect()
    assert {r.parcel_key: json.loads(r.g) for r in back} == {k: json.loads(json.dumps(geometries[k])) for k in "ab"}


def test_topology_of_shapes_with_holes(spark):
    w = 0.001
    parts = {
        "frame": [[box(73.9, 18.5, w), box(73.9 + w / 4, 18.5 + w / 4, w / 2)]],
        "inner": [[box(73.9 + w * 0.3, 18.5 + w * 0.3, w * 0.4)]],  # in the hole, apart from the frame
        "over": [[box(73.9 + w / 2, 18.5 + w / 4, w)], [box(75, 19, w)]],
        "next": [[box(73.9 - w - 0.000003, 18.5, w)]],
        "tie": [[ring((73.9, 18.5), (73.9 + w, 18.5 + w), (73.9 + w, 18.5), (73.9, 18.5 + w))]],
    }
    df = spark.createDataFrame([(k, [[[dict(lon=x, lat=y) for x, y in r] for r in p] for p in v]) for k, v in parts.items()], f"parcel_key string, parts {shapes.PARTS}")
    got = {(r.parcel_key, r.counterpart): r for r in geo.topology_findings(df).collect()}
    assert {k: v.kind for k, v in got.items()} == {("frame", "over"): "overlap", ("over", "frame"): "overlap", ("inner", "over"): "overlap", ("over", "inner"): "overlap", ("frame", "next"): "sliver_gap", ("next", "frame"): "sliver_gap", ("tie", None): "self_intersection"}
    assert abs(got["frame", "over"].fraction - (0.5 * 0.75 - 0.25 * 0.5) / 0.75) < 1e-5 and abs(got["inner", "over"].fraction - 0.5) < 1e-5
    bad = geo.discrepancies(spark.createDataFrame([("tie", 100.0, 0.9, 0.9, 0.9)], "parcel_key string, textual_area double, ocr double, llm double, integrity double"), df.withColumn("source", F.lit("mock"))).first()
    assert bad.geometry_matched and bad.geometric_area is None and bad.band == "undetermined"


def test_feature_collection_of_shapes(spark):
    df = spark.createDataFrame([(1, "k1", [[[dict(lon=x, lat=y) for x, y in r] for r in (box(0, 0, 4), box(1, 1, 1))]]), (2, 'k"2', None)], f"id int, parcel_key string, parts {shapes.PARTS}")
    row = exports.feature_collection(df, ("parcel_key",)).first()
    body = json.loads(row.collection)
    assert (body["total_matching"], body["returned"], body["without_geometry"]) == (2, 1, 1) and len(body["features"][0]["geometry"]["coordinates"]) == 2 and body["features"][0]["properties"] == {"parcel_key": "k1"}
