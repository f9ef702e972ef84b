"""Document mapping, sources, sinks and streams over literal and driver data."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..enums import ROLES, STATUSES
from ..functions import names
from ..operators import docmap
from ..sources import exports, files, pages, replaced
from ..session import shared_folder
from ..streaming import audit, review
from .registry import Registry
from .views import AS_OF, EVENTS, PARCELS, as_of, parcels, review_events, time_text

query = Registry()
T = "'%Y-%m-%d %H:%M:%S'"

# Boxes by key arithmetic: a page an order, boxes of a tenth of the page
BOX = "b AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS page, (l_partkey % 900) / CAST(1000 AS DOUBLE) AS x0, (l_suppkey * 7 % 900) / CAST(1000 AS DOUBLE) AS y0, l_linestatus AS side FROM lineitem)"


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    t = t.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("page"), ((F.col("l_partkey") % 900) / F.lit(1000.0)).alias("x0"), ((F.col("l_suppkey") * 7 % 900) / F.lit(1000.0)).alias("y0"), F.col("l_linestatus").alias("side"))
    return t.withColumns({"x1": F.col("x0") + 0.1, "y1": F.col("y0") + 0.1})


@query("jn15_overlapping_tokens", f"WITH {BOX}, j AS (SELECT a.id AS id_a, b.id AS id_b, greatest(CAST(0 AS DOUBLE), least(a.x0, b.x0) + 0.1 - greatest(a.x0, b.x0)) * greatest(CAST(0 AS DOUBLE), least(a.y0, b.y0) + 0.1 - greatest(a.y0, b.y0)) AS i FROM b a JOIN b ON a.page = b.page AND a.side = 'O' AND b.side = 'F') SELECT id_a, id_b, round(i / (0.02 - i), 6) AS iou FROM j WHERE i / (0.02 - i) > 0.3001".replace("+ 0.1 -", "+ CAST(0.1 AS DOUBLE) -").replace("(0.02 - i)", "(CAST(0.02 AS DOUBLE) - i)"))
def jn15(spark: SparkSession, d: str) -> DataFrame:
    b = _boxes(spark, d)
    out = docmap.overlapping(b.filter("side = 'O'"), b.filter("side = 'F'"))
    return out.filter("iou > 0.3001").select("id_a", "id_b", F.round("iou", 6).alias("iou"))


@query("jn16_tokens_in_cells", f"WITH {BOX}, c AS (SELECT p.i AS page, r.i AS row, q.i AS col, q.i / CAST(4 AS DOUBLE) AS cx0, r.i / CAST(4 AS DOUBLE) AS cy0 FROM (SELECT DISTINCT page FROM b) p(i), range(4) r(i), range(4) q(i)) SELECT c.page, c.row, c.col, count(*) AS n FROM c JOIN b ON b.page = c.page AND x0 + 0.05 >= cx0 AND x0 + 0.05 <= cx0 + 0.25 AND y0 + 0.05 >= cy0 AND y0 + 0.05 <= cy0 + 0.25 GROUP BY 1, 2, 3".replace("+ 0.05", "+ CAST(0.05013 AS DOUBLE)").replace("+ 0.25", "+ CAST(0.25 AS DOUBLE)"))
def jn16(spark: SparkSession, d: str) -> DataFrame:
    cells = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("page")).distinct().withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>"))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    cells = cells.withColumns({"x0": F.col("col") / 4.0, "y0": F.col("row") / 4.0}).withColumns({"x1": F.col("x0") + 0.25, "y1": F.col("y0") + 0.25})
    shift = 0.00013
    t = _boxes(spark, d).select("page", F.lit("w").alias("text"), F.lit(1.0).alias("confidence"), (F.col("x0") + shift).alias("x0"), (F.col("y0") + shift).alias("y0"), (F.col("x0") + shift + 0.1).alias("x1"), (F.col("y0") + shift + 0.1).alias("y1"))
    return docmap.cell_texts(cells, t).select("page", "row", "col", F.size(F.split("text", " ")).cast("long").alias("n"))


TOKENS = [
    ("p", "Survey", 0.10, 0.10, 0.20, 0.14, 0.9, "easy"), ("p", "No", 0.22, 0.101, 0.26, 0.141, 0.8, "easy"), ("p", "125", 0.30, 0.10, 0.36, 0.14, 0.7, "easy"), ("p", "Ramesh", 0.10, 0.30, 0.22, 0.34, 0.6, "easy"),
    ("p", "survey", 0.10, 0.10, 0.20, 0.14, 0.85, "tess"), ("p", "12S", 0.30, 0.10, 0.36, 0.14, 0.75, "tess"), ("p", "extra", 0.70, 0.30, 0.78, 0.34, 0.9, "tess"), ("p", " ", 0.5, 0.5, 0.6, 0.6, 0.9, "tess"), ("p", "faint", 0.5, 0.5, 0.6, 0.6, 0.2, "tess"),
]


def tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOKENS, docmap.TOKEN)


@query("dm1_token_filter", "SELECT l_linestatus AS engine, count(*) AS n FROM lineitem WHERE l_discount >= 0.03 AND l_returnflag <> 'N' GROUP BY 1".replace("0.03", "CAST(0.03 AS DOUBLE)"))
def dm1(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linestatus").alias("engine"), F.col("l_discount").alias("confidence"), F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.col("l_returnflag")).alias("text"))
    return docmap.kept_tokens(t, 0.03).groupBy("engine").agg(F.count(F.lit(1)).alias("n"))


@query("dm2_engine_status", "SELECT user_id AS page, count(*) AS engines, count(CASE WHEN value <= 50 THEN 1 END) AS failed, CASE WHEN count(*) = count(CASE WHEN value <= 50 THEN 1 END) THEN 'failed' WHEN count(CASE WHEN value <= 50 THEN 1 END) > 0 THEN 'degraded' ELSE 'whole' END AS status FROM events GROUP BY 1")
def dm2(spark: SparkSession, d: str) -> DataFrame:
    return docmap.engine_status(spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("page"), F.col("event_type").alias("engine"), (F.col("value") > 50).alias("ok")))


@query("dm9_validate_and_repair", "SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE CAST(json_extract(props, '$.k') AS INT) END AS k, CASE event_id % 5 WHEN 0 THEN 'valid' WHEN 4 THEN 'rejected' ELSE 'repaired' END AS state FROM events")
def dm9(spark: SparkSession, d: str) -> DataFrame:
    n, p = F.col("event_id") % 5, F.col("props")
    text = F.when(n == 0, p).when(n == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 2, F.concat(F.lit("Here it is: "), p)).when(n == 3, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), F.lit(", }"))).otherwise(F.substring(p, F.lit(1), F.length(p) - 1))
    out = docmap.validated(spark.read.parquet(f"{d}/events.parquet").select("event_id", text.alias("json")), "k int")
    return out.select("event_id", "record.k", "state")


# Lines of an order as tokens of a page, read by two engines; SQL folds the leading engine's tokens in order, each with its partners from best to worst
_DM3 = """
WITH b AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus, l_returnflag) AS seq, l_linestatus || l_returnflag AS engine, CAST(l_partkey % 4 AS VARCHAR) AS text, (l_partkey % 60) / CAST(1000 AS DOUBLE) AS x0, (l_suppkey * 7 % 60) / CAST(1000 AS DOUBLE) AS y0, (l_quantity + 50) / CAST(100 AS DOUBLE) AS confidence FROM lineitem),
e AS (SELECT page, engine, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, min(seq)) AS rank FROM b GROUP BY 1, 2),
t AS (SELECT b.*, rank, rank * 100 + seq AS place FROM b JOIN e USING (page, engine)),
k AS (SELECT *, x0 + CAST(0.1 AS DOUBLE) AS x1, y0 + CAST(0.1 AS DOUBLE) AS y1 FROM t),
h AS (SELECT a.page, a.seq AS a, o.place AS o, greatest(CAST(0 AS DOUBLE), least(a.x1, o.x1) - greatest(a.x0, o.x0)) * greatest(CAST(0 AS DOUBLE), least(a.y1, o.y1) - greatest(a.y0, o.y0)) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (o.x1 - o.x0) * (o.y1 - o.y0) AS total FROM k a JOIN k o ON a.page = o.page AND a.rank = 1 AND o.rank > 1),
c AS (SELECT page, a, list(o ORDER BY i / (total - i) DESC, o) AS os FROM h WHERE i / (total - i) > CAST(0.3 AS DOUBLE) GROUP BY 1, 2),
f AS (SELECT page, list(a ORDER BY a) AS firsts, list_reduce(list_prepend([]::BIGINT[], list(os ORDER BY a)), lambda taken, os: list_append(taken, coalesce(list_filter(os, lambda x: NOT list_contains(taken, x))[1], -1))) AS taken FROM c GROUP BY 1),
p AS (SELECT page, unnest(firsts) AS a, unnest(taken) AS o FROM f),
m AS (SELECT t.page, t.seq, o.seq AS o_seq, t.text AS t_text, o.text AS o_text, t.confidence AS tc, o.confidence AS oc, t.engine FROM t LEFT JOIN p ON p.page = t.page AND p.a = t.seq LEFT JOIN t o ON o.page = t.page AND o.place = p.o WHERE t.rank = 1)
SELECT page, CASE WHEN o_seq IS NULL OR tc >= oc THEN seq ELSE o_seq END AS seq, CASE WHEN o_seq IS NULL THEN engine ELSE 'ensemble' END AS engine, CASE WHEN o_seq IS NULL THEN round(tc, 4) ELSE round(least(CAST(1 AS DOUBLE), greatest(tc, oc) * CASE WHEN t_text = o_text THEN CAST(1.1 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END), 4) END AS confidence FROM m
UNION ALL SELECT page, seq, engine, round(confidence, 4) FROM t WHERE rank > 1 AND (page, place) NOT IN (SELECT page, o FROM p)
"""


@query("dm3_reconcile", _DM3)
def dm3(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus", "l_returnflag")
    t = t.select(F.col("l_orderkey").alias("page"), F.row_number().over(order).cast("long").alias("seq"), F.concat("l_linestatus", "l_returnflag").alias("engine"), (F.col("l_partkey") % 4).cast("string").alias("text"), ((F.col("l_partkey") % 60) / F.lit(1000.0)).alias("x0"), ((F.col("l_suppkey") * 7 % 60) / F.lit(1000.0)).alias("y0"), ((F.col("l_quantity") + 50) / F.lit(100.0)).alias("confidence"))
    t = t.withColumns({"x1": F.col("x0") + 0.1, "y1": F.col("y0") + 0.1})
    return docmap.reconcile(t).select("page", "seq", "engine", F.round("confidence", 4).alias("confidence"))


@query("rd20_lines", "SELECT * FROM (VALUES (0, 'Survey No 12S'), (1, 'Ramesh extra')) t(line, text)")
def rd20(spark: SparkSession, d: str) -> DataFrame:
    return docmap.lines(docmap.reconcile(docmap.kept_tokens(tokens(spark)))).select("line", "text")


@query("sc41_box", "SELECT o_orderkey, least(greatest(o_orderkey % 130 - 10, 0), 100) / CAST(100 AS DOUBLE) AS x0 FROM orders")
def sc41(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    b = docmap.box(F.lit(100.0), F.lit(0.0), k % 130 - 10, F.lit(50.0), F.lit(100.0), F.lit(100.0))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", b["x0"].alias("x0"))


@query("sc42_markdown", "WITH t AS (SELECT o_custkey AS page, list(concat('| ', o_orderkey, ' | ', o_orderstatus, '\\|', o_orderpriority, ' |') ORDER BY o_orderkey) AS l FROM orders GROUP BY 1) SELECT page, array_to_string(list_concat([l[1], '| --- | --- |'], l[2:]), chr(10)) AS \"table\" FROM t")
def sc42(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    texts = F.array(F.col("o_orderkey").cast("string"), F.concat("o_orderstatus", F.lit("|"), "o_orderpriority"))
    return docmap.markdown(o.select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("row"), F.posexplode(texts).alias("col", "text")))


# Lines of the documents' texts; told is the start of one of a document's lines, with its letters or spoiled beyond recognition
LINES = "t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents), ln AS (SELECT doc_id, unnest(range(0, len(lines))) AS line, unnest(lines) AS text FROM t), told AS (SELECT doc_id, path, substr(lines[1 + (doc_id * 7 + path) % len(lines)], 1, 20 + path) AS raw FROM t, (VALUES (1), (2)) p(path) UNION ALL SELECT doc_id, 3, '#~^#~^#~^' FROM t)"


@query("jn17_attach_boxes", f"WITH {LINES}, m AS (SELECT told.doc_id, path, min(line) AS line FROM told JOIN ln ON ln.doc_id = told.doc_id AND (contains(ln.text, raw) OR contains(raw, ln.text)) WHERE trim(raw) <> '' AND trim(ln.text) <> '' GROUP BY 1, 2) SELECT told.doc_id AS document, CAST(told.path AS BIGINT) AS path, CAST(m.line AS DOUBLE) AS y0 FROM told LEFT JOIN m ON m.doc_id = told.doc_id AND m.path = told.path")
def jn17(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("document"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    ln = t.select("document", F.lit(0).alias("page"), F.posexplode("lines").alias("line", "text"))
    ln = ln.withColumns({"x0": F.lit(0.0), "y0": F.col("line").cast("double"), "x1": F.lit(1.0), "y1": F.col("line") + 1.0})
    path = F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 2, 3)))).alias("path")
    raw = F.substring(F.get("lines", ((F.col("document") * 7 + F.col("path")) % F.size("lines")).cast("int")), F.lit(1), (20 + F.col("path")).cast("int"))
    told = t.select("document", "lines", path).select("document", "path", F.when(F.col("path") == 3, "#~^#~^#~^").otherwise(raw).alias("raw_text"))
    return docmap.attach_boxes(told, ln).select("document", "path", F.col("box.y0").alias("y0"))


@query("jn10_best_owner", "WITH w AS (SELECT p_partkey AS id, p_partkey // 10 AS document, split_part(p_name, ' ', 1) AS name FROM part), s AS (SELECT x.id, round(jaro_winkler_similarity(x.name, y.name), 4) AS score FROM w x JOIN w y ON x.document = y.document AND x.id <> y.id), b AS (SELECT id, max(score) AS score FROM s GROUP BY 1) SELECT id, score, score >= 0.88 AS matched FROM b")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    w = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 10).alias("document"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))
    return names.best_owners(w, w, "document").select("id", "score", "matched")


WIRES = [
    ("good", json.dumps({"detected_record_format": "satbara_7_12", "parcels": [{"survey_number": "125/2", "total_area": {"raw_text": "1-20-00"}, "owners": [{"serial_number": "1", "name": {"raw_name": "Ramesh", "relation_raw": "s/o"}, "tenure_raw": "malik", "share": {"raw_text": "1/3"}}, {"serial_number": "2", "name": {"raw_name": " "}}, {"serial_number": "3", "name": {"raw_name": "Sita"}, "tenure_raw": "qqqq", "share": {"raw_text": "समान"}}], "mutations": [{"mutation_number": "1", "type_raw": "varsa", "status_raw": "manjur", "entry_date_raw": "01/02/2020", "order_date_raw": "01/01/2020"}, {"mutation_number": "2", "type_raw": "bai", "status_raw": "pending", "entry_date_raw": "01/02/2020"}], "encumbrances": [{"type_raw": "gahan", "status_raw": "chalu", "discharged_on_raw": "1/1/2021"}, {"type_raw": "boja", "status_raw": "chalu"}]}, {"survey_number": "7", "total_area": {"hectare": "O", "are": "8O", "sq_metre": "5"}}], "field_confidences": [{"field_path": "$.parcels[0].owners[0]", "confidence": 0.4, "reason": "faint"}]}, ensure_ascii=False)),
    ("bad", "{not json"),
]


def _wire(spark: SparkSession) -> DataFrame:
    return docmap.read_wire(spark.createDataFrame(WIRES, "document string, json string"))


# Wire JSON of an order each: an area, three owners, one mutation, one charge; every tenth is broken
_WIRE = """concat('{"detected_record_format":"satbara_7_12","parcels":[{"survey_number":"S', o_orderkey, '","total_area":{"raw_text":"', o_orderkey % 9, '-', o_orderkey % 90, '-', o_custkey % 70, '"},"owners":[{"serial_number":"1","name":{"raw_name":"Owner ', o_custkey, '","relation_raw":"s/o"},"tenure_raw":"malik","share":{"raw_text":"1/', 2 + o_orderkey % 3, '"}},{"serial_number":"2","name":{"raw_name":" "}},{"serial_number":"3","name":{"raw_name":"Sita"},"tenure_raw":"qqqq","share":{"raw_text":"समान"}}],"mutations":[{"mutation_number":"', o_orderkey, '","type_raw":"varsa","status_raw":"manjur","entry_date_raw":"01/02/2020","order_date_raw":"01/0', 1 + o_orderkey % 2 * 2, '/2020"}],"encumbrances":[{"type_raw":"gahan","status_raw":"chalu"', IF(o_orderkey % 2 = 1, ',"discharged_on_raw":"1/1/2021"', ''), '}]}],"field_confidences":[{"field_path":"$.parcels[0].owners[0]","confidence":0.', 1 + o_orderkey % 9, '}]}')"""


def wires(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 == 3, F.concat(F.lit("{not json "), F.col("o_orderkey").cast("string"))).otherwise(F.expr(_WIRE))
    return docmap.read_wire(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("document"), text.alias("json")))


@query("dm6_wire_parcels", "SELECT CAST(o_orderkey AS VARCHAR) AS document, 0 AS parcel, concat('S', o_orderkey) AS survey, CAST(o_orderkey % 9 * 10000 + o_orderkey % 90 * 100 + o_custkey % 70 AS DOUBLE) AS area FROM orders WHERE o_orderkey % 10 <> 3")
def dm6(spark: SparkSession, d: str) -> DataFrame:
    p = docmap.parcels(wires(spark, d))
    return p.select("document", "parcel", F.col("p.survey_number").alias("survey"), docmap.wire_area(F.col("p.total_area"), F.col("system"))["sq_metre"].cast("double").alias("area"))


@query("io10_batch_isolation", "SELECT CAST(o_orderkey AS VARCHAR) AS document, 'not readable' AS reason FROM orders WHERE o_orderkey % 10 = 3")
def io10(spark: SparkSession, d: str) -> DataFrame:
    _, failed = files.split_batch(wires(spark, d), F.col("corrupt"), F.lit("not readable"))
    return failed.select("document", "reason")


@query("dm7_owners", "SELECT CAST(o_orderkey AS VARCHAR) AS document, i, CASE i WHEN 0 THEN 'son_of' ELSE 'unknown' END AS relation, CASE i WHEN 0 THEN 'owner' ELSE 'unknown' END AS tenure, CASE i WHEN 0 THEN CAST(1 AS BIGINT) END AS num, CASE i WHEN 0 THEN CAST(2 + o_orderkey % 3 AS BIGINT) END AS den, CASE i WHEN 1 THEN 'no name' WHEN 2 THEN 'unresolved tenure' END AS warning, i <> 1 AS kept FROM orders, (VALUES (0), (1), (2)) v(i) WHERE o_orderkey % 10 <> 3")
def dm7(spark: SparkSession, d: str) -> DataFrame:
    return docmap.owners(docmap.parcels(wires(spark, d))).select("document", "i", "relation", "tenure", "share.num", "share.den", "warning", "kept")


@query("dm7_mutations", "SELECT CAST(o_orderkey AS VARCHAR) AS number, 'inheritance' AS mutation_type, 'sanctioned' AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'order before entry' END AS warning, o_orderkey % 2 = 1 AS kept FROM orders WHERE o_orderkey % 10 <> 3")
def dm7b(spark: SparkSession, d: str) -> DataFrame:
    return docmap.mutations(docmap.parcels(wires(spark, d))).select("number", "mutation_type", "status", "warning", "kept")


@query("dm7_encumbrances", "SELECT CAST(o_orderkey AS VARCHAR) AS document, 0 AS i, 'mortgage' AS encumbrance_type, CASE WHEN o_orderkey % 2 = 1 THEN 'discharged' ELSE 'active' END AS status FROM orders WHERE o_orderkey % 10 <> 3")
def dm7c(spark: SparkSession, d: str) -> DataFrame:
    return docmap.encumbrances(docmap.parcels(wires(spark, d))).select("document", "i", "encumbrance_type", "status")


# Land of an order each: areas by class, sub-divisions, crops and money; every tenth is broken
_LAND = """concat('{"detected_record_format":"satbara_7_12","parcels":[{"survey_number":"S', o_orderkey, '","assessment_amount":"1O', o_orderkey % 10, '.50"', IF(o_orderkey % 2 = 0, concat(',"water_rate":"', o_custkey, '"'), ''), ',"classified_areas":[{"raw_label":"चाही","area":{"raw_text":"', o_orderkey % 9, '-', o_orderkey % 90, '-', o_custkey % 70, '"},"irrigation_raw":"canal"},{"raw_label":"qqqq","area":{"hectare":"', o_orderkey % 7, '"}},{"raw_label":"barani","area":{}},{"area":{"raw_text":"torn"}}],"sub_divisions":[{"sub_division_number":"', o_orderkey % 4, '/A","area":{"are":"', o_orderkey % 90, '"},"classification_raw":"jirayat","assessment_amount":"', o_custkey, '","owner_serial_numbers":["1","2"]},{"area":{"are":"3","sq_metre":"', o_custkey % 70, '"}},{"sub_division_number":"9","remarks":"lost"}],"crops":[{"year":"2020-21","season_raw":"Rabi","crop_name":"wheat","area":{"are":"', o_orderkey % 50, '"},"irrigation_raw":"well"},{"crop_name":"gram","remarks":"', o_orderstatus, '"}]}]}')"""


def land(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 10 == 3, "[").otherwise(F.expr(_LAND))
    return docmap.parcels(docmap.read_wire(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("document"), text.alias("json"))))


@query("dm7_classified_areas", "SELECT CAST(o_orderkey AS VARCHAR) AS document, concat('$.parcels[0].classified_areas[', i, ']') AS path, CASE i WHEN 0 THEN 'irrigated' WHEN 2 THEN 'unirrigated' ELSE 'unknown' END AS classification, CASE i WHEN 0 THEN 'canal' ELSE 'unknown' END AS irrigation, CASE i WHEN 0 THEN CAST(o_orderkey % 9 * 10000 + o_orderkey % 90 * 100 + o_custkey % 70 AS DOUBLE) WHEN 1 THEN CAST(o_orderkey % 7 * 10000 AS DOUBLE) END AS area, CASE i WHEN 1 THEN 'unresolved classification' WHEN 2 THEN 'no area' WHEN 3 THEN 'unreadable area' END AS warning, i < 2 AS kept FROM orders, (VALUES (0), (1), (2), (3)) v(i) WHERE o_orderkey % 10 <> 3")
def dm7d(spark: SparkSession, d: str) -> DataFrame:
    return docmap.classified_areas(land(spark, d)).select("document", "path", "classification", "irrigation", F.col("sq_metre").cast("double").alias("area"), "warning", "kept")


@query("dm7_sub_divisions", "SELECT CAST(o_orderkey AS VARCHAR) AS document, CASE i WHEN 0 THEN concat(o_orderkey % 4, '/A') WHEN 1 THEN 'unnumbered-1' ELSE '9' END AS number, CASE i WHEN 0 THEN 'unirrigated' ELSE 'unknown' END AS classification, CASE i WHEN 0 THEN CAST(o_orderkey % 90 * 100 AS DOUBLE) WHEN 1 THEN CAST(300 + o_custkey % 70 AS DOUBLE) END AS area, CASE i WHEN 0 THEN CAST(o_custkey AS DOUBLE) END AS assessment, CASE i WHEN 0 THEN '1 2' ELSE '' END AS owners, CASE i WHEN 2 THEN 'lost' END AS remarks, CASE i WHEN 2 THEN 'no area' END AS warning, i < 2 AS kept FROM orders, (VALUES (0), (1), (2)) v(i) WHERE o_orderkey % 10 <> 3")
def dm7e(spark: SparkSession, d: str) -> DataFrame:
    return docmap.sub_divisions(land(spark, d)).select("document", "number", "classification", F.col("sq_metre").cast("double").alias("area"), F.col("assessment").cast("double").alias("assessment"), F.array_join("owner_serial_numbers", " ").alias("owners"), "remarks", "warning", "kept")


@query("dm7_crops", "SELECT CAST(o_orderkey AS VARCHAR) AS document, i, CASE i WHEN 0 THEN '2020-21' END AS year, CASE i WHEN 0 THEN 'Rabi' END AS season, CASE i WHEN 0 THEN 'wheat' ELSE 'gram' END AS crop, CASE i WHEN 0 THEN CAST(o_orderkey % 50 * 100 AS DOUBLE) END AS area, CASE i WHEN 0 THEN 'well' ELSE 'unknown' END AS irrigation, CASE i WHEN 1 THEN o_orderstatus END AS remarks FROM orders, (VALUES (0), (1)) v(i) WHERE o_orderkey % 10 <> 3")
def dm7f(spark: SparkSession, d: str) -> DataFrame:
    return docmap.crops(land(spark, d)).select("document", "i", "year", "season", "crop", F.col("sq_metre").cast("double").alias("area"), "irrigation", "remarks")


@query("dm7_assessments", "SELECT CAST(o_orderkey AS VARCHAR) AS document, CAST(100.5 AS DOUBLE) + o_orderkey % 10 AS assessment, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) END AS water_rate FROM orders WHERE o_orderkey % 10 <> 3")
def dm7g(spark: SparkSession, d: str) -> DataFrame:
    return docmap.assessments(land(spark, d)).select("document", F.col("assessment").cast("double").alias("assessment"), F.col("water_rate").cast("double").alias("water_rate"))


@query("dm8_field_confidence", "SELECT CAST(o_orderkey AS VARCHAR) AS document, concat('$.parcels[0].owners[', i, ']') AS path, CASE i WHEN 0 THEN round((1 + o_orderkey % 9) / CAST(10 AS DOUBLE), 2) ELSE CAST(0.95 AS DOUBLE) END AS confidence FROM orders, (VALUES (0), (2)) v(i) WHERE o_orderkey % 10 <> 3")
def dm8(spark: SparkSession, d: str) -> DataFrame:
    w = wires(spark, d)
    paths = docmap.owners(docmap.parcels(w)).filter("kept").select("document", "path")
    return docmap.field_confidence(w.filter(~F.col("corrupt")), paths).select("document", "path", F.round("confidence", 2).alias("confidence"))


@query("sx23_route_documents", "SELECT * FROM (VALUES ('RoR', 'jamabandi', 'snapshot'), ('new-jamabandi', 'updated_jamabandi', 'snapshot'), ('Death Certificate', 'death_certificate', 'death'), ('ferfar', 'mutation_order', 'mutation'), ('legal heir', 'legal_heir_certificate', 'heirs'), ('haq tyag', 'relinquishment_deed', 'supporting'), ('tax bill', 'other', 'supporting')) t(raw, kind, part)")
def sx23(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(x,) for x in ("RoR", "new-jamabandi", "Death Certificate", "ferfar", "legal heir", "haq tyag", "tax bill")], "raw string").withColumn("kind", docmap.document_type(F.col("raw")))
    return t.select("raw", "kind", docmap.route(F.col("kind")).alias("part"))


@query("sx25_labelled_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN concat('Owner ', o_custkey) END AS name, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') END AS died, CAST(CASE WHEN o_orderkey % 4 IN (1, 2) THEN o_orderkey % 4 ELSE 0 END AS INT) AS heirs FROM orders")
def sx25(spark: SparkSession, d: str) -> DataFrame:
    k, owner = F.col("o_orderkey") % 4, F.concat(F.lit("Owner "), F.col("o_custkey").cast("string"))
    dead = F.concat(F.lit("GOVT\nName of the Deceased : "), owner, F.lit("\nDate of Death: "), F.date_format("o_orderdate", "dd/MM/yyyy"))
    heirs = F.concat(F.lit("Name: "), owner, F.lit("\nWife : Sita"), F.when(k == 2, "\nSon 1: Amit").otherwise(""))
    text = F.when(k == 0, dead).when(k < 3, heirs).otherwise("nothing here")
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", text.alias("text")).withColumn("f", docmap.labelled_fields(F.col("text")))
    return t.select("o_orderkey", F.try_element_at("f.fields", F.lit("name")).alias("name"), F.try_element_at("f.fields", F.lit("date_of_death")).alias("died"), F.size("f.heirs").alias("heirs"))


@query("sc38_read_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def sc38(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", docmap.read_path(F.col("props"), "$.k").alias("k"), docmap.read_path(F.col("props"), "$.x[3].y").alias("missing"))


@query("sc39_write_path", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 2) THEN CAST(o_custkey AS VARCHAR) END AS value FROM orders")
def sc39(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    json_ = F.when(k == 0, F.concat(F.lit('{"a": [{"b": '), F.col("o_orderkey").cast("string"), F.lit("}]}"))).when(k == 1, '{"a": []}').when(k == 2, "{}").otherwise("broken")
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", json_.alias("json"), F.when(k < 2, "$.a[0].b").otherwise("$.n").alias("path"), F.col("o_custkey").cast("string").alias("value"))
    t = t.withColumn("j", docmap.write_path("json", "path", "value"))
    return t.select("o_orderkey", F.coalesce(F.get_json_object("j", "$.a[0].b"), F.get_json_object("j", "$.n")).alias("value"))


@query("sc40_drop_computed", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def sc40(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.from_json("props", "k int").withField("computed", F.lit(1)).alias("p"))
    return t.select("event_id", docmap.without_computed(F.col("p"), "computed").alias("p")).select("event_id", "p.*")


# Sources and sinks


@query("io6_content_dedup", "SELECT md5(text) AS hash, min(doc_id) AS first_doc FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id < 300) GROUP BY 1")
def io6(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.md5(F.col("text").cast("binary")).alias("hash"))
    return files.new_documents(t, t.filter("doc_id < 300"), "hash").select("hash", F.col("doc_id").alias("first_doc"))


@query("io2_document_load", "SELECT 'parquet' AS kind, true AS hashed")
def io2(spark: SparkSession, d: str) -> DataFrame:
    t = files.documents(spark, f"{d}/region.parquet")
    return t.select(F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"), (F.length("sha256") == 64).alias("hashed"))


@query("io9_rekey_provenance", "SELECT o_orderkey, '$.n' AS path, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, concat('$.owners[', o_orderkey % 5, ']'), o_orderstatus FROM orders WHERE o_orderkey % 3 = 1")
def io9(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    own = F.concat(F.lit("$.parcels["), (k % 3).cast("string"), F.lit("].owners["), (k % 5).cast("string"), F.lit("]"))
    t = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.create_map(own, F.col("o_orderstatus"), F.lit("$.parcels[1].n"), F.col("o_orderpriority")).alias("p"))
    return t.select("o_orderkey", F.explode(files.rekeyed(F.col("p"), 1)).alias("path", "value"))


@query("io12_parcel_csv", f"WITH {PARCELS} SELECT id, state, district, village, khata_number, survey_number, CAST(area AS DOUBLE) AS area_sq_metre, confidence, review_status FROM parcels WHERE state = 'ASIA' AND {'review_status IN'} ('pending','in_review','escalated') ORDER BY district NULLS FIRST, village, id LIMIT 500")
def io12(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reads import parcel_filter

    p = parcels(spark, d)
    out = exports.parcel_rows(p.filter(parcel_filter(p.columns, state="ASIA", open_only=True)), 500)
    return out.select("id", "state", "district", "village", "khata_number", "survey_number", "area_sq_metre", "confidence", "review_status")


@query("io11_csv_lines", f"WITH {PARCELS} SELECT concat(id, ',', state, ',', coalesce(assigned_to, ''), ',', CASE WHEN has_geometry THEN 'True' ELSE 'False' END) AS line FROM parcels")
def io11(spark: SparkSession, d: str) -> DataFrame:
    return exports.csv_lines(parcels(spark, d).select("id", "state", "assigned_to", "has_geometry"))


@query("io14_artifact_json", "SELECT concat('{\"event_id\":', event_id, ',\"user_id\":', user_id, '}') AS json FROM events")
def io14(spark: SparkSession, d: str) -> DataFrame:
    return exports.artifact_json(spark.read.parquet(f"{d}/events.parquet").select("event_id", "user_id"))


@query("io16_share_text", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat(1 + o_orderkey % 5, '/', 6 + o_custkey % 9) WHEN 1 THEN o_orderpriority END AS out FROM orders")
def io16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    share = F.when(k % 3 == 0, F.struct((1 + k % 5).alias("num"), (6 + F.col("o_custkey") % 9).alias("den")))
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", exports.share_text(share, F.when(k % 3 == 1, F.col("o_orderpriority"))).alias("out"))


@query("io17_geojson", f"WITH {PARCELS}, m AS (SELECT * FROM parcels) SELECT CAST(least(count(CASE WHEN has_geometry THEN 1 END), 100) AS INT) AS returned, count(*) AS total_matching FROM m")
def io17(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("id").cast("double")
    p = parcels(spark, d).withColumn("ring", F.when(F.col("has_geometry"), F.array(F.struct(x.alias("lon"), x.alias("lat")))))
    return exports.feature_collection(p, ("id", "state"), 100).select("returned", "total_matching")


@query("io18_document_register", "SELECT doc_id, source FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 50")
def io18(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reads import page

    return page(spark.read.parquet(f"{d}/documents.parquet"), "n_chars", limit=50, offset=50, tie="doc_id").select("doc_id", "source")


@query("io13_audit_csv", f"WITH {PARCELS}, {EVENTS} SELECT e.id, p.district, e.reviewer, strftime(e.created_at, {T}) AS at FROM review_events e JOIN parcels p ON e.parcel_id = p.id WHERE e.action = 'status_changed'")
def io13(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.reads import audit as joined

    return exports.audit_rows(joined(review_events(spark, d), parcels(spark, d), action="status_changed")).select("id", "district", "reviewer", time_text("created_at").alias("at"))


@query("io7_ingest_rows", "SELECT conv_id AS document, turn AS parcel, length(text) AS n FROM conversations")
def io7(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/conversations.parquet").groupBy(F.col("conv_id").alias("document")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("parcels"))
    _, rows = files.ingested(t)
    return rows.select("document", F.col("turn").alias("parcel"), F.length("text").cast("long").alias("n"))


# Lines as the stored events of their orders; every third order is judged again and gets its larger lines only


@query("sx26_replaced_rows", "SELECT l_orderkey AS case_id, l_partkey AS part, l_quantity AS n, CASE WHEN l_orderkey % 3 = 0 THEN 'again' ELSE 'first' END AS run FROM lineitem WHERE l_orderkey % 3 <> 0 OR l_quantity > 10")
def sx26(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("case_id"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("n"))
    at = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    first = lines.withColumn("run", F.lit("first"))
    replaced.replace(first, first, at, "case_id")
    again = lines.filter("case_id % 3 = 0")
    for _ in range(2):  # the second time changes nothing
        replaced.replace(again.filter("n > 10").withColumn("run", F.lit("again")), again, at, "case_id")
    return replaced.read(spark, at)


# Each order's lines as the pages of a TIFF: a directory a line; every seventh file is cut short


@query("io2_page_counts", "SELECT o_orderkey, 'image/tiff' AS media_type, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(1 + o_custkey % 9 AS INT) END AS page_count, o_orderkey % 7 = 0 AS failed FROM orders")
def io2b(spark: SparkSession, d: str) -> DataFrame:
    number = lambda n, width: F.unhex(F.concat(*(F.lpad(F.hex(F.shiftright(n.cast("int"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(width))))
    n = 1 + F.col("o_custkey") % 9
    directories = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda k: F.concat(number(F.lit(0), 2), number(F.when(k < n, 8 + 6 * k).otherwise(0), 4)))
    content = F.concat(F.unhex(F.lit("49492A00")), number(F.lit(8), 4), F.unhex(F.array_join(F.transform(directories, lambda x: F.hex(x)), "")))
    content = F.when(F.col("o_orderkey") % 7 == 0, F.substring(content, F.lit(1), F.length(content) - 3)).otherwise(content)
    rows = pages.counted(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", content.alias("content")))
    return rows.select("o_orderkey", "media_type", "page_count", F.col("error").isNotNull().alias("failed"))


# Streams


def _as_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("reviewer"), F.when(F.col("event_type") == "click", "corrected").when(F.col("event_type") == "purchase", "status_changed").otherwise("other").alias("action"), F.col("ts").cast("timestamp").alias("created_at"))


def _drained(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream gives for the data that is there."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("st1_stream_throughput", f"SELECT strftime(date_trunc('day', ts), {T}) AS day, concat('user', CAST(user_id AS VARCHAR)) AS reviewer, count(*) AS events, count(CASE WHEN event_type = 'click' THEN 1 END) AS corrections, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS decisions FROM events GROUP BY 1, 2")
def st1(spark: SparkSession, d: str) -> DataFrame:
    out = _drained(audit.throughput(_as_stream(spark, d)), "st1_throughput")
    return out.select(time_text("start").alias("day"), "reviewer", "events", "corrections", "decisions")


@query("st2_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM o) SELECT concat('user', CAST(user_id AS VARCHAR)) AS reviewer, CAST(max(spell) AS BIGINT) AS spells, count(*) AS events FROM s GROUP BY 1")
def st2(spark: SparkSession, d: str) -> DataFrame:
    e = review_events(spark, d).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return audit.sessions(e).groupBy("reviewer").agg(F.count(F.lit(1)).alias("spells"), F.sum("events").alias("events"))


@query("st3_sla_breaches", f"WITH {PARCELS} SELECT id, priority FROM parcels WHERE sla_due_at < TIMESTAMP '{AS_OF}' AND review_status IN ('pending','in_review','escalated')")
def st3(spark: SparkSession, d: str) -> DataFrame:
    return audit.breaches(parcels(spark, d), as_of()).select("id", "priority")


# Requests are the events of a user in order of time; what lies within the watermark's delay of the last event still waits
_WF7 = f"""
WITH RECURSIVE r AS (SELECT user_id AS p, event_id AS id, ts AS moment, list_extract(['pending','in_review','approved','rejected','escalated'], CAST(event_id % 5 AS INT) + 1) AS target, list_extract(['auditor','operator','reviewer','admin'], CAST(event_id % 4 AS INT) + 1) AS role, list_extract([336, 168, 72, 24], CAST(user_id % 4 AS INT) + 1) AS hours FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY moment, id) AS n, min(moment) OVER (PARTITION BY p) + to_hours(hours) AS due, (SELECT max(moment) FROM r) - INTERVAL 3600500 MILLISECOND AS until FROM r),
s(p, n, id, moment, due, until, was, target, reason, status) AS (
  SELECT p, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP), due, until, CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), 'pending' FROM o WHERE n = 1 AND moment <= until
  UNION ALL
  SELECT o.p, o.n, o.id, o.moment, o.due, o.until, s.status, o.target, c.reason, CASE WHEN c.reason IS NULL THEN o.target ELSE s.status END
  FROM s JOIN o ON o.p = s.p AND o.n = s.n + 1 AND o.moment <= o.until,
  LATERAL (SELECT CASE WHEN s.status = o.target THEN 'already there' WHEN NOT ((s.status = 'pending' AND o.target IN ('in_review','approved','rejected','escalated')) OR (s.status = 'in_review' AND o.target IN ('pending','approved','rejected','escalated')) OR (s.status = 'escalated' AND o.target IN ('in_review','approved','rejected')) OR (s.status IN ('approved','rejected') AND o.target = 'in_review')) THEN 'not allowed' WHEN s.status IN ('approved','rejected') AND o.role NOT IN ('reviewer','admin') THEN 'needs a reviewer' END AS reason) c),
b AS (SELECT p, due, arg_max(status, n) AS status FROM s WHERE due <= until AND (n = 0 OR moment < due) GROUP BY 1, 2)
SELECT p AS parcel_id, id, 'request' AS kind, was, target, reason, status AS review_status, strftime(moment, {T}) AS "at" FROM s WHERE n > 0
UNION ALL SELECT p, NULL, 'breach', status, NULL, NULL, status, strftime(due, {T}) FROM b WHERE status IN ('pending','in_review','escalated')
"""


@query("st4_review_stream", _WF7)
def st4(spark: SparkSession, d: str) -> DataFrame:
    """The adjudication stream, drained."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    pick = lambda key, *values: F.get(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values)).cast("int"))
    rows = e.select(F.col("user_id").alias("parcel_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), pick("event_id", *STATUSES).alias("target"), F.lit("me").alias("actor"), pick("event_id", *ROLES).alias("role"), pick("user_id", "low", "normal", "high", "critical").alias("priority"))
    out = _drained(review.reviewed(rows, "3600.5 seconds"), f"st4_{uuid.uuid4().hex}", "append")
    return out.select("parcel_id", "id", "kind", "was", "target", "reason", "review_status", time_text("at").alias("at"))


@query("st5_stream_dedup", "SELECT source, count(DISTINCT md5(coalesce(text, ''))) AS n FROM documents GROUP BY 1")
def st5(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream: one row of each content of a source."""
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    docs = spark.readStream.schema(schema).parquet(f"{d}/documents.parque[t]")  # a pattern stands for a file as well as for a folder of files
    own = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))  # none is not the empty one
    docs = docs.select("source", F.md5(F.concat_ws("|", own, F.md5(F.coalesce("text", F.lit(""))))).alias("sha256"), F.timestamp_seconds(1_700_000_000 + F.col("doc_id") % 1000).alias("ingested_at"))
    out = _drained(audit.first_of_content(docs), f"st5_{uuid.uuid4().hex}", "append")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
