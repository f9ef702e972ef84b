"""Literal cases of display, mapping and export functions, against stated values."""

import compare
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import areas, display, names
from parcelforge.operators import docmap
from parcelforge.plans.mapping import _wire, tokens
from parcelforge.plans.registry import Registry
from parcelforge.plans.views import as_of
from parcelforge.sources import exports, files

query = Registry()


@query("sc8_unit_words", "SELECT * FROM (VALUES (0, CAST(25 AS DOUBLE)), (1, CAST(2.5 AS DOUBLE)), (2, CAST(9.2903 AS DOUBLE)), (3, CAST(100 AS DOUBLE)), (4, CAST(8.3613 AS DOUBLE))) t(id, area)")
def sc8(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(0, "25 Sq. Mtrs"), (1, "2.5 चौ.मी."), (2, "100 sq. ft"), (3, "1 आर"), (4, "10 Sq.Yds")], "id int, raw string")
    return t.select("id", areas.parse(F.col("raw"))["sq_metre"].cast("double").alias("area"))


@query("sc29_token_similarity", "SELECT * FROM (VALUES (0, CAST(1 AS DOUBLE)), (1, CAST(0.92 AS DOUBLE)), (2, CAST(0.8433 AS DOUBLE)), (3, CAST(0 AS DOUBLE))) t(id, score)")
def sc29(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(0, "sharma ramesh", "ramesh sharma"), (1, "karthikeyan r", "karthikeyan ramasamy"), (2, "a b c", "a b"), (3, "", "x")], "id int, a string, b string")
    return t.select("id", names.folded_similarity("a", "b").alias("score"))


@query("sc45_formatters", "SELECT * FROM (VALUES ('1,23,456', '12%', '1.5 KB', 'in 3 days', 'Mutation date in future', 'RS', '1.2000 ha', '55.5 m²')) t(count, percent, size, due, title, initials, area, small)")
def sc45(spark: SparkSession, d: str) -> DataFrame:
    now = as_of()
    return spark.range(1).select(
        display.indian_count(F.lit(123456)).alias("count"), display.percent(F.lit(0.123)).alias("percent"), display.file_size(F.lit(1536)).alias("size"), display.relative(now + F.expr("INTERVAL 3 DAYS"), now).alias("due"),
        display.rule_title(F.lit("MUTATION_DATE_IN_FUTURE")).alias("title"), display.initials(F.lit("ramesh  sharma k")).alias("initials"), display.area(F.lit(12000.0)).alias("area"), display.area(F.lit(55.5)).alias("small"),
    )


@query("sc47_axis_steps", "SELECT * FROM (VALUES (1, CAST(1 AS DOUBLE)), (3, CAST(5 AS DOUBLE)), (20, CAST(20 AS DOUBLE)), (70, CAST(100 AS DOUBLE)), (0, CAST(1 AS DOUBLE))) t(v, step)")
def sc47(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(1,), (3,), (20,), (70,), (0,)], "v int").select("v", display.nice_step(F.col("v").cast("double")).alias("step"))


@query("dm1_token_filter", "SELECT * FROM (VALUES ('easy', 4), ('tess', 3)) t(engine, n)")
def dm1(spark: SparkSession, d: str) -> DataFrame:
    return docmap.kept_tokens(tokens(spark)).groupBy("engine").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("sc42_markdown", "SELECT 'p' AS page, concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| 1 | x\\|y |') AS \"table\"")
def sc42(spark: SparkSession, d: str) -> DataFrame:
    return docmap.markdown(spark.createDataFrame([("p", 0, 0, "a"), ("p", 0, 1, "b"), ("p", 1, 0, "1"), ("p", 1, 1, "x|y")], "page string, row int, col int, text string"))


@query("sx25_labelled_text", "SELECT * FROM (VALUES (0, 'Ramesh Sharma', '01/05/2021', 0, CAST(1 AS DOUBLE)), (1, 'Ramesh', NULL, 2, CAST(1 AS DOUBLE)), (2, NULL, NULL, 0, CAST(0 AS DOUBLE))) t(id, name, died, heirs, confidence)")
def sx25(spark: SparkSession, d: str) -> DataFrame:
    rows = [(0, "death_certificate", "GOVT\nName of the Deceased : Ramesh Sharma\nDate of Death: 01/05/2021\nName: other"), (1, "legal_heir_certificate", "Name: Ramesh\nWife : Sita\nSon 1: Amit"), (2, "death_certificate", "nothing here")]
    t = spark.createDataFrame(rows, "id int, kind string, text string").withColumn("f", docmap.labelled_fields(F.col("text")))
    return t.select("id", F.try_element_at("f.fields", F.lit("name")).alias("name"), F.try_element_at("f.fields", F.lit("date_of_death")).alias("died"), F.size("f.heirs").alias("heirs"), docmap.text_confidence(F.col("f"), F.col("kind")).cast("double").alias("confidence"))


@query("sc39_write_path", "SELECT * FROM (VALUES (0, '9'), (1, NULL), (2, '5'), (3, NULL)) t(id, value)")
def sc39(spark: SparkSession, d: str) -> DataFrame:
    rows = [(0, '{"a": [{"b": 1}]}', "$.a[0].b", "9", "$.a[0].b"), (1, '{"a": []}', "$.a[0].b", "9", "$.a[0].b"), (2, "{}", "$.n", "5", "$.n"), (3, "broken", "$.n", "5", "$.n")]
    t = spark.createDataFrame(rows, "id int, json string, path string, value string, back string").withColumn("j", docmap.write_path("json", "path", "value"))
    return t.select("id", F.coalesce(F.get_json_object("j", "$.a[0].b"), F.get_json_object("j", "$.n")).alias("value"))


@query("io9_rekey_provenance", "SELECT * FROM (VALUES ('$.owners[0]', 'x')) t(path, value)")
def io9(spark: SparkSession, d: str) -> DataFrame:
    t = spark.range(1).select(F.create_map(F.lit("$.parcels[1].owners[0]"), F.lit("x"), F.lit("$.parcels[0].a"), F.lit("y")).alias("p"))
    return t.select(F.explode(files.rekeyed(F.col("p"), 1)).alias("path", "value"))


@query("io16_share_text", "SELECT * FROM (VALUES (0, '1/3'), (1, 'equal'), (2, NULL)) t(id, out)")
def io16(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([(0, (1, 3), "x"), (1, None, "equal"), (2, None, None)], "id int, s struct<num:bigint,den:bigint>, raw string")
    return t.select("id", exports.share_text(F.col("s"), F.col("raw")).alias("out"))


@query("dm6_wire_parcels", "SELECT * FROM (VALUES ('good', 0, '125/2', CAST(12000 AS DOUBLE)), ('good', 1, '7', CAST(8005 AS DOUBLE))) t(document, parcel, survey, area)")
def dm6(spark: SparkSession, d: str) -> DataFrame:
    p = docmap.parcels(_wire(spark))
    return p.select("document", "parcel", F.col("p.survey_number").alias("survey"), docmap.wire_area(F.col("p.total_area"), F.col("system"))["sq_metre"].cast("double").alias("area"))


@query("io10_batch_isolation", "SELECT * FROM (VALUES ('bad', 'not readable')) t(document, reason)")
def io10(spark: SparkSession, d: str) -> DataFrame:
    _, failed = files.split_batch(_wire(spark), F.col("corrupt"), F.lit("not readable"))
    return failed.select("document", "reason")


@query("dm7_owners", "SELECT * FROM (VALUES (0, 'son_of', 'owner', CAST(1 AS BIGINT), CAST(3 AS BIGINT), NULL, true), (1, 'unknown', 'unknown', NULL, NULL, 'no name', false), (2, 'unknown', 'unknown', NULL, NULL, 'unresolved tenure', true)) t(i, relation, tenure, num, den, warning, kept)")
def dm7(spark: SparkSession, d: str) -> DataFrame:
    return docmap.owners(docmap.parcels(_wire(spark))).select("i", "relation", "tenure", "share.num", "share.den", "warning", "kept")


@query("dm7_mutations", "SELECT * FROM (VALUES ('1', 'inheritance', 'sanctioned', 'order before entry', false), ('2', 'sale', 'pending', NULL, true)) t(number, mutation_type, status, warning, kept)")
def dm7b(spark: SparkSession, d: str) -> DataFrame:
    return docmap.mutations(docmap.parcels(_wire(spark))).select("number", "mutation_type", "status", "warning", "kept")


@query("dm7_encumbrances", "SELECT * FROM (VALUES (0, 'mortgage', 'discharged'), (1, 'bank_charge', 'active')) t(i, encumbrance_type, status)")
def dm7c(spark: SparkSession, d: str) -> DataFrame:
    return docmap.encumbrances(docmap.parcels(_wire(spark))).select("i", "encumbrance_type", "status")


@query("dm8_field_confidence", "SELECT path, CAST(c AS DOUBLE) AS confidence FROM (VALUES ('$.parcels[0].owners[0]', 0.4), ('$.parcels[0].owners[2]', 0.95)) t(path, c)")
def dm8(spark: SparkSession, d: str) -> DataFrame:
    w = _wire(spark)
    paths = docmap.owners(docmap.parcels(w)).filter("kept").select("document", "path")
    return docmap.field_confidence(w.filter(~F.col("corrupt")), paths).select("path", "confidence")


@pytest.mark.parametrize("name", sorted(query.queries))
def test_literal_cases(spark, small, con, name):
    assert compare.differences(query.queries[name](spark, small), query.oracle[name], con) == ""
