"""Literal cases of the scalar functions, against stated values."""

import compare
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions import areas, dates, identifiers, names, numerals, shares, units, vocabulary
from parcelforge.plans.registry import Registry

query = Registry()


def _rows(spark: SparkSession, values: list, schema: str = "id int, raw string") -> DataFrame:
    return spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], schema)


def _expected(values: list[tuple], names_: tuple[str, ...], casts: tuple[str, ...]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(lit(x) for x in (i, *v))})" for i, v in enumerate(values))
    cols = ", ".join(f"CAST(c{k} AS {t}) AS {n}" for k, (n, t) in enumerate(zip(names_, casts, strict=True)))
    return f"SELECT {cols} FROM (VALUES {rows}) t({', '.join(f'c{k}' for k in range(len(names_)))})"


def _decimal(c):
    return c.cast("double")


DIGITS = ["१२३", "૦-૮૦-૦૫", "Khasra 45/2", "सर्वे नं. १४२", "٣٤", "", None]


@query("sc1_ascii_digits", _expected([("123",), ("0-80-05",), ("Khasra 45/2",), ("सर्वे नं. 142",), ("34",), ("",), (None,)], ("id", "out"), ("INT", "VARCHAR")))
def sc1(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, DIGITS).select("id", numerals.ascii_digits(F.col("raw")).alias("out"))


@query("sc2_multilingual", _expected([("Devanagari", False), ("Latin", False), ("Devanagari", True), ("Unknown", False)], ("id", "dominant", "mixed"), ("INT", "VARCHAR", "BOOLEAN")))
def sc2b(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, ["सर्वे नंबर", "Survey number", "सर्वे नंबर गाव abc", " -- "])
    return t.select("id", numerals.dominant_script(F.col("raw")).alias("dominant"), numerals.is_multilingual(F.col("raw")).alias("mixed"))


@query("sc3_repair", _expected([("0-80-05",), ("5o1apur".replace("o", "0"),), ("1217",)], ("id", "out"), ("INT", "VARCHAR")))
def sc3(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, ["O-8O-O5", "So1apur", "l2I7"]).select("id", numerals.repaired(F.col("raw")).alias("out"))


@query("sc5_parse_decimal", _expected([(123.45,), (125000,), (None,), (-3.5,), (None,), (12,)], ("id", "out"), ("INT", "DOUBLE")))
def sc5(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, ["१२३.४५", "Rs. 1,25,000/-", "---", "-3.5 x 7", None, "₹ 12"]).select("id", _decimal(numerals.decimal_of(F.col("raw"))).alias("out"))


@query("sc6_parse_int", _expected([(12,), (-7,), (None,), (125000,)], ("id", "out"), ("INT", "BIGINT")))
def sc6(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, ["12.9", "-7.9", "x", "1,25,000"]).select("id", numerals.int_of(F.col("raw")).alias("out"))


@query("sc7_components", _expected([("0;80;5",), ("1;20;0",), ("1.205",), ("0;80;5",), ("",), ("2;8",)], ("id", "out"), ("INT", "VARCHAR")))
def sc7(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, ["0-80-05", "१-२०-००", "1.205", "0.80.05", "", "2/8"])
    text = F.array_join(F.transform(numerals.components(F.col("raw")), lambda x: F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")), ";")
    return t.select("id", text.alias("out"))


AREAS = [("0-80-05", "metric_ha_are_sqm", None), ("8005 sq.m.", None, None), ("1.20 Ha", None, None), ("1 acre 20 guntha", None, None), ("1.20", "metric_ha_are_sqm", None), ("2 bigha 10 biswa", None, None), ("2 bigha 10 biswa", None, "gujarat"), ("2/8", "kanal_marla", None), ("1-2-3-4", "metric_ha_are_sqm", None), ("हे ०-८०", "metric_ha_are_sqm", None), (None, None, None), ("500", "sq_metre", None)]


@query("sc9_parse_area", _expected([(8005, "metric_ha_are_sqm", None), (8005, "metric_ha_are_sqm", None), (12000, "metric_ha_are_sqm", None), (6070.2846, "acre_guntha", None), (None, None, None), (None, None, "bigha needs a region"), (4046.8564, "bigha_biswa", None), (1214.0569, "kanal_marla", None), (None, None, None), (8000, "metric_ha_are_sqm", None), (None, None, None), (500, "sq_metre", None)], ("id", "sq_metre", "unit_system", "error"), ("INT", "DOUBLE", "VARCHAR", "VARCHAR")))
def sc9(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, AREAS, "id int, raw string, system string, region string").withColumn("a", areas.parse(F.col("raw"), F.col("system"), F.col("region")))
    return t.select("id", _decimal(F.col("a.sq_metre")).alias("sq_metre"), "a.unit_system", "a.error")


@query("sc15_native", _expected([("0-80-05.00 H-R-Sq.M",), ("1 acre 20.00 guntha",), ("2 kanal 8.00 marla",), ("1.2000 ha",), ("55.50 sq m",)], ("id", "out"), ("INT", "VARCHAR")))
def sc15b(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, [("8005", "metric_ha_are_sqm"), ("6070.2846336", "acre_guntha"), ("1214.05692672", "kanal_marla"), ("12000", "hectare"), ("55.5", "unknown")], "id int, raw string, system string")
    return t.select("id", units.native(F.col("raw").cast("decimal(28,10)"), F.col("system")).alias("out"))


SHARES = ["1/3", "0.3333", "33.33%", "0.25", "0.5", "0.123", "0.2", "5/3", "समान", "१/४", "50%", "100%", "whole", "1", "0.12345678", None, "junk", "3 : 8"]


@query("sc17_parse_share", _expected([(1, 3), (1, 3), (1, 3), (1, 4), (1, 2), (123, 1000), (1, 5), (None, None), (None, None), (1, 4), (1, 2), (1, 1), (1, 1), (1, 1), (10, 81), (None, None), (None, None), (3, 8)], ("id", "num", "den"), ("INT", "BIGINT", "BIGINT")))
def sc17(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, SHARES).withColumn("s", shares.parse(F.col("raw")))
    return t.select("id", "s.num", "s.den")


@query("sc19_equal_marker", _expected([(True,), (True,), (False,), (False,)], ("id", "out"), ("INT", "BOOLEAN")))
def sc19(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, ["Equal-share", "समान", "1/2", None]).select("id", shares.is_equal_marker(F.col("raw")).alias("out"))


DATES = ["03/04/2019", "१५-०८-२०२१", "junk", "3.4.2019", "5/6/68", "5/6/70", "2020-02-30", "2020-02-29", "4 March 1999", "4 Mar 1999", "07/2015", "1988", "Jan 5, 2001", "1-2/2003", None]


@query("sc20_parse_date", _expected([("2019-04-03",), ("2021-08-15",), (None,), ("2019-04-03",), ("2068-06-05",), ("1970-06-05",), (None,), ("2020-02-29",), ("1999-03-04",), ("1999-03-04",), ("2015-07-01",), ("1988-01-01",), ("2001-01-05",), (None,), (None,)], ("id", "out"), ("INT", "VARCHAR")))
def sc20(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, DATES).select("id", F.date_format(dates.parse(F.col("raw")), "yyyy-MM-dd").alias("out"))


@query("sc21_revenue_year", _expected([("2019-01-01",), ("1985-01-01",), (None,), (None,)], ("id", "out"), ("INT", "VARCHAR")))
def sc21(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, ["2019-20", "सन १९८५", "1700", None]).select("id", F.date_format(dates.revenue_year_start(F.col("raw")), "yyyy-MM-dd").alias("out"))


VOCAB = [("चाही", "irrigated", 1.0), ("Gair Mumkin", "non_cultivable", 1.0), ("land: gair mumkin (rocks)", "non_cultivable", 0.95), ("nahree", "irrigated", None), ("xyzzy", "unknown", None), (None, "unknown", 0.0)]


@query("sc24_resolve", _expected([(v, s) for _, v, s in VOCAB[:3]] + [("irrigated", None), ("unknown", None), ("unknown", 0.0)], ("id", "value", "score"), ("INT", "VARCHAR", "DOUBLE")))
def sc24(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, [v[0] for v in VOCAB]).withColumn("r", vocabulary.resolve(F.col("raw"), "classification"))
    return t.select("id", "r.value", F.when(F.col("r.score").isin(0.0, 0.95, 1.0) & ~F.col("id").isin(3, 4), F.col("r.score")).alias("score"))


@query("sc25_resolvers", _expected([("tenure", "occupant_class_i"), ("mutation_type", "inheritance"), ("mutation_status", "sanctioned"), ("encumbrance_type", "mortgage"), ("encumbrance_status", "discharged"), ("irrigation", "tubewell"), ("relation", "widow_of")], ("id", "domain", "value"), ("INT", "VARCHAR", "VARCHAR")))
def sc25(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, [("भोगवटादार वर्ग-१", "tenure"), ("वारस", "mutation_type"), ("MANJUR", "mutation_status"), ("गहाण", "encumbrance_type"), ("मुक्त", "encumbrance_status"), ("Borewell", "irrigation"), ("Wd/o", "relation")], "id int, raw string, domain string")
    value = None
    for name in vocabulary.ALIASES:
        v = vocabulary.resolve(F.col("raw"), name, fuzzy=False)["value"]
        value = F.when(F.col("domain") == name, v) if value is None else value.when(F.col("domain") == name, v)
    return t.select("id", "domain", value.alias("value"))


@query("sc27_normalize_name", _expected([("ramesh sharma",), ("ramesh sharma",), ("sharma ramesh",), ("karthikeyan r",), ("",), ("ramesh",), ("रमेश शर्मा",)], ("id", "out"), ("INT", "VARCHAR")))
def sc27(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, ["Shri Ramesh Sharma", "Late Ramesh  Sharma s/o Hari Singh", "Sharma, Ramesh", "Karthikeyan R.", None, "Ramesh W/O Kamla", "श्री रमेश शर्मा"])
    return t.select("id", names.normalized(F.col("raw")).alias("out"))


PEOPLE = [("Ramesh Sharma", "Shri Ramesh Sharma", True), ("Ramesh Sharma", "Sharma Ramesh", True), ("Ramesh Sharma", "Late Ramesh Sharma", True), ("Ramesh Sharma", "Ramesh Sharrma", True), ("Karthikeyan R", "Karthikeyan Ramasamy", True), ("Ramesh Sharma", "Mahesh Kulkarni", False), ("Amit Sharma", "Sumit Verma", False), ("Sita Sharma", "Gita Sharma", False), ("", "x", False)]


@query("sc30_name_similarity", _expected([(m,) for _, _, m in PEOPLE], ("id", "matched"), ("INT", "BOOLEAN")))
def sc30(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, [(a, b) for a, b, _ in PEOPLE], "id int, a string, b string")
    return t.select("id", names.is_match(names.similarity(F.col("a"), F.col("b"))).alias("matched"))


IDS = ["125/2", " 125 / 2 ", "125-2", "0125/2", "१२५/२", "125", None, "  "]


@query("sc32_normalize_identifier", _expected([("125/2",)] * 5 + [("125",), ("",), ("",)], ("id", "out"), ("INT", "VARCHAR")))
def sc32(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, IDS).select("id", identifiers.normalized(F.col("raw")).alias("out"))


@query("sc34_compare_identifier", _expected([("equal",), ("related",), ("different",), (None,), (None,), ("related",)], ("id", "out"), ("INT", "VARCHAR")))
def sc34(spark: SparkSession, d: str) -> DataFrame:
    t = _rows(spark, [("125/2", "०१२५-2"), ("125", "125/2"), ("125", "1250"), (None, "1"), ("", ""), ("7/1/2", "7/1")], "id int, a string, b string")
    return t.select("id", identifiers.compared(F.col("a"), F.col("b")).alias("out"))


def test_unit_words_are_rounded_once(spark, con, tmp_path):
    """1366 square yards are 1142.14997 square metres, of which four places are 1142.1500."""
    from parcelforge.plans import extras

    spark.createDataFrame([(4, 1366), (9, 5291), (14, 2905), (2, 1366), (5, 7), (6, None)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.area for r in extras.query.queries["sc8_unit_words"](spark, str(tmp_path)).collect()}
    assert got == {4: 1142.1, 9: 4423.9, 14: 2428.9, 2: 126.9, 5: 7.0, 6: None}
    assert compare.differences(extras.query.queries["sc8_unit_words"](spark, str(tmp_path)), extras.query.oracle["sc8_unit_words"], compare.oracle(str(tmp_path))) == ""


def test_unrounded_area_knows_regions(spark):
    t = _rows(spark, [("3 biswansi", "gujarat"), ("2 acre 1 guntha", None)], "id int, raw string, region string").select("id", areas.parse(F.col("raw"), region=F.col("region")).alias("a"))
    assert [r.x for r in t.orderBy("id").select((areas.unrounded(F.col("a")).cast("double")).alias("x")).collect()] == [3 * 1936 * 0.83612736 / 400, 2 * 4046.8564224 + 101.17141056]


def test_all_kinds_of_names_are_compared(spark, small):
    from parcelforge.plans import scalars

    parts = spark.read.parquet(f"{small}/part.parquet").count()
    got = {r.kind: (r.n, r.yes) for r in scalars.query.queries["sc30_name_similarity"](spark, small).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("matched").cast("int")).alias("yes")).collect()}
    assert {k: n for k, (n, _) in got.items()} == dict.fromkeys(("title", "order", "late", "doubled", "initial", "others", "first", "next", "none"), parts)
    assert all(got[k][1] == parts for k in ("title", "order", "late", "doubled", "initial")) and got["others"][1] == got["none"][1] == 0
    assert got["first"][1] < parts and 0 < got["next"][1] < parts


@pytest.mark.parametrize("name", sorted(query.queries))
def test_literal_cases(spark, small, con, name):
    assert compare.differences(query.queries[name](spark, small), query.oracle[name], con) == ""
