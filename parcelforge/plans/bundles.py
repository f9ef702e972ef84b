"""Literal cases of the bundle engine for the tests, and its relational parts over the driver's tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bundle
from .registry import Registry

query = Registry()
D = datetime.date


def parcel(khasra="125", village="Angol", area=50000.0, khata=None):
    return (khasra, khata, None, village, None, "Belagavi", "Karnataka", area)


def owner(name, share=None, relation="unknown", relative=None):
    return (name, relation, relative, share)


def _case(case_id, **over):
    base = {
        "snapshots": [("old", "jamabandi", D(2015, 1, 1), False, parcel(), [owner("Ramesh Sharma", (1, 1))], True), ("new", "updated_jamabandi", D(2023, 1, 1), False, parcel(), [owner("Amit Sharma", (1, 1))], True)],
        "deaths": [("Shri Ramesh Sharma", D(2021, 5, 1), True)],
        "heirs": [("Amit Sharma", "son_of", "Ramesh Sharma", None), ("Sunita Kulkarni", "daughter_of", "Ramesh Sharma", None), ("Vijay Patil", "son_of", "Ramesh Sharma", None)],
        "mutations": [("M1", "inheritance", "sanctioned", D(2022, 1, 1), D(2022, 2, 1), parcel(), None, [owner("Ramesh Sharma")], [owner("Amit Sharma", (1, 1))], True)],
        "documents": [],
    } | over
    return (case_id, "key", *(base[k] for k in ("snapshots", "deaths", "heirs", "mutations", "documents")))


def _moved(**over):
    m = {"parcel": parcel(), "area": None, "status": "sanctioned", "order": D(2022, 2, 1), "entry": D(2022, 1, 1), "before": [owner("Ramesh Sharma")], "after": [owner("Amit Sharma", (1, 1))]} | over
    return ("M1", "inheritance", m["status"], m["entry"], m["order"], m["parcel"], m["area"], m["before"], m["after"], True)


def _pair(second, first=None):
    old = first or ("old", "jamabandi", D(2015, 1, 1), False, parcel(), [owner("Ramesh Sharma", (1, 1))], True)
    return [old, second]


def _deed(executants, beneficiaries=("Amit Sharma",)):
    return ("relinquishment_deed", "deed", D(2021, 9, 1), [owner(n) for n in executants], [owner(n) for n in beneficiaries], True)


_NEW = ("new", "updated_jamabandi", D(2023, 1, 1), False, parcel(), [owner("Amit Sharma", (1, 1))], True)


def cases() -> list[tuple]:
    none = (None,) * 8
    return [
        _case("base"),
        _case("no_land", mutations=[_moved(parcel=none)]),
        _case("sole_heir", heirs=[("Amit Sharma", "son_of", "Ramesh Sharma", None)]),
        _case("wrong_deceased", deaths=[("Mahesh Kulkarni", D(2021, 5, 1), True)]),
        _case("other_khasra", snapshots=_pair((*_NEW[:4], parcel("311/1"), *_NEW[5:]))),
        _case("hissa", snapshots=_pair((*_NEW[:4], parcel("125/2"), *_NEW[5:]))),
        _case("larger", snapshots=_pair((*_NEW[:4], parcel(area=62000.0), *_NEW[5:]))),
        _case("smaller", snapshots=_pair((*_NEW[:4], parcel(area=30000.0), *_NEW[5:]))),
        _case("close", snapshots=_pair((*_NEW[:4], parcel(area=50000.4), *_NEW[5:]))),
        _case("deed_both", documents=[_deed(["Sunita Kulkarni", "Vijay Patil"])]),
        _case("deed_one", documents=[_deed(["Sunita Kulkarni"])]),
        _case("deed_other", documents=[_deed(["Nobody Atall"], ["Stranger Person"])]),
        _case("no_mutation", mutations=[]),
        _case("early", mutations=[_moved(order=D(2020, 1, 1), entry=D(2019, 1, 1))]),
        _case("chain", snapshots=[("a", "jamabandi", D(2010, 1, 1), False, parcel(), [owner("Ramesh Sharma", (1, 1))], True), ("b", "jamabandi", D(2022, 1, 1), False, parcel(), [owner("Vijay Patil", (1, 1))], True), ("c", "updated_jamabandi", D(2025, 1, 1), False, parcel(), [owner("Amit Sharma", (1, 1))], True)], mutations=[], deaths=[], heirs=[]),
        _case("not_updated", snapshots=_pair((*_NEW[:5], [owner("Ramesh Sharma", (1, 1))], True)), mutations=[]),
        _case("approximate", deaths=[("Ramesh Sharrna", D(2021, 5, 1), True)], heirs=[("Amit Sharma", "son_of", "Ramesh Sharma", None)]),
        _case("empty", snapshots=[], deaths=[], heirs=[], mutations=[]),
    ]


#: (case, outcome, level, score). What each case must give.
EXPECTED = [
    ("base", "review_required", "high", 46.75), ("no_land", "review_required", "high", 62.5), ("sole_heir", "validated", "low", 0.0), ("wrong_deceased", "inconsistent", "high", 40.0),
    ("other_khasra", "inconsistent", "critical", 96.75), ("hissa", "review_required", "high", 69.25), ("larger", "inconsistent", "critical", 76.75), ("smaller", "review_required", "high", 60.25),
    ("close", "review_required", "high", 46.75), ("deed_both", "validated", "low", 0.0), ("deed_one", "incomplete", "medium", 24.75), ("deed_other", "inconsistent", "critical", 100.0),
    ("no_mutation", "review_required", "critical", 100.0), ("early", "inconsistent", "critical", 91.75), ("chain", "review_required", "critical", 89.75), ("not_updated", "incomplete", "low", 6.75),
    ("approximate", "incomplete", "low", 2.7), ("empty", "validated", "low", 0.0),
]


def reports(spark: SparkSession) -> DataFrame:
    return bundle.validate(spark.createDataFrame(cases(), bundle.CASE))


@query("jn12_identifier_intersection", "SELECT a.l_orderkey AS left_key, count(*) AS shared FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O') a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F') b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey GROUP BY 1")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet").filter("l_linestatus in ('O', 'F')")
    return bundle.shared_identifiers(t, "l_orderkey", F.col("l_linestatus") == "O", "l_suppkey").withColumnRenamed("l_orderkey", "left_key")


@query("jn13_death_conflicts", "SELECT a.l_orderkey AS k, count(*) AS conflicts FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey % 10 = b.l_partkey % 10 AND a.l_shipdate < b.l_shipdate GROUP BY 1")
def jn13(spark: SparkSession, d: str) -> DataFrame:
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 10).alias("person"), "l_shipdate")
    return bundle.death_conflicts(t, "k", "person", "l_shipdate")


@query("jn18_event_in_window", "SELECT o_orderkey, count(*) AS events FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND (l_shipdate IS NULL OR (l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAY)) GROUP BY 1")
def jn18(spark: SparkSession, d: str) -> DataFrame:
    o, li = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    return bundle.events_in_window(o, li, "o_orderkey", "o_orderdate", F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"), "l_orderkey", "l_shipdate")
