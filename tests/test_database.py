"""Tables in database files: pushed conditions, ranges, fallback, failed writes."""

import datetime
import decimal

import pyarrow as pa
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from parcelforge.sources import database

COLUMNS = 'id long, name string, price double, day date, cost decimal(12,2), paid boolean, `odd "name` binary'
ROWS = [(i, None if i % 7 == 0 else f"n{i % 5}é", None if i % 11 == 0 else i / 4, None if i % 13 == 0 else datetime.date(1990, 1, 1) + datetime.timedelta(i), decimal.Decimal(i).scaleb(-2), i % 2 == 0 if i % 3 else None, bytes([i % 256, 0])) for i in range(500)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('db')}/t"
    database.store_table(spark.createDataFrame(ROWS, COLUMNS).repartition(3), at, "the rows", roll_rows="100")
    return at


def test_round_trip_by_ranges(spark, stored):
    rows, substituted = database.scan(spark, stored, "the rows", COLUMNS, range_bytes="4096")
    assert not substituted and rows.rdd.getNumPartitions() > 6
    assert sorted(map(tuple, rows.collect())) == sorted(ROWS, key=lambda r: r[0])


CONDITIONS = [
    ("id >= 17 and id < 300", 2),
    ("name = 'n3é'", 2),  # with its own test for null
    ("name is null", 1),
    ("name in ('n1é', 'n2é')", 1),
    ("name like 'n4%'", 2),
    ("not (name = 'n3é')", 2),
    ("day > date'1990-03-01' and price <= 60.5", 4),
    ("cost > 1.5", 1),  # decimals stay with Spark, but for the test for null, which goes
    ("price is null", 0),
    ("paid", 1),
]


@pytest.mark.parametrize("condition, least", CONDITIONS)
def test_conditions_agree(spark, stored, condition, least):
    want = sorted(map(tuple, spark.createDataFrame(ROWS, COLUMNS).filter(condition).collect()), key=lambda r: r[0])
    rows, _ = database.scan(spark, stored, "the rows", COLUMNS, F.expr(condition))
    assert sorted(map(tuple, rows.collect()), key=lambda r: r[0]) == want


def test_pushed_conditions_leave_the_plan(spark, stored):
    plan = lambda c: database.scan(spark, stored, "the rows", "id long, name string", F.expr(c))[0]._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan("id > 5") and "BatchScan database_files" in plan("id > 5")
    assert "Filter (" in plan("length(name) > 2")


def test_conditions_that_may_differ_are_not_pushed(spark):
    schema = spark.createDataFrame([], COLUMNS).schema
    c = lambda f: database.clause(f, schema)
    assert c(ds.EqualTo(("cost",), decimal.Decimal(1))) is None and c(ds.IsNull(("price",))) is None
    assert c(ds.EqualTo(("price",), float("nan"))) is None and c(ds.In(("name",), ("a", None))) is None
    assert c(ds.Not(ds.EqualTo(("cost",), 1))) is None and c(ds.EqualTo(("a", "b"), 1)) is None
    assert c(ds.StringStartsWith(("name",), "é")) == ('substr("name", 1, 1) = ?', ["é"])


def test_fallback(spark, stored, small):
    orders = f"{small}/orders.parquet"
    for at, table, columns in (("file:///nowhere", "orders", "o_orderkey long"), (stored, "orders", "o_orderkey long"), ("no uri", "orders", "o_orderkey long")):
        rows, substituted = database.scan(spark, at, table, columns, F.col("o_orderkey") < 10, fallback=orders)
        assert substituted and rows.columns == ["o_orderkey"] and rows.count() == spark.read.parquet(orders).filter("o_orderkey < 10").count()
        with pytest.raises(database.Unreachable):
            database.scan(spark, at, table, columns)


def test_a_failed_write_adds_nothing(spark, tmp_path):
    at, schema = f"file://{tmp_path}/t", spark.createDataFrame([], "id long").schema
    batch = lambda *ids: iter([pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], ["id"])])
    whole, lost = (database.DatabaseWriter(schema, {"path": at, "table": "t"}) for _ in range(2))
    whole.commit([whole.write(batch(1, 2)), None])
    lost.write(batch(3))  # its driver goes before the manifest
    assert sorted(r.id for r in database.scan(spark, at, "t", "id long")[0].collect()) == [1, 2]
    lost.abort([])
    assert not [f for f in (tmp_path / "t").iterdir() if f.name.startswith(lost.job)]
    with pytest.raises(ValueError):
        database.DatabaseWriter(spark.createDataFrame([], "a array<int>").schema, {"path": at, "table": "t"})


def test_empty_table(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    database.store_table(spark.createDataFrame([], "id long"), at, "t")
    rows, substituted = database.scan(spark, at, "t", "id long")
    assert rows.count() == 0 and not substituted
