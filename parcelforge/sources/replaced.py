"""Stored tables whose rows are replaced by key, all at once: buckets of Parquet files and a manifest that names them.

Rows lie in a fixed number of buckets by the hash of their key. A write puts new files of the touched
buckets beside the old ones, and then a new manifest, which is created in one step under the next number: readers see
all of the write or nothing of it, and of two writers one fails. The manifest has one entry a bucket.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class Conflict(RuntimeError):
    """Another write came first; read again and repeat."""


def _files(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, at: str) -> tuple[int, dict]:
    """Number and content of the last manifest; 0 for a table that is not there."""
    path, files = _files(spark, f"{at}/manifests")
    if not files.exists(path):
        return 0, {}
    last = max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(path) if f.getPath().getName().endswith(".json")), default=0)
    return (last, json.loads(spark.read.text(f"{at}/manifests/{last}.json", wholetext=True).first()[0])) if last else (0, {})


def _commit(spark: SparkSession, at: str, number: int, content: dict) -> None:
    path, files = _files(spark, f"{at}/manifests/{number}.json")
    try:
        out = files.create(path, False)  # fails where the number is taken
    except Exception as e:
        raise Conflict(f"manifest {number} of {at} is there already") from e
    try:
        out.write(bytearray(json.dumps(content).encode()))
    finally:
        out.close()


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, at: str) -> DataFrame:
    """The table as of its last manifest."""
    number, manifest = _manifest(spark, at)
    if not number:
        raise FileNotFoundError(at)
    schema = manifest["schema"]
    paths = sorted(set(manifest["buckets"].values()))
    return spark.read.schema(schema).parquet(*(f"{at}/{p}" for p in paths)) if paths else spark.createDataFrame([], schema)


def replace(rows: DataFrame, touched: DataFrame, at: str, key: str, buckets: int = BUCKETS) -> int:
    """Rows of all keys in ``touched`` (``key``) become those in ``rows``; gives the manifest's number.

    Rows of other keys stay; keys in ``rows`` count as touched. Only buckets with a touched key are written again.
    Columns keep the order and types of the first write.
    """
    spark = rows.sparkSession
    number, manifest = _manifest(spark, at)
    buckets = manifest.get("n", buckets)
    names = [c for c in rows.columns]
    schema = manifest.get("schema") or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    if number:
        names = spark.createDataFrame([], schema).columns
        rows = rows.select(names)
    keys = touched.select(F.col(key).alias("__key")).unionByName(rows.select(F.col(key).alias("__key"))).distinct()
    hit = sorted(r[0] for r in keys.select(_bucket(F.col("__key"), buckets)).distinct().collect())  # at most as many as there are buckets
    old = {int(k): p for k, p in manifest.get("buckets", {}).items()}
    kept = [old[k] for k in hit if k in old]
    new = rows
    if kept:
        stay = spark.read.schema(schema).parquet(*(f"{at}/{p}" for p in kept)).join(keys, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
        new = stay.select(names).unionByName(rows)
    write = f"data/{uuid.uuid4().hex}"
    new.withColumn("__bucket", _bucket(F.col(key), buckets)).repartition(max(1, len(hit)), "__bucket").write.partitionBy("__bucket").parquet(f"{at}/{write}")
    path, files = _files(spark, f"{at}/{write}")
    made = {int(f.getPath().getName().split("=")[1]) for f in files.listStatus(path) if "=" in f.getPath().getName()}
    now = {k: p for k, p in old.items() if k not in hit} | {k: f"{write}/__bucket={k}" for k in made}
    _commit(spark, at, number + 1, {"n": buckets, "schema": schema, "buckets": {str(k): p for k, p in now.items()}})
    return number + 1
