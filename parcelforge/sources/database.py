"""Tables in folders of SQLite files as a Spark data source, with a Parquet table to fall back on.

Writing tasks put files of their own into the folder; one manifest a job makes them part of the table, so a
failed write adds nothing.  Scans are planned from file sizes alone: a large file is dealt out by
ranges of row numbers, whose ends each task looks up for itself.  Conditions that mean the same in both
systems go to the database; the others stay with Spark.  Columns that are not asked for are not read.

Dates and decimals are stored as text, booleans as 0 and 1, NaN as null; other types than these, numbers,
text and binary are refused.  Files in a store that is not mounted are opened in memory.
"""

from __future__ import annotations

import json
import sqlite3
import uuid
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows after which a task begins another file, bytes of file in one partition, rows in one batch.
ROLL, RANGE, BATCH = 1_000_000, 64 << 20, 10_000

_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
_STORED = {T.BooleanType: "INTEGER", T.ByteType: "INTEGER", T.ShortType: "INTEGER", T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.FloatType: "REAL", T.DoubleType: "REAL", T.StringType: "TEXT", T.DateType: "TEXT", T.DecimalType: "TEXT", T.BinaryType: "BLOB"}


class Unreachable(RuntimeError):
    """The database has no such table, or cannot be opened."""


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _kinds(schema: T.StructType) -> dict[str, str]:
    bad = [f.name for f in schema if type(f.dataType) not in _STORED]
    if bad:
        raise ValueError(f"columns of types that cannot be stored: {bad}")
    return {f.name: _STORED[type(f.dataType)] for f in schema}


def _open(store: pafs.FileSystem, at: str) -> sqlite3.Connection:
    if isinstance(store, pafs.LocalFileSystem):
        return sqlite3.connect(f"file:{at.replace('%', '%25').replace('?', '%3f').replace('#', '%23')}?mode=ro&immutable=1", uri=True)
    connection = sqlite3.connect(":memory:")
    with store.open_input_stream(at) as f:
        connection.deserialize(f.read())
    return connection


def _files(store: pafs.FileSystem, root: str) -> list[str]:
    """Names of the files that manifests list; a table without rows has a manifest, too."""
    manifests = [f for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.endswith(".manifest")]
    if not manifests:
        raise Unreachable(f"no database at {root}")
    names: list[str] = []
    for f in manifests:
        with store.open_input_stream(f.path) as x:
            names += json.loads(x.read())
    return sorted(names)


@dataclass
class Span(ds.InputPartition):
    file: str
    part: int
    parts: int


@dataclass
class Written(ds.WriterCommitMessage):
    names: list[str]


_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


def clause(f: ds.Filter, schema: T.StructType) -> tuple[str, list] | None:
    """A condition as SQL and its values, or None where the two systems may differ."""
    if isinstance(f, ds.Not):
        inner = clause(f.child, schema)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(f.attribute) != 1 or f.attribute[0] not in schema.names:
        return None
    kind, name = schema[f.attribute[0]].dataType, _quoted(f.attribute[0])
    if isinstance(f, ds.IsNull | ds.IsNotNull) and not isinstance(kind, T.FloatType | T.DoubleType):
        return f"{name} IS {'NOT ' if isinstance(f, ds.IsNotNull) else ''}NULL", []
    values = list(f.value) if isinstance(f, ds.In) else [f.value] if hasattr(f, "value") else []
    if isinstance(kind, T.DateType):
        ready = [v.isoformat() if hasattr(v, "isoformat") and v.year >= 1000 else None for v in values]
    elif isinstance(kind, T.StringType):
        ready = [v if isinstance(v, str) else None for v in values]
    elif isinstance(kind, _NUMBERS):
        ready = [v if isinstance(v, int | float) and not isinstance(v, bool) and v == v else None for v in values]
    else:
        return None
    if not ready or None in ready:
        return None
    if type(f) in _SIGNS:
        return f"{name} {_SIGNS[type(f)]} ?", ready
    if isinstance(f, ds.In):
        return f"{name} IN ({', '.join('?' * len(ready))})", ready
    if isinstance(f, ds.StringStartsWith):
        return f"substr({name}, 1, {len(ready[0])}) = ?", ready
    if isinstance(f, ds.StringContains):
        return f"instr({name}, ?) > 0", ready
    return None


class DatabaseReader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.path, self.table, self.range = options["path"].rstrip("/"), options["table"], int(options.get("range_bytes", RANGE))
        self.columns, self.where, self.values = schema, ["rowid BETWEEN ? AND ?"], []
        _kinds(schema)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for f in filters:
            said = clause(f, self.columns)
            if said is None:
                yield f
            else:
                self.where.append(said[0])
                self.values += said[1]

    def partitions(self) -> list[Span]:
        store, root = pafs.FileSystem.from_uri(self.path)
        names = _files(store, root)
        sizes = [i.size for i in store.get_file_info([f"{root}/{n}" for n in names])]
        return [Span(n, k, parts) for n, size in zip(names, sizes, strict=True) for parts in (max(1, -(-size // self.range)),) for k in range(parts)] or [Span("", 0, 1)]

    def read(self, p: Span) -> Iterator[pa.RecordBatch]:
        if not p.file:
            return
        store, root = pafs.FileSystem.from_uri(self.path)
        arrow = to_arrow_schema(self.columns)
        with closing(_open(store, f"{root}/{p.file}")) as connection:
            first, last = connection.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if first is None:
                return
            n = last - first + 1
            ends = [first + n * p.part // p.parts, first + n * (p.part + 1) // p.parts - 1]
            names = ", ".join(map(_quoted, self.columns.names)) or "1"
            cursor = connection.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE {' AND '.join(self.where)}", ends + self.values)
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([_typed(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=False)], schema=arrow)


def _typed(values: tuple, kind: pa.DataType) -> pa.Array:
    if pa.types.is_date(kind) or pa.types.is_decimal(kind):
        return pa.array(values, pa.string()).cast(kind)
    return pa.array(values, pa.int64()).cast(kind) if pa.types.is_boolean(kind) else pa.array(values, kind)


class DatabaseWriter(ds.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.path, self.table, self.job = options["path"].rstrip("/"), options["table"], uuid.uuid4().hex
        self.kinds, self.roll = _kinds(schema), int(options.get("roll_rows", ROLL))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        columns = ", ".join(f"{_quoted(n)} {k}" for n, k in self.kinds.items())
        names, connection, n = [], None, 0

        def close() -> None:
            connection.commit()
            names.append(f"{self.job}-{uuid.uuid4().hex}.db")
            with store.open_output_stream(f"{root}/{names[-1]}") as out:
                out.write(connection.serialize())
            connection.close()

        for batch in iterator:
            if connection is None:
                connection, n = sqlite3.connect(":memory:"), 0
                connection.execute(f"CREATE TABLE {_quoted(self.table)} ({columns})")
            flat = [c.cast(pa.string()) if pa.types.is_date(c.type) or pa.types.is_decimal(c.type) else c for c in batch.columns]
            connection.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(flat))})", zip(*(c.to_pylist() for c in flat), strict=True))
            n += batch.num_rows
            if n >= self.roll:
                close()
                connection = None
        if connection is not None:
            close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        open_ = f"{root}/{self.job}.open"
        with store.open_output_stream(open_) as out:
            out.write(json.dumps([n for m in messages if m for n in m.names]).encode())
        store.move(open_, f"{root}/{self.job}.manifest")  # from here on the files belong to the table

    def abort(self, messages: list[Written | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        for f in store.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(self.job):
                store.delete_file(f.path)


class DatabaseSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "database_files"

    def schema(self) -> T.StructType:
        raise ValueError("give the columns to read as a schema")

    def reader(self, schema: T.StructType) -> DatabaseReader:
        return DatabaseReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> DatabaseWriter:
        return DatabaseWriter(schema, dict(self.options))


def store_table(df: DataFrame, path: str, table: str, **options: str) -> None:
    """Add rows to the table in a folder of database files."""
    df.sparkSession.dataSource.register(DatabaseSource)
    df.write.format("database_files").options(path=path, table=table, **options).mode("append").save()


def reachable(path: str, table: str, columns: tuple[str, ...]) -> None:
    """Asks one file of the folder for the columns; Unreachable says why it cannot be read."""
    try:
        store, root = pafs.FileSystem.from_uri(path.rstrip("/"))
        names = _files(store, root)
        if not names:
            return
        with closing(_open(store, f"{root}/{names[0]}")) as connection:
            known = [r[1] for r in connection.execute(f"PRAGMA table_info({_quoted(table)})")]
    except (OSError, ValueError, sqlite3.Error) as e:
        raise Unreachable(f"{path}: {e}") from e
    if missing := set(columns) - set(known):
        raise Unreachable(f"{path}: {table} has no {sorted(missing)}")


def scan(spark: SparkSession, path: str, table: str, columns: T.StructType | str, condition: Column | None = None, fallback: str | None = None, **options: str) -> tuple[DataFrame, bool]:
    """Columns of a table under a condition, and whether they come from the Parquet table ``fallback``, as the database could not be read; without one this is Unreachable."""
    schema = T.StructType.fromDDL(columns) if isinstance(columns, str) else columns
    try:
        reachable(path, table, tuple(schema.names))
        substituted = False
    except Unreachable:
        if fallback is None:
            raise
        substituted = True
    if substituted:
        rows = spark.read.parquet(fallback).select(*schema.names)
    else:
        spark.dataSource.register(DatabaseSource)
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        rows = spark.read.format("database_files").schema(schema).options(path=path, table=table, **options).load()
    return (rows if condition is None else rows.filter(condition)), substituted
