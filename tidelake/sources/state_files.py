"""Tables of SQLite files as a Spark source: split by row ids, conditions and top rows decided in the files.

    spark.dataSource.register(SqliteSource)
    spark.read.format("sqlite").option("path", "/shared/state/*.db").option("table", "macro_features").load()

Options: path (a file, a glob, or several divided by commas; a folder that all executors see), table, rows (rows of a partition, 100,000 unless set), schema (reader's DDL; else from
the file's declared types). A partition covers a range of row ids, found from the table's first and last one. Files are opened read-only. `read` adds two options: conditions,
which become the file's WHERE, so that its indexes serve them, and newest, with which a partition returns only its own n largest rows.

Conditions are given to `read` and not taken from later filters (Spark's pushFilters of Python sources): filters pushed that way stay with the source, so a
second query of the same DataFrame would get the first one's rows (met with Spark 4.1.2). Filters on the DataFrame are right, but read all rows.

A state file's schema can be made from a sample (`ddl_from_sample`), with a unique index that makes writing an upsert (`upsert_rows`).
"""

from __future__ import annotations

import datetime
import glob
import json
import sqlite3
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = 100_000
_COMPARE = ("=", ">", ">=", "<", "<=")
# Declared types of columns and what they are here; anything else is text.
_TYPES = {"INTEGER": T.LongType(), "INT": T.LongType(), "BIGINT": T.LongType(), "REAL": T.DoubleType(), "DOUBLE": T.DoubleType(), "FLOAT": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BLOB": T.BinaryType()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _files(path: str) -> list[str]:
    out = [f for p in path.split(",") for f in (sorted(glob.glob(p.strip().removeprefix("file://"))) or [p.strip().removeprefix("file://")])]
    return list(dict.fromkeys(out))


def declared_schema(path: str, table: str) -> T.StructType:
    with _open(path) as con:
        columns = con.execute(f"PRAGMA table_info({_quoted(table)})").fetchall()
    if not columns:
        raise ValueError(f"{path} has no table {table}")
    return T.StructType([T.StructField(name, _TYPES.get((kind or "").upper().split("(")[0], T.StringType())) for _, name, kind, *_ in columns])


def clauses(schema: T.StructType, conditions: Sequence[Sequence]) -> tuple[list[str], list]:
    """(column, operator, value) as parts of a WHERE and their values: = < <= > >= in, and null, not null without a value."""
    parts, values = [], []
    for name, sign, *value in conditions:
        if name not in schema.names:
            raise ValueError(f"no column {name}")
        if sign in _COMPARE:
            parts.append(f"{_quoted(name)} {sign} ?")
            values += value
        elif sign == "in":
            parts.append(f"{_quoted(name)} IN ({', '.join('?' * len(value[0]))})")
            values += value[0]
        elif sign in ("null", "not null"):
            parts.append(f"{_quoted(name)} IS {sign.upper()}")
        else:
            raise ValueError(f"no operator {sign}")
    return parts, values


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    last: int


class SqliteReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.table, self.rows = schema, options["table"], int(options.get("rows", ROWS))
        self.files = _files(options["path"])
        self.where, self.values = clauses(schema, json.loads(options.get("where", "[]")))
        newest = json.loads(options.get("newest", "[]"))
        self.tail = f" ORDER BY {_quoted(newest[0])} DESC LIMIT {int(newest[1])}" if newest else ""

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for file in self.files:
            with _open(file) as con:
                a, b = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
            if a is not None:
                out += [Rows(file, k, min(k + self.rows, b + 1)) for k in range(a, b + 1, self.rows)]
        return out or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        where = " AND ".join(["rowid >= ? AND rowid < ?", *self.where])
        with _open(partition.file) as con:
            rows = con.execute(f"SELECT {', '.join(map(_quoted, self.schema.names))} FROM {_quoted(self.table)} WHERE {where}{self.tail}", [partition.first, partition.last, *self.values])
            while part := rows.fetchmany(8192):
                columns = [[bool(v) if v is not None and pa.types.is_boolean(f.type) else v for v in c] for f, c in zip(schema, zip(*part, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([str(v) if v is not None and pa.types.is_string(f.type) else v for v in c], f.type) for f, c in zip(schema, columns, strict=True)], schema=schema)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        return declared_schema(_files(self.options["path"])[0], self.options["table"])

    def reader(self, schema: T.StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)


def read(spark: SparkSession, path: str, table: str, rows: int = ROWS, where: Sequence[Sequence] = (), newest: tuple[str, int] | None = None) -> DataFrame:
    """where: conditions as `clauses` takes them, all of which hold; newest: (column, n), of which each partition returns its n largest rows."""
    spark.dataSource.register(SqliteSource)
    source = spark.read.format("sqlite").option("path", path).option("table", table).option("rows", rows).option("where", json.dumps([list(c) for c in where]))
    return (source.option("newest", json.dumps(newest)) if newest else source).load()


# Reads of the state


def latest(spark: SparkSession, path: str, table: str, order: str, rows: int = ROWS) -> DataFrame:
    """The row with the largest order; none where the table is empty. Each task returns one row."""
    return last_rows(spark, path, table, order, 1, rows)


def last_rows(spark: SparkSession, path: str, table: str, order: str, n: int, rows: int = ROWS) -> DataFrame:
    """The n newest rows, in order; each task returns n at most."""
    return read(spark, path, table, rows, newest=(order, n)).orderBy(F.desc(order)).limit(n).orderBy(order)


def series(spark: SparkSession, path: str, table: str, order: str, value: str, first: str | int | None = None, rows: int = ROWS) -> DataFrame:
    """order and value, from first on, in order, without nulls."""
    from_first = [] if first is None else [(order, ">=", first)]
    return read(spark, path, table, rows, [(value, "not null"), *from_first]).select(order, value).orderBy(order)


# State files are small: one row a day. They are made and written by the driver.


def declared(values: Iterable) -> str:
    """The declared type of a sample of values: INTEGER, REAL, BOOLEAN or TEXT (also for a mix or none)."""
    kinds = {type(v) for v in values if v is not None}
    if kinds <= {bool}:
        return "BOOLEAN" if kinds else "TEXT"
    if kinds <= {int}:
        return "INTEGER"
    return "REAL" if kinds <= {int, float} else "TEXT"


def parsed_value(text: str | None) -> int | float | bool | str | None:
    """A CSV cell as what it looks like."""
    if text is None or text.strip() in ("", "NaN", "nan", "None"):
        return None
    if text.strip().lower() in ("true", "false"):
        return text.strip().lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def ddl_from_sample(table: str, names: Sequence[str], rows: Sequence[Sequence], key: str) -> list[str]:
    """Statements that make the table, its columns typed by the sample, and its unique index."""
    columns = [f"{_quoted(n)} {declared(r[i] for r in rows)}" for i, n in enumerate(names)]
    return [f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({', '.join(columns)})", f"CREATE UNIQUE INDEX IF NOT EXISTS {_quoted(f'{table}_{key}')} ON {_quoted(table)} ({_quoted(key)})"]


def upsert_rows(path: str, table: str, names: Sequence[str], rows: Iterable[Sequence], key: str) -> int:
    """Inserts rows or replaces those of their key; columns that the table lacks are added. How many were written."""
    plain = lambda v: v.isoformat() if isinstance(v, datetime.date | datetime.datetime) else v
    rows = [tuple(map(plain, r)) for r in rows]
    con = sqlite3.connect(path)
    try:
        with con:
            for statement in ddl_from_sample(table, names, rows, key):
                con.execute(statement)
            there = {r[1] for r in con.execute(f"PRAGMA table_info({_quoted(table)})")}
            for i, n in enumerate(names):
                if n not in there:
                    con.execute(f"ALTER TABLE {_quoted(table)} ADD COLUMN {_quoted(n)} {declared(r[i] for r in rows)}")
            update = ", ".join(f"{_quoted(n)} = excluded.{_quoted(n)}" for n in names if n != key) or f"{_quoted(key)} = excluded.{_quoted(key)}"
            con.executemany(f"INSERT INTO {_quoted(table)} ({', '.join(map(_quoted, names))}) VALUES ({', '.join('?' * len(names))}) ON CONFLICT ({_quoted(key)}) DO UPDATE SET {update}", rows)
    finally:
        con.close()
    return len(rows)


def save(daily: DataFrame, path: str, table: str, key: str) -> int:
    """A daily table (one row a key) into a state file, streamed through the driver partition by partition."""
    return upsert_rows(path, table, daily.columns, (tuple(r) for r in daily.toLocalIterator()), key)
