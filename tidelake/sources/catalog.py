"""Scans, sinks and the catalog of views over a folder of parquet tables.

Reads are lazy with the schema given where one is declared, so filters and column lists reach the scan. Replacing writes go to
a staging folder that is renamed, or use dynamic partition overwrite; merges are joins, never row loops.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def scan(spark: SparkSession, path: str, schema: str | T.StructType | None = None, date: tuple[str, str] | None = None, column: str = "date") -> DataFrame:
    """A parquet table, with a declared schema and an inclusive date range if given."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df.where(F.col(column).between(*(F.lit(d).cast("date") for d in date))) if date else df


def scan_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; without a schema it is inferred (a second pass over the file)."""
    return spark.read.csv(path, header=True, schema=schema) if schema else spark.read.csv(path, header=True, inferSchema=True)


def scan_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed API payloads, one JSON object a line."""
    return spark.read.schema(schema).json(path)


def load_prices(spark: SparkSession, path: str, tickers: Sequence[str] | None = None) -> DataFrame:
    """date, ticker, close from CSV or parquet, long (ticker or asset_id, close) or wide (a column a ticker)."""
    df = scan_csv(spark, path) if path.lower().endswith(".csv") else spark.read.parquet(path)
    by_name = {c.lower(): c for c in df.columns}
    name = by_name.get("ticker") or by_name.get("asset_id") or by_name.get("symbol")
    day = by_name.get("date") or df.columns[0]
    if name and "close" in by_name:
        out = df.select(F.to_date(day).alias("date"), F.upper(F.col(name).cast("string")).alias("ticker"), F.col(by_name["close"]).cast("double").alias("close"))
    else:
        values = [c for c in df.columns if c != day]
        out = df.select(F.to_date(day).alias("date"), *(F.col(c).cast("double").alias(c) for c in values)).unpivot("date", values, "ticker", "close").withColumn("ticker", F.upper("ticker"))
    out = out.where(F.col("close").isNotNull())
    return out.where(F.col("ticker").isin([t.upper() for t in tickers])) if tickers else out


def load_with_fallback(spark: SparkSession, paths: Sequence[str], tickers: Sequence[str] | None = None) -> DataFrame:
    """The first path that exists and has rows."""
    for p in paths:
        if _exists(spark, p):
            df = load_prices(spark, p, tickers)
            if not df.isEmpty():
                return df
    raise FileNotFoundError(f"none of {list(paths)} has rows")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def create_views(spark: SparkSession, folder: str, names: Sequence[str] = TABLES, aliases: Mapping[str, str] | None = None) -> list[str]:
    """A temporary view for each table that exists in the folder; aliases name a view again."""
    made = []
    for n in names:
        path = f"{folder}/{n}.parquet"
        if _exists(spark, path):
            spark.read.parquet(path).createOrReplaceTempView(n)
            made.append(n)
    for new, old in (aliases or {}).items():
        if old in made:
            spark.table(old).createOrReplaceTempView(new)
            made.append(new)
    return made


def show_tables(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW VIEWS").select("viewName")


def materialize(spark: SparkSession, folder: str, database: str, names: Sequence[str] = TABLES, location: str | None = None) -> list[str]:
    """The tables of a folder as managed tables of a database, which lies at location or in the warehouse."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}" + (f" LOCATION '{location}'" if location else ""))
    done = []
    for n in names:
        if _exists(spark, f"{folder}/{n}.parquet"):
            spark.read.parquet(f"{folder}/{n}.parquet").write.mode("overwrite").saveAsTable(f"{database}.{n}")
            done.append(n)
    return done


def rewrite_dialect(text: str) -> str:
    """Forms of other dialects: read_parquet('p') and read_csv_auto('p') as scans, SHOW TABLES as views."""
    text = re.sub(r"read_parquet\('([^']+)'\)", r"parquet.`\1`", text)
    text = re.sub(r"read_csv_auto\('([^']+)'\)", r"csv.`\1`", text)
    return re.sub(r"(?i)^\s*show\s+tables\s*;?\s*$", "SHOW VIEWS", text)


def run_sql(spark: SparkSession, text: str) -> list[DataFrame]:
    """The frames of one or several statements divided by semicolons (none inside quotes)."""
    parts = re.findall(r"(?:[^;']|'(?:[^']|'')*')+", text)
    return [spark.sql(rewrite_dialect(p)) for p in parts if p.strip()]


def run_sql_file(spark: SparkSession, path: str) -> list[DataFrame]:
    return run_sql(spark, Path(path).read_text(encoding="utf-8"))


# Sinks


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_atomically(df: DataFrame, path: str) -> None:
    """Writes beside the target, renames the old table, then the new one; the old one goes last. df may read the target.

    A crash between the two renames leaves the old table under the name `<path>.replaced`; the next call puts it back first
    (as does `restore`), so no state loses the table. Readers meet the old table, the new one, or for a moment none."""
    spark = df.sparkSession
    top = path.rstrip("/")
    restore(spark, path)
    staged, replaced = f"{top}.{uuid.uuid4().hex}", f"{top}.replaced"
    df.write.parquet(staged)
    Path_ = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path_(top).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(Path_(top)) and not fs.rename(Path_(top), Path_(replaced)):
        raise OSError(f"cannot rename {top}")
    if not fs.rename(Path_(staged), Path_(top)):
        fs.rename(Path_(replaced), Path_(top))
        raise OSError(f"cannot rename {staged}")
    fs.delete(Path_(replaced), True)


def restore(spark: SparkSession, path: str) -> None:
    """Brings a table back that a crashed `replace_atomically` left renamed, or removes what it left of a replaced one."""
    Path_ = spark._jvm.org.apache.hadoop.fs.Path
    target, replaced = Path_(path.rstrip("/")), Path_(f"{path.rstrip('/')}.replaced")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(replaced):
        if fs.exists(target):
            fs.delete(replaced, True)
        elif not fs.rename(replaced, target):
            raise OSError(f"cannot rename {replaced}")


def replace_partitions(df: DataFrame, path: str, column: str = "date") -> None:
    """Replaces the partitions that df has, and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append_new_dates(df: DataFrame, path: str, date: str = "date") -> None:
    """Appends the rows of dates that the table doesn't have; a second run appends nothing."""
    spark = df.sparkSession
    if _exists(spark, path):
        df = df.join(spark.read.parquet(path).select(date).distinct(), date, "left_anti")
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


# Merges


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old rows of their key; columns may differ (missing ones are null)."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def append_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows, and new rows of keys that old doesn't have."""
    return old.unionByName(new.join(old.select(*keys).distinct(), list(keys), "left_anti"), allowMissingColumns=True)


def combine_first(first: DataFrame, second: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cell by cell the first table's value, else the second's."""
    values = [c for c in first.columns if c not in keys]
    other = second.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in values if c in second.columns))
    both = first.join(other, list(keys), "full")
    return both.select(*keys, *(F.coalesce(c, f"_o_{c}").alias(c) if c in second.columns else F.col(c) for c in values))


def replace_slice(old: DataFrame, new: DataFrame, symbols: DataFrame, key: str, date: str, first: str, last: str) -> DataFrame:
    """Old rows outside of symbols x [first, last], and all new rows."""
    hit = symbols.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    inside = F.coalesce(F.col("_hit"), F.lit(False)) & F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return old.join(hit, key, "left").where(~inside).drop("_hit").unionByName(new)


def first_source_wins(sources: Sequence[DataFrame]) -> DataFrame:
    """The union of all sources of the smallest rank that has rows: sources are asked in order."""
    all_rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("_rank", F.lit(i))
        all_rows = s if all_rows is None else all_rows.unionByName(s)
    best = all_rows.agg(F.min("_rank").alias("_best"))
    return all_rows.join(F.broadcast(best), F.col("_rank") == F.col("_best")).drop("_rank", "_best")


def watermarks(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """The last stored date of each key: where the next fetch begins."""
    return df.groupBy(*keys).agg(F.max(date).alias("last_date"))


def refill_missing(cache: DataFrame, wanted: DataFrame, fetched: DataFrame, keys: Sequence[str], order: str, last: int) -> DataFrame:
    """The cache's rows and the fetched rows of wanted keys that the cache lacks; the newest `last` rows of each key."""
    lacking = wanted.join(cache.select(*keys).distinct(), list(keys), "left_anti")
    rows = cache.unionByName(fetched.join(lacking, list(keys), "left_semi"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("_n", n).where(F.col("_n") <= last).drop("_n")


# Configuration and metadata, on the driver


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """Dictionaries merge key by key, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def file_hash(path: str | os.PathLike) -> str:
    """The first 16 hex digits of a file's SHA-256."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()[:16]


def run_metadata(tables: Mapping[str, DataFrame], config: Mapping) -> dict:
    """Row counts of the tables and a hash of the configuration."""
    text = repr(sorted(config.items()))
    return {"rows": {k: v.count() for k, v in tables.items()}, "config_hash": hashlib.sha256(text.encode()).hexdigest()[:16]}


def facts_from_payloads(payloads: DataFrame, key: str = "asset_id", payload: str = "payload", value: str = "value") -> DataFrame:
    """Facts (key, date, value) from API payloads [[unix ms, value], ...]: UTC days, of several points a day the last one."""
    points = payloads.select(key, F.explode(F.from_json(payload, "array<array<double>>")).alias("_p")).where(F.size("_p") >= 2)
    ms = F.element_at("_p", 1).cast("long")
    x = points.select(key, F.to_date(F.timestamp_millis(ms)).alias("date"), ms.alias("_ms"), F.element_at("_p", 2).alias(value))
    return x.groupBy(key, "date").agg(F.max_by(value, "_ms").alias(value))


# Results for people and for other programs


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are kept as such."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown(df: DataFrame, most: int = 50) -> str:
    """A small result as a Markdown table; a longer one ends with a row that says how many rows follow."""
    def cell(v: object) -> str:
        return "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")

    rows = df.limit(most + 1).collect()  # a report, never a table
    lines = ["| " + " | ".join(map(cell, df.columns)) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append("| " + " | ".join([f"... {df.count() - most} more rows", *[""] * (len(df.columns) - 1)]) + " |")
    return "\n".join(lines) + "\n"


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text, such as a manifest or a report, as one file of any file system, in place of an older one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def receipt(tables: Mapping[str, DataFrame], config: Mapping, steps: Mapping[str, str]) -> str:
    """A run's receipt as JSON: row counts, configuration and its hash, status of the steps."""
    return json.dumps(run_metadata(tables, config) | {"config": dict(config), "steps": dict(steps)}, indent=1, sort_keys=True, default=str)
