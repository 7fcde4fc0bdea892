"""Tables of immutable files with a ledger of commits: whole versions, bucketed merges, reads as of a version.

    table/data/<commit>/...            files, never changed once a commit names them
    table/ledger/<version>.json        what a version consists of: {"version", "batch", "schema", "buckets": {bucket: [folder]}, "keys", "n_buckets"}

A version is what its ledger file says. It becomes visible by one rename of that file, which fails where the version exists, so readers meet the old version or the new one and never
none, a writer that dies leaves files that no version names, and of two writers one must try again. A batch id is in the ledger once: a batch
that comes again, as a stream's may after a crash, changes nothing.

A merge reads and writes only the buckets (hash of the keys) that new rows fall into. The driver handles bucket numbers and folder names, never rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import hadoop

#: Buckets of a table that doesn't say otherwise: for 100 TB more, so that a bucket is about a gigabyte.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), buckets: int = BUCKETS):
        """keys: columns that are unique in the table; they also choose a row's bucket. What the ledger says of an existing table holds."""
        self.spark, self.path = spark, path.rstrip("/")
        now = self._entry(self.version()) if self.version() else None
        self.keys, self.buckets = (tuple(now["keys"]), now["n_buckets"]) if now else (tuple(keys), buckets if keys else 1)

    # The ledger

    def versions(self) -> list[int]:
        fs, p = hadoop(self.spark, f"{self.path}/ledger")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))

    def version(self) -> int:
        """The newest version; 0 where there is none."""
        return max(self.versions(), default=0)

    def _entry(self, version: int) -> dict:
        fs, p = hadoop(self.spark, f"{self.path}/ledger/{version:09d}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def committed(self, batch: str | int) -> int | None:
        """The version that a batch made, if it has made one."""
        return next((v for v in reversed(self.versions()) if self._entry(v)["batch"] == str(batch)), None)

    def history(self) -> list[tuple[int, str, int]]:
        """version, batch and number of buckets with rows."""
        return [(v, e["batch"], len(e["buckets"])) for v in self.versions() for e in [self._entry(v)]]

    def _commit(self, version: int, batch: str, schema: T.StructType, buckets: dict[str, list[str]]) -> int:
        entry = {"version": version, "batch": str(batch), "schema": schema.jsonValue(), "buckets": buckets, "keys": list(self.keys), "n_buckets": self.buckets}
        fs, ledger = hadoop(self.spark, f"{self.path}/ledger")
        fs.mkdirs(ledger)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        staged, target = path(f"{self.path}/ledger/.{uuid.uuid4().hex}"), path(f"{self.path}/ledger/{version:09d}.json")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(staged, target):
            fs.delete(staged, False)
            raise Conflict(f"version {version} of {self.path} exists")
        return version

    # Reading

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table as of a version (the newest, if none is given), or only some of its buckets."""
        version = version or self.version()
        if not version:
            raise FileNotFoundError(f"{self.path} has no version")
        entry = self._entry(version)
        schema = T.StructType.fromJson(entry["schema"])
        folders = sorted(f for b, fs in entry["buckets"].items() if buckets is None or int(b) in buckets for f in fs)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders)) if folders else self.spark.createDataFrame([], schema)

    # Writing

    def bucket(self) -> Column:
        """A row's bucket; equal keys are together whatever their number type."""
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """rows in a folder a bucket; the folders by bucket."""
        own, name = f"data/{uuid.uuid4().hex}", "_bucket"
        out = rows.withColumn(name, self.bucket())
        if self.keys:
            out = out.repartition(name)
        out.write.partitionBy(name).parquet(f"{self.path}/{own}")
        fs, p = hadoop(self.spark, f"{self.path}/{own}")
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {n.removeprefix(f"{name}="): [f"{own}/{n}"] for n in names if n.startswith(f"{name}=")}

    def _checked(self, rows: DataFrame) -> DataFrame:
        """rows, of which a second one with some keys stops the job."""
        if not self.keys:
            return rows
        twice = rows.groupBy(*self.keys).count().where("count > 1").first()
        if twice:
            raise ValueError(f"{self.path}: keys {twice.asDict()} are not unique")
        return rows

    def replace(self, rows: DataFrame, batch: str | int | None = None) -> int:
        """A version of these rows alone; rows may read the table. Returns its number."""
        batch = uuid.uuid4().hex if batch is None else str(batch)
        if (done := self.committed(batch)) is not None:
            return done
        at = self.version()
        return self._commit(at + 1, batch, rows.schema, self._write(self._checked(rows)))

    def _hit(self, rows: DataFrame) -> list[int]:
        """The buckets of rows: at most one number a bucket."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def append(self, rows: DataFrame, batch: str | int | None = None) -> int:
        """A version with rows added, whose keys must be new; missing columns are null on either side. Only new files are written, and of the old ones only
        the keys of the same buckets are read."""
        batch = uuid.uuid4().hex if batch is None else str(batch)
        if (done := self.committed(batch)) is not None:
            return done
        at = self.version()
        if not at:
            return self.replace(rows, batch)
        old = self._entry(at)["buckets"]
        if self.keys and (twice := self._checked(rows).select(*self.keys).join(self.read(at, self._hit(rows)).select(*self.keys), list(self.keys), "left_semi").first()):
            raise ValueError(f"{self.path}: keys {twice.asDict()} are not unique")
        schema = self.read(at).limit(0).unionByName(rows.limit(0), allowMissingColumns=True).schema
        new = self._write(rows)
        return self._commit(at + 1, batch, schema, old | {b: [*old.get(b, []), *f] for b, f in new.items()})

    def merge(self, rows: DataFrame, order: Sequence[str], batch: str | int) -> int:
        """A version in which each key of rows has the row, old or new, with the largest order. Only the buckets of these keys are read and written;
        columns that either side lacks are null. A batch that has been merged changes nothing."""
        if not self.keys:
            raise ValueError("a merge needs keys")
        if (done := self.committed(batch)) is not None:
            return done
        at = self.version()
        old = self._entry(at) if at else {"buckets": {}}
        hit = self._hit(rows)
        if at:
            before = self.read(at)
            schema = before.limit(0).unionByName(rows.limit(0), allowMissingColumns=True).schema
            rows = self.read(at, hit).unionByName(rows, allowMissingColumns=True)
        else:
            schema = rows.schema
        values = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rows.columns if c not in (*order, *self.keys)))
        newest = rows.groupBy(*self.keys).agg(F.max(values).alias("_row")).select(*(F.col(c) if c in self.keys else F.col(f"_row.{c}").alias(c) for c in rows.columns))
        kept = {b: f for b, f in old["buckets"].items() if int(b) not in hit}
        return self._commit(at + 1, str(batch), schema, kept | self._write(newest.select(*schema.fieldNames())))

    def vacuum(self, keep: int = 1) -> list[str]:
        """Forgets all but the newest versions and deletes files that no version left names (also those of writers that died). Not beside a writer."""
        fs, data = hadoop(self.spark, f"{self.path}/data")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        known = self.versions()
        for v in known[:-keep]:
            fs.delete(path(f"{self.path}/ledger/{v:09d}.json"), False)
        used = {f for v in known[-keep:] for fs_ in self._entry(v)["buckets"].values() for f in fs_}
        gone = []
        for commit in fs.listStatus(data) if fs.exists(data) else []:
            for part in fs.listStatus(commit.getPath()):
                name = f"data/{commit.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used:
                    fs.delete(part.getPath(), True)
                    gone.append(name)
            if not any(f.startswith(f"data/{commit.getPath().getName()}/") for f in used):
                fs.delete(commit.getPath(), True)
        return gone


def merge_stream(stream: DataFrame, table: VersionedTable, checkpoint: str, order: Sequence[str]) -> None:
    """A stream's micro-batches merged into a table; a batch that is run again after a crash finds itself in the ledger."""
    name = f"stream:{checkpoint.rstrip('/').rpartition('/')[2]}:"

    def merge(batch: DataFrame, k: int) -> None:
        table.merge(batch, order, f"{name}{k}")

    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
