"""Helpers shared by the operators: batches, word hashes over whole texts, shared folders, connected classes."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _one_thread_each() -> None:
    """numpy's matrix products of a worker on its own thread: a task has one core, and waiting helpers burn others' time."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        with contextlib.suppress(OSError):
            lib = ctypes.CDLL(str(path))
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)


_one_thread_each()

#: Bytes of text handled at once by the numpy code (about ten working arrays of eight bytes a byte).
PIECE = 1 << 20

#: Byte classes of the two word definitions in use, as tables "is this byte a separator?".
SPACE_SEPARATORS = np.zeros(256, bool)
SPACE_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
ALNUM_SEPARATORS = np.zeros(256, bool)
ALNUM_SEPARATORS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names starting with the given ones that no column of df has (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def computed_once(value: Column) -> Column:
    """value, in a form that the optimizer doesn't copy into filters: a filter on one of its fields, pushed below the steps
    that build it, would repeat each step wherever a later one refers to it."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 32 << 20) -> None:
    """Python workers get at most so many rows, and about so many bytes, at once: a batch of very long texts must fit in
    memory. These are settings of the session, as Spark has none for a single step; larger values are lowered, others stay."""
    for key, usual, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 28, size)):
        if not 0 < _bytes(spark.conf.get(key, str(usual))) <= most:
            spark.conf.set(key, str(most))


def _bytes(value: str) -> int:
    unit = value.strip().lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(unit[-1:], 1)
    return int(float(unit[:-1] if scale > 1 else unit) * scale)


def _shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one that the cluster names, in local mode else one in /tmp."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "/tmp/checkpoints"
    return top.rstrip("/")


def _hadoop_path(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes when the application ends."""
    path = f"{_shared(spark)}/{name}-{uuid.uuid4().hex}"
    fs, p = _hadoop_path(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


def ready_for_checkpoints(spark: SparkSession) -> None:
    """checkpoint() writes to the folder that the cluster names, or to one for local tests where it names none."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(_shared(spark))


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, survives lost executors. by: a column to lay it out by."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    out = df.write.option("compression", "zstd").mode("append")
    (out.partitionBy(by) if by else out).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.__dict__["_folder"] = path
    return table


def discard(table: DataFrame) -> None:
    """Removes a written table that nothing reads any more."""
    fs, p = _hadoop_path(table.sparkSession, table.__dict__["_folder"])
    fs.delete(p, True)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null is empty."""
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """Every text; null is empty."""
    return [x or "" for x in column.to_pylist()]


def groups(sizes: list[int], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows with about limit bytes; a longer row is a run of its own."""
    first = held = 0
    for i, n in enumerate(sizes):
        if i > first and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        m = max(n, PIECE + 65536)
        with np.errstate(over="ignore"):
            up = np.multiply.accumulate(np.full(m, _BASE, np.uint64))
            down = np.multiply.accumulate(np.full(m, _INVERSE, np.uint64))
        if m > 4 * PIECE:  # one word of many megabytes: don't keep its tables
            return up, down
        _POWERS.update(up=up, down=down)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _piece(a: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.empty(len(a) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(separators[a], out=inside[1:-1].view(bool))
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    up, down = _powers(len(a) + 1)
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(a * up[: len(a)], dtype=np.uint64, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts]), starts, ends


def hash_words(text: bytes, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of every word of a text; long texts go piece by piece, cut at separators."""
    a = np.frombuffer(text, np.uint8)
    if len(a) <= PIECE:
        return _piece(a, separators)
    parts, at = [], 0
    while at < len(a):
        end = min(at + PIECE, len(a))
        if end < len(a):
            cut = np.flatnonzero(separators[a[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # a word longer than a piece
                while end < len(a) and not separators[a[end]]:
                    nxt = np.flatnonzero(separators[a[end : end + PIECE]])
                    end = end + int(nxt[0]) if len(nxt) else min(end + PIECE, len(a))
        h, s, e = _piece(a[at:end], separators)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def hashed(texts: list[bytes], separators: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]]:
    """For each run of rows: first row, end, word hashes, where each row's words begin (and the end), the joined bytes, words' first bytes and ends."""
    for i, j in groups([len(x) + 1 for x in texts]):
        joined = b"\n".join(texts[i:j])
        h, s, e = hash_words(joined, separators)
        at = np.cumsum([0] + [len(x) + 1 for x in texts[i:j]])
        yield i, j, h, np.searchsorted(s, at), joined, s, e


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words (of the whole text if it has fewer; none if it has none)."""
    if not len(h):
        return h
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + h[i : len(h) - k + 1 + i]
    return mix(out + np.uint64(k))
