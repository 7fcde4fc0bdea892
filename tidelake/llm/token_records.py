"""Token ids as length-delimited binary records.

Each document is one record of a shard file: its length (8 bytes), the masked checksum of these (4), the payload, and the
masked checksum of the payload (4), all little-endian. A payload is one flag byte (1: the id is null), doc_id (8 bytes), and
the token ids, two bytes each where the vocabulary allows, else four (the shard's first record is a header that says which).
Beside each shard an index file holds the offset of every record and the file's end, for reads in any order.

Shards hold ascending, disjoint ranges of doc_id and text (the first 64 characters of it, so that many rows with one doc_id
are many shards). They lie in the shared folder; a task writes under a name of its own and
renames the complete file, so a lost executor or a second attempt leaves whole files only. The driver gets one manifest row
a shard, never one a document.

Defined cases: a null text is empty; a null doc_id sorts first; rows with one doc_id are ordered by their text and each have
their record; an empty table gives no records; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chunks import CACHE_LIMIT, Memo, Runs, load, mode, spaced, trim
from ._common import groups, hash_words, shared_folder, small_batches, strings

HEADER = b"RECTOK1"
MANIFEST = "shard int, file string, n_docs long, n_tokens long"
_STATE: dict = {}
BLANK = np.zeros(256, bool)
BLANK[0x20] = True


def masked(data: bytes) -> int:
    """Checksum, rotated and shifted so that the checksum of data that holds checksums stays useful."""
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + struct.pack("<I", masked(n)) + payload + struct.pack("<I", masked(payload))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the record at an offset, and where the next begins; damage raises ValueError."""
    n, check = struct.unpack_from("<QI", data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(bytes(payload)):
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + n


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Encoder:
    """Ids of whole texts. Where blanks lead (byte-level splitting), the words of many texts are looked up at once, by 64-bit
    hash and length, in sorted arrays; each distinct word that is not known goes to the library."""

    def __init__(self, path: str, limit: int = 700_000):
        self.tok, self.how = load(path), mode(path)
        self.code = "H" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.type, self.limit = np.uint16 if self.code == "H" else np.uint32, limit
        self.ids = Runs(self.tok, self.how, path)
        self.memo = Memo({"": b""} if self.how == "dropped" else {}, lambda runs: [array(self.code, x).tobytes() for x in self.ids(runs)], 50_000 if self.how == "leading" else CACHE_LIMIT)
        self.keys = np.empty(0, np.uint64)
        self.first, self.many, self.size, self.used = (np.empty(0, np.int32) for _ in range(4))
        self.flat, self.held = np.empty(1 << 16, self.type), 0

    def _forget(self) -> None:
        """Keeps the words that came up in several runs of texts, at most half of the limit."""
        least = max(2, int(np.partition(self.used, -(self.limit // 2))[-(self.limit // 2)]) + 1 if len(self.used) > self.limit // 2 else 2)
        keep = self.used >= least
        n = self.many[keep].astype(np.int64)
        ends = np.cumsum(n)
        self.flat = self.flat[np.repeat(self.first[keep] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self.held = len(self.flat)
        if not self.held:
            self.flat = np.empty(1 << 16, self.type)
        self.keys, self.size, self.used, self.many = self.keys[keep], self.size[keep], self.used[keep] // 2, self.many[keep]
        self.first = (ends - n).astype(np.int32)

    def _words(self, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of the words between single blanks, one after the other; where each word's begin and end; where words begin."""
        h, s, e = hash_words(joined, BLANK)
        u, at, back = np.unique(h, return_index=True, return_inverse=True)
        length = (e - s)[at]
        i = np.searchsorted(self.keys, u)
        near = np.minimum(i, max(0, len(self.keys) - 1))
        known = self.keys[near] == u if len(self.keys) else np.zeros(len(u), bool)
        if len(self.keys) and (self.size[near] != length)[known].any():
            return None
        new = np.flatnonzero(~known)
        if len(self.keys) > self.limit:
            self._forget()
            return self._words(joined)
        ids = self.ids([joined[a:b].decode() for a, b in zip(s[at[new]].tolist(), e[at[new]].tolist(), strict=True)]) if len(new) else []
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        more = int(many.sum())
        while self.held + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.held : self.held + more] = np.fromiter(chain.from_iterable(ids), self.type, more)
        first = self.held + np.cumsum(many) - many
        self.held += more
        put = i[new]
        self.keys, self.first, self.many = np.insert(self.keys, put, u[new]), np.insert(self.first, put, first), np.insert(self.many, put, many)
        self.size, self.used = np.insert(self.size, put, length[new]), np.insert(self.used, put, 0)
        own = i + np.cumsum(~known) - (~known)
        self.used[own] += 1
        place = own[back]
        n = self.many[place].astype(np.int64)
        ends = np.cumsum(n)
        out = self.flat[np.repeat(self.first[place] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.append(0, ends), s

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as the bytes of the shard's width."""
        if self.how != "leading":
            return [b"".join(v) for v in self.memo.by_text(texts, self.how)]
        fast = [k for k, t in enumerate(texts) if not spaced(t)]
        parts = [texts[k].encode().partition(b" ") for k in fast]
        tails = [p[2] for p in parts]
        found = self._words(b" ".join(tails)) if fast else None
        if found is None:
            return [b"".join(v) for v in self.memo.by_text(texts, self.how)]
        ids, ends, starts = found
        at = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in tails]))
        cuts = (ends[at] * ids.itemsize).tolist()
        data = ids.tobytes()
        heads = self.memo.values_of([(p[0].decode(),) for p in parts])
        out: list = [None] * len(texts)
        for k, head, a, b in zip(fast, heads, cuts, cuts[1:], strict=False):
            out[k] = head + data[a:b]
        slow = [k for k, x in enumerate(out) if x is None]
        for k, v in zip(slow, self.memo.by_text([texts[k] for k in slow], self.how), strict=True):
            out[k] = b"".join(v)
        return out


def write(df: DataFrame, path: str, folder: str | None = None, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the records of all documents in ascending doc_id order; returns the manifest (a row for each shard)."""
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or shared_folder(spark, "records")
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    docs = df.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text")
    docs = docs.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _STATE:
            _STATE.clear()
            _STATE[path] = _Encoder(path)
        encode = _STATE[path]
        end = array(encode.code, [end_id]).tobytes()
        ctx = TaskContext.get()
        shard = ctx.partitionId()
        fs, top = _open(folder)
        name = f"{top}/shard-{shard:07d}"
        own = f"{name}.{ctx.taskAttemptId()}"
        n_docs = n_tokens = 0
        offsets = array("Q")
        with fs.open_output_stream(own + ".rec") as out:
            head = frame(HEADER + encode.code.encode())
            out.write(head)
            place = len(head)
            for b in batches:
                ids, texts = b.column("doc_id").to_pylist(), strings(b.column("text"))
                for i, j in groups([len(t) for t in texts]):
                    for d, x in zip(ids[i:j], encode(texts[i:j]), strict=True):
                        payload = struct.pack("<Bq", d is None, d or 0) + x + end
                        record = frame(payload)
                        offsets.append(place)
                        place += len(record)
                        out.write(record)
                        n_docs += 1
                        n_tokens += (len(payload) - 9) // len(end)
        offsets.append(place)
        with fs.open_output_stream(own + ".idx") as out:
            out.write(np.frombuffer(offsets.tobytes(), np.uint64).astype("<u8").tobytes())
        fs.move(own + ".idx", name + ".idx")
        fs.move(own + ".rec", name + ".rec")
        trim()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [f"{folder}/shard-{shard:07d}"], "n_docs": pa.array([n_docs], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    rows = sorted(docs.mapInArrow(run, MANIFEST).where("n_docs > 0").collect())
    return spark.createDataFrame(rows, MANIFEST)


def load_shard(file: str) -> tuple[memoryview, np.ndarray, str]:
    """The bytes of a shard, the offsets of its records (and its end), and the code of the width of its ids."""
    fs, at = _open(file)
    with fs.open_input_stream(at + ".rec") as f:
        data = memoryview(f.read())
    with fs.open_input_stream(at + ".idx") as f:
        offsets = np.frombuffer(f.read(), "<u8").astype(np.int64)
    head, _ = unframe(data, 0)
    if bytes(head[:-1]) != HEADER:
        raise ValueError(f"not a record file: {file}")
    return data, offsets, bytes(head[-1:]).decode()


def stream_shard(file: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """doc_id and ids of every record of a shard, in order; one record is in memory at a time."""
    fs, at = _open(file)
    code = None
    with fs.open_input_stream(at + ".rec", buffer_size=1 << 20) as f:
        while head := f.read(12):
            n, check = struct.unpack("<QI", head)
            if masked(head[:8]) != check:
                raise ValueError(f"damaged length in {file}")
            data = memoryview(head + f.read(n + 4))
            payload, _ = unframe(data, 0)
            if code is None:
                if bytes(payload[:-1]) != HEADER:
                    raise ValueError(f"not a record file: {file}")
                code = bytes(payload[-1:]).decode()
            else:
                yield record(data, 0, code)


def record(data: memoryview, at: int, code: str) -> tuple[int | None, np.ndarray]:
    """doc_id and the ids (unsigned 32 bits) of the record at an offset."""
    payload, _ = unframe(data, at)
    null, d = struct.unpack_from("<Bq", payload, 0)
    return None if null else d, np.frombuffer(payload[9:], "<u2" if code == "H" else "<u4").astype("<u4")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every record, read from the files.

    The starts of shards are running sums over the manifest, which has a row for each shard.
    """
    rows = sorted(manifest.collect())
    starts = np.cumsum([0] + [r["n_tokens"] for r in rows])
    work = spark.createDataFrame([(r["file"], int(s)) for r, s in zip(rows, starts[:-1], strict=True)], "file string, start long")

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column("file").to_pylist(), b.column("start").to_pylist(), strict=True):
                out: list[tuple] = []
                for d, ids in stream_shard(file):
                    out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                    if len(out) == 4096:
                        yield table(out)
                        out = []
                if out:
                    yield table(out)

    return work.repartition(max(1, len(rows))).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
