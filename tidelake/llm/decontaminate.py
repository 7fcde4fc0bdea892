"""Benchmark decontamination by winnowing.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts whose A-Z are lowered. Of every run of ten words the smallest hash
of its five-word grams is its fingerprint, so a shared span of ten words or more always shares a fingerprint. An item of fewer words than a window is one window of
its own length, and its own fingerprint.

Fingerprints of documents and of the benchmark are joined by a shuffle, each together with the hash of the window that it stands for. Before
that, documents drop fingerprints that the benchmark surely lacks, by a bit map of a fixed size (FILTER_BITS), united on the executors;
a benchmark of any size passes through it, only less is dropped. Documents without a fingerprint left are done; to the others come
the windows that they met, and every occurrence is verified word by word, which extends a hit to the whole span shared. The benchmark is
never on the driver, and documents are read once, whatever its size. A passage that many documents share gives each of them a row of the join; its
hash has many rows on one side and one on the other, which Spark's skew handling divides.

Defined cases: null or empty texts have no words and no hits; items without words hit nothing, nor do those without an id
in find (as in its SQL), while clean searches them too; rows of one item_id count as one item; repeated documents each get
their result; an empty benchmark hits nothing; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import ALNUM_SEPARATORS, byte_texts, fresh, hashed, shingles, small_batches, written

WINDOW, GRAM = 10, 5
#: Bits of the map of the benchmark's fingerprints (2 MB, on the driver and in every worker).
FILTER_BITS = 1 << 24
FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)])


def minima(g: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each n neighbours."""
    out = g[: len(g) - n + 1]
    for i in range(1, n):
        out = np.minimum(out, g[i : len(g) - n + 1 + i])
    return out


def prints(h: np.ndarray, n: int, window: int, gram: int) -> np.ndarray:
    """The fingerprint of every run of n words of one text: winnowed for whole windows, the run's hash for shorter items."""
    return minima(shingles(h, gram), window - gram + 1) if n == window else shingles(h, n)


def _place(fp: np.ndarray, size: int) -> np.ndarray:
    """The bit of each fingerprint in a map of size (a power of two) bits."""
    return fp >> np.uint64(65 - size.bit_length())


def windows_of(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """items: id, text (strings). Windows: fp, wh (hashes of the fingerprint and of all words), n words, w (the words joined by
    a blank), items (ids, each once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, j, h, bounds, joined, s, e in hashed([t.lower() for t in byte_texts(b.column(1))], ALNUM_SEPARATORS):
                for r in range(j - i):
                    lo, hi = int(bounds[r]), int(bounds[r + 1])
                    n = min(window, hi - lo)
                    if not n:
                        continue
                    words = [joined[x:y].decode() for x, y in zip(s[lo:hi].tolist(), e[lo:hi].tolist(), strict=True)]
                    for k in range(0, hi - lo - n + 1, 1 << 16):  # an item of any length, piece by piece
                        part = h[lo + k : min(hi, lo + k + (1 << 16) + n - 1)]
                        m = len(part) - n + 1
                        text = [" ".join(words[k + q : k + q + n]) for q in range(m)]
                        columns = [pa.array(prints(part, n, window, gram).view(np.int64)), pa.array(shingles(part, n).view(np.int64)), pa.array(np.full(m, n, np.int32)), pa.array(text, pa.string()), pa.array([ids[i + r]] * m, pa.string())]
                        yield pa.RecordBatch.from_arrays(columns, names=["fp", "wh", "n", "w", "id"])

    rows = items.mapInArrow(run, "fp long, wh long, n int, w string, id string")
    return written(rows.groupBy("fp", "wh", "n", "w").agg(F.collect_set("id").alias("items")), "decontaminate-windows")


def bit_map(windows: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """Which fingerprints may be there: united in tasks, then in groups of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, bool)
        for b in batches:
            held[_place(b.column(0).to_numpy().view(np.uint64), size)] = True
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.packbits(held).tobytes()], pa.binary())], names=["part", "bits"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for x in b.column(1):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                held = x.copy() if held is None else np.bitwise_or(held, x, out=held)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([held.tobytes()], pa.binary())], names=["part", "bits"])

    rows, parts = windows.select("fp").mapInArrow(run, "part int, bits binary"), max(1, windows.rdd.getNumPartitions())
    while parts > 1:
        parts = math.ceil(parts / 16)
        rows = rows.repartition(parts).mapInArrow(united, "part int, bits binary")
    top = [np.frombuffer(r["bits"], np.uint8) for r in rows.collect()]
    return np.bitwise_or.reduce(top) if top else np.zeros(size // 8, np.uint8)


def _may_hold(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    i = _place(fp, 8 * len(bits))
    return (bits[i >> np.uint64(3)] >> (np.uint8(7) - (i & np.uint64(7)).astype(np.uint8))) & 1 == 1


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "found", window: int = WINDOW, gram: int = GRAM, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with a struct column: n_words, n_hit (words inside windows of items), items (ids, sorted as strings), spans (runs of
    hit words). A column of docs with the name of the output is replaced."""
    spark = docs.sparkSession
    small_batches(spark)
    items = items.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).where("id is not null")
    bench = windows_of(items, window, gram)
    lengths = sorted(r["n"] for r in bench.select("n").distinct().collect())  # window of them at most
    shipped = spark.sparkContext.broadcast(bit_map(bench, filter_bits))
    keep = [c for c in docs.columns if c.lower() != out.lower()]
    rid, words, cand, met, given = fresh(docs, "_rid", "_words", "_cand", "_met", "_given")
    src = docs.select(*keep, F.col(text).alias(given))
    schema = src.withColumns({rid: F.lit(0).cast("long"), words: F.lit(0).cast("long"), cand: F.lit(None).cast("array<struct<fp:bigint,wh:bigint>>")}).schema

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, at = shipped.value, TaskContext.get().partitionId() << 40
        for b in batches:
            sizes, count, fps, whs = [], [], [], []
            for i, j, h, bounds, *_ in hashed([t.lower() for t in byte_texts(b.column(given))], ALNUM_SEPARATORS):
                doc = np.repeat(np.arange(j - i), np.diff(bounds))
                found = []
                for n in lengths:
                    if len(h) < n:
                        continue
                    fp = prints(h, n, window, gram)
                    k = np.flatnonzero(_may_hold(bits, fp) & (doc[: len(doc) - n + 1] == doc[n - 1 :]))
                    if len(k):
                        found.append(np.stack([doc[k].astype(np.int64), fp[k].view(np.int64), shingles(h, n)[k].view(np.int64)]))
                found = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((3, 0), np.int64)
                sizes.append(np.diff(bounds))
                count.append(np.bincount(found[0], minlength=j - i))
                fps.append(found[1]), whs.append(found[2])
            cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(cat(fps), pa.int64()), pa.array(cat(whs), pa.int64())], names=["fp", "wh"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cat(count))).astype(np.int32)), pairs)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows)), pa.array(cat(sizes), pa.int64()), lists], names=[*b.schema.names, rid, words, cand])
            at += b.num_rows

    table = written(src.mapInArrow(candidates, schema), "decontaminate-docs")
    none = F.struct(F.col(words).alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")).cast(FOUND)
    done = table.where(F.size(cand) == 0).select(*keep, none.alias(out))

    open_ = table.where(F.size(cand) > 0)
    hits = open_.select(F.col(rid).alias("r"), F.explode(cand).alias("c")).select("r", "c.fp", "c.wh").join(bench, ["fp", "wh"])
    hits = hits.groupBy("r").agg(F.collect_list(F.struct("wh", "n", "w", "items")).alias(met)).withColumnRenamed("r", rid)
    open_ = open_.select(*keep, given, rid).join(hits, rid, "left").select(*keep, given, met)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = [_verified(t, m or [], lengths) for t, m in zip(byte_texts(b.column(given)), b.column(met).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(column, _FOUND)], names=[*keep, out])

    return done.unionByName(open_.mapInArrow(verify, done.schema))


def _verified(text: bytes, windows: list[dict], lengths: list[int]) -> dict:
    """What of the text lies in occurrences of these windows, word by word."""
    n_words, cover, items = 0, np.zeros(0, np.int64), set()
    by = {n: {} for n in lengths}
    for x in windows:
        by[x["n"]].setdefault(x["wh"], []).append(x)
    for _, _, h, _, joined, s, e in hashed([text.lower()], ALNUM_SEPARATORS):
        n_words, cover = len(h), np.zeros(len(h) + 1, np.int64)
        word = lambda a: joined[s[a] : e[a]].decode()
        for n, known in by.items():
            if not known or len(h) < n:
                continue
            wh = shingles(h, n).view(np.int64)
            for a in np.flatnonzero(np.isin(wh, np.fromiter(known, np.int64, len(known)))).tolist():
                own = " ".join(word(a + q) for q in range(n))
                same = [x for x in known[int(wh[a])] if x["w"] == own]
                if same:
                    cover[a] += 1
                    cover[a + n] -= 1
                    items.update(i for x in same for i in x["items"])
    hit = np.cumsum(cover[:-1]) > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    spans = [{"start": p, "end": q} for p, q in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
    return {"n_words": n_words, "n_hit": int(hit.sum()), "items": sorted(items), "spans": spans}


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **how: object) -> DataFrame:
    """The documents that hold no window of the benchmark; its items without an id count as well."""
    name, item_id = fresh(docs, "_found")[0], str(how.get("item_id", "item_id"))
    items = items.withColumn(item_id, F.coalesce(F.col(item_id).cast("string"), F.lit("")))
    return find(docs, items, text, out=name, **how).where(F.col(name)["n_hit"] == 0).select(*docs.columns)
