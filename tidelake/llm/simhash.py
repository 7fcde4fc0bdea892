"""SimHash near-duplicates: fingerprints linked through a Gray-order hierarchical index.

A fingerprint has a bit set where more than half of the XXH64 hashes (seed 42) of the text's shingles have it. Shingles are runs of
WORDS words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered, joined by one blank, repeats included; a shorter text is one shingle, a
text without words has fingerprint zero. Rows whose fingerprints differ in LIMIT bits or fewer are linked; a component is what links
connect.

Distinct fingerprints are sorted by their Gray rank, so that neighbours differ in few bits, and cut by ranges into segments (one for LEAST
fingerprints, at most SEGMENTS). In a segment FAN neighbours form a node, FAN nodes a node of the next level, and so on: a node holds
the pattern that all below it share (a mask and the bits under it), and a level adds the part that its parent's mask lacks. Two nodes are compared on the
bits that both masks have; that count is the sum of the differences so far and those of the newly shared bits, so that it only grows on the
way down, and beyond LIMIT the whole pair of groups is dropped. A pair of groups already known to lie in one component is dropped too, so a
dense group of near copies isn't expanded into its pairs.

Each segment first joins with itself. Segments' patterns are the upper nodes: a fingerprint visits the other segments whose pattern is near enough
(of two segments one visits the other, by turns), with the component it has so far. Tasks return edges of spanning forests, never pairs of
a group. A task holds one segment (2^14 fingerprints, or 1/4096 of all where that is more) and one chunk of visitors.

A segment's pattern fixes about log2(number of segments) bits. A fingerprint lies within LIMIT of about 3 of 5 segments at 200 segments and 1 of 5 at 4096, and visits half of
these; how many fingerprints it is compared with grows like the same number for log2(n) bits, far slower than n.

Defined cases: a null text has no words; a null id belongs to its component but is never its smallest id, and a component of null ids only has none; repeated rows
share a fingerprint; an empty table gives an empty result; other columns stay, and one named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import byte_texts, discard, fresh, small_batches, written
from .components import components

WORDS, LIMIT, SEED = 4, 4, 42
SEGMENTS, LEAST = 4096, 1 << 14
FAN = 4
#: Fingerprints of one row between stages; of a block that is routed at once; pairs of nodes expanded at once.
CHUNK, BLOCK, PAIRS = 1 << 13, 64, 1 << 15
#: Bytes of text split into words at once.
PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about PIECE bytes, cut at white space."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of a text, piece by piece."""
    digest, held, some = xxhash.xxh64_intdigest, [], False
    for piece in _pieces(text.lower()):
        held += piece.split()
        if len(held) < words:
            continue
        line = b" ".join(held)
        ends = np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1) - 1
        starts = np.append(0, ends[:-1] + 1)
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts[: len(held) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)
        some, held = True, held[len(held) - words + 1 :]
    if held and not some:
        yield np.array([digest(b" ".join(held), seed)], np.uint64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    n, ones = 0, np.zeros(64, np.int64)
    for h in shingle_hashes(text, words, seed):
        for k in range(0, len(h), 1 << 16):
            part = h[k : k + (1 << 16)]
            ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist())


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Place of each fingerprint in Gray order."""
    out = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def pattern(f: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """The bits that all fingerprints share: mask and values."""
    both, any_ = np.bitwise_and.reduce(f), np.bitwise_or.reduce(f)
    mask = ~(both ^ any_)
    return mask, both & mask


class Index:
    """Fingerprints in Gray order with the patterns of their groups, level by level, and the label that a group shares (or -1)."""

    def __init__(self, f: np.ndarray, labels: np.ndarray):
        self.f, self.labels = f, labels
        self.masks, self.bits = [np.full(len(f), ~np.uint64(0))], [f]
        low = high = f
        while len(low) > 1:
            at = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            mask = ~(low ^ high)
            self.masks.append(mask)
            self.bits.append(low & mask)
        self.share(labels)

    @property
    def top(self) -> int:
        return len(self.bits) - 1

    def share(self, labels: np.ndarray) -> None:
        self.same, low, high = [labels], labels, labels
        for _ in range(self.top):
            at = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.same.append(np.where(low == high, low, -1))


class Forest:
    """Labels joined so far; keeps the edges that joined them."""

    def __init__(self, n: int):
        self.up, self.edges = np.arange(n), []

    def grow(self, n: int) -> None:
        self.up = np.append(self.up, np.arange(len(self.up), n))

    def join(self, x: np.ndarray, y: np.ndarray) -> int:
        """Joins labels pairwise; how many joins were new."""
        new = 0
        p, q = self.up[x], self.up[y]
        apart = p != q
        if not apart.any():
            return 0
        up = self.up
        for a, b in np.unique(np.stack([p[apart], q[apart]]), axis=1).T.tolist():
            while up[a] != a:
                a = int(up[a])
            while up[b] != b:
                b = int(up[b])
            if a != b:
                up[max(a, b)] = min(a, b)
                self.edges.append((a, b))
                new += 1
        while (up != (shorter := up[up])).any():
            up = shorter
        self.up = up
        return new


def search(x: Index, y: Index, forest: Forest, limit: int = LIMIT) -> None:
    """Joins the labels of all fingerprints of x and y that differ in limit bits or fewer; x may be y."""
    itself, fan = x is y, np.arange(FAN)
    stack = [(x.top, y.top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    since = joined = 0
    while stack:
        i, j, a, b = stack.pop()
        if len(a) > PAIRS:
            stack.append((i, j, a[PAIRS:], b[PAIRS:]))
            a, b = a[:PAIRS], b[:PAIRS]
        near = np.bitwise_count((x.bits[i][a] ^ y.bits[j][b]) & x.masks[i][a] & y.masks[j][b]) <= limit
        p, q = x.same[i][a], y.same[j][b]
        near &= (p < 0) | (q < 0) | (forest.up[p] != forest.up[q])
        a, b = a[near], b[near]
        if not len(a):
            continue
        if i == j == 0:
            joined += forest.join(x.labels[a], y.labels[b])
            continue
        grow_x, grow_y = i > 0 and i >= j, j > 0 and j >= i
        ca = a[:, None] * FAN + fan if grow_x else a[:, None]
        cb = b[:, None] * FAN + fan if grow_y else b[:, None]
        ca, cb = np.repeat(ca, cb.shape[1], axis=1).ravel(), np.tile(cb, (1, ca.shape[1])).ravel()
        i, j = i - grow_x, j - grow_y
        there = (ca < len(x.bits[i])) & (cb < len(y.bits[j]))
        if itself:
            there &= ca < cb if i == 0 else ca <= cb
        stack.append((i, j, ca[there], cb[there]))
        since += len(ca)
        if itself and joined and since > 4 * len(x.f):  # groups that lie in one component by now
            x.share(forest.up[x.labels])
            since = joined = 0


def _blob(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def _values(x: bytes) -> np.ndarray:
    return np.frombuffer(x, "<u8").astype(np.uint64)


def _local(limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy().view(np.uint64) for b in batches if b.num_rows]
        if not parts:
            return
        f = np.concatenate(parts)
        forest = Forest(len(f))
        if len(f) > 1:
            index = Index(f, np.arange(len(f)))
            search(index, index, forest, limit)
        roots, (mask, bits), part = f[forest.up], pattern(f), TaskContext.get().partitionId()
        for k in range(0, len(f), CHUNK):
            yield pa.RecordBatch.from_pylist([{"segment": part, "chunk": k // CHUNK, "mask": int(mask.view(np.int64)), "bits": int(bits.view(np.int64)), "prints": _blob(f[k : k + CHUNK]), "roots": _blob(roots[k : k + CHUNK])}], schema=pa.schema([("segment", pa.int32()), ("chunk", pa.int32()), ("mask", pa.int64()), ("bits", pa.int64()), ("prints", pa.binary()), ("roots", pa.binary())]))

    return run


_VISIT = pa.schema([("target", pa.int32()), ("slot", pa.int32()), ("guest", pa.int32()), ("chunk", pa.int32()), ("prints", pa.binary()), ("roots", pa.binary())])


def _route(patterns: list[tuple[int, int, int]], slots: int, limit: int) -> Callable:
    """Each chunk to the segments it visits, and to its own segment (guest -1) once for each slot."""
    names = np.array([p[0] for p in patterns])
    masks, bits = (np.array([p[k] for p in patterns], np.int64).view(np.uint64) for k in (1, 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, f, roots = r["segment"], _values(r["prints"]), _values(r["roots"])
                for s in range(slots):
                    yield pa.RecordBatch.from_pylist([{"target": own, "slot": s, "guest": -1, "chunk": r["chunk"], "prints": r["prints"], "roots": r["roots"]}], schema=_VISIT)
                at = np.arange(0, len(f), BLOCK)
                low, high = np.bitwise_and.reduceat(f, at), np.bitwise_or.reduceat(f, at)
                mask = ~(low ^ high)
                hosts = np.flatnonzero((names != own) & ((own < names) == ((names + own) % 2 == 0)))
                for k in hosts.tolist():
                    blocks = np.bitwise_count((low ^ bits[k]) & mask & masks[k]) <= limit
                    if not blocks.any():
                        continue
                    go = np.repeat(blocks, BLOCK)[: len(f)] & (np.bitwise_count((f ^ bits[k]) & masks[k]) <= limit)
                    if go.any():
                        yield pa.RecordBatch.from_pylist([{"target": int(names[k]), "slot": own % slots, "guest": own, "chunk": r["chunk"], "prints": _blob(f[go]), "roots": _blob(roots[go])}], schema=_VISIT)

    return run


def _host(limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, index, forest, ids = None, [], None, None, None

        def edges() -> pa.RecordBatch:
            back = np.array(list(ids), np.uint64).view(np.int64)
            pairs = np.array(forest.edges, np.int64).reshape(-1, 2)
            forest.edges.clear()
            return pa.RecordBatch.from_arrays([pa.array(back[pairs[:, 0]]), pa.array(back[pairs[:, 1]])], names=["a", "b"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["target"], r["slot"]) != key:
                    if forest is not None and forest.edges:
                        yield edges()
                    key, own, index, forest = (r["target"], r["slot"]), [], None, None
                if r["guest"] < 0:
                    own.append((_values(r["prints"]), _values(r["roots"])))
                    continue
                if index is None:
                    roots = np.concatenate([x[1] for x in own])
                    known, labels = np.unique(roots, return_inverse=True)
                    ids = {v: i for i, v in enumerate(known.tolist())}
                    index, forest, own = Index(np.concatenate([x[0] for x in own]), labels), Forest(len(known)), []
                known, labels = np.unique(_values(r["roots"]), return_inverse=True)
                known = np.array([ids.setdefault(v, len(ids)) for v in known.tolist()])
                forest.grow(len(ids))
                search(Index(_values(r["prints"]), known[labels]), index, forest, limit)
        if forest is not None and forest.edges:
            yield edges()

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for prints, roots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = _values(prints).view(np.int64), _values(roots).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def links(prints: DataFrame, limit: int = LIMIT) -> DataFrame:
    """prints: fp, rank (long; rank shifted so that its order is unsigned), each fingerprint once. Edges a, b that connect exactly what pairs
    of fingerprints with limit differing bits or fewer connect."""
    segments = max(1, min(SEGMENTS, prints.count() // LEAST))
    laid = prints.select("fp", "rank").repartitionByRange(segments, "rank").sortWithinPartitions("rank").select("fp")
    segment = written(laid.mapInArrow(_local(limit), "segment int, chunk int, mask long, bits long, prints binary, roots binary"), "simhash-segments")
    patterns = [tuple(r) for r in segment.where("chunk = 0").select("segment", "mask", "bits").collect()]  # one row a segment
    stars = segment.select("prints", "roots").mapInArrow(_stars, "a long, b long")
    if len(patterns) < 2:
        return written(stars, "simhash-edges")
    visits = segment.mapInArrow(_route(patterns, 1 + len(patterns) // 256, limit), "target int, slot int, guest int, chunk int, prints binary, roots binary")
    dealt = visits.repartition("target", "slot").sortWithinPartitions("target", "slot", "guest", "chunk")
    return written(stars.unionByName(dealt.mapInArrow(_host(limit), "a long, b long")), "simhash-edges")


def near(df: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "simhash", words: int = WORDS, limit: int = LIMIT, keep_text: bool = True) -> DataFrame:
    """df with a struct column: fingerprint (16 lowercase hex digits) and component_id, the smallest id that links reach."""
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c.lower() != out.lower() and (keep_text or c != text)]
    fp, rank = fresh(df, "_fp", "_rank")
    src = df.select(*keep, *([] if text in keep else [F.col(text)]))
    schema = df.select(*keep, F.lit(0).cast("long").alias(fp), F.lit(0).cast("long").alias(rank)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t, words) for t in byte_texts(b.column(text))], np.uint64)
            place = gray_rank(f) ^ np.uint64(1 << 63)  # signed order is the order of ranks
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(f.view(np.int64)), pa.array(place.view(np.int64))], names=[*keep, fp, rank])

    docs = written(src.mapInArrow(run, schema), "simhash-docs")
    prints = written(docs.groupBy(F.col(fp).alias("fp"), F.col(rank).alias("rank")).agg(F.min(doc_id).alias("low")), "simhash-prints")
    edges = links(prints, limit)
    roots = written(components(edges).select("node", "root"), "simhash-roots")
    known = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    low, one = fresh(docs, "_low", "_one")
    known = known.join(known.groupBy("root").agg(F.min("low").alias(low)), "root").select(F.col("fp").alias(one), low)
    known = written(known, "simhash-known")
    for t in (edges, roots, prints):
        discard(t)
    struct = F.struct(F.lower(F.lpad(F.hex(F.col(fp)), 16, "0")).alias("fingerprint"), F.col(low).alias("component_id"))
    return docs.join(known, F.col(fp) == F.col(one)).select(*keep, struct.alias(out))
