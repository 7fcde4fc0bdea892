"""N-gram Jaccard join: MinHash LSH forest with exact verification.

Two texts are linked if the sets of their five-word shingles have a Jaccard similarity of THRESHOLD or more. Words are
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of texts whose A-Z are lowered; a text of one to four words is one shingle. Texts
with one shingle set are one representative.

Each representative has TREES signatures of DEPTH minima. All signatures are sorted, tree by tree, so that each tree lies there
as a prefix trie: the texts under a node are neighbours, and the prefix that a text shares with the one before it says at
which depth they part. The sort is by ranges that include the text, so a node with most of the texts is spread over many
tasks; partitions are linked by their first and last rows.

Prefixes are shortened from DEPTH on. At a level, texts that share a prefix of its length in some tree are
chained, connected chains are the candidate components, and within each all pairs are verified exactly. From the
similarities of all links found, the recall of the level is measured: a link of similarity s is found with probability
1 - (1 - s^d)^TREES, so that each stands for the inverse of it. Prefixes are then shortened to the depth at which the recall so
measured reaches the target, where it is measured again; shortening ends when it does,
or at the depth at which texts just at the threshold meet with that probability whatever the data (floor_depth). At a further level
only components that grew are verified again. A threshold too low for the target is refused.

A component of more than BLOCK texts is first divided by an exact filter: two similar texts share one of their rarest
shingles (of n, as many as n less the least overlap, plus one; rare within the component), so texts without such a shingle in common, which met
by chance or by phrases that all share, part. The rest is dealt out as pairs of blocks of BLOCK texts, so a task never holds more than two
blocks and no pair is ever a row. A representative's links count all copies on the other side.

Defined cases: null texts and texts without a word are linked to nothing, and each is its own class; repeated rows are
copies; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ALNUM_SEPARATORS, byte_texts, discard, fresh, hashed, mix, shingles, small_batches, written
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 20, 6, 0.9999
BLOCK = 64
_RNG = np.random.default_rng(20240229)
_MULT = (_RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def meeting(similarity: float | np.ndarray, depth: int) -> float | np.ndarray:
    """The probability that two texts share a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def floor_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix at which texts with this similarity meet in some tree with this probability."""
    d = DEPTH
    while d > 1 and meeting(threshold, d) < recall:
        d -= 1
    if meeting(threshold, d) < recall:
        raise ValueError(f"{TREES} trees don't reach a recall of {recall} at a threshold of {threshold}")
    return d


def sets(texts: list[bytes], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text."""
    for i, j, h, bounds, *_ in hashed([t.lower() for t in texts], ALNUM_SEPARATORS):
        for r in range(j - i):
            yield np.unique(shingles(h[bounds[r] : bounds[r + 1]], k))


def _signatures(texts: list[bytes], k: int) -> tuple[list, list, list, list]:
    n, k1, k2, sig = [], [], [], []
    for i, j, h, bounds, *_ in hashed([t.lower() for t in texts], ALNUM_SEPARATORS):
        own = [np.unique(shingles(h[bounds[r] : bounds[r + 1]], k)) for r in range(j - i)]
        size = np.array([len(x) for x in own])
        full = np.flatnonzero(size)
        minima = np.zeros((j - i, TREES * DEPTH), np.uint32)
        a, b = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
        if len(full):
            g = np.concatenate([own[r] for r in full])
            at = np.append(0, np.cumsum(size[full])[:-1])
            a[full] = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), at)
            b[full] = np.add.reduceat(mix(g ^ np.uint64(0x14057B7EF767814F)), at)
            for q in range(TREES * DEPTH):
                minima[full, q] = np.minimum.reduceat((g * _MULT[q]) >> np.uint64(32), at)
        n += size.tolist()
        k1.append(a.view(np.int64)), k2.append(b.view(np.int64))
        sig += [x.tobytes() if s else b"" for x, s in zip(minima, size, strict=True)]
    return n, np.concatenate(k1) if k1 else [], np.concatenate(k2) if k2 else [], sig


def _verify(rids: np.ndarray, block: np.ndarray, copies: np.ndarray, own: list[np.ndarray], within: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text in this pair of blocks: copies linked to it, the smallest text it is connected to, texts linked to it, and
    for each depth how many links each of these stands for beside itself, in sum."""
    m = len(rids)
    inter = np.zeros((m, m), np.float32)
    values, at, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(x) for x in own])
    shared = count[at] > 1
    at, row = at[shared], row[shared]
    code = np.full(len(values), -1)
    code[count > 1] = np.arange(int((count > 1).sum()))
    at = code[at]
    for lo in range(0, int((count > 1).sum()), 32768):
        sel = (at >= lo) & (at < lo + 32768)
        x = np.zeros((m, min(32768, int((count > 1).sum()) - lo)), np.float32)
        x[row[sel], at[sel] - lo] = 1
        inter += x @ x.T
    size = np.array([len(x) for x in own], np.float64)
    inter = inter.astype(np.float64)
    union = size[:, None] + size[None, :] - inter
    linked = inter * 1_000_000 >= round(threshold * 1_000_000) * union
    np.fill_diagonal(linked, False)
    if not within:
        linked &= block[:, None] != block[None, :]
    links = linked @ copies
    beside = np.zeros((m, DEPTH))
    for i, j in zip(*np.nonzero(linked.any(axis=1)[:, None] & np.ones((1, DEPTH), bool)), strict=True):
        s = inter[i, linked[i]] / union[i, linked[i]]
        beside[i, j] = (1 / meeting(s, int(j) + 1) - 1).sum()
    root = np.arange(m)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
        p, q = find(i), find(j)
        if p != q:
            if rids[p] > rids[q]:
                p, q = q, p
            root[q] = p
    return links, rids[[find(i) for i in range(m)]], linked.sum(axis=1), beside


def neighbours(rows: DataFrame, least: int, name: str) -> DataFrame:
    """rows: key (binary, all of one length, words of four bytes) and r (long). Sorted by both: each row's r with that of the row before it (a, b), and how many words
    of the key both begin with (shared), where these are least or more. No key, however frequent, is bound to one task."""

    def words(keys: pa.Array) -> np.ndarray:
        size = len(keys[0].as_py())
        return np.frombuffer(keys.cast(pa.binary(size)).buffers()[1], ">u4", len(keys) * size // 4).reshape(len(keys), size // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, before = TaskContext.get().partitionId(), None, None

        def edge(row: tuple, second: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([row[1]], pa.int64()), pa.array([None], pa.int64()), pa.array([int(second)], pa.int32()), pa.array([part], pa.int32()), pa.array([row[0]], pa.binary())], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            r = b.column(1).to_numpy()
            if last is None:
                yield edge((b.column(0)[0].as_py(), int(r[0])), False)
            k = words(b.column(0))
            last = (b.column(0)[b.num_rows - 1].as_py(), int(r[-1]))
            if before is not None:
                k, r = np.concatenate([before[0], k]), np.concatenate([before[1], r])
            shared = np.logical_and.accumulate(k[1:] == k[:-1], axis=1).sum(axis=1)
            at = np.flatnonzero(shared >= least)
            if len(at):
                none = pa.nulls(len(at), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(r[at + 1]), pa.array(r[at]), pa.array(shared[at].astype(np.int32)), none, pa.nulls(len(at), pa.binary())], names=names)
            before = k[-1:].copy(), r[-1:].copy()
        if last is not None:
            yield edge(last, True)

    names = ["a", "b", "shared", "part", "key"]
    found = written(rows.select("key", "r").repartitionByRange("key", "r").sortWithinPartitions("key", "r").mapInArrow(run, "a long, b long, shared int, part int, key binary"), name)
    # two rows of each partition
    ends = sorted(found.where("part is not null").collect(), key=lambda x: (x["part"], x["shared"]))
    across = []
    for x, y in zip(ends, ends[1:], strict=False):
        if x["part"] != y["part"]:
            same = 0
            while same < len(x["key"]) // 4 and x["key"][: 4 * same + 4] == y["key"][: 4 * same + 4]:
                same += 1
            if same >= least:
                across.append((y["a"], x["a"], same))
    return found.where("part is null").select("a", "b", "shared").unionByName(rows.sparkSession.createDataFrame(across, "a long, b long, shared int"))


def with_roots(comp: DataFrame) -> DataFrame:
    return comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct())


def join(df: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "near", k: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """df with a struct column: class_id (the smallest id of the class), n_links (other rows whose text is similar or equal),
    first (true for one row of each class: that with the smallest id, of these with the smallest hash of its text; nulls last). A column with that name is replaced."""
    spark = df.sparkSession
    small_batches(spark)
    keep = [c for c in df.columns if c.lower() != out.lower()]
    rid, n, k1, k2, sig = fresh(df, "_rid", "_n", "_k1", "_k2", "_sig")
    src = df.select(*keep, *([] if text in keep else [F.col(text)]))
    schema = src.withColumns({rid: F.lit(0).cast("long"), n: F.lit(0), k1: F.lit(0).cast("long"), k2: F.lit(0).cast("long"), sig: F.lit(b"")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            size, a, c, s = _signatures(byte_texts(b.column(text)), k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(at, at + b.num_rows)), pa.array(size, pa.int32()), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(s, pa.binary())], names=[*b.schema.names, rid, n, k1, k2, sig])
            at += b.num_rows

    docs = written(src.mapInArrow(run, schema), "ngram-docs")
    ids = F.col(doc_id)
    first = F.min(F.struct(ids.isNull().alias("none"), ids.alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.col(rid).alias("rid")))
    groups = written(docs.where(F.col(n) > 0).groupBy(k1, k2, n).agg(F.min(rid).alias("rep"), F.count(F.lit(1)).alias("copies"), F.min(ids).alias("low"), first.alias("first")), "ngram-sets")

    # the forest: every signature after the number of its tree
    size = DEPTH * 4
    reps = written(docs.select(F.col(rid).alias("r"), F.col(sig).alias("sig")).join(groups.select(F.col("rep").alias("r")), "r"), "ngram-reps")
    keys = F.array(*(F.concat(F.lit(bytearray(t.to_bytes(4, "big"))), F.substring("sig", t * size + 1, size)) for t in range(TREES)))
    floor = floor_depth(threshold, recall)
    met = neighbours(reps.select(F.explode(keys).alias("key"), "r"), floor + 1, "ngram-forest")
    discard(reps)
    texts = docs.select(F.col(rid).alias("node"), F.col(n).alias("n"), F.col(text).cast("string").alias("text"))

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, own in enumerate(sets(byte_texts(b.column("text")), k)):
                m = len(own)
                yield pa.RecordBatch.from_arrays([pa.repeat(b.column("root")[i], m), pa.repeat(b.column("node")[i], m), pa.repeat(pa.scalar(m, pa.int32()), m), pa.array(own.view(np.int64))], names=["root", "node", "n", "s"])

    def divided(comp: DataFrame) -> DataFrame:
        """comp, its components of more than BLOCK texts divided by the rarest shingles of these."""
        large = written(comp.groupBy("root").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK).select("root"), "ngram-roots")
        if large.isEmpty():
            return comp
        inside = written(comp.join(large.select("root"), "root").join(texts.select("node", "text"), "node").select("root", "node", "text").mapInArrow(exploded, "root long, node long, n int, s long"), "ngram-large")
        common = inside.groupBy("root", "s").agg(F.count(F.lit(1)).alias("df"))
        rank = F.row_number().over(Window.partitionBy("root", "node").orderBy("df", "s"))
        rare = inside.join(common, ["root", "s"]).withColumn("rank", rank).where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-6) + 1) & (F.col("df") > 1))
        word = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
        linked = neighbours(rare.select(F.concat(word("root"), word("s")).alias("key"), F.col("node").alias("r")), 4, "ngram-rare")
        parts = with_roots(components(linked.select("a", "b")))
        return written(comp.join(large.select("root"), "root", "left_anti").select("node", "root").unionByName(parts.select("node", "root")), "ngram-parts")

    def pairs_of(comp: DataFrame) -> DataFrame:
        """Pairs of blocks of each component."""
        sized = comp.groupBy("root").agg(F.count(F.lit(1)).alias("m"))
        cand = comp.join(sized, "root").join(groups.select(F.col("rep").alias("node"), "copies"), "node").join(texts.select("node", "text"), "node")
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        cand = cand.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = cand.select("root", "node", "copies", "block", "text", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "text")
        return dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("node", "copies", "block", "text")

        def done(rows: list[tuple]) -> pa.RecordBatch:
            node, copies, block, texts = zip(*rows, strict=True)
            links, root, found, beside = _verify(np.array(node), np.array(block), np.array(copies), list(sets([t or b"" for t in texts], k)), len(set(block)) == 1, threshold)
            return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64()), pa.array(root, pa.int64()), pa.array(found, pa.int64()), pa.array(list(beside), pa.list_(pa.float64()))], names=["node", "links", "root", "found", "beside"])

        key, rows = None, []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in names[:3]] + [byte_texts(b.column("text"))]
            for x, row in zip(zip(*(b.column(c).to_pylist() for c in ("root", "i", "j")), strict=True), zip(*cols, strict=True), strict=True):
                if x != key and rows:
                    yield done(rows)
                    rows = []
                key = x
                rows.append(row)
        if rows:
            yield done(rows)

    checked = comp = None
    depth = DEPTH
    while True:
        # tables between the steps keep plans, and what the driver holds of them, small
        now = written(with_roots(components(met.where(F.col("shared") > depth).select("a", "b"))).select("node", "root"), "ngram-components")
        grown = now
        if comp is not None:
            old = now.join(comp.withColumnRenamed("root", "old"), "node", "left").withColumn("old", F.coalesce("old", "node"))
            grown = written(now.join(old.groupBy("root").agg(F.min("old").alias("p"), F.max("old").alias("q")).where("p <> q").select("root"), "root").select("node", "root"), "ngram-grown")
        new = written(pairs_of(divided(grown)).mapInArrow(verify, "node long, links long, root long, found long, beside array<double>"), "ngram-links")
        checked = new if checked is None else checked.join(grown.select("node"), "node", "left_anti").unionByName(new)
        comp = now
        sums = [F.coalesce(F.sum(F.element_at("beside", d)), F.lit(0.0)).alias(f"d{d}") for d in range(floor, depth + 1)]
        x = checked.agg(F.coalesce(F.sum("found"), F.lit(0)).alias("found"), *sums).first()
        reached = [d for d in range(floor, depth + 1) if x["found"] and x["found"] >= recall * (x["found"] + x[f"d{d}"])]
        if depth in (floor, *reached):
            break
        depth = max(reached, default=floor)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    final = written(components(checked.select(F.col("node").alias("a"), F.col("root").alias("b"))), "ngram-final")

    known = groups.join(links.withColumnRenamed("node", "rep"), "rep", "left").join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    classes = known.groupBy("root").agg(F.min("low").alias("class_id"), F.min("first").alias("one"))
    known = written(known.join(classes, "root").select(F.col(k1).alias("x"), F.col(k2).alias("y"), F.col(n).alias("z"), "class_id", F.col("one")["rid"].alias("one"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "ngram-classes")
    info = fresh(docs, "_info")[0]
    known = known.select(F.col("x").alias(k1), F.col("y").alias(k2), F.col("z").alias(n), F.struct("class_id", "one", "links").alias(info))
    x = F.col(info)
    near = F.struct(x["class_id"].alias("class_id"), x["links"].cast("long").alias("n_links"), (F.col(rid) == x["one"]).alias("first"))
    alone = F.struct(ids.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    linked = docs.where(F.col(n) > 0).join(known, [k1, k2, n]).select(*keep, near.alias(out))
    return linked.unionByName(docs.where(F.col(n) == 0).select(*keep, alone.alias(out)))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class, with the columns of df."""
    name = fresh(df, "_near")[0]
    return join(df, text, doc_id, name).where(F.col(name)["first"]).select(*df.columns)
