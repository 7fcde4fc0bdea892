"""Merkle manifest of a dataset: every row a leaf, a tree per group (such as lang), a tree over the groups' roots.

H is lowercase hex SHA-256 of the concatenated inputs (digests as hex text). A leaf is H of the named columns, each `-` if null, else its
UTF-8 byte count, `:` and its value. Within a group, leaves ascend by the key; while more than one node remains, every two
consecutive ones (the last run may be a single one) become their H. The groups' roots, ordered by group (null first, by UTF-8 bytes), likewise give the root.

Spark sorts small rows (group, key, leaf) by ranges that include a row number, so that neither a frequent group nor a frequent key is bound to one task, and
numbers them by partition offsets. HEIGHT levels are one step: 2^HEIGHT consecutive positions of a group are an aligned bucket. Executors hand Arrow batches of whole buckets to
DuckDB, which builds a level by `sha256(string_agg(h, '' ORDER BY pos))` after the other, and looks up each node's sibling on each level. Spark takes the
buckets' roots as nodes of the next step (three steps for 2^36 rows), then the groups' roots as nodes of one more tree, and joins the outer
proofs to the inner ones. A proof of n rows has about log2(n) siblings of 64 bytes.

Defined cases: null texts, ids or groups are `-` in the leaf; a null group is a group; null keys come first; rows with one key are ordered by their leaf, and rows equal in
all of it are interchangeable leaves; an empty table gives an empty result; other columns stay, and one named like the result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, written

#: Levels of a bucket (4096 leaves), and nodes that go to DuckDB at once.
HEIGHT, NODES = 12, 1 << 15
_NODE = pa.schema([("r", pa.int64()), ("g", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("top", pa.string()), ("path", pa.list_(pa.string()))])


def leaf(columns: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """H of the columns; changed: other values for some."""
    parts = []
    for c in columns:
        v = (changed or {}).get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """rows: r (long, distinct), g (string) and sort columns k*, h. With n, the rows of the group, and pos, the place in it by k*, h, r."""
    order = [c for c in rows.columns if c.startswith("k")]
    laid = rows.repartitionByRange("g", *order, "h", "r").sortWithinPartitions("g", *order, "h", "r")
    at = F.monotonically_increasing_id()  # a partition's number and the row's place in it
    laid = written(laid.select("r", "g", "h", at.alias("at"), F.shiftright(at, 33).alias("part")), name)
    runs = laid.groupBy("part", "g").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("m"))
    of_group = Window.partitionBy("g")
    runs = runs.select("part", "g", "first", (F.sum("m").over(of_group.orderBy("part")) - F.col("m")).alias("before"), F.sum("m").over(of_group).alias("n"))
    return laid.join(runs, ["part", "g"]).select("r", "g", "h", "n", (F.col("before") + F.col("at") - F.col("first")).alias("pos"))


def _levels(con: duckdb.DuckDBPyConnection, nodes: pa.Table) -> pa.Table:
    """nodes: b (bucket), levels (of its tree), pos, h, whole buckets only. r, top (the bucket's root), path (siblings upwards: L or R and the digest, empty where the run has no other)."""
    con.register("nodes", nodes)
    con.execute("CREATE OR REPLACE TEMP TABLE level0 AS SELECT b, levels, pos, h FROM nodes")
    height = max(nodes["levels"].to_pylist())
    for k in range(height):
        con.execute(f"CREATE OR REPLACE TEMP TABLE level{k + 1} AS SELECT b, levels, pos >> 1 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM level{k} WHERE levels > {k} GROUP BY b, levels, pos >> 1")
    sides = [f"CASE WHEN x.levels > {k} THEN coalesce(CASE WHEN (x.pos >> {k}) & 1 = 1 THEN 'L' ELSE 'R' END || s{k}.h, '') END" for k in range(height)]
    joins = " ".join(f"LEFT JOIN level{k} s{k} ON s{k}.b = x.b AND s{k}.pos = xor(x.pos >> {k}, 1)" for k in range(height))
    tops = " UNION ALL ".join(f"SELECT b, h FROM level{k} WHERE levels = {k}" for k in range(height + 1))
    path = f"list_filter([{', '.join(sides)}], lambda s: s IS NOT NULL)" if sides else "CAST([] AS VARCHAR[])"
    out = con.sql(f"SELECT x.r, top.h AS top, {path} AS path FROM nodes x JOIN ({tops}) top ON top.b = x.b {joins} ORDER BY x.at").to_arrow_table()
    con.unregister("nodes")
    return out


def _climb(batches: Iterator[pa.RecordBatch], high: int) -> Iterator[pa.RecordBatch]:
    """Nodes sorted by group and position, whole buckets in each task: their buckets' roots and the siblings below these."""
    con = duckdb.connect(config={"threads": 1})

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        pos, n = t["pos"].to_numpy(), t["n"].to_numpy()
        levels = np.minimum(np.ceil(np.log2(np.maximum(n, 1))), high).astype(np.int32)
        g = t["g"].combine_chunks().dictionary_encode().indices.to_numpy()
        start = np.append(True, (g[1:] != g[:-1]) | (pos[1:] >> high != pos[:-1] >> high))
        nodes = pa.table({"at": np.arange(len(pos)), "r": t["r"], "b": np.cumsum(start), "levels": levels, "pos": pos & ((1 << high) - 1), "h": t["h"]})
        x = _levels(con, nodes)
        out = pa.table([t["r"], t["g"], t["n"], t["pos"], x["top"].cast(pa.string()), x["path"].cast(pa.list_(pa.string()))], schema=_NODE)
        yield from out.combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < NODES:
            continue
        t = pa.Table.from_batches(held)
        g, pos = t["g"].to_pylist(), t["pos"].to_numpy() >> high
        cut = len(g) - 1  # the last bucket may go on in the next batch
        while cut and (g[cut - 1], pos[cut - 1]) == (g[-1], pos[-1]):
            cut -= 1
        if cut:
            yield from done(t.slice(0, cut))
            held = t.slice(cut).to_batches()
    if held:
        yield from done(pa.Table.from_batches(held))


def _tree(nodes: DataFrame, name: str, high: int) -> tuple[DataFrame, DataFrame]:
    """nodes: r, g, h, n, pos. A table of r, g and path (siblings up to the group's root), and one of each group's root: g, top."""
    steps = []
    while True:
        clustered = nodes.withColumn("b", F.shiftright("pos", high)).repartition("g", "b").sortWithinPartitions("g", "pos")
        steps.append(written(clustered.select("r", "g", "n", "pos", "h").mapInArrow(lambda batches: _climb(batches, high), "r long, g string, n long, pos long, top string, path array<string>"), name))
        first = steps[-1].where(F.col("pos") % (1 << high) == 0)
        if steps[-1].where(F.col("n") > 1 << high).isEmpty():
            break
        # a bucket is a node of the next step; a group of one bucket stays as it is
        nodes = first.select(F.lit(0).cast("long").alias("r"), "g", F.col("top").alias("h"), F.ceil(F.col("n") / (1 << high)).cast("long").alias("n"), F.shiftright("pos", high).alias("pos"))
    tops = first.where("pos = 0").select("g", "top")
    paths = steps[-1]
    for below in reversed(steps[:-1]):
        outer = paths.select(F.col("g").alias("og"), F.col("pos").alias("opos"), F.col("path").alias("outer"))
        paths = below.join(outer, (F.col("g") == F.col("og")) & (F.shiftright("pos", high) == F.col("opos"))).select("r", "g", "pos", F.concat("path", "outer").alias("path"))
    return paths.select("r", "g", "path"), tops


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    def step(h: Column, s: Column) -> Column:
        other = F.substring(s, 2, 64)
        return F.sha2(F.when(F.startswith(s, F.lit("L")), F.concat(other, h)).otherwise(F.concat(h, other)), 256)

    return F.aggregate(path, start, step)


def manifest(df: DataFrame, columns: Sequence[str], key: str, group: str, tampered: tuple[Column, dict[str, Column]] | None = None, out: str = "merkle", drop: Sequence[str] = (), height: int = HEIGHT) -> DataFrame:
    """df with a struct column: leaf, subroot, root, proof (digest of the siblings in order), path (the siblings, with their side), folded (the root from leaf and path) and verified.

    tampered: a condition and other values of columns; where it holds, folded starts from the leaf of these. drop: columns left out of the result."""
    keep = [c for c in df.columns if c.lower() != out.lower() and c not in drop]
    rid, own, seen, g, k = fresh(df, "_rid", "_leaf", "_seen", "_g", "_key")
    honest = leaf(columns)
    found = honest if tampered is None else F.when(tampered[0], leaf(columns, tampered[1])).otherwise(honest)
    group_key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = df.select(*keep, F.monotonically_increasing_id().alias(rid), honest.alias(own), found.alias(seen), group_key.alias(g), F.col(key).alias(k))
    rows = written(rows, "merkle-rows")
    leaves = numbered(rows.select(F.col(rid).alias("r"), F.col(g).alias("g"), F.col(k).alias("k"), F.col(own).alias("h")), "merkle-order")
    paths, tops = _tree(leaves, "merkle-nodes", height)
    tops = written(tops.select(F.monotonically_increasing_id().alias("r"), F.col("g").alias("name"), "top"), "merkle-subroots")
    over = numbered(tops.select("r", F.lit("").alias("g"), F.col("name").alias("k"), F.col("top").alias("h")), "merkle-groups")
    upper, roots = _tree(over, "merkle-upper", height)
    above = upper.join(tops, "r").join(roots.select("g", F.col("top").alias("root")), "g").select("name", F.col("top").alias("subroot"), "root", F.col("path").alias("above"))
    pr, info = fresh(rows, "_pr", "_info")
    full = paths.join(above, F.col("g") == F.col("name")).select(F.col("r").alias(pr), F.struct("subroot", "root", F.concat("path", "above").alias("path")).alias(info))
    f = F.col(info)
    fold = folded(F.col(seen), f["path"])
    proof = F.sha2(F.array_join(F.transform(f["path"], lambda s: F.substring(s, 2, 64)), ""), 256)
    x = rows.join(full, F.col(rid) == F.col(pr))
    x = x.select(*keep, F.struct(F.col(own).alias("leaf"), f["subroot"].alias("subroot"), f["root"].alias("root"), proof.alias("proof"), f["path"].alias("path"), fold.alias("folded")).alias(out))
    return x.withColumn(out, F.col(out).withField("verified", F.col(out)["folded"] == F.col(out)["root"]))
