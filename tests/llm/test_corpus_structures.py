"""The Merkle manifest, phrase collocations and SimHash near-duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelake.llm import collocations, merkle, simhash
from tidelake.llm import queries as Q

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    def leaf(r):
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(nodes):
        out = [nodes]
        while len(nodes) > 1:
            nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
            out.append(nodes)
        return out

    def siblings(levels, p):
        for nodes in levels[:-1]:
            yield p & 1, nodes[p ^ 1] if (p ^ 1) < len(nodes) else ""
            p >>= 1

    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        by.setdefault(r[2], []).append(r)
    order = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([leaf(r) for r in by[g]]) for g in order]
    top = tree([t[-1][0] for t in trees]) if rows else []
    out = []
    for k, g in enumerate(order):
        for p, r in enumerate(by[g]):
            steps, x = [*siblings(trees[k], p), *siblings(top, k)], list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                x[3] += 1
            h = leaf(x)
            for left, other in steps:
                h = H(other, h) if left else H(h, other)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], H(*(o for _, o in steps)), h, h == top[-1][0]))
    return sorted(out, key=repr)


def manifest(df, **options):
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    x = merkle.manifest(df, COLUMNS, "doc_id", "lang", (changed, {"n_chars": F.col("n_chars") + 1}), **options)
    return x.columns, sorted(((r["doc_id"], *(r["merkle"][c] for c in ("leaf", "subroot", "root", "proof", "folded", "verified"))) for r in x.collect()), key=repr)


def manifest_rows(n, seed=1):
    r = random.Random(seed)
    rows = [(r.choice([None, i, i // 2]), r.choice(["a", "", None]), r.choice(["en", "de", None, "é", "z", "und"]) if i < n // 3 else "en", r.choice([None, 5, i]), r.choice([None, "", f"text é {i}", "x" * 5000])) for i in range(n)]
    return rows + rows[:20] + [rows[0]] * 30  # repeated rows, and one key with many


@pytest.mark.parametrize("height", [2, merkle.HEIGHT])
def test_manifest_equals_brute_force(spark, height):
    """Several steps of buckets, tiny groups, null and repeated keys, equal rows."""
    rows = manifest_rows(400)
    columns, got = manifest(spark.createDataFrame(rows, DOCS).repartition(3), height=height)
    assert columns == [*COLUMNS, "merkle"] and got == brute_manifest(rows)


def test_manifest_of_few_rows_and_clashing_names(spark):
    assert manifest(spark.createDataFrame([], DOCS))[1] == []
    one = [(None, None, None, None, None)]
    assert manifest(spark.createDataFrame(one, DOCS))[1] == brute_manifest(one)
    df = spark.createDataFrame([(1, "s", "en", 3, "abc", "x", 9, "g", 0)], DOCS + ", merkle string, _rid int, path string, root int")
    columns, got = manifest(df, drop=["text"])
    assert columns == ["doc_id", "source", "lang", "n_chars", "_rid", "path", "root", "merkle"] and got == brute_manifest([(1, "s", "en", 3, "abc")])


def test_every_language_its_own_group(spark):
    rows = [(i, "s", f"l{i:04d}", 1, "t") for i in range(300)]
    assert manifest(spark.createDataFrame(rows, DOCS), height=3)[1] == brute_manifest(rows)


def test_a_proof_leads_to_the_root_and_a_changed_row_does_not(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(50)]
    for r in merkle.manifest(spark.createDataFrame(rows, DOCS), COLUMNS, "doc_id", "lang").collect():
        h = r["merkle"]["leaf"]
        for s in r["merkle"]["path"]:
            h = H(s[1:], h) if s[:1] == "L" else H(h, s[1:])
        assert h == r["merkle"]["root"] and r["merkle"]["verified"]


def brute_collocations(rows, most=3, least=10, top=2000):
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, most + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        drop = {p[i : i + k] for p, a in cand.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 50 * c[p[i : i + k]]}
        best = []
        for p in cand.keys() - drop:
            s, k = min((1_000_000 * c[p] * c[p] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, l, q, n[lang], -s) for r, (s, a, p, l, q) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def collocation_rows(seed=4):
    r = random.Random(seed)
    rows = [(None, "en"), ("", None), ("...", "en"), ("ONE\ttwo  Three, one two three.\x0bone two", "en"), ("é è é è é", None)]
    for _ in range(400):
        words = [r.choice("alpha beta gamma delta Épsilon zeta eta theta the of".split()) for _ in range(r.randint(1, 40))]
        rows.append(("".join(w + r.choice([" ", " ", " ", "\t", ", ", "\n", "  "]) for w in words), r.choice(["en", "en", "de", None, "und"])))
    return rows + [(" ".join(["hot phrase here"] * 3000), "de"), *[("same text in all copies", "fr")] * 40, ("x " * 100_000, "es")]


@pytest.mark.parametrize("options", [{}, {"top": 5}, {"most": 4, "least": 25}])
def test_collocations_equal_brute_force(spark, options):
    rows = collocation_rows()
    df = spark.createDataFrame([(t, g, 1, "q") for t, g in rows], "text string, lang string, phrase int, words string").repartition(5)
    got = sorted(tuple(r) for r in collocations.mine(df, **options).collect())
    assert got == brute_collocations(rows, **options)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With too few cells all phrases survive the first pass; the counts are the same."""
    rows = collocation_rows(5)
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(collocations, "FEWEST_CELLS", 4)
    monkeypatch.setattr(collocations, "CELLS", 4)
    assert sorted(tuple(r) for r in collocations.mine(df).collect()) == brute_collocations(rows)
    assert collocations.mine(df.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and collocations.mine(df.limit(0)).count() == 0


def test_sketches_overestimate_and_drop_most_rare_phrases(spark):
    import pyarrow as pa

    r = random.Random(6)
    text = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(30_000)) + " often said" * 50
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array(["en"])], names=["text", "lang"])
    blocks = [b for b in collocations.sketch(iter([batch]), 18, 3, 10)]
    maps = [np.zeros((1 << 18) // 8, np.uint8) for _ in range(collocations.ROWS)]
    for b in collocations._merged(iter(blocks), 10):
        for x in b.to_pylist():
            part = np.frombuffer(x["bits"], np.uint8)
            maps[x["q"]][x["block"] * len(part) : (x["block"] + 1) * len(part)] = part
    kept = [x["phrase"] for b in collocations.survivors(iter([batch]), maps, 18, 3) for x in b.to_pylist()]
    assert {"often said", "said often", "often said often", "often", "said"} <= set(kept) and len(kept) < 200


def test_scores_are_exact_beyond_64_bits(spark):
    a = 987_654_321_987
    x = spark.createDataFrame([(a, a + 12_345, a + 99_999)], "a long, l long, r long").select(collocations.score("a", "l", "r").alias("s")).first()["s"]
    assert x == 1_000_000 * a * a // ((a + 12_345) * (a + 99_999))


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, limit=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= limit:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def clusters(seed, groups, each, lonely, bits=3):
    """Fingerprints around centres that chains of links connect, and random ones."""
    r = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for _ in range(groups):
        x = r.getrandbits(64)
        for _ in range(each):
            for _ in range(r.randint(0, bits)):
                x ^= 1 << r.randrange(64)
            out.add(x)
    return sorted(out | {r.getrandbits(64) for _ in range(lonely)})


def test_index_links_what_brute_force_links():
    f = np.array(clusters(1, 30, 30, 300), np.uint64)
    f = f[np.argsort(simhash.gray_rank(f))]
    forest, index = simhash.Forest(len(f)), simhash.Index(f, np.arange(len(f)))
    simhash.search(index, index, forest)
    assert len(set(zip(forest.up.tolist(), brute_components(f.tolist()), strict=True))) == len(set(forest.up.tolist())) == len(set(brute_components(f.tolist())))


def test_gray_neighbours_differ_in_one_bit():
    ranks = np.arange(4096, dtype=np.uint64)
    codes = ranks ^ (ranks >> np.uint64(1))
    assert (simhash.gray_rank(codes) == ranks).all() and (np.bitwise_count(codes[1:] ^ codes[:-1]) == 1).all()


def test_segments_link_across_their_bounds(spark, monkeypatch):
    """Many small segments that visit each other, in several slots, find what one segment finds."""
    monkeypatch.setattr(simhash, "LEAST", 40)
    f = clusters(2, 40, 25, 200)
    ranks = simhash.gray_rank(np.array(f, np.uint64)) ^ np.uint64(1 << 63)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), int(y)) for x, y in zip(f, ranks.view(np.int64), strict=True)], "fp long, rank long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df).collect()]
    assert len(edges) < 3 * len(f)
    at, root = {x: i for i, x in enumerate(f)}, list(range(len(f)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(at[a])] = find(at[b])
    got, want = [find(i) for i in range(len(f))], brute_components(f)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def near_rows(seed=3):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE\ttwo"), (5, "a b c d"), (None, "a b c d"), (7, "é " * 5)]
    for g in range(12):
        base = [f"w{r.randint(0, 300)}" for _ in range(r.choice([30, 400]))]
        for _ in range(r.randint(1, 15)):
            w = list(base)
            if r.random() < 0.7:
                w[r.randrange(len(w))] = "changed"
            rows.append((100 + len(rows), " ".join(w)))
    return rows + [(900, "long " * 300_000 + "end"), (901, "long\n" * 300_000 + "END"), (5, "a b c d")]


def test_near_equals_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, _fp int, simhash string, low int").repartition(4)
    x = simhash.near(df)
    assert x.columns == ["doc_id", "text", "_fp", "low", "simhash"]
    prints = [brute_print(t) for _, t in rows]
    root = brute_components(prints)
    low = {c: min((d for (d, _), k in zip(rows, root, strict=True) if k == c and d is not None), default=None) for c in set(root)}
    want = sorted(((d, f"{p:016x}", low[c]) for (d, _), p, c in zip(rows, prints, root, strict=True)), key=repr)
    got = sorted(((r["doc_id"], r["simhash"]["fingerprint"], r["simhash"]["component_id"]) for r in x.collect()), key=repr)
    assert got == want
    assert simhash.near(df.limit(0)).count() == 0


def test_the_queries_equal_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(d, "s", "en" if k % 3 else None, k, t) for k, (d, t) in enumerate(near_rows(8)) if len(t or "") < 10_000], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    got = Q.op11_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_manifest(rows)
    assert sorted(tuple(r) for r in Q.op12_collocations(spark, str(tmp_path)).collect()) == brute_collocations([(r[4], r[2]) for r in rows])
    got = Q.op13_simhash_near(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    assert sorted(r["fingerprint"] for r in got.collect()) == sorted(f"{brute_print(r[4]):016x}" for r in rows)
