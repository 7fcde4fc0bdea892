"""Operators that gather from the corpus, and the pipeline, against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.llm import components, lm, ngram_join
from tidelake.llm import queries as Q

SCHEMA = "doc_id long, text string, lang string, _rid int"


def shingle_set(t):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """doc_id -> (class id, links), every pair compared."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 10 * inter >= 8 * (len(sets[i]) + len(sets[j]) - inter):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return {d: (low[find(i)], links[i]) for i, (d, _) in enumerate(rows)}


def near_rows(seed=0):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randint(0, 400)}" for _ in range(n)]
    rows, k = [(0, None), (1, ""), (2, "one two"), (3, "ONE, two!"), (4, "five words are in here"), (5, "!!!")], 6
    for size, copies in ((60, 70), (40, 5), (200, 9), (30, 3)):  # more than one block of near copies
        base = say(size)
        for c in range(copies):
            w = list(base)
            for _ in range(c % 4):
                w[r.randrange(len(w))] = f"x{r.randint(0, 9999)}"
            rows.append((k, " ".join(w)))
            k += 1
    for _ in range(60):
        rows.append((k, " ".join(say(r.randint(1, 80)))))
        k += 1
    rows.append((k, " ".join(say(20_000))))
    rows.append((k + 1, rows[-1][1] + " tail"))
    r.shuffle(rows)
    return rows


def test_ngram_join_equals_brute_force(spark):
    rows = near_rows()
    want = brute_classes(rows)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(4)
    out = ngram_join.join(df)
    assert out.columns == ["doc_id", "text", "lang", "_rid", "near"]
    got = {r["doc_id"]: (r["near"]["class_id"], r["near"]["n_links"]) for r in out.collect()}
    assert got == want
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len({c for c, _ in want.values()})
    assert ngram_join.one_of_each(df.limit(0)).count() == 0


def test_prefixes_reach_the_recall():
    d = ngram_join.floor_depth()
    assert 1 - (1 - 0.8**d) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** ngram_join.TREES


def test_thresholds_too_low_for_the_recall_are_refused():
    assert ngram_join.floor_depth(0.4) == 1
    with pytest.raises(ValueError, match="recall"):
        ngram_join.floor_depth(0.3)


def test_survivors_do_not_depend_on_files(spark):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in near_rows(3)], SCHEMA)
    kept = [sorted((r["doc_id"], r["text"] or "") for r in ngram_join.one_of_each(x).collect()) for x in (df.repartition(1), df.orderBy(F.rand(2)).repartition(5))]
    assert kept[0] == kept[1]


def test_forest_shortens_until_the_recall(spark, monkeypatch):
    """Links near the threshold need shorter prefixes than links of near copies; what is measured is close to what is missed."""
    floors, real = [], ngram_join.with_roots
    monkeypatch.setattr(ngram_join, "with_roots", lambda c: floors.append(1) or real(c))
    r = random.Random(9)
    near, far = [], []
    for g in range(150):
        w = [f"g{g}w{i}" for i in range(100)]
        near += [" ".join(w), " ".join([*w, "end"])]
        v = list(w)
        v[50:56] = [f"x{g}y{i}" for i in range(6)]  # ten of 96 shingles differ on each side
        far += [" ".join(f"f{x}" for x in w), " ".join(f"f{x}" for x in v)]
    r.shuffle(near), r.shuffle(far)
    for texts, levels in ((near, 1), (far, 2)):
        floors.clear()
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], SCHEMA)
        linked = ngram_join.join(df).where("near.n_links = 1").count()
        assert len(floors) == levels and linked == len(texts)  # recall 1, measured; at least 0.9999 by the model


def test_chance_meetings_are_not_shipped_in_squares(spark, monkeypatch):
    """Texts that share half their words (no link): candidates that met by chance are parted before pairs of blocks are built."""
    shipped, real = [], ngram_join.written
    def spy(df, name, by=None):  # noqa: E306
        t = real(df, name, by)
        if name == "ngram-links":
            shipped.append(t.count())
        return t
    monkeypatch.setattr(ngram_join, "written", spy)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    half = " ".join(f"s{i}" for i in range(60))
    rows = [(i, half + " " + " ".join(f"u{i}x{j}" for j in range(60)), "x", 1) for i in range(600)]
    out = ngram_join.join(spark.createDataFrame(rows, SCHEMA))
    assert out.where("near.n_links > 0").count() == 0 and sum(shipped) < 600


@pytest.mark.parametrize("local", [500_000, 30])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, x) for x in range(101, 160)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(50)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {i: find(i) for i in root if find(i) != i}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    p = lm.Weights.drawn(1, hidden=3, classes=2, per=3)
    for name in ("e", "x", "u", "wc", "bc", "w", "b"):
        setattr(p, name, getattr(p, name).astype(np.float64) * 5)
    inputs, targets = rng.integers(0, 6, (4, 2)), rng.integers(0, 6, (4, 2))
    clear = np.array([[True, False], [False, False], [False, True], [False, False]])
    h = rng.normal(size=(2, 3))
    _, _, grads = lm.window_gradients(p, h, inputs, targets, clear)
    for a, g in zip(p.arrays(), grads, strict=True):
        for i in range(0, a.size, max(1, a.size // 7)):
            old = a.flat[i]
            a.flat[i] = old + 1e-5
            up = lm.window_gradients(p, h, inputs, targets, clear)[0]
            a.flat[i] = old - 1e-5
            down = lm.window_gradients(p, h, inputs, targets, clear)[0]
            a.flat[i] = old
            assert g.flat[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def plain_log10(p, ids, end):
    """log10 probability of one text by the model's equations, token by token."""
    k, per = p.u.shape[0], p.b.shape[1]
    f = {n: getattr(p, n).astype(np.float64) for n in ("e", "x", "u", "wc", "bc", "w", "b")}
    sig = lambda a: 1 / (1 + np.exp(-a))
    lse = lambda a: a - a.max() - np.log(np.exp(a - a.max()).sum())
    h, before, s = np.zeros(k), end, 0.0
    for i in ids:
        x, g = f["e"][before] @ f["x"], h @ f["u"]
        z, r = sig(x[:k] + g[:k]), sig(x[k : 2 * k] + g[k : 2 * k])
        n = np.tanh(x[2 * k :] + r * g[2 * k :])
        h = (1 - z) * n + z * h
        c = i // per
        s += lse(h @ f["wc"] + f["bc"])[c] + lse(h @ f["w"][c] + f["b"][c])[i % per]
        before = i
    return s / math.log(10)


def test_texts_abreast_score_as_alone(monkeypatch):
    monkeypatch.setattr(lm, "WIDTH", 3)
    rng = np.random.default_rng(2)
    p = lm.Weights.drawn(3)
    m = lm.Model(p, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), 1, 0, 0, 0, 0)
    texts = [rng.integers(0, 2048, n).astype(np.int32) for n in (1, 50, 7, 7, 300)]
    bounds = np.append(0, np.cumsum([len(t) for t in texts]))
    got = m.log10_texts(np.concatenate(texts), bounds)
    for t, x in zip(texts, got, strict=True):
        assert x == pytest.approx(plain_log10(p, t.tolist(), 1), rel=1e-4)


def test_lm_score_by_its_equations(spark, monkeypatch):
    """score: known tokens, the shares of other tokens, and those whose counts come in by the join."""
    monkeypatch.setattr(lm, "HEAD", 3000)
    monkeypatch.setattr(lm, "VISITS", 1)
    r = random.Random(5)
    say = lambda: " ".join(f"w{r.randint(0, 8000)}" for _ in range(r.randint(0, 90)))
    rows = [(i, say()) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    counts = lm.count(df.where("doc_id % 4 <> 1"))
    model = lm.fit(df.where("doc_id % 4 <> 1"), counts)
    c = {}
    for d, t in rows:
        if d % 4 != 1:
            for w in [*t.split(), None]:
                c[w] = c.get(w, 0) + 1
    hashes = {w: int(lm.token_hashes([w.encode()])[0][0]) for w in {w for _, t in rows for w in t.split()}}
    known = [None, *sorted((w for w in c if w is not None), key=lambda w: (-c[w], hashes[w]))][: 2048 - 1]
    ids = {w: k + 1 for k, w in enumerate(known)}
    assert len(c) > lm.HEAD > len(known) - 100 and model.end == 1
    other = sum(n for w, n in c.items() if w not in ids), sum(w not in ids for w in c)
    assert (model.other_tokens, model.other_distinct) == other
    for x in lm.score(df, model, counts).collect():
        w = [*x["text"].split(), None]
        want = plain_log10(model.weights, [ids.get(t, 0) for t in w], 1) + sum(math.log10((c.get(t, 0) + 1) / (sum(other) + 1)) for t in w if t not in ids)
        assert x["lm"]["score"] == pytest.approx(want, rel=1e-4)


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_TOKENS", 4_000)
    monkeypatch.setattr(lm, "FAN", 2)  # a tree of several levels
    monkeypatch.setattr(lm, "VISITS", 1)
    r = random.Random(3)
    rows = [(i, " ".join(f"w{r.randint(0, 60)}" for _ in range(r.randint(1, 80)))) for i in range(500)] + [(1000 + i, "one text many times") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for x in (df.repartition(1), df.repartition(7), df.orderBy(F.rand(1)), df.repartition(3, "text")):
        counts = lm.count(x)
        model = lm.fit(x, counts)
        assert model.trained == model.tokens
        found.append({y["doc_id"]: y["lm"]["score"] for y in lm.score(x, model, counts).collect()})
    for other in found[1:]:
        assert all(found[0][d] == pytest.approx(other[d], rel=1e-9) for d in found[0])


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 40)  # most tokens come in by the join
    r = random.Random(0)
    nxt = {f"w{i}": [f"w{(i * 7 + k) % 90}" for k in range(2)] for i in range(90)}

    def say():
        w = [f"w{r.randint(0, 89)}"]
        while len(w) < 60:
            w.append(r.choice(nxt[w[-1]]))
        return " ".join(w)

    rows = [(i, say(), "x", 1) for i in range(300)] + [(900, None, "x", 1), (901, "", "x", 1), (902, "Unknown\tWORD w1", "x", 1), (0, rows0 := "w1 w2", "x", 1), (903, "w3 " * 20_000, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    train = df.where(~Q.held_out(7, 2))
    counts = lm.count(train)
    model = lm.fit(train, counts)
    out = lm.score(df.withColumn("held", Q.held_out(7, 2)), model, counts).collect()
    c, tokens = {}, lambda t: [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            for w in tokens(t):
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.distinct) == (n, v)
    by = {}
    for d, t, *_ in rows:
        w = tokens(t)
        by.setdefault(d, []).append((len(w), sum(x in c for x in w), sum(math.log10((c.get(x, 0) + 1) / (n + v + 1)) for x in w)))
    got = {}
    for x in out:
        got.setdefault(x["doc_id"], []).append((x["lm"]["n_tokens"], x["lm"]["n_known"], x["lm"]["base_score"]))
    for d in by:
        for a, b in zip(sorted(by[d]), sorted(got[d]), strict=True):
            assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-9)
    held = [x["lm"] for x in out if x["held"] and x["lm"]["n_tokens"] == 61]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)
    assert set(out[0].asDict()) == {"doc_id", "text", "lang", "_rid", "held", "lm"}
    assert rows0 == "w1 w2" and all(math.isfinite(x["lm"]["score"]) for x in out)
    nothing = lm.count(train.limit(0))
    assert lm.score(df.limit(3), lm.fit(train.limit(0), nothing), nothing).count() == 3


def test_lm_trains_on_every_shard(spark, monkeypatch):
    """More tokens than a bounded sample would hold, none of them in texts that such a sample drew by their hash."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 60_000)  # several shards
    n, size = 21000, 70
    at = F.col("id") * 7
    word = F.transform(F.sequence(F.lit(0), F.lit(size - 2)), lambda i: F.concat(F.lit("c"), ((i + at) % 24).cast("int").cast("string")))
    rows = spark.range(n, numPartitions=8).select(F.concat_ws(" ", word, F.concat(F.lit("u"), "id")).alias("text"))
    rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) >= 0.7 * 1_000_003).persist()
    counts = lm.count(rows)
    model = lm.fit(rows, counts)
    assert model.tokens == rows.count() * (size + 1) > 300_000 and model.trained == model.tokens
    out = lm.score(rows.limit(50), model, counts).collect()
    gain = np.mean([x["lm"]["score"] - x["lm"]["base_score"] for x in out])
    assert gain > 0.5 * 69 * math.log10(24)  # much of the cycle of 24 words is learnt


def test_lm_trains_on_copies_and_nulls(spark, monkeypatch):
    """A third of the rows are copies of one text whose hash a draw by text would miss; null texts are one end each."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 60_000)
    copies = [t for k in range(40) if (t := f"k{k} " + " ".join(f"m{(i * 7 + k) % 30}" for i in range(90)))]
    missed = spark.createDataFrame([(t,) for t in copies], "text string").where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) >= 0.8 * 1_000_003).first()["text"]
    other = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit("v"), F.pmod(F.xxhash64(F.col("id"), i), F.lit(300)).cast("string"))))
    rows = spark.range(4500, numPartitions=8).select(F.when(F.col("id") % 3 == 0, F.lit(missed)).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(other).alias("text")).persist()
    counts = lm.count(rows)
    model = lm.fit(rows, counts)
    nulls = rows.where("text is null").count()
    assert nulls == 60 and model.tokens == 1500 * 92 + nulls + (3000 - nulls) * 91 > 300_000 / 0.8 and model.trained == model.tokens
    x = lm.score(rows.where(F.col("text") == missed).limit(1), model, counts).first()["lm"]
    assert x["score"] > 0.5 * x["base_score"]  # the copies were learnt


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from tidelake.llm import quality

    r = random.Random(7)
    words = {"aa": ["the", "of", "and", *(f"ka{x}" for x in "abcdefghijklmn")], "bb": ["der", "und", "die", *(f"sch{x}" for x in "öüaeioprst")]}
    say = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n))
    leak = say("aa", 40)
    rows = [(i, say("aa" if i % 2 else "bb", r.randint(40, 90)), "aa" if i % 2 else "bb", "s", 0) for i in range(120)]
    rows += [(200 + i, rows[i][1] + (" the" if i % 2 else ""), rows[i][2], "s", 0) for i in range(30)]
    rows += [(300, "123 456 789", "aa", "s", 0), (301, None, None, None, None), (302, "the of and", "aa", "s", 0), (303, "### *** " * 30, "aa", "s", 0), (304, say("aa", 30) + " " + leak[5:150] + " " + say("aa", 30), "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {x["doc_id"]: x["ids"] for x in out.collect()}
    left = [x for x in rows if x[0] not in (300, 301)]
    q = {x["doc_id"] for x in quality.keep(spark.createDataFrame([x[:2] for x in left], "doc_id long, text string")).collect()}
    assert q == {x[0] for x in left} - {302, 303}
    left = [(d, t) for d, t, *_ in left if d in q]
    classes = brute_classes(left)
    near = {d for d, (c, _) in classes.items()}
    firsts = {c for c, _ in classes.values()}
    assert len(got) == len(firsts) - 1 and 304 not in got and set(got) <= near
    assert {classes[d][0] for d in got} == firsts - {304}
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = dict(left)
    assert all(tok.encode(text[d], add_special_tokens=False).ids == ids for d, ids in got.items())
    kept = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string").where(F.col("doc_id") == 0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        if name not in ("language_id",):
            assert stage(spark, kept, str(tmp_path)).columns == ["doc_id", "text"]
