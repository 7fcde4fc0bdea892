"""Row-wise operators: brute force, edge cases (null, empty, very long, repeated, clashing columns, empty table)."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelake.llm import bpe, decontaminate, html_text, language, licenses, quality, token_counts, token_records
from tidelake.llm import _chunks as chunks
from tidelake.llm import _common as common

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "'s", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "é", "é", "İ", "ß", "Σ", "中", "😀", "<|endoftext|>", "<|startoftext|>", "1", "#", "_", "\r\n", "ǅ", "'ll", "the", "of", "‍"]


def odd_texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) for _ in range(n)]


def docs(spark, texts):
    """With columns whose names clash with those of operators."""
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _words int").repartition(3)


EDGE = [None, "", "   \n", "one", "word " * 30_000, "same text here", "same text here", "ÄÖ ß mit"]


def test_word_hashes_do_not_depend_on_pieces():
    text = ("abc é " * 5 + "x" * 50 + " ").encode() * 40_000
    h, s, e = common.hash_words(text, common.SPACE_SEPARATORS)
    words = re.findall(rb"[^\x20\x09-\x0d]+", text)
    assert len(h) == len(words) and all(text[a:b] == w for a, b, w in zip(s[:100], e[:100], words[:100], strict=True))
    by_word = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)


def count_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {x for x in win if win.count(x) > 1} if len(win) < 500 else {win[0]}
    hit = {i + k for i, x in enumerate(win) if x in seen for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    texts = [*EDGE, "a b c d e f g h i\na b c d e f g h i", "x\nx\ny\n\n", "# * ## |", *odd_texts(60)]
    rows = {r["doc_id"]: r["quality"] for r in quality.score(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        q = rows[i]
        n = count_quality(t)
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == n, (i, t and t[:50])
        assert q["base_failed"] == (n[0] < 20 or 100 * n[4] > 30 * n[0]) and not (q["base_failed"] and q["kept"])
    good = " ".join(f"the w{i} of" for i in range(40))
    kept = quality.keep(docs(spark, [good, None, good]))
    assert kept.columns == ["doc_id", "text", "lang", "_words"] and kept.count() == 2
    assert quality.keep(docs(spark, [good]).limit(0)).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licenses(spark):
    texts = [*EDGE, "Under the MIT License. under the mit license", "KIT under the İMIT License", "CC BY-NC", "gnu general public license version 3", "license " * 2000, "Apache License, Version 2.0"]
    rows = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = lambda p: [k for k in range(len(w)) if w[k : k + len(p)] == p]  # noqa: B023, E731
        base = {x.label: at(x.key) for x in licenses.TEMPLATES if x.base}
        places = sorted(k for v in base.values() for k in v)
        x = rows[i]
        assert x["n_words"] == len(w) and x["n_base"] == len(places), t
        assert (x["first_word"], x["last_word"]) == ((places[0], places[-1]) if places else (None, None))
        assert x["base_labels"] == sorted(k for k, v in base.items() if v)
        assert x["labels"] == sorted({t.label for t in licenses.TEMPLATES if at(t.key)})
        assert 0 <= x["score"] <= 1


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_runs_give_the_ids_of_whole_texts(path):
    tok, how = chunks.load(path), chunks.mode(path)
    ids = chunks.Runs(tok, how, path)
    memo = chunks.Memo({}, lambda runs: [tuple(x) for x in ids(runs)], limit=300)
    r = random.Random(9)
    letters = "abcXYZéÉßſǅİŉĳÿ×÷ñ,.!|'#1"
    texts = odd_texts(800) + ["qwertyuiop asdfghjkl zxcvbnm " * 50] + [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(40)) for _ in range(200)]
    for i in range(0, len(texts), 50):
        for t, v in zip(texts[i : i + 50], memo.by_text(texts[i : i + 50], how), strict=True):
            assert [x for r in v for x in r] == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_counts(spark):
    tok = chunks.load(WORD)
    assert len(token_counts.whole_tokens(WORD)) > 30_000
    texts = EDGE + odd_texts(50)
    rows = {r["doc_id"]: r for r in token_counts.count_tokens(docs(spark, texts), WORD).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"], rows[i]["lang"]) == (len((t or "").encode()), n, n > 2048, "x")
    sp = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.count_tokens(docs(spark, ["hello world"]), sp).first()["n_tokens"] > 0
    assert token_counts.count_tokens(docs(spark, ["a"]).limit(0), WORD).count() == 0


def test_tree_concatenation_is_exact():
    r = random.Random(3)
    tok = chunks.load(WORD)
    for leaf in (5, 16, 64):
        tree = bpe.TreeEncoder(WORD, leaf)
        for _ in range(120):
            x = "".join(r.choice(["th", "e", "ing", "a", "tion", "é", "中", "on", "xx", "un"]) for _ in range(r.randint(1, 300)))
            assert tree.encode(x) == tok.encode(x, add_special_tokens=False).ids
    x = "ab" * 40_000 + "<|endoftext|>" + "é" * 3000
    assert bpe.TreeEncoder(WORD).encode(x) == tok.encode(x, add_special_tokens=False).ids


def test_bpe(spark):
    tok = chunks.load(WORD)
    texts = [*EDGE, "x" * 5000, *odd_texts(50)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {r["doc_id"]: r for r in bpe.encode(docs(spark, texts), WORD, digest=True).collect()}
    full = {r["doc_id"]: r for r in bpe.encode(docs(spark, texts), WORD).collect()}
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        assert (rows[i]["n_tokens"], rows[i]["ids"], rows[i]["decoded"]) == (len(ids), sha(" ".join(map(str, ids))), sha(text))
        assert full[i]["ids"] == ids and full[i]["decoded"] == text


def test_bpe_joins_on_ordinary_documents():
    """Ids and decoded text of every document are the library's, and come through joins of halves."""
    tok, codec = chunks.load(WORD), bpe.Codec(WORD)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    got = codec.digests(texts)
    assert codec.joins > len(texts) / 2
    for t, (n, ids, decoded) in zip(texts, got, strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert n == len(want) and ids == " ".join(map(str, want)) and decoded == tok.decode(want, skip_special_tokens=False)


def test_bpe_joins_anywhere():
    """Small leaves cut words, blanks in a row, unsplit runs, contractions and combining marks; odd texts by hypothesis' rules."""
    tok, codec = chunks.load(WORD), bpe.Codec(WORD, leaf=8)
    codec.tree.leaf = 4
    r = random.Random(11)
    parts = ["don't", "it''s", " ", "  ", "\n", "\t", "e\u0301", "\u0301", "x" * 30, "9" * 20, "<|endoftext|>", "\u00a0", "hello", "WORLD", "!?", "'ll", "\u4f60\u597d", "\U0001f600"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(400)] + ["a" * 200 + " b", "b " + "a" * 200, " " * 50, "ab " * 100]
    for t, (n, ids, decoded) in zip(texts, codec.digests(texts), strict=True):
        want = tok.encode(t, add_special_tokens=False).ids
        assert n == len(want) and ids == " ".join(map(str, want)) and decoded == tok.decode(want, skip_special_tokens=False), t
    assert codec.joins > 400 and codec.tree.joins > 0


def test_token_records(spark, tmp_path):
    tok = chunks.load(BYTE)
    texts = EDGE + odd_texts(60)
    df = docs(spark, texts).selectExpr("case when doc_id = 5 then null else doc_id * 3 end as doc_id", "text", "lang").union(spark.createDataFrame([(3, "again", "x")], "doc_id long, text string, lang string"))
    manifest = token_records.write(df, BYTE, str(tmp_path / "records"))
    rows = token_records.read(spark, manifest).collect()
    want = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    start = 0
    for r, (d, t) in zip(sorted(rows, key=lambda r: r["start"]), want, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    file = sorted(manifest.collect())[0]["file"]
    data, offsets, code = token_records.load_shard(file)
    random.Random(1).shuffle(order := list(range(len(offsets) - 1)))
    assert all(token_records.record(data, int(offsets[i]), code)[1][-1] == 2 for i in order)
    assert [(d, x.tolist()) for d, x in token_records.stream_shard(file)] == [(d, x.tolist()) for d, x in (token_records.record(data, int(o), code) for o in offsets[:-1])]
    broken = bytearray(data)
    broken[int(offsets[0]) + 15] ^= 1
    with pytest.raises(ValueError):
        token_records.record(memoryview(bytes(broken)), int(offsets[0]), code)
    assert token_records.read(spark, token_records.write(df.limit(0), BYTE, str(tmp_path / "none"))).count() == 0


def brute_hits(text, items):
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    w, hit, found = words(text), set(), set()
    for k, t in items:
        v = words(t)
        n = min(10, len(v))
        if k is None or not n:
            continue
        for i in range(len(v) - n + 1):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(str(k))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("bits", [decontaminate.FILTER_BITS, 8])  # eight bits: everything passes to the join
def test_decontamination(spark, bits):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(12)] + ["Üb", "É"]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(10, say(30)), (9, say(12)), (2, "w1 w2, W3"), (7, None), (8, ""), (None, say(15)), (10, say(11)), (4, "zz " * 14)]
    texts = [None, "", "w1 w2 w3", items[0][1], "x " + items[0][1][20:80] + " y", "w1-W2.w3 " + items[1][1], "zz " * 40, say(4000), *[say(60) for _ in range(20)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {x["doc_id"]: x["found"] for x in decontaminate.find(docs(spark, texts), bench, filter_bits=bits).collect()}
    for i, t in enumerate(texts):
        f = rows[i]
        assert (f["n_words"], f["n_hit"], f["items"]) == brute_hits(t, items), i
        assert sum(s["end"] - s["start"] for s in f["spans"]) == f["n_hit"]
    clean = decontaminate.clean(docs(spark, ["zz " * 20, "fine text", None]), bench)
    assert clean.columns == ["doc_id", "text", "lang", "_words"] and {x["doc_id"] for x in clean.collect()} == {1, 2}
    assert decontaminate.clean(docs(spark, ["a"]), bench.limit(0)).count() == 1
    assert decontaminate.find(docs(spark, texts).limit(0), bench).count() == 0
    assert decontaminate.find(docs(spark, texts).withColumn("_RID", F.lit(1)).withColumn("_met", F.lit(2)), bench).columns[-3:] == ["_RID", "_met", "found"]


def test_decontamination_of_hot_passages_and_huge_items(spark):
    """A passage in all documents and in many items, and an item of 70,000 words, of which a document holds a part."""
    r = random.Random(8)
    say = lambda n: " ".join(f"v{r.randint(0, 9999)}" for _ in range(n))
    hot, huge = say(14), say(70_000)
    items = [(i, f"{hot} {say(5)}") for i in range(60)] + [(100, huge)]
    part = " ".join(huge.split()[65_530:65_545])  # across the pieces in which an item is read
    texts = [f"{say(20)} x {hot} x {say(3)}" for _ in range(200)] + [f"{say(4)} {part} {say(4)}", say(50)]
    got = {x["doc_id"]: x["found"] for x in decontaminate.find(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()}
    every = sorted(str(i) for i in range(60))
    assert all((got[i]["n_hit"], got[i]["items"]) == (14, every) for i in range(200))
    assert (got[200]["n_hit"], got[200]["items"], got[201]["n_hit"]) == (15, ["100"], 0)
    assert [(x["start"], x["end"]) for x in got[200]["spans"]] == [(4, 19)]


@pytest.mark.parametrize("bits", [1 << 20, 8])
def test_clean_searches_items_without_id(spark, bits):
    bench = spark.createDataFrame([(None, "a b c d e f g h i j k l"), (3, "p q r s t u v w x y z")], "item_id long, text string")
    texts = ["so A b c d e f g h i j it goes", "a b c d", "p q r s t u v w x y", None]
    assert {x["doc_id"] for x in decontaminate.clean(docs(spark, texts), bench, filter_bits=bits).collect()} == {1, 3}


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now, it is very cheap.</div><article><h1>Caf&eacute; &amp; more</h1><p><b>First   paragraph
of the text.<br><p>Short.<p>Last one, it ends here.</article><div id=cookie-notice>We use cookies on this page and ask you to agree.</div>
<section class="comments"><p>I think this is a very good article and want to say so at length.</p></section><form><label>Mail</label></form><footer>&copy; x</footer>"""
    want = "Café & more\nFirst paragraph of the text.\nShort.\nLast one, it ends here."
    assert html_text.extract_text(page) == want
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>" + "word " * 50_000), (5, "u", "plain text only, without any markup at all.")], "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.extract(rows).collect()}
    assert out == {1: want, 2: "", 3: "", 4: ("word " * 50_000).strip(), 5: "plain text only, without any markup at all."}
    assert html_text.content([3.0, -1.0, 2.0], [(0, 1, 0.8), (1, 2, 0.8)]) == [True, True, True]
    assert html_text.content([3.0, -2.0, -2.0], [(0, 1, 0.8), (1, 2, 0.8)]) == [True, False, False]


def test_html_names_of_the_whole_page_and_fallbacks():
    said = "A short paragraph of some thirty words stands here, so that its own log-odds are middling and what the elements around it add decides whether it is kept."
    for tags in ('<html class="no-cookies"><body><article>{}</article>', '<html><body class="has-sidebar"><article>{}</article>', '<body><main class="with-sidebar">{}</main>'):
        assert html_text.extract_text(tags.format(f"<p>{said}</p>")) == said
    assert html_text.extract_text(f'<body><div class="sidebar"><p>{said}</p></div>') == ""
    math = "<math><mi>x</mi><mo>+</mo><mn>1</mn><annotation encoding=tex>x+1</annotation></math>"
    page = f"<body><noscript>Turn scripts on, please, to read this page.</noscript><article><p>{said} So {math} holds.</p><noscript><p>{said}</p></noscript><object data=x><p>{said}</p></object></article>"
    assert html_text.extract_text(page) == f"{said} So x+1 holds.\n{said}\n{said}"


def test_minimum_cut_is_minimal():
    r = random.Random(2)
    for _ in range(40):
        n = r.randint(1, 7)
        odds = [r.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 1)) for i in range(n) for j in range(i + 1, n) if r.random() < 0.5]
        cost = lambda side: sum(max(s, 0) if not k else max(-s, 0) for s, k in zip(odds, side, strict=True)) + sum(w for i, j, w in edges if side[i] != side[j])  # noqa: B023, E731
        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.content(odds, edges)) == pytest.approx(best, abs=1e-6)


def test_language(spark):
    r = random.Random(4)
    make = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(60))
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ein", "ö"], "cc": ["qu", "que", "ñ", "ia"]}
    labelled = spark.createDataFrame([(make(p), k) for k, p in sounds.items() for _ in range(60)] + [("x", None), (None, "aa")], "text string, lang string")
    model = language.fit(labelled)
    assert model.languages == ["aa", "bb", "cc"]
    for n in range(language.ORDER):
        assert (np.diff(model.keys[n].astype(object)) > 0).all()
    texts = [make(sounds[k]) for k in sounds for _ in range(20)] + [None, "", "123 !?", "中文" * 50]
    rows = {x["doc_id"]: x["language"] for x in language.identify(docs(spark, texts), model).collect()}
    assert [rows[i]["lang"] for i in range(60)] == [k for k in sounds for _ in range(20)]
    assert all(rows[i]["lang"] == "und" and rows[i]["rejected"] and rows[i]["score"] == 0 for i in (60, 61, 62))
    assert rows[63]["lang"] in model.languages and rows[63]["rejected"]
    assert all(0 <= x["score"] <= 1 for x in rows.values())
    kept = language.keep_identified(docs(spark, texts), model)
    assert kept.columns == ["doc_id", "text", "lang", "_words"] and kept.count() == 60
    empty = language.fit(labelled.limit(0))
    assert language.identify(docs(spark, ["abc"]), empty).first()["language"]["lang"] == "und"


def test_kneser_ney_sums_to_one():
    counts = {}
    s = "   " + "abracadabra abba "
    for i in range(len(s) - 3):
        counts[s[i : i + 4]] = counts.get(s[i : i + 4], 0) + 1
    m = language.estimate({"x": counts})
    letters = sorted(set(s))
    for context in ("abr", "ra ", "bba"):
        p = 0.0
        for c in letters:
            a = np.array([ord(x) for x in context + c], np.uint32)
            logp, inv = m.char_logp(a)
            p += 2.0 ** float(logp[inv[0], 0])
        assert 0.85 < p <= 1.0 + 1e-6  # the rest is kept for unseen characters


def test_no_language_is_lost(spark):
    """Neither beside copies that make up nearly all rows of a language, nor with a single text."""
    r = random.Random(1)
    say = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(30))
    rows = [(say("abcde"), "aa") for _ in range(300)] + [(say("fghij"), "bb") for _ in range(300)] + [("kkl mmn ook lmn", "cc"), ("123 !!", "dd"), (None, "ee"), ("no label", None)]
    df = spark.createDataFrame(rows, "text string, lang string")
    hot = spark.range(20_000).selectExpr("'abc cde eab' as text", "'aa' as lang")
    model = language.fit(df.unionByName(hot).repartition(4))
    assert model.languages == ["aa", "bb", "cc"]
    got = {x["text"]: x["language"]["lang"] for x in language.identify(spark.createDataFrame([(say("abcde"),), (say("fghij"),), ("kkl mmn",), ("9",)], "text string"), model).collect()}
    assert sorted(got.values()) == ["aa", "bb", "cc", "und"] and got["kkl mmn"] == "cc" and got["9"] == "und"
    clash = language.identify(df.withColumn("Language", F.lit(1)).limit(0), model)
    assert clash.columns == ["text", "lang", "language"] and clash.count() == 0


def test_kneser_ney_by_recursion():
    r = random.Random(4)
    grams = lambda t: [(" " * 3 + t)[i : i + 4] for i in range(len(t))]
    counts = {}
    for lang, letters in (("x", "abca"), ("y", "abddc")):
        c = {}
        for _ in range(60):
            for g in grams(" " + "".join(r.choice(letters + " ") for _ in range(20)) + " "):
                c[g] = c.get(g, 0) + 1
        counts[lang] = c
    model = language.estimate(counts)

    def p(levels, h, c):
        n = len(h) + 1
        level = levels[n]
        ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = {g: v for g, v in level.items() if g[:-1] == h}
        lower = (lambda: p(levels, h[1:], c)) if n > 1 else (lambda: 1 / (len(level) + 200))
        if not after:
            return lower()
        total = sum(after.values())
        return max(after.get(h + c, 0) - d, 0) / total + d * len(after) / total * lower()

    texts = [" abcab ab ", " aab caa ", " a "]
    h = model.cross_entropy([np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts])
    for k, lang in enumerate(model.languages):
        levels = {4: counts[lang]}
        for n in (3, 2, 1):
            levels[n] = {}
            for g in levels[n + 1]:
                levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
        for t, row in zip(texts, h, strict=True):
            want = -sum(math.log2(p(levels, g[:-1], g[-1])) for g in grams(t)) / len(t)
            assert row[k] == pytest.approx(want, rel=1e-4)


def test_html_keeps_headers_of_articles_and_survives_broken_tags():
    said = "A paragraph of the article that is long enough to be taken for text by any reader of it, with a full stop."
    for head in ('<div class="article-header"><h1>The title stands here</h1></div>', '<header class="entry-header"><h1>The title stands here</h1></header>', '<div class="header"><h1>The title stands here</h1></div>'):
        assert html_text.extract_text(f"<body><div class=header>Shop of all things</div><article>{head}<p>{said}</p></article>") == f"The title stands here\n{said}"
    for tag in ("<button>", "<select>", "<canvas>", "<object>", "<svg>", "<button><button>", "<video>"):
        got = html_text.extract_text(f"<article><p>{said}</p>{tag}<p>Second: {said}</p></article>")
        assert got.startswith(said) and got.endswith(f"Second: {said}"), tag
    assert html_text.extract_text(f"<article><p>{said}</p><svg><svg><text>no</text></svg></svg><button>Press</button><select><option>One</select><p>{said}</p></article>") == f"{said}\n{said}"
    assert html_text.extract_text(f"<article><p>{said}</p><script>var x = '<p>no</p>'") == said
    assert html_text.extract_text(f"<article><p title='a > b' class=\"x\">{said}</p><p>1 < 2 and 3 > 2, as everybody knows who reads this sentence.</p>") == f"{said}\n1 < 2 and 3 > 2, as everybody knows who reads this sentence."


@pytest.mark.parametrize("piece", ["<a ", "<a \"", "<a '", "<div ", "<button>", "<svg>", "<!--", "<![CDATA[", "</p", "<p \"'"])
def test_html_takes_linear_time(piece):
    start = time.process_time()
    html_text.blocks(piece * (1_000_000 // len(piece)))
    assert time.process_time() - start < 30


def test_html_rows(spark):
    page = "<article><p>A paragraph of the article that is long enough to be taken for text.</p></article>"
    rows = spark.createDataFrame([(1, "u", page, 5, 6)] * 3, "page_id long, url string, html string, _page int, _PAGE_ int")
    out = html_text.extract(rows)
    assert out.columns == ["page_id", "url", "_page", "_PAGE_", "text"] and [x["text"] for x in out.collect()] == ["A paragraph of the article that is long enough to be taken for text."] * 3
    assert html_text.extract(rows.limit(0)).count() == 0
    assert html_text.extract(rows.withColumn("TEXT", F.lit(1))).columns == ["page_id", "url", "_page", "_PAGE_", "text"]


_SAID = "This is one rather long sentence of an ordinary article about harbours, ships and weather, which goes on for about forty words so that anybody can see that it is prose and not a menu or a label of some kind."


@pytest.mark.parametrize("around", [
    '<article class="post comment-open">{}</article>', '<article class="post hentry sharing-enabled">{}</article>', '<article class="story related-content">{}</article>', '<article class="article has-banner">{}</article>',
    '<article class="ad-free-article">{}</article>', '<article class="post login-required">{}</article>', '<div id="content" class="subscriber-menu-open">{}</div>', '<form id="aspnetForm"><div class="content">{}</div></form>',
    '<div class="content-sidebar-wrap"><div class="entry-content">{}</div></div>', '<div class="layout-sidebar-right"><div>{}</div></div>', '<main role="main"><div class="page-header-wrapper"><section>{}</section></div></main>',
    '<article id="post-7" class="post-7 type-post status-publish category-advertising tag-comments">{}</article>', '<div itemprop="articleBody">{}</div>', '<table id="main"><tr><td class="text">{}</td></tr></table>',
])
def test_html_names_of_what_else_a_page_has_lose_no_article(around):
    page = f'<body><nav><a href="/">Home</a> <a href="/a">All about it</a></nav>{around.format(f"<p>{_SAID}</p><p>{_SAID}</p>")}<div class="sidebar-widget"><p>Subscribe to our letter today.</p></div><footer>Imprint</footer></body>'
    assert html_text.extract_text(page) == f"{_SAID}\n{_SAID}"


@pytest.mark.parametrize("inner", [
    '<div class="comment">{}</div>', '<div class="advertisement">{}</div>', '<div class="content"><div class="newsletter">{}</div></div>', '<aside>{}{}</aside>', '<form>{}{}</form>', '<div class="ad-slot">{}</div>',
    '<ol class="comment-list"><li><article class="comment-body"><div class="comment-content">{}{}</div></article></li></ol>', '<section class="related-posts"><article class="post">{}</article></section>', '<div id="disqus_thread">{}</div>',
    '<div role="complementary">{}</div>', '<div class="commentText" itemprop="comment">{}</div>', '<div style="display: none">{}</div>', '<div class="share-buttons">{}</div>', '<div class="cookieNotice">{}</div>',
])
def test_html_what_stands_in_an_article_but_is_none_goes(inner):
    other = "<p>X" + _SAID + "</p>"
    page = f"<body><main><article class=post><h1>A title of the article</h1><p>{_SAID}</p>{inner.replace('{}', other)}<p>{_SAID}</p></article></main></body>"
    assert html_text.extract_text(page) == f"A title of the article\n{_SAID}\n{_SAID}"
