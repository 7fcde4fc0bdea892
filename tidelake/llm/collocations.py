"""Phrase collocations per language: count-min sketches, exact counts of what may be frequent, scores, and phrases that longer ones subsume.

A-Z are lowered, texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words `[^\\x20\\x09]+`; phrases are runs of words within a piece. A candidate is a phrase of 2 to
MOST words that occurs LEAST times or more in its language. Cut after its first k words into parts that occur l and r times, it scores
floor(SCALE * a * a / (l * r)); the cut with the lowest score counts (ties: the smallest k). A candidate that lies inside a longer
one which occurs SUBSUMED percent as often or more is dropped, and the TOP best of each language are returned: the best of PARTS parts, then the best of these.

First pass: each task counts its phrases of 1 to MOST words in a count-min sketch of ROWS rows of cells, saturating at LEAST, and adds its sketch to
others by a shuffle of blocks. A sketch overestimates, so a phrase with a cell below LEAST in any row is not frequent; the merged sketch
shrinks to a bit a cell, which all tasks get (at most ROWS * 2^CELLS bits: 16 MB). Second pass: only phrases with all bits set are counted exactly. Parts of
a frequent phrase are frequent as well, so every count that a score needs is among them. The number of cells follows the size of the texts up to 2^CELLS; beyond about half a
billion words chance fills most cells, and the second pass then counts nearly all phrases: more work, the same result. Tasks of the first pass take SHARE times as
many bytes of text as their sketch, so that sketches stay a small part of what is shuffled.

Within a piece of STEP bytes phrases are told apart by 64-bit hashes (of chance collisions 2e-6 are expected a piece); across pieces by their text.

Defined cases: null texts are empty; a null language is `und`; texts without phrases give no rows, an empty table gives an empty result; repeated rows count as often as they
occur; other columns are not read; ties of score and count are ordered by the phrase's UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import byte_texts, groups, hash_words, mix, small_batches, strings, written

MOST, LEAST, SUBSUMED, TOP, SCALE = 3, 10, 50, 2000, 1_000_000
ROWS, CELLS, FEWEST_CELLS = 2, 26, 16
#: Parts of a language that are ranked by themselves first.
PARTS = 64
#: Bytes of text a byte of sketch; cells of a block; bytes of text counted at once.
SHARE, CELL_BLOCK, STEP = 4, 1 << 16, 4 << 20
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[0x20, 0x09]] = True
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def phrases(texts: list[bytes], langs: list[str], most: int) -> Iterator[tuple[list[str], bytes, np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of rows: languages, joined text, words' first bytes and ends, words' languages; and for 1, 2, ... words: the first word of each phrase and its hash."""
    for i, j in groups([len(t) + 1 for t in texts], STEP):
        joined = b"\n".join(texts[i:j]).lower()
        h, s, e = hash_words(joined, _SEPARATORS)
        names, codes = np.unique(np.array(langs[i:j], object), return_inverse=True)
        row = np.searchsorted(np.cumsum([len(t) + 1 for t in texts[i:j]]), s, side="right")
        lang = codes[row]
        seeds = np.array([xxhash.xxh64_intdigest(str(n)) for n in names], np.uint64)
        breaks = np.append(0, np.cumsum(_BREAKS[np.frombuffer(joined, np.uint8)], dtype=np.int32))[s] if len(s) else s
        first, value, out = np.arange(len(h)), seeds[lang], []
        for k in range(most):
            if k:
                first, value = first[:-1] if len(first) and first[-1] + k >= len(h) else first, value
                value = value[: len(first)]
                whole = breaks[first + k] == breaks[first]
                first, value = first[whole], value[whole]
            value = mix(value + h[first + k] * _MULT[0])
            out.append((first, value))
        yield list(names), joined, s, e, lang, out


def _cells(value: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (value * _MULT[row + 1]) >> np.uint64(64 - bits)


def sketch(batches: Iterator[pa.RecordBatch], bits: int, most: int, least: int) -> Iterator[pa.RecordBatch]:
    """The task's count-min sketch, in blocks of cells."""
    held = np.zeros((ROWS, 1 << bits), np.uint8)
    for b in batches:
        for *_, found in phrases(byte_texts(b.column(0)), strings(b.column(1)), most):
            for _, value in found:
                for q in range(ROWS):
                    c, n = np.unique(_cells(value, q, bits).astype(np.uint32), return_counts=True)
                    held[q, c] = np.minimum(held[q, c] + np.minimum(n, least), least)
    size = min(CELL_BLOCK, 1 << bits)
    for q in range(ROWS):
        for k in range(0, 1 << bits, size):
            part = held[q, k : k + size]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int32()), pa.array([k // size], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["q", "block", "cells"])


def _merged(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by their place: summed, and a bit for each cell that reaches least."""
    def done(key: tuple, held: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(held >= least, bitorder="little").tobytes()], pa.binary())], names=["q", "block", "bits"])

    key, held = None, None
    for b in batches:
        for q, block, cells in zip(*(c.to_pylist() for c in b.columns), strict=True):
            part = np.frombuffer(cells, np.uint8)
            if (q, block) != key:
                if key is not None:
                    yield done(key, held)
                key, held = (q, block), np.zeros(len(part), np.uint8)
            held = np.minimum(held + np.minimum(part, least), least)
    if key is not None:
        yield done(key, held)


def survivors(batches: Iterator[pa.RecordBatch], maps: list[np.ndarray], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Phrases that may be frequent, with their counts piece by piece; words 0: all words of the language."""
    for b in batches:
        for names, joined, s, e, lang, found in phrases(byte_texts(b.column(0)), strings(b.column(1)), most):
            own: list[tuple[np.ndarray, int, np.ndarray, list[str]]] = []
            count = np.bincount(lang, minlength=len(names))
            own.append((np.arange(len(names)), 0, count, [""] * len(names)))
            for k, (first, value) in enumerate(found):
                kept = np.ones(len(value), bool)
                for q, m in enumerate(maps):
                    c = _cells(value, q, bits)
                    kept &= (m[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 == 1
                first = first[kept]
                _, at, n = np.unique(value[kept], return_index=True, return_counts=True)
                first = first[at]
                if k:
                    words = [joined[p:q] for p, q in zip(s.tolist(), e.tolist(), strict=True)] if k == 1 else words
                    text = [b" ".join(words[w : w + k + 1]) for w in first.tolist()]
                else:
                    text = [joined[p:q] for p, q in zip(s[first].tolist(), e[first].tolist(), strict=True)]
                own.append((lang[first], k + 1, n, text))
            for codes, k, n, text in own:
                if len(codes):
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(codes)), pa.array(np.full(len(codes), k, np.int32)), pa.array(text, pa.binary()).cast(pa.string()) if k else pa.array(text, pa.string()), pa.array(n.astype(np.int64))], names=["lang", "words", "phrase", "f"])


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST) -> DataFrame:
    """lang, words, phrase, f (long) of all phrases of up to most words that occur least times or more, exactly; words 0: all words of a language."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    size = src.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    bits = int(np.clip(np.ceil(np.log2(max(size / 16, 1))), FEWEST_CELLS, CELLS))
    tasks = max(1, -(-size // (SHARE * ROWS << bits)))
    full = min(least, 100)  # a cell is a byte; a lower bar keeps more phrases, never fewer
    blocks = src.coalesce(tasks).mapInArrow(lambda x: sketch(x, bits, most, full), "q int, block int, cells binary")
    blocks = blocks.repartition("q", "block").sortWithinPartitions("q", "block").mapInArrow(lambda x: _merged(x, full), "q int, block int, bits binary")
    maps = [np.zeros(max(1, (1 << bits) // 8), np.uint8) for _ in range(ROWS)]
    for r in blocks.collect():  # a bit a cell, at most ROWS * 2^CELLS bits
        part = np.frombuffer(r["bits"], np.uint8)
        at = r["block"] * min(CELL_BLOCK, 1 << bits) // 8
        maps[r["q"]][at : at + len(part)] = part
    shared = spark.sparkContext.broadcast(maps)
    x = src.mapInArrow(lambda b: survivors(b, shared.value, bits, most), "lang string, words int, phrase string, f long")
    return x.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("words") == 0))


def score(a: str, l: str, r: str) -> Column:
    """floor(SCALE * a * a / (l * r)), in decimals of 38 digits (counts up to 10^15)."""
    d = lambda c: f"cast({c} as decimal(15,0))"
    return F.expr(f"(cast({SCALE} as decimal(7,0)) * {d(a)} * {d(a)}) div ({d(l)} * {d(r)})")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's best candidates."""
    f = written(counts(docs, text, lang, most, least), "phrases")
    total = f.where("words = 0").select("lang", F.col("f").alias("n"))
    part = lambda p, n: f.where("words > 0").select("lang", F.col("phrase").alias(p), F.col("f").alias(n))
    found = f.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, most), " ").alias("right"))
    scored = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).withColumn("score", score("a", "l", "r"))
    scored = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    if most > 2:
        places = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))))
        inside = found.where("words > 2").select("lang", F.col("a").alias("longer"), F.explode(places).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < subsumed * F.col("a")))
    c = F.col("cut")
    best = scored.select("lang", "phrase", "a", c["l"].alias("l"), c["r"].alias("r"), c["score"].alias("score"))
    order = (F.desc("score"), F.desc("a"), "phrase")
    best = best.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    for group in (["lang", "_part"], ["lang"]):  # the best of each part first, so that one task never ranks more than PARTS * top rows
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
