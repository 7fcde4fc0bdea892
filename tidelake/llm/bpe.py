"""BPE encoding and decoding: tree concatenation.

A text is halved at characters, wherever these stand, until no part has more than LEAF characters; the leaves of many texts
are encoded in parallel, and neighbours are joined level by level. A join takes the last runs (what stands between white space) of the
left and the first ones of the right part, encodes them anew from the text, and takes twice as many until the outermost run on
both sides has just the tokens that its part gave it, or the part has no more. This holds for tokenizers whose tokens never
hold white space, where runs stand alone ("dropped" in _chunks).

A run of more than LEAF characters, such as unsplit text without any white space, is a tree of its own, joined by tokens:
the last tokens of the left and the first of the right side are encoded anew in a growing window until both
ends of the window agree with what stands beside them: two neighbouring tokens agree if the two, encoded together, give just
these two. A sequence whose neighbours all agree is the encoding of the whole (merges of a trained vocabulary build on
earlier merges), so the result is exactly what the library gives for the unsplit run. Texts of other tokenizers are cut into
the runs that these treat one by one, and only their long runs are trees.

Tokens of runs and of leaves' ends are kept in a memo. Leaves that are new to it are encoded by WORKERS threads, without the
interpreter's lock.

Defined cases: a null text is empty (no tokens, empty decoded text); repeated rows each get their result; an empty table
gives an empty result; other columns stay. Work is row by row, without a shuffle.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import Memo, Runs, load, mode
from ._common import groups, small_batches, strings

#: Characters in a leaf, of a text and of a run.
LEAF = 2048
#: Threads that encode leaves; and runs that a thread takes at least.
WORKERS, SHARE = 2, 8192
_STATE: dict = {}


class TreeEncoder:
    """Encodes long runs of one tokenizer file by tree concatenation."""

    def __init__(self, path: str, leaf: int = LEAF // 4):
        from tokenizers import Tokenizer, models

        self.tok, self.leaf = load(path), leaf
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # the same merges for a piece that ends inside a word, and for one that ends a word
        self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
        self.outer = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.suffix)) if self.suffix else self.inner
        self.vocab: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special, self.split = special, re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._agree: dict[tuple[str, str], bool] = {}
        self.joins = 0

    def _encode(self, symbols: str, last: bool) -> list[str]:
        return (self.outer if last else self.inner).encode(symbols, add_special_tokens=False).tokens

    def _text(self, tokens: list[str], last: bool) -> str:
        s = "".join(tokens)
        return s[: len(s) - len(self.suffix)] if last and self.suffix else s

    def agree(self, a: str, b: str, last: bool) -> bool:
        key = (a, b)
        if key not in self._agree:
            if len(self._agree) > 100_000:
                self._agree.clear()
            self._agree[key] = self._encode(self._text([a, b], last), last) == [a, b]
        return self._agree[key]

    def join(self, a: list[str], b: list[str], last: bool) -> list[str]:
        """The tokens of two neighbouring pieces together; last: b ends the word."""
        if not a or not b:
            return a + b
        self.joins += 1
        k = 1
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            end = last and j == len(b)
            w = self._encode(self._text(a[i:] + b[:j], end), end)
            left = i == 0 or self.agree(a[i - 1], w[0], end and len(w) == 1)
            right = j == len(b) or self.agree(w[-1], b[j], last and j + 1 == len(b))
            if left and right:
                return a[:i] + w + b[j:]
            k *= 2

    def word(self, symbols: str) -> list[str]:
        """The tokens of one word in the byte alphabet."""
        if len(symbols) <= self.leaf:
            return self._encode(symbols, True)
        cuts = [symbols[i : i + self.leaf] for i in range(0, len(symbols), self.leaf)]
        level = [e.tokens for e in self.inner.encode_batch(cuts[:-1], add_special_tokens=False)] + [self._encode(cuts[-1], True)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1], i + 2 >= len(level)) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                norm = self.tok.normalizer.normalize_str(part) if self.tok.normalizer else part
                for symbols, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm):
                    out += [self.vocab[t] for t in self.word(symbols)]
        return out


class Codec:
    """Encodes and decodes texts of one tokenizer file."""

    def __init__(self, path: str, leaf: int = LEAF):
        self.tok, self.how, self.tree, self.leaf = load(path), mode(path), TreeEncoder(path), leaf
        self.joined = self.tok.decoder is None  # then decode() joins the token strings with one blank
        self.names = [self.tok.decode([i], skip_special_tokens=False) for i in range(self.tok.get_vocab_size(with_added_tokens=True))] if self.joined else []
        self.ids, self.memo = Runs(self.tok, self.how, path), Memo({"": (0, "", "")} if self.how == "dropped" else {}, self._learn)
        self.pool = ThreadPoolExecutor(WORKERS)
        self.joins = 0

    def _learn(self, runs: list) -> list[tuple[int, str, str]]:
        """Number of tokens, ids and decoded text of each run."""
        size = lambda r: len(r[0]) if isinstance(r, tuple) else len(r)
        short = [r for r in runs if size(r) <= self.leaf]
        share = max(SHARE, -(-len(short) // WORKERS))
        parts = [short[i : i + share] for i in range(0, len(short), share)]
        known = dict(zip(short, (x for part in (self.pool.map(self.ids, parts) if len(parts) > 1 else map(self.ids, parts)) for x in part), strict=True))
        lead = " " if self.how == "leading" else ""
        out = []
        for r in runs:
            x = known[r] if r in known else self.tree.encode(r[0] if isinstance(r, tuple) else lead + r)
            out.append((len(x), " ".join(map(str, x)), " ".join([self.names[i] for i in x]) if self.joined else ""))
        return out

    def leaves(self, s: str) -> list[int]:
        """Where the text is cut: each part is halved until it is a leaf. A long run is not cut, as it is a tree of its own."""
        cuts, parts = [], [(0, len(s))]
        while parts:
            lo, hi = parts.pop()
            if hi - lo <= self.leaf:
                continue
            mid = (lo + hi) // 2
            first, last = s.rfind(" ", lo, mid) + 1 or lo, s.find(" ", mid, hi)
            last = hi if last < 0 else last
            if last - first > self.leaf:
                mid = first if first > lo else last
                if mid >= hi:  # nothing but the run
                    continue
            cuts.append(mid)
            parts += [(lo, mid), (mid, hi)]
        return [0, *sorted(cuts), len(s)]

    def _windows(self, joins: list[tuple], texts: list[str], k: int) -> list[tuple[int, int]]:
        """The text of the k last runs of the left and the k first of the right part of each join."""
        out = []
        for t, lo, mid, hi, *_ in joins:
            s, a, b = texts[t], mid, mid
            for _ in range(k):
                a = s.rfind(" ", lo, a)
                if a < 0:
                    break
            at = mid
            for _ in range(k):
                b = s.find(" ", at, hi)
                if b < 0:
                    break
                at = b + 1
            out.append((lo if a < 0 else a + 1, hi if b < 0 else b))
        return out

    def join(self, joins: list[tuple], texts: list[str]) -> list[list]:
        """The values of the runs of each join's two parts together; a join is (text, begin, cut, end, left, right)."""
        out: list = [None] * len(joins)
        self.joins += len(joins)
        open_, k = list(range(len(joins))), 2
        while open_:
            todo = [joins[q] for q in open_]
            bounds = self._windows(todo, texts, k)
            runs = [texts[x[0]][a:b].split(" ") for x, (a, b) in zip(todo, bounds, strict=True)]
            flat, at = self.memo.values_of([r for w in runs for r in w]), 0
            rest = []
            for q, (t, lo, mid, hi, left, right), (a, b), w in zip(open_, todo, bounds, runs, strict=True):
                new, s = flat[at : at + len(w)], texts[t]
                at += len(w)
                i, j = len(left) - 1 - s.count(" ", a, mid), s.count(" ", mid, b) + 1
                if (a == lo or new[0] == left[i]) and (b == hi or new[-1] == right[j - 1]):
                    out[q] = left[:i] + new + right[j:]
                else:
                    rest.append(q)
            open_, k = rest, 2 * k
        return out

    def values(self, texts: list[str]) -> list[list]:
        """The values of the runs of each text."""
        if self.how != "dropped":
            return self.memo.by_text(texts, self.how)
        for c in "\n\t\r":
            texts = [t.replace(c, " ") if c in t else t for t in texts]
        cuts = [self.leaves(t) if len(t) > self.leaf else [0, len(t)] for t in texts]
        runs = [[t[i:j].split(" ") for i, j in zip(c, c[1:], strict=False)] for t, c in zip(texts, cuts, strict=True)]
        flat, at = self.memo.values_of([r for parts in runs for leaf in parts for r in leaf]), 0
        level: list[list] = []
        for parts in runs:
            level.append([])
            for leaf in parts:
                level[-1].append(flat[at : at + len(leaf)])
                at += len(leaf)
        while any(len(parts) > 1 for parts in level):
            joins = [(t, cuts[t][q], cuts[t][q + 1], cuts[t][q + 2], parts[q], parts[q + 1]) for t, parts in enumerate(level) for q in range(0, len(parts) - 1, 2)]
            done = iter(self.join(joins, texts))
            level = [[next(done) if q + 1 < len(parts) else parts[q] for q in range(0, len(parts), 2)] for parts in level]
            cuts = [c[:-1:2] + c[-1:] for c in cuts]
        return [parts[0] for parts in level]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, ids and decoded text of each text."""
        out = []
        for known in self.values(texts):
            known = [x for x in known if x[0]]
            n, ids, decoded = zip(*known, strict=True) if known else ((), (), ())
            ids = " ".join(ids)
            out.append((sum(n), ids, " ".join(decoded) if self.joined else self.tok.decode([int(i) for i in ids.split()], skip_special_tokens=False)))
        return out


def encode(df: DataFrame, path: str, text: str = "text", digest: bool = False, names: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """df with the number of tokens of the text, their ids (array of int) and the text decoded from them.

    digest: instead of the last two, the sha256 in hex of the decimal ids joined by blanks and of the decoded text. Columns of
    df with one of the names are replaced. path: at the same place on every machine.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    df = df.select(*keep, *([] if text in keep else [F.col(text)]))
    kinds = ("long", "string" if digest else "array<int>", "string")
    schema = df.select(*keep).withColumns({n: F.lit(None).cast(k) for n, k in zip(names, kinds, strict=True)}).schema
    sha: Callable[[str], str] = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _STATE:
            _STATE.clear()
            _STATE[path] = Codec(path)
        codec = _STATE[path]
        for b in batches:
            texts = strings(b.column(text))
            n, ids, decoded = [], [], []
            for i, j in groups([len(t) for t in texts]):
                for x, y, z in codec.digests(texts[i:j]):
                    n.append(x)
                    ids.append(sha(y) if digest else np.array(y.split(), np.int32))
                    decoded.append(sha(z) if digest else z)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(n, pa.int64()), pa.array(ids, pa.string() if digest else pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=[*keep, *names])

    return df.mapInArrow(run, schema)
