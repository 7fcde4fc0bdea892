"""LM scoring: a gated recurrent language model with class-factored softmax, in numpy.

Tokens are words `[^\\x20\\x09-\\x0D]+` of texts whose A-Z are lowered, then one end of text. The model knows the CLASSES x
PER_CLASS most frequent training tokens, one of which stands for every other word; such a word's probability is that
of its kind times its smoothed share among the other words' counts over the whole training corpus. Training is truncated
backpropagation over all training tokens: windows of STEPS tokens over parallel streams, the state carried from window to
window and cleared where a text begins. Scoring walks every text to its end in the same way, many texts abreast, and adds up
the log-probabilities of all its tokens.

Training is data-parallel. Equal texts are one row with their number of copies, dealt out in chunks of COPIES, so that no text
loads one shard. A chunk's hash says to which shard and to which of ROUNDS rounds it belongs, so that each epoch goes over every token
once, whatever the partitions of the input; within a shard chunks come in the order of their hashes. In a round every shard
starts from the same weights; then the shards' weights are averaged by a tree of FAN shards a node on the executors, and one set of weights
comes to the driver. A small corpus is gone over more often: until VISITS tokens, or MOST_EPOCHS epochs, have been seen.

What is gathered from the corpus: the count of every training token (a distributed table, joined in by a shuffle; only its
HEAD most frequent rows go to the workers), the token ids of the training texts, and in each round a set of weights from every shard.

Defined cases: a null text is empty, its only token is the end; repeated rows each get their score; without training rows
the weights stay as they are drawn; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_SEPARATORS, byte_texts, discard, fresh, hashed, small_batches, written

CLASSES, PER_CLASS, HIDDEN = 32, 64, 24
STREAMS, STEPS, RATE = 128, 32, 0.01
#: Tokens that a training task holds, and about the number of tokens in a shard.
BLOCK, SHARD_TOKENS = 1 << 18, 2_000_000
#: Epochs over all tokens, each of so many rounds; more epochs where the corpus is small.
EPOCHS, ROUNDS, VISITS, MOST_EPOCHS = 1, 4, 4_000_000, 8
#: Copies of a text in one chunk, and shards averaged in one node of the tree.
COPIES, FAN = 64, 8
#: Tokens whose counts the workers hold.
HEAD = 65_536
#: Tokens scored in one go, and texts abreast (so many that a step's arrays stay in a core's cache).
ABREAST, WIDTH = 3_000_000, 1024
END = -(1 << 62) + 12345  # stands for the end of text among the word hashes
OTHER = 0


@dataclass
class Weights:
    e: np.ndarray  # [V, H] input tokens
    x: np.ndarray  # [H, 3H] what an input adds to update, reset and new state
    u: np.ndarray  # [H, 3H]
    wc: np.ndarray  # [H, C]
    bc: np.ndarray
    w: np.ndarray  # [C, H, M]
    b: np.ndarray  # [C, M]

    @staticmethod
    def drawn(seed: int = 7, hidden: int = HIDDEN, classes: int = CLASSES, per: int = PER_CLASS) -> Weights:
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        return Weights(n(classes * per, hidden), n(hidden, 3 * hidden), n(hidden, 3 * hidden), n(hidden, classes), np.zeros(classes, np.float32), n(classes, hidden, per), np.zeros((classes, per), np.float32))

    def arrays(self) -> list[np.ndarray]:
        return [self.e, self.x, self.u, self.wc, self.bc, self.w, self.b]

    def like(self, flat: np.ndarray) -> Weights:
        """Weights of the same shapes as views of one array."""
        cuts = np.cumsum([0] + [a.size for a in self.arrays()])
        return Weights(*(flat[i:j].reshape(a.shape) for a, i, j in zip(self.arrays(), cuts, cuts[1:], strict=False)))


def sigmoid(a: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.multiply(a, 0.5, out=out)
    np.tanh(out, out=out)
    out += 1
    out *= 0.5
    return out


class Cell:
    """Steps of the recurrence for up to width rows, in arrays that are made once."""

    def __init__(self, p: Weights, width: int):
        k = p.u.shape[0]
        self.p, self.k, kind = p, k, p.u.dtype
        self.g, self.a, self.d = np.empty((width, 3 * k), kind), np.empty((width, 2 * k), kind), np.empty((width, k), kind)

    def step(self, h: np.ndarray, x: np.ndarray, zr: np.ndarray | None = None, gn: np.ndarray | None = None, n: np.ndarray | None = None, out: np.ndarray | None = None) -> np.ndarray:
        """The next state, from the state and what the inputs add (their rows of e @ x); the parts go to zr, gn and n, if given."""
        m, k = len(h), self.k
        g, a, d = self.g[:m], self.a[:m] if zr is None else zr, self.d[:m]
        np.dot(h, self.p.u, out=g)
        np.add(g[:, : 2 * k], x[:, : 2 * k], out=a)
        sigmoid(a, a)
        if gn is not None:
            gn[:] = g[:, 2 * k :]
        n = np.empty((m, k), h.dtype) if n is None else n
        np.multiply(a[:, k:], g[:, 2 * k :], out=n)
        n += x[:, 2 * k :]
        np.tanh(n, out=n)
        np.subtract(h, n, out=d)
        d *= a[:, :k]
        return np.add(n, d, out=out) if out is not None else n + d


def log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = logits[np.arange(len(at)), at]
    np.minimum(logits, 80, out=logits)  # far above what trained weights give; keeps exp finite
    np.exp(logits, out=logits)
    return np.minimum(own, 80) - np.log(logits.sum(axis=1))  # row by row: a product with ones rounds by the number of rows


def output_logp(p: Weights, hs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """ln p(target | state): of its class, plus of the token within the class; rows are taken class by class."""
    per = p.b.shape[1]
    order = np.argsort(target, kind="stable")
    hs, target = hs[order], target[order]
    cls, own = target // per, target % per
    got = log_softmax_at(hs @ p.wc + p.bc, cls)
    cuts = np.searchsorted(cls, np.arange(len(p.b) + 1)).tolist()
    for c in range(len(p.b)):
        i, j = cuts[c], cuts[c + 1]
        if i < j:
            got[i:j] += log_softmax_at(hs[i:j] @ p.w[c] + p.b[c], own[i:j])
    out = np.empty_like(got)
    out[order] = got
    return out


def window_gradients(
    p: Weights, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, clear: np.ndarray, counted: np.ndarray | None = None, out: list[np.ndarray] | None = None
) -> tuple[float, np.ndarray, list[np.ndarray]]:
    """Mean loss of a window [steps, streams], the state after it, and the gradients (into out, if given) cut off at its begin.
    clear: the input begins a text. counted: which targets count; all, if not given."""
    k, per, steps, wide = p.u.shape[0], p.b.shape[1], *inputs.shape
    g = [np.zeros_like(a) for a in p.arrays()] if out is None else out
    ge, gx, gu, gwc, gbc, gw, gb = g
    kind = p.u.dtype
    ids = inputs.ravel()
    e = p.e[ids]
    x = (e @ p.x).reshape(steps, wide, 3 * k)
    before, after, gn, n = (np.empty((steps, wide, k), kind) for _ in range(4))
    zr = np.empty((steps, wide, 2 * k), kind)
    cell, any_clear = Cell(p, wide), clear.any(axis=1)
    for t in range(steps):
        before[t] = h
        if any_clear[t]:
            before[t, clear[t]] = 0
        h = cell.step(before[t], x[t], zr[t], gn[t], n[t], after[t])
    every = counted is None
    target = targets.ravel()
    m = len(target) if every else max(1, int(counted.sum()))
    order = np.argsort(target, kind="stable")
    if not every:
        order = order[counted.ravel()[order]]
    target, flat = target[order], after.reshape(-1, k)[order]
    cls, own = target // per, target % per
    row = np.arange(len(order))

    def errors(logits: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, float]:
        """(probabilities - target) / m, and the loss."""
        np.minimum(logits, 80, out=logits)
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], kind)
        r = row[: len(at)]
        lost = float(np.log(total).sum() - np.log(logits[r, at]).sum())
        logits *= (1 / (m * total))[:, None].astype(kind)
        logits[r, at] -= kind.type(1 / m)
        return logits, lost

    q, loss = errors(flat @ p.wc + p.bc, cls)
    np.dot(flat.T, q, out=gwc)
    gbc[:] = q.sum(axis=0)
    dh = q @ p.wc.T
    cuts = np.searchsorted(cls, np.arange(len(p.b) + 1)).tolist()
    for c in range(len(p.b)):
        i, j = cuts[c], cuts[c + 1]
        if i == j:
            gw[c], gb[c] = 0, 0
            continue
        q, lost = errors(flat[i:j] @ p.w[c] + p.b[c], own[i:j])
        loss += lost
        np.dot(flat[i:j].T, q, out=gw[c])
        gb[c] = np.ones(j - i, kind) @ q
        dh[i:j] += q @ p.w[c].T
    d_after = np.zeros((steps * wide, k), kind)
    d_after[order] = dh
    d_after = d_after.reshape(steps, wide, k)
    z, r = zr[:, :, :k], zr[:, :, k:]
    of_n = (1 - z) * (1 - n * n)
    of_z, of_r = (before - n) * z * (1 - z), gn * r * (1 - r)
    dg, dn3 = np.empty((steps, wide, 3 * k), kind), np.empty((steps, wide, k), kind)
    d, ut = np.zeros((wide, k), kind), np.ascontiguousarray(p.u.T)
    back, held = np.zeros((wide, k), kind), np.empty((wide, k), kind)
    for t in range(steps - 1, -1, -1):
        np.add(d_after[t], back, out=d)
        dn, one = dn3[t], dg[t]
        np.multiply(d, of_n[t], out=dn)
        np.multiply(d, of_z[t], out=one[:, :k])
        np.multiply(dn, of_r[t], out=one[:, k : 2 * k])
        np.multiply(dn, r[t], out=one[:, 2 * k :])
        np.dot(one, ut, out=back)
        np.multiply(d, z[t], out=held)
        back += held
        if any_clear[t]:
            back[clear[t]] = 0
    flat_dg = dg.reshape(-1, 3 * k)
    np.dot(before.reshape(-1, k).T, flat_dg, out=gu)
    dx = flat_dg  # the same for update and reset; the new state's own part
    dx[:, 2 * k :] = dn3.reshape(-1, k)
    np.dot(e.T, dx, out=gx)
    # rows of one token added up, along contiguous memory
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.diff(ids[order], prepend=-1))
    ge.fill(0)
    ge[ids[order[first]]] = np.add.reduceat((p.x @ dx.T)[:, order], first, axis=1).T
    return loss / m, h, g


class Trainer:
    """Adam over the windows of a token stream (texts one after the other, each closed by end) that comes in pieces; no more
    than BLOCK tokens and one piece are held."""

    def __init__(self, weights: Weights, end: int, rate: Callable[[int], float], streams: int = STREAMS, steps: int = STEPS):
        self.flat = np.concatenate([a.ravel() for a in weights.arrays()])
        self.weights = weights.like(self.flat)
        self.gradient, self.m, self.v = (np.zeros_like(self.flat) for _ in range(3))
        self.gradients = weights.like(self.gradient).arrays()
        self.end, self.rate, self.streams, self.steps = end, rate, streams, steps
        self.held: list[np.ndarray] = []
        self.waiting = self.tokens = self.t = 0
        self.last = end

    def add(self, tokens: np.ndarray) -> None:
        self.held.append(tokens)
        self.waiting += len(tokens)
        if self.waiting >= BLOCK:
            every = np.concatenate(self.held)
            whole = len(every) - len(every) % BLOCK
            for i in range(0, whole, BLOCK):
                self.block(every[i : i + BLOCK])
            self.held, self.waiting = [every[whole:]], len(every) - whole

    def finish(self) -> None:
        if self.waiting:
            self.block(np.concatenate(self.held))
        self.held, self.waiting = [], 0

    def block(self, tokens: np.ndarray) -> None:
        """Parallel streams over the block; the last is filled up with ends that don't count, so that every token does."""
        streams = max(1, min(self.streams, len(tokens) // (self.steps + 1)))
        n = -(-len(tokens) // streams)
        filled = np.full(n * streams, self.end, np.int32)
        filled[: len(tokens)] = tokens
        lay = lambda a: a.reshape(streams, n).T
        before, target = lay(np.append(np.int32(self.last), filled[:-1])), lay(filled)
        counted = lay(np.arange(n * streams) < len(tokens)) if n * streams > len(tokens) else None
        h = np.zeros((streams, self.weights.u.shape[0]), np.float32)
        for i in range(0, n, self.steps):
            x = before[i : i + self.steps]
            _, h, _ = window_gradients(self.weights, h, x, target[i : i + self.steps], x == self.end, None if counted is None else counted[i : i + self.steps], self.gradients)
            self.update(self.rate(self.tokens + i * streams))
        self.tokens += len(tokens)
        self.last = tokens[-1]

    def update(self, rate: float) -> None:
        g, m, v = self.gradient, self.m, self.v
        self.t += 1
        # Adam, after the gradient is cut to length one
        g *= np.float32(min(1.0, 1.0 / (math.sqrt(float(g @ g)) + 1e-9)))
        m += np.float32(0.1) * (g - m)
        g *= g
        g -= v
        v += np.float32(0.01) * g
        np.multiply(v, np.float32(1 / (1 - 0.99**self.t)), out=g)
        np.sqrt(g, out=g)
        g += np.float32(1e-6)
        np.divide(m, g, out=g)
        g *= np.float32(rate / (1 - 0.9**self.t))
        self.flat -= g


def train(texts: DataFrame, weights: Weights, tokens: int, end: int, epochs: int | None = None) -> tuple[Weights, int]:
    """The weights after epochs over every text of texts (columns ids binary, n copies), and how many tokens each epoch went over."""
    spark, trained = texts.sparkSession, 0
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-VISITS // max(1, tokens)))) if epochs is None else epochs
    shards = max(1, -(-tokens // SHARD_TOKENS))
    expected = max(1.0, tokens / shards / ROUNDS)
    spread = lambda lo, hi, by: F.explode(F.sequence(lo, hi - 1, F.lit(by).cast("long")))
    cut = texts.select("ids", "n", spread(F.lit(0).cast("long"), F.col("n"), COPIES << 16).alias("lo"))  # in two steps: no long array
    cut = cut.select("ids", "n", spread(F.col("lo"), F.least("n", F.col("lo") + (COPIES << 16)), COPIES).alias("at"))
    cut = cut.select("ids", F.least(F.lit(COPIES), F.col("n") - F.col("at")).cast("int").alias("n"), F.xxhash64("ids", "at").alias("h"))
    dealt = cut.select("ids", "n", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("h"), F.lit(ROUNDS)).cast("int").alias("round"))
    dealt = written(dealt.repartition(shards, "shard").sortWithinPartitions("round", "shard", "h", "ids"), "lm-shards", by="round")
    for turn in range(epochs * ROUNDS):
        shipped = spark.sparkContext.broadcast(weights)

        def shard(batches: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            rate = lambda done: RATE * (1 - 0.95 * (turn + min(1.0, done / expected)) / (epochs * ROUNDS))
            key, trainer = None, None

            def out() -> pa.RecordBatch:
                trainer.finish()
                return _weights_row(key, trainer.tokens, trainer.flat.astype(np.float64) * trainer.tokens)

            for b in batches:
                for k, n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if k != key:
                        if key is not None:
                            yield out()
                        key, trainer = k, Trainer(shipped.value, end, rate)
                    for _ in range(n):
                        trainer.add(np.frombuffer(x.as_buffer(), "<u2").astype(np.int32))
            if key is not None:
                yield out()

        rows = dealt.where(F.col("round") == turn % ROUNDS).select("shard", "n", "ids", "h").repartition(shards, "shard").sortWithinPartitions("shard", "h", "ids").select("shard", "n", "ids").mapInArrow(shard, _ROW)
        level = shards
        while level > 1:  # a tree of sums; each node adds its rows one by one, in one order
            level = -(-level // FAN)
            rows = rows.select(F.floor(F.col("shard") / FAN).cast("int").alias("shard"), F.col("shard").alias("own"), "n", "w").repartition(level, "shard").sortWithinPartitions("shard", "own").select("shard", "n", "w").mapInArrow(_summed, _ROW)
        top = rows.collect()  # one row: all are under shard 0
        shipped.unpersist()
        seen = sum(r["n"] for r in top)
        if turn < ROUNDS:
            trained += seen
        if seen:
            weights = weights.like((sum(np.frombuffer(r["w"]) for r in top) / seen).astype(np.float32))
    discard(dealt)
    return weights, trained


_ROW = "shard int, n long, w binary"


def _weights_row(shard: int, n: int, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], names=["shard", "n", "w"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of neighbouring rows of one shard."""
    key, n, w = None, 0, None
    for b in batches:
        for k, c, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            if k != key:
                if key is not None:
                    yield _weights_row(key, n, w)
                key, n, w = k, 0, 0.0
            n, w = n + c, w + np.frombuffer(x.as_buffer())
    if key is not None:
        yield _weights_row(key, n, w)


@dataclass
class Model:
    weights: Weights
    head: np.ndarray  # sorted hashes of the most frequent training tokens
    head_count: np.ndarray
    head_id: np.ndarray  # their ids in the model; OTHER for those it does not know
    end: int
    tokens: int  # N
    distinct: int  # V
    other_tokens: int
    other_distinct: int
    trained: int = 0  # tokens that each epoch of training goes over

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Model id, training count, whether the head has it, and its place there, of every token hash."""
        if not len(self.head):
            return np.zeros(len(h), np.int32), np.zeros(len(h), np.int64), np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        i = np.minimum(np.searchsorted(self.head, h), len(self.head) - 1)
        ok = self.head[i] == h
        return np.where(ok, self.head_id[i], OTHER).astype(np.int32), np.where(ok, self.head_count[i], 0), ok, i

    def log10_texts(self, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """log10 probability of the id sequence of each text; ids of all texts, bounds where each begins (and the end)."""
        p, m = self.weights, len(bounds) - 1
        out = np.zeros(m)
        if not m:
            return out
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        table, cell = p.e @ p.x, Cell(p, WIDTH)
        for first in range(0, m, WIDTH):
            texts = order[first : first + WIDTH]
            out[texts] = self._abreast(ids, bounds[texts], length[texts], table, cell)
        return out / math.log(10)

    def _abreast(self, ids: np.ndarray, begin: np.ndarray, length: np.ndarray, table: np.ndarray, cell: Cell) -> np.ndarray:
        """ln probability of texts with falling lengths, one step of all texts that last so long after another."""
        p, m = self.weights, len(length)
        alive = (m - np.searchsorted(length[::-1], np.arange(1, length[0] + 1), "left")).tolist()
        out, room = np.zeros(m), 16384 + m
        h, before = np.zeros((m, p.u.shape[0]), p.u.dtype), np.full(m, self.end, np.int32)
        hs, targets, used = np.empty((room, h.shape[1]), h.dtype), np.empty(room, np.int32), 0
        sizes: list[int] = []
        x = np.empty((m, table.shape[1]), table.dtype)
        for t, n in enumerate(alive):
            np.take(table, before[:n], axis=0, out=x[:n], mode="clip")
            h = cell.step(h[:n], x[:n], out=hs[used : used + n])
            before = ids[begin[:n] + t]
            targets[used : used + n] = before
            sizes.append(n)
            used += n
            if used >= 16384 or t + 1 == len(alive):
                logp = output_logp(p, hs[:used], targets[:used])
                who = np.concatenate([np.arange(c) for c in sizes])
                out += np.bincount(who, weights=logp, minlength=m)
                h, sizes, used = h.copy(), [], 0
        return out


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Signed 64-bit token hashes of all texts, the end after each, and where each text begins."""
    parts, bounds = [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
    at = 0
    for i, j, h, b, *_ in hashed([t.lower() for t in texts], SPACE_SEPARATORS):
        h = np.insert(h.view(np.int64), b[1:], END)
        parts.append(h)
        bounds.append(at + b[1:] + np.arange(1, j - i + 1))
        at += len(h)
    return np.concatenate(parts), np.concatenate(bounds)


def count(train_rows: DataFrame, text: str = "text", limit: int = 1_000_000) -> DataFrame:
    """Count of every token of the training rows: hash, n. Counted within each task before the shuffle."""
    small_batches(train_rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["hash", "n"])

        for b in batches:
            h, _ = token_hashes(byte_texts(b.column(0)))
            x, c = np.unique(h, return_counts=True)
            both, at = np.unique(np.concatenate([keys, x]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([n, c]), minlength=len(both)).astype(np.int64)
            keys = both
            if len(keys) > limit:
                yield out()
                keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        yield out()

    rows = train_rows.select(F.col(text).alias("text")).mapInArrow(run, "hash long, n long")
    return written(rows.groupBy("hash").agg(F.sum("n").alias("n")), "lm-counts")


def fit(train_rows: DataFrame, counts: DataFrame, text: str = "text", epochs: int | None = None) -> Model:
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the head: all tokens above a count that at most HEAD tokens reach (their ends apart), by a small histogram of the counts
    level = F.floor(F.log2("n") * 64).cast("long")
    held, least = 0, 1 << 62
    for r in sorted(counts.where(F.col("hash") != END).groupBy(level.alias("level")).count().collect(), reverse=True):
        held += r["count"]
        if held > HEAD:
            break
        least = r["level"]
    top = sorted(counts.where((level >= least) | (F.col("hash") == END)).collect(), key=lambda r: (-r["n"], r["hash"]))
    size = CLASSES * PER_CLASS
    known = [END] + [r["hash"] for r in top if r["hash"] != END][: size - 2]
    ids = {h: i + 1 for i, h in enumerate(known)}  # 0 is OTHER
    top = sorted((r["hash"], r["n"]) for r in top)
    head, n = np.array([h for h, _ in top], np.int64), np.array([c for _, c in top], np.int64)
    head_id = np.array([ids.get(h, OTHER) for h in head.tolist()], np.int32)
    inside = head_id != OTHER
    model = Model(Weights.drawn(), head, n, head_id, ids[END], total["n"], total["v"], total["n"] - int(n[inside].sum()), total["v"] - int(inside.sum()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, at = token_hashes(byte_texts(b.column(0)))
            offsets = pa.py_buffer((2 * at).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, offsets, pa.py_buffer(model.look_up(h)[0].astype("<u2"))])], names=["ids"])

    # start from the frequencies: class and token biases are their logarithms
    freq = np.bincount(head_id, weights=n, minlength=size)
    freq[OTHER] = model.other_tokens
    freq = freq.reshape(CLASSES, PER_CLASS) + 0.05
    model.weights.bc[:] = np.log(freq.sum(axis=1) / freq.sum())
    model.weights.b[:] = np.log(freq / freq.sum(axis=1)[:, None])
    if epochs != 0:
        small_batches(train_rows.sparkSession)
        rows = written(train_rows.select(F.col(text).alias("text")).mapInArrow(encode, "ids binary").groupBy("ids").agg(F.count(F.lit(1)).alias("n")), "lm-ids")
        model.weights, model.trained = train(rows, model.weights, model.tokens, model.end, epochs)
        discard(rows)
    return model


def score(df: DataFrame, model: Model, counts: DataFrame, text: str = "text", out: str = "lm", keep_text: bool = True) -> DataFrame:
    """df with a struct column: n_tokens, n_known (counted in training), base_score (log10, add-one unigram) and score (log10
    probability under the model). A column with that name is replaced. keep_text: without, the text itself isn't carried along."""
    spark = df.sparkSession
    small_batches(spark)
    keep = [c for c in df.columns if c.lower() != out.lower() and (keep_text or c.lower() != text.lower())]
    rid, own, given = fresh(df, "_rid", "_own", "_given")
    src = df.select(*keep, F.col(text).alias(given))
    kind = "struct<n:bigint,known:bigint,head:double,model:double,other:double,n_other:bigint,tail:array<bigint>>"
    schema = src.select(*keep).withColumns({rid: F.lit(0).cast("long"), own: F.lit(None).cast(kind)}).schema
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        at = TaskContext.get().partitionId() << 40
        log_count = np.log10(m.head_count + 1.0)

        def done(held: list[tuple]) -> pa.RecordBatch:
            ids = np.concatenate([x[1] for x in held])
            bounds = np.append(0, np.cumsum(np.concatenate([np.diff(x[2]) for x in held])))
            lp = m.log10_texts(ids, bounds)
            cat = lambda k: np.concatenate([x[k] for x in held])
            tails = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(cat(8))).astype(np.int32)), pa.array(cat(7)))
            fields = [pa.array(np.diff(bounds)), pa.array(cat(3)), pa.array(cat(4)), pa.array(lp), pa.array(cat(5)), pa.array(cat(6)), tails]
            rows = pa.Table.from_batches([x[0] for x in held]).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in rows.columns]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            return pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(fields, names=["n", "known", "head", "model", "other", "n_other", "tail"])], names=[*rows.column_names, own])

        held: list[tuple] = []
        tokens = 0
        for b in batches:
            h, bounds = token_hashes(byte_texts(b.column(given)))
            ids, c, ok, i = m.look_up(h)
            lc = np.where(ok, log_count[i], 0.0) if len(m.head) else np.zeros(len(h))
            sums = lambda v: np.diff(np.append(0, np.cumsum(v))[bounds])
            other = ids == OTHER
            rows = pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(np.arange(at, at + b.num_rows))], names=[*keep, rid])
            at += b.num_rows
            held.append((rows, ids, bounds, sums(c > 0), sums(lc), sums(lc * other), sums(other), h[~ok], sums(~ok)))
            tokens += len(h)
            if tokens >= ABREAST:
                yield done(held)
                held, tokens = [], 0
        if held:
            yield done(held)

    docs = written(src.mapInArrow(run, schema), "lm-docs")
    x = F.col(own)
    tail = docs.select(F.col(rid).alias("r"), F.explode(x["tail"]).alias("hash")).join(counts, "hash")
    tail = tail.groupBy("r").agg(F.sum(F.log10(F.col("n") + 1.0)).alias("s"), F.count(F.lit(1)).alias("k")).select(F.col("r").alias(rid), F.struct("s", "k").alias("_tail"))
    extra = fresh(docs, "_tail")[0]
    docs = docs.join(tail.withColumnRenamed("_tail", extra), rid, "left")
    s, k = F.coalesce(F.col(extra)["s"], F.lit(0.0)), F.coalesce(F.col(extra)["k"], F.lit(0))
    base = x["head"] + s - x["n"] * math.log10(model.tokens + model.distinct + 1)
    full = x["model"] + x["other"] + s - x["n_other"] * math.log10(model.other_tokens + model.other_distinct + 1)
    return docs.select(*keep, F.struct(x["n"].alias("n_tokens"), (x["known"] + k).alias("n_known"), base.alias("base_score"), full.alias("score")).alias(out))
