"""Language ID: interpolated Kneser-Ney character models per language.

A text is its lower-cased letters, every run of other characters as one blank. For each language an order-ORDER character
model with interpolated Kneser-Ney smoothing is estimated; its entries lie in sorted arrays of 64-bit gram hashes, with one
column of log-probabilities and back-off weights a language. A text gets the language of the lowest cross-entropy a
character. Rejection is calibrated on training documents left out of the counts: a text is rejected if it has no letter or
if its best cross-entropy lies beyond what such documents of that language show.

The counts come from a bounded sample of labelled rows, SAMPLE different texts a language (expected; drawn by a hash of the
text; all, where a language has no more, and one of them at least is counted); prediction reads every text whole. The model's size follows the sample, not the corpus.

Defined cases: null, empty and letterless texts are `und` with score 0 and rejected; ties go to the first language in
order; repeated rows get equal results; without any labelled row everything is `und`; an empty table gives an empty result;
other columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, groups, mix, small_batches, strings, written

ORDER = 4
#: Labelled documents a language that are counted, and of these the share kept for calibration.
SAMPLE, CALIBRATION = 400, 0.25
#: Values of the language column whose counts are broadcast; more are joined as Spark sees fit.
LANGUAGES = 10_000
#: A text is rejected beyond the mean cross-entropy of calibration texts by so many deviations (widened for short texts) plus slack.
DEVIATIONS, SLACK = 8.0, 0.9
UNKNOWN = "und"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LETTER: dict[str, np.ndarray] = {}
BLANK = 32


def _letters() -> np.ndarray:
    """For each code point whether it is a letter (or a mark inside words)."""
    if "t" not in _LETTER:
        _LETTER["t"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER["t"]


def normal(text: str) -> np.ndarray:
    """Code points of the lower-cased letters with single blanks around words; empty without letters."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    ok = _letters()[np.minimum(a, 0x10FFFF)]
    if not ok.any():
        return np.empty(0, np.uint32)
    a = np.where(ok, a, np.uint32(BLANK))
    keep = ok | np.append(True, ok[:-1])
    a = a[keep]
    if a[0] != BLANK:
        a = np.append(np.uint32(BLANK), a)
    return a if a[-1] == BLANK else np.append(a, np.uint32(BLANK))


def gram_hashes(a: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(a) - n + 1), np.uint64)
    for i in range(n):
        out = out * _BASE + (a[i : len(a) - n + 1 + i].astype(np.uint64) + np.uint64(1))
    return mix(out)


@dataclass
class Model:
    """Sorted gram hashes of each order 1..ORDER; for each, a column a language of log2 p(last | rest) with all lower orders
    interpolated where the language has the gram (else nan), and of log2 back-off weights of the gram as a context."""

    languages: list[str]
    order: int = ORDER
    keys: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    back: list[np.ndarray] = field(default_factory=list)
    floor: float = -20.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None

    def _rows(self, n: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = self.keys[n - 1]
        i = np.minimum(np.searchsorted(k, x), len(k) - 1)
        return i, k[i] == x

    def char_logp(self, a: np.ndarray) -> np.ndarray:
        """log2 p of the character after each position ORDER-1.. for each language; looked up once a distinct gram."""
        full = gram_hashes(a, self.order)
        u, first, inverse = np.unique(full, return_index=True, return_inverse=True)
        total = np.zeros((len(u), len(self.languages)), np.float32)
        done = np.zeros(total.shape, bool)
        for n in range(self.order, 0, -1):
            shift = self.order - n
            x = u if shift == 0 else gram_hashes_at(a, first + shift, n)
            i, ok = self._rows(n, x)
            p = np.where(ok[:, None], self.logp[n - 1][i], np.nan)
            use = ~done & ~np.isnan(p)
            total[use] += p[use]
            done |= use
            if n > 1:  # not in this order: the weight of the context, and on
                i, ok = self._rows(n - 1, gram_hashes_at(a, first + shift, n - 1))
                w = np.where(ok[:, None], self.back[n - 2][i], 0.0)
                total += np.where(done, 0.0, w)
        total[~done] += self.floor
        return total, inverse

    def cross_entropy(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits a character of each text (nan without letters) under each language."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        full = [i for i, t in enumerate(texts) if len(t)]
        if not full or not self.languages:
            return out
        pad = np.full(self.order - 1, BLANK, np.uint32)
        parts = [x for i in full for x in (pad, texts[i])]
        a = np.concatenate(parts)
        logp, inverse = self.char_logp(a)
        ends = np.cumsum([len(pad) + len(texts[i]) for i in full])
        starts = np.append(0, ends[:-1])
        lengths = np.array([len(texts[i]) for i in full])
        weight = np.zeros(len(inverse) + 1, np.float64)
        for k in range(len(self.languages)):
            weight[1:] = np.cumsum(logp[inverse, k], dtype=np.float64)
            out[full, k] = -(weight[starts + lengths] - weight[starts]) / lengths
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool], list[float | None]]:
        """Language, score (0 to 1), rejected, and the best cross-entropy of each text."""
        lang, score, rejected, best = [], [], [], []
        norm = [normal(t) for t in texts]
        h = self.cross_entropy(norm)
        for x, t in zip(h, norm, strict=True):
            if not len(t) or not self.languages:
                lang.append(UNKNOWN), score.append(0.0), rejected.append(True), best.append(None)
                continue
            k = int(np.argmin(x))
            share = np.exp2(np.maximum(-(x - x[k]) * min(len(t), 200), -60.0))
            bound = self.mean[k] + DEVIATIONS * self.spread[k] * (1 + 10 / math.sqrt(len(t))) + SLACK + 12 / len(t)
            fit = 1.0 / (1.0 + math.exp(min(50.0, 4 * (x[k] - bound))))
            lang.append(self.languages[k]), score.append(float(fit / share.sum())), rejected.append(bool(x[k] > bound)), best.append(float(x[k]))
        return lang, score, rejected, best


def gram_hashes_at(a: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(at), np.uint64)
    for i in range(n):
        out = out * _BASE + (a[at + i].astype(np.uint64) + np.uint64(1))
    return mix(out)


def estimate(counts: dict[str, dict[str, int]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from the counts of order-grams of each language. Lower orders count distinct continuations."""
    languages = sorted(counts)
    per: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order)]
    backs: list[dict[str, tuple[np.ndarray, np.ndarray]]] = [{} for _ in range(order)]
    for lang in languages:
        level = counts[lang]
        levels = [level]
        for _ in range(order - 1):  # n(. gram): distinct characters before it
            lower: dict[str, int] = {}
            for g in levels[-1]:
                lower[g[1:]] = lower.get(g[1:], 0) + 1
            levels.append(lower)
        levels.reverse()  # levels[n-1]: grams of n characters
        prob: dict[str, float] = {}
        for n in range(1, order + 1):
            c = levels[n - 1]
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            context: dict[str, list[float]] = {}
            for g, v in c.items():
                x = context.setdefault(g[:-1], [0.0, 0.0])
                x[0] += v
                x[1] += 1
            weight = {g: d * t / s for g, (s, t) in context.items()}
            if n == 1:
                base = 1.0 / (len(c) + 200)  # the rest of an alphabet of 200 more characters
                new = {g: max(v - d, 0) / context[""][0] + weight[""] * base for g, v in c.items()}
            else:
                new = {g: max(v - d, 0) / context[g[:-1]][0] + weight[g[:-1]] * prob[g[1:]] for g, v in c.items()}
                backs[n - 2][lang] = _packed(weight, n - 1)
            per[n - 1][lang] = _packed(new, n)
            prob = new
    model = Model(languages, order)
    for n in range(order):
        keys = np.unique(np.concatenate([np.empty(0, np.uint64), *(x[0] for t in (per[n], backs[n]) for x in t.values())]))
        logp = np.full((len(keys), len(languages)), np.nan, np.float32)
        back = np.zeros((len(keys), len(languages)), np.float32)
        for k, lang in enumerate(languages):
            h, v = per[n][lang]
            logp[np.searchsorted(keys, h), k] = v
            if lang in backs[n]:
                h, v = backs[n][lang]
                back[np.searchsorted(keys, h), k] = v
        model.keys.append(keys), model.logp.append(logp), model.back.append(back)
    return model


def _packed(values: dict[str, float], n: int) -> tuple[np.ndarray, np.ndarray]:
    grams = list(values)
    a = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = gram_hashes_at(a, np.arange(len(grams)) * n, n)
    return h, np.log2(np.array([values[g] for g in grams], np.float64)).astype(np.float32)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, order: int = ORDER) -> Model:
    """The model of labelled rows. Counts of the sample are added up on the executors; the driver gets the grams of the
    sample (bounded by it) and the calibration figures."""
    small_batches(rows.sparkSession)
    x = rows.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null").where(F.col("text").rlike(r"\p{L}"))
    h = F.xxhash64("text")
    many = x.groupBy("lang").agg(F.approx_count_distinct(h, 0.02).alias("many"))
    many = written(many, "language-counts")
    if many.count() <= LANGUAGES:
        many = F.broadcast(many)
    # the hash of the text draws the sample: copies of one text come together, and count once
    drawn = x.join(many, "lang").where(F.pmod(h, F.lit(1_000_003)) * F.col("many") < F.lit(1_000_003) * F.lit(sample)).select("lang", "text").dropDuplicates()
    # of a language's texts in the order of their hashes the last are for calibration, but never all
    own = Window.partitionBy("lang")
    rank, size = F.row_number().over(own.orderBy(h, "text")), F.count(F.lit(1)).over(own)
    x = drawn.withColumn("counted", rank <= F.greatest(F.lit(1), F.ceil(size * (1 - CALIBRATION))))
    x = written(x, "language-sample")
    if x.isEmpty():
        return Model([], order)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], int] = {}
        for b in batches:
            for t, g, u in zip(strings(b.column("text")), b.column("lang").to_pylist(), b.column("counted").to_pylist(), strict=True):
                if u:
                    a = normal(t)
                    if len(a):
                        s = " " * (order - 1) + a.tobytes().decode("utf-32-le", "surrogatepass")
                        for i in range(len(a)):
                            k = (g, s[i : i + order])
                            held[k] = held.get(k, 0) + 1
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in held], pa.string()), "gram": pa.array([k[1] for k in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})

    counts: dict[str, dict[str, int]] = {}
    table = x.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    for g, t, n in zip(table["lang"], table["gram"], table["n"], strict=True):
        counts.setdefault(g, {})[t] = int(n)
    if not counts:
        return Model([], order)
    model = estimate(counts, order)
    model.mean, model.spread = np.full(len(model.languages), np.inf), np.ones(len(model.languages))
    shared = _Shipped(model)

    def calibrate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            h = m.cross_entropy([normal(t) for t in strings(b.column("text"))])
            keep = [(g, float(v[m.languages.index(g)])) for g, v in zip(b.column("lang").to_pylist(), h, strict=True) if g in m.languages]
            keep = [k for k in keep if not math.isnan(k[1])]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keep], pa.string()), "h": pa.array([k[1] for k in keep], pa.float64())})

    for r in x.where(~F.col("counted")).mapInArrow(calibrate, "lang string, h double").groupBy("lang").agg(F.percentile("h", 0.5).alias("m"), (F.percentile("h", 0.9) - F.percentile("h", 0.1)).alias("s")).collect():
        k = model.languages.index(r["lang"])
        model.mean[k], model.spread[k] = r["m"], max(0.02, r["s"] / 2.563)
    return model


class _Shipped:
    """A model that goes to the workers with the task."""

    def __init__(self, value: Model):
        self.value = value


def identify(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """df with a struct column: lang, score, rejected, cross_entropy. A column with the name of the output is replaced."""
    spark = df.sparkSession
    small_batches(spark)
    keep = [c for c in df.columns if c.lower() != out.lower()]
    df = df.select(*keep, *([] if text in keep else [F.col(text)]))
    schema = df.select(*keep).withColumn(out, F.lit(None).cast("struct<lang:string,score:double,rejected:boolean,cross_entropy:double>")).schema
    shipped = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shipped.value
        for b in batches:
            texts = strings(b.column(text))
            parts: list[list] = [[], [], [], []]
            for i, j in groups([len(t) for t in texts]):
                for p, x in zip(parts, m.predict(texts[i:j]), strict=True):
                    p += x
            column = pa.StructArray.from_arrays([pa.array(p, t) for p, t in zip(parts, (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)], names=["lang", "score", "rejected", "cross_entropy"])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), column], names=[*keep, out])

    return df.mapInArrow(run, schema)


def keep_identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose language is not rejected, with the columns of df."""
    name = fresh(df, "_language")[0]
    return identify(df, model, text, name).where(~F.col(name)["rejected"]).select(*df.columns)
