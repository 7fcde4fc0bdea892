"""Quality rules (native): a threshold table compiled into one Spark projection, without user functions.

Words are `[^\\x20\\x09-\\x0D]+`. Every figure is computed within its row: nothing is shuffled, so neither hot sources nor
copies matter, and long texts cost in proportion to their words (repeated windows: n log n).

Defined cases: a null text has no words and fails; an empty text as well; repeated rows each get their verdict; an empty
table stays empty; other columns stay as they are, and one named like the output is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import computed_once, fresh

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that it on for was with as be by at are this from "
    "der die das und in zu den von mit ist des im nicht ein eine auf für sich dem als auch "
    "le la les de des du et un une en est que qui dans pour pas sur au par avec "
    "el los las del y en que por con para una su al es se no lo como"
).split()
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document fails where low <= measure <= high does not hold (None: no bound)."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: The base rules are those of the contract of op8; the others make the verdict of the method.
BASE_RULES = (Rule("too_short", "n_words", low=20), Rule("repeated_windows", "repeat_share", high=0.30))
RULES = (
    Rule("too_long", "n_words", high=1_000_000),
    Rule("word_length", "mean_word", low=2.0, high=15.0),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("repeated_lines", "dup_line_ratio", high=0.60),
    Rule("line_length", "words_per_line", low=1.5),
    Rule("shouting", "upper_ratio", high=0.50),
)


def counts(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """df with the counts under names that it does not have, and those names.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in 8-word windows that occur again, the first
    included), n_lines (lines with a word), n_stop_words, n_upper (upper-case letters).
    """
    tmp = dict(zip(("t", "words", "lines", "h1", "h2", "h4", "win", "rep"), fresh(df, "_t", "_words", "_lines", "_h1", "_h2", "_h4", "_win", "_rep"), strict=True))
    c = {k: F.col(v) for k, v in tmp.items()}
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_stop_words", "n_upper", "n_repeat_words")
    out = dict(zip(names, fresh(df, *(f"_{x}" for x in names)), strict=True))

    def paired(a: str, step: int) -> Column:
        return F.transform(F.col(a), lambda x, i: F.xxhash64(x, F.get(F.col(a), i + step)))

    df = df.withColumn(tmp["t"], F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumns({
        tmp["words"]: F.array_remove(F.split(c["t"], r"[ \t-\r]+", -1), ""),
        tmp["lines"]: F.filter(F.split(c["t"], "\n", -1), lambda x: x.rlike(r"[^ \t-\r]")),
        out["n_symbols"]: (F.length(c["t"]) - F.length(F.regexp_replace(c["t"], r"[#*$%&|<>]+", ""))).cast("long"),
        out["n_upper"]: (F.length(c["t"]) - F.length(F.regexp_replace(c["t"], r"\p{Lu}+", ""))).cast("long"),
    })
    df = df.withColumns({
        out["n_words"]: F.size(c["words"]).cast("long"),
        out["word_chars"]: F.length(F.array_join(c["words"], "")).cast("long"),
        out["n_lines"]: F.size(c["lines"]).cast("long"),
        out["n_dup_lines"]: (F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))).cast("long"),
        out["n_stop_words"]: F.size(F.filter(c["words"], lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long"),
        tmp["h1"]: F.transform(c["words"], lambda w: F.xxhash64(w)),
    })
    # Hashes of two, four and eight words: three passes whatever the window; windows that pass the end are cut off.
    df = df.withColumn(tmp["h2"], paired(tmp["h1"], 1)).withColumn(tmp["h4"], paired(tmp["h2"], 2))
    df = df.withColumn(tmp["win"], F.when(F.col(out["n_words"]) >= WINDOW, F.slice(paired(tmp["h4"], 4), F.lit(1), F.greatest(F.size(c["h4"]) - (WINDOW - 1), F.lit(0)))).otherwise(F.array().cast("array<long>")))
    # Only texts with some repeated window sort their windows; neighbours with one hash are repeats.
    df = df.withColumn(tmp["rep"], F.when(F.size(F.array_distinct(c["win"])) < F.size(c["win"]), F.sort_array(F.transform(c["win"], lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    df = df.withColumn(tmp["rep"], F.sort_array(F.transform(F.filter(c["rep"], lambda x, i: F.coalesce(x["h"] == F.get(c["rep"], i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(c["rep"], i + 1)["h"], F.lit(False))), lambda x: x["i"])))
    df = df.withColumn(out["n_repeat_words"], F.aggregate(F.transform(c["rep"], lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(c["rep"], i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x).cast("long"))
    return df.drop(*tmp.values()), out


def score(df: DataFrame, text: str = "text", out: str = "quality", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """df with a struct column `out`: the counts, base_failed, kept, and failed (the names of the rules it fails)."""
    columns = [c for c in df.columns if c.lower() != out.lower()]
    counted, names = counts(df, text)
    measured = fresh(counted, "_m")[0]
    counted = counted.withColumn(measured, F.struct(*(F.col(v).alias(k) for k, v in names.items())))
    field = lambda k: F.col(measured)[k]
    base_failed = (field("n_words") < 20) | (100 * field("n_repeat_words") > 30 * field("n_words"))

    def within(e: Column, rule: Rule) -> Column:
        ok = ([e >= rule.low] if rule.low is not None else []) + ([e <= rule.high] if rule.high is not None else [])
        return reduce(lambda a, b: a & b, ok)

    n, lines, chars = (F.greatest(field(k), F.lit(1)).cast("double") for k in ("n_words", "n_lines", "word_chars"))
    ratio = {
        "n_words": field("n_words").cast("double"), "mean_word": field("word_chars") / n, "symbol_ratio": field("n_symbols") / n, "stop_ratio": field("n_stop_words") / n,
        "dup_line_ratio": field("n_dup_lines") / lines, "words_per_line": field("n_words") / lines, "upper_ratio": field("n_upper") / chars,
    }
    failed = F.array_compact(F.array(F.when(field("n_words") < 20, "too_short"), F.when(100 * field("n_repeat_words") > 30 * field("n_words"), "repeated_windows"), *(F.when(~within(ratio[r.measure], r), r.name) for r in rules)))
    kept = reduce(lambda a, b: a & b, (within(ratio[r.measure], r) for r in rules), ~base_failed)
    return counted.select(*columns, computed_once(F.struct(*(field(k).alias(k) for k in names), base_failed.alias("base_failed"), kept.alias("kept"), failed.alias("failed"))).alias(out))


def keep(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows whose text passes every rule, with the columns of df."""
    name = fresh(df, "_quality")[0]
    return score(df, text, name, rules).where(F.col(name)["kept"]).select(*df.columns)
