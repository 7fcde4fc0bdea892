"""Token counts: whole-token shortcut.

Offline, on the driver, every string of the vocabulary is encoded alone; those that give exactly one token are proven whole
tokens. They go to the workers with the task (a table no larger than the vocabulary). A text is cut into the runs that its
tokenizer treats one by one; runs that are proven whole tokens count as one directly, and only the rest is merged by the
library, each distinct run once while it is remembered.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows each get their count; an empty table gives an
empty result; other columns stay. Work is row by row: no shuffle, memory bounded by a batch of rows plus the memo.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chunks import Memo, Runs, byte_alphabet, ids_of, load, mode
from ._common import groups, small_batches, strings

_STATE: dict = {}


def whole_tokens(path: str) -> frozenset[str]:
    """Texts of vocabulary strings that, encoded alone, are one token."""
    tok = load(path)
    found: set[str] = set()
    suffix = getattr(tok.model, "end_of_word_suffix", None) or ""
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    texts = []
    for s in tok.get_vocab(with_added_tokens=False):
        if suffix and not s.endswith(suffix):
            continue
        s = s[: len(s) - len(suffix)] if suffix else s
        try:
            texts.append(bytes(byte_of[c] for c in s).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    for t, ids in zip(texts, ids_of(tok, texts), strict=True):
        if len(ids) == 1 and t:
            found.add(t)
    return frozenset(found)


def _counter(path: str, whole: frozenset[str]):
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)] if texts else []
    tok, how = load(path), mode(path)
    ids = Runs(tok, how, path)
    memo = Memo(dict.fromkeys(whole, 1) | {"": 0} if how == "dropped" else {}, lambda runs: [len(x) for x in ids(runs)])
    return lambda texts: [sum(v) for v in memo.by_text(texts, how)] if how != "whole" else [len(x) for x in ids_of(tok, texts)]


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048, names: tuple[str, str, str] = ("n_bytes", "n_tokens", "over_limit"), vocabulary: str | None = None) -> DataFrame:
    """df with the bytes of the text in UTF-8, its tokens, and whether these are more than limit.

    path: a .json of tokenizers or a .model of sentencepiece, at the same place on every machine. Columns of df with one of
    the three names are replaced.
    """
    small_batches(df.sparkSession)
    whole = whole_tokens(path) if path.endswith(".json") else frozenset()
    keep = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    df = df.select(*keep, *([] if text in keep else [F.col(text)]))
    schema = df.select(*keep).withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.lit(0).cast("long"), names[2]: F.lit(False)}).schema
    key = (path, len(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _STATE:
            _STATE.clear()
            _STATE[key] = _counter(path, whole)
        count = _STATE[key]
        for b in batches:
            texts = strings(b.column(text))
            sizes = [len(t) if t.isascii() else len(t.encode("utf-8", "surrogatepass")) for t in texts]
            n: list[int] = []
            for i, j in groups(sizes):
                n += count(texts[i:j])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[*keep, *names])

    return df.mapInArrow(run, schema)
