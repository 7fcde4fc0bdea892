"""License scans (native): a positional rare-token index, in DataFrame functions only.

Each template is a notice with a mandatory key phrase. The index holds, for each template, the RARE words of the phrase with
the highest inverse document frequency over all templates, with their places. The words of a file that the index holds are
looked up; postings of one template that agree on where the phrase would begin are an alignment; an alignment that has all
its rare words is verified against the whole phrase. The phrases of the contract are templates like the others, so every place
where one stands is found (it has all rare words at their places) and nothing else is (the phrase is verified).

All of it is computed within the row: no shuffle, so copies and hot sources cost nothing extra; a text full of licence words
costs the sorting of its alignments.

Defined cases: a null text has no words and no labels; repeated rows each get their result; an empty table stays empty; other
columns stay, and one named like the output is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import computed_once, fresh

RARE = 2
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def key(self) -> list[str]:
        return self.phrase.split()

    @property
    def before(self) -> int:
        """Words of the notice before its phrase."""
        w, k = self.words, self.key
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "released under the terms of the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    Template("apache-2", "licensed under the apache license version 2 0", "the apache license version 2"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl-3", "licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    Template("lgpl-2.1", "licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    Template("mpl-2", "licensed under the mozilla public license version 2 0", "mozilla public license version 2"),
    Template("epl-2", "made available under the eclipse public license 2 0", "eclipse public license 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsd", "released under the bsd license", "the bsd license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0"),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international", "commons attribution noncommercial"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international", "commons attribution sharealike"),
)


def rare_words(templates: tuple[Template, ...] = TEMPLATES) -> list[list[tuple[str, int]]]:
    """For each template the RARE words of its phrase with the highest inverse document frequency, and their places."""
    n = len(templates)
    idf = {w: math.log(n / sum(w in t.words for t in templates)) for t in templates for w in t.words}
    out = []
    for t in templates:
        first = {w: t.key.index(w) for w in t.key}
        out.append([(w, first[w]) for w in sorted(first, key=lambda w: (-idf[w], first[w]))[:RARE]])
    return out


_SHIFT = 1 << 40


def scan(df: DataFrame, text: str = "text", out: str = "licenses", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """df with a struct column: n_words, n_base (places of base phrases), first_word and last_word (their smallest and largest
    start), base_labels, labels (arrays, distinct and sorted), score (the largest share of a notice's words that stand where a
    verified phrase puts them)."""
    keep = [c for c in df.columns if c.lower() != out.lower()]
    words, found, keys, hits = fresh(df, "_words", "_found", "_keys", "_hits")
    index: dict[str, list[tuple[int, int]]] = {}
    for t, rare in enumerate(rare_words(templates)):
        for w, q in rare:
            index.setdefault(w, []).append((t, q))
    # plain ASCII words compare in lower case; others (such as the Kelvin sign) are no licence words
    low = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w))
    strings = lambda xs: F.array(*(F.lit(x) for x in xs))
    postings = F.create_map(*(c for w, ps in index.items() for c in (F.lit(w), F.array(*(F.struct(F.lit(t).cast("long").alias("t"), F.lit(q).alias("q")) for t, q in ps)))))
    phrases, notices = F.array(*(strings(t.key) for t in templates)), F.array(*(strings(t.words) for t in templates))
    before = F.array(*(F.lit(t.before) for t in templates))
    labels, base = strings(t.label for t in templates), F.array(*(F.lit(t.base) for t in templates))
    sizes = F.array(*(F.lit(len(t.key)) for t in templates))

    x = df.select(*keep, *([] if text in keep else [F.col(text)]))
    x = x.withColumn(words, F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SEPARATORS, -1), ""))
    w = F.col(words)
    x = x.withColumn(found, F.exists(w, lambda v: low(v).isin(*index)))
    looked_up = F.flatten(F.transform(F.filter(F.transform(w, lambda v, i: F.struct(low(v).alias("w"), i.alias("i"))), lambda v: v["w"].isin(*index)), lambda v: F.transform(F.element_at(postings, v["w"]), lambda e: e["t"] * _SHIFT + (v["i"] - e["q"] + F.lit(1 << 20)).cast("long"))))
    x = x.withColumn(keys, F.when(F.col(found), F.sort_array(looked_up)).otherwise(F.array().cast("array<bigint>")))
    k = F.col(keys)
    begin = lambda v: (v % _SHIFT - (1 << 20)).cast("int")
    which = lambda v: (F.floor(v / F.lit(float(_SHIFT)))).cast("int")
    aligned = F.array_distinct(F.filter(k, lambda v, i: F.coalesce(v == F.get(k, i + (RARE - 1)), F.lit(False))))
    placed = F.transform(aligned, lambda v: F.struct(which(v).alias("t"), begin(v).alias("b")))
    stands = lambda p: F.transform(F.slice(w, p["b"] + 1, F.get(sizes, p["t"])), low) == F.get(phrases, p["t"])
    x = x.withColumn(hits, F.filter(placed, lambda p: F.when(p["b"] >= 0, F.coalesce(stands(p), F.lit(False))).otherwise(F.lit(False))))
    h = F.col(hits)
    of_base = F.filter(h, lambda p: F.get(base, p["t"]))
    share = F.transform(h, lambda p: F.size(F.filter(F.transform(F.get(notices, p["t"]), lambda v, i: F.coalesce(low(F.get(w, p["b"] - F.get(before, p["t"]) + i)) == v, F.lit(False))), lambda ok: ok)) / F.size(F.get(notices, p["t"])))
    name = lambda a: F.array_sort(F.array_distinct(F.transform(a, lambda p: F.get(labels, p["t"]))))
    starts = F.transform(of_base, lambda p: p["b"].cast("long"))
    result: Column = F.struct(
        F.size(w).cast("long").alias("n_words"), F.size(of_base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        name(of_base).alias("base_labels"), name(h).alias("labels"), F.coalesce(F.array_max(share), F.lit(0.0)).alias("score"),
    )
    return x.select(*keep, computed_once(result).alias(out))
