"""The corpus pipeline: language ID, quality rules, n-gram Jaccard join, benchmark decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir), decides on every row that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of docs.

* language ID: rows whose language is rejected go (among them texts without a letter);
* quality rules: rows that fail a rule go;
* n-gram Jaccard join: of each class of near duplicates the first row stays;
* decontamination: rows that hold a ten-word window of the benchmark go;
* BPE: the token ids of each remaining text.

Part of the llm subpackage: it is absent where that is.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import bpe, decontaminate, language, ngram_join, quality
from tidelake.llm._common import written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labelled = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1)
    return language.keep_identified(docs, language.fit(labelled))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: A trained language model and near-duplicate classes over it are no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
