"""A training corpus from the ``documents`` table, in five stages.

Each stage works on all rows that its predecessor kept, and all but the last give the columns of ``documents``:
language identification (rejected documents go, ``lang`` becomes the language found), near duplicates (one document of
each group stays), secrets (found values are replaced by their kind), the mix of sources (what the mix takes of each
document, once or twice), packing (pieces in sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import curve_packing, jaccard_join, language_spans, mixing, secret_grammar
from tallyforge.llm.common import crc32_of_id, table, written
from tallyforge.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    train = docs.where(crc32_of_id(F.col("doc_id")) % 3 != 1).select("doc_id", "text", "lang")
    return language_spans.accepted(docs, language_spans.fit(train))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_grammar.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curve_packing.packed(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", replace_secrets),
    ("mix", mix_sources),
    ("pack", pack),
]
#: Viterbi paths, inferred grammars and token ids can't be expressed in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
