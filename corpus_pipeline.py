"""A training-data pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
what a stage returns as Parquet to the folder that the cluster shares and the
next stage reads it, so that a lost executor never costs more than a stage.
As the application, it sets the bytes that a Python worker gets at once.

Defined cases, for every stage: a null text counts as an empty one; null and
repeated ids stay, a repeated row is a row of its own; columns besides doc_id,
text and source are carried along, whatever their names; an empty table gives
an empty one. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakframe.llm import decontam, jaccard, kit, mixing, quality, queries, tokens


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go; an empty text has under 20 words and goes; equal rows go or stay together."""
    kit.bounded(spark)
    return quality.keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    kit.bounded(spark)
    return jaccard.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, empty ones stay; an empty benchmark leaves all."""
    kit.bounded(spark)
    return decontam.clean(docs, kit.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights; a document taken twice stands twice; a null source is a source, the last in order."""
    kit.bounded(spark)
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token files are written and read back: doc_id, start, n_tokens, ids_crc32 of every document of the mix."""
    kit.bounded(spark)
    return tokens.read(tokens.write(docs, queries.tokenizer_path(), queries.END_ID, kit.scratch(spark, keep=True)))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: Compression, sampled sums and token ids are beyond SQL; tests/llm/ holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, where = kit.table(spark, sf_dir, "documents"), kit.scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = kit.stored(stage(spark, docs, sf_dir), f"{where}/{k}_{name}")
    return docs
