"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import common, decontamination, language_id, line_dedup, mixing, ngram_join

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay."""
    common.ship(spark)
    return language_id.keep_known(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that an earlier document has go; every document stays."""
    common.ship(spark)
    return line_dedup.line_dedup(docs).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles the one with the smallest doc_id stays."""
    common.ship(spark)
    return ngram_join.keep_one(docs)


def unseen_questions(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    common.ship(spark)
    return decontamination.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat as often as the target weights of their sources ask."""
    common.ship(spark)
    return mixing.mixed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("line dedup", fresh_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", unseen_questions),
    ("mixing sources to target weights", to_weights),
]
#: Hashing and fitted models can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes when the next one is written."""
    with common.Scratch(spark) as s:
        docs = common.table(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            before, docs = docs, s.table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
            s.drop(before)
        name, stage = STAGES[-1]
        return common.materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
