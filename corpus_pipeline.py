"""From raw documents to a mixed, tokenised training corpus.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. run() writes each stage's rows to the shared folder and reads them back for the next one; what a stage wrote on
its way, and what it read, is deleted then.

- language: documents without a letter, or without evidence for any language learned from the labelled rows, go;
- near_dups: of each component of near copies one document stays, that of least doc_id;
- decontamination: documents that hold a benchmark item, within its number of edits, go;
- mixing: each document is repeated as its source's target asks;
- tokens: ids are written as bit planes and read back; one row per document kept and repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tomospark.llm import bitplanes, decontam, langid, mixing, similar
from tomospark.llm.common import drop_table, read, settled
from tomospark.shipping import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.keep_known(docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return similar.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bitplanes.digests(docs)


STAGES = [("language", language), ("near_dups", near_dups), ("decontamination", decontamination), ("mixing", mix), ("tokens", tokens)]

#: Learned filters, edit distances and a tokenizer aren't SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        if held is not None:
            drop_table(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
