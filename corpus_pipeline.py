"""A corpus pipeline over documents, in stages that each call one operator of foldscape.llm.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but
the last return the columns of documents, COLUMNS, and no others.

Defined results: a null text is an empty one for every judgement and stays null until it is
packed, as the end id alone; documents without words are never toxic beyond the model's
score for nothing, near duplicates or contaminated; of rows with the same id and a text
with words one stays, those without words all stay; null ids, languages, sources and n_chars pass through (n_chars follows the masked
text); an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldscape.llm.common import kept
from foldscape.llm.decontaminate import decontaminate
from foldscape.llm.encode import tokenizer_path
from foldscape.llm.ngram_join import drop_near_duplicates
from foldscape.llm.packing import pack
from foldscape.llm.secrets import redact_secrets
from foldscape.llm.toxicity import fit_toxicity, score_toxicity
from foldscape.storage import dropped, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on the labelled ones, calls toxic go."""
    docs = docs.select(*COLUMNS)
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, a similarity of 0.8."""
    return drop_near_duplicates(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more are benchmark passages go."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Findings in texts are masked; n_chars follows."""
    return redact_secrets(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: No stage but joins and counts can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage needed beside its result is deleted behind it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:  # not run yet: what it needs stays
            return stage(spark, docs, sf_dir)
        before = docs
        with scratch(spark) as made:
            docs = kept(stage(spark, before, sf_dir), name)
            made.keep(docs)
        if k:
            dropped(before)
    return docs
