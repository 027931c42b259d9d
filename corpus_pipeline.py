"""A training corpus from raw documents: without toxic texts, near-duplicates, benchmark passages and personal data, packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written to the shared folder and read again as the docs
of the next one. All but the last return the columns of documents, whatever they are; a changed text has its n_chars set anew.

toxicity: documents with a score of 0.7 or more go. near_duplicates: of each group linked by a similarity of 0.8 or more of
their sets of five-word shingles the one with the least doc_id stays. decontamination: words inside any 10-word window of the
benchmark are cut out, documents of which more than half is hit go. pii: personal data are replaced by their kind in
brackets. packing: a row per piece of the sequences of 2048 tokens. Nulls, empty tables and repeated rows are treated as the
operators define it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamis.llm.common import materialise
from tamis.llm.decontaminate import decontaminate
from tamis.llm.near_dup import drop_near_duplicates
from tamis.llm.packing import pack
from tamis.llm.pii import redact
from tamis.llm.queries import remainder, tokenizer_path
from tamis.llm.tables import table
from tamis.llm.toxicity import fit_toxicity, score_toxicity

TOXIC = 0.7
#: SQL has neither the trained models nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").filter(remainder(3) != 1))
    return score_toxicity(docs, model, name="__toxicity").filter(F.col("__toxicity.score") < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(decontaminate(docs, table(spark, sf_dir, "benchmark"), 10))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recounted(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path(), 2048, 1).drop("ids")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
