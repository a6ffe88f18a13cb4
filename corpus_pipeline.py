"""From documents to packed training sequences: each stage reads what the one before it kept.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents, other columns that these have included, of whatever name. Null texts are empty from the line stage on. A
text alone decides whether the first stage keeps a row; the later stages keep every row whose doc_id is null. Rows that repeat are judged each, and where a doc_id
repeats near_duplicates and decontamination decide for all its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import read, save
from tracewell.llm.decontam import leaks
from tracewell.llm.jaccard_join import jaccard_components
from tracewell.llm.line_dedup import drop_lines
from tracewell.llm.packing import pack
from tracewell.llm.toxicity import score, train

TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score TOXIC or more go."""
    model, name = train(docs, read(spark, sf_dir, "labels")), "toxicity"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return score(docs, model, name).where(F.col(name) < TOXIC).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents repeat stay in one of them; n_chars follows the text."""
    kept = drop_lines(docs, counts=False)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that of the smallest doc_id stays."""
    others = jaccard_components(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = save(leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return pack(docs).drop("certified")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]
#: SQL can't express the first stage's model, the retrieval or the packing; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
