"""From raw documents to token ids: five stages, each applied to all that the one before it kept.

quality (rejected documents go), near copies by SimHash and pigeonring, verified by five-word Jaccard (one document of each group stays), benchmark
decontamination (documents that hold a test item go), secrets (replaced in the text), SentencePiece ids.
A stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm import containment, mil_quality, near_copies, secret_scan, sentencepiece_fst
from lithoframe.llm.components import written
from lithoframe.llm.registry import TOKENIZER
from lithoframe.llm.textarr import small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mil_quality.good_documents(docs, mil_quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return containment.without_items(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    clean = docs.withColumn("text", secret_scan.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.tokenise(docs, TOKENIZER)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("token_ids", token_ids)]

#: SQL expresses neither the classifier nor the tokenizer; tests/llm/test_pipeline_plain.py compares with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
