"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoframe.llm import containment, langid_ecoc, license_dice, mil_quality, quartile_digest, secret_scan, sentencepiece_fst, simhash_pigeonring, template_extract, warc_revisit
from lithoframe.llm.textarr import id_text_crc, table

#: Where the tokenizer's model stands; the file stays there.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of documents."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text of documents, learned from those whose crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    held = F.pmod(id_text_crc(F.col("doc_id")), F.lit(3)) == 1
    model = langid_ecoc.fit(docs.where(~held), "text", "lang", "doc_id")
    return langid_ecoc.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text of documents, learned from the labels of rows whose crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(F.pmod(id_text_crc(F.col("doc_id")), F.lit(5)) != 0)
    model = mil_quality.fit(docs, labels)
    held = F.pmod(id_text_crc(F.col("doc_id")), F.lit(5)) == 0
    return docs.select("doc_id", held.alias("held_out"), mil_quality.score(F.col("text"), model, spark).alias("score")).withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every whole text of documents, of its edited text, and their likeness."""
    return quartile_digest.with_edits(table(spark, sf_dir, "documents"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of documents, and a digest of what they decode to."""
    return sentencepiece_fst.tokenise(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in each whole text of documents."""
    return containment.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole text of documents."""
    return simhash_pigeonring.near_duplicates(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return template_extract.extract(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in every whole text of documents."""
    return license_dice.find_licenses(table(spark, sf_dir, "documents"), windows=True)


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not-modified revisits of every page, resolved."""
    return warc_revisit.resolved_pages(table(spark, sf_dir, "pages"))


def queries():
    return {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_revisits, op4_quartile_digest, op5_main_text, op6_contained_items, op7_secret_scan, op8_simhash, op9_quality, op10_license_scan,)}


def oracle_sql():
    return {"op3_revisits": warc_revisit.ORACLE, "op6_contained_items": containment.ORACLE, "op10_license_scan": license_dice.oracle()}
