"""The registered queries of the text operators: each applies one operator, with production parameters, to a whole
table and derives the columns of its contract. ``QUERIES`` and ``ORACLE_SQL`` are what the entry module adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, html_extract, langid, line_dedup, media, mixing, packing, pii, quality_clf, quality_rules, simhash


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _learnable(docs: DataFrame) -> DataFrame:
    """Rows outside the held-out fold; a row with a null id is not learned from."""
    return docs.where(common.fold("doc_id") != 2)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(_learnable(docs))
    return langid.predict(docs, model).select("doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), "text")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(_read(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_read(spark, sf_dir, "documents"), shingle=3, bits=3)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_read(spark, sf_dir, "documents")).taken()


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality_clf.train(_learnable(docs), _read(spark, sf_dir, "labels"))
    score = F.col("score")
    return quality_clf.score(docs, model).select("doc_id", common.held_out("doc_id").alias("held_out"), score, (score >= 0.7).cast("int").alias("predicted"))


def tokenizer_path() -> str:
    """Path of the vocabulary file that the packing query uses; the file comes with an installed package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path(), size=2048, end_id=1)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_read(spark, sf_dir, "documents")).withColumn("points", F.to_json("points"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_line_dedup": op2_line_dedup,
    "op3_personal_data": op3_personal_data,
    "op4_html_extraction": op4_html_extraction,
    "op5_simhash": op5_simhash,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op2_line_dedup": line_dedup.ORACLE_SQL,
}
