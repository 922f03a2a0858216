"""A training corpus from ``documents``: language, repeated lines, near-duplicates, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. ``run`` writes what a stage returns as Parquet in the shared folder and reads it for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import common, langid, line_dedup, mixing, packing, simhash
from segmill.llm.queries import tokenizer_path

#: A document is rejected if the best language's share of belief is below this, or if it has no letters.
MIN_SCORE = 0.5


def _counted(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``, with n_chars (where it is one) that fits the text."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else c for c in names])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language go."""
    model = langid.train(docs.where(common.fold("doc_id") != 2))
    judged = langid.predict(docs, model, keep=tuple(docs.columns))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line dedup: lines that an earlier line equals, or nearly equals if they have 20 characters, go; every document
    stays."""
    return _counted(line_dedup.dedup(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: one document of each group stays."""
    return simhash.keep_one(docs, shingle=3, bits=3)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: what the mix takes of each document, once for each pass over its source."""
    return _counted(mixing.Mix(docs).mixed(), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing into sequences of at most 2048 tokens: a row for each piece."""
    return packing.pack(docs, tokenizer_path(), size=2048, end_id=1)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The stages hold trained models, hashes and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage{k}")
    return docs
