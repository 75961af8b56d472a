"""A cleaning pipeline over ``documents``: each stage keeps, trims or encodes what the last one left."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm.line_dedup import without_repeated_lines
from waymark.llm.mixing import PIPELINE_TARGETS, draw
from waymark.llm.ngram_join import without_near_copies
from waymark.llm.piece_transducer import encode_documents
from waymark.llm.toxicity import without_toxic
from waymark.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.3."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line resembles at 80 % of its words; n_chars follows the text."""
    trimmed = without_repeated_lines(docs, num=4, den=5)
    return trimmed.selectExpr(*[f"length(text) as {c}" if c == "n_chars" else f"`{c}`" for c in trimmed.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at 80 % of their five-word shingles."""
    return without_near_copies(docs, size=5, num=4, den=5)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and kinds of text have their target shares."""
    return draw(docs, PIPELINE_TARGETS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text decoded from them."""
    encoded = encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), name="ids", decoded="decoded")
    return encoded.select("doc_id", "lang", "source", "ids", "decoded")


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", pieces),
]

#: The first and the last stage have no SQL form: the tests hold the first to held-out accuracy, the last to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
