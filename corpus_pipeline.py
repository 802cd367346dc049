"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, SentencePiece.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; a runner writes it as
Parquet and hands what it reads back to the next stage. All but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, near_dup, quality_rules, sentencepiece_codec
from textloom.llm.queries import piece_model
from textloom.llm.shared_store import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts fail, repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeats of runs of lines.

    Documents of which no line is left go, and so do those without a line (null or empty texts). Of repeated rows the first stays.
    """
    edited = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in edited] or [F.lit(0)]
    done = line_dedup.dedup_lines(docs.select(F.struct(*rest).alias("rest"), *edited)).filter("n_removed_lines < n_lines")
    return done.select(*[F.col(c) if c in edited else F.col("rest").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; a text without words is a class of its own."""
    return near_dup.keep_one_of_each(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts have none and stay, repeated rows are treated alike."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids and the text that these decode to; null texts have no ids and decode to ""."""
    return sentencepiece_codec.encode_decode(docs, piece_model())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmarks),
    ("sentencepiece", tokens),
]

#: Signatures and byte-pair encoding have no SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored in the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(spark, docs)
    return docs
