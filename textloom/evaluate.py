"""Evaluation from the command line: python -m textloom.evaluate --cases set.jsonl --tables folder --out folder."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.config import RetrievalConfig
from textloom.operators import evaluation, metrics, structure
from textloom.plans.hybrid import HybridRetriever
from textloom.sources import tables as src
from textloom.sources.shared import stored


def evaluate(spark: SparkSession, cases_path: str, tables: str, out: str, embedder: str, config: RetrievalConfig) -> dict:
    """Runs all cases of a JSONL set against the chunks of a folder of tables, writes the reports and gives the summary.

    Chunks are embedded by the embedder that embeds the queries. Gold ids are chunk ids.
    """
    cases = evaluation.load_cases(spark, cases_path)
    cases = stored(spark, cases.withColumn("case_id", F.col("case_id").cast("bigint")))
    chunks = src.vector_chunks(spark, tables).drop("embedding")
    vectors = structure.embedder(embedder)(chunks.select("chunk_id", "text"), "chunk_id", "text")
    chunks = stored(spark, chunks.join(vectors, "chunk_id"))
    began = time.time()
    ranked, dropped = evaluation.run_cases(cases, HybridRetriever(config, embedder), chunks)
    ranked = stored(spark, ranked)
    took = spark.createDataFrame([("all", (time.time() - began) * 1000)], "stage string, ms double")
    gold = cases.select("case_id", F.explode("gold").alias("chunk_id")).select("case_id", F.col("chunk_id").cast("bigint").alias("chunk_id"))
    found = stored(spark, metrics.rank_metrics(ranked, gold))
    summary = stored(spark, evaluation.summary_report(cases, found, dropped, metrics.latency_stats(took, "stage", "ms")))
    evaluation.save_report(evaluation.case_reports(cases, ranked, found), summary, out)
    return json.loads(summary.first().report)


def main(given: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Evaluates retrieval on a set of cases.")
    parser.add_argument("--cases", required=True, help="lines of JSON, one case each")
    parser.add_argument("--tables", required=True, help="folder of the Parquet tables")
    parser.add_argument("--out", required=True, help="folder of the reports")
    parser.add_argument("--embedder", default="hashing-64")
    parser.add_argument("--top-k", type=int, default=RetrievalConfig.top_k)
    args = parser.parse_args(given)
    spark = SparkSession.builder.getOrCreate()
    summary = evaluate(spark, args.cases, args.tables, args.out, args.embedder, RetrievalConfig(top_k=args.top_k))
    if not summary["n_cases"]:
        print("no cases", file=sys.stderr)
        return 1
    print(json.dumps(summary, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
