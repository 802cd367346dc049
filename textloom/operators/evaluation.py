"""Evaluation sets as lines of JSON, reports, and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import aggregate_metrics, lift
from .retrieval import request_verdicts
from .updates import set_run_status  # noqa: F401 (transitions of runs)

# The keys of a case.
CASE = "id string, query string, user_id string, document_ids array<string>, relevant_chunk_ids array<string>, answerable boolean, reference_answer string, tags array<string>"
KEY_METRICS = (("hit", 5), ("recall", 5), ("mrr", 10), ("ndcg", 10), ("precision", 5), ("recall", 10))


def read_cases(lines: DataFrame) -> DataFrame:
    """case_id, query, user_id, document_ids, gold, answerable, reference_answer, tags from lines (value): blank ones and those
    that begin with # are skipped, keys that aren't known ignored, and missing ones have their defaults."""
    kept = lines.filter((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    x = kept.select(F.from_json("value", CASE).alias("c"))
    many = lambda c: F.coalesce(f"c.{c}", F.array().cast("array<string>"))
    return x.select(
        F.col("c.id").alias("case_id"),
        F.col("c.query").alias("query"),
        F.col("c.user_id").alias("user_id"),
        many("document_ids").alias("document_ids"),
        many("relevant_chunk_ids").alias("gold"),
        F.coalesce("c.answerable", F.lit(True)).alias("answerable"),
        F.coalesce("c.reference_answer", F.lit("")).alias("reference_answer"),
        many("tags").alias("tags"),
    )


def case_lines(cases: DataFrame) -> DataFrame:
    """value: each case as a line of JSON, its gold ids sorted."""
    return cases.select(F.to_json(F.struct(F.col("case_id").alias("id"), "query", "user_id", "document_ids", F.array_sort("gold").alias("relevant_chunk_ids"), "answerable", "reference_answer", "tags")).alias("value"))


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    return read_cases(spark.read.text(path))


def save_cases(cases: DataFrame, path: str) -> None:
    case_lines(cases).write.mode("overwrite").text(path)


def stage_report(aggregated: DataFrame, stages: list[str]) -> DataFrame:
    """metric, k and the mean of each stage (a column each) for KEY_METRICS; a missing one is null."""
    wanted = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k")) for m, k in KEY_METRICS])
    rows = aggregated.filter(F.array_contains(wanted, F.struct("metric", "k")))
    return rows.groupBy("metric", "k").pivot("stage", stages).agg(F.first("mean"))


def lifts(aggregated: DataFrame) -> DataFrame:
    """metric, k, step, lift: what fusion adds to vectors alone, and reranking to its input."""
    fusion = lift(aggregated, "vector", "fused").withColumn("step", F.lit("fusion"))
    return fusion.unionByName(lift(aggregated, "rerank_input", "post_rerank").withColumn("step", F.lit("rerank")))


def failures(metrics: DataFrame, stage: str, k: int = 5) -> DataFrame:
    """case_id of the cases with gold of which none is among the first k."""
    return metrics.filter((F.col("stage") == stage) & (F.col("k") == k) & (F.col("hit") == 0)).select("case_id")


def report_json(metrics: DataFrame) -> DataFrame:
    """case_id, report: each case's metrics as JSON, in the order of stage, k."""
    one = F.struct("stage", "k", "hit", "recall")
    return metrics.groupBy("case_id").agg(F.to_json(F.array_sort(F.collect_list(one))).alias("report"))


def run_cases(cases: DataFrame, retriever, chunks: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Long ranked lists (case_id, stage, rank, chunk_id, score) of the cases that can be run, and case_id, reason of those that can't.

    A case with a bad request (no text, one that is too long, too many documents) or, for scoped searches, without an owner is
    dropped from the run and named; it doesn't fail the others.
    """
    given = ["embedding"] if "embedding" in cases.columns else []
    asked = cases.select("case_id", F.col("query").alias("text"), "user_id", "document_ids", *given).withColumn("top_k", F.lit(retriever.config.top_k))
    told = request_verdicts(asked)
    if documents is not None:
        told = told.withColumn("verdict", F.when((F.col("verdict") == "ok") & F.col("user_id").isNull(), "no owner").otherwise(F.col("verdict")))
    good = told.filter("verdict = 'ok'").select(F.col("case_id").alias("query_id"), "text", "user_id", "document_ids", *given)
    return retriever.stages(good, chunks, documents), told.filter("verdict != 'ok'").select("case_id", F.col("verdict").alias("reason"))


def _packed(key: str, value) -> Column:
    """A map of a group's keys (each once) and values, in order of keys."""
    entries = F.collect_list(F.struct(F.col(key).alias("key"), value.alias("value")))
    return F.map_from_entries(F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).otherwise(1)))


def case_reports(cases: DataFrame, ranked: DataFrame, metrics: DataFrame) -> DataFrame:
    """case_id, report: one JSON object for each case that was run: query, answerable, its chunks and its metrics by stage.

    Lists are as long as a stage's ranking, which the configuration bounds. Metrics are given for answerable cases only.
    """
    lists = ranked.groupBy("case_id", "stage").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("r"))
    lists = lists.groupBy("case_id").agg(_packed("stage", F.col("r.chunk_id")).alias("stage_chunks"))
    names = ["hit", "precision", "recall", "mrr", "ndcg"]
    known = metrics.join(cases.filter("answerable").select("case_id"), "case_id", "left_semi").unpivot(["case_id", "stage", "k"], names, "metric", "value").filter("value is not null")
    known = known.withColumn("name", F.concat_ws("@", "metric", F.col("k").cast("string")))
    by_stage = known.groupBy("case_id", "stage").agg(_packed("name", F.round("value", 6)).alias("m"))
    by_case = by_stage.groupBy("case_id").agg(_packed("stage", F.col("m")).alias("metrics"))
    out = cases.select("case_id", "query", "answerable").join(lists, "case_id").join(by_case, "case_id", "left_outer")
    return out.select("case_id", F.to_json(F.struct("case_id", "query", "answerable", "stage_chunks", "metrics")).alias("report"))


def summary_report(cases: DataFrame, metrics: DataFrame, dropped: DataFrame, latency: DataFrame | None = None) -> DataFrame:
    """report: one JSON object: numbers of cases, the mean of each stage's metrics over answerable cases, what was dropped, and latencies.

    latency: stage, mean, p50, p95, most. One row of fixed size: stages x metrics x k, and reasons.
    """
    answerable = metrics.join(cases.filter("answerable").select("case_id"), "case_id", "left_semi")
    means = aggregate_metrics(answerable).withColumn("name", F.concat_ws("@", "metric", F.col("k").cast("string")))
    by_stage = means.groupBy("stage").agg(_packed("name", F.col("mean")).alias("m"))
    parts = [
        cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count_if("answerable").alias("n_answerable")),
        by_stage.agg(_packed("stage", F.col("m")).alias("aggregate")),
        dropped.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).agg(_packed("reason", F.col("n")).alias("dropped")),
    ]
    if latency is not None:
        parts.append(latency.agg(_packed("stage", F.struct("mean", "p50", "p95", "most")).alias("latency")))
    one = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        one = one.join(part.withColumn("_one", F.lit(1)), "_one")
    return one.select(F.to_json(F.struct(*[c for c in one.columns if c != "_one"])).alias("report"))


def save_report(cases: DataFrame, summary: DataFrame, path: str) -> None:
    """Writes the cases' reports (one line of JSON each) and the summary beside each other."""
    cases.select("report").write.mode("overwrite").text(f"{path}/cases")
    summary.select("report").coalesce(1).write.mode("overwrite").text(f"{path}/summary")
