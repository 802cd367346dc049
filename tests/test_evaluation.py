"""Evaluation runs: requests, dropped cases, reports, the command line, named embedders and rerankers."""

import json
import os

import pytest
from pyspark.sql import functions as F

from textloom import evaluate
from textloom.config import RetrievalConfig
from textloom.operators import evaluation, jobs, metrics, retrieval
from textloom.plans.hybrid import HybridRetriever
from textloom.sources.shared import new_path

DATA = "/root/testdata/sf0.001"
REQUEST = "text string, top_k int, document_ids array<string>"


def test_requests(spark):
    rows = [("a", None, None, "ok"), ("a", 30, ["x"] * 100, "ok"), ("a", 31, None, "top_k out of bounds"), ("a", 0, None, "top_k out of bounds"), ("  \n", 5, None, "empty query"), (None, 5, None, "empty query"), ("x" * 2000, 1, [], "ok"), ("x" * 2001, 99, None, "long query"), ("a", 1, ["x"] * 101, "too many documents")]
    df = spark.createDataFrame(rows, REQUEST + ", want string")
    assert retrieval.request_verdicts(df).filter("verdict != want").count() == 0


def test_latencies_with_outliers_ties_and_nulls(spark):
    groups = {"out": [1e12, *[k / 7 for k in range(2000)]], "same": [3.0] * 50, "one": [7.26], "two": [1.0, 2.0], "wide": [float(2**k) for k in range(60)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("out", None), ("none", None)]
    got = {r.g: (r.mean, r.p50, r.p95, r.most, r.n) for r in metrics.latency_stats(spark.createDataFrame(rows, "g string, v double").repartition(3), "g", "v").collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s, n = sorted(vs), len(vs)
        assert got[g][1:] == (pytest.approx(round((s[(n - 1) // 2] + s[n // 2]) / 2, 1)), pytest.approx(round(s[int(0.95 * n)], 1)), round(s[-1], 1), n)


def chunks_of(spark, n=24):
    rows = [(k, k // 4, k % 4, f"word{k} topic{k // 4} common text", 4, 1, None, f"u{k // 4 % 2}") for k in range(n)]
    return spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_index int, text string, token_count int, page_number int, section string, user_id string")


def test_cases_that_fail_are_named_and_dropped(spark):
    chunks = chunks_of(spark)
    vectors = evaluation_embedder(chunks)
    cases = spark.createDataFrame(
        [(1, "word5 topic1", None, [], True), (2, "", None, [], True), (3, "word9 topic2", None, [], False), (4, "x" * 2001, None, [], True), (5, None, None, [], True), (6, "word1", None, ["i"] * 101, True)],
        "case_id long, query string, user_id string, document_ids array<string>, answerable boolean",
    )
    retriever = HybridRetriever(RetrievalConfig(top_k=3), "hashing-64", prefix="")
    ranked, dropped = evaluation.run_cases(cases, retriever, vectors)
    assert {r.case_id: r.reason for r in dropped.collect()} == {2: "empty query", 4: "long query", 5: "empty query", 6: "too many documents"}
    assert {r.case_id for r in ranked.select("case_id").distinct().collect()} == {1, 3}
    gold = spark.createDataFrame([(1, 5), (3, 9)], "case_id long, chunk_id long")
    found = metrics.rank_metrics(ranked, gold)
    reports = {r.case_id: json.loads(r.report) for r in evaluation.case_reports(cases, ranked, found).collect()}
    assert set(reports) == {1, 3} and reports[1]["stage_chunks"]["fused"][0] == 5 and len(reports[1]["stage_chunks"]["selected"]) == 3
    assert reports[1]["metrics"]["fused"]["hit@1"] == 1.0 and "metrics" not in reports[3] and not reports[3]["answerable"]
    (one,) = evaluation.summary_report(cases, found, dropped, spark.createDataFrame([("all", 1.0, 2.0, 3.0, 4.0, 1)], "stage string, mean double, p50 double, p95 double, most double, n long")).collect()
    summary = json.loads(one.report)
    assert (summary["n_cases"], summary["n_answerable"], summary["dropped"]) == (6, 5, {"empty query": 2, "long query": 1, "too many documents": 1})
    assert summary["aggregate"]["fused"]["mrr@10"] == 1.0 and summary["latency"] == {"all": {"mean": 1.0, "p50": 2.0, "p95": 3.0, "most": 4.0}}
    none = evaluation.summary_report(cases.limit(0), found.limit(0), dropped.limit(0)).first().report
    assert json.loads(none)["n_cases"] == 0 and json.loads(none)["aggregate"] == {}


def evaluation_embedder(chunks):
    from textloom.operators import structure

    return chunks.join(structure.embedder("hashing-64")(chunks.select("chunk_id", "text"), "chunk_id", "text"), "chunk_id")


def test_named_embedders_and_rerankers(spark):
    chunks = evaluation_embedder(chunks_of(spark))
    queries = spark.createDataFrame([(1, "word7 topic1"), (2, None)], "query_id long, text string")
    with pytest.raises(ValueError, match="no embedder"):
        HybridRetriever().fused(queries, chunks)
    with pytest.raises(ValueError, match="no embedder 'x'"):
        HybridRetriever(embedder="x")
    with pytest.raises(ValueError, match="no reranker 'y'"):
        HybridRetriever(reranker="y")
    top = HybridRetriever(embedder="hashing-64").fused(queries, chunks).filter("fused_rank = 1 and query_id = 1").first()
    assert top.chunk_id == 7
    with pytest.raises(Exception, match="isn't of 256 numbers"):
        HybridRetriever(embedder="hashing-256").fused(queries, chunks).collect()
    retrieval.RERANKERS["backwards"] = lambda pairs: pairs.select("query_id", "chunk_id", (-F.col("chunk_id")).cast("double").alias("rerank_score"))
    try:
        pool = HybridRetriever(RetrievalConfig(rerank_enabled=True), "hashing-64", reranker="backwards").reranked(queries, chunks).filter("query_id = 1")
        assert [r.chunk_id for r in pool.orderBy("final_rank").collect()] == sorted(r.chunk_id for r in pool.collect())
    finally:
        del retrieval.RERANKERS["backwards"]


def test_command_line(spark, capsys):
    out, cases = new_path(spark), new_path(spark).removeprefix("file://")
    os.makedirs(os.path.dirname(cases), exist_ok=True)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 30 and length(text) < 1500").collect()}
    lines = ["# a comment", ""] + [json.dumps({"id": str(k), "query": " ".join(t.split()[:12]), "relevant_chunk_ids": [str(k)]}) for k, t in texts.items() if len(t.split()) > 12] + ['{"id": "900", "query": " "}']
    with open(cases, "w") as f:
        f.write("\n".join(lines))
    assert evaluate.main(["--cases", cases, "--tables", DATA, "--out", out, "--top-k", "4"]) == 0
    summary = json.loads(capsys.readouterr().out)
    assert summary["n_cases"] == len(lines) - 2 and summary["dropped"] == {"empty query": 1} and summary["aggregate"]["keyword"]["hit@20"] > 0.3
    assert json.loads(spark.read.text(f"{out}/summary").first()[0]) == summary
    assert spark.read.text(f"{out}/cases").count() == len(lines) - 3
    with open(cases, "w") as f:
        f.write("# nothing\n")
    assert evaluate.main(["--cases", cases, "--tables", DATA, "--out", out]) == 1


def test_job_reads_with_limits(spark):
    docs = spark.createDataFrame([(k, "pending", f"2024-01-01 00:00:{k:02d}") for k in range(40)], "document_id long, status string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    live = spark.createDataFrame([(3, "queued"), (5, "done")], "document_id long, status string")
    got = [r.document_id for r in jobs.pending_without_job(docs, live, "2024-01-01 00:00:40", limit=20).collect()]
    assert got == [k for k in range(28) if k != 3][:20]
    assert jobs.pending_without_job(docs, live).count() == 39
    old = docs.select("document_id", F.lit("processing").alias("status"), F.col("created_at").alias("updated_at"))
    assert [r.document_id for r in jobs.processing_since(old, "2024-01-01 00:00:10", 4).collect()] == [0, 1, 2, 3]
    done = spark.createDataFrame([(1, 1, "index", "done", None, '{"k":3}')], "job_id long, document_id long, stage string, status string, finished_at timestamp, details string")
    (r,) = jobs.reconcile(spark.createDataFrame([(1, "processing")], "document_id long, status string"), done, "2024-01-02 00:00:00").collect()
    assert f"{r.indexed_at}" == "2024-01-02 00:00:00" and r.chunk_count == 3
