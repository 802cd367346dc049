import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.config import RetrievalConfig, content_room
from textloom.operators import metrics, passages, retrieval
from textloom.plans.hybrid import HybridRetriever

RANKED = "query_id bigint, chunk_id bigint, rank int, score double"


def test_fusion_sums_reciprocal_ranks(spark):
    v = spark.createDataFrame([(1, 10, 1, 0.9), (1, 11, 2, 0.8)], RANKED)
    k = spark.createDataFrame([(1, 11, 1, 0.5), (1, 12, 2, 0.4)], RANKED)
    got = {r.chunk_id: (r.fused, r.fused_rank) for r in retrieval.fuse(v, k).collect()}
    assert got[11][0] == pytest.approx(1 / 61 + 1 / 62)
    assert got[10][0] == pytest.approx(1 / 61)
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1][1])] == [11, 10, 12]


def test_fusion_weights_and_k(spark):
    v = spark.createDataFrame([(1, 10, 1, 0.9)], RANKED)
    none = spark.createDataFrame([], RANKED)
    assert retrieval.fuse(v, none, vector_weight=2).first().fused == pytest.approx(2 / 61)
    assert retrieval.fuse(none, v, k=10).first().fused == pytest.approx(1 / 11)


POOL = "query_id bigint, chunk_id bigint, position int, relevance double, embedding array<float>"


def picks(df, k, lam):
    return [r.chunk_id for r in retrieval.mmr(df, k, lam).orderBy("pick").collect()]


def test_mmr_prefers_what_is_different(spark):
    pool = spark.createDataFrame([(1, 1, 1, 0.9, [1.0, 0.0]), (1, 2, 2, 0.8, [1.0, 0.0]), (1, 3, 3, 0.1, [0.0, 1.0])], POOL)
    assert picks(pool, 2, 0.0) == [1, 3]
    assert picks(pool, 2, 1.0) == [1, 2]
    assert picks(pool, 5, 0.5) == [1, 2, 3]


def test_mmr_without_embedding_comes_last(spark):
    pool = spark.createDataFrame([(1, 1, 1, 0.9, None), (1, 2, 2, 0.8, [1.0, 0.0]), (1, 3, 3, 0.1, [0.0, 1.0]), (1, 4, 4, 0.0, [0.0, 0.0])], POOL)
    assert picks(pool, 3, 0.7)[:1] == [2] and 1 not in picks(pool, 3, 0.7)


def test_mmr_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=(20, 8)).astype(np.float32)
    rel = rng.random(20)
    pool = spark.createDataFrame([(1, i, i, float(rel[i]), e[i].tolist()) for i in range(20)], POOL)
    x = e.astype(float) / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    r = (rel - rel.min()) / (rel.max() - rel.min())
    left, chosen = list(range(20)), []
    while len(chosen) < 6:
        best = max(left, key=lambda i: (0.7 * r[i] - 0.3 * max([0.0, *(x[i] @ x[j] for j in chosen)]), -i))
        chosen.append(best)
        left.remove(best)
    assert picks(pool, 6, 0.7) == chosen


def members(spark, rows):
    df = spark.createDataFrame(rows, "query_id bigint, document_id bigint, chunk_index int, chunk_id bigint, tokens int, relevance double, `order` int")
    # chunk 0 of a document has no page and no section
    at = F.col("chunk_index")
    return df.withColumns({"page_number": F.when(at > 0, at + 10), "section": F.when(at > 0, F.concat(F.lit("s"), at.cast("string"))).otherwise("")})


def test_runs_split_at_gaps_and_reach_one_window(spark):
    rows = [(1, 7, 0, 100, 10, 0.9, 1), (1, 7, 1, 101, 10, None, None), (1, 7, 5, 105, 10, 0.5, 2)]
    got = [(r.lo, r.hi, r.score, r.tokens) for r in passages.runs(members(spark, rows), 1).orderBy("lo").collect()]
    assert got == [(0, 1, 0.9, 20), (5, 5, 0.5, 10)]


@pytest.mark.parametrize(
    "tokens, cap, expected",
    [((600, 600), 700, [(1, [100])]), ((900, 100), 1000, [(1, [100]), (2, [105])])],
)
def test_budget(spark, tokens, cap, expected):
    rows = [(1, 7, 0, 100, tokens[0], 0.9, 1), (1, 7, 5, 105, tokens[1], 0.5, 2)]
    got = passages.budgeted(passages.runs(members(spark, rows), 1), cap).orderBy("citation").collect()
    assert [(r.citation, r.chunk_ids) for r in got] == expected


def test_first_run_over_budget_is_cut_and_smaller_later_fits(spark):
    rows = [(1, 7, 0, 100, 1000, 0.9, 1), (1, 7, 1, 101, 1000, None, None), (1, 8, 0, 200, 900, 0.5, 2), (1, 9, 0, 300, 100, 0.4, 3)]
    got = passages.budgeted(passages.runs(members(spark, rows), 1), 1500).orderBy("citation").collect()
    assert [(r.document_id, r.chunk_ids, r.tokens) for r in got] == [(7, [100], 1000), (9, [300], 100)]


def test_render(spark):
    rows = [(1, 1, "Intro", 1, 1, "a"), (1, 2, None, 3, 7, "b"), (1, 3, "", None, None, "c")]
    df = spark.createDataFrame(rows, "query_id bigint, citation int, section string, page_start int, page_end int, text string")
    assert passages.render(df).first().context == "[1] Intro (p.1)\na\n\n---\n\n[2] (pp.3-7)\nb\n\n---\n\n[3] (n/a)\nc"


def test_rank_metrics(spark):
    ranked = spark.createDataFrame([(1, "s", 1, 10), (1, "s", 2, 11), (1, "s", 3, 12), (2, "s", 1, 10)], "case_id bigint, stage string, rank int, chunk_id bigint")
    gold = spark.createDataFrame([(1, 11), (1, 99)], "case_id bigint, chunk_id bigint")
    got = {(r.case_id, r.k): r for r in metrics.rank_metrics(ranked, gold, (1, 3)).collect()}
    assert (got[1, 1].hit, got[1, 1].mrr) == (0.0, 0.0)
    r = got[1, 3]
    assert (r.hit, r.precision, r.recall, r.mrr) == (1.0, pytest.approx(1 / 3), 0.5, 0.5)
    assert r.ndcg == pytest.approx((1 / np.log2(3)) / (1 + 1 / np.log2(3)))
    assert got[2, 3].hit is None and got[2, 3].ndcg is None


def test_p95_is_truncated_not_interpolated(spark):
    df = spark.range(1, 21).select(F.lit("a").alias("t"), F.col("id").cast("double").alias("v"))
    r = metrics.latency_stats(df, "t", "v").first()
    assert (r.p95, r.p50, r.most) == (20.0, 10.5, 20.0)


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        RetrievalConfig(vector_weight=0, keyword_weight=0)
    with pytest.raises(ValueError):
        RetrievalConfig(rerank_min_score=0.5)
    with pytest.raises(ValueError):
        RetrievalConfig(top_k=31)
    assert content_room(512) == 446
    with pytest.raises(ValueError):
        content_room(66)


def test_rerank_falls_back_when_a_score_is_missing(spark):
    pool = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1), (2, 11, 2)], "query_id bigint, chunk_id bigint, fused_rank int")
    scores = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.9), (2, 11, 0.9)], "query_id bigint, chunk_id bigint, rerank_score double")
    got = {(r.query_id, r.final_rank): (r.chunk_id, r.reranked) for r in retrieval.rerank(pool, scores).collect()}
    assert got[1, 1] == (11, True) and got[2, 1] == (10, False)


def test_pages_and_sections_of_a_passage(spark):
    rows = [(1, 7, 0, 100, 10, 0.9, 1), (1, 7, 1, 101, 10, None, None), (1, 7, 2, 102, 10, 0.8, 2), (1, 8, 0, 200, 10, 0.7, 3)]
    got = passages.budgeted(passages.runs(members(spark, rows), 1), 1000).orderBy("citation").collect()
    assert [(r.page_start, r.page_end, r.section) for r in got] == [(11, 12, "s1"), (None, None, None)]


CHUNKS = "chunk_id bigint, document_id bigint, chunk_index int, embedding array<float>, text string, token_count int, page_number int, section string"
DOCUMENTS = "document_id bigint, user_id string, status string"


def corpus(spark, n=60, size=6, seed=1):
    rng = np.random.default_rng(seed)
    e = rng.integers(-2, 3, size=(n, size)).astype(np.float32)  # many ties
    rows = [(i, i // 4, i % 4, e[i].tolist(), f"word{i % 5} word{i % 3}", 2, i, None) for i in range(n)]
    return e.astype(float), spark.createDataFrame(rows, CHUNKS)


def plain_topk(e, queries, k, allowed=lambda q, i: True):
    x = e / (np.linalg.norm(e, axis=1, keepdims=True) + 1e-12)
    sims = np.round(x @ x.T, 9)
    return {(q, i) for q in queries for i in sorted((i for i in range(len(e)) if allowed(q, i)), key=lambda i: (-sims[q, i], i))[:k]}


@pytest.mark.parametrize("tile, block", [(256, 4096), (2, 3)])
def test_vector_search_in_tiles_and_blocks(spark, monkeypatch, tile, block):
    e, chunks = corpus(spark)
    # whole numbers, so equal scores are equal in every order of adding
    monkeypatch.setattr(retrieval, "TILE", tile)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", block)
    asked = chunks.filter("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "embedding", "text")
    got = retrieval.vector_topk(asked, chunks.repartition(5), 4).collect()
    queries = list(range(0, 60, 7))
    assert len(got) == 4 * len(queries)
    x = e / (np.linalg.norm(e, axis=1, keepdims=True) + 1e-12)
    for q in queries:
        mine = sorted((r.rank, r.chunk_id) for r in got if r.query_id == q)
        assert np.allclose([x[q] @ x[i] for _, i in mine], sorted(x @ x[q], reverse=True)[:4])


def test_vectors_of_another_length_are_an_error(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, embedding array<float>")
    chunks = spark.createDataFrame([(1, [1.0]), (2, [0.0, 0.0, 1.0])], "chunk_id bigint, embedding array<float>")
    with pytest.raises(Exception, match="2 numbers"):
        retrieval.vector_topk(q, chunks, 1).collect()
    with pytest.raises(ValueError):
        retrieval.vector_topk(q.union(spark.createDataFrame([(2, [1.0])], q.schema)), chunks, 1)


def test_an_owner_finds_only_what_is_theirs_and_indexed(spark):
    e, chunks = corpus(spark)
    owner = lambda d: "ann" if d % 2 else "bob"
    documents = spark.createDataFrame([(d, owner(d), "pending" if d == 5 else "indexed") for d in range(15)], DOCUMENTS)
    asked = spark.createDataFrame([(0, e[0].tolist(), " word1\u00a0 word2\n", "ann", None), (1, e[1].tolist(), "word1", "bob", [2, 3, 4])], "query_id bigint, embedding array<float>, text string, user_id string, document_ids array<bigint>")
    r = HybridRetriever(RetrievalConfig(neighbor_window=0))
    found = {(x.query_id, x.chunk_id) for x in r.fused(asked, chunks, documents).collect()}
    assert found and all(owner(c // 4) == "ann" and c // 4 != 5 for q, c in found if q == 0)
    assert {c // 4 for q, c in found if q == 1} == {2, 4}
    assert r.retrieve(asked, chunks, documents).count() == 2
    stages = {x.stage for x in r.stages(asked, chunks, documents).collect()}
    assert stages == {"vector", "keyword", "fused", "rerank_input", "post_rerank", "selected", "expanded"}


def test_order_statistics_of_skewed_values(spark, monkeypatch):
    values = [0.0] * 500 + [float(k) for k in range(300)] + [1e9]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 7.0), ("c", None)], "t string, v double").repartition(6)
    for bins in (4096, 3):
        monkeypatch.setattr(metrics, "BINS", bins)
        got = {r.t: r for r in metrics.latency_stats(df, "t", "v").collect()}
        s = sorted(values)
        assert (got["a"].p50, got["a"].p95, got["a"].n) == (s[400], s[int(801 * 0.95)], 801)
        assert got["b"].p50 == got["b"].p95 == 7.0 and "c" not in got
