"""Hybrid retrieval end to end, for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.config import RetrievalConfig
from textloom.functions.text import normal_query, token_estimate
from textloom.operators import passages, retrieval, structure
from textloom.sources.shared import stored

#: What a passage needs of a chunk, beside its text.
PAYLOAD = ("chunk_id", "document_id", "chunk_index", "page_number", "section")


class HybridRetriever:
    """Search, fusion, optional reranking, diversification, neighbours, passages and context.

    queries: query_id, embedding, text; without an embedding, their texts are embedded by the retriever's embedder,
    behind its prefix. Where documents are given, queries have a user_id too (and may have document_ids,
    an allow-list): each then searches its owner's indexed documents alone.
    """

    def __init__(self, config: RetrievalConfig | None = None, embedder: str | None = None, prefix: str = "", reranker: str = "lexical"):
        self.config = config or RetrievalConfig()
        self.embedder, self.prefix = embedder and structure.embedder(embedder), prefix
        self.reranker = retrieval.reranker(reranker)

    def embedded(self, queries: DataFrame) -> DataFrame:
        """The queries with an embedding. An error if they have none and the retriever has no embedder; vectors of another
        length than the chunks' are told by the search."""
        if "embedding" in queries.columns:
            return queries
        if self.embedder is None:
            raise ValueError("queries have no embedding, and the retriever has no embedder")
        asked = queries.withColumn("_asked", F.concat(F.lit(self.prefix), F.coalesce(normal_query(F.col("text")), F.lit(""))))
        return queries.join(self.embedder(asked, "query_id", "_asked"), "query_id")

    def ranked(self, queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The two ranked lists: by vectors and by keywords."""
        c, owned = self.config, documents is not None
        queries = self.embedded(queries).withColumn("text", normal_query(F.col("text")))
        held = retrieval.scope(chunks, documents) if owned else chunks
        return retrieval.vector_topk(queries, held, c.vector_candidates, owned), retrieval.keyword_topk(queries, held, c.keyword_candidates, owned)

    def fused(self, queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        c = self.config
        return retrieval.fuse(*self.ranked(queries, chunks, documents), c.rrf_k, c.vector_weight, c.keyword_weight)

    def reranked(self, queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, fused_rank, fused, rerank_score, final_rank, position, relevance of the rerank pool."""
        return self._reranked(self.fused(queries, chunks, documents), queries, chunks)

    def _reranked(self, fused: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
        c = self.config
        pool = fused.filter(F.col("fused_rank") <= c.rerank_candidates)
        if not c.rerank_enabled:
            return pool.withColumns({"rerank_score": F.lit(None).cast("double"), "final_rank": F.col("fused_rank"), "position": F.col("fused_rank"), "relevance": F.col("fused")})
        asked = queries.select("query_id", normal_query(F.col("text")).alias("query_text"))
        pairs = pool.select("query_id", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").join(asked, "query_id")
        out = retrieval.rerank(pool, self.reranker(pairs), c.rerank_min_score)
        return out.withColumns({"position": F.col("final_rank"), "relevance": F.coalesce("rerank_score", "fused")})

    def selected(self, queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """The pool's picks after diversification, with their chunk columns."""
        return self._selected(self.reranked(queries, chunks, documents), chunks)

    def _selected(self, pool: DataFrame, chunks: DataFrame) -> DataFrame:
        pool = pool.select("query_id", "chunk_id", "position", "relevance")
        picks = retrieval.mmr(pool.join(chunks.select("chunk_id", "embedding"), "chunk_id"), self.config.top_k, self.config.mmr_lambda)
        payload = chunks.select(*PAYLOAD, token_estimate(F.col("token_count"), F.col("text")).alias("tokens"))
        return picks.join(payload, "chunk_id")

    def expanded(self, selected: DataFrame, chunks: DataFrame) -> DataFrame:
        """The selection (order: its pick) and its neighbours (order and relevance null)."""
        light = chunks.select(*PAYLOAD, token_estimate(F.col("token_count"), F.col("text")).alias("tokens"))
        near = retrieval.neighbours(selected, light, self.config.neighbor_window)
        columns = ["query_id", *PAYLOAD, "tokens"]
        chosen = selected.select(*columns, "relevance", F.col("pick").alias("order"))
        return chosen.unionByName(near.select(*columns, F.lit(None).cast("double").alias("relevance"), F.lit(None).cast("int").alias("order")))

    def passages(self, selected: DataFrame, chunks: DataFrame) -> DataFrame:
        c = self.config
        return passages.budgeted(passages.runs(self.expanded(selected, chunks), c.neighbor_window), c.max_context_tokens)

    def context(self, found: DataFrame, chunks: DataFrame) -> DataFrame:
        """query_id, context: passages' texts fetched last, by chunk."""
        each = found.select("query_id", "citation", "section", "page_start", "page_end", F.posexplode("chunk_ids").alias("k", "chunk_id")).join(chunks.select("chunk_id", "text"), "chunk_id")
        texts = each.groupBy("query_id", "citation", "section", "page_start", "page_end").agg(F.array_sort(F.collect_list(F.struct("k", "text"))).alias("t"))
        return passages.render(texts.select("query_id", "citation", "section", "page_start", "page_end", F.array_join(F.col("t.text"), "\n").alias("text")))

    def retrieve(self, queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """query_id, context. The selection, top_k rows for each query, is stored, as what follows reads it several times."""
        selected = stored(queries.sparkSession, self.selected(queries, chunks, documents))
        return self.context(self.passages(selected, chunks), chunks)

    def stages(self, queries: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """case_id, stage, rank, chunk_id, score of keyword, vector, fused, rerank_input, post_rerank, selected and expanded, for evaluation.

        Ranked lists, the reranked pool and the selection, a few rows for each query, are stored: each search and each
        ranking runs once, however many stages and callers read it.
        """
        c, spark = self.config, queries.sparkSession
        vector, keyword = (stored(spark, found) for found in self.ranked(queries, chunks, documents))
        fused = retrieval.fuse(vector, keyword, c.rrf_k, c.vector_weight, c.keyword_weight)
        pool = fused.filter(F.col("fused_rank") <= c.rerank_candidates)
        reranked = stored(spark, self._reranked(fused, queries, chunks))
        selected = stored(spark, self._selected(reranked, chunks).withColumnRenamed("pick", "rank"))
        # neighbours follow the selection, by document and place
        more = self.expanded(selected.withColumnRenamed("rank", "pick"), chunks)
        behind = F.row_number().over(passages.Window.partitionBy("query_id").orderBy(F.asc_nulls_last("order"), "document_id", "chunk_index"))
        parts = [("vector", vector, "rank", "score"), ("keyword", keyword, "rank", "score"), ("fused", fused, "fused_rank", "fused"), ("rerank_input", pool, "fused_rank", "fused"), ("post_rerank", reranked, "final_rank", "relevance"), ("selected", selected, "rank", "relevance"), ("expanded", more.withColumn("rank", behind), "rank", "relevance")]
        out = None
        for stage, df, rank, score in parts:
            part = df.select(F.col("query_id").alias("case_id"), F.lit(stage).alias("stage"), F.col(rank).cast("int").alias("rank"), "chunk_id", F.col(score).alias("score"))
            out = part if out is None else out.unionByName(part)
        return out
