"""Hybrid retrieval for many queries at once; every result has query_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.config import MOST_DOCUMENT_IDS, MOST_PASSAGES, MOST_QUERY_CHARS, RetrievalConfig
from textloom.functions.text import lexemes, normal_query

from . import lexeme_scores

#: Queries of one pass over the chunks; more make more passes, as a pass's queries go to every executor as one matrix.
BLOCK_QUERIES = 4096
MOST_BLOCKS = 4
#: Queries and chunks of one product, so that a task holds BLOCK x TILE scores at most.
TILE = 256


def scope(chunks: DataFrame, documents: DataFrame, user_id=None, document_ids=None) -> DataFrame:
    """Chunks of indexed documents, with their owner; of one owner and from an allow-list where these are given."""
    docs = documents.filter(F.col("status") == "indexed")
    if user_id is not None:
        docs = docs.filter(F.col("user_id") == user_id)
    if document_ids:
        docs = docs.filter(F.col("document_id").isin(list(document_ids)))
    own = docs.select("document_id", F.col("user_id").alias("_owner"))
    return chunks.drop("user_id").join(own, "document_id").withColumnRenamed("_owner", "user_id")


def validate_scope(requested: DataFrame, documents: DataFrame) -> DataFrame:
    """user_id, document_id, verdict (ok, not_found, not_ready) of each distinct request."""
    owned = documents.select("user_id", "document_id", "status")
    out = requested.select("user_id", "document_id").distinct().join(owned, ["user_id", "document_id"], "left_outer")
    verdict = F.when(F.col("status").isNull(), "not_found").when(F.col("status") != "indexed", "not_ready").otherwise("ok")
    return out.select("user_id", "document_id", verdict.alias("verdict"))


def request_verdicts(requests: DataFrame) -> DataFrame:
    """requests (text, top_k, document_ids) with verdict: ok, or what is wrong with it (the first that applies).

    A null top_k stands for the default, null document_ids for no list.
    """
    ids = F.size(F.coalesce("document_ids", F.array().cast(dict(requests.dtypes)["document_ids"])))
    top_k = F.coalesce("top_k", F.lit(RetrievalConfig.top_k))
    verdict = (
        F.when(normal_query(F.col("text")).isNull(), "empty query")
        .when(F.char_length("text") > MOST_QUERY_CHARS, "long query")
        .when(~top_k.between(1, MOST_PASSAGES), "top_k out of bounds")
        .when(ids > MOST_DOCUMENT_IDS, "too many documents")
        .otherwise("ok")
    )
    return requests.withColumn("verdict", verdict)


def query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks of about BLOCK_QUERIES, by a hash of their id."""
    n = -(-queries.count() // BLOCK_QUERIES)
    return [queries] if n <= 1 else [queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == k) for k in range(n)]


def _best(sims: np.ndarray, chunk: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties by chunk id; what ties with the k-th is looked at before it is cut."""
    if sims.shape[1] > 4 * k:
        least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]
        wide = max(k, int((sims >= least).sum(axis=1).max()))
        at = np.argpartition(-sims, wide - 1, axis=1)[:, :wide]
        sims, chunk = np.take_along_axis(sims, at, 1), np.take_along_axis(chunk, at, 1)
    order = np.lexsort((chunk, -sims), axis=1)[:, :k]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(chunk, order, 1)


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, owned: bool = False) -> DataFrame:
    """query_id, chunk_id, score (cosine), rank: the k nearest chunks, ties by chunk_id.

    The queries of a block (BLOCK_QUERIES at most, about) are one matrix on each executor; a task multiplies
    tiles of it with tiles of its chunks, and only its k best per query leave it. Vectors of another length
    than the queries' are an error. With ``owned``, a query meets the chunks of its user_id only, and of its
    document_ids where it has such a list. More than MOST_BLOCKS blocks would read the chunks as often, so
    then tiles of queries meet pieces of chunks instead (vector_index.exact_topk).
    """
    found, blocks = None, query_blocks(queries)
    if len(blocks) > MOST_BLOCKS:
        from .vector_index import exact_topk

        return exact_topk(queries, chunks, k, owned)
    for block in blocks:
        part = _vector_block(block, chunks, k, owned)
        found = part if found is None else found.unionByName(part)
    return _ranked(found, k)


def _vector_block(queries: DataFrame, chunks: DataFrame, k: int, owned: bool) -> DataFrame:
    lists = owned and "document_ids" in queries.columns
    rows = queries.select("query_id", "embedding", *["user_id"] * owned, *["document_ids"] * lists).filter(F.col("embedding").isNotNull()).collect()
    ids = np.array([r.query_id for r in rows], np.int64)
    sizes = {len(r.embedding) for r in rows}
    if len(sizes) > 1:
        raise ValueError(f"query vectors of different lengths: {sorted(sizes)}")
    dimension = sizes.pop() if sizes else 0
    matrix = np.array([r.embedding for r in rows], np.float64).reshape(len(ids), dimension)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True) + 1e-12
    users = np.array([r.user_id for r in rows], object) if owned else None
    allowed = [set(r.document_ids) if r.document_ids else None for r in rows] if lists else []
    held = queries.sparkSession.sparkContext.broadcast((ids, matrix, users, allowed))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, users, allowed = held.value
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, dimension)
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-12
            names = batch.column("chunk_id").to_numpy(zero_copy_only=False)
            owners = np.array(batch.column("user_id").to_pylist(), object) if owned else None
            documents = batch.column("document_id").to_pylist() if lists else None
            for at in range(0, len(ids), TILE):
                sims = q[at : at + TILE] @ vectors.T
                if owned:
                    sims[users[at : at + TILE, None] != owners[None, :]] = -np.inf
                for n, only in enumerate(allowed[at : at + TILE]):
                    if only is not None:
                        sims[n, [d not in only for d in documents]] = -np.inf
                chunk = np.broadcast_to(names, sims.shape)
                if at in kept:
                    sims, chunk = np.hstack([kept[at][0], sims]), np.hstack([kept[at][1], chunk])
                kept[at] = _best(sims, chunk, k)
        for at, (sims, chunk) in kept.items():
            real = sims > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(ids[at : at + TILE, None], sims.shape)[real]), pa.array(chunk[real]), pa.array(sims[real])], names=["query_id", "chunk_id", "score"])

    size = F.size("embedding")
    checked = F.when(size == dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"a vector isn't of {dimension} numbers but "), size.cast("string")))) if dimension else F.col("embedding")
    columns = ["chunk_id", checked.alias("embedding"), *["user_id"] * owned, *["document_id"] * lists]
    return chunks.filter(F.col("embedding").isNotNull()).select(*columns).mapInArrow(best, "query_id bigint, chunk_id bigint, score double")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def postings(chunks: DataFrame) -> DataFrame:
    """lexeme, chunk_id, tf."""
    return chunks.select("chunk_id", F.explode(lexemes(F.col("text"))).alias("lexeme")).groupBy("lexeme", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int, owned: bool = False) -> DataFrame:
    """query_id, chunk_id, score n / (n + 10) of n occurrences of query lexemes, rank; ties by chunk_id.

    The lexemes of a block of queries are on each executor; a task counts them in tiles of its chunks (lexeme_scores), and
    only its k best per query leave it. With ``owned`` as in vector_topk.
    """
    lists = owned and "document_ids" in queries.columns
    found = None
    for block in lexeme_scores.blocks(queries):
        asked = lexeme_scores.collect(block, lexemes(F.col("text")), owned, lists)
        part = lexeme_scores.best_chunks(asked, chunks, lexemes(F.col("text")), k, owned, lists)
        found = part if found is None else found.unionByName(part)
    return _ranked(found.select("query_id", "chunk_id", (F.col("n") / (F.col("n") + 10.0)).alias("score")), k)


def fuse(vector: DataFrame, keyword: DataFrame, k: int = 60, vector_weight: float = 1.0, keyword_weight: float = 1.0) -> DataFrame:
    """Reciprocal-rank fusion: the full outer join of two ranked lists."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    w = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"), F.col("score").alias("keyword_score"))
    part = lambda weight, rank: F.coalesce(F.lit(float(weight)) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    both = v.join(w, ["query_id", "chunk_id"], "full_outer").withColumn("fused", part(vector_weight, "vector_rank") + part(keyword_weight, "keyword_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"))
    return both.withColumn("fused_rank", F.row_number().over(order))


def rerank(pool: DataFrame, scores: DataFrame, min_score: float | None = None) -> DataFrame:
    """Orders by rerank score, nulls last; a query of which any score is missing keeps its fused order (reranked = false)."""
    scored = pool.join(scores, ["query_id", "chunk_id"], "left_outer")
    whole = Window.partitionBy("query_id")
    scored = scored.withColumn("reranked", F.bool_and(F.col("rerank_score").isNotNull()).over(whole))
    if min_score is not None:
        scored = scored.filter(~F.col("reranked") | (F.col("rerank_score") >= min_score))
    order = whole.orderBy(F.desc_nulls_last(F.when(F.col("reranked"), F.col("rerank_score"))), "fused_rank")
    return scored.withColumn("final_rank", F.row_number().over(order))


def lexical_scores(pairs: DataFrame) -> DataFrame:
    """query_id, chunk_id, rerank_score: share of the query's distinct lexemes in the chunk (a stand-in for a model)."""
    q, c = F.array_distinct(lexemes(F.col("query_text"))), F.array_distinct(lexemes(F.col("text")))
    return pairs.select("query_id", "chunk_id", (F.size(F.array_intersect(q, c)) / F.greatest(F.lit(1), F.size(q))).alias("rerank_score"))


#: Rerankers by name: a function of pairs (query_id, chunk_id, query_text, text) that gives query_id, chunk_id, rerank_score.
RERANKERS = {"lexical": lexical_scores}


def reranker(name: str):
    if name not in RERANKERS:
        raise ValueError(f"no reranker {name!r}; there are {', '.join(sorted(RERANKERS))}")
    return RERANKERS[name]


def mmr(pool: DataFrame, k: int, lambda_: float) -> DataFrame:
    """Maximal marginal relevance: query_id, chunk_id, pick (1..k), relevance from a pool with position, relevance, embedding.

    Pools are small (retrieval cuts them to rerank_candidates), so a query is one group. Equal values
    go to the earlier position; rows without an embedding come last in their order.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position").reset_index(drop=True)
        if len(group) <= k or lambda_ >= 1:
            chosen = list(range(min(k, len(group))))
        else:
            has = [i for i, e in enumerate(group["embedding"]) if e is not None]
            chosen = []
            if has:
                rel = group.loc[has, "relevance"].to_numpy(np.float64)
                span = rel.max() - rel.min()
                rel = (rel - rel.min()) / span if span > 0 else np.ones(len(rel))
                x = np.array([np.asarray(group.at[i, "embedding"], np.float64) for i in has])
                x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-12
                near, open_ = np.zeros(len(has)), np.ones(len(has), bool)
                for _ in range(min(k, len(has))):
                    value = np.where(open_, lambda_ * rel - (1 - lambda_) * near, -np.inf)
                    j = int(np.argmax(value))
                    open_[j] = False
                    chosen.append(has[j])
                    near = np.maximum(near, x @ x[j])
            chosen = (chosen + [i for i in range(len(group)) if i not in set(has)])[:k]
        return pd.DataFrame({"query_id": group["query_id"].iloc[0], "chunk_id": group["chunk_id"].iloc[chosen].to_numpy(), "pick": np.arange(1, len(chosen) + 1), "relevance": group["relevance"].iloc[chosen].to_numpy()})

    return pool.select("query_id", "chunk_id", "position", "relevance", "embedding").groupBy("query_id").applyInPandas(pick, "query_id bigint, chunk_id bigint, pick int, relevance double")


def neighbours(selected: DataFrame, chunks: DataFrame, window: int) -> DataFrame:
    """query_id and chunk of the positions within ``window`` of selected ones that aren't selected; an equi-join."""
    at = selected.select("query_id", "document_id", "chunk_index")
    wanted = at.select("query_id", "document_id", F.explode(F.sequence(F.col("chunk_index") - window, F.col("chunk_index") + window)).alias("chunk_index"))
    wanted = wanted.filter("chunk_index >= 0").distinct().join(at, ["query_id", "document_id", "chunk_index"], "left_anti")
    return wanted.join(chunks, ["document_id", "chunk_index"]).select("query_id", *chunks.columns)
