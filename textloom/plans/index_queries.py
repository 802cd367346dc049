"""Registered queries on stored indexes, positions, keyed state and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.operators import positions, text_index, vector_index
from textloom.sources import tables as src
from textloom.sources.shared import new_path
from textloom.streaming import job_timers

from .queries import CHUNKS, KEYWORD, SQL, VECTOR, query


def _vectors(spark, d):
    """Chunks and queries without their texts."""
    return (x.select(*(c for c in x.columns if c != "text")) for x in (src.vector_chunks(spark, d), src.query_batch(spark, d)))


@query()  # no SQL; tests hold it against a plain version
def ann_topk(spark, d):
    """The vector index with the probes it was calibrated for."""
    chunks, queries = _vectors(spark, d)
    return vector_index.search(vector_index.build(chunks), queries, 50).withColumn("score", F.round("score", 6))


@query(f"WITH {CHUNKS}, {VECTOR} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM vector")
def ann_all_lists(spark, d):
    """The vector index with every list probed: the exact result, so every row is indexed once."""
    chunks, queries = _vectors(spark, d)
    index = vector_index.build(chunks)
    return vector_index.search(index, queries, 50, len(index.centroids)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {CHUNKS}, pairs AS (SELECT q.query_id, c.chunk_id, list_cosine_similarity(q.embedding, c.embedding) AS score FROM q JOIN corpus c ON q.document_id % 3 = c.document_id % 3)
SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pairs QUALIFY rank <= 200"""
)
def ann_owned_iterative(spark, d):
    """Owned searches for more rows than the nearest lists hold, which go on until they have them or no list is left."""
    chunks, queries = (x.withColumn("user_id", (F.col("document_id") % 3).cast("string")) for x in _vectors(spark, d))
    index = vector_index.build(chunks)
    return vector_index.search(index, queries, 200, len(index.centroids), owned=True, iterative=True).withColumn("score", F.round("score", 6))


@query(f"WITH {CHUNKS}, {KEYWORD} SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM keyword")
def keyword_blocks(spark, d):
    """Keyword search by blocks of postings with bounds."""
    index = text_index.build_blocks(src.vector_chunks(spark, d).select("chunk_id", "text"))
    return text_index.block_topk(index, src.query_batch(spark, d).select("query_id", "text"), 50).withColumn("score", F.round("score", 9))


@query()  # no SQL; tests hold it against a plain version
def keyword_english(spark, d):
    """Keyword search with stems and without stop words."""
    index = text_index.build_blocks(src.vector_chunks(spark, d).select("chunk_id", "text"), "english")
    return text_index.block_topk(index, src.query_batch(spark, d).select("query_id", "text"), 50).withColumn("score", F.round("score", 9))


@query(SQL["pipeline_sweep"])
def timed_sweep(spark, d):
    """The sweep's actions, by timers of a stream over every job's events up to the clock's time."""
    folder, late = new_path(spark), "400 days"  # the table isn't in order of time
    events = job_timers.job_events(src.jobs(spark, d)).filter(F.col("at") <= F.lit(src.NOW).cast("timestamp"))
    events.unionByName(job_timers.clock(spark, src.NOW, late)).write.parquet(folder)
    out = new_path(spark)
    job_timers.watch(job_timers.event_stream(spark, folder), out, new_path(spark), late).awaitTermination()
    return job_timers.last_actions(spark.read.schema(job_timers.ACTIONS).parquet(out))


@query(
    f"""WITH {CHUNKS}, a AS (SELECT vec_id, label, row_number() OVER (ORDER BY label, vec_id) - 1 AS position FROM embeddings),
b AS (SELECT chunk_id, token_count, row_number() OVER (ORDER BY token_count, chunk_id) - 1 AS position FROM chunks) SELECT * FROM a JOIN b USING (position)"""
)
def zipped_rows(spark, d):
    """Vectors by label beside chunks by length, place by place."""
    vectors, chunks = src.table(spark, d, "embeddings").select("vec_id", "label"), src.vector_chunks(spark, d).select("chunk_id", F.col("token_count").cast("bigint").alias("token_count"))
    return positions.zip_by_position(vectors, chunks, ["label", "vec_id"], ["token_count", "chunk_id"])
