"""Views over the stored tables that stand for the ingestion and retrieval schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import normal_query, words

#: Chunks of a document; of the vectors, every one whose id this divides is a query.
CHUNKS_OF_DOCUMENT = 8
QUERY_EVERY = 100
#: The clock of staleness predicates.
NOW = "2024-01-30 12:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name; columns and filters reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, user_id, content_hash, size_bytes, status: owners are sources, status comes from labels."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = d.join(lab.select("doc_id", "quality"), "doc_id", "left_outer")
    status = F.when(F.col("quality") == 1, "indexed").when(F.col("quality") == 0, "failed").when(F.col("doc_id") % 2 == 0, "pending").otherwise("processing")
    return x.select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), F.sha2("text", 256).alias("content_hash"), F.col("n_chars").alias("size_bytes"), status.alias("status"), "text")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, document_id, chunk_index, embedding, text, token_count, page_number, section: every vector is a chunk, with the text of its id."""
    v, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    at = F.col("vec_id") % CHUNKS_OF_DOCUMENT
    c = v.join(d.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left_outer")
    return c.select(
        F.col("vec_id").alias("chunk_id"),
        F.floor(F.col("vec_id") / CHUNKS_OF_DOCUMENT).cast("bigint").alias("document_id"),
        at.cast("int").alias("chunk_index"),
        "embedding",
        "text",
        F.size(words(F.col("text"))).alias("token_count"),
        F.when(F.col("vec_id") % 5 != 0, F.floor(at / 2).cast("int") + 1).alias("page_number"),
        F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("Part "), F.floor(at / 4).cast("string"))).alias("section"),
    )


def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, embedding, text (normalised), document_id: every chunk whose id QUERY_EVERY divides, to be searched for in all."""
    q = vector_chunks(spark, sf_dir).filter(F.col("chunk_id") % QUERY_EVERY == 0)
    return q.select(F.col("chunk_id").alias("query_id"), "embedding", normal_query(F.col("text")).alias("text"), "document_id")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, chunk_id: the chunks of the query's document."""
    at = lambda k: F.sequence(k * CHUNKS_OF_DOCUMENT, (k + 1) * CHUNKS_OF_DOCUMENT - 1)
    q = query_batch(spark, sf_dir).select(F.col("query_id").alias("case_id"), F.explode(at(F.col("document_id"))).alias("chunk_id"))
    return q.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")), "chunk_id", "left_semi").select("case_id", "chunk_id")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, document_id, stage, status, created_at, started_at, finished_at, details from events."""
    e = table(spark, sf_dir, "events")
    stage = F.when(F.col("event_type") == "signup", "extract").when(F.col("event_type") == "view", "clean").when(F.col("event_type") == "click", "chunk").when(F.col("event_type") == "purchase", "embed").otherwise("index")
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "done", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    x = e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("document_id"), stage.alias("stage"), status.alias("status"), F.col("ts").cast("timestamp").alias("created_at"), "value", F.col("props").alias("details"))
    x = x.withColumn("started_at", F.when(F.col("status") != "queued", F.col("created_at") + F.expr("INTERVAL 1 MINUTE")))
    finished = F.timestamp_micros(F.unix_micros("started_at") + F.floor(F.col("value")).cast("bigint") * 1_000_000)
    return x.withColumn("finished_at", F.when(F.col("status").isin("done", "failed"), finished)).drop("value")


def toc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item, text: lines of documents, with dirt, and before them lines like a table of contents on some."""
    d = table(spark, sf_dir, "documents")
    dirty = F.transform(F.split("text", "\n"), lambda x: F.concat(F.lit("  "), x, F.lit("\t​ ")))
    entry = lambda page: F.concat(F.lit("Part ....... "), page.cast("string"))
    kind = F.col("doc_id") % 4
    up, down = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: entry(i * 10)), F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: entry(60 - i * 10))
    three, apart = F.slice(up, 1, 3), F.flatten(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.array(entry(i * 10)), F.array_repeat(F.lit("filler"), 9))))
    head = F.when(kind == 0, up).when(kind == 1, down).when(kind == 2, three).otherwise(apart)
    return d.select("doc_id", F.posexplode(F.concat(head, dirty)).alias("item", "text"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
