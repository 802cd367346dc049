"""Continuous ingestion: new documents as files, cleaned, cut into windows and stored once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.functions.text import clean_text
from textloom.operators.ingest import token_windows

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def document_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Documents of the Parquet files that appear in a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def ingest_chunks(documents: DataFrame, out: str, checkpoint: str, limit: int = 64, overlap: int = 8, every: str | None = None) -> StreamingQuery:
    """Writes the chunks of each new (source, content); a batch that is run again overwrites its own folder.

    It ends when all there is has been read, or with ``every`` ("30 seconds") looks for more in that rhythm until it is stopped.

    Uploads are deduplicated within a day of processing time by owner and content hash.
    """
    arriving = documents.withColumn("content_hash", F.sha2("text", 256)).withColumn("seen_at", F.current_timestamp())
    arriving = arriving.withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark(["source", "content_hash"])

    def write(batch: DataFrame, number: int) -> None:
        cleaned = batch.select("doc_id", clean_text(F.col("text")).alias("text"))
        token_windows(cleaned, limit, overlap).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type in tumbling windows, late rows within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
