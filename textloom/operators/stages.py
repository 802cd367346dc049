"""Ingestion by stages with artifacts as a cache: what a content already has is read, the rest is made and kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import clean_text, fingerprint_chain
from textloom.sources import artifacts, packs
from textloom.sources.shared import exists, stored

from .ingest import STAGES, artifact_keys, token_windows
from .structure import vector

#: The batch of artifacts that are objects; a name after those of packs.
OBJECTS = "objects"
#: A stage: from rows (content_hash and fields of a stored chunk) to such rows.
Stage = Callable[[DataFrame], DataFrame]


def clean(rows: DataFrame) -> DataFrame:
    """Texts cleaned, once (a filter over them would clean each again); empty ones go."""
    cleaned = F.filter(F.array(clean_text(F.col("text"))), lambda text: text != "")
    return rows.withColumn("text", F.explode(cleaned))


def chunk(limit: int = 64, overlap: int = 8) -> Stage:
    """Windows of ``limit`` words, ``overlap`` shared."""

    def run(rows: DataFrame) -> DataFrame:
        pieces = token_windows(rows.select(F.col("content_hash").alias("doc_id"), "text"), limit, overlap)
        return pieces.select(F.col("doc_id").alias("content_hash"), F.col("piece").cast("bigint").alias("chunk_index"), "text", F.col("n_tokens").cast("bigint").alias("token_count"))

    return run


def embed(name: str) -> Stage:
    """A vector for each chunk by a named embedder."""

    def run(rows: DataFrame) -> DataFrame:
        return rows.withColumn("embedding", vector(name)(F.col("text")))

    return run


def ingest(documents: DataFrame, folder: str, configs: dict[str, str], stages: dict[str, Stage]) -> tuple[DataFrame, DataFrame]:
    """Chunks of each document (document_id and the fields of a stored chunk), and stage, n_cached, n_computed.

    documents: document_id, content_hash, text. configs has a stage's settings as text: an artifact's key
    depends on the content and on the settings of its stage and all before, so a new setting makes that
    stage and the ones after anew. Equal contents are made once. A content without rows has an empty
    artifact, so it is cached too. Null texts have no content and no chunks.

    What is made goes to packs. Artifacts that lie at their keys as objects are read as well. A stage gives
    rows of the contents of the rows it gets, no others.
    """
    spark = documents.sparkSession
    unknown = [s for s in stages if s not in STAGES or s not in configs]
    if unknown:
        raise ValueError(f"stages without a place or a configuration: {unknown}")
    names = [s for s in STAGES if s in stages]
    prints = spark.range(1).select(*(c.alias(s) for s, c in zip(configs, fingerprint_chain(list(configs.values())), strict=True))).first().asDict()
    known = documents.filter(F.col("content_hash").isNotNull() & F.col("text").isNotNull())
    contents = stored(spark, known.select("content_hash").distinct())
    asked = stored(spark, _batches(contents, folder, configs, prints, names))
    each = [F.struct(F.lit(s).alias("stage"), F.count(s).alias("n_cached"), F.count_if(F.col(s).isNull()).alias("n_computed")) for s in names]
    counts = asked.agg(F.array(*each).alias("x")).select(F.inline("x"))
    before = None
    for name in names:
        todo = asked.filter(F.col(name).isNull())
        if not todo.isEmpty():
            if before is None:
                texts = known.groupBy("content_hash").agg(F.min("text").alias("text"))  # copies go before the shuffle
                rows = texts.join(todo.select("content_hash"), "content_hash", "left_semi").withColumn("chunk_index", F.lit(0).cast("bigint"))
            else:
                rows = _rows(todo.select("content_hash", F.col(before).alias("batch")), folder, configs, prints, before)
            made = packs.write(stages[name](rows), todo, folder, prints[name])
            asked = asked.withColumn(name, F.coalesce(name, F.lit(made)))
        before = name
    chunks = _rows(asked.select("content_hash", F.col(before).alias("batch")), folder, configs, prints, before)
    return known.select("document_id", "content_hash").join(chunks, "content_hash"), counts


def _objects(contents: DataFrame, folder: str, configs: dict[str, str], prints: dict[str, str], name: str) -> DataFrame | None:
    """content_hash and key of contents at a stage; None where the folder has no objects of its fingerprint, so none is asked for."""
    if not exists(contents.sparkSession, f"{folder}/_pipeline/cache/{prints[name]}"):
        return None
    keys = artifact_keys(contents.select(F.col("content_hash").alias("document_id"), "content_hash"), configs).filter(F.col("stage") == name)
    return keys.select(F.col("document_id").alias("content_hash"), "key")


def _batches(contents: DataFrame, folder: str, configs: dict[str, str], prints: dict[str, str], names: list[str]) -> DataFrame:
    """content_hash and, by the name of each stage, the batch that has its artifact; null where none has."""
    found = []
    for name in names:
        found.append(packs.held(contents.sparkSession, folder, prints[name]).withColumn("stage", F.lit(name)))
        keys = _objects(contents, folder, configs, prints, name)
        if keys is not None:
            held = artifacts.held_keys(keys, folder).filter("held")
            found.append(held.select("content_hash", F.lit(OBJECTS).alias("batch"), F.lit(name).alias("stage")))
    first = [F.min(F.when(F.col("stage") == name, F.col("batch"))).alias(name) for name in names]
    return contents.join(reduce(DataFrame.unionByName, found).groupBy("content_hash").agg(*first), "content_hash", "left_outer")


def _rows(wanted: DataFrame, folder: str, configs: dict[str, str], prints: dict[str, str], name: str) -> DataFrame:
    """content_hash and the stored rows of contents (content_hash, batch) at a stage."""
    rows = packs.read(wanted, folder, prints[name])
    keys = _objects(wanted.filter(F.col("batch") == OBJECTS), folder, configs, prints, name)
    if keys is not None:
        found = artifacts.fetch_artifacts(keys, folder)
        rows = rows.unionByName(keys.join(found, "key").select("content_hash", F.explode("rows").alias("r")).select("content_hash", "r.*"))
    return rows
