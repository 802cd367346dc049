"""Packs: the artifacts of many contents under one fingerprint in a few Parquet files, for jobs that make them in bulk.

A file for each content takes a folder and blocks of its own however small it is; a pack has their rows side by side. Each run that
makes artifacts adds one batch: first its rows, then the contents it is for, those without rows too.
A content is held once it is in the latter, so what a job that died left behind is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import CHUNK, PACKS
from .shared import exists

#: Columns of held contents, and of rows.
HELD = "content_hash string, batch string"
ROWS = f"content_hash string, {CHUNK.replace(':', '')}"


def _at(folder: str, fingerprint: str, what: str, batch: str | None = None) -> str:
    path = f"{folder.rstrip('/')}/{PACKS}{fingerprint}/{what}"
    return path if batch is None else f"{path}/batch={batch}"


def held(spark: SparkSession, folder: str, fingerprint: str) -> DataFrame:
    """content_hash, batch of the contents that have artifacts under a fingerprint, once for each batch."""
    path = _at(folder, fingerprint, "contents")
    if not exists(spark, path):
        return spark.createDataFrame([], HELD)
    return spark.read.schema(HELD).parquet(path)


def write(rows: DataFrame, contents: DataFrame, folder: str, fingerprint: str) -> str:
    """Adds a batch, and gives its name. rows: content_hash and fields of CHUNK, of these contents (content_hash, each once) only."""
    batch = uuid.uuid4().hex
    types = [x.split(": ") for x in CHUNK.split(", ")]
    named = [F.col(c).cast(t).alias(c) for c, t in types if c in rows.columns]
    for df, what in ((rows.select("content_hash", *named), "rows"), (contents.select("content_hash"), "contents")):
        df.write.option("compression", "zstd").parquet(_at(folder, fingerprint, what, batch))
    return batch


def read(wanted: DataFrame, folder: str, fingerprint: str) -> DataFrame:
    """content_hash and the fields of CHUNK of the rows of contents (content_hash, batch) in their batches.

    A batch of which all contents are wanted is read as it is; only rows of others meet the wanted contents in a join.
    """
    spark = wanted.sparkSession
    sizes = held(spark, folder, fingerprint).groupBy("batch").agg(F.count(F.lit(1)).alias("size"))
    asked = wanted.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).join(sizes, "batch").collect()  # a row for each run that made some
    # without the mark of a whole commit there may be rows of contents that aren't held
    whole = [r.batch for r in asked if r.n == r.size and exists(spark, f"{_at(folder, fingerprint, 'contents', r.batch)}/_SUCCESS")]
    part = [r.batch for r in asked if r.batch not in whole]
    found = spark.createDataFrame([], ROWS)
    for batches in (whole, part):
        if batches:
            rows = spark.read.schema(f"{ROWS}, batch string").option("basePath", _at(folder, fingerprint, "rows")).parquet(*(_at(folder, fingerprint, "rows", b) for b in batches))
            rows = rows.join(wanted, ["content_hash", "batch"], "left_semi") if batches is part else rows
            found = found.unionByName(rows.drop("batch"))
    return found
