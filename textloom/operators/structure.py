"""Chunks that follow a document's structure: headings carried down, bodies merged, pieces with their heading."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import lexemes, words


def sections(items: DataFrame) -> DataFrame:
    """Adds section: the headings over each item, joined by " > ", null where there is none.

    items: doc_id, item, level (1 or 2 for headings, null for text), text, page (null if not known).
    """
    order = Window.partitionBy("doc_id").orderBy("item").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda level, value: F.last(F.when(F.col("level") == level, F.col(value)), ignorenulls=True).over(order)
    x = items.withColumns({"_h1": last(1, "text"), "_p1": last(1, "item"), "_h2": last(2, "text"), "_p2": last(2, "item")})
    under = F.when(F.col("_p2") > F.coalesce("_p1", F.lit(-1)), F.col("_h2"))
    path = F.array_compact(F.array("_h1", under))
    return x.withColumn("section", F.when(F.size(path) > 0, F.array_join(path, " > "))).drop("_h1", "_p1", "_h2", "_p2")


def merged_bodies(items: DataFrame) -> DataFrame:
    """doc_id, part, section, page (the smallest), text: neighbouring text items of one section as one body, in order."""
    order = Window.partitionBy("doc_id").orderBy("item")
    x = sections(items).withColumn("_new", F.when(F.col("level").isNotNull(), 1).otherwise(0))
    x = x.withColumn("part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("level is null")
    g = x.groupBy("doc_id", "part").agg(F.first("section", ignorenulls=True).alias("section"), F.min("page").alias("page"), F.array_sort(F.collect_list(F.struct("item", "text"))).alias("ts"))
    return g.select("doc_id", "part", "section", "page", F.array_join(F.col("ts.text"), "\n").alias("text"))


def structural_chunks(items: DataFrame, limit: int = 64, overlap: int = 8, split: bool = True) -> DataFrame:
    """doc_id, part, piece, section, page, n_tokens, text: bodies cut into windows of ``limit`` words, each behind its section.

    A section that leaves no room, or (without ``split``) a body that is too long, is an error.
    """
    head = words(F.coalesce(F.regexp_replace("section", " > ", " "), F.lit("")))
    x = merged_bodies(items).withColumns({"head": head, "w": words(F.col("text"))}).withColumn("room", F.lit(limit) - F.size("head"))
    checked = F.when(F.col("room") > 0, F.col("room")).otherwise(F.raise_error(F.lit("a section leaves no room")).cast("int"))
    x = x.filter(F.size("w") > 0).withColumn("room", checked).withColumn("step", F.greatest(F.lit(1), F.col("room") - overlap))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - F.col("room")) / F.col("step")).cast("int"))
    if not split:
        last = F.when(last == 0, last).otherwise(F.raise_error(F.lit("a body is longer than the limit")).cast("int"))
    x = x.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    tokens = F.concat("head", F.slice("w", F.col("piece") * F.col("step") + 1, F.col("room")))
    return x.select("doc_id", "part", "piece", "section", "page", F.size(tokens).alias("n_tokens"), F.array_join(tokens, " ").alias("text"))


def heading_prefix(context, body, section):
    """What stands before a body in its context; rebuilt from the section where the context doesn't end with the body."""
    ends = F.endswith(context, body) & (F.char_length(body) > 0)
    return F.when(ends, F.left(context, F.char_length(context) - F.char_length(body))).when(section.isNotNull(), F.concat(section, F.lit("\n"))).otherwise(F.lit(""))


def document_stats(items: DataFrame) -> DataFrame:
    """doc_id, pages, text_items, headings."""
    return items.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"), F.count_if(F.col("level").isNull()).alias("text_items"), F.count_if(F.col("level").isNotNull()).alias("headings"))


def indexable(chunks: DataFrame, dimension: int) -> DataFrame:
    """The chunks, if each has a vector of that length; an error otherwise, before anything is written."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    return chunks.withColumn("embedding", F.when(size == dimension, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit("chunk without a vector of the index: "), F.col("chunk_id").cast("string")))))


def hashed_embeddings(rows: DataFrame, key: str, text: str, dimension: int = 64, prefix: str = "") -> DataFrame:
    """key, embedding: a stand-in for a model. Lexemes are hashed into signed places; a vector has length 1, or zeros for no lexeme.

    Places are counted before the shuffle; JVM functions only.
    """
    each = rows.select(key, F.explode(lexemes(F.concat(F.lit(prefix), F.coalesce(F.col(text), F.lit(""))))).alias("w"))
    code = F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("bigint")
    at = each.select(key, F.pmod(code, F.lit(dimension)).cast("int").alias("at"), F.when(F.pmod(F.shiftright(code, 16), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
    sums = at.groupBy(key, "at").agg(F.sum("s").alias("s"))
    g = sums.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("at", "s"))).alias("m"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda k: F.when(F.col("norm") > 0, F.coalesce(F.try_element_at("m", k), F.lit(0.0)) / F.col("norm")).otherwise(F.lit(0.0)))
    return rows.select(key).join(g, key, "left_outer").select(key, vector.alias("embedding"))


def hashed_vector(text: Column, dimension: int = 64) -> Column:
    """The vector that hashed_embeddings gives a text, as a column of floats: counted in Arrow batches, nothing is shuffled."""

    def run(lists: pa.Array) -> pa.Array:
        words = lists.flatten().dictionary_encode()
        codes = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words.dictionary.to_pylist()], np.int64)[words.indices.to_numpy()]
        at = compute.list_parent_indices(lists).to_numpy() * dimension + codes % dimension
        sums = np.bincount(at, np.where((codes >> 16) % 2 == 0, 1.0, -1.0), len(lists) * dimension).reshape(-1, dimension)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        vectors = (sums / np.where(norm > 0, norm, 1.0)).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, dimension, dtype=np.int32)), pa.array(vectors.ravel()))

    return F.arrow_udf(run, "array<float>")(lexemes(text))


#: Stand-ins for models by name: a function of (rows, key, text column) that gives key, embedding; and one of a text that gives its vector.
EMBEDDERS = {"hashing-64": hashed_embeddings, "hashing-256": lambda rows, key, text: hashed_embeddings(rows, key, text, 256)}
VECTORS = {"hashing-64": hashed_vector, "hashing-256": lambda text: hashed_vector(text, 256)}


def _named(models: dict[str, Callable], name: str) -> Callable:
    if name not in models:
        raise ValueError(f"no embedder {name!r}; there are {', '.join(sorted(models))}")
    return models[name]


def embedder(name: str) -> Callable[[DataFrame, str, str], DataFrame]:
    return _named(EMBEDDERS, name)


def vector(name: str) -> Callable[[Column], Column]:
    return _named(VECTORS, name)
