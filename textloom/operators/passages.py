"""Passages: runs of neighbouring chunks under a token budget, and their rendered context."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import page_label


def runs(members: DataFrame, window: int) -> DataFrame:
    """Gaps and islands: query_id, document_id, lo, hi, score, tokens, chunks (array) of each run.

    members: query_id, document_id, chunk_index, chunk_id, tokens, page_number, section, relevance (null for neighbours),
    order (position in the selection, null for neighbours). A run's score is the largest relevance
    of the selected chunks whose window reaches into it.
    """
    by = Window.partitionBy("query_id", "document_id")
    seq = by.orderBy("chunk_index")
    m = members.withColumn("island", F.col("chunk_index") - F.row_number().over(seq))
    m = m.withColumn("doc_first", F.min("order").over(by))
    near = F.max("relevance").over(seq.rangeBetween(-window, window))
    m = m.withColumn("near", near)
    return m.groupBy("query_id", "document_id", "island").agg(
        F.min("chunk_index").alias("lo"),
        F.max("chunk_index").alias("hi"),
        F.max("near").alias("score"),
        F.sum("tokens").alias("tokens"),
        F.min("doc_first").alias("doc_first"),
        F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "tokens", "page_number", "section"))).alias("chunks"),
    )


def budgeted(found: DataFrame, max_tokens: int) -> DataFrame:
    """Passages in order of score that fit the budget: a run that would exceed it is skipped, but the first
    of all is cut to its first chunk. query_id, citation, document_id, lo, hi, score, tokens, chunk_ids, and of these chunks
    page_start and page_end (nulls left out) and section, the first that isn't empty."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "doc_first", "lo", "hi", "document_id", "tokens", "chunks")))
    step = lambda a, x: F.when((F.size(a["taken"]) > 0) & (a["used"] + x["tokens"] > max_tokens), a).otherwise(
        F.struct(
            (a["used"] + F.when(a["used"] + x["tokens"] > max_tokens, x["chunks"][0]["tokens"]).otherwise(x["tokens"])).cast("bigint").alias("used"),
            F.concat(
                a["taken"],
                F.array(
                    F.struct(
                        x["document_id"].alias("document_id"),
                        x["lo"].alias("lo"),
                        F.when(a["used"] + x["tokens"] > max_tokens, x["lo"]).otherwise(x["hi"]).alias("hi"),
                        (-x["minus"]).alias("score"),
                        F.when(a["used"] + x["tokens"] > max_tokens, x["chunks"][0]["tokens"]).otherwise(x["tokens"]).cast("bigint").alias("tokens"),
                        F.when(a["used"] + x["tokens"] > max_tokens, F.slice(x["chunks"], 1, 1)).otherwise(x["chunks"]).alias("chunks"),
                    )
                ),
            ).alias("taken"),
        )
    )
    types = dict(found.dtypes)
    empty = F.array().cast(f"array<struct<document_id:{types['document_id']},lo:{types['lo']},hi:{types['hi']},score:double,tokens:bigint,chunks:{types['chunks']}>>")
    folded = found.groupBy("query_id").agg(ordered.alias("runs")).select("query_id", F.aggregate("runs", F.struct(F.lit(0).cast("bigint").alias("used"), empty.alias("taken")), step, lambda a: a["taken"]).alias("taken"))
    out = folded.select("query_id", F.posexplode("taken").alias("k", "p")).select("query_id", (F.col("k") + 1).alias("citation"), "p.*")
    pages, sections = F.col("chunks.page_number"), F.filter("chunks.section", lambda x: F.coalesce(x, F.lit("")) != "")
    return out.select("query_id", "citation", "document_id", "lo", "hi", "score", "tokens", F.col("chunks.chunk_id").alias("chunk_ids"), F.array_min(pages).alias("page_start"), F.array_max(pages).alias("page_end"), F.get(sections, F.lit(0)).alias("section"))


def render(passages: DataFrame) -> DataFrame:
    """query_id, context: blocks "[n] section (pages)" and text, with a rule between them.

    passages: query_id, citation, section, page_start, page_end, text.
    """
    title = F.concat_ws(" ", F.concat(F.lit("["), F.col("citation").cast("string"), F.lit("]")), F.when(F.col("section") != "", F.col("section")), F.concat(F.lit("("), page_label(F.col("page_start"), F.col("page_end")), F.lit(")")))
    block = F.concat(title, F.lit("\n"), F.col("text"))
    return passages.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("citation", block.alias("b")))).alias("bs")).select("query_id", F.array_join(F.col("bs.b"), "\n\n---\n\n").alias("context"))
