"""Read patterns over owned tables: paging, counts, sums, latest rows, deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def page(df: DataFrame, order: list, offset: int = 0, limit: int = 100) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, by: list[str], order: list, offset: int, limit: int) -> DataFrame:
    """A page of each group's rows, and the group's total; rows beyond the page leave before any sort of whole groups."""
    totals = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    rows = df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter((F.col("n") > offset) & (F.col("n") <= offset + limit))
    return rows.join(totals, by)


def count_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """key, n: 0 for a parent without children."""
    return parents.select(key).join(children.groupBy(key).agg(F.count(F.lit(1)).alias("n")), key, "left_outer").select(key, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def last_n(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n).drop("back")


def delete_cascade(deleted: DataFrame, key: str, *tables: DataFrame) -> list[DataFrame]:
    """The tables without rows of the deleted keys."""
    gone = deleted.select(key).distinct()
    return [t.join(gone, key, "left_anti") for t in tables]


def quota(documents: DataFrame, most_documents: int, most_bytes: int) -> DataFrame:
    """user_id, n_documents, n_bytes, over for each owner."""
    g = documents.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))
    return g.withColumn("over", (F.col("n_documents") >= most_documents) | (F.col("n_bytes") > most_bytes))


def keyword_candidates(chunks: DataFrame, keywords: list[str], by: str, k: int = 5) -> DataFrame:
    """Chunks with any keyword (ignoring case), the most matched first, k per group: draft gold."""
    low = F.lower("text")
    hits = sum((F.when(F.instr(low, w.lower()) > 0, 1).otherwise(0) for w in keywords), F.lit(0))
    x = chunks.withColumn("hits", hits).filter("hits > 0")
    order = Window.partitionBy(by).orderBy(F.desc("hits"), "chunk_index")
    return x.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)


def owned(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of wanted (user_id and the key) that belong to that owner."""
    return df.join(wanted.select("user_id", key).distinct(), ["user_id", key], "left_semi")


def only(df: DataFrame, **equal: object) -> DataFrame:
    """Rows equal in the given columns; an argument that is None filters nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def search_annotations(chunks: DataFrame, pattern: str, page: int | None = None) -> DataFrame:
    """Chunks whose text has the pattern, ignoring case, on a page where one is given (0 is none)."""
    return only(chunks.filter(F.contains(F.lower("text"), F.lit(pattern.lower()))), page_number=page or None)


def point_lookup(df: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """id, and the row of each id, null where there is none: a filter that reaches the scan once the ids are few."""
    return ids.select(F.col(key)).distinct().join(df, key, "left_outer")


def listed(df: DataFrame, by: str, order: list) -> DataFrame:
    """Rows with their place (from 1) in their group's listing."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("bigint"))
