"""Deletes along declared keys: rows go, and with them the rows that refer to them, level by level."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """Rows of child refer by ``column`` to rows of parent by ``of``."""

    child: str
    column: str
    parent: str
    of: str


# What refers to what in the schema of the ingestion and chat tables.
SCHEMA_KEYS = (
    Key("documents", "user_id", "users", "user_id"),
    Key("conversations", "user_id", "users", "user_id"),
    Key("chunks", "document_id", "documents", "document_id"),
    Key("jobs", "document_id", "documents", "document_id"),
    Key("extractions", "document_id", "documents", "document_id"),
    Key("messages", "conversation_id", "conversations", "conversation_id"),
    Key("citations", "message_id", "messages", "message_id"),
    Key("citations", "chunk_id", "chunks", "chunk_id"),
    Key("results", "run_id", "runs", "run_id"),
)


def in_order(keys: Iterable[Key], tables: Iterable[str]) -> list[str]:
    """The tables, parents before children; keys that lead in a circle are an error."""
    left, out = dict.fromkeys(tables), []
    keys = [k for k in keys if k.child in left and k.parent in left]
    while left:
        free = [t for t in left if not any(k.child == t and k.parent in left for k in keys)]
        if not free:
            raise ValueError(f"keys lead in a circle among {sorted(left)}")
        out += free
        for t in free:
            del left[t]
    return out


def cascade(tables: dict[str, DataFrame], keys: Iterable[Key], deleted: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the rows whose keys are in ``deleted`` (table -> rows with some of its columns) nor any that refer to
    such a row, and table, n_deleted of each table.

    Walked once, parents before children; a row is marked by joins with distinct keys, one for each way it may go. A null reference refers to
    nothing. Keys of tables that aren't given are passed over.
    """
    keys = [k for k in keys if k.child in tables and k.parent in tables]
    marked: dict[str, DataFrame] = {}
    for name in in_order(keys, tables):
        table, ways = tables[name].withColumn("_gone", F.lit(False)), []
        if name in deleted:
            ways.append((deleted[name], deleted[name].columns))
        for k in keys:
            if k.child == name:
                ways.append((marked[k.parent].filter("_gone").select(F.col(k.of).alias(k.column)), [k.column]))
        for rows, columns in ways:
            table = table.join(rows.distinct().withColumn("_hit", F.lit(True)), columns, "left_outer")
            table = table.withColumn("_gone", F.col("_gone") | F.col("_hit").isNotNull()).drop("_hit")
        marked[name] = table.select(*tables[name].columns, "_gone")
    left = {name: marked[name].filter("not _gone").drop("_gone") for name in tables}
    counts = [marked[name].agg(F.count_if("_gone").alias("n_deleted")).select(F.lit(name).alias("table"), "n_deleted") for name in tables]
    return left, reduce(DataFrame.unionByName, counts)
