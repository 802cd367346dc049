"""Positions of rows in an order, and running aggregates along them, without one task for all rows of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.shared import stored

#: Bits below a partition's number in what monotonically_increasing_id() returns.
_ROW_BITS = 33
#: Places of a group that one task takes at once in running().
BLOCK = 4096


def row_positions(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "position") -> DataFrame:
    """df with the 0-based position of each row in the given order, within its group if by is given.

    Rows are dealt by ranges of group and order, sorted there, and stored with their places; the counts
    of the partitions before give the rest (prefix sums). So a group may span many tasks. Groups that
    do are found by their counts: one row for each border between partitions is broadcast, no more.
    Nulls are a group of their own and come first in an order; equal rows take positions in any order.
    """
    by = by or []
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = stored(df.sparkSession, dealt.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", _ROW_BITS))
    counts = rows.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    borders = counts.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_part").alias("_from"), before.alias("_before")).filter("_before > 0")
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_id")) - 1 if by else F.col("_id").bitwiseAND((1 << _ROW_BITS) - 1)
    same = F.col("_part") == F.col("_from")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    out = rows.withColumn("_own", own).join(F.broadcast(borders), same, "left_outer")
    return out.select(*df.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("bigint").alias(name))


def running(df: DataFrame, key: str, place: Column, values: dict[str, Column], fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> DataFrame:
    """df with each value folded over the rows of its key up to its place (inclusive).

    A key's places are cut into blocks of BLOCK; a task folds a block, and what all blocks before hold
    comes from their totals. fold is an associative aggregate (F.sum, F.bit_xor), join combines two
    of its results. Places are whole numbers, different within a key.
    """
    cut = df.select("*", *[v.alias(f"_{c}") for c, v in values.items()], place.alias("_place"), F.floor(place / BLOCK).alias("_block"))
    within = Window.partitionBy(key, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = cut.groupBy(key, "_block").agg(*(fold(F.col(f"_{c}")).alias(f"_{c}") for c in values))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_block", *[fold(F.col(f"_{c}")).over(earlier).alias(f"_before_{c}") for c in values]).filter(f"_before_{next(iter(values))} is not null")
    joined = cut.select("*", *[fold(F.col(f"_{c}")).over(within).alias(c) for c in values]).join(before, [key, "_block"], "left_outer")
    return joined.select(*df.columns, *[F.when(F.col(f"_before_{c}").isNull(), F.col(c)).otherwise(join(F.col(c), F.col(f"_before_{c}"))).alias(c) for c in values])


class LengthMismatch(ValueError):
    """Two tables that were to be zipped have different numbers of rows."""


def zip_by_position(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of both tables side by side, the n-th of one order with the n-th of the other, with their position.

    Different numbers of rows are an error (LengthMismatch), told before anything is joined. Names of
    right that left has too are an error. Both sides are dealt by position, so no task holds a table.
    """
    clash = set(left.columns) & set(right.columns)
    if clash:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    a, b = row_positions(left, left_order), row_positions(right, right_order)
    sizes = a.count(), b.count()
    if sizes[0] != sizes[1]:
        raise LengthMismatch(f"{sizes[0]} rows against {sizes[1]}")
    return a.join(b, "position").select("position", *left.columns, *right.columns)
