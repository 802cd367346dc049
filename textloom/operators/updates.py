"""Updates of stored tables: one row for each key whatever the number of updates, all other columns kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.json import fields_of, merged_json, object_text


def newest(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last of each key's updates; of those that are alike in the order, the greatest of their other columns."""
    rest = [c for c in updates.columns if c != key and c not in order]
    of = F.struct(*order, *rest)
    return updates.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(of).alias("_u")).select(key, "_u.*")


def replaced(table: DataFrame, key: str, updates: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The table with some columns computed from its row and its key's row of updates (as _u, null without one); keys of
    updates are unique, and those of no row do nothing."""
    packed = updates.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in updates.columns if c != key]).alias("_u"))
    joined = table.join(packed, F.col(key) == F.col("_key"), "left_outer")
    return joined.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in table.columns])


def patch(table: DataFrame, key: str, updates: DataFrame, order: list[str]) -> DataFrame:
    """Partial updates: the columns that updates share with the table take the last update's value where it isn't null."""
    shared = [c for c in updates.columns if c in table.columns and c != key and c not in order]
    if not shared:
        raise ValueError("updates and table share no column")
    of_key = updates.filter(F.col(key).isNotNull()).groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order, c))).alias(c) for c in shared))
    return replaced(table, key, of_key, {c: F.coalesce(F.col(f"_u.{c}"), F.col(c)) for c in shared})


def merged_fields(updates: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """key, column: the fields of all updates of a key as one JSON object, each with its last value; text that is no object counts for nothing.

    Fields are aggregated one by one, so no key's updates are gathered.
    """
    each = updates.filter(F.col(key).isNotNull()).select(key, *order, F.explode(fields_of(F.col(column))).alias("name", "value"))
    text = F.to_json(F.struct(F.col("value").alias("v")))  # a variant can't be compared; its text in a struct can
    last = each.groupBy(key, "name").agg(F.max_by(text, F.struct(*order, text)).alias("v"))
    pairs = F.map_from_entries(F.collect_list(F.struct("name", F.try_variant_get(F.try_parse_json("v"), "$.v", "variant").alias("v"))))
    return last.groupBy(key).agg(object_text(pairs).alias(column))


def mark(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs after updates (job_id, to, at, more): the last status; running stamps started_at, done and failed finished_at, each
    with its last time; details are merged in order of time, their types kept. Details that are no JSON object stay as they are.

    Several updates of a job make one row. Other columns of jobs are kept.
    """
    order = ["at", "to"]
    stamp = lambda *names: F.max(F.when(F.col("to").isin(*names), F.col("at")))
    status = updates.groupBy("job_id").agg(F.max_by("to", F.struct("at", "to")).alias("to"), stamp("running").alias("began"), stamp("done", "failed").alias("ended"))
    folded = status.join(merged_fields(updates, "job_id", "more", order), "job_id", "left_outer")
    merged = F.coalesce(merged_json(F.col("details"), F.col("_u.more")), F.col("details"))
    columns = {"status": F.coalesce(F.col("_u.to"), F.col("status")), "started_at": F.coalesce(F.col("_u.began"), F.col("started_at")), "finished_at": F.coalesce(F.col("_u.ended"), F.col("finished_at")), "details": F.when(F.col("_u.more").isNotNull(), merged).otherwise(F.col("details"))}
    return replaced(jobs, "job_id", folded, columns)


def set_status(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """Documents after updates (document_id, to, why, at): the last status; the error is overwritten, null clears it; indexed
    stamps indexed_at. Several updates of a document make one row; an update of none does nothing; other columns are kept."""
    moved = F.col("_u.to").isNotNull()
    stamped = newest(updates.filter("to = 'indexed'"), "document_id", ["at"]).select("document_id", F.col("at").alias("indexed"))
    last = newest(updates, "document_id", ["at"]).join(stamped, "document_id", "left_outer")
    columns = {"status": F.coalesce(F.col("_u.to"), F.col("status")), "error": F.when(moved, F.col("_u.why")).otherwise(F.col("error")), "indexed_at": F.coalesce(F.col("_u.indexed"), F.col("indexed_at"))}
    return replaced(documents, "document_id", last, columns)


def set_index_results(documents: DataFrame, results: DataFrame) -> DataFrame:
    """Documents after results (document_id, chunks, pages, at): the last that isn't null of each; other columns are kept."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", c))).alias(c)
    folded = results.groupBy("document_id").agg(last("chunks"), last("pages"), F.max("at").alias("at"))
    columns = {"chunk_count": F.coalesce(F.col("_u.chunks"), F.col("chunk_count")), "page_count": F.coalesce(F.col("_u.pages"), F.col("page_count")), "indexed_at": F.coalesce(F.col("_u.at"), F.col("indexed_at"))}
    return replaced(documents, "document_id", folded, columns)


def set_run_status(runs: DataFrame, updates: DataFrame) -> DataFrame:
    """Runs after updates (run_id, new_status, new_metrics, at): the last status and the last metrics that aren't null;
    finished_at is stamped once, with the first terminal status. Several updates of a run make one row; other columns are kept."""
    ends = F.min(F.when(F.col("new_status").isin("completed", "failed"), F.col("at"))).alias("ended")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", c))).alias(c)
    folded = updates.groupBy("run_id").agg(last("new_status"), last("new_metrics"), ends)
    columns = {"status": F.coalesce(F.col("_u.new_status"), F.col("status")), "metrics": F.coalesce(F.col("_u.new_metrics"), F.col("metrics")), "finished_at": F.coalesce(F.col("finished_at"), F.col("_u.ended"))}
    return replaced(runs, "run_id", folded, columns)
