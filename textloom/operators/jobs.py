"""The ingestion state machine, its read model and its sweeps, as pure table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ingest import STAGES
from .positions import row_positions
from .updates import mark, replaced, set_index_results, set_status  # noqa: F401 (transitions of this machine)


def stage_order(stage: str = "stage"):
    return F.array_position(F.array(*map(F.lit, STAGES)), F.col(stage))


def start_stage(requests: DataFrame, jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """job_id, verdict, job_status and doc_status after it, for requests (job_id, stage; null stage: any)."""
    r = requests.select("job_id", F.col("stage").alias("asked"))
    j = jobs.select("job_id", "document_id", "stage", "status")
    d = documents.select("document_id", F.col("status").alias("doc_before"))
    x = r.join(j, "job_id", "left_outer").join(d, "document_id", "left_outer")
    verdict = (
        F.when(F.col("stage").isNull(), "job_missing")
        .when(F.col("asked") != F.col("stage"), "stage_mismatch")
        .when(F.col("status") == "done", "already_done")
        .when(F.col("status") == "failed", "already_failed")
        .when(~F.col("status").isin("queued", "running"), "bad_status")
        .when(F.col("doc_before").isNull(), "document_missing")
        .when(~F.col("doc_before").isin("pending", "processing"), "document_closed")
        .otherwise("started")
    )
    x = x.withColumn("verdict", verdict)
    go = F.col("verdict") == "started"
    return x.select("job_id", "verdict", F.when(go, "running").otherwise(F.col("status")).alias("job_status"), F.when(go, "processing").otherwise(F.col("doc_before")).alias("doc_status"))


def complete_stage(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """job_id, verdict, next_stage and doc_status for each job that reports its end."""
    d = documents.select("document_id", F.col("status").alias("doc_before"))
    x = jobs.select("job_id", "document_id", "stage", "status").join(d, "document_id", "left_outer")
    verdict = (
        F.when(F.col("status") == "done", "already_done")
        .when(F.col("status") != "running", "not_running")
        .when(F.col("doc_before").isNull(), "document_missing")
        .when(F.col("doc_before") != "processing", "document_closed")
        .otherwise("completed")
    )
    x = x.withColumn("verdict", verdict).withColumn("i", stage_order())
    done = F.col("verdict") == "completed"
    following = F.get(F.array(*map(F.lit, STAGES)), F.col("i").cast("int"))
    return x.select("job_id", "verdict", F.when(done, following).alias("next_stage"), F.when(done & (F.col("i") == len(STAGES)), "indexed").otherwise(F.col("doc_before")).alias("doc_status"))


def fail_stage(jobs: DataFrame, documents: DataFrame, error: str) -> DataFrame:
    """job_id, job_status, doc_status, error: terminal jobs stay; documents fail only while open."""
    d = documents.select("document_id", F.col("status").alias("doc_before"))
    x = jobs.select("job_id", "document_id", "status").join(d, "document_id", "left_outer")
    live = F.col("status").isin("queued", "running")
    return x.select("job_id", F.when(live, "failed").otherwise(F.col("status")).alias("job_status"), F.when(live & F.col("doc_before").isin("pending", "processing"), "failed").otherwise(F.col("doc_before")).alias("doc_status"), F.when(live, F.lit(error)).alias("error"))


def latest_by_stage(jobs: DataFrame) -> DataFrame:
    """The newest job of each document and stage (created_at, then job_id)."""
    newest = F.max_by(F.struct("job_id", "status", "created_at", "started_at", "finished_at"), F.struct("created_at", "job_id"))
    return jobs.groupBy("document_id", "stage").agg(newest.alias("j")).select("document_id", "stage", "j.*")


def last_completed(jobs: DataFrame) -> DataFrame:
    """The done job of each document that finished last."""
    newest = F.max_by(F.struct("job_id", "stage", "finished_at", "details"), F.struct("finished_at", "job_id"))
    return jobs.filter("status = 'done'").groupBy("document_id").agg(newest.alias("j")).select("document_id", "j.*")


def document_state(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """document_id, status, progress, current_stage, stages_done, duration_ms: five stages, an absent one is queued."""
    stages = F.explode(F.array(*map(F.lit, STAGES))).alias("stage")
    each = documents.select("document_id", F.col("status").alias("doc_status"), stages)
    x = each.join(latest_by_stage(jobs), ["document_id", "stage"], "left_outer").withColumn("status", F.coalesce("status", F.lit("queued")))
    x = x.withColumn("i", stage_order())
    ms = F.floor((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000)
    g = x.groupBy("document_id", "doc_status").agg(
        F.count_if(F.col("status") == "done").alias("stages_done"),
        F.min_by("stage", F.when(F.col("status") == "running", F.col("i"))).alias("running"),
        F.min_by("stage", F.when(F.col("status") != "done", F.col("i"))).alias("open"),
        F.sum(ms).alias("duration_ms"),
    )
    current = F.when(F.col("doc_status") != "failed", F.coalesce("running", "open"))
    return g.select("document_id", F.col("doc_status").alias("status"), F.round(F.col("stages_done") / len(STAGES), 2).alias("progress"), current.alias("current_stage"), "stages_done", "duration_ms")


def stuck(jobs: DataFrame, now: str, queued_minutes: int = 20, running_minutes: int = 180) -> DataFrame:
    """Jobs queued or running for too long."""
    t = F.lit(now).cast("timestamp")
    old = lambda c, m: F.col(c) < t - F.expr(f"INTERVAL {m} MINUTES")
    return jobs.filter(((F.col("status") == "queued") & old("created_at", queued_minutes)) | ((F.col("status") == "running") & old("started_at", running_minutes)))


def sweep(jobs: DataFrame, now: str, give_up_hours: int = 12) -> DataFrame:
    """job_id, action (fail, requeue, skip) and reason for stuck jobs."""
    t = F.lit(now).cast("timestamp")
    x = stuck(jobs, now)
    aged = F.coalesce("started_at", "created_at") < t - F.expr(f"INTERVAL {give_up_hours} HOURS")
    action = F.when(~F.col("stage").isin(*STAGES), "skip").when((F.col("status") == "running") | aged, "fail").when(F.col("status") == "queued", "requeue").otherwise("skip")
    reason = F.when(action != "fail", F.lit(None)).when(F.col("status") == "running", "stalled while running").otherwise("not picked up in time")
    return x.select("job_id", "document_id", "stage", action.alias("action"), reason.alias("reason"))


def pending_without_job(documents: DataFrame, jobs: DataFrame, now: str | None = None, grace_seconds: int = 12, limit: int | None = None) -> DataFrame:
    """Pending documents that no queued or running job will move.

    With ``now``, those created in the last seconds are left out, as their job may be on its way; with
    ``limit``, the oldest so many are given, by created_at and document_id.
    """
    waiting = documents.filter("status = 'pending'")
    if now is not None:
        waiting = waiting.filter(F.col("created_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {grace_seconds} SECONDS"))
    found = waiting.join(jobs.filter(F.col("status").isin("queued", "running")), "document_id", "left_anti")
    return found if limit is None else found.orderBy("created_at", "document_id").limit(limit)


def reconcile(documents: DataFrame, jobs: DataFrame, now: str | None = None) -> DataFrame:
    """Processing documents whose index job is done: document_id, indexed_at (its end; where it has none, now), chunk_count."""
    done = last_completed(jobs.filter("stage = 'index'"))
    x = documents.filter("status = 'processing'").join(done, "document_id")
    ended = F.coalesce("finished_at", F.current_timestamp() if now is None else F.lit(now).cast("timestamp"))
    return x.select("document_id", ended.alias("indexed_at"), F.coalesce(F.get_json_object("details", "$.k").cast("bigint"), F.lit(0).cast("bigint")).alias("chunk_count"))


#: Deletions in a pass up to which a limit chooses them.
MOST_LIMITED = 10_000


def sweep_orphans(objects: DataFrame, live_keys: DataFrame, now: str, grace_hours: int = 2, most: int = 1000) -> DataFrame:
    """key, action (keep_live, keep_young, delete, later): at most ``most`` deletions in a pass, oldest first."""
    x = objects.join(live_keys.select("key", F.lit(True).alias("live")).distinct(), "key", "left_outer")
    young = F.col("mtime").isNull() | (F.col("mtime") > F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {grace_hours} HOURS"))
    kept = x.withColumn("action", F.when(F.col("live"), "keep_live").when(young, "keep_young"))
    dead = kept.filter("action is null")
    # the first few are kept by each task; many are numbered by ranges, so that no task sorts all objects
    oldest = dead.orderBy("mtime", "key").limit(most) if most <= MOST_LIMITED else row_positions(dead.select("key", "mtime"), ["mtime", "key"]).filter(F.col("position") < most)
    first = oldest.select("key", F.lit(True).alias("chosen"))
    gone = dead.join(first, "key", "left_outer").select("key", F.when(F.col("chosen"), "delete").otherwise("later").alias("action"))
    return kept.filter("action is not null").select("key", "action").unionByName(gone)


# Kinds of errors that no further try mends; keys that artifacts may have; endings of the types that are stored.
PERMANENT_ERRORS = ("PermanentError", "ObjectNotFound", "DocumentNotFound", "JobNotFound", "TypeError", "ValueError", "KeyError", "AttributeError")
UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
USER_KEY = rf"^{UUID}/[0-9a-f]{{2}}/[0-9a-f]{{64}}\.[a-z0-9]{{1,5}}$"
ARTIFACT_KEY = r"^_pipeline/cache/[0-9a-f]{16}/[0-9a-f]{64}/[a-z0-9_]+\.json\.gz$"
EXTENSIONS = {"application/pdf": ".pdf", "text/html": ".html", "text/markdown": ".md", "text/csv": ".csv", "text/plain": ".txt", "text/asciidoc": ".adoc", "application/xml": ".xml"}


def error_class(error):
    """permanent or transient, by the name of the error."""
    return F.when(error.isin(*PERMANENT_ERRORS), "permanent").otherwise("transient")


def key_shape(key):
    """user, artifact, or null for a key that is neither."""
    return F.when(key.rlike(USER_KEY), "user").when(key.rlike(ARTIFACT_KEY), "artifact")


def is_uuid(text):
    return F.coalesce(F.lower(text).rlike(f"^{UUID}$"), F.lit(False))


def extension(mime):
    out = F.lit(".bin")
    for name, ending in EXTENSIONS.items():
        out = F.when(mime == name, ending).otherwise(out)
    return out


def ascii_metadata(text, limit: int = 200):
    """Every character outside ASCII as a question mark, cut at ``limit``."""
    return F.left(F.regexp_replace(text, r"[^\x00-\x7F]", "?"), F.lit(limit))


def record_attempts(jobs: DataFrame, attempts: DataFrame) -> DataFrame:
    """job_id, n_attempts, last_error, history of running jobs: attempts (job_id, attempt, error) in order; other jobs record nothing."""
    running = jobs.filter("status = 'running'").select("job_id")
    g = attempts.join(running, "job_id", "left_semi").groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "error"))).alias("history"))
    return g.select("job_id", F.size("history").cast("bigint").alias("n_attempts"), F.element_at("history", -1)["error"].alias("last_error"), "history")


def has_active_job(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """document_id, active."""
    live = jobs.filter(F.col("status").isin("queued", "running")).select("document_id").distinct().withColumn("active", F.lit(True))
    return documents.select("document_id").join(live, "document_id", "left_outer").select("document_id", F.coalesce("active", F.lit(False)).alias("active"))


def latest_overall(jobs: DataFrame) -> DataFrame:
    """The newest job of each document, whatever its stage."""
    newest = F.max_by(F.struct("job_id", "stage", "status", "created_at"), F.struct("created_at", "job_id"))
    return jobs.groupBy("document_id").agg(newest.alias("j")).select("document_id", "j.*")


def live_keys(documents: DataFrame, configs: dict[str, str]) -> DataFrame:
    """key: every key that a document row still needs: its source, its parsed form, and the artifacts of its content."""
    from .ingest import artifact_keys

    own = documents.select(F.explode(F.array("storage_key", "parsed_key")).alias("key"))
    return own.unionByName(artifact_keys(documents, configs).select("key")).filter("key is not null").distinct()


def orphans(objects: DataFrame, live: DataFrame, owners: DataFrame) -> DataFrame:
    """key of the objects that nothing needs: no live key, and not under <user>/_pipeline/<document>/ of a live pair.

    owners: user_id, document_id. A key with segments that are no UUIDs has no such pair.
    """
    x = objects.select("key").join(live.select("key").distinct(), "key", "left_anti")
    parts = F.split("key", "/")
    inside = (F.size(parts) >= 4) & (F.get(parts, F.lit(1)) == "_pipeline") & is_uuid(F.get(parts, F.lit(0))) & is_uuid(F.get(parts, F.lit(2)))
    x = x.withColumns({"user_id": F.when(inside, F.lower(F.get(parts, F.lit(0)))), "document_id": F.when(inside, F.lower(F.get(parts, F.lit(2))))})
    return x.join(owners.select("user_id", "document_id").distinct(), ["user_id", "document_id"], "left_anti").select("key")


def reprocess(documents: DataFrame, requests: DataFrame, configs: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, new jobs and keys to delete for requests (document_id, from_stage): the documents are pending again, their
    first job is the stage's, and the artifacts from that stage on go."""
    from .ingest import artifact_keys

    # of several requests for a document, the earliest stage
    requests = requests.groupBy("document_id").agg(F.min_by("from_stage", stage_order("from_stage")).alias("from_stage"))
    asked = F.col("_u.from_stage").isNotNull()
    after = replaced(documents, "document_id", requests, {"status": F.when(asked, "pending").otherwise(F.col("status")), "indexed_at": F.when(~asked, F.col("indexed_at"))})
    jobs = documents.join(requests, "document_id").select("document_id", F.col("from_stage").alias("stage"), F.lit("queued").alias("status"))
    keys = artifact_keys(documents, configs).join(requests, "document_id").filter(stage_order() >= stage_order("from_stage")).select("document_id", "key")
    return after, jobs, keys


def processing_since(documents: DataFrame, cutoff: str, limit: int | None = None) -> DataFrame:
    """Processing documents that weren't updated since a time; with ``limit`` the oldest so many, in order."""
    found = documents.filter((F.col("status") == "processing") & (F.col("updated_at") < F.lit(cutoff).cast("timestamp")))
    return found if limit is None else found.orderBy("updated_at", "document_id").limit(limit)


def newest_per_schema(extractions: DataFrame) -> DataFrame:
    """The newest extraction of each document and schema (created_at, then extraction_id)."""
    rest = [c for c in extractions.columns if c not in ("document_id", "schema_name")]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "extraction_id"))
    return extractions.groupBy("document_id", "schema_name").agg(newest.alias("e")).select("document_id", "schema_name", "e.*")
