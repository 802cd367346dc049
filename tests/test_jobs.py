import pytest

from textloom.operators import jobs, relational

JOB = "job_id bigint, document_id bigint, stage string, status string, created_at string, started_at string, finished_at string, details string"


def frames(spark, job_rows, doc_rows):
    from pyspark.sql import functions as F

    j = spark.createDataFrame(job_rows, JOB)
    for c in ("created_at", "started_at", "finished_at"):
        j = j.withColumn(c, F.col(c).cast("timestamp"))
    return j, spark.createDataFrame(doc_rows, "document_id bigint, user_id string, status string")


T = "2024-01-01 00:00:00"


@pytest.mark.parametrize(
    "job, doc, verdict",
    [
        ("queued", "pending", "started"),
        ("running", "processing", "started"),
        ("done", "processing", "already_done"),
        ("failed", "failed", "already_failed"),
        ("queued", "indexed", "document_closed"),
        ("queued", "failed", "document_closed"),
    ],
)
def test_start(spark, job, doc, verdict):
    j, d = frames(spark, [(1, 1, "extract", job, T, None, None, "{}")], [(1, "u", doc)])
    asked = spark.createDataFrame([(1, None)], "job_id bigint, stage string")
    assert jobs.start_stage(asked, j, d).first().verdict == verdict


def test_start_missing_and_mismatch(spark):
    j, d = frames(spark, [(1, 9, "extract", "queued", T, None, None, "{}")], [(1, "u", "pending")])
    asked = spark.createDataFrame([(1, "clean"), (1, "extract"), (2, None)], "job_id bigint, stage string")
    assert sorted(r.verdict for r in jobs.start_stage(asked, j, d).collect()) == ["document_missing", "job_missing", "stage_mismatch"]


def test_complete_moves_on_and_ends(spark):
    j, d = frames(spark, [(1, 1, "clean", "running", T, T, None, "{}"), (2, 2, "index", "running", T, T, None, "{}")], [(1, "u", "processing"), (2, "u", "processing")])
    got = {r.job_id: (r.next_stage, r.doc_status) for r in jobs.complete_stage(j, d).collect()}
    assert got == {1: ("chunk", "processing"), 2: (None, "indexed")}


def test_sweep(spark):
    rows = [(1, 1, "extract", "queued", "2024-01-30 11:00:00", None, None, "{}"), (2, 1, "extract", "running", "2024-01-30 01:00:00", "2024-01-30 02:00:00", None, "{}"), (3, 1, "extract", "queued", "2024-01-29 01:00:00", None, None, "{}"), (4, 1, "extract", "queued", "2024-01-30 11:59:00", None, None, "{}")]
    j, _ = frames(spark, rows, [(1, "u", "pending")])
    got = {r.job_id: r.action for r in jobs.sweep(j, "2024-01-30 12:00:00").collect()}
    assert got == {1: "requeue", 2: "fail", 3: "fail"}


def test_document_state(spark):
    rows = [(1, 1, "extract", "done", T, T, "2024-01-01 00:00:02", "{}"), (2, 1, "clean", "failed", T, T, T, "{}"), (3, 1, "clean", "running", "2024-01-01 00:01:00", T, None, "{}")]
    j, d = frames(spark, rows, [(1, "u", "processing"), (2, "u", "failed")])
    got = {r.document_id: r for r in jobs.document_state(d, j).collect()}
    assert (got[1].progress, got[1].current_stage, got[1].duration_ms) == (0.2, "clean", 2000)
    assert got[2].current_stage is None and got[2].progress == 0.0


def test_orphans(spark):
    from pyspark.sql import functions as F

    o = spark.createDataFrame([("a", T), ("b", T), ("c", None), ("d", "2024-01-30 11:30:00"), ("e", T)], "key string, mtime string").withColumn("mtime", F.col("mtime").cast("timestamp"))
    live = spark.createDataFrame([("a",)], "key string")
    got = {r.key: r.action for r in jobs.sweep_orphans(o, live, "2024-01-30 12:00:00", most=1).collect()}
    assert got == {"a": "keep_live", "b": "delete", "c": "keep_young", "d": "keep_young", "e": "later"}


def test_read_patterns(spark):
    df = spark.createDataFrame([(g, k) for g in (1, 2) for k in range(5)], "g bigint, k bigint")
    assert sorted((r.g, r.k) for r in relational.last_n(df, "g", "k", 2).collect()) == [(1, 3), (1, 4), (2, 3), (2, 4)]
    parents = spark.createDataFrame([(1,), (3,)], "g bigint")
    assert sorted(tuple(r) for r in relational.count_children(parents, df, "g").collect()) == [(1, 5), (3, 0)]
    (left,) = relational.delete_cascade(parents, "g", df)
    assert {r.g for r in left.collect()} == {2}
