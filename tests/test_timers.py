"""Job timers: the same actions as a sweep, also after a restart; updates take timers back."""

import shutil
import tempfile
import time

from pyspark.sql import functions as F

from textloom.operators import jobs as job_ops
from textloom.sources import tables as src
from textloom.sources.shared import new_path
from textloom.streaming import job_timers as jt

DATA = "/root/testdata/sf0.001"


def put(df, folder, name):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_actions_of_a_stream_with_a_restart(spark):
    jobs = src.jobs(spark, DATA)
    events = jt.job_events(jobs).filter(f"at <= timestamp'{src.NOW}'")
    folder, out, checkpoint = tempfile.mkdtemp(prefix="spark-"), new_path(spark), new_path(spark)
    read = lambda: jt.watch(spark.readStream.schema(jt.EVENTS).option("recursiveFileLookup", "true").parquet(folder), out, checkpoint).awaitTermination()
    put(events.filter("at < timestamp'2024-01-15'"), folder, "a")
    read()
    early = spark.read.schema(jt.ACTIONS).parquet(out).count()
    put(events.filter("at >= timestamp'2024-01-15'"), folder, "b")
    put(jt.clock(spark, src.NOW), folder, "c")
    read()  # from the checkpoint
    actions = spark.read.schema(jt.ACTIONS).parquet(out)
    assert 0 < early < actions.count() == actions.select("job_id", "due_at").distinct().count()
    assert sorted(map(tuple, jt.last_actions(actions).collect())) == sorted(map(tuple, job_ops.sweep(jobs, src.NOW).collect()))
    read()  # nothing new
    assert spark.read.parquet(out).count() == actions.count()
    shutil.rmtree(folder)


def test_newer_events_take_timers_back(spark):
    rows = [
        (1, 1, "embed", "queued", "00:00"), (1, 1, "embed", "running", "00:10"), (1, 1, "embed", "done", "01:00"),  # in time
        (2, 1, "embed", "running", "00:05"), (2, 1, "embed", "queued", "00:00"), (2, 1, "embed", "queued", "00:00"),  # stalls at 03:05; older events come late
        (3, None, "clean", "queued", "00:30"),  # queued anew at 00:50
        (4, 2, "odd", "queued", "00:00"),  # no worker knows its stage
        (5, 2, "clean", "lost", "00:00"), (None, 2, "clean", "queued", "00:00"), (6, 2, "clean", "queued", None),  # nothing
    ]
    df = spark.createDataFrame([(*r[:4], f"2024-03-01 {r[4]}:00" if r[4] else None) for r in rows], "job_id long, document_id long, stage string, status string, at string").withColumn("at", F.to_timestamp("at"))
    folder, out = tempfile.mkdtemp(prefix="spark-"), new_path(spark)
    df.unionByName(jt.clock(spark, "2024-03-01 11:00:00")).coalesce(1).write.mode("append").parquet(folder)
    jt.watch(jt.event_stream(spark, folder), out, new_path(spark)).awaitTermination()
    got = sorted((r.job_id, r.document_id, r.action, r.reason, f"{r.due_at:%H:%M}") for r in spark.read.schema(jt.ACTIONS).parquet(out).collect())
    assert got == [(2, 1, "fail", "stalled while running", "03:05"), (3, -1, "requeue", None, "00:50"), (4, 2, "skip", None, "00:20")]
    shutil.rmtree(folder)


def test_a_rhythm_until_it_is_stopped(spark):
    folder, out = tempfile.mkdtemp(prefix="spark-"), new_path(spark)
    row = spark.createDataFrame([(1, 1, "embed", "queued")], "job_id long, document_id long, stage string, status string").withColumn("at", F.to_timestamp(F.lit("2024-03-01 00:00:00")))
    row.unionByName(jt.clock(spark, "2024-03-01 01:00:00")).coalesce(1).write.mode("append").parquet(folder)
    query = jt.watch(jt.event_stream(spark, folder), out, new_path(spark), every="1 second")
    for _ in range(60):
        time.sleep(1)
        if query.lastProgress and len(query.recentProgress) > 1:
            break
    assert query.isActive
    query.processAllAvailable()
    query.stop()
    assert [(r.job_id, r.action) for r in spark.read.schema(jt.ACTIONS).parquet(out).collect()] == [(1, "requeue")]
    shutil.rmtree(folder)
