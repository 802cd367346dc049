"""Keyed state of jobs with timers, many jobs to a state: what a sweep would do, told as the stream's clock passes each limit."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from textloom.operators.ingest import STAGES

#: Milliseconds after which a queued job is queued anew and a running one fails, and the age at which any job fails.
MINUTE = 60_000
QUEUED_MS, RUNNING_MS, GIVE_UP_MS = 20 * MINUTE, 180 * MINUTE, 720 * MINUTE
#: How late an event may arrive; later ones are dropped, as by any watermark.
LATE = "1 hour"
EVENTS = "job_id bigint, document_id bigint, stage string, status string, at timestamp"
ACTIONS = "job_id bigint, document_id bigint, stage string, action string, reason string, due_at timestamp"
#: Jobs share so many states: a state's jobs are held, and their timers told, together.
BUCKETS = 1024
_STATE = "jobs binary"
_FIELDS = ["job_id", "document_id", "stage", "status", "since"]
_HELD = pa.schema([("job_id", pa.int64()), ("document_id", pa.int64()), ("stage", pa.string()), ("status", pa.string()), ("since", pa.int64()), ("due", pa.int64())])
#: The time of a timer that isn't set.
NEVER = 2**62
#: Statuses in the order of a job's life; of events at the same time the later one counts.
_PLACES = {"queued": 0, "running": 1, "done": 2, "failed": 2}


class JobTimers(StatefulProcessor):
    """The last event of each job of a bucket, and the next limit that it faces; one timer for the first of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", _STATE)

    def _held(self) -> pd.DataFrame | None:
        if not self.jobs.exists():
            return None
        return pa.ipc.open_stream(pa.py_buffer(bytes(self.jobs.get()[0]))).read_pandas()

    def _hold(self, jobs: pd.DataFrame) -> None:
        table, sink = pa.Table.from_pandas(jobs, _HELD, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD) as out:
            out.write_table(table)
        self.jobs.update((sink.getvalue().to_pybytes(),))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        first = int(jobs["due"].min()) if len(jobs) else NEVER
        if first < NEVER:
            self.handle.registerTimer(first)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([some[some["status"].isin(list(_PLACES))] for some in rows])
        if not len(fresh):
            return iter(())
        fresh = fresh.rename(columns={"at_ms": "since"})[_FIELDS]
        before = self._held()
        since, waits = fresh["since"].astype("int64"), fresh["status"].map({"queued": QUEUED_MS, "running": RUNNING_MS})
        fresh = fresh.assign(since=since, due=(since + waits.fillna(0).astype("int64")).where(waits.notna(), NEVER))
        # an event at the time and place of the last one takes its place, as it came later
        all_ = fresh if before is None else pd.concat([before, fresh])
        all_ = all_.assign(place=all_["status"].map(_PLACES)).sort_values(["job_id", "since", "place"], kind="stable")
        last = all_.drop_duplicates("job_id", keep="last").drop(columns="place")
        if before is not None:  # a repeated event sets no timer anew
            old = last[["job_id"]].merge(before, on="job_id", how="left")
            equal = np.logical_and.reduce([(old[c].to_numpy() == last[c].to_numpy()) | (old[c].isna().to_numpy() & last[c].isna().to_numpy()) for c in _FIELDS])
            last = last.assign(due=np.where(equal, old["due"].fillna(0).astype("int64"), last["due"]))
        self._hold(last)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs = self._held()
        if jobs is None:
            return
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        while (ready := ((jobs["due"] <= fired) | (jobs["due"] < now)).to_numpy()).any():
            some = jobs[ready]
            known, running = some["stage"].isin(STAGES).to_numpy(), (some["status"] == "running").to_numpy()
            aged = (some["due"] >= some["since"] + GIVE_UP_MS).to_numpy()
            action = np.select([~known, running | aged], ["skip", "fail"], "requeue").astype(object)
            reason = np.where(action != "fail", None, np.where(running, "stalled while running", "not picked up in time").astype(object))
            yield pd.DataFrame({"job_id": some["job_id"], "document_id": some["document_id"], "stage": some["stage"], "action": action, "reason": reason, "due_at": pd.to_datetime(some["due"], unit="ms")})
            # a queued job is given up later, unless no worker knows its stage: that is only skipped
            jobs.loc[ready, "due"] = np.where(known & ~running & ~aged, some["since"] + GIVE_UP_MS, NEVER)
        self._hold(jobs)


def job_actions(events: DataFrame, late: str = LATE) -> DataFrame:
    """ACTIONS from a stream of EVENTS: requeue after 20 minutes in the queue, fail after 3 hours of running or 12 hours in the queue.

    An action comes once the watermark (the newest event less ``late``) passes its time. A newer event of
    a job takes back timers that aren't due. Jobs are dealt to BUCKETS by a hash, and a state holds those of a bucket. Events without a job, a time or a known status only move
    the clock; a null document_id comes out as -1. Jobs that ended keep one small state row, so a late repeat of an old event starts nothing.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = F.when(F.col("job_id").isNotNull(), F.col("status"))  # rows without a job stay, as a filter would be pushed below the watermark
    timed = events.withWatermark("at", late).select(F.coalesce("job_id", F.lit(-1)).alias("job_id"), F.coalesce("document_id", F.lit(-1)).alias("document_id"), "stage", known.alias("status"), "at", F.unix_millis("at").alias("at_ms"))
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).alias("bucket")
    return timed.filter("at is not null").select("*", bucket).groupBy("bucket").transformWithStateInPandas(JobTimers(), ACTIONS, "Append", "EventTime")


def job_events(jobs: DataFrame) -> DataFrame:
    """EVENTS of rows of jobs: each one's creation, start and end, where it has them."""
    known = lambda status, at, when: F.when(when, F.struct(F.lit(status).alias("status"), F.col(at).alias("at")))
    ended = F.when(F.col("status").isin("done", "failed"), F.struct(F.col("status").alias("status"), F.coalesce("finished_at", "started_at", "created_at").alias("at")))
    each = F.array_compact(F.array(known("queued", "created_at", F.col("created_at").isNotNull()), known("running", "started_at", F.col("started_at").isNotNull()), ended))
    return jobs.select("job_id", "document_id", "stage", F.explode(each).alias("e")).select("job_id", "document_id", "stage", "e.status", "e.at")


def clock(spark: SparkSession, now: str, late: str = LATE) -> DataFrame:
    """One event without a job that moves the watermark just past now."""
    return spark.range(1).select(F.lit(None).cast("bigint").alias("job_id"), F.lit(None).cast("bigint").alias("document_id"), F.lit(None).cast("string").alias("stage"), F.lit("tick").alias("status"), (F.lit(now).cast("timestamp") + F.expr(f"INTERVAL {late}")).alias("at"))


def event_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", max_files).parquet(folder)


def watch(events: DataFrame, out: str, checkpoint: str, late: str = LATE, every: str | None = None) -> StreamingQuery:
    """Appends actions to a Parquet folder until all events there are have been read, or with ``every`` ("30 seconds") in that
    rhythm until it is stopped; goes on from its checkpoint when called again."""
    writer = job_actions(events, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def last_actions(actions: DataFrame) -> DataFrame:
    """The latest action of each job, as one sweep would have it."""
    newest = Window.partitionBy("job_id").orderBy(F.desc("due_at"))
    return actions.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "due_at")
