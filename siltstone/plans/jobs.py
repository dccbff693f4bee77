"""Jobs, their progress, and rates and times left over progress events."""

from __future__ import annotations

import json
import threading
import time
import traceback
import uuid
from collections import deque
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

JOB_SCHEMA = (
    "job_id string, action string, status string, started_at double, finished_at double, args string, progress string, "
    "message string, result string, error string"
)
EVENT_SCHEMA = "job_id string, t double, stage string, written long, total long, path string"
RECENT, EVENTS = 200, 10_000


class Jobs:
    """Driver-side registry; work runs under a job group, so a stop also cancels Spark."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.rows: dict[str, dict[str, Any]] = {}
        self.events: deque[tuple] = deque(maxlen=EVENTS)
        self.stops: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def run(self, action: str, work: Callable[..., Any], wait: bool = True, **args: Any) -> str:
        """``work(job_id, **args)`` as a job; its id is returned."""
        job = uuid.uuid4().hex
        with self.lock:
            self._forget()
            self.stops[job] = threading.Event()
            self.rows[job] = {"job_id": job, "action": action, "status": "running", "started_at": time.time(), "finished_at": None,
                              "args": args, "progress": None, "message": "", "result": None, "error": None}

        def body() -> None:
            self.spark.sparkContext.setJobGroup(job, action, interruptOnCancel=True)
            row = self.rows[job]
            try:
                row["result"] = work(job, **args)
                row["status"] = "stopped" if self.stops[job].is_set() else "completed"
            except Exception as e:  # the job's own failure is its result
                row["status"] = "stopped" if self.stops[job].is_set() else "failed"
                row["error"], row["message"] = f"{type(e).__name__}: {e}"[:2000], traceback.format_exc(limit=5)
            row["finished_at"] = time.time()

        if wait:
            body()
        else:
            threading.Thread(target=body, daemon=True).start()
        return job

    def _forget(self) -> None:
        """Of finished jobs the newest ``RECENT`` stay."""
        done = [j for j, r in self.rows.items() if r["status"] != "running"]
        for job in done[: max(0, len(done) - RECENT + 1)]:
            del self.rows[job], self.stops[job]

    def call(self, action: str, work: Callable[[], Any], **args: Any) -> Any:
        """``work()`` as a job that is waited for; its value is returned, its error raised."""
        held: list[Any] = []

        def body(job: str, **_: Any) -> Any:
            try:
                held.append(work())
            except Exception as e:
                held.append(e)
                raise
            return {"rows": len(held[0])} if isinstance(held[0], list | dict) else None

        self.run(action, body, True, **args)
        if isinstance(held[0], Exception):
            raise held[0]
        return held[0]

    def progress(self, job: str) -> Callable[[str, dict], None]:
        def note(stage: str, payload: dict) -> None:
            self.rows[job]["progress"] = {"stage": stage} | payload
            self.events.append((job, time.time(), stage, payload.get("written"), payload.get("total"), payload.get("path")))

        return note

    def stopping(self, job: str) -> Callable[[], bool]:
        return self.stops[job].is_set

    def stop(self, job: str) -> bool:
        """False for an unknown or finished job."""
        if job not in self.rows or self.rows[job]["status"] != "running":
            return False
        self.stops[job].set()
        self.spark.sparkContext.cancelJobGroup(job)
        return True

    def status(self, job: str) -> dict[str, Any]:
        return dict(self.rows[job])

    def table(self) -> DataFrame:
        text = lambda x: None if x is None else json.dumps(x, default=str, sort_keys=True)
        rows = [(r["job_id"], r["action"], r["status"], r["started_at"], r["finished_at"], text(r["args"]), text(r["progress"]), r["message"], text(r["result"]), r["error"]) for r in self.rows.values()]
        return self.spark.createDataFrame(rows, JOB_SCHEMA)

    def recent(self, limit: int = 20) -> DataFrame:
        return recent_jobs(self.table(), limit)

    def progress_events(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.events), EVENT_SCHEMA)


def recent_jobs(jobs: DataFrame, limit: int = RECENT) -> DataFrame:
    """Newest first; at least one row is allowed."""
    return jobs.orderBy(F.desc("started_at"), "job_id").limit(min(RECENT, max(1, limit)))


def ingest_rate(events: DataFrame, samples: int = 12, least: float = 0.5) -> DataFrame:
    """``events`` (job_id, stage, t, written, total) with rate, percent and eta.

    The rate is the rise of ``written`` over the last ``samples`` events of the same job and
    stage, null until they span more than ``least`` seconds; the total is the largest so far.
    """
    phase = Window.partitionBy("job_id", "stage").orderBy("t", "written")
    last = phase.rowsBetween(-(samples - 1), 0)
    span = F.col("t") - F.first("t").over(last)
    rise = F.col("written") - F.first("written").over(last)
    total = F.max("total").over(phase.rowsBetween(Window.unboundedPreceding, 0))
    out = events.withColumns({"span": span, "rise": rise, "top": total})
    rate = F.when((F.col("span") > least) & (F.col("rise") > 0), F.col("rise") / F.col("span"))
    left = F.greatest(F.col("top") - F.col("written"), F.lit(0)) / F.col("rate")
    percent = F.when(F.col("top") > 0, F.round(F.col("written") / F.col("top") * 100, 1))
    return out.withColumn("rate", rate).withColumns({"percent": percent, "eta": left}).drop("span", "rise")


def phase_rate(events: DataFrame, least: float = 0.5) -> DataFrame:
    """``events`` with the mean rate since their stage began, percent and eta: for stages that
    count files, such as preparing and deleting."""
    phase = Window.partitionBy("job_id", "stage").orderBy("t", "written").rowsBetween(Window.unboundedPreceding, 0)
    span = F.col("t") - F.first("t").over(phase)
    out = events.withColumns({"span": span, "top": F.max("total").over(phase)})
    out = out.withColumn("rate", F.when((F.col("span") > least) & (F.col("written") > 0), F.col("written") / F.col("span")))
    left = F.greatest(F.col("top") - F.col("written"), F.lit(0)) / F.col("rate")
    percent = F.when(F.col("top") > 0, F.round(F.col("written") / F.col("top") * 100, 1))
    return out.withColumns({"percent": percent, "eta": left}).drop("span")


def worker_rollup(workers: DataFrame) -> DataFrame:
    """One row a group of ``workers`` (group, gpu): whether any has a GPU, and how many there are."""
    return workers.groupBy("group").agg(F.bool_or("gpu").alias("any_gpu"), F.count("*").alias("workers"))


def summary_line(jobs: DataFrame) -> DataFrame:
    """(job_id, line): one readable line a job."""
    took = T.duration(F.coalesce("finished_at", F.unix_timestamp().cast("double")) - F.col("started_at"))
    return jobs.select("job_id", F.format_string("%s: %s (%s)", "action", "status", took).alias("line"))
