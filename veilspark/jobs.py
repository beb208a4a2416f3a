"""Jobs: started, watched, cancelled and retried, each in its own Spark job group."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Jobs:
    """A registry on the driver; finished jobs are forgotten after ``ttl`` seconds, and no more than ``capacity`` are kept."""

    def __init__(self, spark: SparkSession, capacity: int = 100, ttl: float = 1800):
        self.spark, self.capacity, self.ttl = spark, capacity, ttl
        self._lock, self._jobs = threading.Lock(), {}

    def start(self, work: Callable, *args) -> str:
        self._expire()
        with self._lock:
            if sum(j["status"] in ("queued", "running") for j in self._jobs.values()) >= self.capacity:
                raise RuntimeError("job_capacity_exceeded")
            job = uuid.uuid4().hex
            self._jobs[job] = {"job_id": job, "status": "queued", "error": "", "result": None, "ended": None, "_work": (work, args)}
        threading.Thread(target=self._run, args=(job,), daemon=True).start()
        return job

    def _run(self, job: str) -> None:
        j = self._jobs[job]
        if j["status"] == "cancelled":
            return
        j["status"] = "running"
        self.spark.sparkContext.setJobGroup(job, job, interruptOnCancel=True)
        work, args = j["_work"]
        try:
            j["result"] = work(self.spark, *args)
            j["status"] = "completed" if j["status"] == "running" else j["status"]
        except Exception as e:
            if j["status"] != "cancelled":
                j["status"], j["error"] = "failed", type(e).__name__
        j["ended"] = time.time()

    def status(self, job: str) -> dict:
        self._expire()
        with self._lock:
            j = self._jobs.get(job)
        return {k: v for k, v in j.items() if not k.startswith("_")} if j else {"job_id": job, "status": "not_found"}

    def cancel(self, job: str) -> dict:
        with self._lock:
            j = self._jobs.get(job)
            if j and j["status"] in ("queued", "running"):
                j["status"], j["ended"] = "cancelled", time.time()
        self.spark.sparkContext.cancelJobGroup(job)
        return self.status(job)

    def retry(self, job: str) -> str:
        with self._lock:
            j = self._jobs.get(job)
        if not j or j["status"] not in ("failed", "cancelled"):
            raise ValueError("job_not_retryable")
        work, args = j["_work"]
        return self.start(work, *args)

    def wait(self, job: str, seconds: float = 60) -> dict:
        end = time.time() + seconds
        while self.status(job)["status"] in ("queued", "running") and time.time() < end:
            time.sleep(0.05)
        return self.status(job)

    def _expire(self) -> None:
        now = time.time()
        with self._lock:
            for k in [k for k, j in self._jobs.items() if j["ended"] and now - j["ended"] > self.ttl]:
                del self._jobs[k]
