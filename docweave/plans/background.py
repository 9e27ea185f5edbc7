"""Long runs in the background: a bounded pool, progress, and a cancel that stops a run's Spark jobs by their tag."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from docweave.functions import text as X

ROWS = "task_id string, status string, stage string, completed int, total int, current_document_id string, error string, created_at timestamp, updated_at timestamp"
OVER = ("succeeded", "failed", "cancelled")


class Cancelled(Exception):
    """Raised inside a run that was cancelled, at its next report of progress."""


class Background:
    """Runs of up to ``workers`` at a time; up to ``most`` are remembered, the oldest that are over go first.

    A run is a callable that gets ``progress(completed, total, stage, document_id)`` and returns its result.
    Its Spark jobs carry a tag of their own, so that a cancel ends them and no others.
    """

    def __init__(self, spark: SparkSession, workers: int = 2, most: int = 64):
        self._spark, self._most = spark, max(1, most)
        self._pool = ThreadPoolExecutor(workers)
        self._rows: dict[str, dict] = {}
        self._runs: dict[str, Future] = {}
        self._stopped: set[str] = set()
        self._lock = threading.RLock()

    def start(self, run: Callable[[Callable[..., None]], object], total: int = 0) -> str:
        """Queue a run; its id. Where all that are remembered are still at work, RuntimeError."""
        task, now = str(uuid.uuid4()), datetime.now(UTC)
        with self._lock:
            over = [t for t, row in self._rows.items() if row["status"] in OVER]
            while len(self._rows) >= self._most and over:
                gone = over.pop(0)
                del self._rows[gone], self._runs[gone]
                self._stopped.discard(gone)
            if len(self._rows) >= self._most:
                raise RuntimeError("too many tasks are at work")
            self._rows[task] = {"task_id": task, "status": "queued", "stage": "queued", "completed": 0, "total": max(0, total), "current_document_id": None, "error": None, "created_at": now, "updated_at": now}
            self._runs[task] = self._pool.submit(self._run, task, run)
        return task

    def _set(self, task: str, **values) -> bool:
        """Change a row, unless it is over; whether it was."""
        with self._lock:
            row = self._rows.get(task)
            if row is None or row["status"] in OVER:
                return False
            row |= values | {"updated_at": datetime.now(UTC)}
            return True

    def _run(self, task: str, run: Callable[[Callable[..., None]], object]) -> object:
        def progress(completed: int, total: int | None = None, stage: str = "mapping", document_id: str | None = None) -> None:
            if task in self._stopped:
                raise Cancelled
            more = {} if total is None else {"total": max(0, total)}
            self._set(task, completed=max(0, completed), stage=stage, current_document_id=document_id, **more)

        if not self._set(task, status="running", stage="mapping"):
            raise Cancelled
        self._spark.addTag(f"docweave-{task}")  # tags belong to this thread's jobs
        try:
            result = run(progress)
            self._set(task, status="succeeded", stage="succeeded", current_document_id=None)
            return result
        except BaseException as error:
            self._set(task, status="failed", stage="failed", error=str(error)[:500])
            raise
        finally:
            self._spark.removeTag(f"docweave-{task}")

    def cancel(self, task: str) -> str:
        """Cancel a task that isn't over, and end its jobs, also one that begins just now; the status after that."""
        with self._lock:
            run = self._runs[task]
            self._stopped.add(task)
            self._set(task, status="cancelled", stage="cancelled", current_document_id=None)
            status = self._rows[task]["status"]
        run.cancel()
        if status == "cancelled" and not run.done():
            threading.Thread(target=self._end, args=(task, run), daemon=True).start()
        return status

    def _end(self, task: str, run: Future) -> None:
        while not run.done():
            self._spark.interruptTag(f"docweave-{task}")
            time.sleep(0.1)

    def result(self, task: str, timeout: float | None = None) -> object:
        """Wait for a task's result; what it raised is raised, CancelledError or Cancelled where it was cancelled."""
        return self._runs[task].result(timeout)

    def wait(self, timeout: float | None = None) -> None:
        """Wait until all tasks are over and no thread works for one that was cancelled."""
        for run in list(self._runs.values()):
            if not run.cancelled():
                run.exception(timeout)

    def table(self) -> DataFrame:
        """The tasks as rows; secrets in errors are masked."""
        with self._lock:
            rows = [tuple(row[k.split(" ")[0]] for k in ROWS.split(", ")) for row in self._rows.values()]
        shown = self._spark.createDataFrame(rows, ROWS)
        return shown.withColumn("error", X.redacted(shown["error"])) if rows else shown

    def close(self) -> None:
        """Cancel what isn't over and let the threads go."""
        for task in list(self._rows):
            self.cancel(task)
        self._pool.shutdown(wait=False, cancel_futures=True)
