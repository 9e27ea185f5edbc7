"""Import tasks kept by a stream of events: guarded transitions, a percent that never falls, retries that fall due."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docweave.operators.imports import RETRY_SECONDS, stage_percent

#: What can happen to a task. ``at`` is the time that counts, ``seq`` tells the order of events at one time.
EVENTS = "task_id string, at timestamp, seq long, kind string, stage string, percent int, retryable boolean, error_code string"
TASKS = "task_id string, updates long, status string, stage string, progress int, attempts int, auto_retry_count int, manual_retry_count int, next_attempt_at timestamp, cancel_requested_at timestamp, error_code string, refused int, updated_at timestamp"
KINDS = ("submit", "claim", "progress", "commit", "succeed", "fail", "cancel", "release", "retry")
MOST_RETRIES = 3


def events(rows: DataFrame, stage: Column, completed: Column, total: Column, **columns: Column) -> DataFrame:
    """``rows`` as EVENTS, ``percent`` from a stage and how much of it is done; ``columns`` name the others."""
    given = {"stage": stage, "percent": stage_percent(stage, completed, total)} | columns
    kinds = dict(part.split(" ", 1) for part in EVENTS.split(", "))
    return rows.select(*(given.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()))


def new_task() -> dict:
    return {"updates": 0, "status": None, "stage": None, "progress": 0, "attempts": 0, "auto_retry_count": 0, "manual_retry_count": 0, "next_attempt_at": None, "cancel_requested_at": None, "error_code": None, "refused": 0, "updated_at": None}


def apply(task: dict, event: dict, most_retries: int = MOST_RETRIES) -> None:
    """One event's change of a task. An event that the task's state doesn't allow changes nothing but ``refused``.

    Times are milliseconds. A running task can be cancelled until it commits: then ``cancel`` is a wish, and
    ``succeed`` or ``fail`` decide. A failure that may pass waits for its retry, the third and later ones longest.
    """
    kind, at, status = event["kind"], event["at"], task["status"]
    running = status == "running"
    change: dict | None = None
    if kind == "submit" and status is None:
        change = {"status": "queued", "stage": "queued"}
    elif kind == "claim" and status == "queued":
        change = {"status": "running", "next_attempt_at": None, "attempts": task["attempts"] + 1, "progress": max(task["progress"], 10)}
    elif kind == "progress" and running:
        change = {"stage": event["stage"], "progress": max(task["progress"], event["percent"] or 0)}
    elif kind == "commit" and running and task["stage"] != "committing" and task["cancel_requested_at"] is None:
        change = {"stage": "committing", "progress": 99}
    elif kind == "succeed" and running:
        change = {"status": "succeeded", "stage": "succeeded", "progress": 100, "error_code": None}
    elif kind == "fail" and running:
        if task["cancel_requested_at"] is not None and task["stage"] != "committing":
            change = {"status": "cancelled", "stage": "cancelled"}
        elif event["retryable"] and task["auto_retry_count"] < most_retries:
            wait = RETRY_SECONDS[min(task["auto_retry_count"], len(RETRY_SECONDS) - 1)]
            change = {"status": "retry_wait", "stage": "queued", "auto_retry_count": task["auto_retry_count"] + 1, "next_attempt_at": at + 1000 * wait, "error_code": event["error_code"]}
        else:
            change = {"status": "failed", "stage": "failed", "error_code": event["error_code"]}
    elif kind == "cancel" and status in ("queued", "retry_wait"):
        change = {"status": "cancelled", "stage": "cancelled", "next_attempt_at": None, "cancel_requested_at": at}
    elif kind == "cancel" and running and task["stage"] != "committing":
        change = {"cancel_requested_at": task["cancel_requested_at"] if task["cancel_requested_at"] is not None else at}
    elif kind == "release" and running:
        change = {"status": "queued", "stage": "queued", "attempts": task["attempts"] - 1}
    elif kind == "retry" and status == "failed":
        change = {"status": "queued", "stage": "queued", "auto_retry_count": 0, "manual_retry_count": task["manual_retry_count"] + 1}
    elif kind == "due" and status == "retry_wait":
        change = {"status": "queued", "next_attempt_at": None}
    if change is None:
        task["refused"] += 1
    else:
        task |= change | {"updated_at": at, "updates": task["updates"] + 1}


def advance(task: dict, waiting: list[dict], until: int, most_retries: int = MOST_RETRIES) -> list[dict]:
    """Apply what lies before ``until``, retries that fall due in their place between the events; what still waits."""
    waiting = sorted(waiting, key=lambda e: (e["at"], e["seq"]))
    k = 0
    while True:
        due = task["next_attempt_at"]
        at = waiting[k]["at"] if k < len(waiting) else None
        if due is not None and due < until and (at is None or due <= at):
            apply(task, {"kind": "due", "at": due}, most_retries)
        elif at is not None and at < until:
            apply(task, waiting[k], most_retries)
            k += 1
        else:
            return waiting[k:]


def follow(arriving: DataFrame, late: str = "10 minutes", most_retries: int = MOST_RETRIES) -> DataFrame:
    """The tasks that a stream of EVENTS leaves behind (TASKS): a row for each change, the one with the most ``updates`` counts.

    Events of a task are held until the watermark has passed them and are applied in order of (at, seq), so the
    result doesn't depend on how the stream is cut into micro-batches or on the order of arrival. A timer wakes a
    task when held events or a retry fall due though nothing arrives. Repeated events (same task, at, seq) count once
    while they are held. Events that come later than ``late`` are dropped, as by any watermark; those that have
    no task, time or kind are left out. State is one row a task; restarts go on from the checkpoint.
    """
    names = ["ms", *(f.split(" ")[0] for f in EVENTS.split(", ") if f.split(" ")[0] not in ("task_id", "at"))]
    times = [f.split(" ")[0] for f in TASKS.split(", ") if f.endswith(" timestamp")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        task, waiting = json.loads(state.get[0]) if state.exists else (new_task(), [])
        for batch in batches:
            for row in batch[names].itertuples(index=False):
                one = {n: (None if pd.isna(v) else v) for n, v in zip(names, row, strict=True)}
                one |= {"at": int(one.pop("ms")), "seq": int(one["seq"] or 0), "percent": None if one["percent"] is None else int(one["percent"]), "retryable": bool(one["retryable"])}
                if one not in waiting:
                    waiting.append(one)
        now = state.getCurrentWatermarkMs()
        before = task["updates"], task["refused"]
        waiting = advance(task, waiting, now, most_retries)
        state.update((json.dumps([task, waiting]),))
        wake = [e["at"] for e in waiting] + ([task["next_attempt_at"]] if task["next_attempt_at"] is not None else [])
        if wake:
            state.setTimeoutTimestamp(max(min(wake), now + 1))
        if (task["updates"], task["refused"]) != before:
            yield pd.DataFrame([{"task_id": key[0]} | task])[[f.split(" ")[0] for f in TASKS.split(", ")]].astype({n: "Int64" for n in times})

    told = arriving.where(F.col("task_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isNotNull())
    kept = told.withWatermark("at", late).withColumn("ms", F.unix_millis("at")).groupBy("task_id")
    changes = kept.applyInPandasWithState(run, TASKS.replace(" timestamp", " long"), "state string", "update", GroupStateTimeout.EventTimeTimeout)
    return changes.withColumns({n: F.timestamp_millis(n) for n in times})


def keep(tasks: DataFrame, path: str, checkpoint: str):
    """Start a query that appends the changes of ``follow`` to the table at ``path`` until the source is exhausted.

    A batch goes to a folder of its own number, which a repeated batch writes anew, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return tasks.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(changes: DataFrame) -> DataFrame:
    """One row of each task: the last of its changes."""
    names = [f.split(" ")[0] for f in TASKS.split(", ")]
    last = F.max_by(F.struct(*names), F.struct("updates", "refused"))
    return changes.groupBy("task_id").agg(last.alias("task")).select("task.*")
