"""Tasks kept by a stream, cut into micro-batches in any way, against the batch transitions over the same events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from docweave.operators import imports as T
from docweave.streaming import tasks as S

T0 = dt.datetime(2024, 1, 1)
STEP = 5  # seconds between events of a task; retries fall due after 2, 10 and 30


def story(seed: int, tasks: int = 12, steps: int = 14) -> list[tuple]:
    """At each step each task has one event or none; the first is its submission."""
    rng = random.Random(seed)
    rows = []
    for k in range(steps):
        for t in range(tasks):
            kind = "submit" if k == 0 else rng.choice(["claim", "claim", "progress", "progress", "commit", "succeed", "fail", "fail", "fail", "cancel", "release", "retry", None])
            if kind:
                stage = rng.choice(["parsing", "chunking", "embedding"]) if kind == "progress" else None
                percent = {"parsing": 20, "chunking": 30, "embedding": 55}.get(stage)
                rows.append((f"t{t}", T0 + dt.timedelta(seconds=STEP * k), k, kind, stage, percent, rng.random() < 0.7, f"e{k}"))
    return rows


def by_batch_transitions(spark, rows: list[tuple]) -> dict:
    """The same events through the functions on whole tables, step by step."""
    kinds = "task_id string, status string, stage string, auto_retry_count int, max_auto_retries int, manual_retry_count int, next_attempt_at timestamp_ntz, cancel_requested_at timestamp_ntz, error_code string, error_summary string"
    names = [k.split(" ")[0] for k in kinds.split(", ")]
    now: list[tuple] = []
    for k in sorted({r[2] for r in rows}):
        here = {r[0]: r for r in rows if r[2] == k}
        at = str(T0 + dt.timedelta(seconds=STEP * k))
        now += [(r[0], "queued", "queued", 0, 3, 0, None, None, None, None) for r in here.values() if r[3] == "submit"]
        df = spark.createDataFrame(now, kinds).coalesce(1)
        due = (F.col("status") == "retry_wait") & (F.col("next_attempt_at") <= F.lit(at).cast("timestamp_ntz"))
        df, _ = T.transition(df, due, F.lit(True), next_attempt_at=F.lit(None).cast("timestamp_ntz"), status=F.lit("queued"))
        of = lambda kind: F.col("task_id").isin([t for t, r in here.items() if r[3] == kind])  # noqa: E731, B023
        before = df
        df, _ = T.transition(df, of("claim"), F.col("status") == "queued", status=F.lit("running"))
        stages = F.create_map(*(F.lit(x) for t, r in here.items() for x in (t, r[4] or "")), F.lit(""), F.lit(""))
        df, _ = T.transition(df, of("progress"), F.col("status") == "running", stage=stages[F.col("task_id")])
        df, _ = T.begin_committing(df, of("commit"))
        df, _ = T.mark_succeeded(df, of("succeed"))
        df, _ = T.transition(df, of("succeed"), F.col("status") == "succeeded", stage=F.lit("succeeded"))
        stop = of("fail") & (F.col("stage") != "committing")
        df, _ = T.mark_cancelled(df, stop)
        failed = [(t, r[7], r[6], "why") for t, r in here.items() if r[3] == "fail"]
        df = T.record_failure(df, spark.createDataFrame(failed, "task_id string, error_code string, retryable boolean, summary string"), at)
        df = df.withColumn("stage", F.when(of("fail") & (F.col("status") == "retry_wait"), "queued").when(of("fail") & (F.col("status") == "failed"), "failed").otherwise(F.col("stage")))
        df = T.request_cancel(df, of("cancel"), at)
        df, _ = T.transition(df, of("release"), F.col("status") == "running", status=F.lit("queued"), stage=F.lit("queued"))
        df, _ = T.transition(df, of("retry"), F.col("status") == "failed", stage=F.lit("queued"), status=F.col("status"))
        df = T.retry_failed(df, of("retry"))
        del before
        now = [tuple(r) for r in df.select(*names).collect()]
    return {r[0]: (r[1], r[2], r[3], r[5], r[7], r[8]) for r in now}


def run(spark, folder, cuts: list[list[tuple]]) -> dict:
    """Each cut arrives as a file of its own and is one micro-batch; the query is started anew for each."""
    source, table, checkpoint = (f"file://{folder}/{x}" for x in ("in", "table", "checkpoint"))
    for rows in cuts:
        spark.createDataFrame(rows, S.EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(S.EVENTS).parquet(source)
        S.keep(S.follow(stream, late="40 seconds"), table, checkpoint).awaitTermination(120)
    return {r.task_id: r for r in S.latest(spark.read.schema(S.TASKS).parquet(f"{table}/batch=*")).collect()}


def plain(rows: list[tuple]) -> dict:
    out = {}
    for r in rows:
        out.setdefault(r[0], (S.new_task(), []))[1].append({"at": int((r[1] - dt.datetime(1970, 1, 1)).total_seconds() * 1000), "seq": r[2], "kind": r[3], "stage": r[4], "percent": r[5], "retryable": r[6], "error_code": r[7]})
    for task, events in out.values():
        S.advance(task, events, 1 << 60)
    return {t: task for t, (task, _) in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_cut_ends_as_the_batch_transitions(spark, tmp_path, seed):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    rows = story(seed)
    last = [("clock", T0 + dt.timedelta(hours=1), 0, "submit", None, None, None, None)]
    want = by_batch_transitions(spark, [r for r in rows])
    rng = random.Random(seed)
    cut = rng.choice([2, 3])
    shuffled = sorted(rows, key=lambda r: r[2] + rng.random() * 6)  # up to 30 seconds late
    n = len(rows) // cut + 1
    parts = [shuffled[k : k + n] for k in range(0, len(rows), n)]
    parts[-1] = parts[-1] + parts[-1][:3] + [(None, T0, 0, "claim", None, None, None, None), ("t0", None, 0, "claim", None, None, None, None)]
    got = run(spark, tmp_path, [*parts, last])
    for task, (status, stage, auto, manual, cancel, code) in want.items():
        r = got[task]
        # the stream's clock runs on after the last event, so a retry that waited has fallen due by then
        status = "queued" if status == "retry_wait" else status
        assert (r.status, r.stage, r.auto_retry_count, r.manual_retry_count, r.cancel_requested_at, r.error_code) == (status, stage, auto, manual, cancel, code), task
    whole = plain(rows)
    for task, r in got.items():
        if task != "clock":
            assert (r.progress, r.attempts, r.refused, r.updates) == tuple(whole[task][n] for n in ("progress", "attempts", "refused", "updates"))


def test_a_retry_falls_due_without_an_event_of_its_task(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    one = [("a", at(0), 0, "submit", None, None, None, None), ("a", at(1), 1, "claim", None, None, None, None), ("a", at(2), 2, "fail", None, None, True, "slow"), ("b", at(43), 0, "submit", None, None, None, None)]
    waits = run(spark, tmp_path, [one])["a"]  # the watermark is at 3: the retry is due at 4
    assert (waits.status, waits.next_attempt_at) == ("retry_wait", at(4))
    later = run(spark, tmp_path, [[("b", at(60), 1, "claim", None, None, None, None)]])["a"]
    assert (later.status, later.next_attempt_at, later.updated_at) == ("queued", None, at(4))


def test_a_repeated_batch_is_written_once(spark, tmp_path, monkeypatch):
    """The query stops after its first batch is written and before it is committed."""
    folder = f"file://{tmp_path}"
    rows = story(3, tasks=3)
    spark.createDataFrame([*rows, ("clock", T0 + dt.timedelta(hours=1), 0, "submit", None, None, None, None)], S.EVENTS).coalesce(1).write.parquet(f"{folder}/in")
    start = lambda: S.keep(S.follow(spark.readStream.schema(S.EVENTS).parquet(f"{folder}/in"), late="40 seconds"), f"{folder}/table", f"{folder}/checkpoint")
    writer = type(spark.range(1).write)
    write = writer.parquet

    def stopped(self, path, *args, **named):
        write(self, path, *args, **named)
        raise RuntimeError("Stop")

    with monkeypatch.context() as m:
        m.setattr(writer, "parquet", stopped)
        with pytest.raises(Exception, match="Stop"):
            start().awaitTermination(120)
    start().awaitTermination(120)
    got = {r.task_id: r for r in S.latest(spark.read.schema(S.TASKS).parquet(f"{folder}/table/batch=*")).collect()}
    whole = plain(rows)
    assert {t: got[t].updates for t in whole} == {t: task["updates"] for t, task in whole.items()}
