"""Import tasks as a table: claims, transitions, retries, progress. Every change is a new version of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: States of a task, those in which it isn't over, and endings of files that can be imported.
STATUSES = ("queued", "running", "retry_wait", "succeeded", "failed", "cancelled")
ACTIVE = ("queued", "running", "retry_wait")
SUFFIXES = (".txt", ".md", ".pdf", ".docx")
#: Percent of progress at a stage's start and end, and seconds before each retry.
STAGE_RANGES = {"parsing": (10, 25), "chunking": (25, 40), "embedding": (40, 80), "persisting": (80, 92), "committing": (92, 99)}
RETRY_SECONDS = (2, 10, 30)
MOST_FILES, MOST_FILE_BYTES, MOST_BATCH_BYTES = 20, 100 << 20, 500 << 20


def batch_problems(files: DataFrame) -> DataFrame:
    """Each batch of ``files`` (batch_id, original_name, size_bytes) with what is wrong with it; null if nothing."""
    suffix = F.lower(F.regexp_extract("original_name", r"(\.[^./\\]+)$", 1))
    bad_name = F.col("original_name").rlike(r"[/\\\x00]") | F.col("original_name").isin("", ".", "..") | ~suffix.isin(*SUFFIXES)
    out = files.groupBy("batch_id").agg(F.count("*").alias("files"), F.max("size_bytes").alias("largest"), F.sum("size_bytes").alias("bytes"), F.max(bad_name.cast("int")).alias("bad"))
    why = F.when(F.col("files") > MOST_FILES, "too many files").when(F.col("bad") == 1, "bad name").when(F.col("largest") > MOST_FILE_BYTES, "file too large").when(F.col("bytes") > MOST_BATCH_BYTES, "batch too large")
    return out.select("batch_id", "files", "bytes", why.alias("problem"))


def batch_summary(batches: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each batch with its number of tasks in all and in each status."""
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES]
    per = tasks.groupBy("batch_id", "user_id").agg(F.count("*").alias("total"), *counts)
    names = ["total", *STATUSES]
    return batches.join(per, ["batch_id", "user_id"], "left").select(*batches.columns, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


def listed(batches: DataFrame, tasks: DataFrame, limit: int = 50) -> DataFrame:
    """Each user's newest batches with their counts, ``place`` from 1; of one time the larger id first. Only what is listed is counted."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("batch_id"))
    newest = batches.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    return batch_summary(newest, tasks.join(newest.select("batch_id", "user_id"), ["batch_id", "user_id"], "left_semi"))


def claimable(tasks: DataFrame, as_of: str, blocked: list | None = None, limit: int = 4) -> DataFrame:
    """The next tasks to run: for each user without a running one the earliest that is due, ``limit`` in all."""
    now = F.lit(as_of).cast("timestamp_ntz")
    due = (F.col("status") == "queued") | (F.col("status") == "retry_wait") & (F.col("next_attempt_at") <= now)
    rows = tasks.where(due).join(tasks.where("status = 'running'").select("user_id").distinct(), "user_id", "left_anti")
    rows = rows if not blocked else rows.where(~F.col("user_id").isin(blocked))
    first = rows.withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "task_id"))).where("_k = 1").drop("_k")
    return first.orderBy("created_at", "task_id").limit(limit)


def cancel_outcome() -> Column:
    return F.when(F.col("status").isin("queued", "retry_wait"), "cancelled").when((F.col("status") == "running") & (F.col("stage") == "committing"), "not_cancellable").when(F.col("status") == "running", "cancel_requested").otherwise("unchanged")


def request_cancel(tasks: DataFrame, wanted: Column, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    outcome = F.when(wanted, cancel_outcome())
    rows = tasks.withColumn("_o", outcome)
    done = F.col("_o") == "cancelled"
    set_ = F.coalesce(done, F.lit(False))
    return rows.withColumns({
        "status": F.when(set_, "cancelled").otherwise(F.col("status")),
        "stage": F.when(set_, "cancelled").otherwise(F.col("stage")),
        "next_attempt_at": F.when(~set_, F.col("next_attempt_at")),
        "cancel_requested_at": F.when(F.col("_o").isin("cancelled", "cancel_requested"), F.coalesce("cancel_requested_at", now)).otherwise(F.col("cancel_requested_at")),
    }).drop("_o")


def record_failure(tasks: DataFrame, failures: DataFrame, as_of: str) -> DataFrame:
    """Running tasks named in ``failures`` (task_id, error_code, retryable, summary) wait for a retry or fail."""
    now = F.lit(as_of).cast("timestamp_ntz")
    f = failures.select("task_id", F.col("error_code").alias("_code"), F.col("retryable").alias("_again"), F.substring("summary", 1, 500).alias("_why"))
    hit = F.col("_code").isNotNull() & (F.col("status") == "running")
    again = hit & F.col("_again") & (F.col("auto_retry_count") < F.col("max_auto_retries"))
    wait = F.element_at(F.array(*map(F.lit, RETRY_SECONDS)), F.least(F.col("auto_retry_count") + 1, F.lit(len(RETRY_SECONDS))))
    return tasks.join(f, "task_id", "left").withColumns({
        "next_attempt_at": F.when(again, F.timestamp_add("SECOND", wait, now)).otherwise(F.when(~hit, F.col("next_attempt_at"))),
        "error_code": F.when(hit, F.col("_code")).otherwise(F.col("error_code")),
        "error_summary": F.when(hit, F.col("_why")).otherwise(F.col("error_summary")),
        "status": F.when(again, "retry_wait").when(hit, "failed").otherwise(F.col("status")),
        "auto_retry_count": F.col("auto_retry_count") + F.when(again, 1).otherwise(0),
    }).drop("_code", "_again", "_why")


def retry_failed(tasks: DataFrame, wanted: Column) -> DataFrame:
    hit = wanted & (F.col("status") == "failed")
    return tasks.withColumns({"manual_retry_count": F.col("manual_retry_count") + hit.cast("int"), "auto_retry_count": F.when(hit, 0).otherwise(F.col("auto_retry_count")), "status": F.when(hit, "queued").otherwise(F.col("status"))})


def recover(tasks: DataFrame, staged: DataFrame) -> DataFrame:
    """After a crash: running tasks queue again where ``staged`` (task_id) has their file, else fail."""
    there = staged.select("task_id", F.lit(True).alias("_there")).distinct()
    running = F.col("status") == "running"
    code = F.when(running & F.col("_there").isNull(), "staged_file_missing").otherwise(F.col("error_code"))
    return tasks.join(there, "task_id", "left").withColumn("error_code", code).withColumn("status", F.when(running & F.col("_there"), "queued").when(running, "failed").otherwise(F.col("status"))).drop("_there")


def stage_percent(stage: Column, completed: Column, total: Column) -> Column:
    """Progress within a stage's range; null for a stage that has none."""
    ratio = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), completed / total))).otherwise(0.0)
    out = F.lit(None).cast("int")
    for name, (start, end) in STAGE_RANGES.items():
        value = F.lit(99) if name == "committing" else (start + F.floor((end - start) * ratio)).cast("int")
        out = F.when(stage == name, value).otherwise(out)
    return out


def monotone_progress(events: DataFrame) -> DataFrame:
    """``events`` (task_id, position, stage, completed, total) with ``progress``, which never falls and is 10 at first."""
    so_far = Window.partitionBy("task_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("progress", F.greatest(F.lit(10), F.max(stage_percent(F.col("stage"), F.col("completed"), F.col("total"))).over(so_far)))


def transition(tasks: DataFrame, wanted: Column, expected: Column, **changes: Column) -> tuple[DataFrame, DataFrame]:
    """A guarded update: ``changes`` where ``wanted`` and ``expected`` hold; also the wanted tasks that weren't as expected."""
    hit = F.coalesce(wanted & expected, F.lit(False))
    after = tasks.withColumns({name: F.when(hit, value).otherwise(F.col(name)) for name, value in changes.items()})
    return after, tasks.where(wanted & ~F.coalesce(expected, F.lit(False))).select("task_id", "status")


def begin_committing(tasks: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    """The last point where a task can be cancelled: running, not committing yet, no cancel asked for."""
    return transition(tasks, wanted, (F.col("status") == "running") & (F.col("stage") != "committing") & F.col("cancel_requested_at").isNull(), stage=F.lit("committing"))


def mark_succeeded(tasks: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    none = F.lit(None).cast("string")
    return transition(tasks, wanted, F.col("status") == "running", status=F.lit("succeeded"), error_code=none, error_summary=none)


def mark_cancelled(tasks: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    return transition(tasks, wanted, (F.col("status") == "running") & F.col("cancel_requested_at").isNotNull(), status=F.lit("cancelled"), stage=F.lit("cancelled"))


def release_claim(tasks: DataFrame, wanted: Column) -> tuple[DataFrame, DataFrame]:
    return transition(tasks, wanted, F.col("status") == "running", status=F.lit("queued"), auto_retry_count=F.greatest(F.lit(0), F.col("auto_retry_count") - 1))


def active(tasks: DataFrame) -> DataFrame:
    """Users with tasks that are queued, running or waiting."""
    return tasks.where(F.col("status").isin(*ACTIVE)).select("user_id").distinct()


def submit(files: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New batches, their queued tasks, and the batches that are refused.

    ``files`` (task_id, batch_id, user_id, document_id, original_name, size_bytes). A batch is refused with a
    problem of ``batch_problems``, or if its files are of several users; then none of its tasks is made.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    users = files.groupBy("batch_id").agg(F.countDistinct("user_id").alias("_users"))
    checked = batch_problems(files).join(users, "batch_id").withColumn("problem", F.when(F.col("_users") != 1, "several users").otherwise(F.col("problem")))
    good = checked.where("problem IS NULL").select("batch_id")
    kept = files.join(good, "batch_id", "left_semi")
    suffix = F.lower(F.regexp_extract("original_name", r"(\.[^./\\]+)$", 1))
    tasks = kept.select("task_id", "batch_id", "user_id", "document_id", "original_name", suffix.alias("file_suffix"), "size_bytes", F.lit("queued").alias("status"), F.lit("queued").alias("stage"), F.lit(0).alias("progress"), now.alias("created_at"), now.alias("updated_at"))
    batches = kept.select("batch_id", "user_id", now.alias("created_at"), now.alias("updated_at")).distinct()
    return batches, tasks, checked.where("problem IS NOT NULL").select("batch_id", "problem")


def with_chunking_boundary(events: DataFrame) -> DataFrame:
    """``events`` (task_id, position, stage, completed, total) with one event 'chunking' complete before each task's first 'embedding'."""
    first = events.where("stage = 'embedding'").groupBy("task_id").agg(F.min_by("total", "position").alias("total"), F.min("position").alias("position"))
    done = first.select("task_id", (F.col("position") - 0.5).alias("position"), F.lit("chunking").alias("stage"), F.col("total").alias("completed"), "total")
    return events.withColumn("position", F.col("position").cast("double")).unionByName(done.withColumn("position", F.col("position").cast("double")), allowMissingColumns=True)
