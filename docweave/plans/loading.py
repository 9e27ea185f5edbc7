"""Loading, deleting and clearing documents as one step over chunks, history, memories and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.operators import chunks as C
from docweave.sources import library as L
from docweave.sources.library import Change

#: A memory of an import, its kind and importance.
LOADED, LOADED_EVENT, LOADED_IMPORTANCE = "用户导入了文档：", "document_loaded", 0.8


def _known(spark: SparkSession, root: str, name: str, empty: str) -> DataFrame:
    rows = L.read(spark, root, name)
    return rows if rows is not None else spark.createDataFrame([], empty)


def load(documents: DataFrame, root: str, user: str, as_of: str, task: str, session: Column | None = None, profile: str = "packed", embed: bool = True) -> bool:
    """Import ``documents`` (document_id, text; document_name and document_path if there) into the library at ``root``.

    Chunks of a document replace its earlier ones (it keeps created_at and counts its version up), its history
    record takes the place of an earlier one, and an episodic memory tells of the import; all of it becomes
    visible together, once for each ``task`` (False if it was). Documents without an id are left out; a
    document without text has a record and no chunks. Of rows with one id one is taken, the greatest text.
    """
    spark = documents.sparkSession
    stamp = F.lit(as_of).cast("timestamp_ntz")
    given = set(documents.columns)
    name = F.col("document_name") if "document_name" in given else F.col("document_id")
    path = F.col("document_path") if "document_path" in given else F.lit(None).cast("string")
    named = documents.where(F.col("document_id").isNotNull()).select(F.col("document_id").cast("string").alias("document_id"), "text", name.cast("string").alias("document_name"), path.alias("document_path"))
    new = named.groupBy("document_id").agg(F.max_by(F.struct("text", "document_name", "document_path"), F.coalesce("text", F.lit(""))).alias("x")).select("document_id", "x.*")
    records = _known(spark, root, "documents", "user_id string, document_id string, first_loaded_at timestamp_ntz, document_version int")
    was = records.where(F.col("user_id") == user).select(F.col("document_id").alias("was_id"), F.col("first_loaded_at").alias("was_at"), F.col("document_version").alias("was_version"))
    record = new.join(was, F.col("document_id") == F.col("was_id"), "left").select(
        F.lit(user).alias("user_id"), "document_id", "document_name", "document_path", F.lower(F.regexp_extract("document_name", r"(\.[^./\\]+)$", 1)).alias("file_suffix"),
        stamp.alias("loaded_at"), F.coalesce("was_at", stamp).alias("first_loaded_at"), (F.coalesce("was_version", F.lit(0)) + 1).alias("document_version"), F.lit(task).alias("import_task_id"),
        (F.lit(None).cast("string") if session is None else session).alias("session_id"),
    )
    chunks = C.chunk_documents(new, "document_id", profile=profile)
    if embed:
        chunks = chunks.withColumn("vector", V.hash_embedding(F.col("content")))
    chunks = chunks.join(record.select("document_id", "document_version", F.col("first_loaded_at").alias("created_at"), F.col("loaded_at").alias("updated_at")), "document_id")
    event = record.select(
        F.concat_ws("-", F.lit("import"), F.lit(task), "document_id").alias("memory_id"), "user_id", F.lit("episodic").alias("memory_type"), F.concat(F.lit(LOADED), "document_name").alias("content"),
        F.lit(LOADED_IMPORTANCE).alias("importance"), F.lit(LOADED_EVENT).alias("event_type"), "session_id", "document_id", stamp.alias("ts"),
    )
    ids = new.select("document_id")
    changes = {"chunks": Change(chunks, ids), "documents": Change(record, ids.withColumn("user_id", F.lit(user)), ("user_id", "document_id")), "memories": Change(event, keys=("memory_id",))}
    return L.commit(spark, root, changes, task)


def delete(spark: SparkSession, root: str, documents: DataFrame) -> dict[str, int]:
    """Remove documents (document_id), their records and the questions that name them; how many rows of each go.

    Tombstones alone are written: no row of another document is written anew.
    """
    ids = documents.select(F.col("document_id").cast("string").alias("document_id")).distinct()
    changes, removed = {}, {}
    for name in ("chunks", "documents"):
        rows = L.read(spark, root, name)
        if rows is not None:
            removed[name] = rows.join(ids, "document_id", "left_semi").count()
            changes[name] = Change(gone=ids)
    questions = L.read(spark, root, "questions")
    if questions is not None:
        told = questions.select("question_id", F.explode(F.array_union(F.array("document_id"), F.coalesce("document_ids", F.array().cast("array<string>")))).alias("document_id"))
        asked = told.join(ids, "document_id", "left_semi").select("question_id").distinct()
        removed["questions"] = asked.count()
        changes["questions"] = Change(gone=asked, keys=("question_id",))
    L.commit(spark, root, changes)
    return removed


def clear(spark: SparkSession, root: str) -> dict[str, int]:
    """Remove all chunks, document records and questions in one step; notes and memories stay. How many rows of each go."""
    names = ("chunks", "documents", "questions")
    removed = {n: 0 if (rows := L.read(spark, root, n)) is None else rows.count() for n in names}
    L.commit(spark, root, {n: Change(all_gone=True) for n in names})
    return removed
