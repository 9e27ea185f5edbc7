"""What a folder of an older installation holds, by the kinds that can be imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Endings, names and folders that tell kinds of files apart.
HISTORY_NAME = "learning_history_user123.json"
DOCUMENT_ENDINGS, REPORT_ENDINGS = (".pdf", ".docx", ".txt", ".md"), (".md", ".docx")
DOCUMENT_FOLDERS = ("uploads", "documents")
KINDS = ("history", "documents", "rag_cache", "reports", "memory", "skipped")


def kind_of(path: Column) -> Column:
    """The kind of a file by its path: the first that fits of history, documents, rag_cache, reports, memory; else skipped."""
    lower = F.lower(path)
    name, folder = F.regexp_extract(path, r"([^/]*)$", 1), F.regexp_extract(lower, r"^(.*)/[^/]*$", 1)
    ends = lambda endings: lower.rlike("(?:" + "|".join(e.replace(".", r"\.") for e in endings) + ")$")
    json = lower.rlike(r"\.json$")
    return (
        F.when(name == HISTORY_NAME, "history")
        .when(ends(DOCUMENT_ENDINGS) & lower.rlike(rf"(?:^|/)(?:{'|'.join(DOCUMENT_FOLDERS)})/"), "documents")
        .when(json & F.lower(name).contains("rag"), "rag_cache")
        .when(ends(REPORT_ENDINGS) & folder.contains("report"), "reports")
        .when(json & F.lower(name).contains("memor"), "memory")
        .otherwise("skipped")
    )


def summary(files: DataFrame) -> DataFrame:
    """``files`` (path, length) by kind, those that are missing included: kind, files, bytes."""
    counts = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS] + [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("length"))), F.lit(0)).alias(f"b_{k}") for k in KINDS]
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("files"), F.col(f"b_{k}").alias("bytes")) for k in KINDS])).alias("x")
    return files.withColumn("kind", kind_of(F.col("path"))).agg(*counts).select(rows).select("x.*")
