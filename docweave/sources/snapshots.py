"""JSON snapshots of chunk collections, as one record a line, read forgivingly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.functions import vectors as V

SCHEMA = "id string, document_id string, content string, vector array<double>, page_number string, chunk_index int, created_at string"


def load_chunks(spark: SparkSession, path: str, dimension: int = V.DIMENSION) -> tuple[DataFrame, DataFrame]:
    """Chunks, and the lines that aren't records.

    Blank contents fall out; missing or empty vectors are embedded anew, others padded or cut; a missing
    index is 0, a missing document 'default', a missing id the document and the index.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{SCHEMA}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    broken = F.col("r").isNull() | F.col("r._corrupt").isNotNull()
    bad = parsed.where(broken).select("r.id", F.col("value").alias("line"))
    good = parsed.where(~broken).select("r.*").drop("_corrupt")
    good = good.where(F.length(X.strip(F.coalesce("content", F.lit("")))) > 0)
    usable = F.coalesce(F.size("vector") > 0, F.lit(False))
    document = F.coalesce("document_id", F.lit("default"))
    chunks = good.select(
        F.coalesce("id", F.concat_ws("_", document, F.coalesce("chunk_index", F.lit(0)))).alias("chunk_id"), document.alias("document_id"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "content",
        X.page_number(F.col("page_number")).alias("page_number"), F.when(usable, V.fitted(F.col("vector"), dimension)).otherwise(V.hash_embedding(F.col("content"), dimension)).alias("vector"), X.timestamp(F.col("created_at")).alias("created_at"),
    )
    return chunks, bad


def save_chunks(chunks: DataFrame, path: str) -> None:
    chunks.withColumnRenamed("chunk_id", "id").write.mode("errorifexists").json(path)
