"""Documents that keep arriving: chunked, embedded and merged into a versioned chunk table; live working memory."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import vectors as V
from docweave.operators.chunks import chunk_documents, replace_documents
from docweave.sources import tables

#: Parts of a chunk table; a micro-batch rewrites those that its documents lie in.
PARTS = 64


def last_arrivals(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row of each doc_id: the one with the greatest ``order``; of equals (or without it) the greatest text, so repeats agree."""
    by = [F.desc("text")] if order is None else [F.desc(order), F.desc("text")]
    return batch.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy(*by))).where("_k = 1").drop("_k")


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a query keeps in its checkpoint, over restarts."""
    return json.loads("".join(r[0] for r in spark.read.text(f"{checkpoint}/metadata").collect()))["id"]


def ingest(stream: DataFrame, path: str, checkpoint: str, as_of: str, embed: bool = True, order: str | None = None, parts: int = PARTS):
    """Start a query that replaces each arriving document (doc_id, text) in the chunk table at ``path``.

    Of a document that arrives twice in one micro-batch the last by the column ``order`` counts. Each
    micro-batch writes one version, in which only the parts that its documents lie in are rewritten. The version's
    pointer tells the last batch of each query (by the id in its checkpoint), so a batch that comes again after
    a crash is passed over, and other queries' batches, also those of a new checkpoint, are not.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = _query_id(spark, checkpoint)
        last = tables.done(spark, path, query)
        if last is not None and number <= last:
            return
        fresh = chunk_documents(last_arrivals(batch, order))
        if embed:
            fresh = fresh.withColumn("vector", V.hash_embedding(F.col("content")))
        touched = tables.parts_of(batch.select(F.col("doc_id").cast("string").alias("document_id")), "document_id", parts)
        if not touched:
            return
        old = tables.read_parts(spark, path, touched)
        if old is None:
            stamp = F.lit(as_of).cast("timestamp_ntz")
            rows = fresh.select("*", stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(1).alias("document_version"))
        else:
            rows = replace_documents(old, fresh, as_of)
        tables.write_parts(rows, path, "document_id", parts, touched, mark=(query, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(events: DataFrame, window: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Memories per user and window of a stream (ts, user_id), with a watermark that bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("memories"))
