"""A table of answers by key, of bounded size: first in, first out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: how many summaries are remembered.
MOST_SUMMARIES = 256
#: Counts up when prompts change, so that what older ones gave is not used.
PROMPT_VERSION = 1
ENTRIES = "key string, summary string, place long"


def summary_key(namespace: Column, document: Column, query: Column, limit: Column, revision: Column, graph_mode: Column, graph_context: Column) -> Column:
    """SHA-256 of all that a document's summary depends on, as JSON with fixed names.

    ``revision`` is an array of (id, version, digest of the content) of the chunks that are read, in order; so a
    changed chunk, a new version, another question, limit or graph all miss.
    """
    parts = F.struct(F.lit(PROMPT_VERSION).alias("prompt_version"), namespace.alias("namespace"), document.alias("document_id"), query.alias("query"), limit.alias("limit"), revision.alias("revision"), graph_mode.alias("graph_mode"), graph_context.alias("graph_context"))
    return F.sha2(F.to_json(parts, {"ignoreNullFields": "false"}), 256)


def put(cache: DataFrame, new: DataFrame, order: str, most: int = MOST_SUMMARIES) -> DataFrame:
    """``cache`` (ENTRIES) after ``new`` (key, summary, and a column that orders them) went in one after the other.

    A key that is there keeps its place and takes the last value. Beyond ``most`` the first that went in fall
    out. Null keys are passed over. However many are new, no more than ``most`` of them are put in order.
    """
    last = new.where("key IS NOT NULL").groupBy("key").agg(F.max_by("summary", order).alias("fresh"), F.min(order).alias("first"))
    both = cache.join(last, "key", "full_outer").select("key", F.when(F.col("first").isNotNull(), F.col("fresh")).otherwise(F.col("summary")).alias("summary"), "place", "first")
    held = both.where("place IS NOT NULL").orderBy(F.desc("place")).limit(most).select("key", "summary", "place", F.lit(None).cast("long").alias("after"))
    added = both.where("place IS NULL").orderBy(F.desc("first"), F.desc("key")).limit(most)
    added = added.withColumn("after", F.row_number().over(Window.orderBy("first", "key")).cast("long")).select("key", "summary", "place", "after")
    rows = held.unionByName(added)
    end = F.coalesce(F.max("place").over(Window.partitionBy()), F.lit(0))
    placed = rows.withColumn("place", F.coalesce("place", end + F.col("after"))).drop("after")
    return placed.orderBy(F.desc("place")).limit(most)
