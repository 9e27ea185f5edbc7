"""Documents to chunks, and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X


#: Fixed value: the first line of a collection's statistics.
STATS_HEAD = "📊 RAG知识库统计:"


def chunk_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile: str = "packed", size: int = X.CHUNK_SIZE, overlap: int = X.CHUNK_OVERLAP) -> DataFrame:
    """One row for each chunk: document_id, chunk_index, chunk_id, content.

    ``profile`` 'packed' packs paragraphs, 'windows' cuts plain windows. Blank texts have no chunks.
    """
    cut = {"packed": X.packed_chunks, "windows": X.windows}[profile](F.coalesce(text_col, F.lit("")), size, overlap)
    rows = docs.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(cut).alias("chunk_index", "content"))
    return rows.select("document_id", "chunk_index", F.concat_ws("_", "document_id", "chunk_index").alias("chunk_id"), "content")


def prepare_segments(segments: DataFrame, profile: str = "packed") -> DataFrame:
    """Chunks of page-structured documents: (document_id, segment_index, page_number, content) rows; indexes run on over segments."""
    cut = {"packed": X.packed_chunks, "windows": X.windows}[profile](F.coalesce("content", F.lit("")))
    rows = segments.select("document_id", "segment_index", X.page_number(F.col("page_number")).alias("page_number"), F.posexplode(cut).alias("_at", "content"))
    order = Window.partitionBy("document_id").orderBy("segment_index", "_at")
    rows = rows.withColumn("chunk_index", F.row_number().over(order) - 1)
    return rows.select("document_id", "chunk_index", F.concat_ws("_", "document_id", "chunk_index").alias("chunk_id"), "page_number", "content")


def replace_documents(old: DataFrame, new: DataFrame, as_of: str, allow_empty: bool = False, emptied: DataFrame | None = None) -> DataFrame:
    """The chunk table after replacing the documents in ``new``.

    A replaced document keeps its first created_at and counts its version up; other documents stay. With
    ``allow_empty`` the documents named in ``emptied`` (document_id) lose their chunks; else nothing new
    leaves the old chunks as they are.
    """
    stamp = F.lit(as_of).cast("timestamp_ntz")
    was = old.groupBy("document_id").agg(F.min("created_at").alias("_created"), F.max("document_version").alias("_version"))
    fresh = new.join(was, "document_id", "left").select(*new.columns, F.coalesce("_created", stamp).alias("created_at"), stamp.alias("updated_at"), (F.coalesce("_version", F.lit(0)) + 1).alias("document_version"))
    gone = new.select("document_id").distinct()
    if allow_empty and emptied is not None:
        gone = gone.union(emptied.select("document_id")).distinct()
    return old.join(gone, "document_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def append_chunks(old: DataFrame, new: DataFrame, profile: str = "count") -> DataFrame:
    """``new`` chunks behind the old ones of their document; indexes go on from the count, or with 'max' from the largest."""
    last = F.count("*") if profile == "count" else F.max("chunk_index") + 1
    after = old.groupBy("document_id").agg(last.alias("_after"))
    moved = new.join(after, "document_id", "left").withColumn("chunk_index", (F.col("chunk_index") + F.coalesce("_after", F.lit(0))).cast("int")).drop("_after")
    return old.unionByName(moved.withColumn("chunk_id", F.concat_ws("_", "document_id", "chunk_index")), allowMissingColumns=True)


def upsert_points(old: DataFrame, new: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """The last write of each key; it keeps the key's first place."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(key)
    ranked = both.withColumn("_n", F.row_number().over(w.orderBy(F.col(seq).desc()))).withColumn("_first", F.min(seq).over(w))
    return ranked.where("_n = 1").withColumn(seq, F.col("_first")).drop("_n", "_first")


def stats(chunks: DataFrame, count_blank: bool = True) -> DataFrame:
    """document_count and chunk_count; blank document ids count as a document or not."""
    ids = F.col("document_id") if count_blank else F.nullif(X.strip(F.col("document_id")), F.lit(""))
    return chunks.agg(F.countDistinct(ids).alias("document_count"), F.count("*").alias("chunk_count"))


def sample_evenly(rows: DataFrame, partition: list[str], order: list[str], limit: int) -> DataFrame:
    """At most ``limit`` rows of each group, spread evenly from the first to the last (half positions to even)."""
    w = Window.partitionBy(*partition)
    numbered = rows.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    if limit == 1:
        return numbered.where("_i = 0").drop("_i", "_n")
    picks = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda p: F.bround(p * (F.col("_n") - 1) / F.lit(limit - 1)).cast("int"))
    return numbered.where((F.col("_n") <= limit) | F.array_contains(picks, F.col("_i"))).drop("_i", "_n")


def summary_by_page(chunks: DataFrame, limit: int = 12) -> DataFrame:
    """The first chunk of each page (no page: one page at the end), sampled evenly."""
    page = F.coalesce(F.col("page_number").try_cast("int"), F.lit(999999))
    first = chunks.withColumn("_page", page).withColumn("_k", F.row_number().over(Window.partitionBy("document_id", "_page").orderBy("chunk_index"))).where("_k = 1").drop("_k")
    return sample_evenly(first, ["document_id"], ["_page"], limit).withColumnRenamed("_page", "page")


def batches(windows: DataFrame, most_rows: int = 5, most_chars: int = 4000) -> DataFrame:
    """Windows (document_id, position, content) with ``batch``, filled in order up to both limits."""
    per = windows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("position", F.length("content").alias("n")))).alias("w"))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("rows"), F.lit(0).alias("chars"), F.array().cast("array<struct<position:int,batch:int>>").alias("out"))

    def step(a, x):
        full = (a["rows"] > 0) & ((a["rows"] >= most_rows) | (a["chars"] + x["n"] > most_chars))
        b = F.when(full, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(full, 1).otherwise(a["rows"] + 1).alias("rows"), F.when(full, x["n"]).otherwise(a["chars"] + x["n"]).alias("chars"), F.concat(a["out"], F.array(F.struct(x["position"].cast("int").alias("position"), b.alias("batch")))).alias("out"))

    return per.select("document_id", F.explode(F.aggregate("w", start, step, lambda a: a["out"])).alias("x")).select("document_id", "x.position", "x.batch")


def document_ids(chunks: DataFrame, namespace: str | None = None) -> DataFrame:
    """The distinct ids of a collection (or of one namespace of it), stripped, without blanks, in order."""
    rows = chunks if namespace is None else chunks.where(F.col("namespace") == namespace)
    return rows.select(X.strip(F.col("document_id").cast("string")).alias("document_id")).where("document_id <> ''").distinct().orderBy("document_id")


def ordered_chunks(chunks: DataFrame, document_id: str | None = None, namespace: str | None = None) -> DataFrame:
    """A document's chunks (without an id: all documents') by index, then id."""
    rows = chunks if namespace is None else chunks.where(F.col("namespace") == namespace)
    rows = rows if document_id is None else rows.where(F.col("document_id") == document_id.strip())
    return rows.orderBy("document_id", F.coalesce("chunk_index", F.lit(0)), "chunk_id")


def points_of_arrays(rows: DataFrame) -> DataFrame:
    """(ids, vectors, metadata) arrays of one length as points; a missing id is the place in the array, a missing payload empty."""
    zipped = F.posexplode(F.arrays_zip("ids", "vectors", "metadata")).alias("place", "x")
    return rows.select(zipped).select(F.coalesce("x.ids", F.col("place").cast("string")).alias("id"), F.col("x.vectors").alias("vector"), F.col("x.metadata").alias("metadata"))


def stats_line(chunks: DataFrame, collection: str, namespace: str, dimension: int) -> DataFrame:
    """``stats`` of a collection as one text of lines."""
    names = ["collection_name", "rag_namespace", "document_count", "chunk_count", "dimension"]
    values = [F.lit(collection), F.lit(namespace), F.col("document_count").cast("string"), F.col("chunk_count").cast("string"), F.lit(str(dimension))]
    lines = [F.concat(F.lit(f"- {n}: "), v) for n, v in zip(names, values, strict=True)]
    return stats(chunks).select(F.concat_ws("\n", F.lit(STATS_HEAD), *lines).alias("text"))
