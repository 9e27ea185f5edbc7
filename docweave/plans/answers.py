"""Whole questions as plans: search, context that fits, prompt, generator, cited answer.

The generator is a callable from a list of prompts to a list of texts; it is the only step that isn't
deterministic, and it runs in batches on the executors.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.operators import cache as K
from docweave.operators import chunks as C
from docweave.operators import context as A
from docweave.operators import graph as G
from docweave.operators import points as P
from docweave.operators import retrieval as R

Generator = Callable[[list[str]], list[str]]
JOINT = "Answer from the sources below and cite them by their marks."
COMPARE = "Compare the documents below; cite the sources by their marks."
SUMMARY = "Summarise the document from the sources below and cite them by their marks."


def source_line(file_name: str = "file_name", document: str = "document_id", page: str = "page_number"):
    """file | id | page, without what is missing."""
    page_text = F.when(F.col(page).isNotNull(), F.concat(F.lit("page "), F.col(page)))
    return F.concat_ws(" | ", *([F.col(file_name)] if file_name else []), F.col(document), page_text)


def _cited(found: DataFrame) -> DataFrame:
    header = F.concat(F.lit("["), "citation_id", F.lit(" | "), source_line(""), F.lit("]\n"))
    return found.withColumn("content", F.concat(header, F.coalesce("content", F.lit(""))))


def _contexts(fitted: DataFrame, key: str, *more: Column) -> DataFrame:
    """The sources of each key in order of rank as one text, whether any was cut, and ``more`` aggregates."""
    return fitted.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("context"), F.max("truncated").alias("truncated"), *more)


def _prompt(instruction: str) -> Column:
    return F.concat(F.lit(instruction + "\n\n"), "context", F.lit("\n\nQuestion: "), F.coalesce("query", F.lit("")))


def _prompts(queries: DataFrame, fitted: DataFrame, instruction: str, *more: Column) -> DataFrame:
    return queries.select("query_id", "query").join(_contexts(fitted, "query_id", *more), "query_id").withColumn("prompt", _prompt(instruction))


def _each(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """Every document with every question (query_id as text, query) of a stated set, broadcast in blocks of ``points.QUERY_BLOCK``."""
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    rows = asked.toLocalIterator()
    blocks = [documents.sparkSession.createDataFrame(b, asked.schema) for b in iter(lambda: list(islice(rows, P.QUERY_BLOCK)), [])]
    return reduce(DataFrame.unionAll, (documents.join(F.broadcast(b), F.lit(True)) for b in blocks or [asked.limit(0)]))


def graph_lines(nodes: DataFrame, edges: DataFrame, questions: DataFrame, most: int = 1000) -> DataFrame:
    """Whole lines 'name type name' of the one-hop context of each question (query_id, document_id, query) as far as they fit."""
    name = nodes.select(F.col("graph_id"), "name")
    rows = G.context(nodes, edges, questions)
    rows = rows.join(name.toDF("source_id", "a"), "source_id").join(name.toDF("target_id", "b"), "target_id")
    lines = rows.select("query_id", F.col("rank").alias("position"), F.concat_ws(" ", "a", "type", "b").alias("line"))
    return A.lines_that_fit(lines, most)


def ask(chunks: DataFrame, queries: DataFrame, generator: Generator, limit: int = 5, mode: str = "vector", min_score: float = 0.12, documents: list[str] | None = None, window: int = A.WINDOW_TOKENS, graph: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """Each question (query_id, query, query_vector) with answer, sources (citation ids) and truncated.

    ``graph`` (query_id, line, position) adds lines below the sources. With ``digits`` scores are rounded
    before ranking. Questions without a hit have no row.
    """
    found = _cited(R.search(chunks, queries, limit, mode, min_score, documents=documents, digits=digits))
    most = A.budget(len(JOINT), window)
    fitted = A.fit(found.withColumn("protected", F.lit(False)), most, kept=["citation_id"])
    prompts = _prompts(queries, fitted, JOINT, F.sort_array(F.collect_set("citation_id")).alias("sources"))
    if graph is not None:
        lines = graph.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "\n").alias("lines"))
        prompts = prompts.join(lines, "query_id", "left").withColumn("prompt", F.concat_ws("\n\n", "prompt", "lines"))
    return A.generate(prompts.select("query_id", "prompt", "sources", "truncated"), generator).select("query_id", "answer", "sources", "truncated")


def compare(chunks: DataFrame, queries: DataFrame, generator: Generator, documents: list[str], limit: int = 8, window: int = A.WINDOW_TOKENS) -> DataFrame:
    """Each question answered over several documents: each one's best two sources stay, others compete.

    Adds missing, the documents without a hit.
    """
    rows = chunks.where(F.col("document_id").isin(documents)).withColumn("id", F.col("chunk_id"))
    near = None
    for d in documents:  # at most ten; each is pruned to its own rows
        one = P.nearest(rows.where(F.col("document_id") == d).select("id", "seq", "vector"), queries, 5).withColumn("document_id", F.lit(d))
        near = one if near is None else near.unionByName(one)
    chosen = A.compare_candidates(near, limit)
    full = chosen.join(rows.select("id", "page_number", "content"), "id")
    full = full.withColumn("citation_id", X.source_citation(F.col("document_id"), X.page_number(F.col("page_number")), X.digest(F.col("content"))))
    full = full.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("document_id", F.desc("score"), "id")))
    fitted = A.fit(_cited(full), A.budget(len(COMPARE), window))
    answered = A.generate(_prompts(queries, fitted, COMPARE).select("query_id", "prompt", "truncated"), generator)
    met = full.groupBy("query_id").agg(F.collect_set("document_id").alias("met"), F.sort_array(F.collect_set("citation_id")).alias("sources"))
    every = F.array(*map(F.lit, documents))
    return answered.join(met, "query_id").select("query_id", "answer", "sources", F.array_except(every, "met").alias("missing"), "truncated")


def summarise(chunks: DataFrame, queries: DataFrame, generator: Generator, documents: list[str] | None = None, limit: int = 12, window: int = A.WINDOW_TOKENS, cache: DataFrame | None = None, namespace: str = "default", graph: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One summary for each question and document (the map step), and one for each question over those.

    Each document is sampled evenly; its first, middle and last chunks are protected. ``cache`` (key,
    summary) spares the generator what was summarised before; the first result has the new keys (put them in with
    ``cache.put``). ``graph`` (query_id, document_id, context) is part of a key and of the prompt. The summaries of
    a question are cut by one ratio where they don't fit together; none is dropped.
    """
    rows = chunks if documents is None else chunks.where(F.col("document_id").isin(documents))
    picked = C.sample_evenly(rows, ["document_id"], ["chunk_index"], max(3, limit))
    own = Window.partitionBy("document_id")
    numbered = picked.withColumn("k", F.row_number().over(own.orderBy("chunk_index"))).withColumn("n", F.count("*").over(own))
    anchors = numbered.withColumn("protected", F.col("k").isin(1) | (F.col("k") == F.col("n")) | (F.col("k") == F.ceil(F.col("n") / 2)))
    cited = _cited(anchors.withColumn("citation_id", X.source_citation(F.col("document_id"), X.page_number(F.col("page_number")), X.digest(F.col("content")))))
    changed = F.col("document_version") if "document_version" in chunks.columns else F.lit(None).cast("int")
    revision = F.struct(F.col("k"), F.col("chunk_id").cast("string").alias("id"), changed.alias("version"), F.sha2("content", 256).alias("content"))
    told = cited.groupBy("document_id").agg(F.array_sort(F.collect_list(revision)).alias("revision"))
    # what a document gives doesn't depend on the question, so it is cut and joined once
    fitted = A.fit(cited.select(F.col("document_id").alias("query_id"), F.col("k").alias("rank"), (1.0 / F.col("k")).alias("score"), "content", "protected"), A.budget(len(SUMMARY), window))
    contexts = _contexts(fitted, "query_id").withColumnRenamed("query_id", "document_id")
    prompts = _each(contexts.join(told, "document_id"), queries).withColumn("prompt", _prompt(SUMMARY))
    none = F.lit(None).cast("string")
    if graph is None:
        prompts = prompts.withColumn("graph", none)
    else:
        known_graph = graph.select(F.col("query_id").cast("string").alias("query_id"), "document_id", F.col("context").alias("graph"))
        prompts = prompts.join(known_graph, ["query_id", "document_id"], "left").withColumn("prompt", F.concat_ws("\n\n", "prompt", "graph"))
    key = K.summary_key(F.lit(namespace), F.col("document_id"), F.col("query"), F.lit(limit), F.col("revision"), F.lit("off" if graph is None else "auto"), F.col("graph"))
    prompts = prompts.withColumn("key", key)
    if cache is not None:
        known = prompts.join(cache, "key").select("query_id", "document_id", "key", F.col("summary").alias("answer"))
        prompts = prompts.join(cache, "key", "left_anti")
    new = A.generate(prompts.select("query_id", "document_id", "key", "prompt"), generator).select("query_id", "document_id", "key", "answer")
    mapped = new if cache is None else new.unionByName(known)
    summaries = mapped.withColumnRenamed("answer", "summary")
    shares = summaries.select("query_id", "document_id", F.concat("document_id", F.lit(": ")).alias("head"), F.col("summary").alias("content"))
    cut = A.fit_summaries(shares, A.budget(len(SUMMARY), window))
    fits = F.when(F.col("fits"), F.concat("head", "content")).otherwise(F.raise_error(F.lit("the least of each summary doesn't fit")))
    joined = cut.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("document_id", fits.alias("text")))), lambda x: x["text"]), "\n\n").alias("context"))
    reduced = joined.join(queries.select(F.col("query_id").cast("string").alias("query_id"), "query"), "query_id").withColumn("prompt", _prompt(SUMMARY))
    return summaries, A.generate(reduced.select("query_id", "prompt"), generator).select("query_id", "answer")
