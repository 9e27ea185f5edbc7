"""Retrieval over chunks: vector pool, hybrid rank, source dedupe, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.functions import vectors as V
from docweave.operators import points as P
from docweave.operators.lexical import best_by_words


def dedupe_sources(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """The first row by rank of each (document_id, page_number, content digest), for each query; ranks close up; at most ``limit``."""
    key = ["query_id", "document_id", "_page", "_digest"]
    marked = ranked.withColumn("_page", X.page_number(F.col("page_number"))).withColumn("_digest", X.digest(F.col("content")))
    first = marked.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy("rank"))).where("_k = 1")
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return (out if limit is None else out.where(F.col("rank") <= limit)).drop("_page", "_digest", "_k")


def hybrid_rank(pool: DataFrame, contents: DataFrame, queries: DataFrame, limit: int, weight: float = 0.7, digits: int | None = None) -> DataFrame:
    """w * vector + (1 - w) * lexical for all of ``contents``; vector scores count only in the pool, clamped to 0..1.

    ``pool`` (query_id, id, score), at most ``limit`` rows a question; ``contents`` (id, content), ``queries`` (query_id,
    query). Outside of the pool only the best by words can count, so they are all that one pass over the contents
    keeps: twice ``limit``, since as many may be in the pool. Rows with neither score all tie at 0; they come last by
    id, and only as many as could be missing are looked at.
    """
    weight = min(1.0, max(0.0, weight))
    tokens = queries.select("query_id", X.lexical_tokens(F.col("query")).alias("_t"))
    near = pool.select("query_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("v"))
    met = near.join(contents.select("id", "content"), "id").join(tokens, "query_id")  # only what is in a pool is taken apart
    told = met.select("query_id", "id", "v", V.overlap_score(F.col("_t"), X.lexical_tokens(F.col("content"))).alias("l"))
    words = best_by_words(contents, queries, 2 * limit, X.lexical_tokens).select("query_id", "id", F.lit(0.0).alias("v"), F.col("score").alias("l"))
    first = F.array(*(F.lit(r.id) for r in contents.select("id").orderBy("id").limit(limit).collect()))
    kind = contents.schema["id"].dataType.simpleString()
    zeros = queries.select("query_id", F.explode(first.cast(f"array<{kind}>")).alias("id"), F.lit(0.0).alias("v"), F.lit(0.0).alias("l"))
    # no part of a score is below 0, so of a row that comes from several sides the greatest parts are its own
    both = told.unionByName(words).unionByName(zeros).groupBy("query_id", "id").agg(F.max("v").alias("v"), F.max("l").alias("l"))
    score = weight * F.col("v") + (1 - weight) * F.col("l")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = both.withColumn("score", F.round(score, digits) if digits is not None else score).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


def mmr(ranked: DataFrame, limit: int, tradeoff: float = 0.75, digits: int = 9) -> DataFrame:
    """Greedy maximal marginal relevance within each query's bounded pool (query_id, rank, id, score, content).

    A pool of at most ``limit`` rows stays in its order. Values are rounded to ``digits``; ties go by id.
    The pool is an array of one row, folded ``limit`` times; it must be bounded (3 * limit in a search).
    """
    tradeoff = min(1.0, max(0.0, tradeoff))
    item = F.struct("rank", "id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")).alias("r"), X.lexical_tokens(F.col("content")).alias("t"))
    pool = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("pool"))
    kind = pool.schema["pool"].dataType.simpleString()

    def step(chosen, _):
        left = F.filter(F.col("pool"), lambda x: ~F.exists(chosen, lambda y: y["id"] == x["id"]))

        def value(x):
            most = F.aggregate(chosen, F.lit(0.0), lambda m, y: F.greatest(m, V.jaccard(x["t"], y["t"])))
            return F.struct((-F.round(tradeoff * x["r"] - (1 - tradeoff) * most, digits)).alias("value"), x["id"].alias("id"), x.alias("x"))

        return F.when(F.size(left) > 0, F.concat(chosen, F.array(F.array_min(F.transform(left, value))["x"]))).otherwise(chosen)

    greedy = F.aggregate(F.sequence(F.lit(1), F.lit(limit)), F.array().cast(kind), step)
    chosen = F.when(F.size("pool") <= limit, F.col("pool")).otherwise(greedy)
    out = pool.select("query_id", F.posexplode(chosen).alias("n", "x"))
    return out.select("query_id", (F.col("n") + 1).alias("rank"), "x.id", F.col("x.r").alias("score"))


def search(chunks: DataFrame, queries: DataFrame, limit: int = 5, mode: str = "vector", min_score: float = 0.0, profile: str = "json", diverse: bool | None = None, weight: float = 0.7, tradeoff: float = 0.75, documents: list[str] | None = None, digits: int | None = None, namespace: str | None = None) -> DataFrame:
    """The whole search over ``chunks`` (chunk_id, document_id, page_number, content, vector, seq).

    ``queries`` (query_id, query, query_vector). The pool of 3 * limit is cut before duplicates fall out, so
    fewer than ``limit`` rows may come back. Profile 'json' applies ``min_score`` only above 0, 'remote'
    always. ``diverse`` is on by default in hybrid mode only. With ``digits`` scores are rounded before ranking.
    """
    if mode not in ("vector", "hybrid"):
        raise ValueError(f"unknown mode {mode!r}")
    within = chunks.where(P.in_scope(documents, namespace)).withColumn("id", F.col("chunk_id"))
    threshold = None if profile == "json" and min_score <= 0 else min_score
    told = ["document_id", "page_number", "content"]
    full = P.nearest(within.select("id", "seq", "vector", *told), queries, 3 * limit, threshold=threshold, digits=digits, payload=told)
    if mode == "hybrid":
        full = hybrid_rank(full, within.select("id", "content"), queries, 3 * limit, weight, digits).join(within.select("id", *told), "id")
    unique = dedupe_sources(full, 3 * limit)
    if diverse if diverse is not None else mode == "hybrid":
        picked = mmr(unique, limit, tradeoff).drop("score")
        unique = unique.drop("rank").join(picked, ["query_id", "id"])
    page = X.page_number(F.col("page_number"))
    cited = X.source_citation(F.col("document_id"), page, X.digest(F.col("content")))
    return unique.where(F.col("rank") <= limit).select("query_id", "rank", "id", "document_id", page.alias("page_number"), "score", cited.alias("citation_id"), "content")
