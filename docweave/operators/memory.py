"""Working, episodic and semantic memories (user_id, memory_id, memory_type, session_id, content, importance, ts) at a stated time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docweave.functions import text as X
from docweave.functions import vectors as V
from docweave.operators import graph as G
from docweave.operators import points as P
from docweave.operators.lexical import best_by_words
from docweave.sources.tables import scratch

TTL_MINUTES, CAPACITY = 60, 50
#: Pairs of memories and questions whose vectors are multiplied at a time.
PAIRS = 1 << 14


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def age_minutes(as_of: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col("ts"), _now(as_of)) / 60e6


def decay(as_of: str, ttl: float = TTL_MINUTES) -> Column:
    if ttl <= 0:
        return F.lit(1.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.exp(-age_minutes(as_of) / ttl)))


def recency(as_of: str) -> Column:
    """1 now, falling by e every week, at least 0.1; 0.5 where the time is unknown."""
    return F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.exp(-age_minutes(as_of) / 1440 / 7))), F.lit(0.5))


def weight() -> Column:
    return 0.8 + 0.4 * F.coalesce("importance", F.lit(0.5))


def live(memories: DataFrame, as_of: str, ttl: float = TTL_MINUTES) -> DataFrame:
    return memories.where(age_minutes(as_of) <= ttl)


def keyword_score(query: Column, content: Column) -> Column:
    """0.8 * recall + 0.2 * precision of distinct tokens."""
    q, c = F.array_distinct(X.working_tokens(query)), F.array_distinct(X.working_tokens(content))
    both = F.size(F.array_intersect(q, c))
    return F.when(both > 0, both / F.size(q) * 0.8 + both / F.size(c) * 0.2).otherwise(0.0)


def term_score(query: Column, content: Column) -> Column:
    """The part of the query's words that the content has; 1 where none but the query is a substring."""
    q, c = X.terms(query), X.terms(content)
    part = F.when(F.size(q) > 0, F.size(F.array_intersect(q, c)) / F.size(q)).otherwise(0.0)
    return F.when(part > 0, part).when(F.contains(content, query), 1.0).otherwise(0.0)


def _matches(memories: DataFrame, queries: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of queries and memories that share a token: tfidf, and shared, asked and held, their numbers of distinct tokens.

    Memories are read once: their token counts give the document frequencies, the lengths and, for the
    queries' tokens alone, the products. ``carry`` names columns of the memories that pairs keep.
    """
    keys = ["memory_id", *carry]
    words = memories.select(*keys, X.working_tokens(F.col("content")).alias("t")).select(*keys, F.size("t").alias("n"), F.explode("t").alias("token"))
    tf = words.groupBy(*keys, "n", "token").agg(F.count("*").alias("c"))
    df = tf.groupBy("token").agg(F.count("*").alias("df"))
    total = F.broadcast(memories.agg(F.count("*").alias("_total")))  # one row
    idf = F.log((F.col("_total") + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1
    asked = queries.select("query_id", X.working_tokens(F.col("query")).alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("token")).groupBy("query_id", "n", "token").agg(F.count("*").alias("c"))
    want = asked.join(df, "token", "left").join(total).select("query_id", "token", idf.alias("idf"), (F.col("c") / F.col("n") * idf).alias("q"))
    share = F.col("c") / F.col("n")
    length = tf.join(df, "token").join(total).groupBy("memory_id").agg(F.sqrt(F.sum((share * idf) * (share * idf))).alias("wn"), F.count("*").alias("held"))
    asked_length = want.groupBy("query_id").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"), F.count("*").alias("asked"))
    pairs = tf.join(want, "token").groupBy("query_id", *keys).agg(F.sum(share * F.col("idf") * F.col("q")).alias("dot"), F.count("*").alias("shared"))
    both = pairs.join(length, "memory_id").join(asked_length, "query_id")
    return both.select("query_id", *keys, (F.col("dot") / (F.col("wn") * F.col("qn"))).alias("tfidf"), "shared", "asked", "held")


def tfidf(memories: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, memory_id, tfidf): cosine of tf * (ln((N + 1) / (df + 1)) + 1); only pairs with a shared token."""
    return _matches(memories, queries).select("query_id", "memory_id", "tfidf")


def _top(scored: DataFrame, limit: int, digits: int | None) -> DataFrame:
    if digits is not None:
        scored = scored.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def working_retrieve(memories: DataFrame, queries: DataFrame, as_of: str, limit: int = 5, ttl: float = TTL_MINUTES, min_importance: float = 0.0, digits: int | None = None) -> DataFrame:
    """Live memories by (0.7 tf-idf + 0.3 keywords, or keywords alone) * decay * weight: query_id, rank, memory_id, score."""
    rows = _matches(live(memories, as_of, ttl), queries, ("importance", "ts")).where(F.col("importance") >= min_importance)
    words = F.col("shared") / F.col("asked") * 0.8 + F.col("shared") / F.col("held") * 0.2
    base = F.when(F.col("tfidf") > 0, 0.7 * F.col("tfidf") + 0.3 * words).otherwise(words)
    return _top(rows.select("query_id", "memory_id", (base * decay(as_of, ttl) * weight()).alias("score")), limit, digits)


def episodic_filter(memories: DataFrame, user: str | int | None = None, session: str | None = None, min_importance: float = 0.0, start: str | None = None, end: str | None = None) -> DataFrame:
    out = memories.where(F.coalesce("importance", F.lit(0.5)) >= min_importance)
    for name, want in (("user_id", user), ("session_id", session)):
        out = out if want is None else out.where(F.col(name) == F.lit(want))
    out = out if start is None else out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return out if end is None else out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))


def episodic_rank(pool: DataFrame, as_of: str, limit: int = 5, digits: int | None = None) -> DataFrame:
    """A vector pool (query_id, memory_id, vector_score, importance, ts) by (0.8 v + 0.2 recency) * weight."""
    score = (0.8 * F.col("vector_score") + 0.2 * recency(as_of)) * weight()
    return _top(pool.withColumn("score", score), limit, digits)


#: What a question may ask of the memories it wants; null asks nothing.
ASKED = "query_id, query, query_vector, user_id, session_id, min_importance, start, end"


def _applicable(memories: DataFrame, asked: DataFrame, whole: bool = True) -> DataFrame:
    """``memories`` with ``asks``: the numbers ``_q`` of the questions (a block of them) whose conditions a memory meets.

    Questions of one user are looked up by the user, so a memory sees its own user's and those that name none.
    Without ``whole`` the user alone counts.
    """
    q = F.struct("_q", "session_id", F.coalesce("min_importance", F.lit(0.0)).alias("least"), F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    per_user = asked.where("user_id IS NOT NULL").groupBy(F.col("user_id").alias("_user")).agg(F.collect_list(q).alias("own"))
    anyone = asked.where("user_id IS NULL").agg(F.collect_list(q).alias("any"))  # one row
    met = memories.join(F.broadcast(per_user), memories["user_id"] == F.col("_user"), "left").join(F.broadcast(anyone), F.lit(True))
    every = F.concat(F.coalesce("own", F.slice("any", 1, 0)), "any")

    def holds(x: Column) -> Column:
        ok = F.coalesce("importance", F.lit(0.5)) >= x["least"]
        ok = ok & (x["session_id"].isNull() | F.coalesce(F.col("session_id") == x["session_id"], F.lit(False)))
        return ok & (x["start"].isNull() | F.coalesce(F.col("ts") >= x["start"], F.lit(False))) & (x["end"].isNull() | F.coalesce(F.col("ts") <= x["end"], F.lit(False)))

    wanted = F.filter(every, holds) if whole else every
    return met.withColumn("asks", F.transform(wanted, lambda x: x["_q"])).where(F.size("asks") > 0).select(*memories.columns, "asks")


def episodic_retrieve(memories: DataFrame, queries: DataFrame, as_of: str, limit: int = 5, digits: int | None = None) -> DataFrame:
    """Episodic memories for questions that each ask for their own user, session, least importance and time range:
    query_id, rank, memory_id, score, backend.

    ``memories`` (memory_id, user_id, session_id, content, importance, ts, vector), ``queries`` (ASKED). The
    conditions are met before the pool of max(5 * limit, 20) nearest is cut. A question for which no memory
    that meets them has a vector takes the pool from its user's memories by words, and the conditions count
    after the cut (backend 'fallback_keyword'). Null importance is 0.5; a null question has no rows.

    Questions are a stated set, answered in blocks of ``points.QUERY_BLOCK``; memories are read once a block,
    each is compared with the questions it applies to alone, and each batch keeps its own best.
    """
    rows = queries.where("query IS NOT NULL AND query_vector IS NOT NULL").toLocalIterator()
    pool = max(5 * limit, 20)
    found = [_episodes_of(memories, queries, block, as_of, pool, digits) for block in iter(lambda: list(islice(rows, P.QUERY_BLOCK)), [])]
    if not found:
        found = [_episodes_of(memories, queries, [], as_of, pool, digits)]
    scored = reduce(DataFrame.unionAll, found)
    score = (0.8 * F.col("v") + 0.2 * recency(as_of)) * weight()
    return _top(scored.withColumn("score", score), limit, digits).select("query_id", "rank", "memory_id", "score", "backend")


def _best(df: DataFrame, pool: int) -> DataFrame:
    order = Window.partitionBy("_q").orderBy(F.desc("v"), "memory_id")
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= pool).drop("_k")


def _episodes_of(memories: DataFrame, queries: DataFrame, block: list[Row], as_of: str, pool: int, digits: int | None) -> DataFrame:
    """The pools of one block of questions: query_id, memory_id, importance, ts, v, backend."""
    spark = memories.sparkSession
    names = [c.strip() for c in ASKED.split(",") if c.strip() not in ("query_vector",)]
    schema = queries.select(*names).schema.add("_q", IntegerType())
    asked = spark.createDataFrame([(*(r[c] for c in names), k) for k, r in enumerate(block)], schema)
    matrix = np.array([list(r.query_vector) for r in block], float).reshape(len(block), -1) if block else np.zeros((0, 0))
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0))
    places = 12 if digits is None else digits
    keys = ["memory_id", "importance", "ts"]
    kinds = ", ".join(f"`{c}` {memories.schema[c].dataType.simpleString()}" for c in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            if not batch.num_rows or not len(wanted):
                continue
            vectors = batch.column("vector")
            if (np.diff(vectors.offsets.to_numpy()) != wanted.shape[1]).any():
                raise ValueError(f"vector size isn't {wanted.shape[1]}")
            own = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            norm = np.linalg.norm(own, axis=1)
            own = own / np.where(norm > 0, norm, 1)[:, None]
            asks = batch.column("asks")
            row = np.repeat(np.arange(batch.num_rows), np.diff(asks.offsets.to_numpy()))
            q = asks.flatten().to_numpy(zero_copy_only=False)
            v = np.concatenate([np.einsum("ij,ij->i", own[row[a : a + PAIRS]], wanted[q[a : a + PAIRS]]) for a in range(0, len(q), PAIRS)])
            v = np.round(v, places) + 0.0
            best = np.lexsort((batch.column("memory_id").to_numpy(zero_copy_only=False)[row], -v, q))
            keep = best[np.arange(len(q)) - np.searchsorted(q[best], q[best]) < pool]
            yield pa.RecordBatch.from_arrays([pa.array(q[keep], pa.int32()), *(batch.column(c).take(pa.array(row[keep])) for c in keys), pa.array(v[keep])], ["_q", *keys, "v"])

    lean = ["memory_id", "user_id", "session_id", "importance", "ts"]
    with_vectors = _applicable(memories.where("vector IS NOT NULL").select(*lean, "vector"), asked).select(*keys, "vector", "asks")
    path = f"{scratch(spark)}/near"  # a pool for each question; read twice below
    _best(with_vectors.mapInArrow(run, f"_q int, {kinds}, v double"), pool).write.parquet(path)
    near = spark.read.parquet(path)
    none = asked.join(near.select("_q").distinct(), "_q", "left_anti")
    words = _applicable(memories.select(*lean, "content"), none, whole=False).withColumn("_q", F.explode("asks")).drop("asks")
    told = words.join(none.select("_q", F.col("query").alias("_query")), "_q").withColumn("v", term_score(F.col("_query"), F.col("content"))).where("v > 0")
    told = told.withColumn("v", F.round("v", places))
    kept = _applicable(_best(told, pool).drop("content", "_query").withColumnRenamed("_q", "_for"), none).where(F.array_contains("asks", F.col("_for")))
    both = near.withColumn("backend", F.lit("vector")).unionByName(kept.select(F.col("_for").alias("_q"), *keys, "v", F.lit("fallback_keyword").alias("backend")))
    return both.join(F.broadcast(asked.select("query_id", "_q")), "_q").select("query_id", *keys, "v", "backend")


def semantic_fuse(vector: DataFrame, words: DataFrame, limit: int = 5, digits: int | None = None) -> DataFrame:
    """Full outer join of (query_id, memory_id, importance, vector_score) and (..., graph_score): (0.7 v + 0.3 g) * weight."""
    g = words.withColumnRenamed("importance", "_i")
    both = vector.join(g, ["query_id", "memory_id"], "full_outer").withColumn("importance", F.coalesce("importance", "_i", F.lit(0.5)))
    score = (0.7 * F.coalesce("vector_score", F.lit(0.0)) + 0.3 * F.coalesce("graph_score", F.lit(0.0))) * weight()
    return _top(both.withColumn("score", score), limit, digits)


def union_rank(parts: list[DataFrame], limit: int = 5, min_importance: float = 0.1) -> DataFrame:
    """The types' own top rows together, by importance alone, then in the order of types and ranks."""
    rows = None
    for k, part in enumerate(parts):
        one = part.select("query_id", "memory_id", "importance", F.lit(k).alias("type_order"), F.col("rank").alias("type_rank"))
        rows = one if rows is None else rows.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("importance"), "type_order", "type_rank")
    return rows.where(F.col("importance") >= min_importance).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def forget(memories: DataFrame, strategy: str, as_of: str, kind: str = "working", threshold: float = 0.1, max_age_days: float = 30, capacity: int = CAPACITY) -> DataFrame:
    """What is left after forgetting.

    importance_based keeps importance >= threshold, time_based ages up to max_age_days, capacity_based the
    ``capacity`` best by importance, then time, of each user (episodic: as importance_based). Semantic
    memories know importance_based only; an unknown strategy forgets nothing.
    """
    importance = F.coalesce("importance", F.lit(0.5))
    if strategy == "importance_based" or strategy == "capacity_based" and kind == "episodic":
        return memories.where(importance >= threshold)
    if strategy == "time_based" and kind != "semantic":
        return memories.where(age_minutes(as_of) <= max_age_days * 1440)
    if strategy == "capacity_based" and kind == "working":
        best = Window.partitionBy("user_id").orderBy(importance.desc(), F.desc("ts"), "memory_id")
        return memories.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= capacity).drop("_k")
    return memories


def forget_all(memories: DataFrame, strategy: str, as_of: str, threshold: float = 0.1, max_age_days: float = 30, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """What is left of memories of all types, each forgotten by its own type's rules as in ``forget``, and how many of each type go.

    One pass over all types; ranks are only needed where working memories are kept by capacity. A memory of no
    known time is forgotten by age; one of no type by importance alone.
    """
    kind, important = F.coalesce("memory_type", F.lit("")), F.coalesce("importance", F.lit(0.5)) >= threshold
    stays, rows = F.lit(True), memories
    if strategy == "importance_based":
        stays = important
    elif strategy == "time_based":
        stays = (kind == "semantic") | F.coalesce(age_minutes(as_of) <= max_age_days * 1440, F.lit(False))
    elif strategy == "capacity_based":
        best = Window.partitionBy("user_id", "memory_type").orderBy(F.coalesce("importance", F.lit(0.5)).desc(), F.desc("ts"), "memory_id")
        rows = memories.withColumn("_k", F.row_number().over(best))
        stays = F.when(kind == "working", F.col("_k") <= capacity).when(kind == "episodic", important).otherwise(True)
    left = rows.where(stays).select(*memories.columns)
    return left, rows.where(~stays).groupBy("memory_type").agg(F.count("*").alias("removed"))


def evict(memories: DataFrame, as_of: str, capacity: int = CAPACITY, ttl: float = TTL_MINUTES) -> DataFrame:
    """The ``capacity`` memories of each user that outlast the others by importance * decay; of equals the earlier goes."""
    order = Window.partitionBy("user_id").orderBy((F.coalesce("importance", F.lit(0.5)) * decay(as_of, ttl)).desc(), F.desc("memory_id"))
    return memories.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= capacity).drop("_k")


def consolidate(memories: DataFrame, source: str = "working", target: str = "episodic", threshold: float = 0.7) -> DataFrame:
    """Important memories of one type become another's; consolidated_from says where they came from."""
    move = (F.col("memory_type") == source) & (F.col("importance") >= threshold)
    return memories.withColumn("consolidated_from", F.when(move, F.col("memory_type"))).withColumn("memory_type", F.when(move, target).otherwise(F.col("memory_type")))


def classify(content: Column, modality: Column, event_type: Column, session: Column, knowledge_type: Column) -> Column:
    some = lambda c: F.coalesce(F.length(c.cast("string")) > 0, F.lit(False))
    return F.when(some(modality), "perceptual").when(some(event_type) | some(session), "episodic").when(some(knowledge_type) | (F.length(content) > 80), "semantic").otherwise("working")


def stats(memories: DataFrame) -> DataFrame:
    return memories.groupBy("memory_type").agg(F.count("*").alias("memories"), F.countDistinct("user_id").alias("users"))


def add(old: DataFrame, new: DataFrame, user: str | int, as_of: str, session: str | None = None) -> DataFrame:
    """``old`` and the memories of ``new`` (memory_id, content; memory_type, importance, file_path, modality if there), all of one session.

    Without a ``session`` it is named by the time, session_YYYYmmdd_HHMMSS. Type and importance are 'working' and 0.5
    unless given; a perceptual memory of a file carries its modality and the file as raw data. Memories without
    content are not added; user, session and time are stamped on all.
    """
    now = _now(as_of)
    given = set(new.columns)
    c = lambda name, kind="string": F.col(name) if name in given else F.lit(None).cast(kind)
    kind = F.coalesce(c("memory_type"), F.lit("working"))
    file = F.when((kind == "perceptual") & (F.length(F.coalesce(c("file_path"), F.lit(""))) > 0), c("file_path"))
    stamp = F.lit(session) if session is not None else F.concat(F.lit("session_"), F.date_format(now, "yyyyMMdd_HHmmss"))
    rows = new.where(F.length(F.coalesce("content", F.lit(""))) > 0).select(
        "memory_id", F.lit(user).alias("user_id"), kind.alias("memory_type"), stamp.alias("session_id"), "content", F.coalesce(c("importance", "double"), F.lit(0.5)).alias("importance"), now.alias("ts"),
        F.when(file.isNotNull(), F.coalesce(F.nullif(c("modality"), F.lit("")), X.modality(file))).alias("modality"), file.alias("raw_data"), file.alias("file_path"),
    )
    return old.unionByName(rows, allowMissingColumns=True)


def episodic_add(old: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """``old`` with the episodes of ``new`` (memory_id, user_id, session_id, content, importance, timestamp, seq) put in.

    An id that is there already gets its new content and moves to its new session; of several new rows of an id
    the last by ``seq`` counts. A timestamp is text in any accepted spelling, ``as_of`` where none fits; no
    session is 'default', null importance 0.5. Rows without an id are not added.
    """
    last = Window.partitionBy("memory_id").orderBy(F.desc("seq"))
    fresh = new.where("memory_id IS NOT NULL").withColumn("_k", F.row_number().over(last)).where("_k = 1")
    rows = fresh.select(
        "memory_id", "user_id", F.lit("episodic").alias("memory_type"), F.coalesce("session_id", F.lit("default")).alias("session_id"), "content",
        F.coalesce("importance", F.lit(0.5)).alias("importance"), X.timestamp(F.col("timestamp"), _now(as_of)).alias("ts"),
    )
    return old.join(rows.select("memory_id"), "memory_id", "left_anti").unionByName(rows, allowMissingColumns=True)


def insert_once(old: DataFrame, new: DataFrame, key: str = "memory_id") -> DataFrame:
    """Rows of ``new`` whose key isn't there yet join ``old``."""
    return old.unionByName(new.dropDuplicates([key]).join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def keyword_search(memories: DataFrame, queries: DataFrame, limit: int, min_importance: float = 0.0, digits: int | None = None) -> DataFrame:
    """Each query's best memories by ``term_score``: query_id, rank, memory_id, importance, score.

    ``queries`` (query_id, query) is a stated set, answered in one pass over the memories for each block of it.
    """
    rows = memories.where(F.coalesce("importance", F.lit(0.5)) >= min_importance).select("memory_id", "importance", "content")
    found = best_by_words(rows, queries, limit, X.terms, "memory_id", ["importance"], digits, substring=True)
    return found.select("query_id", "rank", "memory_id", "importance", "score")


def semantic_retrieve(memories: DataFrame, queries: DataFrame, limit: int = 5, user: str | int | None = None, min_importance: float = 0.0, digits: int | None = None) -> DataFrame:
    """Semantic memories by vectors and by words, fused: query_id, rank, memory_id, score, backend.

    ``memories`` (memory_id, seq, vector, content, importance), ``queries`` (query_id, query, query_vector).
    Twice ``limit`` rows come from either side. Importance counts after the vectors' cut; a query for which
    nothing is left of it takes the words' rows as its vector side (backend 'fallback_keyword').
    """
    rows = memories.where("memory_type = 'semantic'") if "memory_type" in memories.columns else memories
    rows = rows if user is None else rows.where(F.col("user_id") == F.lit(user))
    points = rows.select(F.col("memory_id").alias("id"), "seq", "vector", F.coalesce("importance", F.lit(0.5)).alias("importance"))
    near = P.nearest(points, queries, 2 * limit, digits=digits, payload=["importance"]).where(F.col("importance") >= min_importance)
    near = near.select("query_id", F.col("id").alias("memory_id"), "importance", F.col("score").alias("vector_score"), F.lit("vector").alias("backend"))
    words = keyword_search(rows, queries, 2 * limit, min_importance, digits).select("query_id", "memory_id", "importance", F.col("score").alias("graph_score"))
    fallback = words.join(near.select("query_id").distinct(), "query_id", "left_anti").select("query_id", "memory_id", "importance", F.col("graph_score").alias("vector_score"), F.lit("fallback_keyword").alias("backend"))
    return semantic_fuse(near.union(fallback), words, limit, digits).select("query_id", "rank", "memory_id", "score", F.coalesce("backend", F.lit("keyword")).alias("backend"))


def semantic_add(new: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New semantic memories (memory_id, content, ...) as points with vector, entities and their counts; the entities; the relations."""
    key = new.select(F.col("memory_id").alias("doc_id"), F.col("content").alias("text"))
    entities = G.rule_entities(key).withColumnRenamed("document_id", "memory_id")
    relations = G.rule_relations(entities.withColumnRenamed("memory_id", "document_id")).withColumnRenamed("document_id", "memory_id")
    named = entities.groupBy("memory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name"))), lambda x: x["name"]).alias("entities"))
    points = new.withColumn("_key", F.col("memory_id").cast("string")).join(named.withColumnRenamed("memory_id", "_key"), "_key", "left").drop("_key")
    some = F.coalesce("entities", F.array().cast("array<string>"))
    points = points.withColumns({"memory_type": F.lit("semantic"), "vector": V.hash_embedding(F.col("content")), "entities": some, "entity_count": F.size(some), "relation_count": F.greatest(F.lit(0), F.size(some) - 1)})
    return points, entities, relations


def difference(before: DataFrame, after: DataFrame, key: str = "memory_id") -> DataFrame:
    """What a snapshot had and a later one hasn't: the ids to remove from other stores, in order."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti").orderBy(key)


def owned(snapshot: DataFrame, owner: str | int) -> DataFrame:
    """A snapshot's rows if all are ``owner``'s; another user's row fails the job before anything is restored."""
    return snapshot.withColumn("user_id", F.when(F.col("user_id") == F.lit(owner), F.col("user_id")).otherwise(F.raise_error(F.lit("the snapshot belongs to another user"))))


def clear(memories: DataFrame, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left without one type of memories (or without all), and how many of each type go."""
    gone = F.lit(True) if kind is None else F.coalesce(F.col("memory_type") == kind, F.lit(False))
    return memories.where(~gone), memories.where(gone).groupBy("memory_type").agg(F.count("*").alias("removed"))


def summary_lines(memories: DataFrame, types: tuple[str, ...] = ("working", "episodic", "semantic")) -> DataFrame:
    """One line for each type, also those without memories: position, line."""
    counts = [F.count(F.when(F.col("memory_type") == t, 1)).alias(t) for t in types]
    lines = F.array(*[F.concat(F.lit(f"- {t}: "), F.col(t), F.lit(" 条记忆")) for t in types])
    return memories.agg(*counts).select(F.posexplode(lines).alias("position", "line"))


#: What the types are called in a list of memories found, and its first line with and without any.
TYPE_NAMES = {"working": "工作记忆", "episodic": "情景记忆", "semantic": "语义记忆", "perceptual": "感知记忆"}
FOUND, NOT_FOUND = ("🔍 找到 ", " 条相关记忆:"), ("🔍 未找到与 '", "' 相关的记忆")


def found_text(found: DataFrame, queries: DataFrame) -> DataFrame:
    """For each question (query_id, query) its memories (query_id, rank, memory_type, content, importance) as text: query_id, text.

    A numbered line for each, with its type's name, the first 80 characters and the importance; questions
    without memories are told so. Null contents are empty, null importance is 0.5.
    """
    content = F.coalesce("content", F.lit(""))
    short = F.when(F.length(content) > 80, F.concat(F.substring(content, 1, 80), F.lit("..."))).otherwise(content)
    names = F.create_map(*(F.lit(x) for pair in TYPE_NAMES.items() for x in pair))
    named = F.coalesce(F.try_element_at(names, F.col("memory_type")), "memory_type")
    line = F.concat(F.lit(". ["), named, F.lit("] "), short, F.lit(" (重要性: "), F.format_number(F.coalesce("importance", F.lit(0.5)), 2), F.lit(")"))
    listed = found.select("query_id", F.struct("rank", F.concat(F.col("rank").cast("string"), line).alias("line")).alias("x"))
    listed = listed.groupBy("query_id").agg(F.array_sort(F.collect_list("x"))["line"].alias("lines"))
    head = F.concat(F.lit(FOUND[0]), F.size("lines").cast("string"), F.lit(FOUND[1]))
    none = F.concat(F.lit(NOT_FOUND[0]), "query", F.lit(NOT_FOUND[1]))
    text = F.when(F.col("lines").isNull(), none).otherwise(F.array_join(F.concat(F.array(head), "lines"), "\n"))
    return queries.select("query_id", "query").join(listed, "query_id", "left").select("query_id", text.alias("text"))


def retrieved_items(hits: DataFrame, episodes: DataFrame) -> DataFrame:
    """Hits (id, score, metadata MAP) as memories: ids and contents as the payload has them, else as the episodes do."""
    m = lambda k: F.nullif(F.col("metadata")[k], F.lit(""))
    rows = hits.withColumn("memory_id", F.coalesce(m("memory_id"), m("episode_id"), "id")).join(episodes.select("memory_id", F.col("content").alias("_content")), "memory_id", "left")
    return rows.select("memory_id", F.coalesce(m("content"), "_content", F.lit("")).alias("content"), F.lit("episodic").alias("memory_type"), F.coalesce(m("importance").cast("double"), F.lit(0.5)).alias("importance"), F.coalesce("score", F.lit(0.0)).alias("retrieval_score"))
