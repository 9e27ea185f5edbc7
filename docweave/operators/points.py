"""Filters and nearest neighbours over point tables (id, vector, payload columns, seq)."""

from __future__ import annotations

import datetime
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docweave.functions import text as X

#: A query table is broadcast only up to this many rows; more are answered block by block.
QUERY_BLOCK = 2_000


@dataclass(frozen=True)
class Range:
    """Bounds of a value; dates compare by day, times parse the stored text. Null never matches."""

    gt: Any = None
    gte: Any = None
    lt: Any = None
    lte: Any = None

    def on(self, c: Column, stored_text: bool = False) -> Column:
        bounds = [("__gt__", self.gt), ("__ge__", self.gte), ("__lt__", self.lt), ("__le__", self.lte)]
        given = [(op, b) for op, b in bounds if b is not None]
        if any(isinstance(b, datetime.datetime) for _, b in given):
            c = X.timestamp(c) if stored_text else c.cast("timestamp_ntz")
        elif given and all(isinstance(b, datetime.date) for _, b in given):
            c = (X.timestamp(c) if stored_text else c).cast("date")
        tests = [getattr(c, op)(F.lit(b)) for op, b in given]
        return reduce(lambda a, b: a & b, tests, c.isNotNull())


def predicate(filters: Mapping[str, Any] | None) -> Column:
    """All of: equality (None matches missing), membership for lists, ``Range``; plain columns, so scans can push it down."""
    tests = []
    for name, want in (filters or {}).items():
        c = F.col("id" if name == "_id" else name)
        if isinstance(want, Range):
            tests.append(want.on(c))
        elif isinstance(want, (list, tuple, set, frozenset)):
            some = [x for x in want if x is not None]
            tests.append(c.isin(some) | c.isNull() if len(some) < len(want) else c.isin(some))
        else:
            tests.append(c.isNull() if want is None else c == F.lit(want))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def scope(document_id: str | None = None, document_ids: Sequence[str] | None = None, most: int = 10) -> list[str] | None:
    """The documents that a search may use: None for all; trimmed, each once, in order. Both arguments: an error."""
    if document_id is not None and document_ids is not None:
        raise ValueError("give document_id or document_ids, not both")
    if document_id is None and document_ids is None:
        return None
    wanted = [document_id] if document_ids is None else document_ids
    out = list(dict.fromkeys(s for x in wanted if (s := str(x).strip())))
    if len(out) > most:
        raise ValueError(f"at most {most} documents")
    return out


def single(documents: Sequence[str] | None) -> str | None:
    """The one document of a selection (None for none); more than one is an error."""
    chosen = scope(document_ids=documents) if documents is not None else None
    if chosen and len(chosen) > 1:
        raise ValueError("one document is asked for, several are selected")
    return chosen[0] if chosen else None


def in_scope(documents: Sequence[str] | None = None, namespace: str | None = None) -> Column:
    """Rows of a namespace (None: of any) and of some documents (None: all of them)."""
    if documents is not None and not documents:
        raise ValueError("the document scope is empty")
    own = F.lit(True) if namespace is None else F.coalesce(F.col("namespace") == namespace, F.lit(False))
    return own if documents is None else own & F.coalesce(F.col("document_id").isin(list(documents)), F.lit(False))


def scroll(points: DataFrame, filters: Mapping[str, Any] | None = None, fields: Sequence[str] | None = None, with_vectors: bool = False) -> DataFrame:
    """Filtered rows with the payload fields asked for (those there are)."""
    kept = [c for c in points.columns if c == "id" or c == "vector" and with_vectors or c not in ("id", "vector") and (fields is None or c in fields)]
    return points.where(predicate(filters)).select(*kept)


def remove(points: DataFrame, documents: Sequence[str] | None = None, namespace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What is left without some documents of a namespace (None: the whole namespace), and how many points of each document go.

    A namespace, documents or both must be named: nothing here empties a table that several namespaces share.
    """
    if documents is None and namespace is None:
        raise ValueError("name a namespace or documents")
    gone = in_scope(documents, namespace)
    return points.where(~gone), points.where(gone).groupBy("document_id").agg(F.count("*").alias("removed"))


def delete(points: DataFrame, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """What is left; no filter deletes all."""
    return points.where(~predicate(filters))


def _broadcast(queries: DataFrame) -> DataFrame:
    return queries if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK else F.broadcast(queries)


def nearest(points: DataFrame, queries: DataFrame, limit: int, filters: Mapping[str, Any] | None = None, threshold: float | None = None, digits: int | None = None, payload: Sequence[str] = ()) -> DataFrame:
    """Each query's ``limit`` nearest points by cosine: query_id, rank, id, score, and the ``payload`` columns.

    ``queries`` (query_id, query_vector) is a stated set, answered in blocks of QUERY_BLOCK rows. A block is
    broadcast as one matrix; each Arrow batch of points is one matrix product and leaves its own best
    ``limit`` of each query, so what is shuffled is a small multiple of the result. The points are read once
    for each block, and the driver holds one block at a time. Zero vectors score 0, null vectors are
    passed over, other sizes than the queries' are an error. Scores are rounded to ``digits`` (else 12)
    before anything is compared; those below ``threshold`` fall out; ties go by ``seq``.
    """
    rows = queries.select("query_id", "query_vector").where("query_vector IS NOT NULL").toLocalIterator()
    found = [_nearest_of(points, queries, asked, limit, filters, threshold, digits, payload) for asked in iter(lambda: list(islice(rows, QUERY_BLOCK)), [])]
    return reduce(DataFrame.unionAll, found) if found else _nearest_of(points, queries, [], limit, filters, threshold, digits, payload)


def _nearest_of(points: DataFrame, queries: DataFrame, asked: list[Row], limit: int, filters: Mapping[str, Any] | None, threshold: float | None, digits: int | None, payload: Sequence[str]) -> DataFrame:
    """``nearest`` of one block of the rows of ``queries``."""
    spark = points.sparkSession
    carried = ["id", "seq", *payload]
    lean = points.where(predicate(filters)).select(*carried, "vector").where("vector IS NOT NULL")
    kinds = ", ".join(f"`{c}` {lean.schema[c].dataType.simpleString()}" for c in carried)
    ids = queries.select("query_id").schema.add("_q", IntegerType())
    numbered = spark.createDataFrame([(r.query_id, k) for k, r in enumerate(asked)], ids)
    matrix = np.array([list(r.query_vector) for r in asked], float).reshape(len(asked), -1) if asked else np.zeros((0, 0))
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(np.divide(matrix, length, out=np.zeros_like(matrix), where=length > 0))
    places = 12 if digits is None else digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            n = batch.num_rows
            if not n or not len(wanted):
                continue
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            if (sizes != wanted.shape[1]).any():
                raise ValueError(f"vector size isn't {wanted.shape[1]}: {sizes[sizes != wanted.shape[1]][0]}")
            rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1)
            norm = np.linalg.norm(rows, axis=1)
            dots = (wanted @ rows.T) / np.where(norm > 0, norm, 1)
            score = np.round(np.where(norm > 0, dots, 0.0), places) + 0.0
            order = batch.column("seq").to_numpy(zero_copy_only=False)
            cut = np.partition(score, n - limit, axis=1)[:, n - limit] if n > limit else np.full(len(wanted), -np.inf)
            q, k = np.nonzero(score >= np.maximum(cut, -np.inf if threshold is None else threshold)[:, None])
            best = np.lexsort((order[k], -score[q, k], q))
            q, k = q[best], k[best]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < limit
            q, k = q[keep], k[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), *(batch.column(c).take(pa.array(k)) for c in carried), pa.array(score[q, k])], ["_q", *carried, "score"])

    found = lean.mapInArrow(run, f"_q int, {kinds}, score double")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), "seq")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
    return ranked.join(F.broadcast(numbered), "_q").select("query_id", "rank", "id", "score", *payload)


def lexical_overlap(contents: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """(query_id, id, score) for every pair that shares a token: the part of the query's tokens that the content has.

    An equi-join on tokens: ``contents`` (id, content), ``queries`` (query_id, query).
    """
    asked = queries.select("query_id", X.lexical_tokens(F.col("query")).alias("t")).select("query_id", F.size("t").alias("n"), F.explode("t").alias("token"))
    have = contents.select("id", F.explode(X.lexical_tokens(F.col("content"))).alias("token"))
    shared = have.join(asked, "token").groupBy("query_id", "n", "id").agg(F.count("*").alias("c"))
    score = F.col("c") / F.col("n")
    return shared.select("query_id", "id", (F.round(score, digits) if digits is not None else score).alias("score"))
