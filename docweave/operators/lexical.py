"""The best contents of each question by the words they share, in one pass over the contents."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docweave.operators import points as P

#: Pairs of contents and questions that are counted at a time.
CELLS = 1 << 22


def _rounded(x: float, digits: int | None) -> float:
    """As SQL rounds: half up, of the number as it is written."""
    return x if digits is None else float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def best_by_words(contents: DataFrame, queries: DataFrame, limit: int, words: Callable[[Column], Column], key: str = "id", payload: Sequence[str] = (), digits: int | None = None, substring: bool = False) -> DataFrame:
    """query_id, rank, ``key``, score and ``payload`` of each question's ``limit`` best contents: the part of its words that a content has.

    ``contents`` (``key``, content, payload columns), ``queries`` (query_id, query), ``words`` gives the distinct words
    of a text. Only contents that share a word count; with ``substring`` also those that share none and in which
    the whole question stands (score 1). Scores are rounded to ``digits`` before they are compared, ties go by ``key``.

    Questions are a stated set: blocks of ``points.QUERY_BLOCK`` are broadcast with an index of their words. Each
    batch of contents keeps its own best, so a common word costs no shuffle. A content in which a question of three
    or more words stands has its inner words, so shorter ones alone are looked for, all in one walk over the text.
    """
    asked = queries.where("query IS NOT NULL AND query <> ''").select("query_id", "query", words(F.col("query")).alias("t")).toLocalIterator()
    blocks = iter(lambda: list(islice(asked, P.QUERY_BLOCK)), [])
    found = [_best_of(contents, queries, block, limit, words, key, payload, digits, substring) for block in blocks]
    return reduce(DataFrame.unionAll, found) if found else _best_of(contents, queries, [], limit, words, key, payload, digits, substring)


def _best_of(contents: DataFrame, queries: DataFrame, block: list[Row], limit: int, words: Callable[[Column], Column], key: str, payload: Sequence[str], digits: int | None, substring: bool) -> DataFrame:
    spark = contents.sparkSession
    carried = list(dict.fromkeys([key, *payload]))
    vocabulary = sorted({w for r in block for w in r.t})
    place = {w: k for k, w in enumerate(vocabulary)}
    pairs = sorted((place[w], q) for q, r in enumerate(block) for w in r.t)
    asks = np.array([q for _, q in pairs], np.int64)
    starts = np.searchsorted([w for w, _ in pairs], np.arange(len(vocabulary) + 1))
    size = [len(r.t) for r in block]
    score = np.zeros((len(block), max(size, default=0) + 1))
    for q, n in enumerate(size):
        score[q, 1 : n + 1] = [_rounded(c / n, digits) for c in range(1, n + 1)]
    short = [(r.query, q) for q, r in enumerate(block) if substring and len(r.query.split()) < 3]
    shared = spark.sparkContext.broadcast((pa.array(vocabulary, pa.string()), starts, asks, score, short))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, asked_by, table, inside = shared.value
        whole = ahocorasick.Automaton()
        for text, q in inside:
            whole.add_word(text, [*whole.get(text, []), q])
        if inside:
            whole.make_automaton()
        n_asked = len(table)
        for big in batches:
            step = max(1, CELLS // max(1, n_asked))
            for batch in (big.slice(a, step) for a in range(0, big.num_rows if n_asked else 0, step)):
                n = batch.num_rows
                lists = batch.column("t")
                row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
                word = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy()
                row, word = row[word >= 0], word[word >= 0].astype(np.int64)
                times = first[word + 1] - first[word]
                before = np.repeat(np.cumsum(times) - times, times)
                q = asked_by[np.repeat(first[word], times) + np.arange(times.sum()) - before]
                counts = np.bincount(np.repeat(row, times) * n_asked + q, minlength=n * n_asked).reshape(n, n_asked).T
                value = np.take_along_axis(table, counts, axis=1)
                if inside:
                    for k, text in enumerate(batch.column("content").to_pylist()):
                        for _, hit in whole.iter(text or ""):
                            for x in hit:
                                if not counts[x, k]:
                                    value[x, k] = 1.0
                cut = np.partition(value, n - limit, axis=1)[:, n - limit] if n > limit else np.zeros(n_asked)
                i, k = np.nonzero((value > 0) & (value >= cut[:, None]))
                keys = np.unique(batch.column(key).to_numpy(zero_copy_only=False), return_inverse=True)[1]
                best = np.lexsort((keys[k], -value[i, k], i))
                i, k = i[best], k[best]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < limit
                i, k = i[keep], k[keep]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), *(batch.column(c).take(pa.array(k)) for c in carried), pa.array(value[i, k])], ["_q", *carried, "score"])

    lean = contents.select(*carried, *(["content"] if substring else []), words(F.col("content")).alias("t"))
    kinds = ", ".join(f"`{c}` {lean.schema[c].dataType.simpleString()}" for c in carried)
    ranked = lean.mapInArrow(run, f"_q int, {kinds}, score double").withColumn("rank", F.row_number().over(Window.partitionBy("_q").orderBy(F.desc("score"), key)))
    numbered = spark.createDataFrame([(r.query_id, q) for q, r in enumerate(block)], queries.select("query_id").schema.add("_q", IntegerType()))
    return ranked.where(F.col("rank") <= limit).join(F.broadcast(numbered), "_q").select("query_id", "rank", *carried, "score")
