"""Exact top-k search among binary codes by incremental multi-index hashing.

A code is cut into m segments. A code within distance d of a query lies within d // m of it in some
segment, so once every segment's buckets up to radius r have been looked up, all codes closer than
m * (r + 1) have been verified: a query is done when the distance of its k-th best is among those.

Vectors with equal codes are one entry with its k smallest ids. The entries are dealt to parts of bounded
size, each with tables of its own; the queries' codes are broadcast in blocks of bounded size; a query's
best of all parts are merged by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 64
#: Entries in a part (some 50 bytes each in its tables), and queries in a broadcast block (8 bytes each).
PART = 1 << 20
#: While there are fewer parts than cores, parts may be as small as this.
LEAST_PART = 1 << 15
QUERY_BLOCK = 1 << 20
_AT_A_TIME = 1 << 21
_U = np.uint64


def sign_code(embedding: Column) -> Column:
    """Bit i is set where the i-th of up to 64 values is above 0; null stays null."""
    bits = F.transform(F.slice(embedding, 1, BITS), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


@lru_cache(maxsize=64)
def _masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with ``radius`` of them set."""
    return np.array([sum(1 << k for k in c) for c in combinations(range(bits), radius)], np.int64)


class MultiIndex:
    """Segment tables of some codes."""

    def __init__(self, codes: np.ndarray, first_ids: np.ndarray) -> None:
        order = np.argsort(first_ids, kind="stable")  # entry numbers then break ties as ids do
        self.order, self.codes = order, codes[order]
        m = min(8, max(4, round(BITS / max(1.0, np.log2(len(codes) + 1)))))
        width = [BITS // m + (k < BITS % m) for k in range(m)]
        shift = np.cumsum([0, *width[:-1]])
        self.segments = []
        for w, s in zip(width, shift.tolist(), strict=True):
            part = ((self.codes >> _U(s)) & _U((1 << w) - 1)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            self.segments.append((w, s, by, np.searchsorted(part[by], np.arange((1 << w) + 1))))

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of each query's k best entries (all if there are fewer), nearest first."""
        n, m = len(self.codes), len(self.segments)
        active = np.arange(len(queries))
        best = (np.zeros(0, np.int64),) * 3
        done: list[tuple] = []
        radius = 0
        while len(active):
            found = [best]
            for w, s, by, bounds in self.segments:
                if radius > w:
                    continue
                masks = _masks(w, radius)
                step = max(1, _AT_A_TIME // max(len(masks), 1))
                for a in range(0, len(active), step):
                    q = active[a : a + step]
                    value = ((queries[q] >> _U(s)) & _U((1 << w) - 1)).astype(np.int64)[:, None] ^ masks
                    size = bounds[value + 1] - bounds[value]
                    row, col = np.nonzero(size)
                    size, start = size[row, col], bounds[value[row, col]]
                    entry = by[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
                    of = np.repeat(q[row], size)
                    found.append((of, entry, np.bitwise_count(queries[of] ^ self.codes[entry]).astype(np.int64)))
            of, entry, distance = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((entry, distance, of))
            of, entry, distance = of[order], entry[order], distance[order]
            fresh = np.append(True, (of[1:] != of[:-1]) | (entry[1:] != entry[:-1]))[: len(of)]
            of, entry, distance = of[fresh], entry[fresh], distance[fresh]
            start = np.searchsorted(of, active)
            rank = np.arange(len(of)) - np.repeat(start, np.searchsorted(of, active, "right") - start)
            keep = rank < k
            of, entry, distance = of[keep], entry[keep], distance[keep]
            end = np.searchsorted(of, active, "right")
            have = end - np.searchsorted(of, active)
            worst = np.where(have >= min(k, n), distance[np.maximum(end - 1, 0)] if len(of) else BITS + 1, BITS + 1)
            over = worst < m * (radius + 1)
            out = np.isin(of, active[over])
            done.append((of[out], entry[out], distance[out]))
            best = (of[~out], entry[~out], distance[~out])
            active = active[~over]
            radius += 1
        of, entry, distance = (np.concatenate(x) for x in zip(*done, strict=True)) if done else best
        return of, self.order[entry], distance


def _blocks(codes: DataFrame, size: int) -> Iterator[np.ndarray]:
    n = max(1, -(-codes.count() // size))
    for k in range(n):
        part = codes if n == 1 else codes.where(F.pmod(F.xxhash64("code"), F.lit(n)) == k)
        yield part.toArrow()["code"].to_numpy().view(_U)


def top_k(index: DataFrame, queries: DataFrame, k: int, part: int = PART, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` rows of ``index`` nearest to each row of ``queries``.

    Both have (id, code), code a 64-bit number; rows with a null there are passed over. Equal distances
    go by id. A query finds itself if it is in the index. Repeated index rows count once each; repeated
    query ids with one code are answered once.
    """
    spark = index.sparkSession
    index = index.where("id is not null and code is not null").select("id", "code")
    queries = queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    first = index.withColumn("n", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("n") <= k)
    entries = first.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    n = index.agg(F.approx_count_distinct("code")).first()[0]
    parts = max(1, -(-n // part), min(spark.sparkContext.defaultParallelism, -(-n // min(part, LEAST_PART))))
    dealt = entries.repartition(parts, "code")

    def run(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        whole, ids = table["code"].to_numpy().view(_U), table["ids"].combine_chunks()
        least = ids.values.to_numpy()[ids.offsets.to_numpy()[:-1]]
        for a in range(0, len(whole), 4 * part):  # hash parts are about even; this bounds them whatever they are
            tables = MultiIndex(whole[a : a + 4 * part], least[a : a + 4 * part])
            for q in range(0, len(shared.value), 1 << 12):
                some = shared.value[q : q + (1 << 12)]
                of, entry, distance = tables.search(some, k)
                yield pa.RecordBatch.from_arrays([pa.array(some[of].view(np.int64)), ids.take(pa.array(entry + a)), pa.array(distance)], ["query", "ids", "distance"])

    found = None
    for codes in _blocks(queries.select(F.col("query").alias("code")).distinct(), block):
        shared = spark.sparkContext.broadcast(codes)
        each = dealt.mapInArrow(lambda batches, shared=shared: run(shared, batches), "query long, ids array<long>, distance long")
        found = each if found is None else found.union(each)
    rows = found.select("query", F.explode("ids").alias("id"), "distance")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where(F.col("rank") <= k)
    return queries.join(ranked, "query").select("query_id", F.col("rank").cast("long").alias("rank"), "id", "distance")
