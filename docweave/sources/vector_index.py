"""A stored index of vectors in clusters, searched exactly: no cluster is read that the triangle inequality rules out.

Vectors of unit length lie in clusters around centroids; each cluster has its radius, each point its distance
from the centroid. By the cosine two unit vectors are sqrt(2 - 2 * cosine) apart. If a question already has its k
best at distance t, a cluster whose centroid is farther than its radius + t holds nothing better, and in the others
only points whose distance from the centroid differs by at most t from the question's can be.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from itertools import islice
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from docweave.operators import points as P
from docweave.sources import tables

#: Bounds of what the driver holds while centroids are placed: clusters, and sampled points for each.
MOST_CLUSTERS, SAMPLE_OF_EACH, ROUNDS = 4_096, 24, 4
#: The cluster of vectors of length zero, which have no direction and score 0.
ZERO = -1
#: More than rounding can add to a distance.
SLACK = 1e-6


def _units(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _centroids(sample: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds over a sample; any centroids give right answers, good ones short searches."""
    near = sample[np.linspace(0, len(sample) - 1, min(k, len(sample))).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ near.T, axis=1)
        total = np.zeros_like(near)
        np.add.at(total, own, sample)
        near = np.where(np.linalg.norm(total, axis=1, keepdims=True) > 0, _units(total), near)
    return near


def build(points: DataFrame, path: str, clusters: int | None = None) -> None:
    """Write the index of ``points`` (id, seq, vector, payload columns) to the versioned table at ``path``.

    ``clusters`` is the square root of the number of points unless given, at most MOST_CLUSTERS. Centroids come
    from the points whose ids hash lowest, SAMPLE_OF_EACH for each cluster; every point is indexed. Null vectors
    are left out; sizes that differ are an error. A cluster is a folder, in which points lie by their distance.
    """
    spark = points.sparkSession
    rows = points.where("vector IS NOT NULL")
    n = rows.count()
    k = max(1, min(clusters or int(np.ceil(np.sqrt(n))), MOST_CLUSTERS))
    sample = rows.select("vector", F.xxhash64("id", "seq").alias("h")).orderBy("h").limit(k * SAMPLE_OF_EACH).toArrow()
    vectors = [v for v in sample.column("vector").to_pylist() if any(v)]
    if vectors and len({len(v) for v in vectors}) != 1:
        raise ValueError("vectors differ in size")
    near = _centroids(_units(np.array(vectors, float)), k) if vectors else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(near)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector")
            if len(around) and (np.diff(vectors.offsets.to_numpy()) != around.shape[1]).any():
                raise ValueError("vectors differ in size")
            unit = _units(vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1))
            some = unit.any(axis=1)
            cosine = unit @ around.T if len(around) else np.zeros((len(unit), 1))
            own = np.where(some, np.argmax(cosine, axis=1), ZERO)
            apart = np.where(some, np.sqrt(np.maximum(0, 2 - 2 * cosine.max(axis=1))), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(apart)], [*batch.schema.names, "cluster", "apart"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(assign, f"{kinds}, cluster int, apart double")
    name = tables.write(placed.repartition("cluster").sortWithinPartitions("cluster", "apart"), f"{path}/points", partition_by=["cluster"] if n else None)  # no rows would leave no schema
    stored = tables.read(spark, f"{path}/points")
    sizes = {r.cluster: (r.n, r.radius) for r in stored.groupBy("cluster").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}  # one row for each cluster
    rows = [(int(c), int(n), float(r), near[c].tolist() if c >= 0 else None) for c, (n, r) in sizes.items()]
    tables.write(spark.createDataFrame(rows, "cluster int, n long, radius double, centroid array<double>").coalesce(1).withColumn("of", F.lit(name)), f"{path}/clusters")


def search(spark: SparkSession, path: str, queries: DataFrame, limit: int, filters: Mapping[str, Any] | None = None, threshold: float | None = None, digits: int | None = None, payload: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """``points.nearest`` over the index, row for row the same, and how many points were read of how many.

    A first look at each question's nearest clusters, twice as many until they hold enough that passes the filters,
    gives its bound; then every cluster that the bound doesn't rule out is searched. Questions are a stated set, in
    blocks of ``points.QUERY_BLOCK``; the driver holds a block's distances to the centroids and its bounds. A question
    of length zero is 0 from everything and reads all.
    """
    stored = tables.read(spark, f"{path}/points")
    clusters = sorted(tables.read(spark, f"{path}/clusters").collect(), key=lambda r: r.cluster)  # at most MOST_CLUSTERS + 1
    known = {"points": sum(r.n for r in clusters), "first": 0, "read": 0}
    rows = queries.select("query_id", "query_vector").where("query_vector IS NOT NULL").toLocalIterator()
    found = None
    for block in iter(lambda: list(islice(rows, P.QUERY_BLOCK)), []):
        one = _block(stored, clusters, queries, block, limit, filters, threshold, digits, payload, known)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = P.nearest(stored.limit(0).select("id", "seq", "vector", *payload), queries.limit(0), limit, payload=payload)
    return found, known


def _block(stored: DataFrame, clusters: list[Row], queries: DataFrame, block: list[Row], limit: int, filters, threshold: float | None, digits: int | None, payload: Sequence[str], known: dict) -> DataFrame:
    spark = stored.sparkSession
    places = 12 if digits is None else digits
    wanted = _units(np.array([list(r.query_vector) for r in block], float).reshape(len(block), -1))
    real = [r for r in clusters if r.cluster != ZERO]
    sizes = np.array([r.n for r in real])
    radius = np.array([r.radius for r in real])
    around = np.array([r.centroid for r in real]).reshape(len(real), -1) if real else np.zeros((0, wanted.shape[1]))
    if len(real) and around.shape[1] != wanted.shape[1]:
        raise ValueError(f"vector size isn't {wanted.shape[1]}")
    apart = np.sqrt(np.maximum(0, 2 - 2 * wanted @ around.T)) if len(real) else np.zeros((len(block), 0))
    none = ~wanted.any(axis=1)
    order = np.argsort(apart, axis=1, kind="stable")
    rows = stored.where(P.predicate(filters))
    bound = np.full(len(block), np.inf)  # of the distance of the k-th best
    probes = 1
    left = np.flatnonzero(~none) if len(real) else np.zeros(0, int)
    while len(left):
        reach = np.zeros(apart.shape, bool)
        picked = np.zeros((len(left), len(real)), bool)
        np.put_along_axis(picked, order[left, :probes], True, axis=1)
        reach[left] = picked
        known["first"] += int(sizes[reach.any(axis=0)].sum())
        near = _scores(rows, real, wanted, reach, apart, bound, limit, None, places, [])
        worst = near.groupBy("_q").agg(F.count("*").alias("n"), F.min("score").alias("least")).collect()  # one row for each question
        for r in worst:
            if r.n >= limit:
                bound[r._q] = np.sqrt(max(0.0, 2 - 2 * (r.least - 10.0**-places))) + SLACK
        left = left[np.isinf(bound[left])] if probes < len(real) else left[:0]
        probes *= 2
    if threshold is not None:
        bound = np.minimum(bound, np.sqrt(np.maximum(0, 2 - 2 * (threshold - 10.0**-places))) + SLACK)
    bound[none] = np.inf
    reach = apart - radius[None, :] <= bound[:, None]
    known["read"] += int(sizes[reach.any(axis=0)].sum()) + sum(r.n for r in clusters if r.cluster == ZERO)
    near = _scores(rows, real, wanted, reach, apart, bound, limit, threshold, places, payload)
    ids = queries.select("query_id").schema.add("_q", IntegerType())
    numbered = spark.createDataFrame([(r.query_id, k) for k, r in enumerate(block)], ids)
    return near.join(F.broadcast(numbered), "_q").select("query_id", "rank", "id", "score", *payload)


def _scores(rows: DataFrame, real: list[Row], wanted: np.ndarray, reach: np.ndarray, apart: np.ndarray, bound: np.ndarray, limit: int, threshold: float | None, places: int, payload: Sequence[str]) -> DataFrame:
    """The best ``limit`` of each question among the points within ``bound`` in the clusters it reaches: _q, rank, id, seq, score, payload."""
    spark = rows.sparkSession
    used = np.flatnonzero(reach.any(axis=0))
    far = np.where(reach, bound[:, None], -np.inf)
    low = np.where(reach, apart - far, np.inf).min(axis=0)[used] - SLACK
    high = np.where(reach, apart + far, -np.inf).max(axis=0)[used] + SLACK
    ranges = [(real[c].cluster, max(float(a), -1.0), min(float(b), 3.0)) for c, a, b in zip(used.tolist(), low, high, strict=True)] + [(ZERO, -1.0, 3.0)]
    of = {real[c].cluster: np.flatnonzero(reach[:, c]) for c in used.tolist()} | {ZERO: np.arange(len(wanted))}
    column = {r.cluster: k for k, r in enumerate(real)}
    shared = spark.sparkContext.broadcast((wanted, of, column, apart, bound))
    carried = ["id", "seq", *payload]
    bounds = spark.createDataFrame(ranges, "cluster_ int, low double, high double")
    within = rows.where(F.col("cluster").isin([c for c, _, _ in ranges])).join(F.broadcast(bounds), (F.col("cluster") == F.col("cluster_")) & F.col("apart").between(F.col("low"), F.col("high")))
    lean = within.select(*carried, "vector", "cluster", "apart")
    kinds = ", ".join(f"`{c}` {lean.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, lists, place, away, most = shared.value
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            for c in np.unique(own):
                at = np.flatnonzero(own == c)
                part = batch.take(pa.array(at))
                vectors = part.column("vector")
                unit = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), -1)
                norm = np.linalg.norm(unit, axis=1)
                q = lists[int(c)]
                dots = (asked[q] @ unit.T) / np.where(norm > 0, norm, 1)
                score = np.round(np.where(norm > 0, dots, 0.0), places) + 0.0
                if c != ZERO:
                    ring = np.abs(away[q, place[int(c)]][:, None] - part.column("apart").to_numpy()[None, :]) <= most[q][:, None] + SLACK
                    score = np.where(ring, score, -np.inf)
                seq = part.column("seq").to_numpy(zero_copy_only=False)
                i, k = np.nonzero(score >= (-2.0 if threshold is None else threshold))
                best = np.lexsort((seq[k], -score[i, k], i))
                i, k = i[best], k[best]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < limit
                i, k = i[keep], k[keep]
                yield pa.RecordBatch.from_arrays([pa.array(q[i], pa.int32()), *(part.column(x).take(pa.array(k)) for x in carried), pa.array(score[i, k])], ["_q", *carried, "score"])

    found = lean.mapInArrow(run, f"_q int, {kinds}, score double")
    best = Window.partitionBy("_q").orderBy(F.desc("score"), "seq")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
