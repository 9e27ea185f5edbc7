"""Toxicity by non-negative positive-unlabelled learning.

The classifier is a logistic model over hashed words and beginnings of words (present or not), learnt in numpy from confirmed toxic
texts (P) and unlabelled ones (U). With the class prior p the risk of the negatives is what the unlabelled
texts show beyond the positives' share,

    R = p * E_P[loss(+)] + max(0, E_U[loss(-)] - p * E_P[loss(-)]),

and where that difference turns negative, the step goes the other way, so that the model can't explain
the toxic texts among the unlabelled away by overfitting.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ALPHANUMERIC, fold_of, map_batches, mix64, text_bytes, words

BITS = 21
BUCKETS = 1 << BITS
#: Lengths in bytes of the beginnings of words that are features beside the words.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Bound of the sample that the classifier is fitted on: texts of each kind. They are learnt and all texts scored whole.
MOST_POSITIVE = 2_000
MOST_UNLABELLED = 6_000
STEPS = 400
SIGNIFICANT = 4.0
RELAXED = 0.1
_U = np.uint64


def word_buckets(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text's words and of their first bytes, and the texts' bounds among them.

    With ``wanted``, a flag for each bucket, only those. Beginnings stand for inflected forms of a word.
    """
    raw, at = text_bytes(texts)
    hashes, start, end, cut = words(raw, at, ALPHANUMERIC)
    owner = np.repeat(np.arange(len(cut) - 1, dtype=_U), np.diff(cut))
    size = end - start
    both, head = [], np.zeros(len(start), _U)

    def add(mixed: np.ndarray, of: np.ndarray) -> None:
        bucket = mixed >> _U(64 - BITS)
        if wanted is not None:
            some = np.flatnonzero(wanted[bucket])
            bucket, of = bucket[some], of[some]
        both.append(of * _U(BUCKETS) + bucket)

    add(hashes, owner)
    for k in range(max(BEGINNINGS)):
        long = np.flatnonzero(size > k)
        byte = raw[start[long] + k].astype(_U)
        head[long] = head[long] * _U(257) + np.where((byte >= 0x41) & (byte <= 0x5A), byte + _U(32), byte)
        if k + 1 in BEGINNINGS:
            add(mix64(head[long] * _U(16) + _U(k + 1)), owner[long])
    found = np.unique(np.concatenate(both))
    return (found % _U(BUCKETS)).astype(np.int64), np.searchsorted(found // _U(BUCKETS), np.arange(len(cut), dtype=_U))


@dataclass
class Toxicity:
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        at, bounds = word_buckets(texts, self.weights != 0)
        return 1 / (1 + np.exp(-np.clip(self.bias + _sums(self.weights[at], bounds), -30, 30)))


def _sums(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(x))
    return total[bounds[1:]] - total[bounds[:-1]]


def nn_pu_fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = STEPS) -> Toxicity:
    """Minimise the non-negative risk by accelerated proximal gradient.

    A word's penalty is SIGNIFICANT standard errors of its part of the gradient if it were as common in the
    positives as in the unlabelled, so words that differ by chance keep weight 0; only words above it at the
    start are carried along. Without positives or unlabelled texts every score is the prior.
    """
    prior = min(max(prior, 1e-4), 0.5)
    start = float(np.log(prior / (1 - prior)))
    positive = list({x.tobytes(): x for x in positive}.values())
    if not positive or not unlabelled:
        return Toxicity(np.zeros(BUCKETS), start)
    in_p = np.bincount(np.concatenate(positive), minlength=BUCKETS) / len(positive)
    in_u = np.bincount(np.concatenate(unlabelled), minlength=BUCKETS) / len(unlabelled)
    null = np.maximum(in_u, 1 / len(unlabelled))
    penalty = SIGNIFICANT * prior * np.sqrt(null * (1 / len(positive) + 1 / len(unlabelled)))
    keep = np.flatnonzero(prior * np.abs(in_p - in_u) > penalty)
    penalty = penalty[keep]
    place = np.full(BUCKETS, -1)
    place[keep] = np.arange(len(keep))

    def pack(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = [x[x >= 0] for r in rows for x in (place[r],)]
        n = np.array([len(x) for x in kept])
        return np.concatenate(kept), np.append(0, np.cumsum(n)), np.repeat(np.arange(len(kept)), n)

    p, u = pack(positive), pack(unlabelled)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    times = lambda x, v: _sums(v[x[0]], x[1])
    back = lambda x, r: np.bincount(x[0], r[x[2]], len(keep))
    v = np.ones(len(keep))  # power rounds: the curvature of the unlabelled part bounds the step
    for _ in range(12 * bool(len(keep))):
        z = times(u, v)
        v = back(u, z) / len(unlabelled) + 1e-12
        curve = np.linalg.norm(v)
        v /= curve
    rate = 1 / (0.25 * (1.2 * curve if len(keep) else 0) + 0.25)
    w, b = np.zeros(len(keep)), start
    fast_w, fast_b, t = w, b, 1.0
    for k in range(2 * steps):
        if k == steps:  # what the full penalty left is fitted on with a small part of it, so that scores don't shrink
            penalty, t = np.where(w != 0, RELAXED * penalty, np.inf), 1.0
            fast_w, fast_b = w, b
        sp, su = sigmoid(fast_b + times(p, fast_w)), sigmoid(fast_b + times(u, fast_w))
        of_p, of_u = -np.log1p(-np.minimum(sp, 1 - 1e-12)), -np.log1p(-np.minimum(su, 1 - 1e-12))
        # gradients of the logistic loss in the score: s - 1 for a positive, s for a negative
        if of_u.mean() >= prior * of_p.mean():
            up, uu = np.full(len(sp), -prior / len(sp)), su / len(su)
        else:
            up, uu = prior * sp / len(sp), -su / len(su)
        new = fast_w - rate * (back(p, up) + back(u, uu))
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = fast_b - rate * (up.sum() + uu.sum())
        if (fast_w - new) @ (new - w) + (fast_b - new_b) * (new_b - b) > 0:
            t = 1.0  # momentum starts anew where it points uphill
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        fast_w, fast_b = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    weights = np.zeros(BUCKETS)
    weights[keep] = w
    return Toxicity(weights, float(b))


def nn_risk(score_p: np.ndarray, score_u: np.ndarray, prior: float) -> float:
    """The non-negative risk of scores of the positives and of the unlabelled."""
    at_least = lambda x: np.log(np.maximum(x, 1e-12))
    return float(-prior * at_least(score_p).mean() + max(0.0, -at_least(1 - score_u).mean() + prior * at_least(1 - score_p).mean()))


def hash_bound(share: float) -> int:
    """The signed 64-bit number that a ``share`` of all hashes don't exceed."""
    return min(int(share * (1 << 64)), (1 << 64) - 1) - (1 << 63)


def _share(n: int, most: int) -> float:
    """The share of ``n`` rows that surely holds the ``most`` lowest hashes: half as many again and some."""
    return min(1.0, (1.5 * most + 100) / max(n, 1))


def _sample(rows: DataFrame, most: int, share: float = 1.0) -> DataFrame:
    """The word buckets (``words``, packed) of at most ``most`` rows, those whose ids hash lowest."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, bounds = word_buckets(batch.column(1))
        packed = [at[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["doc_id", "words"])

    picked = rows.where(F.xxhash64("doc_id") <= F.lit(hash_bound(share)))
    return map_batches(picked.select("doc_id", "text"), run, "doc_id long, words binary", "text").orderBy(F.xxhash64("doc_id"), "words").limit(most).select("words")


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Toxicity:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), from labels of ids in ``train`` only.

    Positives are texts labelled 1; unlabelled ones are drawn from all texts of ids in ``train``, whatever
    their label. ``prior``, the toxic share of all texts, is by default the labels' own share (0.05 without
    labels). The fit uses at most ``most_positive`` and ``most_unlabelled`` texts, those whose ids hash lowest, in one
    task; only the model comes to the driver.
    """
    train = F.lit(True) if train is None else train
    known = labels.where(train & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*"), F.sum("toxic")).first()
    if prior is None:
        prior = float(counts[1] or 0) / counts[0] if counts[0] else 0.05
    docs = docs.where(train & F.col("doc_id").isNotNull())
    positive = docs.join(known.where("toxic = 1"), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            for side, packed in zip(batch["side"].to_pylist(), batch["words"].to_pylist(), strict=True):
                sides[side].append(np.frombuffer(packed, np.int32).astype(np.int64))
        model = nn_pu_fit(*sides, prior)
        at = np.flatnonzero(model.weights)
        lean = pickle.dumps((at, model.weights[at], model.bias))
        yield pa.RecordBatch.from_arrays([pa.array([lean], pa.binary()), pa.array([len(sides[1])])], ["model", "n"])

    n = docs.count()
    for share in (_share(n, most_unlabelled), 1.0):
        p = _sample(positive, most_positive, _share(counts[1] or 0, most_positive) if share < 1 else 1.0)
        u = _sample(docs, most_unlabelled, share)
        both = p.select(F.lit(0).alias("side"), "words").union(u.select(F.lit(1).alias("side"), "words"))
        made = both.coalesce(1).mapInArrow(run, "model binary, n long").first()
        if made.n >= min(n, most_unlabelled) or share == 1.0:  # few ids with very many rows can miss the share: then all rows are looked at
            break
    at, weights, bias = pickle.loads(made.model)
    model = Toxicity(np.zeros(BUCKETS), bias)
    model.weights[at] = weights
    return model


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: toxic likelier) from the whole text, however long; null counts as empty.

    A column ``score`` of ``docs`` is replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score") + ", score double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column("text")))], [*batch.schema.names, "score"])

    return map_batches(docs.select(*(c for c in docs.columns if c != "score")), run, schema, "text")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """Each row of ``docs`` with held_out, score and predicted (score >= 0.5), learnt from the other folds.

    The fold is crc32(doc_id as text) modulo ``folds``. Null ids are never learnt from and not held out.
    Repeated rows get equal scores; without labels all scores are low; empty tables give empty results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    fold = fold_of("doc_id", folds)
    out = score(docs, fit(docs, labels, fold != held_out_fold))
    return out.select("doc_id", F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
