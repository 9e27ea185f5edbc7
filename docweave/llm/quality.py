"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, and learned filters slide over them. Overlapping chunks (256 bytes, every
192) cover the whole text; in each the filters are max-pooled, and the mean, largest and smallest of the
chunks' values and the text's length go through a small dense layer into one probability. Gradients flow back through the
pooled positions only. The fit uses a bounded sample of labelled texts; every text is scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import fold_of, map_batches, text_bytes

WIDTH, EMBEDDED, FILTERS, HIDDEN = 6, 6, 24, 16
CELL, CELLS, STEP = 64, 4, 3  # a chunk is 4 cells of 64 bytes and begins every 3 cells
INPUTS = 3 * FILTERS + 2
#: Bound of the sample that the network is fitted on, for each label.
MOST_LABELLED = 1_500
EPOCHS = 14
RATE = 4e-3


class ByteNetwork:
    """The network's parameters, its forward pass and its gradient step."""

    def __init__(self, seed: int = 0, share: float = 0.5) -> None:
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 1, shape).astype(np.float32)
        self.p = {
            "embedding": draw(256, EMBEDDED) * 0.5,
            "filters": draw(WIDTH * EMBEDDED, FILTERS) * np.float32(np.sqrt(2 / (WIDTH * EMBEDDED))),
            "shift": np.zeros(FILTERS, np.float32),
            "hidden": draw(INPUTS, HIDDEN) * np.float32(np.sqrt(1 / INPUTS)),
            "hidden_shift": np.zeros(HIDDEN, np.float32),
            "out": draw(HIDDEN) * np.float32(np.sqrt(1 / HIDDEN)),
            "out_shift": np.array([np.log(share / (1 - share))], np.float32),
        }
        self.first = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.second = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.steps = 0

    def _laid_out(self, raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts one after the other, each from the start of a cell and with WIDTH - 1 zeros behind it; their first cells."""
        size = np.diff(bounds)
        cells = (size + WIDTH - 1 + CELL - 1) // CELL
        first = np.append(0, np.cumsum(cells))
        out = np.zeros(first[-1] * CELL + WIDTH - 1, np.uint8)
        out[np.arange(len(raw)) + np.repeat(first[:-1] * CELL - bounds[:-1], size)] = raw
        size = np.repeat(size, cells)
        within = np.arange(first[-1]) - np.repeat(first[:-1], cells)
        self.filled = np.clip(size - within * CELL, 0, CELL)  # windows of each cell that begin inside the text
        return out, first

    def _pooled(self, laid: np.ndarray, first: np.ndarray, keep: bool) -> tuple:
        """Largest filter values of each cell, and where, a few thousand cells at a time."""
        p, n = self.p, int(first[-1])
        top, where = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int32) if keep else None
        embedded = p["embedding"]
        for a in range(0, n, 4096):
            b = min(n, a + 4096)
            x = embedded[laid[a * CELL : b * CELL + WIDTH - 1]].ravel()
            windows = np.lib.stride_tricks.as_strided(x, ((b - a) * CELL, WIDTH * EMBEDDED), (x.itemsize * EMBEDDED, x.itemsize))
            z = (np.ascontiguousarray(windows) @ p["filters"]).reshape(b - a, CELL, FILTERS)
            short = np.flatnonzero(self.filled[a:b] < CELL)
            z[short] = np.where(np.arange(CELL)[None, :, None] < self.filled[a:b][short][:, None, None], z[short], np.float32(-1e9))
            if keep:
                where[a:b] = z.argmax(1)
                top[a:b] = np.take_along_axis(z, where[a:b, None], 1)[:, 0]
            else:
                top[a:b] = z.max(1)
        return top + p["shift"], where

    def _texts(self, top: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> tuple:
        """Chunks' values and, for each text, their mean, largest and smallest."""
        cells = np.diff(first)
        chunks = np.maximum(1, -(-(cells - CELLS) // STEP) + 1)
        owner = np.repeat(np.arange(len(cells)), chunks)
        start = np.append(0, np.cumsum(chunks))
        begin = first[owner] + (np.arange(start[-1]) - start[owner]) * STEP
        member = np.minimum(begin[:, None] + np.arange(CELLS), first[owner + 1][:, None] - 1)
        values = top[member]
        chunk = np.maximum(values.max(1), 0)
        n = np.diff(bounds)
        size = np.stack([np.log1p(n) / 4, np.minimum(n, CELL * CELLS) / (CELL * CELLS) * 2], 1)
        mean = np.add.reduceat(chunk, start[:-1]) / chunks[:, None]
        return member, values, chunk, start, np.concatenate([mean, np.maximum.reduceat(chunk, start[:-1]), np.minimum.reduceat(chunk, start[:-1]), size], 1).astype(np.float32)

    def _head(self, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(whole @ self.p["hidden"] + self.p["hidden_shift"])
        return h, 1 / (1 + np.exp(-np.clip(h @ self.p["out"] + self.p["out_shift"][0], -30, 30)))

    def score(self, texts: pa.Array) -> np.ndarray:
        raw, bounds = text_bytes(texts)
        laid, first = self._laid_out(raw, bounds)
        top, _ = self._pooled(laid, first, False)
        return self._head(self._texts(top, first, bounds)[-1])[1].astype(float)

    def step(self, raw: np.ndarray, bounds: np.ndarray, true: np.ndarray, weight: np.ndarray, rate: float = RATE) -> float:
        """One Adam step on a mini-batch; returns its weighted log loss."""
        p = self.p
        laid, first = self._laid_out(raw, bounds)
        top, where = self._pooled(laid, first, True)
        member, values, chunk, start, whole = self._texts(top, first, bounds)
        h, s = self._head(whole)
        weight = weight / weight.sum()
        loss = -(weight * np.log(np.clip(np.where(true == 1, s, 1 - s), 1e-7, 1))).sum()
        g = {}
        d = ((s - true) * weight).astype(np.float32)
        g["out"], g["out_shift"] = h.T @ d, np.array([d.sum()])
        dh = d[:, None] * p["out"] * (1 - h * h)
        g["hidden"], g["hidden_shift"] = whole.T @ dh, dh.sum(0)
        dw = dh @ p["hidden"].T
        count = np.diff(start)
        owner = np.repeat(np.arange(len(count)), count)
        dc = dw[owner, :FILTERS] / count[owner][:, None]
        for part, best in ((slice(FILTERS, 2 * FILTERS), whole[:, FILTERS : 2 * FILTERS]), (slice(2 * FILTERS, 3 * FILTERS), whole[:, 2 * FILTERS : 3 * FILTERS])):
            hit = chunk == best[owner]
            dc = dc + hit * (dw[:, part] / np.maximum(np.add.reduceat(hit, start[:-1], dtype=np.float32), 1))[owner]
        dc = (dc * (chunk > 0)).astype(np.float32)
        cell = np.take_along_axis(member, values.argmax(1), 1)
        at = cell * CELL + np.take_along_axis(where, cell, 0)
        bytes_at = laid[at[..., None] + np.arange(WIDTH)]
        seen = p["embedding"][bytes_at].reshape(*at.shape, WIDTH * EMBEDDED)
        g["filters"], g["shift"] = np.einsum("cfx,cf->xf", seen, dc), dc.sum(0)
        back = (dc[..., None] * p["filters"].T[None]).reshape(-1, EMBEDDED)
        flat = bytes_at.ravel()
        g["embedding"] = np.stack([np.bincount(flat, back[:, k], 256) for k in range(EMBEDDED)], 1)
        self.steps += 1
        for k, v in g.items():
            v = v.astype(np.float32)
            self.first[k] += 0.1 * (v - self.first[k])
            self.second[k] += 0.01 * (v * v - self.second[k])
            unbiased = np.sqrt(self.second[k] / (1 - 0.99**self.steps)) + 1e-7
            p[k] -= rate * self.first[k] / (1 - 0.9**self.steps) / unbiased
        return float(loss)


def _some_cut(texts: pa.Array, true: np.ndarray, r: np.random.Generator) -> pa.Array:
    """Every eighth good text shortened to 20 to 99 characters: short good texts are rare among the labelled."""
    size = np.where((true == 1) & (r.random(len(true)) < 0.125), r.integers(20, 100, len(true)), 0).tolist()
    return pa.array([t[:n].strip() if n and t else t for t, n in zip(texts.to_pylist(), size, strict=True)], pa.string())


def train(texts: pa.Array, true: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, batch: int = 48, seed: int = 0) -> ByteNetwork:
    share = float(np.clip((true * weight).sum() / max(weight.sum(), 1e-9), 0.02, 0.98)) if len(true) else 0.5
    network = ByteNetwork(seed, share)
    if not len(true) or true.min() == true.max():
        network.p["out"][:] = 0  # nothing to tell apart: the share is the answer
        return network
    r = np.random.default_rng(seed + 1)
    epochs = max(epochs, min(60, 40 * batch // len(true)))
    total = epochs * -(-len(true) // batch)
    for _ in range(epochs):
        order = r.permutation(len(true))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            raw, bounds = text_bytes(_some_cut(texts.take(pa.array(pick)), true[pick], r))
            rate = RATE * (0.1 + 0.9 * 0.5 * (1 + np.cos(np.pi * network.steps / total)))
            network.step(raw, bounds, true[pick], weight[pick], rate)
    return network


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, most: int = MOST_LABELLED) -> ByteNetwork:
    """A network from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), from ids in ``allowed`` only.

    At most ``most`` texts of either label, chosen by a hash of their ids, and weighted so that both labels
    keep their share. Null labels and ids are passed over. Without labels every score is 0.5.
    """
    allowed = F.lit(True) if allowed is None else allowed
    known = labels.where(allowed & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in known.groupBy("quality").count().collect()}
    chosen = None
    for label in sorted(counts):
        part = known.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        return train(pa.array([], pa.string()), np.zeros(0), np.zeros(0))
    sample = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").orderBy(F.xxhash64("doc_id", F.lit(3)), "text").limit(4 * most)
    have = {True: counts.get(1, 0), False: sum(v for k, v in counts.items() if k != 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            got = pa.Table.from_batches(held)
            true = (got["quality"].to_numpy() == 1).astype(np.float32)
            weight = np.where(true == 1, have[True] / max(1, (true == 1).sum()), have[False] / max(1, (true == 0).sum()))
            network = train(got["text"].combine_chunks(), true, weight / weight.mean())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(network.p)], pa.binary())], ["network"])

    made = sample.coalesce(1).mapInArrow(run, "network binary").first()  # one task over the bounded sample
    if made is None:
        return train(pa.array([], pa.string()), np.zeros(0), np.zeros(0))
    network = ByteNetwork()
    network.p = pickle.loads(made.network)
    return network


def score(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: good likelier) from the whole text, however long; null counts as empty.

    A column ``score`` of ``docs`` is replaced; all others stay.
    """
    network.first = network.second = {}
    shared = docs.sparkSession.sparkContext.broadcast(network)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "score") + ", score double"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(batch.column("text")))], [*batch.schema.names, "score"])

    return map_batches(docs.select(*(c for c in docs.columns if c != "score")), run, schema, "text")


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """Each row of ``docs`` with held_out, score and predicted (score >= 0.3), learnt from the other folds.

    The fold is crc32(doc_id as text) modulo ``folds``. Null ids are never learnt from and not held out.
    Repeated rows get equal scores; empty tables give empty results.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    fold = fold_of("doc_id", folds)
    out = score(docs, fit(docs, labels, fold != held_out_fold))
    return out.select("doc_id", F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
