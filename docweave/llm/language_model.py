"""Language-model scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(slot | class, history) * P(word | slot, history). The first two factors are
softmaxes over hashed features of the history: the last word, the last two, and (for classes) the one before
the last, a skip; the second one's features are joined with the class. The most frequent words are classes of their own; the
others go by their ending, and endings that follow alike words share a class. Of each such class the most
frequent words have slots of their own, so for them the second factor is a softmax over words; the class's
other words share GROUPS slots, again by endings that follow alike words. There the third factor tells them apart, however
many and however rare they are: the word's share of its slot, less what words seen once suggest for unseen ones,
times a weight of the feature that joins the word with the class of the last word. These weights are counted for
every pair met, not learnt, and so is each sum they are divided by (``Shared``); no bound leaves out a word or a pair.

The weights are learnt by distributed gradient updates: in each round every training text is run over, each
partition starts from the weights of the last round, and the rows that partitions touched are averaged by
how often they did. Only touched rows travel. The table's size follows the number of training tokens
(``table_rows``) up to MOST_BUCKETS, which bounds what a worker holds; the number of training partitions is
such that their tables are a small part of the text (``train_parts``), whatever the input is dealt into.

Everything is learnt from all training documents. Word counts, with those after each class, meet the texts in
two ways: the most frequent words (a table of bounded size) by broadcast, all others by a shuffled join, so no
vocabulary has to fit in memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import SPACED, fold_of, map_batches, mix64, staged, text_bytes, text_slices, words

ENDINGS = 256
OWN_CLASSES = 16
END_CLASSES = 16
CLASSES = OWN_CLASSES + END_CLASSES
#: Slots of a class: its most frequent words, and groups of its other words.
WORDS = 24
GROUPS = 8
SLOTS = WORDS + GROUPS
#: What stands before a word: one of the classes, or the start.
BEFORE = CLASSES + 1
#: A word of a shared slot that was met so often goes half by its own counts after each class, half by its share.
TRUST = 20
#: Pairs of a word and the class before it that a task sums at a time.
PAIRS = 1 << 20
#: Bounds of the rows of a factor's weight table, 4 * CLASSES (or SLOTS) bytes each.
LEAST_BUCKETS = 1 << 15
MOST_BUCKETS = 1 << 18
TOKENS_A_ROW = 512
ROUNDS = 1
BATCH = 4096
RATE = 0.3
#: Words whose counts are broadcast, 16 bytes each and 4 for each class before them; the rest are joined.
FREQUENT = 1 << 17
#: Rows of the weight table that travel together when partitions' tables are averaged.
CHUNK = 1 << 10
#: Partitions whose rows one task merges; more are merged in two steps.
MERGED = 32

_U = np.uint64
_END = mix64(np.array([0xE0D], _U))[0]
_START = mix64(np.array([0xB05], _U))[0]
_IMPOSSIBLE = -100.0


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of texts, each text with an end after its last: hashes, ending numbers, bounds."""
    raw, cut = text_bytes(texts)
    hashes, start, end, bounds = words(raw, cut, SPACED)
    n, docs = len(hashes), len(bounds) - 1
    lower = raw[end - 1] if n else np.zeros(0, np.uint8)
    before = np.where(end - start > 1, raw[np.maximum(end - 2, 0)], 0) if n else np.zeros(0, np.uint8)
    fold = lambda b: np.where((b >= 0x41) & (b <= 0x5A), b + 32, b).astype(_U)
    ending = (mix64(fold(lower) * _U(256) + fold(before) + _U(7)) % _U(ENDINGS - 1)).astype(np.int64) + 1
    place = np.arange(n) + np.repeat(np.arange(docs), np.diff(bounds))
    out, kind = np.full(n + docs, _END), np.zeros(n + docs, np.int64)
    out[place], kind[place] = hashes, ending
    return out, kind, bounds + np.arange(docs + 1)


def features(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64-bit hashes of each token's history: last word, last two, the one before the last (a skip)."""
    n = len(hashes)
    at = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))
    last = []
    for k in (1, 2):
        x = np.full(n, _START)
        ok = np.flatnonzero(at >= k)
        x[ok] = hashes[ok - k]
        last.append(x)
    odd = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)]
    each = [last[0] * odd[0], last[0] * odd[1] + last[1] * odd[2], last[1] * odd[3]]
    return np.stack([mix64(x) for x in each], 1)


def class_rows(history: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of the class factor's features in the weight table: its first ``buckets``."""
    return ((history >> _U(17)) & _U(buckets - 1)).astype(np.int64)


def slot_rows(history: np.ndarray, kind: np.ndarray, buckets: int) -> np.ndarray:
    """Rows of the slot factor's features, the last word and the last two joined with the class: the table's second half."""
    joined = (history[:, :2] ^ (kind.astype(_U) * _U(0xD1342543DE82EF95))[:, None]) * _U(0x9E3779B97F4A7C15)
    return ((joined >> _U(29)) & _U(buckets - 1)).astype(np.int64) + buckets


def table_rows(n_tokens: int) -> int:
    """Rows for each factor: the power of two below a TOKENS_A_ROW-th of the training tokens, within bounds."""
    return int(min(max(1 << max(n_tokens // TOKENS_A_ROW, 1).bit_length() - 1, LEAST_BUCKETS), MOST_BUCKETS))


def train_parts(n_tokens: int, buckets: int) -> int:
    """Training partitions: 8, or one for each text (6 bytes a token) of four times what a partition may send."""
    return max(8, 6 * n_tokens // (4 * 2 * buckets * (2 * SLOTS + 6)))


@dataclass
class Classes:
    """Which class and slot a word is in."""

    known: np.ndarray  # hashes of the words with a class or slot of their own, sorted
    known_class: np.ndarray
    known_slot: np.ndarray
    of_ending: np.ndarray
    group_of_ending: np.ndarray

    def __call__(self, hashes: np.ndarray, endings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, slot = self.of_ending[endings], WORDS + self.group_of_ending[endings]
        if len(self.known):
            i = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            own = np.flatnonzero(self.known[i] == hashes)
            kind[own], slot[own] = self.known_class[i[own]], self.known_slot[i[own]]
        return kind, slot


def _group_endings(follows: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """k-means of endings by the distribution of the endings before them, weighted by their counts."""
    shape = np.sqrt(follows / np.maximum(follows.sum(1, keepdims=True), 1))
    centre = shape[np.argsort(-count, kind="stable")[:most]].copy()
    for _ in range(25):
        group = ((shape[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for k in range(len(centre)):
            if (w := count * (group == k)).sum():
                centre[k] = (shape * w[:, None]).sum(0) / w.sum()
    return group


def _gathered(train: DataFrame) -> DataFrame:
    """Counts over all training texts: kind 0 words (with their ending), kind 1 pairs of neighbouring endings."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, ending, bounds = tokens(batch.column(0))
        word, first, n = np.unique(hashes, return_index=True, return_counts=True)
        before = np.append(0, ending[:-1])
        before[bounds[:-1]] = 0
        pair, m = np.unique(ending * ENDINGS + before, return_counts=True)
        kind = np.repeat([0, 1], [len(word), len(pair)])
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.concatenate([word.view(np.int64), pair])), pa.array(np.concatenate([ending[first], np.zeros(len(pair), np.int64)]), pa.int32()), pa.array(np.concatenate([n, m]))], ["kind", "word", "ending", "n"])

    rows = map_batches(train.select("text"), run, "kind int, word long, ending int, n long", "text")
    return rows.groupBy("kind", "word", "ending").agg(F.sum("n").alias("n"))


def _before(kind: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The class of the word before each token, CLASSES at a text's start."""
    before = np.append(CLASSES, kind[:-1])[: len(kind)]
    before[bounds[:-1]] = CLASSES
    return before


def _summed(word: np.ndarray, ending: np.ndarray, before: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry for each word and class before it."""
    key, first, group = np.unique(word + mix64(before), return_index=True, return_inverse=True)
    return word[first], ending[first], before[first], np.bincount(group, n, len(key)).astype(np.int64)


def _counts(train: DataFrame, classes: Classes) -> DataFrame:
    """Each word of the training texts with its ending, count, and how often it was ``met`` after which classes (``before``)."""
    known = train.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            word, ending, before, n = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ending, pa.int32()), pa.array(before, pa.int32()), pa.array(n)], ["word", "ending", "before", "n"])

        held: list[tuple[np.ndarray, ...]] = []
        for whole in batches:
            for batch in text_slices(whole, "text"):
                hashes, ending, bounds = tokens(batch.column(0))
                held.append(_summed(hashes, ending, _before(known.value(hashes, ending)[0], bounds), np.ones(len(hashes), np.int64)))
                if sum(len(x[0]) for x in held) > PAIRS:
                    yield out()
                    held = []
        if held:
            yield out()
        pa.default_memory_pool().release_unused()

    rows = train.select("text").mapInArrow(run, "word long, ending int, before int, n long")
    pairs = rows.repartition("word").groupBy("word", "ending", "before").agg(F.sum("n").alias("n"))
    return pairs.groupBy("word", "ending").agg(F.sum("n").alias("n"), F.collect_list("before").alias("before"), F.collect_list("n").alias("met"))


@dataclass
class Shared:
    """The third factor in the slots that words share.

    After class c, a word met n times, and n_c times after c, has its share of the slot times
    (trust * (n_c / n) / (N_c / N) + 1 - trust) / norm, where trust = n / (n + TRUST), and N and N_c are the sums of
    n and n_c over the slot. ``norm`` is the sum of that over the slot's words, so that they keep what the shares leave them.
    """

    scale: np.ndarray  # N / N_c at each place (a shared slot after a class); 0 at place 0: the slot has one word
    norm: np.ndarray

    def places(self, kind: np.ndarray, slot: np.ndarray, before: np.ndarray) -> np.ndarray:
        shared = (kind >= OWN_CLASSES) & (slot >= WORDS)
        return np.where(shared, ((kind - OWN_CLASSES) * GROUPS + slot - WORDS) * BEFORE + before + 1, 0)

    def weight(self, place, n, met):
        return (met * self.scale[place] + TRUST) / ((n + TRUST) * self.norm[place])


def _shared(others: DataFrame, kind: Column, group: Column) -> Shared:
    """Sums over the words of ``others``, those without a slot of their own; at most BEFORE for each shared slot come back."""
    slot = ((kind - OWN_CLASSES) * GROUPS + group).alias("slot")
    each = others.select(slot, (F.col("n") / (F.col("n") + TRUST)).alias("trust"), F.explode(F.arrays_zip("before", "met")).alias("pair"))
    met, trusted = np.zeros((2, END_CLASSES * GROUPS, BEFORE))
    for r in each.groupBy("slot", "pair.before").agg(F.sum("pair.met").alias("met"), F.sum(F.col("trust") * F.col("pair.met")).alias("trusted")).collect():
        met[r.slot, r.before], trusted[r.slot, r.before] = r.met, r.trusted
    all_met, all_trusted = met.sum(1, keepdims=True), trusted.sum(1, keepdims=True)
    scale = np.where(met > 0, all_met / np.maximum(met, 1), 0)
    norm = 1 + trusted / np.maximum(met, 1) - all_trusted / np.maximum(all_met, 1)
    return Shared(np.append(0, scale), np.append(1, norm))


def _logits(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = weights.take(at[:, 0], axis=0)
    for k in range(1, at.shape[1]):
        z += weights.take(at[:, k], axis=0)
    z += bias
    return z


def _log_softmax(weights: np.ndarray, bias: np.ndarray, at: np.ndarray) -> np.ndarray:
    z = _logits(weights, bias, at)
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def _log_true(weights: np.ndarray, bias: np.ndarray, at: np.ndarray, true: np.ndarray) -> np.ndarray:
    z = _logits(weights, bias, at)
    z -= z.max(1, keepdims=True)
    own = z[np.arange(len(true)), true]
    return own - np.log(np.exp(z, out=z).sum(1))


def _sorted(flat: np.ndarray) -> np.ndarray:
    """A stable order of row numbers, by two radix passes over 16 bits."""
    order = np.argsort((flat & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((flat[order] >> 16).astype(np.uint16), kind="stable")]


def _learn(weights: np.ndarray, squares: np.ndarray, touched: np.ndarray, bias: np.ndarray, at: np.ndarray, true: np.ndarray) -> None:
    """One gradient step of AdaGrad on a mini-batch, in place."""
    if not len(true):
        return
    gradient = _logits(weights, bias, at)
    gradient -= gradient.max(1, keepdims=True)
    np.exp(gradient, out=gradient)
    gradient /= gradient.sum(1, keepdims=True)
    gradient[np.arange(len(true)), true] -= 1
    flat = at.ravel()
    order = _sorted(flat)
    flat, token = flat[order], order // at.shape[1]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    n = np.diff(np.append(start, len(flat)))
    often = np.argsort(-n, kind="stable")
    start, n = start[often], n[often]
    rows, total = flat[start], gradient.take(token[start], axis=0)
    for k in range(1, 12):  # most rows are met a few times: add all second meetings, all third ones, ...
        m = int(np.searchsorted(-n, -k, "left"))
        total[:m] += gradient.take(token[start[:m] + k], axis=0)
    for i in range(int((n > 12).sum())):
        total[i] += gradient.take(token[start[i] + 12 : start[i] + n[i]], axis=0).sum(0)
    squares[rows] += np.einsum("ij,ij->i", total, total) / total.shape[1]
    total *= (-RATE / np.sqrt(squares[rows] + 1))[:, None]
    total += weights.take(rows, axis=0)
    weights[rows] = total
    touched[rows] += n


MOVED = "chunk long, lane long, rows binary, moved binary, touched binary"


def _moved(chunk: int, lane: int, rows: np.ndarray, moved: np.ndarray, touched: np.ndarray) -> pa.RecordBatch:
    packed = [x.astype(kind).tobytes() for x, kind in ((rows, np.int16), (moved, np.float16), (touched, np.float32))]
    return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([lane]), *(pa.array([x], pa.binary()) for x in packed)], ["chunk", "lane", "rows", "moved", "touched"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k, lane, rows, moved, touched in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield k, lane, np.frombuffer(rows, np.int16), np.frombuffer(moved, np.float16).astype(np.float32).reshape(-1, SLOTS), np.frombuffer(touched, np.float32)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Averages of rows' moves, weighted by how often they were touched."""
    total: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for k, lane, rows, moved, touched in _unpacked(batches):
        held, n = total.setdefault((k, lane), (np.zeros((CHUNK, SLOTS), np.float32), np.zeros(CHUNK, np.float32)))
        held[rows] += moved * touched[:, None]
        n[rows] += touched
    for (k, lane), (held, n) in total.items():
        rows = np.flatnonzero(n)
        yield _moved(k, lane, rows, held[rows] / n[rows, None], n[rows])


def _train(train: DataFrame, classes: Classes, bias: np.ndarray, slot_bias: np.ndarray, buckets: int, parts: int, rounds: int) -> np.ndarray:
    spark = train.sparkSession
    weights = np.zeros((2 * buckets, SLOTS), np.float32)
    known = spark.sparkContext.broadcast((classes, bias, slot_bias))
    lanes = -(-parts // MERGED)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            classes, bias, slot_bias = known.value
            own = now.value.copy()
            squares, touched = np.zeros(2 * buckets, np.float32), np.zeros(2 * buckets, np.float32)
            for whole in batches:
                for batch in text_slices(whole, "text", 1 << 20):
                    hashes, ending, bounds = tokens(batch.column(0))
                    history, (kind, slot) = features(hashes, bounds), classes(hashes, ending)
                    mixed = np.argsort(mix64(np.arange(len(kind), dtype=_U)))
                    for k in range(0, len(kind), BATCH):
                        part = mixed[k : k + BATCH]
                        _learn(own, squares, touched, bias, class_rows(history[part], buckets), kind[part])
                        part = part[kind[part] >= OWN_CLASSES]
                        _learn(own, squares, touched, slot_bias[kind[part]], slot_rows(history[part], kind[part], buckets), slot[part])
            lane = TaskContext.get().partitionId() % lanes
            for k in range(0, 2 * buckets, CHUNK):
                rows = np.flatnonzero(touched[k : k + CHUNK])
                if len(rows):
                    yield _moved(k // CHUNK, lane, rows, own[k + rows] - now.value[k + rows], touched[k + rows])

        moved = train.select("text").coalesce(parts).mapInArrow(run, MOVED)
        for keys in (["chunk", "lane"], ["chunk"]) if lanes > 1 else (["chunk"],):
            moved = moved.repartition(*keys).withColumn("lane", F.col("lane") if len(keys) > 1 else F.lit(0).cast("long")).mapInArrow(_merge, MOVED)
        for row in moved.toLocalIterator():
            k = row.chunk * CHUNK + np.frombuffer(row.rows, np.int16).astype(np.int64)
            weights[k] += np.frombuffer(row.moved, np.float16).astype(np.float32).reshape(-1, SLOTS)
        now.unpersist()
    return weights


@dataclass
class Model:
    classes: Classes
    bias: np.ndarray
    slot_bias: np.ndarray
    weights: np.ndarray
    slot_tokens: np.ndarray
    unseen: np.ndarray
    shared: Shared
    tokens: int
    distinct: int
    counts: DataFrame

    def base(self, n):
        return np.log10((n + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    @property
    def buckets(self) -> int:
        return len(self.weights) // 2


def _log_bias(held: np.ndarray) -> np.ndarray:
    return np.log((held + 0.5) / (held + 0.5).sum(-1, keepdims=True))


def fit(train: DataFrame, rounds: int = ROUNDS) -> Model:
    """Learn from all rows of ``train`` (doc_id, text). No row: every class is equally likely, all words unseen."""
    gathered = staged(_gathered(train))
    found = gathered.where("kind = 0").select("word", "ending", "n")
    follows = np.zeros(ENDINGS * ENDINGS)
    for r in gathered.where("kind = 1").collect():  # at most ENDINGS ** 2 rows
        follows[r.word] = r.n
    follows = follows.reshape(ENDINGS, ENDINGS)
    top = found.orderBy(F.desc("n"), "word").limit(OWN_CLASSES).collect()
    of_ending, group_of_ending = OWN_CLASSES + _group_endings(follows, follows.sum(1), END_CLASSES), np.zeros(ENDINGS, np.int64)
    for k in range(OWN_CLASSES, CLASSES):
        mine = np.flatnonzero(of_ending == k)
        if len(mine):
            group_of_ending[mine] = _group_endings(follows[mine], follows[mine].sum(1), GROUPS)
    of = lambda numbers: F.element_at(F.array(*[F.lit(int(k)) for k in numbers]), F.col("ending") + 1)
    kind = of(of_ending)
    rest = found.where(~F.col("word").isin([r.word for r in top])).withColumn("class", kind) if top else found.withColumn("class", kind)
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "word"))
    slots = rest.withColumn("slot", rank - 1).where(F.col("slot") < WORDS).select("word", "n", "class", "slot").collect()  # at most END_CLASSES * WORDS rows
    own = np.array([r.word for r in [*top, *slots]], np.int64).view(_U)
    own_class = np.array([*range(len(top)), *(r["class"] for r in slots)], np.int64)
    own_slot = np.array([*(0 for _ in top), *(r.slot for r in slots)], np.int64)
    order = np.argsort(own)
    classes = Classes(own[order], own_class[order], own_slot[order], of_ending, group_of_ending)
    by = np.zeros((3, CLASSES, SLOTS))
    for k, s, r in zip(own_class, own_slot, [*top, *slots], strict=True):
        by[:, k, s] += [r.n, 1, 0]
    others = rest.where(~F.col("word").isin([r.word for r in slots])) if slots else rest
    for r in others.groupBy("class", of(group_of_ending).alias("group")).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect():
        by[:, r["class"], WORDS + r.group] += [r.n, r.v, r.once]
    held, distinct, once = by
    unseen = np.where(held > 0, (once + 0.5) / (held + 1), 1.0)
    unseen[own_class, own_slot] = 0
    slot_bias = _log_bias(held)
    slot_bias[:, :WORDS][held[:, :WORDS] == 0] = _IMPOSSIBLE
    bias = _log_bias(held.sum(1)).astype(np.float32)
    total = int(held.sum())
    counts = staged(_counts(train, classes))
    shared = _shared(counts.where(~F.col("word").isin(own.view(np.int64).tolist())), kind, of(group_of_ending))
    weights = _train(train, classes, bias, slot_bias.astype(np.float32), table_rows(total), train_parts(total, table_rows(total)), rounds)
    return Model(classes, bias, slot_bias.astype(np.float32), weights, held, unseen, shared, total, int(distinct.sum()), counts)


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with counts above a cut that leaves at most ``most`` of them, sorted by hash: hashes, counts, and those after each class."""
    step = F.floor(F.log2("n") * 8)
    total, cut = 0, None
    for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.min("n").alias("least")).orderBy(F.desc("step")).collect():
        total += r.v
        if total > most:
            break
        cut = r.least
    if cut is None:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros((0, BEFORE), np.float32)
    got = counts.where(F.col("n") >= cut).select("word", "n", "before", "met").toArrow()
    word, n = got["word"].to_numpy().view(_U), got["n"].to_numpy()
    met = np.zeros((len(word), BEFORE), np.float32)
    met[np.repeat(np.arange(len(word)), pc.list_value_length(got["before"]).to_numpy()), pc.list_flatten(got["before"]).to_numpy()] = pc.list_flatten(got["met"]).to_numpy()
    order = np.argsort(word)
    return word[order], n[order], met[order]


def token_logs(model: Model, hashes: np.ndarray, ending: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 P(class | history) * P(slot | class, history) of each token, its slot's number among all, and its place among the shared ones."""
    history, (kind, slot) = features(hashes, bounds), model.classes(hashes, ending)
    logs = np.zeros(len(hashes))
    for k in range(0, len(hashes), BATCH):
        part = slice(k, k + BATCH)
        logs[part] = _log_true(model.weights, model.bias, class_rows(history[part], model.buckets), kind[part])
    shared = np.flatnonzero(kind >= OWN_CLASSES)
    for k in range(0, len(shared), BATCH):
        part = shared[k : k + BATCH]
        logs[part] += _log_true(model.weights, model.slot_bias[kind[part]], slot_rows(history[part], kind[part], model.buckets), slot[part])
    return logs / np.log(10), kind * SLOTS + slot, model.shared.places(kind, slot, _before(kind, bounds))


def score(docs: DataFrame, model: Model, frequent: int = FREQUENT) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with n_tokens, n_known, base_score and score (log10 probabilities).

    Null texts count as empty: one end. Repeated rows get the same scores. Long texts are scored whole, with
    arrays of some hundred bytes a word.
    """
    spark = docs.sparkSession
    word, n, met = _frequent(model.counts, frequent)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen_in = np.log10((1 - model.unseen) / model.slot_tokens).ravel()
        unseen_in = np.log10(np.maximum(model.unseen, 1e-300)).ravel()
    seen_in = np.where(np.isfinite(seen_in), seen_in, 0.0)
    lean = replace(model, counts=None)
    shared = spark.sparkContext.broadcast((lean, word, n, met, model.base(n), seen_in))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, word, count, met, base, seen_in = shared.value
        ids, texts = batch.column(0), batch.column(1)
        hashes, ending, bounds = tokens(texts)
        logs, leaf, place = token_logs(model, hashes, ending, bounds)
        i = np.minimum(np.searchsorted(word, hashes), max(len(word) - 1, 0))
        hot = word[i] == hashes if len(word) else np.zeros(len(hashes), bool)
        base_logs = np.zeros(len(hashes))
        base_logs[hot] = base[i[hot]]
        logs[hot] += seen_in[leaf[hot]] + np.log10(count[i[hot]])
        told = np.flatnonzero(hot & (place > 0))
        at = place[told]
        logs[told] += np.log10(model.shared.weight(at, count[i[told]], met[i[told], (at - 1) % BEFORE]))
        sums = lambda x: np.add.reduceat(x, bounds[:-1])
        docs = len(bounds) - 1
        mark = mix64(sums(mix64(hashes + np.arange(len(hashes), dtype=_U) - np.repeat(bounds[:-1], np.diff(bounds)).astype(_U))) ^ mix64(ids.fill_null(-1).to_numpy().view(_U)) ^ ids.is_null().to_numpy(zero_copy_only=False).astype(_U))
        # a row for each text, then one for each word and place of it that isn't frequent; the first have their mark for a word, to spread in the join
        cold = np.flatnonzero(~hot)
        owner = np.repeat(np.arange(docs), np.diff(bounds))[cold]
        order = np.lexsort((place[cold], hashes[cold], owner))
        o, h, c, p = owner[order], hashes[cold][order], leaf[cold][order], place[cold][order]
        new = np.append(True, (o[1:] != o[:-1]) | (h[1:] != h[:-1]) | (p[1:] != p[:-1])) if len(o) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        times = np.diff(np.append(start, len(o)))
        o, h, c, p = o[start], h[start], c[start], p[start]
        m = len(o)
        none = lambda kind, k: pa.nulls(k, kind)
        both = lambda a, b, kind: pa.concat_arrays([pa.array(a, kind) if not isinstance(a, pa.Array) else a, pa.array(b, kind) if not isinstance(b, pa.Array) else b])
        arrays = [
            both(mark.view(np.int64), mark[o].view(np.int64), pa.int64()), both(ids, none(pa.int64(), m), pa.int64()), both(np.ones(docs), np.zeros(m), pa.int32()),
            both(np.diff(bounds), np.zeros(m), pa.int64()), both(sums(hot.astype(np.int64)), np.zeros(m), pa.int64()), both(sums(base_logs), np.zeros(m), pa.float64()), both(sums(logs), np.zeros(m), pa.float64()),
            both(mark.view(np.int64), h.view(np.int64), pa.int64()), both(np.zeros(docs), c, pa.int32()), both(np.zeros(docs), p, pa.int32()), both(np.zeros(docs), times, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(arrays, ["mark", "doc_id", "rows", "n_tokens", "n_known", "base_score", "score", "word", "leaf", "place", "times"])

    rows = map_batches(docs, run, "mark long, doc_id long, rows int, n_tokens long, n_known long, base_score double, score double, word long, leaf int, place int, times int", "text")
    pick = lambda values, at="leaf": F.element_at(F.lit(values), F.col(at) + 1)
    total = F.lit(model.tokens + 0.5 * (model.distinct + 1))
    n = F.coalesce("n", F.lit(0))
    own = F.col("rows") == 1
    after = F.coalesce(F.get("met", (F.array_position("before", (F.col("place") - 1) % BEFORE) - 1).cast("int")), F.lit(0))
    weight = (after * pick(model.shared.scale, "place") + TRUST) / ((n + TRUST) * pick(model.shared.norm, "place"))
    told = F.when(F.col("place") > 0, F.log10(weight)).otherwise(0)
    joined = rows.join(model.counts.select("word", "n", "before", "met"), "word", "left")
    # identical rows share a mark and each adds its rare words: sums are divided by how many rows there are
    summed = joined.groupBy("mark").agg(
        F.sum("rows").alias("copies"),
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.when(own, F.col("n_known")).when(n > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.when(own, F.col("base_score")).otherwise(F.col("times") * F.log10((n + 0.5) / total))).alias("base_score"),
        F.sum(F.when(own, F.col("score")).when(n > 0, F.col("times") * (pick(seen_in) + F.log10(F.greatest(n, F.lit(1))) + told)).otherwise(F.col("times") * pick(unseen_in))).alias("score"),
    )
    each = [(F.col(c) / F.col("copies")).cast(kind).alias(c) for c, kind in (("n_known", "long"), ("base_score", "double"), ("score", "double"))]
    return summed.select("doc_id", "n_tokens", *each, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).drop("copy")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out_fold: int = 1, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """All rows of ``docs`` scored by the model of those whose crc32(id as text) modulo ``folds`` is not ``held_out_fold``.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. A null id counts as the
    text '' for the fold. An empty table gives an empty table; one without training rows scores all words as unseen.
    Null texts count as empty, repeated rows get equal scores, very long texts are learnt and scored whole, and
    other columns, whatever their names, are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    fold = F.coalesce(fold_of("doc_id", folds), F.lit(0))
    model = fit(docs.where(fold != held_out_fold), rounds)
    out = score(docs, model, frequent)
    return out.select("doc_id", (fold == held_out_fold).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
