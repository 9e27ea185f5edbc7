"""Pieces shared by the training-data operators: words as 64-bit hashes, staged tables, row batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes hashed at a time; bounds the 8-byte arrays beside a batch of texts.
SLICE = 1 << 21

_U = np.uint64
_PRIME = _U(0x100000001B3)  # FNV's 64-bit prime: odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(0x100000001B3, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    word = np.ones(256, bool)
    for low, high in ranges:
        word[low : high + 1] = False
    return word


#: Bytes that make words of ``[^\x20\x09-\x0D]+``.
SPACED = _separators((0x20, 0x20), (0x09, 0x0D))
#: Bytes that make words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
ALPHANUMERIC = _separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]  # A-Z count as a-z

_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        step = np.full(max(n, SLICE + 1), _PRIME if which == "up" else _INVERSE)
        step[0] = 1
        have = _powers[which] = np.multiply.accumulate(step)
    return have[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a batch of texts in one array, and each text's bounds in it; null is empty."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, bounds: np.ndarray, word_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch: 64-bit hashes (A-Z as a-z), first and end byte, and each text's bounds among the words.

    Equal words have equal hashes; different words have different ones but for a chance of 2**-64 a pair.
    """
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = word_bytes[raw]
    first = inside[1:] & ~inside[:-1]
    last = inside[:-1] & ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    split = edges[inside[edges] & inside[edges + 1]]  # a word never runs on into the next text
    first[split] = True
    last[split] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    hashes = np.empty(len(start), _U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        a, b = int(start[i]), int(end[j - 1])
        sums = np.zeros(b - a + 1, _U)
        np.cumsum(_BYTE[raw[a:b]] * _power("up", b - a), out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        h = (sums[e] - sums[s]) * _power("down", b - a + 1)[s]
        hashes[i:j] = mix64(h + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return hashes, start, end, np.searchsorted(start, bounds)


_ORDER = 0x9E3779B97F4A7C15


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for k in range(size):
        total += hashes[k : k + n] * _U(pow(_ORDER, k, 1 << 64))
    return mix64(total + _U(size))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def text_slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, so that long texts don't add up."""
    _, bounds = text_bytes(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str | None = None, most: int = 4 << 20) -> DataFrame:
    """mapInArrow of a function of one batch; with ``text``, of batches of about ``most`` bytes in that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, text, most) if text else (whole,):
                if batch.num_rows and (out := function(batch)) is not None and out.num_rows:
                    yield out
            pa.default_memory_pool().release_unused()  # workers live on between stages

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode (tests) a temporary one if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='docweave-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def buckets(spark: SparkSession) -> int:
    """Buckets for packed keys: four for each shuffle partition, so that a bucket is a bounded part of the data where partitions are."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def staged(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docweave-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(schema).parquet(path)


def fold_of(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``: which documents are held out."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % folds


def row_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` from a partition sorted by them, one bounded run at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
