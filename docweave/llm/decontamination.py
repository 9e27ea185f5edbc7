"""Benchmark decontamination with a distributed positional inverted index.

``index_segments`` turns the training documents into index segments: one row holds the postings of a
bounded batch of documents (for each term the ascending positions where it stands, on one axis with gaps
between documents). Segments need no shuffle, are a few MB each, and are stored. ``search_segments`` reads
them and intersects, in each segment, the offset-adjusted postings of a phrase's terms, from the term that is
rarest in that segment; ``near_matches`` does so within a distance. ``decontaminate`` stores the index of its
documents in the shared folder and searches it.

The benchmark is read in blocks of a bounded number of words. One block at a time is broadcast, searched for
in all segments, and let go; what blocks find is brought together by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import ALPHANUMERIC, as_long, map_batches, staged, text_bytes, text_slices, words

WINDOW = 10
#: Bytes of text in one segment; a longer document is a segment by itself.
SEGMENT_BYTES = 2 << 20
#: Words of benchmark text in one broadcast block: about 16 MB of hashes and windows.
BLOCK_WORDS = 1 << 20
SEGMENT_SCHEMA = "seg long, doc_ids binary, no_id binary, n_words binary, terms binary, starts binary, positions binary"


@dataclass
class Segment:
    """Postings of a batch of documents. Document d's words are at base[d] ... base[d] + n_words[d] - 1."""

    n_words: np.ndarray
    base: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    positions: np.ndarray

    def postings(self, term: int) -> np.ndarray:
        i = int(np.searchsorted(self.terms, term))
        return self.positions[self.starts[i] : self.starts[i + 1]] if i < len(self.terms) and self.terms[i] == term else self.positions[:0]

    def phrase(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """First positions of the exact phrase; ``places`` are the terms' places among ``self.terms``."""
        counts = self.starts[places + 1] - self.starts[places]
        order = np.argsort(counts, kind="stable")
        found = None
        for k in order:
            at = self.positions[self.starts[places[k]] : self.starts[places[k] + 1]]
            if found is None:
                found = at - k
            else:
                want = found + k
                i = np.minimum(np.searchsorted(at, want), len(at) - 1)
                found = found[at[i] == want]
            if not len(found):
                break
        return found

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``slop`` words away in the same document."""
        lists = sorted((self.postings(t) for t in terms), key=len)
        found = lists[0]
        for at in lists[1:]:
            if not len(at) or not len(found):
                return found[:0]
            right = np.minimum(np.searchsorted(at, found), len(at) - 1)
            left = np.maximum(right - 1, 0)
            close = np.minimum(np.abs(at[right] - found), np.abs(at[left] - found)) <= slop
            same = (self.document(at[right]) == self.document(found)) & (np.abs(at[right] - found) <= slop) | (self.document(at[left]) == self.document(found)) & (np.abs(at[left] - found) <= slop)
            found = found[close & same]
        return found

    def document(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, positions, "right") - 1


def _segment(batch: pa.RecordBatch, window: int) -> Segment:
    hashes, _, _, bounds = words(*text_bytes(batch.column(1)), ALPHANUMERIC)
    n_words = np.diff(bounds)
    base = bounds[:-1] + np.arange(batch.num_rows) * window  # the gap keeps phrases within a document
    positions = np.arange(len(hashes)) + np.repeat(np.arange(batch.num_rows) * window, n_words)
    order = np.argsort(hashes, kind="stable")
    terms, starts = np.unique(hashes[order], return_index=True)
    return Segment(n_words, base, terms, np.append(starts, len(hashes)), positions[order])


def _pack(x: np.ndarray, kind: type) -> pa.Array:
    return pa.array([x.astype(kind).tobytes()], pa.binary())


def index_segments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Index segments of the documents, each over about SEGMENT_BYTES of text; a longer document is a segment by itself.

    Null and empty texts are in the index with no words. Ids must be whole numbers; null ids stay null. Repeated
    rows are documents of their own. Empty tables give no segments. ``seg`` numbers the segments of one table.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in text_slices(whole, "text", SEGMENT_BYTES):
                if batch.num_rows:
                    s = _segment(batch, window)
                    ids = batch.column(0)
                    arrays = [_pack(ids.fill_null(0).to_numpy(), np.int64), _pack(ids.is_null().to_numpy(zero_copy_only=False), np.bool_), _pack(s.n_words, np.int64), _pack(s.terms, np.uint64), _pack(s.starts, np.int64), _pack(s.positions, np.int32 if len(s.positions) < 1 << 30 else np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([seg]), *arrays], ["seg", "doc_ids", "no_id", "n_words", "terms", "starts", "positions"])
                    seg += 1
            pa.default_memory_pool().release_unused()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(build, SEGMENT_SCHEMA)


def _opened_ids(ids: bytes, missing: bytes) -> pa.Array:
    return pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(missing, np.bool_))


def _open(row: pa.RecordBatch, i: int, window: int) -> tuple[pa.Array, Segment]:
    raw = {name: row.column(name)[i].as_buffer() for name in row.schema.names if name != "seg"}
    n = np.frombuffer(raw["n_words"], np.int64)
    starts = np.frombuffer(raw["starts"], np.int64)
    wide = len(raw["positions"]) > 4 * starts[-1]
    base = np.cumsum(n) - n + np.arange(len(n)) * window
    return _opened_ids(raw["doc_ids"], raw["no_id"]), Segment(n, base, np.frombuffer(raw["terms"], np.uint64), starts, np.frombuffer(raw["positions"], np.int64 if wide else np.int32))


def _windows(items: pa.Table, window: int) -> tuple[list, np.ndarray, np.ndarray]:
    """Item ids, all word hashes, and the windows: first word, item number and size of each."""
    hashes, _, _, bounds = words(*text_bytes(items.column(1).combine_chunks() if items.num_rows else pa.array([], pa.string())), ALPHANUMERIC)
    first, item, size = [], [], []
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b > a:
            w = min(window, b - a)
            at = np.arange(a, b - w + 1)
            first.append(at)
            item.append(np.full(len(at), k))
            size.append(np.full(len(at), w))
    empty = np.zeros(0, np.int64)
    cat = lambda x: np.concatenate(x) if x else empty
    return items.column(0).to_pylist(), hashes, np.stack([cat(first), cat(item), cat(size)])


def _blocks(items: DataFrame, block_words: int, window: int) -> Iterator[tuple]:
    """The windows of the items in blocks of about ``block_words`` words, read one after the other; an item is never split."""
    sized = items.withColumn("_size", F.octet_length("text") / 2 + 1)
    total = sized.agg(F.sum("_size")).first()[0] or 0
    n = max(1, int(np.ceil(total / block_words)))
    for k in range(n):
        block = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else sized
        yield _windows(block.select("item_id", "text").toArrow(), window)


def _search(segment: Segment, block: tuple) -> dict[int, list[tuple[int, int, int]]]:
    """For each document with a window of the block: (item, first word, end word)."""
    ids, hashes, (first, item, size) = block
    if not len(first) or not len(segment.terms):
        return {}
    places = np.minimum(np.searchsorted(segment.terms, hashes), len(segment.terms) - 1)
    missing = np.cumsum(np.append(0, segment.terms[places] != hashes))
    alive = np.flatnonzero(missing[first + size] == missing[first])
    out: dict[int, list[tuple[int, int, int]]] = {}
    for k in alive:
        a, w = first[k], size[k]
        at = segment.phrase(hashes[a : a + w], places[a : a + w])
        if len(at):
            d = segment.document(at)
            inside = (at >= segment.base[d]) & (at + w <= segment.base[d] + segment.n_words[d])
            for doc, p in zip(d[inside].tolist(), (at - segment.base[d])[inside].tolist(), strict=True):
                out.setdefault(doc, []).append((int(item[k]), p, p + int(w)))
    return out


def _merged(spans: list[tuple]) -> list[tuple]:
    """Spans of one item, in order, run together where they overlap or touch; items without an id last."""
    out: list[list] = []
    for item, a, b in sorted(spans, key=lambda x: (x[0] is None, x[0] or "", *x[1:])):
        if out and out[-1][0] == item and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([item, a, b])
    return [tuple(x) for x in out]


RESULT_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<item:string,first:int,end:int>>"


FOUND_SCHEMA = "seg long, doc int, item string, first int, end int"


def _results(doc_ids: pa.Array, n_words: np.ndarray, spans_of: dict[int, list[tuple]]) -> pa.RecordBatch:
    """A row for each document; ``spans_of`` has the matches of some."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("item", pa.string()), ("first", pa.int32()), ("end", pa.int32())])))])
    n = len(doc_ids)
    hit, items, runs_of = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)]
    for doc, spans in spans_of.items():
        hit[doc] = sum(b - a for _, a, b in _merged([("", a, b) for _, a, b in spans]))
        runs = _merged(spans)
        items[doc] = sorted({x[0] for x in runs if x[0] is not None})
        runs_of[doc] = [{"item": x, "first": a, "end": b} for x, a, b in runs]
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(n_words), pa.array(hit), pa.array(items, schema.field("items").type), pa.array(runs_of, schema.field("spans").type)], schema=schema)


def _segments_of(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[int, pa.Array, Segment]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch["seg"][i].as_py(), *_open(batch, i, window)


def _found(segment: Segment, block: tuple) -> dict[int, list[tuple]]:
    return {doc: [(block[0][item], a, b) for item, a, b in spans] for doc, spans in _search(segment, block).items()}


def _search_block(segments: DataFrame, shared: Broadcast, window: int) -> DataFrame:
    """What one block of the benchmark finds in the index, stored: the spans of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seg, _, segment in _segments_of(batches, window):
            rows = [(seg, doc, *span) for doc, spans in _found(segment, shared.value).items() for span in _merged(spans)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32()), strict=True)], ["seg", "doc", "item", "first", "end"])

    return staged(segments.mapInArrow(run, FOUND_SCHEMA))


def search_segments(segments: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Each indexed document with the benchmark windows that stand in it word for word.

    A window is ``window`` consecutive words of an item, or the whole item if it has fewer (none: no window).
    Columns: doc_id, n_words, n_hit (words inside any occurrence), items (their ids as text, sorted, each
    once), spans (for each item the runs of words covered: first and end, counted from 0). Items that share
    an id count as one item. The words of an item without an id are hit like others', but it is in no list of
    ids (its spans have a null item); a null text matches nothing. Documents without a match, and all
    documents if the benchmark is empty, have n_hit 0 and empty lists. Equal documents have equal rows; very
    long ones are segments by themselves. Other columns are not read. A benchmark of one block is searched in
    the pass that gives the result; of several, each is a pass over the index, and the result another.
    """
    spark = segments.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    parts: list[DataFrame] = []
    before = None
    for block in _blocks(items, block_words, window):
        if before is not None:
            parts.append(_search_block(segments, before, window))
            before.unpersist()
        before = spark.sparkContext.broadcast(block)
    if not parts:
        shared = before

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, doc_ids, segment in _segments_of(batches, window):
                yield _results(doc_ids, segment.n_words, _found(segment, shared.value))

        return segments.mapInArrow(run, RESULT_SCHEMA)
    parts.append(_search_block(segments, before, window))
    before.unpersist()
    found = parts[0]
    for part in parts[1:]:
        found = found.union(part)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, ids, missing, words_of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n_words = np.frombuffer(words_of, np.int64)
                n = len(n_words)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, seg)), pa.array(np.arange(n, dtype=np.int32)), _opened_ids(ids, missing), pa.array(n_words)], ["seg", "doc", "doc_id", "n_words"])

    def brought(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = {k: [(x["item"], x["first"], x["end"]) for x in s] for k, s in enumerate(batch["spans"].to_pylist()) if s}
        return _results(batch["doc_id"], batch["n_words"].to_numpy(), spans)

    spans = found.groupBy("seg", "doc").agg(F.collect_list(F.struct("item", "first", "end")).alias("spans"))
    rows = segments.select("seg", "doc_ids", "no_id", "n_words").mapInArrow(listed, "seg long, doc int, doc_id long, n_words long").join(spans, ["seg", "doc"], "left")
    return map_batches(rows.select("doc_id", "n_words", "spans"), brought, RESULT_SCHEMA)


def near_matches(segments: DataFrame, terms: list[str], slop: int, window: int = WINDOW) -> DataFrame:
    """Documents where all ``terms`` stand within ``slop`` words of the rarest of them: doc_id and that term's word number.

    A document without an id has a null one, repeated rows each have their own; an empty index and terms that
    are nowhere give no rows.
    """
    raw, bounds = text_bytes(pa.array(terms, pa.string()))
    wanted, _, _, _ = words(raw, bounds, ALPHANUMERIC)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc_ids, segment in _segments_of(batches, window):
            at = segment.near(wanted, slop)
            d = segment.document(at)
            if len(at):
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(d)), as_long(at - segment.base[d])], ["doc_id", "word"])

    return segments.mapInArrow(run, "doc_id long, word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``search_segments`` over the index of ``docs``, stored in the shared folder."""
    return search_segments(staged(index_segments(docs, id_col, text_col, window)), benchmark, window=window, block_words=block_words)
