"""Byte-pair encoding and decoding in batched numpy merge rounds.

A batch of texts is cut into the vocabulary's pre-tokens; each distinct one is encoded once. The symbols
of all distinct words of a batch stand in one flat array. In a round, every neighbouring pair's rank is
found by binary search over the sorted pair keys, each word merges its lowest-ranked pair, wherever it
stands in the word, and words without a pair leave. Vocabulary files are read where ``path`` says; each
worker process reads its file once.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import map_batches, text_slices

#: Words with more bytes than this (rare: runs without spaces) merge one at a time from a heap instead.
LONG_WORD = 256
#: Distinct words whose ids a worker keeps between batches; then it starts anew.
CACHE_WORDS = 1 << 16
#: Bytes of text that a worker encodes at a time; bounds its arrays.
SLICE = 1 << 20
_CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_NO_RANK = np.int64(1) << 40


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: itself if printable, else the next from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary file, as arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        names, vocab = _byte_names(), spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.pieces = np.full(self.size, b"", object)
        for name, i in vocab.items():
            self.pieces[i] = bytes(names[c] for c in name)
        for name, i in self.special.items():
            self.pieces[i] = name.encode()
        self.byte_id = np.array([vocab[name] for name, _ in sorted(names.items(), key=lambda x: x[1])], np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.piece_bytes = np.array([len(x) for x in self.pieces], np.int64)
        self.split = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache: dict[str, np.ndarray] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.ranks[i], _NO_RANK)

    def merge_rounds(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, all words' rounds side by side."""
        out: list = [None] * len(words)
        size = np.array([len(w) for w in words])
        flat = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        rank = np.full(len(flat), _NO_RANK)
        if len(flat) > 1:
            same = owner[1:] == owner[:-1]
            rank[:-1][same] = self.rank(flat[:-1][same], flat[1:][same])
        while len(flat):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            count = np.diff(np.append(start, len(flat)))
            least = np.minimum.reduceat(rank, start)
            over = least == _NO_RANK
            if over.any():
                for a, n in zip(start[over].tolist(), count[over].tolist(), strict=True):
                    out[owner[a]] = flat[a : a + n]
                stay = np.repeat(~over, count)
                flat, owner, rank = flat[stay], owner[stay], rank[stay]
                if not len(flat):
                    break
                least, count = least[~over], count[~over]
            hit = rank == np.repeat(least, count)
            # in a run of touching hits (aaa) the first, third, ... merge
            at = np.flatnonzero(hit)
            begin = np.append(True, np.diff(at) > 1)
            within = np.arange(len(at)) - np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
            at = at[within % 2 == 0]
            flat[at] = self.merged[rank[at]]
            stay = np.ones(len(flat), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            flat, owner, rank = flat[stay], owner[stay], rank[stay]
            at = place[at]
            again = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[again] = _NO_RANK
            again = again[again < len(flat) - 1]
            again = again[owner[again] == owner[again + 1]]
            rank[again] = self.rank(flat[again], flat[again + 1])
        return out

    def merge_heap(self, word: bytes) -> np.ndarray:
        """The ids of one long word: the lowest-ranked, then leftmost pair first, in n log n steps."""
        import heapq

        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._table()
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := table.get(ids[i] * self.size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (q := table.get(ids[x] * self.size + ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return np.array([x for x in ids if x is not None], np.int64)

    @lru_cache(maxsize=1)  # noqa: B019
    def _table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in words if w not in self.cache]
        raw = [w.encode() for w in new]
        short = [k for k, w in enumerate(raw) if len(w) <= LONG_WORD]
        fresh = dict(zip((new[k] for k in short), self.merge_rounds([raw[k] for k in short]) if short else [], strict=True))
        fresh |= {new[k]: self.merge_heap(w) for k, w in enumerate(raw) if len(w) > LONG_WORD}
        out = [self.cache[w] if w in self.cache else fresh[w] for w in words]
        self.cache |= {w: ids for w, ids in fresh.items() if len(w) <= 40}
        return out

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text; the vocabulary's special strings stand by themselves."""
        if self.split is None or not (marks := [*self.split.finditer(text)]):
            return _CUT.findall(text)
        out, at = [], 0
        for m in marks:
            out += [*_CUT.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + _CUT.findall(text[at:])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and each text's bounds among them."""
        numbers: dict[str, int] = {}
        codes, sizes = [], []
        for text in texts:
            cut = self.cut(text)
            codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in cut), np.int64, len(cut)))
            sizes.append(len(cut))
        words = list(numbers)
        plain = [w for w in words if w not in self.special]
        ids_of = dict(zip(plain, self.encode_words(plain), strict=True)) | {w: np.array([i]) for w, i in self.special.items()}
        ids = [ids_of[w] for w in words]
        count = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
        start = np.cumsum(count) - count
        code = np.concatenate([*codes, np.zeros(0, np.int64)])
        n = count[code]
        end = np.cumsum(n)
        out = flat[np.repeat(start[code] - end + n, n) + np.arange(int(n.sum()))]
        return out, np.append(0, end)[np.cumsum([0, *sizes])]

    def decode(self, ids: np.ndarray) -> str:
        """The ids' bytes as UTF-8; what isn't valid becomes U+FFFD."""
        return b"".join(self.pieces[ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Each row's id with ``ids``, its whole text as token ids; special strings in a text become their ids.

    With ``decoded``, also the text that the ids decode to, by the same worker: one Python process a task
    instead of two. Null and empty texts have no tokens. Repeated rows stay; other columns are not read. The
    vocabulary file must be at ``path`` on every worker.
    """
    path = path or default_vocabulary()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batch, "text", SLICE):
            c = codec(path)
            ids, bounds = c.encode([t or "" for t in part.column(1).to_pylist()])
            arrays = [part.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                arrays.append(pa.array([c.decode(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids", "decoded"][: len(arrays)])

    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>" + ", decoded string" * decoded
    return docs.mapInArrow(lambda batches: (out for b in batches if b.num_rows for out in run(b)), schema)


def bpe_decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``out_col``, the text of its ids, special tokens included; null ids give null."""
    path = path or default_vocabulary()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != out_col) + f", `{out_col}` string"
    encoded = encoded.select(*(c for c in encoded.columns if c != out_col))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, lists = codec(path), batch.column(ids_col)
        values, bounds = lists.values.to_numpy(), lists.offsets.to_numpy()
        texts = [c.decode(values[a:b]) if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], lists.is_valid().to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out_col])

    return map_batches(encoded, run, schema)
