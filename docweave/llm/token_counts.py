"""Token counts of sections: whole documents are encoded once and tokens attributed by their spans.

The encoder gives each token the bytes it covers. Sections are spans of the same text; the interval join is
one binary search of token bounds among section bounds. A token that crosses a boundary is allocated by an
explicit rule:

* ``start``: to the section that holds its first byte (default);
* ``majority``: to the section that holds most of its bytes, the earlier one on a tie;
* ``share``: to each section by the part of its bytes there, so counts may be fractions.

Under every rule a document's counts sum to the tokens of its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.bpe import codec, default_vocabulary
from docweave.llm.common import map_batches

RULES = ("start", "majority", "share")


def allocate(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens per section; both tile the same bytes from 0, given by their ends. Empty sections get none."""
    counts = np.zeros(len(section_ends))
    if not len(token_ends):
        return counts
    starts = np.append(0, token_ends[:-1])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    inside = first == last
    np.add.at(counts, first if rule == "start" else first[inside], 1.0)
    if rule != "start":
        section_starts = np.append(0, section_ends[:-1])
        for k in np.flatnonzero(~inside):
            s = np.arange(first[k], last[k] + 1)
            part = np.minimum(section_ends[s], token_ends[k]) - np.maximum(section_starts[s], starts[k])
            if rule == "share":
                counts[s] += part / part.sum()
            else:
                counts[s[part.argmax()]] += 1
    return counts


def line_sizes(text: str) -> list[int]:
    """The bytes that each line covers, with its newline."""
    out = [len(x.encode()) + 1 for x in text.split("\n")]
    out[-1] -= 1
    return out


def section_token_counts(docs: DataFrame, rule: str = "start", path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line of each document: doc_id, section, n_bytes, n_tokens, n_crossing.

    n_crossing counts the tokens that begin in the line and end in a later one. A null or empty text has one
    empty section. Repeated rows give repeated sections; an empty table gives none. Very long texts are encoded
    whole, in a batch of their own. Other columns are not read.
    """
    return _counted(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.lit(None).cast("array<long>").alias("sizes")), rule, path)


def field_token_counts(rows: DataFrame, fields: list[str], separator: str = "\n", rule: str = "start", path: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Like ``section_token_counts`` for the text columns ``fields`` joined by ``separator`` (which counts to the field before it).

    Fields may have any names; batches are bounded by the bytes of all fields together.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    parts = [F.concat(x, F.lit(separator)) for x in parts[:-1]] + parts[-1:]
    sizes = F.array(*[F.octet_length(x).cast("long") for x in parts])
    return _counted(rows.select(F.col(id_col).alias("doc_id"), F.concat(*parts).alias("text"), sizes.alias("sizes")), rule, path)


def _counted(rows: DataFrame, rule: str, path: str | None) -> DataFrame:
    """Counts of (doc_id, text, sizes): ``sizes`` are the bytes of the sections, null for lines."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_vocabulary()
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(path)
        texts = batch["text"].to_pylist()
        ids, bounds = c.encode(texts)
        width = c.piece_bytes[ids]
        owner, number, size, tokens, crossing = [], [], [], [], []
        for k, (text, sizes) in enumerate(zip(texts, batch["sizes"].to_pylist(), strict=True)):
            spans = np.array(line_sizes(text) if sizes is None else sizes, np.int64)
            ends = np.cumsum(width[bounds[k] : bounds[k + 1]])
            section = np.cumsum(spans)
            owner.append(np.full(len(spans), k))
            number.append(np.arange(len(spans)))
            size.append(spans)
            tokens.append(allocate(ends, section, rule))
            begin = np.append(0, ends[:-1]) if len(ends) else ends
            crosses = np.searchsorted(section, begin, "right") != np.searchsorted(section, ends - 1, "right")
            crossing.append(np.bincount(np.searchsorted(section, begin[crosses], "right"), minlength=len(spans)))
        cat = np.concatenate
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cat(owner))), pa.array(cat(number), pa.int64()), pa.array(cat(size), pa.int64()), pa.array(cat(tokens), pa.float64()), pa.array(cat(crossing), pa.int64())], ["doc_id", "section", "n_bytes", "n_tokens", "n_crossing"])

    return map_batches(rows, run, f"doc_id {kind}, section long, n_bytes long, n_tokens double, n_crossing long", "text")
