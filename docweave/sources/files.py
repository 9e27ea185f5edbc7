"""Text, Markdown, DOCX and PDF files as segment rows; plug-in readers for other formats."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources.pdf import read_pdf

SEGMENTS = "document_id string, file_name string, segment_index int, page_number int, content string, error string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A reader turns a file's bytes into (page number or None, text) pairs.
Reader = Callable[[bytes], list[tuple[int | None, str]]]


def read_text(raw: bytes) -> list[tuple[int | None, str]]:
    """UTF-8 with or without a mark, else GBK."""
    try:
        return [(None, raw.decode("utf-8-sig"))]
    except UnicodeDecodeError:
        return [(None, raw.decode("gbk"))]


def read_docx(raw: bytes) -> list[tuple[int | None, str]]:
    """Paragraphs that aren't blank, joined by blank lines."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    texts = ["".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p")]
    return [(None, "\n\n".join(t for t in texts if t.strip()))]


READERS: dict[str, Reader] = {"txt": read_text, "md": read_text, "docx": read_docx, "pdf": read_pdf}


def read_documents(spark: SparkSession, path: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """One row for each segment of each file under ``path``; what can't be read has an ``error`` and no content.

    ``readers`` adds formats by their ending, or other readers for these. Blank pages fall out; a file without
    content is an error.
    """
    known = READERS | (readers or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                file = re.sub(r".*/", "", name)
                stem, _, ending = file.rpartition(".")
                try:
                    if ending.lower() not in known:
                        raise ValueError(f"unsupported format: {ending}")
                    parts = [(p, t) for p, t in known[ending.lower()](bytes(raw)) if t.strip()]
                    if not parts:
                        raise ValueError("the document is empty")
                    out += [(stem or file, file, k, p, t, None) for k, (p, t) in enumerate(parts)]
                except Exception as error:  # noqa: BLE001  a bad file is a row, not a failed job
                    out.append((stem or file, file, 0, None, None, f"{type(error).__name__}: {error}"[:500]))
            frame = pd.DataFrame(out, columns=["document_id", "file_name", "segment_index", "page_number", "content", "error"])
            frame["page_number"] = frame["page_number"].astype("Int32")
            yield frame

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(run, SEGMENTS)


def pages_of(texts: DataFrame, id_col: str = "document_id", text_col: str = "content") -> DataFrame:
    """Texts with form feeds between pages as segment rows."""
    rows = texts.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(F.split(text_col, "\f")).alias("segment_index", "content"))
    return rows.where(F.length(F.trim("content")) > 0).withColumn("page_number", F.col("segment_index") + 1)
