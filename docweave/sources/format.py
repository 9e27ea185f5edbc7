"""Document files as a source of their own: ``spark.read.format("docweave").option("pages", "1-3").load(path)``.

Reading is planned by file and page: small files share a partition, a PDF that is larger than a partition is
dealt out by pages to several, and pages that aren't asked for are not unpacked. Paths are local, or of a store
that pyarrow knows; for others ``files.read_documents`` reads whole files through Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docweave.sources.files import READERS, SEGMENTS
from docweave.sources.pdf import read_pdf

#: Bytes of files that one task reads, unless the option ``bytesPerPartition`` says otherwise.
PARTITION_BYTES = 16 << 20


def page_ranges(text: str | None) -> list[tuple[int, int]] | None:
    """'2-5,9' as ranges; None for all pages."""
    if not text or not text.strip():
        return None
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m or int(m[1]) < 1 or m[2] and int(m[2]) < int(m[1]):
            raise ValueError(f"not a range of pages: {part.strip()!r}")
        out.append((int(m[1]), int(m[2] or m[1])))
    return out


@dataclass
class Part(InputPartition):
    """Files, and of their pages those whose number leaves ``rest`` when divided by ``of``."""

    files: tuple[str, ...]
    of: int = 1
    rest: int = 0


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.pages = page_ranges(options.get("pages"))
        self.most = int(options.get("bytesperpartition", PARTITION_BYTES))

    def partitions(self) -> list[Part]:
        store, root = _place(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory else [store.get_file_info(root)]
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        parts: list[Part] = []
        held: list[str] = []
        size = 0
        for path, n in files:
            if n > self.most and path.lower().endswith(".pdf"):
                pieces = -(-n // self.most)
                parts += [Part((path,), pieces, k) for k in range(pieces)]
                continue
            if held and size + n > self.most:
                parts.append(Part(tuple(held)))
                held, size = [], 0
            held.append(path)
            size += n
        return [*parts, Part(tuple(held))] if held or not parts else parts

    def read(self, partition: Part) -> Iterator[tuple]:
        store, _ = _place(self.path)
        asked = lambda k: k % partition.of == partition.rest and (self.pages is None or any(a <= k <= b for a, b in self.pages))
        for path in partition.files:
            name = path.rpartition("/")[2]
            stem, _, ending = name.rpartition(".")
            try:
                if ending.lower() not in READERS:
                    raise ValueError(f"unsupported format: {ending}")
                with store.open_input_file(path) as file:
                    raw = file.read()
                parts = read_pdf(raw, asked) if ending.lower() == "pdf" else READERS[ending.lower()](raw)
                for page, text in parts:
                    if text.strip():
                        yield (stem or name, name, (page or 1) - 1, page, text, None)
                if ending.lower() != "pdf" and not any(t.strip() for _, t in parts):
                    raise ValueError("the document is empty")
            except Exception as error:  # noqa: BLE001  a bad file is a row, not a failed job
                if not partition.rest:
                    yield (stem or name, name, 0, None, None, f"{type(error).__name__}: {error}"[:500])


class Documents(DataSource):
    """Segments of text, Markdown, DOCX and PDF files, as ``files.SEGMENTS``; a segment's index is its page's place.

    Options: path; pages ('2-5,9', of PDF files; others have no pages and are read whole); bytesPerPartition.
    """

    @classmethod
    def name(cls) -> str:
        return "docweave"

    def schema(self) -> str:
        return SEGMENTS

    def reader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Documents)
