import zlib

import pytest

from docweave.sources import files
from docweave.sources.pdf import read_pdf

CMAP = b"1 beginbfchar\n<0001> <00480069>\nendbfchar\n2 beginbfrange\n<0010> <0012> <0061>\n<0020> <0021> [<4F60> <597D>]\nendbfrange"


def stream(data, packed=False):
    body = zlib.compress(data) if packed else data
    return b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", body)


def pdf(pages, extra=None, resources=b"<< /Font << /F1 8 0 R /F2 9 0 R >> >>"):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 8: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>", 9: b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>", 10: stream(CMAP, True)}
    kids = b" ".join(b"%d 0 R" % (20 + 2 * k) for k in range(len(pages)))
    objects[2] = b"<< /Type /Pages /Count %d /Kids [%s] /Resources %s >>" % (len(pages), kids, resources)
    for k, content in enumerate(pages):
        objects[20 + 2 * k] = b"<< /Type /Page /Parent 2 0 R /Contents %s >>" % (b"[%d 0 R]" % (21 + 2 * k) if k % 2 else b"%d 0 R" % (21 + 2 * k))
        objects[21 + 2 * k] = stream(content, k % 2 == 0)
    objects |= extra or {}
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_pages_fonts_and_operators():
    one = b"BT /F1 12 Tf 72 700 Td (First \\(line\\)) Tj 0 -14 Td [(sec) -20 (ond) -300 (line)] TJ T* (caf\\351) Tj ET"
    two = b"BT /F2 9 Tf <00010010001100120020 0021> Tj ET BT /F1 9 Tf 1 0 0 1 5 5 Tm (end) ' ET % a comment (no)"
    assert read_pdf(pdf([one, b"", two])) == [(1, "First (line)\nsecond line\ncafé"), (2, ""), (3, "Hiabc你好\nend")]


def test_objects_in_object_streams():
    inner = b"30 0 31 50 " + b"<< /Type /Page /Contents 32 0 R >>".ljust(50) + b"<< /Other true >>"
    packed = zlib.compress(inner)
    holder = b"<< /Type /ObjStm /N 2 /First 11 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(packed), packed)
    raw = pdf([], {2: b"<< /Type /Pages /Kids [30 0 R] >>", 32: stream(b"BT (held) Tj ET"), 33: holder})
    assert read_pdf(raw) == [(1, "held")]


def test_what_cannot_be_read(spark, tmp_path):
    with pytest.raises(ValueError, match="encrypted"):
        read_pdf(pdf([b""]) + b"/Encrypt 5 0 R")
    for name, raw in (("a.pdf", pdf([b"BT (one) Tj ET", b"", b"BT (three) Tj ET"])), ("b.pdf", pdf([b"", b""])), ("c.pdf", b"nothing")):
        (tmp_path / name).write_bytes(raw)
    rows = sorted((x.document_id, x.segment_index, x.page_number, x.content, (x.error or "")[:10]) for x in files.read_documents(spark, str(tmp_path)).collect())
    assert rows == [("a", 0, 1, "one", ""), ("a", 1, 3, "three", ""), ("b", 0, None, None, "ValueError"), ("c", 0, None, None, "ValueError")]


def test_updates_and_streams_that_cannot_be_unpacked():
    plain = pdf([b"BT (old) Tj ET"])
    newer = b"21 0 obj\n" + stream(b"BT (new) Tj ET") + b"\nendobj\n"
    inner = b"20 0 " + b"<< /Type /Page /Contents 40 0 R >>"
    packed = zlib.compress(inner)
    holder = b"50 0 obj\n<< /Type /ObjStm /N 1 /First 5 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n40 0 obj\n" + stream(b"BT (newest) Tj ET") + b"\nendobj\n"
    assert read_pdf(plain + newer) == [(1, "new")] and read_pdf(plain + newer + holder) == [(1, "newest")]
    odd = pdf([b"x"], {21: b"<< /Filter /LZWDecode >>\nstream\nabc\nendstream"})
    with pytest.raises(ValueError, match="LZWDecode"):
        read_pdf(odd)
    assert read_pdf(odd, lambda k: k > 1) == []  # what isn't asked for is not unpacked


def test_a_stream_that_unpacks_to_too_much(monkeypatch):
    from docweave.sources import pdf as module

    monkeypatch.setattr(module, "MOST_BYTES", 1000)
    with pytest.raises(ValueError, match="too long"):
        read_pdf(pdf([b"BT (" + b"a" * 5000 + b") Tj ET"]))


def test_file_source_plans_by_file_and_page(spark, tmp_path):
    from docweave.sources import format as source

    many = pdf([b"BT (page %d) Tj ET" % k for k in range(1, 41)])
    for name, raw in (("big.pdf", many), ("note.md", "# Überschrift".encode()), ("empty.txt", b" "), ("odd.xyz", b"?"), (".hidden", b"x")):
        (tmp_path / name).write_bytes(raw)
    source.register(spark)
    load = lambda **options: spark.read.format("docweave").options(**options).load(f"file://{tmp_path}")
    rows = load(bytesPerPartition=str(len(many) // 4))
    assert rows.rdd.getNumPartitions() >= 5
    pages = sorted((r.page_number, r.segment_index, r.content) for r in rows.where("file_name = 'big.pdf'").collect())
    assert pages == [(k, k - 1, f"page {k}") for k in range(1, 41)]
    asked = load(pages="2-3, 39").where("error IS NULL").collect()
    assert sorted((r.document_id, r.page_number or 0) for r in asked) == [("big", 2), ("big", 3), ("big", 39), ("note", 0)]
    assert sorted(r.file_name for r in load().where("error IS NOT NULL").collect()) == ["empty.txt", "odd.xyz"]
    assert spark.read.format("docweave").load(str(tmp_path / "note.md")).first().content == "# Überschrift"
    with pytest.raises(ValueError, match="range"):
        source.page_ranges("3-1")
