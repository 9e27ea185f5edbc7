"""Text of PDF files by page: a small reader for unencrypted files whose streams are plain or deflated.

It follows the page tree, joins a page's content streams and reads their text operators; fonts' ToUnicode
tables turn codes into characters, other fonts count as Windows-1252. Scanned pages have no text. For other
files give ``read_documents`` a reader of your own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()%]*|\[|\]|[^\s/<>\[\]()%]+|%[^\r\n]*", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: A shift to the left of so many thousandths between parts of one string is a space.
_GAP = 200
#: A stream that unpacks to more is an error, so that a small file can't fill a worker.
MOST_BYTES = 256 << 20


class _File:
    def __init__(self, raw: bytes) -> None:
        if b"/Encrypt" in raw:
            raise ValueError("the PDF is encrypted")
        self.objects: dict[int, bytes] = {}
        for number, body in _OBJECT.findall(raw):  # in the order of the file: what an update brings later counts
            self.objects[int(number)] = body
            if re.search(rb"/Type\s*/ObjStm\b", body):
                count, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
                data = self.stream(body)
                head = [int(x) for x in data[:first].split()[: 2 * count]]
                ends = [*head[3::2], len(data) - first]
                for held, start, end in zip(head[::2], head[1::2], ends, strict=True):
                    self.objects[held] = data[first + start : first + end]

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.match(body)
        if not m:
            return b""
        filters = re.search(rb"/Filter\s*(?:\[([^\]]*)\]|(/\w+))", m[1])
        names = re.findall(rb"/(\w+)", filters[1] or filters[2]) if filters else []
        if not names:
            return m[2]
        if names != [b"FlateDecode"]:
            raise ValueError(f"a stream is coded in a way that isn't known: {b' '.join(names).decode()}")
        unpacker = zlib.decompressobj()
        data = unpacker.decompress(m[2], MOST_BYTES)
        if unpacker.unconsumed_tail:
            raise ValueError("a stream is too long")
        return data

    def value(self, body: bytes, key: str) -> bytes:
        """What stands behind ``key`` in a dictionary, references followed: a dictionary, an array, or the rest."""
        m = re.search(rb"/" + key.encode() + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := re.match(rb"(\d+)\s+\d+\s+R\b", rest):
            return self.objects.get(int(ref[1]), b"")
        pair = next(((a, b) for a, b in ((b"<<", b">>"), (b"[", b"]")) if rest.startswith(a)), None)
        if pair is None:
            return rest
        depth = 0
        for m in re.finditer(re.escape(pair[0]) + b"|" + re.escape(pair[1]), rest):
            depth += 1 if m[0] == pair[0] else -1
            if not depth:
                return rest[: m.end()]
        return rest

    def references(self, body: bytes) -> list[bytes]:
        return [self.objects.get(int(n), b"") for n in re.findall(rb"(\d+)\s+\d+\s+R\b", body)]

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in order; resources may come from the nodes above."""
        out: list[tuple[bytes, bytes]] = []
        seen: set[bytes] = set()

        def walk(node: bytes, resources: bytes) -> None:
            if node in seen:
                return
            own = self.value(node, "Resources") or resources
            if kids := self.value(node, "Kids"):
                seen.add(node)
                for kid in self.references(kids):
                    walk(kid, own)
            elif node:
                out.append((node, own))

        for body in self.objects.values():
            if re.search(rb"/Type\s*/Catalog\b", body):
                walk(self.value(body, "Pages"), b"")
        return out

    def contents(self, page: bytes) -> bytes:
        whole = self.value(page, "Contents")
        return b"\n".join(self.stream(x) for x in (self.references(whole) if whole.startswith(b"[") else [whole]))

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Each font's bytes a code and its table of characters (empty: Windows-1252)."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R\b", self.value(resources, "Font")):
            font = self.objects.get(int(number), b"")
            table = _unicode(self.stream(self.value(font, "ToUnicode")))
            out[name] = (2 if re.search(rb"/Subtype\s*/Type0\b", font) else 1, table)
        return out


def _unicode(cmap: bytes) -> dict[int, str]:
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "ignore")
    out = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<(\w+)>\s*<(\w+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, one, many in re.findall(rb"<(\w+)>\s*<(\w+)>\s*(?:<(\w+)>|\[(.*?)\])", block, re.S):
            low, high = int(a, 16), int(b, 16)
            if one:
                start = text(one)
                out |= {k: start[:-1] + chr(ord(start[-1]) + k - low) for k in range(low, high + 1) if start}
            else:
                out |= dict(zip(range(low, high + 1), map(text, re.findall(rb"<(\w+)>", many)), strict=False))
    return out


def _bytes(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    unescaped = lambda m: _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1])
    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", unescaped, token[1:-1], flags=re.S)


def _page_text(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    out: list[str] = []
    held: list[bytes] = []
    font: tuple[int, dict[int, str]] = (1, {})

    def shown(token: bytes) -> str:
        width, table = font
        raw = _bytes(token)
        if not table:
            return raw.decode("cp1252", "replace")
        return "".join(table.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))

    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<[/]" or re.fullmatch(rb"[+-]?[\d.]+", token):
            held.append(token)
            continue
        strings = [t for t in held if t[:1] in (b"(", b"<")]
        if token == b"Tf" and len(held) > 1:
            font = fonts.get(held[-2][1:], (1, {}))
        elif token in (b"T*", b"TD", b"Tm", b"ET", b"'", b'"') or token == b"Td" and held[-1:] not in ([b"0"], [b"0.0"]):
            out.append("\n")
        if token in (b"Tj", b"'", b'"'):
            out += map(shown, strings[-1:])
        elif token == b"TJ":
            for t in held:
                if t[:1] in (b"(", b"<"):
                    out.append(shown(t))
                elif t not in (b"[", b"]") and not t.startswith(b"/") and float(t) < -_GAP:
                    out.append(" ")
        held.clear()
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def read_pdf(raw: bytes, wanted: Callable[[int], bool] | None = None) -> list[tuple[int | None, str]]:
    """(page number from 1, text) of each page (of those that are ``wanted``), blank ones included; other pages aren't unpacked."""
    if not raw.startswith(b"%PDF"):
        raise ValueError("not a PDF file")
    file = _File(raw)
    return [(k, _page_text(file.contents(page), file.fonts(resources))) for k, (page, resources) in enumerate(file.pages(), 1) if wanted is None or wanted(k)]
