"""Main text of web pages with host suffix arrays.

Markup gives each page's blocks and where they stand: in an article, in a part that is never main text
(menus, headers, forms, scripts, ...), or anywhere else ("open"). Of a page whose article has at least as many
words as its open blocks the article is the text. On all other pages repetition decides: the pages' streams
outside articles (words, with marks between blocks) are concatenated, their suffixes sorted by the first RUN
entries, and substrings that stand on distinct pages of a host are boilerplate. Covered runs are cut out of
the open blocks, unique runs stay; if an article is then as long as what is left of the open blocks, it is
the text, else both are, in page order. Articles' own blocks stay even where other pages repeat them.

A host's suffix array is never in one place. Streams travel in segments of bounded size; each segment sorts
its own suffixes, sends one entry for each distinct beginning to that beginning's bucket, where the host's
equal beginnings meet, and is told which of them other pages have. So no result depends on a host's size, and
a beginning that all pages share is one entry a segment.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import SPACED, buckets, map_batches, mix64, row_groups, shingles, staged, text_bytes, words

#: Entries (words and block marks) of the shortest substring that counts as repeated.
RUN = 8
#: Bytes of html whose streams make a segment; a longer page is a segment by itself.
SEGMENT_BYTES = 2 << 20

ARTICLE, OPEN, NEVER = 2, 1, 0
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style noscript template iframe svg math textarea title".split())
_NEVER = frozenset("nav header footer aside form button select option dialog menu head canvas audio video object fieldset".split()) | _RAW
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|pager|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])", re.I
)
_START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
_QUOTED = re.compile(r">|=\s*([\"'])")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def _zone(name: str, attributes: str, inside: int) -> int:
    if name in _NEVER or inside == NEVER:
        return NEVER
    if attributes and (_HIDDEN.search(attributes) or name not in ("html", "body", "article", "main") and any(_NAMED.search(next(filter(None, m), "")) for m in _NAMES.findall(attributes))):
        return NEVER
    return ARTICLE if name in ("article", "main") else inside


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(first, end, slash, name, attributes) of each tag, comments and declarations with the name ''; in linear time.

    An element whose content is no markup (script, ...) is one tag with it. A quoted value may hold ">"; where
    quotes never close again, tags end at the next ">" from there on.
    """
    last, quotes, at = page.rfind(">"), True, 0
    while m := _START.search(page, at):
        first, at = m.start(), m.end()
        if at > last:
            return
        if m[2] is None:
            close = page.find("-->", at) if m[0] == "<!--" else page.find(">", at)
            at = len(page) if close < 0 else close + (3 if m[0] == "<!--" else 1)
            yield first, at, "", "", ""
            continue
        end, k = -1, at
        while quotes and (q := _QUOTED.search(page, k)):
            if q[1] is None:
                end = q.start()
                break
            k = page.find(q[1], q.end()) + 1
            if not k:
                break
        if end < 0:
            quotes, end = False, page.find(">", at)
        name, attributes, at = m[2].lower(), page[at:end], end + 1
        if name in _RAW and not m[1] and not attributes.endswith("/"):
            closing = _CLOSING[name].search(page, at)
            at = closing.end() if closing else len(page)
        yield first, at, m[1], name, attributes


def page_blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of a page's blocks in order: character references decoded, white space single, no empty ones."""
    out: list[tuple[int, str]] = []
    held: list[str] = []
    open_: list[tuple[str, int]] = []
    often: Counter[str] = Counter()

    def flush() -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((open_[-1][1] if open_ else OPEN, text))

    def close() -> None:
        often[open_.pop()[0]] -= 1

    at = 0
    for first, end, slash, name, attributes in _tags(page):
        held.append(page[at:first])
        at = end
        if not name:
            continue
        if name not in _INLINE:
            flush()
        if slash:
            if often[name]:
                inside = open_[-1][1]
                k = len(open_) - 1
                while open_[k][0] != name:
                    k -= 1
                if inside != (open_[k - 1][1] if k else OPEN):
                    flush()
                while len(open_) > k:
                    close()
            continue
        if name in _VOID or attributes.endswith("/"):
            continue
        if name in _ENDS_P:
            while open_ and (open_[-1][0] == "p" or open_[-1][0] in _INLINE and often["p"]):
                close()
        inside = open_[-1][1] if open_ else OPEN
        zone = _zone(name, attributes, inside)
        if zone != inside:
            flush()
        if name not in _RAW:
            open_.append((name, zone))
            often[name] += 1
    held.append(page[at:])
    flush()
    return out


def _number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _size(blocks: list[tuple[int, str]], zone: int) -> int:
    return sum(t.count(" ") + 1 for z, t in blocks if z == zone)


def decided(blocks: list[tuple[int, str]]) -> bool:
    """Whether markup alone gives the text: there is nothing open, or an article at least as long as what is."""
    return _size(blocks, ARTICLE) >= _size(blocks, OPEN)


def _joined(blocks: list[tuple[int, str]], *zones: int) -> str:
    return "\n".join(t for z, t in blocks if z in zones and t)


def _streams(pages: list[list[tuple[int, str]]], hosts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pages' entries outside articles in one stream, each entry's page and block number, and whether it is a word.

    A block is a mark and its words; an article's block is an entry that nothing equals. Hosts share no entry.
    """
    blocks = [b for p in pages for b in p]
    owner = np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    hashes, _, _, cut = words(*text_bytes(pa.array(["" if z == ARTICLE else t for z, t in blocks], pa.string())), SPACED)
    n = np.diff(cut)
    block = np.repeat(np.arange(len(blocks)), n + 1)
    stream = np.empty(len(block), np.uint64)
    begin = np.cumsum(n + 1) - n - 1
    word = np.ones(len(block), bool)
    word[begin] = False
    stream[word] = hashes
    stream[begin] = np.where([z == ARTICLE for z, _ in blocks], mix64(np.arange(len(blocks), dtype=np.uint64) + np.uint64(1 << 60)), np.uint64(1)) if blocks else 0
    page = owner[block] if len(block) else np.zeros(0, np.int64)
    return stream ^ mix64(hosts)[page], page, block, word


def suffix_order(stream: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes sorted by their first ``run`` entries, by prefix doubling, and where each kind of beginning starts in that order."""
    n = len(stream)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = np.unique(stream, return_inverse=True)
    have = 1
    while have < run:
        step = min(have, run - have)
        later = np.zeros(n, np.int64)
        later[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
        have += step
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    return order, np.flatnonzero(np.append(True, r[1:] != r[:-1]))


def _keys(stream: np.ndarray, page: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The places whose next ``run`` entries lie in one page, and a hash of these entries."""
    whole = np.flatnonzero(page[run - 1 :] == page[: len(page) - run + 1]) if len(page) >= run else np.zeros(0, np.int64)
    return whole, shingles(stream, run)[whole]


def beginnings(pages: list[list[tuple[int, str]]], hosts: np.ndarray, digests: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment: each distinct beginning of a suffix as a hash, the least digest of its pages, and whether there are several.

    Pages that are copies of one another have equal digests and count as one.
    """
    stream, page, _, _ = _streams(pages, hosts)
    whole, key = _keys(stream, page, run)
    key_of = np.zeros(len(stream), np.uint64)
    key_of[whole] = key
    inside = np.zeros(len(stream), bool)
    inside[whole] = True
    order, start = suffix_order(stream, run)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    least = np.minimum.reduceat(np.where(inside, digests[page], np.uint64((1 << 64) - 1))[order], start)
    most = np.maximum.reduceat(np.where(inside, digests[page], np.uint64(0))[order], start)
    some = np.maximum.reduceat(np.where(inside, key_of, np.uint64(0))[order], start)
    real = np.logical_or.reduceat(inside[order], start)
    return some[real], least[real], (least != most)[real]


def unique_runs(pages: list[list[tuple[int, str]]], hosts: np.ndarray, repeated: np.ndarray, run: int = RUN) -> list[str]:
    """The texts of pages once the hashes of repeated beginnings (sorted) are known."""
    stream, page, block, word = _streams(pages, hosts)
    whole, key = _keys(stream, page, run)
    depth = np.zeros(len(stream) + run + 1, np.int64)
    if len(repeated):
        i = np.minimum(np.searchsorted(repeated, key), len(repeated) - 1)
        at = whole[repeated[i] == key]
        np.add.at(depth, at, 1)
        np.add.at(depth, at + run, -1)
    covered = np.cumsum(depth)[: len(stream)] > 0
    bounds = np.searchsorted(block[word], np.arange(sum(map(len, pages)) + 1))
    kept = ~covered[word]
    out, k = [], 0
    for p in pages:
        left: list[tuple[int, str]] = []
        for z, t in p:
            if z == OPEN:
                stay = kept[bounds[k] : bounds[k + 1]]
                t = t if stay.all() else " ".join(w for w, yes in zip(t.split(" "), stay, strict=True) if yes)
            left.append((z, t))
            k += 1
        left = [(z, t) for z, t in left if t]
        out.append(_joined(left, ARTICLE) if _size(left, ARTICLE) >= _size(left, OPEN) else _joined(left, ARTICLE, OPEN))
    return out


def meet(keys: np.ndarray, least: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which entries of a bucket have a beginning that stands on at least two pages."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k, p = keys[order], least[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    many = (np.minimum.reduceat(p, start) != np.maximum.reduceat(p, start)) | np.logical_or.reduceat(several[order], start)
    out = np.zeros(len(keys), bool)
    out[order] = np.repeat(many, np.diff(np.append(start, len(keys))))
    return out


def main_texts(pages: list[list[tuple[int, str]]], run: int = RUN) -> list[str]:
    """The main text of each page of one host whose blocks are at hand: what ``extract`` gives."""
    host = np.zeros(len(pages), np.uint64)
    keys, least, several = beginnings(pages, host, np.array([_number(repr(p)) for p in pages], np.uint64), run)
    texts = unique_runs(pages, host, np.sort(keys[meet(keys, least, several)]), run)
    return [_joined(p, ARTICLE) if decided(p) else t for p, t in zip(pages, texts, strict=True)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Each page's main text: page_id, url, text, n_chars (code points).

    Blocks are joined by one newline. Null or empty html, and pages of nothing but boilerplate, have an empty
    text. Pages without a host in their url are one host. Repeated rows stay and get equal texts; copies of a
    page don't make each other boilerplate. Other columns are not read. Very long pages are parsed in linear
    time and held whole by one task. An empty table gives an empty table.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host.alias("host"))
    n_buckets = buckets(pages.sparkSession)
    page_schema = f"page_id {kind}, url string"
    page_names = ["seg", "host", "digest", "known", "page_id", "url", "zones", "texts"]

    def final(batch: pa.RecordBatch) -> pa.RecordBatch:
        blocks = [page_blocks(x) for x in batch["html"].to_pylist()]
        ready = np.array([decided(b) for b in blocks], bool)
        texts = [_joined(b, ARTICLE) for b, yes in zip(blocks, ready, strict=True) if yes]
        rows = batch.filter(pa.array(ready))
        return pa.RecordBatch.from_arrays([rows["page_id"], rows["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    def segment(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        blocks = [page_blocks(x) for x in batch["html"].to_pylist()]
        digests = [_number(repr(b)) for b in blocks]
        known = [decided(b) for b in blocks]
        lean = [[(z, t) for z, t in b if z != ARTICLE or not yes] for b, yes in zip(blocks, known, strict=True)]
        some = pa.array([bool(b) for b in lean])
        hosts = np.array([_number(h) for h in batch["host"].to_pylist()], np.uint64)
        seg = _number(f"{digests} {batch['page_id'][0]} {batch['url'][0]}")
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        arrays = [as_long([seg] * len(blocks)), as_long(hosts), as_long(digests), pa.array(known), batch["page_id"], batch["url"], pa.array([bytes(z for z, _ in b) for b in lean], pa.binary()), pa.array(["\n".join(t for _, t in b) for b in lean], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, page_names).filter(some)

    def opened(rows: pa.RecordBatch | pa.Table) -> tuple[list[list[tuple[int, str]]], np.ndarray, np.ndarray]:
        blocks = [list(zip(z, t.split("\n"), strict=True)) for z, t in zip(rows["zones"].to_pylist(), rows["texts"].to_pylist(), strict=True)]
        return blocks, *(rows[c].to_numpy(zero_copy_only=False).view(np.uint64) for c in ("host", "digest"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_groups(batches, ["seg"]):
            keys, least, several = beginnings(*opened(rows.combine_chunks()), run)
            want = not all(rows["known"].to_pylist())
            to = (keys % np.uint64(n_buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            there, start = np.unique(to[order], return_index=True)
            parts = np.split(order, start[1:]) if len(there) else []
            columns = [[x[p].tobytes() for p in parts] for x in (keys, least, several)]
            yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array([rows["seg"][0].as_py()] * len(there), pa.int64()), pa.array([want] * len(there), pa.bool_()), *(pa.array(c, pa.binary()) for c in columns)], ["bucket", "seg", "want", "keys", "least", "several"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_groups(batches, ["bucket"]):
            keys, least, several = ([np.frombuffer(x, t) for x in rows[c].to_pylist()] for c, t in (("keys", np.uint64), ("least", np.uint64), ("several", bool)))
            many = meet(*(np.concatenate(x) for x in (keys, least, several)))
            parts = np.split(many, np.cumsum([len(k) for k in keys])[:-1])
            told = [(s, k[m].tobytes()) for s, w, k, m in zip(rows["seg"].to_pylist(), rows["want"].to_pylist(), keys, parts, strict=True) if w and m.any()]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in told], pa.int64()), pa.array([k for _, k in told], pa.binary())], ["seg", "told"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in row_groups(batches, ["seg"]):
            rows = rows.combine_chunks()
            told = [np.frombuffer(x, np.uint64) for x in rows["told"].to_pylist() if x is not None]
            rows = rows.filter(rows["zones"].is_valid())
            if rows.num_rows:
                blocks, hosts, _ = opened(rows)
                texts = unique_runs(blocks, hosts, np.unique(np.concatenate(told)) if told else np.zeros(0, np.uint64), run)
                yield pa.RecordBatch.from_arrays([rows["page_id"].combine_chunks(), rows["url"].combine_chunks(), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    result = f"{page_schema}, text string, n_chars long"
    segments = staged(map_batches(pages, segment, f"seg long, host long, digest long, known boolean, {page_schema}, zones binary, texts string", "html", segment_bytes))
    sent = segments.drop("page_id", "url").mapInArrow(send, "bucket long, seg long, want boolean, keys binary, least binary, several binary")
    told = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(answer, "seg long, told binary")
    both = segments.where("not known").withColumn("told", F.lit(None).cast("binary")).unionByName(told, allowMissingColumns=True)
    cut = both.repartition("seg").sortWithinPartitions("seg").mapInArrow(finish, result)
    return map_batches(pages, final, result, "html").unionByName(cut)
