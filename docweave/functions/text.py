"""Text as Column expressions; everything stays in the JVM but NFKC and full case folding."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

CHUNK_SIZE, CHUNK_OVERLAP = 800, 120
#: Keywords that route a question, and what they route to.
COMPARE_WORDS = ("对比", "比较", "区别", "差异", "异同", "共同点")
SUMMARY_WORDS = ("总结", "概括", "综述", "主要内容", "核心内容", "全文")
QA_MODES = ("auto", "joint", "compare", "summary")


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space (Unicode) at the ends; looks at the ends only."""
    return F.btrim(c, F.lit(WHITE))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of a text: an array of stripped pieces, the last one ending with the text; blanks fall out."""

    def cut(t: Column) -> Column:
        n = F.when(F.length(t) <= size, 1).otherwise(F.ceil((F.length(t) - size) / F.lit(size - overlap)) + 1).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: strip(F.substring(t, i * (size - overlap) + 1, F.lit(size))))
        return F.filter(F.when(F.length(t) > 0, pieces).otherwise(F.array().cast("array<string>")), lambda x: F.length(x) > 0)

    return let(strip(text), cut)


def paragraphs(text: Column) -> Column:
    """Stripped parts between blank lines; where there is but one, stripped lines."""
    some = lambda parts: F.filter(F.transform(parts, strip), lambda x: F.length(x) > 0)
    blocks = lambda t: some(F.split(F.replace(t, F.lit("\r\n"), F.lit("\n")), "\n\n"))
    return let(strip(text), lambda t: let(blocks(t), lambda b: F.when(F.size(b) > 1, b).otherwise(some(F.split(t, "\n")))))


def packed_chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Paragraphs packed greedily, joined by a blank line, up to ``size``; longer ones in windows."""
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, p: Column) -> Column:
        longer = F.concat(a["now"], F.lit("\n\n"), p)
        return (
            F.when(a["now"] == "", F.struct(p.alias("now"), a["done"].alias("done")))
            .when(F.length(longer) <= size, F.struct(longer.alias("now"), a["done"].alias("done")))
            .otherwise(F.struct(p.alias("now"), F.concat(a["done"], F.array(a["now"])).alias("done")))
        )

    def chunks(t: Column) -> Column:
        packs = F.aggregate(paragraphs(t), start, step, lambda a: F.concat(a["done"], F.array(a["now"])))
        many = F.flatten(F.transform(packs, lambda p: windows(p, size, overlap)))
        return F.when(F.length(t) == 0, F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(many)

    return let(strip(text), chunks)


def disjoint_windows(text: Column, size: int) -> Column:
    """Slices of ``size`` characters that don't overlap."""
    n = F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(size))).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def lexical_tokens(text: Column) -> Column:
    """Distinct lower-cased runs of ASCII word characters, and single CJK characters."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z0-9_]+|[\\u4e00-\\u9fff])"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def working_tokens(text: Column) -> Column:
    """CJK characters first, then lower-cased words; repeats stay."""
    text = F.coalesce(text, F.lit(""))
    cjk = F.regexp_extract_all(text, F.lit("([\\u4e00-\\u9fff])"), F.lit(1))
    return F.concat(cjk, F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1)))


def terms(text: Column) -> Column:
    """Distinct lower-cased runs between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda x: x != ""))


def query_terms(text: Column, most: int = 12) -> Column:
    """Search terms of a question: words and CJK runs in order, each CJK run followed by its pairs; distinct, at most 12."""
    runs = F.regexp_extract_all(F.lower(strip(F.coalesce(text, F.lit("")))), F.lit("([a-z0-9_]+|[\\u4e00-\\u9fff]+)"), F.lit(1))

    def expand(r: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - 1)), lambda i: F.substring(r, i, F.lit(2)))
        return F.when(r.rlike("^[\\u4e00-\\u9fff]") & (F.length(r) > 1), F.concat(F.array(r), pairs)).otherwise(F.array(r))

    return F.slice(F.array_distinct(F.flatten(F.transform(runs, expand))), 1, most)


def preview(text: Column, most: int = 220) -> Column:
    """Lines stripped and joined by one space, blanks dropped, cut to ``most`` characters and '...'."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), strip), lambda x: F.length(x) > 0)
    one = F.regexp_replace(F.array_join(lines, " "), " {2,}", " ")
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most), F.lit("..."))).otherwise(one)


#: The blocks of CJK characters.
_CJK = "\\u4e00-\\u9fff\\u3400-\\u4dbf\\x{20000}-\\x{2a6df}\\x{2a700}-\\x{2b73f}\\x{2b740}-\\x{2b81f}\\x{2b820}-\\x{2ceaf}\\uf900-\\ufaff"


def approximate_tokens(text: Column) -> Column:
    """CJK characters plus runs between white space."""
    cjk = F.length(F.regexp_replace(text, f"[^{_CJK}]", ""))
    return cjk + F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


def _beyond_ascii(text: Column, plain: Column, full: Callable[[Column], Column]) -> Column:
    """``plain`` of ASCII texts and ``full`` of others; Python, which Spark runs before the choice, gets null for ASCII."""
    ascii_only = text.rlike("^[\\x00-\\x7f]*$")
    return F.coalesce(F.when(ascii_only, plain), full(F.when(~ascii_only, text)))


def digest(content: Column) -> Column:
    """sha256 of the content: NFKC where it isn't ASCII, newlines \\n, ends stripped."""
    c = F.coalesce(content, F.lit(""))
    c = _beyond_ascii(c, c, nfkc)
    return F.sha2(strip(F.regexp_replace(c, "\r\n?", "\n")), 256)


def page_number(page: Column) -> Column:
    """The page as text without spaces; blank is null."""
    return F.nullif(strip(page.cast("string")), F.lit(""))


def normal_name(name: Column) -> Column:
    """Stripped, case-folded, inner white space single. Folding beyond lower case runs only where it can differ."""
    n = F.coalesce(name, F.lit(""))
    n = _beyond_ascii(n, F.lower(n), casefold)
    return strip(F.regexp_replace(n, r"(?U)\s+", " "))


def graph_id(document: Column, kind: Column, name: Column, namespace: str = "default") -> Column:
    """document:kind:digest, stable for a name however it is spaced or cased."""
    zero = F.lit("\0")
    key = F.concat(F.lit(namespace), zero, document, zero, kind, zero, normal_name(name))
    return F.concat_ws(":", document, kind, F.substring(F.sha2(key, 256), 1, 24))


def canonical_id(kind: Column, normalized: Column, namespace: str = "default") -> Column:
    return F.substring(F.sha2(F.concat(F.lit(namespace), F.lit("\0"), kind, F.lit("\0"), normalized), 256), 1, 24)


def source_citation(document: Column, page: Column, content_digest: Column) -> Column:
    none = F.lit("")
    key = F.concat(F.coalesce(document, none), F.lit("|"), F.coalesce(page, none), F.lit("|"), content_digest)
    return F.concat(F.lit("S-"), F.substring(F.sha2(key, 256), 1, 12))


def graph_citation(document: Column, kind: Column, graph: Column) -> Column:
    return F.concat(F.lit("G-"), F.substring(F.sha1(F.concat(document, F.lit("|"), kind, F.lit("|"), graph)), 1, 10))


def qa_mode(query: Column, mode: str = "auto", summary: bool = False) -> Column:
    """The mode that answers a question: as asked, else by keywords, comparison first."""
    if mode not in QA_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    if summary or mode != "auto":
        return F.lit("summary" if summary else mode)
    return F.when(query.rlike("|".join(COMPARE_WORDS)), "compare").when(query.rlike("|".join(SUMMARY_WORDS)), "summary").otherwise("joint")


#: Keys whose values are secrets in messages and addresses.
SECRET_KEYS = ("api_key", "apikey", "api-key", "key", "access_token", "token", "authorization", "auth", "password", "passwd", "client_secret", "secret")
#: Text between quotes, in which a quote may be escaped.
_QUOTED = r"""(?:"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+')"""


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def redacted(message: Column, secrets: tuple[str, ...] = ()) -> Column:
    """A message without user info in addresses, bearer tokens, and values of secret keys, wherever they stand in a word.

    A quoted value goes up to its closing quote; one whose quote is never closed, and a bare one, up to the next
    white space or mark that ends a value.
    """
    key = rf"(?is)((?:{_any_of(SECRET_KEYS)})[\"']?\s*[=:]\s*"
    m = F.regexp_replace(F.coalesce(message, F.lit("")), r"(?i)([a-z][a-z0-9+.-]*://)[^/@\s]+@", "$1***@")
    m = F.regexp_replace(m, rf"{key}){_QUOTED}", "$1***")
    m = F.regexp_replace(m, r"(?i)(authorization\s*[:=]\s*)(?:bearer\s+)?[^\s,;]+", "$1***")
    m = F.regexp_replace(m, r"(?i)\b(bearer\s+)[^\s,;]+", "$1***")
    m = F.regexp_replace(m, rf"{key}[\"']?)[^\"'&,;\s}}\]]+", "$1***")
    for secret in secrets:
        m = F.replace(m, F.lit(secret), F.lit("***")) if secret else m
    return m


#: What stands for a graph store's address and for a secret, and the schemes of such addresses.
GRAPH_ADDRESS, GRAPH_SECRET = "[REDACTED_NEO4J_URI]", "[REDACTED_SECRET]"
GRAPH_SCHEMES = ("bolt", "bolt+s", "bolt+ssc", "neo4j", "neo4j+s", "neo4j+ssc")
#: Short keys are common words in a graph's messages.
GRAPH_KEYS = tuple(k for k in SECRET_KEYS if k not in ("key", "auth"))


def graph_redacted(message: Column, most: int = 500) -> Column:
    """A graph store's message on one line: its addresses masked, and secret keys with their values; cut with an ellipsis.

    A key may follow any mark that isn't part of a name, as in ``cfg.password=`` or ``(token=``.
    """
    value = rf"(?:{_QUOTED}\S*|(?:bearer\s+)?\S+)"
    m = F.regexp_replace(F.coalesce(message, F.lit("")), rf"(?i)\b(?:{_any_of(GRAPH_SCHEMES)})://\S+", GRAPH_ADDRESS)
    m = F.regexp_replace(m, rf"(?is)[\"']?\b(?:{_any_of(GRAPH_KEYS)})[\"']?\s*[:=]\s*{value}", GRAPH_SECRET)
    line = strip(F.regexp_replace(m, r"(?U)\s+", " "))
    return let(line, lambda m: F.when(F.length(m) > most, F.concat(F.substring(m, 1, most - 1), F.lit("…"))).otherwise(m))


#: File name endings by modality.
MODALITIES = {
    "image": ("jpg", "jpeg", "png", "gif", "bmp", "webp"),
    "audio": ("mp3", "wav", "m4a", "flac", "aac"),
    "video": ("mp4", "avi", "mov", "mkv", "wmv"),
    "text": ("txt", "md", "json", "csv", "xml", "html", "py", "js"),
}


def modality(path: Column) -> Column:
    out = F.lit("unknown")
    for name, endings in reversed(MODALITIES.items()):
        out = F.when(F.lower(path).rlike(rf"\.(?:{'|'.join(endings)})$"), name).otherwise(out)
    return out


def timestamp(text: Column, as_of: Column | None = None) -> Column:
    """Any of the accepted spellings of a time; ``as_of`` where none fits."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd")
    tried = [F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in forms]
    return F.coalesce(*tried, *([as_of] if as_of is not None else []))


def tool_calls(text: Column) -> Column:
    """The [TOOL_CALL:name:arguments] marks of a text: an array of (name, arguments)."""
    whole = r"(\[TOOL_CALL:[^:\]]+:[^\]]+\])"
    return F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(1)), lambda c: F.struct(F.regexp_extract(c, r"^\[TOOL_CALL:([^:\]]+):", 1).alias("name"), F.regexp_extract(c, r"^\[TOOL_CALL:[^:\]]+:([^\]]+)\]$", 1).alias("arguments")))


def label_id(label: Column) -> Column:
    """The id behind the last pipe of 'name | id'; a label without one is the id."""
    return strip(F.when(F.contains(label, F.lit("|")), F.regexp_extract(label, r"\|([^|]*)$", 1)).otherwise(label))


def tool_arguments(arguments: Column, default: str = "input") -> Column:
    """'a=1,b=2' as a map; text without '=' is the value of ``default``."""
    pairs = F.transform_keys(F.transform_values(F.str_to_map(arguments, F.lit(","), F.lit("=")), lambda _, v: strip(v)), lambda k, _: strip(k))
    return F.when(F.contains(arguments, F.lit("=")), pairs).otherwise(F.create_map(F.lit(default), strip(arguments)))


def redacted_url(url: Column) -> Column:
    """An address without user info; values of secret keys in its query masked."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^([a-zA-Z][\w+.-]*://)[^/@?#]*@", "$1")
    return F.regexp_replace(bare, rf"(?i)([?&](?:{_any_of(SECRET_KEYS)})=)[^&#]*", "$1***")


#: States of a remote store that pass by themselves, and words that say so.
TRANSIENT_STATUS = (408, 425, 429)
TRANSIENT_WORDS = ("timeout", "timed out", "temporarily", "connection", "unavailable", "rate limit")


def transient(status: Column, message: Column) -> Column:
    """Whether a failure may pass: by its status if there is one, else by its words."""
    return F.when(status.isNotNull(), status.isin(*TRANSIENT_STATUS) | (status >= 500)).otherwise(F.lower(F.coalesce(message, F.lit(""))).rlike("|".join(TRANSIENT_WORDS)))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name in a namespace (a UUID)."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def headed_paragraphs(text: Column) -> Column:
    """Markdown as an array of (content, heading_path, level): runs of lines under their headings, 'A > B' for the path."""
    empty = F.array().cast("array<string>")
    item = "array<struct<content:string,heading_path:string,level:int>>"
    start = F.struct(empty.alias("stack"), empty.alias("held"), F.array().cast(item).alias("out"))

    def flushed(a: Column) -> Column:
        one = F.struct(F.array_join(a["held"], "\n").alias("content"), F.array_join(a["stack"], " > ").alias("heading_path"), F.size(a["stack"]).alias("level"))
        return F.when(F.size(a["held"]) > 0, F.concat(a["out"], F.array(one))).otherwise(a["out"])

    def step(a: Column, line: Column) -> Column:
        marks = F.length(F.regexp_extract(line, r"^(#{1,6})\s", 1))
        title = strip(F.regexp_replace(line, r"^#{1,6}\s+", ""))
        kept = F.slice(a["stack"], F.lit(1), F.least(marks - 1, F.size(a["stack"])))
        return (
            F.when(marks > 0, F.struct(F.concat(kept, F.array(title)).alias("stack"), empty.alias("held"), flushed(a).alias("out")))
            .when(strip(line) == "", F.struct(a["stack"].alias("stack"), empty.alias("held"), flushed(a).alias("out")))
            .otherwise(F.struct(a["stack"].alias("stack"), F.concat(a["held"], F.array(strip(line))).alias("held"), a["out"].alias("out")))
        )

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), "\n"), start, step, flushed)
