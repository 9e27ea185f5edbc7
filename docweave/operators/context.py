"""Context for answers: budgets, what fits, candidates for comparisons, checks of structured answers."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X

WINDOW_TOKENS, OUTPUT_TOKENS, SAFETY_TOKENS, LEAST_CHARS = 8192, 1024, 512, 200
_SEPARATOR = 2


def budget(prompt_tokens: int, window: int = WINDOW_TOKENS, output: int = OUTPUT_TOKENS, safety: int = SAFETY_TOKENS) -> int:
    left = window - output - safety - prompt_tokens
    if left <= 0:
        raise ValueError("no capacity is left for context")
    return left


def room(prompt_tokens: Column, window: int = WINDOW_TOKENS, output: int = OUTPUT_TOKENS, safety: int = SAFETY_TOKENS) -> Column:
    """``budget`` of each row; a prompt that leaves none fails the job."""
    left = F.lit(window - output - safety) - prompt_tokens
    return F.when(left > 0, left).otherwise(F.raise_error(F.lit("no capacity is left for context")))


def drop_to_fit(rows: DataFrame, most: int) -> DataFrame:
    """The sources that stay when the lowest-scored unprotected ones fall out until all fit into ``most`` characters.

    ``rows`` (query_id, rank, score, content, protected), with blank lines between sources. Of equal scores the
    later falls first; one source always stays. A running sum over what would fall first, no loop.
    """
    cost = F.length("content") + _SEPARATOR
    per = Window.partitionBy("query_id")
    order = per.orderBy(F.col("protected").desc(), F.desc("score"), "rank")
    sized = rows.withColumn("_after", F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0)) - _SEPARATOR).withColumn("_k", F.row_number().over(order))
    return sized.where(F.col("protected") | (F.col("_after") <= most) | (F.col("_k") == 1)).drop("_after", "_k")


def common_cut(sizes: Column, most: Column, least: int = LEAST_CHARS) -> Column:
    """The sizes after one ratio has shortened all: each keeps its first ``least`` characters and the ratio of the rest.

    The ratio is 1 if all fit into ``most``, else the largest that does, by 24 halvings; 0 if not even that does.
    """
    floor = lambda n: F.least(n, F.lit(least))
    cut = lambda all_, r: F.transform(all_, lambda n: (floor(n) + F.floor((n - floor(n)) * r)).cast("int"))
    total = lambda all_: F.aggregate(all_, F.lit(0).cast("long"), lambda a, n: a + n)
    start = F.struct(F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))

    def halve(a: Column, _: Column) -> Column:
        middle = (a["low"] + a["high"]) / 2
        fits = total(cut(sizes, middle)) <= most
        return F.struct(F.when(fits, middle).otherwise(a["low"]).alias("low"), F.when(fits, a["high"]).otherwise(middle).alias("high"))

    ratio = F.when(total(sizes) <= most, F.lit(1.0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(24)), start, halve, lambda a: a["low"]))
    return X.let(ratio, lambda r: cut(sizes, r))


def _shortened(rows: DataFrame, key: str, order: str, kept: list[str], most: Column, least_chars: int) -> DataFrame:
    """``rows`` (key, order, head, content and ``kept``) of each key cut by their common ratio, blank lines between them."""
    item = F.struct(F.col(order).alias("order"), *kept, F.length(F.coalesce("head", F.lit(""))).alias("head"), F.coalesce("content", F.lit("")).alias("content"))
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("all"), most.alias("most"))
    sizes = F.transform("all", lambda x: F.length(x["content"]))
    fixed = F.aggregate("all", F.lit(0).cast("long"), lambda a, x: a + x["head"]) + _SEPARATOR * (F.size("all") - 1)
    cut = per.withColumn("room", F.col("most") - fixed).withColumn("cut", common_cut(sizes, F.col("room"), least_chars))
    fits = F.aggregate("cut", F.lit(0).cast("long"), lambda a, n: a + n) <= F.col("room")
    out = cut.select(key, fits.alias("fits"), F.explode(F.arrays_zip("all", "cut")).alias("x"))
    columns = [F.col(f"x.all.{c}").alias(c) for c in kept]
    return out.select(key, F.col("x.all.order").alias(order), *columns, F.substring(F.col("x.all.content"), F.lit(1), F.col("x.cut")).alias("content"), (F.col("x.cut") < F.length("x.all.content")).alias("truncated"), "fits")


def fit(rows: DataFrame, most: int, least_chars: int = LEAST_CHARS, kept: Sequence[str] = ()) -> DataFrame:
    """``drop_to_fit``, then one common ratio that shortens what is left: query_id, rank, ``kept`` columns, content, truncated, fits.

    Each source keeps its first ``least_chars`` characters plus the ratio of the rest. Where even the least doesn't
    fit, ``fits`` is false. A question's sources are one row for a moment; their number is bounded by what was asked for.
    """
    left = drop_to_fit(rows, most).select("query_id", F.col("rank").cast("int").alias("rank"), *kept, "content", F.lit("").alias("head"))
    return _shortened(left, "query_id", "rank", list(kept), F.lit(most).cast("long"), least_chars)


def fit_summaries(rows: DataFrame, most: int, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Summaries (query_id, document_id, head, content) of documents cut by one ratio; no document is dropped and no ``head`` is cut.

    query_id, document_id, head, content, truncated, fits; false where even the least of each doesn't fit.
    """
    named = rows.select("query_id", "document_id", "head", "content", F.col("head").alias("_head"))
    cut = _shortened(named, "query_id", "document_id", ["_head"], F.lit(most).cast("long"), least_chars)
    return cut.select("query_id", "document_id", F.col("_head").alias("head"), "content", "truncated", "fits")


def lines_that_fit(lines: DataFrame, most: int) -> DataFrame:
    """Whole lines (query_id, position, line) as long as they fit, up to the first that doesn't."""
    order = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("used", F.sum(F.length("line") + 1).over(order)).where(F.col("used") <= most)


def compare_candidates(ranked: DataFrame, limit: int = 5, per_document: int = 5, protected: int = 2) -> DataFrame:
    """For comparisons: each document's best two are protected; its next three compete by score for what ``limit`` leaves.

    ``ranked`` (query_id, document_id, id, score).
    """
    own = Window.partitionBy("query_id", "document_id").orderBy(F.desc("score"), "id")
    top = ranked.withColumn("k", F.row_number().over(own)).where(F.col("k") <= per_document).withColumn("protected", F.col("k") <= protected)
    per = Window.partitionBy("query_id")
    base = F.sum(F.col("protected").cast("int")).over(per)
    extra = F.row_number().over(Window.partitionBy("query_id", "protected").orderBy(F.desc("score"), "id"))
    return top.withColumn("_base", base).withColumn("_extra", extra).where(F.col("protected") | (F.col("_extra") <= F.lit(limit) - F.col("_base"))).drop("_base", "_extra", "k")


COMPARISON_SCHEMA = (
    "common_points array<struct<text:string,citations:array<string>>>, differences array<struct<topic:string,documents:array<struct<document_id:string,text:string,citations:array<string>>>>>, "
    "per_document_evidence array<struct<document_id:string,summary:string,citations:array<string>>>, missing_information array<struct<document_id:string,note:string>>"
)


def valid_comparisons(answers: DataFrame) -> DataFrame:
    """``answers`` (answer JSON, allowed citations, selected documents) with ``valid`` and the parsed ``comparison``.

    Valid: all four lists are there, texts are strings, citations are allowed and documents selected. A code
    fence around the JSON is taken off.
    """
    bare = F.regexp_replace(F.trim("answer"), r"^```(?:json)?\s*|\s*```$", "")
    parsed = answers.withColumn("comparison", F.from_json(bare, COMPARISON_SCHEMA))
    c = F.col("comparison")
    cited = lambda x: x["citations"].isNotNull() & (F.size(F.array_except(x["citations"], F.col("allowed"))) == 0)
    chosen = lambda x: F.array_contains(F.col("selected"), x["document_id"])
    ok = (
        c["common_points"].isNotNull() & c["differences"].isNotNull() & c["per_document_evidence"].isNotNull() & c["missing_information"].isNotNull()
        & F.forall(c["common_points"], lambda x: x["text"].isNotNull() & cited(x))
        & F.forall(c["differences"], lambda x: x["topic"].isNotNull() & x["documents"].isNotNull() & F.forall(x["documents"], lambda y: chosen(y) & y["text"].isNotNull() & cited(y)))
        & F.forall(c["per_document_evidence"], lambda x: chosen(x) & x["summary"].isNotNull() & cited(x))
        & F.forall(c["missing_information"], lambda x: chosen(x) & x["note"].isNotNull())
    )
    return parsed.withColumn("valid", F.coalesce(ok, F.lit(False)))


def generate(prompts: DataFrame, generator, prompt_col: str = "prompt", out_col: str = "answer") -> DataFrame:
    """``prompts`` with the answers of a callable from a list of texts to a list of texts, a batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out_col: generator(pdf[prompt_col].tolist())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + f", `{out_col}` string"
    return prompts.mapInPandas(run, schema)


#: Headings and marks of a rendered comparison and of an answer.
COMPARISON_HEADS = ("## 共同点", "## 差异点", "## 逐文档依据", "## 信息缺失")
NOTHING_YET, NOTHING_MISSING, NO_SOURCE = "- 暂无", "- 无", "暂无明确来源信息"
ANSWER_HEAD, COUNT_HEAD, SOURCE_HEAD, GRAPH_HEAD, CUT_NOTE = "🤖 RAG回答:", "📚 参考知识条数: ", "📌 参考来源:", "图谱参考：", "⚠️ 上下文已截断。"


def comparison_markdown(c: Column) -> Column:
    """A valid comparison as Markdown: four sections, each entry with its citations in brackets; empty ones say so."""
    marks = lambda x: F.when(F.size(x["citations"]) > 0, F.concat(F.lit(" ["), F.array_join(x["citations"], ", "), F.lit("]"))).otherwise("")
    of = lambda x, text: F.concat(F.lit("`"), x["document_id"], F.lit("`: "), text)
    points = F.transform(c["common_points"], lambda x: F.concat(F.lit("- "), x["text"], marks(x)))
    differences = F.flatten(F.transform(c["differences"], lambda d: F.concat(F.array(F.concat(F.lit("- **"), d["topic"], F.lit("**"))), F.transform(d["documents"], lambda y: F.concat(F.lit("  - "), of(y, y["text"]), marks(y))))))
    evidence = F.transform(c["per_document_evidence"], lambda x: F.concat(F.lit("- "), of(x, x["summary"]), marks(x)))
    missing = F.transform(c["missing_information"], lambda x: F.concat(F.lit("- "), of(x, x["note"])))
    lines = [F.array_join(F.concat(F.array(F.lit(head)), F.when(F.size(part) > 0, part).otherwise(F.array(F.lit(none)))), "\n") for head, part, none in zip(COMPARISON_HEADS, (points, differences, evidence, missing), (NOTHING_YET,) * 3 + (NOTHING_MISSING,), strict=True)]
    return F.concat_ws("\n\n", *lines)


def graph_source_lines(sources: Column) -> Column:
    """[citation] document | kind: name for each graph source under one heading; no source: an empty text."""
    line = lambda s: F.concat(F.lit("["), s["citation_id"], F.lit("] 文档 "), s["document_id"], F.lit(" | "), s["kind"], F.lit(": "), s["name"])
    return F.when(F.size(sources) > 0, F.array_join(F.concat(F.array(F.lit(GRAPH_HEAD)), F.transform(sources, line)), "\n")).otherwise("")


#: Lines of a list of citations, of chunks found, and what stands for a missing file or page.
CITATIONS, KEYWORDS, NO_FILE, NO_PAGE = "📌 可复制引用：", "检索关键词：", "未知文件", "未知页码"
CITATION_LINES = {"normal": ("{n}. 《{file}》，第 {page} 页。", "相关度：{score}", "引用内容：{text}", ""), "markdown": ("> **引用 {n}**  ", "> **来源**：《{file}》，第 {page} 页  ", "> **相关度**：{score}  ", "> **内容**：{text}", "")}
NO_CITATION = ("🔍 未找到与 '", "' 相关的引用内容")


def citation_text(found: DataFrame, queries: DataFrame, style: str = "normal") -> DataFrame:
    """For each question (query_id, query) its hits (query_id, rank, file_name, page_number, score, content) as quotable citations: query_id, text.

    Contents are previews of up to 260 characters; a missing file or page is named as unknown. Questions
    without hits are told so.
    """
    if style not in CITATION_LINES:
        raise ValueError(f"unknown style {style!r}")
    values = {"n": F.col("rank").cast("string"), "file": F.coalesce("file_name", F.lit(NO_FILE)), "page": F.coalesce(F.col("page_number").cast("string"), F.lit(NO_PAGE)), "score": F.format_number("score", 4), "text": X.preview(F.col("content"), 260)}
    filled = [F.concat(F.lit(""), *(values[p] if k % 2 else F.lit(p) for k, p in enumerate(re.split(r"\{(\w+)\}", line)))) for line in CITATION_LINES[style]]
    entries = found.select("query_id", F.struct("rank", F.concat_ws("\n", *filled).alias("entry")).alias("x")).groupBy("query_id").agg(F.array_sort(F.collect_list("x"))["entry"].alias("entries"))
    head = F.array(F.lit(CITATIONS), F.lit(""), F.concat(F.lit(KEYWORDS), "query"), F.lit(""))
    none = F.concat(F.lit(NO_CITATION[0]), "query", F.lit(NO_CITATION[1]))
    text = F.when(F.col("entries").isNull(), none).otherwise(F.array_join(F.concat(head, "entries"), "\n"))
    return queries.select("query_id", "query").join(entries, "query_id", "left").select("query_id", text.alias("text"))


def answer_text(answer: Column, sources: Column, truncated: Column, graph_sources: Column | None = None) -> Column:
    """An answer with its sources (citation_id, shown), each once in order, their number, and a note if the context was cut."""
    ids = F.transform(sources, lambda s: s["citation_id"])
    once = F.filter(sources, lambda s, i: F.array_position(ids, s["citation_id"]) == i + 1)
    shown = F.transform(F.filter(once, lambda s: s["shown"] != ""), lambda s: F.concat(F.lit("["), s["citation_id"], F.lit("] "), s["shown"]))
    listed = F.when(F.size(shown) > 0, F.array_join(shown, "\n")).otherwise(F.lit(NO_SOURCE))
    graph = F.lit("") if graph_sources is None else graph_source_lines(graph_sources)
    note = F.when(truncated, F.lit("\n" + CUT_NOTE)).otherwise("")
    return F.concat(F.lit(ANSWER_HEAD + "\n"), answer, F.lit("\n\n" + COUNT_HEAD), F.size(once).cast("string"), note, F.lit("\n" + SOURCE_HEAD + "\n"), listed, F.when(graph != "", F.concat(F.lit("\n"), graph)).otherwise(""))
