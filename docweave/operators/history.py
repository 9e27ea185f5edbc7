"""Learning history and the document library: documents, questions and notes as append tables (position gives their order)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X


def latest(records: DataFrame, last: bool = True) -> DataFrame:
    """One record of each (user_id, document_id): the last by position, or the first."""
    order = F.desc("position") if last else F.asc("position")
    return records.withColumn("_k", F.row_number().over(Window.partitionBy("user_id", "document_id").orderBy(order))).where("_k = 1").drop("_k")


def library(records: DataFrame) -> DataFrame:
    """Each user's documents: dated ones from the newest (ties: larger id first), then the undated by id; ``place`` counts from 1."""
    rows = latest(records)
    dated = F.col("loaded_at").isNotNull()
    order = Window.partitionBy("user_id").orderBy(dated.desc(), F.desc("loaded_at"), F.when(dated, F.col("document_id")).desc(), F.col("document_id"))
    return rows.withColumn("place", F.row_number().over(order))


def delete_cascade(documents: DataFrame, questions: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """Documents and questions without those of one document; a question names it as document_id or in document_ids."""
    gone = F.coalesce(F.col("document_id") == document_id, F.lit(False))
    listed = F.coalesce(F.array_contains("document_ids", document_id), F.lit(False))
    return documents.where(~gone), questions.where(~(gone | listed))


def recall(documents: DataFrame, questions: DataFrame, notes: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """The first ``limit`` records that contain ``query``: documents, then questions, then notes."""
    parts = [(documents, ("document_name", "document_path"), "document_name"), (questions, ("question", "answer"), "question"), (notes, ("concept", "note", "content"), "note")]
    rows = None
    for k, (table, fields, shown) in enumerate(parts):
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.contains(F.coalesce(f, F.lit("")), F.lit(query))
        one = table.where(hit).select(F.lit(k).alias("kind"), "position", F.col(shown).alias("text"))
        rows = one if rows is None else rows.union(one)
    return rows.orderBy("kind", "position").limit(limit)


def recent(records: DataFrame, count: int) -> DataFrame:
    """The last ``count`` records of each user, newest first, with ``place``."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("position")))).where(F.col("place") <= count)


def upsert(records: DataFrame, new: DataFrame) -> DataFrame:
    """Replace records of the same user and document in their place, append the others."""
    key = ["user_id", "document_id"]
    place = records.groupBy(*key).agg(F.min("position").alias("_p"))
    moved = new.join(place, key, "left").withColumn("position", F.coalesce("_p", "position")).drop("_p")
    return records.join(new.select(*key).distinct(), key, "left_anti").unionByName(moved, allowMissingColumns=True)


def expired(sessions: DataFrame, as_of: str, hours: int = 12) -> DataFrame:
    """Sessions (last_access) idle for ``hours`` or more."""
    return sessions.where(F.col("last_access") <= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))


def cleared(**tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The named tables emptied, and how many records of each went (kind, removed)."""
    counts = None
    for name, table in tables.items():
        one = table.agg(F.count("*").alias("removed")).select(F.lit(name).alias("kind"), "removed")
        counts = one if counts is None else counts.union(one)
    return {name: table.limit(0) for name, table in tables.items()}, counts


def with_note(memories: DataFrame, notes: DataFrame, new: DataFrame, importance: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Notes (user_id, position, ts, note, concept) as semantic memories, 'concept: note' where there is a concept, and as history."""
    some = F.length(F.coalesce("concept", F.lit(""))) > 0
    content = F.when(some, F.concat("concept", F.lit(": "), "note")).otherwise(F.col("note"))
    memory = new.select(F.concat(F.lit("note-"), "user_id", F.lit("-"), "position").alias("memory_id"), "user_id", F.lit("semantic").alias("memory_type"), content.alias("content"), F.lit(importance).alias("importance"), "ts")
    return memories.unionByName(memory, allowMissingColumns=True), notes.unionByName(new, allowMissingColumns=True)


def learning_stats(documents: DataFrame, questions: DataFrame, notes: DataFrame) -> DataFrame:
    """Each user's numbers of loaded documents, questions and notes; 0 where there is none."""
    rows = None
    for name, table in (("documents", documents), ("questions", questions), ("notes", notes)):
        one = table.select("user_id", *[F.lit(int(name == k)).alias(k) for k in ("documents", "questions", "notes")])
        rows = one if rows is None else rows.union(one)
    return rows.groupBy("user_id").agg(*[F.sum(k).alias(k) for k in ("documents", "questions", "notes")])


def projected(records: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """Document records fit for display (user_id, document_id, name, file_suffix, loaded_at), malformed ones left out.

    ``records`` (user_id, document_id, document_name, file_suffix, document_path, loaded_at as text): nothing may be
    blank, the name must be a bare file name, the path's ending must be the suffix (without regard to case)
    and stay below the user's folder. A time that can't be read is null.
    """
    blank = lambda c: X.strip(F.coalesce(c, F.lit(""))) == ""
    names = ("document_id", "document_name", "file_suffix", "document_path")
    bad = F.col("document_name").rlike(r"[/\\]|^\.{0,2}$") | F.col("document_path").rlike(r"(^|[/\\])\.\.([/\\]|$)")
    for name in names:
        bad = bad | blank(name)
    ending = F.lower(F.regexp_extract("document_path", r"[^/\\](\.[^./\\]+)$", 1))
    bad = bad | (ending != F.lower("file_suffix"))
    if suffixes is not None:
        bad = bad | ~F.lower("file_suffix").isin(*suffixes)
    return records.where(~F.coalesce(bad, F.lit(True))).select("user_id", "document_id", F.col("document_name").alias("name"), "file_suffix", X.timestamp(F.col("loaded_at")).alias("loaded_at"))


#: What a report says where there is nothing, and how it shows questions and notes.
NO_DOCUMENTS, NO_QUESTIONS, NO_NOTES, NO_CONCEPT = "暂无导入记录", "暂无问答记录", "暂无学习笔记", "未命名概念"
ASKED_HEAD, ANSWER_HEAD = "问题：", "回答："


def report_sections(users: DataFrame, documents: DataFrame, questions: DataFrame, notes: DataFrame) -> DataFrame:
    """For each of ``users`` (user_id): counts of documents, questions and notes, and their last 5, 10 and 10 as numbered texts, oldest first.

    ``documents`` (user_id, position, document_name, loaded_at), ``questions`` (..., question, answer), ``notes``
    (..., concept, note). Answers are cut to 300 characters and '...'.
    """
    none = F.lit("None")
    some = lambda c: F.coalesce(F.col(c).cast("string"), none)
    concept = F.coalesce(F.nullif(F.col("concept"), F.lit("")), F.lit(NO_CONCEPT))
    parts = (
        ("documents", documents, 5, F.concat(some("document_name"), F.lit(" | "), some("loaded_at")), "\n", NO_DOCUMENTS),
        ("questions", questions, 10, F.concat(F.lit(ASKED_HEAD), some("question"), F.lit("\n" + ANSWER_HEAD), F.substring(some("answer"), 1, 300), F.lit("...")), "\n\n", NO_QUESTIONS),
        ("notes", notes, 10, F.concat(F.lit("【"), concept, F.lit("】"), some("note")), "\n", NO_NOTES),
    )
    out = users.select("user_id").distinct()
    for name, rows, most, line, between, empty in parts:
        counts = rows.groupBy("user_id").agg(F.count("*").alias(f"{name}_count"))
        last = recent(rows, most).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))), lambda x: x["line"]).alias("lines"))
        numbered = F.array_join(F.transform("lines", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), between)
        out = out.join(counts, "user_id", "left").join(last.select("user_id", numbered.alias(f"{name}_text")), "user_id", "left")
        out = out.withColumns({f"{name}_count": F.coalesce(f"{name}_count", F.lit(0)), f"{name}_text": F.coalesce(f"{name}_text", F.lit(empty))})
    return out


LISTS = ("documents", "questions", "notes")


def load(raw: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Histories from JSON texts (user_id, value): the lengths of their lists, a missing one empty; and users whose text is corrupt."""
    kinds = [F.coalesce(F.get_json_object(column, f"$.{name}"), F.lit("[]")).alias(name) for name in LISTS]
    rows = raw.select("user_id", F.try_parse_json(column).isNotNull().alias("_json"), F.coalesce(F.col(column).rlike(r"^\s*\{"), F.lit(False)).alias("_object"), *kinds)
    ok = F.col("_json") & F.col("_object")
    for name in LISTS:
        ok = ok & F.col(name).rlike(r"^\s*\[")
    good = rows.where(ok).select("user_id", *[F.coalesce(F.json_array_length(name), F.lit(0)).alias(name) for name in LISTS])
    return good, rows.where(~ok).select("user_id")
