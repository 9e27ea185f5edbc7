"""Golden cases over recorded prompts and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASES = "case_id string, query string, mode string, document_ids array<string>, required_document_ids array<string>, forbidden_document_ids array<string>, required_answer_markers array<string>, required_prompt_markers array<string>, minimum_llm_calls int"


def load_cases(spark, path: str) -> DataFrame:
    """Cases from a JSON file, lists and the minimum of calls with their defaults."""
    rows = spark.read.schema(CASES).option("multiLine", True).json(path)
    empty = F.array().cast("array<string>")
    return rows.select(*(F.coalesce(c, empty).alias(c) if kind.startswith("array") else F.coalesce(c, F.lit(1)).alias(c) if c == "minimum_llm_calls" else F.col(c) for c, kind in rows.dtypes))


def evaluate(traces: DataFrame) -> DataFrame:
    """``traces`` (a case's columns, prompts ARRAY, output) with ``failures`` and ``passed``."""
    prompt = F.array_join("prompts", "\n\n")
    combined = F.concat(prompt, F.lit("\n\n"), F.col("output"))

    def misses(column: str, text: Column, kind: str, wanted: bool = True) -> Column:
        some = F.filter(column, lambda x: F.contains(text, x) != F.lit(wanted))
        return F.transform(some, lambda x: F.concat(F.lit(f"{kind}:"), x))

    calls = F.when(F.size("prompts") < F.col("minimum_llm_calls"), F.array(F.lit("calls"))).otherwise(F.array().cast("array<string>"))
    failures = F.concat(
        calls, misses("required_document_ids", combined, "document"), misses("forbidden_document_ids", prompt, "leak", False),
        misses("required_answer_markers", F.col("output"), "answer"), misses("required_prompt_markers", prompt, "prompt"),
    )
    return traces.withColumn("failures", failures).withColumn("passed", F.size("failures") == 0)


def report(results: DataFrame) -> DataFrame:
    line = F.when(F.col("passed"), F.concat(F.lit("PASS "), "case_id")).otherwise(F.concat(F.lit("FAIL "), "case_id", F.lit(": "), F.array_join("failures", "; ")))
    return results.select("case_id", line.alias("line"))


def assert_all_pass(results: DataFrame) -> None:
    failed = report(results.where(~F.col("passed"))).limit(20).collect()
    if failed:
        raise AssertionError("\n".join(r.line for r in failed))
