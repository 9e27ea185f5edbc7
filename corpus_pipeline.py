"""Five operators in a row over a corpus: documents in, digests of encoded clean documents out.

Each stage takes all rows that its predecessor kept; all but the last return the columns of documents.
Decisions are on rows, not ids: rows without an id, or with the id of another text, are judged as all others,
and columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.llm import bpe, decontamination, ngram_join, quality, toxicity
from docweave.llm.common import fold_of, staged


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kept(docs: DataFrame, score: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows of ``docs`` whose score is kept; the row travels as one column, so no name can clash."""
    return score(docs.select(F.struct(*docs.columns).alias("row"), "text")).where(keep).select("row.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps (score 0.3 or more)."""
    network = quality.fit(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality"), fold_of("doc_id") != 0)
    return _kept(docs, lambda rows: quality.score(rows, network), F.col("score") >= 0.3)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't mark (score under 0.5)."""
    model = toxicity.fit(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "toxic"), fold_of("doc_id") != 0)
    return _kept(docs, lambda rows: toxicity.score(rows, model), F.col("score") < 0.5)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (5-word shingles, similarity 0.8): the one with the smallest id, rows without an id last.

    Equal rows count as one, also if they have no words; other rows without words are groups by themselves.
    """
    names = docs.columns
    key = F.xxhash64(*names, *(F.col(c).isNull() for c in names)).alias("key")
    rows = docs.select(F.struct(*names).alias("row"), "doc_id", "text", key)
    groups = ngram_join.jaccard_components(rows, id_col="key", size=5, percent=80).select(F.col("doc_id").alias("key"), "component_id").distinct()
    least = groups.join(rows.select("key", "doc_id").distinct(), "key").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least"))
    one = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return rows.withColumn("n", one).where("n = 1").join(least.select("least.key"), "key", "left_semi").select("row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text no window of a benchmark item stands."""
    text = F.xxhash64(docs["text"])
    found = decontamination.decontaminate(docs.select(text.alias("key"), "text"), _table(spark, sf_dir, "benchmark"), id_col="key")
    hit = staged(found.where("n_hit > 0").select(F.col("doc_id").alias("hit")).distinct())
    return docs.join(hit, text == hit["hit"], "left_anti")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids and what they decode to, as digests."""
    coded = bpe.bpe_encode(docs, decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_jaccard", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: Classifiers and token ids have no SQL form; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each keeps is written to the shared folder and read again."""
    rows = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        rows = stage(spark, rows, sf_dir)
        if k + 1 < len(STAGES):
            rows = staged(rows)
    return rows
