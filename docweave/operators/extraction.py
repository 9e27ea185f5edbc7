"""Graphs from a generator's answers: parse, check, assemble nodes and edges.

``answers`` (document_id, chunk_id, answer JSON) come from any generator, one for each batch of chunks; an
answer has seven lists. Problems are rows, so that a bad answer can be asked again and doesn't fail a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.operators import graph as G
from docweave.sources.tables import scratch

_ITEM = "struct<name:string,description:string,chunk_id:string,confidence:double>"
_LINK = "struct<source:string,target:string,type:string,relation_name:string,chunk_id:string,evidence:string,confidence:double>"
#: The lists of an answer and what each makes.
LISTS = {"concepts": "Concept", "knowledge_points": "KnowledgePoint", "persons": "Person"}
RELATIONS = {"concept_relations": ("Concept", G.CONCEPT_TYPES), "knowledge_relations": ("KnowledgePoint", G.KNOWLEDGE_TYPES), "person_relations": ("Person", ("RELATED_TO",))}
SCHEMA = ", ".join([*(f"{k} array<{_ITEM}>" for k in LISTS), *(f"{k} array<{_LINK}>" for k in RELATIONS), "mentions array<struct<type:string,name:string,chunk_id:string,evidence:string,confidence:double>>"])


def parsed(answers: DataFrame) -> DataFrame:
    """``answers`` with ``graph`` and ``problem`` (null if all seven lists are there); a code fence is taken off."""
    bare = F.regexp_replace(F.trim("answer"), r"^```(?:json)?\s*|\s*```$", "")
    out = answers.withColumn("graph", F.from_json(bare, SCHEMA))
    missing = F.lit(False)
    for k in (*LISTS, *RELATIONS, "mentions"):
        missing = missing | F.col("graph")[k].isNull()
    return out.withColumn("problem", F.when(F.col("graph").isNull() | missing, "not a graph answer"))


def entities(good: DataFrame, namespace: str = "default") -> DataFrame:
    """One node for each kind and normalised name of a document; properties as first met by chunk."""
    rows = None
    for name, label in LISTS.items():
        one = good.select("document_id", F.lit(label).alias("label"), F.explode(F.col("graph")[name]).alias("x"))
        rows = one if rows is None else rows.union(one)
    named = rows.select("document_id", "label", X.normal_name(F.col("x.name")).alias("normalized_name"), "x").where("normalized_name <> ''")
    first = named.groupBy("document_id", "label", "normalized_name").agg(F.min_by("x", F.struct("x.chunk_id", "x.name")).alias("x"))
    return first.select("document_id", X.graph_id(F.col("document_id"), F.lower("label"), F.col("normalized_name"), namespace).alias("graph_id"), "label", F.trim("x.name").alias("name"), "normalized_name", "x.description")


def relations(good: DataFrame, nodes: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges between known ends, and problems: 'dangling' ends, 'unsupported' types, chunks that aren't the document's."""
    rows = None
    for name, (label, types) in RELATIONS.items():
        one = good.select("document_id", F.lit(label).alias("label"), F.explode(F.col("graph")[name]).alias("x"))
        kind = F.lit("RELATED_TO") if label == "Person" else F.upper(F.trim("x.type"))
        one = one.withColumn("type", kind).withColumn("supported", F.coalesce(F.col("type").isin(*types), F.lit(False)))
        rows = one if rows is None else rows.unionByName(one)
    rows = rows.withColumn("_s", X.normal_name(F.col("x.source"))).withColumn("_t", X.normal_name(F.col("x.target"))).withColumn("chunk_id", F.col("x.chunk_id"))
    n = nodes.select("document_id", "label", "normalized_name", "graph_id")
    there = chunks.select("document_id", "chunk_id", F.lit(True).alias("_there")).distinct()
    full = (
        rows.join(n.toDF("document_id", "label", "_s", "source_id"), ["document_id", "label", "_s"], "left")
        .join(n.toDF("document_id", "label", "_t", "target_id"), ["document_id", "label", "_t"], "left")
        .join(there, ["document_id", "chunk_id"], "left")
    )
    why = F.when(~F.col("supported"), "unsupported").when(F.col("source_id").isNull() | F.col("target_id").isNull(), "dangling").when(F.col("_there").isNull(), "unknown chunk")
    marked = full.withColumn("problem", why)
    edges = marked.where("problem IS NULL").select("document_id", "source_id", "type", "target_id", F.col("x.relation_name").alias("relation_name"), "chunk_id", F.col("x.evidence").alias("evidence"), G.confidence(F.col("x.confidence")).alias("confidence"))
    edges = edges.dropDuplicates(["document_id", "source_id", "target_id", "type", "relation_name", "chunk_id"])
    return edges, marked.where("problem IS NOT NULL").select("document_id", "problem", F.col("x.source").alias("source"), F.col("x.target").alias("target"), "type")


def mentions(good: DataFrame, nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """MENTIONS edges from chunks to the entities that answers name for them."""
    alias = F.create_map(*[F.lit(x) for k, v in {"concept": "Concept", "knowledge_point": "KnowledgePoint", "knowledgepoint": "KnowledgePoint", "person": "Person"}.items() for x in (k, v)])
    rows = good.select("document_id", F.explode("graph.mentions").alias("x")).select("document_id", F.try_element_at(alias, F.lower("x.type")).alias("label"), X.normal_name(F.col("x.name")).alias("normalized_name"), F.col("x.chunk_id").alias("chunk_id"), F.col("x.evidence").alias("evidence"), G.confidence(F.col("x.confidence")).alias("confidence"))
    found = rows.join(nodes.select("document_id", "label", "normalized_name", "graph_id"), ["document_id", "label", "normalized_name"]).join(chunks.select("document_id", "chunk_id").distinct(), ["document_id", "chunk_id"], "left_semi")
    return found.select("document_id", F.col("chunk_id").alias("source_id"), F.lit("MENTIONS").alias("type"), F.col("graph_id").alias("target_id"), "evidence", "confidence")


def structural_edges(chunks: DataFrame) -> DataFrame:
    """HAS_CHAPTER, PARENT_OF and HAS_CHUNK from the chunks' heading paths."""
    tree = G.chapters(chunks)
    top = tree.select("document_id", F.coalesce("parent", "document_id").alias("source_id"), F.when(F.col("parent").isNull(), "HAS_CHAPTER").otherwise("PARENT_OF").alias("type"), F.col("path").alias("target_id"))
    path = F.array_join("heading_path", " > ")
    held = chunks.select("document_id", F.when(F.size("heading_path") > 0, path).otherwise(F.col("document_id")).alias("source_id"), F.lit("HAS_CHUNK").alias("type"), F.col("chunk_id").alias("target_id"))
    return top.union(held)


def _stored(df: DataFrame) -> DataFrame:
    path = f"{scratch(df.sparkSession)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def assembled(good: DataFrame, chunks: DataFrame, namespace: str = "default") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole graph of each document with good answers: nodes, edges, and relations that are left out.

    Nodes (document_id, graph_id, label, name): the document, its chapters, chunks and entities. Edges (document_id,
    source_id, type, target_id, evidence, confidence): relations, mentions and structure; of several between the
    same ends one stays, a relation before a mention, then by chunk and evidence. ``chunks`` (document_id,
    chunk_id, chunk_index, heading_path) of other documents are left out. Parsed answers and entities are
    written to the shared folder, since every part reads them. Documents are never gathered.
    """
    good = _stored(good.select("document_id", "graph"))
    own = chunks.join(good.select("document_id").distinct(), "document_id", "left_semi")
    named = _stored(entities(good, namespace))
    tree = G.chapters(own)
    ids = own.select("document_id").distinct()
    nodes = (
        ids.select("document_id", F.col("document_id").alias("graph_id"), F.lit("Document").alias("label"), F.col("document_id").alias("name"))
        .unionByName(tree.select("document_id", F.col("path").alias("graph_id"), F.lit("Chapter").alias("label"), F.col("path").alias("name")))
        .unionByName(own.select("document_id", F.col("chunk_id").alias("graph_id"), F.lit("Chunk").alias("label"), F.col("chunk_id").alias("name")).distinct())
        .unionByName(named.select("document_id", "graph_id", "label", "name"))
    )
    related, problems = relations(good, named, own)
    ends = ["document_id", "source_id", "type", "target_id"]
    parts = [
        related.select(*ends, "evidence", "confidence", F.struct(F.lit(0).alias("kind"), "chunk_id", "evidence").alias("position")),
        mentions(good, named, own).select(*ends, "evidence", "confidence", F.struct(F.lit(1).alias("kind"), F.col("source_id").alias("chunk_id"), "evidence").alias("position")),
    ]
    none = F.lit(None).cast("string")
    parts.append(structural_edges(own).select(*ends, none.alias("evidence"), F.lit(None).cast("double").alias("confidence"), F.struct(F.lit(2).alias("kind"), none.alias("chunk_id"), none.alias("evidence")).alias("position")))
    edges = G.dedupe_edges(parts[0].unionByName(parts[1]).unionByName(parts[2])).drop("position")
    return nodes, edges, problems


def upsert_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """Build states by document: new rows replace old ones, counters that a new row leaves null carry on."""
    was = state.select("document_id", F.col("attempt_count").alias("_a"), F.col("llm_attempt_count").alias("_l"), F.col("build_id").alias("_b"))
    fresh = new.join(was, "document_id", "left").withColumns({"attempt_count": F.coalesce("attempt_count", "_a", F.lit(0)), "llm_attempt_count": F.coalesce("llm_attempt_count", "_l", F.lit(0)), "build_id": F.coalesce("build_id", "_b")}).drop("_a", "_l", "_b")
    return state.join(new.select("document_id"), "document_id", "left_anti").unionByName(fresh)
