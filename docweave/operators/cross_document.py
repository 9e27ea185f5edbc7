"""What several documents' graphs have in common for a question, the sources that this gives, and whether graphs are wanted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X

#: Labels of entities that documents can share, and how many documents, entities and members count.
SHARED_LABELS = ("Concept", "KnowledgePoint", "Person")
LEAST_DOCUMENTS, MOST_DOCUMENTS, ENTITY_LIMIT, EVIDENCE_LIMIT = 2, 10, 12, 40
GRAPH_MODES = ("off", "auto", "required")


def selections(questions: DataFrame, states: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions (query_id, query, document_ids) one row for each document, and why others can't be asked (query_id, problem).

    Ids are trimmed and count once. There must be 2 to 10, none blank, and the graph of each must be ready in
    ``states`` (document_id, status); of several that aren't, the first in the question's order is named.
    """
    ids = F.array_distinct(F.transform("document_ids", lambda x: X.strip(F.coalesce(x, F.lit("")))))
    named = questions.select("query_id", "query", F.coalesce(ids, F.array().cast("array<string>")).alias("ids"))
    size = F.size("ids")
    wrong = F.when(F.array_contains("ids", ""), "document_id is required").when((size < LEAST_DOCUMENTS) | (size > MOST_DOCUMENTS), f"document_ids must contain between {LEAST_DOCUMENTS} and {MOST_DOCUMENTS} items")
    told = named.withColumn("problem", wrong)
    each = told.where("problem IS NULL").select("query_id", "query", F.posexplode("ids").alias("place", "document_id"))
    known = states.select(F.col("document_id").alias("known"), "status")
    met = each.join(known, F.col("document_id") == F.col("known"), "left").withColumn("status", F.coalesce("status", F.lit("pending")))
    unready = met.where("status <> 'ready'").groupBy("query_id").agg(F.min_by(F.concat("document_id", F.lit(": "), "status"), "place").alias("problem"))
    ready = each.join(unready, "query_id", "left_anti").select("query_id", "query", "document_id")
    return ready, told.where("problem IS NOT NULL").select("query_id", "problem").unionByName(unready)


def shared_evidence(ready: DataFrame, nodes: DataFrame, entity_limit: int = ENTITY_LIMIT, evidence_limit: int = EVIDENCE_LIMIT, fair: bool = False, namespace: str = "default") -> DataFrame:
    """Entities that two or more of a question's documents name, with the nodes that name them:
    query_id, entity_rank, canonical_id, label, normalized_name, name, documents, member_rank, document_id, graph_id.

    ``ready`` as ``selections`` gives it. A name must contain a term of the question. At most ``entity_limit``
    entities by label and name, and of each ``evidence_limit`` members by document and id; with ``fair`` the
    documents take turns, so that one with many members doesn't crowd out the others.
    """
    asked = ready.select("query_id", "document_id", X.query_terms(F.col("query")).alias("terms"))
    own = nodes.where(F.col("label").isin(*SHARED_LABELS)).withColumn("key", F.lower(X.strip(F.coalesce("normalized_name", F.lit(""))))).where("key <> ''")
    met = own.join(asked, "document_id").where(F.exists("terms", lambda t: F.contains(F.lower("normalized_name"), t) | F.contains(F.lower(F.coalesce("name", F.lit(""))), t)))
    met = met.select("query_id", "document_id", "graph_id", "label", F.col("key").alias("normalized_name"), "name")
    entity = ["query_id", "label", "normalized_name"]
    shared = met.groupBy(*entity).agg(F.countDistinct("document_id").alias("documents"), F.min_by("name", F.struct("document_id", "graph_id")).alias("entity_name")).where(F.col("documents") >= LEAST_DOCUMENTS)
    ranked = shared.withColumn("entity_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("label", "normalized_name"))).where(F.col("entity_rank") <= entity_limit)
    members = met.join(ranked, entity)
    order = [F.col("document_id"), F.col("graph_id")]
    if fair:
        members = members.withColumn("turn", F.row_number().over(Window.partitionBy(*entity, "document_id").orderBy("graph_id")))
        order = [F.col("turn"), *order]
    members = members.withColumn("member_rank", F.row_number().over(Window.partitionBy(*entity).orderBy(*order))).where(F.col("member_rank") <= evidence_limit)
    return members.select("query_id", "entity_rank", X.canonical_id(F.col("label"), F.col("normalized_name"), namespace).alias("canonical_id"), "label", "normalized_name", F.col("entity_name").alias("name"), "documents", "member_rank", "document_id", "graph_id")


def gate(contexts: DataFrame, ready: DataFrame, problems: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``contexts`` (query_id, ...) that may be used, and the questions that must fail before an answer is generated (query_id, problem).

    'off' uses none; 'auto' uses what there is; 'required' fails questions with a problem and those for whose
    documents nothing was found.
    """
    if mode not in GRAPH_MODES:
        raise ValueError(f"unknown graph mode {mode!r}")
    if mode == "off":
        return contexts.limit(0), problems.limit(0)
    if mode == "auto":
        return contexts, problems.limit(0)
    empty = ready.select("query_id").distinct().join(contexts.select("query_id").distinct(), "query_id", "left_anti").withColumn("problem", F.lit("GraphContextEmpty"))
    return contexts, problems.unionByName(empty)


def sources(entities: DataFrame | None = None, relations: DataFrame | None = None, shared: DataFrame | None = None) -> DataFrame:
    """The graph sources of answers, each citation once: query_id, citation_id, document_id, kind, type, name.

    ``entities`` (query_id, document_id, graph_id, label, name), ``relations`` (query_id, document_id, source_id,
    target_id, type, evidence), ``shared`` as ``shared_evidence`` gives it, whose document is all its question's
    documents. Names that are missing are the ids.
    """
    parts = []
    if shared is not None:
        scopes = shared.groupBy("query_id").agg(F.array_sort(F.collect_set("document_id")).alias("ids"))
        rows = shared.select("query_id", "canonical_id", "label", "name").distinct().join(scopes, "query_id")
        parts.append(rows.select("query_id", X.graph_citation(F.array_join("ids", "|"), F.lit("canonical_entity"), F.col("canonical_id")).alias("citation_id"), F.array_join("ids", ", ").alias("document_id"), F.lit("canonical_entity").alias("kind"), F.col("label").alias("type"), F.coalesce("name", "canonical_id").alias("name")))
    if entities is not None:
        parts.append(entities.where("graph_id <> ''").select("query_id", X.graph_citation(F.col("document_id"), F.lit("entity"), F.col("graph_id")).alias("citation_id"), "document_id", F.lit("entity").alias("kind"), F.col("label").alias("type"), F.coalesce("name", "graph_id").alias("name")))
    if relations is not None:
        none = F.lit("")
        key = F.concat_ws("|", F.coalesce("source_id", none), F.coalesce("target_id", none), F.coalesce("type", none))
        parts.append(relations.withColumn("key", key).select("query_id", X.graph_citation(F.col("document_id"), F.lit("relation"), F.col("key")).alias("citation_id"), "document_id", F.lit("relation").alias("kind"), "type", F.coalesce(F.nullif("evidence", none), "key").alias("name")))
    if not parts:
        raise ValueError("give entities, relations or shared entities")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("query_id", "citation_id").agg(*(F.min_by(c, F.struct("document_id", "kind", "name")).alias(c) for c in ("document_id", "kind", "type", "name")))
