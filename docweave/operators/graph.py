"""Document-scoped property graphs: nodes (document_id, graph_id, label, name, ...) and edges (document_id, source_id, type, target_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X

#: Relation types that each kind of end may have, and labels that a search starts from.
CONCEPT_TYPES = ("RELATED_TO", "PART_OF", "IS_A", "CONTRASTS_WITH")
KNOWLEDGE_TYPES = ("DEPENDS_ON", "PREREQUISITE_OF")
SEED_LABELS = ("Concept", "KnowledgePoint", "Person", "Chapter")


def rule_entities(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 10) -> DataFrame:
    """(document_id, position, name): the first ``most`` words of two or more characters, each once, in order."""
    words = F.slice(F.regexp_extract_all(F.coalesce(text_col, F.lit("")), F.lit("([\\u4e00-\\u9fffA-Za-z0-9_]{2,})"), F.lit(1)), 1, most)
    return texts.select(F.col(id_col).cast("string").alias("document_id"), F.posexplode(F.array_distinct(words)).alias("position", "name"))


def rule_relations(entities: DataFrame) -> DataFrame:
    """Each entity related to the next one of its document."""
    after = Window.partitionBy("document_id").orderBy("position")
    rows = entities.select("document_id", "position", F.col("name").alias("source"), F.lead("name").over(after).alias("target"))
    return rows.where("target is not null").withColumn("type", F.lit("RELATED_TO"))


def concept_nodes(entities: DataFrame, namespace: str = "default") -> DataFrame:
    """One Concept for each normalised name of a document; the name as first met."""
    named = entities.withColumn("normalized_name", X.normal_name(F.col("name"))).where("normalized_name <> ''")
    first = named.groupBy("document_id", "normalized_name").agg(F.min_by("name", "position").alias("name"), F.min("position").alias("ord"))
    return first.select("document_id", X.graph_id(F.col("document_id"), F.lit("concept"), F.col("name"), namespace).alias("graph_id"), F.lit("Concept").alias("label"), "name", "normalized_name", "ord")


def concept_edges(relations: DataFrame, namespace: str = "default") -> DataFrame:
    end = lambda c: X.graph_id(F.col("document_id"), F.lit("concept"), F.col(c), namespace)
    return relations.select("document_id", end("source").alias("source_id"), "type", end("target").alias("target_id"), "position")


def resolve(relations: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations by name as edges between ids, and those with an end that no node of the document has."""
    n = nodes.select("document_id", "normalized_name", "graph_id")
    rows = relations.withColumn("_s", X.normal_name(F.col("source"))).withColumn("_t", X.normal_name(F.col("target")))
    a = n.toDF("document_id", "_s", "source_id")
    b = n.toDF("document_id", "_t", "target_id")
    both = rows.join(a, ["document_id", "_s"], "left").join(b, ["document_id", "_t"], "left").drop("_s", "_t")
    whole = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    return both.where(whole), both.where(~whole)


def confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.5))))


def dedupe_edges(edges: DataFrame, keys: tuple[str, ...] = ("document_id", "source_id", "target_id", "type")) -> DataFrame:
    """The first edge of each key by position."""
    return edges.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("position"))).where("_k = 1").drop("_k")


def merged_edges(edges: DataFrame) -> DataFrame:
    """What a store that merges parallel edges keeps: the last properties of each (source, type, target)."""
    last = Window.partitionBy("document_id", "source_id", "type", "target_id").orderBy(F.desc("position"))
    return edges.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")


def context(nodes: DataFrame, edges: DataFrame, queries: DataFrame, node_limit: int = 8, relation_limit: int = 16) -> DataFrame:
    """One hop around the nodes whose names contain a term of the question: (query_id, source_id, type, target_id, rank).

    ``queries`` (query_id, document_id, query): each asks one document. Seeds are the first ``node_limit`` by
    id; edges on either end count once, at most ``relation_limit``, in the order of seed, type, neighbour.
    """
    asked = queries.select("query_id", "document_id", X.query_terms(F.col("query")).alias("terms"))
    names = [c for c in ("normalized_name", "name", "title", "description") if c in nodes.columns]
    hit = lambda t: F.lit(False)
    for c in names:
        hit = (lambda prev, c: lambda t: prev(t) | F.contains(F.lower(F.coalesce(c, F.lit(""))), t))(hit, c)
    seeds = nodes.where(F.col("label").isin(*SEED_LABELS)).join(asked, "document_id").where(F.exists("terms", hit))
    seeds = seeds.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("graph_id"))).where(F.col("_k") <= node_limit).select("query_id", "document_id", F.col("graph_id").alias("seed"))
    ends = F.array(*(F.struct(F.col(a).alias("seed"), F.col(b).alias("other")) for a, b in (("source_id", "target_id"), ("target_id", "source_id"))))
    e = edges.select("document_id", "source_id", "type", "target_id", F.inline(ends))
    met = seeds.join(e, ["document_id", "seed"]).groupBy("query_id", "source_id", "type", "target_id").agg(F.min(F.struct("seed", "type", "other")).alias("o"))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o.seed", "o.type", "o.other", "source_id", "target_id")))
    return ranked.where(F.col("rank") <= relation_limit).select("query_id", "source_id", "type", "target_id", "rank")


def typed_relations(nodes: DataFrame, edges: DataFrame, label: str, types: tuple[str, ...], name: str | None = None, cursor: int = 0, limit: int = 100) -> DataFrame:
    """A page of edges of the given types between nodes of one label, optionally with a name on either end."""
    n = nodes.where(F.col("label") == label)
    a = n.select("document_id", F.col("graph_id").alias("source_id"), F.col("name").alias("source_name"), F.col("normalized_name").alias("_s"))
    b = n.select("document_id", F.col("graph_id").alias("target_id"), F.col("name").alias("target_name"), F.col("normalized_name").alias("_t"))
    rows = edges.where(F.col("type").isin(*types)).join(a, ["document_id", "source_id"]).join(b, ["document_id", "target_id"])
    if name is not None:
        wanted = F.lit(name.strip().casefold())
        rows = rows.where((F.col("_s") == wanted) | (F.col("_t") == wanted))
    page = rows.select("document_id", "source_id", "type", "target_id", "source_name", "target_name").orderBy("document_id", "type", "source_id", "target_id")
    return page.offset(cursor).limit(limit)


def knowledge_dependencies(nodes: DataFrame, edges: DataFrame, name: str | None = None, cursor: int = 0, limit: int = 100) -> DataFrame:
    """A page of what knowledge points depend on."""
    return typed_relations(nodes, edges, "KnowledgePoint", KNOWLEDGE_TYPES, name, cursor, limit)


def person_relations(nodes: DataFrame, edges: DataFrame, name: str | None = None, cursor: int = 0, limit: int = 100) -> DataFrame:
    """A page of relations between persons."""
    return typed_relations(nodes, edges, "Person", ("RELATED_TO",), name, cursor, limit)


def shared_entities(nodes: DataFrame, documents: list[str] | None = None, namespace: str = "default", limit: int | None = None) -> DataFrame:
    """Names that two or more documents have: canonical_id, label, normalized_name, name, documents, members."""
    rows = nodes if documents is None else nodes.where(F.col("document_id").isin(documents))
    grouped = rows.groupBy("label", "normalized_name").agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("members"), F.min("name").alias("name")).where("documents >= 2")
    out = grouped.select(X.canonical_id(F.col("label"), F.col("normalized_name"), namespace).alias("canonical_id"), "label", "normalized_name", "name", "documents", "members")
    return out if limit is None else out.orderBy(F.desc("documents"), "label", "normalized_name").limit(limit)


def chapters(chunks: DataFrame) -> DataFrame:
    """Every beginning of a heading path as a chapter: (document_id, path, title, level, parent, ord, chunk_ids of those deepest there).

    ``chunks`` (document_id, chunk_id, chunk_index, heading_path ARRAY). Order is that of first sight.
    """
    depth = F.sequence(F.lit(1), F.size("heading_path"))
    rows = chunks.where(F.size("heading_path") > 0).select("document_id", "chunk_id", "chunk_index", "heading_path", F.explode(depth).alias("level"))
    rows = rows.withColumn("path", F.array_join(F.slice("heading_path", F.lit(1), F.col("level")), " > "))
    rows = rows.withColumn("own", F.when(F.col("level") == F.size("heading_path"), F.struct("chunk_index", "chunk_id")))
    out = rows.groupBy("document_id", "path").agg(
        F.min(F.element_at("heading_path", F.col("level"))).alias("title"),
        F.min("level").alias("level"),
        F.min("chunk_index").alias("_first"),
        F.min(F.array_join(F.slice("heading_path", F.lit(1), F.col("level") - 1), " > ")).alias("_parent"),
        F.array_join(F.transform(F.array_sort(F.collect_list("own")), lambda x: x["chunk_id"]), ",").alias("chunk_ids"),
    )
    ord_ = F.row_number().over(Window.partitionBy("document_id").orderBy("_first", "level", "path")) - 1
    return out.select("document_id", "path", "title", "level", F.nullif(F.col("_parent"), F.lit("")).alias("parent"), ord_.alias("ord"), "chunk_ids")


def heading_path(value: Column) -> Column:
    """'A > B', 'A / B' or 'A » B' as its parts."""
    return F.filter(F.transform(F.split(value, "[>/»]"), X.strip), lambda x: F.length(x) > 0)


def delete_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What deleting each document would remove: document_id, nodes, edges."""
    n = nodes.groupBy("document_id").agg(F.countDistinct("graph_id").alias("nodes"))
    e = edges.groupBy("document_id").agg(F.countDistinct("source_id", "type", "target_id").alias("edges"))
    return n.join(e, "document_id", "full_outer").select("document_id", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("edges", F.lit(0)).alias("edges"))


def page(rows: DataFrame, order: list[str], cursor: int = 0, limit: int = 100) -> DataFrame:
    """One page and one row more if there is a next page."""
    if not 1 <= limit <= 500 or cursor < 0:
        raise ValueError("limit must be 1 to 500, cursor 0 or more")
    return rows.orderBy(*order).offset(cursor).limit(limit + 1)


def recovered(state: DataFrame, builds: DataFrame) -> DataFrame:
    """Interrupted builds: 'building' is ready where the store has that build, else failed."""
    b = builds.select("document_id", F.col("build_id").alias("_stored"))
    ok = F.col("_stored") == F.col("build_id")
    new = F.when(F.col("status") != "building", F.col("status")).when(ok, "ready").otherwise("failed")
    return state.join(b, "document_id", "left").withColumn("status", new).drop("_stored")


def normalized_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chunks fit for extraction (document_id, chunk_id, chunk_index, content), and what is wrong with others.

    ``chunks`` (document_id, chunk_id, content, owner, chunk_index): blank ids and contents fall out; a chunk
    whose ``owner`` is another document, or whose id stands twice in one, is a problem.
    """
    rows = chunks.withColumn("chunk_id", X.strip(F.coalesce("chunk_id", F.lit("")))).where((F.col("chunk_id") != "") & (X.strip(F.coalesce("content", F.lit(""))) != ""))
    often = rows.groupBy("document_id", "chunk_id").agg(F.count("*").alias("_n"))
    why = F.when(F.coalesce(F.col("owner") != F.col("document_id"), F.lit(False)), "belongs to another document").when(F.col("_n") > 1, "duplicate chunk_id")
    marked = rows.join(often, ["document_id", "chunk_id"]).withColumn("problem", why)
    good = marked.where("problem IS NULL").select("document_id", "chunk_id", F.coalesce("chunk_index", F.lit(0)).alias("chunk_index"), "content")
    return good, marked.where("problem IS NOT NULL").select("document_id", "chunk_id", "problem").distinct()


def replace_graph(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, documents: DataFrame, namespace: str = "default") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes and edges after the graphs of ``documents`` (document_id) are replaced; canonical entities after it; those that no node names any more.

    Only edges with both ends among the document's new nodes are written. A document in ``documents`` without
    new nodes loses its graph. Canonical entities are what the nodes that are left name.
    """
    ends = new_nodes.select("document_id", "graph_id")
    closed = new_edges.join(ends.withColumnRenamed("graph_id", "source_id"), ["document_id", "source_id"], "left_semi").join(ends.withColumnRenamed("graph_id", "target_id"), ["document_id", "target_id"], "left_semi")
    after = nodes.join(documents, "document_id", "left_anti").unionByName(new_nodes.join(documents, "document_id", "left_semi"), allowMissingColumns=True)
    linked = edges.join(documents, "document_id", "left_anti").unionByName(closed.join(documents, "document_id", "left_semi"), allowMissingColumns=True)
    key = X.canonical_id(F.col("label"), F.col("normalized_name"), namespace).alias("canonical_id")
    canonical = after.groupBy("label", "normalized_name").agg(F.countDistinct("document_id").alias("documents")).select(key, "label", "normalized_name", "documents")
    orphans = nodes.select(key, "label", "normalized_name").distinct().join(canonical.select("canonical_id"), "canonical_id", "left_anti")
    return after, linked, canonical, orphans


def status(documents: DataFrame, state: DataFrame) -> DataFrame:
    """Each document's build: its state ('pending' if none is known), counters from 0, and success unless it failed or waits for a cleanup."""
    s = state.select("document_id", "status", "build_id", "attempt_count", "llm_attempt_count")
    now = F.coalesce("status", F.lit("pending"))
    counters = [F.coalesce(c, F.lit(0)).alias(c) for c in ("attempt_count", "llm_attempt_count")]
    return documents.select("document_id").join(s, "document_id", "left").select("document_id", now.alias("status"), (~now.isin("failed", "cleanup_pending")).alias("success"), "build_id", *counters)


def by_status(state: DataFrame, wanted: str) -> DataFrame:
    return state.where(F.col("status") == wanted).orderBy("document_id")


def deleted(state: DataFrame, documents: DataFrame, failed: DataFrame) -> DataFrame:
    """States after the graphs of ``documents`` were to go: 'deleted', or 'cleanup_pending' for those in ``failed``."""
    d = documents.select("document_id", F.lit(True).alias("_d")).distinct()
    f = failed.select("document_id", F.lit(True).alias("_f")).distinct()
    new = F.when(F.col("_f"), "cleanup_pending").when(F.col("_d"), "deleted").otherwise(F.col("status"))
    return state.join(d, "document_id", "left").join(f, "document_id", "left").withColumn("status", F.when(F.col("_d"), new).otherwise(F.col("status"))).drop("_d", "_f")
