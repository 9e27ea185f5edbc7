"""Each operator as a query over whole driver tables. Scores are rounded to 6 digits, ties go by id, time is a literal."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.functions import vectors as V
from docweave.operators import cache as K
from docweave.operators import chunks as C
from docweave.operators import context as A
from docweave.operators import cross_document as D
from docweave.operators import evaluation as E
from docweave.operators import extraction as N
from docweave.operators import graph as G
from docweave.operators import history as H
from docweave.operators import imports as T
from docweave.operators import memory as M
from docweave.operators import payload as Y
from docweave.operators import points as P
from docweave.operators import retrieval as R
from docweave.operators.lexical import best_by_words
from docweave.plans import answers, loading
from docweave.plans.background import Background
from docweave.sources import library as L
from docweave.sources import format as document_format
from docweave.sources import scan, snapshots, vector_index
from docweave.sources.tables import scratch, spread
from docweave.streaming import tasks as S

AS_OF = "2024-01-31 00:00:00"
DIGITS = 6
_registered: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _registered[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_registered)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "conversations") else rows


def _windows(spark, d):
    return C.chunk_documents(_t(spark, d, "documents"), profile="windows")


def _asked(spark, d) -> DataFrame:
    """The query set of searches: benchmark texts whose id is divisible by 20."""
    return _t(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _points(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


def _vector_queries(spark, d) -> DataFrame:
    return _points(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))


def _memories(spark, d) -> DataFrame:
    """Events as memories: importance from the value, session from the type."""
    e = _t(spark, d, "events")
    return e.select(
        F.col("event_id").alias("memory_id"), "user_id", F.col("event_type").alias("session_id"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.round(F.least(F.lit(1.0), F.col("value") / 100), 4).alias("importance"), F.concat_ws(" ", "event_type", "props").alias("content"),
        F.when(F.col("event_type").isin("view", "click"), "working").when(F.col("event_type").isin("purchase", "signup"), "episodic").otherwise("semantic").alias("memory_type"),
    )


def _turns(spark, d) -> DataFrame:
    """Conversation turns as memories an hour at most before AS_OF."""
    c = _t(spark, d, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("memory_id"), F.col("conv_id").alias("user_id"), F.col("role").alias("session_id"), F.col("text").alias("content"),
        F.timestamp_add("SECOND", -(F.col("conv_id") * 37 + F.col("turn") * 11) % 5400, F.lit(AS_OF).cast("timestamp_ntz")).alias("ts"),
        (F.lit(0.3) + (F.col("turn") % 7) / 10).alias("importance"),
    )


def _remembered(spark, d) -> DataFrame:
    return _turns(spark, d).withColumn("seq", F.col("memory_id")).withColumn("vector", V.hash_embedding(F.col("content")))


def _remembered_asked(spark, d) -> DataFrame:
    return _asked(spark, d).withColumn("query_vector", V.hash_embedding(F.col("query")))


@query
def chunk_windows(spark, d):
    return _windows(spark, d).select("document_id", "chunk_index", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("digest"))


@query
def chunk_paragraphs(spark, d):
    return C.chunk_documents(_t(spark, d, "documents")).select("document_id", "chunk_index", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("digest"))


@query
def content_digest_dupes(spark, d):
    return _t(spark, d, "documents").groupBy(X.digest(F.col("text")).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query
def preview_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query
def approx_token_len(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.approximate_tokens(F.col("text")).alias("tokens"))


@query
def graph_query_terms(spark, d):
    return _t(spark, d, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


@query
def qa_mode_route(spark, d):
    marked = F.concat("text", F.when(F.col("item_id") % 3 == 0, " 请对比并总结").when(F.col("item_id") % 3 == 1, " 总结").otherwise(""))
    return _t(spark, d, "benchmark").select("item_id", X.qa_mode(marked).alias("mode"))


@query
def lexical_overlap_topk(spark, d):
    rows = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return best_by_words(rows, _asked(spark, d), 5, X.lexical_tokens, digits=DIGITS)


@query
def vector_topk(spark, d):
    return P.nearest(_points(spark, d), _vector_queries(spark, d), 5, digits=DIGITS)


@query
def vector_topk_indexed(spark, d):
    """The same from a stored index of clusters."""
    path = f"{scratch(spark)}/index"
    vector_index.build(_points(spark, d), path)
    return vector_index.search(spark, path, _vector_queries(spark, d), 5, digits=DIGITS)[0]


@query
def vector_threshold_indexed(spark, d):
    path = f"{scratch(spark)}/index"
    vector_index.build(_points(spark, d), path)
    return vector_index.search(spark, path, _vector_queries(spark, d), 20, {"label": [1, 3, 5]}, 0.25, DIGITS)[0]


@query
def vector_topk_filtered_in(spark, d):
    return P.nearest(_points(spark, d), _vector_queries(spark, d), 5, {"label": [1, 3, 5]}, digits=DIGITS)


@query
def vector_threshold(spark, d):
    return P.nearest(_points(spark, d), _vector_queries(spark, d), 20, threshold=0.25, digits=DIGITS)


@query
def payload_range_filter(spark, d):
    import datetime as dt

    wanted = {"importance": P.Range(gte=0.5, lt=0.9), "ts": P.Range(gte=dt.datetime(2024, 1, 10), lte=dt.datetime(2024, 1, 20)), "session_id": ["view", "click"]}
    return P.scroll(_memories(spark, d).withColumnRenamed("memory_id", "id"), wanted, ["user_id", "session_id", "importance"])


@query
def scroll_projection(spark, d):
    return P.scroll(_points(spark, d), {"label": 2}, ["label", "nothing"])


@query
def delete_by_filter(spark, d):
    return P.delete(_points(spark, d), {"label": P.Range(gte=5)}).groupBy("label").agg(F.count("*").alias("points"))


@query
def collection_stats(spark, d):
    return _points(spark, d).agg(F.count("*").alias("points"), F.countDistinct("label").alias("labels"), F.max(F.size("vector")).alias("dimension"))


@query
def point_upsert(spark, d):
    old = _t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "value")
    return C.upsert_points(old.where("event_id % 2 = 0"), old.where("event_id % 2 = 1")).select("id", "seq", "value")


@query
def hash_embedding_components(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(V.hash_embedding(F.col("text"))).alias("idx", "value"))
    return rows.where("value <> 0").select("doc_id", "idx", F.round("value", DIGITS).alias("value"))


@query
def vector_dimension_fit(spark, d):
    return _points(spark, d).select("id", F.round(F.aggregate(V.fitted(F.col("vector"), 48), F.lit(0.0), lambda a, x: a + x), DIGITS).alias("total"), F.size(V.fitted(F.col("vector"), 100)).alias("padded"))


def _pool(spark, d) -> DataFrame:
    """The 15 documents nearest to each question by hash embeddings of whole texts, with their contents."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), V.hash_embedding(F.col("text")).alias("vector"), F.col("text").alias("content"))
    return P.nearest(docs, _asked(spark, d).withColumn("query_vector", V.hash_embedding(F.col("query"))), 15, digits=DIGITS, payload=["content"])


@query
def hybrid_rank(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return R.hybrid_rank(_pool(spark, d).drop("content"), docs, _asked(spark, d), 15, digits=DIGITS)


@query
def mmr_select(spark, d):
    return R.mmr(_pool(spark, d), 5).select("query_id", "rank", "id")


@query
def source_dedupe(spark, d):
    """Each source's documents as the ranked hits of one question."""
    docs = _t(spark, d, "documents")
    rows = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.col("lang").alias("document_id"), F.lit(" 3 ").alias("page_number"), F.col("text").alias("content"), "doc_id")
    return R.dedupe_sources(rows).select("doc_id", "rank")


def _searchable(spark, d) -> tuple[DataFrame, DataFrame]:
    """Chunks of all documents and the benchmark's questions, with hash embeddings."""
    rows = C.chunk_documents(_t(spark, d, "documents")).withColumn("vector", V.hash_embedding(F.col("content"))).withColumn("page_number", F.lit(None).cast("string"))
    rows = rows.withColumn("seq", F.col("document_id").cast("long") * 100_000 + F.col("chunk_index"))
    return rows, _asked(spark, d).withColumn("query_vector", V.hash_embedding(F.col("query")))


def _digests(prompts: list[str]) -> list[str]:
    """Stands for a generator of answers."""
    return [hashlib.sha256(p.encode()).hexdigest() for p in prompts]


@query
def document_search(spark, d):
    """Benchmark questions over all chunks: embeddings, vector pool, source dedupe, citations."""
    rows, asked = _searchable(spark, d)
    return R.search(rows, asked, 5, digits=DIGITS).select("query_id", "rank", F.col("id").alias("chunk_id"), "score", "citation_id")


@query
def joint_answer(spark, d):
    """Benchmark questions asked whole: search, the sources that fit, prompt and cited answer, which is the prompt's digest."""
    rows, asked = _searchable(spark, d)
    told = answers.ask(rows, asked, _digests, window=4000, digits=DIGITS)
    return told.select("query_id", "answer", F.array_join("sources", ",").alias("sources"), "truncated")


@query
def citation_list(spark, d):
    """What a search finds as citations to copy."""
    rows, asked = _searchable(spark, d)
    found = R.search(rows, asked, 5, digits=DIGITS).withColumn("file_name", F.when(F.col("document_id").cast("long") % 2 == 0, F.concat("document_id", F.lit(".md"))))
    both = [A.citation_text(found, asked, style).withColumn("style", F.lit(style)) for style in ("normal", "markdown")]
    return both[0].unionByName(both[1])


@query
def document_summaries(spark, d):
    """One summary of each document for each question, the digest of its prompt."""
    chunks = C.chunk_documents(_t(spark, d, "documents")).withColumn("page_number", F.lit(None).cast("string"))
    return answers.summarise(chunks, _asked(spark, d), _digests)[0].drop("key")


@query
def citation_ids(spark, d):
    page = X.page_number(F.lit(" 7 "))
    return _t(spark, d, "documents").select("doc_id", X.source_citation(F.col("doc_id").cast("string"), page, X.digest(F.col("text"))).alias("citation_id"), X.graph_citation(F.col("doc_id").cast("string"), F.lit("entity"), F.col("source")).alias("graph_citation_id"))


@query
def rag_stats(spark, d):
    return C.stats(_windows(spark, d))


@query
def summary_sample_even(spark, d):
    return C.sample_evenly(_windows(spark, d), ["document_id"], ["chunk_index"], 4).select("document_id", "chunk_index")


@query
def summary_by_page(spark, d):
    rows = _windows(spark, d).withColumn("page_number", F.when(F.col("chunk_index") % 5 != 4, (F.col("chunk_index") / 2).cast("int").cast("string")))
    return C.summary_by_page(rows, 6).select("document_id", "page", "chunk_index")


@query
def chunk_append_index(spark, d):
    rows = _windows(spark, d)
    return C.append_chunks(rows.where("chunk_index < 2"), rows.where("chunk_index < 1"), "max").select("document_id", "chunk_index", "chunk_id")


@query
def document_replace(spark, d):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    rows = _windows(spark, d)
    old = rows.select("*", stamp.alias("created_at"), stamp.alias("updated_at"), F.lit(1).alias("document_version"))
    out = C.replace_documents(old, rows.where("chunk_index < 1 AND document_id LIKE '%7'"), AS_OF)
    return out.groupBy("document_version", "created_at", "updated_at").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


@query
def graph_chunk_batches(spark, d):
    cut = F.posexplode(X.disjoint_windows(F.col("text"), 1500)).alias("position", "content")
    return C.batches(_t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), cut))


@query
def working_tfidf_rank(spark, d):
    asked = _asked(spark, d)
    scored = M.tfidf(_turns(spark, d), asked).withColumnRenamed("tfidf", "score")
    return M._top(scored, 5, DIGITS).select("query_id", "rank", "memory_id", "score")


@query
def working_retrieve(spark, d):
    return M.working_retrieve(_turns(spark, d), _asked(spark, d), AS_OF, 5, digits=DIGITS).select("query_id", "rank", "memory_id", "score")


@query
def working_ttl(spark, d):
    return M.live(_turns(spark, d), AS_OF).select("memory_id", "user_id")


@query
def working_capacity_keep(spark, d):
    return M.evict(_memories(spark, d), AS_OF, 20, 20000).select("memory_id", "user_id")


def _forget(kind, strategy, **options):
    def run(spark, d):
        rows = _memories(spark, d).where(F.col("memory_type") == kind)
        return M.forget(rows, strategy, AS_OF, kind, **options).select("memory_id", "user_id")

    run.__name__ = f"{kind}_forget_{strategy.split('_')[0]}"
    return query(run)


_forget("working", "importance_based", threshold=0.4)
_forget("working", "time_based", max_age_days=12)
_forget("working", "capacity_based", capacity=10)
_forget("episodic", "capacity_based", threshold=0.6)
_forget("semantic", "time_based", max_age_days=1)


@query
def memory_forget_all(spark, d):
    return M.forget_all(_memories(spark, d), "capacity_based", AS_OF, threshold=0.6, capacity=10)[0].select("memory_id", "memory_type")


@query
def memory_forgotten(spark, d):
    rows = _memories(spark, d)
    by_age = M.forget_all(rows, "time_based", AS_OF, max_age_days=12)[1].withColumn("strategy", F.lit("age"))
    return by_age.unionByName(M.forget_all(rows, "importance_based", AS_OF, threshold=0.4)[1].withColumn("strategy", F.lit("importance")))


@query
def episodic_rank(spark, d):
    near = P.nearest(_points(spark, d), _vector_queries(spark, d), 20, digits=DIGITS).select("query_id", F.col("id").alias("memory_id"), F.col("score").alias("vector_score"))
    pool = near.join(_memories(spark, d).select("memory_id", "importance", "ts"), "memory_id")
    return M.episodic_rank(pool, AS_OF, 5, DIGITS).select("query_id", "rank", "memory_id", "score")


@query
def episodic_retrieve(spark, d):
    """Questions that each ask for other users, sessions, importances and times; some users' memories have no vectors."""
    e = _memories(spark, d)
    vectors = _t(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").alias("vector"))
    memories = e.join(vectors, "memory_id", "left").withColumn("vector", F.when(F.col("user_id") % 4 != 3, F.col("vector")))
    n = F.col("memory_id")
    asked = e.join(vectors, "memory_id").where("memory_id % 20 = 0").select(
        n.alias("query_id"), F.col("session_id").alias("query"), F.col("vector").alias("query_vector"), F.when(n % 60 != 0, F.col("user_id")).alias("user_id"), F.when(n % 40 == 0, F.col("session_id")).alias("session_id"),
        (n % 100 / 200).alias("min_importance"), F.when(n % 80 == 0, F.col("ts") - F.expr("INTERVAL 5 DAYS")).alias("start"), F.when(n % 160 == 0, F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("end"),
    )
    return M.episodic_retrieve(memories, asked, AS_OF, 5, DIGITS)


@query
def episodic_time_range(spark, d):
    return M.episodic_filter(_memories(spark, d), session="purchase", min_importance=0.3, start="2024-01-05 00:00:00", end="2024-01-12 23:59:59").select("memory_id", "user_id", "importance")


@query
def episodic_keyword_fallback(spark, d):
    """The turns that hold the question 'the de' as words or as a substring."""
    score = M.term_score(F.lit("the de"), F.col("content"))
    return _turns(spark, d).select("memory_id", F.round(score, DIGITS).alias("score")).where("score > 0")


@query
def semantic_fuse(spark, d):
    """Turns near a question by their vectors, and turns that share its words."""
    turns, asked = _remembered(spark, d), _remembered_asked(spark, d)
    near = P.nearest(turns.withColumnRenamed("memory_id", "id"), asked, 10, digits=DIGITS, payload=["importance"])
    vector = near.select("query_id", F.col("id").alias("memory_id"), "importance", F.col("score").alias("vector_score"))
    words = M.keyword_search(turns, asked, 10, digits=DIGITS).select("query_id", "memory_id", "importance", F.col("score").alias("graph_score"))
    return M.semantic_fuse(vector, words, 8, DIGITS).select("query_id", "rank", "memory_id", "score")


@query
def semantic_keyword_search(spark, d):
    return M.keyword_search(_turns(spark, d), _asked(spark, d), 10, 0.5, DIGITS).select("query_id", "rank", "memory_id", "score")


@query
def semantic_retrieve(spark, d):
    return M.semantic_retrieve(_remembered(spark, d), _remembered_asked(spark, d), 5, min_importance=0.8, digits=DIGITS)


@query
def semantic_add(spark, d):
    points, _, _ = M.semantic_add(_turns(spark, d))
    return points.select("memory_id", F.array_join("entities", " ").alias("entities"), "entity_count", "relation_count", F.size("vector").alias("dimension"))


def _best_of_types(spark, d) -> DataFrame:
    parts = []
    for kind in ("working", "episodic", "semantic"):
        own = Window.partitionBy("user_id").orderBy(F.desc("ts"), "memory_id")
        rows = _memories(spark, d).where(F.col("memory_type") == kind).withColumn("rank", F.row_number().over(own)).where("rank <= 5")
        parts.append(rows.withColumnRenamed("user_id", "query_id"))
    return M.union_rank(parts, 5).select("query_id", "rank", "memory_id", "importance")


@query
def memory_union_rank(spark, d):
    return _best_of_types(spark, d)


@query
def memory_found_text(spark, d):
    """Each user's best memories as text, and some users who have none."""
    rows = _memories(spark, d)
    found = _best_of_types(spark, d).join(rows.select("memory_id", "memory_type", "content"), "memory_id")
    users = rows.select("user_id").distinct()
    users = users.unionByName(users.where("user_id % 10 = 0").select((F.col("user_id") + 1_000_000).alias("user_id")))
    return M.found_text(found, users.select(F.col("user_id").alias("query_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query")))


@query
def memory_consolidate(spark, d):
    return M.consolidate(_memories(spark, d)).groupBy("memory_type", "consolidated_from").agg(F.count("*").alias("memories"), F.round(F.avg("importance"), DIGITS).alias("importance"))


@query
def memory_classify(spark, d):
    none = F.lit(None).cast("string")
    kind = M.classify(F.col("text"), F.when(F.col("turn") % 11 == 0, "image"), F.when(F.col("turn") % 5 == 0, "chat"), none, F.when(F.col("turn") % 3 == 0, "fact"))
    return _t(spark, d, "conversations").select("conv_id", "turn", kind.alias("memory_type"))


@query
def memory_stats(spark, d):
    return M.stats(_memories(spark, d))


@query
def infer_modality(spark, d):
    endings = F.array(*map(F.lit, [".PNG", ".mp3", ".mov", ".md", ".bin", ""]))
    path = F.concat("source", F.element_at(endings, (F.col("doc_id") % 6 + 1).cast("int")))
    return _t(spark, d, "documents").select("doc_id", X.modality(path).alias("modality"))


@query
def timestamp_canonical(spark, d):
    ts = F.col("ts").cast("timestamp_ntz")
    spelled = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).when(F.col("event_id") % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy/MM/dd")).otherwise("never")
    return _t(spark, d, "events").select("event_id", X.timestamp(spelled, F.lit(AS_OF).cast("timestamp_ntz")).alias("ts"))


def _entities(spark, d):
    return G.rule_entities(_t(spark, d, "documents"))


def _graph(spark, d):
    e = _entities(spark, d)
    return G.concept_nodes(e), G.concept_edges(G.rule_relations(e))


@query
def graph_entities(spark, d):
    return _entities(spark, d)


@query
def graph_relations(spark, d):
    return G.rule_relations(_entities(spark, d)).select("document_id", "position", "source", "target")


@query
def graph_nodes(spark, d):
    return G.concept_nodes(_entities(spark, d)).select("document_id", "graph_id", "normalized_name", "ord")


@query
def graph_edge_dedupe(spark, d):
    return G.dedupe_edges(_graph(spark, d)[1]).groupBy("document_id").agg(F.count("*").alias("edges"), F.min("source_id").alias("least_source"))


@query
def graph_cross_document_entities(spark, d):
    return G.shared_entities(_graph(spark, d)[0]).select("canonical_id", "normalized_name", "documents", "members")


@query
def graph_one_hop_context(spark, d):
    nodes, edges = _graph(spark, d)
    asked = _t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("the que ber").alias("query"))
    return G.context(nodes, edges, asked, 4, 6)


@query
def graph_context_lines(spark, d):
    """One-hop contexts of all documents as lines of a prompt, as far as they fit."""
    asked = _t(spark, d, "documents").select(F.col("doc_id").alias("query_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("the que ber").alias("query"))
    return answers.graph_lines(*_graph(spark, d), asked, 200).select("query_id", "position", "line")


@query
def graph_typed_relations_page(spark, d):
    nodes, edges = _graph(spark, d)
    return G.typed_relations(nodes, G.dedupe_edges(edges), "Concept", G.CONCEPT_TYPES, cursor=10, limit=50).select("document_id", "source_id", "target_id", "source_name", "target_name")


@query
def graph_chapter_tree(spark, d):
    part = F.concat(F.lit("Part "), (F.col("chunk_index") / 4).cast("int"))
    section = F.concat(F.lit("Section "), (F.col("chunk_index") / 2).cast("int"))
    path = F.when(F.col("chunk_index") % 7 == 6, F.concat(part, F.lit(" / "))).otherwise(F.concat(part, F.lit(" > "), section))
    rows = _windows(spark, d).withColumn("heading_path", G.heading_path(path))
    return G.chapters(rows).select("document_id", "path", "level", "parent", "ord", "chunk_ids")


@query
def graph_delete_counts(spark, d):
    return G.delete_counts(*_graph(spark, d))


@query
def compare_candidates(spark, d):
    near = P.nearest(_points(spark, d), _vector_queries(spark, d), 60, digits=DIGITS)
    rows = near.join(_points(spark, d).select("id", F.col("label").alias("document_id")), "id")
    return A.compare_candidates(rows, 24).select("query_id", "document_id", "id", "protected")


def _sources(spark, d):
    """Each user's events as sources with distinct scores."""
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = _t(spark, d, "events").withColumn("rank", F.row_number().over(order))
    return e.select(F.col("user_id").alias("query_id"), "rank", (F.col("value") - F.col("rank") / 1000).alias("score"), F.repeat("event_type", (F.col("event_id") % 9).cast("int") + 1).alias("content"), (F.col("rank") == 3).alias("protected"), "event_id")


@query
def fit_context_drop(spark, d):
    return A.drop_to_fit(_sources(spark, d), 150).select("query_id", "rank", "event_id")


@query
def fit_context(spark, d):
    """All sources of a user, every third protected, so that they have to be cut; for some users not even the least fits."""
    return A.fit(_sources(spark, d).withColumn("protected", F.col("event_id") % 3 == 0), 300, least_chars=12)


@query
def fit_summaries(spark, d):
    """The turns of a conversation as summaries that share a budget; none falls out."""
    turns = _t(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("document_id"), F.concat(F.lit("["), "role", F.lit("] ")).alias("head"), F.col("text").alias("content"))
    cut = A.fit_summaries(turns, 900)
    return cut.select("query_id", "document_id", F.length("content").alias("kept"), F.sha2("content", 256).alias("digest"), "truncated", "fits")


@query
def summary_cache(spark, d):
    """Summaries of documents put into a cache one source after the other, some again under their old key."""
    docs = _t(spark, d, "documents").withColumn("order", F.col("doc_id"))
    key = K.summary_key(F.lit("default"), F.col("lang"), F.lit("q"), F.lit(12), F.array(F.col("doc_id")), F.lit("off"), F.lit(None).cast("string"))
    entries = docs.select(key.alias("key"), F.col("doc_id").cast("string").alias("summary"), "order", "doc_id")
    cache = spark.createDataFrame([], K.ENTRIES)
    for k in range(3):
        part = entries.where(F.col("doc_id") % 3 <= k).withColumn("summary", F.concat(F.lit(f"{k}-"), "summary"))
        cache = K.put(cache, part, "order")
    return cache.select("key", "summary")


@query
def graph_lines_fit(spark, d):
    rows = _sources(spark, d).select("query_id", F.col("rank").alias("position"), F.col("content").alias("line"))
    return A.lines_that_fit(rows, 120).select("query_id", "position", "used")


@query
def comparison_validate(spark, d):
    answer = F.concat(
        F.lit('```json\n{"common_points":[{"text":"both","citations":["S-'), F.col("item_id") % 3, F.lit('"]}],"differences":[{"topic":"t","documents":[{"document_id":"doc-'), F.col("item_id") % 4,
        F.lit('","text":"x","citations":[]}]}],"per_document_evidence":[],"missing_information":'), F.when(F.col("item_id") % 5 == 0, "null").otherwise("[]"), F.lit("}\n```"),
    )
    rows = _t(spark, d, "benchmark").select("item_id", answer.alias("answer"), F.array(F.lit("S-0"), F.lit("S-1")).alias("allowed"), F.array(F.lit("doc-0"), F.lit("doc-1"), F.lit("doc-2")).alias("selected"))
    return A.valid_comparisons(rows).select("item_id", "valid")


def _tasks(spark, d):
    """Events as import tasks."""
    e = _t(spark, d, "events")
    status = F.element_at(F.array(*map(F.lit, T.STATUSES)), (F.col("event_id") % 6 + 1).cast("int"))
    null_ts = F.lit(None).cast("timestamp_ntz")
    return e.select(
        F.col("event_id").alias("task_id"), F.floor(F.col("event_id") / 8).alias("batch_id"), "user_id", status.alias("status"),
        F.when(F.col("event_id") % 4 == 1, "committing").otherwise("embedding").alias("stage"), F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.when(F.col("event_id") % 6 == 2, F.timestamp_add("HOUR", F.lit(5), F.col("ts").cast("timestamp_ntz"))).otherwise(null_ts).alias("next_attempt_at"), null_ts.alias("cancel_requested_at"),
        (F.col("event_id") % 5).cast("int").alias("auto_retry_count"), F.lit(3).alias("max_auto_retries"), F.lit(0).alias("manual_retry_count"), F.lit(None).cast("string").alias("error_code"), F.lit(None).cast("string").alias("error_summary"),
    )


@query
def import_batch_summary(spark, d):
    tasks = _tasks(spark, d)
    batches = tasks.select("batch_id", "user_id").distinct()
    return T.batch_summary(batches, tasks)


@query
def import_claim_next(spark, d):
    """Users with running tasks are those whose id is divisible by 3; the others' have succeeded."""
    over = (F.col("status") == "running") & (F.col("user_id") % 3 > 0)
    tasks = _tasks(spark, d).withColumn("status", F.when(over, "succeeded").otherwise(F.col("status")))
    return T.claimable(tasks, "2024-01-20 00:00:00", blocked=[1, 2], limit=20).select("task_id", "user_id", "status")


@query
def import_cancel_outcome(spark, d):
    return _tasks(spark, d).select("task_id", T.cancel_outcome().alias("outcome"))


@query
def import_retry_backoff(spark, d):
    tasks = _tasks(spark, d)
    failures = tasks.where("task_id % 2 = 1").select("task_id", F.lit("rag_connection").alias("error_code"), (F.col("task_id") % 7 != 0).alias("retryable"), F.lit("reset").alias("summary"))
    return T.record_failure(tasks, failures, AS_OF).select("task_id", "status", "auto_retry_count", "next_attempt_at", "error_code")


@query
def import_batch_limits(spark, d):
    files = _t(spark, d, "documents").select(F.floor(F.col("doc_id") / 15).alias("batch_id"), F.concat("source", F.when(F.col("doc_id") % 97 == 5, ".exe").otherwise(".md")).alias("original_name"), (F.col("n_chars") * 4096).alias("size_bytes"))
    return T.batch_problems(files)


@query
def import_progress_monotone(spark, d):
    stages = F.array(*map(F.lit, [*T.STAGE_RANGES, "unknown"]))
    e = _t(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("position"), F.element_at(stages, (F.col("event_id") % 6 + 1).cast("int")).alias("stage"), (F.col("event_id") % 10).alias("completed"), F.lit(8).alias("total"))
    return T.monotone_progress(e.where("position % 50 <> 4 OR stage <> 'committing'")).select("task_id", "position", "progress")


def _records(spark, d):
    e = _t(spark, d, "events")
    return e.select("user_id", (F.col("event_id") % 13).cast("string").alias("document_id"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 3 > 0, F.col("ts").cast("timestamp_ntz")).alias("loaded_at"), F.col("event_type").alias("name"))


@query
def library_latest(spark, d):
    return H.library(_records(spark, d)).select("user_id", "document_id", "place", "name")


@query
def document_choices(spark, d):
    return H.latest(_records(spark, d), last=False).select("user_id", "document_id", "position")


@query
def history_delete_cascade(spark, d):
    docs = _records(spark, d)
    asked = docs.withColumn("document_ids", F.when(F.col("position") % 2 == 0, F.array(F.col("document_id"), (F.col("position") % 5).cast("string"))))
    left, kept = H.delete_cascade(docs, asked, "4")
    return left.agg(F.count("*").alias("rows")).withColumn("kind", F.lit("documents")).union(kept.agg(F.count("*").alias("rows")).withColumn("kind", F.lit("questions")))


@query
def history_recall(spark, d):
    c = _t(spark, d, "conversations").select("role", (F.col("conv_id") * 1000 + F.col("turn")).alias("position"), "text")
    docs = _t(spark, d, "documents").select(F.col("source").alias("document_name"), F.lit(None).cast("string").alias("document_path"), F.col("doc_id").alias("position"))
    questions = c.where("role = 'user'").select(F.col("text").alias("question"), F.lit("").alias("answer"), "position")
    notes = c.where("role = 'assistant'").select(F.lit("").alias("concept"), F.col("text").alias("note"), F.lit("").alias("content"), "position")
    return H.recall(docs, questions, notes, "c1", 30).union(H.recall(docs, questions, notes, "eau", 30)).select("kind", "position", "text")


@query
def report_recent(spark, d):
    return H.recent(_records(spark, d), 5).select("user_id", "position", "place")


@query
def session_expiry(spark, d):
    seen = _t(spark, d, "events").groupBy("user_id").agg(F.max(F.col("ts").cast("timestamp_ntz")).alias("last_access"))
    return H.expired(seen, "2024-01-30 22:00:00").select("user_id")


def _traces(spark, d) -> DataFrame:
    b = _t(spark, d, "benchmark")
    return b.select(
        F.concat(F.lit("case-"), "item_id").alias("case_id"), F.array(F.col("text"), F.lit("doc-1 the prompt")).alias("prompts"), F.concat(F.lit("doc-2 answer "), "text").alias("output"),
        F.array(F.lit("doc-1"), F.concat(F.lit("doc-"), F.col("item_id") % 4)).alias("required_document_ids"), F.array(F.lit("que")).alias("forbidden_document_ids"),
        F.array(F.lit("answer"), F.lit("er")).alias("required_answer_markers"), F.array(F.lit("the")).alias("required_prompt_markers"), (F.col("item_id") % 3 + 1).cast("int").alias("minimum_llm_calls"),
    )


@query
def golden_trace_eval(spark, d):
    return E.evaluate(_traces(spark, d)).select("case_id", "passed", F.array_join("failures", ";").alias("failures"))


@query
def golden_report(spark, d):
    return E.report(E.evaluate(_traces(spark, d)))


@query
def error_redaction(spark, d):
    kinds = [
        "GET https://me:pw@host/x?api_key=abc&x=1 failed", "Authorization: Bearer abc.def, retry", '{"password": "p w", "n": 1}', "token=zzz; ok",
        "auth=abc&passwd=def", r'{"client_secret": "a\"b c", "n": 2}', "db.password='it\\'s'; retry", "x_key:k1]", 'secret="never closed', "sent Bearer abc",
    ]
    message = F.concat(F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % len(kinds) + 1).cast("int")), F.lit(" #"), "event_id")
    return _t(spark, d, "events").select("event_id", X.redacted(message).alias("message"))


@query
def tool_call_parse(spark, d):
    text = F.concat(F.col("event_type"), F.lit(" [TOOL_CALL:search:query="), F.col("user_id"), F.lit("] then [TOOL_CALL:calculator:1+"), F.col("event_id"), F.lit("]"))
    return _t(spark, d, "events").select("event_id", F.posexplode(X.tool_calls(text)).alias("n", "c")).select("event_id", "n", "c.name", "c.arguments")


def _scoped(spark, d) -> DataFrame:
    """Points of documents (their label) in two namespaces."""
    return _points(spark, d).select("id", F.col("label").cast("string").alias("document_id"), F.concat(F.lit("ns"), F.col("id") % 2).alias("namespace"))


@query
def namespace_scope(spark, d):
    return _scoped(spark, d).where(P.in_scope(P.scope(document_ids=["1", " 3 ", "1"]), "ns1"))


@query
def namespace_remove(spark, d):
    left, removed = P.remove(_scoped(spark, d), ["1", "2"], "ns1")
    whole, _ = P.remove(_scoped(spark, d), namespace="ns0")
    kept = lambda rows, kind: rows.groupBy("namespace", "document_id").agg(F.count("*").alias("points")).select(F.lit(kind).alias("kind"), "namespace", "document_id", "points")
    return kept(left, "left").union(removed.select(F.lit("removed"), F.lit("ns1"), "document_id", "removed")).union(kept(whole, "cleared"))


@query
def document_ids(spark, d):
    return C.document_ids(_windows(spark, d))


@query
def ordered_chunks(spark, d):
    own = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    return C.ordered_chunks(_windows(spark, d)).select("document_id", "chunk_id", F.row_number().over(own).alias("place"))


@query
def points_of_arrays(spark, d):
    held = _points(spark, d).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("id", "vector"))).alias("x"))
    rows = held.select("label", F.transform("x", lambda x: F.when(x["id"] % 2 == 0, x["id"].cast("string"))).alias("ids"), F.transform("x", lambda x: x["vector"]).alias("vectors"), F.transform("x", lambda x: F.col("label")).alias("metadata"))
    return C.points_of_arrays(rows).select("id", F.round(F.element_at("vector", 1), DIGITS).alias("first"), "metadata")


@query
def cosine_neighbours(spark, d):
    a, b = _points(spark, d).select("id", "vector"), _points(spark, d).select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return a.join(b, "id").select("id", F.round(V.cosine(F.col("vector"), F.col("other")), DIGITS).alias("score"))


@query
def vector_dimension_strict(spark, d):
    return _points(spark, d).select("id", F.round(F.aggregate(V.fitted(F.col("vector"), 64, "error"), F.lit(0.0), lambda a, x: a + x), DIGITS).alias("total"))


@query
def segments_prepared(spark, d):
    """Documents as two pages each."""
    pages = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.posexplode(F.array(F.col("text"), F.concat(F.lit("note on "), "source"))).alias("segment_index", "content"))
    rows = C.prepare_segments(pages.withColumn("page_number", F.concat(F.lit(" "), F.col("segment_index") + 1)), "windows")
    return rows.select("document_id", "chunk_index", "chunk_id", "page_number", F.length("content").alias("n_chars"))


@query
def headed_paragraphs(spark, d):
    text = F.concat(F.lit("start\n# "), "source", F.lit("\none\ntwo\n\nthree\n## "), "lang", F.lit("\nfour\n# End\n"), F.col("doc_id").cast("string"))
    return _t(spark, d, "documents").select("doc_id", F.posexplode(X.headed_paragraphs(text)).alias("position", "p")).select("doc_id", "position", "p.content", "p.heading_path", "p.level")


@query
def label_ids(spark, d):
    label = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit(" | x | "), "doc_id", F.lit(" "))).otherwise(F.concat(F.lit(" "), "source"))
    return _t(spark, d, "documents").select("doc_id", X.label_id(label).alias("label_id"))


@query
def tool_arguments(spark, d):
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("kind= "), "event_type", F.lit(" ,user="), "user_id")).otherwise(F.concat(F.lit(" "), "event_type"))
    return _t(spark, d, "events").select("event_id", F.explode(X.tool_arguments(text)).alias("name", "value"))


@query
def redacted_urls(spark, d):
    url = F.concat(F.lit("https://me:pw@host/x?token="), "event_id", F.lit("&user="), "user_id", F.lit("&API_KEY=zz"))
    return _t(spark, d, "events").select("event_id", X.redacted_url(url).alias("url"))


@query
def graph_redaction(spark, d):
    kinds = [
        "no route to bolt+s://h:7687", "password = hush\nrefused", "token:abc   NEO4J://h", "fine",
        "url=bolt://me:pw@h:7687 down", "config:neo4j+s://u:p@h", "cfg.password=abc", "(user=x,token=abc)", "a=1;api_key=abc", '{"password": "p w"} x', "api-key:\tabc",
    ]
    message = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % len(kinds) + 1).cast("int"))
    return _t(spark, d, "events").select("event_id", X.graph_redacted(F.concat(message, F.lit(" #"), "event_id")).alias("message"))


@query
def transient_failures(spark, d):
    status = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(*map(F.lit, [404, 429, 503, 200])), (F.col("event_id") % 4 + 1).cast("int")))
    return _t(spark, d, "events").select("event_id", X.transient(status, F.when(F.col("event_id") % 2 == 0, "Read timed out").otherwise("bad key")).alias("transient"))


@query
def stable_point_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", X.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("default:"), "doc_id", F.lit(":"), "source")).alias("point_id"))


@query
def graph_resolve(spark, d):
    """Each document's entities related by name, every seventh to a name that no node has."""
    nodes, _ = _graph(spark, d)
    rel = G.rule_relations(_entities(spark, d)).withColumn("target", F.when(F.col("document_id").cast("long") % 7 == 3, "no such node").otherwise(F.upper("target")))
    good, dangling = G.resolve(rel, nodes)
    count = lambda rows, kind: rows.groupBy("document_id").agg(F.count("*").alias("relations")).select("document_id", F.lit(kind).alias("kind"), "relations")
    return count(good, "edge").union(count(dangling, "dangling"))


@query
def graph_replace(spark, d):
    """Documents ending in 3 get graphs of their first four words, those ending in 4 lose theirs."""
    nodes, edges = _graph(spark, d)
    fresh = G.rule_entities(_t(spark, d, "documents").where("doc_id % 10 = 3"), most=4)
    asked = _t(spark, d, "documents").where("doc_id % 10 IN (3, 4)").select(F.col("doc_id").cast("string").alias("document_id"))
    parts = G.replace_graph(nodes, G.dedupe_edges(edges), G.concept_nodes(fresh), G.dedupe_edges(G.concept_edges(G.rule_relations(fresh))), asked)
    out = None
    for kind, rows in zip(("nodes", "edges", "canonical", "orphans"), parts, strict=True):
        one = rows.agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), "rows")
        out = one if out is None else out.union(one)
    return out


def _builds(spark, d) -> DataFrame:
    """Build states of four in five documents."""
    kinds = F.array(*map(F.lit, ["building", "ready", "failed", "cleanup_pending"]))
    rows = _t(spark, d, "documents").where("doc_id % 5 < 4")
    return rows.select(F.col("doc_id").cast("string").alias("document_id"), F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("status"), F.concat(F.lit("b"), "doc_id").alias("build_id"), (F.col("doc_id") % 3).cast("int").alias("attempt_count"), F.lit(1).alias("llm_attempt_count"))


def _ids(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"))


@query
def graph_status(spark, d):
    return G.status(_ids(spark, d), _builds(spark, d))


@query
def graph_by_status(spark, d):
    return G.by_status(_builds(spark, d), "failed").select("document_id", "build_id")


@query
def graph_deleted(spark, d):
    asked = _ids(spark, d).where("document_id LIKE '%1'")
    return G.deleted(_builds(spark, d), asked, asked.where("document_id LIKE '%11'")).select("document_id", "status")


@query
def graph_recovered(spark, d):
    stored = _builds(spark, d).where("document_id LIKE '%0'").select("document_id", "build_id")
    return G.recovered(_builds(spark, d), stored).select("document_id", "status")


@query
def graph_state_upsert(spark, d):
    new = _ids(spark, d).where("document_id LIKE '%4' OR document_id LIKE '%5'").select("document_id", F.lit("ready").alias("status"), F.lit(None).cast("string").alias("build_id"), F.lit(None).cast("int").alias("attempt_count"), F.lit(9).alias("llm_attempt_count"))
    return N.upsert_state(_builds(spark, d), new)


@query
def graph_page(spark, d):
    return G.page(_graph(spark, d)[0].select("document_id", "graph_id"), ["document_id", "graph_id"], 100, 200)


@query
def graph_chunks_normalized(spark, d):
    """Chunks, some without an id or of another document's; the first chunk of each third document stands twice."""
    w = _windows(spark, d)
    rows = w.select("document_id", F.when(F.col("chunk_index") % 9 != 8, F.concat(F.lit(" "), "chunk_id")).alias("chunk_id"), "content", F.when(F.col("chunk_index") % 7 == 6, "other").alias("owner"), "chunk_index")
    rows = rows.union(rows.where("chunk_index = 0 AND document_id % 3 = 0"))
    good, bad = G.normalized_chunks(rows)
    return good.select("document_id", "chunk_id", F.lit("").alias("problem")).union(bad)


def _extracted(spark, d):
    """An answer for each document that names its language and its source."""
    item = lambda name: F.concat(F.lit('{"name":"'), name, F.lit('","chunk_id":"c0","description":"d","confidence":0.5}'))
    link = F.concat(F.lit('{"source":"'), F.upper("source"), F.lit('","target":"'), F.when(F.col("doc_id") % 4 == 1, "nowhere").otherwise(F.col("lang")), F.lit('","type":"'), F.when(F.col("doc_id") % 4 == 2, "eats").otherwise("is_a"), F.lit('","chunk_id":"'), F.when(F.col("doc_id") % 4 == 3, "c9").otherwise("c0"), F.lit('","confidence":1.5}'))
    head = F.concat(F.lit('```json\n{"concepts":['), item(F.col("lang")), F.lit(","), item(F.col("source")), F.lit(","), item(F.concat(F.lit(" "), F.upper("lang"))), F.lit('],"knowledge_points":[],"persons":['), item(F.lit("Ada")), F.lit('],"knowledge_relations":[],"person_relations":[],"concept_relations":['), link)
    whole = F.concat(head, F.lit('],"mentions":[{"type":"concept","name":"'), F.col("lang"), F.lit('","chunk_id":"c0"},{"type":"person","name":"ada","chunk_id":"c9"}]}\n```'))
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("c0").alias("chunk_id"), F.when(F.col("doc_id") % 10 == 9, F.lit('{"concepts":[]}')).otherwise(whole).alias("answer"))
    return docs, docs.select("document_id", "chunk_id")


@query
def extraction_problems(spark, d):
    return N.parsed(_extracted(spark, d)[0]).where("problem IS NOT NULL").select("document_id", "problem")


@query
def extraction_entities(spark, d):
    return N.entities(N.parsed(_extracted(spark, d)[0]).where("problem IS NULL")).select("document_id", "label", "normalized_name")


@query
def extraction_relations(spark, d):
    rows, chunks = _extracted(spark, d)
    good = N.parsed(rows).where("problem IS NULL")
    edges, problems = N.relations(good, N.entities(good), chunks)
    return edges.select("document_id", "type", "confidence", F.lit("").alias("problem")).union(problems.select("document_id", "type", F.lit(None).cast("double"), "problem"))


@query
def extraction_mentions(spark, d):
    rows, chunks = _extracted(spark, d)
    good = N.parsed(rows).where("problem IS NULL")
    return N.mentions(good, N.entities(good), chunks).groupBy("document_id", "source_id", "type").agg(F.count("*").alias("mentions"), F.min("confidence").alias("confidence"))


@query
def graph_assembled(spark, d):
    """What each document's whole graph has of each kind of node and edge."""
    rows, chunks = _extracted(spark, d)
    told = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("chunk_index"), F.array("source", "lang").alias("heading_path"))
    nodes, edges, _ = N.assembled(N.parsed(rows).where("problem IS NULL"), chunks.join(told, "document_id"))
    kinds = nodes.select("document_id", F.col("label").alias("kind")).unionByName(edges.select("document_id", F.col("type").alias("kind")))
    return kinds.groupBy("document_id", "kind").agg(F.count("*").alias("n"))


def _dependent(spark, d):
    """Answers in which a document's source depends on its language, and is someone whom Ada knows."""
    item = lambda name: F.struct(name.alias("name"), F.lit("d").alias("description"), F.lit("c0").alias("chunk_id"), F.lit(0.5).alias("confidence"))
    link = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), kind.alias("type"), F.lit("c0").alias("chunk_id"), F.lit("e").alias("evidence"))
    source, lang, ada, none = F.col("source"), F.col("lang"), F.lit("Ada"), F.array()
    kind = F.when(F.col("doc_id") % 2 == 0, "depends_on").otherwise("prerequisite_of")
    graph = F.struct(
        none.alias("concepts"), F.array(item(source), item(lang)).alias("knowledge_points"), F.array(item(ada), item(source)).alias("persons"), none.alias("concept_relations"),
        F.array(link(source, lang, kind)).alias("knowledge_relations"), F.array(link(ada, source, F.lit("knows"))).alias("person_relations"), none.alias("mentions"),
    )
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("c0").alias("chunk_id"), F.to_json(graph).alias("answer"))
    good = N.parsed(docs).where("problem IS NULL")
    nodes = N.entities(good)
    return nodes, N.relations(good, nodes, docs)[0]


@query
def graph_dependencies(spark, d):
    return G.knowledge_dependencies(*_dependent(spark, d), cursor=5).select("document_id", "type", "source_name", "target_name")


@query
def graph_person_relations(spark, d):
    return G.person_relations(*_dependent(spark, d), name=" ADA ").select("document_id", "type", "source_name", "target_name")


@query
def comparison_markdown(spark, d):
    c = F.struct(
        F.array(F.struct(F.col("lang").alias("text"), F.array(F.lit("S-1"), F.lit("S-2")).alias("citations"))).alias("common_points"),
        F.array(F.struct(F.col("source").alias("topic"), F.array(F.struct(F.lit("a").alias("document_id"), F.lit("x").alias("text"), F.array().cast("array<string>").alias("citations"))).alias("documents"))).alias("differences"),
        F.array().cast("array<struct<document_id:string,summary:string,citations:array<string>>>").alias("per_document_evidence"),
        F.array(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.lit("n").alias("note"))).alias("missing_information"),
    )
    return _t(spark, d, "documents").select("doc_id", A.comparison_markdown(c).alias("markdown"))


@query
def answer_text(spark, d):
    source = lambda mark, shown: F.struct(mark.alias("citation_id"), shown.alias("shown"))
    sources = F.array(source(F.lit("S-1"), F.col("source")), source(F.lit("S-1"), F.lit("again")), source(F.col("lang"), F.lit("")))
    graph = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("G-1").alias("citation_id"), F.col("doc_id").cast("string").alias("document_id"), F.lit("entity").alias("kind"), F.col("source").alias("name")))).otherwise(F.array().cast("array<struct<citation_id:string,document_id:string,kind:string,name:string>>"))
    return _t(spark, d, "documents").select("doc_id", A.answer_text(F.col("lang"), sources, F.col("doc_id") % 3 == 0, graph).alias("answer"))


@query
def memory_snapshot_difference(spark, d):
    rows = M.owned(_memories(spark, d).where("user_id = 3"), 3)
    return M.difference(rows, M.forget(rows, "importance_based", AS_OF, threshold=0.6))


@query
def memory_clear(spark, d):
    left, removed = M.clear(_memories(spark, d), "semantic")
    return left.groupBy("memory_type").agg(F.count("*").alias("memories")).select(F.lit("left").alias("kind"), "memory_type", "memories").union(removed.select(F.lit("removed"), "memory_type", "removed"))


@query
def memory_summary(spark, d):
    return M.summary_lines(_memories(spark, d))


@query
def memory_insert_once(spark, d):
    rows = _memories(spark, d).select("memory_id", "user_id", "importance")
    return M.insert_once(rows.where("memory_id % 3 = 0"), rows.where("memory_id % 2 = 0").union(rows.where("memory_id % 2 = 0")).withColumn("importance", F.lit(0.1)))


@query
def episodic_items(spark, d):
    rows = _memories(spark, d).where("memory_type = 'episodic'").select(F.col("memory_id").cast("string").alias("memory_id"), "content", "importance")
    payload = F.create_map(F.lit("episode_id"), F.when(F.col("memory_id") % 2 == 0, F.col("memory_id")).otherwise(""), F.lit("content"), F.when(F.col("memory_id") % 3 == 0, "told").otherwise(""), F.lit("importance"), F.when(F.col("memory_id") % 5 == 0, "0.9"))
    return M.retrieved_items(rows.select(F.col("memory_id").alias("id"), F.lit(0.25).alias("score"), payload.alias("metadata")), rows)


@query
def history_upsert(spark, d):
    rows = H.latest(_records(spark, d)).select("user_id", "document_id", "position", "name")
    new = _records(spark, d).where("position % 26 = 4").groupBy("user_id", "document_id").agg((F.max("position") + 1_000_000).alias("position"), F.lit("new").alias("name"))
    return H.upsert(rows, new)


@query
def history_clear(spark, d):
    r = _records(spark, d)
    return H.cleared(documents=r.where("position % 3 = 0"), questions=r.where("position % 3 = 1"))[1]


@query
def history_note(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("position"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("note"), F.when(F.col("event_id") % 2 == 0, F.lit("what")).alias("concept"))
    none = _memories(spark, d).limit(0).select(F.col("memory_id").cast("string").alias("memory_id"), "user_id", "memory_type", "content", "importance", "ts")
    memories, _ = H.with_note(none, e.limit(0), e)
    return memories.select("memory_id", "content", "importance", "memory_type")


@query
def learning_stats(spark, d):
    r = _records(spark, d)
    return H.learning_stats(H.latest(r), r.where("position % 3 = 1"), r.where("position % 5 = 1"))


@query
def history_load(spark, d):
    kinds = F.array(F.lit('{"documents":[1,2],"questions":[{}]}'), F.lit('{"documents":{},"notes":[]}'), F.lit("broken"), F.lit('{"notes":[1,2,3]}'), F.lit("[]"))
    good, bad = H.load(_t(spark, d, "events").select(F.col("event_id").alias("user_id"), F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("value")))
    none = F.lit(None).cast("int")
    return good.select("user_id", "documents", "questions", "notes").union(bad.select("user_id", none, none, none))


@query
def import_transitions(spark, d):
    """Commit gate, success, cancel and release, each asked of every task."""
    tasks = _tasks(spark, d).withColumn("cancel_requested_at", F.when(F.col("task_id") % 12 == 1, F.col("created_at")))
    out = None
    for kind, step in (("commit", T.begin_committing), ("succeed", T.mark_succeeded), ("cancel", T.mark_cancelled), ("release", T.release_claim)):
        after, refused = step(tasks, F.lit(True))
        rows = after.groupBy("status", "stage").agg(F.count("*").alias("tasks"), F.sum("auto_retry_count").alias("retries")).select(F.lit(kind).alias("kind"), "status", "stage", "tasks", "retries")
        rows = rows.union(refused.agg(F.count("*").alias("n")).select(F.lit(kind), F.lit("refused"), F.lit(""), "n", F.lit(0).cast("long")))
        out = rows if out is None else out.union(rows)
    return out


@query
def import_manual_retry(spark, d):
    return T.retry_failed(_tasks(spark, d), F.col("batch_id") % 2 == 0).select("task_id", "status", "auto_retry_count", "manual_retry_count")


@query
def import_recover(spark, d):
    tasks = _tasks(spark, d)
    return T.recover(tasks, tasks.where("task_id % 5 = 0").select("task_id")).select("task_id", "status", "error_code")


@query
def import_active_users(spark, d):
    return T.active(_tasks(spark, d))


@query
def context_budgets(spark, d):
    """The room that each question leaves for its sources, by the length of its words."""
    tokens = X.approximate_tokens(F.col("text"))
    return _t(spark, d, "benchmark").select("item_id", tokens.alias("tokens"), A.room(tokens).alias("room"))


@query
def rag_stats_text(spark, d):
    return C.stats_line(_windows(spark, d), "rag", "default", V.DIMENSION)


def _uploads(spark, d) -> DataFrame:
    name = F.concat("source", F.when(F.col("doc_id") % 97 == 5, ".exe").otherwise(".MD"))
    return _t(spark, d, "documents").select(F.col("doc_id").alias("task_id"), F.floor(F.col("doc_id") / 15).alias("batch_id"), F.when(F.col("doc_id") % 150 == 3, 9).otherwise(F.floor(F.col("doc_id") / 15) % 4).alias("user_id"), F.col("doc_id").cast("string").alias("document_id"), name.alias("original_name"), (F.col("n_chars") * 4096).alias("size_bytes"))


@query
def import_submit(spark, d):
    batches, tasks, refused = T.submit(_uploads(spark, d), AS_OF)
    counted = tasks.groupBy("batch_id", "user_id", "file_suffix", "status").agg(F.count("*").alias("tasks"))
    rows = counted.join(batches.select("batch_id", "created_at"), "batch_id").select("batch_id", F.concat_ws(" ", "file_suffix", "status").alias("outcome"), "tasks", "created_at")
    return rows.union(refused.select("batch_id", "problem", F.lit(0).cast("long"), F.lit(None).cast("timestamp_ntz")))


@query
def import_chunking_boundary(spark, d):
    stages = F.array(*map(F.lit, ["parsing", "embedding", "persisting"]))
    e = _t(spark, d, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("position"), F.element_at(stages, (F.col("event_id") % 3 + 1).cast("int")).alias("stage"), (F.col("event_id") % 10).alias("completed"), (F.col("event_id") % 7 + 10).alias("total"))
    return T.with_chunking_boundary(e).where("stage <> 'persisting'")


@query
def old_files_scan(spark, d):
    """Documents as files of an older installation."""
    places = F.array(*map(F.lit, ["x/Uploads/a.PDF", "memory_data/learning_history_user123.json", "data/rag_cache.json", "old/Reports/r.md", "data/memories.json", "misc/b.bin", "documents/deep/c.txt", "report/d.txt"]))
    files = _t(spark, d, "documents").select(F.concat(F.lit("/home/"), "source", F.lit("/"), F.element_at(places, (F.col("doc_id") % 8 + 1).cast("int"))).alias("path"), F.col("n_chars").cast("long").alias("length"))
    return scan.summary(files)


@query
def import_stream(spark, d):
    """Tasks (one for each user) that a stream of all events leaves behind, up to an hour before its end; held events and retries wake by timers."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/event[s].parquet")  # a pattern: the table may be one file
    of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    n = F.col("event_id")
    told = S.events(
        rows, of(["parsing", "chunking", "embedding", "persisting"], n), n % 10, F.lit(10), task_id=F.col("user_id"), at=F.col("ts"), seq=n, retryable=n % 3 > 0, error_code=F.concat(F.lit("E"), n % 5),
        kind=of(["submit", "claim", "claim", "progress", "progress", "progress", "commit", "succeed", "fail", "fail", "cancel", "retry", "claim", "release"], n * 5 + F.col("user_id")),
    )
    folder = scratch(spark)
    S.keep(S.follow(told, late="1 hour"), f"{folder}/tasks", f"{folder}/checkpoint").awaitTermination()
    last = S.latest(spark.read.schema(S.TASKS).parquet(f"{folder}/tasks/batch=*"))
    return last.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("next_attempt_at", "cancel_requested_at", "updated_at")})


def _library(spark, d) -> str:
    """A library of all documents, in which those in German were loaded once more, cut, and a source's were deleted."""
    root = scratch(spark)
    docs = _t(spark, d, "documents").withColumn("document_id", F.col("doc_id").cast("string"))
    loading.load(docs.select("document_id", "text"), root, "u1", AS_OF, "first", profile="windows", embed=False)
    again = docs.where("lang = 'de'").select("document_id", F.substring("text", 1, 900).alias("text"))
    for _ in range(2):  # the second time does nothing
        loading.load(again, root, "u1", "2024-02-01 00:00:00", "second", profile="windows", embed=False)
    loading.delete(spark, root, docs.where("source = 'src3'"))
    return root


@query
def document_load(spark, d):
    """Each document left in the library with its version, chunks, events and last import."""
    root = _library(spark, d)
    chunks = L.read(spark, root, "chunks").groupBy("document_id").agg(F.count("*").alias("chunks"), F.max("document_version").alias("chunk_version"))
    events = L.read(spark, root, "memories").groupBy("document_id").agg(F.count("*").alias("events"))
    records = L.read(spark, root, "documents").join(chunks, "document_id", "left").join(events, "document_id", "left")
    none = F.lit(0).cast("long")
    return records.select("document_id", "document_version", "chunk_version", F.coalesce("chunks", none).alias("chunks"), F.coalesce("events", none).alias("events"), "import_task_id", "first_loaded_at")


@query
def documents_cleared(spark, d):
    """Rows of each table that clearing a library removes, what is left, and what an older manifest still shows."""
    root = _library(spark, d)
    before = L.version(spark, root)
    names = ("chunks", "documents", "memories")
    removed = loading.clear(spark, root)
    count = lambda rows: 0 if rows is None else rows.count()
    rows = [(n, removed.get(n, 0), count(L.read(spark, root, n)), count(L.read(spark, root, n, before))) for n in names]
    return spark.createDataFrame(rows, "kind string, removed long, remaining long, shown_before long")


@query
def summaries_in_background(spark, d):
    """One run that summarises every document's chunks, and one that is cancelled while it waits or has just begun."""
    folder = scratch(spark)

    def run(progress):
        chunks = _windows(spark, d)
        progress(0, stage="mapping")
        chunks.groupBy("document_id").agg(F.count("*").alias("chunks")).write.parquet(f"{folder}/summaries")
        progress(1, stage="reducing")
        return spark.read.parquet(f"{folder}/summaries").count()

    pool = Background(spark, workers=1)
    first = pool.start(run, 1)
    second = pool.start(lambda progress: _windows(spark, d).write.parquet(f"{folder}/never"), 1)
    pool.cancel(second)
    documents = pool.result(first)
    pool.wait()
    rows = pool.table().withColumn("documents", F.when(F.col("task_id") == first, F.lit(documents).cast("long")))
    pool.close()
    return rows.select("status", "stage", "completed", "total", "documents")


def _compared(spark, d):
    """Each document asked together with the next two; graphs of every ninth are not ready."""
    n = F.col("doc_id")
    ids = F.array(*((n + k).cast("string") for k in range(3)))
    docs = _t(spark, d, "documents")
    return docs.select(n.alias("query_id"), F.lit("the que ber").alias("query"), ids.alias("document_ids")), docs.where("doc_id % 9 <> 4").select(n.cast("string").alias("document_id"), F.lit("ready").alias("status"))


@query
def graph_cross_document_evidence(spark, d):
    ready, _ = D.selections(*_compared(spark, d))
    return D.shared_evidence(ready, _graph(spark, d)[0]).drop("name")


@query
def graph_cross_document_problems(spark, d):
    """Questions that fail before an answer where graphs are required."""
    ready, problems = D.selections(*_compared(spark, d))
    shared = D.shared_evidence(ready, _graph(spark, d)[0])
    return D.gate(shared, ready, problems, "required")[1]


@query
def graph_sources(spark, d):
    """Citations of shared entities and of every node and edge that a question's document has."""
    nodes, edges = _graph(spark, d)
    ready, _ = D.selections(*_compared(spark, d))
    entities = nodes.select(F.col("document_id").alias("query_id"), "document_id", "graph_id", "label", "name")
    relations = edges.select(F.col("document_id").alias("query_id"), "document_id", "source_id", "target_id", "type", F.lit("").alias("evidence"))
    shared = D.shared_evidence(ready.withColumn("query_id", F.col("query_id").cast("string")), nodes)
    return D.sources(entities, relations, shared).drop("name")


def _payloads(spark, d):
    e = _t(spark, d, "events")
    more = F.struct(F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 7).alias("chunk_index"), (F.col("event_id") % 4).alias("document_version"), F.lit("hidden").alias("content"), F.col("event_type").alias("kind"), F.struct((F.col("event_id") % 10).alias("depth")).alias("place"))
    text = F.when(F.col("event_id") % 11 == 5, F.lit("[1]")).otherwise(F.to_json(more))
    return Y.stored(e.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit("!")).alias("content"), F.col("user_id").cast("string").alias("document_id"), text.alias("metadata")), "ns")


@query
def payload_layout(spark, d):
    rows = _payloads(spark, d)
    flat = Y.flattened(rows)
    return rows.select("id", "chunk_index", "document_version", F.array_join(F.array_sort(F.map_keys(flat)), ",").alias("keys"), F.try_variant_get(flat["content"], "$", "string").alias("content"), F.to_json("metadata").alias("nested"))


@query
def payload_nested_filter(spark, d):
    """Filters on columns and on paths inside the metadata."""
    return Y.matching(_payloads(spark, d), {"chunk_index": [1, 2, 4], "place.depth": P.Range(gte=3, lt=8), "kind": ["view", "click", "purchase"]}).select("id", "chunk_index")


@query
def memory_add(spark, d):
    e = _t(spark, d, "events")
    new = e.select((F.col("event_id") + 1_000_000).alias("memory_id"), F.when(F.col("event_id") % 5 > 0, F.col("props")).alias("content"), F.when(F.col("event_id") % 3 == 0, "perceptual").alias("memory_type"), F.concat(F.lit("f."), F.element_at(F.array(*map(F.lit, ["PNG", "mp3", "xyz"])), (F.col("event_id") % 3 + 1).cast("int"))).alias("file_path"))
    return M.add(_memories(spark, d), new, 7, AS_OF).select("memory_id", "user_id", "memory_type", "session_id", "importance", "modality", "raw_data")


@query
def memory_episodic_add(spark, d):
    """Every third event told anew, some ids several times."""
    e, at = _t(spark, d, "events"), F.col("event_id")
    ts = F.col("ts").cast("timestamp_ntz")
    spelled = F.when(at % 4 == 0, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).when(at % 4 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(at % 4 == 2, F.date_format(ts, "yyyy/MM/dd")).otherwise("never")
    new = e.select((at - at % 3).alias("memory_id"), "user_id", F.when(at % 2 == 0, F.col("event_type")).alias("session_id"), F.col("props").alias("content"), F.lit(None).cast("double").alias("importance"), spelled.alias("timestamp"), at.alias("seq"))
    return M.episodic_add(_memories(spark, d).where("memory_type = 'episodic'"), new, AS_OF).select("memory_id", "session_id", "content", "importance", "ts")


@query
def import_batches_listed(spark, d):
    tasks = _tasks(spark, d)
    batches = tasks.groupBy("batch_id", "user_id").agg(F.max("created_at").alias("created_at"))
    return T.listed(batches, tasks, 3).select("batch_id", "user_id", "place", "total", "failed")


@query
def library_projection(spark, d):
    n = F.col("event_id")
    name = F.concat("event_type", F.when(n % 6 == 1, "/x.md").when(n % 6 == 2, ".PDF").otherwise(".md"))
    rows = _t(spark, d, "events").select("user_id", n.cast("string").alias("document_id"), name.alias("document_name"), F.when(n % 10 == 3, " ").when(n % 6 == 2, ".pdf").otherwise(".md").alias("file_suffix"), F.concat(F.lit("u/"), F.when(n % 7 == 2, "../").otherwise(""), "event_type", F.when(n % 6 == 2, ".PDF").otherwise(".MD")).alias("document_path"), F.when(n % 2 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise("yesterday").alias("loaded_at"))
    return H.projected(rows)


@query
def learning_report(spark, d):
    e = _t(spark, d, "events").select("user_id", F.col("event_id").alias("position"), F.col("event_type"), "props")
    of = lambda kind: e.where(F.col("event_type") == kind)
    documents = of("view").select("user_id", "position", F.col("props").alias("document_name"), F.when(F.col("position") % 2 == 0, F.col("position").cast("string")).alias("loaded_at"))
    questions = of("click").select("user_id", "position", F.col("props").alias("question"), F.repeat("props", 40).alias("answer"))
    notes = of("purchase").select("user_id", "position", F.when(F.col("position") % 2 == 0, "idea").otherwise("").alias("concept"), F.col("props").alias("note"))
    out = H.report_sections(e, documents, questions, notes)
    return out.select("user_id", "documents_count", "questions_count", "notes_count", "documents_text", F.sha2("questions_text", 256).alias("questions_digest"), "notes_text")


def _pdf(pages: list[str]) -> bytes:
    """A plain PDF file, a line of ASCII text on each page."""
    kids = " ".join(f"{3 + 2 * k} 0 R" for k in range(len(pages)))
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{kids}] >>"]
    for k, text in enumerate(pages):
        content = f"BT <{text.encode().hex()}> Tj ET"
        objects += [f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >>", f"<< /Length {len(content)} >>\nstream\n{content}\nendstream"]
    return ("%PDF-1.4\n" + "".join(f"{n} 0 obj\n{body}\nendobj\n" for n, body in enumerate(objects, 1)) + "trailer << /Root 1 0 R >>\n%%EOF").encode()


def _docx(lines: list[str]) -> bytes:
    import io
    import zipfile
    from xml.sax.saxutils import escape

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        body = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in lines)
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query
def files_read(spark, d):
    """Every document written as a file, printable ones as PDF (a page for each line) and DOCX, and read by the file source: of PDF files pages 1 and 2."""
    folder = scratch(spark)

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        for pdf in batches:
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                text = text or ""
                plain = all(c == "\n" or " " <= c <= "~" for c in text)
                kind = ("pdf" if i % 2 else "docx") if plain else ("txt" if i % 2 else "md")
                lines = text.split("\n")
                raw = _pdf(lines) if kind == "pdf" else _docx(lines) if kind == "docx" else text.encode()
                with store.open_output_stream(f"{root}/{i}.{kind}") as out:
                    out.write(raw)
            yield pdf[["doc_id"]]

    _t(spark, d, "documents").select("doc_id", "text").mapInPandas(write, "doc_id long").count()
    document_format.register(spark)
    rows = spark.read.format("docweave").option("pages", "1-2").option("bytesPerPartition", "200000").load(folder)
    return rows.select("document_id", "file_name", "segment_index", "page_number", F.length("content").alias("chars"), F.sha2("content", 256).alias("digest"), F.col("error").isNotNull().alias("failed"))


@query
def snapshot_round_trip(spark, d):
    """Chunks saved as JSON lines and loaded again, among them blank ones, ones without an index and one line that is no record."""
    folder = scratch(spark)
    chunks = _windows(spark, d)
    n = F.crc32("chunk_id") % 10
    rows = chunks.select("chunk_id", "document_id", F.when(n == 1, " ").otherwise(F.col("content")).alias("content"), F.when(n != 2, F.col("chunk_index")).alias("chunk_index"), F.when(n == 3, " 7 ").alias("page_number"), F.when(n == 4, "2024-01-05 10:00:00").otherwise("never").alias("created_at"), F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    snapshots.save_chunks(rows, f"{folder}/chunks")
    spark.range(1).select(F.lit("{broken").alias("value")).coalesce(1).write.text(f"{folder}/lines")
    loaded, bad = snapshots.load_chunks(spark, f"{folder}/{{chunks,lines}}", 3)
    good = loaded.select("chunk_id", "document_id", "chunk_index", F.sha2("content", 256).alias("digest"), "page_number", "created_at", F.array_join(F.transform("vector", lambda x: x.cast("int")), ",").alias("vector"))
    none = F.lit(None)
    return good.unionByName(bad.select(F.lit("bad").alias("chunk_id"), *(none.cast(good.schema[c].dataType).alias(c) for c in good.columns[1:3]), F.sha2("line", 256).alias("digest"), *(none.cast(good.schema[c].dataType).alias(c) for c in good.columns[4:])))


@query
def rag_stats_without_blank(spark, d):
    """Statistics in which chunks without a document id are counted, but as no document."""
    rows = _windows(spark, d).withColumn("document_id", F.when(F.crc32("document_id") % 4 == 0, " ").otherwise(F.col("document_id")))
    return C.stats(rows, count_blank=False)
