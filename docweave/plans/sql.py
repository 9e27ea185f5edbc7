"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from docweave.operators.context import CITATIONS, KEYWORDS, NO_FILE, NO_PAGE, budget
from docweave.operators.memory import TYPE_NAMES
from docweave.plans.answers import JOINT, SUMMARY

_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


_NORMAL = r"replace(regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 'ß', 'ss')"
_W = rf"""
t0 AS (SELECT doc_id, {_strip("coalesce(text, '')")} AS t FROM documents),
w0 AS (SELECT doc_id, i, {_strip("substr(t, i * 680 + 1, 800)")} AS content FROM (SELECT doc_id, t, unnest(range(0, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 800 THEN 1 ELSE CAST(ceil((length(t) - 800) / 680.0) AS BIGINT) + 1 END)) AS i FROM t0)),
w AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, content FROM w0 WHERE length(content) > 0)"""
_P = rf"""
t0 AS (SELECT doc_id, {_strip("coalesce(text, '')")} AS t FROM documents),
p0 AS (SELECT doc_id, t, list_filter(list_transform(string_split(replace(t, chr(13) || chr(10), chr(10)), chr(10) || chr(10)), lambda x: {_strip("x")}), lambda x: length(x) > 0) AS b,
       list_filter(list_transform(string_split(t, chr(10)), lambda x: {_strip("x")}), lambda x: length(x) > 0) AS l FROM t0 WHERE length(t) > 0),
p1 AS (SELECT doc_id, t, CASE WHEN len(b) > 1 THEN b ELSE l END AS p FROM p0),
p2 AS (SELECT doc_id, t, unnest(string_split(list_reduce(p, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 2 + length(x) <= 800 THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END), chr(1))) AS q,
       generate_subscripts(string_split(list_reduce(p, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + 2 + length(x) <= 800 THEN a || chr(10) || chr(10) || x ELSE a || chr(1) || x END), chr(1)), 1) AS k FROM p1 WHERE length(t) > 800),
p3 AS (SELECT doc_id, k, i, {_strip("substr(q, i * 680 + 1, 800)")} AS content FROM (SELECT doc_id, k, q, unnest(range(0, CASE WHEN length(q) <= 800 THEN 1 ELSE CAST(ceil((length(q) - 800) / 680.0) AS BIGINT) + 1 END)) AS i FROM p2)
       UNION ALL SELECT doc_id, 1, 0, t FROM p1 WHERE length(t) <= 800),
p AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS chunk_index, content FROM p3 WHERE length(content) > 0)"""
_DIGEST = "sha256(" + _strip("replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10))") + ")"
_TOK = "list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9_]+|[一-鿿]'), lambda x: lower(x)))"
_WTOK = "list_concat(regexp_extract_all(coalesce({0}, ''), '[一-鿿]'), regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9_]+'))"
_LEX = f"""
q AS (SELECT item_id AS query_id, unnest({_TOK.format("text")}) AS token, len({_TOK.format("text")}) AS n FROM benchmark WHERE item_id % 20 = 0),
c AS (SELECT doc_id AS id, unnest({_TOK.format("text")}) AS token FROM documents),
lex AS (SELECT query_id, id, count(*) / any_value(n) AS l FROM c JOIN q USING (token) GROUP BY query_id, id)"""
_COS = """
e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT a.id AS query_id, b.id AS id, b.label AS label, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a, e b WHERE a.id % 20 = 0)"""
_NEAR = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"
_MEM = """
m AS (SELECT event_id AS memory_id, user_id, event_type AS session_id, CAST(ts AS TIMESTAMP) AS ts, round(least(1.0, value / 100), 4) AS importance, event_type || ' ' || props AS content,
      CASE WHEN event_type IN ('view', 'click') THEN 'working' WHEN event_type IN ('purchase', 'signup') THEN 'episodic' ELSE 'semantic' END AS memory_type FROM events)"""
_AGE = f"(date_diff('microsecond', ts, {_AS_OF}) / 60e6)"
_TURNS = f"""
u AS (SELECT conv_id * 1000 + turn AS memory_id, conv_id AS user_id, role AS session_id, text AS content, {_AS_OF} + to_seconds(-(conv_id * 37 + turn * 11) % 5400) AS ts, 0.3::DOUBLE + (turn % 7) / 10 AS importance FROM conversations)"""


def _tfidf(memories: str) -> str:
    return f"""
mt AS (SELECT memory_id, {_WTOK.format("content")} AS t FROM {memories}),
tf AS (SELECT memory_id, token, count(*) / any_value(n) AS tf FROM (SELECT memory_id, len(t) AS n, unnest(t) AS token FROM mt) GROUP BY memory_id, token),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
nn AS (SELECT count(*) AS total FROM {memories}),
dw AS (SELECT memory_id, tf.token, tf * (ln((total + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (token), nn),
qt AS (SELECT item_id AS query_id, text AS query, {_WTOK.format("text")} AS t FROM benchmark WHERE item_id % 20 = 0),
qf AS (SELECT query_id, token, count(*) / any_value(n) AS tf FROM (SELECT query_id, len(t) AS n, unnest(t) AS token FROM qt) GROUP BY query_id, token),
qw AS (SELECT query_id, qf.token, tf * (ln((total + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM qf LEFT JOIN df USING (token), nn),
tfidf AS (SELECT query_id, memory_id, dot / (a.l * b.l) AS s FROM (SELECT query_id, memory_id, sum(dw.w * qw.w) AS dot FROM dw JOIN qw USING (token) GROUP BY query_id, memory_id)
          JOIN (SELECT memory_id, sqrt(sum(w * w)) AS l FROM dw GROUP BY memory_id) a USING (memory_id) JOIN (SELECT query_id, sqrt(sum(w * w)) AS l FROM qw GROUP BY query_id) b USING (query_id))"""


_ENT = r"""
e0 AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, list_slice(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}A-Za-z0-9_]{2,}'), 1, 10) AS ws FROM documents),
e1 AS (SELECT document_id, name, min(i) AS i FROM (SELECT document_id, unnest(ws) AS name, generate_subscripts(ws, 1) AS i FROM e0) GROUP BY document_id, name),
ent AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS position, name FROM e1),
rel AS (SELECT * FROM (SELECT document_id, position, name AS source, lead(name) OVER (PARTITION BY document_id ORDER BY position) AS target FROM ent) WHERE target IS NOT NULL)"""


def _gid(name: str) -> str:
    return f"document_id || ':concept:' || substr(sha256('default' || chr(0) || document_id || chr(0) || 'concept' || chr(0) || {_NORMAL.format(name)}), 1, 24)"


_GRAPH = f"""{_ENT},
node AS (SELECT document_id, normalized_name, min_by(name, position) AS name, min(position) AS ord, {_gid("normalized_name")} AS graph_id FROM (SELECT *, {_NORMAL.format("name")} AS normalized_name FROM ent) WHERE normalized_name <> '' GROUP BY document_id, normalized_name),
edge AS (SELECT document_id, {_gid("source")} AS source_id, {_gid("target")} AS target_id, position FROM rel),
edge1 AS (SELECT DISTINCT document_id, source_id, target_id FROM edge)"""
_SRC = """
s0 AS (SELECT user_id AS query_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, value, event_id, event_type FROM events),
src AS (SELECT query_id, rank, value - rank / 1000 AS score, repeat(event_type, CAST(event_id % 9 AS BIGINT) + 1) AS content, rank = 3 AS protected, event_id FROM s0),
dropped AS (SELECT *, sum(length(content) + 2) OVER o - 2 AS after_, row_number() OVER o AS k FROM src WINDOW o AS (PARTITION BY query_id ORDER BY protected DESC, score DESC, rank ROWS UNBOUNDED PRECEDING))"""
_TASK = """
task AS (SELECT event_id AS task_id, CAST(floor(event_id / 8) AS BIGINT) AS batch_id, user_id, ['queued', 'running', 'retry_wait', 'succeeded', 'failed', 'cancelled'][CAST(event_id % 6 + 1 AS INT)] AS status,
         CASE WHEN event_id % 4 = 1 THEN 'committing' ELSE 'embedding' END AS stage, CAST(ts AS TIMESTAMP) AS created_at, CASE WHEN event_id % 6 = 2 THEN CAST(ts AS TIMESTAMP) + INTERVAL 5 HOUR END AS next_attempt_at,
         event_id % 5 AS auto_retry_count FROM events)"""
_REC = """
r AS (SELECT user_id, CAST(event_id % 13 AS VARCHAR) AS document_id, event_id AS position, CASE WHEN event_id % 3 > 0 THEN CAST(ts AS TIMESTAMP) END AS loaded_at, event_type AS name FROM events)"""
def _forget(kind: str, keep: str) -> str:
    return f"WITH {_MEM} SELECT memory_id, user_id FROM m WHERE memory_type = '{kind}' AND {keep}"


def _embedding(ids: str, source: str) -> str:
    """Hash embeddings of (key, text) rows of ``source`` as (key, idx, value)."""
    return f"""
ch AS (SELECT {ids}, (i - 1) % 384 AS idx, (unicode(c) % 997) / 997.0::DOUBLE AS x FROM (SELECT {ids}, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM {source} WHERE length(text) > 0)),
wd AS (SELECT {ids}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 384 AS idx, 1.0::DOUBLE AS x FROM (SELECT {ids}, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) AS t FROM {source})),
raw AS (SELECT {ids}, idx, sum(x) AS x FROM (SELECT * FROM ch UNION ALL SELECT * FROM wd) GROUP BY ALL),
nrm AS (SELECT {ids}, sqrt(sum(x * x)) AS n FROM raw GROUP BY ALL)"""


def _near(source: str, limit: int, name: str = "pool") -> str:
    """The ``limit`` rows of ``source`` (id, text) nearest to each question by hash embeddings, as (query_id, id, score, r)."""
    return f"""pt AS (SELECT 'm' AS side, id AS key, text FROM {source} UNION ALL SELECT 'q', item_id, text FROM benchmark WHERE item_id % 20 = 0), {_embedding("side, key", "pt")},
    unit AS (SELECT side, key, idx, x / n AS x FROM raw JOIN nrm USING (side, key)),
    every AS (SELECT q.item_id AS query_id, m.id FROM benchmark q, {source} m WHERE q.item_id % 20 = 0 AND m.text IS NOT NULL),
    dots AS (SELECT a.key AS query_id, b.key AS id, sum(a.x * b.x) AS dot FROM unit a JOIN unit b USING (idx) WHERE a.side = 'q' AND b.side = 'm' GROUP BY ALL),
    {name} AS (SELECT query_id, id, round(coalesce(dot, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(dot, 0), 6) DESC, id) AS r FROM every LEFT JOIN dots USING (query_id, id) QUALIFY r <= {limit})"""


_TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\s+'), lambda x: x <> ''))"
_WORDS = rf"""
kq AS (SELECT item_id AS query_id, text AS query, {_TERMS.format("text")} AS t FROM benchmark WHERE item_id % 20 = 0),
kp AS (SELECT query_id, memory_id, importance, len(list_intersect(t, {_TERMS.format("content")})) / len(t) AS part, contains(content, query) AS inside FROM kq, u),
kw AS (SELECT query_id, memory_id, importance, round(CASE WHEN part > 0 THEN part WHEN inside THEN 1.0 ELSE 0 END, 6) AS g FROM kp)"""
_BEST = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id)"
_PTS = "pts AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS document_id, 'ns' || (vec_id % 2) AS namespace FROM embeddings)"
_BLD = """bld AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, ['building', 'ready', 'failed', 'cleanup_pending'][CAST(doc_id % 5 + 1 AS INT)] AS status, 'b' || doc_id AS build_id, doc_id % 3 AS attempt_count, 1 AS llm_attempt_count FROM documents WHERE doc_id % 5 < 4),
ids AS (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents)"""
_XNAMES = "xn AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id, lang, source FROM documents WHERE doc_id % 10 <> 9)"

_SQL = {
    "chunk_windows": f"WITH {_W} SELECT document_id, chunk_index, length(content) AS n_chars, sha256(content) AS digest FROM w",
    "chunk_paragraphs": f"WITH {_P} SELECT document_id, chunk_index, length(content) AS n_chars, sha256(content) AS digest FROM p",
    "content_digest_dupes": f"SELECT {_DIGEST.format('text')} AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "preview_text": rf"""WITH l AS (SELECT doc_id, regexp_replace(array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip("x")}), lambda x: length(x) > 0), ' '), ' {{2,}}', ' ', 'g') AS one FROM documents)
        SELECT doc_id, CASE WHEN length(one) > 220 THEN substr(one, 1, 220) || '...' ELSE one END AS preview FROM l""",
    "approx_token_len": r"""SELECT doc_id, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]', '', 'g')) + len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM documents""",
    "graph_query_terms": r"""SELECT item_id, coalesce(string_agg(t, ' ' ORDER BY i), '') AS terms FROM (SELECT item_id, t, i, row_number() OVER (PARTITION BY item_id ORDER BY i) AS k FROM
        (SELECT item_id, t, min(i) AS i FROM (SELECT item_id, unnest(ws) AS t, generate_subscripts(ws, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM benchmark)) GROUP BY item_id, t)) WHERE k <= 12 GROUP BY item_id""",
    "qa_mode_route": "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'compare' WHEN 1 THEN 'summary' ELSE 'joint' END AS mode FROM benchmark",
    "lexical_overlap_topk": f"WITH {_LEX} SELECT query_id, rank, id, score FROM (SELECT query_id, id, round(l, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(l, 6) DESC, id) AS rank FROM lex) WHERE rank <= 5",
    "vector_topk": f"WITH {_COS} SELECT query_id, rank, id, score FROM (SELECT *, {_NEAR} AS rank FROM n) WHERE rank <= 5",
    "vector_topk_filtered_in": f"WITH {_COS} SELECT query_id, rank, id, score FROM (SELECT *, {_NEAR} AS rank FROM n WHERE label IN (1, 3, 5)) WHERE rank <= 5",
    "vector_threshold": f"WITH {_COS} SELECT query_id, rank, id, score FROM (SELECT *, {_NEAR} AS rank FROM n WHERE score >= 0.25) WHERE rank <= 20",
    "payload_range_filter": f"WITH {_MEM} SELECT memory_id AS id, user_id, session_id, importance FROM m WHERE importance >= 0.5 AND importance < 0.9 AND ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AND session_id IN ('view', 'click')",
    "scroll_projection": "SELECT vec_id AS id, label FROM embeddings WHERE label = 2",
    "delete_by_filter": "SELECT label, count(*) AS points FROM embeddings WHERE label < 5 GROUP BY label",
    "collection_stats": "SELECT count(*) AS points, count(DISTINCT label) AS labels, max(len(embedding)) AS dimension FROM embeddings",
    "point_upsert": "SELECT user_id AS id, min(event_id) AS seq, max_by(value, event_id) AS value FROM events GROUP BY user_id",
    "hash_embedding_components": f"WITH {_embedding('doc_id', 'documents')} SELECT doc_id, idx, round(x / n, 6) AS value FROM raw JOIN nrm USING (doc_id) WHERE x <> 0",
    "vector_dimension_fit": "SELECT vec_id AS id, round(list_sum(list_slice(CAST(embedding AS DOUBLE[]), 1, 48)), 6) AS total, 100 AS padded FROM embeddings",
    "source_dedupe": f"""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, lang, {_DIGEST.format("text")})""",
    "citation_ids": f"SELECT doc_id, 'S-' || substr(sha256(doc_id || '|7|' || {_DIGEST.format('text')}), 1, 12) AS citation_id, 'G-' || substr(sha1(doc_id || '|entity|' || source), 1, 10) AS graph_citation_id FROM documents",
    "rag_stats": f"WITH {_W} SELECT count(DISTINCT document_id) AS document_count, count(*) AS chunk_count FROM w",
    "summary_sample_even": f"""WITH {_W}, c AS (SELECT document_id, chunk_index, count(*) OVER (PARTITION BY document_id) AS n FROM w)
        SELECT document_id, chunk_index FROM c WHERE n <= 4 OR list_contains(list_transform([0, 1, 2, 3], lambda p: CAST(round_even(p * (n - 1) / 3.0, 0) AS BIGINT)), chunk_index)""",
    "summary_by_page": f"""WITH {_W}, g AS (SELECT document_id, CASE WHEN chunk_index % 5 <> 4 THEN chunk_index // 2 ELSE 999999 END AS page, min(chunk_index) AS chunk_index FROM w GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM g)
        SELECT document_id, page, chunk_index FROM k WHERE n <= 6 OR list_contains(list_transform([0, 1, 2, 3, 4, 5], lambda p: CAST(round_even(p * (n - 1) / 5.0, 0) AS BIGINT)), i)""",
    "chunk_append_index": f"""WITH {_W}, a AS (SELECT document_id, chunk_index FROM w WHERE chunk_index IN (0, 1)), b AS (SELECT document_id, max(chunk_index) + 1 AS chunk_index FROM a GROUP BY document_id)
        SELECT *, document_id || '_' || chunk_index AS chunk_id FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
    "document_replace": f"""WITH {_W} SELECT CASE WHEN document_id LIKE '%7' THEN 2 ELSE 1 END AS document_version, TIMESTAMP '2024-01-01' AS created_at, CASE WHEN document_id LIKE '%7' THEN {_AS_OF} ELSE TIMESTAMP '2024-01-01' END AS updated_at,
        count(*) AS chunks, count(DISTINCT document_id) AS documents FROM w WHERE document_id NOT LIKE '%7' OR chunk_index < 1 GROUP BY ALL""",
    "graph_chunk_batches": """WITH RECURSIVE s AS (SELECT doc_id, i AS position, least(1500, length(text) - i * 1500) AS n FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1500.0) AS BIGINT)))) AS i FROM documents)),
        f AS (SELECT doc_id, position, 0 AS batch, 1 AS rows_, n AS chars FROM s WHERE position = 0 UNION ALL
        SELECT s.doc_id, s.position, CASE WHEN rows_ >= 5 OR chars + n > 4000 THEN batch + 1 ELSE batch END, CASE WHEN rows_ >= 5 OR chars + n > 4000 THEN 1 ELSE rows_ + 1 END, CASE WHEN rows_ >= 5 OR chars + n > 4000 THEN n ELSE chars + n END FROM f JOIN s ON s.doc_id = f.doc_id AND s.position = f.position + 1)
        SELECT doc_id AS document_id, position, batch FROM f""",
    "working_tfidf_rank": f"WITH {_TURNS}, {_tfidf('u')} SELECT query_id, rank, memory_id, score FROM (SELECT query_id, memory_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, memory_id) AS rank FROM tfidf WHERE round(s, 6) > 0) WHERE rank <= 5",
    "working_retrieve": f"""WITH {_TURNS}, live AS (SELECT * FROM u WHERE {_AGE} <= 60), {_tfidf("live")},
        kw AS (SELECT query_id, memory_id, importance, ts, s, len(list_intersect(list_distinct(qt.t), list_distinct(mt.t))) AS b, len(list_distinct(qt.t)) AS nq, len(list_distinct(mt.t)) AS nm FROM tfidf JOIN live USING (memory_id) JOIN mt USING (memory_id) JOIN qt USING (query_id)),
        sc AS (SELECT query_id, memory_id, round((0.7 * s + 0.3 * (b / nq * 0.8 + b / nm * 0.2)) * greatest(0.1, least(1.0, exp(-{_AGE} / 60))) * (0.8 + 0.4 * importance), 6) AS score FROM kw)
        SELECT query_id, rank, memory_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM sc WHERE score > 0) WHERE rank <= 5""",
    "working_ttl": f"WITH {_TURNS} SELECT memory_id, user_id FROM u WHERE {_AGE} <= 60",
    "working_capacity_keep": f"WITH {_MEM} SELECT memory_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance * greatest(0.1, least(1.0, exp(-{_AGE} / 20000))) DESC, memory_id DESC) AS k FROM m) WHERE k <= 20",
    "working_forget_importance": _forget("working", "importance >= 0.4"),
    "working_forget_time": _forget("working", f"{_AGE} <= 12 * 1440"),
    "working_forget_capacity": f"WITH {_MEM} SELECT memory_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, ts DESC, memory_id) AS k FROM m WHERE memory_type = 'working') WHERE k <= 10",
    "episodic_forget_capacity": _forget("episodic", "importance >= 0.6"),
    "semantic_forget_time": _forget("semantic", "true"),
    "episodic_rank": f"""WITH {_COS}, {_MEM}, p AS (SELECT query_id, id AS memory_id, score AS v FROM (SELECT *, {_NEAR} AS rank FROM n) WHERE rank <= 20),
        s AS (SELECT query_id, memory_id, round((0.8 * v + 0.2 * greatest(0.1, least(1.0, exp(-{_AGE} / 1440 / 7)))) * (0.8 + 0.4 * importance), 6) AS score FROM p JOIN m USING (memory_id))
        SELECT query_id, rank, memory_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""",
    "episodic_time_range": f"WITH {_MEM} SELECT memory_id, user_id, importance FROM m WHERE session_id = 'purchase' AND importance >= 0.3 AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-12 23:59:59'",
    "episodic_keyword_fallback": rf"""WITH {_TURNS}, k AS (SELECT memory_id, content, len(list_intersect(['the', 'de'], list_distinct(regexp_split_to_array(lower(content), '\s+')))) / 2 AS part FROM u)
        SELECT memory_id, round(CASE WHEN part > 0 THEN part ELSE 1.0 END, 6) AS score FROM k WHERE part > 0 OR contains(content, 'the de')""",
    "memory_union_rank": f"""WITH {_MEM}, t AS (SELECT user_id, memory_id, importance, CASE memory_type WHEN 'working' THEN 0 WHEN 'episodic' THEN 1 ELSE 2 END AS o, row_number() OVER (PARTITION BY user_id, memory_type ORDER BY ts DESC, memory_id) AS r FROM m),
        k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY importance DESC, o, r) AS rank FROM t WHERE r <= 5 AND importance >= 0.1) SELECT user_id AS query_id, rank, memory_id, importance FROM k WHERE rank <= 5""",
    "memory_consolidate": f"""WITH {_MEM} SELECT CASE WHEN memory_type = 'working' AND importance >= 0.7 THEN 'episodic' ELSE memory_type END AS memory_type, CASE WHEN memory_type = 'working' AND importance >= 0.7 THEN 'working' END AS consolidated_from,
        count(*) AS memories, round(avg(importance), 6) AS importance FROM m GROUP BY 1, 2""",
    "memory_classify": "SELECT conv_id, turn, CASE WHEN turn % 11 = 0 THEN 'perceptual' WHEN turn % 5 = 0 THEN 'episodic' WHEN turn % 3 = 0 OR length(text) > 80 THEN 'semantic' ELSE 'working' END AS memory_type FROM conversations",
    "memory_stats": f"WITH {_MEM} SELECT memory_type, count(*) AS memories, count(DISTINCT user_id) AS users FROM m GROUP BY memory_type",
    "infer_modality": "SELECT doc_id, ['image', 'audio', 'video', 'text', 'unknown', 'unknown'][CAST(doc_id % 6 + 1 AS INT)] AS modality FROM documents",
    "timestamp_canonical": f"SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', CAST(ts AS TIMESTAMP)) WHEN 1 THEN date_trunc('second', CAST(ts AS TIMESTAMP)) WHEN 2 THEN date_trunc('day', CAST(ts AS TIMESTAMP)) ELSE {_AS_OF} END AS ts FROM events",
    "graph_entities": f"WITH {_ENT} SELECT document_id, position, name FROM ent",
    "graph_relations": f"WITH {_ENT} SELECT document_id, position, source, target FROM rel",
    "graph_nodes": f"WITH {_GRAPH} SELECT document_id, graph_id, normalized_name, ord FROM node",
    "graph_edge_dedupe": f"WITH {_GRAPH} SELECT document_id, count(*) AS edges, min(source_id) AS least_source FROM edge1 GROUP BY document_id",
    "graph_cross_document_entities": f"WITH {_GRAPH} SELECT substr(sha256('default' || chr(0) || 'Concept' || chr(0) || normalized_name), 1, 24) AS canonical_id, normalized_name, count(DISTINCT document_id) AS documents, count(*) AS members FROM node GROUP BY normalized_name HAVING count(DISTINCT document_id) >= 2",
    "graph_one_hop_context": f"""WITH {_GRAPH}, sd AS (SELECT * FROM (SELECT document_id, graph_id AS seed, row_number() OVER (PARTITION BY document_id ORDER BY graph_id) AS k FROM node
            WHERE contains(normalized_name, 'the') OR contains(normalized_name, 'que') OR contains(normalized_name, 'ber') OR contains(lower(name), 'the') OR contains(lower(name), 'que') OR contains(lower(name), 'ber')) WHERE k <= 4),
        met AS (SELECT sd.document_id, source_id, target_id, min([seed, other]) AS o FROM (SELECT document_id, source_id, target_id, source_id AS seed, target_id AS other FROM edge1 UNION ALL SELECT document_id, source_id, target_id, target_id, source_id FROM edge1) x JOIN sd USING (document_id, seed) GROUP BY ALL),
        rk AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY o[1], o[2], source_id, target_id) AS rank FROM met)
        SELECT CAST(document_id AS BIGINT) AS query_id, source_id, 'RELATED_TO' AS type, target_id, rank FROM rk WHERE rank <= 6""",
    "graph_typed_relations_page": f"""WITH {_GRAPH} SELECT edge1.document_id, source_id, target_id, a.name AS source_name, b.name AS target_name FROM edge1 JOIN node a ON a.document_id = edge1.document_id AND a.graph_id = source_id JOIN node b ON b.document_id = edge1.document_id AND b.graph_id = target_id
        ORDER BY edge1.document_id, source_id, target_id LIMIT 50 OFFSET 10""",
    "graph_chapter_tree": f"""WITH {_W}, h AS (SELECT document_id, chunk_index, document_id || '_' || chunk_index AS chunk_id, 'Part ' || (chunk_index // 4) AS a, CASE WHEN chunk_index % 7 <> 6 THEN 'Part ' || (chunk_index // 4) || ' > Section ' || (chunk_index // 2) END AS b FROM w),
        x AS (SELECT document_id, a AS path, 1 AS level, NULL AS parent, chunk_index, CASE WHEN b IS NULL THEN chunk_id END AS own FROM h UNION ALL SELECT document_id, b, 2, a, chunk_index, chunk_id FROM h WHERE b IS NOT NULL),
        g AS (SELECT document_id, path, min(level) AS level, min(parent) AS parent, min(chunk_index) AS f, coalesce(string_agg(own, ',' ORDER BY chunk_index), '') AS chunk_ids FROM x GROUP BY document_id, path)
        SELECT document_id, path, level, parent, row_number() OVER (PARTITION BY document_id ORDER BY f, level, path) - 1 AS ord, chunk_ids FROM g""",
    "graph_delete_counts": f"WITH {_GRAPH} SELECT document_id, coalesce(nodes, 0) AS nodes, coalesce(edges, 0) AS edges FROM (SELECT document_id, count(*) AS nodes FROM node GROUP BY 1) FULL JOIN (SELECT document_id, count(*) AS edges FROM edge1 GROUP BY 1) USING (document_id)",
    "compare_candidates": f"""WITH {_COS}, r AS (SELECT query_id, label AS document_id, id, score FROM (SELECT *, {_NEAR} AS rank FROM n) WHERE rank <= 60),
        t AS (SELECT *, k <= 2 AS protected FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, id) AS k FROM r) WHERE k <= 5),
        x AS (SELECT *, sum(CAST(protected AS INT)) OVER (PARTITION BY query_id) AS base, row_number() OVER (PARTITION BY query_id, protected ORDER BY score DESC, id) AS extra FROM t)
        SELECT query_id, document_id, id, protected FROM x WHERE protected OR extra <= 24 - base""",
    "fit_context_drop": f"WITH {_SRC} SELECT query_id, rank, event_id FROM dropped WHERE protected OR after_ <= 150 OR k = 1",
    "graph_lines_fit": f"WITH {_SRC} SELECT query_id, position, used FROM (SELECT query_id, rank AS position, sum(length(content) + 1) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM src) WHERE used <= 120",
    "comparison_validate": "SELECT item_id, item_id % 3 < 2 AND item_id % 4 < 3 AND item_id % 5 <> 0 AS valid FROM benchmark",
    "import_batch_summary": f"""WITH {_TASK} SELECT b.batch_id, b.user_id, count(t.task_id) AS total, {", ".join(f"count(*) FILTER (t.status = '{s}') AS {s}" for s in ("queued", "running", "retry_wait", "succeeded", "failed", "cancelled"))}
        FROM (SELECT DISTINCT batch_id, user_id FROM task) b LEFT JOIN task t USING (batch_id, user_id) GROUP BY b.batch_id, b.user_id""",
    "import_claim_next": f"""WITH {_TASK}, x AS (SELECT * REPLACE (CASE WHEN status = 'running' AND user_id % 3 > 0 THEN 'succeeded' ELSE status END AS status) FROM task),
        y AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at, task_id) AS k FROM x WHERE (status = 'queued' OR status = 'retry_wait' AND next_attempt_at <= TIMESTAMP '2024-01-20') AND user_id NOT IN (SELECT user_id FROM x WHERE status = 'running') AND user_id NOT IN (1, 2))
        SELECT task_id, user_id, status FROM y WHERE k = 1 ORDER BY created_at, task_id LIMIT 20""",
    "import_cancel_outcome": f"WITH {_TASK} SELECT task_id, CASE WHEN status IN ('queued', 'retry_wait') THEN 'cancelled' WHEN status = 'running' AND stage = 'committing' THEN 'not_cancellable' WHEN status = 'running' THEN 'cancel_requested' ELSE 'unchanged' END AS outcome FROM task",
    "import_retry_backoff": f"""WITH {_TASK}, x AS (SELECT *, task_id % 2 = 1 AND status = 'running' AS hit, task_id % 7 <> 0 AND auto_retry_count < 3 AS again FROM task)
        SELECT task_id, CASE WHEN hit AND again THEN 'retry_wait' WHEN hit THEN 'failed' ELSE status END AS status, auto_retry_count + CASE WHEN hit AND again THEN 1 ELSE 0 END AS auto_retry_count,
        CASE WHEN hit AND again THEN {_AS_OF} + to_seconds([2, 10, 30][CAST(least(auto_retry_count + 1, 3) AS INT)]) WHEN NOT hit THEN next_attempt_at END AS next_attempt_at, CASE WHEN hit THEN 'rag_connection' END AS error_code FROM x""",
    "import_batch_limits": """SELECT doc_id // 15 AS batch_id, count(*) AS files, CAST(sum(n_chars * 4096) AS BIGINT) AS bytes, CASE WHEN count(*) > 20 THEN 'too many files' WHEN bool_or(doc_id % 97 = 5) THEN 'bad name' WHEN max(n_chars * 4096) > 104857600 THEN 'file too large' WHEN sum(n_chars * 4096) > 524288000 THEN 'batch too large' END AS problem FROM documents GROUP BY 1""",
    "import_progress_monotone": """WITH x AS (SELECT user_id AS task_id, event_id AS position, event_id % 6 AS s, least(1.0, (event_id % 10) / 8) AS r FROM events WHERE event_id % 50 <> 4 OR event_id % 6 <> 4),
        y AS (SELECT *, CASE s WHEN 0 THEN 10 + floor(15 * r) WHEN 1 THEN 25 + floor(15 * r) WHEN 2 THEN 40 + floor(40 * r) WHEN 3 THEN 80 + floor(12 * r) WHEN 4 THEN 99 END AS p FROM x)
        SELECT task_id, position, CAST(greatest(10, max(p) OVER (PARTITION BY task_id ORDER BY position)) AS INT) AS progress FROM y""",
    "library_latest": f"""WITH {_REC}, x AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, document_id ORDER BY position DESC) AS k FROM r) WHERE k = 1)
        SELECT user_id, document_id, row_number() OVER (PARTITION BY user_id ORDER BY loaded_at IS NOT NULL DESC, loaded_at DESC NULLS LAST, CASE WHEN loaded_at IS NOT NULL THEN document_id END DESC NULLS LAST, document_id) AS place, name FROM x""",
    "document_choices": f"WITH {_REC} SELECT user_id, document_id, min(position) AS position FROM r GROUP BY user_id, document_id",
    "history_delete_cascade": f"""WITH {_REC} SELECT count(*) AS rows, 'documents' AS kind FROM r WHERE document_id <> '4' UNION ALL SELECT count(*), 'questions' FROM r WHERE document_id <> '4' AND NOT (position % 2 = 0 AND position % 5 = 4)""",
    "history_recall": """WITH c AS (SELECT role, conv_id * 1000 + turn AS position, text FROM conversations), a AS (SELECT 0 AS kind, doc_id AS position, source AS text FROM documents UNION ALL SELECT 1, position, text FROM c WHERE role = 'user' UNION ALL SELECT 2, position, text FROM c WHERE role = 'assistant')
        SELECT * FROM (SELECT * FROM a WHERE contains(text, 'c1') ORDER BY kind, position LIMIT 30) UNION ALL SELECT * FROM (SELECT * FROM a WHERE contains(text, 'eau') ORDER BY kind, position LIMIT 30)""",
    "report_recent": f"WITH {_REC} SELECT user_id, position, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position DESC) AS place FROM r) WHERE place <= 5",
    "session_expiry": "SELECT user_id FROM events GROUP BY user_id HAVING max(CAST(ts AS TIMESTAMP)) <= TIMESTAMP '2024-01-30 10:00:00'",
    "golden_trace_eval": """WITH b AS (SELECT item_id, text, text || chr(10) || chr(10) || 'doc-1 the prompt' AS prompt, 'doc-2 answer ' || text AS output FROM benchmark),
        f AS (SELECT item_id, list_concat(CASE WHEN 2 < item_id % 3 + 1 THEN ['calls'] ELSE [] END,
            list_transform(list_filter(['doc-1', 'doc-' || (item_id % 4)], lambda x: NOT contains(prompt || chr(10) || chr(10) || output, x)), lambda x: 'document:' || x), list_transform(list_filter(['que'], lambda x: contains(prompt, x)), lambda x: 'leak:' || x),
            list_transform(list_filter(['answer', 'er'], lambda x: NOT contains(output, x)), lambda x: 'answer:' || x), list_transform(list_filter(['the'], lambda x: NOT contains(prompt, x)), lambda x: 'prompt:' || x)) AS fs FROM b)
        SELECT 'case-' || item_id AS case_id, len(fs) = 0 AS passed, coalesce(array_to_string(fs, ';'), '') AS failures FROM f""",
    "error_redaction": """SELECT event_id, ['GET https://***@host/x?api_key=***&x=1 failed', 'Authorization: ***, retry', '{"password": ***, "n": 1}', 'token=***; ok',
        'auth=***&passwd=***', '{"client_secret": ***, "n": 2}', 'db.password=***; retry', 'x_key:***]', 'secret="*** closed', 'sent Bearer ***'][CAST(event_id % 10 + 1 AS INT)] || ' #' || event_id AS message FROM events""",
    "tool_call_parse": """SELECT event_id, 0 AS n, 'search' AS name, 'query=' || user_id AS arguments FROM events UNION ALL SELECT event_id, 1, 'calculator', '1+' || event_id FROM events""",
}
_DOCS = "ds AS (SELECT doc_id AS id, text FROM documents)"
_SQL["hybrid_rank"] = f"""WITH {_LEX}, {_DOCS}, {_near("ds", 15)}, ids AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark, documents WHERE item_id % 20 = 0),
    b AS (SELECT query_id, id, round(0.7::DOUBLE * greatest(0, least(1, coalesce(score, 0))) + (1 - 0.7::DOUBLE) * coalesce(l, 0), 6) AS score FROM ids LEFT JOIN pool USING (query_id, id) LEFT JOIN lex USING (query_id, id))
    SELECT query_id, rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b) WHERE rank <= 15"""
_SQL["mmr_select"] = f"""WITH RECURSIVE {_DOCS}, {_near("ds", 15)}, c AS (SELECT query_id, id, greatest(0, least(1, score)) AS score, {_TOK.format("text")} AS t FROM pool JOIN documents ON doc_id = id),
    sim AS (SELECT a.query_id, a.id AS x, b.id AS y, CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) ELSE 0 END AS j FROM c a JOIN c b USING (query_id)),
    s(query_id, k, ids) AS (SELECT DISTINCT query_id, 0, CAST([] AS BIGINT[]) FROM c UNION ALL
      SELECT query_id, k + 1, list_append(ids, pick) FROM (SELECT s.query_id, s.k, s.ids, min_by(c.id, [-round(0.75::DOUBLE * c.score - 0.25::DOUBLE * coalesce((SELECT max(j) FROM sim WHERE sim.query_id = s.query_id AND sim.x = c.id AND list_contains(s.ids, sim.y)), 0), 9), c.id]) AS pick
        FROM s JOIN c ON c.query_id = s.query_id WHERE s.k < 5 AND NOT list_contains(s.ids, c.id) GROUP BY s.query_id, s.k, s.ids))
    SELECT query_id, unnest(range(1, 6)) AS rank, unnest(ids) AS id FROM s WHERE k = 5"""
_TU = "tu AS (SELECT memory_id AS id, content AS text FROM u)"
_FUSED = "round((0.7::DOUBLE * coalesce(v, 0) + 0.3::DOUBLE * coalesce(g, 0)) * (0.8::DOUBLE + 0.4::DOUBLE * importance), 6)"
_SQL["semantic_fuse"] = f"""WITH {_TURNS}, {_TU}, {_near("tu", 10)}, {_WORDS}, k AS (SELECT query_id, memory_id, importance, g FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, memory_id) AS r FROM kw WHERE g > 0) WHERE r <= 10),
    v AS (SELECT query_id, memory_id, score AS v, importance FROM pool JOIN u ON memory_id = id),
    s AS (SELECT query_id, memory_id, {_FUSED} AS score FROM (SELECT query_id, memory_id, v, g, coalesce(v.importance, k.importance) AS importance FROM v FULL JOIN k USING (query_id, memory_id)))
    SELECT query_id, rank, memory_id, score FROM (SELECT *, {_BEST} AS rank FROM s WHERE score > 0) WHERE rank <= 8"""
_SQL["semantic_keyword_search"] = f"WITH {_TURNS}, {_WORDS} SELECT query_id, rank, memory_id, score FROM (SELECT query_id, memory_id, g AS score, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, memory_id) AS rank FROM kw WHERE g > 0 AND importance >= 0.5) WHERE rank <= 10"
_SQL["semantic_retrieve"] = f"""WITH {_TURNS}, {_TU}, {_near("tu", 10)}, {_WORDS}, k AS (SELECT query_id, memory_id, importance, g FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, memory_id) AS r FROM kw WHERE g > 0 AND importance >= 0.8) WHERE r <= 10),
    v0 AS (SELECT query_id, memory_id, importance, score AS v, 'vector' AS backend FROM pool JOIN u ON memory_id = id WHERE importance >= 0.8),
    v AS (SELECT * FROM v0 UNION ALL SELECT query_id, memory_id, importance, g, 'fallback_keyword' FROM k WHERE query_id NOT IN (SELECT query_id FROM v0)),
    s AS (SELECT query_id, memory_id, backend, {_FUSED} AS score FROM (SELECT query_id, memory_id, v, g, backend, coalesce(v.importance, k.importance) AS importance FROM v FULL JOIN k USING (query_id, memory_id)))
    SELECT query_id, rank, memory_id, score, coalesce(backend, 'keyword') AS backend FROM (SELECT *, {_BEST} AS rank FROM s WHERE score > 0) WHERE rank <= 5"""
_SQL["semantic_add"] = rf"""WITH {_TURNS}, e0 AS (SELECT memory_id, list_slice(regexp_extract_all(content, '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9_]{{2,}}'), 1, 10) AS ws FROM u),
    e1 AS (SELECT memory_id, string_agg(w, ' ' ORDER BY i) AS entities, count(*) AS n FROM (SELECT memory_id, w, min(i) AS i FROM (SELECT memory_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM e0) GROUP BY memory_id, w) GROUP BY memory_id)
    SELECT memory_id, coalesce(entities, '') AS entities, coalesce(n, 0) AS entity_count, greatest(0, coalesce(n, 0) - 1) AS relation_count, 384 AS dimension FROM u LEFT JOIN e1 USING (memory_id)"""
_SQL |= {
    "namespace_scope": f"WITH {_PTS} SELECT * FROM pts WHERE namespace = 'ns1' AND document_id IN ('1', '3')",
    "namespace_remove": f"""WITH {_PTS} SELECT 'left' AS kind, namespace, document_id, count(*) AS points FROM pts WHERE NOT (namespace = 'ns1' AND document_id IN ('1', '2')) GROUP BY ALL
        UNION ALL SELECT 'removed', 'ns1', document_id, count(*) FROM pts WHERE namespace = 'ns1' AND document_id IN ('1', '2') GROUP BY ALL UNION ALL SELECT 'cleared', namespace, document_id, count(*) FROM pts WHERE namespace <> 'ns0' GROUP BY ALL""",
    "document_ids": f"WITH {_W} SELECT DISTINCT document_id FROM w",
    "ordered_chunks": f"WITH {_W} SELECT document_id, document_id || '_' || chunk_index AS chunk_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS place FROM w",
    "points_of_arrays": "SELECT CASE WHEN vec_id % 2 = 0 THEN CAST(vec_id AS VARCHAR) ELSE CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS VARCHAR) END AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS first, label AS metadata FROM embeddings",
    "cosine_neighbours": "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT a.id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM e a JOIN e b ON b.id = a.id + 1",
    "vector_dimension_strict": "SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
    "segments_prepared": f"""WITH {_W}, a AS (SELECT document_id, 0 AS seg, chunk_index AS i, content FROM w UNION ALL SELECT CAST(doc_id AS VARCHAR), 1, 0, 'note on ' || source FROM documents WHERE source IS NOT NULL),
        b AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY seg, i) - 1 AS chunk_index FROM a) SELECT document_id, chunk_index, document_id || '_' || chunk_index AS chunk_id, CAST(seg + 1 AS VARCHAR) AS page_number, length(content) AS n_chars FROM b""",
    "headed_paragraphs": r"""SELECT doc_id, position, content, heading_path, level FROM (SELECT doc_id, unnest([0, 1, 2, 3, 4]) AS position, unnest(['start', 'one' || chr(10) || 'two', 'three', 'four', CAST(doc_id AS VARCHAR)]) AS content,
        unnest(['', source, source, source || ' > ' || lang, 'End']) AS heading_path, unnest([0, 1, 1, 2, 1]) AS level FROM documents)""",
    "label_ids": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) ELSE source END AS label_id FROM documents",
    "tool_arguments": """SELECT event_id, 'kind' AS name, event_type AS value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'user', CAST(user_id AS VARCHAR) FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'input', event_type FROM events WHERE event_id % 2 = 1""",
    "redacted_urls": "SELECT event_id, 'https://host/x?token=***&user=' || user_id || '&API_KEY=***' AS url FROM events",
    "graph_redaction": """SELECT event_id, ['no route to [REDACTED_NEO4J_URI]', '[REDACTED_SECRET] refused', '[REDACTED_SECRET] [REDACTED_NEO4J_URI]', 'fine',
        'url=[REDACTED_NEO4J_URI] down', 'config:[REDACTED_NEO4J_URI]', 'cfg.[REDACTED_SECRET]', '(user=x,[REDACTED_SECRET]', 'a=1;[REDACTED_SECRET]', '{[REDACTED_SECRET] x', '[REDACTED_SECRET]'][CAST(event_id % 11 + 1 AS INT)] || ' #' || event_id AS message FROM events""",
    "transient_failures": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id % 4 IN (1, 2) ELSE event_id % 2 = 0 END AS transient FROM events""",
    "stable_point_ids": """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('default:' || doc_id || ':' || source)) AS h FROM documents)
        SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST(('0x' || substr(h, 17, 1))::INT % 4 + 1 AS INT)] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""",
    "graph_resolve": f"""WITH {_GRAPH}, x AS (SELECT document_id, source, CAST(document_id AS BIGINT) % 7 = 3 AS lost FROM rel) SELECT document_id, CASE WHEN lost THEN 'dangling' ELSE 'edge' END AS kind, count(*) AS relations FROM x GROUP BY ALL""",
    "graph_replace": rf"""WITH {_GRAPH}, 
        f0 AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, list_slice(regexp_extract_all(coalesce(text, ''), '[\x{{4e00}}-\x{{9fff}}A-Za-z0-9_]{{2,}}'), 1, 4) AS ws FROM documents WHERE doc_id % 10 = 3),
        f1 AS (SELECT document_id, name, min(i) AS i FROM (SELECT document_id, unnest(ws) AS name, generate_subscripts(ws, 1) AS i FROM f0) GROUP BY document_id, name), f2 AS (SELECT document_id, i, name, {_NORMAL.format("name")} AS normalized_name FROM f1),
        f3 AS (SELECT DISTINCT document_id, a, b FROM (SELECT document_id, normalized_name AS a, lead(normalized_name) OVER (PARTITION BY document_id ORDER BY i) AS b FROM f2) WHERE b IS NOT NULL),
        an AS (SELECT document_id, normalized_name FROM node WHERE CAST(document_id AS BIGINT) % 10 NOT IN (3, 4) UNION SELECT document_id, normalized_name FROM f2)
        SELECT 'nodes' AS kind, count(*) AS rows FROM an UNION ALL SELECT 'edges', (SELECT count(*) FROM edge1 WHERE CAST(document_id AS BIGINT) % 10 NOT IN (3, 4)) + (SELECT count(*) FROM f3)
        UNION ALL SELECT 'canonical', count(DISTINCT normalized_name) FROM an UNION ALL SELECT 'orphans', count(DISTINCT normalized_name) FROM node WHERE normalized_name NOT IN (SELECT normalized_name FROM an)""",
    "graph_status": f"""WITH {_BLD} SELECT document_id, coalesce(status, 'pending') AS status, coalesce(status, '') NOT IN ('failed', 'cleanup_pending') AS success, build_id, coalesce(attempt_count, 0) AS attempt_count, coalesce(llm_attempt_count, 0) AS llm_attempt_count FROM ids LEFT JOIN bld USING (document_id)""",
    "graph_by_status": f"WITH {_BLD} SELECT document_id, build_id FROM bld WHERE status = 'failed'",
    "graph_deleted": f"WITH {_BLD} SELECT document_id, CASE WHEN document_id LIKE '%11' THEN 'cleanup_pending' WHEN document_id LIKE '%1' THEN 'deleted' ELSE status END AS status FROM bld",
    "graph_recovered": f"WITH {_BLD} SELECT document_id, CASE WHEN status <> 'building' THEN status WHEN document_id LIKE '%0' THEN 'ready' ELSE 'failed' END AS status FROM bld",
    "graph_state_upsert": f"""WITH {_BLD}, n AS (SELECT document_id FROM ids WHERE document_id LIKE '%4' OR document_id LIKE '%5') SELECT * FROM bld WHERE document_id NOT IN (SELECT document_id FROM n)
        UNION ALL SELECT document_id, 'ready', build_id, coalesce(attempt_count, 0), 9 FROM n LEFT JOIN bld USING (document_id)""",
    "graph_page": f"WITH {_GRAPH} SELECT document_id, graph_id FROM node ORDER BY document_id, graph_id LIMIT 201 OFFSET 100",
    "graph_chunks_normalized": f"""WITH {_W}, x AS (SELECT document_id, chunk_index, document_id || '_' || chunk_index AS chunk_id, chunk_index % 7 = 6 AS other, chunk_index = 0 AND CAST(document_id AS BIGINT) % 3 = 0 AS twice FROM w WHERE chunk_index % 9 <> 8)
        SELECT document_id, chunk_id, CASE WHEN other THEN 'belongs to another document' WHEN twice THEN 'duplicate chunk_id' ELSE '' END AS problem FROM x""",
    "extraction_problems": "SELECT CAST(doc_id AS VARCHAR) AS document_id, 'not a graph answer' AS problem FROM documents WHERE doc_id % 10 = 9",
    "extraction_entities": f"WITH {_XNAMES} SELECT document_id, 'Concept' AS label, lower(lang) AS normalized_name FROM xn UNION SELECT document_id, 'Concept', lower(source) FROM xn UNION SELECT document_id, 'Person', 'ada' FROM xn",
    "extraction_relations": f"""WITH {_XNAMES} SELECT document_id, CASE WHEN doc_id % 4 = 2 THEN 'EATS' ELSE 'IS_A' END AS type, CASE WHEN doc_id % 4 = 0 THEN 1.0::DOUBLE END AS confidence, ['', 'dangling', 'unsupported', 'unknown chunk'][CAST(doc_id % 4 + 1 AS INT)] AS problem FROM xn""",
    "extraction_mentions": f"WITH {_XNAMES} SELECT document_id, 'c0' AS source_id, 'MENTIONS' AS type, 1 AS mentions, 0.5::DOUBLE AS confidence FROM xn",
    "comparison_markdown": """SELECT doc_id, '## 共同点' || chr(10) || '- ' || lang || ' [S-1, S-2]' || chr(10) || chr(10) || '## 差异点' || chr(10) || '- **' || source || '**' || chr(10) || '  - `a`: x' || chr(10) || chr(10) || '## 逐文档依据' || chr(10) || '- 暂无' || chr(10) || chr(10) || '## 信息缺失' || chr(10) || '- `' || doc_id || '`: n' AS markdown FROM documents""",
    "answer_text": """SELECT doc_id, '🤖 RAG回答:' || chr(10) || lang || chr(10) || chr(10) || '📚 参考知识条数: 2' || CASE WHEN doc_id % 3 = 0 THEN chr(10) || '⚠️ 上下文已截断。' ELSE '' END || chr(10) || '📌 参考来源:' || chr(10) || '[S-1] ' || source
        || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '图谱参考：' || chr(10) || '[G-1] 文档 ' || doc_id || ' | entity: ' || source ELSE '' END AS answer FROM documents""",
    "memory_snapshot_difference": f"WITH {_MEM} SELECT memory_id FROM m WHERE user_id = 3 AND importance < 0.6",
    "memory_clear": f"WITH {_MEM} SELECT CASE WHEN memory_type = 'semantic' THEN 'removed' ELSE 'left' END AS kind, memory_type, count(*) AS memories FROM m GROUP BY ALL",
    "memory_summary": f"""WITH {_MEM}, t AS (SELECT unnest([0, 1, 2]) AS position, unnest(['working', 'episodic', 'semantic']) AS memory_type) SELECT position, '- ' || memory_type || ': ' || (SELECT count(*) FROM m WHERE m.memory_type = t.memory_type) || ' 条记忆' AS line FROM t""",
    "memory_insert_once": f"WITH {_MEM} SELECT memory_id, user_id, CASE WHEN memory_id % 3 = 0 THEN importance ELSE 0.1 END AS importance FROM m WHERE memory_id % 3 = 0 OR memory_id % 2 = 0",
    "episodic_items": f"""WITH {_MEM} SELECT CAST(memory_id AS VARCHAR) AS memory_id, CASE WHEN memory_id % 3 = 0 THEN 'told' ELSE content END AS content, 'episodic' AS memory_type, CASE WHEN memory_id % 5 = 0 THEN 0.9::DOUBLE ELSE 0.5 END AS importance, 0.25::DOUBLE AS retrieval_score FROM m WHERE memory_type = 'episodic'""",
    "history_upsert": f"""WITH {_REC}, l AS (SELECT user_id, document_id, max(position) AS position, max_by(name, position) AS name FROM r GROUP BY ALL), n AS (SELECT DISTINCT user_id, document_id FROM r WHERE position % 26 = 4)
        SELECT l.user_id, l.document_id, position, CASE WHEN n.user_id IS NULL THEN name ELSE 'new' END AS name FROM l LEFT JOIN n ON n.user_id = l.user_id AND n.document_id = l.document_id""",
    "history_clear": f"WITH {_REC} SELECT 'documents' AS kind, count(*) AS removed FROM r WHERE position % 3 = 0 UNION ALL SELECT 'questions', count(*) FROM r WHERE position % 3 = 1",
    "history_note": "SELECT 'note-' || user_id || '-' || event_id AS memory_id, CASE WHEN event_id % 2 = 0 THEN 'what: ' ELSE '' END || event_type AS content, 0.85::DOUBLE AS importance, 'semantic' AS memory_type FROM events",
    "learning_stats": f"WITH {_REC} SELECT user_id, count(DISTINCT document_id) AS documents, count(*) FILTER (position % 3 = 1) AS questions, count(*) FILTER (position % 5 = 1) AS notes FROM r GROUP BY user_id",
    "history_load": """SELECT event_id AS user_id, CASE event_id % 5 WHEN 0 THEN 2 WHEN 3 THEN 0 END AS documents, CASE event_id % 5 WHEN 0 THEN 1 WHEN 3 THEN 0 END AS questions, CASE event_id % 5 WHEN 0 THEN 0 WHEN 3 THEN 3 END AS notes FROM events""",
    "import_transitions": f"""WITH {_TASK}, x AS (SELECT *, CASE WHEN task_id % 12 = 1 THEN created_at END AS asked FROM task),
        a AS (SELECT 'commit' AS kind, status, CASE WHEN status = 'running' AND stage <> 'committing' AND asked IS NULL THEN 'committing' ELSE stage END AS stage, auto_retry_count AS n, NOT (status = 'running' AND stage <> 'committing' AND asked IS NULL) AS no FROM x
          UNION ALL SELECT 'succeed', CASE WHEN status = 'running' THEN 'succeeded' ELSE status END, stage, auto_retry_count, status <> 'running' FROM x
          UNION ALL SELECT 'cancel', CASE WHEN status = 'running' AND asked IS NOT NULL THEN 'cancelled' ELSE status END, CASE WHEN status = 'running' AND asked IS NOT NULL THEN 'cancelled' ELSE stage END, auto_retry_count, NOT (status = 'running' AND asked IS NOT NULL) FROM x
          UNION ALL SELECT 'release', CASE WHEN status = 'running' THEN 'queued' ELSE status END, stage, CASE WHEN status = 'running' THEN greatest(0, auto_retry_count - 1) ELSE auto_retry_count END, status <> 'running' FROM x)
        SELECT kind, status, stage, count(*) AS tasks, CAST(sum(n) AS BIGINT) AS retries FROM a GROUP BY ALL UNION ALL SELECT kind, 'refused', '', count(*) FILTER (no), 0 FROM a GROUP BY kind""",
    "import_manual_retry": f"WITH {_TASK} SELECT task_id, CASE WHEN batch_id % 2 = 0 AND status = 'failed' THEN 'queued' ELSE status END AS status, CASE WHEN batch_id % 2 = 0 AND status = 'failed' THEN 0 ELSE auto_retry_count END AS auto_retry_count, CAST(batch_id % 2 = 0 AND status = 'failed' AS INT) AS manual_retry_count FROM task",
    "import_recover": f"WITH {_TASK} SELECT task_id, CASE WHEN status <> 'running' THEN status WHEN task_id % 5 = 0 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN status = 'running' AND task_id % 5 <> 0 THEN 'staged_file_missing' END AS error_code FROM task",
    "import_active_users": f"WITH {_TASK} SELECT DISTINCT user_id FROM task WHERE status IN ('queued', 'running', 'retry_wait')",
    "context_budgets": r"""WITH t AS (SELECT item_id, length(regexp_replace(text, '[^\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}]', '', 'g')) + len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS tokens FROM benchmark) SELECT item_id, tokens, 6656 - tokens AS room FROM t""",
    "rag_stats_text": f"""WITH {_W} SELECT '📊 RAG知识库统计:' || chr(10) || '- collection_name: rag' || chr(10) || '- rag_namespace: default' || chr(10) || '- document_count: ' || count(DISTINCT document_id) || chr(10) || '- chunk_count: ' || count(*) || chr(10) || '- dimension: 384' AS text FROM w""",
    "import_submit": f"""WITH f AS (SELECT doc_id, doc_id // 15 AS batch_id, CASE WHEN doc_id % 150 = 3 THEN 9 ELSE (doc_id // 15) % 4 END AS user_id, doc_id % 97 = 5 AS bad, n_chars * 4096 AS n FROM documents),
        b AS (SELECT batch_id, count(*) AS files, CASE WHEN count(DISTINCT user_id) <> 1 THEN 'several users' WHEN count(*) > 20 THEN 'too many files' WHEN bool_or(bad) THEN 'bad name' WHEN max(n) > 104857600 THEN 'file too large' WHEN sum(n) > 524288000 THEN 'batch too large' END AS problem FROM f GROUP BY batch_id)
        SELECT batch_id, coalesce(problem, '.md queued') AS outcome, CASE WHEN problem IS NULL THEN files ELSE 0 END AS tasks, CASE WHEN problem IS NULL THEN {_AS_OF} END AS created_at FROM b""",
    "import_chunking_boundary": """WITH e AS (SELECT user_id AS task_id, CAST(event_id AS DOUBLE) AS position, ['parsing', 'embedding', 'persisting'][CAST(event_id % 3 + 1 AS INT)] AS stage, event_id % 10 AS completed, event_id % 7 + 10 AS total FROM events),
        f AS (SELECT task_id, min(position) AS position, min_by(total, position) AS total FROM e WHERE stage = 'embedding' GROUP BY task_id) SELECT * FROM e WHERE stage <> 'persisting' UNION ALL SELECT task_id, position - 0.5, 'chunking', total, total FROM f""",
    "old_files_scan": """WITH k AS (SELECT unnest(['history', 'documents', 'rag_cache', 'reports', 'memory', 'skipped']) AS kind), f AS (SELECT ['documents', 'history', 'rag_cache', 'reports', 'memory', 'skipped', 'documents', 'skipped'][CAST(doc_id % 8 + 1 AS INT)] AS kind, n_chars FROM documents)
        SELECT kind, count(n_chars) AS files, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes FROM k LEFT JOIN f USING (kind) GROUP BY kind""",
}
def _search(least: float = -1) -> str:
    """The five best chunks of each question that score at least ``least``, as ``hit``."""
    return f"""{_P}, pt AS (SELECT document_id || '_' || chunk_index AS key, content AS text FROM p UNION ALL SELECT 'q' || item_id, text FROM benchmark WHERE item_id % 20 = 0), {_embedding("key", "pt")},
    unit AS (SELECT key, idx, x / n AS x FROM raw JOIN nrm USING (key)),
    sc AS (SELECT q.key AS q, c.key AS id, round(sum(q.x * c.x), 6) AS score FROM unit q JOIN unit c ON q.idx = c.idx WHERE q.key[1] = 'q' AND c.key[1] <> 'q' GROUP BY ALL HAVING score >= {least}),
    pool AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, CAST(split_part(id, '_', 1) AS BIGINT), CAST(split_part(id, '_', 2) AS BIGINT)) AS r FROM sc QUALIFY r <= 15),
    full_ AS (SELECT q, r, id, score, document_id, content, {_DIGEST.format("content")} AS digest FROM pool JOIN p ON id = document_id || '_' || chunk_index),
    one AS (SELECT * FROM full_ QUALIFY row_number() OVER (PARTITION BY q, document_id, digest ORDER BY r) = 1),
    hit AS (SELECT CAST(substr(q, 2) AS BIGINT) AS query_id, row_number() OVER (PARTITION BY q ORDER BY r) AS rank, id, document_id, content, score, 'S-' || substr(sha256(document_id || '||' || digest), 1, 12) AS citation_id FROM one QUALIFY rank <= 5)"""


def _prompt(instruction: str, context: str, query: str) -> str:
    return f"'{instruction}' || chr(10) || chr(10) || {context} || chr(10) || chr(10) || 'Question: ' || coalesce({query}, '')"


_SQL["document_search"] = f"WITH {_search()} SELECT query_id, rank, id AS chunk_id, score, citation_id FROM hit"
_CITED = "'[' || citation_id || ' | ' || document_id || ']' || chr(10) || content"
_SQL["joint_answer"] = f"""WITH {_search(0.12)}, c AS (SELECT query_id, rank, score, citation_id, {_CITED} AS content FROM hit),
    f AS (SELECT *, sum(length(content) + 2) OVER o - 2 AS after_, row_number() OVER o AS k FROM c WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, rank ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context, list_sort(list(DISTINCT citation_id)) AS sources FROM f WHERE after_ <= {budget(len(JOINT), 4000)} OR k = 1 GROUP BY query_id)
    SELECT query_id, sha256({_prompt(JOINT, "context", "text")}) AS answer, array_to_string(sources, ',') AS sources, false AS truncated FROM g JOIN benchmark ON item_id = query_id"""
_SQL["citation_list"] = f"""WITH {_search()}, v AS (SELECT query_id, rank, CASE WHEN CAST(document_id AS BIGINT) % 2 = 0 THEN document_id || '.md' ELSE '{NO_FILE}' END AS file, format('{{:.4f}}', score) AS score,
        regexp_replace(array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: {_strip("x")}), lambda x: length(x) > 0), ' '), ' {{2,}}', ' ', 'g') AS t FROM hit),
    w AS (SELECT *, CASE WHEN length(t) > 260 THEN t[1:260] || '...' ELSE t END AS text FROM v),
    s AS (SELECT query_id, 'normal' AS style, string_agg(rank || '. 《' || file || '》，第 {NO_PAGE} 页。' || chr(10) || '相关度：' || score || chr(10) || '引用内容：' || text || chr(10), chr(10) ORDER BY rank) AS entries FROM w GROUP BY query_id
          UNION ALL SELECT query_id, 'markdown', string_agg('> **引用 ' || rank || '**  ' || chr(10) || '> **来源**：《' || file || '》，第 {NO_PAGE} 页  ' || chr(10) || '> **相关度**：' || score || '  ' || chr(10) || '> **内容**：' || text || chr(10), chr(10) ORDER BY rank) FROM w GROUP BY query_id),
    k AS (SELECT item_id, text, style FROM benchmark, (SELECT unnest(['normal', 'markdown']) AS style) WHERE item_id % 20 = 0)
    SELECT item_id AS query_id, k.style, CASE WHEN entries IS NULL THEN '🔍 未找到与 ' || chr(39) || text || chr(39) || ' 相关的引用内容' ELSE '{CITATIONS}' || chr(10) || chr(10) || '{KEYWORDS}' || text || chr(10) || chr(10) || entries END AS text
    FROM k LEFT JOIN s ON s.query_id = item_id AND s.style = k.style"""
_SQL["document_summaries"] = f"""WITH {_P}, c0 AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) - 1 AS i, count(*) OVER (PARTITION BY document_id) AS n FROM p),
    c1 AS (SELECT document_id, chunk_index, content FROM c0 WHERE n <= 12 OR list_contains(list_transform(range(12), lambda j: CAST(round_even(j * (n - 1) / 11.0, 0) AS BIGINT)), i)),
    c2 AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS k, count(*) OVER (PARTITION BY document_id) AS m, content, 'S-' || substr(sha256(document_id || '||' || {_DIGEST.format("content")}), 1, 12) AS citation_id FROM c1),
    c3 AS (SELECT document_id, k, {_CITED} AS content, k = 1 OR k = m OR k = (m + 1) // 2 AS protected FROM c2),
    c4 AS (SELECT *, sum(length(content) + 2) OVER o - 2 AS after_, row_number() OVER o AS r FROM c3 WINDOW o AS (PARTITION BY document_id ORDER BY protected DESC, k ROWS UNBOUNDED PRECEDING)),
    c5 AS (SELECT document_id, string_agg(content, chr(10) || chr(10) ORDER BY k) AS context FROM c4 WHERE protected OR after_ <= {budget(len(SUMMARY))} OR r = 1 GROUP BY document_id)
    SELECT CAST(item_id AS VARCHAR) AS query_id, document_id, sha256({_prompt(SUMMARY, "context", "text")}) AS summary FROM c5, benchmark WHERE item_id % 20 = 0"""
_SQL["graph_context_lines"] = _SQL["graph_one_hop_context"].replace("k <= 4", "k <= 8").rsplit("SELECT CAST(document_id AS BIGINT)", 1)[0] + """, ln AS (SELECT rk.document_id, rank, a.name || ' RELATED_TO ' || b.name AS line FROM rk JOIN node a ON a.graph_id = source_id JOIN node b ON b.graph_id = target_id WHERE rank <= 16)
    SELECT CAST(document_id AS BIGINT) AS query_id, rank AS position, line FROM ln QUALIFY sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY rank) <= 200"""
_SQL["memory_forget_all"] = f"""WITH {_MEM} SELECT memory_id, memory_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, memory_type ORDER BY importance DESC, ts DESC, memory_id) AS k FROM m)
    WHERE CASE memory_type WHEN 'working' THEN k <= 10 WHEN 'episodic' THEN importance >= 0.6 ELSE true END"""
_SQL["memory_forgotten"] = f"""WITH {_MEM} SELECT memory_type, count(*) AS removed, 'age' AS strategy FROM m WHERE memory_type <> 'semantic' AND {_AGE} > 12 * 1440 GROUP BY memory_type
    UNION ALL SELECT memory_type, count(*), 'importance' FROM m WHERE importance < 0.4 GROUP BY memory_type"""
_SQL["memory_found_text"] = f"""{_SQL["memory_union_rank"].rsplit("SELECT user_id AS query_id", 1)[0]}, b AS (SELECT k.user_id, rank, MAP {TYPE_NAMES}[memory_type] AS kind, content, m.importance FROM k JOIN m USING (memory_id) WHERE rank <= 5),
    l AS (SELECT user_id, count(*) AS n, string_agg(rank || '. [' || kind || '] ' || CASE WHEN length(content) > 80 THEN content[1:80] || '...' ELSE content END || ' (重要性: ' || format('{{:.2f}}', importance::DOUBLE) || ')', chr(10) ORDER BY rank) AS lines FROM b GROUP BY user_id),
    q AS (SELECT DISTINCT user_id FROM m UNION ALL SELECT DISTINCT user_id + 1000000 FROM m WHERE user_id % 10 = 0)
    SELECT q.user_id AS query_id, CASE WHEN n IS NULL THEN '🔍 未找到与 ' || chr(39) || 'user ' || q.user_id || chr(39) || ' 相关的记忆' ELSE '🔍 找到 ' || n || ' 条相关记忆:' || chr(10) || lines END AS text FROM q LEFT JOIN l ON l.user_id = q.user_id"""


_LIBRARY = f"""d0 AS (SELECT doc_id, lang, source, {_strip("CASE WHEN lang = 'de' THEN substr(coalesce(text, ''), 1, 900) ELSE coalesce(text, '') END")} AS t FROM documents),
    d1 AS (SELECT doc_id, lang, source, (SELECT count(*) FROM (SELECT unnest(range(0, CASE WHEN length(t) = 0 THEN 0 WHEN length(t) <= 800 THEN 1 ELSE CAST(ceil((length(t) - 800) / 680.0) AS BIGINT) + 1 END)) AS i) WHERE length({_strip("substr(t, i * 680 + 1, 800)")}) > 0) AS chunks FROM d0)"""
_SQL["document_load"] = f"""WITH {_LIBRARY} SELECT CAST(doc_id AS VARCHAR) AS document_id, v AS document_version, CASE WHEN chunks > 0 THEN v END AS chunk_version, chunks, CAST(v AS BIGINT) AS events, CASE WHEN v = 2 THEN 'second' ELSE 'first' END AS import_task_id, {_AS_OF} AS first_loaded_at
    FROM (SELECT *, CASE WHEN lang = 'de' THEN 2 ELSE 1 END AS v FROM d1 WHERE source IS DISTINCT FROM 'src3')"""
_SQL["documents_cleared"] = f"""WITH {_LIBRARY}, k AS (SELECT count(*) AS n, sum(chunks) AS c FROM d1 WHERE source IS DISTINCT FROM 'src3'), m AS (SELECT count(*) + count(*) FILTER (lang = 'de') AS n FROM documents)
    SELECT 'chunks' AS kind, CAST(c AS BIGINT) AS removed, 0::BIGINT AS remaining, CAST(c AS BIGINT) AS shown_before FROM k UNION ALL SELECT 'documents', n, 0, n FROM k UNION ALL SELECT 'memories', 0, n, n FROM m"""


def _cut(rows: str, most: int, least: int) -> str:
    """Tables that cut the contents of ``rows`` (q, o, head, content) by one ratio for each q: low is the ratio after 24 halvings."""
    total = lambda r: f"list_sum(list_transform(sizes, lambda x: least(x, {least}) + CAST(floor((x - least(x, {least})) * ({r})) AS BIGINT)))"
    return f"""g AS (SELECT q, list(length(content)) AS sizes, {most} - sum(length(head)) - 2 * (count(*) - 1) AS room FROM {rows} GROUP BY q),
    b(k, q, sizes, room, low, high) AS (SELECT 0, q, sizes, room, 0.0::DOUBLE, 1.0::DOUBLE FROM g
        UNION ALL SELECT k + 1, q, sizes, room, CASE WHEN {total("(low + high) / 2")} <= room THEN (low + high) / 2 ELSE low END, CASE WHEN {total("(low + high) / 2")} <= room THEN high ELSE (low + high) / 2 END FROM b WHERE k < 24),
    ratio AS (SELECT q, r, {total("r")} <= room AS fits FROM (SELECT q, sizes, room, CASE WHEN list_sum(sizes) <= room THEN 1.0::DOUBLE ELSE low END AS r FROM b WHERE k = 24)),
    cut AS (SELECT q, o, substr(content, 1, least(length(content), {least}) + CAST(floor((length(content) - least(length(content), {least})) * r) AS BIGINT)) AS kept, length(content) AS whole, fits FROM {rows} JOIN ratio USING (q))"""


_SQL["fit_context"] = f"""WITH RECURSIVE {_SRC.replace("rank = 3 AS protected", "event_id % 3 = 0 AS protected")}, rows_ AS (SELECT query_id AS q, rank AS o, '' AS head, content FROM dropped WHERE protected OR after_ <= 300 OR k = 1), {_cut("rows_", 300, 12)}
    SELECT q AS query_id, CAST(o AS INT) AS rank, kept AS content, length(kept) < whole AS truncated, fits FROM cut"""
_SQL["fit_summaries"] = f"""WITH RECURSIVE rows_ AS (SELECT conv_id AS q, turn AS o, '[' || role || '] ' AS head, coalesce(text, '') AS content FROM conversations), {_cut("rows_", 900, 200)}
    SELECT q AS query_id, o AS document_id, CAST(length(kept) AS INT) AS kept, sha256(kept) AS digest, length(kept) < whole AS truncated, fits FROM cut"""
_SQL["summary_cache"] = """WITH e AS (SELECT doc_id, sha256('{"prompt_version":1,"namespace":"default","document_id":"' || lang || '","query":"q","limit":12,"revision":[' || doc_id || '],"graph_mode":"off","graph_context":null}') AS key FROM documents),
    a AS (SELECT key, doc_id, '0-' || doc_id AS summary, row_number() OVER (ORDER BY doc_id) AS place FROM e WHERE doc_id % 3 <= 0 QUALIFY row_number() OVER (ORDER BY doc_id DESC) <= 256),
    b0 AS (SELECT key, doc_id, '1-' || doc_id AS summary, place FROM a UNION ALL SELECT key, doc_id, '1-' || doc_id, (SELECT max(place) FROM a) + row_number() OVER (ORDER BY doc_id) FROM e WHERE doc_id % 3 <= 1 AND key NOT IN (SELECT key FROM a)),
    b AS (SELECT * FROM b0 QUALIFY row_number() OVER (ORDER BY place DESC) <= 256),
    c0 AS (SELECT key, '2-' || doc_id AS summary, place FROM b UNION ALL SELECT key, '2-' || doc_id, (SELECT max(place) FROM b) + row_number() OVER (ORDER BY doc_id) FROM e WHERE key NOT IN (SELECT key FROM b))
    SELECT key, summary FROM c0 QUALIFY row_number() OVER (ORDER BY place DESC) <= 256"""
_SQL["episodic_retrieve"] = rf"""WITH {_MEM}, v AS (SELECT m.*, CASE WHEN user_id % 4 <> 3 THEN CAST(embedding AS DOUBLE[]) END AS v FROM m LEFT JOIN embeddings ON vec_id = memory_id),
    q AS (SELECT memory_id AS query_id, session_id AS query, CAST(embedding AS DOUBLE[]) AS qv, CASE WHEN memory_id % 60 <> 0 THEN user_id END AS u, CASE WHEN memory_id % 40 = 0 THEN session_id END AS s, memory_id % 100 / 200 AS least_,
                 CASE WHEN memory_id % 80 = 0 THEN ts - INTERVAL 5 DAY END AS start_, CASE WHEN memory_id % 160 = 0 THEN ts + INTERVAL 5 DAY END AS end_ FROM m JOIN embeddings ON vec_id = memory_id WHERE memory_id % 20 = 0),
    p AS (SELECT q.*, v.*, (s IS NULL OR session_id = s) AND importance >= least_ AND (start_ IS NULL OR ts >= start_) AND (end_ IS NULL OR ts <= end_) AS ok FROM q JOIN v ON u IS NULL OR user_id = u),
    near AS (SELECT query_id, memory_id, importance, ts, round(list_cosine_similarity(v, qv), 6) AS x, 'vector' AS backend FROM p WHERE ok AND v IS NOT NULL),
    word AS (SELECT query_id, memory_id, importance, ts, ok, len(list_intersect([query], list_distinct(regexp_split_to_array(lower(content), '\s+')))) AS part, contains(content, query) AS inside FROM p WHERE query_id NOT IN (SELECT query_id FROM near)),
    told AS (SELECT query_id, memory_id, importance, ts, ok, 1.0::DOUBLE AS x, 'fallback_keyword' AS backend FROM word WHERE part > 0 OR inside QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY memory_id) <= 25),
    pool AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY x DESC, memory_id) <= 25 UNION ALL SELECT * EXCLUDE (ok) FROM told WHERE ok),
    z AS (SELECT query_id, memory_id, backend, round((0.8::DOUBLE * x + 0.2::DOUBLE * greatest(0.1, least(1.0, exp(-{_AGE} / 1440 / 7)))) * (0.8::DOUBLE + 0.4::DOUBLE * importance), 6) AS score FROM pool)
    SELECT query_id, rank, memory_id, score, backend FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM z WHERE score > 0) WHERE rank <= 5"""
_SQL["summaries_in_background"] = f"WITH {_W} SELECT 'succeeded' AS status, 'succeeded' AS stage, 1 AS completed, 1 AS total, (SELECT count(DISTINCT document_id) FROM w) AS documents UNION ALL SELECT 'cancelled', 'cancelled', 0, 1, NULL"
_SQL["vector_topk_indexed"] = _SQL["vector_topk"]
_SQL["vector_threshold_indexed"] = _SQL["vector_threshold"].replace("score >= 0.25", "score >= 0.25 AND label IN (1, 3, 5)")
_ASKED_GRAPHS = """w0 AS (SELECT doc_id AS query_id, doc_id + k AS doc, k FROM documents, (SELECT unnest([0, 1, 2]) AS k)), ready_ AS (SELECT doc_id FROM documents WHERE doc_id % 9 <> 4),
    bad AS (SELECT query_id, arg_min(doc || ': pending', k) AS problem FROM w0 WHERE doc NOT IN (SELECT doc_id FROM ready_) GROUP BY query_id),
    asked AS (SELECT query_id, CAST(doc AS VARCHAR) AS document_id FROM w0 WHERE query_id NOT IN (SELECT query_id FROM bad))"""
_EVIDENCE = """met AS (SELECT query_id, document_id, graph_id, normalized_name FROM node JOIN asked USING (document_id) WHERE contains(normalized_name, 'the') OR contains(normalized_name, 'que') OR contains(normalized_name, 'ber')),
    sh AS (SELECT query_id, normalized_name, count(DISTINCT document_id) AS documents FROM met GROUP BY ALL HAVING count(DISTINCT document_id) >= 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY normalized_name) AS entity_rank FROM sh QUALIFY entity_rank <= 12),
    ev AS (SELECT query_id, CAST(entity_rank AS INT) AS entity_rank, substr(sha256('default' || chr(0) || 'Concept' || chr(0) || normalized_name), 1, 24) AS canonical_id, 'Concept' AS label, normalized_name, documents,
           CAST(row_number() OVER (PARTITION BY query_id, normalized_name ORDER BY document_id, graph_id) AS INT) AS member_rank, document_id, graph_id FROM met JOIN top USING (query_id, normalized_name))"""
_SQL["graph_cross_document_evidence"] = f"WITH {_GRAPH}, {_ASKED_GRAPHS}, {_EVIDENCE} SELECT * FROM ev WHERE member_rank <= 40"
_SQL["graph_cross_document_problems"] = f"WITH {_GRAPH}, {_ASKED_GRAPHS}, {_EVIDENCE} SELECT * FROM bad UNION ALL SELECT DISTINCT query_id, 'GraphContextEmpty' FROM asked WHERE query_id NOT IN (SELECT query_id FROM ev)"
_SQL["graph_sources"] = f"""WITH {_GRAPH}, {_ASKED_GRAPHS}, {_EVIDENCE}, sc AS (SELECT query_id, list_sort(list(DISTINCT document_id)) AS ids FROM ev WHERE member_rank <= 40 GROUP BY query_id),
    x AS (SELECT CAST(query_id AS VARCHAR) AS query_id, array_to_string(ids, '|') || '|canonical_entity|' || canonical_id AS key, array_to_string(ids, ', ') AS document_id, 'canonical_entity' AS kind, 'Concept' AS type FROM ev JOIN sc USING (query_id)
        UNION SELECT document_id, document_id || '|entity|' || graph_id, document_id, 'entity', 'Concept' FROM node
        UNION SELECT document_id, document_id || '|relation|' || source_id || '|' || target_id || '|RELATED_TO', document_id, 'relation', 'RELATED_TO' FROM edge)
    SELECT query_id, 'G-' || substr(sha1(key), 1, 10) AS citation_id, document_id, kind, type FROM x"""
_SQL["payload_layout"] = """SELECT event_id AS id, CAST(CASE WHEN event_id % 11 <> 5 AND event_id % 3 > 0 THEN event_id % 7 ELSE 0 END AS INT) AS chunk_index, CAST(CASE WHEN event_id % 11 = 5 THEN 1 ELSE event_id % 4 END AS INT) AS document_version,
    'chunk_index,content,created_at,document_id,document_version,' || CASE WHEN event_id % 11 = 5 THEN '' ELSE 'kind,place,' END || 'rag_namespace,updated_at' AS keys, event_type || '!' AS content,
    CASE WHEN event_id % 11 = 5 THEN '{}' ELSE '{"kind":"' || event_type || '","place":{"depth":' || event_id % 10 || '}}' END AS nested FROM events"""
_SQL["payload_nested_filter"] = "SELECT event_id AS id, CAST(event_id % 7 AS INT) AS chunk_index FROM events WHERE event_id % 11 <> 5 AND event_id % 3 > 0 AND event_id % 7 IN (1, 2, 4) AND event_id % 10 BETWEEN 3 AND 7 AND event_type IN ('view', 'click', 'purchase')"
_SQL["memory_add"] = f"""WITH {_MEM} SELECT memory_id, user_id, memory_type, session_id, importance, NULL AS modality, NULL AS raw_data FROM m
    UNION ALL SELECT event_id + 1000000, 7, CASE WHEN event_id % 3 = 0 THEN 'perceptual' ELSE 'working' END, 'session_20240131_000000', 0.5, CASE WHEN event_id % 3 = 0 THEN 'image' END, CASE WHEN event_id % 3 = 0 THEN 'f.PNG' END FROM events WHERE event_id % 5 > 0 AND props <> ''"""
_SQL["import_batches_listed"] = f"""WITH {_TASK}, b AS (SELECT batch_id, user_id, max(created_at) AS created_at, count(*) AS total, count(*) FILTER (status = 'failed') AS failed FROM task GROUP BY batch_id, user_id)
    SELECT batch_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, batch_id DESC) AS INT) AS place, total, failed FROM b QUALIFY place <= 3"""
_SQL["library_projection"] = """SELECT user_id, CAST(event_id AS VARCHAR) AS document_id, event_type || CASE WHEN event_id % 6 = 2 THEN '.PDF' ELSE '.md' END AS name, CASE WHEN event_id % 6 = 2 THEN '.pdf' ELSE '.md' END AS file_suffix,
    CASE WHEN event_id % 2 = 0 THEN date_trunc('second', CAST(ts AS TIMESTAMP)) END AS loaded_at FROM events WHERE event_id % 6 <> 1 AND event_id % 10 <> 3 AND event_id % 7 <> 2"""


def _last(kind: str, most: int, line: str, between: str, empty: str) -> str:
    return f"""(SELECT user_id, count(*) AS n, string_agg(k || '. ' || line, {between} ORDER BY k) FILTER (k > 0) AS t FROM (SELECT user_id, line, CASE WHEN b <= {most} THEN least({most}, n) - b + 1 ELSE 0 END AS k FROM
        (SELECT user_id, {line} AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS b, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = '{kind}')) GROUP BY user_id)"""


_SQL["learning_report"] = f"""SELECT u.user_id, coalesce(a.n, 0) AS documents_count, coalesce(b.n, 0) AS questions_count, coalesce(c.n, 0) AS notes_count, coalesce(a.t, '暂无导入记录') AS documents_text, sha256(coalesce(b.t, '暂无问答记录')) AS questions_digest, coalesce(c.t, '暂无学习笔记') AS notes_text
    FROM (SELECT DISTINCT user_id FROM events) u
    LEFT JOIN {_last("view", 5, "coalesce(props, 'None') || ' | ' || CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'None' END", "chr(10)", "")} a USING (user_id)
    LEFT JOIN {_last("click", 10, "'问题：' || coalesce(props, 'None') || chr(10) || '回答：' || substr(coalesce(repeat(props, 40), 'None'), 1, 300) || '...'", "chr(10) || chr(10)", "")} b USING (user_id)
    LEFT JOIN {_last("purchase", 10, "'【' || CASE WHEN event_id % 2 = 0 THEN 'idea' ELSE '未命名概念' END || '】' || coalesce(props, 'None')", "chr(10)", "")} c USING (user_id)"""
_SQL["files_read"] = r"""WITH k AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines, CASE WHEN regexp_full_match(coalesce(text, ''), '[\x20-\x7e\n]*') THEN CASE WHEN doc_id % 2 = 1 THEN 'pdf' ELSE 'docx' END WHEN doc_id % 2 = 1 THEN 'txt' ELSE 'md' END AS kind FROM documents),
    p AS (SELECT doc_id, kind, i AS page, trim(regexp_replace(lines[i], ' +', ' ', 'g')) AS content FROM (SELECT *, unnest([1, 2]) AS i FROM k WHERE kind = 'pdf') WHERE i <= len(lines)
        UNION ALL SELECT doc_id, kind, NULL, CASE WHEN kind = 'docx' THEN array_to_string(list_filter(lines, lambda x: trim(x) <> ''), chr(10) || chr(10)) ELSE text END FROM k WHERE kind <> 'pdf')
    SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id || '.' || kind AS file_name, CAST(coalesce(page, 1) - 1 AS INT) AS segment_index, CAST(page AS INT) AS page_number, CASE WHEN full_ THEN CAST(length(content) AS INT) END AS chars, CASE WHEN full_ THEN sha256(content) END AS digest, NOT full_ AS failed
    FROM (SELECT *, regexp_matches(content, '\S') AS full_ FROM p) WHERE full_ OR kind <> 'pdf'"""
_CRC_BYTE = "list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))"


def _crc(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII text: eight steps for each byte, from the reversed polynomial."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {_CRC_BYTE}), 4294967295)"


_SQL["snapshot_round_trip"] = f"""WITH {_W}, x AS (SELECT document_id || '_' || chunk_index AS chunk_id, document_id, chunk_index, content, {_crc("document_id || '_' || chunk_index")} % 10 AS n FROM w)
    SELECT chunk_id, document_id, CAST(CASE WHEN n = 2 THEN 0 ELSE chunk_index END AS INT) AS chunk_index, sha256(content) AS digest, CASE WHEN n = 3 THEN '7' END AS page_number, CASE WHEN n = 4 THEN TIMESTAMP '2024-01-05 10:00:00' END AS created_at, '1,2,0' AS vector FROM x WHERE n <> 1
    UNION ALL SELECT 'bad', NULL, NULL, sha256('{{broken'), NULL, NULL, NULL"""
_SQL["rag_stats_without_blank"] = f"WITH {_W} SELECT count(DISTINCT document_id) FILTER ({_crc('document_id')} % 4 <> 0) AS document_count, count(*) AS chunk_count FROM w"
_SQL["import_stream"] = """WITH RECURSIVE e0 AS (SELECT CAST(user_id AS VARCHAR) AS task_id, epoch_us(ts) // 1000 AS tm, event_id AS seq, event_id % 3 > 0 AS retryable, 'E' || event_id % 5 AS code,
        ['submit', 'claim', 'claim', 'progress', 'progress', 'progress', 'commit', 'succeed', 'fail', 'fail', 'cancel', 'retry', 'claim', 'release'][(event_id * 5 + user_id) % 14 + 1] AS kind,
        ['parsing', 'chunking', 'embedding', 'persisting'][event_id % 4 + 1] AS to_stage, [10 + event_id % 10 * 15 // 10, 25 + event_id % 10 * 15 // 10, 40 + event_id % 10 * 4, 80 + event_id % 10 * 12 // 10][event_id % 4 + 1] AS percent FROM events),
    u AS (SELECT max(tm) - 3600000 AS until FROM e0),
    e AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY tm, seq) AS k FROM e0, u WHERE tm < until),
    s(task_id, k, status, stage, progress, attempts, auto, manual, next, cancel, code, refused, updates, updated) AS (
        SELECT DISTINCT task_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0, 0, 0, 0, NULL::BIGINT, NULL::BIGINT, NULL::VARCHAR, 0, 0, NULL::BIGINT FROM e
        UNION ALL SELECT task_id, k,
            CASE WHEN NOT ok THEN st WHEN kind IN ('submit', 'release', 'retry') THEN 'queued' WHEN kind = 'claim' THEN 'running' WHEN kind = 'succeed' THEN 'succeeded' WHEN kind = 'fail' THEN fate WHEN kind = 'cancel' AND st <> 'running' THEN 'cancelled' ELSE st END,
            CASE WHEN NOT ok THEN stage WHEN kind IN ('submit', 'release', 'retry') THEN 'queued' WHEN kind = 'progress' THEN to_stage WHEN kind = 'commit' THEN 'committing' WHEN kind = 'succeed' THEN 'succeeded'
                 WHEN kind = 'fail' THEN CASE WHEN fate = 'retry_wait' THEN 'queued' ELSE fate END WHEN kind = 'cancel' AND st <> 'running' THEN 'cancelled' ELSE stage END,
            CASE WHEN NOT ok THEN progress WHEN kind = 'claim' THEN greatest(progress, 10) WHEN kind = 'progress' THEN greatest(progress, percent) WHEN kind = 'commit' THEN 99 WHEN kind = 'succeed' THEN 100 ELSE progress END,
            attempts + CASE WHEN ok AND kind = 'claim' THEN 1 WHEN ok AND kind = 'release' THEN -1 ELSE 0 END,
            CASE WHEN ok AND kind = 'fail' AND fate = 'retry_wait' THEN auto + 1 WHEN ok AND kind = 'retry' THEN 0 ELSE auto END,
            manual + CASE WHEN ok AND kind = 'retry' THEN 1 ELSE 0 END,
            CASE WHEN ok AND kind = 'fail' AND fate = 'retry_wait' THEN tm + 1000 * [2, 10, 30][auto + 1] WHEN due OR ok AND kind IN ('claim', 'cancel') AND st <> 'running' THEN NULL ELSE next END,
            CASE WHEN ok AND kind = 'cancel' THEN CASE WHEN st = 'running' THEN coalesce(cancel, tm) ELSE tm END ELSE cancel END,
            CASE WHEN ok AND kind = 'succeed' THEN NULL WHEN ok AND kind = 'fail' AND fate <> 'cancelled' THEN new_code ELSE code END,
            refused + CASE WHEN ok THEN 0 ELSE 1 END, updates + CASE WHEN due THEN 1 ELSE 0 END + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN tm WHEN due THEN next ELSE updated END
        FROM (SELECT *, coalesce(CASE kind WHEN 'submit' THEN st IS NULL WHEN 'claim' THEN st = 'queued' WHEN 'retry' THEN st = 'failed' WHEN 'cancel' THEN st IN ('queued', 'retry_wait') OR st = 'running' AND stage <> 'committing'
                                    WHEN 'commit' THEN st = 'running' AND stage <> 'committing' AND cancel IS NULL ELSE st = 'running' END, false) AS ok,
                     CASE WHEN cancel IS NOT NULL AND stage <> 'committing' THEN 'cancelled' WHEN retryable AND auto < 3 THEN 'retry_wait' ELSE 'failed' END AS fate
              FROM (SELECT s.* EXCLUDE (k), e.k, e.tm, e.kind, e.retryable, e.to_stage, CAST(e.percent AS INT) AS percent, e.code AS new_code, coalesce(next <= e.tm, false) AS due, CASE WHEN next <= e.tm THEN 'queued' ELSE status END AS st
                    FROM s JOIN e ON e.task_id = s.task_id AND e.k = s.k + 1))),
    f AS (SELECT s.*, coalesce(next < until, false) AS due FROM (SELECT * FROM s WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY k DESC) = 1) s, u)
    SELECT task_id, CAST(updates + CASE WHEN due THEN 1 ELSE 0 END AS BIGINT) AS updates, CASE WHEN due THEN 'queued' ELSE status END AS status, stage, progress, attempts, auto AS auto_retry_count, manual AS manual_retry_count, CASE WHEN NOT due THEN make_timestamp(next * 1000) END AS next_attempt_at,
           make_timestamp(cancel * 1000) AS cancel_requested_at, code AS error_code, refused, make_timestamp(CASE WHEN due THEN next ELSE updated END * 1000) AS updated_at FROM f"""

_SQL["golden_report"] = f"""SELECT case_id, CASE WHEN passed THEN 'PASS ' || case_id ELSE 'FAIL ' || case_id || ': ' || replace(failures, ';', '; ') END AS line FROM ({_SQL["golden_trace_eval"]})"""
_SQL["graph_assembled"] = f"""WITH {_XNAMES}, k AS (SELECT document_id, unnest(list_concat(['Document', 'Chapter', 'Chapter', 'Chunk', 'Concept', 'Concept', 'Person', 'HAS_CHAPTER', 'PARENT_OF', 'HAS_CHUNK', 'MENTIONS'], CASE WHEN doc_id % 4 = 0 THEN ['IS_A'] ELSE [] END)) AS kind FROM xn)
    SELECT document_id, kind, count(*) AS n FROM k GROUP BY document_id, kind"""
_SQL["graph_dependencies"] = """SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 2 = 0 THEN 'DEPENDS_ON' ELSE 'PREREQUISITE_OF' END AS type, source AS source_name, lang AS target_name FROM documents ORDER BY document_id LIMIT 100 OFFSET 5"""
_SQL["graph_person_relations"] = "SELECT CAST(doc_id AS VARCHAR) AS document_id, 'RELATED_TO' AS type, 'Ada' AS source_name, source AS target_name FROM documents ORDER BY document_id LIMIT 100"
_SQL["memory_episodic_add"] = f"""WITH {_MEM}, n AS (SELECT event_id - event_id % 3 AS memory_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'default' END AS session_id, props AS content, 0.5::DOUBLE AS importance, t.ts
        FROM events JOIN ({_SQL["timestamp_canonical"]}) t USING (event_id) QUALIFY row_number() OVER (PARTITION BY event_id - event_id % 3 ORDER BY event_id DESC) = 1)
    SELECT * FROM n UNION ALL SELECT memory_id, session_id, content, importance, ts FROM m WHERE memory_type = 'episodic' AND memory_id NOT IN (SELECT memory_id FROM n)"""


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
