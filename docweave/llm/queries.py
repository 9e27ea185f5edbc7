"""The registered queries of this subpackage: thin digests of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import bpe, decontamination, hamming_search, html_extraction, language_model, merkle, mixing, ngram_join, prefix_trie, quality, sharding, token_counts, toxicity
from docweave.sources.tables import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_links(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.lm_scores(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(_table(spark, sf_dir, "documents"), decoded=True)
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.section_token_counts(_table(spark, sf_dir, "documents"))
    return counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.array_sort("items")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(_table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


SHARDS = [f"shard-{k:03d}" for k in range(256)]


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op10_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming_search.sign_code(F.col("embedding")).alias("code"))
    found = hamming_search.top_k(rows, rows.where("id % 20 = 0"), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.planned(mixing.measured(_table(spark, sf_dir, "documents")))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_lm_scoring, op3_bpe, op4_decontamination, op5_token_counts, op6_toxicity, op7_html_extraction, op8_quality_classifier, op9_sharding, op10_top_k_search, op11_prefix_trie, op12_source_mix, op13_merkle_manifest)}


OP1_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') || '#' || least(4, len(w)) AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM link UNION SELECT y, x FROM link UNION SELECT doc_id, doc_id FROM d),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.y) AS component_id, (SELECT count(*) FROM link WHERE x = d.doc_id OR y = d.doc_id) AS n_links
FROM d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
       FROM (SELECT item, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS win
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT doc_id, item, i, dw.size AS size FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


OP10_SQL = """
WITH c AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings),
r AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code)) AS distance FROM c AS q, c WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM r)
SELECT query_id, rank, vec_id, CAST(distance AS BIGINT) AS distance FROM k WHERE rank <= 10
"""


def _op9_sql() -> str:
    """The lookup table as a list of shard numbers by slot, and a look into it for each document."""
    table = sharding.lookup_table(SHARDS)
    return f"""
WITH t AS (SELECT {table.tolist()} AS shards), s AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(CAST(shards[slot + 1] AS VARCHAR), 3, '0') AS shard FROM s, t
"""


def _op11_sql() -> str:
    """Every prefix of every rebuilt conversation as a list of (role, text), grouped; a subtree is the nodes that a path begins."""
    return f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY c),
h AS (SELECT c, own, {_crc("CAST(c AS VARCHAR)")} % 4 AS h FROM o),
s AS (SELECT h.c, list_concat(list_slice(coalesce(b.own, []), 1, h.h), list_slice(h.own, h.h + 1, len(h.own))) AS seq FROM h LEFT JOIN o b ON b.c = h.c - h.c % 20),
p AS (SELECT c, len(seq) AS n, d, list_slice(seq, 1, d) AS path FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256,
             CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM p GROUP BY path, d),
k AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT list_slice(x.path, 1, d2) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS d2 FROM a) x GROUP BY ALL)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, b.conv_id AS parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, a.ends_sha256
FROM a JOIN u ON u.path = a.path LEFT JOIN a b ON a.d > 0 AND b.path = list_slice(a.path, 1, a.d - 1)
"""


OP12_SQL = r"""
WITH d AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM d GROUP BY source),
k AS (SELECT source, source_size, weight, sum(2 * source_size) OVER w - 2 * source_size AS full_before, sum(weight) OVER () - (sum(weight) OVER w - weight) AS rest
      FROM s WINDOW w AS (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
p AS (SELECT max((1.5 * (SELECT sum(source_size) FROM s) - full_before) / rest) AS part FROM k),
t AS (SELECT source, source_size, least(2 * source_size, weight * part) AS target FROM k, p),
r AS (SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
             CAST('0x' || substr(md5(coalesce('mix:' || CAST(doc_id AS VARCHAR), 'mix-' || md5(coalesce(text, '')))), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS taken FROM r
"""

def _crc(text: str) -> str:
    """SQL of the unsigned crc32 of an ASCII text: eight steps for each byte, from the reversed polynomial."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda a, i: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))"
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {byte}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _op13_sql() -> str:
    """Levels from below by recursion; a node's siblings are the other nodes of its run; changed leaves are folded up level by level."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    leaf, changed = (f"sha256({' || '.join(_field(v) for v in ('doc_id', 'source', 'lang', 'n_chars', text))})" for text in ("text", f"translate(text, {letters})"))
    return f"""
WITH RECURSIVE l AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {leaf} AS leaf, CASE WHEN {_crc("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {changed} ELSE {leaf} END AS other FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
up(k, g, i, n, h) AS (SELECT 0, g, i, n, leaf FROM o
    UNION ALL SELECT k + 1, g, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM up WHERE n > 1 GROUP BY k, g, i // 16),
sub AS (SELECT g, k AS top, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
above(k, i, n, h) AS (SELECT 0, i, n, subroot FROM sub
    UNION ALL SELECT k + 1, i // 16, any_value((n + 15) // 16), sha256(string_agg(h, '' ORDER BY i)) FROM above WHERE n > 1 GROUP BY k, i // 16),
nodes AS (SELECT k, g, i, h FROM up WHERE n > 1 UNION ALL SELECT top + above.k, sub.g, above.i, above.h FROM above, sub WHERE above.n > 1),
path(doc_id, g, leaf, j, k, i, f) AS (SELECT o.doc_id, o.g, leaf, o.i, 0, CASE WHEN o.n > 1 THEN o.i ELSE sub.i END, other FROM o JOIN sub USING (g)
    UNION ALL SELECT p.doc_id, p.g, p.leaf, p.j, p.k + 1, any_value(CASE WHEN p.k + 1 = sub.top THEN sub.i ELSE p.i // 16 END),
                     sha256(string_agg(CASE WHEN nodes.i = p.i THEN p.f ELSE nodes.h END, '' ORDER BY nodes.i))
              FROM path p JOIN sub ON sub.g = p.g JOIN nodes ON nodes.g = p.g AND nodes.k = p.k AND nodes.i // 16 = p.i // 16
              GROUP BY p.doc_id, p.g, p.leaf, p.j, p.k),
proof AS (SELECT p.g, p.j, sha256(coalesce(string_agg(nodes.h, '' ORDER BY nodes.k, nodes.i) FILTER (nodes.i <> p.i), '')) AS proof
          FROM path p LEFT JOIN nodes ON nodes.g = p.g AND nodes.k = p.k AND nodes.i // 16 = p.i // 16 GROUP BY p.g, p.j),
folded AS (SELECT g, j, arg_max(f, k) AS f, any_value(doc_id) AS doc_id, any_value(leaf) AS leaf FROM path GROUP BY g, j)
SELECT f.doc_id, leaf, subroot, above.h AS root, proof AS proof_sha256, f.f AS folded_root, f.f = above.h AS verified
FROM folded f JOIN proof USING (g, j) JOIN sub USING (g) JOIN above ON above.n = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op4_decontamination": OP4_SQL, "op9_sharding": _op9_sql(), "op10_top_k_search": OP10_SQL, "op11_prefix_trie": _op11_sql(), "op12_source_mix": OP12_SQL, "op13_merkle_manifest": _op13_sql()}
