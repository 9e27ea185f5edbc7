"""A Merkle manifest of a dataset: a digest for every row, group and the whole, and each row's proof.

A level is a window: nodes of a group partitioned by (group, parent), their digests collected in order over
the full frame. That list is the parent's preimage and holds a node's siblings. Parents are made distinct
and are the next level's nodes; a run has at most ``ARITY`` nodes, so no window grows with the data. Then
proofs are handed down, the runs above to the runs below, once for a run and not once for a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import fold_of, staged
from docweave.llm.running import plus, running

ARITY = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<at:int,siblings:string>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts one after the other, as text."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value so that no two rows have the same fields in a row: its bytes' number, a colon and itself; null is a dash."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lower_ascii(value: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(value.cast("string"), letters, letters.lower())


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (g, i, n, hash) with ``up``, their run's number, ``at``, their place in it, and ``run``, its digests in order."""
    run = Window.partitionBy("g", "up").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = nodes.withColumns({"up": F.floor(F.col("i") / arity), "at": (F.col("i") % arity).cast("int")})
    return placed.withColumn("run", F.collect_list("hash").over(run))


def _levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The inner levels over ``nodes``, lowest first, and each group's last node (g, hash)."""
    levels, tops = [], [nodes.where("n = 1").select("g", "hash")]
    below = nodes.where("n > 1")
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        parents = _runs(below, arity).select("g", F.col("up").alias("i"), F.ceil(F.col("n") / arity).alias("n"), digest(F.concat_ws("", "run")).alias("hash"))
        level = staged(parents.distinct())
        levels.append(level)
        tops.append(level.where("n = 1").select("g", "hash"))
        below = level.where("n > 1")
        most = -(-most // arity)
    last = tops[0]
    for t in tops[1:]:
        last = last.unionByName(t)
    return levels, last


def _step() -> Column:
    """A node's place in its run and the digests of its siblings, one after the other."""
    return F.struct(F.col("at").alias("at"), F.concat_ws("", F.filter("run", lambda _, k: k != F.col("at"))).alias("siblings"))


def _paths(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (g, i, n, hash and others) with ``path``, the steps from each to the root, and ``root`` and ``subroot``.

    ``above`` has each group's ``path`` from its last node on, with ``root`` and ``subroot``.
    """
    above = above.select(F.col("g").alias("g_up"), F.col("path").alias("path_up"), "root", "subroot")
    known = None
    for level in reversed([nodes, *levels]):
        single = level.where("n = 1").join(above, F.col("g") == F.col("g_up"))
        single = single.select(*level.columns, F.col("path_up").alias("path"), "root", "subroot")
        if known is not None:
            parents = known.select(F.col("g").alias("g_up"), F.col("i").alias("i_up"), F.col("path").alias("path_up"), "root", "subroot")
            inner = _runs(level.where("n > 1"), arity).join(parents, (F.col("g") == F.col("g_up")) & (F.col("up") == F.col("i_up")))
            inner = inner.select(*level.columns, F.concat(F.array(_step()), F.col("path_up")).alias("path"), "root", "subroot")
            single = single.unionByName(inner)
        known = single if level is nodes else staged(single)
    return known


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""

    def up(hash_: Column, step: Column) -> Column:
        cut = step["at"] * 64
        return digest(F.substring(step["siblings"], F.lit(1), cut), hash_, F.substring(step["siblings"], cut + 1, F.length(step["siblings"])))

    return F.aggregate(path, leaf, up)


def manifest(documents: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group: str = "source", arity: int = ARITY, tampered: dict[str, Column] | None = None) -> DataFrame:
    """Each row's id (as ``id_col``), ``leaf``, ``subroot``, ``root``, ``path``, and ``tampered``, its leaf with the values of ``tampered`` in place of its own.

    Leaves of a group are in order of id, null first; rows with equal ids in order of their leaves, so equal
    rows are any of each other. Groups are in order of code points, null first. A group of one row is its
    leaf; a single group's digest is the root. An empty table has no rows and so no root. Other columns are not
    read. Only ids, digests and groups are shuffled, texts never.
    """
    if arity < 2:
        raise ValueError("a run needs room for two nodes")
    changed = tampered or {}
    own, other = (digest(*(field(values.get(f, F.col(f))) for f in fields)) for values in ({}, changed))
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # '-' is below '='
    leaves = staged(documents.select(F.col(id_col).alias("id"), g.alias("g"), own.alias("hash"), (other if changed else own).alias("other")))
    ordered = running(leaves, ["g"], [F.col("id").asc_nulls_first(), F.col("hash")], {"i": plus(F.lit(1))})
    nodes = staged(ordered.select("g", (F.col("i") - 1).alias("i"), F.col("all_i").alias("n"), "hash", "id", "other"))
    levels, subroots = _levels(nodes, arity)
    subroots = staged(subroots)
    groups = running(subroots, [], [F.col("g")], {"i": plus(F.lit(1))})
    groups = staged(groups.select(F.lit("").alias("g"), (F.col("i") - 1).alias("i"), F.col("all_i").alias("n"), "hash", F.col("g").alias("name")))
    upper, root = _levels(groups, arity)
    start = root.select("g", F.array().cast(PATH).alias("path"), F.col("hash").alias("root"), F.lit("").alias("subroot"))
    above = _paths(groups, upper, staged(start), arity)
    above = staged(above.select(F.col("name").alias("g"), "path", "root", F.col("hash").alias("subroot")))
    found = _paths(nodes, levels, above, arity)
    return found.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root", "path", F.col("other").alias("tampered"))


def proof(path: Column) -> Column:
    """The siblings of a path, from the leaf's run to the root's, one after the other."""
    return F.concat_ws("", F.transform(path, lambda s: s["siblings"]))


def tamper_check(documents: DataFrame, folds: int = 5) -> DataFrame:
    """The manifest of ``documents`` and what comes of changed rows: where ``folds`` divides crc32(id as text), the text's A-Z are lower-cased.

    ``folded_root`` is made of the changed row and its original siblings, ``verified`` tells whether it is the root.
    A row without an id is never changed.
    """
    text = F.when(fold_of("doc_id", folds) == 0, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rows = manifest(documents, tampered={"text": text})
    folded = rows.withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
