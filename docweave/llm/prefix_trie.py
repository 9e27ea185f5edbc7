"""A Patricia trie of the shared beginnings of conversations.

1. Turns are numbered in each conversation, and each gets a 128-bit hash of everything up to it. Sorting by that
   hash brings equal prefixes together. Only the points of the trie are made: the root, prefixes after which
   conversations differ (branches) and prefixes that end one (ends and leaves). A prefix that all its
   conversations continue with the same turn lies inside an edge and is dropped.
2. A point belongs to its smallest conversation. The points on a conversation's path that are its own are at
   the bottom, in one run, since whatever lies deeper has fewer members. So each conversation that is the
   smallest at its own end carries its path's points, with the edges that are its own: every edge once.
3. Subtree sums on this compressed tree: a conversation gives each point of its path what its own edges
   below that point hold, and each point adds up what it is given. No rounds, whatever the depth.
4. Edges are expanded: a node inside an edge has the counts of the point below it, and its sum is that
   point's and the edge's from the node on, a difference of two running sums of words.

A path has at most about sqrt(2 * turns) points (each needs another conversation that goes as far), so windows
over a path are small even where one conversation holds a third of all turns. Turns and prefixes of one
conversation are never gathered in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import staged
from docweave.llm.mixing import word_count
from docweave.llm.running import plus, running, xor

#: Depths of an edge that are expanded from one row.
PIECE = 4096
#: Conversations with the same id but for the last 16 bits are joined to one text before digests are made.
CHUNK_BITS = 16


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each turn as (c, pos, h1, h2, words): its conversation, its place from 0, two hashes of role and text, the text's words.

    In order of turn, null first; turns with equal numbers in order of role, then text; null role and text are
    empty. Rows without a conversation are left out. Texts are read once, and once more only where turn numbers repeat,
    and those rows alone.
    """
    of, said = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role, text))
    hashes = F.xxhash64(of, said).alias("h1"), F.xxhash64(said, F.lit("2"), of).alias("h2")
    read = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("t"), of.alias("role"), said.alias("text"), *hashes)
    thin = staged(read.select("c", "t", "h1", "h2", word_count("text").alias("words")))
    tied = staged(thin.groupBy("c", "t").count().where("count > 1").select("c", "t"))
    if tied.isEmpty():
        placed = thin.withColumn("tie", F.lit(0).cast("long"))
    else:
        again = tied.select(F.col("c").alias("c_"), F.col("t").alias("t_"))
        rows = read.join(again, (F.col("c") == F.col("c_")) & F.col("t").eqNullSafe(F.col("t_")), "left_semi")
        ties = running(rows.withColumn("key", F.struct(F.col("t").isNull().alias("none"), F.coalesce("t", F.lit(0)).alias("t"))), ["c", "key"], [F.col("role"), F.col("text")], {"tie": plus(F.lit(1))})
        ties = ties.groupBy("c", F.col("t").alias("t_"), "h1", "h2").agg(F.min("tie").alias("tie")).withColumnsRenamed({"c": "c_", "h1": "h1_", "h2": "h2_"})
        same = [thin["c"] == ties["c_"], thin["t"].eqNullSafe(ties["t_"]), thin["h1"] == ties["h1_"], thin["h2"] == ties["h2_"]]
        placed = thin.join(ties, same, "left").select(thin["*"], F.coalesce("tie", F.lit(0)).alias("tie"))
    counted = running(placed, ["c"], [F.col("t").asc_nulls_first(), F.col("tie")], {"n": plus(F.lit(1))})
    return counted.select("c", (F.col("n") - 1).alias("pos"), "h1", "h2", "words")


def rebuilt(placed: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """The turns (c, depth from 1, h1, h2, words) after conversation c's beginning was replaced, and a row of depth 0 for each c.

    Its first h turns (h = crc32(c as decimals) modulo ``heads``) give way to the first h of conversation
    c - c % every, or to all that it has, or to none where it does not exist.
    """
    h = (F.crc32(F.col("c").cast("string")) % heads).alias("h")
    base = (F.col("c") - F.col("c") % every).alias("base")
    first = placed.where((F.col("pos") < heads - 1) & (F.col("c") % every == 0)).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("head"))
    first = first.withColumnRenamed("c", "of")
    convs = placed.select("c").distinct().select("c", h, base)
    convs = staged(convs.join(first, F.col("base") == F.col("of"), "left").select("c", "h", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,h1:long,h2:long,words:long>>")), F.lit(1), F.col("h").cast("int")).alias("head")))
    taken = convs.select("c", F.explode("head").alias("x")).select("c", (F.col("x.pos") + 1).alias("depth"), "x.h1", "x.h2", "x.words")
    sizes = convs.select(F.col("c").alias("c_"), (F.size("head") - F.col("h")).alias("shift"))
    own = placed.where(F.col("pos") >= F.crc32(F.col("c").cast("string")) % heads).join(sizes, F.col("c") == F.col("c_"))
    own = own.select("c", (F.col("pos") + 1 + F.col("shift")).alias("depth"), "h1", "h2", "words")
    none = F.lit(0).cast("long")
    roots = convs.select("c", none.alias("depth"), none.alias("h1"), none.alias("h2"), none.alias("words"))
    return taken.unionByName(own).unionByName(roots)


def _prefixes(sequences: DataFrame) -> DataFrame:
    """Rows (c, depth, t1, t2, p1, p2, upto, words, last): the turn's own hashes at its depth, those of all turns up to it, the words up to it, and the last depth.

    The hash of a prefix is the exclusive or of its turns' hashes, each taken together with its depth.
    """
    marked = sequences.select("c", "depth", "words", F.when(F.col("depth") > 0, F.xxhash64("h1", "h2", "depth")).otherwise(0).alias("t1"), F.when(F.col("depth") > 0, F.xxhash64("depth", "h2", "h1", F.lit(2))).otherwise(0).alias("t2"))
    totals = {"p1": xor(F.col("t1")), "p2": xor(F.col("t2")), "upto": plus(F.col("words")), "n": plus(F.lit(1))}
    return running(marked, ["c"], [F.col("depth")], totals).select("c", "depth", "t1", "t2", "p1", "p2", "words", "upto", (F.col("all_n") - 1).alias("last"))


def _points(rows: DataFrame) -> DataFrame:
    """The root, branches, ends and leaves: (p1, p2, depth, conv_id, n_convs, n_children, ends, least_end)."""
    on = rows.where("depth > 0").groupBy(F.col("p1").bitwiseXOR(F.col("t1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("t2")).alias("p2"), (F.col("depth") - 1).alias("depth"), "t1", "t2")
    on = on.agg(F.count("*").alias("n"), F.min("c").alias("least"), F.lit(None).cast("long").alias("least_end")).drop("t1", "t2")
    over = rows.where("depth = last").groupBy("p1", "p2", "depth").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.min("c").alias("least_end"))
    both = on.unionByName(over).groupBy("p1", "p2", "depth")
    ends = F.col("least_end").isNotNull()
    points = both.agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.count_if(~ends).alias("n_children"), F.sum(F.when(ends, F.col("n")).otherwise(0)).alias("ends"), F.min("least_end").alias("least_end"))
    return points.where("n_children <> 1 or ends > 0 or depth = 0")


def _ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the decimal ids that end at a point, ascending and comma-joined: (p1, p2, depth, ends_sha256).

    Ids that differ in their last ``CHUNK_BITS`` bits only are joined in one text; a digest takes these texts one
    after the other, so that a group that holds most conversations needs no more memory than a small one.
    """
    ids = rows.where("depth = last").groupBy("p1", "p2", "depth", F.shiftright("c", CHUNK_BITS).alias("chunk"))
    chunks = ids.agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))
    dealt = chunks.repartition("p1", "p2", "depth").sortWithinPartitions("p1", "p2", "depth", "chunk")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for *at, ids in zip(*(batch.column(k).to_pylist() for k in ("p1", "p2", "depth", "ids")), strict=True):
                if at != key:
                    if state:
                        done.append((*key, state.hexdigest()))
                    key, state = at, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digest_rows(done)
            done = []
        if state:
            yield _digest_rows([(*key, state.hexdigest())])

    return dealt.mapInArrow(digests, "p1 long, p2 long, depth long, ends_sha256 string")


def _digest_rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [(), (), (), ()]
    kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["p1", "p2", "depth", "ends_sha256"])


def _edges(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Each point with the edge that ends in it: its first depth, the conversation above it, and its subtree's sums.

    ``below`` are saved words of nodes under the point, ``upto`` the words up to it, ``n_leaves`` leaves in its subtree.
    """
    # a conversation owns nodes if it is the smallest member of its own end, so it is the smallest that ends there
    owners = points.where("conv_id = least_end").select(F.col("conv_id").alias("owner"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    mine = rows.join(owners, rows["c"] == owners["owner"]).select("c", "leaf", "p1", "p2", "depth", "upto")
    known = points.withColumnsRenamed({"p1": "p1_", "p2": "p2_", "depth": "depth_"})
    met = mine.join(known, [mine["p1"] == known["p1_"], mine["p2"] == known["p2_"], mine["depth"] == known["depth_"]])
    path = Window.partitionBy("c").orderBy("depth")
    above = {"top": F.coalesce(F.lag("depth").over(path), F.lit(-1)) + 1, "above": F.lag("conv_id").over(path), "words_above": F.coalesce(F.lag("upto").over(path), F.lit(0))}
    met = met.withColumns(above)
    held = F.when(F.col("c") == F.col("conv_id"), (F.col("n_convs") - 1) * (F.col("upto") - F.col("words_above"))).otherwise(0)
    met = met.withColumn("held", held)
    under = F.coalesce(F.sum("held").over(path.rowsBetween(1, Window.unboundedFollowing)), F.lit(0))
    met = staged(met.withColumn("under", under).select("c", "leaf", "p1", "p2", "depth", "upto", "top", "above", "conv_id", "n_convs", "n_children", "ends", "under"))
    sums = met.groupBy(F.col("conv_id").alias("conv_id_"), F.col("depth").alias("depth_")).agg(F.sum("leaf").alias("n_leaves"), F.sum("under").alias("below"))
    own = met.where("c = conv_id")
    return own.join(sums, [own["conv_id"] == sums["conv_id_"], own["depth"] == sums["depth_"]]).drop("c", "leaf", "under", "conv_id_", "depth_")


def trie(sequences: DataFrame) -> DataFrame:
    """All nodes of the trie of ``sequences`` (c, depth, h1, h2, words; a row of depth 0 for each c).

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves (childless nodes in the subtree), saved_tokens ((n_convs - 1) * words of the last text, summed over
    the subtree), ends_sha256 (of the ids of members that end here). A conversation without turns is a member of
    the root. Without conversations there is no node, not even a root. Equal conversations share all nodes.
    Prefixes are told apart by 128 bits.
    """
    rows = staged(_prefixes(sequences))
    points = staged(_points(rows))
    digests = _ends(rows)
    edges = staged(_edges(rows, points))
    named = edges.join(digests.withColumnsRenamed({"p1": "p1_", "p2": "p2_", "depth": "depth_"}), [F.col("p1") == F.col("p1_"), F.col("p2") == F.col("p2_"), F.col("depth") == F.col("depth_")], "left")
    pieces = named.withColumn("from", F.explode(F.sequence(F.col("top"), F.col("depth"), F.lit(PIECE).cast("long"))))
    nodes = pieces.withColumn("at", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + PIECE - 1, F.col("depth")))))
    here = rows.select(F.col("c").alias("c_"), F.col("depth").alias("d_"), F.col("words").alias("w_"), F.col("upto").alias("u_"))
    nodes = nodes.join(here, [nodes["conv_id"] == here["c_"], nodes["at"] == here["d_"]])
    point = F.col("at") == F.col("depth")
    nothing = F.lit(hashlib.sha256().hexdigest())
    return nodes.select(
        "conv_id",
        F.col("at").alias("depth"),
        F.when(F.col("at") > F.col("top"), F.col("conv_id")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs",
        F.when(point, F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * (F.col("upto") - F.col("u_") + F.col("w_"))).alias("saved_tokens"),
        F.when(point, F.coalesce("ends_sha256", nothing)).otherwise(nothing).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations whose beginnings are replaced as in ``rebuilt``; other columns are not read.

    For the trie of conversations as they are, give ``trie`` the rows of ``plain(turns(...))``.
    """
    return trie(rebuilt(turns(conversations, conv_id, turn, role, text)))


def plain(placed: DataFrame) -> DataFrame:
    """The sequences of conversations as they are."""
    none = F.lit(0).cast("long")
    roots = placed.select("c").distinct().select("c", none.alias("depth"), none.alias("h1"), none.alias("h2"), none.alias("words"))
    return placed.select("c", (F.col("pos") + 1).alias("depth"), "h1", "h2", "words").unionByName(roots)
