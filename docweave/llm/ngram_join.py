"""N-gram Jaccard self-join with prefix trees.

Each document is the set of its distinct word shingles. Documents meet by exact signatures: the shingles
are dealt into classes, and two sets that differ in at most H shingles must agree on one of any H + 1
classes, so every linked pair shares a signature, while texts that only share passages rarely do. Members
of a meeting group put their globally ordered sets (shingles common in the group first) into a prefix tree;
one walk counts overlaps for all probes at once, sharing the counts of common beginnings and leaving a
subtree as soon as the remaining lengths can't reach the threshold.

One pass over the texts describes and signs them. A worker sends a signature at most FEW times for each of its
chunks of text; where more sets have it there, only the least is sent, and the others follow that one into its
groups. So a signature that a third of all rows share is a few entries a chunk. Signatures travel packed, and
meeting sets as compressed texts, which are smaller than their shingles.

Exact copies are one set from the start. A group too large for one task first compares each member with
the group's leader; members linked to it need no comparison with each other, and by the triangle
inequality of the Jaccard distance only the others (and what may reach them) are joined, in blocks.

Components need only links that connect (``jaccard_components``). ``jaccard_links`` verifies every pair: the
walk adds up each set's partners by their copies, a pair counts in the first group that it shares, and large
groups are joined block by block without the leader's shortcut. Pairs are never written out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import SPACED, as_long, buckets, map_batches, mix64, row_groups, shingles, staged, text_bytes, text_slices, words
from docweave.llm.components import connected_components

SHINGLE = 4
PERCENT = 85
#: Shingles that a task holds of one group; larger groups are joined in blocks.
GROUP_SHINGLES = 1 << 20
#: Sets that a task holds of one group, or of one block.
GROUP_SETS = 1 << 10
#: Marks of one signature that a chunk sends; of more it sends one, and the others follow it.
FEW = 16
#: Members of large groups that are looked up by broadcast, some 100 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Bytes of text whose signatures are dealt out together.
CHUNK_BYTES = 32 << 20

_U = np.uint64


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The ascending distinct shingle hashes of each text; a text of fewer words is one shingle, one of none is empty."""
    hashes, _, _, bounds = words(*text_bytes(texts), SPACED)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(shingles(hashes[a:b], min(size, b - a))) if b > a else hashes[:0]


def _print(s: np.ndarray) -> int:
    """A fingerprint of a set; with its size it stands for the set."""
    return int(mix64(np.array([mix64(s).sum(dtype=_U) + _U(len(s))]))[0]) if len(s) else 0


def most_apart(n: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of a set of ``n`` and one that it links with."""
    return (100 - percent) * (n + 100 * n // percent) // (100 + percent)


def signatures(s: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes of the set's classes: two linked sets have one of them in common.

    Sizes fall in levels by powers of two; a set also signs at the next level if it can link with a set
    there. With H = most_apart(n) it signs its first H + 1 classes that have shingles; of a linked pair at
    most H classes differ, and the first H + 1 of the set that signs fewer lie among the other's.
    """
    n = len(s)
    apart = most_apart(n, percent)
    out = []
    for level in range(n.bit_length() - 1, (100 * n // percent).bit_length()):
        classes = most_apart((2 << level) - 1, percent) + 9
        mixed = mix64(s + _U((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        kind = (mixed >> _U(11)) % _U(classes)
        order = np.argsort(kind)
        kind = kind[order]
        start = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
        sums = np.add.reduceat(mix64(mixed)[order], start)[: apart + 1]
        start = start[: apart + 1]
        out.append(mix64(sums + kind[start] * _U(0xD1342543DE82EF95) + _U(level)))
        if len(start) <= apart:  # too few classes have shingles: such sets all meet
            out.append(mix64(np.array([level + 1], _U) * _U(0xA0761D6478BD642F)))
    return np.concatenate(out)


@dataclass
class Count:
    """What a walk that counts is given for each set (then probe), and ``partners``, to which it adds."""

    copies: np.ndarray
    #: Ascending smaller roots of the set: a pair that shares one counts in that root's group.
    earlier: list[np.ndarray]
    partners: np.ndarray


def trie_links(sets: list[np.ndarray], probes: list[np.ndarray] | None = None, percent: int = PERCENT, count: Count | None = None, within: bool = False) -> list[tuple[int, int]]:
    """Links that connect what the pairs with 100 * |a & b| >= percent * |a | b| connect.

    ``sets`` are joined with themselves, or with ``probes``, whose numbers then start at len(sets), or
    ``within`` with both. The sets in lexicographic order and their common beginnings are the prefix tree:
    a node is a range of sets and a depth. Pairs that earlier links connect are passed over, unless
    ``count`` is given: then every pair is verified and adds to the partners of both.
    """
    whole = sets if probes is None else sets + probes
    offset = 0 if probes is None or within else len(sets)
    seek = whole[offset:]
    have = _places(count.earlier[offset:]) if count else {}
    sizes = np.array([len(x) for x in whole])
    tokens, inverse, times = np.unique(np.concatenate(whole), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, -times))] = np.arange(len(tokens))
    ranks = rank[inverse]
    cut = np.cumsum(sizes)[:-1]
    # a shingle of one set alone (they come last in the order) overlaps with nothing: the tree is built without
    shared_by = np.sort(times)[::-1]
    lone = int(np.searchsorted(-shared_by, -1, "left"))
    rows = [np.sort(x[x < lone]) for x in np.split(ranks, cut)]
    most_of = np.array([len(x) for x in rows])
    # the probes that hold each shingle
    first = sizes[:offset].sum()
    owner = np.repeat(np.arange(len(seek)), sizes[offset:])
    order = np.argsort(ranks[first:], kind="stable")
    holders = owner[order]
    held = np.searchsorted(ranks[first:][order], np.arange(len(tokens) + 1))
    tree = np.array(sorted(range(len(sets)), key=lambda i: rows[i].astype(">i8").tobytes()))
    shared = np.zeros(len(tree) + 1, np.int64)
    for i in range(1, len(tree)):
        a, b = rows[tree[i - 1]], rows[tree[i]]
        m = min(len(a), len(b))
        differ = a[:m] != b[:m]
        shared[i] = int(differ.argmax()) if differ.any() else m
    length, whole_length = most_of[tree], sizes[tree]
    size_of, most_of = sizes[offset:], most_of[offset:]
    label = np.arange(len(whole))
    found = np.zeros(len(seek), np.int64)
    out: list[tuple[int, int]] = []
    stack = [(0, len(tree), 0, np.arange(len(seek)), np.zeros(len(seek), np.int64))]
    while stack:
        lo, hi, depth, active, overlap = stack.pop()
        if count is None:
            members = label[tree[lo:hi]]
            if (members == members[0]).all() and (label[offset + active] == members[0]).all():
                continue
        end = int(length[lo]) if hi - lo == 1 else int(min(length[lo], shared[lo + 1 : hi].min()))
        run = rows[tree[lo]][depth:end]
        if len(run):
            a, b = held[run], held[run + 1]
            n = b - a
            if total := int(n.sum()):
                of = holders[np.repeat(a - np.cumsum(n) + n, n) + np.arange(total)]
                if len(run) > 1:
                    overlap = overlap + np.bincount(of, minlength=len(seek))[active]
                else:
                    found[of] = 1
                    overlap = overlap + found[active]
                    found[of] = 0
        shortest, longest = int(whole_length[lo:hi].min()), int(length[lo:hi].max())
        most = overlap + np.minimum(most_of[active] - overlap, longest - end)
        keep = most * (100 + percent) >= percent * (size_of[active] + shortest)
        active, overlap = active[keep], overlap[keep]
        if not len(active):
            continue
        done = lo
        while done < hi and length[done] == end and (done == lo or shared[done] == end):
            me = int(tree[done])
            linked = active[overlap * (100 + percent) >= percent * (size_of[active] + int(whole_length[done]))] + offset
            if count is not None:
                linked = linked[linked != me]
                if len(linked) and len(count.earlier[me]):
                    met = np.zeros(len(seek), bool)
                    for r in count.earlier[me].tolist():
                        met[have.get(r, [])] = True
                    linked = linked[~met[linked - offset]]
                count.partners[me] += count.copies[linked].sum()
                np.add.at(count.partners, linked[linked >= len(sets)], count.copies[me])  # pairs of two sets are met from either side
            for other in np.unique(label[linked], return_index=True)[1]:
                j = int(linked[other])
                if label[j] != label[me]:
                    out.append((me, j))
                    label[label == label[j]] = label[me]
            done += 1
        if done < hi:
            starts = [done, *(done + 1 + np.flatnonzero(shared[done + 1 : hi] == end)).tolist(), hi]
            stack += [(x, y, end, active, overlap) for x, y in zip(starts, starts[1:], strict=False)]
    return out


def _places(lists: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each number in ``lists``, the places of the lists that hold it."""
    values = np.concatenate([np.zeros(0, np.int64), *lists])
    order = np.argsort(values, kind="stable")
    place = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]
    kinds, start = np.unique(values[order], return_index=True)
    return dict(zip(kinds.tolist(), np.split(place, start[1:]), strict=True)) if len(kinds) else {}


def count_links(sets: list[np.ndarray], probes: list[np.ndarray] | None, percent: int, count: Count) -> list[tuple[int, int]]:
    """trie_links with ``count``, less the pairs that share the most frequent earlier root: they count there."""
    n = len(sets)
    places = _places(count.earlier)
    known = np.zeros(len(count.earlier), bool)
    if places:
        known[max(places.values(), key=len)] = True
    whole = sets + (probes or [])
    new, old = np.flatnonzero(~known[:n]), np.flatnonzero(known[:n])
    if probes is None:
        walks = [(new, old, True)]
    else:
        others, met = n + np.flatnonzero(~known[n:]), n + np.flatnonzero(known[n:])
        walks = [(new, np.concatenate([others, met]), False), (others, old, False)]
    out = []
    for a, b, within in walks:
        if len(a) and (len(b) or within and len(a) > 1):
            both = np.concatenate([a, b])
            part = Count(count.copies[both], [count.earlier[k] for k in both], np.zeros(len(both), np.int64))
            found = trie_links([whole[k] for k in a], [whole[k] for k in b], percent, part, within)
            count.partners[both] += part.partners
            out += [(int(both[i]), int(both[j])) for i, j in found]
    return out


def _packed(signs: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a chunk sends: its signatures with the marks that have each, and pairs (a mark, another that follows it).

    Of a signature that more than FEW marks of the chunk have only the least is sent; the others follow it.
    """
    order = np.lexsort((marks, signs))
    s, m = signs[order], marks[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    size = np.diff(np.append(start, len(s)))
    first = np.zeros(len(s), bool)
    first[start] = True
    many = np.repeat(size > FEW, size)
    follow = many & ~first
    return s[~follow], m[~follow], *_pairs(np.repeat(m[start], size)[follow], m[follow])


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    return a[new], b[new]


def _meet(signs: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, mark) of signatures that several marks have; the root is the least of them."""
    order = np.lexsort((marks, signs))
    s, m = signs[order], marks[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    size = np.diff(np.append(start, len(s)))
    root = np.repeat(m[start], size)
    several = np.repeat(m[start] != m[start + size - 1], size) if len(start) else np.zeros(0, bool)
    return _pairs(root[several], m[several])


DOCUMENT, FOLLOWS, MEETS = 0, 1, 2


def _described(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One pass over ``docs`` (doc_id, text, key): rows (what, a, b, c, d) of three kinds.

    DOCUMENT doc_id, set size, mark, key; FOLLOWS a mark and one that shares a signature with it in a chunk;
    MEETS a root and a mark of its group.
    """
    n_buckets = buckets(docs.sparkSession)
    wire = ["bucket", "what", "x", "y", "z", "w"]

    def chunk(ids: list[pa.Array], keys: list[pa.Array], n: list[int], mark: list[int], signs: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
        none = np.zeros(0, _U)
        sign, least, leader, follower = _packed(np.concatenate([none, *signs]), np.concatenate([none, *marks]))
        to = (sign % _U(n_buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        there, start = np.unique(to[order], return_index=True)
        parts = np.split(order, start[1:]) if len(there) else []
        doc_id = pa.concat_arrays(ids)
        known = doc_id.is_valid().to_numpy(zero_copy_only=False)
        number = np.array(mark, _U)
        home = int(mix64(np.array([len(number)], _U) + number[:1].sum())[0] % _U(n_buckets))
        rows = [(home, DOCUMENT, doc_id.fill_null(0).to_numpy().tobytes(), np.array(n, np.int64).tobytes(), number.tobytes(), pa.concat_arrays(keys).to_numpy().tobytes() + known.tobytes()), (home, FOLLOWS, leader.tobytes(), follower.tobytes(), b"", b"")]
        rows += [(int(k), MEETS, sign[p].tobytes(), least[p].tobytes(), b"", b"") for k, p in zip(there, parts, strict=True)]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], wire)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ([], [], [], [], [], [])
        seen: set[int] = set()
        total = 0
        for whole in batches:
            for batch in text_slices(whole, "text"):
                ids, keys, n, mark, signs, marks = held
                for s in shingle_sets(batch["text"], size):
                    n.append(len(s))
                    mark.append(_print(s))
                    if len(s) and mark[-1] not in seen:
                        seen.add(mark[-1])
                        signs.append(signatures(s, percent))
                        marks.append(np.full(len(signs[-1]), mark[-1], _U))
                ids.append(batch["doc_id"])
                keys.append(batch["key"])
                total += batch["text"].nbytes
                if total >= CHUNK_BYTES:
                    yield chunk(*held)
                    held, total = ([], [], [], [], [], []), 0
                    seen.clear()
        if held[0]:
            yield chunk(*held)
        pa.default_memory_pool().release_unused()

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(what: int, a: pa.Array, *rest: np.ndarray) -> pa.RecordBatch:
            columns = [as_long(x) for x in rest] + [pa.nulls(len(a), pa.int64())] * (3 - len(rest))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), what), pa.int32()), a, *columns], ["what", "a", "b", "c", "d"])

        for rows in row_groups(batches, ["bucket"]):
            signs, marks = [np.zeros(0, _U)], [np.zeros(0, _U)]
            for what, x, y, z, w in zip(*(rows[c].to_pylist() for c in wire[1:]), strict=True):
                if what == MEETS:
                    signs.append(np.frombuffer(x, _U))
                    marks.append(np.frombuffer(y, _U))
                elif what == FOLLOWS:
                    yield out(FOLLOWS, as_long(np.frombuffer(x, _U)), np.frombuffer(y, _U))
                else:
                    m = len(x) // 8
                    ids = pa.array(np.frombuffer(x, np.int64), mask=~np.frombuffer(w[8 * m :], bool))
                    yield out(DOCUMENT, ids, np.frombuffer(y, np.int64), np.frombuffer(z, _U), np.frombuffer(w[: 8 * m], np.int64))
            root, mark = _meet(np.concatenate(signs), np.concatenate(marks))
            yield out(MEETS, as_long(root), mark)

    sent = docs.select("doc_id", "text", "key").mapInArrow(send, "bucket long, what int, x binary, y binary, z binary, w binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(receive, "what int, a long, b long, c long, d long")


def _members(described: DataFrame) -> DataFrame:
    """(root, mark) of all meeting groups: marks that follow one are in its groups, or in one of its own if it has none."""
    meets = described.where(F.col("what") == MEETS).select(F.col("a").alias("root"), F.col("b").alias("lead")).distinct()
    follows = described.where(F.col("what") == FOLLOWS).select(F.col("a").alias("lead"), F.col("b").alias("mark")).distinct()
    alone = follows.select("lead").distinct().join(meets, "lead", "left_anti")
    groups = meets.union(alone.select("lead", "lead"))
    return groups.select("root", F.col("lead").alias("mark")).union(groups.join(follows, "lead").select("root", "mark")).distinct()


def _without_subsets(members: DataFrame) -> DataFrame:
    """``members`` without groups whose marks all stand in one other group: in the largest one that their root is in.

    Of groups with equal marks the one with the smallest root stays; so what a dropped group held together, a
    larger one that stays holds.
    """
    size = members.groupBy("root").agg(F.count("*").alias("size"))
    order = F.struct("size", (-F.col("root")).alias("root"))
    best = members.join(size, "root").groupBy("mark").agg(F.max(order).alias("best"))
    over = best.select(F.col("mark").alias("root"), (-F.col("best.root")).alias("over")).where("root <> over")
    there = members.select(F.col("root").alias("over"), "mark", F.lit(1).alias("there"))
    held = members.join(over, "root").join(there, ["over", "mark"], "left").groupBy("root").agg(F.count("*").alias("all"), F.count("there").alias("held"))
    return members.join(held.where("all = held").select("root"), "root", "left_anti")


_ZSTD = "zstd"


def _folded(text: bytes) -> bytes:
    return len(text).to_bytes(8, "little") + pa.compress(text, _ZSTD, asbytes=True)


def _opened(packed: list[bytes], size: int) -> list[np.ndarray]:
    texts = [pa.decompress(x[8:], int.from_bytes(x[:8], "little"), _ZSTD, asbytes=True) for x in packed]
    return list(shingle_sets(pa.array(texts, pa.large_binary()), size))


def _sets(docs: DataFrame, size: int, every: bool) -> DataFrame:
    """(root, b, mark, n, packed, copies, earlier) of one document for each set and group."""
    names = ["root", "b", "mark", "n", "packed", "copies", "earlier"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in text_slices(whole, "text"):
                out: list[list] = [[] for _ in names]
                texts = batch["text"].cast(pa.large_binary())
                for k, (want, n, same, roots) in enumerate(zip(*(batch[c].to_pylist() for c in ("mark", "n", "copies", "roots")), strict=True)):
                    if want in seen:
                        continue
                    seen.add(want)
                    packed = _folded(texts[k].as_py())
                    ordered = sorted((r["root"], r["b"]) for r in roots)
                    numbers = np.array([r for r, _ in ordered], np.int64)
                    for i, (root, b) in enumerate(ordered):
                        for column, x in zip(out, (root, b, want, n, packed, same, numbers[:i].tobytes() if every else b""), strict=True):
                            column.append(x)
                kinds = [pa.int64()] * 4 + [pa.binary(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)
        pa.default_memory_pool().release_unused()

    return docs.select("text", "mark", "n", "copies", "roots").mapInArrow(run, "root long, b long, mark long, n long, packed binary, copies long, earlier binary")


def _joined(rows: DataFrame, keys: list[str], size: int, percent: int, every: bool = False) -> DataFrame:
    """Links (u, v) of marks within each group of ``keys``; where ``probe`` is set, between the two sides.

    With ``every``, also ``partners``: links that connect have 0, and a row (mark, mark) has a set's rows
    linked within the group.
    """
    names = ["u", "v", "partners"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, c = [], [], []
        for group in row_groups(batches, keys):
            sides: tuple[dict, dict] = ({}, {})
            for mark, packed, probe, *more in zip(*(group[x].to_pylist() for x in carried), strict=True):
                sides[probe].setdefault(mark, (packed, *more))
            marks = [*sides[0], *sides[1]]
            two = group["two"][0].as_py()
            if len(sides[0]) and (len(sides[1]) if two else len(sides[0]) > 1):
                own, probes = (_opened([x[0] for x in side.values()], size) for side in sides)
                if every:
                    extra = [*sides[0].values(), *sides[1].values()]
                    count = Count(np.array([x[1] for x in extra]), [np.frombuffer(x[2], np.int64) for x in extra], np.zeros(len(extra), np.int64))
                    links = count_links(own, probes if two else None, percent, count)
                    some = np.flatnonzero(count.partners).tolist()
                    u += [marks[k] for k in some]
                    v += [marks[k] for k in some]
                    c += count.partners[some].tolist()
                else:
                    links = trie_links(own, probes if two else None, percent)
                for i, j in links:
                    u.append(marks[i])
                    v.append(marks[j])
                    c.append(0)
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, c)], names)
                u, v, c = [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, c)], names)

    carried = ["mark", "packed", "probe", *(["copies", "earlier"] if every else [])]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    found = dealt.select(*keys, *carried, "two").mapInArrow(run, "u long, v long, partners long")
    return found if every else found.select("u", "v")


def _distances(rows: DataFrame, size: int) -> DataFrame:
    """Members of large groups with ``d``, their Jaccard distance from the leader, and ``linked``; a group's rows are dealt into its b parts."""
    names = ["root", "b", "mark", "n", "packed", "common", "leader_n"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaders: dict[int, np.ndarray] = {}
        common = []
        for root, s, leader in zip(batch["root"].to_pylist(), _opened(batch["packed"].to_pylist(), size), batch["leader"].to_pylist(), strict=True):
            if root not in leaders:
                leaders[root] = _opened([leader], size)[0]
            common.append(len(np.intersect1d(s, leaders[root], assume_unique=True)))
        return pa.RecordBatch.from_arrays([*(batch[c] for c in names[:5]), pa.array(common, pa.int64()), batch["leader_n"]], names)

    leaders = rows.where("mark = root").groupBy("root").agg(F.first("packed").alias("leader"), F.first("n").alias("leader_n"), F.first("b").alias("b"))
    leaders = leaders.select("root", "leader", "leader_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)).alias("i"))
    both = rows.withColumn("i", F.pmod(F.xxhash64("mark", F.lit(3)), "b")).join(leaders, ["root", "i"]).select("root", "b", "mark", "n", "packed", "leader", "leader_n")
    out = map_batches(both, run, "root long, b long, mark long, n long, packed binary, common long, leader_n long", "packed")
    return out.withColumn("d", 1 - F.col("common") / (F.col("n") + F.col("leader_n") - F.col("common")))


def _parts(most: int, most_sets: int):
    return F.greatest(F.lit(1), F.ceil(F.sum("n") / most), F.ceil(F.count("*") / most_sets)).cast("long")


def _large_links(rows: DataFrame, size: int, percent: int, most: int, most_sets: int) -> DataFrame:
    """Links in groups larger than a task: leader first, then the rest in blocks."""
    near = staged(_distances(rows, size).withColumn("linked", F.expr(f"{100 + percent} * common >= {percent} * (n + leader_n)")).drop("b"))
    far = 1 - percent / 100
    rest = near.where("not linked")
    blocks_of = rest.groupBy("root").agg(_parts(most, most_sets).alias("b"), F.min("d").alias("nearest"))
    rest = rest.join(blocks_of, "root").withColumn("i", F.pmod(F.xxhash64("mark", F.lit(1)), "b"))
    every = F.sequence(F.lit(0).cast("long"), F.col("b") - 1)
    # block against block of the rest, itself included; then the rest against what is linked and within reach
    pairs = rest.select("root", "mark", "packed", "b", "i", F.explode(every).alias("j"))
    within = pairs.select("root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.lit(0).cast("long").alias("k"), "mark", "packed", (F.col("i") > F.col("j")).cast("int").alias("probe"), (F.col("i") != F.col("j")).alias("two"))
    reach = near.where("linked").join(blocks_of, "root").where(F.col("d") >= F.col("nearest") - far - 1e-9)
    n = near.where("linked").groupBy("root").agg(_parts(most, most_sets).alias("c"))
    reach = reach.join(n, "root").withColumn("k", 1 + F.pmod(F.xxhash64("mark", F.lit(2)), "c"))
    a = reach.select("root", F.explode(every).alias("i"), F.lit(0).cast("long").alias("j"), "k", "mark", "packed", F.lit(1).alias("probe"), F.lit(True).alias("two"))
    r = rest.where(F.col("d") <= 2 * far + 1e-9).join(n, "root").select("root", "i", F.lit(0).cast("long").alias("j"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("k"), "mark", "packed", F.lit(0).alias("probe"), F.lit(True).alias("two"))
    blocks = within.unionByName(a).unionByName(r)
    return near.where("linked and mark <> root").select(F.col("root").alias("u"), F.col("mark").alias("v")).union(_joined(blocks, ["root", "i", "j", "k"], size, percent))


def _all_blocks(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """_joined with ``every``: each block of a group with itself and with every other, each pair once."""
    dealt = rows.withColumn("i", F.pmod(F.xxhash64("mark", F.lit(1)), "b"))
    pairs = dealt.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("b") - 1)))
    probe = (F.col("i") > F.col("j")).cast("int").alias("probe")
    blocks = pairs.select("root", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "mark", "packed", "copies", "earlier", probe, (F.col("i") != F.col("j")).alias("two"))
    return _joined(blocks, ["root", "i", "j"], size, percent, True)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """jaccard_components with ``n_links``: the other rows with an id that the row links with, copies included.

    Every linked pair of different texts is verified and counted once. Rows with a null id have a null n_links.
    """
    return _linked(docs, id_col, text_col, size, percent, group_shingles, True)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """Each row of ``docs`` with the component of its links: doc_id, n_shingles, component_id.

    Words are runs of bytes other than space and \\t-\\r, A-Z as a-z. A set is a text's distinct shingles of
    ``size`` words; a text of fewer words is one shingle. Two rows link if 100 * |a & b| >= percent * |a | b|;
    component_id is the smallest id that a row reaches, itself included. Null and blank texts have empty
    sets, n_shingles 0, and link with nothing. Equal texts link. Rows with a null id link as all others do, but
    have no id to lend: among such rows alone component_id is null. Other columns are not read. Very long texts
    are whole sets; an empty table gives an empty table. Shingles count as equal if their 64-bit hashes are, sets if size and
    64-bit fingerprint are.
    """
    return _linked(docs, id_col, text_col, size, percent, group_shingles, False)


def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, group_shingles: int, every: bool, group_sets: int = GROUP_SETS) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))  # names a row that has no id
    passed = staged(_described(docs, size, percent))
    described = passed.where(F.col("what") == DOCUMENT).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), F.col("c").alias("mark"), F.col("d").alias("key"))
    first = F.min_by("key", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("key")
    classes = described.where("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.count("doc_id").alias("copies"), F.max("n_shingles").alias("n"), first)
    members = staged(_without_subsets(staged(_members(passed))))
    sized = members.join(classes.select("mark", "n"), "mark")
    weight = sized.groupBy("root").agg(_parts(group_shingles, group_sets).alias("b"))

    def sets(weight: DataFrame, few: bool = False) -> DataFrame:
        roots = members.join(weight, "root").groupBy("mark").agg(F.collect_list(F.struct("root", "b")).alias("roots"))
        need = roots.join(classes, "mark").drop("doc_id")
        return _sets(docs.select("text", "key").join(F.broadcast(need) if few else need, "key"), size, every)

    if every:
        links = _all_blocks(sets(weight), size, percent)
    else:
        small = sets(weight.where("b = 1")).select("root", "mark", "packed", F.lit(0).alias("probe"), F.lit(False).alias("two"))
        links = _joined(small, ["root"], size, percent)
        large = weight.where("b > 1")
        if not large.isEmpty():
            few = members.join(large, "root").limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
            links = links.union(_large_links(sets(large, few).drop("copies", "earlier"), size, percent, group_shingles, group_sets))
    if every:
        links = staged(links)
    groups = connected_components(links)
    named = classes.join(groups.withColumnRenamed("node", "mark"), "mark", "left").select("mark", "doc_id", F.coalesce("component", "mark").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of = named.join(least, "component").select("mark", "component_id")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    if not every:
        return described.join(of, "mark", "left").select("doc_id", "n_shingles", component)
    partners = links.where("partners > 0").groupBy(F.col("u").alias("mark")).agg(F.sum("partners").alias("partners"))
    of = of.join(classes.select("mark", "copies"), "mark").join(partners, "mark", "left")
    n = F.when(F.col("n_shingles") > 0, F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).otherwise(F.lit(0).cast("long"))
    return described.join(of, "mark", "left").select("doc_id", "n_shingles", component, F.when(F.col("doc_id").isNotNull(), n).alias("n_links"))
