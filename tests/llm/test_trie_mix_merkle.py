"""The prefix trie, the mix and the manifest against plain versions, on rows of every odd kind."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm import merkle, mixing, prefix_trie
from docweave.llm.running import plus, running, xor

DOCS = "doc_id long, source string, lang string, n_chars long, text string, row int, copy int, hash string"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents(seed: int, n: int, hot: float = 0.4) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = "hot" if rng.random() < hot else rng.choice([None, "", "a", "b", "-", "=", "\U0001f600", "", "zß"])
        text = rng.choice([None, "", " \t", "Ein Wort", "x" * 5000, "A b\x0bC\x1fd  e", " ".join("wörter" for _ in range(rng.randrange(40)))])
        rows.append((k, source, rng.choice([None, "de"]), rng.choice([None, k]), text, 1, 2, "h"))
    rows += rows[:5] + [(None, "a", None, None, None, 1, 2, "h")] * 2 + [(None, None, "x", 3, "Null ID", 1, 2, "h"), (3, "a", "other", 1, "same id", 1, 2, "h")]
    return rows


# running


@pytest.mark.parametrize("n", [0, 1, 500])
def test_running_totals(spark, n):
    rng = random.Random(n)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", k, rng.randrange(100)) for k in range(n)]
    got = running(spark.createDataFrame(rows, "k string, at long, v long"), ["k"], [F.col("at")], {"s": plus(F.col("v")), "x": xor(F.col("v"))})
    state, want = {}, []
    for k, at, v in rows:
        s, x = state.get(k, (0, 0))
        state[k] = s + v, x ^ v
        want.append((k, at, v, *state[k]))
    assert sorted(tuple(r) for r in got.collect()) == sorted((*w, *state[w[0]]) for w in want)


def test_hot_group_lies_in_many_partitions(spark):
    rows = spark.range(0, 20_000, 1, 8).select(F.lit("one").alias("k"), "id")
    seen = running(rows, ["k"], [F.col("id")], {"n": plus(F.lit(1))})
    assert seen.where("n <> id + 1 or all_n <> 20000").isEmpty() and seen.count() == 20_000


# op12


def plain_targets(sizes: dict) -> dict:
    """Shares by weight; full sources keep what they may have, and the others share again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, full = {}, 1.5 * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        if not rest:
            return target
        share = {s: weight[s] * left / rest for s in order if s not in full}
        over = [s for s in share if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            full.add(s)
            target[s] = 2.0 * sizes[s]
            left -= target[s]


@pytest.mark.parametrize(("seed", "n"), [(1, 3), (2, 60), (3, 400)])
def test_mix_targets_and_copies(spark, seed, n):
    rows = documents(seed, n)
    got = mixing.planned(mixing.measured(spark.createDataFrame(rows, DOCS))).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[1]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[4] or ""))
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 2
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_comes_near_its_targets_and_agrees_with_itself(spark):
    rows = spark.range(0, 30_000, 1, 8).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 11).cast("int")).alias("text"))
    for docs in (rows, rows.withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", (F.monotonically_increasing_id()).cast("string")))):
        one, two = ({tuple(r) for r in mixing.planned(mixing.measured(d)).groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size"))).collect()} for d in (docs, docs))
        assert one == two and all(abs(taken - target) < 0.05 * target for _, target, taken in one)


def test_mix_repeats_whole_rows(spark):
    rows = documents(5, 80)
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.planned(mixing.measured(docs))
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "source", "lang", "n_chars", "text", "row", "hash", "copy"]
    assert out.count() == plan.agg(F.sum("copies")).first()[0]
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.planned(mixing.measured(docs.limit(0))).count() == 0
    with pytest.raises(ValueError, match="share"):
        mixing.mix(docs, share=3.0)


def test_sources_without_words(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, " ")], "doc_id long, source string, text string")
    assert [(r.target, r.copies) for r in mixing.planned(mixing.measured(docs)).collect()] == [(0.0, 0)] * 2


# op13


def plain_field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The top digest, and for each leaf its place and siblings by level."""
    at = list(range(len(leaves)))
    paths: list[list] = [[] for _ in leaves]
    level = leaves
    while len(level) > 1:
        runs = [level[i : i + 16] for i in range(0, len(level), 16)]
        for k, i in enumerate(at):
            run = runs[i // 16]
            paths[k].append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        at = [i // 16 for i in at]
        level = [sha("".join(r)) for r in runs]
    return level[0], paths


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tree = {}
    for s in order:
        own = sorted(((r[0] is not None, r[0] or 0, sha("".join(map(plain_field, r[:5]))), r) for r in groups[s]), key=lambda x: x[:3])
        tree[s] = (own, *plain_tree([x[2] for x in own]))
    root, upper = plain_tree([tree[s][1] for s in order])
    out = []
    for s, above in zip(order, upper, strict=True):
        own, sub, paths = tree[s]
        for (_, _, leaf, r), path in zip(own, paths, strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            h = sha("".join(map(plain_field, (*r[:4], text))))
            for i, others in path + above:
                h = sha("".join(others[:i] + [h] + others[i:]))
            out.append((r[0], leaf, sub, root, sha("".join(x for _, others in path + above for x in others)), h, h == root))
    return out


@pytest.mark.parametrize(("seed", "n"), [(1, 0), (2, 40), (3, 700)])
def test_manifest(spark, seed, n):
    rows = documents(seed, n, hot=0.6)
    got = [tuple(r) for r in merkle.tamper_check(spark.createDataFrame(rows, DOCS)).collect()]
    want = plain_manifest(rows)
    by = lambda r: tuple(map(str, r))
    assert sorted(got, key=by) == sorted(want, key=by)
    assert n < 700 or {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("rows", [[], [(7, "a", "de", 1, "Only", 1, 2, "h")], [(k, "a", None, None, None, 1, 2, "h") for k in range(17)], [(k, str(k), None, None, "T", 1, 2, "h") for k in range(16)]])
def test_manifest_of_few(spark, rows):
    got = sorted(tuple(r) for r in merkle.tamper_check(spark.createDataFrame(rows, DOCS)).collect())
    assert got == (sorted(plain_manifest(rows)) if rows else [])


def test_fields_do_not_run_into_each_other(spark):
    rows = [(1, "a", "b", None, "c"), (1, "a", "b1:c", None, None)]
    leaves = merkle.manifest(spark.createDataFrame([(*r, 1, 2, "h") for r in rows], DOCS)).select("leaf").collect()
    assert leaves[0] != leaves[1]


# op11


def plain_trie(rows: list[tuple], change: bool = True) -> list[tuple]:
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if change else 0
        seq = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        own_words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * own_words + sum(saved[k] for k in children[p])
    return [(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()]


def conversations(seed: int, n: int, deepest: int) -> list[tuple]:
    """Walks in a small tree of turns, some of them very alike; odd turn numbers, ties, nulls and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 40 * n), n):
        for d in range(rng.randrange(deepest + 1)):
            text = "the same" if rng.random() < 0.8 else rng.choice(["other words here", None, "", "ü\x0bx"])
            rows.append((c, rng.choice([d, d, d, 2, None]), rng.choice(["user", "user", None, ""]), text))
    return rows + rows[:3] + [(None, 1, "user", "lost")]


SAID = "conv_id long, turn long, role string, text string, c int, depth int, words int"


@pytest.mark.parametrize(("seed", "n", "deepest"), [(1, 1, 1), (2, 30, 4), (3, 200, 7), (4, 12, 60)])
def test_trie(spark, monkeypatch, seed, n, deepest):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)
    rows = conversations(seed, n, deepest)
    got = prefix_trie.conversation_trie(spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SAID))
    by = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.collect()), key=by) == sorted(plain_trie(rows), key=by)


def test_trie_of_conversations_as_they_are(spark):
    rows = [(c, d, "user", f"turn {d}") for c in range(1, 50) for d in range(c % 7 + 1)]
    placed = prefix_trie.turns(spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SAID))
    got = prefix_trie.trie(prefix_trie.plain(placed)).collect()
    by = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got), key=by) == sorted(plain_trie(rows, change=False), key=by)


def test_empty_trie(spark):
    assert prefix_trie.conversation_trie(spark.createDataFrame([], SAID)).count() == 0


def test_only_points_are_made(spark):
    rows = [(c, d, "user", "same" if d < 50 else f"{c}") for c in range(3) for d in range(60)]
    placed = prefix_trie.turns(spark.createDataFrame([(*r, 1, 1, 1) for r in rows], SAID))
    prefixes = prefix_trie._prefixes(prefix_trie.plain(placed))
    assert sorted(r.depth for r in prefix_trie._points(prefixes).collect()) == [0, 50, 60, 60, 60]
