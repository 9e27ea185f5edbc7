import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest

from docweave.llm import ngram_join as J


def brute(rows, size=4, percent=85):
    def grams(text):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(size, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = [(i, grams(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[top(k)] = min(i, least.get(top(k), i))
    return sorted((i, len(s), least[top(k)] if s else i) for k, (i, s) in enumerate(sets))


def corpus(seed, families=6, each=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows, doc_id = [], 0
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 8, 17, 40, 90, 200]))]
        for _ in range(each):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            text = " ".join(w)
            if r.random() < 0.2:
                text += "\n" + passage
            if r.random() < 0.2:
                text = text.upper()
            rows.append((doc_id, text))
            doc_id += 1
    rows += [(doc_id, None), (doc_id + 1, ""), (doc_id + 2, " \t\n"), (doc_id + 3, rows[0][1]), (doc_id + 4, "one two"), (doc_id + 5, "One TWO"), (doc_id + 6, "é É"), rows[1]]
    r.shuffle(rows)
    return rows


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, root string, sign int").repartition(3)
    return sorted(tuple(x) for x in J.jaccard_components(docs, **options).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_large_groups_take_the_leader_and_block_path(spark):
    rows = corpus(3, families=3, each=30)
    assert found(spark, rows, group_shingles=150) == brute(rows)


def test_empty_table(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_trie_links_connect_what_pairs_connect():
    r = np.random.default_rng(5)
    for _ in range(40):
        base = r.integers(0, 1 << 60, 120, dtype=np.uint64)
        sets = []
        for _ in range(int(r.integers(2, 14))):
            keep = base[r.random(len(base)) > r.choice([0.0, 0.03, 0.08, 0.5])]
            extra = r.integers(0, 1 << 60, int(r.integers(0, 8)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate([keep, extra, base[:1]])))
        cut = int(r.integers(1, len(sets)))
        for probes in (None, sets[cut:]):
            own = sets if probes is None else sets[:cut]
            whole = own + (probes or [])
            true = [(i, j) for i in range(len(own)) for j in range(len(whole)) if i != j and (probes is None or j >= len(own)) and 100 * len(np.intersect1d(whole[i], whole[j])) >= 85 * len(np.union1d(whole[i], whole[j]))]
            links = J.trie_links(own, probes)
            assert set(links) <= set(true)
            assert groups(len(whole), links) == groups(len(whole), true)


def groups(n, links):
    label = list(range(n))
    for i, j in links:
        a, b = label[i], label[j]
        label = [a if x == b else x for x in label]
    return {frozenset(k for k in range(n) if label[k] == x) for x in label}


def test_signatures_of_linked_sets_meet():
    r = np.random.default_rng(7)
    for n in [1, 2, 5, 6, 7, 9, 15, 16, 31, 40, 200, 1000]:
        for _ in range(60):
            a = np.unique(r.integers(0, 1 << 60, n, dtype=np.uint64))
            apart = int(15 * 2 * n / 185)
            drop = int(r.integers(0, apart + 1))
            b = np.unique(np.concatenate([a[r.permutation(len(a))[drop:]], r.integers(0, 1 << 60, int(r.integers(0, apart - drop + 1)), dtype=np.uint64)]))
            if len(b) and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b)):
                assert np.intersect1d(J.signatures(a), J.signatures(b)).size


def test_large_group_whose_smallest_mark_has_only_null_ids(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join([*words[:99], f"x{k}"]) for k in range(12)]
    marks = [np.uint64(J._print(next(J.shingle_sets(pa.array([t]), 4)))).view(np.int64) for t in texts]
    texts = [texts[k] for k in np.argsort(marks)]
    rows = [(None, texts[0]), *((10 + k, t) for k, t in enumerate(texts[1:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in J.jaccard_components(docs, group_shingles=150).collect() if x.doc_id is not None}
    assert got == {10 + k: 10 for k in range(11)}


@pytest.mark.parametrize("most", [J.GROUP_SHINGLES, 150])
def test_rows_without_an_id_link_others(spark, most):
    """1 and 3 link only with a row that has no id; so do its copies, and they reach 1 as well."""
    words = [f"w{k}" for k in range(100)]
    change = lambda k: " ".join(words[k:] + [f"x{i}" for i in range(k)])
    rows = [(3, change(0)), (None, change(5)), (1, change(10)), (None, change(5)), (None, "quite another"), (None, None), (8, "quite another")]
    assert [tuple(x[2] for x in brute([(9 + k, t) for k, (_, t) in enumerate(part)])) for part in (rows[:3], [rows[0], rows[2]])] == [(9, 9, 9), (9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for f in (J.jaccard_components, J.jaccard_links):
        got = sorted((x.doc_id or 0, x.component_id or 0) for x in f(docs, group_shingles=most).collect())
        assert got == [(0, 0), (0, 1), (0, 1), (0, 8), (1, 1), (3, 1), (8, 8)]


def test_marks_that_share_a_signature_share_a_group():
    """Whatever chunks the marks come from: each pair is in the group of a root that chunks or buckets name."""
    r = np.random.default_rng(11)
    for _ in range(50):
        signs = {m: np.unique(np.where([True, True, r.random() < 0.3], r.integers(1, 30, 3), 0)).astype(np.uint64) for m in range(90)}
        chunks = [[m for m in signs if r.random() < 0.4] for _ in range(4)]
        sent = [J._packed(np.concatenate([signs[m] for m in c] or [np.zeros(0, np.uint64)]), np.repeat(np.array(c, np.uint64), [len(signs[m]) for m in c])) for c in chunks]
        assert any(len(x[2]) for x in sent) or not chunks
        root, lead = J._meet(*(np.concatenate([x[i] for x in sent]) for i in (0, 1)))
        groups = {}
        for a, b in zip(root.tolist(), lead.tolist(), strict=True):
            groups.setdefault(b, set()).add(a)
        of = {m: set(groups.get(m, ())) for c in chunks for m in c}
        for x in sent:
            for a, b in zip(x[2].tolist(), x[3].tolist(), strict=True):
                of[a] |= groups.get(a, {a})
                of[b] |= groups.get(a, {a})
        for a in of:
            for b in of:
                if a != b and np.intersect1d(signs[a], signs[b]).size:
                    assert of[a] & of[b]


def test_many_half_alike_sets_are_walked_fast():
    r = np.random.default_rng(13)
    base = r.integers(0, 1 << 60, 100, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[r.random(100) < 0.5], r.integers(0, 1 << 60, 50, dtype=np.uint64)])) for _ in range(8000)]
    began = time.process_time()
    assert J.trie_links(sets) == []
    assert time.process_time() - began < 5


def brute_counts(rows):
    """Each row's id with the number of other rows that it links with."""
    sets = [next(J.shingle_sets(pa.array([t or ""]), 4)) for _, t in rows]
    linked = lambda x, y: len(x) and len(y) and 100 * len(np.intersect1d(x, y)) >= 85 * len(np.union1d(x, y))
    return sorted((i, sum(1 for b in range(len(rows)) if b != a and linked(sets[a], sets[b]))) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("most", [J.GROUP_SHINGLES, 150])
def test_every_link_counts(spark, most):
    rows = corpus(4, families=3, each=24)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = J.jaccard_links(docs, group_shingles=most).collect()
    assert sorted((x.doc_id, x.n_links) for x in got) == brute_counts(rows)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute(rows)


def test_walk_counts_pairs_once():
    r = np.random.default_rng(9)
    for _ in range(40):
        base = r.integers(0, 1 << 60, 120, dtype=np.uint64)
        sets = [np.unique(np.append(base[r.random(len(base)) > 0.06], base[:1])) for _ in range(int(r.integers(2, 16)))]
        copies = r.integers(1, 5, len(sets))
        earlier = [np.flatnonzero(r.random(4) < 0.3) for _ in sets]
        cut = int(r.integers(1, len(sets)))
        for probes in (None, sets[cut:]):
            own = len(sets) if probes is None else cut
            want = np.zeros(len(sets), np.int64)
            for i in range(len(sets)):
                for j in range(i):
                    pair = probes is None or j < cut <= i
                    if pair and not np.intersect1d(earlier[i], earlier[j]).size and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                        want[i] += copies[j]
                        want[j] += copies[i]
            count = J.Count(copies, earlier, np.zeros(len(sets), np.int64))
            J.count_links(sets[:own], probes, 85, count)
            assert count.partners.tolist() == want.tolist()
