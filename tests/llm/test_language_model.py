import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from docweave.llm import language_model as M
from docweave.llm import queries


def words(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    c = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in words(t))
    total, distinct = sum(c.values()), len(c)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        w = words(t)
        out.append((i, h, len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)))
    return out


def compare(got, want):
    got = sorted((x.doc_id, x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.base_score) for x in got)
    want = sorted(want)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in got], [x[5] for x in want])


def test_base_columns_on_the_documents_and_better_scores_on_held_out(spark):
    got = queries.op2_lm_scoring(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    compare(got, brute([(d.doc_id, d.text) for d in docs]))
    held = [x for x in got if x.held_out]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    assert all(x.score <= 0 and math.isfinite(x.score) for x in got)


def test_rare_words_nulls_repeated_rows_and_long_texts(spark):
    rows = [(k, f"the cat {'sat' if k % 3 else 'RAN'} on w{k} w{k % 7}.\nThe end") for k in range(40)]
    rows += [(50, None), (51, ""), (52, "the " * 30000), rows[3], rows[3], (3, "other text of the same id")]
    docs = spark.createDataFrame([(i, t, 5, 1) for i, t in rows], "doc_id long, text string, n int, mark int").repartition(3)
    for frequent in (1, 5, 1 << 17):
        got = M.lm_scores(docs, frequent=frequent, rounds=1).collect()
        compare(got, brute(rows))


def test_empty_and_untrained(spark):
    assert M.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    held = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 5 == 1)
    (row,) = M.lm_scores(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0)


def test_probabilities_sum_to_at_most_one(spark):
    """Over all known words and, for each slot, its unseen words."""
    docs = spark.createDataFrame([(k, f"a b c d{k % 5} e.{k} The b") for k in range(60)], "doc_id long, text string")
    model = M.fit(docs, rounds=1)
    hashes, ending, bounds = M.tokens(pa.array(["a b c"]))
    history = M.features(hashes, bounds)
    classes = np.exp(M._log_softmax(model.weights, model.bias, M.class_rows(history, model.buckets)).astype(float)).sum(1)
    assert np.allclose(classes, 1, atol=1e-4)
    for k in range(M.OWN_CLASSES, M.CLASSES):
        kind = np.full(len(hashes), k)
        slots = np.exp(M._log_softmax(model.weights, model.slot_bias[kind], M.slot_rows(history, kind, model.buckets)).astype(float)).sum(1)
        assert np.allclose(slots, 1, atol=1e-4)
    inside = np.zeros((M.CLASSES, M.SLOTS))
    for r in model.counts.collect():
        k, s = (x[0] for x in model.classes(np.array([r.word], np.int64).view(np.uint64), np.array([r.ending])))
        inside[k, s] += (1 - model.unseen[k, s]) * r.n / model.slot_tokens[k, s]
    assert (inside + model.unseen <= 1 + 1e-9).all()


def test_scores_against_a_naive_forward_pass(spark):
    """Each word's probability as a product of three factors, one softmax written out at a time."""
    r = np.random.default_rng(5)
    vocabulary = [f"w{k}{'aeiou'[k % 5]}" for k in range(90)]
    texts = [" ".join(r.choice(vocabulary, 30, p=np.arange(90, 0, -1) / 4095)) for _ in range(60)] + ["never seen w3o", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = docs.where("doc_id < 50")
    model = M.fit(train)
    counts = Counter(w for t in texts[:50] for w in words(t))

    def dot(rows, bias):
        z = [float(bias[j]) + sum(float(model.weights[i][j]) for i in rows) for j in range(len(bias))]
        return z, max(z) + math.log(sum(math.exp(x - max(z)) for x in z))

    got = {x.doc_id: x.score for x in M.score(docs, model, frequent=20).collect()}
    for k, text in enumerate(texts):
        hashes, ending, bounds = M.tokens(pa.array([text], pa.string()))
        history = M.features(hashes, bounds)
        total = 0.0
        for w, h, e, f in zip(words(text), hashes, ending, history, strict=True):
            kind, slot = (x[0] for x in model.classes(np.array([h]), np.array([e])))
            z, norm = dot(M.class_rows(f[None], model.buckets)[0], model.bias)
            total += z[kind] - norm
            if kind >= M.OWN_CLASSES:
                z, norm = dot(M.slot_rows(f[None], np.array([kind]), model.buckets)[0], model.slot_bias[kind])
                total += z[slot] - norm
            n, unseen = counts[w], model.unseen[kind, slot]
            total += math.log((1 - unseen) * n / model.slot_tokens[kind, slot]) if n else math.log(unseen)
        assert math.isclose(got[k], total / math.log(10), rel_tol=1e-4), text


def test_histories_tell_words_of_one_class_apart(spark):
    """Two words with the same ending and count, each after a word of its own: the slot factor must learn which."""
    docs = spark.createDataFrame([(k, "left xaz. right yaz. " * 20) for k in range(50)], "doc_id long, text string")
    model = M.fit(docs)
    asked = spark.createDataFrame([(1, "left xaz. right yaz."), (2, "left yaz. right xaz.")], "doc_id long, text string")
    got = {x.doc_id: x.score for x in M.score(asked, model).collect()}
    assert got[1] > got[2] + 1


def test_tables_and_partitions_follow_the_corpus():
    assert [M.table_rows(n) for n in (0, 10**6, 10**8, 10**12)] == [M.LEAST_BUCKETS, M.LEAST_BUCKETS, 1 << 17, M.MOST_BUCKETS]
    for n in (0, 10**8, 10**10, 10**13):
        parts, sent = M.train_parts(n, M.table_rows(n)), 2 * M.table_rows(n) * (2 * M.SLOTS + 6)
        assert parts == 8 or parts * sent <= 6 * n / 4


def test_merging_in_two_steps_averages_by_touches():
    rows = [M._moved(3, lane, np.array([1, 5]), np.full((2, M.SLOTS), value), np.array([n, 2 * n])) for lane, value, n in ((0, 1.0, 1), (0, 4.0, 2), (1, 2.0, 3))]
    first = list(M._merge(iter(rows)))
    again = [M.pa.RecordBatch.from_arrays([b["chunk"], pa.array([0]), *b.columns[2:]], b.schema.names) for b in first]
    ((k, lane, at, moved, touched),) = M._unpacked(M._merge(iter(again)))
    assert (k, lane, at.tolist(), touched.tolist()) == (3, 0, [1, 5], [6, 12])
    assert np.allclose(moved, (1 * 1 + 4 * 2 + 2 * 3) / 6, atol=1e-2)


def test_learning_lowers_the_loss():
    r = np.random.default_rng(1)
    at = r.integers(0, 50, (4000, 4))
    true = at[:, 0] % 64
    weights, squares, touched = np.zeros((64, 64), np.float32), np.zeros(64, np.float32), np.zeros(64)
    bias = np.zeros(64, np.float32)
    loss = lambda: -M._log_softmax(weights, bias, at)[np.arange(4000), true].mean()
    before = loss()
    for _ in range(20):
        M._learn(weights, squares, touched, bias, at, true)
    assert loss() < before / 3


def _crowded():
    """More words of one ending than a class has slots: most of them share one, half met after 'left', half after 'right'."""
    lines = [f"left l{k}xaz on right r{k}xaz on" for k in range(120)]
    r = np.random.default_rng(3)
    return [" ".join(lines[j] for j in r.permutation(120)) for _ in range(25)] + ["left r7xaz on Right l9xaz l11xaz", "right l7xaz on"]


def test_words_that_share_a_slot_are_told_apart_by_what_stands_before(spark):
    """Rare words of one slot with equal counts: none keeps the same share after every history."""
    docs = spark.createDataFrame(list(enumerate(_crowded())), "doc_id long, text string")
    model = M.fit(docs)
    pairs = [(k, j) for k in range(20, 100) for j in range(20, 100, 9) if k != j]
    words_of = {w: M.tokens(pa.array([w])) for k in range(120) for w in (f"l{k}xaz", f"r{k}xaz")}
    place = {w: tuple(x[0] for x in model.classes(h[:1], e[:1])) for w, (h, e, _) in words_of.items()}
    k = next(k for k, j in pairs if place[f"l{k}xaz"] == place[f"r{k}xaz"] and place[f"l{k}xaz"][1] >= M.WORDS)
    asked = spark.createDataFrame([(1, f"on left l{k}xaz on"), (2, f"on left r{k}xaz on"), (3, f"on right r{k}xaz on"), (4, f"on right l{k}xaz on")], "doc_id long, text string")
    got = {f: {x.doc_id: x.score for x in M.score(asked, model, frequent=f).collect()} for f in (1, 1 << 17)}
    assert all(got[f][1] > got[f][2] + 0.5 and got[f][3] > got[f][4] + 0.5 for f in got)
    assert all(math.isclose(got[1][d], got[1 << 17][d], rel_tol=1e-6) for d in got[1])


def test_shared_slots_against_counts_by_hand_and_sums_of_one(spark):
    texts = _crowded()
    model = M.fit(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    met, n, at = Counter(), Counter(), {}
    for text in texts:
        hashes, ending, bounds = M.tokens(pa.array([text]))
        kind, slot = model.classes(hashes, ending)
        for h, k, s, b in zip(hashes, kind, slot, [M.CLASSES, *kind[:-1]], strict=True):
            met[h, int(b)] += 1
            n[h] += 1
            at[h] = int(k), int(s)
    stored = {(np.int64(r.word).astype(np.uint64), b): m for r in model.counts.collect() for b, m in zip(r.before, r.met, strict=True)}
    assert stored == met
    groups = {x for x in at.values() if x[0] >= M.OWN_CLASSES and x[1] >= M.WORDS}
    assert groups and sum(x in groups for x in at.values()) > 100
    for k, s in groups:
        mine = [h for h in n if at[h] == (k, s)]
        whole = sum(n[h] for h in mine)
        for b in range(M.BEFORE):
            part = sum(met[h, b] for h in mine)
            trust = {h: n[h] / (n[h] + M.TRUST) for h in mine}
            raw = {h: n[h] / whole * (trust[h] * (met[h, b] / n[h] * whole / part if part else 0) + 1 - trust[h]) for h in mine}
            place = model.shared.places(np.array([k]), np.array([s]), np.array([b]))
            got = {h: n[h] / whole * model.shared.weight(place, n[h], met[h, b])[0] for h in mine}
            assert math.isclose(sum(got.values()), 1, rel_tol=1e-9)
            assert all(math.isclose(got[h], raw[h] / sum(raw.values()), rel_tol=1e-9) for h in mine)
