import zlib

import numpy as np
import pyarrow as pa

from docweave.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def judged(spark, rows, label):
    labels = {x.doc_id: x[label] for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = [(x, labels[x.doc_id]) for x in rows if x.doc_id in labels and x.held_out]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 for x in rows)
    return out


def auc(pairs):
    up, down = [x.score for x, t in pairs if t], [x.score for x, t in pairs if not t]
    return np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])


def test_toxicity_on_held_out_labels(spark):
    rows = queries.op6_toxicity(spark, SF).collect()
    assert len(rows) == 1000
    assert auc(judged(spark, rows, "toxic")) > 0.7
    assert all(x.predicted == int(x.score >= 0.5) for x in rows)


def test_quality_on_held_out_labels(spark):
    rows = queries.op8_quality_classifier(spark, SF).collect()
    assert len(rows) == 1000
    pairs = judged(spark, rows, "quality")
    assert auc(pairs) > 0.9
    assert np.mean([x.predicted == t for x, t in pairs]) > 0.9
    assert all(x.predicted == int(x.score >= 0.3) for x in rows)


def edge(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "a"), (4, "Fine words " * 20000), (None, "x y"), (5, "é" * 300)]
    return spark.createDataFrame([(i, t, 0.5, 1) for i, t in rows], "doc_id long, text string, score double, toxic int"), len(rows)


def test_edge_rows_and_missing_labels(spark):
    docs, n = edge(spark)
    for module, name, run in ((toxicity, "toxic", toxicity.toxicity_scores), (quality, "quality", quality.quality_scores)):
        for labels in ([], [(1, 1), (1, 1), (2, None), (None, 1)], [(1, 1), (2, 0), (3, 1), (4, 0)]):
            got = run(docs, spark.createDataFrame(labels, f"doc_id long, {name} int")).collect()
            assert len(got) == n and all(0 <= x.score <= 1 for x in got), module
        assert run(docs.limit(0), spark.createDataFrame([], f"doc_id long, {name} int")).collect() == []


def test_non_negative_risk_finds_the_words_among_unlabelled():
    r = np.random.default_rng(2)
    def text(bad):
        return " ".join(f"w{k}" for k in r.integers(0, 300, 60)) + (" awful" if bad else "")
    bad = [text(True) for _ in range(60)]
    mixed = [text(k < 60) for k in range(600)]
    rows = lambda x: [b[0] for b in (toxicity.word_buckets(pa.array([t])) for t in x)]
    model = toxicity.nn_pu_fit(rows(bad), rows(mixed), 0.1)
    assert (model.score(pa.array(bad)) > 0.5).mean() > 0.95
    assert (model.score(pa.array(mixed[60:])) < 0.5).all()


def test_network_gradients_match_differences():
    r = np.random.default_rng(0)
    texts = pa.array(["some words here " * 30, "x", "", "###*** " * 90])
    raw, bounds = quality.text_bytes(texts)
    true, weight = np.array([1, 1, 0, 0], np.float32), np.ones(4)

    def loss(network):
        s = network.score(texts)
        return -np.log(np.where(true == 1, s, 1 - s)).mean()

    network = quality.ByteNetwork(3)
    network.step(raw, bounds, true, weight, rate=0)
    gradient = {k: v * 10 for k, v in network.first.items()}
    for name, value in network.p.items():
        for _ in range(4):
            at = tuple(int(r.integers(n)) for n in value.shape)
            kept, e = value[at], 1e-2
            value[at] = kept + e
            up = loss(network)
            value[at] = kept - e
            down = loss(network)
            value[at] = kept
            assert abs((up - down) / (2 * e) - gradient[name][at]) < 5e-3 + 0.1 * abs(gradient[name][at]), name


def test_scores_do_not_depend_on_the_batch():
    network = quality.ByteNetwork(1)
    texts = ["abc " * n for n in (0, 1, 15, 16, 17, 63, 64, 65, 300)]
    whole = network.score(pa.array(texts))
    assert np.allclose(whole, [network.score(pa.array([t]))[0] for t in texts], atol=1e-5)


def test_long_texts_are_learnt_whole(spark):
    text = " ".join(f"{k * 7919:x}" for k in range(30000))
    want = toxicity.word_buckets(pa.array([text]))[0]
    assert len(want) > 20000
    (got,) = toxicity._sample(spark.createDataFrame([(1, text)], "doc_id long, text string"), 10).collect()
    assert np.frombuffer(got.words, np.int32).tolist() == want.tolist()


def test_samples_of_huge_tables():
    """With 5e10 rows the share is tiny but the hashes below its bound are still that share, never none."""
    for n in (1, 10**6, 10**9, 5 * 10**10, 10**13):
        share = toxicity._share(n, toxicity.MOST_UNLABELLED)
        below = toxicity.hash_bound(share) + (1 << 63)
        assert 0 < below < 1 << 64 and abs(below / 2**64 - share) <= 1e-6 * share
        assert share == 1 or share * n >= 1.5 * toxicity.MOST_UNLABELLED


def test_one_id_with_most_rows_is_still_sampled(spark):
    docs = spark.range(40_000).selectExpr("if(id < 100, id, 7777) AS doc_id", "concat('word', id % 50, ' some text') AS text")
    model = toxicity.fit(docs, spark.createDataFrame([(k, int(k < 5)) for k in range(100)], "doc_id long, toxic int"))
    assert np.isfinite(model.bias) and 0 < model.score(pa.array(["word1"]))[0] < 1


def test_risk_and_scores_against_plain_versions():
    r = np.random.default_rng(4)
    sp, su = r.random(30), r.random(70)
    for prior in (0.05, 0.4, 0.9):
        positive = sum(-np.log(x) for x in sp) / 30
        as_negative = sum(-np.log(1 - x) for x in sp) / 30
        unlabelled = sum(-np.log(1 - x) for x in su) / 70
        assert np.isclose(toxicity.nn_risk(sp, su, prior), prior * positive + max(0, unlabelled - prior * as_negative))
    bad, mixed = [f"w{k % 7} awful thing{k}" for k in range(40)], [f"w{k % 7} {'awful' if k < 40 else 'plain'} thing{k}" for k in range(400)]
    rows = lambda x: [toxicity.word_buckets(pa.array([t]))[0] for t in x]
    model = toxicity.nn_pu_fit(rows(bad), rows(mixed), 0.1)

    def plain(text):
        z = model.bias
        found = set()
        for w in text.split():
            found |= set(toxicity.word_buckets(pa.array([w]))[0].tolist())
        return 1 / (1 + np.exp(-(z + sum(model.weights[b] for b in found))))

    texts = [*bad[:5], *mixed[:60:7], "", "AWFUL awful"]
    assert np.allclose(model.score(pa.array(texts)), [plain(t.lower()) for t in texts])
    risk = lambda m: toxicity.nn_risk(m.score(pa.array(bad)), m.score(pa.array(mixed)), 0.1)
    assert risk(model) < 0.7 * risk(toxicity.Toxicity(np.zeros(toxicity.BUCKETS), np.log(0.1 / 0.9)))


def test_network_scores_against_a_naive_forward_pass():
    """Filters, chunks and pools written out in loops, one text at a time."""
    network = quality.ByteNetwork(7)
    p, width, cell = network.p, quality.WIDTH, quality.CELL

    def naive(text):
        raw = text.encode()
        n, padded = len(raw), raw + bytes(width)
        z = [sum(p["embedding"][padded[i + j]] @ p["filters"][j * quality.EMBEDDED : (j + 1) * quality.EMBEDDED] for j in range(width)) for i in range(n)]
        cells = -(-(n + width - 1) // cell)
        top = [np.max(z[c * cell : (c + 1) * cell], axis=0) + p["shift"] if z[c * cell :] else np.full(quality.FILTERS, -1e9) for c in range(cells)]
        chunks = [np.maximum(0, np.max(top[k * quality.STEP : k * quality.STEP + quality.CELLS], axis=0)) for k in range(max(1, -(-(cells - quality.CELLS) // quality.STEP) + 1))]
        size = [np.log1p(n) / 4, min(n, cell * quality.CELLS) / (cell * quality.CELLS) * 2]
        whole = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0), np.min(chunks, axis=0), size])
        hidden = np.tanh(whole @ p["hidden"] + p["hidden_shift"])
        return 1 / (1 + np.exp(-(hidden @ p["out"] + p["out_shift"][0])))

    texts = ["", "a", "Some words of a text. " * 9, "é ### " * 40, "x" * 63, "yz" * 700]
    got = network.score(pa.array(texts))
    assert np.allclose(got, [naive(t) for t in texts], atol=1e-4) and len({round(float(x), 6) for x in got}) == len(texts)
