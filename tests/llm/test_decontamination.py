import random
import re

from docweave.llm import decontamination as D


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_id(row):
    """Rows by id, those without one last."""
    return row[0] is None, row[0] or 0, row[1:]


def brute(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            k = min(window, len(v))
            wins = {tuple(v[a : a + k]) for a in range(len(v) - k + 1)} if v else set()
            for a in range(len(w) - k + 1):
                if k and tuple(w[a : a + k]) in wins:
                    hit.update(range(a, a + k))
                    found |= {str(item)} - {"None"}
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=by_id)


def cases(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "x1", "the", "the"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(k, text(r.choice([0, 3, 9, 10, 11, 25]))) for k in range(12)] + [(12, None), (None, text(12)), (3, "the the")]
    docs = []
    for k in range(60):
        t = text(r.randrange(0, 80))
        if r.random() < 0.5:
            t += (r.choice(items)[1] or "").upper() + text(5)
        docs.append((k, t))
    return [*docs, (60, None), (61, ""), (62, "The the THE the"), docs[0], (None, docs[1][1]), (None, items[-2][1]), (-(1 << 63), "the the")], items


def found(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id long").repartition(3)
    b = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in D.search_segments(D.index_segments(d), b, **options).collect()), key=by_id)


def test_matches_brute_force(spark):
    docs, items = cases(1)
    assert found(spark, docs, items) == brute(docs, items)


def test_benchmark_in_blocks(spark):
    docs, items = cases(2)
    assert found(spark, docs, items, block_words=40) == brute(docs, items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (40, 1 << 20):
        assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in D.decontaminate(d, b, block_words=words).collect()), key=by_id) == brute(docs, items)


def test_stored_segments_and_empty_tables(spark, tmp_path):
    docs, items = cases(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    D.index_segments(d).write.parquet(str(tmp_path / "index"))
    stored = D.search_segments(spark.read.parquet(str(tmp_path / "index")), b)
    assert sorted(((x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in stored.collect()), key=by_id) == brute(docs, items)
    assert D.decontaminate(d.limit(0), b).collect() == []
    assert {x.n_hit for x in D.decontaminate(d, b.limit(0)).collect()} == {0}


def near(docs, terms, slop):
    """Words of the rarest term (of the first where they are equally rare) with all others within ``slop`` words."""
    terms = sorted(set(t.lower() for t in terms))
    texts = [(i, split(t)) for i, t in docs]
    count = {t: sum(w.count(t) for _, w in texts) for t in terms}
    out = {}
    for rare in [t for t in terms if count[t] == min(count.values())]:
        out[rare] = sorted(((i, k) for i, w in texts for k, x in enumerate(w) if x == rare and all(t in w[max(0, k - slop) : k + slop + 1] for t in terms)), key=repr)
    return list(out.values())


def test_proximity_by_brute_force(spark):
    r = random.Random(7)
    docs = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(30)))) for k in range(80)] + [(None, "a b c"), (None, None), (5, ""), (6, "h a b")]
    segments = D.index_segments(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    for terms, slop in ((["a", "b"], 1), (["c", "D", "h"], 4), (["e"], 0), (["a", "nowhere"], 9)):
        got = sorted(((x.doc_id, x.word) for x in D.near_matches(segments, terms, slop).collect()), key=repr)
        assert got in near(docs, terms, slop), (terms, got)
    assert D.near_matches(D.index_segments(spark.createDataFrame([], "doc_id long, text string")), ["a"], 1).count() == 0


def test_proximity(spark):
    docs = [(1, "alpha beta gamma delta"), (2, "alpha x x x x x gamma"), (3, "gamma"), (4, "alpha")]
    segments = D.index_segments(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert [x.doc_id for x in D.near_matches(segments, ["Gamma", "alpha"], 3).collect()] == [1]
    assert sorted(x.doc_id for x in D.near_matches(segments, ["gamma", "alpha"], 6).collect()) == [1, 2]
