import hashlib
import random

import numpy as np
import pytest

from docweave.llm import bpe, queries, token_counts

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    r = random.Random(4)
    return [
        None, "", " ", "a<|endoftext|> b<|endoftext|><|endoftext|>", "aaaaaaa" * 100, "x" * 5000, "a 　 \t\n\n  b", "日本語 текст عربى", "😀😀 \U0001f468‍\U0001f469",
        "!!!!" * 200, "  \n " * 300, "don't I'LL we've'd", "\x00\x01\x7f", "éé", "".join(r.choice("abcdefghij") for _ in range(3000)), "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(2000)),
        "12345" * 50, "Thé quick\r\nbrown fox", "Thé quick\r\nbrown fox", "the " * 20000,
    ]


def test_ids_and_text_match_the_library(spark, theirs):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    got = {x.doc_id: x for x in bpe.bpe_decode(bpe.bpe_encode(docs)).collect()}
    for i, text in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids
        assert got[i].decoded == theirs.decode(ids, skip_special_tokens=False) == (text or "")


def test_invalid_bytes_decode_to_replacements(theirs):
    codec = bpe.codec(PATH)
    r = np.random.default_rng(3)
    for _ in range(200):
        ids = r.integers(0, 400, 12)
        assert codec.decode(ids) == theirs.decode(ids.tolist(), skip_special_tokens=False)


def test_heap_and_rounds_agree():
    codec = bpe.codec(PATH)
    r = random.Random(9)
    for _ in range(200):
        word = "".join(r.choice("abétion ") for _ in range(r.randrange(1, 200))).encode()
        assert codec.merge_heap(word).tolist() == codec.merge_rounds([word])[0].tolist()


def test_query_digests(spark, theirs):
    got = {x.doc_id: x for x in queries.op3_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = theirs.encode(d.text or "", add_special_tokens=False).ids
        x = got[d.doc_id]
        assert x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


def brute_allocate(token_ends, section_ends, rule):
    """Byte by byte."""
    section_of = [next(k for k, e in enumerate(section_ends) if b < e) for b in range(section_ends[-1] if len(section_ends) else 0)]
    counts, start = [0.0] * len(section_ends), 0
    for end in token_ends:
        held = section_of[start:end]
        if rule == "start":
            counts[held[0]] += 1
        elif rule == "majority":
            counts[min(set(held), key=lambda k: (-held.count(k), k))] += 1
        else:
            for k in set(held):
                counts[k] += held.count(k) / len(held)
        start = end
    return counts


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation(rule):
    r = np.random.default_rng(11)
    for _ in range(200):
        n = int(r.integers(1, 40))
        cut = lambda: np.unique(np.append(r.integers(1, n + 1, int(r.integers(1, 9))), n))  # noqa: B023, E731
        tokens, sections = cut(), cut()
        sections = np.sort(np.append(sections, r.choice(sections)))  # an empty section too
        got = token_counts.allocate(tokens, sections, rule)
        assert np.allclose(got, brute_allocate(tokens, sections, rule))
        assert np.isclose(got.sum(), len(tokens))


def test_sections_sum_to_whole_texts(spark, theirs):
    rows = [(i, t) for i, t in enumerate(texts())] + [(99, "one\n\ntwo \n three\n"), (99, "\n\n\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = token_counts.section_token_counts(docs).collect()
    whole = {}
    for i, t in rows:
        whole[i] = whole.get(i, 0) + len(theirs.encode(t or "", add_special_tokens=False).ids)
    summed = {}
    for x in out:
        summed[x.doc_id] = summed.get(x.doc_id, 0) + x.n_tokens
    assert summed == whole
    assert sorted(x.section for x in out if x.doc_id == 0) == [0]
    assert token_counts.section_token_counts(docs.limit(0)).collect() == []


def test_fields(spark, theirs):
    rows = spark.createDataFrame([(1, "Title here", None, "body text\nmore"), (2, None, None, None)], "doc_id long, title string, extra string, body string")
    out = sorted((x.doc_id, x.section, x.n_bytes, x.n_tokens) for x in token_counts.field_token_counts(rows, ["title", "extra", "body"]).collect())
    assert [x[:3] for x in out] == [(1, 0, 11), (1, 1, 1), (1, 2, 14), (2, 0, 1), (2, 1, 1), (2, 2, 0)]
    assert sum(x[3] for x in out if x[0] == 1) == len(theirs.encode("Title here\n\nbody text\nmore").ids)


def test_token_count_query_agrees_with_encoding(spark):
    counted = {x.doc_id: x.n for x in queries.op5_token_counts(spark, "/root/testdata/sf0.001").groupBy("doc_id").agg({"n_tokens": "sum"}).toDF("doc_id", "n").collect()}
    assert counted == {x.doc_id: x.n_tokens for x in queries.op3_bpe(spark, "/root/testdata/sf0.001").collect()}


def plain_counts(theirs, text, ends, rule="start"):
    """Each section's tokens, one token and one byte at a time; tokens' bytes from their pieces in the vocabulary."""
    width = [len(piece) for piece in theirs.encode(text, add_special_tokens=False).tokens]  # byte-level pieces: one character a byte
    section = lambda byte: sum(byte >= e for e in ends)
    counts, crossing, at = [0.0] * len(ends), [0] * len(ends), 0
    for n in width:
        own = [section(b) for b in range(at, at + n)]
        crossing[own[0]] += own[0] != own[-1]
        if rule == "start":
            counts[own[0]] += 1
        elif rule == "majority":
            counts[max(sorted(set(own)), key=own.count)] += 1
        else:
            for s in own:
                counts[s] += 1 / n
        at += n
    return counts, crossing


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_lines_against_a_plain_version(spark, theirs, rule):
    rows = [(k, t) for k, t in enumerate(texts()) if t and len(t) < 4000 and "<|endoftext|>" not in t] + [(90, "a\n\n\n  b\n\n"), (91, "x  \n  y\n\n\n\nz\n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {}
    for x in sorted(token_counts.section_token_counts(docs, rule).collect(), key=lambda x: x.section):
        got.setdefault(x.doc_id, []).append((x.n_bytes, x.n_tokens, x.n_crossing))
    for k, text in rows:
        size = [len(x.encode()) + 1 for x in text.split("\n")]
        size[-1] -= 1
        counts, crossing = plain_counts(theirs, text, np.cumsum(size).tolist(), rule)
        assert [x[0] for x in got[k]] == size and [x[2] for x in got[k]] == crossing, text[:40]
        assert np.allclose([x[1] for x in got[k]], counts), text[:40]


def test_fields_of_any_name_and_length(spark):
    rows = spark.createDataFrame([(1, "a", 5, "b" * 3_000_000), (2, None, None, "c")], "id long, doc_id string, sizes long, text string").repartition(1)
    out = sorted((x.doc_id, x.section, x.n_bytes) for x in token_counts.field_token_counts(rows, ["doc_id", "sizes", "text"], id_col="id").collect())
    assert out == [(1, 0, 2), (1, 1, 2), (1, 2, 3_000_000), (2, 0, 1), (2, 1, 1), (2, 2, 1)]
