import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from docweave.llm import hamming_search as S
from docweave.llm import queries, sharding


def brute_table(shards, slots):
    """Preference lists written out in full."""
    number = lambda t: int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")
    prefer = [[(number(f"{s}/offset") + k * (number(f"{s}/skip") % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    table, turn = {}, 0
    while len(table) < slots:
        k = turn % len(shards)
        table[next(x for x in prefer[k] if x not in table)] = k
        turn += 1
    return [table[i] for i in range(slots)]


def test_table_matches_written_out_preferences():
    shards = [f"s{k}" for k in range(7)]
    assert sharding.lookup_table(shards, slots=101).tolist() == brute_table(shards, 101)


def test_shares_weights_and_few_moves():
    shards = [f"s{k}" for k in range(50)]
    table = sharding.lookup_table(shards)
    assert max(Counter(table.tolist()).values()) - min(Counter(table.tolist()).values()) <= 1
    heavy = Counter(sharding.lookup_table(["a", "b"], [3, 1], 1009).tolist())
    assert abs(heavy[0] - 3 * heavy[1]) <= 4
    less = sharding.lookup_table(shards[:-1])
    stayed = table != 49
    assert (less[stayed] != table[stayed]).mean() < 0.05
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad[0], slots=bad[1])


def test_sharding_query(spark, tmp_path):
    rows = queries.op9_sharding(spark, "/root/testdata/sf0.001").collect()
    table = sharding.lookup_table(queries.SHARDS)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len(rows) == docs.count()
    for x in rows:
        slot = int(hashlib.md5(str(x.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (x.slot, x.shard) == (slot, queries.SHARDS[table[slot]])
    sharding.write_shards(docs, str(tmp_path / "out"), "doc_id", ["a", "b", "c"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(rows) and {x.shard for x in back.select("shard").distinct().collect()} == {"a", "b", "c"}


def test_sharding_edges(spark):
    df = spark.createDataFrame([(None, "x", 1), (None, "x", 2), (3, "y", 3)], "id long, shard string, slot int")
    got = sharding.place(df, "id", ["a", "b"]).collect()
    assert len(got) == 3 and len({x.shard for x in got if x.id is None}) == 1
    assert sharding.place(df.limit(0), "id", ["a"]).collect() == []


def test_columns_of_any_name_stay(spark, tmp_path):
    df = spark.createDataFrame([(k, k, k, k) for k in range(20)], "id long, _slot long, number long, _part long")
    got = sharding.place(df, "id", ["a", "b"])
    assert got.columns == ["id", "_slot", "number", "_part", "slot", "shard"] and all(x.id == x._slot == x.number == x._part for x in got.collect())
    sharding.write_shards(df, str(tmp_path / "out"), "id", ["a", "b"], files=2)
    assert sorted(x._part for x in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(20))


def test_sharding_sql_gives_the_querys_rows(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(f"SELECT doc_id, slot, shard FROM ({queries.oracle_sql()['op9_sharding']})").fetchall()
    got = queries.op9_sharding(spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == ["doc_id", "shard", "slot"]
    assert sorted(want) == sorted((x.doc_id, x.slot, x.shard) for x in got.collect())


def brute(codes, wanted, k):
    out = []
    for q in wanted:
        best = sorted((bin((codes[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in codes.items())[:k]
        out += [(q, r + 1, i, d) for r, (d, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("spread", "part"), [(64, 1 << 15), (9, 16), (3, 40)])
def test_search_matches_brute_force(spark, spread, part):
    r = np.random.default_rng(spread)
    base = r.integers(0, 1 << 63, 6, dtype=np.uint64)
    codes = {}
    for i in range(400):
        c = int(base[r.integers(6)])
        for b in r.integers(0, 64, int(r.integers(0, spread))):
            c ^= 1 << int(b)
        codes[i] = c - (1 << 64) if c >= 1 << 63 else c
    rows = spark.createDataFrame([*codes.items(), (None, 5), (900, None)], "id long, code long")
    got = S.top_k(rows, rows.where("id % 20 = 0"), 7, part=part, block=8).collect()
    assert sorted(map(tuple, got)) == brute(codes, [i for i in codes if i % 20 == 0], 7)


def test_search_edges(spark):
    few = spark.createDataFrame([(1, 0), (2, 0), (2, 0), (3, -1)], "id long, code long")
    got = sorted(map(tuple, S.top_k(few, few.where("id = 1"), 10).collect()))
    assert got == [(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 2, 0), (1, 4, 3, 64)]
    assert S.top_k(few.limit(0), few, 3).collect() == []
    assert S.top_k(few, few.limit(0), 3).collect() == []
