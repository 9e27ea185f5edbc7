"""Memories of all types: forgetting in one pass, lists of what was found."""

import pytest
from pyspark.sql import functions as F

from docweave.operators import memory as M

NOW = "2024-01-31 00:00:00"
MEMORIES = "memory_id long, user_id long, memory_type string, importance double, ts timestamp_ntz, content string"


def memories(spark, n=60):
    kinds = ["working", "episodic", "semantic", None]
    rows = spark.range(n).selectExpr("id AS memory_id", "id % 3 AS user_id", "id", "IF(id % 7 = 0, NULL, (id * 37 % 100) / 100) AS importance", "IF(id % 11 = 5, NULL, timestamp_ntz'2024-01-31' - make_dt_interval(CAST(id AS INT))) AS ts")
    named = [(r.memory_id, r.user_id, kinds[r.id % 4], None if r.importance is None else float(r.importance), r.ts, f"m{r.id}") for r in rows.collect()]
    return spark.createDataFrame(named, MEMORIES)


@pytest.mark.parametrize("strategy", ["importance_based", "time_based", "capacity_based", "unknown"])
def test_all_types_are_forgotten_as_each_by_itself(spark, strategy):
    rows = memories(spark)
    rule = {"threshold": 0.4, "max_age_days": 25, "capacity": 3}
    left, removed = M.forget_all(rows, strategy, NOW, **rule)
    want = set()
    for kind in ("working", "episodic", "semantic"):
        want |= {r.memory_id for r in M.forget(rows.where(f"memory_type = '{kind}'"), strategy, NOW, kind, **rule).collect()}
    got = left.where("memory_type IS NOT NULL").collect()
    assert {r.memory_id for r in got} == want and len(got) == len(want)
    assert sum(r.removed for r in removed.collect()) == rows.count() - left.count()
    assert left.columns == rows.columns


def test_nothing_is_forgotten_of_an_empty_table(spark):
    left, removed = M.forget_all(memories(spark).limit(0), "capacity_based", NOW)
    assert left.isEmpty() and removed.isEmpty()


def test_found_memories_as_text(spark):
    found = spark.createDataFrame([(1, 2, "episodic", None, 0.125), (1, 1, "own", "x" * 81, None)], "query_id int, rank int, memory_type string, content string, importance double")
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, query string")
    text = {r.query_id: r.text for r in M.found_text(found, asked).collect()}
    assert text[1].split("\n") == ["🔍 找到 2 条相关记忆:", "1. [own] " + "x" * 80 + "... (重要性: 0.50)", "2. [情景记忆]  (重要性: 0.12)"]
    assert text[2] == "🔍 未找到与 'b' 相关的记忆"


def test_an_episode_told_again_moves_to_its_new_session(spark):
    old = memories(spark, 8).where("memory_type = 'episodic'").withColumn("session_id", F.lit("first"))
    rows = [(1, 9, "second", "new", None, "2024/01/05", 1), (1, 9, None, "newest", 0.9, "2024-01-06 07:08:09", 2), (100, 9, "s", None, None, "someday", 3), (None, 9, "s", "lost", None, None, 4)]
    new = spark.createDataFrame(rows, "memory_id long, user_id long, session_id string, content string, importance double, timestamp string, seq int")
    got = {r.memory_id: r for r in M.episodic_add(old, new, NOW).collect()}
    assert sorted(got) == [1, 5, 100]
    assert (got[1].session_id, got[1].content, got[1].importance, str(got[1].ts)) == ("default", "newest", 0.9, "2024-01-06 07:08:09")
    assert got[5].session_id == "first" and (got[100].importance, str(got[100].ts)) == (0.5, NOW)
    assert M.episodic_add(old, new.limit(0), NOW).count() == 2
