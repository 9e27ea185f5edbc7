"""Tables that change together: what readers see when a writer stops between any two of its steps."""

import pytest
from pyspark.sql import functions as F

from docweave.plans import loading
from docweave.sources import library as L
from docweave.sources import tables

AT = "2024-01-31 00:00:00"
NAMES = ("chunks", "documents", "memories")


class Stop(Exception):
    pass


def docs(spark, rows):
    return spark.createDataFrame(rows, "document_id string, text string")


def state(spark, root, at=None):
    out = {}
    for n in NAMES:
        rows = L.read(spark, root, n, at)
        key = {"chunks": ["chunk_id", "content", "document_version"], "documents": ["document_id", "document_version", "import_task_id"], "memories": ["memory_id"]}[n]
        out[n] = [] if rows is None else sorted(tuple(r) for r in rows.select(*key).collect())
    return out


def load(spark, root, rows, task):
    return loading.load(docs(spark, rows), root, "u", AT, task, embed=False)


def test_a_load_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/library"
    load(spark, root, [("a", "one"), ("b", "two")], "t1")
    before = state(spark, root)
    writer = type(spark.range(1).write)
    write, create = writer.parquet, tables._create
    steps = 0
    while True:  # stop after 0, 1, 2, ... of the load's writes, then before and after the manifest
        left = [steps]

        def stopped(self, path, *args, left=left, **named):
            if not left[0]:
                raise Stop
            left[0] -= 1
            write(self, path, *args, **named)

        def crash(*args, left=left):
            if not left[0]:
                raise Stop
            create(*args)
            raise Stop

        with monkeypatch.context() as m:
            m.setattr(writer, "parquet", stopped)
            m.setattr(tables, "_create", crash)
            with pytest.raises(Stop):
                load(spark, root, [("a", "changed"), ("c", "three")], "t2")
        if L.imported(spark, root, "t2"):
            break
        assert state(spark, root) == before, steps
        steps += 1
    assert steps >= 6
    after = state(spark, root)
    assert after["chunks"] == [("a_0", "changed", 2), ("b_0", "two", 1), ("c_0", "three", 1)]
    assert after["documents"] == [("a", 2, "t2"), ("b", 1, "t1"), ("c", 1, "t2")] and len(after["memories"]) == 4
    assert not load(spark, root, [("a", "changed"), ("c", "three")], "t2") and state(spark, root) == after


def test_of_two_writers_one_tries_again(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/library"
    load(spark, root, [("a", "one")], "t1")
    point = tables._point

    def late(*args):
        monkeypatch.setattr(tables, "_point", point)
        load(spark, root, [("b", "from the other")], "t2")
        point(*args)

    monkeypatch.setattr(tables, "_point", late)
    with pytest.raises(OSError, match="another writer"):
        load(spark, root, [("c", "mine")], "t3")
    assert load(spark, root, [("c", "mine")], "t3") and [r[0] for r in state(spark, root)["documents"]] == ["a", "b", "c"]


def test_replacing_a_document_writes_no_other(spark, tmp_path):
    root = f"file://{tmp_path}/library"
    load(spark, root, [(f"d{k}", "text " * 300) for k in range(50)], "t1")
    old, was = L.version(spark, root), state(spark, root)
    load(spark, root, [("d7", "short")], "t2")
    layer = tables._latest(spark, root)[1]["tables"]["chunks"][-1]
    written = spark.read.parquet(f"{root}/{layer['rows']}").select("document_id").distinct().collect()
    assert [r[0] for r in written] == ["d7"]
    assert loading.delete(spark, root, docs(spark, [("d8", None), ("none", None)])) == {"chunks": 3, "documents": 1}
    now = state(spark, root)
    assert state(spark, root, old) == was
    assert [c for c in now["chunks"] if c[0].startswith(("d7_", "d8_"))] == [("d7_0", "short", 2)] and len(now["documents"]) == 49
    assert L.compact(spark, root, "chunks") and state(spark, root) == now and not L.compact(spark, root, "chunks")
    load(spark, root, [("d8", "back again")], "t3")
    assert ("d8_0", "back again", 1) in state(spark, root)["chunks"]
    tables.vacuum(spark, root)
    assert len(state(spark, root)["documents"]) == 50 and L.crowded(spark, root) == []


def test_clear_and_questions(spark, tmp_path):
    root = f"file://{tmp_path}/library"
    load(spark, root, [("a", "one"), ("b", ""), ("b", None), (None, "no id")], "t1")
    asked = spark.createDataFrame([("q1", "a", None), ("q2", None, ["b", "a"]), ("q3", None, ["b"])], "question_id string, document_id string, document_ids array<string>")
    L.commit(spark, root, {"questions": L.Change(rows=asked), "notes": L.Change(rows=spark.range(3))})
    assert state(spark, root)["documents"] == [("a", 1, "t1"), ("b", 1, "t1")]
    assert loading.delete(spark, root, docs(spark, [("a", None)])) == {"chunks": 1, "documents": 1, "questions": 2}
    assert [r.question_id for r in L.read(spark, root, "questions").collect()] == ["q3"]
    assert loading.clear(spark, root) == {"chunks": 0, "documents": 1, "questions": 1}
    assert L.read(spark, root, "questions") is None and L.read(spark, root, "notes").count() == 3 and len(state(spark, root)["memories"]) == 2
    load(spark, root, [("a", "anew")], "t2")
    assert state(spark, root)["chunks"] == [("a_0", "anew", 1)]


def test_null_keys_stay(spark, tmp_path):
    root = f"file://{tmp_path}/library"
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "document_id string, v int")
    L.commit(spark, root, {"t": L.Change(rows=rows)})
    L.commit(spark, root, {"t": L.Change(gone=rows)})
    assert [r.v for r in L.read(spark, root, "t").collect()] == [1] and L.read(spark, root, "t").where(F.col("v") == 2).isEmpty()
