"""Several tables that change together. One manifest, itself a numbered pointer, names the layers of each table.

A layer is what one commit did to a table: keys whose earlier rows are gone, and rows that came. A commit
writes only these; readers lay the layers over each other with one anti-join, and ``compact`` makes one of
many. Old manifests still show the tables as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources import tables

#: The table of imports that are done, and the number of layers from which a table should be compacted.
IMPORTS, MANY_LAYERS = "imports", 16


@dataclass(frozen=True)
class Change:
    """What happens to a table: rows whose ``keys`` stand in ``gone`` (or all) go, then ``rows`` come."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    keys: Sequence[str] = ("document_id",)
    all_gone: bool = False


def version(spark: SparkSession, root: str) -> str | None:
    """The name of the current manifest, to read tables as they are now at any later time."""
    names = [n for n in tables._pointers(spark, root) if tables._pointed(spark, root, n) is not None]
    return names[-1] if names else None


def _layers(spark: SparkSession, root: str, name: str, at: str | None) -> list[dict] | None:
    to = tables._latest(spark, root)[1] if at is None else tables._pointed(spark, root, at) or {}
    return to.get("tables", {}).get(name)


def read(spark: SparkSession, root: str, name: str, at: str | None = None) -> DataFrame | None:
    """The rows of a table now, or as the manifest ``at`` shows them; None if it has never had rows or was cleared."""
    layers = _layers(spark, root, name, at) or []
    folders = [f"{root}/{layer['rows']}" for layer in layers if layer["rows"]]
    if not folders:
        return None
    rows = spark.read.option("mergeSchema", True).parquet(*folders)
    for keys in sorted({tuple(layer["keys"]) for layer in layers if layer["gone"]}):
        gone = spark.read.parquet(*(f"{root}/{layer['gone']}" for layer in layers if layer["gone"] and tuple(layer["keys"]) == keys))
        last = gone.groupBy(*(F.col(k).alias(f"{k}_gone") for k in keys)).agg(F.max("layer_").alias("gone_after"))
        rows = rows.join(last, [F.col(k) == F.col(f"{k}_gone") for k in keys] + [F.col("layer_") < F.col("gone_after")], "left_anti")
    return rows.drop("layer_")


def imported(spark: SparkSession, root: str, task: str) -> bool:
    """Whether a commit for this import task has become visible."""
    done = read(spark, root, IMPORTS)
    return done is not None and not done.where(F.col("import_task_id") == task).isEmpty()


def commit(spark: SparkSession, root: str, changes: dict[str, Change], task: str | None = None) -> bool:
    """Make all changes visible at once, or none: the manifest is created last and only if no other came between.

    With ``task`` the commit happens once: whether it is done is written in the same commit, and False is
    returned if it was before. A writer that lost to another gets OSError and can simply try again.
    """
    after, to = tables._latest(spark, root)
    if task is not None:
        if imported(spark, root, task):
            return False
        changes = changes | {IMPORTS: Change(rows=spark.createDataFrame([(task,)], "import_task_id string"), keys=("import_task_id",))}
    new = {name: list(layers) for name, layers in to.get("tables", {}).items()}
    for name, change in changes.items():
        layers = [] if change.all_gone else new.get(name, [])
        number = layers[-1]["n"] + 1 if layers else 1
        layer = {"n": number, "rows": None, "gone": None, "keys": list(change.keys)}
        for part, df in (("rows", change.rows), ("gone", None if change.gone is None else change.gone.select(*change.keys).distinct())):
            if df is not None:
                layer[part] = f"v-{uuid.uuid4().hex}"
                df.withColumn("layer_", F.lit(number)).write.parquet(f"{root}/{layer[part]}")
        new[name] = [*layers, layer] if layer["rows"] or layer["gone"] else layers
    tables._point(spark, root, after, {"tables": new})
    return True


def compact(spark: SparkSession, root: str, name: str) -> bool:
    """Write a table's rows as one layer, if it has more than one; other tables' files are not touched."""
    after, to = tables._latest(spark, root)
    layers = to.get("tables", {}).get(name, [])
    if len(layers) < 2:
        return False
    rows = read(spark, root, name)
    one = []
    if rows is not None:
        folder = f"v-{uuid.uuid4().hex}"
        number = layers[-1]["n"]
        rows.withColumn("layer_", F.lit(number)).write.parquet(f"{root}/{folder}")
        one = [{"n": number, "rows": folder, "gone": None, "keys": layers[-1]["keys"]}]
    tables._point(spark, root, after, {"tables": to["tables"] | {name: one}})
    return True


def crowded(spark: SparkSession, root: str) -> list[str]:
    """Tables with so many layers that they should be compacted."""
    return sorted(n for n, layers in tables._latest(spark, root)[1].get("tables", {}).items() if len(layers) >= MANY_LAYERS)
