"""Versioned parquet tables: a version is written whole, and numbered pointer files say which is the current one."""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this size are dealt out anew if they lie in few files.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer files than there are cores, dealt out to all of them; any other as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES
    return df.repartition(n) if small and len(df.inputFiles()) < n else df


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir, removed when the JVM ends; in local mode a temporary one if that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='docweave-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/docweave-{uuid.uuid4().hex}"
    place, fs = _file(spark, path)
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


def _file(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str) -> list[str]:
    """The names of the pointer files, ascending; a pointer is never removed while it is the highest."""
    place, fs = _file(spark, path)
    if not fs.exists(place):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(place)]
    return sorted(n for n in names if n.startswith("CURRENT-"))


def _pointed(spark: SparkSession, path: str, name: str) -> dict | None:
    """What a pointer says; None where its writer stopped before it was whole."""
    place, fs = _file(spark, f"{path}/{name}")
    file = fs.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
    finally:
        file.close()
    try:
        return json.loads(text)
    except ValueError:
        return None


def _create(spark: SparkSession, path: str, text: str) -> None:
    """Create a file that nobody has created before, or raise OSError.

    On a local file system a whole file is linked to the name, which fails where the name is taken. Elsewhere
    the file is created with overwrite off, which the store decides; a reader who comes before it is whole passes it over.
    """
    place, fs = _file(spark, path)
    local = fs.getUri().getScheme() == "file"
    fresh, _ = _file(spark, f"{path.rpartition('/')[0]}/.fresh-{uuid.uuid4().hex}")
    try:
        out = fs.create(fresh if local else place, False)
        out.write(bytearray(text.encode()))
        out.close()
        if local:
            file = spark._jvm.java.io.File
            spark._jvm.java.nio.file.Files.createLink(file(place.toUri().getPath()).toPath(), file(fresh.toUri().getPath()).toPath())
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        raise OSError(f"{path} is taken: another writer was first") from None
    finally:
        if local:
            fs.delete(fresh, False)


def _point(spark: SparkSession, path: str, after: str | None, to: dict) -> None:
    """Make ``to`` current if no pointer has come after ``after``; of two writers at once one gets an error."""
    number = int(after.rpartition("-")[2]) + 1 if after else 1
    place, fs = _file(spark, path)
    fs.mkdirs(place)
    _create(spark, f"{path}/CURRENT-{number:012d}", json.dumps(to))


def _latest(spark: SparkSession, path: str) -> tuple[str | None, dict]:
    """The highest pointer's name, and what the highest whole one says."""
    names = _pointers(spark, path)
    for name in reversed(names):
        to = _pointed(spark, path, name)
        if to is not None:
            return names[-1], to
    return (names[-1] if names else None), {}


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version's folder (the last one written), or None."""
    return _latest(spark, path)[1].get("version")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the current version."""
    _, to = _latest(spark, path)
    if not to:
        raise FileNotFoundError(path)
    folders = sorted(set(to["parts"].values())) if "parts" in to else [to["version"]]
    return spark.read.parquet(*(f"{path}/{f}" for f in folders))


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a version and point to it last, so readers see the old rows or the new ones, never a mixture or nothing.

    The rows may come from the table's current version. Old versions stay until ``vacuum``. A crash at any
    point leaves the table as it was; of two writers at once one gets an error.
    """
    spark = df.sparkSession
    after, to = _latest(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.write.partitionBy(*(partition_by or [])).parquet(f"{path}/{name}")
    _point(spark, path, after, {"version": name, "done": to.get("done", {})})
    return name


def _part(key: str, parts: int):
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def parts_of(keys: DataFrame, key: str, parts: int) -> list[int]:
    """Which of ``parts`` parts the keys lie in; at most that many numbers."""
    return sorted(r[0] for r in keys.select(_part(key, parts).alias("p")).distinct().collect())


def read_parts(spark: SparkSession, path: str, touched: list[int]) -> DataFrame | None:
    """The rows of the touched parts alone; None if there are none."""
    _, to = _latest(spark, path)
    folders = [f"{path}/{f}" for f in (to.get("parts", {}).get(str(p)) for p in touched) if f]
    return spark.read.parquet(*folders) if folders else None


def done(spark: SparkSession, path: str, source: str) -> int | None:
    """The last number that ``write_parts`` has marked as done for ``source``."""
    return _latest(spark, path)[1].get("done", {}).get(source)


def write_parts(df: DataFrame, path: str, key: str, parts: int, touched: list[int], mark: tuple[str, int] | None = None) -> str:
    """A version in which the ``touched`` parts (by a hash of ``key``) hold ``df``'s rows and all others are as before.

    ``mark`` (a source and a number) becomes true together with the rows: see ``done``.
    """
    spark = df.sparkSession
    after, to = _latest(spark, path)
    name = f"v-{uuid.uuid4().hex}"
    df.withColumn("part_", _part(key, parts)).repartition(F.col("part_")).write.partitionBy("part_").parquet(f"{path}/{name}")
    place, fs = _file(spark, f"{path}/{name}")
    filled = {s.getPath().getName().removeprefix("part_=") for s in fs.listStatus(place) if s.getPath().getName().startswith("part_=")}
    kept = {p: f for p, f in to.get("parts", {}).items() if int(p) not in touched}
    marks = to.get("done", {}) | (dict([mark]) if mark else {})
    _point(spark, path, after, {"version": name, "parts": kept | {p: f"{name}/part_={p}" for p in filled}, "done": marks})
    return name


def _needed(to: dict) -> set[str]:
    """Folders that a pointer names: a version, parts of versions, or the layers of tables."""
    layers = [f for table in to.get("tables", {}).values() for layer in table for f in (layer["rows"], layer["gone"])]
    return {to.get("version"), *(f.partition("/")[0] for f in to.get("parts", {}).values()), *layers}


def vacuum(spark: SparkSession, path: str, hours: float = 24.0) -> int:
    """Remove what the current version doesn't need; how many versions.

    Versions that an older pointer names go at once. Files that no pointer names may be a writer's who is still at
    work: they go when they are ``hours`` old, which must be more than any writer takes.
    """
    name, to = _latest(spark, path)
    keep = _needed(to)
    pointers = _pointers(spark, path)
    past = set().union(*(_needed(_pointed(spark, path, p) or {}) for p in pointers)) - keep
    place, fs = _file(spark, path)
    oldest = time.time() * 1000 - hours * 3_600_000
    gone = 0
    for status in fs.listStatus(place):
        found = status.getPath().getName()
        stale = status.getModificationTime() < oldest
        if found.startswith("v-") and found not in keep and (found in past or stale):
            gone += 1
            fs.delete(status.getPath(), True)
        elif found.startswith(".fresh-") and stale:
            fs.delete(status.getPath(), False)
    for p in pointers[:-1]:  # after the versions, so that a crash in between leaves none that no pointer names
        if _pointed(spark, path, pointers[-1]) is not None:
            fs.delete(_file(spark, f"{path}/{p}")[0], False)
    return gone
