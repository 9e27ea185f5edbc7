"""Mixing sources to target weights: every document stays, is repeated or is left out by its source's rate.

Sizes are summed for each source; a target is the source's share of the whole mix by weight, at most ``most``
times its size, and what that takes from a source goes to the others by weight. A document is taken
floor(rate) times and once more with a probability of the rest of the rate, drawn from a hash of its id.
Everything is DataFrame expressions, joins and aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import staged
from docweave.llm.running import plus, running

#: Weights of the sources in order of code points (null last), again from the first when they are used up.
WEIGHTS = (3, 1, 2)
#: Size of the mix as a share of all sizes, and of a target as a multiple of its source's size.
SHARE, MOST = 1.5, 2.0


def word_count(text: str) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of a whole text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(id_col: str, text: str, seed: str = "mix") -> Column:
    """A number from 0 up to 1 that a document's id fixes; a row without an id is told by its text.

    52 bits of md5(seed, id), so that other engines can draw the same. Rows with the same id draw alike.
    """
    key = F.coalesce(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), F.concat(F.lit(f"{seed}-"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _key(source: str) -> Column:
    """A source as a key that is never null and sorts by code point, null last."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))


def source_targets(sizes: DataFrame, source: str = "source", size: str = "size", weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row for each source: ``key``, ``source_size``, ``weight``, ``target``.

    A source is full where its weight's part of the mix is ``most`` times its size or more. With sources in
    order of how soon they fill, the part of one weight is (mix - what the first k may have) / (weights of the
    rest) for the right k, and less for every other k: so it is the largest of these, and no rounds are needed.
    Any number of sources will do. ``share`` must be at most ``most``; sources without words have target 0.
    """
    if not 0 <= share <= most or not weights or min(weights) <= 0:
        raise ValueError("share must lie between 0 and most, weights must be positive")
    sources = sizes.groupBy(_key(source).alias("key")).agg(F.sum(size).alias("source_size"))
    ranked = running(sources, [], [F.col("key")], {"n": plus(F.lit(1)), "size": plus(F.col("source_size"))})
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("key", "source_size", weight.alias("weight"), (F.col("all_size") * F.lit(share)).alias("mix"))
    fills = F.col("source_size") * F.lit(most)
    filled = running(weighed, [], [fills / F.col("weight"), F.col("key")], {"cap": plus(fills), "heavy": plus(F.col("weight"))})
    before = F.col("mix") - (F.col("cap") - fills), F.col("all_heavy") - (F.col("heavy") - F.col("weight"))
    part = staged(filled.select("key", "source_size", "weight", (before[0] / before[1]).alias("part")))
    largest = part.agg(F.max("part")).first()[0] or 0.0
    target = F.least(F.col("source_size") * F.lit(most), F.col("weight") * F.lit(largest))
    return part.select("key", "source_size", "weight", target.alias("target"))


def copies(draws: str | Column) -> Column:
    """How often a document is taken: the whole repeats of its source's rate, and one more where its draw is below the rest."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(F.col(draws) < rate - whole, 1).otherwise(0)).cast("long")


def planned(measured: DataFrame, **rule) -> DataFrame:
    """Rows of ``measured`` (columns ``source``, ``size``, ``draw`` and others) with ``source_size``, ``target`` and ``copies``.

    Null sources are a source by themselves. An empty table gives an empty table.
    """
    targets = source_targets(measured, **rule)
    named = measured.withColumn("key_", _key("source"))
    return named.join(targets, named["key_"] == targets["key"]).select(*(named[c] for c in measured.columns), "source_size", "target", copies("draw").alias("copies"))


def measured(documents: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix") -> DataFrame:
    """Each document's id, ``source``, ``size`` in words and ``draw``, from one reading of the texts, written to the shared folder."""
    return staged(documents.select(F.col(id_col).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), draw(id_col, text, seed).alias("draw")))


def mix(documents: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix", **rule) -> DataFrame:
    """The mix itself: every row of ``documents`` as often as it is taken, with all its columns and ``copy`` (1, 2, ...; a column of this name is replaced).

    Sources' sizes are summed in a first reading of the texts; the second only draws and repeats, so texts are
    never shuffled while the sources' targets are small enough to be broadcast, which Spark decides by their size.
    Null texts have no words and are taken like others of their source; repeated rows of one id draw alike.
    """
    targets = source_targets(measured(documents, id_col, source, text, seed), **rule)
    kept = [c for c in documents.columns if c != "copy"]
    rows = documents.select(F.struct(*kept).alias("row"), _key(source).alias("key_"), draw(id_col, text, seed).alias("draw"))
    taken = rows.join(targets, rows["key_"] == targets["key"]).select("row", copies("draw").cast("int").alias("n")).where("n > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*", "copy")
