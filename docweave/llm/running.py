"""Running totals over sorted rows, with no task that sees a whole group."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.common import staged


class Total(NamedTuple):
    """What is totalled, by which aggregate, and how the totals of two runs of rows become one."""

    of: Column
    by: Callable[[Column], Column]
    both: Callable[[Column, Column], Column]


def plus(of: Column) -> Total:
    return Total(of, F.sum, lambda a, b: a + b)


def xor(of: Column) -> Total:
    return Total(of, F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], totals: dict[str, Total]) -> DataFrame:
    """``rows`` with, for each name of ``totals``, the total over the rows of the same keys up to this one in
    ``order``, and as ``all_<name>`` the total over all rows of the same keys.

    The rows are dealt out by ranges of (keys, order), so that a group, however large, lies in as many partitions
    as it needs. Each partition totals its own rows; a window over the partitions of a group, which are few, gives
    what comes before them. Keys and totalled values must not be null; rows that are equal in ``order`` come in
    any order. An empty table gives an empty table.
    """
    placed = staged(rows.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id()))
    here = Window.partitionBy("part_", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part_", *keys).agg(*(t.by(t.of).alias(n) for n, t in totals.items()))
    parts = parts.select(
        *(F.col(k).alias(f"{k}_of") for k in ("part_", *keys)),
        *(F.coalesce(t.by(F.col(n)).over(earlier), F.lit(0)).alias(f"earlier_{n}") for n, t in totals.items()),
        *(t.by(F.col(n)).over(group).alias(f"all_{n}") for n, t in totals.items()),
    )
    counted = placed.withColumns({f"here_{n}": t.by(t.of).over(here) for n, t in totals.items()})
    same = [F.col(k) == F.col(f"{k}_of") for k in ("part_", *keys)]
    return counted.join(parts, same).select(
        *rows.columns,
        *(t.both(F.col(f"earlier_{n}"), F.col(f"here_{n}")).alias(n) for n, t in totals.items()),
        *(f"all_{n}" for n in totals),
    )
