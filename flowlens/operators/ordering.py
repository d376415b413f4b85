"""Running sums and numbers over an order that no single task sees whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.storage import discard, materialise

_HELD: list[DataFrame] = []


def release() -> None:
    """Remove the dealt-out rows that earlier calls have written for their results."""
    while _HELD:
        discard(_HELD.pop())


def running_sums(rows: DataFrame, keys: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with sums of whole numbers from the first row of its key up to each row, by unique order.

    Rows are dealt out by ranges of (keys, order). Inside a range the sums are a window; what lies before it
    is added from the sums of whole ranges, of which there is one row for each range and key.
    """
    part, *totals = ("_part", *(f"_total_{n}" for n in sums))
    # order and sums must come from one evaluation of the range partitioning, so that it is written
    ranged = materialise(rows.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    _HELD.append(ranged)
    per = ranged.groupBy(part, *keys).agg(*(F.sum(c).alias(t) for t, c in zip(totals, sums.values(), strict=True)))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = per.select(part, *keys, *(F.coalesce(F.sum(t).over(before), F.lit(0)).alias(t) for t in totals))
    within = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumns({n: F.sum(c).over(within) for n, c in sums.items()}).join(before, [part, *keys])
    return found.withColumns({n: F.col(n) + F.col(t) for n, t in zip(sums, totals, strict=True)}).drop(part, *totals)


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with their place in the order, from 1 in each key."""
    return running_sums(rows, keys, order, {name: F.lit(1).cast("bigint")})
