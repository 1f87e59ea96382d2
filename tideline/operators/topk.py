"""The k greatest rows of every group by threshold: a count per group and cell of value bounds what can be among them, and only rows at or above the bound are ordered.

A cell is a value's place on a logarithmic scale, about one percent wide, so it falls and rises with the value. Counts per cell are
summed before they are shuffled, few rows however many there are in a group. From the greatest cell down, the cell that brings a
group to k rows is its bound: what lies below can't be among the k. Bounds go to every task while there are MOST groups at most,
which is counted; beyond that all rows are candidates. Of candidates each task keeps k per group before they meet, so a group
of ties is no burden to one task either.

Order: the greatest value first, NaN above all, nulls last; ties by the least `tie`, nulls of it first. Null groups are a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Groups whose bounds go to every task.
MOST = 1_000_000
#: Cells of a doubling, and more than any value's cell is from that of 1.
FINE, FAR = 64, 70_000


def cell(value: Column) -> Column:
    """A value's cell; nulls lie in the lowest."""
    place = lambda x: F.floor(F.log2(x) * FINE) + FAR
    x = value.cast("double")
    top = F.lit(3 * FAR).cast("long")
    return F.when(x.isNull(), -top).when(F.isnan(x) | (x == float("inf")), top).when(x == float("-inf"), 1 - top).when(x > 0, place(x)).when(x < 0, -place(-x)).otherwise(F.lit(0).cast("long"))


def bounds(rows: DataFrame, k: int, value: str, *group: str) -> DataFrame:
    """The cell of every group below which no row is among its k greatest."""
    counts = rows.groupBy(*group, cell(F.col(value)).alias("_cell")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    return counts.withColumn("_before", before).filter(F.col("_before") < k).groupBy(*group).agg(F.min("_cell").alias("_bound"))


def top_k(rows: DataFrame, k: int, value: str, tie: str, *group: str) -> DataFrame:
    """All columns of rows and their rank (from 1) within their group, for the k greatest of each."""
    known = bounds(rows, k, value, *group)
    if known.limit(MOST + 1).count() <= MOST:
        right = known.withColumnsRenamed({g: f"_{g}" for g in group})
        on = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group])
        rows = rows.join(F.broadcast(right), on).filter(cell(F.col(value)) >= F.col("_bound")).select(*rows.columns)
    order = Window.partitionBy(*group).orderBy(F.desc_nulls_last(value), F.asc_nulls_first(tie))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
