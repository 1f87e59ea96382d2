"""Audit of two sinks as multisets of lines: which partitions differ, and by which lines.

Each side is reduced to a count and two order-free sums of line hashes per partition, in one pass without moving lines. Only
partitions in which these differ are looked at again; there every line counts up on the one side and down on the other, summed
before it is shuffled, and what doesn't cancel out is the difference, with its number of copies. Lines that most of a partition
repeats thus meet as one row per task.

Two lines of 64 equal hash bits would have to be exchanged for each other to escape: 64 bits of sum and 64 of exclusive or of
hashes with two seeds stand against that. A null line counts as a line. Null partition values are values of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.flatten import FLATTEN


def summary(lines: DataFrame, *by: str) -> DataFrame:
    """Count and order-free hashes of a column value per partition."""
    other = F.xxhash64(F.lit("other"), "value")
    return lines.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(20,0)")).alias("total"), F.bit_xor(other).alias("mixed"))


def _same(names: tuple[str, ...], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def differing(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """The partitions whose multisets differ, one of which may be missing on a side: by, n_left and n_right."""
    met = summary(left, *by).alias("l").join(summary(right, *by).alias("r"), _same(by, "l", "r"), "full_outer")
    equal = (F.col("l.n") == F.col("r.n")) & F.col("l.total").eqNullSafe(F.col("r.total")) & F.col("l.mixed").eqNullSafe(F.col("r.mixed"))
    names = [F.when(F.col("l.n").isNotNull(), F.col(f"l.{n}")).otherwise(F.col(f"r.{n}")).alias(n) for n in by]
    return met.filter(~F.coalesce(equal, F.lit(False))).select(*names, F.coalesce("l.n", F.lit(0)).alias("n_left"), F.coalesce("r.n", F.lit(0)).alias("n_right"))


def differences(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Lines of partitions that differ: by, value and n, how many more copies the left side has (fewer, if negative)."""
    where = differing(left, right, *by).select(*by)
    side = lambda df, sign: df.select(*by, "value").alias("l").join(where.alias("r"), _same(by, "l", "r"), "left_semi").withColumn("n", F.lit(sign).cast("long"))
    return side(left, 1).unionByName(side(right, -1)).groupBy(*by, "value").agg(F.sum("n").alias("n")).filter("n <> 0")


def normalized_again(raw: DataFrame) -> DataFrame:
    """What the normalized sink should hold of raw lines (signal, ingest_date, value): service_dir, signal, ingest_date and value."""
    from ..sources.payloads import parse
    from ..sources.sinks import normalized

    payloads = parse(raw.select("signal", F.to_timestamp(F.col("ingest_date").cast("string")).alias("received_at"), F.col("value").alias("body")))
    return reduce(DataFrame.unionByName, [normalized(payloads, signal) for signal in FLATTEN])
