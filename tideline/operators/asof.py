"""As-of join: every point meets the latest value of its key that is not later than the point.

Points and values are dealt by ranges of key and time, values before points of the same time, so a busy key spreads over as many
ranges as it has rows for. Within a range the last value goes along with the rows behind it. What a range can't know is the last
value before its border: each range gives the last value of each of its keys, and those few rows, one per key and range, carry
it on from range to range. A point that has found none in its own range takes the one carried to its border.

Of values of one key and time the greatest by its columns holds. Points of null key or time, and those before any value, keep
nulls; values of null key or time are none. Repeated points come out each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

_LAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def as_of(points: DataFrame, values: DataFrame, key: str, at: str) -> DataFrame:
    """All columns of points, then those of values but key and at (whose names must differ from the points'), nulls where there is no value."""
    shown = [c for c in values.columns if c not in (key, at)]
    value, given = F.struct(F.col(at).alias("_at"), *shown), F.struct(*points.columns)
    # copies of a time leave one value before they are dealt
    latest = values.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias("_value"))
    # written once: dealing by ranges reads its input twice, and untimed points once more
    left = stored(points.select(F.col(key).alias("_key"), F.col(at).alias("_t"), F.lit(1).alias("_side"), F.xxhash64(F.monotonically_increasing_id()).alias("_salt"), given.alias("_point")))
    timed = left.filter("_key IS NOT NULL AND _t IS NOT NULL")
    right = latest.select(F.col(key).alias("_key"), F.col(at).alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_salt"), F.col("_value"))
    order = ("_key", "_t", "_side", "_salt")
    both = timed.unionByName(right, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
    # written once: a range's number and its rows belong together
    ranged = stored(both.withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    known = ranged.withColumn("_found", F.expr(f"last(_value, true) OVER (PARTITION BY _range, _key ORDER BY _place {_LAST})"))
    ends = ranged.filter("_side = 0").groupBy("_key", "_range").agg(F.max_by("_value", "_place").alias("_end"))
    # a range without a value of a key passes on what it got
    borders = ranged.groupBy("_key", "_range").agg(F.lit(None).cast("int").alias("_none")).drop("_none").join(ends, ["_key", "_range"], "left")
    carried = borders.withColumn("_carried", F.expr("last(_end, true) OVER (PARTITION BY _key ORDER BY _range ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")).filter("_carried IS NOT NULL").select("_key", "_range", "_carried")
    asked = known.filter("_side = 1").select("_key", "_range", "_point", "_found")
    # whoever knows its value needs no border; few of a busy key are left
    found = asked.filter("_found IS NOT NULL").select("_point", "_found")
    open_ = asked.filter("_found IS NULL").join(carried, ["_key", "_range"], "left").select("_point", F.col("_carried").alias("_found"))
    untimed = left.filter("_key IS NULL OR _t IS NULL").select("_point", F.lit(None).cast(ranged.schema["_value"].dataType).alias("_found"))
    out = found.unionByName(open_).unionByName(untimed)
    return out.select("_point.*", *[F.col("_found").getField(c).alias(c) for c in shown])
