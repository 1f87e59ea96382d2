"""Cumulative points to deltas: what was added between a point of a series and the one before it, with resets and restarts told apart from growth.

A series is a service, a metric and its attributes. Its points stand by time; of several of one time the greatest counts, so points
that come twice change nothing. A point begins anew if its start time is later than the one before had, or if its value fell: then
all of it is new since its start. The first point of a series is new as a whole if it says when it began, else unknown.

A series is cut at time ranges: points are sorted within range and series, and only each range's last point of a series goes on
to the next range, so a series with most of all points is spread over its ranges. Points of null series, time or value are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Microseconds of a range.
RANGE = 6 * 3600 * 1_000_000


def deltas(points: DataFrame, width: int = RANGE) -> DataFrame:
    """series, at, delta (null if unknown), kind (first, growth, restart or reset) and since (the time that the delta counts from) of points (series, at, start, value; times in microseconds)."""
    known = points.filter("series IS NOT NULL AND at IS NOT NULL AND value IS NOT NULL").withColumn("start", F.expr("nullif(start, 0)"))
    one = known.groupBy("series", "at").agg(F.max(F.struct("value", "start")).alias("p")).select("series", "at", F.floor(F.col("at") / width).alias("_range"), F.col("p.value").alias("value"), F.col("p.start").alias("start"))
    whole = F.struct("at", "value", "start")
    # a range's last point, and what each range gets from the one before it that has any
    ends = one.groupBy("series", "_range").agg(F.max(whole).alias("_end"))
    got = ends.withColumn("_got", F.expr("lag(_end) OVER (PARTITION BY series ORDER BY _range)")).select("series", "_range", "_got")
    before = one.withColumn("_within", F.expr("lag(struct(at, value, start)) OVER (PARTITION BY series, _range ORDER BY at)")).join(got, ["series", "_range"])
    row = before.withColumn("_b", F.coalesce("_within", "_got"))
    restart = F.coalesce(F.col("start") > F.col("_b.start"), F.lit(False))
    kind = F.when(F.col("_b").isNull(), "first").when(restart, "restart").when(F.col("value") < F.col("_b.value"), "reset").otherwise("growth")
    row = row.withColumn("kind", kind)
    delta = F.when(F.col("kind") == "growth", F.col("value") - F.col("_b.value")).when((F.col("kind") != "first") | F.col("start").isNotNull(), F.col("value"))
    since = F.when(F.col("kind") == "growth", F.col("_b.at")).when(F.col("kind") == "reset", F.greatest("start", "_b.at")).otherwise(F.col("start"))
    return row.select("series", "at", delta.alias("delta"), "kind", since.alias("since"))
