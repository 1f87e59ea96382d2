"""Merging exponential histograms: points of unequal scale are brought to the coarsest of their key, buckets summed by index, and quantiles read off with the bounds of their bucket.

At scale s the bucket of index i holds values above 2^(i / 2^s) and up to 2^((i + 1) / 2^s). One scale coarser two neighbours become
one, so an index loses a bit per step, negative ones too. Buckets are summed as they came before anything else, per key, scale, sign
and index, which leaves few rows of however many points; only these meet the key's coarsest scale.

Points of null key or scale are left out; null counts are none, and buckets without a count aren't there. Quantiles are of all
counted values: rank q n lies in the first bucket that reaches it, in the order negative, zero, positive; inside a bucket the
value is interpolated on the logarithmic scale. The error is the bucket's width at most, a factor of 2^(2^-s).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signs of buckets: below zero, zero, above.
NEGATIVE, ZERO, POSITIVE = -1, 0, 1


def points(metrics: DataFrame, *keys: str) -> DataFrame:
    """keys, scale, count, sum, min, max, zero and the buckets (offset, counts) of flattened exponential histograms."""
    whole = lambda v: F.try_variant_get(v, "$", "string").cast("long")
    buckets = lambda c: F.struct(F.coalesce(F.col(f"{c}.offset"), F.lit(0)).alias("offset"), F.transform(F.col(f"{c}.bucketCounts"), whole).alias("counts"))
    rows = metrics.filter("metricType = 'exponentialHistogram'")
    return rows.select(*keys, F.col("scale").cast("int").alias("scale"), whole(F.col("count")).alias("count"), "sum", "min", "max", whole(F.col("zeroCount")).alias("zero"), buckets("positive").alias("positive"), buckets("negative").alias("negative"))


def merge(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key and bucket of the merged histogram: keys, scale (the coarsest), sign, bucket (its index, null for zero) and n."""
    rows = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in (*keys, "scale")))
    side = lambda sign, c: rows.select(*keys, "scale", F.lit(sign).alias("sign"), F.posexplode_outer(F.col(f"{c}.counts")).alias("_i", "n"), F.col(f"{c}.offset").alias("_o"))
    every = side(POSITIVE, "positive").unionByName(side(NEGATIVE, "negative")).select(*keys, "scale", "sign", (F.col("_i") + F.col("_o")).cast("long").alias("bucket"), "n")
    every = every.unionByName(rows.select(*keys, "scale", F.lit(ZERO).alias("sign"), F.lit(None).cast("long").alias("bucket"), F.col("zero").alias("n")))
    # rows without a count stay so far: their scale counts too
    summed = every.groupBy(*keys, "scale", "sign", "bucket").agg(F.sum("n").alias("n"))
    coarsest = summed.groupBy(*keys).agg(F.min("scale").alias("_s"))
    met = summed.filter("n > 0").join(coarsest, list(keys))
    # twenty steps and more join all there is on either side of one
    moved = met.withColumn("bucket", F.expr("shiftright(bucket, CAST(least(scale - _s, 63) AS INT))"))
    return moved.groupBy(*keys, F.col("_s").alias("scale"), "sign", "bucket").agg(F.sum("n").alias("n"))


def totals(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key: points, count, sum, min and max of its histograms."""
    rows = rows.filter(" AND ".join(f"`{k}` IS NOT NULL" for k in (*keys, "scale")))
    return rows.groupBy(*keys).agg(F.count("*").alias("points"), F.sum("count").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"))


def quantiles(merged: DataFrame, qs: tuple[float, ...], *keys: str) -> DataFrame:
    """Per key and q: sign and bucket in which it lies, fraction of the bucket's values up to it, value, and the bucket's bounds lower and upper."""
    by = ", ".join(f"`{k}`" for k in keys)
    # -1 turns the order of buckets below zero
    placed = merged.withColumn("_place", F.col("sign") * F.coalesce("bucket", F.lit(0)))
    running = placed.withColumns({"_upto": F.expr(f"sum(n) OVER (PARTITION BY {by} ORDER BY sign, _place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"), "_all": F.expr(f"sum(n) OVER (PARTITION BY {by})")})
    asked = running.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("_rank", F.col("q") * F.col("_all"))
    # the first bucket that reaches the rank; rank 0 lies in the first of all
    hit = asked.filter((F.col("_upto") >= F.col("_rank")) & ((F.col("_upto") - F.col("n") < F.col("_rank")) | ((F.col("_rank") == 0) & (F.col("_upto") == F.col("n")))))
    fraction = (F.col("_rank") - (F.col("_upto") - F.col("n"))) / F.col("n")
    near, far = F.pow(F.lit(2.0), F.col("bucket") / F.pow(F.lit(2.0), F.col("scale"))), F.pow(F.lit(2.0), (F.col("bucket") + 1) / F.pow(F.lit(2.0), F.col("scale")))
    inside = lambda f: F.pow(F.lit(2.0), (F.col("bucket") + f) / F.pow(F.lit(2.0), F.col("scale")))
    hit = hit.withColumn("fraction", fraction)
    below, above = F.col("sign") == NEGATIVE, F.col("sign") == POSITIVE
    pick = lambda neg, pos: F.when(below, neg).when(above, pos).otherwise(0.0)
    return hit.select(*keys, "q", "scale", "sign", "bucket", "fraction", pick(-inside(1 - F.col("fraction")), inside(F.col("fraction"))).alias("value"), pick(-far, near).alias("lower"), pick(-near, far).alias("upper"))
