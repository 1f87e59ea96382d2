"""Queries of what is computed over metric points: merged exponential histograms and deltas of cumulative points; inputs go through the engine's payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import deltas as cumulative
from ..operators import histograms
from ..operators.flatten import flatten_logs, flatten_metrics
from ..operators.topk import top_k
from ..sources import payloads
from .common import attr, entry, envelopes, nanos, read_table, whole

QUANTILES = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point per supplier and line number, of four scales: quantities are bucket indexes, returned ones below zero, undiscounted ones zero."""
    side = "CASE WHEN l_discount = 0 THEN 'z' WHEN l_returnflag = 'R' THEN 'n' ELSE 'p' END"
    lines = read_table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_linenumber", "CAST(l_quantity AS INT) AS i", f"{side} AS side")
    counts = lines.groupBy("l_suppkey", "l_linenumber", "side", "i").agg(F.count("*").alias("n")).groupBy("l_suppkey", "l_linenumber").agg(
        *[F.expr(f"map_from_entries(collect_list(CASE WHEN side = '{s}' THEN struct(i, n) END))").alias(s) for s in "np"], F.expr("coalesce(sum(CASE WHEN side = 'z' THEN n END), 0)").alias("z"), F.sum("n").alias("all"),
    )
    dense = lambda m: f"named_struct('offset', -24, 'bucketCounts', transform(sequence(1, 50), i -> CAST(coalesce({m}[i], 0) AS STRING)))"
    point = f"named_struct('timeUnixNano', '1700000000123456789', 'count', CAST(all AS STRING), 'scale', l_linenumber % 4 - 1, 'zeroCount', CAST(z AS STRING), 'positive', {dense('p')}, 'negative', {dense('n')})"
    leaf = f"named_struct('name', 'quantity', 'exponentialHistogram', named_struct('dataPoints', array({point})))"
    rows = flatten_metrics(payloads.parse(envelopes(counts, "metrics", "concat('supplier-', l_suppkey % 10)", "l_suppkey", leaf)))
    return histograms.merge(histograms.points(rows, "serviceName"), "serviceName")


def merged_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)


_BUCKETS = """
WITH l AS (SELECT 'supplier-' || l_suppkey % 10 AS service, l_linenumber % 4 - 1 AS scale, CASE WHEN l_discount = 0 THEN 0 WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign, CAST(l_quantity AS INT) - 25 AS i FROM lineitem),
c AS (SELECT *, min(scale) OVER (PARTITION BY service) AS s FROM l),
m AS (SELECT service, s AS scale, sign, CASE WHEN sign <> 0 THEN CAST(floor(i / pow(2, scale - s)) AS BIGINT) END AS bucket, count(*) AS n FROM c GROUP BY ALL)
"""
MERGED_SQL = _BUCKETS + """
SELECT service AS "serviceName", CAST(scale AS INT) AS scale, CAST(sign AS INT) AS sign, bucket, n FROM m
"""


def merged_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quantiles of the merged histograms lie; values within a bucket are held against exact ones by a test."""
    return histograms.quantiles(_merged(spark, sf_dir), QUANTILES, "serviceName").select("serviceName", "q", "sign", "bucket", "fraction", "lower", "upper")


MERGED_QUANTILES_SQL = _BUCKETS + f""",
r AS (SELECT *, sum(n) OVER (PARTITION BY service ORDER BY sign, sign * coalesce(bucket, 0) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n) OVER (PARTITION BY service) AS everything FROM m),
a AS (SELECT *, q * everything AS rank FROM r, (SELECT unnest([{", ".join(f"CAST({q} AS DOUBLE)" for q in QUANTILES)}]) AS q)),
h AS (SELECT *, row_number() OVER (PARTITION BY service, q ORDER BY upto) AS k FROM a WHERE upto >= rank)
SELECT service AS "serviceName", q, CAST(sign AS INT) AS sign, bucket, (rank - (upto - n)) / n AS fraction,
       CASE sign WHEN 1 THEN pow(2, bucket / pow(2, scale)) WHEN -1 THEN -pow(2, (bucket + 1) / pow(2, scale)) ELSE 0 END AS lower,
       CASE sign WHEN 1 THEN pow(2, (bucket + 1) / pow(2, scale)) WHEN -1 THEN -pow(2, bucket / pow(2, scale)) ELSE 0 END AS upper
FROM h WHERE k = 1
"""


_SERIES = """SELECT event_id, user_id, ts, sum(event_id % 10) OVER (PARTITION BY user_id, k // 7, k % 7 >= 4 ORDER BY ts) AS value, min(ts) OVER (PARTITION BY user_id, k // 7) AS began, k
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS k FROM {events})"""


def cumulative_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter per user that starts anew every seventh point, falls to nothing within, doesn't say at times when it began, and sends points twice."""
    read_table(spark, sf_dir, "events").createOrReplaceTempView("tideline_events")
    series = spark.sql(_SERIES.replace("//", "DIV").format(events="tideline_events")).withColumn("again", F.explode(F.expr("IF(event_id % 11 = 0, array(1, 2), array(1))")))
    point = f"named_struct('startTimeUnixNano', CASE WHEN k % 5 <> 3 THEN {nanos('began')} END, 'timeUnixNano', {nanos('ts')}, 'asInt', CAST(value AS STRING), 'attributes', array({entry('user', i='user_id')}))"
    leaf = f"named_struct('name', 'counted', 'sum', named_struct('aggregationTemporality', 2, 'isMonotonic', true, 'dataPoints', array({point})))"
    rows = flatten_metrics(payloads.parse(envelopes(series, "metrics", "'events'", "event_id", leaf)))
    time = lambda c: F.unix_micros(F.to_timestamp(c))
    points = rows.select(whole("user").alias("series"), time("timestamp").alias("at"), time("startTimestamp").alias("start"), F.try_variant_get("value", "$", "string").cast("long").alias("value"))
    return cumulative.deltas(points)


DELTAS_SQL = f"""
WITH s AS ({_SERIES.format(events="events")}),
t AS (SELECT user_id AS series, epoch_us(ts) // 1000 * 1000 AS "at", CASE WHEN k % 5 <> 3 THEN epoch_us(began) // 1000 * 1000 END AS start, CAST(value AS BIGINT) AS value FROM s),
b AS (SELECT *, lag("at") OVER w AS at0, lag(start) OVER w AS start0, lag(value) OVER w AS value0 FROM t WINDOW w AS (PARTITION BY series ORDER BY "at")),
k AS (SELECT *, CASE WHEN at0 IS NULL THEN 'first' WHEN coalesce(start > start0, false) THEN 'restart' WHEN value < value0 THEN 'reset' ELSE 'growth' END AS kind FROM b)
SELECT series, "at", CASE WHEN kind = 'growth' THEN value - value0 WHEN kind <> 'first' OR start IS NOT NULL THEN value END AS delta, kind,
       CASE kind WHEN 'growth' THEN at0 WHEN 'reset' THEN greatest(start, at0) ELSE start END AS since
FROM k
"""


def top_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five logs of each service with the greatest value."""
    leaf = f"named_struct('timeUnixNano', {nanos('ts')}, 'attributes', array({entry('event_id', i='event_id')}, {entry('value', d='value')}))"
    logs = flatten_logs(payloads.parse(envelopes(read_table(spark, sf_dir, "events"), "logs", "event_type", "event_id", leaf)))
    return top_k(logs.select("serviceName", whole("event_id").alias("event_id"), attr("value", "double").alias("value")), 5, "value", "event_id", "serviceName")


TOP_LOGS_SQL = """
SELECT * FROM (SELECT event_type AS "serviceName", event_id, value, CAST(row_number() OVER (PARTITION BY event_type ORDER BY value DESC NULLS LAST, event_id) AS INT) AS rank FROM events) WHERE rank <= 5
"""


QUERIES = {
    "top_logs": (top_logs, TOP_LOGS_SQL),
    "merged_histograms": (merged_histograms, MERGED_SQL),
    "merged_quantiles": (merged_quantiles, MERGED_QUANTILES_SQL),
    "cumulative_deltas": (cumulative_deltas, DELTAS_SQL),
}
