"""Queries over the base tables, one or more per operator: inputs are built as export payloads, run through the engine and
reduced to scalars, so that plain SQL over the base tables says what must come out."""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Callable
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timefn
from ..operators.flatten import flatten_logs, flatten_metrics, flatten_traces
from ..operators.routing import classify_request, ingest_date, service_dir
from ..session import on_workers, scratch_dir, stored
from ..sources import payloads
from ..sources.wire import encode, read_scalar, write_scalar
from . import handmade, measures, stateful
from .common import CHUNK, attr, entry, envelopes, nanos, read_table, tagged, whole

#: How bodies become payloads.
Reader = Callable[[DataFrame], DataFrame]


# logs

_LOG = f"""named_struct('timeUnixNano', {nanos('ts')}, 'observedTimeUnixNano', {nanos("ts + INTERVAL '1' SECOND")}, 'severityNumber', event_id % 24 + 1, 'severityText', event_type,
    'body', {tagged(s='props')}, 'traceId', lpad(lower(hex(event_id)), 32, '0'), 'spanId', lpad(lower(hex(user_id)), 16, '0'), 'flags', event_id % 2,
    'attributes', array({entry('event_id', i='event_id')}, {entry('user_id', i='user_id')}, {entry('value', d='value')}))"""


def _log_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(read_table(spark, sf_dir, "events"), "logs", "concat('svc-', event_type)", "event_id", _LOG)


def _log_rows(parsed: DataFrame) -> DataFrame:
    rows = flatten_logs(parsed)
    return rows.select(
        whole("event_id").alias("event_id"), "serviceName", "timestamp", "observedTimestamp", "severityNumber", "severityText", F.try_variant_get("body", "$", "string").alias("body"),
        "traceId", "spanId", "flags", whole("user_id").alias("user_id"), attr("value", "double").alias("value"), F.col("scope.name").alias("scope_name"),
    )


LOGS_SQL = """
SELECT event_id, 'svc-' || event_type AS "serviceName", strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
       strftime(ts + INTERVAL 1 SECOND, '%Y-%m-%dT%H:%M:%S.%gZ') AS "observedTimestamp", event_id % 24 + 1 AS "severityNumber", event_type AS "severityText", props AS body,
       lpad(printf('%x', event_id), 32, '0') AS "traceId", lpad(printf('%x', user_id), 16, '0') AS "spanId", event_id % 2 AS flags, user_id, value, 'gen' AS scope_name
FROM events
"""


def logs_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_rows(payloads.parse(_log_bodies(spark, sf_dir)))


def logs_edge_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Malformed records: each kind degrades to omitted or default columns, never to a lost row."""
    ev = read_table(spark, sf_dir, "events")
    record = r"""CASE event_id % 8
        WHEN 0 THEN concat('{"timeUnixNano":"not-a-number","severityNumber":"9","attributes":[{"key":"id","value":{"intValue":"', event_id, '"}}]}')
        WHEN 1 THEN concat('{"timeUnixNano":"999999999999999999999999999999999999","severityText":"","body":{"stringValue":""},"attributes":[{"key":"id","value":{"intValue":"', event_id, '"}}]}')
        WHEN 2 THEN concat('{"timeUnixNano":"","severityNumber":', event_id % 5, ',"body":{},"attributes":[{"key":"id","value":{"intValue":"1"}},{"key":"id","value":{"intValue":"', event_id, '"}},{"key":"","value":{"intValue":"7"}},5]}')
        WHEN 3 THEN concat('{"timeUnixNano":-1,"traceId":5,"body":{"intValue":"', event_id, '"},"attributes":[{"key":"id","value":{"intValue":"', event_id, '"}},{"key":"bad","value":{"stringValue":5}}]}')
        WHEN 4 THEN concat('{"timeUnixNano":1.5,"severityNumber":9,"body":"plain","attributes":[{"key":"id","value":{"intValue":"', event_id, '"}},{"key":"none"}]}')
        WHEN 5 THEN 'null' WHEN 6 THEN '5'
        ELSE concat('{"attributes":{"key":"id"},"body":{"boolValue":"false"}}') END"""
    body = F.expr(f"""concat('{{"resourceLogs":[{{', CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '"resource":{{"attributes":[{{"key":"service.name","value":{{"intValue":5}}}}]}},'
        ELSE '"resource":{{"attributes":[{{"key":"service.name","value":{{"intValue":"5"}}}}]}},' END, '"scopeLogs":[{{"logRecords":[', {record}, ']}}]}}]}}')""")
    rows = flatten_logs(payloads.parse(ev.select("event_id", body.alias("body"))))
    return rows.select("event_id", "serviceName", "timestamp", "severityNumber", "severityText", F.to_json("body").alias("body"), "traceId", whole("id").alias("id"), F.size("attributes").cast("long").alias("n_attributes"))


LOGS_EDGE_SQL = """
SELECT event_id, CASE event_id % 3 WHEN 2 THEN '5' ELSE '_unknown' END AS "serviceName",
       CASE WHEN event_id % 8 IN (2, 3) THEN '1970-01-01T00:00:00.000Z' END AS timestamp,
       CASE event_id % 8 WHEN 2 THEN event_id % 5 WHEN 4 THEN 9 END AS "severityNumber", CAST(NULL AS VARCHAR) AS "severityText",
       CASE event_id % 8 WHEN 1 THEN '""' WHEN 3 THEN '"' || event_id || '"' WHEN 4 THEN '"plain"' WHEN 7 THEN 'true' ELSE 'null' END AS body,
       CAST(NULL AS VARCHAR) AS "traceId", CASE WHEN event_id % 8 <= 4 THEN event_id END AS id,
       CAST(CASE WHEN event_id % 8 <= 3 THEN 1 WHEN event_id % 8 = 4 THEN 2 ELSE 0 END AS BIGINT) AS n_attributes
FROM events
"""


# traces

_SPAN = f"""named_struct('traceId', lpad(lower(hex(l_orderkey)), 32, '0'), 'spanId', lpad(lower(hex(l_linenumber)), 16, '0'), 'name', l_returnflag, 'kind', l_linenumber % 6, 'flags', 1,
    'startTimeUnixNano', {nanos('l_shipdate')}, 'endTimeUnixNano', CASE WHEN l_linenumber = 7 THEN '1' ELSE concat(unix_micros(l_shipdate) + CAST(l_quantity AS BIGINT) * 1500, '000') END,
    'status', CASE WHEN l_linenumber <> 3 THEN named_struct('code', l_linenumber % 3, 'message', l_linestatus) END,
    'attributes', array({entry('partkey', i='l_partkey')}, {entry('price', d='l_extendedprice')}, {entry('returned', b="l_returnflag = 'R'")}))"""


def _span_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelopes(read_table(spark, sf_dir, "lineitem"), "traces", "concat('supplier-', l_suppkey % 10)", "l_orderkey", _SPAN)


def _span_rows(parsed: DataFrame) -> DataFrame:
    return flatten_traces(parsed).select(
        "serviceName", "traceId", "spanId", "parentSpanId", "name", "kind", "flags", "startTimestamp", "durationMs", F.col("status.code").alias("status_code"), F.col("status.message").alias("status_message"),
        whole("partkey").alias("partkey"), attr("price", "double").alias("price"), attr("returned", "boolean").alias("returned"), F.size("events").cast("long").alias("n_events"),
    )


TRACES_SQL = """
SELECT 'supplier-' || l_suppkey % 10 AS "serviceName", lpad(printf('%x', l_orderkey), 32, '0') AS "traceId", lpad(printf('%x', l_linenumber), 16, '0') AS "spanId", CAST(NULL AS VARCHAR) AS "parentSpanId",
       l_returnflag AS name, CAST(l_linenumber % 6 AS BIGINT) AS kind, CAST(1 AS BIGINT) AS flags, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS "startTimestamp",
       CASE WHEN l_linenumber <> 7 THEN CAST(l_quantity AS BIGINT) * 1500000 / 1e6 END AS "durationMs",
       CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber % 3 AS BIGINT) END AS status_code, CASE WHEN l_linenumber <> 3 THEN l_linestatus END AS status_message,
       l_partkey AS partkey, l_extendedprice AS price, l_returnflag = 'R' AS returned, CAST(0 AS BIGINT) AS n_events
FROM lineitem
"""


def traces_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(payloads.parse(_span_bodies(spark, sf_dir)))


def span_events_links(spark: SparkSession, sf_dir: str, read: Reader = payloads.parse) -> DataFrame:
    """One span per order; its lines are events, its suppliers links."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.expr(f"collect_list(named_struct('timeUnixNano', {nanos('l_shipdate')}, 'name', l_returnflag, 'droppedAttributesCount', l_linenumber, 'attributes', array({entry('line', i='l_linenumber')})))").alias("events"),
        F.expr("collect_list(named_struct('traceId', lpad(lower(hex(l_suppkey)), 32, '0'), 'spanId', lpad(lower(hex(l_linenumber)), 16, '0'), 'flags', 1))").alias("links"),
    )
    bodies = envelopes(lines, "traces", "'orders'", "l_orderkey", "named_struct('name', concat('order-', l_orderkey), 'events', events, 'links', links)")
    rows = flatten_traces(read(bodies)).select("name", F.explode(F.arrays_zip("events", "links")).alias("z"))
    return rows.select("name", F.col("z.events.timestamp").alias("event_timestamp"), F.col("z.events.name").alias("event_name"), F.col("z.events.droppedAttributesCount").alias("dropped"), F.try_variant_get(F.try_element_at("z.events.attributes", F.lit("line")), "$", "string").cast("long").alias("line"), F.col("z.links.spanId").alias("link_span"), F.col("z.links.flags").alias("link_flags"))


SPAN_EVENTS_SQL = """
SELECT 'order-' || l_orderkey AS name, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS event_timestamp, l_returnflag AS event_name, CAST(l_linenumber AS BIGINT) AS dropped,
       CAST(l_linenumber AS BIGINT) AS line, lpad(printf('%x', l_linenumber), 16, '0') AS link_span, CAST(1 AS BIGINT) AS link_flags
FROM lineitem
"""


# metrics


def _metric(name: str, kind: str, point: str, more: str = "") -> str:
    return f"named_struct('name', {name}, 'unit', '1', '{kind}', named_struct('dataPoints', array({point}){more}))"


_POINT_TIME = "'startTimeUnixNano', '1000000', 'timeUnixNano', '1700000000123456789'"


def metrics_gauge(spark: SparkSession, sf_dir: str, read: Reader = payloads.parse) -> DataFrame:
    leaf = _metric("'balance'", "gauge", f"named_struct({_POINT_TIME}, 'asDouble', s_acctbal, 'attributes', array({entry('id', i='s_suppkey')}))")
    rows = flatten_metrics(read(envelopes(read_table(spark, sf_dir, "supplier"), "metrics", "concat('nation-', s_nationkey)", "s_suppkey", leaf)))
    return rows.select("serviceName", "metricName", "unit", "metricType", "startTimestamp", "timestamp", F.try_variant_get("value", "$", "double").alias("value"), "valueType", "aggregationTemporality", "isMonotonic", whole("id").alias("id"))


METRICS_GAUGE_SQL = """
SELECT 'nation-' || s_nationkey AS "serviceName", 'balance' AS "metricName", '1' AS unit, 'gauge' AS "metricType", '1970-01-01T00:00:00.001Z' AS "startTimestamp", '2023-11-14T22:13:20.123Z' AS timestamp,
       s_acctbal AS value, 'double' AS "valueType", CAST(NULL AS BIGINT) AS "aggregationTemporality", CAST(NULL AS BOOLEAN) AS "isMonotonic", s_suppkey AS id
FROM supplier
"""


def metrics_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = _metric("p_name", "sum", f"named_struct({_POINT_TIME}, 'asInt', CAST(p_size - 25 AS STRING), 'flags', p_size % 2, 'attributes', array({entry('id', i='p_partkey')}))", ", 'aggregationTemporality', 2, 'isMonotonic', p_size > 25")
    rows = flatten_metrics(payloads.parse(envelopes(read_table(spark, sf_dir, "part"), "metrics", "p_brand", "p_partkey", leaf)))
    return rows.select("serviceName", "metricName", "metricType", "flags", F.to_json("value").alias("value"), "valueType", "aggregationTemporality", "isMonotonic", whole("id").alias("id"), F.size("exemplars").cast("long").alias("n_exemplars"))


METRICS_SUM_SQL = """
SELECT p_brand AS "serviceName", p_name AS "metricName", 'sum' AS "metricType", CAST(p_size % 2 AS BIGINT) AS flags, '"' || (p_size - 25) || '"' AS value, 'int' AS "valueType",
       CAST(2 AS BIGINT) AS "aggregationTemporality", p_size > 25 AS "isMonotonic", p_partkey AS id, CAST(0 AS BIGINT) AS n_exemplars
FROM part
"""


def metrics_histogram(spark: SparkSession, sf_dir: str, read: Reader = payloads.parse) -> DataFrame:
    """Quantities per part counted in three buckets."""
    counts = read_table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(*[F.count(F.when(F.expr(c), 1)).alias(n) for n, c in (("b0", "l_quantity <= 10"), ("b1", "l_quantity > 10 AND l_quantity <= 30"), ("b2", "l_quantity > 30"))], F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))
    point = f"named_struct({_POINT_TIME}, 'count', CAST(n AS STRING), 'sum', s, 'min', lo, 'max', hi, 'bucketCounts', array(CAST(b0 AS STRING), CAST(b1 AS STRING), CAST(b2 AS STRING)), 'explicitBounds', array(10.0D, 30.0D), 'attributes', array({entry('id', i='l_partkey')}))"
    rows = flatten_metrics(read(envelopes(counts, "metrics", "'parts'", "l_partkey", _metric("'quantity'", "histogram", point, ", 'aggregationTemporality', 1"))))
    bucket = lambda i: F.try_variant_get(F.get("bucketCounts", F.lit(i)), "$", "string").cast("long").alias(f"b{i}")
    return rows.select(whole("id").alias("id"), "metricType", F.try_variant_get("count", "$", "string").cast("long").alias("count"), "sum", "min", "max", bucket(0), bucket(1), bucket(2), F.size("explicitBounds").cast("long").alias("n_bounds"), "aggregationTemporality")


METRICS_HISTOGRAM_SQL = """
SELECT l_partkey AS id, 'histogram' AS "metricType", count(*) AS count, sum(l_quantity) AS sum, min(l_quantity) AS min, max(l_quantity) AS max,
       count(*) FILTER (l_quantity <= 10) AS b0, count(*) FILTER (l_quantity > 10 AND l_quantity <= 30) AS b1, count(*) FILTER (l_quantity > 30) AS b2,
       CAST(2 AS BIGINT) AS n_bounds, CAST(1 AS BIGINT) AS "aggregationTemporality"
FROM lineitem GROUP BY l_partkey
"""


def metrics_exp_histogram(spark: SparkSession, sf_dir: str, read: Reader = payloads.parse) -> DataFrame:
    point = f"named_struct({_POINT_TIME}, 'count', p_size, 'sum', p_retailprice, 'scale', p_size % 7 - 3, 'zeroCount', CAST(p_size % 3 AS STRING), 'zeroThreshold', 0.5D, 'positive', named_struct('offset', p_size % 5 - 2, 'bucketCounts', array(CAST(p_size AS STRING), '1')), 'negative', CASE WHEN p_size % 2 = 0 THEN named_struct('offset', -1) END, 'attributes', array({entry('id', i='p_partkey')}))"
    rows = flatten_metrics(read(envelopes(read_table(spark, sf_dir, "part"), "metrics", "p_brand", "p_partkey", _metric("'price'", "exponentialHistogram", point))))
    return rows.select(whole("id").alias("id"), "metricType", F.to_json("count").alias("count"), "sum", "scale", F.to_json("zeroCount").alias("zeroCount"), "zeroThreshold", F.col("positive.offset").alias("offset"), F.size("positive.bucketCounts").cast("long").alias("n_positive"), F.col("negative").isNotNull().alias("has_negative"), F.col("negative.bucketCounts").isNull().alias("no_negative_counts"))


METRICS_EXP_SQL = """
SELECT p_partkey AS id, 'exponentialHistogram' AS "metricType", CAST(p_size AS VARCHAR) AS count, p_retailprice AS sum, CAST(p_size % 7 - 3 AS BIGINT) AS scale, '"' || p_size % 3 || '"' AS "zeroCount",
       CAST(0.5 AS DOUBLE) AS "zeroThreshold", CAST(p_size % 5 - 2 AS BIGINT) AS "offset", CAST(2 AS BIGINT) AS n_positive, p_size % 2 = 0 AS has_negative, true AS no_negative_counts
FROM part
"""


def metrics_summary(spark: SparkSession, sf_dir: str, read: Reader = payloads.parse) -> DataFrame:
    rows = flatten_metrics(read(_point_bodies(spark, sf_dir)))
    rows = rows.select(whole("id").alias("id"), "metricType", F.try_variant_get("count", "$", "string").cast("long").alias("count"), "sum", F.col("exemplars").isNull().alias("no_exemplars"), F.explode("quantileValues").alias("q"))
    return rows.select("id", "metricType", "count", "sum", "no_exemplars", F.col("q.quantile").alias("quantile"), F.col("q.value").alias("value"))


METRICS_SUMMARY_SQL = """
SELECT event_id AS id, 'summary' AS "metricType", user_id AS count, value AS sum, true AS no_exemplars, q AS quantile, CASE WHEN q < 0.9 THEN value ELSE value * 2 END AS value
FROM events, (SELECT unnest([CAST(0.5 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS q)
"""


def _point_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary point per event."""
    point = f"named_struct({_POINT_TIME}, 'count', CAST(user_id AS STRING), 'sum', value, 'quantileValues', array(named_struct('quantile', 0.5D, 'value', value), named_struct('quantile', 0.99D, 'value', value * 2)), 'attributes', array({entry('id', i='event_id')}))"
    return envelopes(read_table(spark, sf_dir, "events"), "metrics", "event_type", "event_id", _metric("'value'", "summary", point))


def metrics_multi_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric with a gauge and a sum gives rows of both, gauge first."""
    point = lambda v: f"named_struct('asDouble', {v}, 'attributes', array({entry('id', i='s_suppkey')}))"
    leaf = f"named_struct('name', s_name, 'sum', named_struct('dataPoints', array({point('s_acctbal * 2')})), 'gauge', named_struct('dataPoints', array({point('s_acctbal')})))"
    rows = flatten_metrics(payloads.parse(envelopes(read_table(spark, sf_dir, "supplier"), "metrics", "'suppliers'", "s_suppkey", leaf)))
    return rows.select("metricName", "metricType", F.col("pointIndex").cast("long").alias("place"), F.try_variant_get("value", "$", "double").alias("value"), whole("id").alias("id"))


METRICS_MULTI_SQL = """
SELECT s_name AS "metricName", 'gauge' AS "metricType", CAST(0 AS BIGINT) AS place, s_acctbal AS value, s_suppkey AS id FROM supplier
UNION ALL SELECT s_name, 'sum', 1, s_acctbal * 2, s_suppkey FROM supplier
"""


def metric_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null asDouble decides a point's value but not an exemplar's."""
    body = F.expr("""concat('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"gauge":{"dataPoints":[{"asDouble":', CASE event_id % 3 WHEN 0 THEN 'null' ELSE CAST(value AS STRING) END, ',"asInt":"', user_id,
        '","exemplars":[{"timeUnixNano":"', unix_micros(ts), '000",', CASE event_id % 3 WHEN 0 THEN '"asDouble":null,' WHEN 1 THEN concat('"asDouble":', value, ',') ELSE '' END, '"asInt":"', user_id, '","filteredAttributes":[{"key":"k","value":{"stringValue":"', event_type, '"}}]}]}]}}]}]}]}')""")
    rows = flatten_metrics(payloads.parse(read_table(spark, sf_dir, "events").select("event_id", body.alias("body"))))
    rows = rows.select("event_id", F.try_variant_get("value", "$", "double").alias("value"), "valueType", F.explode("exemplars").alias("x"))
    return rows.select("event_id", "value", "valueType", F.col("x.timestamp").alias("timestamp"), F.try_variant_get("x.value", "$", "double").alias("exemplar"), F.col("x.valueType").alias("exemplar_type"), F.try_variant_get(F.try_element_at("x.filteredAttributes", F.lit("k")), "$", "string").alias("k"))


METRIC_EXEMPLARS_SQL = """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value, 'double' AS "valueType", strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
       CASE event_id % 3 WHEN 1 THEN value ELSE CAST(user_id AS DOUBLE) END AS exemplar, CASE event_id % 3 WHEN 2 THEN 'int' ELSE 'double' END AS exemplar_type, event_type AS k
FROM events
"""


# values, times, routing


def anyvalue_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tag of a value, and values without one; the last two lie deeper than expressions unfold."""
    value = F.expr(r"""CASE p_partkey % 12 WHEN 0 THEN concat('{"stringValue":"', p_brand, '"}') WHEN 1 THEN concat('{"boolValue":', p_size % 2, '}') WHEN 2 THEN concat('{"intValue":"', p_partkey, '"}')
        WHEN 3 THEN concat('{"doubleValue":', p_size, '.5}') WHEN 4 THEN '{"bytesValue":"3q0="}' WHEN 5 THEN concat('{"arrayValue":{"values":[{"intValue":', p_size, '},{},{"stringValue":5}]}}')
        WHEN 6 THEN concat('{"kvlistValue":{"values":[{"key":"a","value":{"intValue":', p_size, '}},{"key":"b","value":{"stringValue":5}}]}}') WHEN 7 THEN '{}' WHEN 8 THEN concat('"', p_brand, '"') WHEN 9 THEN '{"arrayValue":{"values":7}}'
        WHEN 10 THEN concat('{"arrayValue":{"values":[{"arrayValue":{"values":[{"arrayValue":{"values":[{"intValue":', p_size, '}]}}]}}]}}')
        ELSE concat('{"kvlistValue":{"values":[{"key":"a","value":{"kvlistValue":{"values":[{"key":"b","value":{"kvlistValue":{"values":[{"key":"c","value":{"intValue":', p_size, '}}]}}}]}}}]}}') END""")
    body = F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":'), value, F.lit("}]}]}]}"))
    rows = flatten_logs(payloads.parse(read_table(spark, sf_dir, "part").select("p_partkey", body.alias("body"))).withColumnRenamed("p_partkey", "id"))
    return rows.select("id", F.to_json("body").alias("body"))


ANYVALUE_SQL = """
SELECT p_partkey AS id, CASE p_partkey % 12 WHEN 0 THEN '"' || p_brand || '"' WHEN 1 THEN CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END WHEN 2 THEN '"' || p_partkey || '"' WHEN 3 THEN p_size || '.5' WHEN 4 THEN '"3q0="'
       WHEN 5 THEN '[' || p_size || ',null,null]' WHEN 6 THEN '{"a":' || p_size || '}' WHEN 7 THEN 'null' WHEN 8 THEN '"' || p_brand || '"' WHEN 9 THEN '[]' WHEN 10 THEN '[[[' || p_size || ']]]' ELSE '{"a":{"b":{"c":' || p_size || '}}}' END AS body
FROM part
"""


def timestamp_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.expr("""CASE event_id % 9 WHEN 0 THEN concat('"', unix_micros(ts), '999"') WHEN 1 THEN concat('" ', unix_micros(ts), '000 "') WHEN 2 THEN '"-1"' WHEN 3 THEN '1.5' WHEN 4 THEN '"1e3"' WHEN 5 THEN '"8640000000000000000000"'
        WHEN 6 THEN '"8640000000001000000000"' WHEN 7 THEN CAST(event_id * 1000000 AS STRING) ELSE 'null' END""")
    v = read_table(spark, sf_dir, "events").select("event_id", F.parse_json(raw).alias("v"))
    return v.select("event_id", F.expr(timefn.iso("v")).alias("iso"))


TIMESTAMP_SQL = """
SELECT event_id, CASE event_id % 9 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN 2 THEN '1970-01-01T00:00:00.000Z' WHEN 5 THEN '+275760-09-13T00:00:00.000Z'
       WHEN 7 THEN strftime(make_timestamp(event_id * 1000), '%Y-%m-%dT%H:%M:%S.%gZ') END AS iso
FROM events
"""


def duration_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.expr("CASE event_id % 5 WHEN 0 THEN concat('\"', unix_micros(ts) + 2, '500\"') WHEN 1 THEN '\"1\"' WHEN 2 THEN 'null' WHEN 3 THEN concat('\"', unix_micros(ts), '000\"') ELSE '\"99999999999999999999999999999999999999\"' END")
    v = read_table(spark, sf_dir, "events").select("event_id", F.parse_json(F.expr("concat('\"', unix_micros(ts), '000\"')")).alias("s"), F.parse_json(end).alias("e"))
    return v.select("event_id", F.expr(timefn.duration_ms("s", "e")).isNotNull().alias("known"), F.when(F.expr("event_id % 5 < 4"), F.expr(timefn.duration_ms("s", "e"))).alias("ms"))


DURATION_SQL = """
SELECT event_id, event_id % 5 IN (0, 3, 4) AS known, CASE event_id % 5 WHEN 0 THEN CAST(2500 AS DOUBLE) / 1e6 WHEN 3 THEN CAST(0 AS DOUBLE) END AS ms FROM events
"""


def service_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(r"CASE c_custkey % 8 WHEN 0 THEN concat('a/', c_custkey) WHEN 1 THEN concat('a\\', c_custkey) WHEN 2 THEN '.' WHEN 3 THEN '..' WHEN 4 THEN '   ' WHEN 5 THEN concat(' \t', c_custkey, ' ') WHEN 6 THEN '...' ELSE c_name END")
    c = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name.alias("service"), F.lit("2024-05-01 23:59:59").cast("timestamp").alias("received"))
    return c.select("id", service_dir(F.col("service")).alias("service_dir"), F.date_format(ingest_date(F.col("received")), "yyyy-MM-dd").alias("ingest_date"))


ROUTING_SQL = r"""
SELECT c_custkey AS id, CASE c_custkey % 8 WHEN 0 THEN 'a_' || c_custkey WHEN 1 THEN 'a_' || c_custkey WHEN 2 THEN '_dot' WHEN 3 THEN '_dotdot' WHEN 4 THEN '_unknown' WHEN 5 THEN CAST(c_custkey AS VARCHAR) WHEN 6 THEN '...' ELSE c_name END AS service_dir,
       '2024-05-01' AS ingest_date
FROM customer
"""


def raw_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any JSON value is stored as it came; empty bodies are {}, broken ones are kept apart."""
    body = F.expr("CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('{\"n\":', event_id, '}') WHEN 2 THEN '' ELSE concat('[', event_id, '{') END")
    parsed = payloads.parse(read_table(spark, sf_dir, "events").select("event_id", body.alias("body")))
    good, bad = payloads.split_rejected(parsed)
    lines = good.select("event_id", payloads.serialized(F.col("payload")).alias("line"), F.lit(False).alias("rejected"))
    again = lines.select("event_id", F.try_variant_get(F.parse_json("line"), "$.n", "bigint").alias("n"), F.try_variant_get(F.parse_json("line"), "$.k", "bigint").alias("k"), (F.col("line") == "{}").alias("empty"), "rejected")
    return again.unionByName(bad.select("event_id", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("k"), F.lit(False).alias("empty"), F.lit(True).alias("rejected")))


RAW_SQL = """
SELECT event_id, CASE WHEN event_id % 4 = 1 THEN event_id END AS n, CASE WHEN event_id % 4 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 4 = 2 OR event_id % 4 = 0 AND props = '{}' AS empty, event_id % 4 = 3 AS rejected
FROM events
"""


def _as_protobuf(bodies: DataFrame, signal: str, encoding: str = "identity", packed: bool = False) -> DataFrame:
    on_workers(bodies.sparkSession)

    def wire(batches):  # noqa: ANN001, ANN202
        for b in payloads.in_slices(batches):
            yield pa.RecordBatch.from_pydict({"body": pa.array([encode(signal, json.loads(t), packed) for t in b.column("body").to_pylist()], pa.binary())})

    return bodies.select("body").mapInArrow(wire, "body binary").select(F.lit(signal).alias("signal"), F.lit("application/x-protobuf").alias("contentType"), F.lit(encoding).alias("contentEncoding"), "body")


def _by_wire(signal: str, packed: bool = False) -> Reader:
    """Bodies sent as protobuf and decoded again."""
    return lambda bodies: payloads.parse(payloads.decode_bodies(_as_protobuf(bodies, signal, packed=packed)))


def protobuf_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_gauge(spark, sf_dir, _by_wire("metrics"))


def protobuf_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated numbers one by one."""
    return metrics_histogram(spark, sf_dir, _by_wire("metrics"))


def protobuf_packed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated numbers in one field."""
    return metrics_histogram(spark, sf_dir, _by_wire("metrics", True))


def protobuf_exp_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_exp_histogram(spark, sf_dir, _by_wire("metrics", True))


#: Whole numbers of 64 bits come out of the wire as strings.
PROTOBUF_EXP_SQL = METRICS_EXP_SQL.replace("CAST(p_size AS VARCHAR) AS count", "'\"' || p_size || '\"' AS count")


def protobuf_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics_summary(spark, sf_dir, _by_wire("metrics"))


def protobuf_events_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_events_links(spark, sf_dir, _by_wire("traces"))


def protobuf_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exemplars with either number; one that has both keeps asDouble."""
    exemplar = f"named_struct('timeUnixNano', {nanos('ts')}, 'asDouble', CASE WHEN event_id % 3 <> 0 THEN value END, 'asInt', CASE WHEN event_id % 3 <> 1 THEN CAST(user_id AS STRING) END, 'traceId', lpad(lower(hex(event_id)), 32, '0'), 'spanId', lpad(lower(hex(user_id)), 16, '0'), 'filteredAttributes', array({entry('k', s='event_type')}))"
    leaf = _metric("'value'", "gauge", f"named_struct({_POINT_TIME}, 'asInt', CAST(-event_id AS STRING), 'flags', event_id % 2, 'exemplars', array({exemplar}), 'attributes', array({entry('id', i='event_id')}))")
    rows = flatten_metrics(_by_wire("metrics")(envelopes(read_table(spark, sf_dir, "events"), "metrics", "event_type", "event_id", leaf)))
    rows = rows.select(whole("id").alias("id"), F.to_json("value").alias("value"), "valueType", "flags", F.explode("exemplars").alias("x"))
    return rows.select("id", "value", "valueType", "flags", "x.timestamp", F.to_json("x.value").alias("exemplar"), F.col("x.valueType").alias("exemplar_type"), "x.traceId", "x.spanId", F.try_variant_get(F.try_element_at("x.filteredAttributes", F.lit("k")), "$", "string").alias("k")).withColumn("exemplar", F.when(F.col("exemplar_type") == "int", F.col("exemplar")))


PROTOBUF_EXEMPLARS_SQL = """
SELECT event_id AS id, '"' || -event_id || '"' AS value, 'int' AS "valueType", CAST(event_id % 2 AS BIGINT) AS flags, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
       CASE WHEN event_id % 3 = 0 THEN '"' || user_id || '"' END AS exemplar, CASE WHEN event_id % 3 = 0 THEN 'int' ELSE 'double' END AS exemplar_type,
       lpad(printf('%x', event_id), 32, '0') AS "traceId", lpad(printf('%x', user_id), 16, '0') AS "spanId", event_type AS k
FROM events
"""


def protobuf_anyvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arm of a value over the wire: strings, flags, numbers, bytes, arrays and maps within each other."""
    value = F.expr(r"""CASE p_partkey % 8 WHEN 0 THEN concat('{"stringValue":"', p_brand, '"}') WHEN 1 THEN concat('{"boolValue":', p_size % 2 = 1, '}') WHEN 2 THEN concat('{"intValue":"', -p_partkey, '"}')
        WHEN 3 THEN concat('{"doubleValue":', p_size, '.5}') WHEN 4 THEN concat('{"bytesValue":"', base64(encode(p_brand, 'UTF-8')), '"}') WHEN 5 THEN concat('{"arrayValue":{"values":[{"intValue":"', p_size, '"},{},{"arrayValue":{"values":[{"boolValue":true},{"arrayValue":{"values":[{"stringValue":""}]}}]}}]}}')
        WHEN 6 THEN concat('{"kvlistValue":{"values":[{"key":"a","value":{"kvlistValue":{"values":[{"key":"b","value":{"kvlistValue":{"values":[{"key":"c","value":{"intValue":"', p_size, '"}}]}}}]}}},{"key":"a2","value":{"arrayValue":{"values":[]}}}]}}') ELSE '{}' END""")
    body = F.concat(F.lit('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"severityNumber":'), F.expr("CAST(p_size AS STRING)"), F.lit(',"attributes":[{"key":"id","value":{"intValue":"'), F.col("p_partkey").cast("string"), F.lit('"}}],"body":'), value, F.lit("}]}]}]}"))
    rows = flatten_logs(_by_wire("logs")(read_table(spark, sf_dir, "part").select(body.alias("body"))))
    return rows.select(whole("id").alias("id"), "severityNumber", F.to_json("body").alias("body"))


PROTOBUF_ANYVALUE_SQL = """
SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS "severityNumber", CASE p_partkey % 8 WHEN 0 THEN '"' || p_brand || '"' WHEN 1 THEN CASE WHEN p_size % 2 = 1 THEN 'true' ELSE 'false' END WHEN 2 THEN '"-' || p_partkey || '"' WHEN 3 THEN p_size || '.5'
       WHEN 4 THEN '"' || base64(encode(p_brand)) || '"' WHEN 5 THEN '["' || p_size || '",null,[true,[""]]]' WHEN 6 THEN '{"a":{"b":{"c":"' || p_size || '"}},"a2":[]}' ELSE 'null' END AS body
FROM part
"""


def wire_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalars of the wire that no message of the protocol uses alone, written and read back."""
    on_workers(spark)

    def sent(kind: str) -> Column:
        def there_and_back(xs: pd.Series) -> pd.Series:
            return xs.map(lambda x: str(read_scalar(kind, write_scalar(kind, x))))

        return F.pandas_udf(there_and_back, "string")(F.expr("(p_partkey - 100) * (p_size - 25)"))

    kinds = ("sint", "sfixed32", "float", "int64", "sfixed64", "uint", "fixed32", "double")
    return read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *[sent(k).cast("double").alias(k) for k in kinds])


WIRE_SCALARS_SQL = """
SELECT p_partkey AS id, x AS sint, x AS sfixed32, x AS float, x AS int64, x AS sfixed64, CASE WHEN x < 0 THEN x + 18446744073709551616 ELSE x END AS uint, CASE WHEN x < 0 THEN x + 4294967296 ELSE x END AS fixed32, x AS double
FROM (SELECT p_partkey, CAST((p_partkey - 100) * (p_size - 25) AS DOUBLE) AS x FROM part)
"""


def protobuf_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log_rows(payloads.parse(payloads.decode_bodies(_as_protobuf(_log_bodies(spark, sf_dir), "logs"))))


def protobuf_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_rows(payloads.parse(payloads.decode_bodies(_as_protobuf(_span_bodies(spark, sf_dir), "traces"))))


def protobuf_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = _metric("p_name", "sum", f"named_struct({_POINT_TIME}, 'asInt', CAST(p_size - 25 AS STRING), 'flags', p_size % 2, 'attributes', array({entry('id', i='p_partkey')}))", ", 'aggregationTemporality', 2, 'isMonotonic', p_size > 25")
    bodies = envelopes(read_table(spark, sf_dir, "part"), "metrics", "p_brand", "p_partkey", leaf)
    rows = flatten_metrics(payloads.parse(payloads.decode_bodies(_as_protobuf(bodies, "metrics"))))
    return rows.select("serviceName", "metricName", "metricType", "flags", F.to_json("value").alias("value"), "valueType", "aggregationTemporality", "isMonotonic", whole("id").alias("id"), F.size("exemplars").cast("long").alias("n_exemplars"))


def compressed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gzip, deflate and plain JSON bodies."""
    bodies = _log_bodies(spark, sf_dir)
    on_workers(spark)

    def squeeze(batches):  # noqa: ANN001, ANN202
        for b in payloads.in_slices(batches):
            texts, encodings = (b.column(c).to_pylist() for c in ("body", "contentEncoding"))
            squeezed = [gzip.compress(t.encode()) if e == "gzip" else zlib.compress(t.encode()) if e == "deflate" else t.encode() for t, e in zip(texts, encodings)]
            yield pa.RecordBatch.from_pydict({"contentEncoding": b.column("contentEncoding"), "body": pa.array(squeezed, pa.binary())})

    encoding = F.element_at(F.array(F.lit("gzip"), F.lit("deflate"), F.lit("identity")), (F.pmod(F.xxhash64("body"), F.lit(3)) + 1).cast("int"))
    sent = bodies.select("body", encoding.alias("contentEncoding")).mapInArrow(squeeze, "contentEncoding string, body binary")
    sent = sent.select(F.lit("logs").alias("signal"), F.lit("application/json; charset=utf-8").alias("contentType"), "contentEncoding", "body")
    return _log_rows(payloads.parse(payloads.decode_bodies(sent)))


def request_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.expr("CASE WHEN c_custkey % 11 = 0 THEN 'GET' ELSE 'POST' END").alias("method"),
        F.expr("CASE c_custkey % 5 WHEN 0 THEN '/v1/logs' WHEN 1 THEN '/v1/traces?x=1' WHEN 2 THEN '/v1/metrics' WHEN 3 THEN '/v1/logs/' ELSE '/v1/logs' END").alias("path"),
        F.expr("CASE c_custkey % 4 WHEN 0 THEN 'Application/JSON; charset=utf-8' WHEN 1 THEN 'application/x-protobuf' WHEN 2 THEN 'text/plain' END").alias("type"),
        F.expr("CASE c_custkey % 3 WHEN 0 THEN 'GZIP' WHEN 1 THEN 'br' END").alias("encoding"),
    )
    r = c.withColumn("r", classify_request(F.col("method"), F.col("path"), F.col("type"), F.col("encoding")))
    return r.select("id", "r.status", "r.code", "r.signal")


REQUEST_SQL = """
SELECT id, CAST(split_part(a, ' ', 1) AS INTEGER) AS status, CAST(nullif(split_part(a, ' ', 2), '') AS INTEGER) AS code, CASE WHEN a = '200' THEN CASE id % 5 WHEN 1 THEN 'traces' WHEN 2 THEN 'metrics' ELSE 'logs' END END AS signal
FROM (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '405 12' WHEN c_custkey % 5 = 3 THEN '404 5' WHEN c_custkey % 4 IN (2, 3) THEN '415 3' WHEN c_custkey % 3 = 1 THEN '415 3' ELSE '200' END AS a FROM customer)
"""


def streaming_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log payloads land as files, a stream flattens them, and its output is read back."""
    from ..streaming.stream import drain, flatten_stream

    root = scratch_dir(spark)
    _log_bodies(spark, sf_dir).withColumnRenamed("body", "value").write.text(f"{root}/landing")
    rows = _log_rows(flatten_stream(spark, f"{root}/landing", "text").drop("received_at"))
    drain(rows.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state"))
    return spark.read.schema(rows.schema).parquet(f"{root}/rows")


_JSON_LOG = r"""concat('{"timeUnixNano":"', unix_micros(ts), '000","severityText":"', event_type, '","body":{"kvlistValue":{"values":[{"key":"a","value":{"kvlistValue":{"values":[{"key":"b","value":{"kvlistValue":{"values":[{"key":"c","value":{"intValue":"', event_id,
    '"}}]}}}]}}}]}},"attributes":[{"key":"event_id","value":{"intValue":"', event_id, '"}},{"key":"deep","value":{"arrayValue":{"values":[{"arrayValue":{"values":[{"arrayValue":{"values":[{"intValue":"', user_id, '"}]}}]}}]}}}]}')"""
_LOG_ROW = "serviceName string, timestamp string, severityText string, body variant, attributes map<string,variant>"


def _landed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as the HTTP front lands them: log records with values three deep, as JSON and protobuf, plain and compressed, and bodies that can't be read."""
    on_workers(spark)
    ev = read_table(spark, sf_dir, "events")
    head, tail = F.lit('{"resourceLogs":[{"resource":{"attributes":[{"key":"service.name","value":{"stringValue":"a/'), F.lit("]}]}]}")
    sent = ev.groupBy("event_type", F.expr(f"event_id DIV {CHUNK}").alias("chunk")).agg(F.concat_ws(",", F.collect_list(F.expr(_JSON_LOG))).alias("records"))
    good = sent.select(F.pmod(F.xxhash64("event_type", "chunk"), F.lit(6)).cast("int").alias("form"), F.concat(head, "event_type", F.lit('"}}]},"scopeLogs":[{"logRecords":['), "records", tail).alias("body"))
    poison = ev.filter("event_id % 100 = 0").select(F.expr("CAST(6 + event_id DIV 100 % 5 AS INT)").alias("form"), F.col("event_id").cast("string").alias("body"))
    def nested() -> bytes:
        """A value 1500 arrays deep on the wire, put together from within."""
        out = b"\x0a\x01x"
        for _ in range(1500):
            for tag in (b"\x0a", b"\x2a"):
                n = len(out)
                out = tag + (bytes([n]) if n < 128 else bytes([n & 127 | 128, n >> 7]) if n < 16384 else bytes([n & 127 | 128, n >> 7 & 127 | 128, n >> 14])) + out
        for tag in (b"\x2a", b"\x12", b"\x12", b"\x0a"):
            n = len(out)
            out = tag + bytes([n & 127 | 128, n >> 7 & 127 | 128, n >> 14]) + out
        return out

    def body_of(form: int, text: str, deep: bytes) -> bytes:
        if form >= 6:
            return (b"[" + text.encode(), b"\xff\xff\xff", deep, b'{"n":' + b"7" * 1200 + b"," + b'"id":' + text.encode() + b"}", b'{"' + b"k" * 60_000 + b'":' + text.encode() + b"}")[form - 6]
        raw = encode("logs", json.loads(text)) if form % 2 else text.encode()
        return gzip.compress(raw) if form // 2 == 1 else zlib.compress(raw) if form // 2 == 2 else raw

    def bytes_of(batches):  # noqa: ANN001, ANN202
        deep, forms, out, held = nested(), [], [], 0
        made = lambda: pa.RecordBatch.from_pydict({"form": pa.array(forms, pa.int32()), "body": pa.array(out, pa.binary())})
        for b in payloads.in_slices(batches):
            for form, text in zip(*(b.column(c).to_pylist() for c in ("form", "body"))):
                forms.append(form)
                out.append(body_of(form, text, deep))
                # short texts make long bodies
                if (held := held + len(out[-1])) >= payloads.SLICE:
                    yield made()
                    forms, out, held = [], [], 0
        yield made()

    kind = F.when(F.col("form").isin(1, 3, 5, 7, 8), "application/x-protobuf").otherwise("application/json; charset=utf-8")
    encoding = F.when(F.col("form").isin(2, 3), "gzip").when(F.col("form").isin(4, 5), "deflate")
    at = F.lit("2024-05-01 23:59:59").cast("timestamp")
    made = good.unionByName(poison).select("form", "body").mapInArrow(bytes_of, "form int, body binary")
    return made.select(F.lit("logs").alias("signal"), kind.alias("contentType"), encoding.alias("contentEncoding"), at.alias("received_at"), "body")


def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed requests through the ingest stream, read back from every sink: raw, services, the logs' mirror and what was rejected."""
    from ..streaming.stream import REJECTED, ingest_stream

    root = scratch_dir(spark)
    _landed_logs(spark, sf_dir).write.parquet(f"{root}/landing")
    ingest_stream(spark, f"{root}/landing", f"{root}/out", f"{root}/state").awaitTermination()
    parts = "value string, batch string, {}ingest_date string"
    services = spark.read.schema(parts.format("service_dir string, signal string, ")).text(f"{root}/out/services").select(F.lit("services").alias("sink"), "service_dir", "signal", "ingest_date", F.from_json("value", _LOG_ROW).alias("r"))
    mirror = spark.read.schema(parts.format("service_dir string, ")).text(f"{root}/out/logs-by-service").select(F.lit("logs-by-service").alias("sink"), "service_dir", F.lit(None).cast("string").alias("signal"), "ingest_date", F.from_json("value", _LOG_ROW).alias("r"))
    rows = services.unionByName(mirror).select("sink", "service_dir", "signal", "ingest_date", "r.serviceName", "r.timestamp", "r.severityText", "r.body", "r.attributes")
    raw = spark.read.schema(parts.format("signal string, ")).text(f"{root}/out/raw").select(F.lit("raw").alias("sink"), F.lit(None).cast("string").alias("service_dir"), "signal", "ingest_date", F.parse_json("value").alias("payload"))
    rows = rows.unionByName(flatten_logs(raw).select(*rows.columns))
    rows = rows.select("sink", "service_dir", "signal", "ingest_date", "serviceName", "timestamp", "severityText", F.to_json("body").alias("body"), whole("event_id").alias("event_id"), F.to_json(F.try_element_at("attributes", F.lit("deep"))).alias("deep"), *[F.lit(None).cast("string").alias(c) for c in ("error", "contentType", "body_sha256")])
    rejected = spark.read.schema(f"{REJECTED}, batch string").parquet(f"{root}/out/rejected")
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rejected = rejected.select(F.lit("rejected").alias("sink"), *none("service_dir"), "signal", F.date_format("received_at", "yyyy-MM-dd").alias("ingest_date"), *none("serviceName", "timestamp", "severityText", "body"), F.lit(None).cast("long").alias("event_id"), *none("deep"), "error", "contentType", F.when(F.length("body") < 100_000, F.sha2("body", 256)).alias("body_sha256"))
    # the bytes of a nested value are not for SQL
    return rows.unionByName(rejected.withColumn("body_sha256", F.when((F.col("contentType") != "application/x-protobuf") | (F.col("body_sha256") == hashlib.sha256(b"\xff\xff\xff").hexdigest()), F.col("body_sha256"))))


STREAMING_INGEST_SQL = """
SELECT sink, CASE WHEN sink <> 'raw' THEN 'a_' || event_type END AS service_dir, CASE WHEN sink <> 'logs-by-service' THEN 'logs' END AS signal, '2024-05-01' AS ingest_date, 'a/' || event_type AS "serviceName",
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, event_type AS "severityText", '{"a":{"b":{"c":"' || event_id || '"}}}' AS body, event_id, '[[["' || user_id || '"]]]' AS deep, CAST(NULL AS VARCHAR) AS error, CAST(NULL AS VARCHAR) AS "contentType", CAST(NULL AS VARCHAR) AS body_sha256
FROM events, (SELECT unnest(['raw', 'services', 'logs-by-service']) AS sink)
UNION ALL
SELECT 'rejected', NULL, 'logs', '2024-05-01', NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k IN (1, 2) THEN 'Invalid protobuf' ELSE 'Invalid JSON' END, CASE WHEN k IN (1, 2) THEN 'application/x-protobuf' ELSE 'application/json; charset=utf-8' END,
       CASE k WHEN 0 THEN sha256('[' || event_id) WHEN 1 THEN sha256(unhex('ffffff')) WHEN 3 THEN sha256('{"n":' || repeat('7', 1200) || ',"id":' || event_id || '}') WHEN 4 THEN sha256('{"' || repeat('k', 60000) || '":' || event_id || '}') END
FROM (SELECT event_id, event_id // 100 % 5 AS k FROM events WHERE event_id % 100 = 0)
"""


def sink_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of every signal over three days in two batches, the second of which is written twice; a row per line of each sink."""
    from ..sources.sinks import write_batch

    root, kept = scratch_dir(spark), ("service", "chunk")
    gauge = _metric("'balance'", "gauge", f"named_struct({_POINT_TIME}, 'asDouble', s_acctbal)")
    sent = {
        "logs": envelopes(read_table(spark, sf_dir, "events"), "logs", "concat(' svc/', event_type)", "event_id", _LOG, kept),
        "traces": envelopes(read_table(spark, sf_dir, "lineitem"), "traces", "concat('supplier-', l_suppkey % 10)", "l_orderkey", _SPAN, kept),
        "metrics": envelopes(read_table(spark, sf_dir, "supplier"), "metrics", "'..'", "s_suppkey", gauge, kept),
    }
    day = F.timestamp_seconds(F.lit(1714607999) + F.col("chunk") % 3 * 86400)
    bodies = reduce(DataFrame.unionByName, [b.select(F.lit(signal).alias("signal"), day.alias("received_at"), "chunk", "body") for signal, b in sent.items()])
    # compressed on disk, where kept payloads would spill as they are
    payload = payloads.parse(stored(bodies, "zstd"))
    for number in (0, 1, 1):
        write_batch(payload.filter(F.col("chunk") % 2 == number).drop("chunk"), root, True, number, held=True, compression="gzip")
    found = []
    for sink, parts in (("raw", "signal string, ingest_date string"), ("services", "service_dir string, signal string, ingest_date string"), ("logs-by-service", "service_dir string, ingest_date string")):
        lines = spark.read.schema(f"value string, batch string, {parts}").text(f"{root}/{sink}")
        columns = [F.col(c) if c in lines.columns else F.lit(None).cast("string").alias(c) for c in ("service_dir", "signal", "ingest_date")]
        found.append(lines.select(F.lit(sink).alias("sink"), *columns, F.try_variant_get(F.parse_json("value"), "$.serviceName", "string").alias("service")))
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy("sink", "service_dir", "signal", "ingest_date", "service").agg(F.count("*").alias("n"))


SINK_BATCHES_SQL = f"""
WITH l AS (
  SELECT 'logs' AS signal, ' svc/' || event_type AS service, 'svc_' || event_type AS dir, event_id // {CHUNK} AS chunk FROM events
  UNION ALL SELECT 'traces', 'supplier-' || l_suppkey % 10, 'supplier-' || l_suppkey % 10, l_orderkey // {CHUNK} FROM lineitem
  UNION ALL SELECT 'metrics', '..', '_dotdot', s_suppkey // {CHUNK} FROM supplier),
d AS (SELECT *, CASE chunk % 3 WHEN 0 THEN '2024-05-01' WHEN 1 THEN '2024-05-02' ELSE '2024-05-03' END AS day FROM l)
SELECT 'raw' AS sink, CAST(NULL AS VARCHAR) AS service_dir, signal, day AS ingest_date, CAST(NULL AS VARCHAR) AS service, count(DISTINCT (service, chunk)) AS n FROM d GROUP BY signal, day
UNION ALL SELECT 'services', dir, signal, day, service, count(*) FROM d GROUP BY dir, signal, day, service
UNION ALL SELECT 'logs-by-service', dir, NULL, day, service, count(*) FROM d WHERE signal = 'logs' GROUP BY dir, day, service
"""


def http_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per nation to the HTTP front, in chunks, compressed, as protobuf, or bad in turn; what it answered and what the stream made of it."""
    import http.client

    from ..sources.http import Front, hadoop_folder
    from ..streaming.stream import ingest_stream

    root = scratch_dir(spark)
    front = Front(f"{root}/landing", 0, "127.0.0.1", hadoop_folder(spark, f"{root}/landing")).start()
    answers = []
    try:
        # a table of 25 rows by its specification
        for r in read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect():
            key, log = r.n_nationkey, {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityText": r.n_name, "severityNumber": r.n_nationkey}]}]}]}
            text, path, method = json.dumps(log).encode(), "/v1/logs", "POST"
            head, body = {"Content-Type": "application/json"}, text
            if key % 8 == 1:
                head["Transfer-Encoding"], body = "chunked", iter([text[:7], text[7:20], text[20:]])
            elif key % 8 == 2:
                head["Content-Encoding"], body = "gzip", gzip.compress(text)
            elif key % 8 == 3:
                head, body = {"Content-Type": "application/x-protobuf"}, encode("logs", log)
            elif key % 8 == 4:
                body = text[:-1]
            elif key % 8 == 5:
                body = b'{"n":NaN}'
            elif key % 8 == 6:
                path = "/v1/other"
            elif key % 8 == 7:
                body = b"[" * 1500 + b"]" * 1500
            c = http.client.HTTPConnection("127.0.0.1", front.port, timeout=60)
            c.request(method, path, body, head, encode_chunked="Transfer-Encoding" in head)
            answer = c.getresponse()
            answers.append((key, answer.status, answer.read().decode()))
            c.close()
    finally:
        front.stop()
    ingest_stream(spark, f"{root}/landing", f"{root}/out", f"{root}/state").awaitTermination()
    line = spark.read.schema("value string").text(f"{root}/out/services").select(F.from_json("value", "severityNumber long, severityText string").alias("r")).select(F.col("r.severityNumber").alias("id"), F.col("r.severityText").alias("stored"))
    return spark.createDataFrame(answers, "id long, status int, answer string").join(line, "id", "left")


HTTP_FRONT_SQL = """
SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN k < 4 THEN 200 WHEN k = 6 THEN 404 ELSE 400 END AS status,
       CASE WHEN k = 3 THEN '' WHEN k < 4 THEN '{"partialSuccess": {"rejectedLogRecords": 0}}' WHEN k = 6 THEN '{"code": 5, "message": "Not found"}' ELSE '{"code": 3, "message": "Invalid JSON"}' END AS answer,
       CASE WHEN k < 4 THEN n_name END AS stored
FROM (SELECT *, n_nationkey % 8 AS k FROM nation)
"""


QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "logs_flatten": (logs_flatten, LOGS_SQL),
    "logs_edge_defaults": (logs_edge_defaults, LOGS_EDGE_SQL),
    "traces_flatten": (traces_flatten, TRACES_SQL),
    "span_events_links": (span_events_links, SPAN_EVENTS_SQL),
    "metrics_gauge": (metrics_gauge, METRICS_GAUGE_SQL),
    "metrics_sum": (metrics_sum, METRICS_SUM_SQL),
    "metrics_histogram": (metrics_histogram, METRICS_HISTOGRAM_SQL),
    "metrics_exp_histogram": (metrics_exp_histogram, METRICS_EXP_SQL),
    "metrics_summary": (metrics_summary, METRICS_SUMMARY_SQL),
    "metrics_multi_kind": (metrics_multi_kind, METRICS_MULTI_SQL),
    "metric_exemplars": (metric_exemplars, METRIC_EXEMPLARS_SQL),
    "anyvalue_arms": (anyvalue_arms, ANYVALUE_SQL),
    "timestamp_edges": (timestamp_edges, TIMESTAMP_SQL),
    "duration_edges": (duration_edges, DURATION_SQL),
    "service_routing": (service_routing, ROUTING_SQL),
    "raw_roundtrip": (raw_roundtrip, RAW_SQL),
    "protobuf_logs": (protobuf_logs, LOGS_SQL),
    "protobuf_traces": (protobuf_traces, TRACES_SQL),
    "protobuf_metrics": (protobuf_metrics, METRICS_SUM_SQL),
    "compressed_payloads": (compressed_payloads, LOGS_SQL),
    "request_classification": (request_classification, REQUEST_SQL),
    "streaming_logs": (streaming_logs, LOGS_SQL),
    "protobuf_gauge": (protobuf_gauge, METRICS_GAUGE_SQL),
    "protobuf_histogram": (protobuf_histogram, METRICS_HISTOGRAM_SQL),
    "protobuf_packed_histogram": (protobuf_packed_histogram, METRICS_HISTOGRAM_SQL),
    "protobuf_exp_histogram": (protobuf_exp_histogram, PROTOBUF_EXP_SQL),
    "protobuf_summary": (protobuf_summary, METRICS_SUMMARY_SQL),
    "protobuf_events_links": (protobuf_events_links, SPAN_EVENTS_SQL),
    "protobuf_exemplars": (protobuf_exemplars, PROTOBUF_EXEMPLARS_SQL),
    "protobuf_anyvalue": (protobuf_anyvalue, PROTOBUF_ANYVALUE_SQL),
    "wire_scalars": (wire_scalars, WIRE_SCALARS_SQL),
    "streaming_ingest": (streaming_ingest, STREAMING_INGEST_SQL),
    "sink_batches": (sink_batches, SINK_BATCHES_SQL),
    "http_front": (http_front, HTTP_FRONT_SQL),
    **handmade.QUERIES,
    **measures.QUERIES,
    **stateful.QUERIES,
}
