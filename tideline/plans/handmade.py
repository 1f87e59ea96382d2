"""Protobuf bodies put together in SQL, byte by byte as the public protocol lays them out, with fields of a later version among them: what the decoder reads then wasn't written by its own table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import let
from ..operators.flatten import flatten_logs
from ..sources import payloads
from .common import read_table, whole

#: Records of one body.
RECORDS = 50


def varint(n: str) -> str:
    """Hex of a number below 2**28."""
    byte = lambda k, more: f"lpad(hex({'128 + ' if more else ''}shiftright({n}, {7 * k}) % 128), 2, '0')"
    chain = lambda k: " || ".join(byte(i, i < k) for i in range(k + 1))
    return f"CASE WHEN {n} < 128 THEN {chain(0)} WHEN {n} < 16384 THEN {chain(1)} WHEN {n} < 2097152 THEN {chain(2)} ELSE {chain(3)} END"


def wide(n: str) -> str:
    """Hex of eight bytes, the least first."""
    return "concat(" + ", ".join(f"substr(lpad(hex({n}), 16, '0'), {i}, 2)" for i in range(15, 0, -2)) + ")"


def sized(tag: str, raw: str) -> str:
    """A tag in hex, the length of what follows, and that."""
    return let(raw, lambda x: f"concat('{tag}', " + let(f"CAST(length({x}) DIV 2 AS INT)", varint) + f", {x})")


def text(value: str) -> str:
    return f"hex(encode({value}, 'UTF-8'))"


#: Fields 100 to 103 of no version: a number, eight bytes, a text, four bytes.
LATER = "'A00605' || 'A9060000000000000001' || 'B2060461626364' || 'BD0600000001'"


def protobuf_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id").cast("int")).selectExpr(
        "*", f"{sized('0A', text(repr('event_id')))} || {sized('12', '(' + repr('18') + ' || ' + varint('event_id') + ')')} AS attribute",
    )
    record = f"concat({LATER}, '09', {wide('unix_micros(ts) * 1000')}, '10', {varint('CAST(event_id % 24 + 1 AS INT)')}, {sized('1A', text('event_type'))}, {LATER}, {sized('32', 'attribute')}, {sized('2A', '(' + sized('0A', text('props')) + ')')}, '4501000000')"
    records = ev.selectExpr(f"event_id DIV {RECORDS} AS chunk", "event_type", f"{record} AS record").selectExpr("chunk", "event_type", f"{sized('12', 'record')} AS part")
    scopes = records.groupBy("chunk", "event_type").agg(F.concat_ws("", F.collect_list("part")).alias("records")).selectExpr("event_type", f"{LATER} || records AS scope")
    service = f"{sized('0A', '(' + sized('0A', text(repr('service.name'))) + ' || ' + sized('12', '(' + sized('0A', text('event_type')) + ')') + ')')}"
    named = scopes.selectExpr(f"{service} AS resource", "scope").selectExpr(f"{sized('0A', 'resource')} || {sized('12', 'scope')} || {LATER} AS part")
    bodies = named.select(F.lit("logs").alias("signal"), F.lit("application/x-protobuf").alias("contentType"), F.lit(None).cast("string").alias("contentEncoding"), F.expr(f"unhex({sized('0A', 'part')} || {LATER})").alias("body"))
    rows = flatten_logs(payloads.parse(payloads.decode_bodies(bodies)))
    return rows.select(whole("event_id").alias("event_id"), "serviceName", "timestamp", "severityNumber", "severityText", F.try_variant_get("body", "$", "string").alias("body"), "flags")


PROTOBUF_BY_HAND_SQL = """
SELECT event_id, event_type AS "serviceName", strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, event_id % 24 + 1 AS "severityNumber", event_type AS "severityText", props AS body, CAST(1 AS BIGINT) AS flags FROM events
"""

QUERIES = {"protobuf_by_hand": (protobuf_by_hand, PROTOBUF_BY_HAND_SQL)}
