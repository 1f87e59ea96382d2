"""What the queries share: reading tables and building export payloads from their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure

#: Leaves that one payload holds.
CHUNK = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def tagged(s: str = "NULL", i: str = "NULL", d: str = "NULL", b: str = "NULL") -> str:
    return f"named_struct('stringValue', CAST({s} AS STRING), 'intValue', CAST({i} AS STRING), 'doubleValue', CAST({d} AS DOUBLE), 'boolValue', CAST({b} AS BOOLEAN))"


def entry(key: str, **value: str) -> str:
    return f"named_struct('key', '{key}', 'value', {tagged(**value)})"


def nanos(ts: str) -> str:
    return f"concat(unix_micros({ts}), '000')"


_NAMES = {"logs": ("resourceLogs", "scopeLogs", "logRecords"), "traces": ("resourceSpans", "scopeSpans", "spans"), "metrics": ("resourceMetrics", "scopeMetrics", "metrics")}


def envelopes(df: DataFrame, signal: str, service: str, number: str, leaf: str, kept: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """Payloads (body) with up to CHUNK leaves of one service each; number: a whole number that tells rows apart; kept: of service, chunk and by, further expressions that a payload's leaves share."""
    top, middle, inner = _NAMES[signal]
    rows = df.select(F.expr(service).alias("service"), F.expr(f"({number}) DIV {CHUNK}").alias("chunk"), F.expr(leaf).alias("leaf"), *[F.expr(e) for e in by])
    body = f"""to_json(named_struct('{top}', array(named_struct('resource', named_struct('attributes', array({entry('service.name', s='service')})),
        '{middle}', array(named_struct('scope', named_struct('name', 'gen', 'version', '1.0'), '{inner}', collect_list(leaf)))))))"""
    shared = [c for c in rows.columns if c not in ("service", "chunk", "leaf")]
    return rows.groupBy("service", "chunk", *shared).agg(F.expr(body).alias("body")).select("body", *[c for c in kept if c != "body"])


def attr(name: str, type_: str, column: str = "attributes"):
    return F.try_variant_get(F.try_element_at(column, F.lit(name)), "$", type_)


def whole(name: str, column: str = "attributes"):
    return attr(name, "string", column).cast("long")
