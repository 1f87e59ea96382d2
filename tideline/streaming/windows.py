"""Counts, errors and duration sums of services over event time, in windows of a fixed width and in sessions, with late rows kept.

The watermark is the latest event time of all earlier batches less `delay`. A batch is judged by one watermark, whatever the
order of its rows. A row is late for a fixed window that had ended by the watermark, and for sessions if it is not behind the
watermark itself; late rows, and rows without a time, are written whole to a sink of their own, so nothing is lost. A window
closes when the next watermark reaches its end, a session when it reaches the last event plus `gap`; events less than `gap` apart
share a session.

What is open after a batch is a small table of partial sums, named by the stream and the batch's number. A batch that runs again
starts from its predecessor's table and replaces its own output, so a restart changes nothing. Rows are summed before they are
shuffled, for sessions within cells of a gap's width, whose events always share one, so that a service with most of all rows
spreads over tasks and only its cells meet. Sums are whole microseconds, so their order doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import configure

#: A stream's row: further columns go along to the late sink.
MEASURES = "service string, at timestamp, error boolean, us long"
OPEN = "kind string, service string, start long, last long, n long, errors long, us long"
CLOSED = "kind string, service string, start long, end long, n long, errors long, us long"
_SUMS = ("n", "errors", "us")


def span_measures(spans: DataFrame) -> DataFrame:
    """MEASURES of flattened spans: status code 2 is an error, an unknown duration counts as none."""
    return spans.select(F.col("serviceName").alias("service"), F.to_timestamp("startTimestamp").alias("at"), (F.coalesce("status.code", F.lit(0)) == 2).alias("error"), F.round(F.coalesce("durationMs", F.lit(0.0)) * 1000).cast("long").alias("us"))


def micros(interval: str) -> int:
    """Microseconds of an interval such as '10 minutes'."""
    spark = SparkSession.getActiveSession()
    return spark.sql(f"SELECT unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {interval}) AS us").first()["us"]


def _summed(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy("kind", "service", *by).agg(F.min("start").alias("_lo"), F.max("last").alias("_hi"), *[F.sum(c).alias(c) for c in _SUMS])


def tumbling(rows: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """Fixed windows (OPEN; last is the end) of rows (t in microseconds) and of what earlier batches hold."""
    start = F.col("t") - F.pmod("t", F.lit(width))
    new = rows.select(F.lit("tumbling").alias("kind"), "service", start.alias("start"), (start + width).alias("last"), F.lit(1).cast("long").alias("n"), F.col("error").cast("long").alias("errors"), "us")
    return _summed(new.unionByName(held.filter("kind = 'tumbling'")), "start").select("kind", "service", "start", F.col("_hi").alias("last"), *_SUMS)


def sessions(rows: DataFrame, held: DataFrame, gap: int) -> DataFrame:
    """Sessions (OPEN; last is the last event) of rows and of what earlier batches hold."""
    new = rows.select(F.lit("session").alias("kind"), "service", F.col("t").alias("start"), F.col("t").alias("last"), F.floor(F.col("t") / gap).alias("_cell"), F.lit(1).cast("long").alias("n"), F.col("error").cast("long").alias("errors"), "us")
    cells = _summed(new, "_cell").select("kind", "service", F.col("_lo").alias("start"), F.col("_hi").alias("last"), *_SUMS)
    parts = cells.unionByName(held.filter("kind = 'session'"))
    before = F.expr("max(last) OVER (PARTITION BY service ORDER BY start, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    begun = parts.withColumn("_new", F.when(before.isNull() | (F.col("start") >= before + gap), 1).otherwise(0))
    numbered = begun.withColumn("_session", F.expr("sum(_new) OVER (PARTITION BY service ORDER BY start, last ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"))
    return _summed(numbered, "_session").select("kind", "service", F.col("_lo").alias("start"), F.col("_hi").alias("last"), *_SUMS)


def window_stream(rows: DataFrame, output: str, checkpoint: str, *, width: str = "1 hour", gap: str = "30 minutes", delay: str = "10 minutes", seconds: float | None = None) -> StreamingQuery:
    """Sums a stream of MEASURES into output/windows (CLOSED, as they close) and output/late (rows with `late_for`); without seconds it ends when all is done."""
    configure(rows.sparkSession)
    wide, apart, slack = micros(width), micros(gap), micros(delay)
    columns = rows.columns

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        state = lambda n: f"{output}/_open/{stream}/{n}"
        held = spark.read.schema(OPEN).parquet(state(number - 1)) if number else spark.createDataFrame([], OPEN)
        batch = batch.withColumn("t", F.unix_micros("at")).persist()
        try:
            # two numbers, whatever the batch
            clock = held.filter("kind = 'clock'").agg(F.max("last")).first()[0]
            latest = max((x for x in (clock, batch.agg(F.max("t")).first()[0]) if x is not None), default=None)
            mark = clock - slack if clock is not None else -(1 << 62)
            after = latest - slack if latest is not None else mark
            judged = batch.withColumn("_for", F.when(F.col("t").isNull(), F.array(F.lit("no time"))).otherwise(F.array_compact(F.array(F.when(F.col("t") - F.pmod("t", F.lit(wide)) + wide <= mark, "tumbling"), F.when(F.col("t") <= mark, "session")))))
            late = judged.select(*columns, F.explode("_for").alias("late_for"))
            late.write.mode("overwrite").parquet(f"{output}/late/batch={stream}-{number}")
            timely = lambda kind: judged.filter(F.col("t").isNotNull() & ~F.array_contains("_for", kind))
            now = tumbling(timely("tumbling"), held, wide).unionByName(sessions(timely("session"), held, apart)).withColumn("end", F.col("last") + F.when(F.col("kind") == "session", apart).otherwise(0)).persist()
            try:
                now.filter(F.col("end") <= after).select("kind", "service", "start", "end", *_SUMS).write.mode("overwrite").parquet(f"{output}/windows/batch={stream}-{number}")
                kept = now.filter(F.col("end") > after).drop("end")
                if latest is not None:
                    kept = kept.unionByName(spark.createDataFrame([("clock", None, None, latest, None, None, None)], OPEN))
                kept.coalesce(1).write.mode("overwrite").parquet(state(number))
            finally:
                now.unpersist()
        finally:
            batch.unpersist()
        # the table before the last serves no batch any more
        if number > 1:
            path = spark._jvm.org.apache.hadoop.fs.Path(state(number - 2))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def read_windows(spark: SparkSession, output: str) -> DataFrame:
    """The windows that have closed."""
    return spark.read.schema(f"{CLOSED}, batch string").parquet(f"{output}/windows").drop("batch")


def read_open(spark: SparkSession, output: str, query: StreamingQuery, gap: str = "30 minutes") -> DataFrame:
    """The windows that were open after a stream's last batch, as if they closed now."""
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    held = spark.read.schema(OPEN).parquet(f"{output}/_open/{query.id}/{done[-1]}").filter("kind <> 'clock'")
    return held.select("kind", "service", "start", (F.col("last") + F.when(F.col("kind") == "session", micros(gap)).otherwise(0)).alias("end"), *_SUMS)
