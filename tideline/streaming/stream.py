"""Stateless streams over landing folders: each micro-batch is parsed and flattened as a batch would be; nothing is ever late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..session import configure
from ..sources import payloads
from ..sources.sinks import write_batch
from .retries import without_retries

#: Landing files that one micro-batch takes at most.
FILES = 1000
LANDED = "signal string, contentType string, contentEncoding string, received_at timestamp, body binary"
#: What output/rejected holds.
REJECTED = f"{LANDED}, error string"


def _lines(spark: SparkSession, landing: str, form: str, files: int) -> DataFrame:
    configure(spark)
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", files).format(form).load(landing)
    return lines.withColumn("received_at", F.current_timestamp())


def flatten_stream(spark: SparkSession, landing: str, form: str = "text", files: int = FILES) -> DataFrame:
    """Payloads (payload, received_at, payloads.MAYBE) as a stream from text files with one JSON body a line; rejected_stream has the lines that can't be read."""
    return payloads.parse(_lines(spark, landing, form, files), "value").filter("payload IS NOT NULL")


def rejected_stream(spark: SparkSession, landing: str, form: str = "text", files: int = FILES) -> DataFrame:
    """The lines (value, received_at, error) that flatten_stream leaves out, as a stream of its own over the same files."""
    lines = _lines(spark, landing, form, files).withColumn("_line", F.col("value"))
    _, rejected = payloads.split_rejected(payloads.parse(lines, "_line"))
    return rejected.select("value", "received_at", F.lit("Invalid JSON").alias("error"))


_IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(writer: DataStreamWriter, last: bool = True) -> None:
    """Runs a stream over what is there and waits for its end. last: a batch without data follows that lets go what the latest rows have made due; before more rows come it would only cost time."""
    spark = SparkSession.getActiveSession()
    had = spark.conf.get(_IDLE, "true")
    spark.conf.set(_IDLE, had if last else "false")
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_IDLE, had)


def ingest_stream(spark: SparkSession, landing: str, output: str, checkpoint: str, *, seconds: float | None = None, logs_mirror: bool = True, files: int = FILES, clean: bool = False, retries_ms: int | None = None) -> StreamingQuery:
    """Landed requests (Parquet, see LANDED) to the raw and normalized sinks; without seconds it ends when all is done.

    Every batch has its own folder in each sink, named by the checkpoint's stream and the batch's number: a batch that is run again
    after a failure replaces it, so no row doubles, and a stream that starts from a new checkpoint replaces nothing. Requests whose
    bodies can't be read, or not stored, go to output/rejected (Parquet) one by one, whole as they landed, with their reason; read
    without `error` they can land again. clean: landed files go once they are done.
    retries_ms: requests that repeat another up to so many milliseconds before are dropped (retries.without_retries).
    """
    configure(spark)
    landed = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", files).option("cleanSource", "delete" if clean else "off").parquet(landing)
    if retries_ms is not None:
        landed = without_retries(landed, retries_ms)
    decoded = payloads.parse(payloads.decode_bodies(landed.withColumn("_raw", F.col("body"))))
    # a batch is kept while its sinks are written; of what can be read, not the bytes too
    decoded = decoded.withColumn("_raw", F.when(F.col("payload").isNull() | F.col("error").isNotNull(), F.col("_raw")))

    def write(batch: DataFrame, number: int) -> None:
        name = f"{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        batch = batch.persist()
        try:
            write_batch(batch.filter("payload IS NOT NULL AND error IS NULL"), output, logs_mirror, name, held=True)
            rejected = batch.filter("payload IS NULL OR error IS NOT NULL").withColumn("error", F.coalesce("error", F.lit("Invalid JSON")))
            rejected.select("signal", "contentType", "contentEncoding", "received_at", F.col("_raw").alias("body"), "error").write.mode("overwrite").parquet(f"{output}/rejected/batch={name}")
        finally:
            batch.unpersist()

    writer = decoded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()
