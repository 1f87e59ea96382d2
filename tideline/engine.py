"""The whole engine: an HTTP front that lands requests and a stream that writes them out; or payloads handed over directly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .config import DEFAULT_OUTPUT, DEFAULT_PORT
from .operators.flatten import FLATTEN
from .session import configure
from .sources.http import Front, hadoop_folder
from .sources.sinks import write_batch
from .streaming.stream import LANDED, ingest_stream


class Engine:
    def __init__(self, spark: SparkSession, port: int | None = None, output: str | None = None, *, seconds: float = 5.0, logs_mirror: bool = True, retries_ms: int | None = None):
        self.spark, self.output, self.seconds, self.logs_mirror, self.retries_ms = configure(spark), output or DEFAULT_OUTPUT, seconds, logs_mirror, retries_ms
        self.landing = f"{self.output.rstrip('/')}/_landing"
        self.front = Front(self.landing, DEFAULT_PORT if port is None else port, save=hadoop_folder(spark, self.landing))
        self.query: StreamingQuery | None = None

    def start(self) -> Engine:
        """Listens, then streams; does nothing if it runs. If the port is taken nothing has begun."""
        if self.query:
            return self
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.landing)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
        self.front.start()
        self.query = ingest_stream(self.spark, self.landing, self.output, f"{self.output.rstrip('/')}/_checkpoint", seconds=self.seconds, logs_mirror=self.logs_mirror, clean=True, retries_ms=self.retries_ms)
        return self

    def stop(self) -> None:
        """Stops the front, lets the stream take what has landed, and ends it; does nothing if never started."""
        self.front.stop()
        if self.query:
            self.query.processAllAvailable()
            self.query.stop()
            self.query = None

    def ingest(self, payloads: DataFrame) -> None:
        """Writes payloads (signal, received_at, payload) as a batch."""
        write_batch(payloads, self.output, self.logs_mirror)

    def views(self, payloads: DataFrame) -> None:
        """Temporary views logs, traces and metrics over payloads (signal, payload and more)."""
        for signal, flatten in FLATTEN.items():
            flatten(payloads.filter(payloads["signal"] == signal)).createOrReplaceTempView(signal)


__all__ = ["LANDED", "Engine"]
