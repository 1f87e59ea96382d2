"""python -m tideline.cli [--port N] [--output DIR]: runs the engine until SIGINT or SIGTERM."""

from __future__ import annotations

import os
import signal
import sys
import threading

from pyspark.sql import SparkSession

from .config import options
from .engine import Engine


def main(argv: list[str] | None = None) -> int:
    chosen = options(sys.argv[1:] if argv is None else argv, os.environ)
    done = threading.Event()
    spark = SparkSession.builder.appName("tideline").getOrCreate()
    # a session puts in a handler of its own, so these come after it
    for name in (signal.SIGINT, signal.SIGTERM):
        signal.signal(name, lambda *_: done.set())
    engine = Engine(spark, chosen.port, chosen.output).start()
    print(f"listening on {engine.front.port}, writing to {chosen.output}", flush=True)
    done.wait()
    engine.stop()
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
