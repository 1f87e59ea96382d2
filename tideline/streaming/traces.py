"""Traces put together from spans that arrive in any order: whole when their root has come, overdue when it has not by a deadline.

A trace's round begins with its first span by received_at and ends `wait` later, or `settle` after its root, whichever is first;
spans received up to then belong to it, later ones begin another round. A round is decided when the watermark, the latest
received_at less `delay`, has passed its end, so the order of arrival within `delay` changes nothing.

State is sums per trace and time of receipt, not spans: spans of one request are summed in the worker that decoded them, before
they are shuffled, so a trace with most of all spans is a few rows. Traces are kept in BUCKETS by a hash of their id, so Python is
called per bucket and batch, not per trace; a bucket's sums are stored as compressed columns, since Spark's usual store keeps two
versions of all state in the executors' memory. A timer on the event-time clock wakes a bucket in which a round ends, and a trace's sums
go with its last round. A span received before the watermark would be left out by Spark: `delay` has to be longer than landed files
are out of order.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import on_workers

#: A decided round: microseconds of the first receipt, the first start and the last end.
ROUND = "traceId string, verdict string, spans long, errors long, received long, start long, end long"
_NAMES = [c.split()[0] for c in ROUND.split(", ")]
#: Groups of traces that state is kept by; a bucket's state is read and written whole, so larger streams want more.
BUCKETS = 512
_PART = "traceId string, received_at timestamp, roots long, spans long, errors long, start long, end long"


def span_parts(spans: DataFrame) -> DataFrame:
    """traceId, received_at and what completes a trace of flattened spans with a received_at; no parent makes a root."""
    time = lambda c: F.unix_micros(F.to_timestamp(c))
    root = (F.coalesce("parentSpanId", F.lit("")) == "").cast("long")
    return spans.filter("traceId IS NOT NULL").select("traceId", "received_at", root.alias("roots"), F.lit(1).cast("long").alias("spans"), (F.coalesce("status.code", F.lit(0)) == 2).cast("long").alias("errors"), time("startTimestamp").alias("start"), time("endTimestamp").alias("end"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per trace and receipt within a batch of rows."""
    names = ("traceId", "received_at", "roots", "spans", "errors", "start", "end")
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["traceId", "received_at"]).aggregate([("roots", "sum"), ("spans", "sum"), ("errors", "sum"), ("start", "min"), ("end", "max")])
        t = t.select(["traceId", "received_at", "roots_sum", "spans_sum", "errors_sum", "start_min", "end_max"]).rename_columns(list(names))
        yield from t.combine_chunks().to_batches()


def rounds(parts: list[tuple], wait: int, settle: int) -> Iterator[tuple[int, list[tuple]]]:
    """End and sums of each round of a trace's sums (received, roots, spans, errors, start, end), in order; times in microseconds."""
    end, now = None, []
    for p in sorted(parts, key=lambda p: p[0]):
        if now and p[0] > end:
            yield end, now
            now = []
        if not now:
            end = p[0] + wait
        if p[1]:
            end = min(end, p[0] + settle)
        now.append(p)
    if now:
        yield end, now


def _decided(trace: str, parts: list[tuple]) -> tuple:
    some = lambda i: [p[i] for p in parts if p[i] is not None]
    return (trace, "whole" if any(p[1] for p in parts) else "overdue", sum(p[2] for p in parts), sum(p[3] for p in parts), parts[0][0], min(some(4), default=None), max(some(5), default=None))


_STATE = pa.schema([("traceId", pa.string()), *[(c, pa.int64()) for c in ("received", "roots", "spans", "errors", "start", "end")]])


def packed(held: dict[str, list[tuple]]) -> bytes:
    """Sums of traces (received, roots, spans, errors, start, end) as they are stored; in order of the traces, whose ids then share what they begin with."""
    rows = [(trace, *p) for trace in sorted(held) for p in held[trace]]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STATE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _STATE)], _STATE))
    return sink.getvalue().to_pybytes()


def unpacked(raw: bytes) -> Iterator[tuple[str, tuple]]:
    """Each trace's sums, one by one, as they went into packed."""
    table = pa.ipc.open_stream(pa.py_buffer(bytes(raw))).read_all()
    for trace, *p in zip(*(c.to_pylist() for c in table.columns)):
        yield trace, tuple(p)


def complete_traces(parts: DataFrame, wait_ms: int = 60_000, settle_ms: int = 5_000, delay: str = "1 minute", buckets: int = BUCKETS) -> DataFrame:
    """ROUNDs of a stream of span_parts, each as soon as the watermark has passed its end. A stream keeps its number of buckets for as long as its checkpoint."""
    on_workers(parts.sparkSession)
    wait, settle = wait_ms * 1000, settle_ms * 1000

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = defaultdict(list)
        if state.exists:
            for trace, part in unpacked(state.get[0]):
                held[trace].append(part)
        if not state.hasTimedOut:
            for f in frames:
                # times come as microseconds, without a zone to get lost
                columns = [f[c].tolist() for c in ("traceId", "received", "roots", "spans", "errors", "start", "end")]
                # a null among them makes doubles of start and end, exact up to 2**53 microseconds
                columns[5:] = [[None if x != x else int(x) for x in c] for c in columns[5:]]
                for trace, *part in zip(*columns):
                    held[trace].append(tuple(part))
        mark, out, rest, due = state.getCurrentWatermarkMs() * 1000, [], {}, None
        for trace, some in held.items():
            keep = []
            for end, of in rounds(some, wait, settle):
                if end < mark:
                    out.append(_decided(trace, of))
                else:
                    keep += of
                    due = end if due is None else min(due, end)
            if keep:
                rest[trace] = keep
        if rest:
            state.update((packed(rest),))
            state.setTimeoutTimestamp(due // 1000 + 1)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=_NAMES).astype({"start": "Int64", "end": "Int64"})

    few = parts.select(*[c.split()[0] for c in _PART.split(", ")]).mapInArrow(_summed, _PART)
    marked = few.withWatermark("received_at", delay).withColumns({"received": F.unix_micros("received_at"), "_bucket": F.pmod(F.xxhash64("traceId"), F.lit(buckets)).cast("int")})
    return marked.groupBy("_bucket").applyInPandasWithState(advance, ROUND, "parts binary", "append", GroupStateTimeout.EventTimeTimeout)
