"""Trace trees: each span's root, depth and subtree by pointer doubling over parent ids, and each trace's critical path.

A span points to its parent, its pointer is n steps long. In a round every pointer becomes that of the span it points to, twice as
long, so a chain of 10,000 spans takes 14 rounds, and a span whose pointer has reached a root, or a parent that isn't there, is
done and leaves. In a round that follows a span's line, the one of its line that is just within reach of the top is done; so what is
still on its way after a round in which none was done goes in a circle.

Traces of LOCAL spans at most are dealt by trace and sorted, and take their rounds in arrays of a task, some batches of rows at a
time; only larger ones take them as joins. Those rounds are written to the shared folder, so a lost executor costs one round. A parent with most of all spans is looked up without
meeting them in one task: parents with more than HOT children are fewer than spans / HOT, and those, counted first, go to every
task instead.

Repeated spans of a trace and id count once, the earliest first. Spans of null trace or id are no part of a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import on_workers, stored

#: Children beyond which a parent goes to every task, and how many such parents may.
HOT, MOST = 100_000, 1_000_000
#: Spans of a trace that one task resolves.
LOCAL = 100_000
_FOUND = ("trace", "id", "parent", "start", "end", "depth", "top", "kind")


def _looked_up(active: DataFrame, targets: DataFrame) -> DataFrame:
    """active (trace, ptr, ...) left-joined with targets (trace, id, ...) by ptr = id, hot targets broadcast."""
    hot = active.groupBy("trace", "ptr").agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT).select("trace", "ptr")
    found = targets.withColumnRenamed("id", "ptr")
    hot = stored(found.join(hot, ["trace", "ptr"], "left_semi"))
    if 0 < hot.count() <= MOST:
        rest = active.join(F.broadcast(hot.select("trace", "ptr")), ["trace", "ptr"], "left_anti")
        return active.join(F.broadcast(hot), ["trace", "ptr"]).unionByName(rest.join(found, ["trace", "ptr"], "left"), allowMissingColumns=True)
    return active.join(found, ["trace", "ptr"], "left")


def _pointed(spans: pa.Table) -> pa.Table:
    """spans (trace, id, parent and others), of whole traces, with depth, top and kind; a trace has an id once."""
    n = spans.num_rows
    number = lambda *columns: pa.chunked_array([c for x in columns for c in x.chunks], columns[0].type).combine_chunks().dictionary_encode().indices
    trace = number(spans["trace"]).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = number(spans["id"], spans["parent"].cast(spans["id"].type))
    none = np.asarray(ids.is_null())[n:]
    ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    key, wanted = trace * (2 * n + 1) + ids[:n], trace * (2 * n + 1) + ids[n:]
    order = np.argsort(key)
    at = order[np.minimum(np.searchsorted(key, wanted, sorter=order), n - 1)]
    last = none | (key[at] != wanted)
    to, depth = np.where(last, np.arange(n), at), np.where(last, 0, 1)
    way, ways = int((~last[to]).sum()), n + 1
    while way and way < ways:
        to, depth, ways = to[to], depth + depth[to], way
        way = int((~last[to]).sum())
    circle = ~last[to]
    kind = pa.array(np.where(circle, "cycle", np.where(none[to], "tree", "orphan")), pa.string())
    top = spans["id"].combine_chunks().take(pa.array(np.where(circle, 0, to), mask=circle))
    return spans.append_column("depth", pa.array(depth, pa.int64(), mask=circle)).append_column("top", top).append_column("kind", kind)


def _by_trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_pointed of spans sorted by trace; those of a batch's last trace wait for the next batch."""
    wait: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = b.column("trace")[b.num_rows - 1].as_py()
        if wait and b.column("trace")[0].as_py() == last == wait[-1].column("trace")[wait[-1].num_rows - 1].as_py():
            wait.append(b)
            continue
        began = int(np.argmax(np.asarray(pa.compute.equal(b.column("trace"), last))))
        if wait or began:
            whole = pa.Table.from_batches([*wait, b.slice(0, began)])
            yield from _pointed(whole).combine_chunks().to_batches()
        wait = [b.slice(began)]
    if wait:
        yield from _pointed(pa.Table.from_batches(wait)).combine_chunks().to_batches()


def resolve(spans: DataFrame, local: int = LOCAL) -> DataFrame:
    """trace, id, parent, depth (steps to the top), top (the last span that is there) and kind (tree, orphan: the top's parent isn't there, cycle: there is no top) of spans (trace, id, parent, start, end)."""
    given = spans.filter("trace IS NOT NULL AND id IS NOT NULL").withColumn("parent", F.expr("nullif(parent, '')"))
    one = stored(given.groupBy("trace", "id").agg(F.min(F.struct("start", "end", "parent")).alias("s")).select("trace", "id", "s.parent", "s.start", "s.end"))
    large = stored(one.groupBy("trace").agg(F.count("*").alias("_n")).filter(F.col("_n") > local).select("trace"))
    if not large.take(1):
        return _in_tasks(one)
    return _in_tasks(one.join(large, "trace", "left_anti")).unionByName(_in_rounds(stored(one.join(large, "trace", "left_semi"))))


def _in_tasks(one: DataFrame) -> DataFrame:
    """resolve of traces that a task can hold."""
    on_workers(one.sparkSession)
    schema = {f.name: f.dataType.simpleString() for f in one.schema} | {"depth": "bigint", "top": one.schema["id"].dataType.simpleString(), "kind": "string"}
    dealt = one.select("trace", "id", "parent", "start", "end").repartition("trace").sortWithinPartitions("trace")
    return dealt.mapInArrow(_by_trace, ", ".join(f"`{c}` {schema[c]}" for c in _FOUND))


def _in_rounds(one: DataFrame) -> DataFrame:
    """resolve of traces of any size, each span of which is there once."""
    # the pointer's target, how far it is, and whether it is the last span of its line
    first = _looked_up(one.filter("parent IS NOT NULL").select("trace", "id", F.col("parent").alias("ptr")), one.select("trace", "id", F.lit(True).alias("there")))
    lines = first.select("trace", "id", F.when(F.col("there"), F.col("ptr")).otherwise(F.col("id")).alias("ptr"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"), F.when(F.col("there").isNull(), "orphan").alias("kind"))
    roots = one.filter("parent IS NULL").select("trace", "id", F.col("id").alias("ptr"), F.lit(0).cast("long").alias("depth"), F.lit("tree").alias("kind"))
    state = stored(lines.unionByName(roots))
    active, settled, more = state.filter("kind IS NULL"), state.filter("kind IS NOT NULL"), True
    while more and active.take(1):
        targets = settled.unionByName(active).select("trace", "id", F.col("ptr").alias("ptr2"), F.col("depth").alias("depth2"), F.col("kind").alias("kind2"))
        moved = stored(_looked_up(active, targets).select("trace", "id", F.col("ptr2").alias("ptr"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("kind2").alias("kind")))
        settled, active, more = settled.unionByName(moved.filter("kind IS NOT NULL")), moved.filter("kind IS NULL"), bool(moved.filter("kind IS NOT NULL").take(1))
    circles = active.select("trace", "id", F.lit(None).cast(one.schema["id"].dataType).alias("ptr"), F.lit(None).cast("long").alias("depth"), F.lit("cycle").alias("kind"))
    found = settled.unionByName(circles).withColumnRenamed("ptr", "top")
    return one.join(found, ["trace", "id"]).select(*_FOUND)


def critical_paths(resolved: DataFrame) -> DataFrame:
    """trace, top, spans, deepest, and the path by which the tree's last span was reached: last (the span that ends last, ties to the greatest id), steps from the top to it, and microseconds that passed from the top's start to its end. Cycles have none."""
    trees = resolved.filter("kind <> 'cycle'")
    last = trees.groupBy("trace", "top").agg(F.count("*").alias("spans"), F.max("depth").alias("deepest"), F.max(F.struct("end", "id", "depth")).alias("l"), F.min(F.when(F.col("id") == F.col("top"), F.col("start"))).alias("began"))
    return last.select("trace", "top", "spans", "deepest", F.col("l.id").alias("last"), F.col("l.depth").alias("steps"), (F.col("l.end") - F.col("began")).alias("passed"))
