import datetime
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import trees
from tideline.operators.asof import as_of
from tideline.operators.intervals import covering, widths
from tideline.streaming.retries import without_retries
from tideline.streaming.stream import LANDED, REJECTED, drain, ingest_stream
from tideline.streaming.traces import complete_traces, rounds
from tideline.streaming.windows import CLOSED, MEASURES, read_open, read_windows, window_stream

BEGAN = datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC)


def at(minutes):
    return BEGAN + datetime.timedelta(minutes=minutes)


def land(spark, path, schema, *files):
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_repeats_go_state_is_bounded_and_a_restart_changes_nothing(spark, tmp_path):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    send = lambda n, t, **other: tuple({"signal": "logs", "contentType": "j", "contentEncoding": None, "received_at": at(t), "body": f"body {n}".encode(), **other}.values())
    files = [[send(10 * k + i, 60 * k) for i in range(10)] * (40 if k == 1 else 1) + [send(10 * k, 60 * k + 5), send(10 * k, 60 * k, signal="traces"), send(10 * k, 60 * k, body=None)] for k in range(6)]
    files[5] += [send(3, 300), send(4, 300)]
    progress = []
    for part in (files[:3], files[3:]):
        land(spark, landing, LANDED, *part)
        stream = without_retries(spark.readStream.schema(LANDED).option("maxFilesPerTrigger", 1).parquet(landing))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        progress += query.recentProgress
    kept = spark.read.schema(LANDED).parquet(out)
    assert kept.filter("signal = 'logs' AND body IS NOT NULL").count() == 62 and kept.filter("signal = 'traces'").count() == 6 and kept.filter("body IS NULL").count() == 6
    assert kept.columns == [c.split()[0] for c in LANDED.split(", ")]
    assert kept.filter(F.col("body") == b"body 3").count() == 2
    held = [max(o["numRowsTotal"] for o in p.stateOperators) for p in progress if p.stateOperators]
    assert max(held) < 60 and sum(o["numRowsDroppedByWatermark"] for p in progress for o in p.stateOperators) == 0


ROWS = MEASURES + ", note string"


def spans(*given):
    return [(s, None if t is None else at(t), e, 1000, "n") for s, t, e in given]


def test_windows_close_late_rows_are_kept_and_a_failed_batch_counts_once(spark, tmp_path, monkeypatch):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, landing, ROWS, spans(("a", 1, False), ("a", 59, True), ("b", 30, False), ("a", None, True)), spans(("a", 125, False), ("a", 65, False)), spans(("a", 3, True), ("b", 100, False), ("a", 130, False)))
    stream = lambda: window_stream(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(landing), out, str(tmp_path / "state"), width="1 hour", gap="30 minutes", delay="10 minutes")
    # the second batch fails behind its output
    frame = type(spark.range(1))
    whole, calls = frame.coalesce, []

    def fails_once(self, n):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return whole(self, n)

    monkeypatch.setattr(frame, "coalesce", fails_once)
    with pytest.raises(Exception, match="lost"):
        stream().awaitTermination()
    monkeypatch.setattr(frame, "coalesce", whole)
    query = stream()
    query.awaitTermination()
    minute = lambda us: round((us / 1e6 - BEGAN.timestamp()) / 60)
    got = lambda df: sorted((r.kind, r.service, minute(r.start), minute(r.end), r.n, r.errors, r.us) for r in df.collect())
    assert got(read_windows(spark, out)) == [
        ("session", "a", 1, 31, 1, 0, 1000), ("session", "a", 59, 95, 2, 1, 2000), ("session", "b", 30, 60, 1, 0, 1000),
        ("tumbling", "a", 0, 60, 2, 1, 2000), ("tumbling", "a", 60, 120, 1, 0, 1000), ("tumbling", "b", 0, 60, 1, 0, 1000), ("tumbling", "b", 60, 120, 1, 0, 1000),
    ]
    assert got(read_open(spark, out, query)) == [("session", "a", 125, 160, 2, 0, 2000), ("tumbling", "a", 120, 180, 2, 0, 2000)]
    late = spark.read.schema(f"{ROWS}, late_for string, batch string").parquet(f"{out}/late")
    assert sorted((r.service, r.late_for, r.note) for r in late.collect()) == [("a", "no time", "n"), ("a", "session", "n"), ("a", "tumbling", "n"), ("b", "session", "n")]
    assert spark.read.schema(CLOSED).parquet(f"{out}/windows").count() == 7


PARTS = "traceId string, received_at timestamp, roots long, spans long, errors long, start long, end long"


def test_traces_are_whole_or_overdue_whatever_the_order(spark, tmp_path):
    rng = random.Random(3)
    span = lambda trace, t, root=0, n=1: (trace, at(t), root, n, 0, None if trace == "c" else 5, 9 + root)
    first = [span("a", 0.1), span("a", 0.2, 1), span("a", 0.25), span("b", 0.1), span("b", 0.9), span("c", 0.1, 1)] + [span("hot", 0.3)] * 5000
    second = [span("a", 0.15), span("b", 5, 1), span("a", 9)]
    rng.shuffle(first)
    results = []
    for files in ([first, second], [second + first]):
        root = tmp_path / str(len(results))
        schema = PARTS
        for part in (files, [[span("z", 60)], [span("y", 120)]]):
            land(spark, str(root / "in"), schema, *part)
            stream = complete_traces(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(root / "in")), 60_000, 6_000, "10 minutes")
            drain(stream.writeStream.format("parquet").option("path", str(root / "out")).option("checkpointLocation", str(root / "state")))
        results.append(sorted((r.traceId, r.verdict, r.spans, r.start, r.end) for r in spark.read.schema(stream.schema).parquet(str(root / "out")).collect()))
    assert results[0] == results[1] == [("a", "overdue", 1, 5, 9), ("a", "whole", 4, 5, 10), ("b", "overdue", 2, 5, 9), ("b", "whole", 1, 5, 10), ("c", "whole", 1, None, 10), ("hot", "overdue", 5000, 5, 9), ("z", "overdue", 1, 5, 9)]


def test_rounds_end_by_wait_or_behind_their_root():
    part = lambda t, root=0: (t, root, 1, 0, None, None)
    got = [(end, [p[0] for p in of]) for end, of in rounds([part(0), part(50, 1), part(55), part(61), part(99), part(170)], 100, 10)]
    assert got == [(60, [0, 50, 55]), (161, [61, 99]), (270, [170])]


def test_interval_join_equals_brute_force_without_nested_loops(spark):
    rng = random.Random(4)
    points = [(rng.choice(["a", "b", None]), None if rng.random() < 0.05 else rng.randint(-5000, 5000), i) for i in range(400)]
    lengths = [0, -3, 1, 7, 8, 9, 64, 500, 4095, 4096, 10**15]
    intervals = [(rng.choice(["a", "b", None]), s := rng.randint(-5000, 5000), s + rng.choice(lengths), i) for i in range(150)] + [("a", None, 5, 900), ("a", 5, None, 901)]
    p, i = spark.createDataFrame(points, "k string, t long, p int"), spark.createDataFrame(intervals, "k string, a long, b long, i int")
    found = covering(p, i, "k", "t", "a", "b")
    want = sorted((x, y) for k, t, x in points for j, a, b, y in intervals if k is not None and k == j and None not in (t, a, b) and a <= t < b)
    assert sorted((r.p, r.i) for r in found.collect()) == want and found.columns == ["k", "t", "p", "a", "b", "i"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # an interval takes two buckets at most, a point one of each width
    leveled, levels = widths(i, "a", "b")
    assert len(levels) <= len(lengths)
    sizes = leveled.select(F.expr("shiftright(b - 1, 3 * _level) - shiftright(a, 3 * _level) + 1").alias("n")).collect()
    assert max(r.n for r in sizes) <= 2
    assert covering(p.limit(0), i, "k", "t", "a", "b").count() == covering(p, i.limit(0), "k", "t", "a", "b").count() == 0


def test_as_of_equals_brute_force_and_spreads_a_busy_key(spark):
    rng = random.Random(9)
    points = [(rng.choice(["hot"] * 6 + ["b", "none", None]), rng.choice([None, *range(200)]), i) for i in range(600)] + [("hot", 50, 1000)] * 40
    values = [(rng.choice(["hot", "hot", "b", "only", None]), rng.choice([None, *range(20, 220)]), rng.randint(0, 9)) for _ in range(300)]
    p, v = spark.createDataFrame(points, "k string, t long, n int"), spark.createDataFrame(values, "k string, t long, value int")
    settings = {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        got = as_of(p, v, "k", "t")
        rows = sorted(map(repr, map(tuple, got.collect())))
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)

    def last(k, t):
        known = [(u, x) for j, u, x in values if j == k and None not in (k, t, u) and u <= t]
        return max(known)[1] if known else None

    assert rows == sorted(repr((k, t, n, last(k, t))) for k, t, n in points) and got.columns == ["k", "t", "n", "value"]
    assert as_of(p, v.limit(0), "k", "t").filter("value IS NULL").count() == 640 and as_of(p.limit(0), v, "k", "t").count() == 0


def test_a_busy_key_lies_in_many_ranges(spark):
    p = spark.range(50_000).select(F.lit("k").alias("k"), F.lit(7).cast("long").alias("t"), "id")
    v = spark.createDataFrame([("k", 3, "x"), ("k", 7, "y"), ("k", 9, "z")], "k string, t long, value string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = as_of(p, v, "k", "t")
        assert order.groupBy("value").count().collect() == [("y", 50_000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trees_of_long_chains_hot_parents_and_circles(spark, monkeypatch):
    monkeypatch.setattr(trees, "HOT", 100)
    spans = [("chain", f"{i:05}", f"{i - 1:05}" if i else None) for i in range(10_000)] + [("star", f"s{i}", "s0" if i else "") for i in range(500)]
    spans += [("loop", "a", "c"), ("loop", "b", "a"), ("loop", "c", "b"), ("loop", "tail", "a"), ("self", "x", "x"), ("lost", "p", "gone"), ("lost", "q", "p"), ("lost", "q", "p"), ("lost", None, "p"), (None, "z", None)]
    df = spark.createDataFrame([(t, i, p, 10 * k, 10 * k + 5) for k, (t, i, p) in enumerate(spans)], "trace string, id string, parent string, start long, end long")
    found = trees.resolve(df).cache()
    by = {(r.trace, r.id): (r.depth, r.top, r.kind) for r in found.collect()}
    assert all(by["chain", f"{i:05}"] == (i, "00000", "tree") for i in range(10_000)) and all(by["star", f"s{i}"] == (min(i, 1), "s0", "tree") for i in range(500))
    assert {k: v for k, v in by.items() if k[0] not in ("chain", "star")} == {**{("loop", x): (None, None, "cycle") for x in ("a", "b", "c", "tail")}, ("self", "x"): (None, None, "cycle"), ("lost", "p"): (0, "p", "orphan"), ("lost", "q"): (1, "p", "orphan")}
    paths = {(r.trace, r.top): (r.spans, r.deepest, r.last, r.steps, r.passed) for r in trees.critical_paths(found).collect()}
    assert paths["chain", "00000"] == (10_000, 9999, "09999", 9999, 99_995) and paths["star", "s0"] == (500, 1, "s499", 1, 4995) and len(paths) == 3
    assert trees.resolve(df.limit(0)).count() == 0


def test_the_ingest_stream_drops_repeats_if_asked(spark, tmp_path):
    log = b'{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"severityText":"once"}]}]}]}'
    send = lambda t, body=log: ("logs", "application/json", None, at(t), body)
    land(spark, str(tmp_path / "in"), LANDED, [send(0), send(1), send(2), send(30), send(0, b"["), send(1, b"[")], [send(31), send(60)])
    for name, retries, n, bad in (("all", None, 6, 2), ("once", 600_000, 3, 1)):
        out = str(tmp_path / name)
        ingest_stream(spark, str(tmp_path / "in"), out, f"{out}-state", files=1, retries_ms=retries).awaitTermination()
        assert spark.read.text(f"{out}/services").count() == n and spark.read.schema(REJECTED).parquet(f"{out}/rejected").count() == bad


def test_points_of_an_as_of_join_are_computed_once(spark):
    from pyspark.sql import functions as F

    from tideline.operators.asof import as_of

    seen = spark.sparkContext.accumulator(0)

    def count(n):
        seen.add(1)
        return n

    points = spark.range(50).select(F.when(F.col("id") % 10 > 0, "k").alias("key"), "id", F.udf(count, "long")("id").alias("at"))
    values = spark.createDataFrame([("k", 7, 1.0), ("k", 30, 2.0)], "key string, at long, value double")
    got = {r["id"]: r["value"] for r in as_of(points, values, "key", "at").collect()}
    assert got == {i: None if i % 10 == 0 or i < 7 else 1.0 if i < 30 else 2.0 for i in range(50)}
    assert seen.value == 50


def test_pairs_of_one_key_and_of_long_intervals_are_made_by_many_tasks(spark):
    points = spark.range(200_000).selectExpr("'k' AS k", "id * 7 AS t", "id AS p")
    intervals = spark.range(40).selectExpr("'k' AS k", "id AS a", "id + 31536000000000 AS b", "id AS i")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = covering(points, intervals, "k", "t", "a", "b")
        made = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(made) == sum(200_000 - -(-i // 7) for i in range(40)) and len(made) == 4 and max(made) < sum(made) // 2


def test_a_block_that_makes_too_many_pairs_is_copied_and_no_pair_is_lost_or_doubled(spark, monkeypatch):
    from tideline.operators import intervals as module

    for name, value in (("BLOCK", 8), ("SHARE", 100), ("LEAST", 50), ("MOST", 400)):
        monkeypatch.setattr(module, name, value)
    rng = random.Random(5)
    # many points of one time, and ends on it
    points = [(rng.choice("ab"), rng.choice([50, 50, rng.randint(0, 99)]), i, rng.choice([None, {"m": str(i)}])) for i in range(120)]
    intervals = [("a", s := rng.choice([0, 49, 50, 51, rng.randint(0, 99)]), s + rng.choice([1, 2, 50, 10**15]), None if i % 7 == 0 else f"i{i}") for i in range(90)]
    p, i = spark.createDataFrame(points, "k string, t int, p int, m map<string, string>"), spark.createDataFrame(intervals, "k string, a long, b long, i string")
    found = covering(p, i, "k", "t", "a", "b")
    assert found.dtypes == [("k", "string"), ("t", "int"), ("p", "int"), ("m", "map<string,string>"), ("a", "bigint"), ("b", "bigint"), ("i", "string")]
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    want = sorted(repr((k, t, x, m, a, b, y)) for k, t, x, m in points for j, a, b, y in intervals if k == j and a <= t < b)
    assert sorted(repr(tuple(r)[:-1]) for r in rows) == want and len({r.task for r in rows}) > 4


def test_trees_of_small_traces_take_one_pass_and_circles_end_the_rounds_of_large_ones(spark, monkeypatch):
    monkeypatch.setattr(trees, "HOT", 10)
    rng = random.Random(6)
    spans = [(f"t{t:02}", f"{i:03}", rng.choice([None, "", "gone", *[f"{rng.randint(0, n - 1):03}"] * 12])) for t in range(40) for n in [rng.choice([1, 2, 5, 60])] for i in range(n)]
    spans += [("ring", f"{i:03}", f"{(i + 1) % 300:03}") for i in range(300)] + [("line", f"{i:03}", f"{i + 1:03}" if i < 9 else None) for i in range(10)]

    def walked(trace, i, up):
        depth, seen = 0, {i}
        while up.get((trace, i)) and (trace, up[trace, i]) in up:
            depth, i = depth + 1, up[trace, i]
            if i in seen:
                return None, None, "cycle"
            seen.add(i)
        return depth, i, "orphan" if up[trace, i] else "tree"

    up = {(t, i): p for t, i, p in spans}
    want = sorted((repr(k), walked(*k, up)) for k in up)
    df = spark.createDataFrame([(*s, k, k + 5) for k, s in enumerate(spans)], "trace string, id string, parent string, start long, end long")
    writes = []
    stored = trees.stored
    monkeypatch.setattr(trees, "stored", lambda df: writes.append(1) or stored(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for local, most in ((1000, 2), (20, 20), (0, 20)):
            writes.clear()
            found = trees.resolve(df, local)
            assert found.columns == ["trace", "id", "parent", "start", "end", "depth", "top", "kind"]
            rows = found.collect()
            assert sorted((repr((r.trace, r.id)), (r.depth, r.top, r.kind)) for r in rows) == want and {(r.trace, r.id, r.parent, r.end - r.start) for r in rows} == {(t, i, p or None, 5) for t, i, p in spans}
            assert len(writes) <= most
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
