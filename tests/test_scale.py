"""What grows with the input must stay within a task, a batch or a payload."""

import datetime
import json
import time

import pyarrow as pa

from tideline.plans import catalogue, stateful
from tideline.sources import payloads, wire
from tideline.sources.sinks import write_batch
from tideline.streaming.traces import complete_traces, packed, unpacked


def spent(run):
    times = []
    for _ in range(5):
        began = time.process_time()
        run()
        times.append(time.process_time() - began)
    return min(times)


def test_the_codec_takes_a_few_times_what_reading_json_takes():
    attribute = {"key": "k", "value": {"doubleValue": 1.5}}
    span = {"traceId": "0a" * 16, "spanId": "0b" * 8, "name": "n", "kind": 3, "startTimeUnixNano": "1700000000000000000", "status": {"code": 1}, "attributes": [attribute] * 3}
    request = {"resourceSpans": [{"scopeSpans": [{"spans": [span] * 1000}]}]}
    raw, text = wire.encode("traces", request), json.dumps(request)
    assert wire.decode("traces", raw) == request
    reading = spent(lambda: json.loads(text))
    assert spent(lambda: wire.decode("traces", raw)) < 8 * reading and spent(lambda: wire.encode("traces", request)) < 8 * reading


def test_bodies_are_worked_on_in_slices_of_few_bytes():
    b = pa.RecordBatch.from_pydict({"body": pa.array([b"x" * 10_000] * 900 + [None, b""], pa.binary()), "n": pa.array(range(902))})
    slices = list(payloads.in_slices([b, b.slice(0, 0)], 1 << 20))
    assert len(slices) > 5 and max(s.nbytes for s in slices) < 2 << 20
    assert [n for s in slices for n in s.column("n").to_pylist()] == list(range(902))


def test_wide_bodies_are_read_a_few_at_a_time(spark, tmp_path):
    spark.range(1000).selectExpr("'logs' AS signal", "concat('{\"n\":', id, '}') AS body").coalesce(1).write.parquet(str(tmp_path / "landed"))
    parsed = payloads.parse(spark.read.parquet(str(tmp_path / "landed")))
    assert parsed.selectExpr("to_json(payload) AS line").distinct().count() == 1000
    lines = parsed.selectExpr("to_json(payload) AS line")
    assert len(lines.collect()) == 1000

    def batches(plan):
        children = plan.children()
        own = plan.metrics().get("numInputBatches")
        return (own.get().value() if own.isDefined() else 0) + sum(batches(children.apply(i)) for i in range(children.size()))

    assert batches(lines._jdf.queryExecution().executedPlan()) >= 10


def test_traces_are_kept_by_buckets(spark, tmp_path):
    schema = "traceId string, received_at timestamp, roots long, spans long, errors long, start long, end long"
    at = lambda s: datetime.datetime(2024, 5, 1, tzinfo=datetime.UTC) + datetime.timedelta(seconds=s)
    rows = [(f"t{i}", at(i % 7), int(i % 2), 1, 0, None if i % 5 == 0 else 2**50 + i, 2**51 + i) for i in range(300)]
    for k, part in enumerate((rows, [("z", at(9_000), 1, 1, 0, 1, 2)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = complete_traces(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 60_000, 6_000, "10 minutes", buckets=8)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        if not k:
            assert query.recentProgress[0].stateOperators[0]["numRowsTotal"] == 8
    got = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    assert got == sorted((t, "whole" if root else "overdue", 1, 0, int(a.timestamp()) * 10**6, s, e) for t, a, root, _, _, s, e in rows)


def test_state_of_traces_is_small_and_comes_back_as_it_was():
    day = 1_700_000_000_000_000
    held = {f"{i:032x}": [(day + i % 997 * 10**6, j % 2, 1, 0, None if j else day - i, day + i + j) for j in range(4)] for i in range(2000)}
    back = {}
    for trace, part in unpacked(packed(held)):
        back.setdefault(trace, []).append(part)
    assert back == held and len(packed(held)) < len(json.dumps(held)) / 5


def test_landed_slices_are_written_by_every_task_and_payloads_are_bounded(spark, tmp_path):
    df = spark.range(4000).repartition(4).selectExpr("CAST(id % 2 AS INT) AS slice", "CAST(id AS STRING) AS value")
    stateful._land(stateful._sliced(df, str(tmp_path / "slices")), str(tmp_path / "in"), 1, "text")
    assert len(list((tmp_path / "in").glob("part-*"))) > 1 and spark.read.text(str(tmp_path / "in")).count() == 2000


def test_sinks_may_be_compressed_and_keep_nothing_beside_them(spark, tmp_path):
    log = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"severityText": "x" * 1000}] * 50}]}]}
    df = payloads.parse(spark.createDataFrame([("logs", datetime.datetime(2024, 5, 1), json.dumps(log))] * 4, "signal string, received_at timestamp, body string"))
    persisted = []
    held, frame = type(df).persist, type(df)
    frame.persist = lambda self, *a: persisted.append(1) or held(self, *a)
    try:
        write_batch(df, str(tmp_path), True, 0, held=True, compression="gzip")
    finally:
        frame.persist = held
    files = [f for f in tmp_path.rglob("part-*") if f.is_file()]
    assert not persisted and files and all(f.name.endswith(".gz") for f in files) and sum(f.stat().st_size for f in files) < 50_000
    lines = lambda sink: sorted(r.value for r in spark.read.text(str(tmp_path / sink)).collect())
    assert lines("services") == lines("logs-by-service") and len(lines("services")) == 200 and len(lines("raw")) == 4


def test_bodies_made_of_short_texts_leave_python_in_slices(spark, tmp_path):
    spark.range(6000).selectExpr("id AS event_id", "TIMESTAMP '2024-05-01' AS ts", "id AS user_id", "'view' AS event_type", "1.5D AS value", "'{}' AS props").write.parquet(str(tmp_path / "events.parquet"))
    landed = catalogue._landed_logs(spark, str(tmp_path))
    assert landed.filter("length(body) > 50000").count() >= 12 and landed.filter("contentType = 'application/x-protobuf'").count() > 0
    assert "ArrowEvalPython" not in landed._jdf.queryExecution().executedPlan().toString()


def test_texts_without_odd_numbers_are_finished_fast_and_alike():
    attribute = {"key": "k", "value": {"arrayValue": {"values": [{"arrayValue": {"values": [{"intValue": "1"}, {"doubleValue": 1.5}]}}] * 3}}}
    plain = json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": {"doubleValue": 0.1}, "attributes": [attribute] * 5, "n\u00e9": "\u00e9\ud83d"}] * 200}]}]})
    slow = lambda: payloads._text(payloads._finished(json.loads(plain, parse_float=payloads._Float)))
    assert payloads._finished_text(plain) == slow() and '["1",1.50]' in payloads._finished_text(plain.replace("1.5", "1.50"))
    assert spent(lambda: payloads._finished_text(plain)) < 0.8 * spent(slow)


def test_messages_of_one_field_are_written_without_a_walk_over_all_fields():
    fields = wire._writers("AnyValue", True)
    for value in ({"stringValue": "x" * 200}, {"boolValue": False}, {"doubleValue": 1.5}, {"arrayValue": {"values": []}}, {"other": 1}, {}):
        assert wire._joined(fields, value) == wire._joined(fields, value | {"no": 1, "field": 2})
    assert wire.encode("Buckets", {"bucketCounts": ["1", "2"]}, True) == b"\x12\x02\x01\x02" and wire.encode("Buckets", {"bucketCounts": ["1", "2"]}) == b"\x10\x01\x10\x02"
