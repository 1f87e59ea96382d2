import datetime
import gzip
import io
import http.client
import json
import os
import signal
import subprocess
import sys
import threading
import time
import zlib

import pytest
from pyspark.sql import functions as F

from tideline.config import Options, options, resolve_options
from tideline.engine import Engine
from tideline.functions import timefn
from tideline.operators.routing import classify_request, service_dir
from tideline.sources import payloads, wire
from tideline.sources.http import Front, Landing, read_body
from tideline.sources.sinks import write_batch
from tideline.streaming.stream import REJECTED, drain, flatten_stream, ingest_stream, rejected_stream

LOG = {"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": ".."}}]}, "scopeLogs": [{"logRecords": [{"body": {"stringValue": "x"}}]}]}]}


def test_service_folders(spark):
    names = {"a/b": "a_b", "a\\b": "a_b", ".": "_dot", "..": "_dotdot", "": "_unknown", " \t ": "_unknown", " svc ": "svc", "...": "..."}
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", service_dir(F.col("n")).alias("d"))
    assert {r.n: r.d for r in df.collect()} == names


@pytest.mark.parametrize(("raw", "iso"), [
    ('"not-a-number"', None), ('"999999999999999999999999999999999999"', None), ('""', "1970-01-01T00:00:00.000Z"), ('"-1"', "1970-01-01T00:00:00.000Z"), ("1.5", None), ("1500000", "1970-01-01T00:00:00.001Z"),
    ('"1e3"', None), ('" 1000000 "', "1970-01-01T00:00:00.001Z"), ('"253402300800000000000"', "+010000-01-01T00:00:00.000Z"), ('"-62198755200000000000"', "-000001-01-01T00:00:00.000Z"), ("null", None), ("true", None), ('"8640000000001000000000"', None),
])
def test_timestamps(spark, raw, iso):
    assert spark.createDataFrame([(raw,)], "raw string").select(F.parse_json("raw").alias("v")).selectExpr(timefn.iso("v")).first()[0] == iso


def test_requests(spark):
    cases = [("GET", "/v1/logs", "application/json", None, 405, 12), ("POST", "/v1/x", "application/json", None, 404, 5), ("POST", "/v1/logs", None, None, 415, 3), ("POST", "/v1/logs", "text/plain", None, 415, 3), ("POST", "/v1/logs", "application/json", "br", 415, 3), ("POST", "/v1/logs?a=1", "Application/JSON; charset=utf-8", "GZIP", 200, None)]
    df = spark.createDataFrame(cases, "m string, p string, t string, e string, status int, code int")
    got = df.select("status", "code", classify_request(F.col("m"), F.col("p"), F.col("t"), F.col("e")).alias("r")).collect()
    assert all((r.status, r.code) == (r.r.status, r.r.code) for r in got) and got[-1].r.signal == "logs"


def test_bodies(spark):
    raw = json.dumps(LOG).encode()
    pb = wire.encode("logs", LOG)
    cases = [("application/json", None, raw), ("application/json", "gzip", gzip.compress(raw)), ("application/json", "deflate", zlib.compress(raw)), ("application/x-protobuf", "gzip", gzip.compress(pb)), ("application/x-protobuf", None, b""), ("application/json", None, b""), ("application/json", "gzip", b"xx"), ("application/x-protobuf", None, b"\x0a\x05\x08"), ("application/json", "br", raw), ("application/json", None, b"[")]
    df = payloads.parse(payloads.decode_bodies(spark.createDataFrame([(i, "logs", *c) for i, c in enumerate(cases)], "i int, signal string, contentType string, contentEncoding string, body binary")))
    got = {r.i: r for r in df.select("i", "error", F.to_json("payload").alias("p")).collect()}
    assert [json.loads(got[i].p) for i in range(6)] == [LOG] * 4 + [{}, {}]
    assert got[6].error and got[7].error == "Invalid protobuf" and got[8].error == "Unsupported Content-Encoding: br" and got[9].p is None


def batch(spark, *values):
    at = datetime.datetime(2024, 5, 1, 23, 59)
    df = spark.createDataFrame([("logs", at, json.dumps(v)) for v in values], "signal string, received_at timestamp, body string")
    return payloads.parse(df)


def test_sinks_and_repeated_batches(spark, tmp_path):
    out = str(tmp_path)
    for _ in range(2):
        write_batch(batch(spark, LOG, {"n": 1}), out, True, 0)
    raw = spark.read.option("basePath", f"{out}/raw").text(f"{out}/raw").collect()
    assert sorted((json.loads(r.value), r.signal, str(r.ingest_date)) for r in raw if "n" in r.value and "resource" not in r.value) == [({"n": 1}, "logs", "2024-05-01")] and len(raw) == 2
    rows = spark.read.text(f"{out}/services").collect()
    assert [(json.loads(r.value)["serviceName"], r.service_dir, r.signal) for r in rows] == [("..", "_dotdot", "logs")]
    assert spark.read.text(f"{out}/logs-by-service").count() == 1


def test_http_to_tables(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    front = Front(landing, 0, "127.0.0.1").start()

    def send(method, path, body=b"", **head):
        c = http.client.HTTPConnection("127.0.0.1", front.port)
        c.request(method, path, body, {k.replace("_", "-"): v for k, v in head.items()})
        r = c.getresponse()
        return r.status, r.read(), r.getheader("Content-Type")

    js, pb = {"Content_Type": "application/json; charset=utf-8"}, {"Content_Type": "application/x-protobuf"}
    raw = json.dumps(LOG).encode()
    try:
        assert send("GET", "/v1/logs")[0] == 405 and send("POST", "/x", raw, **js)[0] == 404 and send("POST", "/v1/logs", raw)[0] == 415
        assert send("POST", "/v1/logs", raw, Content_Encoding="br", **js)[0] == 415 and send("POST", "/v1/logs", b"{", **js)[0] == 400
        assert json.loads(send("POST", "/v1/logs", b"zz", Content_Encoding="gzip", **js)[1])["code"] == 3
        assert json.loads(send("POST", "/v1/logs", b"\xff\xff\xff", **pb)[1]) == {"code": 3, "message": "Invalid protobuf"}
        assert json.loads(send("POST", "/v1/traces", b"{}", **js)[1]) == {"partialSuccess": {"rejectedSpans": 0}}
        assert json.loads(send("POST", "/v1/logs", gzip.compress(raw), Content_Encoding="gzip", **js)[1]) == {"partialSuccess": {"rejectedLogRecords": 0}}
        assert send("POST", "/v1/logs", wire.encode("logs", LOG), **pb) == (200, b"", "application/x-protobuf")
    finally:
        front.stop()
        front.stop()
    assert 1 <= len(os.listdir(landing)) <= 3
    ingest_stream(spark, landing, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.text(f"{out}/services").count() == 2
    ingest_stream(spark, landing, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.text(f"{out}/services").count() == 2


def test_options():
    env = {"TIDELINE_PORT": "9", "TIDELINE_OUTPUT_DIR": "e"}
    assert options([], {}) == Options(4318, "./otel-data") and options([], env) == Options(9, "e")
    assert options(["--port", "12x", "--output=o", "--other"], env) == Options(12, "o")
    assert resolve_options(["--port", "abc", "--port=", "--output"], {"TIDELINE_PORT": "x"}) == {}
    assert options(["--output="], env).output == "./otel-data"


def deep_log():
    value = {"intValue": "7"}
    for key in "cba":
        value = {"kvlistValue": {"values": [{"key": key, "value": value}]}}
    return {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"body": value, "attributes": [{"key": "k", "value": value}]}]}]}]}


def test_deep_values_through_the_engine(spark, tmp_path):
    out, raw, deep = str(tmp_path / "out"), json.dumps(deep_log()).encode(), {"a": {"b": {"c": "7"}}}
    engine = Engine(spark, 0, out, seconds=0.2).start()
    for kind, body in (("application/json", raw), ("application/x-protobuf", wire.encode("logs", deep_log()))):
        c = http.client.HTTPConnection("127.0.0.1", engine.front.port)
        c.request("POST", "/v1/logs", body, {"Content-Type": kind})
        assert c.getresponse().status == 200
    engine.stop()
    handed = str(tmp_path / "handed")
    Engine(spark, 0, handed).ingest(batch(spark, deep_log()))
    for folder, n in ((out, 2), (handed, 1)):
        for sink in ("services", "logs-by-service"):
            rows = [json.loads(r.value) for r in spark.read.text(f"{folder}/{sink}").collect()]
            assert [(r["body"], r["attributes"]) for r in rows] == [(deep, {"k": deep})] * n
        # raw output is the payload as it came
        assert [json.loads(r.value) for r in spark.read.text(f"{folder}/raw").collect()] == [deep_log()] * n


def test_unreadable_lines_come_out_of_their_own_stream(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    (tmp_path / "landing" / "a.txt").write_text("\n".join([json.dumps(LOG), "[", "", "{]", "{}"]) + "\n")
    for name, stream in (("read", flatten_stream), ("rejected", rejected_stream)):
        rows = stream(spark, str(tmp_path / "landing"))
        rows = rows.select(F.to_json("payload").alias("value")) if name == "read" else rows.select("value", "error")
        drain(rows.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "rejected")).collect()) == [("[", "Invalid JSON"), ("{]", "Invalid JSON")]
    assert spark.read.parquet(str(tmp_path / "read")).count() == 3


def test_framing_of_bodies():
    read = lambda raw, **head: read_body(io.BytesIO(raw), {k.replace("_", "-"): v for k, v in head.items()})
    assert read(b"5;x=1\r\nabcde\r\nA\r\n0123456789\r\n0\r\nT: 1\r\n\r\nrest", Transfer_Encoding="Chunked") == b"abcde0123456789"
    assert read(b"abc", Content_Length="2") == b"ab" and read(b"abc") == b""
    for raw, head in ((b"zz\r\n", {"Transfer_Encoding": "chunked"}), (b"5\r\nab", {"Transfer_Encoding": "chunked"}), (b"2\r\nabc\r\n0\r\n\r\n", {"Transfer_Encoding": "chunked"}), (b"ab", {"Content_Length": "3"}), (b"ab", {"Content_Length": "-1"}), (b"ab", {"Content_Length": "x"}), (b"", {"Transfer_Encoding": "gzip"})):
        with pytest.raises(Exception, match="Malformed request body|Unsupported Transfer-Encoding"):
            read(raw, **head)


def nested_json(levels):
    value = '{"stringValue":"x"}'
    for _ in range(levels):
        value = '{"arrayValue":{"values":[' + value + "]}}"
    return '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":' + value + "}]}]}]}"


def nested_wire(levels):
    def sized(tag, raw):
        return bytes([tag]) + wire.write_varint(len(raw)) + raw

    out = b"\x0a\x01x"
    for _ in range(levels):
        out = sized(0x2A, sized(0x0A, out))
    for tag in (0x2A, 0x12, 0x12, 0x0A):
        out = sized(tag, out)
    return out


def test_bodies_sent_in_chunks_or_too_deep_or_with_nan(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    front = Front(landing, 0, "127.0.0.1").start()
    try:
        def send(body, kind="application/json", connection=None, **head):
            c = connection or http.client.HTTPConnection("127.0.0.1", front.port, timeout=30)
            chunked = not isinstance(body, bytes)
            c.request("POST", "/v1/logs", body, {"Content-Type": kind, **({"Transfer-Encoding": "chunked"} if chunked else {}), **head}, encode_chunked=chunked)
            r = c.getresponse()
            return r.status, r.read()

        raw, pb = json.dumps(LOG).encode(), "application/x-protobuf"
        one = http.client.HTTPConnection("127.0.0.1", front.port, timeout=30)
        # the connection serves on after chunks and after a refusal
        assert send(iter([raw[:9], raw[9:40], raw[40:]]), connection=one)[0] == 200
        assert send(b"[", connection=one)[0] == 400
        assert send(iter([wire.encode("logs", LOG)]), pb, connection=one) == (200, b"")
        assert send(nested_json(300).encode())[0] == 200 and send(nested_wire(300), pb)[0] == 200
        for body, kind in ((nested_json(1500).encode(), "application/json"), (b"[" * 100_000, "application/json"), (b'{"a":NaN}', "application/json"), (b"[-Infinity]", "application/json"), (nested_wire(1500), pb)):
            status, answer = send(body, kind)
            assert status == 400 and json.loads(answer)["code"] == 3
        # requests that come in together are all landed before their answers
        many = [threading.Thread(target=lambda: send(raw)) for _ in range(20)]
        [t.start() for t in many]
        [t.join() for t in many]
    finally:
        front.stop()
    assert sum(spark.read.parquet(landing).groupBy().count().first()) == 24
    ingest_stream(spark, landing, out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.text(f"{out}/services").count() == 24 and spark.read.schema("error string").parquet(f"{out}/rejected").count() == 0
    bodies = [json.loads(r.value)["body"] for r in spark.read.text(f"{out}/services").collect()]
    depth = lambda x: 1 + depth(x[0]) if isinstance(x, list) else 0
    assert sorted(map(depth, bodies))[-2:] == [300, 300] and bodies.count("x") == 22


def test_poison_is_rejected_one_by_one_and_a_new_checkpoint_replaces_nothing(spark, tmp_path):
    out, schema = str(tmp_path / "out"), "signal string, contentType string, contentEncoding string, received_at timestamp, body binary"
    at, js, pb = datetime.datetime(2024, 5, 1), "application/json", "application/x-protobuf"
    bodies = [(js, json.dumps(LOG).encode()), (pb, nested_wire(1500)), (js, nested_json(1500).encode()), (pb, b"\xff\xff"), (js, b"{"), (pb, wire.encode("logs", LOG))]
    for day in ("a", "b"):
        rows = [("logs", kind, None, at, body) for kind, body in bodies] + [("other", pb, None, at, b"x")]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / day))
        ingest_stream(spark, str(tmp_path / day), out, str(tmp_path / f"state-{day}")).awaitTermination()
    assert spark.read.text(f"{out}/services").count() == 4 and spark.read.text(f"{out}/logs-by-service").count() == 4
    rejected = spark.read.schema(REJECTED).parquet(f"{out}/rejected")
    assert sorted(r.error for r in rejected.collect()) == ["Invalid JSON"] * 4 + ["Invalid protobuf"] * 6
    # whole as they landed, ready to land again
    assert sorted(bytes(r.body) for r in rejected.filter("signal = 'logs'").collect()) == sorted([b for _, b in bodies[1:5]] * 2)
    rejected.drop("error").coalesce(1).write.parquet(str(tmp_path / "again"))
    ingest_stream(spark, str(tmp_path / "again"), str(tmp_path / "out2"), str(tmp_path / "state-again")).awaitTermination()
    assert spark.read.schema(REJECTED).parquet(str(tmp_path / "out2" / "rejected")).count() == 10
    assert len(os.listdir(f"{out}/services")) == 2 + sum(not f.startswith("batch=") for f in os.listdir(f"{out}/services"))


LIMITS = {"digits": b'{"n":' + b"7" * 1200 + b"}", "fraction": b'{"n":0.' + b"7" * 1200 + b"}", "key": b'{"' + b"k" * 60_000 + b'":1}', "string": b'["' + b"s" * 20_000_001 + b'"]'}


def test_what_spark_cannot_store_is_refused_by_the_front_and_kept_whole_by_the_stream(spark, tmp_path):
    landing, out, js = str(tmp_path / "landing"), str(tmp_path / "out"), "application/json"
    front = Front(landing, 0, "127.0.0.1").start()

    def send(body, **head):
        c = http.client.HTTPConnection("127.0.0.1", front.port, timeout=60)
        c.request("POST", "/v1/logs", body, {"Content-Type": js, **{k.replace("_", "-"): v for k, v in head.items()}})
        r = c.getresponse()
        return r.status, json.loads(r.read())

    try:
        for body in LIMITS.values():
            assert send(body) == (400, {"code": 3, "message": "Invalid JSON"})
        for kind in (gzip, zlib):
            assert send(kind.compress(b"[" + b" " * payloads.MAX_BODY + b"]"), Content_Encoding="gzip" if kind is gzip else "deflate") == (413, {"code": 8, "message": "Payload too large"})
        c = http.client.HTTPConnection("127.0.0.1", front.port, timeout=60)
        c.putrequest("POST", "/v1/logs")
        c.putheader("Content-Type", js)
        c.putheader("Content-Length", str(payloads.MAX_BODY + 1))
        c.endheaders()
        assert c.getresponse().status == 413
        fits = b'["' + b"s" * 19_999_999 + b'",' + b"7" * 1000 + b',{"' + b"k" * 50_000 + b'":1}]'
        assert send(fits)[0] == 200
    finally:
        front.stop()
    ingest_stream(spark, landing, out, str(tmp_path / "state")).awaitTermination()
    stored = json.loads(spark.read.text(f"{out}/raw").first().value)
    assert (len(stored[0]), len(next(iter(stored[2])))) == (19_999_999, 50_000) and spark.read.schema(REJECTED).parquet(f"{out}/rejected").count() == 0
    # landed by other hands
    rows = [("logs", js, None, datetime.datetime(2024, 5, 1), body) for body in [*LIMITS.values(), json.dumps(LOG).encode()]]
    spark.createDataFrame(rows, "signal string, contentType string, contentEncoding string, received_at timestamp, body binary").coalesce(1).write.parquet(str(tmp_path / "more"))
    ingest_stream(spark, str(tmp_path / "more"), out, str(tmp_path / "state2")).awaitTermination()
    assert sorted(bytes(r.body) for r in spark.read.schema(REJECTED).parquet(f"{out}/rejected").collect()) == sorted(LIMITS.values())
    assert spark.read.text(f"{out}/services").count() == 1


def test_a_failed_write_answers_all_that_wait():
    def save(name, data):
        raise RuntimeError("no disk")

    landing, answers = Landing(save), []

    def land():
        try:
            landing.land("logs", "application/json", None, b"{}")
        except OSError as e:
            answers.append(str(e))

    many = [threading.Thread(target=land) for _ in range(8)]
    [t.start() for t in many]
    [t.join(20) for t in many]
    assert answers == ["can't land the request: no disk"] * 8


def test_engine_starts_once_stops_any_time_and_frees_its_port(spark, tmp_path):
    idle = Engine(spark, 0, str(tmp_path / "idle"))
    idle.stop()
    engine = Engine(spark, 0, str(tmp_path / "out"), seconds=0.2).start()
    port = engine.front.port
    assert engine.start() is engine and engine.front.port == port
    with pytest.raises(OSError):
        Engine(spark, port, str(tmp_path / "taken")).start()
    engine.stop()
    engine.stop()
    again = Engine(spark, port, str(tmp_path / "out"), seconds=0.2).start()
    again.stop()
    assert Engine(spark).output == "./otel-data" and Engine(spark).front.port == 4318
    engine.views(batch(spark, LOG))
    assert spark.sql("SELECT body FROM logs").count() == 1


@pytest.mark.parametrize("name", ["SIGINT", "SIGTERM"])
def test_cli_serves_until_a_signal(tmp_path, name):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "PYTHONPATH": root, "TIDELINE_OUTPUT_DIR": str(tmp_path / "out"), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    run = subprocess.Popen([sys.executable, "-m", "tideline.cli", "--port", "0"], env=env, cwd=tmp_path, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
    try:
        began, line = time.time(), ""
        while not line.startswith("listening") and time.time() < began + 100:
            line = run.stdout.readline()
        c = http.client.HTTPConnection("127.0.0.1", int(line.split()[2].strip(",")), timeout=30)
        c.request("POST", "/v1/logs", json.dumps(LOG), {"Content-Type": "application/json"})
        assert c.getresponse().status == 200
        run.send_signal(getattr(signal, name))
        assert run.wait(100) == 0
    finally:
        run.kill()
    lines = [line for d, _, names in os.walk(tmp_path / "out" / "services") for f in names if f.startswith("part-") for line in open(os.path.join(d, f))]
    assert [json.loads(x)["serviceName"] for x in lines] == [".."]
