import json

from pyspark.sql import functions as F

from tideline.operators.flatten import FLATTEN, PLACES, flatten
from tideline.sources import payloads


def kv(**values):
    return [{"key": k, "value": v} for k, v in values.items()]


def rows(spark, signal, *bodies):
    df = payloads.parse(spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)], "i int, body string"))
    out = FLATTEN[signal](df)
    got = out.orderBy("i", *[c for c in PLACES if c in out.columns]).select(F.to_json(F.struct(*[c for c in out.columns if c not in PLACES and c != "i"]))).collect()
    return [json.loads(r[0]) for r in got]


def logs(*records, **resource):
    return {"resourceLogs": [{"resource": {"attributes": kv(**resource)}, "scopeLogs": [{"scope": {"name": "test.scope", "version": "1.2.3"}, "logRecords": list(records)}]}]}


def test_logs(spark):
    svc = {"service.name": {"stringValue": "svc-a"}}
    got = rows(spark, "logs", logs(
        {"timeUnixNano": "1776886719688000000", "observedTimeUnixNano": "1776886719689000000", "severityNumber": 9, "severityText": "INFO", "body": {"stringValue": ""}, "attributes": kv(k={"stringValue": ""})},
        None, 5, **svc))
    assert got[0] == {"serviceName": "svc-a", "timestamp": "2026-04-22T19:38:39.688Z", "observedTimestamp": "2026-04-22T19:38:39.689Z", "severityNumber": 9, "severityText": "INFO", "body": "", "resource": {"service.name": "svc-a"}, "scope": {"name": "test.scope", "version": "1.2.3", "attributes": {}}, "attributes": {"k": ""}}
    assert len(got) == 3 and got[1] == got[2] and got[1]["body"] is None and got[1]["attributes"] == {}


def test_values_and_attributes(spark):
    record = {"body": {"boolValue": "false"}, "severityNumber": "9", "attributes": [
        *kv(a={"intValue": "5"}, b={}, c={"stringValue": 5}, d={"doubleValue": 1.5}, e={"bytesValue": "3q0="}, f={"arrayValue": {"values": 3}}, g={"kvlistValue": {"values": kv(x={"intValue": 1})}}),
        {"key": "h"}, {"key": "", "value": {"intValue": 1}}, 7, *kv(i={"intValue": 1}), *kv(i={"stringValue": "last"}), *kv(j={"intValue": 1}), *kv(j={"stringValue": 5}),
    ]}
    (row,) = rows(spark, "logs", logs(record))
    assert row["serviceName"] == "_unknown" and row["body"] is True and "severityNumber" not in row
    assert row["attributes"] == {"a": "5", "b": None, "d": 1.5, "e": "3q0=", "f": [], "g": {"x": 1}, "h": None, "i": "last"}


def test_deep_values_equal_shallow_rules(spark):
    deep = {"arrayValue": {"values": [{"kvlistValue": {"values": kv(x={"arrayValue": {"values": [{"kvlistValue": {"values": kv(y={"intValue": "7"}, z={"stringValue": 1})}}, {}]}})}}]}}
    (row,) = rows(spark, "logs", logs({"body": deep}))
    assert row["body"] == [{"x": [{"y": "7"}, None]}]


def test_traces(spark):
    span = {"traceId": "aa", "startTimeUnixNano": "1000000", "endTimeUnixNano": "2500000", "kind": "SPAN_KIND_SERVER", "status": {"code": 1, "message": "ok"}, "events": [{"timeUnixNano": "-1", "name": "e", "attributes": kv(a={"intValue": 1})}], "links": [{"traceId": "bb", "flags": 1}]}
    back = {"startTimeUnixNano": "5", "endTimeUnixNano": "4", "status": 3}
    a, b = rows(spark, "traces", {"resourceSpans": [{"scopeSpans": [{"spans": [span, back]}]}]})
    assert a["durationMs"] == 1.5 and a["status"] == {"code": 1, "message": "ok"} and "kind" not in a
    assert a["events"] == [{"timestamp": "1970-01-01T00:00:00.000Z", "name": "e", "attributes": {"a": 1}}] and a["links"] == [{"traceId": "bb", "flags": 1, "attributes": {}}]
    assert "durationMs" not in b and "status" not in b and b["events"] == [] and b["links"] == []


def test_metrics_of_every_kind(spark):
    exemplar = {"asDouble": None, "asInt": "5", "traceId": "t", "filteredAttributes": kv(q={"intValue": 2})}
    metric = {
        "name": "m", "unit": "s", "metadata": kv(n={"stringValue": "v"}),
        "summary": {"dataPoints": [{"count": "2", "sum": 3.5, "quantileValues": [{"quantile": 0.5, "value": 2.5}]}]},
        "exponentialHistogram": {"dataPoints": [{"count": 3, "scale": -2, "zeroCount": "1", "positive": {"offset": 3, "bucketCounts": ["1"]}, "negative": 4}]},
        "histogram": {"aggregationTemporality": 1, "dataPoints": [{"count": "3", "sum": 1.5, "min": 0.5, "bucketCounts": ["1", "2"], "explicitBounds": [1.5]}]},
        "sum": {"isMonotonic": True, "aggregationTemporality": 2, "dataPoints": [{"asInt": "-5", "exemplars": [exemplar]}]},
        "gauge": {"dataPoints": [{"asDouble": None, "asInt": "5"}, {"asDouble": 1.5}]},
    }
    got = rows(spark, "metrics", {"resourceMetrics": [{"scopeMetrics": [{"metrics": [metric, {"gauge": {"dataPoints": 5}}]}]}]})
    assert [r["metricType"] for r in got] == ["gauge", "gauge", "sum", "histogram", "exponentialHistogram", "summary"]
    gauge, double, total, histogram, exp, summary = got
    assert gauge["valueType"] == "double" and "value" not in gauge and double["value"] == 1.5 and gauge["metadata"] == {"n": "v"} and gauge["exemplars"] == []
    assert total["value"] == "-5" and total["isMonotonic"] is True and total["aggregationTemporality"] == 2 and total["exemplars"] == [{"value": "5", "valueType": "double", "traceId": "t", "filteredAttributes": {"q": 2}}]
    assert histogram["bucketCounts"] == ["1", "2"] and histogram["explicitBounds"] == [1.5] and histogram["count"] == "3" and "max" not in histogram
    assert exp["count"] == 3 and exp["scale"] == -2 and exp["positive"] == {"offset": 3, "bucketCounts": ["1"]} and "negative" not in exp
    assert summary["quantileValues"] == [{"quantile": 0.5, "value": 2.5}] and "exemplars" not in summary and "isMonotonic" not in summary


def test_other_payloads_have_no_rows_and_unknown_signals_none(spark):
    assert rows(spark, "logs", {"hello": 1}, {"resourceLogs": 5}, [1], {"resourceLogs": [{"scopeLogs": []}]}) == []
    assert flatten("profiles", None) is None


def test_plan_has_no_exchange_and_three_generators(spark):
    df = payloads.parse(spark.createDataFrame([("{}",)], "body string"))
    plan = FLATTEN["logs"](df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Generate") == 3


def nested(levels):
    """A tagged map in a map and so on around a number, and what it comes to."""
    value, plain = {"doubleValue": 1.50}, 1.5
    for i in range(levels):
        value, plain = ({"kvlistValue": {"values": kv(a=value, b={"intValue": "1"}, c={"stringValue": 5})}}, {"a": plain, "b": "1"}) if i % 2 else ({"arrayValue": {"values": [value, {}]}}, [plain, None])
    return value, plain


def test_values_of_any_depth_are_whole_everywhere(spark):
    for levels in (2, 3, 60, 240):
        value, plain = nested(levels)
        got = rows(spark, "logs", logs({"body": value, "attributes": kv(k=value, big={"intValue": 2**60}), "arrayValue": {}}, r=value))
        assert (got[0]["body"], got[0]["attributes"], got[0]["resource"]) == (plain, {"k": plain, "big": 2**60}, {"r": plain})
    value, plain = nested(4)
    exemplar = {"asInt": 1, "filteredAttributes": kv(q=value)}
    got = rows(spark, "metrics", {"resourceMetrics": [{"scopeMetrics": [{"scope": {"attributes": kv(s=value)}, "metrics": [{"metadata": kv(m=value), "gauge": {"dataPoints": [{"attributes": kv(p=value), "exemplars": [exemplar]}]}}]}]}]})
    assert (got[0]["scope"]["attributes"], got[0]["metadata"], got[0]["attributes"], got[0]["exemplars"][0]["filteredAttributes"]) == ({"s": plain}, {"m": plain}, {"p": plain}, {"q": plain})
    got = rows(spark, "traces", {"resourceSpans": [{"scopeSpans": [{"spans": [{"events": [{"attributes": kv(e=value)}], "links": [{"attributes": kv(n=value)}]}]}]}]})
    assert (got[0]["events"][0]["attributes"], got[0]["links"][0]["attributes"]) == ({"e": plain}, {"n": plain})


def test_finished_values_take_nothing_from_the_sender(spark):
    value, plain = nested(3)
    bad = {"arrayValue": {"values": [{"arrayValue": {"values": [{"doubleValue": 1}]}, "tidelineDone": 7}, {"tidelineDone": 7}]}}
    got = rows(spark, "logs", logs({"body": bad}), logs({"body": [value]}), logs({"body": {"tidelineDone": 7}}))
    assert [r["body"] for r in got] == [[[1], None], [value], None]
    df = payloads.parse(spark.createDataFrame([('{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":{"arrayValue":{"values":[{"arrayValue":{"values":[{"doubleValue":1e400},{"doubleValue":12345678901234567890.12345678901},{"stringValue":"\\ud800"}]}}]}}}]}]}]}',)], "body string"))
    assert FLATTEN["logs"](df).select(F.to_json("body")).first()[0] == '[[null,12345678901234567890.12345678901,"?"]]'


def test_names_hidden_by_escapes_are_found(spark):
    value = '{"\\u0061rrayValue":{"values":[{"\\u0061rrayValue":{"values":[{"\\u0061rrayValue":{"values":[{"intValue":1}]}}]}}]}}'
    body = '{"resourceLogs":[{"scopeLogs":[{"logRecords":[{"body":' + value + "}]}]}]}"
    df = payloads.parse(spark.createDataFrame([(body,)], "body string"))
    assert FLATTEN["logs"](df).select(F.to_json("body")).first()[0] == "[[[1]]]"
    assert FLATTEN["logs"](df).columns[0] == "resourceIndex"


INTERNAL = ("resource", "scope", "serviceName", "resourceIndex", "scopeIndex", "leafIndex", "_r", "_s", "_x", "_p", "_t", "_m", "p", "_own", "_leaf", "_leaves", "_scopes", "_points", "_nanos", "_nanos_end", "_start", "_time", "f0")


def test_callers_columns_may_have_any_name(spark):
    span = {"resourceSpans": [{"resource": {"attributes": kv(**{"service.name": {"stringValue": "s"}})}, "scopeSpans": [{"spans": [{"name": "n"}]}]}]}
    point = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "m", "gauge": {"dataPoints": [{"asInt": "3"}]}}]}]}]}
    for signal, body in (("logs", logs({"severityText": "x"}, **{"service.name": {"stringValue": "s"}})), ("traces", span), ("metrics", point)):
        plain = FLATTEN[signal](payloads.parse(spark.createDataFrame([(json.dumps(body),)], "body string")))
        clashing = list(dict.fromkeys([*INTERNAL, *[c for c in plain.columns if c != "body"], "a`b", "x.y", "TimeStamp_in"]))
        given = spark.createDataFrame([(json.dumps(body), *range(len(clashing)))], "_given string, " + ", ".join(f"`{c.replace('`', '``')}` int" for c in clashing))
        rows = FLATTEN[signal](payloads.parse(given, "_given"))
        # nothing clashes, whatever the case, and all values are there
        assert len({c.lower() for c in rows.columns}) == len(rows.columns) == len(plain.columns) + len(clashing)
        row, bare = rows.collect()[0].asDict(), plain.selectExpr(*[f"to_json(struct(`{c}`)) AS `{c}`" for c in plain.columns]).collect()[0].asDict()
        assert sorted(v for c, v in row.items() if c not in plain.columns) == list(range(len(clashing))) and row["a`b"] == clashing.index("a`b")
        assert row["resource_in"] == 0 and "resource" in plain.columns
        again = rows.selectExpr(*[f"to_json(struct(`{c}`)) AS `{c}`" for c in plain.columns]).collect()[0].asDict()
        assert again == bare


def test_payloads_are_read_in_one_pass_and_odd_parts_keep_their_place(spark):
    span = {"name": "n", "attributes": 7, "events": [5, {"name": "e", "attributes": [5, {"key": 5, "value": 1}, *kv(a={"intValue": 1})]}], "links": {}, "status": []}
    body = {"resourceSpans": [5, {"resource": 5, "scopeSpans": [None, {"scope": 5, "spans": [span, [], None]}, {"spans": 3}]}, {"resource": {"attributes": {}}, "scopeSpans": 1}]}
    df = payloads.parse(spark.createDataFrame([(json.dumps(body),)], "body string"))
    out = FLATTEN["traces"](df)
    # level by level, every VARIANT would be written anew
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "StructField(scopeSpans,ArrayType(StructType(" in plan
    got = [tuple(r) for r in out.orderBy(*PLACES[:3]).select(*PLACES[:3], F.size("links"), F.col("status").isNull(), F.to_json("resource"), F.to_json("attributes"), F.to_json("events")).collect()]
    assert [r[:-1] for r in got] == [(1, 1, i, 0, True, "{}", "{}") for i in range(3)]
    assert json.loads(got[0][-1]) == [{"attributes": {}}, {"name": "e", "attributes": {"a": 1}}] and [json.loads(r[-1]) for r in got[1:]] == [[], []]
