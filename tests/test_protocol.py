"""The decoder against the protobuf library: messages as the public protocol defines them, filled at random, with fields that no version knows."""

import base64
import json
import random

import pytest

from tideline.sources import wire

pb = pytest.importorskip("google.protobuf.descriptor_pb2")
from google.protobuf import descriptor_pool, message_factory  # noqa: E402

#: The messages of the public protocol. A field is type, name and number; many marks repeated ones, one those of a oneof.
PROTOCOL = """
LogsRequest: many ResourceLogs resource_logs 1
ResourceLogs: Resource resource 1, many ScopeLogs scope_logs 2, string schema_url 3
ScopeLogs: InstrumentationScope scope 1, many LogRecord log_records 2, string schema_url 3
LogRecord: fixed64 time_unix_nano 1, fixed64 observed_time_unix_nano 11, int32 severity_number 2, string severity_text 3, AnyValue body 5, many KeyValue attributes 6, uint32 dropped_attributes_count 7, fixed32 flags 8, bytes trace_id 9, bytes span_id 10, string event_name 12
TraceRequest: many ResourceSpans resource_spans 1
ResourceSpans: Resource resource 1, many ScopeSpans scope_spans 2, string schema_url 3
ScopeSpans: InstrumentationScope scope 1, many Span spans 2, string schema_url 3
Span: bytes trace_id 1, bytes span_id 2, string trace_state 3, bytes parent_span_id 4, fixed32 flags 16, string name 5, int32 kind 6, fixed64 start_time_unix_nano 7, fixed64 end_time_unix_nano 8, many KeyValue attributes 9, uint32 dropped_attributes_count 10, many Event events 11, uint32 dropped_events_count 12, many Link links 13, uint32 dropped_links_count 14, Status status 15
Event: fixed64 time_unix_nano 1, string name 2, many KeyValue attributes 3, uint32 dropped_attributes_count 4
Link: bytes trace_id 1, bytes span_id 2, string trace_state 3, many KeyValue attributes 4, uint32 dropped_attributes_count 5, fixed32 flags 6
Status: string message 2, int32 code 3
MetricsRequest: many ResourceMetrics resource_metrics 1
ResourceMetrics: Resource resource 1, many ScopeMetrics scope_metrics 2, string schema_url 3
ScopeMetrics: InstrumentationScope scope 1, many Metric metrics 2, string schema_url 3
Metric: string name 1, string description 2, string unit 3, one Gauge gauge 5, one Sum sum 7, one Histogram histogram 9, one ExponentialHistogram exponential_histogram 10, one Summary summary 11, many KeyValue metadata 12
Gauge: many NumberDataPoint data_points 1
Sum: many NumberDataPoint data_points 1, int32 aggregation_temporality 2, bool is_monotonic 3
Histogram: many HistogramDataPoint data_points 1, int32 aggregation_temporality 2
ExponentialHistogram: many ExponentialHistogramDataPoint data_points 1, int32 aggregation_temporality 2
Summary: many SummaryDataPoint data_points 1
NumberDataPoint: many KeyValue attributes 7, fixed64 start_time_unix_nano 2, fixed64 time_unix_nano 3, one double as_double 4, one sfixed64 as_int 6, many Exemplar exemplars 5, uint32 flags 8
HistogramDataPoint: many KeyValue attributes 9, fixed64 start_time_unix_nano 2, fixed64 time_unix_nano 3, fixed64 count 4, double sum 5, many fixed64 bucket_counts 6, many double explicit_bounds 7, many Exemplar exemplars 8, uint32 flags 10, double min 11, double max 12
ExponentialHistogramDataPoint: many KeyValue attributes 1, fixed64 start_time_unix_nano 2, fixed64 time_unix_nano 3, fixed64 count 4, double sum 5, sint32 scale 6, fixed64 zero_count 7, Buckets positive 8, Buckets negative 9, uint32 flags 10, many Exemplar exemplars 11, double min 12, double max 13, double zero_threshold 14
Buckets: sint32 offset 1, many uint64 bucket_counts 2
SummaryDataPoint: many KeyValue attributes 7, fixed64 start_time_unix_nano 2, fixed64 time_unix_nano 3, fixed64 count 4, double sum 5, many ValueAtQuantile quantile_values 6, uint32 flags 8
ValueAtQuantile: double quantile 1, double value 2
Exemplar: many KeyValue filtered_attributes 7, fixed64 time_unix_nano 2, one double as_double 3, one sfixed64 as_int 6, bytes span_id 4, bytes trace_id 5
AnyValue: one string string_value 1, one bool bool_value 2, one int64 int_value 3, one double double_value 4, one ArrayValue array_value 5, one KeyValueList kvlist_value 6, one bytes bytes_value 7
ArrayValue: many AnyValue values 1
KeyValueList: many KeyValue values 1
KeyValue: string key 1, AnyValue value 2
InstrumentationScope: string name 1, string version 2, many KeyValue attributes 3, uint32 dropped_attributes_count 4
Resource: many KeyValue attributes 1, uint32 dropped_attributes_count 2
"""
REQUESTS = {"logs": "LogsRequest", "traces": "TraceRequest", "metrics": "MetricsRequest"}
UNKNOWN = "uint64 later_number 2001, fixed64 later_wide 2002, bytes later_bytes 2003, fixed32 later_word 2004, many uint32 later_numbers 2005"


def build(packed=True):
    """Message classes of the protocol, with fields of a later version in every message."""
    file = pb.FileDescriptorProto(name=f"protocol{packed}.proto", package=f"p{packed}", syntax="proto3")
    types = {n: getattr(pb.FieldDescriptorProto, f"TYPE_{n.upper()}") for n in ("double", "int64", "uint64", "int32", "fixed64", "fixed32", "bool", "string", "bytes", "uint32", "sfixed64", "sint32")}
    lines = dict(line.split(": ") for line in PROTOCOL.strip().splitlines())
    for name, given in lines.items():
        m = file.message_type.add(name=name)
        for f in f"{given}, {UNKNOWN}".split(", "):
            how, kind, field, number = f.split() if len(f.split()) == 4 else ["", *f.split()]
            d = m.field.add(name=field, number=int(number), label=3 if how == "many" else 1)
            if kind in types:
                d.type = types[kind]
                if how == "many" and kind not in ("string", "bytes"):
                    d.options.packed = packed
            else:
                d.type, d.type_name = pb.FieldDescriptorProto.TYPE_MESSAGE, f".p{packed}.{kind}"
            if how == "one":
                if not m.oneof_decl:
                    m.oneof_decl.add(name="choice")
                d.oneof_index = 0
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return {n: message_factory.GetMessageClass(pool.FindMessageTypeByName(f"p{packed}.{n}")) for n in lines}


def fill(message, rng, depth=0):
    """Random values, edges among them; recursion ends."""
    choice = [f for f in message.DESCRIPTOR.fields if f.containing_oneof]
    chosen = rng.choice(choice) if choice else None
    for f in message.DESCRIPTOR.fields:
        if f.containing_oneof and f is not chosen or rng.random() < 0.15:
            continue
        edge = lambda bits, low=0: rng.choice([low, 0, 1, 127, 128, 300, 2**bits - 1, rng.randrange(2**bits)])
        make = {
            f.TYPE_DOUBLE: lambda: rng.choice([0.0, -1.5, 1e300, rng.random()]), f.TYPE_INT64: lambda: edge(63, -(2**63)), f.TYPE_UINT64: lambda: edge(64), f.TYPE_INT32: lambda: rng.randrange(25), f.TYPE_FIXED64: lambda: edge(64),
            f.TYPE_FIXED32: lambda: edge(32), f.TYPE_BOOL: lambda: rng.random() < 0.5, f.TYPE_STRING: lambda: rng.choice(["", "a", "é中😀", "x" * 200]), f.TYPE_BYTES: lambda: rng.randbytes(rng.choice([0, 8, 16])), f.TYPE_UINT32: lambda: edge(32),
            f.TYPE_SFIXED64: lambda: edge(63, -(2**63)), f.TYPE_SINT32: lambda: edge(31, -(2**31)),
        }
        many = f.is_repeated if hasattr(f, "is_repeated") else f.label == 3
        for _ in range(rng.randint(0, 3) if many else 1):
            if f.type == f.TYPE_MESSAGE:
                if depth < 9:
                    inner = getattr(message, f.name).add() if many else getattr(message, f.name)
                    inner.SetInParent()
                    fill(inner, rng, depth + 1)
            elif many:
                getattr(message, f.name).append(make[f.type]())
            else:
                setattr(message, f.name, make[f.type]())
    return message


def camel(name):
    head, *rest = name.split("_")
    return head + "".join(w.capitalize() for w in rest)


def expected(message):
    out = {}
    for f, value in message.ListFields():
        if f.name.startswith("later_"):
            continue
        show = {f.TYPE_MESSAGE: expected, f.TYPE_BYTES: (lambda b: base64.b64encode(b).decode()) if f.name == "bytes_value" else bytes.hex}
        show |= dict.fromkeys((f.TYPE_FIXED64, f.TYPE_UINT64, f.TYPE_INT64, f.TYPE_SFIXED64), str)
        show = show.get(f.type, lambda x: x)
        many = f.is_repeated if hasattr(f, "is_repeated") else f.label == 3
        out[camel(f.name)] = [show(v) for v in value] if many else show(value)
    return out


def bare(x):
    """Without empty lists, which the decoder shows for some fields."""
    if isinstance(x, dict):
        return {k: bare(v) for k, v in x.items() if v != []}
    return [bare(v) for v in x] if isinstance(x, list) else x


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("signal", REQUESTS)
def test_requests_written_by_the_library(signal, packed):
    classes, rng, seen = build(packed), random.Random(11), set()
    for _ in range(150):
        message = fill(classes[REQUESTS[signal]](), rng)
        raw = message.SerializeToString()
        got = json.loads(wire.decode_request(signal, raw))
        assert bare(got) == bare(expected(message))
        seen |= {k for k in json.dumps(got).split('"') if k}
    # every field of the signal's messages has come up
    names = {"logs": "eventName droppedAttributesCount kvlistValue bytesValue", "traces": "links events traceState parentSpanId", "metrics": "exponentialHistogram explicitBounds zeroThreshold quantileValues filteredAttributes metadata isMonotonic"}
    assert set(names[signal].split()) <= seen


def test_every_message_alone():
    classes, rng = build(), random.Random(12)
    own = {"InstrumentationScope": "Scope", **{v: k for k, v in REQUESTS.items()}}
    assert {own.get(n, n) for n in classes} == set(wire.MESSAGES)
    for name, cls in classes.items():
        for _ in range(40):
            message = fill(cls(), rng, 5)
            assert bare(wire.decode(own.get(name, name), message.SerializeToString())) == bare(expected(message)), name
