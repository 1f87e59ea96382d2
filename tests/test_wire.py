import math
import struct

import pytest

from tideline.sources import wire


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


@pytest.mark.parametrize("n", [0, 1, 127, 128, 150, 300, 2**33, 2**53 - 1, 2**64 - 1])
def test_varints(n):
    assert wire.read_varint(memoryview(varint(n)), 0) == (n, len(varint(n)))


def test_zigzag_and_sign():
    assert [wire.zigzag(n) for n in range(4)] == [0, -1, 1, -2]
    assert wire.signed(2**64 - 5) == -5 and wire.signed(5) == 5


@pytest.mark.parametrize(("name", "raw", "value"), [
    ("fixed32", b"\x01\0\0\0", 1), ("sfixed32", b"\xff\xff\xff\xff", -1), ("fixed64", b"\xff" * 8, str(2**64 - 1)), ("sfixed64", b"\xff" * 8, "-1"),
    ("float", struct.pack("<f", 1.5), 1.5), ("double", struct.pack("<d", 1.0), 1.0), ("double", struct.pack("<d", math.inf), None), ("hex", b"\xde\xad", "dead"), ("base64", b"\xde\xad", "3q0="), ("string", b"a\xff", "a�"),
])
def test_scalars(name, raw, value):
    assert wire.SCALARS[name][1](memoryview(raw)) == value


def test_unknown_fields_are_skipped_and_bad_wire_types_refused():
    raw = varint(99 << 3) + b"\x05" + varint(98 << 3 | 1) + b"\0" * 8 + varint(97 << 3 | 2) + b"\x02ab" + varint(96 << 3 | 5) + b"\0" * 4
    assert wire.decode("logs", raw) == {"resourceLogs": []}
    for bad in (b"\x0a\x05\x08", b"\xff\xff\xff", b"\x0f", b"\x0b"):
        with pytest.raises(wire.Malformed):
            wire.decode("logs", bad)
    assert wire.decode_request("logs", b"") == "{}"


@pytest.mark.parametrize("value", [
    {"stringValue": ""}, {"boolValue": False}, {"intValue": "-5"}, {"intValue": "42"}, {"doubleValue": 1.5}, {"bytesValue": "3q0="},
    {"arrayValue": {"values": [{"stringValue": "a"}, {"arrayValue": {"values": []}}]}}, {"kvlistValue": {"values": [{"key": "k", "value": {"intValue": "7"}}]}},
])
def test_values_round_trip(value):
    assert wire.decode("AnyValue", wire.encode("AnyValue", value)) == value


def test_metrics_round_trip_packed_and_unpacked():
    point = {"startTimeUnixNano": "1", "timeUnixNano": "2", "count": "3", "sum": 1.5, "bucketCounts": ["1", "2"], "explicitBounds": [0.5], "flags": 1, "min": 0.0, "max": 2.0}
    request = {"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": "h", "histogram": {"dataPoints": [point], "aggregationTemporality": 2}}]}]}]}
    assert wire.decode("metrics", wire.encode("metrics", request)) == request
    packed = b"\x32\x10" + struct.pack("<QQ", 7, 8) + b"\x3a\x08" + struct.pack("<d", 2.5) + b"\x55" + struct.pack("<I", 3)
    assert wire.decode("HistogramDataPoint", packed) == {"bucketCounts": ["7", "8"], "explicitBounds": [2.5], "flags": 3}
    assert wire.decode("Buckets", b"\x08\x05\x12\x03\x01\xac\x02") == {"offset": -3, "bucketCounts": ["1", "300"]}
    exp = {"dataPoints": [{"scale": -2, "zeroCount": "1", "positive": {"offset": 3, "bucketCounts": ["1"]}, "zeroThreshold": 0.5}]}
    assert wire.decode("ExponentialHistogram", wire.encode("ExponentialHistogram", exp)) == exp
    summary = {"dataPoints": [{"count": "2", "sum": 3.0, "quantileValues": [{"quantile": 0.5, "value": 1.0}, {"quantile": 0.99, "value": 2.0}]}]}
    assert wire.decode("Summary", wire.encode("Summary", summary)) == summary


def test_last_of_a_repeated_single_field_holds_and_strange_wire_types_are_skipped():
    two = wire.encode("KeyValue", {"key": "a"}) + wire.encode("KeyValue", {"key": "b"})
    assert wire.decode("KeyValue", two) == {"key": "b"}
    assert wire.decode("KeyValue", b"\x08\x05") == {}
