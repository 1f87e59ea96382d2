"""Protobuf export requests to their JSON shape, by one decoder over a table of fields.

Strict where the wire format is: a length beyond its message or a wire type that doesn't exist makes the request malformed.
A known field with another wire type than its own is skipped as unknown. A repeated singular field's last value holds. A message
whose JSON form would nest deeper than Spark parses is malformed.
"""

from __future__ import annotations

import base64
import json
import math
import struct
from collections.abc import Callable
from functools import partial

VARINT, I64, LEN, I32 = 0, 1, 2, 5
#: Levels of objects and arrays that the JSON form of a message may have.
DEEPEST = 1000


class Malformed(ValueError):
    pass


def _bounded(b: bytes | memoryview, at: int, end: int) -> tuple[int, int]:
    """An unsigned 64-bit varint that stands before `end`, and the position after it."""
    n = shift = 0
    while at < end and shift < 70:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n & 0xFFFFFFFFFFFFFFFF, at
        shift += 7
    raise Malformed("varint")


def read_varint(b: bytes | memoryview, at: int) -> tuple[int, int]:
    """An unsigned 64-bit varint and the position after it."""
    return _bounded(b, at, len(b))


def signed(n: int, bits: int = 64) -> int:
    return n - (1 << bits) if n >> (bits - 1) & 1 else n


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def _double(x: memoryview) -> float | None:
    v = struct.unpack("<d", x)[0]
    # JSON has no NaN or infinity
    return v if math.isfinite(v) else None


#: How a scalar is read: wire type and conversion.
SCALARS = {
    "string": (LEN, lambda x: bytes(x).decode("utf-8-sig", "replace")),
    "hex": (LEN, lambda x: bytes(x).hex()),
    "base64": (LEN, lambda x: base64.b64encode(x).decode()),
    "uint": (VARINT, lambda x: x),
    "bool": (VARINT, bool),
    "int64": (VARINT, lambda x: str(signed(x))),
    "uint64": (VARINT, str),
    "sint": (VARINT, zigzag),
    "fixed32": (I32, lambda x: struct.unpack("<I", x)[0]),
    "sfixed32": (I32, lambda x: struct.unpack("<i", x)[0]),
    "float": (I32, lambda x: struct.unpack("<f", x)[0]),
    "fixed64": (I64, lambda x: str(struct.unpack("<Q", x)[0])),
    "sfixed64": (I64, lambda x: str(struct.unpack("<q", x)[0])),
    "double": (I64, _double),
}

#: Fixed values of the public protocol: per message its fields by number, as name and type. A type is a scalar, a message, or
#: either with * (repeated, left out when empty) or + (repeated, always there). flags of points come in two wire types.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "logs": {1: ("resourceLogs", "ResourceLogs+")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scopeLogs", "ScopeLogs*"), 3: ("schemaUrl", "string")},
    "ScopeLogs": {1: ("scope", "Scope"), 2: ("logRecords", "LogRecord*"), 3: ("schemaUrl", "string")},
    "LogRecord": {1: ("timeUnixNano", "fixed64"), 2: ("severityNumber", "uint"), 3: ("severityText", "string"), 5: ("body", "AnyValue"), 6: ("attributes", "KeyValue*"), 7: ("droppedAttributesCount", "uint"), 8: ("flags", "fixed32"), 9: ("traceId", "hex"), 10: ("spanId", "hex"), 11: ("observedTimeUnixNano", "fixed64"), 12: ("eventName", "string")},
    "traces": {1: ("resourceSpans", "ResourceSpans+")},
    "ResourceSpans": {1: ("resource", "Resource"), 2: ("scopeSpans", "ScopeSpans*"), 3: ("schemaUrl", "string")},
    "ScopeSpans": {1: ("scope", "Scope"), 2: ("spans", "Span*"), 3: ("schemaUrl", "string")},
    "Span": {1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "string"), 4: ("parentSpanId", "hex"), 5: ("name", "string"), 6: ("kind", "uint"), 7: ("startTimeUnixNano", "fixed64"), 8: ("endTimeUnixNano", "fixed64"), 9: ("attributes", "KeyValue*"), 10: ("droppedAttributesCount", "uint"), 11: ("events", "Event*"), 12: ("droppedEventsCount", "uint"), 13: ("links", "Link*"), 14: ("droppedLinksCount", "uint"), 15: ("status", "Status"), 16: ("flags", "fixed32")},
    "Event": {1: ("timeUnixNano", "fixed64"), 2: ("name", "string"), 3: ("attributes", "KeyValue*"), 4: ("droppedAttributesCount", "uint")},
    "Link": {1: ("traceId", "hex"), 2: ("spanId", "hex"), 3: ("traceState", "string"), 4: ("attributes", "KeyValue*"), 5: ("droppedAttributesCount", "uint"), 6: ("flags", "fixed32")},
    "Status": {2: ("message", "string"), 3: ("code", "uint")},
    "metrics": {1: ("resourceMetrics", "ResourceMetrics+")},
    "ResourceMetrics": {1: ("resource", "Resource"), 2: ("scopeMetrics", "ScopeMetrics*"), 3: ("schemaUrl", "string")},
    "ScopeMetrics": {1: ("scope", "Scope"), 2: ("metrics", "Metric*"), 3: ("schemaUrl", "string")},
    "Metric": {1: ("name", "string"), 2: ("description", "string"), 3: ("unit", "string"), 5: ("gauge", "Gauge"), 7: ("sum", "Sum"), 9: ("histogram", "Histogram"), 10: ("exponentialHistogram", "ExponentialHistogram"), 11: ("summary", "Summary"), 12: ("metadata", "KeyValue*")},
    "Gauge": {1: ("dataPoints", "NumberDataPoint+")},
    "Sum": {1: ("dataPoints", "NumberDataPoint+"), 2: ("aggregationTemporality", "uint"), 3: ("isMonotonic", "bool")},
    "Histogram": {1: ("dataPoints", "HistogramDataPoint+"), 2: ("aggregationTemporality", "uint")},
    "ExponentialHistogram": {1: ("dataPoints", "ExponentialHistogramDataPoint+"), 2: ("aggregationTemporality", "uint")},
    "Summary": {1: ("dataPoints", "SummaryDataPoint+")},
    "NumberDataPoint": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("asDouble", "double"), 5: ("exemplars", "Exemplar*"), 6: ("asInt", "sfixed64"), 7: ("attributes", "KeyValue*"), 8: ("flags", "uint|fixed32")},
    "HistogramDataPoint": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("bucketCounts", "fixed64*"), 7: ("explicitBounds", "double*"), 8: ("exemplars", "Exemplar*"), 9: ("attributes", "KeyValue*"), 10: ("flags", "uint|fixed32"), 11: ("min", "double"), 12: ("max", "double")},
    "ExponentialHistogramDataPoint": {1: ("attributes", "KeyValue*"), 2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("scale", "sint"), 7: ("zeroCount", "fixed64"), 8: ("positive", "Buckets"), 9: ("negative", "Buckets"), 10: ("flags", "uint|fixed32"), 11: ("exemplars", "Exemplar*"), 12: ("min", "double"), 13: ("max", "double"), 14: ("zeroThreshold", "double")},
    "Buckets": {1: ("offset", "sint"), 2: ("bucketCounts", "uint64*")},
    "SummaryDataPoint": {2: ("startTimeUnixNano", "fixed64"), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("quantileValues", "ValueAtQuantile*"), 7: ("attributes", "KeyValue*"), 8: ("flags", "uint|fixed32")},
    "ValueAtQuantile": {1: ("quantile", "double"), 2: ("value", "double")},
    "Exemplar": {2: ("timeUnixNano", "fixed64"), 3: ("asDouble", "double"), 4: ("spanId", "hex"), 5: ("traceId", "hex"), 6: ("asInt", "sfixed64"), 7: ("filteredAttributes", "KeyValue*")},
    "AnyValue": {1: ("stringValue", "string"), 2: ("boolValue", "bool"), 3: ("intValue", "int64"), 4: ("doubleValue", "double"), 5: ("arrayValue", "ArrayValue"), 6: ("kvlistValue", "KeyValueList"), 7: ("bytesValue", "base64")},
    "ArrayValue": {1: ("values", "AnyValue+")},
    "KeyValueList": {1: ("values", "KeyValue+")},
    "KeyValue": {1: ("key", "string"), 2: ("value", "AnyValue")},
    "Scope": {1: ("name", "string"), 2: ("version", "string"), 3: ("attributes", "KeyValue*"), 4: ("droppedAttributesCount", "uint")},
    "Resource": {1: ("attributes", "KeyValue*"), 2: ("droppedAttributesCount", "uint")},
}


def _packed(kind: int, read, raw: memoryview) -> list:
    if kind == VARINT:
        out, at = [], 0
        while at < len(raw):
            n, at = read_varint(raw, at)
            out.append(read(n))
        return out
    width = 8 if kind == I64 else 4
    if len(raw) % width:
        raise Malformed("packed length")
    return [read(raw[i : i + width]) for i in range(0, len(raw), width)]


def _string(x: bytes) -> str:
    s = str(x, "utf-8", "replace")
    return s[1:] if s[:1] == "\ufeff" else s


#: Scalars of the hot path, read from bytes.
_READ = {name: read for name, (_, read) in SCALARS.items()} | {"string": _string, "hex": bytes.hex, "fixed64": lambda x: str(int.from_bytes(x, "little"))}
_SCALAR, _MESSAGE, _PACKED = range(3)


def _plan(message: str) -> tuple[dict, tuple]:
    """What a message's tags mean (how a value is read, its name, its reader, whether it repeats), and the names that are always there."""
    steps: dict[int, tuple] = {}
    for number, (name, type_) in MESSAGES[message].items():
        many, type_ = type_[-1] in "*+", type_.rstrip("*+")
        if type_ in MESSAGES:
            steps[number << 3 | LEN] = (_MESSAGE, name, type_, many)
            continue
        for option in type_.split("|"):
            kind = SCALARS[option][0]
            steps[number << 3 | kind] = (_SCALAR, name, _READ[option], many)
            if many and kind != LEN:
                steps[number << 3 | LEN] = (_PACKED, name, (kind, _READ[option]), many)
    return steps, tuple(name for name, type_ in MESSAGES[message].values() if type_[-1] == "+")


_PLANS = {message: _plan(message) for message in MESSAGES}


def _read(message: str, b: bytes, at: int, end: int, depth: int) -> dict:
    """The message that stands between two places of b; tags and lengths of one byte, as most are, are read in line."""
    if depth > DEEPEST:
        raise Malformed("nested too deep")
    steps, always = _PLANS[message]
    out: dict = {name: [] for name in always}
    while at < end:
        tag = b[at]
        at += 1
        if tag > 127:
            tag, at = _bounded(b, at - 1, end)
        step, kind = steps.get(tag), tag & 7
        if kind == LEN:
            if at < end and b[at] < 128:
                n, at = b[at], at + 1
            else:
                n, at = _bounded(b, at, end)
            value, at = at, at + n
            if at > end:
                raise Malformed("length")
            if step is None:
                continue
            how, name, read, many = step
            if how == _SCALAR:
                got = read(b[value:at])
            elif how == _MESSAGE:
                got = _read(read, b, value, at, depth + 1 + many)
            else:
                if some := _packed(*read, b[value:at]):
                    out.setdefault(name, []).extend(some)
                continue
        elif kind == VARINT:
            if at < end and b[at] < 128:
                value, at = b[at], at + 1
            else:
                value, at = _bounded(b, at, end)
            if step is None:
                continue
            _, name, read, many = step
            got = read(value)
        elif kind == I64 or kind == I32:
            value, at = at, at + (8 if kind == I64 else 4)
            if at > end:
                raise Malformed("length")
            if step is None:
                continue
            _, name, read, many = step
            got = read(b[value:at])
        else:
            raise Malformed("wire type")
        if not many:
            out[name] = got
        elif name in out:
            out[name].append(got)
        else:
            out[name] = [got]
    return out


def decode(message: str, raw: bytes | memoryview, depth: int = 1) -> dict:
    """A message as the object that its JSON form would be; depth: the level on which it stands."""
    return _read(message, bytes(raw), 0, len(raw), depth)


def decode_request(signal: str, body: bytes) -> str:
    """The JSON text of an export request of a signal; an empty body is an empty object."""
    return json.dumps(decode(signal, body), ensure_ascii=False) if body else "{}"


_SHORT = [bytes([n]) for n in range(128)]


def write_varint(n: int) -> bytes:
    if 0 <= n < 128:
        return _SHORT[n]
    out = bytearray()
    n &= 0xFFFFFFFFFFFFFFFF
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


#: How numbers of fixed width are laid out.
_LAYOUT = {"fixed32": "<I", "sfixed32": "<i", "float": "<f", "fixed64": "<Q", "sfixed64": "<q", "double": "<d"}


def write_scalar(type_: str, x) -> bytes:  # noqa: ANN001
    """A scalar as it stands after its tag."""
    if type_ in ("string", "hex", "base64"):
        raw = x.encode() if type_ == "string" else bytes.fromhex(x) if type_ == "hex" else base64.b64decode(x)
        return write_varint(len(raw)) + raw
    if type_ == "sint":
        return write_varint((x << 1) ^ (x >> 63))
    if SCALARS[type_][0] == VARINT:
        return write_varint(int(x))
    if type_ in ("float", "double"):
        return struct.pack(_LAYOUT[type_], float(x))
    return struct.pack(_LAYOUT[type_], int(x) % (1 << 8 * struct.calcsize(_LAYOUT[type_])) if type_.startswith("fixed") else int(x))


def read_scalar(type_: str, raw: bytes):  # noqa: ANN201
    """The value of a scalar as it stands after its tag."""
    kind, read = SCALARS[type_]
    value = read_varint(memoryview(raw), 0)[0] if kind == VARINT else memoryview(raw)[read_varint(memoryview(raw), 0)[1] :] if kind == LEN else memoryview(raw)
    return read(value)


def _sized(raw: bytes) -> bytes:
    return write_varint(len(raw)) + raw


def _put(type_: str, packed: bool) -> Callable:
    """How a value is written after its tag."""
    if type_ in MESSAGES:
        fields = _writers(type_, packed)

        def message(x: dict) -> bytes:
            raw = _joined(fields, x)
            n = len(raw)
            return (_SHORT[n] if n < 128 else write_varint(n)) + raw

        return message
    if type_ == "string":
        return lambda x: _sized(x.encode())
    if type_ == "hex":
        return lambda x: _sized(bytes.fromhex(x))
    if type_ == "fixed64":
        return lambda x: (int(x) & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little")
    if type_ == "double":
        return lambda x: _DOUBLE(float(x))
    return partial(write_scalar, type_)


_DOUBLE = struct.Struct("<d").pack
#: Per message and packed: see _writers.
_FIELDS: dict[tuple[str, bool], dict[str, tuple]] = {}


def _writers(message: str, packed: bool) -> dict[str, tuple]:
    """Per field of a message, by name in the order of numbers: its tag, whether it repeats, how a value is written, and whether all share one field."""
    if (message, packed) in _FIELDS:
        return _FIELDS[message, packed]
    # messages may hold themselves
    out = _FIELDS[message, packed] = {}
    for number, (name, type_) in MESSAGES[message].items():
        many, type_ = type_[-1] in "*+", type_.rstrip("*+").split("|")[0]
        kind = SCALARS[type_][0] if type_ in SCALARS else LEN
        shared = packed and many and kind != LEN
        out[name] = (write_varint(number << 3 | (LEN if shared else kind)), many, _put(type_, packed), shared)
    return out


def _joined(fields: dict[str, tuple], value: dict) -> bytes:
    if len(value) == 1:
        # most messages are values with one tag
        for name, x in value.items():
            if name in fields and not (step := fields[name])[1]:
                return step[0] + step[2](x)
    out = []
    for name, (tag, many, put, shared) in fields.items():
        if name not in value:
            continue
        x = value[name]
        if shared:
            out += (tag, _sized(b"".join(map(put, x))))
        elif many:
            for y in x:
                out += (tag, put(y))
        else:
            out += (tag, put(x))
    return b"".join(out)


def _written(message: str, value: dict, packed: bool) -> bytes:
    return _joined(_writers(message, packed), value)


def encode(message: str, value: dict, packed: bool = False) -> bytes:
    """The wire form of an object; for tests and for building inputs. packed: repeated numbers share one field."""
    return _written(message, value, packed)
