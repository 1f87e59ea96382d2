"""Unnesting: one row per log record, span or metric data point from a DataFrame of payloads.

Each function takes a DataFrame with a VARIANT column `payload` and returns its other columns, the place of the row in its
payload and the normalized columns. A payload is read in one pass down to its leaves, and a leaf in one pass down to its values
(coerce.struct). Parents are computed before their children are exploded, so they are computed once; plans are scans, projections
and generators without an exchange. NULL columns are omitted ones; to_json drops them.

The caller's columns go along in one struct, so they may have any names but `payload`. One whose name is, but for case, also that
of a normalized column comes out as name_in, or with as many _in as make it differ; a column named as payloads.MAYBE goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.coerce import ENTRIES, any_value, attributes, boolean, each, get, integer, known, number, number_like, record, struct, text
from ..functions.timefn import duration_of, iso, iso_at, nanos, time_of
from ..sources.payloads import MAYBE, finish

UNKNOWN_SERVICE = "_unknown"


def _named(**columns: str) -> list[str]:
    return [f"{value} AS `{name}`" for name, value in columns.items()]


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: The struct that carries the caller's columns as f0, f1 and so on.
_OWN = "_own"


def _foreign(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("payload", MAYBE)]


def _carried(names: list[str]) -> list[str]:
    return ["named_struct(" + ", ".join(f"'f{i}', {_quote(c)}" for i, c in enumerate(names)) + f") AS {_OWN}"] if names else []


def _returned(names: list[str], normalized: list[str]) -> list[str]:
    """The caller's columns out of their struct, renamed where they clash."""
    taken, out = {c.lower() for c in normalized}, []
    for i, name in enumerate(names):
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out.append(f"{_OWN}.f{i} AS {_quote(name)}")
    return out


def _selected(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Columns of df, given as SQL, behind those of the caller."""
    rows = df.selectExpr(*([_OWN] if names else []), *columns)
    return rows.selectExpr(*_returned(names, [c for c in rows.columns if c != _OWN]), *[_quote(c) for c in rows.columns if c != _OWN])


def _scope(s: str) -> str:
    return record(name=text(f"{s}.name"), version=text(f"{s}.version"), attributes=attributes(f"{s}.attributes"))


def _leaves(df: DataFrame, top: str, middle: str, leaf: str, type_: str, times: dict[str, str]) -> DataFrame:
    """The leaves, read by their type (_x), with resource, serviceName and scope beside them, their place as resourceIndex, scopeIndex and leafIndex, and counts of nanoseconds (times: name and field)."""
    names = _foreign(df)
    kept = [_OWN] if names else []
    scopes = f"array<{struct(scope=struct('name', 'version', attributes=ENTRIES), **{leaf: 'array<variant>'})}>"
    resources = f"array<{struct(resource=struct(attributes=ENTRIES), **{middle: scopes})}>"
    outer = finish(df).selectExpr(*_carried(names), "payload").selectExpr(*kept, f"posexplode({known(get('payload', resources, f'$.{top}'), resources)}) AS (resourceIndex, _r)")
    outer = outer.selectExpr(*kept, "resourceIndex", f"{attributes('_r.resource.attributes')} AS resource", f"{known(f'_r.{middle}', scopes)} AS _scopes")
    service = f"""coalesce({text("try_element_at(resource, 'service.name')")}, '{UNKNOWN_SERVICE}')"""
    inner = outer.selectExpr(*kept, "resourceIndex", f"{service} AS serviceName", "resource", "posexplode(_scopes) AS (scopeIndex, _s)")
    kept += ["resourceIndex", "scopeIndex", "serviceName", "resource"]
    inner = inner.selectExpr(*kept, f"{_scope('_s.scope')} AS scope", f"{known(f'_s.{leaf}')} AS _leaves")
    # leaves are read one by one, so a large payload isn't unfolded as a whole
    rows = inner.selectExpr(*kept, "scope", "posexplode(_leaves) AS (leafIndex, _leaf)").selectExpr(*kept, "scope", "leafIndex", f"{get('_leaf', type_)} AS _x")
    return _timed(rows, {name: f"_x.{source}" for name, source in times.items()})


def _timed(df: DataFrame, times: dict[str, str]) -> DataFrame:
    """df with counts of nanoseconds (times: name and value), and the timestamp of each as name_at; both are columns, as each is read more than once."""
    counted = df.selectExpr("*", *_named(**{name: nanos(value) for name, value in times.items()}))
    return counted.selectExpr("*", *_named(**{f"{name}_at": time_of(name) for name in times}))


#: A row's place in its payload.
_PLACE = ("resourceIndex", "scopeIndex", "leafIndex")


_EVENT = struct("timeUnixNano", "name", "droppedAttributesCount", attributes=ENTRIES)
_LINK = struct("traceId", "spanId", "traceState", "flags", "droppedAttributesCount", attributes=ENTRIES)
#: What is read of a log record and of a span.
LOG = struct("timeUnixNano", "observedTimeUnixNano", "severityNumber", "severityText", "body", "traceId", "spanId", "flags", "droppedAttributesCount", attributes=ENTRIES)
SPAN = struct(
    "traceId", "spanId", "parentSpanId", "name", "kind", "traceState", "flags", "startTimeUnixNano", "endTimeUnixNano", "droppedAttributesCount", "droppedEventsCount", "droppedLinksCount",
    status=struct("code", "message"), attributes=ENTRIES, events=f"array<{_EVENT}>", links=f"array<{_LINK}>",
)


def _each(items: str, type_: str, use: Callable[[str], str]) -> str:
    return each(known(items, f"array<{type_}>"), use)


def _same(s: str, read: Callable[[str], str], *names: str) -> dict[str, str]:
    """Fields of a struct under their own names."""
    return {n: read(f"{s}.{n}") for n in names}


def flatten_logs(payloads: DataFrame) -> DataFrame:
    df = _leaves(payloads, "resourceLogs", "scopeLogs", "logRecords", LOG, {"_nanos": "timeUnixNano", "_nanos_observed": "observedTimeUnixNano"})
    return _selected(df, _foreign(payloads), [
        *_PLACE, "serviceName",
        *_named(
            timestamp=iso_at("_nanos_at"), observedTimestamp=iso_at("_nanos_observed_at"), severityNumber=integer("_x.severityNumber"), severityText=text("_x.severityText"), body=any_value("_x.body"),
            **_same("_x", text, "traceId", "spanId"), **_same("_x", integer, "flags", "droppedAttributesCount"),
        ),
        "resource", "scope", *_named(attributes=attributes("_x.attributes")),
    ])


def _status(s: str) -> str:
    return f"CASE WHEN {s} IS NOT NULL THEN {record(code=integer(f'{s}.code'), message=text(f'{s}.message'))} END"


def _event(x: str) -> str:
    return record(timestamp=iso(f"{x}.timeUnixNano"), name=text(f"{x}.name"), droppedAttributesCount=integer(f"{x}.droppedAttributesCount"), attributes=attributes(f"{x}.attributes"))


def _link(x: str) -> str:
    return record(**_same(x, text, "traceId", "spanId", "traceState"), **_same(x, integer, "flags", "droppedAttributesCount"), attributes=attributes(f"{x}.attributes"))


def flatten_traces(payloads: DataFrame) -> DataFrame:
    df = _leaves(payloads, "resourceSpans", "scopeSpans", "spans", SPAN, {"_nanos": "startTimeUnixNano", "_nanos_end": "endTimeUnixNano"})
    return _selected(df, _foreign(payloads), [
        *_PLACE, "serviceName",
        *_named(
            **_same("_x", text, "traceId", "spanId", "parentSpanId", "name"), kind=integer("_x.kind"), traceState=text("_x.traceState"), flags=integer("_x.flags"),
            startTimestamp=iso_at("_nanos_at"), endTimestamp=iso_at("_nanos_end_at"), durationMs=duration_of("_nanos", "_nanos_end"), status=_status("_x.status"),
            **_same("_x", integer, "droppedAttributesCount", "droppedEventsCount", "droppedLinksCount"),
        ),
        "resource", "scope",
        *_named(
            attributes=attributes("_x.attributes"), events=_each("_x.events", _EVENT, _event), links=_each("_x.links", _LINK, _link),
        ),
    ])


_EXEMPLAR = struct("timeUnixNano", "asDouble", "asInt", "traceId", "spanId", filteredAttributes=ENTRIES)
_QUANTILE = struct("quantile", "value")
_SIDE = struct("offset", bucketCounts="array<variant>")
#: What is read of a data point of any kind.
POINT = struct(
    "startTimeUnixNano", "timeUnixNano", "flags", "asDouble", "asInt", "count", "sum", "min", "max", "scale", "zeroCount", "zeroThreshold", bucketCounts="array<variant>", explicitBounds="array<variant>",
    positive=_SIDE, negative=_SIDE, quantileValues=f"array<{_QUANTILE}>", attributes=ENTRIES, exemplars=f"array<{_EXEMPLAR}>",
)
#: Data containers of a metric in the order of their rows.
KINDS = ("gauge", "sum", "histogram", "exponentialHistogram", "summary")
_HOLDER = struct("aggregationTemporality", "isMonotonic", dataPoints="array<variant>")
METRIC = struct("name", "description", "unit", metadata=ENTRIES, **dict.fromkeys(KINDS, _HOLDER))


def _value_type(x: str) -> str:
    return f"CASE WHEN {x}.asDouble IS NOT NULL THEN 'double' WHEN {x}.asInt IS NOT NULL THEN 'int' END"


def _exemplar(x: str) -> str:
    double = f"CASE WHEN {number(f'{x}.asDouble')} IS NOT NULL THEN {x}.asDouble END"
    return record(timestamp=iso(f"{x}.timeUnixNano"), value=f"coalesce({double}, {number_like(f'{x}.asInt')})", valueType=_value_type(x), **_same(x, text, "traceId", "spanId"), filteredAttributes=attributes(f"{x}.filteredAttributes"))


def _buckets(s: str) -> str:
    return f"CASE WHEN {s} IS NOT NULL THEN {record(offset=integer(f'{s}.offset'), bucketCounts=f'{s}.bucketCounts')} END"


def _quantile(x: str) -> str:
    return record(**_same(x, number, "quantile", "value"))


def flatten_metrics(payloads: DataFrame) -> DataFrame:
    """One superset of columns for all kinds; columns that a kind lacks are NULL."""
    df = _leaves(payloads, "resourceMetrics", "scopeMetrics", "metrics", METRIC, {})

    def points(kind: str) -> str:
        shared = {"kind": f"'{kind}'", "temporality": integer(f"_x.{kind}.aggregationTemporality"), "monotonic": boolean(f"_x.{kind}.isMonotonic")}
        return each(known(f"_x.{kind}.dataPoints"), lambda p: record(**shared, point=p))

    names = _foreign(payloads)
    base = df.selectExpr(
        *[_OWN] * bool(names), *_PLACE, "serviceName", *_named(metricName=text("_x.name"), description=text("_x.description"), unit=text("_x.unit")), "resource", "scope",
        *_named(metadata=attributes("_x.metadata"), _points=f"concat({', '.join(map(points, KINDS))})"),
    )
    kept = [c for c in base.columns if c != "_points"]
    rows = base.selectExpr(*kept, "posexplode(_points) AS (pointIndex, _p)")
    rows = rows.selectExpr(*kept, "pointIndex", "_p.kind AS metricType", "_p.temporality AS _t", "_p.monotonic AS _m", f"{get('_p.point', POINT)} AS p")
    rows = _timed(rows, {"_start": "p.startTimeUnixNano", "_time": "p.timeUnixNano"})
    of = lambda kinds, value: f"CASE WHEN metricType IN ({', '.join(repr(k) for k in kinds)}) THEN {value} END"
    numbers, both, counted = ("gauge", "sum"), ("histogram", "exponentialHistogram"), ("histogram", "exponentialHistogram", "summary")
    plain, exp, summary = ("histogram",), ("exponentialHistogram",), ("summary",)
    # a present asDouble decides even if it holds no number
    value = f"CASE WHEN p.asDouble IS NOT NULL THEN CASE WHEN {number('p.asDouble')} IS NOT NULL THEN p.asDouble END ELSE {number_like('p.asInt')} END"
    return _selected(rows, names, [
        *[c for c in kept if c != _OWN], "pointIndex", "metricType",
        *_named(
            aggregationTemporality=of(numbers + both, "_t"), isMonotonic=of(numbers, "_m"), startTimestamp=iso_at("_start_at"), timestamp=iso_at("_time_at"), flags=integer("p.flags"),
            value=of(numbers, value), valueType=of(numbers, _value_type("p")), count=of(counted, number_like("p.count")), sum=of(counted, number("p.sum")),
            bucketCounts=of(plain, "p.bucketCounts"), explicitBounds=of(plain, "p.explicitBounds"), min=of(both, number("p.min")), max=of(both, number("p.max")),
            scale=of(exp, integer("p.scale")), zeroCount=of(exp, number_like("p.zeroCount")), zeroThreshold=of(exp, number("p.zeroThreshold")),
            positive=of(exp, _buckets("p.positive")), negative=of(exp, _buckets("p.negative")), quantileValues=of(summary, _each("p.quantileValues", _QUANTILE, _quantile)),
            attributes=attributes("p.attributes"), exemplars=of(numbers + both, _each("p.exemplars", _EXEMPLAR, _exemplar)),
        ),
    ])


FLATTEN = {"logs": flatten_logs, "traces": flatten_traces, "metrics": flatten_metrics}
#: Columns that tell a row's place; sinks leave them out.
PLACES = ("resourceIndex", "scopeIndex", "leafIndex", "pointIndex")


def flatten(signal: str, payloads: DataFrame) -> DataFrame | None:
    """The rows of a signal's payloads; an unknown signal has none."""
    return FLATTEN[signal](payloads) if signal in FLATTEN else None
