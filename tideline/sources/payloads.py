"""Payloads from bodies: JSON text, protobuf bytes, gzip and deflate.

`parse_json` keeps all work in the JVM. Bytes that need Python are decoded in Arrow batches. What can't be read is kept apart
with its reason, never dropped.
"""

from __future__ import annotations

import gzip
import io
import json
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import DEPTH, DONE, TAGS
from ..session import configure, on_workers
from .wire import DEEPEST, decode_request

#: Two containers at least, so that values may lie deeper than expressions unfold; or the key of finished ones, which no sender may use.
_DEEP = rf"(?s)(arrayValue|kvlistValue).*(arrayValue|kvlistValue)|{DONE}"
#: Column that tells whether a payload's text names a container or the key of finished values.
MAYBE = "_deep"
#: What Spark's JSON parser takes at most: characters of a number, and UTF-16 units of a key and of a string.
MAX_NUMBER, MAX_KEY, MAX_STRING = 1000, 50_000, 20_000_000
#: Bytes of a body, plain: Spark stores values of 128 MiB at most, and one may print longer than it came.
MAX_BODY = 64 << 20
#: Bytes of bodies that Python works on at a time.
SLICE = 2 << 20
#: Keys of key-value arrays.
_ENTRIES = ("attributes", "filteredAttributes", "metadata")


class _Float(float):
    """A number that keeps its digits."""

    def __new__(cls, digits: str):
        self = super().__new__(cls, digits)
        self.digits = digits
        return self


def _finished_text(text: str) -> str:
    """JSON text of _finished; numbers keep their digits, and where json.dumps would keep them too, it writes the text."""
    odd = []

    def read(digits: str) -> float:
        if repr(x := float(digits)) == digits:
            return x
        odd.append(digits)
        return _Float(digits)

    done = _finished(json.loads(text, parse_float=read))
    return _text(done) if odd else json.dumps(done, separators=(",", ":"))


def _text(x) -> str:
    """JSON text, as json.dumps gives it but for the digits of numbers."""
    if isinstance(x, _Float):
        return x.digits
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_text(v)}" for k, v in x.items()) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(_text, x)) + "]"
    return json.dumps(x)


def _plain(value):
    """A tagged value as plain JSON; Ellipsis for an omitted one."""
    if not isinstance(value, dict):
        return value
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < float("inf")
    for tag in TAGS:
        if tag not in value:
            continue
        x = value[tag]
        if tag in ("stringValue", "bytesValue"):
            return x if isinstance(x, str) else ...
        if tag == "boolValue":
            return True if isinstance(x, (dict, list)) else bool(x)
        if tag == "intValue":
            return x if number(x) or isinstance(x, str) and x else ...
        if tag == "doubleValue":
            return x if number(x) else ...
        inner = x.get("values") if isinstance(x, dict) else None
        inner = inner if isinstance(inner, list) else []
        if tag == "arrayValue":
            return [None if (y := _plain(e)) is ... else y for e in inner]
        named = {e["key"]: _plain(e.get("value")) for e in inner if isinstance(e, dict) and isinstance(e.get("key"), str) and e["key"]}
        return {k: y for k, y in named.items() if y is not ...}
    return None


def _folded(value, depth: int):
    """A tagged value with those that lie deeper in it than the given depth finished."""
    if not isinstance(value, dict):
        return value
    tag = next((t for t in TAGS if t in value), None)
    if tag not in ("arrayValue", "kvlistValue"):
        return {tag: value[tag]} if tag else {}
    if not depth:
        return {tag: None, DONE: _plain(value)}
    inner = value[tag].get("values") if isinstance(value[tag], dict) else None
    inner = inner if isinstance(inner, list) else []
    return {tag: {"values": [_folded(e, depth - 1) for e in inner] if tag == "arrayValue" else _entries(inner, depth - 1)}}


def _entries(entries: list, depth: int = DEPTH) -> list:
    return [e | {"value": _folded(e["value"], depth)} if isinstance(e, dict) and "value" in e else e for e in entries]


def _finished(x):
    """A payload, or a part of it above its values, with deep values finished."""
    if isinstance(x, list):
        return [_finished(e) for e in x]
    if not isinstance(x, dict):
        return x
    return {k: _entries(v) if k in _ENTRIES and isinstance(v, list) else _folded(v, DEPTH) if k == "body" else _finished(v) for k, v in x.items()}


class TooLarge(ValueError):
    """A body beyond MAX_BODY."""


def _no_number(token: str) -> None:
    raise ValueError(f"{token} is no JSON")


def _short(read):  # noqa: ANN001, ANN202
    def number(token: str):  # noqa: ANN202
        if len(token) > MAX_NUMBER:
            raise ValueError("number too long")
        return read(token)

    return number


def _longer(text: str, most: int) -> bool:
    """Whether a text has more than `most` UTF-16 units, as the JVM counts."""
    return 2 * len(text) > most and len(text.encode("utf-16-le", "surrogatepass")) > 2 * most


def check_json(text: str) -> None:
    """Raises ValueError on a text that Spark could not store: no JSON, nested beyond DEEPEST, or with a number, key or string beyond the limits."""
    try:
        layer, depth = [json.loads(text, parse_constant=_no_number, parse_int=_short(int), parse_float=_short(float))], 0
    except RecursionError as e:
        raise ValueError("nested too deep") from e
    while layer:
        if any(isinstance(x, str) and _longer(x, MAX_STRING) for x in layer):
            raise ValueError("string too long")
        if not (layer := [x for x in layer if isinstance(x, (dict, list))]):
            return
        if (depth := depth + 1) > DEEPEST:
            raise ValueError("nested too deep")
        if any(_longer(k, MAX_KEY) for x in layer if isinstance(x, dict) for k in x):
            raise ValueError("key too long")
        layer = [y for x in layer for y in (x.values() if isinstance(x, dict) else x)]


def check_text(text: str) -> None:
    """check_json for a text put together here: short ones can't break a limit."""
    if len(text) > MAX_BODY:
        raise TooLarge("Payload too large")
    if len(text) > MAX_KEY:
        check_json(text)


def _fold_deep(texts: pd.Series) -> pd.Series:
    # JSON text of Spark nests 1000 levels at most
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
    return texts.map(lambda t: None if t is None else _finished_text(t))


def finish(df: DataFrame) -> DataFrame:
    """df with the values in `payload` that are nested deeper than expressions unfold finished; only payloads that may hold some pass through Python.

    The flatteners call it, so whatever hands payloads to them, none is cut, and raw sinks keep payloads as they came. A column
    MAYBE, as parse gives it, spares payloads without containers; it goes.
    """
    on_workers(df.sparkSession)
    raw = F.to_json(F.when(F.col(MAYBE), F.col("payload")) if MAYBE in df.columns else "payload")
    folded = F.pandas_udf(_fold_deep, "string")(F.when(raw.rlike(_DEEP), raw))
    return df.withColumn("payload", F.coalesce(F.parse_json(folded), "payload")).drop(MAYBE)


def parse(df: DataFrame, body: str = "body") -> DataFrame:
    """df with `payload` (VARIANT) in place of a text column: empty bodies are {}, unreadable ones NULL; and MAYBE, whether values may lie deep.

    Values of any depth stay as they came; the flatteners finish them.
    """
    configure(df.sparkSession)
    raw = F.when(F.col(body) == "", F.lit("{}")).otherwise(F.col(body))
    # an escape may hide a name
    maybe = reduce(or_, [F.col(body).contains(x) for x in ("arrayValue", "kvlistValue", DONE, "\\u")])
    return df.withColumns({"payload": F.try_parse_json(raw), MAYBE: maybe}).drop(body)


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose payload could be read, and the others."""
    return df.filter("payload IS NOT NULL"), df.filter("payload IS NULL")


def decompress(encoding: str | None, body: bytes, most: int = MAX_BODY) -> bytes:
    """A body by its Content-Encoding; raises ValueError on an unknown one and on damage, TooLarge on one of more than `most` bytes, of which no more are unpacked."""
    encoding = (encoding or "").lower()
    try:
        if encoding == "gzip":
            with gzip.GzipFile(fileobj=io.BytesIO(body)) as f:
                body = f.read(most + 1)
        elif encoding == "deflate":
            stream = zlib.decompressobj()
            body = stream.decompress(body, most + 1)
            if len(body) <= most and not stream.eof:
                raise ValueError("incomplete or truncated stream")
        elif encoding not in ("", "identity"):
            raise ValueError(f"Unsupported Content-Encoding: {encoding}")
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(str(e)) from e
    if len(body) > most:
        raise TooLarge("Payload too large")
    return body


def in_slices(batches: Iterable[pa.RecordBatch], most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `most` bytes: a batch of Spark's holds up to 64 MB of bodies, and what Python makes of them is several times as much."""
    for b in batches:
        step = max(1, b.num_rows * most // max(1, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def decode_bodies(df: DataFrame, body: str = "body") -> DataFrame:
    """df (signal, contentType, contentEncoding and a binary body) with the body as JSON text and `error`, NULL if there is none."""
    on_workers(df.sparkSession)
    kept = [f for f in df.schema if f.name != body]

    def run(batches):
        for b in in_slices(batches):
            texts, errors = [], []
            for signal, kind, encoding, raw in zip(*(b.column(c).to_pylist() for c in ("signal", "contentType", "contentEncoding", body))):
                text = error = None
                try:
                    plain = decompress(encoding, raw or b"")
                    if (kind or "").split(";")[0].strip().lower() == "application/x-protobuf":
                        try:
                            text = decode_request(signal, plain)
                        except (ValueError, KeyError):
                            error = "Invalid protobuf"
                    else:
                        text = plain.decode("utf-8", "replace") or "{}"
                except ValueError as e:
                    error = str(e)
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_pydict({f.name: b.column(f.name) for f in kept} | {body: pa.array(texts, pa.string()), "error": pa.array(errors, pa.string())})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + f", `{body}` string, error string"
    return df.select(*[f.name for f in kept], body).mapInArrow(run, schema)


def serialized(payload: Column) -> Column:
    """The JSON line of a payload."""
    return F.to_json(payload)
