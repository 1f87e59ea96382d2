"""Timestamps and durations from nanosecond counts given as strings or whole numbers; SQL text like coerce."""

from __future__ import annotations

from .coerce import get, is_number, is_text, let

#: Milliseconds either side of 1970 that a date can express, in nanoseconds.
LIMIT = 8_640_000_000_000_000 * 1_000_000 + 999_999
#: What is less than that and fits a bigint.
NEAR = 10**18 - 1
SPACE = r"[\s\x{00A0}\x{FEFF}\x{2028}\x{2029}\p{Zs}]+"
_COUNT = "DECIMAL(38,0)"


def nanos(value: str) -> str:
    """The count as decimal(38,0). Strings are whole numbers with sign and surrounding space, empty ones 0; numbers pass through double."""
    raw, double = get(value, "string"), get(value, "double")
    # most counts are plain digits that fit a bigint; they are read once
    odd = let(f"regexp_replace({raw}, r'^{SPACE}|{SPACE}$', '')", lambda s: f"CASE WHEN {s} = '' THEN CAST(0 AS {_COUNT}) WHEN {s} RLIKE r'^[+-]?[0-9]{{1,38}}$' THEN try_cast({s} AS {_COUNT}) END")
    return (
        f"CASE WHEN {is_text(value)} THEN coalesce(CAST(try_cast(regexp_extract({raw}, '^[0-9]{{1,19}}$', 0) AS BIGINT) AS {_COUNT}), {odd})"
        f" WHEN {is_number(value)} AND {double} = floor({double}) THEN try_cast({double} AS {_COUNT}) END"
    )


def millis_of(count: str) -> str:
    """Whole milliseconds of a count, cut toward zero; NULL beyond what a date can express."""
    # DIV wraps beyond bigint, so the range is checked before; division of bigints is the cheaper one
    far = f"CASE WHEN abs({count}) <= CAST('{LIMIT}' AS {_COUNT}) THEN {count} END DIV CAST(1000000 AS {_COUNT})"
    return f"CASE WHEN abs({count}) <= CAST('{NEAR}' AS {_COUNT}) THEN CAST({count} AS BIGINT) DIV 1000000 ELSE {far} END"


def time_of(count: str) -> str:
    """The timestamp of a count, cut to milliseconds."""
    return f"timestamp_millis({millis_of(count)})"


def iso_at(t: str) -> str:
    """YYYY-MM-DDTHH:mm:ss.sssZ in UTC of a timestamp; years outside 0 to 9999 have a sign and six digits."""
    rest = f"date_format({t}, \"-MM-dd'T'HH:mm:ss.SSS'Z'\")"
    odd = f"concat(CASE WHEN year({t}) BETWEEN 0 AND 9999 THEN lpad(CAST(year({t}) AS STRING), 4, '0') ELSE concat(CASE WHEN year({t}) < 0 THEN '-' ELSE '+' END, lpad(CAST(abs(year({t})) AS STRING), 6, '0')) END, {rest})"
    return f"CASE WHEN {t} BETWEEN TIMESTAMP_SECONDS(-62135596800) AND TIMESTAMP_MILLIS(253402300799999) THEN date_format({t}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") ELSE {odd} END"


def iso_of(count: str) -> str:
    return let(time_of(count), iso_at)


def iso(value: str) -> str:
    return let(nanos(value), iso_of)


def duration_of(start: str, end: str) -> str:
    """Milliseconds between two counts with their fraction; omitted if either is missing or the end comes first."""
    span = f"try_subtract({end}, {start})"
    return f"CASE WHEN {span} >= 0 THEN CAST({span} AS DOUBLE) / 1e6 END"


def duration_ms(start: str, end: str) -> str:
    return let(nanos(start), lambda a: let(nanos(end), lambda b: duration_of(a, b)))
