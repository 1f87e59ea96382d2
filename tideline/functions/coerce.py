"""Coercions from VARIANT values, as SQL text: a function takes the text of an expression and gives the text of another.

A flattener is some thousand nested calls; as text it reaches the JVM in one piece and is parsed there, where building it call by
call takes seconds, in every micro-batch. Column objects come from `functions.expr`.

A value is omitted (SQL NULL), an explicit null (variant null) or present. `try_variant_get` converts freely between types, so
each coercion asks for the stored type first.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

#: Levels of arrays and maps inside a value that expressions unfold; sources.payloads.finish folds what lies deeper.
DEPTH = 1
#: Key under which sources.payloads leaves a finished deep value.
DONE = "tidelineDone"
NULL = "parse_json('null')"
#: Type of a key-value array whose entries are read in one pass.
ENTRIES = "array<struct<key:variant,value:variant>>"
_fresh = count()


def each(items: str, use: Callable[[str], str]) -> str:
    """use of every element of an array."""
    x = f"x{next(_fresh)}"
    return f"transform({items}, {x} -> {use(x)})"


def let(value: str, use: Callable[[str], str]) -> str:
    """use(value) with value computed once."""
    return f"get({each(f'array({value})', use)}, 0)"


def record(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{name}', {value}" for name, value in fields.items()) + ")"


def get(value: str, kind: str, path: str = "$") -> str:
    return f"try_variant_get({value}, '{path}', '{kind}')"


def field(value: str, name: str) -> str:
    """A field of an object; NULL if absent, variant null if it is a JSON null."""
    return get(value, "variant", f"$.{name}")


def struct(*names: str, **typed: str) -> str:
    """Type of an object: fields that stay VARIANTs, and fields of types of their own.

    What is read by a type of several levels is walked once; read level by level, Spark would write every level's VARIANT anew,
    with a dictionary of its own. Absent fields are NULL, and so is all that isn't of its type, in its place.
    """
    return "struct<" + ",".join(f"`{n}`:{t}" for n, t in (dict.fromkeys(names, "variant") | typed).items()) + ">"


def shape(value: str, *names: str) -> str:
    """Fields of an object, read in one pass, as a struct of VARIANTs; absent ones are NULL. NULL for anything but an object."""
    return get(value, struct(*names))


def kind(value: str) -> str:
    return f"schema_of_variant({value})"


def is_text(value: str) -> str:
    return f"({kind(value)} = 'STRING')"


def is_number(value: str) -> str:
    """A finite number; whole ones and decimals are, unread: each reading of another type costs an expression of Spark's."""
    return f"(left({kind(value)}, 3) IN ('BIG', 'DEC') OR left({kind(value)}, 3) IN ('DOU', 'FLO') AND abs({get(value, 'double')}) < double('infinity'))"


def any_text(value: str) -> str:
    """A string, the empty one too."""
    return f"CASE WHEN {is_text(value)} THEN {get(value, 'string')} END"


def text(value: str) -> str:
    """A non-empty string."""
    return f"nullif({any_text(value)}, '')"


def number(value: str) -> str:
    """A finite number as double."""
    return f"CASE WHEN {is_number(value)} THEN {get(value, 'double')} END"


def integer(value: str) -> str:
    """A whole number as bigint; fractions, which no integer column of the protocol has, are omitted."""
    x = get(value, "double")
    return f"CASE WHEN {kind(value)} = 'BIGINT' THEN {get(value, 'bigint')} WHEN {is_number(value)} AND {x} = floor({x}) THEN {get(value, 'bigint')} END"


def number_like(value: str) -> str:
    """A finite number or a non-empty string, unchanged."""
    return f"CASE WHEN {is_text(value)} THEN CASE WHEN {get(value, 'string')} <> '' THEN {value} END WHEN {is_number(value)} THEN {value} END"


def boolean(value: str) -> str:
    return f"CASE WHEN {kind(value)} = 'BOOLEAN' THEN {get(value, 'boolean')} END"


def array(value: str) -> str:
    """The elements of an array; NULL for anything else."""
    return get(value, "array<variant>")


def known(items: str, type_: str = "array<variant>") -> str:
    """An array of a type; none for NULL."""
    return f"coalesce({items}, CAST(array() AS {type_}))"


def elements(value: str) -> str:
    """The elements of an array; none for anything else."""
    return known(array(value))


def truth(value: str) -> str:
    """Whether a script would take the value for true."""
    return (
        f"CASE WHEN {kind(value)} = 'BOOLEAN' THEN {get(value, 'boolean')} WHEN {is_text(value)} THEN {get(value, 'string')} <> '' WHEN {kind(value)} = 'VOID' THEN false"
        f" WHEN left({kind(value)}, 3) IN ('BIG', 'DOU', 'FLO', 'DEC') THEN {get(value, 'double')} <> 0 ELSE true END"
    )


#: Tags of a value in the order in which they decide.
TAGS = ("stringValue", "boolValue", "intValue", "doubleValue", "bytesValue", "arrayValue", "kvlistValue")


def any_value(value: str, depth: int = DEPTH) -> str:
    """The plain VARIANT of a tagged value. The first tag present decides, whatever it holds."""
    return let(shape(value, *TAGS, DONE), lambda s: _tagged(value, s, depth))


def _tagged(value: str, s: str, depth: int) -> str:
    """any_value of a value whose shape is known."""
    string, flag, whole, double, raw, many, named = (f"{s}.{t}" for t in TAGS)
    done = NULL if depth else f"{s}.{DONE}"
    as_array = as_map = done
    if depth:
        as_array = f"CAST({each(elements(field(many, 'values')), lambda x: f'coalesce({any_value(x, depth - 1)}, {NULL})')} AS VARIANT)"
        as_map = f"to_variant_object({attributes(get(named, ENTRIES, '$.values'), depth - 1)})"
    return (
        f"CASE WHEN {value} IS NULL THEN {NULL} WHEN {s} IS NULL THEN {value}"
        f" WHEN {string} IS NOT NULL THEN CASE WHEN {is_text(string)} THEN {string} END"
        f" WHEN {flag} IS NOT NULL THEN CAST({truth(flag)} AS VARIANT)"
        f" WHEN {whole} IS NOT NULL THEN {number_like(whole)}"
        f" WHEN {double} IS NOT NULL THEN CASE WHEN {is_number(double)} THEN {double} END"
        f" WHEN {raw} IS NOT NULL THEN CASE WHEN {is_text(raw)} THEN {raw} END"
        f" WHEN {many} IS NOT NULL THEN {as_array} WHEN {named} IS NOT NULL THEN {as_map} ELSE {done} END"
    )


def attributes(entries: str, depth: int = DEPTH) -> str:
    """The map of key-value entries (ENTRIES), empty for NULL: entries without a non-empty key are skipped, the last of a key holds, omitted values go."""
    named = each(known(entries, ENTRIES), lambda e: record(k=any_text(f"{e}.key"), v=f"{e}.value", s=shape(f"{e}.value", *TAGS, DONE)))
    pairs = each(f"filter({named}, e -> e.k <> '')", lambda e: record(key=f"{e}.k", value=_tagged(f"{e}.v", f"{e}.s", depth)))
    return f"map_filter(map_from_entries({pairs}), (k, v) -> v IS NOT NULL)"
