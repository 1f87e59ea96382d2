"""Options from arguments and environment; arguments win."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

DEFAULT_PORT, DEFAULT_OUTPUT = 4318, "./otel-data"
PORT_ENV, OUTPUT_ENV = "TIDELINE_PORT", "TIDELINE_OUTPUT_DIR"


@dataclass(frozen=True)
class Options:
    port: int = DEFAULT_PORT
    output: str = DEFAULT_OUTPUT


def whole_prefix(text: str) -> int | None:
    """The whole number that a text begins with."""
    m = re.match(r"\s*([+-]?\d+)", text)
    return int(m[1]) if m else None


def resolve_options(argv: Sequence[str], env: Mapping[str, str]) -> dict[str, int | str]:
    """The options given; what isn't given or isn't readable is left out, unknown arguments are passed over."""
    found: dict[str, int | str] = {}

    def put(name: str, value: str) -> None:
        if name == "output":
            found["output"] = value
        elif (n := whole_prefix(value)) is not None:
            found["port"] = n

    for name, variable in (("port", PORT_ENV), ("output", OUTPUT_ENV)):
        if value := env.get(variable):
            put(name, value)
    rest = list(argv)
    while rest:
        name, given, value = rest.pop(0).partition("=")
        if name not in ("--port", "--output"):
            continue
        if not given:
            if not rest or not rest[0]:
                continue
            value = rest.pop(0)
        put(name[2:], value)
    return found


def options(argv: Sequence[str], env: Mapping[str, str]) -> Options:
    found = resolve_options(argv, env)
    return Options(found.get("port", DEFAULT_PORT), found.get("output") or DEFAULT_OUTPUT)
