"""JSON texts of uncertain quality, decoded one way everywhere."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring
from typing import Any

BAD = object()
SPACE = re.compile(r"[ \t\n\r]*")
SCALAR = re.compile(r"-?(?:0|[1-9][0-9]*)((?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)|true|false|null")
NAMED = {"true": True, "false": False, "null": None}


def _no_constant(name: str) -> Any:
    raise ValueError(name)


def loads_deep(text: str) -> Any:
    """The value of a JSON text of any depth: containers are kept on a stack of their own."""
    at = 0
    opened: list = []  # open containers; an object is followed by the key its next value belongs to

    def skip(i: int) -> int:
        return SPACE.match(text, i).end()

    def key(i: int) -> tuple[str, int]:
        if text[i] != '"':
            raise ValueError("a key is expected")
        name, i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i] != ":":
            raise ValueError("a colon is expected")
        return name, skip(i + 1)

    at = skip(at)
    while True:
        c = text[at]
        if c in "{[":
            value: Any = {} if c == "{" else []
            at = skip(at + 1)
            if text[at] != "}]"[c == "["]:
                name = None
                if c == "{":
                    name, at = key(at)
                opened.append([value, name])
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            m = SCALAR.match(text, at)
            if m is None:
                raise ValueError("a value is expected")
            at = m.end()
            value = NAMED[m[0]] if m[0] in NAMED else float(m[0]) if m[1] or len(m[0]) > 4000 else int(m[0])
        while True:  # a value is complete: into its container, and out of those that end with it
            at = skip(at)
            if not opened:
                if at != len(text):
                    raise ValueError("more than one value")
                return value
            owner, name = opened[-1]
            if name is None:
                owner.append(value)
            else:
                owner[name] = value
            c = text[at]
            at = skip(at + 1)
            if c == ",":
                if name is not None:
                    opened[-1][1], at = key(at)
                break
            if c != ("]" if name is None else "}"):
                raise ValueError("an end is expected")
            value = opened.pop()[0]


def decode(text: str | None) -> Any:
    """The value of a JSON text, or ``BAD`` for null, empty, cut-off or otherwise invalid JSON.

    A text that was encoded as a JSON string (once or more) counts as its content. NaN and Infinity are invalid.
    Nesting of any depth is read, the deepest without recursion.
    """
    value: Any = text
    while isinstance(value, str):
        if not value.strip():
            return BAD
        try:
            value = json.loads(value, parse_constant=_no_constant)
        except RecursionError:
            try:
                value = loads_deep(value)
            except (ValueError, IndexError):
                return BAD
        except ValueError as e:
            if "integer string conversion" not in str(e):
                return BAD
            try:
                value = json.loads(value, parse_constant=_no_constant, parse_int=float)
            except (ValueError, RecursionError):
                return BAD
    return BAD if value is None else value


def clean(text: str) -> str:
    """``text`` without lone surrogates (they come from JSON escapes and cannot be stored as UTF-8)."""
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()
