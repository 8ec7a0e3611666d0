"""Text and JSON normal forms shared by problems 2 and 7."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

WORDS = re.compile(r"[^\W_]+")


def parsed(payload: str | None):
    """The JSON value, or None with False where the text isn't JSON."""
    if payload is None:
        return None, True
    try:
        return json.loads(payload), True
    except (ValueError, RecursionError):
        return payload, False


def strings(value, key: str | None = None) -> Iterator[str]:
    """All string values, and the keys of `pairs`, but no field names."""
    stack = [(value, key)]
    while stack:
        v, k = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, list):
            stack.extend((x, None) for x in v)
        elif isinstance(v, dict):
            if k == "pairs":
                yield from v
            stack.extend((x, name) for name, x in v.items())


def words(text: str | None, payload: str | None) -> set[str]:
    found = set(WORDS.findall((text or "").lower()))
    value, _ = parsed(payload)
    for s in strings(value):
        found.update(WORDS.findall(s.lower()))
    return found


def plain(text: str) -> str:
    """Letters and digits only, without case."""
    return "".join(WORDS.findall(text.lower()))


def canonical(value) -> str:
    """A string that two JSON values share if they agree in their letters and digits: field order is free, list
    order isn't, numbers are compared by value, and strings never equal numbers."""
    if value is None:
        return "n"
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, (int, float)):
        same = isinstance(value, float) and value.is_integer() and abs(value) < 1e15
        return f"#{int(value) if same else value}"
    if isinstance(value, str):
        return f'"{plain(value)}'
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(sorted(f"{plain(k)}:{canonical(v)}" for k, v in value.items())) + "}"


def record(kind: str | None, text: str | None, payload: str | None) -> str:
    """The full comparison key of a question."""
    value, _ = parsed(payload)
    try:
        body = canonical(value)
    except RecursionError:  # nested beyond reason: compared as a text
        body = f'"{plain(payload or "")}'
    return "\x1f".join(("\x00" if kind is None else kind, "\x00" if text is None else plain(text), body))
