"""Literals of JavaScript read from text: objects, lists, strings, numbers and names, as far as they are written out."""

from __future__ import annotations

import re
from dataclasses import dataclass

_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?\*/)*", re.S)
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?(?![\w$])")
_ESCAPE = re.compile(r"\\(u\{[0-9a-fA-F]+\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\n|.)", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": ""}


@dataclass(frozen=True)
class Name:
    """A name, or a chain of names joined by dots."""

    text: str


@dataclass(frozen=True)
class Opaque:
    """Anything that is no literal: a call, a function, an expression."""

    text: str


@dataclass
class Entry:
    """The value of a key with the place it begins at."""

    value: object
    start: int
    end: int


def skip(text: str, at: int) -> int:
    """Behind blank space and comments."""
    return _SKIP.match(text, at).end()


def unquoted(body: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        if x[0] in "ux" and len(x) > 1:
            return chr(int(x[1:].strip("{}"), 16))
        return _SIMPLE.get(x, x)

    return _ESCAPE.sub(one, body)


def past(text: str, masked: str, at: int, stops: str) -> int:
    """The place of the first of the stops outside brackets. masked: the text without strings and comments."""
    depth = 0
    for i in range(at, len(masked)):
        c = masked[i]
        if not depth and c in stops:
            return i
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth < 0:
                return i
    return len(masked)


def parse(text: str, masked: str, at: int) -> Entry:
    """The value that begins at `at`, ended by a comma, a closing bracket or a semicolon outside of it.

    Objects become dicts of Entry in their order (spread and computed keys are left out), lists lists of Entry; strings,
    also templates without a hole, str; numbers float. Containers nest by recursion as the text does, which sources keep
    shallow; a text deeper than the interpreter allows is opaque."""
    at = skip(text, at)
    end = past(text, masked, at, ",;")
    whole = text[at:end].rstrip()
    stop = at + len(whole)
    try:
        value = _value(text, masked, at, stop)
    except RecursionError:
        value = Opaque(whole)
    return Entry(value, at, end)


def _value(text: str, masked: str, at: int, stop: int) -> object:
    whole = text[at:stop]
    c = whole[:1]
    if c in ("'", '"') and len(whole) > 1 and whole[-1] == c and not masked[at:stop].strip():
        body = whole[1:-1]
        return unquoted(body) if not re.search(rf"(?<!\\)(?:\\\\)*{c}", body) else Opaque(whole)
    if c == "`" and len(whole) > 1 and whole[-1] == "`" and "${" not in whole and not masked[at:stop].strip():
        return unquoted(whole[1:-1])
    if _NUMBER.fullmatch(whole):
        return float(whole)
    if whole in ("true", "false", "null", "undefined"):
        return {"true": True, "false": False}.get(whole)
    if c in "{[" and past(text, masked, at + 1, "") == stop - 1:
        return _object(text, masked, at, stop) if c == "{" else _list(text, masked, at, stop)
    if _NAME.fullmatch(whole):
        return Name(whole)
    return Opaque(whole)


def _list(text: str, masked: str, at: int, stop: int) -> list[Entry]:
    out, i = [], skip(text, at + 1)
    while i < stop - 1:
        e = parse(text, masked, i)
        out.append(e)
        i = skip(text, e.end + 1)
    return out


def _object(text: str, masked: str, at: int, stop: int) -> dict[str, Entry]:
    out: dict[str, Entry] = {}
    i = skip(text, at + 1)
    while i < stop - 1:
        end = past(text, masked, i, ",")
        colon = past(text, masked, i, ":,")
        raw = text[i:colon].strip()
        if colon < end and not raw.startswith(("...", "[")):
            key = unquoted(raw[1:-1]) if raw[:1] in ("'", '"') else raw
            out[key] = parse(text, masked, colon + 1)
        elif _NAME.fullmatch(text[i:end].strip()):  # a name alone stands for itself
            out[text[i:end].strip()] = Entry(Name(text[i:end].strip()), i, end)
        elif m := re.match(r"(?:async\s+)?\*?\s*([A-Za-z_$][\w$]*)\s*\(", masked[i:end]):
            out[m[1]] = Entry(Opaque(text[i:end].strip()), i, end)
        i = skip(text, end + 1)
    return out


def plain(e: Entry | object) -> object:
    """A value without the places, for storing: names and expressions as their text."""
    v = e.value if isinstance(e, Entry) else e
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain(x) for x in v]
    if isinstance(v, Name | Opaque):
        return v.text
    return int(v) if isinstance(v, float) and v == int(v) else v
