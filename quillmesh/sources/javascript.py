"""The outline of JavaScript and TypeScript text without a parser: strings and comments are masked, signatures are found by
regular expressions, bodies are delimited by a stack of braces."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

_OPAQUE = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)|`|/(?![/*])|[{}]""", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_NOT_LINE_END = re.compile(r"[^\n]")
_LEAD = re.compile(r"[ \t\f]*")


def blanked(text: str) -> str:
    """As many characters and lines as text, all blank."""
    return _NOT_LINE_END.sub(" ", text)


def lines_of(text: str) -> str:
    """The text with line feeds alone, whatever line ends it came with, and without a byte order mark."""
    return text.replace("\r\n", "\n").replace("\r", "\n").lstrip("﻿")


def mask(text: str) -> tuple[str, list[tuple[int, int]]]:
    """(text with strings, templates, regular expressions and comments blanked, spans of the doc blocks)."""
    docs: list[tuple[int, int]] = []
    out: list[str] = []
    at = pos = 0
    depth: list[int] = []  # open braces within each ${ } of a template

    def opaque(a: int, b: int) -> None:
        nonlocal at, pos
        out.extend((text[at:a], blanked(text[a:b])))
        at = pos = b

    def template(a: int) -> None:
        """From within a template to its end or to the next ${."""
        i = a + 1
        while i < len(text):
            c = text[i]
            if c == "\\":
                i += 2
                continue
            if c == "`":
                return opaque(a, i + 1)
            if c == "$" and text[i + 1 : i + 2] == "{":
                depth.append(0)
                return opaque(a, i + 2)
            i += 1
        opaque(a, len(text))

    while m := _OPAQUE.search(text, pos):
        s, x = m.start(), m[0]
        if x == "`":
            template(s)
        elif x == "{":
            if depth:
                depth[-1] += 1
            pos = m.end()
        elif x == "}":
            pos = m.end()
            if depth:
                if depth[-1] == 0:
                    depth.pop()
                    template(s)
                else:
                    depth[-1] -= 1
        elif x == "/":
            before = text[max(0, s - 40) : s].rstrip()
            word = re.search(r"[\w$]+$", before)
            literal = not before or before[-1] in "(,=:[!&|?{};+-*%~^<>" or (word and word[0] in ("return", "typeof", "case", "in", "of", "void", "delete"))
            r = _REGEX.match(text, s) if literal else None
            if r:
                opaque(s, r.end())
            else:
                pos = m.end()
        else:
            if x.startswith("/**") and len(x) > 4 and x.endswith("*/"):
                docs.append((s, m.end()))
            opaque(s, m.end())
    out.append(text[at:])
    return "".join(out), docs


@dataclass(slots=True)
class Part:
    """A function or method. qual: the name behind those of the enclosing classes and functions; owner: the innermost class
    or named object it is a member of; form: function, binding, method or member; level: enclosing functions; doc: the
    block directly before it."""

    qual: str
    name: str
    owner: str | None
    form: str
    level: int
    start: int
    value: int
    end: int
    doc: tuple[int, int] | None


_ID = r"[A-Za-z_$][\w$]*"
_VALUE = rf"(?:async\b\s*)?(?:(?P<{{0}}f>function\b\s*\*?\s*[\w$]*\s*(?:<[^(){{{{}}}};]*>)?\s*(?=\())|(?P<{{0}}a>(?:<[^(){{{{}}}};=]*>\s*)?(?=\())|(?P<{{0}}x>{_ID}\s*=>)|(?P<{{0}}c>class\b[^{{{{;]*\{{{{))"
_SIGN = re.compile(
    rf"""(?P<cls>\b(?:export\s+(?:default\s+)?)?(?:abstract\s+)?class(?:\s+(?P<cname>(?!extends\b|implements\b){_ID}))?(?:\s*<[^{{;(]*>)?(?:\s+(?:extends|implements)\b[^{{;]*)?\s*\{{)
    |(?P<fun>\b(?:export\s+(?:default\s+)?)?(?:async\s+)?function\b\s*\*?\s*(?P<fname>{_ID})\s*(?:<[^(){{}};]*>)?\s*(?=\())
    |(?P<var>\b(?:export\s+(?:default\s+)?)?(?:const|let|var)\s+(?P<vname>{_ID})\s*(?::[^=;{{}}]*(?:=>[^=;{{}}]*)?)?=\s*(?:(?P<vo>\{{)|{_VALUE.format("v")}))
    |(?P<mem>(?:(?:public|private|protected|static|override|readonly|declare)\s+)*(?:{_ID}\s*\.\s*)*(?P<aname>\#?{_ID})\s*(?::[^=;{{}}()]*(?:\([^()]*\)\s*=>[^=;{{}}]*)?)?=(?![=>])\s*{_VALUE.format("m")})
    |(?P<key>(?P<kname>{_ID})\s*:\s*(?:(?P<ko>\{{)|{_VALUE.format("k")}))
    |(?P<met>(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*(?:async\s*(?=\*))?(?:\*\s*)?(?P<mname>\#?{_ID}|\[\s*{_ID}(?:\.{_ID})*\s*\])\s*(?:<[^(){{}};]*>)?\s*(?=\())
    |(?P<open>\{{)|(?P<close>\}})|(?P<semi>;)""",
    re.X,
)
# Words of the language that stand before a bracket and name no function.
_WORDS = frozenset("if for while switch catch return function new typeof await super import do else try with case of in throw delete void yield class".split())
_TYPE = re.compile(r"\s*(?::\s*[^{};]*?)?\s*(?=\{)")
_ARROW = re.compile(r"\s*(?::[^={};]*(?:\{[^{}]*\}[^={};]*)?)?\s*=>\s*")
_BRACKET = re.compile(r"[()\[\]{}]")
_STOP = re.compile(r"[;\n]")
_BEFORE_OBJECT = re.compile(r"(?:[=(,:\[?&|]|\b(?:return|default))\s*$")


def closing(masked: str, at: int) -> int:
    """Behind the bracket that closes the one at `at`, or -1."""
    depth = 0
    for m in _BRACKET.finditer(masked, at):
        if m[0] in "([{":
            depth += 1
        else:
            depth -= 1
            if depth == 0:
                return m.end()
    return -1


def outline(text: str, masked: str | None = None, docs: list[tuple[int, int]] | None = None) -> list[Part]:
    """Function declarations, functions and arrows bound to names, members or keys, and methods of classes and objects, in
    the order of the text. text has line feeds alone."""
    if masked is None or docs is None:
        masked, docs = mask(text)
    ends = [e for _, e in docs]
    found: list[Part] = []
    stack: list[tuple[str, str, Part | None]] = []  # kind (class, object, fun, block), name, function
    pos = 0

    def add(name: str, start: int, form: str) -> Part:
        k = bisect.bisect_right(ends, start) - 1
        doc = docs[k] if k >= 0 and not text[ends[k] : start].strip() else None
        around = [n for kind, n, _ in stack if n and kind != "object"]
        owner = stack[-1][1] if stack and stack[-1][0] in ("class", "object") else None
        p = Part(".".join([*around, name]), name, owner or None, form, sum(kind == "fun" for kind, _, _ in stack), start, start, len(text), doc)
        found.append(p)
        return p

    def body(p: Part, at: int) -> int:
        """Open the body if it starts at `at`; an expression ends where its line does, behind what it has open."""
        if masked[at : at + 1] == "{":
            stack.append(("fun", p.name, p))
            return at + 1
        e = _STOP.search(masked, at)
        p.end = e.start() if e else len(text)
        return at

    def bound(m: re.Match, g: str, name: str, form: str) -> int:
        """What is bound to a name: a class, an arrow or a function."""
        if m[f"{g}c"] is not None:
            stack.append(("class", name, None))
            return m.end()
        at = min(m.start(f"{g}{x}") for x in "fax" if m[f"{g}{x}"] is not None)
        if m[f"{g}x"] is not None:
            past = m.end()
            past += _LEAD.match(masked, past).end() - past
        else:
            past = closing(masked, m.end())
            t = (_TYPE if m[f"{g}f"] is not None else _ARROW).match(masked, past) if past > 0 else None
            if not t:
                return m.end()
            past = t.end()
        p = add(name, m.start(), form)
        p.value = at
        return body(p, past)

    while m := _SIGN.search(masked, pos):
        pos = m.end()
        top = stack[-1][0] if stack else ""
        if m["open"]:
            literal = _BEFORE_OBJECT.search(masked[max(0, m.start() - 40) : m.start()])
            stack.append(("object" if literal else "block", "", None))
        elif m["close"]:
            if stack:
                p = stack.pop()[2]
                if p:
                    p.end = m.end()
        elif m["semi"]:
            continue
        elif m["cls"]:
            stack.append(("class", m["cname"] or "", None))
        elif m["fun"]:
            past = closing(masked, m.end())
            t = _TYPE.match(masked, past) if past > 0 else None
            if t:
                p = add(m["fname"], m.start(), "function")
                pos = body(p, t.end())
        elif m["var"]:
            if m["vo"]:
                stack.append(("object", m["vname"], None))
            else:
                pos = bound(m, "v", m["vname"], "binding")
        elif m["mem"]:
            pos = bound(m, "m", m["aname"], "member")
        elif m["key"]:
            if m["ko"]:
                stack.append(("object" if top == "object" else "block", "", None))
            elif top == "object":
                pos = bound(m, "k", m["kname"], "member")
            else:
                pos = m.end("kname") + 1
        elif m["met"]:
            if top not in ("class", "object") or m["mname"] in _WORDS:
                continue
            past = closing(masked, m.end())
            t = _TYPE.match(masked, past) if past > 0 else None
            if t:
                pos = body(add(m["mname"].replace(" ", ""), m.start(), "method"), t.end())
    return found
