"""Functions paired with their documentation."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.javascript import blanked, lines_of, outline

PAIRS = "location string, lang string, qual_name string, start_line int, line_distance int, code string, description string"
PAIRS_ARROW = pa.schema([("location", pa.string()), ("lang", pa.string()), ("qual_name", pa.string()), ("start_line", pa.int32()), ("line_distance", pa.int32()), ("code", pa.string()), ("description", pa.string())])
MIN_WORDS = 5

_PY_OPAQUE = re.compile(
    r"""(?P<str>(?P<pre>\b[rRbBuUfFtT]{1,2})?(?:\"{3}(?:[^\\]|\\.)*?(?:\"{3}|\Z)|'{3}(?:[^\\]|\\.)*?(?:'{3}|\Z)|"(?:[^"\\\n]|\\.)*(?:"|(?=\n)|\Z)|'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z)))|(?P<com>\#[^\n]*)""",
    re.S,
)


def mask_python(text: str) -> tuple[str, dict[int, tuple[int, str]]]:
    """(text with strings and comments blanked, start of each string -> (end, prefix))."""
    strings: dict[int, tuple[int, str]] = {}
    out, at = [], 0
    for m in _PY_OPAQUE.finditer(text):
        out += [text[at : m.start()], blanked(m[0])]
        at = m.end()
        if m["str"] is not None:
            strings[m.start()] = (m.end(), (m["pre"] or "").lower())
    out.append(text[at:])
    return "".join(out), strings


@dataclass(slots=True)
class Found:
    qual_name: str
    start: int
    end: int
    doc: str | None
    distance: int


_PY_SIGN = re.compile(r"(?P<async>async[ \t]+)?(?P<kind>def|class)[ \t\f]+(?P<name>\w+)")
_PY_AFTER = re.compile(r"[ \t\f]*(?:\n|;|\Z)")


def python_functions(text: str) -> list[Found]:
    """Functions and methods at any nesting, delimited by a stack of indents. text has line feeds alone."""
    masked, strings = mask_python(text)
    found: list[Found] = []
    stack: list[tuple[int, str, Found | None]] = []  # indent, name, function
    pos = depth = 0
    joined = False
    last = 0
    for line in masked.split("\n"):
        code = line.strip()
        lead = len(line) - len(line.lstrip(" \t\f"))
        real = bool(code) or pos + _lead_of(text, pos) in strings
        if real:
            sign = _PY_SIGN.match(line, lead) if code else None
            if sign and depth:
                depth, joined = 0, False  # nothing is defined within brackets: one before was never closed
            if not depth and not joined:
                indent = len(text[pos : pos + _lead_of(text, pos)].expandtabs(8))
                while stack and stack[-1][0] >= indent:
                    f = stack.pop()[2]
                    if f:
                        f.end = last
                if sign:
                    name = ".".join([*(s[1] for s in stack), sign["name"]])
                    f = None
                    if sign["kind"] == "def":
                        doc, gap = _docstring(text, masked, strings, pos + sign.end(), indent)
                        f = Found(name, pos + lead, len(text), doc, gap)
                        found.append(f)
                    stack.append((indent, sign["name"], f))
            depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
            joined = line.endswith("\\")
            last = pos + len(line)
        pos += len(line) + 1
    for _, _, f in stack:
        if f:
            f.end = last
    return found


_LEAD = re.compile(r"[ \t\f]*")


def _lead_of(text: str, pos: int) -> int:
    return _LEAD.match(text, pos).end() - pos


def _docstring(text: str, masked: str, strings: dict[int, tuple[int, str]], at: int, indent: int) -> tuple[str | None, int]:
    """The string literal that is the first statement of the body, and the lines between it and the signature."""
    depth, i = 0, at
    for m in re.compile(r"[()\[\]{}:]").finditer(masked, at):
        c = m[0]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif depth == 0:
            i = m.end()
            break
    else:
        return None, 0
    colon = i
    while True:  # over blank space and comments
        m = re.compile(r"\s*(?:#[^\n]*)?").match(text, i)
        if m.end() == i:
            break
        i = m.end()
    if i not in strings:
        return None, 0
    own = text.rfind("\n", 0, i) + 1
    if own > colon and len(text[own:i].expandtabs(8)) <= indent:
        return None, 0
    parts = []
    j = i
    while j in strings:  # adjacent literals are one
        end, prefix = strings[j]
        if "b" in prefix or "f" in prefix or "t" in prefix:
            return None, 0
        body = text[j + len(prefix) : end]
        q = 3 if body[:3] in ('"""', "'''") else 1
        body = body[q:-q] if body.endswith(body[:q]) and len(body) >= 2 * q else body[q:]
        parts.append(body if "r" in prefix else re.sub(r"\\\n", "", body))
        j = end + _lead_of(text, end)
    if not _PY_AFTER.match(masked, j):
        return None, 0
    return "".join(parts), text.count("\n", colon, i)


def javascript_functions(text: str) -> list[Found]:
    """Function declarations, functions and arrows bound to names, members or keys, and methods of classes and objects, by a
    stack of braces."""
    out = []
    for x in outline(text):
        doc = text[x.doc[0] + 3 : x.doc[1] - 2] if x.doc else None
        out.append(Found(x.qual, x.start, x.end, doc, text.count("\n", x.doc[1], x.start) if x.doc else 0))
    return out


# Headings of parts that describe parameters, returns, types and examples.
_HEADINGS = "args|arguments|arg|parameters|parameter|params|param|keyword args|keyword arguments|other parameters|returns|return|return value|return type|rtype|yields|yield|raises|raise|throws|exceptions|attributes|types|type|examples|example|parámetros|devuelve|paramètres|retourne|renvoie|rückgabe|argumente"
_HEADING = re.compile(rf"\s*(?:{_HEADINGS})\s*:?\s*$", re.I)
_HEADING_INLINE = re.compile(rf"\s*(?:{_HEADINGS})\s*:\s+\S", re.I)
_RULE = re.compile(r"\s*[-=~^]{3,}\s*$")
_FIELD = re.compile(r"\s*:(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|var|ivar|cvar|vartype|returns?|rtype|yields?|meta)\b[^:]*:")
_TAG = re.compile(r"\s*[@\\](?!desc(?:ription)?\b|summary\b|remarks\b|brief\b|details\b)[a-zA-Z]+\b")
_PROSE_TAG = re.compile(r"\s*[@\\](?:desc(?:ription)?|summary|remarks|brief|details)\b")
_NOTE = re.compile(
    r"""\b(?:TODO|FIXME|XXX|TBD|TBA|WIP|HACK)\b|^\W*(?:todo|fixme|xxx|tbd|tba|wip|n/?a)\b
    |\b(?:doc(?:s|umentation|strings?)?|descriptions?|comments?|text|explanation)\b.{0,30}\b(?:pending|missing|follows?|later|soon|needed|(?:still\s+)?to\s+(?:be|follow|come|do)|not\s+(?:yet\s+)?(?:written|available))\b
    |\b(?:to\s+be|still|yet\s+to\s+be)\s+(?:documented|described|written|done|added|filled)\b
    |\b(?:add|write|insert|put|needs?|missing)\s+(?:a\s+|the\s+|some\s+)?(?:doc(?:s|umentation|strings?)?|descriptions?|comments?)\b
    |auto-?generated\b.{0,20}\b(?:stub|method)|\b(?:beschreibung|dokumentation|doku)\b.{0,20}\b(?:folgt|fehlt)\b|\bà\s+(?:documenter|compléter)\b|\bpor\s+documentar\b|\bdocumentación\s+pendiente\b""",
    re.X | re.I,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\dA-Za-z_]+")


def prose(doc: str, javascript: bool) -> str:
    """The documentation without its descriptions of parameters, returns and types, without headings, examples in code
    and notes that documentation is still to be written."""
    lines = []
    for x in doc.split("\n"):
        lines.append(re.sub(r"^\s*\*+ ?", "", x) if javascript else x)
    kept: list[str] = []
    skip: str | None = None  # what ends the part being left out
    base = 0
    for i, x in enumerate(lines):
        bare = x.strip()
        lead = len(x.expandtabs(8)) - len(x.expandtabs(8).lstrip())
        nxt = lines[i + 1] if i + 1 < len(lines) else ""
        if _PROSE_TAG.match(x):
            skip = None
            x = _PROSE_TAG.sub("", x)
        elif _TAG.match(x) and (javascript or re.match(r"\s*@(?:param|type|returns?|rtype|raises?|arg)\b", x)):
            skip = "tag"
            continue
        elif _FIELD.match(x):
            skip, base = "indent", lead
            continue
        elif _HEADING.match(x) and (_RULE.match(nxt) or bare.endswith(":") or skip):
            skip, base = ("rule" if _RULE.match(nxt) else "indent+"), lead
            continue
        elif _HEADING_INLINE.match(x):
            skip, base = "indent", lead
            continue
        elif _RULE.match(x):
            continue
        elif skip == "tag":
            continue
        elif skip == "rule":
            if not bare:
                after = [y for y in lines[i + 1 :] if y.strip()]
                if after and not re.match(r"\s*\*{0,2}\w+\s*:|\s{3,}", after[0]) and not _HEADING.match(after[0]):
                    skip = None
            continue
        elif skip in ("indent", "indent+"):
            if not bare:
                if skip == "indent+":
                    skip = "indent"
                continue
            if skip == "indent+" or lead > base:
                continue
            skip = None
        if bare.startswith(">>>") or bare.startswith("```"):
            continue
        kept.append(x)
    text = "\n".join(kept)
    out = []
    for para in re.split(r"\n\s*\n", text):
        for sentence in re.split(r"(?<=[.!?])\s+", " ".join(para.split())):
            if not _NOTE.search(sentence):
                out.append(sentence)
    return " ".join(out).strip()


def says_enough(name: str, doc: str, javascript: bool, min_words: int = MIN_WORDS) -> bool:
    """Whether at least min_words words of prose remain besides those of the function's own name."""
    own = {p.lower() for p in _NAME_PART.findall(name)} | {name.lower()}
    text = re.sub(rf"(?<!\w){re.escape(name)}(?!\w)", " ", prose(doc, javascript))
    return sum(1 for w in _WORD.findall(text) if w.lower() not in own) >= min_words


def description(doc: str, javascript: bool) -> str:
    lines = [re.sub(r"^\s*\*+ ?", "", x) if javascript else x.expandtabs(8) for x in doc.strip().split("\n")]
    lead = min((len(x) - len(x.lstrip()) for x in lines[1:] if x.strip()), default=0)
    return "\n".join([lines[0].strip(), *(x[lead:].rstrip() for x in lines[1:])]).strip()


def _extract(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for location, lang, content in zip(*(b.column(c).to_pylist() for c in ("location", "lang", "content")), strict=True):
                js = (lang or "").strip().lower() != "python"
                text = lines_of(content)
                line_starts = [m.end() for m in re.finditer("\n", text)]
                for f in javascript_functions(text) if js else python_functions(text):
                    if f.doc is not None and says_enough(f.qual_name.rpartition(".")[2], f.doc, js, min_words):
                        rows.append((location, lang, f.qual_name, bisect.bisect_right(line_starts, f.start) + 1, f.distance, text[f.start : f.end].rstrip(), description(f.doc, js)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(PAIRS_ARROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PAIRS_ARROW.types, strict=True)], schema=PAIRS_ARROW)

    return run


def function_pairs(files: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per function or method with sufficient documentation: location, lang, qual_name, start_line, line_distance
    (from the signature or, in javascript, from the block before it), code, description.

    files: file_id, location, lang (`python`, all else is read as javascript), content, delivered_at. Of a location
    the content with the latest delivered_at counts (at equal times the largest file_id). Rows with a null location
    or content hold nothing. Redefinitions of a name each give a row. Other columns are ignored.
    """
    src = files.filter(F.col("location").isNotNull() & F.col("content").isNotNull())
    latest = src.groupBy("location").agg(F.max_by(F.struct("lang", "content"), F.struct(F.col("delivered_at").isNotNull(), "delivered_at", "file_id")).alias("f"))
    return latest.select("location", "f.lang", "f.content").mapInArrow(_extract(min_words), PAIRS)
