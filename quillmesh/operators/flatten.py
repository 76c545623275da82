"""Deeply nested semi-structured records to related flat tables, by shared inlining."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

#: Edges of the schema graph that the driver takes; records of more are refused, as their field names are data.
MOST_EDGES = 200_000
SHREDDED = "record_id long, table_name string, pos_path string, parent_table string, parent_path string, entry_key string, value string, fields map<string,string>"
SHREDDED_ARROW = pa.schema([("record_id", pa.int64()), *[(c, pa.string()) for c in ("table_name", "pos_path", "parent_table", "parent_path", "entry_key", "value")], ("fields", pa.map_(pa.string(), pa.string()))])


class _Number(str):
    """A JSON number as it is written."""


def _refuse(_: str) -> None:
    raise ValueError("not JSON")


def _decode(text: str) -> object:
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse)
    except RecursionError:
        return _decode_deep(text)


_STRING = r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"'
_NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?"
_GAP = r"[ \t\n\r]*"


def _decode_deep(text: str) -> object:
    """JSON of any depth, without recursion: open containers are kept on a list."""
    token = re.compile(rf"{_GAP}(?:(?P<s>{_STRING})|(?P<n>{_NUMBER})|(?P<w>true|false|null)|(?P<p>[\[\]{{}}:,])){_GAP}")
    top: list = []
    open_: list[tuple[object, list]] = [(top, [])]  # container, key waiting for its value
    want = "value"  # what may come: value, first (a value or the end), key, firstkey, colon, more
    at = 0
    while at < len(text):
        m = token.match(text, at)
        if m is None:
            _refuse(text)
        at = m.end()
        box, key = open_[-1]
        p = m["p"]
        if p in ("]", "}"):
            if len(open_) == 1 or isinstance(box, list) != (p == "]") or want not in (("first", "more") if p == "]" else ("firstkey", "more")):
                _refuse(text)
            open_.pop()
            want = "more"
        elif p == ":":
            if want != "colon":
                _refuse(text)
            want = "value"
        elif p == ",":
            if want != "more" or len(open_) == 1:
                _refuse(text)
            want = "value" if isinstance(box, list) else "key"
        elif want in ("key", "firstkey"):
            if m["s"] is None:
                _refuse(text)
            key.append(json.loads(m["s"]))
            want = "colon"
        elif want in ("value", "first"):
            v: object = [] if p == "[" else {} if p == "{" else json.loads(m["s"]) if m["s"] else _Number(m["n"]) if m["n"] else {"true": True, "false": False, "null": None}[m["w"]]
            if isinstance(box, dict):
                box[key.pop()] = v
            else:
                box.append(v)
            if p:
                open_.append((v, []))
            want = "first" if p == "[" else "firstkey" if p == "{" else "more"
        else:
            _refuse(text)
    if len(open_) > 1 or len(top) != 1:
        _refuse(text)
    return top[0]


def _encode(v: object) -> str:
    """The text of a value of any depth, numbers as they were written."""
    out: list[str] = []
    todo: list = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):  # a piece of text
            out.append(x[0])
        elif isinstance(x, dict | list):
            ends = "{}" if isinstance(x, dict) else "[]"
            parts: list = [(ends[0],)]
            for i, e in enumerate(x):
                if i:
                    parts.append((", ",))
                if ends == "{}":
                    parts += [(json.dumps(e, ensure_ascii=False) + ": ",), x[e]]
                else:
                    parts.append(e)
            parts.append((ends[1],))
            todo += reversed(parts)
        else:
            out.append(x if isinstance(x, _Number) else json.dumps(x, ensure_ascii=False))
    return "".join(out)


def parse_json(text: str | None) -> tuple[bool, object]:
    """(is valid JSON, value); a leading byte order mark and JSON text within JSON strings, however often, are resolved."""
    value: object = text
    while isinstance(value, str) and not isinstance(value, _Number):
        try:
            value = _decode(value.lstrip("﻿"))
        except ValueError:
            return (value is not text), value
    return text is not None, value


def as_text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return _encode(v)


def entries(value: object) -> list[tuple[int, str | None, object]]:
    """(place, key, entry) of a repeated field in any of its spellings: a list, one object alone, an object of objects,
    or one of these as JSON text. Anything else has no entries."""
    if isinstance(value, str) and not isinstance(value, _Number):
        ok, value = parse_json(value)
        if not ok or isinstance(value, str):
            return []
    if isinstance(value, list):
        return [(i, None, x) for i, x in enumerate(value)]
    if isinstance(value, dict):
        if all(isinstance(x, dict) for x in value.values()):
            return [(i, k, x) for i, (k, x) in enumerate(value.items())]
        return [(0, None, value)]
    return []


def holder(value: object, field: str) -> dict | None:
    """The object that has the field: the value itself, or the one object standing as the value of its single field."""
    if isinstance(value, dict):
        if field in value:
            return value
        if len(value) == 1:
            (inner,) = value.values()
            if isinstance(inner, str) and not isinstance(inner, _Number):
                _, inner = parse_json(inner)
            if isinstance(inner, dict) and field in inner:
                return inner
    return None


def _clean(x: str | None) -> str | None:
    """Lone surrogates, which JSON escapes can make and Arrow can't hold, become replacement marks."""
    return None if x is None else x.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _schema_edges(root: str, recursive: str) -> Callable:
    """Count, per (parent element, field), objects, lists and the most entries in one parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[int]] = {}
        for b in batches:
            for raw in b.column("raw").to_pylist():
                top = holder(parse_json(raw)[1], recursive)
                todo: list[tuple[str, dict]] = [(root, top)] if top is not None else []
                while todo:
                    elem, obj = todo.pop()
                    for field, v in obj.items():
                        if field == recursive:
                            kids = [x for _, _, x in entries(v)]
                        elif isinstance(v, list):
                            kids = v
                        elif isinstance(v, dict):
                            kids = [v]
                        else:
                            continue
                        s = seen.get((elem, field))
                        if s is None:
                            s = seen[elem, field] = [0, 0, 0]
                        s[0] += 1
                        s[1] = max(s[1], len(kids))
                        s[2] |= isinstance(v, list) or field == recursive
                        todo += [(field, x) for x in kids if isinstance(x, dict)]
        rows = [(p, f, *s) for (p, f), s in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["parent", "field", "n", "most", "listed"])

    return run


@dataclass(frozen=True)
class Layout:
    """Which elements get tables of their own; tables maps each to the reason."""

    root: str
    recursive: str
    tables: dict[str, str]
    edges: frozenset[tuple[str, str]]


def layout(records: DataFrame, raw: str, root: str, recursive: str, most_edges: int = MOST_EDGES) -> Layout:
    """Analyse the schema graph of all records and choose the tables: the root, and elements that are repeated (a list,
    or the field read in any spelling), shared (under several parents) or recursive. Others are inlined in their parent.

    Records with more than most_edges different pairs of an element and a field are an error: nothing is left out."""
    found = spread(records.select(F.col(raw).alias("raw"))).mapInArrow(_schema_edges(root, recursive), "parent string, field string, n long, most long, listed long")
    agg = found.groupBy("parent", "field").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.max("listed").alias("listed"))
    rows = agg.limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        raise ValueError(f"more than {most_edges} pairs of an element and a field: their names are data, read such objects as maps first")
    parents: dict[str, set[str]] = {}
    repeated = {recursive}
    for r in rows:
        parents.setdefault(r["field"], set()).add(r["parent"])
        if r["listed"] or r["most"] > 1:
            repeated.add(r["field"])

    def under(x: str) -> set[str]:
        seen: set[str] = set()
        todo = [f for f, ps in parents.items() if x in ps]
        while todo:
            y = todo.pop()
            if y not in seen:
                seen.add(y)
                todo += [f for f, ps in parents.items() if y in ps]
        return seen

    tables = {root: "root"}
    for f, ps in parents.items():
        if f in under(f):
            tables[f] = "recursive"
        elif f in repeated:
            tables[f] = "repeated"
        elif len(ps) > 1:
            tables[f] = "shared"
    tables.setdefault(recursive, "repeated")
    return Layout(root, recursive, tables, frozenset((r["parent"], r["field"]) for r in rows))


def _shredder(plan: Layout, only: frozenset[str] | None, fields: frozenset[str] | None) -> Callable:
    root, rec = plan.root, plan.recursive

    def inline(obj: dict, prefix: str, kids: list, cols: dict, elem: str) -> None:
        """Scalars and singleton objects of obj as columns; what has a table goes to kids."""
        for field, v in obj.items():
            if field in plan.tables and (elem, field) in plan.edges and field != root:
                if v is not None:
                    kids.append((field, v))
            elif isinstance(v, dict) and (elem, field) in plan.edges:
                inline(v, f"{prefix}{field}_", kids, cols, field)
            elif fields is None or prefix + field in fields:
                cols[prefix + field] = as_text(v)

    def rows(record_id: int, top: dict) -> Iterator[tuple]:
        todo: list = [(root, top, "", None, None, None)]
        while todo:
            elem, obj, path, ptab, ppath, key = todo.pop()
            kids: list = []
            cols: dict = {}
            value = None
            if isinstance(obj, dict):
                inline(obj, "", kids, cols, elem)
            else:
                value = as_text(obj)
            if only is None or elem in only:
                yield record_id, elem, path, ptab, ppath, key, value, list(cols.items())
            for field, v in kids:
                if field == rec:
                    got = [(i, k, x) for i, k, x in entries(v) if isinstance(x, dict)]
                elif isinstance(v, list):
                    got = [(i, None, x) for i, x in enumerate(v)]
                else:
                    got = [(0, None, v)]
                if only is not None and field not in only and field != rec:
                    continue
                todo += [(field, x, f"{path}.{i}" if path else str(i), elem, path, k) for i, k, x in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            try:
                arrays = [pa.array(c, t) for c, t in zip(cols, SHREDDED_ARROW.types, strict=True)]
            except UnicodeEncodeError:
                cols[1:7] = [[_clean(x) for x in c] for c in cols[1:7]]
                cols[7] = [[(_clean(k), _clean(v)) for k, v in dict(((_clean(k), v) for k, v in c)).items()] for c in cols[7]]
                arrays = [pa.array(c, t) for c, t in zip(cols, SHREDDED_ARROW.types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=SHREDDED_ARROW)

        for b in batches:
            for record_id, raw in zip(b.column("record_id").to_pylist(), b.column("raw").to_pylist(), strict=True):
                top = holder(parse_json(raw)[1], rec)
                if top is not None:
                    for r in rows(record_id, top):
                        out.append(r)
                        if len(out) >= 20_000:
                            yield flush()
        if out:
            yield flush()

    return run


def shred(records: DataFrame, record_id: str, raw: str, plan: Layout, only: Collection[str] | None = None, fields: Collection[str] | None = None) -> DataFrame:
    """All rows of all flat tables, each with its place and its parent's.

    record_id, table_name, pos_path (0-based places from the top joined by `.`, empty for the root), parent_table and
    parent_path (the foreign key, null for the root), entry_key (the key an entry stands under in an object of
    objects), value (entries that are no objects), fields (the inlined columns as text).
    Null, broken and other raw values hold no record and give no rows; list entries that are no objects take a place
    in the recursive element but give no row there. only and fields restrict tables and columns to those needed.
    """
    src = spread(records.select(F.col(record_id).cast("long").alias("record_id"), F.col(raw).alias("raw")))
    return src.mapInArrow(_shredder(plan, frozenset(only) if only is not None else None, frozenset(fields) if fields is not None else None), SHREDDED)


def flat_table(shredded: DataFrame, name: str, columns: Collection[str]) -> DataFrame:
    """One flat table with its inlined columns; a column that no row has is null."""
    rows = shredded.filter(F.col("table_name") == name)
    return rows.select("record_id", "pos_path", "parent_table", "parent_path", "entry_key", "value", *[F.element_at("fields", F.lit(c)).alias(c) for c in columns])


def manifest_sections(manifests: DataFrame) -> DataFrame:
    """Every section of every record that holds a manifest: manifest_id, pos_path, parent_path, section_id."""
    plan = layout(manifests, "raw", "manifest", "sections")
    s = flat_table(shred(manifests, "manifest_id", "raw", plan, ["sections"], ["id"]), "sections", ["id"])
    return s.select(F.col("record_id").alias("manifest_id"), "pos_path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), F.coalesce("id", "entry_key", F.lit("")).alias("section_id"))
