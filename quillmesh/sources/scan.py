"""Source files and documents to nodes and edges: one pass over each file, everything between files by joins."""

from __future__ import annotations

import ast
import copy
import hashlib
import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..runtime import spread

FACTS = "kind string, id string, parent string, subtype string, title string, location string, level_1 string, level_2 string, level_3_location string, code_hash string, desc_hash string, tags array<string>, module string, name string, called boolean, meta string"
FACTS_ARROW = pa.schema([*[(c, pa.string()) for c in ("kind", "id", "parent", "subtype", "title", "location", "level_1", "level_2", "level_3_location", "code_hash", "desc_hash")], ("tags", pa.list_(pa.string())), ("module", pa.string()), ("name", pa.string()), ("called", pa.bool_()), ("meta", pa.string())])
MARKERS = ("workflow", "task")


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16]


_SENTENCE = re.compile(r"\s*([^\n.!?]*[.!?]?)")


def first_sentence(text: str) -> str:
    """What the first line with anything on it says up to its first full stop, exclamation or question mark."""
    return _SENTENCE.match(text)[1].rstrip()


def module_path(location: str) -> tuple[str, str]:
    """(project, dotted module) of `project/a/b.py`."""
    project, _, rest = location.partition("/")
    rest = re.sub(r"\.[A-Za-z]+$", "", rest or project)
    return project, re.sub(r"/(__init__|index)$", "", rest).replace("/", ".")


class _Module(ast.NodeVisitor):
    """Facts of one Python file: module and function nodes, what it imports, and which imported names functions use."""

    def __init__(self, location: str, text: str):
        self.location, self.out = location, []
        project, self.dotted = module_path(location)
        self.module = f"{project}::{self.dotted}"
        self.bound: dict[str, tuple[str, str | None]] = {}
        base = location.rsplit("/", 1)[-1]
        self.tests = base.startswith("test_") or base.endswith("_test.py")
        title = self.dotted.rsplit(".", 1)[-1]
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            self.fact("node", self.module, None, "module", title, level_1=f"{title} (not parsed)", code_hash=text_hash(text))
            return
        doc = ast.get_docstring(tree)
        main = any(isinstance(s, ast.If) and "__main__" in ast.dump(s.test) for s in tree.body)
        tags = ["test"] * self.tests + ["entrypoint"] * main
        self.fact("node", self.module, None, "module", title, level_1=first_sentence(doc) if doc else f"{title} module", level_2=doc, level_3_location=location, code_hash=text_hash(text), desc_hash=text_hash(doc) if doc else None, tags=tags)
        for s in tree.body:
            self.imports(s)
        self.scope: list[str] = []
        self.parent = self.module
        for s in tree.body:
            self.visit(s)

    def fact(self, kind: str, id_: str, parent: str | None, subtype: str | None = None, title: str | None = None, **more) -> None:
        row = {"kind": kind, "id": id_, "parent": parent, "subtype": subtype, "title": title, "location": self.location} | more
        self.out.append(tuple(row.get(c) for c in FACTS_ARROW.names))

    def imports(self, s: ast.stmt) -> None:
        if isinstance(s, ast.Import):
            for a in s.names:
                self.bound[a.asname or a.name.split(".")[0]] = (a.name, None)
                self.fact("import", self.module, None, module=a.name)
        elif isinstance(s, ast.ImportFrom):
            here = self.dotted.split(".")[:-1]
            base = here[: len(here) - (s.level - 1)] if s.level else []
            name = ".".join([*base, *([s.module] if s.module else [])])
            if name:
                self.fact("import", self.module, None, module=name)
                for a in s.names:
                    if a.name != "*":
                        self.bound[a.asname or a.name] = (name, a.name)

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.scope.append(node.name)
        for s in node.body:
            self.visit(s)
        self.scope.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        name = ".".join([*self.scope, node.name])
        id_ = f"{self.module}::{name}"
        doc = ast.get_docstring(node, clean=False)
        marks = {m: d for d in node.decorator_list if (m := _called(d).rsplit(".", 1)[-1]) in MARKERS}
        meta = docstring_parts(ast.get_docstring(node) or "")
        code = ast.unparse(_Plain(doc is not None, marks.values()).visit(copy.deepcopy(node)))
        args = ast.unparse(node.args)
        sig = f"{node.name}({re.sub(r'^(?:self|cls)(?:, )?', '', args)})"
        raised = sorted({_called(r.exc) for r in ast.walk(node) if isinstance(r, ast.Raise) and r.exc is not None} - {""})
        if raised:
            meta["raises"] = raised
        for m, d in marks.items():
            meta |= {"decorator": m} | {k.arg: _literal(k.value) for k in getattr(d, "keywords", []) if k.arg}
        marked = self.markers(node)
        if marked:
            meta["steps"] = sorted(({k: v for k, v in kw.items() if k != "line"} for _, kw in marked if isinstance(kw.get("step_num"), int | float)), key=lambda x: float(x["step_num"]))
        told = "\n\n".join(x for x in (doc, "Raises: " + ", ".join(raised) if raised else None) if x) or None
        decorators = [_called(d) for d in node.decorator_list]
        test = node.name.startswith("test_") and self.tests
        tags = ["test"] * test + ["test:fixture"] * any(d.endswith("fixture") for d in decorators) + ["entrypoint:cli"] * any(d.endswith(("command", "group")) for d in decorators) + ["entrypoint:http"] * any(re.search(r"\.(get|post|put|delete|route)$", d) is not None for d in decorators)
        first = node.decorator_list[0].lineno if node.decorator_list else node.lineno
        self.fact("node", id_, self.parent, "test" if test else "function", name, level_1=f"{sig} — {first_sentence(doc)}" if doc and first_sentence(doc) else sig, level_2=told, level_3_location=f"{self.location}#L{first}-L{node.end_lineno}", code_hash=text_hash(code), desc_hash=text_hash(doc) if doc else None, tags=tags, meta=json.dumps(meta, default=str) if meta else None)
        for m, d in marks.items():
            options = {k.arg: _literal(k.value) for k in getattr(d, "keywords", []) if k.arg}
            # Fixed format: the options of an envelope, in this order, as Python writes their values.
            kwargs = "|".join(f"{k}={options.get(k, '')!r}" for k in ("critical", "inputs", "outputs", "purpose"))
            purpose = options.get("purpose")
            self.fact("node", f"{id_}@workflow", self.module, m, name, level_1=f"{m} {name}", level_2=str(purpose) if purpose else None, level_3_location=f"{self.location}#L{d.lineno}", code_hash=text_hash(kwargs), tags=[m, "envelope"], meta=json.dumps(options, default=str))
            self.fact("annotates", f"{id_}@workflow", id_)
            self.steps(marked, f"{id_}@workflow", id_)
        self.uses(node, id_)
        outer, self.parent = self.parent, id_
        self.scope.append(node.name)
        for s in node.body:
            self.visit(s)
        self.scope.pop()
        self.parent = outer

    visit_AsyncFunctionDef = visit_FunctionDef

    def markers(self, node: ast.AST) -> list[tuple[str, dict]]:
        """(kind, options with line, in_loop and what is called next) of the step markers of a function, in the order of the text."""
        found: list[tuple[str, dict]] = []
        todo: list[tuple[ast.AST, bool]] = [(node, False)]
        while todo:
            x, loop = todo.pop()
            loop = loop or isinstance(x, ast.For | ast.AsyncFor | ast.While)
            for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                block = getattr(x, field, None)
                for i, s in enumerate(block if isinstance(block, list) else []):
                    call = s.value if isinstance(s, ast.Expr | ast.Assign | ast.AnnAssign) else None
                    if isinstance(call, ast.Call) and isinstance(call.func, ast.Name) and call.func.id in ("Step", "AutoStep"):
                        kw = {k.arg: _literal(k.value) for k in call.keywords if k.arg}
                        nxt = block[i + 1] if i + 1 < len(block) else None
                        then = nxt.value if isinstance(nxt, ast.Expr | ast.Assign) else None
                        found.append((call.func.id, kw | {"line": call.lineno, "in_loop": loop, "_raw": _number(call), "_next": _called(then) if isinstance(then, ast.Call) else None}))
                    if not isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                        todo.append((s, loop))
        return sorted(found, key=lambda f: f[1]["line"])

    def steps(self, marked: list[tuple[str, dict]], envelope: str, func: str) -> None:
        """Nodes of the step markers; of a repeated number the first counts. What a marker says goes out for the rules, too."""
        seen: set[str] = set()
        for pos, (kind, kw) in enumerate(marked):
            num, auto = kw.get("step_num"), kind == "AutoStep"
            number = float(num) if isinstance(num, int | float) and not isinstance(num, bool) else None
            text = {c: kw.get(c) if isinstance(kw.get(c), str) else None for c in ("name", "purpose")}
            self.fact("step", func, None, "autostep" if auto else "step", text["name"], level_2=text["purpose"], meta=json.dumps({"pos": pos, "step_num": number, "in_loop": kw["in_loop"]}))
            if num is None or not auto and not kw.get("name") and not kw.get("purpose") or kw["_raw"] in seen:
                continue
            seen.add(kw["_raw"])
            id_, title = f"{func}::step-{kw['_raw']}", str(kw.get("name") or f"step {kw['_raw']}")
            said = {k: v for k, v in kw.items() if k not in ("line", "in_loop", "_next", "_raw")} | {"step_num_raw": kw["_raw"]}
            self.fact("node", id_, envelope, "autostep" if auto else "step", title, level_1=title, level_2=text["purpose"], level_3_location=f"{self.location}#L{kw['line']}", code_hash="", tags=["autostep" if auto else "step"], meta=json.dumps(said, default=str))
            root, _, attr = (kw["_next"] or "").partition(".")
            if auto and root in self.bound:
                module, name = self.bound[root]
                if (name is None) == bool(attr) and "." not in attr:
                    self.fact("delegates", id_, None, module=module, name=name or attr)
            elif auto and root and not attr:
                self.fact("delegates", id_, f"{self.module}::{root}")

    def uses(self, node: ast.AST, id_: str) -> None:
        seen: set[tuple] = set()
        for x in ast.walk(node):
            call = isinstance(x, ast.Call)
            ref = x.func if call else x
            attr = ref.attr if isinstance(ref, ast.Attribute) else None
            while isinstance(ref, ast.Attribute):
                ref = ref.value
            if isinstance(ref, ast.Name) and ref.id in self.bound:
                module, name = self.bound[ref.id]
                row = (module, attr if attr is not None and (name is None or call) else name, call)
                if row not in seen:
                    seen.add(row)
                    self.fact("use", id_, None, module=row[0], name=row[1], called=call)


class _Plain(ast.NodeTransformer):
    """Takes the docstring and the workflow markers off one function, and nothing off those within it."""

    def __init__(self, told: bool, marks):
        self.told, self.marks = told, [ast.dump(d) for d in marks]

    def visit_FunctionDef(self, node: ast.FunctionDef) -> ast.FunctionDef:
        node.decorator_list = [d for d in node.decorator_list if ast.dump(d) not in self.marks]
        if self.told:
            node.body[:1] = [] if len(node.body) > 1 else [ast.Pass()]
        return node

    visit_AsyncFunctionDef = visit_FunctionDef


def _literal(v: ast.expr) -> object:
    try:
        return ast.literal_eval(v)
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return ast.unparse(v)


def _number(call: ast.Call) -> str:
    """The number of a step as the text writes it, so that 1.10 stays apart from 1.1."""
    v = next((k.value for k in call.keywords if k.arg == "step_num"), None)
    if isinstance(v, ast.Constant):
        return v.value if isinstance(v.value, str) else f"{v.value:g}" if isinstance(v.value, float) else str(v.value)
    return ast.unparse(v) if v is not None else ""


_SECTION = re.compile(r"^(Args|Arguments|Parameters|Returns|Return|Yields|Raises)\s*:\s*$", re.I)
_ITEM = re.compile(r"^\s+(\*{0,2}\w[\w.]*)\s*(?:\(([^)]*)\))?\s*:\s*(.*)$")
_RST = re.compile(r"^\s*:(param|parameter|arg|returns?|rtype|raises?|type)\s*([^:]*):\s*(.*)$")


def docstring_parts(doc: str) -> dict:
    """params, returns and raises_doc of a docstring with headed sections or field lists: names, types and descriptions."""
    out: dict[str, list[dict]] = {}
    part, lead = None, 0
    types: dict[str, str] = {}
    for line in doc.split("\n"):
        if m := _RST.match(line):
            kind, arg, text = m[1], m[2].split(), m[3].strip()
            part = None
            if kind in ("param", "parameter", "arg") and arg:
                out.setdefault("params", []).append({"name": arg[-1]} | ({"type": " ".join(arg[:-1])} if arg[1:] else {}) | ({"desc": text} if text else {}))
            elif kind.startswith("return"):
                out.setdefault("returns", []).append({"desc": text})
            elif kind == "rtype":
                out.setdefault("returns", [{}])[0]["type"] = text
            elif kind.startswith("raise") and arg:
                out.setdefault("raises_doc", []).append({"type": arg[0]} | ({"desc": text} if text else {}))
            elif kind == "type" and arg:
                types[arg[0]] = text
        elif m := _SECTION.match(line):
            part, lead = {"a": "params", "p": "params", "r": "returns", "y": "returns"}[m[1][0].lower()], 0
            if m[1].lower() == "raises":
                part = "raises_doc"
        elif part and line.strip():
            own = len(line) - len(line.lstrip())
            lead = lead or own
            if not own:
                part = None
                continue
            m = _ITEM.match(line) if own == lead else None
            rows = out.setdefault(part, [])
            if m and part == "params":
                kind = (m[2] or "").removesuffix(", optional").strip()
                rows.append({"name": m[1].lstrip("*")} | ({"type": kind} if kind else {}) | ({"desc": m[3]} if m[3] else {}) | ({"optional": True} if (m[2] or "").endswith("optional") else {}))
            elif m and part == "raises_doc":
                rows.append({"type": m[1]} | ({"desc": m[3]} if m[3] else {}))
            elif own == lead and part == "returns" and not rows:
                kind, sep, text = line.strip().partition(": ")
                rows.append({"type": kind, "desc": text} if sep and re.fullmatch(r"[\w.\[\], |]+", kind) else {"desc": line.strip()})
            elif rows:
                rows[-1]["desc"] = f"{rows[-1].get('desc', '')} {line.strip()}".strip()
    for p in out.get("params", []):
        if p["name"] in types:
            p.setdefault("type", types[p["name"]])
    return {k: v for k, v in out.items() if v}


def _called(d: ast.expr) -> str:
    """The dotted name of a decorator, exception or callee."""
    d = d.func if isinstance(d, ast.Call) else d
    parts = []
    while isinstance(d, ast.Attribute):
        parts.append(d.attr)
        d = d.value
    return ".".join([d.id, *reversed(parts)]) if isinstance(d, ast.Name) else ".".join(reversed(parts))


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for location, text in zip(b.column("location").to_pylist(), b.column("content").to_pylist(), strict=True):
            rows += _Module(location, text.replace("\r\n", "\n").replace("\r", "\n")).out
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(FACTS_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FACTS_ARROW.types, strict=True)], schema=FACTS_ARROW)


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of the Python files (location, content). A file that doesn't parse gives its module alone."""
    return spread(files.filter("location is not null and content is not null").select("location", "content")).mapInArrow(_facts, FACTS)


_COMPOSITE = ("module", "state_machine", "compound_state", *MARKERS)


def fact_nodes(facts: DataFrame) -> DataFrame:
    """Nodes of the facts, with their tags; of several of one id the first by line counts. Packages that no file has become
    entities."""
    own = facts.filter("kind = 'node'")
    first = F.min(F.struct(F.coalesce(fn.level3("level_3_location").getField("line_start"), F.lit(0)).alias("line"), "subtype", "title", "location", "level_1", "level_2", "level_3_location", "code_hash", "desc_hash", "tags", "meta"))
    nodes = own.groupBy("id").agg(first.alias("x")).select("id", F.when(F.col("x.subtype").isin(*_COMPOSITE), "composite_process").otherwise("atomic_process").alias("node_type"), "x.*").drop("line")
    more = facts.filter("kind = 'tag'").groupBy("id").agg(F.collect_set("name").alias("more"), F.max("meta").alias("said"))
    nodes = nodes.join(more, "id", "left").withColumn("tags", F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))).withColumn("meta", F.coalesce("said", "meta")).drop("more", "said")
    nodes = nodes.withColumn("subtype", F.when(F.col("subtype") == "compound_state", "state").otherwise(F.col("subtype")))
    ext = externals(facts).select("to_id").distinct()
    name = F.substring_index("to_id", "::", -1)
    none = F.lit(None).cast("string")
    stub = ext.select(F.col("to_id").alias("id"), F.lit("entity").alias("node_type"), F.lit("external_package").alias("subtype"), name.alias("title"), F.lit("").alias("location"), name.alias("level_1"), *[none.alias(c) for c in ("level_2", "level_3_location", "code_hash", "desc_hash")], F.array().cast("array<string>").alias("tags"), none.alias("meta"))
    return nodes.unionByName(stub)


def python_nodes(facts: DataFrame) -> DataFrame:
    return fact_nodes(facts).drop("tags", "meta")


def fact_steps(facts: DataFrame) -> DataFrame:
    """The step markers of the facts, in the shape that validation.step_findings takes."""
    said = F.from_json("meta", "pos int, step_num double, in_loop boolean")
    return facts.filter("kind = 'step'").select(F.col("id").alias("function"), said.alias("m"), F.col("title").alias("name"), F.col("level_2").alias("purpose"), (F.col("subtype") == "autostep").alias("is_auto")).select("function", "m.*", "name", "purpose", "is_auto")


def _resolved(facts: DataFrame, kind: str) -> DataFrame:
    """Facts about a module, with the id of the module's file in the same project, null if there is none."""
    known = facts.filter("kind = 'node' and subtype = 'module'").select(F.col("id").alias("target")).distinct()
    want = facts.filter(F.col("kind") == kind).withColumn("want", F.concat_ws("::", F.substring_index("id", "::", 1), "module"))
    return want.join(known, F.col("want") == F.col("target"), "left")


def externals(facts: DataFrame) -> DataFrame:
    """from_id, to_id: modules and the packages they import that are neither files nor of the standard library."""
    std = F.array(*[F.lit(x) for x in sorted(sys.stdlib_module_names)])
    top = F.substring_index("module", ".", 1)
    lost = _resolved(facts, "import").filter(F.col("target").isNull() & ~F.array_contains(std, top))
    return lost.select(F.col("id").alias("from_id"), F.concat_ws("::", F.substring_index("id", "::", 1), F.lit("external"), top).alias("to_id")).distinct()


def fact_edges(facts: DataFrame) -> DataFrame:
    """Edges of the facts: composes, annotates, depends_on (modules and functions to modules), validates (tests to what they
    call), delegates_to (automatic steps to the call behind them, states to states and actors); meta of the latter as text.
    Of several with one id the one with the greatest meta counts."""
    composes = facts.filter("kind = 'node' and parent is not null").select(F.lit("composes").alias("edge_type"), F.col("parent").alias("from_id"), F.col("id").alias("to_id"))
    notes = facts.filter("kind = 'annotates'").select(F.lit("annotates").alias("edge_type"), F.col("id").alias("from_id"), F.col("parent").alias("to_id"))
    imports = _resolved(facts, "import").filter("target is not null and target <> id").select(F.lit("depends_on").alias("edge_type"), F.col("id").alias("from_id"), F.col("target").alias("to_id"))
    uses = _resolved(facts, "use").filter("target is not null")
    deps = uses.select(F.lit("depends_on").alias("edge_type"), F.col("id").alias("from_id"), F.col("target").alias("to_id"))
    tests = facts.filter("kind = 'node' and subtype = 'test'").select("id")
    val = uses.filter("called and name is not null").join(tests, "id", "left_semi").select(F.lit("validates").alias("edge_type"), F.col("id").alias("from_id"), F.concat_ws("::", "target", "name").alias("to_id"))
    ext = externals(facts).select(F.lit("depends_on").alias("edge_type"), "from_id", "to_id")
    plain = composes.unionByName(notes).unionByName(imports).unionByName(deps).unionByName(val).unionByName(ext).withColumn("meta", F.lit(None).cast("string"))
    moves = facts.filter("kind = 'transition' or (kind = 'delegates' and parent is not null)").select(F.lit("delegates_to").alias("edge_type"), F.col("id").alias("from_id"), F.col("parent").alias("to_id"), "meta")
    far = _resolved(facts, "delegates").filter("target is not null and name is not null").select(F.lit("delegates_to").alias("edge_type"), F.col("id").alias("from_id"), F.concat_ws("::", "target", "name").alias("to_id"), "meta")
    spawned = _resolved(facts, "spawn").filter("target is not null").select(F.lit("composes").alias("edge_type"), F.col("id").alias("from_id"), F.concat_ws("::", "target", "name").alias("to_id"), "meta")
    every = plain.unionByName(moves).unionByName(far).unionByName(spawned).withColumn("id", fn.edge_id("from_id", "edge_type", "to_id"))
    return every.groupBy("id", "edge_type", "from_id", "to_id").agg(F.max("meta").alias("meta"))


def python_edges(facts: DataFrame) -> DataFrame:
    return fact_edges(facts).drop("meta")


def markdown_sections(docs: DataFrame, key: str, text: str, with_body: bool = False) -> DataFrame:
    """key, position, heading, slug, body_hash: the parts under second-level headings, fenced code left aside."""
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), r"(?s)```.*?```", "")
    parts = docs.select(key, F.posexplode(F.split(clean, r"(?m)^## ")).alias("position", "part")).filter("position > 0")
    head = F.trim(F.substring_index("part", "\n", 1))
    body = F.regexp_replace(F.expr("substr(part, length(substring_index(part, '\n', 1)) + 1)"), r"^\s+|\s+$", "")
    return parts.select(key, "position", head.alias("heading"), fn.slug(head).alias("slug"), fn.hash16(body).alias("body_hash"), *([body.alias("body")] if with_body else []))


def is_docjson(raw: Column) -> Column:
    """An object with a title that is text and an array of sections."""
    v = F.try_parse_json(raw)
    return F.coalesce((F.schema_of_variant(F.try_variant_get(v, "$.title", "variant")) == "STRING") & F.schema_of_variant(F.try_variant_get(v, "$.sections", "variant")).startswith("ARRAY"), F.lit(False))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change: A, M, D or R (renamed, with old_path) between two manifests of (path, content_hash).

    A deleted and an added path of equal content are a rename, the first of each by name."""
    j = old.select("path", F.col("content_hash").alias("o")).join(new.select("path", F.col("content_hash").alias("n")), "path", "full_outer")
    gone = j.filter("n is null").groupBy(F.col("o").alias("h")).agg(F.min("path").alias("old_path"))
    come = j.filter("o is null").groupBy(F.col("n").alias("h")).agg(F.min("path").alias("path"))
    moved = gone.join(come, "h").select("old_path", "path")
    plain = j.filter(~F.col("o").eqNullSafe(F.col("n"))).withColumn("change", F.when(F.col("o").isNull(), "A").when(F.col("n").isNull(), "D").otherwise("M"))
    plain = plain.join(moved.select("path"), "path", "left_anti").join(moved.select(F.col("old_path").alias("path")), "path", "left_anti")
    return plain.select("path", "change", F.lit(None).cast("string").alias("old_path")).unionByName(moved.select("path", F.lit("R").alias("change"), "old_path"))


def sliced(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, code: the lines of each wanted node (id, location, line_start, line_end) from its file (location, content)."""
    return wanted.join(files.select("location", "content"), "location").select("id", fn.lines_between("content", F.col("line_start"), F.col("line_end")).alias("code"))
