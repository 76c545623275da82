"""JavaScript and TypeScript files to facts: modules, functions in their six forms, imports, workflow envelopes with their steps,
tests, and state machines. The facts have the shape of those of Python files; what lies between files is joined later."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import spread
from . import javascript as js
from . import literals as lit
from .scan import FACTS, FACTS_ARROW, text_hash

SUFFIX = re.compile(r"\.(?:jsx?|tsx?|mjs|cjs)$")
# Names of wrappers, of step markers and of test runners, and the options that are kept.
WRAPPERS, MARKERS, RUNNERS, GROUPS = ("workflow", "task"), ("Step", "AutoStep"), ("test", "it"), ("describe",)
ENVELOPE_OPTIONS = ("critical", "inputs", "outputs", "purpose")
STEP_OPTIONS = ("step_num", "name", "purpose", "inputs", "outputs", "critical")
_IMPORT = re.compile(r"\bimport\s+(?P<type>type\b\s*)?(?P<what>[\w$*\s{},]*?)\s*(?:\bfrom\s*)?(?=['\"])")
_WRAPPED = re.compile(rf"\b(?P<kind>{'|'.join(WRAPPERS)})\s*\(")
_MARKER = re.compile(rf"\b(?P<kind>{'|'.join(MARKERS)})\s*\(")
_RUNNER = re.compile(rf"(?<![\w$.])(?P<kind>{'|'.join(RUNNERS)})\s*\(")
_LOOP = re.compile(r"\b(?:for|while)\s*\(|\bdo\s*\{")


def is_test_file(location: str) -> bool:
    base = location.rsplit("/", 1)[-1]
    stem = base.rsplit(".", 1)[0]
    return base.startswith("test_") or ".test." in base or ".spec." in base or stem.endswith(("_test", "_spec"))


def first_sentence(doc: str) -> str:
    m = re.match(r"\s*([^\n]*?[.!?](?=\s|$)|[^\n]+)", doc)
    return m[1].strip() if m else ""


def doc_text(block: str) -> str:
    """What a doc block says, without its marks and before its first tag."""
    lines = [re.sub(r"^\s*\*+ ?", "", x).rstrip() for x in block[3:-2].split("\n")]
    kept: list[str] = []
    for x in lines:
        if x.lstrip().startswith("@"):
            break
        kept.append(x)
    return "\n".join(kept).strip()


class Script:
    """The facts of one file."""

    def __init__(self, location: str, text: str):
        self.location, self.out = location, []
        project, _, rest = location.partition("/")
        self.project, self.folder = project, rest.rsplit("/", 1)[0] if "/" in rest else ""
        self.module = f"{project}::{SUFFIX.sub('', rest or project).replace('/', '.')}"
        self.text = js.lines_of(text)
        self.masked, self.docs = js.mask(self.text)
        self.bound: dict[str, tuple[str, str | None]] = {}
        self.local: dict[str, str] = {}
        self.envelope_of: dict[str, str] = {}
        self.test_names: set[str] = set()
        self.subtype = "test" if is_test_file(location) else "function"
        self.head()
        self.imports()
        parts = js.outline(self.text, self.masked, self.docs)
        for p in parts:
            if not p.level and not (p.form == "member" and not p.owner):
                name = f"{p.owner}.{p.name}" if p.owner else p.name
                self.function(name, p.start, p.value, p.end, self.doc_of(p.doc))
        self.wrapped()
        self.tests()
        self.machines()

    def line(self, at: int) -> int:
        return self.text.count("\n", 0, at) + 1

    def fact(self, kind: str, id_: str, parent: str | None = None, **more) -> None:
        row = {"kind": kind, "id": id_, "parent": parent, "location": self.location} | more
        self.out.append(tuple(row.get(c) for c in FACTS_ARROW.names))

    def doc_of(self, span: tuple[int, int] | None) -> str | None:
        return (doc_text(self.text[span[0] : span[1]]) or None) if span else None

    def head(self) -> None:
        title = self.module.rpartition("::")[2].rpartition(".")[2]
        lines = []
        for x in self.text.split("\n"):
            if not x.startswith("//"):
                break
            if y := x[2:].strip(" =-_"):
                lines.append(y)
        doc = " ".join(lines) or None
        self.fact("node", self.module, subtype="module", title=title, level_1=first_sentence(doc) if doc else f"{title} module", level_2=doc, level_3_location=self.location, code_hash=text_hash(self.text), desc_hash=text_hash(doc) if doc else None, tags=[])

    def imports(self) -> None:
        """Modules that are imported, by their path within the project; packages and imports of types alone are left out."""
        for m in _IMPORT.finditer(self.masked_but_quotes()):
            q = self.text[m.end()]
            end = self.text.find(q, m.end() + 1)
            path = self.text[m.end() + 1 : end]
            if m["type"] or end < 0 or not path.startswith("."):
                continue
            parts = [x for x in self.folder.split("/") if x]
            for x in path.split("/"):
                if x == "..":
                    parts = parts[:-1]
                elif x not in (".", ""):
                    parts.append(x)
            target = SUFFIX.sub("", "/".join(parts)).replace("/", ".")
            if f"{self.project}::{target}" == self.module:
                continue
            self.fact("import", self.module, module=target)
            what = m["what"]
            for x in re.search(r"\{([^}]*)\}", what)[1].split(",") if "{" in what else []:
                names = re.split(r"\s+as\s+", x.strip())
                if names[0] and not names[0].startswith("type "):
                    self.bound[names[-1]] = (target, names[0])
            if n := re.search(r"\*\s*as\s+([\w$]+)", what):
                self.bound[n[1]] = (target, None)
            if n := re.match(r"\s*([A-Za-z_$][\w$]*)", what):
                self.bound[n[1]] = (target, None)

    def masked_but_quotes(self) -> str:
        """The masked text with the first quote of each string, which an import is found by."""
        out = list(self.masked)
        for m in re.finditer(r"\b(?:from|import)\s*(?=['\"])", self.text):
            if self.masked[m.start()] == self.text[m.start()]:
                out[m.end()] = self.text[m.end()]
        return "".join(out)

    def function(self, name: str, start: int, value: int, end: int, doc: str | None) -> str:
        id_ = f"{self.module}::{name}"
        if name in self.local:
            return id_
        self.local[name] = id_
        first = first_sentence(doc) if doc else ""
        self.fact("node", id_, self.module, subtype=self.subtype, title=name, level_1=f"{name} -- {first}" if first else f"{name} function", level_2=doc, level_3_location=f"{self.location}#L{self.line(value)}-L{self.line(max(start, end - 1))}", code_hash=text_hash(self.text[value:end]), desc_hash=text_hash(doc) if doc else None, tags=[])
        return id_

    # Envelopes

    def call(self, at: int) -> tuple[object, int] | None:
        """(options, place of the wrapped function) of `workflow({..})(fn)` whose first bracket is at `at`."""
        close = js.closing(self.masked, at)
        if close < 0 or self.masked[close : close + 1] != "(":
            return None
        return lit.parse(self.text, self.masked, at + 1).value, close

    def wrapped(self) -> None:
        for m in re.finditer(r"(?:^|\n)(?:export\s+(?:default\s+)?)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*(?::[^=;]*)?=\s*(?=(?:workflow|task)\s*\()", self.masked):
            w = _WRAPPED.match(self.masked, m.end())
            got = w and self.call(w.end() - 1)
            if got:
                k = [d for d in self.docs if d[1] <= m.start("name") and not re.sub(r"export|default|const|let|var", "", self.text[d[1] : m.start("name")]).strip()]
                end = js.closing(self.masked, got[1])
                func = self.function(m["name"], m.start("name"), w.start(), end if end > 0 else len(self.text), self.doc_of(k[-1] if k else None))
                self.envelope_of[m["name"]] = self.envelope(func, m["name"], w["kind"], got, w.start())

    def envelope(self, func: str, name: str, kind: str, got: tuple[object, int], at: int, runner: str | None = None, test: str | None = None) -> str:
        options = {k: lit.plain(e) for k, e in got[0].items() if k in ENVELOPE_OPTIONS} if isinstance(got[0], dict) else {}
        if not isinstance(got[0], dict):
            self.finding("D0", name, at, "the options are no literal object")
        id_ = f"{func}@workflow"
        meta = options | ({"test_runner": runner, "test_name": test} if runner else {})
        shown = test or name
        self.fact("node", id_, self.module, subtype=kind, title=shown, level_1=f"{kind} {shown}", level_2=options.get("purpose") or None, level_3_location=f"{self.location}#L{self.line(at)}", code_hash=text_hash("|".join(f"{k}={options.get(k, '')!r}" for k in ENVELOPE_OPTIONS)), tags=[kind, "envelope", *(["test"] if runner else [])], meta=json.dumps(meta))
        self.fact("annotates", id_, func)
        self.steps(func, id_, got[1])
        return id_

    def steps(self, func: str, envelope: str, at: int) -> None:
        """Step markers within the wrapped function; of a repeated number the first counts."""
        end = js.closing(self.masked, at)
        end = end if end > 0 else len(self.masked)
        seen: set[str] = set()
        for pos, m in enumerate(_MARKER.finditer(self.masked, at, end)):
            opts = lit.parse(self.text, self.masked, m.end()).value
            kw = {k: lit.plain(e) for k, e in opts.items() if k in STEP_OPTIONS} if isinstance(opts, dict) else {}
            raw = kw.get("step_num")
            auto = m["kind"] == "AutoStep"
            number = float(raw) if isinstance(raw, int | float) and not isinstance(raw, bool) else None
            self.fact("step", func, subtype="autostep" if auto else "step", title=kw.get("name") if isinstance(kw.get("name"), str) else None, level_2=kw.get("purpose") if isinstance(kw.get("purpose"), str) else None, meta=json.dumps({"pos": pos, "step_num": number, "in_loop": self.in_loop(at, m.start())}))
            if raw is None or not isinstance(raw, int | float | str):
                continue
            text = opts["step_num"].value if isinstance(raw, str) else self.text[opts["step_num"].start : opts["step_num"].end].strip()
            if text in seen:
                continue
            seen.add(text)
            id_ = f"{func}::step-{text}"
            label = str(kw.get("name") or f"step {text}")
            self.fact("node", id_, envelope, subtype="autostep" if auto else "step", title=label, level_1=label, level_2=kw.get("purpose") or None, level_3_location=f"{self.location}#L{self.line(m.start())}", code_hash="", tags=["autostep" if auto else "step"], meta=json.dumps(kw))
            if auto:
                self.delegate(id_, js.closing(self.masked, m.end() - 1))

    def in_loop(self, a: int, b: int) -> bool:
        """Whether a loop opened after a is still open at b."""
        for m in _LOOP.finditer(self.masked, a, b):
            at = m.end() - 1
            head = js.closing(self.masked, at)
            block = head if m[0].startswith(("for", "while")) else at
            block = lit.skip(self.masked, block)
            if self.masked[block : block + 1] == "{" and block < b < js.closing(self.masked, block):
                return True
        return False

    def delegate(self, step: str, at: int) -> None:
        """The call in the statement behind an automatic step."""
        m = re.compile(r"[\s;]*(?:(?:const|let|var)\s+[\w${}\[\],\s]+=\s*)?(?:return\s+)?(?:await\s+)?([A-Za-z_$][\w$]*)(?:\.([A-Za-z_$][\w$]*))?\s*\(").match(self.masked, at)
        if not m:
            return
        root, attr = m[1], m[2]
        if root in self.bound:
            module, name = self.bound[root]
            if (name is None) == (attr is not None):
                self.fact("delegates", step, module=module, name=attr if name is None else name)
        elif attr is None and root in self.local:
            self.fact("delegates", step, self.local[root])

    def finding(self, rule: str, func: str, at: int, text: str) -> None:
        self.fact("finding", f"{self.module}::{func}", name=rule, title=text, level_3_location=f"{self.location}#L{self.line(at)}")

    def tests(self) -> None:
        """Calls of a test runner at the top or within one describe: they wrap a workflow, or name one that is tested."""
        spans = [(0, len(self.masked), 0)]
        for g in re.finditer(r"(?<![\w$.])(?:describe)\s*\(", self.masked):
            if self.depth(g.start()) == 0:
                end = js.closing(self.masked, g.end() - 1)
                spans.append((g.end(), end if end > 0 else len(self.masked), 2))
        calls = {m.start(): m for a, b, depth in spans for m in _RUNNER.finditer(self.masked, a, b) if self.depth(m.start()) == depth}
        for at in sorted(calls):
            self.test(calls[at]["kind"], calls[at].end() - 1)

    def depth(self, at: int) -> int:
        head = self.masked[:at]
        return sum(head.count(c) for c in "({[") - sum(head.count(c) for c in ")}]")

    def test(self, runner: str, at: int) -> None:
        name = lit.parse(self.text, self.masked, at + 1)
        body = lit.skip(self.text, name.end + 1)
        w = _WRAPPED.match(self.masked, body)
        ref = re.compile(r"([A-Za-z_$][\w$]*)\s*[,)]").match(self.masked, body)
        got = w and self.call(w.end() - 1)
        if not got and not (ref and ref[1] in self.envelope_of):
            return
        if not isinstance(name.value, str):
            return self.finding("D2", f"{runner}(...)", at, "the name of a test is no literal text")
        slug = re.sub(r"[^a-zA-Z0-9]+", "-", name.value).strip("-").lower()
        if not slug:
            return self.finding("D2", f"{runner}(...)", at, "the name of a test has no letter or digit")
        if slug in self.test_names:
            return self.finding("D1", f"{runner}('{name.value}')", at, "two tests have one name")
        self.test_names.add(slug)
        if got:
            end = js.closing(self.masked, got[1])
            label = f"test::{slug}"
            func = self.function(label, body, body, end if end > 0 else len(self.text), None)
            self.envelope(func, label, w["kind"], got, body, runner, name.value)
        else:
            self.fact("tag", self.envelope_of[ref[1]], name="test", meta=json.dumps({"test_runner": runner, "test_name": name.value}))

    # State machines

    def machines(self) -> None:
        for m in re.finditer(r"\bcreateMachine\s*\(", self.masked):
            head = self.masked[: m.start()]
            bind = re.search(r"(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=;]*)?=\s*(?:setup\s*\([^;]*\)\s*\.\s*)?$", head)
            setup = re.search(r"\bsetup\s*\(", head[bind.start() :]) if bind else None
            obj = lit.parse(self.text, self.masked, m.end())
            name = bind[1] if bind else None
            if not isinstance(obj.value, dict):
                self.finding("X1", name or "<unbound>", m.start(), "a machine is no literal object")
                continue
            told = obj.value.get("id")
            short = told.value if told and isinstance(told.value, str) else name
            if not short:
                self.finding("X1", "<unbound>", m.start(), "a machine has neither an id nor a name")
                continue
            actors: dict[str, str] = {}
            if setup:
                s = lit.parse(self.text, self.masked, bind.start() + setup.end()).value
                a = s.get("actors") if isinstance(s, dict) else None
                actors = {k: e.value.text for k, e in a.value.items() if isinstance(e.value, lit.Name)} if a and isinstance(a.value, dict) else {}
            self.machine(short, obj, m.start(), actors)

    def purpose(self, obj: dict) -> str | None:
        meta = obj.get("meta")
        p = meta.value.get("purpose") if meta and isinstance(meta.value, dict) else None
        return p.value if p and isinstance(p.value, str) else None

    def machine(self, short: str, obj: lit.Entry, at: int, actors: dict[str, str]) -> None:
        id_, why = f"{self.module}::{short}@machine", self.purpose(obj.value)
        self.fact("node", id_, self.module, subtype="state_machine", title=short, level_1=f"xstate machine {short}" + (f" — {why}" if why else ""), level_2=why, level_3_location=f"{self.location}#L{self.line(at)}", code_hash=text_hash(self.text[obj.start : obj.end].rstrip()), tags=["state_machine", "xstate"], meta=json.dumps({"purpose": why or "", "machine_id": short}))
        states: dict[str, tuple[lit.Entry, str, str]] = {}  # path -> (object, path above, own name)
        todo = [("", obj)]
        while todo:
            above, e = todo.pop(0)
            kids = e.value.get("states")
            if kids is None:
                continue
            if not isinstance(kids.value, dict):
                self.finding("X1", short, kids.start, "states are no literal object")
                continue
            for k, x in kids.value.items():
                if not isinstance(x.value, dict):
                    self.finding("X1", short, x.start, f"state {k} is no literal object")
                    continue
                path = f"{above}.{k}" if above else k
                states[path] = (x, above, k)
                todo.append((path, x))
        for path, (x, above, k) in states.items():
            sid, why = f"{id_}.states.{path}", self.purpose(x.value)
            kind = x.value.get("type")
            final = bool(kind) and kind.value == "final"
            compound = any(a == path for _, a, _ in states.values())
            self.fact("node", sid, f"{id_}.states.{above}" if above else id_, subtype="compound_state" if compound else "state", title=k, level_1=f"state {path}" + (f" — {why}" if why else ""), level_2=why, level_3_location=f"{self.location}#L{self.line(x.start)}", code_hash="", tags=["state", *(["final"] if final else [])], meta=json.dumps({"xstate_path": path, "purpose": why or "", "terminal": final}))
            siblings = {n for _, a, n in states.values() if a == above}
            for target, meta in self.transitions(short, x.value):
                to = state_target(target, above, siblings, set(states), short)
                self.fact("transition", sid, f"{id_}.states.{to}" if to else f"{id_}.<unresolved>", meta=json.dumps(meta))
            for e in self.several(x.value.get("invoke")):
                if isinstance(e.value, dict):
                    self.invoked(sid, id_, short, e.value, actors, above, siblings, set(states))
        for s in re.finditer(r"(?<![\w$.])spawn\s*\(\s*([A-Za-z_$][\w$]*)", self.masked[obj.start : obj.end]):
            if s[1] in self.bound:
                module, name = self.bound[s[1]]
                self.fact("spawn", id_, module=module, name=f"{name or s[1]}@machine")

    @staticmethod
    def several(e: lit.Entry | None) -> list[lit.Entry]:
        return [] if e is None else e.value if isinstance(e.value, list) else [e]

    def target(self, e: lit.Entry) -> tuple[str | None, bool]:
        """(target, internal) of a transition in any of its spellings."""
        v = e.value
        if isinstance(v, str):
            return v, False
        if isinstance(v, dict):
            t, inner = v.get("target"), v.get("internal")
            first = next((x.value for x in self.several(t) if isinstance(x.value, str)), None)
            return first, bool(inner and inner.value is True)
        if isinstance(v, list):
            for x in v:
                if isinstance(x.value, str | dict):
                    return self.target(x)
        return None, False

    def transitions(self, machine: str, state: dict) -> Iterator[tuple[str, dict]]:
        for via in ("on", "after"):
            e = state.get(via)
            if e is None:
                continue
            if not isinstance(e.value, dict):
                self.finding("X1", machine, e.start, f"`{via}` is no literal object")
                continue
            for k, x in e.value.items():
                t, inner = self.target(x)
                if t is None:
                    self.finding("X1", machine, x.start, f"{via}.{k} has no literal target")
                else:
                    yield t, {("event" if via == "on" else "delay"): k, "via": via} | ({"internal": True} if inner else {})
        for x in self.several(state.get("always")):
            t, inner = self.target(x)
            if t is None:
                self.finding("X1", machine, x.start, "`always` has no literal target")
            else:
                yield t, {"via": "always"} | ({"internal": True} if inner else {})

    def invoked(self, state: str, machine_id: str, short: str, spec: dict, actors: dict[str, str], above: str, siblings: set[str], paths: set[str]) -> None:
        src = spec.get("src")
        name = src.value if src and isinstance(src.value, str) else None
        known = actors.get(name or "")
        if name is None:
            self.finding("X1", short, src.start if src else 0, "the source of an actor is no literal text")
        elif known and known in self.bound:
            module, orig = self.bound[known]
            self.fact("delegates", state, module=module, name=orig or known, meta=json.dumps({"via": "invoke", "src": name}))
        elif known:
            self.fact("transition", state, f"{self.module}::{known}", meta=json.dumps({"via": "invoke", "src": name}))
        for k in ("onDone", "onError"):
            if k in spec:
                t, _ = self.target(spec[k])
                if t is not None:
                    to = state_target(t, above, siblings, paths, short)
                    self.fact("transition", state, f"{machine_id}.states.{to}" if to else f"{machine_id}.<unresolved>", meta=json.dumps({"via": f"invoke.{k}"}))


def state_target(target: str, above: str, siblings: set[str], paths: set[str], machine: str) -> str | None:
    """The path of the state that a transition names: `#machine.path`, else a sibling, else a path from the top, else one from
    the state above; None if there is none."""
    if target.startswith("#"):
        named = target[1:]
        want = named.removeprefix(f"{machine}.") if named.startswith(f"{machine}.") else "" if named == machine else named
        return want if want in paths else None
    choices = [f"{above}.{target}" if above else target] if target in siblings else []
    choices += [target, *([f"{above}.{target}"] if above else [])]
    return next((c for c in choices if c and c in paths), None)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for location, text in zip(b.column("location").to_pylist(), b.column("content").to_pylist(), strict=True):
            rows += Script(location, text).out
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(FACTS_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, FACTS_ARROW.types, strict=True)], schema=FACTS_ARROW)


def script_facts(files: DataFrame) -> DataFrame:
    """Facts of the files (location, content), whatever a parser would say of them."""
    return spread(files.filter("location is not null and content is not null").select("location", "content")).mapInArrow(_facts, FACTS)
