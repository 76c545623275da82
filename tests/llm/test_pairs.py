import ast
import textwrap
from datetime import datetime

import pytest

from quillmesh.llm import pairs as p

PROSE = "Keep at most one digest for each cursor so that copies never pile up."
S = "file_id long, location string, lang string, content string, delivered_at timestamp, code string, qual_name string"


def names(text, js=False):
    text = p.lines_of(text)
    return [(f.qual_name, f.doc) for f in (p.javascript_functions(text) if js else p.python_functions(text))]


PY = '''
"""Module: def not_one(): pass"""
X = "def nor_this(): pass"
# def comment(): pass
class A(
    B,
):
    """doc"""
    @deco(x=1)
    async def m(self, a: dict[str, int] = {"k": (1, 2)}) -> list[
        int
    ]:  # why
        # first a comment

        r"""one \\d"""
        def inner(): "inline doc"; return 1
        if x:
            def deep():
                ("not a doc")
        return f"""{x}
def fake():
    pass
"""
    def n(self): return """no doc"""
if DEBUG:
    def cond():
        b"""bytes are none"""
    def cond2():
        f"""nor are these"""
    def cond3():
        """a""" "b"
    def cond4():
        """a""".strip()
def after(x=lambda y: y): "d"
'''


def test_python_like_the_parser():
    want = []

    def walk(node, pre):
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                if not isinstance(x, ast.ClassDef):
                    want.append((".".join([*pre, x.name]), ast.get_docstring(x, clean=False)))
                walk(x, [*pre, x.name])
            else:
                walk(x, pre)

    walk(ast.parse(PY), [])
    got = {n: d for n, d in names(PY)}
    want = dict(want)
    assert want.pop("A.m.deep") == "not a doc" and got.pop("A.m.deep") is None  # in brackets it is no literal alone
    assert got == want


def test_python_that_no_parser_takes():
    text = "if D:\n\tprint 'x'\n\ndef f(\n    a,\n):\n\t'''doc'''\n\tx = (1,\n\ndef g():\r\n    '''doc2'''\r\n    def h(:\n"
    assert names(text)[:2] == [("f", "doc"), ("g", "doc2")]


JS = """
/** class doc */
export class K {
  /** m doc */
  async *m(a, b = {c: 1}) { if (a) { function inner() {} } }
  /** far */

  static get s() { return `${ (() => { return "}" })() } /** x */ function no() {}`; }
  // line
  plain(x) { while (x) { x--; } return /[}'"]/.test(x); }
}
/** arrow */ export const f = async (x, {y}) => x + y;
/** lost */ let z = 3;
const g = function (a) { /** nested */ const k = v => v; }
/** typed */
export default function t<T>(a: T): Map<string, T> { return a }
const s = "function nope() {}"; // function no2() {}
/* no doc */ function u() {}
"""


def test_javascript():
    got = {n: (d or "").strip() or None for n, d in names(JS, True)}
    assert got == {"K.m": "m doc", "K.m.inner": None, "K.s": "far", "K.plain": None, "f": "arrow", "g": None, "g.k": "nested", "t": "typed", "u": None}


JS_FORMS = """
class A { /** plain */ foo(a) { return 1 }
  foo2() {}
  /** gen */
  async *g() {}
  /** priv */ #p(x) { }
  /** comp */ [Symbol.iterator]() { }
  /** field */ onClick = (e) => { }
  /** typed */ static h: Handler = async (e) => { };
  /** get */ get(x) { }
  x = 3; y = foo(1);
}
/** me */ module.exports.f = function (a) { }
/** pr */ A.prototype.z = (a) => 1;
/** o */ const api = { /** om */ m(a) { if (a) { call(a) } }, /** ok */ k: function (x) {}, n: { /** deep */ q() {} } };
/** ce */ const B = class Inner extends A { /** bm */ b() { } };
/** dc */ export default class extends A { /** dm */ d() {} }
for (const q of z) { /** inner */ const w = (a) => { }; }
switch (x) { case 1: { foo(); break } default: { bar() } }
"""


def test_javascript_forms():
    got = {n: (d or "").strip() or None for n, d in names(JS_FORMS, True)}
    own = {"A.foo": "plain", "A.foo2": None, "A.g": "gen", "A.#p": "priv", "A.[Symbol.iterator]": "comp", "A.onClick": "field", "A.h": "typed", "A.get": "get"}
    assert got == own | {"f": "me", "z": "pr", "m": "om", "k": "ok", "q": "deep", "B.b": "bm", "d": "dm", "w": "inner"}


def test_javascript_method_behind_a_block(spark):
    text = f"class A {{\n  /** {PROSE} */\n  foo(a) {{\n    return a;\n  }}\n}}\n"
    df = spark.createDataFrame([(1, "a.js", "javascript", text, datetime(2024, 1, 1), "", "")], S)
    assert [(r.qual_name, r.start_line, r.line_distance, r.code.split("\n")[0]) for r in p.function_pairs(df).collect()] == [("A.foo", 3, 1, "foo(a) {")]


@pytest.mark.parametrize(
    ("name", "doc", "ok"),
    [
        ("f", PROSE, True), ("fold_queue", "Fold queue function for five more", False), ("f", "", False), ("f", "TODO: " + PROSE, False), ("f", "Docstring still to be written, sorry.", False),
        ("f", f"{PROSE}\n\nTODO", True), ("f", "Args:\n    a: one two three four five six\n\nReturns:\n    one two three four five six", False), ("f", "Parameters\n----------\na : int\n    one two three four five", False),
        ("f", ":param a: one two three four five six\n    seven eight nine\n:returns: one two three four five", False), ("f", f"Short.\n\n:param a: x\n\n{PROSE}", True), ("f", "Returns nothing when the cursor is local.", True), ("f", "Returns: the one two three four", False),
        ("f", "one two three four", False), ("f", "one two three four five", True), ("f", "Beschreibung folgt noch in diesem Jahr, bestimmt", False),
    ],
)
def test_prose(name, doc, ok):
    assert p.says_enough(name, doc, False) is ok


def test_js_tags():
    assert not p.says_enough("f", "*\n * @param {string} a one two three four five six\n * more words of that same tag\n * @returns {x} one two three four five\n ", True)
    assert p.says_enough("f", f"*\n * {PROSE}\n * @param {{string}} a x\n ", True)


def test_operator(spark):
    body = f'def f():\n    """{PROSE}"""\n    return 1\n'
    t = [datetime(2024, 1, d) for d in (1, 2)]
    rows = [(1, "a.py", "python", body.replace("def f", "def old"), t[0]), (2, "a.py", "python", body, t[1]), (3, "b.py", "python", None, t[0]), (4, None, "python", body, t[0]), (5, "c.py", "python", "", None), (6, "d.js", None, f"/** {PROSE} */\nfunction g() {{\n  return 1;\n}}\n", t[0]), (7, "e.py", "Python", ("x = 1\n" * 200_000) + body, t[0])]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], S)
    got = {(r.location, r.qual_name, r.start_line, r.code, r.description) for r in p.function_pairs(df).collect()}
    assert got == {("a.py", "f", 1, body.rstrip(), PROSE), ("d.js", "g", 2, "function g() {\n  return 1;\n}", PROSE), ("e.py", "f", 200_001, body.rstrip(), PROSE)}
    assert p.function_pairs(df.limit(0)).collect() == []


def test_indent_of_description():
    assert p.description(textwrap.dedent("""One.

        Two.
            Three.
    """), False) == "One.\n\nTwo.\n    Three."  # fmt: skip
