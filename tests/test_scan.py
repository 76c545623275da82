from quillmesh.sources import scan

A = '''"""Module doc. More."""
import os
import numpy.linalg
from . import helper
from pkg.tool import run as go, other

@task(purpose="p", inputs="x")
def f(self, a: int, *, b=1) -> int:
    """Doc of f. Rest."""
    Step(step_num=1, name="one")
    Step(step_num=1, name="again")
    AutoStep(step_num=2, name="two")
    def inner():
        raise ValueError("x")
    return go(a) + helper.calc(b)

class C:
    @property
    def m(self): return other
'''


def facts(spark, *files):
    return scan.python_facts(spark.createDataFrame(list(files), "location string, content string, lang string"))


def test_python(spark):
    fs = facts(spark, ("proj/pkg/a.py", A, ""), ("proj/pkg/tool.py", "def run(x): pass\n", ""), ("proj/pkg/helper/__init__.py", "", ""), ("proj/pkg/test_a.py", "from pkg.a import f\nimport pkg.tool\ndef test_f():\n    assert f(1)\n    pkg.tool.run(2)\n", ""), ("proj/bad.py", "def (", ""), (None, "x", ""), ("proj/null.py", None, ""))
    fs = fs.cache()
    nodes = {r.id: r for r in scan.python_nodes(fs).collect()}
    assert {k: v.subtype for k, v in nodes.items()} == {
        "proj::pkg.a": "module", "proj::pkg.a::f": "function", "proj::pkg.a::f@workflow": "task", "proj::pkg.a::f::step-1": "step", "proj::pkg.a::f::step-2": "autostep", "proj::pkg.a::f.inner": "function", "proj::pkg.a::C.m": "function",
        "proj::pkg.tool": "module", "proj::pkg.tool::run": "function", "proj::pkg.helper": "module", "proj::pkg.test_a": "module", "proj::pkg.test_a::test_f": "test", "proj::bad": "module", "proj::external::numpy": "external_package", "proj::external::pkg": "external_package",  # a package without a file of its own
    }
    assert nodes["proj::pkg.a::f"].level_1 == "f(a: int, *, b=1) — Doc of f." and nodes["proj::pkg.a::f"].level_3_location == "proj/pkg/a.py#L7-L15"
    assert nodes["proj::pkg.a::f::step-1"].title == "one" and nodes["proj::pkg.a::f.inner"].level_2 == "Raises: ValueError"
    edges = {(r.edge_type, r.from_id, r.to_id) for r in scan.python_edges(fs).collect()}
    f = "proj::pkg.a::f"
    assert edges >= {("composes", "proj::pkg.a", f), ("composes", f, f + ".inner"), ("composes", "proj::pkg.a", "proj::pkg.a::C.m"), ("composes", "proj::pkg.a", f + "@workflow"), ("composes", f + "@workflow", f + "::step-1"), ("annotates", f + "@workflow", f), ("depends_on", "proj::pkg.a", "proj::external::numpy"), ("depends_on", f, "proj::pkg.tool"), ("depends_on", "proj::pkg.a", "proj::pkg.tool"), ("validates", "proj::pkg.test_a::test_f", f)}
    assert not any(t == "proj::external::os" for _, _, t in edges)
    fs.unpersist()


def test_hash_ignores_format_and_docs(spark):
    code = {r.code_hash for r in facts(spark, ("p/a.py", "def f(a,b): return a", ""), ("p/b.py", "def f( a, b ):\n  '''doc'''\n  # c\n  return (a)\n", ""), ("p/c.py", "@task(purpose='x')\ndef f(a, b):\n    return a\n", "")).filter("subtype = 'function'").collect()}
    assert len(code) == 1


def test_markdown_and_manifest(spark):
    d = spark.createDataFrame([(1, "# T\r\n## One Two\r\nbody\n```\n## not\n```\n## Three\n", "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, part string")
    assert [(r.position, r.heading, r.slug) for r in scan.markdown_sections(d, "doc_id", "text").orderBy("position").collect()] == [(1, "One Two", "one-two"), (2, "Three", "three")]
    j = spark.createDataFrame([('{"title": "t", "sections": []}',), ('{"title": 1, "sections": []}',), ('{"title": "t", "sections": {}}',), ("{",), (None,)], "raw string")
    assert [r[0] for r in j.select(scan.is_docjson(j.raw)).collect()] == [True, False, False, False, False]
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", "3"), ("k", "4")], "path string, content_hash string")
    b = spark.createDataFrame([("x", "9"), ("w", "2"), ("n", "7"), ("k", "4")], "path string, content_hash string")
    assert {tuple(r) for r in scan.changed_files(a, b).collect()} == {("x", "M", None), ("w", "R", "y"), ("n", "A", None), ("z", "D", None)}
