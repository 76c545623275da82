import json
from datetime import datetime

import pytest

from quillmesh import store
from quillmesh.__main__ import run
from quillmesh.api import Index
from quillmesh.operators import documents, render
from quillmesh.sources import project

T = datetime(2025, 1, 1)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("w") / "proj"
    (root / "docs").mkdir(parents=True)
    (root / "pkg.py").write_text('def f(a):\n    """Does it. More."""\n    return a\n\n\n@workflow(purpose="p")\ndef g():\n    Step(step_num=1, name="a", purpose="b")\n    AutoStep(step_num=2)\n    f(1)\n')
    doc = {"title": "Guide", "tags": ["Spec"], "sections": [{"id": "intro", "heading": "Intro", "content": "the text", "links": [{"node_id": "proj::pkg::f"}, {"node_id": "proj::none"}], "sections": [{"id": "sub", "heading": "Sub", "content": "x"}]}, {"id": "end", "heading": "End"}]}
    (root / "docs" / "guide.json").write_text(json.dumps(doc))
    x = Index(spark, str(root))
    assert x.build(at=T)["docs"] == 1
    return x


def col(df, *names):
    return {tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_reads(index):
    assert {"proj::pkg", "proj::pkg::f", "proj::pkg::g@workflow", "proj::docs.guide", "proj::docs.guide::intro.sub"} <= col(index.list(), "id")
    assert col(index.search("does OR nothing"), "id") == {"proj::pkg::f"}
    assert "  outgoing:" in index.tree("proj::pkg", depth=2) and index.tree("proj::none") == ["  (no edges)"]
    assert index.source(["proj::pkg::f", "x"]).filter("id = 'x'").first()["result"] == "not_found"
    assert "return a" in index.source(["proj::pkg::f"]).first()["text"]
    assert col(index.read_doc("proj::docs.guide", "su"), "part", "result") == {("proj::docs.guide::intro.sub", "section")}
    assert col(index.read_doc("proj::docs.guide", "nope"), "result") == {"unknown"} and "Linked nodes" in index.read_doc("proj::docs.guide").first()["text"]
    assert col(index.workflow_detail("g"), "path", "delegates_to", "note") == {("1", None, None), ("2", "proj::pkg::f", "target not annotated")}
    assert col(index.drift(), "id") == {"proj::docs.guide::intro"} and col(index.drift(group_by="status"), "n") == {1}
    header, rows = index.render(1, size=2)
    assert header.startswith("[2 of ") and "pass offset=2" in header and rows.count() == 2
    assert col(index.sql("SELECT count(*) AS n FROM docs"), "n") == {"1"}


def test_documents(index):
    x = index
    assert col(x.update_section("proj::docs.guide::intro", heading="Start", new_id="start", at=T), "result") == {"done"}
    assert {"proj::docs.guide::start", "proj::docs.guide::start.sub"} <= col(x.mesh.sections, "id") and "proj::docs.guide::start.sub" in col(x.mesh.nodes, "id")
    assert ("proj::docs.guide::start", "proj::pkg::f") in col(x.mesh.edges.filter("edge_type = 'documents'"), "from_id", "to_id")
    assert col(x.add_section("proj::docs.guide", "mid", "Mid", "m", None, "start", at=T), "result") == {"done"}
    order = [r["id"].rpartition("::")[2] for r in x.mesh.sections.orderBy("position").collect()]
    assert order == ["start", "start.sub", "mid", "end"]
    assert col(x.update_section("proj::docs.guide::start", after="end", at=T), "result") == {"done"}
    assert [r["id"].rpartition("::")[2] for r in x.mesh.sections.orderBy("position").collect()] == ["mid", "end", "start", "start.sub"]
    for section, parent, after, want in (("Bad One", None, None, "bad_name"), ("mid", None, None, "taken"), ("a", "nope", None, "no_parent"), ("a", None, "nope", "no_sibling")):
        assert col(x.add_section("proj::docs.guide", section, "H", None, parent, after, at=T), "result") == {want}
    assert col(x.update_section("proj::docs.guide::mid", at=T), "result") == {"nothing"} and col(x.update_section("proj::docs.guide::mid", new_id="end", at=T), "result") == {"taken"}
    assert col(x.patch_section("proj::docs.guide::mid", "!", "$"), "result") == {"done"} and col(x.patch_section("proj::docs.guide::mid", "y", None, "zz"), "result") == {"absent"}
    assert x.mesh.sections.filter("id = 'proj::docs.guide::mid'").first()["content"] == "m!"
    assert col(x.update_doc("proj::docs.guide", "New", ["A"], at=T), "result") == {"done"} and col(x.update_doc("proj::docs.guide", " ", at=T), "result") == {"empty_title"}
    assert ("proj::docs.guide", "a") in col(x.mesh.tags, "node_id", "tag")
    x.add_links("proj::docs.guide::mid", ["proj::pkg::g"], at=T)
    x.delete_links("proj::docs.guide::start", ["proj::none"], at=T)
    assert col(x.mesh.edges.filter("edge_type = 'documents'"), "from_id", "to_id") == {("proj::docs.guide::mid", "proj::pkg::g"), ("proj::docs.guide::start", "proj::pkg::f")}
    x.delete_section("proj::docs.guide::start", at=T)
    assert col(x.mesh.sections, "id") == {"proj::docs.guide::mid", "proj::docs.guide::end"}
    for slug, raw, want in (("a::b", "{}", "node_id"), ("a?", '{"title": "t", "sections": []}', "bad_character"), ("b", "{", "no_object"), ("b", '{"title": "t"}', "no_sections"), ("b", '{"title": "t", "sections": [{"id": "a"}]}', "section_without_id_or_heading")):
        assert col(x.write_doc(slug, raw, at=T), "error") == {want}
    deep = {"id": "a", "heading": "h"}
    for _ in range(3):
        deep = {"id": "a", "heading": "h", "sections": [deep]}
    assert col(x.write_doc("deep", json.dumps({"title": "t", "sections": [deep]}), at=T), "error") == {"too_deep"}
    x.delete_doc("proj::docs.guide", at=T)
    assert x.mesh.sections.count() == 0


def test_writes(index, tmp_path, capsys):
    x = index
    assert col(x.mark_clean(["proj::pkg::f", "x"], "ok", at=datetime(2025, 1, 2)), "id", "result") == {("proj::pkg::f", "marked"), ("x", "not_found")} and col(x.agent_verified(), "node_id") == {"proj::pkg::f"}
    assert x.link("proj::pkg::f", "delegates_to", "proj::pkg::g", at=T) == "added" and x.link("proj::pkg::f", "consumes", "proj::pkg::g", at=T) == "not_allowed" and x.link("q", "consumes", "proj::pkg::g", at=T) == "no_start"
    assert col(x.purge(["proj::pkg::f", "x"], at=T), "id", "result") == {("proj::pkg::f", "not_stale"), ("x", "unknown")}
    assert col(x.apply_rename("proj::pkg::f", "proj::pkg::g", at=T), "reason") == {"old_status_VERIFIED"} and col(x.revert_rename("proj::pkg::g", at=T), "reason") == {"no_rename_record"}
    x.checkpoint("0123456789abcdef", "m", at=T)
    assert col(x.reference_points(), "git_sha", "kind", "message") == {("0123456789ab", "checkpoint", "m")}
    with pytest.raises(ValueError):
        x.report("fffff")
    target = str(tmp_path / "copy")
    assert x.checkout(target) and not x.checkout(target) and store.load(x.spark, target).nodes.count() == x.mesh.nodes.count()
    assert x.vacuum() > 0 and x.mesh.nodes.count() > 0
    assert x.embed().count() == x.mesh.nodes.count() and x.search("anything", "semantic", most=3).count() == 3
    for argv in (["list", "--type", "module"], ["graph", "proj::pkg"], ["search", "does"], ["sql", "SELECT count(*) AS n FROM nodes"], ["drift", "--group-by", "status"], ["history", "proj::pkg::f"], ["report"], ["render"], ["workflows"], ["workflow", "g"], ["export", str(tmp_path / "out")], ["agent-verified"]):
        assert run([x.root, *argv], x) == 0
    assert run([x.root, "check", "--fail-on", "any", "--json"], x) == 0 and run([x.root, "link", "q", "composes", "z"], x) == 1 and run([x.root, "checkout", target], x) == 1
    assert '"id":"proj::pkg::f"' in capsys.readouterr().out


def test_site(spark, tmp_path):
    out = tmp_path / "site"
    pages = spark.createDataFrame([("p::docs.a.b", "# T"), ("p::docs.c", "# C"), ("p::docs.a.own", "# O"), ("p::x", "# X")], "doc_id string, markdown string")
    (out / "docs" / "a").mkdir(parents=True)
    (out / "docs" / "a" / "own.md").write_text("mine")
    t = render.parse_targets([{"name": "s", "out": str(out), "prefix": "docs."}, {"name": "o", "out": str(out / "all"), "overwrite": True}])
    got = {r.path: r.state for r in render.build_site(pages, t[0]).collect()}
    assert got == {"docs/a/b.md": "written", "docs/c.md": "written", "docs/a/own.md": "foreign"} and (out / "docs" / "a" / "own.md").read_text() == "mine"
    assert {r.state for r in render.build_site(pages, t[0]).filter("doc_id = 'p::docs.c'").collect()} == {"written"}
    assert set(render.render_targets(pages, t, "o")) == {"o"}
    for bad in ([{"name": "a"}], [{"name": "a", "out": "x", "z": 1}], [{"name": "a", "out": "x"}] * 2):
        with pytest.raises(ValueError):
            render.parse_targets(bad)
    assert render.nav_leaves({"show": ["a", {"title": "t", "show": ["b", "c"]}]}) == [("0", "a"), ("1.0", "b"), ("1.1", "c")]
    with pytest.raises(ValueError):
        render.nav_leaves({"show": [3]})
    assert "- [T](a.md)" in render.toctree([("a.md", "T")]) and json.loads(render.manifest_json([("a", "d", "h")])) == {"a": {"doc_id": "d", "hash": "h"}}


def test_tree():
    e = [("composes", "a", "b"), ("calls", "b", "a"), ("composes", "b", "c"), ("uses", "x", "a")]
    assert render.render_tree("a", e, "both", {"c": "f#L1"}) == ["  outgoing:", "  --[composes]--> b", "      --[calls]--> a", "      --[composes]--> c  @ f#L1", "  incoming:", "  <--[calls]-- b", "      <--[composes]-- a", "  <--[uses]-- x"]


def test_links_of_renamed_nodes(spark):
    raw = json.dumps({"title": "t", "sections": [{"id": "a", "heading": "h", "links": [{"node_id": "old"}, {"node_id": "k"}], "sections": [{"id": "b", "heading": "h", "links": [{"node_id": "old"}]}]}]})
    docs = spark.createDataFrame([("d1", raw), ("d2", raw.replace("old", "o2")), ("d3", None)], "doc_id string, raw string")
    pairs = spark.createDataFrame([("old", "new")], "old_id string, new_id string")
    got = {r.doc_id: json.loads(r.raw) for r in documents.patch_links(docs, pairs).collect()}
    assert set(got) == {"d1"} and got["d1"]["sections"][0]["links"] == [{"node_id": "new"}, {"node_id": "k"}] and got["d1"]["sections"][0]["sections"][0]["links"] == [{"node_id": "new"}]


def test_repeated_patches(spark):
    m = store.empty(spark)
    m = documents.write_docs(m, spark.createDataFrame([("p", "a", json.dumps({"title": "t", "sections": [{"id": "s", "heading": "h", "content": "c"}]}))], "project string, slug string, raw string"), T)[0]
    two = spark.createDataFrame([("p::docs.a::s", "$", None, "1"), ("p::docs.a::s", "^", None, "2"), ("q", "$", None, "1")], "id string, anchor string, old_text string, new_text string")
    out, told = documents.patch_sections(m, two)
    assert {(r.id, r.result) for r in told.collect()} == {("p::docs.a::s", "repeated"), ("q", "unknown")} and [r.content for r in out.sections.collect()] == ["c"]


def test_skips(spark):
    df = spark.createDataFrame([("a/node_modules/x.py",), ("a/b.py",)], "p string")
    assert [r[0] for r in df.select(project.not_skipped(df.p)).collect()] == [False, True]
