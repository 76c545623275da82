"""Operators over a small index made by hand."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from quillmesh.mesh import Mesh, clean_edges, latest_nodes
from quillmesh.operators import drift, graph, history, inventory, mutations, rename, search, staleness

T = [datetime(2024, 1, d) for d in range(1, 29)]
NODES = "id string, node_type string, subtype string, title string, location string, status string, source string, code_hash string, desc_hash string, file_mtime double, level_0 string, level_1 string, level_2 string, level_3_location string, level_steps string, dflow_meta string, own_status string, link_status string, updated_at timestamp"
EDGES = "id string, edge_type string, from_id string, to_id string, weight double, via string, event string, loaded_at timestamp"
HISTORY = "id long, node_id string, scanned_at timestamp, change_type string, git_sha string, meta string, preserved boolean"
VERIFIED = "node_id string, status string, verified_at timestamp, verified_by string, reason string, code_hash_at string, desc_hash_at string"


def node(id_, kind="atomic_process", subtype="function", own="VERIFIED", link="VERIFIED", at=T[5], loc="p/a/x.py", code="c", desc="d", text="t"):
    return (id_, kind, subtype, id_, loc, "active", "json_doc_scanner" if subtype == "docjson" else "ast", code, desc, None, "", text, text, f"{loc}#L1-L2", None, None, own, link, at)


def mesh(spark, nodes, edges=(), hist=(), docs=(), sections=(), ver=(), cur=(), tags=()):
    e = [(f"{f}::{k}::{t}", k, f, t, 1.0, None, None, T[0]) for k, f, t in edges]
    h = [(i, n, at, kind, "s", None, False) for i, (n, at, kind) in enumerate(hist)]
    return Mesh(
        spark.createDataFrame(nodes, NODES), spark.createDataFrame(e, EDGES), spark.createDataFrame(list(tags), "node_id string, tag string"), spark.createDataFrame(h, HISTORY),
        spark.createDataFrame([(d, d, t, "f", None, T[0]) for d, t in docs], "id string, title string, tags array<string>, file_path string, desc_hash string, updated_at timestamp"),
        spark.createDataFrame([(s, d, "h", "c", None, T[0], 0, 0, None) for s, d in sections], "id string, doc_id string, heading string, content string, desc_hash string, updated_at timestamp, depth int, position int, parent_id string"),
        spark.createDataFrame([(n, "VERIFIED", at, "agent", None, c, d) for n, at, c, d in ver], VERIFIED),
        spark.createDataFrame(list(cur), "id string, gone boolean, cur_code string, cur_desc string"),
    )


def rows(df, *cols):
    return {tuple(r[c] for c in cols) for r in df.collect()}


def test_transitive_links(spark):
    nodes = [node("f"), *(node(s, subtype="docjson") for s in ("a", "b", "c", "z"))]
    kw = {"edges": [("documents", "a", "f"), ("documents", "b", "a"), ("documents", "c", "b"), ("documents", "b", "c"), ("documents", "z", "f")], "hist": [("f", T[3], "CONTENT_ONLY")], "docs": [("A", ["spec"]), ("B", ["consumer"]), ("Z", ["frozen"])], "sections": [("a", "A"), ("b", "B"), ("c", "B"), ("z", "Z")]}
    m = mesh(spark, nodes, **kw)
    assert rows(staleness.linked_stale(m), "id", "via") == {("a", "f"), ("z", "f")}
    assert rows(staleness.linked_stale(m, ["consumer"], ["frozen"]), "id", "via") == {("a", "f"), ("b", "a"), ("c", "b"), ("b", "c")}
    for at, want in ((T[2], {"a", "b", "c", "z"}), (T[3], {"z"})):  # verified before and at the change
        v = mesh(spark, nodes, ver=[("a", at, "c", "d")], **kw)
        assert {i for (i,) in rows(staleness.linked_stale(v, ["consumer"]), "id")} == want


def test_annotated_compares_times(spark):
    nodes = [node("f"), node("e1", "composite_process", "workflow", at=T[2]), node("e2", "composite_process", "workflow", at=T[9])]
    m = mesh(spark, nodes, [("annotates", "e1", "f"), ("annotates", "e2", "f")], [("f", T[5], "DESC_ONLY")])
    assert rows(drift.stale_annotated(m), "id", "via") == {("e1", "f")}


def test_delegation_goes_round(spark):
    nodes = [node(e, "composite_process", "workflow", at=T[1]) for e in ("e1", "e2")] + [node(s, subtype="autostep") for s in ("s1", "s2")] + [node("f1"), node("f2")]
    edges = [("composes", "e1", "s1"), ("delegates_to", "s1", "f2"), ("annotates", "e2", "f2"), ("composes", "e2", "s2"), ("delegates_to", "s2", "f1"), ("annotates", "e1", "f1")]
    m = mesh(spark, nodes, edges, [("f1", T[5], "CONTENT_ONLY")])
    assert rows(graph.stale_by_delegation(m, history.latest_change(m.history)), "id", "via") == {("e1", "f1"), ("e2", "f1")}


def test_inheritance(spark):
    nodes = [node("pkg", "composite_process", "module"), node("mod", "composite_process", "module"), node("f", own="CONTENT_UPDATED", link="BROKEN_LINK"), node("outer"), node("inner", own="NOT_FOUND"), node("x", "composite_process", "module"), node("y", "composite_process", "module", own="RENAMED"), node("up", "composite_process", "module"), node("self", own="DESC_UPDATED"), node("leaf")]
    m = mesh(spark, nodes, [("composes", "pkg", "mod"), ("composes", "mod", "f"), ("composes", "mod", "outer"), ("composes", "outer", "inner"), ("composes", "x", "y"), ("composes", "y", "x"), ("composes", "up", "x"), ("composes", "self", "leaf"), ("composes", "gone", "leaf")])
    got = {(i, o, link) for i, o, link in rows(graph.inherit(m, graph.severities(m.nodes)), "id", "own", "link")}
    assert got >= {("pkg", 2, 2), ("mod", 2, 2), ("outer", 0, 1), ("self", 1, 1), ("x", 0, 0), ("y", 3, 0), ("up", 0, 0), ("gone", 0, 0)}


def inherited(edges, kinds, given):
    """Brute force: leaves first, what is on or above a circle left as it was."""
    kids, done = {}, {}
    for p, c in edges:
        kids.setdefault(p, set()).add(c)
    names = {x for e in edges for x in e} | set(given)
    got = {x: given.get(x, (0, 0)) for x in names if x not in kids}
    while True:
        ready = [p for p in kids if p not in got and kids[p] <= set(got)]
        if not ready:
            break
        for p in ready:
            own, link = given.get(p, (0, 0))
            wo, wl = max([own, *(got[c][0] for c in kids[p])]), max([link, *(got[c][1] for c in kids[p])])
            got[p] = done[p] = (own, max(wl, 1) if wo or wl else wl) if kinds.get(p) == "atomic_process" else (wo, wl)
    return {x: done.get(x, given.get(x)) for x in set(given) | set(done)}


@pytest.mark.parametrize("fragment", [250_000, 40, 6])
def test_inheritance_by_fragments(spark, fragment):
    rnd = random.Random(fragment)
    ids = [f"n{i:03}" for i in range(120)]
    rnd.shuffle(ids)
    edges = {(ids[i], ids[rnd.randrange(i + 1, min(i + 9, 120))]) for i in range(118) for _ in range(2)} | {(ids[0], x) for x in ids[1:60]}  # one with many children
    edges |= {(ids[100], ids[90]), (ids[7], "far"), ("none", ids[50])}
    kinds = {x: rnd.choice(["atomic_process", "composite_process"]) for x in ids}
    given = {x: (rnd.choice([0, 0, 0, 1, 2, 4]), rnd.choice([0, 0, 0, 1, 2])) for x in ids}
    m = mesh(spark, [node(x, kinds[x], "module") for x in ids], [("composes", a, b) for a, b in edges])
    s = spark.createDataFrame([(k, *v) for k, v in given.items()], "id string, own int, link int")
    got = {r.id: (r.own, r.link) for r in graph.inherit(m, s, fragment).collect()}
    assert got == inherited(edges, kinds, given)


def test_stored_renames_stay(spark):
    nodes = [node("a", own="RENAMED"), node("b", own="RENAMED"), node("c")]
    m = mesh(spark, nodes, cur=[("a", False, "c", "d"), ("b", True, None, None), ("c", False, "c", "d")])
    assert dict(rows(staleness.statuses(m), "id", "own_status")) == {"a": "RENAMED", "b": "NOT_FOUND", "c": "VERIFIED"}
    assert dict(rows(staleness.statuses(m, renamed=spark.createDataFrame([("c",)], "id string")), "id", "own_status"))["c"] == "RENAMED"


def test_long_chains_of_delegation(spark):
    n = 34
    nodes = [x for i in range(n) for x in (node(f"e{i}", "composite_process", "workflow"), node(f"e{i}::step-1", subtype="autostep"), node(f"f{i}"))]
    edges = [x for i in range(n) for x in (("composes", f"e{i}", f"e{i}::step-1"), ("annotates", f"e{i}", f"f{i}"), *([("delegates_to", f"e{i}::step-1", f"f{i + 1}")] if i + 1 < n else []))]
    m = mesh(spark, nodes, edges)
    steps = graph.expanded_steps(m).filter("root = 'e0'").collect()
    assert len(steps) == n and max(r.path.count(".") for r in steps) == n - 1
    start = spark.createDataFrame([("e0",)], "id string")
    assert graph.reachable_tasks(m, start).count() == 32 and graph.reachable_tasks(m, start, None).count() == n - 1


def test_own_statuses_and_promotion(spark):
    nodes = [node("same"), node("code"), node("desc"), node("both"), node("gone"), node("new"), node("m", "composite_process", "module"), node("s", subtype="step"), node("done"), node("nohash", code=None)]
    cur = [("same", False, "c", "d"), ("code", False, "x", "d"), ("desc", False, "c", "x"), ("both", False, "x", "x"), ("gone", True, "c", "d"), ("m", False, "x", "x"), ("s", True, "c", "d"), ("done", False, "x", "y"), ("nohash", False, "x", "d")]
    m = mesh(spark, nodes, cur=cur, ver=[("done", T[1], "X", "y")])
    assert rows(staleness.own_statuses(m), "id", "own") == {("same", 0), ("code", 2), ("desc", 1), ("both", 2), ("gone", 4), ("new", 0), ("m", None), ("s", 0), ("done", 2), ("nohash", 0)}
    got = dict(rows(staleness.statuses(m), "id", "own_status"))
    assert got["done"] == "VERIFIED" and got["code"] == "CONTENT_UPDATED" and got["gone"] == "NOT_FOUND"
    assert rows(staleness.transitions(m.nodes.select("id", "own_status", "link_status"), staleness.statuses(m)), "id", "event") == {("code", "BECAME_CONTENT_UPDATED"), ("both", "BECAME_CONTENT_UPDATED"), ("desc", "BECAME_DESC_UPDATED"), ("gone", "BECAME_NOT_FOUND")}


def test_drift_filters(spark):
    with pytest.raises(ValueError, match="unknown filter"):
        drift.parse_filter("nope")
    assert drift.parse_filter("staleness")[1] == {"LINKED_STALE"}
    nodes = [node("a", own="NOT_FOUND", loc="p/viz/x.py"), node("b", link="BROKEN_LINK", loc="p/viz/y.py"), node("c", loc="p/index/z.py"), node("d", subtype="docjson", text="x" * 2001, loc="")]
    m = mesh(spark, nodes)
    assert rows(drift.drift_rows(m), "id") == {("a",), ("b",)}
    assert rows(drift.drift_rows(m, "all", "P/**/X.py*"), "id") == {("a",)}
    assert rows(drift.drift_rows(m, "doc_quality"), "id") == {("d",)}
    assert rows(drift.drift_counts(m, drift.drift_rows(m, "all"), "location_prefix"), "grp", "n") == {("p/viz", 2), ("#L1-L2", 1)}
    page = drift.drift_page(m, drift.drift_rows(m), 1, 1).collect()
    assert [(r.id, r.total) for r in page] == [("b", 2)]


def test_features_and_frozen(spark):
    nodes = [node("f", own="NOT_FOUND"), node("g", own="NOT_FOUND"), node("p::docs.features.viz.design::s", subtype="docjson", link="LINKED_STALE"), node("p::docs.features.idx::t", subtype="docjson", link="BROKEN_LINK")]
    sec = [("p::docs.features.viz.design::s", "p::docs.features.viz.design"), ("p::docs.features.idx::t", "p::docs.features.idx")]
    m = mesh(spark, nodes, [("documents", sec[0][0], "f"), ("documents", sec[1][0], "f")], docs=[(d, ["frozen"]) for _, d in sec], sections=sec)
    assert rows(drift.features(m), "id", "feature") == {("f", "idx")}
    assert rows(drift.drift_counts(m, drift.drift_rows(m, "all"), "feature"), "grp", "n") == {("idx", 1), ("(undocumented)", 3)}
    assert rows(drift.drift_rows(m, "links", frozen_tags=["frozen"]), "id", "marker") == {(sec[1][0], "[frozen-source]")}
    assert rows(drift.drift_rows(m, "links", frozen_tags=["frozen"], include_frozen=True), "marker") == {("[frozen]",)}


def test_cutoffs(spark):
    m = mesh(spark, [node("a")], hist=[("a", T[0], "INITIAL"), ("b", T[0], "INITIAL"), ("a", T[3], "BECAME_RENAMED"), ("a", T[6], "CHECKPOINT")])
    assert history.resolve_cutoff(m.history) == (T[6], "s")
    assert history.resolve_cutoff(m.history.filter("id < 3"), "s") == (T[0], "s")
    assert history.resolve_cutoff(m.history, "nope") == (None, None)
    assert history.resolve_cutoff(m.history, None, T[2]) == (T[2], None)
    assert rows(history.history_since(m.history, T[0], T[3]), "id") == {(2,)}


def test_khop(spark):
    m = mesh(spark, [node("a")], [("x", "a", "b"), ("x", "b", "c"), ("y", "c", "a"), ("x", "d", "a")])
    assert rows(graph.khop_edges(m, "a", "out", 2), "from_id", "to_id", "hop") == {("a", "b", 1), ("b", "c", 2)}
    assert {e for e, *_ in rows(graph.khop_edges(m, "a", "both", 1), "id")} == {"a::x::b", "c::y::a", "d::x::a"}
    assert rows(graph.khop_nodes(m, "a", "out", 9), "id", "level") == {("a", 0), ("b", 1), ("c", 2)}


def test_upsert(spark):
    m = mesh(spark, [node("a", own="NOT_FOUND"), node("b")], hist=[("a", T[0], "INITIAL")], ver=[("a", T[1], "c", "d"), ("b", T[1], "c", "d")])
    new = spark.createDataFrame([node("a", code="C2"), node("b"), node("n")], NODES)
    full = mutations.upsert_nodes(m, new, T[20], False, "sha")
    assert rows(full.nodes, "id", "code_hash", "own_status") == {("a", "C2", "VERIFIED"), ("b", "c", "VERIFIED"), ("n", "c", "VERIFIED")}
    assert rows(full.history.filter("git_sha = 'sha'"), "node_id", "change_type") == {("a", "CONTENT_ONLY"), ("n", "INITIAL")}
    assert rows(full.verification, "node_id") == {("b",)}
    seen = mutations.upsert_nodes(m, new, T[20])
    assert rows(seen.nodes, "id", "code_hash", "own_status") == {("a", "c", "NOT_FOUND"), ("b", "c", "VERIFIED"), ("n", "c", "VERIFIED")}
    again = mutations.upsert_nodes(full, new, T[21], False)
    assert again.history.count() == full.history.count()


def test_delete_keeps_documents_links(spark):
    m = mesh(spark, [node("gone"), node("stay"), node("doc", subtype="docjson")], [("documents", "doc", "gone"), ("depends_on", "stay", "gone"), ("composes", "gone", "stay")], hist=[("gone", T[0], "INITIAL")], tags=[("gone", "x")])
    out = mutations.delete_nodes(m, m.nodes.filter("id = 'gone'").select("id"), T[9])
    assert rows(out.edges, "edge_type") == {("documents",)}
    assert sorted((r.node_id, r.change_type) for r in out.history.collect()) == [("gone", "DELETED"), ("stay", "LINK_REMOVED"), ("stay", "LINK_REMOVED")]
    assert out.tags.count() == 0 and rows(drift.broken_links(out), "id", "target") == {("doc", "gone")}
    assert rows(mutations.purge(m, spark.createDataFrame([("gone",), ("no",)], "id string"), T[9])[1], "id", "result") == {("gone", "not_stale"), ("no", "unknown")}


def test_rename_moves_all(spark):
    m = mesh(spark, [node("p::f"), node("p::f@workflow"), node("p::f::step-1"), node("q::g")], [("documents", "s", "p::f"), ("documents", "s", "q::g"), ("annotates", "p::f@workflow", "p::f")], hist=[("p::f", T[0], "INITIAL"), ("p::f::step-1", T[0], "INITIAL")], ver=[("p::f", T[0], "c", "d"), ("q::g", T[1], "c", "d")])
    out = mutations.rename(m, spark.createDataFrame([("p::f", "q::g")], "old_id string, new_id string"))
    assert rows(out.edges, "id") == {("s::documents::q::g",), ("q::g@workflow::annotates::q::g",)}
    assert rows(out.history, "node_id") == {("q::g",), ("q::g::step-1",)}
    assert rows(out.nodes, "id") == {("p::f",), ("q::g",), ("q::g@workflow",), ("q::g::step-1",)}
    assert rows(out.verification, "node_id", "verified_at") == {("q::g", T[1])}


def test_rename_matcher(spark):
    s = "id string, scope string, code_hash string, body string"
    lost = spark.createDataFrame([("l1", "a", "h1", "x"), ("l2", "a", "h2", "def f(a):\n    return a + 1"), ("l3", "a", "h3", "completely other words"), ("l4", "b", None, None), ("l5", "big", "h5", "same body")], s)
    found = spark.createDataFrame([("n1", "z", "h1", "y", True), ("n2", "a", "k", "def g(a):\n    return a + 1", True), ("n3", "a", "h3", "completely other words", False)] + [(f"b{i}", "big", None, "same body", True) for i in range(60)], s + ", is_new boolean")
    got = {(r.old_id, r.new_id, r.reason) for r in rename.match(lost, found).collect()}
    assert got == {("l1", "n1", None), ("l2", "n2", None), ("l3", None, None), ("l4", None, "no_body"), ("l5", None, "pool_cap")}


def test_rename_matcher_compares_large_scopes(spark):
    body = "def f{0}(a):\n    return a + {0} * {0}"
    nodes = [node(f"p::m.old{i}", loc="p/m.py", text=body.format(i)) for i in range(7)] + [node(f"p::m.new{i}", loc="p/m.py", text=body.format(i) + "\n") for i in range(60)]
    nodes += [node("p::other", loc="p/o.py", text=body.format(3))]
    current = spark.createDataFrame([(f"p::m.old{i}", f"h{i}", None, True) for i in range(7)], "id string, cur_code string, cur_desc string, gone boolean")
    lost, found = rename.lost_and_found(mesh(spark, nodes).nodes, current)
    got = {(r.old_id, r.new_id, r.reason) for r in rename.match(lost, found, pool_cap=None, block=4).collect()}
    assert got == {(f"p::m.old{i}", f"p::m.new{i}", None) for i in range(7)}


def test_deep_delegation_is_expanded(spark):
    n = 11
    nodes = [node(f"e{i}", "composite_process", "workflow") for i in range(n)] + [node(f"e{i}::step-1", subtype="step") for i in range(n)]
    edges = [("composes", f"e{i}", f"e{i}::step-1") for i in range(n)]
    edges += [e for i in range(n - 1) for e in (("delegates_to", f"e{i}::step-1", f"f{i + 1}"), ("annotates", f"e{i + 1}", f"f{i + 1}"))]
    got = graph.expanded_steps(mesh(spark, nodes, edges)).filter("root = 'e0'")
    assert rows(got, "step") == {(f"e{i}::step-1",) for i in range(n)}


def test_search_stages(spark):
    m = mesh(spark, [node("p::alpha", text="Frozen queues"), node("p::beta", text="A frozen queue"), node("p::gamma", text="nothing")], tags=[("p::alpha", "x")])
    hit = lambda *a, **k: rows(search.keyword_search(m, *a, **k), "id", "mode", "total")
    assert hit("queue FROZEN") == {("p::beta", "fts", 1)}
    assert hit("gamma") == {("p::gamma", "fts", 1)}
    assert hit("gamma", level=1) == set()
    assert hit("roze ueue") == {("p::alpha", "like_and", 2), ("p::beta", "like_and", 2)}
    assert hit("zzz othin") == {("p::gamma", "like_or", 1)}
    assert hit("zzz othin", tag="x") == set() and hit("") == set()


def test_projection_of_dirt(spark):
    e = spark.createDataFrame([("1", " Composes", "a", "b", 1.0, {"via": "on"}, T[3]), ("1", "composes", "a", "b", 2.0, None, T[1]), ("2", "composes", "a", " ", 1.0, None, T[1]), ("3", None, "a", "b", 1.0, None, T[1])], "id string, edge_type string, from_id string, to_id string, weight double, meta map<string,string>, loaded_at timestamp")
    assert [tuple(r) for r in clean_edges(e).collect()] == [("a::composes::b", "composes", "a", "b", 2.0, "on", None, T[1])]
    n = spark.createDataFrame([("a", "old", T[1], T[2]), ("a", "new", T[1], T[3]), (None, "x", T[1], T[3])], "id string, code_hash string, updated_at timestamp, loaded_at timestamp")
    assert rows(latest_nodes(n), "id", "code_hash") == {("a", "new")}


def test_sql_passthrough(spark):
    m = mesh(spark, [node("a"), node("b" * 100)])
    with pytest.raises(ValueError, match="SELECT"):
        inventory.run_sql(spark, m, "DELETE FROM nodes")
    assert rows(inventory.run_sql(spark, m, "select id, file_mtime from nodes order by id", 1), "id", "file_mtime") == {("a", "NULL")}
    assert max(len(r.id) for r in inventory.run_sql(spark, m, "SELECT id FROM nodes").collect()) == 80


def test_upserts_of_sections_without_broadcasts(spark):
    """Tables too large to be broadcast are joined by the key after a union of sides that are both partitioned by it."""
    import __spark_entry__ as e

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = "/root/testdata/sf0.001"
        got = e.queries()["snk5_upsert_sections"](spark, d).collect()
        assert {r.id for r in got} == {r.id for r in spark.read.parquet(f"{d}/nodes.parquet").filter("subtype = 'docjson'").select("id").distinct().collect()}
        assert len(got) == len({r.id for r in got}) and any(r.level_1 == r.level_1.upper() for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
