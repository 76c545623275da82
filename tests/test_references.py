from datetime import datetime

import pytest

from quillmesh import runtime
from quillmesh.operators import references as r

EDGES = "id string, from_id string, to_id string, loaded_at timestamp, key string, kind string"
T = [datetime(2024, 1, d) for d in range(1, 10)]


def found(spark, edges, nodes, history, ver=()):
    e = spark.createDataFrame([(*x, "clash", "clash") for x in edges], EDGES)
    v = spark.createDataFrame(list(ver), "node_id string, verified_at timestamp, kind string")
    n = spark.createDataFrame([(*x, None) for x in nodes], "key string, seen_at timestamp, existing string")
    h = spark.createDataFrame([(x,) for x in history], "key string")
    got = r.orphan_references(r.index_references(e, v), n, h)
    return {(x.table_name, x.ref_field, x.row_key, x.kind) for x in got.collect()}


def test_kinds_and_times(spark):
    edges = [("e1", "a", "gone", T[3]), ("e2", "a", "never", T[3]), ("e3", "a", "late", T[3]), ("e3", "a", "late", T[7]), ("e4", "a", "a", T[3]), ("e5", None, "  ", T[3])]
    got = found(spark, edges, [("a", T[0]), ("late", T[5]), ("late", T[6]), (None, T[1])], ["gone", "a", None], [("never", T[2], None), ("late", None, None), ("a", T[1], None)])
    assert got == {("edges", "to_id", "e1", "deleted"), ("edges", "to_id", "e2", "missing"), ("edges", "to_id", "e3", "late"), ("node_verification", "node_id", "never", "missing")}


def test_exact_comparison_and_empty(spark):
    assert found(spark, [("e1", "A ", "A", T[1])], [("A", T[0])], []) == {("edges", "from_id", "e1", "missing")}
    assert found(spark, [], [], []) == set()


def test_deltas_in_any_order(spark):
    refs = spark.createDataFrame([("k", T[1]), ("k", T[2]), ("m", T[1])], "key string, ref_time timestamp")
    ids = spark.createDataFrame([("k", T[0])], "key string, seen_at timestamp")
    a = r.apply_deltas(None, r.reference_deltas(refs), r.existence_deltas(ids))
    b = r.apply_deltas(r.apply_deltas(None, r.existence_deltas(ids)), r.reference_deltas(refs))
    assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    assert [x.key for x in r.orphan_keys(a).collect()] == ["m"]
    c = r.apply_deltas(a, r.existence_deltas(ids, -1), r.reference_deltas(refs.filter("key = 'm'"), -1))
    assert [x.key for x in r.orphan_keys(c).collect()] == ["k"]


@pytest.mark.parametrize("rows", [0, 10])
def test_hot_key_is_whole(spark, rows, monkeypatch):
    monkeypatch.setattr(runtime.Heavy.__init__, "__defaults__", (max(rows, 1),))
    edges = [(f"e{i}", "a", "hot" if i % 2 else f"x{i}", T[1]) for i in range(60)]
    assert len(found(spark, edges, [("a", T[0])], [])) == 60
