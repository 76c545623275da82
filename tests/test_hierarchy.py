import random
from datetime import datetime

import pytest

from quillmesh import runtime
from quillmesh.operators import hierarchy as h


def brute(parent):
    out = {}
    for x in parent:
        path, seen = [x], {x}
        while parent[path[-1]] is not None and parent[path[-1]] not in seen:
            path.append(parent[path[-1]])
            seen.add(path[-1])
        top = parent[path[-1]]
        out[x] = (path[-1], len(path) - 1, path[::-1]) if top is None else (min(path[path.index(top) :]), -1, None)
    return out


def forest(rnd, n):
    ids = [f"n{i:03}" for i in range(n)]
    rnd.shuffle(ids)
    parent = {ids[0]: None}
    for i, x in enumerate(ids[1:], 1):
        parent[x] = None if rnd.random() < 0.05 else ids[rnd.randrange(max(0, i - 3), i)]
    for _ in range(3):  # circles
        a = rnd.choice(ids)
        parent[a] = rnd.choice([a, *ids])
    return parent


@pytest.mark.parametrize("fragment", [7, 40, 100_000])
@pytest.mark.parametrize("paths", [False, True])
def test_against_brute_force(spark, fragment, paths):
    for seed in range(2):
        parent = forest(random.Random(seed), 150)
        df = spark.createDataFrame([(k, v, "clash") for k, v in parent.items()], "node string, parent string, root string")
        got = {r.node_id: (r.root_id, r.depth, r.path if paths else None) for r in h.hierarchy(df, fragment, paths).collect()}
        want = {k: (a, b, c if paths else None) for k, (a, b, c) in brute(parent).items()}
        assert got == want


@pytest.mark.parametrize("broadcast", [100_000, 1])
def test_random_mates_and_heavy_parents(spark, monkeypatch, broadcast):
    monkeypatch.setattr(runtime, "MOST_BROADCAST", broadcast)
    monkeypatch.setattr(runtime.Heavy.__init__, "__defaults__", (5,))
    rnd = random.Random(3)
    ids = [f"n{rnd.random()}" for _ in range(400)]
    parent = {x: ids[i - 1] if i else None for i, x in enumerate(ids[:200])}  # a chain in no order of ids
    parent |= {x: ids[rnd.choice([7, 9, i - 1])] for i, x in enumerate(ids[200:380], 200)}  # two parents of many
    parent |= {x: ids[380 + (i + 1) % 20] for i, x in enumerate(ids[380:])}  # a circle
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r.node_id: (r.root_id, r.depth, r.path) for r in h.hierarchy(df, 30, True).collect()}
    assert got == brute(parent)


def test_no_order(spark):
    parent = {f"n{i:03}": f"n{(i * 37 + 11) % 97:03}" if i % 9 else None for i in range(97)}
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r.node_id: (r.root_id, r.depth, r.path) for r in h.hierarchy(df, 2, True).collect()}
    assert got == brute(parent)


def test_parents_of_dirty_edges(spark):
    t = [datetime(2024, 1, d) for d in range(1, 9)]
    rows = [("e1", "Composes ", "a", "c", t[3]), ("e1", "composes", "a", "c", t[1]), ("e2", " COMPOSES", "b", "c", t[2]), ("e3", "composes", "z", "d", t[2]), ("e4", "composes", "y", "d", t[2]), ("e5", "composes", " ", "x", t[1]), ("e6", "uses", "q", "r", t[1]), ("e7", None, "q", "r", t[1]), ("e8", "composes", "a", None, None)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "id string, edge_type string, from_id string, to_id string, loaded_at timestamp, node double")
    assert {(r.node, r.parent) for r in h.composes_links(df).collect()} == {("a", None), ("b", None), ("c", "b"), ("d", "y"), ("y", None), ("z", None)}
    assert h.hierarchy(h.composes_links(df.limit(0))).collect() == []


def test_descendants(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "x"), ("y", "x")], "node string, parent string")
    got = {tuple(r) for r in h.descendants(h.hierarchy(df, with_paths=True)).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


@pytest.mark.parametrize("fragment", [3, 100_000])
def test_below_circles(spark, fragment):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("x", "z"), ("y", "x"), ("z", "y"), ("s", "s"), ("k", "y"), ("l", "k"), ("m", "l"), ("n", "k"), ("t", "s"), ("u", "t")], "node string, parent string")
    placed = h.all_paths(df, fragment)
    got = {r.node_id: (r.root_id, r.depth, r.path) for r in placed.collect()}
    assert got["m"] == ("x", -1, ["k", "l", "m"]) and got["k"] == ("x", -1, ["k"]) and got["u"] == ("s", -1, ["t", "u"])
    assert [got[x] for x in "xyzs"] == [("x", -1, None)] * 3 + [("s", -1, None)] and got["b"] == ("a", 1, ["a", "b"])
    assert {tuple(r) for r in h.descendants(placed).collect()} == {("a", "b", 1), ("k", "l", 1), ("k", "m", 2), ("l", "m", 1), ("k", "n", 1), ("t", "u", 1)}
