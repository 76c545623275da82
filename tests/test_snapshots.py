import random
from datetime import datetime, timedelta

import pytest

from quillmesh.operators.snapshots import snapshot_changes

S = "snapshot_no int, id string, code_hash string, desc_hash string, updated_at timestamp, key string, digest string, now boolean"
T0 = datetime(2024, 1, 1)


def norm(x):
    return (x or "").strip().lower() or None


def brute(rows):
    state = {}
    for n, i, c, d, t in rows:
        if n is not None and i is not None:
            rank = (t is not None, t or T0, norm(c) is not None, norm(c) or "", norm(d) is not None, norm(d) or "")
            if i not in state.setdefault(n, {}) or rank > state[n][i][0]:
                state[n][i] = (rank, (norm(c), norm(d)))
    out, nos = set(), sorted(state)
    for p, n in zip(nos, nos[1:], strict=False):
        for i in state[n].keys() | state[p].keys():
            a, b = state[p].get(i), state[n].get(i)
            if a is None or b is None or a[1] != b[1]:
                out.add((n, i, "added" if a is None else "removed" if b is None else "changed"))
    return out


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_against_brute_force(spark, chunk):
    rnd = random.Random(chunk)
    rows = []
    for n in (3, 4, 9):
        for i in range(120):
            if rnd.random() < 0.9:
                for _ in range(rnd.choice([1, 1, 1, 2])):
                    code = f"c{i}" if rnd.random() < 0.9 else rnd.choice(["x", None, " "])
                    rows.append((n, f"k{i}", code.upper() + " " if code and rnd.random() < 0.3 else code, rnd.choice([None, "", f"d{i}"]) if rnd.random() < 0.1 else f"d{i}", T0 + timedelta(days=rnd.randrange(3)) if rnd.random() < 0.95 else None))
    rows += [(None, "k1", "a", "b", T0), (4, None, "a", "b", T0)]
    df = spark.createDataFrame([(*r, "clash", None, True) for r in rows], S)
    got = snapshot_changes(df, "snapshot_no", "id", "updated_at", ["code_hash", "desc_hash"], chunk)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_one_snapshot_and_none(spark):
    one = spark.createDataFrame([(1, "a", "x", "y", T0, "", "", True)], S)
    assert snapshot_changes(one, "snapshot_no", "id", "updated_at", ["code_hash"]).collect() == []
    assert snapshot_changes(one.limit(0), "snapshot_no", "id", "updated_at", ["code_hash"]).collect() == []
