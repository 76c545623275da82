import random
from datetime import datetime, timedelta

import pytest

from quillmesh.operators.versions import versions

S = "id long, node_id string, scanned_at timestamp, change_type string, git_sha string, k string, v string, part int"
T0 = datetime(2024, 1, 1)


def brute(rows):
    out = []
    keys = {r[1] for r in rows if r[1] is not None}
    for k in keys:
        at = {}
        for r in rows:
            if r[1] == k and r[2] is not None and (r[2] not in at or (r[0] if r[0] is not None else -(2**63)) > (at[r[2]][0] if at[r[2]][0] is not None else -(2**63))):
                at[r[2]] = r
        runs = []
        for t in sorted(at):
            a = at[t][3:5]
            if not runs or runs[-1][1] != a:
                runs.append((t, a))
        for i, (t, a) in enumerate(runs):
            if a[0] != "DELETED":
                out.append((k, a[0], a[1], t, runs[i + 1][0] if i + 1 < len(runs) else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [20_000, 15, 3])
def test_against_brute_force(spark, heavy):
    from pyspark.sql import functions as F

    rnd = random.Random(heavy)
    rows = []
    for i in range(400):
        node = "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", "c", None])
        rows.append((i, node, T0 + timedelta(hours=rnd.randrange(150)) if rnd.random() < 0.97 else None, rnd.choice(["X", "Y", None, "DELETED"]), rnd.choice([None, "s"])))
    rows += rows[:20]
    df = spark.createDataFrame([(*r, "clash", "clash", 7) for r in rows], S)
    got = versions(df, "node_id", "scanned_at", ["change_type", "git_sha"], "id", ends=F.col("change_type") == "DELETED", heavy_rows=heavy)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty(spark):
    assert versions(spark.createDataFrame([], S), "node_id", "scanned_at", ["change_type"], "id").collect() == []
