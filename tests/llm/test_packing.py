import bisect
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import packing as pk

D = "doc_id long, text string, n_tokens int, plan_id string, piece int"


def best_fit(lengths, capacity):
    """Containers that best fit decreasing needs."""
    free = []
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, n)
        bisect.insort(free, (free.pop(i) if i < len(free) else capacity) - n)
    return len(free)


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=12), st.integers(60, 90))
@settings(max_examples=100, deadline=None)
def test_plan(histogram, capacity):
    placements, packs = pk.plan_packs(histogram, capacity)
    fill, seen = Counter(), Counter()
    for length, rank, first, n in placements:
        assert rank == seen[length]
        seen[length] += n
        for i in range(n):
            fill[first + i] += length
    assert seen == Counter(histogram) and set(fill) == set(range(packs))
    assert all(v <= capacity for v in fill.values())
    # No two containers could be one more than once: at most one is half empty.
    assert sum(2 * v <= capacity for v in fill.values()) <= 1


@pytest.mark.parametrize("part_items", [50_000, 7])
def test_operator(spark, part_items):
    rnd = random.Random(3)
    docs = [(i, None, 40 if i % 3 == 0 else rnd.randrange(1, 150)) for i in range(300)] + [(900, "a b", None), (901, None, None), (902, "", None), (903, "x", -1), (904, None, 1000), (900, "a b", 7)]
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], D)
    plans = spark.createDataFrame([(1, 100), (2, 500), (3, None), (4, 0), (1, 100)], "plan_id int, capacity int")
    rows = pk.pack(pk.sized(df), plans, part_items).collect()
    sizes = Counter({(d, n if n is not None and n >= 0 else len(t.split()) if t else 0): 1 for d, t, n in docs})
    for plan, cap in ((1, 100), (2, 500)):
        fill, pieces = Counter(), defaultdict(list)
        for r in rows:
            if r.plan_id == plan:
                fill[r.container] += r.length
                pieces[r.doc_id].append((r.start, r.length))
        assert max(fill.values()) <= cap
        assert sum(fill.values()) == sum(n for _, n in sizes)
        assert set(pieces) == {d for d, _ in sizes}
        for d, n in sizes:
            if d != 900:
                assert len(pieces[d]) == max(1, -(-n // cap)) and sum(x for _, x in pieces[d]) == n
    assert {r.plan_id for r in rows} == {1, 2}
    use = {r.plan_id: r for r in pk.usage(pk.pack(pk.sized(df), plans), plans).collect()}
    for plan, cap in ((1, 100), (2, 500)):
        lengths = [r.length for r in rows if r.plan_id == plan and r.length]
        assert use[plan].containers <= 1.01 * best_fit(lengths, cap) and use[plan].tokens == sum(lengths)
    assert pk.pack(pk.sized(df.limit(0)), plans).collect() == [] and pk.pack(pk.sized(df), plans.limit(0)).collect() == []


def test_tokens():
    assert pk.count_tokens("") == 0
    assert pk.count_tokens("It's  12ab_é!\n") == len(["It", "'s", " ", " 12", "ab", "_", "é", "!", "\n"])
