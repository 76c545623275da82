import random

import pytest

from quillmesh.llm import leaks as lk
from quillmesh.llm.text import words

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "so", "ti", "vu", "xe")]
D = "doc_id long, text string, item_id string, field string"
I = "item_id long, question string, passage string, doc_id long, text string"  # noqa: E741


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, q, p in items:
            for x in (q, p):
                y = words(x or "")
                if any(tuple(y[j : j + 12]) in grams for j in range(len(y) - 11)):
                    out.add((d, i))
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, "clash", "clash") for x in docs], D)
    i = spark.createDataFrame([(*x, 1, "clash") for x in items], I)
    return lk.leaks(d, i, **kw)


def test_distance():
    rnd = random.Random(1)

    def slow(p, t):
        row = [0] * (len(t) + 1)
        for i, a in enumerate(p, 1):
            new = [i]
            for j, b in enumerate(t, 1):
                new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
            row = new
        return min(row)

    for _ in range(300):
        p, t = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, n))) for n in (90, 40))
        assert lk.edit_distance_within(p, t) == slow(p, t)


@pytest.mark.parametrize(("errors", "block"), [(1, 20_000), (0, 3), (2, 5)])
def test_against_brute_force(spark, errors, block):
    rnd = random.Random(errors)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [(i, "read this then answer now please " + text(rnd.randrange(0, 20)), text(30)) for i in range(8)] + [(8, None, None), (9, "too short", "")]
    items.append((10, items[0][1], items[1][2]))
    docs = [(100, None), (101, ""), (102, text(5000))]
    for d in range(60):
        i = rnd.choice(items[:8])
        src = rnd.choice(i[1:]).split()
        n = rnd.choice([10, 11, 12, 13, len(src)])
        a = rnd.randrange(max(1, len(src) - n))
        docs.append((d, f"{text(30)} {' '.join(src[a : a + n])} {text(rnd.choice([0, 30]))}"))
    got = run(spark, docs, items, errors=errors, block=block)
    assert {(r.doc_id, r.item_id) for r in got.filter("exact_run >= 12").collect()} == brute(docs, items)


@pytest.mark.parametrize("errors", [1, 2])
def test_planted_edits(errors):
    """Every window within the budget is found, wherever the edits are: held against the edit distance of all windows."""
    rnd = random.Random(errors)
    text = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    items = [(i, f"read this then answer {text(rnd.randrange(9, 14))}") for i in range(12)]
    index = lk._Index(items, 12, errors)
    held = 0
    for _ in range(250):
        k, t = rnd.choice(items)
        w = t.split()
        a = rnd.randrange(len(w) - 11)
        x = list(" ".join(w[a : a + 12]))
        for _ in range(rnd.randrange(0, errors + 2)):
            at = rnd.choice([i for i, c in enumerate(x) if c == " "] if rnd.random() < 0.4 else range(1, len(x) - 1))
            x[at : at + rnd.randrange(2)] = [] if rnd.random() < 0.4 else [rnd.choice("az ")]
        doc = f"{text(4)} {''.join(x)} {text(4)}".split()
        got = {i: d for i, d, _ in index.search(doc)}
        for i, y in items:
            v = y.split()
            # Text around a window within the budget starts and ends at words that the edits may have parted or joined.
            least = min(lk.edit_distance_within(" ".join(v[s : s + 12]), " ".join(doc)) for s in range(len(v) - 11))
            if least <= errors:
                held += 1
                assert i in got and got[i] == least, (y, doc)
            else:
                assert i not in got
    assert held > 150


def test_without_the_automaton(monkeypatch):
    import sys

    rnd = random.Random(5)
    text = "".join(rnd.choice("ab ") for _ in range(3000))
    patterns = {text[i : i + rnd.randrange(2, 30)] for i in range(0, 900, 7)}
    native = lk.Automaton(patterns).hits(text)
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    assert sorted(lk.Automaton(patterns).hits(text)) == sorted(native)


def test_dirt_and_near(spark):
    base = [f"word{i}" for i in range(14)]
    item = [(1, " ".join(base), None)]
    docs = [(1, "<p>" + ", ".join(base[:6]).upper() + "</p>\n**" + "** _".join(base[6:]) + "_"), (2, " ".join(base).replace("word5", "wo-\nrd5").replace("word7", "w\u200bord\u00ad7").replace("word9", "ｗｏｒｄ９")), (3, " ".join(base).replace("word6", "wurd6")), (4, " ".join(base[:6] + ["x", "y", "z"] + base[6:]))]
    got = {r.doc_id: (r.distance, r.exact_run >= 12) for r in run(spark, docs, item).collect()}
    assert got == {1: (0, True), 2: (0, True), 3: (1, False)}


def test_empty(spark):
    assert run(spark, [], [(1, "a " * 20, None)]).collect() == []
    assert run(spark, [(1, "a " * 20)], []).collect() == []
