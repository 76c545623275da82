import math
import random
from collections import Counter

from quillmesh.llm import subjects as sj
from quillmesh.llm.text import sentences, words

TERMS = {"law": "judge court appeal witness verdict lawyer".split(), "sport": "goal match league keeper coach season".split()}
RARE = {"law": ["notary", "bailiff"], "sport": ["paddle", "trophy"]}
TOOL = "The {} keeps one row for each {}. Run the check again after the {} has been merged."
D = "doc_id long, text string, subject string, k int"
E = "example_id long, subject string, lang string, text string, doc_id long"


def sentence(rnd, s, rare=False):
    a, b = rnd.sample(TERMS[s], 2)
    if rare:
        a = rnd.choice(RARE[s])
    return f"When a {a} changes, the {b} must be read again."


def tool(rnd):
    return TOOL.format(*(rnd.choice(["ledger", "cursor", "shard", "goal post".split()[1]]) for _ in range(3)))


def make(rnd):
    ex = []
    for i in range(60):
        s = ("law", "sport", "tooling")[i % 3]
        ex.append((i, s, "en", " ".join([tool(rnd)] + ([sentence(rnd, s) for _ in range(3)] if s in TERMS else [])), 1))
    docs, want = [], {}
    for i in range(120):
        kinds = (["law"], ["sport"], ["law", "sport"], [])[i % 4]
        body = [tool(rnd) for _ in range(2)] + [sentence(rnd, s, rnd.random() < 0.4) for s in kinds for _ in range(4)]
        rnd.shuffle(body)
        docs.append((i, "# Heading judge\n\n" + "\n\n".join(body), "clash", 5))
        want[i] = set(kinds) or {"tooling"}
    return docs, ex, want


def test_subjects(spark):
    docs, ex, want = make(random.Random(5))
    docs += [(500, None, "", 0), (501, "", "", 0), (502, "!!!", "", 0), (503, "A judge met the court. " + "Nothing is written here. " * 3000, "", 0)]
    d = spark.createDataFrame(docs, D)
    e = spark.createDataFrame([*ex, (99, None, None, None, 1), (100, "law", None, None, 1)], E)
    got = {}
    for r in sj.document_subjects(d, e).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert all(got.pop(i) == {"tooling"} for i in (500, 501, 502, 503))
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    # Words that no example has are learnt from the sentences they stand in.
    only = spark.createDataFrame([(700, "When a notary changes, the bailiff must be read again.", "", 0), *docs], D)
    assert [r.subject for r in sj.document_subjects(only, e).filter("doc_id = 700").collect()] == ["law"]


def test_empty(spark):
    d, e = spark.createDataFrame([], D), spark.createDataFrame([], E)
    assert sj.document_subjects(d, e).collect() == []
    one = spark.createDataFrame([(1, "Some text.", "", 0)], D)
    assert [tuple(r)[:2] for r in sj.document_subjects(one, e).collect()] == [(1, "tooling")]


def test_repeated_rows(spark):
    text = "A judge met the court. " + "Nothing is written here. " * 8
    docs, ex, _ = make(random.Random(6))
    d = spark.createDataFrame([(900, text, "", 0)] * 3 + docs, D)
    got = sj.document_subjects(d, spark.createDataFrame(ex, E)).filter("doc_id = 900").collect()
    assert [r.subject for r in got] == ["tooling"]


def test_sentences():
    text = "# Title judge.\n\nOne two. Three\nfour? - no\n\n- Item one.\n2. Item two.\n\n```python\nx = 1.\n```\n\nStatus: open\n\n<p>La&shy; ｆｉｎ．</p>"
    assert sentences(text) == ["one two.", "three four?", "item one.", "item two.", "la&shy; fin."]
    assert sentences("no end here") == ["no end here"]
    assert words("Wo-\r\nrd <b>b</b>old a\u00adb ＡＢ１ x_y") == ["word", "bold", "ab", "ab1", "x", "y"]


def test_headings_take_only_their_line():
    assert sentences("<p># H</p>\n<p>Text.</p>") == ["text."]
    assert sentences("<p># Usage 73</p>\n<p>One two. Three.</p>\n<div>## More</div><p>Four.</p>") == ["one two.", "three.", "four."]
    assert sentences("Before it.\n## Title\nDirectly\nunder. # stays.\n\n# Last") == ["before it.", "directly under.", "# stays."]
    assert sentences("Read this.\n# The judge met\n# the court. A witness\n# left.\n Then more.") == ["read this.", "the judge met the court.", "a witness left.", "then more."]
    assert sentences("# Title<br/>Under it.") == ["under it."] and sentences("# Only") == []


def hashed(nodes):
    from pyspark.sql import functions as F

    return nodes.select("sid", F.transform("content", lambda t: F.xxhash64(t)).alias("content"))


def test_graph_is_verified_and_labels_travel(spark):
    from pyspark.sql import functions as F

    rows = [(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["b", "c", "d"]), (4, ["c", "d", "e", "f"]), (5, ["e", "f"]), (6, ["x"]), (7, []), (11, ["e", "f", "g", "h", "i"]), (12, ["g", "h", "k", "l"]), (8, ["a", "b", *(f"z{i}" for i in range(9))]), (9, ["p", "q"]), (10, ["p", "q", "r"])]
    nodes = hashed(spark.createDataFrame(rows, "sid long, content array<string>"))
    got = {(r.src, r.dst) for r in sj.similar_passages(nodes, 0.6).collect()}
    assert {(min(e), max(e)) for e in got} == {(1, 2), (2, 3), (9, 10), (4, 5), (5, 11)} and all((b, a) in got for a, b in got)
    seeds = spark.createDataFrame([(1, 0), (9, 1)], "sid long, k int")
    assert {(r.sid, r.k) for r in sj.spread_labels(sj.similar_passages(nodes, 0.6), seeds, 0.8).collect()} == {(1, 0), (2, 0), (3, 0), (9, 1), (10, 1)}  # 8 holds all of 1, but much beside it
    # A long chain: labels arrive however many rounds it takes; a passage told two subjects takes neither.
    chain = spark.createDataFrame([(i, [f"t{i}", f"t{i + 1}"]) for i in range(5)], "sid long, content array<string>").select("sid", F.array_union("content", F.array(F.concat(F.lit("t"), (F.col("sid") + 2).cast("string")))).alias("content"))
    chain = hashed(chain)
    far = sj.spread_labels(sj.similar_passages(chain, 0.5), spark.createDataFrame([(0, 3)], "sid long, k int"), 0.8).collect()
    assert {r.sid for r in far} == {0, 1, 2, 3, 4} and {r.k for r in far} == {3}
    mixed = spark.createDataFrame([(1, 2), (3, 2), (2, 1), (2, 3), (4, 2), (2, 4)], "src long, dst long")
    assert {(r.sid, r.k) for r in sj.spread_labels(mixed, spark.createDataFrame([(1, 0), (3, 1)], "sid long, k int"), 0.8).collect()} == {(1, 0), (3, 1)}


def test_hot_pairs_of_terms(spark, monkeypatch):
    from quillmesh import runtime

    monkeypatch.setattr(runtime.Heavy.__init__, "__defaults__", (5,))
    nodes = hashed(spark.createDataFrame([(i, ["a", "b", f"u{i}"]) for i in range(60)], "sid long, content array<string>"))
    links = sj.similar_passages(nodes, 0.5)
    assert links.count() == 2 * 59
    assert sj.spread_labels(links, spark.createDataFrame([(7, 1)], "sid long, k int"), 0.8).count() == 60


def spread_by_hand(passages, seeds, similarity, purity):
    """The labels of the graph of all similar pairs, pair by pair."""
    sets = {i: set(c) for i, c in passages}
    near = {i: [j for j, b in sets.items() if j != i and a and b and len(a & b) >= similarity * math.sqrt(len(a) * len(b)) - 1e-9] for i, a in sets.items()}
    out, more = dict(seeds), True
    while more:
        told = {i: Counter(out[j] for j in near[i] if j in out) for i in sets if i not in out}
        more = {i: k for i, c in told.items() if c and (k := max(c, key=lambda x: (c[x], x))) is not None and c[k] >= purity * sum(c.values())}
        out |= more
    return out


def test_labels_travel_over_all_similar_pairs(spark, monkeypatch):
    from quillmesh import runtime

    rnd = random.Random(11)
    passages = [(i, rnd.sample([f"t{rnd.choice((0, 20))}{x}" for x in range(14)], rnd.choice([0, 1, 2, 2, 3, 3, 4, 5, 7, 13]))) for i in range(220)]
    passages += [(1000 + i, c) for i, c in passages[:20]]  # equal terms
    seeds = {i: i % 3 for i in rnd.sample(range(220), 25)}
    nodes = hashed(spark.createDataFrame(passages, "sid long, content array<string>"))
    sown = spark.createDataFrame(list(seeds.items()), "sid long, k int")
    monkeypatch.setattr(runtime.Heavy.__init__, "__defaults__", (30,))
    for similarity, purity in ((0.5, 0.8), (0.75, 0.5), (0.3, 0.6)):
        got = [tuple(r) for r in sj.spread_similar(nodes, sown, similarity, purity).select("sid", "k").collect()]
        assert len(got) == len(dict(got)) and dict(got) == spread_by_hand(passages, seeds, similarity, purity)
