"""Subject area of each document: labels spread from trusted examples over a verified graph of similar passages."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Collection, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Heavy, cut, extend, release, salted_join, spread
from .text import sentences, terms

#: The examples are fitted on the driver; at most so many.
MOST_EXAMPLES = 100_000
#: Up to so many labelled terms are broadcast; beyond, the joins are shuffled.
MOST_BROADCAST = 200_000
#: Terms that lie at most so far apart in a passage's sorted terms make a candidate key together.
REACH = 11
#: What newly labelled passages of at most so many terms tell is counted by subsets of their terms, if passages of no more than
#: MOST_SUBSETS_OF terms can be similar to them.
SHORT, MOST_SUBSETS_OF = 3, 16
#: The number of a subject takes so many bits beside a count.
BITS = 10
SENTENCES = "doc_id long, total int, n int, common int, terms array<string>"
SENTENCES_ARROW = pa.schema([("doc_id", pa.int64()), ("total", pa.int32()), ("n", pa.int32()), ("common", pa.int32()), ("terms", pa.list_(pa.string()))])


class Seeds:
    """What the labelled examples say: the language of words, terms that are trusted for a subject, terms of the rest, terms
    common to subjects, and the passages themselves."""

    def __init__(self, rows: list[tuple[str, str, str]], rest: str, share: float = 0.75, least: int = 2):
        langs: dict[str, Counter] = defaultdict(Counter)
        by: dict[str, Counter] = defaultdict(Counter)
        for subject, lang, text in rows:
            tag = (lang or "").strip().lower()[:2]
            for w in {w for s in sentences(text or "") for w in terms(s)}:
                langs[w][tag] += 1
                by[f"{tag}:{w}"][subject] += 1
        self.words = {w: max(sorted(c), key=c.__getitem__) for w, c in langs.items() if max(c.values()) >= 0.9 * sum(c.values())}
        self.subjects = sorted({s for s, _, _ in rows if s != rest})
        self.rest = {t for t, c in by.items() if c[rest]}
        self.trusted = {}
        for t, c in by.items():
            s, n = max(sorted(c.items()), key=lambda x: x[1])
            if s != rest and t not in self.rest and n >= least and n >= share * sum(c.values()):
                self.trusted[t] = s
        self.common = {t for t, c in by.items() if len(c) > 1 and max(c.values()) < share * sum(c.values())}
        self.passages: list[tuple[str, list[str]]] = []
        for subject, lang, text in rows:
            tag = (lang or "").strip().lower()[:2]
            for x in sentences(text or "") if subject != rest else []:
                known = [f"{tag}:{w}" for w in terms(x) if f"{tag}:{w}" not in self.rest]
                self.passages.append((subject, known))


def _ordered(words: list[str], common: Collection[str]) -> tuple[int, tuple[str, ...]]:
    """(number of common terms, the terms with those first)."""
    first = [w for w in words if w in common]
    return len(first), (*first, *(w for w in words if w not in common))


def _sentences(lang_of: dict[str, str], drop: frozenset[str], common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                every = [terms(s) for s in sentences(text or "")]
                votes = [Counter(lang_of[w] for w in ws if w in lang_of) for ws in every]
                main = sum(votes, Counter()).most_common(1)
                main_lang = main[0][0] if main else ""
                seen: Counter = Counter()
                for ws, v in zip(every, votes, strict=True):
                    top = v.most_common(2)
                    lang = top[0][0] if top and (len(top) < 2 or top[0][1] > top[1][1]) else main_lang
                    # Terms trusted to be of no subject tell nothing.
                    seen[_ordered([t for w in ws if (t := f"{lang}:{w}") not in drop], common)] += 1
                rows.append((doc_id, len(every), 0, 0, []))  # the total, once per text
                rows += [(doc_id, 0, n, c, list(ws)) for (c, ws), n in seen.items() if ws]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, SENTENCES_ARROW.types, strict=True)], schema=SENTENCES_ARROW)

    return run


def similar_passages(nodes: DataFrame, similarity: float, reach: int = REACH) -> DataFrame:
    """src, dst: a sparse part of the verified similarity graph of passages (sid, content: hashes of their terms in the order of the
    terms), each link in both directions. Of similar passages with a common hub many have no link of their own, and terms far
    apart make no pair; spread_similar holds all pairs.

    Two passages that share a term, or two (at most reach places apart in either), are candidates. Of those with one term, or
    pair of terms, the one of fewest terms is the hub, and the others are held against it: they are linked if the cosine of their terms is
    at least `similarity`, so that a long passage isn't linked to a short one that it happens to hold. So a term or pair in n passages gives n links at most, not n², and still joins
    all that are similar to its hub.
    """
    pairs = F.flatten(F.transform("content", lambda x, i: F.transform(F.slice("content", i + 2, F.lit(reach)), lambda y: F.xxhash64(F.least(x, y), F.greatest(x, y)))))
    keys = cut(nodes.select("sid", "content", F.explode(F.concat("content", pairs)).alias("key")))
    hubs = keys.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.size("content").alias("size"), "sid", "content")).alias("h")).filter("n > 1")
    hubs = cut(hubs.select("key", "n", F.col("h.sid").alias("hub"), F.col("h.content").alias("terms")))
    heavy = Heavy(hubs, "key", "n")
    both = salted_join(keys, hubs.drop("n"), "key", heavy, F.col("sid")).filter("sid <> hub")
    alike = F.size(F.array_intersect("content", "terms")) >= F.lit(similarity) * F.sqrt((F.size("content") * F.size("terms")).cast("double")) - 1e-9
    edges = cut(both.filter(alike).select("sid", "hub").distinct())
    release(keys)
    return edges.select(F.col("sid").alias("src"), F.col("hub").alias("dst")).unionByName(edges.select(F.col("hub").alias("src"), F.col("sid").alias("dst"))).distinct()


def spread_labels(links: DataFrame, seeds: DataFrame, purity: float) -> DataFrame:
    """sid, k: labels of seeds (sid, k; one row each, clamped) carried over links (src, dst) round by round.

    In a round the newly labelled passages tell their neighbours; one without a label takes the subject that at least
    `purity` of all it was told so far name, and keeps it. Ends when a round labels nothing, which is after as many rounds
    as the graph is wide; every round works on what is new alone.
    """
    links = cut(links)
    heavy = Heavy(links.groupBy("src").agg(F.count("*").alias("n")), "src", "n")
    front = cut(seeds.select("sid", "k"))
    labelled = cut(front)
    votes = cut(front.limit(0).select(F.col("sid").alias("dst"), "k", F.lit(0).cast("long").alias("c")))
    for turn in count(1):
        told = salted_join(links, front.withColumnRenamed("sid", "src"), "src", heavy, F.col("dst")).groupBy("dst", "k").agg(F.count("*").alias("c"))
        every = told.unionByName(votes).groupBy("dst", "k").agg(F.sum("c").alias("c"))
        now = cut(every.join(labelled.select(F.col("sid").alias("dst")), "dst", "left_anti"))
        top = F.max(F.shiftleft("c", BITS).bitwiseOR(F.col("k"))).alias("x")
        best = now.groupBy("dst").agg(F.sum("c").alias("all"), top).filter(F.shiftright("x", BITS) >= purity * F.col("all"))
        labelled, front = extend(labelled, best.select(F.col("dst").alias("sid"), F.col("x").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("k")))
        release(votes)
        votes = now
        if front.isEmpty():
            return labelled
        if turn & (turn - 1) == 0:  # links to labelled passages tell nothing any more
            links, before = cut(links.join(labelled.select(F.col("sid").alias("dst")), "dst", "left_anti").select("src", "dst")), links
            release(before)


def spread_similar(passages: DataFrame, seeds: DataFrame, similarity: float, purity: float) -> DataFrame:
    """sid, k: what spread_labels gives over the links of all pairs of passages (sid, content: hashes of their terms) whose
    cosine is at least `similarity`, from seeds (sid, k; one row each). No pair is left out, and no list of links is made.

    Passages without a label that have equal terms are told the same in each round: they are one shape. What newly labelled
    passages of up to SHORT terms tell a shape is counted by their subsets of terms: with S(i) the number of passages that
    hold a subset of i terms of the shape, over all such subsets, S(1) - S(2) + S(3) share at least one term with it,
    S(2) - 2 S(3) at least two, and S(3) three. Longer ones meet those they can be similar to by their first terms in the
    order of the hashes: with p of them left out a pair would share too few terms. The first that both have verifies the pair.
    """
    short = SHORT if SHORT <= MOST_SUBSETS_OF * similarity**2 else 0  # else longer shapes than that have to be cut into subsets
    need = lambda a, b: F.greatest(F.ceil(F.lit(similarity) * F.sqrt((a * b).cast("double")) - 1e-9).cast("int"), F.lit(1))

    def first(size: Column, least: int) -> Column:
        """How many first terms a passage needs beside others of at least `least` terms."""
        other = F.greatest(F.ceil(F.lit(similarity**2) * size - 1e-9).cast("int"), F.lit(least))
        return F.greatest(size - need(size, other) + 1, F.lit(0))

    every = cut(passages.select("sid", F.array_sort(F.array_distinct("content")).alias("content")).filter(F.size("content") > 0).withColumn("cid", F.xxhash64("content")))
    known = seeds.select("sid", "k")
    free = cut(every.join(known, "sid", "left_anti").select("sid", "cid"))
    shapes = cut(free.groupBy("cid").agg(F.count("*").alias("w")).join(every.groupBy("cid").agg(F.first("content").alias("content")), "cid"))
    size = F.size("content")
    rest = lambda i: F.slice("content", i + 2, size)
    ones = F.transform("content", lambda x: F.struct(F.lit(1).alias("i"), F.xxhash64(x).alias("key")))
    twos = F.flatten(F.transform("content", lambda x, i: F.transform(rest(i), lambda y: F.struct(F.lit(2).alias("i"), F.xxhash64(x, y).alias("key")))))
    threes = F.flatten(F.flatten(F.transform("content", lambda x, i: F.transform(rest(i), lambda y, j: F.transform(F.slice("content", i + j + 3, size), lambda z: F.struct(F.lit(3).alias("i"), F.xxhash64(x, y, z).alias("key")))))))
    subsets = F.explode(F.concat(ones, twos, threes)).alias("x")
    parts = cut(shapes.filter(F.lit(similarity**2) * size <= short + 1e-9).select("cid", size.alias("size"), subsets).select("cid", "size", "x.*"))
    heavy_parts = Heavy(parts.groupBy("key").agg(F.count("*").alias("n")), "key", "n")
    begin = lambda least: F.slice("content", 1, first(size, least))
    heads = cut(shapes.select("cid", "content", begin(short + 1).alias("head")).withColumn("key", F.explode("head")))
    heavy_heads = Heavy(heads.groupBy("key").agg(F.count("*").alias("n")), "key", "n")

    def told_by(front: DataFrame) -> DataFrame:
        """cid, k, c: addends of the numbers of passages of the front (content, k, w) with a label that are similar to a shape."""
        few = front.filter(size <= short).select("k", "w", size.alias("m"), subsets).groupBy(F.col("x.key").alias("key"), "m", "k").agg(F.sum("w").alias("w"))
        j, i = need(F.col("m"), F.col("size")), F.col("i")
        times = F.when(j == 1, F.when(i == 2, -1).otherwise(1)).when(j == 2, F.when(i == 2, 1).when(i == 3, -2).otherwise(0)).when((j == 3) & (i == 3), 1).otherwise(0)
        by_parts = salted_join(parts, few, "key", heavy_parts, F.col("cid")).withColumn("w", F.col("w") * times).filter("w <> 0").select("cid", "k", F.col("w").alias("c"))
        long = front.filter(size > short).select("k", "w", F.col("content").alias("terms"), begin(1).alias("start")).withColumn("key", F.explode("start"))
        both = salted_join(heads, long, "key", heavy_heads, F.col("cid")).filter(F.get(F.array_intersect("head", "start"), 0) == F.col("key"))
        alike = F.size(F.array_intersect("content", "terms")) >= need(size, F.size("terms"))
        return by_parts.unionByName(both.filter(alike).select("cid", "k", F.col("w").alias("c")))

    sown = every.join(known, "sid").groupBy("cid", "k").agg(F.first("content").alias("content"), F.count("*").alias("w"))
    front = cut(sown.select("content", "k", "w"))
    labelled = cut(shapes.limit(0).select("cid", F.lit(0).alias("k")))
    votes = cut(shapes.limit(0).select("cid", F.lit(0).alias("k"), F.lit(0).cast("long").alias("c")))
    while not front.isEmpty():
        every_vote = told_by(front).unionByName(votes).groupBy("cid", "k").agg(F.sum("c").alias("c")).filter("c > 0")
        now = cut(every_vote.join(labelled.select("cid"), "cid", "left_anti"))
        top = F.max(F.shiftleft("c", BITS).bitwiseOR(F.col("k"))).alias("x")
        best = now.groupBy("cid").agg(F.sum("c").alias("all"), top).filter(F.shiftright("x", BITS) >= purity * F.col("all"))
        labelled, fresh = extend(labelled, best.select("cid", F.col("x").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("k")))
        release(votes, front)
        votes, front = now, cut(shapes.join(fresh, "cid").select("content", "k", "w"))
    release(parts, heads)
    return cut(free.join(labelled, "cid").select("sid", "k").unionByName(known))


def document_subjects(
    documents: DataFrame, examples: DataFrame, rest: str = "tooling", share: float = 0.2, purity: float = 0.8, support: float = 0.2, least: int = 3, witnesses: int = 3, similarity: float = 0.5
) -> DataFrame:
    """doc_id, subject, share: each subject that at least `share` of a document's sentences deal with; `rest` for a document
    without any (its share is null), such as one with a null or empty text.

    The sentences of all documents are passages of a graph, those with equal terms being one. Passages are linked where they
    are verified to be similar, all that are (spread_similar), without terms that examples of `rest` use or that are common to the
    examples of several subjects. The passages of the labelled examples are part of it and the trusted seeds: they keep
    their subject, and labels spread from them over the links until nothing changes.

    A term then has the subject of the labelled passages that hold it beside a trusted term of that subject, if at least `least` of them and `support` of all, with at
    least `witnesses` different other terms, have one, and at least `purity` of those that have any; terms trusted from the
    examples keep theirs. A sentence deals with the subject that most of its labelled terms have; at equality with the one
    that more of the document's other sentences deal with, or else with each. A sentence with one labelled term alone counts
    if most (`purity`) sentences with that term have its subject, or if others of the document deal with it. A document may
    have several subjects. Terms are kept apart by language, told by the words of the examples.

    Rows with equal doc_id are one document. Nulls in other columns and extra columns have no effect.
    """
    rows = [(r["subject"], r["lang"], r["text"]) for r in examples.select("subject", "lang", "text").filter("subject is not null").limit(MOST_EXAMPLES + 1).collect()]
    if len(rows) > MOST_EXAMPLES:
        raise ValueError(f"more than {MOST_EXAMPLES} labelled examples: fit on a sample of them")
    seeds = Seeds(rows, rest)
    if len(seeds.subjects) >= 1 << BITS:
        raise ValueError(f"{1 << BITS} subjects or more")
    spark = documents.sparkSession
    src = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spoken = cut(src.mapInArrow(_sentences(seeds.words, frozenset(seeds.rest), frozenset(seeds.common)), SENTENCES).withColumn("sid", F.xxhash64("terms")))
    nodes = cut(spoken.filter(F.size("terms") > 0).groupBy("sid").agg(F.first("terms").alias("terms"), F.first("common").alias("common")))
    links = cut(nodes.select("sid", F.explode(F.transform("terms", lambda t: F.xxhash64(t))).alias("term")))
    ids = {s: i for i, s in enumerate(seeds.subjects)}
    word = pa.table({"word": pa.array(list(seeds.trusted), pa.string()), "k": pa.array([ids[s] for s in seeds.trusted.values()], pa.int32())})
    clamped = spark.createDataFrame(word).select(F.xxhash64("word").alias("term"), "k")
    uses = cut(links.groupBy("term").agg(F.count("*").alias("uses")).filter(F.col("uses") >= least))
    heavy = Heavy(uses, "term", "uses")
    cs = [f"c{i}" for i in range(max(len(ids), 1))]

    def by_sentence(labels: DataFrame, n: int) -> DataFrame:
        """Per sentence: c0, c1, ..., the numbers of its labelled terms per subject, and the surest."""
        hit = links.join(F.broadcast(labels), "term") if n <= MOST_BROADCAST else salted_join(links, labels, "term", heavy, F.col("sid"))
        return hit.groupBy("sid").agg(*[F.count_if(F.col("k") == i).alias(c) for i, c in enumerate(cs)], F.max("sure").alias("sure"))

    # Terms common to subjects, which come first, tell passages apart no more than those of the rest.
    content = F.transform(F.slice("terms", F.col("common") + 1, F.greatest(F.size("terms"), F.lit(1))), lambda t: F.xxhash64(t)).alias("content")
    told = [(ids[s], *_ordered(ws, seeds.common)) for s, ws in seeds.passages]
    said = pa.table({"k": pa.array([x[0] for x in told], pa.int32()), "common": pa.array([x[1] for x in told], pa.int32()), "terms": pa.array([list(x[2]) for x in told], pa.list_(pa.string()))})
    trusted = spark.createDataFrame(said).select("k", F.xxhash64("terms").alias("sid"), content).filter(F.size("content") > 1)
    # A passage that examples of several subjects have is no seed.
    sown = trusted.groupBy("sid").agg(F.first("content").alias("content"), F.min("k").alias("k"), F.max("k").alias("k2")).filter("k = k2").select("sid", "content", "k")
    passages = nodes.select("sid", content).join(F.broadcast(sown.select("sid")), "sid", "left_anti").unionByName(sown.select("sid", "content"))  # examples: bounded
    labelled = spread_similar(passages, sown, similarity, purity)
    # What the labelled passages say of their terms, each beside another term of the passage.
    # Those of one term alone, which may be a passing mention, and those without a trusted term of their subject say nothing: a
    # label that strayed into another part of the graph ends there.
    proven = links.join(F.broadcast(clamped), "term").select("sid", "k").distinct()
    held = nodes.filter(F.size("terms") - F.col("common") > 1).join(labelled.join(proven, ["sid", "k"], "left_semi"), "sid").select("k", "terms", "common", F.explode("terms").alias("word"))
    lead = F.try_element_at("terms", F.col("common") + 1)
    other = F.when(lead == F.col("word"), F.try_element_at("terms", F.col("common") + 2)).otherwise(lead)
    per = cut(held.select("k", F.xxhash64("word").alias("term"), other.alias("witness")).groupBy("term", "k", "witness").agg(F.count("*").alias("c")).groupBy("term", "k").agg(F.sum("c").alias("c"), F.count("witness").alias("d")))
    best = per.groupBy("term").agg(F.sum("c").alias("all"), F.max(F.struct("c", "d", "k")).alias("x")).select("term", "all", "x.*").join(uses, "term")
    good = (F.col("c") >= least) & (F.col("d") >= witnesses) & (F.col("c") >= purity * F.col("all")) & (F.col("c") >= support * F.col("uses"))
    learnt = best.filter(good).join(F.broadcast(clamped.select("term")), "term", "left_anti").select("term", "k", (F.col("c") / F.col("uses")).alias("sure"))
    seeded = clamped.join(per, ["term", "k"], "left").join(uses, "term", "left").select("term", "k", F.when(F.col("uses").isNull(), 1.0).otherwise(F.coalesce("c", F.lit(0)) / F.col("uses")).alias("sure"))
    labels = cut(seeded.unionByName(learnt))
    n = labels.count()
    most = F.greatest(*cs) if len(cs) > 1 else F.col(cs[0])
    ties = F.array_compact(F.array(*[F.when(F.col(c) == F.col("most"), i) for i, c in enumerate(cs)]))
    told = by_sentence(labels, n).withColumn("most", most).select("sid", ties.alias("ks"), ((F.col("most") > 1) | (F.col("sure") >= purity)).alias("firm"))
    often = Heavy(spoken.groupBy("sid").agg(F.count("*").alias("docs")), "sid", "docs")
    hits = salted_join(spoken.select("doc_id", "sid", "n"), told, "sid", often, F.col("doc_id"))
    # At most two rows per set of subjects and document.
    sets = hits.groupBy("doc_id", "ks", "firm").agg(F.sum("n").alias("n")).groupBy("doc_id").agg(F.collect_list(F.struct("ks", "firm", "n")).alias("l"))
    zero = F.lit(0).cast("long")

    def tally(which) -> Column:
        """Per subject, the sentences of the document for which which(entry, subject) holds."""
        return F.transform(F.sequence(F.lit(0), F.lit(len(cs) - 1)), lambda i: F.aggregate("l", zero, lambda a, x: a + F.when(F.array_contains(x["ks"], i) & which(x, i), x["n"]).otherwise(zero)))

    alone = lambda x, _: (F.size(x["ks"]) == 1) & x["firm"]
    sets = sets.withColumn("u", tally(alone))
    lead = lambda x: F.array_max(F.transform(x["ks"], lambda k: F.get("u", k)))
    rest_of = lambda x, i: ~((F.size(x["ks"]) == 1) & x["firm"]) & (F.get("u", i) == lead(x)) & (x["firm"] | (F.get("u", i) > 0))
    counted = sets.select("doc_id", F.posexplode(F.zip_with("u", tally(rest_of), lambda a, b: a + b)).alias("k", "n")).filter("n > 0")
    totals = spoken.groupBy("doc_id").agg(F.sum("total").alias("n")).select("doc_id", F.lit(-1).alias("k"), "n")
    per_doc = counted.unionByName(totals)
    w = Window.partitionBy("doc_id")
    per_doc = per_doc.withColumn("total", F.max(F.when(F.col("k") < 0, F.col("n"))).over(w))
    kept = per_doc.withColumn("share", F.when(F.col("k") >= 0, F.col("n") / F.greatest("total", F.lit(1))))
    kept = kept.withColumn("several", F.max(F.when(F.col("share") >= share, 1).otherwise(0)).over(w)).filter(((F.col("k") >= 0) & (F.col("share") >= share)) | ((F.col("k") < 0) & (F.col("several") == 0)))
    names = F.array(*[F.lit(s) for s in seeds.subjects]) if seeds.subjects else F.array(F.lit(rest))
    return kept.select("doc_id", F.when(F.col("k") < 0, F.lit(rest)).otherwise(F.element_at(names, F.greatest(F.col("k"), F.lit(0)) + 1)).alias("subject"), "share")
