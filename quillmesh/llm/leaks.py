"""Evaluation texts leaking into training text: pigeonhole pieces, exact hits, verification by bit-parallel edit distance."""

from __future__ import annotations

import bisect
import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .text import words

#: Distinct test texts searched for in one pass over the corpus; more texts take more passes.
TEXT_BLOCK = 20_000
WINDOW = 12
#: Characters that patterns are looked up by where no automaton is installed.
HEAD = 8
HITS = "doc_id long, text_id long, distance int, exact_run int"
HITS_ARROW = pa.schema([("doc_id", pa.int64()), ("text_id", pa.int64()), ("distance", pa.int32()), ("exact_run", pa.int32())])


def edit_distance_within(pattern: str, text: str) -> int:
    """The least edit distance between pattern and any substring of text (Myers' bit-parallel algorithm)."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # free start in the text: no carry into the first row
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best


def one_edit(pattern: str, text: str) -> bool:
    """Whether pattern is within one edit of some beginning of text."""
    if text.startswith(pattern):
        return True
    c = len(commonprefix((pattern, text)))
    return text.startswith(pattern[c + 1 :], c + 1) or text.startswith(pattern[c + 1 :], c) or text.startswith(pattern[c:], c + 1)


class Automaton:
    """All places of a set of patterns in a text, by the Aho-Corasick automaton of pyahocorasick; where that is not installed,
    by one hash look-up per word and length of pattern."""

    def __init__(self, patterns: Iterable[str]):
        self.patterns = frozenset(patterns)
        self.heads: dict[str, list[str]] = {}
        try:
            from ahocorasick import Automaton as Native
        except ImportError:
            for p in self.patterns:
                self.heads.setdefault(p[:HEAD], []).append(p)
            return
        self.native = Native()
        for p in self.patterns:
            self.native.add_word(p, p)
        self.native.make_automaton()

    def hits(self, text: str) -> list[tuple[int, str]]:
        """(start, pattern), by end."""
        if not self.patterns:
            return []
        if not self.heads:
            return [(end - len(p) + 1, p) for end, p in self.native.iter(text)]
        found = [(i, p) for i in range(len(text)) for p in self.heads.get(text[i : i + HEAD], ()) if text.startswith(p, i)]
        found += [(i, p) for p in self.patterns if len(p) < HEAD for i in range(len(text)) if text.startswith(p, i) and p not in self.heads.get(text[i : i + HEAD], ())]
        return sorted(found, key=lambda x: (x[0] + len(x[1]), x[0]))


def piece_words(window: int, errors: int) -> int:
    """The most words a piece may have so that every window of words holds errors + 1 disjoint aligned pieces."""
    p = window // (errors + 1)
    while p > 1 and (window - (p - 1)) // p < errors + 1:
        p -= 1
    return p


class _Index:
    """The pieces of the test texts of one pass, and the search of a document for them."""

    def __init__(self, texts: list[tuple[int, str]], window: int, errors: int):
        self.window, self.errors, self.size = window, errors, piece_words(window, errors)
        self.items = [(i, w) for i, t in texts if len(w := words(t)) >= window]
        self.pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, w) in enumerate(self.items):
            for j in range(0, len(w) - self.size + 1, self.size):
                # Without the blanks around it: an edit of such a blank leaves both pieces beside it whole.
                self.pieces.setdefault(" ".join(w[j : j + self.size]), []).append((k, j))
        self.automaton = Automaton(self.pieces)

    def search(self, doc: list[str]) -> list[tuple[int, int, int]]:
        """(text_id, distance, exact_run) of the texts that doc holds within the budget."""
        hay = " ".join(doc)
        hits = self.automaton.hits(hay)
        if not hits:
            return []
        starts = list(itertools.accumulate((len(w) + 1 for w in doc), initial=0))
        size, window = self.size, self.window
        runs: dict[int, int] = {}
        spans: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}  # text -> (diagonal, first window) -> run of equal words
        for at, piece in hits:
            i = bisect.bisect_right(starts, at) - 1
            for k, j in self.pieces[piece]:
                w, own = self.items[k][1], spans.setdefault(k, {})
                d = i - j
                s = max(0, j + size - window)
                last = min(j, len(w) - window)
                if (d, last) in own and (d, s) in own:
                    continue
                # Words equal along the diagonal, to either side of the piece; its outer words may be parts of longer ones.
                a = b = j + (size > 2)
                while a > 0 and a + d > 0 and w[a - 1] == doc[a - 1 + d]:
                    a -= 1
                while b < len(w) and b + d < len(doc) and w[b] == doc[b + d]:
                    b += 1
                runs[k] = max(runs.get(k, 0), b - a)
                for x in range(s, last + 1):
                    own[d, x] = (a, b)
        out = []
        for k, own in spans.items():
            d = self.verified(self.items[k][1], doc, own)
            if d <= self.errors:
                out.append((self.items[k][0], d, runs[k]))
        return out

    def verified(self, w: list[str], doc: list[str], own: dict[tuple[int, int], tuple[int, int]]) -> int:
        """The least edit distance of a window of w that holds a hit to the text around it, by Myers' algorithm; errors + 1
        if none is within the budget. Windows covered by a run of equal words come first."""
        window, errors = self.window, self.errors
        best = errors + 1
        for (d, s), (a, b) in sorted(own.items(), key=lambda x: not (x[1][0] <= x[0][1] and x[0][1] + window <= x[1][1])):
            if not (a <= s and s + window <= b) and not (errors and self.possible(w, doc, d, s, a, b)):
                continue
            region = doc[max(0, s + d - errors) : s + d + window + errors]
            best = min(best, edit_distance_within(" ".join(w[s : s + window]), " ".join(region)))
            if not best:
                break
        return best

    def possible(self, w: list[str], doc: list[str], d: int, s: int, a: int, b: int) -> bool:
        """Whether the words allow the window to be within the budget. An edit changes two adjacent words at most and moves
        what follows by one word at most."""
        window, errors = self.window, self.errors
        end = s + window
        if errors > 1:
            pattern, region = Counter(w[s:end]), Counter(doc[max(0, s + d - errors) : end + d + errors])
            return (pattern & region).total() >= window - 2 * errors
        if a <= s < b:  # equal from the left
            return one_edit(" ".join(w[s:end]), " ".join(doc[s + d : end + d + 2]))
        if a < end <= b:
            return one_edit(" ".join(w[s:end])[::-1], " ".join(doc[max(0, s + d - 2) : end + d])[::-1])
        # Changed words on either side of a run of two or more are two edits.
        return b - a < 2


def _searcher(texts: list[tuple[int, str]], window: int, errors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(texts, window, errors)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if index.pieces and text:
                    rows += ((doc_id, *r) for r in index.search(words(text)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, HITS_ARROW.types, strict=True)], schema=HITS_ARROW)

    return run


def leaks(documents: DataFrame, items: DataFrame, fields: tuple[str, ...] = ("question", "passage"), window: int = WINDOW, errors: int = 1, block: int = TEXT_BLOCK) -> DataFrame:
    """doc_id, item_id, field, distance, exact_run: documents that hold, within `errors` edits of characters, some window
    of `window` consecutive words of a test text. exact_run is the longest run of equal words around a hit.

    Test texts are cut into aligned pieces of words, so that each window holds errors + 1 whole pieces: one of them must
    stand unchanged in any text within the budget. All pieces are looked up in one pass over each document; the windows
    that hold a hit are verified by their edit distance to the text around it, those whose words rule it out beforehand
    excepted. Texts shared by items are searched once. Null and empty texts, and test texts of
    fewer words than the window, leak nowhere. Rows of documents with equal doc_id each count; extra columns are ignored.

    Each pass holds up to `block` distinct test texts in the memory of a task.
    """
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    flat = items.select("item_id", F.explode(kinds).alias("x")).select("item_id", "x.field", "x.text").filter("text is not null")
    distinct = flat.groupBy("text").agg(F.min(F.struct("item_id", "field")).alias("m"))
    ids = distinct.select(F.xxhash64("text").alias("text_id"), "text").orderBy("text_id", "text")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    docs = spread(docs)
    found = None
    n = ids.count()
    for start in range(0, max(n, 1), block):
        texts = [(r["text_id"], r["text"]) for r in ids.offset(start).limit(block).collect()]
        part = docs.mapInArrow(_searcher(texts, window, errors), HITS)
        found = part if found is None else found.unionByName(part)
    who = flat.select(F.xxhash64("text").alias("text_id"), "item_id", "field").distinct()
    return found.join(F.broadcast(who) if n <= block else who, "text_id").groupBy("doc_id", "item_id", "field").agg(F.min("distance").alias("distance"), F.max("exact_run").alias("exact_run"))
