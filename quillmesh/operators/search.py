"""Keyword and vector search over the index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh
from .inventory import scope_is

_TOKENS = r"[^\p{L}\p{N}]+"


def _like(token: str) -> Column:
    """A token anywhere in either text, without regard to case; `%` and `_` in it act as wild cards."""
    return F.coalesce(F.col("level_1").ilike(f"%{token}%"), F.lit(False)) | F.coalesce(F.col("level_2").ilike(f"%{token}%"), F.lit(False))


_QUERY = re.compile(r"""(?:(?P<col>id|level_1|level_2)\s*:\s*)?(?:"(?P<phrase>[^"]*)"(?P<p>\*)?|(?P<bare>[^\s"()]+))""")


def text_predicate(query: str, columns: Sequence[str] = ("id", "level_1", "level_2")) -> Column | None:
    """The predicate of a full-text query over whole words, without regard to case; None for a query without words.

    Words stand for themselves, all of them are needed; `"a b"` is a phrase within one column, `wor*` a beginning of a word,
    `level_1: x` (or id, level_2) a word of that column, `a OR b` either, `NOT a` none of it (also `a NOT b`). OR binds less
    than the rest. Marks within a word part it into a phrase.
    """
    spaced = {c: F.concat(F.lit(" "), F.array_join(F.split(F.lower(F.coalesce(c, F.lit(""))), _TOKENS), " "), F.lit(" ")) for c in columns}

    def one(words: list[str], prefix: bool, col: str | None) -> Column:
        needle = " " + " ".join(words) + ("" if prefix else " ")
        hits = [spaced[c].contains(needle) for c in ([col] if col else columns) if c in spaced]
        out = F.lit(False)
        for h in hits:
            out = out | h
        return out

    either: list[Column | None] = [None]
    negate = False
    for m in _QUERY.finditer(query):
        bare = m["bare"]
        if bare == "OR":
            either.append(None)
            continue
        if bare in ("AND", "NOT"):
            negate = bare == "NOT"
            continue
        text, prefix = (m["phrase"], bool(m["p"])) if bare is None else (bare.rstrip("*"), bare.endswith("*"))
        words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
        if not words:
            continue
        part = one(words, prefix, m["col"])
        part = ~part if negate else part
        negate = False
        either[-1] = part if either[-1] is None else either[-1] & part
    given = [x for x in either if x is not None]
    if not given:
        return None
    out = given[0]
    for x in given[1:]:
        out = out | x
    return out


def keyword_search(m: Mesh, query: str, level: int | None = None, most: int = 20, node_type: str | None = None, scope: str = "all", tag: str | None = None, offset: int = 0) -> DataFrame:
    """id, mode, total: nodes that match the query as text_predicate reads it (`fts`); if there are none, those that hold all
    tokens within words (`like_and`), then any of them (`like_or`, at most 10, not with a tag). By id, from offset on; total is
    the number before the limit, after the filters of type, scope and tag.

    The first stage decides by the words alone: if any node has them, the filters may leave nothing. One predicate per
    stage, evaluated in the scan; no index is needed and nothing is shuffled before the limit.
    """
    texts = {1: ["level_1"], 2: ["level_2"]}.get(level, ["id", "level_1", "level_2"])

    def finish(rows: DataFrame, mode: str, cap: int) -> DataFrame:
        if tag is not None:
            rows = rows.join(m.tags.filter(F.col("tag") == tag).select(F.col("node_id").alias("id")), "id", "left_semi")
        total = rows.agg(F.count("*").alias("total"))
        page = rows.select("id").orderBy("id").offset(offset).limit(cap) if offset else rows.select("id").orderBy("id").limit(cap)
        return page.withColumn("mode", F.lit(mode)).crossJoin(F.broadcast(total))  # one row

    def narrowed(cond: Column) -> DataFrame:
        rows = m.nodes.filter(cond & scope_is(scope))
        return rows.filter(F.col("node_type") == node_type) if node_type else rows

    cond = text_predicate(query, texts)
    if cond is not None and not m.nodes.filter(cond).isEmpty():
        return finish(narrowed(cond), "fts", most)
    tokens = query.split()
    if not tokens:
        return finish(m.nodes.filter(F.lit(False)), "fts", most)
    both = F.lit(True)
    for t in tokens:
        both = both & _like(t)
    rows = narrowed(both)
    if not rows.isEmpty():
        return finish(rows, "like_and", most)
    if tag is not None:
        return finish(m.nodes.filter(F.lit(False)), "fts", most)
    any_ = F.lit(False)
    for t in tokens:
        any_ = any_ | _like(t)
    return finish(narrowed(any_), "like_or", min(most, 10))


def token_index(m: Mesh) -> DataFrame:
    """token, id, field, tf: the inverted index of ids and texts."""
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit("")).alias("text")) for f in ("id", "level_1", "level_2")])
    ex = m.nodes.select("id", F.explode(fields).alias("x")).select("id", "x.field", F.explode(F.split(F.lower("x.text"), _TOKENS)).alias("token"))
    return ex.filter("token <> ''").groupBy("token", "id", "field").agg(F.count("*").alias("tf"))


def distance(vec: Column, query: Sequence[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.round(F.sqrt(F.aggregate(F.zip_with(vec, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)), 6)


def vector_search(m: Mesh, vectors: DataFrame, query: Sequence[float], most: int = 20, node_type: str | None = None, scope: str = "all") -> DataFrame:
    """id, distance: of the 3 * most nearest vectors (by Euclid, at equal distance the smaller id) those whose node exists
    and passes the filters, at most `most`. vectors: node_id, vec of the width of the query."""
    near = vectors.select(F.col("node_id").alias("id"), distance(F.col("vec"), query).alias("distance")).orderBy("distance", "id").limit(3 * most)
    rows = m.nodes.filter(scope_is(scope)).join(F.broadcast(near), "id")  # at most 3 * most rows
    rows = rows.filter(F.col("node_type") == node_type) if node_type else rows
    return rows.select("id", "distance").orderBy("distance", "id").limit(most)


def to_embed(m: Mesh, hashes: DataFrame) -> DataFrame:
    """id, content_hash of nodes whose text has no vector yet or has changed since."""
    now = m.nodes.select("id", fn.embedding_hash("level_1", "level_2").alias("content_hash"))
    return now.join(hashes.select(F.col("node_id").alias("id"), "content_hash"), ["id", "content_hash"], "left_anti")


EMBEDDED = "id string, content_hash string, vec array<float>"
EMBED_BATCH = 64


def stand_in(texts: list[str], width: int = 384) -> list[list[float]]:
    """Deterministic vectors of texts, the same as scalars.test_vector gives: for tests, and where no model is installed."""
    out = []
    for t in texts:
        digest = hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()
        out.append([(digest[i % 32] ^ (i & 0xFF)) / 128 - 1 for i in range(width)])
    return out


def embed(wanted: DataFrame, embedder: Callable[[list[str]], list[list[float]]] = stand_in, batch: int = EMBED_BATCH) -> DataFrame:
    """id, content_hash, vec of wanted (id, content_hash, text): batches of texts at a time go through the embedder, which is
    sent to the tasks and should load its model when first called."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            vecs = [v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("content_hash"), pa.array(vecs, pa.list_(pa.float32()))], names=["id", "content_hash", "vec"])

    return wanted.select("id", "content_hash", "text").mapInArrow(run, EMBEDDED)


def upsert_vectors(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored (node_id, content_hash, vec) with those of fresh (id, content_hash, vec) in place; one of equal hash stays as it
    is, of several new ones for an id the one with the greatest hash counts."""
    new = fresh.select(F.col("id").alias("node_id"), "content_hash", "vec").join(stored.select("node_id", "content_hash"), ["node_id", "content_hash"], "left_anti")
    one = new.groupBy("node_id").agg(F.max_by(F.struct("content_hash", "vec"), "content_hash").alias("x")).select("node_id", "x.content_hash", "x.vec")
    return stored.select("node_id", "content_hash", "vec").join(one.select("node_id"), "node_id", "left_anti").unionByName(one)


def refresh_vectors(m: Mesh, stored: DataFrame, embedder: Callable[[list[str]], list[list[float]]] = stand_in) -> DataFrame:
    """stored after all nodes whose text is new or changed were embedded."""
    text = F.concat(F.coalesce("level_1", F.lit("")), F.lit("\n"), F.coalesce("level_2", F.lit("")))
    wanted = to_embed(m, stored).join(m.nodes.select("id", text.alias("text")), "id")
    return upsert_vectors(stored, embed(wanted, embedder))


def semantic_search(m: Mesh, vectors: DataFrame, query: str, embedder: Callable[[list[str]], list[list[float]]] = stand_in, most: int = 20, node_type: str | None = None, scope: str = "all") -> DataFrame:
    """id, mode, total: the nearest nodes to the query's vector (`semantic`, in the order of their distance), or those of
    keyword_search where there is none or the embedder fails."""
    try:
        vec = embedder([query])[0]
    except Exception:  # noqa: BLE001 - whatever a model raises, words still work
        return keyword_search(m, query, None, most, node_type, scope)
    near = vector_search(m, vectors.filter(F.size("vec") == len(vec)), vec, most, node_type, scope)
    if near.isEmpty():
        return keyword_search(m, query, None, most, node_type, scope)
    total = near.agg(F.count("*").alias("total"))
    return near.select("id", F.lit("semantic").alias("mode")).crossJoin(F.broadcast(total))  # one row
