"""Writes as pure functions: an index and a command give a new index. Nothing is updated in place.

Times are passed in, so that a retry of a lost task writes the same rows.
"""

from __future__ import annotations

from collections.abc import Collection
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import runtime
from ..functions import scalars as fn
from ..mesh import Mesh
from ..schema import KEPT_HISTORY
from .history import retained
from .staleness import change_type

_STRUCTURE = ("node_type", "subtype", "title", "location", "source", "level_0", "level_1", "level_2", "level_3_location", "level_steps", "dflow_meta")


def _at(t: datetime) -> Column:
    return F.lit(t).cast("timestamp")


def events(rows: DataFrame, like: DataFrame, base: Column | None = None) -> DataFrame:
    """Rows (node_id, scanned_at, change_type and any of git_sha, meta, preserved) in the shape of the history. Their ids lie
    above those of deliveries, in the order of their times (to the millisecond) and within one by a hash of what they say, so
    that a repeated write gives the same ids."""
    defaults = {"git_sha": F.lit(None).cast("string"), "meta": F.lit(None).cast("string"), "preserved": F.lit(False)}
    rows = rows.withColumns({c: v for c, v in defaults.items() if c not in rows.columns})
    code = F.xxhash64("node_id", "change_type", "meta").bitwiseAND(F.lit((1 << 20) - 1))
    when = F.greatest(F.unix_millis("scanned_at"), F.lit(0)).bitwiseAND(F.lit((1 << 42) - 1))
    return rows.withColumn("id", F.shiftleft(when, 20).bitwiseOR(code).bitwiseOR(F.lit(1 << 62)) if base is None else base).select(*like.columns)


def keep_latest(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new replace those of old with equal key; of several new ones the greatest counts.

    The new rows are written once. Sides of a union that are both partitioned by the key would pass for a whole that is, and a
    later join by the key would fail where adaptive execution then reads them apart."""
    last = runtime.cut(new.groupBy(key).agg(F.max(F.struct(*[c for c in new.columns if c != key])).alias("x")).select(key, "x.*").select(*new.columns))
    return old.join(last.select(key), key, "left_anti").select(*new.columns).unionByName(last)


def upsert_nodes(m: Mesh, incoming: DataFrame, at: datetime, discovery_only: bool = True, git_sha: str | None = None) -> Mesh:
    """Write nodes (columns of m.nodes; unique ids).

    A node not yet known is added (INITIAL). A known one, with discovery_only, has its structure refreshed while hashes,
    statuses and time stay; else it is replaced if a hash differs: its statuses fall back to VERIFIED, its verification
    goes, and the change becomes history, pruned to the newest rows of a node.
    """
    old = m.nodes.select("id", F.lit(True).alias("known"), *[F.col(c).alias(f"old_{c}") for c in m.nodes.columns if c != "id"])
    j = incoming.join(old, "id", "left")
    change = change_type(F.col("old_code_hash"), F.col("old_desc_hash"), F.col("code_hash"), F.col("desc_hash"))
    j = j.withColumn("change", F.when(F.col("known") & F.col("old_code_hash").isNotNull() & F.lit(discovery_only), None).otherwise(change))
    written = F.col("change").isNotNull()
    refreshed = F.col("known") & ~written & F.lit(discovery_only)
    cols = []
    for c in m.nodes.columns:
        if c == "id":
            cols.append(F.col("id"))
        elif c in ("own_status", "link_status"):
            cols.append(F.when(written, F.lit("VERIFIED")).otherwise(F.col(f"old_{c}")).alias(c))
        elif c == "updated_at":
            cols.append(F.when(written, _at(at)).otherwise(F.col(f"old_{c}")).alias(c))
        elif c in _STRUCTURE:
            cols.append(F.when(written | refreshed, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c))
        else:
            cols.append(F.when(written, F.col(c)).otherwise(F.col(f"old_{c}")).alias(c))
    fresh = j.select(*cols)
    nodes = m.nodes.join(incoming.select("id"), "id", "left_anti").unionByName(fresh)
    changed = j.filter(written).select(F.col("id").alias("node_id"), _at(at).alias("scanned_at"), F.col("change").alias("change_type"), F.lit(git_sha).cast("string").alias("git_sha"))
    history = retained(m.history.unionByName(events(changed, m.history)), KEPT_HISTORY)
    replaced = j.filter(written & F.col("known")).select(F.col("id").alias("node_id"))
    return m.but(nodes=nodes, history=history, verification=m.verification.join(replaced, "node_id", "left_anti"))


def upsert_edges(m: Mesh, incoming: DataFrame) -> Mesh:
    return m.but(edges=keep_latest(m.edges, incoming.select(*m.edges.columns), "id"))


def set_statuses(m: Mesh, statuses: DataFrame) -> Mesh:
    """Put own_status and link_status (null: as it was) of the given ids on the nodes."""
    s = statuses.select("id", F.col("own_status").alias("o"), F.col("link_status").alias("l"))
    nodes = m.nodes.join(s, "id", "left").withColumn("own_status", F.coalesce("o", "own_status")).withColumn("link_status", F.coalesce("l", "link_status")).drop("o", "l")
    return m.but(nodes=nodes)


def set_baseline(m: Mesh, hashes: DataFrame) -> Mesh:
    """Take code_hash and desc_hash of the given ids as their new baseline, with a verified own status."""
    s = hashes.select("id", F.col("code_hash").alias("c"), F.col("desc_hash").alias("d"), F.lit(True).alias("_set"))
    j = m.nodes.join(s, "id", "left")
    for c, v in (("code_hash", F.col("c")), ("desc_hash", F.col("d")), ("own_status", F.lit("VERIFIED"))):
        j = j.withColumn(c, F.when(F.col("_set"), v).otherwise(F.col(c)))
    return m.but(nodes=j.drop("c", "d", "_set").select(*m.nodes.columns))


def delete_nodes(m: Mesh, ids: DataFrame, at: datetime, git_sha: str | None = None) -> Mesh:
    """Take nodes out with their tags, verification, own history and edges.

    A preserved DELETED row tells what each was. Edges go with a preserved LINK_REMOVED row at the end that stays (at
    from_id if neither does), but documents edges from nodes that stay into deleted ones are kept: they show as broken.
    """
    gone = m.nodes.join(ids.select("id").distinct(), "id", "left_semi")
    key = gone.select("id")
    tags = m.tags.groupBy("node_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    what = gone.join(tags, gone.id == tags.node_id, "left").select(
        F.col("id").alias("node_id"), _at(at).alias("scanned_at"), F.lit("DELETED").alias("change_type"), F.lit(git_sha).cast("string").alias("git_sha"),
        F.to_json(F.struct("title", "node_type", "subtype", "location", "level_3_location", F.lit(git_sha).cast("string").alias("git_sha"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.lit("system").alias("actor"))).alias("meta"), F.lit(True).alias("preserved"),
    )
    f, t = key.select(F.col("id").alias("from_id"), F.lit(True).alias("f_gone")), key.select(F.col("id").alias("to_id"), F.lit(True).alias("t_gone"))
    e = m.edges.join(f, "from_id", "left").join(t, "to_id", "left").fillna(False, ["f_gone", "t_gone"])
    cut = (F.col("f_gone") | F.col("t_gone")) & ~((F.col("edge_type") == "documents") & F.col("t_gone") & ~F.col("f_gone"))
    stays = F.when(F.col("f_gone"), F.col("to_id")).otherwise(F.col("from_id"))
    links = e.filter(cut).select(stays.alias("node_id"), _at(at).alias("scanned_at"), F.lit("LINK_REMOVED").alias("change_type"), F.to_json(F.struct("edge_type", F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.lit("system").alias("actor"))).alias("meta"), F.lit(True).alias("preserved"))
    node_key = key.select(F.col("id").alias("node_id"))
    old = m.history.filter(~F.coalesce("preserved", F.lit(False))).join(node_key, "node_id", "left_anti").select(*m.history.columns).unionByName(m.history.filter("preserved"))
    return m.but(
        nodes=m.nodes.join(key, "id", "left_anti"),
        edges=e.filter(~cut).select(*m.edges.columns),
        tags=m.tags.join(node_key, "node_id", "left_anti").select(*m.tags.columns),
        verification=m.verification.join(node_key, "node_id", "left_anti").select(*m.verification.columns),
        history=old.unionByName(events(what, m.history)).unionByName(events(links, m.history)),
        docs=m.docs.join(key, "id", "left_anti"),
        sections=m.sections.join(key, "id", "left_anti"),
    )


def delete_location(m: Mesh, location: str, at: datetime, git_sha: str | None = None) -> Mesh:
    return delete_nodes(m, m.nodes.filter(F.col("location") == location).select("id"), at, git_sha)


def delete_doc(m: Mesh, doc_id: str, at: datetime) -> Mesh:
    """A document and its sections."""
    return delete_nodes(m, m.nodes.filter((F.col("id") == doc_id) | F.col("id").startswith(f"{doc_id}::")).select("id"), at)


def remove_link(m: Mesh, from_id: str, to_id: str, at: datetime, actor: str = "build:reconcile") -> Mesh:
    """Take out a documents edge, with a LINK_REMOVED row at its source."""
    hit = (F.col("edge_type") == "documents") & (F.col("from_id") == from_id) & (F.col("to_id") == to_id)
    rows = m.edges.filter(hit).select(F.col("from_id").alias("node_id"), _at(at).alias("scanned_at"), F.lit("LINK_REMOVED").alias("change_type"), F.to_json(F.struct(F.col("to_id").alias("target"), F.lit(actor).alias("actor"))).alias("meta"))
    return m.but(edges=m.edges.filter(~hit), history=m.history.unionByName(events(rows, m.history)))


def rename(m: Mesh, pairs: DataFrame, prefixes: Collection[str] = ("@workflow", "::step-")) -> Mesh:
    """Move what is known of old_id to new_id, and of what belongs to it: ids of nodes that go on with one of the prefixes.

    History and verification move (an existing verification of the new id stays), edges get new ends and ids, and of edges
    that become equal one is kept. The old node itself is left to be purged; the nodes that belong to it move.
    """
    known = m.nodes.select("id")
    owned = None
    for p in prefixes:
        stem = F.when(F.col("id").contains(p), F.substring_index("id", p, 1))
        part = known.withColumn("old_id", stem).filter("old_id is not null").join(pairs, "old_id").select(F.col("id").alias("old"), F.concat("new_id", F.expr("substr(id, length(old_id) + 1)")).alias("new"))
        owned = part if owned is None else owned.unionByName(part)
    every = pairs.select(F.col("old_id").alias("old"), F.col("new_id").alias("new"))
    every = (every.unionByName(owned) if owned is not None else every).distinct()

    def moved(df: DataFrame, c: str) -> DataFrame:
        return df.join(every.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new").select(*df.columns)

    edges = moved(moved(m.edges, "from_id"), "to_id").withColumn("id", fn.edge_id("from_id", "edge_type", "to_id"))
    edges = edges.groupBy("id").agg(F.max(F.struct(*[c for c in m.edges.columns if c != "id"])).alias("x")).select("id", "x.*").select(*m.edges.columns)
    mine = moved(m.verification.join(every.select(F.col("old").alias("node_id")), "node_id", "left_semi").select(*m.verification.columns), "node_id")
    rest = m.verification.join(every.select(F.col("old").alias("node_id")), "node_id", "left_anti").select(*m.verification.columns)
    ver = rest.unionByName(mine.join(rest.select("node_id"), "node_id", "left_anti").select(*rest.columns))
    inner = owned if owned is not None else every.limit(0)
    nodes = m.nodes.join(inner.select(F.col("old").alias("id"), F.col("new").alias("_new")), "id", "left").withColumn("id", F.coalesce("_new", "id")).drop("_new")
    return m.but(nodes=nodes, history=moved(m.history, "node_id"), verification=ver, edges=edges)


def mark_clean(m: Mesh, ids: DataFrame, at: datetime, by: str, reason: str) -> Mesh:
    """Verify nodes as they are: an event, a snapshot of their observed hashes, and that as the new baseline."""
    kind = "AGENT_VERIFIED" if by.startswith("agent") else "MANUAL_VERIFIED"
    hit = m.nodes.join(ids.select("id").distinct(), "id", "left_semi").join(m.current, "id", "left")
    hit = hit.select("id", F.coalesce("cur_code", "code_hash").alias("code_hash"), F.coalesce("cur_desc", "desc_hash").alias("desc_hash"))
    event = hit.select(F.col("id").alias("node_id"), _at(at).alias("scanned_at"), F.lit(kind).alias("change_type"), F.to_json(F.struct(F.lit(reason).alias("reason"))).alias("meta"))
    snap = hit.select(F.col("id").alias("node_id"), F.lit("VERIFIED").alias("status"), _at(at).alias("verified_at"), F.lit(by).alias("verified_by"), F.lit(reason).alias("reason"), F.col("code_hash").alias("code_hash_at"), F.col("desc_hash").alias("desc_hash_at"))
    out = set_baseline(m, hit)
    return out.but(history=m.history.unionByName(events(event, m.history)), verification=keep_latest(m.verification, snap.select(*m.verification.columns), "node_id"))


def mark_clean_report(m: Mesh, ids: DataFrame) -> DataFrame:
    """id, result of each id that mark_clean is asked for: marked or not_found."""
    return ids.select("id").distinct().join(m.nodes.select("id", F.lit(True).alias("known")), "id", "left").select("id", F.when(F.col("known"), "marked").otherwise("not_found").alias("result"))


def add_edges(m: Mesh, wanted: DataFrame, at: datetime) -> tuple[Mesh, DataFrame]:
    """Add typed edges (from_id, edge_type, to_id): the index after it, and for each edge added, no_start, no_end or
    not_allowed by the rules of types."""
    from .drift import EDGE_RULES

    rules = m.nodes.sparkSession.createDataFrame(EDGE_RULES, "edge_type string, ft string, tt string").withColumn("ok", F.lit(True))
    t = m.nodes.select("id", "node_type")
    j = wanted.select("from_id", "edge_type", "to_id").distinct().join(t.select(F.col("id").alias("from_id"), F.col("node_type").alias("ft")), "from_id", "left").join(t.select(F.col("id").alias("to_id"), F.col("node_type").alias("tt")), "to_id", "left")
    j = j.join(F.broadcast(rules), ["edge_type", "ft", "tt"], "left")  # as many rows as there are rules
    told = j.select("from_id", "edge_type", "to_id", F.when(F.col("ft").isNull(), "no_start").when(F.col("tt").isNull(), "no_end").when(F.col("ok").isNull(), "not_allowed").otherwise("added").alias("result"))
    new = told.filter("result = 'added'")
    have = {"id": fn.edge_id("from_id", "edge_type", "to_id"), "weight": F.lit(1.0), "loaded_at": _at(at)}
    rows = new.select(*[(have[c] if c in have else F.col(c) if c in new.columns else F.lit(None)).cast(k).alias(c) for c, k in m.edges.dtypes])
    return upsert_edges(m, rows), told


def purge(m: Mesh, ids: DataFrame, at: datetime) -> tuple[Mesh, DataFrame]:
    """Delete those of the ids whose own status is NOT_FOUND; and what became of each id."""
    j = ids.select("id").distinct().join(m.nodes.select("id", "own_status"), "id", "left")
    told = j.select("id", F.when(F.col("own_status").isNull(), "unknown").when(F.col("own_status") == "NOT_FOUND", "purged").otherwise("not_stale").alias("result"))
    return delete_nodes(m, told.filter("result = 'purged'").select("id"), at), told


def checkpoint_events(m: Mesh, node_types: Collection[str], at: datetime, git_sha: str, message: str) -> Mesh:
    """A preserved CHECKPOINT row for each node of the types."""
    rows = m.nodes.filter(F.col("node_type").isin(*node_types)).select(F.col("id").alias("node_id"), _at(at).alias("scanned_at"), F.lit("CHECKPOINT").alias("change_type"), F.lit(git_sha[:12]).alias("git_sha"), F.to_json(F.struct(F.lit(message).alias("message"))).alias("meta"), F.lit(True).alias("preserved"))
    return m.but(history=m.history.unionByName(events(rows, m.history)))


def export_json(m: Mesh) -> DataFrame:
    """The index as JSON lines: kind, document; nodes and edges a document each, so that no task holds them all."""
    return m.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(*[c for c in m.nodes.columns])).alias("document")).unionByName(m.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(*m.edges.columns)).alias("document")))
