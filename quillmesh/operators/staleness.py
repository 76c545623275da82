"""The status of every node: its own state, that of its links, and what caused it."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..runtime import cut
from ..schema import CODE_OR_DESC_CHANGES, LINK, OWN, severity, status_of
from . import drift, graph
from .history import latest_change, latest_change_times
from .inventory import sections_of_docs_with_tags


def change_type(old_code: Column, old_desc: Column, new_code: Column, new_desc: Column) -> Column:
    """What a write changed: INITIAL without an old hash, else CONTENT_AND_DESC, CONTENT_ONLY, DESC_ONLY or null; null equals null."""
    code, desc = ~old_code.eqNullSafe(new_code), ~old_desc.eqNullSafe(new_desc)
    return F.when(old_code.isNull(), "INITIAL").when(code & desc, "CONTENT_AND_DESC").when(code, "CONTENT_ONLY").when(desc, "DESC_ONLY")


def own_statuses(m: Mesh) -> DataFrame:
    """id, own: the severity of each node against the state last observed; null where a composite takes that of its parts.

    External packages, entities, steps and nodes without a hash are verified, as are nodes whose file the observation
    doesn't cover. Both hashes changed counts as changed content."""
    n = m.nodes.join(m.current, "id", "left")
    fixed = (F.col("node_type") == "entity") | F.coalesce("subtype", F.lit("")).isin("external_package", "step", "autostep")
    code = ~F.lower("code_hash").eqNullSafe(F.col("cur_code"))
    desc = ~F.lower("desc_hash").eqNullSafe(F.col("cur_desc"))
    inner = (F.col("node_type") == "composite_process") & ~F.coalesce("subtype", F.lit("")).isin("docjson", "workflow", "task")
    own = F.when(fixed | F.col("gone").isNull(), 0).when(F.col("gone"), 4).when(F.col("code_hash").isNull(), 0).when(inner, None).when(code, 2).when(desc, 1).otherwise(0)
    return n.select("id", own.cast("int").alias("own"), F.coalesce("cur_code", F.lower("code_hash")).alias("seen_code"), F.when(F.col("gone").isNotNull(), F.col("cur_desc")).otherwise(F.lower("desc_hash")).alias("seen_desc"))


def narrowed(m: Mesh) -> Mesh:
    """The columns that statuses are made of, written once: the operators below read them many times."""
    nodes = cut(m.nodes.select("id", "node_type", "subtype", "code_hash", "desc_hash", "own_status", "link_status", "updated_at"))
    edges = cut(m.edges.select("id", "edge_type", "from_id", "to_id"))
    history = cut(m.history.filter(F.col("change_type").isin(*CODE_OR_DESC_CHANGES)).select("id", "node_id", "change_type", "scanned_at"))
    return m.but(nodes=nodes, edges=edges, history=history, sections=cut(m.sections.select("id", "doc_id", "heading")), docs=cut(m.docs.select("id", "tags")))


def linked_stale(m: Mesh, transitive_tags: Collection[str] = (), frozen_tags: Collection[str] = ()) -> DataFrame:
    """id, via: nodes whose links are stale, a row per cause.

    Causes: a documented or validated node whose code ever changed, an annotated one that changed since, a task reached by
    delegation whose code changed since. Nodes verified later than the last code change of all their causes are left out.
    Then sections of docs with a transitive tag become stale through stale sections they document. Sections of docs with a
    frozen tag never become stale by their own or by transitive links.
    """
    m = narrowed(m)
    return _linked_stale(m, graph.reachable_tasks(m, graph.delegating(m)), transitive_tags, frozen_tags)


def _linked_stale(m: Mesh, reach: DataFrame, transitive_tags: Collection[str], frozen_tags: Collection[str]) -> DataFrame:
    frozen = sections_of_docs_with_tags(m, frozen_tags).select("id")
    sec = drift.stale_sections(m).select("id", "via")
    if frozen_tags:
        sec = sec.join(frozen, "id", "left_anti")
    causes = sec.unionByName(drift.stale_tests(m).select("id", "via")).unionByName(drift.stale_annotated(m).select("id", "via")).unionByName(graph.stale_by_delegation(m, latest_change(m.history), reach))
    causes = causes.distinct()
    last = latest_change_times(m.history)
    at = causes.join(last, causes.via == last.node_id, "left").groupBy("id").agg(F.max("changed_at").alias("latest"))
    proven = at.join(m.verification.groupBy(F.col("node_id").alias("id")).agg(F.max("verified_at").alias("v")), "id").filter("v is not null and (latest is null or latest <= v)")
    direct = cut(causes.join(proven.select("id"), "id", "left_anti"))
    if not transitive_tags:
        return direct
    hops = drift.doc_doc_links(m, transitive_tags)
    if frozen_tags:
        hops = hops.join(frozen.withColumnRenamed("id", "src"), "src", "left_anti")
    hops = cut(hops)
    stale = graph.grow(direct.select("id"), ["id"], lambda f: f.join(hops, f.id == hops.tgt).select(F.col("src").alias("id")), None)
    more = hops.join(stale.select(F.col("id").alias("tgt")), "tgt").select(F.col("src").alias("id"), F.col("tgt").alias("via"))
    return direct.unionByName(more).distinct()


def statuses(m: Mesh, transitive_tags: Collection[str] = ("consumer",), frozen_tags: Collection[str] = ("frozen",), renamed: DataFrame | None = None) -> DataFrame:
    """id, own_status, link_status of every node: own states, stale links, those of envelopes whose targets have drifted just
    now, inheritance by composites, promotion by verification, broken links, then renames.

    A node that is stored as RENAMED stays so unless it is lost: no hash tells of a rename. renamed (id) adds those of
    this build.
    """
    m = narrowed(m)
    own = cut(own_statuses(m))
    ann = m.edges.filter("edge_type = 'annotates'")
    starts = graph.delegating(m)
    reach = cut(graph.reachable_tasks(m, starts.select("id").union(ann.select("from_id")).distinct()))
    stale = _linked_stale(m, reach, transitive_tags, frozen_tags).select("id").distinct()
    kept = m.nodes.filter("link_status = 'LINKED_STALE'").join(sections_of_docs_with_tags(m, frozen_tags), "id", "left_semi").select("id")
    drifted = own.filter("own in (1, 2, 4)").select(F.col("id").alias("to_id"))
    fresh = ann.join(drifted, "to_id", "left_semi").select(F.col("from_id").alias("id"))
    code = own.filter("own in (2, 4)").select(F.col("id").alias("task"))
    fresh = fresh.unionByName(reach.join(ann.select(F.col("from_id").alias("env")), "env", "left_semi").join(code, "task", "left_semi").select(F.col("env").alias("id")))
    linked = stale.unionByName(kept).unionByName(fresh).distinct().withColumn("link", F.lit(1))
    base = own.select("id", F.coalesce("own", F.lit(0)).alias("own")).join(linked, "id", "left").fillna(0, ["link"])
    got = graph.inherit(m, base).join(own.select("id", "seen_code", "seen_desc"), "id")
    v = m.verification.groupBy(F.col("node_id").alias("id")).agg(F.max_by(F.struct("code_hash_at", "desc_hash_at"), "verified_at").alias("at"))
    got = got.join(v, "id", "left")
    same_code, same_desc = F.lower("at.code_hash_at").eqNullSafe(F.col("seen_code")), F.lower("at.desc_hash_at").eqNullSafe(F.col("seen_desc"))
    promoted = F.when(F.col("own").isin(1, 2) & F.col("at").isNotNull() & F.col("seen_code").isNotNull(), F.when(same_code & same_desc, 0).when(~same_code, 2).otherwise(1)).otherwise(F.col("own"))
    broken = drift.broken_links(m).select("id", F.lit(2).alias("b"))
    sticky = m.nodes.filter("own_status = 'RENAMED'").select("id")
    sticky = (sticky if renamed is None else sticky.unionByName(renamed.select("id"))).distinct().withColumn("moved", F.lit(True))
    out = got.withColumn("own", promoted).join(broken, "id", "left").join(sticky, "id", "left")
    own_now = F.when(F.col("moved") & (F.col("own") != OWN.index("NOT_FOUND")), OWN.index("RENAMED")).otherwise(F.col("own"))
    return out.select("id", status_of(own_now, OWN).alias("own_status"), status_of(F.greatest("link", F.coalesce("b", F.lit(0))), LINK).alias("link_status"))


def transitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, event: what a change of status is called, none to two rows per node. Both: id, own_status, link_status."""
    j = old.select("id", F.col("own_status").alias("oo"), F.col("link_status").alias("ol")).join(new, "id")
    own = F.when(F.coalesce("oo", F.lit("VERIFIED")) != F.col("own_status"), F.concat(F.lit("BECAME_"), "own_status"))
    link = F.when(F.coalesce("ol", F.lit("VERIFIED")) != F.col("link_status"), F.when(F.col("link_status") == "VERIFIED", "LINK_BECAME_VERIFIED").otherwise(F.concat(F.lit("BECAME_"), "link_status")))
    return j.select("id", F.explode(F.filter(F.array(own, link), lambda x: x.isNotNull())).alias("event"))


def summary(rows: DataFrame) -> DataFrame:
    """Counts of a status table: one row."""
    own = [F.count_if(F.col("own_status") == s).alias(f"own_{s.lower()}") for s in OWN]
    link = [F.count_if(F.col("link_status") == s).alias(f"link_{s.lower()}") for s in LINK]
    return rows.agg(*own, *link, F.count_if((F.col("own_status") == "VERIFIED") & (F.col("link_status") == "VERIFIED")).alias("clean"))


def causes(m: Mesh) -> DataFrame:
    """id, status, cause: the worse of a node's two statuses and what it says."""
    o, link = severity("own_status", OWN), severity("link_status", LINK)
    text = F.when(o > 0, F.concat(F.lit("own: "), "own_status")).when(link > 0, F.concat(F.lit("links: "), "link_status")).otherwise("verified")
    return m.nodes.select("id", F.when(o > 0, F.col("own_status")).otherwise(F.col("link_status")).alias("status"), text.alias("cause"))
