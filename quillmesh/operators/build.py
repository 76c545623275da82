"""A whole build: files to nodes and edges, what is new, lost or renamed, links reconciled, statuses renewed."""

from __future__ import annotations

from collections.abc import Collection
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh
from ..runtime import cut
from ..sources import project, scan, scripts
from . import documents, mutations, rename, staleness


def scanned(files: DataFrame) -> DataFrame:
    """The facts of source files (location, content): Python by its parser, scripts by their outline; others have none."""
    py = scan.python_facts(files.filter(F.col("location").endswith(".py")))
    js = scripts.script_facts(files.filter(F.lower("location").rlike(r"\.(jsx?|tsx?|mjs|cjs)$")))
    return py.unionByName(js)


def as_nodes(facts: DataFrame, like: DataFrame, mtimes: DataFrame | None, at: datetime) -> DataFrame:
    """Nodes of the facts in the shape of an index's nodes."""
    n = scan.fact_nodes(facts)
    if mtimes is not None:
        n = n.join(mtimes.select("location", F.col("file_mtime").cast("double")), "location", "left")
    else:
        n = n.withColumn("file_mtime", F.lit(None).cast("double"))
    steps = F.from_json(F.get_json_object("meta", "$.steps"), "array<struct<step_num:double,name:string,purpose:string,inputs:string,outputs:string,critical:string>>")
    have = {"status": F.lit("active"), "source": F.when(F.col("location").endswith(".py"), "ast").otherwise("tree_sitter"), "level_0": F.substring_index("id", "::", 1), "level_steps": steps, "dflow_meta": F.col("meta"), "own_status": F.lit("VERIFIED"), "link_status": F.lit("VERIFIED"), "updated_at": F.lit(at).cast("timestamp")}
    return n.select(*[(have[c] if c in have else F.col(c) if c in n.columns else F.lit(None)).cast(t).alias(c) for c, t in like.dtypes])


def current_hashes(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """id, code_hash, desc_hash, state of nodes against their files (location, content), parsed once each.

    state: seen, not_found (the file is read and has no such node), missing (no such file), or kept (of files that nothing
    reads: the stored hashes count). Files may be those of now or of a commit."""
    facts = scan.fact_nodes(scanned(files)).select("id", F.col("code_hash").alias("c"), F.col("desc_hash").alias("d"), F.lit(True).alias("seen"))
    readable = F.lower("location").rlike(r"\.(py|jsx?|tsx?|mjs|cjs)$")
    n = nodes.select("id", "location", "code_hash", "desc_hash").join(facts, "id", "left").join(files.select("location", F.lit(True).alias("there")).distinct(), "location", "left")
    state = F.when(~F.coalesce(readable, F.lit(False)), "kept").when(F.col("there").isNull(), "missing").when(F.col("seen").isNull(), "not_found").otherwise("seen")
    own = state == "seen"
    return n.select("id", F.when(own, F.col("c")).when(state == "kept", F.col("code_hash")).alias("code_hash"), F.when(own, F.col("d")).when(state == "kept", F.col("desc_hash")).alias("desc_hash"), state.alias("state"))


def observation(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """The state seen on disk in the shape of Mesh.current: id, gone, cur_code, cur_desc; nodes of kept files are not covered."""
    h = current_hashes(nodes, files).filter("state <> 'kept'")
    return h.select("id", F.col("state").isin("not_found", "missing").alias("gone"), F.lower("code_hash").alias("cur_code"), F.lower("desc_hash").alias("cur_desc"))


def orphan_links(current: DataFrame, intended: DataFrame, scanned_ids: DataFrame) -> DataFrame:
    """from_id, to_id of documents links that a section of scanned_ids (id) has in the index and no longer in its text."""
    mine = current.filter("edge_type = 'documents'").join(scanned_ids.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    return mine.select("from_id", "to_id").join(intended.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti").distinct()


def reconcile_links(m: Mesh, intended: DataFrame, scanned_ids: DataFrame, at: datetime) -> Mesh:
    """Take out orphan_links, each with a LINK_REMOVED row."""
    gone = cut(orphan_links(m.edges, intended, scanned_ids))
    rows = gone.select(F.col("from_id").alias("node_id"), F.lit(at).cast("timestamp").alias("scanned_at"), F.lit("LINK_REMOVED").alias("change_type"), F.to_json(F.struct(F.col("to_id").alias("target"), F.lit("build:reconcile").alias("actor"))).alias("meta"))
    ids = gone.select(fn.edge_id("from_id", F.lit("documents"), "to_id").alias("id"))
    return m.but(edges=m.edges.join(ids, "id", "left_anti").select(*m.edges.columns), history=m.history.unionByName(mutations.events(rows, m.history)))


def stale_locations(m: Mesh, manifest: DataFrame, exclude_dirs: Collection[str] = (), with_docs: bool = True) -> DataFrame:
    """id of nodes whose file is not in the manifest (location), or lies in an excluded folder; entities have no file, and
    documents count only with_docs."""
    n = m.nodes.filter("node_type <> 'entity' and location is not null and location <> ''")
    n = (n if with_docs else n.filter("coalesce(subtype, '') <> 'docjson'")).select("id", "location")
    lost = n.join(manifest.select("location"), "location", "left_anti")
    return (lost.unionByName(n.filter(~project.not_skipped(F.col("location"), exclude_dirs)).select(*lost.columns)) if exclude_dirs else lost).select("id").distinct()


def purge_stale(m: Mesh, manifest: DataFrame, at: datetime, exclude_dirs: Collection[str] = ()) -> Mesh:
    return mutations.delete_nodes(m, cut(stale_locations(m, manifest, exclude_dirs)), at)


def _merged(m: Mesh, files: DataFrame, at: datetime, discovery_only: bool, git_sha: str | None) -> tuple[Mesh, DataFrame]:
    facts = cut(scanned(files))
    new = cut(as_nodes(facts, m.nodes, files if "file_mtime" in files.columns else None, at))
    e = scan.fact_edges(facts)
    told = F.from_json("meta", "map<string,string>")
    have = {"weight": F.lit(1.0), "via": F.try_element_at(told, F.lit("via")), "event": F.try_element_at(told, F.lit("event")), "meta": told, "loaded_at": F.lit(at).cast("timestamp")}
    edges = e.select(*[(have[c] if c in have else F.col(c) if c in e.columns else F.lit(None)).cast(t).alias(c) for c, t in m.edges.dtypes])
    tags = scan.fact_nodes(facts).select(F.col("id").alias("node_id"), F.explode("tags").alias("tag"))
    out = mutations.upsert_edges(mutations.upsert_nodes(m, new, at, discovery_only, git_sha), edges)
    first = tags.join(m.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    return out.but(tags=m.tags.select("node_id", "tag").unionByName(first).distinct()), facts


def rescan(m: Mesh, files: DataFrame, at: datetime) -> Mesh:
    """Take in files again whose text is not that of their module node; known hashes stay, so that drift still shows."""
    anchors = m.nodes.filter("subtype = 'module'").select("location", F.col("code_hash").alias("_anchor"))
    new = files.join(anchors, "location", "left").filter(~project.same_text("content", "_anchor")).drop("_anchor")
    return _merged(m, new, at, True, None)[0]


def build(m: Mesh, files: DataFrame, at: datetime, discovery_only: bool = True, git_sha: str | None = None, exclude_dirs: Collection[str] = (), transitive_tags: Collection[str] = ("consumer",), frozen_tags: Collection[str] = ("frozen",), pool_cap: int | None = rename.POOL_CAP, threshold: float = rename.THRESHOLD, docs: DataFrame | None = None) -> tuple[Mesh, dict[str, int]]:
    """A build over all source files of the projects (location, content, and file_mtime if known): the index after it and the
    numbers of files read, nodes, edges, lost, renamed and purged nodes.

    Files no newer than stored, or of equal text, are not read again. What is lost in files that were read, and what is new,
    is matched as renames within each file, which carry history, verification and links over. Nodes of vanished files go.
    Statuses are then renewed against all files, and their changes told in the history. docs (project, slug, raw: all
    documents there are) are read along, their links reconciled, and vanished ones taken out; without docs those of the
    index stay as they are.
    """
    manifest = cut(files.select("location", "content", *[c for c in ("file_mtime",) if c in files.columns]).filter("location is not null and content is not null"))
    anchors = m.nodes.filter("subtype = 'module'").select("location", F.col("code_hash").alias("_anchor"))
    todo = cut(manifest.join(anchors, "location", "left").filter(~project.same_text("content", "_anchor")).drop("_anchor"))
    before = cut(m.nodes.select("id", "location", "subtype", "code_hash", F.col("level_2").alias("body")))
    out, facts = _merged(m, todo, at, discovery_only, git_sha)
    seen = cut(facts.filter("kind = 'node'").select("id").distinct())
    lost = cut(before.filter("subtype in ('function', 'test')").join(todo.select("location"), "location", "left_semi").join(seen, "id", "left_anti"))
    new = out.nodes.filter("subtype in ('function', 'test')").join(seen, "id", "left_semi").join(before.select("id"), "id", "left_anti")
    shape = lambda df: df.select("id", F.coalesce("location", F.lit("")).alias("scope"), "code_hash", "body")
    found = cut(new.select("id", "location", "code_hash", F.col("level_2").alias("body")))
    pairs = cut(rename.match(shape(lost), shape(found).withColumn("is_new", F.lit(True)), pool_cap, threshold).filter("new_id is not null").select("old_id", "new_id"))
    out = mutations.rename(out, pairs)
    done = rename.renames_of(m).unionByName(pairs.select("old_id", "new_id", F.lit(at).cast("timestamp").alias("renamed_at"), F.lit("").alias("file_path")))
    gone = stale_locations(out, manifest, exclude_dirs, False).unionByName(pairs.select(F.col("old_id").alias("id")))
    if docs is not None:
        hashes = cut(documents.doc_hashes(docs))
        known = out.nodes.filter("subtype = 'docjson'").select("id", F.concat_ws("::", F.get(F.split("id", "::"), 0), F.get(F.split("id", "::"), 1)).alias("doc_id"))
        gone = gone.unionByName(known.join(hashes.select(F.col("id").alias("doc_id")), "doc_id", "left_anti").select("id"))
    gone = cut(gone.distinct())
    left = out.nodes.join(gone, "id", "left_anti")
    now = observation(left.filter("coalesce(subtype, '') <> 'docjson'"), manifest)
    out = mutations.delete_nodes(out, gone, at, git_sha)
    if docs is not None:
        out, _ = documents.write_docs(out, docs, at, None)
        now = now.unionByName(hashes.select("id", F.lit(False).alias("gone"), F.col("code_hash").alias("cur_code"), F.col("desc_hash").alias("cur_desc")))
    out = out.but(renames=done, current=now)
    out = out.but(nodes=cut(out.nodes), edges=cut(out.edges), history=cut(out.history), current=cut(out.current))
    fresh = cut(staleness.statuses(out, transitive_tags, frozen_tags, pairs.select(F.col("new_id").alias("id"))))
    events = staleness.transitions(out.nodes.select("id", "own_status", "link_status"), fresh)
    rows = events.select(F.col("id").alias("node_id"), F.lit(at).cast("timestamp").alias("scanned_at"), F.col("event").alias("change_type"), F.lit(git_sha).cast("string").alias("git_sha"))
    out = mutations.set_statuses(out, fresh).but(history=out.history.unionByName(mutations.events(rows, out.history)))
    told = {"files": manifest.count(), "files_read": todo.count(), "nodes": fresh.count(), "edges": out.edges.count(), "lost": lost.count(), "renamed": pairs.count(), "purged": gone.count()}
    return out, told


def check(m: Mesh, fail_on: str = "none", findings: DataFrame | None = None) -> tuple[dict[str, int], int]:
    """(counts of statuses, exit code): 1 where there is what fail_on names (stale: links or content, unverified: any own status
    but VERIFIED, any: either), or where findings, if given, has a row."""
    c = staleness.summary(m.nodes).first().asDict()
    own = sum(v for k, v in c.items() if k.startswith("own_")) - c["own_verified"]
    link = sum(v for k, v in c.items() if k.startswith("link_")) - c["link_verified"]
    stale = c["own_content_updated"] + c["own_not_found"] + link
    bad = {"none": 0, "stale": stale, "unverified": own, "any": own + link}
    if fail_on not in bad:
        raise ValueError(f"unknown: {fail_on!r}")
    wrong = findings is not None and not findings.isEmpty()
    return c, int(bad[fail_on] > 0 or wrong)
