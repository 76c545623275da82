"""Drift views: filters, groupings, offenders and the joins behind stale links."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh
from ..schema import CODE_OR_DESC_CHANGES, LINK, LONG_SECTION, OWN
from .history import latest_change
from .inventory import sections_of_docs_with_tags

VIA_EDGES = ("annotates", "documents", "validates", "delegates_to")


def parse_filter(text: str | None) -> tuple[set[str], set[str], bool]:
    """(own statuses, link statuses, long sections too) that a filter word shows; an unknown word is an error."""
    own, link = set(OWN[1:]), set(LINK[1:])
    named = {None: (own, link, False), "staleness": (own, {"LINKED_STALE"}, False), "links": (set(), link, False), "doc_quality": (set(), set(), True), "DOC_SECTION_LONG": (set(), set(), True), "all": (own, link, True)}
    if text in named:
        return named[text]
    if text in link:
        return set(), {text}, False
    if text in OWN:
        return {text}, set(), False
    raise ValueError(f"unknown filter: {text!r}")


def matches(text: str | None, location_glob: str | None = None, long_section: int = LONG_SECTION) -> Column:
    """The filter as one predicate on nodes. Globs match without regard to case; sections are long beyond long_section characters."""
    own, link, long = parse_filter(text)
    cond = F.lit(False)
    if own:
        cond = cond | F.col("own_status").isin(*sorted(own))
    if link:
        cond = cond | F.col("link_status").isin(*sorted(link))
    if long:
        cond = cond | ((F.col("subtype") == "docjson") & (F.length("level_2") > long_section))
    if location_glob is not None:
        cond = cond & F.coalesce("level_3_location", "location").ilike(fn.glob_to_like(location_glob))
    return F.coalesce(cond, F.lit(False))


def vias(m: Mesh, most: int = 3) -> DataFrame:
    """id, via: the first offenders (targets of its links whose own status isn't VERIFIED, by id), at most `most`."""
    bad = m.nodes.filter("own_status <> 'VERIFIED'").select(F.col("id").alias("to_id"))
    hit = m.edges.filter(F.col("edge_type").isin(*VIA_EDGES)).join(bad, "to_id", "left_semi").select(F.col("from_id").alias("id"), F.col("to_id").alias("via")).distinct()
    return hit.withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("via"))).filter(F.col("rn") <= most).select("id", "via", "rn")


def features(m: Mesh) -> DataFrame:
    """id, feature: of the documents links to a node, the feature (the part after `features` in the doc's path) of the
    deepest section, at equal depth the first by name."""
    path = F.split(F.get(F.split("doc_id", "::"), 1), r"\.")
    at = F.array_position(path, F.lit("features"))
    label = F.when(at > 0, F.try_element_at(path, (at + 1).cast("int")))
    s = m.sections.select(F.col("id").alias("from_id"), "depth", label.alias("feature")).filter("feature is not null")
    hit = m.edges.filter("edge_type = 'documents'").join(s, "from_id")
    return hit.groupBy(F.col("to_id").alias("id")).agg(F.min(F.struct((-F.col("depth")).alias("d"), "feature")).alias("x")).select("id", "x.feature")


def group_key(m: Mesh, rows: DataFrame, by: str) -> DataFrame:
    if by == "status":
        return rows.withColumn("grp", F.concat_ws("/", "own_status", "link_status"))
    if by == "location_prefix":
        return rows.withColumn("grp", fn.location_prefix(F.coalesce("level_3_location", "location")))
    if by == "feature":
        return rows.join(features(m), "id", "left").withColumn("grp", F.coalesce("feature", F.lit("(undocumented)")))
    raise ValueError(f"unknown grouping: {by!r}")


def drift_rows(m: Mesh, text: str | None = None, location_glob: str | None = None, frozen_tags: Collection[str] = (), include_frozen: bool = False) -> DataFrame:
    """id, own_status, link_status, location, marker of the nodes a filter shows. Sections of docs with a frozen tag are
    left out, but for broken links (marked [frozen-source]), or marked [frozen] if wanted."""
    rows = m.nodes.filter(matches(text, location_glob))
    marker = F.lit("")
    if frozen_tags:
        frozen = sections_of_docs_with_tags(m, frozen_tags).select("id", F.lit(True).alias("frozen"))
        rows = rows.join(frozen, "id", "left")
        if include_frozen:
            marker = F.when(F.col("frozen"), "[frozen]").otherwise("")
        else:
            rows = rows.filter(F.col("frozen").isNull() | (F.col("link_status") == "BROKEN_LINK"))
            marker = F.when(F.col("frozen"), "[frozen-source]").otherwise("")
    return rows.select("id", "own_status", "link_status", F.coalesce("level_3_location", "location").alias("location"), "level_3_location", marker.alias("marker"))


def drift_page(m: Mesh, rows: DataFrame, page: int, limit: int) -> DataFrame:
    """A page of drift rows by id with their offenders and the total of rows; the total is of the rows after all filters."""
    total = rows.agg(F.count("*").alias("total"))
    some = rows.orderBy("id").offset(page * limit).limit(limit)
    by = vias(m).join(F.broadcast(some.select("id")), "id", "left_semi").groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "via"))), lambda x: x["via"]), ",").alias("via"))
    via = F.when(F.col("link_status") == "LINKED_STALE", F.coalesce("via", F.lit(""))).otherwise("")
    return some.join(by, "id", "left").withColumn("via", via).crossJoin(F.broadcast(total))  # one row


def drift_counts(m: Mesh, rows: DataFrame, by: str) -> DataFrame:
    return group_key(m, rows, by).groupBy("grp").agg(F.count("*").alias("n"))


def drift_ids(m: Mesh, rows: DataFrame, by: str) -> DataFrame:
    """grp, id: the members of each group, a row each."""
    return group_key(m, rows, by).select("grp", "id")


def drift_full(m: Mesh, rows: DataFrame, by: str) -> DataFrame:
    return group_key(m, rows, by).select("grp", "id", "own_status", "link_status", "location", "marker")


# --- joins behind the links --------------------------------------------------------------------------------------


def _code_targets(m: Mesh) -> DataFrame:
    """Nodes that a link can make stale: all but sections."""
    section = (F.col("node_type") == "atomic_process") & (F.coalesce("subtype", F.lit("")) == "docjson")
    return m.nodes.filter(~section).select(F.col("id").alias("to_id"))


def stale_sections(m: Mesh) -> DataFrame:
    """Sections linked to code that ever changed; a later edit of the section doesn't clear it."""
    hit = m.edges.filter("edge_type = 'documents'").join(_code_targets(m), "to_id", "left_semi").join(latest_change(m.history), F.col("to_id") == F.col("node_id"))
    return hit.join(m.sections.select(F.col("id").alias("from_id"), "doc_id", "heading"), "from_id").select(F.col("from_id").alias("id"), "doc_id", "heading", F.col("to_id").alias("via"), "changed_at")


def stale_tests(m: Mesh) -> DataFrame:
    tests = m.nodes.filter("node_type = 'atomic_process' and subtype = 'test'").select(F.col("id").alias("from_id"))
    hit = m.edges.filter("edge_type = 'validates'").join(tests, "from_id", "left_semi").join(_code_targets(m), "to_id", "left_semi")
    return hit.join(latest_change(m.history), F.col("to_id") == F.col("node_id")).select(F.col("from_id").alias("id"), F.col("to_id").alias("via"), "changed_at")


def stale_annotated(m: Mesh) -> DataFrame:
    """Nodes whose annotated target changed (its description included) after the node was updated."""
    src = m.nodes.select(F.col("id").alias("from_id"), "updated_at")
    hit = m.edges.filter("edge_type = 'annotates'").join(src, "from_id").join(latest_change(m.history, CODE_OR_DESC_CHANGES), F.col("to_id") == F.col("node_id"))
    return hit.filter("changed_at > updated_at").select(F.col("from_id").alias("id"), F.col("to_id").alias("via"), "changed_at", "updated_at")


def broken_links(m: Mesh) -> DataFrame:
    """id, target: sources of documents and validates links to ids that no node has, with the first such id."""
    kinds = m.edges.filter(F.col("edge_type").isin("documents", "validates"))
    lost = kinds.join(m.nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return lost.groupBy(F.col("from_id").alias("id")).agg(F.min("to_id").alias("target"))


def undocumented(m: Mesh, node_type: str | None = None) -> DataFrame:
    told = m.edges.filter("edge_type = 'documents'").select(F.col("to_id").alias("id"))
    section = (F.col("node_type") == "atomic_process") & (F.coalesce("subtype", F.lit("")) == "docjson")
    out = m.nodes.filter(~section).join(told, "id", "left_anti")
    return out.filter(F.col("node_type") == node_type) if node_type else out


def doc_doc_links(m: Mesh, tags: Collection[str]) -> DataFrame:
    """Links from sections of docs with one of the tags to other sections: src, tgt."""
    src = sections_of_docs_with_tags(m, tags).select(F.col("id").alias("from_id"))
    tgt = m.sections.select(F.col("id").alias("to_id"))
    return m.edges.filter("edge_type = 'documents'").join(src, "from_id", "left_semi").join(tgt, "to_id", "left_semi").select(F.col("from_id").alias("src"), F.col("to_id").alias("tgt"))


def shadow_violations(nodes: DataFrame, sections: DataFrame) -> DataFrame:
    """Ids of sections whose node shows another heading, content, hash or time."""
    s = sections.select("id", F.col("heading").alias("h"), F.col("content").alias("c"), F.col("desc_hash").alias("x"), F.col("updated_at").alias("u"))
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    return nodes.join(s, "id").filter((e("level_1") != e("h")) | (e("level_2") != e("c")) | (e("desc_hash") != e("x")) | ~F.col("updated_at").eqNullSafe(F.col("u"))).select("id")


def target_links(m: Mesh, kind: str) -> DataFrame:
    """Targets of one kind of link with their sources, the source's location and title: tests of a node, docs of a node."""
    src = m.nodes.select(F.col("id").alias("from_id"), "location", "title")
    return m.edges.filter(F.col("edge_type") == kind).join(src, "from_id").select("to_id", "from_id", "location", "title")


def section_links(m: Mesh) -> DataFrame:
    """Linked nodes of each section, those that don't exist with a null title; links into the own doc left out."""
    s = m.sections.select(F.col("id").alias("from_id"), "doc_id")
    links = m.edges.filter("edge_type = 'documents'").join(s, "from_id").filter(~(F.col("to_id") == F.col("doc_id")) & ~F.col("to_id").startswith(F.concat("doc_id", F.lit("::"))))
    return links.join(m.nodes.select(F.col("id").alias("to_id"), "title"), "to_id", "left").select("from_id", "to_id", "title")


def workflow_labels(m: Mesh) -> DataFrame:
    """caller, callee, step: envelopes' annotated functions and the functions their steps delegate to."""
    ann = m.edges.filter("edge_type = 'annotates'").groupBy(F.col("from_id").alias("env")).agg(F.min("to_id").alias("caller"))
    steps = m.edges.filter("edge_type = 'composes'").select(F.col("from_id").alias("env"), F.col("to_id").alias("step"))
    to = m.edges.filter("edge_type = 'delegates_to'").groupBy(F.col("from_id").alias("step")).agg(F.min("to_id").alias("callee"))
    return ann.join(steps, "env").join(to, "step").select("caller", "callee", F.regexp_extract("step", r"::step-([0-9.]+)$", 1).alias("step_num"))


_PROCESS, _COMPOSITE, _ANY = ("atomic_process", "composite_process"), ("composite_process",), ("atomic_process", "composite_process", "entity")
# Edge type -> node types allowed at its start and at its end.
EDGE_ENDS = {
    "consumes": (_PROCESS, ("entity",)),
    "produces": (_PROCESS, ("entity",)),
    "composes": (_PROCESS, _PROCESS),
    "delegates_to": (_PROCESS, _PROCESS),
    "depends_on": (_PROCESS, _ANY),
    "constrains": (("atomic_process",), _ANY),
    "validates": (("atomic_process",), _PROCESS),
    "documents": (_PROCESS, _ANY),
    "annotates": (_COMPOSITE, _PROCESS),
    "supersedes": (_PROCESS, _PROCESS),
}
EDGE_RULES = [(k, a, b) for k, (starts, ends) in EDGE_ENDS.items() for a in starts for b in ends]


def invalid_edges(m: Mesh) -> DataFrame:
    """Edges between existing nodes whose types the rules don't allow, with the reason."""
    rules = m.edges.sparkSession.createDataFrame(EDGE_RULES, "edge_type string, ft string, tt string").withColumn("ok", F.lit(True))
    a = m.nodes.select(F.col("id").alias("from_id"), F.col("node_type").alias("ft"))
    b = m.nodes.select(F.col("id").alias("to_id"), F.col("node_type").alias("tt"))
    x = m.edges.join(a, "from_id").join(b, "to_id").join(F.broadcast(rules), ["edge_type", "ft", "tt"], "left_anti")
    return x.select("id", F.concat("edge_type", F.lit(": "), "ft", F.lit(" -> "), "tt").alias("reason"))
