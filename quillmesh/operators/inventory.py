"""Lookups, filters, counts, sets and paging over the index."""

from __future__ import annotations

from collections.abc import Collection
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh
from ..runtime import cut
from ..schema import DOC_SOURCES, LONG_SECTION, TYPE_ALIASES


def with_tags(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """Nodes with their sorted tags; an empty array for those without."""
    own = tags.groupBy(F.col("node_id").alias("id")).agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return nodes.join(own, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def query_nodes(m: Mesh, node_type: str | None = None, tag: str | None = None) -> DataFrame:
    """Nodes of a type (or its alias) and with a tag, each if given."""
    out = m.nodes
    if node_type is not None:
        out = out.filter(F.col("node_type") == TYPE_ALIASES.get(node_type, node_type))
    if tag is not None:
        out = out.join(m.tags.filter(F.col("tag") == tag).select(F.col("node_id").alias("id")), "id", "left_semi")
    return out


def children(m: Mesh, parent_id: str) -> DataFrame:
    kids = m.edges.filter((F.col("edge_type") == "composes") & (F.col("from_id") == parent_id)).select(F.col("to_id").alias("id"))
    return m.nodes.join(kids, "id", "left_semi")


def list_nodes(m: Mesh, node_type: str | None = None, tag: str | None = None, parent_id: str | None = None, location: str | None = None) -> DataFrame:
    """Children of parent_id (the tag then plays no part), or nodes by type and tag; then those whose line location contains a text."""
    out = children(m, parent_id) if parent_id is not None else query_nodes(m, node_type, tag)
    return out.filter(F.col("level_3_location").contains(location)) if location is not None else out


def scope_is(scope: str) -> Column:
    """Whether a node belongs to `code`, `docs` or `all`, by its source."""
    doc = F.coalesce(F.col("source").isin(*DOC_SOURCES), F.lit(False))
    return {"code": ~doc, "docs": doc, "all": F.lit(True)}[scope]


def file_mtimes(m: Mesh) -> DataFrame:
    return m.nodes.filter("file_mtime is not null").groupBy("location").agg(F.max("file_mtime").alias("file_mtime"))


def long_sections(m: Mesh, threshold: int = LONG_SECTION) -> DataFrame:
    n = F.length("content")
    return m.sections.filter(n > threshold).select("id", "doc_id", "heading", n.alias("n_chars")).orderBy(F.col("n_chars").desc(), "id")


def docs_with_tags(m: Mesh, tags: Collection[str]) -> DataFrame:
    return m.docs.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))).select("id") if tags else m.docs.select("id").limit(0)


def sections_of_docs_with_tags(m: Mesh, tags: Collection[str]) -> DataFrame:
    return m.sections.join(docs_with_tags(m, tags).select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("id", "doc_id")


def sections_by_tags(m: Mesh, tags: Collection[str], match_all: bool = False) -> DataFrame:
    """Sections that have one, or each, of the tags. Repeated tags in the request count each for match_all."""
    need = len(tags) if match_all else 1
    hits = m.tags.filter(F.col("tag").isin(*tags)).groupBy("node_id").agg(F.count_distinct("tag").alias("n_tags")).filter(F.col("n_tags") >= need)
    return m.sections.join(hits, F.col("id") == F.col("node_id")).select("id", "doc_id", "heading", "n_tags")


def filter_history(rows: DataFrame, m: Mesh, change_type: str | None = None, node: str | None = None, node_type: str | None = None) -> DataFrame:
    """History rows whose change type and node id match file-name patterns and whose node has the type."""
    if change_type is not None:
        rows = rows.filter(F.col("change_type").rlike(fn.glob_to_regex(change_type)))
    if node is not None:
        rows = rows.filter(F.col("node_id").rlike(fn.glob_to_regex(node)))
    if node_type is not None:
        rows = rows.join(m.nodes.filter(F.col("node_type") == node_type).select(F.col("id").alias("node_id")), "node_id", "left_semi")
    return rows


def run_sql(spark: SparkSession, m: Mesh, query: str, most: int = 500, width: int = 80) -> DataFrame:
    """A read-only query over the index: one SELECT over nodes, edges, tags, node_history, docs, doc_sections and
    node_verification. At most `most` rows; values over `width` characters are cut, nulls read NULL."""
    if not query.lstrip().upper().startswith("SELECT"):
        raise ValueError("only a SELECT is allowed")
    views = {"nodes": m.nodes, "edges": m.edges, "tags": m.tags, "node_history": m.history, "docs": m.docs, "doc_sections": m.sections, "node_verification": m.verification}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    got = spark.sql(query)
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("NULL")).alias(c) for c in got.columns]
    cut = got.limit(most).select(*text)
    return cut.select(*[F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(F.col(c)).alias(c) for c in cut.columns])


def tag_counts(m: Mesh) -> DataFrame:
    return m.tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy("tag")


def type_counts(m: Mesh) -> DataFrame:
    return m.nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def meta(m: Mesh, embedded: DataFrame) -> DataFrame:
    """One row: numbers of nodes and edges, the distinct edge types, tags and statuses, and the share of nodes with a vector."""
    a = m.nodes.agg(F.count("*").alias("n_nodes"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))
    b = m.edges.agg(F.count("*").alias("n_edges"), F.array_join(F.sort_array(F.collect_set("edge_type")), ",").alias("edge_types"))
    c = m.tags.agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    x = m.nodes.join(embedded.select(F.col("node_id").alias("id")).distinct(), "id", "left_semi").agg(F.count("*").alias("n_embedded"))
    one = a.crossJoin(b).crossJoin(c).crossJoin(x)  # one row each
    return one.withColumn("coverage", F.round(F.col("n_embedded") / F.greatest("n_nodes", F.lit(1)), 4))


def location_rollup(m: Mesh) -> DataFrame:
    """Nodes counted under every directory of their location."""
    parts = F.filter(F.split("location", "/"), lambda x: x != "")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return m.nodes.filter(F.size(parts) > 0).select(F.explode(ups).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


def page(df: DataFrame, order: list[str], number: int, size: int) -> DataFrame:
    """A page of the ordered rows, with the total."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(max(0, number) * max(1, size)).limit(size).crossJoin(F.broadcast(total))  # one row


def within_budget(df: DataFrame, order: str, text: str, budget: int, key: str | None = None) -> DataFrame:
    """Rows marked kept while the running number of characters, in this order, is within the budget; per key, if given."""
    sized = df.withColumn("chars", F.length(F.coalesce(F.col(text), F.lit(""))).cast("long"))
    if key:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return sized.withColumn("kept", F.sum("chars").over(w) <= budget)
    # Without a key: ranges of the order, each summed by itself; what the ranges before hold is a row per range.
    ranged = cut(sized.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    own = F.sum("chars").over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy("_range").agg(F.sum("chars").alias("_n"))
    before = sums.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(before), "_range").withColumn("kept", own + F.col("_before") <= budget).drop("_range", "_before")  # a row per task


def envelopes(m: Mesh, role: str | None = None, module: str | None = None, scope: str = "all", has_steps: bool = False) -> DataFrame:
    """Workflow, task and state machine envelopes with their number of steps, filtered."""
    kinds = ["workflow", "task", "state_machine"]
    env = m.nodes.filter(F.col("subtype").isin(*kinds))
    steps = m.nodes.select(F.col("id").alias("to_id"), F.col("subtype").alias("step"))
    per = m.edges.filter("edge_type = 'composes'").join(steps, "to_id").groupBy("from_id").agg(F.count_if(F.col("step").isin("step", "autostep")).alias("n_steps"), F.count_if(F.col("step") == "state").alias("n_states"))
    out = env.join(per, env.id == per.from_id, "left").withColumn("step_count", F.coalesce(F.when(F.col("subtype") == "state_machine", F.col("n_states")).otherwise(F.col("n_steps")), F.lit(0)))
    if role is not None:
        out = out.filter(F.col("subtype") == role)
    if module is not None:
        out = out.filter(F.get(F.split("id", "::"), 1).contains(module))
    test = F.get(F.split("id", "::"), 1).startswith("tests.")
    if scope != "all":
        out = out.filter(test if scope == "tests" else ~test)
    if has_steps:
        out = out.filter("step_count > 0")
    return out.select("id", "subtype", "level_1", "location", "step_count")


def tests_dashboard(m: Mesh) -> DataFrame:
    """Tests that are no fixtures, with what they validate, their steps and their tier: T3 with steps, T2 with targets, else T1."""
    fixtures = m.tags.filter("tag = 'test:fixture'").select(F.col("node_id").alias("id"))
    tests = m.nodes.filter("subtype = 'test'").join(fixtures, "id", "left_anti")
    val = m.edges.filter("edge_type = 'validates'").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("validates_count"))
    kinds = m.nodes.filter("subtype in ('step', 'autostep')").select(F.col("id").alias("to_id"))
    steps = m.edges.filter("edge_type = 'composes'").join(kinds, "to_id", "left_semi").groupBy(F.col("from_id").alias("env")).agg(F.count("*").alias("step_count"))
    out = tests.join(val, "id", "left").join(steps, F.concat(tests.id, F.lit("@workflow")) == F.col("env"), "left")
    out = out.select("id", F.coalesce("validates_count", F.lit(0)).alias("validates_count"), F.coalesce("step_count", F.lit(0)).alias("step_count"))
    return out.withColumn("tier", F.when(F.col("step_count") > 0, "T3").when(F.col("validates_count") > 0, "T2").otherwise("T1"))


def display_filter(m: Mesh, hide_types: Collection[str] = (), hide_subtypes: Collection[str] = (), need_tags: Collection[str] = (), status: str | None = None, hide_private: bool = False, hide_tests: bool = False) -> DataFrame:
    """The composite filter of a list view: types, subtypes, all of the tags, the shown status (the own one unless it is
    VERIFIED, else that of the links), private names, test paths."""
    out = m.nodes
    if hide_types:
        out = out.filter(~F.col("node_type").isin(*hide_types))
    if hide_subtypes:
        out = out.filter(~F.coalesce("subtype", "node_type").isin(*hide_subtypes))
    if need_tags:
        per = m.tags.filter(F.col("tag").isin(*need_tags)).groupBy(F.col("node_id").alias("id")).agg(F.count_distinct("tag").alias("n")).filter(F.col("n") == len(set(need_tags)))
        out = out.join(per.select("id"), "id", "left_semi")
    if status is not None:
        out = out.filter(F.when(F.col("own_status") != "VERIFIED", F.col("own_status")).otherwise(F.col("link_status")) == status)
    if hide_private:
        out = out.filter(~fn.short_name("id").startswith("_"))
    if hide_tests:
        out = out.filter(~F.coalesce(F.array_contains(F.split("location", "/"), "tests"), F.lit(False)))
    return out


def capped(df: DataFrame, order: list[str], most: int, offset: int = 0) -> DataFrame:
    """At most `most` rows in order from offset on, each with truncated: whether there are more behind them."""
    some = df.orderBy(*order).offset(offset).limit(most + 1)
    n = some.agg((F.count("*") > most).alias("truncated"))
    return some.orderBy(*order).limit(most).crossJoin(F.broadcast(n))  # one row


def column_sort(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a column without regard to case, empty and null values first, equal ones by id."""
    c = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return df.orderBy(c.desc() if descending else c.asc(), "id")


def group_counts(m: Mesh, by: str) -> DataFrame:
    """grp, n: nodes counted by node_type, subtype, shown status, or first tag (by name); `(none)` for those without."""
    own = F.when(F.col("own_status") != "VERIFIED", F.col("own_status")).otherwise(F.col("link_status"))
    keys = {"node_type": F.col("node_type"), "subtype": F.coalesce("subtype", "node_type"), "status": own}
    if by == "tag":
        first = m.tags.groupBy(F.col("node_id").alias("id")).agg(F.min("tag").alias("grp"))
        rows = m.nodes.select("id").join(first, "id", "left")
    elif by in keys:
        rows = m.nodes.select(keys[by].alias("grp"))
    else:
        raise ValueError(f"unknown grouping: {by!r}")
    return rows.groupBy(F.coalesce("grp", F.lit("(none)")).alias("grp")).agg(F.count("*").alias("n"))


def workflow_filter(m: Mesh, has_steps: bool = False, critical: bool = False, linked: bool = False, modules: Collection[str] = ()) -> DataFrame:
    """id of envelopes with steps, with a step that is critical (its node tagged so, or its marker says so), with a function,
    of one of the modules; each if asked for."""
    out = envelopes(m).select("id", "step_count", F.get(F.split("id", "::"), 1).alias("module"))
    if has_steps:
        out = out.filter("step_count > 0")
    if critical:
        steps = m.nodes.filter("subtype in ('step', 'autostep')").select(F.col("id").alias("to_id"), F.coalesce(F.get_json_object("dflow_meta", "$.critical"), F.lit("")).alias("c"))
        tagged = m.tags.filter("tag = 'critical'").select(F.col("node_id").alias("to_id"), F.lit(True).alias("t")).distinct()
        crit = m.edges.filter("edge_type = 'composes'").join(steps, "to_id").join(tagged, "to_id", "left").filter("c <> '' or t").select(F.col("from_id").alias("id"))
        out = out.join(crit, "id", "left_semi")
    if linked:
        out = out.join(m.edges.filter("edge_type = 'annotates'").select(F.col("from_id").alias("id")), "id", "left_semi")
    if modules:
        out = out.filter(F.col("module").isin(*modules))
    return out.select("id")


def tests_filter(m: Mesh, tier: str | None = None, has_steps: bool = False, has_targets: bool = False, modules: Collection[str] = ()) -> DataFrame:
    """Rows of tests_dashboard: without tier T1 (`some`) or of one tier, with steps, with targets, of one of the modules."""
    out = tests_dashboard(m)
    if tier is not None:
        out = out.filter("tier <> 'T1'" if tier == "some" else F.col("tier") == tier)
    if has_steps:
        out = out.filter("step_count > 0")
    if has_targets:
        out = out.filter("validates_count > 0")
    return out.filter(F.get(F.split("id", "::"), 1).isin(*modules)) if modules else out


def filter_commits(commits: DataFrame, text: str | None = None, since: datetime | None = None) -> DataFrame:
    """Commits (sha, subject, body, at) that hold a text anywhere, without regard to case, and are no older than a time."""
    if text:
        commits = commits.filter(F.lower(F.concat_ws(" ", "sha", "subject", "body")).contains(text.lower()))
    return commits.filter(F.col("at") >= since) if since is not None else commits


def docs_of_file(m: Mesh, file_path: str) -> DataFrame:
    return m.docs.filter(F.col("file_path") == file_path).select("id")


def node_hashes(m: Mesh, ids: DataFrame) -> DataFrame:
    """id, code_hash, desc_hash of each id, null where there is no such node."""
    return ids.select("id").distinct().join(m.nodes.select("id", "code_hash", "desc_hash"), "id", "left")


def staleness_of(m: Mesh, ids: DataFrame) -> DataFrame:
    """id, status: struct(own_status, link_status)."""
    return m.nodes.join(ids.select("id"), "id", "left_semi").select("id", F.struct("own_status", "link_status").alias("status"))


def node_edges(m: Mesh, node_id: str) -> DataFrame:
    """Edges of a node with way: out or in; one from a node to itself is both."""
    out = m.edges.filter(F.col("from_id") == node_id).withColumn("way", F.lit("out"))
    return out.unionByName(m.edges.filter(F.col("to_id") == node_id).withColumn("way", F.lit("in")))


def scan_excluded(m: Mesh, dirs: Collection[str], prefixes: Collection[str] = ()) -> DataFrame:
    """id of nodes in an excluded folder or under a path of tests."""
    cond = F.arrays_overlap(F.split("location", "/"), F.array(*[F.lit(x) for x in dirs])) if dirs else F.lit(False)
    for p in prefixes:
        cond = cond | F.col("location").startswith(p)
    return m.nodes.filter(cond).select("id")


def without_tagged(m: Mesh, tag: str) -> DataFrame:
    return m.nodes.join(m.tags.filter(F.col("tag") == tag).select(F.col("node_id").alias("id")), "id", "left_anti")


def without_frozen(m: Mesh, tags: Collection[str]) -> DataFrame:
    """Nodes that are no sections of documents with one of the tags."""
    return m.nodes.join(sections_of_docs_with_tags(m, tags), "id", "left_anti")


def repeated_edges(edges: DataFrame) -> DataFrame:
    """id, n of the edges that were delivered more than once."""
    return edges.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def find_section(m: Mesh, doc_id: str, place: str) -> DataFrame:
    """The section at a dotted place (`a.b`) of a document."""
    return m.sections.filter(F.col("id") == f"{doc_id}::{place}")


def export_header(m: Mesh, project: str, version: str) -> DataFrame:
    """One row: what an export says of itself beside mutations.export_json."""
    n, e = m.nodes.agg(F.count("*").alias("nodes")), m.edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(e).select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(project).alias("project_id"), "nodes", "edges")).alias("document"))  # one row each
