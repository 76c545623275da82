"""Queries and SQL of documents: rendering and edits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import documents as dc
from .registry import registry

QUERIES, SQL, add = registry()
NOW = datetime(2025, 7, 1)


def _top(m):
    return m.sections.filter("depth = 0 and position = 0").select("id")


def _patches(m):
    return m.sections.select("id", F.when(F.col("depth") > 0, F.lit("$")).alias("anchor"), F.lit("the").alias("old_text"), F.lit("THE").alias("new_text"))


_NEW = "x AS (SELECT s.id AS from_id, s.doc_id AS to_id FROM s)"
add("fn30_render", dc.render, """p AS (SELECT doc_id, string_agg(repeat('#', greatest(2, least(6, depth + 2))) || ' ' || coalesce(heading, '') || CASE WHEN trim(coalesce(content, '')) <> '' THEN chr(10) || chr(10) || regexp_replace(trim(content), '\\[([^\\]]*)\\]\\(([^)]*::[^)]*)\\)', '\\1', 'g') ELSE '' END, chr(10) || chr(10) ORDER BY position) AS body FROM s GROUP BY 1)
SELECT d.id AS doc_id, concat_ws(chr(10) || chr(10), '# ' || coalesce(title, ''), body) AS markdown FROM d LEFT JOIN p ON p.doc_id = d.id""")  # fmt: skip
add("doc4_patch", lambda m: dc.patch_sections(m, _patches(m))[0].sections.select("id", "content"),
    "SELECT id, CASE WHEN depth > 0 THEN coalesce(content, '') || 'THE' WHEN len(string_split(coalesce(content, ''), 'the')) = 2 THEN replace(content, 'the', 'THE') ELSE content END AS content FROM s")
add("doc4_patch_results", lambda m: dc.patch_sections(m, _patches(m))[1], "SELECT id, CASE WHEN depth > 0 OR k = 2 THEN 'done' WHEN k > 2 THEN 'ambiguous' ELSE 'absent' END AS result FROM (SELECT id, depth, len(string_split(coalesce(content, ''), 'the')) AS k FROM s)")
add("doc6_delete_section", lambda m: dc.delete_sections(m, _top(m), NOW).sections.select("id"), "SELECT id FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.depth = 0 AND o.position = 0 AND (s.id = o.id OR starts_with(s.id, o.id || '.')))")
add("doc7_add_links", lambda m: dc.add_links(m, m.sections.select(F.col("id").alias("from_id"), F.col("doc_id").alias("to_id")), NOW)[0].edges.select("id"), f"{_NEW} SELECT id FROM e UNION SELECT from_id || '::documents::' || to_id FROM x")
add("doc8_delete_links", lambda m: dc.delete_links(m, m.edges.filter("edge_type = 'documents'").join(m.nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti"), NOW).history.filter("change_type = 'LINK_REMOVED'").groupBy("node_id").agg(F.count("*").alias("n")),
    "SELECT node_id, count(*) AS n FROM (SELECT node_id FROM h WHERE change_type = 'LINK_REMOVED' UNION ALL SELECT from_id FROM e WHERE edge_type = 'documents' AND to_id NOT IN (SELECT id FROM n)) GROUP BY 1")


def _raw(m, project=None):
    """The documents as JSON of their title and top sections, to be written anew, into another project if given."""
    top = m.sections.filter("depth = 0").select("doc_id", F.struct("position", F.struct(F.element_at(F.split("id", "::"), -1).alias("id"), "heading", F.upper("content").alias("content")).alias("s")).alias("x"))
    parts = top.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda y: y["s"]).alias("sections"))
    d = m.docs.select("id", "title").join(parts, F.col("id") == F.col("doc_id"), "left")
    name = F.get(F.split("id", "::"), 1)
    raw = F.to_json(F.struct("title", F.coalesce("sections", F.array().cast("array<struct<id:string,heading:string,content:string>>")).alias("sections")))
    return d.select((F.get(F.split("id", "::"), 0) if project is None else F.lit(project)).alias("project"), F.expr("substr(split(id, '::')[1], 6)").alias("slug"), raw.alias("raw"))


def _written(m, project=None):
    return dc.write_docs(m, _raw(m, project), NOW)


_H = "substr(sha256(heading || chr(10) || trim(regexp_replace(coalesce(upper(content), ''), '<[^>]+>', '', 'g'))), 1, 16)"
add("fn22_section_ids", lambda m: m.nodes.select("id", dc.section_parts("id").alias("p")).filter("p is not null").select("id", "p.project", "p.doc_path", "p.section", "p.doc_id"),
    "SELECT id, split_part(id, '::', 1) AS project, split_part(id, '::', 2) AS doc_path, split_part(id, '::', 3) AS section, split_part(id, '::', 1) || '::' || split_part(id, '::', 2) AS doc_id FROM n WHERE len(string_split(id, '::')) = 3")
add("doc1_write_docs", lambda m: _written(m, "w")[0].sections.filter("startswith(doc_id, 'w::')").select("id", "doc_id", "heading", "content", "depth", "position"),
    "SELECT 'w::' || split_part(id, '::', 2) || '::' || split_part(id, '::', 3) AS id, 'w::' || split_part(doc_id, '::', 2) AS doc_id, heading, upper(content) AS content, depth, row_number() OVER (PARTITION BY 'w::' || split_part(doc_id, '::', 2) ORDER BY position) - 1 AS position FROM s WHERE depth = 0")
add("doc1_write_report", lambda m: _written(m)[1], "SELECT d.id AS doc_id, NULL::VARCHAR AS error, count(s.id) AS sections, 0 AS links, 0 AS unknown FROM d LEFT JOIN s ON s.doc_id = d.id AND depth = 0 GROUP BY d.id")
add("doc2_rewritten_nodes", lambda m: _written(m)[0].nodes.select("id", "subtype", "code_hash", "own_status"),
    f"SELECT id, subtype, code_hash, own_status FROM n WHERE subtype IS DISTINCT FROM 'docjson' OR id NOT IN (SELECT id FROM s UNION SELECT id FROM d) UNION ALL SELECT id, 'docjson', {_H}, 'VERIFIED' FROM s WHERE depth = 0 UNION ALL SELECT id, 'docjson', substr(sha256(title), 1, 16), 'VERIFIED' FROM d")
add("doc2_auto_verified", lambda m: _written(m)[0].history.filter(F.col("scanned_at") == NOW).select("node_id", "change_type"),
    f"SELECT n.id AS node_id, 'AGENT_VERIFIED' AS change_type FROM n JOIN s USING (id) WHERE s.depth = 0 AND n.code_hash IS NOT NULL UNION ALL SELECT n.id, 'AGENT_VERIFIED' FROM n JOIN d USING (id) WHERE n.code_hash IS NOT NULL AND (n.code_hash <> substr(sha256(d.title), 1, 16) OR n.desc_hash IS DISTINCT FROM substr(sha256(d.title || chr(10)), 1, 16))")
add("doc12_cleaned_edges", lambda m: _written(m)[0].edges.select("id"),
    """g AS (SELECT id FROM s WHERE depth > 0), w AS (SELECT id FROM s UNION SELECT id FROM d) SELECT id FROM e WHERE from_id NOT IN (SELECT id FROM w) AND (to_id NOT IN (SELECT id FROM g) OR edge_type = 'documents') UNION SELECT doc_id || '::composes::' || id FROM s WHERE depth = 0""")  # fmt: skip
_CH = "depth = 0 AND position = 0"


def _updates(m):
    return m.sections.select("id", F.lit(None).cast("string").alias("heading"), F.when(F.col("depth") > 0, "new text").alias("content"), F.when((F.col("depth") == 0) & (F.col("position") == 0), "renamed").when(F.col("depth") == 0, "Not A Slug").alias("new_id"), F.lit(None).cast("string").alias("after"))


_REN = f"r AS (SELECT id AS o, regexp_replace(id, '[^.:]*$', 'renamed') AS w FROM s WHERE {_CH}), x AS (SELECT s.*, r.w, r.o FROM s LEFT JOIN r ON s.id = r.o OR starts_with(s.id, r.o || '.'))"
add("doc3_update_sections", lambda m: dc.update_sections(m, _updates(m), NOW)[0].sections.select("id", "content", "position"), f"{_REN} SELECT coalesce(w || substr(id, length(o) + 1), id) AS id, CASE WHEN depth > 0 THEN 'new text' ELSE content END AS content, position FROM x")
add("doc3_update_results", lambda m: dc.update_sections(m, _updates(m), NOW)[1], f"SELECT id, CASE WHEN depth > 0 OR ({_CH}) THEN 'done' ELSE 'bad_name' END AS result FROM s")
add("doc3_renamed_edges", lambda m: dc.update_sections(m, _updates(m), NOW)[0].edges.select("id"), f"{_REN}, y AS (SELECT id, coalesce(w || substr(id, length(o) + 1), id) AS nid FROM x) SELECT DISTINCT coalesce(a.nid, from_id) || '::' || edge_type || '::' || coalesce(b.nid, to_id) AS id FROM e LEFT JOIN y a ON a.id = from_id LEFT JOIN y b ON b.id = to_id")


def _additions(m):
    last = F.element_at(F.split("id", "::"), -1)
    under = m.sections.select("doc_id", F.lit("added").alias("section"), F.lit("Added").alias("heading"), F.lit("text").alias("content"), last.alias("parent"), F.lit(None).cast("string").alias("after"))
    top = m.docs.select(F.col("id").alias("doc_id"), F.lit("Bad Name").alias("section"), F.lit("x").alias("heading"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("after"))
    return under.unionByName(top)


add("doc5_add_sections", lambda m: dc.add_sections(m, _additions(m), NOW)[0].sections.select("id", "depth", "parent_id"), "SELECT id, depth, parent_id FROM s UNION ALL SELECT id || '.added', depth + 1, id FROM s WHERE depth < 2")
add("doc5_add_results", lambda m: dc.add_sections(m, _additions(m), NOW)[1], "SELECT id || '.added' AS id, CASE WHEN depth < 2 THEN 'done' ELSE 'too_deep' END AS result FROM s UNION ALL SELECT id || '::Bad Name', 'bad_name' FROM d")
add("doc10_update_docs", lambda m: dc.update_docs(m, m.docs.select(F.col("id").alias("doc_id"), F.when(F.array_contains("tags", "spec"), F.upper("title")).alias("title"), F.lit(None).cast("array<string>").alias("tags")), NOW)[0].docs.select("id", "title"), "SELECT id, CASE WHEN id IN (SELECT node_id FROM t WHERE tag = 'spec') THEN upper(title) ELSE title END AS title FROM d")


def _moves(m):
    return m.docs.select(F.col("id").alias("old_id"), F.concat(F.col("id"), F.lit("-moved")).alias("new_id"))


add("snk18_rename_docs", lambda m: dc.rename_docs(m, _moves(m)).history.select("id", "node_id"), "SELECT h.id, CASE WHEN d.id IS NOT NULL AND h.node_id IN (SELECT id FROM n) THEN d.id || '-moved' || substr(node_id, length(d.id) + 1) ELSE node_id END AS node_id FROM h LEFT JOIN d ON d.id = split_part(node_id, '::', 1) || '::' || split_part(node_id, '::', 2)")
add("snk19_move_docs", lambda m: dc.move_docs(m, _moves(m), NOW).sections.select("id", "doc_id", "parent_id"), "SELECT doc_id || '-moved' || substr(id, length(doc_id) + 1) AS id, doc_id || '-moved' AS doc_id, CASE WHEN parent_id IS NOT NULL THEN doc_id || '-moved' || substr(parent_id, length(doc_id) + 1) END AS parent_id FROM s")
add("doc13_renamed_docs", lambda m: dc.renamed_docs(m.docs, dc.move_docs(m, _moves(m).filter("length(old_id) % 2 = 0"), NOW).docs), "SELECT a.id AS old_id, b.id || '-moved' AS new_id FROM d a JOIN d b USING (file_path) WHERE length(b.id) % 2 = 0 UNION ALL SELECT a.id, b.id FROM d a JOIN d b USING (file_path) WHERE length(b.id) % 2 <> 0 AND a.id <> b.id")
add("jn22_doc_diff", lambda m: dc.doc_diff(m.sections, dc.update_sections(m, _updates(m), NOW)[0].sections).select("id", "change"),
    f"{_REN}, z AS (SELECT coalesce(w || substr(id, length(o) + 1), id) AS id, heading, CASE WHEN depth > 0 THEN 'new text' ELSE content END AS content FROM x) SELECT coalesce(s.id, z.id) AS id, CASE WHEN s.id IS NULL THEN 'added' WHEN z.id IS NULL THEN 'removed' WHEN s.heading IS NOT DISTINCT FROM z.heading AND s.content IS NOT DISTINCT FROM z.content THEN 'same' ELSE 'changed' END AS change FROM s FULL JOIN z ON z.id = s.id")
add("snk5_upsert_sections", lambda m: dc.upsert_sections(m, m.sections.filter("depth = 1").withColumn("heading", F.upper("heading"))).nodes.filter("subtype = 'docjson'").select("id", "level_1"), "SELECT n.id, CASE WHEN s.depth = 1 THEN upper(s.heading) ELSE level_1 END AS level_1 FROM n LEFT JOIN s USING (id) WHERE subtype = 'docjson'")
add("snk8_add_shadows", lambda m: dc.add_shadows(m.but(nodes=m.nodes.filter("subtype <> 'docjson'")), m.sections).nodes.filter("subtype = 'docjson'").select("id", "level_1", "level_2"), "SELECT id, heading AS level_1, content AS level_2 FROM s")
add("snk4_upsert_docs", lambda m: dc.upsert_docs(m, m.docs.withColumn("title", F.upper("title"))).docs.select("id", "title"), "SELECT id, upper(title) AS title FROM d")
add("sup1_list_docs", lambda m: m.docs.select("id", "title", "file_path").orderBy("id"), "SELECT id, title, file_path FROM d ORDER BY id")
add("sup3_outbound_targets", lambda m: m.edges.filter("edge_type = 'documents'").select("from_id", "to_id").distinct(), "SELECT DISTINCT from_id, to_id FROM e WHERE edge_type = 'documents'")
