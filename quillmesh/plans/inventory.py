"""Queries and SQL of lookups, filters, counts, sets and paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import SQL as MESH
from ..mesh import open_mesh
from ..operators import graph as gr
from ..operators import inventory as inv
from ..operators import mutations as mu
from ..operators.drift import EDGE_RULES
from ..runtime import table
from .registry import registry, us

QUERIES, SQL, add = registry()

PROJECT = "heron0"
NOW = datetime(2025, 7, 1)

add("flt1_get_node", lambda m: inv.with_tags(m.nodes.filter(F.col("id") == PROJECT), m.tags).select("id", "node_type", "title", "location", F.array_join("tags", ",").alias("tags")),
    f"SELECT id, node_type, title, location, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM t WHERE node_id = id), '') AS tags FROM n WHERE id = '{PROJECT}'")
add("flt2_query_nodes", lambda m: inv.query_nodes(m, "function", "spec").select("id", "title"), "SELECT id, title FROM n WHERE node_type = 'atomic_process' AND id IN (SELECT node_id FROM t WHERE tag = 'spec')")
add("flt3_all_nodes", lambda m: m.nodes.select("id", "node_type", "subtype", "title", "location", "status", "source", "code_hash", "desc_hash", "level_0", "level_1", "level_2", "level_3_location", "own_status", "link_status"),
    "SELECT id, node_type, subtype, title, location, status, source, code_hash, desc_hash, level_0, level_1, level_2, level_3_location, own_status, link_status FROM n")
add("flt4_all_edges", lambda m: m.edges.select("id", "edge_type", "from_id", "to_id", "weight", "via", "event"), "SELECT id, edge_type, from_id, to_id, weight, via, event FROM e")
add("flt5_list_children", lambda m: inv.list_nodes(m, tag="spec", parent_id=PROJECT).select("id"), f"SELECT id FROM n WHERE id IN (SELECT to_id FROM e WHERE edge_type = 'composes' AND from_id = '{PROJECT}')")
add("flt5_list_by_location", lambda m: inv.list_nodes(m, "module", location="tests/").select("id", "level_3_location"), "SELECT id, level_3_location FROM n WHERE node_type = 'composite_process' AND contains(level_3_location, 'tests/')")
add("flt8_node_hashes", lambda m: m.nodes.select("id", "code_hash", "desc_hash"), "SELECT id, code_hash, desc_hash FROM n")
add("flt10_verifications", lambda m: m.verification.select("node_id", "status", us("verified_at").alias("verified_us"), "verified_by", "code_hash_at", "desc_hash_at"), "SELECT node_id, status, epoch_us(verified_at) AS verified_us, verified_by, code_hash_at, desc_hash_at FROM v")
add("flt11_all_staleness", lambda m: m.nodes.select("id", "own_status", "link_status"), "SELECT id, own_status, link_status FROM n")
add("flt17_docs_of_file", lambda m: m.docs.filter(F.col("file_path").startswith(PROJECT + "/")).select("id", "file_path"), f"SELECT id, file_path FROM d WHERE starts_with(file_path, '{PROJECT}/')")
add("flt18_doc_sections", lambda m: m.sections.select("id", "doc_id", "heading", "depth", "parent_id", "position").orderBy("doc_id", "position"), "SELECT id, doc_id, heading, depth, parent_id, position FROM s ORDER BY doc_id, position")
add("flt19_long_sections", lambda m: inv.long_sections(m, 150), "SELECT id, doc_id, heading, length(content) AS n_chars FROM s WHERE length(content) > 150")
add("flt20_docs_with_tags", lambda m: inv.docs_with_tags(m, ["frozen", "spec"]), "SELECT DISTINCT id FROM d JOIN t ON t.node_id = d.id WHERE tag IN ('frozen', 'spec')")
add("flt21_section_doc_map", lambda m: inv.sections_of_docs_with_tags(m, ["frozen", "spec"]), "SELECT id, doc_id FROM s WHERE doc_id IN (SELECT d.id FROM d JOIN t ON t.node_id = d.id WHERE tag IN ('frozen', 'spec'))")
add("flt22_filter_history", lambda m: inv.filter_history(m.history, m, "BECAME_*", "*.[a-m]*", "atomic_process").select("id", "node_id", "change_type"),
    "SELECT id, node_id, change_type FROM h WHERE change_type GLOB 'BECAME_*' AND node_id GLOB '*.[a-m]*' AND node_id IN (SELECT id FROM n WHERE node_type = 'atomic_process')")
add("flt23_node_types", lambda m: m.nodes.select("id", "node_type"), "SELECT id, node_type FROM n")
_ENV = """st AS (SELECT e.from_id, count(*) FILTER (c.subtype IN ('step', 'autostep')) AS n_steps, count(*) FILTER (c.subtype = 'state') AS n_states FROM e JOIN n c ON c.id = e.to_id WHERE edge_type = 'composes' GROUP BY 1),
env AS (SELECT n.id, subtype, level_1, location, coalesce(CASE WHEN subtype = 'state_machine' THEN n_states ELSE n_steps END, 0) AS step_count, split_part(n.id, '::', 2) AS module FROM n LEFT JOIN st ON st.from_id = n.id WHERE subtype IN ('workflow', 'task', 'state_machine'))"""
add("flt24_workflow_list", lambda m: inv.envelopes(m, scope="production", has_steps=True), _ENV + " SELECT * EXCLUDE (module) FROM env WHERE NOT starts_with(module, 'tests.') AND step_count > 0")
add("agg28_workflow_steps", lambda m: inv.envelopes(m), _ENV + " SELECT * EXCLUDE (module) FROM env")
add("flt25_nodes_by_status", lambda m: m.nodes.filter((F.col("node_type") == "atomic_process") & (F.col("own_status") == "NOT_FOUND")).select("id"), "SELECT id FROM n WHERE node_type = 'atomic_process' AND own_status = 'NOT_FOUND'")
add("flt26_scan_excluded", lambda m: inv.scan_excluded(m, ["cache", "export"], ["tests/"]),
    "SELECT id FROM n WHERE list_has_any(string_split(location, '/'), ['cache', 'export']) OR starts_with(location, 'tests/')")
add("flt27_composite_filter", lambda m: inv.display_filter(m, ["entity"], ["state", "docjson"], ["spec"], None, True, True).select("id"),
    """SELECT id FROM n WHERE node_type <> 'entity' AND coalesce(subtype, node_type) NOT IN ('state', 'docjson') AND id IN (SELECT node_id FROM t WHERE tag = 'spec')
    AND NOT starts_with(regexp_replace(regexp_extract(list_last(string_split(id, '::')), '([^.]*)$', 1), '@(workflow|machine)$', ''), '_') AND NOT coalesce(list_contains(string_split(location, '/'), 'tests'), false)""")  # fmt: skip
add("flt27_by_shown_status", lambda m: inv.display_filter(m, status="LINKED_STALE").select("id"), "SELECT id FROM n WHERE CASE WHEN own_status <> 'VERIFIED' THEN own_status ELSE link_status END = 'LINKED_STALE'")
_TESTS = """ts AS (SELECT n.id, count(DISTINCT e.to_id) AS validates_count FROM n LEFT JOIN e ON e.from_id = n.id AND e.edge_type = 'validates' WHERE subtype = 'test' AND n.id NOT IN (SELECT node_id FROM t WHERE tag = 'test:fixture') GROUP BY 1),
sp AS (SELECT from_id, count(*) AS step_count FROM e JOIN n ON n.id = e.to_id WHERE edge_type = 'composes' AND subtype IN ('step', 'autostep') GROUP BY 1),
td AS (SELECT ts.id, validates_count, coalesce(step_count, 0) AS step_count, CASE WHEN step_count > 0 THEN 'T3' WHEN validates_count > 0 THEN 'T2' ELSE 'T1' END AS tier FROM ts LEFT JOIN sp ON sp.from_id = ts.id || '@workflow')"""
add("agg27_tests_dashboard", inv.tests_dashboard, _TESTS + " SELECT * FROM td")
add("flt28_tests_filter", lambda m: inv.tests_filter(m, "some"), _TESTS + " SELECT * FROM td WHERE tier <> 'T1'")
add("flt30_doc_tags_any", lambda m: m.docs.filter(F.arrays_overlap("tags", F.array(F.lit("consumer"), F.lit("legacy")))).select("id"), "SELECT DISTINCT d.id FROM d JOIN t ON t.node_id = d.id WHERE tag IN ('consumer', 'legacy')")
add("flt31_commit_filter", lambda m: inv.filter_commits(m.history.select(F.col("git_sha").alias("sha"), F.col("change_type").alias("subject"), F.col("meta").alias("body"), F.col("scanned_at").alias("at"), "id"), "AB", datetime(2024, 6, 1)).select("id"),
    "SELECT id FROM h WHERE contains(lower(concat_ws(' ', git_sha, change_type, meta)), 'ab') AND scanned_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00'")
add("flt29_workflow_filter", lambda m: inv.workflow_filter(m, has_steps=True, linked=True), _ENV + " SELECT id FROM env WHERE step_count > 0 AND id IN (SELECT from_id FROM e WHERE edge_type = 'annotates')")
add("flt28_tests_linked", lambda m: inv.tests_filter(m, "T2", has_targets=True), _TESTS + " SELECT * FROM td WHERE tier = 'T2' AND validates_count > 0")
for _by, _key in (("node_type", "node_type"), ("subtype", "coalesce(subtype, node_type)"), ("status", "CASE WHEN own_status <> 'VERIFIED' THEN own_status ELSE link_status END"), ("tag", "(SELECT min(tag) FROM t WHERE node_id = id)")):
    add(f"agg29_groups_by_{_by}", lambda m, by=_by: inv.group_counts(m, by), f"SELECT coalesce({_key}, '(none)') AS grp, count(*) AS n FROM n GROUP BY 1")
add("srt8_capped", lambda m: inv.capped(m.nodes.select("id"), ["id"], 30), "SELECT id, (SELECT count(*) FROM n) > 30 AS truncated FROM n ORDER BY id LIMIT 30")
add("srt13_column_sort", lambda m: inv.column_sort(m.nodes.select("id", "title"), "title", True).limit(50), "SELECT id, title FROM n ORDER BY lower(coalesce(title, '')) DESC, id LIMIT 50")
add("srt9_char_budget_whole", lambda m: inv.within_budget(m.sections.select("id", "content"), "id", "content", 6000).select("id", "kept"), "SELECT id, sum(length(coalesce(content, ''))) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) <= 6000 AS kept FROM s")
add("sup23_status_pairs", lambda m: inv.staleness_of(m, m.nodes).select("id", "status.own_status", "status.link_status"), "SELECT id, own_status, link_status FROM n")
add("flt8_hashes_of", lambda m: inv.node_hashes(m, m.edges.select(F.col("to_id").alias("id"))), "SELECT x.id, code_hash, desc_hash FROM (SELECT DISTINCT to_id AS id FROM e) x LEFT JOIN n USING (id)")
add("gr15_find_sections", lambda m: m.sections.join(m.docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.substring_index("id", "::", -1).alias("place"), "doc_id", "id"), "SELECT list_last(string_split(id, '::')) AS place, doc_id, id FROM s WHERE doc_id IN (SELECT id FROM d)")
add("fn25_steps_json", lambda m: m.nodes.filter("level_steps is not null").select("id", F.to_json(fn.json_to_steps(fn.steps_to_json("level_steps"))).eqNullSafe(fn.steps_to_json("level_steps")).alias("same"), F.size(fn.json_to_steps(fn.steps_to_json("level_steps"))).alias("n")), "SELECT id, true AS same, CAST(len(level_steps) AS INTEGER) AS n FROM n WHERE level_steps IS NOT NULL")
add("snk21_export_documents", lambda m: mu.export_json(m).select("kind", F.get_json_object("document", "$.id").alias("id"), F.coalesce(F.get_json_object("document", "$.title"), F.get_json_object("document", "$.from_id")).alias("what")), "SELECT 'node' AS kind, id, title AS what FROM n UNION ALL SELECT 'edge', id, from_id FROM e")
add("snk10_set_statuses", lambda m: mu.set_statuses(m, m.nodes.filter("subtype = 'test'").select("id", F.lit("NOT_FOUND").alias("own_status"), F.lit(None).cast("string").alias("link_status"))).nodes.select("id", "own_status", "link_status"), "SELECT id, CASE WHEN subtype = 'test' THEN 'NOT_FOUND' ELSE own_status END AS own_status, link_status FROM n")
add("stl13_mark_clean_report", lambda m: mu.mark_clean_report(m, m.edges.select(F.col("to_id").alias("id"))), "SELECT DISTINCT to_id AS id, CASE WHEN to_id IN (SELECT id FROM n) THEN 'marked' ELSE 'not_found' END AS result FROM e")
_RULES = "r(edge_type, ft, tt) AS (VALUES " + ", ".join(str(x) for x in EDGE_RULES) + ")"
add("api4_add_edges", lambda m: mu.add_edges(m, m.edges.filter("edge_type in ('composes', 'depends_on')").select(F.col("to_id").alias("from_id"), F.lit("consumes").alias("edge_type"), F.col("from_id").alias("to_id")), NOW)[1],
    f"{_RULES}, w AS (SELECT DISTINCT to_id AS from_id, 'consumes' AS edge_type, from_id AS to_id FROM e WHERE edge_type IN ('composes', 'depends_on')) SELECT w.*, CASE WHEN a.id IS NULL THEN 'no_start' WHEN b.id IS NULL THEN 'no_end' WHEN NOT EXISTS (SELECT 1 FROM r WHERE r.edge_type = w.edge_type AND ft = a.node_type AND tt = b.node_type) THEN 'not_allowed' ELSE 'added' END AS result FROM w LEFT JOIN n a ON a.id = w.from_id LEFT JOIN n b ON b.id = w.to_id")
_DOC = "sable5::docs.manifest_reset0"
_DEL = f"g AS (SELECT id FROM n WHERE id = '{_DOC}' OR starts_with(id, '{_DOC}::'))"
add("snk14_delete_doc", lambda m: mu.delete_doc(m, _DOC, NOW).edges.select("id"), f"{_DEL} SELECT id FROM e WHERE NOT ((from_id IN (SELECT id FROM g) OR to_id IN (SELECT id FROM g)) AND NOT (edge_type = 'documents' AND to_id IN (SELECT id FROM g) AND from_id NOT IN (SELECT id FROM g)))")
add("doc9_delete_doc_nodes", lambda m: mu.delete_doc(m, _DOC, NOW).nodes.select("id"), f"{_DEL} SELECT id FROM n WHERE id NOT IN (SELECT id FROM g)")
_LINKED = "heron0::shape.docs.plan.token_render3"
add("gr2_fetch_graph", lambda m: gr.fetch_graph(m, PROJECT, "out", 2, 15, 5).select("id", "hop", "total", "truncated"),
    f"f AS (SELECT '{PROJECT}' AS at, 0 AS level UNION SELECT to_id, level + 1 FROM f JOIN e ON e.from_id = f.at WHERE level < 1), k AS (SELECT e.id, min(level) + 1 AS hop FROM e JOIN f ON f.at = e.from_id GROUP BY 1) SELECT id, hop, (SELECT count(*) FROM k) AS total, (SELECT count(*) FROM k) > 20 AS truncated FROM k ORDER BY hop, id LIMIT 15 OFFSET 5", True)


def _sql_query(spark: SparkSession, d: str) -> DataFrame:
    return inv.run_sql(spark, open_mesh(spark, d), "SELECT subtype, count(*) AS n FROM nodes GROUP BY subtype ORDER BY n DESC, subtype")


QUERIES["flt32_run_sql"] = _sql_query
SQL["flt32_run_sql"] = f"WITH {MESH} SELECT coalesce(subtype, 'NULL') AS subtype, CAST(count(*) AS VARCHAR) AS n FROM n GROUP BY n.subtype"

add("agg1_list_tags", inv.tag_counts, "SELECT tag, count(*) AS n FROM t GROUP BY 1")
add("agg2_sections_any_tag", lambda m: inv.sections_by_tags(m, ["spec", "frozen"]), "SELECT s.id, doc_id, heading, count(DISTINCT tag) AS n_tags FROM s JOIN t ON t.node_id = s.id WHERE tag IN ('spec', 'frozen') GROUP BY ALL")
add("agg2_sections_all_tags", lambda m: inv.sections_by_tags(m, ["legacy", "frozen"], True), "SELECT s.id, doc_id, heading, count(DISTINCT tag) AS n_tags FROM s JOIN t ON t.node_id = s.id WHERE tag IN ('legacy', 'frozen') GROUP BY ALL HAVING count(DISTINCT tag) >= 2")
add("agg3_file_mtimes", inv.file_mtimes, "SELECT location, max(file_mtime) AS file_mtime FROM n WHERE file_mtime IS NOT NULL GROUP BY 1")
add("agg8_doc_paths", lambda m: m.docs.select("file_path").distinct(), "SELECT DISTINCT file_path FROM d")
add("agg9_locations", lambda m: m.nodes.select("location").distinct(), "SELECT DISTINCT location FROM n")


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return inv.meta(open_mesh(spark, d), table(spark, d, "embedding_hashes"))


QUERIES["agg22_meta"] = _meta
SQL["agg22_meta"] = f"""WITH {MESH}, x AS (SELECT count(*) AS c FROM n WHERE id IN (SELECT node_id FROM embedding_hashes))
SELECT count(*) AS n_nodes, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses, (SELECT count(*) FROM e) AS n_edges, (SELECT string_agg(DISTINCT edge_type, ',' ORDER BY edge_type) FROM e) AS edge_types,
(SELECT string_agg(DISTINCT tag, ',' ORDER BY tag) FROM t) AS tags, any_value(x.c) AS n_embedded, round(any_value(x.c) / greatest(count(*), 1), 4) AS coverage FROM n, x"""
add("agg22_types", inv.type_counts, "SELECT node_type, count(*) AS n FROM n GROUP BY 1")
add("agg23_own_counts", lambda m: m.nodes.groupBy("own_status").agg(F.count("*").alias("n")), "SELECT own_status, count(*) AS n FROM n GROUP BY 1")
add("agg24_docs", lambda m: m.docs.join(m.sections.groupBy("doc_id").agg(F.count("*").alias("c")), F.col("id") == F.col("doc_id"), "left").select("id", "title", "file_path", F.coalesce("c", F.lit(0)).alias("section_count")),
    "SELECT d.id, title, file_path, count(s.id) AS section_count FROM d LEFT JOIN s ON s.doc_id = d.id GROUP BY ALL")
add("agg25_docs_and_sections", lambda m: m.sections.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "heading"))), lambda x: x["heading"]), " | ").alias("headings")),
    "SELECT doc_id, count(*) AS n, string_agg(heading, ' | ' ORDER BY position) AS headings FROM s GROUP BY 1")
add("agg29_location_rollup", inv.location_rollup, "SELECT array_to_string(p[1:i], '/') AS prefix, count(*) AS n FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT list_filter(string_split(location, '/'), lambda x: x <> '') AS p FROM n)) GROUP BY 1")
add("agg30_doc_tag_counts", lambda m: m.docs.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")), "SELECT tag, count(*) AS n FROM t WHERE node_id IN (SELECT id FROM d) GROUP BY 1")
add("agg32_doc_toc", lambda m: m.sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum(F.length(F.coalesce("content", F.lit("")))).alias("n_chars")), "SELECT doc_id, count(*) AS n_sections, CAST(sum(length(coalesce(content, ''))) AS BIGINT) AS n_chars FROM s GROUP BY 1")
add("srt1_page", lambda m: inv.page(m.nodes.select("id"), ["id"], 2, 25), "SELECT id, (SELECT count(*) FROM n) AS total FROM n ORDER BY id LIMIT 25 OFFSET 50")
add("srt7_edge_page", lambda m: inv.page(m.edges.select("id"), ["id"], 1, 40), "SELECT id, (SELECT count(*) FROM e) AS total FROM e ORDER BY id LIMIT 40 OFFSET 40")
add("srt9_char_budget", lambda m: inv.within_budget(m.sections.select("id", "doc_id", "content"), "id", "content", 600, "doc_id").select("id", "kept"),
    "SELECT id, sum(length(coalesce(content, ''))) OVER (PARTITION BY doc_id ORDER BY id ROWS UNBOUNDED PRECEDING) <= 600 AS kept FROM s")
QUERIES["set8_edge_dedupe"] = lambda spark, d: inv.repeated_edges(table(spark, d, "edges"))
SQL["set8_edge_dedupe"] = "SELECT id, count(*) AS n FROM edges GROUP BY 1 HAVING count(*) > 1"
add("set10_frozen_exclusion", lambda m: inv.without_frozen(m, ["frozen"]).select("id"), "SELECT id FROM n WHERE id NOT IN (SELECT s.id FROM s JOIN t ON t.node_id = s.doc_id WHERE tag = 'frozen')")
add("set11_exclude_fixtures", lambda m: inv.without_tagged(m, "test:fixture").select("id"), "SELECT id FROM n WHERE id NOT IN (SELECT node_id FROM t WHERE tag = 'test:fixture')")
add("sup21_tags_bulk", lambda m: inv.with_tags(m.nodes.select("id"), m.tags).select("id", F.array_join("tags", ",").alias("tags")), "SELECT id, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM t WHERE node_id = id), '') AS tags FROM n")
add("fn_scalars", lambda m: m.nodes.select("id", fn.hash16("id").alias("hash16"), fn.slug("title").alias("slug"), fn.location_prefix("location").alias("prefix"), fn.level3("level_3_location").getField("line_start").alias("line_start"),
    fn.level3("level_3_location").getField("line_end").alias("line_end"), fn.short_name("id").alias("short_name"), fn.embedding_hash("level_1", "level_2").alias("embedding_hash"), fn.camel_to_snake(fn.short_name("id")).alias("snake"), fn.dotted("location").alias("dotted")),
    """SELECT id, substr(sha256(id), 1, 16) AS hash16, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
    CASE WHEN len(p) = 0 THEN '(no-location)' ELSE array_to_string(p[1:2], '/') END AS prefix, try_cast(nullif(regexp_extract(level_3_location, '#L(\\d+)', 1), '') AS INTEGER) AS line_start,
    coalesce(try_cast(nullif(regexp_extract(level_3_location, '#L\\d+-L?(\\d+)', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(level_3_location, '#L(\\d+)', 1), '') AS INTEGER)) AS line_end,
    sn AS short_name, substr(sha256(coalesce(level_1, '') || chr(10) || coalesce(level_2, '')), 1, 16) AS embedding_hash, lower(regexp_replace(sn, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake,
    replace(regexp_replace(regexp_replace(location, '\\.[A-Za-z]+$', ''), '/(__init__|index)$', ''), '/', '.') AS dotted
    FROM (SELECT *, list_filter(string_split(replace(coalesce(location, ''), chr(92), '/'), '/'), lambda x: x <> '') AS p, regexp_replace(regexp_extract(list_last(string_split(id, '::')), '([^.]*)$', 1), '@(workflow|machine)$', '') AS sn FROM n)""")  # fmt: skip
