"""Queries and SQL of workflows, findings and rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import SQL as MESH
from ..mesh import open_mesh
from ..operators import render as rd
from ..operators import validation as va
from ..operators import workflows as wf
from ..runtime import table
from .registry import registry

QUERIES, SQL, add = registry()

_NO = "regexp_extract(e.to_id, '::step-([0-9.]+)$', 1)"
_LINE = "try_cast(nullif(regexp_extract({}, '#L(\\d+)', 1), '') AS INTEGER)"
_SHORT = "regexp_replace(regexp_extract(list_last(string_split({}, '::')), '([^.]*)$', 1), '@(workflow|machine)$', '')"
_STEPS = "k AS (SELECT e.from_id AS env, n.* EXCLUDE (id), n.id AS step, " + _NO + " AS no FROM e JOIN n ON n.id = e.to_id WHERE edge_type = 'composes' AND subtype IN ('step', 'autostep'))"
_TO = "g AS (SELECT from_id AS step, min(to_id) AS target FROM e WHERE edge_type = 'delegates_to' GROUP BY 1)"

add("src4_level_steps", lambda m: wf.level_steps(m.nodes), "x AS (SELECT id, unnest(list_transform(list_sort(list_transform(level_steps, lambda s: struct_pack(k := coalesce(s.step_num, 0), s := s))), lambda y: y.s)) AS s, unnest(range(len(level_steps)))::INTEGER AS pos FROM n WHERE level_steps IS NOT NULL) SELECT id, pos, s.step_num, s.name, s.purpose, s.inputs, s.outputs, s.critical FROM x")
add("srt11_ordered_steps", wf.ordered_steps, f"{_STEPS} SELECT env, step, row_number() OVER (PARTITION BY env ORDER BY coalesce(try_cast(no AS DOUBLE), 0), step) AS place FROM k")
add("sup28_step_rows", wf.step_rows,
    f"""{_STEPS}, {_TO} SELECT k.env, k.step, k.no AS step_number, k.level_1 AS name, k.level_2 AS purpose, k.subtype = 'autostep' AS is_auto, {_LINE.format('k.level_3_location')} AS line, g.target,
    {_SHORT.format('n.id')} AS target_name, n.location AS target_location, {_LINE.format('n.level_3_location')} AS target_line FROM k LEFT JOIN g ON g.step = k.step LEFT JOIN n ON n.id = g.target""")  # fmt: skip
_ITEMS = f"""c AS (SELECT e.from_id AS id, count(*) FILTER (x.subtype IN ('step', 'autostep')) AS a, count(*) FILTER (x.subtype = 'state') AS b FROM e JOIN n x ON x.id = e.to_id WHERE edge_type = 'composes' GROUP BY 1),
f AS (SELECT from_id AS id, min(to_id) AS function FROM e WHERE edge_type = 'annotates' GROUP BY 1)
SELECT n.id, subtype, split_part(n.id, '::', 2) AS module_name, location, coalesce({_LINE.format('level_3_location')}, 1) AS line, coalesce(CASE WHEN subtype = 'state_machine' THEN b ELSE a END, 0) AS step_count, function
FROM n LEFT JOIN c USING (id) LEFT JOIN f USING (id) WHERE node_type = 'composite_process' AND """
add("jn15_envelopes_by_subtype", lambda m: wf.envelope_items(m, "task", None), _ITEMS + "subtype = 'task'")
add("sup27_tagged_envelopes", lambda m: wf.envelope_items(m, None, "spec"), _ITEMS + "subtype IN ('workflow', 'task', 'state_machine') AND n.id IN (SELECT node_id FROM t WHERE tag = 'spec')")
add("gr13_resolve_envelopes", lambda m: wf.resolve_envelopes(m, m.nodes.filter("subtype <> 'external_package'").select(F.col("id").alias("key")).union(m.nodes.select(fn.short_name("id")))),
    f"""env AS (SELECT id FROM n WHERE node_type = 'composite_process' AND subtype IN ('workflow', 'task', 'state_machine')), keys AS (SELECT id AS key FROM n WHERE subtype <> 'external_package' UNION SELECT {_SHORT.format('id')} FROM n),
    a AS (SELECT to_id AS key, min(from_id) AS v FROM e WHERE edge_type = 'annotates' AND from_id IN (SELECT id FROM n) GROUP BY 1), b AS (SELECT {_SHORT.format('id')} AS key, min(id) AS v FROM env GROUP BY 1)
    SELECT key, coalesce(env.id, a.v, b.v) AS envelope, CASE WHEN env.id IS NOT NULL THEN 'id' WHEN a.v IS NOT NULL THEN 'function' WHEN b.v IS NOT NULL THEN 'name' END AS how FROM keys LEFT JOIN env ON env.id = key LEFT JOIN a USING (key) LEFT JOIN b USING (key)""")  # fmt: skip
add("gr11_workflow_details", wf.workflow_details,
    f"""{_TO}, a AS (SELECT to_id AS target, min(from_id) AS "inner" FROM e WHERE edge_type = 'annotates' GROUP BY 1), {_STEPS}, o AS (SELECT k.env, k.step, k.no, k.subtype, k.level_1, k.level_2, target, "inner" FROM k LEFT JOIN g ON g.step = k.step LEFT JOIN a USING (target)),
    x AS (SELECT n.id AS root, no AS path, o.*, [n.id] AS seen, coalesce("inner" = n.id, false) AS cyclic FROM n JOIN o ON o.env = n.id WHERE n.subtype = 'workflow'
      UNION ALL SELECT x.root, x.path || '.' || o.no, o.*, list_append(x.seen, x."inner"), coalesce(list_contains(list_append(x.seen, x."inner"), o."inner"), false) FROM x JOIN o ON o.env = x."inner" WHERE NOT x.cyclic)
    SELECT root, path, step, level_1 AS name, coalesce(level_2, '') AS purpose, subtype = 'autostep' AS is_auto, target AS delegates_to, CASE WHEN cyclic THEN 'cycle detected at ' || "inner" WHEN subtype = 'autostep' AND target IS NOT NULL AND "inner" IS NULL THEN 'target not annotated' END AS note FROM x""", True)  # fmt: skip
add("gr12_machine_states", wf.machine_states,
    """x AS (SELECT *, regexp_extract(id, '^(.*@machine)\\.states\\.', 1) AS machine FROM n WHERE subtype = 'state'), y AS (SELECT from_id AS id, count(*) AS c, string_agg(coalesce(event, '') || '>' || to_id, '|' ORDER BY coalesce(event, '') || '>' || to_id) AS mv FROM e WHERE edge_type = 'delegates_to' AND via IS NOT NULL GROUP BY 1)
    SELECT machine, x.id AS state, substr(x.id, length(machine) + 9) AS path, node_type = 'composite_process' AS is_compound, x.id IN (SELECT node_id FROM t WHERE tag = 'final') AS is_terminal, coalesce(c, 0) AS n_transitions, coalesce(mv, '') AS transitions FROM x LEFT JOIN y USING (id) WHERE machine <> ''""")  # fmt: skip
_PARAMS = "list_filter(list_transform(string_split(regexp_extract(coalesce(level_1, ''), '\\(([^)]*)\\)', 1), ','), lambda x: trim(regexp_extract(x, '^([^:=]*)', 1))), lambda x: x <> '' AND NOT list_contains(" + str(list(wf.BUILTIN_FIXTURES)) + ", x))"
add("sup25_fixture_names", lambda m: m.nodes.filter("subtype = 'test'").select("id", F.array_join(wf.fixture_names("level_1"), ",").alias("names")), f"SELECT id, array_to_string({_PARAMS}, ',') AS names FROM n WHERE subtype = 'test'")
add("sup26_test_stems", lambda m: m.nodes.select("id", wf.test_stem(F.get(F.split("id", "::"), 1)).alias("stem")), "SELECT id, coalesce(list_last(list_filter(string_split(split_part(id, '::', 2), '.'), lambda x: starts_with(x, 'test_'))), list_last(string_split(split_part(id, '::', 2), '.'))) AS stem FROM n WHERE contains(id, '::') UNION ALL SELECT id, NULL FROM n WHERE NOT contains(id, '::')")


def _fixtures(m):
    """Functions count as fixtures under the first letters of their names, and tests ask for those of their own, so that there are some."""
    short = F.concat(F.lit("f"), F.substring(F.regexp_replace(fn.short_name("id"), "^test_", ""), 1, 4))
    made = m.nodes.filter("subtype = 'function'").withColumn("id", F.concat("id", F.lit("."), short))
    tests = m.nodes.filter("subtype = 'test'").withColumn("level_1", F.concat(F.lit("t(self, "), short, F.lit(": int = 3)")))
    return wf.test_fixtures(m.but(nodes=made.unionByName(tests), tags=made.select(F.col("id").alias("node_id"), F.lit("test:fixture").alias("tag"))))


add("jn20_test_fixtures", _fixtures,
    f"""x AS (SELECT id, subtype, 'f' || substr(regexp_replace({_SHORT.format('id')}, '^test_', ''), 1, 4) AS name FROM n WHERE subtype IN ('function', 'test')), y AS (SELECT name, min(id || '.' || name) AS fixture FROM x WHERE subtype = 'function' GROUP BY 1)
    SELECT id AS test, fixture FROM x JOIN y USING (name) WHERE subtype = 'test'""")  # fmt: skip

_CALLS = "q AS (SELECT n.id AS function, unnest(level_steps) AS s, unnest(range(len(level_steps)))::INTEGER AS pos, id LIKE '%.cache%' AS auto FROM n WHERE level_steps IS NOT NULL), p AS (SELECT function, pos, s.step_num AS no, CASE WHEN pos = 1 THEN ' ' ELSE s.name END AS name, s.purpose AS purpose, auto FROM q)"


def _calls(m):
    """The steps that texts mark, with the faults there are in the data and blank second names; functions of caches mark automatic ones."""
    rows = m.nodes.filter("level_steps is not null").select(F.col("id").alias("function"), F.posexplode("level_steps").alias("pos", "s"))
    return rows.select("function", "pos", F.col("s.step_num").alias("step_num"), F.when(F.col("pos") == 1, " ").otherwise(F.col("s.name")).alias("name"), F.col("s.purpose").alias("purpose"), F.col("function").like("%.cache%").alias("is_auto"), F.lit(False).alias("in_loop"))


add("stl29_step_findings", lambda m: va.step_findings(_calls(m).withColumn("step_num", F.when(F.col("pos") == 2, F.lit(1.0)).otherwise(F.col("step_num")))),
    f"""{_CALLS}, r AS (SELECT * REPLACE (CASE WHEN pos = 2 THEN 1.0 ELSE no END AS no) FROM p), u AS (
    SELECT function, 'A1' AS rule, coalesce(CAST(no AS VARCHAR), 'none') AS detail FROM r WHERE no IS NULL OR no <= 0
    UNION ALL SELECT function, 'A2', CAST(no AS VARCHAR) FROM r WHERE no > 0 AND NOT auto AND (coalesce(trim(name), '') = '' OR coalesce(trim(purpose), '') = '')
    UNION ALL SELECT function, 'A3', CAST(no AS VARCHAR) FROM r WHERE no > 0 AND auto AND trim(name) = ''
    UNION ALL SELECT function, 'B3', CAST(no AS VARCHAR) FROM r WHERE no % 1 <> 0
    UNION ALL SELECT function, 'B1', CAST(no AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY function, no ORDER BY pos) AS rn FROM r WHERE no IS NOT NULL) WHERE rn > 1
    UNION ALL SELECT function, 'B2', array_to_string(list_filter(range(1, mx + 1), lambda i: NOT list_contains(have, i)), ',') FROM (SELECT function, list(DISTINCT CAST(floor(no) AS BIGINT)) AS have, max(CAST(floor(no) AS BIGINT)) AS mx FROM r WHERE floor(no) > 0 GROUP BY 1) WHERE len(have) < mx)
    SELECT * FROM u""")  # fmt: skip
add("win13_step_gaps", lambda m: va.step_findings(_calls(m).filter("pos <> 1")).filter("rule = 'B2'"),
    f"{_CALLS}, h2 AS (SELECT function, list(DISTINCT CAST(floor(no) AS BIGINT)) AS have, max(CAST(floor(no) AS BIGINT)) AS mx FROM p WHERE floor(no) > 0 AND pos <> 1 GROUP BY 1) SELECT function, 'B2' AS rule, array_to_string(list_filter(range(1, mx + 1), lambda i: NOT list_contains(have, i)), ',') AS detail FROM h2 WHERE len(have) < mx")
add("win12_repeated_steps", lambda m: va.step_findings(_calls(m).withColumn("step_num", F.ceil(F.col("step_num") / 2).cast("double"))).filter("rule = 'B1'"),
    f"{_CALLS}, z AS (SELECT function, ceil(no / 2) AS no, pos FROM p) SELECT function, 'B1' AS rule, CAST(no AS VARCHAR) AS detail FROM (SELECT *, row_number() OVER (PARTITION BY function, no ORDER BY pos) AS rn FROM z WHERE no IS NOT NULL) WHERE rn > 1")


def _autosteps(m):
    auto = m.nodes.filter("subtype = 'autostep'").select(F.col("id").alias("step"))
    to = m.edges.filter("edge_type = 'delegates_to'").groupBy(F.col("from_id").alias("step")).agg(F.min("to_id").alias("target"))
    return auto.join(to, "step", "left")


add("stl30_autostep_findings", lambda m: va.autostep_findings(_autosteps(m), m.edges.filter("edge_type = 'annotates'").select(F.col("to_id").alias("function"))),
    f"{_TO}, y AS (SELECT id AS function, CASE WHEN target IS NULL THEN 'unresolved' WHEN target NOT IN (SELECT to_id FROM e WHERE edge_type = 'annotates') THEN 'undecorated: ' || target END AS detail FROM n LEFT JOIN g ON g.step = n.id WHERE subtype = 'autostep') SELECT function, 'B4' AS rule, detail FROM y WHERE detail IS NOT NULL")
add("stl29_envelope_findings", lambda m: va.envelope_findings(m.nodes.filter("subtype in ('workflow', 'task')").select("id", F.col("level_2").alias("purpose"))), "SELECT id AS function, 'C1' AS rule, '' AS detail FROM n WHERE subtype IN ('workflow', 'task') AND coalesce(trim(level_2), '') = ''")
add("sup33_nav_findings", lambda m: va.nav_findings(m.sections.select(F.col("id").alias("path"), F.when(F.col("depth") > 0, F.col("id")).otherwise(F.col("doc_id")).alias("doc_id")), m.docs), "SELECT id AS path, id AS doc_id FROM s WHERE depth > 0")

_MARK = "CASE WHEN own_status <> 'VERIFIED' OR link_status <> 'VERIFIED' THEN '  [' || array_to_string(list_filter([own_status, link_status], lambda x: x <> 'VERIFIED'), '+') || ']' ELSE '' END"
add("sup20_render_level_0", lambda m: rd.render_nodes(m.nodes, 0), "SELECT id, id AS text FROM n")
add("fn32_render_level_1", lambda m: rd.render_nodes(m.nodes, 1, True), f"SELECT id, rpad(id, CAST((SELECT max(length(id)) FROM n) AS INTEGER), ' ') || '  ' || coalesce(level_1, '') || CASE WHEN contains(level_3_location, '#L') THEN '  @ ' || level_3_location ELSE '' END || {_MARK} AS text FROM n")
add("fn33_render_level_2", lambda m: rd.render_nodes(m.nodes, 2, True), f"SELECT id, '=== ' || id || ' ===' || {_MARK} || chr(10) || '  ' || coalesce(level_1, '') || chr(10) || CASE WHEN coalesce(level_2, '') <> '' THEN '  ' || replace(level_2, chr(10), chr(10) || '  ') ELSE '  (no detail)' END || CASE WHEN coalesce(level_3_location, '') <> '' THEN chr(10) || '  @ ' || level_3_location ELSE '' END AS text FROM n")
add("fn34_render_steps", lambda m: rd.render_nodes(m.nodes, 3),
    """z AS (SELECT id, list_transform(level_steps, lambda s: '  [' || regexp_replace(CAST(s.step_num AS VARCHAR), '\\.0$', '') || '] ' || coalesce(s.name, '') || chr(10) || '       purpose : ' || coalesce(s.purpose, '')
      || CASE WHEN coalesce(s.inputs, '') <> '' THEN chr(10) || '       inputs  : ' || s.inputs ELSE '' END || CASE WHEN coalesce(s.outputs, '') <> '' THEN chr(10) || '       outputs : ' || s.outputs ELSE '' END || CASE WHEN coalesce(s.critical, '') <> '' THEN chr(10) || '       CRITICAL: ' || s.critical ELSE '' END) AS l FROM n WHERE len(level_steps) > 0)
    SELECT id, '=== ' || id || ' ===' || chr(10) || array_to_string(l, chr(10)) AS text FROM z""")  # fmt: skip
add("srt2_render_page", lambda m: rd.render_page(m, 1, "entity", 20, 20, True)[1], f"w AS (SELECT * FROM n WHERE node_type = 'entity' ORDER BY id LIMIT 20 OFFSET 20) SELECT id, rpad(id, CAST((SELECT max(length(id)) FROM w) AS INTEGER), ' ') || '  ' || coalesce(level_1, '') || CASE WHEN contains(level_3_location, '#L') THEN '  @ ' || level_3_location ELSE '' END || {_MARK} AS text FROM w")
_AGENT = """lk AS (SELECT e.from_id AS id, string_agg('- `' || e.to_id || '`' || CASE WHEN coalesce(n.level_1, '') <> '' THEN ' — ' || n.level_1 ELSE '' END || CASE WHEN contains(n.level_3_location, '#L') THEN '  @ ' || n.level_3_location ELSE '' END, chr(10) ORDER BY e.to_id) AS links FROM e JOIN s ON s.id = e.from_id LEFT JOIN n ON n.id = e.to_id WHERE edge_type = 'documents' AND e.to_id <> s.doc_id GROUP BY 1),
ag AS (SELECT doc_id, string_agg(repeat('#', greatest(2, least(6, depth + 2))) || ' ' || coalesce(heading, '') || '  <!-- id: ' || s.id || ' -->' || chr(10) || CASE WHEN coalesce(content, '') <> '' THEN chr(10) || content || chr(10) ELSE '' END || CASE WHEN links IS NOT NULL THEN chr(10) || '**Linked nodes:**' || chr(10) || links || chr(10) ELSE '' END, chr(10) ORDER BY position, s.id) AS body FROM s LEFT JOIN lk USING (id) GROUP BY 1),
md AS (SELECT d.id AS doc_id, concat_ws(chr(10), '# ' || coalesce(title, '') || chr(10), body) AS markdown FROM d LEFT JOIN ag ON ag.doc_id = d.id)"""
add("fn31_docs_for_agents", rd.docs_for_agents, f"{_AGENT} SELECT * FROM md")
add("snk25_site_pages", lambda m: rd.site_pages(rd.docs_for_agents(m)).select("path", "doc_id", "hash"), f"{_AGENT} SELECT replace(split_part(doc_id, '::', 2), '.', '/') || '.md' AS path, doc_id, substr(sha256(markdown), 1, 16) AS hash FROM md")
add("sch9_read_sections", lambda m: rd.read_docs(m, m.sections.select("doc_id", F.element_at(F.split("id", "::"), -1).alias("section"))).select("doc_id", "section", "part", "result"), "SELECT doc_id, list_last(string_split(id, '::')) AS section, id AS part, 'section' AS result FROM s")
add("sch9_read_docs", lambda m: rd.read_docs(m, m.docs.select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("section")), 1000).select("doc_id", "result", F.length("text").alias("n")),
    f"{_AGENT}, sz AS (SELECT doc_id, sum(length(coalesce(content, ''))) AS c, string_agg('| ' || list_last(string_split(id, '::')) || ' | ' || length(coalesce(content, '')) || ' |', chr(10) ORDER BY position) AS toc FROM s GROUP BY 1) SELECT md.doc_id, CASE WHEN c > 1000 THEN 'contents' ELSE 'document' END AS result, length(CASE WHEN c > 1000 THEN toc ELSE markdown END) AS n FROM md LEFT JOIN sz USING (doc_id)")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").filter("location is not null")
    files = f.groupBy("location").agg(F.max_by("content", F.struct("delivered_at", "file_id")).alias("content"))
    m = open_mesh(spark, d)
    return rd.node_sources(m, files, m.nodes.select("id"), 40, 5).select("id", "result", fn.hash16(F.regexp_replace("text", r"\n\nChildren:[\s\S]*", "")).alias("text_hash"))


QUERIES["fn20_node_sources"] = _sources
SQL["fn20_node_sources"] = f"""WITH {MESH}, f AS (SELECT location AS path, content FROM source_files WHERE location IS NOT NULL QUALIFY row_number() OVER (PARTITION BY location ORDER BY delivered_at DESC, file_id DESC) = 1),
x AS (SELECT id, node_type, level_3_location AS loc, regexp_extract(level_3_location, '^(.*?)(?:#L\\d+(?:-L?\\d+)?)?$', 1) AS path, {_LINE.format('level_3_location')} AS a, coalesce(try_cast(nullif(regexp_extract(level_3_location, '#L\\d+-L?(\\d+)', 1), '') AS INTEGER), {_LINE.format('level_3_location')}) AS b FROM n),
y AS (SELECT x.*, content, string_split(content, chr(10)) AS l, len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS c, (SELECT count(*) FROM e JOIN n k ON k.id = e.to_id WHERE edge_type = 'composes' AND e.from_id = x.id) AS kids FROM x LEFT JOIN f USING (path)),
z AS (SELECT *, CASE WHEN coalesce(loc, '') = '' THEN 'no_location' WHEN content IS NULL THEN 'file_missing' WHEN a IS NULL AND node_type = 'composite_process' AND c > 40 THEN 'preview' WHEN a IS NULL THEN 'file' ELSE 'lines' END AS result FROM y)
SELECT id, result, substr(sha256(CASE result WHEN 'preview' THEN '# ' || id || '  @ ' || loc || chr(10) || chr(10) || 'Module has ' || c || ' lines and ' || kids || ' functions.' || chr(10) || chr(10) || array_to_string(l[1:5], chr(10))
  WHEN 'file' THEN '# ' || id || '  @ ' || loc || chr(10) || chr(10) || content WHEN 'lines' THEN '# ' || id || '  @ ' || loc || chr(10) || chr(10) || array_to_string(l[greatest(a, 1):b], chr(10)) END), 1, 16) AS text_hash FROM z"""
