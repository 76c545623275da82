"""Queries and SQL of drift views, stale links and statuses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift as dr
from ..operators import graph as gr
from ..operators import history as hs
from ..operators import staleness as st
from ..operators.inventory import docs_with_tags, node_edges
from .registry import registry, us

QUERIES, SQL, add = registry()

_CHG = """cc AS (SELECT node_id, scanned_at AS changed_at FROM h WHERE change_type IN ('CONTENT_ONLY', 'CONTENT_AND_DESC', 'BECAME_CONTENT_UPDATED') QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY id DESC) = 1),
cd AS (SELECT node_id, scanned_at AS changed_at FROM h WHERE change_type IN ('CONTENT_ONLY', 'CONTENT_AND_DESC', 'BECAME_CONTENT_UPDATED', 'DESC_ONLY') QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY id DESC) = 1),
code AS (SELECT id FROM n WHERE NOT (node_type = 'atomic_process' AND coalesce(subtype, '') = 'docjson')),
j1 AS (SELECT s.id, s.doc_id, s.heading, e.to_id AS via, changed_at FROM s JOIN e ON e.from_id = s.id AND edge_type = 'documents' JOIN code ON code.id = e.to_id JOIN cc ON cc.node_id = e.to_id),
j2 AS (SELECT n.id, e.to_id AS via, changed_at FROM n JOIN e ON e.from_id = n.id AND edge_type = 'validates' JOIN code ON code.id = e.to_id JOIN cc ON cc.node_id = e.to_id WHERE n.node_type = 'atomic_process' AND n.subtype = 'test'),
j3 AS (SELECT n.id, e.to_id AS via, changed_at, updated_at FROM n JOIN e ON e.from_id = n.id AND edge_type = 'annotates' JOIN cd ON cd.node_id = e.to_id WHERE changed_at > updated_at)"""
_BROKEN = "br AS (SELECT from_id AS id, min(to_id) AS target FROM e WHERE edge_type IN ('documents', 'validates') AND to_id NOT IN (SELECT id FROM n) GROUP BY 1)"
_FROZEN = "fz AS (SELECT id FROM s WHERE doc_id IN (SELECT node_id FROM t WHERE tag = 'frozen'))"
_SHOWN = "(own_status IN ('DESC_UPDATED', 'CONTENT_UPDATED', 'RENAMED', 'NOT_FOUND') OR link_status IN ('LINKED_STALE', 'BROKEN_LINK'))"
_FEATURE = """fe AS (SELECT to_id AS id, feature FROM (SELECT e.to_id, s.depth, p[list_position(p, 'features') + 1] AS feature FROM e JOIN (SELECT *, string_split(split_part(doc_id, '::', 2), '.') AS p FROM s) s ON s.id = e.from_id
  WHERE edge_type = 'documents' AND list_contains(p, 'features')) WHERE feature IS NOT NULL QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY depth DESC, feature) = 1)"""
_PREFIX = "CASE WHEN len(list_filter(string_split(replace(coalesce(level_3_location, location, ''), chr(92), '/'), '/'), lambda x: x <> '')) = 0 THEN '(no-location)' ELSE array_to_string(list_filter(string_split(replace(coalesce(level_3_location, location, ''), chr(92), '/'), '/'), lambda x: x <> '')[1:2], '/') END"
_KEYS = {"status": "own_status || '/' || link_status", "location_prefix": _PREFIX, "feature": "coalesce(feature, '(undocumented)')"}
_DRIFT = f"{_FROZEN}, {_FEATURE}, dq AS (SELECT n.*, fe.feature FROM n LEFT JOIN fe USING (id) WHERE {_SHOWN} AND (link_status = 'BROKEN_LINK' OR id NOT IN (SELECT id FROM fz)))"


def _rows(m, text=None, glob=None):
    return dr.drift_rows(m, text, glob, ["frozen"])


add("jn1_stale_sections", lambda m: dr.stale_sections(m).select("id", "doc_id", "heading", "via", us("changed_at").alias("changed_us")), f"{_CHG} SELECT id, doc_id, heading, via, epoch_us(changed_at) AS changed_us FROM j1")
add("jn2_stale_tests", lambda m: dr.stale_tests(m).select("id", "via", us("changed_at").alias("changed_us")), f"{_CHG} SELECT id, via, epoch_us(changed_at) AS changed_us FROM j2")
add("jn3_stale_annotated", lambda m: dr.stale_annotated(m).select("id", "via", us("changed_at").alias("changed_us")), f"{_CHG} SELECT id, via, epoch_us(changed_at) AS changed_us FROM j3")
add("jn4_broken_links", dr.broken_links, f"{_BROKEN} SELECT * FROM br")
add("jn5_undocumented", lambda m: dr.undocumented(m).select("id"), "SELECT id FROM n WHERE NOT (node_type = 'atomic_process' AND coalesce(subtype, '') = 'docjson') AND id NOT IN (SELECT to_id FROM e WHERE edge_type = 'documents')")
add("jn7_doc_doc_links", lambda m: dr.doc_doc_links(m, ["consumer", "spec"]), "SELECT from_id AS src, to_id AS tgt FROM e WHERE edge_type = 'documents' AND from_id IN (SELECT s.id FROM s JOIN t ON t.node_id = s.doc_id WHERE tag IN ('consumer', 'spec')) AND to_id IN (SELECT id FROM s)")
add("jn8_shadow_violations", lambda m: dr.shadow_violations(m.nodes, m.sections.withColumn("heading", F.when(F.col("depth") > 1, F.upper("heading")).otherwise(F.col("heading")))), "SELECT id FROM s WHERE depth > 1 AND upper(heading) <> heading")
add("jn10_vias", lambda m: dr.vias(m), "x AS (SELECT DISTINCT from_id AS id, to_id AS via FROM e WHERE edge_type IN ('annotates', 'documents', 'validates', 'delegates_to') AND to_id IN (SELECT id FROM n WHERE own_status <> 'VERIFIED')) SELECT id, via, row_number() OVER (PARTITION BY id ORDER BY via) AS rn FROM x QUALIFY rn <= 3")
add("jn12_features", dr.features, f"{_FEATURE} SELECT id, feature FROM fe")
add("jn13_node_tests", lambda m: dr.target_links(m, "validates"), "SELECT to_id, from_id, location, title FROM e JOIN n ON n.id = e.from_id WHERE edge_type = 'validates'")
add("jn14_section_links", dr.section_links, "SELECT e.from_id, e.to_id, n.title FROM e JOIN s ON s.id = e.from_id LEFT JOIN n ON n.id = e.to_id WHERE edge_type = 'documents' AND e.to_id <> s.doc_id AND NOT starts_with(e.to_id, s.doc_id || '::')")
add("jn19_workflow_labels", dr.workflow_labels, """a AS (SELECT from_id AS env, min(to_id) AS caller FROM e WHERE edge_type = 'annotates' GROUP BY 1), g AS (SELECT from_id AS step, min(to_id) AS callee FROM e WHERE edge_type = 'delegates_to' GROUP BY 1)
SELECT caller, callee, regexp_extract(step, '::step-([0-9.]+)$', 1) AS step_num FROM a JOIN (SELECT from_id AS env, to_id AS step FROM e WHERE edge_type = 'composes') c USING (env) JOIN g USING (step)""")  # fmt: skip
add("jn25_invalid_edges", lambda m: dr.invalid_edges(m.but(edges=m.edges.select("id", "edge_type", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))), "r(edge_type, ft, tt) AS (VALUES " + ", ".join(str(x) for x in dr.EDGE_RULES) + ") SELECT e.id, e.edge_type || ': ' || a.node_type || ' -> ' || b.node_type AS reason FROM e JOIN n a ON a.id = e.to_id JOIN n b ON b.id = e.from_id WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.edge_type = e.edge_type AND ft = a.node_type AND tt = b.node_type)")
for _word in (None, "staleness", "links", "doc_quality", "DOC_SECTION_LONG", "RENAMED", "BROKEN_LINK"):
    _cond = {None: _SHOWN, "staleness": "(own_status IN ('DESC_UPDATED', 'CONTENT_UPDATED', 'RENAMED', 'NOT_FOUND') OR link_status = 'LINKED_STALE')", "links": "link_status IN ('LINKED_STALE', 'BROKEN_LINK')", "RENAMED": "own_status = 'RENAMED'", "BROKEN_LINK": "link_status = 'BROKEN_LINK'"}.get(_word, "(subtype = 'docjson' AND length(level_2) > 150)")
    add(f"flt13_filter_{(_word or 'default').lower()}", lambda m, w=_word: m.nodes.filter(dr.matches(w, long_section=150)).select("id"), f"SELECT id FROM n WHERE {_cond}")
add("flt16_drift_predicate", lambda m: m.nodes.filter(dr.matches("all", "**/docs/**")).select("id"), f"SELECT id FROM n WHERE ({_SHOWN} OR (subtype = 'docjson' AND length(level_2) > 2000)) AND coalesce(level_3_location, location) ILIKE '%/docs/%'")
add("srt3_drift_rows", lambda m: _rows(m).select("id", "own_status", "link_status", "location", "marker"), f"{_DRIFT} SELECT id, own_status, link_status, coalesce(level_3_location, location) AS location, CASE WHEN id IN (SELECT id FROM fz) THEN '[frozen-source]' ELSE '' END AS marker FROM dq")
add("srt4_drift_page", lambda m: dr.drift_page(m, _rows(m, "links"), 1, 30).select("id", "own_status", "link_status", "via", "total"),
    f"""{_FROZEN}, q AS (SELECT * FROM n WHERE link_status IN ('LINKED_STALE', 'BROKEN_LINK') AND (link_status = 'BROKEN_LINK' OR id NOT IN (SELECT id FROM fz))),
    x AS (SELECT DISTINCT from_id AS id, to_id AS via FROM e WHERE edge_type IN ('annotates', 'documents', 'validates', 'delegates_to') AND to_id IN (SELECT id FROM n WHERE own_status <> 'VERIFIED')),
    y AS (SELECT id, string_agg(via, ',' ORDER BY via) AS via FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY via) <= 3) GROUP BY 1)
    SELECT q.id, own_status, link_status, CASE WHEN link_status = 'LINKED_STALE' THEN coalesce(y.via, '') ELSE '' END AS via, (SELECT count(*) FROM q) AS total FROM q LEFT JOIN y USING (id) ORDER BY q.id LIMIT 30 OFFSET 30""")  # fmt: skip
for _n, _by in enumerate(("status", "location_prefix", "feature")):
    add(f"agg{12 + _n}_drift_counts_by_{_by}", lambda m, by=_by: dr.drift_counts(m, _rows(m), by), f"{_DRIFT} SELECT {_KEYS[_by]} AS grp, count(*) AS n FROM dq GROUP BY 1")
    add(f"agg{15 + _n}_drift_ids_by_{_by}", lambda m, by=_by: dr.drift_ids(m, _rows(m), by), f"{_DRIFT} SELECT {_KEYS[_by]} AS grp, id FROM dq")
    add(f"agg{18 + _n}_drift_full_by_{_by}", lambda m, by=_by: dr.drift_full(m, _rows(m), by).select("grp", "id", "own_status", "link_status", "location"), f"{_DRIFT} SELECT {_KEYS[_by]} AS grp, id, own_status, link_status, coalesce(level_3_location, location) AS location FROM dq")

_REACH = """hop AS (SELECT DISTINCT c.from_id AS env, g.task FROM e c JOIN n ON n.id = c.to_id AND n.subtype = 'autostep' JOIN (SELECT from_id AS step, min(to_id) AS task FROM e WHERE edge_type = 'delegates_to' GROUP BY 1) g ON g.step = c.to_id WHERE c.edge_type = 'composes'),
nx AS (SELECT DISTINCT hop.env, a.from_id AS nxt FROM hop JOIN e a ON a.edge_type = 'annotates' AND a.to_id = hop.task),
rc AS (SELECT id AS env, id AS at FROM n WHERE node_type = 'composite_process' AND subtype IN ('workflow', 'task') UNION SELECT rc.env, nx.nxt FROM rc JOIN nx ON nx.env = rc.at),
rt AS (SELECT DISTINCT rc.env, hop.task FROM rc JOIN hop ON hop.env = rc.at),
j4 AS (SELECT rt.env AS id, rt.task AS via FROM rt JOIN cc ON cc.node_id = rt.task JOIN n ON n.id = rt.env WHERE changed_at > updated_at)"""
_LINKED = f"""{_FROZEN}, c0 AS (SELECT id, via FROM j1 WHERE id NOT IN (SELECT id FROM fz) UNION SELECT id, via FROM j2 UNION SELECT id, via FROM j3 UNION SELECT id, via FROM j4),
ct AS (SELECT node_id, max(scanned_at) AS m FROM h WHERE change_type IN ('CONTENT_ONLY', 'CONTENT_AND_DESC', 'BECAME_CONTENT_UPDATED') GROUP BY 1),
c1 AS (SELECT * FROM c0 WHERE id NOT IN (SELECT c0.id FROM c0 JOIN v ON v.node_id = c0.id LEFT JOIN ct ON ct.node_id = c0.via WHERE verified_at IS NOT NULL GROUP BY c0.id, verified_at HAVING bool_and(ct.m IS NULL OR ct.m <= verified_at))),
dd AS (SELECT from_id AS src, to_id AS tgt FROM e WHERE edge_type = 'documents' AND from_id IN (SELECT s.id FROM s JOIN t ON t.node_id = s.doc_id WHERE tag = 'consumer') AND to_id IN (SELECT id FROM s) AND from_id NOT IN (SELECT id FROM fz)),
ss AS (SELECT id FROM c1 UNION SELECT dd.src FROM ss JOIN dd ON dd.tgt = ss.id),
ls AS (SELECT id, via FROM c1 UNION SELECT src, tgt FROM dd WHERE tgt IN (SELECT id FROM ss))"""
add("gr6_delegates", lambda m: gr.stale_by_delegation(m, hs.latest_change(m.history)), f"{_CHG}, {_REACH} SELECT id, via FROM j4", True)
add("gr6_reachable_tasks", lambda m: gr.reachable_tasks(m, m.nodes.filter("node_type = 'composite_process' and subtype in ('workflow', 'task')").select("id")), f"{_CHG}, {_REACH} SELECT env, task FROM rt", True)
add("gr7_linked_stale", lambda m: st.linked_stale(m, ["consumer"], ["frozen"]), f"{_CHG}, {_REACH}, {_LINKED} SELECT id, via FROM ls", True)

_INHERIT = """ce AS (SELECT from_id AS p, to_id AS c FROM e WHERE edge_type = 'composes'), pa AS (SELECT DISTINCT p FROM ce),
dn AS (SELECT DISTINCT p AS a, c AS b FROM ce UNION SELECT dn.a, ce.c FROM dn JOIN ce ON ce.p = dn.b),
cy AS (SELECT a AS id FROM dn WHERE b IN (SELECT a FROM dn WHERE a = b) UNION SELECT a FROM dn WHERE a = b),
ok AS (SELECT p FROM pa WHERE p NOT IN (SELECT id FROM cy)),
ty AS (SELECT id, node_type FROM n),
-- own: the worst over what is reached through parents that are not atomic
ow AS (SELECT p AS a, p AS b FROM ok LEFT JOIN ty ON ty.id = p WHERE node_type IS DISTINCT FROM 'atomic_process'
  UNION SELECT ow.a, ce.c FROM ow JOIN ce ON ce.p = ow.b LEFT JOIN ty ON ty.id = ow.b WHERE ty.node_type IS DISTINCT FROM 'atomic_process'),
o1 AS (SELECT a AS id, max(coalesce(base.own, 0)) AS own FROM ow LEFT JOIN base ON base.id = ow.b GROUP BY 1),
of AS (SELECT p AS id, coalesce(o1.own, base.own, 0) AS own FROM ok LEFT JOIN o1 ON o1.id = p LEFT JOIN base ON base.id = p),
oa AS (SELECT id, own FROM of UNION ALL SELECT id, own FROM base WHERE id NOT IN (SELECT id FROM of)),
l0 AS (SELECT p AS id, greatest(coalesce(base.link, 0), CASE WHEN ty.node_type = 'atomic_process' AND (coalesce(base.own, 0) > 0 OR EXISTS (SELECT 1 FROM ce x JOIN oa ON oa.id = x.c WHERE x.p = ok.p AND oa.own > 0)) THEN 1 ELSE 0 END) AS link FROM ok LEFT JOIN base ON base.id = p LEFT JOIN ty ON ty.id = p),
lb AS (SELECT id, link FROM l0 UNION ALL SELECT id, link FROM base WHERE id NOT IN (SELECT id FROM l0)),
lf AS (SELECT ok.p AS id, greatest(max(l0.link), coalesce(max(lb.link), 0)) AS link FROM ok JOIN l0 ON l0.id = ok.p LEFT JOIN dn ON dn.a = ok.p LEFT JOIN lb ON lb.id = dn.b GROUP BY 1),
inh AS (SELECT coalesce(of.id, base.id) AS id, coalesce(of.own, base.own) AS own, coalesce(lf.link, base.link) AS link FROM base FULL JOIN of ON of.id = base.id LEFT JOIN lf ON lf.id = coalesce(of.id, base.id))"""
_LADDER = """own AS (SELECT unnest(['VERIFIED', 'DESC_UPDATED', 'CONTENT_UPDATED', 'RENAMED', 'NOT_FOUND']) AS s, unnest(range(5))::INTEGER AS k), lnk AS (SELECT unnest(['VERIFIED', 'LINKED_STALE', 'BROKEN_LINK']) AS s, unnest(range(3))::INTEGER AS k)"""
add("gr8_inheritance", lambda m: gr.inherit(m, gr.severities(m.nodes)), f"{_LADDER}, base AS (SELECT id, own.k AS own, lnk.k AS link FROM n JOIN own ON own.s = own_status JOIN lnk ON lnk.s = link_status), {_INHERIT} SELECT id, CAST(own AS INTEGER) AS own, CAST(link AS INTEGER) AS link FROM inh", True)
_OWN = """os AS (SELECT n.id, n.node_type, CASE WHEN node_type = 'entity' OR subtype IN ('external_package', 'step', 'autostep') OR gone IS NULL THEN 0 WHEN gone THEN 4 WHEN code_hash IS NULL THEN 0
  WHEN node_type = 'composite_process' AND coalesce(subtype, '') NOT IN ('docjson', 'workflow', 'task') THEN NULL WHEN lower(code_hash) IS DISTINCT FROM cur_code THEN 2 WHEN lower(desc_hash) IS DISTINCT FROM cur_desc THEN 1 ELSE 0 END AS own,
  coalesce(cur_code, lower(code_hash)) AS seen_code, CASE WHEN gone IS NOT NULL THEN cur_desc ELSE lower(desc_hash) END AS seen_desc FROM n LEFT JOIN cur USING (id))"""
add("stl1_own_statuses", lambda m: st.own_statuses(m).select("id", "own"), f"{_OWN} SELECT id, own FROM os")
add("stl8_change_type", lambda m: m.nodes.join(m.current, "id").select("id", st.change_type(F.lower("code_hash"), F.lower("desc_hash"), F.col("cur_code"), F.col("cur_desc")).alias("change")),
    "SELECT id, CASE WHEN code_hash IS NULL THEN 'INITIAL' WHEN a AND b THEN 'CONTENT_AND_DESC' WHEN a THEN 'CONTENT_ONLY' WHEN b THEN 'DESC_ONLY' END AS change FROM (SELECT id, code_hash, lower(code_hash) IS DISTINCT FROM cur_code AS a, lower(desc_hash) IS DISTINCT FROM cur_desc AS b FROM n JOIN cur USING (id))")
_STATUS = f"""{_CHG}, {_REACH}, {_LINKED}, {_OWN}, {_LADDER}, {_BROKEN},
rb AS (SELECT DISTINCT from_id AS env, from_id AS at FROM e WHERE edge_type = 'annotates' UNION SELECT rb.env, nx.nxt FROM rb JOIN nx ON nx.env = rb.at),
nw AS (SELECT from_id AS id FROM e WHERE edge_type = 'annotates' AND to_id IN (SELECT id FROM os WHERE own IN (1, 2, 4)) UNION SELECT rb.env FROM rb JOIN hop ON hop.env = rb.at WHERE hop.task IN (SELECT id FROM os WHERE own IN (2, 4))),
lk AS (SELECT id FROM ls UNION SELECT id FROM nw UNION SELECT id FROM n WHERE link_status = 'LINKED_STALE' AND id IN (SELECT id FROM fz)),
base AS (SELECT id, coalesce(own, 0) AS own, CASE WHEN id IN (SELECT id FROM lk) THEN 1 ELSE 0 END AS link FROM os), {_INHERIT},
fin AS (SELECT os.id, CASE WHEN inh.own IN (1, 2) AND v.node_id IS NOT NULL AND seen_code IS NOT NULL THEN CASE WHEN lower(code_hash_at) IS NOT DISTINCT FROM seen_code AND lower(desc_hash_at) IS NOT DISTINCT FROM seen_desc THEN 0 WHEN lower(code_hash_at) IS DISTINCT FROM seen_code THEN 2 ELSE 1 END ELSE inh.own END AS o,
  greatest(inh.link, CASE WHEN br.id IS NOT NULL THEN 2 ELSE 0 END) AS l FROM os JOIN inh USING (id) LEFT JOIN v ON v.node_id = os.id LEFT JOIN br ON br.id = os.id),
sta AS (SELECT id, CASE WHEN own.s <> 'NOT_FOUND' AND id IN (SELECT id FROM n WHERE own_status = 'RENAMED') THEN 'RENAMED' ELSE own.s END AS own_status, lnk.s AS link_status FROM fin JOIN own ON own.k = o JOIN lnk ON lnk.k = l)"""
add("stl2_statuses", st.statuses, f"{_STATUS} SELECT * FROM sta", True)
add("stl7_transitions", lambda m: st.transitions(m.nodes.select("id", "own_status", "link_status"), st.statuses(m)),
    f"""{_STATUS}, x AS (SELECT sta.id, CASE WHEN n.own_status <> sta.own_status THEN 'BECAME_' || sta.own_status END AS a, CASE WHEN n.link_status <> sta.link_status THEN CASE WHEN sta.link_status = 'VERIFIED' THEN 'LINK_BECAME_VERIFIED' ELSE 'BECAME_' || sta.link_status END END AS b FROM sta JOIN n USING (id))
    SELECT id, a AS event FROM x WHERE a IS NOT NULL UNION ALL SELECT id, b FROM x WHERE b IS NOT NULL""", True)  # fmt: skip
add("agg10_check_summary", lambda m: st.summary(m.nodes), "SELECT " + ", ".join(f"count(*) FILTER (own_status = '{s}') AS own_{s.lower()}" for s in st.OWN) + ", " + ", ".join(f"count(*) FILTER (link_status = '{s}') AS link_{s.lower()}" for s in st.LINK) + ", count(*) FILTER (own_status = 'VERIFIED' AND link_status = 'VERIFIED') AS clean FROM n")
add("stl25_causes", st.causes, "SELECT id, CASE WHEN own_status <> 'VERIFIED' THEN own_status ELSE link_status END AS status, CASE WHEN own_status <> 'VERIFIED' THEN 'own: ' || own_status WHEN link_status <> 'VERIFIED' THEN 'links: ' || link_status ELSE 'verified' END AS cause FROM n")

_HOPS = "f AS (SELECT id AS at, 0 AS level FROM n WHERE id = 'heron0' UNION SELECT nxt, level + 1 FROM f JOIN hp ON hp.src = f.at WHERE level < {d})"
add("gr1_khop_out", lambda m: gr.khop_edges(m, "heron0", "out", 3), "hp AS (SELECT from_id AS src, to_id AS nxt FROM e), " + _HOPS.format(d=2) + " SELECT e.id, edge_type, from_id, to_id, min(level) + 1 AS hop FROM e JOIN f ON f.at = e.from_id GROUP BY ALL", True)
_INTO = "heron0::shape.docs.plan.token_render3"
add("gr1_khop_in", lambda m: gr.khop_edges(m, _INTO, "in", 2), "hp AS (SELECT to_id AS src, from_id AS nxt FROM e), " + _HOPS.format(d=1).replace("'heron0'", f"'{_INTO}'") + " SELECT e.id, edge_type, from_id, to_id, min(level) + 1 AS hop FROM e JOIN f ON f.at = e.to_id GROUP BY ALL", True)
add("gr3_neighbourhood", lambda m: gr.neighbourhood(m, "heron0", 2), "hp AS (SELECT from_id AS src, to_id AS nxt FROM e UNION ALL SELECT to_id, from_id FROM e), " + _HOPS.format(d=2) + " SELECT n.id, min(level) AS level, own_status, link_status FROM n JOIN f ON f.at = n.id GROUP BY ALL", True)
add("gr4_node_edges", lambda m: node_edges(m, _INTO).select("id", "way"), f"SELECT id, 'out' AS way FROM e WHERE from_id = '{_INTO}' UNION ALL SELECT id, 'in' FROM e WHERE to_id = '{_INTO}'")
add("gr10_expanded_steps", lambda m: gr.expanded_steps(m).drop("inner"),
    """k AS (SELECT id FROM n WHERE subtype IN ('step', 'autostep')), g AS (SELECT from_id AS step, min(to_id) AS target FROM e WHERE edge_type = 'delegates_to' GROUP BY 1), a AS (SELECT to_id AS target, min(from_id) AS "inner" FROM e WHERE edge_type = 'annotates' GROUP BY 1),
    o AS (SELECT c.from_id AS env, c.to_id AS step, regexp_extract(c.to_id, '::step-([0-9.]+)$', 1) AS no, target, "inner" FROM e c JOIN k ON k.id = c.to_id LEFT JOIN g ON g.step = c.to_id LEFT JOIN a USING (target) WHERE c.edge_type = 'composes'),
    x AS (SELECT n.id AS root, no AS path, step, target, "inner", [n.id] AS seen, coalesce("inner" = n.id, false) AS cyclic FROM n JOIN o ON o.env = n.id WHERE n.subtype = 'workflow'
      UNION ALL SELECT x.root, x.path || '.' || o.no, o.step, o.target, o."inner", list_append(x.seen, x."inner"), coalesce(list_contains(list_append(x.seen, x."inner"), o."inner"), false) FROM x JOIN o ON o.env = x."inner" WHERE NOT x.cyclic)
    SELECT root, path, step, target, cyclic FROM x""", True)  # fmt: skip
add("gr12_transitions", gr.machine_transitions, "SELECT regexp_extract(from_id, '^(.*@machine)\\.states\\.', 1) AS machine, from_id AS state, to_id AS target, via, event FROM e WHERE edge_type = 'delegates_to' AND via IS NOT NULL AND regexp_extract(from_id, '^(.*@machine)\\.states\\.', 1) <> ''")
add("jn16_steps", lambda m: m.edges.filter("edge_type = 'composes'").join(m.nodes.filter("subtype in ('step', 'autostep')").select(F.col("id").alias("to_id"), "subtype"), "to_id").select(F.col("from_id").alias("env"), F.col("to_id").alias("step"), "subtype"), "SELECT from_id AS env, to_id AS step, subtype FROM e JOIN n ON n.id = e.to_id WHERE edge_type = 'composes' AND subtype IN ('step', 'autostep')")
add("set2_lost_nodes", lambda m: m.nodes.join(m.current.filter("not gone"), "id", "left_anti").join(m.current.select("id"), "id", "left_semi").select("id"), "SELECT id FROM n JOIN cur USING (id) WHERE gone")
add("set3_new_nodes", lambda m: m.current.filter("not gone").join(m.nodes, "id", "left_anti").select("id"), "SELECT id FROM cur WHERE NOT gone AND id NOT IN (SELECT id FROM n)")
add("flt20_frozen_docs", lambda m: docs_with_tags(m, ["frozen"]), "SELECT id FROM d WHERE id IN (SELECT node_id FROM t WHERE tag = 'frozen')")
