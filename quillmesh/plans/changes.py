"""Queries and SQL of search, writes and renames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import SQL as MESH
from ..mesh import open_mesh
from ..operators import mutations as mu
from ..operators import rename as rn
from ..operators import search as se
from ..runtime import table
from .registry import registry

QUERIES, SQL, add = registry()
NOW = datetime(2025, 7, 1)

_FTS = "list_filter(regexp_split_to_array(lower(id || ' ' || coalesce(level_1, '') || ' ' || coalesce(level_2, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
add("sch1_words", lambda m: se.keyword_search(m, "frozen queue", most=1000), f"q AS (SELECT id FROM n WHERE list_has_all({_FTS}, ['frozen', 'queue'])) SELECT id, 'fts' AS mode, (SELECT count(*) FROM q) AS total FROM q ORDER BY id LIMIT 1000")
add("sch1_words_docs", lambda m: se.keyword_search(m, "anchor", most=50, node_type="atomic_process", scope="docs", tag="spec"),
    f"q AS (SELECT id FROM n WHERE list_has_all({_FTS}, ['anchor']) AND source IN ('docjson', 'doc_scanner', 'json_doc_scanner') AND node_type = 'atomic_process' AND id IN (SELECT node_id FROM t WHERE tag = 'spec')) SELECT id, 'fts' AS mode, (SELECT count(*) FROM q) AS total FROM q ORDER BY id LIMIT 50")
add("sch1_parts", lambda m: se.keyword_search(m, "hash ueu", most=30), "q AS (SELECT id FROM n WHERE (level_1 ILIKE '%hash%' OR level_2 ILIKE '%hash%') AND (level_1 ILIKE '%ueu%' OR level_2 ILIKE '%ueu%')) SELECT id, 'like_and' AS mode, (SELECT count(*) FROM q) AS total FROM q ORDER BY id LIMIT 30")
add("sch1_any", lambda m: se.keyword_search(m, "edger zzz", most=30), "q AS (SELECT id FROM n WHERE level_1 ILIKE '%edger%' OR level_2 ILIKE '%edger%' OR level_1 ILIKE '%zzz%' OR level_2 ILIKE '%zzz%') SELECT id, 'like_or' AS mode, (SELECT count(*) FROM q) AS total FROM q ORDER BY id LIMIT 10")
def _sp(c: str) -> str:
    return "' ' || array_to_string(regexp_split_to_array(lower(coalesce(" + c + ", '')), '[^\\p{L}\\p{N}]+'), ' ') || ' '"


def _any(needle: str) -> str:
    return "(" + " OR ".join(f"contains({_sp(c)}, '{needle}')" for c in ("id", "level_1", "level_2")) + ")"


for _name, _q, _cond in (
    ("phrase", '"one row" OR "the order"', f"{_any(' one row ')} OR {_any(' the order ')}"),
    ("prefix", "snap* NOT level_1: walk*", f"{_any(' snap')} AND NOT contains({_sp('level_1')}, ' walk')"),
    ("column", "level_2: cursor id: heron0", f"contains({_sp('level_2')}, ' cursor ') AND contains({_sp('id')}, ' heron0 ')"),
):
    add(f"sch1_{_name}", lambda m, q=_q: se.keyword_search(m, q, most=100_000), f"q AS (SELECT id FROM n WHERE {_cond}) SELECT id, 'fts' AS mode, (SELECT count(*) FROM q) AS total FROM q")
add("srt6_search_page", lambda m: se.keyword_search(m, "marker", most=10, offset=20), f"q AS (SELECT id FROM n WHERE {_any(' marker ')}) SELECT id, 'fts' AS mode, (SELECT count(*) FROM q) AS total FROM q ORDER BY id LIMIT 10 OFFSET 20")
add("sch1_token_index", se.token_index, """x AS (SELECT id, 'id' AS field, id AS txt FROM n UNION ALL SELECT id, 'level_1', level_1 FROM n UNION ALL SELECT id, 'level_2', level_2 FROM n),
y AS (SELECT id, field, unnest(regexp_split_to_array(lower(coalesce(txt, '')), '[^\\p{L}\\p{N}]+')) AS token FROM x) SELECT token, id, field, count(*) AS tf FROM y WHERE token <> '' GROUP BY ALL""")  # fmt: skip

_GOOD = "vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = table(spark, d, "vec_embeddings").filter((F.size("vec") == 64) & fine)
    ok = ok.join(table(spark, d, "embedding_hashes"), ["node_id", "content_hash"], "left_semi")
    return ok.groupBy("node_id").agg(F.min_by("vec", "vec_id").alias("vec"), F.min("vec_id").alias("vec_id"))


def _knn(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    query = v.orderBy("vec_id").select("vec").first()
    return se.vector_search(open_mesh(spark, d), v, query["vec"], 20, "atomic_process", "code")


QUERIES["sch3_vector_search"] = _knn
SQL["sch3_vector_search"] = f"""WITH {MESH}, x AS (SELECT node_id, arg_min(vec, vec_id)::DOUBLE[] AS vec, min(vec_id) AS vec_id FROM vec_embeddings JOIN embedding_hashes USING (node_id, content_hash) WHERE {_GOOD} GROUP BY 1),
q AS (SELECT vec FROM x ORDER BY vec_id LIMIT 1), y AS (SELECT node_id AS id, round(list_distance(x.vec, q.vec), 6) AS distance FROM x, q ORDER BY 2, 1 LIMIT 60)
SELECT id, distance FROM y JOIN n USING (id) WHERE node_type = 'atomic_process' AND source NOT IN ('docjson', 'doc_scanner', 'json_doc_scanner') ORDER BY 2, 1 LIMIT 20"""


def _to_embed(spark: SparkSession, d: str) -> DataFrame:
    return se.to_embed(open_mesh(spark, d), table(spark, d, "embedding_hashes"))


QUERIES["sch7_to_embed"] = _to_embed
SQL["sch7_to_embed"] = f"WITH {MESH}, x AS (SELECT id, substr(sha256(coalesce(level_1, '') || chr(10) || coalesce(level_2, '')), 1, 16) AS content_hash FROM n) SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM embedding_hashes b WHERE b.node_id = x.id AND b.content_hash = x.content_hash)"


def _vectored(spark: SparkSession, d: str) -> DataFrame:
    """The stored vectors' first eight places, and stand-ins of eight for what they lack."""
    m = open_mesh(spark, d)
    stored = _vectors(spark, d).join(table(spark, d, "embedding_hashes"), "node_id").select("node_id", "content_hash", F.slice("vec", 1, 8).alias("vec"))
    got = se.refresh_vectors(m, stored, lambda texts: se.stand_in(texts, 8))
    return got.select("node_id", "content_hash", F.size("vec").alias("width"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total"))


QUERIES["snk22_refresh_vectors"] = _vectored
_BYTE = "(instr('0123456789abcdef', substr(sha256(tx), {0}, 1)) - 1) * 16 + instr('0123456789abcdef', substr(sha256(tx), {1}, 1)) - 1"
SQL["snk22_refresh_vectors"] = f"""WITH {MESH}, st AS (SELECT node_id, content_hash, list_sum(list_transform(vec[1:8], lambda v: v::DOUBLE)) AS total FROM (SELECT node_id, arg_min(vec, vec_id) AS vec FROM vec_embeddings JOIN embedding_hashes USING (node_id, content_hash) WHERE {_GOOD} GROUP BY 1) JOIN embedding_hashes USING (node_id)),
x AS (SELECT id, coalesce(level_1, '') || chr(10) || coalesce(level_2, '') AS tx FROM n), y AS (SELECT id AS node_id, substr(sha256(tx), 1, 16) AS content_hash, {' + '.join(f"xor(CAST({_BYTE.format(2 * i + 1, 2 * i + 2)} AS INTEGER), {i}) / 128.0 - 1" for i in range(8))} AS total FROM x),
nw AS (SELECT y.* FROM y WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.node_id = y.node_id AND st.content_hash = y.content_hash))
SELECT node_id, content_hash, 8 AS width, round(total, 3) AS total FROM nw UNION ALL SELECT node_id, content_hash, 8, round(total, 3) FROM st WHERE node_id NOT IN (SELECT node_id FROM nw)"""
add("src28_stand_in_vectors", lambda m: m.nodes.select("id", F.round(F.aggregate(fn.test_vector("id", 8), F.lit(0.0), lambda a, x: a + x.cast("double")), 3).alias("total")), "x AS (SELECT id, id AS tx FROM n) SELECT id, round(" + " + ".join(f"xor(CAST({_BYTE.format(2 * i + 1, 2 * i + 2)} AS INTEGER), {i}) / 128.0 - 1" for i in range(8)) + ", 3) AS total FROM x")
QUERIES["sch4_semantic_search"] = lambda spark, d: se.semantic_search(open_mesh(spark, d), _vectors(spark, d), "queue", lambda texts: [[1.0] * 64], 20)
SQL["sch4_semantic_search"] = f"""WITH {MESH}, x AS (SELECT node_id, arg_min(vec, vec_id)::DOUBLE[] AS vec FROM vec_embeddings JOIN embedding_hashes USING (node_id, content_hash) WHERE {_GOOD} GROUP BY 1),
y AS (SELECT node_id AS id, round(list_distance(vec, list_transform(range(64), lambda i: 1.0::DOUBLE)), 6) AS distance FROM x ORDER BY 2, 1 LIMIT 60), z AS (SELECT id FROM y JOIN n USING (id) ORDER BY distance, id LIMIT 20) SELECT id, 'semantic' AS mode, (SELECT count(*) FROM z) AS total FROM z"""


def _observed(m):
    """The nodes as last observed, to be written over the index."""
    seen = m.current.filter("not gone and cur_code is not null")
    return m.nodes.join(seen, "id").withColumn("code_hash", F.col("cur_code")).withColumn("desc_hash", F.col("cur_desc")).select(*m.nodes.columns)


_OBS = "o AS (SELECT n.id, n.code_hash AS oc, n.desc_hash AS od, cur_code AS nc, cur_desc AS nd FROM n JOIN cur USING (id) WHERE NOT gone AND cur_code IS NOT NULL)"
_NEW = "c AS (SELECT *, CASE WHEN oc IS NULL THEN 'INITIAL' WHEN oc <> nc AND od IS DISTINCT FROM nd THEN 'CONTENT_AND_DESC' WHEN oc <> nc THEN 'CONTENT_ONLY' WHEN od IS DISTINCT FROM nd THEN 'DESC_ONLY' END AS change FROM o)"
add("snk2_upsert_nodes", lambda m: mu.upsert_nodes(m, _observed(m), NOW, False, "abc").nodes.select("id", "code_hash", "desc_hash", "own_status", "link_status"),
    f"{_OBS}, {_NEW} SELECT n.id, CASE WHEN change IS NOT NULL THEN nc ELSE code_hash END AS code_hash, CASE WHEN change IS NOT NULL THEN nd ELSE desc_hash END AS desc_hash, CASE WHEN change IS NOT NULL THEN 'VERIFIED' ELSE own_status END AS own_status, CASE WHEN change IS NOT NULL THEN 'VERIFIED' ELSE link_status END AS link_status FROM n LEFT JOIN c USING (id)")
add("snk2_upsert_history", lambda m: mu.upsert_nodes(m, _observed(m), NOW, False, "abc").history.filter(F.col("scanned_at") == NOW).select("node_id", "change_type", "git_sha"), f"{_OBS}, {_NEW} SELECT id AS node_id, change AS change_type, 'abc' AS git_sha FROM c WHERE change IS NOT NULL")
add("snk2_discovery_only", lambda m: mu.upsert_nodes(m, _observed(m).withColumn("title", F.upper("title")), NOW).nodes.select("id", "title", "code_hash", "own_status"), f"{_OBS} SELECT n.id, CASE WHEN o.id IS NOT NULL THEN upper(title) ELSE title END AS title, code_hash, own_status FROM n LEFT JOIN o USING (id)")
add("snk3_upsert_edges", lambda m: mu.upsert_edges(m, m.edges.filter("edge_type = 'validates'").withColumn("weight", F.lit(0.5))).edges.select("id", "weight"), "SELECT id, CASE WHEN edge_type = 'validates' THEN 0.5 ELSE weight END AS weight FROM e")
_GONE = "g AS (SELECT id FROM n WHERE own_status = 'NOT_FOUND')"
_CUT = "(x.from_id IN (SELECT id FROM g) OR x.to_id IN (SELECT id FROM g)) AND NOT (x.edge_type = 'documents' AND x.to_id IN (SELECT id FROM g) AND x.from_id NOT IN (SELECT id FROM g))"


def _purged(m):
    return mu.purge(m, m.nodes.filter("own_status = 'NOT_FOUND'").select("id"), NOW)[0]


add("snk12_delete_edges", lambda m: _purged(m).edges.select("id"), f"{_GONE} SELECT id FROM e x WHERE NOT ({_CUT})")
add("snk12_delete_history", lambda m: _purged(m).history.filter(F.col("scanned_at") == NOW).groupBy("node_id", "change_type").agg(F.count("*").alias("n")),
    f"{_GONE}, y AS (SELECT id AS node_id, 'DELETED' AS change_type FROM g UNION ALL SELECT CASE WHEN from_id IN (SELECT id FROM g) THEN to_id ELSE from_id END, 'LINK_REMOVED' FROM e x WHERE {_CUT}) SELECT node_id, change_type, count(*) AS n FROM y GROUP BY ALL")
add("snk12_delete_kept_history", lambda m: _purged(m).history.filter(F.col("scanned_at") != NOW).select("id", "node_id"), f"{_GONE} SELECT id, node_id FROM h WHERE preserved OR node_id NOT IN (SELECT id FROM g)")
add("stl14_purge", lambda m: mu.purge(m, m.nodes.select("id"), NOW)[1], "SELECT id, CASE WHEN own_status = 'NOT_FOUND' THEN 'purged' ELSE 'not_stale' END AS result FROM n")
add("stl12_mark_clean", lambda m: mu.mark_clean(m, m.nodes.filter("own_status = 'CONTENT_UPDATED'").select("id"), NOW, "agent:x", "ok").nodes.select("id", "code_hash", "own_status"), "SELECT n.id, CASE WHEN own_status = 'CONTENT_UPDATED' THEN coalesce(cur_code, code_hash) ELSE code_hash END AS code_hash, CASE WHEN own_status = 'CONTENT_UPDATED' THEN 'VERIFIED' ELSE own_status END AS own_status FROM n LEFT JOIN cur USING (id)")
add("stl12_verifications", lambda m: mu.mark_clean(m, m.nodes.filter("own_status = 'CONTENT_UPDATED'").select("id"), NOW, "agent:x", "ok").verification.select("node_id", "verified_by"), "g AS (SELECT id FROM n WHERE own_status = 'CONTENT_UPDATED') SELECT node_id, verified_by FROM v WHERE node_id NOT IN (SELECT id FROM g) UNION ALL SELECT id, 'agent:x' FROM g")


def _renames(m):
    """Every function moves to a project of its own."""
    return m.nodes.filter("subtype = 'function'").select(F.col("id").alias("old_id"), F.concat(F.lit("moved-"), F.col("id")).alias("new_id"))


add("snk16_rename_edges", lambda m: mu.rename(m, _renames(m)).edges.select("id", "from_id", "to_id"),
    """r0 AS (SELECT id AS o, 'moved-' || id AS w FROM n WHERE subtype = 'function'),
    r AS (SELECT o, w FROM r0 UNION SELECT n.id, w || substr(n.id, length(o) + 1) FROM n JOIN r0 ON (contains(n.id, '@workflow') AND split_part(n.id, '@workflow', 1) = o) OR (contains(n.id, '::step-') AND split_part(n.id, '::step-', 1) = o)),
    z AS (SELECT edge_type, coalesce(a.w, from_id) AS from_id, coalesce(b.w, to_id) AS to_id FROM e LEFT JOIN r a ON a.o = from_id LEFT JOIN r b ON b.o = to_id) SELECT DISTINCT from_id || '::' || edge_type || '::' || to_id AS id, from_id, to_id FROM z""")  # fmt: skip
add("snk17_rename_history", lambda m: mu.rename(m, _renames(m)).history.select("id", "node_id"),
    """r0 AS (SELECT id AS o, 'moved-' || id AS w FROM n WHERE subtype = 'function'),
    r AS (SELECT o, w FROM r0 UNION SELECT n.id, w || substr(n.id, length(o) + 1) FROM n JOIN r0 ON (contains(n.id, '@workflow') AND split_part(n.id, '@workflow', 1) = o) OR (contains(n.id, '::step-') AND split_part(n.id, '::step-', 1) = o))
    SELECT h.id, coalesce(w, node_id) AS node_id FROM h LEFT JOIN r ON r.o = node_id""")  # fmt: skip
add("snk21_export", lambda m: mu.export_json(m).groupBy("kind").agg(F.count("*").alias("n")), "SELECT 'node' AS kind, count(*) AS n FROM n UNION ALL SELECT 'edge', count(*) FROM e")
add("api5_checkpoint", lambda m: mu.checkpoint_events(m, ["entity"], NOW, "0123456789abcdef", "x").history.filter("change_type = 'CHECKPOINT'").select("node_id", "git_sha"), "SELECT node_id, git_sha FROM h WHERE change_type = 'CHECKPOINT' UNION ALL SELECT id, '0123456789ab' FROM n WHERE node_type = 'entity'")


def _likely(m):
    """Lost nodes and all others as found ones, by the first two digits of their hashes, so that some are equal."""
    two = F.substring(F.lower("code_hash"), 1, 2).alias("code_hash")
    lost = m.nodes.filter("own_status = 'NOT_FOUND'").select("id", F.col("location").alias("scope"), two, F.col("level_2").alias("body"))
    return lost, m.nodes.filter("own_status <> 'NOT_FOUND'").select("id", F.col("location").alias("scope"), two, F.col("level_2").alias("body"), (F.length("id") % 3 > 0).alias("is_new"))


add("jn23_exact_renames", lambda m: rn.exact_matches(*_likely(m)).select("old_id", "new_id"),
    "a AS (SELECT substr(lower(code_hash), 1, 2) AS k, min(id) AS old_id FROM n WHERE own_status = 'NOT_FOUND' AND code_hash IS NOT NULL GROUP BY 1), b AS (SELECT substr(lower(code_hash), 1, 2) AS k, min(id) AS new_id FROM n WHERE own_status <> 'NOT_FOUND' AND code_hash IS NOT NULL AND length(id) % 3 > 0 GROUP BY 1) SELECT old_id, new_id FROM a JOIN b USING (k)")
add("stl17_rename_matcher", lambda m: rn.match(*rn.lost_and_found(m.nodes, m.current), pool_cap=None), None)
