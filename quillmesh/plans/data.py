"""Queries of the general data problems p2, p3, p4, p5 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import flatten, hierarchy, references, snapshots, versions
from ..runtime import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    nodes, history = table(spark, d, "nodes"), table(spark, d, "node_history")
    refs = references.index_references(table(spark, d, "edges"), table(spark, d, "node_verification"))
    ids = nodes.select(F.col("id").alias("key"), F.col("loaded_at").alias("seen_at"))
    return references.orphan_references(refs, ids, history.filter("change_type = 'DELETED'").select(F.col("node_id").alias("key")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "ref_field", "row_key", "kind")


def p2_by_month(spark: SparkSession, d: str) -> DataFrame:
    by = references.by_period(_orphans(spark, d))
    return by.select("table_name", "ref_field", F.date_format("period", "yyyy-MM").alias("month"), "kind", "n")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(hierarchy.composes_links(table(spark, d, "edges"))).select("node_id", "root_id", "depth")


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.hierarchy(hierarchy.composes_links(table(spark, d, "edges")), with_paths=True)
    return h.select("node_id", "root_id", "depth", F.array_join("path", " / ").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(hierarchy.composes_links(table(spark, d, "edges")), with_paths=True))


def p3_all_paths(spark: SparkSession, d: str) -> DataFrame:
    h = hierarchy.all_paths(hierarchy.composes_links(table(spark, d, "edges")))
    return h.select("node_id", "root_id", "depth", F.array_join("path", " / ").alias("path"))


def p3_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(hierarchy.all_paths(hierarchy.composes_links(table(spark, d, "edges"))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.manifest_sections(table(spark, d, "cycle_manifests"))


def p4_sections(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of sections: their own fields beside the key of what holds them, at every depth."""
    m = table(spark, d, "cycle_manifests")
    plan = flatten.layout(m, "raw", "manifest", "sections")
    s = flatten.flat_table(flatten.shred(m, "manifest_id", "raw", plan, ["sections"], ["id", "heading", "content"]), "sections", ["id", "heading", "content"])
    return s.select(F.col("record_id").alias("manifest_id"), "pos_path", "parent_table", "parent_path", F.coalesce("id", "entry_key", F.lit("")).alias("section_id"), "heading", "content")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "cycle_manifests")
    plan = flatten.layout(m, "raw", "manifest", "sections")
    links = flatten.flat_table(flatten.shred(m, "manifest_id", "raw", plan, ["sections", "links"]), "links", ["node_id"])
    return links.select(F.col("record_id").alias("manifest_id"), "pos_path", "parent_table", "parent_path", "node_id")


def p4_tags(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "cycle_manifests")
    plan = flatten.layout(m, "raw", "manifest", "sections")
    tags = flatten.flat_table(flatten.shred(m, "manifest_id", "raw", plan, ["sections", "tags"]), "tags", [])
    return tags.select(F.col("record_id").alias("manifest_id"), "pos_path", "parent_table", "parent_path", F.col("value").alias("tag"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "node_history").filter(~F.col("change_type").eqNullSafe("CHECKPOINT"))
    return versions.versions(h, "node_id", "scanned_at", ["change_type", "git_sha"], "id", ends=F.col("change_type") == "DELETED")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    v = _versions(spark, d)
    return v.select("node_id", F.unix_micros("valid_from").alias("valid_from_us"), F.coalesce(F.unix_micros("valid_to"), F.lit(-1)).alias("valid_to_us"))


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "node_snapshots"), "snapshot_no", "id", "updated_at", ["code_hash", "desc_hash"])


QUERIES = {f.__name__: f for f in (p2_found, p2_by_month, p3_found, p3_paths, p3_descendants, p3_all_paths, p3_all_descendants, p4_found, p4_sections, p4_links, p4_tags, p5_found, p5_versions, p7_found)}

_REFS = """
ref AS (
  SELECT 'edges' AS table_name, 'from_id' AS ref_field, id AS row_key, min(from_id) AS key, min(loaded_at) AS t FROM edges GROUP BY id
  UNION ALL SELECT 'edges', 'to_id', id, min(to_id), min(loaded_at) FROM edges GROUP BY id
  UNION ALL SELECT 'node_verification', 'node_id', node_id, node_id, min(verified_at) FROM node_verification GROUP BY node_id
), seen AS (SELECT id, min(loaded_at) AS t FROM nodes GROUP BY id),
gone AS (SELECT DISTINCT node_id FROM node_history WHERE change_type = 'DELETED'),
cases AS (
  SELECT r.*, CASE WHEN s.id IS NULL THEN CASE WHEN g.node_id IS NULL THEN 'missing' ELSE 'deleted' END WHEN s.t > r.t THEN 'late' END AS kind
  FROM ref r LEFT JOIN seen s ON s.id = r.key LEFT JOIN gone g ON g.node_id = r.key
  WHERE r.key IS NOT NULL AND trim(r.key) <> ''
)"""

_TREE = """
c AS (SELECT id, from_id, to_id, min(loaded_at) AS t FROM edges WHERE lower(trim(edge_type)) = 'composes' AND trim(from_id) <> '' AND trim(to_id) <> '' GROUP BY ALL),
pick AS (SELECT to_id AS node, from_id AS parent FROM c QUALIFY row_number() OVER (PARTITION BY to_id ORDER BY t DESC, from_id) = 1),
ids AS (SELECT to_id AS node FROM c UNION SELECT from_id FROM c),
tree AS (
  SELECT node, node AS root, 0 AS depth, [node] AS path FROM ids WHERE node NOT IN (SELECT node FROM pick)
  UNION ALL SELECT p.node, t.root, t.depth + 1, list_append(t.path, p.node) FROM tree t JOIN pick p ON p.parent = t.node
),
lost AS (SELECT node FROM ids WHERE node NOT IN (SELECT node FROM tree)),
up AS (
  SELECT node AS start, node AS cur, [node] AS seen FROM lost
  UNION ALL SELECT u.start, p.parent, list_append(u.seen, p.parent) FROM up u JOIN pick p ON p.node = u.cur WHERE NOT list_contains(u.seen, p.parent)
),
ends AS (SELECT start, seen, p.parent AS again FROM up u JOIN pick p ON p.node = u.cur WHERE list_contains(u.seen, p.parent)),
ring AS (SELECT start AS node, list_min(seen[list_position(seen, again):]) AS root FROM ends)"""

#: What hangs below circles, from the first id outside.
_BELOW = """
member AS (SELECT DISTINCT unnest(seen[list_position(seen, again):]) AS node FROM ends),
below AS (
  SELECT node, [node] AS path FROM pick WHERE parent IN (SELECT node FROM member) AND node NOT IN (SELECT node FROM member)
  UNION ALL SELECT p.node, list_append(b.path, p.node) FROM below b JOIN pick p ON p.parent = b.node
)"""

_RUNS = """
o AS (SELECT node_id, scanned_at AS t, change_type, git_sha FROM node_history WHERE change_type IS DISTINCT FROM 'CHECKPOINT' AND node_id IS NOT NULL AND scanned_at IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY node_id, scanned_at ORDER BY id DESC) = 1),
f AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR change_type IS DISTINCT FROM lag(change_type) OVER w OR git_sha IS DISTINCT FROM lag(git_sha) OVER w THEN 1 ELSE 0 END AS s FROM o WINDOW w AS (PARTITION BY node_id ORDER BY t)),
v AS (SELECT node_id, change_type, git_sha, t AS valid_from, lead(t) OVER (PARTITION BY node_id ORDER BY t) AS valid_to FROM f WHERE s = 1)"""

SQL = {
    "p2_found": f"WITH {_REFS} SELECT table_name, ref_field, row_key, kind FROM cases WHERE kind IS NOT NULL",
    "p2_by_month": f"WITH {_REFS} SELECT table_name, ref_field, strftime(t, '%Y-%m') AS month, kind, count(*) AS n FROM cases WHERE kind IS NOT NULL GROUP BY ALL",
    "p3_found": f"WITH RECURSIVE {_TREE} SELECT node AS node_id, root AS root_id, CAST(depth AS INTEGER) AS depth FROM tree UNION ALL SELECT node, root, -1 FROM ring",
    "p3_paths": f"WITH RECURSIVE {_TREE} SELECT node AS node_id, root AS root_id, CAST(depth AS INTEGER) AS depth, array_to_string(path, ' / ') AS path FROM tree UNION ALL SELECT node, root, -1, NULL FROM ring",
    "p3_descendants": f"WITH RECURSIVE {_TREE} SELECT path[i] AS ancestor_id, node AS node_id, CAST(len(path) - i AS INTEGER) AS distance FROM (SELECT node, path, unnest(range(1, len(path))) AS i FROM tree)",
    "p3_all_paths": f"WITH RECURSIVE {_TREE}, {_BELOW} SELECT node AS node_id, root AS root_id, CAST(depth AS INTEGER) AS depth, array_to_string(path, ' / ') AS path FROM tree UNION ALL SELECT r.node, r.root, -1, array_to_string(b.path, ' / ') FROM ring r LEFT JOIN below b USING (node)",
    "p3_all_descendants": f"WITH RECURSIVE {_TREE}, {_BELOW} SELECT path[i] AS ancestor_id, node AS node_id, CAST(len(path) - i AS INTEGER) AS distance FROM (SELECT node, path, unnest(range(1, len(path))) AS i FROM (SELECT node, path FROM tree UNION ALL SELECT node, path FROM below))",
    "p5_found": f"WITH {_RUNS} SELECT node_id, epoch_us(valid_from) AS valid_from_us, coalesce(epoch_us(valid_to), -1) AS valid_to_us FROM v WHERE change_type IS DISTINCT FROM 'DELETED'",
    "p5_versions": f"WITH {_RUNS} SELECT node_id, change_type, git_sha, valid_from, valid_to FROM v WHERE change_type IS DISTINCT FROM 'DELETED'",
    "p7_found": """WITH s AS (SELECT snapshot_no, id, nullif(lower(trim(code_hash)), '') AS c, nullif(lower(trim(desc_hash)), '') AS h FROM node_snapshots
  QUALIFY row_number() OVER (PARTITION BY snapshot_no, id ORDER BY updated_at DESC, nullif(lower(trim(code_hash)), '') DESC NULLS LAST, nullif(lower(trim(desc_hash)), '') DESC NULLS LAST) = 1),
n AS (SELECT snapshot_no, lag(snapshot_no) OVER (ORDER BY snapshot_no) AS prev FROM (SELECT DISTINCT snapshot_no FROM node_snapshots)),
cur AS (SELECT s.*, n.prev FROM s JOIN n USING (snapshot_no) WHERE prev IS NOT NULL),
old AS (SELECT n.snapshot_no, s.id, s.c, s.h FROM s JOIN n ON n.prev = s.snapshot_no)
SELECT snapshot_no, id, CASE WHEN old.id IS NULL THEN 'added' WHEN cur.id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM (SELECT *, id AS k FROM cur) cur FULL JOIN (SELECT *, id AS k FROM old) old USING (snapshot_no, id)
WHERE old.k IS NULL OR cur.k IS NULL OR cur.c IS DISTINCT FROM old.c OR cur.h IS DISTINCT FROM old.h""".replace("old.id IS NULL", "old.k IS NULL").replace("cur.id IS NULL", "cur.k IS NULL"),
}
