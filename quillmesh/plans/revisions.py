"""Queries and SQL of renames, revisions and net differences."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import SQL as MESH
from ..mesh import Mesh, open_mesh
from ..operators import rename as rn
from ..operators import revisions as rv
from ..runtime import table
from .registry import registry

QUERIES, SQL, add = registry()
NOW = datetime(2025, 7, 1)
SINCE = datetime(2024, 9, 1)


def _pairs(m: Mesh) -> DataFrame:
    """Every function, test and module beside the next one by id, as an old and a new name."""
    nxt = F.lead("id").over(Window.partitionBy(F.substring_index("id", "::", 1)).orderBy("id"))
    return m.nodes.filter("subtype in ('function', 'test', 'module')").select(F.col("id").alias("old_id"), nxt.alias("new_id")).filter("new_id is not null")


_PAIRS = "pr AS (SELECT id AS old_id, lead(id) OVER (PARTITION BY split_part(id, '::', 1) ORDER BY id) AS new_id FROM n WHERE subtype IN ('function', 'test', 'module') QUALIFY new_id IS NOT NULL), ap AS (SELECT old_id, new_id, a.own_status AS os, b.own_status AS ns FROM pr JOIN n a ON a.id = old_id JOIN n b ON b.id = new_id), ok AS (SELECT * FROM ap WHERE os = 'NOT_FOUND' AND ns <> 'NOT_FOUND')"
add("stl15_rename_results", lambda m: rn.apply_renames(m, _pairs(m), NOW)[1], f"{_PAIRS} SELECT old_id, new_id, os = 'NOT_FOUND' AND ns <> 'NOT_FOUND' AS applied, CASE WHEN os <> 'NOT_FOUND' THEN 'old_status_' || os WHEN ns = 'NOT_FOUND' THEN 'new_not_live' END AS reason FROM ap")
add("stl15_renamed_statuses", lambda m: rn.apply_renames(m, _pairs(m), NOW)[0].nodes.select("id", "own_status"),
    f"{_PAIRS}, nm AS (SELECT id AS o, ok.new_id || substr(id, length(old_id) + 1) AS w FROM n JOIN ok ON (contains(id, '@workflow') AND split_part(id, '@workflow', 1) = old_id) OR (contains(id, '::step-') AND split_part(id, '::step-', 1) = old_id)) SELECT coalesce(w, n.id) AS id, CASE WHEN n.id IN (SELECT new_id FROM ok) THEN 'RENAMED' ELSE own_status END AS own_status FROM n LEFT JOIN nm ON nm.o = n.id")
add("sup15_became_renamed", lambda m: rn.apply_renames(m, _pairs(m), NOW)[0].history.filter(F.col("scanned_at") == NOW).select("node_id", "change_type"), f"{_PAIRS} SELECT new_id AS node_id, 'BECAME_RENAMED' AS change_type FROM ok WHERE ns <> 'RENAMED'")
add("stl16_reverted_history", lambda m: rn.revert_renames(rn.apply_renames(m, _pairs(m), NOW)[0], _pairs(m).select("new_id"), NOW)[0].history.filter(F.col("scanned_at") != NOW).select("id", "node_id"),
    f"{_PAIRS}, kd AS (SELECT id, id AS o, regexp_replace(id, '(@workflow|::step-).*$', '') AS stem FROM n) SELECT h.id, CASE WHEN b.new_id IS NOT NULL THEN b.old_id WHEN c.new_id IS NOT NULL AND h.node_id IN (SELECT id FROM n) THEN c.old_id || substr(h.node_id, length(c.new_id) + 1) ELSE h.node_id END AS node_id FROM h LEFT JOIN ok b ON b.new_id = h.node_id LEFT JOIN ok c ON (contains(h.node_id, '@workflow') AND split_part(h.node_id, '@workflow', 1) = c.new_id) OR (contains(h.node_id, '::step-') AND split_part(h.node_id, '::step-', 1) = c.new_id)")
add("stl16_revert_results", lambda m: rn.revert_renames(rn.apply_renames(m, _pairs(m), NOW)[0], _pairs(m).select("new_id"), NOW)[1], f"{_PAIRS} SELECT pr.new_id, ok.old_id, ok.old_id IS NOT NULL AS reverted, CASE WHEN ok.old_id IS NULL THEN 'no_rename_record' END AS reason FROM pr LEFT JOIN ok USING (new_id)")


def _lines(m: Mesh) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(x) for x in ("A", "M", "D", "R095", "C080", "X")]), F.pmod(F.length("id"), F.lit(6)) + 1)
    two = F.pmod(F.length("id"), F.lit(6)).isin(3, 4)
    return m.nodes.select(F.concat(code, F.lit("\t"), F.replace("location", F.lit("/"), F.lit("\\")), F.when(two, F.concat(F.lit("\tnew/"), "id")).otherwise("")).alias("line"))


_LINES = "ln AS (SELECT length(id) % 6 AS k, location AS p, id FROM n)"
add("sup10_name_status", lambda m: rv.name_status(_lines(m)), f"{_LINES} SELECT CASE WHEN k IN (3, 4) THEN 'R' ELSE ['A', 'M', 'D'][k + 1] END AS change, CASE WHEN k >= 2 THEN p END AS old_path, CASE WHEN k IN (3, 4) THEN 'new/' || id WHEN k <> 2 THEN p END AS path FROM ln WHERE k < 5")
add("sup11_renames_only", lambda m: rv.name_status(_lines(m)).filter("change = 'R'").select("old_path", "path"), f"{_LINES} SELECT p AS old_path, 'new/' || id AS path FROM ln WHERE k IN (3, 4)")


def _renamed_paths(m: Mesh) -> DataFrame:
    loc = m.nodes.select("location").distinct()
    a = loc.filter("length(location) % 3 = 0").select(F.col("location").alias("old_path"), F.concat(F.lit("m/"), "location").alias("path"))
    b = a.filter("length(path) % 2 = 0").select(F.col("path").alias("old_path"), F.concat(F.lit("n/"), "path").alias("path"))
    return rv.rename_pairs(a, b.unionByName(loc.filter("length(location) % 3 = 1").select(F.col("location").alias("old_path"), F.concat(F.lit("w/"), "location").alias("path"))))


add("src24_rename_pairs", _renamed_paths, "lo AS (SELECT DISTINCT location AS p FROM n WHERE location IS NOT NULL) SELECT p AS old_path, CASE WHEN length(p) % 2 = 0 THEN 'n/m/' || p ELSE 'm/' || p END AS path FROM lo WHERE length(p) % 3 = 0 UNION ALL SELECT p, 'w/' || p FROM lo WHERE length(p) % 3 = 1")


def _commits(m: Mesh) -> DataFrame:
    """The shas of the history in the order of their first row."""
    return m.history.filter("git_sha is not null").groupBy(F.col("git_sha").alias("sha")).agg(F.min("id").alias("seq"))


add("src26_commits_ahead", lambda m: rv.commits_ahead(_commits(m), _commits(m).select(F.col("sha").alias("base")).union(_commits(m).select(F.concat(F.lit("zz"), "sha")))), "cm AS (SELECT git_sha AS sha, min(id) AS seq FROM h WHERE git_sha IS NOT NULL GROUP BY 1) SELECT sha AS base, (SELECT max(seq) FROM cm) - seq AS n FROM cm UNION ALL SELECT 'zz' || sha, NULL FROM cm")
add("sup12_head_sha", lambda m: m.history.filter("git_sha is not null").agg(F.max_by("git_sha", "id").alias("sha")), "SELECT arg_max(git_sha, id) AS sha FROM h WHERE git_sha IS NOT NULL")


def _net(spark: SparkSession, d: str) -> DataFrame:
    """Against the first snapshot of each id; files that no snapshot names are added, TypeScript ones count as renamed."""
    m, s = open_mesh(spark, d), table(spark, d, "node_snapshots")
    norm = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    base = s.groupBy("id").agg(F.min(F.struct("snapshot_no", "updated_at", "code_hash", "desc_hash")).alias("x")).select("id", norm("x.code_hash").alias("code_hash"), norm("x.desc_hash").alias("desc_hash"))
    seen = s.select("location").distinct().withColumn("seen", F.lit(True))
    change = F.when(F.col("location").endswith(".ts"), "R").when(F.col("seen").isNull(), "A").otherwise("M")
    changes = m.nodes.select("location").distinct().join(seen, "location", "left").select(F.col("location").alias("path"), change.alias("change"))
    nodes = m.nodes.select("id", "location", F.lower("code_hash").alias("code_hash"), F.lower("desc_hash").alias("desc_hash"))
    return rv.net_diff(nodes, changes, base, m.nodes.filter("code_hash is not null").select("id"))


_NET = """ba AS (SELECT id, nullif(lower(trim(code_hash)), '') AS oc, nullif(lower(trim(desc_hash)), '') AS od FROM node_snapshots QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_no, updated_at, code_hash NULLS FIRST, desc_hash NULLS FIRST) = 1),
nd AS (SELECT n.id, CASE WHEN ends_with(location, '.ts') THEN 'renamed' WHEN location NOT IN (SELECT location FROM node_snapshots WHERE location IS NOT NULL) THEN 'added' WHEN ba.id IS NULL THEN CASE WHEN code_hash IS NOT NULL THEN 'added' END
  WHEN oc IS NULL THEN NULL WHEN oc <> coalesce(lower(code_hash), '') AND od IS DISTINCT FROM lower(desc_hash) THEN 'content+desc' WHEN oc <> coalesce(lower(code_hash), '') THEN 'content' WHEN od IS DISTINCT FROM lower(desc_hash) THEN 'desc' END AS kind FROM n LEFT JOIN ba USING (id))"""
QUERIES["jn21_net_diff_by_hashes"] = _net
SQL["jn21_net_diff_by_hashes"] = f"WITH {MESH}, {_NET} SELECT id, kind FROM nd WHERE kind IS NOT NULL"
QUERIES["stl26_changes_since"] = lambda spark, d: rv.changes_since(open_mesh(spark, d), SINCE, _net(spark, d), F.lit(3).cast("long"))
SQL["stl26_changes_since"] = f"""WITH {MESH}, {_NET}, gh AS (SELECT node_id AS id, arg_min(meta, id) AS meta FROM h WHERE change_type = 'DELETED' AND scanned_at > TIMESTAMPTZ '2024-09-01 00:00:00+00' GROUP BY 1)
SELECT id, kind, false AS ghost, NULL::VARCHAR AS meta, 3 AS ahead FROM nd WHERE kind IS NOT NULL UNION ALL SELECT id, 'deleted', true, meta, 3 FROM gh WHERE id NOT IN (SELECT id FROM n)"""


def _blobs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The first delivery of each file as its blob at commit `base`, the last one as the file of now."""
    f = table(spark, d, "source_files").filter("location is not null")
    order = F.struct("delivered_at", "file_id")
    g = f.groupBy(F.col("location").alias("path")).agg(F.min_by("content", order).alias("a"), F.max_by("content", order).alias("b"))
    return g.select(F.lit("base").alias("git_sha"), "path", F.col("a").alias("content")), g.select("path", F.col("b").alias("content"))


def _node_diff(spark: SparkSession, d: str) -> DataFrame:
    m = open_mesh(spark, d)
    blobs, files = _blobs(spark, d)
    got = rv.node_diff(m, blobs, files, m.nodes.select("id", F.lit("base").alias("git_sha")))
    return got.select("id", fn.hash16("old").alias("old_hash"), fn.hash16("new").alias("new_hash"), "added", "removed")


_FILES = "fl AS (SELECT location AS path, arg_min(content, (delivered_at, file_id)) AS a, arg_max(content, (delivered_at, file_id)) AS b FROM source_files WHERE location IS NOT NULL GROUP BY 1)"
_SPAN = """sp AS (SELECT id, regexp_extract(level_3_location, '^(.*?)(?:#L\\d+(?:-L?\\d+)?)?$', 1) AS path, try_cast(nullif(regexp_extract(level_3_location, '#L(\\d+)', 1), '') AS INTEGER) AS s,
coalesce(try_cast(nullif(regexp_extract(level_3_location, '#L\\d+-L?(\\d+)', 1), '') AS INTEGER), try_cast(nullif(regexp_extract(level_3_location, '#L(\\d+)', 1), '') AS INTEGER)) AS t FROM n WHERE level_3_location IS NOT NULL)"""
QUERIES["stl27_node_diff"] = _node_diff
SQL["stl27_node_diff"] = f"""WITH {MESH}, {_FILES}, {_SPAN}, x AS (SELECT id, CASE WHEN s IS NULL THEN a ELSE array_to_string(string_split(a, chr(10))[greatest(s, 1):t], chr(10)) END AS o, CASE WHEN s IS NULL THEN b ELSE array_to_string(string_split(b, chr(10))[greatest(s, 1):t], chr(10)) END AS w FROM sp LEFT JOIN fl USING (path)),
y AS (SELECT id, o, w, string_split(coalesce(o, ''), chr(10)) AS ol, string_split(coalesce(w, ''), chr(10)) AS wl FROM x)
SELECT id, substr(sha256(o), 1, 16) AS old_hash, substr(sha256(w), 1, 16) AS new_hash, CAST(len(list_filter(wl, lambda v: NOT list_contains(ol, v))) AS INTEGER) AS added, CAST(len(list_filter(ol, lambda v: NOT list_contains(wl, v))) AS INTEGER) AS removed FROM y"""


def _recovered(spark: SparkSession, d: str) -> DataFrame:
    """As if every lost node had been deleted; those with ids of even length without their own commit."""
    m = open_mesh(spark, d)
    lost = m.nodes.filter("level_3_location is not null").select("id", fn.level3("level_3_location").getField("path").alias("location"), F.when(F.length("id") % 2 == 1, "base").alias("preserved_sha"), F.col("level_3_location").alias("preserved_level_3"), F.lit("base").alias("baseline_sha"))
    got = rv.recovered(lost, _blobs(spark, d)[0])
    return got.select("id", fn.hash16("text").alias("text_hash"), "how")


QUERIES["stl28_recovered"] = _recovered
SQL["stl28_recovered"] = f"""WITH {MESH}, {_FILES}, {_SPAN} SELECT id, substr(sha256(CASE WHEN length(id) % 2 = 1 AND s IS NOT NULL AND a IS NOT NULL THEN array_to_string(string_split(a, chr(10))[greatest(s, 1):t], chr(10)) ELSE a END), 1, 16) AS text_hash,
CASE WHEN length(id) % 2 = 1 AND s IS NOT NULL AND a IS NOT NULL THEN 'span' WHEN a IS NOT NULL THEN 'file' END AS how FROM sp LEFT JOIN fl USING (path)"""
