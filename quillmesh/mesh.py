"""The index as a set of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import blank, table


@dataclass(frozen=True)
class Mesh:
    """nodes, edges, tags, history, docs, sections, verification, current (the state last seen on disk) and, once there are
    any, renames (old_id, new_id, renamed_at, file_path).

    Operators take a Mesh or single tables and return DataFrames; mutations return a new Mesh.
    """

    nodes: DataFrame
    edges: DataFrame
    tags: DataFrame
    history: DataFrame
    docs: DataFrame
    sections: DataFrame
    verification: DataFrame
    current: DataFrame
    renames: DataFrame | None = None

    def but(self, **tables: DataFrame) -> Mesh:
        return replace(self, **tables)


def latest_nodes(nodes: DataFrame) -> DataFrame:
    """The last delivery of each id. As a window, so that only the columns in use are shuffled, a row per id and task."""
    w = Window.partitionBy("id").orderBy(F.desc("loaded_at"), F.desc("updated_at"), F.desc("code_hash"))
    return nodes.filter("id is not null").withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "loaded_at")


def clean_edges(edges: DataFrame) -> DataFrame:
    """One row per edge: the type in lower case without outer blanks, both ends present, repeated deliveries merged."""
    kind = F.lower(F.trim("edge_type"))
    ok = edges.filter(~blank("from_id") & ~blank("to_id") & F.col("edge_type").isNotNull()).withColumn("edge_type", kind)
    one = ok.groupBy("edge_type", "from_id", "to_id").agg(F.max("weight").alias("weight"), F.max(F.element_at("meta", "via")).alias("via"), F.max(F.element_at("meta", "event")).alias("event"), F.min("loaded_at").alias("loaded_at"))
    return one.select(F.concat_ws("::", "from_id", "edge_type", "to_id").alias("id"), "*")


def observed(snapshots: DataFrame) -> DataFrame:
    """id, cur_code, cur_desc as of the last snapshot; gone for ids that only earlier snapshots hold."""
    one = snapshots.groupBy("id").agg(F.max(F.struct("snapshot_no", "updated_at", "code_hash", "desc_hash")).alias("m"))
    last = snapshots.agg(F.max("snapshot_no").alias("last_no"))
    norm = lambda c: F.nullif(F.lower(F.trim(F.col(c))), F.lit(""))
    return one.crossJoin(F.broadcast(last)).select("id", (F.col("m.snapshot_no") < F.col("last_no")).alias("gone"), norm("m.code_hash").alias("cur_code"), norm("m.desc_hash").alias("cur_desc"))


def open_mesh(spark: SparkSession, d: str) -> Mesh:
    """The index over the tables of a folder."""
    nodes = latest_nodes(table(spark, d, "nodes"))
    tags = table(spark, d, "tags").filter("node_id is not null and tag is not null").select("node_id", F.lower("tag").alias("tag")).distinct()
    docjson = nodes.filter("subtype = 'docjson'")
    own = tags.groupBy("node_id").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    docs = docjson.filter("node_type = 'composite_process'").select("id", F.col("level_1").alias("title"), F.col("location").alias("file_path"), "desc_hash", "updated_at")
    docs = docs.join(own, docs.id == own.node_id, "left").select("id", "title", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "file_path", "desc_hash", "updated_at")
    parts = F.split("id", "::")
    sec = docjson.filter("node_type = 'atomic_process'").select("id", F.concat_ws("::", F.get(parts, 0), F.get(parts, 1)).alias("doc_id"), F.col("level_1").alias("heading"), F.col("level_2").alias("content"), "desc_hash", "updated_at")
    depth = F.length("id") - F.length(F.replace("id", F.lit("."), F.lit(""))) - F.length("doc_id") + F.length(F.replace("doc_id", F.lit("."), F.lit("")))
    sec = sec.withColumn("depth", depth).withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("id")) - 1)
    sec = sec.withColumn("parent_id", F.when(F.col("depth") > 0, F.regexp_replace("id", r"\.[^.]*$", "")))
    return Mesh(nodes, clean_edges(table(spark, d, "edges")), tags, table(spark, d, "node_history"), docs, sec, table(spark, d, "node_verification"), observed(table(spark, d, "node_snapshots")))


#: The same projection in SQL, as common table expressions n, e, t, h, d, s, v, cur.
SQL = """
n AS (SELECT * EXCLUDE (loaded_at) FROM nodes WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, updated_at DESC, code_hash DESC) = 1),
e AS (SELECT from_id || '::' || k || '::' || to_id AS id, k AS edge_type, from_id, to_id, weight, via, event, loaded_at FROM (
  SELECT lower(trim(edge_type)) AS k, from_id, to_id, max(weight) AS weight, max(meta['via']) AS via, max(meta['event']) AS event, min(loaded_at) AS loaded_at
  FROM edges WHERE trim(from_id) <> '' AND trim(to_id) <> '' AND edge_type IS NOT NULL GROUP BY ALL)),
t AS (SELECT DISTINCT node_id, lower(tag) AS tag FROM tags WHERE node_id IS NOT NULL AND tag IS NOT NULL),
h AS (SELECT * FROM node_history),
v AS (SELECT * FROM node_verification),
d AS (SELECT id, level_1 AS title, location AS file_path, desc_hash, updated_at FROM n WHERE subtype = 'docjson' AND node_type = 'composite_process'),
s AS (SELECT *, CASE WHEN depth > 0 THEN regexp_replace(id, '\\.[^.]*$', '') END AS parent_id, row_number() OVER (PARTITION BY doc_id ORDER BY id) - 1 AS position FROM (
  SELECT id, split_part(id, '::', 1) || '::' || split_part(id, '::', 2) AS doc_id, level_1 AS heading, level_2 AS content, desc_hash, updated_at,
    length(split_part(id, '::', 3)) - length(replace(split_part(id, '::', 3), '.', '')) AS depth
  FROM n WHERE subtype = 'docjson' AND node_type = 'atomic_process')),
cur AS (SELECT id, snapshot_no < (SELECT max(snapshot_no) FROM node_snapshots) AS gone, nullif(lower(trim(code_hash)), '') AS cur_code, nullif(lower(trim(desc_hash)), '') AS cur_desc FROM node_snapshots
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY snapshot_no DESC, updated_at DESC, code_hash DESC NULLS LAST, desc_hash DESC NULLS LAST) = 1)"""
