"""Queries of the sources: code, markdown and documents in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import SQL as MESH
from ..mesh import open_mesh
from ..operators import build, flatten
from ..runtime import table
from ..sources import project, scan, scripts


def _files(spark: SparkSession, d: str) -> DataFrame:
    """The last delivery of each location."""
    f = table(spark, d, "source_files").filter("location is not null")
    return f.groupBy("location").agg(F.max_by(F.struct("lang", "content"), F.struct("delivered_at", "file_id")).alias("f")).select("location", "f.lang", "f.content")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return scan.python_facts(_files(spark, d).filter("lang = 'python'"))


def src1_python_nodes(spark: SparkSession, d: str) -> DataFrame:
    return scan.python_nodes(_facts(spark, d))


def src1_python_edges(spark: SparkSession, d: str) -> DataFrame:
    return scan.python_edges(_facts(spark, d))


def src12_markdown_sections(spark: SparkSession, d: str) -> DataFrame:
    return scan.markdown_sections(table(spark, d, "documents"), "doc_id", "text")


def src16_docjson_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of at most three levels, as the index takes them; deeper ones are left out."""
    m = table(spark, d, "cycle_manifests")
    plan = flatten.layout(m, "raw", "manifest", "sections")
    s = flatten.flat_table(flatten.shred(m, "manifest_id", "raw", plan, ["sections"]), "sections", ["id", "heading", "content"])
    depth = F.size(F.split("pos_path", r"\.")) - 1
    ok = s.withColumn("depth", depth).filter("depth <= 2")
    return ok.select(F.col("record_id").alias("manifest_id"), "pos_path", "depth", F.coalesce("id", "entry_key").alias("id"), "heading", fn.hash16(fn.strip_html(F.coalesce("content", F.lit("")))).alias("code_hash"))


def src16_skipped_sections(spark: SparkSession, d: str) -> DataFrame:
    """The sections that src16_docjson_sections leaves out, as they lie below the third level: what the index warns of."""
    m = table(spark, d, "cycle_manifests")
    plan = flatten.layout(m, "raw", "manifest", "sections")
    s = flatten.flat_table(flatten.shred(m, "manifest_id", "raw", plan, ["sections"], ["id"]), "sections", ["id"])
    depth = F.size(F.split("pos_path", r"\.")) - 1
    return s.filter(depth > 2).select(F.col("record_id").alias("manifest_id"), "pos_path", depth.alias("depth"), F.coalesce("id", "entry_key").alias("id"))


def src18_file_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("location", fn.hash16("content").alias("code_hash"), fn.dotted("location").alias("dotted"))


def src23_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files as first against as last delivered."""
    f = table(spark, d, "source_files").filter("location is not null")
    first = f.groupBy("location").agg(F.min_by("content", F.struct("delivered_at", "file_id")).alias("c"))
    return scan.changed_files(first.select(F.col("location").alias("path"), fn.hash16("c").alias("content_hash")), _files(spark, d).select(F.col("location").alias("path"), fn.hash16("content").alias("content_hash")))


def _scripts(spark: SparkSession, d: str) -> DataFrame:
    return scripts.script_facts(_files(spark, d).filter("lang = 'javascript'"))


def src7_script_nodes(spark: SparkSession, d: str) -> DataFrame:
    return scan.fact_nodes(_scripts(spark, d)).select("id", "node_type", "subtype", "title", "location", "level_1", "level_3_location", "code_hash", "desc_hash")


def src8_script_edges(spark: SparkSession, d: str) -> DataFrame:
    return scan.fact_edges(_scripts(spark, d)).drop("meta")


def src12_markdown_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The pages as files of markdown."""
    docs = table(spark, d, "documents").filter("text is not null").select(F.concat(F.lit("pages/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("location"), F.col("text").alias("content"))
    return project.markdown_nodes(docs).select("id", "parent", "node_type", "code_hash")


def src18_config_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Source files as if they were configuration, by turns of each ending."""
    end = F.element_at(F.array(*[F.lit(x) for x in (".MD", ".json", ".yaml", ".yml", ".toml", ".txt")]), F.pmod(F.length("location"), F.lit(6)) + 1)
    return project.config_nodes(_files(spark, d).select(F.concat(F.regexp_replace("location", r"\.[A-Za-z]+$", ""), end).alias("location"), "content")).select("id", "title", "kind", "code_hash")


def src22_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cycle_manifests").filter(scan.is_docjson(F.col("raw"))).select("manifest_id")


def stl4_files_to_read(spark: SparkSession, d: str) -> DataFrame:
    """Files whose last delivery is newer than what the index has of them."""
    f = _files(spark, d).join(table(spark, d, "source_files").groupBy("location").agg((F.unix_micros(F.max("delivered_at")) / 1e6).alias("file_mtime")), "location")
    stored = table(spark, d, "nodes").filter("file_mtime is not null").groupBy("location").agg(F.max("file_mtime").alias("file_mtime"))
    return project.changed_since(f, stored).select("location")


def stl3_same_text(spark: SparkSession, d: str) -> DataFrame:
    """Files whose last delivery has the text of their first one."""
    first = table(spark, d, "source_files").filter("location is not null").groupBy("location").agg(F.min_by("content", F.struct("delivered_at", "file_id")).alias("a"))
    return _files(spark, d).join(first.select("location", fn.hash16("a").alias("anchor")), "location").select("location", project.same_text("content", "anchor").alias("same"))


def stl22_stale_locations(spark: SparkSession, d: str) -> DataFrame:
    return build.stale_locations(open_mesh(spark, d), _files(spark, d), ["cache"])


def set1_orphan_links(spark: SparkSession, d: str) -> DataFrame:
    """Documents links of all sections, of which those to ids of even length are still intended."""
    m = open_mesh(spark, d)
    return build.orphan_links(m.edges, m.edges.filter("edge_type = 'documents' and length(to_id) % 2 = 0"), m.sections)


def stl9_current_hashes(spark: SparkSession, d: str) -> DataFrame:
    return build.current_hashes(open_mesh(spark, d).nodes, _files(spark, d)).groupBy("state").agg(F.count("*").alias("n"))


def sup50_matched_roots(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("location", project.matched_root("location", ["heron0/store", "heron0", "tarn3/"]).alias("root"), project.root_prefix("location").alias("prefix"))


QUERIES = {f.__name__: f for f in (src7_script_nodes, src8_script_edges, src12_markdown_nodes, src18_config_nodes, src22_documents, stl4_files_to_read, stl3_same_text, stl22_stale_locations, set1_orphan_links, stl9_current_hashes, sup50_matched_roots, src1_python_nodes, src1_python_edges, src12_markdown_sections, src16_docjson_sections, src16_skipped_sections, src18_file_hashes, src23_changed_files)}
_LAST = "l AS (SELECT * FROM source_files WHERE location IS NOT NULL QUALIFY row_number() OVER (PARTITION BY location ORDER BY delivered_at DESC, file_id DESC) = 1)"
SQL = {
    "src12_markdown_nodes": """WITH b AS (SELECT 'pages' || '::' || replace(source || '/d' || doc_id, '/', '.') AS id, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), p AS (SELECT id, regexp_split_to_array(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?s)```.*?```', '', 'g'), '(?m)^## ') AS a FROM b), q AS (SELECT id, unnest(a[2:]) AS part FROM p)
SELECT id, NULL::VARCHAR AS parent, 'composite_process' AS node_type, substr(sha256(text), 1, 16) AS code_hash FROM b
UNION ALL SELECT id || '#' || regexp_replace(regexp_replace(lower(trim(split_part(part, chr(10), 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), id, 'atomic_process', substr(sha256(regexp_replace(substr(part, length(split_part(part, chr(10), 1)) + 1), '^\\s+|\\s+$', '', 'g')), 1, 16) FROM q""",
    "src18_config_nodes": f"""WITH {_LAST}, x AS (SELECT regexp_replace(location, '\\.[A-Za-z]+$', '') AS stem, ['.MD', '.json', '.yaml', '.yml', '.toml', '.txt'][length(location) % 6 + 1] AS ending, content FROM l)
SELECT split_part(stem, '/', 1) || '::config.' || replace(substr(stem, length(split_part(stem, '/', 1)) + 2), '/', '.') AS id, list_last(string_split(stem, '/')) || ending AS title, lower(substr(ending, 2)) AS kind, substr(sha256(content), 1, 16) AS code_hash FROM x WHERE ending <> '.txt' AND content IS NOT NULL""",
    "src22_documents": "SELECT manifest_id FROM cycle_manifests WHERE CASE WHEN json_valid(raw) THEN json_type(raw, '$.title') = 'VARCHAR' AND json_type(raw, '$.sections') = 'ARRAY' ELSE false END",
    "stl4_files_to_read": f"WITH {_LAST} SELECT l.location FROM l LEFT JOIN (SELECT location, max(file_mtime) AS t FROM nodes WHERE file_mtime IS NOT NULL GROUP BY 1) s USING (location) WHERE t IS NULL OR epoch_us(l.delivered_at) / 1e6 > t",
    "stl3_same_text": f"WITH {_LAST}, f AS (SELECT * FROM source_files WHERE location IS NOT NULL QUALIFY row_number() OVER (PARTITION BY location ORDER BY delivered_at, file_id) = 1) SELECT location, l.content = f.content AS same FROM l JOIN f USING (location)",
    "stl22_stale_locations": f"WITH {MESH}, {_LAST} SELECT id FROM n WHERE node_type <> 'entity' AND location <> '' AND (location NOT IN (SELECT location FROM l) OR list_contains(string_split(location, '/'), 'cache'))",
    "set1_orphan_links": f"WITH {MESH} SELECT DISTINCT from_id, to_id FROM e WHERE edge_type = 'documents' AND from_id IN (SELECT id FROM s) AND length(to_id) % 2 <> 0",
    "sup50_matched_roots": f"WITH {_LAST} SELECT location, CASE WHEN starts_with(location, 'heron0/store/') THEN 'heron0/store' WHEN starts_with(location, 'heron0/') THEN 'heron0' WHEN starts_with(location, 'tarn3/') THEN 'tarn3' END AS root, replace(location, '/', '.') AS prefix FROM l",
    "src12_markdown_sections": """WITH p AS (SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?s)```.*?```', '', 'g'), '(?m)^## ') AS a FROM documents),
q AS (SELECT doc_id, unnest(a[2:]) AS part, unnest(range(1, len(a))) AS position FROM p)
SELECT doc_id, CAST(position AS INTEGER) AS position, trim(split_part(part, chr(10), 1)) AS heading, regexp_replace(regexp_replace(lower(trim(split_part(part, chr(10), 1))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
substr(sha256(regexp_replace(substr(part, length(split_part(part, chr(10), 1)) + 1), '^\\s+|\\s+$', '', 'g')), 1, 16) AS body_hash FROM q""",
    "src18_file_hashes": f"WITH {_LAST} SELECT location, substr(sha256(content), 1, 16) AS code_hash, replace(regexp_replace(regexp_replace(location, '\\.[A-Za-z]+$', ''), '/(__init__|index)$', ''), '/', '.') AS dotted FROM l",
    "src23_changed_files": f"WITH {_LAST}, f AS (SELECT * FROM source_files WHERE location IS NOT NULL QUALIFY row_number() OVER (PARTITION BY location ORDER BY delivered_at, file_id) = 1) SELECT l.location AS path, 'M' AS change, NULL AS old_path FROM l JOIN f USING (location) WHERE l.content <> f.content",
}
