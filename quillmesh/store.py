"""An index kept in a folder that all executors share: a version per write, and a file that names the one in force."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .mesh import Mesh

STEP = "array<struct<step_num:double,name:string,purpose:string,inputs:string,outputs:string,critical:string>>"
#: The tables of an index and their columns.
TABLES = {
    "nodes": f"id string, node_type string, subtype string, title string, location string, status string, source string, code_hash string, desc_hash string, file_mtime double, level_0 string, level_1 string, level_2 string, level_3_location string, level_steps {STEP}, dflow_meta string, own_status string, link_status string, updated_at timestamp",
    "edges": "id string, edge_type string, from_id string, to_id string, weight double, via string, event string, loaded_at timestamp",
    "tags": "node_id string, tag string",
    "history": "id bigint, node_id string, scanned_at timestamp, change_type string, git_sha string, meta string, preserved boolean",
    "docs": "id string, title string, tags array<string>, file_path string, desc_hash string, updated_at timestamp",
    "sections": "id string, doc_id string, heading string, content string, desc_hash string, updated_at timestamp, depth int, position int, parent_id string",
    "verification": "node_id string, status string, verified_at timestamp, verified_by string, reason string, code_hash_at string, desc_hash_at string",
    "current": "id string, gone boolean, cur_code string, cur_desc string",
    "renames": "old_id string, new_id string, renamed_at timestamp, file_path string",
}


def empty(spark: SparkSession) -> Mesh:
    """An index without a row."""
    return Mesh(**{t: spark.createDataFrame([], s) for t, s in TABLES.items()})


class _Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self.path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{x}")
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.spark = spark

    def current(self) -> str | None:
        rows = self.spark.read.text(f"{self.root}/CURRENT").collect() if self.fs.exists(self.path("CURRENT")) else []
        return rows[0][0] if rows else None

    def point(self, version: str) -> None:
        """Name the version in force: written beside and renamed, so that a reader sees the old or the new one."""
        part = self.path(f"CURRENT.{version}")
        out = self.fs.create(part, True)
        out.write(bytearray(version.encode()))
        out.close()
        if self.fs.exists(self.path("CURRENT")):
            self.fs.delete(self.path("CURRENT"), False)
        self.fs.rename(part, self.path("CURRENT"))


def save(m: Mesh, root: str) -> str:
    """Write all tables as a new version and put it in force; earlier versions stay until vacuum()."""
    spark = m.nodes.sparkSession
    f = _Folder(spark, root)
    version = uuid.uuid4().hex
    for t, s in TABLES.items():
        df: DataFrame | None = getattr(m, t)
        df = spark.createDataFrame([], s) if df is None else df
        want = spark.createDataFrame([], s).dtypes
        df.select(*[df[c].cast(k).alias(c) for c, k in want]).write.parquet(f"{f.root}/{version}/{t}")
    f.point(version)
    return version


def load(spark: SparkSession, root: str) -> Mesh:
    """The version in force; an empty index where there is none."""
    f = _Folder(spark, root)
    version = f.current()
    if version is None:
        return empty(spark)
    return Mesh(**{t: spark.read.schema(s).parquet(f"{f.root}/{version}/{t}") for t, s in TABLES.items()})


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete all versions but that in force; their number."""
    f = _Folder(spark, root)
    version, n = f.current(), 0
    if f.fs.exists(f.path("")):
        for s in f.fs.listStatus(f.path("")):
            if s.isDirectory() and s.getPath().getName() != version:
                f.fs.delete(s.getPath(), True)
                n += 1
    return n


def copy(spark: SparkSession, source: str, target: str, force: bool = False) -> bool:
    """Copy the version in force into another folder; one that holds an index already is left alone, unless forced."""
    if _Folder(spark, target).current() is not None and not force:
        return False
    save(load(spark, source), target)
    return True
