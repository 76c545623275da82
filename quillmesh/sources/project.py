"""A project on disk: its configuration, its files as rows, and the list of known projects."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Collection
from dataclasses import dataclass, field, fields
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..operators.render import Target, parse_targets
from ..operators.validation import RULES
from .scan import is_docjson, markdown_sections

# Folders that are never read, and the endings of each kind of file.
SKIPPED = (".git", ".hg", ".venv", "venv", "node_modules", "__pycache__", ".mypy_cache", ".pytest_cache", "dist", "build")
ENDINGS = {"python": (".py",), "script": (".js", ".jsx", ".ts", ".tsx"), "config": (".md", ".json", ".yaml", ".yml", ".toml"), "docs": (".json",), "markdown": (".md",)}


@dataclass(frozen=True)
class Config:
    """What a project's TOML file says; each field has a default."""

    project_id: str = ""
    docs_dirs: tuple[str, ...] = ("docs",)
    exclude_dirs: tuple[str, ...] = ()
    script_paths: tuple[str, ...] = ()
    config_dirs: tuple[str, ...] = ()
    transitive_tags: tuple[str, ...] = ("consumer",)
    frozen_tags: tuple[str, ...] = ("frozen",)
    rules_off: tuple[str, ...] = ()
    rename_threshold: float = 0.6
    rename_pool_cap: int | None = 50
    targets: tuple[Target, ...] = field(default_factory=tuple)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Read a TOML file; one that is missing gives the defaults. Unknown fields, rules and wrong types are errors."""
        p = Path(path)
        raw = tomllib.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
        known = {f.name: f for f in fields(cls)}
        if extra := sorted(set(raw) - set(known)):
            raise ValueError(f"unknown fields: {extra}")
        got: dict = {}
        for k, v in raw.items():
            want = known[k].default if k != "targets" else ()
            if isinstance(want, tuple):
                if not isinstance(v, list):
                    raise ValueError(f"{k} is no list")
                got[k] = tuple(parse_targets(v)) if k == "targets" else tuple(str(x) for x in v)
            elif isinstance(want, str) and not isinstance(v, str) or isinstance(want, float) and not isinstance(v, int | float) or k == "rename_pool_cap" and not isinstance(v, int):
                raise ValueError(f"{k} is of another type")
            else:
                got[k] = v
        if wrong := sorted(set(got.get("rules_off", ())) - set(RULES)):
            raise ValueError(f"unknown rules: {wrong}")
        return cls(**({"project_id": p.parent.resolve().name} | got))


def index_path(root: str | Path) -> str:
    """Where the index of a project is kept."""
    return f"{str(root).rstrip('/')}/.quillmesh/index"


def not_skipped(path: Column, skip: Collection[str] = SKIPPED) -> Column:
    """Whether no folder of a path is one of those to skip."""
    return ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in skip])) if skip else F.lit(True)


def list_files(spark: SparkSession, root: str, kind: str, below: Collection[str] = (), skip: Collection[str] = SKIPPED, with_text: bool = True) -> DataFrame:
    """location (relative to the folder above root), file_mtime (seconds), content of the files of a kind, each once, whatever
    globs of below (paths under root) name it. Text that is no UTF-8 has marks in the place of the wrong bytes."""
    base = os.path.abspath(root).rstrip("/")
    name = os.path.basename(base)
    paths = [f"file://{base}/{x}" for x in below] or [f"file://{base}"]
    ends = "|".join(x.replace(".", r"\.") for x in ENDINGS[kind])
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    rel = F.concat(F.lit(name), F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), f"^{base}", ""))
    rows = raw.withColumn("location", rel).filter(F.col("location").rlike(f"({ends})$")).filter(not_skipped(F.col("location"), skip))
    text = [F.decode("content", "utf-8").alias("content")] if with_text else []
    return rows.dropDuplicates(["location"]).select("location", (F.unix_micros("modificationTime") / 1e6).alias("file_mtime"), *text)


def unchanged(stored: Column, current: Column, slop: float = 0.0) -> Column:
    """Whether a file is no newer than when it was stored; one without a stored time is."""
    return F.coalesce(current <= stored + F.lit(slop), F.lit(False))


def changed_since(files: DataFrame, stored: DataFrame, slop: float = 0.0) -> DataFrame:
    """The files (location, file_mtime) to be read again, against stored (location, file_mtime)."""
    s = stored.select("location", F.col("file_mtime").alias("_was"))
    return files.join(s, "location", "left").filter(~unchanged(F.col("_was"), F.col("file_mtime"), slop)).drop("_was")


def same_text(content: Column | str, anchor_hash: Column | str) -> Column:
    """Whether a file's text has the hash that its module node carries: the check behind a newer time."""
    return F.coalesce(fn.hash16(content) == (F.col(anchor_hash) if isinstance(anchor_hash, str) else anchor_hash), F.lit(False))


def config_nodes(files: DataFrame, prefix: str = "config") -> DataFrame:
    """A node per configuration file (location, content), hashed as a whole; files of other endings are left out."""
    ends = "|".join(x.replace(".", r"\.") for x in ENDINGS["config"])
    rows = files.filter(F.col("location").isNotNull() & F.col("content").isNotNull() & F.lower("location").rlike(f"({ends})$"))
    project, rest = F.substring_index("location", "/", 1), F.expr("substr(location, length(substring_index(location, '/', 1)) + 2)")
    dots = F.replace(F.regexp_replace(rest, r"\.[A-Za-z]+$", ""), F.lit("/"), F.lit("."))
    title = F.substring_index("location", "/", -1)
    return rows.select(F.concat(project, F.lit(f"::{prefix}."), dots).alias("id"), F.lit("composite_process").alias("node_type"), F.lit("config").alias("subtype"), title.alias("title"), "location", F.lower(F.regexp_extract("location", r"\.([A-Za-z]+)$", 1)).alias("kind"), fn.hash16("content").alias("code_hash"), F.col("location").alias("level_3_location"))


def markdown_nodes(files: DataFrame) -> DataFrame:
    """A node per markdown file and one per second-level heading (`#slug`): id, parent, node_type, title, location, level_1,
    level_2, code_hash."""
    rows = files.filter(F.col("location").isNotNull() & F.col("content").isNotNull() & F.lower("location").endswith(".md"))
    project, rest = F.substring_index("location", "/", 1), F.expr("substr(location, length(substring_index(location, '/', 1)) + 2)")
    file_id = F.concat(project, F.lit("::"), F.replace(F.regexp_replace(rest, r"\.[A-Za-z]+$", ""), F.lit("/"), F.lit(".")))
    rows = rows.withColumn("file_id", file_id)
    head = F.trim(F.regexp_extract("content", r"(?m)^# ([^\r\n]*)", 1))
    name = F.regexp_replace(F.substring_index("location", "/", -1), r"\.[A-Za-z]+$", "")
    none = F.lit(None).cast("string")
    top = rows.select(F.col("file_id").alias("id"), none.alias("parent"), F.lit("composite_process").alias("node_type"), F.when(head != "", head).otherwise(name).alias("title"), "location", F.when(head != "", head).otherwise(name).alias("level_1"), none.alias("level_2"), fn.hash16("content").alias("code_hash"))
    parts = markdown_sections(rows.withColumnRenamed("content", "_text").withColumn("_key", F.struct("file_id", "location")), "_key", "_text", True)
    sec = parts.select(F.concat("_key.file_id", F.lit("#"), "slug").alias("id"), F.col("_key.file_id").alias("parent"), F.lit("atomic_process").alias("node_type"), F.col("heading").alias("title"), F.col("_key.location").alias("location"), F.coalesce(F.nullif(fn.first_sentence("body"), F.lit("")), F.col("heading")).alias("level_1"), F.col("body").alias("level_2"), F.col("body_hash").alias("code_hash"))
    return top.unionByName(sec)


def document_files(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """project, slug, raw of the JSON files that are documents (a title that is text and a list of sections), in the shape that
    documents.write_docs takes; those no newer than stored (location, file_mtime) are left out. A file in a docs folder is
    named by its path below that folder."""
    rows = files if stored is None else changed_since(files, stored)
    rows = rows.filter(is_docjson(F.col("content")))
    slug = F.regexp_replace(F.expr("substr(location, length(substring_index(location, '/', 1)) + 2)"), r"\.json$", "")
    return rows.select(F.substring_index("location", "/", 1).alias("project"), F.regexp_replace(slug, "^docs/", "").alias("slug"), F.col("content").alias("raw"))


def matched_root(path: Column | str, roots: Collection[str]) -> Column:
    """The first of the folders that a path lies in; null for none."""
    c = path if isinstance(path, Column) else F.col(path)
    clean = [r.replace("\\", "/").rstrip("/") for r in roots]
    return F.coalesce(*[F.when(F.replace(c, F.lit("\\"), F.lit("/")).startswith(r + "/"), r) for r in clean if r], F.lit(None).cast("string"))


def root_prefix(root: Column | str) -> Column:
    """`docs/x/y` as the prefix `x.y` of ids below the docs folder."""
    c = root if isinstance(root, Column) else F.col(root)
    return F.replace(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+|/+$", ""), "^docs(/|$)", ""), F.lit("/"), F.lit("."))


# The list of projects: a small JSON file of one user, written whole.


def _registry(path: str | Path) -> list[dict]:
    p = Path(path)
    try:
        rows = json.loads(p.read_text(encoding="utf-8")) if p.exists() else []
    except json.JSONDecodeError:
        rows = []
    return [x for x in rows if isinstance(x, dict) and x.get("path")]


def _store(path: str | Path, rows: list[dict]) -> list[dict]:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    part = p.with_suffix(f".{os.getpid()}.part")
    part.write_text(json.dumps(rows, indent=1), encoding="utf-8")
    os.replace(part, p)
    return rows


def register(path: str | Path, project: str, at: datetime) -> list[dict]:
    """Enter a project folder with its name and the time; one that is there is renewed."""
    full = os.path.abspath(project)
    rest = [x for x in _registry(path) if x["path"] != full]
    return _store(path, [*rest, {"path": full, "name": os.path.basename(full), "seen_at": at.isoformat()}])


def prune_registry(path: str | Path) -> list[dict]:
    """Take out projects whose folder is gone."""
    return _store(path, [x for x in _registry(path) if os.path.isdir(x["path"])])
