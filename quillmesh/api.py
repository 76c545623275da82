"""One object per project: its index in a folder, and a method per command. Reads give DataFrames, writes a new version."""

from __future__ import annotations

from collections.abc import Collection
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .mesh import Mesh
from .operators import build, documents, drift, graph, history, inventory, mutations, rename, render, revisions, search, staleness, workflows
from .sources import project as pj


class Index:
    """The index of a project. root: the folder of the project; at: where the index is kept, by default below it.

    Times of writes are the clock's unless given, so that tests and repeated runs can fix them.
    """

    def __init__(self, spark: SparkSession, root: str, at: str | None = None, config: pj.Config | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = at or pj.index_path(self.root)
        self.config = config or pj.Config.load(f"{self.root}/quillmesh.toml")
        self.vectors: DataFrame | None = None

    @property
    def mesh(self) -> Mesh:
        return store.load(self.spark, self.path)

    def _keep(self, m: Mesh) -> None:
        store.save(m, self.path)

    @staticmethod
    def _now(at: datetime | None) -> datetime:
        return at or datetime.now(UTC).replace(tzinfo=None)

    def _ids(self, ids: Collection[str], name: str = "id") -> DataFrame:
        return self.spark.createDataFrame([(x,) for x in ids], f"{name} string")

    # Builds and checks

    def files(self) -> DataFrame:
        c = self.config
        py = pj.list_files(self.spark, self.root, "python", (), (*pj.SKIPPED, *c.exclude_dirs))
        return py.unionByName(pj.list_files(self.spark, self.root, "script", c.script_paths, (*pj.SKIPPED, *c.exclude_dirs)))

    def build(self, discovery_only: bool = True, git_sha: str | None = None, at: datetime | None = None) -> dict[str, int]:
        c, t = self.config, self._now(at)
        below = F.expr("substr(location, length(substring_index(location, '/', 1)) + 2)")
        docs = pj.list_files(self.spark, self.root, "docs", (), (*pj.SKIPPED, *c.exclude_dirs)).filter(pj.matched_root(below, c.docs_dirs).isNotNull())
        m, told = build.build(self.mesh, self.files(), t, discovery_only, git_sha, c.exclude_dirs, c.transitive_tags, c.frozen_tags, c.rename_pool_cap, c.rename_threshold, pj.document_files(docs))
        told["docs"] = m.docs.count()
        self._keep(m)
        return told

    def check(self, fail_on: str = "none") -> tuple[dict[str, int], int]:
        return build.check(self.mesh, fail_on)

    def checkout(self, target: str, force: bool = False) -> bool:
        return store.copy(self.spark, self.path, target, force)

    def vacuum(self) -> int:
        return store.vacuum(self.spark, self.path)

    # Reading

    def sql(self, query: str, most: int = 500) -> DataFrame:
        return inventory.run_sql(self.spark, self.mesh, query, most)

    def list(self, node_type: str | None = None, tag: str | None = None, parent_id: str | None = None, location: str | None = None) -> DataFrame:
        return inventory.list_nodes(self.mesh, node_type, tag, parent_id, location)

    def render(self, level: int, node_id: str | None = None, node_type: str | None = None, size: int = 60, offset: int = 0) -> tuple[str, DataFrame]:
        if node_id is not None:
            return "", render.render_nodes(self.mesh.nodes.filter(F.col("id") == node_id), level, True)
        return render.render_page(self.mesh, level, node_type, size, offset, True)

    def graph(self, node_id: str, direction: str = "out", depth: int = 1, most: int = 40, offset: int = 0) -> DataFrame:
        return graph.fetch_graph(self.mesh, node_id, direction, depth, most, offset)

    def tree(self, node_id: str, direction: str = "out", depth: int = 1, most: int = 40) -> list[str]:
        rows = self.graph(node_id, direction, depth, most).orderBy("hop", "id").collect()  # at most `most`
        return render.render_tree(node_id, [(r["edge_type"], r["from_id"], r["to_id"]) for r in rows], direction)

    def search(self, query: str, mode: str = "keyword", most: int = 20, node_type: str | None = None, scope: str = "all", tag: str | None = None, offset: int = 0) -> DataFrame:
        if mode == "semantic" and self.vectors is not None:
            return search.semantic_search(self.mesh, self.vectors, query, most=most, node_type=node_type, scope=scope)
        return search.keyword_search(self.mesh, query, None, most, node_type, scope, tag, offset)

    def source(self, ids: Collection[str]) -> DataFrame:
        return render.node_sources(self.mesh, self.files(), self._ids(ids))

    def list_tags(self) -> DataFrame:
        return inventory.tag_counts(self.mesh)

    def list_undocumented(self, node_type: str | None = None) -> DataFrame:
        return drift.undocumented(self.mesh, node_type)

    def drift(self, text: str | None = None, location_glob: str | None = None, group_by: str | None = None, form: str | None = None, page: int = 0, size: int = 100, include_frozen: bool = False) -> DataFrame:
        """Rows in the form full, ids or counts (counts by default where grouped), a page at a time where not grouped."""
        m = self.mesh
        rows = drift.drift_rows(m, text, location_glob, self.config.frozen_tags, include_frozen)
        form = form or ("counts" if group_by else "full")
        if form not in ("full", "ids", "counts"):
            raise ValueError(f"unknown form: {form!r}")
        if group_by:
            return {"counts": drift.drift_counts, "ids": drift.drift_ids, "full": drift.drift_full}[form](m, rows, group_by)
        if form == "counts":
            return rows.agg(F.count("*").alias("n"))
        got = drift.drift_page(m, rows, page, size)
        return got.select("id") if form == "ids" else got

    def history(self, node_id: str, most: int = 10, offset: int = 0) -> DataFrame:
        return history.history_page(self.mesh.history.filter(F.col("node_id") == node_id), most, offset)

    def reference_points(self) -> DataFrame:
        return history.reference_points(self.mesh.history)

    def report(self, since_sha: str | None = None, since: datetime | None = None, change_type: str | None = None, node: str | None = None, node_type: str | None = None) -> DataFrame:
        m = self.mesh
        after, _ = history.resolve_cutoff(m.history, since_sha, since)
        if after is None and since_sha:
            raise ValueError(f"no such commit in the history: {since_sha}")
        return history.report(inventory.filter_history(history.history_since(m.history, after), m, change_type, node, node_type))

    def agent_verified(self) -> DataFrame:
        return history.agent_verified(self.mesh)

    def diff(self, blobs: DataFrame, files: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
        return revisions.node_diff(self.mesh, blobs, files, baseline)

    def workflow_list(self, module: str | None = None, role: str | None = None, scope: str = "production", has_steps: bool = False) -> DataFrame:
        return inventory.envelopes(self.mesh, role, module, scope, has_steps)

    def workflow_detail(self, key: str) -> DataFrame:
        m = self.mesh
        env = workflows.resolve_envelopes(m, self._ids([key], "key"))
        return workflows.workflow_details(m).join(env.select(F.col("envelope").alias("root")), "root", "left_semi")

    def read_doc(self, doc_id: str, section: str | None = None) -> DataFrame:
        return render.read_docs(self.mesh, self.spark.createDataFrame([(doc_id, section)], "doc_id string, section string"))

    def export(self) -> DataFrame:
        return mutations.export_json(self.mesh)

    # Writing

    def mark_clean(self, ids: Collection[str], reason: str, by: str = "agent", at: datetime | None = None) -> DataFrame:
        m, ask = self.mesh, self._ids(ids)
        self._keep(mutations.mark_clean(m, ask, self._now(at), by, reason))
        return mutations.mark_clean_report(m, ask)

    def purge(self, ids: Collection[str], at: datetime | None = None) -> DataFrame:
        out, told = mutations.purge(self.mesh, self._ids(ids), self._now(at))
        self._keep(out)
        return told

    def link(self, from_id: str, edge_type: str, to_id: str, at: datetime | None = None) -> str:
        out, told = mutations.add_edges(self.mesh, self.spark.createDataFrame([(from_id, edge_type, to_id)], "from_id string, edge_type string, to_id string"), self._now(at))
        result = told.first()["result"]
        if result == "added":
            self._keep(out)
        return result

    def apply_rename(self, old_id: str, new_id: str, at: datetime | None = None) -> DataFrame:
        out, told = rename.apply_renames(self.mesh, self.spark.createDataFrame([(old_id, new_id)], "old_id string, new_id string"), self._now(at))
        self._keep(out)
        return told

    def revert_rename(self, new_id: str, at: datetime | None = None) -> DataFrame:
        out, told = rename.revert_renames(self.mesh, self._ids([new_id], "new_id"), self._now(at))
        self._keep(out)
        return told

    def checkpoint(self, git_sha: str, message: str = "", node_types: Collection[str] = ("atomic_process", "composite_process", "entity"), at: datetime | None = None) -> None:
        self._keep(mutations.checkpoint_events(self.mesh, node_types, self._now(at), git_sha, message))

    def write_doc(self, slug: str | None, raw: str, at: datetime | None = None) -> DataFrame:
        project = self.root.rpartition("/")[2]
        out, told = documents.write_docs(self.mesh, self.spark.createDataFrame([(project, slug, raw)], "project string, slug string, raw string"), self._now(at))
        self._keep(out)
        return told

    def _edit(self, edit, rows: list[tuple], schema: str, at: datetime | None) -> DataFrame:
        out, told = edit(self.mesh, self.spark.createDataFrame(rows, schema), self._now(at))
        self._keep(out)
        return told

    def update_section(self, section_id: str, content: str | None = None, heading: str | None = None, new_id: str | None = None, after: str | None = None, at: datetime | None = None) -> DataFrame:
        return self._edit(documents.update_sections, [(section_id, heading, content, new_id, after)], "id string, heading string, content string, new_id string, after string", at)

    def patch_section(self, section_id: str, new_text: str, anchor: str | None = None, old_text: str | None = None) -> DataFrame:
        out, told = documents.patch_sections(self.mesh, self.spark.createDataFrame([(section_id, anchor, old_text, new_text)], "id string, anchor string, old_text string, new_text string"))
        self._keep(out)
        return told

    def add_section(self, doc_id: str, section: str, heading: str, content: str | None = None, parent: str | None = None, after: str | None = None, at: datetime | None = None) -> DataFrame:
        return self._edit(documents.add_sections, [(doc_id, section, heading, content, parent, after)], "doc_id string, section string, heading string, content string, parent string, after string", at)

    def delete_section(self, section_id: str, at: datetime | None = None) -> None:
        self._keep(documents.delete_sections(self.mesh, self._ids([section_id]), self._now(at)))

    def add_links(self, section_id: str, node_ids: Collection[str], at: datetime | None = None) -> DataFrame:
        return self._edit(documents.add_links, [(section_id, x) for x in node_ids], "from_id string, to_id string", at)

    def delete_links(self, section_id: str, node_ids: Collection[str], at: datetime | None = None) -> None:
        rows = self.spark.createDataFrame([(section_id, x) for x in node_ids], "from_id string, to_id string")
        self._keep(documents.delete_links(self.mesh, rows, self._now(at)))

    def delete_doc(self, doc_id: str, at: datetime | None = None) -> None:
        self._keep(mutations.delete_doc(self.mesh, doc_id, self._now(at)))

    def update_doc(self, doc_id: str, title: str | None = None, tags: list[str] | None = None, at: datetime | None = None) -> DataFrame:
        return self._edit(documents.update_docs, [(doc_id, title, tags)], "doc_id string, title string, tags array<string>", at)

    def render_site(self, only: str | None = None) -> dict[str, DataFrame]:
        m = self.mesh
        return render.render_targets(render.docs_for_agents(m), list(self.config.targets), only)

    def embed(self) -> DataFrame:
        """Vectors of all nodes, those of unchanged texts as they were, for semantic searches of this object."""
        have = self.vectors if self.vectors is not None else self.spark.createDataFrame([], "node_id string, content_hash string, vec array<float>")
        self.vectors = search.refresh_vectors(self.mesh, have)
        return self.vectors

    def statuses(self) -> DataFrame:
        return staleness.statuses(self.mesh, self.config.transitive_tags, self.config.frozen_tags)
