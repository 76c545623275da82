"""Text for readers: nodes at four levels of detail, trees of edges, documents and tables of contents, and their files."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh

STAMP = "<!-- generated: do not edit -->"


def badge(own: Column | str = "own_status", link: Column | str = "link_status") -> Column:
    """`  [OWN+LINK]` of the statuses that aren't VERIFIED, else nothing."""
    bad = F.filter(F.array(F.col(own) if isinstance(own, str) else own, F.col(link) if isinstance(link, str) else link), lambda x: x != "VERIFIED")
    return F.when(F.size(bad) > 0, F.concat(F.lit("  ["), F.array_join(bad, "+"), F.lit("]"))).otherwise("")


def _at(prefix: str, lined: bool) -> Column:
    loc = F.col("level_3_location")
    shown = loc.contains("#L") if lined else loc.isNotNull() & (loc != "")
    return F.when(F.coalesce(shown, F.lit(False)), F.concat(F.lit(prefix + "@ "), loc)).otherwise("")


def render_nodes(nodes: DataFrame, level: int, badges: bool = False) -> DataFrame:
    """id, text of each node: its id (0), a line (1), a block (2) or its numbered steps (3; nodes without any are left out).

    On level 1 ids are padded to the longest one."""
    mark = badge() if badges else F.lit("")
    if level == 0:
        return nodes.select("id", F.col("id").alias("text"))
    if level == 1:
        width = nodes.agg(F.max(F.length("id")).alias("w"))
        line = F.concat(F.rpad("id", F.col("w"), F.lit(" ")), F.lit("  "), F.coalesce("level_1", F.lit("")), _at("  ", True), mark)
        return nodes.crossJoin(F.broadcast(width)).select("id", line.alias("text"))  # one row
    if level == 2:
        body = F.when(F.coalesce("level_2", F.lit("")) != "", F.concat(F.lit("  "), F.replace("level_2", F.lit("\n"), F.lit("\n  ")))).otherwise("  (no detail)")
        block = F.concat(F.lit("=== "), "id", F.lit(" ==="), mark, F.lit("\n  "), F.coalesce("level_1", F.lit("")), F.lit("\n"), body, _at("\n  ", False))
        return nodes.select("id", block.alias("text"))
    if level == 3:
        has = nodes.filter(F.size("level_steps") > 0)

        def step(s: Column) -> Column:
            line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n       {label}: "), c)).otherwise("")
            return F.concat(F.lit("  ["), F.regexp_replace(s["step_num"].cast("string"), r"\.0$", ""), F.lit("] "), F.coalesce(s["name"], F.lit("")), F.lit("\n       purpose : "), F.coalesce(s["purpose"], F.lit("")), line("inputs  ", s["inputs"]), line("outputs ", s["outputs"]), line("CRITICAL", s["critical"]))

        return has.select("id", F.concat(F.lit("=== "), "id", F.lit(" ===\n"), F.array_join(F.transform("level_steps", step), "\n")).alias("text"))
    raise ValueError(f"unknown level: {level}")


def render_page(m: Mesh, level: int, node_type: str | None = None, size: int = 60, offset: int = 0, badges: bool = False) -> tuple[str, DataFrame]:
    """(header, lines) of a page of nodes by id: the header tells the numbers and where the next page begins."""
    rows = m.nodes if node_type is None else m.nodes.filter(F.col("node_type") == node_type)
    total = rows.count()
    header = f"[{max(0, min(size, total - offset))} of {total} nodes -- level {level}]"
    if total > offset + size:
        header += f"  (cap={size}; pass offset={offset + size} for next page)"
    return header, render_nodes(rows.orderBy("id").offset(offset).limit(size), level, badges)


def render_tree(root: str, edges: list[tuple[str, str, str]], direction: str = "out", locations: dict[str, str] | None = None) -> list[str]:
    """The edges (edge_type, from_id, to_id) of a traversal as lines of a tree, each node unfolded once, in the order given.

    The rows are those of one bounded traversal (graph.khop_edges with a limit), brought to the driver by the caller."""
    name = lambda x: f"{x}  @ {locations[x]}" if locations and "#L" in (locations.get(x) or "") else x
    lines: list[str] = []
    for way, title, source, arrow in (("out", "outgoing", 1, "--[{}]--> {}"), ("in", "incoming", 2, "<--[{}]-- {}")):
        if direction not in (way, "both"):
            continue
        below: dict[str, list[tuple[str, str]]] = {}
        for e in edges:
            below.setdefault(e[source], []).append((e[0], e[3 - source]))
        seen, part = {root}, []
        todo = [(k, x, 1) for k, x in reversed(below.get(root, []))]
        while todo:
            kind, x, depth = todo.pop()
            part.append("    " * (depth - 1) + "  " + arrow.format(kind, name(x)))
            if x not in seen:
                seen.add(x)
                todo += [(k, y, depth + 1) for k, y in reversed(below.get(x, []))]
        if part:
            lines += [f"  {title}:", *part]
    return lines or ["  (no edges)"]


def docs_for_agents(m: Mesh) -> DataFrame:
    """doc_id, markdown with the id of every section and the nodes it links to, by id: those that don't exist by their id alone."""
    links = m.edges.filter("edge_type = 'documents'").join(m.sections.select(F.col("id").alias("from_id"), "doc_id"), "from_id").filter("to_id <> doc_id")
    known = m.nodes.select(F.col("id").alias("to_id"), F.coalesce("level_1", F.lit("")).alias("summary"), "level_3_location")
    entry = F.concat(F.lit("- `"), "to_id", F.lit("`"), F.when(F.coalesce("summary", F.lit("")) != "", F.concat(F.lit(" — "), "summary")).otherwise(""), _at("  ", True))
    per = links.join(known, "to_id", "left").groupBy(F.col("from_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("to_id", entry.alias("entry")))), lambda x: x["entry"]), "\n").alias("links"))
    level = F.greatest(F.lit(2), F.least(F.lit(6), F.col("depth") + 2))
    head = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.coalesce("heading", F.lit("")), F.lit("  <!-- id: "), "id", F.lit(" -->"))
    part = F.concat(head, F.lit("\n"), F.when(F.coalesce("content", F.lit("")) != "", F.concat(F.lit("\n"), "content", F.lit("\n"))).otherwise(""), F.when(F.col("links").isNotNull(), F.concat(F.lit("\n**Linked nodes:**\n"), "links", F.lit("\n"))).otherwise(""))
    parts = m.sections.join(per, "id", "left").groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "id", part.alias("part")))), lambda x: x["part"]), "\n").alias("body"))
    docs = m.docs.select("id", "title").join(parts, F.col("id") == F.col("doc_id"), "left")
    return docs.select(F.col("id").alias("doc_id"), F.concat_ws("\n", F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n")), "body").alias("markdown"))


def read_docs(m: Mesh, keys: DataFrame, long_doc: int = 3000) -> DataFrame:
    """key, part, result, text of what each key (doc_id, section; section null for the whole) names.

    A section is found by its equal last part, else by the first whose last part contains it. A document of more than
    long_doc characters is answered with its table of contents. result: section, document, contents or unknown."""
    want = keys.select("doc_id", "section").distinct()
    last = F.element_at(F.split("id", "::"), -1)
    sec = m.sections.select("doc_id", "id", last.alias("slug"), "position", F.concat(F.lit("## "), F.coalesce("heading", F.lit("")), F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("text"))
    near = want.filter("section is not null").join(sec, "doc_id").filter(F.col("slug").contains(F.col("section")) | (F.element_at(F.split("slug", r"\."), -1) == F.col("section")))
    exact = (F.col("slug") == F.col("section")) | (F.element_at(F.split("slug", r"\."), -1) == F.col("section"))
    best = near.groupBy("doc_id", "section").agg(F.min(F.struct(F.when(exact, 0).otherwise(1).alias("o"), "position", "id", "text")).alias("x"))
    parts = want.filter("section is not null").join(best, ["doc_id", "section"], "left").select("doc_id", "section", F.col("x.id").alias("part"), F.when(F.col("x").isNull(), "unknown").otherwise("section").alias("result"), F.col("x.text").alias("text"))
    sizes = m.sections.groupBy("doc_id").agg(F.sum(F.length(F.coalesce("content", F.lit("")))).alias("chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", last.alias("slug"), F.length(F.coalesce("content", F.lit(""))).alias("n")))), lambda x: F.concat(F.lit("| "), x["slug"], F.lit(" | "), x["n"].cast("string"), F.lit(" |"))), "\n").alias("toc"))
    whole = want.filter("section is null").join(docs_for_agents(m), "doc_id", "left").join(sizes, "doc_id", "left")
    big = F.coalesce("chars", F.lit(0)) > long_doc
    whole = whole.select("doc_id", "section", F.lit(None).cast("string").alias("part"), F.when(F.col("markdown").isNull(), "unknown").when(big, "contents").otherwise("document").alias("result"), F.when(big, F.col("toc")).otherwise(F.col("markdown")).alias("text"))
    return parts.unionByName(whole)


def node_sources(m: Mesh, files: DataFrame, ids: DataFrame, long_module: int = 200, preview: int = 50) -> DataFrame:
    """id, result, text: the source of each id from its file (location, content).

    result: not_found, no_location, file_missing, lines (the node's own), file, or preview: of a module of more than
    long_module lines the first ones, with its children."""
    at = fn.level3("level_3_location")
    n = ids.select("id").distinct().join(m.nodes.select("id", F.lit(True).alias("known"), "node_type", "level_3_location"), "id", "left")
    n = n.withColumn("path", at.getField("path")).withColumn("a", at.getField("line_start")).withColumn("b", at.getField("line_end"))
    n = n.join(files.select(F.col("location").alias("path"), "content"), "path", "left").withColumn("lines", F.size(F.split(F.regexp_replace("content", r"\n\z", ""), "\n")))
    kids = m.edges.filter("edge_type = 'composes'").join(m.nodes.select(F.col("id").alias("to_id"), F.col("level_3_location").alias("loc")), "to_id")
    entry = F.concat(F.lit("- "), "to_id", F.when(F.coalesce("loc", F.lit("")) != "", F.concat(F.lit("  @ "), "loc")).otherwise(""))
    kids = kids.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_kids"), F.array_join(F.sort_array(F.collect_list(entry)), "\n").alias("kids"))
    n = n.join(kids, "id", "left")
    module = F.col("a").isNull() & (F.col("node_type") == "composite_process") & (F.col("lines") > long_module)
    result = F.when(F.col("known").isNull(), "not_found").when(F.coalesce("level_3_location", F.lit("")) == "", "no_location").when(F.col("content").isNull(), "file_missing").when(module, "preview").when(F.col("a").isNull(), "file").otherwise("lines")
    head = F.concat(F.lit("# "), "id", F.lit("  @ "), "level_3_location", F.lit("\n\n"))
    first = F.concat(head, F.lit("Module has "), F.col("lines").cast("string"), F.lit(" lines and "), F.coalesce("n_kids", F.lit(0)).cast("string"), F.lit(" functions.\n\n"), fn.lines_between("content", F.lit(1), F.lit(preview)), F.when(F.col("kids").isNotNull(), F.concat(F.lit("\n\nChildren:\n"), "kids")).otherwise(""))
    text = F.when(result == "preview", first).when(result == "file", F.concat(head, "content")).when(result == "lines", F.concat(head, fn.lines_between("content", F.col("a"), F.col("b"))))
    return n.select("id", result.alias("result"), text.alias("text"))


@dataclass(frozen=True)
class Target:
    """A place that documents are rendered to: those under prefix, as files below out."""

    name: str
    out: str
    prefix: str = ""
    overwrite: bool = False


def parse_targets(raw: list[dict]) -> list[Target]:
    """Targets of a configuration: name and out are required, names unique, other fields unknown to Target are errors."""
    out, seen = [], set()
    for i, x in enumerate(raw):
        if not isinstance(x, dict) or not x.get("name") or not x.get("out"):
            raise ValueError(f"target {i}: name and out are required")
        if extra := sorted(set(x) - {"name", "out", "prefix", "overwrite"}):
            raise ValueError(f"target {x['name']}: unknown fields {extra}")
        if x["name"] in seen:
            raise ValueError(f"target {x['name']}: named twice")
        seen.add(x["name"])
        out.append(Target(**x))
    return out


def _write_files(root: str, overwrite: bool) -> Callable:
    """For mapInPandas: write path and text below root; a file that isn't ours is left alone."""

    def run(batches):
        for x in batches:
            state = []
            for path, text in zip(x["path"], x["text"], strict=True):
                full = os.path.normpath(os.path.join(root, path))
                if not full.startswith(os.path.normpath(root) + os.sep):
                    state.append("outside")
                    continue
                if os.path.exists(full) and not overwrite:
                    with open(full, encoding="utf-8", errors="replace") as f:
                        if not f.readline().startswith(STAMP):
                            state.append("foreign")
                            continue
                os.makedirs(os.path.dirname(full), exist_ok=True)
                part = f"{full}.{os.getpid()}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(f"{STAMP}\n{text}\n")
                os.replace(part, full)  # a retried task writes the same file again
                state.append("written")
            yield x.assign(state=state)[["path", "doc_id", "hash", "state"]]

    return run


def site_pages(rendered: DataFrame, prefix: str = "") -> DataFrame:
    """path, doc_id, text, hash of the pages of a site: the path is the dotted part of the id as folders; ids under prefix only."""
    dotted = F.get(F.split("doc_id", "::"), 1)
    rows = rendered.filter(F.coalesce(dotted, F.lit("")).startswith(prefix)) if prefix else rendered
    return rows.select(F.concat(F.replace(F.coalesce(dotted, "doc_id"), F.lit("."), F.lit("/")), F.lit(".md")).alias("path"), "doc_id", F.col("markdown").alias("text"), fn.hash16("markdown").alias("hash"))


def build_site(rendered: DataFrame, target: Target) -> DataFrame:
    """Write the pages (doc_id, markdown) of a target into a folder that all executors share: path, doc_id, hash and what
    became of each, written, foreign (a file of another hand was there and stays) or outside. The rows are the manifest."""
    pages = site_pages(rendered, target.prefix)
    return pages.mapInPandas(_write_files(target.out, target.overwrite), "path string, doc_id string, hash string, state string")


def render_targets(rendered: DataFrame, targets: list[Target], only: str | None = None) -> dict[str, DataFrame]:
    return {t.name: build_site(rendered, t) for t in targets if only in (None, t.name)}


def nav_leaves(nav: dict, above: str = "") -> list[tuple[str, str]]:
    """(path, doc_id) of the leaves of a navigation: `show` lists documents by id, or folders with a title and a `show`."""
    if not isinstance(nav, dict) or not isinstance(nav.get("show"), list):
        raise ValueError("a navigation is an object with a list `show`")
    out: list[tuple[str, str]] = []
    for i, x in enumerate(nav["show"]):
        where = f"{above}{i}"
        if isinstance(x, str):
            out.append((where, x))
        elif isinstance(x, dict) and "show" in x:
            out += nav_leaves(x, f"{where}.")
        else:
            raise ValueError(f"navigation {where}: neither a document nor a folder")
    return out


def toctree(pages: list[tuple[str, str]]) -> str:
    """An index page over (path, title)."""
    return "\n".join(["# Contents", "", *(f"- [{t}]({p})" for p, t in sorted(pages))])


def manifest_json(rows: list[tuple[str, str, str]]) -> str:
    """The manifest of a site, path -> document and hash, as JSON."""
    return json.dumps({p: {"doc_id": d, "hash": h} for p, d, h in sorted(rows)}, indent=1)
