"""Documents: rendering, and edits of sections and links as pure functions of the index."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh
from ..runtime import cut
from . import mutations
from .flatten import parse_json


def render(m: Mesh) -> DataFrame:
    """doc_id, markdown: the title and the sections in order, headings of level 2 to 6 by depth; links to ids as plain text."""
    level = F.greatest(F.lit(2), F.least(F.lit(6), F.col("depth") + 2))
    body = F.trim(F.coalesce("content", F.lit("")))
    part = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), F.coalesce("heading", F.lit("")), F.when(body != "", F.concat(F.lit("\n\n"), fn.strip_id_links(body))).otherwise(""))
    parts = m.sections.select("doc_id", F.struct("position", part.alias("part")).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("l"))
    doc = m.docs.join(parts, m.docs.id == parts.doc_id, "left")
    return doc.select(F.col("id").alias("doc_id"), F.concat_ws("\n\n", F.concat(F.lit("# "), F.coalesce("title", F.lit(""))), F.array_join(F.transform("l", lambda x: x["part"]), "\n\n")).alias("markdown"))


def patch_sections(m: Mesh, patches: DataFrame) -> tuple[Mesh, DataFrame]:
    """Change contents. patches: id, anchor (`^` puts the text before, `$` behind, null replaces old_text), old_text, new_text.

    A replacement is made only where old_text stands exactly once. Returns the index and what became of each id: done,
    unknown, absent, ambiguous, or repeated where one call has several patches for it, of which none is made.
    """
    once = patches.groupBy("id").agg(F.min(F.struct("anchor", "old_text", "new_text")).alias("p"), F.count("*").alias("n"))
    many = once.filter("n > 1").select("id", F.lit("repeated").alias("result"))
    patches = once.filter("n = 1").select("id", "p.*")
    j = patches.join(m.sections.select("id", F.coalesce("content", F.lit("")).alias("content")), "id", "left")
    hits = F.size(F.split("content", F.concat(F.lit("\\Q"), F.replace("old_text", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)) - 1
    result = F.when(F.col("content").isNull(), "unknown").when(F.col("anchor").isin("^", "$"), "done").when(F.coalesce("old_text", F.lit("")) == "", "absent").when(hits == 1, "done").when(hits > 1, "ambiguous").otherwise("absent")
    new = F.when(F.col("anchor") == "^", F.concat("new_text", "content")).when(F.col("anchor") == "$", F.concat("content", "new_text")).otherwise(F.replace("content", F.col("old_text"), F.col("new_text")))
    told = j.select("id", result.alias("result"), F.when(result == "done", new).alias("new"))
    sections = m.sections.join(told.filter("result = 'done'").select("id", "new"), "id", "left").withColumn("content", F.coalesce("new", "content")).drop("new").select(*m.sections.columns)
    return m.but(sections=sections), told.select("id", "result").unionByName(many)


def delete_sections(m: Mesh, ids: DataFrame, at: datetime) -> Mesh:
    """Take out sections with all below them."""
    stems = ids.select(F.col("id").alias("stem")).distinct()
    parts = F.split("id", r"\.")
    # Every prefix of a section's id, so that the join stays an equi-join.
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    hit = m.sections.select("id", F.explode(ups).alias("stem")).join(stems, "stem", "left_semi").select("id").distinct()
    return mutations.delete_nodes(m, hit, at)


def add_links(m: Mesh, links: DataFrame, at: datetime) -> tuple[Mesh, DataFrame]:
    """Add documents links (from_id, to_id) that aren't there yet, with LINK_ADDED rows; and the targets that no node has."""
    want = links.select("from_id", "to_id").distinct().withColumn("id", fn.edge_id("from_id", F.lit("documents"), "to_id"))
    new = want.join(m.edges.select("id"), "id", "left_anti")
    edges = new.select("id", F.lit("documents").alias("edge_type"), "from_id", "to_id", F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("event"), F.lit(at).cast("timestamp").alias("loaded_at"))
    rows = new.select(F.col("from_id").alias("node_id"), F.lit(at).cast("timestamp").alias("scanned_at"), F.lit("LINK_ADDED").alias("change_type"), F.to_json(F.struct(F.col("to_id").alias("target"))).alias("meta"))
    lost = want.join(m.nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti").select("from_id", "to_id")
    return m.but(edges=m.edges.unionByName(edges), history=m.history.unionByName(mutations.events(rows, m.history))), lost


def delete_links(m: Mesh, links: DataFrame, at: datetime) -> Mesh:
    """Take out documents links (from_id, to_id), with LINK_REMOVED rows at their sources."""
    gone = m.edges.filter("edge_type = 'documents'").join(links.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_semi")
    rows = gone.select(F.col("from_id").alias("node_id"), F.lit(at).cast("timestamp").alias("scanned_at"), F.lit("LINK_REMOVED").alias("change_type"), F.to_json(F.struct(F.col("to_id").alias("target"))).alias("meta"))
    return m.but(edges=m.edges.join(gone.select("id"), "id", "left_anti").select(*m.edges.columns), history=m.history.unionByName(mutations.events(rows, m.history)))


SLUG = "^[a-z0-9]+(?:-[a-z0-9]+)*$"
DEEPEST = 2
PARSED = "doc_id string, error string, title string, tags array<string>, sec string, parent string, depth int, position int, heading string, content string, sec_tags array<string>, links array<string>"
PARSED_ARROW = pa.schema([("doc_id", pa.string()), ("error", pa.string()), ("title", pa.string()), ("tags", pa.list_(pa.string())), ("sec", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("position", pa.int32()), ("heading", pa.string()), ("content", pa.string()), ("sec_tags", pa.list_(pa.string())), ("links", pa.list_(pa.string()))])


def section_parts(section_id: Column | str) -> Column:
    """struct(project, doc_path, section, doc_id) of `project::docs.a.b::section.child`; null for what is no section id."""
    c = section_id if isinstance(section_id, Column) else F.col(section_id)
    p = F.split(c, "::")
    whole = (F.size(p) == 3) & ~F.exists(p, lambda x: x == "")
    return F.when(whole, F.struct(F.get(p, 0).alias("project"), F.get(p, 1).alias("doc_path"), F.get(p, 2).alias("section"), F.concat_ws("::", F.get(p, 0), F.get(p, 1)).alias("doc_id")))


def _texts(x: object) -> list[str]:
    return [str(y) for y in x if isinstance(y, str)] if isinstance(x, list) else []


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and one per section, in the order of the text; a document with a fault has its error alone."""
    for b in batches:
        rows: list[tuple] = []
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist(), strict=True):
            ok, data = parse_json(raw)
            mine: list[tuple] = []
            error = None
            if not ok or not isinstance(data, dict):
                error = "no_object"
            elif not isinstance(data.get("title"), str) or not data["title"].strip():
                error = "no_title"
            elif not isinstance(data.get("sections"), list):
                error = "no_sections"
            else:
                seen: set[str] = set()
                todo = [(x, None, 0) for x in reversed(data["sections"])]
                while todo and not error:
                    x, parent, depth = todo.pop()
                    if not isinstance(x, dict) or not isinstance(x.get("id"), str) or not x["id"] or not isinstance(x.get("heading"), str):
                        error = "section_without_id_or_heading"
                    elif depth > DEEPEST:
                        error = "too_deep"
                    else:
                        sec = f"{parent}.{x['id']}" if parent else x["id"]
                        if sec in seen:
                            error = "repeated_section"
                        seen.add(sec)
                        links = [y.get("node_id", "").strip() for y in x.get("links") or [] if isinstance(y, dict) and isinstance(y.get("node_id", ""), str)]
                        content = x.get("content")
                        mine.append((doc_id, None, None, None, sec, parent, depth, len(mine), x["heading"], content if isinstance(content, str) else None, _texts(x.get("tags")), list(dict.fromkeys(y for y in links if y))))
                        todo += [(y, sec, depth + 1) for y in reversed(x.get("sections") or [])]
            if error:
                rows.append((doc_id, error, *[None] * 10))
            else:
                rows += [(doc_id, None, data["title"], _texts(data.get("tags")), *[None] * 8), *mine]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(PARSED_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, PARSED_ARROW.types, strict=True)], schema=PARSED_ARROW)


def parse_docs(docs: DataFrame) -> DataFrame:
    """docs: doc_id, raw (JSON with title, sections, tags). Rows of PARSED; ids of sections are required, three levels allowed."""
    return docs.select("doc_id", "raw").mapInArrow(_parsed, PARSED)


def slug_error(slug: Column) -> Column:
    """Why a path slug of a document can't be used: it is a node id, or has characters that no file name takes."""
    return F.when(slug.contains("::"), "node_id").when(slug.rlike(r'[<>:"\\\\|?*\x00-\x1f]'), "bad_character").when(slug == "", "empty")


def _named(docs: DataFrame) -> DataFrame:
    """docs with slug (of the title where none is given), bad (slug_error) and doc_id."""
    slug = F.coalesce(F.nullif(F.trim("slug"), F.lit("")), fn.slug(F.get_json_object("raw", "$.title")), F.lit(""))
    want = docs.select("project", "raw", slug.alias("slug")).withColumn("bad", slug_error(F.col("slug")))
    return want.withColumn("doc_id", F.concat("project", F.lit("::docs."), F.replace("slug", F.lit("/"), F.lit("."))))


def _hashed(heads: DataFrame, secs: DataFrame) -> DataFrame:
    """The nodes of parsed documents and sections with the hashes of their texts."""
    text = fn.strip_html(F.coalesce("content", F.lit("")))
    fresh = heads.select(F.col("doc_id").alias("id"), "title", F.col("title").alias("level_1"), F.lit(None).cast("string").alias("level_2"), fn.hash16("title").alias("code_hash"), F.lit("composite_process").alias("node_type"), "doc_id")
    fresh = fresh.unionByName(secs.select("id", F.col("heading").alias("title"), F.col("heading").alias("level_1"), F.col("content").alias("level_2"), fn.hash16(F.concat_ws("\n", "heading", text)).alias("code_hash"), F.lit("atomic_process").alias("node_type"), "doc_id"))
    return fresh.withColumn("desc_hash", fn.hash16(F.concat_ws("\n", "level_1", F.coalesce("level_2", F.lit("")))))


def doc_hashes(docs: DataFrame) -> DataFrame:
    """id, code_hash, desc_hash of the documents and sections of docs (project, slug, raw); faulty documents have none."""
    good = parse_docs(_named(docs).filter("bad is null")).filter("error is null")
    secs = good.filter("sec is not null").withColumn("id", F.concat_ws("::", "doc_id", "sec"))
    return _hashed(good.filter("sec is null"), secs).select("id", "code_hash", "desc_hash")


def write_docs(m: Mesh, docs: DataFrame, at: datetime, by: str | None = "agent") -> tuple[Mesh, DataFrame]:
    """Create or overwrite documents: the index after it, and for each doc_id its error, or the numbers of its sections, links
    and links to ids that no node has.

    docs: project, slug (a path such as `adrs/016-x`; null or empty: made of the title), raw. The id of a document is
    `project::docs.` and the slug with dots. Nodes that were there and whose text changes are verified by the writer; new
    ones are INITIAL; sections that are gone lose all but their history. Each documents link is told as LINK_ADDED.
    Without a writer (by None: a build that reads files) known hashes and statuses stay, so that drift shows, nothing is
    verified, and only links that are new are told.
    """
    want = _named(docs)
    parsed = cut(parse_docs(want.filter("bad is null").groupBy("doc_id").agg(F.max("raw").alias("raw"))))
    good = parsed.filter("error is null")
    heads, secs = good.filter("sec is null").select("doc_id", "title", "tags"), good.filter("sec is not null").withColumn("id", F.concat_ws("::", "doc_id", "sec")).withColumn("parent_id", F.when(F.col("parent").isNotNull(), F.concat_ws("::", "doc_id", "parent")))
    fresh = cut(_hashed(heads, secs))
    written = heads.select("doc_id")
    doc_of = F.concat_ws("::", F.get(F.split("id", "::"), 0), F.get(F.split("id", "::"), 1))
    mine = m.nodes.filter("subtype = 'docjson'").withColumn("doc_id", doc_of).join(written, "doc_id", "left_semi")
    old = cut(mine.select("id", F.col("code_hash").alias("oc"), F.col("desc_hash").alias("od")))
    both = fresh.join(old, "id", "left")
    changed = both.filter(F.col("oc").isNotNull() & (~F.col("oc").eqNullSafe(F.col("code_hash")) | ~F.col("od").eqNullSafe(F.col("desc_hash")))).select("id", "code_hash", "desc_hash")
    # Nodes: those of the written documents are replaced.
    base = {c: F.lit(None).cast(t) for c, t in m.nodes.dtypes}
    base |= {"subtype": F.lit("docjson"), "status": F.lit("active"), "source": F.lit("json_doc_scanner"), "own_status": F.lit("VERIFIED"), "link_status": F.lit("VERIFIED"), "updated_at": F.lit(at).cast("timestamp"), "level_0": F.get(F.split("id", "::"), 0)}
    base |= {"location": F.concat(F.replace(F.get(F.split("doc_id", "::"), 1), F.lit("."), F.lit("/")), F.lit(".json"))}
    nodes = m.nodes.join(old.select("id"), "id", "left_anti").select(*m.nodes.columns)
    shown = fresh.select(*[F.col(c) if c in fresh.columns else v.alias(c) for c, v in base.items()]).select(*m.nodes.columns)
    if by is None:
        stays = ("code_hash", "desc_hash", "own_status", "link_status", "updated_at")
        was = mine.select("id", F.lit(True).alias("_was"), *[F.col(c).alias(f"_{c}") for c in stays])
        shown = shown.join(was, "id", "left").select(*[F.when(F.col("_was"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in stays else F.col(c) for c in m.nodes.columns])
        changed = changed.limit(0)
    nodes = nodes.unionByName(shown)
    gone = old.join(fresh.select("id"), "id", "left_anti").select(F.col("id").alias("node_id"))
    tags = heads.select(F.col("doc_id").alias("node_id"), F.explode("tags").alias("tag")).unionByName(secs.select(F.col("id").alias("node_id"), F.explode("sec_tags").alias("tag"))).select("node_id", F.lower("tag").alias("tag")).distinct()
    all_mine = old.select(F.col("id").alias("node_id")).unionByName(fresh.select(F.col("id").alias("node_id"))).distinct()
    # Edges: composes from each parent, documents for the links; the sections' earlier ones go.
    parts = secs.select(F.lit("composes").alias("edge_type"), F.coalesce("parent_id", "doc_id").alias("from_id"), F.col("id").alias("to_id"))
    links = cut(secs.select(F.col("id").alias("from_id"), F.explode("links").alias("to_id")).withColumn("edge_type", F.lit("documents")))
    new_edges = parts.unionByName(links.select("edge_type", "from_id", "to_id")).withColumn("id", fn.edge_id("from_id", "edge_type", "to_id"))
    kept = m.edges.join(old.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(gone.select(F.col("node_id").alias("to_id")).withColumn("lost", F.lit(True)), "to_id", "left")
    kept = kept.filter(F.col("lost").isNull() | (F.col("edge_type") == "documents")).select(*m.edges.columns)
    shape = {c: F.lit(None).cast(t) for c, t in m.edges.dtypes} | {"weight": F.lit(1.0), "loaded_at": F.lit(at).cast("timestamp")}
    edges = kept.join(new_edges.select("id"), "id", "left_anti").select(*m.edges.columns).unionByName(new_edges.select(*[F.col(c) if c in new_edges.columns else shape[c].alias(c) for c in m.edges.columns]))
    when = F.lit(at).cast("timestamp").alias("scanned_at")
    event = fresh.join(old.select("id"), "id", "left_anti").select(F.col("id").alias("node_id"), when, F.lit("INITIAL").alias("change_type"), F.lit(None).cast("string").alias("meta"))
    told_links = links if by is not None else links.join(m.edges.filter("edge_type = 'documents'").select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    by = by or "build"
    event = event.unionByName(told_links.select(F.col("from_id").alias("node_id"), when, F.lit("LINK_ADDED").alias("change_type"), F.to_json(F.struct(F.lit("documents").alias("edge_type"), F.col("from_id").alias("source"), F.col("to_id").alias("target"), F.lit(by).alias("actor"))).alias("meta")))
    event = event.unionByName(changed.select(F.col("id").alias("node_id"), when, F.lit("AGENT_VERIFIED" if by.startswith("agent") else "MANUAL_VERIFIED").alias("change_type"), F.to_json(F.struct(F.lit("auto: docjson write").alias("reason"))).alias("meta")))
    snap = changed.select(F.col("id").alias("node_id"), F.lit("VERIFIED").alias("status"), F.lit(at).cast("timestamp").alias("verified_at"), F.lit(by).alias("verified_by"), F.lit("auto: docjson write").alias("reason"), F.col("code_hash").alias("code_hash_at"), F.col("desc_hash").alias("desc_hash_at"))
    ver = mutations.keep_latest(m.verification.join(gone, "node_id", "left_anti").select(*m.verification.columns), snap.select(*m.verification.columns), "node_id")
    stamp = F.lit(at).cast("timestamp").alias("updated_at")
    file = F.concat(F.replace(F.get(F.split("id", "::"), 1), F.lit("."), F.lit("/")), F.lit(".json"))
    doc_rows = heads.select(F.col("doc_id").alias("id"), "title", "tags").withColumn("file_path", file).join(fresh.select("id", "desc_hash"), "id").select("id", "title", "tags", "file_path", "desc_hash", stamp)
    sec_rows = secs.join(fresh.select("id", "desc_hash"), "id").select("id", "doc_id", "heading", "content", "desc_hash", stamp, "depth", "position", "parent_id")
    lost = links.join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti").join(secs.select(F.col("id").alias("from_id"), "doc_id"), "from_id").groupBy("doc_id").agg(F.count("*").alias("unknown"))
    told = secs.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum(F.size("links")).alias("links"))
    none = F.lit(0).cast("long")
    report = heads.select("doc_id").join(told, "doc_id", "left").join(lost, "doc_id", "left").select("doc_id", F.lit(None).cast("string").alias("error"), F.coalesce("sections", none).alias("sections"), F.coalesce("links", none).alias("links"), F.coalesce("unknown", none).alias("unknown"))
    failed = parsed.filter("error is not null").select("doc_id", "error").unionByName(want.filter("bad is not null").select("doc_id", F.col("bad").alias("error")))
    report = report.unionByName(failed.select("doc_id", "error", none.alias("sections"), none.alias("links"), none.alias("unknown")))
    out = m.but(
        nodes=nodes, edges=edges, verification=ver,
        tags=m.tags.join(all_mine, "node_id", "left_anti").select("node_id", "tag").unionByName(tags),
        history=m.history.unionByName(mutations.events(event, m.history)),
        docs=m.docs.join(written.withColumnRenamed("doc_id", "id"), "id", "left_anti").select(*doc_rows.columns).unionByName(doc_rows),
        sections=m.sections.join(written, "doc_id", "left_anti").select(*sec_rows.columns).unionByName(sec_rows),
    )
    return out, report


def _replaced(m: Mesh, rows: DataFrame) -> Mesh:
    """The index with the sections of rows (the shape of m.sections) in place of those of the same documents, their nodes after
    them."""
    rows = rows.select(*m.sections.columns)
    shown = rows.select("id", F.col("heading").alias("h"), F.col("content").alias("c"), F.col("desc_hash").alias("x"), F.col("updated_at").alias("u"))
    nodes = m.nodes.join(shown, "id", "left")
    for c, v in (("level_1", "h"), ("level_2", "c"), ("desc_hash", "x"), ("updated_at", "u")):
        nodes = nodes.withColumn(c, F.when(F.col("u").isNotNull(), F.col(v)).otherwise(F.col(c)))
    return m.but(sections=rows, nodes=nodes.select(*m.nodes.columns))


def placed(sections: DataFrame, order: str) -> DataFrame:
    """Sections with position anew: parents before their children, siblings by the column order, then by id."""
    dots = F.split(F.element_at(F.split("id", "::"), -1), r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.concat_ws("::", "doc_id", F.array_join(F.slice(dots, 1, i), ".")))
    steps = sections.select("id", F.posexplode(ups).alias("level", "up")).join(sections.select(F.col("id").alias("up"), F.col(order).alias("o")), "up")
    path = steps.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "o", "up"))), lambda x: F.struct(x["o"], x["up"])).alias("path"))
    w = Window.partitionBy("doc_id").orderBy("path")
    return sections.join(path, "id").withColumn("position", (F.row_number().over(w) - 1).cast("int")).drop("path")


def update_sections(m: Mesh, changes: DataFrame, at: datetime) -> tuple[Mesh, DataFrame]:
    """Change sections: heading, content, new_id (a short name; what is below moves along) and after (the short name of the
    sibling to stand behind); null leaves each as it is. changes: id and these four, an id once. Returns the index and what
    became of each id: done, unknown, bad_name, taken, no_sibling or nothing.
    """
    short = F.regexp_extract("id", r"([^.:]*)$", 1)
    stem = F.expr("substr(id, 1, length(id) - length(regexp_extract(id, '([^.:]*)$', 1)))")
    have = m.sections.select("id", "doc_id", "position", short.alias("short"), stem.alias("stem"))
    j = changes.select("id", F.col("heading").alias("nh"), F.col("content").alias("nc"), "new_id", "after").join(have, "id", "left")
    peers = have.select(F.col("id").alias("peer"), F.col("position").alias("peer_position"))
    j = j.withColumn("want", F.concat("stem", "new_id")).withColumn("behind", F.concat("stem", "after"))
    j = j.join(peers.select(F.col("peer").alias("want"), F.lit(True).alias("taken")), "want", "left").join(peers.select(F.col("peer").alias("behind"), "peer_position"), "behind", "left")
    empty = F.col("nh").isNull() & F.col("nc").isNull() & F.col("new_id").isNull() & F.col("after").isNull()
    result = F.when(F.col("doc_id").isNull(), "unknown").when(empty, "nothing").when(F.col("new_id").isNotNull() & ~F.col("new_id").rlike(SLUG), "bad_name").when(F.col("taken") & (F.col("want") != F.col("id")), "taken").when(F.col("after").isNotNull() & F.col("peer_position").isNull(), "no_sibling").otherwise("done")
    told = cut(j.withColumn("result", result).select("id", "doc_id", "nh", "nc", "want", "behind", "peer_position", "result"))
    ok = told.filter("result = 'done'")
    s = m.sections.join(ok.select("id", "nh", "nc", F.col("peer_position").alias("pp"), (F.col("behind") != F.col("id")).alias("other")), "id", "left")
    touched = F.col("nh").isNotNull() | F.col("nc").isNotNull()
    s = s.withColumn("heading", F.coalesce("nh", "heading")).withColumn("content", F.coalesce("nc", "content"))
    s = s.withColumn("desc_hash", F.when(touched, fn.hash16(F.concat_ws("\n", "heading", F.coalesce("content", F.lit(""))))).otherwise(F.col("desc_hash"))).withColumn("updated_at", F.when(touched, F.lit(at).cast("timestamp")).otherwise(F.col("updated_at")))
    s = s.withColumn("order", F.when(F.col("pp").isNotNull() & F.coalesce("other", F.lit(False)), F.col("pp") + 0.5).otherwise(F.col("position").cast("double")))
    out = _replaced(m, placed(s, "order"))
    moves = ok.filter("want is not null and want <> id").select(F.col("id").alias("old_id"), F.col("want").alias("new_id"))
    return _renamed_sections(out, moves), told.select("id", "result")


def _renamed_sections(m: Mesh, moves: DataFrame) -> Mesh:
    """Sections and what is below them under new ids, with their nodes, edges, tags, history and verification."""
    dots = F.split("id", r"\.")
    ups = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, 1, i), "."))
    hit = m.sections.select("id", F.explode(ups).alias("old_id")).join(moves, "old_id")
    longest = hit.groupBy("id").agg(F.max_by(F.struct("old_id", "new_id"), F.length("old_id")).alias("x"))
    every = cut(longest.select(F.col("id").alias("old_id"), F.concat("x.new_id", F.expr("substr(id, length(x.old_id) + 1)")).alias("new_id")))
    out = mutations.rename(m, every, ())
    new = every.select(F.col("old_id").alias("id"), F.col("new_id").alias("_new"))
    swap = lambda df, c: df.join(new.withColumnRenamed("id", c), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new").select(*df.columns)
    return out.but(nodes=swap(out.nodes, "id"), tags=swap(out.tags, "node_id"), sections=swap(swap(out.sections, "id"), "parent_id"))


def add_sections(m: Mesh, new: DataFrame, at: datetime) -> tuple[Mesh, DataFrame]:
    """Add sections: doc_id, section (a short name), heading, content, parent (the dotted place of the section above, or null)
    and after (the short name of the sibling to stand behind, null for the end). Returns the index and what became of each:
    done, no_document, bad_name, no_parent, too_deep, taken, no_sibling, or repeated within the call.
    """
    above = F.when(F.col("parent").isNotNull(), F.concat_ws("::", "doc_id", "parent"))
    n = new.withColumn("parent_id", above).withColumn("prefix", F.when(F.col("parent").isNotNull(), F.concat("parent_id", F.lit("."))).otherwise(F.concat("doc_id", F.lit("::"))))
    n = n.withColumn("id", F.concat("prefix", "section")).withColumn("behind", F.concat("prefix", "after"))
    have = m.sections.select("id", "position", "depth")
    n = n.join(m.docs.select(F.col("id").alias("doc_id"), F.lit(True).alias("known")), "doc_id", "left").join(have.select(F.col("id").alias("parent_id"), F.col("depth").alias("pd")), "parent_id", "left")
    n = n.join(have.select("id", F.lit(True).alias("taken")), "id", "left").join(have.select(F.col("id").alias("behind"), F.col("position").alias("bp")), "behind", "left")
    twice = Window.partitionBy("id").orderBy("heading", "content")
    n = n.withColumn("rn", F.row_number().over(twice))
    depth = F.coalesce(F.col("pd") + 1, F.lit(0))
    result = F.when(F.col("known").isNull(), "no_document").when(~F.coalesce(F.col("section").rlike(SLUG), F.lit(False)), "bad_name").when(F.col("parent").isNotNull() & F.col("pd").isNull(), "no_parent").when(depth > DEEPEST, "too_deep").when(F.col("taken"), "taken").when(F.col("after").isNotNull() & F.col("bp").isNull(), "no_sibling").when(F.col("rn") > 1, "repeated").otherwise("done")
    told = cut(n.withColumn("result", result).withColumn("depth", depth).select("id", "doc_id", "parent_id", "heading", "content", "depth", "bp", "result"))
    ok = told.filter("result = 'done'")
    text = F.concat_ws("\n", "heading", F.coalesce("content", F.lit("")))
    stamp = F.lit(at).cast("timestamp")
    rows = ok.select("id", "doc_id", "heading", "content", fn.hash16(text).alias("desc_hash"), stamp.alias("updated_at"), F.col("depth").cast("int").alias("depth"), F.lit(0).alias("position"), "parent_id", F.coalesce(F.col("bp") + 0.5, F.lit(1e15)).alias("order"))
    s = m.sections.select(*[c for c in rows.columns if c != "order"], F.col("position").cast("double").alias("order"))
    base = {c: F.lit(None).cast(t) for c, t in m.nodes.dtypes} | {"node_type": F.lit("atomic_process"), "subtype": F.lit("docjson"), "status": F.lit("active"), "source": F.lit("json_doc_scanner"), "own_status": F.lit("VERIFIED"), "link_status": F.lit("VERIFIED"), "updated_at": stamp, "id": F.col("id"), "title": F.col("heading"), "level_1": F.col("heading"), "level_2": F.col("content"), "code_hash": fn.hash16(text), "desc_hash": fn.hash16(text)}
    nodes = m.nodes.unionByName(ok.select(*[v.alias(c) for c, v in base.items()]).select(*m.nodes.columns))
    e = ok.select(F.coalesce("parent_id", "doc_id").alias("from_id"), F.col("id").alias("to_id"), F.lit("composes").alias("edge_type"))
    shape = {c: F.lit(None).cast(t) for c, t in m.edges.dtypes} | {"weight": F.lit(1.0), "loaded_at": stamp, "id": fn.edge_id("from_id", "edge_type", "to_id")}
    edges = m.edges.unionByName(e.select(*[F.col(c) if c in e.columns else shape[c].alias(c) for c in m.edges.columns]))
    event = ok.select(F.col("id").alias("node_id"), stamp.alias("scanned_at"), F.lit("INITIAL").alias("change_type"))
    out = m.but(nodes=nodes, edges=edges, history=m.history.unionByName(mutations.events(event, m.history)))
    return out.but(sections=placed(s.unionByName(rows), "order").select(*m.sections.columns)), told.select("id", "result")


def update_docs(m: Mesh, changes: DataFrame, at: datetime) -> tuple[Mesh, DataFrame]:
    """Change titles and tags (null leaves them). changes: doc_id, title, tags; a doc_id once. Returns the index and what became
    of each: done, unknown, empty_title or nothing. A changed document is verified by its writer."""
    j = changes.select("doc_id", F.col("title").alias("nt"), F.col("tags").alias("ng")).join(m.docs.select(F.col("id").alias("doc_id"), F.lit(True).alias("known")), "doc_id", "left")
    result = F.when(F.col("known").isNull(), "unknown").when(F.col("nt").isNull() & F.col("ng").isNull(), "nothing").when(F.trim("nt") == "", "empty_title").otherwise("done")
    told = cut(j.withColumn("result", result))
    ok = told.filter("result = 'done'")
    stamp = F.lit(at).cast("timestamp")
    docs = m.docs.join(ok.select(F.col("doc_id").alias("id"), "nt", "ng", F.lit(True).alias("hit")), "id", "left")
    docs = docs.withColumn("title", F.coalesce("nt", "title")).withColumn("tags", F.coalesce("ng", "tags")).withColumn("updated_at", F.when(F.col("hit"), stamp).otherwise(F.col("updated_at"))).select(*m.docs.columns)
    nodes = m.nodes.join(ok.filter("nt is not null").select(F.col("doc_id").alias("id"), "nt"), "id", "left").withColumn("title", F.coalesce("nt", "title")).withColumn("level_1", F.coalesce("nt", "level_1")).select(*m.nodes.columns)
    given = ok.filter("ng is not null")
    tags = m.tags.join(given.select(F.col("doc_id").alias("node_id")), "node_id", "left_anti").select("node_id", "tag").unionByName(given.select(F.col("doc_id").alias("node_id"), F.explode("ng").alias("tag")).select("node_id", F.lower("tag").alias("tag")).distinct())
    event = ok.select(F.col("doc_id").alias("node_id"), stamp.alias("scanned_at"), F.lit("AGENT_VERIFIED").alias("change_type"))
    return m.but(docs=docs, nodes=nodes, tags=tags, history=m.history.unionByName(mutations.events(event, m.history))), told.select("doc_id", "result")


def rename_docs(m: Mesh, pairs: DataFrame) -> Mesh:
    """Move what is known of documents (old_id) and their sections to other ids (new_id): history, verification and edges. The
    old rows themselves are left to be deleted."""
    doc_of = F.concat_ws("::", F.get(F.split("id", "::"), 0), F.get(F.split("id", "::"), 1))
    own = m.nodes.select("id", doc_of.alias("old_id")).join(pairs, "old_id").select(F.col("id").alias("old"), F.concat("new_id", F.expr("substr(id, length(old_id) + 1)")).alias("new_id"))
    return mutations.rename(m, own.withColumnRenamed("old", "old_id"), ())


def move_docs(m: Mesh, pairs: DataFrame, at: datetime) -> Mesh:
    """rename_docs, and the documents and sections themselves under their new ids; the old ids are gone."""
    out = rename_docs(m, pairs)
    doc_of = F.concat_ws("::", F.get(F.split("id", "::"), 0), F.get(F.split("id", "::"), 1))
    new = F.coalesce(F.concat("new_id", F.expr("substr(id, length(old_id) + 1)")), "id")

    def moved(df: DataFrame, c: str) -> DataFrame:
        x = df.withColumnRenamed(c, "id") if c != "id" else df
        x = x.withColumn("old_id", doc_of).join(pairs.select("old_id", "new_id"), "old_id", "left").withColumn("id", new).drop("old_id", "new_id")
        return (x.withColumnRenamed("id", c) if c != "id" else x).select(*df.columns)

    sections = moved(out.sections.withColumnRenamed("id", "sid"), "sid").withColumnRenamed("sid", "id")
    for c in ("doc_id", "parent_id"):
        sections = moved(sections.withColumnRenamed("id", "sid"), c).withColumnRenamed("sid", "id")
    return out.but(nodes=moved(out.nodes, "id"), docs=moved(out.docs, "id"), sections=sections.select(*m.sections.columns), tags=moved(out.tags, "node_id"))


def renamed_docs(old: DataFrame, new: DataFrame) -> DataFrame:
    """old_id, new_id of documents whose file (file_path) has another id now. Both: id, file_path."""
    j = old.select(F.col("id").alias("old_id"), "file_path").join(new.select(F.col("id").alias("new_id"), "file_path"), "file_path")
    return j.filter("old_id <> new_id").select("old_id", "new_id")


def doc_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """id, change (added, removed, changed, same), old_content, new_content of the sections (id, heading, content) of two states."""
    a = old.select("id", F.col("heading").alias("oh"), F.col("content").alias("old_content"), F.lit(True).alias("was"))
    b = new.select("id", F.col("heading").alias("nh"), F.col("content").alias("new_content"), F.lit(True).alias("now"))
    j = a.join(b, "id", "full_outer")
    same = F.col("oh").eqNullSafe(F.col("nh")) & F.col("old_content").eqNullSafe(F.col("new_content"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(same, "same").otherwise("changed")
    return j.select("id", change.alias("change"), "old_content", "new_content")


def upsert_docs(m: Mesh, docs: DataFrame) -> Mesh:
    return m.but(docs=mutations.keep_latest(m.docs, docs.select(*m.docs.columns), "id"))


def upsert_sections(m: Mesh, sections: DataFrame) -> Mesh:
    """Insert or replace sections; their nodes show the same heading, content, hash and time, and are made where missing."""
    rows = cut(mutations.keep_latest(m.sections, sections.select(*m.sections.columns), "id"))
    return _replaced(add_shadows(m, rows), rows)


def add_shadows(m: Mesh, sections: DataFrame) -> Mesh:
    """The index with a node for each section that has none; those are written once, for the reason of keep_latest."""
    bare = sections.join(m.nodes.select("id"), "id", "left_anti")
    base = {c: F.lit(None).cast(t) for c, t in m.nodes.dtypes} | {"node_type": F.lit("atomic_process"), "subtype": F.lit("docjson"), "status": F.lit("active"), "source": F.lit("json_doc_scanner"), "own_status": F.lit("VERIFIED"), "link_status": F.lit("VERIFIED"), "updated_at": F.col("updated_at"), "id": F.col("id"), "title": F.col("heading"), "level_1": F.col("heading"), "level_2": F.col("content"), "desc_hash": F.col("desc_hash")}
    return m.but(nodes=m.nodes.unionByName(cut(bare.select(*[v.alias(c) for c, v in base.items()]).select(*m.nodes.columns))))


def _relinked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for raw, names in zip(b.column("raw").to_pylist(), b.column("names").to_pylist(), strict=True):
            data, new = json.loads(raw), dict(names)
            todo: list = [data]
            while todo:
                x = todo.pop()
                for link in x.get("links") or []:
                    if isinstance(link, dict) and link.get("node_id") in new:
                        link["node_id"] = new[link["node_id"]]
                todo += [y for y in x.get("sections") or [] if isinstance(y, dict)]
            out.append(json.dumps(data, indent=2, ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "raw"])


def patch_links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, raw of the documents (doc_id, raw) that link to an old_id of pairs, with new_id in its place. Only the names that
    a document links to come to it."""
    links = parse_docs(docs).filter("sec is not null").select("doc_id", F.explode("links").alias("old_id")).distinct()
    names = links.join(pairs, "old_id").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("old_id", "new_id"))).alias("names"))
    return docs.select("doc_id", "raw").join(names, "doc_id").mapInArrow(_relinked, "doc_id string, raw string")
