"""States of files and nodes at commits: name-status lines, renames, net differences, slices of earlier texts.

A repository comes as tables: commits (sha, seq), manifests (path, content_hash) and blobs (sha, path, content), read by
whatever has access to it; nothing here runs a program.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..mesh import Mesh
from .history import baselines, history_since
from .staleness import change_type

KINDS = {"CONTENT_ONLY": "content", "DESC_ONLY": "desc", "CONTENT_AND_DESC": "content+desc"}


def name_status(lines: DataFrame, line: str = "line") -> DataFrame:
    """change (A, M, D or R), old_path, path of lines of `git diff --name-status`: a copy counts as a rename, back slashes as
    slashes; other lines tell nothing."""
    p = F.split(F.replace(F.col(line), F.lit("\\"), F.lit("/")), "\t")
    code = F.substring(F.get(p, 0), 1, 1)
    two = code.isin("R", "C") & (F.size(p) >= 3)
    one = code.isin("A", "M", "D") & (F.size(p) >= 2)
    got = lines.withColumn("_p", p).filter(F.coalesce(one | two, F.lit(False)))
    p, code = F.col("_p"), F.substring(F.get("_p", 0), 1, 1)
    two = code.isin("R", "C")
    return got.select(F.when(two, "R").otherwise(code).alias("change"), F.when(two | (code == "D"), F.get(p, 1)).alias("old_path"), F.when(code != "D", F.when(two, F.get(p, 2)).otherwise(F.get(p, 1))).alias("path"))


def rename_pairs(committed: DataFrame, working: DataFrame) -> DataFrame:
    """old_path, path: renames of the commits carried on by those of the working tree. Both: old_path, path."""
    w = working.select(F.col("old_path").alias("mid"), F.col("path").alias("now"))
    through = committed.select("old_path", F.col("path").alias("mid")).join(w, "mid", "left").select("old_path", F.coalesce("now", "mid").alias("path"))
    fresh = w.join(committed.select(F.col("path").alias("mid")), "mid", "left_anti").select(F.col("mid").alias("old_path"), F.col("now").alias("path"))
    return through.unionByName(fresh).filter("old_path <> path")


def commits_ahead(commits: DataFrame, bases: DataFrame) -> DataFrame:
    """base, n: the number of commits (sha, seq) after each base (a sha or its beginning, of four digits at least), null if no commit has it."""
    last = commits.agg(F.max("seq").alias("last"))
    known = commits.select("sha", "seq", F.substring("sha", 1, 4).alias("head"))
    asked = bases.select("base").distinct().withColumn("head", F.substring("base", 1, 4))
    hit = asked.join(known, (asked["head"] == known["head"]) & F.col("sha").startswith(F.col("base")), "left").groupBy("base").agg(F.min("seq").alias("seq"))
    return hit.crossJoin(F.broadcast(last)).select("base", (F.col("last") - F.col("seq")).alias("n"))  # one row


def net_diff(nodes: DataFrame, changes: DataFrame, baseline: DataFrame, present: DataFrame) -> DataFrame:
    """id, kind of the nodes (id, location, code_hash, desc_hash) that differ from a baseline.

    changes: path, change of the files between the two. Nodes of added files are `added`, of renamed ones `renamed`. Those of
    modified files are compared by their hashes (baseline: id, code_hash, desc_hash): an edit taken back gives no row;
    one without a hash at the baseline is added if it has one now (present: id), and else tells nothing.
    """
    n = nodes.select("id", F.replace(F.coalesce("location", F.lit("")), F.lit("\\"), F.lit("/")).alias("path"), "code_hash", "desc_hash")
    hit = n.join(changes.select("path", "change").filter("change in ('A', 'M', 'R')").distinct(), "path")
    old = baseline.select("id", F.col("code_hash").alias("oc"), F.col("desc_hash").alias("od"), F.lit(True).alias("was"))
    hit = hit.join(old, "id", "left").join(present.select("id", F.lit(True).alias("now")).distinct(), "id", "left")
    change = change_type(F.col("oc"), F.col("od"), F.coalesce("code_hash", F.lit("")), F.col("desc_hash"))
    kinds = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    edited = F.when(F.col("was").isNull(), F.when(F.col("now"), "added")).otherwise(F.try_element_at(kinds, F.coalesce(change, F.lit(""))))
    kind = F.when(F.col("change") == "A", "added").when(F.col("change") == "R", "renamed").otherwise(edited)
    return hit.select("id", kind.alias("kind")).filter("kind is not null")


def changes_since(m: Mesh, after: datetime, diff: DataFrame, ahead: Column | None = None) -> DataFrame:
    """id, kind, ghost, meta, ahead: the nodes of a net difference, and those deleted since a time that don't live again, each
    with the meta of its first deletion. ahead tells how many commits the index is behind."""
    first = history_since(m.history, after).filter("change_type = 'DELETED'").groupBy(F.col("node_id").alias("id")).agg(F.min_by("meta", "id").alias("meta"))
    gone = first.join(m.nodes.select("id"), "id", "left_anti")
    live = diff.select("id", "kind", F.lit(False).alias("ghost"), F.lit(None).cast("string").alias("meta"))
    every = live.unionByName(gone.select("id", F.lit("deleted").alias("kind"), F.lit(True).alias("ghost"), "meta"))
    return every.withColumn("ahead", F.lit(None).cast("long") if ahead is None else ahead)


def _slice(content: str, at: str) -> Column:
    a, b = F.col(f"{at}.line_start"), F.col(f"{at}.line_end")
    return F.when(a.isNull(), F.col(content)).otherwise(fn.lines_between(content, a, b))


def node_diff(m: Mesh, blobs: DataFrame, files: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """id, git_sha, old, new, added, removed: each node's text at its baseline and now, and the numbers of lines that only one has.

    blobs: git_sha, path, content; files: path, content. baseline: id, git_sha; by default the newest verification or
    checkpoint of the node (history.baselines). Nodes without a baseline, or whose file wasn't there, have a null old text.
    """
    base = baselines(m.history).select(F.col("node_id").alias("id"), "git_sha") if baseline is None else baseline.select("id", "git_sha")
    n = m.nodes.filter("level_3_location is not null").select("id", fn.level3("level_3_location").alias("at")).withColumn("path", F.col("at.path")).join(base, "id", "left")
    n = n.join(blobs.select("git_sha", "path", F.col("content").alias("oc")), ["git_sha", "path"], "left").join(files.select("path", F.col("content").alias("nc")), "path", "left")
    n = n.withColumn("old", _slice("oc", "at")).withColumn("new", _slice("nc", "at"))
    return n.select("id", "git_sha", "old", "new", fn.lines_added("old", "new").alias("added"), fn.lines_added("new", "old").alias("removed"))


def recovered(deleted: DataFrame, blobs: DataFrame) -> DataFrame:
    """id, text, how: the source of deleted nodes. deleted: id, location, preserved_sha, preserved_level_3, baseline_sha.

    The lines that the deletion kept (`span`), else the whole file at the commit it kept or at the baseline (`file`)."""
    at = fn.level3("preserved_level_3")
    d = deleted.select("*", at.alias("at"))
    b = lambda sha, name: blobs.select(F.col("git_sha").alias(sha), F.col("path").alias("location"), F.col("content").alias(name))
    d = d.join(b("preserved_sha", "pc"), ["preserved_sha", "location"], "left").join(b("baseline_sha", "bc"), ["baseline_sha", "location"], "left")
    span = F.col("at.line_start").isNotNull() & F.col("pc").isNotNull()
    text = F.when(span, fn.lines_between("pc", F.col("at.line_start"), F.col("at.line_end"))).otherwise(F.coalesce("pc", "bc"))
    return d.select("id", text.alias("text"), F.when(span, "span").when(text.isNotNull(), "file").alias("how"))
